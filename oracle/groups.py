"""Feature groups: each function gives the select statement of one group and its columns."""

from __future__ import annotations

from oracle.base import EDGES, HOURS, PARAMS, PERIODS, PIDS, PLANS, Anchor, log5, spread

Group = tuple[dict[str, str], str]  # column name -> expression, FROM clause


def select(group: Group) -> str:
    cols, source = group
    return "select uid, " + ",\n".join(f'{e} as "{n}"' for n, e in cols.items()) + f"\nfrom {source}"


def month_panel(a: Anchor, table: str, value: str) -> str:
    return f"(select uid, mon, sum({value}) s from {table} group by uid, mon)"


def month_stats(a: Anchor, table: str, value: str, prefix: str, stats: tuple[str, ...]) -> str:
    """Statistics over months that have events."""
    agg = {
        "min": "min(s)", "mean": "avg(s)", "max": "max(s)", "median": "median(s)",
        "std": "stddev_samp(s)", "count": "count(s)", "sum": "sum(s)",
    }
    cols = ", ".join(f"{agg[s]} as {prefix}_{s}" for s in stats)
    return f"(select uid, {cols} from {month_panel(a, table, value)} group by uid)"


def hour_table(table: str, prefix: str) -> str:
    cols = ", ".join(f"count(*) filter (hb='{h}')/count(*) as {prefix}_hours_{h}" for h in HOURS)
    return f"(select uid, {cols} from {table} group by uid)"


def plan_table() -> str:
    n = "count(*) filter (plannum in (1,3,6,12))"
    cols = ", ".join(f"count(*) filter (plannum={p})/{n} as plannum_{p:02d}" for p in PLANS)
    return f"(select uid, {cols}, {n} as plannum_sum from ln group by uid)"


def gap_table(table: str, time: str, action: str, distinct: bool) -> str:
    n = "count(distinct wk)" if distinct else "count(*)"
    return f"""(select *, last_{action}_time - per_{action}_time_interval as is_exceed_{action}_interval from (
        select l.uid, l.wk as last_{action}_time,
               case when g.n=1 then 13.0-g.lo else (g.hi-g.lo)/(g.n-1) end as per_{action}_time_interval
        from (select uid, wk from (select uid, wk, row_number() over (partition by uid order by {time} desc) r
                                   from {table}) where r=1) l
        join (select uid, min(wk) lo, max(wk) hi, {n} n from {table} group by uid) g on l.uid=g.uid))"""


def user(a: Anchor) -> Group:
    return {
        "age": "age", "limit": "lim", "a_date": "round_even(adays/7.0,0)",
        "sex_1": "case when sex=1 then 1 else 0 end", "sex_2": "case when sex=2 then 1 else 0 end",
    }, "usr"


def month_flags(a: Anchor) -> str:
    m1, m2, m3 = a.months
    def both(*ms):
        return "case when " + " and ".join(f"list_contains(ms,{m})" for m in ms) + " then 1 else 0 end"
    return f"""(select uid, len(ms) as loan_times_months, {both(m1, m2)} as loan_12, {both(m1, m3)} as loan_13,
        {both(m2, m3)} as loan_23, {both(m1, m2, m3)} as loan_123
        from (select uid, list(distinct mon) ms from ln group by uid))"""


def exceed_table(a: Anchor) -> str:
    cols = ", ".join(
        f"coalesce(m{k},0)-lim as exceed_loan_{k}" for k in (1, 2, 3)
    )
    pivot = ", ".join(f"sum(amt) filter (mon={m}) as m{k}" for k, m in enumerate(a.months, 1))
    return f"(select l.uid, {cols} from (select uid, {pivot} from ln group by uid) l left join usr on usr.uid=l.uid)"


def loan(a: Anchor) -> Group:
    source = f"""
      (select uid, sum(amt) as loan_amount, sum(plannum) as plannum, count(*) as loan_times,
              sum(amt*(1.0/(1+wk))) as loan_weights, sum(due) as repay from ln group by uid) t
      join {month_flags(a)} f using (uid)
      join {month_stats(a, 'ln', 'amt', 'loan', ('min', 'mean', 'median', 'max', 'std'))} s using (uid)
      join {plan_table()} p using (uid)
      join {hour_table('ln', 'loan')} h using (uid)
      join {gap_table('ln', 'loan_time', 'loan', False)} g using (uid)
      join (select uid, arg_min(wk, loan_time) wk0, max(amt) largest from ln group by uid) e using (uid)
      join {exceed_table(a)} x using (uid)
      left join (select uid, lim, round_even(adays/7.0,0) a_date from usr) u using (uid)"""
    same = ["loan_amount", "plannum", "loan_times", "loan_weights", "repay", "loan_times_months",
            "loan_12", "loan_13", "loan_23", "loan_123"]
    cols = {c: c for c in same}
    cols["per_plannum_loan"] = "loan_amount/plannum"
    cols["per_times_loan"] = "loan_amount/loan_times_months"
    for c in ["loan_min", "loan_mean", "loan_median", "loan_max", "loan_std", "plannum_01", "plannum_03",
              "plannum_06", "plannum_12", "plannum_sum", *[f"loan_hours_{h}" for h in HOURS],
              "last_loan_time", "per_loan_time_interval", "is_exceed_loan_interval"]:
        cols[c] = c
    cols["active_loan_interval"] = "a_date-wk0"
    cols |= {f"exceed_loan_{k}": f"exceed_loan_{k}" for k in (1, 2, 3)}
    cols["new_limit"] = "case when lim > largest then lim else largest end"
    return cols, source


def loan_windows(a: Anchor) -> Group:
    stats = {"min": "min(amt)", "mean": "avg(amt)", "max": "max(amt)", "median": "median(amt)",
             "count": "count(amt)", "sum": "sum(amt)", "std": "stddev_samp(amt)"}
    aggs, cols = [], {}
    for lo, hi in zip(EDGES, EDGES[1:]):
        for s, e in stats.items():
            aggs.append(f"{e} filter (days > {lo} and days <= {hi}) as w{hi}_{s}")
            cols[f"loan_{hi}_{s}"] = f"coalesce(w{hi}_{s},0)"
    return cols, f"(select uid, {', '.join(aggs)} from ln group by uid)"


def click(a: Anchor) -> Group:
    shares = {f"pid_{v}": f"count(*) filter (pid={v})/(1+count(*))" for v in PIDS}
    shares |= {f"param_{v}": f"count(*) filter (param={v})/(1+count(*))" for v in PARAMS}
    stats = ("min", "mean", "max", "std", "median", "count", "sum")
    source = f"""
      (select uid, sum(1.0/(1+wk)) as click_weights, {', '.join(f'{e} as {n}' for n, e in shares.items())}
       from ck group by uid) t
      join {month_stats(a, 'ck', '1', 'click', stats)} s using (uid)
      join {hour_table('ck', 'click')} h using (uid)
      join {gap_table('ck', 'click_time', 'click', True)} g using (uid)"""
    names = ["click_weights", *shares, *[f"click_{s}" for s in stats], *[f"click_hours_{h}" for h in HOURS],
             "last_click_time", "per_click_time_interval", "is_exceed_click_interval"]
    return {n: n for n in names}, source


def order(a: Anchor) -> Group:
    stats = ("min", "mean", "max", "std", "median", "count", "sum")
    source = f"""
      (select uid, sum(1.0/(1+wk)) as buy_weights, sum(paid*(1.0/(1+wk))) as cost_weight, sum(paid) as real_price,
              case when sum(saved)+sum(paid)=0 then 0 else sum(saved)/(sum(saved)+sum(paid)) end as dis_ratio
       from od group by uid) t
      join {month_stats(a, 'od', 'paid', 'price', stats)} s using (uid)
      join {gap_table('od', 'buy_time', 'order', True)} g using (uid)"""
    names = ["buy_weights", "cost_weight", "real_price", "dis_ratio", *[f"price_{s}" for s in stats],
             "last_order_time", "per_order_time_interval", "is_exceed_order_interval"]
    return {n: f"coalesce({n},0)" for n in names}, source


def label(a: Anchor) -> Group:
    return {"label": "loan_sum"}, "v_loan_sum"


# ---- original variant ------------------------------------------------------------------------


def original_user(a: Anchor) -> Group:
    return {"age": "age", "sex": "sex", "limit": "limx", "a_date": "adays/7.0"}, "usr"


def zero_months(a: Anchor, table: str, value: str) -> list[str]:
    return [f"coalesce(sum({value}) filter (mon={m}),0)" for m in a.months]


def month_spread(a: Anchor, table: str, value: str, prefix: str) -> str:
    pivot = ", ".join(f"{e} as m{k}" for k, e in enumerate(zero_months(a, table, value), 1))
    cols = spread(prefix, ["m1", "m2", "m3"])
    return (f"(select uid, {', '.join(f'{e} as {n}' for n, e in cols.items())} "
            f"from (select uid, {pivot} from {table} group by uid))")


def loan_counts(a: Anchor) -> str:
    m1, m2, m3 = a.months
    def exactly(*ms):
        listed = ",".join(str(m) for m in ms)
        return f"case when count(*) filter (mon in ({listed})) = {len(ms)} then 1 else 0 end"
    return f"""(select uid, count(*) as loan_months, {exactly(m1, m2)} as loan_12, {exactly(m1, m3)} as loan_13,
        {exactly(m2, m3)} as loan_23, {exactly(m1, m2, m3)} as loan_123 from ln group by uid)"""


def original_loan(a: Anchor) -> Group:
    amt, due = a.original_amount, a.original_due
    hw = "(1.0/(0.000001::double+days/30.0))"
    plans = [f"plannum_{p:02d}" for p in PLANS]
    counts = ", ".join(f"count(*) filter (plannum={p}) as plannum_{p:02d}" for p in PLANS)
    plan_stats = spread("plannum", plans)
    hours = ", ".join(f"count(*) filter (hb='{h}') as loan_hours_{h}" for h in HOURS)
    source = f"""
      (select uid, sum({amt}) as loan_amount, sum(plannum) as plannum, sum({hw}) as loanTime_weights,
              sum({amt}*{hw}) as loan_weights, sum({due}) as repay from ln group by uid) t
      join {loan_counts(a)} c using (uid)
      join {month_spread(a, 'ln', amt, 'loan')} s using (uid)
      join (select *, {', '.join(f'{e} as {n}' for n, e in plan_stats.items())}
            from (select uid, {counts} from ln group by uid)) p using (uid)
      join (select uid, {hours} from ln group by uid) h using (uid)
      left join (select uid, limx from usr) u using (uid)"""
    cols = {c: c for c in ["loan_amount", "plannum", "loanTime_weights", "loan_weights", "repay", "loan_months",
                           "loan_12", "loan_13", "loan_23", "loan_123"]}
    cols["per_plannum"] = "plannum/loan_months"
    cols["per_times_loan"] = "loan_amount/loan_months"
    cols["exceed_loan"] = "case when loan_amount/loan_months - limx >= 0 then 1 else 0 end"
    for c in ["loan_min", "loan_max", "loan_sum", "loan_mean", "loan_std", *plans, *plan_stats,
              *[f"loan_hours_{h}" for h in HOURS]]:
        cols[c] = c
    return cols, source


def periods(table: str, value: str, prefix: str) -> Group:
    aggs = ", ".join(f"sum({value}) filter (days<={d}) as p{d}" for d in PERIODS)
    return {f"{prefix}_{d}": log5(f"coalesce(p{d},0)") for d in PERIODS}, \
        f"(select uid, {aggs} from {table} group by uid)"


def week_pivot(table: str, value: str) -> str:
    ends = {1: "days<=7", 2: "days>7 and days<=14", 3: "days>14 and days<=21", 4: "days>21 and days<=28"}
    aggs = ", ".join(f"coalesce(sum({value}) filter ({c}),0) as w{k}" for k, c in ends.items())
    return f"(select uid, {aggs} from {table} group by uid)"


def original_loan_periods(a: Anchor) -> Group:
    cols, source = periods("ln", "amt", "loan")
    cols |= {f"loan_filter_week{k}": f"w{k}" for k in (1, 2, 3, 4)}
    cols |= spread("filter_loan", ["w1", "w2", "w3", "w4"])
    return cols, f"{source} p join {week_pivot('ln', 'amt')} w using (uid)"


def original_order(a: Anchor) -> Group:
    source = f"""
      (select uid, sum(hw) as buy_weights, sum(paidx*hw) as cost_weight, sum(paidx) as real_price,
              sum(savedx)/(sum(savedx)+sum(paidx)) as dis_ratio from od group by uid) t
      join {month_spread(a, 'od', 'paidx', 'buy')} s using (uid)"""
    names = ["buy_weights", "cost_weight", "real_price", "dis_ratio",
             "buy_min", "buy_max", "buy_sum", "buy_mean", "buy_std"]
    cols = {n: f"coalesce({n},0)" for n in names}
    cols["dis_ratio"] = "case when isnan(dis_ratio) then 0 else coalesce(dis_ratio,0) end"
    return cols, source


def original_order_periods(a: Anchor) -> Group:
    return periods("od", "paidx", "order")


def original_click(a: Anchor) -> Group:
    decayed = {f"pid_{v}": f"sum(case when pid={v} then hw else 0 end)" for v in PIDS}
    decayed |= {f"param_{v}": f"sum(case when param={v} then hw else 0 end)" for v in PARAMS}
    hours = ", ".join(f"{log5(f'''count(*) filter (hb='{h}')''')} as click_hours_{h}" for h in HOURS)
    source = f"""
      (select uid, sum(hw) as click_weights, {', '.join(f'{e} as {n}' for n, e in decayed.items())}
       from ck group by uid) t
      join {month_spread(a, 'ck', '1', 'click')} s using (uid)
      join (select uid, {hours} from ck group by uid) h using (uid)"""
    names = ["click_weights", *decayed, "click_min", "click_max", "click_mean", "click_sum", "click_std",
             *[f"click_hours_{h}" for h in HOURS]]
    return {n: n for n in names}, source


def original_click_periods(a: Anchor) -> Group:
    return periods("ck", "1", "click")


FIT_MONTHS = (8, 9, 10, 11)


def code_panel() -> str:
    """(uid, mon) with codes 1..4 of loans, purchases and clicks over all fitting months."""
    def code(c):
        return (f"case when {c} <= {c}_lo+0.25*({c}_hi-{c}_lo) then 1 when {c} <= {c}_lo+0.5*({c}_hi-{c}_lo) then 2 "
                f"when {c} <= {c}_lo+0.75*({c}_hi-{c}_lo) then 3 else 4 end")
    edges = ", ".join(f"min({c}) as {c}_lo, max({c}) as {c}_hi" for c in ("l", "p", "c"))
    return f"""(
      with panel as ({level_panel('2016-08-01', '2016-12-01')}),
      edge as (select {edges} from panel)
      select uid, mon, {code('l')} as lc, {code('p')} as pc, {code('c')} as cc from panel, edge)"""


def level_panel(start: str, end: str) -> str:
    """(uid, mon) with encoded totals of loans, purchases and clicks."""
    def within(time: str, kind: str) -> str:
        return f"{time} >= {kind} '{start}' and {time} < {kind} '{end}'"
    paid = "(" + _net_exact() + ")"
    return f"""
        select uid, mon, {log5('coalesce(ls,0)')} as l, {log5('coalesce(ps,0)')} as p, {log5('coalesce(cs,0)')} as c
        from (select uid, month(loan_time) mon, sum(round_even(pow(5,loan_amount)-1,0)) ls from v_loan
              where {within('loan_time', 'timestamp')} group by all)
        full join (select uid, month(buy_time) mon, sum({paid}) ps from v_order
              where {within('buy_time', 'date')} group by all) using (uid, mon)
        full join (select uid, month(click_time) mon, count(click_time) cs from v_click
              where {within('click_time', 'timestamp')} group by all) using (uid, mon)"""


def edge_drift() -> str:
    """Edges of the training window, and the scoring window's levels beyond them."""
    names = {"l": "loan", "p": "paid", "c": "clicks"}
    then, now = (
        " union all ".join(f"select '{name}' as level, {c} as x from {panel}" for c, name in names.items())
        for panel in ("panel_then", "panel_now")
    )
    return f"""
      (with panel_then as ({level_panel('2016-08-01', '2016-11-01')}), panel_now as ({level_panel('2016-09-01', '2016-12-01')}),
        edge as (select level, min(x) as low, max(x) as high from ({then}) group by level)
      select level, low, high, min(x) as low_now, max(x) as high_now, count(*) as n,
        count(*) filter (x < low) as below, count(*) filter (x > high) as above
      from ({now}) join edge using (level) group by all)"""


def _net_exact() -> str:
    value = "(pow(5,price)-1)*qty-(pow(5,discount)-1)"
    return f"case when {value} < 0 then 0 else {value} end"


def union(a: Anchor) -> Group:
    parts = {"lp": "lc{m}+pc{m}", "lc": "lc{m}+cc{m}", "pc": "pc{m}+cc{m}", "lpc": "lc{m}+pc{m}+cc{m}"}
    cols = {}
    for slot, m in zip(("first", "two", "three"), a.months):
        for n, e in parts.items():
            cols[f"{n}_{slot}"] = e.format(m=m)
    pivot = ", ".join(
        f"coalesce(max({c}) filter (mon={m}),0) as {c}{m}" for m in FIT_MONTHS for c in ("lc", "pc", "cc")
    )
    cols = {**cols, **spread("union", [f"({e})" for e in cols.values()])}
    return cols, f"(select uid, {pivot} from {code_panel()} group by uid)"


def _level(a: Anchor, table: str, value: str) -> str:
    cols = ", ".join(f"{log5(e)} as m{k}" for k, e in enumerate(zero_months(a, table, value), 1))
    return f"(select uid, {cols} from {table} group by uid)"


LEVELS = {"l": ("ln", "amt"), "o": ("od", "paidx"), "c": ("ck", "1")}


def _product(tables: dict[str, str], letters: str, fields: list[str], name: str) -> str:
    """Inner join of two or three tables and the products of their columns."""
    first, *rest = letters
    source = f"{tables[first]} {first}" + "".join(f" join {tables[r]} {r} on {r}.uid={first}.uid" for r in rest)
    cols = ", ".join(
        "*".join(f"{x}.{f}" for x in letters) + f" as {name}_{k}" for k, f in enumerate(fields, 1)
    )
    return f"(select {first}.uid as uid, {cols} from {source})"


def interactive(a: Anchor, tables: dict[str, str], fields: list[str], prefix: str) -> Group:
    """Outer join of the four products, gaps 0, and statistics over all of them."""
    names = ["lo", "co", "lc", "lco"]
    joined = _product(tables, "lo", fields, f"{prefix}lo")
    for n in names[1:]:
        joined = f"{joined} full join {_product(tables, n, fields, f'{prefix}{n}')} using (uid)"
    cols = {f"{prefix}{n}_{k}": f"coalesce({prefix}{n}_{k},0)" for n in names for k in range(1, len(fields) + 1)}
    return {**cols, **spread("interactive", list(cols.values()))}, joined


def interactive_month(a: Anchor) -> Group:
    tables = {x: _level(a, t, v) for x, (t, v) in LEVELS.items()}
    return interactive(a, tables, ["m1", "m2", "m3"], "")


def interactive_week(a: Anchor) -> Group:
    tables = {x: week_pivot(t, v) for x, (t, v) in LEVELS.items()}
    return interactive(a, tables, ["w1", "w2", "w3", "w4"], "week_")


def interactive_all(a: Anchor) -> Group:
    month, mfrom = interactive_month(a)
    week, wfrom = interactive_week(a)
    def renamed(group, suffix):
        cols, source = group
        return select(({(n + suffix if n.startswith("interactive") else n): e for n, e in cols.items()}, source))
    stats = {}
    weeks = ""
    for x, action in (("l", "loan"), ("o", "order"), ("c", "click")):
        t, v = LEVELS[x]
        cols = spread(f"{action}_weeks", ["w1", "w2", "w3", "w4"])
        stats |= cols
        part = f"({select((cols, week_pivot(t, v)))})"
        weeks = f"{weeks} full join {part} using (uid)" if weeks else part
    source = (f"({renamed((month, mfrom), '_x')}) full join (select * from {weeks}) using (uid) "
              f"full join ({renamed((week, wfrom), '_y')}) using (uid)")
    names = [n + "_x" if n.startswith("interactive") else n for n in month]
    names += list(stats)
    names += [n + "_y" if n.startswith("interactive") else n for n in week]
    return {n: f"coalesce({n},0)" for n in names}, source
