"""Shared parts: the five input views, and the decoded events of one anchor."""

from __future__ import annotations

from dataclasses import dataclass

INPUTS = {
    "v_user": """
        select c_custkey uid, 18+c_nationkey age, 1+c_nationkey%2 sex,
               ln(floor(greatest(c_acctbal,0)*60)+1)/ln(5) "limit",
               date '2016-08-01' - cast((c_custkey*37)%500 as int) active_date
        from customer""",
    "v_loan": """
        select o_custkey uid,
               make_timestamp(1000000*(1470009600 + (cast(epoch(o_orderdate) as bigint) - 788918400)//5)) loan_time,
               ln(floor(o_totalprice)+1)/ln(5) loan_amount,
               case substr(o_orderpriority,1,1) when '2' then 3 when '3' then 6 when '4' then 12 else 1 end plannum
        from orders""",
    "v_click": """
        select user_id uid,
               make_timestamp(1000000*(1470009600 + 4*(cast(floor(epoch(ts)) as bigint) - 1704067200))) click_time,
               case event_type when 'click' then 1 when 'error' then 2 when 'purchase' then 3
                               when 'signup' then 4 else 5 end pid,
               cast(json_extract_string(props,'$.k') as int)%48+1 param
        from events""",
    "v_order": """
        select o_custkey uid,
               cast(make_timestamp(1000000*(1470009600 + (cast(epoch(l_shipdate) as bigint) - 788918400)//5)) as date)
                 buy_time,
               ln(floor(l_extendedprice/l_quantity)+1)/ln(5) price, cast(l_quantity as int) qty,
               case when l_linenumber=7 then null else ln(floor(l_extendedprice*l_discount*12)+1)/ln(5) end discount
        from lineitem join orders on l_orderkey=o_orderkey""",
    "v_loan_sum": """
        select uid, ln(sum(round_even(pow(5,loan_amount)-1,0))+1)/ln(5) loan_sum
        from v_loan where loan_time>=timestamp '2016-11-01' and loan_time<timestamp '2016-12-01' group by uid""",
}

HOURS = ("01", "02", "03", "04", "05", "06")
BUCKET = """case when hr between 8 and 11 then '01' when hr between 12 and 15 then '02'
            when hr between 16 and 19 then '03' when hr between 20 and 23 then '04'
            when hr between 4 and 7 then '05' else '06' end"""
EDGES = (0, 3, 7, 14, 21, 28, 35, 42, 49, 56, 63, 70, 77, 84)
PERIODS = (1, 2, 3, 5, 7, 9, 15, 20, 25, 30, 35, 40, 45, 50, 60, 70, 80, 90)
PIDS = tuple(range(1, 11))
PARAMS = tuple(range(1, 49))
PLANS = (1, 3, 6, 12)


@dataclass(frozen=True)
class Anchor:
    day: str
    start: str
    months: tuple[int, ...]
    order_numerator: str
    original_amount: str  # which decoded amount the original loan features use
    original_due: str

    @property
    def cut(self) -> int:
        return self.months[-1] - 1


TRAIN = Anchor("2016-11-01", "2016-08-01", (8, 9, 10), "1.0", "amx", "duex")
SCORE = Anchor("2016-12-01", "2016-09-01", (9, 10, 11), "0.1", "amt", "due")


def net(price: str, qty: str, discount: str) -> str:
    value = f"({price})*({qty})-({discount})"
    return f"case when {value} < 0 then 0 else {value} end"


def events(a: Anchor) -> dict[str, str]:
    """Decoded events before the anchor; time is measured towards it."""
    amt = "round_even(pow(5,loan_amount)-1,0)"
    amx = "(pow(5,loan_amount)-1)"
    due = "case when plannum=1 and month(loan_time)<={cut} then 0 else {amt}/plannum end"
    p0 = "round_even(pow(5,coalesce(price,0))-1,0)"
    d0 = "round_even(pow(5,coalesce(discount,0))-1,0)"
    px, dx = "(pow(5,price)-1)", "(pow(5,discount)-1)"
    return {
        "usr": f"""
            select uid, age, sex, round_even(pow(5,"limit")-1,0) lim, pow(5,"limit")-1 limx,
                   date_diff('day', active_date, date '{a.day}') adays
            from v_user""",
        "ln": f"""
            select *, cast(round_even(days/7.0,0) as bigint) wk, {BUCKET} hb from (
              select uid, loan_time, plannum, {amt} amt, {amx} amx, month(loan_time) mon, hour(loan_time) hr,
                     {due.format(cut=a.cut, amt=amt)} due, {due.format(cut=a.cut, amt=amx)} duex,
                     cast(floor((epoch(timestamp '{a.day}')-epoch(loan_time))/86400) as bigint) as days
              from v_loan where loan_time >= timestamp '{a.start}' and loan_time < timestamp '{a.day}')""",
        "ck": f"""
            select *, cast(round_even(days/7.0,0) as bigint) wk, {BUCKET} hb, 1.0/(0.000001::double+days) hw from (
              select uid, click_time, pid, param, month(click_time) mon, hour(click_time) hr,
                     cast(floor((epoch(timestamp '{a.day}')-epoch(click_time))/86400) as bigint) as days
              from v_click where click_time >= timestamp '{a.start}' and click_time < timestamp '{a.day}')""",
        "od": f"""
            select *, cast(round_even(days/7.0,0) as bigint) wk,
                   {a.order_numerator}::double/(0.000001::double+days) hw from (
              select uid, buy_time, month(buy_time) mon, {net(p0, 'coalesce(qty,0)', d0)} paid, {d0} saved,
                     {net(px, 'qty', dx)} paidx, {dx} savedx,
                     date_diff('day', buy_time, date '{a.day}') as days
              from v_order where buy_time >= date '{a.start}' and buy_time < date '{a.day}')""",
    }


def with_(ctes: dict[str, str], body: str) -> str:
    text = ",\n".join(f"{name} as ({sql})" for name, sql in ctes.items())
    return f"with {text}\n{body}"


def query(a: Anchor, body: str, **more: str) -> str:
    """A statement over the inputs and the events of one anchor."""
    return with_({**INPUTS, **events(a), **more}, body)


def num(expr: str, name: str) -> str:
    """A double at four decimals and single precision; adding 0 turns a negative zero into a plain one."""
    return f'cast(cast(round(cast({expr} as double),4) as float) as double)+0.0 as "{name}"'


def comparable(name: str) -> str:
    """A double column the same way."""
    return num(f'"{name}"', name)


def nums(exprs: dict[str, str]) -> str:
    return ",\n".join(num(e, n) for n, e in exprs.items())


def whole(expr: str, name: str) -> str:
    return f'cast({expr} as bigint) as "{name}"'


def log5(expr: str) -> str:
    return f"ln(({expr})+1)/ln(5)"


def row_std(cols: list[str]) -> str:
    """Sample deviation across columns, through an unnested list."""
    return f"list_stddev_samp([{', '.join(cols)}])"


def spread(prefix: str, cols: list[str]) -> dict[str, str]:
    items = ", ".join(f"cast({c} as double)" for c in cols)
    return {
        f"{prefix}_min": f"least({items})",
        f"{prefix}_max": f"greatest({items})",
        f"{prefix}_sum": f"list_sum([{items}])",
        f"{prefix}_mean": f"list_avg([{items}])",
        f"{prefix}_std": f"1/(1+list_stddev_samp([{items}]))",
    }
