"""One statement per query name."""

from __future__ import annotations

from oracle import groups as g
from oracle import matrices as m
from oracle.base import (
    BUCKET, HOURS, PARAMS, PIDS, SCORE, TRAIN, Anchor, comparable, log5, num, query, spread, whole,
)

SEED = 2017


def rounded(a: Anchor, group: g.Group, tail: str = "", **ctes: str) -> str:
    cols, source = group
    inner = "select uid, " + ",\n".join(f'cast({e} as double) as "{n}"' for n, e in cols.items())
    outer = ",\n".join(comparable(n) for n in cols)
    return query(a, f"select {whole('uid', 'uid')}, {outer}\nfrom ({inner}\nfrom {source} {tail})", **ctes)


def _doubles(group: g.Group) -> g.Group:
    return {n: f"cast({e} as double)" for n, e in group[0].items()}, group[1]


def pick(group: g.Group, *names: str) -> g.Group:
    return {n: group[0][n] for n in names}, group[1]


def hash_text(uid: str = "uid", seed: int = SEED) -> str:
    return f"md5(concat({uid},'|{seed}'))"


def fold(uid: str = "uid") -> str:
    return f"(cast(concat('0x',substr({hash_text(uid)},1,8)) as bigint)%5)"


AT = "cast(epoch(loan_time) as bigint)"
AGE = f"floor((epoch(timestamp '{TRAIN.day}')-epoch(loan_time))/86400)"

# Forecast by a fixed rule: the encoded total of the last observed month.
RULE = """
    select u.uid, coalesce(ln(sum(l.amt)+1)/ln(5),0) pred from v_user u
    left join (select * from ln where mon=10) l on l.uid=u.uid group by u.uid"""
RULE_LABEL = "select uid, pred, coalesce(loan_sum,0) label from rule left join v_loan_sum using (uid)"


def scalar_queries() -> dict[str, str]:
    weight_row = "select 'loan' kind, uid, cast(loan_time as date) d, wk, days, 1.0/(0.000001::double+days/30.0) hyper from ln"
    order_row = "select 'order' kind, uid, buy_time d, wk, days, hw hyper from od"
    click_row = "select 'click' kind, uid, cast(click_time as date) d, wk, days, hw hyper from ck"
    raw_order = """(select uid, buy_time, case when p0*q0-d0 < 0 then 0 else p0*q0-d0 end paid,
                    case when p1*qty-d1 < 0 then 0 else p1*qty-d1 end paid_exact from
                    (select *, round_even(pow(5,coalesce(price,0))-1,0) p0, coalesce(qty,0) q0,
                     round_even(pow(5,coalesce(discount,0))-1,0) d0, pow(5,price)-1 p1, pow(5,discount)-1 d1
                     from v_order))"""
    return {
        "q_decode_rounded": f"select event_id, {num('round_even(pow(5,value/150)-1,0)', 'money')} from events",
        "q_decode_exact": f"select event_id, {num('pow(5,value/150)-1', 'money')} from events",
        "q_encode_log5": f"select o_orderkey, {num(log5('o_totalprice'), 'stored')} from orders",
        "q_event_age": query(TRAIN, f"""
            select uid, {whole(AT, 'at')}, {whole('month(loan_time)', 'month')}, {whole('hour(loan_time)', 'hour')},
                   {whole(AGE, 'days')}, {whole(f'round_even({AGE}/7.0,0)', 'weeks')},
                   {num(f'{AGE}/7.0', 'fractional_weeks')} from v_loan"""),
        "q_hour_bucket": query(TRAIN, f"""
            select 'loan' as action, uid, {whole(AT, 'at')}, {BUCKET} as bucket
            from (select *, hour(loan_time) hr from v_loan)
            union all
            select 'click', uid, cast(epoch(click_time) as bigint), {BUCKET}
            from (select *, hour(click_time) hr from v_click)"""),
        "q_recency_weights": query(TRAIN, f"""
            select kind, uid, cast(d as varchar) as day, {whole('days', 'days')}, {num('1.0/(1+wk)', 'weekly')},
                   {num('hyper', 'hyperbolic')} from ({weight_row} union all {order_row} union all {click_row})"""),
        "q_net_price": query(TRAIN, f"""
            select uid, cast(buy_time as varchar) as day, {num('paid', 'paid')}, {num('paid_exact', 'paid_exact')}
            from {raw_order}"""),
        "q_discount_rate": query(TRAIN, f"""
            select uid, {num('case when sum(saved)+sum(paid)=0 then 0 else sum(saved)/(sum(saved)+sum(paid)) end',
                             'dis_ratio')} from od group by uid"""),
        "q_installment_due": query(TRAIN, f"""
            select uid, {whole(AT, 'at')}, {whole('plannum', 'plannum')}, {num('due', 'due')} from ln"""),
        "q_onehot_sex": rounded(TRAIN, pick(g.user(TRAIN), "sex_1", "sex_2")),
        "q_filter_amount_band": query(TRAIN, f"""
            select uid, {whole(AT, 'at')}, {num('amt', 'amount')} from ln where amt > 499 and amt <= 90000 and mon = 10"""),
        "q_active_borrowers": query(TRAIN, f"""
            select uid, {whole('age', 'age')}, {whole('case when uid in (select uid from ln) then 1 else 0 end',
            'borrower')} from v_user"""),
        "q_union_all_months": query(TRAIN, f"""
            select uid, {whole(AT, 'at')}, {whole('mon', 'month')}, {num('due', 'due')} from ln where mon = 8
            union all select uid, {AT}, mon, cast(cast(round(due,4) as float) as double)+0.0 from ln where mon = 9
            union all select uid, {AT}, mon, cast(cast(round(due,4) as float) as double)+0.0 from ln where mon = 10"""),
    }


def loan_queries() -> dict[str, str]:
    a = TRAIN
    loan = g.loan(a)

    def cols(*names: str) -> str:
        return rounded(a, pick(loan, *names))

    weeks, wfrom = g.original_loan_periods(a)
    filled = {}
    source = ""
    for table, value, prefix in (("ln", "amx", "loan"), ("od", "paidx", "buy"), ("ck", "1", "click")):
        part = g.month_spread(a, table, value, prefix)
        source = f"{source} full join {part} using (uid)" if source else part
        filled |= {f"{prefix}_{s}": f"{prefix}_{s}" for s in ("min", "max", "sum", "mean", "std")}

    def edge(order: str) -> str:
        return query(a, f"""
            select uid, {whole(AT, 'at')}, {num('amt', 'amount')}, {whole('plannum', 'plannum')} from (
              select *, row_number() over (partition by uid order by loan_time {order}, amt {order}, plannum {order}) r
              from ln) where r=1""")

    return {
        "q_loan_month_stats": cols("loan_min", "loan_mean", "loan_median", "loan_max", "loan_std"),
        "q_month_stats_zero_filled": rounded(a, (filled, source)),
        "q_loan_hour_share": cols(*[f"loan_hours_{h}" for h in HOURS]),
        "q_plannum_share": cols("plannum_01", "plannum_03", "plannum_06", "plannum_12", "plannum_sum"),
        "q_loan_recency_gap": cols("last_loan_time", "per_loan_time_interval", "is_exceed_loan_interval"),
        "q_last_loan": edge("desc"),
        "q_first_loan": edge("asc"),
        "q_activation_gap": cols("active_loan_interval"),
        "q_limit_update": cols("new_limit"),
        "q_exceed_by_month": cols("exceed_loan_1", "exceed_loan_2", "exceed_loan_3"),
        "q_month_flags": cols("loan_times_months", "loan_12", "loan_13", "loan_23", "loan_123"),
        "q_month_flags_counts": rounded(a, pick(g.original_loan(a), "loan_months", "loan_12", "loan_13", "loan_23", "loan_123")),
        "q_loan_ratio_of_sums": cols("loan_weights", "per_plannum_loan", "per_times_loan"),
        "q_loan_windows": rounded(a, g.loan_windows(a)),
        "q_loan_periods": rounded(a, g.periods("ln", "amt", "loan")),
        "q_loan_weeks": rounded(a, ({n: e for n, e in weeks.items() if "filter" in n}, wfrom)),
        "q_loan_features": rounded(a, loan),
        "q_loan_features_scoring": rounded(SCORE, g.loan(SCORE)),
        "q_loan_windows_scoring": rounded(SCORE, g.loan_windows(SCORE)),
        "q_v1_loan": rounded(a, g.original_loan(a)),
        "q_v1_loan_scoring": rounded(SCORE, g.original_loan(SCORE)),
        "q_v1_loan_filter": rounded(a, g.original_loan_periods(a)),
    }


def other_group_queries() -> dict[str, str]:
    a = TRAIN
    click, order, oclick = g.click(a), g.order(a), g.original_click(a)
    stats = ("min", "mean", "max", "std", "median", "count", "sum")
    values = [f"pid_{v}" for v in PIDS] + [f"param_{v}" for v in PARAMS]
    return {
        "q_user_features": rounded(a, g.user(a)),
        "q_click_month_stats": rounded(a, pick(click, *[f"click_{s}" for s in stats])),
        "q_order_month_stats": rounded(a, pick(order, *[f"price_{s}" for s in stats])),
        "q_click_hour_share": rounded(a, pick(click, *[f"click_hours_{h}" for h in HOURS])),
        "q_click_recency_gap": rounded(a, pick(click, "last_click_time", "per_click_time_interval", "is_exceed_click_interval")),
        "q_order_recency_gap": rounded(a, pick(order, "last_order_time", "per_order_time_interval", "is_exceed_order_interval")),
        "q_click_onehot_share": rounded(a, pick(click, *values)),
        "q_click_onehot_decayed": rounded(a, pick(oclick, "click_weights", *values)),
        "q_order_periods": rounded(a, g.original_order_periods(a)),
        "q_click_periods": rounded(a, g.original_click_periods(a)),
        "q_click_features": rounded(a, click),
        "q_order_features": rounded(a, order),
        "q_labels": rounded(a, g.label(a)),
        "q_v1_user": rounded(a, g.original_user(a)),
        "q_v1_order": rounded(a, g.original_order(a)),
        "q_v1_order_scoring": rounded(SCORE, g.original_order(SCORE)),
        "q_v1_click": rounded(a, oclick),
        "q_union_codes": query(a, f"""
            select uid, {whole('mon', 'month')}, {num('lc', 'loan_code')}, {num('pc', 'paid_code')},
                   {num('cc', 'clicks_code')} from {g.code_panel()}"""),
        "q_union_features": rounded(a, g.union(a)),
        "q_union_features_scoring": rounded(SCORE, g.union(SCORE)),
        "q_union_edge_drift": query(SCORE, f"""
            select level, {num('low', 'low')}, {num('high', 'high')}, {num('low_now', 'low_now')},
                   {num('high_now', 'high_now')}, {whole('n', 'n')}, {whole('below', 'below')}, {whole('above', 'above')}
            from {g.edge_drift()}"""),
        "q_interactive_month": rounded(a, g.interactive_month(a)),
        "q_interactive_week": rounded(a, g.interactive_all(a)),
    }


def matrix_queries() -> dict[str, str]:
    cohorts = {"cohorts": m.cohorts(TRAIN)}
    full = m.original(TRAIN, True)
    names = sorted(c for c in full[0] if c != "label")
    split = f"""
        select {whole('uid', 'uid')}, {', '.join(comparable(n) for n in names)}, {num('label', 'label')},
               {num('coalesce(label2,0)', 'label2')},
               cast(row_number() over (order by {hash_text()}, uid)
                    <= floor(0.2*(select count(*) from full_matrix)) as bigint) as held_out
        from full_matrix left join (select uid, cohort as label2 from cohorts where cohort>0) using (uid)"""
    training, scoring = rounded(TRAIN, m.training(TRAIN)), rounded(SCORE, m.scoring(SCORE))
    return {
        "q_matrices_two_anchors": f"""
            select date '{TRAIN.day}' as anchor, * from ({training})
            union all by name select date '{SCORE.day}' as anchor, * from ({scoring})""",
        "q_describe_matrix": query(TRAIN, f"""
            select "column", stat, value from (
                select "column", {num('count(v)', 'count')}, {num('avg(v)', 'mean')}, {num('stddev_samp(v)', 'std')},
                    {num('min(v)', 'min')}, {num('max(v)', 'max')}, {num('quantile_cont(v,0.25)', '25%')},
                    {num('quantile_cont(v,0.5)', '50%')}, {num('quantile_cont(v,0.75)', '75%')}
                from wide unpivot include nulls (v for "column" in (columns(* exclude (uid)))) group by "column"
            ) unpivot include nulls (value for stat in (columns(* exclude ("column"))))""", wide=g.select(_doubles(m.training(TRAIN)))),
        "q_training_matrix": rounded(TRAIN, m.training(TRAIN)),
        "q_scoring_matrix": rounded(SCORE, m.scoring(SCORE)),
        "q_top_rows": rounded(TRAIN, m.training(TRAIN), tail="order by uid limit 10"),
        "q_v1_training_matrix": rounded(TRAIN, full),
        "q_v1_scoring_matrix": rounded(SCORE, m.original(SCORE, False)),
        "q_model1_matrix": rounded(TRAIN, m.model1(TRAIN)),
        "q_model2_matrix": rounded(TRAIN, m.model2(TRAIN)),
        "q_model1_scoring_matrix": rounded(SCORE, m.model1(SCORE, False)),
        "q_model2_scoring_matrix": rounded(SCORE, m.model2(SCORE, False)),
        "q_cohort_matrix": rounded(TRAIN, m.cohort(TRAIN, True), **cohorts),
        "q_cohort_scoring_matrix": rounded(SCORE, m.cohort(SCORE, False)),
        "q_split_matrix": query(TRAIN, split, **cohorts, full_matrix=g.select(_doubles(full))),
        "q_shape": query(TRAIN, f"select count(*) as \"rows\", {whole(len(m.training(TRAIN)[0]) + 1, 'cols')} "
                                f"from (select uid from {m.training(TRAIN)[1]})"),
    }


def cohort_queries() -> dict[str, str]:
    ctes = {"cohorts": m.cohorts(TRAIN)}
    borrowed = "select distinct uid from v_loan where loan_time >= timestamp '{}' and loan_time < timestamp '{}'"
    train, submit = borrowed.format(TRAIN.start, TRAIN.day), borrowed.format(SCORE.start, SCORE.day)
    return {
        "q_cohorts": query(TRAIN, f"select uid, {whole('cohort', 'cohort')} from cohorts", **ctes),
        "q_cohort_labels": query(TRAIN, f"select uid, {num('cohort', 'label2')} from cohorts where cohort>0", **ctes),
        "q_new_borrowers_by_month": query(TRAIN, f"""
            select uid, {whole("date_diff('month', date '2016-08-01', min(loan_time)) + 1", 'first_month')} from v_loan
            where loan_time >= timestamp '2016-08-01' and loan_time < timestamp '2016-12-01' group by uid
            having min(loan_time) >= timestamp '2016-09-01'"""),
        "q_population_split": query(TRAIN, f"""
            select u.uid, {whole('case when t.uid is not null then 1 else 2 end', 'train_model')},
                   {whole('case when s.uid is not null then 1 else 2 end', 'submit_model')}
            from v_user u left join ({train}) t on t.uid=u.uid left join ({submit}) s on s.uid=u.uid"""),
        "q_cohort_sample": query(TRAIN, f"""
            select uid, {whole('cohort', 'cohort')},
                   cast(row_number() over (partition by cohort order by {hash_text()}, uid)
                     <= floor(0.2*count(*) over (partition by cohort)) as bigint) as sampled from cohorts""", **ctes),
        "q_shuffled": query(TRAIN, "select uid, age from v_user"),
        "q_fold_assignment": query(TRAIN, f"select uid, {whole(fold(), 'fold')} from v_user"),
        "q_holdout_split": query(TRAIN, f"""
            select uid, cast(row_number() over (order by {hash_text()}, uid)
                             <= floor(0.2*count(*) over ()) as bigint) as held_out
            from v_user"""),
        "q_downsample_negatives": query(TRAIN, f"""
            select uid, {num('label', 'label')} from (
              select *, row_number() over (partition by label order by {hash_text()}, uid) r from y)
            where label=1 or r <= 50""",
            y="select u.uid, case when coalesce(loan_sum,0)<>0 then 1 else 0 end label from v_user u "
              "left join v_loan_sum s using (uid)"),
        "q_value_counts": query(TRAIN, "select cohort, count(*) as n from (select cast(cohort as bigint) cohort "
                                       "from cohorts) group by cohort", **ctes),
        "q_profile": query(TRAIN, f"""
            unpivot (select {num('count(loan_sum)', 'count')}, {num('avg(loan_sum)', 'mean')},
                {num('stddev_samp(loan_sum)', 'std')}, {num('min(loan_sum)', 'min')}, {num('max(loan_sum)', 'max')},
                {num('quantile_cont(loan_sum,0.25)', '25%')}, {num('quantile_cont(loan_sum,0.5)', '50%')},
                {num('quantile_cont(loan_sum,0.75)', '75%')} from v_loan_sum)
            on columns(*) into name stat value value"""),
    }


def evaluation_queries() -> dict[str, str]:
    ctes = {"rule": RULE, "judged": RULE_LABEL}
    f1 = "2*tp/(2*tp+fp+fn)"
    counts = """(select count(*) filter (p and y) tp, count(*) filter (p and not y) fp,
                 count(*) filter (not p and y) fn, count(*) filter (not p and not y) tn
                 from (select pred>=0.5 p, label<>0 y from judged))"""
    return {
        "q_rmse": query(TRAIN, f"""
            select count(*) as n, {num('avg((pred-label)*(pred-label))', 'mse')},
                   {num('sqrt(avg((pred-label)*(pred-label)))', 'rmse')} from judged""", **ctes),
        "q_binary_metrics": query(TRAIN, f"""
            select tp, fp, fn, tn, tp+fn as label_1, fp+tn as label_0, tp+fp as pred_1, fn+tn as pred_0,
                   {num('(tp+tn)/(tp+tn+fp+fn)', 'accuracy')}, {num('tp/(tp+fp)', 'precision')},
                   {num('tp/(tp+fn)', 'recall')}, {num(f1, 'f1')} from {counts}""", **ctes),
        "q_confusion": query(TRAIN, f"""
            select {num('case when label<>0 then 1 else 0 end', 'label')},
                   {num('case when pred>=0.5 then 1 else 0 end', 'pred')}, count(*) as n
            from judged group by 1, 2""", **ctes),
        "q_cap_prediction": query(TRAIN, f"""
            select uid, {num('pred-4', 'pred')}, {num('case when pred-4<=0 then 0 else pred-4 end', 'clamped')},
                   {num('abs(pred-4)', 'folded')}, {num('case when pred-4>=0.5 then 1 else 0 end', 'decided')},
                   {num('case when lim is null or pred<=lim then pred else lim end', 'capped')}
            from rule left join (select uid, "limit"*0.8 lim from v_user) using (uid)""", **ctes),
        "q_mean_prediction": query(TRAIN, f"""
            select uid, {num('avg(p)', 'pred')} from (
              select uid, pred p from rule union all select uid, greatest(pred-1,0) from rule) group by uid""", **ctes),
        "q_standardised": query(TRAIN, f"""
            select uid, {', '.join(num(f'({c}-avg({c}) over ())/stddev_pop({c}) over ()', c)
                                   for c in ('loan_amount', 'loan_weights', 'repay', 'last_loan_time'))}
            from ({g.select(pick(g.loan(TRAIN), 'loan_amount', 'loan_weights', 'repay', 'last_loan_time'))})"""),
        "q_csv_roundtrip": query(TRAIN, f"""
            select uid, {whole('epoch(loan_time)', 'at')}, {num('loan_amount', 'loan_amount')},
                   {whole('plannum', 'plannum')} from v_loan"""),
        "q_predictions_file": query(TRAIN, f"select uid, {num('pred', 'pred')} from rule", **ctes),
        "q_holdout_file": query(TRAIN, f"""
            select uid, {num('label', 'label')} from (
              select uid, label, row_number() over (order by {hash_text()}, uid) r, count(*) over () n from judged)
            where r <= floor(0.2*n)""", **ctes),
        "q_materialized": rounded(TRAIN, g.loan(TRAIN)),
    }


def statements() -> dict[str, str]:
    return {
        **scalar_queries(), **loan_queries(), **other_group_queries(),
        **matrix_queries(), **cohort_queries(), **evaluation_queries(),
    }
