"""Every operator and feature group as a named query over a data folder."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.functions import clock, coding, money
from creditloom.models import boosting, segments
from creditloom.operators import cohorts, metrics, profile, recency, sampling, windows
from creditloom.operators.fused import KEY, Measures, outer_merge, summarise
from creditloom.plans import click, cross, loan, matrix, order, original_click, original_loan, original_matrix
from creditloom.plans import original_order, panes, user
from creditloom.plans.events import click_events, loan_events, order_events, priced
from creditloom.session import fresh_path
from creditloom.sources import sinks
from creditloom.sources.artefacts import Artefacts
from creditloom.sources.retimed import open_tables, scan
from creditloom.sources.tables import LOAN, Tables, read_table
from creditloom.spec import SCORE, TRAIN, FeatureSpec

Query = Callable[[SparkSession, str], DataFrame]
SEED = 2017
AMOUNT_BAND = (499.0, 90000.0)  # fixed values: the optional band on loan amounts


def presented(df: DataFrame) -> DataFrame:
    """Results in comparable form: doubles at four decimals and single precision, whole numbers as bigint.

    Sums of doubles differ in their last digits by the order they are added in; single precision leaves those out.
    """
    cols = []
    for name, kind in df.dtypes:
        x = f"`{name}`"
        if kind == "double":
            x = f"cast(cast(round({x}, 4) as float) as double)"
        elif kind in ("int", "smallint", "tinyint", "boolean"):
            x = f"cast({x} as bigint)"
        cols.append(f"{x} as `{name}`")
    return df.selectExpr(*cols)


def _on_tables(make: Callable[[Tables], DataFrame]) -> Query:
    return lambda spark, sf_dir: presented(make(open_tables(spark, sf_dir)))


def _at(time: str = "loan_time") -> Column:
    return F.unix_timestamp(time).alias("at")


# ---- projections and filters -----------------------------------------------------------------


def decoded(f: Callable[[Column], Column]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        events = scan(spark, sf_dir, "events")
        return presented(events.select("event_id", f(F.col("value") / 150).alias("money")))

    return run


def encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = scan(spark, sf_dir, "orders")
    return presented(orders.select("o_orderkey", money.encode("o_totalprice").alias("stored")))


def event_age(t: Tables) -> DataFrame:
    days = clock.age_days("loan_time", TRAIN.anchor)
    return t.loan.select(
        KEY,
        _at(),
        clock.month_of("loan_time").alias("month"),
        clock.hour_of("loan_time").alias("hour"),
        days.alias("days"),
        clock.weeks_of(days).alias("weeks"),
        clock.fractional_weeks(days).alias("fractional_weeks"),
    )


def hour_buckets(t: Tables) -> DataFrame:
    def one(df: DataFrame, action: str, time: str) -> DataFrame:
        return df.select(F.lit(action).alias("action"), KEY, _at(time), clock.hour_bucket(time).alias("bucket"))

    return one(t.loan, "loan", "loan_time").unionByName(one(t.click, "click", "click_time"))


def recency_weights(t: Tables) -> DataFrame:
    def one(df: DataFrame, kind: str, time: str, hyperbolic: Column) -> DataFrame:
        return df.select(
            F.lit(kind).alias("kind"),
            KEY,
            F.date_format(time, "yyyy-MM-dd").alias("day"),
            "days",
            clock.weekly_weight("weeks").alias("weekly"),
            hyperbolic.alias("hyperbolic"),
        )

    s = TRAIN
    by_loan = clock.hyperbolic_weight("days", s.loan_scale_days, 1.0, s.epsilon)
    by_order = clock.hyperbolic_weight("days", 1.0, s.order_numerator, s.epsilon)
    by_click = clock.hyperbolic_weight("days", 1.0, 1.0, s.epsilon)
    return (
        one(loan_events(t, s), "loan", "loan_time", by_loan)
        .unionByName(one(order_events(t, s), "order", "buy_time", by_order))
        .unionByName(one(click_events(t, s), "click", "click_time", by_click))
    )


def net_prices(t: Tables) -> DataFrame:
    """Both readings of missing inputs side by side, in one pass."""
    filled = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("price", "discount")}
    return t.order.select(
        KEY,
        F.date_format("buy_time", "yyyy-MM-dd").alias("day"),
        money.net_price(
            money.decode_rounded(filled["price"]),
            F.coalesce(F.col("qty"), F.lit(0)),
            money.decode_rounded(filled["discount"]),
        ).alias("paid"),
        money.net_price(money.decode_exact("price"), F.col("qty"), money.decode_exact("discount")).alias("paid_exact"),
    )


def discount_rates(t: Tables) -> DataFrame:
    measures = order.totals()
    return summarise(order_events(t, TRAIN), _only(measures, "dis_ratio"))


def installments(t: Tables) -> DataFrame:
    return loan_events(t, TRAIN).select(KEY, _at(), "plannum", "due")


def sex_indicators(t: Tables) -> DataFrame:
    return user.user_features(t, TRAIN).select(KEY, "sex_1", "sex_2")


def banded_loans(t: Tables) -> DataFrame:
    """Loans of the last observed month within the optional amount band."""
    banded = loan_events(t, TRAIN.with_(amount_band=AMOUNT_BAND))
    return banded.where(F.col("slot") == TRAIN.n_months).select(KEY, _at(), "amount")


def active_borrowers(t: Tables) -> DataFrame:
    users = t.user.select(KEY, "age")
    borrowers = t.during("loan", TRAIN.start, TRAIN.anchor)
    inside = cohorts.among(users, borrowers).withColumn("borrower", F.lit(1))
    outside = cohorts.not_among(users, borrowers).withColumn("borrower", F.lit(0))
    return inside.unionByName(outside)


def stacked_months(t: Tables) -> DataFrame:
    """The observation months handled one by one and put back together."""
    loans = loan_events(t, TRAIN)
    parts = [
        loans.where(F.col("slot") == k).select(KEY, _at(), clock.month_of("loan_time").alias("month"), "due")
        for k in TRAIN.slots
    ]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    return stacked


# ---- parts of the feature groups -------------------------------------------------------------


def _only(measures: Measures, *names: str) -> Measures:
    return Measures(measures.aggs, {n: measures.outs[n] for n in names} if names else measures.outs)


def _loan_part(measures: Callable[[FeatureSpec], Measures]) -> Callable[[Tables], DataFrame]:
    return lambda t: summarise(loan_events(t, TRAIN), measures(TRAIN))


def _click_part(measures: Callable[[FeatureSpec], Measures]) -> Callable[[Tables], DataFrame]:
    return lambda t: summarise(click_events(t, TRAIN), measures(TRAIN))


def zero_filled_month_stats(t: Tables) -> DataFrame:
    s = TRAIN
    return outer_merge(
        {
            "loan": summarise(loan_events(t, s, rounded=False), original_loan.month_spread(s)),
            "buy": summarise(order_events(t, s, filled=False), original_order.month_spread(s)),
            "click": summarise(click_events(t, s), original_click.month_spread(s)),
        }
    )


def edge_loan(pick) -> Callable[[Tables], DataFrame]:
    def run(t: Tables) -> DataFrame:
        rows = pick(loan_events(t, TRAIN), ["loan_time", "amount", "plannum"])
        return rows.select(KEY, _at(), "amount", "plannum")

    return run


def _finished(t: Tables, *names: str) -> DataFrame:
    return loan.loan_features(t, TRAIN).select(KEY, *names)


def loan_ratios(s: FeatureSpec) -> Measures:
    both = loan.totals() + loan.active_months(s) | loan.ratios(s)
    return _only(both, "loan_weights", "per_plannum_loan", "per_times_loan")


def loan_periods(s: FeatureSpec) -> Measures:
    return windows.cumulative_periods("amount", "loan", s)


def new_borrowers(t: Tables) -> DataFrame:
    """Borrowers whose first loan falls in the second or a later month."""
    first = cohorts.first_month(t, TRAIN)
    return first.where(F.col("first_month") > 1)


# ---- samples, profiles, files ----------------------------------------------------------------


def borrowed_labels(t: Tables) -> DataFrame:
    users = t.user.select(KEY)
    joined = users.join(t.loan_sum, KEY, "left")
    return joined.select(KEY, F.coalesce(coding.binarised(F.col("loan_sum")), F.lit(0.0)).alias("label"))


def downsampled(t: Tables) -> DataFrame:
    """All borrowers and a fixed number of the others."""
    flagged = sampling.sample_flags(borrowed_labels(t), SEED, size=50, stratum="label")
    return flagged.where((F.col("label") == 1) | F.col("sampled")).select(KEY, "label")


def rule_prediction(t: Tables) -> DataFrame:
    """Forecast by a fixed rule: the encoded total of the last observed month."""
    last = t.during("loan", TRAIN.last_month_start, TRAIN.anchor)
    totals = last.groupBy(KEY).agg(money.encode(F.sum(money.decode_rounded("loan_amount"))).alias("pred"))
    return t.user.select(KEY).join(totals, KEY, "left").fillna(0.0, ["pred"])


def judged(t: Tables) -> DataFrame:
    labels = t.loan_sum.select(KEY, F.col("loan_sum").alias("label"))
    return rule_prediction(t).join(labels, KEY, "left").fillna(0.0, ["label"])


def judged_classes(t: Tables) -> DataFrame:
    return judged(t).select(
        KEY, coding.binarised(F.col("label")).alias("label"), coding.decided(F.col("pred")).alias("pred")
    )


def adjusted_predictions(t: Tables) -> DataFrame:
    limits = t.user.select(KEY, (F.col("limit") * 0.8).alias("cap"))
    shifted = F.col("pred") - 4
    return rule_prediction(t).join(limits, KEY, "left").select(
        KEY,
        shifted.alias("pred"),
        coding.clamped(shifted).alias("clamped"),
        coding.folded(shifted).alias("folded"),
        coding.decided(shifted).alias("decided"),
        money.at_most("pred", "cap").alias("capped"),
    )


def averaged_predictions(t: Tables) -> DataFrame:
    one = rule_prediction(t)
    other = one.select(KEY, coding.clamped(F.col("pred") - 1).alias("pred"))
    return metrics.mean_prediction(one.unionByName(other))


def standardised_columns(t: Tables) -> DataFrame:
    cols = ["loan_amount", "loan_weights", "repay", "last_loan_time"]
    s = TRAIN
    parts = [loan.totals(), recency.gap_measures("loan", s, per_event=True)]
    return segments.standardised(summarise(loan_events(t, s), *parts).select(KEY, *cols), cols)


def csv_roundtrip(t: Tables) -> DataFrame:
    spark = t.loan.sparkSession
    path = fresh_path(spark, "loan-csv")
    sinks.write_table(t.loan, path)
    return read_table(spark, path, LOAN).select(KEY, _at(), "loan_amount", "plannum")


def predictions_file(t: Tables) -> DataFrame:
    spark = t.loan.sparkSession
    path = fresh_path(spark, "predictions")
    sinks.write_predictions(rule_prediction(t), path)
    return sinks.read_predictions(spark, path)


def holdout_file(t: Tables) -> DataFrame:
    spark = t.loan.sparkSession
    path = fresh_path(spark, "holdout")
    flagged = sampling.sample_flags(judged(t), SEED, fraction=0.2)
    sinks.write_holdout(flagged.where("sampled"), path)
    return sinks.read_holdout(spark, path)


def materialized(t: Tables) -> DataFrame:
    spark = t.loan.sparkSession
    path = fresh_path(spark, "loan-features")
    sinks.materialize(spark, lambda: loan.loan_features(t, TRAIN), path)
    return sinks.materialize(spark, lambda: loan.loan_features(t, TRAIN), path)


def described_matrix(t: Tables) -> DataFrame:
    made = matrix.training_matrix(t, TRAIN)
    return profile.describe_frame(made, profile.numeric_columns(made, but=(KEY,)))


def split_matrix(t: Tables) -> DataFrame:
    stored = _stored(original_matrix.original_training_matrix(t, TRAIN), "original-training")
    return original_matrix.split_matrix(stored, cohorts.cohort_labels(t, TRAIN), SEED)


def _edge_store(t: Tables, spec: FeatureSpec) -> Artefacts:
    store = Artefacts(t.loan.sparkSession, fresh_path(t.loan.sparkSession, "edges"))
    cross.store_edges(store, t, spec)
    return store


def union_scored_by_stored_edges(t: Tables) -> DataFrame:
    """Code sums of the next anchor by the edges that were stored in training."""
    return cross.union_features(t, SCORE, cross.stored_edges(_edge_store(t, TRAIN), SCORE))


def union_edge_drift(t: Tables) -> DataFrame:
    """Levels of the scoring window against edges fitted on the training window alone."""
    own = {"fit_from": None, "fit_to": None}
    then, now = TRAIN.with_(**own), SCORE.with_(**own)
    return cross.edge_drift(t, now, cross.stored_edges(_edge_store(t, then), now))


def two_anchors(t: Tables) -> DataFrame:
    """The training and the scoring matrix from one scan of each event table."""
    labels = matrix.labels(t).withColumn("anchor", F.lit(TRAIN.anchor))
    return panes.anchored_matrix(panes.open_panes(t, TRAIN), [TRAIN, SCORE], labels)


# ---- models ----------------------------------------------------------------------------------

FULL = boosting.Boosting()
# Few rounds keep some registered queries quick; the settings' own defaults are the full ones.
QUICK = boosting.Boosting(rounds=6, step=0.3, min_leaf=20)
TINY = boosting.Boosting(rounds=3, step=0.3, min_leaf=20, depth=3)


def _stored(df: DataFrame, name: str) -> DataFrame:
    """Training reads its matrix many times; store it once in the shared folder."""
    spark = df.sparkSession
    return sinks.materialize(spark, lambda: df, fresh_path(spark, name))


def _side_by_side(spark: SparkSession, make: Callable, of: Iterable) -> list:
    """What is made of each; their jobs need nothing of each other and run side by side."""
    of = list(of)
    with ThreadPool(len(of)) as pool:
        return pool.map(inheritable_thread_target(spark)(make), of)


def _train(t: Tables) -> DataFrame:
    return _stored(matrix.training_matrix(t, TRAIN), "training")


def user_clusters(t: Tables) -> DataFrame:
    """Segments fitted on training loans, applied to the loans of the next anchor."""
    spark = t.loan.sparkSession
    path = fresh_path(spark, "segments")
    train = _stored(original_loan.original_loan_features(t, TRAIN), "segment-input")
    fitted = segments.segmented(train, path, fit=True, name="loan_cluster_label", k=12, max_iter=20, restarts=2)
    scoring = original_loan.original_loan_features(t, SCORE)
    applied = segments.segmented(scoring, path, fit=False, name="loan_cluster_label")
    pick = (KEY, "loan_cluster_label")
    return fitted.select(F.lit("train").alias("part"), *pick).unionByName(
        applied.select(F.lit("score").alias("part"), *pick)
    )


CLUSTERED = {
    "loan_cluster_label": original_loan.original_loan_features,
    "order_cluster_label": original_order.original_order_features,
    "click_cluster_label": original_click.original_click_features,
}


def clustered(name: str, **params) -> Callable[[Tables], DataFrame]:
    """A feature group of the next anchor with the segments fitted on its training users."""

    def run(t: Tables) -> DataFrame:
        path, make = fresh_path(t.loan.sparkSession, name), CLUSTERED[name]
        train = _stored(make(t, TRAIN), f"{name}-train")
        segments.segmented(train, path, fit=True, name=name, **params)
        return segments.segmented(_stored(make(t, SCORE), f"{name}-score"), path, fit=False, name=name)

    return run


def _with_segments(t: Tables, spec: FeatureSpec, place: Callable[..., DataFrame], whole: DataFrame) -> DataFrame:
    """A matrix with the segments of its three groups and, last, of its whole rows.

    The groups' segments need nothing of each other, so their jobs run side by side.
    """

    def group(name: str) -> DataFrame:
        return place(_stored(CLUSTERED[name](t, spec), name), spec, name)

    groups = dict(zip(CLUSTERED, _side_by_side(t.loan.sparkSession, group, CLUSTERED)))
    joined = _stored(segments.with_clusters(whole, groups), "clustered-matrix")
    return place(joined, spec, "cluster_label")


def clustered_training_matrix(t: Tables, store: Artefacts | None = None, **params) -> DataFrame:
    """The original training matrix with its four segment columns, whose scalers and segments are stored."""
    store = store or Artefacts(t.loan.sparkSession, fresh_path(t.loan.sparkSession, "artefacts"))

    def fit(df: DataFrame, spec: FeatureSpec, name: str) -> DataFrame:
        return segments.store_segments(store, df, spec, name, **params)

    return _with_segments(t, TRAIN, fit, original_matrix.original_training_matrix(t, TRAIN))


def clustered_scoring_matrix(t: Tables, store: Artefacts | None = None, **params) -> DataFrame:
    """The original scoring matrix with the segments that were stored in training; without a store, they are fitted first."""
    if store is None:
        store = Artefacts(t.loan.sparkSession, fresh_path(t.loan.sparkSession, "artefacts"))
        clustered_training_matrix(t, store, **params)

    def apply(df: DataFrame, spec: FeatureSpec, name: str) -> DataFrame:
        return segments.stored_segments(store, df, spec, name)

    return _with_segments(t, SCORE, apply, original_matrix.original_scoring_matrix(t, SCORE))


def cv_rmse(t: Tables) -> DataFrame:
    return boosting.fold_rmse(boosting.fit_folds(_train(t), QUICK, folds=5))


def cv_predictions(t: Tables) -> DataFrame:
    folded = boosting.fit_folds(_train(t), FULL, folds=5)
    return boosting.predict_folds(folded, matrix.scoring_matrix(t, SCORE))


def feature_importance(t: Tables) -> DataFrame:
    train = _train(t)
    features = segments.feature_columns(train)
    model = boosting.fit_regressor(_filled(train), features, QUICK)
    return boosting.importance(model, features, train)


def _filled(df: DataFrame) -> DataFrame:
    return df.fillna(0.0, [c for c in df.columns if c != KEY])


def grid_scores(t: Tables) -> DataFrame:
    _, scores = boosting.grid_search(_train(t), TINY, {"stepSize": [0.1, 0.2], "maxDepth": [2, 3]}, folds=3)
    return scores


def borrow_classes(t: Tables) -> DataFrame:
    train = _train(t)
    return boosting.borrow_probability(boosting.fit_borrow_classifier(train, QUICK), train)


def _held_out(df: DataFrame, stratum: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Training and held-out rows of a stored matrix: a fifth of the users, of each stratum if one is given."""
    keys = df.select(*dict.fromkeys((KEY, *([stratum] if stratum else []))))
    flags = sampling.sample_flags(keys, SEED, fraction=0.2, stratum=stratum, flag="held_out").select(KEY, "held_out")
    flagged = df.join(_stored(flags, "held-out"), KEY)
    return flagged.where(~F.col("held_out")).drop("held_out"), flagged.where("held_out").drop("held_out")


def borrow_report(t: Tables) -> DataFrame:
    """How well the borrow classifier does on users it has not seen."""
    train, held = _held_out(_train(t))
    model = boosting.fit_borrow_classifier(train, QUICK)
    return metrics.binary_metrics(boosting.borrow_probability(model, held))


def cohort_report(t: Tables) -> DataFrame:
    """True and predicted cohorts of users that the classifier has not seen, all sixteen pairs."""
    matrix_ = _stored(original_matrix.cohort_training_matrix(t, TRAIN).fillna(0.0, ["label2"]), "cohort-matrix")
    train, held = _held_out(matrix_, "label2")
    model = boosting.fit_cohort_classifier(train, TINY)
    judged = model.transform(_filled(held)).select(F.col("label2").alias("label"), "pred")
    return metrics.class_confusion(judged, 4)


def two_model_report(t: Tables) -> DataFrame:
    """Error of the two models on held-out users of their own population, a fifth of each cohort."""
    split = _stored(cohorts.population_split(t, TRAIN, SCORE), "populations")
    groups = _stored(cohorts.cohorts(t, TRAIN), "cohorts")

    def part(number: int, make: Callable[..., DataFrame]) -> DataFrame:
        own = cohorts.among(make(t, TRAIN), split.where(F.col("train_model") == number))
        own = _stored(own.join(groups, KEY, "left").fillna(0, ["cohort"]), f"model{number}")
        train, held = _held_out(own, "cohort")
        train, held = (_filled(df.drop("cohort")) for df in (train, held))
        model = boosting.fit_regressor(train, segments.feature_columns(train), FULL)
        found = metrics.rmse(model.transform(held).select("label", "pred"))
        return found.select(F.lit(number).cast("bigint").alias("model"), "*")

    made = ((1, original_matrix.borrower_matrix), (2, original_matrix.non_borrower_matrix))
    one, other = _side_by_side(split.sparkSession, lambda of: part(*of), made)
    return one.unionByName(other)


def stored_model_predictions(t: Tables) -> DataFrame:
    """A regressor that stops with patience, stored, loaded again and applied to the users to score."""
    spark = t.loan.sparkSession
    train = _filled(_train(t)).withColumn("_held", sampling.fold_id(SEED) == 0)
    features = segments.feature_columns(train, but=(KEY, "label", "_held"))
    model, _ = boosting.fit_with_patience(train, features, QUICK, "_held")
    path = fresh_path(spark, "regressor")
    sinks.save_model(model, path)
    return boosting.mean_of_models([sinks.load_model(path)], matrix.scoring_matrix(t, SCORE))


def cohort_classes(t: Tables) -> DataFrame:
    train = _stored(original_matrix.cohort_training_matrix(t, TRAIN), "cohort-matrix")
    model = boosting.fit_cohort_classifier(train, TINY)
    scoring = original_matrix.cohort_scoring_matrix(t, SCORE)
    return model.transform(scoring).select(KEY, F.col("pred").alias("cohort"))


def two_models(t: Tables) -> DataFrame:
    """Model 1 for users with loans in the window, model 2 for the others."""
    spark = t.loan.sparkSession
    split = _stored(cohorts.population_split(t, TRAIN, SCORE), "populations")

    def population(df: DataFrame, flag: str, model: int) -> DataFrame:
        return cohorts.among(df, split.where(F.col(flag) == model))

    def pair(make, spec, flag: str, model: int) -> DataFrame:
        return population(make(t, spec, label=flag == "train_model"), flag, model)

    train1 = _stored(pair(original_matrix.borrower_matrix, TRAIN, "train_model", 1), "model1")
    train2 = _stored(pair(original_matrix.non_borrower_matrix, TRAIN, "train_model", 2), "model2")
    score1 = pair(original_matrix.borrower_matrix, SCORE, "submit_model", 1)
    score2 = pair(original_matrix.non_borrower_matrix, SCORE, "submit_model", 2)
    return boosting.two_model_predictions(train1, train2, score1, score2, TINY)


def blended(t: Tables) -> DataFrame:
    train = _filled(_train(t))
    features = segments.feature_columns(train)
    settings = [FULL, boosting.Boosting(columns=0.75)]
    rows = boosting.assembled(train, features, "label")
    models = _side_by_side(rows.sparkSession, lambda s: boosting.fit_assembled(rows, features, s), settings)
    return boosting.blend(models, matrix.scoring_matrix(t, SCORE))


# ---- registry --------------------------------------------------------------------------------


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {
        "q_decode_rounded": decoded(money.decode_rounded),
        "q_decode_exact": decoded(money.decode_exact),
        "q_encode_log5": encoded,
    }
    on_tables: dict[str, Callable[[Tables], DataFrame]] = {
        "q_event_age": event_age,
        "q_hour_bucket": hour_buckets,
        "q_recency_weights": recency_weights,
        "q_net_price": net_prices,
        "q_discount_rate": discount_rates,
        "q_installment_due": installments,
        "q_onehot_sex": sex_indicators,
        "q_filter_amount_band": banded_loans,
        "q_active_borrowers": active_borrowers,
        "q_union_all_months": stacked_months,
        "q_loan_month_stats": _loan_part(loan.month_stats),
        "q_click_month_stats": _click_part(click.month_stats),
        "q_order_month_stats": lambda t: summarise(order_events(t, TRAIN), order.month_stats(TRAIN)).fillna(0.0),
        "q_month_stats_zero_filled": zero_filled_month_stats,
        "q_loan_hour_share": _loan_part(lambda s: loan.hour_shares("loan", "amount")),
        "q_click_hour_share": _click_part(lambda s: loan.hour_shares("click", "click_time")),
        "q_plannum_share": _loan_part(loan.plannum_shares),
        "q_loan_recency_gap": _loan_part(lambda s: recency.gap_measures("loan", s, per_event=True)),
        "q_click_recency_gap": _click_part(lambda s: recency.gap_measures("click", s, per_event=False)),
        "q_order_recency_gap": lambda t: summarise(
            order_events(t, TRAIN), recency.gap_measures("order", TRAIN, per_event=False)
        ).fillna(0.0),
        "q_last_loan": edge_loan(recency.last_row),
        "q_first_loan": edge_loan(recency.first_row),
        "q_activation_gap": lambda t: _finished(t, "active_loan_interval"),
        "q_limit_update": lambda t: _finished(t, "new_limit"),
        "q_exceed_by_month": lambda t: _finished(t, *[f"exceed_loan_{k}" for k in TRAIN.slots]),
        "q_month_flags": _loan_part(loan.active_months),
        "q_month_flags_counts": _loan_part(original_loan.loan_counts),
        "q_loan_ratio_of_sums": _loan_part(loan_ratios),
        "q_loan_windows": lambda t: loan.loan_window_features(t, TRAIN),
        "q_loan_windows_scoring": lambda t: loan.loan_window_features(t, SCORE),
        "q_loan_periods": _loan_part(loan_periods),
        "q_order_periods": lambda t: original_order.original_order_periods(t, TRAIN),
        "q_click_periods": lambda t: original_click.original_click_periods(t, TRAIN),
        "q_loan_weeks": _loan_part(lambda s: original_loan.period_measures(s)[1]),
        "q_click_onehot_share": _click_part(click.value_shares),
        "q_click_onehot_decayed": lambda t: summarise(
            original_click.weighted_clicks(t, TRAIN), original_click.decayed_values(TRAIN)
        ),
        "q_union_codes": lambda t: cross.union_codes(t, TRAIN),
        "q_union_features": lambda t: cross.union_features(t, TRAIN),
        "q_union_features_scoring": union_scored_by_stored_edges,
        "q_union_edge_drift": union_edge_drift,
        "q_interactive_month": lambda t: cross.interactive_month_features(t, TRAIN),
        "q_interactive_week": lambda t: cross.interactive_features(t, TRAIN),
        "q_user_features": lambda t: user.user_features(t, TRAIN),
        "q_loan_features": lambda t: loan.loan_features(t, TRAIN),
        "q_loan_features_scoring": lambda t: loan.loan_features(t, SCORE),
        "q_click_features": lambda t: click.click_features(t, TRAIN),
        "q_order_features": lambda t: order.order_features(t, TRAIN),
        "q_labels": matrix.labels,
        "q_training_matrix": lambda t: matrix.training_matrix(t, TRAIN),
        "q_scoring_matrix": lambda t: matrix.scoring_matrix(t, SCORE),
        "q_matrices_two_anchors": two_anchors,
        "q_v1_user": lambda t: user.original_user_features(t, TRAIN),
        "q_v1_loan": lambda t: original_loan.original_loan_features(t, TRAIN),
        "q_v1_loan_scoring": lambda t: original_loan.original_loan_features(t, SCORE),
        "q_v1_loan_filter": lambda t: original_loan.original_loan_periods(t, TRAIN),
        "q_v1_order": lambda t: original_order.original_order_features(t, TRAIN),
        "q_v1_order_scoring": lambda t: original_order.original_order_features(t, SCORE),
        "q_v1_click": lambda t: original_click.original_click_features(t, TRAIN),
        "q_v1_training_matrix": lambda t: original_matrix.original_training_matrix(t, TRAIN),
        "q_v1_scoring_matrix": lambda t: original_matrix.original_scoring_matrix(t, SCORE),
        "q_model1_matrix": lambda t: original_matrix.borrower_matrix(t, TRAIN),
        "q_model2_matrix": lambda t: original_matrix.non_borrower_matrix(t, TRAIN),
        "q_model1_scoring_matrix": lambda t: original_matrix.borrower_matrix(t, SCORE, label=False),
        "q_model2_scoring_matrix": lambda t: original_matrix.non_borrower_matrix(t, SCORE, label=False),
        "q_cohort_matrix": lambda t: original_matrix.cohort_training_matrix(t, TRAIN),
        "q_cohort_scoring_matrix": lambda t: original_matrix.cohort_scoring_matrix(t, SCORE),
        "q_split_matrix": split_matrix,
        "q_cohorts": lambda t: cohorts.cohorts(t, TRAIN),
        "q_cohort_labels": lambda t: cohorts.cohort_labels(t, TRAIN),
        "q_new_borrowers_by_month": new_borrowers,
        "q_population_split": lambda t: cohorts.population_split(t, TRAIN, SCORE),
        "q_cohort_sample": lambda t: sampling.sample_flags(
            cohorts.cohorts(t, TRAIN), SEED, fraction=0.2, stratum="cohort"
        ),
        "q_shuffled": lambda t: sampling.shuffled(t.user.select(KEY, "age"), SEED),
        "q_fold_assignment": lambda t: t.user.select(KEY, sampling.fold_id(SEED).alias("fold")),
        "q_holdout_split": lambda t: sampling.sample_flags(
            t.user.select(KEY), SEED, fraction=0.2, flag="held_out"
        ),
        "q_downsample_negatives": downsampled,
        "q_profile": lambda t: profile.describe(t.loan_sum, "loan_sum"),
        "q_describe_matrix": described_matrix,
        "q_value_counts": lambda t: profile.value_counts(cohorts.cohorts(t, TRAIN), "cohort"),
        "q_shape": lambda t: profile.shape(matrix.training_matrix(t, TRAIN)),
        "q_top_rows": lambda t: profile.top_rows(matrix.training_matrix(t, TRAIN), KEY, 10),
        "q_rmse": lambda t: metrics.rmse(judged(t)),
        "q_binary_metrics": lambda t: metrics.binary_metrics(judged_classes(t)),
        "q_confusion": lambda t: metrics.confusion(judged_classes(t)),
        "q_cap_prediction": adjusted_predictions,
        "q_mean_prediction": averaged_predictions,
        "q_standardised": standardised_columns,
        "q_csv_roundtrip": csv_roundtrip,
        "q_predictions_file": predictions_file,
        "q_holdout_file": holdout_file,
        "q_materialized": materialized,
        "q_user_clusters": user_clusters,
        "q_v1_loan_clustered": clustered("loan_cluster_label"),
        "q_v1_order_clustered": clustered("order_cluster_label"),
        "q_v1_click_clustered": clustered("click_cluster_label"),
        "q_v1_training_clustered": clustered_training_matrix,
        "q_v1_scoring_clustered": clustered_scoring_matrix,
        "q_gbt_cv_rmse": cv_rmse,
        "q_gbt_predictions": cv_predictions,
        "q_feature_importance": feature_importance,
        "q_grid_search": grid_scores,
        "q_borrow_classifier": borrow_classes,
        "q_cohort_classifier": cohort_classes,
        "q_two_model_predictions": two_models,
        "q_borrow_holdout_metrics": borrow_report,
        "q_cohort_holdout_confusion": cohort_report,
        "q_two_model_holdout_rmse": two_model_report,
        "q_stored_model_predictions": stored_model_predictions,
        "q_blend": blended,
    }
    found.update({name: _on_tables(make) for name, make in on_tables.items()})
    return found
