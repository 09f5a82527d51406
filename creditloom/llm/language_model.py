"""Quality by perplexity under an interpolated modified Kneser-Ney n-gram model of trusted text.

The model is that of ``ngram_model``: n-grams of characters as they are, counted over all trusted text and looked up by
sharded keys.

A document's score is its mean surprise a character, drawn towards its language's mean by ``prior`` characters, so
that short documents are not judged by a few letters; its perplexity is also given. The limit of a language is a
quantile of its trusted documents' scores, moved out by ``reach`` times its distance from the median; languages with
fewer than ``least`` trusted documents use the limit of all languages. Quantiles are exact to a thousandth of a
nat and the same on every run, because they are read off counts.

Null texts count as empty: no characters, perplexity 1, never rejected. A null language is a language of its own.
Without trusted text nothing is rejected. Repeated rows are judged alike, and repeated trusted ids count once. Very long texts are
scored whole; an empty table gives no rows. Other columns may have any name. Ids are numbers, as the labels' are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.llm import ngram_model
from creditloom.llm.common import ROW, numbered, quoted, stored
from creditloom.llm.exact_dedup import keep_rows

#: Scores are counted in steps of this many nats.
STEP = 0.001


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of documents labelled good and not toxic."""
    return labels.where("quality = 1 and toxic = 0 and doc_id is not null").select("doc_id")


def _quantiles(counts: dict[int, int], shares: tuple[float, ...]) -> list[float]:
    steps = sorted(counts)
    reached = np.cumsum([counts[s] for s in steps])
    return [steps[int(np.searchsorted(reached, share * reached[-1]))] * STEP for share in shares]


@dataclass(frozen=True)
class Cut:
    """Where a language's limit lies."""

    quantile: float = 0.99
    reach: float = 4.0
    prior: int = 200
    least: int = 100


@dataclass
class Limits:
    """Mean surprise and limit by language; ``None`` as a second key is all languages together."""

    means: dict
    limits: dict
    overall: tuple[float, float]
    prior: int

    def _pick(self, lang: Column, values: dict, otherwise: float) -> Column:
        found = None
        for key, value in values.items():
            same = lang.eqNullSafe(F.lit(key))
            found = F.when(same, value) if found is None else found.when(same, value)
        return F.lit(otherwise) if found is None else found.otherwise(F.lit(otherwise))

    def score(self, scored: Column, lang: Column) -> Column:
        mean = self._pick(lang, self.means, self.overall[0])
        return (scored["nats"] + self.prior * mean) / (scored["n"] + self.prior)

    def limit(self, lang: Column) -> Column:
        return self._pick(lang, self.limits, self.overall[1])


def language_limits(scored: DataFrame, cut: Cut) -> Limits | None:
    """From trusted documents' lang, n and nats. One row per language and step reaches the driver."""
    sums = scored.where("n > 0").groupBy("lang").agg(
        F.count("*").alias("docs"), F.sum("n").alias("n"), F.sum("nats").alias("nats")
    )
    by_lang = {r.lang: r for r in sums.where(F.col("docs") >= cut.least).collect()}
    total = sums.agg(F.sum("n").alias("n"), F.sum("nats").alias("nats")).first()
    if not total.n:
        return None
    limits = Limits({k: r.nats / r.n for k, r in by_lang.items()}, {}, (total.nats / total.n, 0.0), cut.prior)
    step = F.round(limits.score(F.struct("nats", "n"), F.col("lang")) / STEP).cast("int").alias("step")
    known = F.when(F.col("lang").isin([k for k in by_lang if k is not None]), F.col("lang"))
    steps: dict = {}
    for r in scored.where("n > 0").groupBy(known.alias("lang"), step).count().collect():
        for key in {r.lang, "*"} if r.lang in by_lang else {"*"}:
            steps.setdefault(key, {})
            steps[key][r.step] = steps[key].get(r.step, 0) + r["count"]

    def limit(key) -> float:
        middle, high = _quantiles(steps[key], (0.5, cut.quantile))
        return middle + cut.reach * (high - middle)

    limits.limits = {k: limit(k) for k in by_lang}
    limits.overall = (limits.overall[0], limit("*"))
    return limits


def perplexities(
    docs: DataFrame,
    labels: DataFrame,
    cut: Cut = Cut(),
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """doc_id, lang, n_chars_scored, perplexity, score, limit, kept for every document."""
    scored, limits = _scored(docs, labels, cut, id_col, text_col, lang_col)
    lang = F.col("lang")
    score, limit = (limits.score(F.struct("nats", "n"), lang), limits.limit(lang)) if limits else (F.lit(0.0), F.lit(0.0))
    return scored.select(
        "doc_id",
        "lang",
        F.col("n").alias("n_chars_scored"),
        F.when(F.col("n") > 0, F.exp(F.col("nats") / F.col("n"))).otherwise(1.0).alias("perplexity"),
        score.alias("score"),
        limit.alias("limit"),
        ((F.col("n") == 0) | (score <= limit)).alias("kept"),
    )


def _scored(
    docs: DataFrame, labels: DataFrame, cut: Cut, id_col: str, text_col: str, lang_col: str
) -> tuple[DataFrame, Limits | None]:
    """row, doc_id, lang, n, nats of every document, stored; and the limits."""
    trusted = trusted_ids(labels)
    # The rows are numbered in the one reading that bundles them, unless they bring a written number.
    row = (F.col(ROW) if ROW in docs.columns else F.monotonically_increasing_id()).alias("row")
    doc_id, lang = quoted(id_col).alias("doc_id"), quoted(lang_col).cast("string").alias("lang")
    base = docs.select(row, doc_id, lang, quoted(text_col).cast("string").alias("text"))
    headed = base.select("row", F.col("doc_id").cast("long").alias("id"), F.struct("row", "doc_id", "lang").alias("head"), "text")
    found = ngram_model.scored(headed, trusted)
    if found is None:
        length = F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n")
        return base.select("row", "doc_id", "lang", length, F.lit(0.0).alias("nats")), None
    scored = found.select("head.*", "n", "nats")
    return scored, language_limits(scored.join(trusted, "doc_id", "left_semi"), cut)


def drop_poor(
    docs: DataFrame,
    labels: DataFrame,
    cut: Cut = Cut(),
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """The documents at or below their language's limit, with all their columns."""
    rows = numbered(docs)
    scored, limits = _scored(rows, labels, cut, id_col, text_col, lang_col)
    if limits is None:
        return rows.drop(ROW)
    low = (F.col("n") == 0) | (limits.score(F.struct("nats", "n"), F.col("lang")) <= limits.limit(F.col("lang")))
    return keep_rows(rows, scored.where(low).select(F.col("row").alias("keep_row")))
