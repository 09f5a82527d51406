"""Mixing sources to target weights by soft membership, in DataFrame functions only.

A naive Bayes classifier, fitted on the labelled table, gives every document a posterior over the domains ``good``, ``poor``
and ``toxic``. Documents then get nonnegative rates such that the expected tokens of each domain, the sum of rate x tokens x
posterior, meet their targets: least squares over the relative misses, by projected gradient steps from rates of one.
A step needs three sums over all documents and changes a rate by a combination of its document's posteriors, so a
rate is a function of the posteriors and of the steps so far; no rates travel.

The anchor domain's target is what it has, and the others follow from the weights, so the anchor keeps its rate of about one;
a domain scarcer than its weight gets rates above one, up to a ceiling of copies, and its documents are repeated. A domain that does
not reach its target even so has none, and a target that is null in the result.
Sums are over documents grouped by equal posteriors, so copies and a hot source combine before the shuffle.

The classifier's features are binned statistics of whole texts and the number of words from a lexicon, which is taken from a bounded
sample of labelled documents (``sample``, the first by a hash of the id); its counts cover all labelled documents. What
reaches the driver is a row per domain, feature and bin, per lexicon word, and three sums a step.

Tokens are words between white space. Null texts count as empty: no tokens, and a posterior like any other. Very long texts are
measured whole. A null source is a source. Repeated rows are documents, and equal posteriors have equal rates. Without labels every
document is wholly good, with rate one; an empty table gives no rows. Other columns are kept by ``mix`` and may have any name.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import ROW, fresh_name, numbered, quoted, stored

DOMAINS = ("good", "poor", "toxic")
FEATURES = ("length", "capitals", "symbols", "digits", "repeated_lines", "repeated_words", "lexicon")
BINS = 12


@dataclass(frozen=True)
class Mixing:
    good: float = 0.94
    poor: float = 0.04
    toxic: float = 0.02
    anchor: str = "good"
    sample: int = 5_000
    lexicon: int = 200
    least_documents: int = 5
    steps: int = 40
    tolerance: float = 1e-3
    #: The most copies of a document.
    ceiling: float = 8.0
    #: Whether targets that are not met are an error.
    strict: bool = False

    @property
    def weights(self) -> tuple[float, ...]:
        return self.good, self.poor, self.toxic


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def plain_words(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _share(part: Column, whole: Column, fineness: float) -> Column:
    """A share as a bin, finer near zero."""
    share = part / F.greatest(whole, F.lit(1))
    return F.least(F.floor(F.sqrt(F.least(share, F.lit(1.0))) * fineness), F.lit(BINS - 1)).cast("int")


def _kinds(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def with_features(docs: DataFrame, text: Column, lexicon: list[str], names: dict[str, str]) -> DataFrame:
    """The documents with bins 0 to BINS - 1 of their texts' statistics, under the given names.

    Arrays that several statistics need are columns of their own first, so that each is made once.
    """
    own = {k: fresh_name(docs, f"mixing_{k}") for k in ("text", "words", "lines", "known")}
    whole = docs.withColumn(own["text"], F.coalesce(text.cast("string"), F.lit("")))
    t = F.col(own["text"])
    listed = F.array(*map(F.lit, lexicon)) if lexicon else F.array().cast("array<string>")
    whole = whole.withColumns(
        {
            own["words"]: words_of(t),
            own["lines"]: F.array_remove(F.split(t, "\n"), ""),
            own["known"]: F.size(F.array_intersect(plain_words(t), listed)),
        }
    )
    bins = _features(t, F.col(own["words"]), F.col(own["lines"]), F.col(own["known"]))
    tokens = {names["tokens"]: F.size(own["words"]).cast("long")} if "tokens" in names else {}
    return whole.withColumns(tokens | {names[n]: c for n, c in bins.items()}).drop(*own.values())


def _features(text: Column, words: Column, lines: Column, known: Column) -> dict[str, Column]:
    n = F.length(text)
    return {
        "length": F.least(F.floor(F.log2(n + 1) / 1.5), F.lit(BINS - 1)).cast("int"),
        "capitals": _share(_kinds(text, "[A-Z]+"), n, 11.9),
        "symbols": _share(_kinds(text, r"[#*$%&|<>!]+"), n, 11.9),
        "digits": _share(_kinds(text, "[0-9]+"), n, 11.9),
        "repeated_lines": _share(F.size(lines) - F.size(F.array_distinct(lines)), F.size(lines), 11.9),
        "repeated_words": _share(F.size(words) - F.size(F.array_distinct(words)), F.size(words), 11.9),
        "lexicon": F.least(known, F.lit(BINS - 1)).cast("int"),
    }


def domains(labels: DataFrame) -> DataFrame:
    """doc_id, domain (by number) of the labelled table: toxic before poor before good."""
    known = labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy("doc_id")
    worst = known.agg(
        F.max(F.coalesce("toxic", F.lit(0))).alias("t"), F.min(F.coalesce("quality", F.lit(1))).alias("q")
    )
    return worst.select("doc_id", F.when(F.col("t") > 0, 2).when(F.col("q") < 1, 1).otherwise(0).alias("domain"))


def toxic_lexicon(texts: DataFrame, known: DataFrame, mixing: Mixing) -> list[str]:
    """Words that a bounded sample's toxic documents have far oftener than its others, by a smoothed log ratio."""
    chosen = stored(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(mixing.sample), "lexicon-sample")
    # The sample is bounded by its parameter, so it may be broadcast.
    met = texts.join(F.broadcast(chosen), "doc_id").select(
        (F.col("domain") == 2).cast("int").alias("toxic"), F.explode(F.array_distinct(plain_words(F.col("text")))).alias("word")
    )
    toxic, rest = F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("rest")
    totals = chosen.select(F.sum((F.col("domain") == 2).cast("int")).alias("t"), F.count("*").alias("n")).first()
    if not totals.t or totals.t == totals.n:
        return []
    ratio = F.log(((F.col("toxic") + 0.5) / (totals.t + 1)) / ((F.col("rest") + 0.5) / (totals.n - totals.t + 1)))
    found = met.where("word != ''").groupBy("word").agg(toxic, rest).where(F.col("toxic") >= mixing.least_documents)
    telling = found.withColumn("ratio", ratio).where("ratio >= 2").orderBy(F.desc(F.col("ratio") * F.sqrt("toxic")), "word")
    return sorted(r.word for r in telling.limit(mixing.lexicon).collect())


def _log_shares(counted: DataFrame, names: list[str]) -> tuple[list[float], dict[str, list[list[float]]]]:
    """Log prior by domain, and log likelihood by feature, domain and bin, with a count of one added to each bin."""
    counts = {(r.feature, r.domain, r.bin): r.n for r in counted.collect()}
    sizes = [sum(n for (f, d, _), n in counts.items() if f == names[0] and d == k) for k in range(len(DOMAINS))]
    prior = [math.log((s + 1) / (sum(sizes) + len(DOMAINS))) for s in sizes]
    likely = {
        f: [[math.log((counts.get((f, k, b), 0) + 1) / (sizes[k] + BINS)) for b in range(BINS)] for k in range(len(DOMAINS))]
        for f in names
    }
    return prior, likely


@dataclass
class Posterior:
    """A fitted classifier as column expressions."""

    lexicon: list[str]
    prior: list[float]
    likely: dict[str, list[list[float]]]

    def of(self, bins: dict[str, Column]) -> list[Column]:
        scores = []
        for k, prior in enumerate(self.prior):
            score = F.lit(prior)
            for name, column in bins.items():
                table = F.array(*map(F.lit, self.likely[name][k]))
                score = score + F.element_at(table, column + 1)
            scores.append(score)
        top = F.greatest(*scores)
        chances = [F.exp(s - top) for s in scores]
        total = chances[0] + chances[1] + chances[2]
        return [c / total for c in chances]


def measured(docs: DataFrame, lexicon: list[str], id_col: str, text_col: str, source_col: str) -> DataFrame:
    """row, doc_id, source, tokens, a hash of the text and the features of every document; stored: texts are measured once."""
    base = docs.select(
        (F.col(ROW) if ROW in docs.columns else F.monotonically_increasing_id()).alias("row"),
        quoted(id_col).alias("doc_id"),
        quoted(source_col).cast("string").alias("source"),
        quoted(text_col).cast("string").alias("text"),
        F.xxhash64(F.coalesce(quoted(text_col).cast("string"), F.lit(""))).alias("text_hash"),
    )
    names = {n: f"f_{n}" for n in FEATURES} | {"tokens": "tokens"}
    return stored(with_features(base, F.col("text"), lexicon, names).drop("text"), "measured")


def fit_posterior(table: DataFrame, known: DataFrame, lexicon: list[str]) -> Posterior:
    names = [c[2:] for c in table.columns if c.startswith("f_")]
    pairs = F.explode(
        F.array(*(F.struct(F.lit(n).alias("feature"), F.col(f"f_{n}").alias("bin")) for n in names))
    )
    met = table.join(known, "doc_id").select("domain", pairs.alias("p"))
    counted = met.groupBy("domain", "p.feature", "p.bin").agg(F.count("*").alias("n"))
    return Posterior(lexicon, *_log_shares(counted, names))


def rate_of(posteriors: list[Column], steps: list[tuple[float, ...]], ceiling: float = Mixing.ceiling) -> Column:
    """A document's rate after the given steps: each goes down the gradient and back to rates from zero to the ceiling."""
    if not steps:
        return F.lit(1.0)
    taken = F.array(*(F.struct(*(F.lit(v).alias(f"s{k}") for k, v in enumerate(s))) for s in steps))
    return F.aggregate(taken, F.lit(1.0), lambda r, s: _moved(r, posteriors, [s[f"s{k}"] for k in range(len(DOMAINS))], ceiling))


def _moved(rate: Column, posteriors: list[Column], step: list, ceiling: float) -> Column:
    down = sum((p * s for p, s in zip(posteriors[1:], step[1:])), posteriors[0] * step[0])
    return F.least(F.lit(float(ceiling)), F.greatest(F.lit(0.0), rate - down))


def fit_steps(table: DataFrame, mixing: Mixing) -> tuple[list[tuple[float, ...]], list[float | None]]:
    """Steps until every domain's expected tokens are within the tolerance; and the targets. See ``fit_rates``."""
    return fit_rates(table, mixing)[:2]


def fit_rates(
    table: DataFrame, mixing: Mixing
) -> tuple[list[tuple[float, ...]], list[float | None], list[float]]:
    """Steps until every domain's expected tokens are within the tolerance; the targets; and the tokens reached.

    ``table`` has tokens and the posteriors p0, p1, p2. What is made small is the sum of the squared relative misses. The gradient
    of a document with tokens t and posterior p along domain k is t p_k times the miss. Of steps down the gradient, as it is and by
    the curvature of the documents whose rates can still move, several lengths are tried in one pass, and the best is taken as long
    as it lowers that sum. A domain that cannot reach its target with all its documents at the ceiling has no target (null), so it
    moves no rates. Targets that cannot be met together end at the nearest: a warning says so, or an error if ``strict``.
    """
    p = [F.col(f"p{k}") for k in range(len(DOMAINS))]
    groups = stored(table.groupBy("p0", "p1", "p2").agg(F.sum("tokens").alias("tokens")), "posterior-groups")
    t, every, ceiling = F.col("tokens"), range(len(DOMAINS)), float(mixing.ceiling)

    def sums(steps: list[tuple[float, ...]], trials: list[tuple[float, ...]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Each domain's expected tokens after each trial step, and the curvature of the documents whose rates can move."""
        rated = groups.withColumn("rate", rate_of(p, steps, ceiling))
        found = []
        for n, trial in enumerate(trials):
            rate = _moved(F.col("rate"), p, list(trial), ceiling)
            live = F.when((rate > 0) & (rate < ceiling), t)
            found += [F.sum(t * p[k] * rate).alias(f"a{n}_{k}") for k in every]
            found += [F.sum(live * p[k] * p[j]).alias(f"g{n}_{k}{j}") for k in every for j in every]
        row = rated.agg(*found).first()
        value = lambda name: row[name] or 0.0
        return [
            (np.array([value(f"a{n}_{k}") for k in every]), np.array([[value(f"g{n}_{k}{j}") for j in every] for k in every]))
            for n in range(len(trials))
        ]

    have, curve = sums([], [(0.0,) * len(DOMAINS)])[0]
    if not have.any():
        return [], [0.0] * len(DOMAINS), [0.0] * len(DOMAINS)
    # The targets follow from the weights and one total, whatever a domain has: scarce ones get rates above one.
    anchor = DOMAINS.index(mixing.anchor)
    targets = np.array(mixing.weights) * (have[anchor] / mixing.weights[anchor])
    within = targets <= ceiling * have
    scale = np.maximum(targets, 1.0)
    miss_of = lambda a: np.where(within, (a - targets) / scale, 0.0)
    off = lambda a: float((miss_of(a) ** 2).sum())
    steps: list[tuple[float, ...]] = []
    for _ in range(mixing.steps):
        if (np.abs(miss_of(have)) <= mixing.tolerance).all():
            break
        bend = np.where(np.outer(within, within), curve / np.outer(scale, scale), 0.0)
        newton = np.linalg.lstsq(bend, miss_of(have), rcond=1e-10)[0] / scale
        gradient = miss_of(have) / max(np.linalg.eigvalsh(bend).max(), 1e-300) / scale
        trials = [tuple(float(x) for x in f * way) for way, fs in ((newton, (1, 0.5, 0.2, 0.05)), (gradient, (3, 1, 0.3))) for f in fs]
        tried = sums(steps, trials)
        best = min(range(len(trials)), key=lambda n: off(tried[n][0]))
        if not off(tried[best][0]) < (1 - 1e-4) * off(have):
            break
        steps, (have, curve) = [*steps, trials[best]], tried[best]
    wanted = [float(x) if fine else None for x, fine in zip(targets, within)]
    if (np.abs(miss_of(have)) > mixing.tolerance).any():
        told = f"mixing: targets {wanted} not met, {have.tolist()} tokens reached"
        if mixing.strict:
            raise ValueError(told)
        warnings.warn(told, stacklevel=2)
    return steps, wanted, have.tolist()


def fitted(
    docs: DataFrame, labels: DataFrame, mixing: Mixing, id_col: str, text_col: str, source_col: str
) -> tuple[DataFrame, list[tuple[float, ...]], list[float | None], list[float | None]]:
    """row, doc_id, source, tokens, text_hash, p0, p1, p2 of every document, stored; the rates' steps, targets and tokens reached."""
    known = stored(domains(labels), "domains")
    texts = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).cast("string").alias("text"))
    lexicon = toxic_lexicon(texts, known, mixing)
    table = measured(docs, lexicon, id_col, text_col, source_col)
    labelled = not known.isEmpty()
    p = [F.lit(1.0), F.lit(0.0), F.lit(0.0)]
    if labelled:
        p = fit_posterior(table, known, lexicon).of({n: F.col(f"f_{n}") for n in FEATURES})
    own = ("row", "doc_id", "source", "tokens", "text_hash")
    # Stored, so that rates read three numbers instead of the classifier's expressions once a step.
    posteriors = stored(table.select(*own, *(x.alias(f"p{k}") for k, x in enumerate(p))), "posteriors")
    return posteriors, *(fit_rates(posteriors, mixing) if labelled else ([], [None] * len(DOMAINS), [None] * len(DOMAINS)))


def mixing_rates(
    docs: DataFrame,
    labels: DataFrame,
    mixing: Mixing = Mixing(),
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """doc_id, source, tokens, p_good, p_poor, p_toxic, rate for every document; target_good to reached_toxic are one of the run's.

    Without labels there are no targets, and these are null.
    """
    posteriors, steps, targets, reached = fitted(docs, labels, mixing, id_col, text_col, source_col)
    rate = rate_of([F.col(f"p{k}") for k in range(len(DOMAINS))], steps, mixing.ceiling)
    named = (F.col(f"p{k}").alias(f"p_{d}") for k, d in enumerate(DOMAINS))
    of_run = (
        F.lit(v).cast("double").alias(f"{what}_{d}")
        for what, values in (("target", targets), ("reached", reached))
        for d, v in zip(DOMAINS, values)
    )
    return posteriors.select("doc_id", "source", "tokens", *named, rate.alias("rate"), *of_run)


def mix(
    docs: DataFrame,
    labels: DataFrame,
    mixing: Mixing = Mixing(),
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The documents drawn at their rates, with all their columns; a rate of 2.3 gives two copies, or three with a chance of 0.3.

    The draw is a hash of id and text, so it is the same on every run.
    """
    docs = numbered(docs)
    posteriors, steps, _, _ = fitted(docs, labels, mixing, id_col, text_col, source_col)
    if not steps:
        return docs.drop(ROW)
    rate = rate_of([F.col(f"p{k}") for k in range(len(DOMAINS))], steps, mixing.ceiling)
    draw = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(1 << 32)) / float(1 << 32)
    copies = fresh_name(docs, "copies")
    drawn = posteriors.select(F.col("row").alias(ROW), F.floor(rate + 1 - draw - F.lit(2.0**-33)).cast("int").alias(copies))
    met = docs.join(drawn.where(F.col(copies) > 0), ROW)
    return met.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*(quoted(c) for c in docs.columns if c != ROW))
