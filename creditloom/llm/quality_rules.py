"""Quality rules: gradient-boosted trees over document statistics, with monotonic constraints.

Statistics are taken over whole texts in the tasks that read them. The trees are fitted to a bounded sample of the labelled
rows (``sample``, the first by a hash of the id), for logistic loss on binned statistics; on statistics in
``FALLING`` the score may only fall, so more symbols, repetition or capitals never make a document better. All trees
have the same depth and lie in numpy arrays, node by node, so a batch is scored level by level for all rows at once.

The base rules reject a document by itself: fewer than ten words, or over a fifth of its words in repeated windows.
Otherwise it is kept if its score reaches the cutoff: the ``lenience`` quantile of good documents' scores in the part
of the sample that fitting does not see, at most one half.

Null texts count as having no words. Null or missing labels are not used; without both kinds of label there is no
model, and only the base rules judge. Repeated rows are judged alike.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import quoted, stored

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
WINDOW = 5

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STATISTICS = (
    "log_words",
    "word_length",
    "symbol_share",
    "dup_line_share",
    "repeat_share",
    "capital_share",
    "digit_share",
    "mark_share",
    "letter_share",
    "distinct_share",
    "line_words",
)
#: Statistics on which the score may not rise.
FALLING = ("symbol_share", "dup_line_share", "repeat_share", "capital_share", "mark_share")

_KINDS = {name: bytes(b for b in range(128) if test(chr(b))) for name, test in {
    "capital": lambda c: "A" <= c <= "Z",
    "digit": lambda c: "0" <= c <= "9",
    "mark": lambda c: c in "!?@^~=_+\\/{}[]\"",
    "small": lambda c: "a" <= c <= "z",
    "symbol": lambda c: c in SYMBOLS,
}.items()}


def repeated_words(words: list) -> int:
    """Words that lie in a window found at least twice, each counted once."""
    windows = list(zip(*(words[k:] for k in range(WINDOW))))
    found = Counter(windows)
    if len(found) == len(windows):
        return 0
    total, covered = 0, 0
    for k, window in enumerate(windows):
        if found[window] > 1:
            total += k + WINDOW - max(covered, k)
            covered = k + WINDOW
    return total


def statistics(text: str | None) -> tuple:
    """The five counts of the base rules, then ``STATISTICS``."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    chars = len(b"".join(words).decode())
    kind = {name: len(raw) - len(raw.translate(None, delete)) for name, delete in _KINDS.items()}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    dup_lines = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    # Bytes of other scripts count as letters.
    other = len(raw) - len(raw.translate(None, bytes(range(128, 256))))
    chars_or_one, n_or_one = max(chars, 1), max(n, 1)
    return (
        n,
        chars,
        kind["symbol"],
        dup_lines,
        repeats,
        np.log1p(n),
        chars / n_or_one,
        kind["symbol"] / chars_or_one,
        dup_lines / max(len(lines), 1),
        repeats / n_or_one,
        kind["capital"] / chars_or_one,
        kind["digit"] / chars_or_one,
        kind["mark"] / chars_or_one,
        min((kind["small"] + other) / chars_or_one, 2.0),
        len(set(words)) / n_or_one,
        n / max(len(lines), 1),
    )


@dataclass(frozen=True)
class Boosting:
    sample: int = 20_000
    trees: int = 60
    depth: int = 3
    rate: float = 0.2
    bins: int = 32
    least_weight: float = 5.0
    ridge: float = 1.0
    lenience: float = 0.003


@dataclass
class Forest:
    """Complete trees: the children of node i are 2 i + 1 and 2 i + 2; a row goes right where it exceeds the threshold."""

    features: np.ndarray
    thresholds: np.ndarray
    leaves: np.ndarray
    prior: float
    cutoff: float = 0.5

    def score(self, x: np.ndarray) -> np.ndarray:
        rows, margin = np.arange(len(x)), np.full(len(x), self.prior)
        inner = self.features.shape[1]
        for features, thresholds, leaves in zip(self.features, self.thresholds, self.leaves):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, features[node]] > thresholds[node])
            margin += leaves[node - inner]
        return 1 / (1 + np.exp(-margin))


def _tree(bins: np.ndarray, grad: np.ndarray, hess: np.ndarray, signs: np.ndarray, n_bins: int, p: Boosting):
    """One complete tree on binned rows: features, split bins (rows with a larger bin go right) and leaf values."""
    inner = (1 << p.depth) - 1
    features, splits = np.zeros(inner, np.int64), np.full(inner, n_bins, np.int64)
    low, high = np.full(2 * inner + 1, -np.inf), np.full(2 * inner + 1, np.inf)
    node = np.zeros(len(bins), np.int64)

    def weight(g, h, lo, hi):
        return np.clip(-g / (h + p.ridge), lo, hi)

    def gain(g, h, w):
        return -(g * w + 0.5 * (h + p.ridge) * w * w)

    for at in range(inner):
        rows = np.flatnonzero(node == at)
        g, h, lo, hi = grad[rows], hess[rows], low[at], high[at]
        best, chosen = 1e-9, None
        whole = gain(g.sum(), h.sum(), weight(g.sum(), h.sum(), lo, hi))
        for f in range(bins.shape[1]):
            gl = np.cumsum(np.bincount(bins[rows, f], g, n_bins))[:-1]
            hl = np.cumsum(np.bincount(bins[rows, f], h, n_bins))[:-1]
            gr, hr = g.sum() - gl, h.sum() - hl
            wl, wr = weight(gl, hl, lo, hi), weight(gr, hr, lo, hi)
            gains = gain(gl, hl, wl) + gain(gr, hr, wr) - whole
            gains[(hl < p.least_weight) | (hr < p.least_weight) | (signs[f] * (wr - wl) < 0)] = -np.inf
            k = int(gains.argmax())
            if gains[k] > best:
                best, chosen = gains[k], (f, k, (wl[k] + wr[k]) / 2)
        left, right = 2 * at + 1, 2 * at + 2
        low[[left, right]], high[[left, right]] = lo, hi
        if chosen:
            features[at], splits[at], middle = chosen
            if signs[features[at]] < 0:
                low[left], high[right] = max(lo, middle), min(hi, middle)
            elif signs[features[at]] > 0:
                high[left], low[right] = min(hi, middle), max(lo, middle)
        node[rows] = np.where(bins[rows, features[at]] > splits[at], right, left)
    leaves = np.zeros(inner + 1)
    for k in range(inner + 1):
        rows = node == inner + k
        leaves[k] = weight(grad[rows].sum(), hess[rows].sum(), low[inner + k], high[inner + k])
    return features, splits, leaves * p.rate, node - inner


def fit(x: np.ndarray, good: np.ndarray, p: Boosting = Boosting(), falling: Iterable[str] = FALLING) -> Forest | None:
    """Trees for P(good); every fifth row is left out of fitting and sets the cutoff. None without both kinds."""
    held = np.arange(len(x)) % 5 == 4
    if not (0 < good[~held].sum() < (~held).sum()):
        return None
    falling = set(falling)
    signs = np.array([-1 if s in falling else 0 for s in STATISTICS[: x.shape[1]]])
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, p.bins + 1)[1:-1])) for c in x[~held].T]
    bins = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x[~held].T)], axis=1)
    y = good[~held].astype(float)
    prior = float(np.log(y.mean() / (1 - y.mean())))
    margin, trees = np.full(len(y), prior), []
    for _ in range(p.trees):
        chance = 1 / (1 + np.exp(-margin))
        features, splits, leaves, leaf = _tree(bins, chance - y, chance * (1 - chance), signs, p.bins + 1, p)
        margin += leaves[leaf]
        thresholds = [edges[f][s] if s < len(edges[f]) else np.inf for f, s in zip(features, splits)]
        trees.append((features, np.array(thresholds), leaves))
    forest = Forest(*(np.stack(part) for part in zip(*trees)), prior)
    sure = forest.score(x[held & good.astype(bool)])
    if len(sure):
        forest.cutoff = min(0.5, float(np.quantile(sure, p.lenience)))
    return forest


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the five counts and ``stats``, an array in the order of ``STATISTICS``; stored."""

    @F.pandas_udf(", ".join(f"{c} long" for c in COUNTS) + ", stats array<double>")
    def measured(texts: pd.Series) -> pd.DataFrame:
        rows = [statistics(t) for t in texts]
        columns = {c: [r[k] for r in rows] for k, c in enumerate(COUNTS)}
        return pd.DataFrame(columns | {"stats": [[float(v) for v in r[len(COUNTS) :]] for r in rows]})

    found = docs.select(quoted(id_col).alias("doc_id"), measured(quoted(text_col).cast("string")).alias("m"))
    return stored(found.select("doc_id", *(f"m.{c}" for c in COUNTS), "m.stats"), "statistics")


def labelled_sample(stats: DataFrame, labels: DataFrame, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``sample`` labelled rows, the first by a hash of the id; ties by the statistics themselves."""
    good = labels.where("quality is not null and doc_id is not null").groupBy("doc_id")
    met = stats.join(good.agg(F.min("quality").alias("good")), "doc_id")
    # Only rows that can be among the first go on, so that tasks do not each send a whole sample to the driver.
    share = min(1.0, 1.5 * sample / max(met.count(), 1))
    rows = (
        met.select("stats", "good", F.xxhash64("doc_id").alias("order"))
        .where(F.col("order") <= int(-(1 << 63) + share * ((1 << 64) - 2048)))
        .orderBy("order", "stats", "good")
        .limit(sample)
        .toPandas()
    )
    x = np.array(rows["stats"].tolist(), float).reshape(len(rows), len(STATISTICS))
    return x, (rows["good"].to_numpy(float) > 0)


def judged(
    docs: DataFrame,
    labels: DataFrame,
    p: Boosting = Boosting(),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, the five counts, base_failed, kept, score (null without a model)."""
    stats = document_statistics(docs, id_col, text_col)
    forest = fit(*labelled_sample(stats, labels, p.sample), p)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    if forest is None:
        score, fine = F.lit(None).cast("double"), F.lit(True)
    else:

        @F.pandas_udf("double")
        def scored(rows: pd.Series) -> pd.Series:
            return pd.Series(forest.score(np.array(rows.tolist(), float).reshape(len(rows), len(STATISTICS))))

        score, fine = scored("stats"), F.col("score") >= forest.cutoff
    return (
        stats.withColumn("score", score)
        .select("doc_id", *COUNTS, "score", failed.alias("base_failed"))
        .withColumn("kept", ~F.col("base_failed") & fine)
    )
