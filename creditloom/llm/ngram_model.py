"""Interpolated modified Kneser-Ney over real character n-grams, counted and looked up by sharded keys.

An n-gram is ``ORDER`` code points as they are, without folding, held exactly in two longs (21 bits a code point). So
the tables grow with the corpus, and nothing of them reaches the driver but the four counts of counts of each order.

Texts are bundled into blocks of about ``BLOCK`` characters, once, where they are read; ``UNIT`` blocks of a task are a unit. Blocks
are stored in buckets by unit, so no text is shuffled, neither to meet the labels nor to meet the answers. Each unit's distinct
n-grams go out packed by shard, with their trusted counts. Counts are summed by n-gram; each order's context totals and its
lower order are found by shuffles on the context and the suffix. The probabilities meet the units' packed n-grams
shard by shard, and return to the units with them, where they are summed for each document. Tasks take ``PART`` characters at
once, and a unit asks before it holds many more than ``HELD`` distinct n-grams.

A code point nobody saw has its share of all code points, so no text is impossible.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.llm.common import bucketed, released, stored

ORDER = 5
BITS = 21
CODE_POINTS = 0x110000
BLOCK = 2_000_000
UNIT = 16
PART = 250_000
HELD = 1_000_000
#: A shard answers about this many blocks' worth of n-grams.
BLOCKS_A_SHARD = 20
LEAST_SHARDS = 16
LEAST_DISCOUNT = 0.05


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """High and low long of the n-gram that ends at each character, and the text it is in, for ``PART`` characters at a time.

    0 stands before a text.
    """
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    pad = "\0" * (ORDER - 1)
    joined = pad + pad.join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4") + np.uint32(1)
    del joined
    stops = np.cumsum(sizes)
    starts = stops - sizes + (ORDER - 1) * np.arange(1, len(sizes) + 1)
    for k in range(1, ORDER):
        points[starts - k] = 0
    total = int(sizes.sum())
    for first in range(0, total, PART):
        at = np.arange(first, min(first + PART, total))
        own = np.searchsorted(stops, at, "right")
        at += (ORDER - 1) * (own + 1)
        begin = int(at[0]) - ORDER + 1
        some, at = points[begin : int(at[-1]) + 1].astype(np.int64), at - begin
        high = some[at - 4] << BITS | some[at - 3]
        low = some[at - 2] << 2 * BITS | some[at - 1] << BITS | some[at]
        yield high, low, own


def distinct(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct n-grams in ascending order, and each n-gram's place among them."""
    of_high, highs = pd.factorize(high)
    of_low, lows = pd.factorize(low)
    place, both = pd.factorize(of_high * max(len(lows), 1) + of_low)
    h, lo = highs[both // max(len(lows), 1)], lows[both % max(len(lows), 1)]
    order = np.lexsort((lo, h))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return h[order], lo[order], rank[place]


def merged(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct n-grams of several (high, low, n) in ascending order, and the sums of their counts."""
    high, low, n = (np.concatenate(c) for c in zip(*parts))
    h, lo, place = distinct(high, low)
    return h, lo, np.bincount(place, n, len(h)).astype(np.int64)


class Places:
    """Where n-grams stand among given distinct ones."""

    def __init__(self, high: np.ndarray, low: np.ndarray):
        self.highs, self.lows = np.unique(high), np.unique(low)
        keys = self._keys(high, low)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    def _keys(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.highs, high) * len(self.lows) + np.searchsorted(self.lows, low)

    def of(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        return self.order[np.searchsorted(self.keys, self._keys(high, low))]


def shard_of(high: np.ndarray, low: np.ndarray, shards: int) -> np.ndarray:
    mixed = (high.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (low.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)


def _pack(values: np.ndarray) -> bytes:
    """Ascending longs pack well as differences."""
    bytes_of = np.diff(values, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8)
    return zlib.compress(np.ascontiguousarray(bytes_of.T).tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    columns = np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(columns.T).view("<i8").ravel())


def _pack_counts(values: np.ndarray) -> bytes:
    """Most counts are small: their upper bytes are zero."""
    return zlib.compress(np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpack_counts(data: bytes) -> np.ndarray:
    columns = np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(columns.T).view("<i8").ravel()


def _pack_texts(texts: list[str]) -> bytes:
    return pa.Codec("zstd", 3).compress("".join(texts).encode("utf-8", "surrogatepass"), asbytes=True)


def _texts(packed: bytes, sizes: np.ndarray) -> list[str]:
    whole = pa.CompressedInputStream(pa.BufferReader(packed), "zstd").read().decode("utf-8", "surrogatepass")
    ends = np.cumsum(sizes).tolist()
    return [whole[a:b] for a, b in zip([0, *ends[:-1]], ends)]


def blocks(docs: DataFrame) -> DataFrame:
    """unit, block, rows, head, ids, sizes and text of the documents (row, id, head, text) in bundles; stored in buckets by unit.

    ``head`` is what goes along unread, so the documents' row numbers are taken in one reading.
    """
    head_type = docs.schema["head"].dataType.simpleString()

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        rows, ids, heads, texts, held = [], [], [], [], 0

        def block() -> pa.RecordBatch:
            columns = (
                pa.array([task << 32 | made // UNIT], pa.int64()),
                pa.array([task << 32 | made], pa.int64()),
                pa.array([np.array(rows, "<i8").tobytes()], pa.binary()),
                pa.array([heads], pa.list_(batch.column(2).type)),
                pa.array([ids], pa.list_(pa.int64())),
                pa.array([np.array([len(t) for t in texts], "<i8").tobytes()], pa.binary()),
                pa.array([_pack_texts(texts)], pa.binary()),
            )
            return pa.RecordBatch.from_arrays(list(columns), ["unit", "block", "rows", "head", "ids", "sizes", "text"])

        for batch in batches:
            for row, doc_id, head, text in zip(*(batch.column(k) for k in range(4))):
                rows.append(row.as_py())
                ids.append(doc_id.as_py())
                heads.append(head.as_py())
                texts.append(text.as_py() or "")
                held += len(texts[-1])
                if held >= BLOCK or len(rows) >= BLOCK:
                    yield block()
                    rows, ids, heads, texts, held, made = [], [], [], [], 0, made + 1
        if rows:
            yield block()

    source = docs.select("row", "id", "head", "text")
    made = f"unit long, block long, rows binary, head array<{head_type}>, ids array<long>, sizes binary, text binary"
    return bucketed(source.mapInArrow(bundle, made), "blocks", "unit", 2 * max(1, source.rdd.getNumPartitions()))


def requests(bundled: DataFrame, trusted: DataFrame, shards: int) -> DataFrame:
    """unit, last, shard, high, low, n: distinct n-grams packed by shard, and how often trusted texts have them; stored.

    They are those of a unit's blocks up to ``last``, from after the ``last`` before it.
    """

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        trusted_at, rows, held = dict(zip(*(right.column(c).to_pylist() for c in ("met", "places")))), [], []
        order = np.argsort(left.column("block").to_numpy())
        for k in order.tolist():
            unit, block, sizes, text = (left.column(c)[k].as_py() for c in ("unit", "block", "sizes", "text"))
            sizes = np.frombuffer(sizes, "<i8")
            known = np.zeros(len(sizes), bool)
            known[trusted_at.get(block, [])] = True
            for high, low, own in grams(_texts(text, sizes)):
                h, lo, place = distinct(high, low)
                held.append((h, lo, np.bincount(place[known[own]], minlength=len(h))))
            del text
            held = [merged(held)] if held else []
            if held and (len(held[0][0]) > HELD or k == order[-1]):
                h, lo, n = held.pop()
                shard = shard_of(h, lo, shards)
                for s in np.unique(shard).tolist():
                    own_part = shard == s
                    rows.append((unit, block, s, _pack(h[own_part]), _pack(lo[own_part]), _pack_counts(n[own_part])))
        kinds = (pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 3)
        columns = list(zip(*rows)) or [()] * len(kinds)
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], ["unit", "last", "shard", "high", "low", "n"])

    # By shuffle at any size: the labels grow with the corpus. Only ids and places are moved.
    known = trusted.select(F.col("doc_id").cast("long").alias("id")).distinct()
    each = bundled.select(F.col("unit").alias("of"), F.col("block").alias("met"), F.posexplode("ids").alias("place", "id"))
    places = each.join(known.hint("merge"), "id").groupBy("of", "met").agg(F.collect_list("place").alias("places"))
    sides = bundled.select("unit", "block", "sizes", "text").groupBy("unit").cogroup(places.groupBy("of"))
    return stored(sides.applyInArrow(ask, "unit long, last long, shard int, high binary, low binary, n binary"), "requests")


def counts(asked: DataFrame) -> DataFrame:
    """shard, high, low, n: every n-gram of all texts and its count in the trusted ones; stored."""

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, high, low, n in zip(*(batch.column(k).to_pylist() for k in range(4))):
                h = _unpack(high)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(h), shard, np.int32)), pa.array(h), pa.array(_unpack(low)), pa.array(_unpack_counts(n))],
                    ["shard", "high", "low", "n"],
                )

    rows = asked.select("shard", "high", "low", "n").mapInArrow(unpacked, "shard int, high long, low long, n long")
    return stored(rows.groupBy("shard", "high", "low").agg(F.sum("n").alias("n")), "ngrams")


def _suffix(order: int) -> list[Column]:
    """The key of an n-gram without its first symbol."""
    high, low = F.col("high"), F.col("low")
    if order > 3:
        return [high.bitwiseAND(F.lit((1 << BITS * (order - 4)) - 1)).alias("high"), low]
    return [high, low.bitwiseAND(F.lit((1 << BITS * (order - 1)) - 1)).alias("low")]


def _context() -> list[Column]:
    """The key of an n-gram without its last symbol."""
    high, low = F.col("high"), F.col("low")
    last = high.bitwiseAND(F.lit((1 << BITS) - 1))
    moved = F.shiftrightunsigned(low, BITS).bitwiseOR(F.shiftleft(last, 2 * BITS))
    return [F.shiftrightunsigned(high, BITS).alias("context_high"), moved.alias("context_low")]


def probabilities(counted: DataFrame) -> DataFrame | None:
    """shard, high, low, log_prob of every n-gram of ``counted``; None if no trusted text has any.

    Lower orders count the distinct symbols that precede an n-gram. Of each n-gram a discount is taken by its count
    (1, 2, 3 or more), and a context's discounts go to the next lower order.
    """
    tables, n = {ORDER: counted}, F.col("n")
    for order in range(ORDER, 1, -1):
        preceded = F.sum((n > 0).cast("long")).alias("n")
        shorter = tables[order].select(*_suffix(order), "n").groupBy("high", "low").agg(preceded)
        tables[order - 1] = stored(shorter, f"ngrams-{order - 1}")
    if tables[1].where("n > 0").isEmpty():
        return None
    lower = None
    for order in range(1, ORDER + 1):
        table = tables[order]
        kinds = {r.n: r.types for r in table.where("n between 1 and 4").groupBy("n").agg(F.count("*").alias("types")).collect()}
        cuts = discounts([kinds.get(k, 0) for k in (1, 2, 3, 4)])
        cut = F.when(n < 1, 0.0).when(n == 1, cuts[0]).when(n == 2, cuts[1]).otherwise(cuts[2])
        if order == 1:
            total, held = table.agg(F.sum("n"), F.sum(cut)).first()
            prob = (n - cut) / F.lit(float(total)) + F.lit(held / total / CODE_POINTS)
            lower = stored(table.select("high", "low", prob.alias("prob")), "probabilities-1")
            continue
        # A context has at most one row for each code point.
        own = Window.partitionBy("context_high", "context_low")
        seen = table.withColumns(dict(zip(("context_high", "context_low"), _context())))
        shares = seen.withColumns({"cut": cut, "total": F.sum("n").over(own), "held": F.sum(cut).over(own)})
        high, low = _suffix(order)
        total = F.greatest("total", F.lit(1))
        part = shares.withColumns({"own": (n - F.col("cut")) / total, "rest": F.col("held") / total})
        part = part.withColumns({"suffix_high": high, "suffix_low": low})
        below = lower.select(F.col("high").alias("suffix_high"), F.col("low").alias("suffix_low"), F.col("prob").alias("below"))
        met = part.join(below.hint("merge"), ["suffix_high", "suffix_low"])
        prob = F.when(F.col("total") > 0, F.col("own") + F.col("rest") * F.col("below")).otherwise(F.col("below"))
        named = ("shard", "high", "low", F.log(prob).alias("log_prob")) if order == ORDER else ("high", "low", prob.alias("prob"))
        lower = released(stored(met.select(*named), f"probabilities-{order}"), lower, tables[order - 1])
    return lower


def discounts(types: list[int]) -> list[float]:
    """The discounts of counts 1, 2 and more, from the numbers of n-grams counted 1 to 4 times."""
    n1, n2, n3, n4 = types
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    return [
        min(max(i - (i + 1) * y * b / a if a and b else y, LEAST_DISCOUNT), float(i))
        for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))
    ]


def answers(asked: DataFrame, probs: DataFrame) -> DataFrame:
    """unit, last, high, low, values: n-grams of a shard that were asked for, and their log probabilities in the same order."""

    def answer(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        places, values = Places(right["high"].to_numpy(), right["low"].to_numpy()), right["log_prob"].to_numpy().astype("<f4")
        found = [values[places.of(_unpack(h), _unpack(lo))].tobytes() for h, lo in zip(left["high"], left["low"])]
        return left[["unit", "last", "high", "low"]].assign(values=pd.Series(found, left.index, dtype=object))

    sides = asked.select("unit", "last", "shard", "high", "low").groupBy("shard").cogroup(probs.groupBy("shard"))
    return sides.applyInPandas(answer, "unit long, last long, high binary, low binary, values binary")


def surprise(bundled: DataFrame, answered: DataFrame) -> DataFrame:
    """row, n, nats: the characters of every document and their summed surprise."""

    def summed(left: pa.Table, right: pa.Table) -> pa.Table:
        lasts = right.column("last").to_numpy()
        ends, now, made = np.unique(lasts), -1, []
        for k in np.argsort(left.column("block").to_numpy()).tolist():
            block, rows, sizes, text = (left.column(c)[k].as_py() for c in ("block", "rows", "sizes", "text"))
            sizes = np.frombuffer(sizes, "<i8")
            if block > now and sizes.any():
                now = ends[np.searchsorted(ends, block)]
                own = right.filter(pa.array(lasts == now))
                high, low = (np.concatenate([_unpack(x.as_py()) for x in own.column(c)]) for c in ("high", "low"))
                places = Places(high, low)
                log_probs = np.concatenate([np.frombuffer(x.as_py(), "<f4") for x in own.column("values")])
                del own, high, low
            each, at = np.empty(int(sizes.sum()), np.float32), 0
            for high, low, _ in grams(_texts(text, sizes)):
                h, lo, place = distinct(high, low)
                each[at : at + len(high)] = log_probs[places.of(h, lo)][place]
                at += len(high)
            nats = -np.bincount(np.repeat(np.arange(len(sizes)), sizes), each, len(sizes))
            made.append(pa.table([np.frombuffer(rows, "<i8"), sizes, nats], ["row", "n", "nats"]))
        return pa.concat_tables(made)

    texts = bundled.select("unit", "block", "rows", "sizes", "text")
    # A unit has a block, but without characters it has no answers.
    return texts.groupBy("unit").cogroup(answered.groupBy("unit")).applyInArrow(summed, "row long, n long, nats double")


def scored(docs: DataFrame, trusted: DataFrame) -> DataFrame | None:
    """head, n, nats of every document (row, id, head, text), stored; None without trusted text. ``row`` is unique."""
    bundled = blocks(docs)
    shards = max(LEAST_SHARDS, -(-bundled.count() // BLOCKS_A_SHARD))
    asked = requests(bundled, trusted, shards)
    counted = counts(asked)
    probs = probabilities(counted)
    if probs is None:
        return None
    heads = bundled.select(F.explode("head").alias("head")).withColumn("row", F.col("head.row"))
    found = surprise(bundled, answers(asked, probs))
    return released(stored(heads.join(found, "row").select("head", "n", "nats"), "surprise"), bundled, asked, counted, probs)
