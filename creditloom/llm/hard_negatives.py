"""Hard negatives by a secondary sort.

An anchor's positives are its best other rows of the same label; a positive's hard negatives are the best rows of another
label whose score lies within given hundredths of the positive's. Scores are exact integer inner products.

Anchors (a stated query set) meet all rows in cells of bounded blocks. A cell sends on what its rows can contribute: the best
few positives of each anchor, and, once positives are known, the best few rows inside each positive's window. What is sent is
one packed key (anchor, descending score, kind, id); ``repartitionAndSortWithinPartitions`` brings each anchor's keys together
in that order, and an iterator reads them as a stream: a positive opens its window, rows inside open windows come out with
their rank. No anchor's rows are held; of an anchor only its open windows are in memory.

Rows with a null id, label or vector, or with a null or non-finite component take no part. Components become floor(scale x);
shorter vectors count as padded with zeros. Ties are broken by the smaller id, then by the number of the stored row. Repeated
rows are rows of their own: each is a candidate, and each repeated anchor gives its own result rows. An anchor is never its own
positive. A score of zero opens a window of zero, a negative one none. Other columns are ignored, whatever their names. Empty
tables, or tables without anchors, give no rows. Long vectors are fine; scores beyond 64 bits raise ``OverflowError``.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import quoted, stored

#: Rows and anchors of a cell.
ROWS, ANCHORS = 2048, 1024
#: The packed key, in sorting order; numbers are big-endian with the sign bit flipped, and the score is inverted.
KEY = np.dtype(
    [("anchor", ">u8"), ("anchor_row", ">u8"), ("down", ">u8"), ("kind", "u1"), ("id", ">u8"), ("row", ">u8")]
)
POSITIVE, NEGATIVE = 0, 1
_UNPACK = struct.Struct(">QQQBQQ").unpack
_SIGN = 1 << 63
_LEAST = np.iinfo(np.int64).min

POSITIVES = "anchor_id long, anchor_row long, positive_id long, positive_row long, positive_score long"
FOUND = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


@dataclass(frozen=True)
class Mining:
    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95
    scale: int = 256


def vectors(
    table: DataFrame, anchor: Column, mining: Mining, id_col: str, vector_col: str, label_col: str
) -> DataFrame:
    """row, vec_id, label, anchor, width, vector (packed integers) of every row that takes part; stored."""
    scale = mining.scale
    chosen = table.select(
        quoted(id_col).cast("long").alias("vec_id"),
        quoted(label_col).cast("string").alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"),
        quoted(vector_col).cast("array<double>").alias("v"),
    ).where("vec_id is not null and label is not null and v is not null")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
            starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
            values = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
            wrong = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
            fine = wrong[ends] == wrong[starts]
            if (np.abs(values[np.isfinite(values)]) >= 2.0**62).any():
                raise OverflowError("vector components beyond 62 bits")
            widths, packed = [], []
            for i, j in zip(starts[fine].tolist(), ends[fine].tolist()):
                top = np.abs(values[i:j]).max(initial=0)
                widths.append(2 if top < 2**15 else 4 if top < 2**31 else 8)
                packed.append(values[i:j].astype(f"<i{widths[-1]}").tobytes())
            kept = [batch.column(k).filter(pa.array(fine)) for k in range(3)]
            columns = [*kept, pa.array(widths, pa.int32()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "anchor", "width", "vector"])

    made = chosen.mapInArrow(pack, "vec_id long, label string, anchor boolean, width int, vector binary")
    return stored(made.select(F.monotonically_increasing_id().alias("row"), "*"), "vectors")


def _matrix(table: pa.Table, length: int) -> np.ndarray:
    """The vectors of a table as rows of one matrix of integers, padded with zeros."""
    out = np.zeros((table.num_rows, length), np.int64)
    for k, (width, data) in enumerate(zip(table["width"].to_pylist(), table["vector"].to_pylist())):
        own = np.frombuffer(data, f"<i{width}")
        out[k, : len(own)] = own
    return out


def _scores(left: pa.Table, right: pa.Table) -> np.ndarray:
    """Exact inner products of all vectors on the left with all on the right."""
    length = max(
        max((len(d) // w for d, w in zip(t["vector"].to_pylist(), t["width"].to_pylist())), default=0)
        for t in (left, right)
    )
    a, b = _matrix(left, length), _matrix(right, length)
    bound = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * length
    if bound < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound >= 2**63:
        raise OverflowError("scores beyond 64 bits")
    return a @ b.T


def _best(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of each row's best k allowed scores; of equal scores the first columns."""
    masked = np.where(allowed, scores, _LEAST)
    if masked.shape[1] > k:
        least = np.partition(masked, -k, axis=1)[:, -k]
        allowed = allowed & (masked >= least[:, None])
    at, column = np.nonzero(allowed)
    order = np.lexsort((column, -scores[at, column], at))
    at, column = at[order], column[order]
    first = np.searchsorted(at, at)
    kept = np.arange(len(at)) - first < k
    return at[kept], column[kept]


def _ordered(column: pa.ChunkedArray) -> np.ndarray:
    """Signed numbers as unsigned ones of the same order."""
    return column.to_numpy().astype(np.int64).view(np.uint64) ^ np.uint64(_SIGN)


def _keys(anchors: pa.Table, rows: pa.Table, at: np.ndarray, column: np.ndarray, scores: np.ndarray, kind: int) -> pa.Table:
    made = np.zeros(len(at), KEY)
    made["anchor"], made["anchor_row"] = _ordered(anchors["vec_id"])[at], _ordered(anchors["row"])[at]
    made["down"] = ~(scores[at, column].view(np.uint64) ^ np.uint64(_SIGN))
    made["kind"] = kind
    made["id"], made["row"] = _ordered(rows["vec_id"])[column], _ordered(rows["row"])[column]
    ends = pa.py_buffer(np.arange(0, (len(at) + 1) * KEY.itemsize, KEY.itemsize, dtype=np.int32).tobytes())
    data = pa.Array.from_buffers(pa.binary(), len(at), [None, ends, pa.py_buffer(made.tobytes())])
    return pa.table({"key": data})


def unpacked(key: bytes) -> tuple[int, int, int, int, int, int]:
    """anchor id, anchor row, score, kind, id, row of a packed key."""
    anchor, anchor_row, down, kind, own, row = _UNPACK(key)
    return anchor - _SIGN, anchor_row - _SIGN, _SIGN - 1 - down, kind, own - _SIGN, row - _SIGN


def _sides(rows: pa.Table, anchors: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """Rows by id, their scores by anchor, and which have the anchor's label or are the anchor itself."""
    rows = rows.sort_by([("vec_id", "ascending"), ("row", "ascending")])
    names = {name: k for k, name in enumerate(set(rows["label"].to_pylist()) | set(anchors["label"].to_pylist()))}
    code = lambda t: np.fromiter((names[x] for x in t["label"].to_pylist()), np.int64, t.num_rows)
    same = code(anchors)[:, None] == code(rows)[None, :]
    itself = anchors["row"].to_numpy()[:, None] == rows["row"].to_numpy()[None, :]
    return rows, _scores(anchors, rows), same, itself


def cells(table: DataFrame, anchors: DataFrame, stripes: int, parts: int):
    """Cells of bounded blocks in which every anchor meets every row once."""
    spread = lambda df, own, n, other, m: (
        df.withColumn(own, F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        )
    )
    left = spread(table.drop("anchor"), "stripe", stripes, "part", parts)
    right = spread(anchors.drop("anchor"), "part", parts, "stripe", stripes)
    # Both come from one table; new names for the same columns tell the sides apart.
    right = right.toDF(*right.columns)
    return left.groupBy("stripe", "part").cogroup(right.groupBy("stripe", "part"))


def sorted_keys(keys: DataFrame) -> RDD:
    """The packed keys, an anchor's in one partition and in order."""
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    paired = keys.rdd.map(lambda r: (bytes(r[0]), None))
    return paired.repartitionAndSortWithinPartitions(parts, lambda key: xxhash.xxh64_intdigest(key[:16]))


def positives(table: DataFrame, anchors: DataFrame, stripes: int, parts: int, mining: Mining) -> DataFrame:
    """Each anchor's best other rows of its label; stored."""
    wanted = mining.positives

    def nearest(rows: pa.Table, own: pa.Table) -> pa.Table:
        rows, scores, same, itself = _sides(rows, own)
        return _keys(own, rows, *_best(scores, same & ~itself, wanted), scores, POSITIVE)

    def first(keys: Iterator[tuple[bytes, None]]) -> Iterator[tuple]:
        anchor, taken = b"", 0
        for key, _ in keys:
            if key[:16] != anchor:
                anchor, taken = key[:16], 0
            if taken < wanted:
                taken += 1
                anchor_id, anchor_row, score, _, own, row = unpacked(key)
                yield anchor_id, anchor_row, own, row, score

    keys = cells(table, anchors, stripes, parts).applyInArrow(nearest, "key binary")
    found = sorted_keys(keys).mapPartitions(first)
    return stored(table.sparkSession.createDataFrame(found, POSITIVES, verifySchema=False), "positives")


def mined(
    table: DataFrame, anchors: DataFrame, known: DataFrame, stripes: int, parts: int, mining: Mining
) -> DataFrame:
    """The best rows of another label inside each positive's window."""
    wanted, low, high = mining.negatives, mining.low, mining.high
    # An anchor has at most a handful of positives.
    scores_of = known.groupBy(F.col("anchor_row").alias("row")).agg(F.collect_set("positive_score").alias("windows"))

    def within(rows: pa.Table, own: pa.Table) -> pa.Table:
        rows, scores, same, _ = _sides(rows, own)
        windows = [[w for w in ws if w >= 0] for ws in own["windows"].to_pylist()]
        at, column = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for k in range(max(map(len, windows), default=0)):
            has = np.array([len(ws) > k for ws in windows])
            least = np.array([-(-low * ws[k] // 100) if len(ws) > k else 0 for ws in windows], np.int64)
            most = np.array([high * ws[k] // 100 if len(ws) > k else -1 for ws in windows], np.int64)
            inside = ~same & has[:, None] & (scores >= least[:, None]) & (scores <= most[:, None])
            more = _best(scores, inside, wanted)
            at, column = np.concatenate([at, more[0]]), np.concatenate([column, more[1]])
        once = np.unique(at * rows.num_rows + column)
        return _keys(own, rows, once // max(rows.num_rows, 1), once % max(rows.num_rows, 1), scores, NEGATIVE)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.table(batch)
            own = t.select(["anchor_id", "anchor_row"]).rename_columns(["vec_id", "row"])
            rows = t.select(["positive_id", "positive_row"]).rename_columns(["vec_id", "row"])
            each = np.arange(t.num_rows)
            yield from _keys(own, rows, each, each, _Diagonal(t["positive_score"].to_numpy()), POSITIVE).to_batches()

    def windowed(keys: Iterator[tuple[bytes, None]]) -> Iterator[tuple]:
        anchor: bytes = b""
        opened: list[list[int]] = []
        for key, _ in keys:
            if key[:16] != anchor:
                anchor, opened = key[:16], []
            anchor_id, _, score, kind, own, _ = unpacked(key)
            if kind == POSITIVE:
                opened.append([own, score, 0])
                continue
            for window in opened:
                if window[2] < wanted and low * window[1] <= 100 * score <= high * window[1]:
                    window[2] += 1
                    yield anchor_id, window[0], window[2], own, window[1], score

    own = anchors.join(scores_of, "row")
    negative = cells(table, own, stripes, parts).applyInArrow(within, "key binary")
    keys = negative.unionByName(known.mapInArrow(packed, "key binary"))
    found = sorted_keys(keys).mapPartitions(windowed)
    return table.sparkSession.createDataFrame(found, FOUND, verifySchema=False)


class _Diagonal:
    """A score for each row, under the index of a matrix."""

    def __init__(self, values: np.ndarray):
        self.values = values.astype(np.int64)

    def __getitem__(self, index: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        return self.values[index[0]]


def hard_negatives(
    table: DataFrame,
    anchor: Column,
    mining: Mining = Mining(),
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows that meet ``anchor``."""
    rows = vectors(table, anchor, mining, id_col, vector_col, label_col)
    anchors = rows.where("anchor")
    counts = rows.agg(F.count("*").alias("rows"), F.count_if("anchor").alias("anchors")).first()
    if not counts.anchors:
        return rows.sparkSession.createDataFrame([], FOUND)
    stripes, parts = -(-counts.rows // ROWS), -(-counts.anchors // ANCHORS)
    known = positives(rows, anchors, stripes, parts, mining)
    return mined(rows, anchors, known, stripes, parts, mining)
