"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most r bits have a common variant within half of r of each. So every distinct
fingerprint emits all variants in that ball (2,081 for r = 4); equal variants meet, and the pairs that collide are verified
on the whole fingerprints and deduplicated. A pair missed is impossible, and there is no bucket to cap: a variant's
members are linked to one of them, which keeps every component whole.

Variants are dealt by a linear code of their bits into slices. What a slice needs of a fingerprint follows from
the fingerprint, so the shuffle carries fingerprints, packed, and each slice makes its own share of all variants: 8 bytes a slice
instead of a row for each of 2,081 variants. A slice works in sub-slices of bounded size.

Null texts count as empty; texts without words have fingerprint zero. Equal fingerprints are one node, so copies cost
nothing. Ids may repeat; a null id is never a component's id unless it has no other. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import ROW, numbered, quoted, stored
from creditloom.llm.components import roots
from creditloom.llm.exact_dedup import keep_rows

SEED = 42
#: The shuffle carries 8 bytes of every fingerprint for each slice; a slice holds every fingerprint it shares a variant with.
SLICES = 256
#: Variants that a task compares at once.
SUB_SLICE = 4_000_000


def fingerprint(text: str | None, words: int = 4) -> int:
    """The 64-bit SimHash of a whole text's shingles, repeats included, as a signed number."""
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[words - 1 :] if len(found) >= words else ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[i:j], SEED) for i, j in zip(starts.tolist(), last.tolist())], "<u8")
    set_bits = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 100_000):
        bits = np.unpackbits(hashes[k : k + 100_000].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, print of every document, stored. ``docs`` is a numbered table, or one read once."""

    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, words) for t in texts], dtype="int64")

    return stored(
        docs.select(
            (F.col(ROW) if ROW in docs.columns else F.monotonically_increasing_id()).alias("row"),
            quoted(id_col).alias("doc_id"),
            prints(quoted(text_col).cast("string")).alias("print"),
        ),
        "fingerprints",
    )


class Ball:
    """The variants of a fingerprint, by the slice and sub-slice they fall into."""

    def __init__(self, max_bits: int, bits: int):
        # The code with fewer bits is the low part of the code with more.
        columns = (np.random.default_rng(64).integers(1, 1 << 40, 64) & ((1 << bits) - 1)).tolist()
        self.table = np.zeros((8, 256), np.int64)
        for byte in range(8):
            for value in range(256):
                for k in range(8):
                    if value >> k & 1:
                        self.table[byte, value] ^= columns[8 * byte + k]
        self.low, self.high = max_bits // 2, (max_bits + 1) // 2
        found: dict[int, tuple[list, list]] = {}
        for radius in range(self.high + 1):
            for chosen in combinations(range(64), radius):
                mask = sum(1 << k for k in chosen)
                code = 0
                for k in chosen:
                    code ^= columns[k]
                found.setdefault(code, ([], []))[radius > self.low].append(mask)
        self.size = sum(len(x) for sides in found.values() for x in sides)
        self.flips = {c: (np.array(a, np.uint64), np.array(b, np.uint64)) for c, (a, b) in found.items()}

    def code(self, prints: np.ndarray) -> np.ndarray:
        parts = np.ascontiguousarray(prints).view(np.uint8).reshape(-1, 8)
        out = np.zeros(len(prints), np.int64)
        for byte in range(8):
            out ^= self.table[byte, parts[:, byte]]
        return out


@lru_cache(maxsize=4)
def ball(max_bits: int, bits: int) -> Ball:
    return Ball(max_bits, bits)


def collisions(prints: np.ndarray, target: int, max_bits: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links among fingerprints that share a variant with the given code."""
    near = ball(max_bits, bits)
    codes = near.code(prints)
    order = np.argsort(codes, kind="stable")
    edges = np.flatnonzero(np.diff(codes[order], prepend=-1))
    # Of the two radii of an odd distance, the smaller comes first: its members are within the distance of all.
    parts: tuple[list, list] = ([], [])
    for start, end in zip(edges, [*edges[1:], len(order)]):
        own = order[start:end]
        for side, masks in enumerate(near.flips.get(target ^ int(codes[own[0]]), ())):
            if len(masks):
                made = prints[own].view(np.uint64)[:, None] ^ masks[None, :]
                parts[side].append((made.ravel(), np.repeat(own, len(masks))))
    if not parts[0]:
        return prints[:0], prints[:0]
    inner = sum(len(v) for v, _ in parts[0])
    variants = np.concatenate([v for side in parts for v, _ in side])
    owners = np.concatenate([o for side in parts for _, o in side])
    order = np.argsort(variants, kind="stable")
    first = np.concatenate(([True], np.diff(variants[order]) != 0))
    hubs = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    linked = ~first & (order[hubs] < inner)
    a, b = prints[owners[order[hubs[linked]]]], prints[owners[order[linked]]]
    # Each side of a pair lies within half the distance of the variant; the whole fingerprints have the last word.
    right = (a != b) & (np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)) <= max_bits)
    pairs = np.unique(np.stack([np.minimum(a, b)[right], np.maximum(a, b)[right]]), axis=1)
    return pairs[0], pairs[1]


def near_links(distinct: DataFrame, max_bits: int = 4, slices: int = SLICES) -> DataFrame:
    """Links a, b among distinct fingerprints (column ``print``) that join all within ``max_bits`` bits of each other."""
    slice_bits = max(slices - 1, 1).bit_length()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = ball(max_bits, slice_bits)
        reach = np.zeros(1 << slice_bits, bool)
        reach[list(near.flips)] = True
        for batch in batches:
            prints = batch.column(0).to_numpy()
            codes = near.code(prints)
            shares = [prints[reach[codes ^ k]].tobytes() for k in range(1 << slice_bits)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(1 << slice_bits), pa.int32()), pa.array(shares, pa.binary())], ["slice", "prints"]
            )

    def meet(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        prints = np.frombuffer(b"".join(rows["prints"]), np.int64)
        variants = len(prints) * ball(max_bits, slice_bits).size >> slice_bits
        more = max(0, (variants // SUB_SLICE).bit_length())
        found = [collisions(prints, int(key[0]) | k << slice_bits, max_bits, slice_bits + more) for k in range(1 << more)]
        return pd.DataFrame({"a": np.concatenate([a for a, _ in found]), "b": np.concatenate([b for _, b in found])})

    dealt = distinct.select("print").mapInArrow(deal, "slice int, prints binary")
    return dealt.groupBy("slice").applyInPandas(meet, "a long, b long").distinct()


def near_components(prints: DataFrame, max_bits: int = 4, slices: int = SLICES) -> DataFrame:
    """print, component_id, keep_row: the component of every distinct fingerprint; stored."""
    smallest = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row"))).alias("first")
    distinct = stored(prints.groupBy("print").agg(smallest), "distinct-prints")
    found = roots(near_links(distinct, max_bits, slices)).withColumnRenamed("node", "print")
    labelled = stored(
        distinct.join(found, "print", "left").withColumn("root", F.coalesce("root", "print")), "labelled-prints"
    )
    heads = stored(labelled.groupBy("root").agg(F.min("first").alias("head")), "component-heads")
    return stored(
        labelled.join(heads, "root").select(
            "print", F.col("head.doc_id").alias("component_id"), F.col("head.row").alias("keep_row")
        ),
        "print-components",
    )


def near_duplicates(
    docs: DataFrame, words: int = 4, max_bits: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, fingerprint (hex), component_id for every document."""
    prints = fingerprints(docs, words, id_col, text_col)
    joined = prints.join(near_components(prints, max_bits), "print")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(
    docs: DataFrame, words: int = 4, max_bits: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row of each component, that of the smallest id, with all its columns."""
    docs = numbered(docs)
    prints = fingerprints(docs, words, id_col, text_col)
    return keep_rows(docs, near_components(prints, max_bits).select("keep_row").distinct())
