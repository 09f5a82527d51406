"""Near-duplicates by b-bit MinHash.

A text's set are its distinct word shingles. Of each of ``bands x rows`` permutations the smallest shingle is taken. Bands of
whole minima generate candidates: texts that share a band's minima meet. Of the minima themselves only the low two bits are
kept, packed into a signature; the share of equal bit pairs, corrected for pairs that are equal by chance, estimates the similarity
of candidates. Those that are not far below the limit are confirmed on the full sets.

At the limit of 0.85, 32 bands of 6 miss a pair with a chance of 3 in 10 million, and the estimate drops one that lies six
standard deviations (0.18) below its similarity. Everything else is exact, but for 64-bit hashes that stand for shingles.

Equal sets are one class. Classes that share a band belong to one candidate group, found as components of links to the least
class of each band, so no pairs within a band are listed. A group is dealt into blocks of bounded numbers and sizes, each with
the group's few least classes; a block's classes are compared, links that join nothing new are skipped. What is not linked to
the largest part of a group after that is compared with the rest of the group, again in blocks. So a group of copies costs what
it has members, and no link between parts is lost.

Null and empty texts and those without words have an empty set and are linked with nothing. Fewer words than a shingle's are one
shingle. Very long texts are hashed whole. Repeated rows are rows; ids may repeat; a null id is a component's id only where it has
no other. Other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.llm.common import ROW, numbered, quoted, stored
from creditloom.llm.components import roots

#: Classes and shingles of a block, and the least classes of a group that go to each of its blocks.
BLOCK, BLOCK_SHINGLES, HUBS = 256, 2_000_000, 8
#: Members of small groups that one task takes at once.
BIN = 2_000
MASK = (1 << 64) - 1


@dataclass(frozen=True)
class MinHash:
    words: int = 3
    percent: int = 85
    bands: int = 32
    rows: int = 6
    deviations: float = 6.0
    seed: int = 13

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    @property
    def floor(self) -> float:
        """The least estimate that a pair at the limit may have."""
        limit = self.percent / 100
        chance = limit + (1 - limit) / 4
        return limit - self.deviations * (chance * (1 - chance) / self.hashes) ** 0.5 / 0.75


class _Words(dict):
    """Hashes of words, remembered between texts; it starts afresh when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 500_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = _Words()


def _mixed(x: np.ndarray) -> np.ndarray:
    """Bits spread over all of 64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, words: int = 3) -> np.ndarray:
    """The sorted hashes of a whole text's distinct shingles."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(_WORDS.__getitem__, found), np.uint64, len(found))
    size = min(words, len(found))
    factors = _odd(words + 1, 5)
    # Sequences of another length than a shingle's start from another number.
    joined = np.full(len(found) - size + 1, size, np.uint64) * factors[words]
    for k in range(size):
        joined += _mixed(hashes[k : len(found) - size + 1 + k] * factors[k])
    return np.unique(_mixed(joined))


def minima(hashes: np.ndarray, spec: MinHash) -> np.ndarray:
    """The smallest value of the set under each permutation of 32-bit numbers."""
    rng = np.random.default_rng(spec.seed)
    factor = rng.integers(0, 1 << 31, (spec.hashes, 1), np.uint32) * np.uint32(2) + np.uint32(1)
    shift = rng.integers(0, 1 << 32, (spec.hashes, 1), np.uint32)
    out = np.full(spec.hashes, 0xFFFFFFFF, np.uint32)
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(low), 1024):
        moved = factor * low[None, k : k + 1024]
        moved += shift
        np.minimum(out, moved.min(axis=1), out=out)
    return out


def band_keys(least: np.ndarray, spec: MinHash) -> np.ndarray:
    """A key for each text and band of rows of minima."""
    parts = least.reshape(-1, spec.bands, spec.rows).astype(np.uint64)
    keys = np.broadcast_to(np.arange(spec.bands, dtype=np.uint64) + np.uint64(1), parts.shape[:2]).copy()
    for k in range(spec.rows):
        keys = _mixed(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return keys


def signatures(least: np.ndarray) -> np.ndarray:
    """The low two bits of each minimum, four to a byte. Minima are mixed first: low bits of a permutation are not random."""
    bits = (_mixed(least.astype(np.uint64)) & np.uint64(3)).astype(np.uint8)
    bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 32)))
    return bits[:, 0::4] | bits[:, 1::4] << 2 | bits[:, 2::4] << 4 | bits[:, 3::4] << 6


def estimates(left: np.ndarray, right: np.ndarray, hashes: int) -> np.ndarray:
    """Similarity of all pairs of packed signatures: the share of equal bit pairs, corrected for chance."""
    a, b = left.view(np.uint64), right.view(np.uint64)
    unequal = np.zeros((len(a), len(b)), np.int32)
    for k in range(a.shape[1]):
        x = a[:, k, None] ^ b[None, :, k]
        unequal += np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(0x5555555555555555))
    return ((1 - unequal / hashes) - 0.25) / 0.75


def signed(docs: DataFrame, spec: MinHash, id_col: str, text_col: str) -> DataFrame:
    """row, doc_id, size, digest, bands, signature of every document; stored. ``docs`` is a numbered table."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                sizes, digests, least = [], [], np.zeros((batch.num_rows, spec.hashes), np.uint32)
                for k, text in enumerate(batch.column(2)):
                    own = shingle_set(text.as_py(), spec.words)
                    sizes.append(len(own))
                    digests.append(xxhash.xxh3_128_digest(own.astype("<u8").tobytes()))
                    least[k] = minima(own, spec)
                keys = band_keys(least, spec).view(np.int64)
                ends = np.arange(0, keys.size + 1, spec.bands, dtype=np.int32)
                columns = [
                    batch.column(0),
                    batch.column(1),
                    pa.array(sizes, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel())),
                    pa.array([x.tobytes() for x in signatures(least)], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "size", "digest", "bands", "signature"])

    chosen = docs.select(F.col(ROW).alias("row"), quoted(id_col).alias("doc_id"), quoted(text_col).cast("string").alias("text"))
    kind = dict(chosen.dtypes)["doc_id"]
    made = chosen.mapInArrow(
        sign, f"row long, doc_id {kind}, size long, digest binary, bands array<long>, signature binary"
    )
    return stored(made, "signed")


def candidate_groups(classes: DataFrame, prints: DataFrame) -> DataFrame:
    """cls, size, signature, root, blocks of every class that shares a band with another; stored.

    ``classes`` has the row that stands for each class. Classes meet their band's least one only.
    """
    own = stored(prints.join(classes.select(F.col("cls").alias("row")), "row", "left_semi").drop("doc_id", "digest"), "class-prints")
    banded = own.select(F.col("row").alias("cls"), F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("cls").alias("hub"), F.max("cls").alias("last"))
    hubs = stored(shared.where("hub != last").select("band", "hub"), "band-hubs")
    links = banded.join(hubs, "band").where("cls != hub").select(F.col("cls").alias("a"), F.col("hub").alias("b"))
    found = roots(links.distinct())
    both = stored(found.unionByName(found.select(F.col("root").alias("node"), "root").distinct()), "candidates")
    members = own.drop("bands").join(both, own["row"] == both["node"]).drop("node").withColumnRenamed("row", "cls")
    sizes = members.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    return stored(members.join(sizes.select("root", blocks.alias("blocks")), "root"), "candidate-groups")


def _linked(table: pa.Table, spec: MinHash, crossed: bool) -> Iterator[tuple[int, int]]:
    """Confirmed links among the classes of one group that join parts not yet joined; crossed: left with right ones only."""
    cls, comp, left = (table[c].to_numpy() for c in ("cls", "comp", "left"))
    size = table["size"].to_numpy()
    marks = np.frombuffer(b"".join(table["signature"].to_pylist()), np.uint8).reshape(len(cls), -1)
    order = np.argsort(cls, kind="stable")
    one, other = (np.flatnonzero(left), np.flatnonzero(~left)) if crossed else (order, order)
    alike = estimates(marks[one], marks[other], spec.hashes)
    small, large = np.minimum(size[one][:, None], size[other]), np.maximum(size[one][:, None], size[other])
    fine = (alike >= spec.floor) & (100 * small >= spec.percent * large) & (comp[one][:, None] != comp[other])
    if not crossed:
        fine &= cls[one][:, None] < cls[other]
    i, j = np.nonzero(fine)
    turn = np.argsort(-alike[i, j], kind="stable")
    texts, sets, root = table["text"], {}, {}

    def top(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def own(k: int) -> np.ndarray:
        if k not in sets:
            sets[k] = shingle_set(texts[k].as_py(), spec.words)
        return sets[k]

    for x, y in zip(one[i[turn]].tolist(), other[j[turn]].tolist()):
        a, b = top(int(comp[x])), top(int(comp[y]))
        if a == b:
            continue
        both = np.concatenate([own(x), own(y)])
        both.sort()
        shared = int(np.count_nonzero(both[1:] == both[:-1]))
        if 100 * shared >= spec.percent * (len(both) - shared):
            root[a] = b
            yield int(cls[x]), int(cls[y])


def _confirm(cells: DataFrame, spec: MinHash, crossed: bool) -> DataFrame:
    """Links a, b found in cells of cls, comp, left, size, signature, text, root, cell."""

    def confirm(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("root")
        group = table["root"].to_numpy()
        edges = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
        found = []
        for start, end in zip(edges.tolist(), [*edges[1:].tolist(), len(group)]):
            found += _linked(table.slice(start, end - start), spec, crossed)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return cells.groupBy("cell").applyInArrow(confirm, "a long, b long")


def links(groups: DataFrame, docs: DataFrame, spec: MinHash, text_col: str) -> DataFrame:
    """Links a, b that join all classes whose similarity reaches the limit; stored."""
    texts = docs.select(F.col(ROW).alias("cls"), quoted(text_col).cast("string").alias("text"))
    members = stored(groups.join(texts, "cls"), "group-texts")
    total = members.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("shingles")).first()
    bins = max(1, -(-total.n // BIN), -(-total.shingles // BLOCK_SHINGLES))

    def cell(kind: int, group: Column, left: Column, right: Column) -> Column:
        parts = (F.lit(kind), group.cast("long"), left.cast("int"), right.cast("int"))
        return F.struct(*(c.alias(n) for c, n in zip(parts, "kglr")))

    zero = F.lit(0)
    small = members.where("blocks = 1").withColumn("cell", cell(0, F.pmod(F.xxhash64("root"), F.lit(bins)), zero, zero))
    large = members.where("blocks > 1").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    least = large.select("cls", F.row_number().over(Window.partitionBy("root").orderBy("cls")).alias("rank"))
    hubs = stored(least.where(F.col("rank") <= HUBS).select("cls"), "hubs")
    guests = large.join(hubs, "cls").withColumn("at", F.explode(F.sequence(zero, F.col("blocks") - 1))).where("at != own")
    dealt = large.withColumn("at", F.col("own")).unionByName(guests)
    dealt = dealt.withColumn("cell", cell(1, F.col("root"), F.col("at"), zero)).drop("at", "own")
    # Each class is a part of its own.
    alone = small.unionByName(dealt).withColumns({"comp": F.col("cls"), "left": F.lit(True)})
    first = stored(_confirm(alone, spec, False), "block-links")
    if large.isEmpty():
        return first
    parts = roots(first.join(large.select(F.col("cls").alias("a")), "a", "left_semi")).toDF("cls", "part")
    placed = large.join(parts, "cls", "left").withColumn("comp", F.coalesce("part", "cls")).drop("part")
    placed = stored(placed, "placed")
    sizes = placed.groupBy("root", "comp").agg(F.count("*").alias("n"))
    main = stored(sizes.groupBy("root").agg(F.max(F.struct("n", "comp")).alias("m")).select("root", F.col("m.comp").alias("main")), "largest-parts")
    rest = placed.join(main, "root").where("comp != main").drop("main")
    counted = rest.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"))
    more = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    counted = stored(counted.select("root", more.alias("rests")), "rest-blocks")
    if counted.isEmpty():
        return first
    sides = rest.join(counted, "root").withColumns({"l": F.pmod(F.xxhash64("cls"), F.col("rests")).cast("int"), "left": F.lit(True)})
    sides = sides.withColumn("r", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    others = placed.join(counted, "root").withColumns({"r": F.col("own"), "left": F.lit(False)})
    others = others.withColumn("l", F.explode(F.sequence(F.lit(0), F.col("rests") - 1)))
    crossed = sides.unionByName(others).withColumn("cell", cell(2, F.col("root"), F.col("l"), F.col("r"))).drop("l", "r", "rests", "own")
    return stored(first.unionByName(_confirm(crossed, spec, True)), "links")


def minhash_duplicates(
    docs: DataFrame, spec: MinHash = MinHash(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document."""
    docs = numbered(docs.select(quoted(id_col), quoted(text_col), *([ROW] if ROW in docs.columns else [])))
    prints = signed(docs, spec, id_col, text_col)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row"))).alias("first")
    full = prints.where("size > 0").groupBy("digest").agg(first)
    classes = stored(full.select("digest", "first", F.col("first.row").alias("cls")), "classes")
    groups = candidate_groups(classes, prints)
    found = roots(links(groups, docs, spec, text_col))
    placed = classes.join(found, classes["cls"] == found["node"], "left").withColumn("root", F.coalesce("root", "cls"))
    placed = stored(placed.select("digest", "first", "root"), "class-components")
    heads = stored(placed.groupBy("root").agg(F.min("first").alias("head")), "heads")
    named = placed.join(heads, "root").select("digest", F.col("head.doc_id").alias("component_id"), F.lit(True).alias("met"))
    named = stored(named, "named")
    joined = prints.select("doc_id", "size", F.when(F.col("size") > 0, F.col("digest")).alias("digest")).join(named, "digest", "left")
    component = F.when(F.col("met"), F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select(
        "doc_id",
        F.col("size").alias("n_shingles"),
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )
