"""Exact duplicates over immutable snapshots and new batches.

Documents come in batches. Each batch is grouped by itself, by the SHA-256 of its texts without white space. What came
before is an immutable snapshot: exact buckets (one row per digest) and, per shard of the digests, a
static binary fuse filter. The filters screen the new batch's digests; only positives join the exact buckets,
where the bytes of the two representatives are compared. Equal digests of unequal bytes stay apart.

Groups combine before the shuffle, so a text with a third of all rows is one row per task. The one join that
meets hot digests, of documents with their groups, reads stored sides, so Spark can split it.

Null texts count as empty, and empty texts equal each other. Of a group, the row with the most code points stays,
then the smallest id (a null id comes last), then the first row; of repeated rows exactly one stays.
Other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.llm import fuse_filter
from creditloom.llm.common import ROW, numbered, quoted, stored

#: Filters hold about this many digests each, so that one task builds and probes one in little memory.
SHARD_KEYS = 500_000
LEAST_SHARDS = 16


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", "")


def digest_table(docs: DataFrame, batches: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, batch, digest, points, of every document; stored, so that texts are hashed once.

    ``docs`` is a numbered table; ``row`` is its stored number.
    """
    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    table = docs.select(
        F.col(ROW).alias("row"),
        quoted(id_col).alias("doc_id"),
        F.unhex(F.sha2(normalised(quoted(text_col)), 256)).alias("digest"),
        F.length(text).alias("points"),
    )
    return stored(table.withColumn("batch", F.pmod(F.xxhash64("doc_id", "row"), F.lit(batches)).cast("int")), "digests")


def buckets(digests: DataFrame) -> DataFrame:
    """Groups of equal digests within each batch: size and the best row."""
    # Larger is better; a null id is smaller than any.
    order = F.struct("points", (-F.col("doc_id").cast("decimal(38,0)")).alias("id"), (-F.col("row")).alias("row"))
    best = F.max(F.struct(order.alias("order"), F.col("doc_id"), F.col("row")))
    return stored(digests.groupBy("batch", "digest").agg(F.count("*").alias("size"), best.alias("best")), "buckets")


def _key(digest: Column) -> Column:
    """The digest's first eight bytes as a signed number."""
    return F.conv(F.hex(F.substring(digest, 1, 8)), 16, -10).cast("long")


def _sharded(groups: DataFrame, shards: int) -> DataFrame:
    keyed = groups.select("digest", _key(F.col("digest")).alias("key"))
    return keyed.withColumn("shard", F.pmod(F.col("key"), F.lit(shards)).cast("int"))


def snapshot_filters(snapshot: DataFrame, shards: int) -> DataFrame:
    """shard, filter: one static filter per shard of the snapshot's digests."""

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": [key[0]], "filter": [fuse_filter.build(rows["key"].to_numpy(np.int64))]})

    made = _sharded(snapshot, shards).select("shard", "key").groupBy("shard")
    return made.applyInPandas(build, "shard int, filter binary")


def screen(incoming: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """The incoming digests that a snapshot's filters may hold; no digest that it does hold is lost."""

    def probe(rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        data = bytes(held["filter"].iloc[0]) if len(held) else b""
        return rows.loc[fuse_filter.may_contain(data, rows["key"].to_numpy(np.int64)), ["digest"]]

    sides = _sharded(incoming, shards).groupBy("shard").cogroup(filters.groupBy("shard"))
    return sides.applyInPandas(probe, "digest binary")


def same_bytes(pairs: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Of (digest, row, row) pairs, the digests whose two rows have the same bytes."""
    rows = pairs.select("digest", F.explode(F.array("row_a", "row_b")).alias("row"))
    texts = docs.select(F.col(ROW).alias("row"), normalised(quoted(text_col)).alias("bytes"))
    both = rows.join(texts, "row").groupBy("digest").agg(F.min("bytes").alias("low"), F.max("bytes").alias("high"))
    return both.where(F.col("low") == F.col("high")).select("digest")


def groups(
    docs: DataFrame, digests: DataFrame, batches: int = 2, text_col: str = "text"
) -> DataFrame:
    """batch, digest, keep_id, keep_row, group_size: which row stands for a batch's digest over all batches."""
    found = buckets(digests)
    shards = max(LEAST_SHARDS, -(-found.count() // SHARD_KEYS))
    # Batch 0 is the first snapshot. Each later batch is joined to what has been settled before it.
    settled = found.where("batch = 0").withColumn("part", F.lit(0))
    for batch in range(1, batches):
        snapshot = settled.groupBy("digest").agg(F.min(F.struct("part", "batch", "best")).alias("first"))
        incoming = found.where(F.col("batch") == batch)
        positive = screen(incoming, snapshot_filters(snapshot, shards), shards)
        pairs = (
            positive.join(incoming, "digest")
            .join(snapshot, "digest")
            .select("digest", F.col("first.best.row").alias("row_a"), F.col("best.row").alias("row_b"))
        )
        equal = same_bytes(pairs, docs, text_col).join(snapshot, "digest")
        equal = stored(equal.select("digest", F.col("first.part").alias("known")), "equal")
        joined = incoming.join(equal, "digest", "left")
        part = F.coalesce("known", F.lit(batch)).alias("part")
        settled = stored(settled.unionByName(joined.select(*found.columns, part)), "settled")
    whole = settled.groupBy("digest", "part").agg(F.sum("size").alias("group_size"), F.max("best").alias("keep"))
    keep = (F.col("keep.doc_id").alias("keep_id"), F.col("keep.row").alias("keep_row"), "group_size")
    return stored(settled.select("batch", "digest", "part").join(whole, ["digest", "part"]).select("batch", "digest", *keep), "groups")


def exact_duplicates(docs: DataFrame, batches: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every document."""
    docs = numbered(docs.select(quoted(id_col), quoted(text_col), *([ROW] if ROW in docs.columns else [])))
    digests = digest_table(docs, batches, id_col, text_col)
    joined = digests.join(groups(docs, digests, batches, text_col), ["batch", "digest"])
    return joined.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, batches: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns."""
    docs = numbered(docs)
    digests = digest_table(docs, batches, id_col, text_col)
    return keep_rows(docs, groups(docs, digests, batches, text_col).select("keep_row"))


def keep_rows(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of a numbered table whose numbers are listed in ``keep_row``, without the number."""
    return docs.join(rows.select(F.col("keep_row").alias(ROW)), ROW, "left_semi").drop(ROW)
