"""From raw documents to packed training sequences, in five stored stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. ``docs`` is a stored table; the
result is written as Parquet and read again as the next stage's docs. All stages but the last return the columns
of ``documents``. Rows are known by their place in the table's files, so no stage stores a copy of the documents to number them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm.common import ROW, positioned, read, released, stored
from creditloom.llm.exact_dedup import drop_exact_duplicates
from creditloom.llm.language_model import drop_poor
from creditloom.llm.mixing import mix
from creditloom.llm.packing import packed_pieces
from creditloom.llm.simhash import drop_near_duplicates


#: Workers give large arrays back to the system when they free them: idle workers wait beside those of the next stage.
WORKERS = {"MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(8 << 20), "MALLOC_ARENA_MAX": "2"}


def lean(spark: SparkSession) -> SparkSession:
    """The session, with settings that keep stages small beside each other in an executor. Settings it has stay."""
    for key, value in WORKERS.items():
        spark.sparkContext.environment.setdefault(key, value)
    return spark


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity exceeds their language's limit go."""
    lean(spark)
    return drop_poor(positioned(docs), read(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    lean(spark)
    return drop_exact_duplicates(positioned(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near fingerprints stays: four-word shingles, at most four bits."""
    lean(spark)
    return drop_near_duplicates(positioned(docs), words=4, max_bits=4)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn at the rates that meet the domains' target weights."""
    lean(spark)
    return mix(positioned(docs), read(spark, sf_dir, "labels"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4,096 tokens, one row per piece."""
    lean(spark)
    return packed_pieces(docs)


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixture", mixture),
    ("packing", packing),
]

#: SQL can express neither the language model nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        # Each stage's output is numbered where it is written, and the one it was made from goes.
        docs = released(stored(stage(spark, docs, sf_dir).withColumn(ROW, F.monotonically_increasing_id()), name), *before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
