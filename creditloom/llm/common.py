"""What the operators share: reading, stored stages and row numbers."""

from __future__ import annotations

import os
from functools import lru_cache
from pathlib import Path

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.session import fresh_path

#: The six characters that separate words in the contracts.
SPACES = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Workers import this package. On a cluster it is installed or shipped; else it is where the driver has it.
    home, known = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment.get("PYTHONPATH", "")
    if home not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [home, known]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a stage to the shared folder and read it back: lineage ends there, and lost executors cost nothing."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made._creditloom_path = path
    return made


def bucketed(df: DataFrame, name: str, by: str, buckets: int) -> DataFrame:
    """As ``stored``, in buckets by a column: grouping by it moves nothing of these rows later."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    table = f"creditloom_{path.rpartition('/')[2].replace('-', '_')}"
    df.write.format("parquet").bucketBy(buckets, by).option("path", path).saveAsTable(table)
    made = spark.table(table)
    made._creditloom_path, made._creditloom_table = path, table
    return made


def released(result: DataFrame, *stages: DataFrame) -> DataFrame:
    """A stored result, once the stages that it was made from have been removed. Only what ``stored`` or ``bucketed`` wrote is."""
    if not hasattr(result, "_creditloom_path"):
        raise ValueError("stages are needed until their result is stored")
    context = result.sparkSession.sparkContext
    for stage in stages:
        if hasattr(stage, "_creditloom_table"):
            result.sparkSession.sql(f"DROP TABLE IF EXISTS {stage._creditloom_table}")
        path = context._jvm.org.apache.hadoop.fs.Path(stage._creditloom_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    return result


#: The column that numbers the rows of a stored table.
ROW = "creditloom_row"
#: Bits of a row's place in its file.
PLACE_BITS = 40


def numbered(docs: DataFrame, name: str = "numbered") -> DataFrame:
    """The documents with a number of each row that is written with them; stored, unless they bring it.

    Numbers that are made while reading change with the splits, so every later join reads the written ones.
    """
    if ROW in docs.columns:
        return docs
    return stored(docs.withColumn(ROW, F.monotonically_increasing_id()), name)


def positioned(docs: DataFrame) -> DataFrame:
    """A table as it was read from Parquet files, with a number of each row, which is its file's and its place in that file.

    The place does not change with the splits, so nothing is stored. What reaches the driver is a row per file. Tables that bring
    numbers keep them; other frames than a table's are ``numbered``. A join or a generator may repeat places: number before them.
    """
    if ROW in docs.columns:
        return docs
    try:
        placed = docs.select("*", F.col("_metadata.file_path").alias(f"{ROW}_file"), F.col("_metadata.row_index").alias(f"{ROW}_place"))
    except AnalysisException:
        return numbered(docs)
    names = sorted(r[0] for r in placed.select(f"{ROW}_file").distinct().collect())
    files = docs.sparkSession.createDataFrame(list(zip(names, range(len(names)))), f"{ROW}_file string, {ROW}_number long")
    row = F.shiftleft(f"{ROW}_number", PLACE_BITS).bitwiseOR(F.col(f"{ROW}_place"))
    return placed.join(F.broadcast(files), f"{ROW}_file").select(*(quoted(c) for c in docs.columns), row.alias(ROW))


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name the input does not have, whatever columns it brings."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


@lru_cache(maxsize=8)
def vocabulary_path(name_or_path: str) -> str:
    """A file given by path, or one of the installed public vocabularies by name."""
    return name_or_path if "/" in name_or_path else str(public_tokenizers.path(name_or_path))


class Memo(dict):
    """A dict that a Python worker keeps between batches; it empties itself when full, so memory is bounded."""

    def __init__(self, entries: int):
        super().__init__()
        self.entries = entries

    def room(self, more: int = 1) -> None:
        if len(self) + more > self.entries:
            self.clear()


class Generations(dict):
    """A dict that a Python worker keeps between batches, in two generations: what was used since the last turn, and before it.

    ``turn`` is called between batches and drops the older generation once the younger is full, so entries in use stay.
    """

    def __init__(self, entries: int):
        super().__init__()
        self.entries, self.older = entries, {}

    def __missing__(self, key):
        value = self[key] = self.older[key]
        return value

    def known(self, key) -> bool:
        return key in self or key in self.older

    def turn(self) -> None:
        if len(self) > self.entries // 2:
            self.older = dict(self)
            self.clear()
