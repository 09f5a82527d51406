"""Session settings the jobs rely on, and the shared folder for stored stages."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "creditloom", master: str | None = None, **conf: str) -> SparkSession:
    """Create a session; cluster-sized settings stay with the cluster unless given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    builder = (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
        # Rows of 200 columns are normal here; at the default of 100 code generation would be off. Much
        # wider ones would exceed the size of a Java method and are better left to the interpreter.
        .config("spark.sql.codegen.maxFields", "240")
        # Wide matrices are thousands of expressions; recording a call site for each is slow.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """Hours and months are read off UTC clocks, whatever the session came with."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, for checkpoints and stored stages.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, stages go beside the tables, below
    the warehouse directory, which is shared as well.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages"
        spark.conf.set("spark.checkpoint.dir", named)
    # spark.checkpoint.dir is read at context start; a later value has to be handed over.
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
