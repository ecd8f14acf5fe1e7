"""Session construction and lineage cutting."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "kitescope", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; ``master`` is left to spark-submit when not given."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The reliable folder for checkpoints and intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``.  Only a local session without that setting
    falls back to a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    already_set = spark.sparkContext.getCheckpointDir()
    if already_set:
        return os.path.dirname(already_set.rstrip("/"))
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    root = tempfile.mkdtemp(prefix="spark-kitescope-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder so that a lost executor costs no rerun."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(checkpoint_root(spark))
    return df.checkpoint(eager=True)


#: Session setting of Spark: shuffle files go when the query that made them ends, not when the driver's memory is cleaned.
LET_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_let_go(spark: SparkSession) -> Iterator[None]:
    """For writes: what is written stands for itself, so nothing reads their shuffle files again."""
    before = spark.conf.get(LET_GO, "false")
    spark.conf.set(LET_GO, "true")
    try:
        yield
    finally:
        spark.conf.set(LET_GO, before)


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once next to the checkpoints, as compressed columns: for tables as large as the input."""
    path = scratch_path(df.sparkSession, name)
    with shuffles_let_go(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder name next to the checkpoints, for round trips through files."""
    import uuid

    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
