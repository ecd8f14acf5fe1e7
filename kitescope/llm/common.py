"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kitescope.session import scratch_path

#: ``\x20`` and ``\x09`` to ``\x0D``: what separates words where a contract says so.
BLANK_RUN = r"[ \t\n\x0B\f\r]+"
NOT_BLANK = r"[^ \t\n\x0B\f\r]"
#: What separates words of digits, a-z and characters beyond ASCII.
NOT_WORD_RUN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores added until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def store(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    The copy cuts lineage, survives lost executors and knows its size; later readers prune its columns.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, _UPPER, _UPPER.lower())


def split_words(text: Column, separators: str) -> Column:
    """The words of ``text`` in order; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def keep_where(df: DataFrame, condition: Column, columns: list[str]) -> DataFrame:
    """``columns`` of the rows that meet a condition on computed columns.

    A filter would be pushed below the projections that compute its columns, and repeat their work for every mention.  A row
    mark in the condition, whose value is not deterministic for the optimiser, keeps it above them.
    """
    mark = free_name(df, "mark")
    marked = df.withColumn(mark, F.monotonically_increasing_id())
    return marked.filter(condition & (F.col(mark) >= 0)).select(*[F.col(f"`{c}`") for c in columns])
