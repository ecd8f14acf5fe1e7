"""Document lengths from flat token files that have no index.

A token file is a stream of ids, each document followed by an end id, kept as fixed-size blocks (file, block, ids) with
16-bit or 32-bit little-endian ids; block borders fall anywhere.  The scan searches every block for end ids with one
vectorised comparison.  A block then knows how many documents end in it and where; sums and maxima over the blocks before
it (a prefix scan per file) give the number of its first document and where that began, possibly many blocks earlier.

Defined results: an empty document is its end id; ids after the last end id are a document that is not closed; an empty
file has no rows; a null or empty text writes its end id alone.  A block is the unit of memory, and a file may have any
number of them.  Repeated rows, null ids and extra columns change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kitescope.llm.common import store
from kitescope.llm.tokens import Encoder

BLOCK = 1 << 16
END_ID = 50256


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = END_ID, block: int = BLOCK, width: int = 2, id_col: str = "doc_id",
                 text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(blocks, order): one stored token file per input partition, and which document comes when in which file.

    ``order`` is only a list of names; it holds no positions and no lengths.
    """
    kind = np.dtype(f"<u{width}")
    end = np.array([end_id], kind).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, file = Encoder.of(tokenizer), TaskContext.get().partitionId()
        held, number, ordinal = bytearray(), 0, 0

        def rows(blocks, names, first):
            n, m = len(blocks), len(names)
            return pa.RecordBatch.from_arrays([
                pa.array([file] * (n + m), pa.int64()), pa.array([number + i for i in range(n)] + [None] * m, pa.int64()),
                pa.array(blocks + [None] * m, pa.binary()), pa.array([None] * n + [first + i for i in range(m)], pa.int64()),
                pa.array([None] * n + names, pa.int64())], ["file", "block", "ids", "ordinal", "doc_id"])

        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                for raw in encoder.encode(part.column(1).to_pylist()):
                    held += np.frombuffer(raw, "<u4").astype(kind).tobytes() + end
                full = len(held) // (block * width)
                blocks = [bytes(held[i * block * width:(i + 1) * block * width]) for i in range(full)]
                yield rows(blocks, part.column(0).to_pylist(), ordinal)
                del held[:full * block * width]
                number, ordinal = number + full, ordinal + part.num_rows
        if held:
            yield rows([bytes(held)], [], 0)

    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    both = store(texts.mapInArrow(run, "file long, block long, ids binary, ordinal long, doc_id long"), "tokens", "zstd")
    return both.filter("block IS NOT NULL").select("file", "block", "ids"), both.filter("block IS NULL").select("file", "ordinal", "doc_id")


def scan(blocks: DataFrame, end_id: int = END_ID, width: int = 2) -> DataFrame:
    """(file, ordinal, start, n_tokens, closed): n_tokens leaves the end id out."""
    kind = np.dtype(f"<u{width}")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(x or b"", kind) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column("file"), batch.column("block"), pa.array([len(x) for x in ids], pa.int64()),
                pa.array([np.flatnonzero(x == end_id) for x in ids], pa.list_(pa.int64()))], ["file", "block", "size", "ends"])

    found = blocks.select("file", "block", "ids").mapInArrow(search, "file long, block long, size long, ends array<long>")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = found.withColumn("base", F.coalesce(F.sum("size").over(before), F.lit(0)))
    placed = placed.withColumn("last", F.when(F.size("ends") > 0, F.col("base") + F.element_at("ends", -1)))
    placed = placed.select(
        "file", "block", "base", "size", "ends", F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).alias("first"),
        (F.coalesce(F.max("last").over(before), F.lit(-1)) + 1).alias("open"))
    ended = placed.select("file", "first", "base", "open", "ends", F.posexplode("ends").alias("k", "end"))
    start = F.when(F.col("k") == 0, F.col("open")).otherwise(F.col("base") + F.get("ends", F.col("k") - 1) + 1)
    closed = ended.select("file", (F.col("first") + F.col("k")).alias("ordinal"), start.alias("start"),
                          (F.col("base") + F.col("end") - start).alias("n_tokens"), F.lit(True).alias("closed"))
    whole = placed.groupBy("file").agg(
        F.max(F.col("base") + F.col("size")).alias("size"), F.sum(F.size("ends")).cast("long").alias("n"),
        F.max(F.when(F.size("ends") > 0, F.col("base") + F.element_at("ends", -1))).alias("last"))
    rest = F.col("size") - F.coalesce(F.col("last"), F.lit(-1)) - 1
    left = whole.filter(rest > 0).select("file", F.col("n").alias("ordinal"), (F.col("size") - rest).alias("start"), rest.alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.union(left)


def document_counts(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, file, ordinal, start, n_tokens) for every document, read from its token file."""
    blocks, order = write_tokens(docs, tokenizer, end_id)
    return scan(blocks, end_id).join(order, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens")
