"""Reproducible shuffle into shards: a Feistel permutation over global row numbers.

Rows are numbered by (id, size, checksum).  A keyed Feistel network over a * b >= n cells, with cycle walking back into
0..n-1, permutes the numbers; shard = permuted mod shards, slot = permuted div shards.  So shard counts differ by at most
one, slots have no gaps, the place of any row number is computed without data, and so is the row number of any place.

Defined results: a null text has no bytes and the checksum of the empty text; null ids come first; equal rows take
neighbouring numbers and so their own places; an empty table gives an empty result; extra columns are ignored.

Only (id, size, checksum) are shuffled, once, by range; the last range key tells equal rows apart, so no run of equal
ids can fill one task.  Numbers are a partition's offset plus the place inside it.  The offsets are one row per
partition.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kitescope.llm.common import store

ROUNDS = 6
#: The cells beyond n are fewer than sqrt(n) + 1.  For n up to 4096 a walk is shorter than this; beyond, longer ones
#: have a chance under (1 / 64) ** 64, and would raise an error.
WALK = 64
_PLACE_BITS = 33


def cells(n: int) -> tuple[int, int]:
    """(a, b) with a * b >= n and fewer than a cells to spare."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def _div(x: Column, by: int) -> Column:
    """Whole-number division; ``/`` would go through doubles."""
    return ((x - F.pmod(x, F.lit(by).cast("long"))) / by).cast("long")


def _forward(x: Column, a: int, b: int, seed: int) -> Column:
    return _network(x, list(range(ROUNDS)), a, b, seed, 1)


def _backward(x: Column, a: int, b: int, seed: int) -> Column:
    return _network(x, list(reversed(range(ROUNDS))), a, b, seed, -1)


def _network(x: Column, rounds: list[int], a: int, b: int, seed: int, sign: int) -> Column:
    """One pass over the halves (x div b, x mod b): rounds in turn move one half by a keyed hash of the other."""
    parts = F.struct(_div(x, b).alias("l"), F.pmod(x, F.lit(b).cast("long")).alias("r"))

    def one(p: Column, k: Column) -> Column:
        def noise(half: Column, modulus: int) -> Column:
            return F.pmod(F.xxhash64(F.lit(seed).cast("long"), k.cast("long"), half), F.lit(modulus).cast("long"))

        even = F.pmod(k, F.lit(2)) == 0
        return F.struct(
            F.when(even, F.pmod(p["l"] + sign * noise(p["r"], a), F.lit(a).cast("long"))).otherwise(p["l"]).alias("l"),
            F.when(even, p["r"]).otherwise(F.pmod(p["r"] + sign * noise(p["l"], b), F.lit(b).cast("long"))).alias("r"))

    return F.aggregate(F.array(*[F.lit(k) for k in rounds]), parts, one, lambda p: p["l"] * b + p["r"])


def _walk(number: Column, n: int, seed: int, network) -> Column:
    a, b = cells(n)
    first = network(number.cast("long"), a, b, seed)
    landed = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)), first, lambda x, _: F.when(x < n, x).otherwise(network(x, a, b, seed)))
    return F.when(landed < n, landed).otherwise(F.raise_error(F.lit("a cycle walk did not end")).cast("long"))


def permuted(number: Column, n: int, seed: int = 0) -> Column:
    """The permuted place of a row number in 0..n-1."""
    return _walk(number, n, seed, _forward)


def number_at(shard: Column, slot: Column, n: int, shards: int, seed: int = 0) -> Column:
    """The row number at a shard and slot."""
    return _walk(slot.cast("long") * shards + shard.cast("long"), n, seed, _backward)


def numbered(rows: DataFrame, keys: list[str], number: str = "row_number") -> tuple[DataFrame, int]:
    """``rows`` with their rank in the order of ``keys`` from 0, and how many rows there are.

    ``rows`` should be narrow: it is stored, dealt out by range and stored again.
    """
    tie, mark = "_tie", "_mark"
    first = store(rows.withColumn(tie, F.monotonically_increasing_id()), "rows")
    count = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ordered = first.repartitionByRange(int(count), *keys, tie).sortWithinPartitions(*keys, tie)
    ordered = store(ordered.withColumn(mark, F.monotonically_increasing_id()), "ordered")
    part = F.shiftright(F.col(mark), _PLACE_BITS)
    sizes = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()  # a row per partition
    offsets, total = [], 0
    for r in sizes:
        offsets.append((r["part"], total))
        total += r["n"]
    if not offsets:
        return ordered.drop(tie, mark).withColumn(number, F.lit(None).cast("long")), 0
    at = rows.sparkSession.createDataFrame(offsets, "part long, at long")
    out = ordered.withColumn("part", part).join(F.broadcast(at), "part")
    place = F.col(mark) - F.shiftleft(F.col("part"), _PLACE_BITS)
    return out.withColumn(number, F.col("at") + place).drop("part", "at", tie, mark), total


def assign(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, row_number, shard, slot."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    narrow = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"))
    rows, n = numbered(narrow, ["doc_id", "size", "text_crc32"])
    place = permuted(F.col("row_number"), n, seed) if n else F.lit(None).cast("long")
    out = rows.withColumn("place", place)
    return out.select(
        "doc_id", "size", "text_crc32", "row_number",
        F.pmod(F.col("place"), F.lit(shards).cast("long")).cast("int").alias("shard"),
        _div(F.col("place"), shards).alias("slot"))
