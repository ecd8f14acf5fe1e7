"""Token files compressed by Re-Pair grammars.

Documents go to shards by ranges of ids, in ascending order, and a shard is cut into blocks of whole documents.  In a
block, frequent pairs of neighbouring symbols are replaced by new symbols until no pair is frequent; a pair never crosses
a document's end.  A stored block has its documents and where each ends in the compressed sequence, the rules (two symbols
each), the length every new symbol expands to, and the sequence in 16 or 32 bits.  So any document, or any position in it,
is decoded from its own part of the sequence.

Pairs are counted exactly.  A round replaces every pair that occurs LEAST times or more, the more frequent first where two
overlap.  Pairs of symbols that were there before cannot become frequent again, so the next round counts the neighbours of
the new symbols only, and all rounds together touch each position a few times.

Defined results: a null or empty text is its end id alone; equal ids keep an order of their own and equal rows are each
written; null ids come first; an empty table gives an empty result; extra columns are ignored.  A block holds at least one
document and about BLOCK_IDS ids; a longer document is a block of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kitescope.llm.common import store
from kitescope.llm.tokens import Encoder

BLOCK_IDS = 1 << 18
END_ID = 2
LEAST = 24
_NONE = np.iinfo(np.int32).max
_FORMAT = ("shard long, block long, first long, n_ids long, base long, doc_ids array<long>, ends array<long>, counts array<long>, "
           "rules binary, levels array<long>, lengths binary, width int, sequence binary")


def _frequent(code: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, rank): pairs that occur ``least`` times or more, most frequent first, and the rank of each place, _NONE elsewhere.

    A hash cell settles one of its pairs, with all its places; the places of its other pairs are hashed again in another way.
    """
    pairs, counts, places, numbers, total, factor = [], [], [], [], 0, 0x9E3779B97F4A7C15
    size, left = len(code), np.arange(len(code))
    while len(left):
        bits = max(8, len(left).bit_length() - 2)
        cell = ((code * np.uint64(factor)) >> np.uint64(64 - bits)).view(np.int64)
        # A cell holds at least as many places as each of its pairs.
        full = np.flatnonzero(np.bincount(cell, minlength=1 << bits)[cell] >= least)
        left, code, cell = left[full], code[full], cell[full]
        kept = np.zeros(1 << bits, dtype=np.uint64)
        kept[cell] = code
        mine = kept[cell] == code
        own = cell[mine]
        n = np.bincount(own, minlength=1 << bits)
        good = np.flatnonzero(n >= least)
        number = np.full(1 << bits, -1)
        number[good] = np.arange(total, total + len(good))
        of_each = number[own]
        pairs.append(kept[good])
        counts.append(n[good])
        places.append(left[mine][of_each >= 0])
        numbers.append(of_each[of_each >= 0])
        left, code = left[~mine], code[~mine]
        total, factor = total + len(good), factor * 0xD6E8FEB86659FD93 % (1 << 64)
    rank = np.full(size, _NONE, dtype=np.int32)
    if not total:
        return np.empty(0, np.uint64), rank
    order = np.argsort(-np.concatenate(counts), kind="stable")
    by_number = np.empty(total, dtype=np.int32)
    by_number[order] = np.arange(total)
    rank[np.concatenate(places)] = by_number[np.concatenate(numbers)]
    return np.concatenate(pairs)[order], rank


def compress(ids: np.ndarray, ends: np.ndarray, least: int = LEAST):
    """(base, rules, levels, sequence, ends): ``ends`` are exclusive ends of documents, ``levels`` rules per round."""
    n = len(ids)
    base = int(ids.max()) + 1 if n else 0
    # Positions keep their numbers; replaced ones are skipped by the links.  Number n stands for none.
    seq = np.zeros(n + 1, dtype=np.uint32)
    seq[:n] = ids
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    after[n] = before[0] = n
    after[ends - 1] = n
    before[ends] = n
    stay = np.ones(n, dtype=bool)
    mark = np.full(n + 1, _NONE, dtype=np.int32)
    top, rules, levels = base, [], []
    fresh = np.flatnonzero(after[:n] < n)
    while len(fresh):
        pairs, rank = _frequent((seq[fresh].astype(np.uint64) << np.uint64(32)) | seq[after[fresh]], least)
        at = fresh[rank != _NONE]
        mark[at] = rank[rank != _NONE]
        new, new_rank = [], []
        while len(at):
            own = mark[at]
            # In a run of one pair that overlaps itself only even places are replaced.
            begins = np.concatenate(([True], (after[at[:-1]] != at[1:]) | (own[:-1] != own[1:])))
            place = np.arange(len(at))
            place -= np.maximum.accumulate(np.where(begins, place, 0))
            pick = (place % 2 == 0) & (own <= mark[before[at]]) & (own <= mark[after[at]])
            p = at[pick]
            second = after[p]
            new.append(p)
            new_rank.append(own[pick])
            mark[before[p]] = mark[p] = mark[second] = _NONE
            after[p] = after[second]
            before[after[p]] = p
            stay[second] = False
            at = at[mark[at] != _NONE]
        if not new:
            break
        p, used = np.concatenate(new), np.concatenate(new_rank)
        numbers = np.cumsum(np.bincount(used, minlength=len(pairs)) > 0)
        seq[p] = top + numbers[used] - 1
        used = np.flatnonzero(np.diff(numbers, prepend=0))
        rules.append(np.stack([(pairs[used] >> np.uint64(32)).astype(np.uint32), pairs[used].astype(np.uint32)], axis=1))
        levels.append(len(used))
        top += len(used)
        near = np.zeros(n + 1, dtype=bool)
        near[p] = near[before[p]] = True
        fresh = np.flatnonzero(near[:n])
        fresh = fresh[after[fresh] < n]
    gone = np.concatenate(([0], np.cumsum(~stay)))
    return base, np.concatenate(rules) if rules else np.empty((0, 2), np.uint32), levels, seq[:n][stay], ends - gone[ends]


def expansion_lengths(base: int, rules: np.ndarray, levels: list[int]) -> np.ndarray:
    """How many ids each new symbol stands for."""
    out, done = np.zeros(len(rules), dtype=np.uint32), 0
    for n in levels:
        part = rules[done:done + n]
        own = np.where(part >= base, out[np.maximum(part.astype(np.int64) - base, 0)], 1)
        out[done:done + n] = own.sum(axis=1)
        done += n
    return out


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of all ranges, one after the other."""
    lengths = lengths.astype(np.int64)
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))


def expand(seq: np.ndarray, base: int, rules: np.ndarray, levels: list[int]) -> np.ndarray:
    """The ids of a whole sequence: every rule is expanded once, from those before it, and then copied."""
    lengths = expansion_lengths(base, rules, levels).astype(np.int64)
    offsets = np.cumsum(lengths) - lengths
    flat = np.empty(int(lengths.sum()), dtype=np.uint32)

    def copy(symbols: np.ndarray, out: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        new = symbols >= base
        known = symbols[new].astype(np.int64) - base
        own = np.ones(len(symbols), dtype=np.int64)
        own[new] = lengths[known]
        if at is None:
            at, out = np.cumsum(own) - own, np.empty(int(own.sum()), dtype=np.uint32)
        out[at[~new]] = symbols[~new]
        out[_ranges(at[new], own[new])] = flat[_ranges(offsets[known], own[new])]
        return out, at + own

    done = 0
    for n in levels:
        at = offsets[done:done + n]
        for side in (0, 1):
            _, at = copy(rules[done:done + n, side], flat, at)
        done += n
    return copy(seq.astype(np.uint32), flat)[0]


def slice_of(seq: np.ndarray, base: int, rules: np.ndarray, lengths: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Ids start..stop of a sequence: expansion lengths find the symbols, and only those are expanded."""
    own = np.ones(len(seq), dtype=np.int64)
    new = seq >= base
    own[new] = lengths[seq[new].astype(np.int64) - base]
    ends = np.cumsum(own)
    start, stop = max(start, 0), min(stop, int(ends[-1]) if len(ends) else 0)
    if stop <= start:
        return np.empty(0, dtype=np.uint32)
    a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
    begin, part = int(ends[a] - own[a]), seq[a:b].astype(np.uint32)
    while (new := part >= base).any():
        at = np.arange(len(part)) + np.concatenate(([0], np.cumsum(new)[:-1]))
        out = np.empty(len(part) + int(new.sum()), dtype=np.uint32)
        pair = rules[part[new] - base]
        out[at[~new]] = part[~new]
        out[at[new]], out[at[new] + 1] = pair[:, 0], pair[:, 1]
        part = out
    return part[start - begin:stop - begin]


def write(docs: DataFrame, tokenizer: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """The stored blocks of all documents, in ascending order of ids."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = Encoder.of(tokenizer), TaskContext.get().partitionId()
        names, parts, size, block, first = [], [], 0, 0, 0

        def done():
            ids = np.frombuffer(b"".join(parts), "<u4")
            counts = np.array([len(x) // 4 for x in parts], dtype=np.int64)
            base, rules, levels, seq, ends = compress(ids, np.cumsum(counts))
            width = 2 if base + len(rules) <= 1 << 16 else 4
            row = (shard, block, first, len(ids), base, names, ends, counts, rules.astype("<u4").tobytes(), levels,
                   expansion_lengths(base, rules, levels).astype("<u4").tobytes(), width, seq.astype(f"<u{width}").tobytes())
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] * 3 + [pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], [x.split()[0] for x in _FORMAT.split(", ")])

        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                for name, raw in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist())):
                    names.append(name)
                    parts.append(raw + end)
                    size += len(parts[-1]) // 4
                    if size >= block_ids:
                        yield done()
                        names, parts, block, first, size = [], [], block + 1, first + size, 0
        if parts:
            yield done()

    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.monotonically_increasing_id().alias("tie"))
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = texts.repartitionByRange(shards, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return store(ordered.mapInArrow(run, _FORMAT), "repair")


def read(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rules = np.frombuffer(row["rules"], "<u4").reshape(-1, 2)
                seq = np.frombuffer(row["sequence"], f"<u{row['width']}")
                raw = expand(seq, row["base"], rules, row["levels"]).astype("<u4").tobytes()
                stops = np.cumsum(row["counts"])
                starts = stops - row["counts"]
                crcs = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(starts.tolist(), stops.tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["shard"]] * len(crcs), pa.int64()), pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["first"], pa.int64()),
                    pa.array(row["counts"], pa.int64()), pa.array(crcs, pa.int64())], ["shard", "doc_id", "start", "n_tokens", "ids_crc32"])

    docs = blocks.mapInArrow(run, "shard long, doc_id long, start long, n_tokens long, ids_crc32 long")
    sizes = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()  # a row per shard
    offsets, total = [], 0
    for r in sizes:
        offsets.append((r["shard"], total))
        total += r["n"]
    at = blocks.sparkSession.createDataFrame(offsets, "shard long, at long")
    return docs.join(F.broadcast(at), "shard").select("doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def read_slices(blocks: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, from, to, ids): ids from..to of documents, decoded from their own parts of the sequences.

    ``wanted`` has doc_id, from and to (exclusive); bounds beyond a document are cut to it, a null bound means its begin or
    end, unknown documents give no row, and rows with equal ids give one row each.  A wanted row carries its document's part
    of the sequence and the block's rules, and nothing else of the block.
    """
    index = blocks.select("shard", "block", "width", F.posexplode(F.arrays_zip("doc_ids", "ends", "counts")).alias("i", "doc"), "ends").select(
        "shard", "block", F.col("doc.doc_ids").alias("doc_id"), F.col("doc.counts").alias("n"),
        F.when(F.col("i") > 0, F.col("ends")[F.greatest(F.col("i") - 1, F.lit(0))]).otherwise(F.lit(0)).alias("begin"), F.col("doc.ends").alias("end"))
    asked = wanted.select("doc_id", "from", "to").join(index, "doc_id")
    width = F.col("width")
    rows = asked.join(blocks.select("shard", "block", "base", "rules", "lengths", "width", "sequence"), ["shard", "block"]).select(
        "doc_id", "from", "to", F.coalesce("from", F.lit(0)).cast("long").alias("a"), F.coalesce("to", "n").cast("long").alias("b"),
        "base", "rules", "lengths", "width",
        F.substring("sequence", (F.col("begin") * width + 1).cast("int"), ((F.col("end") - F.col("begin")) * width).cast("int")).alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                slice_of(np.frombuffer(r["part"], f"<u{r['width']}"), r["base"], np.frombuffer(r["rules"], "<u4").reshape(-1, 2),
                         np.frombuffer(r["lengths"], "<u4"), r["a"], r["b"]).tolist()
                for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.list_(pa.int64()))], ["doc_id", "from", "to", "ids"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"doc_id bigint, `from` {kinds['from']}, `to` {kinds['to']}, ids array<bigint>")
