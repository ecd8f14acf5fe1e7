"""Best-fit packing of token sequences, improved by a swap-based local search.

Documents become ids plus an end id; only a document longer than a sequence is cut, its first piece takes the remainder.
Pieces are dealt to parts of bounded size.  A part is packed best fit decreasing; then its underfull bins are improved:
moves, one-for-one and two-for-one exchanges, each of which increases the sum of squared fills, go on among all of them
until none helps or no fewer bins could hold the tokens.  Bins that stay underfull are opened again and packed together in fewer parts, until one
part is left or a round leaves more than half of its tokens in such bins.

Defined results: a null or empty text is its end id alone; repeated rows and null ids are pieces like others; an empty
table gives an empty result; extra columns are ignored.  Only lengths and checksums are shuffled, never ids.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kitescope.llm.common import store
from kitescope.llm.tokens import Encoder

CAPACITY = 2048
END_ID = 0
#: Bounds of one part.
PART_TOKENS = 16 << 20
PART_ROWS = 50_000
#: A bin below this share of its capacity is packed again with others.
FULL_SHARE = 0.995

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the pieces of every document."""
    end = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                rows = []
                for doc_id, raw in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist())):
                    raw += end
                    n = len(raw) // 4
                    first = n % capacity or capacity
                    bounds = [0, *range(first, n + 1, capacity)]
                    for i, (x, y) in enumerate(zip(bounds, bounds[1:])):
                        rows.append((doc_id, i, x, y - x, zlib.crc32(raw[4 * x:4 * y])))
                doc, piece, start, length, crc = zip(*rows)
                yield pa.RecordBatch.from_arrays([
                    pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(cut, _PIECES)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of positions, by best fit decreasing; bins wait in one stack per free space."""
    bins: list[list[int]] = []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    # Bit f is set when a bin has f tokens free, so the tightest bin is one shift and one lowest bit away.
    waiting = 0
    for i in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        n = lengths[i]
        fits = waiting >> n
        if fits:
            space = n + (fits & -fits).bit_length() - 1
            b = free[space].pop()
            if not free[space]:
                waiting &= ~(1 << space)
            bins[b].append(i)
        else:
            space, b = capacity, len(bins)
            bins.append([i])
        if space > n:
            free[space - n].append(b)
            waiting |= 1 << (space - n)
    return bins


def improve(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Local search over all underfull bins; every step moves tokens from an emptier to a bin at least as full.

    Bins give from the emptiest to the fullest, each by its best step until it is empty or has none.  Passes take equally full
    bins in one order and in the other, and go on until two change nothing or no fewer bins could hold the tokens.
    """
    bins = [b for b in bins if b]
    fill = [sum(lengths[i] for i in b) for b in bins]
    spare = len(bins) - math.ceil(sum(fill) / capacity)
    unchanged = 0
    while unchanged < 2 and spare > 0:
        unchanged += 1
        takers = _Takers(bins, fill, lengths, capacity)
        while takers.members:
            # The bins that gave before are emptier (or gone) and take no more in this pass; neither does the donor itself.
            donor = takers.having(0)
            mine = takers.remove(donor)
            while fill[donor]:
                step = takers.best_step(mine)
                if step is None:
                    break
                give, back = step
                taker = takers.having(back)
                theirs = takers.remove(taker)
                for n in give:
                    theirs.setdefault(n, []).append(_taken(mine, n))
                if back:
                    mine.setdefault(back, []).append(_taken(theirs, back))
                gain = sum(give) - back
                fill[donor] -= gain
                fill[taker] += gain
                takers.add(taker, theirs)
                bins[taker] = [i for same in theirs.values() for i in same]
                unchanged = 0
            bins[donor] = [i for same in mine.values() for i in same]
            if not fill[donor]:
                spare -= 1
                if spare <= 0:
                    break
        bins.reverse()
        fill.reverse()
    return [b for b in bins if b]


def _taken(pieces: dict[int, list[int]], length: int) -> int:
    same = pieces[length]
    i = same.pop()
    if not same:
        del pieces[length]
    return i


class _Takers:
    """Underfull bins, found by piece length and free space; length 0 stands for every bin.

    ``reach[n]`` is n plus the most free space of a bin with a piece of length n: what may come in its place.
    """

    def __init__(self, bins: list[list[int]], fill: list[int], lengths: list[int], capacity: int):
        self.capacity, self.fill, self.n_bins = capacity, fill, len(bins)
        self.reach = np.zeros(capacity + 1, np.int64)
        self.heaps: dict[int, list[int]] = {}
        self.members: dict[int, dict[int, list[int]]] = {}
        for b, members in enumerate(bins):
            if 0 < fill[b] < capacity:
                pieces: dict[int, list[int]] = {}
                for i in members:
                    pieces.setdefault(lengths[i], []).append(i)
                self.members[b] = pieces
                for n in (0, *pieces):
                    self.heaps.setdefault(n, []).append(fill[b] * self.n_bins + b)
        for n, heap in self.heaps.items():
            heapq.heapify(heap)
            self._settle(n)

    def _settle(self, n: int) -> None:
        # Entries of bins that have gone, changed or lost the length are dropped when they come up.
        heap = self.heaps[n]
        while heap:
            fill, b = divmod(heap[0], self.n_bins)
            pieces = self.members.get(b)
            if pieces is not None and self.fill[b] == fill and (not n or n in pieces):
                self.reach[n] = n + self.capacity - fill
                return
            heapq.heappop(heap)
        self.reach[n] = 0

    def remove(self, b: int) -> dict[int, list[int]]:
        pieces = self.members.pop(b)
        for n in (0, *pieces):
            if self.heaps[n][0] % self.n_bins == b:
                self._settle(n)
        return pieces

    def add(self, b: int, pieces: dict[int, list[int]]) -> None:
        if self.fill[b] < self.capacity:
            self.members[b] = pieces
            for n in (0, *pieces):
                heapq.heappush(self.heaps.setdefault(n, []), self.fill[b] * self.n_bins + b)
                self._settle(n)

    def having(self, n: int) -> int:
        """The emptiest bin with a piece of this length."""
        return self.heaps[n][0] % self.n_bins

    def best_step(self, pieces: dict[int, list[int]]) -> tuple[tuple[int, ...], int] | None:
        """The step that moves most tokens: (lengths given, length taken back or 0); None if there is none."""
        kinds = sorted(pieces, reverse=True)
        give = [(n,) for n in kinds] + [
            (n, m) for k, n in enumerate(kinds) for m in kinds[k:] if n != m or len(pieces[n]) > 1]
        size = np.array([sum(g) for g in give])
        # The shortest length whose place the given pieces fit into; it must be shorter than they are.
        back = np.searchsorted(np.maximum.accumulate(self.reach), size)
        gain = np.where(back <= self.capacity, size - back, 0)
        k = int(gain.argmax())
        return (give[k], int(back[k])) if gain[k] > 0 else None


def _deal(rows: DataFrame, n: int, tokens: int) -> tuple[DataFrame, int]:
    parts = max(1, math.ceil(tokens / PART_TOKENS), math.ceil(n / PART_ROWS))
    # Rows are stored, so their numbers are the same when a lost task runs again; equal rows have different ones.
    return rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(parts)).cast("int")), parts


def _packer(number: int, capacity: int):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        lengths = pdf["length"].tolist()
        bins = improve(best_fit(lengths, capacity), lengths, capacity)
        sequence, offset, fill = (np.zeros(len(pdf), np.int64) for _ in range(3))
        base = (number << 56) | (int(pdf["part"].iloc[0]) << 32)
        for b, members in enumerate(bins):
            at = 0
            for i in members:
                sequence[i], offset[i] = base + b, at
                at += lengths[i]
            fill[members] = at
        return pdf.assign(sequence_id=sequence, offset=offset, fill=fill).drop(columns="part")

    return pack


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` rows with sequence_id and offset."""
    out, number, left, before = [], 0, rows, None
    schema = f"{_PIECES}, sequence_id long, offset long, fill long"
    while True:
        n, tokens = left.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        dealt, parts = _deal(left, n, tokens)
        packed = store(dealt.groupBy("part").applyInPandas(_packer(number, capacity), schema), "packed")
        if parts == 1 or (before is not None and 2 * tokens > before):
            out.append(packed)
            break
        full = F.col("fill") >= FULL_SHARE * capacity
        out.append(packed.filter(full))
        left = packed.filter(~full).drop("sequence_id", "offset", "fill")
        number, before = number + 1, tokens
    result = out[0]
    for more in out[1:]:
        result = result.union(more)
    return result.drop("fill")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    return pack(store(pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity)
