"""Removal of repeated byte strings with suffix arrays by induced sorting.

A byte goes if a string of ``LENGTH`` bytes covers it that also starts earlier: in a smaller id, or earlier in the same text.

1. Every string of LENGTH bytes is named by the smallest hash among the GRAM-byte grams inside it (leftmost on ties), which
   depends on the string alone.  Neighbouring starts with the same gram form a slice; equal strings lie in slices of the
   same gram, whatever their texts.  A gram that only one slice has is done with.
2. Slices that equal an earlier slice of their gram are repeated from start to end.  Where a gram has several different
   slices, the earliest of each goes on with its bytes.
3. Shards of whole grams become one byte string each, in the order of (id, start).  Its suffix array comes from induced
   sorting: suffixes are classified, leftmost-smaller (LMS) substrings are named and their reduced string is sorted by
   doubling ranks until LENGTH bytes are told apart, and all other suffixes are induced from them bucket by bucket.
   Common prefixes are compared in text order with the array's predecessor (permuted), as far as LENGTH; runs of LENGTH or
   more are equal strings, and all but the first in the text are repeated.
4. Grams with very many different slices would not fit a shard; their strings are compared one by one through two 64-bit
   hashes and a minimum.

Defined results: a null or empty text has no bytes; rows with the same id and text are one place, and neither is earlier;
null ids come before all; an empty table gives an empty result; extra columns are ignored.  Long texts are cut to pieces
for hashing; a slice cut there is compared like any other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kitescope.llm.common import store

LENGTH = 100
GRAM = 32
#: Bytes of slices in one suffix array, and how many different slices a gram may have to go there.
SHARD_BYTES = 4 << 20
HOT = 20_000
_PIECE = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POSITION_BITS = 24


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


class _Powers:
    size = 0

    @classmethod
    def upto(cls, n: int):
        if n > cls.size:
            cls.size = n
            up, down = np.full(n, _BASE), np.full(n, np.uint64(pow(int(_BASE), -1, 1 << 64)))
            up[0] = down[0] = 1
            cls.up, cls.down = np.cumprod(up), np.cumprod(down)
        return cls.up[:n], cls.down[:n]


class Hashes:
    """Hashes of any substrings of a piece, from prefix sums of a polynomial modulo 2 ** 64."""

    def __init__(self, raw: np.ndarray):
        up, self.down = _Powers.upto(len(raw) + 1)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * up[:-1])))

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mix((self.sums[stop] - self.sums[start]) * self.down[start] + (stop - start).astype(np.uint64))


def slices(raw: np.ndarray, owner_ends: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(gram hash, first start, starts, slice hash) of all slices in a piece of joined texts that end at ``owner_ends``."""
    n, width = len(raw), length - gram + 1
    none = np.empty(0, np.int64)
    if n < length:
        return np.empty(0, np.uint64), none, none, np.empty(0, np.uint64)
    hashes = Hashes(raw)
    at = np.arange(n - gram + 1)
    value = hashes.of(at, at + gram)
    key = (value >> np.uint64(_POSITION_BITS) << np.uint64(_POSITION_BITS)) | at.astype(np.uint64)
    # The least key of every window: doubling, then two overlapping windows of a power of two.
    span = 1
    while 2 * span <= width:
        key, span = np.minimum(key[:-span], key[span:]), 2 * span
    if width > span:
        key = np.minimum(key[:-(width - span)], key[width - span:])
    anchor = (key & np.uint64((1 << _POSITION_BITS) - 1)).astype(np.int64)
    start = np.arange(len(anchor))
    owner = np.searchsorted(owner_ends, start, side="right")
    valid = start + length <= owner_ends[owner]
    start, anchor = start[valid], anchor[valid]
    if not len(start):
        return np.empty(0, np.uint64), none, none, np.empty(0, np.uint64)
    # A gram lies in one text, so a run of one gram does too.
    first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    starts = np.diff(np.concatenate((first, [len(start)])))
    s1 = start[first]
    return value[anchor[first]], s1, starts, hashes.of(s1, s1 + starts + length - 1)


def _bytes(texts: pa.Array) -> list[bytes]:
    return [x if x is not None else b"" for x in texts.cast(pa.binary()).to_pylist()]


def _slice_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(held, names):
        raw = np.frombuffer(b"".join(x for x, _ in held), np.uint8)
        ends = np.cumsum([len(x) for x, _ in held])
        h, s1, starts, whole = slices(raw, ends)
        k = np.searchsorted(ends, s1, side="right")
        begins = ends - np.array([len(x) for x, _ in held])
        place = np.array([at for _, at in held], dtype=np.int64)
        docs, marks = zip(*names)
        return pa.RecordBatch.from_arrays([
            pa.array(h.view(np.int64)), pa.array(docs, pa.int64()).take(pa.array(k)), pa.array(marks, pa.int64()).take(pa.array(k)),
            pa.array((s1 - begins[k] + place[k]).astype(np.int32)), pa.array(starts.astype(np.int32)), pa.array(whole.view(np.int64))],
            ["h", "doc_id", "mark", "s", "n", "sh"])

    for batch in batches:
        held, names, size = [], [], 0
        for doc_id, mark, text in zip(batch.column("doc_id").to_pylist(), batch.column("mark").to_pylist(), _bytes(batch.column("text"))):
            for a in range(0, max(len(text) - LENGTH + 1, 0), _PIECE):
                held.append((text[a:a + _PIECE + LENGTH - 1], a))
                names.append((doc_id, mark))
                size += len(held[-1][0])
                if size >= _PIECE:
                    yield out(held, names)
                    held, names, size = [], [], 0
        if held:
            yield out(held, names)


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (S); the last suffix is S by the sentinel behind it."""
    n = len(t)
    differs = np.concatenate((t[1:] != t[:-1], [True]))
    following = np.minimum.accumulate(np.where(differs, np.arange(n), n)[::-1])[::-1]
    return np.where(following == n - 1, False, t[following] < t[np.minimum(following + 1, n - 1)])


def suffix_array(t: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Suffixes of the bytes ``t`` in order of their first ``depth`` bytes at least; the end sorts before any byte."""
    n = len(t)
    if n < 2:
        return np.arange(n)
    smaller = _types(t)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    order = _sorted_lms(t, lms, depth)
    counts = np.bincount(t, minlength=256)
    ends = np.cumsum(counts)
    heads = ends - counts
    # L suffixes, from the buckets' heads; seeds are LMS suffixes, which stand behind the L suffixes of their bucket.
    seeds = lms[order]
    seed_at = np.searchsorted(t[seeds], np.arange(257))
    large: list[np.ndarray] = []
    pending: list[list[np.ndarray]] = [[] for _ in range(256)]
    if not smaller[n - 1]:
        pending[t[n - 1]].append(np.array([n - 1]))  # induced by the end

    def spread(found: np.ndarray, want_small: bool) -> tuple[np.ndarray, np.ndarray]:
        before = found[found > 0] - 1
        before = before[smaller[before] == want_small]
        return before, t[before]

    for c in range(256):
        own, wave = [], np.concatenate(pending[c]) if pending[c] else np.empty(0, np.int64)
        while len(wave):
            own.append(wave)
            before, first = spread(wave, False)
            for d in np.unique(first):
                if d != c:
                    pending[d].append(before[first == d])
            wave = before[first == c]
        large.append(np.concatenate(own) if own else np.empty(0, np.int64))
        before, first = spread(seeds[seed_at[c]:seed_at[c + 1]], False)
        for d in np.unique(first):
            pending[d].append(before[first == d])
    # S suffixes, from the buckets' tails; lists grow from the largest suffix down.
    pending = [[] for _ in range(256)]
    out = [np.empty(0, np.int64)] * 256
    for c in range(255, -1, -1):
        own, wave = [], np.concatenate(pending[c]) if pending[c] else np.empty(0, np.int64)
        while len(wave):
            own.append(wave)
            before, first = spread(wave, True)
            for d in np.unique(first):
                if d != c:
                    pending[d].append(before[first == d])
            wave = before[first == c]
        small = np.concatenate(own) if own else np.empty(0, np.int64)
        before, first = spread(large[c][::-1], True)
        for d in np.unique(first):
            pending[d].append(before[first == d])
        out[c] = np.concatenate((large[c], small[::-1]))
    return np.concatenate(out)


def _sorted_lms(t: np.ndarray, lms: np.ndarray, depth: int) -> np.ndarray:
    """The order of the LMS suffixes: names of their substrings, then ranks of two, four, eight ... substrings."""
    m = len(lms)
    if m < 2:
        return np.arange(m)
    ends = np.minimum(np.concatenate((lms[1:] + 1, [len(t)])), len(t))
    sizes = ends - lms
    padded = np.concatenate((t, np.zeros(8, np.uint8)))
    words = np.zeros(len(t), np.uint64)
    for k in range(8):
        words = (words << np.uint64(8)) | padded[k:k + len(t)]
    rank = np.zeros(m, np.int64)
    longest = int(sizes.max())
    for at in range(0, longest, 8):
        # A substring that continues another is smaller, because its suffix is of type L where the other's turns S: missing
        # bytes count as the largest.  The text's end is smaller than any byte.
        left = np.clip(sizes - at, 0, 8)
        missing = ((8 - left) * 8).astype(np.uint64)
        part = np.where(left > 0, words[np.minimum(lms + at, len(t) - 1)], np.uint64(0))
        shift = np.minimum(missing, np.uint64(63))
        head = np.where(missing < 64, part >> shift << shift, np.uint64(0))
        fill = np.where(missing < 64, (np.uint64(1) << shift) - np.uint64(1), np.uint64(2**64 - 1))
        part = head | fill
        part[-1] = head[-1]
        left = -left
        left[-1] = left[-1] if left[-1] == -8 else -9
        order = np.lexsort((left, part, rank))
        rank = _ranks(order, rank, part, left)
    reach = 1
    while rank.max() < m - 1 and reach < depth:
        nxt = np.full(m, -1, np.int64)
        nxt[:-reach] = rank[reach:]
        order = np.lexsort((nxt, rank))
        rank = _ranks(order, rank, nxt)
        reach *= 2
        if reach >= m:
            break
    return np.argsort(rank, kind="stable")


def _ranks(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    new = np.zeros(len(order), dtype=bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def repeated_starts(parts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each of ``parts``, in their order, its starts whose string of ``length`` bytes also starts earlier."""
    t = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
    sizes = np.array([len(x) for x in parts])
    begins = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    sa = suffix_array(t, length)
    owner = np.repeat(np.arange(len(parts)), sizes + 1)
    room = (begins + sizes)[owner] - np.arange(len(t)) >= length
    # Permuted: for every position its predecessor in the array, compared in words as far as needed.
    before = np.full(len(t), -1, np.int64)
    before[sa[1:]] = sa[:-1]
    same = room & (before >= 0)
    same[same] = room[before[same]]
    padded = np.concatenate((t, np.zeros(length + 8, np.uint8)))
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    alive = np.flatnonzero(same)
    for k in [*range(0, length - 7, 8), length - 8]:
        alive = alive[(words[alive + k] == words[before[alive] + k]).all(axis=1)] if len(alive) else alive
    equal = np.zeros(len(t), dtype=bool)
    equal[alive] = True
    run = np.cumsum(~equal[sa])
    first = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
    least = np.repeat(np.minimum.reduceat(sa, first), np.diff(np.concatenate((first, [len(sa)]))))
    again = np.sort(sa[(least != sa) & room[sa]])
    cut = np.searchsorted(again, np.concatenate((begins, [len(t)])))
    return [again[a:b] - begins[i] for i, (a, b) in enumerate(zip(cut[:-1], cut[1:]))]


def _runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate(([True], starts[1:] != starts[:-1] + 1))) if len(starts) else np.empty(0, np.int64)
    return starts[first], np.diff(np.concatenate((first, [len(starts)])))


def _shard_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by gram; whole grams are gathered to shards."""
    held, size, last = [], 0, None

    def out():
        rows = sorted(held, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        docs, marks, s, n = [], [], [], []
        for r, again in zip(rows, repeated_starts([r[4] for r in rows])):
            for a, b in zip(*_runs(again)):
                docs.append(r[1]), marks.append(r[2]), s.append(r[3] + int(a)), n.append(int(b))
        return pa.RecordBatch.from_arrays(
            [pa.array(docs, pa.int64()), pa.array(marks, pa.int64()), pa.array(s, pa.int32()), pa.array(n, pa.int32())], ["doc_id", "mark", "s", "n"])

    for batch in batches:
        for r in zip(*[batch.column(c).to_pylist() for c in ("h", "doc_id", "mark", "s", "bytes")]):
            if size >= SHARD_BYTES and r[0] != last:
                yield out()
                held, size = [], 0
            held.append(r)
            size += len(r[4])
            last = r[0]
    if held:
        yield out()


def _string_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every string of a slice by two hashes."""
    for batch in batches:
        for doc_id, mark, s, data in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "mark", "s", "bytes")]):
            k = range(len(data) - LENGTH + 1)
            x = np.frombuffer(b"".join(hashlib.blake2b(data[i:i + LENGTH], digest_size=16).digest() for i in k), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([
                pa.array(x[:, 0].copy()), pa.array(x[:, 1].copy()), pa.array([doc_id] * len(k), pa.int64()), pa.array([mark] * len(k), pa.int64()),
                pa.array([s + i for i in k], pa.int32())], ["x", "y", "doc_id", "mark", "s"])


def _cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of a text at the places that are asked for."""
    for batch in batches:
        for doc_id, mark, text, at in zip(batch.column("doc_id").to_pylist(), batch.column("mark").to_pylist(), _bytes(batch.column("text")), batch.column("at").to_pylist()):
            yield pa.RecordBatch.from_arrays([
                pa.array([x["h"] for x in at], pa.int64()), pa.array([doc_id] * len(at), pa.int64()), pa.array([mark] * len(at), pa.int64()),
                pa.array([x["s"] for x in at], pa.int32()), pa.array([x["hot"] for x in at], pa.bool_()),
                pa.array([text[x["s"]:x["s"] + x["n"] + LENGTH - 1] for x in at], pa.binary())], ["h", "doc_id", "mark", "s", "hot", "bytes"])


def removed_spans(at: list[dict], size: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the given runs of starts cover."""
    out: list[list[int]] = []
    for a, b in sorted((x["s"], x["s"] + x["n"] + LENGTH - 1) for x in at or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, min(b, size)) for a, b in out]


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text, at in zip(batch.column("doc_id").to_pylist(), _bytes(batch.column("text")), batch.column("at").to_pylist()):
            spans = removed_spans(at, len(text))
            left, end = hashlib.sha256(), 0
            for a, b in spans:
                left.update(text[end:a])
                end = b
            left.update(text[end:])
            rows.append((doc_id, len(text), sum(b - a for a, b in spans), len(spans), left.hexdigest()))
        columns = list(zip(*rows)) or [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(columns, [pa.int64()] * 4 + [pa.string()])], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _places(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("mark"), F.col(f"`{text_col}`").alias("text"))


def _meet(places: DataFrame, rows: DataFrame, how: str, *fields: str) -> DataFrame:
    """Texts with the list of ``rows`` for their place; null ids meet null ids."""
    lists = rows.groupBy("doc_id", "mark").agg(F.collect_list(F.struct(*fields)).alias("at"))
    lists = lists.select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), "at").hint("shuffle_hash")
    met = places.join(lists, places["doc_id"].eqNullSafe(F.col("d")) & (places["mark"] == F.col("m")), how)
    return met.select("doc_id", "mark", "text", "at")


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, mark, s, n): runs of n starts from byte s whose strings start earlier too."""
    places = _places(docs, id_col, text_col)
    found = places.mapInArrow(_slice_batches, "h long, doc_id long, mark long, s int, n int, sh long")
    gram, alike = Window.partitionBy("h"), Window.partitionBy("h", "sh").orderBy("doc_id", "mark", "s")
    # Rows of one place are the same place, so rank and not row number.
    marked = found.select("h", "doc_id", "mark", "s", "n", "sh", F.rank().over(alike).alias("r"), F.row_number().over(alike).alias("k"),
                          F.min("sh").over(gram).alias("lo"), F.max("sh").over(gram).alias("hi"))
    marked = store(marked.filter("r > 1 OR (k = 1 AND lo != hi)"), "slices")
    earliest = marked.filter("r = 1")
    hot = (F.count("*").over(gram) > HOT).alias("hot")
    wanted = earliest.select("h", "doc_id", "mark", "s", "n", hot)
    texts = _meet(places, wanted, "inner", "h", "s", "n", "hot")
    cut = store(texts.mapInArrow(_cut_batches, "h long, doc_id long, mark long, s int, hot boolean, bytes binary").dropDuplicates(["h", "doc_id", "mark", "s"]), "cut")
    shards = cut.filter("NOT hot").repartition("h").sortWithinPartitions("h").mapInArrow(_shard_batches, "doc_id long, mark long, s int, n int")
    strings = cut.filter("hot").mapInArrow(_string_batches, "x long, y long, doc_id long, mark long, s int")
    least = strings.groupBy("x", "y").agg(F.min(F.struct("doc_id", "mark", "s")).alias("first"))
    single = strings.join(least, ["x", "y"]).filter(F.struct("doc_id", "mark", "s") != F.col("first")).select("doc_id", "mark", "s", F.lit(1).alias("n"))
    return store(marked.filter("r > 1").select("doc_id", "mark", "s", "n").union(shards).union(single), "repeated")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every document."""
    met = _meet(_places(docs, id_col, text_col), repeated(docs, id_col, text_col).distinct(), "left", "s", "n")
    return met.mapInArrow(_digest_batches, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
