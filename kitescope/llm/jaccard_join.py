"""Exact Jaccard self-join of shingle sets by partitions of the universe.

Two sets of sizes a and b with similarity t or more differ in at most H = floor((a + b) * (1 - t) / (1 + t)) members.

1. Sizes fall into bands whose starts grow by 1 / t, so the smaller set of a link lies in the band of the larger one or in the
   band below.  Each band hashes the universe of shingles into H + 1 segments for its largest H, and a seventh more to choose from.
2. The larger set of a pair is the probe.  It gives every segment of a band it visits an allowance v of -1, 0 or 1 such that the
   sum of v + 1 is at least its own H + 1.  By the pigeonhole principle one segment then differs in at most v members.
   v = 0 looks a segment's subset up; v = 1 also looks up its one-deletion neighbourhood, and its subset in the index of
   one-deletion neighbourhoods; v = -1 skips the segment.
3. Allowances are bought where they are cheap.  A subset is at most as frequent as its rarest shingle, a subset less one member
   at most as frequent as its second rarest, so document frequencies of shingles bound the lists; empty segments cost most.
   Ties go to low segment numbers, and the index holds deletion neighbourhoods (and empty subsets) of a segment only if some
   probe of its band asks for them.
4. A first look, before frequencies are known, takes larger subsets as rarer ones and finds the texts that share any key with
   another.  It sends ten bytes an entry; only the sets of those texts are stored and go through steps 2 and 3.
5. Lists with at most ``SMALL`` probes, or as few index entries, give pairs.  Of longer lists every member meets one hub first;
   what these links leave apart is compared with the rest of its list, as pairs while at most ``SMALL`` members lie outside the
   list's largest part, else block by block inside tasks, where parts that are joined by then are not compared again.
6. Every pair is verified on the whole sets.  Links close to components.

No step estimates: a link is lost only if two different sets share a 128-bit digest.

Defined results: texts without words, null texts included, have empty sets and are linked with nothing; equal sets are one
component; a null id gets the smallest id of its component; repeated ids are nodes by their sets; an empty table gives an empty
result; extra columns are ignored.  Intermediate tables stay under the checkpoint folder, which its owner clears.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kitescope.llm.common import store
from kitescope.llm.near_dedup import _digest, _mix, _Owners, _Parts, components, shingle_sets

WIDTH = 5
PERCENT = 80
#: Up to so many documents a shingle counts as rare: its lists are short whatever is chosen.
RARE = 8
#: What a deletion neighbourhood costs beside its lists: both sides write a key for each member of the segment.
NEIGHBOURHOOD = 64
#: Probes of a list, or members outside its largest part, that are met pair by pair.
SMALL = 16
#: Bytes of sets that one block of a list may hold.
BLOCK_BYTES = 16 << 20
#: Members that one step of the vectorised code takes at once, unless one set has more.
STEP = 400_000

#: One segment in so many is spare, so that probes may skip the smallest, which are the most frequent.
SPARE = 7

_NEVER = np.int64(1) << np.int64(40)
_PHI = np.uint64(0x9E3779B97F4A7C15)
_WHERE, _WHAT = np.uint64(0xD1B54A32D192ED03), np.uint64(0x8CB92BA72F3D8DD7)
_NEIGHBOUR = np.uint64(0x2545F4914F6CDD1D)


# ---- bands and segments -----------------------------------------------------------------------------------------

def band_starts(largest: int, percent: int = PERCENT) -> np.ndarray:
    """First sizes of the bands, up to one beyond ``largest``."""
    starts = [1]
    while starts[-1] <= largest:
        starts.append(max(starts[-1] + 1, -(-starts[-1] * 100 // percent)))
    return np.array(starts, dtype=np.int64)


def most_apart(total: np.ndarray | int, percent: int = PERCENT):
    """How many members two linked sets of so many members together may differ in."""
    return total * (100 - percent) // (100 + percent)


def segments_of(band: np.ndarray, starts: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    top = starts[band + 1] - 1
    least = most_apart(top + top * 100 // percent, percent) + 1
    return least + least // SPARE


class _Cut:
    """Sets of a batch cut into the segments of the bands they visit, flat over (visit, segment)."""

    def __init__(self, values: np.ndarray, sizes: np.ndarray, doc: np.ndarray, band: np.ndarray, m: np.ndarray):
        first = np.cumsum(sizes) - sizes
        self.doc, self.band, self.m = doc, band, m
        taken = sizes[doc]
        self.seg_first = np.cumsum(m) - m
        self.total = int(m.sum())
        at = np.repeat(first[doc] - (np.cumsum(taken) - taken), taken) + np.arange(taken.sum())
        visit = np.repeat(np.arange(len(doc)), taken)
        self.at = at
        place = (_mix(values[at] ^ _WHERE) >> np.uint64(32)) * m[visit].astype(np.uint64) >> np.uint64(32)
        self.gid = self.seg_first[visit] + place.astype(np.int64)
        self.value = _mix(values[at] + _WHAT)
        self.visit_of = np.repeat(np.arange(len(doc)), m)
        self.segment = np.arange(self.total) - np.repeat(self.seg_first, m)
        self.count = np.bincount(self.gid, minlength=self.total)
        order = np.argsort(self.gid, kind="stable")
        self.sum = np.zeros(self.total, dtype=np.uint64)
        filled = np.flatnonzero(self.count)
        starts = (np.cumsum(self.count) - self.count)[filled]
        if len(filled):
            self.sum[filled] = np.add.reduceat(self.value[order], starts)
        label = band[self.visit_of].astype(np.uint64) * _PHI + self.segment.astype(np.uint64)
        self.tag = _mix(label * _PHI + _WHAT)

    def subsets(self, gid: np.ndarray, space: np.uint64 = np.uint64(0)) -> np.ndarray:
        return _mix((self.sum[gid] + self.count[gid].astype(np.uint64) * _PHI) ^ (self.tag[gid] + space))

    def neighbours(self, element: np.ndarray, space: np.uint64 = np.uint64(0)) -> np.ndarray:
        """Keys of the elements' segments without the element."""
        gid = self.gid[element]
        rest = self.sum[gid] - self.value[element] + (self.count[gid] - 1).astype(np.uint64) * _PHI
        return _mix(rest ^ (self.tag[gid] + space))


def allowances(cut: _Cut, first: np.ndarray, second: np.ndarray, need: np.ndarray) -> np.ndarray:
    """-1, 0 or 1 for every segment: the cheapest units of allowance, as many as each visit needs.

    ``first`` and ``second`` are the costs of a segment's first and second unit.
    """
    # A second unit costs more than the first, so it is never bought alone.
    cost = np.concatenate([first, np.maximum(first, second) + 1])
    visit, unit = np.tile(cut.visit_of, 2), np.repeat(np.array([0, 1]), cut.total)
    ranked = np.lexsort((np.tile(cut.segment, 2), unit, cost, visit))
    rank = np.empty(2 * cut.total, dtype=np.int64)
    rank[ranked] = np.arange(2 * cut.total) - np.repeat(2 * cut.seg_first, 2 * cut.m)
    bought = rank < need[visit]
    return bought[:cut.total].astype(np.int64) + bought[cut.total:] - 1


def costs_by_frequency(cut: _Cut, frequency: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The document frequencies of each segment's rarest and second rarest member."""
    ranked = frequency[np.lexsort((frequency, cut.gid))]
    start = np.cumsum(cut.count) - cut.count
    first, second = np.full(cut.total, _NEVER), np.full(cut.total, _NEVER)
    lone, several = np.flatnonzero(cut.count > 0), np.flatnonzero(cut.count > 1)
    first[lone] = ranked[start[lone]]
    second[several] = ranked[start[several] + 1] + NEIGHBOURHOOD
    return first, second


def _visits(sizes: np.ndarray, starts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, band, units needed) of every band that a set probes: its own, and the one below where smaller partners may lie."""
    own = np.searchsorted(starts, sizes, "right") - 1
    below = np.flatnonzero((own > 0) & (-(-sizes * percent // 100) < starts[own]))
    doc = np.concatenate([np.arange(len(sizes)), below])
    band = np.concatenate([own, own[below] - 1])
    return doc, band, most_apart(sizes[doc] + np.minimum(sizes[doc], starts[band + 1] - 1), percent) + 1


def _lists_by(doc: np.ndarray, values: np.ndarray, docs: int) -> pa.ListArray:
    order = np.argsort(doc, kind="stable")
    offsets = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=docs)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[order].astype(np.int64) if values.dtype != np.uint64 else values[order].view(np.int64)))


def demand_code(band: np.ndarray, segment: np.ndarray, empty: bool) -> np.ndarray:
    """What a probe asks the index for: deletion neighbourhoods of a segment, or its empty subsets."""
    return (band << 40) + (segment << 1) + int(empty)


def probe_keys(values: np.ndarray, sizes: np.ndarray, frequency: np.ndarray, percent: int = PERCENT) -> tuple[pa.ListArray, pa.ListArray]:
    """(keys looked up, demands) of each set as the larger one of a link."""
    starts = band_starts(int(sizes.max(initial=1)), percent)
    doc, band, need = _visits(sizes, starts, percent)
    cut = _Cut(values, sizes, doc, band, segments_of(band, starts, percent))
    v = allowances(cut, *costs_by_frequency(cut, frequency[cut.at]), need)
    plain, wide = np.flatnonzero(v >= 0), np.flatnonzero(v == 1)
    spread = np.flatnonzero(v[cut.gid] == 1)
    keys = np.concatenate([cut.subsets(plain), cut.subsets(wide, _NEIGHBOUR), cut.neighbours(spread)])
    owner = cut.doc[cut.visit_of[np.concatenate([plain, wide, cut.gid[spread]])]]
    bare = np.flatnonzero(((v >= 0) & (cut.count == 0)) | ((v == 1) & (cut.count == 1)))
    asked = np.concatenate([demand_code(band[cut.visit_of[wide]], cut.segment[wide], False), demand_code(band[cut.visit_of[bare]], cut.segment[bare], True)])
    return _lists_by(owner, keys, len(sizes)), _lists_by(cut.doc[cut.visit_of[np.concatenate([wide, bare])]], asked, len(sizes))


def index_keys(values: np.ndarray, sizes: np.ndarray, asked: np.ndarray, asked_sizes: np.ndarray, percent: int = PERCENT) -> pa.ListArray:
    """Keys under which each set is found as the smaller one of a link; ``asked`` holds the demands on its band."""
    starts = band_starts(int(sizes.max(initial=1)), percent)
    band = np.searchsorted(starts, sizes, "right") - 1
    cut = _Cut(values, sizes, np.arange(len(sizes)), band, segments_of(band, starts, percent))
    gid = np.repeat(cut.seg_first, asked_sizes) + ((asked & ((np.int64(1) << 40) - 1)) >> 1)
    wide, empty = np.zeros(cut.total, dtype=bool), np.zeros(cut.total, dtype=bool)
    wide[gid[asked & 1 == 0]] = True
    empty[gid[asked & 1 == 1]] = True
    plain = np.flatnonzero((cut.count > 0) | empty)
    spread = np.flatnonzero(wide[cut.gid])
    keys = np.concatenate([cut.subsets(plain), cut.neighbours(spread, _NEIGHBOUR)])
    return _lists_by(cut.visit_of[np.concatenate([plain, cut.gid[spread]])], keys, len(sizes))


def entries(values: np.ndarray, sizes: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, set, role) of the first look: role 1 is held by the index, 2 looked up by a probe, 3 both.

    Frequencies are not known yet: larger subsets count as rarer, and second units are bought in the first segments only, whose
    deletion neighbourhoods the index always holds.
    """
    starts = band_starts(int(sizes.max(initial=1)), percent)
    doc, band, need = _visits(sizes, starts, percent)
    cut = _Cut(values, sizes, doc, band, segments_of(band, starts, percent))
    reserve = cut.segment <= cut.m[cut.visit_of] // 32
    first = np.where(cut.count > 0, 256 - np.minimum(cut.count, 255), _NEVER)
    v = allowances(cut, first, np.where(reserve & (cut.count > 1), 1000, 2 * _NEVER), need)
    own = cut.visit_of < len(sizes)
    plain, wide = np.flatnonzero(own | (v >= 0)), np.flatnonzero(v == 1)
    spread, held = np.flatnonzero(v[cut.gid] == 1), np.flatnonzero(own[cut.gid] & reserve[cut.gid])
    keys = np.concatenate([cut.subsets(plain), cut.subsets(wide, _NEIGHBOUR), cut.neighbours(spread), cut.neighbours(held, _NEIGHBOUR)])
    owner = cut.doc[cut.visit_of[np.concatenate([plain, wide, cut.gid[spread], cut.gid[held]])]]
    role = np.concatenate([own[plain] + 2 * (v[plain] >= 0), np.full(len(wide) + len(spread), 2), np.full(len(held), 1)])
    return keys, owner, role


def _met(keys: np.ndarray, role: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group of each entry, whether the group has a probe and another set) of entries that come sorted by key."""
    new = np.concatenate(([True], keys[1:] != keys[:-1]))
    group = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    roles = np.bitwise_or.reduceat(role, at)
    return group, (np.diff(np.concatenate((at, [len(keys)]))) > 1) & (roles == 3)


def first_look(values: np.ndarray, sizes: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sets that meet another of the batch, keys, sets, roles to send on).

    Entries that met inside the batch go on as one, so a frequent key costs one entry a batch.
    """
    keys, owner, role = entries(values, sizes, percent)
    order = np.lexsort((owner, keys))
    keys, owner, role = keys[order], owner[order], role[order]
    at = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1]))))
    role = np.bitwise_or.reduceat(role, at)
    keys, owner = keys[at], owner[at]
    group, met = _met(keys, role)
    role[met[group]] = 3
    first = np.concatenate(([True], group[1:] != group[:-1]))
    send = ~met[group] | first
    return np.unique(owner[met[group]]), keys[send], owner[send], role[send]


# ---- tasks ------------------------------------------------------------------------------------------------------

def _steps(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    a = 0
    while a < len(sizes):
        b = max(a + 1, a + int(np.searchsorted(np.cumsum(sizes[a:a + 4096]), STEP, "right")))
        yield a, b
        a = b


def _flat(column: pa.ListArray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, sizes) of rows a to b of a list column without null lists."""
    offsets = column.offsets.to_numpy()[a:b + 1]
    return column.values.to_numpy()[offsets[0]:offsets[-1]], np.diff(offsets).astype(np.int64)


_ENTRY = np.dtype([("low", "<u4"), ("high", "<u2"), ("ref", "<u4")])


def _look_batches(width: int, percent: int, buckets: int):
    """Entries of all texts, packed: 46 bits of key beside the bucket's, 2 of role, 32 of the text's own key."""
    def packed(sets: list[np.ndarray], refs: list[int]) -> pa.RecordBatch:
        once: dict[bytes, int] = {}
        for i, s in enumerate(sets):
            if len(s):
                once.setdefault(_digest(s), i)
        chosen = list(once.values())
        sizes = np.array([len(sets[i]) for i in chosen], dtype=np.int64)
        ref = np.array([refs[i] & 0xFFFFFFFF for i in chosen], dtype=np.uint32)
        met, keys, owner, role = first_look(np.concatenate([sets[i] for i in chosen]), sizes, percent)
        bucket = (keys >> np.uint64(40)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        out = np.empty(len(keys), dtype=_ENTRY)
        word = (keys[order] << np.uint64(2)) | role[order].astype(np.uint64)
        out["low"], out["high"], out["ref"] = word & np.uint64(0xFFFFFFFF), (word >> np.uint64(32)) & np.uint64(0xFFFF), ref[owner[order]]
        bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
        filled = np.flatnonzero(np.diff(bounds))
        return pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([filled, filled[:1]]).astype(np.int32)),
            pa.array([out[bounds[b]:bounds[b + 1]].tobytes() for b in filled] + [b""] * min(1, len(filled)), pa.binary()),
            pa.array([None] * len(filled) + [ref[met].tobytes()] * min(1, len(filled)), pa.binary()),
        ], ["bucket", "entries", "met"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, refs, members = [], [], 0
        for batch in batches:
            keys, texts = batch.column("key").to_pylist(), batch.column("text")
            for a in range(0, batch.num_rows, 128):
                sets = shingle_sets([x.encode("utf-8", "surrogatepass") if x is not None else b"" for x in texts.slice(a, 128).to_pylist()], width)
                held += sets
                refs += keys[a:a + 128]
                members += sum(map(len, sets))
                if members >= STEP:
                    yield packed(held, refs)
                    held, refs, members = [], [], 0
        if members:
            yield packed(held, refs)

    return run


def _meet_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Own keys of texts that share an entry's key with another text, bucket by bucket."""
    def solved(blobs: list[bytes]) -> np.ndarray:
        rows = np.concatenate([np.frombuffer(b, dtype=_ENTRY) for b in blobs])
        if not len(rows):
            return rows["ref"]
        word = rows["low"].astype(np.uint64) | (rows["high"].astype(np.uint64) << np.uint64(32))
        order = np.argsort(word >> np.uint64(2), kind="stable")
        group, met = _met(word[order] >> np.uint64(2), (word[order] & np.uint64(3)).astype(np.int64))
        return np.unique(rows["ref"][order][met[group]])

    def row(refs: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.unique(refs).astype(np.int64))], ["ref"])

    now, blobs = None, []
    for batch in batches:
        inside = [np.frombuffer(b, dtype="<u4") for b in batch.column("met").drop_null().to_pylist()]
        if inside:
            yield row(np.concatenate(inside))
        for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("entries").to_pylist()):
            if bucket != now:
                if blobs:
                    yield row(solved(blobs))
                now, blobs = bucket, []
            blobs.append(blob)
    if blobs:
        yield row(solved(blobs))


def _size_batches(width: int):
    """(key, doc_id, n, digest) of every text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for a in range(0, batch.num_rows, 256):
                sets = shingle_sets([x.encode("utf-8", "surrogatepass") if x is not None else b"" for x in texts.slice(a, 256).to_pylist()], width)
                yield pa.RecordBatch.from_arrays([
                    batch.column("key").slice(a, 256), batch.column("doc_id").slice(a, 256), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_digest(s) for s in sets], pa.binary())], ["key", "doc_id", "n", "digest"])

    return run


def _set_batches(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for a in range(0, batch.num_rows, 256):
                sets = shingle_sets([x.encode("utf-8", "surrogatepass") if x is not None else b"" for x in texts.slice(a, 256).to_pylist()], width)
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                band = np.searchsorted(band_starts(int(sizes.max(initial=1)), percent), sizes, "right") - 1
                offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.array(sizes), pa.array(band.astype(np.int32)), pa.array([_digest(s) for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64))),
                ], ["n", "band", "digest", "shingles"])

    return run


def _probe_batches(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column("shingles").offsets.to_numpy())
            for a, b in _steps(sizes):
                values, n = _flat(batch.column("shingles"), a, b)
                frequent, fn = _flat(batch.column("frequent"), a, b)
                counts, _ = _flat(batch.column("counts"), a, b)
                frequency = np.ones(len(values), dtype=np.int64)
                if len(frequent):
                    rows, wanted = np.repeat(np.arange(b - a), n), np.repeat(np.arange(b - a), fn)
                    order = np.lexsort((values, rows))
                    pairs = np.rec.fromarrays([rows[order], values[order]])
                    look = np.rec.fromarrays([wanted, frequent])
                    frequency[order[np.searchsorted(pairs, look)]] = counts
                keys, asked = probe_keys(values.view(np.uint64), n, frequency, percent)
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(a, b - a), pa.array(n), keys, asked], ["node", "n", "keys", "asked"])

    return run


def _index_batches(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column("shingles").offsets.to_numpy())
            for a, b in _steps(sizes):
                values, n = _flat(batch.column("shingles"), a, b)
                asked, asked_sizes = _flat(batch.column("asked"), a, b)
                keys = index_keys(values.view(np.uint64), n, asked, asked_sizes, percent)
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(a, b - a), pa.array(n), keys], ["node", "n", "keys"])

    return run


def joining(sets: list[np.ndarray], roots: list[int], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that join parts of a list; members with one root are together from the start.

    A member is compared, exactly, with all others unless it lies in the largest part by then.
    """
    parts, links = _Parts(len(sets)), []
    seen: dict[int, int] = {}
    for i, root in enumerate(roots):
        parts.join(seen.setdefault(root, i), i)
    sizes, owners = np.array([len(s) for s in sets]), _Owners(sets)
    for x in range(len(sets)):
        if parts.size[parts.find(parts.largest)] > 1 and parts.find(x) == parts.find(parts.largest):
            continue
        both = owners.shared(sets[x])
        for y in np.flatnonzero((both > 0) & (100 * both >= percent * (sizes + sizes[x] - both))):
            if parts.join(x, int(y)):
                links.append((x, int(y)))
    return links


def _block_batches(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, roots, sets = None, [], [], []

        def solved() -> pa.RecordBatch:
            links = joining(sets, roots, percent) if len(sets) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([nodes[a] for a, _ in links], pa.int64()), pa.array([nodes[b] for _, b in links], pa.int64())], ["a", "b"])

        for batch in batches:
            names = zip(batch.column("key").to_pylist(), batch.column("block").to_pylist())
            values = batch.column("shingles")
            flat, offsets = values.values.to_numpy().view(np.uint64), values.offsets.to_numpy()
            for i, (name, node, root) in enumerate(zip(names, batch.column("node").to_pylist(), batch.column("root").to_pylist())):
                if name != now:
                    yield solved()
                    now, nodes, roots, sets = name, [], [], []
                nodes.append(node)
                roots.append(root)
                sets.append(flat[offsets[i]:offsets[i + 1]].copy())
        yield solved()

    return run


# ---- the Spark job ----------------------------------------------------------------------------------------------

def meeting(texts: DataFrame, drawn: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Sets (node, digest, n, band, shingles), one of each kind, of the texts (key, doc_id, text) that share a key with another."""
    buckets = max(64, 4 * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    looked = texts.select("key", "text").mapInArrow(_look_batches(width, percent, buckets), "bucket int, entries binary, met binary")
    refs = looked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_meet_batches, "ref long")
    refs = store(refs.distinct(), "met")
    # Texts of one set need one representative; a reference of 32 bits may bring a few texts more, which costs time only.
    mine = drawn.filter("n > 0").withColumn("ref", F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)))
    wanted = store(mine.join(refs, "ref", "left_semi").groupBy("digest").agg(F.min("key").alias("key")).select("key"), "wanted")
    sets = texts.join(wanted, "key", "left_semi").select("text").mapInArrow(_set_batches(width, percent), "n long, band int, digest binary, shingles array<long>")
    sets = store(sets.withColumn("node", F.monotonically_increasing_id()), "sets")
    # Rows that repeat id and text still come twice.
    again = sets.groupBy("digest").agg(F.min("node").alias("node"), F.count("*").alias("rows"))
    if again.filter("rows > 1").isEmpty():
        return sets
    return store(sets.join(again.select("node"), "node", "left_semi"), "sets")


def postings(sets: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(probes, index), both (node, n, keys), of sets (node, n, band, shingles)."""
    flat = sets.select("node", F.explode("shingles").alias("shingle"))
    common = store(flat.groupBy("shingle").agg(F.count("*").alias("count")).filter(F.col("count") > RARE), "common")
    # Only frequent shingles come back to their documents.
    met = flat.join(common, "shingle").groupBy("node").agg(F.collect_list(F.struct("shingle", "count")).alias("met"))
    none = F.array().cast("array<long>")
    weighed = sets.join(met, "node", "left").select(
        "node", "n", "shingles", F.coalesce(F.col("met.shingle"), none).alias("frequent"), F.coalesce(F.col("met.count"), none).alias("counts"))
    probes = store(weighed.mapInArrow(_probe_batches(percent), "node long, n long, keys array<long>, asked array<long>"), "probes")
    asked = probes.select(F.explode("asked").alias("code")).distinct()
    asked = asked.groupBy(F.shiftright("code", 40).cast("int").alias("band")).agg(F.collect_list("code").alias("asked"))
    index = sets.join(asked, "band", "left").select("node", "n", "shingles", F.coalesce("asked", none).alias("asked"))
    index = store(index.mapInArrow(_index_batches(percent), "node long, n long, keys array<long>"), "index")
    return probes.select("node", "n", "keys"), index


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("s")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("t")), "b")
    inter = F.size(F.array_intersect("s", "t"))
    return store(both.filter(100 * inter >= percent * (F.size("s") + F.size("t") - inter)).select("a", "b"), "links")


def joining_links(sets: DataFrame, percent: int = PERCENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Links (a, b) between nodes from which every other link follows by transitivity."""
    probes, index = postings(sets, percent)
    asks = probes.select(F.explode("keys").alias("key"), "node", "n")
    holds = index.select(F.explode("keys").alias("key"), "node", "n")
    marked = asks.withColumn("probe", F.lit(1)).union(holds.withColumn("probe", F.lit(0)))
    lists = marked.groupBy("key").agg(
        F.sum("probe").alias("probes"), F.count("*").alias("members"), F.min("node").alias("hub"), F.max("node").alias("other"))
    lists = store(lists.filter("probes > 0 AND probes < members AND hub != other").select(
        "key", "hub", (F.least(F.col("probes"), F.col("members") - F.col("probes")) <= SMALL).alias("short")), "lists")
    short, long = lists.filter("short").select("key"), lists.filter("NOT short").select("key", "hub")
    # The larger set of a pair is the probe; equal sizes go by digest.
    # Lists grow with the texts, so they are never broadcast: the plan is the same at every size.
    left = asks.join(short.hint("merge"), "key").select("key", F.col("node").alias("a"), F.col("n").alias("n_a"))
    pairs = left.join(holds.select("key", F.col("node").alias("b"), F.col("n").alias("n_b")), "key")
    larger = (F.col("n_b") < F.col("n_a")) | ((F.col("n_b") == F.col("n_a")) & (F.col("b") < F.col("a")))
    pairs = pairs.filter(larger & (100 * F.col("n_b") >= percent * F.col("n_a"))).select("a", "b")
    members = store(marked.join(long, "key").select("key", "node", "n", "hub").distinct(), "members")
    stars = members.filter("node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    links = verified(pairs.union(stars).distinct(), sets, percent)
    if members.isEmpty():
        return links
    return links.union(_rest_of_lists(members, links, sets, percent, block_bytes))


def _rest_of_lists(members: DataFrame, links: DataFrame, sets: DataFrame, percent: int, block_bytes: int) -> DataFrame:
    """Links between parts that the first links leave apart in long lists (key, node, n)."""
    rooted = components(links).select("node", "root")
    members = store(members.join(rooted, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root")), "rooted")
    counts = members.groupBy("key", "root").agg(F.count("*").alias("rows"), F.sum("n").alias("total"))
    lists = counts.groupBy("key").agg(
        F.count("*").alias("parts"), F.max_by("root", F.struct("rows", "root")).alias("top"), (F.sum("rows") - F.max("rows")).alias("outside"),
        F.sum("total").alias("total")).filter("parts > 1")
    apart = store(members.join(lists, "key"), "apart")
    few, many = apart.filter(F.col("outside") <= SMALL), apart.filter(F.col("outside") > SMALL)
    lone = few.filter("root != top").select("key", F.col("node").alias("x"), F.col("root").alias("x_root"), F.col("n").alias("n_x"))
    pairs = lone.join(few.select("key", F.col("node").alias("y"), F.col("root").alias("y_root"), F.col("n").alias("n_y")), "key")
    pairs = pairs.filter((F.col("x_root") != F.col("y_root")) & (100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y")))
    pairs = pairs.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
    found = verified(pairs, sets, percent)
    # Lists with the same members count once.
    marks = many.groupBy("key").agg(F.count("*").alias("rows"), F.bit_xor(F.xxhash64("node")).alias("p"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("q"))
    once = marks.groupBy("rows", "p", "q").agg(F.min("key").alias("key")).select("key")
    blocks = F.expr(f"cast(8 * total div {block_bytes} + 1 as int)")
    mine = F.pmod(F.xxhash64("node", F.lit(2)), F.col("blocks")).cast("int")
    # Every two blocks of a list meet once.
    placed = many.join(once, "key").select("key", "node", "root", blocks.alias("blocks")).withColumn("mine", mine)
    placed = placed.select("key", "node", "root", F.explode(F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda j: F.least(j, F.col("mine")).cast("long") * F.col("blocks") + F.greatest(j, F.col("mine")))).alias("block"))
    dealt = placed.join(sets.select("node", "shingles"), "node").repartition("key", "block").sortWithinPartitions("key", "block", "node")
    return found.union(store(dealt.select("key", "block", "node", "root", "shingles").mapInArrow(_block_batches(percent), "a long, b long"), "links"))


def join_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT,
                 block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    key = F.xxhash64(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`"), F.col(f"`{id_col}`").isNull())
    texts = docs.select(key.alias("key"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    drawn = store(texts.mapInArrow(_size_batches(width), "key long, doc_id long, n long, digest binary"), "sizes")
    sets = meeting(texts, drawn, width, percent)
    roots = components(joining_links(sets, percent, block_bytes)).withColumnRenamed("node", "linked")
    named = sets.select("node", "digest").join(roots, F.col("node") == F.col("linked"), "left").select("digest", F.coalesce("root", "node").alias("root"))
    ids = drawn.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("least")).join(named, "digest", "left")
    smallest = ids.filter("root IS NOT NULL").groupBy("root").agg(F.min("least").alias("component"))
    labels = ids.join(smallest, "root", "left").select("digest", F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component")).alias("component"))
    out = drawn.select("doc_id", "n", "digest").join(labels, "digest", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))
