"""Near-duplicate documents by bottom-k sketches of word shingles.

1. Every text becomes its set of distinct 64-bit shingle hashes.  The same hash values, in order, are the one MinHash
   permutation: the first ``K`` are the bottom-k sketch.  Equal sets (128-bit digest) collapse to one representative.
2. Inverted lists of ``RUN`` retained values in a row find documents that overlap.  Documents that link share such a run
   except with a small chance a link: 0.742 ** 69, about 1e-9, at a similarity of 0.85, and 0.8 ** 71, about 1e-7, at 0.8.
   Small sets also use shorter runs, long enough that a link cannot be missed.
3. The overlapping documents are matched exactly.  Shingles are ordered from rare to common; a link needs a common shingle
   among the first n - ceil(threshold * n) + 1 of both, so only those go to lists.  Lists with the same members count once.
4. Lists of up to ``SMALL`` members propose pairs, which the union of two sketches sifts before whole sets decide.  Of a
   longer list one task takes it all, or two blocks of it, estimates similarity from the union of two sketches, verifies
   survivors on the full sets, and returns only links that join two parts of the list.  Members of the list's largest part
   are never compared with each other, and its pairs are never written.
5. Links close to components by large-star and small-star steps.

Defined results: texts without words, null texts included, have empty sets and are linked with nothing; a null id gets the
smallest id of its component and is not kept; repeated ids are nodes by their sets; an empty table gives an empty result;
extra columns are ignored.  A text is hashed in pieces, so memory does not grow with more than its words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kitescope.llm.common import free_name, store

K = 64
RUN = 4
#: Words of a shingle and least similarity in percent; the library's default for near-duplicates.
WIDTH = 5
PERCENT = 80
#: Lists of so many members propose their pairs, at most SMALL - 1 for an entry; longer lists are matched inside tasks.
SMALL = 16
#: Bytes of sets that one block of a list may hold.
BLOCK_BYTES = 16 << 20
#: An estimate this far below the threshold is rejected: six standard errors of 64 values.
MARGIN = 0.3

_PIECE = 1 << 20
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 on an array."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LETTER = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


class _Powers:
    """Powers of the base, as many as the longest word so far needs."""

    values = np.ones(1, dtype=np.uint64)

    @classmethod
    def upto(cls, n: int) -> np.ndarray:
        if len(cls.values) < n:
            steps = np.full(max(n, 64), _BASE, dtype=np.uint64)
            steps[0] = 1
            cls.values = np.cumprod(steps)
        return cls.values


def word_hashes(data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every word; ``data`` holds texts that each end in a blank at ``ends`` - 1."""
    raw = np.frombuffer(data.lower(), dtype=np.uint8)
    blank = _BLANK[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank)).astype(np.int8)))
    starts, stops = edge[0::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    letters = np.flatnonzero(~blank)
    sizes = stops - starts
    first = np.cumsum(sizes) - sizes
    inside = np.arange(len(letters)) - np.repeat(first, sizes)
    sums = np.add.reduceat(_LETTER[raw[letters]] * _Powers.upto(int(sizes.max()))[inside], first)
    return _mix(sums + sizes.astype(np.uint64)), np.searchsorted(ends, starts, side="right")


def _pieces(texts: list[bytes]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """Texts joined to pieces of bounded size; a longer text is cut after a blank."""
    held, numbers, size = [], [], 0
    for number, text in enumerate(texts):
        text = text + b" "
        at = 0
        while at < len(text):
            stop = len(text)
            if stop - at > _PIECE:
                stop = max((text.rfind(b, at, at + _PIECE) for b in (b" ", b"\n", b"\t")), default=-1) + 1 or at + _PIECE
                while stop < len(text) and not _BLANK[text[stop - 1]]:
                    stop += 1
            held.append(text[at:stop])
            numbers.append(number)
            size += stop - at
            at = stop
            if size >= _PIECE:
                yield b"".join(held), np.cumsum([len(x) for x in held]), np.array(numbers)
                held, numbers, size = [], [], 0
    if held:
        yield b"".join(held), np.cumsum([len(x) for x in held]), np.array(numbers)


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, owners = [], []
    for data, ends, numbers in _pieces(texts):
        h, k = word_hashes(data, ends)
        hashes.append(h)
        owners.append(numbers[k])
    h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    owner = np.concatenate(owners) if owners else np.empty(0, np.int64)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    multipliers = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
    sets = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        w, n = h[a:b], min(width, b - a)
        if n == 0:
            sets.append(np.empty(0, np.uint64))
            continue
        total = np.full(b - a - n + 1, n, dtype=np.uint64)
        for i in range(n):
            total = _mix(total * multipliers[i % 5] + w[i:b - a - n + 1 + i])
        total.sort()
        sets.append(total[np.concatenate(([True], total[1:] != total[:-1]))])
    return sets


@lru_cache(maxsize=4096)
def run_lengths(n: int, percent: int, k: int = K, run: int = RUN) -> tuple[int, ...]:
    """Lengths of runs whose lists a set of n shingles joins.

    A small set is its own sketch.  Where it links, at most e of the union's u shingles are not shared, so at least one run
    of shared ones has ceil((u - e) / (e + 1)) members.
    """
    if n > k:
        return (run,)
    unions = [u for u in range(n, 100 * n // percent + 1) if u * (100 - percent) >= 100]
    if not unions:
        return ()  # links with equal sets only
    sure = min(-(-(u - e) // (e + 1)) for u in unions for e in [u * (100 - percent) // 100])
    return tuple(range(min(sure, run), run + 1))


def run_keys(s: np.ndarray, percent: int = PERCENT, k: int = K, run: int = RUN) -> np.ndarray:
    """Keys of the inverted lists that a set joins."""
    kept = s[:k]
    lengths = [r for r in run_lengths(len(s), percent, k, run) if r <= len(kept)]
    out = []
    for r in lengths:
        total = np.full(len(kept) - r + 1, r, dtype=np.uint64)
        for i in range(r):
            total = _mix(total * np.uint64(_BASE) + kept[i:len(kept) - r + 1 + i])
        out.append(total)
    return np.concatenate(out).view(np.int64) if out else np.empty(0, np.int64)


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _sketch_batches(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.encode() if x is not None else b"" for x in batch.column("text").to_pylist()]
            for a in range(0, max(len(texts), 1), 512):
                part = batch.slice(a, 512)
                sets = shingle_sets(texts[a:a + 512], width)
                keys = [run_keys(s, percent) for s in sets]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in keys]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    part.column("key"), part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_digest(s) for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64))),
                ], ["key", "doc_id", "n", "digest", "runs"])

    return run


def _set_batches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.encode() if x is not None else b"" for x in batch.column("text").to_pylist()]
            for a in range(0, len(texts), 256):
                sets = shingle_sets(texts[a:a + 256], width)
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.array([_digest(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64))),
                ], ["digest", "n", "shingles"])

    return run


def similar(s: np.ndarray, t: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sketches leave the threshold possible, judged on the sketch of their union."""
    if not len(s) or not len(t):
        return False
    reach = min(s[-1], t[-1])
    s, t = s[:np.searchsorted(s, reach, "right")], t[:np.searchsorted(t, reach, "right")]
    both = len(np.intersect1d(s, t, assume_unique=True))
    return both >= (percent / 100 - MARGIN) * (len(s) + len(t) - both)


def _estimate_batches(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, t = batch.column("s"), batch.column("t")
            sv, so, tv, to = s.values.to_numpy().view(np.uint64), s.offsets.to_numpy(), t.values.to_numpy().view(np.uint64), t.offsets.to_numpy()
            stay = pa.array([similar(sv[so[i]:so[i + 1]], tv[to[i]:to[i + 1]], percent) for i in range(batch.num_rows)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(stay), batch.column("b").filter(stay)], ["a", "b"])

    return run


class _Parts:
    """Union-find over a list's members."""

    def __init__(self, n: int):
        self.parent = list(range(n))
        self.size = [1] * n
        self.largest = 0

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if self.size[a] < self.size[b]:
            a, b = b, a
        self.parent[b] = a
        self.size[a] += self.size[b]
        if self.size[a] > self.size[self.find(self.largest)]:
            self.largest = a
        return True


class _Owners:
    """Which members hold a value: all values sorted, with their owners."""

    def __init__(self, lists: list[np.ndarray]):
        values = np.concatenate(lists)
        owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        order = np.argsort(values, kind="stable")
        self.values, self.owner, self.n = values[order], owner[order], len(lists)

    def shared(self, query: np.ndarray) -> np.ndarray:
        """How many values of ``query`` each member holds."""
        a, b = np.searchsorted(self.values, query, "left"), np.searchsorted(self.values, query, "right")
        size = b - a
        at = np.repeat(a - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return np.bincount(self.owner[at], minlength=self.n)


def _estimated(x: int, short: _Owners, sketches: list[np.ndarray], last: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Members that may link with member x, by size and by the sketch of the union, which reaches as far as both sketches."""
    both = short.shared(sketches[x])
    near = np.flatnonzero((both > 0) & (100 * np.minimum(sizes, sizes[x]) >= percent * np.maximum(sizes, sizes[x])))
    near = near[near != x]
    reach = np.minimum(last[near], last[x])
    mine = np.searchsorted(sketches[x], reach, "right")
    theirs = np.array([np.searchsorted(sketches[y], r, "right") for y, r in zip(near, reach)], dtype=np.int64)
    return near[both[near] >= (percent / 100 - MARGIN) * (mine + theirs - both[near])]


def with_partner(sketches: list[np.ndarray], sizes: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Which members may link with some other member of their list."""
    last = np.array([s[-1] if len(s) else 0 for s in sketches], dtype=np.uint64)
    short, found = _Owners(sketches), np.zeros(len(sketches), dtype=bool)
    for x in range(len(sketches)):
        if not found[x]:
            near = _estimated(x, short, sketches, last, sizes, percent)
            found[near] = True
            found[x] = len(near) > 0
    return found


def joining_links(sets: list[np.ndarray], percent: int = PERCENT, k: int = K) -> list[tuple[int, int]]:
    """Links between members that join the list's parts: every link follows from them by transitivity.

    A member is compared with all others unless it lies in the largest part by then.
    """
    n = len(sets)
    if n < 2:
        return []
    sizes = np.array([len(s) for s in sets])
    sketches = [s[:k] for s in sets]
    last = np.array([s[-1] if len(s) else 0 for s in sketches], dtype=np.uint64)
    short, full = _Owners(sketches), None
    parts, links, done = _Parts(n), [], np.zeros(n, dtype=bool)
    queue = list(range(n))
    while queue:
        later = []
        for x in queue:
            if done.any() and parts.find(x) == parts.find(parts.largest) and parts.size[parts.find(x)] > 1:
                later.append(x)
                continue
            done[x] = True
            near = _estimated(x, short, sketches, last, sizes, percent)
            if not len(near):
                continue
            if len(near) > 8:
                full = full or _Owners(sets)
                inter = full.shared(sets[x])[near]
            else:
                inter = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for y in near], dtype=np.int64)
            for y in near[100 * inter >= percent * (sizes[x] + sizes[near] - inter)]:
                if parts.join(x, int(y)):
                    links.append((x, int(y)))
        top = parts.find(parts.largest)
        queue = [x for x in later if parts.find(x) != top]
    return links


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[bytes], list[int], list[np.ndarray]]]:
    """(name, digests, sizes, values) of every list of two or more members.

    Rows come sorted by list; a list may begin in one batch and end in another.
    """
    now, digests, sizes, sets = None, [], [], []
    for batch in batches:
        names = list(zip(batch.column("list").to_pylist(), batch.column("block").to_pylist()))
        values = batch.column("shingles")
        flat, offsets = values.values.to_numpy().view(np.uint64), values.offsets.to_numpy()
        for i, (digest, n) in enumerate(zip(batch.column("digest").to_pylist(), batch.column("n").to_pylist())):
            if names[i] != now:
                if len(sets) > 1:
                    yield now, digests, sizes, sets
                now, digests, sizes, sets = names[i], [], [], []
            digests.append(digest)
            sizes.append(n)
            sets.append(flat[offsets[i]:offsets[i + 1]].copy())
    if len(sets) > 1:
        yield now, digests, sizes, sets


def _near_batches(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (name, block), digests, sizes, sketches in _lists(batches):
            stay = [d for d, near in zip(digests, with_partner(sketches, np.array(sizes), percent)) if near]
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(stay), pa.int64()), pa.array([block] * len(stay), pa.int64()), pa.array(stay, pa.binary())], ["list", "block", "digest"])

    return run


def _link_batches(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, digests, _, sets in _lists(batches):
            links = joining_links(sets, percent)
            yield pa.RecordBatch.from_arrays(
                [pa.array([digests[a] for a, _ in links], pa.binary()), pa.array([digests[b] for _, b in links], pa.binary())], ["a", "b"])

    return run


def components(links: DataFrame, name: str = "stars") -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the smallest node of its component.

    Large-star and small-star steps in turn, each stored, until the set of links stays the same.
    """
    def mark(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = store(links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before = mark(edges)
    while before[0]:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a")
        small = small.filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(small_least.select("a", F.col("m").alias("b")))
        edges = store(small.distinct(), name)
        after = mark(edges)
        if tuple(after) == tuple(before):
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _key(id_col: str, text_col: str) -> Column:
    # The hash skips nulls, so marks tell (5, null) from (null, "5").
    number, text = F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`")
    return F.xxhash64(number, text, number.isNull(), text.isNull())


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT,
            block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: key, doc_id, n_shingles, component_id, kept."""
    texts = docs.select(_key(id_col, text_col).alias("key"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    drawn = store(texts.mapInArrow(_sketch_batches(width, percent), "key long, doc_id long, n long, digest binary, runs array<long>"), "sketches")
    # Equal sets: one representative, and the smallest id among them.
    groups = store(drawn.filter("n > 0").groupBy("digest").agg(
        F.min("doc_id").alias("least"), F.min(F.struct("key", "n", "runs")).alias("one")).select("digest", "least", "one.*"), "groups")
    # Lists of retained runs: who shares one with another set.
    entries = groups.filter(F.size("runs") > 0).select("digest", F.explode("runs").alias("run"))
    own = Window.partitionBy("run")
    overlapping = entries.select("digest", F.min("digest").over(own).alias("lo"), F.max("digest").over(own).alias("hi"))
    overlapping = overlapping.filter("lo != hi").select("digest").distinct()
    wanted = store(groups.select("key", "digest").join(overlapping, "digest", "left_semi"), "overlapping")
    sets = texts.join(wanted.select("key"), "key", "left_semi").select("text").mapInArrow(_set_batches(width), "digest binary, n long, shingles array<long>")
    sets = store(sets.join(wanted.select("digest"), "digest", "left_semi").dropDuplicates(["digest"]), "sets")
    links = exact_links(sets, percent, block_bytes)
    rooted = components(links)
    least = groups.select("digest", "least").join(rooted, groups["digest"] == rooted["node"], "left").select(
        "digest", "least", F.coalesce("root", "digest").alias("root"))
    smallest = least.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = least.join(smallest, "root").select("digest", "component_id")
    out = drawn.select("key", "doc_id", "n", "digest").join(labels, "digest", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("key", "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))


def exact_links(sets: DataFrame, percent: int = PERCENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Links (a, b) between digests that join the components of sets (digest, n, shingles)."""
    postings = sets.select("digest", "n", F.explode("shingles").alias("list"))
    counted = postings.withColumn("df", F.count("*").over(Window.partitionBy("list"))).filter("df > 1")
    own = Window.partitionBy("digest")
    ranked = counted.select(
        "list", "digest", "n", F.count("*").over(own).alias("m"), F.row_number().over(own.orderBy("df", "list")).alias("r"))
    # Shingles of one document alone come first in the order from rare to common and use up the prefix.
    length = F.col("n") - F.expr(f"({percent} * n + 99) div 100") + 1
    prefix = store(ranked.filter(F.col("r") <= length - (F.col("n") - F.col("m"))).select("list", "digest", "n"), "prefix")
    lists = prefix.groupBy("list").agg(
        F.count("*").alias("members"), F.sum("n").alias("total"),
        F.bit_xor(F.xxhash64("digest")).alias("x"), F.bit_xor(F.xxhash64("digest", F.lit(1))).alias("y")).filter("members > 1")
    once = lists.groupBy("members", "x", "y").agg(F.min("list").alias("list"), F.first("total").alias("total"))
    once = store(prefix.select("list", "digest", "n").join(once, "list"), "lists")
    small, long = once.filter(F.col("members") <= SMALL), once.filter(F.col("members") > SMALL)
    return _pair_links(small, sets, percent).union(_block_links(long, sets, percent, block_bytes))


def _pair_links(lists: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among lists of at most SMALL members: each entry meets the fewer than SMALL others of its list."""
    other = lists.select("list", F.col("digest").alias("b"), F.col("n").alias("n_b"))
    pairs = lists.select("list", F.col("digest").alias("a"), F.col("n").alias("n_a")).join(other, "list")
    pairs = pairs.filter((F.col("a") < F.col("b")) & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")))
    pairs = pairs.select("a", "b").distinct()
    # The union of two sketches estimates first; only survivors take whole sets along.
    short = sets.select("digest", F.slice("shingles", 1, K).alias("sketch"))
    close = pairs.join(short.select(F.col("digest").alias("a"), F.col("sketch").alias("s")), "a")
    close = close.join(short.select(F.col("digest").alias("b"), F.col("sketch").alias("t")), "b")
    close = store(close.mapInArrow(_estimate_batches(percent), "a binary, b binary"), "close")
    full = close.join(sets.select(F.col("digest").alias("a"), F.col("shingles").alias("s")), "a")
    full = full.join(sets.select(F.col("digest").alias("b"), F.col("shingles").alias("t")), "b")
    both = F.size(F.array_intersect("s", "t"))
    return store(full.filter(100 * both >= percent * (F.size("s") + F.size("t") - both)).select("a", "b"), "links")


def _block_links(lists: DataFrame, sets: DataFrame, percent: int, block_bytes: int) -> DataFrame:
    """Links that join the parts of long lists, found block by block."""
    blocks = F.expr(f"cast(8 * total div {block_bytes} + 1 as int)")
    placed = lists.select("list", "digest", blocks.alias("blocks"))
    mine = F.pmod(F.xxhash64("digest", F.lit(2)), F.col("blocks")).cast("int")
    # Every two blocks of a list meet once: block i goes to (i, j) and (j, i) for all j.
    placed = placed.withColumn("mine", mine).select("list", "digest", F.explode(F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda j: F.least(j, F.col("mine")).cast("long") * F.col("blocks") + F.greatest(j, F.col("mine")))).alias("block"))
    # Sketches go first: whole sets follow only for members that may link with another member.
    fields = ["list", "block", "digest", "n", "shingles"]

    def dealt(members: DataFrame, values: DataFrame) -> DataFrame:
        return members.join(values, "digest").repartition("list", "block").sortWithinPartitions("list", "block", "digest").select(*fields)

    short = sets.select("digest", "n", F.slice("shingles", 1, K).alias("shingles"))
    near = store(dealt(placed, short).mapInArrow(_near_batches(percent), "list long, block long, digest binary"), "near")
    return store(dealt(near, sets.select("digest", "n", "shingles")).mapInArrow(_link_batches(percent), "a binary, b binary"), "links")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of every component, the one with the smallest id; a row that repeats it goes too.

    Documents with a null id stay only where their component has no id at all; of such a component one row stays.
    """
    key = free_name(docs, "key")
    judged = classes(docs, id_col, text_col, width, percent)
    alone = judged.filter("component_id IS NULL").select("key", "doc_id")
    kept = judged.filter("kept").select("key", "doc_id").union(alone).groupBy("key").agg(F.count("*").alias("rows"))
    kept = store(kept.withColumnRenamed("key", key), "kept")
    stay = docs.withColumn(key, _key(id_col, text_col)).join(kept.select(key), key, "left_semi")
    if not kept.filter("rows > 1").isEmpty():
        stay = stay.dropDuplicates([key])
    return stay.select(*[F.col(f"`{c}`") for c in docs.columns])
