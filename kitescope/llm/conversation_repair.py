"""Repair of conversation structure as lightest derivations.

A repaired conversation has the role initials ``(s?(ua)+)?``.  Rows are kept (K), given another role (R), deleted (D), and empty
rows are inserted (I); the cheapest sequence of edits is wanted, and of equally cheap ones the first in ASCII order.

The deduction system has items [k, q]: rows k, k+1, ... of a block can be finished from state q of the pattern's automaton.
A rule takes the item to its right and, unless it inserts, the row before it.  An agenda (Knuth's generalisation of Dijkstra's
algorithm) pops items by (cost, rows consumed, edits).  Every rule adds cost or consumes a row and puts its letter in front,
so its value is larger than its antecedent's and grows with it: the first pop of an item is its lightest derivation, and the
search ends when the goal item is popped.

Rows are dealt by ranges of (conversation, turn), so a conversation may lie in many tasks.  A task cuts its rows into blocks of
at most ``BLOCK`` rows or ``BLOCK_BYTES``.  A conversation that lies inside one block is finished there.  Of all others, each
block gives its lightest derivation between any two states; these are chained in order, which the same two rules allow:
equally cheap derivations of one item are never prefixes of each other, so putting edits behind keeps their order too.  The
chain holds four strings of edits, one byte a row; texts are only streamed through the hash.

Defined results: a null role, text or id counts as one blank where text is needed, and null turns come first; rows of one turn
follow by role and digest of the text; rows without an id form the conversation null; a conversation without rows and an
empty table give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kitescope.llm.common import store

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Rows and bytes of a block.
BLOCK = 1024
BLOCK_BYTES = 16 << 20

_BLANKS = " \t\n\x0b\f\r"
_LEGAL = {"su", "ua", "au"}
#: Automaton of (s?(ua)+)?: 0 nothing yet, 1 after s, 2 after u, 3 after a; 0 and 3 may end.
_NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
_BEFORE = {q: [(p, c) for (p, c), r in _NEXT.items() if r == q] for q in range(4)}
_ENDS = (0, 3)


# ---- one block --------------------------------------------------------------------------------------------------

def lightest(initials: list[str], faults: list[str], ends: tuple[int, ...], goals: tuple[int, ...]) -> dict[int, tuple[int, str]]:
    """(cost, edits) of the lightest derivation from each goal state to one of the end states over all rows."""
    n = len(initials)
    agenda = [(0, 0, "", q) for q in ends]
    done: set[tuple[int, int]] = set()
    found: dict[int, tuple[int, str]] = {}
    while agenda:
        cost, used, edits, state = heapq.heappop(agenda)
        if (used, state) in done:
            continue
        done.add((used, state))
        if used == n and state in goals:
            found[state] = (cost, edits)
            if len(found) == len(goals):
                break
        for before, letter in _BEFORE[state]:
            if letter != "s" and (used, before) not in done:
                heapq.heappush(agenda, (cost + INSERT, used, "I" + edits, before))
        if used == n:
            continue
        row = n - used - 1
        if (used + 1, state) not in done:
            heapq.heappush(agenda, (cost + DELETE, used + 1, "D" + edits, state))
        if faults[row] in ("blank", "duplicate"):
            continue
        extra = TRUNCATED if faults[row] == "truncated" else 0
        for before, letter in _BEFORE[state]:
            if (used + 1, before) in done:
                continue
            if letter == initials[row]:
                heapq.heappush(agenda, (cost + KEEP + extra, used + 1, "K" + edits, before))
            if letter != "s":
                heapq.heappush(agenda, (cost + REROLE + extra, used + 1, "R" + edits, before))
    return found


def repaired_lines(edits: str, roles: list[str], texts: list[str], state: int = 0) -> list[str]:
    """``role:text`` of every row that the edits leave or insert; new roles follow from the state."""
    out, row = [], 0
    for edit in edits:
        if edit == "D":
            row += 1
            continue
        role = roles[row] if edit == "K" else "assistant" if state == 2 else "user"
        out.append(f"{role}:{'' if edit == 'I' else texts[row]}")
        state = _NEXT[(state, role[:1])]
        row += edit != "I"
    return out


class _Block:
    """Rows of one conversation that follow each other in one task."""

    def __init__(self, conv):
        self.conv = conv
        self.turns: list[int | None] = []
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.faults: list[str] = []
        self.bytes = 0

    def add(self, turn, role, text, fault) -> None:
        self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)
        self.faults.append(fault)
        self.bytes += len(role) + len(text)

    def full(self) -> bool:
        return len(self.turns) >= BLOCK or self.bytes >= BLOCK_BYTES

    def summary(self) -> dict:
        initials = [r[:1] for r in self.roles]
        turns = [t for t in self.turns if t is not None]
        return {
            "conv": self.conv, "least": min(turns, default=None), "most": max(turns, default=None), "turns": len(set(turns)),
            "first": initials[0], "last": initials[-1], "illegal": sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:])),
            **{f: self.faults.count(f) for f in ("blank", "duplicate", "truncated")},
        }

    def finished(self) -> dict:
        """The whole answer of a conversation that this block holds whole."""
        cost, edits = lightest([r[:1] for r in self.roles], self.faults, _ENDS, (0,))[0]
        text = "\n".join(repaired_lines(edits, self.roles, self.texts))
        return {"cost": cost, "audit": edits, "sha": hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()}

    def links(self) -> list[dict]:
        """The lightest derivation between any two states."""
        initials = [r[:1] for r in self.roles]
        return [{"p": p, "q": q, "cost": cost, "edits": edits}
                for q in range(4) for p, (cost, edits) in sorted(lightest(initials, self.faults, (q,), (0, 1, 2, 3)).items())]


# ---- the Spark job ----------------------------------------------------------------------------------------------

def _block_schema(conv_type: pa.DataType) -> pa.Schema:
    long, text = pa.int64(), pa.string()
    link = pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", long), ("edits", text)])
    return pa.schema([
        ("conv", conv_type), ("task", pa.int32()), ("seq", long), ("least", long), ("most", long), ("turns", long), ("first", text), ("last", text),
        ("illegal", long), ("blank", long), ("duplicate", long), ("truncated", long), ("cost", long), ("audit", text), ("sha", text),
        ("links", pa.list_(link)), ("roles", pa.list_(text)), ("texts", pa.list_(text))])


_BLOCK_DDL = ("conv {conv}, task int, seq long, least long, most long, turns long, first string, last string, illegal long, blank long, duplicate long, "
              "truncated long, cost long, audit string, sha string, links array<struct<p:int,q:int,cost:long,edits:string>>, roles array<string>, texts array<string>")


def _block_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows that come sorted; the first and last conversation of a task may go on in others."""
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    out, seq, weight, schema = [], 0, 0, None
    held: _Block | None = None
    opened = True  # whether the held block is the first of its task or follows a full block of its conversation

    def close(block: _Block, whole: bool) -> dict:
        row = {"task": task, "seq": seq, **block.summary()}
        return row | (block.finished() if whole else {"links": block.links(), "roles": block.roles, "texts": block.texts})

    for batch in batches:
        schema = schema or _block_schema(batch.schema.field("conv").type)
        columns = [batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "fault")]
        for conv, turn, role, text, fault in zip(*columns):
            if held is not None and (conv != held.conv or held.full()):
                same = conv == held.conv
                out.append(close(held, whole=not (opened or same)))
                weight += held.bytes if opened or same else 100
                seq, opened, held = seq + 1, same, None
                if weight >= BLOCK_BYTES or len(out) >= 4096:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, weight = [], 0
            if held is None:
                held = _Block(conv)
            held.add(turn, role, text, fault)
    if held is not None:
        out.append(close(held, whole=False))
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def _chained(conv, blocks: Iterator[dict]) -> Iterator[dict]:
    """The answer of a conversation from its blocks, and the edits and first state of each block."""
    state = {0: (0, "", "")}  # per state: cost, edits, states passed
    total = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "turns": 0}
    least = most = last = None
    seen_turn = None
    places: list[tuple[int, int]] = []
    lengths: list[dict[tuple[int, int], int]] = []
    for b in blocks:
        for k in total:
            total[k] += b[k]
        if last is not None and last + b["first"] not in _LEGAL:
            total["illegal"] += 1
        last = b["last"]
        if b["least"] is not None:
            total["turns"] -= seen_turn == b["least"]
            least, most = b["least"] if least is None else min(least, b["least"]), b["most"] if most is None else max(most, b["most"])
            seen_turn = b["most"]
        new: dict[int, tuple[int, str, str]] = {}
        for link in b["links"]:
            if link["p"] in state:
                cost, edits, path = state[link["p"]]
                value = (cost + link["cost"], edits + link["edits"], path + str(link["p"]))
                if link["q"] not in new or value < new[link["q"]]:
                    new[link["q"]] = value
        state = new
        places.append((b["task"], b["seq"]))
        lengths.append({(link["p"], link["q"]): len(link["edits"]) for link in b["links"]})
    cost, edits, path = min(state[q] + (q,) for q in _ENDS if q in state)[:3]
    end = min((state[q], q) for q in _ENDS if q in state)[1]
    path += str(end)
    yield {"conv": conv, "task": None, "least": least, "most": most, "cost": cost, "audit": edits, **total}
    at = 0
    for (task, seq), sizes, p, q in zip(places, lengths, path, path[1:]):
        size = sizes[(int(p), int(q))]
        yield {"conv": conv, "task": task, "seq": seq, "state": int(p), "audit": edits[at:at + size]}
        at += size


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[dict]]]:
    """(conversation, its rows) of rows that come sorted by conversation; rows are read one batch at a time."""
    from itertools import groupby

    rows = (row for batch in batches for row in batch.to_pylist())
    for key, part in groupby(rows, key=lambda r: (r["conv"] is None, r["conv"])):
        yield key[1], part


def _chain_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first = next(batches, None)
    if first is None:
        return
    long = pa.int64()
    schema = pa.schema([("conv", first.schema.field("conv").type), ("task", pa.int32()), ("seq", long), ("state", pa.int32()), ("least", long), ("most", long),
                        ("turns", long), ("illegal", long), ("blank", long), ("duplicate", long), ("truncated", long), ("cost", long), ("audit", pa.string())])

    def again():
        yield first
        yield from batches

    for conv, blocks in _runs(again()):
        yield pa.RecordBatch.from_pylist(list(_chained(conv, blocks)), schema)


def _line_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repaired text of each block; null where it leaves no row."""
    for batch in batches:
        texts = []
        for row in batch.to_pylist():
            lines = repaired_lines(row["audit"], row["roles"], row["texts"], row["state"])
            texts.append("\n".join(lines) if lines else None)
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("task"), batch.column("seq"), pa.array(texts, pa.string())], ["conv", "task", "seq", "lines"])


def _hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first = next(batches, None)
    if first is None:
        return

    def again():
        yield first
        yield from batches

    for conv, parts in _runs(again()):
        digest, between = hashlib.sha256(), b""
        for part in parts:
            if part["lines"] is not None:
                digest.update(between + part["lines"].encode("utf-8", "surrogatepass"))
                between = b"\n"
        yield pa.RecordBatch.from_arrays([pa.array([conv], first.schema.field("conv").type), pa.array([digest.hexdigest()])], ["conv", "sha"])


def _blank_free(c: str) -> Column:
    return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with a fixed twentieth of the rows dropped, emptied, cut of their stops, repeated, or given to the user."""
    place = F.concat(_blank_free("conv_id"), F.lit(":"), _blank_free("turn"))
    hit = F.crc32(place.cast("binary")) % 20
    text = F.when(hit == 1, "").when(hit == 2, F.regexp_replace(_blank_free("text"), "[.!?]", "")).otherwise(_blank_free("text"))
    role = F.when(hit == 4, "user").otherwise(_blank_free("role"))
    copies = F.when(hit == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.filter(hit != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def faulty(rows: DataFrame) -> DataFrame:
    """Stored rows (conv, turn, role, text, digest, mark, fault); fault is blank, duplicate, truncated or sound."""
    plain = rows.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), _blank_free("role").alias("role"), _blank_free("text").alias("text"))
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    marked = store(plain.withColumn("digest", digest).withColumn("mark", F.monotonically_increasing_id()), "turns")
    # The first of equal rows is a minimum: equal rows of a large conversation are folded before they are sent.
    firsts = marked.groupBy("conv", "role", "digest").agg(F.min(F.struct("turn", "mark")).alias("first")).select(F.col("first.mark").alias("mark"), F.lit(True).alias("new"))
    stripped = F.rtrim(F.col("text"), F.lit(_BLANKS))
    fault = (F.when(stripped == "", "blank").when(F.col("new").isNull(), "duplicate")
             .when(F.instr(F.lit(".!?"), F.substring(stripped, -1, 1)) == 0, "truncated").otherwise("sound"))
    return marked.join(firsts, "mark", "left").withColumn("fault", fault).drop("new")


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    conv = rows.schema["conv_id"].dataType.simpleString()
    order = ["conv", "turn", "role", "digest", "mark"]
    sorted_rows = faulty(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = store(sorted_rows.select("conv", "turn", "role", "text", "fault").mapInArrow(_block_batches, _BLOCK_DDL.format(conv=conv)), "blocks")
    gaps = F.coalesce(F.col("most") - F.col("least") + 1 - F.col("turns"), F.lit(0)).cast("long").alias("gaps")
    answer = [gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    whole = blocks.filter("links IS NULL").select("conv", *answer, "sha")
    parts = blocks.filter("links IS NOT NULL")
    brief = parts.drop("roles", "texts", "cost", "audit", "sha")
    chained = store(brief.repartition("conv").sortWithinPartitions("conv", "task", "seq").mapInArrow(
        _chain_batches, f"conv {conv}, task int, seq long, state int, least long, most long, turns long, illegal long, blank long, duplicate long, truncated long, cost long, audit string"), "chains")
    lines = parts.select("conv", "task", "seq", "roles", "texts").join(chained.filter("task IS NOT NULL").select("task", "seq", "state", "audit"), ["task", "seq"])
    lines = lines.mapInArrow(_line_batches, f"conv {conv}, task int, seq long, lines string")
    hashed = lines.repartition("conv").sortWithinPartitions("conv", "task", "seq").mapInArrow(_hash_batches, f"conv {conv}, sha string")
    solved = chained.filter("task IS NULL").select("conv", *answer)
    solved = solved.alias("s").join(hashed.alias("h"), F.col("s.conv").eqNullSafe(F.col("h.conv"))).select("s.*", "h.sha")
    return whole.union(solved).withColumnsRenamed({"conv": "conv_id", "sha": "repaired_sha256"})


def repair_all(original: DataFrame, rows: DataFrame) -> DataFrame:
    """``repair(rows)`` for every conversation of ``original``; one that has no rows left costs nothing and is empty."""
    fixed = repair(rows).alias("f")
    every = original.select("conv_id").distinct().alias("o")
    joined = every.join(fixed, F.col("o.conv_id").eqNullSafe(F.col("f.conv_id")), "left")
    zeros = [F.coalesce(F.col(f"f.{c}"), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256(b"").hexdigest()
    return joined.select("o.conv_id", *zeros, F.coalesce("f.audit", F.lit("")).alias("audit"), F.coalesce("f.repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
