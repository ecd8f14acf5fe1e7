"""Secret scan: fixed patterns, and windows of high Shannon entropy inside candidate strings.

Base kinds are patterns; their matches are leftmost and non-overlapping per kind.  The entropy kinds slide a window of
fixed width over every run of one character class.  The window's symbol counts and the sum of c * log2(c) are carried
from step to step, so a step costs the same for any window width and grows with the alphabet, whose counts are an array;
entropy = log2(width) - sum / width.  Windows of high entropy that touch or overlap give one span, others one each, so
what lies between them stays.  Candidates that
an allow-list pattern matches add nothing, and neither do windows that touch a placeholder word; where a base span covers
a part of an entropy span, the rest of it stays.

Positions are code points, ends exclusive.  Defined results: a null or empty text has no spans; rows are judged one by
one, so repeated rows, null ids and extra columns change nothing; an empty table gives an empty result.  Everything
happens inside the row, without a shuffle.  Positions of many matches come from chunked prefix sums, so a long text with
n matches costs about n * CHUNK steps and never n squared list copies.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kitescope.llm.common import free_name

CHUNK = 128
MARK = "[secret]"


@dataclass(frozen=True)
class Pattern:
    """A base kind: matches whose ``group`` has fewer than ``least`` characters are dropped after matching."""

    kind: str
    regex: str
    group: int
    least: int


@dataclass(frozen=True)
class CharClass:
    """An entropy kind: runs of ``alphabet``, watched through a window of ``width`` characters."""

    kind: str
    regex: str
    alphabet: str
    width: int
    bits: float


# The three base patterns and their least lengths.
PATTERNS = (
    Pattern("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    Pattern("access", r"AKIA[A-Z0-9]+", 0, 20),
    Pattern("hex", r"[0-9a-f]{24,}", 0, 24),
)
CLASSES = (
    CharClass("entropy_hex", r"[0-9A-Fa-f]{20,}", "0123456789abcdefABCDEF", 20, 2.9),
    CharClass("entropy_text", r"[A-Za-z0-9+/_=-]{24,}",
              "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-", 24, 3.9),
)
#: A candidate that one of these matches is no secret: no digit or no letter in it, a UUID, words joined by signs.
ALLOWED = (
    r"^[^0-9]*$",
    r"^[^A-Za-z]*$",
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"^/?[A-Za-z]+(?:[-_/=+]+(?:[A-Za-z]+|[0-9]{1,8}))*/?$",
)
#: A window that touches one of these is no secret; other windows of its candidate may be.
PLACEHOLDER = r"(?i)example|sample|placeholder|x{6,}"
KINDS = tuple(p.kind for p in PATTERNS) + tuple(c.kind for c in CLASSES)


def _running(values: Column, zero: Column, step) -> Column:
    """For each element of ``values``, the fold of those before it; folded in chunks of CHUNK."""
    chunks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(values) - 1) / CHUNK).cast("int")),
        lambda c: F.slice(values, c * CHUNK + 1, F.lit(CHUNK)))
    with_own = F.transform(chunks, lambda part: F.struct(part.alias("part"), F.aggregate(part, zero, step).alias("own")))
    folded = F.transform(with_own, lambda x, c: F.struct(
        x["part"].alias("part"), F.aggregate(F.slice(with_own, F.lit(1), c), zero, lambda a, y: step(a, y["own"])).alias("before")))
    return F.flatten(F.transform(folded, lambda x: F.transform(
        x["part"], lambda v, i: F.aggregate(F.slice(x["part"], F.lit(1), i), x["before"], step))))


def _starts(pieces: Column, lengths: Column) -> Column:
    """Code point positions of matches, given the pieces between them and their lengths."""
    gaps = F.transform(lengths, lambda n, i: n + F.length(pieces[i]))
    before = _running(gaps, F.lit(0), lambda a, x: a + x)
    return F.transform(before, lambda at, i: at + F.length(pieces[i]))


def _found(text: Column, regex: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(regex), F.lit(group))


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is mentioned."""
    return F.transform(F.array(value), use)[0]


def _weight(n: Column) -> Column:
    return F.when(n > 0, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))


def _placeholders(m: Column) -> Column:
    """For each character of ``m``, whether it belongs to a placeholder word; null if there is none."""
    words, gaps = _found(m, PLACEHOLDER), F.split(m, PLACEHOLDER)
    until = F.transform(words, lambda x, i: F.concat(F.array_repeat(F.lit(False), F.length(gaps[i])), F.array_repeat(F.lit(True), F.length(x))))
    return F.when(m.rlike(PLACEHOLDER), F.concat(F.flatten(until), F.array_repeat(F.lit(False), F.length(F.element_at(gaps, -1)))))


def _windows(codes: Column, holders: Column, c: CharClass) -> Column:
    """Spans (first, last) that windows of high entropy cover, ends exclusive; ``holders`` as of _placeholders."""
    w = c.width
    zero = F.struct(
        F.array_repeat(F.lit(0), len(c.alphabet)).alias("counts"), F.lit(0.0).alias("total"), F.lit(-1).alias("first"), F.lit(-1).alias("last"),
        F.lit(-1).alias("holder"), F.array().cast("array<struct<first:int,last:int>>").alias("done"))

    def closed(a: Column) -> Column:
        return F.concat(a["done"], F.array(F.struct(a["first"], a["last"])))

    def step(a: Column, i: Column) -> Column:
        came, left = codes[i], F.when(i >= w, codes[F.greatest(i - w, F.lit(0))]).otherwise(F.lit(-1))
        counts = F.transform(a["counts"], lambda n, k: n + F.when(k == came, 1).otherwise(0) - F.when(k == left, 1).otherwise(0))
        up, down = a["counts"][came], a["counts"][F.greatest(left, F.lit(0))]
        change = F.when(came == left, F.lit(0.0)).otherwise(
            _weight(up + 1) - _weight(up) + F.when(left >= 0, _weight(down - 1) - _weight(down)).otherwise(F.lit(0.0)))
        total = a["total"] + change
        holder = F.when(holders[i], i).otherwise(a["holder"])
        high = (i >= w - 1) & (holder < i - (w - 1)) & (F.round(F.lit(math.log2(w)) - total / w, 9) >= c.bits)
        # A window that begins beyond the last span begins a new one.
        opens = high & (i - (w - 1) > a["last"])
        return F.struct(
            counts.alias("counts"), total.alias("total"),
            F.when(opens, i - (w - 1)).otherwise(a["first"]).alias("first"),
            F.when(high, i + 1).otherwise(a["last"]).alias("last"),
            holder.alias("holder"),
            F.when(opens & (a["first"] >= 0), closed(a)).otherwise(a["done"]).alias("done"))

    return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), zero, step, lambda a: F.when(a["first"] >= 0, closed(a)).otherwise(a["done"]))


def _uncovered(x: Column, base: Column) -> Column:
    """The parts of span ``x`` that no span of ``base`` covers; ``base`` is sorted."""
    over = F.filter(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))

    def left(over: Column) -> Column:
        # Before each covering span lies a gap if all earlier ones have ended; the last gap ends with x.
        stops = F.concat(F.transform(over, lambda b: b["start"]), F.array(x["end"]))
        ends = F.concat(F.transform(over, lambda b: b["end"]), F.array(x["end"]))
        gaps = F.arrays_zip(_running(ends, x["start"], lambda a, e: F.greatest(a, e)).alias("start"), stops.alias("end"))
        return F.filter(F.transform(gaps, lambda g: F.struct(g["start"].alias("start"), x["kind"].alias("kind"), g["end"].alias("end"))),
                        lambda part: part["start"] < part["end"])

    return _once(over, lambda over: F.when(F.size(over) == 0, F.array(x)).otherwise(left(over)))


def _none() -> Column:
    return F.array().cast("array<struct<start:int,kind:int,end:int>>")


def _span(start: Column, kind: int, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), F.lit(kind).alias("kind"), end.cast("int").alias("end"))


def scan(docs: DataFrame, text_col: str = "text", into: str = "secrets") -> tuple[DataFrame, str]:
    """``docs`` with a struct (base, spans) of sorted span lists; returns the frame and the struct's name.

    A span has start, kind (position in KINDS) and end.
    """
    name = free_name(docs, into)
    kept = [F.col(f"`{c}`") for c in docs.columns]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    s = F.col(f"`{name}`")
    every = [(p.kind, p.regex) for p in PATTERNS] + [(c.kind, c.regex) for c in CLASSES]
    # Each pass is its own projection, so that no match list is computed twice.
    work = docs.select(*kept, F.struct(
        *[_found(text, regex).alias(kind) for kind, regex in every]).alias(name))
    work = work.select(*kept, F.struct(*[s[kind].alias(kind) for kind, _ in every], *[
        F.when(F.size(s[kind]) > 0, F.split(text, regex)).alias(f"{kind}_gaps") for kind, regex in every], *[
        F.when(F.size(s[p.kind]) > 0, _found(text, p.regex, p.group)).alias(f"{p.kind}_value") for p in PATTERNS if p.group]).alias(name))
    work = work.select(*kept, F.struct(*[s[kind].alias(kind) for kind, _ in every], *[
        F.when(F.size(s[kind]) > 0, _starts(s[f"{kind}_gaps"], F.transform(s[kind], lambda m: F.length(m)))).alias(f"{kind}_at")
        for kind, _ in every], *[s[f"{p.kind}_value"].alias(f"{p.kind}_value") for p in PATTERNS if p.group]).alias(name))

    def base_spans(number: int, p: Pattern) -> Column:
        value = s[f"{p.kind}_value"] if p.group else s[p.kind]
        spans = F.transform(s[p.kind], lambda m, i: F.when(
            F.length(value[i]) >= p.least, _span(s[f"{p.kind}_at"][i], number, s[f"{p.kind}_at"][i] + F.length(m))))
        return F.when(F.size(s[p.kind]) > 0, F.filter(spans, lambda x: x.isNotNull())).otherwise(_none())

    def entropy_spans(number: int, c: CharClass) -> Column:
        def region(m: Column, i: Column) -> Column:
            allowed = F.lit(False)
            for regex in ALLOWED:
                allowed = allowed | m.rlike(regex)
            codes = F.transform(F.split(m, ""), lambda x: F.instr(F.lit(c.alphabet), x) - 1)
            both = F.struct(codes.alias("codes"), _placeholders(m).alias("holders"))
            r = F.when(~allowed, _once(both, lambda x: _windows(x["codes"], x["holders"], c)))
            return F.struct(r.alias("r"), s[f"{c.kind}_at"][i].alias("at"))

        spans = F.flatten(F.transform(
            F.filter(F.transform(s[c.kind], region), lambda x: F.size(x["r"]) > 0),
            lambda x: F.transform(x["r"], lambda part: _span(x["at"] + part["first"], number, x["at"] + part["last"]))))
        return F.when(F.size(s[c.kind]) > 0, spans).otherwise(_none())

    base = F.sort_array(F.concat(*[base_spans(i, p) for i, p in enumerate(PATTERNS)]))
    more = F.concat(*[entropy_spans(len(PATTERNS) + i, c) for i, c in enumerate(CLASSES)])
    work = work.select(*kept, F.struct(base.alias("base"), more.alias("more")).alias(name))
    apart = F.flatten(F.transform(s["more"], lambda x: _uncovered(x, s["base"])))
    return work.select(*kept, F.struct(
        s["base"].alias("base"), F.when(F.size(s["more"]) == 0, s["base"]).otherwise(F.sort_array(F.concat(s["base"], apart))).alias("spans"),
    ).alias(name)), name


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", kinds[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == KINDS.index(kind))).cast("long")


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", mark: str = MARK) -> DataFrame:
    """``docs`` with every span of a secret replaced by ``mark``; overlapping spans share one mark.

    A length column, where there is one and it is not null, follows the changed text.  Columns and rows stay.
    """
    found, name = scan(docs, text_col)
    s = F.col(f"`{name}`")["spans"]
    text = F.col(f"`{text_col}`")
    ends = _running(F.transform(s, lambda x: x["end"]), F.lit(0), lambda a, x: F.greatest(a, x))
    # Cutting a list of code points costs the length of each piece; substring would walk from the text's start every time.
    letters = F.split(text, "")
    whole = found.select(*[F.col(f"`{c}`") for c in docs.columns], F.when(F.size(s) > 0, F.struct(
        s.alias("spans"), letters.alias("letters"), ends.alias("ends"),
        F.aggregate(s, F.lit(0), lambda a, x: F.greatest(a, x["end"])).alias("last"))).alias(name))
    w = F.col(f"`{name}`")
    pieces = F.transform(w["spans"], lambda x, i: F.when(x["start"] >= w["ends"][i], F.concat(
        F.array_join(F.slice(w["letters"], w["ends"][i] + 1, x["start"] - w["ends"][i]), ""), F.lit(mark))).otherwise(F.lit("")))
    tail = F.array_join(F.slice(w["letters"], w["last"] + 1, F.greatest(F.size(w["letters"]) - w["last"], F.lit(0))), "")
    clean = F.when(w.isNull(), text).otherwise(F.concat(F.array_join(pieces, ""), tail))
    out = whole.select(*[(clean if c == text_col else F.col(f"`{c}`")).alias(c) for c in docs.columns], w.isNotNull().alias(name))
    if length_col in docs.columns:
        n = F.col(f"`{length_col}`")
        kind = docs.schema[length_col].dataType
        fresh = F.when(F.col(f"`{name}`") & n.isNotNull(), F.length(F.col(f"`{text_col}`")).cast(kind)).otherwise(n)
        out = out.select(*[(fresh if c == length_col else F.col(f"`{c}`")).alias(c) for c in docs.columns])
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
