"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document.  The ledger keeps the measurements and one bit per failed rule, so a new
policy version, or the question what a single rule costs, is bit arithmetic on the ledger and needs no text again.

Defined results: a null or empty text has no words and fails ``few_words``.  Rows are judged one by one, so repeated
rows, repeated or null ids and extra columns change nothing.  An empty table gives an empty ledger.  All work on one
text happens inside its row, without a shuffle; repeated windows are found by sorting hashes, so a very long text
costs n log n.  Windows are compared by 64-bit hashes within one text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kitescope.llm.common import BLANK_RUN, NOT_BLANK, free_name, keep_where, split_words, store

WINDOW = 5
#: Letters of scripts that put no blanks between words, as a Java character class.
UNSPACED = "".join(rf"\p{{Is{x}}}" for x in ("Han", "Hiragana", "Katakana", "Bopomofo", "Yi", "Thai", "Lao", "Khmer", "Myanmar", "Tibetan"))


@dataclass(frozen=True)
class Rule:
    """A named test on measurements; true means that the document fails."""

    name: str
    fails: Callable[[Column], Column]


def _word_length(m: Column) -> Column:
    return (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 14 * m["n_words"])


#: Bit i of a ledger belongs to RULES[i]; rules are only ever appended.
RULES = (
    Rule("few_words", lambda m: m["n_words"] < 10),
    Rule("repeated_words", lambda m: 100 * m["n_repeat_words"] > 20 * m["n_words"]),
    Rule("symbols", lambda m: 20 * m["n_symbols"] > m["n_words"]),
    Rule("repeated_lines", lambda m: (m["n_lines"] >= 5) & (100 * m["n_dup_lines"] > 50 * m["n_lines"])),
    Rule("word_length", _word_length),
    Rule("shouting", lambda m: 100 * m["n_upper"] > 50 * m["word_chars"]),
    # Where most letters belong to scripts without blanks, a run between blanks is no word and its length says nothing.
    Rule("spaced_word_length", lambda m: (2 * m["n_unspaced"] <= m["n_letters"]) & _word_length(m)),
)
BASE_RULES = ("few_words", "repeated_words")

#: Policy versions: the rules that reject a document.
POLICIES = {
    "base": BASE_RULES,
    "v1": BASE_RULES + ("symbols", "repeated_lines"),
    "v2": BASE_RULES + ("symbols", "repeated_lines", "word_length", "shouting"),
    "v3": BASE_RULES + ("symbols", "repeated_lines", "spaced_word_length", "shouting"),
}
CURRENT = "v3"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_unspaced", "n_letters")


def mask_of(rules, known=RULES) -> int:
    """The bits of the named rules."""
    names = [r.name for r in known]
    return sum(1 << names.index(r) for r in set(rules))


def measure(docs: DataFrame, text_col: str = "text", into: str = "quality") -> tuple[DataFrame, str]:
    """``docs`` with a struct of all measurements; returns the frame and the struct's name."""
    name = free_name(docs, into)
    kept = [F.col(f"`{c}`") for c in docs.columns]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(NOT_BLANK))
    # One struct column travels beside the given columns, so their names cannot clash with working names.
    work = docs.select(*kept, F.struct(
        split_words(text, BLANK_RUN).alias("words"),
        lines.alias("lines"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(text, r"[^A-Z]+", "")).cast("long").alias("n_upper"),
        # Both counts are 0 where no such letter is; most texts end with the search for one.
        *[F.when(text.rlike(f"[{UNSPACED}]"), F.length(F.regexp_replace(text, others, ""))).otherwise(F.lit(0)).cast("long").alias(c)
          for c, others in (("n_unspaced", f"[^{UNSPACED}]+"), ("n_letters", r"[^\p{L}\p{M}]+"))],
    ).alias(name))
    w = F.col(f"`{name}`")
    hashes = F.transform(w["words"], lambda x: F.xxhash64(x))
    work = work.select(*kept, F.struct(
        F.size(w["words"]).cast("long").alias("n_words"),
        F.length(F.array_join(w["words"], "")).cast("long").alias("word_chars"),
        w["n_symbols"].alias("n_symbols"),
        (F.size(w["lines"]) - F.size(F.array_distinct(w["lines"]))).cast("long").alias("n_dup_lines"),
        F.size(w["lines"]).cast("long").alias("n_lines"),
        w["n_upper"].alias("n_upper"),
        w["n_unspaced"].alias("n_unspaced"),
        w["n_letters"].alias("n_letters"),
        hashes.alias("hashes"),
    ).alias(name))
    h, n = w["hashes"], w["n_words"].cast("int")
    windows = F.when(n >= WINDOW, F.transform(
        F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[h[i + k] for k in range(WINDOW)]),
    )).otherwise(F.array().cast("array<bigint>"))
    first = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_upper", "n_unspaced", "n_letters"]
    work = work.select(*kept, F.struct(*[w[c].alias(c) for c in first], windows.alias("windows")).alias(name))
    # Most texts repeat no window: counting distinct hashes is cheap and spares them the sort.
    repeats = F.size(F.array_distinct(w["windows"])) < F.size(w["windows"])
    pairs = F.sort_array(F.transform(w["windows"], lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    work = work.select(*kept, F.struct(*[w[c].alias(c) for c in first], F.when(repeats, pairs).alias("pairs")).alias(name))
    p = w["pairs"]
    last = F.size(p) - 1
    twice = F.filter(
        F.transform(p, lambda x, k: F.when(
            ((k > 0) & (p[F.greatest(k - 1, F.lit(0))]["h"] == x["h"])) | ((k < last) & (p[F.least(k + 1, last)]["h"] == x["h"])),
            x["i"])),
        lambda i: i.isNotNull())
    covered = F.aggregate(
        F.sort_array(twice), F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])
    out = {c: w[c] for c in first} | {"n_repeat_words": F.when(p.isNull(), F.lit(0).cast("long")).otherwise(covered)}
    return work.select(*kept, F.struct(*[out[c].alias(c) for c in MEASURES]).alias(name)), name


def bits_of(measures: Column, rules=RULES) -> Column:
    """The failure bits for a struct of measurements."""
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(rules):
        bits = bits + F.when(rule.fails(measures), F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
    return bits


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """One row per document: id, measurements and ``fail_bits``."""
    work, name = measure(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")))
    return work.select("doc_id", f"{name}.*", bits_of(F.col(name), rules).alias("fail_bits"))


def stored_ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """``ledger`` written once under the shared folder; policies and ablations read it and never a text."""
    return store(ledger(docs, id_col, text_col, rules), "ledger")


def passes(bits: Column, policy: str = CURRENT, policies=POLICIES) -> Column:
    """Whether a document with these failure bits is kept under a policy version."""
    return bits.bitwiseAND(F.lit(mask_of(policies[policy])).cast("long")) == 0


def filter_documents(docs: DataFrame, text_col: str = "text", policy: str = CURRENT) -> DataFrame:
    """The documents that a policy keeps, with their columns as they were."""
    work, name = measure(docs, text_col)
    return keep_where(work, passes(bits_of(F.col(f"`{name}`")), policy), docs.columns)


def ablation(rows: DataFrame, policy: str = CURRENT, by: tuple[str, ...] = ()) -> DataFrame:
    """What each rule of a policy rejects, alone and with others, from ledger rows and their bits only.

    Columns: ``by``, rule, n_docs, n_failed, n_only (rejected by this rule and no other), n_kept, n_kept_without.
    The ledger folds to one row per group and bit pattern before the rules are spread out.
    """
    mask = mask_of(POLICIES[policy])
    patterns = rows.groupBy(*by, F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    names = [r.name for r in RULES]
    spread = patterns.withColumn("rule", F.explode(F.array(*[F.lit(r) for r in POLICIES[policy]])))
    bit = F.create_map(*[x for r in POLICIES[policy] for x in (F.lit(r), F.lit(1 << names.index(r)).cast("long"))])[F.col("rule")]
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return spread.withColumn("bit", bit).groupBy(*by, "rule").agg(
        F.sum("n").alias("n_docs"),
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n"))), F.lit(0)).alias("n_only"),
        F.coalesce(F.sum(F.when(F.col("bits") == 0, F.col("n"))), F.lit(0)).alias("n_kept"),
        F.coalesce(F.sum(F.when((F.col("bits") == 0) | (F.col("bits") == F.col("bit")), F.col("n"))), F.lit(0)).alias("n_kept_without"),
    )
