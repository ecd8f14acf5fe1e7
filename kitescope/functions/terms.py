"""Question text to terms, types and labels (T1-T10), as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from kitescope.functions import fixed_values as fixed
from kitescope.functions.naming import contains_any, first_match

WORD_RUN = r"[\p{L}\p{N}_]+"


def _strings(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def _held(question: Column, words: list[str]) -> Column:
    """Words contained in the lower-cased question, which is made once and not for every word."""
    return F.transform(F.array(F.lower(question)), lambda low: F.filter(_strings(words), lambda t: F.contains(low, t)))[0]


def whitespace_words(text: Column) -> Column:
    """Words between white space, without empty strings."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def vocab_terms(question: Column, vocabulary: list[str] = fixed.BUSINESS_TERMS) -> Column:
    """Vocabulary words contained in the lower-cased question, in vocabulary order."""
    return _held(question, vocabulary)


def identifier_terms(question: Column) -> Column:
    """Upper-case identifiers of at least three characters, lower-cased, repeats kept.

    A run of word characters is taken whole, so an accented neighbour keeps a run from matching.
    """
    runs = F.regexp_extract_all(question, F.lit(WORD_RUN), 0)
    return F.transform(F.filter(runs, lambda w: w.rlike("^[A-Z][A-Z_]+[A-Z]$")), F.lower)


def long_words(question: Column) -> Column:
    """Words over three characters (measured first), stripped of punctuation and lower-cased."""
    words = F.filter(whitespace_words(question), lambda w: F.length(w) > 3)
    return F.transform(words, lambda w: F.lower(F.btrim(w, F.lit(fixed.STRIPPED_PUNCTUATION))))


def word_terms(question: Column, vocabulary: list[str] = fixed.BUSINESS_TERMS_SHORT) -> Column:
    """Distinct terms of T1, T2 and the long words, in that order."""
    return F.array_distinct(
        F.concat(vocab_terms(question, vocabulary), identifier_terms(question), long_words(question))
    )


def column_terms(question: Column) -> Column:
    """T4: identifiers plus column suffixes found in the question, suffixes without underscores."""
    found = _held(question, fixed.COLUMN_SUFFIXES)
    return F.concat(identifier_terms(question), F.transform(found, lambda s: F.btrim(s, F.lit("_"))))


def intent_types_regex(question: Column) -> Column:
    """T5: table types whose word pattern occurs in the question."""
    low = F.lower(question)
    edge = r"[\p{L}\p{N}_]"
    checks = [
        F.when(low.rlike(f"(?<!{edge})(?:{pattern})(?!{edge})"), F.lit(label))
        for label, pattern in fixed.INTENT_WORD_PATTERNS
    ]
    return F.array_compact(F.array(*checks))


def intent_types_keywords(question: Column) -> Column:
    """Table types by keyword groups, all common types when none applies."""
    low = F.lower(question)
    empty = _strings([])
    parts = [
        F.when(contains_any(low, words), _strings(labels)).otherwise(empty)
        for labels, words in fixed.INTENT_KEYWORDS
    ]
    found = F.concat(*parts)
    return F.when(F.size(found) > 0, found).otherwise(_strings(fixed.INTENT_DEFAULT))


def seed_terms(question: Column, first: int | None = None) -> Column:
    """Lower-case words over three characters; ``first`` keeps only the leading ones."""
    words = F.filter(whitespace_words(F.lower(question)), lambda w: F.length(w) > 3)
    return words if first is None else F.slice(words, 1, first)


def all_terms(question: Column) -> Column:
    """Every lower-case word of the question."""
    return whitespace_words(F.lower(question))


def question_category(question: Column) -> Column:
    """First keyword group that applies, else Other."""
    return first_match(F.lower(question), fixed.QUESTION_CATEGORIES, "Other")


def complexity_level(text: Column) -> Column:
    """Simple, Medium or Complex by marker words."""
    low = F.lower(text)
    medium = sum((F.contains(low, F.lit(m)).cast("int") for m in fixed.MEDIUM_MARKS), F.lit(0))
    return (
        F.when(contains_any(low, fixed.COMPLEX_MARKS), F.lit("Complex"))
        .when(medium > 1, F.lit("Medium"))
        .otherwise(F.lit("Simple"))
    )


def question_length(question: Column) -> Column:
    """Characters in the question."""
    return F.length(question)


def term_count(question: Column) -> Column:
    """Words in the question."""
    return F.size(whitespace_words(question))
