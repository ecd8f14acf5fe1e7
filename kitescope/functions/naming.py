"""Rules that read meaning from names and values, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from kitescope.functions import fixed_values as fixed


def contains_any(text: Column, words: list[str]) -> Column:
    """True when ``text`` contains one of ``words``."""
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def first_match(text: Column, rules: list[tuple[str, list[str]]], default: str) -> Column:
    """Label of the first rule with a word inside ``text``; null text takes the default."""
    branches = [F.when(contains_any(text, words), F.lit(label)) for label, words in rules]
    return F.coalesce(*branches, F.lit(default))


def table_type(name: Column) -> Column:
    """K1: table type from naming habits."""
    return first_match(F.upper(name), fixed.TABLE_TYPE_MARKS, "unknown")


def column_category(name: Column) -> Column:
    """K2: column category from naming habits; ``id`` inside any word counts."""
    return first_match(F.lower(name), fixed.COLUMN_CATEGORY_MARKS, "unknown")


def value_type(value: Column, is_number: Column | bool = False) -> Column:
    """K3: kind of a sampled value, given as text plus a flag for numeric sources."""
    numeric = F.lit(is_number) if isinstance(is_number, bool) else is_number
    digits_only = F.regexp_replace(value, "[-/]", "").rlike("^[0-9]+$")
    return (
        F.when(value.isNull(), F.lit("unknown"))
        .when(numeric, F.lit("numeric"))
        .when((F.length(value) <= 10) & digits_only, F.lit("date"))
        .when(F.length(value) <= 50, F.lit("categorical"))
        .otherwise(F.lit("text"))
    )


def _relationship_rules(column_name: Column) -> list[tuple[Column, str, float]]:
    low = F.lower(column_name)
    return [
        (low.endswith("_sk"), "SURROGATE_KEY", 0.95),
        (low == "smcp", "SMCP_MATCH", 0.95),
        (low.contains("_id") | low.contains("_key"), "KEY_MATCH", 0.90),
        (low.endswith("_code"), "CODE_MATCH", 0.85),
        ((low == "key") | low.endswith("id"), "ID_MATCH", 0.80),
    ]


#: The same rules as patterns over lower-case names.
_RELATIONSHIP_PATTERNS = [r"_sk\z", r"\Asmcp\z", r"_id|_key", r"_code\z", r"\Akey\z|id\z"]


def relationship_type(column_name: Column) -> Column:
    """K8 (label): what an equally named column pair says about two tables."""
    return F.coalesce(*[F.when(test, F.lit(label)) for test, label, _ in _relationship_rules(column_name)], F.lit("NO_MATCH"))


def relationship_confidence(column_name: Column) -> Column:
    """K8 (score): confidence that goes with :func:`relationship_type`."""
    return F.coalesce(*[F.when(test, F.lit(score)) for test, _, score in _relationship_rules(column_name)], F.lit(0.0))


def supports_relationship(column_name: Column, min_confidence: float) -> Column:
    """Whether the confidence lies above a bound, by one look at the name; rules stand in falling order of it."""
    patterns = [p for p, score in zip(_RELATIONSHIP_PATTERNS, (0.95, 0.95, 0.90, 0.85, 0.80)) if score > min_confidence]
    return F.lower(column_name).rlike("|".join(patterns)) if patterns else F.lit(False)


def stable_id(*parts: Column) -> Column:
    """Deterministic identifier of a natural key."""
    return F.md5(F.concat_ws("\u0001", *parts))
