"""Reading SQL texts with patterns: tables, clauses, tokens, references (Column expressions)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from kitescope.functions import fixed_values as fixed

NO_STRINGS = "array<string>"


def strings(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast(NO_STRINGS)


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), group)


def tables_in_sql(sql: Column, keep_schema: bool = False) -> Column:
    """Distinct upper-case names after FROM, JOIN, INTO or UPDATE.

    Without the schema, names are plain identifiers and lose their prefix; with it, a name runs to
    the next white space, comma or closing bracket.
    """
    up = F.upper(F.coalesce(sql, F.lit("")))
    if keep_schema:
        return F.array_distinct(find_all(up, r"(?:FROM|JOIN|UPDATE|INTO)\s+([^\s,\)]+)", 1))
    names = find_all(up, r"\b(?:FROM|JOIN|INTO|UPDATE)\s+([A-Z_][A-Z0-9_.]*)", 1)
    return F.array_distinct(F.transform(names, lambda n: F.element_at(F.split(n, r"\."), -1)))


# --- fixed values: patterns that cut a statement into clauses ---------------------------------
CLAUSE_PATTERNS = {
    "select": r"(?s)SELECT\s+(.*?)\s+FROM",
    "from": r"FROM\s+([^\s]+)",
    "where": r"(?s)WHERE\s+(.*?)(?:\s+GROUP\s+BY|\s+ORDER\s+BY|\s+HAVING|$)",
    "join": r"((?:INNER|LEFT|RIGHT|OUTER|FULL)?\s*JOIN\s+[^\s]+(?:\s+ON\s+[^WHERE^GROUP^ORDER^HAVING]+)?)",
    "group_by": r"(?s)GROUP\s+BY\s+(.*?)(?:\s+HAVING|\s+ORDER\s+BY|$)",
    "having": r"(?s)HAVING\s+(.*?)(?:\s+ORDER\s+BY|$)",
    "order_by": r"(?s)ORDER\s+BY\s+(.*?)(?:\s+LIMIT|$)",
}
LISTED_CLAUSES = ["select", "group_by", "order_by"]
TOKEN_PATTERN = r"\w+|[^\w\s]"
SELECT_NAME_PATTERN = r"([A-Z_][A-Z0-9_]*)"
PREDICATE_NAME_PATTERN = r"([A-Z_][A-Z0-9_]*)\s*[=<>!]"


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def sql_component(sql: Column, clause: str) -> Column:
    """Q2: distinct upper-case parts of one clause; select, group by and order by split at commas."""
    up = _trimmed(F.upper(sql))
    pattern = CLAUSE_PATTERNS[clause]
    if clause == "join":
        return F.array_distinct(find_all(up, pattern, 1))
    present = up.rlike(pattern)
    body = F.regexp_extract(up, pattern, 1)
    if clause in LISTED_CLAUSES:
        found = F.array_distinct(F.transform(F.split(body, ","), _trimmed))
    else:
        found = F.array(body if clause == "from" else _trimmed(body))
    return F.when(present, found).otherwise(strings([]))


def sql_tokens(sql: Column) -> Column:
    """Q4: words and single symbols after dropping comments."""
    text = F.regexp_replace(sql, r"--.*?\n", " ")
    text = F.regexp_replace(text, r"(?s)/\*.*?\*/", " ")
    return find_all(text, TOKEN_PATTERN)


def column_references(sql: Column) -> Column:
    """Distinct upper-case names: the first of each selected item, and those before a comparison."""
    up = F.regexp_replace(F.upper(sql), r"'[^']*'", "")
    up = F.regexp_replace(up, r'"[^"]*"', "")
    up = F.regexp_replace(up, r"--.*?\n", " ")
    body = F.regexp_extract(up, CLAUSE_PATTERNS["select"], 1)
    names = F.transform(F.split(body, ","), lambda i: F.regexp_extract(i, SELECT_NAME_PATTERN, 1))
    picked = F.array_except(names, strings(fixed.SQL_AGGREGATES + [""]))
    compared = F.array_except(find_all(up, PREDICATE_NAME_PATTERN, 1), strings(fixed.SQL_PREDICATE_WORDS))
    return F.array_union(picked, compared)


def normalised(sql: Column) -> Column:
    """Layout and case folded: one space between words, none at the ends, lower case."""
    return F.lower(F.trim(F.regexp_replace(sql, r"\s+", " ")))


def lower_tokens(sql: Column) -> Column:
    """Lower-case words and symbols; quoted strings and numbers with a point stay whole."""
    return F.transform(find_all(sql, r"'[^']*'|\d+\.\d+|\w+|[^\w\s]"), F.lower)


def structure_flags(sql: Column) -> Column:
    """Which of the seven main clauses occur."""
    up = F.upper(sql)
    return F.array_compact(F.array(*[F.when(F.contains(up, F.lit(m)), F.lit(m)) for m in fixed.SQL_STRUCTURE_MARKS]))


def references(sql: Column) -> Column:
    """Distinct lower-case words over two characters that are no keywords."""
    words = F.transform(find_all(sql, r"\w+"), F.lower)
    return F.array_except(F.filter(words, lambda w: F.length(w) > 2), strings(fixed.SQL_REFERENCE_STOP))


def entities(sql: Column) -> Column:
    """Lower-case identifiers over one character that are no keywords, repeats kept."""
    stop = strings(fixed.SQL_ENTITY_STOP)
    # a digit cannot start an identifier, and no identifier starts inside a word
    words = F.filter(find_all(sql, r"\w+"), lambda w: w.rlike("^[A-Za-z_]"))
    low = F.transform(words, F.lower)
    return F.filter(low, lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w))


def complexity(sql: Column) -> Column:
    """Q15: 1 + 2 per join, 3 with a subquery mark, 2 grouped, 1 ordered, 2 with having."""
    up = F.upper(sql)
    nested = F.contains(up, F.lit("SUBQUERY")) | (F.contains(sql, F.lit("(")) & F.contains(sql, F.lit("SELECT")))
    parts = [
        F.lit(1.0),
        F.regexp_count(up, F.lit("JOIN")) * 2.0,
        F.when(nested, 3.0).otherwise(0.0),
        F.when(F.contains(up, F.lit("GROUP BY")), 2.0).otherwise(0.0),
        F.when(F.contains(up, F.lit("ORDER BY")), 1.0).otherwise(0.0),
        F.when(F.contains(up, F.lit("HAVING")), 2.0).otherwise(0.0),
    ]
    return reduce(lambda a, b: a + b, parts)
