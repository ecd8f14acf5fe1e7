"""Registered queries over question texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from kitescope.functions import fixed_values as fixed
from kitescope.functions import terms
from kitescope.plans.registry import query

BAR = "|"


def sql_list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


IDENT = (
    r"list_transform(list_filter(regexp_extract_all(question, '[\p{L}\p{N}_]+'), "
    r"lambda w: regexp_matches(w, '^[A-Z][A-Z_]+[A-Z]$')), lambda w: lower(w))"
)
WORDS = r"list_filter(string_split_regex(question, '\s+'), lambda w: w <> '')"
LONG = f"list_transform(list_filter({WORDS}, lambda w: length(w) > 3), lambda w: lower(trim(w, '{fixed.STRIPPED_PUNCTUATION}')))"
SUFFIXES = f"list_transform(list_filter({sql_list(fixed.COLUMN_SUFFIXES)}, lambda s: contains(lower(question), s)), lambda s: trim(s, '_'))"


def vocab_sql(words: list[str]) -> str:
    return f"list_filter({sql_list(words)}, lambda t: contains(lower(question), t))"


def first_match_sql(text: str, rules: list[tuple[str, list[str]]], default: str) -> str:
    arms = " ".join(
        "WHEN " + " OR ".join(f"contains({text}, '{w}')" for w in words) + f" THEN '{label}'" for label, words in rules
    )
    return f"CASE {arms} ELSE '{default}' END"


TYPES_REGEX = (
    "list_filter(["
    + ", ".join(
        rf"CASE WHEN regexp_matches(lower(question), '(^|[^\p{{L}}\p{{N}}_])({p})($|[^\p{{L}}\p{{N}}_])') THEN '{label}' END"
        for label, p in fixed.INTENT_WORD_PATTERNS
    )
    + "], lambda x: x IS NOT NULL)"
)


def _types_keywords_sql() -> str:
    parts = []
    for labels, words in fixed.INTENT_KEYWORDS:
        cond = " OR ".join(f"contains(lower(question), '{w}')" for w in words)
        parts.append(f"CASE WHEN {cond} THEN {sql_list(labels)} ELSE CAST([] AS VARCHAR[]) END")
    found = "list_concat(" + "list_concat(" + parts[0] + ", " + parts[1] + "), " + parts[2] + ")"
    return f"CASE WHEN len({found}) > 0 THEN {found} ELSE {sql_list(fixed.INTENT_DEFAULT)} END"


TYPES_KEYWORDS = _types_keywords_sql()


def joined_sql(expr: str, source: str = "q_order") -> str:
    return f"SELECT question_id, array_to_string({expr}, '|') AS terms FROM {source}"


def per_question(name: str, build, expr: str, source: str = "q_order") -> None:
    @query(name, joined_sql(expr, source))
    def run(c):
        return c(source).select("question_id", F.array_join(build(F.col("question")), BAR).alias("terms"))


per_question("t1_vocab_terms", terms.vocab_terms, vocab_sql(fixed.BUSINESS_TERMS))
per_question("t1_vocab_terms_short", lambda q: terms.vocab_terms(q, fixed.BUSINESS_TERMS_SHORT), vocab_sql(fixed.BUSINESS_TERMS_SHORT))
per_question("t2_identifier_terms", terms.identifier_terms, IDENT)
T3 = f"list_concat(list_concat({vocab_sql(fixed.BUSINESS_TERMS_SHORT)}, {IDENT}), {LONG})"


@query(
    "t3_word_terms",
    f"""WITH x AS (SELECT question_id, {T3} AS t FROM q_text)
SELECT question_id, array_to_string(list_filter(t, lambda w, i: list_position(t, w) = i), '|') AS terms FROM x""",
)
def t3_word_terms(c):
    return c("q_text").select("question_id", F.array_join(terms.word_terms(F.col("question")), BAR).alias("terms"))


per_question("t4_column_terms", terms.column_terms, f"list_concat({IDENT}, {SUFFIXES})")
per_question("t5_intent_types_regex", terms.intent_types_regex, TYPES_REGEX)
per_question("t6_intent_types_keywords", terms.intent_types_keywords, TYPES_KEYWORDS)
SEEDS = r"list_filter(string_split_regex(lower(question), '\s+'), lambda w: length(w) > 3)"
per_question("t7_seed_terms", terms.seed_terms, SEEDS, "q_text")
per_question("t7_seed_terms_first3", lambda q: terms.seed_terms(q, 3), f"({SEEDS})[1:3]", "q_text")


@query("t8_question_category", f"SELECT question_id, {first_match_sql('lower(question)', fixed.QUESTION_CATEGORIES, 'Other')} AS category FROM q_order")
def t8_question_category(c):
    return c("q_order").select("question_id", terms.question_category(F.col("question")).alias("category"))


def complexity_sql(col: str) -> str:
    medium = " + ".join(f"CAST(contains(lower({col}), '{m}') AS INT)" for m in fixed.MEDIUM_MARKS)
    hard = " OR ".join(f"contains(lower({col}), '{m}')" for m in fixed.COMPLEX_MARKS)
    return f"CASE WHEN {hard} THEN 'Complex' WHEN {medium} > 1 THEN 'Medium' ELSE 'Simple' END"


@query(
    "t9_complexity_level",
    f"""SELECT CAST(pair_id AS VARCHAR) AS id, {complexity_sql('truth_sql')} AS level FROM s_pairs
UNION ALL SELECT question_id, {complexity_sql('question')} FROM q_order""",
)
def t9_complexity_level(c):
    pairs = c("s_pairs").select(F.col("pair_id").cast("string").alias("id"), terms.complexity_level(F.col("truth_sql")).alias("level"))
    return pairs.unionByName(
        c("q_order").select(F.col("question_id").alias("id"), terms.complexity_level(F.col("question")).alias("level"))
    )


@query(
    "t10_question_stats",
    f"SELECT question_id, CAST(length(question) AS INT) AS n_chars, CAST(len({WORDS}) AS INT) AS n_terms FROM q_text",
)
def t10_question_stats(c):
    q = F.col("question")
    return c("q_text").select("question_id", terms.question_length(q).alias("n_chars"), terms.term_count(q).alias("n_terms"))
