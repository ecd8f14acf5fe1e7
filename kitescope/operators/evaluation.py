"""Running methods over question sets and judging their rankings.

A run is long: (question_id, method, rank, entity).  Truth is (question_id, entity, importance).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from kitescope.functions.sqltext import tables_in_sql
from kitescope.operators.search import top_by

__all__ = ["tables_in_sql"]

PRECISION_CUTS = [1, 3, 5]
HIT_CUTS = [3, 5, 10]


def run_methods(outputs: dict[str, DataFrame]) -> DataFrame:
    """Every method's output as one run, names trimmed, blanks and repeats dropped, re-ranked."""
    parts = [df.select("question_id", F.lit(m).alias("method"), "rank", "entity") for m, df in outputs.items()]
    return clean_run(reduce(DataFrame.unionByName, parts))


def clean_run(run: DataFrame) -> DataFrame:
    """Trim, drop blanks, keep the first of repeated names, number again."""
    named = run.withColumn("entity", F.trim("entity")).filter(F.col("entity") != "")
    first = named.groupBy("question_id", "method", "entity").agg(F.min("rank").alias("first_rank"))
    return top_by(first, ["question_id", "method"], ["first_rank", "entity"], None).drop("first_rank")


def pivot_wide(run: DataFrame, cells: DataFrame, methods: list[str]) -> DataFrame:
    """One row per question with each method's names, count and seconds."""
    lists = run.groupBy("question_id", "method").agg(
        F.expr("listagg(entity, '; ') WITHIN GROUP (ORDER BY rank)").alias("names"), F.count("*").alias("n")
    )
    filled = cells.select("question_id", "method", "seconds").join(lists, ["question_id", "method"], "left")
    return filled.groupBy("question_id").pivot("method", methods).agg(
        F.coalesce(F.first("names"), F.lit("No tables found")).alias("Tables"),
        F.coalesce(F.first("n"), F.lit(0)).alias("Count"),
        F.round(F.first("seconds"), 3).alias("Duration_sec"),
    )


def method_performance(evaluation: DataFrame) -> DataFrame:
    """Seconds over all questions, tables over successful ones, success share; unsuccessful methods are left out."""
    hit = F.col("n_tables") > 0
    return (
        evaluation.groupBy("method").agg(
            F.avg("seconds").alias("avg_seconds"),
            F.sum("n_tables").alias("tables"), F.count_if(hit).alias("successes"), F.count("*").alias("questions"),
        )
        .filter(F.col("successes") > 0)
        .select(
            "method", F.round("avg_seconds", 6).alias("avg_seconds"),
            F.round(F.col("tables") / F.col("successes"), 6).alias("avg_tables"),
            F.round(F.col("successes") / F.col("questions") * 100, 6).alias("success_pct"),
        )
    )


def cross_method_union(run: DataFrame) -> DataFrame:
    """Methods with results and distinct entities over all of them, per question."""
    pairs = run.groupBy("question_id", "entity").agg(F.count("*").alias("n"))
    names = pairs.groupBy("question_id").agg(F.count("*").alias("unique_tables"))
    methods = run.select("question_id", "method").distinct().groupBy("question_id").agg(F.count("*").alias("successful_methods"))
    return names.join(methods, "question_id")


def basic_summary(evaluation: DataFrame) -> DataFrame:
    """E5: mean count, success share, mean seconds, number of questions per method."""
    return evaluation.groupBy("method").agg(
        F.round(F.avg("n_tables"), 2).alias("avg_tables_per_query"),
        F.round(F.count_if(F.col("n_tables") > 0) / F.count("*") * 100, 1).alias("success_rate_pct"),
        F.round(F.avg("seconds"), 3).alias("avg_duration_sec"),
        F.count("*").alias("total_queries"),
    )


def match_positions(run: DataFrame, truth: DataFrame) -> DataFrame:
    """(question_id, method, entity, position) - first rank matching each true entity.

    Names match when equal or one contains the other, in any case.  A prediction can only match a truth of
    its own question, so the two meet by question and work grows with the lists of single questions.
    """
    said = run.select("question_id", "method", "rank", F.lower("entity").alias("said"))
    meant = truth.select("question_id", "entity", F.lower("entity").alias("meant"))
    matched = F.contains("said", "meant") | F.contains("meant", "said")
    return (
        meant.join(said, "question_id").filter(matched)
        .groupBy("question_id", "method", "entity").agg(F.min("rank").alias("position"))
    )


def main_entities(truth: DataFrame) -> DataFrame:
    """(question_id, main, needed): the most important true entity and the number of true entities."""
    return truth.groupBy("question_id").agg(
        F.min_by("entity", F.struct(-F.col("importance"), F.col("entity"))).alias("main"), F.count("*").alias("needed")
    )


def retrieval_metrics(cells: DataFrame, positions: DataFrame, truth: DataFrame) -> DataFrame:
    """precision@k of the main entity, hit@k of any, coverage, per question and method.

    A cell with no prediction or no truth scores false and zero throughout.
    """
    mains = main_entities(truth)
    placed = positions.join(mains.select("question_id", "main"), "question_id")
    best = placed.groupBy("question_id", "method").agg(
        F.min(F.when(F.col("entity") == F.col("main"), F.col("position"))).alias("main_position"),
        F.min("position").alias("any_position"),
        F.count("*").alias("found"),
    )
    joined = cells.select("question_id", "method").join(best, ["question_id", "method"], "left").join(
        mains.select("question_id", "needed"), "question_id", "left"
    )
    within = lambda c, k: F.coalesce(F.col(c) <= k, F.lit(False))
    found = F.coalesce(F.col("found"), F.lit(0))
    needed = F.coalesce(F.col("needed"), F.lit(0))
    return joined.select(
        "question_id", "method",
        *[within("main_position", k).alias(f"precision_at_{k}") for k in PRECISION_CUTS],
        *[within("any_position", k).alias(f"hit_at_{k}") for k in HIT_CUTS],
        F.coalesce(F.try_divide(found * 100.0, needed), F.lit(0.0)).alias("coverage"),
        found.alias("tables_found"), needed.alias("tables_needed"), (found > 0).alias("retrieval_success"),
    )


def truth_matches(cells: DataFrame, positions: DataFrame, truth: DataFrame) -> DataFrame:
    """E10 lists in long form: every true entity of every cell with its position, null if unmatched."""
    wanted = cells.select("question_id", "method").join(truth.select("question_id", "entity"), "question_id")
    return wanted.join(positions, ["question_id", "method", "entity"], "left")


def metric_inconsistencies(reported: DataFrame, computed: DataFrame) -> DataFrame:
    """Cells whose reported flags differ from the computed ones, with the differences spelled out.

    Both frames carry precision_at_1/3/5 and hit_at_3/5/10; a missing reported flag differs too.
    """
    flags = [(f"precision_at_{k}", f"Precision@{k}") for k in PRECISION_CUTS] + [(f"hit_at_{k}", f"Recall@{k}") for k in HIT_CUTS]
    joined = reported.alias("r").join(computed.alias("c"), ["question_id", "method"])
    notes = [
        F.when(
            ~F.col(f"r.{flag}").eqNullSafe(F.col(f"c.{flag}")),
            F.concat(
                F.lit(f"{label}: reported="), F.coalesce(F.col(f"r.{flag}").cast("string"), F.lit("none")),
                F.lit(", computed="), F.col(f"c.{flag}").cast("string"),
            ),
        )
        for flag, label in flags
    ]
    return joined.select("question_id", "method", F.concat_ws("; ", *notes).alias("inconsistencies")).filter(F.col("inconsistencies") != "")


# --- answers of judges ------------------------------------------------------------------------------

JUDGE_FLAGS = [
    "precision_at_1", "precision_at_3", "precision_at_5",
    "recall_at_3", "recall_at_5", "recall_at_10",
    "hit_rate_at_3", "hit_rate_at_5", "hit_rate_at_10",
]
SCORE_KEYS = [
    "semantic_equivalence", "syntactic_correctness", "logical_structure",
    "efficiency", "completeness", "overall_quality",
]


def json_part(response: Column) -> Column:
    """From the first opening to the last closing brace, or everything when there is none."""
    fenced = F.trim(response)
    body = F.when(fenced.startswith("```json"), F.trim(F.replace(F.replace(fenced, F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")))).otherwise(fenced)
    cut = F.regexp_extract(body, r"(?s)\{.*\}", 0)
    return F.when(cut != "", cut).otherwise(body)


def _parsed(response: Column, fields: list[str]) -> Column:
    schema = ", ".join(f"{f} string" for f in fields) + ", broken string"
    return F.from_json(json_part(response), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})


def _clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def _said_true(low: Column, name: str) -> Column:
    return low.rlike(f'"{name}":\\s*true') | low.rlike(f"{name}.*true") | low.rlike(f"{name}.*yes")


def parse_judgements(responses: DataFrame) -> DataFrame:
    """Typed metrics from written judgements; unreadable ones fall back to patterns.

    ``responses`` has question_id, method, response and, where known, n_predicted, the length of the judged list.  Coverage is kept in 0-100 and confidence in
    0-1; hit rates default to the recall of the same cut.
    """
    fields = JUDGE_FLAGS + ["ground_truth_tables", "coverage_percentage", "tables_found", "tables_needed", "confidence", "explanation", "retrieval_success", "most_important_table"]
    rows = responses.withColumn("j", _parsed(F.col("response"), fields)).withColumn("low", F.lower("response"))
    readable = F.col("j").isNotNull() & F.col("j.broken").isNull()
    j = lambda name: F.col(f"j.{name}")
    truthy = lambda c: F.coalesce((F.lower(c) == "true") | (c.try_cast("double") != 0), F.lit(False))
    number = lambda c: F.coalesce(c.try_cast("double"), F.lit(0.0))
    low = F.col("low")
    flags = []
    for name in JUDGE_FLAGS:
        if name.startswith("hit_rate"):
            partner = name.replace("hit_rate", "recall")
            good = F.when(j(name).isNull(), truthy(j(partner))).otherwise(truthy(j(name)))
            loose = _said_true(low, name) | _said_true(low, partner)
        else:
            good, loose = truthy(j(name)), _said_true(low, name)
        flags.append(F.when(readable, good).otherwise(loose).alias(name))
    digits = lambda name: F.coalesce(
        F.regexp_extract(low, name + r".*?([0-9.]+)", 1).try_cast("double"), F.lit(None).cast("double")
    )
    # the list of an unreadable answer: quoted names inside the first brackets after its key
    listed = F.regexp_extract("response", r"(?s)ground_truth_tables.*?\[(.*?)\]", 1)
    loose_tables = F.regexp_extract_all(listed, F.lit('"([^"]+)"'), F.lit(1))
    tables = F.when(readable, F.coalesce(F.from_json(j("ground_truth_tables"), "array<string>"), F.array().cast("array<string>"))).otherwise(loose_tables)
    predicted = F.col("n_predicted") if "n_predicted" in responses.columns else F.lit(None)
    any_five = _said_true(low, "recall_at_5") | _said_true(low, "hit_rate_at_5") | _said_true(low, "precision_at_5")
    return rows.select(
        "question_id", "method", *flags,
        F.when(readable, _clamp(number(j("coverage_percentage")), 0.0, 100.0))
        .otherwise(_clamp(F.coalesce(digits("coverage_percentage"), F.lit(0.0)), 0.0, 100.0)).alias("coverage_percentage"),
        F.when(readable, _clamp(number(j("confidence")), 0.0, 1.0))
        .otherwise(_clamp(F.coalesce(digits("confidence"), F.lit(0.5)), 0.0, 1.0)).alias("confidence"),
        F.when(readable, number(j("tables_found")).cast("int")).otherwise(F.size(loose_tables)).alias("tables_found"),
        F.when(readable, F.substring(F.coalesce(j("explanation"), F.lit("")), 1, 200))
        .otherwise(F.concat(F.lit("Fallback parsing: "), F.substring("response", 1, 100), F.lit("..."))).alias("explanation"),
        F.when(readable, truthy(j("retrieval_success"))).otherwise(any_five).alias("retrieval_success"),
        F.when(readable, F.lit("json")).otherwise(F.lit("fallback")).alias("extraction_method"),
        tables.alias("ground_truth_tables"),
        F.when(readable, F.coalesce(j("most_important_table"), F.lit(""))).otherwise(F.coalesce(F.get(loose_tables, F.lit(0)), F.lit(""))).alias("most_important_table"),
        F.when(readable, number(j("tables_needed")).cast("int")).otherwise(F.size(loose_tables)).alias("tables_needed"),
        predicted.cast("int").alias("total_predicted"),
    )


def parse_scores(responses: DataFrame, scale: float = 100.0, keys: list[str] = SCORE_KEYS) -> DataFrame:
    """E12 (scores): judge scores divided by ``scale``; patterns when the text is no JSON."""
    rows = responses.withColumn("j", _parsed(F.col("response"), keys))
    readable = F.col("j").isNotNull() & F.col("j.broken").isNull()
    out = []
    for key in keys:
        loose = F.regexp_extract("response", f"(?i){key}[:\\s]+(\\d+)", 1).try_cast("double")
        value = F.when(readable, F.col(f"j.{key}").try_cast("double")).otherwise(loose)
        out.append(F.coalesce(value / F.lit(scale), F.lit(0.0)).alias(key))
    return rows.select("question_id", "method", *out, readable.alias("readable"))
