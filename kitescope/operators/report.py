"""Summaries of evaluated runs.

``metrics`` is the output of evaluation.retrieval_metrics; ``evaluation`` has one row per question and
method: question_id, question, question_length, truth_sql, method, n_tables, seconds, accuracy,
confidence, relevant.  Every summary is a plain aggregate, so map-side combining shrinks the data to
methods (or questions) before any shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from kitescope.functions import fixed_values as fixed
from kitescope.functions.sqltext import tables_in_sql
from kitescope.functions.terms import question_category

PRECISIONS = ["precision_at_1", "precision_at_3", "precision_at_5"]
HITS = ["hit_at_3", "hit_at_5", "hit_at_10"]


def share(flag: Column) -> Column:
    """Share of rows where the flag holds; null counts as false."""
    return F.avg(F.coalesce(flag, F.lit(False)).cast("int"))


def _known(flag: Column) -> Column:
    return F.avg(flag.cast("int"))


def _gain(value: str, base: str) -> Column:
    v, b = F.col(value), F.col(base)
    return (
        F.when(b > 0, (v / b - 1) * 100)
        .when(v > 0, F.lit(float("inf")))
        .otherwise(F.lit(0.0))
    )


def method_metrics(metrics: DataFrame) -> DataFrame:
    """Mean of every metric per method and relative gains over the strictest cut."""
    means = metrics.groupBy("method").agg(
        *[share(F.col(c)).alias(c) for c in PRECISIONS + HITS],
        F.avg("coverage").alias("avg_coverage"),
        share(F.col("retrieval_success")).alias("retrieval_success_rate"),
        F.count("*").alias("total_evaluations"),
    )
    return means.select(
        "*",
        _gain("precision_at_3", "precision_at_1").alias("precision_improvement_3"),
        _gain("precision_at_5", "precision_at_1").alias("precision_improvement_5"),
        _gain("hit_at_5", "hit_at_3").alias("recall_improvement_5"),
        _gain("hit_at_10", "hit_at_3").alias("recall_improvement_10"),
    )


def overall_metrics(methods: DataFrame) -> DataFrame:
    """Unweighted means over methods and the best method per criterion, ties to the smaller name."""
    best = lambda c: F.min_by("method", F.struct(-F.col(c), F.col("method")))
    return methods.agg(
        F.count("*").alias("total_methods"),
        *[F.avg(c).alias(f"avg_{c}") for c in PRECISIONS + HITS],
        F.avg("avg_coverage").alias("avg_coverage"),
        F.avg("retrieval_success_rate").alias("avg_retrieval_success"),
        best("precision_at_1").alias("best_precision_1"), best("hit_at_5").alias("best_recall_5"),
        best("avg_coverage").alias("best_coverage"), best("retrieval_success_rate").alias("best_retrieval_success"),
    )


def comprehensive_summary(methods: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Percentages, mean tables and seconds per method, best hit@5 first."""
    runs = evaluation.groupBy("method").agg(
        F.avg("n_tables").alias("tables"), F.avg("seconds").alias("secs"), share(F.col("n_tables") > 0).alias("ok")
    )
    pct = lambda c: F.round(F.col(c) * 100, 1)
    return (
        methods.join(runs, "method").select(
            "method",
            *[pct(c).alias(f"{c}_pct") for c in PRECISIONS + HITS],
            F.round("avg_coverage", 1).alias("avg_coverage_pct"),
            pct("retrieval_success_rate").alias("retrieval_success_pct"),
            F.round("tables", 1).alias("avg_tables_found"), F.round("secs", 3).alias("avg_duration_sec"),
            F.round(F.col("ok") * 100, 1).alias("query_success_pct"),
            *[F.round(c, 1).alias(f"{c}_pct") for c in ("precision_improvement_3", "precision_improvement_5", "recall_improvement_5")],
        )
        .orderBy(F.desc("hit_at_5_pct"), "method")
    )


def recommend_method(summary: DataFrame) -> DataFrame:
    """Use-case ladder, four-quadrant label and leader label per method of a summary."""
    p1, r5 = F.col("precision_at_1_pct"), F.col("hit_at_5_pct")
    cov, ok, secs = F.col("avg_coverage_pct"), F.col("retrieval_success_pct"), F.col("avg_duration_sec")
    tests = [p1 >= 70, r5 >= 80, cov >= 75, (ok >= 90) & (secs < 1.0), secs < 0.1, ok >= 85]
    ladder = F.coalesce(*[F.when(t, F.lit(label)) for t, label in zip(tests, fixed.RECOMMENDATION_LADDER)], F.lit(fixed.RECOMMENDATION_LADDER[-1]))
    quadrant = (
        F.when((p1 >= 60) & (r5 >= 80), "Excellent All-Round").when(p1 >= 60, "Precision Leader")
        .when(r5 >= 80, "Recall Leader").otherwise("Needs Improvement")
    )
    leader = (
        F.when(p1 > 70, "Precision Leader").when(r5 > 80, "Recall Leader").when(cov > 75, "Coverage Leader")
        .when(ok > 90, "Reliable").otherwise("Specialized")
    )
    return summary.select("method", ladder.alias("recommendation"), quadrant.alias("quadrant"), leader.alias("leader"))


def composite_score(summary: DataFrame) -> DataFrame:
    """Weighted precision, recall, coverage and relative speed."""
    slowest = summary.agg(F.max("avg_duration_sec").alias("m")).scalar()
    speed = F.when(slowest > 0, (1 - F.col("avg_duration_sec") / slowest) * 100).otherwise(50.0)
    score = 0.3 * F.col("precision_at_1_pct") + 0.4 * F.col("hit_at_5_pct") + 0.2 * F.col("avg_coverage_pct") + 0.1 * speed
    return summary.select("method", F.round(score, 6).alias("score"))


def metric_gains(summary: DataFrame) -> DataFrame:
    """Absolute gain from the strict to the relaxed cut, zero when the strict one is zero."""
    gain = lambda strict, relaxed: F.when(F.col(strict) > 0, F.round(F.col(relaxed) - F.col(strict), 6)).otherwise(0.0)
    return summary.select(
        "method", gain("precision_at_1_pct", "precision_at_5_pct").alias("precision_gain"),
        gain("hit_at_3_pct", "hit_at_10_pct").alias("recall_gain"),
    )


def method_kind(method: Column) -> Column:
    return F.when(reduce(lambda a, b: a | b, [F.contains(method, F.lit(m)) for m in fixed.HOSTED_MODEL_MARKS]), F.lit("LLM")).otherwise(F.lit("Local"))


def accuracy_summary(evaluation: DataFrame) -> DataFrame:
    """Success, accuracy, confidence, pooled precision and recall, and seconds per method.

    Recall divides by the tables of the true SQL of all rows.  ``type`` splits hosted and local methods.
    """
    sums = evaluation.groupBy("method").agg(
        _known(F.col("accuracy")).alias("acc"), F.avg("confidence").alias("conf"), F.avg("relevant").alias("rel"),
        F.avg("n_tables").alias("tables"), share(F.col("n_tables") > 0).alias("ok"),
        F.sum("n_tables").alias("predicted"), F.coalesce(F.sum("relevant"), F.lit(0)).alias("relevant_found"),
        F.sum(F.size(tables_in_sql(F.col("truth_sql")))).alias("actual"),
        F.avg("seconds").alias("s_avg"), F.min("seconds").alias("s_min"), F.max("seconds").alias("s_max"),
        F.count("*").alias("total_queries"), F.count_if(F.col("n_tables") > 0).alias("successful_queries"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    p = zero(F.try_divide(F.col("relevant_found"), F.col("predicted")))
    r = zero(F.try_divide(F.col("relevant_found"), F.col("actual")))
    rated = sums.withColumn("p", p).withColumn("r", r)
    f1 = zero(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")))
    return rated.select(
        "method", method_kind(F.col("method")).alias("type"),
        F.round(F.col("ok") * 100, 1).alias("success_rate_pct"), F.round(zero(F.col("acc")) * 100, 1).alias("avg_accuracy_pct"),
        F.round(zero(F.col("conf")), 3).alias("avg_confidence"), F.round("tables", 2).alias("avg_tables_per_query"),
        F.round(zero(F.col("rel")), 2).alias("avg_relevant_tables"),
        F.round("p", 3).alias("precision"), F.round("r", 3).alias("recall"), F.round(f1, 3).alias("f1_score"),
        F.col("predicted").alias("total_tables_found"),
        F.round("s_avg", 3).alias("avg_duration_sec"), F.round("s_min", 3).alias("min_duration_sec"), F.round("s_max", 3).alias("max_duration_sec"),
        "total_queries", "successful_queries",
    ).orderBy(F.desc("avg_accuracy_pct"), "type", "method")


def question_accuracy(evaluation: DataFrame) -> DataFrame:
    """Mean accuracy over methods, correct and tested methods, shortened question, truth flag."""
    question = F.first("question")
    return evaluation.groupBy("question_id").agg(
        F.when(F.length(question) > 100, F.concat(F.substring(question, 1, 100), F.lit("..."))).otherwise(question).alias("question"),
        F.first("question_length").alias("question_length"),
        (F.coalesce(F.first("truth_sql"), F.lit("")) != "").alias("has_ground_truth"),
        F.coalesce(_known(F.col("accuracy")), F.lit(0.0)).alias("avg_accuracy"),
        F.count_if(F.col("accuracy")).alias("methods_correct"), F.count("accuracy").alias("methods_tested"),
    )


def topk_pivot(evaluation: DataFrame, cuts: list[int] = [1, 3, 5]) -> DataFrame:
    """Share of judged questions with at least k tables and a correct verdict, one column per k."""
    judged = F.col("accuracy").isNotNull()
    return evaluation.groupBy("method").agg(*[
        F.round(
            F.coalesce(F.try_divide(F.count_if((F.col("n_tables") >= k) & F.col("accuracy")) * 100.0, F.count_if(judged)), F.lit(0.0)), 1
        ).alias(f"top_{k}_pct")
        for k in cuts
    ])


def accuracy_metrics(evaluation: DataFrame) -> DataFrame:
    """Questions some method answered, mean precision and recall over all judged rows, F1.

    The published top-k figures only ask that the cut list is not empty, so they agree for all k.
    """
    judged = F.col("accuracy").isNotNull()
    answered = (F.col("n_tables") > 0) & F.coalesce(F.col("accuracy"), F.lit(False))
    rows = evaluation.select("question_id", answered.alias("answered"), judged.alias("judged"), "relevant", "n_tables",
                             F.size(tables_in_sql(F.col("truth_sql"))).alias("actual"))
    ratio = lambda d: F.when(F.col("judged") & (F.col(d) > 0), F.col("relevant") / F.col(d))
    per_question = rows.groupBy("question_id").agg(
        F.max("answered").alias("answered"), F.count_if("judged").alias("judged"),
        F.sum(ratio("n_tables")).alias("p"), F.sum(ratio("actual")).alias("r"),
    )
    total = per_question.agg(
        F.avg(F.col("answered").cast("int")).alias("top"), F.count("*").alias("total_queries"),
        F.coalesce(F.try_divide(F.sum("p"), F.sum("judged")), F.lit(0.0)).alias("p"),
        F.coalesce(F.try_divide(F.sum("r"), F.sum("judged")), F.lit(0.0)).alias("r"),
    )
    return total.select(
        *[F.round("top", 6).alias(f"top_{k}_accuracy") for k in (1, 3, 5)], "total_queries",
        F.round("p", 6).alias("average_precision"), F.round("r", 6).alias("average_recall"),
        F.round(F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0)), 6).alias("f1_score"),
    )


def accuracy_by_method(evaluation: DataFrame) -> DataFrame:
    """Mean accuracy in percent over judged rows."""
    return evaluation.groupBy("method").agg(F.round(_known(F.col("accuracy")) * 100, 6).alias("accuracy_pct")).filter(F.col("accuracy_pct").isNotNull())


def pr_points(evaluation: DataFrame) -> DataFrame:
    """Precision and recall of every row; a row without true SQL counts one true table."""
    relevant = F.coalesce(F.col("relevant"), F.lit(0))
    actual = F.when(F.coalesce(F.col("truth_sql"), F.lit("")) == "", F.lit(1)).otherwise(F.size(tables_in_sql(F.col("truth_sql"))))
    return evaluation.select(
        "question_id", "method",
        F.coalesce(F.try_divide(relevant, F.col("n_tables")), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide(relevant, actual), F.lit(0.0)).alias("recall"),
    )


def speed_accuracy(evaluation: DataFrame) -> DataFrame:
    """Mean seconds and accuracy per method, with the median of the methods' mean seconds."""
    means = evaluation.groupBy("method").agg(F.avg("seconds").alias("s"), share(F.col("accuracy")).alias("a"))
    middle = means.agg(F.percentile("s", F.lit(0.5)).alias("m")).scalar()
    return means.select(
        "method", F.round("s", 6).alias("avg_seconds"), F.round("a", 6).alias("avg_accuracy"), F.round(middle, 6).alias("median_seconds")
    )


def distribution(rows: DataFrame, by: str, value: str, decimals: int = 3) -> DataFrame:
    """Exact quartiles and mean of a measure per group.

    Values are counted at ``decimals`` places first, so the quartiles read a bounded number of
    distinct values whatever the number of rows.
    """
    counted = rows.filter(F.col(value).isNotNull()).groupBy(by, F.round(value, decimals).alias("v")).agg(F.count("*").alias("n"))
    points = counted.groupBy(by).agg(
        F.expr("percentile(v, array(0D, 0.25D, 0.5D, 0.75D, 1D), n)").alias("q"),
        F.round(F.sum(F.col("v") * F.col("n")) / F.sum("n"), 6).alias("mean"), F.sum("n").alias("n"),
    )
    names = ["minimum", "lower_quartile", "median", "upper_quartile", "maximum"]
    return points.select(by, *[F.round(F.col("q")[i], 6).alias(c) for i, c in enumerate(names)], "mean", "n")


def minmax_heatmap(evaluation: DataFrame) -> DataFrame:
    """Method means of four measures scaled to 0-1 per measure; a constant measure gives 0."""
    means = evaluation.groupBy("method").agg(
        F.coalesce(_known(F.col("accuracy")), F.lit(0.0)).alias("accuracy"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("confidence"),
        F.avg("n_tables").alias("count"), (1 / (F.avg("seconds") + 0.001)).alias("speed"),
    )
    long = means.unpivot(["method"], ["accuracy", "confidence", "count", "speed"], "metric", "value")
    span = long.groupBy("metric").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    scaled = F.coalesce(F.try_divide(F.col("value") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))
    return long.join(span, "metric").select("method", "metric", F.round(scaled, 6).alias("scaled"))


def _per_question(evaluation: DataFrame) -> DataFrame:
    return (
        evaluation.groupBy("question_id").agg(
            F.first("question").alias("question"), F.first("question_length").alias("question_length"),
            (_known(F.col("accuracy")) * 100).alias("accuracy_pct"),
        )
        .filter(F.col("accuracy_pct").isNotNull())
    )


def difficulty_trend(evaluation: DataFrame) -> DataFrame:
    """Linear fit and correlation of question length with mean accuracy."""
    y, x = F.col("accuracy_pct"), F.col("question_length").cast("double")
    return _per_question(evaluation).agg(
        F.round(F.regr_slope(y, x), 6).alias("slope"), F.round(F.regr_intercept(y, x), 6).alias("intercept"),
        F.round(F.corr(x, y), 6).alias("correlation"), F.count("*").alias("n_questions"),
    )


def success_rates(evaluation: DataFrame) -> DataFrame:
    """Share of questions with results and mean number of tables."""
    return evaluation.groupBy("method").agg(
        F.round(share(F.col("n_tables") > 0) * 100, 6).alias("success_pct"), F.round(F.avg("n_tables"), 6).alias("mean_tables")
    ).orderBy(F.desc("success_pct"), "method")


def accuracy_by_category(evaluation: DataFrame) -> DataFrame:
    """Mean and population deviation of question accuracy per question category."""
    return _per_question(evaluation).groupBy(question_category(F.col("question")).alias("category")).agg(
        F.round(F.avg("accuracy_pct"), 6).alias("mean_accuracy"), F.round(F.stddev_pop("accuracy_pct"), 6).alias("deviation"),
        F.count("*").alias("n_questions"),
    )


def calibration(evaluation: DataFrame, bins: int = 10) -> DataFrame:
    """Mean accuracy and confidence in equal confidence bins [lo, hi); 1.0 falls outside."""
    conf = F.col("confidence")
    edges = [i / bins for i in range(bins + 1)]
    which = F.coalesce(*[F.when((conf >= edges[i]) & (conf < edges[i + 1]), F.lit(i)) for i in range(bins)])
    rows = evaluation.filter(conf.isNotNull() & F.col("accuracy").isNotNull())
    return rows.withColumn("bin", which).filter(F.col("bin").isNotNull()).groupBy("bin").agg(
        F.round(_known(F.col("accuracy")), 6).alias("mean_accuracy"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.count("*").alias("n")
    )


def reliability(evaluation: DataFrame) -> DataFrame:
    """Correlation of confidence and accuracy per method, zero when either never varies."""
    rows = evaluation.filter(F.col("confidence").isNotNull() & F.col("accuracy").isNotNull())
    a = F.col("accuracy").cast("double")
    constant = (F.min(a) == F.max(a)) | (F.min("confidence") == F.max("confidence"))
    # corr is only asked for rows that vary; a constant side would give null
    return rows.groupBy("method").agg(
        F.round(F.when(constant, F.lit(0.0)).otherwise(F.corr(F.col("confidence"), a)), 6).alias("reliability"), F.count("*").alias("n")
    )


def confusion(evaluation: DataFrame) -> DataFrame:
    """Outcome shares in percent from (any result, correct verdict)."""
    some, right = F.col("n_tables") > 0, F.coalesce(F.col("accuracy"), F.lit(False))
    pct = lambda test: F.round(F.count_if(test) * 100.0 / F.count("*"), 6)
    return evaluation.groupBy("method").agg(
        pct(some & right).alias("true_positive_pct"), pct(some & ~right).alias("false_positive_pct"),
        pct(~some & right).alias("true_negative_pct"), pct(~some & ~right).alias("false_negative_pct"),
    )
