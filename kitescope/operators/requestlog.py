"""Request-log metrics (M1, M2) and run timing (M3).

A log has request_id, ts, worker, url, status and seconds; a status of 400 or more is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kitescope.operators.search import top_by


def failed(status: Column) -> Column:
    return status >= 400


def test_report(log: DataFrame) -> DataFrame:
    """M1: totals, success share and mean, longest and shortest time over the whole log."""
    n = F.count("*")
    passed = F.count_if(~failed(F.col("status")))
    return log.agg(
        n.alias("total"), passed.alias("passed"), (n - passed).alias("failed"),
        F.round(F.coalesce(F.try_divide(passed * 100.0, n), F.lit(0.0)), 6).alias("success_pct"),
        F.round(F.avg("seconds"), 6).alias("mean_seconds"), F.max("seconds").alias("max_seconds"), F.min("seconds").alias("min_seconds"),
    )


def worker_summary(log: DataFrame) -> DataFrame:
    """M2 per worker: requests, errors and response times."""
    return log.groupBy("worker").agg(
        F.count("*").alias("requests_made"), F.count_if(failed(F.col("status"))).alias("errors"),
        F.avg("seconds").alias("avg_response_time"), F.max("seconds").alias("max_response_time"), F.min("seconds").alias("min_response_time"),
    )


def load_summary(log: DataFrame, duration_seconds: float | None = None) -> DataFrame:
    """M2 totals: error share, requests per second and the mean of the workers' means above zero.

    Without ``duration_seconds`` the span between first and last request counts.
    """
    workers = log.groupBy("worker").agg(
        F.count("*").alias("requests"), F.count_if(failed(F.col("status"))).alias("errors"), F.avg("seconds").alias("mean"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )
    span = (
        F.timestamp_diff("MICROSECOND", F.min("first_ts"), F.max("last_ts")) / 1e6 if duration_seconds is None else F.lit(float(duration_seconds))
    )
    total = workers.agg(
        F.sum("requests").alias("total_requests"), F.sum("errors").alias("total_errors"), span.alias("span"),
        F.avg(F.when(F.col("mean") > 0, F.col("mean"))).alias("mean_of_means"),
    )
    return total.select(
        "total_requests", "total_errors",
        F.round(F.coalesce(F.try_divide(F.col("total_errors") * 100.0, F.col("total_requests")), F.lit(0.0)), 6).alias("error_pct"),
        F.round(F.try_divide(F.col("total_requests"), F.col("span")), 6).alias("requests_per_second"),
        F.round("mean_of_means", 6).alias("avg_response_time"),
    )


def retrieval_benchmark(cells: DataFrame) -> DataFrame:
    """M3: mean seconds and mean number of tables per method; ``cells`` has method, seconds, n_tables."""
    return cells.groupBy("method").agg(
        F.count("*").alias("test_queries"), F.round(F.avg("seconds"), 6).alias("average_processing_time"), F.round(F.avg("n_tables"), 6).alias("average_tables_found")
    )


def top_tables(run: DataFrame, n: int = 5) -> DataFrame:
    """M3 details: the first ``n`` tables per question and method in one text."""
    leading = top_by(run, ["question_id", "method"], ["rank"], n, "place")
    return leading.groupBy("question_id", "method").agg(F.expr("listagg(entity, '; ') WITHIN GROUP (ORDER BY rank)").alias("top_tables"))
