"""Registered queries for logs (M1-M4), sources and sinks (S1-S9), and the flagship report."""

from __future__ import annotations

from pyspark.sql import functions as F

from kitescope.operators import catalog, evaluation, report, requestlog, retrieval, search, tfidf
from kitescope.plans.carriers import METHODS
from kitescope.plans.catalog_queries import CHAIN, KEYED, MERGED, chain, merged, metadata
from kitescope.plans.evaluation_queries import E2_SQL, MM_DOUBLES, RUN, run
from kitescope.plans.registry import query
from kitescope.plans.retrieval_queries import DIRECT, ENTITY_HAY, FEATURES, T3_FIRST5, TFIDF, cut_sql, doc_corpus, exploded_sql, term_top_sql
from kitescope.session import cut_lineage, scratch_path, shuffles_let_go
from kitescope.sources import readers, sinks
from kitescope.streaming import request_metrics

OK = "count(*) FILTER (status < 400)"


@query(
    "m1_test_report",
    f"""SELECT count(*) AS total, {OK} AS passed, count(*) - {OK} AS failed, round({OK} * 100.0::DOUBLE / count(*), 6) AS success_pct, round(avg(seconds), 6) AS mean_seconds,
 max(seconds) AS max_seconds, min(seconds) AS min_seconds FROM l_requests""",
)
def m1(c):
    return requestlog.test_report(c("l_requests"))


@query(
    "m2_worker_summary",
    """SELECT worker, count(*) AS requests_made, count(*) FILTER (status >= 400) AS errors, round(avg(seconds), 6) AS avg_response_time, max(seconds) AS max_response_time,
 min(seconds) AS min_response_time FROM l_requests GROUP BY 1""",
)
def m2_workers(c):
    return requestlog.worker_summary(c("l_requests")).withColumn("avg_response_time", F.round("avg_response_time", 6))


@query(
    "m2_load_summary",
    """WITH w AS (SELECT worker, count(*) AS n, count(*) FILTER (status >= 400) AS e, avg(seconds) AS m, min(ts) AS a, max(ts) AS b FROM l_requests GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS total_requests, CAST(sum(e) AS BIGINT) AS total_errors, round(sum(e) * 100.0::DOUBLE / sum(n), 6) AS error_pct,
 round(sum(n) / (date_diff('microsecond', min(a), max(b)) / 1e6::DOUBLE), 6) AS requests_per_second, round(avg(m) FILTER (m > 0), 6) AS avg_response_time FROM w""",
)
def m2(c):
    return requestlog.load_summary(c("l_requests"))


@query(
    "m3_retrieval_benchmark",
    "SELECT method, count(*) AS test_queries, round(avg(seconds), 6) AS average_processing_time, round(avg(n_tables), 6) AS average_tables_found FROM r_eval GROUP BY 1",
)
def m3(c):
    return requestlog.retrieval_benchmark(c("r_eval"))


@query("m3_top_tables", f"WITH {RUN} SELECT question_id, method, string_agg(entity, '; ' ORDER BY rank) AS top_tables FROM run WHERE rank <= 5 GROUP BY 1, 2")
def m3_tables(c):
    return requestlog.top_tables(run(c))


@query(
    "m4_request_metrics_stream",
    """WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS s, url, status, seconds FROM l_requests), latest AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM l_requests)
SELECT strftime(s, '%Y-%m-%d %H:%M') AS window_start, url, count(*) AS requests, count(*) FILTER (status >= 400) AS errors,
 round(count(*) FILTER (status >= 400) * 100.0::DOUBLE / count(*), 6) AS error_pct, round(avg(seconds), 6) AS mean_seconds, max(seconds) AS max_seconds
 FROM w WHERE s + INTERVAL 1 HOUR <= (SELECT mark FROM latest) GROUP BY s, url""",
)
def m4(c):
    spark = c.spark
    events = request_metrics.file_stream(spark, c.sf_dir, c("events").schema, "events.parquet")
    log = events.select(
        "ts", F.concat(F.lit("/"), F.col("event_type")).alias("url"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"), (F.col("value") / 100.0).alias("seconds"),
    )
    base = scratch_path(spark, "stream")
    written = request_metrics.run_available(request_metrics.windowed_metrics(log), f"{base}/out", f"{base}/checkpoint")
    return written.select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "url", "requests", "errors",
        F.round("error_pct", 6).alias("error_pct"), F.round("mean_seconds", 6).alias("mean_seconds"), "max_seconds",
    )


# --- sources and sinks: every query writes what Spark derives from the tables and reads it back ----------


@query(
    "s1_load_rich_metadata",
    """WITH twice AS (SELECT name, description, rules, alias_one || '|' || alias_two AS aliases, 1 AS version FROM c_tables UNION ALL
 SELECT name, 'newer ' || rules, rules, alias_one || '|' || alias_two, 2 FROM c_tables WHERE ord % 3 = 0)
SELECT name AS tablename, arg_max(description, version) AS description, any_value(rules) AS rules, any_value(aliases) AS aliases FROM twice GROUP BY 1""",
)
def s1(c):
    base = scratch_path(c.spark, "metadata")
    records = metadata(c)
    fields = [f for f in readers.RECORD_FIELDS if f != "columns"]
    # the first part holds plain records (some without a name), the second documents with the list inside
    named = F.when(F.col("ord") % 97 == 96, F.lit(None).cast("string")).otherwise(F.col("tablename"))
    blank = records.filter(F.col("ord") % 97 == 96).withColumn("tablename", named)
    records.select(*fields).unionByName(blank.select(*fields)).write.json(f"{base}/first")
    newer = records.filter(F.col("ord") % 3 == 0).withColumn("tableDescription", F.concat(F.lit("newer "), "tableSpecificRules"))
    newer.select(F.array(F.struct(*fields)).alias("trainingdata")).write.json(f"{base}/second")
    loaded = readers.load_rich_metadata(c.spark, [f"{base}/first", f"{base}/second"], multi_line=False)
    return loaded.select(
        "tablename", F.col("tableDescription").alias("description"), F.col("tableSpecificRules").alias("rules"), F.array_join("tableAlias", "|").alias("aliases")
    )


@query(
    "s2_load_erd_relationships",
    f"""WITH {KEYED}, {CHAIN} SELECT from_table, to_table, name AS from_column, name AS to_column, kind AS relationship_type, conf AS confidence FROM chain WHERE length(name) % 4 <> 0""",
)
def s2(c):
    path = f"{scratch_path(c.spark, 'edges')}/edges"
    # edges whose second column is missing are incomplete and must be skipped
    broken = F.when(F.length("from_column") % 4 != 0, F.col("to_column"))
    with shuffles_let_go(c.spark):
        chain(catalog.infer_relationships(c("c_columns"))).withColumn("to_column", broken).write.option("compression", "gzip").json(path)
    return readers.load_erd_relationships(c.spark, path, multi_line=False)


@query(
    "s3_load_questions",
    """WITH n AS (SELECT row_number() OVER (ORDER BY item_id) AS row_number, text FROM benchmark), t AS (SELECT *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS question FROM n)
SELECT 'Q' || CAST(row_number AS VARCHAR) AS id, question, 'file' AS source, row_number, 'SELECT ' || regexp_replace(text, '\\s+$', '', 'g') AS ground_truth_sql FROM t WHERE length(question) > 10""",
)
def s3(c):
    path = f"{scratch_path(c.spark, 'questions')}/questions.csv"
    rows = c("benchmark").repartitionByRange(4, "item_id").sortWithinPartitions("item_id")
    rows.select(F.concat(F.lit("  "), "text").alias("Query"), F.concat(F.lit(" SELECT "), "text").alias("SQL")).write.option("header", True).option("escape", '"').csv(path)
    return readers.load_questions(readers.read_table(c.spark, path))


@query(
    "s4_load_questions_simple",
    """SELECT 'Q' || CAST(rn AS VARCHAR) AS id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS question, 'file' AS source
 FROM (SELECT row_number() OVER (ORDER BY item_id) AS rn, text FROM benchmark) n WHERE rn <= 20""",
)
def s4(c):
    path = f"{scratch_path(c.spark, 'questions')}/questions"
    c("benchmark").repartitionByRange(4, "item_id").sortWithinPartitions("item_id").select(F.col("text").alias("Question")).write.parquet(path)
    return readers.load_questions_simple(readers.read_table(c.spark, path))


def stored_network(c):
    path = scratch_path(c.spark, "network")
    sinks.write_network(path, {
        "tables": c("c_tables").select("ord", "name", "table_type"), "columns": c("c_columns").select("table_name", "name", "data_type"),
        "relationships": merged(c, keep=False), "dates": catalog.date_nodes(c("x_dates")),
    })
    return readers.open_network(c.spark, path)


@query(
    "s5_open_network",
    f"""WITH {MERGED} SELECT 'tables' AS table_name, count(*) AS n FROM c_tables UNION ALL SELECT 'columns', count(*) FROM c_columns
UNION ALL SELECT 'relationships', CAST(sum(n) AS BIGINT) FROM totals UNION ALL SELECT 'dates', count(*) FROM x_dates WHERE regexp_matches(date_string, '^[0-9]{{8}}$') AND try_strptime(date_string, '%Y%m%d') IS NOT NULL""",
)
def s5(c):
    return readers.network_counts(stored_network(c))


@query("s6_write_network", "SELECT t.name, t.table_type, count(c.name) AS n_columns FROM c_tables t LEFT JOIN c_columns c ON c.table_name = t.name GROUP BY 1, 2")
def s6(c):
    stored = stored_network(c)
    per_table = stored["columns"].groupBy("table_name").agg(F.count("*").alias("n_columns"))
    return stored["tables"].join(per_table, F.col("name") == F.col("table_name"), "left").select("name", "table_type", F.coalesce("n_columns", F.lit(0)).alias("n_columns"))


@query("s7_write_run_wide", E2_SQL)
def s7(c):
    path = scratch_path(c.spark, "wide")
    sinks.write_run_wide(path, run(c), c("r_cells"), METHODS)
    schema = "question_id string, " + ", ".join(f"{m}_Tables string, {m}_Count bigint, {m}_Duration_sec double" for m in METHODS)
    return c.spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


STAMP = "2024-01-01 00:00:00"


@query(
    "s8_write_ranked_long",
    f"""WITH {RUN} SELECT r.question_id AS "Query", r.method AS "Method", r.rank AS "Rank", r.entity AS "Table_Name", round(c.seconds, 3) AS "Duration_sec",
 count(*) OVER (PARTITION BY r.question_id, r.method) AS "Total_Tables_Found", '{STAMP}' AS "Timestamp" FROM run r JOIN r_cells c ON c.question_id = r.question_id AND c.method = r.method""",
)
def s8(c):
    path = scratch_path(c.spark, "long")
    sinks.write_ranked_long(path, run(c), c("r_cells"), STAMP)
    schema = "Query string, Method string, Rank int, Table_Name string, Duration_sec double, Total_Tables_Found bigint, Timestamp string"
    return c.spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


@query("s9_write_json", "SELECT question_id, question, method, n_tables, seconds, truth_sql FROM r_eval")
def s9(c):
    path = scratch_path(c.spark, "json")
    sinks.write_json(path, c("r_eval").select("question_id", "question", "method", "n_tables", "seconds", "truth_sql"), "gzip")
    return c.spark.read.schema("question_id string, question string, method string, n_tables bigint, seconds double, truth_sql string").json(path)


# --- flagship: retrieve, judge against the documents that hold the passage, and summarise ----------------


@query(
    "flagship_retrieval_report",
    f"""WITH asked AS ({exploded_sql(T3_FIRST5, 'q_text')}), top AS ({term_top_sql('asked', ENTITY_HAY, 3)}), {TFIDF},
 kw AS ({cut_sql('SELECT DISTINCT a.question_id, t.name AS entity, CAST(1 AS DOUBLE) AS score FROM asked a JOIN top t ON a.term = t.term', 10)}),
 scored AS (SELECT question_id, entity, round(sum(q.w * d.w), 6) AS score FROM qn q JOIN dn d USING (term) GROUP BY 1, 2), tf AS ({cut_sql('SELECT * FROM scored WHERE score > 0.01', 10)}),
 dm AS ({cut_sql(DIRECT, 5)}), run AS (SELECT question_id, 'Keyword' AS method, entity, rank FROM kw UNION ALL SELECT question_id, 'TFIDF', entity, rank FROM tf UNION ALL SELECT question_id, 'Direct', entity, rank FROM dm),
 truth AS (SELECT question_id, entity FROM ({DIRECT}) d),
 mains AS (SELECT question_id, min(entity) AS main, count(*) AS needed FROM truth GROUP BY 1),
 positions AS (SELECT r.question_id, r.method, t.entity, min(r.rank) AS position FROM run r JOIN truth t ON t.question_id = r.question_id
  AND (contains(lower(r.entity), lower(t.entity)) OR contains(lower(t.entity), lower(r.entity))) GROUP BY 1, 2, 3),
 best AS (SELECT p.question_id, p.method, min(position) FILTER (p.entity = m.main) AS mp, min(position) AS ap, count(*) AS found FROM positions p JOIN mains m ON m.question_id = p.question_id GROUP BY 1, 2),
 cells AS (SELECT q.question_id, m.method FROM q_text q CROSS JOIN (VALUES ('Keyword'), ('TFIDF'), ('Direct')) m(method)),
 mt AS (SELECT c.method, coalesce(mp <= 1, false) AS p1, coalesce(mp <= 3, false) AS p3, coalesce(mp <= 5, false) AS p5, coalesce(ap <= 3, false) AS h3, coalesce(ap <= 5, false) AS h5, coalesce(ap <= 10, false) AS h10,
  coalesce(coalesce(found, 0) * 100.0::DOUBLE / needed, 0) AS cov, coalesce(found, 0) > 0 AS ok FROM cells c LEFT JOIN best b ON b.question_id = c.question_id AND b.method = c.method LEFT JOIN mains m ON m.question_id = c.question_id)
SELECT method, count(*) AS total_evaluations, round(avg(CAST(p1 AS INT)), 6) AS precision_at_1, round(avg(CAST(p3 AS INT)), 6) AS precision_at_3, round(avg(CAST(p5 AS INT)), 6) AS precision_at_5,
 round(avg(CAST(h3 AS INT)), 6) AS hit_at_3, round(avg(CAST(h5 AS INT)), 6) AS hit_at_5, round(avg(CAST(h10 AS INT)), 6) AS hit_at_10, round(avg(cov), 6) AS avg_coverage,
 round(avg(CAST(ok AS INT)), 6) AS retrieval_success_rate FROM mt GROUP BY 1""",
)
def flagship(c):
    tables = c("c_tables")
    # texts are searched for whole passages once; the hits serve as a method and as the truth
    holders = cut_lineage(search.phrase_matches(c("q_plain"), tables, ["name", "description", "rules"]))
    outputs = {
        "Keyword": retrieval.simple_keyword(c("q_text"), tables),
        "TFIDF": tfidf.search(tfidf.fit(doc_corpus(c), FEATURES), c("q_text")),
        "Direct": retrieval.ranked(holders, 5),
    }
    # the run is short (ten names per question and method) and read several times: save it once
    ranked = cut_lineage(evaluation.run_methods(outputs))
    truth = holders.select("question_id", F.col("name").alias("entity"), F.lit(1.0).alias("importance"))
    cells = c("q_text").select("question_id", F.explode(F.array(*[F.lit(m) for m in outputs])).alias("method"))
    metrics = evaluation.retrieval_metrics(cells, evaluation.match_positions(ranked, truth), truth)
    summary = report.method_metrics(metrics)
    kept = ["precision_at_1", "precision_at_3", "precision_at_5", "hit_at_3", "hit_at_5", "hit_at_10", "avg_coverage", "retrieval_success_rate"]
    return summary.select("method", "total_evaluations", *[F.round(x, 6).alias(x) for x in kept if x in MM_DOUBLES])
