"""Registered queries for runs, retrieval metrics and their summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kitescope.functions import fixed_values as fixed
from kitescope.functions.sqltext import tables_in_sql
from kitescope.operators import evaluation, report
from kitescope.plans.carriers import METHODS
from kitescope.plans.registry import query
from kitescope.plans.text_queries import first_match_sql

RUN = """run AS (SELECT question_id, method, CAST(rank AS INT) AS rank, entity FROM (
 SELECT question_id, method, entity, row_number() OVER (PARTITION BY question_id, method ORDER BY first_position, entity) AS rank FROM (
  SELECT question_id, method, trim(entity) AS entity, min(position) AS first_position FROM r_predictions WHERE trim(entity) <> '' GROUP BY 1, 2, 3) d) e)"""
POSITIONS = f"""{RUN}, positions AS (SELECT p.question_id, p.method, t.entity, min(p.rank) AS position FROM run p JOIN r_truth t ON p.question_id = t.question_id
 AND (contains(lower(p.entity), lower(t.entity)) OR contains(lower(t.entity), lower(p.entity))) GROUP BY 1, 2, 3)"""
METRICS = f"""{POSITIONS},
 mains AS (SELECT question_id, arg_min(entity, (-importance, entity)) AS main, count(*) AS needed FROM r_truth GROUP BY 1),
 best AS (SELECT p.question_id, p.method, min(position) FILTER (p.entity = m.main) AS main_position, min(position) AS any_position, count(*) AS found
  FROM positions p JOIN mains m ON p.question_id = m.question_id GROUP BY 1, 2),
 metrics AS (SELECT c.question_id, c.method, coalesce(main_position <= 1, false) AS precision_at_1, coalesce(main_position <= 3, false) AS precision_at_3,
  coalesce(main_position <= 5, false) AS precision_at_5, coalesce(any_position <= 3, false) AS hit_at_3, coalesce(any_position <= 5, false) AS hit_at_5,
  coalesce(any_position <= 10, false) AS hit_at_10, coalesce(coalesce(found, 0) * 100.0::DOUBLE / needed, 0) AS coverage, coalesce(found, 0) AS tables_found,
  coalesce(needed, 0) AS tables_needed, coalesce(found, 0) > 0 AS retrieval_success
  FROM r_cells c LEFT JOIN best b ON b.question_id = c.question_id AND b.method = c.method LEFT JOIN mains m ON m.question_id = c.question_id)"""
SHARES = ["precision_at_1", "precision_at_3", "precision_at_5", "hit_at_3", "hit_at_5", "hit_at_10"]


def gain_sql(v: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN ({v} / {b} - 1) * 100 WHEN {v} > 0 THEN 'inf'::DOUBLE ELSE 0 END"


METHOD = f"""{METRICS}, mm0 AS (SELECT method, {', '.join(f'avg(CAST({c} AS INT)) AS {c}' for c in SHARES)}, avg(coverage) AS avg_coverage,
  avg(CAST(retrieval_success AS INT)) AS retrieval_success_rate, count(*) AS total_evaluations FROM metrics GROUP BY 1),
 mm AS (SELECT *, {gain_sql('precision_at_3', 'precision_at_1')} AS precision_improvement_3, {gain_sql('precision_at_5', 'precision_at_1')} AS precision_improvement_5,
  {gain_sql('hit_at_5', 'hit_at_3')} AS recall_improvement_5, {gain_sql('hit_at_10', 'hit_at_3')} AS recall_improvement_10 FROM mm0)"""
SUMMARY = f"""{METHOD}, runs AS (SELECT method, avg(n_tables) AS tables, avg(seconds) AS secs, avg(CAST(n_tables > 0 AS INT)) AS ok FROM r_eval GROUP BY 1),
 summary AS (SELECT mm.method, {', '.join(f'round({c} * 100, 1) AS {c}_pct' for c in SHARES)}, round(avg_coverage, 1) AS avg_coverage_pct,
  round(retrieval_success_rate * 100, 1) AS retrieval_success_pct, round(tables, 1) AS avg_tables_found, round(secs, 3) AS avg_duration_sec, round(ok * 100, 1) AS query_success_pct,
  round(precision_improvement_3, 1) AS precision_improvement_3_pct, round(precision_improvement_5, 1) AS precision_improvement_5_pct,
  round(recall_improvement_5, 1) AS recall_improvement_5_pct FROM mm JOIN runs ON runs.method = mm.method)"""


def run(c):
    return evaluation.clean_run(c("r_predictions").withColumnRenamed("position", "rank"))


def positions(c):
    return evaluation.match_positions(run(c), c("r_truth"))


def metrics(c):
    return evaluation.retrieval_metrics(c("r_cells"), positions(c), c("r_truth"))


def summary(c):
    return report.comprehensive_summary(report.method_metrics(metrics(c)), c("r_eval"))


def rounded(df, columns):
    return df.select(*[F.round(x, 6).alias(x) if x in columns else F.col(x) for x in df.columns])


@query("e1_run_methods", f"WITH {RUN} SELECT * FROM run")
def e1(c):
    pred = c("r_predictions").withColumnRenamed("position", "rank")
    outputs = {m: pred.filter(F.col("method") == m).drop("method") for m in METHODS}
    return evaluation.run_methods(outputs).select("question_id", "method", "rank", "entity")


WIDE = ", ".join(
    f"coalesce(max(names) FILTER (method = '{m}'), 'No tables found') AS \"{m}_Tables\", coalesce(max(n) FILTER (method = '{m}'), 0) AS \"{m}_Count\", "
    f"round(max(seconds) FILTER (method = '{m}'), 3) AS \"{m}_Duration_sec\""
    for m in METHODS
)
E2_SQL = f"""WITH {RUN}, lists AS (SELECT question_id, method, string_agg(entity, '; ' ORDER BY rank) AS names, count(*) AS n FROM run GROUP BY 1, 2),
 filled AS (SELECT c.question_id, c.method, c.seconds, l.names, l.n FROM r_cells c LEFT JOIN lists l ON l.question_id = c.question_id AND l.method = c.method)
SELECT question_id, {WIDE} FROM filled GROUP BY 1"""


@query("e2_pivot_wide", E2_SQL)
def e2(c):
    return evaluation.pivot_wide(run(c), c("r_cells"), METHODS)


@query(
    "e3_method_performance",
    """SELECT method, round(avg(seconds), 6) AS avg_seconds, round(sum(n_tables) / sum(CAST(n_tables > 0 AS INT)), 6) AS avg_tables,
 round(sum(CAST(n_tables > 0 AS INT)) / count(*) * 100, 6) AS success_pct FROM r_eval GROUP BY 1 HAVING sum(CAST(n_tables > 0 AS INT)) > 0""",
)
def e3(c):
    return evaluation.method_performance(c("r_eval"))


@query("e4_cross_method_union", f"WITH {RUN} SELECT question_id, count(DISTINCT entity) AS unique_tables, count(DISTINCT method) AS successful_methods FROM run GROUP BY 1")
def e4(c):
    return evaluation.cross_method_union(run(c))


@query(
    "e5_basic_summary",
    """SELECT method, round(avg(n_tables), 2) AS avg_tables_per_query, round(sum(CAST(n_tables > 0 AS INT)) / count(*) * 100, 1) AS success_rate_pct,
 round(avg(seconds), 3) AS avg_duration_sec, count(*) AS total_queries FROM r_eval GROUP BY 1""",
)
def e5(c):
    return evaluation.basic_summary(c("r_eval"))


def tables_sql(col: str) -> str:
    return (
        f"list_transform(regexp_extract_all(upper(coalesce({col}, '')), '\\b(?:FROM|JOIN|INTO|UPDATE)\\s+([A-Z_][A-Z0-9_.]*)', 1), "
        "lambda n: split_part(n, '.', -1))"
    )


ACTUAL = f"len(list_distinct({tables_sql('truth_sql')}))"


@query(
    "e6_tables_in_sql",
    f"""WITH u AS (SELECT pair_id, truth_sql AS sql, 'truth' AS side FROM s_pairs UNION ALL SELECT pair_id, generated_sql, 'generated' FROM s_pairs)
SELECT pair_id, side, array_to_string(list_sort(list_distinct({tables_sql('sql')})), '|') AS tables,
 array_to_string(list_sort(list_distinct(regexp_extract_all(upper(sql), '(?:FROM|JOIN|UPDATE|INTO)\\s+([^\\s,\\)]+)', 1))), '|') AS qualified FROM u""",
)
def e6(c):
    pairs = c("s_pairs")
    both = pairs.select("pair_id", F.col("truth_sql").alias("sql"), F.lit("truth").alias("side")).unionByName(
        pairs.select("pair_id", F.col("generated_sql").alias("sql"), F.lit("generated").alias("side")))
    text = lambda a: F.array_join(F.array_sort(a), "|")
    return both.select("pair_id", "side", text(tables_in_sql(F.col("sql"))).alias("tables"), text(tables_in_sql(F.col("sql"), True)).alias("qualified"))


@query("e7_match_positions", f"WITH {POSITIONS} SELECT * FROM positions")
def e7(c):
    return positions(c)


@query("e8_precision_at_k", f"WITH {METRICS} SELECT question_id, method, precision_at_1, precision_at_3, precision_at_5 FROM metrics")
def e8(c):
    return metrics(c).select("question_id", "method", "precision_at_1", "precision_at_3", "precision_at_5")


@query("e9_hit_at_k", f"WITH {METRICS} SELECT question_id, method, hit_at_3, hit_at_5, hit_at_10 FROM metrics")
def e9(c):
    return metrics(c).select("question_id", "method", "hit_at_3", "hit_at_5", "hit_at_10")


@query("e10_coverage", f"WITH {METRICS} SELECT question_id, method, round(coverage, 6) AS coverage, tables_found, tables_needed, retrieval_success FROM metrics")
def e10(c):
    return metrics(c).select("question_id", "method", F.round("coverage", 6).alias("coverage"), "tables_found", "tables_needed", "retrieval_success")


@query(
    "e10_truth_matches",
    f"""WITH {POSITIONS} SELECT c.question_id, c.method, t.entity, coalesce(p.position, 0) AS position FROM r_cells c JOIN r_truth t ON t.question_id = c.question_id
 LEFT JOIN positions p ON p.question_id = c.question_id AND p.method = c.method AND p.entity = t.entity""",
)
def e10_lists(c):
    found = evaluation.truth_matches(c("r_cells"), positions(c), c("r_truth"))
    return found.withColumn("position", F.coalesce("position", F.lit(0)))


FLAGS = [("precision_at_1", "Precision@1"), ("precision_at_3", "Precision@3"), ("precision_at_5", "Precision@5"),
         ("hit_at_3", "Recall@3"), ("hit_at_5", "Recall@5"), ("hit_at_10", "Recall@10")]
NOTES = ", ".join(
    f"CASE WHEN r.{f} IS DISTINCT FROM m.{f} THEN '{label}: reported=' || coalesce(CAST(r.{f} AS VARCHAR), 'none') || ', computed=' || CAST(m.{f} AS VARCHAR) END"
    for f, label in FLAGS
)


@query(
    "e11_metric_inconsistencies",
    f"""WITH {METRICS}, noted AS (SELECT r.question_id, r.method, concat_ws('; ', {NOTES}) AS inconsistencies
 FROM r_reported r JOIN metrics m ON m.question_id = r.question_id AND m.method = r.method) SELECT * FROM noted WHERE inconsistencies <> ''""",
)
def e11(c):
    return evaluation.metric_inconsistencies(c("r_reported"), metrics(c))


def _truthy(name: str) -> str:
    x = f"json_extract_string(j, '$.{name}')"
    return f"coalesce(lower({x}) = 'true' OR TRY_CAST({x} AS DOUBLE) <> 0, false)"


def _said(name: str) -> str:
    return f"(regexp_matches(low, '\"{name}\":\\s*true') OR regexp_matches(low, '{name}.*true') OR regexp_matches(low, '{name}.*yes'))"


def _flag_sql(name: str) -> str:
    if name.startswith("hit_rate"):
        partner = name.replace("hit_rate", "recall")
        good = f"CASE WHEN json_extract_string(j, '$.{name}') IS NULL THEN {_truthy(partner)} ELSE {_truthy(name)} END"
        loose = f"({_said(name)} OR {_said(partner)})"
    else:
        good, loose = _truthy(name), _said(name)
    return f"CASE WHEN ok THEN {good} ELSE {loose} END AS {name}"


CUT = r"""CASE WHEN regexp_extract(response, '(?s)\{.*\}') <> '' THEN regexp_extract(response, '(?s)\{.*\}') ELSE response END"""


@query(
    "e12_parse_judgements",
    f"""WITH a AS (SELECT question_id, method, response, n_predicted, lower(response) AS low, {CUT} AS cut,
  regexp_extract_all(regexp_extract(response, '(?s)ground_truth_tables.*?\\[(.*?)\\]', 1), '"([^"]+)"', 1) AS loose FROM r_answers),
 b AS (SELECT *, json_valid(cut) AS ok, CASE WHEN json_valid(cut) THEN CAST(cut AS JSON) END AS j FROM a)
SELECT question_id, method, {', '.join(_flag_sql(n) for n in evaluation.JUDGE_FLAGS)},
 CASE WHEN ok THEN least(greatest(coalesce(TRY_CAST(json_extract_string(j, '$.coverage_percentage') AS DOUBLE), 0), 0), 100)
  ELSE least(greatest(coalesce(TRY_CAST(regexp_extract(low, 'coverage_percentage.*?([0-9.]+)', 1) AS DOUBLE), 0), 0), 100) END AS coverage_percentage,
 CASE WHEN ok THEN least(greatest(coalesce(TRY_CAST(json_extract_string(j, '$.confidence') AS DOUBLE), 0), 0), 1)
  ELSE least(greatest(coalesce(TRY_CAST(regexp_extract(low, 'confidence.*?([0-9.]+)', 1) AS DOUBLE), 0.5), 0), 1) END AS confidence,
 CASE WHEN ok THEN CAST(coalesce(TRY_CAST(json_extract_string(j, '$.tables_found') AS DOUBLE), 0) AS INT) ELSE CAST(len(loose) AS INT) END AS tables_found,
 CASE WHEN ok THEN substr(coalesce(json_extract_string(j, '$.explanation'), ''), 1, 200) ELSE 'Fallback parsing: ' || substr(response, 1, 100) || '...' END AS explanation,
 CASE WHEN ok THEN {_truthy('retrieval_success')} ELSE {_said('recall_at_5')} OR {_said('hit_rate_at_5')} OR {_said('precision_at_5')} END AS retrieval_success,
 CASE WHEN ok THEN 'json' ELSE 'fallback' END AS extraction_method,
 coalesce(array_to_string(CASE WHEN ok THEN CAST(json_extract(j, '$.ground_truth_tables') AS VARCHAR[]) ELSE loose END, '|'), '') AS ground_truth_tables,
 CASE WHEN ok THEN coalesce(json_extract_string(j, '$.most_important_table'), '') ELSE coalesce(loose[1], '') END AS most_important_table,
 CASE WHEN ok THEN CAST(coalesce(TRY_CAST(json_extract_string(j, '$.tables_needed') AS DOUBLE), 0) AS INT) ELSE CAST(len(loose) AS INT) END AS tables_needed,
 n_predicted AS total_predicted FROM b""",
)
def e12(c):
    return evaluation.parse_judgements(c("r_answers")).withColumn("ground_truth_tables", F.array_join("ground_truth_tables", "|"))


@query(
    "e12_parse_scores",
    f"""WITH a AS (SELECT *, {CUT} AS cut FROM r_scores), b AS (SELECT *, json_valid(cut) AS ok, CASE WHEN json_valid(cut) THEN CAST(cut AS JSON) END AS j FROM a)
SELECT question_id, method, {', '.join(f"coalesce(CASE WHEN ok THEN TRY_CAST(json_extract_string(j, '$.{k}') AS DOUBLE) ELSE TRY_CAST(regexp_extract(response, '(?i){k}[:{chr(92)}s]+({chr(92)}d+)', 1) AS DOUBLE) END / 100, 0) AS {k}" for k in evaluation.SCORE_KEYS)},
 ok AS readable FROM b""",
)
def e12_scores(c):
    return evaluation.parse_scores(c("r_scores"))


MM_DOUBLES = SHARES + ["avg_coverage", "retrieval_success_rate", "precision_improvement_3", "precision_improvement_5", "recall_improvement_5", "recall_improvement_10"]


@query("e13_method_metrics", f"WITH {METHOD} SELECT method, total_evaluations, {', '.join(f'round({x}, 6) AS {x}' for x in MM_DOUBLES)} FROM mm")
def e13(c):
    return rounded(report.method_metrics(metrics(c)), MM_DOUBLES)


E14_MEANS = [f"avg_{x}" for x in SHARES] + ["avg_coverage", "avg_retrieval_success"]


@query(
    "e14_overall_metrics",
    f"""WITH {METHOD} SELECT count(*) AS total_methods, {', '.join(f'round(avg({x}), 6) AS avg_{x}' for x in SHARES)}, round(avg(avg_coverage), 6) AS avg_coverage,
 round(avg(retrieval_success_rate), 6) AS avg_retrieval_success, arg_min(method, (-precision_at_1, method)) AS best_precision_1, arg_min(method, (-hit_at_5, method)) AS best_recall_5,
 arg_min(method, (-mm.avg_coverage, method)) AS best_coverage, arg_min(method, (-retrieval_success_rate, method)) AS best_retrieval_success FROM mm""",
)
def e14(c):
    return rounded(report.overall_metrics(report.method_metrics(metrics(c))), E14_MEANS)


@query("e15_comprehensive_summary", f"WITH {SUMMARY} SELECT * FROM summary")
def e15(c):
    return summary(c)


LADDER = fixed.RECOMMENDATION_LADDER


@query(
    "e16_recommend_method",
    f"""WITH {SUMMARY} SELECT method, CASE WHEN precision_at_1_pct >= 70 THEN '{LADDER[0]}' WHEN hit_at_5_pct >= 80 THEN '{LADDER[1]}' WHEN avg_coverage_pct >= 75 THEN '{LADDER[2]}'
 WHEN retrieval_success_pct >= 90 AND avg_duration_sec < 1 THEN '{LADDER[3]}' WHEN avg_duration_sec < 0.1 THEN '{LADDER[4]}' WHEN retrieval_success_pct >= 85 THEN '{LADDER[5]}' ELSE '{LADDER[6]}' END AS recommendation,
 CASE WHEN precision_at_1_pct >= 60 AND hit_at_5_pct >= 80 THEN 'Excellent All-Round' WHEN precision_at_1_pct >= 60 THEN 'Precision Leader' WHEN hit_at_5_pct >= 80 THEN 'Recall Leader' ELSE 'Needs Improvement' END AS quadrant,
 CASE WHEN precision_at_1_pct > 70 THEN 'Precision Leader' WHEN hit_at_5_pct > 80 THEN 'Recall Leader' WHEN avg_coverage_pct > 75 THEN 'Coverage Leader' WHEN retrieval_success_pct > 90 THEN 'Reliable' ELSE 'Specialized' END AS leader
 FROM summary""",
)
def e16(c):
    return report.recommend_method(summary(c))


@query(
    "e17_composite_score",
    f"""WITH {SUMMARY} SELECT method, round(CAST(0.3 AS DOUBLE) * precision_at_1_pct + CAST(0.4 AS DOUBLE) * hit_at_5_pct + CAST(0.2 AS DOUBLE) * avg_coverage_pct
 + CAST(0.1 AS DOUBLE) * CASE WHEN max(avg_duration_sec) OVER () > 0 THEN (1 - avg_duration_sec / max(avg_duration_sec) OVER ()) * 100 ELSE 50 END, 6) AS score FROM summary""",
)
def e17(c):
    return report.composite_score(summary(c))


@query(
    "e18_metric_gains",
    f"""WITH {SUMMARY} SELECT method, CASE WHEN precision_at_1_pct > 0 THEN round(precision_at_5_pct - precision_at_1_pct, 6) ELSE 0 END AS precision_gain,
 CASE WHEN hit_at_3_pct > 0 THEN round(hit_at_10_pct - hit_at_3_pct, 6) ELSE 0 END AS recall_gain FROM summary""",
)
def e18(c):
    return report.metric_gains(summary(c))


KIND = "CASE WHEN contains(method, 'GPT') OR contains(method, 'Gemini') OR contains(method, 'Azure') THEN 'LLM' ELSE 'Local' END"


@query(
    "e19_accuracy_summary",
    f"""WITH s AS (SELECT method, avg(CAST(accuracy AS INT)) AS acc, avg(confidence) AS conf, avg(relevant) AS rel, avg(n_tables) AS tables, avg(CAST(n_tables > 0 AS INT)) AS ok,
  CAST(sum(n_tables) AS BIGINT) AS predicted, coalesce(sum(relevant), 0) AS found, sum({ACTUAL}) AS actual, avg(seconds) AS sa, min(seconds) AS si, max(seconds) AS sx, count(*) AS n,
  count(*) FILTER (n_tables > 0) AS hits FROM r_eval GROUP BY 1),
 r AS (SELECT *, coalesce(found / nullif(predicted, 0), 0) AS p, coalesce(found / nullif(actual, 0), 0) AS q FROM s)
SELECT method, {KIND} AS type, round(ok * 100, 1) AS success_rate_pct, round(coalesce(acc, 0) * 100, 1) AS avg_accuracy_pct, round(coalesce(conf, 0), 3) AS avg_confidence,
 round(tables, 2) AS avg_tables_per_query, round(coalesce(rel, 0), 2) AS avg_relevant_tables, round(p, 3) AS precision, round(q, 3) AS recall,
 round(coalesce(2 * p * q / nullif(p + q, 0), 0), 3) AS f1_score, predicted AS total_tables_found, round(sa, 3) AS avg_duration_sec, round(si, 3) AS min_duration_sec,
 round(sx, 3) AS max_duration_sec, n AS total_queries, hits AS successful_queries FROM r""",
)
def e19(c):
    return report.accuracy_summary(c("r_eval"))


@query(
    "e20_question_accuracy",
    """SELECT question_id, any_value(CASE WHEN length(question) > 100 THEN substr(question, 1, 100) || '...' ELSE question END) AS question, any_value(question_length) AS question_length,
 coalesce(max(truth_sql), '') <> '' AS has_ground_truth, round(coalesce(avg(CAST(accuracy AS INT)), 0), 6) AS avg_accuracy, count(*) FILTER (accuracy) AS methods_correct,
 count(accuracy) AS methods_tested FROM r_eval GROUP BY 1""",
)
def e20(c):
    return rounded(report.question_accuracy(c("r_eval")), ["avg_accuracy"])


@query("e21_topk_pivot", "SELECT method, " + ", ".join(
    f"round(coalesce(count(*) FILTER (n_tables >= {k} AND accuracy) * 100.0::DOUBLE / nullif(count(accuracy), 0), 0), 1) AS top_{k}_pct" for k in (1, 3, 5)) + " FROM r_eval GROUP BY 1")
def e21(c):
    return report.topk_pivot(c("r_eval"))


@query(
    "e22_accuracy_metrics",
    f"""WITH x AS (SELECT *, {ACTUAL} AS actual FROM r_eval),
 q AS (SELECT question_id, max(CAST(n_tables > 0 AND coalesce(accuracy, false) AS INT)) AS hit FROM x GROUP BY 1),
 t AS (SELECT sum(CASE WHEN n_tables > 0 THEN relevant / n_tables END) / count(*) AS p, sum(CASE WHEN actual > 0 THEN relevant / actual END) / count(*) AS r FROM x WHERE accuracy IS NOT NULL)
SELECT round(avg(hit), 6) AS top_1_accuracy, round(avg(hit), 6) AS top_3_accuracy, round(avg(hit), 6) AS top_5_accuracy, count(*) AS total_queries,
 round(any_value(p), 6) AS average_precision, round(any_value(r), 6) AS average_recall, round(any_value(2 * p * r / (p + r)), 6) AS f1_score FROM q, t""",
)
def e22(c):
    return report.accuracy_metrics(c("r_eval"))


@query("e23_accuracy_by_method", "SELECT method, round(avg(CAST(accuracy AS INT)) * 100, 6) AS accuracy_pct FROM r_eval GROUP BY 1")
def e23(c):
    return report.accuracy_by_method(c("r_eval"))


@query(
    "e24_pr_points",
    f"""SELECT question_id, method, round(coalesce(coalesce(relevant, 0) / nullif(n_tables, 0), 0), 6) AS precision,
 round(coalesce(coalesce(relevant, 0) / nullif(CASE WHEN truth_sql IS NULL THEN 1 ELSE {ACTUAL} END, 0), 0), 6) AS recall FROM r_eval""",
)
def e24(c):
    return rounded(report.pr_points(c("r_eval")), ["precision", "recall"])


@query(
    "e25_speed_accuracy",
    """WITH m AS (SELECT method, avg(seconds) AS s, avg(CAST(coalesce(accuracy, false) AS INT)) AS a FROM r_eval GROUP BY 1)
SELECT method, round(s, 6) AS avg_seconds, round(a, 6) AS avg_accuracy, round((SELECT median(s) FROM m), 6) AS median_seconds FROM m""",
)
def e25(c):
    return report.speed_accuracy(c("r_eval"))


def dist_sql(source: str, by: str, value: str) -> str:
    q = ", ".join(f"round(quantile_cont({value}, {f}), 6) AS {n}" for f, n in
                  ((0, "minimum"), (0.25, "lower_quartile"), (0.5, "median"), (0.75, "upper_quartile"), (1, "maximum")))
    return f"SELECT {by}, {q}, round(avg({value}), 6) AS mean, count({value}) AS n FROM {source} WHERE {value} IS NOT NULL GROUP BY 1"


@query("e26_distribution_confidence", dist_sql("r_eval", "method", "confidence"))
def e26(c):
    return report.distribution(c("r_eval"), "method", "confidence")


@query("e26_distribution_seconds", dist_sql("(SELECT url, round(seconds, 4) AS seconds FROM l_requests) l", "url", "seconds"))
def e26_seconds(c):
    return report.distribution(c("l_requests"), "url", "seconds", decimals=4)


@query(
    "e27_minmax_heatmap",
    """WITH m AS (SELECT method, avg(CAST(accuracy AS INT)) AS accuracy, avg(confidence) AS confidence, avg(n_tables) AS count, 1 / (avg(seconds) + CAST(0.001 AS DOUBLE)) AS speed FROM r_eval GROUP BY 1),
 l AS (SELECT method, 'accuracy' AS metric, accuracy AS v FROM m UNION ALL SELECT method, 'confidence', confidence FROM m UNION ALL SELECT method, 'count', count FROM m UNION ALL SELECT method, 'speed', speed FROM m)
SELECT method, metric, round(coalesce((v - min(v) OVER w) / nullif(max(v) OVER w - min(v) OVER w, 0), 0), 6) AS scaled FROM l WINDOW w AS (PARTITION BY metric)""",
)
def e27(c):
    return report.minmax_heatmap(c("r_eval"))


PER_Q = "pq AS (SELECT question_id, any_value(question) AS question, CAST(any_value(question_length) AS DOUBLE) AS x, avg(CAST(accuracy AS INT)) * 100 AS y FROM r_eval GROUP BY 1)"


@query(
    "e28_difficulty_trend",
    f"WITH {PER_Q} SELECT round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(corr(x, y), 6) AS correlation, count(*) AS n_questions FROM pq WHERE y IS NOT NULL",
)
def e28(c):
    return report.difficulty_trend(c("r_eval"))


@query("e29_success_rate", "SELECT method, round(avg(CAST(n_tables > 0 AS INT)) * 100, 6) AS success_pct, round(avg(n_tables), 6) AS mean_tables FROM r_eval GROUP BY 1")
def e29(c):
    return report.success_rates(c("r_eval"))


@query(
    "e30_accuracy_by_category",
    f"""WITH {PER_Q} SELECT {first_match_sql('lower(question)', fixed.QUESTION_CATEGORIES, 'Other')} AS category, round(avg(y), 6) AS mean_accuracy,
 round(stddev_pop(y), 6) AS deviation, count(*) AS n_questions FROM pq WHERE y IS NOT NULL GROUP BY 1""",
)
def e30(c):
    return report.accuracy_by_category(c("r_eval"))


BIN = "CASE " + " ".join(f"WHEN confidence >= CAST({i / 10} AS DOUBLE) AND confidence < CAST({(i + 1) / 10} AS DOUBLE) THEN {i}" for i in range(10)) + " END"


@query(
    "e31_calibration",
    f"""SELECT CAST({BIN} AS INT) AS bin, round(avg(CAST(accuracy AS INT)), 6) AS mean_accuracy, round(avg(confidence), 6) AS mean_confidence, count(*) AS n
 FROM r_eval WHERE confidence IS NOT NULL AND accuracy IS NOT NULL AND {BIN} IS NOT NULL GROUP BY 1""",
)
def e31(c):
    return report.calibration(c("r_eval"))


@query(
    "e32_reliability",
    """SELECT method, round(CASE WHEN count(DISTINCT accuracy) > 1 AND count(DISTINCT confidence) > 1 THEN corr(confidence, CAST(CAST(accuracy AS INT) AS DOUBLE)) ELSE 0 END, 6) AS reliability, count(*) AS n
 FROM r_eval WHERE confidence IS NOT NULL AND accuracy IS NOT NULL GROUP BY 1""",
)
def e32(c):
    return report.reliability(c("r_eval"))


@query(
    "e33_confusion",
    "SELECT method, " + ", ".join(
        f"round(count(*) FILTER ({t}) * 100.0::DOUBLE / count(*), 6) AS {n}_pct" for n, t in (
            ("true_positive", "n_tables > 0 AND coalesce(accuracy, false)"), ("false_positive", "n_tables > 0 AND NOT coalesce(accuracy, false)"),
            ("true_negative", "n_tables = 0 AND coalesce(accuracy, false)"), ("false_negative", "n_tables = 0 AND NOT coalesce(accuracy, false)"))
    ) + " FROM r_eval GROUP BY 1",
)
def e33(c):
    return report.confusion(c("r_eval"))
