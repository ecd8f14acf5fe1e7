"""Catalog building, sources and evaluation on hand-made rows, hot groups included."""

import json
import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from kitescope.functions import naming
from kitescope.operators import catalog, evaluation, lookup, report
from kitescope.sources import readers, sinks
from kitescope.streaming import request_metrics


@pytest.fixture(scope="module")
def columns(spark):
    rows = []
    for i in range(30):
        rows.append((f"t{i:02d}", i, "hot_id"))  # one name in every table
        rows.append((f"t{i:02d}", i, f"pair{i // 2}_sk"))
        rows.append((f"t{i:02d}", i, "note"))
        if i % 10 == 0:
            rows.append((f"t{i:02d}", i, "rare_code"))
    return spark.createDataFrame(rows, "table_name string, ord int, name string")


def brute_pairs(columns):
    rows = [(r.table_name, r.ord, r.name) for r in columns.collect() if r.name != "note"]
    return {(a[0], b[0], a[2]) for a in rows for b in rows if a[2] == b[2] and a[1] < b[1]}


def test_lists_hold_every_relationship_once(columns):
    members = {}
    for r in catalog.infer_relationships(columns).collect():
        members.setdefault(r.column_name, []).append((r.ord, r.table_name))
        assert r.group_size > 1
    got = [(a, b, name) for name, tables in members.items() for (_, a), (_, b) in combinations(sorted(tables), 2)]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(columns)
    assert sum(r.n_relationships for r in catalog.relationship_totals(columns).collect()) == len(got)


def test_relationships_of_one_table(spark, columns):
    got = [r.related for r in catalog.relationships_of(columns, spark.createDataFrame([("t03",)], "table_name string"), 4).orderBy("rank").collect()]
    near = sorted({b if a == "t03" else a for a, b, _ in brute_pairs(columns) if "t03" in (a, b)})
    assert got == near[:4]


def test_explicit_edges_win(spark, columns):
    schema = "from_table string, to_table string, from_column string, to_column string, relationship_type string, confidence double"
    curated = spark.createDataFrame([("t05", "t03", "hot_id", "hot_id", "CURATED", 1.0), ("t03", "gone", "x", "y", "CURATED", 1.0)], schema)
    rules = spark.createDataFrame([("t03", "t05", "hot_id", "hot_id", "RULE", 0.9), ("t03", "t04", "hot_id", "rare_code", "RULE", 0.9)], schema)
    merged = catalog.merge_relationships([curated, rules], catalog.infer_relationships(columns))
    expected = {(*sorted((a, b)), n, n): "inferred" for a, b, n in brute_pairs(columns)}
    expected |= {("t03", "t05", "hot_id", "hot_id"): "CURATED", ("gone", "t03", "x", "y"): "CURATED", ("t03", "t04", "hot_id", "rare_code"): "RULE"}
    totals = {r.relationship_type: r.n for r in catalog.merged_totals(merged).collect()}
    assert sum(totals.values()) == len(expected) and totals["CURATED"] == 2 and totals["RULE"] == 1
    chosen = spark.createDataFrame([("t03",)], "table_name string")
    got = {(*sorted((r.seed, r.related)), r.from_column, r.to_column): r.relationship_type for r in catalog.merged_edges_of(merged, chosen).collect()}
    counted = {(r.seed, r.relationship_type): r.n for r in catalog.merged_counts_of(merged, chosen).collect()}
    listed = catalog.merged_edges_of(merged, chosen).groupBy("seed", "relationship_type").count().collect()
    assert counted == {(r.seed, r.relationship_type): r["count"] for r in listed}
    assert got.keys() == {k for k in expected if "t03" in k[:2]}
    assert all(got[k] == v for k, v in expected.items() if k in got and v != "inferred")


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_merged_edges_share_a_deal_and_read_few_texts(spark, columns):
    schema = "from_table string, to_table string, from_column string, to_column string, relationship_type string, confidence double"
    curated = spark.createDataFrame([("t05", "t03", "hot_id", "hot_id", "B", 1.0), ("t03", "t05", "hot_id", "hot_id", "C", 1.0), ("t03", "t03", "hot_id", "hot_id", "B", 1.0), ("t03", "t09", "pair1_sk", "pair1_sk", "B", 1.0)], schema)
    edges = catalog.merged_explicit_edges([curated], catalog.infer_relationships(columns))
    got = {(r.from_table, r.to_table, r.from_column, r.relationship_type, r.replaces) for r in edges.collect()}
    assert got == {("t03", "t05", "hot_id", "C", "KEY_MATCH"), ("t03", "t03", "hot_id", "B", None), ("t03", "t09", "pair1_sk", "B", None)}


def test_relationship_patterns_agree_with_the_rules(spark):
    names = ["a_sk", "A_SK", "a_sk\n", "smcp", "xsmcp", "my_idx", "my_keys", "x_code", "key", "akey", "grid", "id", "note", "", None]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    for bound in (0.0, 0.7, 0.8, 0.9, 0.95):
        plain = df.filter(naming.relationship_confidence(F.col("name")) > bound).collect()
        assert df.filter(naming.supports_relationship(F.col("name"), bound)).collect() == plain


def test_tables_that_hold_their_columns_need_no_shuffle(spark):
    fields = "ordinal_position bigint, name string, data_type string, description string, is_primary_key boolean, is_foreign_key boolean"
    rows = [("t1", "about", "fact", 5, [(2, "price_id", "string", None, False, True), (1, "key", "bigint", "k", True, False)]), ("t2", None, "other", None, []), ("t3", "x", "reference", 1, None), ("t4", "y", "fact", 1, [(1, "zz", "string", "z", False, False), (2, "zz_id", "string", "", False, False)])]
    nested = spark.createDataFrame(rows, f"name string, description string, table_type string, record_count bigint, columns array<struct<{fields.replace(' ', ':').replace(',:', ',')}>>")
    flat = nested.select(F.col("name").alias("table_name"), F.explode("columns").alias("c")).select("table_name", "c.*").withColumn("column_category", naming.column_category(F.col("name")))
    tables = nested.drop("columns")
    details = lookup.table_details(nested, None)
    assert exchanges(details) == 0 and sorted(details.collect()) == sorted(lookup.table_details(tables, flat).collect())
    for counts in (False, True):
        assert sorted(lookup.ddl_context(details, counts).collect()) == sorted(lookup.ddl_context(lookup.table_details(tables, flat), counts).collect())
    for options in ({}, {"broad": True}, {"broad": True, "limit": 1, "column_chars": 4}):
        assert lookup.schema_summary_typed(nested, None, **options).collect() == lookup.schema_summary_typed(tables, flat, **options).collect()


def test_dates_skip_what_is_no_date(spark):
    values = spark.createDataFrame([("20240229",), ("20230229",), ("2024-01-01",), ("202401",), (None,), ("20240106",)], "date_string string")
    got = {r.date_string: (r.day_of_week, r.is_business_day) for r in catalog.date_nodes(values).collect()}
    assert got == {"20240229": (3, True), "20240106": (5, False)}


def test_value_nodes_skip_blanks_and_unwanted_columns(spark):
    rows = [("t", 1, "status_flag", "", "", "string", True, ["a"], [" ", "x", None, "2024-01-01"], None), ("t", 2, "note", "", "", "string", True, [], ["y"], None), ("t", 3, "memo", "", "", "string", True, [], ["z"], "YES")]
    schema = "table_name string, ordinal_position int, name string, text_description string, description string, data_type string, is_nullable boolean, aliases array<string>, distinct_values array<string>, provide_distinct string"
    nodes = catalog.value_nodes(catalog.column_nodes(spark.createDataFrame(rows, schema)))
    assert sorted((r.name, r.value_type) for r in nodes.collect()) == [("2024-01-01", "date"), ("x", "categorical"), ("z", "categorical")]


def test_metadata_documents_last_one_wins(spark, tmp_path):
    first, second = tmp_path / "a.json", tmp_path / "b.json"
    first.write_text(json.dumps([{"tablename": "T1", "tableDescription": "old"}, {"tableDescription": "nameless"}, {"tablename": "T2", "columns": [{"columnname": "c1", "datatype": "int", "distinct_values": ["1"]}, {"columnname": ""}]}]))
    second.write_text(json.dumps({"trainingdata": [{"tablename": "T1", "tableDescription": "mid"}, {"tablename": "T1", "tableDescription": "new", "tableAlias": ["x"]}]}))
    loaded = readers.load_rich_metadata(spark, [str(first), str(second)])
    assert {r.tablename: r.tableDescription for r in loaded.collect()} == {"T1": "new", "T2": None}
    nodes = catalog.column_nodes(catalog.column_records(loaded)).collect()
    assert [(r.full_name, r.data_type, r.is_nullable) for r in nodes] == [("T2.c1", "int", True)]
    assert catalog.table_nodes(loaded).filter("name = 'T1'").first().embedding_text == "Table: T1. Description: new. Aliases: x. Rules: "


def test_curated_edge_file(spark, tmp_path):
    path = tmp_path / "edges.json"
    edge = {"from_table": "a", "to_table": "b", "from_column": "x", "to_column": "y"}
    path.write_text(json.dumps([{**edge, "confidence": 0.5}, {**edge, "from_table": "b", "to_table": "a", "relationship_type": "R"}, {"from_table": "a"}]))
    got = readers.load_erd_relationships(spark, str(path)).collect()
    assert [(r.from_table, r.to_table, r.relationship_type, r.confidence) for r in got] == [("b", "a", "R", 0.0)]
    assert readers.load_erd_relationships(spark, str(tmp_path / "none.json")).count() == 0


def test_question_numbers_follow_source_rows(spark, tmp_path):
    path = str(tmp_path / "q.csv")
    with open(path, "w") as f:
        f.write('Question,Answer\n"  how many, trades? ",SELECT 1\nshort,\n"two\nlines of question",\n')
    got = readers.load_questions(readers.read_table(spark, path)).orderBy("row_number").collect()
    assert [(r.id, r.question, r.ground_truth_sql) for r in got] == [("Q1", "how many, trades?", "SELECT 1"), ("Q3", "two\nlines of question", None)]
    simple = readers.load_questions_simple(readers.read_table(spark, path), 2).collect()
    assert [r.id for r in simple] == ["Q1", "Q2"]


def test_network_round_trip(spark, tmp_path):
    tables = spark.createDataFrame([("a",), ("b",)], "name string")
    sinks.write_network(str(tmp_path), {"tables": tables, "dates": tables.limit(1)})
    sinks.write_network(str(tmp_path), {"tables": tables.limit(1)})
    assert {r.table_name: r.n for r in readers.network_counts(readers.open_network(spark, str(tmp_path))).collect()} == {"tables": 1, "dates": 1}
    with pytest.raises(ValueError):
        sinks.write_network(str(tmp_path), {"other": tables})


RUN = [("q1", "M", 1, " Sales.Orders "), ("q1", "M", 2, "sales.orders"), ("q1", "M", 3, "Sales.Orders"), ("q1", "M", 4, " "), ("q1", "M", 5, "items"), ("q2", "M", 1, "other")]
TRUTH = [("q1", "orders", 2.0), ("q1", "line_items", 1.0), ("q1", "gone", 1.0), ("q2", "orders", 1.0)]


@pytest.fixture(scope="module")
def judged(spark):
    run = evaluation.clean_run(spark.createDataFrame(RUN, "question_id string, method string, rank int, entity string"))
    truth = spark.createDataFrame(TRUTH, "question_id string, entity string, importance double")
    cells = spark.createDataFrame([("q1", "M"), ("q2", "M"), ("q3", "M")], "question_id string, method string")
    return run, truth, cells, evaluation.match_positions(run, truth)


def test_clean_run_keeps_first_and_numbers_again(judged):
    assert [(r["rank"], r.entity) for r in judged[0].filter("question_id = 'q1'").orderBy("rank").collect()] == [(1, "Sales.Orders"), (2, "sales.orders"), (3, "items")]


def test_names_match_by_containment_either_way(judged):
    assert sorted((r.question_id, r.entity, r.position) for r in judged[3].collect()) == [("q1", "line_items", 3), ("q1", "orders", 1)]


def test_metrics_of_hit_miss_and_empty_cells(judged):
    run, truth, cells, positions = judged
    got = {r.question_id: r for r in evaluation.retrieval_metrics(cells, positions, truth).collect()}
    assert got["q1"].precision_at_1 and got["q1"].hit_at_3 and got["q1"].coverage == pytest.approx(200 / 3)
    assert not got["q2"].hit_at_10 and (got["q2"].tables_found, got["q2"].tables_needed) == (0, 1)
    assert (got["q3"].tables_needed, got["q3"].coverage, got["q3"].retrieval_success) == (0, 0.0, False)
    for r in got.values():
        assert r.hit_at_3 <= r.hit_at_5 <= r.hit_at_10 and r.precision_at_1 <= r.precision_at_3 <= r.precision_at_5
    lists = {(r.entity, r.position) for r in evaluation.truth_matches(cells, positions, truth).filter("question_id = 'q1'").collect()}
    assert lists == {("orders", 1), ("line_items", 3), ("gone", None)}


def test_judgements_clamp_default_and_fall_back(spark):
    rows = [
        ("a", "M", 'x {"precision_at_1": true, "recall_at_3": 1, "coverage_percentage": 140, "confidence": -2, "tables_found": 3} y'),
        ("b", "M", "precision_at_5 is: yes, coverage_percentage 12.5"),
        ("c", "M", ""),
    ]
    got = {r.question_id: r for r in evaluation.parse_judgements(spark.createDataFrame(rows, "question_id string, method string, response string")).collect()}
    assert got["a"].precision_at_1 and got["a"].hit_rate_at_3 and (got["a"].coverage_percentage, got["a"].confidence, got["a"].tables_found) == (100.0, 0.0, 3)
    assert got["b"].precision_at_5 and got["b"].retrieval_success and (got["b"].coverage_percentage, got["b"].confidence) == (12.5, 0.5)
    assert got["c"].extraction_method == "fallback" and not got["c"].precision_at_1


def test_gains_reach_infinity_from_zero(spark):
    rows = [("q", "M", False, True, True, False, False, False, 0.0, 0, 0, False)]
    names = "question_id string, method string, precision_at_1 boolean, precision_at_3 boolean, precision_at_5 boolean, hit_at_3 boolean, hit_at_5 boolean, hit_at_10 boolean, coverage double, tables_found int, tables_needed int, retrieval_success boolean"
    r = report.method_metrics(spark.createDataFrame(rows, names)).first()
    assert r.precision_improvement_3 == float("inf") and r.recall_improvement_5 == 0.0


def test_calibration_leaves_out_full_confidence(spark):
    rows = spark.createDataFrame([(0.3, True), (0.39, False), (1.0, True), (None, True)], "confidence double, accuracy boolean")
    assert [(r.bin, r.mean_accuracy, r.n) for r in report.calibration(rows).collect()] == [(3, 0.5, 2)]


def test_distribution_is_exact(spark):
    rows = spark.createDataFrame([("m", v) for v in (0.1, 0.1, 0.1, 0.4, 0.9)], "method string, seconds double")
    r = report.distribution(rows, "method", "seconds").first()
    assert (r.minimum, r.lower_quartile, r.median, r.upper_quartile, r.maximum, r.n) == (0.1, 0.1, 0.1, 0.4, 0.9, 5)


def test_stream_equals_batch_for_closed_windows(spark, tmp_path):
    rows = [(f"2024-01-01 0{i // 6}:{i % 6}5:00", "/a" if i % 2 else "/b", 500 if i % 5 == 0 else 200, i / 10) for i in range(30)]
    log = spark.createDataFrame(rows, "ts string, url string, status int, seconds double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    log.write.parquet(str(tmp_path / "in"))
    stream = request_metrics.file_stream(spark, str(tmp_path / "in"), log.schema, "*.parquet")
    out = request_metrics.run_available(request_metrics.windowed_metrics(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    batch = request_metrics.windowed_metrics(log).filter(F.col("window_end") <= F.lit("2024-01-01 04:45:00").cast("timestamp"))
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(out) == key(batch) and out.count() == 8


def test_profiles_compare_numbers_as_numbers(spark):
    rows = [(9, 1.00001, "9"), (10, 1.00002, "10"), (1499, 1e30, "1499"), (999, float("nan"), "999"), (None, -2.5, None), (9, 1.00001, "9")]
    p = {r.column_name: r for r in catalog.profile_columns(spark.createDataFrame(rows, "k long, d double, s string"), "t", 3).collect()}
    assert (p["k"].min_value, p["k"].max_value, p["k"].n_distinct, p["k"].n_nulls, p["k"].distinct_values) == ("9", "1499", 4, 1, ["9", "10", "999"])
    assert (p["d"].min_value, p["d"].max_value, p["d"].n_distinct, p["d"].distinct_values) == ("-2.5", "NaN", 5, ["-2.5", "1.00001", "1.00002"])
    assert (p["s"].min_value, p["s"].max_value) == ("10", "999")


def test_columns_come_out_of_their_own_document_without_a_shuffle(spark, tmp_path):
    from kitescope.plans.carriers import Carriers

    rows = [(1, "b a B c a", "en", "web", 9), (2, None, "en", "web", 0), (3, "  ", "en", "web", 2), (None, "x", "en", "web", 1)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    columns = Carriers(spark, str(tmp_path))("c_columns")
    got = sorted((r.ord, r.description, r.ordinal_position, r.is_primary_key) for r in columns.collect())
    assert got == [(1, "holds a", 1, False), (1, "holds b", 0, True), (1, "holds c", 3, False)]
    plan = columns._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_questions_and_their_pairs_come_out_of_one_row(spark):
    from kitescope.plans.carriers import Carriers

    c = Carriers(spark, "/root/testdata/sf0.001")
    made = c("r_questions")
    assert exchanges(made) == 0
    joined = c("q_order").join(c("s_pairs"), F.col("ord") == F.col("pair_id")).select("question_id", "question", "ord", F.when(F.col("ord") % 10 != 0, F.col("truth_sql")).alias("truth_sql"))
    assert made.exceptAll(joined).isEmpty() and joined.exceptAll(made).isEmpty()


@pytest.mark.parametrize("name", ["l5_ddl_context", "l5_ddl_context_counts", "l2_table_details", "l7_schema_summary_typed"])
def test_documents_without_words_or_name_equal_the_sql(spark, tmp_path, name):
    import duckdb

    from kitescope.plans import registry

    registry.load_all()
    rows = [(0, "Ab cd ab", "en", "s1", 8), (1, "!!! ... ", "en", "s1", 8), (2, "", "fr", "s2", 0), (3, "one two_x", "de", "s3", 9), (4, "x y", "en", None, 3)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = [tuple(r) for r in registry.QUERIES[name](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(con.sql(registry.ORACLE[name]).fetchall(), key=str)


def test_chosen_tables_with_their_names_need_no_second_look_at_columns(spark, columns):
    chosen = spark.createDataFrame([("t07",), ("t20",), ("t20",), ("gone",)], "table_name string")
    held = chosen.distinct().join(columns.groupBy("table_name").agg(F.collect_list("name").alias("names")), "table_name", "left")
    repeated = columns.unionByName(columns)
    want = sorted(catalog.relationships_of(columns, chosen).collect())
    assert [r.related for r in want if r.seed == "t07"] == ["t00", "t01", "t02", "t03", "t04"] and {r.seed for r in want} == {"t07", "t20"}
    for got in (catalog.relationships_of(columns, held), catalog.relationships_of(repeated, chosen), catalog.relationships_of(repeated, held)):
        assert sorted(got.collect()) == want
    plan = catalog.relationships_of(columns, held)._jdf.queryExecution().executedPlan().toString()
    # rows are cut to the leading ones in every task, ahead of both shuffles
    assert plan.count("WindowGroupLimit") >= 4


def test_written_tables_let_their_shuffle_files_go(spark, monkeypatch):
    from kitescope import session

    held = []
    write = type(spark.range(1).write).parquet
    monkeypatch.setattr(type(spark.range(1).write), "parquet", lambda self, path, *a, **k: (held.append(spark.conf.get(session.LET_GO)), write(self, path, *a, **k))[1])
    kept = session.saved(spark.range(9).repartition(3, "id"), "kept")
    assert kept.count() == 9 and held == ["true"] and spark.conf.get(session.LET_GO) == "false"


def test_edges_read_from_a_file_travel_with_every_text_once(spark, tmp_path):
    rows = [("b", "a", "x", "y", "K", 0.5), ("a", "b", "x", "y", "L", None), ("b", "a", "y", "x", None, 0.1), ("c", "c", "x", "x", "M", 1.0), ("a", None, "x", "x", "M", 1.0)]
    path = str(tmp_path / "edges")
    spark.createDataFrame(rows, "from_table string, to_table string, from_column string, to_column string, relationship_type string, confidence double").coalesce(1).write.json(path)
    loaded = readers.load_erd_relationships(spark, path, multi_line=False)
    assert sorted(map(tuple, loaded.collect())) == [("a", "b", "x", "y", "L", 0.0), ("b", "a", "y", "x", "UNKNOWN", 0.1), ("c", "c", "x", "x", "M", 1.0)]
    dealt = [x for x in loaded._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Project [" in x and "least(" in x]
    assert len(dealt) == 1 and "from_table" not in re.sub(r"(least|greatest)\([^)]*\)|\([^()]*> [^()]*\)", "", dealt[0])
