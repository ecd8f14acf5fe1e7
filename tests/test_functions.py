"""Column rules on hand-made rows."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from kitescope.functions import naming, sqltext, terms, vectors
from kitescope.operators import sqlscore


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("name,kind", [
    ("db.om_trade_fact", "fact"), ("PRODUCT_DIM", "dimension"), ("FACT_DIM", "fact"), ("x_lookup", "reference"),
    ("market_feed", "market_data"), ("fiscal_calendar", "calendar"), ("ledger", "unknown"),
])
def test_table_type_takes_first_rule(spark, name, kind):
    assert one(spark, naming.table_type(F.col("n")), n=name) == kind


@pytest.mark.parametrize("name,category", [
    ("product_sk", "id"), ("paid", "id"), ("natural_key", "key"), ("zip_code", "code"), ("trade_date", "date"),
    ("unit_price", "measure"), ("order_status", "type"), ("long_text", "attribute"), ("qux", "unknown"),
])
def test_column_category(spark, name, category):
    assert one(spark, naming.column_category(F.col("n")), n=name) == category


@pytest.mark.parametrize("value,kind", [("2024-01-05", "date"), ("20240105", "date"), ("abc", "categorical"), ("x" * 51, "text"), ("12345678901", "categorical")])
def test_value_type(spark, value, kind):
    assert one(spark, naming.value_type(F.col("v")), v=value) == kind
    assert one(spark, naming.value_type(F.col("v"), True), v=value) == "numeric"


@pytest.mark.parametrize("name,kind,confidence", [
    ("product_sk", "SURROGATE_KEY", 0.95), ("SMCP", "SMCP_MATCH", 0.95), ("order_id", "KEY_MATCH", 0.90), ("cust_key_no", "KEY_MATCH", 0.90),
    ("zip_code", "CODE_MATCH", 0.85), ("key", "ID_MATCH", 0.80), ("soeid", "ID_MATCH", 0.80), ("price", "NO_MATCH", 0.0),
])
def test_relationship_rules(spark, name, kind, confidence):
    assert one(spark, naming.relationship_type(F.col("n")), n=name) == kind
    assert one(spark, naming.relationship_confidence(F.col("n")), n=name) == confidence


def test_identifier_terms_need_three_upper_case_characters(spark):
    text = "show EXECUTION_VENUE and AB or A_B, xTRADE ÉTAT TRADE_ID EXECUTION_VENUE"
    assert one(spark, terms.identifier_terms(F.col("q")), q=text) == ["execution_venue", "a_b", "trade_id", "execution_venue"]


def test_long_words_are_measured_before_stripping(spark):
    assert one(spark, terms.long_words(F.col("q")), q="all. of [Books] now, tell") == ["all", "books", "now", "tell"]


def test_column_terms_strip_underscores(spark):
    assert one(spark, terms.column_terms(F.col("q")), q="PRODUCT_SK and the trade_date") == ["product_sk", "sk", "date"]


def test_intent_types(spark):
    assert one(spark, terms.intent_types_regex(F.col("q")), q="intra-day trade codes by venue") == ["fact", "dimension"]
    assert one(spark, terms.intent_types_keywords(F.col("q")), q="market lookup") == ["dimension", "reference", "market_data"]
    assert one(spark, terms.intent_types_keywords(F.col("q")), q="hello") == ["fact", "dimension", "reference"]


def test_complexity_level(spark):
    assert one(spark, terms.complexity_level(F.col("q")), q="a JOIN b GROUP BY c") == "Medium"
    assert one(spark, terms.complexity_level(F.col("q")), q="a JOIN b") == "Simple"
    assert one(spark, terms.complexity_level(F.col("q")), q="x UNION y") == "Complex"


def test_embedding_is_repeatable_and_bounded(spark):
    a = one(spark, vectors.text_embedding(F.col("t")), t="hello")
    b = one(spark, vectors.text_embedding(F.col("t")), t="hello")
    assert a == b and len(a) == 10 and all(0 <= x < 1 for x in a)
    assert one(spark, vectors.text_embedding(F.lit(None).cast("string"))) == [0.0] * 10


def test_fit_vector_cuts_pads_and_blanks(spark):
    v = F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))
    assert one(spark, vectors.fit_vector(v, 2)) == [1.0, 2.0]
    assert one(spark, vectors.fit_vector(v, 5)) == [1.0, 2.0, 3.0, 0.0, 0.0]
    assert one(spark, vectors.fit_vector(v, 2, F.lit("  "))) == [0.0, 0.0]


def test_unit_keeps_zero_vectors(spark):
    assert one(spark, vectors.unit(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
    assert one(spark, vectors.unit(F.array(F.lit(3.0), F.lit(4.0)))) == [0.6, 0.8]


def test_attention_never_negative(spark):
    assert one(spark, vectors.attention(F.array(F.lit(1.0)), F.array(F.lit(-1.0)))) == 0.0


def test_tables_in_sql(spark):
    sql = "select a from Sales.Orders o join lineitem l on 1=1 where x in (select y from sales.orders)"
    assert sorted(one(spark, sqltext.tables_in_sql(F.col("s")), s=sql)) == ["LINEITEM", "ORDERS"]
    assert sorted(one(spark, sqltext.tables_in_sql(F.col("s"), True), s=sql)) == ["LINEITEM", "SALES.ORDERS"]


def test_clause_parts(spark):
    sql = "SELECT a, b FROM t JOIN u ON t.a = u.a WHERE a > 1 GROUP BY a, b HAVING count(*) > 2 ORDER BY a LIMIT 3"
    parts = {c: one(spark, sqltext.sql_component(F.col("s"), c), s=sql) for c in sqlscore.CLAUSES}
    assert parts["select"] == ["A", "B"] and parts["from"] == ["T"] and parts["where"] == ["A > 1"]
    assert parts["group_by"] == ["A", "B"] and parts["having"] == ["COUNT(*) > 2"] and parts["order_by"] == ["A"]


def test_exact_match_ignores_layout_and_case(spark):
    pairs = spark.createDataFrame([(1, "select  a\nfrom t ", "SELECT a FROM T"), (2, "select b", "select a")], "pair_id int, generated_sql string, truth_sql string")
    assert [r.m for r in pairs.select("pair_id", sqlscore.exact_match(pairs).alias("m")).orderBy("pair_id").collect()] == [1.0, 0.0]


def test_soft_f1_equals_brute_force(spark):
    rows = [
        (1, "SELECT o_orderkey, totl_price FROM orders WHERE custkey = 1", "SELECT o_orderkey, total_price FROM orders WHERE cust_key = 2"),
        (2, "SELECT a1 FROM b2", "SELECT c3 FROM d4"),
        (3, "", "SELECT x1 FROM y1"),
        (4, "SELECT revenue, revenue FROM order_lines", "SELECT revenues FROM orderlines"),
    ]
    pairs = spark.createDataFrame(rows, "pair_id int, generated_sql string, truth_sql string")
    ents = pairs.select("pair_id", sqltext.entities(F.col("generated_sql")).alias("g"), sqltext.entities(F.col("truth_sql")).alias("t")).collect()
    want = {}
    for r in ents:
        hits = sum(any(SequenceMatcher(None, x, y).ratio() > 0.8 for y in r.t) for x in r.g)
        p, q = (hits / len(r.g) if r.g else 0.0), (hits / len(r.t) if r.t else 0.0)
        want[r.pair_id] = 2 * p * q / (p + q) if p + q else 0.0
    got = {r.pair_id: r.soft_f1 for r in sqlscore.soft_f1(pairs).collect()}
    assert got == pytest.approx(want) and want[1] > 0.9 and want[4] > 0


def test_matching_blocks_equal_the_matcher_on_thousands_of_pairs(spark):
    rng = random.Random(7)
    words = lambda letters, most: "".join(rng.choice(letters) for _ in range(rng.randint(0, most)))
    rows = [(words("ab_", 9), words("ab_", 9)) for _ in range(2000)] + [(words("order_ky", 16), words("order_ky", 16)) for _ in range(1000)]
    rows += [("", ""), ("a", ""), ("", "a"), ("x" * 60, "x" * 61), ("ab" * 20, "ba" * 20), ("é_ü", "ü_é"), ("l_orderkey", "orderkey_l"), ("l_orderkey", "l_orderkeys")]
    df = spark.createDataFrame(rows, "x string, y string").distinct()
    got = df.select("x", "y", sqlscore.matching_blocks_ratio(F.col("x"), F.col("y")).alias("r")).collect()
    assert len(got) > 2000
    assert [(r.x, r.y) for r in got if r.r != SequenceMatcher(None, r.x, r.y).ratio()] == []


def test_overall_weights_use_present_scores_only(spark):
    rows = spark.createDataFrame([(1.0, 0.5, None, None)], "execution double, logical double, partial double, judge double")
    assert sqlscore.overall_a(rows).first().overall == pytest.approx((0.4 + 0.125) / 0.65)


def test_compare_results_treats_nulls_as_equal_and_empty_truth_as_zero(spark):
    schema = "a int, b string"
    g = spark.createDataFrame([(1, None), (1, None), (2, "x")], schema)
    t = spark.createDataFrame([(1, None), (3, "y")], schema)
    r = sqlscore.compare_results(g, t).first()
    assert (r.generated_rows, r.truth_rows, r.precision, r.recall, r.jaccard) == (3, 2, 0.5, 0.5, pytest.approx(1 / 3))
    empty = spark.createDataFrame([], schema)
    assert sqlscore.compare_results(g, empty).first().f1_score == 0.0
    e = sqlscore.compare_results(empty, empty)
    assert e.count() == 0 or e.first().f1_score == 0.0


def test_many_results_equal_the_comparison_row_by_row(spark):
    rng = random.Random(3)
    cell = lambda: rng.choice([None, 1, 2])
    sides = ([], [])
    for k in [None, *range(300)]:
        rows = [(k, cell(), rng.choice([None, "x"])) for _ in range(rng.randint(0, 4))]
        other = list(rows) if k is None or k % 3 else [(k, cell(), rng.choice([None, "x"])) for _ in range(rng.randint(0, 4))]
        rng.shuffle(other)
        sides[0].extend(rows)
        sides[1].extend(other + other[:1] * (k == 7))
    sides[0].extend([(1000, None, "x"), (1001, 1, None)])
    sides[1].extend([(1000, 1, None), (1001, 1, None)])
    g, t = (spark.createDataFrame(rows, "k int, a int, b string") for rows in sides)
    as_rows = lambda df: sorted(map(str, df.collect()))
    assert as_rows(sqlscore.compare_many_results(g, t, ["k"])) == as_rows(sqlscore.compare_results(g, t, ["k"]))
    prints = {r.k: r.same for r in sqlscore.result_fingerprints(sqlscore._marked(g, t), t.columns, ["k"]).collect()}
    bags = {k: [sorted(map(repr, [r for r in side if r[0] == k])) for side in sides] for k in prints}
    assert prints == {k: x == y for k, (x, y) in bags.items()} and not prints[1000] and prints[1001]
    assert sqlscore.compare_many_results(g.limit(0), t.limit(0), ["k"]).count() == 0


def test_pair_cosine_in_the_row_equals_the_joined_one_without_a_shuffle(spark):
    rows = [(1, "a bb cc bb cc bb", "bb cc dd bb"), (2, "", "xx yy"), (3, None, "xx"), (4, "same words same", "same words same"), (5, "aa bb aa", "cc dd"), (6, "bb aa bb aa bb", "aa")]
    pairs = spark.createDataFrame(rows, "pair_id bigint, generated_sql string, truth_sql string")
    near = sqlscore.pair_tfidf_cosine(pairs, unique=True)
    assert "Exchange" not in near._jdf.queryExecution().executedPlan().toString()
    got, expected = ({r.pair_id: r.semantic for r in df.collect()} for df in (near, sqlscore.pair_tfidf_cosine(pairs)))
    assert got == pytest.approx(expected) and got[4] == pytest.approx(1) and got[3] == 0


def test_text_scores_are_made_in_dealt_rows_without_a_join(spark):
    rows = [(i, f"SELECT a{i % 3}, SUM(b) FROM t WHERE c > {i}", f"SELECT a{i % 4}, SUM(b) FROM {'t' if i % 2 else 'u'} WHERE c > {i}", 0.5) for i in range(40)]
    rows += [(40, "", "SELECT x FROM y", None), (None, "SELECT x FROM y", "SELECT x FROM y", 1.0)]
    pairs = spark.createDataFrame(rows, "pair_id bigint, generated_sql string, truth_sql string, judge_score double").coalesce(1)
    scored = sqlscore.score_texts(pairs)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning(pair_id") == 1
    assert scored.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    got = {r.pair_id: r for r in scored.collect()}
    assert set(got) == set(range(41))
    cosine = {r.pair_id: r.semantic for r in sqlscore.pair_tfidf_cosine(pairs, unique=True).collect()}
    soft = {r.pair_id: r.soft_f1 for r in sqlscore.soft_f1_edit(pairs).collect()}
    assert all(got[i].semantic == cosine[i] and got[i].soft_f1 == soft[i] for i in got)
