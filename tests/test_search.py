"""Substring search, top-k and TF-IDF against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kitescope.functions.fixed_values import DEFAULT_STOP_WORDS
from kitescope.operators import retrieval, search, tfidf, topk


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["alpha", "beta", "gammaray", "a", "the", "of", "theory", "in", "bet", "rayon"]
    docs = [(f"t{i:03d}", " ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) + ("\nhot copy text" if i % 3 == 0 else ""), f"rule {i % 4}") for i in range(60)]
    return docs


@pytest.fixture(scope="module")
def entities(spark, texts):
    return spark.createDataFrame(texts, "name string, description string, rules string")


def test_matching_tokens(spark):
    tokens = ["alphabet", "bet", "beta", "x", "axb", "ab", "b"]
    needles = ["bet", "b", "alpha", "zz", "ab", "alphabets"]
    got = search.matching_tokens(spark.createDataFrame([(n,) for n in needles], "term string"), spark.createDataFrame([(t,) for t in tokens], "token string"))
    assert {(r.term, r.token) for r in got.collect()} == {(n, t) for n in needles for t in tokens if n in t}


def _final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()


def _between(plan, above, below, end):
    """Whether ``below`` stands under ``above`` with no ``end`` between them."""
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    for i, line in enumerate(plan):
        if above in line:
            for inner in plan[i + 1:]:
                if depth(inner) <= depth(line) or end in inner:
                    break
                if below in inner:
                    return True
    return False


def test_only_postings_of_asked_tokens_are_cut(spark):
    postings = spark.range(2000).selectExpr("concat('w', cast(id % 500 AS string)) AS token", "concat('t', cast(id AS string)) AS name")
    got = search.term_first_entities(spark.createDataFrame([("w49",), ("nowhere",)], "term string"), postings, 2)
    plan = _final_plan(got)
    assert _between(plan, "WindowGroupLimit", "LeftSemi", "ShuffleQueryStage")
    names = sorted(f"t{i}" for i in range(2000) if "w49" in f"w{i % 500}")[:2]
    assert {(r.term, r.name, r.place) for r in got.collect()} == {("w49", name, i + 1) for i, name in enumerate(names)}


@pytest.mark.parametrize("n", [1, 3, 1000])
def test_term_first_entities(spark, texts, entities, n):
    needles = ["the", "bet", "ray", "a", "nothing", "", "t00", "copy"]
    got = search.term_first_entities(spark.createDataFrame([(t,) for t in needles], "term string"), search.token_postings(entities, ["name", "description"]), n)
    want = set()
    for t in needles:
        hits = sorted(name for name, text, _ in texts if t in name or t in text)[:n]
        want |= {(t, name, i + 1) for i, name in enumerate(hits)}
    assert {(r.term, r.name, r.place) for r in got.collect()} == want


def test_few_terms_are_tried_in_the_rows_of_entities(spark, texts, entities):
    needles = ["the", "bet", "ray", "a", "nothing", "", "t00", "a h", "y h", "copy", None]
    rows = [(name, name + " " + text) for name, text, _ in texts]
    lists = search.token_lists(spark.createDataFrame(rows + [("unsaid", None), ("empty", "")], "name string, text string"), ["text"])
    terms = spark.createDataFrame([(t,) for t in needles], "term string")
    want = set()
    for t in needles[:-1]:
        hits = sorted(name for name, text in rows if any(t in w for w in text.split()))[:3]
        want |= {(t, name, i + 1) for i, name in enumerate(hits)}
    for few in (64, 0):  # in rows, and by the vocabulary
        got = search.term_first_entities(terms, lists, 3, few)
        assert {(r.term, r.name, r.place) for r in got.collect()} == want
    # only matches are shuffled, cut to the first names
    assert _between(_final_plan(search.term_first_entities(terms, lists, 3)), "WindowGroupLimit", "Generate explode", "ShuffleQueryStage")


def test_questions_with_equal_terms_are_answered_once(spark):
    columns = spark.createDataFrame([(f"t{i:02d}", [f"order_id{i}", "price"][: i % 3]) for i in range(30)] + [(None, ["order_id"]), ("none_id", None)],
                                    "table_name string, names array<string>")
    asked = [(f"q{i}", "show ORDER_ID and price" if i % 2 else "T0 TRADE_PRICE nothing") for i in range(200)]
    asked += [("q1", "which NONE_ID"), ("q2", "ORDER_ID29"), ("bare", "no"), ("unsaid", None), (None, "ORDER_ID")]
    questions = spark.createDataFrame(asked, "question_id string, question string")
    with_id, priced = [f"t{i:02d}" for i in range(1, 30) if i % 3], [f"t{i:02d}" for i in range(2, 30, 3)]
    per_term = {"order_id": with_id[:3], "price": priced[:3]}
    got = retrieval.column_match(questions, columns, retrieval.keyword_terms(F.col("question")))
    assert sum("ShuffleQueryStage" in line for line in _final_plan(got)) == 0  # questions meet a small table where they are
    held = {"order_id": lambda text: "ORDER_ID" in text.split(), "price": lambda text: "price" in text.lower()}
    want = [(q, t, name, i + 1) for q, text in asked if text for t in per_term if held[t](text) for i, name in enumerate(per_term[t])]
    key = lambda rows: sorted(((a or "", b, c, d) for a, b, c, d in rows))
    assert key(map(tuple, got.collect())) == key(want)
    ranks = {}
    for r in retrieval.column_retriever(questions, columns).collect():
        ranks.setdefault(r.question_id, []).append((r["rank"], r.entity, r.score))
    terms = {q: set() for q, _ in asked}
    for q, text in asked:
        terms[q] |= {w.lower() for w in (text or "").split() if re.fullmatch("[A-Z][A-Z_]+[A-Z]", w)}
        terms[q] |= {s.strip("_") for s in ("_id", "_price") if s in (text or "").lower()}
    hay = {f"t{i:02d}": [f"t{i:02d}", *[f"order_id{i}", "price"][: i % 3]] for i in range(30) if i % 3}
    for q, mine in terms.items():
        names = sorted({n for t in mine for n in sorted(n for n, texts in hay.items() if any(t in x for x in texts))[:3]})[:10]
        assert sorted(ranks.get(q, [])) == [(i + 1, n, 1.0) for i, n in enumerate(names)]


def test_phrase_matches(spark, texts, entities):
    phrases = ["HOT copy text", "copy", "alpha beta", "pha beta the", "t copy te", "rule 3", "the", " of", "not there at all"]
    asked = spark.createDataFrame([(f"q{i}", p) for i, p in enumerate(phrases)], "question_id string, question string")
    got = search.phrase_matches(asked, entities, ["name", "description", "rules"])
    want = {(f"q{i}", d[0]) for i, p in enumerate(phrases) for d in texts if any(p.lower() in x.lower() for x in d)}
    rows = [(r.question_id, r.name) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_top_is_a_prefix_of_a_longer_top(spark, entities):
    asked = spark.createDataFrame([("q", "theory gammaray alpha")], "question_id string, question string")
    seeds = [[(r.rank, r.entity) for r in retrieval.semantic_seeds(asked, entities, n).orderBy("rank").collect()] for n in (2, 3)]
    short = {e for _, e in seeds[0]}
    assert short <= {e for _, e in seeds[1]}


@pytest.fixture(scope="module")
def vectors_data():
    rng = np.random.default_rng(3)
    e = rng.normal(size=(300, 8)).round(1)
    e[7] = 0
    q = rng.normal(size=(23, 8)).round(1)
    return e, q


def frames(spark, e, q):
    entities = spark.createDataFrame([(f"e{i:04d}", f"g{i % 3 if i % 3 else 0}", v.tolist()) for i, v in enumerate(e)], "entity string, table_name string, embedding array<double>").repartition(5)
    asked = spark.createDataFrame([(f"q{i:02d}", v.tolist()) for i, v in enumerate(q)], "question_id string, embedding array<double>")
    return entities, asked


def cosines(e, q):
    n = np.linalg.norm(e, axis=1)
    n[n == 0] = np.nan
    return np.round((e / n[:, None]) @ (q / np.linalg.norm(q, axis=1)[:, None]).T, 6)


@pytest.mark.parametrize("chunk", [2_000_000, 300])
def test_top_scores_equal_brute_force(spark, vectors_data, monkeypatch, chunk):
    monkeypatch.setattr(topk, "BLOCK_NUMBERS", chunk)
    e, q = vectors_data
    entities, asked = frames(spark, e, q)
    got = {}
    for r in retrieval.vector_tables(asked, entities, 0.3, 5).collect():
        got.setdefault(r.question_id, {})[r["rank"]] = (r.entity, r.score)
    c = cosines(e, q)
    for j in range(len(q)):
        order = sorted((-c[i, j], f"e{i:04d}") for i in range(len(e)) if c[i, j] > 0.3)[:5]
        assert got.get(f"q{j:02d}", {}) == {k + 1: (name, pytest.approx(-s)) for k, (s, name) in enumerate(order)}


def test_group_means(spark, vectors_data):
    e, q = vectors_data
    entities, asked = frames(spark, e, q)
    c = cosines(e, q)
    groups = np.array([f"g{i % 3}" for i in range(len(e))])
    pre = {(r.question_id, r.entity): r.score for r in retrieval.vector_columns_prefilter(asked, entities).collect()}
    post = {(r.question_id, r.entity): r.score for r in retrieval.vector_columns_postfilter(asked, entities, threshold=-1.0).collect()}
    for j in range(len(q)):
        for g in ("g0", "g1", "g2"):
            mine = c[groups == g, j]
            mine = mine[~np.isnan(mine)]
            assert pre[(f"q{j:02d}", g)] == pytest.approx(mine[mine > 0.2].mean(), abs=2e-6)
            assert post[(f"q{j:02d}", g)] == pytest.approx(mine.mean(), abs=2e-6)


def test_exact_ranks(spark, vectors_data, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_NUMBERS", 300)
    e, q = np.abs(vectors_data[0]), np.abs(vectors_data[1])
    q[3] = q[2]
    ents = spark.createDataFrame([(f"e{i:04d}", v.tolist()) for i, v in enumerate(e)], "entity string, vector array<double>").repartition(4)
    asked = spark.createDataFrame([(f"q{i:02d}", v.tolist()) for i, v in enumerate(q)], "question_id string, vector array<double>")
    s = np.round(e @ q.T, 6)
    wanted = [(f"q{j:02d}", f"e{i:04d}") for j in range(len(q)) for i in (0, 5, 7, 100, 299)]
    got = {(r.question_id, r.entity): r["rank"] for r in topk.exact_ranks(ents, asked, spark.createDataFrame(wanted, "question_id string, entity string"), 0.1).collect()}
    want = {}
    for j in range(len(q)):
        order = [n for _, n in sorted((-s[i, j], f"e{i:04d}") for i in range(len(e)) if s[i, j] > 0.1)]
        want.update({(f"q{j:02d}", n): order.index(n) + 1 for qq, n in wanted if qq == f"q{j:02d}" and n in order})
    assert got == want


def test_tfidf_equals_formula(spark, texts):
    corpus = [(name, text) for name, text, _ in texts]
    asked = [("q1", "Theory of the gammaray alpha beta"), ("q2", "zzz unknown"), ("q3", "hot copy")]

    def grams(text):
        w = [x for x in re.findall(r"\w{2,}", text.lower()) if x not in DEFAULT_STOP_WORDS]
        return w + [f"{a} {b}" for a, b in zip(w, w[1:])]

    counts = {n: Counter(grams(t)) for n, t in corpus}
    total, df = Counter(), Counter()
    for c in counts.values():
        total.update(c)
        df.update(c.keys())
    vocab = [t for t, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:12]]
    idf = {t: math.log((1 + len(corpus)) / (1 + df[t])) + 1 for t in vocab}

    def vec(c):
        w = {t: c[t] * idf[t] for t in vocab if c[t]}
        n = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / n for t, x in w.items()} if n else {}

    model = tfidf.fit(spark.createDataFrame(corpus, "entity string, text string"), 12)
    got = {}
    for r in tfidf.search(model, spark.createDataFrame(asked, "question_id string, question string"), 4).collect():
        got.setdefault(r.question_id, {})[r["rank"]] = (r.entity, r.score)
    for qid, text in asked:
        v = vec(Counter(grams(text)))
        scored = sorted((-round(sum(x * d.get(t, 0) for t, x in v.items()), 6), n) for n, d in ((n, vec(c)) for n, c in counts.items()))
        want = {i + 1: (n, pytest.approx(-s, abs=2e-6)) for i, (s, n) in enumerate([x for x in scored if -x[0] > 0.01][:4])}
        assert got.get(qid, {}) == want


def test_table_documents_keep_columns_in_order(spark):
    tables = spark.createDataFrame([("a", "about a"), ("b", None)], "name string, description string")
    columns = spark.createDataFrame([("a", 2, "y", "second"), ("a", 1, "x", None)], "table_name string, ordinal_position int, name string, description string")
    got = {r.entity: r.text for r in tfidf.table_documents(tables, columns).collect()}
    assert got == {"a": "about a x:  y: second", "b": " "}


def test_parse_ranked_answers(spark):
    names = spark.createDataFrame([("Sales.Orders",), ("sales.orders_old",), ("ledger",)], "name string")
    answers = spark.createDataFrame(
        [("q1", ' "Sales.Orders", SALES.ORDERS_OLD, ab, the ledger'), ("q2", "orders\nledger"), ("q3", "'ledger'"), ("q4", "nothing known")], "question_id string, response string"
    )
    got = sorted((r.question_id, r.pos, r.entity) for r in retrieval.parse_ranked_answers(answers, names).collect())
    assert got == [("q1", 0, "Sales.Orders"), ("q1", 1, "sales.orders_old"), ("q2", 0, "Sales.Orders"), ("q2", 1, "ledger"), ("q3", 0, "ledger")]


def test_vectors_meet_vectors_of_their_length_only(spark, monkeypatch):
    entities = spark.createDataFrame([("two", [1.0, 0.0]), ("three", [1.0, 0.0, 0.0])], "entity string, vector array<double>")
    questions = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0, 0.0]), ("c", [1.0])], "question_id string, vector array<double>")
    for numbers in (topk.BLOCK_NUMBERS, 1):
        monkeypatch.setattr(topk, "BLOCK_NUMBERS", numbers)
        got = topk.top_scores(entities, questions, 5, None).collect()
        assert sorted((r.question_id, r.entity) for r in got) == [("a", "two"), ("b", "three")]
    wanted = spark.createDataFrame([(q, e) for q in "ab" for e in ("two", "three")], "question_id string, entity string")
    assert sorted(map(tuple, topk.exact_ranks(entities, questions, wanted, 0.0).collect())) == [("a", "two", 1), ("b", "three", 1)]


def test_one_and_many_blocks_give_the_same_rows(spark, monkeypatch):
    rng = np.random.default_rng(8)
    entities = spark.createDataFrame([(f"e{i:03d}", rng.standard_normal(6 if i % 3 else 4).tolist()) for i in range(200)], "entity string, vector array<double>")
    questions = spark.createDataFrame([(f"q{i:02d}", rng.standard_normal(6 if i % 2 else 4).tolist()) for i in range(30)], "question_id string, vector array<double>")
    groups = entities.withColumnRenamed("entity", "group_key")
    wanted = spark.createDataFrame([(f"q{i:02d}", f"e{i:03d}") for i in range(30)], "question_id string, entity string")

    def run():
        best = [topk.top_scores(entities, questions, 4, t, cosine=c) for t, c in ((None, False), (0.9, True), (1.5, True))]
        folded = topk.group_scores(groups, questions, 0.1).selectExpr("question_id", "group_key", "round(total, 9) AS total", "n")
        return [sorted(map(tuple, df.collect())) for df in (*best, folded, topk.exact_ranks(entities, questions, wanted, -9.0))]

    whole = run()
    assert whole[0] and whole[1] and not whole[2]
    monkeypatch.setattr(topk, "BLOCK_NUMBERS", 24)
    assert run() == whole


def test_top_scores_of_nothing(spark):
    none = spark.createDataFrame([], "entity string, vector array<double>")
    asked = spark.createDataFrame([("q", [1.0, 2.0]), ("empty", []), ("null", None)], "question_id string, vector array<double>")
    some = spark.createDataFrame([("e", [0.0, 0.0]), ("f", None), ("g", [])], "entity string, vector array<double>")
    assert topk.top_scores(none, asked, 3, None).count() == 0
    assert topk.top_scores(some, asked, 3, None, cosine=True).count() == 0
    assert [tuple(r) for r in topk.top_scores(some, asked, 3, None).collect()] == [("q", "e", 0.0, 1)]


def test_sparse_search_equals_the_full_product(spark):
    rng = np.random.default_rng(2)
    words = [f"t{i}" for i in range(25)]
    share = 1 / np.arange(1, 26)
    text = lambda n: " ".join(rng.choice(words, size=n, p=share / share.sum()))
    corpus = spark.createDataFrame([(f"e{i:03d}", text(rng.integers(1, 30))) for i in range(250)] + [("none", "")], "entity string, text string")
    asked = spark.createDataFrame([(f"q{i:02d}", text(rng.integers(1, 12))) for i in range(40)] + [("bare", "unknown")], "question_id string, question string")
    model = tfidf.fit(corpus, 60)
    unpack = lambda df, key: {r[key]: dict(zip(r.positions, r.weights)) for r in df.collect()}
    rows = unpack(model.entities, "entity")
    for k in (1, 7):
        got = {}
        for r in tfidf.search(model, asked, k).collect():
            got.setdefault(r.question_id, []).append((r["rank"], r.entity, round(r.score, 5)))
        for q, v in unpack(model.weights(asked.withColumnRenamed("question", "text"), "question_id"), "question_id").items():
            scores = sorted((-round(sum(w * e.get(p, 0.0) for p, w in v.items()), 6), n) for n, e in rows.items())
            want = [-s for s, _ in scores if -s > 0.01][:k]
            mine = sorted(got.get(q, []))
            assert [s for _, _, s in mine] == pytest.approx(want, abs=2e-5)
            full = {n: -s for s, n in scores}
            assert all(abs(full[n] - s) < 2e-5 for _, n, s in mine) and [r for r, _, _ in mine] == list(range(1, len(want) + 1))
    assert "bare" not in got


def leading_terms(corpus, n):
    """The n most frequent words and pairs with their document counts, and every entity's counts of them."""
    counts = {}
    for name, text in corpus:
        w = [x for x in re.findall(r"\w{2,}", (text or "").lower()) if x not in DEFAULT_STOP_WORDS]
        counts.setdefault(name, Counter()).update(w + [f"{a} {b}" for a, b in zip(w, w[1:])])
    total, df = Counter(), Counter()
    for c in counts.values():
        total.update(c)
        df.update(c.keys())
    terms = sorted(t for t, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:n])
    return terms, [df[t] for t in terms], {e: {terms.index(t): m for t, m in c.items() if t in terms} for e, c in counts.items()}


@pytest.mark.parametrize("n", [1, 4, 20, 500])
@pytest.mark.parametrize("ties", [False, True])
def test_leading_terms_and_rows_equal_counting_all(spark, n, ties):
    rng = np.random.default_rng(n)
    words = ["b", "the", "ab", "abc", "ab_id", "x1", "holds", "é1", "of", "zz", "yy"]
    share = np.ones(11) / 11 if ties else 1 / np.arange(1, 12) / (1 / np.arange(1, 12)).sum()
    corpus = [(f"e{i}", " ".join(rng.choice(words, size=rng.integers(1, 3 if ties else 30), p=share))) for i in range(30)]
    corpus += [(None, "zz ab holds"), (None, "ab holds zz zz"), ("bare", "of the"), ("none", None)]
    if ties:
        corpus += [("alpha", "aa bb cc dd"), ("beta", "dd cc bb aa")]
    terms, df, rows = leading_terms(corpus, n)
    frame = spark.createDataFrame(corpus, "entity string, text string")
    for given in (frame, frame.select("entity", tfidf.all_words(F.col("text")).alias("words"))):
        model = tfidf.fit(given, n)
        assert [(r.term, r.df) for r in model.vocabulary.orderBy("position").collect()] == list(zip(terms, df))
        idf = [math.log((1 + len(corpus)) / (1 + d)) + 1 for d in df]
        got = {r.entity: dict(zip(r.positions, r.weights)) for r in model.entities.collect()}
        assert set(got) == {e for e, c in rows.items() if c}
        for e, weights in got.items():
            length = math.sqrt(sum((m * idf[p]) ** 2 for p, m in rows[e].items()))
            assert weights == pytest.approx({p: m * idf[p] / length for p, m in rows[e].items()})


def test_fitting_counts_only_pairs_that_can_lead_and_shuffles_no_entity(spark, monkeypatch):
    monkeypatch.setattr(tfidf, "grams", lambda words: pytest.fail("all pairs are spread"))
    corpus = [(f"e{i}", "red blue red green " + " ".join(f"w{i}x{j}" for j in range(20))) for i in range(20)]
    model = tfidf.fit(spark.createDataFrame(corpus, "entity string, text string"), 5)
    assert [r.term for r in model.vocabulary.orderBy("position").collect()] == ["blue", "blue red", "green", "red", "red blue"]
    plan = model.entities._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(entity" not in plan


def test_word_lists_of_documents_equal_their_texts(spark):
    from kitescope.plans.carriers import Carriers

    c = Carriers(spark, "/root/testdata/sf0.001")
    lists = {r.entity: r.words for r in c("c_word_lists").collect()}
    texts = tfidf.table_documents(c("c_tables"), c("c_columns")).select("entity", tfidf.all_words(F.col("text")).alias("words"))
    assert {r.entity: r.words for r in texts.collect()} == lists
