"""Network analytics against brute force on small networks."""

from collections import deque
from itertools import permutations

import pytest

from kitescope.operators import network


def undirected(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return near


def brute_betweenness(names, edges):
    near, score = undirected(edges), dict.fromkeys(names, 0.0)
    for s, t in permutations(names, 2):
        dist, queue, paths = {s: 0}, deque([s]), []
        while queue:
            v = queue.popleft()
            for w in near.get(v, ()):
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
        if t not in dist:
            continue

        def walk(v, path):
            if v == s:
                paths.append(path)
            for w in near.get(v, ()):
                if dist.get(w, -1) == dist[v] - 1:
                    walk(w, path + [w])

        walk(t, [t])
        for p in paths:
            for v in p[1:-1]:
                score[v] += 1 / len(paths)
    n = len(names)
    return {v: x / ((n - 1) * (n - 2)) for v, x in score.items()}


NAMES = list("abcdefgh")
EDGES = [("a", "b"), ("b", "c"), ("a", "d"), ("d", "c"), ("c", "e"), ("e", "f"), ("f", "c"), ("f", "g")]  # h stands alone


@pytest.fixture(scope="module")
def small(spark):
    vertices = spark.createDataFrame([(n, f"the {n} thing") for n in NAMES], "name string, description string")
    edges = spark.createDataFrame([(a, b, "reference" if a < b else "odd") for a, b in EDGES], "src string, dst string, rel_type string")
    return vertices, network.build_network(vertices, edges)


@pytest.mark.parametrize("groups", [1, 3])
def test_betweenness_with_several_shortest_paths(small, groups):
    vertices, edges = small
    got = {r.name: r.score for r in network.betweenness(vertices, edges, source_groups=groups).collect()}
    assert got == pytest.approx(brute_betweenness(NAMES, EDGES), abs=1e-6)


@pytest.mark.parametrize("groups", [1, 3])
def test_betweenness_walks_twins_together(spark, monkeypatch, groups):
    # two hubs, six leaves of one, five vertices between both, a tail behind the other
    edges = [("h1", f"l{i}") for i in range(6)] + [(h, f"m{i}") for i in range(5) for h in ("h1", "h2")] + [("h2", "t1"), ("t1", "t2")]
    names = sorted({x for e in edges for x in e}) + ["alone"]
    vertices = spark.createDataFrame([(n,) for n in names], "name string")
    made = spark.createDataFrame(edges, "src string, dst string")
    states, real = [], network._dependencies
    monkeypatch.setattr(network, "_dependencies", lambda s, a: states.append(s.count()) or real(s, a))
    got = {r.name: r.score for r in network.betweenness(vertices, made, source_groups=groups).collect()}
    assert got == pytest.approx(brute_betweenness(names, edges), abs=1e-6)
    # sources: both hubs, leaves, those between, two of the tail
    assert sum(states) == 6


def test_betweenness_pivots_all_equals_exact(small):
    vertices, edges = small
    exact = {r.name: r.score for r in network.betweenness(vertices, edges).collect()}
    assert {r.name: r.score for r in network.betweenness(vertices, edges, pivots=8).collect()} == exact


def dense_pagerank(names, edges, rounds=None):
    """Ranks after that many rounds, or by the end rule (total change below n x 1e-6, at most 100 rounds)."""
    weights, both = {(r.src, r.dst): r.weight for r in edges.collect()}, {}
    for (a, b), w in weights.items():
        for p in ((a, b), (b, a)):
            both[p] = max(both.get(p, 0), w)
    total, n = {}, len(names)
    for (a, _), w in both.items():
        total[a] = total.get(a, 0) + w
    rank = dict.fromkeys(names, 1 / n)
    for done in range(1, (rounds or 100) + 1):
        loose = sum(r for v, r in rank.items() if v not in total)
        new = {v: (0.15 + 0.85 * loose) / n for v in names}
        for (a, b), w in both.items():
            new[b] += 0.85 * rank[a] * w / total[a]
        change = sum(abs(new[v] - rank[v]) for v in names)
        rank = new
        if rounds is None and change < n * 1e-6:
            break
    return rank, done


def scores(df):
    return {r.name: r.score for r in df.collect()}


@pytest.mark.parametrize("hub_slice", [1_000_000, 2])
def test_pagerank_equals_dense_iteration(small, hub_slice):
    vertices, edges = small
    rank, _ = dense_pagerank(NAMES, edges, 20)
    got = scores(network.pagerank(vertices, edges, iterations=20, tolerance=None, hub_slice=hub_slice))
    assert got == pytest.approx(rank, abs=1e-9) and sum(got.values()) == pytest.approx(1.0)


@pytest.mark.parametrize("save_every", [1, 4])
def test_pagerank_ends_with_the_first_settled_round(small, save_every):
    vertices, edges = small
    rank, done = dense_pagerank(NAMES, edges)
    assert 20 < done < 100
    got = scores(network.pagerank(vertices, edges, save_every=save_every))
    assert got == pytest.approx(rank, abs=1e-12)
    short = scores(network.pagerank(vertices, edges, iterations=done - 1, save_every=save_every))
    assert short != pytest.approx(rank, abs=1e-8)


def test_pagerank_without_edges_and_without_vertices(small):
    vertices, edges = small
    assert scores(network.pagerank(vertices, edges.limit(0))) == dict.fromkeys(NAMES, 1 / 8)
    assert scores(network.pagerank(vertices.limit(0), edges.limit(0))) == {}


def test_vertex_texts_list_columns_by_place(spark):
    vertices = spark.createDataFrame([("a", "red"), ("b", None), ("c", "blue")], "name string, description string")
    columns = spark.createDataFrame([("a", "y", 2), ("a", "z", 1), ("a", "x", 2), ("a", None, 0), ("b", "k", None), ("gone", "q", 1)], "table_name string, name string, place int")
    assert {r.name: r.text for r in network.vertex_texts(vertices, columns).collect()} == {"a": "red z x y", "b": " k", "c": "blue "}
    assert {r.name: r.text for r in network.vertex_texts(vertices).collect()} == {"a": "red", "b": "", "c": "blue"}


def test_build_network_drops_loops_and_strangers_and_keeps_the_heavier(spark):
    vertices = spark.createDataFrame([("a", ""), ("b", "")], "name string, description string")
    edges = spark.createDataFrame([("a", "a", "foreign_key"), ("a", "z", "foreign_key"), ("a", "b", "similar"), ("a", "b", "foreign_key"), ("b", "a", "made_up")], "src string, dst string, rel_type string")
    assert sorted((r.src, r.dst, r.weight) for r in network.build_network(vertices, edges).collect()) == [("a", "b", 0.9), ("b", "a", 0.5)]


def test_community_takes_three_then_two_of_two(spark):
    edges = spark.createDataFrame([("s", x) for x in "abcd"] + [("a", x) for x in "mno"] + [("b", "p"), ("c", "q")], "src string, dst string")
    seeds = spark.createDataFrame([("s",), ("lonely",)], "seed string")
    got = {}
    for r in network.ego_community(seeds, edges).collect():
        got.setdefault(r.seed, set()).add(r.entity)
    assert got == {"s": set("sabcmnp"), "lonely": {"lonely"}}


def test_greedy_paths_stop_below_the_threshold(spark):
    vertices = spark.createDataFrame([("s", "start"), ("x", "red ring"), ("y", "blue"), ("z", "red")], "name string, description string")
    edges = spark.createDataFrame([("s", "x", 0.9), ("s", "y", 0.9), ("x", "z", 0.5), ("z", "y", 0.5)], "src string, dst string, weight double")
    asked = spark.createDataFrame([("q", "red ring")], "question_id string, question string")
    seeds = spark.createDataFrame([("q", "s", 1)], "question_id string, entity string, rank int")
    # hop one: x = .6 + .36; hop two: z = .3 + 0, as there is no edge from the seed
    assert [r.entity for r in network.greedy_paths(asked, seeds, vertices, edges).orderBy("rank").collect()] == ["s", "x", "z"]
    assert [r.entity for r in network.greedy_paths(asked, seeds, vertices, edges, least=0.4).orderBy("rank").collect()] == ["s", "x"]
    assert [r.entity for r in network.greedy_paths(asked, seeds, vertices, edges, least=0.4, reward_from="current").orderBy("rank").collect()] == ["s", "x", "z"]


def test_ensemble_counts_repeats_and_ignores_extra_lists(spark):
    rows = [("q", 0, 1, "a"), ("q", 1, 1, "b"), ("q", 1, 2, "b"), ("q", 2, 2, "a"), ("q", 7, 1, "c")]
    lists = spark.createDataFrame(rows, "question_id string, list_no int, rank int, entity string")
    assert [(r.entity, r.score) for r in network.rank_ensemble(lists).orderBy("rank").collect()] == [("a", 0.55), ("b", 0.45)]


def test_advanced_retriever_falls_back_to_word_seeds(spark, small):
    vertices, edges = small
    asked = spark.createDataFrame([("q1", "thing with edges"), ("q2", "")], "question_id string, question string")
    ranks = network.pagerank(vertices, edges)
    got = network.advanced_retriever(asked, vertices, edges, ranks, network.degree_hubs(vertices, edges), network.betweenness_bridges(network.betweenness(vertices, edges)))
    rows = got.collect()
    assert {r.question_id for r in rows} == {"q1"}
    assert sorted(r["rank"] for r in rows) == list(range(1, len(rows) + 1)) and len(rows) <= 10


def test_attention_made_before_is_read_instead_of_edges(spark):
    vertices = spark.createDataFrame([(f"v{i}", f"text {i % 4} of ring") for i in range(12)], "name string, description string")
    edges = spark.createDataFrame([(f"v{i}", f"v{(i * 5 + 1) % 12}", "related", 0.5) for i in range(12)], "src string, dst string, rel_type string, weight double")
    questions = spark.createDataFrame([("a", "show ring"), ("b", "text of")], "question_id string, question string")
    wanted = spark.createDataFrame([("a", "v3"), ("a", "v7"), ("b", "v0")], "question_id string, entity string")
    mixed = network.attention_vectors(vertices, edges)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(network.neighbour_attention(questions, vertices, None, 5, mixed=mixed)) == rows(network.neighbour_attention(questions, vertices, edges, 5))
    ranks = rows(network.attention_ranks(questions, vertices, None, wanted, mixed=mixed))
    assert len(ranks) == 3 and ranks == rows(network.attention_ranks(questions, vertices, edges, wanted))
