"""Registered queries for network analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from kitescope.functions import fixed_values as fixed
from kitescope.functions import vectors
from kitescope.operators import network
from kitescope.plans.registry import query
from kitescope.plans.retrieval_queries import COLS, ENTITY_HAY, cut_sql, exploded_sql, term_top_sql
from kitescope.plans.text_queries import SEEDS
from kitescope.session import cut_lineage, saved

WEIGHT = "CASE rel_type " + " ".join(f"WHEN '{k}' THEN {w}::DOUBLE" for k, w in fixed.EDGE_WEIGHTS.items()) + " ELSE 0.5 END"


def edges_sql(g: str) -> str:
    return f"""{g}e AS (SELECT src, dst, rel_type, w AS weight FROM (SELECT *, {WEIGHT} AS w, row_number() OVER (PARTITION BY src, dst ORDER BY {WEIGHT} DESC, rel_type DESC) AS rn
 FROM {g}_edges WHERE src <> dst AND src IN (SELECT name FROM {g}_vertices) AND dst IN (SELECT name FROM {g}_vertices)) x WHERE rn = 1)"""


def edges(c, g: str):
    return network.build_network(c(f"{g}_vertices"), c(f"{g}_edges"))


@query("g1_build_network", f"WITH {edges_sql('gl')} SELECT src, dst, rel_type, weight FROM gle")
def g1(c):
    return edges(c, "gl")


def words_sql(q: str) -> str:
    return rf"list_filter(string_split_regex(lower({q}), '\s+'), lambda w: w <> '')"


def number_sql(t: str) -> str:
    return f"CAST('0x' || substr(md5({t}), 1, 8) AS BIGINT)"


RAW_CODE = f"list_transform(range(1, 11), lambda i: CASE WHEN i <= len(w) THEN CAST({number_sql('w[i]')} % 100 AS DOUBLE) / 100 ELSE 0 END)"
NORM = "sqrt(list_sum(list_transform({x}, lambda v: v * v)))"


def code_sql(source: str) -> str:
    """qcode(question_id, v) of G2."""
    return f"""qraw AS (SELECT question_id, {RAW_CODE} AS r FROM (SELECT question_id, {words_sql('question')} AS w FROM {source}) q0),
 qcode AS (SELECT question_id, list_transform(r, lambda x: x / ({NORM.format(x='r')} + 1e-8::DOUBLE)) AS v FROM qraw)"""


@query("g2_encode_question", f"WITH {code_sql('q_order')} SELECT question_id, {', '.join(f'round(v[{i + 1}], 6) AS s{i}' for i in range(10))} FROM qcode")
def g2(c):
    coded = c("q_order").select("question_id", vectors.encode_question(F.col("question")).alias("v"))
    return coded.select("question_id", *[F.round(F.col("v")[i], 6).alias(f"s{i}") for i in range(10)])


@query(
    "g3_attention",
    """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT a.vec_id, round(greatest(0, list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)) + 1e-8::DOUBLE)), 6) AS attention
 FROM e a JOIN e b ON b.vec_id = a.vec_id + 1""",
)
def g3(c):
    a, b = c("embeddings").alias("a"), c("embeddings").alias("b")
    return a.join(b, F.col("b.vec_id") == F.col("a.vec_id") + 1).select(
        F.col("a.vec_id").alias("vec_id"), F.round(vectors.attention(F.col("a.embedding"), F.col("b.embedding")), 6).alias("attention")
    )


HASH_TEXT = f"list_transform(range(10), lambda i: CAST({number_sql('text || CAST(i AS VARCHAR)')} % 1000 AS DOUBLE) / 1000)"


def attention_sql(g: str, questions: str) -> str:
    """att(question_id, entity, score, rank): the complete ranking of G4."""
    return f"""{code_sql(questions)}, vtext AS (SELECT v.name, coalesce(v.description, '') || ' ' || coalesce(string_agg(c.name, ' ' ORDER BY c.place, c.name), '') AS text
  FROM {g}_vertices v LEFT JOIN {g}_columns c ON c.table_name = v.name GROUP BY v.name, v.description), vv AS (SELECT name, {HASH_TEXT} AS v FROM vtext),
 cells AS (SELECT q.question_id, x.name, list_dot_product(q.v, x.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(x.v, x.v)) + 1e-8::DOUBLE) AS a FROM qcode q CROSS JOIN vv x),
 nb AS (SELECT c.question_id, e.src AS name, avg(c.a) AS m FROM {g}e e JOIN cells c ON c.name = e.dst GROUP BY 1, 2),
 mix AS (SELECT c.question_id, c.name AS entity, round(CASE WHEN nb.m IS NULL THEN c.a ELSE c.a * 0.7::DOUBLE + nb.m * 0.3::DOUBLE END, 6) AS score
  FROM cells c LEFT JOIN nb ON nb.question_id = c.question_id AND nb.name = c.name),
 att AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, entity) AS rank FROM mix WHERE score > 0.1)"""


@query("g4_neighbour_attention", f"WITH {edges_sql('gl')}, {attention_sql('gl', 'gl_questions')} SELECT question_id, entity, score, CAST(rank AS INT) AS rank FROM att WHERE rank <= 10")
def g4(c):
    return network.neighbour_attention(c("gl_questions"), c("gl_vertices"), edges(c, "gl"), columns=c("gl_columns")).select(*COLS)


def overlap_sql(desc: str, words: str) -> str:
    return f"CASE WHEN {desc} = '' OR len({words}) = 0 THEN 0 ELSE len(list_filter({words}, lambda t: contains(lower({desc}), t))) / CAST(len({words}) AS DOUBLE) END"


@query(
    "g5_term_overlap",
    f"""SELECT v.conv_id, v.turn, round({overlap_sql('d.text', words_sql('v.text'))}, 6) AS overlap FROM conversations v JOIN documents d ON d.doc_id = v.conv_id""",
)
def g5(c):
    v, d = c("conversations"), c("documents").select(F.col("doc_id").alias("conv_id"), F.col("text").alias("description"))
    from kitescope.functions.terms import all_terms

    return v.join(d, "conv_id").select("conv_id", "turn", F.round(network.term_overlap(F.col("description"), all_terms(F.col("text"))), 6).alias("overlap"))


def paths_sql(g: str, questions: str) -> str:
    """rl(question_id, entity, rank): G6 from the five best of att."""
    worth = f"round({overlap_sql('v.description', 'q.w')} * 0.6::DOUBLE + {{reward}} * 0.4::DOUBLE, 6)"
    return f"""qw AS (SELECT question_id, {words_sql('question')} AS w FROM {questions}), five AS (SELECT question_id, entity, rank FROM att WHERE rank <= 5),
 h1 AS (SELECT f.question_id, f.entity AS seed, f.rank AS seed_rank, e.dst, {worth.format(reward='e.weight')} AS worth FROM five f JOIN {g}e e ON e.src = f.entity JOIN {g}_vertices v ON v.name = e.dst
  JOIN qw q ON q.question_id = f.question_id WHERE f.rank <= 3),
 p1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id, seed ORDER BY worth DESC, dst) AS rn FROM h1) x WHERE rn = 1 AND worth > 0.2),
 h2 AS (SELECT p.question_id, p.seed, p.seed_rank, e.dst, {worth.format(reward='coalesce(d.weight, 0)')} AS worth FROM p1 p JOIN {g}e e ON e.src = p.dst JOIN {g}_vertices v ON v.name = e.dst
  JOIN qw q ON q.question_id = p.question_id LEFT JOIN {g}e d ON d.src = p.seed AND d.dst = e.dst),
 p2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id, seed ORDER BY worth DESC, dst) AS rn FROM h2) x WHERE rn = 1 AND worth > 0.2),
 places AS (SELECT question_id, entity, rank - 1000 AS place FROM five UNION ALL SELECT question_id, dst, seed_rank * 10 + 1 FROM p1 UNION ALL SELECT question_id, dst, seed_rank * 10 + 2 FROM p2),
 rl AS (SELECT question_id, entity, row_number() OVER (PARTITION BY question_id ORDER BY min(place)) AS rank FROM places GROUP BY question_id, entity)"""


@query("g6_greedy_paths", f"WITH {edges_sql('gl')}, {attention_sql('gl', 'gl_questions')}, {paths_sql('gl', 'gl_questions')} SELECT question_id, entity, CAST(rank AS INT) AS rank FROM rl")
def g6(c):
    return gl_paths(c)[2]


def gl_paths(c):
    """(edges, attention vectors, greedy paths); the first two are read many times and made once."""
    e = saved(edges(c, "gl"), "edges")
    mixed = saved(network.attention_vectors(c("gl_vertices"), e, c("gl_columns")), "attention")
    seeds = network.neighbour_attention(c("gl_questions"), c("gl_vertices"), e, 5, mixed=mixed)
    return e, mixed, network.greedy_paths(c("gl_questions"), seeds, c("gl_vertices"), e)


@query(
    "g4_attention_ranks",
    f"""WITH {edges_sql('gl')}, {attention_sql('gl', 'gl_questions')}, {paths_sql('gl', 'gl_questions')}
SELECT a.question_id, a.entity, a.rank FROM att a JOIN rl ON rl.question_id = a.question_id AND rl.entity = a.entity""",
)
def g4_ranks(c):
    # the vertices of the greedy paths: at most eleven per question
    e, mixed, found = gl_paths(c)
    return network.attention_ranks(c("gl_questions"), c("gl_vertices"), e, found, mixed=mixed)


def seeds_sql(questions: str, hay: str, per_term: int = 3) -> str:
    return f"""asked AS ({exploded_sql(SEEDS, questions)}), top AS ({term_top_sql('asked', hay, per_term)}),
 seeds AS (SELECT a.question_id, t.name AS entity, row_number() OVER (PARTITION BY a.question_id ORDER BY a.pos, t.place) AS rank FROM asked a JOIN top t ON a.term = t.term)"""


@query("g7_semantic_seeds", f"WITH {seeds_sql('q_text', ENTITY_HAY)} SELECT question_id, entity, CAST(rank AS INT) AS rank FROM seeds")
def g7(c):
    return network.semantic_seeds(c("q_text"), c("c_tables"))


def degree_sql(g: str, threshold: float) -> str:
    return f"""SELECT name, round(coalesce(d, 0) / ((SELECT count(*) FROM {g}_vertices) - 1), 6) AS score FROM {g}_vertices v
 LEFT JOIN (SELECT n, count(*) AS d FROM (SELECT src AS n FROM {g}e UNION ALL SELECT dst FROM {g}e) x GROUP BY 1) y ON y.n = v.name ORDER BY score DESC, name LIMIT 5"""


@query("g8_degree_hubs", f"WITH {edges_sql('gl')}, top AS ({degree_sql('gl', 0.1)}) SELECT name, score FROM top WHERE score > 0.1")
def g8(c):
    return network.degree_hubs(c("gl_vertices"), edges(c, "gl"))


# shortest paths are counted level by level; a vertex lies on those of a pair whose distances through it add up
BETWEEN = """adj AS MATERIALIZED (SELECT src, dst FROM gse UNION SELECT dst, src FROM gse), nv AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM gs_vertices),
 walk AS (SELECT name AS s, name AS t, 0 AS d FROM gs_vertices UNION SELECT w.s, a.dst, w.d + 1 FROM walk w JOIN adj a ON a.src = w.t WHERE w.d < 6),
 dist AS MATERIALIZED (SELECT s, t, min(d) AS d FROM walk GROUP BY 1, 2),
 counts AS (SELECT name AS s, name AS t, 0 AS d, 1::DOUBLE AS paths FROM gs_vertices UNION ALL
  SELECT c.s, a.dst, c.d + 1, sum(c.paths) FROM counts c JOIN adj a ON a.src = c.t JOIN dist x ON x.s = c.s AND x.t = a.dst AND x.d = c.d + 1 GROUP BY 1, 2, 3),
 sigma AS MATERIALIZED (SELECT * FROM counts),
 between AS (SELECT v.name, round(coalesce(sum(a.share), 0) / ((n - 1) * (n - 2)), 6) AS score
  FROM gs_vertices v CROSS JOIN nv LEFT JOIN (SELECT x.t AS name, x.paths * y.paths / z.paths AS share FROM sigma x JOIN sigma y ON y.s = x.t JOIN sigma z ON z.s = x.s AND z.t = y.t
   WHERE x.d > 0 AND y.d > 0 AND x.d + y.d = z.d) a ON a.name = v.name GROUP BY v.name, n)"""


@query("g9_betweenness", f"WITH RECURSIVE {edges_sql('gs')}, {BETWEEN} SELECT name, score FROM between")
def g9(c):
    return network.betweenness(c("gs_vertices"), edges(c, "gs"))


@query("g9_betweenness_bridges", f"WITH RECURSIVE {edges_sql('gs')}, {BETWEEN}, top AS (SELECT * FROM between ORDER BY score DESC, name LIMIT 5) SELECT * FROM top WHERE score > 0.05")
def g9_bridges(c):
    return network.betweenness_bridges(network.betweenness(c("gs_vertices"), edges(c, "gs")))


def pagerank_sql(g: str) -> str:
    """pr(name, r): rounds follow one another until the total change lies below n x 1e-6, at most 100."""
    return f"""und AS (SELECT src, dst, max(weight) AS weight FROM (SELECT src, dst, weight FROM {g}e UNION ALL SELECT dst, src, weight FROM {g}e) x GROUP BY 1, 2),
 moves AS MATERIALIZED (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM und), nn AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM {g}_vertices),
 prr AS (SELECT 0 AS i, name, 1 / n AS r, 1e9::DOUBLE AS change FROM {g}_vertices, nn
  UNION ALL SELECT i, name, r, sum(abs(r - old)) OVER () FROM (
   SELECT p.i + 1 AS i, p.name, p.r AS old, 0.85::DOUBLE * coalesce(f.flow, 0) + (0.15::DOUBLE + 0.85::DOUBLE * (SELECT coalesce(sum(r), 0) FROM prr WHERE name NOT IN (SELECT src FROM moves))) / n AS r
   FROM prr p CROSS JOIN nn LEFT JOIN (SELECT m.dst, sum(q.r * m.share) AS flow FROM moves m JOIN prr q ON q.name = m.src GROUP BY 1) f ON f.dst = p.name
   WHERE p.change >= n * 1e-6::DOUBLE AND p.i < 100) step),
 pr AS MATERIALIZED (SELECT name, r FROM prr WHERE i = (SELECT max(i) FROM prr))"""


@query("g10_pagerank", f"WITH RECURSIVE {edges_sql('gl')}, {pagerank_sql('gl')} SELECT name, round(r, 6) AS score FROM pr")
def g10(c):
    return network.pagerank(c("gl_vertices"), edges(c, "gl")).select("name", F.round("score", 6).alias("score"))


def relevant_sql(words: str = "q.w", name: str = "v.name", desc: str = "v.description") -> str:
    return f"len(list_filter({words}, lambda t: contains(lower({name}), t) OR contains(lower({desc}), t))) > 0"


def ranked_sql(g: str, questions: str, threshold: float) -> str:
    return f"""qwords AS (SELECT question_id, {words_sql('question')} AS w FROM {questions}),
 pgr AS (SELECT question_id, entity, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, entity) AS rank FROM (
  SELECT q.question_id, v.name AS entity, round(p.r, 6) AS score FROM qwords q CROSS JOIN pr p JOIN {g}_vertices v ON v.name = p.name WHERE round(p.r, 6) > {threshold} AND {relevant_sql()}) x)"""


@query(
    "g10_pagerank_relevant",
    f"WITH RECURSIVE {edges_sql('gl')}, {pagerank_sql('gl')}, {ranked_sql('gl', 'gl_questions', 0.001)} SELECT question_id, entity, score, CAST(rank AS INT) AS rank FROM pgr WHERE rank <= 5",
)
def g10_relevant(c):
    # a supplier's rank is about 1 / (2 x suppliers), so the carrier's threshold is below the default
    ranks = network.pagerank(c("gl_vertices"), edges(c, "gl"))
    return network.pagerank_relevant(c("gl_questions"), c("gl_vertices"), ranks, 0.001).select(*COLS)


def community_sql(g: str, seeds: str) -> str:
    """com(seed, entity) for a SELECT of distinct seeds."""
    return f"""near AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS place FROM {g}e), starts AS ({seeds}),
 com AS (SELECT seed, seed AS entity FROM starts UNION SELECT s.seed, n.dst FROM starts s JOIN near n ON n.src = s.seed AND n.place <= 3
  UNION SELECT s.seed, m.dst FROM starts s JOIN near n ON n.src = s.seed AND n.place <= 2 JOIN near m ON m.src = n.dst AND m.place <= 2)"""


@query("g11_ego_community", f"WITH {edges_sql('gl')}, {community_sql('gl', 'SELECT name AS seed FROM gl_vertices')} SELECT seed, entity FROM com")
def g11(c):
    return network.ego_community(c("gl_vertices").select(F.col("name").alias("seed")), edges(c, "gl"))


@query("g12_is_relevant", f"SELECT v.conv_id, v.turn, {relevant_sql(words_sql('v.text'), 'd.source', 'd.text')} AS relevant FROM conversations v JOIN documents d ON d.doc_id = v.conv_id")
def g12(c):
    from kitescope.functions.terms import all_terms

    d = c("documents").select(F.col("doc_id").alias("conv_id"), "source", F.col("text").alias("description"))
    return c("conversations").join(d, "conv_id").select("conv_id", "turn", network.is_relevant(F.col("source"), F.col("description"), all_terms(F.col("text"))).alias("relevant"))


GS_HAY = "SELECT name, lower(name) AS hay FROM gs_vertices UNION ALL SELECT name, lower(description) FROM gs_vertices"
HUB_AT, BRIDGE_AT, RANK_AT = 0.02, 0.05, 0.005
STRUCT = f"""hubs AS (SELECT name FROM ({degree_sql('gs', HUB_AT)}) t WHERE score > {HUB_AT}), bridges AS (SELECT name FROM (SELECT * FROM between ORDER BY score DESC, name LIMIT 5) t WHERE score > {BRIDGE_AT}),
 lead AS (SELECT DISTINCT question_id, entity AS seed FROM seeds WHERE rank <= 3), {community_sql('gs', 'SELECT DISTINCT seed FROM lead')},
 pool AS (SELECT question_id, name AS entity FROM gs_questions, (SELECT name FROM hubs UNION SELECT name FROM bridges) f UNION SELECT l.question_id, c.entity FROM lead l JOIN com c ON c.seed = l.seed),
 struct AS (SELECT p.question_id, p.entity FROM pool p JOIN gs_vertices v ON v.name = p.entity JOIN qwords q ON q.question_id = p.question_id WHERE {relevant_sql()})"""
BASE = f"WITH RECURSIVE {edges_sql('gs')}, {BETWEEN}, {pagerank_sql('gs')}, {ranked_sql('gs', 'gs_questions', RANK_AT)}, {seeds_sql('gs_questions', GS_HAY)}, {STRUCT}"


class Small:
    """Shared pieces of the small network."""

    def __init__(self, c):
        self.questions, self.vertices, self.edges = c("gs_questions"), c("gs_vertices"), cut_lineage(edges(c, "gs"))
        self.hubs = network.degree_hubs(self.vertices, self.edges, threshold=HUB_AT)
        self.bridges = network.betweenness_bridges(network.betweenness(self.vertices, self.edges), threshold=BRIDGE_AT)
        self.seeds = network.semantic_seeds(self.questions, self.vertices)

    def structural(self):
        return network.structural_candidates(self.questions, self.vertices, self.edges, self.seeds, self.hubs, self.bridges)

    def ranks(self):
        return network.pagerank(self.vertices, self.edges)


@query("g13_structural_candidates", f"{BASE} SELECT question_id, entity FROM struct")
def g13(c):
    return Small(c).structural().select("question_id", "entity")


LEVELS = """lv AS (SELECT DISTINCT question_id, entity, 0.5::DOUBLE AS w FROM seeds UNION ALL SELECT question_id, entity, 0.3 FROM struct UNION ALL SELECT question_id, entity, 0.2 FROM pgr WHERE rank <= 5),
 ml AS (SELECT question_id, entity, round(sum(w), 6) AS score, row_number() OVER (PARTITION BY question_id ORDER BY round(sum(w), 6) DESC, entity) AS rank FROM lv GROUP BY 1, 2)"""


@query("g14_multilevel_score", f"{BASE}, {LEVELS} SELECT question_id, entity, score, CAST(rank AS INT) AS rank FROM ml")
def g14(c):
    s = Small(c)
    ranked = network.pagerank_relevant(s.questions, s.vertices, s.ranks(), RANK_AT)
    return network.multilevel_score(s.seeds, s.structural(), ranked).select(*COLS)


LIST_NO = "CASE method WHEN 'Keyword' THEN 0 WHEN 'Vector' THEN 1 WHEN 'TFIDF' THEN 2 ELSE 3 END"


@query(
    "g15_rank_ensemble",
    f"""WITH l AS (SELECT question_id, part_name AS entity, CAST(position AS BIGINT) AS rank, {LIST_NO} AS list_no FROM r_predictions),
 s AS (SELECT question_id, entity, round(sum(CASE list_no WHEN 0 THEN 0.4::DOUBLE ELSE 0.3 END / rank), 6) AS score FROM l WHERE list_no < 3 GROUP BY 1, 2)
{cut_sql('SELECT * FROM s', 10)}""",
)
def g15(c):
    lists = c("r_predictions").select(
        "question_id", F.col("part_name").alias("entity"), F.col("position").alias("rank"),
        F.when(F.col("method") == "Keyword", 0).when(F.col("method") == "Vector", 1).when(F.col("method") == "TFIDF", 2).otherwise(3).alias("list_no"),
    )
    return network.rank_ensemble(lists, n=10).select(*COLS)


@query(
    "g16_advanced_retriever",
    f"""{BASE}, {LEVELS}, {attention_sql('gs', 'gs_questions')}, {paths_sql('gs', 'gs_questions')},
 lists AS (SELECT question_id, entity, 0.4::DOUBLE / rank AS w FROM att UNION ALL SELECT question_id, entity, 0.3::DOUBLE / rank FROM rl UNION ALL SELECT question_id, entity, 0.3::DOUBLE / rank FROM ml),
 ens AS (SELECT question_id, entity, round(sum(w), 6) AS score, row_number() OVER (PARTITION BY question_id ORDER BY round(sum(w), 6) DESC, entity) AS rank FROM lists GROUP BY 1, 2)
SELECT question_id, entity, score, CAST(rank AS INT) AS rank FROM ens WHERE rank <= 10""",
)
def g16(c):
    s = Small(c)
    return network.advanced_retriever(s.questions, s.vertices, s.edges, s.ranks(), s.hubs, s.bridges, rank_threshold=RANK_AT, columns=c("gs_columns")).select(*COLS)
