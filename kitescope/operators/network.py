"""Network analytics over vertices (name, description) and edges (src, dst, rel_type) as joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from kitescope.functions import fixed_values as fixed
from kitescope.functions import terms as term_rules
from kitescope.functions import vectors
from kitescope.operators import topk
from kitescope.operators.retrieval import semantic_seeds
from kitescope.operators.search import top_by
from kitescope.session import cut_lineage, saved

__all__ = ["semantic_seeds"]

DIMS = 10


def edge_weight(rel_type: Column, weights: dict[str, float] = fixed.EDGE_WEIGHTS) -> Column:
    picked = F.coalesce(*[F.when(rel_type == kind, F.lit(w)) for kind, w in weights.items()])
    return F.coalesce(picked, F.lit(fixed.DEFAULT_EDGE_WEIGHT))


def build_network(vertices: DataFrame, edges: DataFrame, weights: dict[str, float] = fixed.EDGE_WEIGHTS) -> DataFrame:
    """G1: weighted directed edges without loops, both ends known, one per ordered pair (heaviest kept)."""
    names = vertices.select("name")
    known = (
        edges.filter(F.col("src") != F.col("dst"))
        .join(names.withColumnRenamed("name", "src"), "src", "left_semi")
        .join(names.withColumnRenamed("name", "dst"), "dst", "left_semi")
    )
    weight = edge_weight(F.col("rel_type"), weights)
    best = known.groupBy("src", "dst").agg(F.max(F.struct(weight.alias("weight"), "rel_type")).alias("e"))
    return best.select("src", "dst", "e.rel_type", "e.weight")


# --- attention --------------------------------------------------------------------------------------


def vertex_texts(vertices: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """(name, text): description, one blank and the column names of the vertex by place, then name.

    ``columns`` has table_name, name and place.  A vertex without columns (or with null names only)
    keeps the blank, a null description is empty and null places come first.  Without ``columns`` the
    text is the description alone.  The list is as long as one table is wide.
    """
    described = F.coalesce("description", F.lit(""))
    if columns is None:
        return vertices.select("name", described.alias("text"))
    listed = columns.filter(F.col("name").isNotNull()).groupBy(F.col("table_name").alias("owner")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "name"))), lambda c: c["name"]), " ").alias("names")
    )
    joined = vertices.join(listed, vertices["name"] == listed["owner"], "left")
    return joined.select(vertices["name"], F.concat(described, F.lit(" "), F.coalesce("names", F.lit(""))).alias("text"))


def vertex_vectors(vertices: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """(name, vector): hash embedding of the vertex text over its length plus a small constant."""
    return vertex_texts(vertices, columns).select("name", vectors.unit(vectors.text_embedding(F.col("text"), DIMS), vectors.EPSILON).alias("vector"))


def attention_vectors(vertices: DataFrame, edges: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """(entity, vector) whose dot product with a question's unit vector is the neighbour-weighted attention.

    Hash embeddings and question codes are never negative, so the floor at zero inside attention has
    no effect and the mean over out-neighbours can be taken over vectors, once for all questions.  The
    mean is ten plain sums and one count: a hub's edges fold in every task before the shuffle.
    """
    own = cut_lineage(vertex_vectors(vertices, columns))
    ends = edges.select("src", "dst").join(own.withColumnRenamed("name", "dst"), "dst")
    means = ends.groupBy("src").agg(F.count("*").alias("n"), *[F.sum(F.col("vector")[i]).alias(f"m{i}") for i in range(DIMS)])
    joined = own.join(means, own["name"] == means["src"], "left")
    mixed = F.array(*[F.col("vector")[i] * 0.7 + F.col(f"m{i}") / F.col("n") * 0.3 for i in range(DIMS)])
    return joined.select(F.col("name").alias("entity"), F.when(F.col("src").isNull(), F.col("vector")).otherwise(mixed).alias("vector"))


def question_vectors(questions: DataFrame) -> DataFrame:
    """(question_id, vector): encoded questions at unit length; a question without words stays zero."""
    return questions.select("question_id", vectors.unit(vectors.encode_question(F.col("question"), DIMS)).alias("vector"))


def neighbour_attention(
    questions: DataFrame, vertices: DataFrame, edges: DataFrame, n: int = 10, threshold: float = 0.1, columns: DataFrame | None = None,
    mixed: DataFrame | None = None,
) -> DataFrame:
    """Best ``n`` vertices per question by own attention x .7 plus out-neighbours' mean x .3.

    The full ranking covers every vertex for every question; :func:`attention_ranks` gives the exact
    place of chosen vertices in it without writing it out.  ``mixed`` are attention vectors made before.
    """
    mixed = cut_lineage(attention_vectors(vertices, edges, columns)) if mixed is None else mixed
    return topk.top_scores(mixed, question_vectors(questions), n, threshold)


def attention_ranks(
    questions: DataFrame, vertices: DataFrame, edges: DataFrame, wanted: DataFrame, threshold: float = 0.1, columns: DataFrame | None = None,
    mixed: DataFrame | None = None,
) -> DataFrame:
    """Exact places of chosen vertices in the full ranking of G4; ``mixed`` are attention vectors made before."""
    return topk.exact_ranks(attention_vectors(vertices, edges, columns) if mixed is None else mixed, question_vectors(questions), wanted, threshold)


# --- relevance and paths ----------------------------------------------------------------------------


def term_overlap(description: Column, terms: Column) -> Column:
    """Share of the question's words found inside the description; zero without either."""
    low = F.lower(F.coalesce(description, F.lit("")))
    hits = F.size(F.filter(terms, lambda t: F.contains(low, t)))
    return F.when((low == "") | (F.size(terms) == 0), F.lit(0.0)).otherwise(hits / F.size(terms))


def is_relevant(name: Column, description: Column, terms: Column) -> Column:
    """Some word of the question lies inside the name or the description."""
    return F.exists(terms, lambda t: F.contains(F.lower(name), t) | F.contains(F.lower(F.coalesce(description, F.lit(""))), t))


def greedy_paths(
    questions: DataFrame, seeds: DataFrame, vertices: DataFrame, edges: DataFrame, hops: int = 2, walked: int = 3,
    least: float = 0.2, reward_from: str = "seed",
) -> DataFrame:
    """Walk from the leading seeds to the best out-neighbour, up to ``hops`` times.

    A neighbour is worth .6 x word overlap + .4 x the weight of its edge from the seed (or from the
    current vertex).  Result: (question_id, entity, rank) - the seeds in order, then chosen vertices
    by seed and hop.  Seeds and steps are a few rows per question and written, so that they go to the edges.
    """
    seeds = saved(seeds.select("question_id", "entity", "rank"), "seeds")
    weighted = edges.select("src", "dst", "weight")
    texts = vertices.select(F.col("name").alias("dst"), "description")
    asked = questions.select("question_id", term_rules.all_terms(F.col("question")).alias("words"))
    paths = seeds.filter(F.col("rank") <= walked).select("question_id", F.col("entity").alias("seed"), F.col("rank").alias("seed_rank"), F.col("entity").alias("current"))
    found = seeds.select("question_id", "entity", (F.col("rank") - 1000).alias("place"))
    for hop in range(1, hops + 1):
        step = paths.join(weighted, paths["current"] == weighted["src"]).join(texts, "dst").join(asked, "question_id")
        if hop == 1 or reward_from == "current":
            reward = F.col("weight")
        else:
            near = edges.join(paths.select(F.col("seed").alias("src")).distinct(), "src", "left_semi")
            direct = near.select(F.col("src").alias("seed"), F.col("dst"), F.col("weight").alias("direct"))
            step = step.join(direct, ["seed", "dst"], "left")
            reward = F.coalesce(F.col("direct"), F.lit(0.0))
        worth = F.round(term_overlap(F.col("description"), F.col("words")) * 0.6 + reward * 0.4, 6)
        best = step.groupBy("question_id", "seed", "seed_rank").agg(F.min(F.struct((-worth).alias("minus"), "dst")).alias("b"))
        paths = saved(best.filter(-F.col("b.minus") > least).select("question_id", "seed", "seed_rank", F.col("b.dst").alias("current")), "paths")
        found = found.unionByName(paths.select("question_id", F.col("current").alias("entity"), (F.col("seed_rank") * 10 + hop).alias("place")))
    first = found.groupBy("question_id", "entity").agg(F.min("place").alias("place"))
    # a list has the seeds plus at most walked x hops entries
    return top_by(first, ["question_id"], ["place"], None).select("question_id", "entity", "rank")


# --- centrality -------------------------------------------------------------------------------------


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def degree_centrality(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, score): in- plus out-degree over n - 1."""
    n = vertices.agg(F.count("*").alias("n")).scalar()
    degrees = _ends(edges).groupBy(F.col("src").alias("name")).agg(F.count("*").alias("degree"))
    joined = vertices.select("name").join(degrees, "name", "left")
    return joined.select("name", F.round(F.coalesce("degree", F.lit(0)) / (n - 1), 6).alias("score"))


def leading_vertices(scores: DataFrame, n: int, threshold: float) -> DataFrame:
    return scores.orderBy(F.desc("score"), "name").limit(n).filter(F.col("score") > threshold)


def degree_hubs(vertices: DataFrame, edges: DataFrame, n: int = 5, threshold: float = 0.1) -> DataFrame:
    """The ``n`` vertices of highest degree centrality, above the threshold."""
    return leading_vertices(degree_centrality(vertices, edges), n, threshold)


def twin_classes(adjacency: DataFrame) -> DataFrame:
    """(name, twin, size): vertices with the same neighbours under the smallest of their names; others are alone.

    ``adjacency`` has both directions of every edge once.  Equal hashes of neighbours propose a class; it holds if every
    neighbour of one member is a neighbour of all, otherwise its members stay alone.
    """
    marks = adjacency.groupBy(F.col("src").alias("name")).agg(
        F.count("*").alias("degree"), F.bit_xor(F.xxhash64("dst")).alias("m1"), F.bit_xor(F.xxhash64("dst", F.lit(1))).alias("m2"))
    same = ["degree", "m1", "m2"]
    proposed = cut_lineage(marks.join(marks.groupBy(*same).agg(F.min("name").alias("twin"), F.count("*").alias("size")), same).select("name", "twin", "size"))
    shared = adjacency.join(proposed.withColumnRenamed("name", "src"), "src").groupBy("twin", "dst", "size").agg(F.count("*").alias("holders"))
    broken = shared.filter("holders < size").select("twin", F.lit(True).alias("broken")).distinct()
    alone = F.col("broken").isNotNull()
    return proposed.join(broken, "twin", "left").select(
        "name", F.when(alone, F.col("name")).otherwise(F.col("twin")).alias("twin"), F.when(alone, F.lit(1)).otherwise(F.col("size")).alias("size"))


def betweenness(vertices: DataFrame, edges: DataFrame, pivots: int | None = None, source_groups: int = 1) -> DataFrame:
    """(name, score): normalised undirected betweenness by level-wise path counting.

    Vertices with the same neighbours are walked from and through together: a class counts as one vertex and, where it has
    more, a second one for all the rest, so the state grows with the classes, not with the vertices.  All sources of a group
    advance one level per join; state is keyed (source, node) and saved after each level, so ``source_groups`` bounds it.
    A network whose vertices all differ keeps one row per pair of vertices.  ``pivots`` uses that many sources (first by hash
    of the name) and scales by n / pivots, the usual estimate for large networks.
    """
    adjacency = cut_lineage(_ends(edges).filter(F.col("src") != F.col("dst")).distinct())
    names = vertices.select("name")
    n = names.count()
    if n < 3:
        return names.withColumn("score", F.lit(0.0))
    twins = cut_lineage(twin_classes(adjacency))
    chosen = names if pivots is None or pivots >= n else names.orderBy(F.xxhash64("name"), "name").limit(pivots)
    scale = 1.0 if pivots is None or pivots >= n else n / pivots
    # node 0 of a class is one member, node 1 stands for the other ``copies`` members
    rest = F.explode(F.when(F.col("size") > 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("rest")
    nodes = twins.select("twin", "size").distinct().select("twin", "size", rest).select(
        "twin", F.struct("twin", "rest").alias("node"), F.when(F.col("rest") == 0, F.lit(1)).otherwise(F.col("size") - 1).alias("copies"))
    linked = adjacency.join(twins.select(F.col("name").alias("src"), F.col("twin").alias("a")), "src").join(twins.select(F.col("name").alias("dst"), F.col("twin").alias("b")), "dst")
    between = linked.select("a", "b").distinct()
    folded = cut_lineage(
        between.join(nodes.select(F.col("twin").alias("a"), F.col("node").alias("src"), "copies"), "a")
        .join(nodes.select(F.col("twin").alias("b"), F.col("node").alias("dst")), "b").select("src", "dst", "copies"))
    sources = twins.join(chosen, "name").groupBy("twin").agg(F.count("*").alias("weight"))
    parts = []
    for group in range(source_groups):
        mine = sources.filter(F.pmod(F.xxhash64("twin"), F.lit(source_groups)) == group)
        parts.append(_dependencies(mine.select(F.struct("twin", F.lit(0).alias("rest")).alias("name")), folded))
    found = reduce(DataFrame.unionByName, parts).join(sources.select(F.col("twin").alias("from"), "weight"), F.col("source.twin") == F.col("from"))
    # other classes send to every member alike; a member sends to the rest of its own class, but not to itself
    other = F.col("source.twin") != F.col("node.twin")
    total = found.groupBy(F.col("node.twin").alias("twin")).agg(
        F.sum(F.when(other & (F.col("node.rest") == 0), F.col("dependency") * F.col("weight"))).alias("d"),
        F.sum(F.when(~other, F.col("dependency"))).alias("own"), F.max(F.when(~other, F.col("weight"))).alias("weight"))
    member = twins.select("name", "twin").join(chosen.select(F.col("name").alias("picked")), F.col("name") == F.col("picked"), "left").join(total, "twin")
    others = F.col("weight") - F.when(F.col("picked").isNull(), F.lit(0)).otherwise(F.lit(1))
    given = member.select("name", (F.coalesce("d", F.lit(0.0)) + F.coalesce(F.col("own") * others, F.lit(0.0))).alias("d"))
    score = F.coalesce(F.col("d"), F.lit(0.0)) * F.lit(scale) / F.lit(float((n - 1) * (n - 2)))
    return names.join(given, "name", "left").select("name", F.round(score, 6).alias("score"))


def _dependencies(sources: DataFrame, adjacency: DataFrame) -> DataFrame:
    """(source, node, dependency): share of shortest paths from each source running through one vertex of each node.

    ``adjacency`` says in ``copies`` for how many vertices its ``src`` stands; a source stands for one.
    """
    frontier = sources.select(F.col("name").alias("source"), F.col("name").alias("node"), F.lit(1.0).alias("paths"))
    levels = [cut_lineage(frontier)]
    # edges go both ways, so a step from a level leads to the level before, the level itself or the next one
    recent = levels[0].select("source", "node")
    while True:
        grown = (
            levels[-1].join(adjacency, F.col("node") == F.col("src")).groupBy("source", F.col("dst").alias("node")).agg(F.sum(F.col("paths") * F.col("copies")).alias("paths"))
            .join(recent, ["source", "node"], "left_anti")
        )
        level = cut_lineage(grown)
        if level.isEmpty():
            break
        levels.append(level)
        recent = levels[-2].select("source", "node").unionByName(level.select("source", "node"))
    through: list[DataFrame] = []
    # (source, node, paths, dependency) of the deepest level; nothing lies beyond it
    below = levels[-1].withColumn("dependency", F.lit(0.0))
    for level in reversed(levels[:-1]):
        share = (
            below.select("source", F.col("node").alias("child"), ((1 + F.col("dependency")) / F.col("paths")).alias("per_path"))
            .join(adjacency, F.col("child") == F.col("src")).groupBy("source", F.col("dst").alias("node")).agg(F.sum(F.col("per_path") * F.col("copies")).alias("per_path"))
        )
        below = cut_lineage(
            level.join(share, ["source", "node"], "left").select("source", "node", "paths", F.coalesce(F.col("paths") * F.col("per_path"), F.lit(0.0)).alias("dependency"))
        )
        through.append(below.filter(F.col("source") != F.col("node")).select("source", "node", "dependency"))
    if not through:
        return levels[0].select("source", "node", F.lit(0.0).alias("dependency")).limit(0)
    return reduce(DataFrame.unionByName, through)


def betweenness_bridges(scores: DataFrame, n: int = 5, threshold: float = 0.05) -> DataFrame:
    """The ``n`` vertices of highest betweenness, above the threshold."""
    return leading_vertices(scores, n, threshold)


def undirected_weights(edges: DataFrame) -> DataFrame:
    """Both directions of every connected pair with the heavier of its weights."""
    both = edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return both.groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def _partitioned_moves(weighted: DataFrame, hub_slice: int) -> tuple[DataFrame, DataFrame]:
    """(moves, widths): edges laid out once by (source, slot) for all rounds, and the slots of each source.

    A source with more than ``hub_slice`` edges takes several slots, so a hub's edges lie in several
    partitions.  Each linked vertex also has one loop of share zero that carries its own earlier ranks.
    """
    spark = weighted.sparkSession
    totals = weighted.groupBy("src").agg(F.sum("weight").alias("total"), F.count("*").alias("degree"))
    width = F.ceil(F.col("degree") / hub_slice).cast("int")
    widths = cut_lineage(totals.select(F.col("src").alias("name"), "total", width.alias("width")))
    joined = weighted.join(widths.withColumnRenamed("name", "src"), "src")
    slot = F.pmod(F.xxhash64("dst"), F.col("width")).cast("int")
    shares = joined.select("src", slot.alias("slot"), "dst", (F.col("weight") / F.col("total")).alias("share"), F.lit(0).alias("width"))
    loops = widths.select(F.col("name").alias("src"), F.lit(0).alias("slot"), F.col("name").alias("dst"), F.lit(0.0).alias("share"), "width")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a checkpoint forgets how its rows are partitioned and a cached table does not; lost parts come back from the checkpoint
    moves = cut_lineage(shares.unionByName(loops)).repartition(parts, "src", "slot").persist()
    moves.count()
    return moves, widths


def _pagerank_rounds(moves: DataFrame, ranks: DataFrame, spreads: list[float], damping: float) -> DataFrame:
    """(name, width, r0 .. rk): ``ranks`` (name, width, r0) carried through one round for each spread.

    A round sends the last rank along the edges and every earlier one along the loop, so a round is one
    join and one sum and nothing is read twice.
    """
    looped = F.col("src") == F.col("dst")
    for i, spread in enumerate(spreads):
        sent = ranks.withColumnRenamed("name", "src").withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("width") - 1))).drop("width")
        kept = [F.sum(F.when(looped, F.col(f"r{k}")).otherwise(0.0)).alias(f"r{k}") for k in range(i + 1)]
        flow = F.sum(F.col(f"r{i}") * F.col("share")) * damping + F.lit(spread)
        ranks = (
            moves.join(sent.hint("shuffle_hash"), ["src", "slot"])
            .groupBy(F.col("dst").alias("name")).agg(F.sum("width").cast("int").alias("width"), *kept, flow.alias(f"r{i + 1}"))
        )
    return ranks


def pagerank(
    vertices: DataFrame, edges: DataFrame, iterations: int = 100, damping: float = 0.85, save_every: int = 5,
    tolerance: float | None = 1e-6, hub_slice: int = 1_000_000,
) -> DataFrame:
    """(name, score): weighted PageRank on the undirected network, unconnected mass spread evenly.

    The result is that of the first round whose total change lies below n x ``tolerance``, or of round
    ``iterations``; without a tolerance it is always the latter.  Ranks are saved every ``save_every``
    rounds together with those in between, so one look at the saved rows judges each of these rounds.
    Saving cuts the lineage and bounds what a lost executor costs.  Edges are shuffled once, before the
    first round; then only ranks and partial sums move.  An empty network gives no rows, one without
    edges the same rank everywhere.
    """
    weighted = undirected_weights(edges)
    moves, widths = _partitioned_moves(weighted, hub_slice)
    alone = vertices.select("name").join(widths, "name", "left_anti")
    n, n_alone = vertices.count(), alone.count()
    if n == 0:
        moves.unpersist()
        return vertices.select("name", F.lit(0.0).alias("score"))
    # vertices without edges receive nothing but the even spread, so their common rank is one number
    alone_rank = 1.0 / n
    ranks = widths.select("name", "width", F.lit(1.0 / n).alias("r0"))
    done = 0
    while done < iterations:
        ahead = [alone_rank]
        for _ in range(min(save_every, iterations - done)):
            ahead.append((1.0 - damping + damping * n_alone * ahead[-1]) / n)
        saved = cut_lineage(_pagerank_rounds(moves, ranks, ahead[1:], damping))
        steps = range(1, len(ahead))
        settled = None
        if tolerance is not None:
            moved = [F.coalesce(F.sum(F.abs(F.col(f"r{i}") - F.col(f"r{i - 1}"))), F.lit(0.0)).alias(f"c{i}") for i in steps]
            change = saved.agg(*moved).first()
            settled = next((i for i in steps if change[f"c{i}"] + n_alone * abs(ahead[i] - ahead[i - 1]) < n * tolerance), None)
        taken = settled or len(ahead) - 1
        alone_rank, done = ahead[taken], done + taken
        ranks = saved.select("name", "width", F.col(f"r{taken}").alias("r0"))
        if settled:
            break
    moves.unpersist()
    return ranks.select("name", F.col("r0").alias("score")).unionByName(alone.select("name", F.lit(alone_rank).alias("score")))


def relevant_only(candidates: DataFrame, questions: DataFrame, vertices: DataFrame) -> DataFrame:
    """(question_id, entity) candidates that pass G12."""
    asked = questions.select("question_id", term_rules.all_terms(F.col("question")).alias("words"))
    named = candidates.join(vertices.select(F.col("name").alias("entity"), "description"), "entity").join(asked, "question_id")
    return named.filter(is_relevant(F.col("entity"), F.col("description"), F.col("words"))).drop("description", "words")


def for_every_question(questions: DataFrame, few: DataFrame, columns: list[str]) -> DataFrame:
    """Attach a short list to every question; ``few`` is bounded by its caller (at most 1 / threshold rows)."""
    packed = few.agg(F.collect_list(F.struct(*columns)).alias("few")).select("few").scalar()
    return questions.select("question_id", packed.alias("few")).select("question_id", F.inline("few"))


def pagerank_relevant(questions: DataFrame, vertices: DataFrame, ranks: DataFrame, threshold: float = 0.01, n: int = 5) -> DataFrame:
    """Relevant vertices with rank above the threshold, best ``n`` per question.

    Ranks sum to one, so fewer than 1 / threshold vertices can pass.
    """
    high = ranks.select(F.col("name").alias("entity"), F.round("score", 6).alias("score")).filter(F.col("score") > threshold)
    found = relevant_only(for_every_question(questions, high, ["entity", "score"]), questions, vertices)
    return top_by(found, ["question_id"], [F.desc("score"), "entity"], n)


def ego_community(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(seed, entity) - the seed, its first three out-neighbours, and the first two of the first two's."""
    near = top_by(edges.select("src", "dst").distinct(), ["src"], ["dst"], 3, "place")
    start = seeds.select("seed").distinct()
    first = start.join(near, F.col("seed") == F.col("src")).select("seed", "dst", "place")
    second = (
        first.filter(F.col("place") <= 2).select("seed", F.col("dst").alias("middle"))
        .join(near.filter(F.col("place") <= 2).select("src", F.col("dst").alias("entity")), F.col("middle") == F.col("src")).select("seed", "entity")
    )
    return start.select("seed", F.col("seed").alias("entity")).unionByName(first.select("seed", F.col("dst").alias("entity"))).unionByName(second).distinct()


def structural_candidates(questions: DataFrame, vertices: DataFrame, edges: DataFrame, seeds: DataFrame, hubs: DataFrame, bridges: DataFrame, expanded: int = 3) -> DataFrame:
    """Hubs, bridges and communities of the leading seeds that pass G12.

    ``hubs`` and ``bridges`` are the short lists of G8 and G9; ``seeds`` is the list of G7.
    """
    few = hubs.select(F.col("name").alias("entity")).unionByName(bridges.select(F.col("name").alias("entity"))).distinct()
    leading = seeds.filter(F.col("rank") <= expanded).select("question_id", F.col("entity").alias("seed")).distinct()
    near = leading.join(ego_community(leading, edges), "seed").select("question_id", "entity")
    found = for_every_question(questions, few, ["entity"]).unionByName(near).distinct()
    return relevant_only(found, questions, vertices)


def multilevel_score(seeds: DataFrame, structural: DataFrame, ranked: DataFrame) -> DataFrame:
    """.5 for word seeds, .3 for structural candidates, .2 for relevant high ranks, highest first."""
    levels = [(seeds, 0.5), (structural, 0.3), (ranked, 0.2)]
    parts = [df.select("question_id", "entity").distinct().withColumn("w", F.lit(w)) for df, w in levels]
    scored = reduce(DataFrame.unionByName, parts).groupBy("question_id", "entity").agg(F.round(F.sum("w"), 6).alias("score"))
    # each level holds a short list per question, so the ranking is bounded by their sizes
    return top_by(scored, ["question_id"], [F.desc("score"), "entity"], None)


def rank_ensemble(lists: DataFrame, weights: list[float] = fixed.ENSEMBLE_WEIGHTS, n: int | None = None) -> DataFrame:
    """Sum of weight / position over the lists, repeats adding again, highest first.

    ``lists`` has question_id, list_no (from 0), rank and entity; lists beyond the weights are ignored.
    """
    weight = F.coalesce(*[F.when(F.col("list_no") == i, F.lit(w)) for i, w in enumerate(weights)])
    scored = (
        lists.withColumn("w", weight / F.col("rank")).filter(F.col("w").isNotNull())
        .groupBy("question_id", "entity").agg(F.round(F.sum("w"), 6).alias("score"))
    )
    return top_by(scored, ["question_id"], [F.desc("score"), "entity"], n)


def advanced_retriever(
    questions: DataFrame, vertices: DataFrame, edges: DataFrame, ranks: DataFrame, hubs: DataFrame, bridges: DataFrame,
    max_tables: int = 10, per_term: int = 3, rank_threshold: float = 0.01, columns: DataFrame | None = None,
) -> DataFrame:
    """Ensemble of attention, greedy paths and multi-level scores; word seeds where all are empty.

    ``edges`` are the weighted edges of G1; ``ranks``, ``hubs`` and ``bridges`` are computed once per
    network.  The attention list is endless in principle: beyond its first ``max_tables`` entries it can
    only matter for vertices the two other (short) lists name, so just those get their exact place.
    """
    # short lists (and one small vector per vertex) are saved once instead of being recomputed per use
    mixed = cut_lineage(attention_vectors(vertices, edges, columns))
    coded = question_vectors(questions)
    attention = cut_lineage(topk.top_scores(mixed, coded, max_tables, 0.1))
    paths = cut_lineage(greedy_paths(questions, attention.filter(F.col("rank") <= 5), vertices, edges))
    seeds = cut_lineage(semantic_seeds(questions, vertices, per_term))
    levels = cut_lineage(multilevel_score(
        seeds, structural_candidates(questions, vertices, edges, seeds, hubs, bridges),
        pagerank_relevant(questions, vertices, ranks, rank_threshold),
    ))
    named = paths.select("question_id", "entity").unionByName(levels.select("question_id", "entity")).distinct()
    further = topk.exact_ranks(mixed, coded, named, 0.1).filter(F.col("rank") > max_tables)
    tagged = lambda df, i: df.select("question_id", F.lit(i).alias("list_no"), F.col("rank").cast("bigint").alias("rank"), "entity")
    lists = tagged(attention, 0).unionByName(tagged(further, 0)).unionByName(tagged(paths, 1)).unionByName(tagged(levels, 2))
    final = rank_ensemble(lists, n=max_tables)
    bare = seeds.join(final.select("question_id").distinct(), "question_id", "left_anti").filter(F.col("rank") <= max_tables)
    return final.unionByName(bare.select("question_id", "entity", F.lit(0.0).alias("score"), "rank"))
