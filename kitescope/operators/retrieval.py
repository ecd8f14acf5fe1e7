"""Ranked retrieval for batches of questions.

Questions have ``question_id`` and ``question``; entities have a unique ``name`` plus texts.  Results
are (question_id, entity, score, rank), every cut in the order score first, then name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kitescope.functions import fixed_values as fixed
from kitescope.functions import terms as term_rules
from kitescope.functions import vectors
from kitescope.operators import search, topk
from kitescope.operators.search import top_by
from kitescope.session import cut_lineage, saved

TEXTS = ["name", "description"]


def ranked(found: DataFrame, n: int, score: Column | None = None) -> DataFrame:
    """Distinct entities per question with their best score, cut to ``n``."""
    scored = found.withColumn("score", F.lit(1.0) if score is None else score)
    best = scored.groupBy("question_id", F.col("name").alias("entity")).agg(F.max("score").alias("score"))
    return top_by(best, ["question_id"], [F.desc("score"), "entity"], n)


def _asked(questions: DataFrame, terms: Column) -> DataFrame:
    """(question_id, terms): never null, as a join would look for nulls first and make the terms twice."""
    return questions.select("question_id", F.coalesce(terms, F.array().cast("array<string>")).alias("terms"))


def _found(lists: DataFrame, postings: DataFrame, per_term: int) -> DataFrame:
    """(terms, found): each list of terms with the first entities by name of its terms, as (term_pos, term, name, place)."""
    each = lists.select("terms", F.posexplode("terms").alias("term_pos", "term"))
    top = search.term_first_entities(each.select("term"), postings, per_term)
    hit = F.collect_list(F.struct("term_pos", "term", "name", "place")).alias("found")
    # written, so that its size is known and a small table of answers is not met by a shuffle of all questions
    return saved(each.join(top, "term").groupBy("terms").agg(hit), "answers")


def _by_terms(questions: DataFrame, terms: Column, postings: DataFrame, per_term: int) -> DataFrame:
    """(question_id, term_pos, term, name, place): first entities by name for every term.

    Questions with the same list of terms are answered once.
    """
    asked = saved(_asked(questions, terms), "asked")
    return asked.join(_found(asked.select("terms").distinct(), postings, per_term), "terms").select("question_id", F.inline("found"))


def _first_by_terms(questions: DataFrame, terms: Column, postings: DataFrame, per_term: int, n: int) -> DataFrame:
    """(question_id, entity, score, rank): first ``n`` of all entities found for a question's terms, all with score 1."""
    # rows of one question ask together; folded by terms, which are shorter than the entities found
    together = F.array_sort(F.array_distinct(F.flatten(F.collect_list("terms"))))
    folded = saved(_asked(questions, terms).groupBy("question_id").agg(together.alias("terms")), "asked")
    found = _found(folded.select("terms").distinct(), postings, per_term)
    first = found.select("terms", F.slice(F.array_sort(F.array_distinct("found.name")), 1, n).alias("names"))
    listed = folded.join(first, "terms").select("question_id", F.posexplode("names").alias("pos", "entity"))
    return listed.select("question_id", "entity", F.lit(1.0).alias("score"), (F.col("pos") + 1).alias("rank"))


def column_postings(columns: DataFrame) -> DataFrame:
    """Lower-case column and table names leading to their table: (name, tokens) where ``columns`` has ``names``, a table's columns,
    else (token, name); pairs may repeat.

    A term without a dot lies in a full name exactly if it lies in the table or the column name.
    """
    named = columns.filter(F.col("table_name").isNotNull())
    if "names" in columns.columns:
        # a table without columns is not found by its own name either
        tokens = search.bound(F.col("names"), lambda names: F.when(
            F.size(names) > 0, F.concat(F.array(F.lower("table_name")), F.transform(names, F.lower))))
        return named.select(F.col("table_name").alias("name"), tokens.alias("tokens"))
    token = F.explode(F.array(F.lower("name"), F.lower("table_name")))
    return named.select(token.alias("token"), F.col("table_name").alias("owner")).select("token", F.col("owner").alias("name"))


def direct_match(questions: DataFrame, entities: DataFrame, n: int = 5, texts: list[str] | None = None) -> DataFrame:
    """The whole question inside name, description or rules."""
    return ranked(search.phrase_matches(questions, entities, texts or TEXTS + ["rules"]), n)


def column_match(questions: DataFrame, columns: DataFrame, terms: Column, per_term: int = 3, n: int | None = None) -> DataFrame:
    """R2: tables with a column whose name or full name contains a term; ``per_term`` tables each.

    ``columns`` has table_name and name, or table_name and ``names``.
    """
    if n is not None:
        return _first_by_terms(questions, terms, column_postings(columns), per_term, n)
    found = _by_terms(questions, terms, column_postings(columns), per_term)
    return found.select("question_id", "term", F.col("name").alias("entity"), F.col("place").alias("rank"))


def first_of_type(entities: DataFrame, n: int) -> DataFrame:
    return top_by(entities.select("table_type", "name"), ["table_type"], ["name"], n, "place")


def type_match(questions: DataFrame, entities: DataFrame, per_type: int = 3) -> DataFrame:
    """First tables of each type the question hints at."""
    asked = questions.select("question_id", F.explode(term_rules.intent_types_regex(F.col("question"))).alias("table_type"))
    return asked.join(first_of_type(entities, per_type), "table_type").select(
        "question_id", "table_type", F.col("name").alias("entity"), F.col("place").alias("rank")
    )


def keyword_terms(question: Column) -> Column:
    """Vocabulary words and identifiers of a question (T1 then T2)."""
    return F.concat(term_rules.vocab_terms(question), term_rules.identifier_terms(question))


def keyword_retriever(questions: DataFrame, entities: DataFrame, columns: DataFrame, n: int = 10) -> DataFrame:
    """Whole-question, column-name and type matches together."""
    found = (
        direct_match(questions, entities).select("question_id", "entity")
        .unionByName(column_match(questions, columns, keyword_terms(F.col("question"))).select("question_id", "entity"))
        .unionByName(type_match(questions, entities).select("question_id", "entity"))
    )
    return ranked(found.withColumnRenamed("entity", "name"), n)


def simple_keyword(questions: DataFrame, entities: DataFrame, terms_used: int = 5, per_term: int = 3, n: int = 10) -> DataFrame:
    """First terms of the question inside name or description."""
    terms = F.slice(term_rules.word_terms(F.col("question")), 1, terms_used)
    return _first_by_terms(questions, terms, search.token_lists(entities, TEXTS), per_term, n)


def column_retriever(questions: DataFrame, columns: DataFrame, terms_used: int = 5, per_term: int = 3, n: int = 10) -> DataFrame:
    """First column terms of the question looked up in column names."""
    terms = F.slice(term_rules.column_terms(F.col("question")), 1, terms_used)
    return column_match(questions, columns, terms, per_term, n)


def pattern_retriever(questions: DataFrame, entities: DataFrame, per_type: int = 5, n: int = 10) -> DataFrame:
    """Tables whose type equals, or whose name contains, a type the question hints at."""
    asked = questions.select("question_id", F.explode(term_rules.intent_types_keywords(F.col("question"))).alias("term"))
    named = search.term_first_entities(asked.select("term"), search.token_lists(entities, ["name"]), per_type).select("term", "name")
    typed = first_of_type(entities, per_type).select(F.col("table_type").alias("term"), "name")
    leading = top_by(named.unionByName(typed).distinct(), ["term"], ["name"], per_type, "place")
    return ranked(asked.join(leading, "term").select("question_id", "name"), n)


def first_neighbours(edges: DataFrame, n: int, directed: bool = False, of: DataFrame | None = None) -> DataFrame:
    """(src, dst, place): first ``n`` distinct neighbours by name, never the vertex itself; only of the ``src`` in ``of``, if given."""
    out = edges.select("src", "dst")
    both = out if directed else out.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    if of is not None:
        both = both.join(of, "src", "left_semi")
    return top_by(both.filter(F.col("src") != F.col("dst")).distinct(), ["src"], ["dst"], n, "place")


def semantic_seeds(questions: DataFrame, entities: DataFrame, per_term: int = 3, first_terms: int | None = None) -> DataFrame:
    """Per question word, the first entities mentioning it; repeats kept, in word order.

    Returns (question_id, entity, rank) where rank numbers the list.
    """
    terms = term_rules.seed_terms(F.col("question"), first_terms)
    found = _by_terms(questions, terms, search.token_lists(entities, TEXTS), per_term)
    # a question's list has at most per_term rows per word, so numbering it is bounded by its length
    return top_by(
        found.select("question_id", "term_pos", "place", F.col("name").alias("entity")),
        ["question_id"], ["term_pos", "place"], None,
    ).select("question_id", "entity", "rank")


def network_traversal(
    questions: DataFrame, entities: DataFrame, edges: DataFrame, per_term: int = 2, first_terms: int | None = None,
    expanded_seeds: int = 3, per_seed: int = 5, n: int = 10,
) -> DataFrame:
    """R9 (and R7 with ``first_terms=3``): word seeds plus one undirected hop from the leading seeds.

    Seeds score 1, entities reached only by the hop 0.5.
    """
    # a few rows per question, read as results, to choose edges and to leave from
    seeds = cut_lineage(semantic_seeds(questions, entities, per_term, first_terms))
    leading = seeds.filter(F.col("rank") <= expanded_seeds).select("question_id", F.col("entity").alias("src")).distinct()
    hop = (
        leading.join(first_neighbours(edges, per_seed, of=leading.select("src").distinct()), "src")
        .select("question_id", F.col("dst").alias("name"), F.lit(0.5).alias("s"))
    )
    found = seeds.select("question_id", F.col("entity").alias("name"), F.lit(1.0).alias("s")).unionByName(hop)
    return ranked(found, n, F.col("s"))


def relationship_retriever(questions: DataFrame, entities: DataFrame, edges: DataFrame, n: int = 10) -> DataFrame:
    """As network traversal, from the first three question words only."""
    return network_traversal(questions, entities, edges, per_term=2, first_terms=3, n=n)


# --- vectors --------------------------------------------------------------------------------------


def given_vectors(df: DataFrame, key: str, alias: str) -> DataFrame:
    """(alias, vector) of the rows that have a vector."""
    return df.filter(F.col("embedding").isNotNull()).select(F.col(key).alias(alias), F.col("embedding").alias("vector"))


def vector_tables(queries: DataFrame, entities: DataFrame, threshold: float | None = 0.3, n: int = 5) -> DataFrame:
    """R10 (and R16 with no threshold): nearest entities by cosine."""
    return topk.top_scores(
        given_vectors(entities, "entity", "entity"), given_vectors(queries, "question_id", "question_id"), n, threshold, cosine=True
    )


def similarity_search(queries: DataFrame, nodes: dict[str, DataFrame], kind: str = "tables", n: int = 10) -> DataFrame:
    """Nearest nodes of one kind (tables, columns or values); ``nodes[kind]`` has entity, embedding."""
    return vector_tables(queries, nodes[kind], None, n)


def vector_columns_prefilter(queries: DataFrame, columns: DataFrame, threshold: float = 0.2, n: int = 5) -> DataFrame:
    """Mean cosine per table over the columns above the threshold."""
    sums = topk.group_scores(
        given_vectors(columns, "table_name", "group_key"), given_vectors(queries, "question_id", "question_id"), threshold
    )
    mean = sums.select("question_id", F.col("group_key").alias("entity"), F.round(F.col("total") / F.col("n"), 6).alias("score"))
    return top_by(mean, ["question_id"], [F.desc("score"), "entity"], n)


def mean_unit_vectors(columns: DataFrame) -> DataFrame:
    """(entity, vector): mean of the unit vectors of each table's columns, folded component-wise."""
    raw = given_vectors(columns, "table_name", "entity").filter(F.exists("vector", lambda x: x != 0))
    unit = raw.select("entity", vectors.unit(F.col("vector")).alias("vector"))
    dims = F.size("vector")
    spread = unit.select("entity", dims.alias("dims"), F.posexplode("vector").alias("i", "x"))
    means = spread.groupBy("entity", "dims", "i").agg(F.avg("x").alias("x"))
    # one row per component: a table's list is as long as its vectors
    return means.groupBy("entity", "dims").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).select(
        "entity", F.col("v.x").alias("vector")
    )


def vector_columns_postfilter(queries: DataFrame, columns: DataFrame, threshold: float = 0.2, n: int = 5) -> DataFrame:
    """Mean cosine per table over all its columns, best tables, then the threshold.

    The mean of cosines with one question equals the question's dot product with the mean unit
    vector, so columns fold to one vector per table before any question is looked at.
    """
    asked = given_vectors(queries, "question_id", "question_id").filter(F.exists("vector", lambda x: x != 0))
    asked = asked.select("question_id", vectors.unit(F.col("vector")).alias("vector"))
    best = topk.top_scores(mean_unit_vectors(columns), asked, n, None)
    return best.filter(F.col("score") > threshold)


def vector_retriever(
    queries: DataFrame, entities: DataFrame, columns: DataFrame, questions: DataFrame | None = None,
    texts: DataFrame | None = None, n: int = 10, columns_first: bool = True,
) -> DataFrame:
    """Nearest tables and tables of nearest columns; questions without a vector fall back to text."""
    by_column = vector_columns_prefilter if columns_first else vector_columns_postfilter
    found = vector_tables(queries, entities).select("question_id", F.col("entity").alias("name")).unionByName(
        by_column(queries, columns).select("question_id", F.col("entity").alias("name"))
    )
    if questions is not None and texts is not None:
        bare = questions.join(queries.filter(F.col("embedding").isNotNull()), "question_id", "left_anti")
        found = found.unionByName(
            direct_match(bare, texts, 5, TEXTS).select("question_id", F.col("entity").alias("name"))
        )
    return ranked(found, n)


def text_fallback_search(questions: DataFrame, entities: DataFrame, n: int = 10, kind: str = "tables") -> DataFrame:
    """Whole question inside name or description, constant score; only tables have texts."""
    found = search.phrase_matches(questions, entities, TEXTS)
    if kind != "tables":
        found = found.filter(F.lit(False))
    return ranked(found, n, F.lit(0.5))


# --- answers written as text ----------------------------------------------------------------------


def answer_names(answer: Column) -> Column:
    """Candidate names in a written answer: split on the first separator kind present, cleaned."""
    pieces = (
        F.when(F.contains(answer, F.lit(",")), F.split(answer, ","))
        .when(F.contains(answer, F.lit("\n")), F.split(answer, "\n"))
        .when(F.contains(answer, F.lit(";")), F.split(answer, ";"))
        .otherwise(F.array(answer))
    )
    quotes = F.lit("\"'")
    space = F.lit(" \t\n\r\x0b\x0c")
    clean = F.transform(pieces, lambda p: F.btrim(F.btrim(F.btrim(p, space), quotes), space))
    stop = F.array(*[F.lit(w) for w in fixed.ANSWER_SKIP_WORDS])
    return F.filter(clean, lambda n: (F.length(n) >= 3) & ~F.exists(stop, lambda w: F.contains(F.lower(n), w)))


def parse_ranked_answers(responses: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities named in written answers, in order: exact, else any case, else inside a name.

    ``responses`` has question_id and response.  Of several real names the first by name is taken.
    """
    said = responses.select("question_id", F.posexplode(answer_names(F.col("response"))).alias("pos", "said"))
    names = entities.select("name").distinct()
    wanted = said.select("said").distinct()
    exact = wanted.join(names, F.col("said") == F.col("name")).select("said", F.lit(0).alias("how"), "name")
    folded = names.groupBy(F.upper("name").alias("u")).agg(F.min("name").alias("name"))
    any_case = wanted.withColumn("u", F.upper("said")).join(folded, "u").select("said", F.lit(1).alias("how"), "name")
    # an exact match is one in any case too; only names without either look inside others
    rest = wanted.join(any_case.select("said"), "said", "left_anti")
    upper = names.select("name", F.upper("name").alias("token"))
    inside_one = search.matching_tokens(
        rest.select(F.upper("said").alias("term")).filter(F.length("term") > 0).distinct(), upper.select("token").distinct()
    ).join(upper, "token").groupBy("term").agg(F.min("name").alias("name"))
    inside = rest.withColumn("term", F.upper("said")).join(inside_one, "term").select("said", F.lit(2).alias("how"), "name")
    best = exact.unionByName(any_case).unionByName(inside).groupBy("said").agg(F.min_by("name", F.struct("how", "name")).alias("entity"))
    return said.join(best, "said").select("question_id", "pos", "said", "entity")
