"""Exact substring search as equi-joins.

A search word without white space can only occur inside one white-space-delimited token of a text,
so a word is first matched against the *vocabulary* (distinct tokens, which grows far slower than the
texts) and the matching tokens are then joined to their postings.  Word against vocabulary is itself
an equi-join: every token containing the word contains all of the word's character n-grams, so the
word is looked up under the one n-gram that the fewest tokens share, and the hit is verified.

Where a question only needs the first n entities by name, the vocabulary is matched first; only postings
of tokens that hold a search word are read on, and each such token keeps its first n entities.  Spark
applies that cut inside every task ahead of the shuffle, so a word carried by a third of all texts costs
n rows per task and a word nobody asked for none.

A handful of words needs no vocabulary: each entity's tokens are tried against all of them in its own row, and only the
matches are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from kitescope.session import cut_lineage, saved

GRAM = 3
#: Up to so many words are tried against every entity; more are looked up in the vocabulary.
FEW = 64


def top_by(df: DataFrame, keys: list[str], order: list, n: int | None, place: str = "rank") -> DataFrame:
    """First ``n`` rows per key in a total order, with their place; all rows where ``n`` is None."""
    placed = df.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return placed if n is None else placed.filter(F.col(place) <= n)


def first_names(df: DataFrame, key: str, n: int) -> DataFrame:
    """(key, name, place): first ``n`` distinct names per key; repeats share a place, so none need folding before the cut."""
    place = F.dense_rank().over(Window.partitionBy(key).orderBy("name"))
    return df.select(key, "name").withColumn("place", place).filter(F.col("place") <= n).distinct()


def tokens_of(*texts: Column) -> Column:
    """Distinct lower-case white-space tokens of several texts."""
    joined = F.concat_ws(" ", *[F.lower(t) for t in texts])
    return F.filter(F.array_distinct(F.split(joined, r"\s+")), lambda w: w != "")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is made once; a plain column would be made anew at every mention inside a lambda."""
    return F.transform(F.array(value), body)[0]


def token_lists(entities: DataFrame, texts: list[str], name: str = "name") -> DataFrame:
    """(name, tokens): the tokens of every entity."""
    return entities.select(F.col(name).alias("name"), tokens_of(*[F.col(t) for t in texts]).alias("tokens"))


def token_postings(entities: DataFrame, texts: list[str], name: str = "name") -> DataFrame:
    """(token, name): which entity holds which token; one row per pair as ``name`` is unique."""
    return _postings(token_lists(entities, texts, name))


def _postings(lists: DataFrame) -> DataFrame:
    return lists.select(F.explode("tokens").alias("token"), "name")


def _grams(text: Column, size: Column) -> Column:
    count = F.length(text) - size + F.lit(1)
    starts = F.when(count >= 1, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(text, i, size))


def matching_tokens(needles: DataFrame, vocabulary: DataFrame, gram: int = GRAM) -> DataFrame:
    """(term, token) for every vocabulary token that contains the term.

    ``needles`` has distinct non-empty ``term``; ``vocabulary`` has distinct ``token``.
    """
    sized = needles.select("term", F.least(F.length("term"), F.lit(gram)).alias("size"))
    # at most ``gram`` different sizes exist, so this scalar stays tiny however many terms there are
    sizes = sized.agg(F.collect_set("size").alias("sizes")).select("sizes").scalar()
    per_size = vocabulary.withColumn("sizes", sizes).select("token", F.explode("sizes").alias("size"))
    hay = per_size.select("token", F.explode(F.array_distinct(_grams(F.col("token"), F.col("size")))).alias("gram"))
    need = sized.select("term", F.explode(F.array_distinct(_grams(F.col("term"), F.col("size")))).alias("gram"))
    spread = hay.groupBy("gram").agg(F.count("*").alias("tokens"))
    # a gram that no token has decides at once
    tokens = F.coalesce("tokens", F.lit(0))
    rarest = need.join(spread, "gram", "left").groupBy("term").agg(F.min_by("gram", F.struct(tokens, "gram")).alias("gram"))
    # Spark takes exploded rows for no larger than the tokens and would broadcast them: the semi-join can only send the
    # terms' grams, and what it leaves is dealt anew, so that the next join goes by its measured size
    near = hay.join(rarest.select("gram").distinct(), "gram", "left_semi").repartition("gram", "token")
    return rarest.join(near, "gram").filter(F.contains(F.col("token"), F.col("term"))).select("term", "token")


def _tried(needles: DataFrame, lists: DataFrame) -> DataFrame:
    """(term, name) of the terms that lie in one of an entity's tokens, all terms tried in the entity's row."""
    asked = F.broadcast(needles.agg(F.collect_list("term").alias("asked")))  # one row of at most FEW terms

    def hits(tokens: Column) -> Column:
        # what lies in no part of the joined text lies in no token; a hit has to lie in one token
        return bound(F.array_join(tokens, " "), lambda text: F.filter(
            "asked", lambda t: F.contains(text, t) & F.exists(tokens, lambda x: F.contains(x, t))))

    return lists.crossJoin(asked).select(F.explode(bound(F.col("tokens"), hits)).alias("term"), "name")


def term_first_entities(terms: DataFrame, postings: DataFrame, n: int, few: int = FEW) -> DataFrame:
    """(term, name, place): first ``n`` entities by name whose tokens contain the term.

    ``postings`` has token and name, or name and ``tokens``; with tokens in lists, up to ``few`` terms are tried in the
    entities' rows.  The blank term is contained in every text, so it takes the
    first entities of all.
    """
    needles = saved(terms.select("term").filter(F.col("term").isNotNull()).distinct(), "needles")
    nested = "tokens" in postings.columns
    if nested and needles.count() <= few:
        return first_names(_tried(needles, postings), "term", n)
    postings = _postings(postings) if nested else postings
    # read for the postings to keep and for the terms they answer
    found = cut_lineage(matching_tokens(needles.filter(F.col("term") != ""), postings.select("token").distinct()))
    leading = first_names(postings.join(found.select("token").distinct(), "token", "left_semi"), "token", n)
    named = found.join(leading.select("token", "name"), "token").select("term", "name")
    # one row at most; without it nothing of this part runs
    blank = postings.select("name").crossJoin(F.broadcast(needles.filter(F.col("term") == ""))).select("term", "name")
    return first_names(named.unionByName(blank), "term", n)


def phrase_matches(phrases: DataFrame, entities: DataFrame, texts: list[str], name: str = "name") -> DataFrame:
    """(question_id, name) for entities one of whose texts contains the whole phrase, any case.

    Every inner word of a phrase must be a whole token of the text, so candidates come from the
    phrase's rarest inner word.  A phrase of one or two words has no inner word; its longest word is
    matched inside tokens instead.  Candidates are verified on the complete texts.
    """
    low = phrases.select("question_id", F.lower("question").alias("phrase")).withColumn("parts", F.split("phrase", r"\s+"))
    count = F.size("parts")
    postings = token_postings(entities, texts, name)

    inner = low.filter(count >= 3).select(
        "question_id", F.explode(F.array_distinct(F.slice("parts", F.lit(2), count - 2))).alias("token")
    )
    wanted = postings.join(inner.select("token").distinct(), "token", "left_semi")
    spread = wanted.groupBy("token").agg(F.count("*").alias("entities"))
    rarest = inner.join(spread, "token").groupBy("question_id").agg(F.min_by("token", F.struct("entities", "token")).alias("token"))
    by_inner = rarest.join(wanted, "token").select("question_id", "name")

    longest = F.max_by("word", F.struct(F.length("word"), "word")).alias("term")
    short = low.filter(count < 3).select("question_id", F.explode("parts").alias("word")).filter(F.col("word") != "")
    short = short.groupBy("question_id").agg(longest)
    tokens = matching_tokens(short.select("term").distinct(), postings.select("token").distinct())
    by_short = short.join(tokens, "term").join(postings, "token").select("question_id", "name").distinct()

    checked = by_inner.unionByName(by_short).join(low.select("question_id", "phrase"), "question_id")
    hit = F.lit(False)
    for text in texts:
        hit = hit | F.contains(F.lower(F.coalesce(F.col(f"e.{text}"), F.lit(""))), F.col("c.phrase"))
    return (
        checked.alias("c").join(entities.select(F.col(name).alias("entity_name"), *[F.col(t) for t in texts]).alias("e"),
                                F.col("c.name") == F.col("e.entity_name"))
        .filter(hit).select("c.question_id", "c.name")
    )
