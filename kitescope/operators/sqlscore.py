"""Scoring pairs of SQL texts and pairs of result sets (Q1-Q17).

``pairs`` has pair_id, generated_sql and truth_sql.  Scores are expressions over one row; only the
TF-IDF cosine and the similarity table spread a pair's terms, and those fold back by pair.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from kitescope.functions import fixed_values as fixed
from kitescope.functions import sqltext
from kitescope.functions.sqltext import strings
from kitescope.session import cut_lineage

GENERATED, TRUTH = "generated_sql", "truth_sql"
CLAUSES = ["select", "from", "where", "join", "group_by", "having", "order_by"]


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))


def _f1(p: Column, r: Column) -> Column:
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def _shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


# --- result sets ----------------------------------------------------------------------------------


def compare_results(generated: DataFrame, truth: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Q1: two results as sets of rows: exact match, precision, recall, F1, Jaccard and raw counts.

    Without ``keys`` the frames are one pair and one row results; with ``keys`` each key value is a
    pair of its own.  Rows meet by grouping, which treats nulls as equal and folds copies first.  An
    empty truth scores zero, although two empty results match exactly.
    """
    return _compare_rows(_marked(generated, truth), truth.columns, keys or [])


def _marked(generated: DataFrame, truth: DataFrame) -> DataFrame:
    return generated.select("*", F.lit(1).alias("in_g"), F.lit(0).alias("in_t")).unionByName(
        truth.select("*", F.lit(0).alias("in_g"), F.lit(1).alias("in_t"))
    )


def _compare_rows(marked: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    rows = marked.groupBy(*columns).agg(F.sum("in_g").alias("g"), F.sum("in_t").alias("t"))
    in_g, in_t = F.col("g") > 0, F.col("t") > 0
    sums = rows.groupBy(*keys).agg(
        F.coalesce(F.sum("g"), F.lit(0)).alias("generated_rows"), F.coalesce(F.sum("t"), F.lit(0)).alias("truth_rows"),
        F.count_if(in_g).alias("n_g"), F.count_if(in_t).alias("n_t"), F.count_if(in_g & in_t).alias("both"), F.count("*").alias("any"),
    )
    some = F.when(F.col("n_t") > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    p, r = _ratio(F.col("both"), F.col("n_g")) * some, _ratio(F.col("both"), F.col("n_t"))
    return sums.select(
        *keys, (F.col("both") == F.col("any")).alias("exact_match"), "generated_rows", "truth_rows",
        p.alias("precision"), r.alias("recall"), _f1(p, r).alias("f1_score"), (_ratio(F.col("both"), F.col("any")) * some).alias("jaccard"),
    )


def result_fingerprints(marked: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """(keys, generated_rows, truth_rows, same): whether both results of a pair hold the same rows as often.

    Two hashes of each row are added for one side and subtracted for the other, in integers wide enough
    not to overflow, so the order of rows has no effect and sums fold inside tasks.  Nulls are hashed by
    mark, as the hash itself passes over them.
    """
    cells = [c for name in columns for c in (F.col(name), F.col(name).isNull())]
    sign = (F.col("in_g") - F.col("in_t")).cast("decimal(1,0)")
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), *cells).cast("decimal(20,0)") * sign)
    sums = marked.groupBy(*keys).agg(F.sum("in_g").alias("generated_rows"), F.sum("in_t").alias("truth_rows"), total(1).alias("a"), total(2).alias("b"))
    same = (F.col("generated_rows") == F.col("truth_rows")) & (F.col("a") == 0) & (F.col("b") == 0)
    return sums.select(*keys, "generated_rows", "truth_rows", F.coalesce(same, F.lit(False)).alias("same"))


def compare_many_results(generated: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Q1 for many pairs of results at once, one per value of ``keys`` (nulls are values), as :func:`compare_results`.

    Pairs of equal fingerprints are settled without sending their rows; only the rows of the others are
    grouped.  A pair counts as equal by two 64-bit hashes per row; anything else is compared cell by cell.
    """
    marked = _marked(generated, truth)
    prints = cut_lineage(result_fingerprints(marked, truth.columns, keys))
    one = F.lit(1.0)
    settled = prints.filter("same").select(
        *keys, F.lit(True).alias("exact_match"), "generated_rows", "truth_rows",
        one.alias("precision"), one.alias("recall"), one.alias("f1_score"), one.alias("jaccard"),
    )
    left = prints.filter("NOT same").select(*[F.col(k).alias(f"open_{i}") for i, k in enumerate(keys)])
    meets = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"open_{i}")) for i, k in enumerate(keys)])
    return settled.unionByName(_compare_rows(marked.join(left, meets, "left_semi"), truth.columns, keys))


# --- scorer A -------------------------------------------------------------------------------------


def components(pairs: DataFrame) -> DataFrame:
    """Q2: clause parts of both texts as arrays named g_<clause> and t_<clause>."""
    return pairs.select(
        "*",
        *[sqltext.sql_component(F.col(GENERATED), c).alias(f"g_{c}") for c in CLAUSES],
        *[sqltext.sql_component(F.col(TRUTH), c).alias(f"t_{c}") for c in CLAUSES],
    )


def logical_form_score(pairs: DataFrame) -> DataFrame:
    """Q3: share of true parts found per clause, averaged; a clause absent from both scores one."""

    def score(c: str) -> Column:
        g, t = F.col(f"g_{c}"), F.col(f"t_{c}")
        return F.when(F.size(t) > 0, _ratio(_shared(g, t), F.size(t))).otherwise((F.size(g) == 0).cast("double"))

    scored = components(pairs).select(*pairs.columns, *[score(c).alias(f"{c}_score") for c in CLAUSES])
    total = reduce(lambda a, b: a + b, [F.col(f"{c}_score") for c in CLAUSES])
    return scored.withColumn("logical", total / len(CLAUSES))


def partial_match(pairs: DataFrame) -> DataFrame:
    """Q5: precision, recall and F1 over keywords, tables and column references, and their mean F1."""
    keywords = lambda sql: F.array_intersect(F.transform(sqltext.sql_tokens(sql), F.upper), strings(fixed.SQL_MATCH_KEYWORDS))
    kinds = {
        "keyword": keywords,
        "table": lambda sql: sqltext.tables_in_sql(sql, keep_schema=True),
        "column": sqltext.column_references,
    }
    sets = pairs.select("*", *[f(F.col(side)).alias(f"{n}_{kind}") for kind, f in kinds.items() for n, side in (("g", GENERATED), ("t", TRUTH))])
    out = sets
    for kind in kinds:
        g, t = F.col(f"g_{kind}"), F.col(f"t_{kind}")
        out = out.withColumn(f"{kind}_precision", _ratio(_shared(g, t), F.size(g))).withColumn(f"{kind}_recall", _ratio(_shared(g, t), F.size(t)))
        out = out.withColumn(f"{kind}_f1", _f1(F.col(f"{kind}_precision"), F.col(f"{kind}_recall")))
    measures = [f"{k}_{m}" for k in kinds for m in ("precision", "recall", "f1")]
    return out.select(*pairs.columns, *measures, ((F.col("keyword_f1") + F.col("table_f1") + F.col("column_f1")) / 3).alias("partial"))


def weighted_present(scores: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted mean over the scores that are not null."""
    used = [(weights[name], col) for name, col in scores.items()]
    top = reduce(lambda a, b: a + b, [F.coalesce(col * w, F.lit(0.0)) for w, col in used])
    bottom = reduce(lambda a, b: a + b, [F.when(col.isNotNull(), F.lit(w)).otherwise(0.0) for w, col in used])
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def overall_a(scored: DataFrame) -> DataFrame:
    """Q6: execution, logical, partial and judge scores weighted over those present."""
    cols = {name: F.col(name) for name in fixed.EXECUTION_SCORE_WEIGHTS}
    return scored.withColumn("overall", weighted_present(cols, fixed.EXECUTION_SCORE_WEIGHTS))


# --- scorer B -------------------------------------------------------------------------------------


def exact_match(pairs: DataFrame) -> Column:
    """Q7: equal after folding layout and case."""
    return (sqltext.normalised(F.col(GENERATED)) == sqltext.normalised(F.col(TRUTH))).cast("double")


CLAUSE_WORDS = {"select": "select", "from": "from", "where": "where", "group_by": "group by", "order_by": "order by", "having": "having"}
NOT_COUNTED = fixed.SQL_WEIGHTED_KEYWORDS + ["as", "in", "limit", "desc", "asc", "distinct"]


def clause_segments(sql: Column) -> Column:
    """The text cut before each clause keyword; every piece reads ``keyword MARK body``."""
    flat = F.regexp_replace(sql, r"\s+", " ")
    marked = F.regexp_replace(flat, r"(?i)\b(select|from|where|group by|order by|having)\b", "\u0001$1\u0002")
    return F.split(marked, "\u0001")


def clause_tokens(segments: Column, clause: str) -> Column:
    """Distinct words and operators written under a clause keyword; punctuation and keywords left out."""
    start = CLAUSE_WORDS[clause] + "\u0002"
    mine = F.filter(segments, lambda s: F.lower(s).startswith(start))
    bodies = F.array_join(F.transform(mine, lambda s: F.substr(s, F.lit(len(start) + 1))), " ")
    tokens = F.array_distinct(sqltext.find_all(bodies, r"'[^']*'|\w+|[^\w\s,.;()]"))
    return F.filter(tokens, lambda t: ~F.array_contains(strings(NOT_COUNTED), F.lower(t)))


def component_f1(pairs: DataFrame) -> DataFrame:
    """Q8: F1 of the words under each clause, averaged over the clauses either text has."""
    cut = pairs.select("*", clause_segments(F.col(GENERATED)).alias("g"), clause_segments(F.col(TRUTH)).alias("t"))
    sets = cut.select("*", *[clause_tokens(F.col(n), c).alias(f"{n}_{c}") for c in CLAUSE_WORDS for n in ("g", "t")])
    scores = []
    for c in CLAUSE_WORDS:
        g, t = F.col(f"g_{c}"), F.col(f"t_{c}")
        f1 = _f1(_ratio(_shared(g, t), F.size(g)), _ratio(_shared(g, t), F.size(t)))
        scores.append(F.when((F.size(g) > 0) | (F.size(t) > 0), f1))
    listed = F.array_compact(F.array(*scores))
    mean = _ratio(F.aggregate(listed, F.lit(0.0), lambda s, x: s + x), F.size(listed))
    return sets.withColumn("listed_mean", mean).select(*pairs.columns, F.col("listed_mean").alias("component_f1"))


def _bigrams(tokens: Column) -> Column:
    short = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.zip_with(F.slice(tokens, F.lit(1), short), F.slice(tokens, F.lit(2), short), lambda a, b: F.concat(a, F.lit("\u0001"), b))


def token_scores(pairs: DataFrame) -> DataFrame:
    """Q9-Q13: bleu, weighted token match, structure and reference overlap, and their mean."""
    toks = pairs.select("*", sqltext.lower_tokens(F.col(GENERATED)).alias("g"), sqltext.lower_tokens(F.col(TRUTH)).alias("t"))
    sets = toks.select(
        "*", F.array_distinct(_bigrams(F.col("g"))).alias("g2"), F.array_distinct(_bigrams(F.col("t"))).alias("t2"),
        F.array_distinct("g").alias("g1"), F.array_distinct("t").alias("t1"),
        sqltext.structure_flags(F.col(GENERATED)).alias("gs"), sqltext.structure_flags(F.col(TRUTH)).alias("ts"),
        sqltext.references(F.col(GENERATED)).alias("gr"), sqltext.references(F.col(TRUTH)).alias("tr"),
    )
    p1 = _ratio(_shared(F.col("g1"), F.col("t1")), F.size("g1"))
    p2 = _ratio(_shared(F.col("g2"), F.col("t2")), F.size("g2"))
    brevity = F.least(F.lit(1.0), _ratio(F.size("g"), F.size("t")))
    keywords = strings(fixed.SQL_WEIGHTED_KEYWORDS)
    weight = lambda w: F.when(F.array_contains(keywords, w), F.lit(5.0)).otherwise(F.lit(1.0))
    add = lambda s, w: s + weight(w)
    matched = F.filter("g", lambda w: F.array_contains(F.col("t1"), w))
    overlap = lambda a, b: F.when((F.size(a) > 0) & (F.size(b) > 0), _ratio(_shared(F.col(a), F.col(b)), F.size(F.array_union(a, b)))).otherwise(0.0)
    out = sets.select(
        *pairs.columns,
        (brevity * F.sqrt(p1 * p2)).alias("bleu"),
        _ratio(F.aggregate(matched, F.lit(0.0), add), F.aggregate(F.col("g"), F.lit(0.0), add)).alias("weighted"),
        overlap("gs", "ts").alias("structure"), overlap("gr", "tr").alias("reference_overlap"),
    )
    mean = 0.25 * F.col("bleu") + 0.25 * F.col("weighted") + 0.25 * F.col("structure") + 0.25 * F.col("reference_overlap")
    return out.withColumn("code_bleu", mean)


def _pair_grams(text: Column) -> Column:
    words = sqltext.find_all(F.lower(text), r"\w{2,}")
    return F.transform(F.array(words), lambda w: F.concat(w, F.transform(_bigrams(w), lambda b: F.translate(b, "\u0001", " "))))[0]


def _idf(g: Column, t: Column) -> Column:
    return F.log(F.lit(3.0) / (1 + (g > 0).cast("int") + (t > 0).cast("int"))) + 1


def text_tfidf_cosine(left: Column, right: Column) -> Column:
    """Q14 inside a row: terms of both texts are sorted together, those of a term from the right ahead of those from the left.

    A term of both texts weighs 1, one of a single text log(3/2) + 1, so whole numbers do: products and squares of counts
    are summed as the occurrences pass (the k-th adds 2k - 1 to a square), squares of shared and other terms apart.
    """
    def marked(text: Column, of_left: bool) -> Column:
        each = F.transform(_pair_grams(text), lambda x: F.struct(x.alias("term"), F.lit(of_left).alias("left")))
        return F.coalesce(each, F.array().cast("array<struct<term:string,left:boolean>>"))

    def step(s: Column, x: Column) -> Column:
        def row(g: Column, t: Column, **added: Column) -> Column:
            return F.struct(x["term"].alias("term"), g.alias("g"), t.alias("t"), *[(s[n] + added[n] if n in added else s[n]).alias(n) for n in sums])

        same, one, g, t = s["term"] == x["term"], zero + 1, s["g"], s["t"]
        first = F.when(x["left"], row(one, zero, na=one)).otherwise(row(zero, one, nb=one))
        alone = F.when(x["left"], row(g + 1, t, na=2 * g + 1)).otherwise(row(g, t + 1, nb=2 * t + 1))
        # with the first occurrence on the left the term's square on the right turns out to be a shared one
        moved = F.when(g == 0, t * t).otherwise(zero)
        shared = row(g + 1, t, dot=t, na_shared=2 * g + 1, nb=-moved, nb_shared=moved)
        return F.when(same & x["left"] & (t > 0), shared).when(same, alone).otherwise(first)

    sums, zero = ("dot", "na", "nb", "na_shared", "nb_shared"), F.lit(0).cast("bigint")
    start = F.struct(F.lit(None).cast("string").alias("term"), *[zero.alias(n) for n in ("g", "t", *sums)])
    square = (1 + math.log(1.5)) ** 2
    length = lambda s, n: s[f"{n}_shared"] + square * s[n]
    found = F.aggregate(
        F.sort_array(F.concat(marked(left, True), marked(right, False))), start, step,
        lambda s: F.try_divide(s["dot"].cast("double"), F.sqrt(length(s, "na") * length(s, "nb"))))
    return F.coalesce(found, F.lit(0.0))


def pair_tfidf_cosine(pairs: DataFrame, left: str = GENERATED, right: str = TRUTH, unique: bool = False) -> DataFrame:
    """Q14: cosine of the 1-2-gram TF-IDF vectors fitted on just the two texts of a pair.

    Returns (pair_id, semantic); a pair with an empty side scores zero.  Where ``pair_id`` is a key (``unique``), both
    texts stand in one row and nothing is shuffled; otherwise rows of one pair count together.
    """
    if unique:
        known = F.when(F.col("pair_id").isNotNull(), text_tfidf_cosine(F.col(left), F.col(right))).otherwise(F.lit(0.0))
        return pairs.select("pair_id", known.alias("semantic"))
    terms = pairs.select("pair_id", F.explode(_pair_grams(F.col(left))).alias("term"), F.lit(1).alias("g"), F.lit(0).alias("t")).unionByName(
        pairs.select("pair_id", F.explode(_pair_grams(F.col(right))).alias("term"), F.lit(0).alias("g"), F.lit(1).alias("t"))
    )
    counts = terms.groupBy("pair_id", "term").agg(F.sum("g").alias("g"), F.sum("t").alias("t"))
    idf = _idf(F.col("g"), F.col("t"))
    weighted = counts.select("pair_id", (F.col("g") * idf).alias("a"), (F.col("t") * idf).alias("b"))
    sums = weighted.groupBy("pair_id").agg(
        F.sum(F.col("a") * F.col("b")).alias("dot"), F.sum(F.col("a") * F.col("a")).alias("na"), F.sum(F.col("b") * F.col("b")).alias("nb")
    )
    cosine = sums.select("pair_id", F.coalesce(F.try_divide(F.col("dot"), F.sqrt(F.col("na") * F.col("nb"))), F.lit(0.0)).alias("semantic"))
    return pairs.select("pair_id").join(cosine, "pair_id", "left").select("pair_id", F.coalesce("semantic", F.lit(0.0)).alias("semantic"))


def efficiency(generated: Column, truth: Column) -> Column:
    """Q15: true over generated complexity, at most one; an empty statement is invalid and scores zero."""
    valid = F.trim(F.coalesce(generated, F.lit(""))) != ""
    return F.when(valid, F.least(F.lit(1.0), sqltext.complexity(truth) / sqltext.complexity(generated))).otherwise(F.lit(0.0))


def edit_similarity(a: Column, b: Column) -> Column:
    return F.lit(1.0) - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))


def _soft_scores(rows: DataFrame, keep: list[str], matched: Column) -> DataFrame:
    p, r = _ratio(matched, F.size("g")), _ratio(matched, F.size("t"))
    return rows.select(*keep, p.alias("soft_precision"), r.alias("soft_recall"), _f1(p, r).alias("soft_f1"))


def soft_f1_edit(pairs: DataFrame, above: float = 0.8) -> DataFrame:
    """Q16 by edit distance: generated identifiers with a similar true one, within the row."""
    rows = pairs.select("*", sqltext.entities(F.col(GENERATED)).alias("g"), sqltext.entities(F.col(TRUTH)).alias("t"))
    hits = F.size(F.filter("g", lambda x: F.exists("t", lambda y: edit_similarity(x, y) > above)))
    return _soft_scores(rows, pairs.columns, hits)


def _longest_block(x: Column, y: Column) -> Column:
    """(start, size) of the longest run of ``x`` inside ``y``, the first in ``x`` where several tie.

    The start moves on where the run cannot grow, so at most length of x plus run length steps are taken.
    """
    def step(s: Column, _: Column) -> Column:
        grows = (s["i"] + s["size"] <= F.length(x)) & F.contains(y, F.substr(x, s["i"], s["size"] + 1))
        return F.when(grows, F.struct(s["i"].alias("i"), (s["size"] + 1).alias("size"), s["i"].alias("start"))).otherwise(
            F.struct((s["i"] + 1).alias("i"), s["size"].alias("size"), s["start"].alias("start"))
        )

    steps = F.sequence(F.lit(1), F.length(x) + F.least(F.length(x), F.length(y)))
    return F.aggregate(steps, F.struct(F.lit(1).alias("i"), F.lit(0).alias("size"), F.lit(1).alias("start")), step)


def matching_characters(x: Column, y: Column) -> Column:
    """Characters of ``x`` and ``y`` that matching blocks pair up: the longest block, then left and right of it.

    Of equally long blocks the first in ``x`` counts, at its first place in ``y``.  Every character counts,
    frequent ones of long texts too.  Spans still open form a stack inside the row.
    """
    def span(left: Column, right: Column) -> Column:
        return F.struct(left.alias("x"), right.alias("y"))

    def split(head: Column, best: Column) -> Column:
        start, size = best["start"], best["size"]
        at = F.position(F.substr(head["x"], start, size), head["y"])
        before = span(F.substr(head["x"], F.lit(1), start - 1), F.substr(head["y"], F.lit(1), at - 1))
        after = span(F.substr(head["x"], start + size), F.substr(head["y"], at + size))
        both = F.filter(F.array(before, after), lambda p: (F.length(p["x"]) > 0) & (F.length(p["y"]) > 0))
        return F.struct(size.alias("size"), F.when(size > 0, both).otherwise(F.slice(both, 1, 0)).alias("spans"))

    def step(s: Column, _: Column) -> Column:
        rest = F.slice(s["open"], F.lit(2), F.size(s["open"]))
        done = F.transform(F.slice(s["open"], 1, 1), lambda h: F.transform(F.array(_longest_block(h["x"], h["y"])), lambda b: split(h, b))[0])
        taken = F.transform(done, lambda d: F.struct((s["matched"] + d["size"]).alias("matched"), F.concat(d["spans"], rest).alias("open")))
        return F.when(F.size(s["open"]) == 0, s).otherwise(taken[0])

    # every block pairs a character at least and leaves at most two spans
    steps = F.sequence(F.lit(0), 2 * F.least(F.length(x), F.length(y)))
    return F.aggregate(steps, F.struct(F.lit(0).alias("matched"), F.array(span(x, y)).alias("open")), step)["matched"]


def matching_blocks_ratio(x: Column, y: Column) -> Column:
    """Twice the matching characters over all characters; two empty texts are equal."""
    total = F.length(x) + F.length(y)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * matching_characters(x, y) / total)


def _common_bound(x: Column, y: Column) -> Column:
    """No fewer than the matching characters: what each side keeps of the other's alphabet, the lesser of both."""
    kept = lambda a, b: F.length(a) - F.length(F.call_function("translate", a, b, F.lit("")))
    return F.least(kept(x, y), kept(y, x))


def soft_f1(pairs: DataFrame, above: float = 0.8) -> DataFrame:
    """Q16: as :func:`soft_f1_edit` with the matching-blocks ratio.

    Similarity is computed once per distinct pair of different identifiers that share a row, and only
    for those whose lengths and alphabets allow the ratio at all; equal identifiers need no computing.
    """
    rows = pairs.select("pair_id", sqltext.entities(F.col(GENERATED)).alias("g"), sqltext.entities(F.col(TRUTH)).alias("t"))
    open_g = F.array_except("g", "t")
    spread = rows.select("pair_id", F.explode(open_g).alias("x"), F.array_distinct("t").alias("t")).select("pair_id", "x", F.explode("t").alias("y"))
    total = F.lit(above) * (F.length("x") + F.length("y"))
    possible = spread.filter(2 * F.least(F.length("x"), F.length("y")) > total)
    names = possible.select("x", "y").distinct().filter(2 * _common_bound(F.col("x"), F.col("y")) > total)
    similar = names.filter(matching_blocks_ratio(F.col("x"), F.col("y")) > above)
    hits = possible.join(similar, ["x", "y"]).select("pair_id", "x").distinct().groupBy("pair_id").agg(F.collect_list("x").alias("near"))
    joined = rows.join(hits, "pair_id", "left").withColumn("near", F.coalesce("near", F.array().cast("array<string>")))
    matched = F.size(F.filter("g", lambda x: F.array_contains(F.col("t"), x) | F.array_contains(F.col("near"), x)))
    return _soft_scores(joined, ["pair_id"], matched)


def grade(score: Column) -> Column:
    return F.when(score >= 0.9, "A").when(score >= 0.8, "B").when(score >= 0.7, "C").when(score >= 0.6, "D").otherwise("F")


def status(score: Column) -> Column:
    return F.when(score >= 0.7, "Good").when(score >= 0.5, "Needs Improvement").otherwise("Poor")


def recommendations(scores: dict[str, Column]) -> Column:
    advice = F.array_compact(F.array(*[F.when(scores[name] < bound, F.lit(text)) for name, bound, text in fixed.ADVICE]))
    return F.when(F.size(advice) > 0, advice).otherwise(F.array(F.lit(fixed.ADVICE_NONE)))


def overall_b(scored: DataFrame) -> DataFrame:
    """Q17: weighted mean of the text scores present, its grade and status, and advice."""
    cols = {name: F.col(name) for name in fixed.TEXT_SCORE_WEIGHTS}
    total = weighted_present(cols, fixed.TEXT_SCORE_WEIGHTS)
    rated = scored.withColumn("overall", total)
    return rated.select(
        "*", grade(F.col("overall")).alias("grade"), status(F.col("overall")).alias("status"), recommendations(cols).alias("recommendations")
    )


def score_texts(pairs: DataFrame, edit_distance: bool = True) -> DataFrame:
    """All text scores of scorer B per pair; ``judge_score`` is used where the pairs carry one; ``pair_id`` is a key.

    Scoring is many times the work of reading, so pairs are dealt over all tasks first, however few their files give; a pair's
    scores are then made in its row.
    """
    spark = pairs.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    judge = F.col("judge_score") if "judge_score" in pairs.columns else F.lit(None).cast("double")
    dealt = pairs.select("pair_id", GENERATED, TRUTH, judge.alias("judge")).filter("pair_id IS NOT NULL").repartition(tasks, "pair_id")
    base = dealt.select("*", exact_match(dealt).alias("exact_match"), efficiency(F.col(GENERATED), F.col(TRUTH)).alias("efficiency"))
    rows = token_scores(component_f1(base)).withColumn("semantic", text_tfidf_cosine(F.col(GENERATED), F.col(TRUTH)))
    if edit_distance:
        return overall_b(soft_f1_edit(rows).drop("soft_precision", "soft_recall"))
    return overall_b(rows.join(soft_f1(dealt).select("pair_id", "soft_f1"), "pair_id"))
