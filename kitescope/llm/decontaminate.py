"""Benchmark decontamination with a positional inverted index over the training corpus.

Index: one posting (term, doc, position) per occurrence of an indexed term, stored as Parquet.  Only the terms that the
phrases need are posted; which ones that is follows from corpus frequencies of all phrase terms.

Search: each window of a phrase looks up its rarest term first.  A posting at position p of a term at offset o proposes
the alignment (doc, item, shift = p - o).  The list of the window's second rarest term, adjusted by its own offset, must
agree (exact: the same shift; near: within ``slop``).  Alignments that survive are compared with the whole text.

Words are runs of digits, a-z (A-Z lower-cased) and characters beyond ASCII.  A window is ``WIDTH`` consecutive words of
an item; a shorter item is one window; an item without words has none.  A document word inside any occurrence is hit.

Defined results: null or empty texts have no words and are never hit; null items have no windows; each row is judged by
its own text, also where ids repeat or are null; equal item ids count once in the list of items, null item ids are not
listed.  An empty
benchmark hits nothing.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kitescope.llm.common import NOT_WORD_RUN, free_name, keep_where, lower_ascii, split_words, store

WIDTH = 13
SLOP = 3


def words_of(text: Column) -> Column:
    return split_words(lower_ascii(F.coalesce(text, F.lit(""))), NOT_WORD_RUN)


def _key(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """What postings call a document.  Documents that share a key only share proposals; each text is compared itself."""
    own = F.when(F.col(f"`{id_col}`").isNull(), F.col(f"`{text_col}`"))
    return F.xxhash64(F.col(f"`{id_col}`").cast("string"), own)


def phrases(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row per distinct item text with words: item (a number), ids, words."""
    return (
        items.select(F.col(f"`{id_col}`").alias("id"), words_of(F.col(f"`{text_col}`")).alias("words"))
        .filter(F.size("words") > 0)
        .groupBy("words").agg(F.collect_set(F.col("id").cast("string")).alias("ids"))
        .withColumn("item", F.xxhash64("words")))


def term_counts(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """Occurrences in the corpus of every given term, 0 where there is none."""
    spread = rows.select(F.explode(words_of(F.col("text"))).alias("term"))
    counted = spread.join(terms, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    return terms.join(counted, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def anchors(items: DataFrame, counts: DataFrame, width: int = WIDTH) -> DataFrame:
    """For every window of every item its rarest and second rarest term with their offsets in the item.

    Windows whose rarest term is absent from the corpus cannot occur and are left out.
    """
    at = items.select("item", F.size("words").alias("size"), F.posexplode("words").alias("off", "term")).join(counts, "term")
    lists = at.groupBy("item", "size").agg(F.sort_array(F.collect_list(F.struct("off", "term", "n"))).alias("at"))
    windows = lists.select("item", F.explode(F.transform(
        F.sequence(F.lit(0), F.greatest(F.col("size") - width, F.lit(0))),
        lambda i: F.sort_array(F.transform(
            F.slice(F.col("at"), i + 1, F.lit(width)), lambda x: F.struct(x["n"], x["off"], x["term"])))
    )).alias("w"))
    first, second = F.col("w")[0], F.coalesce(F.get("w", F.lit(1)), F.col("w")[0])
    return windows.filter(first["n"] > 0).select(
        "item", first["term"].alias("term"), first["off"].alias("off"),
        second["term"].alias("term2"), second["off"].alias("off2")).distinct()


def index(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """The stored postings (term, row, pos) of the given terms."""
    spread = rows.select("row", F.posexplode(words_of(F.col("text"))).alias("pos", "term"))
    return store(spread.join(terms, "term", "left_semi").select("term", "row", "pos"), "postings")


def align(postings: DataFrame, anchored: DataFrame, slop: int = 0) -> DataFrame:
    """Distinct alignments (row, item, shift) on which the two rarest terms of a window agree within ``slop``."""
    proposed = postings.join(anchored, "term").select(
        "row", "item", (F.col("pos") - F.col("off")).alias("shift"),
        F.col("term2"), (F.col("pos") - F.col("off") + F.col("off2")).alias("pos2"))
    other = postings.select(F.col("term").alias("term2"), "row", F.col("pos").alias("found"))
    if slop == 0:
        agreed = proposed.join(other.withColumnRenamed("found", "pos2"), ["row", "term2", "pos2"], "left_semi")
    else:
        # Positions fall into blocks as wide as the reach, so that a neighbour is in the same or an adjoining block.
        reach = 2 * slop + 1
        near = other.withColumn("block", F.explode(F.array(*[F.floor(F.col("found") / reach) + k for k in (-1, 0, 1)])))
        near = near.withColumnRenamed("row", "row2").withColumnRenamed("term2", "other")
        here = proposed.withColumn("block", F.floor(F.col("pos2") / reach))
        agreed = here.join(near, (here["row"] == near["row2"]) & (here["term2"] == near["other"]) & (here["block"] == near["block"])
                           & (F.abs(here["pos2"] - near["found"]) <= slop), "left_semi")
    return agreed.select("row", "item", "shift").distinct()


def _hit_spans(words: Column, at: Column, width: int) -> Column:
    """(ids, spans) for each alignment of one text under which a window agrees; a span is (start, end) in words."""
    def spans(x: Column) -> Column:
        size = F.size(x["words"])
        need = F.least(F.lit(width), size)
        agree = F.transform(x["words"], lambda w, k: F.coalesce(F.get(words, x["shift"] + k) == w, F.lit(False)))
        starts = F.filter(F.sequence(F.lit(0), size - need), lambda i: F.forall(F.slice(agree, i + 1, need), lambda y: y))
        return F.struct(x["ids"].alias("ids"), F.transform(
            starts, lambda i: F.struct((x["shift"] + i).alias("s"), (x["shift"] + i + need).alias("e"))).alias("spans"))

    return F.filter(F.transform(at, spans), lambda y: F.size(y["spans"]) > 0)


def _covered(spans: Column) -> Column:
    return F.aggregate(
        F.sort_array(spans), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("e")),
        lambda a, x: F.struct(
            (a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(a["e"], x["s"]))).alias("n"), F.greatest(a["e"], x["e"]).alias("e")),
        lambda a: a["n"])


def proposals(docs: DataFrame, items: DataFrame, width: int = WIDTH, slop: int = 0, id_col: str = "doc_id", text_col: str = "text"):
    """(alignments, phrases): index ``docs`` and intersect the lists of the items' rarest terms."""
    rows = docs.select(_key(docs, id_col, text_col).alias("row"), F.col(f"`{text_col}`").alias("text"))
    wanted = store(phrases(items), "phrases")
    counts = store(term_counts(rows, wanted.select(F.explode("words").alias("term")).distinct()), "counts")
    anchored = store(anchors(wanted, counts, width), "anchors")
    postings = index(rows, anchored.select(F.explode(F.array("term", "term2")).alias("term")).distinct())
    return align(postings, anchored, slop), wanted


def near(docs: DataFrame, items: DataFrame, slop: int = SLOP, width: int = WIDTH) -> DataFrame:
    """Proximity matches (doc_id, item_id, shift).

    An item matches at a shift where every word of some window of it occurs at most ``slop`` words from its place.  The lists
    of the window's two rarest words propose shifts; all its words are then placed on the whole text.
    """
    # Two words that are each within slop of their places are within twice that of each other's.
    aligned, wanted = proposals(docs, items, width, 2 * slop)
    rows = docs.select(_key(docs, "doc_id", "text").alias("row"), "doc_id", words_of(F.col("text")).alias("here")).dropDuplicates(["row"])
    shifts = F.explode(F.sequence(F.col("shift") - slop, F.col("shift") + slop)).alias("shift")
    tried = aligned.select("row", "item", shifts).distinct().groupBy("row", "item").agg(F.collect_list("shift").alias("shifts"))
    tried = tried.join(wanted.select("item", "words", "ids"), "item").join(rows, "row")

    def fits(shift: Column) -> Column:
        size = F.size("words")
        need = F.least(F.lit(width), size)
        placed = F.transform("words", lambda w, k: F.array_contains(F.slice(
            F.col("here"), F.greatest(shift + k - slop, F.lit(0)) + 1, F.greatest(shift + k + slop + 1 - F.greatest(shift + k - slop, F.lit(0)), F.lit(0))), w))
        return F.exists(F.sequence(F.lit(0), size - need), lambda i: F.forall(F.slice(placed, i + 1, need), lambda y: y))

    found = tried.withColumn("shift", F.explode(F.filter("shifts", fits)))
    return found.select("doc_id", F.explode("ids").alias("item_id"), "shift").distinct()


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text",
                  into: str = "hits") -> tuple[DataFrame, str]:
    """``docs`` with a struct (n_words, n_hit, items); returns the frame and the struct's name.  ``items`` are sorted ids."""
    name, key = free_name(docs, into), free_name(docs, "row")
    aligned, wanted = proposals(docs, items, width, 0, id_col, text_col)
    by_row = aligned.join(wanted, "item").groupBy("row").agg(F.collect_list(F.struct("shift", "words", "ids")).alias("at"))
    at = free_name(docs, "at")
    by_row = by_row.select(F.col("row").alias(key), F.col("at").alias(at))
    kept = [F.col(f"`{c}`") for c in docs.columns]
    # The hash join keeps whole texts out of sorts.
    met = docs.withColumn(key, _key(docs, id_col, text_col)).join(by_row.hint("shuffle_hash"), key, "left")
    met = met.select(*kept, F.struct(words_of(F.col(f"`{text_col}`")).alias("words"), F.col(f"`{at}`").alias("at")).alias(name))
    s = F.col(f"`{name}`")
    met = met.select(*kept, F.struct(
        F.size(s["words"]).cast("long").alias("n_words"),
        F.when(s["at"].isNotNull(), _hit_spans(s["words"], s["at"], width)).alias("found")).alias(name))
    found = F.size(F.coalesce(s["found"], F.array().cast(met.schema[name].dataType["found"].dataType))) > 0
    return met.select(*kept, F.struct(
        s["n_words"].alias("n_words"),
        F.when(found, _covered(F.flatten(s["found"]["spans"]))).otherwise(F.lit(0)).cast("long").alias("n_hit"),
        F.when(found, F.sort_array(F.array_distinct(F.flatten(s["found"]["ids"])))).otherwise(F.array().cast("array<string>")).alias("items"),
    ).alias(name)), name


def contaminated(hits: Column) -> Column:
    """A twentieth of the words or more is hit."""
    return (hits["n_hit"] > 0) & (20 * hits["n_hit"] >= hits["n_words"])


def remove_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    judged, name = contamination(docs, items)
    return keep_where(judged, ~contaminated(F.col(f"`{name}`")), docs.columns)
