"""Best-scoring entities per question by dot product, without writing out question-entity pairs.

Both sides fall into blocks of bounded size, and every block of entities meets every block of questions with vectors of the
same length: an equi-join on (length, entity block, question block).  A task holds one block of each, multiplies them and
keeps only the best k per question, so k rows per question and entity block are shuffled on.  Neither side passes through
the driver or is broadcast.  A pair of blocks whose largest lengths multiply to no more than the threshold is skipped: by
Cauchy and Schwarz no score of it can lie above.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from kitescope.session import cut_lineage

# tasks get the small helpers below with the function, so workers need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: numbers that one block of vectors may hold: 16 MB
BLOCK_NUMBERS = 2_000_000


def _matrix(rows: pd.DataFrame) -> np.ndarray:
    """The vectors of one block, which all have one length; sparse ones become dense only here."""
    if "vector" in rows.columns:
        return np.array([np.asarray(v, dtype=float) for v in rows["vector"]])
    out = np.zeros((len(rows), int(rows["dims"].iloc[0])))
    sizes = [len(p) for p in rows["positions"]]
    out[np.repeat(np.arange(len(rows)), sizes), np.concatenate(rows["positions"].to_list()).astype(np.int64)] = np.concatenate(rows["weights"].to_list())
    return out


def _frame(**columns) -> pd.DataFrame:
    """A frame whose texts stay plain objects, as Arrow wants them."""
    return pd.DataFrame({name: pd.Series(list(v), dtype=object) if name in ("question_id", "entity", "group_key") else v for name, v in columns.items()})


def _unit(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows at unit length and a mask of the rows kept; rows of length zero are left out."""
    length = np.sqrt(np.sum(block * block, axis=1))
    kept = length > 0
    return block[kept] / length[kept, None], kept


def _blocks(df: DataFrame, keys: list[str], side: str) -> tuple[DataFrame, DataFrame]:
    """(rows with their block, blocks per length) of a table with vectors, or with ``dims``, ``positions`` and ``weights``."""
    sparse = "positions" in df.columns
    sized = df.filter(F.size("positions" if sparse else "vector") > 0)
    sized = sized if sparse else sized.withColumn("dims", F.size("vector"))
    room = F.greatest(F.lit(1), F.floor(F.lit(BLOCK_NUMBERS) / F.col("dims")))
    counts = sized.groupBy("dims").agg(F.count("*").alias("rows")).select("dims", F.ceil(F.col("rows") / room).cast("int").alias(f"{side}_blocks"))
    # one row a length, so no more rows than the longest vector has numbers
    counts = F.broadcast(counts)
    place = F.pmod(F.xxhash64(*keys, "weights" if sparse else "vector"), F.col(f"{side}_blocks")).cast("int").alias(side)
    return sized.join(counts, "dims").select(place, *sized.columns), counts


def _meet(entities: DataFrame, questions: DataFrame, keys: list[str], score: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Every block of entities beside every block of questions of its length, given to ``score``."""
    left, left_counts = _blocks(entities, keys, "e")
    right, right_counts = _blocks(questions, ["question_id"], "q")

    def dealt(rows: DataFrame, others: DataFrame, side: str) -> DataFrame:
        return rows.join(others, "dims").withColumn(side, F.explode(F.sequence(F.lit(0), F.col(f"{side}_blocks") - 1))).drop(f"{side}_blocks")

    left, right = dealt(left, right_counts, "q"), dealt(right, left_counts, "e")
    return left.groupBy("dims", "e", "q").cogroup(right.groupBy("dims", "e", "q")).applyInPandas(score, schema)


def top_scores(entities: DataFrame, questions: DataFrame, k: int, threshold: float | None, cosine: bool = False) -> DataFrame:
    """(question_id, entity, score, rank): best ``k`` entities by dot product, score above ``threshold``.

    With ``cosine`` both sides are scaled to unit length first and zero vectors are left out.  ``entities`` has ``entity`` and
    ``vector``, ``questions`` has ``question_id`` and ``vector``; vectors of different lengths do not meet.  Sparse rows have
    ``dims``, ``positions`` and ``weights`` instead of ``vector`` and are sent as they are.  Scores are rounded
    to six decimals and ties go to the smaller name, in tasks and overall alike.
    """
    schema = "question_id string, entity string, score double"

    def best(e: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        nothing = _frame(question_id=[], entity=[], score=[])
        if not len(e) or not len(q):
            return nothing
        block, asked = _matrix(e), _matrix(q)
        names, ids = e["entity"].to_numpy(dtype=object), q["question_id"].to_numpy(dtype=object)
        if cosine:
            (block, kept), (asked, answered) = _unit(block), _unit(asked)
            names, ids = names[kept], ids[answered]
        if not len(names) or not len(ids) or (threshold is not None and _reach(block) * _reach(asked) <= threshold - 1e-6):
            return nothing
        scores = np.round(block @ asked.T, 6) + 0.0
        rows, cols = _leading(scores, k, threshold)
        found = _frame(question_id=ids[cols], entity=names[rows], score=scores[rows, cols])
        found = found.sort_values(["question_id", "score", "entity"], ascending=[True, False, True])
        return found.groupby("question_id").head(k)

    values = ["dims", "positions", "weights"] if "positions" in entities.columns else ["vector"]
    found = _meet(entities.select("entity", *values), questions.select("question_id", *values), ["entity"], best, schema)
    place = Window.partitionBy("question_id").orderBy(F.desc("score"), "entity")
    return found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)


def _reach(block: np.ndarray) -> float:
    return float(np.sqrt(np.max(np.sum(block * block, axis=1))))


def _leading(scores: np.ndarray, k: int, threshold: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Cells that can be among the best k of their column: no smaller than the column's k-th score."""
    n = scores.shape[0]
    wanted = np.ones(scores.shape, dtype=bool) if threshold is None else scores > threshold
    if n > k:
        kth = np.partition(scores, n - k, axis=0)[n - k]
        wanted &= scores >= kth
    return np.nonzero(wanted)


def group_scores(entities: DataFrame, questions: DataFrame, threshold: float | None) -> DataFrame:
    """(question_id, group_key, total, n): sums of cosines above ``threshold`` per question and group.

    ``entities`` has ``group_key`` and ``vector``.  Each block folds its own rows first, so a group holding a third of all rows
    reaches the shuffle as one row per question and block.
    """
    schema = "question_id string, group_key string, total double, n bigint"

    def fold(e: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        nothing = _frame(question_id=[], group_key=[], total=[], n=[])
        if not len(e) or not len(q):
            return nothing
        (block, kept), (asked, answered) = _unit(_matrix(e)), _unit(_matrix(q))
        keys, ids = e["group_key"].to_numpy(dtype=object)[kept], q["question_id"].to_numpy(dtype=object)[answered]
        if not len(keys) or not len(ids):
            return nothing
        scores = block @ asked.T
        wanted = np.ones(scores.shape, dtype=bool) if threshold is None else scores > threshold
        codes, names = pd.factorize(keys)
        order = np.argsort(codes, kind="stable")
        starts = np.searchsorted(codes[order], np.arange(len(names)))
        totals = np.add.reduceat(np.where(wanted, scores, 0.0)[order], starts, axis=0)
        counts = np.add.reduceat(wanted[order].astype(np.int64), starts, axis=0)
        g, c = np.nonzero(counts)
        return _frame(question_id=ids[c], group_key=np.asarray(names, dtype=object)[g], total=totals[g, c], n=counts[g, c])

    sums = _meet(entities.select("group_key", "vector"), questions.select("question_id", "vector"), ["group_key"], fold, schema)
    return sums.groupBy("question_id", "group_key").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def exact_ranks(entities: DataFrame, questions: DataFrame, wanted: DataFrame, threshold: float) -> DataFrame:
    """(question_id, entity, rank): place of chosen entities in the complete ranking by dot product.

    ``wanted`` names a bounded number of entities per question.  One pass scores them; their scores then travel with the questions,
    and blocks only count how many of their entities come before each.  No ranking is written out.  Entities at or below ``threshold`` have no place
    and are left out.
    """
    # both passes see the same vectors in the same blocks, so a chosen entity ties with itself to the last bit
    placed = cut_lineage(entities.select("entity", "vector"))
    asked = cut_lineage(questions.select("question_id", "vector"))
    names = wanted.groupBy("question_id").agg(F.collect_set("entity").alias("names"))

    def score(e: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(e) or not len(q):
            return _frame(question_id=[], entity=[], score=[])
        scores = _matrix(q) @ _matrix(e).T
        row = {name: i for i, name in enumerate(e["entity"])}
        at = [(row[name], c) for c, chosen in enumerate(q["names"]) if chosen is not None for name in chosen if name in row]
        rows, cols = [r for r, _ in at], [c for _, c in at]
        return _frame(question_id=q["question_id"].to_numpy(dtype=object)[cols], entity=e["entity"].to_numpy(dtype=object)[rows], score=np.round(scores[cols, rows], 6) + 0.0)

    scored = _meet(placed, asked.join(names, "question_id", "left"), ["entity"], score, "question_id string, entity string, score double")
    marks = scored.filter(F.col("score") > threshold).groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("score", "entity"))).alias("marks"))
    marked = asked.join(marks, "question_id", "left").select("question_id", "vector", F.col("marks.score").alias("scores"), F.col("marks.entity").alias("names"))

    def count(e: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(e) or not len(q):
            return _frame(question_id=[], entity=[], ahead=[])
        scores = _matrix(q) @ _matrix(e).T
        names, out = e["entity"].to_numpy(dtype=object), []
        for c, (question, mark_scores, mark_names) in enumerate(zip(q["question_id"], q["scores"], q["names"])):
            if mark_names is None:
                continue
            mine = np.round(scores[c], 6) + 0.0
            order = np.sort(mine)
            upto, below = np.searchsorted(order, mark_scores, side="right"), np.searchsorted(order, mark_scores, side="left")
            ahead = len(order) - upto
            for j in np.nonzero(upto - below)[0]:
                ahead[j] += int(np.sum((mine == mark_scores[j]) & (names < mark_names[j])))
            out.append(_frame(question_id=[question] * len(mark_names), entity=mark_names, ahead=ahead))
        return pd.concat(out) if out else _frame(question_id=[], entity=[], ahead=[])

    counted = _meet(placed, marked, ["entity"], count, "question_id string, entity string, ahead bigint")
    return counted.groupBy("question_id", "entity").agg((F.sum("ahead") + 1).alias("rank"))
