"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams per language inside each task and sums the counts; the model is a matrix of languages times
BUCKETS log-probabilities, so its size does not depend on the rows.  It is broadcast, and texts are scored in batches: the
rows of the matrix that a batch's n-grams select are summed per text.

Defined results: a null text, or one without a letter, is ``und`` with score 0, as is everything when nothing could be
learned.  Rows with a null language or text teach nothing.  Ties go to the language first in order.  Repeated rows count
as often as they occur; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
ORDERS = (2, 3)
#: Bound of the broadcast model.
MOST_LANGUAGES = 500
UNKNOWN = "und"
_PIECE = 1 << 19
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, text number) of all n-grams, in pieces; texts are lower-cased and framed by spaces."""
    held, numbers, size = [], [], 0
    for number, text in enumerate(texts):
        framed = f" {text.lower()} "
        for a in range(0, len(framed), _PIECE):
            held.append(framed[a:a + _PIECE + max(ORDERS) - 1])
            numbers.append(number)
            size += len(held[-1])
            if size >= _PIECE:
                yield _hashed(held, numbers)
                held, numbers, size = [], [], 0
    if held:
        yield _hashed(held, numbers)


def _hashed(held: list[str], numbers: list[int]) -> tuple[np.ndarray, np.ndarray]:
    c = np.frombuffer("".join(held).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.repeat(np.array(numbers), [len(x) for x in held])
    # what starts behind _PIECE starts the next piece of the same text too and is counted there
    first = np.concatenate([np.arange(len(x)) < _PIECE for x in held])
    out, owners = [], []
    for n in ORDERS:
        m = len(c) - n + 1
        if m <= 0:
            continue
        total = np.full(m, n, dtype=np.uint32)
        for i in range(n):
            total = (total ^ (c[i:i + m] * _FACTORS[i % 3])) * np.uint32(0x27D4EB2F)
            total ^= total >> np.uint32(15)
        inside = (owner[:m] == owner[n - 1:]) & first[:m]
        out.append((total & np.uint32(BUCKETS - 1))[inside])
        owners.append(owner[:m][inside])
    return np.concatenate(out or [np.empty(0, np.uint32)]).astype(np.int64), np.concatenate(owners or [np.empty(0, np.int64)])


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang"):
    """(languages, log-probabilities) from all rows with a text and a language; None if there are none."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for lang in set(langs):
                own = totals.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                mine = [t for t, x in zip(texts, langs) if x == lang]
                own[BUCKETS] += len(mine)  # the last cell counts texts
                for bucket, _ in grams(mine):
                    own[:BUCKETS] += np.bincount(bucket, minlength=BUCKETS)
        for lang, own in totals.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(own[at])], ["lang", "bucket", "n"])

    known = rows.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")).dropna()
    counted = known.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).persist()
    n = counted.select("lang").distinct().count()
    if n > MOST_LANGUAGES:
        raise ValueError(f"{n} languages; the model is bounded to {MOST_LANGUAGES}")
    cells = counted.toPandas()  # at most MOST_LANGUAGES * (BUCKETS + 1) rows
    counted.unpersist()
    if not n:
        return None
    langs = sorted(cells["lang"].unique())
    matrix = np.zeros((BUCKETS + 1, len(langs)))
    matrix[cells["bucket"], cells["lang"].map({x: i for i, x in enumerate(langs)})] = cells["n"]
    prior = np.log(matrix[BUCKETS] / matrix[BUCKETS].sum())
    smooth = matrix[:BUCKETS] + 1.0
    return langs, np.log(smooth / smooth.sum(axis=0)), prior


def score(texts: list[str | None], model) -> tuple[list[str], np.ndarray]:
    """(language, posterior) of each text."""
    out, sure = [UNKNOWN] * len(texts), np.zeros(len(texts))
    at = [i for i, t in enumerate(texts) if t and model and any(map(str.isalpha, t))]
    if not at:
        return out, sure
    langs, logs, prior = model
    sums = np.tile(prior, (len(at), 1))
    for bucket, owner in grams([texts[i] for i in at]):
        # Owners come in runs, one for each text and order.
        first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else []
        if len(first):
            np.add.at(sums, owner[first], np.add.reduceat(logs[bucket], first, axis=0))
    best = sums.argmax(axis=1)
    post = 1.0 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
    for k, i in enumerate(at):
        out[i], sure[i] = langs[best[k]], post[k]
    return out, sure


def predict(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                langs, sure = score(part.column(1).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs), pa.array(sure)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(
        run, "doc_id long, lang_pred string, score double")
