"""Vector expressions: hash embeddings, fitting, question encoding and attention."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EPSILON = 1e-8


def _hash_number(text: Column) -> Column:
    """A repeatable non-negative number from the first 32 bits of the MD5 digest."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def text_embedding(text: Column, dims: int = 10) -> Column:
    """Component i is the hash of the text followed by i, scaled to [0, 1); null text gives zeros."""
    parts = F.transform(
        F.sequence(F.lit(0), F.lit(dims - 1)),
        lambda i: (_hash_number(F.concat(text, i.cast("string"))) % 1000).cast("double") / F.lit(1000.0),
    )
    return F.when(text.isNull(), zeros(dims)).otherwise(parts)


def zeros(dims: int) -> Column:
    return F.array_repeat(F.lit(0.0), dims)


def fit_vector(vector: Column, dims: int, text: Column | None = None) -> Column:
    """Cut or zero-pad to ``dims``; blank source text or a missing vector gives zeros."""
    given = F.coalesce(vector.cast("array<double>"), F.array().cast("array<double>"))
    missing = F.greatest(F.lit(dims) - F.size(given), F.lit(0))
    fitted = F.slice(F.concat(given, F.array_repeat(F.lit(0.0), missing)), 1, dims)
    if text is None:
        return fitted
    blank = text.isNull() | (F.trim(text) == "")
    return F.when(blank, zeros(dims)).otherwise(fitted)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def unit(vector: Column, epsilon: float = 0.0) -> Column:
    """The vector over its length plus ``epsilon``; a zero vector stays zero.

    The vector and its length are bound as one struct, so neither is computed again per component.
    """
    bound = F.transform(F.array(vector), lambda v: F.struct(v.alias("v"), (norm(v) + F.lit(epsilon)).alias("n")))
    scaled = F.transform(
        bound, lambda s: F.transform(s["v"], lambda x: F.when(s["n"] > 0, x.cast("double") / s["n"]).otherwise(F.lit(0.0)))
    )
    return scaled[0]


def encode_question(question: Column, slots: int = 10) -> Column:
    """Hash weight of each of the first words in its own slot, divided by the norm."""
    words = F.filter(F.split(F.lower(question), r"\s+"), lambda w: w != "")
    weights = F.transform(F.slice(words, 1, slots), lambda w: (_hash_number(w) % 100).cast("double") / F.lit(100.0))
    return unit(fit_vector(weights, slots), EPSILON)


def attention(a: Column, b: Column) -> Column:
    """Cosine with a small constant in the denominator, never below zero."""
    return F.greatest(F.lit(0.0), dot(a, b) / (norm(a) * norm(b) + F.lit(EPSILON)))
