"""Whitening of embeddings by a bidiagonal qd solver.

1. Entries become whole numbers, x = floor(64 * c) + 1000000, so counts and sums per dimension are exact.
2. Blockwise QR: every task stacks centred rows under the triangle it holds and reduces again; triangles of tasks merge the
   same way, in two levels.  V = R'R / n is never formed, so no accuracy is lost by squaring.
3. Householder reflections from both sides bring R to upper bidiagonal form.
4. dqds sweeps find all squared singular values of the bidiagonal to high relative accuracy.
5. Twisted factorisations of the shifted LDL' give one eigenvector for each of the leading values; right reflections carry
   them back to the dimensions of the table.  Values tied to three digits get their vectors from the subspace they span.

Vectors of one length form one fit list; each length is fitted on its own.  A model is ``dim`` * ``components`` numbers, so it
is bounded by the vectors' length; models of many lengths go to the tasks in groups of at most ``MODEL_BYTES``.

Defined results: a null vector, or one with a null or non-finite entry, is dropped; a null id stays null; repeated rows count
each time; an empty vector, a list without variance (a single row, equal rows) and an empty table give no rows; directions
whose variance is zero up to rounding are left out; numbers beyond 2**61 are clipped; a deviation beyond a long is null; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 32
#: Rows of one reduction and of one output batch.
BLOCK = 2048
#: Groups that triangles of tasks merge in before the last merge.
MERGES = 64
#: Bytes of models that one pass sends to the tasks.
MODEL_BYTES = 64 << 20
#: Values closer than this, relatively, count as tied.
TIED = 1e-3
_EPS = np.finfo(float).eps


# ---- the solver -------------------------------------------------------------------------------------------------

def reduced(triangle: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    """The upper triangle that has the same R'R as ``triangle`` stacked on ``rows``."""
    stacked = rows if triangle is None else np.vstack([triangle, rows])
    r = np.linalg.qr(stacked, mode="r")
    if r.shape[0] < r.shape[1]:
        r = np.vstack([r, np.zeros((r.shape[1] - r.shape[0], r.shape[1]))])
    return r


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """(v, beta) such that x - beta * v * (v'x) is a multiple of the first unit vector."""
    v = x.copy()
    norm = float(np.linalg.norm(x))
    if norm == 0.0:
        return v, 0.0
    v[0] += math.copysign(norm, x[0])
    return v, 2.0 / float(v @ v)


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, P) with r = Q B P' for an upper bidiagonal B."""
    a = r.astype(float).copy()
    d = a.shape[0]
    p = np.eye(d)
    for k in range(d):
        v, beta = _reflector(a[k:, k])
        a[k:, k:] -= beta * np.outer(v, v @ a[k:, k:])
        if k + 2 < d:
            v, beta = _reflector(a[k, k + 1:])
            a[k:, k + 1:] -= beta * np.outer(a[k:, k + 1:] @ v, v)
            p[:, k + 1:] -= beta * np.outer(p[:, k + 1:] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), p


def _sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], int, float]:
    """One dqds transform: (new q, new e, place of the first negative pivot or -1, that pivot)."""
    n = len(q)
    out_q, out_e = [0.0] * n, [0.0] * (n - 1)
    d = q[0] - shift
    for i in range(n - 1):
        if d < 0.0:
            return out_q, out_e, i, d
        out_q[i] = d + e[i]
        t = q[i + 1] / out_q[i]
        out_e[i] = e[i] * t
        d = d * t - shift
    out_q[n - 1] = d
    return out_q, out_e, (n - 1 if d < 0.0 else -1), d


def _shift(q: list[float], e: list[float]) -> float:
    """The smaller eigenvalue of the last two rows: a guess that a failed sweep corrects."""
    a, b, c = q[-2] + (e[-3] if len(e) > 2 else 0.0), q[-1] + e[-1], math.sqrt(q[-2] * e[-1])
    half = math.hypot((a - b) / 2, c)
    return max(0.0, min((a * b - c * c) / ((a + b) / 2 + half) if a + b > 0 else 0.0, q[-1] + e[-1]))


def dqds(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Eigenvalues, falling, of B'B for the bidiagonal with squared diagonal ``q`` and squared superdiagonal ``e``."""
    found: list[float] = []
    work = [([float(x) for x in q], [float(x) for x in e], 0.0)]
    while work:
        q_, e_, base = work.pop()
        while q_:
            n = len(q_)
            small = [i for i in range(n - 1) if e_[i] <= _EPS * _EPS * (base + min(q_[i], q_[i + 1])) or e_[i] < 1e-290]
            if n == 1:
                found.append(base + q_[0])
                break
            if small:
                cut = small[-1]
                work.append((q_[:cut + 1], e_[:cut], base))
                q_, e_ = q_[cut + 1:], e_[cut + 1:]
                continue
            if 1.5 * q_[0] < q_[-1]:
                q_, e_ = q_[::-1], e_[::-1]
            shift = _shift(q_, e_)
            while True:
                new_q, new_e, bad, pivot = _sweep(q_, e_, shift)
                if bad < 0:
                    break
                # A sweep that fails only at its end tells how far the shift was too large.
                late = shift + pivot if bad == n - 1 else 0.0
                shift = late if 0.0 < late < shift * (1 - 4 * _EPS) else shift / 4
                if shift <= _EPS * min(q_):
                    shift = 0.0
            q_, e_, base = new_q, new_e, base + shift
    return np.sort(np.array(found))[::-1]


def twisted_vector(diag: np.ndarray, above: np.ndarray, value: float) -> np.ndarray:
    """A unit eigenvector of B'B at ``value``: twisted at the row whose pivot is smallest."""
    d = len(diag)
    dd, ll = diag * diag, above / diag[:-1]
    tiny = 1e-300 + _EPS * _EPS * value
    s, p = np.empty(d), np.empty(d)
    lower, upper = np.empty(d - 1), np.empty(d - 1)
    s[0] = -value
    for i in range(d - 1):
        pivot = s[i] + dd[i]
        pivot = pivot if pivot != 0.0 else tiny
        lower[i] = dd[i] * ll[i] / pivot
        s[i + 1] = lower[i] * ll[i] * s[i] - value
    p[d - 1] = dd[d - 1] - value
    for i in range(d - 2, -1, -1):
        pivot = dd[i] * ll[i] * ll[i] + p[i + 1]
        pivot = pivot if pivot != 0.0 else tiny
        t = dd[i] / pivot
        upper[i] = ll[i] * t
        p[i] = p[i + 1] * t - value
    gamma = np.abs(s + p + value)
    gamma[~np.isfinite(gamma)] = np.inf
    twist = int(np.argmin(gamma))
    z = np.zeros(d)
    z[twist] = 1.0
    for i in range(twist - 1, -1, -1):
        z[i] = -lower[i] * z[i + 1]
    for i in range(twist, d - 1):
        z[i + 1] = -upper[i] * z[i]
    return z / np.linalg.norm(z)


def _tied_vectors(diag: np.ndarray, above: np.ndarray, values: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Orthonormal eigenvectors of values so close that their own vectors may lean on each other."""
    d = len(diag)
    t = np.diag(diag * diag)
    t[np.arange(1, d), np.arange(1, d)] += above * above
    off = diag[:-1] * above
    t[np.arange(d - 1), np.arange(1, d)] = t[np.arange(1, d), np.arange(d - 1)] = off
    basis, r = np.linalg.qr(start)
    if np.min(np.abs(np.diag(r))) < 1e-6:
        # The vectors coincide: inverse iteration on the whole space instead.
        basis = np.linalg.qr(np.random.default_rng(len(values)).standard_normal((d, len(values))))[0]
        aim = float(np.mean(values)) * (1 + 1e-10) + 1e-290
        for _ in range(4):
            basis = np.linalg.qr(np.linalg.solve(t - aim * np.eye(d), basis))[0]
    ritz, turn = np.linalg.eigh(basis.T @ t @ basis)
    return basis @ turn[:, np.argsort(ritz)[::-1]]


def principal_directions(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors): up to ``most`` leading eigenvalues of R'R, falling, and unit eigenvectors as columns."""
    scale = float(np.max(np.abs(r))) if r.size else 0.0
    if scale == 0.0:
        return np.empty(0), np.empty((r.shape[1], 0))
    diag, above, p = bidiagonal(r / scale)
    floor = 1e-100
    diag = np.where(np.abs(diag) < floor, floor, diag)
    values = dqds(diag * diag, above * above)
    values = values[values > (len(diag) * _EPS) ** 2 * values[0]]
    # Ties at the cut take part whole, so that the kept vectors of a tied group are orthogonal.
    count = min(most, len(values))
    while count < len(values) and values[count - 1] - values[count] <= TIED * values[count - 1]:
        count += 1
    z = np.column_stack([twisted_vector(diag, above, v) for v in values[:count]]) if len(diag) > 1 else np.ones((1, count))
    a = 0
    while a < count:
        b = a + 1
        while b < count and values[b - 1] - values[b] <= TIED * values[b - 1]:
            b += 1
        if b - a > 1:
            z[:, a:b] = _tied_vectors(diag, above, values[a:b], z[:, a:b])
        a = b
    keep = min(most, count)
    return values[:keep] * scale * scale, (p @ z)[:, :keep]


# ---- the Spark job ----------------------------------------------------------------------------------------------

def whole_numbers(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(SCALE * values) + OFFSET, -(2.0 ** 61), 2.0 ** 61).astype(np.int64)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows of the batch, whole numbers) for every vector length of a batch."""
    column = batch.column("vector")
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    for dim in np.unique(sizes):
        if dim == 0:
            continue
        rows = np.flatnonzero(sizes == dim)
        for a in range(0, len(rows), BLOCK):
            part = rows[a:a + BLOCK]
            yield int(dim), part, whole_numbers(flat[offsets[part][:, None] + np.arange(dim)[None, :]])


def _sum_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list] = {}
    for batch in batches:
        for dim, rows, x in _by_length(batch):
            have = held.setdefault(dim, [0, [0] * dim])
            have[0] += len(rows)
            have[1] = [a + b for a, b in zip(have[1], x.astype(object).sum(axis=0) if np.abs(x).max() > 2 ** 45 else x.sum(axis=0).tolist())]
    for dim, (n, sums) in held.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([dim], pa.int32()), pa.array([n], pa.int64()), pa.array([[str(s) for s in sums]], pa.list_(pa.string()))], ["dim", "n", "sums"])


def _merge_sums(part: pd.DataFrame) -> pd.DataFrame:
    totals = [sum(int(s) for s in column) for column in zip(*part["sums"])]
    return pd.DataFrame({"dim": [int(part["dim"].iloc[0])], "n": [int(part["n"].sum())], "sums": [[str(t) for t in totals]]})


def _centring(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whole centre, rest of the mean, exact rest of the sums): x - S/n without loss is x - centre - rest."""
    centre = [(2 * s + n) // (2 * n) for s in sums]
    left = [s - n * c for s, c in zip(sums, centre)]
    return np.array(centre, dtype=np.int64), np.array([v / n for v in left]), np.array(left, dtype=object)


def _triangle_batches(lists: dict[int, tuple[int, list[int]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        means = {dim: _centring(n, sums) for dim, (n, sums) in lists.items()}
        for batch in batches:
            for dim, _, x in _by_length(batch):
                if dim in means:
                    centre, rest, _ = means[dim]
                    held[dim] = reduced(held.get(dim), (x - centre) - rest)
        for dim, r in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([r.tobytes()], pa.binary())], ["dim", "triangle"])

    return run


def _merged(part: pd.DataFrame) -> tuple[int, np.ndarray]:
    dim = int(part["dim"].iloc[0])
    r = None
    for blob in sorted(part["triangle"]):
        r = reduced(r, np.frombuffer(blob).reshape(dim, dim))
    return dim, r


def _merge_triangles(part: pd.DataFrame) -> pd.DataFrame:
    dim, r = _merged(part)
    return pd.DataFrame({"dim": [dim], "triangle": [r.tobytes()]})


def _solve(most: int, counts: dict[int, int]):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        dim, r = _merged(part)
        values, vectors = principal_directions(r, most)
        total = float(np.sum(r * r))
        return pd.DataFrame({"dim": [dim], "values": [(values / counts[dim]).tobytes()], "vectors": [np.ascontiguousarray(vectors).tobytes()],
                             "explained": [(values / total if total > 0 else values).tobytes()]})

    return run


class Model:
    """What one fit list says: its size, exact sums, eigenvalues, unit directions and shares of the variance."""

    def __init__(self, dim: int, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray, explained: np.ndarray):
        self.dim, self.n, self.sums = dim, n, sums
        self.values, self.vectors, self.explained = values, vectors, explained
        self.error = 0.0

    def whitened(self, x: np.ndarray) -> np.ndarray:
        centre, rest, _ = _centring(self.n, self.sums)
        return ((x - centre) - rest) @ (self.vectors / np.sqrt(self.values))

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of (n * x - S) ** 2; None where a long cannot hold one."""
        centre, _, left = _centring(self.n, self.sums)
        near = np.abs(x - centre).max(axis=1).astype(float) * self.n + self.n
        small = near * near * self.dim < 2.0 ** 62
        out: list[int | None] = [None] * len(x)
        quick = np.flatnonzero(small)
        if len(quick):
            gap = (x[quick] - centre) * self.n - left.astype(np.int64)
            for i, v in zip(quick.tolist(), (gap * gap).sum(axis=1).tolist()):
                out[i] = v
        for i in np.flatnonzero(~small).tolist():
            total = sum((int(v) * self.n - s) ** 2 for v, s in zip(x[i], self.sums))
            out[i] = total if total < 2 ** 63 else None
        return out


def _vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    rows = df.select(F.col(f"`{id_col}`").alias("id"), vector.alias("vector"))
    finite = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.filter(F.col("vector").isNotNull() & F.coalesce(finite, F.lit(False)))


def fit(df: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> list[list[Model]]:
    """Models of all vector lengths, in groups of at most MODEL_BYTES each."""
    rows = _vectors(df, id_col, vector_col).select("vector")
    sums = rows.mapInArrow(_sum_batches, "dim int, n long, sums array<string>")
    sums = sums.groupBy("dim").applyInPandas(_merge_sums, "dim int, n long, sums array<string>")
    groups: list[list[tuple[int, int, list[int]]]] = [[]]
    room = MODEL_BYTES
    for row in sums.orderBy("dim").toLocalIterator():
        need = 8 * row.dim * (components + 4)
        if groups[-1] and need > room:
            groups.append([])
            room = MODEL_BYTES
        groups[-1].append((row.dim, row.n, [int(s) for s in row.sums]))
        room -= need
    return [_fit_group(rows, {dim: (n, s) for dim, n, s in group}, components) for group in groups if group]


def _fit_group(rows: DataFrame, lists: dict[int, tuple[int, list[int]]], components: int) -> list[Model]:
    schema = "dim int, triangle binary"
    triangles = rows.mapInArrow(_triangle_batches(lists), schema).withColumn("part", F.pmod(F.xxhash64("triangle"), F.lit(MERGES)))
    triangles = triangles.groupBy("dim", "part").applyInPandas(_merge_triangles, schema)
    solved = triangles.groupBy("dim").applyInPandas(
        _solve(components, {dim: n for dim, (n, _) in lists.items()}), "dim int, values binary, vectors binary, explained binary").collect()
    models = []
    for row in solved:
        n, sums = lists[row.dim]
        values = np.frombuffer(row["values"])
        if len(values):
            models.append(Model(row.dim, n, sums, values, np.frombuffer(row.vectors).reshape(row.dim, len(values)), np.frombuffer(row.explained)))
    errors = {row.dim: row.error for row in _identity_errors(rows, models).collect()} if models else {}
    for model in models:
        model.error = errors[model.dim]
    return models


def _identity_errors(rows: DataFrame, models: list[Model]) -> DataFrame:
    """(dim, error): the largest absolute entry of the whitened rows' covariance minus the identity, over all rows."""
    by = {m.dim: m for m in models}

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for dim, _, x in _by_length(batch):
                if dim in by:
                    w = by[dim].whitened(x)
                    k = w.shape[1]
                    have = held.setdefault(dim, [np.zeros((k, k)), np.zeros(k)])
                    have[0] += w.T @ w
                    have[1] += w.sum(axis=0)
        for dim, (products, sums) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), pa.array([products.tobytes()], pa.binary()), pa.array([sums.tobytes()], pa.binary())], ["dim", "products", "sums"])

    def added(part: pd.DataFrame) -> tuple[int, int, np.ndarray, np.ndarray]:
        dim = int(part["dim"].iloc[0])
        k = len(by[dim].values)
        return dim, k, sum(np.frombuffer(b).reshape(k, k) for b in part["products"]), sum(np.frombuffer(b) for b in part["sums"])

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        dim, _, products, sums = added(part)
        return pd.DataFrame({"dim": [dim], "products": [products.tobytes()], "sums": [sums.tobytes()]})

    def error(part: pd.DataFrame) -> pd.DataFrame:
        dim, k, products, sums = added(part)
        mean = sums / by[dim].n
        return pd.DataFrame({"dim": [dim], "error": [float(np.max(np.abs(products / by[dim].n - np.outer(mean, mean) - np.eye(k))))]})

    schema = "dim int, products binary, sums binary"
    parts = rows.mapInArrow(gram, schema).withColumn("part", F.pmod(F.xxhash64("products"), F.lit(MERGES)))
    return parts.groupBy("dim", "part").applyInPandas(merge, schema).groupBy("dim").applyInPandas(error, "dim int, error double")


def whiten(df: DataFrame, groups: list[list[Model]], id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector and component: id, component, n, deviation, whitened, explained, identity_error."""
    rows = _vectors(df, id_col, vector_col)
    id_type = rows.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    out = df.sparkSession.createDataFrame([], schema)
    for group in groups:
        out = rows.mapInArrow(_score_batches(group), schema).union(out)
    return out.withColumnRenamed("id", id_col)


def _score_batches(models: list[Model]):
    by = {m.dim: m for m in models}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, rows, x in _by_length(batch):
                model = by.get(dim)
                if model is None:
                    continue
                k, m = len(model.values), len(rows)
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").take(pa.array(rows)).take(each), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                    pa.array(np.full(m * k, model.n), pa.int64()), pa.array(model.deviation(x), pa.int64()).take(each),
                    pa.array(model.whitened(x).ravel()), pa.array(np.tile(model.explained, m)), pa.array(np.full(m * k, model.error)),
                ], ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run
