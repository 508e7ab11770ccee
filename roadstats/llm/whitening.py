"""Embedding whitening by a bidiagonal qd solver.

Every entry c becomes the integer floor(64 * c) + 1000000.  The fit reads all usable
vectors:

1. Exact integer sums per dimension, added up by Spark, give the mean.
2. Blockwise QR: a task reduces its centred rows, block by block, to one triangle R;
   the tasks' triangles are reduced again, ``FAN_IN`` at a time, until one is left.
   The covariance is R'R / n; it is never formed, so nothing is lost by squaring.
3. Householder reflections turn R into an upper bidiagonal B = U'RV.
4. dqds, with shifts that never pass the smallest value, finds the singular values of B
   to high relative accuracy; twisted factorisations of B'B - lambda give its vectors,
   and V carries them back to directions of the input.

Only R (one value per pair of dimensions) and the directions reach the driver.

Defined cases: vectors that are null, empty, or hold null or non-finite entries or ones
beyond 1e9 in size are left out, as are those whose length isn't the most frequent one
(of equally frequent ones the greatest); null or repeated ids and repeated rows are rows
like others; other columns are ignored; directions without variance (to rounding) have
no component, so an empty table, one vector or equal vectors give no rows; components of
equal variance are any orthonormal basis of their space; each direction's largest entry
is positive; a deviation beyond a long is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadstats.llm.common import save

#: The scale and the offset of the integers.
SCALE, OFFSET = 64, 1_000_000
#: Greatest size of an entry, so that the sums of ``FLUSH`` rows fit in a long.
LIMIT, FLUSH = 1e9, 10_000_000
#: Triangles reduced to one at a time, and rows that a reduction stacks at once.
FAN_IN, ROWS = 32, 4096
EPS = float(np.finfo(float).eps)
#: Directions whose singular value is below this share of the largest hold no variance.
NO_VARIANCE = 1e-12


# --- singular values and vectors of a triangle -------------------------------------------

def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, V) of the bidiagonal U'RV, by Householder reflections from both sides."""
    m, d = np.array(r, float), len(r)
    v = np.eye(d)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        size = np.abs(x).max() if len(x) else 0.0
        if len(x) < 2 or size == 0.0 or not np.abs(x[1:]).max():
            return None
        u = x / size
        u[0] += np.copysign(np.linalg.norm(u), u[0])
        return u / np.linalg.norm(u)

    for k in range(d):
        u = reflector(m[k:, k].copy())
        if u is not None:
            m[k:, k:] -= 2 * np.outer(u, u @ m[k:, k:])
        u = reflector(m[k, k + 1:].copy())
        if u is not None:
            m[k:, k + 1:] -= 2 * np.outer(m[k:, k + 1:] @ u, u)
            v[:, k + 1:] -= 2 * np.outer(v[:, k + 1:] @ u, u)
    return np.diag(m).copy(), np.diag(m, 1).copy(), v


def _sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """One dqds transform; None if the shift passed the smallest value."""
    d, nq, ne = q[0] - shift, [], []
    for k in range(len(e)):
        if d < 0:
            return None
        top = d + e[k]
        share = q[k + 1] / top if top > 0 else 0.0
        nq.append(top)
        ne.append(e[k] * share)
        d = d * share - shift if top > 0 else q[k + 1] - shift
    return None if d < 0 else ([*nq, d], ne)


def _bounds(q: list[float], e: list[float]) -> tuple[float, float]:
    """A lower and an upper bound of the smallest value, from the diagonal of the inverse of BB'."""
    w, total, most = 0.0, 0.0, 0.0
    for k, x in enumerate(q):
        if x <= 0:
            return 0.0, 0.0
        w = (1 + e[k - 1] * w) / x if k else 1 / x
        total, most = total + w, max(most, w)
    return (1 / total, 1 / most) if np.isfinite(total) else (0.0, 0.0)


def dqds(q: list[float], e: list[float]) -> list[float]:
    """Squared singular values, falling, of the bidiagonal with squared entries ``q`` and ``e``."""
    found, work = [], [(list(q), list(e), 0.0)]
    while work:
        q, e, moved = work.pop()
        for _ in range(100 * len(q) + 100):
            while len(q) > 1 and e[-1] <= EPS * EPS * (moved + q[-1]):
                found.append(moved + q.pop())
                e.pop()
            if len(q) == 1:
                found.append(moved + q[0])
                break
            cut = next((k for k in range(len(e) - 1) if e[k] <= EPS * EPS * (moved + q[k])), None)
            if cut is not None:
                work += [(q[:cut + 1], e[:cut], moved), (q[cut + 1:], e[cut + 1:], moved)]
                break
            if 2 * q[0] < q[-1]:  # the smallest value is to come out at the end
                q, e = q[::-1], e[::-1]
            low, high = _bounds(q, e)
            for shift in ((low + high) / 2 if high > 1.05 * low else low, low * (1 - 16 * len(q) * EPS), 0.0):
                swept = _sweep(q, e, shift)
                if swept is not None:
                    q, e = swept
                    moved += shift
                    break
        else:
            raise ArithmeticError("the qd sweeps did not settle")
    return sorted(found, reverse=True)


def _twists(a: np.ndarray, b: np.ndarray, value: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gamma, down, up): twisted factorisations of B'B - value, from the stationary and the progressive transform."""
    n, d, off = len(a), a * a, b * b
    least = EPS * EPS * (d.max() + off.max(initial=0))

    def kept(pivot: float) -> float:
        return pivot if abs(pivot) >= least else np.copysign(least, pivot)

    s, p = np.empty(n), np.empty(n)
    down, up = np.empty(n), np.empty(n)  # down[i]: L+ of i, i + 1; up[i]: U- of i, i + 1
    s[0] = -value
    for i in range(n - 1):
        pivot = kept(d[i] + s[i])
        down[i] = a[i] * b[i] / pivot
        s[i + 1] = off[i] / d[i] * (d[i] / pivot) * s[i] - value
    p[-1] = d[-1] - value
    for i in range(n - 2, -1, -1):
        pivot = kept(off[i] + p[i + 1])
        up[i] = a[i] * b[i] / pivot
        p[i] = p[i + 1] * (d[i] / pivot) - value
    return s + p + value, down, up


def _twisted_vector(down: np.ndarray, up: np.ndarray, at: int) -> np.ndarray:
    z = np.zeros(len(down))
    z[at] = 1.0
    for i in range(at - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(at, len(z) - 1):
        z[i + 1] = -up[i] * z[i]
    size = np.linalg.norm(z)
    return z / size if np.isfinite(size) else np.zeros(len(z))


def bidiagonal_vectors(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(squared singular values, right singular vectors as columns) of an upper bidiagonal, largest first.

    Entries of B that vanish split it, and vectors of a part vanish outside it.  Vectors of
    values closer than a thousandth are made orthogonal; where one is lost by that, another twist gives it.
    """
    n = len(a)
    most = max(float(np.abs(a).max(initial=0)), float(np.abs(b).max(initial=0)))
    if most == 0:
        return np.zeros(n), np.eye(n)
    a, b = a / most, b / most
    a = np.where(np.abs(a) < EPS * EPS, EPS * EPS, a)
    cuts = [0, *(np.flatnonzero(np.abs(b) <= EPS * np.sqrt(np.abs(a[:-1] * a[1:]))) + 1).tolist(), n]
    values, vectors = [], []
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        pa_, pb = a[lo:hi], b[lo:hi - 1]
        near: list[tuple[float, np.ndarray]] = []
        for value in dqds((pa_ * pa_).tolist(), (pb * pb).tolist()):
            gamma, down, up = _twists(pa_, pb, value)
            near = [(v, z) for v, z in near if v - value <= 1e-3 * v]
            best, kept = None, -1.0
            for at in np.argsort(np.abs(gamma))[:1 + 8 * bool(near)]:
                z = _twisted_vector(down, up, int(at))
                left = 1.0
                for _ in range(2):
                    for _, other in near:
                        z = z - (other @ z) * other
                    size = np.linalg.norm(z)
                    left, z = left * size, z / size if size > 0 else z
                if left > kept:
                    best, kept = z, left
                if kept > 0.5:
                    break
            near.append((value, best))
            whole = np.zeros(n)
            whole[lo:hi] = best
            values.append(value)
            vectors.append(whole)
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order] * most * most, np.array(vectors)[order].T


# --- the fit ------------------------------------------------------------------------------

@dataclass(frozen=True)
class Whitening:
    """What a fit found: ``n`` vectors, exact ``sums``, ``directions`` (columns) with their
    ``variances``, and the ``trace`` of the covariance."""

    n: int
    sums: tuple[int, ...]
    directions: np.ndarray
    variances: np.ndarray
    trace: float


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows of ``vectors`` without null, non-finite and immense entries."""
    size = F.abs(F.col("embedding").cast("array<double>")[0])
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) <= LIMIT))
    return vectors.select("vec_id", "embedding").where((F.size("embedding") > 0) & size.isNotNull() & fine)


def _blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(batch, rows of it, their integers) by length of vector."""
    for batch in batches:
        lists = batch.column(column)
        offsets = np.asarray(lists.offsets)
        lengths = np.diff(offsets)
        flat = lists.values.to_numpy(zero_copy_only=False).astype(float)
        for d in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == d)
            c = flat[offsets[rows][:, None] + np.arange(d)]
            yield batch, rows, np.floor(SCALE * c).astype(np.int64) + OFFSET


def _triangle(rows: np.ndarray) -> np.ndarray:
    r = np.linalg.qr(rows, mode="r")
    return r if len(r) == rows.shape[1] else np.vstack([r, np.zeros((rows.shape[1] - len(r), rows.shape[1]))])


def reduced(rows: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """The triangle R of all centred rows of ``rows`` (embedding)."""
    mean, d = np.array([s // n for s in sums]), len(sums)
    rest = np.array([(s % n) / n for s in sums])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, any_rows = np.zeros((d, d)), False
        for _, _, x in _blocks(batches, 0):
            for at in range(0, len(x) if x.shape[1] == d else 0, ROWS):
                r, any_rows = _triangle(np.vstack([r, (x[at:at + ROWS] - mean) - rest])), True
        if any_rows:
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int64()),
                                   pa.array([r.tobytes()], pa.binary())], names=["slot", "r"])

    def together(pdf):
        r = np.zeros((d, d))
        for x in pdf.sort_values("slot")["r"]:
            r = _triangle(np.vstack([r, np.frombuffer(x).reshape(d, d)]))
        return pdf[:1].assign(slot=int(pdf["slot"].iloc[0]) // FAN_IN, r=[r.tobytes()])

    left = save(rows.select("embedding").mapInArrow(own, "slot bigint, r binary"), "whitening-triangles")
    while left.agg(F.max("slot")).first()[0]:
        left = save(left.groupBy(F.floor(F.col("slot") / FAN_IN).alias("g")).applyInPandas(
            together, "slot bigint, r binary"), "whitening-triangles")
    return np.frombuffer(left.first()["r"]).reshape(d, d)


def fit(vectors: DataFrame, components: int = 32) -> Whitening | None:
    """The whitening of all usable rows of ``vectors`` (vec_id, embedding); None if there are none."""
    rows = usable(vectors)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray]] = {}

        def told() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(held), pa.int64()), pa.array([n for n, _ in held.values()], pa.int64()),
                                    pa.array([s.tolist() for _, s in held.values()], pa.list_(pa.int64()))],
                                   names=["d", "n", "sums"])
        for _, _, x in _blocks(batches, 0):
            n, s = held.get(x.shape[1], (0, np.zeros(x.shape[1], np.int64)))
            held[x.shape[1]] = (n + len(x), s + x.sum(axis=0))
            if n + len(x) >= FLUSH:
                yield told()
                held.clear()
        yield told()

    sums = save(rows.select("embedding").mapInArrow(own, "d bigint, n bigint, sums array<bigint>"), "whitening-sums")
    best = sums.groupBy("d").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if best is None:
        return None
    n, d = best["n"], best["d"]
    total = {r["at"]: int(r["s"]) for r in sums.where(F.col("d") == d).select(F.posexplode("sums").alias("at", "x"))
             .groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("s")).collect()}  # one row a dimension
    total = [total[i] for i in range(d)]
    r = reduced(rows, n, total)
    a, b, v = bidiagonal(r)
    values, vectors_ = bidiagonal_vectors(a, b)
    held = int((np.sqrt(values) > NO_VARIANCE * max(np.sqrt(values[0]), OFFSET * EPS)).sum())
    directions = (v @ vectors_)[:, :min(components, held)]
    directions = directions * np.sign(directions[np.abs(directions).argmax(axis=0), np.arange(directions.shape[1])])
    return Whitening(n, tuple(total), directions, values[:directions.shape[1]] / n, float((r * r).sum() / n))


def _whitened(x: np.ndarray, model: Whitening) -> np.ndarray:
    mean = np.array([s // model.n for s in model.sums])
    rest = np.array([(s % model.n) / model.n for s in model.sums])
    return ((x - mean) - rest) @ (model.directions / np.sqrt(model.variances))


def _deviation(x: np.ndarray, model: Whitening) -> list[int | None]:
    """Sums over dimensions of (n * x - S) ** 2, exact."""
    sums, d = np.array(model.sums, object), x.shape[1]
    most = model.n * int(np.abs(x).max()) + max(abs(s) for s in model.sums)
    if most < 2 ** 62 and d * most * most < 2 ** 62:
        return ((model.n * x - sums.astype(np.int64)) ** 2).sum(axis=1).tolist()
    if most < 2 ** 62:
        off = model.n * x - sums.astype(np.int64)
        if d * int(np.abs(off).max()) ** 2 < 2 ** 62:
            return (off ** 2).sum(axis=1).tolist()
    exact = ((model.n * x.astype(object) - sums) ** 2).sum(axis=1)
    return [int(v) if v < 2 ** 63 else None for v in exact]


def transform(vectors: DataFrame, model: Whitening) -> DataFrame:
    """(vec_id, deviation, whitened array<double>) of the usable rows of ``vectors`` that are as long as the model."""
    d = len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows, x in _blocks(batches, 1):
            if x.shape[1] == d:
                w = _whitened(x, model)
                yield pa.record_batch([batch.column(0).take(pa.array(rows)), pa.array(_deviation(x, model), pa.int64()),
                                       pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()),
                                                                pa.array(w.ravel()))],
                                      names=["vec_id", "deviation", "whitened"])
    rows = usable(vectors)
    return rows.mapInArrow(run, f"vec_id {dict(rows.dtypes)['vec_id']}, deviation bigint, whitened array<double>")


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened vectors' covariance less the identity, over all of ``vectors``."""
    d, k = len(model.sums), model.directions.shape[1]

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, p = np.zeros(k), np.zeros((k, k))
        for _, _, x in _blocks(batches, 0):
            if x.shape[1] == d:
                w = _whitened(x, model)
                s, p = s + w.sum(axis=0), p + w.T @ w
        yield pa.record_batch([pa.array([np.vstack([s, p]).ravel().tolist()], pa.list_(pa.float64()))], names=["s"])
    parts = usable(vectors).select("embedding").mapInArrow(own, "s array<double>")
    rows = parts.select(F.posexplode("s").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect()
    s = np.zeros((k + 1) * k)
    for r in rows:  # (components + 1) * components values
        s[r["at"]] = r["x"]
    s = s.reshape(k + 1, k) / model.n
    # rows are centred on the exact mean; what rounding left of it is taken off here
    return float(np.abs(s[1:] - np.outer(s[0], s[0]) - np.eye(k)).max())


def components(vectors: DataFrame, most: int = 32) -> DataFrame:
    """One row per usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    kind = dict(vectors.dtypes)["vec_id"]
    model = fit(vectors, most)
    schema = (f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, "
              "identity_error double")
    if model is None or not len(model.variances):
        return vectors.sparkSession.createDataFrame([], schema)
    error = identity_error(vectors, model)
    explained = F.array(*[F.lit(float(e / model.trace)) for e in model.variances])
    out = transform(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"),
                      "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"),
                      F.lit(error).alias("identity_error"))
