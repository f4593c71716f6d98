"""Embedding whitening by spectrum slicing.

Components c become integers x = floor(scale * c). The fit list is each distinct x vector once, found
by an aggregate over the packed integers (repetitions fall away before the shuffle). One pass sums it,
exactly; a second one sums the products of centred vectors, one row of the covariance for each
dimension and task; both leave what is bounded by the dimensions alone on the driver.

The leading eigenvalues are isolated there: the inertia of LDL^T of the covariance less a shift counts
the eigenvalues above the shift, and halving the spectrum by these counts gives an interval with one
eigenvalue only. Rayleigh quotient iteration starts inside and converges cubically; if it leaves the
interval, that is halved further. Two counts, just below and above the result, certify its number. An
interval that cannot be split to rounding holds equal eigenvalues: each gets a vector orthogonal to
those before.

Then every row is projected, map-side. The identity error is measured on the fit list by a pass of
its own.

Rows whose vector is null, empty, or holds null or non-finite entries are dropped; so are vectors of
another length than most have (ties: the longer). Repeated rows are returned each. Where the fit list
has fewer directions than components are asked for (one distinct vector has none), only those of
non-zero variance exist. An empty table gives an empty result. A deviation beyond 63 bits (some ten
million distinct unit vectors) is null. Scaled entries of 2**31 or more are an error. Columns other
than id and vector are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docplan.llm.common import modest_batches, written
from docplan.llm.vectors import id_type, vectors, whole

#: Bunch and Parlett's bound: a single pivot is taken if it is this large against the largest entry.
_PIVOT = (1 + 17**0.5) / 8


def above(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric matrix lie above the shift: the positive pivots of LDL^T."""
    m = a - shift * np.eye(len(a))
    count = 0
    while len(m):
        size = np.abs(m)
        diagonal = size.diagonal()
        r = int(diagonal.argmax())
        p, q = divmod(int(size.argmax()), len(m))
        if size[p, q] == 0:
            break
        pivots = [r] if diagonal[r] >= _PIVOT * size[p, q] else [p, q]
        rest = np.setdiff1d(np.arange(len(m)), pivots)
        block, side = m[np.ix_(pivots, pivots)], m[np.ix_(rest, pivots)]
        if len(pivots) == 1:
            count += block[0, 0] > 0
        else:  # an indefinite block: one eigenvalue of either sign
            count += 1
        m = m[np.ix_(rest, rest)] - side @ np.linalg.solve(block, side.T)
    return int(count)


def _iterate(a: np.ndarray, start: float, found: list[np.ndarray], lo: float, hi: float, tiny: float) -> tuple[float, np.ndarray, float] | None:
    """Rayleigh quotient iteration from `start`: value, vector and residual; none if it leaves lo..hi."""

    def clean(v: np.ndarray) -> np.ndarray:
        for _ in range(2):
            for f in found:
                v = v - (f @ v) * f
        return v / np.linalg.norm(v)

    def solved(shift: float, v: np.ndarray) -> np.ndarray:
        try:
            w = np.linalg.solve(a - shift * np.eye(len(a)), v)
        except np.linalg.LinAlgError:
            w = np.linalg.solve(a - (shift + tiny) * np.eye(len(a)), v)
        return w if np.isfinite(w).all() else v

    v = clean(np.random.default_rng(len(found)).normal(size=len(a)))
    for _ in range(2):
        v = clean(solved(start, v))
    value, best = float(v @ a @ v), None
    for _ in range(30):
        left = float(np.linalg.norm(a @ v - value * v))
        if best is None or left < best[2]:
            best = (value, v, left)
        elif left >= best[2] and best[2] <= 64 * tiny:
            break
        v = clean(solved(value, v))
        value = float(v @ a @ v)
    value, v, left = best
    return best if lo - tiny <= value <= hi + tiny and left <= 4096 * tiny else None


def leading(a: np.ndarray, wanted: int) -> tuple[list[float], list[np.ndarray]]:
    """The largest eigenvalues above zero, falling, and their unit vectors."""
    reach = np.abs(a).sum(axis=1)
    top = float((a.diagonal() + reach - np.abs(a.diagonal())).max()) if len(a) else 0.0
    scale = float(reach.max()) if len(a) else 0.0
    if scale == 0:
        return [], []
    tiny = scale * np.finfo(float).eps
    floor = tiny * 8 * len(a)  # below this a variance is rounding
    counts = {floor: above(a, floor), top + floor: 0}
    values: list[float] = []
    found: list[np.ndarray] = []
    for j in range(1, min(wanted, counts[floor]) + 1):
        while True:
            lo = max(s for s, n in counts.items() if n >= j)
            hi = min(s for s, n in counts.items() if n < j)
            alone = counts[lo] == j and counts[hi] == j - 1
            narrow = hi - lo <= 4 * tiny * len(a)
            if alone or narrow:
                near = _iterate(a, (lo + hi) / 2, found, lo, hi, tiny * len(a))
                if near is not None:
                    value, v, left = near
                    margin = 2 * left + 4 * tiny * len(a)
                    if narrow or (above(a, value + margin) <= j - 1 and above(a, value - margin) >= j):
                        break
                elif narrow:
                    raise ArithmeticError("an isolated eigenvalue was not reached")
            middle = (lo + hi) / 2
            if not lo < middle < hi:
                raise ArithmeticError("an eigenvalue could not be isolated")
            counts[middle] = above(a, middle)
        values.append(value)
        found.append(v)
    return values, found


def _packed(df: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """id and the scaled integers, 4 bytes each, of every row with a non-empty finite vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, lengths, fine = whole(batch.column(1))
            fine &= lengths > 0
            x = np.floor(scale * flat[np.repeat(fine, lengths)]) + 0.0
            if len(x) and np.abs(x).max() >= 2.0**31:
                raise ValueError("a scaled entry reaches 2**31")
            ends = np.concatenate([[0], np.cumsum(lengths[fine])]).astype(np.int32)
            data = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(4 * ends), pa.py_buffer(x.astype("<i4"))])
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(fine)), data], ["id", "x"])

    return vectors(df, vec_id, vector).mapInArrow(run, f"id {id_type(df, vec_id)}, x binary")


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, dims).astype(np.int64)


def _summed(df: DataFrame, parts: Callable[[np.ndarray], np.ndarray], dims: int, kind: str) -> np.ndarray:
    """The sum, over all rows x, of the matrices that `parts` makes of batches: tasks add up rows of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = parts(_matrix(batch.column(0), dims))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(list(total))], ["i", "row"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in zip(batch.column(0).to_pylist(), batch.column(1)):
                row = row.values.to_numpy()
                held[i] = held[i] + row if i in held else row
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(list(held.values()))], ["i", "row"])

    schema = f"i int, row array<{kind}>"
    rows = df.select("x").mapInArrow(run, schema).repartition("i").mapInArrow(add, schema).collect()  # dims rows at most
    return np.array([r.row for r in sorted(rows, key=lambda r: r.i)])


def whitened(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = 4, scale: int = 256) -> DataFrame:
    """id, component, n, deviation, whitened, explained and identity_error of every row and component."""
    modest_batches(df.sparkSession)
    rows = written(_packed(df, vec_id, vector, scale))
    schema = (f"`{vec_id}` {id_type(df, vec_id)}, component int, n bigint, deviation bigint, whitened double, "
              "explained double, identity_error double")
    common = rows.groupBy(F.length("x").alias("bytes")).count().orderBy(F.desc("count"), F.desc("bytes")).limit(1).collect()
    if not common:
        return df.sparkSession.createDataFrame([], schema)
    dims = common[0]["bytes"] // 4
    rows = rows.where(F.length("x") == 4 * dims)
    fit = written(rows.select("x").groupBy("x").agg(F.lit(1).alias("one")).select("x"))
    # the sums of components and, as the last entry, the number of vectors
    sums = _summed(fit, lambda x: np.append(x.sum(axis=0), len(x))[None, :], dims, "bigint")[0]
    n, s = int(sums[-1]), sums[:-1].astype(np.int64)

    def centred(x: np.ndarray) -> np.ndarray:
        """x - s / n, rounded once where n * x fits 63 bits."""
        if n * (int(np.abs(x).max()) + 1) + int(np.abs(s).max()) < 1 << 62:
            return (n * x - s) / n
        return x - s / n

    def products(x: np.ndarray) -> np.ndarray:
        y = centred(x)
        return y.T @ y

    covariance = _summed(fit, products, dims, "double") / n
    covariance = (covariance + covariance.T) / 2
    values, found = leading(covariance, min(components, dims))
    k = len(values)
    if not k:
        return df.sparkSession.createDataFrame([], schema)
    ahead = np.array(found).T / np.sqrt(values)

    def spread(x: np.ndarray) -> np.ndarray:
        z = centred(x) @ ahead
        return np.vstack([z.T @ z, z.sum(axis=0)])

    seen = _summed(fit, spread, dims, "double") / n
    error = float(np.abs(seen[:k] - np.outer(seen[k], seen[k]) - np.eye(k)).max())
    explained = np.array(values) / float(np.trace(covariance))

    def deviations(x: np.ndarray) -> list[int | None]:
        largest = n * int(np.abs(x).max()) + int(np.abs(s).max())
        if dims * largest * largest < 1 << 63:
            t = n * x - s
            return (t * t).sum(axis=1).tolist()
        exact = ((n * x.astype(object) - s.astype(object)) ** 2).sum(axis=1).tolist()
        return [v if v < 1 << 63 else None for v in exact]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), dims)
            z = centred(x) @ ahead
            at = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, n)),
                 pa.array(deviations(x), pa.int64()).take(at), pa.array(z.ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(x) * k, error))],
                [vec_id, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("id", "x").mapInArrow(project, schema)
