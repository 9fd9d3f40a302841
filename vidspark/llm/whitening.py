"""Whitening of vectors by their leading principal components, found with a block Jacobi-Davidson method.

Entries become integers x = floor(1024 c) + 100000. The covariance V of x is never formed: what the method needs of it is
V times a few vectors, and that is one pass over the table in which each task adds up Z'(Z W) for its centred rows Z and
Spark adds up the tasks. Outside the products there are only matrices of size x basis.

One round: Rayleigh-Ritz in the current subspace; Ritz pairs whose residual has reached double precision are locked from
the largest down; for each of the others MINRES steps solve the projected correction equation
(I - QQ')(V - theta I)(I - QQ') t = -r, all pairs sharing each pass; the corrections widen the subspace. A full subspace
shrinks to its leading Ritz vectors. A pair is locked when its residual is below PRECISION times the largest eigenvalue
times the machine's precision times sqrt(size); the locked pairs' residuals are measured once more by a product of their own.

Rows are packed once into blocks of integers in the shared folder, so that a pass reads binary columns only; they follow
the input, everything on the driver follows the size of a vector.

Defined results: vectors that are null or have null or non-finite entries go, shorter ones than the longest too. x is held
to +-2^53. deviation is exact, and null where it exceeds a long. With fewer positive eigenvalues than components (fewer
entries, equal rows, one row) the others, at or below the rounding of the trace, have a null whitened, explained 0 and no
part in identity_error; that is null if there is none. Repeated rows count as often as they stand there; equal eigenvalues
come in either order. Null ids stay. Other columns are left out. An empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidspark.llm.common import batch_of, materialize
from vidspark.llm.vectors import blocks, embeddings, finite_vectors, scaled_floor

SCALE, OFFSET, COMPONENTS = 1024.0, 100_000, 8
LIMIT = 1 << 53
#: Starting vectors beyond the wanted ones; MINRES steps of a correction; basis vectors a wanted one; rounds at most.
GUARD, INNER, BASIS, ROUNDS = 8, 3, 10, 200
PRECISION = 16.0
EPS = float(np.finfo(np.float64).eps)

PACKED = pa.schema([("ids", pa.list_(pa.int64())), ("n", pa.int64()), ("wide", pa.bool_()), ("data", pa.binary())])
TOTALS = pa.schema([("at", pa.int32()), ("total", pa.string()), ("most", pa.int64())])
PRODUCT = pa.schema([("at", pa.int32()), ("product", pa.list_(pa.float64()))])
WHITE = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("deviation", pa.int64()), ("whitened", pa.float64())])


def packed(vectors: DataFrame, size: int) -> DataFrame:
    """Blocks of rows: ids, and floor(SCALE * entry) row by row as int32, or as int64 where that is too narrow."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, values in blocks(batches, "vector", size):
            whole = scaled_floor(values, SCALE, LIMIT)
            wide = bool(len(whole)) and int(np.abs(whole).max()) >= 1 << 31
            yield batch_of(PACKED, [[batch.column(0).to_pylist()], [len(whole)], [wide],
                                    [whole.astype("<i8" if wide else "<i4").tobytes()]])

    return vectors.select("vec_id", "vector").mapInArrow(pack, "ids array<long>, n long, wide boolean, data binary")


def _unpacked(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list, np.ndarray]]:
    for batch in batches:
        at = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        for i in range(batch.num_rows):
            data = np.frombuffer(at["data"][i].as_buffer(), "<i8" if at["wide"][i].as_py() else "<i4")
            yield (at["ids"][i] if "ids" in at else None), data.reshape(-1, size)


def totals(table: DataFrame, size: int) -> tuple[int, list[int], int]:
    """Rows, exact sums of each entry, and the largest magnitude."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, most = [0] * size, 0
        for _, block in _unpacked(batches, size):
            high, low = block.astype(np.int64) >> 26, block & ((1 << 26) - 1)  # no sum of a block leaves a long
            sums = [s + (int(h) << 26) + int(lo) for s, h, lo in zip(sums, high.sum(axis=0), low.sum(axis=0, dtype=np.int64))]
            most = max(most, int(np.abs(block.astype(np.int64)).max(initial=0)))
        yield batch_of(TOTALS, [list(range(size)), [str(s) for s in sums], [most] * size])

    rows = table.agg(F.sum("n")).first()[0]
    found = table.select("wide", "data").mapInArrow(add, "at int, total string, most long").groupBy("at").agg(
        F.sum(F.col("total").cast("decimal(38,0)")).cast("string").alias("total"), F.max("most").alias("most")).collect()
    by_place = {r["at"]: r for r in found}  # one row an entry of a vector
    return rows, [int(by_place[j]["total"]) for j in range(size)], max(r["most"] for r in found)


def _summed(table: DataFrame, size: int, height: int, of_block: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all blocks of a matrix of so many rows; one pass."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, block in _unpacked(batches, size):
            part = of_block(block.astype(np.float64))
            total = part if total is None else total + part
        if total is not None:
            yield batch_of(PRODUCT, [np.arange(height, dtype=np.int32), total.tolist()])

    found = table.select("wide", "data").mapInArrow(add, "at int, product array<double>")
    width = len(of_block(np.zeros((1, size)))[0])
    rows = found.groupBy("at").agg(F.array(*[F.sum(F.get("product", F.lit(i))) for i in range(width)]).alias("p")).collect()
    out = np.zeros((height, width))
    for r in rows:
        out[r["at"]] = r["p"]
    return out


def _orthonormal(new: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what new adds to the bases; directions that add nothing but rounding are left out."""
    for _ in range(3):
        norms = np.linalg.norm(new, axis=0)
        new = new[:, norms > 0] / norms[norms > 0]
        before = new.copy()
        for b in bases:
            new = new - b @ (b.T @ new)
        left = np.linalg.norm(new, axis=0) > 1e-10 * np.maximum(np.linalg.norm(before, axis=0), EPS)
        if not left.any():
            return new[:, :0]
        u, s, _ = np.linalg.svd(new[:, left], full_matrices=False)
        new = u[:, s > 1e-10 * s[0]]
    return new


def _corrections(product, theta: np.ndarray, residual: np.ndarray, known: np.ndarray, steps: int) -> np.ndarray:
    """MINRES on (I - KK')(V - theta I)(I - KK') t = -residual, one column a pair; each step is one product."""
    def off(w):
        w = w - known @ (known.T @ w)
        return w - known @ (known.T @ w)

    v = off(-residual)
    beta_first = np.linalg.norm(v, axis=0)
    safe = lambda x: np.where(x > 0, x, 1.0)
    v, v_old = v / safe(beta_first), np.zeros_like(v)
    t, w, w_old = np.zeros_like(v), np.zeros_like(v), np.zeros_like(v)
    m = v.shape[1]
    beta, eta = np.zeros(m), beta_first.copy()
    cos, cos_old, sin, sin_old = np.ones(m), np.ones(m), np.zeros(m), np.zeros(m)
    live = beta_first > 0
    for _ in range(steps):
        if not live.any():
            break
        u = np.zeros_like(v)
        u[:, live] = off(product(v[:, live]) - v[:, live] * theta[live])
        alpha = (u * v).sum(axis=0)
        u = off(u - alpha * v - beta * v_old)
        beta_new = np.linalg.norm(u, axis=0)
        delta = cos * alpha - cos_old * sin * beta
        rho = np.hypot(delta, beta_new)
        live &= rho > EPS * np.abs(theta)
        second, third = sin * alpha + cos_old * cos * beta, sin_old * beta
        w_new = np.where(live, (v - third * w_old - second * w) / safe(rho), 0.0)
        cos_old, sin_old, cos, sin = cos, sin, delta / safe(rho), beta_new / safe(rho)
        t = t + np.where(live, cos * eta * w_new, 0.0)
        eta = -sin * eta
        w_old, w, v_old = w, w_new, v
        live &= (beta_new > EPS * np.abs(theta)) & (np.abs(eta) > 1e-3 * beta_first)
        v, beta = u / safe(beta_new), beta_new
    return t


@dataclass
class Eigen:
    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    products: int


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], size: int, wanted: int, seed: int = 7,
                    inner: int = INNER) -> Eigen:
    """The largest eigenpairs of a symmetric, positive semidefinite operator given by its product with a matrix."""
    wanted, calls = min(wanted, size), 0

    def times(w):
        nonlocal calls
        calls += 1
        return product(w)

    basis = _orthonormal(np.random.default_rng(seed).standard_normal((size, min(size, wanted + GUARD))))
    image = times(basis)
    locked, values = np.zeros((size, 0)), np.zeros(0)
    most = min(size, BASIS * wanted)
    for _ in range(ROUNDS):
        small = basis.T @ image
        theta, inside = np.linalg.eigh((small + small.T) / 2)
        theta, inside = theta[::-1], inside[:, ::-1]
        basis, image = basis @ inside, image @ inside
        open_ = min(wanted - locked.shape[1], basis.shape[1])
        residual = image[:, :open_] - basis[:, :open_] * theta[:open_]
        residual = residual - locked @ (locked.T @ residual)
        norms = np.linalg.norm(residual, axis=0)
        bound = PRECISION * EPS * np.sqrt(size) * max([*values, theta[0], 0.0])
        done = int(np.argmin(np.append(norms <= bound, False)))
        if done:
            locked, values = np.hstack([locked, basis[:, :done]]), np.append(values, theta[:done])
            basis, image, theta = basis[:, done:], image[:, done:], theta[done:]
            residual = residual[:, done:]
            open_ -= done
        if locked.shape[1] == wanted or not basis.shape[1]:
            # a pair found late may be larger than one locked before: order, and go on if the rest still rises above
            if not basis.shape[1] or theta[0] <= values.min() + bound:
                break
        if not open_:  # what rises above the least locked pair goes on as an open one
            worst = int(values.argmin())
            back = locked[:, worst:worst + 1]
            locked, values = np.delete(locked, worst, axis=1), np.delete(values, worst)
            basis, image = np.hstack([basis, back]), np.hstack([image, times(back)])
            continue
        if basis.shape[1] + open_ > most - locked.shape[1] and basis.shape[1] + locked.shape[1] < size:
            keep = min(basis.shape[1], open_ + GUARD)
            basis, image, theta = basis[:, :keep], image[:, :keep], theta[:keep]
        known = np.hstack([locked, basis[:, :open_]])
        steps = inner if size > known.shape[1] else 0
        new = _corrections(times, theta[:open_], residual, known, steps) if steps else residual
        new = _orthonormal(new, locked, basis)
        if not new.shape[1]:  # corrections within the subspace: any other direction will do
            if basis.shape[1] + locked.shape[1] >= size:
                new = basis[:, :0]
            else:
                fresh = np.random.default_rng(seed + calls).standard_normal((size, open_))
                new = _orthonormal(fresh, locked, basis)[:, :size - basis.shape[1] - locked.shape[1]]
        if new.shape[1]:
            basis, image = np.hstack([basis, new]), np.hstack([image, times(new)])
        else:  # the whole space is in the basis, so its pairs are as exact as doubles are
            take = wanted - locked.shape[1]
            locked, values = np.hstack([locked, basis[:, :take]]), np.append(values, theta[:take])
            break
    else:
        raise RuntimeError(f"{locked.shape[1]} of {wanted} eigenpairs after {ROUNDS} rounds")
    order = np.argsort(-values, kind="stable")
    vectors = _orthonormal_in_order(locked[:, order])
    image = times(vectors)
    values = (vectors * image).sum(axis=0)
    return Eigen(values, vectors, np.linalg.norm(image - vectors * values, axis=0), calls)


def _orthonormal_in_order(columns: np.ndarray) -> np.ndarray:
    q, r = np.linalg.qr(columns)
    return q * np.sign(np.where(np.diag(r) == 0, 1.0, np.diag(r)))


@dataclass
class Whitening:
    """A fitted whitening: whitened = (x - mean) @ directions; ``rows`` blocks the vectors it was fitted on."""
    table: DataFrame
    n: int
    sums: list[int]
    most: int
    trace: float
    eigen: Eigen
    positive: np.ndarray
    directions: np.ndarray
    identity_error: float | None


def fitted(rows: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", vector: str = "embedding") -> Whitening | None:
    """Fits to every vector that counts; None if there is none."""
    plain = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    plain, size = finite_vectors(plain, "vector")
    if not size:
        return None
    table = materialize(packed(plain, size), "blocks")
    n, sums, most = totals(table, size)
    mean = np.array([s // n + (s % n) / n for s in sums])
    trace = float(_summed(table, size, 1, lambda b: ((b - mean) ** 2).sum(keepdims=True))[0, 0]) / n

    def product(w: np.ndarray) -> np.ndarray:
        def of_block(b):
            centred = b - mean
            return centred.T @ (centred @ w)
        return _summed(table, size, size, of_block) / n

    eigen = jacobi_davidson(product, size, components)
    positive = eigen.values > size * EPS * trace
    directions = eigen.vectors / np.sqrt(np.where(positive, eigen.values, 1.0))
    real = directions[:, positive]
    error = None
    if positive.any():
        white = lambda b: (b - mean) @ real
        centre = _summed(table, size, 1, lambda b: white(b).sum(axis=0, keepdims=True))[0] / n

        def spread(b):
            w = white(b) - centre
            return w.T @ w
        covariance = _summed(table, size, real.shape[1], spread) / n
        error = float(np.abs(covariance - np.eye(real.shape[1])).max())
    return Whitening(table, n, sums, most, trace, eigen, positive, directions, error)


def whitened(model: Whitening) -> DataFrame:
    """(vec_id, component, deviation, whitened) of every vector the whitening was fitted on."""
    n, sums, size = model.n, model.sums, len(model.sums)
    mean = np.array([s // n + (s % n) / n for s in sums])
    directions, positive = model.directions, model.positive
    fits = size * (n * model.most + max(map(abs, sums))) ** 2 < 1 << 63
    count = directions.shape[1]

    def white(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact = np.array(sums, np.int64 if fits else object)
        for ids, block in _unpacked(batches, size):
            off = n * block.astype(np.int64 if fits else object) - exact
            far = (off * off).sum(axis=1)
            deviation = far.tolist() if fits else [x if x < 1 << 63 else None for x in far]
            values = (block.astype(np.float64) - mean) @ directions
            rows = len(block)
            yield batch_of(WHITE, [
                ids.values.take(pa.array(np.repeat(np.arange(rows), count))),
                np.tile(np.arange(1, count + 1, dtype=np.int32), rows), np.repeat(np.array(deviation, object), count),
                pa.array(values.ravel(), pa.float64(), mask=np.tile(~positive, rows))])

    return model.table.select("ids", "wide", "data").mapInArrow(
        white, "vec_id long, component int, deviation long, whitened double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = fitted(embeddings(spark, sf_dir))
    if model is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, "
                                         "explained double, identity_error double")
    share = np.where(model.positive, model.eigen.values / (model.trace or 1.0), 0.0)
    shares = F.array(*[F.lit(float(x)) for x in share])
    return whitened(model).select(
        "vec_id", "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("component") - 1).alias("explained"),
        F.lit(model.identity_error).cast("double").alias("identity_error"))
