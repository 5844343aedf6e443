"""Operator 11: embeddings whitened along their principal components, found by matrix-free block Lanczos."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS, BLOCK, SEED = 32, 16, 42
#: Residuals of this share of the largest eigenvalue are rounding; eigenvalues below FLOOR of it can't be told from none.
TOLERANCE, FLOOR = 2e-14, 1e-12
#: Partial sums that reach the driver, whatever the number of tasks.
REDUCERS = 8
LONG, FAR = 1 << 63, float(1 << 61)


@dataclass
class Fit:
    """n vectors, their exact sums a dimension, eigenvectors (columns) by falling eigenvalue, and the trace of the covariance."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float = 0.0
    identity_error: float = 0.0

    @property
    def base(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        """What the mean is above ``base``: kept apart, as the mean itself has too few digits."""
        return np.array([(s % self.n) / self.n for s in self.sums])


def entries(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x) of the rows whose vector has entries, all of them finite; the entries as longs, those beyond 2^61 as that."""
    v = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    whole = v.where("size(v) > 0 and forall(v, c -> c is not null and not isnan(c) and abs(c) < double('infinity'))")
    return whole.select("id", F.expr(f"transform(v, c -> floor(greatest(-{FAR}D, least({FAR}D, {SCALE}D * c))) + {SHIFT}L)").alias("x"))


def matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return np.asarray(batch.column("x").flatten(), np.int64).reshape(-1, width)


def total(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...], width: int) -> np.ndarray:
    """The sum of ``part`` over all rows: each task adds up its own, a few add up theirs, and those few reach the driver."""

    def run(batches):
        out = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                out += part(matrix(batch, width))
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()])], names=["part"])

    def add(batches):
        out = np.zeros(shape)
        for batch in batches:
            for x in batch.column("part"):
                out += np.frombuffer(x.as_py()).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()])], names=["part"])

    parts = rows.select("x").mapInArrow(run, "part binary").repartition(REDUCERS).mapInArrow(add, "part binary").collect()
    return sum((np.frombuffer(p.part).reshape(shape) for p in parts), np.zeros(shape))


def orthogonal(w: np.ndarray, basis: np.ndarray, least: float) -> np.ndarray:
    """An orthonormal base of what the columns of ``w`` have beyond ``basis``, but for directions of ``least`` or less."""
    for _ in range(2):
        w = w - basis @ (basis.T @ w)
    u, s, _ = np.linalg.svd(w, full_matrices=False)
    u = u[:, s > least]
    if u.shape[1]:
        u = u - basis @ (basis.T @ u)
        u, _ = np.linalg.qr(u)
    return u


def lanczos(apply: Callable[[np.ndarray], np.ndarray], width: int, components: int, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues and their eigenvectors of a symmetric matrix that is only known by what it makes of a block.

    Every block is made orthogonal to the whole basis twice.  Directions that break down give way to random ones.  The
    residuals of the wanted pairs end a phase; as a block finds no more copies of an eigenvalue than it has columns, a
    second phase of as many blocks starts from random directions and must leave the wanted values as they are.  A basis
    that fills the space needs no second phase.
    """
    rng = np.random.default_rng(SEED)
    basis, images = np.zeros((width, 0)), np.zeros((width, 0))
    fresh = lambda n: orthogonal(rng.standard_normal((width, n)), basis, 1e-8)
    v, taken, left, before = fresh(min(block, width)), 0, 0, None
    while True:
        basis, images = np.hstack([basis, v]), np.hstack([images, apply(v)])
        taken += 1
        small = basis.T @ images
        values, y = np.linalg.eigh((small + small.T) / 2)
        values, y = values[::-1][:components], y[:, ::-1][:, :components]
        vectors = basis @ y
        scale = max(abs(values[0]), np.finfo(float).tiny)
        room = width - basis.shape[1]
        if not room:
            return values, vectors
        residual = np.linalg.norm(images @ y - vectors * values, axis=0).max()
        left -= 1
        v = orthogonal(images[:, -v.shape[1] :], basis, TOLERANCE * scale)[:, :room]
        if len(values) == components and residual <= TOLERANCE * scale * np.sqrt(width) and left <= 0:
            if before is not None and np.abs(values - before).max() <= 1e-10 * scale:
                return values, vectors
            before, left, taken, v = values, taken, 0, v[:, :0]
        if v.shape[1] < min(block, room):
            v = np.hstack([v, orthogonal(rng.standard_normal((width, min(block, room) - v.shape[1])), np.hstack([basis, v]), 1e-8)])


def deviations(x: np.ndarray, n: int, sums: list[int], base: np.ndarray) -> list[int]:
    """For each row the sum of (n * x - S)^2, exactly."""
    rest = [s - n * int(b) for s, b in zip(sums, base)]
    y = x - base
    most = float(np.abs(y.astype(np.float64)).max()) if y.size else 0.0
    if ((most + 1) * n) ** 2 * x.shape[1] < 2**62:
        return ((n * y - np.array(rest, np.int64)) ** 2).sum(1).tolist()
    return [sum((n * (a - b) - r) ** 2 for a, b, r in zip(row, base.tolist(), rest)) for row in x.tolist()]


def fit(rows: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """The components of the vectors ``x`` of ``rows``, all of one width; None without rows or without variance."""
    sums = {r.pos: r for r in rows.select(F.posexplode("x")).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).collect()}
    if not sums:
        return None
    width, n = len(sums), sums[0].n
    found = Fit(n, [int(sums[i].s) for i in range(width)], np.zeros((width, 0)), np.zeros(0))
    base, rest, exact = found.base, found.rest, found.sums

    def spread(batches):
        out = 0
        for batch in batches:
            out += sum(deviations(matrix(batch, width), n, exact, base))
        yield pa.RecordBatch.from_arrays([pa.array([str(out)])], names=["part"])

    parts = rows.select("x").mapInArrow(spread, "part string").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("s")).first()
    if not parts.s:
        return None
    found.trace = int(parts.s) / n**3

    def apply(v: np.ndarray) -> np.ndarray:
        def part(x):
            y = (x - base) - rest
            return y.T @ (y @ v)

        return total(rows, part, v.shape, width) / n

    values, vectors = lanczos(apply, width, min(components, width))
    kept = values > FLOOR * values[0]
    found.values, found.vectors = values[kept], vectors[:, kept]
    scaled = found.vectors / np.sqrt(found.values)
    k = len(found.values)
    mean = total(rows, lambda x: (((x - base) - rest) @ scaled).sum(0), (k,), width) / n

    def products(x):
        z = ((x - base) - rest) @ scaled - mean
        return z.T @ z

    found.identity_error = float(np.abs(total(rows, products, (k, k), width) / n - np.eye(k)).max())
    return found


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, n, deviation, whitened, explained, identity_error): each row's vector along the components, scaled to unit variance.

    ``whitened`` and ``explained`` hold a number a component, by falling eigenvalue; ``deviation`` is the exact sum of
    squares of n * x - S over the dimensions, null beyond the range of a long.  Rows whose vector is null, empty or
    holds null or non-finite entries go, and so do those of vectors shorter than the longest, which lack entries.
    Rows without an id stay; repeated rows count and come back as often.  Directions without variance are no
    components: vectors that are all equal, one vector, and an empty table give no rows.  Other columns don't matter.

    All rows take part in every pass over the data; a pass sends a block of vectors to the tasks and a few sums of
    that size back, so that the driver holds no more than the width of a vector times that of the basis.
    """
    spark = df.sparkSession
    clean = stored(entries(df, id_col, vector_col))
    schema = "id " + dict(clean.dtypes)["id"] + ", n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    width = clean.agg(F.max(F.size("x"))).first()[0]
    rows = clean.where(F.size("x") == width) if width else clean
    found = fit(rows, components) if width else None
    if found is None:
        return spark.createDataFrame([], schema)
    base, rest, n, sums = found.base, found.rest, found.n, found.sums
    scaled, shares, error = found.vectors / np.sqrt(found.values), found.values / found.trace, found.identity_error
    k = len(shares)

    def run(batches):
        for batch in batches:
            x = matrix(batch, width)
            z = ((x - base) - rest) @ scaled
            rows = len(x)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * k), pa.array(v)) for v in (z.ravel(), np.tile(shares, rows))]
            far = [d if d < LONG else None for d in deviations(x, n, sums, base)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([n] * rows, pa.int64()), pa.array(far, pa.int64()), *lists, pa.array([error] * rows)],
                names=["id", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema)
