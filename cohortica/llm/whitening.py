"""Embedding whitening by Jacobi-Davidson (operator 13).

Entries become integers ``x = floor(256 * c)``; every distinct vector counts once (the fit list).
The covariance is never formed: the solver only asks for products ``V @ W`` with a few columns.
Each product is one Spark job over the fit list: tasks centre their vectors, multiply, and Spark
adds the partial sums by dimension. What the driver holds is dimensions x subspace, whatever the
number of vectors.

Solver: a block of Ritz pairs of a search space (Rayleigh-Ritz); for all that have not converged,
the correction equations, projected against locked vectors and the block, are solved together by
MINRES, so a step of all of them is one job; the corrections enter the search space. A pair is
locked when the residual of a fresh product is within ``TOLERANCE`` of the largest eigenvalue.

Centring: the mean is a whole part and a fraction; the whole part is subtracted in integers, so a
centred entry is rounded once.

Rows whose vector is null or holds a null or non-finite entry are dropped, and so are those with
an entry of 2**45 or more, which have no exact integer. A shorter vector is filled up with
zeros to the longest one. Repeated rows and rows without an id are all returned. Components
without variance (all vectors equal, fewer vectors than components) are not returned; an empty
table gives an empty result. Equal eigenvalues have any orthonormal basis. Deviations are exact, and null
from 2**95. Texts do not occur here; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F, types as T

from cohortica.llm.common import kept

BLOCK_BYTES = 1 << 20
SCALE = 256
BOUND = 2.0**53
TOLERANCE = 64 * np.finfo(float).eps
GUARD = 8                     # Ritz pairs improved besides the wanted ones: more columns a product, fewer products
SPACE = 40                    # columns of the search space before a restart
INNER_STEPS = 4
OUTER_STEPS = 200


def usable(vector: Column) -> Column:
    """Whether all entries are there, finite and within exact integers."""
    return F.coalesce(F.forall(vector, lambda c: F.abs(c.cast("double") * SCALE) < BOUND), F.lit(False))


def integers(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of usable vectors as a matrix of ``floor(256 * c)``, short ones filled up with 0."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = np.floor(flat * SCALE).astype(np.int64)
    sizes = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    if np.all(sizes == dims):
        return x.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = x
    return out


@dataclass
class Mean:
    """``sums / n`` as whole part and fraction."""
    n: int
    sums: list[int]
    whole: np.ndarray = field(init=False)
    part: np.ndarray = field(init=False)

    def __post_init__(self):
        self.whole = np.array([s // self.n for s in self.sums], np.int64)
        self.part = np.array([(s % self.n) / self.n for s in self.sums])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.part

    def deviations(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact sum of ``(n * x - sums)**2`` of every row, in multiples of 2**32 and the rest; None from 2**95."""
        most = int(np.abs(x).max(initial=0)) * self.n + max((abs(s) for s in self.sums), default=0)
        if most * most * max(x.shape[1], 1) < 2**63:
            a = x * np.int64(self.n) - np.array(self.sums, np.int64)
            total = np.einsum("ij,ij->i", a, a)
        else:
            a = x.astype(object) * self.n - np.array(self.sums, object)
            total = (a * a).sum(axis=1)
            if total.max(initial=0) >= 2**95:
                none = total >= 2**95
                return np.where(none, None, total >> 32), np.where(none, None, total & 0xFFFFFFFF)
        return (total >> 32).astype(np.int64), (total & 0xFFFFFFFF).astype(np.int64)


@dataclass
class Whitening:
    mean: Mean | None
    dims: int
    values: np.ndarray            # eigenvalues, falling
    vectors: np.ndarray           # dims x components, unit columns
    explained: np.ndarray
    identity_error: float = 0.0
    residuals: np.ndarray | None = None
    products: int = 0


def fit_list(rows: DataFrame, dims: int) -> DataFrame:
    """Every distinct integer vector once, packed into blocks of little-endian 64-bit rows."""
    def pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = integers(batch.column(0), dims).astype("<i8")
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary())], ["x"])

    def pack_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for x in batch.column(0).to_pylist():
                held.append(x)
                size += len(x)
                if size >= BLOCK_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["block"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["block"])

    distinct = rows.mapInArrow(pack_rows, "x binary").distinct()
    return kept(distinct.mapInArrow(pack_blocks, "block binary"), "vectors")


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for block in batch.column(0).to_pylist():
            yield np.frombuffer(block, "<i8").reshape(-1, dims)


def totals(blocks: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of vectors, and their exact sum by dimension."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for x in _blocks(batches, dims):
            n += len(x)
            high += (x >> 26).sum(axis=0)
            low += (x & (2**26 - 1)).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([-1, *range(dims)], pa.int32()), pa.array([0, *high.tolist()], pa.int64()),
                                              pa.array([n, *low.tolist()], pa.int64())], ["dim", "high", "low"])

    found = blocks.mapInArrow(part, "dim int, high bigint, low bigint").groupBy("dim").agg(
        F.sum(F.col("high").cast("decimal(30,0)")).alias("high"), F.sum("low").alias("low")).collect()
    sums = {r["dim"]: int(r["high"]) * 2**26 + r["low"] for r in found}
    return sums.get(-1, 0), [sums.get(i, 0) for i in range(dims)]


def summed(blocks: DataFrame, dims: int, mean: Mean, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """Sum over all blocks of ``part(centred vectors)``, a small matrix; one job, added up by its rows."""
    rows, columns = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(shape)
        for x in _blocks(batches, dims):
            out += part(mean.centred(x))
        yield pa.RecordBatch.from_arrays([pa.array(range(rows), pa.int32()), *[pa.array(c) for c in out.T]],
                                         ["at", *[f"v{j}" for j in range(columns)]])

    schema = T.StructType([T.StructField("at", T.IntegerType()), *[T.StructField(f"v{j}", T.DoubleType()) for j in range(columns)]])
    out = np.zeros(shape)
    for row in blocks.mapInArrow(run, schema).groupBy("at").agg(*[F.sum(f"v{j}").alias(f"v{j}") for j in range(columns)]).collect():
        out[row[0]] = row[1:]
    return out


# ---- the solver ------------------------------------------------------------------------------

def _orthonormal(new: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span what ``new`` adds to the bases; none for what adds nothing."""
    base = np.hstack(bases)
    out = np.zeros((len(new), 0))
    for v in new.T:
        size = np.linalg.norm(v)
        for _ in range(3):
            v = v - base @ (base.T @ v)
            v = v - out @ (out.T @ v)
        if size > 0 and np.linalg.norm(v) > 1e-10 * size:
            out = np.column_stack([out, v / np.linalg.norm(v)])
    return out


def minres(apply: Callable[[np.ndarray], np.ndarray], shift: np.ndarray, rhs: np.ndarray, steps: int, rtol: float) -> np.ndarray:
    """Columns of ``(A - shift)**-1 rhs`` for a symmetric ``apply``, all columns in step: one product a step."""
    x, older_w, old_w, old_v = (np.zeros_like(rhs) for _ in range(4))
    beta = np.linalg.norm(rhs, axis=0)
    safe = lambda b: np.where(b > 0, b, 1.0)
    v, eta, goal = rhs / safe(beta), beta.copy(), rtol * beta
    old_c = c = np.ones_like(beta)
    old_s = s = np.zeros_like(beta)
    for _ in range(steps):
        if np.all(np.abs(eta) <= goal):
            break
        q = apply(v) - v * shift
        alpha = (v * q).sum(axis=0)
        q = q - alpha * v - beta * old_v
        next_beta = np.linalg.norm(q, axis=0)
        delta = c * alpha - old_c * s * beta
        r1, r2, r3 = safe(np.hypot(delta, next_beta)), s * alpha + old_c * c * beta, old_s * beta
        old_c, old_s, c, s = c, s, delta / r1, next_beta / r1
        w = (v - r3 * older_w - r2 * old_w) / r1
        x = x + c * eta * w
        eta = -s * eta
        older_w, old_w, old_v, v, beta = old_w, w, v, q / safe(next_beta), next_beta
    return x


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], dims: int, want: int, seed: int = 13) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``want`` largest eigenvalues (falling), unit eigenvectors and residual norms of a symmetric operator."""
    rng = np.random.default_rng(seed)
    want = min(want, dims)
    locked, values, residuals = np.zeros((dims, 0)), [], []
    space = _orthonormal(rng.standard_normal((dims, min(dims, want + GUARD))), locked)
    image = product(space)
    largest = 0.0
    for step in range(OUTER_STEPS):
        gram = space.T @ image
        theta, s = np.linalg.eigh((gram + gram.T) / 2)
        theta, s = theta[::-1], s[:, ::-1]
        largest = max([largest, abs(theta[0]), *values])
        left = want - locked.shape[1]
        block = min(left + GUARD, space.shape[1])                   # guards share the products and widen the space
        ritz, mapped = space @ s[:, :block], image @ s[:, :block]
        error = mapped - ritz * theta[:block]
        error -= locked @ (locked.T @ error)
        size = np.linalg.norm(error, axis=0)
        whole = space.shape[1] + locked.shape[1] == dims
        ready = size <= TOLERANCE * largest
        if ready[:left].any() or whole:
            found = ritz[:, :left]
            fresh = product(found)                                  # residuals count only from a fresh product
            now = (found * fresh).sum(axis=0)
            true = np.linalg.norm(fresh - found * now, axis=0)
            done = np.flatnonzero(true <= (16 if whole else 1) * TOLERANCE * largest)
            if len(done):
                locked = np.column_stack([locked, found[:, done]])
                values += now[done].tolist()
                residuals += true[done].tolist()
                if locked.shape[1] >= want:
                    break
                rest = np.delete(np.arange(space.shape[1]), done)   # the search space gives up what is locked
                space, image = space @ s[:, rest], image @ s[:, rest]
                space = space - locked @ (locked.T @ space)
                continue
            if whole:                                               # nothing left to add: work on the rounding
                space, image = _orthonormal(space @ s, locked), np.zeros((dims, 0))
                image = product(space)
                continue
        if space.shape[1] + block > min(SPACE, dims):
            keep = min(2 * (want + GUARD), SPACE // 2, space.shape[1])
            space, image = space @ s[:, :keep], image @ s[:, :keep]
        open_ = np.flatnonzero(~ready) if (~ready).any() else np.arange(block)
        basis = np.column_stack([locked, ritz])
        project = lambda v: v - basis @ (basis.T @ v)  # noqa: B023,E731
        rhs = -project(error[:, open_])
        fix = minres(lambda v: project(product(v)), theta[open_], rhs, INNER_STEPS, max(1e-3, 0.3 * 0.5**step))  # noqa: B023
        new = _orthonormal(project(fix), locked, space)
        if not new.shape[1]:
            new = _orthonormal(rng.standard_normal((dims, 1)), locked, space)
        space, image = np.column_stack([space, new]), np.column_stack([image, product(new)])
    else:
        raise RuntimeError(f"residuals above double precision after {OUTER_STEPS} steps: {size}")
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], locked[:, order], np.array(residuals)[order]


# ---- fit and apply ---------------------------------------------------------------------------

def fit_whitening(rows: DataFrame, vector_col: str = "embedding", components: int = 4, seed: int = 13) -> Whitening:
    """Mean and leading components of the distinct integer vectors of ``rows``."""
    given = rows.select(F.col(f"`{vector_col}`").alias("vector")).where(usable(F.col("vector")))
    dims = given.agg(F.max(F.size("vector"))).first()[0] or 0
    none = Whitening(None, dims, np.zeros(0), np.zeros((dims, 0)), np.zeros(0))
    if not dims:
        return none
    blocks = fit_list(given, dims).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n, sums = totals(blocks, dims)
        mean = Mean(n, sums)
        calls = [0]

        def product(w: np.ndarray) -> np.ndarray:
            calls[0] += 1
            return summed(blocks, dims, mean, lambda c: c.T @ (c @ w), w.shape) / n

        trace = summed(blocks, dims, mean, lambda c: np.array([[np.einsum("ij,ij->", c, c)]]), (1, 1))[0, 0] / n
        if trace == 0:
            return none
        values, vectors, residuals = jacobi_davidson(product, dims, components, seed)
        real = values > 64 * dims * np.finfo(float).eps * values[0]
        values, vectors, residuals = values[real], vectors[:, real], residuals[real]
        weights = vectors / np.sqrt(values)
        k = len(values)
        middle = summed(blocks, dims, mean, lambda c: (c @ weights).sum(axis=0)[None], (1, k))[0] / n

        def spread(c: np.ndarray) -> np.ndarray:
            y = c @ weights - middle
            return y.T @ y

        error = np.abs(summed(blocks, dims, mean, spread, (k, k)) / n - np.eye(k)).max()
        return Whitening(mean, dims, values, vectors, values / trace, float(error), residuals, calls[0])
    finally:
        blocks.unpersist()


def whiten(rows: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id, component, n, deviation, whitened, explained, identity_error`` of every usable row and component."""
    given = rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("vector")).where(usable(F.col("vector")))
    k, mean, dims = len(model.values), model.mean, model.dims
    weights = model.vectors / np.sqrt(model.values)
    kind = given.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not (batch.num_rows and k):
                continue
            x = integers(batch.column(1), dims)
            high, low = (pa.array(np.repeat(v, k), pa.int64()) for v in mean.deviations(x))
            repeat = pa.array(np.repeat(np.arange(batch.num_rows), k))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(repeat), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), high, low,
                 pa.array((mean.centred(x) @ weights).ravel())], ["id", "component", "high", "low", "whitened"])

    schema = T.StructType([T.StructField("id", kind), T.StructField("component", T.IntegerType()),
                           T.StructField("high", T.LongType()), T.StructField("low", T.LongType()),
                           T.StructField("whitened", T.DoubleType())])
    share = F.lit(0.0) if not k else F.element_at(F.array(*[F.lit(float(e)) for e in model.explained]), F.col("component"))
    return given.mapInArrow(run, schema).select(
        F.col("id").alias(id_col), "component", F.lit(mean.n if mean else 0).cast("long").alias("n"),
        (F.col("high").cast("decimal(20,0)") * F.lit(2**32).cast("decimal(10,0)") + F.col("low").cast("decimal(20,0)"))
        .cast("decimal(38,0)").alias("deviation"),
        "whitened", share.alias("explained"), F.lit(model.identity_error).alias("identity_error"))


def op13_jacobi_davidson_whitening(spark, sf_dir: str) -> DataFrame:
    """``deviation`` is null where it leaves a long; ``deviation_exact`` has it in any case."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    out = whiten(rows, fit_whitening(rows))
    return out.withColumn("deviation_exact", F.col("deviation").cast("string")).withColumn(
        "deviation", F.expr("try_cast(deviation AS BIGINT)"))
