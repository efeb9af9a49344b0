"""Hazard models on unit risk intervals.

Likelihood sums are dense blocks by tenure, summed in the tasks and merged by a tree; only
coefficient-sized matrices reach the driver. A design has tens of columns, whatever the
number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from cohortica.functions.features import known_category
from cohortica.functions.ordered import BLOCK, range_count
from cohortica.operators.contracts import count_if
from cohortica.operators.encoding import category_vocabulary
from cohortica.spec import DEFAULT, PanelSpec

CLOGLOG_RIDGE = 1e-6
COX_RIDGE = 1e-4


@dataclass(frozen=True)
class Design:
    """Training means, scales and category levels of a one-hot design (P20)."""

    numeric: tuple[tuple[str, float, float], ...]
    dummies: tuple[tuple[str, str, float, float], ...]

    @property
    def names(self) -> list[str]:
        return [n for n, _, _ in self.numeric] + [f"{c}_{v}" for c, v, _, _ in self.dummies]

    def columns(self) -> list[Column]:
        """Standardised columns; an unseen level is all zeros before scaling."""
        out = [(F.col(c).cast("double") - F.lit(m)) / F.lit(s) for c, m, s in self.numeric]
        out += [((known_category(c) == F.lit(v)).cast("double") - F.lit(m)) / F.lit(s)
                for c, v, m, s in self.dummies]
        return out

    def array(self) -> Column:
        return F.array(*self.columns())


def fit_design(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> Design:
    """Learn the design from training rows only: one aggregate for all means and scales.

    The first sorted level of each category is the reference. The level list is
    the size of the vocabulary and is read on the driver.
    """
    levels = [(r["column"], r["value"]) for r in category_vocabulary(train, categorical)
              .where(F.col("code") > 0).orderBy("column", "code").collect()] if categorical else []
    exprs = {c: F.col(c).cast("double") for c in numeric}
    exprs |= {f"{c}={v}": (known_category(c) == F.lit(v)).cast("double") for c, v in levels}
    row = train.agg(*[x for name, e in exprs.items() for x in (
        F.avg(e).alias(f"m:{name}"), F.stddev_pop(e).alias(f"s:{name}"))]).first()
    stats = {name: (row[f"m:{name}"], row[f"s:{name}"]) for name in exprs}
    return Design(
        tuple((c, *stats[c]) for c in numeric if stats[c][1] > 0),
        tuple((c, v, *stats[f"{c}={v}"]) for c, v in levels if stats[f"{c}={v}"][1] > 0))


def risk_audit(train: DataFrame, valid: DataFrame, label: str = "objetivo") -> DataFrame:
    """Risk rows, events, censored entities, validation rows beyond the longest tenure."""
    a = train.agg(F.count(F.lit(1)).alias("risk_rows"), F.sum(label).alias("events"),
                  count_if(F.col("censored_last_observation")).alias("censored"),
                  F.max("stop").alias("_longest"))
    return valid.crossJoin(F.broadcast(a.select("_longest"))).agg(
        count_if(F.col("stop") > F.col("_longest")).alias("beyond_tenure")).crossJoin(a.drop("_longest"))


def hazard_by_tenure(intervals: DataFrame, label: str = "objetivo") -> DataFrame:
    """Rows at risk, events and raw hazard per tenure."""
    return intervals.groupBy("stop").agg(
        F.count(F.lit(1)).alias("at_risk"), F.sum(label).alias("events"), F.avg(label).alias("hazard"))


# ---- dense sums by tenure ----------------------------------------------------------------------

# A state is one vector of sums for one tenure; these merge two states of it.
_Merge = Callable[[np.ndarray, np.ndarray], np.ndarray]


def keyed_sums(rows: DataFrame, states: Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray]]], merge: _Merge,
               parts: int) -> dict[int, np.ndarray]:
    """Merged states by key; ``states`` gives keys and states of a batch of ``rows``, which have ``parts`` partitions.

    A task keeps one state a key, whatever its rows; states merge by key, those of more
    than ``BLOCK`` tasks in blocks first. The driver gets one state a key.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, state in states(batch):
                held[key] = merge(held[key], state) if key in held else state
        block = TaskContext.get().partitionId() // BLOCK
        yield pa.RecordBatch.from_arrays(
            [pa.array([block] * len(held), pa.int32()), pa.array(list(held), pa.int32()),
             pa.array([v.tobytes() for v in held.values()], pa.binary())], ["block", "key", "state"])

    def merged(table: pa.Table) -> pa.Table:
        state = reduce(merge, [np.frombuffer(v.as_buffer()) for v in table["state"]])
        return pa.table({"block": pa.array([0], pa.int32()), "key": table["key"].slice(0, 1), "state": pa.array([state.tobytes()], pa.binary())})

    schema = "block int, key int, state binary"
    found = rows.mapInArrow(scan, schema)
    for keys in ([["block", "key"]] if parts > BLOCK else []) + [["key"]]:
        found = found.groupBy(*keys).applyInArrow(merged, schema)
    return {r["key"]: np.frombuffer(bytes(r["state"])) for r in found.collect()}


@dataclass(frozen=True)
class Packed:
    """Blocks ``(n, x, y, stop)`` of rows in tenure order, each column one byte string, and the number of partitions.

    They are kept on the executors' disks: a pass reads them once, in order, and the fits of several cuts
    run side by side, so in memory they would take all that an executor has.
    """

    blocks: DataFrame
    parts: int

    def unpersist(self) -> None:
        self.blocks.unpersist()


_PART = 1 << 25               # bytes of packed rows a task reads


def packed(rows: DataFrame) -> Packed:
    """``rows`` (``x`` array, ``y``, ``stop``) in blocks, so that a pass reads them without converting values."""
    typed = rows.select("x", F.col("y").cast("double"), F.col("stop").cast("int"))
    n, width = typed.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    parts = max(range_count(rows), -(-n * (8 * (width or 0) + 12) // _PART))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = [batch.column(0).flatten(), batch.column(1), batch.column(2)]
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int32()), *[
                    pa.array([v.to_numpy(zero_copy_only=False).tobytes()], pa.binary()) for v in values]], ["n", "x", "y", "stop"])

    spread = typed.repartition(parts, F.xxhash64("x", "stop", "y")).sortWithinPartitions("stop")
    return Packed(spread.mapInArrow(pack, "n int, x binary, y binary, stop binary").persist(StorageLevel.DISK_ONLY), parts)


def tenure_sums(rows: DataFrame | Packed, part: Callable[[np.ndarray, np.ndarray, int], np.ndarray], merge: _Merge) -> dict[int, np.ndarray]:
    """Merged states by tenure of ``rows`` (``x`` array, ``y``, ``stop``), ``part(x, y, stop)`` for a piece of one tenure."""
    def pieces(x: np.ndarray, y: np.ndarray, stop: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        order = np.argsort(stop, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(stop[order])) + 1):
            tenure = int(stop[at[0]])
            yield tenure, part(x[at], y[at], tenure)

    def states(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        if batch.num_rows:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            yield from pieces(x, *(batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2)))

    def block_states(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        for row in range(batch.num_rows):
            x, y, stop = (np.frombuffer(batch.column(1 + i)[row].as_buffer(), t) for i, t in enumerate(("<f8", "<f8", "<i4")))
            yield from pieces(x.reshape(len(y), -1), y, stop)

    if isinstance(rows, Packed):
        return keyed_sums(rows.blocks, block_states, merge, rows.parts)
    typed = rows.select("x", F.col("y").cast("double"), F.col("stop").cast("int"))
    return keyed_sums(typed, states, merge, rows.rdd.getNumPartitions())


def newton_steps(beta: np.ndarray, max_iter: int, tolerance: float) -> Generator[np.ndarray, tuple, np.ndarray]:
    """Newton's method with step halving: yields points, is sent their loss, gradient and solved step, returns the optimum."""
    loss, grad, step = yield beta
    for _ in range(max_iter):
        if np.abs(grad).max(initial=0.0) < tolerance:
            return beta
        scale = 1.0
        while True:
            trial = beta - scale * step
            t_loss, t_grad, t_step = yield trial
            if t_loss <= loss + 1e-12 or scale < 1e-4:
                break
            scale /= 2
        beta, loss, grad, step = trial, t_loss, t_grad, t_step
    if np.abs(grad).max(initial=0.0) < tolerance * 1000:
        return beta
    raise RuntimeError("the hazard fit did not converge")


def newton(evaluate: Callable, beta: np.ndarray, max_iter: int, tolerance: float) -> np.ndarray:
    """Newton's method; ``evaluate`` gives loss, gradient and the solved step."""
    steps = newton_steps(beta, max_iter, tolerance)
    point = next(steps)
    while True:
        try:
            point = steps.send(evaluate(point))
        except StopIteration as end:
            return end.value


# ---- discrete hazard -----------------------------------------------------------------------------

@dataclass(frozen=True)
class CloglogFit:
    """Complementary log-log hazard: intercept, covariate coefficients, one effect for each tenure after the first."""

    intercept: float
    beta: np.ndarray
    tenure: np.ndarray
    longest: int

    @property
    def coefficients(self) -> np.ndarray:
        return np.r_[self.beta, self.tenure]


def cloglog_newton(rows: DataFrame | Packed, longest: int, d: int, ridge: float = CLOGLOG_RIDGE, max_iter: int = 60,
                   tolerance: float = 1e-9) -> CloglogFit:
    """Newton fit of mean loss plus ``ridge / 2`` of all squared coefficients but the intercept (M6).

    Tenure effects touch only their own rows, so the Hessian has a diagonal block for them;
    they are eliminated and the solved system has the size of the covariates, not of the tenures.
    """
    def evaluate(theta: np.ndarray):
        tenure = np.r_[0.0, theta[1 + d:]]

        def part(x: np.ndarray, y: np.ndarray, stop: int) -> np.ndarray:
            h = np.exp(np.clip(theta[0] + tenure[stop - 1] + x @ theta[1:1 + d], -40, 40))
            miss = -np.expm1(-h)                                        # probability of the event
            slope = np.where(h < 50, h / np.expm1(np.minimum(h, 50)), 0.0)
            u = np.where(y == 1, -slope, h)
            v = np.where(y == 1, slope * (h / miss - 1), h)
            loss = np.where(y == 1, -np.log(np.maximum(miss, 1e-300)), h).sum()
            return np.concatenate([[len(y), loss, u.sum(), v.sum()], u @ x, v @ x, ((x * v[:, None]).T @ x).ravel()])

        sums = tenure_sums(rows, part, np.add)
        total = sum(sums.values())
        n, width = total[0], d + 1
        grad, dense = np.zeros(len(theta)), np.zeros((width, width))
        grad[0], grad[1:width] = total[2], total[4:4 + d]
        dense[0, 0], dense[0, 1:], dense[1:, 0] = total[3], total[4 + d:4 + 2 * d], total[4 + d:4 + 2 * d]
        dense[1:, 1:] = total[4 + 2 * d:].reshape(d, d)
        cross, diagonal = np.zeros((longest - 1, width)), np.zeros(longest - 1)
        for stop, v in sums.items():
            if stop > 1:
                grad[width + stop - 2], diagonal[stop - 2] = v[2], v[3]
                cross[stop - 2] = v[3:4 + 2 * d][np.r_[0, 1 + d:1 + 2 * d]]
        penalty = np.r_[0.0, theta[1:]]
        grad, dense, cross, diagonal = grad / n + ridge * penalty, dense / n, cross / n, diagonal / n + ridge
        dense[np.arange(1, width), np.arange(1, width)] += ridge
        schur = dense - (cross / diagonal[:, None]).T @ cross
        head = np.linalg.solve(schur, grad[:width] - cross.T @ (grad[width:] / diagonal))
        tail = (grad[width:] - cross @ head) / diagonal
        return total[1] / n + 0.5 * ridge * float(penalty @ penalty), grad, np.r_[head, tail]

    theta = newton(evaluate, np.zeros(d + longest), max_iter, tolerance)
    return CloglogFit(float(theta[0]), theta[1:1 + d], theta[1 + d:], longest)


def fit_cloglog(intervals: DataFrame, design: Design, label: str = "objetivo", max_iter: int = 60) -> tuple[CloglogFit, int]:
    """Discrete hazard with a complementary log-log link and an effect for each tenure (M6)."""
    longest = intervals.agg(F.max("stop")).first()[0]
    rows = _design_rows(intervals, design, label)
    try:
        return cloglog_newton(rows, longest, len(design.names), max_iter=max_iter), longest
    finally:
        rows.unpersist()


def _design_rows(intervals: DataFrame, design: Design, label: str) -> Packed:
    rows = intervals.select(design.array().alias("x"), F.col(label).cast("double").alias("y"), "stop").persist(StorageLevel.DISK_ONLY)
    try:
        out = packed(rows)
        out.blocks.count()                                              # the blocks are kept before their rows go
        return out
    finally:
        rows.unpersist()


# ---- Cox -----------------------------------------------------------------------------------------

def _cox_merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of shifted weights: the smaller shift is scaled down, so no exponential overflows."""
    shift = max(a[0], b[0])
    out = a[1:] * np.exp(a[0] - shift) + b[1:] * np.exp(b[0] - shift)
    out[:2] = a[1:3] + b[1:3]                                           # events and their predictors are not weights
    d = _cox_width(len(a))
    out[3 + d:3 + 2 * d] = a[4 + d:4 + 2 * d] + b[4 + d:4 + 2 * d]
    return np.r_[shift, out]


def _cox_width(size: int) -> int:
    """d of a state of ``4 + 2 d + d * d`` numbers."""
    return int(round((size - 3) ** 0.5)) - 1


def cox_loss_gradient(rows: DataFrame | Packed, beta: np.ndarray, ridge: float = COX_RIDGE):
    """Breslow partial likelihood per event, gradient and Hessian.

    ``rows`` has ``x`` (array), ``y`` and ``stop``. On unit intervals the risk set of a time
    is the rows that stop there. A state holds the largest predictor of its tenure, events,
    their summed predictor, and the summed weights, weighted x, x of events, weighted x x'.
    """
    d = len(beta)

    def part(x: np.ndarray, y: np.ndarray, stop: int) -> np.ndarray:
        eta = x @ beta
        e = np.exp(eta - eta.max())
        return np.concatenate([[eta.max(), y.sum(), y @ eta, e.sum()], e @ x, y @ x, ((x * e[:, None]).T @ x).ravel()])

    loss, grad, hess, events = 0.0, np.zeros(d), np.zeros((d, d)), 0.0
    for v in tenure_sums(rows, part, _cox_merge).values():
        if v[1] > 0:
            mean, second = v[4:4 + d] / v[3], v[4 + 2 * d:].reshape(d, d) / v[3]
            loss += v[1] * (v[0] + np.log(v[3])) - v[2]
            grad += v[1] * mean - v[4 + d:4 + 2 * d]
            hess += v[1] * (second - np.outer(mean, mean))
            events += v[1]
    if not events:
        raise ValueError("a Cox fit needs an event")
    loss = loss / events + 0.5 * ridge * float(beta @ beta)
    return loss, grad / events + ridge * beta, hess / events + ridge * np.eye(d)


def fit_cox(intervals: DataFrame, design: Design, label: str = "objetivo", max_iter: int = 30,
            tolerance: float = 1e-9, ridge: float = COX_RIDGE) -> np.ndarray:
    """Newton's method on the start-stop Cox likelihood with Breslow ties (M7)."""
    rows = _design_rows(intervals, design, label)

    def evaluate(beta: np.ndarray):
        loss, grad, hess = cox_loss_gradient(rows, beta, ridge)
        return loss, grad, np.linalg.solve(hess, grad)

    try:
        return newton(evaluate, np.zeros(len(design.names)), max_iter, tolerance)
    finally:
        rows.unpersist()


def breslow_increments(scored: DataFrame, risk: str, label: str = "objetivo") -> DataFrame:
    """Baseline hazard increment per tenure: events over the summed risk (M8)."""
    return scored.groupBy("stop").agg(
        F.try_divide(F.sum(F.col(label)).cast("double"), F.sum(risk)).alias("increment"))


def cox_probability(valid: DataFrame, increments: DataFrame, risk: str, out: str = "probability") -> DataFrame:
    """Event probability of the next interval; longer tenures use the last increment (M8)."""
    longest = increments.agg(F.max("stop").alias("_longest"))
    rows = valid.crossJoin(F.broadcast(longest)).withColumn("_t", F.least("stop", "_longest"))
    table = increments.select(F.col("stop").alias("_t"), "increment")
    return rows.join(table, "_t", "left").withColumn(
        out, -F.expm1(-F.coalesce("increment", F.lit(0.0)) * F.col(risk))).drop("_t", "_longest", "increment")


def _linear(design: Design, beta: np.ndarray) -> Column:
    return sum((c * F.lit(float(b)) for c, b in zip(design.columns(), beta)), F.lit(0.0))


def _clipped_exp(eta: Column) -> Column:
    return F.exp(F.greatest(F.least(eta, F.lit(40.0)), F.lit(-40.0)))


def cox_risk(design: Design, beta: np.ndarray) -> Column:
    """exp of the clipped linear predictor as a column."""
    return _clipped_exp(_linear(design, beta))


def cloglog_probability(design: Design, fit: CloglogFit) -> Column:
    """Event probability of an interval; tenures beyond the longest use its effect (M6)."""
    effects = F.array(*[F.lit(float(v)) for v in (0.0, *fit.tenure)])
    tenure = F.element_at(effects, F.least(F.col("stop"), F.lit(fit.longest)).cast("int"))
    return -F.expm1(-_clipped_exp(F.lit(fit.intercept) + tenure + _linear(design, fit.beta)))


def score_cox(train: DataFrame, valid: DataFrame, numeric: Sequence[str], categorical: Sequence[str],
              spec: PanelSpec = DEFAULT) -> DataFrame:
    """Fit on the training intervals, score the validation intervals (M7, M8)."""
    design = fit_design(train, numeric, categorical)
    beta = fit_cox(train, design, spec.label)
    risk = cox_risk(design, beta)
    increments = breslow_increments(train.withColumn("_risk", risk), "_risk", spec.label)
    out = cox_probability(valid.withColumn("_risk", risk), increments, "_risk", spec.score)
    return out.select(*spec.keys, spec.label, spec.score)


def score_cloglog(train: DataFrame, valid: DataFrame, numeric: Sequence[str], categorical: Sequence[str],
                  spec: PanelSpec = DEFAULT) -> DataFrame:
    """Fit the discrete hazard on training intervals, score the validation intervals (M6)."""
    design = fit_design(train, numeric, categorical)
    fit, _ = fit_cloglog(train, design, spec.label)
    return valid.select(*spec.keys, spec.label, cloglog_probability(design, fit).alias(spec.score))
