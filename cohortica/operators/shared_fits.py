"""Many L2 logistic fits over the same rows in shared passes.

Rows are packed once: a block holds the numbers, category codes, label and training bits of some
thousand rows as byte strings. Every pass adds up loss, gradient and Hessian of all fits that have not
ended; a task keeps one small vector a fit, vectors merge by fit. So the number of passes is that of
the slowest fit, whatever the number of fits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from cohortica.functions.features import known_category
from cohortica.functions.ordered import range_count
from cohortica.operators.survival import keyed_sums, newton_steps

AT_ONCE = 60                  # fits of one pass: a bit each in a long
_PART = 1 << 25               # bytes of packed rows a task reads
_CELLS = 1 << 20              # numbers of a design held at once


@dataclass(frozen=True)
class Code:
    """One-hot column group: a category, the bins of a number, or their cross; the last place is for unseen levels."""

    levels: int
    category: int | None = None
    number: int | None = None
    edges: tuple[float, ...] = ()
    fill: float = 0.0

    def of(self, numbers: np.ndarray, categories: np.ndarray) -> np.ndarray:
        code = None if self.category is None else categories[:, self.category]
        if self.number is None:
            return code
        x = numbers[:, self.number]
        place = np.searchsorted(self.edges, np.where(np.isnan(x), self.fill, x), "right")
        if code is None:
            return place
        bins = len(self.edges) + 1
        return np.where(code < self.levels // bins, code * bins + place, self.levels)


@dataclass(frozen=True)
class SharedDesign:
    """Intercept, standardised ``numbers`` and one-hot ``codes``."""

    numbers: tuple[int, ...]
    codes: tuple[Code, ...]

    @property
    def width(self) -> int:
        return 1 + len(self.numbers) + sum(c.levels for c in self.codes)

    @property
    def dense(self) -> bool:
        return bool(self.numbers)

    def parts(self, numbers: np.ndarray, categories: np.ndarray, scaled: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        left = np.column_stack([np.ones(len(numbers)), scaled[:, list(self.numbers)]])
        codes = [c.of(numbers, categories) for c in self.codes]
        if not self.dense:
            return left, codes
        hot = []
        for c, code in zip(self.codes, codes):
            one = np.zeros((len(code), c.levels + 1))
            one[np.arange(len(code)), code] = 1.0
            hot.append(one[:, :-1])
        return np.hstack([left, *hot]), []

    def predictor(self, left: np.ndarray, codes: list[np.ndarray], beta: np.ndarray, exact_ties: bool = False) -> np.ndarray:
        """With ``exact_ties`` equal rows have equal values to the last bit; a matrix product rounds by position."""
        at = left.shape[1]
        if exact_ties:
            eta = np.zeros(len(left))
            for column, b in zip(left.T, beta):
                eta += column * b
        else:
            eta = left @ beta[:at]
        for c, code in zip(self.codes, codes):
            eta += np.append(beta[at:at + c.levels], 0.0)[code]
            at += c.levels
        return eta

    def sums(self, left: np.ndarray, codes: list[np.ndarray], y: np.ndarray, w: np.ndarray, beta: np.ndarray) -> np.ndarray:
        """Weight, loss, gradient and Hessian, flat."""
        eta = self.predictor(left, codes, beta)
        p = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
        loss = np.log1p(np.exp(-np.abs(eta))) + np.maximum(eta, 0) - y * eta
        rest, curve = w * (p - y), w * p * (1 - p)
        a = left.shape[1]
        grad, hess = np.zeros(self.width), np.zeros((self.width, self.width))
        grad[:a], hess[:a, :a] = rest @ left, (left * curve[:, None]).T @ left
        starts = a + np.cumsum([0, *[c.levels for c in self.codes]])
        for i, code in enumerate(codes):                               # ``left`` is the intercept here
            n, at = self.codes[i].levels, slice(starts[i], starts[i + 1])
            grad[at] = np.bincount(code, rest, n + 1)[:n]
            diagonal = np.bincount(code, curve, n + 1)[:n]
            hess[0, at] = hess[at, 0] = diagonal
            hess[np.arange(at.start, at.stop), np.arange(at.start, at.stop)] = diagonal
            for k in range(i):
                m, other = self.codes[k].levels, slice(starts[k], starts[k + 1])
                cross = np.bincount(code * (m + 1) + codes[k], curve, (n + 1) * (m + 1)).reshape(n + 1, m + 1)[:n, :m]
                hess[at, other], hess[other, at] = cross, cross.T
        return np.concatenate([[w.sum(), w @ loss], grad, hess.ravel()])


@dataclass(frozen=True)
class SharedFit:
    """Training rows, rows to score, weight and design of one fit; ``c`` is the inverse penalty."""

    train: Column
    valid: Column
    weight: Column | None
    design: SharedDesign
    c: float


@dataclass(frozen=True)
class Space:
    """Columns of the shared rows, centres and scales of the numbers, levels of the categories."""

    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    centre: np.ndarray
    scale: np.ndarray
    levels: tuple[tuple[str, ...], ...]

    def columns(self) -> list[Column]:
        return [F.array(*[F.col(c).cast("double") for c in self.numeric]).cast("array<double>").alias("_numbers"),
                *[known_category(c).alias(f"_category_{i}") for i, c in enumerate(self.categorical)]]

    def read(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and category codes of a batch that starts with ``columns``; an unseen level has the next free code."""
        numbers = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, len(self.numeric))
        codes = np.zeros((batch.num_rows, len(self.categorical)), np.int32)
        for i, words in enumerate(self.levels):
            found = pc.fill_null(pc.index_in(batch.column(1 + i), pa.array(words, batch.column(1 + i).type)), len(words))
            codes[:, i] = found.to_numpy(zero_copy_only=False)
        return numbers, codes


def _bits(conditions: Sequence[Column]) -> Column:
    total = F.lit(0).cast("long")
    for i, c in enumerate(conditions):
        total = total + F.when(c, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
    return total


def _packed(rows: DataFrame, fits: Sequence[SharedFit], space: Space, label: str, keys: Sequence[str], n: int) -> tuple[DataFrame, int]:
    """Blocks ``(n, numbers, codes, y, bits, weights)``, kept, and the number of their partitions."""
    weights = [f.weight for f in fits if f.weight is not None]
    k, c, d = len(space.numeric), len(space.categorical), len(weights)
    parts = max(range_count(rows), -(-n * (8 * k + 4 * c + 8 * d + 17) // _PART))
    bits = _bits([f.train for f in fits])
    chosen = rows.where(bits != 0).repartition(parts, *keys).select(
        *space.columns(), F.col(label).cast("double").alias("_y"), bits.alias("_bits"),
        F.array(*[w.cast("double") for w in weights]).cast("array<double>").alias("_weights"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                numbers, codes = space.read(batch)
                y, mask, w = (batch.column(1 + c + i) for i in range(3))
                y, mask = y.to_numpy(zero_copy_only=False), mask.to_numpy(zero_copy_only=False)
                w = w.flatten().to_numpy(zero_copy_only=False) if d else np.empty(0)
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int32()), *[
                    pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for v in (numbers, codes, y, mask, w)]],
                    ["n", "numbers", "codes", "y", "bits", "weights"])

    return chosen.mapInArrow(pack, "n int, numbers binary, codes binary, y binary, bits binary, weights binary").persist(), parts


def _passes(blocks: DataFrame, parts: int, fits: Sequence[SharedFit], space: Space, betas: dict[int, np.ndarray] | None) -> dict[int, np.ndarray]:
    """Sums of the fits in ``betas``; without it rows, events, and sums and squares of the scaled numbers of all fits."""
    designs = [f.design for f in fits]
    weighted = [i for i, f in enumerate(fits) if f.weight is not None]
    wanted = list(range(len(fits))) if betas is None else list(betas)
    step = max(1, _CELLS // max(d.width for d in designs))

    def states(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        for row in range(batch.num_rows):
            n = batch.column(0)[row].as_py()
            raw = [np.frombuffer(batch.column(1 + i)[row].as_buffer(), t) for i, t in enumerate(("<f8", "<i4", "<f8", "<i8", "<f8"))]
            numbers, codes = raw[0].reshape(n, -1), raw[1].reshape(n, -1)
            extra = raw[4].reshape(n, -1) if weighted else None
            for a in range(0, n, step):
                piece = slice(a, a + step)
                x, z, y, bits = numbers[piece], codes[piece], raw[2][piece], raw[3][piece]
                scaled = (x - space.centre) / space.scale
                made = {}
                for i in wanted:
                    at = np.flatnonzero((bits >> i) & 1)
                    if not len(at):
                        continue
                    design = designs[i]
                    if betas is None:
                        s = scaled[at][:, list(design.numbers)]
                        yield i, np.concatenate([[len(at), y[at].sum()], s.sum(axis=0), (s * s).sum(axis=0)])
                        continue
                    if design not in made:
                        made[design] = design.parts(x, z, scaled)
                    left, places = made[design]
                    w = extra[piece][at, weighted.index(i)] if i in weighted else np.ones(len(at))
                    yield i, design.sums(left[at], [p[at] for p in places], y[at], w, betas[i])

    return keyed_sums(blocks, states, np.add, parts)


def _evaluated(fit: SharedFit, sums: np.ndarray, beta: np.ndarray, free: np.ndarray, active: np.ndarray):
    d = len(beta)
    grad = sums[2:2 + d] / sums[0] + free * beta
    hess = sums[2 + d:].reshape(d, d) / sums[0] + np.diag(free)
    if not np.isfinite(grad[active]).all():
        raise ValueError("a number of a logistic fit is NULL or NaN")
    grad, step = np.where(active, grad, 0.0), np.zeros(d)
    step[active] = np.linalg.solve(hess[np.ix_(active, active)], grad[active])
    return sums[1] / sums[0] + 0.5 * float(free @ beta**2), grad, step


def fit_shared(rows: DataFrame, fits: Sequence[SharedFit], space: Space, label: str, keys: Sequence[str], n: int,
               max_iter: int = 60, tolerance: float = 1e-10) -> list[np.ndarray]:
    """Coefficients on the scaled columns of ``space``, penalised as coefficients on columns standardised over a fit's own rows.

    The penalty is 1 / (c n) for n training rows. Numbers without variance get 0; rows of a single class a certain prediction.
    """
    blocks, parts = _packed(rows, fits, space, label, keys, n)
    try:
        stats = _passes(blocks, parts, fits, space, None)
        found: list = [None] * len(fits)
        runs, penalties = {}, {}
        for i, fit in enumerate(fits):
            if i not in stats:
                raise ValueError("a logistic fit needs rows")
            d, k = fit.design.width, len(fit.design.numbers)
            count, events = stats[i][:2]
            if events in (0, count):
                found[i] = np.r_[np.inf if events else -np.inf, np.zeros(d - 1)]
                continue
            total, squares = stats[i][2:2 + k], stats[i][2 + k:]
            if not np.isfinite(squares).all():
                raise ValueError("a number of a logistic fit is NULL or NaN")
            variance = (squares - total**2 / count) / max(count - 1, 1)
            varies = variance > 1e-12 * (1 + (total / count)**2)
            ridge = 1 / (fit.c * count)
            penalties[i] = (np.r_[0.0, ridge * np.where(varies, variance, 0.0), np.full(d - 1 - k, ridge)],
                            np.r_[True, varies, np.full(d - 1 - k, True)])
            runs[i] = newton_steps(np.zeros(d), max_iter, tolerance)
        asked = {i: next(run) for i, run in runs.items()}
        while asked:
            sums = _passes(blocks, parts, fits, space, asked)
            for i, beta in list(asked.items()):
                try:
                    asked[i] = runs[i].send(_evaluated(fits[i], sums[i], beta, *penalties[i]))
                except StopIteration as end:
                    found[i] = end.value
                    del asked[i]
        return found
    finally:
        blocks.unpersist()


def score_shared(rows: DataFrame, fits: Sequence[SharedFit], betas: Sequence[np.ndarray], space: Space, keep: Sequence[str],
                 out: str) -> DataFrame:
    """``keep``, ``_job`` (position of the fit) and the probability, one row a fit and row it scores."""
    designs, at = [f.design for f in fits], 1 + len(space.categorical)
    bits = _bits([f.valid for f in fits])
    chosen = rows.where(bits != 0).select(*space.columns(), bits.alias("_bits"), *keep)
    step = max(1, _CELLS // max(d.width for d in designs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, step):
                batch = whole.slice(a, step)
                numbers, codes = space.read(batch)
                scaled = (numbers - space.centre) / space.scale
                mask = batch.column(at).to_numpy(zero_copy_only=False)
                made = {}
                for i, design in enumerate(designs):
                    rows_of = np.flatnonzero((mask >> i) & 1)
                    if not len(rows_of):
                        continue
                    if design not in made:
                        made[design] = design.parts(numbers, codes, scaled)
                    left, places = made[design]
                    eta = design.predictor(left[rows_of], [p[rows_of] for p in places], betas[i], True)
                    if np.isnan(eta).any():
                        raise ValueError("a number of a row to score is NULL or NaN")
                    with np.errstate(over="ignore"):
                        p = 1 / (1 + np.exp(-eta))
                    take = pa.array(rows_of)
                    yield pa.RecordBatch.from_arrays(
                        [*[batch.column(at + 1 + j).take(take) for j in range(len(keep))],
                         pa.array(np.full(len(rows_of), i, np.int32)), pa.array(p)], [*keep, "_job", out])

    schema = T.StructType([*[rows.schema[c] for c in keep], T.StructField("_job", T.IntegerType()), T.StructField(out, T.DoubleType())])
    return chosen.mapInArrow(run, schema)
