"""Bootstrap replicates in packed form: rows are never multiplied by replicates or models.

An entity carries the weights of all replicates as one byte string. Rows join it once, are
range-partitioned by score, and every range is scanned once for all replicates: what a range
knows of its ordered pairs is a small state per replicate, and states of neighbouring ranges
merge. Merging goes through blocks of ranges, so no task ever sees more than a block of states.
Ties may span ranges, so one hot score does not fill a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from cohortica.functions.ordered import BLOCK, range_count, row_numbers
from cohortica.operators.metrics import checked_label, checked_score
from cohortica.spec import DEFAULT, PanelSpec

# Replicate number of the unweighted point estimates in a bootstrap table.
OBSERVED = -1

# Cumulative Poisson(1) probabilities up to 16; beyond that the mass is below 1e-14.
_POISSON_STEPS = 17

_DRAW = np.dtype("<u4")       # cell of a draw in its block: offset * replicates + replicate
_POSITIONS = 1024             # positions whose draws are counted together
_HELD_DRAWS = 1 << 20         # draws a task holds before it passes them on, eight bytes each
_ROWS = 128                   # rows drawn or weighted at once


def _draws(seed: int, replicates: range, texts: Sequence[str]) -> np.ndarray:
    """48-bit hash draws, one row a text: the same numbers as ``hash_int(seed, replicate, text)``."""
    heads = [f"{seed}|{r}|".encode() for r in replicates]
    raw = b"".join([md5(head + tail).digest()[:8] for tail in (str(t).encode() for t in texts) for head in heads])
    return (np.frombuffer(raw, ">u8") >> np.uint64(16)).astype(np.int64).reshape(len(texts), len(heads))


def poisson_limits() -> np.ndarray:
    """Distribution function of Poisson(1) at 0, 1, ...; a draw is the number of limits not above a uniform."""
    total, term, out = 0.0, 2.718281828459045 ** -1, []
    for k in range(_POISSON_STEPS):
        total += term
        out.append(total)
        term /= k + 1
    return np.array(out)


def _bytes(weights: np.ndarray) -> pa.Array:
    if weights.max(initial=0) > 255:
        raise ValueError("an entity was drawn more than 255 times in one replicate")
    return pa.array([w.tobytes() for w in weights.astype(np.uint8)], pa.binary())


def _poisson_weights(entities: DataFrame, replicates: range, seed: int, entity: str) -> DataFrame:
    limits = poisson_limits()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                uniform = _draws(seed, replicates, part.column(1).to_pylist()) / 2.0**48
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), _bytes(np.searchsorted(limits, uniform, "right"))], ["entity", "weights"])

    schema = T.StructType([T.StructField("entity", entities.schema[entity].dataType), T.StructField("weights", T.BinaryType())])
    return entities.select(entity, F.col(entity).cast("string").alias("_text")).mapInArrow(run, schema).withColumnRenamed("entity", entity)


def _multinomial_weights(entities: DataFrame, replicates: range, seed: int, entity: str) -> DataFrame:
    placed = row_numbers(entities, [], [entity], "_pos").withColumn("_pos", F.col("_pos") - 1)
    size = entities.count()
    width = len(replicates)

    if _POSITIONS * width > 1 << 32:
        raise ValueError(f"at most {(1 << 32) // _POSITIONS} replicates can be drawn at once")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = np.empty(max(_HELD_DRAWS, _ROWS * width), np.int64), 0
        replicates_at = np.arange(width)

        def packs(draws: np.ndarray) -> pa.RecordBatch:
            draws.sort()
            blocks = draws >> 32
            starts = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]])
            cells = draws.astype(_DRAW)                                  # the low half
            return pa.RecordBatch.from_arrays(
                [pa.array(blocks[starts]), pa.array([c.tobytes() for c in np.split(cells, starts[1:])], pa.binary())], ["block", "pack"])

        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                hit = _draws(seed, replicates, batch.column(0).slice(at, _ROWS).to_pylist()) % size
                if count + hit.size > held.size:
                    yield packs(held[:count])
                    count = 0
                held[count:count + hit.size] = ((hit // _POSITIONS << 32) + (hit % _POSITIONS) * width + replicates_at).ravel()
                count += hit.size
        if count:
            yield packs(held[:count])

    def total(table: pa.Table) -> pa.Table:
        draws = np.concatenate([np.frombuffer(pack.as_buffer(), _DRAW) for pack in table["pack"]])
        cells = np.bincount(draws, minlength=_POSITIONS * width)
        first = table["block"][0].as_py() * _POSITIONS
        there = min(_POSITIONS, size - first)
        return pa.table({"_pos": pa.array(np.arange(first, first + there)),
                         "weights": _bytes(cells.reshape(_POSITIONS, width)[:there])})

    packed = placed.select("_pos").mapInArrow(draw, "block bigint, pack binary")
    counted = packed.groupBy("block").applyInArrow(total, "_pos bigint, weights binary")
    return counted.join(placed, "_pos").select(entity, "weights")


def packed_weights(df: DataFrame, replicates: int, seed: int, scheme: str = "multinomial", first: int = 0,
                   spec: PanelSpec = DEFAULT) -> DataFrame:
    """``(entity, weights)``: one byte a replicate, from replicate ``first`` on.

    ``poisson`` draws every weight from a hash of the replicate and the entity, where the
    entity is; nothing moves. ``multinomial`` draws exactly N of N entities: each position
    makes one draw a replicate; draws move in packs of four bytes and are counted by blocks
    of positions.
    """
    entities = df.select(spec.entity).distinct()
    span = range(first, first + replicates)
    if scheme == "poisson":
        return _poisson_weights(entities, span, seed, spec.entity)
    if scheme != "multinomial":
        raise ValueError(f"unknown scheme {scheme}")
    return _multinomial_weights(entities, span, seed, spec.entity)


def unpacked(weights: DataFrame, first: int = 0, spec: PanelSpec = DEFAULT) -> DataFrame:
    """``(replicate, entity, weight)`` of all positive weights; for results, not for joins."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                cells = np.vstack([np.frombuffer(w.as_buffer(), np.uint8) for w in part.column(1)])
                row, replicate = np.nonzero(cells)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((replicate + first).astype(np.int32)), part.column(0).take(pa.array(row)),
                     pa.array(cells[row, replicate].astype(np.int32))], ["replicate", "entity", "weight"])

    schema = T.StructType([T.StructField("replicate", T.IntegerType()), T.StructField("entity", weights.schema[spec.entity].dataType),
                           T.StructField("weight", T.IntegerType())])
    return weights.select(spec.entity, "weights").mapInArrow(run, schema).withColumnRenamed("entity", spec.entity)


# ---- ordered pairs of all replicates -----------------------------------------------------------

@dataclass
class Ordered:
    """Ordered pairs (ties half) and class weights of rows in score order, and those of the first and last tie."""
    first: float
    last: float
    pairs: np.ndarray
    pos: np.ndarray
    neg: np.ndarray
    first_pos: np.ndarray
    first_neg: np.ndarray
    last_pos: np.ndarray
    last_neg: np.ndarray

    @classmethod
    def of(cls, score: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> Ordered:
        """Of sorted rows; ``pos`` and ``neg`` hold a row's weight in either class, one column a replicate."""
        new = np.flatnonzero(np.r_[True, score[1:] != score[:-1]])
        pos, neg = np.add.reduceat(pos, new, axis=0), np.add.reduceat(neg, new, axis=0)
        below = np.cumsum(neg, axis=0) - neg
        return cls(score[0], score[-1], (pos * (below + neg / 2)).sum(axis=0), pos.sum(axis=0), neg.sum(axis=0),
                   pos[0], neg[0], pos[-1], neg[-1])

    def then(self, after: Ordered) -> Ordered:
        pairs = self.pairs + after.pairs + after.pos * self.neg
        first, last = (self.first_pos, self.first_neg), (after.last_pos, after.last_neg)
        if self.last == after.first:                    # one tie on both sides: its pairs count half
            pairs = pairs + (self.last_pos * after.first_neg - after.first_pos * self.last_neg) / 2
            if self.first == self.last:
                first = (self.first_pos + after.first_pos, self.first_neg + after.first_neg)
            if after.first == after.last:
                last = (self.last_pos + after.last_pos, self.last_neg + after.last_neg)
        return Ordered(self.first, after.last, pairs, self.pos + after.pos, self.neg + after.neg, *first, *last)

    def pack(self) -> bytes:
        return np.concatenate([[self.first, self.last], self.pairs, self.pos, self.neg, self.first_pos, self.first_neg,
                               self.last_pos, self.last_neg]).tobytes()

    @classmethod
    def unpack(cls, raw: pa.Buffer) -> Ordered:
        values = np.frombuffer(raw, np.float64)
        return cls(values[0], values[1], *values[2:].reshape(7, -1))


def _runs(batch: pa.RecordBatch, keys: int) -> Iterator[tuple[int, int, tuple]]:
    """Runs of equal keys (the first columns) of a batch: start, length, key values."""
    change = np.zeros(batch.num_rows, bool)
    change[:1] = True
    for i in range(keys):
        codes = batch.column(i).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        change[1:] |= codes[1:] != codes[:-1]
    starts = np.flatnonzero(change)
    for a, z in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows]):
        yield a, z - a, tuple(batch.column(i)[a].as_py() for i in range(keys))


def ordered_states(ready: DataFrame, names: Sequence[str], n: int, split: Sequence[str],
                   weigh: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """``(names, state)``: the packed `Ordered` of every key, from one range partitioning by score.

    ``ready`` holds the keys ``names``, then ``_score``; ``weigh`` gives the class weights of a
    piece of a batch. ``split`` names further columns that part the rows of one tie.
    """
    names = list(names)
    kinds = [ready.schema[c] for c in names]
    rest = [c for c in ready.columns if c not in (*names, "_score")]
    ranged = ready.repartitionByRange(n, *names, "_score", *split).sortWithinPartitions(*names, "_score")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId()
        key, state = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([place], pa.int32()), *[pa.array([v], t) for v, t in zip(key, types)],
                 pa.array([state.pack()], pa.binary())], ["_place", *names, "state"])

        for batch in batches:
            types = [batch.schema.field(i).type for i in range(len(names))]
            values = batch.column(len(names)).to_numpy(zero_copy_only=False)
            for start, length, now in _runs(batch, len(names)):
                if state is not None and now != key:
                    yield row()
                    state = None
                key = now
                for a in range(start, start + length, _ROWS):
                    z = min(a + _ROWS, start + length)
                    part = Ordered.of(values[a:z], *weigh(batch.slice(a, z - a)))
                    state = part if state is None else state.then(part)
        if state is not None:
            yield row()

    schema = T.StructType([T.StructField("_place", T.IntegerType()), *kinds, T.StructField("state", T.BinaryType())])
    states = ranged.select(*names, "_score", *rest).mapInArrow(scan, schema)

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by("_place")
        state = None
        for raw in table["state"]:
            part = Ordered.unpack(raw.as_buffer())
            state = part if state is None else state.then(part)
        head = table.slice(0, 1)
        return pa.table([pa.array([head["_place"][0].as_py() // BLOCK], pa.int32()), *[head[k] for k in names],
                         pa.array([state.pack()], pa.binary())], names=["_place", *names, "state"])

    while n > 1:
        states = states.groupBy(F.floor(F.col("_place") / BLOCK).alias("_block"), *names).applyInArrow(merge, schema)
        n = -(-n // BLOCK)
    return states.select(*names, "state")


def unpacked_states(states: DataFrame, numbers: np.ndarray) -> DataFrame:
    """``(replicate, keys, pairs, pos, neg)`` from packed states; ``numbers`` names their columns."""
    keys = [f for f in states.schema if f.name != "state"]
    numbers = numbers.astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, raw in enumerate(batch.column(len(keys))):
                s = Ordered.unpack(raw.as_buffer())
                repeat = pa.array(np.full(len(numbers), i))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(numbers), *[batch.column(k).take(repeat) for k in range(len(keys))],
                     pa.array(s.pairs), pa.array(s.pos), pa.array(s.neg)],
                    ["replicate", *[f.name for f in keys], "pairs", "pos", "neg"])

    return states.mapInArrow(run, T.StructType([T.StructField("replicate", T.IntegerType()), *keys,
                                                *[T.StructField(c, T.DoubleType()) for c in ("pairs", "pos", "neg")]]))


def replicate_pairs(rows: DataFrame, weights: DataFrame, by: Sequence[str], score: str, replicates: int,
                    observed: bool = False, first: int = 0, spec: PanelSpec = DEFAULT) -> DataFrame:
    """``(replicate, by, pairs, pos, neg)``: ordered pairs and class weights of every replicate and key."""
    by = list(by)
    names = [f"_k{i}" for i in range(len(by))]
    ready = rows.select(spec.entity, *[F.col(c).alias(k) for k, c in zip(names, by)],
                        checked_score(rows, score).cast("double").alias("_score"),
                        checked_label(spec.label).cast("double").alias("_y")).join(weights, spec.entity)
    ready = ready.select(*names, "_score", F.col(spec.entity).alias("_entity"), "_y", "weights")

    def weigh(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        w = np.ones((part.num_rows, replicates + observed))
        w[:, :replicates] = np.vstack([np.frombuffer(x.as_buffer(), np.uint8) for x in part.column(part.num_columns - 1)])
        label = part.column(part.num_columns - 2).to_numpy(zero_copy_only=False)[:, None]
        return w * label, w * (1 - label)

    states = ordered_states(ready, names, range_count(rows), ["_entity"], weigh)
    numbers = np.r_[np.arange(first, first + replicates), [OBSERVED] * observed]
    return unpacked_states(states, numbers).toDF("replicate", *by, "pairs", "pos", "neg")
