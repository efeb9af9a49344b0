"""Fixed-size count tables filled in tasks and merged by Spark in slices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SLICES = 64
FIELDS = "slice int, cells binary"


def emit(cells: np.ndarray, first: int = 0, slices: int = SLICES) -> Iterator[pa.RecordBatch]:
    """Non-zero slices of a table, numbered from ``first``."""
    for i, part in enumerate(np.split(cells, slices), first):
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part.tobytes()], pa.binary())],
                                             ["slice", "cells"])


def merge(rows: DataFrame, kinds: dict[int, tuple[np.dtype, str]], sizes: dict[int, int]) -> dict[int, np.ndarray]:
    """Tables by their first slice number; ``kinds`` gives type and "sum" or "max", ``sizes`` the cells.

    Sums are 64-bit whatever the type of a task's table. Each slice is merged in one task, which holds one slice at a time and streams the others.
    """
    starts = sorted(kinds)
    of = lambda i: max(s for s in starts if s <= i)
    merged = {s: np.dtype(np.int64) if how == "sum" else kind for s, (kind, how) in kinds.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, cell in zip(batch.column(0).to_pylist(), batch.column(1)):
                kind, how = kinds[of(i)]
                part = np.frombuffer(cell.as_buffer(), kind)
                if i not in held:
                    held[i] = part.astype(merged[of(i)])
                elif how == "sum":
                    held[i] += part
                else:
                    np.maximum(held[i], part, out=held[i])
        for i, part in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part.tobytes()], pa.binary())],
                                             ["slice", "cells"])

    out = {s: np.zeros(sizes[s], merged[s]) for s in starts}
    for r in rows.select("slice", "cells").repartition(SLICES, "slice").mapInArrow(run, FIELDS).collect():
        s = of(r["slice"])
        part = np.frombuffer(r["cells"], merged[s])
        at = (r["slice"] - s) * len(part)
        out[s][at:at + len(part)] = part
    return out


REGISTERS = 1 << 14


def observe(registers: np.ndarray, hashes: np.ndarray) -> None:
    """Enter hashes in the registers of a distinct counter."""
    at = (hashes & np.uint64(REGISTERS - 1)).astype(np.int64)
    rest = (hashes >> np.uint64(14)).astype(np.float64) + 1.0        # below 2**50: exact in a double
    rank = np.where(rest >= 1, 51 - np.ceil(np.log2(rest + 0.5)), 51).clip(1, 51).astype(np.int32)
    np.maximum.at(registers, at, rank)


def distinct(registers: np.ndarray) -> float:
    """Estimated number of distinct hashes, within about one percent."""
    m = len(registers)
    if not registers.any():
        return 0.0
    raw = 0.7213 / (1 + 1.079 / m) * m * m / np.sum(2.0 ** -registers.astype(np.float64))
    zero = int((registers == 0).sum())
    return float(m * np.log(m / zero)) if zero and raw < 2.5 * m else float(raw)
