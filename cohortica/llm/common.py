"""Helpers shared by the training-data operators.

Operators select the columns they need by name first, so extra input columns never
clash with their own. Python parts work on Arrow batches in slices of bounded size.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from cohortica.session import ensure_checkpoint_dir

SLICE_BYTES = 1 << 20          # text bytes worked on at once
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_ONE = np.uint64(1)


def shared_dir(spark) -> str:
    ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


def kept(df: DataFrame, tag: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back.

    Unlike ``checkpoint()`` this computes the plan a single time.
    """
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=partition_by)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id's decimal text, modulo ``m``; a null id counts as the text ''."""
    return F.pmod(F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")), F.lit(m))


def range_index(value: Column, bounds: list, kind: str = "bigint") -> Column:
    """How many of the ascending ``bounds`` are not above ``value`` (null: 0).

    Two steps of about sqrt(n) comparisons each; the array is a constant of the plan.
    """
    if not bounds:
        return F.lit(0)
    step = max(2, int(len(bounds) ** 0.5))
    text = lambda xs: "array(" + ",".join(f"cast({x} as {kind})" for x in xs) + ")"
    blocks = [bounds[i:i + step] for i in range(0, len(bounds), step)]
    heads = F.expr(text([b[0] for b in blocks]))
    nested = F.expr("array(" + ",".join(text(b) for b in blocks) + ")")
    block = F.size(F.filter(heads, lambda b: b <= value))
    inner = F.size(F.filter(F.element_at(nested, F.greatest(block, F.lit(1))), lambda b: b <= value))
    return F.when(value.isNull() | (block == 0), F.lit(0)).otherwise((block - 1) * F.lit(step) + inner)


# ---- words of Arrow text batches -------------------------------------------------------------

def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mixing (splitmix64 finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BYTE[65:91] = _BYTE[97:123]          # A-Z as a-z
_BASE = 0xD6E8FEB86659FD93
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(21, (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and the offsets of each; a null text is empty."""
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text",
           limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each piece holds about ``limit`` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = utf8(batch.column(batch.schema.get_field_index(text)))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(at, at[first] + limit, "right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last


def words(raw: np.ndarray, at: np.ndarray, stems: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word (A-Z lower-cased) and the text that it belongs to.

    With ``stems`` the hashes are rows: the words, then for each length the first so many
    bytes, or 0 where a word is shorter.

    Words are runs of bytes other than space and 0x09-0x0D; a text's end ends a word.
    Long inputs go in blocks that end at a separator, so temporaries stay small.
    """
    n = len(raw)
    if not n:
        return np.zeros((1 + len(stems), 0) if stems else 0, np.uint64), np.zeros(0, np.int64)
    inside = ~_SEPARATOR[raw]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    first = at[:-1][at[:-1] < n]
    begin[first] = inside[first]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | begin[1:]
    b, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
    out = np.zeros((1 + len(stems), len(b)), np.uint64)
    done = 0
    while done < len(b):
        last = max(int(np.searchsorted(e, b[done] + SLICE_BYTES, "right")), done + 1)
        lo, hi = b[done], e[last - 1]
        up, down = _powers(int(hi - lo))
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_BYTE[raw[lo:hi]] * up[:hi - lo], out=sums[1:])
        start, stop = b[done:last] - lo, e[done:last] - lo
        base, shift = sums[start], down[start]
        out[0, done:last] = mix((sums[stop] - base) * shift)
        for k, size in enumerate(stems, 1):
            stem = mix(mix((sums[np.minimum(start + size, stop)] - base) * shift) + np.uint64(size))
            out[k, done:last] = np.where(stop - start >= size, stem, np.uint64(0))
        done = last
    return (out if stems else out[0]), np.searchsorted(at, b, "right") - 1


def shingles(h: np.ndarray, doc: np.ndarray, docs: int, size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ``size``-word shingles as 64-bit hashes, by text and hash; a shorter text is one shingle.

    Also the text of each, and the number of its first word.

    Two different shingles share a hash with probability 2**-64.
    """
    count = np.bincount(doc, minlength=docs) if len(doc) else np.zeros(docs, np.int64)
    k = np.uint64(0x9FB21C651E98DF25)
    if len(h) >= size:
        s = np.zeros(len(h) - size + 1, np.uint64)
        for j in range(size):
            s = s * k + h[j:len(h) - size + 1 + j]
        whole = doc[:len(s)] == doc[size - 1:]
        place = np.flatnonzero(whole)
        s, owner = mix(s[whole]), doc[:len(s)][whole]
    else:
        s, owner, place = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        start = np.cumsum(count) - count
        own = []
        for d in short:
            v = int(count[d])
            for x in h[start[d]:start[d] + count[d]].tolist():
                v = (v * int(k) + x) % 2**64
            own.append(v)
        s = np.concatenate([s, mix(mix(np.array(own, np.uint64)))])
        owner = np.concatenate([owner, short])
        place = np.concatenate([place, start[short]])
    order = np.lexsort((s, owner))
    s, owner, place = s[order], owner[order], place[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
    return s[new], owner[new], place[new]


def map_rows(docs: DataFrame, run) -> DataFrame:
    """``mapInArrow`` over whole rows that keeps the schema; ``run`` sees columns named c0, c1, ..."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    schema = T.StructType([T.StructField(n, f.dataType, True) for n, f in zip(names, docs.schema)])
    return docs.toDF(*names).mapInArrow(run, schema).toDF(*docs.columns)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys of sorted batches, each as one table."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        head = tuple(c[0] for c in cols)
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for i, (a, z) in enumerate(zip(cuts, cuts[1:])):
            if held and (i or head != last):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, z - a))
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)
