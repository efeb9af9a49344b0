"""Language identification with hyperdimensional profiles (operator 10).

Every letter has a random vector of +1/-1. A letter trigram is the product of its letters'
vectors, the first rotated twice and the second once, so order counts; a text is the sum
of its trigrams, and a language the sum of its texts' unit vectors. A text gets the
language whose prototype has the largest cosine with it.

Letters are those of Unicode, lower-cased; the vector of each is drawn from its code point
alone, so no two share one and every worker has the same. Anything else is a word boundary.
Prototypes are summed by Spark over all training texts: one row a language and dimension.

A null text or one without a letter is ``und`` with score 0, and so is every text if there
is nothing to learn from. Equal cosines go to the alphabetically first language. Texts are
whole, however long. Repeated rows and rows without an id are each scored, and learned from
as often as they occur. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortica.llm.common import crc_mod, slices

DIMENSIONS = 512
SYMBOL_BITS = 21           # room for every code point
LETTERS = 50_000           # letter vectors a worker holds before it starts over: 100 MB
HELD = 4096                # trigrams whose vectors a worker adds at a time
MOST = 40_000              # trigram vectors a worker holds: 80 MB
SEED = 41


class Profiles:
    """Text vectors; letter and trigram vectors are made when first seen."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        self.dimensions, self.seed = dimensions, seed
        self._forget()

    def _forget(self) -> None:
        """Start over: symbol 0 is the word boundary, the others are letters in the order seen."""
        self.symbol: dict[int, int] = {}
        self.letters = self._letter(0)[None]
        self._table: np.ndarray | None = None
        self.clear()

    def _letter(self, code: int) -> np.ndarray:
        """The vector of a code point, drawn from its number alone."""
        return np.random.default_rng([self.seed, code]).choice(np.array([-1.0, 1.0], np.float32), self.dimensions)

    def clear(self) -> None:
        self.keys, self.rows = np.zeros(0, np.int64), np.zeros(0, np.int64)      # trigrams in order, and their vectors' rows
        self.vectors = np.empty((HELD, self.dimensions), np.float32)

    def _rows(self, grams: np.ndarray) -> np.ndarray:
        """Vector rows of distinct trigrams in order, at most ``MOST``."""
        at = np.minimum(np.searchsorted(self.keys, grams), max(len(self.keys) - 1, 0))
        new = grams[self.keys[at] != grams] if len(self.keys) else grams
        if len(new):
            if len(self.keys) + len(new) > MOST:
                self.clear()
                new = grams
            used = len(self.keys)
            while used + len(new) > len(self.vectors):
                self.vectors = np.concatenate([self.vectors, np.empty_like(self.vectors)])
            mask = (1 << SYMBOL_BITS) - 1
            for i in range(0, len(new), HELD):
                part = new[i:i + HELD]
                self.vectors[used + i:used + i + len(part)] = (
                    np.roll(self.letters[part >> 2 * SYMBOL_BITS], 2, 1)
                    * np.roll(self.letters[part >> SYMBOL_BITS & mask], 1, 1) * self.letters[part & mask])
            keys, rows = np.concatenate([self.keys, new]), np.concatenate([self.rows, np.arange(used, used + len(new))])
            order = np.argsort(keys)
            self.keys, self.rows = keys[order], rows[order]
        return self.rows[np.searchsorted(self.keys, grams)]

    def _symbols(self, codes: np.ndarray) -> np.ndarray:
        seen, back = np.unique(codes, return_inverse=True)
        out, made = [], []
        for c in seen.tolist():
            if c not in self.symbol:
                letter = chr(c).isalpha()
                self.symbol[c] = len(self.letters) + len(made) if letter else 0
                if letter:
                    made.append(self._letter(c))
            out.append(self.symbol[c])
        if made:
            self.letters = np.concatenate([self.letters, made])
        return np.array(out, np.int64)[back]

    def _symbols_table(self, codes: np.ndarray) -> np.ndarray:
        if self._table is None:
            self._table = self._symbols(np.arange(0x250, dtype=np.uint32))
        out = self._table[np.minimum(codes, 0x24F)]
        far = np.flatnonzero(codes >= 0x250)
        if len(far):
            out[far] = self._symbols(codes[far])
        return out

    def texts(self, texts: list[str | None]) -> np.ndarray:
        """One vector a text; zero where it has no letter."""
        if len(self.letters) > LETTERS:
            self._forget()
        low = [(t or "").lower() for t in texts]
        out = np.zeros((len(texts), self.dimensions), np.float32)
        codes = np.frombuffer(("\n" + "\n".join(low) + "\n").encode("utf-32-le", "replace"), np.uint32)
        size = np.array([len(t) for t in low]) + 1
        doc = np.concatenate([[0], np.repeat(np.arange(len(low)), size)])
        symbol = self._symbols_table(codes)
        keep = np.concatenate([[True], (symbol[1:] != 0) | (symbol[:-1] != 0) | (doc[1:] != doc[:-1])])
        symbol, doc = symbol[keep], doc[keep]
        if len(symbol) < 3:
            return out
        real = symbol[1:-1] > 0
        if not real.any():
            return out
        # letters are numbered in the order seen: few bits hold a trigram, and one sort counts (text, trigram)
        bits = int(len(self.letters) - 1).bit_length()
        gram = (symbol[:-2] << 2 * bits | symbol[1:-1] << bits | symbol[2:])[real]
        if 3 * bits + len(texts).bit_length() < 63:
            key, count = np.unique(doc[1:-1][real] << 3 * bits | gram, return_counts=True)
            own, gram = key >> 3 * bits, key & ((1 << 3 * bits) - 1)
            distinct = np.unique(gram)
            at = np.searchsorted(distinct, gram)
        else:
            distinct, at = np.unique(gram, return_inverse=True)
            key, count = np.unique(doc[1:-1][real] * len(distinct) + at, return_counts=True)
            own, at = np.divmod(key, len(distinct))
        mask = (1 << bits) - 1
        distinct = distinct >> 2 * bits << 2 * SYMBOL_BITS | (distinct >> bits & mask) << SYMBOL_BITS | distinct & mask
        for low_end in range(0, len(distinct), MOST):
            rows = self._rows(distinct[low_end:low_end + MOST])
            here = np.flatnonzero((at >= low_end) & (at < low_end + MOST))
            cut = np.flatnonzero(np.diff(own[here], prepend=-1))
            for a, z in zip(cut.tolist(), [*cut[1:].tolist(), len(here)]):
                for i in range(a, z, HELD):                          # counts times +1/-1: exact in any order
                    part = here[i:min(z, i + HELD)]
                    out[own[part[0]]] += count[part].astype(np.float32) @ self.vectors[rows[at[part] - low_end]]
        return out


_HELD: list[Profiles] = []


def _profiles() -> Profiles:
    """One per worker process, so that trigram vectors are made once."""
    if not _HELD:
        _HELD.append(Profiles())
    return _HELD[0]


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def _bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of unit text vectors by language, of one task."""
    made, sums = _profiles(), {}
    for piece in slices(batches):
        vectors = _unit(made.texts(piece.column(1).to_pylist())).astype(np.float64)
        lang = np.array(piece.column(0).to_pylist(), object)
        for name in set(lang.tolist()):
            sums[name] = sums.get(name, 0) + vectors[lang == name].sum(0)
    for name, v in sums.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * len(v), pa.string()), pa.array(np.arange(len(v)), pa.int32()), pa.array(v)],
            ["lang", "dim", "value"])


def prototypes(train: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their unit prototypes, from ``lang, text``; languages x dimensions numbers reach the driver."""
    sums = train.mapInArrow(_bundle, "lang string, dim int, value double").groupBy("lang", "dim").agg(
        F.sum("value").alias("value"))
    rows = sums.collect()
    names = sorted({r["lang"] for r in rows})
    out = np.zeros((len(names), DIMENSIONS))
    at = {n: i for i, n in enumerate(names)}
    for r in rows:
        out[at[r["lang"]], r["dim"]] = r["value"]
    return names, _unit(out)


def _predict(names: list[str], protos):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, proto = _profiles(), protos.value
        for piece in slices(batches):
            v = made.texts(piece.column(2).to_pylist())
            lettered = v.any(axis=1)
            if len(names):
                # rounding makes the choice independent of the order of floating sums
                cosine = np.round(_unit(v) @ proto.T, 6)
                best, score = cosine.argmax(axis=1), np.clip(cosine.max(axis=1), 0.0, 1.0)
            else:
                lettered, best, score = np.zeros(len(v), bool), np.zeros(len(v), int), np.zeros(len(v))
            pred = [names[b] if has else "und" for b, has in zip(best.tolist(), lettered.tolist())]
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), piece.column(1), pa.array(pred, pa.string()), pa.array(np.where(lettered, score, 0.0))],
                ["doc_id", "held_out", "lang_pred", "score"])
    return run


def identify(docs: DataFrame, held_out=None, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score``; learns from rows that are not ``held_out`` and have a language."""
    out = F.lit(False) if held_out is None else held_out
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), out.alias("held_out"),
                       F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    names, protos = prototypes(rows.where(~F.col("held_out") & F.col("lang").isNotNull()).select("lang", "text"))
    protos = docs.sparkSession.sparkContext.broadcast(protos)
    return rows.select("doc_id", "held_out", "text").mapInArrow(
        _predict(names, protos), "doc_id long, held_out boolean, lang_pred string, score double")


def op10_hyperdimensional_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, crc_mod(F.col("doc_id"), 4) == 2)
