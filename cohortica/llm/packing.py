"""Best-fit packing with swap-based local search (operator 2).

Texts are tokenised in Arrow batches; only piece records (no text, no ids) move on.
Pieces are dealt to blocks of about ``BLOCK_PIECES`` by hash, the number of blocks
following the number of pieces, and each block is packed on its own: the cost of the
cut is at most about one underfull sequence a block. Within a block best fit gives the
start; then items move between underfull bins (moves, one-for-one and two-for-one
exchanges either way) as long as the sum of squared fills grows, which drains the
emptiest bins until they are gone.

A null text is empty and still gets its end id, so every row has at least one piece.
Repeated rows are packed like any others; a null id is kept. No pieces, no sequences.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortica.llm.common import kept, slices

BLOCK_PIECES = 50_000
CACHE_WORDS = 500_000
CACHE_CHARS = 16_000_000
# Latin letters whose lower case is one letter, then ASCII punctuation
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([!-/:-@[-`{-~]*)")
PIECE_COLUMNS = "doc_id long, piece int, start long, length long, ids_crc32 long, salt long"


class Tokens:
    """Ids of whole texts as little-endian bytes; ids of words are remembered.

    Text between white space is tokenised independently by a word-level BPE, so a text's
    ids are those of its words in turn. A word of Latin letters, with or without a run of
    ASCII punctuation behind it, is one or two pre-tokens, which go straight to the BPE
    model in the byte alphabet of the vocabulary; all else takes the full tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # printable Latin-1 bytes stand for themselves, the rest for code points from 256 on
        same = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in same]
        self.alphabet = {b: 256 + i for i, b in enumerate(rest)}
        self.known: dict[str, bytes] = {"": b""}
        self.chars = 0

    def _word(self, word: str) -> bytes:
        spelled = word.lower()
        if not spelled.isascii():
            spelled = spelled.encode().decode("latin-1").translate(self.alphabet)
        ids = [t.id for t in self.model.tokenize(spelled)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        parts = [t.replace("\n", " ").replace("\t", " ").split(" ") for t in texts]
        if len(self.known) > CACHE_WORDS or self.chars > CACHE_CHARS:
            self.known, self.chars = {"": b""}, 0
        known = self.known
        new = set().union(*parts).difference(known)
        split = {w: m.groups() for w in new if (m := _PLAIN.fullmatch(w))}
        other = list((new - split.keys()) | {mark for _, mark in split.values() if mark not in known})
        for w, got in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False)):
            known[w] = np.array(got.ids, "<u4").tobytes()
        for w, (letters, mark) in split.items():
            if letters not in known:
                known[letters] = self._word(letters)
            if mark:
                known[w] = known[letters] + known[mark]
        self.chars += sum(map(len, new))
        return [b"".join([known[w] for w in p]) for p in parts]


_TOKENS: dict[str, Tokens] = {}


def cut_pieces(path: str, capacity: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _TOKENS:
            _TOKENS[path] = Tokens(path)
        tokens = _TOKENS[path]
        salt = 0
        for piece in slices(batches):
            ids = piece.column(0).to_pylist()
            texts = [t or "" for t in piece.column(1).to_pylist()]
            rows = []
            for doc, got in zip(ids, tokens.encode(texts)):
                got += end
                for k, at in enumerate(range(0, len(got), 4 * capacity)):
                    part = got[at:at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), salt))
                    salt += 1
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()),
                 *(pa.array(c, pa.int64()) for c in cols[2:])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "salt"])
    return run


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing over the gaps present; items are positions in ``lengths``."""
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    gaps: list[int] = []                       # sorted gaps that have a bin
    bins: list[list[int]] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        at = bisect_right(gaps, n - 1)
        if at == len(gaps):
            bins.append([i])
            b, gap = len(bins) - 1, capacity - n
        else:
            gap = gaps[at]
            b = by_gap[gap].pop()
            if not by_gap[gap]:
                gaps.pop(at)
            bins[b].append(i)
            gap -= n
        if gap:
            if not by_gap[gap]:
                gaps.insert(bisect_right(gaps, gap), gap)
            by_gap[gap].append(b)
    return bins


class _Pool:
    """Items of the bins to be emptied, by length."""

    def __init__(self):
        self.sizes: list[int] = []
        self.at: dict[int, list[tuple[int, int]]] = {}

    def add(self, n: int, item: tuple[int, int]) -> None:
        if n not in self.at:
            self.at[n] = []
            self.sizes.insert(bisect_right(self.sizes, n), n)
        self.at[n].append(item)

    def remove(self, n: int, item: tuple[int, int]) -> None:
        self.at[n].remove(item)
        if not self.at[n]:
            del self.at[n]
            self.sizes.pop(bisect_right(self.sizes, n) - 1)

    def best(self, above: int, upto: int) -> int:
        """Largest length in (above, upto], or 0."""
        at = bisect_right(self.sizes, upto) - 1
        return self.sizes[at] if at >= 0 and self.sizes[at] > above else 0


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int, donors: int = 64,
                 rounds: int = 40) -> list[list[int]]:
    """Drain the least filled bins into the gaps of the others; sum of squared fills only grows."""
    size = lengths.tolist()
    fill = [sum(size[i] for i in b) for b in bins]
    for _ in range(rounds):
        open_bins = [b for b in range(len(bins)) if bins[b] and fill[b] < capacity]
        open_bins.sort(key=lambda b: fill[b])
        giving = open_bins[:max(1, min(donors, len(open_bins) // 2))]
        taking = open_bins[len(giving):]
        pool = _Pool()
        for b in giving:
            for i in bins[b]:
                pool.add(size[i], (i, b))
        gained = False

        def trade(b: int, out: list[int], n: list[int]) -> None:
            """Bin ``b`` gives ``out`` to the donor of the largest item and takes items of lengths ``n``."""
            back = None
            for k in n:
                item = pool.at[k][-1]
                pool.remove(k, item)
                bins[item[1]].remove(item[0])
                fill[item[1]] -= k
                bins[b].append(item[0])
                fill[b] += k
                back = item[1] if back is None else back
            for i in out:
                bins[b].remove(i)
                fill[b] -= size[i]
                bins[back].append(i)
                fill[back] += size[i]
                pool.add(size[i], (i, back))

        for b in sorted(taking, key=lambda b: -fill[b]):
            while (gap := capacity - fill[b]) > 0 and pool.sizes:
                n = pool.best(0, gap)
                choice = (n, [], [n]) if n else None                       # a move
                mine = sorted({size[i]: i for i in bins[b]}.items())
                for a, i in mine:                                          # one for one
                    n = pool.best(a, a + gap)
                    if n and (choice is None or n - a > choice[0]):
                        choice = (n - a, [i], [n])
                if choice is None or choice[0] < gap:
                    items = bins[b] if len(bins[b]) <= 24 else bins[b][:24]
                    for x in range(len(items)):                            # one for two of this bin
                        for y in range(x + 1, len(items)):
                            a = size[items[x]] + size[items[y]]
                            n = pool.best(a, a + gap)
                            if n and (choice is None or n - a > choice[0]):
                                choice = (n - a, [items[x], items[y]], [n])
                    for a, i in mine:                                      # two for one of this bin
                        for first in pool.sizes[-1:-9:-1]:
                            rest = pool.best(max(a - first, 0), a + gap - first)
                            if rest and (rest != first or len(pool.at[rest]) > 1) and (
                                    choice is None or first + rest - a > choice[0]):
                                choice = (first + rest - a, [i], [first, rest])
                if choice is None:
                    break
                donor_fill = max(fill[pool.at[k][-1][1]] for k in choice[2])
                if fill[b] + choice[0] <= donor_fill:                      # squared fill would not grow
                    break
                same = len({pool.at[k][-1][1] for k in choice[2]}) == 1
                if not same and choice[1]:
                    back = pool.at[choice[2][0]][-1][1]
                    grown = fill[back] - choice[2][0] + sum(size[i] for i in choice[1])
                    if grown > capacity:
                        break
                trade(b, choice[1], choice[2])
                gained = True
        if not gained:
            break
    return [b for b in bins if b]


def pack_block(capacity: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "start", "salt"]).reset_index(drop=True)
        lengths = rows["length"].to_numpy(np.int64)
        bins = local_search(best_fit(lengths, capacity), lengths, capacity)
        where = np.empty(len(rows), np.int64)
        offset = np.empty(len(rows), np.int64)
        for k, items in enumerate(bins):
            where[items] = k
            sizes = lengths[items]
            offset[items] = np.cumsum(sizes) - sizes
        rows["sequence_id"] = rows["block"].to_numpy(np.int64) * 2**32 + where
        rows["offset"] = offset
        return rows[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]
    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: its place in a sequence of at most ``capacity`` tokens."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = kept(texts.mapInArrow(cut_pieces(tokenizer, capacity, end_id), PIECE_COLUMNS), "pieces")
    blocks = max(1, -(-pieces.count() // BLOCK_PIECES))
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "salt"), F.lit(blocks)))
    return dealt.groupBy("block").applyInPandas(
        pack_block(capacity), "doc_id long, piece int, start long, length long, ids_crc32 long, "
                              "sequence_id long, offset long")


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
