"""Language-model scores from a hierarchical Pitman-Yor model (operator 8).

Word bigrams: every context word is a restaurant whose dishes come from one shared parent,
the unigram restaurant, whose dishes come from a uniform base. Training tokens are the
customers. Gibbs sweeps draw the number of tables of every (context, word) and of every word
from its conditional under the Chinese restaurant process, and the predictive probabilities
after burn-in are averaged.

How it is spread: all (word, context) pairs of a word, of training and of scored tokens
alike, meet in one part of the shuffle, so the counts of the pair and of the word, the
seating of both restaurants' share of the word, and the token's probability are local there.
Words too frequent for one part are split by context; their exact counts come from a scan of
their own. The customers of a context are counted exactly: those of common contexts are the
counts of that scan, those of all others are summed in a shuffle by context (55 bits) and sent
to the parts that hold one of its pairs. Its tables are the expected number for its customers.
What goes back is one sum per text and part. The fixed table of hash cells only tells which
words may be common and how far words are split.

Counts of words (64-bit hashes, 40 bits within a part) cover all training tokens, so the
base score is exact up to hash collisions. Null and empty texts are one end token. Rows are
scored one by one; repeated rows are repeated training data. With nothing to train on, every
probability is that of the uniform base over the one unknown word.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from cohortica.llm import sketch
from cohortica.llm.common import crc_mod, groups, kept, mix, partitions, slices, utf8, words

CELLS_LOG2 = 22            # cells that find frequent words and deal out their pairs
COMMON = 1 << 16           # words above 1/COMMON of the training tokens are broadcast, so fewer than this
BURN_IN, SAMPLES = 2, 4
STRENGTH, ROOT_STRENGTH, ROOT_DISCOUNT = 2.0, 10.0, 0.6
EXACT = 48                 # customers up to which table counts are drawn from exact weights
SPLIT = 4                  # a word may fill 1/SPLIT of a mean part before it is split
_END, _START = np.uint64(0x5C0FFEE5EED5EED5), np.uint64(0xA11CE0FB0B0C0DE5)
_CONTEXT_BITS = np.uint64(24)
_CUT = np.uint64(9)        # contexts are told apart by the 55 bits above
_LISTED = np.uint64(1 << 23)   # in a key, with the place among the common contexts; else 23 bits of the context, 32 more apart
ASK_TOKENS = 1_000_000     # tokens of contexts that are not common held before they are asked for
_TOLD = -2                 # slice of the packets that tell customers of contexts
PACKET = "part int, slice long, docs binary, counts binary, keys binary, more binary"
ASKED = "part int, contexts binary, counts binary, asking binary, parts binary"
SUMS = "slice long, docs binary, base binary, model binary, known binary"


def _tokens(piece: pa.RecordBatch):
    """Word hashes with an end token after each text, context hashes, and tokens of each text."""
    raw, at = utf8(piece.column(2))
    h, doc = words(raw, at)
    n = np.bincount(doc, minlength=len(at) - 1) + 1
    w = np.empty(int(n.sum()), np.uint64)
    end = np.cumsum(n) - 1
    w[end] = _END
    inner = np.ones(len(w), bool)
    inner[end] = False
    w[inner] = h
    u = np.concatenate([[_START], w[:-1]])
    u[np.concatenate([[0], end[:-1] + 1])] = _START
    return w, u, n


def _cell(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - CELLS_LOG2)).astype(np.int64)


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Context customers by cell, distinct pairs and words, and the number of training tokens."""
    cells, pairs, vocabulary = np.zeros(1 << CELLS_LOG2, np.int32), np.zeros(sketch.REGISTERS, np.int32), np.zeros(
        sketch.REGISTERS, np.int32)
    total = np.zeros(sketch.SLICES, np.int64)
    for piece in slices(batches):
        w, u, _ = _tokens(piece)
        np.add.at(cells, _cell(u), 1)
        np.add.at(cells, _cell(w[w == _END]), 1)
        sketch.observe(pairs, mix(w * np.uint64(3) + u))
        sketch.observe(vocabulary, w)
        total[0] += len(w)
    for i, table in enumerate((cells, pairs, vocabulary, total)):
        yield from sketch.emit(table, i * sketch.SLICES)


def _frequent(hot):
    """Exact counts of the words in the cells of frequent words, and whether the cell is split."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, split = hot.value
        in_hot, in_split, seen = np.zeros(1 << CELLS_LOG2, bool), np.zeros(1 << CELLS_LOG2, bool), {}
        in_hot[cells], in_split[cells] = True, split
        for piece in slices(batches):
            w, _, _ = _tokens(piece)
            for x, n in zip(*(v.tolist() for v in np.unique(w[in_hot[_cell(w)]], return_counts=True))):
                seen[x] = seen.get(x, 0) + n
        word = np.array(list(seen), np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(list(seen.values()), pa.int64()),
                                          pa.array(in_split[_cell(word)])], ["word", "n", "split"])
    return run


def _part(w: np.ndarray, u: np.ndarray, salts: np.ndarray, parts: int) -> np.ndarray:
    many = salts[_cell(w)].astype(np.uint64)
    return ((mix(w ^ np.uint64(9)) + mix(u) % many) % np.uint64(parts)).astype(np.int64)


def _find(sought: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the ascending ``among``, and whether the value is there."""
    if not len(among):
        return np.zeros(len(sought), np.int64), np.zeros(len(sought), bool)
    at = np.minimum(np.searchsorted(among, sought), len(among) - 1)
    return at, among[at] == sought


def _packed(x: np.ndarray) -> bytes:
    """Numbers of 64 bits byte by byte, so that the shuffle's compression removes the empty ones."""
    return x.astype(np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(x) -> np.ndarray:
    return np.frombuffer(x, np.uint8).reshape(8, -1).T.copy().view(np.uint64)[:, 0]


def _requests(held: list, parts: int) -> pa.RecordBatch:
    part, context, train = (np.concatenate(x) for x in zip(*held))
    to = (mix(context) % np.uint64(parts)).astype(np.int64)
    by = np.lexsort((part, context, to))
    part, context, to, train = part[by], context[by], to[by], train[by].astype(np.int64)
    other = np.concatenate([[True], context[1:] != context[:-1]])[:len(by)]
    first = np.flatnonzero(other | np.concatenate([[True], part[1:] != part[:-1]])[:len(by)])
    lead = np.flatnonzero(other)
    customers = np.add.reduceat(train, lead) if len(lead) else train
    asking = np.diff(np.append(np.searchsorted(first, lead), len(first)))
    part = part[first]
    begin = np.cumsum(asking) - asking
    cut = np.flatnonzero(np.diff(to[lead], prepend=-1)).tolist()
    rows = [(int(to[lead[a]]), _packed(context[lead[a:z]]), _packed(customers[a:z]), _packed(asking[a:z]),
             _packed(part[begin[a]:begin[z - 1] + asking[z - 1]])) for a, z in zip(cut, [*cut[1:], len(lead)])]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3, 4))],
        ["part", "contexts", "counts", "asking", "parts"])


def _ask(shared, parts: int):
    """Contexts that are not common with their training tokens, and the parts that will hold their pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts, common = shared.value["salts"], shared.value["contexts"]
        held, size = [], 0
        for piece in slices(batches):
            w, u, n = _tokens(piece)
            train = np.repeat(~np.array(piece.column(1).to_pylist(), bool), n)
            rare = ~_find(u >> _CUT, common)[1]
            held.append((_part(w[rare], u[rare], salts, parts).astype(np.uint32), u[rare] >> _CUT, train[rare]))
            size += len(held[-1][0])
            if size >= ASK_TOKENS:
                yield _requests(held, parts)
                held, size = [], 0
        if held:
            yield _requests(held, parts)
    return run


def _tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Customers of every context asked for, to each part that asked."""
    held = [[_unpacked(x.as_buffer()) for x in row] for batch in batches for row in zip(*batch.columns[1:])]
    if not held:
        return
    context, count, asking, part = (np.concatenate(x) for x in zip(*held))
    name, of = np.unique(context, return_inverse=True)
    customers = np.zeros(len(name), np.int64)
    np.add.at(customers, of, count.astype(np.int64))
    of = np.repeat(of, asking.astype(np.int64))
    asked = np.unique(part.astype(np.int64) * len(name) + of)
    part, of = asked // len(name), asked % len(name)
    cut = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
    for a, z in zip(cut, [*cut[1:], len(part)]):
        yield pa.RecordBatch.from_arrays(
            [pa.array([part[a]], pa.int32()), pa.array([_TOLD], pa.int64()), pa.nulls(1, pa.binary()),
             pa.array([_packed(customers[of[a:z]])], pa.binary()), pa.array([_packed(name[of[a:z]])], pa.binary()),
             pa.nulls(1, pa.binary())], ["part", "slice", "docs", "counts", "keys", "more"])


def _send(shared, parts: int):
    """Keys (40 bits of the word, 24 for the context, 32 more if it is not common) of all tokens for each part, and the texts' ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts, common = shared.value["salts"], shared.value["contexts"]
        base = TaskContext.get().partitionId() << 32
        for number, piece in enumerate(slices(batches)):
            w, u, n = _tokens(piece)
            doc = np.repeat(np.arange(len(n), dtype=np.uint32), n)
            part = _part(w, u, salts, parts)
            by = np.argsort(part, kind="stable")
            part, doc = part[by], doc[by]
            u = u[by] >> _CUT
            at, listed = _find(u, common)
            key = (w[by] << _CONTEXT_BITS) | np.where(listed, at.astype(np.uint64) | _LISTED, u >> np.uint64(32))
            more, rare = u.astype(np.uint32), ~listed
            cut = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
            rows = []
            for a, z in zip(cut, [*cut[1:], len(part)]):
                first = np.flatnonzero(np.diff(doc[a:z].astype(np.int64), prepend=-1))
                rows.append((int(part[a]), base + number, doc[a:z][first].tobytes(),
                             np.diff(np.append(first, z - a)).astype(np.uint32).tobytes(), key[a:z].tobytes(), more[a:z][rare[a:z]].tobytes()))
            ids = pa.Table.from_arrays([piece.column(0), piece.column(1), pa.array(n)], ["doc_id", "held_out", "n_tokens"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, ids.schema) as out:
                out.write_table(ids)
            # texts held out are told apart by the sign of their number
            held = np.array(piece.column(1).to_pylist(), bool)
            rows = [(p, s, (np.frombuffer(d, np.uint32) | (held[np.frombuffer(d, np.uint32)].astype(np.uint32) << np.uint32(31))
                            ).astype(np.uint32).tobytes(), c, k, m) for p, s, d, c, k, m in rows]
            rows.append((number % parts, base + number, None, None, sink.getvalue().to_pybytes(), None))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()),
                 *(pa.array([r[i] for r in rows], pa.binary()) for i in (2, 3, 4, 5))],
                ["part", "slice", "docs", "counts", "keys", "more"])
    return run


def stirling(most: int, discount: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers ``[customers, tables]``."""
    s = np.full((most + 1, most + 1), -np.inf)
    s[1, 1] = 0.0
    for c in range(1, most):
        t = np.arange(1, c + 2)
        s[c + 1, 1:c + 2] = np.logaddexp(s[c, 0:c + 1], s[c, 1:c + 2] + np.log(np.maximum(c - t * discount, 1e-300)))
    return s


def draw_tables(c: np.ndarray, a: np.ndarray, discount: float, table: np.ndarray, rng) -> np.ndarray:
    """Tables of each dish with ``c`` customers, drawn from P(t) ~ S(c, t) a**t.

    Beyond ``EXACT`` customers, where the weights are too many to list, the others take seats
    after them in doubling blocks, with the chance of a new table at the middle of the block.
    """
    t = np.minimum(c, 1).astype(np.int64)
    base = np.minimum(c, len(table) - 1)
    order = np.argsort(base, kind="stable")
    cut = np.searchsorted(base[order], np.arange(2, len(table) + 1))
    log_a = np.log(np.maximum(a, 1e-300))
    for k, (first, last) in enumerate(zip(cut, cut[1:]), 2):
        for lo in range(first, last, 100_000):
            rows = order[lo:min(lo + 100_000, last)]
            x = table[k, 1:k + 1] + log_a[rows, None] * np.arange(1, k + 1)
            x = np.cumsum(np.exp(x - x.max(1, keepdims=True)), axis=1)
            t[rows] = 1 + (x < rng.random(len(rows))[:, None] * x[:, -1:]).sum(1)
    big = np.flatnonzero(c >= len(table))
    seated = np.full(len(big), len(table) - 1, np.int64)
    while len(big):
        block = np.minimum(seated, c[big] - seated)
        p = a[big] / (a[big] + seated + block / 2 - discount * t[big])
        t[big] += rng.binomial(block, np.clip(p, 0, 1))
        seated += block
        more = seated < c[big]
        big, seated = big[more], seated[more]
    return t


def expected_tables(c: np.ndarray, strength: float, discount: float) -> np.ndarray:
    """Mean number of tables of a restaurant with ``c`` customers."""
    grown = np.exp(lgamma(1 + strength) - lgamma(discount + strength)) * (c + strength) ** discount
    return np.clip((grown - strength) / discount, np.minimum(c, 1), c)


def pair_probabilities(keys: np.ndarray, count: np.ndarray, extra: dict, seed: int):
    """``seated`` for sorted keys of 40 bits of the word and 24 of the context, with customers by cell of the context."""
    cell = ((keys >> np.uint64(2)) & np.uint64((1 << CELLS_LOG2) - 1)).astype(np.int64)
    return seated(keys >> _CONTEXT_BITS, np.maximum(extra["cells"][cell], count), count, extra, seed)


def seated(word: np.ndarray, customers: np.ndarray, count: np.ndarray, extra: dict, seed: int):
    """Averaged predictive probability of every distinct pair, and its word's training count.

    Pairs come in the order of their words; ``customers`` are those of a pair's whole context,
    ``count`` those of the pair.
    """
    rng = np.random.default_rng(seed)
    start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
    of = np.cumsum(np.concatenate([[0], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
    local = np.add.reduceat(count, start) if len(start) else np.zeros(0, np.int64)
    total, share = local.copy(), np.ones(len(local))
    where = np.searchsorted(extra["words"], word[start])
    where = np.minimum(where, max(len(extra["words"]) - 1, 0))
    split = extra["words"][where] == word[start] if len(extra["words"]) else np.zeros(len(start), bool)
    total[split] = extra["counts"][where[split]]
    share[split] = np.maximum(total[split], 1) / np.maximum(local[split], 1)
    once, twice = int((count == 1).sum()), int((count == 2).sum())
    discount = float(np.clip(once / (once + 2 * twice), 0.3, 0.95)) if once else 0.75
    table, root_table = stirling(EXACT, discount), stirling(EXACT, ROOT_DISCOUNT)
    room = STRENGTH + discount * expected_tables(customers.astype(np.float64), STRENGTH, discount)
    floor = 1.0 / (extra["vocabulary"] + 1)
    tables = np.minimum(count, 1).astype(np.int64)
    served = np.flatnonzero(count > 0)
    mean = np.zeros(len(word))
    types = max(int((count > 0).sum()), 1)
    for turn in range(BURN_IN + SAMPLES):
        under = np.add.reduceat(tables, start) * share if len(start) else np.zeros(0)
        under = np.where((total > 0) & (under < 1), 1.0, under).round().astype(np.int64)
        all_tables = extra["pairs"] * max(tables.sum() / types, 1.0)
        top = draw_tables(under, np.full(len(under), (ROOT_STRENGTH + ROOT_DISCOUNT * extra["vocabulary"]) * floor),
                          ROOT_DISCOUNT, root_table, rng)
        parent = (under - ROOT_DISCOUNT * top + (ROOT_STRENGTH + ROOT_DISCOUNT * extra["vocabulary"]) * floor) / (
            ROOT_STRENGTH + all_tables)
        parent = np.minimum(parent, 1.0)
        if turn >= BURN_IN:
            mean += (count - discount * tables + room * parent[of]) / (STRENGTH + customers)
        tables[served] = draw_tables(count[served], (room * parent[of])[served], discount, table, rng)
    return np.minimum(mean / SAMPLES, 1.0), total[of] if len(of) else np.zeros(0, np.int64), int((total[~split] > 0).sum())


def _seat(shared):
    """Sums of a part's tokens by text; a row of slice -1 counts its training words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extra, held, packets, rows, seed = shared.value, [], [], [], 1 << 31
        told = [(extra["contexts"], extra["customers"])]
        for batch in batches:
            for part, number, docs, counts, keys, more in zip(*batch.columns):
                if docs.is_valid:
                    held.append((number.as_py(), np.frombuffer(docs.as_buffer(), np.uint32).copy(),
                                 np.frombuffer(counts.as_buffer(), np.uint32).copy()))
                    packets.append((np.frombuffer(keys.as_buffer(), np.uint64), np.frombuffer(more.as_buffer(), np.uint32)))
                    seed = min(seed, part.as_py())
                elif number.as_py() == _TOLD:
                    told.append((_unpacked(keys.as_buffer()), _unpacked(counts.as_buffer()).astype(np.int64)))
                else:
                    rows.append((number.as_py(), None, keys.as_py(), None, None))
        if held:
            keys, more = (np.concatenate(x) for x in zip(*packets))
            del packets, batch, docs, counts
            size = np.concatenate([h[2] for h in held]).astype(np.int64)
            train = np.repeat(np.concatenate([h[1] for h in held]) < 1 << 31, size)
            context = keys & np.uint64((1 << 24) - 1)
            rare = context < _LISTED
            context[~rare] = extra["contexts"][(context[~rare] ^ _LISTED).astype(np.int64)]
            context[rare] = (context[rare] << np.uint64(32)) | more
            del more, rare
            context, of = np.unique(context, return_inverse=True)
            of = of.astype(np.uint32)
            customers, missing = np.zeros(len(context), np.int64), np.ones(len(context), bool)
            for name, known in told:
                if len(name) > len(context):
                    at, there = _find(context, name)
                    at, known = np.flatnonzero(there), known[at[there]]
                else:
                    at, there = _find(name, context)
                    at, known = at[there], known[there]
                customers[at], missing[at] = known, False
            if missing.any():
                raise RuntimeError("a context's customers were not counted")
            del told
            keys >>= _CONTEXT_BITS
            word, keys = np.unique(keys, return_inverse=True)
            keys *= len(context)
            keys += of
            del of
            order = np.argsort(keys)
            ordered = keys[order]
            new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
            first = np.flatnonzero(new)
            count = np.add.reduceat(train[order].astype(np.int64), first)
            back = np.empty(len(keys), np.int32)
            back[order] = np.cumsum(new, dtype=np.int32) - 1
            pair = ordered[first]
            del ordered, order, new, keys, train, first
            p, total, vocabulary = seated(word[pair // len(context)], customers[pair % len(context)], count, extra, seed)
            begin = np.cumsum(size) - size
            base = np.add.reduceat(np.log10(total + 1.0)[back], begin)
            model = np.add.reduceat(np.log10(np.maximum(p, 1e-300))[back], begin)
            known = np.add.reduceat((total > 0)[back].astype(np.int64), begin)
            at = 0
            for number, docs, *_ in held:
                z = at + len(docs)
                rows.append((number, (docs & np.uint32((1 << 31) - 1)).tobytes(), base[at:z].tobytes(),
                             model[at:z].astype(np.float32).tobytes(), known[at:z].astype(np.uint32).tobytes()))
                at = z
            rows.append((-1, None, str(vocabulary).encode(), None, None))
        for i in range(0, len(rows), 256):
            some = rows[i:i + 256]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in some], pa.int64()), *(pa.array([r[j] for r in some], pa.binary()) for j in (1, 2, 3, 4))],
                ["slice", "docs", "base", "model", "known"])
    return run


def _collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Totals of every text of a slice; vocabulary counts go on as they are."""
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base", "score", "vocabulary"]
    for group in groups(batches, ["slice"]):
        if group["slice"][0].as_py() < 0:
            for v in group["base"].to_pylist():
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(1, pa.int64()), pa.nulls(1, pa.bool_()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()),
                     pa.nulls(1, pa.float64()), pa.nulls(1, pa.float64()), pa.array([int(v)], pa.int64())], names)
            continue
        rows = list(zip(*(group[c].to_pylist() for c in ("docs", "base", "model", "known"))))
        ids = next(pa.ipc.open_stream(r[1]).read_all() for r in rows if r[0] is None)
        base, model, known = np.zeros(len(ids)), np.zeros(len(ids)), np.zeros(len(ids), np.int64)
        for docs, b, m, k in sorted((r for r in rows if r[0] is not None), key=lambda r: r[1]):
            at = np.frombuffer(docs, np.uint32)
            base[at] += np.frombuffer(b, np.float64)
            model[at] += np.frombuffer(m, np.float32)
            known[at] += np.frombuffer(k, np.uint32)
        ids = ids.combine_chunks()
        yield pa.RecordBatch.from_arrays(
            [*(ids[c].combine_chunks() if ids[c].num_chunks != 1 else ids[c].chunk(0) for c in ids.column_names),
             pa.array(known), pa.array(base), pa.array(model), pa.nulls(len(known), pa.int64())], names)


def score(docs: DataFrame, held_out=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row."""
    spark, parts = docs.sparkSession, partitions(docs)
    out = F.lit(False) if held_out is None else held_out
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), out.alias("held_out"),
                        F.col(text_col).cast("string").alias("text"))
    train = texts.where(~F.col("held_out"))
    first = [i * sketch.SLICES for i in range(4)]
    tables = sketch.merge(kept(train.mapInArrow(_survey, sketch.FIELDS), "survey"),
                          {first[0]: (np.dtype(np.int32), "sum"), first[1]: (np.dtype(np.int32), "max"),
                           first[2]: (np.dtype(np.int32), "max"), first[3]: (np.dtype(np.int64), "sum")},
                          {first[0]: 1 << CELLS_LOG2, first[1]: sketch.REGISTERS, first[2]: sketch.REGISTERS,
                           first[3]: sketch.SLICES})
    cells, total = tables[first[0]], int(tables[first[3]][0])
    room = max(total / parts / SPLIT, 1.0)
    salts = np.maximum(np.ceil(cells / room), 1).astype(np.int32)
    least = total / COMMON
    hot = np.flatnonzero((salts > 1) | (cells > least))            # fewer than SPLIT * parts * 2 + COMMON * 2 cells
    exact = train.mapInArrow(_frequent(spark.sparkContext.broadcast((hot, salts[hot] > 1))), "word long, n long, split boolean")
    exact = (exact.groupBy("word", "split").agg(F.sum("n").alias("n")).where((F.col("n") > 0) & (F.col("split") | (F.col("n") > least)))
             .orderBy("word").collect()) if len(hot) else []
    word = np.array([r["word"] for r in exact], np.int64).view(np.uint64)
    count, split = np.array([r["n"] for r in exact], np.int64), np.array([r["split"] for r in exact], bool)
    name = word[split] & np.uint64((1 << 40) - 1)
    order = np.argsort(name)
    # every training word but the end is followed by a token, so its count is its customers as a context
    context = np.where(word == _END, _START, word) >> _CUT
    by = np.argsort(context)
    shared = spark.sparkContext.broadcast({
        "salts": salts, "words": name[order], "counts": count[split][order], "contexts": context[by], "customers": count[by],
        "pairs": sketch.distinct(tables[first[1]]), "vocabulary": sketch.distinct(tables[first[2]])})
    asked = texts.mapInArrow(_ask(shared, parts), ASKED).repartitionById(parts, F.col("part")).mapInArrow(_tell, PACKET)
    sent = texts.mapInArrow(_send(shared, parts), PACKET).unionByName(asked).repartitionById(parts, F.col("part"))
    sums = sent.mapInArrow(_seat(shared), SUMS).repartition(parts, "slice").sortWithinPartitions("slice")
    rows = kept(sums.mapInArrow(_collect, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, "
                                          "score double, vocabulary long"), "scores")
    seen = len(name) + (rows.where("vocabulary is not null").agg(F.sum("vocabulary")).first()[0] or 0)
    whole = float(np.log10(total + seen + 1))
    return rows.where("vocabulary is null").select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(whole)).alias("base_score"), "score")


def op8_pitman_yor_scores(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, crc_mod(F.col("doc_id"), 7) == 2)
