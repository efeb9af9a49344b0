"""Toxic passages by maximum-scoring segments (operator 7).

Fitting, on a bounded sample of labelled rows (``FIT_ROWS`` of each class, in hash order):
tokens are whole words and their stems (the first 4 to 8 bytes). A token's score is the log
ratio of its rates in toxic and clean texts with a Dirichlet prior in proportion to its rate
overall; tokens whose score less two standard errors is above ``LEAST`` are kept. All other
words score the (negative) log ratio of seeing none of them.

Scoring, over all whole texts: a word scores the best of its tokens, and the linear-time scan
for all maximal scoring segments finds every toxic passage. A segment of score S in a text of
n words has E = K n exp(-lambda S) expected chance rivals; lambda is the root of the score
distribution of clean texts and K is fitted to their best segments. A text's evidence is the
sum of log(1/E) over its segments with E < 1, and a logistic curve fitted on the sample maps
it to a probability.

Only the text itself enters a score. Null or empty texts have no segment and get the curve's
value at no evidence. Without two classes of labels every score is 0. Rows with one id share
their label (the largest); null labels and ids teach nothing. Ties in a segment's end go to
the first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortica.llm.common import crc_mod, kept, map_rows, signed, slices, utf8, words

FIT_ROWS = 8000            # labelled texts of each class to fit on
CANDIDATES = 100_000       # tokens counted in the clean sample, by toxic document count
LEAST_DOCS = 4             # toxic texts that a token must be in
PRIOR = 10.0               # prior texts of each class
LEAST = 1.0                # least score of a kept token, after two standard errors
STEMS = (4, 5, 6, 7, 8)


class Model:
    """Token scores, drift of other words, extreme-value constants and the final curve."""

    def __init__(self, hashes: np.ndarray, scores: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.scores = hashes[order], scores[order]
        self.near = np.zeros(1 << 16, bool)
        self.near[(self.hashes >> np.uint64(48)).astype(np.int64)] = True
        self.drift, self.rate, self.k, self.curve = -0.01, 1.0, 0.1, np.array([-3.0, 0.0, 0.0])

    def word_scores(self, rows: np.ndarray) -> np.ndarray:
        """Best score of each word's tokens; 0 for words without one."""
        best = np.zeros(rows.shape[1])
        if len(self.hashes):
            for row in rows:
                hit = np.flatnonzero(self.near[(row >> np.uint64(48)).astype(np.int64)])
                at = np.minimum(np.searchsorted(self.hashes, row[hit]), len(self.hashes) - 1)
                same = self.hashes[at] == row[hit]
                best[hit[same]] = np.maximum(best[hit[same]], self.scores[at[same]])
        return best

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        z = self.curve[0] + self.curve[1] * evidence + self.curve[2] * np.log1p(evidence)
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def maximal_segments(places: list[int], scores: list[float], drift: float) -> list[tuple[float, int, int]]:
    """All maximal scoring segments ``(score, first, last)`` of a row of words, in linear time.

    ``places`` and ``scores`` are those of the words that score above 0; every other word scores ``drift``.
    """
    out: list[list] = []
    total, next_place = 0.0, 0
    for place, score in zip(places, scores):
        total += drift * (place - next_place)
        next_place = place + 1
        new = [total, total + score, place, place]
        total += score
        while out:
            j = len(out) - 1
            while j >= 0 and out[j][0] >= new[0]:
                j -= 1
            if j < 0 or out[j][1] >= new[1]:
                break
            new = [out[j][0], new[1], out[j][2], new[3]]
            del out[j:]
        out.append(new)
    return [(hi - lo, first, last) for lo, hi, first, last in out]


def passages(raw: np.ndarray, at: np.ndarray, model: Model):
    """Word counts of the texts of a slice, and their segments as ``(text, score, first, last)``."""
    rows, doc = words(raw, at, STEMS)
    score = model.word_scores(rows)
    n = np.bincount(doc, minlength=len(at) - 1)
    hit = np.flatnonzero(score > 0)
    start = np.cumsum(n) - n
    found = []
    own = doc[hit]
    cut = np.flatnonzero(np.diff(own, prepend=-1)).tolist()
    for a, z in zip(cut, [*cut[1:], len(own)]):
        d = int(own[a])
        places = (hit[a:z] - start[d]).tolist()
        found += [(d, *s) for s in maximal_segments(places, score[hit[a:z]].tolist(), model.drift)]
    return n, found


def evidence(n: np.ndarray, found, model: Model) -> np.ndarray:
    """Sum of log(1/E) over the significant segments of each text."""
    out = np.zeros(len(n))
    for d, score, _, _ in found:
        e = np.log(model.k * max(int(n[d]), 1)) - model.rate * score
        if e < 0:
            out[d] -= e
    return out


def _documents_with(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of each slice hold each token."""
    for piece in slices(batches):
        rows, doc = words(*utf8(piece.column(0)), STEMS)
        flat, own = rows.ravel(), np.tile(doc, len(rows))
        order = np.lexsort((own, flat))
        flat, own = flat[order], own[order]
        new = np.ones(len(flat), bool)
        new[1:] = (flat[1:] != flat[:-1]) | (own[1:] != own[:-1])
        token, count = np.unique(flat[new & (flat != 0)], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(signed(token)), pa.array(count)], ["token", "n"])


def _documents_of(candidates):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = candidates.value
        total = np.zeros(len(known), np.int64)
        for piece in slices(batches):
            rows, doc = words(*utf8(piece.column(0)), STEMS)
            flat, own = rows.ravel(), np.tile(doc, len(rows))
            at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
            hit = known[at] == flat
            pair = np.unique(at[hit] * np.int64(piece.num_rows) + own[hit])
            total += np.bincount(pair // piece.num_rows, minlength=len(known))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])
    return run


def _hits(model):
    """Per text: label, words, scores of its scoring words; for drift and the constants."""
    def run(batches):
        m = model.value
        for piece in slices(batches):
            rows, doc = words(*utf8(piece.column(0)), STEMS)
            score = m.word_scores(rows)
            n = np.bincount(doc, minlength=piece.num_rows)
            hit = np.flatnonzero(score > 0)
            count = np.bincount(doc[hit], minlength=piece.num_rows)
            yield pa.RecordBatch.from_arrays(
                [piece.column(1), pa.array(n), pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(score[hit])),
                 pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()),
                                          pa.array(hit - (np.cumsum(n) - n)[doc[hit]]))],
                ["toxic", "n", "scores", "places"])
    return run


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weighted ridge logistic regression; the first column is the constant.

    Newton steps are halved until the penalised likelihood grows, so nearly separable
    classes cannot throw the fit off. Columns are scaled to unit size while fitting.
    """
    size = np.maximum(np.abs(x).max(axis=0), 1e-9)
    x = x / size
    penalty = np.array([1e-3, *[ridge / 100] * (x.shape[1] - 1)])
    beta = np.zeros(x.shape[1])
    rate = np.clip(np.average(y, weights=w), 1e-4, 1 - 1e-4)
    beta[0] = np.log(rate / (1 - rate))
    loss = lambda b: float((w * (np.logaddexp(0, x @ b) - y * (x @ b))).sum() + (penalty * b * b).sum() / 2)
    now = loss(beta)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        slope = x.T @ (w * (y - p)) - penalty * beta
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), slope)
        share = 1.0
        while share > 1e-6 and loss(beta + share * step) > now:
            share /= 2
        after = loss(beta + share * step)
        if share <= 1e-6 or now - after < 1e-9 * max(now, 1.0):
            break
        beta, now = beta + share * step, after
    return beta / size


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model | None:
    """Model from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``; None without two classes."""
    spark = docs.sparkSession
    known = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id")
             .agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where("toxic in (0, 1)"))
    total = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(total) < 2:
        return None
    order = F.xxhash64("doc_id", F.lit(5))
    chosen = known.where("toxic = 0").orderBy(order).limit(rows).unionByName(
        known.where("toxic = 1").orderBy(order).limit(rows))
    sample = kept(docs.join(F.broadcast(chosen), "doc_id").select("text", "toxic"), "labelled")   # 2 * rows at most
    counts = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return None
    n1, n0 = counts[1], counts[0]
    in_toxic = (sample.where("toxic = 1").select("text").mapInArrow(_documents_with, "token long, n long")
                .groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_DOCS)
                .orderBy(F.desc("n"), "token").limit(CANDIDATES).toPandas())
    token = in_toxic["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(token)
    token, y1 = token[order], in_toxic["n"].to_numpy(np.float64)[order]
    y0 = np.zeros(len(token))
    if len(token):
        shared = spark.sparkContext.broadcast(token)
        in_clean = (sample.where("toxic = 0").select("text").mapInArrow(_documents_of(shared), "at long, n long")
                    .groupBy("at").agg(F.sum("n").alias("n")).toPandas())
        y0[in_clean["at"].to_numpy(np.int64)] = in_clean["n"].to_numpy(np.float64)
    prior = PRIOR * (y1 + y0 + 1) / (n1 + n0 + 2)
    score = np.log((y1 + prior) / (n1 + PRIOR)) - np.log((y0 + prior) / (n0 + PRIOR))
    error = np.sqrt(1 / (y1 + prior) + 1 / (y0 + prior))
    take = score - 2 * error > LEAST
    model = Model(token[take], score[take])
    hits = sample.mapInArrow(_hits(spark.sparkContext.broadcast(model)),
                             "toxic int, n long, scores array<double>, places array<long>").collect()
    toxic = np.array([r["toxic"] for r in hits])
    n = np.array([r["n"] for r in hits], np.int64)
    many = np.array([len(r["scores"]) for r in hits])
    q1 = (many[toxic == 1].sum() + 0.5) / (n[toxic == 1].sum() + 1)
    q0 = (many[toxic == 0].sum() + 0.5) / (n[toxic == 0].sum() + 1)
    model.drift = min(float(np.log((1 - q1) / (1 - q0))), -1e-3)
    clean = [s for r in hits if r["toxic"] == 0 for s in r["scores"]]
    excess = lambda rate: (1 - q0) * np.exp(rate * model.drift) + np.exp(rate * np.array(clean)).sum() / max(n[toxic == 0].sum(), 1) - 1
    low, high = 0.05, 3.0
    if clean and excess(low) < 0 < excess(high):
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if excess(mid) < 0 else (low, mid)
        model.rate = low
    found = [(i, *s) for i, r in enumerate(hits) if len(r["scores"])
             for s in maximal_segments(r["places"], r["scores"], model.drift)]
    best = np.zeros(len(hits))
    for i, s, _, _ in found:
        best[i] = max(best[i], s)
    rivals = ((best > 0) & (toxic == 0)).sum() + 0.5
    model.k = float(rivals / max(n[toxic == 0].sum() * np.exp(-model.rate * LEAST), 1.0))
    e = evidence(n, found, model)
    weight = np.where(toxic == 1, total[1] / n1, total[0] / n0)
    model.curve = _logistic(np.column_stack([np.ones(len(e)), e, np.log1p(e)]), toxic, weight)
    return model


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for piece in slices(batches):
            if m is None:
                p, found = np.zeros(piece.num_rows), []
            else:
                n, found = passages(*utf8(piece.column(2)), m)
                p = m.probability(evidence(n, found, m))
            spans: list[list] = [[] for _ in range(piece.num_rows)]
            for d, s, first, last in found:
                spans[d].append({"score": s, "first_word": first, "last_word": last})
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), piece.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32)),
                 pa.array(spans, SPANS)], ["doc_id", "held_out", "score", "predicted", "passages"])
    return run


SPANS = pa.list_(pa.struct([("score", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())]))
SCORED = ("doc_id long, held_out boolean, score double, predicted int, "
          "passages array<struct<score: double, first_word: long, last_word: long>>")


def score(docs: DataFrame, labels: DataFrame, held_out=None, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted, passages`` of every row; learns from labels that are not held out.

    ``held_out`` is a function of an id column.
    """
    out = held_out or (lambda c: F.lit(False))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where(~out(F.col("doc_id")))
    model = docs.sparkSession.sparkContext.broadcast(fit(texts, marks))
    return texts.select("doc_id", out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(_score(model), SCORED)


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               limit: float = 0.5) -> DataFrame:
    """Rows of ``docs``, all columns, whose score is below ``limit``; one pass, nothing moves."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    model = docs.sparkSession.sparkContext.broadcast(fit(texts, marks))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for piece in slices(batches, f"c{at}"):
            if m is None:
                yield piece
                continue
            n, found = passages(*utf8(piece.column(at)), m)
            yield piece.filter(pa.array(m.probability(evidence(n, found, m)) < limit))

    return map_rows(docs, run)


def held_out_fold(doc_id):
    return crc_mod(doc_id, 5) == 0


def op7_toxic_segments(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"),
                 held_out_fold).drop("passages")
