"""Fitted operators, against brute force on small tables and on held-out rows."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from cohortica.llm import pitman_yor, sketch
from cohortica.llm.boosting import Trees, threshold
from cohortica.llm.common import crc_mod, mix, range_index, words as hashed_words
from cohortica.llm.language import identify
from cohortica.llm.pii import KINDS, base_spans, find, fit, luhn, redact, redacted, spans_of
from cohortica.llm.pitman_yor import draw_tables, pair_probabilities, stirling
from cohortica.llm.toxicity import _logistic, drop_toxic, maximal_segments, score

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return WORD.findall((text or "").translate(LOW))


# ---- helpers ---------------------------------------------------------------------------------

def test_range_index(spark):
    for n in (0, 1, 2, 5, 30):
        bounds = sorted(random.Random(n).sample(range(-50, 50), n))
        rows = spark.createDataFrame([(i,) for i in [None, *range(-60, 60)]], "x long").select("x", range_index(F.col("x"), bounds).alias("i"))
        assert all(r["i"] == sum(b <= r["x"] for b in bounds) if r["x"] is not None else r["i"] == 0 for r in rows.collect())


def test_distinct_counter():
    for n in (0, 10, 5000, 300_000):
        registers = np.zeros(sketch.REGISTERS, np.int32)
        sketch.observe(registers, mix(np.arange(n, dtype=np.uint64)))
        assert abs(sketch.distinct(registers) - n) <= 0.05 * n + 1


# ---- personal data ---------------------------------------------------------------------------

def plain_spans(t):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
            if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t)
            if 16 <= len(d := re.sub("[^0-9]", "", m.group())) <= 19 and luhn(d)]
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t)
                  if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


def test_base_spans_equal_the_patterns():
    rng = random.Random(1)
    for _ in range(20_000):
        t = "".join(rng.choice("ab_@@..--  1230+()é4") for _ in range(rng.randint(0, 40)))
        assert sorted(base_spans(t)) == sorted(plain_spans(t))
    card = "4111 1111 1111 1111 and 4111-1111-1111-1112, 10.20.30.40.50, +1 (212) 555-0199."
    assert sorted(base_spans(card)) == sorted(plain_spans(card)) and len(base_spans(card)) == 3


def test_base_spans_are_linear():
    for t in ("1" * 300_000, "a" * 300_000, "1." * 150_000, "a@" * 150_000, "+1" * 100_000, "1 " * 150_000, "a.b" * 100_000):
        assert base_spans(t) == [] or len(t) > 0


def private_docs(spark, n=1500):
    rng = random.Random(3)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def card():
        body = "4" + digits(14)
        return body + next(c for c in "0123456789" if luhn(body + c))
    makers = [lambda: f"{rng.choice('abcdef')}{digits(2)}@mail{digits(1)}.example.com", lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
              card, lambda: f"+1 ({digits(3)}) 555-{digits(4)}", lambda: digits(16), lambda: f"v{digits(1)}.{digits(1)}.{digits(2)}", lambda: "nothing"]
    text = lambda: " ".join([rng.choice(["the", "of", "thing", "call", "on", "with"]) for _ in range(12)] + [rng.choice(makers)()] + ["and", "more"])
    return spark.createDataFrame([(i, text()) for i in range(n)], "doc_id long, text string")


def test_added_spans(spark):
    model = fit(private_docs(spark))
    hit = lambda t: [(KINDS[k], t[s:e]) for k, s, e in spans_of(t, model)[1]]
    assert hit("call 212-555-0199 now") == [("phone", "212-555-0199")]
    assert hit("host 10[.]0[.]0[.]1 is up") == [("ip", "10[.]0[.]0[.]1")]
    assert hit("paid with 4111.1111.1111.1111 here") == [("card", "4111.1111.1111.1111")]
    for clean in ("version 1.2.3 of 2024-01-15", "look at the dot com boom", "born 1999-12-31, paid 1,234,567", "id 1234567890123456 here"):
        assert hit(clean) == []


def test_neighbouring_numbers_are_added(spark):
    model = fit(private_docs(spark))
    hit = lambda t: [(KINDS[k], t[s:e]) for k, s, e in spans_of(t, model)[1]]
    assert hit("of 4539578763621486 4716461583322103 and more") == [("card", "4539578763621486"), ("card", "4716461583322103")]
    assert hit("of +1 (826) 555-4081 190.137.223.204 and more") == [("phone", "+1 (826) 555-4081")]
    many = " ".join(["4539578763621486"] * 20)
    assert len(hit(f"the {many} and more")) == 20
    start = time.monotonic()
    spans_of("1 " * 20_000, model)
    short = time.monotonic() - start
    spans_of("1 " * 80_000, model)
    assert time.monotonic() - start - short < 8 * short + 1


def test_bracketed_at_with_plain_dot_is_added(spark):
    model = fit(private_docs(spark))
    for body in ("b27(at)mail5.example.com", "b27[at]mail5.example.com", "b27(AT)mail5.example.com"):
        assert [(KINDS[k], s, e) for k, s, e in spans_of(f"the thing with {body} and more", model)[1]] == [("email", 15, 15 + len(body))]
    assert spans_of("meet (at)noon or [at] home", model) == ([], [])


def test_find_and_redact(odd_docs, no_docs, spark):
    for row in find(odd_docs).collect():
        assert row["base_sha256"] and row["n_email"] >= 0
    texts = {r["doc_id"]: r["text"] or "" for r in odd_docs.collect()}
    row = find(odd_docs).where("doc_id = 12").first()
    spans = sorted(plain_spans(texts[12]))
    written = ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)
    assert row["spans"] == written and row["base_sha256"] == hashlib.sha256(written.encode()).hexdigest()
    assert (row["n_email"], row["n_ip"], row["n_card"], row["n_phone"]) == (1, 1, 1, 1)
    out = redact(odd_docs)
    assert out.columns == odd_docs.columns
    clean = out.where("doc_id = 12").first()
    assert clean["text"] == "mail [EMAIL], [PHONE], [IP] and [CARD] end" and clean["n_chars"] == len(clean["text"])
    assert out.where("doc_id = 6").count() == 2 and find(no_docs).collect() == [] and redact(no_docs).collect() == []
    assert redacted(None, None) is None and redacted("x a@b.c", None) == "x [EMAIL]"


def test_trees_learn_and_calibrate():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    model = Trees().fit(x[:2000], y[:2000]).calibrate(x[2000:3000], y[2000:3000])
    p = model.probability(x[3000:])
    assert ((p > 0.5) == (y[3000:] > 0.5)).mean() > 0.97
    assert 0.5 <= threshold(p, y[3000:], 0.99, 0.5) < 1 and threshold(np.array([0.9]), np.array([0.0]), 0.99, 0.5) > 1


# ---- toxicity --------------------------------------------------------------------------------

def brute_segments(scores):
    """All maximal scoring segments by their definition: the best one, then both sides of it."""
    if not scores or max(scores) <= 0:
        return []
    best = max(((sum(scores[i:j]), -(j - i), -i, i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)))
    i, j = best[3], best[4]
    shift = [(s, a + j, b + j) for s, a, b in brute_segments(scores[j:])]
    return brute_segments(scores[:i]) + [(best[0], i, j - 1)] + shift


def test_segments_equal_brute_force():
    rng = random.Random(2)
    for _ in range(400):
        n, drift = rng.randint(0, 25), -0.37
        scores = [rng.choice([1.13, 2.71]) if rng.random() < 0.3 else drift for _ in range(n)]
        places = [i for i, s in enumerate(scores) if s > 0]
        got = maximal_segments(places, [scores[i] for i in places], drift)
        assert [(round(s, 6), a, b) for s, a, b in got] == [(round(s, 6), a, b) for s, a, b in brute_segments(scores)]


def test_curve_survives_nearly_separable_classes():
    rng = np.random.default_rng(8)
    y = (np.arange(16_000) % 9 == 0).astype(int)
    e = np.where(y == 1, rng.gamma(9, 9, len(y)), 0.0)
    e[rng.integers(0, len(y), 30)] = 4.0
    for w in (np.ones(len(y)), np.where(y == 1, 1.0, 5.5)):
        beta = _logistic(np.column_stack([np.ones(len(e)), e, np.log1p(e)]), y, w)
        z = beta[0] + beta[1] * e + beta[2] * np.log1p(e)
        assert beta[0] < -2 and ((z > 0) == (y == 1)).mean() > 0.99


def toxic_docs(spark, n=600):
    rng = random.Random(7)
    word = lambda: rng.choice("abcdefg") + rng.choice("aeiou") + rng.choice("klmnrst") + rng.choice("aeiou")
    rows = []
    for i in range(n):
        text = [word() for _ in range(60)]
        toxic = int(i % 5 == 0)
        for k in range(4 * toxic):
            text.insert(rng.randrange(len(text)), rng.choice(["scumbag", "Vilefool", "vileness"]))
        rows.append((i, " ".join(text), toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_toxic_scores(spark, odd_docs, no_docs):
    docs = toxic_docs(spark)
    fold = lambda c: crc_mod(c, 5) == 0
    rows = score(docs.drop("toxic"), docs.select("doc_id", "toxic"), fold).collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert r["predicted"] == int(r["doc_id"] % 5 == 0) and 0 <= r["score"] <= 1
    left = drop_toxic(docs, docs.select("doc_id", "toxic"))
    assert left.columns == docs.columns and {r["toxic"] for r in left.collect()} == {0} and left.count() == 480
    labels = docs.select("doc_id", "toxic")
    assert score(odd_docs, labels).count() == odd_docs.count() and score(no_docs, labels).collect() == []
    one_class = spark.createDataFrame([(1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    assert {r["score"] for r in score(odd_docs, one_class).collect()} == {0.0}
    assert drop_toxic(odd_docs, one_class).count() == odd_docs.count()


# ---- language model --------------------------------------------------------------------------

def test_base_scores_and_perplexity(spark, odd_docs, no_docs):
    rng = random.Random(4)
    follow = {c: rng.sample("abcdefghijklmnop", 3) for c in "abcdefghijklmnop"}
    rows = []
    for i in range(400):
        w = [rng.choice("abcdefghijklmnop")]
        while len(w) < 30:
            w.append(rng.choice(follow[w[-1]]))
        rows.append((i, " ".join(w) + (" rare%d" % i if i % 3 == 0 else "")))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = pitman_yor.score(docs, crc_mod(F.col("doc_id"), 7) == 2).collect()
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    tokens = {i: [*words_of(t), None] for i, t in rows}
    count = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(count.values()), len(count)
    better = 0
    for r in out:
        ws = tokens[r["doc_id"]]
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws)
        assert abs(base - r["base_score"]) < 1e-6 and r["train_tokens"] == n and r["n_tokens"] == len(ws)
        assert r["n_known"] == sum(count[w] > 0 for w in ws) and r["held_out"] == held[r["doc_id"]] and r["score"] < 0
        better += r["score"] > base
    assert better == len(out)
    assert pitman_yor.score(odd_docs).count() == odd_docs.count() and pitman_yor.score(no_docs).collect() == []
    nothing = pitman_yor.score(odd_docs, F.lit(True)).collect()
    assert {r["base_score"] for r in nothing} == {0.0} and all(abs(r["score"]) < 1e-6 for r in nothing)


def test_table_counts_follow_their_conditional():
    """For few customers against the sum over all seatings: set partitions, each block of n weighing a (1-d)_(n-1)."""
    def partitions(n):
        if n == 0:
            yield []
            return
        for rest in partitions(n - 1):
            for i in range(len(rest)):
                yield rest[:i] + [rest[i] + 1] + rest[i + 1:]
            yield rest + [1]

    rng = np.random.default_rng(1)
    discount, a = 0.4, 0.7
    table = stirling(48, discount)
    for c in (2, 4, 7):
        weight = np.zeros(c + 1)
        for blocks in partitions(c):
            weight[len(blocks)] += math.prod(math.prod(i - discount for i in range(1, n)) for n in blocks)
        assert np.allclose(np.log(weight[1:]), table[c, 1:c + 1])
        p = weight * a ** np.arange(c + 1)
        drawn = np.bincount(draw_tables(np.full(40_000, c), np.full(40_000, a), discount, table, rng), minlength=c + 1)
        assert np.abs(drawn / 40_000 - p / p.sum()).max() < 0.01
    many = draw_tables(np.full(2000, 5000), np.full(2000, a), discount, table, rng)
    assert (many >= 1).all() and (many <= 5000).all() and draw_tables(np.array([0, 1]), np.array([a, a]), discount, table, rng).tolist() == [0, 1]


def test_predictive_probabilities_sum_to_about_one():
    rng = np.random.default_rng(3)
    vocabulary, contexts = 40, 12
    word = mix(np.arange(1, vocabulary + 1, dtype=np.uint64)) >> np.uint64(24)
    context = np.unique(mix(np.arange(500, 500 + contexts, dtype=np.uint64)) >> np.uint64(40))
    keys = np.sort(np.add.outer(word << np.uint64(24), context).ravel())
    count = rng.poisson(rng.gamma(0.3, 6, len(keys)))
    cells = np.zeros(1 << pitman_yor.CELLS_LOG2, np.int64)
    np.add.at(cells, ((keys >> np.uint64(2)) & np.uint64((1 << pitman_yor.CELLS_LOG2) - 1)).astype(np.int64), count)
    extra = {"words": np.zeros(0, np.uint64), "counts": np.zeros(0, np.int64), "cells": cells,
             "pairs": float((count > 0).sum()), "vocabulary": float(vocabulary)}
    p, total, known = pair_probabilities(keys, count, extra, 5)
    assert known == vocabulary and (p > 0).all()
    for c in context:
        assert 0.75 < p[(keys & np.uint64((1 << 24) - 1)) == c].sum() < 1.25


def test_contexts_are_counted_one_by_one(spark, monkeypatch):
    """Two contexts whose hashes share 24 bits keep their own bigrams and customers, on the common and the rare path."""
    names = [f"w{i}" for i in range(20_000)]
    raw = " ".join(names).encode()
    h, _ = hashed_words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    top = h >> np.uint64(40)
    order = np.argsort(top)
    k = int(np.flatnonzero(top[order][1:] == top[order][:-1])[0])
    a, b = names[order[k]], names[order[k + 1]]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    train, free = [i for i in range(700) if not held(i)][:400], [i for i in range(700) if held(i)][:2]
    rows = [(i, f"{a} x" if n % 2 else f"{b} y") for n, i in enumerate(train)] + [(free[0], f"{a} x"), (free[1], f"{b} x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    scores = []
    for common in (1 << 16, 1):
        monkeypatch.setattr(pitman_yor, "COMMON", common, raising=False)
        scores.append({r["doc_id"]: r["score"] for r in pitman_yor.score(docs, crc_mod(F.col("doc_id"), 7) == 2).collect()})
    assert scores[0].keys() == scores[1].keys() and all(abs(scores[0][i] - scores[1][i]) < 1e-6 for i in scores[0])
    # a or b is even; after a comes x in all training texts, after b in none
    assert abs(scores[0][free[0]] - math.log10(0.5)) < 0.2 and scores[0][free[1]] < scores[0][free[0]] - 1


# ---- language --------------------------------------------------------------------------------

def test_language(spark, odd_docs, no_docs):
    rng = random.Random(6)
    parts = {"aa": ["the", "ing", "and", "sh"], "bb": ["ñor", "ción", "que", "lla"], "cc": ["ßen", "sch", "ung", "ver"]}
    rows = [(i, " ".join("".join(rng.choice(parts[l]) for _ in range(3)) for _ in range(20)), l)
            for i, l in enumerate(rng.choice(sorted(parts)) for _ in range(300))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = identify(docs, crc_mod(F.col("doc_id"), 4) == 2).collect()
    lang = {i: l for i, _, l in rows}
    assert all(r["lang_pred"] == lang[r["doc_id"]] and 0 < r["score"] <= 1 for r in out) and len(out) == 300
    odd = {(r["doc_id"], r["lang_pred"]): r["score"] for r in identify(odd_docs).collect()}
    assert odd[(1, "und")] == odd[(2, "und")] == odd[(3, "und")] == 0.0 and (4, "en") in odd
    assert identify(no_docs).collect() == []
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in identify(unlabelled).collect()} == {"und"}
