"""Operator 12: exact divergences against a plain computation, and the defined cases."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from cohortica.llm import divergence
from cohortica.llm.divergence import divergences, shares


def plain(rows, min_docs, top=10):
    counts, docs, groups = defaultdict(Counter), Counter(), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in terms]
        counts[lang, source].update(terms)
        docs.update((lang, t) for t in set(terms))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted((t for (l, t), n in docs.items() if l == lang and n >= min_docs), key=str.encode)
        sources = sorted(s for l, s in groups if l == lang)
        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])

        def share(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        p, q = {s: share(counts[lang, s]) for s in sources}, share(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, v, i) for i, (v, item) in enumerate(found[:most], 1)}
    return out


@pytest.mark.parametrize("cells", [1 << 15, 1])
def test_against_plain_computation(spark, odd_docs, monkeypatch, cells):
    monkeypatch.setattr(divergence, "CELLS", cells)                       # 1: many shards
    rng = np.random.default_rng(2)
    vocabulary = ["Éa", "éa", "the", "THE", "x", "ß", "日本", "mid-dle", "a1b"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(" ".join(rng.choice(vocabulary, rng.integers(0, 30))), ["en", "de", None][i % 3], f"s{rng.integers(0, 5)}")
            for i in range(200)]
    rows += [("once only", "zz", "a"), (None, "zz", "b"), ("lonely", "yy", None), ("", "en", "never"), ("tail", "en", "never")]
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    got = {tuple(r) for r in divergences(df, min_docs=4).collect()}
    assert got == plain(rows, 4)
    odd = [(r.text, r.lang, r.source) for r in odd_docs.collect()]
    assert {tuple(r) for r in divergences(odd_docs, min_docs=2).collect()} == plain(odd, 2)


def test_long_division_is_exact_beyond_64_bit_products():
    counts, total, terms = np.array([0, 5, 10**13, 3 * 10**15]), np.int64(3 * 10**15 + 10**13 + 5), 4
    assert shares(counts, total, terms).tolist() == [1 + 10**9 * (int(c) + 2) // (int(total) + 8) for c in counts]
    assert shares(np.array([7]), np.int64(7), 1).tolist() == [1 + 10**9]


def test_empty_table(spark, no_docs):
    assert divergences(no_docs).count() == 0
