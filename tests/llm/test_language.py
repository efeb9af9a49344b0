"""Operator 10 against a plain computation; letters beyond a-z keep their own vectors."""

import numpy as np
from pyspark.sql import functions as F

from cohortica.llm import language
from cohortica.llm.language import Profiles, identify


def plain_vector(text, dims, seed=language.SEED):
    letter = lambda c: np.random.default_rng([seed, ord(c) if c.isalpha() else 0]).choice([-1.0, 1.0], dims)
    out = np.zeros(dims)
    for word in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split():
        padded = f" {word} "
        for a, b, c in zip(padded, padded[1:], padded[2:]):
            out += np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c)
    return out


TEXTS = ["hello world", "Äpfel, Öl und Übermut! äöü", "привет мир, это текст", "日本語の文章です", "a1b2 c", "", None, "…!?", "ß" * 50,
         "mixed привет hello 日本"]


def test_vectors_match_a_plain_computation():
    made = Profiles(64)
    for most in (40_000, 7):                                    # also with a store that overflows within a text
        language.MOST, before = most, language.MOST
        try:
            got = made.texts(TEXTS)
        finally:
            language.MOST = before
        for text, v in zip(TEXTS, got):
            np.testing.assert_array_equal(v, plain_vector(text, 64))


def test_letters_a_hundred_code_points_apart_differ():
    made = Profiles(256)
    a, b = made.texts([chr(0x4E00 + 5) * 3, chr(0x4E00 + 105) * 3])
    assert abs(a @ b) / np.sqrt((a @ a) * (b @ b)) < 0.4


def test_predictions_match_a_plain_computation(spark):
    rng = np.random.default_rng(1)
    alphabets = {"aa": "abcdefgh", "bb": "ijklmnop", "cc": "абвгдежз", "dd": "ийклмноп"}
    rows = [(i, lang, " ".join("".join(rng.choice(list(letters), 4)) for _ in range(6)), i % 3 == 0)
            for i, (lang, letters) in enumerate(list(alphabets.items()) * 15)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string, held boolean").repartition(4)
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify(df, F.col("held")).collect()}
    unit = lambda v: v / max(np.linalg.norm(v), 1e-12)
    vectors = {i: unit(plain_vector(t, language.DIMENSIONS)) for i, _, t, _ in rows}
    proto = {g: unit(sum(vectors[i] for i, h, _, held in rows if h == g and not held)) for g in alphabets}
    for i, lang, _, held in rows:
        cosine = {g: round(float(vectors[i] @ p), 6) for g, p in proto.items()}
        assert got[i][0] == max(sorted(cosine), key=cosine.get) and abs(got[i][1] - max(cosine.values())) < 1e-5
        assert not held or got[i][0] == lang
