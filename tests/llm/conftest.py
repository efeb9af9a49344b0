"""Fixtures for the training-data operators: one odd little table with every special case."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, keep string, `a.b` int"
CLASHING = (None, "row", 7)


def rows_of(texts, start=1):
    return [(i, t, "en", f"src{i % 3}", len(t or ""), *CLASHING) for i, t in enumerate(texts, start)]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, blanks, long text, copies, near copies, repeated rows, a null id; extra clashing columns."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    body = [word() for _ in range(300)]
    near = body[:]
    near[150] = "changed"
    texts = [None, "", "  \n\t ", "one", "a b c d", " ".join(body), " ".join(body), " ".join(near),
             " ".join(word() for _ in range(30_000)), "x" * 200_000, "Same line\nSame line\nother line here",
             "mail a.b@c.org, +1 (212) 555-0199, 10.0.0.1 and 4111 1111 1111 1111 end", "é ß ñ\n\nzwei Absätze. Noch einer."]
    rows = rows_of(texts)
    rows.append(rows[5])
    rows.append((None, "no id but some text", None, None, None, *CLASHING))
    rows.append((None, None, None, None, None, None, None, None))
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
