"""Operators made of built-in functions, against DuckDB or plain Python."""

import hashlib
import re
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cohortica.llm.fingerprints import fingerprints
from cohortica.llm.mixing import document_levels, mix, share_budget
from cohortica.llm.quality import quality
from cohortica.llm.sharding import shard, splitters
from tools.check_oracle import table

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

NATIVE = ["op3_merkle_fingerprints", "op5_line_frequency_quality", "op9_hierarchical_mixture", "op11_typed_chat_format"]


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables not present")
@pytest.mark.parametrize("name", NATIVE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for name_ in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {name_} AS SELECT * FROM '{SF}/{name_}.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    df = entry.queries()[name](spark, SF)
    assert table(df.columns, df.collect()) == table([d[0] for d in cur.description], cur.fetchall())


def test_no_python_in_native_plans(spark):
    for name in NATIVE:
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().toString()
        assert not re.search("Python|Arrow|Pandas", plan)


def test_quality_counts(odd_docs, no_docs):
    got = {(r["doc_id"], r["n_words"]): r for r in quality(odd_docs).collect()}
    for row in odd_docs.collect():
        text = row["text"] or ""
        words = WORD.findall(text)
        seen = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
        hit = {j for i in range(len(words) - 7) if seen[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        r = got[(row["doc_id"], len(words))]
        assert r["word_chars"] == sum(map(len, words)) and r["n_repeat_words"] == len(hit)
        assert r["n_symbols"] == len(re.findall("[#*$%&|<>]", text)) and r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["base_failed"] == (len(words) < 20 or 100 * len(hit) > 30 * len(words))
    assert quality(no_docs).collect() == []


def test_quality_repeats(spark):
    texts = [" ".join("abcdefgh") * 1 + " " + " ".join("abcdefgh"), " ".join("ab" * 30), "x " * 25, " ".join(map(str, range(40)))]
    rows = quality(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit("s")))
    assert [r["n_repeat_words"] for r in rows.orderBy("doc_id").collect()] == [16, 60, 25, 0]


def test_common_lines_deplete(spark):
    own = lambda i: " ".join(f"own{i}w{j}" for j in range(25))
    spam = "Subscribe to our great newsletter now and read all of the daily news of page 5"
    rows = [(i, f"{own(i)}\n{spam}", "h") for i in range(30)] + [(100, f"{spam}\n{spam.upper()}", "h")]
    rows += [(200 + i, f"{own(i)}\n{spam}", "other") for i in range(5)]
    out = {r["doc_id"]: r for r in quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(out[i]["kept"] and out[i]["removed_lines"] == 1 for i in range(30))
    assert not out[100]["kept"] and not out[100]["base_failed"] and out[100]["removed_lines"] == 2
    assert out[200]["removed_lines"] == 0                       # its host has few copies


def tree(text):
    h = lambda tag, s: hashlib.sha256((tag + s).encode()).hexdigest()
    leaves = [[[h("s", s) for s in p.split(". ")] for p in x.split("\n")] for x in text.split("\n\n")]
    root = h("r", "".join(h("x", "".join(h("p", "".join(p)) for p in x)) for x in leaves))
    return root, {s[:16] for x in leaves for p in x for s in p}


def test_fingerprints(odd_docs, no_docs):
    docs = odd_docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    texts = [(r["doc_id"], r["text"] or "") for r in docs.orderBy("doc_id").collect()]
    got = {r["doc_id"]: r for r in fingerprints(docs).collect()}
    for i, (doc, text) in enumerate(texts):
        follow = texts[(i + 1) % len(texts)][1]
        half = len(text) // 2
        edited = text[:len(text) - half] + follow[:half]
        r, (root, leaves), (edited_root, edited_leaves), (_, next_leaves) = got[doc], tree(text), tree(edited), tree(follow)
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == root and r["edited_fingerprint"] == edited_root
        assert r["near_edited"] == len(leaves & edited_leaves) / len(leaves | edited_leaves)
        assert r["near_next"] == len(leaves & next_leaves) / len(leaves | next_leaves)
        assert (r["first_edit"] == 0) == (root == edited_root)
    assert fingerprints(no_docs).collect() == []
    assert fingerprints(odd_docs).count() == odd_docs.count()


def test_edit_is_located(spark):
    text = "\n".join(f"Paragraph {i}. It has two sentences." for i in range(10))
    docs = spark.createDataFrame([(1, text), (2, "z" * 1000)], "doc_id long, text string")
    row = fingerprints(docs).where("doc_id = 1").first()
    half = len(text) - len(text) // 2
    assert row["first_edit"] == text[:half].count("\n") + 1


def test_fingerprints_over_many_ranges(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        texts = {i * i: f"text {i} " + "y" * (i % 5) for i in range(300)}
        rows = fingerprints(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
        ids = sorted(texts)
        for r in rows:
            text, follow = texts[r["doc_id"]], texts[ids[(ids.index(r["doc_id"]) + 1) % len(ids)]]
            edited = text[:len(text) - len(text) // 2] + follow[:len(text) // 2]
            assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert len(rows) == 300
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_share_budget(spark):
    rows = [("a", "x", 10.0, 1.0, 90.0), ("a", "y", 100.0, 1.0, 90.0), ("a", "z", 20.0, 2.0, 90.0),
            ("b", "x", 5.0, 1.0, 5.0), ("c", "x", 50.0, 3.0, 40.0), ("c", "y", 50.0, 1.0, 40.0)]
    df = spark.createDataFrame(rows, "f string, n string, supply double, weight double, budget double")
    got = {(r["f"], r["n"]): r["given"] for r in share_budget(df, ["f"]).collect()}
    assert got == {("a", "x"): 10.0, ("a", "y"): 60.0, ("a", "z"): 20.0, ("b", "x"): 5.0, ("c", "x"): 30.0, ("c", "y"): 10.0}


def test_mixture_takes_prefixes_and_epochs(odd_docs, no_docs, spark):
    out = mix(odd_docs, document_levels(), {}, 3.0, 4)
    assert out.select("doc.*").columns == odd_docs.columns
    total = odd_docs.select(F.sum(F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) + 1)).first()[0]
    assert out.agg(F.sum("tokens")).first()[0] <= 3 * total
    assert mix(no_docs, document_levels(), {}, 1.0).collect() == []
    docs = spark.createDataFrame([(i, "w " * 9, l, s) for i, (l, s) in enumerate([("en", "src1")] * 60 + [("de", "src2")] * 20)],
                                 "doc_id long, text string, lang string, source string")
    rows = mix(docs, document_levels(), {}, 0.5, 4).collect()
    took = Counter(r["language"] for r in rows)
    assert took == {"en": 20, "de": 20}                          # half of 800 tokens, in equal parts
    assert Counter(r["epoch"] for r in mix(docs, document_levels(), {}, 1.0, 4).where("language = 'de'").collect()) == {0: 20, 1: 20}


def test_shards(odd_docs, no_docs, spark):
    def check(docs, shards):
        texts = Counter((r["doc_id"], len((r["text"] or "").encode()) + 16) for r in docs.collect())
        rows = shard(docs, shards).collect()
        assert Counter((r["doc_id"], r["size"]) for r in rows) == texts
        slots = {}
        for r in rows:
            slots.setdefault(r["shard"], []).append(r["slot"])
            assert 0 <= r["shard"] < shards and r["law"] == "bytes" and r["grown_shard"] is None
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
        return rows
    check(odd_docs, 4)
    assert shard(no_docs).collect() == []
    rows = [(i, f"text {i} " * (1 + i % 7)) for i in range(3000)] + [(5000 + i, "the same text again") for i in range(1500)]
    got = check(spark.createDataFrame(rows, "doc_id long, text string"), 8)
    load = Counter()
    for r in got:
        load[r["shard"]] += r["size"]
    assert max(load.values()) < 1.05 * sum(load.values()) / 8 and len(load) == 8


def test_splitters_isolate_a_heavy_key():
    bounds = splitters([(1, 1.0), (2, 1.0), (5, 10.0), (9, 1.0)], 3.0)
    assert {5, 6} <= bounds
