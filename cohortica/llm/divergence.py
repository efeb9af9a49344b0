"""Source divergence audit (operator 12): term counts of sources and languages compared exactly.

1. ``mapInArrow`` over whole texts runs an Arrow compute pipeline (``ascii_lower``,
   ``split_pattern_regex``, ``dictionary_encode``, hash ``group_by``): partial counts of
   (language, source, term), merged within a task before they leave it.
2. Spark merges the partial counts and gathers, for every term of a language in at least
   ``min_docs`` of its documents, its counts by source: one row a term, never more entries than
   sources. These rows are written once.
3. The kept terms of a language are dealt into shards, so many that a shard's matrix (terms x
   sources) stays near ``CELLS``. Each shard meets the totals of its language and sums, in 64-bit
   integers, the terms' parts of the divergence for every pair of sources, and its own ten top
   terms a source. Spark adds the sums and ranks them.

All arithmetic is exact: quotients are long divisions in base 1,000, so no product leaves 64 bits
while a language has under 9 * 10^15 terms.

Null texts, languages and sources are ''. A document is a row: repeated rows and rows without an
id count each. Groups without a term count 0 everywhere; a language without kept terms has pairs
of value 0 and no terms. Very long texts are whole: a slice holds one text at least. An empty
table gives an empty result. Other columns are not looked at. Pairs of sources are the result
itself: a language of S sources has S * (S - 1) rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from cohortica.llm.common import kept, slices

SPLIT = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
BILLION_STEPS = 3                 # 1,000 ** 3
CELLS = 1 << 15                   # cells of a shard's matrix
MERGE_ROWS = 1 << 20              # partial counts held in a task before they are merged
COUNTS = "lang string, source string, term string, n bigint, docs bigint"
_KEYS = ["lang", "source", "term"]


def _slice_counts(batch: pa.RecordBatch) -> pa.Table:
    """Occurrences and documents of every (language, source, term) of a batch; each group has a row with a null term."""
    text = pc.ascii_lower(batch.column("text").cast(pa.string()).fill_null(""))
    lists = pc.split_pattern_regex(text, pattern=SPLIT)
    row, term = pc.list_parent_indices(lists), pc.list_flatten(lists)
    word = pc.not_equal(term, "")                                       # before the first and after the last separator
    row, coded = row.filter(word), term.filter(word).dictionary_encode()
    by_row = pa.table({"row": row, "code": coded.indices}).group_by(["row", "code"]).aggregate([([], "count_all")])
    lang = batch.column("lang").fill_null("").dictionary_encode()
    source = batch.column("source").fill_null("").dictionary_encode()
    at = by_row["row"].combine_chunks()
    table = pa.table({"lang": lang.indices.take(at), "source": source.indices.take(at), "term": by_row["code"],
                      "n": by_row["count_all"]})
    merged = table.group_by(_KEYS).aggregate([("n", "sum"), ([], "count_all")])
    all_of = pa.table({"lang": lang.indices, "source": source.indices}).group_by(["lang", "source"]).aggregate([])
    decode = lambda d, i: d.dictionary.take(i.combine_chunks())
    counts = pa.table({"lang": decode(lang, merged["lang"]), "source": decode(source, merged["source"]),
                       "term": decode(coded, merged["term"]), "n": merged["n_sum"].cast(pa.int64()),
                       "docs": merged["count_all"].cast(pa.int64())})
    zeros = pa.array(np.zeros(all_of.num_rows, np.int64))
    groups = pa.table({"lang": decode(lang, all_of["lang"]), "source": decode(source, all_of["source"]),
                       "term": pa.nulls(all_of.num_rows, pa.string()), "n": zeros, "docs": zeros})
    return pa.concat_tables([counts, groups])


def _merge(tables: list[pa.Table]) -> pa.Table:
    merged = pa.concat_tables(tables).group_by(_KEYS).aggregate([("n", "sum"), ("docs", "sum")])
    return merged.select([*_KEYS, "n_sum", "docs_sum"]).rename_columns([*_KEYS, "n", "docs"])


def partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    rows = 0
    for piece in slices(batches):
        held.append(_slice_counts(piece))
        rows += held[-1].num_rows
        if rows >= MERGE_ROWS:
            merged = _merge(held)
            held, rows = [merged], merged.num_rows
            if rows >= MERGE_ROWS // 2:                                 # hardly anything merges: pass it on
                yield from merged.to_batches(max_chunksize=1 << 16)
                held, rows = [], 0
    if held:
        yield from _merge(held).to_batches(max_chunksize=1 << 16)


def shares(counts: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """``1 + floor(10**9 * (count + 2) / (total + 2 * terms))``, by long division in base 1,000."""
    below = np.asarray(total, np.int64) + 2 * np.int64(terms)
    rest = counts.astype(np.int64) + 2
    out = rest // below
    rest = rest - out * below
    for _ in range(BILLION_STEPS):
        rest = rest * 1000
        digit = rest // below
        out = out * 1000 + digit
        rest = rest - digit * below
    return out + 1


def difference(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def _shard(terms: pa.Table, groups: pa.Table, top: int) -> pa.Table:
    """Sums over the terms of a shard for each pair of sources, and each source's top terms."""
    names = groups["source"].combine_chunks()
    order = pc.sort_indices(names)
    names = names.take(order)
    total = groups["total"].combine_chunks().take(order).to_numpy()
    sources, kept_terms, lang = len(names), groups["kept"][0].as_py(), groups["of_lang"][0]
    whole = groups["lang_total"][0].as_py()
    texts = terms["term"].combine_chunks()
    cells = terms["cells"].combine_chunks()
    counts = np.zeros((len(texts), sources), np.int64)
    if len(texts):
        flat = pc.list_flatten(cells)
        row, place = pc.list_parent_indices(cells).to_numpy(), pc.index_in(flat.field("source"), names).to_numpy()
        counts[row, place] = flat.field("n").to_numpy()
    p = shares(counts, total, kept_terms) if kept_terms else counts
    out: dict[str, list] = {"source": [], "part": [], "item": [], "value": []}

    def add(source, part, items, values):
        out["source"] += [source] * len(items)
        out["part"] += [part] * len(items)
        out["item"] += items
        out["value"] += values

    sums = np.zeros((sources, sources), np.int64)
    for g in range(sources - 1):
        if len(texts):
            sums[g, g + 1:] = difference(p[:, g:g + 1], p[:, g + 1:]).sum(axis=0)
    sums += sums.T
    listed = names.to_pylist()
    for g in range(sources):
        add(listed[g], "pair", listed[:g] + listed[g + 1:], np.delete(sums[g], g).tolist())
    if len(texts):
        q = shares(counts.sum(axis=1), np.int64(whole), kept_terms)
        rank = np.empty(len(texts), np.int64)
        rank[pc.sort_indices(texts).to_numpy()] = np.arange(len(texts))      # order of UTF-8 bytes
        for g in range(sources):
            over = np.flatnonzero((counts[:, g] > 0) & (p[:, g] > q))
            value = difference(p[over, g], q[over])
            best = np.lexsort((rank[over], -value))[:top]
            add(listed[g], "term", texts.take(pa.array(over[best])).to_pylist(), value[best].tolist())
    n = len(out["value"])
    return pa.table({"lang": pa.array([lang.as_py()] * n, pa.string()), "source": pa.array(out["source"], pa.string()),
                     "part": pa.array(out["part"], pa.string()), "item": pa.array(out["item"], pa.string()),
                     "value": pa.array(out["value"], pa.int64())})


def divergences(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                min_docs: int = 10, top: int = 10) -> DataFrame:
    """``lang, source, part, item, value, rank``: all pairs of a language's sources, and each source's ``top`` terms."""
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = docs.select(text(text_col).alias("text"), text(lang_col).alias("lang"), text(source_col).alias("source"))
    counts = rows.mapInArrow(partial_counts, COUNTS).groupBy(*_KEYS).agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    cells = F.collect_list(F.struct("source", "n")).alias("cells")
    terms = counts.groupBy("lang", "term").agg(cells, F.sum("docs").alias("docs"))
    terms = kept(terms.where(F.col("term").isNull() | (F.col("docs") >= min_docs)).select("lang", "term", "cells"), "terms")
    each = terms.select("lang", "term", F.explode("cells").alias("x"))
    totals = each.groupBy("lang", F.col("x.source").alias("source")).agg(
        F.sum("x.n").alias("total"))                                     # null terms name every group, with 0
    sizes = terms.groupBy("lang").agg(F.count("term").alias("kept"), F.max(F.size("cells")).alias("sources"))
    most = F.greatest(F.lit(CELLS), 16 * F.col("sources").cast("long") * F.col("sources"))
    sizes = kept(sizes.join(totals.groupBy("lang").agg(F.sum("total").alias("lang_total")), "lang").withColumn(
        "shards", F.greatest(F.lit(1), F.ceil(F.col("kept") * F.col("sources") / most)).cast("int")), "sizes")
    left = terms.where("term is not null").join(sizes.select("lang", "shards"), "lang").select(
        "lang", F.pmod(F.xxhash64("term"), F.col("shards")).alias("shard"), "term", "cells")
    right = totals.join(sizes, "lang").select(
        "lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards").cast("long") - 1)).alias("shard"),
        "source", "total", "kept", "lang_total").toDF("of_lang", "of_shard", "source", "total", "kept", "lang_total")
    parts = left.groupBy("lang", "shard").cogroup(right.groupBy("of_lang", "of_shard")).applyInArrow(
        lambda a, b: _shard(a, b, top), "lang string, source string, part string, item string, value bigint")
    summed = parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return summed.withColumn("rank", F.row_number().over(order)).where((F.col("part") == "pair") | (F.col("rank") <= top))


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    return divergences(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
t AS (SELECT id, lang, source, translate(unnest(ts), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
gn AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY lang, source),
gp AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n,
  1 + (1000000000::HUGEINT * (coalesce(n, 0) + 2)) // (total + 2 * v) AS p
  FROM g JOIN k USING (lang) JOIN v USING (lang) JOIN gn ON gn.lang = g.lang AND gn.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
lp AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 2)) // (any_value(total) + 2 * any_value(v)) AS q
  FROM c JOIN v USING (lang) JOIN (SELECT lang, sum(n) AS total FROM c GROUP BY lang) USING (lang) GROUP BY lang, term),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN gp x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN gp y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY a.lang, a.source, b.source),
terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // (p + q) AS value
  FROM gp JOIN lp USING (lang, term) WHERE n > 0 AND p > q),
u AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 10
"""
