"""Merkle fingerprints of documents (operator 3); built-in functions only.

A text is sections (split at blank lines) of paragraphs (lines) of sentences (split at
". "). Every node is the SHA-256 of its children, so equal roots mean equal texts, and
the paragraphs whose nodes differ locate an edit. The likeness of two trees is the
Jaccard similarity of their sentence nodes.

``with_next`` gives each row its successor in ``doc_id`` order with a single exchange:
rows go to ranges cut at ids drawn by approximate quantiles, and the first row of each
range is also sent, as a guest, to the range before it.

Null texts are empty. Null ids come first, in the order of their texts, like rows that
share an id. A lone row is its own successor; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortica.llm.common import partitions, range_index

RANGES_PER_PARTITION = 3


def sentences(text: Column) -> Column:
    """Leaves by section and paragraph: ``array<array<array<string>>>`` of hex digests."""
    leaf = lambda s: F.sha2(F.concat(F.lit("s"), s), 256)
    paragraph = lambda p: F.transform(F.split(p, r"\. "), leaf)
    return F.transform(F.split(text, "\n\n"), lambda x: F.transform(F.split(x, "\n"), paragraph))


def paragraphs(leaves: Column) -> Column:
    """Paragraph nodes by section."""
    return F.transform(leaves, lambda x: F.transform(x, lambda p: F.sha2(F.concat(F.lit("p"), F.array_join(p, "")), 256)))


def root(nodes: Column) -> Column:
    sections = F.transform(nodes, lambda x: F.sha2(F.concat(F.lit("x"), F.array_join(x, "")), 256))
    return F.sha2(F.concat(F.lit("r"), F.array_join(sections, "")), 256)


def flat(leaves: Column) -> Column:
    return F.array_distinct(F.transform(F.flatten(F.flatten(leaves)), lambda s: F.substring(s, 1, 16)))


def likeness(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def first_edit(a: Column, b: Column) -> Column:
    """1-based number of the first paragraph in which two trees differ; 0 if none does."""
    return F.coalesce(F.array_position(F.zip_with(F.flatten(a), F.flatten(b), lambda x, y: x.eqNullSafe(y)), False),
                      F.lit(0)).cast("long")


def with_next(docs: DataFrame, key: str, text: str, extra) -> DataFrame:
    """Columns ``key, text`` and those of ``extra(rows)``, all also of the next row as ``next_*``."""
    n = partitions(docs)
    buckets = n * RANGES_PER_PARTITION
    shares = [i / buckets for i in range(buckets)]
    cut = docs.agg(F.percentile_approx(key, shares, 20 * buckets).alias("cut")).first()["cut"] or []
    bounds = sorted({b for b in cut if b is not None})
    bucket = F.greatest(range_index(F.col(key), bounds), F.lit(1))
    heads = bounds[1:]
    start = F.col(key).isNull() | (F.col(key) == (bounds[0] if bounds else 0))
    place = lambda b, guest: F.struct(b.cast("int").alias("bucket"), F.lit(guest).alias("guest"))
    to = F.when(start, F.array(place(F.lit(1), 0), place(F.lit(max(len(bounds), 1)), 1)))
    if heads:
        to = to.when(F.col(key).isin(heads), F.array(place(bucket, 0), place(bucket - 1, 1)))
    to = to.otherwise(F.array(place(bucket, 0)))
    sent = docs.select(key, text, F.explode(to).alias("to")).select(key, text, "to.bucket", "to.guest")
    rows = extra(sent.repartition(n, "bucket"))
    order = Window.partitionBy("bucket").orderBy("guest", F.asc_nulls_first(key), F.xxhash64(text), text)
    names = [c for c in rows.columns if c not in ("bucket", "guest", key)]
    ahead = rows.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in names])
    return ahead.where("guest = 0").drop("bucket", "guest")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edit (second half replaced by the next text's start)."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = with_next(texts, "doc_id", "text", lambda d: d.select("*", sentences(F.col("text")).alias("leaves")).select(
        "doc_id", "text", "bucket", "guest", paragraphs(F.col("leaves")).alias("nodes"), flat(F.col("leaves")).alias("flat")))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr(F.col("text"), F.lit(1), n - half), F.substr(F.col("next_text"), F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "nodes", "flat", "next_flat", edited.alias("edited"))
    rows = rows.select("*", sentences(F.col("edited")).alias("leaves"))
    rows = rows.select("*", paragraphs(F.col("leaves")).alias("edited_nodes"), flat(F.col("leaves")).alias("edited_flat"))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), root(F.col("nodes")).alias("fingerprint"),
        root(F.col("edited_nodes")).alias("edited_fingerprint"),
        likeness(F.col("flat"), F.col("edited_flat")).alias("near_edited"),
        likeness(F.col("flat"), F.col("next_flat")).alias("near_next"),
        first_edit(F.col("nodes"), F.col("edited_nodes")).alias("first_edit"))


def op3_merkle_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS nt FROM d),
e AS (SELECT doc_id, t, nt, left(t, length(t) - length(t) // 2) || left(nt, length(t) // 2) AS et FROM n),
s AS (SELECT *,
  list_transform(string_split(t, chr(10) || chr(10)), lambda x: list_transform(string_split(x, chr(10)), lambda p: list_transform(string_split(p, '. '), lambda s: sha256('s' || s)))) AS a,
  list_transform(string_split(et, chr(10) || chr(10)), lambda x: list_transform(string_split(x, chr(10)), lambda p: list_transform(string_split(p, '. '), lambda s: sha256('s' || s)))) AS b,
  list_transform(string_split(nt, chr(10) || chr(10)), lambda x: list_transform(string_split(x, chr(10)), lambda p: list_transform(string_split(p, '. '), lambda s: sha256('s' || s)))) AS c
  FROM e),
p AS (SELECT *,
  list_transform(a, lambda x: list_transform(x, lambda p: sha256('p' || array_to_string(p, '')))) AS pa,
  list_transform(b, lambda x: list_transform(x, lambda p: sha256('p' || array_to_string(p, '')))) AS pb,
  list_distinct(flatten(flatten(a))) AS fa, list_distinct(flatten(flatten(b))) AS fb, list_distinct(flatten(flatten(c))) AS fc
  FROM s),
q AS (SELECT *, flatten(pa) AS la, flatten(pb) AS lb FROM p)
SELECT doc_id, length(t)::BIGINT AS n_chars, sha256(et) AS edited_sha256,
  sha256('r' || array_to_string(list_transform(pa, lambda x: sha256('x' || array_to_string(x, ''))), '')) AS fingerprint,
  sha256('r' || array_to_string(list_transform(pb, lambda x: sha256('x' || array_to_string(x, ''))), '')) AS edited_fingerprint,
  len(list_intersect(fa, fb))::DOUBLE / (len(fa) + len(fb) - len(list_intersect(fa, fb))) AS near_edited,
  len(list_intersect(fa, fc))::DOUBLE / (len(fa) + len(fc) - len(list_intersect(fa, fc))) AS near_next,
  coalesce(list_min(list_filter(range(1, greatest(len(la), len(lb)) + 1), lambda i: la[i] IS DISTINCT FROM lb[i])), 0)::BIGINT AS first_edit
FROM q
"""
