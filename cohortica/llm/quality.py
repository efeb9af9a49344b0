"""Quality rules with cross-document line frequency (operator 5); built-in functions only.

One pass over the texts computes the rule counts and a hash and letter count for every
line; after that only line hashes move. Lines are normalised (lower case, one blank for
white space, digits as 0) and counted by distinct documents per host. A line in more
documents of a host than an absolute limit is removed, and a document that loses more than
``depleted`` percent of its word characters is rejected.

Null texts have no words, so they fail the base rule. Null hosts are one host. Rows with
the same ``doc_id`` are one document for the counts; rows without an id count as one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cohortica.llm.common import kept

BLANKS = r"[\x20\x09-\x0D]+"
WINDOW = 8


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def repeat_words(hashes: Column) -> Column:
    """Words in windows that occur twice or more, from the hashes of all windows in order.

    Each key keeps the place in the remainder modulo the number of windows and the hash
    above it, so one sort of plain numbers brings equal windows together.
    """
    m = F.size(hashes).cast("long")
    half = F.transform(hashes, lambda h: F.shiftright(h, 1))
    keys = F.sort_array(F.transform(half, lambda h, i: h - F.pmod(h, m) + i))
    base = lambda k: k - F.pmod(k, m)
    follow = F.zip_with(keys, F.slice(keys, 2, F.size(keys)), lambda a, b: F.coalesce(base(a) == base(b), F.lit(False)))
    twice = F.zip_with(follow, F.concat(F.array(F.lit(False)), follow), lambda a, b: F.coalesce(a, F.lit(False)) | b)
    places = F.filter(F.zip_with(keys, twice, lambda k, t: F.when(t, F.pmod(k, m))), lambda p: p.isNotNull())
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).cast("long").alias("last"))
    return F.aggregate(F.sort_array(places), start, lambda s, p: F.struct(
        (s["n"] + F.least(F.lit(WINDOW).cast("long"), p - s["last"])).alias("n"), p.alias("last")))["n"]


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
            max_docs: int = 20, depleted: int = 50) -> DataFrame:
    """Rule counts, base verdict and final verdict of every row.

    A line in more than ``max_docs`` documents of its host is removed, whatever the size of the host.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    long = lambda c: c.cast("long")
    first = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"),
        text.alias("text"), split_words(text).alias("words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    windows = F.when(F.size("words") >= WINDOW, F.transform(
        F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)),
        lambda i: F.xxhash64(F.slice(F.col("words"), i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    clean = lambda x: F.regexp_replace(F.trim(F.regexp_replace(F.lower(x), BLANKS, " ")), "[0-9]", "0")
    second = first.select("*", windows.alias("windows"))
    counted = second.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "host", long(F.size("words")).alias("n_words"),
        long(F.length(F.regexp_replace("text", BLANKS, ""))).alias("word_chars"),
        long(F.regexp_count("text", F.lit("[#*$%&|<>]"))).alias("n_symbols"),
        long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("windows")) == F.size("windows"), F.lit(0).cast("long"))
        .otherwise(repeat_words(F.col("windows"))).alias("n_repeat_words"),
        F.transform("lines", lambda x: F.struct(
            F.xxhash64(clean(x)).alias("line"),
            F.length(F.regexp_replace(x, BLANKS, "")).cast("long").alias("chars"))).alias("lines"))
    rows = kept(counted, "quality")
    lines = rows.select("row", "doc_id", "host", F.explode("lines").alias("x")).select(
        "row", "doc_id", "host", "x.line", "x.chars")
    seen = lines.groupBy("host", "line").agg(F.count_distinct(F.coalesce("doc_id", F.lit(-1))).alias("in_docs"))
    common = seen.where(F.col("in_docs") > max_docs).select("host", "line")
    lost = lines.join(common, ["host", "line"]).groupBy("row").agg(
        F.sum("chars").alias("removed_chars"), F.count(F.lit(1)).alias("removed_lines"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    removed = F.coalesce("removed_chars", F.lit(0).cast("long"))
    return rows.join(lost, "row", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (100 * removed <= depleted * F.col("word_chars"))).alias("kept"),
        F.coalesce("removed_lines", F.lit(0).cast("long")).alias("removed_lines"), removed.alias("removed_chars"))


def op5_line_frequency_quality(spark, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT id, i, array_to_string(ws[i:i + 7], ' ') AS k
        FROM (SELECT id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
rep AS (SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, k) AS n FROM win) WHERE n > 1),
cov AS (SELECT id, sum(least(8, coalesce(nxt - i, 8))) AS n
        FROM (SELECT id, i, lead(i) OVER (PARTITION BY id ORDER BY i) AS nxt FROM rep) GROUP BY id),
raw AS (SELECT id, doc_id, host, unnest(string_split(t, chr(10))) AS x FROM d),
ln AS (SELECT id, doc_id, host, x, length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) AS chars,
       regexp_replace(trim(regexp_replace(lower(x), '[\x20\x09-\x0D]+', ' ', 'g')), '[0-9]', '0', 'g') AS line
       FROM raw WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
dup AS (SELECT id, count(*) - count(DISTINCT x) AS n FROM ln GROUP BY id),
common AS (SELECT host, line FROM ln GROUP BY host, line HAVING count(DISTINCT coalesce(doc_id, -1)) > 20),
lost AS (SELECT id, sum(chars) AS c, count(*) AS n FROM ln JOIN common USING (host, line) GROUP BY id),
a AS (SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
      length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
      coalesce(dup.n, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
      coalesce(lost.n, 0) AS removed_lines, coalesce(lost.c, 0) AS removed_chars
      FROM d JOIN w USING (id) LEFT JOIN dup USING (id) LEFT JOIN cov USING (id) LEFT JOIN lost USING (id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * removed_chars <= 50 * word_chars AS kept,
       removed_lines::BIGINT AS removed_lines, removed_chars::BIGINT AS removed_chars
FROM a
"""
