"""Chat formatting with typed content parts (operator 11); built-in functions only.

A message is a role and a list of parts: text, image, audio or document. A visitor turns every
part into its place in the formatted string: text is escaped, an attachment becomes an ordered
placeholder ``<|kind:ordinal|>``, whose reference and expanded token count are recorded. Parts
are visited as rows: running sums over a conversation give ordinals and places, so no string is
built up step by step.

Template: ``<|start|>role<|says|>body<|end|>`` for each turn, in order; two text parts in a row
are parted by ``<|part|>``. Control strings inside texts and roles get a backslash after their
first character, and every backslash is doubled, so texts never hold a control string and come
back exactly (`read_turns`).

Null roles and texts are empty, a null or empty list of parts is one empty text. Turns go by
``turn`` (null first), then role and parts, so ties and repeated rows have one order and all
stay. Rows with a null conversation are one conversation. Parts of an unknown kind count as
documents. An empty table gives an empty result. A conversation is one output value and so is
put together in one task; its limit is Spark's 2 GB for a string. Very long texts are otherwise
of no concern: each text is visited once. Columns are chosen by name, others are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

START, SAYS, END, PART = "<|start|>", "<|says|>", "<|end|>", "<|part|>"
_CONTROL = r"\\|<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\])"
_PLACEHOLDER = r"<\|(?:part|image:[0-9]+|audio:[0-9]+|document:[0-9]+)\|>"

PART_TYPE = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
NO_PARTS = f"array<{PART_TYPE}>"


def _count(value: Column) -> Column:
    """At least one token, also where a size is missing."""
    return F.greatest(F.coalesce(F.ceil(value).cast("long"), F.lit(1)), F.lit(1))


#: Tokens that a placeholder stands for: 28-pixel patches, 25 frames a second, 1,024 a page.
TOKENS: dict[str, Callable[[Column], Column]] = {
    "image": lambda p: _count(F.ceil(p["width"] / 28) * F.ceil(p["height"] / 28)),
    "audio": lambda p: _count(p["seconds"] * 25),
    "document": lambda p: _count(p["pages"].cast("long") * 1024),
}


def word_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_parts(text: Column) -> Column:
    """One text part from a plain text column."""
    return F.array(F.struct(
        F.lit("text").alias("kind"), text.cast("string").alias("text"), F.lit(None).cast("string").alias("ref"),
        F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"),
        F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages")))


def format_chat(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                parts: str = "parts", loss_roles: Sequence[str] = ("assistant",),
                tokens: Mapping[str, Callable[[Column], Column]] = TOKENS,
                text_tokens: Callable[[Column], Column] = word_tokens) -> DataFrame:
    """One row a conversation: the formatted text, its loss mask, attachments and expanded tokens.

    ``loss_mask`` holds the spans of the texts of ``loss_roles`` in code points: ``start`` in the
    formatted text, ``length``, the ``turn`` (from 1) and ``at``, the start within that turn.
    ``attachments`` holds ``ordinal`` (order in the conversation), ``turn``, ``kind``, ``ref``, ``tokens``.
    """
    empty = F.from_json(F.lit('[{"kind":"text","text":""}]'), NO_PARTS)
    content = F.when(F.size(F.coalesce(F.col(f"`{parts}`"), empty)) == 0, empty).otherwise(
        F.coalesce(F.col(f"`{parts}`").cast(NO_PARTS), empty))
    content = F.transform(content, lambda p: F.struct(
        F.when(p["kind"].isNull() | (p["kind"] == "text"), "text").when(p["kind"].isin(*tokens), p["kind"])
        .otherwise("document").alias("shape"),
        F.coalesce(p["text"], F.lit("")).alias("text"), p.alias("given")))
    rows = messages.select(
        F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"), content.alias("content"),
        F.monotonically_increasing_id().alias("row"))
    visited = rows.select("*", F.posexplode("content").alias("pos", "part"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "content", "row", "pos")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shape = F.col("part.shape")
    previous = F.when(F.col("pos") > 0, F.get(F.col("content"), F.col("pos") - 1)["shape"])
    named = visited.select(
        "conv_id", "turn", "role", "content", "row", "pos", F.col("part.given").alias("given"), shape.alias("shape"),
        F.when(F.col("pos") == 0, F.concat(F.lit(START), escape(F.col("role")), F.lit(SAYS)))
        .when((shape == "text") & (previous == "text"), F.lit(PART)).otherwise(F.lit("")).alias("before"),
        F.when(F.col("pos") == F.size("content") - 1, F.lit(END)).otherwise(F.lit("")).alias("after"),
        F.col("part.text").alias("text"),
        (F.sum((shape != "text").cast("long")).over(upto) - 1).alias("ordinal"),
        F.sum((F.col("pos") == 0).cast("long")).over(upto).alias("turn_no"),
        F.row_number().over(order).alias("seq"))
    body = F.when(F.col("shape") == "text", escape(F.col("text"))).otherwise(
        F.concat(F.lit("<|"), F.col("shape"), F.lit(":"), F.col("ordinal").cast("string"), F.lit("|>")))
    size = lambda c: F.char_length(c).cast("long")
    placed = named.select("*", body.alias("body")).withColumn(
        "ends", F.sum(size(F.col("before")) + size(F.col("body")) + size(F.col("after"))).over(upto))
    placed = placed.withColumn("start", F.col("ends") - size(F.col("after")) - size(F.col("body"))).withColumn(
        "turn_start", F.max(F.when(F.col("pos") == 0, F.col("start") - size(F.col("before")))).over(upto))
    counted = F.when(F.col("shape") == "text", text_tokens(F.col("text")))
    for kind, rule in tokens.items():
        counted = counted.when(F.col("shape") == kind, rule(F.col("given")))
    controls = F.when(F.col("pos") == 0, 2).otherwise((F.col("before") != "").cast("int")) + (F.col("after") != "").cast("int")
    pieces = placed.select(
        "conv_id", counted.alias("tokens"), controls.alias("controls"), "pos",
        F.struct("seq", F.concat("before", "body", "after").alias("piece"),
                 ((F.col("shape") == "text") & F.col("role").isin(*loss_roles)).alias("loss"), "start",
                 size(F.col("body")).alias("length"), F.col("turn_no").alias("turn"),
                 (F.col("start") - F.col("turn_start")).alias("at"), "shape", "ordinal",
                 F.col("given.kind").alias("kind"), F.col("given.ref").alias("ref"), counted.alias("tokens")).alias("x"))
    whole = pieces.groupBy("conv_id").agg(
        F.sort_array(F.collect_list("x")).alias("x"), F.sum((F.col("pos") == 0).cast("long")).alias("n_turns"),
        F.count(F.lit(1)).alias("n_parts"), F.sum(F.col("tokens") + F.col("controls")).alias("expanded_tokens"))
    return whole.select(
        "conv_id", F.array_join(F.transform("x", lambda p: p["piece"]), "").alias("formatted"),
        F.transform(F.filter("x", lambda p: p["loss"]), lambda p: F.struct(
            p["start"].alias("start"), p["length"].alias("length"), p["turn"].alias("turn"), p["at"].alias("at"))).alias("loss_mask"),
        F.transform(F.filter("x", lambda p: p["shape"] != "text"), lambda p: F.struct(
            p["ordinal"].alias("ordinal"), p["turn"].alias("turn"), p["kind"].alias("kind"), p["ref"].alias("ref"),
            p["tokens"].alias("tokens"))).alias("attachments"),
        "n_turns", "n_parts", "expanded_tokens")


def _turns(formatted: Column) -> Column:
    """The turns of a formatted text, without the start marks."""
    return F.filter(F.split(formatted, r"<\|start\|>"), lambda t, i: i > 0)


def read_turns(formatted: Column) -> Column:
    """Role and parts of every turn, read from the formatted text alone.

    ``parts`` holds ``text``, or the ``ordinal`` of an attachment. Empty texts beside attachments
    are not told from none.
    """
    def parts(body: Column) -> Column:
        marks = F.regexp_extract_all(body, F.lit(f"({_PLACEHOLDER})"))
        texts = F.transform(F.split(body, _PLACEHOLDER), unescape)
        pairs = F.transform(texts, lambda t, i: F.struct(
            t.alias("text"), F.nullif(F.regexp_extract(F.coalesce(F.get(marks, i), F.lit("")), "([0-9]+)", 1), F.lit(""))
            .cast("long").alias("ordinal"), F.get(marks, i).contains("|part|").alias("parted"),
            F.when(i > 0, F.get(marks, i - 1).contains("|part|")).otherwise(False).alias("follows")))
        none = F.lit(None)
        return F.flatten(F.transform(pairs, lambda p: F.concat(
            F.when((p["text"] != "") | p["follows"] | F.coalesce(p["parted"], F.lit(False)) | (F.size(marks) == 0), F.array(
                F.struct(p["text"].alias("text"), none.cast("long").alias("ordinal")))).otherwise(
                    F.array().cast("array<struct<text:string,ordinal:long>>")),
            F.when(p["ordinal"].isNotNull(), F.array(F.struct(
                none.cast("string").alias("text"), p["ordinal"].alias("ordinal")))).otherwise(
                    F.array().cast("array<struct<text:string,ordinal:long>>")))))

    return F.transform(_turns(formatted), lambda t: F.struct(
        unescape(F.substring_index(t, SAYS, 1)).alias("role"),
        parts(F.substring_index(F.substring_index(t, SAYS, -1), END, 1)).alias("parts")))


def masked_texts(formatted: Column, loss_mask: Column) -> Column:
    """Texts under the loss mask, unescaped, in order; every turn is cut out once."""
    marked = lambda t, i: F.transform(
        F.filter(loss_mask, lambda m: m["turn"] == i + 1), lambda m: unescape(F.substring(
            F.concat(F.lit(START), t), (m["at"] + 1).cast("int"), m["length"].cast("int"))))
    return F.flatten(F.transform(_turns(formatted), marked))


#: A conversation whose texts are control strings of other templates.
PROBE_ID, PROBE_TEXT = -7, "</s>[INST] ok [/INST]"


def op11_typed_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(PROBE_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE_TEXT).alias("text"))
    messages = rows.unionByName(probe).select("conv_id", "turn", "role", text_parts(F.col("text")).alias("parts"))
    out = format_chat(messages).select(
        "*", read_turns(F.col("formatted")).alias("turns"),
        F.array_join(masked_texts(F.col("formatted"), F.col("loss_mask")), "").alias("loss"))
    said = F.transform("turns", lambda t: F.concat(
        t["role"], F.lit("\n"), F.array_join(F.transform(t["parts"], lambda p: p["text"]), ""), F.lit("\n")))
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(F.array_join(said, ""), "UTF-8"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        F.size("attachments").cast("long").alias("n_attachments"), "expanded_tokens")


OP11_SQL = rf"""
WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {PROBE_ID}, x, CASE x WHEN 0 THEN 'user' ELSE 'assistant' END, '{PROBE_TEXT}' FROM range(2) r(x)),
e AS (SELECT *, {{0}} AS er, {{1}} AS et FROM m)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('{START}' || er || '{SAYS}' || et || '{END}'))::BIGINT AS formatted_chars, 0::BIGINT AS n_attachments,
  sum(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 3)::BIGINT AS expanded_tokens
FROM e GROUP BY conv_id
"""


def _escaped_sql(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for mark in ("<|", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]"):
        out = f"replace({out}, '{mark}', '{mark[0]}\\{mark[1:]}')"
    return out


OP11_SQL = OP11_SQL.replace("{0}", _escaped_sql("role")).replace("{1}", _escaped_sql("text"))
