"""Operator 11: typed parts, escapes, round trips, loss mask, defined cases."""

import random

from pyspark.sql import functions as F

from cohortica.llm.chat_format import (END, NO_PARTS, PART, SAYS, START, escape, format_chat, masked_texts, read_turns,
                                       text_parts, unescape)

SCHEMA = f"conv_id long, turn long, role string, parts {NO_PARTS}, formatted string, row int, tokens double"


def part(kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None):
    return (kind, text, ref, width, height, seconds, pages)


def messages(spark, rows):
    return spark.createDataFrame([(*r, "clash", 3, 0.5) for r in rows], SCHEMA).repartition(3)


def test_control_strings_are_escaped_and_come_back(spark):
    rng = random.Random(3)
    alphabet = ["<", "|", ">", "/", "s", "[", "]", "INST", "SYS", "\\", "$", "\n", "é", "😀", "<|end|>", "</s>", "<<SYS>>", " "]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escape(F.col("t")).alias("e"))
    for t, e, u in df.select("t", "e", unescape(F.col("e"))).collect():
        assert u == t
        assert not any(mark in e for mark in ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))


def test_parts_are_visited_in_order(spark):
    rows = [
        (1, 1, "assistant", [part("text", "see "), part("text", "both"), part("document", ref="d.pdf", pages=3), part("text", "!")]),
        (1, 0, "user", [part("text", "a <|x"), part("image", ref="i.png", width=56, height=29), part("audio", ref="s.wav", seconds=2.5)]),
        (1, 2, "user", [part("video", ref="v.mp4")]),
    ]
    got = format_chat(messages(spark, rows)).first()
    assert got.formatted == (
        f"{START}user{SAYS}a <\\|x<|image:0|><|audio:1|>{END}"
        f"{START}assistant{SAYS}see {PART}both<|document:2|>!{END}{START}user{SAYS}<|document:3|>{END}")
    assert [tuple(a) for a in got.attachments] == [
        (0, 1, "image", "i.png", 4), (1, 1, "audio", "s.wav", 63), (2, 2, "document", "d.pdf", 3072), (3, 3, "video", "v.mp4", 1)]
    assert [got.formatted[m.start:m.start + m.length] for m in got.loss_mask] == ["see ", "both", "!"]
    assert (got.n_turns, got.n_parts) == (3, 8)
    assert got.expanded_tokens == (2 + 4 + 63) + (1 + 1 + 3072 + 1) + 1 + 3 * 3 + 1


def test_turns_and_texts_read_back(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for conv in range(40):
        for turn in range(rng.randint(1, 6)):
            role = rng.choice(["user", "assistant", "a<|b", ""])
            parts = []
            for _ in range(rng.randint(1, 5)):
                text = "".join(rng.choice(["<|end|>", "x", "\\", "[INST]", "é", "|>", "image:0"]) for _ in range(rng.randint(1, 6)))
                parts.append(part("text", text) if rng.random() < 0.6 else part(rng.choice(["image", "audio", "document"])))
            rows.append((conv, turn, role, parts))
            want.setdefault(conv, []).append((role, parts))
    df = format_chat(messages(spark, rows)).select(
        "conv_id", read_turns(F.col("formatted")).alias("turns"),
        masked_texts(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    for conv, turns, loss in df.collect():
        count = 0
        assert len(turns) == len(want[conv])
        for got, (role, parts) in zip(turns, want[conv]):
            expected = []
            for p in parts:
                expected.append((p[1], None) if p[0] == "text" else (None, count))
                count += p[0] != "text"
            assert got.role == role and [tuple(p) for p in got.parts] == expected
        assert loss == [p[1] for role, parts in want[conv] if role == "assistant" for p in parts if p[0] == "text"]


def test_defined_cases(spark):
    long = "word " * 300_000
    rows = [(None, None, None, None), (None, 0, "user", []), (5, 0, "assistant", [part(None, long)]),
            (6, 1, "user", [part("text", "b")]), (6, 1, "user", [part("text", "a")]), (6, 1, "user", [part("text", "a")])]
    got = {r.conv_id: r for r in format_chat(messages(spark, rows)).collect()}
    assert got[None].formatted == f"{START}{SAYS}{END}{START}user{SAYS}{END}"
    assert got[5].loss_mask[0].length == len(long) and got[5].expanded_tokens == 300_003
    assert got[6].formatted == f"{START}user{SAYS}a{END}" * 2 + f"{START}user{SAYS}b{END}"
    assert format_chat(messages(spark, [])).count() == 0


def test_plain_texts(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", None)], "conv_id long, turn long, role string, text string")
    out = format_chat(df.withColumn("parts", text_parts(F.col("text"))))
    turns, loss = out.select(read_turns(F.col("formatted")), masked_texts(F.col("formatted"), F.col("loss_mask"))).first()
    assert [(t.role, t.parts[0].text) for t in turns] == [("user", "hi"), ("assistant", "")] and loss == [""]
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
