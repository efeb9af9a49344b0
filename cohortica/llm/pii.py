"""Personal data by candidate gradient boosting (operator 1).

Generators of high recall propose overlapping spans for four kinds: e-mail addresses (also
spelled "at" and "dot"), IP addresses (also with blanks or bracketed dots), payment cards
and phone numbers (any grouping; every run of whole digit groups of a chain of numbers, so
neighbouring numbers are proposed one by one). Boosted trees score each proposal from its format and its
context; calibrated thresholds per kind select those that are added to the base spans,
which are exact patterns with their checks and always stay. An added span overlaps no base
span and no added span of higher probability.

The trees learn from a sample bounded by ``FIT_DOCS``: base spans are positives, as are
respelled copies of them in their context; proposals that fail the checks, damaged copies
and numbers inside longer tokens are negatives; numbers of a chain that pass the checks only
by themselves are neither. A text gives ``FIT_FREE`` proposals outside base spans at most to
the sample. Half of the documents (by hash) train, the
others calibrate. Without a positive or a negative nothing is added.

Null and empty texts have no span. Every row is treated alone, so repeated rows repeat
their spans; texts are read whole, in time linear in their length.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from cohortica.llm.boosting import Trees, threshold
from cohortica.llm.common import map_rows, slices

KINDS = ("email", "ip", "card", "phone")
FIT_DOCS = 20_000          # expected number of texts drawn to fit on
FIT_ROWS = 60_000          # proposals used at most
FIT_FREE = 64              # of one text outside its base spans, evenly taken
SCORED = 4096              # proposals scored at once
LONGEST = 19               # digits of a card
PRECISION = 0.99
FLOOR = 0.8
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_PART = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])*+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"[+(]{0,2}[0-9](?:[\x20().\-/_\[\]]{0,3}[0-9])*+")
_SPELLED = re.compile(
    r"[A-Za-z0-9._%+-]{1,64}\x20?(?:@|[(\[]at[)\]]|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}"
    r"(?:\x20?(?:\.|[(\[]dot[)\]]|\x20dot\x20)\x20?[A-Za-z0-9-]{1,63}){1,4}", re.I)
_COMMON = frozenset("the a an this that our my your his her its their all any one some no it".split())
_CUES = {
    "email": ("mail", "contact", "write"), "ip": ("ip", "host", "server", "addr"),
    "card": ("card", "visa", "credit", "pay"), "phone": ("phone", "tel", "call", "fax", "mobile"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)``: leftmost non-overlapping matches of each kind that pass their checks."""
    out = []
    low = at = 0
    while (p := text.find("@", at)) >= 0:
        start = low + len(text[low:p].rstrip(_LOCAL))
        found = _DOMAIN.match(text, p + 1) if start < p else None
        if found:
            out.append((0, start, found.end()))
            low = at = found.end()
        else:
            low = at = p + 1
    digits = _DIGIT.search(text)
    if not digits:
        return out
    for m in _CHAIN.finditer(text, digits.start()):
        parts = list(_PART.finditer(text, m.start(), m.end()))
        for i in range(0, len(parts) - 3, 4):
            if all(len(t := x.group().lstrip("0")) < 4 and int(t or 0) < 256 for x in parts[i:i + 4]):
                out.append((1, parts[i].start(), parts[i + 3].end()))
    for m in _CARD.finditer(text, digits.start()):
        if m.end() - m.start() >= 16:
            plain = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(plain) <= 19 and luhn(plain):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((3, m.start(), m.end()))
    return out


_DIGIT = re.compile("[0-9]")


_SIGN = re.compile(r"@|dot|DOT|Dot|[(\[][aA][tT][)\]]")
_ANY = re.compile("[0-9]|" + _SIGN.pattern)


def proposals(text: str) -> list[tuple[int, int, int]]:
    """Overlapping ``(kind, start, end)`` of every generator."""
    out = []
    if _SIGN.search(text):
        low = text.lower()
        anchors = [m.start() for m in re.finditer(r"@|[(\[]at[)\]]|\x20at\x20", low)]
        last = -1
        for a in anchors:
            if a < last:
                continue
            window = max(0, a - 66, last)
            m = _SPELLED.search(text, window, min(len(text), a + 330))
            while m and m.end() <= a:
                m = _SPELLED.search(text, m.end(), min(len(text), a + 330))
            if m and m.start() <= a < m.end() and (text[a] in "@([" or "dot" in m.group().lower()):
                out.append((0, m.start(), m.end()))
                last = m.end()
    if not _DIGIT.search(text):
        return out
    for m in _NUMBER.finditer(text):
        if m.end() - m.start() >= 7:
            out += _runs(text, *m.span())
    return out


def _runs(text: str, start: int, end: int) -> Iterator[tuple[int, int, int]]:
    """Runs of whole digit groups of a chain, with the signs before them; ``LONGEST`` bounds their number by the text's length."""
    groups = [m.span() for m in _PART.finditer(text, start, end)]
    low = start
    for i, (s, last) in enumerate(groups):
        a = s
        while a > low and s - a < 2 and text[a - 1] in "+(":
            a -= 1
        low = last
        n = 0
        for j in range(i, len(groups)):
            b, e = groups[j]
            n += e - b
            if n > LONGEST:
                break
            if e - a < 7:
                continue
            if j == i + 3 and all(z - y <= 3 for y, z in groups[i:j + 1]) and "." in text[s:e]:
                yield 1, a, e
            if 13 <= n:
                yield 2, a, e
            if 7 <= n <= 15:
                yield 3, a, e


def _char(c: str) -> int:
    return 0 if not c or c.isspace() else 1 if c in ".,;:!?" else 2 if c.isalnum() else 3


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    """Format and context of one proposal."""
    body = text[start:end]
    digits = [c for c in body if c.isdigit()]
    groups = [g for g in re.split("[^0-9]+", body) if g]
    sizes = [len(g) for g in groups] or [0]
    octets = sum(len(g) <= 3 and int(g) < 256 for g in groups)
    before, after = text[max(0, start - 40):start], text[end:end + 20]
    low = before.lower()
    cue = max((len(w) for w in _CUES[KINDS[kind]] if w in low), default=0)
    other = max((len(w) for k in KINDS if k != KINDS[kind] for w in _CUES[k] if w in low), default=0)
    tail = re.split(r"\.|dot", body.lower())[-1].strip(" )]")
    name, host = (re.split(r"\x20?(?:@|[(\[]at[)\]]|\x20at\x20)\x20?", body.lower(), maxsplit=1) + [""])[:2] if kind == 0 else ("", "")
    host = re.split(r"[^a-z0-9-]", host.strip())[0]
    return [
        kind, len(body), len(digits), len(groups), min(sizes), max(sizes), sizes[0], sizes[-1], float(len(set(sizes)) == 1),
        body.count(" "), body.count("-"), body.count("."), body.count("(") + body.count("["), body.count("/") + body.count("_"),
        float(body[:1] == "+"), float("@" in body), float(" at " in body.lower()), float("dot" in body.lower()),
        float(luhn("".join(digits))) if digits else 0.0, octets, float(len(groups) == 4 and octets == 4),
        float(digits[0]) if digits else -1.0, len(set(digits)), len(tail) if tail.isalpha() else 0,
        _char(before[-1:]), _char(after[:1]), float(bool(re.search(r"[0-9a-f]{8}$", low))), float(bool(before[-1:].isdigit() or after[:1].isdigit())),
        float(host in _COMMON), len(host), float(any(c.isdigit() or c in "._-+" for c in name)), float("." in body[1:-1]),
        cue, other, float("=" in before[-12:] or '"' in before[-3:] or "#" in before[-2:]),
    ]


def _respelled(kind: int, body: str, pick: int) -> list[tuple[str, float]]:
    """Copies of a base span in other spellings (1) and damaged ones (0)."""
    plain = "".join(c for c in body if c.isdigit())
    flip = lambda s, i: s[:i] + str((int(s[i]) + 1 + pick % 8) % 10) + s[i + 1:]
    if kind == 0:
        name, domain = body.split("@", 1)
        at, dot = ((" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]"), ("(at)", "."), (" @ ", "."))[pick % 5]
        word = ("the", "a", "this", "that", "our", "my", "all")[pick % 7]
        return [(name + at + domain.replace(".", dot), 1.0), (f"look at {word} dot com", 0.0),
                (f"{name.strip('._%+-') or 'it'} at {word} dot {domain.split('.')[-1]}", 0.0)]
    if kind == 1:
        parts = body.split(".")
        good = ("[.]", " . ", ". ")[pick % 3].join(parts)
        bad = ".".join([*parts[:2], str(256 + pick % 700), parts[3]])
        return [(good, 1.0), (bad, 0.0), (".".join([*parts, parts[0]]), 0.0)]
    if kind == 2:
        sep = (".", "/", "_", "  ", " - ")[pick % 5]
        good = sep.join(plain[i:i + 4] for i in range(0, len(plain), 4))
        return [(good, 1.0), (flip(good, 0), 0.0), (flip(plain, pick % len(plain)), 0.0)]
    tail = plain[-10:]
    good = (f"({tail[:3]}) {tail[3:6]}-{tail[6:]}", f"{tail[:3]}-{tail[3:6]}-{tail[6:]}", f"00{plain}",
            f"{tail[:3]}.{tail[3:6]}.{tail[6:]}", f"+{plain[:-10]} {tail[:3]}/{tail[3:]}")[pick % 5]
    month, day = 1 + pick % 12, 1 + pick % 28
    dates = (f"{1900 + pick % 130}-{month:02}-{day:02}", f"{day:02}.{month:02}.{1900 + pick % 130}",
             f"{1900 + pick % 130}/{month:02}/{day:02}", f"{day:02}/{month:02}/{1950 + pick % 80}")
    bad = (plain[:8], f"{plain[:3]}.{plain[3:9]}", f"{plain[:5]} {plain[5:8]}", f"{plain[:2]} {plain[2:4]} {plain[4:7]}")
    return [(good, 1.0), (dates[pick % 4], 0.0), (dates[pick // 4 % 4], 0.0), (bad[pick % 4], 0.0)]


class _Taken:
    """Disjoint spans in order."""

    def __init__(self, spans: list[tuple[int, int, int]] = ()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, s, e in sorted(spans, key=lambda x: x[1]):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def free(self, start: int, end: int) -> bool:
        i = bisect_right(self.ends, start)
        return i == len(self.starts) or self.starts[i] >= end

    def add(self, start: int, end: int) -> None:
        i = bisect_right(self.starts, start)
        self.starts.insert(i, start)
        self.ends.insert(i, end)


def examples(text: str) -> Iterator[tuple[list[float], float]]:
    """Labelled proposals of one text, with respelled and damaged copies of its base spans."""
    base = base_spans(text)
    exact, taken = set(base), _Taken(base)
    found = proposals(text)
    for kind, s, e in (p for p in found if p in exact):
        yield features(text, kind, s, e), 1.0
    free = [p for p in found if p not in exact and taken.free(p[1], p[2])]
    for i in range(0, len(free), max(1, -(-len(free) // FIT_FREE))):
        kind, s, e = free[i]
        if (kind, 0, e - s) not in base_spans(text[s:e]):
            yield features(text, kind, s, e), 0.0
    for kind, s, e in base:
        before, after = text[max(0, s - 60):s], text[e:e + 40]
        for body, label in _respelled(kind, text[s:e], s + e):
            copy = before + body + after
            digits = sum(c.isdigit() for c in body)
            hits = [p for p in proposals(copy) if p[1] < len(before) + len(body) and p[2] > len(before)
                    and (p[0] == kind or kind and p[0])]
            for k, a, z in hits:
                covers = (k == kind and a >= len(before) - 1 and z <= len(before) + len(body) + 1 and z - a >= 0.8 * len(body)
                          and (not kind or sum(c.isdigit() for c in copy[a:z]) == digits))
                yield features(copy, k, a, z), label if covers else 0.0


class Model:
    def __init__(self, trees: Trees, least: list[float]):
        self.trees, self.least = trees, least

    def added(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        known, taken = _Taken(base), _Taken()
        free = [p for p in proposals(text) if known.free(p[1], p[2])]
        likely = []
        for i in range(0, len(free), SCORED):
            some = free[i:i + SCORED]
            prob = self.trees.probability(np.array([features(text, *p) for p in some]))
            likely += [(-p, at, x) for at, (p, x) in enumerate(zip(prob.tolist(), some), i) if p >= self.least[x[0]]]
        out: list[tuple[int, int, int]] = []
        for _, _, (k, s, e) in sorted(likely):
            if taken.free(s, e):
                taken.add(s, e)
                out.append((k, s, e))
        return out


def spans_of(text: str | None, model: Model | None) -> tuple[list, list]:
    """Base and added spans, each in order of kind and start."""
    if not text or not _ANY.search(text):
        return [], []
    base = base_spans(text)
    return sorted(base), sorted(model.added(text, base)) if model else []




def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in slices(batches):
        rows = ((draw, x, y) for draw, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist())
                if text and _ANY.search(text) for x, y in examples(text))
        while some := list(islice(rows, SCORED)):
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in some], pa.int64()), pa.array([r[1] for r in some], pa.list_(pa.float64())),
                 pa.array([r[2] for r in some], pa.float64())], ["draw", "x", "y"])


def fit(texts: DataFrame, docs_bound: int = FIT_DOCS) -> Model | None:
    """Trees and thresholds from a sample of ``doc_id, text`` drawn by a hash of both."""
    count = texts.count()
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    share = min(1.0, docs_bound / max(count, 1))
    rows = (texts.select(draw.alias("draw"), "text").where(F.col("draw") <= int(share * (1 << 30)))
            .mapInArrow(_sample, "draw long, x array<double>, y double")
            .orderBy("draw", "x", "y").limit(FIT_ROWS).collect())
    if not rows:
        return None
    x, y = np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows])
    half = np.array([r["draw"] % 2 for r in rows]) == 0
    if not 0 < y[half].sum() < half.sum() or half.all():
        return None
    trees = Trees().fit(x[half], y[half]).calibrate(x[~half], y[~half])
    p = trees.probability(x[~half])
    least = [threshold(p[x[~half, 0] == k], y[~half][x[~half, 0] == k], PRECISION, FLOOR) for k in range(len(KINDS))]
    return Model(trees, least)


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def _find(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for piece in slices(batches):
            found = [spans_of(t, m) for t in piece.column(1).to_pylist()]
            count = [[sum(s[0] == k for s in base) for base, _ in found] for k in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), *(pa.array(c, pa.int64()) for c in count),
                 pa.array([hashlib.sha256(_written(b).encode()).hexdigest() for b, _ in found], pa.string()),
                 pa.array([_written(sorted(b + a)) for b, a in found], pa.string()),
                 pa.array([len(a) for _, a in found], pa.int64())],
                ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"])
    return run


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of base spans by kind, a digest of them, and all spans of every row."""
    texts = _texts(docs, id_col, text_col)
    model = docs.sparkSession.sparkContext.broadcast(fit(texts))
    return texts.mapInArrow(_find(model), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, "
                                          "base_sha256 string, spans string, n_added long")


def redacted(text: str | None, model: Model | None) -> str | None:
    """The text with every span replaced by its kind in brackets; overlaps become one."""
    base, more = spans_of(text, model)
    if not base and not more:
        return text
    out, at = [], 0
    for k, s, e in sorted(base + more, key=lambda x: (x[1], -x[2])):
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = e
    return "".join(out) + text[at:]


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with the spans of ``text_col`` replaced, and ``length_col`` (if a column) of changed texts renewed."""
    model = docs.sparkSession.sparkContext.broadcast(fit(_texts(docs, id_col, text_col)))
    at = docs.columns.index(text_col)
    size = docs.columns.index(length_col) if length_col in docs.columns else None
    kind = docs.schema[text_col].dataType
    if not isinstance(kind, T.StringType):
        raise TypeError(f"{text_col} is not a text column")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for piece in slices(batches, f"c{at}"):
            old = piece.column(at).to_pylist()
            new = [redacted(t, m) for t in old]
            columns = list(piece.columns)
            columns[at] = pa.array(new, columns[at].type)
            if size is not None:
                known = piece.column(size).to_pylist()
                columns[size] = pa.array([n if a == b else len(b) for n, a, b in zip(known, old, new)], columns[size].type)
            yield pa.RecordBatch.from_arrays(columns, schema=piece.schema)

    return map_rows(docs, run)


def op1_boosted_pii(spark, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
