"""Personal data: base patterns and bootstrapped contextual extraction.

Four base patterns find e-mail and IP addresses, card and phone numbers in whole texts. Their spans are seeds, and so are tokens
with the look of a key: 32 hexadecimal digits or more, letters and figures both. Seeds, and other tokens with a digit, are
instances. The words around one are its lexical patterns: the word before it (with its sign, if
one of ``: = #`` stands between, as in ``id = "..."``), the word after it, and both together. Patterns and instances form a
bipartite graph of distinct values. Seeds are known; a pattern is as sure as the known share of its instances, once ``SUPPORT``
of them are known; all instances of a pattern that reaches ``CONFIDENCE`` become known, and so support others, until nothing
changes. In texts, confident patterns mark the identifiers that no base pattern knows, which become spans of kind ``id``; the
word after alone is too weak a sign to mark one, it only passes knowledge on. The look of a key alone makes no span either: a
checksum that stands nowhere in particular is nobody's. Base spans always stay, and no added span overlaps one. Tokens and words
of any length take part; a word of over ``WORD`` code points stands in a pattern by its hash.

Sums by pattern are partial before they are shuffled, so a frequent pattern is one row a task. A null text is the empty text.
Each row is judged by its own text, so repeated rows, ties and equal ids are nothing special, and an empty table gives an empty
result. ``redact`` keeps all columns and changes ``text`` (and ``n_chars``, if there is one); the rest read ``doc_id`` and
``text`` only.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm._common import map_texts, materialise, small, texts_of

KINDS = ("email", "ip", "card", "phone", "id")
SUPPORT, CONFIDENCE = 5, 0.9
WORD = 64
SMALL = 100_000  # texts with added spans that may be broadcast
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")  # inside a run of digits no match can start
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_STOP = re.compile(r"[\s\"'<>(),;]|\Z")
_AFTER = re.compile(r"\W*(\w+)")
_KEY = re.compile(r"(?=[a-fA-F]*[0-9])(?=[0-9]*[a-fA-F])[0-9a-fA-F]{32,}")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of EMAIL, found from each sign outwards in linear time."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` in order; kind is an index into KINDS."""
    out = [(a, 0, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def _word(text: str) -> str:
    return text.lower() if len(text) <= WORD else hashlib.md5(text.lower().encode()).hexdigest()


def _around(text: str, start: int, end: int) -> tuple[str, str]:
    """The word before a place, with the last sign between, and the word after it; empty if there are none."""
    b, sign = start, ""
    while b > 0 and not (text[b - 1].isalnum() or text[b - 1] == "_"):
        b -= 1
        sign = sign or (text[b] if text[b] in ":=#" else "")
    a = b
    while a > 0 and (text[a - 1].isalnum() or text[a - 1] == "_"):
        a -= 1
    after = _AFTER.match(text, end)
    return f"{_word(text[a:b])} {sign}".rstrip() if a < b else "", _word(after[1]) if after else ""


def instances(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, str, str, bool, bool]]:
    """``(start, end, left, right, seed, base)`` of every base span and every other token with a digit that has a word beside it."""
    out = [(a, b, *around, True, True) for a, _, b in spans if any(around := _around(text, a, b))]
    k, at = 0, 0
    while m := _DIGIT.search(text, at):
        a, at = m.start(), _STOP.search(text, m.start()).start()
        b = at
        while a > 0 and not _STOP.match(text[a - 1]):
            a -= 1
        while b > a and text[b - 1] in ".:!?#$%&*|":
            b -= 1
        if 5 <= b - a:
            while k < len(spans) and spans[k][2] <= a:
                k += 1
            if not any(s < b and a < e for s, _, e in spans[k : k + 8]) and any(around := _around(text, a, b)):
                out.append((a, b, *around, bool(_KEY.fullmatch(text, a, b)), False))
    return out


def _key() -> list[Column]:
    text = F.coalesce("text", F.lit(""))
    return [F.xxhash64(text).alias("key"), F.crc32(text.cast("binary")).alias("check")]


def extract(docs: DataFrame) -> DataFrame:
    """``doc_id, key, check, spans, found``: base spans, and the instances with the words around, of every whole text."""
    kind = dict(docs.dtypes)["doc_id"]
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    found = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("left", pa.string()), ("right", pa.string()), ("value", pa.string()), ("seed", pa.bool_()), ("base", pa.bool_())]))

    def start():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            spans, seen = [], []
            for t in texts_of(batch):
                own = base_spans(t)
                spans.append([{"start": a, "kind": k, "end": b} for a, k, b in own])
                seen.append([
                    {"start": a, "end": b, "left": l, "right": r, "value": hashlib.md5(t[a:b].encode()).hexdigest(), "seed": s, "base": of}
                    for a, b, l, r, s, of in instances(t, own)
                ])
            out = [batch.column(c) for c in ("doc_id", "key", "check")] + [pa.array(spans, span), pa.array(seen, found)]
            return pa.RecordBatch.from_arrays(out, ["doc_id", "key", "check", "spans", "found"])

        return each

    return map_texts(
        docs.select("doc_id", "text", *_key()), start,
        f"doc_id {kind}, key bigint, check bigint, spans array<struct<start:int,kind:int,end:int>>, "
        "found array<struct<start:int,end:int,left:string,right:string,value:string,seed:boolean,base:boolean>>",
    )


def _patterns(*sides: str) -> Column:
    """The patterns of an instance, of the given sides: ``l``, ``r`` or ``b`` for both."""
    whole = {"l": F.col("left") != "", "r": F.col("right") != "", "b": (F.col("left") != "") & (F.col("right") != "")}
    words = {"l": ["left"], "r": ["right"], "b": ["left", "right"]}
    made = [F.when(whole[s], F.concat_ws("\n", F.lit(s), *words[s])) for s in sides]
    return F.explode(F.array_compact(F.array(*made))).alias("pattern")


def confident_patterns(found: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """``pattern`` of those that mark identifiers, by iterated scores over the graph of ``pattern, value, seed``."""
    edges = materialise(found.groupBy("pattern", "value").agg(F.max("seed").alias("seed")), "edges")
    able = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support)
    live = materialise(edges.join(able, "pattern"), "live")  # no other pattern can come to count
    known, before = live.where("seed").select("value").distinct(), 0
    while True:
        marked = live.join(known.withColumn("known", F.lit(True)), "value", "left")
        scored = marked.groupBy("pattern").agg(F.count("known").alias("k"), F.first("n").alias("n"))
        sure = materialise(scored.where((F.col("k") >= support) & (F.col("k") / F.col("n") >= confidence)).select("pattern"), "sure")
        now = sure.count()
        if now == before:  # what is known only grows, and with it the confident patterns
            return sure
        before = now
        known = materialise(known.unionByName(live.join(sure, "pattern").select("value")).distinct(), "known")


def added_spans(read: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """``key, check, added``: the spans that confident patterns add, once for each text that has any."""
    found = read.select("key", "check", F.inline("found"))
    sure = confident_patterns(found.select(_patterns("l", "r", "b"), "value", "seed"), support, confidence)
    span = F.struct("start", F.lit(KINDS.index("id")).alias("kind"), "end")
    more = found.where("not base").select("*", _patterns("l", "b")).join(sure, "pattern")
    more = more.groupBy("key", "check").agg(F.array_sort(F.collect_set(span)).alias("added"))
    return small(materialise(more, "added"), SMALL)


def _with_added(rows: DataFrame, more: DataFrame) -> DataFrame:
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")
    return rows.join(more, ["key", "check"], "left").withColumn("added", F.coalesce("added", none))


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def personal_data(docs: DataFrame) -> DataFrame:
    """Counts of each base kind, the hash of the base spans, and all spans, for every document."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    read = materialise(extract(docs), "instances")
    return _with_added(read.withColumnRenamed("spans", "base"), added_spans(read)).select(
        "doc_id",
        *[count(k).alias(f"n_{KINDS[k]}") for k in range(4)],
        F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _written(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("bigint").alias("n_added"),
    )


def redact_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with each span, or run of overlapping ones, replaced by the kind of its first in angle brackets."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"<{KINDS[k]}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every base and added span of its texts replaced by its kind. Texts without any stay as they are, null too."""
    read = materialise(extract(docs), "instances")
    spans = read.where(F.size("spans") > 0).groupBy("key", "check").agg(F.first("spans").alias("base"))  # equal texts have equal ones
    both = spans.join(added_spans(read), ["key", "check"], "full_outer")
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")
    both = both.select("key", "check", F.array_sort(F.concat(F.coalesce("base", none), F.coalesce("added", none))).alias("all"))
    both = small(materialise(both, "spans"), SMALL)

    names = docs.columns
    of = both.select(F.col("key").alias("__key"), F.col("check").alias("__check"), F.col("all").alias("__all"))
    rows = docs.withColumns(dict(zip(("__key", "__check"), _key()))).join(of, ["__key", "__check"], "left")
    at, sizes = names.index("text"), [i for i, c in enumerate(names) if c == "n_chars"]

    def start():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            columns = [batch.column(i) for i in range(len(names))]
            texts = [
                redact_text(t, [(s["start"], s["kind"], s["end"]) for s in spans])
                for t, spans in zip(columns[at].to_pylist(), batch.column(len(names)).to_pylist())
            ]
            columns[at] = pa.array(texts, pa.string())
            for i in sizes:
                columns[i] = pa.array(map(len, texts), pa.int64()).cast(columns[i].type)
            return pa.RecordBatch.from_arrays(columns, names)

        return each

    touched = map_texts(rows.where("__all is not null").select(*names, "__all"), start, docs.schema)
    return rows.where("__all is null").select(*names).unionByName(touched)  # few rows have any and pass through Python
