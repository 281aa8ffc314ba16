"""Functions whose results are spans: dates, rivers, truncated words, keyword windows, OCR flags.

Dates and truncations need positions of regular-expression matches, which Spark SQL lacks, so they are Arrow-batched; rivers
and keyword hits are found natively, by lookahead splits and by lexicon arrays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import lexicons as lx
from strandline.functions import words
from strandline.functions.arrow import batched
from strandline.functions.text import array_of, digits_to_letters, exploded, let, vowel_share

DATE = "struct<day:int,month:int,year:int,raw:string,format:string>"
_STEMS = sorted({s: n for n, stems in lx.MONTH_STEMS.items() for s in stems.split()}.items(), key=lambda x: len(x[0]), reverse=True)
_DAY = r"(\d{1,2})\s*p[:.]?n[äa]"


def _long_date(fixed: bool) -> re.Pattern:
    names = "|".join(s for s, _ in _STEMS)
    # as the source has it, only the last name may be inflected; ``fixed`` lets all be
    month = rf"((?:{names})\w*)" if fixed else rf"({names}\w*)"
    return re.compile(rf"(?:{_DAY}\s+)?{month}(?:\s+{_DAY})?(?:\s+(\d{{4}}))?", re.I)


_LONG = {fixed: _long_date(fixed) for fixed in (False, True)}
_NUMERIC = re.compile(r"\b(\d{1,2})[./](\d{1,2})(?:[./](\d{4}|\d{2}))?\b")
_YEAR = re.compile(r"(?:vuonna|v\.)\s*(\d{4})\b|\b(1[89]\d{2})\b")


# what each kind of date holds, and what re.I takes for ASCII letters beyond ``lower``: a text is searched only where it may have one
_SEPARATED, _FOUR, _FOLDED = re.compile(r"\d[./]\d"), re.compile(r"\d{4}"), re.compile("[\u0130\u0131\u017f]")


def _long_dates(text: str, pattern: re.Pattern) -> Iterator[re.Match]:
    """What ``pattern.finditer`` gives, tried only where the name of a month, or a day before it, begins."""
    if _FOLDED.search(text):
        yield from pattern.finditer(text)
        return
    low, places = text.lower(), set()
    for stem, _ in _STEMS:
        at = low.find(stem)
        while at >= 0:
            places.add(at)
            at = low.find(stem, at + 1)
    done = 0
    for at in sorted(places):
        if at >= done:
            m = next((m for s in _day_starts(low, at, done) if (m := pattern.match(text, s))), None) or pattern.match(text, at)
            if m:
                done = m.end()
                yield m


def _day_starts(low: str, at: int, least: int) -> Iterator[int]:
    """Where "11 p:nä " may begin that ends at a place, the first before the second digit."""
    k = at
    while k > least and low[k - 1].isspace():
        k -= 1
    if k == at or low[max(least, k - 2) : k] not in ("nä", "na"):
        return
    k -= 2
    k -= k > least and low[k - 1] in ":."
    if k <= least or low[k - 1] != "p":
        return
    k -= 1
    while k > least and low[k - 1].isspace():
        k -= 1
    yield from (s for s in (k - 2, k - 1) if s >= least and low[s:k].isdecimal())


def _month(word: str) -> int | None:
    low = word.lower()
    return next((n for s, n in _STEMS if s in low), None)


def dates_of(text: str, fixed_months: bool = False) -> list[dict]:
    """Numeric dates, then long ones, then bare years; none overlaps one found before."""
    out: list[dict] = []
    taken: list[tuple[int, int]] = []

    def add(m: re.Match, kind: str, day, month, year) -> None:
        taken.append(m.span())
        out.append({"day": day, "month": month, "year": year, "raw": m[0].strip(), "format": kind})

    def free(m: re.Match) -> bool:
        return all(m.end() <= a or b <= m.start() for a, b in taken)

    for m in filter(free, _NUMERIC.finditer(text)) if _SEPARATED.search(text) else ():
        day, month, year = int(m[1]), int(m[2]), m[3]
        if 1 <= day <= 31 and 1 <= month <= 12:
            add(m, "numeric", day, month, None if not year else int(year) + 1900 * (len(year) == 2))
    for m in filter(free, _long_dates(text, _LONG[fixed_months])):
        if (month := _month(m[2])) is not None:
            day = m[1] or m[3]
            add(m, "finnish_long", int(day) if day and int(day) <= 31 else None, month, int(m[4]) if m[4] else None)
    for m in filter(free, _YEAR.finditer(text)) if _FOUR.search(text) else ():
        add(m, "year_only", None, None, int(m[1] or m[2]))
    return out


@batched(f"array<{DATE}>")
def dates(text: pd.Series) -> pd.Series:
    return text.map(lambda t: dates_of(t or ""))


@batched(f"array<{DATE}>")
def dates_fixed(text: pd.Series) -> pd.Series:
    """With inflected month names."""
    return text.map(lambda t: dates_of(t or "", True))


def best_year(found: Column, fallback: Column) -> Column:
    """The first year of a full date, else of any, else ``fallback``."""
    full = F.filter(found, lambda d: d["year"].isNotNull() & (d["year"] != 0) & (d["format"] != "year_only"))
    some = F.filter(found, lambda d: d["year"].isNotNull() & (d["year"] != 0))
    return F.coalesce(F.get(full, F.lit(0))["year"], F.get(some, F.lit(0))["year"], fallback)


_TRUNCATED = re.compile(r"\b([a-zåäöA-ZÅÄÖ]{2,5})\.|\b([a-zåäö]{3,4})\s*$", re.M)


def truncations_of(text: str) -> list[tuple[str, int]]:
    found = ((m[1] or m[2], m.start()) for m in _TRUNCATED.finditer(text))
    return [(w, at) for w, at in found if w.lower() not in lx.ABBREVIATIONS]


@batched("array<struct<fragment:string,position:int>>")
def truncations(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [{"fragment": w, "position": at} for w, at in truncations_of(t or "")])


def rivers(text: Column, stems=lx.RIVER_STEMS) -> Column:
    """``array<struct<river, matched_text, position>>`` by position; of overlapping mentions the first stays.

    A stem counts at the start of a word. Every word that some stem begins is cut out once, with its place, by splitting before
    such words, so the cost doesn't grow with the number of stems squared.
    """
    ordered = sorted(dict.fromkeys(s for _, s in stems), key=len, reverse=True)
    any_stem = r"(?iuU)(?<!\w)(?:" + "|".join(ordered) + ")"
    known = F.array(*[F.struct(F.lit(r).alias("river"), F.lit(s).alias("stem")) for r, s in stems])

    def found(parts: Column) -> Column:
        state = F.aggregate(
            parts,
            F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<piece:string,at:int>>)").alias("out")),
            lambda acc, p: F.struct(
                (acc["at"] + F.length(p)).alias("at"),
                F.when(p.rlike("^" + any_stem), F.array_append(acc["out"], F.struct(p.alias("piece"), acc["at"].alias("at"))))
                .otherwise(acc["out"]).alias("out"),
            ),
            lambda acc: acc["out"],
        )
        return F.transform(
            state,
            lambda x: F.struct(
                F.filter(known, lambda k: F.startswith(F.lower(x["piece"]), k["stem"]))[0]["river"].alias("river"),
                F.regexp_extract(x["piece"], any_stem + r"\p{L}*", 0).alias("matched_text"),
                x["at"].alias("position"),
            ),
        )

    return let(F.split(text, any_stem.replace("(?iuU)(?<!\\w)(?:", "(?iuU)(?<!\\w)(?=").removesuffix(")") + ")"), found)


def keyword_hits(rows: DataFrame, keywords: tuple[str, ...], keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep, text, ord, keyword, position`` of all, also overlapping, hits in the lower-cased text.

    Splitting before each keyword gives pieces that start at its hits; running lengths are their positions.
    """
    none = F.expr("cast(array() as array<struct<ord:int,keyword:string,position:int>>)")

    def places(word: str) -> Column:
        return F.aggregate(
            F.split("__low", r"(?=\Q" + word + r"\E)"),
            F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out")),
            lambda acc, p: F.struct(
                (acc["at"] + F.length(p)).alias("at"),
                F.when((acc["at"] > 0) | F.startswith(F.col("__low"), F.lit(word)), F.array_append(acc["out"], acc["at"])).otherwise(acc["out"]).alias("out"),
            ),
            lambda acc: acc["out"],
        )

    # most texts have no hit, and are not split
    parts = [F.when(F.contains(F.col("__low"), F.lit(w)), F.transform(places(w), _hit(k, w))).otherwise(none) for k, w in enumerate(keywords)]
    low = rows.select(*keep, text, F.lower(text).alias("__low"))
    return exploded(low, (*keep, text), F.concat(*parts), "hit").select(*keep, text, "hit.*")


def _hit(k: int, word: str):
    return lambda p: F.struct(F.lit(k).alias("ord"), F.lit(word).alias("keyword"), p.alias("position"))


def snippet(text: Column, position: Column, length: Column, window: int) -> Column:
    start = F.greatest(F.lit(0), position - window)
    return F.substring(text, start + 1, position + length + window - start)


#: name: pattern over the stripped token, in order.
OCR_RULES = {
    "digit_in_word": rf"\b[{lx.LETTERS}]+[0-9][{lx.LETTERS}]+\b",
    "repeated_chars": r"\b\w*(.)\1{3,}\w*\b",
    "long_allcaps": r"\b[A-ZÅÄÖ]{8,}\b",
    "mixed_case_chaos": r"\b(?:[a-zåäö][A-ZÅÄÖ]){3,}\b",
    "embedded_symbols": rf"\b[{lx.LETTERS}]+[|+\\#@$%^&*<>][{lx.LETTERS}]+\b",
    "internal_cluster_5": r"(?i)[bcdfghjklmnpqrstvwxz]{5,}",
    "bad_consonant_start": rf"(?<![a-zA-Zåäöy])[bcdfghjklmnpqrstvwxzBCDFGHJKLMNPQRSTVWXZ]{{3}}[{lx.LETTERS}]+",
}
#: What a match of each rule holds besides, found without word boundaries, which are slow, or cases.
OCR_GUARDS = {
    "digit_in_word": "[0-9]",
    "repeated_chars": r"(.)\1{3}",
    "long_allcaps": "[A-ZÅÄÖ]{8}",
    "mixed_case_chaos": "[a-zåäö][A-ZÅÄÖ]",
    "embedded_symbols": r"[|+\\#@$%^&*<>]",
    "internal_cluster_5": r"[bcdfghjklmnpqrstvwxzBCDFGHJKLMNPQRSTVWXZ\u212a\u017f]{5}",
    "bad_consonant_start": "[bcdfghjklmnpqrstvwxzBCDFGHJKLMNPQRSTVWXZ]{3}",
}


def ocr_rule(token: Column) -> Column:
    """The first rule that a stripped token breaks, or null."""
    out = None
    for name, pattern in OCR_RULES.items():
        hit = token.rlike(OCR_GUARDS[name]) & token.rlike("(?U)" + pattern)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.when(token.rlike(f"[{lx.LETTERS}]{{5,}}") & (vowel_share(token) < 0.26), F.lit("low_vowel_ratio"))


def may_be_flagged(bare: Column) -> Column:
    white = array_of(sorted(lx.WHITELIST))
    return ~F.array_contains(white, F.lower(bare)) & bare.rlike(f"[{lx.LETTERS}]") & (F.length(bare) >= 2)


def ocr_flags(rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, token, original, suggestion, rule_name, position, context`` of every suspicious token.

    A sieve in Arrow, wider than the rules, drops the words that break none once a batch; the rules judge the rest.
    """
    names = (key, "token", "original", "bare", "found", "context")
    kept = exploded(words.suspicious(rows, key, text).where(may_be_flagged(F.col("bare"))), names, F.array(ocr_rule(F.col("bare"))), "rule_name")
    fixed = digits_to_letters(F.col("bare"))
    return kept.where("rule_name is not null").select(
        key, "token", "original", F.when(fixed != F.col("bare"), fixed).otherwise("").alias("suggestion"), "rule_name", F.col("found").alias("position"), "context",
    )


def apply_corrections(text: Column, flags: Column) -> Column:
    """Replaces, from the last position to the first, the first occurrence of each flagged token that is safe to correct.

    ``flags``: array of ``struct<position, original, suggestion, reason, rule_name, confidence>``.
    """
    safe = F.filter(flags, lambda f: (f["suggestion"] != "") & (f["suggestion"] != f["original"]) & (
        ((f["reason"] == "rule") & (f["rule_name"] == "digit_in_word")) | ((f["reason"] == "model") & (f["confidence"] > 0.5))
    ))
    ordered = F.array_sort(safe, lambda a, b: F.when(a["position"] > b["position"], -1).when(a["position"] < b["position"], 1).otherwise(0))

    def step(t: Column, f: Column) -> Column:
        at = F.instr(t, f["original"])
        new = F.concat(F.substring(t, F.lit(1), at - 1), f["suggestion"], F.substring(t, at + F.length(f["original"]), F.length(t)))
        return F.when(at > 0, new).otherwise(t)

    return F.aggregate(ordered, text, step)
