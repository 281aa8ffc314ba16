"""Text functions as Column expressions. Regular expressions carry ``(?U)`` where the letters of Finnish count as letters."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import lexicons as lx

PUNCTUATION = ".,;:!?\"'()[]"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\u200b\u200c\u200d\ufeff]"
#: What both cleaners do to dashes and quotes; the parser and the normaliser differ in U+201A and U+2012.
CLEAN_SIGNS = (("—", " -- "), ("–", " - "), *((c, '"') for c in "“”„"), *((c, "'") for c in "‘’‚"))
NORMAL_SIGNS = (("—", " -- "), ("–", " - "), ("‒", " - "), *((c, '"') for c in "“”„‚"), *((c, "'") for c in "‘’"))


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def exploded(rows: DataFrame, keep: Iterable[str], values: Column, name: str, place: str = "__place") -> DataFrame:
    """``keep`` and a row for each of ``values``, which are computed once.

    An inner explode lets the optimizer add a filter on the array's size below it, which computes the array again.
    """
    out = rows.select(*keep, F.posexplode_outer(values).alias(place, name)).where(F.col(place).isNotNull())
    return out.drop(place) if place == "__place" else out


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def lines(c: Column) -> Column:
    """Parts between line ends of any kind."""
    return F.split(F.regexp_replace(c, r"\r\n|[\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]", "\n"), "\n")


def tokens(c: Column) -> Column:
    """White-space separated parts, none empty."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def _replaced(c: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def array_of(words: Iterable[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def clean_text(c: Column) -> Column:
    """Drops rule lines and lines without letters, straightens quotes and dashes, removes control signs and runs of blanks."""
    lines_of = lines(c)
    kept = F.filter(lines_of, lambda x: ~strip(x).rlike(r"^[-=_*~+]{3,}$") & ((strip(x) == "") | x.rlike(f"[{lx.LETTERS}]")))
    out = F.regexp_replace(_replaced(F.array_join(kept, "\n"), CLEAN_SIGNS), CONTROL, "")
    return F.coalesce(strip(F.regexp_replace(out, r"[ \t]{2,}", " ")), F.lit(""))


def clean_text_basic(c: Column) -> Column:
    """The older cleaner: rules become blanks, then lines without letters go."""
    out = F.regexp_replace(F.regexp_replace(c, r"[-=_]{3,}", " "), r"[ \t]{2,}", " ")
    return strip(F.array_join(F.filter(F.split(out, "\n"), lambda x: x.rlike(f"[{lx.LETTERS}]")), "\n"))


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"(?U)(?<=[.!?])\s+"), strip), lambda s: s != "")


def sentences_before_capitals(c: Column) -> Column:
    """Splits before capitals only; of over ten characters."""
    parts = F.split(F.replace(c, F.lit("\n"), F.lit(" ")), r"(?U)(?<=[.!?])\s+(?=[A-ZÅÄÖ])")
    return F.filter(F.transform(parts, strip), lambda s: F.length(s) > 10)


def word_chunks(c: Column, most: int = 60) -> Column:
    """Sentences, cut into runs of at most ``most`` words."""

    def cut(sentence: Column) -> Column:
        return let(
            tokens(sentence),
            lambda w: F.transform(
                F.sequence(F.lit(0), F.floor((F.greatest(F.size(w), F.lit(1)) - 1) / most).cast("int")),
                lambda k: F.array_join(F.slice(w, k * most + 1, most), " "),
            ),
        )

    return F.filter(F.flatten(F.transform(F.split(c, r"(?U)(?<=[.!?])\s+"), cut)), lambda s: s != "")


def historical_fold(c: Column) -> Column:
    out = _replaced(F.lower(c), (("w", "v"), ("ph", "f"), ("ck", "kk")))
    return F.translate(out, "âôû", "äöu")


#: (pattern, replacement, rule) in order.
SPELLING = (
    ("W", "V", "w→v"), ("w", "v", "w→v"), ("dt", "tt", "dt→tt"), ("gh", "g", "gh→g"), ("ck", "kk", "ck→kk"),
    (r"(?U)\bhafv", "hav", "hafv→hav"), (r"(?U)\bgifv", "giv", "gifv→giv"), (r"(?U)\bblifv", "bliv", "blifv→bliv"),
)


def modern_spelling(c: Column) -> Column:
    for pattern, new, _ in SPELLING:
        c = F.regexp_replace(c, pattern, new)
    return c


def _change(new: str, rule: str):
    return lambda x: F.struct(x.alias("orig"), F.lit(new).alias("norm"), F.lit(rule).alias("rule"))


def spelling_changes(c: Column) -> Column:
    """``array<struct<orig, norm, rule>>``: what each rule finds in the text that the rules before it leave."""
    found = []
    for pattern, new, rule in SPELLING:
        hits = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
        found.append(F.transform(hits, _change(new, rule)))
        c = F.regexp_replace(c, pattern, new)
    return F.concat(*found)


def rejoin_hyphens(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)-\s*\n\s*", "")


def straighten(c: Column) -> Column:
    """Dashes, quotes, invisible signs and runs of blanks; without the repair of split words."""
    out = F.regexp_replace(_replaced(c, NORMAL_SIGNS), r"[\u200b\u200c\u200d\ufeff\u00ad]", "")
    return F.regexp_replace(out, r"[ \t]{2,}", " ")


def merge_split_words(c: Column, common=lx.SPACE_COMMON, blocked=lx.SPACE_BLOCKED) -> Column:
    """Joins a word that OCR cut in two: a fragment and the word after it, never three in a row.

    One pattern takes both words, so matches can't overlap and each pair is taken from the left, in one pass over the text.
    """
    whole = "|".join(re.escape(w) for w in sorted(blocked))
    stays = "|".join(re.escape(w) for w in sorted(common))
    consonants = "bcdfghjklmnpqrstvwxzBCDFGHJKLMNPQRSTVWXZ"
    fragment = rf"[A-ZÅÄÖ][a-zåäö]{{0,2}}\n?|(?!(?iu:{whole})(?: |\z))\p{{Ll}}[^ ]{{0,2}}[{consonants}]"
    goes_on = rf"(?!(?:{stays})(?: |\z))\p{{Ll}}[^ ]{{2,}}"
    return F.regexp_replace(c, rf"(?<![^ ])({fragment}) ({goes_on})", "$1$2")


def normalize_unicode(c: Column) -> Column:
    return F.regexp_replace(merge_split_words(straighten(c)), r"\n{3,}", "\n\n")


def normalize(c: Column) -> Column:
    return modern_spelling(rejoin_hyphens(normalize_unicode(c)))


def word_list(c: Column, stopwords=lx.STOPWORDS) -> Column:
    """Lower-cased runs of three letters or more that are no stop words."""
    found = F.regexp_extract_all(F.lower(c), F.lit(f"([{lx.LETTERS}]{{3,}})"), F.lit(1))
    stop = array_of(sorted(stopwords))
    return F.filter(found, lambda w: ~F.array_contains(stop, w))


def has_any_token(c: Column, lexicon=lx.ICE_TOKENS) -> Column:
    found = F.regexp_extract_all(F.lower(c), F.lit(f"([{lx.LETTERS}]+)"), F.lit(1))
    return F.arrays_overlap(found, array_of(sorted(lexicon)))


def is_header(c: Column) -> Column:
    """A short block that starts like a title: seven tests in order."""

    def judge(t: Column) -> Column:
        def of(alpha: Column) -> Column:
            upper = lambda w: F.substring(w, 1, 1).rlike(r"^\p{Lu}")
            n = F.size(alpha)
            return (
                F.when(n == 0, False)
                .when(~F.exists(alpha, lambda w: F.length(w) > 3), False)
                .when(n > 7, False)
                .when(t.rlike(r"(?iU)^(?:n:o|s\.|k\.|p\.)\s*\d"), False)
                .when(F.forall(alpha, lambda w: (F.length(w) <= 1) | (F.upper(w) == w)), True)
                .when((n <= 4) & upper(F.get(alpha, F.lit(0))), True)
                .otherwise(F.size(F.filter(alpha, upper)) / n >= 0.6)
            )

        return let(F.filter(tokens(t), lambda w: w.rlike(f"[{lx.LETTERS}]{{2,}}")), of)

    return let(F.regexp_replace(strip(c), r"\.+$", ""), judge)


def noisy_share(c: Column) -> Column:
    """Share of tokens without letters, or with eight capitals, five equal characters or two rule signs in a row."""
    noise = rf"^[^{lx.LETTERS}]*$|[A-Z]{{8,}}|(.)\1{{4,}}|[|}}{{\\]{{2,}}"
    return let(tokens(c), lambda w: F.when(F.size(w) == 0, 0.0).otherwise(F.size(F.filter(w, lambda t: t.rlike(noise))) / F.size(w)))


def vowel_share(word: Column) -> Column:
    letters = F.regexp_count(word, F.lit(r"\p{L}"))
    return F.when(letters >= 5, F.regexp_count(word, F.lit("[aeiouåäöyAEIOUÅÄÖY]")) / letters)


def digits_to_letters(word: Column) -> Column:
    return F.translate(word, "0135678", "oissbtB")


def year_of_name(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"(?U)\b(1[89]\d{2}|20\d{2})\b", 1), F.lit("")).cast("int")


def date_of_name(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"\d{4}-\d{2}-\d{2}", 0), F.lit(""))


def categories(c: Column, rules=lx.CATEGORY_RULES) -> Column:
    """``array<struct<category, pattern>>`` of the rules that match the folded text, in order."""
    folded = historical_fold(c)
    return let(folded, lambda t: F.filter(
        F.array(*[F.when(t.rlike(p), F.struct(F.lit(k).alias("category"), F.lit(p).alias("pattern"))) for k, p in rules]),
        lambda x: x.isNotNull(),
    ))


def flood_is_ice(snippet: Column, published: Column) -> Column:
    month = F.substring(published, 6, 2).try_cast("int")
    return (
        F.when(snippet.rlike("(?iuU)" + lx.ICE_WITH_FLOOD), True)
        .when(snippet.rlike("(?iuU)" + lx.SUMMER_FLOOD), False)
        .otherwise(F.coalesce(month.isin(*lx.ICE_MONTHS), F.lit(False)))
    )


def event_date(snippet: Column, published: Column) -> Column:
    """``struct<event_date, confidence>``."""
    exact = F.regexp_extract(snippet, "(?iuU)" + lx.EXACT_DATE, 0)
    sure = (
        F.when(exact != "", "exact").when(snippet.rlike("(?iuU)" + lx.RELATIVE_DATE), "inferred").otherwise("publication")
    )
    return F.struct(F.when(exact != "", strip(exact)).otherwise(published).alias("event_date"), sure.alias("confidence"))


def first_river(c: Column, rivers=lx.TARGET_RIVERS) -> Column:
    """The first of ``rivers``, in their order, that the text contains; else empty."""
    low = F.lower(c)
    return F.coalesce(*[F.when(F.contains(low, F.lit(r)), F.lit(r)) for r in rivers], F.lit(""))
