"""Words of texts in Arrow: cut, trimmed and coded once for each batch, so that what is asked of a word is asked once a batch."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions import lexicons as lx
from strandline.functions.arrow import bound_batches
from strandline.functions.text import PUNCTUATION

CHUNK, FLUSH_BYTES, SIEVE_BYTES = 60, 16 << 20, 8 << 20
_OTHER = re.compile("[\x1c-\x1f]")
_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_CONSONANTS = "bcdfghjklmnpqrstvwxz"
_EITHER = _CONSONANTS + _CONSONANTS.upper()
#: What every word of all rules but two has, in a syntax without lookarounds: a first sieve, wider than the rules.
_SUSPICIOUS = "|".join((
    rf"[{lx.LETTERS}][0-9|+\\\\#@$%^&*<>][{lx.LETTERS}]", "[A-ZÅÄÖ]{8}", "(?:[a-zåäö][A-ZÅÄÖ]){3}",
    f"[{_EITHER}\u212a\u017f]{{5}}", f"[{_EITHER}]{{3}}[{lx.LETTERS}]",
))
_REPEATED = re.compile(r"(.)\1{3}", re.S)


def words_of(text: str) -> list[str]:
    """The parts that ``text.tokens`` finds; Python's own split takes four more signs for blanks."""
    return [w for w in _BLANKS.split(text) if w] if _OTHER.search(text) else text.split()


def strings(words: Iterator[str] | list[str]) -> pa.Array:
    return pa.array(words, pa.large_string())


class Words:
    """The words of some texts one after another, as ids of bare words with those before and after them in the text."""

    def __init__(self, texts: list[str | None]):
        lists = [words_of(t) if t else [] for t in texts]
        self.sizes = np.array([len(x) for x in lists], "i8")
        self.list = list(chain.from_iterable(lists))
        self.words = strings(self.list)
        n = self.n = len(self.words)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.first = np.zeros(n + 1, bool)  # of its text, and after the last
        self.first[self.starts] = True
        self.first[n] = True
        coded = pc.utf8_trim(self.words, PUNCTUATION).dictionary_encode()
        self.vocabulary, self.ids = coded.dictionary, coded.indices.to_numpy().astype("u4")
        self.none = pc.index(self.vocabulary, pa.scalar("", pa.large_string())).as_py()
        if self.none < 0:
            self.none, self.vocabulary = len(self.vocabulary), pa.concat_arrays([self.vocabulary, strings([""])])
        self.l, self.r = self.around(self.first)

    def around(self, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words before and after, none beyond where something opens."""
        before, after = np.full(self.n, self.none, "u4"), np.full(self.n, self.none, "u4")
        before[1:], after[:-1] = self.ids[:-1], self.ids[1:]
        before[opens[:-1]] = after[opens[1:]] = self.none
        return before, after

    def place(self) -> None:
        """Adds ``doc, chunk, token`` and the bounds of chunks: sentences cut every CHUNK words."""
        n, at = self.n, np.arange(self.n)
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.start = self.starts[self.doc]
        opens = self.first[:-1].copy()
        if n:
            last = np.frombuffer(self.words.buffers()[1], "i8", n + 1)[1:] - 1
            signs = np.frombuffer(self.words.buffers()[2], "u1")[last]
            opens[1:] |= ((signs == ord(".")) | (signs == ord("!")) | (signs == ord("?")))[:-1]
        self.token = (at - np.maximum.accumulate(np.where(opens, at, 0))) % CHUNK
        self.cut = np.append(self.token == 0, True)
        self.number = np.cumsum(self.cut[:-1])
        self.chunk = self.number - self.number[self.start]

    def may_be_asked(self) -> np.ndarray:
        """Long enough and with a letter; the rest of the conditions hold words back at the end."""
        ok = pc.and_(pc.greater_equal(pc.utf8_length(self.vocabulary), 3), pc.match_substring_regex(self.vocabulary, f"[{lx.LETTERS}]"))
        return ok.to_numpy(zero_copy_only=False)[self.ids]


def flushes(batches: Iterator[pa.RecordBatch], most: int = FLUSH_BYTES) -> Iterator[pa.Table]:
    """Batches put together to some ``most`` bytes."""
    held, size = [], 0
    for b in batches:
        for at in range(0, b.num_rows, step := max(1, int(b.num_rows * most / max(b.nbytes, 1)))):
            held.append(b.slice(at, step))
            size += held[-1].nbytes
            if size >= most:
                yield pa.Table.from_batches(held)
                held, size = [], 0
                pa.default_memory_pool().release_unused()
    if held:
        yield pa.Table.from_batches(held)


def sieve(words: pa.Array) -> np.ndarray:
    """Which bare words may break a rule of ``spans.OCR_RULES`` or have few vowels; others break none."""
    of = lambda found: found.to_numpy(zero_copy_only=False)
    out = of(pc.match_substring_regex(words, _SUSPICIOUS))
    out |= np.fromiter((_REPEATED.search(w) is not None for w in words.to_pylist()), bool, len(words))
    long = np.flatnonzero(~out & of(pc.match_substring_regex(words, f"[{lx.LETTERS}]{{5}}")))
    rest = words.take(pa.array(long))
    letters, vowels = (of(pc.count_substring_regex(rest, p)) for p in (r"\p{L}", "[aeiouåäöyAEIOUÅÄÖY]"))
    # what is a letter beyond Latin depends on the version of Unicode: those words stay
    out[long] = (vowels < 0.2601 * letters) | of(pc.match_substring_regex(rest, "[^\\x{0}-\\x{24f}]"))
    return out


def suspicious(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``key, token, original, bare, found, context`` of the words that ``sieve`` keeps; found is the first place of such letters."""
    bound_batches(rows.sparkSession)
    names = (("token", T.IntegerType()), ("original", T.StringType()), ("bare", T.StringType()), ("found", T.IntegerType()), ("context", T.StringType()))
    schema = T.StructType([T.StructField(key, rows.schema[key].dataType), *(T.StructField(n, k) for n, k in names)])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in flushes(batches, SIEVE_BYTES):
            texts = t.column(1).to_pylist()
            w = Words(texts)
            at = np.flatnonzero(sieve(w.vocabulary)[w.ids])
            doc = np.repeat(np.arange(len(texts)), w.sizes)[at]
            lo, hi = np.maximum(w.starts[doc], at - 3), np.minimum((w.starts + w.sizes)[doc], at + 4)
            context = [" ".join(w.list[a:b]) for a, b in zip(lo.tolist(), hi.tolist())]
            columns = [
                t.column(0).combine_chunks().take(pa.array(doc)), pa.array((at - w.starts[doc]).astype("i4")), w.words.take(pa.array(at)).cast(pa.string()),
                w.vocabulary.take(pa.array(w.ids[at])).cast(pa.string()), pa.array(found_at(w.list, texts, at, doc), pa.int32()), pa.array(context, pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema])

    return rows.select(key, text).mapInArrow(of, schema)


def found_at(words: list[str], texts: list[str], at: np.ndarray, doc: np.ndarray) -> list[int]:
    """For words of texts in order, where the text first has these letters; searched once a word and text."""
    out, seen, last, text = [], {}, -1, ""
    for d, i in zip(doc.tolist(), at.tolist()):
        if d != last:
            last, seen, text = d, {}, texts[d]
        if (p := seen.get(o := words[i])) is None:
            p = seen[o] = text.find(o)
        out.append(p)
    return out


def suspicious_counts(rows: DataFrame, text: str) -> DataFrame:
    """``word, n``: bare words that ``sieve`` keeps, counted by batch before they move."""
    bound_batches(rows.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in flushes(batches, SIEVE_BYTES):
            w = Words(t.column(0).to_pylist())
            n = np.bincount(w.ids, minlength=len(w.vocabulary))
            kept = np.flatnonzero(sieve(w.vocabulary) & (n > 0))
            yield pa.RecordBatch.from_arrays([w.vocabulary.take(pa.array(kept)).cast(pa.string()), pa.array(n[kept].astype("i8"))], ["word", "n"])

    return rows.select(text).mapInArrow(of, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
