"""Articles of a page: boundaries between its blocks, and the text of what lies between them.

Everything works on one row's array of blocks: the depth of its valleys, headers, and the joining of blocks are folds over that
array, and lexical similarity of the windows before and after each block is counted in Arrow batches, so no operator shuffles.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import lexicons as lx
from strandline.functions.arrow import batched, parts
from strandline.functions.text import array_of, exploded, has_any_token, is_header, let, lines, normalize, strip
from strandline.operators.layout import column_order

WINDOW, DEPTH, LEAST_WORDS = 3, 0.10, 2


_WORD = re.compile(f"[{lx.LETTERS}]{{3,}}")


def _cosines(pages: list[list[str | None] | None], window: int) -> pa.Array:
    """For all blocks of some pages at once; sums are of whole numbers, so no order of adding shows in them.

    The words of a block count in the windows that hold it, each at most once a word: sorting brings the counts of either side
    of a gap together.
    """
    sizes = np.array([len(p or ()) for p in pages], "i8")
    start, end = (np.repeat(x, sizes) for x in (np.cumsum(sizes) - sizes, np.cumsum(sizes)))
    found = [_WORD.findall(t.lower()) if t else [] for p in pages for t in p or ()]
    coded = pa.array(chain.from_iterable(found), pa.large_string()).dictionary_encode()
    said = ~pc.is_in(coded.dictionary, pa.array(sorted(lx.STOPWORDS), pa.large_string())).to_numpy(zero_copy_only=False)
    ids, most = coded.indices.to_numpy().astype("i8"), max(1, len(said))
    kept = said[ids]
    both, n = np.unique((np.repeat(np.arange(len(found)), [len(w) for w in found]) * most + ids)[kept], return_counts=True)
    block, word = np.divmod(both, most)
    sides = []  # gap and word, count before, count after
    for d in range(-window + 1, window + 1):
        at = np.flatnonzero((block + d >= start[block]) & (block + d < end[block]))
        sides.append((((block + d) * most + word)[at], n[at] * (d > 0), n[at] * (d <= 0)))
    key, x, y = (np.concatenate(c) for c in zip(*sides))
    out = np.zeros(len(found))
    if len(key):
        order = np.argsort(key)
        key, x, y = key[order], x[order], y[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        gap, x, y = key[first] // most, np.add.reduceat(x, first), np.add.reduceat(y, first)
        xy, xx, yy = (np.bincount(gap, v, len(found)) for v in (x * y, x * x, y * y))
        at = np.flatnonzero((xx > 0) & (yy > 0))
        out[at] = xy[at] / (np.sqrt(xx[at]) * np.sqrt(yy[at]))
    offsets = pa.array([0, *np.cumsum(sizes).tolist()], pa.int32(), mask=np.array([*(p is None for p in pages), False]))
    return pa.ListArray.from_arrays(offsets, pa.array(out))


@cache
def _similarities(window: int):
    @batched("array<double>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            made = [_cosines(part.to_pylist(), window) for part in parts(texts)]
            yield pa.concat_arrays(made) if made else pa.array([], pa.list_(pa.float64()))

    return of


def similarities(texts: Column, window: int = WINDOW) -> Column:
    """For each block the cosine of the term frequencies of the blocks before it and of those from it on; 0 if a side has no word."""
    return _similarities(window)(texts)


def _climb(values: Column) -> Column:
    """For each value the peak reached by walking back while values do not fall."""
    none = F.expr("cast(array() as array<double>)")
    return F.aggregate(
        values,
        F.struct(F.lit(None).cast("double").alias("last"), F.lit(None).cast("double").alias("peak"), none.alias("out")),
        lambda acc, v: let(
            F.when(acc["last"] >= v, acc["peak"]).otherwise(v),
            lambda p: F.struct(v.alias("last"), p.alias("peak"), F.array_append(acc["out"], p).alias("out")),
        ),
        lambda acc: acc["out"],
    )


def depths(sims: Column) -> Column:
    """How far similarity rises to both sides of each place."""
    return let(sims, lambda s: let(
        F.struct(_climb(s).alias("l"), F.reverse(_climb(F.reverse(s))).alias("r")),
        lambda p: F.transform(s, lambda v, i: (F.get(p["l"], i) - v) + (F.get(p["r"], i) - v)),
    ))


def valleys(depth: Column, headers: Column, threshold: float = DEPTH) -> Column:
    """The deepest place of each run of depths from ``threshold`` on; the last place is never one.

    A run begins at no header's gap, and is dropped if its deepest place is one.
    """
    start = F.struct(F.lit(-1).alias("best"), F.lit(0.0).alias("most"), F.expr("cast(array() as array<int>)").alias("out"))

    def marked(of: Column) -> Column:
        return F.transform(of, lambda d, i: F.struct(d.alias("d"), i.alias("i"), ((d >= threshold) & (i < F.size(of) - 1)).alias("deep")))

    def step(acc: Column, x: Column) -> Column:
        is_open = acc["best"] >= 0
        opens = x["deep"] & ~is_open & ~F.array_contains(headers, x["i"])
        deeper = x["deep"] & is_open & (x["d"] > acc["most"])
        closes = ~x["deep"] & is_open
        return F.struct(
            F.when(opens | deeper, x["i"]).when(closes, -1).otherwise(acc["best"]).alias("best"),
            F.when(opens | deeper, x["d"]).otherwise(acc["most"]).alias("most"),
            F.when(closes & ~F.array_contains(headers, acc["best"]), F.array_append(acc["out"], acc["best"])).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(let(depth, marked), start, step, lambda acc: acc["out"])


def header_gaps(texts: Column) -> Column:
    """Places after which a block that is a header follows."""
    return let(
        F.transform(texts, lambda t, i: F.when((i > 0) & is_header(t), i - 1)),
        lambda gaps: F.filter(gaps, lambda g: g.isNotNull()),
    )


def boundaries(texts: Column, window: int = WINDOW, threshold: float = DEPTH, aligned: bool = False) -> Column:
    """``array<struct<gap, type>>``: after which blocks an article ends, and why.

    Similarity is measured before a block and its valley cut after it; ``aligned`` cuts where it was measured.
    """
    shift = 1 if aligned else 0

    def of(p: Column) -> Column:
        tiles = F.filter(F.transform(p["v"], lambda g: g - shift), lambda g: (g >= 0) & ~F.array_contains(p["h"], g))
        one = lambda gaps, kind: F.transform(gaps, lambda g: F.struct(g.alias("gap"), F.lit(kind).alias("type")))
        return F.array_sort(F.concat(one(p["h"], "header"), one(tiles, "texttiling")))

    given = F.struct(header_gaps(texts).alias("h"), similarities(texts, window).alias("s"))  # no Python inside of a lambda
    both = let(given, lambda g: F.struct(g["h"].alias("h"), valleys(depths(g["s"]), g["h"], threshold).alias("v")))
    return F.when(F.size(texts) < 2, F.expr("cast(array() as array<struct<gap:int,type:string>>)")).otherwise(let(both, of))


def joined(texts: Column) -> Column:
    """Blocks as lines; one that ends in a hyphen, or in a short open fragment before a small letter, runs on."""
    short = array_of(sorted(lx.SHORT_WORDS))

    def step(acc: Column, t: Column) -> Column:
        last = acc["last"]
        word = F.regexp_extract(last, r"(?U)(\S+)\s*$", 1)
        runs_on = (
            F.length(word).between(2, 4) & word.rlike("[aeiouåäöy]$") & ~F.array_contains(short, F.lower(word)) & t.rlike(r"^\p{Ll}")
        )
        hyphen = F.endswith(last, F.lit("-"))
        return (
            F.when(acc["first"], F.struct(F.lit("").alias("done"), t.alias("last"), F.lit(False).alias("first")))
            .when(hyphen, F.struct(acc["done"].alias("done"), F.concat(F.left(last, F.length(last) - 1), t).alias("last"), F.lit(False).alias("first")))
            .when(runs_on, F.struct(acc["done"].alias("done"), F.concat(last, t).alias("last"), F.lit(False).alias("first")))
            .otherwise(F.struct(F.concat(acc["done"], last, F.lit("\n")).alias("done"), t.alias("last"), F.lit(False).alias("first")))
        )

    start = F.struct(F.lit("").alias("done"), F.lit("").alias("last"), F.lit(True).alias("first"))
    return F.aggregate(F.transform(texts, strip), start, step, lambda acc: F.concat(acc["done"], acc["last"]))


def title(texts: Column) -> Column:
    """The first header among the first three texts, without its closing dots; else empty."""
    found = F.filter(F.slice(texts, 1, 3), lambda t: is_header(t))
    return F.coalesce(F.regexp_replace(strip(F.get(found, F.lit(0))), r"\.+$", ""), F.lit(""))


def segments(texts: Column, gaps: Column) -> Column:
    """``array<struct<first, n_blocks, boundary_type>>``; a segment is named by the boundary that closes it, the last by none."""
    ends = F.concat(gaps, F.array(F.struct((F.size(texts) - 1).alias("gap"), F.lit("").alias("type"))))

    def of(e: Column) -> Column:
        return F.transform(e, lambda x, k: let(
            F.when(k == 0, 0).otherwise(F.get(e, k - 1)["gap"] + 1),
            lambda first: F.struct(first.alias("first"), (x["gap"] - first + 1).alias("n_blocks"), x["type"].alias("boundary_type")),
        ))

    return F.when(F.size(texts) == 0, F.expr("cast(array() as array<struct<first:int,n_blocks:int,boundary_type:string>>)")).otherwise(let(ends, of))


def article_segments(
    pages: DataFrame, window: int = WINDOW, threshold: float = DEPTH, columns: int = 0, least_words: int = LEAST_WORDS, aligned: bool = False
) -> DataFrame:
    """One row for each article of each page (``blocks, page_width``), with all other columns of the page.

    Adds ``segment, full_text, header, has_ice_keywords, n_blocks, boundary_type``.
    """
    kept = F.filter("blocks", lambda b: b["word_count"] >= least_words)
    keep = [c for c in pages.columns if c not in ("blocks", "page_width")]
    texts = pages.select(*keep, F.transform(let(kept, lambda k: column_order(k, F.col("page_width"), columns)), lambda b: b["text"]).alias("__texts"))
    cut = segments(F.col("__texts"), boundaries(F.col("__texts"), window, threshold, aligned))
    rows = exploded(texts, (*keep, "__texts"), cut, "__s", "segment")
    rows = rows.withColumn("__own", F.slice("__texts", F.col("__s.first") + 1, F.col("__s.n_blocks")))
    rows = rows.select(*keep, "segment", joined(F.col("__own")).alias("full_text"), title(F.col("__own")).alias("header"), "__s.n_blocks", "__s.boundary_type")
    return rows.select(*keep, "segment", "full_text", "header", has_any_token(F.col("full_text")).alias("has_ice_keywords"), "n_blocks", "boundary_type")


def articles(pages: DataFrame, ice_only: bool = False, **options) -> DataFrame:
    """Segments with normalised text: ``header, clean_text, raw_text, has_ice_keywords, n_blocks, boundary_type`` and the page's columns.

    Only articles that pass the filter are normalised.
    """
    of = article_segments(pages, **options)
    if ice_only:
        of = of.where("has_ice_keywords")
    of = of.withColumn("clean_text", normalize(F.col("full_text")))
    return of.withColumn("header", title(lines(F.col("clean_text")))).withColumnRenamed("full_text", "raw_text")


def article_files(rows: DataFrame, source: str, text: str = "clean_text", order: str = "segment", separator: str = "\n\n---\n\n") -> DataFrame:
    """``source, text``: the articles of each source joined in order. A source is a page or an issue, of bounded size."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, strip(F.col(text)).alias("t")))), lambda x: x["t"])
    return rows.groupBy(source).agg(F.array_join(parts, separator).alias("text"))
