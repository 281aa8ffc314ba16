"""Reading order and columns of a page.

A page is one row with its blocks in an array, so ordering them never moves rows between tasks. ``blocks`` is
``array<struct<block_id, vpos, hpos, text, word_count, ...>>`` in document order; order among equals stays that of the document.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions.text import let

BANDS = 4
BAND_OF_UNKNOWN = 1000  # width of a column where the page's width is unknown


def _ordered(blocks: Column, first, second) -> Column:
    keyed = F.transform(blocks, lambda b, i: F.struct(first(b).alias("a"), second(b).alias("b"), i.alias("i"), b.alias("block")))
    # the block itself is never compared: i is unique
    return F.transform(F.array_sort(keyed), lambda x: x["block"])


def reading_order(blocks: Column, page_width: Column) -> Column:
    """By quarter of the page, then from the top; by place alone if the width is unknown. Quarters may lie beyond the page."""
    known = page_width > 0
    return _ordered(
        blocks,
        lambda b: F.when(known, (b["hpos"] / (page_width / BANDS)).cast("int")).otherwise(b["vpos"]),
        lambda b: F.when(known, b["vpos"]).otherwise(b["hpos"]),
    )


def estimate_columns(blocks: Column, page_width: Column) -> Column:
    """Columns of a page, from how far its left edges spread."""
    edges = F.transform(blocks, lambda b: b["hpos"])
    spread = (F.array_max(edges) - F.array_min(edges)) / page_width
    return (
        F.when((F.size(blocks) == 0) | (page_width == 0), 4)
        .when(spread < 0.2, 2).when(spread < 0.4, 3).when(spread < 0.65, 4).when(spread < 0.8, 5).otherwise(6)
    )


def column_order(blocks: Column, page_width: Column, columns: int = 0) -> Column:
    """By column, the last taking whatever lies beyond it, then from the top."""
    count = estimate_columns(blocks, page_width) if columns == 0 else F.lit(columns)
    return let(
        F.struct(count.alias("n"), F.when(page_width > 0, page_width / count).otherwise(float(BAND_OF_UNKNOWN)).alias("band")),
        lambda c: _ordered(blocks, lambda b: F.least((b["hpos"] / c["band"]).cast("int"), c["n"] - 1), lambda b: b["vpos"]),
    )


def page_text(blocks: Column) -> Column:
    return F.array_join(F.transform(blocks, lambda b: b["text"]), "\n\n")


def page_words(blocks: Column) -> Column:
    return F.aggregate(blocks, F.lit(0), lambda n, b: n + b["word_count"].cast("int"))


def block_of(blocks: Column, position: Column, parity: bool = True) -> Column:
    """Id of the block that holds a position of the page's text, by running lengths.

    With ``parity`` a position at the very start of a block counts to the one before, and the first position to the first.
    """
    ends = F.aggregate(
        blocks,
        F.struct(F.lit(0).alias("at"), F.lit(None).cast("string").alias("id")),
        lambda acc, b: let(
            acc["at"] + F.length(b["text"]) + 2,
            lambda end: F.struct(
                end.alias("at"),
                F.when(acc["id"].isNull() & ((end >= position) if parity else (end > position)), b["block_id"]).otherwise(acc["id"]).alias("id"),
            ),
        ),
        lambda acc: acc["id"],
    )
    return F.coalesce(ends, F.lit(""))
