"""Column expressions for words and lines, built from Spark SQL functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\f\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once: a lambda variable is not inlined, as a column could be."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The runs of other characters than x20 and x09-x0D."""
    return let(
        F.btrim(text, F.lit(SPACE)),
        lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"[\x20\x09-\x0D]+")),
    )


def window_hashes(ws: Column, size: int) -> Column:
    """XXH64 of every run of ``size`` words; fewer words (also none) are one run."""
    n = F.size(ws)
    return F.when(n < size, F.array(F.xxhash64(ws))).otherwise(
        F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(size)]))
    )
