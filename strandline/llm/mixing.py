"""Mixing sources to target weights by temperature.

A source's weight is its token share to the power ``a``, normalised. The exponent is found by bisection, each step cutting the
bracket into many parts with one aggregate over the source table: the largest exponent up to one whose weights reach a target
entropy, unless a source would then be repeated more than a limit allows; then the smallest that keeps the limit. The target can
be given in nats, or as ``evenness``: which part of the way it goes from the shares' own entropy (0) to that of equal weights (1).

Weights become token budgets. The total is the least that gives every source its weight without dropping any of its documents,
or a given one. A source's documents are dealt to blocks of some ``block_tokens`` tokens, ``LEAST_BLOCKS`` at least, by hash. Its budget is spent by whole
passes, each visiting its blocks in the order of a keyed hash; the last pass takes blocks in that order while they fit, and of
the next block the documents with the least hashes until the budget is reached, so a source exceeds its budget by less than a
document (and the copies of it).

Sums over blocks are prefix sums in two levels, by slices of the permuted order, so the blocks of one source never stand in one
task. A null source is a source of its own; null and empty texts have no tokens and are taken in every pass, or once where the
budget holds less than a pass. Rows with equal id and text share a hash and go together. An empty table gives an empty mix.
``mix`` keeps all columns; ``plan`` reads ``doc_id``, ``text`` and ``source``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm._common import materialise, small
from strandline.llm._native import let, words

BLOCK_TOKENS, LEAST_BLOCKS = 1 << 20, 16
SLICES = 64
PARTS = 32  # of the bracket, in each step of the bisection
SOURCES, BLOCKS = 10_000, 100_000  # rows that may be broadcast


def token_count(text: Column) -> Column:
    return let(words(F.coalesce(text, F.lit(""))), lambda w: F.size(w).cast("bigint"))


def source_table(rows: DataFrame) -> DataFrame:
    """``src, tokens, docs, p``: token share of each source; rows are summed by task first."""
    t = rows.groupBy("src").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    t = materialise(t, "sources")
    total = t.agg(F.sum("tokens")).first()[0] or 0
    return t.withColumn("p", F.col("tokens") / F.lit(max(total, 1)))


def choose_exponent(sources: DataFrame, target_entropy: float | None, max_repeats: float | None, evenness: float | None = None) -> float:
    """The exponent in [0, 1] that the module's text describes; entropies are in nats."""
    some = sources.where("p > 0")

    def bisect(holds, smallest: bool = False) -> float:
        """The largest exponent for which ``holds(sums)`` is true, if it is at zero; or the smallest, if it is at one."""
        low, high = 0.0, 1.0
        for _ in range(6):
            at = [low + (high - low) * k / PARTS for k in range(PARTS + 1)]
            sums = some.agg(*[
                F.struct(
                    F.sum(F.pow("p", a)).alias("z"), F.sum(F.pow("p", a) * F.log("p")).alias("zl"),
                    # with the least budget that drops nothing, a source is repeated (weight / share) * max(share / weight) times
                    (F.max(F.pow("p", a - 1)) * F.max(F.pow("p", 1 - a))).alias("repeats"), F.lit(a).alias("a"),
                ).alias(f"s{k}")
                for k, a in enumerate(at)
            ]).first()
            good = [k for k in range(PARTS + 1) if holds(sums[k])]
            if smallest:
                k = min(good, default=PARTS)
                if not k:
                    return low
                low, high = at[k - 1], at[k]
            else:
                k = max(good, default=0)
                if k == PARTS:
                    return high
                low, high = at[k], at[k + 1]
        return high if smallest else low

    if not some.limit(1).count():
        return 1.0
    chosen = 0.0 if target_entropy is None and evenness is None and max_repeats is not None else 1.0
    if evenness is not None:
        own, n = some.agg(-F.sum(F.col("p") * F.log("p")), F.count(F.lit(1))).first()
        target_entropy = own + evenness * (math.log(n) - own)
    if target_entropy is not None:
        chosen = bisect(lambda s: s["z"] > 0 and math.log(s["z"]) - s["a"] * s["zl"] / s["z"] >= target_entropy - 1e-12)
    if max_repeats is not None:
        chosen = max(chosen, bisect(lambda s: s["repeats"] <= max(max_repeats, 1.0) + 1e-9, smallest=True))
    return chosen


def weights(sources: DataFrame, exponent: float, budget: int | None = None) -> DataFrame:
    """Adds ``weight, budget, repeats``."""
    z, total = sources.where("p > 0").agg(F.sum(F.pow("p", exponent)), F.sum("tokens")).first()
    w = F.when(F.col("p") > 0, F.pow("p", exponent) / F.lit(z or 1.0)).otherwise(0.0)
    out = sources.withColumn("weight", w)
    if budget is None:
        budget = out.where("weight > 0").agg(F.max(F.col("tokens") / F.col("weight"))).first()[0] or 0
    out = out.withColumn("budget", F.col("weight") * F.lit(float(budget)))
    # a hair of rounding must not cost a whole pass
    ratio = F.col("budget") / F.col("tokens")
    near = F.when(F.abs(ratio - F.round(ratio)) < 1e-9, F.round(ratio)).otherwise(ratio)
    return out.withColumn("repeats", F.when(F.col("tokens") > 0, near).otherwise(1.0))


def _counted(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__src, __n, __h``."""
    return docs.withColumns({
        "__src": F.col("source").cast("string"), "__n": token_count(F.col("text")), "__h": F.xxhash64("doc_id", "text"),
    })


def _blocks(rows: DataFrame, sources: DataFrame, block_tokens: int, seed: int) -> DataFrame:
    """``src, block, full, taken, upto``: whole passes of a block; is it in the last one, and up to which hash."""
    per = rows.groupBy("src", "block").agg(F.sum("n_tokens").alias("t"))
    passes = F.floor("repeats").cast("bigint")
    rest = sources.select(F.col("src").alias("src1"), passes.alias("full"), F.round(F.col("budget") - F.col("tokens") * passes).alias("rest"))
    per = per.join(rest, F.col("src").eqNullSafe(F.col("src1"))).drop("src1")
    per = per.withColumn("order", F.xxhash64(F.lit(seed), "full", "src", "block"))
    per = materialise(per.withColumn("slice", F.shiftrightunsigned("order", 64 - int(math.log2(SLICES)))), "blocks")
    # the order is that of the unsigned hash: by slice, then by what is left
    slices = per.groupBy("src", "slice").agg(F.sum("t").alias("s"))
    earlier = Window.partitionBy("src").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # SLICES rows at most
    slices = slices.select(F.col("src").alias("src2"), F.col("slice").alias("slice2"), F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("src", "slice").orderBy("order", "block").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("within", F.coalesce(F.sum("t").over(inside), F.lit(0)))
    per = per.join(slices, F.col("src").eqNullSafe(F.col("src2")) & (F.col("slice") == F.col("slice2")))
    before = F.col("ahead") + F.col("within")
    state = F.when(before + F.col("t") <= F.col("rest"), "all").when(before < F.col("rest"), "part").otherwise("none")
    per = materialise(per.select("src", "block", "full", "order", state.alias("state"), (F.col("rest") - before).alias("take")), "taken")
    cut = per.where("state = 'part'").select(F.col("src").alias("src3"), F.col("block").alias("block3"), "take")  # one of each source
    cut = small(cut, SOURCES)
    inner = rows.join(cut, F.col("src").eqNullSafe(F.col("src3")) & (F.col("block") == F.col("block3")))
    inner = inner.groupBy("src", "block", "h").agg(F.sum("n_tokens").alias("t"), F.first("take").alias("take"))
    ahead = Window.partitionBy("src", "block").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)  # a part of one block
    inner = inner.withColumn("before", F.coalesce(F.sum("t").over(ahead), F.lit(0))).where("before < take")
    upto = inner.groupBy(F.col("src").alias("src4"), F.col("block").alias("block4")).agg(F.max("h").alias("upto"))
    return per.join(upto, F.col("src").eqNullSafe(F.col("src4")) & (F.col("block") == F.col("block4")), "left").select(
        "src", "block", "full", "order", F.col("state").isin("all").alias("taken"), "upto"
    )


def _planned(docs: DataFrame, target_entropy, max_repeats, budget, block_tokens, seed, evenness) -> DataFrame:
    """``docs`` with ``__src, __n, __h, __block, __weight, __repeats, __order, __copies``."""
    counted = _counted(docs)
    narrow = materialise(counted.select(F.col("__src").alias("src"), F.col("__n").alias("n_tokens"), F.col("__h").alias("h")), "tokens")
    sources = source_table(narrow)
    sources = materialise(weights(sources, choose_exponent(sources, target_entropy, max_repeats, evenness), budget), "weights")
    sources = small(sources, SOURCES)
    count = F.greatest(F.lit(LEAST_BLOCKS), F.ceil(F.col("tokens") / F.lit(block_tokens)))
    dealt = sources.select(F.col("src").alias("__s"), count.alias("__k"), F.col("weight").alias("__weight"), F.col("repeats").alias("__repeats"))
    block = lambda h: F.pmod(h, F.col("__k")).cast("bigint")
    rows = narrow.join(dealt, F.col("src").eqNullSafe(F.col("__s"))).select("src", "n_tokens", "h", block(F.col("h")).alias("block"))
    blocks = materialise(_blocks(rows, sources, block_tokens, seed), "plan")
    blocks = small(blocks.select(*[F.col(c).alias(f"__b_{c}") for c in blocks.columns]), BLOCKS)
    out = counted.join(dealt, F.col("__src").eqNullSafe(F.col("__s"))).withColumn("__block", block(F.col("__h")))
    out = out.join(blocks, F.col("__src").eqNullSafe(F.col("__b_src")) & (F.col("__block") == F.col("__b_block")))
    last = F.col("__b_taken") | F.coalesce(F.col("__h") <= F.col("__b_upto"), F.lit(False))
    copies = F.when(F.col("__n") == 0, F.greatest(F.lit(1), F.col("__b_full"))).otherwise(F.col("__b_full") + last.cast("bigint"))
    return out.withColumns({"__copies": copies.cast("int"), "__order": F.col("__b_order")})


def plan(
    docs: DataFrame, target_entropy: float | None = None, max_repeats: float | None = 2.0, budget: int | None = None,
    block_tokens: int = BLOCK_TOKENS, seed: int = 7, evenness: float | None = None,
) -> DataFrame:
    """For every document: tokens, its source's weight and passes, its block and that block's place, and its copies."""
    of = _planned(docs.select("doc_id", "text", "source"), target_entropy, max_repeats, budget, block_tokens, seed, evenness)
    return of.select(
        "doc_id", F.col("__src").alias("source"), F.col("__n").alias("n_tokens"), F.col("__weight").alias("weight"),
        F.col("__repeats").alias("repeats"), F.col("__block").alias("block"), F.col("__order").alias("block_order"), F.col("__copies").alias("copies"),
    )


def mix(
    docs: DataFrame, target_entropy: float | None = None, max_repeats: float | None = 2.0, budget: int | None = None,
    block_tokens: int = BLOCK_TOKENS, seed: int = 7, evenness: float | None = None,
) -> DataFrame:
    """``docs`` with each row as often as the plan says."""
    of = _planned(docs, target_entropy, max_repeats, budget, block_tokens, seed, evenness)
    return of.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("__copies")))).select(*docs.columns)
