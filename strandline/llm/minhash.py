"""Document fingerprints by one-permutation MinHash.

Each run of five words is hashed once. The top bits of a hash name its bin, and each bin keeps its least hash. A bin without
one takes that of another bin, found by the bin's own pseudo-random walk over all bins (optimal densification: the walk
depends on the empty bin alone, so two texts agree as often as their sets do). The low byte of each bin is stored; the share
of equal bytes, corrected for those equal by chance, estimates the Jaccard similarity. Only Spark SQL functions are used.

A null text is the empty text. Texts of fewer than five words are one run, the empty text a run of no words, so equal texts
always have equal fingerprints. Rows with the same id and text are one document; of an id with several texts, these follow
each other by hash; null ids come last in descending order. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm._common import materialise
from strandline.llm._native import let, window_hashes, words

BINS = 256  # one for each value of a hash's top byte
SHINGLE = 5
TRIES = 6  # steps of a walk tried one by one, before all steps are compared at once
_REST = (1 << 56) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _walk(i: int) -> tuple[int, int]:
    """Odd step and start of bin ``i``'s walk."""
    x = (i * 0x9E3779B97F4A7C15 + 0xD1B54A32D192ED03) % (1 << 64)
    x = ((x ^ (x >> 31)) * 0xBF58476D1CE4E5B9) % (1 << 64)
    x ^= x >> 29
    return (x >> 8) % BINS | 1, (x >> 24) % BINS


def codes(text: Column) -> Column:
    """The low bytes of all bins after densification, as array<smallint>.

    Bins are numbered by the signed order of their hashes. A sentinel above all other hashes of its bin stands for an empty
    one, so after sorting the first hash of each bin is its place in the array.
    """
    order = [_signed(((b + 128) % BINS) << 56 | _REST) for b in range(BINS)]
    sentinels = F.array(*[F.lit(v) for v in order])
    step, start = (F.array(*[F.lit(_walk(i)[k]) for i in range(BINS)]) for k in (0, 1))
    inverse = F.array(*[F.lit(pow(_walk(i)[0], -1, BINS)) for i in range(BINS)])
    top = lambda x: F.shiftrightunsigned(x, 56)
    empty = lambda x: x.bitwiseAND(F.lit(_REST)) == _REST

    def densified(bins: Column) -> Column:
        full = F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda j: ~empty(F.get(bins, j)))

        def fill(held: Column) -> Column:
            def value(x: Column, i: Column) -> Column:
                def at(t: int) -> Column:
                    found = F.get(bins, (F.get(step, i) * t + F.get(start, i)).bitwiseAND(F.lit(BINS - 1)))
                    return F.when(~empty(found), found)

                def first() -> Column:  # the full bin that the walk comes to first
                    when = lambda j: ((j - F.get(start, i)) * F.get(inverse, i)).bitwiseAND(F.lit(BINS - 1))
                    return F.get(bins, F.array_min(F.transform(held, lambda j: when(j) * BINS + j)).bitwiseAND(F.lit(BINS - 1)))

                return F.when(~empty(x), x).otherwise(F.coalesce(*[at(t) for t in range(TRIES)], first()))

            return F.transform(bins, lambda x, i: value(x, i).bitwiseAND(F.lit(255)).cast("smallint"))

        return let(full, fill)

    hashed = let(words(text), lambda w: window_hashes(w, SHINGLE))
    ordered = F.sort_array(F.concat(hashed, sentinels))
    firsts = let(ordered, lambda s: F.filter(s, lambda x, j: (j == 0) | (top(x) != top(F.get(s, j - 1)))))
    return let(firsts, densified)


def packed(text: Column) -> Column:
    """The fingerprint of a text as binary, a byte for each bin."""
    return F.unhex(F.array_join(F.transform(codes(text), lambda x: F.substring(F.hex(x.cast("int") + 256), 2, 2)), ""))


def written(fingerprint: Column) -> Column:
    """The bytes as hexadecimal digits."""
    return F.lower(F.hex(fingerprint))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two packed fingerprints, from 0 to 1."""
    byte = lambda f, i: F.substring(f, i, F.lit(1))
    same = F.aggregate(F.sequence(F.lit(1), F.lit(BINS)), F.lit(0), lambda n, i: n + (byte(a, i) == byte(b, i)).cast("int"))
    chance = 1 / 256
    return F.greatest(F.lit(0.0), (same / F.lit(BINS) - F.lit(chance)) / F.lit(1 - chance))


def followers(keys: DataFrame) -> DataFrame:
    """For each document (``doc_id, h, n``) the next one in descending order, and after the last the first.

    Ranges of ids are numbered by their partitions; only the first row of each range meets those of the others.
    """
    ranged = materialise(
        keys.repartitionByRange(F.desc_nulls_last("doc_id"), F.asc("h")).withColumn("part", F.spark_partition_id()), "ranges"
    )
    inside = Window.partitionBy("part").orderBy(F.desc_nulls_last("doc_id"), F.asc("h"))
    near = ranged.select(
        "*", F.row_number().over(inside).alias("k"), F.lead(F.struct("doc_id", "h")).over(inside).alias("next")
    )
    heads = near.where("k = 1").select("part", F.struct("doc_id", "h").alias("head"))
    over = Window.orderBy("part")  # one row for each range
    whole = over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = heads.select("part", F.coalesce(F.lead("head").over(over), F.first("head").over(whole)).alias("head"))
    return near.join(F.broadcast(after), "part").select(
        "doc_id", "h", "n", F.coalesce("next", "head").alias("next")
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, packed`` of every whole text."""
    rows = docs.select("doc_id", packed(F.coalesce("text", F.lit(""))).alias("packed"))
    return rows.select("doc_id", written(F.col("packed")).alias("fingerprint"), "packed")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Every document against its edited text and against the next document, in descending order of ids.

    In the edited text, the last third of the code points is replaced by the first as many of the next document.
    Whole texts are dealt out by key once; what crosses to the neighbour is a prefix and a packed fingerprint.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    links = followers(base.groupBy("doc_id", "h").agg(F.max(F.length("text")).cast("bigint").alias("n")))
    base = base.withColumn("own", packed(F.col("text")))
    asked = links.select(
        F.col("next.doc_id").alias("y"), F.col("next.h").alias("yh"),
        F.col("doc_id").alias("x"), F.col("h").alias("xh"), F.floor(F.col("n") / 3).cast("int").alias("m"),
    )
    given = (
        base.join(asked, F.col("doc_id").eqNullSafe(F.col("y")) & (F.col("h") == F.col("yh")))
        .select("x", "xh", F.expr("substring(text, 1, m)").alias("prefix"), F.col("own").alias("theirs"))
        .dropDuplicates(["x", "xh"])
    )
    n = F.length("text")
    both = base.join(given, F.col("doc_id").eqNullSafe(F.col("x")) & (F.col("h") == F.col("xh"))).select(
        "doc_id", n.cast("bigint").alias("n_chars"), "own", "theirs",
        F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 3) as int))"), F.col("prefix")).alias("edited"),
    )
    return both.withColumn("edit", packed(F.col("edited"))).select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        written(F.col("own")).alias("fingerprint"),
        written(F.col("edit")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edit")).alias("near_edited"),
        likeness(F.col("own"), F.col("theirs")).alias("near_next"),
    )
