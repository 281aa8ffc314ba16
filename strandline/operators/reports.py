"""Counts and tables of a run, each a DataFrame to show or write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BAR = 40


def top_titles(records: DataFrame, title: str, most: int = 20) -> DataFrame:
    """``title, n`` of the titles with most records."""
    return records.groupBy(F.col(title).alias("title")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "title").limit(most)


def more_titles(records: DataFrame, title: str, most: int = 20) -> DataFrame:
    """``more``: how many titles the top leaves out."""
    return records.select(title).distinct().agg(F.greatest(F.lit(0), F.count(F.lit(1)) - most).alias("more"))


def decades(records: DataFrame, year: Column) -> DataFrame:
    """``decade, n, bar``: records by decade, with a bar for the share of the largest."""
    of = records.select(F.when(year.rlike(r"^\d+$"), year).try_cast("int").alias("y")).where("y is not null")
    counts = of.groupBy((F.floor(F.col("y") / 10) * 10).cast("int").alias("decade")).agg(F.count(F.lit(1)).alias("n"))
    most = counts.agg(F.max("n").alias("most"))  # one row beside a few decades
    unit = F.greatest(F.lit(1), F.floor(F.col("most") / BAR))
    bar = F.repeat(F.lit("█"), F.least(F.lit(BAR), F.floor(F.col("n") / unit)).cast("int"))
    return counts.join(F.broadcast(most), F.lit(True)).select("decade", "n", bar.alias("bar")).orderBy("decade")


def coverage_counters(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("alto_accessible").alias("alto_ok"), F.count_if("mets_accessible").alias("mets_ok"),
        F.count_if(~F.col("binding_found")).alias("no_binding"),
    )


def readable_titles(rows: DataFrame) -> DataFrame:
    """Titles whose text can be read, by first year."""
    years = F.concat_ws("–", F.col("available_from").cast("string"), F.col("available_to").cast("string"))
    return rows.where("alto_accessible").orderBy("available_from", "title").select(F.left("title", F.lit(40)).alias("title"), "issn", years.alias("years"), "sample_binding")


def without_binding(rows: DataFrame, most: int = 10) -> DataFrame:
    return rows.where(~F.col("binding_found")).orderBy("title", "issn").limit(most).select("title", "issn", "available_from", "available_to")


def article_counts(rows: DataFrame, source: str) -> DataFrame:
    """``articles, on_ice`` of each source."""
    return rows.groupBy(source).agg(F.count(F.lit(1)).alias("articles"), F.count_if("has_ice_keywords").alias("on_ice"))


def ranked(counts: DataFrame, name: str = "value") -> DataFrame:
    return counts.orderBy(F.desc("n"), name)


def flag_counts(flags: DataFrame, *keys: str) -> DataFrame:
    """``n_flagged, n_corrected``: flags, and those with another spelling to suggest."""
    other = (F.col("suggestion") != "") & (F.col("suggestion") != F.col("original"))
    return flags.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_flagged"), F.count_if(other).alias("n_corrected"))


def change_counts(changes: Column) -> list[Column]:
    """``n_changes, w_replacements`` of an array of changes."""
    return [F.size(changes).alias("n_changes"), F.size(F.filter(changes, lambda c: c["rule"] == "w→v")).alias("w_replacements")]


def change_sample(rows: DataFrame, key: str, changes: str = "changes", most: int = 20) -> DataFrame:
    """The changes that come first, each once."""
    of = rows.select(key, F.posexplode(changes).alias("i", "c")).groupBy("c.orig", "c.norm", "c.rule").agg(F.min(F.struct(key, "i")).alias("at"))
    return of.orderBy("at").limit(most).drop("at")


def download_tally(status: DataFrame) -> DataFrame:
    """``ok, failed`` of the bindings of ``bindingId, success``: one failed file fails its binding."""
    by = status.groupBy("bindingId").agg(F.bool_and("success").alias("ok"))
    return by.agg(F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"))
