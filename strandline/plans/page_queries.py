"""Queries on layout and segmentation, over documents whose lines are the blocks of a page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import lexicons as lx
from strandline.functions.text import exploded
from strandline.operators import layout, reports, segments
from strandline.plans.corpus import LAYOUTS, layouts
from strandline.plans.registry import list_sql, query
from strandline.plans.text_queries import HEADER

COLUMNS = """spread AS (SELECT doc_id, page_width, (max(hpos) - min(hpos)) / nullif(page_width, 0) AS s FROM blocks GROUP BY 1, 2),
columns AS (SELECT doc_id, CASE WHEN page_width = 0 THEN 4 WHEN s < 0.2 THEN 2 WHEN s < 0.4 THEN 3 WHEN s < 0.65 THEN 4 WHEN s < 0.8 THEN 5 ELSE 6 END AS n FROM spread)"""


def _placed(rows: DataFrame) -> DataFrame:
    of = exploded(rows, ("doc_id",), F.col("ordered"), "b", "place")
    return of.select("doc_id", "place", F.col("b.block_id").alias("block_id"))


@query(f"""
WITH {LAYOUTS}
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN page_width > 0 THEN CAST(floor(hpos / (page_width / 4)) AS INTEGER) ELSE vpos END,
    CASE WHEN page_width > 0 THEN vpos ELSE hpos END, i) - 1 AS INTEGER) AS place, CAST(i AS VARCHAR) AS block_id FROM blocks""")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = layouts(spark, sf_dir)
    return _placed(rows.withColumn("ordered", layout.reading_order(F.col("blocks"), F.col("page_width"))))


@query(f"WITH {LAYOUTS}, {COLUMNS} SELECT doc_id, CAST(n AS INTEGER) AS n_columns FROM columns")
def column_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layouts(spark, sf_dir).select("doc_id", layout.estimate_columns(F.col("blocks"), F.col("page_width")).alias("n_columns"))


@query(f"""
WITH {LAYOUTS}, {COLUMNS}
SELECT b.doc_id, CAST(row_number() OVER (PARTITION BY b.doc_id ORDER BY least(CAST(floor(hpos / CASE WHEN page_width > 0 THEN page_width / n ELSE 1000 END) AS INTEGER), n - 1), vpos, i) - 1 AS INTEGER) AS place,
       CAST(i AS VARCHAR) AS block_id FROM blocks b JOIN columns c ON c.doc_id = b.doc_id""")
def column_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = layouts(spark, sf_dir)
    return _placed(rows.withColumn("ordered", layout.column_order(F.col("blocks"), F.col("page_width"))))


@query(f"WITH {LAYOUTS} SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY i) AS full_text, CAST(sum(word_count) AS INTEGER) AS word_count FROM blocks GROUP BY 1")
def page_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = layouts(spark, sf_dir)
    return rows.select("doc_id", layout.page_text(F.col("blocks")).alias("full_text"), layout.page_words(F.col("blocks")).alias("word_count"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layouts(spark, sf_dir).select("doc_id", F.transform("blocks", lambda b: b["text"]).alias("texts"))


@query(f"""
WITH {LAYOUTS},
words AS (SELECT doc_id, i, w FROM (SELECT doc_id, i, unnest(regexp_extract_all(lower(text), '[{lx.LETTERS}]{{3,}}')) AS w FROM blocks) WHERE NOT list_contains({list_sql(sorted(lx.STOPWORDS))}, w)),
sides AS (SELECT w.doc_id, b.i, w.w, count(*) FILTER (w.i < b.i) AS x, count(*) FILTER (w.i >= b.i) AS y
    FROM blocks b JOIN words w ON w.doc_id = b.doc_id AND w.i BETWEEN b.i - 3 AND b.i + 2 GROUP BY 1, 2, 3),
sums AS (SELECT doc_id, i, sum(x * y) AS xy, sum(x * x) AS xx, sum(y * y) AS yy FROM sides GROUP BY 1, 2)
SELECT b.doc_id, CAST(b.i AS INTEGER) AS gap, round(CASE WHEN xx > 0 AND yy > 0 THEN xy / (sqrt(xx) * sqrt(yy)) ELSE 0.0 END, 9) AS similarity
FROM blocks b LEFT JOIN sums s ON s.doc_id = b.doc_id AND s.i = b.i""")
def cosine_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = exploded(_texts(spark, sf_dir), ("doc_id",), segments.similarities(F.col("texts")), "s", "gap")
    return of.select("doc_id", "gap", F.round("s", 9).alias("similarity"))


@query()
def texttiling_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depths of all gaps; a climb that stops has no SQL, so tests compare with plain Python."""
    sims = _texts(spark, sf_dir).select("doc_id", segments.similarities(F.col("texts")).alias("s"))
    return exploded(sims, ("doc_id",), segments.depths(F.col("s")), "d", "gap").select("doc_id", "gap", F.round("d", 9).alias("depth"))


@query()
def valley_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where articles end, and why."""
    of = exploded(_texts(spark, sf_dir), ("doc_id",), segments.boundaries(F.col("texts")), "b")
    return of.select("doc_id", "b.gap", F.col("b.type").alias("boundary_type"))


@query(f"WITH {LAYOUTS}, {HEADER} SELECT doc_id, CAST(i - 1 AS INTEGER) AS gap FROM headers WHERE is_header AND i > 0")
def header_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(_texts(spark, sf_dir), ("doc_id",), segments.header_gaps(F.col("texts")), "gap")


@query(f"""
WITH {LAYOUTS}, {HEADER}, cut AS (SELECT doc_id, i, is_header AND i > 0 AS cut FROM headers),
ids AS (SELECT doc_id, i, sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS segment FROM cut)
SELECT doc_id, CAST(segment AS INTEGER) AS segment, CAST(min(i) AS INTEGER) AS first, CAST(count(*) AS INTEGER) AS n_blocks,
       CASE WHEN segment < max(max(segment)) OVER (PARTITION BY doc_id) THEN 'header' ELSE '' END AS boundary_type
FROM ids GROUP BY doc_id, segment""")
def segments_by_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments between headers alone."""
    gaps = F.transform(segments.header_gaps(F.col("texts")), lambda g: F.struct(g.alias("gap"), F.lit("header").alias("type")))
    of = _texts(spark, sf_dir).select("doc_id", "texts", gaps.alias("gaps"))
    return of.select("doc_id", F.posexplode(segments.segments(F.col("texts"), F.col("gaps"))).alias("segment", "s")).select("doc_id", "segment", "s.*")


@query()
def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole page pipeline: columns, boundaries, joined blocks, normalised text, title."""
    return segments.articles(layouts(spark, sf_dir))


@query()
def articles_on_ice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.articles(layouts(spark, sf_dir), ice_only=True)


@query()
def article_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.article_counts(segments.article_segments(layouts(spark, sf_dir)), "doc_id")
