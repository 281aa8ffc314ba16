"""Queries on search manifests, titles and downloads, over orders, customers and suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import catalog, reports
from strandline.operators.extract import match_rate
from strandline.plans.registry import query, table

TEMPLATE = "/page-{{page}}.xml"


@query("""
SELECT c_custkey, '?startDate=1820-01-01&endDate=1939-12-31&formats=NEWSPAPER&requireOnline=true&query='
    || replace(url_encode(c_name || ' ' || c_mktsegment), '%20', '+')
    || CASE WHEN c_custkey % 3 = 2 THEN '' ELSE '&language=' || ['fi', 'sv'][1 + c_custkey % 3] END AS url
FROM customer""")
def search_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    language = F.element_at(F.array(F.lit("fi"), F.lit("sv"), F.lit("all")), (1 + F.col("c_custkey") % 3).cast("int"))
    url = catalog.search_url(F.lit("1820-01-01"), F.lit("1939-12-31"), F.concat_ws(" ", "c_name", "c_mktsegment"), language)
    return c.select("c_custkey", url.alias("url"))


@query("""
SELECT o_orderkey, 'https://example.org/' || o_custkey || replace('/page-{{page}}.xml', '{{page}}',
    CASE WHEN length(CAST(o_orderkey * 7 AS VARCHAR)) >= 5 THEN CAST(o_orderkey * 7 AS VARCHAR) ELSE lpad(CAST(o_orderkey * 7 AS VARCHAR), 5, '0') END) AS url
FROM orders""")
def page_file_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.concat(F.lit("https://example.org/"), F.col("o_custkey").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", catalog.page_url(base, F.lit(TEMPLATE), F.col("o_orderkey") * 7).alias("url"))


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as search results."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("bindingId"), F.col("o_orderpriority").alias("bindingTitle"),
        F.concat(F.lit("ISSN-"), (F.col("o_custkey") % 50).cast("string")).alias("publicationId"),
        F.when(F.col("o_orderkey") % 13 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"),
        F.col("o_orderstatus").alias("generalType"), (1 + F.col("o_orderkey") % 4).cast("int").alias("pageCount"),
        F.lit("https://example.org/").alias("baseUrl"),
        F.struct(F.array(F.lit("jää"), F.col("o_orderstatus")).alias("text")).alias("textHighlights"),
        F.when(F.col("o_orderkey") % 5 != 0, F.array(F.lit("jää"), F.lit("joki"))).alias("terms"),
    )


ISSUES = """issues AS (
    SELECT o_orderkey AS id, o_orderpriority AS title, 'ISSN-' || (o_custkey % 50) AS issn,
           CASE WHEN o_orderkey % 13 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS date, o_orderstatus AS kind, CAST(1 + o_orderkey % 4 AS INTEGER) AS n
    FROM orders)"""


@query(f"""
WITH {ISSUES}
SELECT CAST(id AS VARCHAR) AS "bindingId", title AS "bindingTitle", issn AS "publicationId", coalesce(date, '') AS date, substr(coalesce(date, ''), 1, 4) AS year,
       '' AS issue, kind AS "generalType", '' AS publisher, '1' AS "pageNumber", CAST(n AS VARCHAR) AS "pageCount", 'https://example.org/' AS "baseUrl",
       '' AS "pdfUrl", '' AS url, '' AS "copyrightWarnings", 'jää ### ' || kind AS "textHighlights",
       CASE WHEN id % 5 <> 0 THEN 'jää,joki' ELSE '' END AS terms, 'jää joki' AS "searchQuery"
FROM issues""")
def manifest_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.manifest(_issues(spark, sf_dir), "jää joki")


@query(f"""
WITH {ISSUES}
SELECT CAST(id AS VARCHAR) AS "bindingId", CAST(page AS INTEGER) AS page, kind AS kind,
       issn || '/' || coalesce(substr(date, 1, 4), 'unknown') || '/' || id || '_page-' || lpad(CAST(page AS VARCHAR), 5, '0') || '.' || kind AS path
FROM (SELECT id, issn, date, unnest(generate_series(1, n)) AS page FROM issues), (VALUES ('xml'), ('txt')) AS k(kind)""")
def page_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = catalog.page_plan(catalog.manifest(_issues(spark, sf_dir), ""), all_pages=True, formats="both")
    return of.select("bindingId", "page", "kind", "path")


@query(f"""
WITH {ISSUES}
SELECT CAST(id AS VARCHAR) AS "bindingId", issn || '/' || coalesce(substr(date, 1, 4), 'unknown') || '/' || id || '_page-00001.xml' AS path
FROM issues WHERE id % 4 <> 0""")
def pending_downloads_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = catalog.page_plan(catalog.manifest(_issues(spark, sf_dir), ""))
    there = of.where(F.col("bindingId").cast("bigint") % 4 == 0).select("path")
    return catalog.pending(of, there).select("bindingId", "path")


@query(f"""
WITH {ISSUES}
SELECT id AS "bindingId", issn AS "publicationId" FROM (SELECT * FROM issues ORDER BY id LIMIT 1000) WHERE issn = 'ISSN-7'""")
def limit_then_issn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.first_then_issn(_issues(spark, sf_dir), 1000, "ISSN-7", ("bindingId",)).select("bindingId", "publicationId")


@query("""
SELECT o_orderkey AS "bindingId", coalesce(n, 1) AS "pageCount"
FROM orders LEFT JOIN (SELECT l_orderkey, max(l_linenumber) AS n FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY 1) ON o_orderkey = l_orderkey""")
def page_count_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_orderkey % 3 = 0")
    counts = lines.select(F.col("l_orderkey").cast("string").alias("bindingId"), F.col("l_linenumber").alias("pageCount"))
    return catalog.with_page_counts(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("bindingId")), counts)


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as titles, whose years come as numbers, as dates, or not at all."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("ISSN-"), k.cast("string")).alias("issn"), F.when(k % 9 != 0, F.col("c_name")).alias("title"), F.lit("fi").alias("language"),
        F.when(k % 4 == 0, (1780 + k % 160).cast("string")).otherwise("").alias("startYear"),
        F.when(k % 4 == 1, F.concat((1780 + k % 160).cast("string"), F.lit("-03-12"))).alias("firstIssueDate"),
        F.when(k % 5 != 0, (1800 + k % 130).cast("string")).alias("endYear"),
    )


TITLES = """titles AS (
    SELECT c_custkey AS k, 'ISSN-' || c_custkey AS issn, CASE WHEN c_custkey % 9 <> 0 THEN c_name ELSE 'Unknown' END AS title,
           CASE WHEN c_custkey % 4 IN (0, 1) THEN 1780 + c_custkey % 160 ELSE 1700 END AS since,
           CASE WHEN c_custkey % 5 <> 0 THEN 1800 + c_custkey % 130 ELSE 9999 END AS until
    FROM customer),
overlapping AS (
    SELECT *, CAST(greatest(since, 1820) AS INTEGER) AS available_from, CAST(least(until, 1890) AS INTEGER) AS available_to
    FROM titles WHERE since <= 1890 AND until >= 1820)"""


@query(f"WITH {TITLES} SELECT issn, available_from, available_to FROM overlapping")
def title_year_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.titles_overlapping(_titles(spark, sf_dir), 1820, 1890).select("issn", "available_from", "available_to")


def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = catalog.titles_overlapping(_titles(spark, sf_dir), 1820, 1890)
    ids = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("sample_binding"))
    samples = ids.select(F.concat(F.lit("ISSN-"), F.col("sample_binding").cast("string")).alias("issn"), "sample_binding")
    k = F.col("sample_binding")
    access = ids.select(
        "sample_binding", F.when(k % 3 != 0, F.concat(F.lit("<METS>"), F.repeat(F.lit("Alto "), (k % 9).cast("int")))).alias("mets"),
        F.when(k % 5 != 0, F.when(k % 7 == 0, F.lit("<html>")).otherwise("<ALTO/>")).alias("alto"),
        F.concat(F.lit("https://example.org/"), k.cast("string"), F.lit("/page-00001.xml")).alias("sample_alto_url"),
    )
    return catalog.coverage(titles, samples, access)


COVERAGE = f"""{TITLES},
coverage AS (
    SELECT title, issn, 'fi' AS language, available_from, available_to, k % 2 = 0 AS binding_found, CASE WHEN k % 2 = 0 THEN k END AS sample_binding,
           k % 2 = 0 AND k % 5 <> 0 AND k % 7 <> 0 AS alto_accessible, k % 2 = 0 AND k % 3 <> 0 AS mets_accessible,
           CASE WHEN k % 2 = 0 AND k % 3 <> 0 THEN CAST(greatest(1, (k % 9) // 2) AS INTEGER) END AS est_pages,
           CASE WHEN k % 2 = 0 THEN 'https://example.org/' || k || '/page-00001.xml' END AS sample_alto_url
    FROM overlapping)"""


@query(f"WITH {COVERAGE} SELECT * FROM coverage")
def probe_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coverage(spark, sf_dir)


@query(f"""
WITH {COVERAGE}
SELECT count(*) AS total, count(*) FILTER (alto_accessible) AS alto_ok, count(*) FILTER (mets_accessible) AS mets_ok,
       count(*) FILTER (NOT binding_found) AS no_binding FROM coverage""")
def coverage_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.coverage_counters(_coverage(spark, sf_dir))


@query(f"""
WITH {COVERAGE}
SELECT left(title, 40) AS title, issn, available_from || '–' || available_to AS years, sample_binding FROM coverage WHERE alto_accessible""")
def readable_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.readable_titles(_coverage(spark, sf_dir))


@query(f"WITH {COVERAGE} SELECT title, issn, available_from, available_to FROM coverage WHERE NOT binding_found ORDER BY title, issn LIMIT 10")
def titles_without_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.without_binding(_coverage(spark, sf_dir))


@query("""SELECT 'src' || (l_suppkey % 60) AS title, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, title LIMIT 20""")
def title_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("src"), (F.col("l_suppkey") % 60).cast("string")).alias("t"))
    return reports.top_titles(rows, "t")


@query("SELECT greatest(0, count(DISTINCT l_suppkey % 60) - 20) AS more FROM lineitem")
def title_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.more_titles(table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 60).alias("t")), "t")


@query("""
WITH d AS (SELECT CAST((1820 + o_custkey % 120) // 10 * 10 AS INTEGER) AS decade, count(*) AS n FROM orders WHERE o_orderkey % 17 <> 0 GROUP BY 1)
SELECT decade, n, repeat('█', CAST(least(40, n // greatest(1, (SELECT max(n) FROM d) // 40)) AS INTEGER)) AS bar FROM d""")
def decade_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    year = F.when(F.col("o_orderkey") % 17 != 0, (1820 + F.col("o_custkey") % 120).cast("string")).otherwise("n.d.")
    return reports.decades(o, year)


@query("""
SELECT o_orderstatus, count(*) FILTER (o_orderkey % 3 = 0) AS matched, count(*) AS total,
       round_even(count(*) FILTER (o_orderkey % 3 = 0) / greatest(count(*), 1) * 100, 1) AS pct FROM orders GROUP BY 1""")
def match_rate_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count_if(F.col("o_orderkey") % 3 == 0).alias("matched"), F.count(F.lit(1)).alias("total"))
    return counts.withColumn("pct", match_rate(F.col("matched"), F.col("total")))


@query("""
SELECT count(*) FILTER (ok) AS ok, count(*) FILTER (NOT ok) AS failed FROM (SELECT l_orderkey, bool_and(l_partkey % 10 <> 0) AS ok FROM lineitem GROUP BY 1)""")
def download_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("bindingId"), (F.col("l_partkey") % 10 != 0).alias("success"))
    return reports.download_tally(rows)
