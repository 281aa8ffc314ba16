"""Sources and sinks by round trip: whole tables are written, or put into page XML, and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import text as tx
from strandline.functions.text import exploded
from strandline.operators import catalog
from strandline.plans.catalog_queries import _issues
from strandline.plans.registry import ORACLES, query, shared_folder, table, tokens_sql
from strandline.sources import alto, files, sinks

NO_XML = r"[^\x09\x0A\x0D\x20-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]"  # what no XML file may hold
SPACES = ("http://www.loc.gov/standards/alto/ns-v4#", "http://www.loc.gov/standards/alto/ns-v2#", "")
DIVIDED = 3  # of ten words the one that is divided between two lines


@query(ORACLES["manifest_projection"])
def manifest_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest as a CSV file and read back."""
    folder = shared_folder(spark, "manifest")
    sinks.manifest(catalog.manifest(_issues(spark, sf_dir), "jää joki"), folder, single=False)
    return files.manifest(spark, folder)


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS binding_id, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS date,
       nullif(['Oulujoki', '', 'Kemijoki, "Kemi"'][1 + o_orderkey % 3], '') AS river_hint, o_orderstatus AS event_type,
       'jää "' || o_orderpriority || '",' || chr(10) || 'lähti' AS snippet
FROM orders""")
def events_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a CSV file, with quotes, commas and line ends in fields, blank rivers and dates that can't be read."""
    k, folder = F.col("o_orderkey"), shared_folder(spark, "events")
    rivers = F.array(F.lit("Oulujoki"), F.lit(""), F.lit('Kemijoki, "Kemi"'))
    rows = table(spark, sf_dir, "orders").select(
        k.cast("string").alias("binding_id"), F.when(k % 7 == 0, "keväällä").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"),
        F.element_at(rivers, (1 + k % 3).cast("int")).alias("river_hint"), F.col("o_orderstatus").alias("event_type"),
        F.concat(F.lit('jää "'), "o_orderpriority", F.lit('",\nlähti')).alias("snippet"),
    )
    rows.write.csv(folder, header=True, quote='"', escape='"', emptyValue="")
    return files.events(spark, folder)


@query("""
SELECT 'nation-' || n_nationkey || '.txt' AS filename, n_name || chr(10) || 'jää ' || n_regionkey || chr(10) AS text, 'nation-' || n_nationkey || '.txt' AS source FROM nation""")
def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts written by source and read back, once strictly and once leniently, which agree."""
    folder = shared_folder(spark, "texts")
    name = F.concat(F.lit("nation-"), F.col("n_nationkey").cast("string"), F.lit(".txt"))
    text = F.concat("n_name", F.lit("\njää "), F.col("n_regionkey").cast("string"))
    sinks.texts(table(spark, sf_dir, "nation").select(name.alias("filename"), text.alias("text")), folder, "filename")
    source = F.regexp_extract("path", "source=([^/]*)/", 1)
    read = lambda strict: files.texts(spark, folder, strict=strict).select(source.alias("source"), "text")
    return read(False).join(read(True), ["source", "text"]).select(F.col("source").alias("filename"), "text", "source")


@query("""
SELECT 'ISSN-' || c_custkey AS issn, c_name AS name, CASE WHEN c_custkey % 4 = 0 THEN CAST(1800 + c_custkey % 100 AS VARCHAR) END AS "startYear" FROM customer""")
def title_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles from bodies that are a list, an object with titles, one with results, or one with another name for them."""
    k = F.col("c_custkey")
    title = F.to_json(F.array(F.struct(
        F.concat(F.lit("ISSN-"), k.cast("string")).alias("issn"), F.col("c_name").alias("name"), F.when(k % 4 == 0, 1800 + k % 100).alias("startYear"))))
    body = F.when(k % 5 == 0, title)
    for i, name in enumerate(("titles", "results", "rows"), 1):
        body = body.when(k % 5 == i, F.concat(F.lit(f'{{"{name}":'), title, F.lit("}")))
    body = body.otherwise(F.concat(F.lit(" "), title))
    return files.title_rows(spark, table(spark, sf_dir, "customer").select(body.alias("body"))).select("issn", "name", "startYear")


def _page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, content``: documents as page XML of three name spaces, each line a block; some words are divided, some lines empty."""

    def quoted(c: Column) -> Column:
        for plain, entity in (("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;")):
            c = F.replace(c, F.lit(plain), F.lit(entity))
        return c

    def word(w: Column, i: Column) -> Column:
        halves = F.concat(
            F.lit('<String SUBS_TYPE="HypPart1" CONTENT="'), quoted(F.substring(w, 1, 2)), F.lit('" SUBS_CONTENT="'), quoted(w),
            F.lit('"/><HYP CONTENT="-"/><String SUBS_TYPE="HypPart2" CONTENT="'), quoted(F.substr(w, F.lit(3))), F.lit('"/>'),
        )
        return F.when((i % 10 == DIVIDED) & (F.length(w) > 4), halves).otherwise(F.concat(F.lit('<String CONTENT="'), quoted(w), F.lit('"/><SP/>')))

    def block(line: Column, i: Column) -> Column:
        return F.concat(
            F.lit('<TextBlock ID="'), i.cast("string"), F.lit('" VPOS="'), (i * 10).cast("string"), F.lit('.5" HPOS="3"><TextLine>'),
            F.array_join(F.transform(tx.tokens(line), word), ""), F.lit("</TextLine></TextBlock>"),
        )

    k = F.col("doc_id")
    space = F.element_at(F.array(*[F.lit(f' xmlns="{s}"' if s else "") for s in SPACES]), (1 + k % 3).cast("int"))
    lines = F.split(F.regexp_replace("text", NO_XML, ""), "\n")
    xml = F.concat(
        F.lit("<alto"), space, F.lit("><Description><softwareName> reader "), (k % 5).cast("string"), F.lit(' </softwareName></Description><Layout><Page WIDTH="'),
        (k % 7 * 100).cast("string"), F.lit('.5" HEIGHT="3000"><PrintSpace>'), F.array_join(F.transform(lines, block), ""), F.lit("</PrintSpace></Page></Layout></alto>"),
    )
    return table(spark, sf_dir, "documents").select(F.concat(k.cast("string"), F.lit(".xml")).alias("path"), F.encode(xml, "UTF-8").alias("content"))


WORDS = f"""lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) - 1 AS i
    FROM (SELECT doc_id, regexp_replace(text, '{NO_XML}', '', 'g') AS t FROM documents)),
words AS (SELECT doc_id, i, {tokens_sql("line")} AS ws FROM lines WHERE regexp_matches(line, '[^\\t-\\r\\x{{85}}\\p{{Z}}]'))"""


@query(f"""
WITH {WORDS}
SELECT doc_id || '.xml' AS filename, CAST(doc_id % 7 * 100 AS INTEGER) AS page_width, 3000 AS page_height, 'reader ' || doc_id % 5 AS ocr_software,
       CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS place, CAST(i AS VARCHAR) AS block_id, CAST(i * 10 AS INTEGER) AS vpos,
       array_to_string(ws, ' ') AS text, CAST(len(ws) AS INTEGER) AS word_count, CAST(sum(len(ws)) OVER (PARTITION BY doc_id) AS INTEGER) AS page_words
FROM words""")
def alto_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of pages: dimensions, software, divided words, empty blocks and word counts, from XML of any name space."""
    pages = alto.parse(_page_files(spark, sf_dir), clean=False, order=False)
    keep = ("filename", "page_width", "page_height", "ocr_software", "word_count")
    of = exploded(pages.select(*keep, "blocks"), keep, F.col("blocks"), "b", "place")
    return of.select(*keep[:-1], "place", "b.block_id", "b.vpos", "b.text", F.col("b.word_count").alias("word_count"), F.col("word_count").alias("page_words"))


@query(f"""
WITH {WORDS},
parts AS (SELECT doc_id, i, list_transform(ws, lambda w, j: CASE WHEN (j - 1) % 10 = {DIVIDED} AND length(w) > 4 THEN w[1:2] || ' - ' || w[3:] ELSE w END) AS ws FROM words)
SELECT d.doc_id || '.xml' AS path, coalesce(string_agg(array_to_string(ws, ' '), ' ' ORDER BY i), '') AS text FROM documents d LEFT JOIN parts p ON p.doc_id = d.doc_id GROUP BY d.doc_id""")
def alto_flat_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of a page's XML as they stand, without layout."""
    return _page_files(spark, sf_dir).select("path", alto.flat_text("content").alias("text"))
