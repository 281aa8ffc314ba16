"""What the queries read: documents as newspaper pages, with a Finnish or Swedish sentence added to each.

The driver's documents have no words on river ice, so each whole text gets one of a fixed list of sentences, by its id. Names of
files carry a date by the same id. Lines of a document stand for the blocks of a page, placed by their number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.plans.registry import list_sql, table

SENTENCES = (
    "Oulujoki jäätyi tänään 15. marraskuuta. Jää on wahwaa.",
    "Kemijoen jäänlähtö alkoi 3.5.1899 aamulla.",
    "Tulwa nousi Tornionjoella maaliskuulla vuonna 1903.",
    "Rankkasade ja tulva Iijoella 4/7 1888.",
    "Jääpatoja on Kiiminkijoella, hyytö seisoo; jään paksuus 11 p:nä huhtikuuta oli suuri.",
    "Eilen jäät lähtivät Kokemäenjoesta, ja jääpato meni v. 1910.",
    "Ter vehdys To ppilan satamasta. Wesi on jäätyw1nen joka paikassa.",
    "Jokia ei mainittu tällä kertaa.",
    "Islossning: isen gick den 12 maj 1871, översvämning väntas.",
    "Suuri tulva ja jäälautta uhkaa siltaa 31.12.05 Kemin luona.",
)
N = len(SENTENCES)
LINE_WIDTH = 4000


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, text, filename``."""
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    added = F.element_at(F.array(*[F.lit(s) for s in SENTENCES]), (1 + k % N).cast("int"))
    name = F.format_string("%d-%02d-%02d_page-001.txt", 1850 + k % 80, 1 + k % 12, 1 + k % 28)
    return d.select("doc_id", "lang", "source", F.concat("text", F.lit(" "), added).alias("text"), name.alias("filename"))


PAGES = f"""pages AS (
    SELECT doc_id, lang, source, text || ' ' || ({list_sql(SENTENCES)})[1 + doc_id % {N}] AS text,
           printf('%d-%02d-%02d_page-001.txt', 1850 + doc_id % 80, 1 + doc_id % 12, 1 + doc_id % 28) AS filename
    FROM documents)"""


def layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, page_width, blocks``: a block for each line of a document."""
    d = table(spark, sf_dir, "documents")

    def block(t, i):
        return F.struct(
            i.cast("string").alias("block_id"), ((i * 7919) % 3001).cast("int").alias("vpos"),
            ((F.col("doc_id") * 131 + i * 977) % LINE_WIDTH).cast("int").alias("hpos"), t.alias("text"),
            F.size(F.regexp_extract_all(t, F.lit(r"(?U)(\S+)"), F.lit(1))).alias("word_count"),
        )

    width = F.when(F.col("doc_id") % 11 == 0, 0).otherwise(LINE_WIDTH - 200).cast("int")
    return d.select("doc_id", width.alias("page_width"), F.transform(F.split("text", "\n"), block).alias("blocks"))


LAYOUTS = f"""lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
blocks AS (
    SELECT doc_id, i, text, (i * 7919) % 3001 AS vpos, (doc_id * 131 + i * 977) % {LINE_WIDTH} AS hpos,
           len(regexp_extract_all(text, '[^\\t-\\r\\x{{85}}\\p{{Z}}]+')) AS word_count,
           CASE WHEN doc_id % 11 = 0 THEN 0 ELSE {LINE_WIDTH - 200} END AS page_width
    FROM lines)"""
