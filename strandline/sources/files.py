"""Files as DataFrames: texts, manifests, results and events."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.arrow import batched
from strandline.operators.catalog import MANIFEST_FIELDS

MANIFEST_SCHEMA = ", ".join(f"{c} string" for c in MANIFEST_FIELDS)
MATCHES = (
    "array<struct<sentence_index:int,sentence:string,normalized:string,ice_categories:array<string>,ice_patterns:array<string>,"
    "rivers:array<string>,publishing_date:string,year:int>>"
)
RESULT_SCHEMA = (
    "source_file string, source_path string, file_year int, sentences_total int, sentences_matched int, "
    f"categories_found map<string,bigint>, rivers_found map<string,bigint>, matches {MATCHES}"
)
EVENT_SCHEMA = "binding_id string, date date, river_hint string, event_type string, snippet string"


@batched("string")
def _utf8(content: pd.Series) -> pd.Series:
    """Bytes that are no UTF-8 are left out."""
    return content.map(lambda b: bytes(b).decode("utf-8", errors="ignore"))


def texts(spark: SparkSession, folder: str, recursive: bool = True, pattern: str = "*.txt", strict: bool = False) -> DataFrame:
    """``path, filename, text`` of text files. Bytes that are no UTF-8 are dropped; ``strict`` fails on them instead."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", pattern).load(folder)
    text = F.decode("content", "UTF-8") if strict else _utf8("content")
    return found.select("path", F.regexp_extract("path", r"[^/]*$", 0).alias("filename"), text.alias("text"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest file: seventeen string columns."""
    return spark.read.csv(path, header=True, schema=MANIFEST_SCHEMA, multiLine=True, quote='"', escape='"').fillna("")


def results(spark: SparkSession, folder: str, lines: bool = False) -> DataFrame:
    """Result files of the sentence matcher: one object a file, or one a line. Spark skips names that begin with ``_``: summaries."""
    return spark.read.json(folder, schema=RESULT_SCHEMA, multiLine=not lines, recursiveFileLookup=True, pathGlobFilter="*.json")


def events(spark: SparkSession, path: str) -> DataFrame:
    """An event file; a date that can't be read is null, as is an empty field."""
    rows = spark.read.csv(path, header=True, schema=EVENT_SCHEMA.replace("date date", "date string"), multiLine=True, quote='"', escape='"')
    return rows.withColumn("date", F.coalesce(F.try_to_date("date"), F.try_to_timestamp("date").cast("date")))


def title_rows(spark: SparkSession, bodies: DataFrame, body: str = "body") -> DataFrame:
    """Titles from JSON bodies that are a list, or an object with ``titles``, with ``results``, or with a list as first value."""
    title = (
        "struct<issn:string,title:string,name:string,language:string,startYear:string,start_year:string,firstIssueDate:string,"
        "endYear:string,end_year:string,lastIssueDate:string>"
    )
    as_list = F.from_json(body, f"array<{title}>")
    named = F.from_json(body, f"struct<titles:array<{title}>,results:array<{title}>>")
    first = F.element_at(F.map_values(F.from_json(body, "map<string,string>")), 1)
    some = lambda a: F.when(F.size(a) > 0, a)
    is_list = F.ltrim(F.col(body)).startswith("[")
    rows = F.when(is_list, as_list).otherwise(
        F.coalesce(some(named["titles"]), some(named["results"]), F.from_json(first, f"array<{title}>"))
    )
    return bodies.select(F.inline(rows))
