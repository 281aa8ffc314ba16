"""Writers. Each writes a folder of part files, or one file where ``single`` asks for it; keys are full paths, so none collide."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.catalog import COVERAGE_FIELDS, MANIFEST_FIELDS
from strandline.operators.extract import event_records, flat_matches


def _csv(df: DataFrame, path: str, single: bool) -> None:
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="")


def manifest(rows: DataFrame, path: str, single: bool = True) -> None:
    _csv(rows.select(*MANIFEST_FIELDS), path, single)


def coverage(rows: DataFrame, path: str, single: bool = True) -> None:
    _csv(rows.select(*COVERAGE_FIELDS), path, single)


def matches_csv(results: DataFrame, path: str, single: bool = True) -> None:
    """Ten columns; without matches a file of the header alone."""
    _csv(flat_matches(results), path, single)


def events_csv(events: DataFrame, path: str, single: bool = True) -> None:
    _csv(event_records(events), path, single)


def results_json(results: DataFrame, path: str) -> None:
    """One JSON object a line for each matched file."""
    results.write.mode("overwrite").json(path, ignoreNullFields=False)


def summary_json(summary: DataFrame, path: str) -> None:
    summary.coalesce(1).write.mode("overwrite").json(path, ignoreNullFields=False)


def texts(rows: DataFrame, path: str, source: str, text: str = "text") -> None:
    """The text of each source under ``source=...``."""
    rows.select(F.col(source).alias("source"), F.col(text).alias("value")).write.mode("overwrite").partitionBy("source").text(path, lineSep="\n")
