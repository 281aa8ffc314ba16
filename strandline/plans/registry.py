"""Queries by name, and the same in SQL where SQL can say it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with its SQL."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the one that the cluster names in ``spark.checkpoint.dir``; a temporary one only in one process."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}"
    return f"{root.rstrip('/')}/strandline-{name}/{uuid.uuid4().hex}"


# SQL of the functions that many queries use; \s and \p{L} of the engine at hand know ASCII and Unicode respectively
WS = r"[\t-\r\x{85}\p{Z}]"
NOT_WS = r"[^\t-\r\x{85}\p{Z}]"


def text_sql(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def list_sql(values) -> str:
    return "[" + ", ".join(text_sql(v) for v in values) + "]"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def sentences_sql(x: str) -> str:
    parts = f"string_split(regexp_replace({x}, '([.!?]){WS}+', '\\1' || chr(1), 'g'), chr(1))"
    return f"list_filter(list_transform({parts}, lambda s: {strip_sql('s')}), lambda s: s <> '')"


def tokens_sql(x: str) -> str:
    return f"regexp_extract_all({x}, '{NOT_WS}+')"


def fold_sql(x: str) -> str:
    return f"translate(replace(replace(replace(lower({x}), 'w', 'v'), 'ph', 'f'), 'ck', 'kk'), 'âôû', 'äöu')"
