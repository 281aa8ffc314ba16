"""ALTO pages.

A page's XML tree is read once, by an Arrow-batched function that returns what the tree holds: dimensions, software, and blocks as
arrays of lines of words. All rules on words, lines and blocks are Spark SQL functions over that.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, chain
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import text as tx
from strandline.functions.arrow import batched, parts
from strandline.operators.layout import page_text, page_words, reading_order

WORD = "struct<content:string,kind:string,whole:string>"
RAW_BLOCK = f"struct<block_id:string,vpos:int,hpos:int,lines:array<array<{WORD}>>>"
RAW = f"page_width:int,page_height:int,ocr_software:string,blocks:array<{RAW_BLOCK}>,error:string"
NOISY = 0.3


def _local(tag: object) -> str:
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


def _whole(element: ElementTree.Element | None, name: str) -> int:
    return round(float(element.get(name) or 0)) if element is not None else 0


def _tree(content: bytes) -> tuple:
    """Width, height, software and blocks (id, vertical and horizontal place, lines of words) of a page, as tuples.

    Elements count in the namespace of the root only.
    """
    root = ElementTree.fromstring(content)
    space = root.tag[: root.tag.index("}") + 1] if root.tag.startswith("{") else ""
    page, software = root.find(f".//{space}Page"), root.find(f".//{space}softwareName")
    words: dict[object, bool] = {}  # whether a tag is a word's

    def line_of(line: ElementTree.Element) -> list[tuple[str, str, str]]:
        out = []
        for w in line:
            if (known := words.get(w.tag)) is None:
                known = words[w.tag] = _local(w.tag) == "String"
            if known:
                get = w.attrib.get
                out.append((get("CONTENT", ""), get("SUBS_TYPE", ""), get("SUBS_CONTENT", "")))
        return out

    blocks = [
        (block.get("ID", ""), _whole(block, "VPOS"), _whole(block, "HPOS"), [line_of(line) for line in block.iter(f"{space}TextLine")])
        for block in root.iter(f"{space}TextBlock")
    ]
    return _whole(page, "WIDTH"), _whole(page, "HEIGHT"), (software.text or "").strip() if software is not None else "", blocks


def read_tree(content: bytes) -> dict:
    """What a page's tree holds."""
    width, height, software, blocks = _tree(content)
    word = lambda w: dict(zip(("content", "kind", "whole"), w))
    found = [{"block_id": k, "vpos": v, "hpos": h, "lines": [[word(w) for w in line] for line in lines]} for k, v, h, lines in blocks]
    return {"page_width": width, "page_height": height, "ocr_software": software, "blocks": found, "error": None}


def _lists(lists: list[list], of: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(accumulate(map(len, lists), initial=0), pa.int32()), of)


def _columns(pages: list[tuple]) -> pa.Array:
    """Pages (as of ``_tree``, and an error) as one array, built column by column: no dict stands for a word."""
    width, height, software, per_page, errors = zip(*pages)
    blocks = list(chain.from_iterable(per_page))
    ids, vpos, hpos, per_block = zip(*blocks) if blocks else ((), (), (), ())
    lines = list(chain.from_iterable(per_block))
    words = list(chain.from_iterable(lines))
    content, kind, whole = zip(*words) if words else ((), (), ())
    struct = lambda **columns: pa.StructArray.from_arrays([pa.array(c, k) if k else c for c, k in columns.values()], list(columns))
    text, number = pa.string(), pa.int32()
    word = struct(content=(content, text), kind=(kind, text), whole=(whole, text))
    block = struct(block_id=(ids, text), vpos=(vpos, number), hpos=(hpos, number), lines=(_lists(per_block, _lists(lines, word)), None))
    return struct(page_width=(width, number), page_height=(height, number), ocr_software=(software, text), blocks=(_lists(per_page, block), None), error=(errors, text))


@batched(f"struct<{RAW}>")
def _parsed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for contents in batches:
        made = []
        for part in parts(contents):
            pages = []
            for content in part.to_pylist():
                try:
                    pages.append((*_tree(content), None))
                except (ElementTree.ParseError, ValueError, OverflowError) as e:
                    pages.append((0, 0, "", [], f"{type(e).__name__}: {e}"))
            made.append(_columns(pages))
        yield pa.concat_arrays(made)


@batched("string")
def flat_text(contents: pd.Series) -> pd.Series:
    """All ``CONTENT`` of a tree, joined; empty if it can't be read."""

    def one(content: bytes) -> str:
        try:
            found = [e.get("CONTENT") for e in ElementTree.fromstring(bytes(content)).iter()]
        except ElementTree.ParseError:
            return ""
        return " ".join(w for w in found if w and w.strip())

    return contents.map(one)


def line_text(words: Column) -> Column:
    """Words of a line: the first part of a divided word stands for the whole, the second for nothing."""
    kept = F.filter(words, lambda w: (w["kind"] == "HypPart1") | ((w["kind"] != "HypPart2") & (tx.strip(w["content"]) != "")))
    whole = F.transform(kept, lambda w: F.when((w["kind"] == "HypPart1") & (w["whole"] != ""), w["whole"]).otherwise(w["content"]))
    return tx.let(whole, lambda ws: F.when(F.size(ws) > 0, F.array_join(ws, " ")))


def block_text(lines: Column) -> Column:
    return F.array_join(F.filter(F.transform(lines, line_text), lambda t: t.isNotNull()), "\n")


def blocks_of(raw: Column, clean: bool = True) -> Column:
    """``array<struct<block_id, vpos, hpos, text, word_count, has_ocr_issues>>`` without empty blocks."""

    def one(b: Column) -> Column:
        return tx.let(
            block_text(b["lines"]),
            lambda t: tx.let(
                tx.clean_text(t) if clean else t,
                lambda c: F.struct(
                    b["block_id"].alias("block_id"), b["vpos"].alias("vpos"), b["hpos"].alias("hpos"), c.alias("text"),
                    F.size(tx.tokens(c)).alias("word_count"), (tx.noisy_share(t) > NOISY).alias("has_ocr_issues"),
                ),
            ),
        )

    return F.filter(F.transform(raw, one), lambda b: tx.strip(b["text"]) != "")


def parse(files: DataFrame, clean: bool = True, order: bool = True, fail_fast: bool = False) -> DataFrame:
    """Pages of files (``path, content``): ``path, filename, full_text, blocks, word_count, page_width, page_height, ocr_software, error``.

    A file that can't be read is a page without blocks and with an ``error``; ``fail_fast`` makes it fail the job.
    """
    raw = files.select("path", _parsed("content").alias("p")).select("path", "p.*")
    if fail_fast:
        raw = raw.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(F.concat_ws(": ", "path", "error")).cast("string")))
    made = raw.withColumn("blocks", blocks_of(F.col("blocks"), clean))
    if order:
        made = made.withColumn("blocks", reading_order(F.col("blocks"), F.col("page_width")))
    return made.select(
        "path", F.regexp_extract("path", r"[^/]*$", 0).alias("filename"), page_text(F.col("blocks")).alias("full_text"), "blocks",
        page_words(F.col("blocks")).alias("word_count"), "page_width", "page_height", "ocr_software", "error",
    )


def read(spark: SparkSession, folder: str, recursive: bool = True, **options) -> DataFrame:
    """Pages of the XML files of a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.xml").load(folder)
    return parse(files.select("path", "content"), **options)


def plain_text(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """``path, text``: all words as they stand, without layout."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.xml").load(folder)
    return files.select("path", flat_text("content").alias("text"))
