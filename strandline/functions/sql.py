"""The functions of this package under names for SQL: ``register(spark)`` makes them known to a session.

Those that SQL can say are SQL functions, which the optimizer inlines; grammars of dates and the XML tree are Arrow-batched or table
functions: ``SELECT d.* FROM pages, LATERAL text_dates(text) d``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from strandline.functions import spans as sp
from strandline.sources import alto


class TextDates:
    """The dates of a text, a row each."""

    def eval(self, text: str) -> Iterator[tuple]:
        for d in sp.dates_of(text or ""):
            yield d["day"], d["month"], d["year"], d["raw"], d["format"]


class AltoWords:
    """The words of a page's XML, a row each: ``block_id, vpos, hpos, line, word``; none if it can't be read."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        try:
            blocks = alto.read_tree(bytes(content))["blocks"]
        except (SyntaxError, ValueError, TypeError):  # a parse error is a SyntaxError
            return
        for b in blocks:
            for k, line in enumerate(b["lines"]):
                for w in line:
                    if w["kind"] == "HypPart1":
                        yield b["block_id"], b["vpos"], b["hpos"], k, w["whole"] or w["content"]
                    elif w["kind"] != "HypPart2" and w["content"].strip():
                        yield b["block_id"], b["vpos"], b["hpos"], k, w["content"]


SQL_FUNCTIONS = {
    "historical_fold(t STRING) RETURNS STRING": "translate(replace(replace(replace(lower(t), 'w', 'v'), 'ph', 'f'), 'ck', 'kk'), 'âôû', 'äöu')",
    "text_sentences(t STRING) RETURNS ARRAY<STRING>": r"""filter(transform(split(t, r'(?U)(?<=[.!?])\s+'), s -> regexp_replace(s, r'(?U)^\s+|\s+$', '')), s -> s <> '')""",
    "digits_to_letters(w STRING) RETURNS STRING": "translate(w, '0135678', 'oissbtB')",
    "year_of_name(f STRING) RETURNS INT": r"""cast(nullif(regexp_extract(f, r'(?U)\b(1[89]\d{2}|20\d{2})\b', 1), '') as int)""",
    "date_of_name(f STRING) RETURNS STRING": r"""nullif(regexp_extract(f, r'\d{4}-\d{2}-\d{2}', 0), '')""",
    "match_rate(m BIGINT, n BIGINT) RETURNS DOUBLE": "bround(m / greatest(n, 1) * 100, 1)",
}


def register(spark: SparkSession) -> None:
    for signature, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    spark.udtf.register("text_dates", udtf(TextDates, returnType="day int, month int, year int, raw string, format string"))
    spark.udtf.register("alto_words", udtf(AltoWords, returnType="block_id string, vpos int, hpos int, line int, word string"))
