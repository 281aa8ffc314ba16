"""Correction of OCR errors: rules, and a scorer that judges each word in its context.

A scorer gets sentences with one word masked and returns the likeliest words there with their shares. ``NgramScorer`` is a
stand-in trained on the corpus itself, which needs no model file; another is any object with the method of ``Scorer``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import lexicons as lx
from strandline.functions import spans as sp
from strandline.functions import text as tx
from strandline.operators import ngrams
from strandline.operators.ngrams import CHUNK, TOP

THRESHOLD = 0.01
FLAG = "struct<position:int,original:string,suggestion:string,reason:string,rule_name:string,confidence:double>"


class Scorer(Protocol):
    def fill(self, left: list[str], right: list[str]) -> list[tuple[list[str], list[float]]]:
        """For each masked place, with the word before and the word after it, the likeliest words and their shares."""
        ...


class NgramScorer:
    """Shares of the words that the corpus has between two neighbours, and else after the left one.

    The ``TOP`` words of every context seen ``least`` times or more count, and nothing is cut as the corpus grows:
    ``model_flags`` counts and looks up in blocks (``ngrams``), where hot left words are dealt by the word after, too.
    """

    def __init__(self, rows: DataFrame, text: str, least: int, size: int, hot: ngrams.HotWords):
        self.rows, self.text, self.least, self.size, self.hot = rows, text, least, size, hot

    @staticmethod
    def _grams(rows: DataFrame, text: str) -> DataFrame:
        ws = F.concat(F.array(F.lit("")), F.transform(tx.tokens(F.col(text)), lambda w: F.btrim(w, F.lit(tx.PUNCTUATION))), F.array(F.lit("")))
        return rows.select(ws.alias("w")).where("size(w) > 2").select(
            F.inline(F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.struct(
                F.get("w", i - 1).alias("l"), F.get("w", i).alias("m"), F.get("w", i + 1).alias("r"))))
        )

    @classmethod
    def tables(cls, rows: DataFrame, text: str = "text", least: int = 2) -> tuple[DataFrame, DataFrame]:
        """Both tables as rows, for a few places."""
        grams = cls._grams(rows, text)

        def top(*keys: str) -> DataFrame:
            counts = grams.groupBy(*keys, "m").agg(F.count(F.lit(1)).alias("n"))
            total = counts.groupBy(*keys).agg(F.sum("n").alias("total")).where(F.col("total") >= least)
            place = Window.partitionBy(*keys).orderBy(F.desc("n"), "m")  # each task keeps TOP rows of a context before they move
            best = counts.withColumn("k", F.row_number().over(place)).where(F.col("k") <= TOP)
            best = best.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", "m", "n"))).alias("best")).join(total, list(keys))
            return best.select(*keys, F.transform("best", lambda b: F.struct(b["m"].alias("m"), (b["n"] / F.col("total")).alias("p"))).alias("best"))

        return top("l", "r"), top("l")

    @classmethod
    def fit(cls, rows: DataFrame, text: str = "text", least: int = 2) -> NgramScorer:
        return cls(rows, text, least, *ngrams.size_and_hot(rows, text))

    def unlikely(self, rows: DataFrame, threshold: float, key: str, text: str) -> DataFrame:
        own = self.rows is rows and self.text == text
        size = self.size if own else self.size + (rows.agg(F.sum(F.length(text)).alias("n")).first()["n"] or 0) // 6  # some words
        return ngrams.unlikely(rows, None if own else self.rows, size, self.hot, self.least, threshold, key, text, self.text)

    def fill(self, left: list[str], right: list[str]) -> list[tuple[list[str], list[float]]]:
        """The same for a few places at once."""
        rows = [(i, a, b) for i, (a, b) in enumerate(zip(left, right))]
        asked = F.broadcast(self.rows.sparkSession.createDataFrame(rows, "i int, l string, r string"))
        pair, single = self.tables(self.rows, self.text, self.least)
        both = pair.join(asked, ["l", "r"]).select("i", "best", F.lit(0).alias("k")).union(single.join(asked, "l").select("i", "best", F.lit(1)))
        found: dict[int, list] = {}
        for r in both.orderBy("k").collect():  # two as many as asked
            found.setdefault(r["i"], r["best"])
        return [([b["m"] for b in found.get(i, [])], [b["p"] for b in found.get(i, [])]) for i in range(len(rows))]


def model_flags(rows: DataFrame, scorer: Scorer | NgramScorer, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, token, original, suggestion, position, confidence, context`` of words that the scorer finds unlikely.

    Words that a rule flags already are left out before they are scored.
    """
    white = tx.array_of(sorted(lx.WHITELIST))
    admitted = (
        (F.length("bare") >= 3) & F.col("bare").rlike(f"[{lx.LETTERS}]") & ~F.array_contains(white, F.lower("bare")) & sp.ocr_rule(F.col("bare")).isNull()
    )
    if isinstance(scorer, NgramScorer):
        return scorer.unlikely(rows, threshold, key, text).where(admitted).drop("bare")

    bare = lambda w: F.btrim(w, F.lit(tx.PUNCTUATION))
    parts = tx.exploded(rows, (key, text), tx.word_chunks(F.col(text), CHUNK), "sentence", "chunk")
    words = tx.exploded(parts.select(key, text, "chunk", tx.tokens(F.col("sentence")).alias("ws")), (key, text, "chunk", "ws"), F.col("ws"), "original", "i")
    words = words.withColumn("bare", bare(F.col("original"))).where(admitted)
    around = F.array_join(F.slice("ws", F.greatest(F.lit(1), F.col("i") - 2), F.col("i") + 4 - F.greatest(F.lit(0), F.col("i") - 3)), " ")
    asked = words.select(
        key, "chunk", F.col("i").alias("token"), "original", "bare", (F.instr(text, F.col("original")) - 1).alias("position"),
        F.coalesce(bare(F.get("ws", F.col("i") - 1)), F.lit("")).alias("before"), F.coalesce(bare(F.get("ws", F.col("i") + 1)), F.lit("")).alias("after"), around.alias("context"),
    )
    shared = rows.sparkSession.sparkContext.broadcast(scorer)

    @F.pandas_udf("suggestion string, confidence double, p double")
    def judge(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for word, a, b in batches:
            found = model.fill(a.tolist(), b.tolist())
            yield pd.DataFrame({
                "suggestion": [ws[0] if ws else "" for ws, _ in found],
                "confidence": [ps[0] if ps else 0.0 for _, ps in found],
                "p": [dict(zip(ws, ps)).get(w, 0.0) for w, (ws, ps) in zip(word, found)],
            })

    scored = asked.withColumn("s", judge("bare", "before", "after"))
    return scored.where(F.col("s.p") < threshold).select(key, "chunk", "token", "original", "s.suggestion", "position", "s.confidence", "context")


def correct(
    rows: DataFrame, scorer: Scorer | NgramScorer | None = None, auto_correct: bool = False, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``key, text, corrected_text, flags, n_flagged, n_corrected`` of every text; ``key`` is unique.

    Without ``auto_correct`` texts stay. With it, digits in words are mended, and suggestions taken that the scorer is sure of.
    """
    one = lambda of, reason: of.select(
        key, F.struct(
            F.col("position").cast("int").alias("position"), "original", "suggestion", F.lit(reason).alias("reason"),
            (F.col("rule_name") if reason == "rule" else F.lit("low_probability")).alias("rule_name"),
            (F.lit(0.0) if reason == "rule" else F.col("confidence")).alias("confidence"),
        ).alias("flag"),
    )
    flags = one(sp.ocr_flags(rows, key, text), "rule")
    if scorer is not None:
        flags = flags.unionByName(one(model_flags(rows, scorer, threshold, key, text), "model"))
    gathered = flags.groupBy(key).agg(F.array_sort(F.collect_list("flag")).alias("flags"))  # of one text
    out = rows.select(key, text).join(gathered, key, "left").withColumn("flags", F.coalesce("flags", F.expr(f"cast(array() as array<{FLAG}>)")))
    new = sp.apply_corrections(F.col(text), F.col("flags")) if auto_correct else F.col(text)
    better = F.filter("flags", lambda f: (f["suggestion"] != "") & (f["suggestion"] != f["original"]))
    return out.select(key, text, new.alias("corrected_text"), "flags", F.size("flags").alias("n_flagged"), F.size(better).alias("n_corrected"))


def flags_by_rank(flags: DataFrame, key: str = "doc_id", most: int = 10) -> DataFrame:
    """The first flags of each text, by position."""
    place = Window.partitionBy(key).orderBy("position", "token")
    return flags.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= most)
