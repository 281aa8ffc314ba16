"""The sieve before the OCR rules: wider than the rules, and asked once a batch."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandline.functions import spans as sp
from strandline.functions import text as tx
from strandline.functions import words
from strandline.plans import text_queries as q
from strandline.plans.corpus import pages

ODD = "a1b jää1tyi aaaa böööök ÅÄÖÅÄÖÅÄ aBcDeF ab|cd Kptrs Ptrſtr xptsk kruunu Schtroumpf ΑΒΓΔabcde 漢字abcde ́abbbb \U0001d400abcdfe ab\x1cc1d xⅨyyyy KKKKK".split(" ")


def test_sieve_keeps_all_that_a_rule_flags(spark):
    of = tx.exploded(pages(spark, "/root/testdata/sf0.01"), (), tx.tokens(F.col("text")), "w").select(F.btrim("w", F.lit(tx.PUNCTUATION)).alias("w")).distinct()
    of = of.union(spark.createDataFrame([(w,) for w in ODD], "w string"))
    slow = F.lit(False)
    for pattern in sp.OCR_RULES.values():
        slow = slow | F.col("w").rlike("(?U)" + pattern)
    slow = slow | F.coalesce(F.col("w").rlike("[a-zA-ZåäöÅÄÖ]{5,}") & (tx.vowel_share(F.col("w")) < 0.26), F.lit(False))
    got = of.select("w", slow.alias("slow"), sp.ocr_rule(F.col("w")).isNotNull().alias("rule")).collect()
    kept = words.sieve(words.strings([r["w"] for r in got]))
    assert all(r["slow"] == r["rule"] for r in got)  # guards change nothing
    assert all(k for r, k in zip(got, kept) if r["rule"]) and 0.01 < sum(r["rule"] for r in got) / len(got) < sum(kept) / len(got) < 0.5


@pytest.mark.parametrize("name", ["ocr_flags", "flag_counts", "apply_corrections", "ocr_rules_by_word"])
def test_only_sieved_words_become_rows(spark, name):
    df = q.QUERIES[name](spark, "/root/testdata/sf0.001") if hasattr(q, "QUERIES") else getattr(q, name)(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "split(" not in plan  # no row for each word


def test_words_are_those_of_the_tokens(spark):
    texts = ["a\x1cb c\x1d d", "x\x85y z᠎1", "", None, " \n", "a b　c.", "﻿a ​b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.tokens(F.col("t")).alias("w"))
    assert [(r["w"] or []) == words.words_of(r["t"] or "") for r in df.collect()] == [True] * len(texts)
    assert words.Words(texts).words.to_pylist() == [w for t in texts for w in words.words_of(t or "")] and pa.array(words.Words([]).ids).null_count == 0
