"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document; the ledger holds its measurements and one bit for each rule that fails.
Policies are named masks over those bits, so another policy, or the effect of leaving one rule out, is a bitwise filter or
aggregate over the ledger and never reads a text again. Only Spark SQL functions are used.

A null text has no words, fails ``few_words`` and is not kept. Repeated rows get equal results; an empty table gives an
empty ledger; columns other than ``doc_id`` and ``text`` are ignored. Windows of three words are compared by 64-bit hash
within their own text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm._native import let, words

#: name: (SQL over the measurements that is true where the rule fails), in the order of their bits.
RULES = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "many_symbols": "10 * n_symbols > n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines and n_lines >= 4",
    "shouting": "10 * n_bangs > 3 * n_words",
    "word_length": "word_chars < 2 * n_words or word_chars > 25 * n_words",
}
#: A policy is the rules that it obeys. Versions are added, never changed.
POLICIES = {
    "base-1": ("few_words", "repeated_windows"),
    "web-1": ("few_words", "repeated_windows", "many_symbols", "repeated_lines", "shouting", "word_length"),
}


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask(policy: str) -> int:
    return sum(map(bit, POLICIES[policy]))


def _repeat_words(ws: Column) -> Column:
    """Words that lie in a window of three words found twice or more."""
    windows = F.array_sort(
        F.transform(
            F.sequence(F.lit(0), F.size(ws) - 3),
            lambda i: F.struct(F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)).alias("h"), i.alias("i")),
        )
    )
    found = let(
        windows,
        lambda s: F.filter(s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"])),
    )
    starts = F.array_sort(F.transform(found, lambda x: x["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda acc, x: F.struct(x.alias("last"), (acc["n"] + F.least(F.lit(3), x - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    return F.when(F.size(ws) < 4, F.lit(0)).otherwise(covered)


def measure(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the measurements that the rules are written over."""
    text = F.coalesce(F.col("text"), F.lit(""))
    of_words = let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            _repeat_words(w).cast("bigint").alias("n_repeat_words"),
        ),
    )
    of_lines = let(
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        lambda x: F.struct(
            F.size(x).cast("bigint").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines")
        ),
    )
    return docs.select(
        "doc_id",
        of_words.alias("w"),
        of_lines.alias("l"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        F.regexp_count(text, F.lit("!")).cast("bigint").alias("n_bangs"),
    ).select("doc_id", "w.*", "l.*", "n_symbols", "n_bangs")


def ledger(docs: DataFrame) -> DataFrame:
    """Measurements and ``failures``, the bits of the rules that fail."""
    failed = [F.when(F.expr(sql), F.lit(bit(name))).otherwise(F.lit(0)) for name, sql in RULES.items()]
    out = failed[0]
    for one in failed[1:]:
        out = out.bitwiseOR(one)
    return measure(docs).withColumn("failures", out)


def apply_policy(of: DataFrame, policy: str) -> DataFrame:
    """The ledger with ``policy`` and ``kept``: no rule of the policy fails."""
    return of.withColumns({"policy": F.lit(policy), "kept": F.col("failures").bitwiseAND(F.lit(mask(policy))) == 0})


def ablations(of: DataFrame, policy: str) -> DataFrame:
    """For each rule of the policy: documents that it fails, and those that would be kept without it."""
    held = F.col("failures").bitwiseAND(F.lit(mask(policy)))
    sums = [
        F.struct(
            F.lit(rule).alias("rule"),
            F.count_if(held.bitwiseAND(F.lit(bit(rule))) != 0).alias("fails"),
            F.count_if(held == bit(rule)).alias("fails_alone"),
        )
        for rule in POLICIES[policy]
    ]
    return of.agg(F.array(*sums).alias("rules"), F.count(F.lit(1)).alias("documents")).select(
        F.inline("rules"), "documents"
    )


def judge(docs: DataFrame, policy: str = "web-1") -> DataFrame:
    """The ledger under ``policy``, with the verdict of the two base rules beside it."""
    base = F.col("failures").bitwiseAND(F.lit(mask("base-1"))) != 0
    return apply_policy(ledger(docs), policy).withColumns({"base_failed": base, "kept": F.col("kept") & ~base})
