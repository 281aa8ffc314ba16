import random
import re

import pytest

from strandline.llm import rules
from strandline.llm.queries import ORACLES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    at = {}
    for i in range(len(words) - 2):
        at.setdefault(tuple(words[i : i + 3]), []).append(i)
    repeated = {j for places in at.values() if len(places) > 1 for i in places for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return {
        "n_words": n, "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text or ""), "n_dup_lines": dup,
        "n_repeat_words": len(repeated), "base_failed": n < 50 or 100 * len(repeated) > 50 * n,
    }


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r"), (4, "a b c a b c"), (5, "a a a a"), (6, "é # <x>\nline\nline\nline "), (7, "w " * 300)]
    out += [(10 + i, "".join(rng.choice(["a ", "b ", "c\n", "dd ", "\t", "#", "é", " "]) for _ in range(rng.randint(0, 200)))) for i in range(80)]
    return out + [(200, " ".join(f"w{i}" for i in range(80)))]


def test_measurements_like_brute_force(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as n_words", "'x' as w", "2 as failures")
    got = {r["doc_id"]: r.asDict() for r in rules.judge(docs).collect()}
    for i, text in rows:
        want = brute(text)
        assert {k: got[i][k] for k in want} == want, text
        assert not (got[i]["base_failed"] and got[i]["kept"])
    assert got[200]["kept"] and not got[7]["kept"]
    assert rules.judge(docs.limit(0)).collect() == []


def test_ledger_serves_policies_and_ablations(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    ledger = rules.ledger(docs).cache()
    kept = {p: {r["doc_id"] for r in rules.apply_policy(ledger, p).where("kept").collect()} for p in rules.POLICIES}
    assert kept["web-1"] <= kept["base-1"]
    of = {r["rule"]: r for r in rules.ablations(ledger, "base-1").collect()}
    bits = {r["doc_id"]: r["failures"] & rules.mask("base-1") for r in ledger.collect()}
    for rule in rules.POLICIES["base-1"]:
        assert of[rule]["fails"] == sum(bool(b & rules.bit(rule)) for b in bits.values())
        assert of[rule]["fails_alone"] == sum(b == rules.bit(rule) for b in bits.values())
        assert of[rule]["documents"] == len(rows)


def test_sql_says_the_same(spark, rows, tmp_path):
    import duckdb

    from strandline.llm.queries import op9_quality_rules

    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    ours = op9_quality_rules(spark, str(tmp_path))
    names = sorted(ours.columns)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    theirs = con.execute(f"select {', '.join(names)} from ({ORACLES['op9_quality_rules']})").fetchall()
    assert sorted(map(tuple, ours.select(*names).collect())) == sorted(theirs)
