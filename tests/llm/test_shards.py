import hashlib

import numpy as np
import pytest

from strandline.llm import shards


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 65, 1000, 4097])
def test_permutation_is_one_to_one(n):
    numbers = np.arange(n)
    slots = shards.permute(numbers, n, key=99)
    assert sorted(slots.tolist()) == list(range(n))
    assert (shards.permute(slots, n, key=99, inverse=True) == numbers).all()
    if n > 100:
        assert (slots != shards.permute(numbers, n, key=100)).any() and abs(np.corrcoef(numbers, slots)[0, 1]) < 0.2


ROWS = [(1, "abc"), (2, None), (3, ""), (4, "é" * 40), (5, "x" * 63), (6, "y" * 64), (None, "z"), (1, "abc")]


def table(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as slot", "2 as task", "'p' as payload")


def back(of, read, width=2):
    """The tokens of each document, by id, from its pieces; equal ids come one after another."""
    parts = {}
    for r in sorted(of, key=lambda r: r["slot"]):
        for p in r["pieces"]:
            parts.setdefault(p["doc_id"], []).append((p["first"], read[r["slot"]][p["at"] : p["at"] + p["n"]].tolist()))
    return {i: [t for _, p in sorted(ps, key=lambda x: x[0]) for t in p] for i, ps in parts.items()}


def test_shards_hold_all_sequences_in_order(spark, tmp_path):
    docs = table(spark)
    of = shards.write_shards(docs, f"file://{tmp_path}/s", key=5, length=16, records=4).collect()
    n = len(of)
    assert sorted(r["slot"] for r in of) == list(range(n))
    assert sum(r["n_tokens"] for r in of) == sum(len((t or "").encode()) + 1 for _, t in ROWS)
    assert sum(r["n_tokens"] < 16 for r in of) <= docs.rdd.getNumPartitions()
    read = list(shards.read_records(f"file://{tmp_path}/s", 0, n, n, length=16, records=4))
    assert len(read) == n
    for r in of:
        raw = read[r["slot"]]
        assert hashlib.sha256(raw.tobytes()).hexdigest() == r["record_sha256"] and r["byte_offset"] == r["slot"] % 4 * 32
        assert (raw[r["n_tokens"] :] == shards.FREE + 1).all() and sum(p["n"] for p in r["pieces"]) == r["n_tokens"]
    docs_of = back(of, read)
    assert bytes(docs_of[4][:-1]).decode() == "é" * 40 and docs_of[4][-1] == shards.FREE and docs_of[2] == [shards.FREE]
    assert bytes(docs_of[6][:-1]).decode() == "y" * 64 and bytes(docs_of[None][:-1]) == b"z" and len(docs_of[1]) == 8
    later = list(shards.read_records(f"file://{tmp_path}/s", 7, 3, n, length=16, records=4))
    assert [x.tolist() for x in later] == [x.tolist() for x in read[7:10]]
    assert {(r["slot"], r["record_sha256"]) for r in shards.manifest(docs, 5, 16, 4).collect()} == {(r["slot"], r["record_sha256"]) for r in of}
    assert shards.manifest(docs.limit(0), 1).collect() == []


def test_wide_ids_and_a_very_long_text(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a" * 3_000_000), (2, "b")], "doc_id int, text string")
    wide = lambda: lambda texts: [np.frombuffer(t.encode(), np.uint8).astype("<u4").tobytes() for t in texts]
    of = shards.write_shards(docs, f"file://{tmp_path}/i", key=1, encode=wide, free=70_000, width=4).collect()
    read = list(shards.read_records(f"file://{tmp_path}/i", 0, len(of), len(of), width=4))
    docs_of = back(of, read)
    assert docs_of[1] == [97] * 3_000_000 + [70_000] and docs_of[2] == [98, 70_000]


def test_query_writes_shards_of_vocabulary_ids(spark, monkeypatch, tmp_path):
    from strandline.llm import bpe, queries

    monkeypatch.setattr(queries, "shared_dir", lambda _: f"file://{tmp_path}")
    sf = "/root/testdata/sf0.001"
    of = queries.op7_training_order(spark, sf).collect()
    (folder,) = (tmp_path / "strandline").iterdir()
    read = list(shards.read_records(f"file://{folder}", 0, len(of), len(of)))
    assert len(read) == len(of)
    machine = bpe.automaton(str(queries.vocabulary()))
    texts = {r["doc_id"]: r["text"] or "" for r in queries.table(spark, sf, "documents").collect()}
    for r in of:
        raw = read[r["slot"]]
        assert hashlib.sha256(raw.tobytes()).hexdigest() == r["record_sha256"] and (raw[r["n_tokens"] :] == machine.n + 1).all()
    docs_of = back(of, read)
    assert set(docs_of) == set(texts)
    for i in sorted(texts)[:40]:
        assert docs_of[i] == machine.encode(texts[i]) + [machine.n]
