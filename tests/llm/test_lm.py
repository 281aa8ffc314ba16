import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from strandline.llm import lm


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w] + [None]


def check(rows, got):
    held = {i: zlib.crc32(str(i if i is not None else "").encode()) % 7 == 2 for i, _ in rows}
    counts = Counter(w for i, t in rows if not held[i] for w in words(t))
    n, v = sum(counts.values()), len(counts)
    texts = dict(rows)
    for r in got:
        ws = words(texts[r["doc_id"]])
        assert r["held_out"] == held[r["doc_id"]] and r["n_tokens"] == len(ws) and r["train_tokens"] == n
        assert r["n_known"] == sum(counts[w] > 0 for w in ws)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
        assert r["score"] < 0 and math.isfinite(r["score"])
    return held


def test_scores_of_small_tables(spark):
    rows = [(i, t) for i, t in enumerate(["A b a", "", None, "é É b\tc", "x " * 500, "never seen anywhere", "a\x0bb"] * 6)] + [(None, "a b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' as word", "1 as block", "2 as n", "true as held_out")
    got = lm.score_documents(docs).collect()
    assert len(got) == len(rows)
    check(rows, got)
    again = {r["doc_id"]: r["score"] for r in lm.score_documents(docs.repartition(5)).collect()}
    assert all(again[r["doc_id"]] == pytest.approx(r["score"], rel=1e-4) for r in got)
    assert lm.score_documents(docs.limit(0)).collect() == []
    none = lm.score_documents(docs, held="true").collect()
    assert len(none) == len(rows) and {r["train_tokens"] for r in none} == {0} and {r["n_known"] for r in none} == {0}


def test_beats_the_base_on_texts_that_it_has_not_seen(spark):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    got = lm.score_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    held = check(rows, got)
    unseen = [r for r in got if held[r["doc_id"]]]
    tokens = sum(r["n_tokens"] for r in unseen)
    gain = sum(r["score"] - r["base_score"] for r in unseen) / tokens
    print(f"held-out log10 probability a token: base {sum(r['base_score'] for r in unseen) / tokens:.4f}, model {gain:+.4f}")
    assert gain > 0.1


def test_training_matches_observed_features(spark):
    """Every class is seen after every other, so no count of a feature is zero; trained shares come near the observed ones."""
    rng = np.random.default_rng(2)
    rows = [(c * (lm.CLASSES + 1) + b, k, int(rng.integers(5, 200))) for c, b in ((1, 2), (3, 2), (1, 7)) for k in range(lm.CLASSES)]
    weights = lm._train(spark.createDataFrame(rows, "context int, class int, n bigint").repartition(3))
    for context in {r[0] for r in rows}:
        seen = np.array([n for c, _, n in rows if c == context], float)
        got = np.exp(lm.log_probabilities(weights, np.array([context]))[0])
        assert np.abs(got - seen / seen.sum()).max() < 0.003


def test_probabilities_of_a_context_add_up():
    rng = np.random.default_rng(1)
    weights = rng.normal(size=(lm.HASHES, lm.CLASSES)).astype(np.float32)
    logs = lm.log_probabilities(weights, np.array([0, 5, 4000, (lm.CLASSES + 1) ** 2 - 1]))
    assert np.exp(logs).sum(axis=1) == pytest.approx(np.ones(4), rel=1e-5)
    classes = np.array([3, 4, 5, 6])
    at = lm.contexts(classes, np.array([0, 2]))
    none, k = lm.CLASSES, lm.CLASSES + 1
    assert at.tolist() == [none * k + none, none * k + 3, none * k + none, none * k + 5]
    rng = random.Random(1)
    assert all(lm.HEAD <= lm.tail_class(bytes([rng.randint(0, 255)] * rng.randint(1, 4))) < lm.CLASSES for _ in range(200))


def trained(observed, expected):
    """Selected classes and their weights of one feature, over all classes without shortcuts."""
    n, q = observed.sum(), np.maximum(expected, 1e-9) / np.maximum(expected, 1e-9).sum()
    chosen, w = [], np.zeros(len(q))
    for c in range(len(q)):
        first = math.log((observed[c] + lm.PRIOR * q[c]) / ((n + lm.PRIOR) * q[c]))
        gain = observed[c] * first - n * math.log1p(q[c] * math.expm1(first))
        if gain >= lm.GAIN and (observed[c] >= 2 or first < 0):
            chosen.append(c)
    for _ in range(lm.STEPS):
        e = q * np.exp(w)
        e *= n / e.sum()
        for c in chosen:
            w[c] += lm.WORD_PACE * (math.log(observed[c] + lm.PRIOR * q[c]) - math.log(e[c] + lm.PRIOR * q[c]))
    return {c: w[c] for c in chosen}


def test_word_features_against_plain_counts(spark):
    """Counts of neighbours, selection and updates, for every word, by plain loops."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["ab", "cd", "ef", "gh", "ij"]) + rng.choice("xyz") for _ in range(rng.randint(0, 60))) for _ in range(80)]
    texts += ["marker follower other"] * 9 + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    head = {lm.END: 0, b"abx": 1, b"other": 2}
    weights = np.random.default_rng(3).normal(size=(lm.HASHES, lm.CLASSES)).astype(np.float32) / 4
    blocks = lm._packed(docs.repartition(3), "doc_id % 5 = 1").cache()
    evidence = lm._evidence(blocks, head).cache()
    key_of = {(r["block"], r["place"]): r["key"] for r in evidence.where("block >= 0").collect()}
    by_key = {}
    for r in lm._word_features(evidence, weights).collect():
        assert by_key.setdefault(key_of[r["block"], r["place"]], bytes(r["data"])) == bytes(r["data"])  # each block has the same weights
    class_of = lambda w: head.get(w, lm.tail_class(w))
    share = lambda a, b: np.exp(lm.log_probabilities(weights, np.array([a * (lm.CLASSES + 1) + b]))[0].astype(float))
    seen, expected = {}, {}
    for i, t in enumerate(texts):
        if i % 5 == 1:
            continue
        ws = lm.tokens(t)
        for k, w in enumerate(ws):
            for kind, back in ((0, 1), (1, 2)):
                if k >= back and ws[k - back] not in head:
                    a = class_of(ws[k - 2]) if k >= 2 else lm.CLASSES
                    key = kind, ws[k - back]
                    seen.setdefault(key, np.zeros(lm.CLASSES))[class_of(w)] += 1
                    expected[key] = expected.get(key, 0) + share(a, class_of(ws[k - 1]))
    words = {w for _, w in seen}
    assert words
    for w in words:
        want = {}
        for kind in (0, 1):
            if (kind, w) in seen:
                want |= {kind * lm.CLASSES + c: x for c, x in trained(seen[kind, w], expected[kind, w]).items()}
        key = int(np.uint64(lm.word_key(w)).view(np.int64))
        flat = np.frombuffer(by_key.get(key, b""), lm.WEIGHT)
        have = dict(zip(flat["slot"].tolist(), flat["w"].astype(float)))
        assert have == pytest.approx(want, abs=4e-3)
    assert int(np.uint64(lm.word_key(b"marker")).view(np.int64)) in by_key
    assert 1 not in trained(np.array([9.0, 1, 0]), np.array([1.0, 1, 8]))


def test_gains_keep_probabilities_normalised():
    pack = lambda *x: np.array([(kind * lm.CLASSES + c, w) for kind, c, w in x], lm.WEIGHT).tobytes()
    data = pa.array([pack((0, 1, -2), (1, 1, 0.5)), pack((0, 1, 1.5), (1, 3, -1))], pa.binary())
    table = lm.WordFeatures(np.array([1, 0]), data, 3)
    shares = np.random.default_rng(0).dirichlet(np.ones(lm.CLASSES), 1).astype(np.float32)
    total = np.zeros(3)
    for c in range(lm.CLASSES):  # the third token stands after words 0 and 1; a text of its own begins at the fourth
        flat = np.array([0, 1, 2, 2])
        gains = table.gains(flat, np.array([0, 3]), np.array([c, c, c, c]), shares, np.zeros(4, int))
        assert gains[0] == gains[3] == 0
        total += shares[0, c] * np.exp(gains[:3])
        w = {1: -2.0, 3: -1.0}
        z = sum(shares[0, k] * math.exp(w.get(k, 0)) for k in range(lm.CLASSES))
        assert gains[2] == pytest.approx(w.get(c, 0) - math.log(z), abs=1e-3)
    assert total == pytest.approx(np.ones(3), rel=1e-4)
    assert lm.WordFeatures(np.zeros(0, np.int32), pa.array([], pa.binary()), 3).row.sum() == 0


def test_large_counts_take_several_records(monkeypatch):
    monkeypatch.setattr(lm, "MOST", 3)
    flat = np.zeros(8, np.int64)
    classes = np.full(8, lm.HEAD)
    offsets, values = lm._neighbours(flat, classes, lm.contexts(classes, np.array([0])), np.array([lm.HEAD]), 1)
    n = Counter()
    for v in values.tolist():
        n[v >> 7] += v & 127
    assert offsets.tolist() == [0, len(values)] and n == {lm.BEFORE + lm.CLASSES: 1, lm.BEFORE + lm.HEAD: 7, lm.AFTER + lm.HEAD: 7, lm.SECOND + lm.HEAD: 6}


ODD = ["A b\ta", "", " ", "  lead", "trail \n", "a\x0b\x0cb\r\nC", "a\x1cb c\x85d\u00a0e\u2003f", "\u00c9t\u00c9 \u0130 \u03a3", "x " * 300, "a\x00b \x00", "b a b"]


def test_tokens_in_arrow_are_those_of_each_text():
    texts = pa.chunked_array([pa.array(ODD[:4]), pa.array([], pa.string()), pa.array(["skipped", *ODD[4:]])[1:]])
    words, numbers, sizes = lm.tokenised(texts)
    want = [lm.tokens(t) for t in ODD]
    assert sizes.tolist() == [len(w) for w in want]
    flat = [w for ws in want for w in ws]
    assert [words[n].as_py() for n in numbers.tolist()] == flat and words.to_pylist() == list(dict.fromkeys(flat))
    head = {lm.END: 0, b"b": 1, b"skipped": 2}
    assert lm.classes_of(words, head).tolist() == [head.get(w, lm.tail_class(w)) for w in words.to_pylist()]
    got = lm.word_keys(words, lm.classes_of(words, head)).tolist()
    assert [k for k, w in zip(got, words.to_pylist()) if w not in head] == [lm.word_key(w) for w in words.to_pylist() if w not in head]


class Plain:
    """Stands for a DataFrame and its session; keeps the function that would run over its batches."""

    def __init__(self, shared=None):
        self.sparkSession = self.sparkContext = self
        self.value = shared

    def broadcast(self, value):
        return Plain(value)

    def mapInArrow(self, run, schema):
        return run


def test_no_step_makes_an_object_of_each_token(monkeypatch):
    """Three steps that did took most of the query's CPU seconds."""
    rows = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["a b a", "c a"]), pa.array([False, True])], ["doc_id", "text", "held_out"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as w:
        w.write_batch(rows)
    block = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "payload"])

    def tokens(text):
        raise AssertionError("tokens as Python objects")

    monkeypatch.setattr(lm, "tokens", tokens)
    (found,) = lm._block_words(Plain())(iter([block]))
    assert found.column("word").to_pylist() == [b"a", b"b", b"", b"c"] and found.column("n").to_pylist() == [2, 1, 1, 0]
    of, sums = lm._evidence(Plain(), {lm.END: 0, b"a": 1})(iter([block]))
    assert of.column("place").to_pylist() == [1, 3] and [len(x) for x in of.column("data").to_pylist()] == [6, 0]
    assert np.frombuffer(sums.column("data")[0].as_py(), np.int32).reshape(3, -1)[2].sum() == 4


def test_shuffle_files_of_a_table_go_when_it_is_written(spark):
    from strandline.llm import _common

    manager, setting = spark._jvm.org.apache.spark.SparkEnv.get().blockManager(), spark.conf.get(_common.FREE_SHUFFLE)
    files = lambda: {f for f in manager.diskBlockManager().getAllFiles().mkString("\n").split() if "shuffle_" in f}
    before = files()
    table = _common.materialise(spark.range(100).repartition(3, "id"), "freed", free=True)
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and table.count() == 100 and spark.conf.get(_common.FREE_SHUFFLE) == setting
