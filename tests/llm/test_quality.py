import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from strandline.llm import quality

SF = "/root/testdata/sf0.01"


def auc(score, label):
    order = np.argsort(score, kind="stable")
    ranks = np.empty(len(score))
    values, inverse, n = np.unique(score, return_inverse=True, return_counts=True)
    ends = np.cumsum(n)
    ranks = (ends - (n - 1) / 2)[inverse]
    pos = label == 1
    assert len(order) and len(values)
    return (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def held_out(got, label, modulus, remainder):
    labels = {r["doc_id"]: r[label] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist() if r[label] is not None}
    rows = [r for r in got if r["held_out"] and r["doc_id"] in labels]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % modulus == remainder for r in rows)
    return rows, np.array([labels[r["doc_id"]] for r in rows])


def test_held_out_accuracy(spark):
    got = quality.quality_scores(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert len(got) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    rows, y = held_out(got, "quality", 4, 2)
    score = np.array([r["score"] for r in rows])
    assert auc(score, y) > 0.95
    assert ((score >= 0.7) == (y == 1)).mean() > 0.88


def test_odd_tables(spark):
    rows = [(i, ("Clean words of a plain text. " if i % 2 else "#$% JUNK!!! ") * (1 + i % 5)) for i in range(60)] + [(100, None), (101, ""), (None, "x"), (3, "twice")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as score", "'a' as label", "2 as x")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(1, None), (None, 1), (500, 1)], "doc_id bigint, quality int")
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == len(rows) and all(r["score"] is not None for r in got)
    by = {r["doc_id"]: r for r in got}
    assert by[100]["score"] == by[101]["score"]
    assert np.mean([by[i]["score"] > 0.5 for i in range(60) if i % 2 and i != 3]) > 0.9 > 0.1 > np.mean([by[i]["score"] > 0.5 for i in range(0, 60, 2)])
    none = quality.quality_scores(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality.quality_scores(docs.limit(0), labels).collect() == []
    model = quality.train(docs, labels, F.lit(True))
    kept = quality.keep_good(docs, model, 0.5)
    assert kept.columns == docs.columns and 0 < kept.count() < len(rows)


def test_tables_are_the_whole_model():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    y = (x[:, 0] * x[:, 1] + 0.5 * x[:, 2] > 0).astype(float)  # a pair matters
    model = quality.fit(x, y)
    assert ((model.score(x) > 0.5) == (y == 1)).mean() > 0.85 and (1, 0) in model.pairs
    b = model.bins(x[:3])
    by_hand = [model.bias + sum(t[b[k, j]] for j, t in enumerate(model.tables)) + sum(g[model.coarse[i][b[k, i]], model.coarse[j][b[k, j]]] for (i, j), g in zip(model.pairs, model.grids)) for k in range(3)]
    assert model.margin(x[:3]) == pytest.approx(by_hand)
