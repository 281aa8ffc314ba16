import numpy as np

from strandline.llm import toxicity
from tests.llm.test_quality import SF, auc, held_out


def test_held_out_accuracy(spark):
    got = toxicity.toxicity_scores(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert len(got) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    rows, y = held_out(got, "toxic", 5, 0)
    score = np.array([r["score"] for r in rows])
    assert auc(score, y) > 0.9
    assert ((score >= 0.5) == (y == 1)).mean() > 0.85


def test_odd_tables(spark):
    rows = [(i, "a fine day at the river " + ("you vile wretch " if i % 2 else "with good folk ") * 2 + f"word{i}") for i in range(80)] + [(100, None), (101, ""), (None, "x"), (3, "twice")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as score", "'a' as y")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(1, None), (None, 1)], "doc_id bigint, toxic int")
    got = toxicity.toxicity_scores(docs, labels).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r["score"] for r in got if r["doc_id"] != 3}
    assert by[100] == by[101]
    assert np.mean([(by[i] >= 0.5) == bool(i % 2) for i in range(80) if i != 3]) > 0.95
    assert {r["score"] for r in toxicity.toxicity_scores(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity_scores(docs.limit(0), labels).collect() == []


def test_language_groups():
    assert [toxicity.language_group(t) for t in ("plain", "schön größer", "été à la forêt", "mañana está", "жук", "")] == [0, 1, 2, 3, 4, 0]


def test_pools_look_at_whole_texts_only():
    rng = np.random.default_rng(1)
    model = toxicity.fit(["bad thing " * 3, "good thing " * 3] * 20, np.array([1.0, 0.0] * 20))
    texts = ["good thing", "x " * 5000 + "bad thing", "good", "", "bad thing"]
    together = model.score(toxicity.Words(), texts)
    alone = np.array([model.score(toxicity.Words(), [t])[0] for t in texts])
    assert np.allclose(together, alone, atol=1e-5) and together[1] > 0.5 > together[0]
    assert rng is not None
