import hashlib

import pytest

import corpus_pipeline
from strandline.llm import bpe, pii
from strandline.llm._common import table
from strandline.llm.queries import vocabulary

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, SF), "test-" + name.replace(" ", "-"))
        out.append(docs)
    return out


def test_stages_take_effect(spark, steps):
    first = table(spark, SF, "documents")
    good, single, clean, mixed, encoded = steps
    assert all(d.columns == first.columns for d in steps[:-1])
    ids = [{r["doc_id"] for r in d.select("doc_id").collect()} for d in (first, good, single, clean, mixed)]
    assert ids[0] > ids[1] >= ids[2] == ids[3] == ids[4]
    texts = {r["doc_id"]: r["text"] for r in good.collect()}
    def shingles(text):
        w = text.encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = {i: shingles(t or "") for i, t in texts.items()}
    near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    kept = sorted(ids[2])
    assert not any(near(a, b) for k, a in enumerate(kept) for b in kept[:k])
    assert all(any(near(i, j) for j in sets if j != i) for i in ids[1] - ids[2])
    for r in clean.collect():
        assert not pii.base_spans(r["text"] or "") and r["n_chars"] == len(r["text"])
        if not pii.base_spans(texts[r["doc_id"]]):
            # nothing but identifiers in learnt contexts may change
            assert r["text"] == texts[r["doc_id"]] or "<id>" in r["text"]
    machine = bpe.automaton(str(vocabulary()))
    by = {r["doc_id"]: r["text"] for r in clean.collect()}
    for r in encoded.limit(30).collect():
        ids_of = machine.encode(by[r["doc_id"]])
        assert r["n_tokens"] == len(ids_of) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids_of)).encode()).hexdigest()
    assert encoded.count() == mixed.count() >= clean.count()


def test_run_is_the_stages_in_order(spark, steps):
    got = sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))
    assert got == sorted(map(tuple, steps[-1].collect()))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "near duplicates", "personal data", "source mixing", "byte pairs"]


def test_stages_take_nulls_repeated_rows_and_clashing_columns(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "mail a@b.cc now", "en", None, 15), (3, "mail a@b.cc now", "en", None, 15), (None, "w " * 30_000, "de", "b", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").selectExpr("*", "1 as key", "'x' as node", "2 as __k2")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and stage(spark, docs.limit(0), SF).collect() == [], name
    single = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in single.collect()) == [(False, 1), (False, 3), (True, 0)]
    assert {r["text"] for r in corpus_pipeline.redact_personal_data(spark, docs, SF).collect()} == {None, "", "mail <email> now", "w " * 30_000}
    assert corpus_pipeline.encode(spark, docs, SF).count() == 5
