import random

import pytest
import xxhash
from pyspark.sql import functions as F

from strandline.llm import simhash


def brute_print(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """Least id that each id is connected with."""
    ids, label = list(prints), {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if (prints[a] ^ prints[b]).bit_count() <= 3 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def test_fingerprints():
    rng = random.Random(1)
    for text in ["", "  \n", "One", "a b", "A b C d", "é É x y z", *[" ".join(rng.choices("aa B c Dd é x y".split(" "), k=rng.randint(1, 40))) for _ in range(200)]]:
        assert simhash.fingerprint(text) == brute_print(text), text


def prints_table(spark, prints):
    signed = [((x - (1 << 64) if x >= 1 << 63 else x),) for x in prints]
    return spark.createDataFrame(signed, "fp bigint")


@pytest.mark.parametrize("cell", [4096, 8])
def test_every_link_is_connected(spark, monkeypatch, cell):
    """Random families of near prints; with small cells, chunks of one cell must meet all others."""
    monkeypatch.setattr(simhash, "CELL", cell)
    rng = random.Random(cell)
    prints = set()
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            prints.add(x)
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
    prints |= {0, 1, 3, 7, 15, (1 << 64) - 1, 1 << 63, 3 << 62}
    prints = sorted(prints)
    edges = simhash.links(prints_table(spark, prints))
    got = {}
    for r in simhash.components(edges).collect():
        got[r["node"] % (1 << 64)] = r["root"]
    want = brute_components({p: p for p in prints})
    groups = lambda of: sorted(map(sorted, {tuple(p for p in prints if of.get(p, p) == of.get(q, q)) for q in prints}))
    assert groups(got) == groups(want)


def test_tables_that_grow_do_not_pass_the_driver(spark):
    """Spark's sizes are of files, and leave out that a print makes some 34 rows: at 0.6 GB of documents it broadcast those."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    cells = plan(simhash.links(simhash.materialise(prints_table(spark, range(1, 50)), "prints")))
    assert "SortMergeJoin" in cells and "Broadcast" not in cells
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(9)], "doc_id bigint, text string")
    assert "BuildLeft" not in plan(simhash.near_duplicates(docs))


def test_documents(spark):
    base = " ".join(f"word{i}" for i in range(400))
    near = base.replace("word200 ", "other ")
    rows = [(5, base), (3, near), (9, base), (4, ""), (8, None), (7, "quite another text of its own"), (2, "x"), (2, "x"), (None, base)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as fp", "'x' as h", "2 as component_id")
    texts = dict(rows)
    want = brute_components({i: brute_print(t or "") for i, t in texts.items() if i is not None})
    out = simhash.near_duplicates(docs).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r["fingerprint"] == f"{brute_print(texts[r['doc_id']] or ''):016x}"
        if r["doc_id"] is not None:
            assert r["component_id"] == want[r["doc_id"]]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))
    assert simhash.near_duplicates(docs.limit(0)).collect() == [] and simhash.keep_one(docs.limit(0)).collect() == []
    assert docs.where(F.lit(True)).count() == len(rows)


def five_word_similarity(a, b):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.encode().lower().split(), b.encode().lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_keep_one_joins_similar_texts_whose_prints_differ(spark):
    rng = random.Random(8)
    rows, texts = [], []
    for k in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(60, 200))]
        for edits in (0, 1, 2, 4):
            some = list(words)
            for at in rng.sample(range(len(some)), edits):
                some[at] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(some))
    rows = [(i, t) for i, t in enumerate(texts)]
    label = list(range(len(texts)))
    far = 0
    for a in range(len(texts)):
        for b in range(a // 4 * 4, a):
            if five_word_similarity(texts[a], texts[b]) >= 0.8:
                far += (simhash.fingerprint(texts[a]) ^ simhash.fingerprint(texts[b])).bit_count() > 3
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    assert far > 20
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(label))
    assert len(set(label)) > 41


def test_keep_one_searches_the_grid_of_fingerprints(spark):
    """Texts whose fingerprints link and whose sets are similar are joined though they share no band; others that link are not."""
    rng = random.Random(3)

    def edited(n, at):
        words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        some = [f"x{rng.randrange(10**6)}" if i in at else w for i, w in enumerate(words)]
        return " ".join(words), " ".join(some)

    def linking(n, at):
        while True:
            a, b = edited(n, at)
            if 0 < (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() <= 3:
                return a, b

    near, far = linking(400, {200}), linking(80, {20, 60})
    assert five_word_similarity(*near) >= 0.8 > five_word_similarity(*far)
    again = "a b c d e f a b c d e f a b c d e f"  # as many distinct shingles in a longer text
    texts = [*near, *far, again, again + " a b c d e f", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    nodes = simhash._nodes(docs).withColumn("bands", F.array("node"))
    node = {r["doc_id"]: r["node"] for r in nodes.collect()}
    found = {frozenset((r["a"], r["b"])) for r in simhash.near_links(docs, nodes).collect()}
    assert found == {frozenset((node[0], node[1])), frozenset((node[4], node[5]))}
