import hashlib
import random

from pyspark.sql import functions as F

from strandline.llm import minhash


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as h", "'x' as codes", "2 as own", "'z' as fingerprint")


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def test_edited_texts_and_neighbours(spark):
    rng = random.Random(1)
    texts = {i: " ".join(rng.choice(["joki", "jää", "é", "vesi\n", "x"]) + str(rng.randint(0, 99)) for _ in range(rng.randint(0, 60))) for i in range(30)}
    texts |= {30: "", 31: "abc", 40: texts[3], 41: None}
    out = {r["doc_id"]: r for r in minhash.edited_fingerprints(table(spark, list(texts.items()))).collect()}
    order = sorted(texts, reverse=True)
    assert len(out) == len(texts)
    for i, after in zip(order, order[1:] + order[:1]):
        own, nxt = texts[i] or "", texts[after] or ""
        m = len(own) // 3
        edited = own[: len(own) - m] + nxt[:m]
        assert out[i]["n_chars"] == len(own) and out[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert len(out[i]["fingerprint"]) == 2 * minhash.BINS
        if edited == own:
            assert out[i]["near_edited"] == 1.0 and out[i]["fingerprint"] == out[i]["edited_fingerprint"]
    assert out[3]["fingerprint"] == out[40]["fingerprint"] and out[30]["fingerprint"] == out[41]["fingerprint"]


def test_likeness_estimates_jaccard(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for i in range(60):
        a = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.choice([30, 300, 3000]))]
        cut = int(len(a) * rng.random())
        b = a[:cut] + [f"v{rng.randint(0, 10**6)}" for _ in range(len(a) - cut)]
        x, y = " ".join(a), " ".join(b)
        want[i] = len(shingles(x) & shingles(y)) / len(shingles(x) | shingles(y))
        rows.append((i, x, y))
    df = spark.createDataFrame(rows, "i int, x string, y string")
    got = df.select("i", minhash.likeness(minhash.packed(F.col("x")), minhash.packed(F.col("y"))).alias("l")).collect()
    errors = [r["l"] - want[r["i"]] for r in got]
    assert max(map(abs, errors)) < 0.2 and abs(sum(errors) / len(errors)) < 0.02


def test_one_row_none_and_null_ids(spark):
    assert minhash.edited_fingerprints(table(spark, []).limit(0)).collect() == []
    one = minhash.edited_fingerprints(table(spark, [(7, "a b c")])).collect()[0]
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"a b a").hexdigest()
    rows = [(None, "a"), (None, None), (1, "b"), (1, "b"), (1, "c")]
    assert minhash.edited_fingerprints(table(spark, rows)).count() == 5
