import math
import random
from collections import Counter

import pytest

from strandline.llm import mixing


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    rows, k = [], 0
    for source, n in (("big", 900), ("mid", 150), ("small", 30), (None, 10), ("none", 2)):
        for _ in range(n):
            rows.append((k, " ".join(["w"] * rng.randint(1, 40)) if source != "none" else rng.choice(["", None]), source))
            k += 1
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "1 as block", "'x' as src", "3 as n_tokens").cache()


def tokens(rows):
    out = Counter()
    for r in rows:
        out[r["source"]] += len((r["text"] or "").split())
    return out


def test_budgets_are_met_and_nothing_is_lost(docs):
    rows = docs.collect()
    have, biggest = tokens(rows), max(len((r["text"] or "").split()) for r in rows)
    plan = mixing.plan(docs, max_repeats=2.0, block_tokens=500).collect()
    assert len(plan) == len(rows) and min(r["copies"] for r in plan) >= 1
    weight = {r["source"]: r["weight"] for r in plan}
    assert sum(weight.values()) == pytest.approx(1.0)
    total = max(have[s] / w for s, w in weight.items() if w > 0)
    got = Counter()
    for r in plan:
        got[r["source"]] += r["n_tokens"] * r["copies"]
    for s, w in weight.items():
        assert w * total - 1 <= got[s] <= w * total + biggest + 1, s
    rare = min((s for s in have if have[s]), key=lambda s: have[s])
    assert got[rare] / have[rare] == pytest.approx(2.0, abs=0.1)


def test_exponent_meets_entropy_or_repetition(spark, docs):
    plan = mixing.plan(docs, target_entropy=1.0, max_repeats=None, block_tokens=500)
    w = [r["weight"] for r in plan.select("source", "weight").distinct().collect() if r["weight"] > 0]
    assert -sum(x * math.log(x) for x in w) == pytest.approx(1.0, abs=1e-3)
    limited = mixing.plan(docs, target_entropy=1.3, max_repeats=1.5, block_tokens=500).select("repeats").distinct().collect()
    assert max(r["repeats"] for r in limited) <= 1.5 + 1e-6
    w = {r["source"]: r["weight"] for r in mixing.plan(docs, None, None).collect()}
    have = tokens(docs.collect())
    assert w["big"] == pytest.approx(have["big"] / sum(have.values()))


def test_exponent_as_a_plain_bisection_finds_it(spark, docs):
    have = {s: n for s, n in tokens(docs.collect()).items() if n}
    p = [n / sum(have.values()) for n in have.values()]

    def weights(a):
        z = sum(x**a for x in p)
        return [x**a / z for x in p]

    entropy = lambda a: -sum(w * math.log(w) for w in weights(a))
    target = entropy(1) + 0.5 * (math.log(len(p)) - entropy(1))
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if entropy(mid) >= target else (low, mid)
    want = dict(zip(have, weights(low)))
    got = {r["source"]: r["weight"] for r in mixing.plan(docs, evenness=0.5, max_repeats=None, block_tokens=500).collect()}
    assert 0.05 < low < 0.95 and all(got[s] == pytest.approx(w, abs=1e-6) for s, w in want.items())
    # the repetition limit: the rarest source is repeated 3 times at the least exponent that keeps it
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if (max(p) / min(p)) ** (1 - mid) <= 3 else (mid, high)
    got = {r["source"]: r["weight"] for r in mixing.plan(docs, evenness=1.0, max_repeats=3.0, block_tokens=500).collect()}
    assert 0 < high < 1 and all(got[s] == pytest.approx(w, abs=1e-6) for s, w in zip(have, weights(high)))


def test_sources_have_many_blocks_and_repeated_rows_go_together(spark, docs):
    blocks = {}
    for r in mixing.plan(docs, evenness=0.5).collect():
        blocks.setdefault(r["source"], set()).add((r["block"], r["block_order"]))
    assert len(blocks["big"]) == mixing.LEAST_BLOCKS and len({o for _, o in blocks["big"]}) == mixing.LEAST_BLOCKS
    twice = docs.where("doc_id < 20").unionAll(docs.where("doc_id < 20"))
    assert all(len({x["copies"] for x in g}) == 1 for g in [[r for r in mixing.plan(twice).collect() if r["doc_id"] == i] for i in range(20)])


def test_mix_repeats_rows(docs):
    plan = {r["doc_id"]: r["copies"] for r in mixing.plan(docs, max_repeats=1.5, block_tokens=500).collect()}
    got = mixing.mix(docs, max_repeats=1.5, block_tokens=500)
    assert got.columns == docs.columns
    assert Counter(r["doc_id"] for r in got.collect()) == Counter(plan)


def test_given_budget_drops_and_empty_tables(docs):
    got = mixing.plan(docs, max_repeats=None, budget=2000, block_tokens=200).collect()
    kept = sum(r["n_tokens"] * r["copies"] for r in got)
    assert 2000 - 5 <= kept <= 2000 + 5 * 40
    assert mixing.mix(docs.limit(0)).collect() == [] and mixing.plan(docs.limit(0)).collect() == []
    same = docs.where("source = 'none'")
    assert {r["copies"] for r in mixing.plan(same).collect()} == {1}
