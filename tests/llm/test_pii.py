import hashlib
import random
import re

from strandline.llm import pii

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def brute(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            digits = re.sub(r"\D", "", m[0])
            ok = [
                True,
                k == 1 and all(int(x) <= 255 for x in m[0].split(".")),
                12 <= len(digits) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0,
                9 <= len(digits) <= 15,
            ][k]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_as_the_patterns_say():
    rng = random.Random(3)
    for _ in range(20_000):
        text = "".join(rng.choice("a1.@@+- 2(0)9.%é:=\"") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == brute(text), text
    assert pii.base_spans("4111 1111-1111 1111 é x.y@z.org") == [(0, 2, 19), (22, 0, 31)]
    assert pii.base_spans("1" * 200_000 + "@" * 100_000 + "+" * 100_000) == []


def test_patterns_with_many_seeds_find_unknown_identifiers(spark):
    rows = [(i, f"word contact: u{i}@mail.example.org end") for i in range(40)]
    rows += [(100, "word contact: zz-98765-q end"), (101, "word other: zz-98765-r end"), (102, None), (103, ""), (None, "a@b.cc")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' as spans", "1L as key", "text as n")
    out = {r["doc_id"]: r for r in pii.personal_data(docs).collect()}
    assert len(out) == 45
    assert out[100]["spans"] == "id:14:24" and out[100]["n_added"] == 1 and out[100]["n_email"] == 0
    assert out[101]["spans"] == "" and out[102]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert out[7]["base_sha256"] == hashlib.sha256(b"email:14:33").hexdigest() and out[None]["n_email"] == 1


def test_words_on_both_sides_and_confident_instances_lead_to_others(spark):
    rows = [(i, f"write to u{i}@mail.example.org today") for i in range(80)]
    rows += [(100, "write to zz-98765-q today"), (101, "see zz-98765-r there")]
    # five values known only by a pattern without a sign are the support of a pattern that has no base seed
    rows += [(200 + i, f"write to kk-{i}2345 today") for i in range(4)] + [(210 + i, f"member kk-{i}2345 left") for i in range(4)]
    rows += [(220, "write to kk-92345 today"), (221, "member kk-92345 left"), (300, "member qq-55555 gone")]
    # a pattern with too few known instances
    rows += [(400 + i, f"item w{i}@mail.example.org sold") for i in range(6)] + [(410 + i, f"item nr-{i}7777 sold") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = {r["doc_id"]: r for r in pii.personal_data(docs).collect()}
    assert out[100]["spans"] == "id:9:19" and out[101]["n_added"] == 0
    assert all(out[i]["n_added"] == 1 for i in [*range(200, 204), 220, *range(210, 214), 221])
    assert all(out[i]["n_added"] == 0 for i in [*range(400, 406), *range(410, 414)])
    # five of its six values are known: 0.83
    assert out[300]["n_added"] == 0


def test_keys_in_a_learnt_context_lead_to_others_there(spark):
    key = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    rows = [(i, f'some words token = "{key(i)}" more') for i in range(60)] + [(100, 'x token = "short-77" y'), (101, f"sum {key(101)} alone")]
    rows += [(102, "a" * 70_000 + " 12345 " + "=" * 70_000 + " b2345"), (103, 'token = "' + "9" * 5000 + 'z" end')]
    out = {r["doc_id"]: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert out[3]["spans"] == "id:20:60" and out[100]["spans"] == "id:11:19" and out[101]["n_added"] == 0
    assert out[103]["spans"] == "id:9:5010" and out[102]["n_added"] == 0


def test_confident_patterns_as_plain_python_finds_them(spark):
    rng = random.Random(12)
    edges = {(f"p{rng.randrange(60)}", f"v{min(rng.randrange(300), rng.randrange(300))}") for _ in range(1500)}
    seeds = {f"v{i}" for i in range(0, 300) if rng.random() < 0.6}
    known, sure = set(seeds), set()
    while True:
        now = {p for p in {p for p, _ in edges} if (vs := {v for q, v in edges if q == p}) and len(vs & known) >= 5 and len(vs & known) / len(vs) >= 0.7}
        known |= {v for p, v in edges if p in now}
        if now == sure:
            break
        sure = now
    rows = [(p, v, v in seeds) for p, v in edges]
    got = pii.confident_patterns(spark.createDataFrame(rows + rows[:50], "pattern string, value string, seed boolean"), 5, 0.7)
    assert {r["pattern"] for r in got.collect()} == sure and 0 < len(sure)
    first = {p for p in {p for p, _ in edges} if (vs := {v for q, v in edges if q == p}) and len(vs & seeds) / len(vs) >= 0.7}
    assert first != sure


def test_redact_keeps_columns_and_an_empty_table(spark):
    docs = spark.createDataFrame([(1, "mail a@b.cc now", 15), (2, None, None)], "doc_id bigint, text string, n_chars bigint").selectExpr("*")
    assert {tuple(r) for r in pii.redact(docs).collect()} == {(1, "mail <email> now", 16), (2, None, None)}
    assert pii.redact(docs.limit(0)).collect() == [] and pii.personal_data(docs.limit(0)).collect() == []
