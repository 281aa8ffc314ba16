import hashlib
import random
import unicodedata

import pyarrow.parquet as pq
import pytest

from strandline.llm import bpe
from strandline.llm.queries import vocabulary

PARTS = ["Hello", " ", "  ", "\n", "\t", "İ", "ß", "Σας", "ΣΑΣ", "é", "é", "日本", "12", "3,4", "don't", "DON'T", "we'll", "#$%", "🙂", "\x1c", "\x85", " ", "​", "a" * 300, "<|endoftext|>", "[UNK]", "ñandú", "_x_"]


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(str(vocabulary()))
    t.no_truncation()
    t.no_padding()
    return t


def expected(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def test_encodes_and_decodes_as_the_library_does(library):
    machine, rng = bpe.automaton(str(vocabulary())), random.Random(6)
    texts = ["", " ", *PARTS, *["".join(rng.choices(PARTS, k=rng.randint(1, 12))) for _ in range(3000)]]
    texts += list(machine.special) + [f"a{s}b {s}" for s in machine.special]
    # the library has other Unicode tables: newer ones for letters, older ones for the order of marks
    known = [chr(c) for c in [*range(32, 0x3000), *range(0x4E00, 0x4F00), *range(0x1F300, 0x1F700)] if unicodedata.category(chr(c)) != "Cn" and (c < 0x370 or not unicodedata.combining(chr(c)))]
    texts += ["".join(rng.choices(known, k=30)) for _ in range(3000)]
    for text in texts:
        ids, plain = expected(library, text)
        assert machine.encode(text) == ids, repr(text)
        assert machine.decode(ids) == plain, repr(text)


def test_whole_documents(spark, library):
    rows = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    rows = [(r["doc_id"], r["text"]) for r in rows] + [(9_001, None), (9_002, ""), (None, "null id"), (9_003, "twice"), (9_003, "twice")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as n_tokens", "'x' as ids")
    got = bpe.encode_documents(docs, str(vocabulary()), keep_ids=True).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        ids, plain = expected(library, texts[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids) and r["ids"] == ids and r["decoded"] == plain
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(plain.encode()).hexdigest()
    assert bpe.encode_documents(docs.limit(0), str(vocabulary())).collect() == []


def test_long_words_take_linear_time():
    machine = bpe.automaton(str(vocabulary()))
    assert len(machine.encode("ab" * 50_000)) > 0


def test_runs_of_a_batch_are_numbered_in_arrow(monkeypatch):
    """A Python object for each run of each text took much of the CPU seconds of training order; the ids are the same."""
    from strandline.llm import bpe, queries

    machine = bpe.automaton(str(queries.vocabulary()))
    texts = ["", " ", "  Lead it's", "trail \n", "a\x1cb c\x85d e f　g h", "ÉtÉ İ ΣΑΣ", "x" * 300, "b a b", "a" + next(iter(machine.special)) + " b"]
    apart = bpe.Encoder(machine)
    runs = [apart.runs(t) for t in texts]
    apart._learn([r for rs in runs for r in rs if not r.startswith(" ")])
    apart.seen.update(apart.own)
    want = [b"".join(apart.seen[r] for r in rs) for rs in runs]
    monkeypatch.setattr(bpe.Encoder, "_split", lambda *_: pytest.fail("runs as Python objects"))
    assert bpe.Encoder(machine).encode(texts[:-1]) == want[:-1]
    monkeypatch.undo()
    assert bpe.Encoder(machine).encode(texts) == want
