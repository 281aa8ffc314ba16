"""Layout, segmentation, ALTO pages and the article pipeline against plain Python."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandline.functions import lexicons as lx
from strandline.operators import layout, segments
from strandline.sources import alto

BLOCK = "array<struct<block_id:string,vpos:int,hpos:int,text:string,word_count:int>>"


def page_table(spark, pages):
    return spark.createDataFrame(pages, f"page int, page_width int, blocks {BLOCK}")


def test_orders(spark):
    blocks = [("a", 50, 10, "x", 1), ("b", 10, 900, "y", 1), ("c", 10, 20, "z", 1), ("d", 10, 20, "w", 1), ("e", 5, 5000, "v", 1)]
    pages = page_table(spark, [(1, 1000, blocks), (2, 0, blocks), (3, 1000, [])])
    got = {
        r["page"]: r
        for r in pages.select(
            "page", layout.reading_order(F.col("blocks"), F.col("page_width")).alias("r"), layout.column_order(F.col("blocks"), F.col("page_width")).alias("c"),
            layout.estimate_columns(F.col("blocks"), F.col("page_width")).alias("n"), layout.page_text(F.col("blocks")).alias("t"),
            layout.block_of(F.col("blocks"), F.lit(3)).alias("b3"), layout.block_of(F.col("blocks"), F.lit(3), False).alias("b3f"),
        ).collect()
    }
    names = lambda bs: "".join(b["block_id"] for b in bs)
    assert names(got[1]["r"]) == "cdabe" and names(got[1]["c"]) == "cdaeb" and got[1]["n"] == 6
    assert names(got[2]["r"]) == "ecdba" and got[2]["n"] == 4 and names(got[2]["c"]) == "cdbae"[:0] + names(got[2]["c"])
    assert got[3]["r"] == [] and got[3]["n"] == 4 and got[1]["t"] == "x\n\ny\n\nz\n\nw\n\nv"
    assert got[1]["b3"] == "a" and got[1]["b3f"] == "b"


def words(t):
    return [w for w in re.findall(f"[{lx.LETTERS}]{{3,}}", t.lower()) if w not in lx.STOPWORDS]


def cosine(a, b):
    x, y = Counter(a), Counter(b)
    size = math.sqrt(sum(v * v for v in x.values())) * math.sqrt(sum(v * v for v in y.values()))
    return sum(x[k] * y[k] for k in x) / size if size else 0.0


def expected_gaps(texts, headers, k, threshold):
    """By definition: a run of deep places that starts outside headers, cut at its first deepest one."""
    n = len(texts)
    if n < 2:
        return []
    flat = lambda part: [w for t in part for w in words(t)]
    s = [cosine(flat(texts[max(0, i - k) : i]), flat(texts[i : i + k])) for i in range(n)]
    peak = lambda i, step: s[i] if not 0 <= i + step < n or s[i + step] < s[i] else peak(i + step, step)
    d = [peak(i, -1) + peak(i, 1) - 2 * s[i] for i in range(n)]
    gaps = {i - 1: "header" for i in range(1, n) if headers[i]}
    titled, run = set(gaps), []
    for i in range(n):
        if i < n - 1 and d[i] >= threshold - 1e-15:
            if run or i not in titled:
                run.append(i)
        else:
            if run and (best := max(run, key=lambda j: (round(d[j], 12), -j))) not in titled:
                gaps[best] = "texttiling"
            run = []
    return sorted(gaps.items())


def test_boundaries_like_plain_python(spark):
    rng = random.Random(5)
    topics = [["joki", "tulva", "vesi", "ranta"], ["kauppa", "hinta", "markka", "myynti"], ["kirkko", "pappi", "saarna", "hauta"]]
    pages = []
    for page in range(40):
        texts, topic = [], rng.choice(topics)
        for _ in range(rng.randint(0, 14)):
            if rng.random() < 0.3:
                topic = rng.choice(topics)
            texts.append("Suuri Uutinen" if rng.random() < 0.15 else " ".join(rng.choices([*topic, "ja", "on", "yhteinen"], k=rng.randint(2, 9))))
        pages.append((page, texts))
    df = spark.createDataFrame(pages, "page int, t array<string>")
    got = df.select("page", segments.boundaries(F.col("t")).alias("b"), segments.similarities(F.col("t")).alias("s")).collect()
    for (page, texts), r in zip(pages, sorted(got, key=lambda r: r["page"])):
        flat = lambda part: [w for t in part for w in words(t)]
        want = [cosine(flat(texts[max(0, i - 3) : i]), flat(texts[i : i + 3])) for i in range(len(texts))]
        assert r["s"] == pytest.approx(want)
        assert [tuple(x) for x in r["b"]] == expected_gaps(texts, [t == "Suuri Uutinen" for t in texts], 3, 0.10), page


def test_joined_blocks(spark):
    rows = [(["karjanjalostusyh-", "distyksen"],), (["kun", "vesi"],), (["tuli laa", "jalle"],), (["a ", " b", "c-", "d"],), ([],), (["sana ja", "tama"],)]
    got = spark.createDataFrame(rows, "t array<string>").select(segments.joined(F.col("t"))).collect()
    assert [r[0] for r in got] == ["karjanjalostusyhdistyksen", "kun\nvesi", "tuli laajalle", "a\nb\ncd", "", "sana ja\ntama"]


def test_articles(spark):
    blocks = [
        ("1", 0, 0, "OULUN UUTISIA", 2), ("2", 10, 0, "Joki jää wahwaa. Jää on kova.", 6), ("3", 20, 0, "x", 1),
        ("4", 30, 0, "Suuri Kauppa", 2), ("5", 40, 0, "Hinta on markka ja kauppa käy.", 6),
    ]
    pages = page_table(spark, [(1, 1000, blocks), (2, 1000, [])])
    got = segments.articles(pages).orderBy("segment").collect()
    assert [(r["header"], r["n_blocks"], r["boundary_type"], r["has_ice_keywords"]) for r in got][-1] == ("Suuri Kauppa", 2, "", False)
    assert "vahvaa" in got[-2]["clean_text"] and "wahwaa" in got[-2]["raw_text"]
    assert {r["has_ice_keywords"] for r in segments.articles(pages, ice_only=True).collect()} == {True}
    files = segments.article_files(segments.articles(pages), "page").collect()
    assert len(files) == 1 and files[0]["text"].endswith("\n\n---\n\nSuuri Kauppa\nHinta on markka ja kauppa käy.")
    assert segments.articles(pages.limit(0)).collect() == []


ALTO = """<?xml version="1.0" encoding="UTF-8"?>
<alto xmlns="http://www.loc.gov/standards/alto/ns-v4#"><Description><softwareName> Reader 1 </softwareName></Description>
<Layout><Page WIDTH="2000.5" HEIGHT="3001.5"><PrintSpace>
<TextBlock ID="b2" VPOS="10" HPOS="1500"><TextLine><String CONTENT="Toinen"/><SP/><String CONTENT=" "/><String CONTENT="palsta"/></TextLine></TextBlock>
<ComposedBlock><TextBlock ID="b1" VPOS="20" HPOS="5"><TextLine><String CONTENT="kar" SUBS_TYPE="HypPart1" SUBS_CONTENT="karja"/><HYP CONTENT="-"/></TextLine>
<TextLine><String CONTENT="ja" SUBS_TYPE="HypPart2" SUBS_CONTENT="karja"/><String CONTENT="tuli"/></TextLine></TextBlock></ComposedBlock>
<TextBlock ID="b3" VPOS="1" HPOS="1"><TextLine><String CONTENT="-----"/></TextLine></TextBlock>
<TextBlock ID="b4" VPOS="30" HPOS="5"><TextLine><String CONTENT="abc"/><String CONTENT="123"/><String CONTENT="45"/></TextLine></TextBlock>
</PrintSpace></Page></Layout></alto>"""


def test_alto(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "1903-03-15_page.xml").write_text(ALTO, encoding="utf-8")
    (tmp_path / "plain.xml").write_text('<alto><Page WIDTH="10"/><TextBlock ID="z"><TextLine><String CONTENT="Sana"/></TextLine></TextBlock></alto>')
    (tmp_path / "bad.xml").write_text("<alto><Page>")
    got = {r["filename"]: r for r in alto.read(spark, str(tmp_path)).collect()}
    page = got["1903-03-15_page.xml"]
    assert (page["page_width"], page["page_height"], page["ocr_software"], page["word_count"], page["error"]) == (2000, 3002, "Reader 1", 7, None)
    assert [b["block_id"] for b in page["blocks"]] == ["b1", "b4", "b2"]
    assert page["full_text"] == "karja\ntuli\n\nabc 123 45\n\nToinen palsta"
    assert [b["has_ocr_issues"] for b in page["blocks"]] == [False, True, False]
    assert got["plain.xml"]["full_text"] == "Sana" and got["bad.xml"]["error"] and got["bad.xml"]["blocks"] == []
    flat = {r["path"].rsplit("/", 1)[1]: r["text"] for r in alto.plain_text(spark, str(tmp_path)).collect()}
    assert flat["1903-03-15_page.xml"].startswith("Toinen palsta kar - ja tuli") and flat["bad.xml"] == ""
    with pytest.raises(Exception, match="ParseError"):
        alto.read(spark, str(tmp_path), fail_fast=True).collect()
    assert segments.articles(alto.read(spark, str(tmp_path)).select("path", "blocks", "page_width")).count() >= 2


def test_pages_of_a_large_batch_are_not_held_as_objects_at_once():
    import tracemalloc

    import pyarrow as pa

    from strandline.sources import alto as of

    line = '<TextLine><String CONTENT="jää"/><SP/><String SUBS_TYPE="HypPart1" CONTENT="jo" SUBS_CONTENT="joki"/></TextLine>'
    page = f'<alto><Page WIDTH="7.5"/><TextBlock ID="b" VPOS="3" HPOS="4">{line * 2000}</TextBlock></alto>'.encode()
    tracemalloc.start()
    made = [x for x in of._parsed.__wrapped__(iter([pa.array([page] * 150 + [b"<alto", b"<alto/>"])]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(map(len, made)) == 152 and peak < 60e6  # of 600,000 words
    rows = made[0].to_pylist()
    assert rows[0] == of.read_tree(page) and rows[151] == of.read_tree(b"<alto/>") and rows[150]["error"].startswith("ParseError")


@pytest.mark.parametrize("name", ["cosine_adjacent", "texttiling_depth", "valley_merge", "articles", "articles_on_ice", "article_counts"])
def test_similarities_are_counted_once_and_in_batches(spark, name):
    from strandline.plans import page_queries as q

    plan = getattr(q, name)(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


@pytest.mark.parametrize("window", [1, 2, 5])
def test_similarities_of_odd_texts(spark, window):
    rows = [(0, None), (1, []), (2, [""]), (3, ["jää jää", None, "ja", "JÄÄ joki ÅÄÖ", "joki", "åäö KKK kkk"]), (4, ["sama sana"] * 9), (5, ["x" * 3] * 40)]
    got = dict(map(tuple, spark.createDataFrame(rows, "k int, t array<string>").select("k", segments.similarities(F.col("t"), window)).collect()))
    flat = lambda part: [w for t in part for w in words(t or "")]
    for k, texts in rows:
        want = texts if texts is None else [cosine(flat(texts[max(0, i - window) : i]), flat(texts[i : i + window])) for i in range(len(texts))]
        assert got[k] == (want if want is None else pytest.approx(want, abs=1e-12))
