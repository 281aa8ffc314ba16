"""Catalogues, HTTP sources with a transport from memory, downloads, files and streams."""

import pathlib

from pyspark.sql import functions as F

from strandline.operators import catalog, reports
from strandline.sources import files, sinks, web
from strandline.streaming import incremental


def search(spark, **options):
    web.register(spark)
    r = spark.read.format("issue_search").option("url", "http://x/search").option("transport", "tests.transports:search").option("pause", "0")
    for k, v in options.items():
        r = r.option(k, v)
    return r.load()


def test_search_follows_the_cursor(spark, monkeypatch, tmp_path):
    monkeypatch.syspath_prepend(str(pathlib.Path(__file__).parent.parent))
    whole = search(spark, startDate="1900-01-01", endDate="1902-12-31").collect()
    assert len(whole) == 9 and {r["altoXmlTemplate"] for r in whole} == {"/p-{{page}}.xml"} and {r["pageImageTemplate"] for r in whole} == {"/image/{{page}}"}
    assert {r["pageCount"] for r in whole if int(r["bindingId"]) % 2} == {4} and {r["pageCount"] for r in whole if int(r["bindingId"]) % 2 == 0} == {1}
    assert whole[0]["textHighlights"] == "a ### b" and whole[0]["terms"] == ["jää"]
    split = search(spark, startDate="1900-01-01", endDate="1902-12-31", splits="3")
    assert sorted(map(str, split.collect())) == sorted(map(str, whole))
    assert len(search(spark, startDate="1900-01-01", endDate="1902-12-31", maxResults="4", splits="3").collect()) == 4
    rows = catalog.manifest(split, "jää")
    assert rows.columns == list(catalog.MANIFEST_FIELDS)
    sinks.manifest(rows, str(tmp_path / "manifest"))
    back = files.manifest(spark, str(tmp_path / "manifest"))
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
    assert reports.top_titles(back, "bindingTitle").collect()[0]["n"] == 9


def test_titles_and_probes(spark, monkeypatch):
    monkeypatch.syspath_prepend(str(pathlib.Path(__file__).parent.parent))
    web.register(spark)
    body = spark.read.format("title_list").option("url", "http://x/t").option("language", "sv").option("transport", "tests.transports:titles").load()
    rows = files.title_rows(spark, body)
    got = {r["issn"]: (r["available_from"], r["available_to"]) for r in catalog.titles_overlapping(rows, 1840, 1900).collect()}
    assert got == {"1": (1840, 1850), "2": (1880, 1900)}
    lists = spark.createDataFrame([('[{"issn": "9"}]',), ('{"titles": [{"issn": "8"}], "results": []}',), ('{"data": [{"issn": "7"}]}',)], "body string")
    assert sorted(r["issn"] for r in files.title_rows(spark, lists).collect()) == ["7", "8", "9"]
    titles = spark.createDataFrame([("1",), ("2",), ("3",)], "issn string")
    found = web.sample_bindings(titles, "http://x/s", 1900, "tests.transports:samples").collect()
    assert [tuple(r) for r in found] == [("1", 77)]
    asked = spark.createDataFrame([(77, "http://x/77/mets", "http://x/77/page-00001.xml"), (78, "http://x/bad", "http://x/bad.xml")], "sample_binding bigint, m string, sample_alto_url string")
    access = web.bodies(asked, {"mets": "m", "alto": "sample_alto_url"}, "tests.transports:pages").select("sample_binding", "mets", "alto", "sample_alto_url")
    names = spark.createDataFrame([("1", "A", 1840, 1850), ("2", None, 1880, 1900)], "issn string, title string, available_from int, available_to int").withColumn("language", F.lit("fi"))
    cover = catalog.coverage(names, spark.createDataFrame(found, "issn string, sample_binding bigint"), access).orderBy("issn")
    assert [(r["title"], r["binding_found"], r["alto_accessible"], r["mets_accessible"], r["est_pages"]) for r in cover.collect()] == [("A", True, True, True, 2), ("Unknown", False, False, False, None)]
    assert reports.coverage_counters(cover).collect()[0][:] == (2, 1, 1, 1)


def test_downloads_are_whole_and_are_not_repeated(spark, monkeypatch, tmp_path):
    monkeypatch.syspath_prepend(str(pathlib.Path(__file__).parent.parent))
    plan = spark.createDataFrame([("1", "i/1900/1_page-00001.xml", "http://x/1.xml"), ("2", "i/1900/2.xml", "http://x/bad.xml")], "bindingId string, path string, url string")
    status = web.download(plan, f"file://{tmp_path}/d", "tests.transports:pages", pause=0).cache()
    assert {r["bindingId"]: r["success"] for r in status.collect()} == {"1": True, "2": False}
    assert reports.download_tally(status).collect()[0][:] == (1, 1)
    assert [p.name for p in (tmp_path / "d").rglob("*") if p.is_file()] == ["1_page-00001.xml"]
    there = files.texts(spark, str(tmp_path / "d"), pattern="*.xml").select(F.substring_index("path", "/d/", -1).alias("path"))
    assert [r["bindingId"] for r in catalog.pending(plan, there).collect()] == ["2"]


def test_page_numbers_and_urls(spark):
    rows = spark.createDataFrame([(7,), (123456,)], "n int")
    got = rows.select(catalog.page_url(F.lit("b"), F.lit("/p-{{page}}.xml"), F.col("n"))).collect()
    assert [r[0] for r in got] == ["b/p-00007.xml", "b/p-123456.xml"]
    url = spark.range(1).select(catalog.search_url(F.lit("1820-01-01"), F.lit("1939-12-31"), F.lit("jää joki*~"), F.lit("all"))).collect()[0][0]
    assert url == "?startDate=1820-01-01&endDate=1939-12-31&formats=NEWSPAPER&requireOnline=true&query=j%C3%A4%C3%A4+joki%2A~"


def test_texts_drop_bad_bytes(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes("jää\xff".encode("latin-1"))
    (tmp_path / "sub" / "b.txt").write_text("kaksi", encoding="utf-8")
    assert {r["filename"]: r["text"] for r in files.texts(spark, str(tmp_path)).collect()} == {"a.txt": "j", "b.txt": "kaksi"}
    assert [r["filename"] for r in files.texts(spark, str(tmp_path), recursive=False).collect()] == ["a.txt"]


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    page = '<alto><Page WIDTH="10"/><TextBlock ID="z"><TextLine><String CONTENT="{}"/></TextLine></TextBlock></alto>'
    (tmp_path / "in").mkdir()
    for k in (1, 2):
        (tmp_path / "in" / f"{k}.xml").write_text(page.format(f"Sana{k}"))
        pages = incremental.arriving_pages(spark, str(tmp_path / "in")).select("filename", "full_text")
        incremental.run_once(pages, str(tmp_path / "out"), str(tmp_path / "state"))
        assert spark.read.parquet(str(tmp_path / "out")).count() == k


def test_streamed_categories(spark, tmp_path):
    rows = [("1900-05-01 00:00:00", "Joki jäätyi. Jäätyi taas. Ei."), ("1903-05-01 00:00:00", "Tulva.")]
    df = spark.createDataFrame(rows, "ts string, text string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = incremental.matches_by_category(stream, "ts").select("category", "n")
    incremental.run_once(out, str(tmp_path / "out"), str(tmp_path / "state"))
    assert [tuple(r) for r in spark.read.schema("category string, n bigint").parquet(str(tmp_path / "out")).collect()] == [("freeze", 2)]
