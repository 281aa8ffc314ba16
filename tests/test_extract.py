"""Sentence matches, events, corrections and the analysis."""

import datetime

import pytest
from pyspark.sql import functions as F

from strandline.functions import text as tx
from strandline.operators import extract, ocr
from strandline.sources import files, sinks

ROWS = [
    (1, "1903-03-15_page-001.txt", "Oulujoki jäätyi tänään 15. marraskuuta. Jäässä oli myös Kemijoki ja kemijoen suu, vuonna 1899. Muuta ei."),
    (2, "1902_page-003.txt", "Tulva uhkaa. Ei mitään."),
    (3, "1910-07-01_page-001.txt", "Ei jokia."),
    (4, "x.txt", None),
    (5, "x.txt", ""),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "doc_id int, filename string, text string").cache()


def test_sentence_matches(rows):
    got = sorted(extract.sentence_matches(rows, "filename").collect(), key=lambda r: (r["doc_id"], r["sentence_index"]))
    assert [(r["doc_id"], r["sentence_index"], r["ice_categories"], r["rivers"], r["year"], r["publishing_date"]) for r in got] == [
        (1, 0, ["freeze"], ["Oulujoki"], 1903, "1903-03-15"),
        (1, 2, ["freeze"], ["Kemijoki", "Kemijoki"], 1899, "1903-03-15"),
        (2, 0, ["flood"], ["unknown"], None, None),
    ]
    assert got[0]["sentence"] == "Oulujoki jäätyi tänään 15."


def test_results_roll_up_and_go_through_files(spark, rows, tmp_path):
    matches = extract.sentence_matches(rows, "filename")
    results = extract.file_results(rows, matches)
    one = {r["doc_id"]: r for r in results.collect()}
    assert set(one) == {1, 2}
    assert one[1]["categories_found"] == {"freeze": 2} and one[1]["rivers_found"] == {"Oulujoki": 1, "Kemijoki": 2} and one[1]["sentences_total"] == 4
    assert one[1]["sentences_matched"] == 2 and [m["sentence_index"] for m in one[1]["matches"]] == [0, 2]
    s = extract.run_summary(rows, matches).collect()[0]
    assert (s["files_scanned"], s["files_with_matches"], s["files_skipped"], s["match_rate_pct"]) == (5, 2, 3, 40.0)
    assert (s["sentences_scanned"], s["sentences_matched"]) == (6, 3) and s["sentences_in_all_files"] >= 7
    sinks.results_json(results.withColumn("source_path", F.col("source_file")), str(tmp_path / "json"))
    back = files.results(spark, str(tmp_path / "json"), lines=True)
    assert sorted(map(str, extract.flat_matches(back).collect())) == sorted(map(str, extract.flat_matches(results).collect()))
    sinks.matches_csv(back, str(tmp_path / "csv"))
    lines = [p.read_text(encoding="utf-8") for p in (tmp_path / "csv").glob("*.csv")]
    assert lines[0].startswith("source_file,file_year,publishing_date,sentence_index,sentence,normalized,ice_categories,ice_patterns,rivers,year")
    sinks.matches_csv(back.limit(0), str(tmp_path / "none"))
    sinks.summary_json(extract.run_summary(rows, matches), str(tmp_path / "summary"))
    empty = rows.limit(0)
    assert extract.file_results(empty, extract.sentence_matches(empty, "filename")).collect() == []
    assert extract.run_summary(empty, extract.sentence_matches(empty, "filename")).collect()[0]["match_rate_pct"] == 0.0


EVENTS = [
    (1, "Oulujoki jäätyi 15. marraskuuta ja talvi tuli.", "1890-11-16"),
    (2, "Kemin tienoilta kerrotaan: jäänlähtö alkoi.", "1890-05-10"),
    (3, "Kauppa käy hyvin.", "1890-05-10"),
    (4, "Jääpatoja ja tulva.", "1902-07-10"),
    (5, "Suuri tulva nousi.", "1902-07-10"),
    (6, "Suuri tulva nousi.", None),
    (7, None, "1902-07-10"),
]


def test_events(spark):
    docs = spark.createDataFrame(EVENTS, "doc_id int, text string, published string")
    of = extract.events(docs, "published").cache()
    got = sorted(of.collect(), key=lambda r: (r["doc_id"], r["ord"], r["position"]))
    assert [(r["doc_id"], r["event_type"], r["keyword"], r["river_hint"], r["event_date"], r["date_confidence"]) for r in got] == [
        (1, "freeze", "jäätyi", "oulujoki", "15. marraskuuta", "exact"),
        (2, "breakup", "jäänlähtö", "kemi", "1890-05-10", "publication"),
        (4, "jam_flood", "jääpato", "", "1902-07-10", "publication"),
        (4, "jam_flood", "jääpatoja", "", "1902-07-10", "publication"),
    ]
    assert got[1]["event_date_iso"] == datetime.date(1890, 5, 10) and got[0]["event_date_iso"] is None
    # "tulva" beside "Jääpatoja": the co-term must be a word of its own
    kept = extract.without_repeats(of).collect()
    assert sorted((r["doc_id"], r["keyword"]) for r in kept) == [(1, "jäätyi"), (2, "jäänlähtö"), (4, "jääpatoja")]
    assert extract.event_records(of).columns == ["event_type", "keywords", "river_hint", "pub_date", "event_date", "date_confidence", "snippet"]
    view = extract.analysis_view(of, "doc_id")
    years = extract.counts_per_river_year(view, "breakup").collect()
    assert [tuple(r) for r in years] == [("kemi", 1890, 1)]


def test_event_files(spark, tmp_path):
    (tmp_path / "events.csv").write_text('binding_id,date,river_hint,event_type,snippet\n1,1890-05-10,kemi,freeze,"a, ""b""\nc"\n2,never,kemi,freeze,x\n3,1890-06-01,,freeze,x\n')
    of = files.events(spark, str(tmp_path / "events.csv"))
    assert [tuple(r) for r in extract.counts_per_river_year(of, "freeze").collect()] == [("kemi", 1890, 1)]
    assert of.where("binding_id = '1'").collect()[0]["snippet"] == 'a, "b"\nc'


def test_keyword_windows(spark):
    docs = spark.createDataFrame([(1, "aaaa"), (2, "x" * 500 + "\nJää " + "y" * 500)], "doc_id int, text string")
    got = sorted((r["doc_id"], r["position"], r["snippet"]) for r in extract.keyword_windows(docs, ("aa", "jää"), window=3).collect())
    assert got == [(1, 0, "aaaa"), (1, 1, "aaaa"), (1, 2, "aaaa"), (2, 501, "xx Jää yy")]


def test_nearest_record(spark):
    d = datetime.date
    events = spark.createDataFrame([(1, "a", d(1900, 5, 1)), (2, "a", d(1902, 1, 1)), (3, "b", d(1900, 1, 1)), (4, "a", d(1899, 1, 1))], "id int, river string, at date")
    records = spark.createDataFrame([("a", d(1900, 4, 1), 7), ("a", d(1900, 6, 1), 8), ("b", d(1901, 1, 1), 9)], "river string, day date, level int")
    got = {r["id"]: (r["day"], r["level"]) for r in extract.nearest_record(events, records, "river", "at", "day").collect()}
    assert got == {1: (d(1900, 4, 1), 7), 2: (d(1900, 6, 1), 8), 3: (None, None), 4: (None, None)}


def test_corrections(spark):
    rows = [(1, "Joki jäätyw1nen ja us7sssa"), (2, "hyvä"), (3, None), (4, "")] + [(10 + i, "iso joki jäätyi nyt kovaa") for i in range(30)] + [(50, "iso joki jaatyi nyt kovaa")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    same = {r["doc_id"]: r for r in ocr.correct(docs).collect()}
    assert same[1]["corrected_text"] == rows[0][1] and same[1]["n_flagged"] == 2 and same[3]["n_flagged"] == 0
    mended = {r["doc_id"]: r for r in ocr.correct(docs, auto_correct=True).collect()}
    assert mended[1]["corrected_text"] == "Joki jäätywinen ja ustsssa" and mended[1]["n_corrected"] == 2
    scorer = ocr.NgramScorer.fit(docs)
    assert scorer.fill(["joki"], ["nyt"])[0][0][0] == "jäätyi"
    model = {r["doc_id"]: r for r in ocr.correct(docs, scorer, auto_correct=True, threshold=0.05).collect()}
    assert model[50]["corrected_text"] == "iso joki jäätyi nyt kovaa" and model[10]["corrected_text"] == "iso joki jäätyi nyt kovaa"
    assert {f["reason"] for f in model[1]["flags"]} >= {"rule"}


def test_confusion_and_counts(spark):
    a = spark.createDataFrame([(1, "freeze"), (2, "none"), (3, "none")], "k int, g string")
    b = spark.createDataFrame([(1, "freeze"), (2, "freeze"), (4, "none")], "k int, t string")
    assert sorted(map(tuple, extract.confusion(a, b, "k", "g", "t").collect())) == [("freeze", "freeze", 1), ("freeze", "none", 1)]
    assert spark.range(1).select(extract.match_rate(F.lit(1), F.lit(3)), extract.match_rate(F.lit(0), F.lit(0)), tx.first_river(F.lit("Oulu ja KEMI"))).collect()[0][:] == (33.3, 0.0, "oulu")


def test_keyword_windows_context_takes_long_texts(spark):
    from strandline.plans import extract_queries as q

    sf = "/root/testdata/sf0.001"
    want = []
    for r in q.pages(spark, sf).select("doc_id", "text").collect():
        low = r["text"].lower()
        for word in q.CONTEXT:
            for at in range(len(low)):
                if low.startswith(word, at):
                    want.append((r["doc_id"], word, at, r["text"][max(0, at - 40) : at + len(word) + 40].replace("\n", " ").strip()))
    got = [(r["doc_id"], r["keyword"], r["position"], r["snippet"]) for r in q.keyword_windows_context(spark, sf).collect()]
    assert sorted(got) == sorted(want)
