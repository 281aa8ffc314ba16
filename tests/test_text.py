"""Text functions: known answers, and native expressions against plain Python."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandline.functions import lexicons as lx
from strandline.functions import spans as sp
from strandline.functions import text as tx


@pytest.fixture(scope="module")
def value(spark):
    def run(fn, *texts):
        rows = [(i, t) for i, t in enumerate(texts)]
        out = spark.createDataFrame(rows, "i int, t string").select("i", fn(F.col("t")).alias("v")).orderBy("i").collect()
        got = [r["v"] for r in out]
        return got[0] if len(got) == 1 else got

    return run


def test_spelling_and_unicode(value):
    assert value(tx.normalize, "Oulujoki jäätywi tänään", "hafva", "tycky", "siandt", "Hafva") == ["Oulujoki jäätyvi tänään", "hava", "tykky", "siantt", "Hafva"]
    assert value(tx.rejoin_hyphens, "jäätymi-\nnen") == "jäätyminen"
    assert value(tx.straighten, "a—b–c‒d “x” ‘y’ ‚z‚­  e") == "a -- b - c - d \"x\" 'y' \"z\" e"
    assert value(tx.historical_fold, "Wesi PHoto ryck â ô û") == "vesi foto rykk ä ö u"
    assert [tuple(c) for c in value(tx.spelling_changes, "Wesi wuosi tycky hafva")] == [
        ("W", "V", "w→v"), ("w", "v", "w→v"), ("ck", "kk", "ck→kk"), ("hafv", "hav", "hafv→hav"),
    ]


def test_split_words_known(value):
    got = value(tx.merge_split_words, "To ppilan", "ter vehdys", "ovat saaneet", "joen ranta", "ter ves ihan", "a  b", "Vii meinen ter vehdys")
    assert got == ["Toppilan", "tervehdys", "ovat saaneet", "joenranta", "terves ihan", "a  b", "Viimeinen tervehdys"]


def merged(text):
    words, out, i = text.split(" "), [], 0
    while i < len(words):
        w, n = words[i], words[i + 1] if i + 1 < len(words) else ""
        goes_on = len(n) >= 3 and n[0].islower() and n not in lx.SPACE_COMMON
        head = re.match(r"^[A-ZÅÄÖ][a-zåäö]{0,2}$", w)
        short = 2 <= len(w) <= 4 and w[0].islower() and w[-1] in "bcdfghjklmnpqrstvwxzBCDFGHJKLMNPQRSTVWXZ" and w.lower() not in lx.SPACE_BLOCKED
        if goes_on and (head or short):
            out.append(w + n)
            i += 2
        else:
            out.append(w)
            i += 1
    return " ".join(out)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from("To ter ves hän Ää on kun joen ranta x tulva ovat T b1s äks Nyt saar".split() + [""]), max_size=8), min_size=1, max_size=20))
def test_split_words_like_plain_python(value, rows):
    texts = [" ".join(r) for r in rows]
    got = value(tx.merge_split_words, *texts)
    assert ([got] if len(texts) == 1 else got) == [merged(t) for t in texts]


def test_cleaning(value):
    assert value(tx.clean_text, "----\nOulu —  x\n12345\n\nabc\x07\r\nd", None, "") == ["Oulu -- x\n\nabc\nd", "", ""]
    assert value(tx.clean_text_basic, "a ==== b\n123\nc") == "a b\nc"
    assert value(tx.lines, "a\r\nb\rc\x85d e f") == ["a", "b", "c", "d", "e f"]


def test_sentences(value):
    assert value(tx.sentences, "Yksi. Kaksi!  kolme? ", "", "...") == [["Yksi.", "Kaksi!", "kolme?"], [], ["..."]]
    assert value(tx.sentences_before_capitals, "Lyhyt. Pitempi lause tässä. ja jatkuu. Äiti tuli kotiin.") == ["Pitempi lause tässä. ja jatkuu.", "Äiti tuli kotiin."]
    assert [len(c.split()) for c in value(tx.word_chunks, "a " * 130 + ". b")] == [60, 60, 11, 1]


def test_headers_and_words(value):
    got = value(tx.is_header, "OULUN SANOMAT", "Uutisia Oulusta.", "Lauseessa on monta sanaa ja piste", "N:o 12 Sanomat", "on se", "12", "Suomen Suuri Kansan Sanomalehti ja Muut Asiat Tässä")
    assert got == [True, True, False, False, False, False, False]
    assert value(tx.word_list, "Jää ja VESI on kylmää, vuonna") == ["jää", "vesi", "kylmää"]
    assert value(tx.has_any_token, "Jää suli", "jäätä", "Is this ice", "") == [True, False, True, False]
    assert value(tx.digits_to_letters, "jäätyw1nen", "us7sssa") == ["jäätywinen", "ustsssa"]


def test_rules_flag_first_match(value):
    got = value(sp.ocr_rule, "jäätyw1nen", "us7sssa", "SEESCETTTE", "HNBOULET", "Virorgrg", "Tllauihlita", "rgrgrg", "jää|tyy", "BSETSIS", "tÄlLauHliTa", "aaaab")
    assert got == ["digit_in_word", "digit_in_word", "long_allcaps", "long_allcaps", "low_vowel_ratio", "bad_consonant_start", "internal_cluster_5", "embedded_symbols", None, None, "repeated_chars"]


def test_names_of_files(value):
    assert value(tx.year_of_name, "1903-03-15_page-001.txt", "1902_page-003.txt", None) == [1903, None, None]
    assert value(tx.date_of_name, "1903-03-15_page-001.txt", "1902_page-003.txt") == ["1903-03-15", None]


def test_dates():
    assert sp.dates_of("Ouluun 11 p:nä huhtikuuta tultiin 15.5.1912 ja 3/4, v. 1899; 45.1.1900 ei") == [
        {"day": 15, "month": 5, "year": 1912, "raw": "15.5.1912", "format": "numeric"},
        {"day": 3, "month": 4, "year": None, "raw": "3/4", "format": "numeric"},
        {"day": 11, "month": 4, "year": None, "raw": "11 p:nä huhtikuu", "format": "finnish_long"},
        {"day": None, "month": None, "year": 1899, "raw": "v. 1899", "format": "year_only"},
        {"day": None, "month": None, "year": 1900, "raw": "1900", "format": "year_only"},
    ]
    assert sp.dates_of("maaliskuun 11 p:nä 1903")[0]["day"] is None
    assert sp.dates_of("maaliskuun 11 p:nä 1903", fixed_months=True)[0] == {
        "day": 11, "month": 3, "year": 1903, "raw": "maaliskuun 11 p:nä 1903", "format": "finnish_long"
    }
    assert sp.dates_of("12.1.85")[0]["year"] == 1985


def test_rivers(value):
    got = value(sp.rivers, "Kemijoen ja TORNIONJOELLA, xkemin Vuoksenniska", "", "Tenojoki Iijoen")
    assert [[tuple(x) for x in r] for r in got] == [
        [("Kemijoki", "Kemijoen", 0), ("Tornionjoki", "TORNIONJOELLA", 12), ("Vuoksi", "Vuoksenniska", 34)],
        [],
        [("Tenojoki", "Tenojoki", 0), ("Iijoki", "Iijoen", 9)],
    ]


def test_flood_gate_and_dates_of_events(spark):
    rows = [("tulva", "1902-07-10"), ("tulva", "1902-04-10"), ("tulva ja jääpato", "1902-07-10"), ("tulva ja rankkasade", "1902-04-10"), ("tulva", ""), ("tulva", None)]
    got = spark.createDataFrame(rows, "s string, d string").select(tx.flood_is_ice(F.col("s"), F.col("d"))).collect()
    assert [r[0] for r in got] == [False, True, True, False, False, False]
    rows = [("jäätyi 15. marraskuuta illalla",), ("eilen jäätyi",), ("jäätyi",)]
    got = spark.createDataFrame(rows, "s string").select(tx.event_date(F.col("s"), F.lit("1890-11-16")).alias("e")).collect()
    assert [tuple(r["e"]) for r in got] == [("15. marraskuuta", "exact"), ("1890-11-16", "inferred"), ("1890-11-16", "publication")]


def test_keyword_hits_overlap(spark):
    docs = spark.createDataFrame([(1, "aaaa"), (2, "xAAx"), (3, None), (4, "")], "doc_id int, text string")
    got = sp.keyword_hits(docs, ("aa", "x"))
    assert sorted((r["doc_id"], r["ord"], r["position"]) for r in got.collect()) == [(1, 0, 0), (1, 0, 1), (1, 0, 2), (2, 0, 1), (2, 1, 0), (2, 1, 3)]


def test_truncations():
    assert sp.truncations_of("Hän tulew. ja mk. menee\nsana yl abc") == [("tulew", 4), ("abc", 32)]


def test_corrections(spark):
    docs = spark.createDataFrame([(1, "Joki jäätyw1nen, oli us7sssa jäätyw1nen")], "doc_id int, text string")
    flags = sp.ocr_flags(docs).collect()
    assert [(f["original"], f["suggestion"], f["position"]) for f in flags] == [
        ("jäätyw1nen,", "jäätywinen", 5), ("us7sssa", "ustsssa", 21), ("jäätyw1nen", "jäätywinen", 5),
    ]
    assert flags[0]["context"] == "Joki jäätyw1nen, oli us7sssa jäätyw1nen"
