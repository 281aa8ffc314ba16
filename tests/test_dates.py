"""Dates are searched only where they may be, and files' results from one pass over their matches."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.functions import spans as sp
from strandline.plans import extract_queries as q

PIECES = ["11", "1", "112", " ", "  ", "\n", "p", ":", ".", "n", "nä", "NA", "p:nä", "11 p:nä ", "maaliskuu", "MARS", "maj", "juli", "junikuu", "ſ", "ſyyskuu", "İ", "Kmaiku", "elokuun", "1903", "x", "4/7", "v.", "٣", "\x1c"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
def test_long_dates_are_those_of_the_pattern(text):
    for pattern in sp._LONG.values():
        assert [m.span() for m in sp._long_dates(text, pattern)] == [m.span() for m in pattern.finditer(text)]


def test_the_pattern_is_tried_at_months_only():
    tried = []

    class Counting:
        def match(self, text, at):
            tried.append(at)
            return sp._LONG[True].match(text, at)

        def finditer(self, text):
            raise AssertionError("whole text")

    text = "sana 5 " * 20_000 + "11 p:nä maaliskuuta 1903 " + "9 sana " * 20_000
    assert [m[0] for m in sp._long_dates(text, Counting())] == ["11 p:nä maaliskuuta 1903"] and len(tried) == 1
    assert isinstance(sp._LONG[True], re.Pattern) and sp.dates_of(text, True)[0]["day"] == 11


def test_matches_are_found_once(spark):
    plan = q.matches_flat_csv(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("Generate posexplode") <= 1 and plan.count("Relation") == 2
