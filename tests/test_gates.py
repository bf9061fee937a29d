"""The literals that a pattern needs: no text that a pattern hits may fail the test for them."""

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from orgsift import rules
from orgsift.functions.text import may_hit, needed_literals
from orgsift.operators import extract as X

PATTERNS = [p for _, _, listed in rules.ENTITY_PATTERNS for p in listed] + [p for _, _, listed in rules.NAME_PATTERN_FAMILIES for p in listed]


def test_literals():
    assert needed_literals(r"(?iu)\b(?:School|law)\s+of\b") == ("school", "law")
    assert needed_literals(r"a(?:b|c*)d+xyz") == ("xyz",) and needed_literals(r"\d+") == () and needed_literals(r"(?:abc)?") == ()
    assert needed_literals(r"(?:abc|\d)") == () and needed_literals(r"\p{L}+ of") == ()
    assert all(needed_literals("(?iu)" + p) for p in PATTERNS)


WORDS = ["University", "of", "Oslo", "Universität", "The", "TECHNICAL", "Institute", "Technology", "School", "law", "ſchool", "Inıtitute", "UNİVERSITY",
         "scholarship", "MBA", "in", "due by: May 1, 2024", "$500", "1/2/2024", "대학", "Saint", "Ab", "-", ",", "Kid", "conference", "on", "AI"]


@settings(max_examples=4, deadline=None)
@given(st.lists(st.lists(st.sampled_from(WORDS), min_size=1, max_size=9).map(" ".join), min_size=60, max_size=60))
def test_the_test_never_says_no_to_a_hit(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    wrong = [F.sum((F.col("t").rlike("(?iu)" + p) & ~may_hit("t", F.lower("t"), "(?iu)" + p)).cast("int")) for p in PATTERNS]
    assert set(df.agg(*[w.alias(str(i)) for i, w in enumerate(wrong)]).first()) == {0}


@pytest.mark.parametrize("text", [None, "", "x" * 100_000, "no hit here", "Oslo University and Oslo University"])
def test_scans_of_odd_texts(spark, text):
    df = spark.createDataFrame([(1, text)], "k long, t string")
    assert X.extract_entities(df, "k", "t").count() == (0 if not text or "Oslo" not in text else X.extract_entities(df, "k", "t").filter("kind = 'university'").count())
