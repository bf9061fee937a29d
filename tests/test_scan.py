"""The search by columns finds what the search row by row finds."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orgsift import rules
from orgsift.functions import scan as P
from orgsift.operators import extract as X

WORDS = ("The", "University", "of", "université", "Oslo", "college", "school", "Merit", "scholarship", "program", "phd", "in", "science", "deadline:", "January 5,", "2024", "2024-01-05",
         "$1,500", "up to $9", "worth", "usd", "fee: 3", "\n", "\x0b", "\x1e", "\x1f", "a_b", "7", "İstanbul", "ſcience", "fair", "due by May 1 2024", "€5", "St.", "Kelvin \u212a", "x")


def found(spark, texts, pad):
    docs = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    return sorted(map(str, X.extract_entities(docs, "k", "t", pad=pad).collect()))


@pytest.mark.parametrize("pad", [0, 7])
def test_entities_like_row_by_row(spark, monkeypatch, pad):
    rng = random.Random(5)
    texts = ["".join(rng.choice(WORDS) + rng.choice((" ", " ", "", ". ")) for _ in range(rng.randrange(1, 40))) for _ in range(300)] + [None, "", "plain"]
    by_columns = found(spark, texts, pad)
    monkeypatch.setattr(X, "written_out", lambda pattern: None)
    assert by_columns == found(spark, texts, pad) and len(by_columns) > 500


def test_no_pattern_of_the_rules_is_searched_row_by_row():
    for kind, _, listed in rules.ENTITY_PATTERNS:
        for p in listed:
            assert P.written_out("(?iu)" + p) and P.written_out("(?iu)" + X._plain_groups([p])[0])


@pytest.mark.parametrize("pattern", ["(?iu)a*", "(?iu)(?:a*)+b", "(?iu)a(?=b)", r"(?iu)\p{L}", "(?iu)a{2,2000}", "(?iu)ſ", "a", "(?i)a", r"(?iu)(a)\1", "(?iu)^a", "(?iu)a|"])
def test_what_is_not_written_out(pattern):
    assert P.written_out(pattern) is None


def test_plain_texts(spark):
    df = spark.createDataFrame([("a\n",), ("é",), ("\x1e",), ("\x1f",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(P.is_plain("t")).collect()] == [True, False, False, False, True, False]


def test_large_texts_are_taken_in_slices(monkeypatch):
    monkeypatch.setattr(P, "SLICE_BYTES", 10)
    monkeypatch.setattr(P, "SLICE_HITS", 2)
    texts = ["ab ab ab", "", "x ab", "ab" * 20, "no"]
    batch = pa.RecordBatch.from_pydict({"k": pa.array(range(9, 14)), "t": texts}).slice(0, 5)
    names = ["k", "_i", "hit_no", "hit", "part", "start_pos", "end_pos", "before", "after"]
    out = list(P._search(P._hits_of, names, [("[Aa][Bb]", False)], 1)([batch]))
    assert max(b.num_rows for b in out) == 2
    rows = [tuple(r.values()) for b in out for r in b.to_pylist()]
    want = [(9 + i, 0, n, "ab", None, at, at + 2, t[max(0, at - 1):at], t[at + 2:at + 3]) for i, t in enumerate(texts)
            for n, at in enumerate(j for j in range(len(t)) if t.startswith("ab", j))]
    assert rows == want


def test_a_context_is_split_once(spark):
    docs = spark.createDataFrame([(1, "Old Oslo College of Arts in town")], "k long, t string")
    hits = X.match_contexts(docs, "k", "t", ("college",), 20)
    named = X.name_from_context(hits).filter("name is not null")
    assert [r.name for r in named.collect()] == ["Old Oslo College of Arts in"]
    text = named.select("name")._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("instr(") <= 2 * text.count("Union") + 1


def test_lists_hold_the_rows_of_their_text(spark, monkeypatch):
    rng = random.Random(8)
    texts = ["".join(rng.choice(WORDS) + " " for _ in range(rng.randrange(1, 30))) for _ in range(100)] + [None, "", "plain"]
    docs = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    want = sorted(map(tuple, X.extract_entities(docs, "k", "t").select("k", "kind", "entity").collect()))
    for form in (P.written_out, lambda pattern: None):
        monkeypatch.setattr(X, "written_out", form)
        lists = X.entity_lists(docs, "k", "t")
        assert lists.count() == len(texts) and sorted(map(tuple, lists.select("k", F.inline("entities")).collect())) == want
