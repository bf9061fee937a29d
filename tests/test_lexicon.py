"""Keyword tables of any length against plain substring search; JSON read into a schema."""

import random
import time

from hypothesis import given, settings, strategies as st

from orgsift import rules
from orgsift.operators import extract as X
from orgsift.operators import lexicon as K
from orgsift.operators import score as S


def found(spark, texts, keywords):
    docs = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    lexicon = spark.createDataFrame([(w,) for w in keywords], "keyword string")
    return sorted((r.k, r.keyword) for r in K.keyword_hits(docs, "k", "t", lexicon).collect())


def plain(texts, keywords):
    return sorted({(k, w.lower()) for k, t in enumerate(texts) if t for w in keywords if w and w.lower() in t.lower()})


PARTS = st.lists(st.sampled_from(["ab", "c", "Ü", "é", "日本", "uni", " ", "-", "x", "ABC"]), max_size=7).map("".join)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.one_of(st.none(), PARTS), min_size=1, max_size=12), st.lists(PARTS, min_size=1, max_size=12))
def test_like_plain_search(spark, texts, keywords):
    assert found(spark, texts, keywords) == plain(texts, keywords)


def test_a_hundred_thousand_keywords(spark):
    rng = random.Random(1)
    name = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(5, 12)))
    keywords = sorted({name() for _ in range(100_000)})
    texts = [f"{name()} {rng.choice(keywords)}{name()} {rng.choice(keywords).upper()}" for _ in range(300)]
    start = time.time()
    got = found(spark, texts, keywords)
    assert time.time() - start < 60
    known = set(keywords)
    assert got == sorted({(k, t[a:b]) for k, text in enumerate(texts) for t in [text.lower()] for a in range(len(t)) for b in range(a + 5, min(a + 12, len(t) + 1)) if t[a:b] in known})


def test_tables_give_what_the_lists_give(spark):
    rows = [(1, "Oslo University and College", "https://www.uio.edu/university"), (2, "research Institute", "https://x.com"), (3, "", ""), (4, None, None), (5, "Nothing", "https://a.ac.uk/")]
    docs = spark.createDataFrame(rows, "k long, t string, u string")
    lists = {"keyword": rules.INSTITUTION_WORDS, "host": (".edu", ".ac."), "context": rules.ACADEMIC_CONTEXT_WORDS}
    by_table = {r.k: r.confidence for r in K.crawl_confidence_by(docs, "k", "t", "u", K.rule_table(spark, lists)).collect()}
    by_list = {r.k: r.c for r in docs.where("t is not null").select("k", S.crawl_confidence("t", "u").alias("c")).collect()}
    assert {k: by_table[k] for k in by_list} == by_list


def test_json_into_a_schema(spark):
    rows = [(1, 'x {"a": 1, "b": {"c": "y", "d": [1, 2]}} z'), (2, '{"a": "no", "b": 7}'), (3, "nothing"), (4, None), (5, "{broken}"), (6, '{"b": {"c": null}}')]
    df = spark.createDataFrame(rows, "k long, t string")
    out = X.salvage_json(df, "t", "a long, b struct<c: string, d: array<long>>, e double", {"a": -1, "b": {"c": "?", "d": []}})
    got = {r.k: (r.record.a, r.record.b.c, r.record.b.d, r.record.e, r.json_error) for r in out.collect()}
    assert got[1] == (1, "y", [1, 2], None, None) and got[2] == (-1, "?", [], None, None) and got[6] == (-1, "?", [], None, None)
    assert got[3] == (-1, "?", [], None, "No JSON content found") and got[4][4] == "No JSON content found" and got[5][4] == "Invalid JSON format"
