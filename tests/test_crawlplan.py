"""Robots rules against the standard parser, the whole frontier in order, long gazetteer phrases."""

from urllib.robotparser import RobotFileParser

import pytest

from orgsift.operators import crawlplan as P
from orgsift.operators import extract as X

FILES = {
    "own": [("*", "/fr/", False), ("Sifter", "/", True)],
    "query": [("*", "/x?page=", False), ("*", "/", True)],
    "order": [("sifter", "/a/b", True), ("sifter", "/a", False)],
    "empty": [("*", "", False)],
    "all": [("*", "/", False)],
    "parts": [("other", "/", False), ("sift", "/s", False), ("sifter", "/", False)],
}
PATHS = ["", "/", "/fr/1", "/x?page=2", "/x", "/a", "/a/b/c", "/s/1", "/x?q#page"]


@pytest.mark.parametrize("agent", ["sifter", "Sifter/2.1", "nobody"])
def test_robots_like_the_standard_parser(spark, agent):
    rules, urls, wanted = [], [], {}
    for name, lines in FILES.items():
        text, last = [], None
        for seq, (who, prefix, allow) in enumerate(lines):
            rules.append((f"{name}.example.com", who, seq, prefix, allow))
            text += ([] if last == who else ["", f"User-agent: {who}"]) + [f"{'Allow' if allow else 'Disallow'}: {prefix}"]
            last = who
        parser = RobotFileParser()
        parser.parse(text)
        for p in PATHS:
            url = f"https://{name}.example.com{p}"
            urls.append((url,))
            wanted[url] = parser.can_fetch(agent, url)
    urls.append(("https://free.example.com/fr/1",))
    wanted["https://free.example.com/fr/1"] = True
    robots = spark.createDataFrame(rules, "host string, agent string, seq int, path_prefix string, allow boolean")
    got = {r.url: r.allowed for r in P.robots_filter(spark.createDataFrame(urls, "url string"), robots, agent).collect()}
    assert got == wanted


def test_the_whole_frontier_is_numbered(spark):
    rows = [(f"u{i}", i % 3, i // 1500, i % 1500) for i in range(12_000)]
    out = P.order_frontier(spark.createDataFrame(rows, "url string, priority int, page long, no long"), ["page", "no"])
    got = {r.url: r.place for r in out.collect()}
    wanted = sorted(rows, key=lambda r: (-r[1], r[2], r[3]))
    assert got == {r[0]: i + 1 for i, r in enumerate(wanted)}


def test_gazetteer_phrases_of_any_length(spark):
    gaz = spark.createDataFrame([("university of british columbia", "ORG"), ("british columbia", "GPE"), ("university", "ORG")], "phrase string, label string")
    docs = spark.createDataFrame([(1, "The University of British Columbia, in British Columbia"), (2, "of"), (3, None)], "id long, text string")
    got = sorted((r.id, r.word_no, r.phrase, r.label) for r in X.gazetteer_entities(docs, "id", "text", gaz).collect())
    assert got == [(1, 1, "university of british columbia", "ORG"), (1, 3, "british columbia", "GPE"), (1, 6, "british columbia", "GPE")]
    assert X.gazetteer_entities(docs, "id", "text", gaz.where("false")).count() == 0


def test_places_and_deep_pages(spark):
    from orgsift.operators.learning import page_of
    from orgsift.operators.ordering import global_places
    rows = spark.range(0, 5000, numPartitions=7).selectExpr("id * 7919 % 5000 AS k", "id % 3 AS g")
    placed = global_places(rows, ["g", "k"], "place").orderBy("place").collect()
    assert [(r.g, r.k) for r in placed] == sorted((r.g, r.k) for r in placed) and [r.place for r in placed] == list(range(1, 5001))
    assert sorted(r.k for r in page_of(rows, "k", 4321, 100).collect()) == list(range(4321, 4421))
    assert page_of(rows.where("false"), "k", 0, 10).count() == 0 and page_of(rows, "k", 6000, 10).count() == 0
    same = global_places(rows.select("g"), ["g"], "place").collect()  # ties get places of their own
    assert sorted(r.place for r in same) == list(range(1, 5001))
