"""Plans that grow with their input: narrow tables over all cores, no derived table whole through the driver, sets that stay where they are."""

import random

import pytest
from pyspark.sql import functions as F

from orgsift.operators import dedup as D, extract as X, html as H, learning as L, lexicon as K, rank as R
from orgsift.queries import derived
from orgsift.session import SCAN_PARTITIONS, TASKS_PER_CORE


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def bare(spark):
    """The session without a number of scan partitions, as a cluster has it."""
    old = spark.conf.get(SCAN_PARTITIONS)
    spark.conf.unset(SCAN_PARTITIONS)
    yield spark
    spark.conf.set(SCAN_PARTITIONS, old)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    for name, sql in {
            "orders": "SELECT id AS o_orderkey, id % 9 AS o_custkey, 'O' AS o_orderstatus, id * 3.5D AS o_totalprice, timestamp'2024-01-05 00:00:00' AS o_orderdate, '2-HIGH' AS o_orderpriority FROM range(60)",
            "part": "SELECT id AS p_partkey, 'large ring' AS p_name, 'Brand#7' AS p_brand, 'LARGE' AS p_type, int(id) AS p_size, 900D AS p_retailprice FROM range(60)",
            "customer": "SELECT id AS c_custkey, 'Customer#000000001' AS c_name, 0 AS c_nationkey, 'BUILDING' AS c_mktsegment FROM range(9)",
            "nation": "SELECT 0 AS n_nationkey, 'FRANCE' AS n_name"}.items():
        spark.sql(sql).coalesce(1).write.parquet(f"{at}/{name}.parquet")
    return str(at)


@pytest.mark.parametrize("made", ["offers", "search_results", "search_queries", "odd_pages", "catalog_pages"])
def test_a_small_file_is_worked_on_by_all_cores(bare, tables, made):
    rows = getattr(derived, made)(bare, tables)
    assert rows.rdd.getNumPartitions() == TASKS_PER_CORE * bare.sparkContext.defaultParallelism
    assert rows.count() == {"search_queries": 9, "catalog_pages": 3}.get(made, 60)


def test_no_derived_table_goes_through_the_driver(spark):
    asked = spark.createDataFrame([(1, "program", "data science")], "query_id long, kind string, entity string")
    found = spark.createDataFrame([(1, "u", "program", "science"), (2, "v", "program", "art")], "query_id long, url string, kind string, entity string")
    urls = found.select("query_id", "url")
    relevance, matches = R.entity_relevance(asked, found, urls), R.entity_matches(asked, found)
    pages = spark.createDataFrame([(1, "https://a.org/x", "<p><a href='/o'>Oslo University</a></p>")], "page_id long, url string, html string")
    named = spark.createDataFrame([(1, "university", "Oslo University")], "page_id long, kind string, entity string")
    guided = X.entity_guided_orgs(H.page_elements(pages), named)
    names = spark.createDataFrame([(1, "a b c", "u", 1.0), (2, "a b d", "v", 0.5)], "pos long, name string, url string, score double")
    similar = D.dedup_similar(names, "name", "url", "score", "pos")
    for df in (relevance, matches, guided, similar):
        assert "BroadcastHashJoin" not in plan(df)
    assert sorted(map(tuple, relevance.collect())) == [(1, "u", 0.5), (2, "v", 0.0)]
    assert [r.target for r in guided.collect()] == ["https://a.org/o"]


def test_elements_of_a_page_do_not_travel(spark):
    pages = spark.createDataFrame([(1, "https://a.org/x", "<a href='/o'>Oslo</a>")], "page_id long, url string, html string")
    named = spark.createDataFrame([(1, "university", "Oslo")], "page_id long, kind string, entity string")
    lines = plan(X.entity_guided_orgs(H.page_elements(pages), named)).split("\n")
    join = next(i for i, x in enumerate(lines) if "SortMergeJoin" in x)
    exchange = next(i for i in range(join, len(lines)) if "Exchange" in lines[i])
    assert "elements" not in lines[exchange + 1].split("[", 1)[1].split("AS")[0] and "elements" not in lines[join]


def test_similar_pairs_like_brute_force(spark):
    rng = random.Random(3)
    common = [f"w{i}" for i in range(12)]
    sets = []
    for i in range(60):
        base = common + [f"r{i // 4}_{j}" for j in range(20)]
        sets.append(sorted(rng.sample(base, rng.randrange(29, 32))))
    df = spark.createDataFrame(list(enumerate(sets)), "id long, _w array<string>")
    score = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    wanted = {(i, j): score(sets[i], sets[j]) for i in range(60) for j in range(i + 1, 60) if score(sets[i], sets[j]) >= 0.85}
    pairs = D.similar_pairs(df, 0.85)
    got = {(r.id, r.other): r.jaccard for r in pairs.collect()}
    assert len(wanted) > 3 and got == pytest.approx(wanted)
    assert "hashpartitioning(w#" not in plan(pairs)  # no row for each word of a set


def test_marks_in_a_text(spark):
    text = "﷐ see ﷐2024-01-05, ﷐ 2024-02-06﷐"
    rows = X.pattern_hits(spark.createDataFrame([(1, text)], "k long, t string"), "k", "t", r"([0-9]{4})-[0-9-]+", 1).collect()
    assert [(r.hit_no, r.start_pos, r.hit, r.part) for r in rows] == [(0, text.index("2024-01"), "2024-01-05", "2024"), (1, text.index("2024-02"), "2024-02-06", "2024")]


def test_only_pieces_that_may_be_anchors_leave_a_text(spark):
    docs = spark.createDataFrame([(i, "the quick brown fox jumps over lazy dogs " * 5) for i in range(20)], "k long, t string")
    lexicon = spark.createDataFrame([("brown fox",), ("cat",)], "keyword string")
    hits = K.keyword_hits(docs, "k", "t", lexicon)
    assert hits.count() == 20 and "BroadcastHashJoin [k#" not in plan(hits)


def test_goals_of_a_category_are_not_one_task(spark):
    goals = spark.createDataFrame([(i, ["A", "B"]) for i in range(50)], "goal_id long, focus_categories array<string>")
    vocab = spark.createDataFrame([(i, "AB"[i % 2]) for i in range(30)], "id long, category string")
    heads = L.category_items(goals, vocab, 3)
    assert heads.count() == 150 and "hashpartitioning(category" not in plan(heads)


def test_pages_are_read_in_slices(spark, monkeypatch):
    import pyarrow as pa
    sizes, real = [], H.read_elements
    monkeypatch.setattr(H, "SLICE_PAGES", 4)
    monkeypatch.setattr(H, "read_elements", lambda html, selectors=(): (sizes.append(1), real(html, selectors))[1])
    batch = pa.RecordBatch.from_pydict({"page_id": pa.array(range(10), pa.int64()), "url": ["u"] * 10, "html": ["<p>a</p>"] * 10})
    assert [i for b in H._parse(())([batch]) for i in b.column(0).to_pylist()] == list(range(10)) and len(sizes) == 10


def test_queries_of_few_texts_make_no_pieces(spark):
    left = spark.createDataFrame([(1, f"t{i}") for i in range(3)], "g int, a string")
    right = spark.createDataFrame([(1, "at1b"), (1, "t"), (2, "t1")], "g int, b string")
    got = R.contained_pairs(left, right, "g", "a", "b")
    assert "_g#" not in plan(got)
    assert sorted(map(tuple, got.collect())) == [(1, "t0", "t"), (1, "t1", "at1b"), (1, "t1", "t"), (1, "t2", "t")]


def test_queries_of_many_texts_meet_by_pieces(spark):
    left = [(1, f"text{i}x") for i in range(R._FEW + 1)] + [(2, "text5x"), (3, None)]
    right = [(1, "a text5x b"), (1, "text"), (2, "text"), (2, "no"), (3, "text"), (1, None)]
    got = R.contained_pairs(spark.createDataFrame(left, "g int, a string"), spark.createDataFrame(right, "g int, b string"), "g", "a", "b")
    want = sorted((g, a, b) for g, a in left for h, b in right if g == h and a and b and (a in b or b in a))
    assert sorted(map(tuple, got.collect())) == want


def test_contexts_of_hits_are_made_only_where_they_are_read(spark):
    docs = spark.createDataFrame([(1, "The University of Oslo.")], "k int, t string")
    assert "right(" not in plan(X.extract_entities(docs, "k", "t").select("k", "entity"))


def test_a_batch_of_elements_is_made_by_columns():
    pages = [H.read_elements(x, (("ul", "", ""),))[1] for x in ('<p a=1 b>x</p><img src="y">', "", None)]
    batch = H._element_batch([1, 2, 3], ["u", None, "w"], [["x"], [], []], pages)
    assert [len(x) for x in batch.column(3).to_pylist()] == [2, 0, 0]
    assert batch.column(3).to_pylist()[0][0]["attrs"] == [("a", "1"), ("b", "")] and batch.schema.field(3).type.value_type.field("attrs").type == H._ELEMENT.field("attrs").type


def test_pages_are_parsed_once_for_all_extractors(spark):
    pages = spark.createDataFrame([(1, "https://a.example.com/", "<h2>Oslo University</h2>")], "page_id long, url string, html string")
    results = pages.selectExpr("page_id AS query_id", "page_id AS pos", "url", "'Best universities' AS title", "'' AS abstract")
    from orgsift.plans import jobs as J
    assert "MapInArrow" not in plan(J.discover_institutions(results, pages)["names"])


def test_no_table_of_elements_is_read(spark):
    html = """<table><tr><th>University</th></tr><tr><td><a href='/t'>Turku University</a></td><td>x</td></tr></table>
        <ul class='universities'><li><a href='/university/o'> Oslo University</a></li></ul><h2>Bergen College</h2><a href='/b?'>more</a>"""
    pages = spark.createDataFrame([(1, "https://a.example.com/", html), (2, "https://b.example.com/", None)], "page_id long, url string, html string")
    results = pages.selectExpr("page_id AS query_id", "page_id AS pos", "url", "'Best universities' AS title", "'' AS abstract")
    from orgsift.plans import jobs as J
    assert "elements" not in plan(J.discover_institutions(results, pages)["names"])
    elements = H.page_elements(pages)
    picked = X.picked_together(elements, {"selector": X.selector_links(), "cell": X.CELLS, "heading": X.HEADINGS, "link": X.LINKS})
    same = {"selector": (X.selector_rows(picked["selector"]), X.selector_candidates(elements)), "cell": (X.cell_rows(picked["cell"]), X.cell_names(elements)),
            "heading": (X.heading_rows(picked["heading"]), X.heading_candidates(elements)), "link": (picked["link"], H.links_of_elements(elements))}
    for name, (got, want) in same.items():
        rows = sorted(map(str, want.collect()))
        assert sorted(map(str, got.select(*want.columns).collect())) == rows and rows, name


def asked_and_found(spark):
    asked = [(1, "program", f"text{i}x") for i in range(R._FEW + 1)] + [(2, "degree", "phd"), (2, "program", "PhD"), (3, "program", "art"), (3, "amount", "$5"), (None, "program", "art")]
    found = [(1, "u", "program", "a text5x b"), (1, "u", "program", "no"), (1, "u", "program", "TEXT5x"), (2, "v", "degree", "phd"), (2, "v", "program", "phd in art"),
             (2, "v", "program", ""), (2, "w", "degree", None), (3, "v", "amount", "$5"), (3, "v", "program", "cart"), (3, "v", "program", "cart"), (None, "v", "program", "art"), (3, None, "program", "art")]
    return (spark.createDataFrame(asked, "query_id long, kind string, entity string"), spark.createDataFrame(found, "query_id long, url string, kind string, entity string"),
            spark.createDataFrame([x[:2] for x in found] + [(4, "z")], "query_id long, url string"))


def test_results_meet_queries_of_any_size(spark):
    asked, found, urls = asked_and_found(spark)
    lists = found.groupBy("query_id", "url").agg(F.collect_list(F.struct("kind", "entity")).alias("entities"))
    twice = lists.unionByName(lists)  # a result that comes twice has the same mean
    for given in (found, lists, twice):
        got = {(r.query_id, r.url): r.relevance for r in R.entity_relevance(asked, given, urls).collect()}
        assert got == {(1, "u"): 0.5, (2, "v"): 0.75, (2, "w"): 0.0, (3, "v"): 0.5, (None, "v"): 0.0, (3, None): 0.0, (4, "z"): 0.0}
    matches = sorted(map(tuple, R.entity_matches(asked, lists).select("query_id", "q_text", "q_kind", "url", "r_text", "times").collect()), key=str)
    assert matches == sorted([(1, "text5x", "program", "u", "a text5x b", 1), (1, "text5x", "program", "u", "text5x", 1), (2, "phd", "program", "v", "phd", 1),
                              (2, "phd", "program", "v", "phd in art", 1), (3, "art", "program", None, "art", 1), (3, "art", "program", "v", "cart", 2)], key=str)


def test_texts_of_results_travel_in_one_row(spark):
    asked, found, urls = asked_and_found(spark)
    lists = found.groupBy("query_id", "url").agg(F.collect_list(F.struct("kind", "entity")).alias("entities"))
    lists = spark.createDataFrame(lists.collect(), lists.schema)
    few = asked.filter("query_id > 1")
    for df in (R.entity_relevance(few, lists, urls), R.entity_matches(few, lists)):
        assert "hashpartitioning(query_id#" in plan(df) and ", entity#" not in plan(df) and "_g#" not in plan(df)


def test_hits_of_records_are_shuffled_once(spark):
    from orgsift.operators import records as O
    hits = spark.createDataFrame([(1, "u", k, e, p, p + 3, 0, 0) for k, e, p in (("scholarship", "Merit Grant", 5), ("amount", "$5", 9), ("amount", "$7", 30), ("university", "Oslo", 28))],
                                 "k long, url string, kind string, entity string, start_pos long, end_pos long, pattern_no int, hit_no int")
    rows = O.records_of(hits, "k", "funding", "url")
    assert plan(rows).count("Exchange") == 1
    assert sorted((r.amount, r.program_name, r.funding_body) for r in rows.collect()) == [("5", "Merit Grant", "Oslo"), ("7", "Merit Grant", "Oslo")]
