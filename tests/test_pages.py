"""Element arrays and extractors on a page with the awkward cases."""

import time

import pytest
from pyspark.sql import functions as F

from orgsift.operators import extract as X
from orgsift.operators import html as H
from orgsift.plans import jobs as J

URL = "https://list.example.com/dir/index.html"
HTML = """<!DOCTYPE html><html><head><TITLE> Best  universities &amp; more </TITLE><meta name="Description" content="all  of them">
<script type="application/ld+json">{"@type": "Organization", "name": "Solo University", "url": "https://solo.edu"}</script>
<script type="application/ld+json">[{"@type": "University", "name": "Array College", "url": ""}, 5, {"@type": "Other", "name": "No"}]</script>
<script type="application/ld+json">{broken</script></head><body>
<nav><a href="/home">Home</a></nav>
<h2>Plain Heading College</h2><p>text <a href="next.html">next</a></p><h3><a href="//cdn.example.org/x">Inside College</a></h3>
<ul><li>Outer <a href="https://o.edu/a">Outer University</a><ul><li><a href="https://i.edu/b">Inner University</a></li></ul></li><li><a href="https://e.edu"></a>Named College</li></ul>
<table><tr><th>University</th></tr><tr><td><a href="https://t.edu">Table University</a></td><td><a href="https://second.edu">Second</a></td></tr></table>
<a href="javascript:void(0)" data-goto="/real">Hidden</a><a href="javascript:go()" onclick="window.location='http://click.edu/x'">Clicked</a><a href="javascript:no()">Lost</a>
<a href="mailto:a@b.c">mail</a><a href="#top">top</a>
<div itemscope itemtype="https://schema.org/EducationalOrganization"><b itemprop="name">Micro Institute</b><a itemprop="url" href="https://micro.edu">m</a></div>
<p>Research <strong>Strong College</strong> phd <a href="/strong">go</a></p><aside>gossip</aside><p>open <b>never closed</body></html>"""


def pages(spark):
    return spark.createDataFrame([(1, URL, HTML), (2, "https://e.example.com/", "")], "page_id long, url string, html string")


def elements(spark):
    return H.page_elements(pages(spark))


def pairs(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_meta_and_text(spark):
    row = H.page_meta(pages(spark)).filter("page_id = 1").first()
    assert (row.title, row.description) == ("Best universities & more", "all of them")
    text = H.main_text(pages(spark)).filter("page_id = 1").first().main_text
    assert "Strong College" in text and "gossip" not in text and "Home" not in text


def test_links(spark):
    got = pairs(X.external_links(H.flat_links(pages(spark))).filter("href not like 'java%'"), "text", "target")
    assert ("Inside College", "https://cdn.example.org/x") in got and ("Outer University", "https://o.edu/a") in got
    assert not [t for t, _ in got if t in ("Home", "mail", "top", "next")]


def test_js_links(spark):
    got = pairs(X.recover_js_links(X.link_context(elements(spark)).filter("href like 'javascript:%'")), "text", "target")
    assert got == [("Clicked", "http://click.edu/x"), ("Hidden", "https://list.example.com/real")]


def test_tables_and_lists(spark):
    assert pairs(X.table_candidates(elements(spark)), "name", "target") == [("Table University", "https://t.edu")]
    assert len(pairs(X.table_candidates(elements(spark), first_cell=False), "name")) == 2
    assert pairs(X.list_candidates(elements(spark)), "name", "target") == [("Inner University", "https://i.edu/b"), ("Named College", "https://e.edu"), ("Outer University", "https://o.edu/a")]


def test_headings_and_emphasis(spark):
    assert pairs(X.heading_candidates(elements(spark)), "name", "target", "quality") == [("Inside College", "https://cdn.example.org/x", 0.7), ("Plain Heading College", "https://list.example.com/dir/next.html", 0.8)]
    assert ("Strong College", "https://list.example.com/strong") in pairs(X.emphasis_candidates(elements(spark)), "name", "target")


def test_structured(spark):
    assert pairs(X.jsonld_orgs(pages(spark)), "name", "target") == [("Solo University", "https://solo.edu")]
    assert pairs(X.jsonld_orgs(pages(spark), ("University",), need_url=False), "name") == [("Array College",)]
    assert pairs(X.microdata_orgs(elements(spark)), "name", "target") == [("Micro Institute", "https://micro.edu")]


def test_context(spark):
    row = X.link_context(elements(spark)).filter("text = 'go'").first()
    assert row.context == "ResearchStrong Collegephdgo"


def test_mine_pages(spark):
    orgs, content = J.mine_pages(pages(spark))
    got = {(r.name, r.method) for r in orgs.collect()}
    assert {("Solo University", "structured_data"), ("Outer University", "link_analysis"), ("Table University", "link_analysis"), ("Named College", "list_extraction")} <= got
    assert ("Home", "navigation") in pairs(content, "title", "content_type")


def test_partitions_do_not_matter(spark):
    rows = []
    for n in (1, 7, 64):
        orgs, _ = J.mine_pages(pages(spark).repartition(n))
        rows.append(pairs(orgs, "name", "url", "confidence"))
    assert rows[0] == rows[1] == rows[2]


def test_odd_links(spark):
    page = "<a href=/unq>U</a><a href='x?a&amp;b'>Universit&eacute; &#233;</a><a href=y>Foo <b>Bar</b></a><a href=z>open"
    got = H.flat_links(spark.createDataFrame([(1, URL, page), (2, URL, None)], "page_id long, url string, html string"))
    assert pairs(got, "no", "href", "text") == [(0, "/unq", "U"), (1, "x?a&b", "Université é"), (2, "y", "FooBar"), (3, "z", "open")]


def test_many_headings_on_one_page(spark):
    n = 8000
    page = "".join(f"<h3>Heading {i} College</h3><p>see <a href='/{i}'>more</a></p><table><tr><td>Cell {i}</td><td><a href='/c{i}'>c</a></td></tr></table>" for i in range(n))
    start = time.time()
    rows = X.heading_candidates(H.page_elements(spark.createDataFrame([(1, URL, page)], "page_id long, url string, html string"))).select("name", "target").collect()
    assert len(rows) == n and time.time() - start < 20
    assert all(r.target.endswith("/" + r.name.split()[1]) for r in rows)


def test_meta_decodes_all_references(spark):
    page = "<title>Universit&eacute; &#x41;&nbsp;&amp;</title><meta name=Description content='caf&eacute; &lt;b&gt;'><meta property=\"og:x\" content=plain>"
    row = H.page_meta(spark.createDataFrame([(1, URL, page)], "page_id long, url string, html string")).first()
    assert row.title == "Université A &" and row.description == "café <b>" and row.meta["og:x"] == "plain"


def rows_of(html):
    pieces, rows = H.read_elements(html)
    return pieces, rows, ["" if r["n"] is None else "".join(pieces[r["first"]:r["first"] + r["n"]]) for r in rows]


def test_missing_end_tags():
    html = ("<ul><li>one<li>two <b>bold<li>three<ul><li>in<li>side</ul></ul><table><tr><td>a<td>b<tr><th>c<td>d<table><tr><td>x</table></table>"
            "<select><option>p<option>q</select><p>first<p>second <i>it<div><p>third</div><dl><dt>t<dd>u<dd>v</dl><a href=1>k <a href=2>l</a>m")
    pieces, rows, texts = rows_of(html)
    of = lambda tag: [t for r, t in zip(rows, texts) if r["tag"] == tag]
    assert of("li") == ["one", "twobold", "threeinside", "in", "side"] and of("td") == ["a", "b", "dx", "x"] and of("tr") == ["ab", "cdx", "x"]
    assert of("option") == ["p", "q"] and of("dd") == ["u", "v"] and of("a") == ["k", "l"]
    assert of("p")[0] == "first" and of("p")[2] == "third"
    assert [rows[r["table"]]["pos"] if r["table"] is not None else None for r in rows if r["tag"] == "td"][-1] is not None


def test_well_formed_pages_nest_as_written():
    html = "<div><p>a<span>b</span></p><ul><li>c<ul><li>d</li></ul>e</li></ul><table><tr><td><table><tr><td>f</td></tr></table>g</td><td>h</td></tr></table></div>"
    pieces, rows, texts = rows_of(html)
    assert dict(zip([r["tag"] + str(r["pos"]) for r in rows], texts)) == {
        "div0": "abcdefgh", "p1": "ab", "span2": "b", "ul3": "cde", "li4": "cde", "ul5": "d", "li6": "d", "table7": "fgh", "tr8": "fgh",
        "td9": "fg", "table10": "f", "tr11": "f", "td12": "f", "td13": "h"}
    assert [r["parent"] for r in rows] == [None, 0, 1, 0, 3, 4, 5, 0, 7, 8, 9, 10, 11, 8]


def test_selectors_of_enclosing_tags():
    html = '<div class="card big"><ul><li><a href="university">U</a></li></ul></div><div class="x"><a href="university">V</a></div>'
    _, rows, _ = rows_of(html)
    pieces, rows = H.read_elements(html, [("ul li", "", "university"), ("div", "card", "university"), ("li div", "", "")])
    assert [r["under"] for r in rows if r["tag"] == "a"] == [("div card", "ul li "), ()]


@pytest.mark.parametrize("unit", ["<p>word ", "<li>word ", "<td>word ", "<div>word ", "<a href=x>word ", "<b>word ", "<option>w ", "<script>", "<!--", "<table><tr><td>x",
                                  "<p><b>", "<ul><li>", "<span itemscope itemtype=Organization itemprop=name>y ", "<a ", "<", "&", "</a", "<!"])
def test_a_megabyte_of_open_tags(unit):
    html = unit * (1_000_000 // len(unit))
    start = time.time()
    pieces, rows = H.read_elements(html)
    assert time.time() - start < 12
    assert sum(map(len, pieces)) <= len(html) and all(r["n"] is None or 0 <= r["first"] + r["n"] <= len(pieces) for r in rows)


@pytest.mark.parametrize("unit", ["<script>", "<nav>x", "<title>", "<div class=\"content", "<main>", "<!--", "<", "<style", "<title"])
def test_native_blocks_are_linear(spark, unit):
    page = spark.createDataFrame([(1, URL, unit * (1_000_000 // len(unit)))], "page_id long, url string, html string")
    H.main_text(page).select(F.length("main_text")).collect()
    start = time.time()
    H.main_text(page).select(F.length("main_text")).collect()
    page.select(H.title_of("html"), F.length(H.page_text("html"))).collect()
    assert time.time() - start < 8
