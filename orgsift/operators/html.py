"""Pages as element arrays, and native expressions for flat tags.

`page_elements` gives one row per page with an array of elements.  Extractors read that array
inside the row, so nothing is shuffled between parsing and candidates.
"""

import re
from collections import Counter
from html import unescape as _unescape
from html.parser import HTMLParser
from itertools import accumulate, chain
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.text import as_col, collapse, cut_words, once
from ..rules import LINK_SELECTORS

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NO_TEXT = frozenset("html head body".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SLICE_ELEMENTS = 20000
SLICE_PAGES = 256

_PLACES = ("pos", "depth", "first", "n", "chars", "parent", "cell", "cell_no", "table", "li", "heading", "item", "item_name")
_STRINGS = ("tag", "href", "inner", "next", "near", "item_url")
_ELEMENT = pa.struct([*[(c, pa.int32()) for c in _PLACES], *[(c, pa.string()) for c in _STRINGS],
                      ("attrs", pa.map_(pa.string(), pa.string())), ("under", pa.list_(pa.string()))])
ELEMENT = ("struct<" + ",".join([*[f"{c}:int" for c in _PLACES], *[f"{c}:string" for c in _STRINGS]])
           + ",attrs:map<string,string>,under:array<string>>")
ELEMENTS = f"page_id long, url string, pieces array<string>, elements array<{ELEMENT}>"
LINKS = "page_id long, url string, no int, href string, text string"

#: A start tag ends an open element of these kinds, unless one of the enclosing tags was opened in between.
_ENDS = {"p": ("p",), "li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"),
         "option": ("option",), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
_BLOCKS = "div section article aside nav main header footer blockquote form fieldset details figure"
_ENCLOSING = {"p": f"{_BLOCKS} ul ol dl li dd dt table td th caption button", "li": "ul ol menu table td th", "td": "table", "th": "table", "tr": "table",
              "option": "select datalist", "dt": "dl table td th", "dd": "dl table td th"}
_KINDS = {tag: [k for k, around in _ENCLOSING.items() if tag in around.split()] for tag in set(" ".join(_ENCLOSING.values()).split())}
_CLOSABLE = frozenset(x for kinds in _ENDS.values() for x in kinds)


def selector_name(rule) -> str:
    """How `under` names a selector: its enclosing tags and the word in the class of the last one."""
    return f"{rule[0]} {rule[1]}"


class _Reader(HTMLParser):
    """Collects elements in document order, and the stripped text nodes of the page.

    The text of an element is a span of the text nodes, so elements inside each other hold no copies.
    The nearest table, row, cell, list item, heading and item stand on the stack of open tags, so a
    tag costs the same wherever it is.

    Well-formed pages are read as the standard parser nests them.  Where an end tag is missing, the
    next p, li, option, dt, dd, cell or row ends the one before it inside the same enclosing list,
    table or block, and the text of a link ends where the next link begins.
    """

    def __init__(self, only=None, selectors=()):
        super().__init__(convert_charrefs=True)
        self.rows, self.pieces, self.only = [], [], only
        self.open, self.times, self.cells = [], Counter(), Counter()
        self.at = {k: [] for k in _CLOSABLE}  # where elements with implied ends stand among the open ones
        self.around = {k: [-1] for k in _ENCLOSING}  # and what encloses them
        self.link = None
        self.selectors = [(selector_name(r), r[0].split(), r[1]) for r in selectors]
        self.step_tags = frozenset(t for _, tags, _ in self.selectors for t in tags)
        self.root = dict(depth=0, parent=None, cell=None, table=None, li=None, heading=None, item=None, line=None, steps=(0,) * len(self.selectors), under=())

    def handle_starttag(self, tag, attrs):
        for kind in _ENDS.get(tag, ()):
            if self.at[kind] and self.at[kind][-1] > self.around[tag][-1]:
                to = self.at[kind][-1]
                while len(self.open) > to:
                    self._close()
        pos = len(self.rows)
        attrs = {k: v or "" for k, v in attrs}
        near = self.open[-1][2] if self.open else self.root
        wanted = self.only is None or tag in self.only
        row = dict(near, pos=pos, tag=tag, first=len(self.pieces), n=None, href=attrs.get("href"), attrs=attrs, cell_no=None, wanted=wanted)
        if tag in ("td", "th"):
            self.cells[near["line"]] += 1
            row["cell_no"] = self.cells[near["line"]]
        self.rows.append(row)
        if tag in VOID:
            row["n"] = 0
            return
        if tag == "a":
            if self.link is not None and self.link["n"] is None:
                self.link["n"] = len(self.pieces) - self.link["first"]
            self.link = row
        below = dict(near, parent=pos, depth=near["depth"] + 1)
        if tag in self.step_tags:
            self._step(below, tag, attrs.get("class", ""))
        name = ("cell" if tag in ("td", "th") else "table" if tag == "table" else "li" if tag == "li"
                else "heading" if tag in HEADINGS else "line" if tag == "tr" else None)
        if name:
            below[name] = pos
        if "itemtype" in attrs:
            below["item"] = pos
        if tag in _CLOSABLE:
            self.at[tag].append(len(self.open))
        for kind in _KINDS.get(tag, ()):
            self.around[kind].append(len(self.open))
        self.open.append((tag, pos, below))
        self.times[tag] += 1

    def _step(self, below, tag, classes):
        """How far the enclosing tags have come along each selector."""
        steps, under = [], below["under"]
        for (name, tags, word), k in zip(self.selectors, below["steps"]):
            if k < len(tags) and tag == tags[k] and (k + 1 < len(tags) or word in classes):
                k += 1
                if k == len(tags):
                    under = (*under, name)
            steps.append(k)
        below["steps"], below["under"] = tuple(steps), under

    def updatepos(self, i, j):
        """Lines are not counted."""
        return j

    def parse_comment(self, i, report=1):
        """A comment without an end goes to the end of the page."""
        end = super().parse_comment(i, report)
        return len(self.rawdata) if end < 0 else end

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close()

    def handle_endtag(self, tag):
        if self.times[tag]:
            while self._close() != tag:
                pass

    def _close(self):
        tag, pos, _ = self.open.pop()
        self.times[tag] -= 1
        if tag in _CLOSABLE:
            self.at[tag].pop()
        for kind in _KINDS.get(tag, ()):
            self.around[kind].pop()
        row = self.rows[pos]
        if row["n"] is None and tag not in NO_TEXT and row["wanted"]:
            row["n"] = len(self.pieces) - row["first"]
        return tag

    def handle_data(self, data):
        if self.open and self.open[-1][0] in ("script", "style"):
            if self.open[-1][0] == "script":
                self.rows[self.open[-1][1]]["attrs"]["#body"] = data
            return
        if data.strip():
            self.pieces.append(data.strip())


_TAG_BEGINS = re.compile("<[a-zA-Z/!?]").search


def _with_whole_tags(html: str) -> str:
    """The page without a last tag that never ends: behind the last `>` no tag can be whole."""
    last = html.rfind(">") + 1
    cut = _TAG_BEGINS(html, last)
    return html[:cut.start()] if cut and not html.startswith("<!--", cut.start()) else html


def _read(html: str, only=None, selectors=()) -> _Reader:
    reader = _Reader(only, selectors)
    reader.feed(_with_whole_tags(html or ""))
    reader.close()
    while reader.open:
        reader._close()
    return reader


def read_elements(html: str, selectors=()) -> tuple[list, list]:
    """The text nodes of a page, and its elements with what extractors ask about their surroundings.

    first, n, chars: the span of text nodes and its length; inner: the first link inside a cell,
    heading or list item; next: the next link of the document (headings); near: the first link whose
    parent or grandparent is the own parent (strong, b); item_name, item_url: the element of the first
    name and the first url property of an item; under: the selectors that the enclosing tags fulfil.
    """
    reader = _read(html, selectors=selectors)
    rows, pieces = reader.rows, reader.pieces
    upto = [0, *accumulate(map(len, pieces))]
    inner, near, names, urls = {}, {}, {}, {}
    following, after = None, [None] * len(rows)
    for row in reversed(rows):
        after[row["pos"]] = following
        link = row["tag"] == "a" and row["href"] is not None
        if link:
            following = row["href"]
            for kind in ("cell", "heading", "li"):
                inner[row[kind]] = row["href"]
            near[row["parent"]] = row["href"]
            if row["parent"] is not None:
                near[rows[row["parent"]]["parent"]] = row["href"]
        if row["item"] is not None:
            prop = row["attrs"].get("itemprop")
            if prop == "name":
                names[row["item"]] = row["pos"]
            elif prop == "url":
                urls[row["item"]] = row["href"]
    for row in rows:
        tag, pos = row["tag"], row["pos"]
        row["chars"] = None if row["n"] is None else upto[row["first"] + row["n"]] - upto[row["first"]]
        row["inner"] = inner.get(pos) if tag in HEADINGS or tag in ("td", "th", "li") else None
        row["next"] = after[pos] if tag in HEADINGS else None
        row["near"] = near.get(row["parent"]) if tag in ("strong", "b") else None
        row["item_name"], row["item_url"] = names.get(pos), urls.get(pos)
    return pieces, rows


_NAMES = [f.name for f in _ELEMENT]
_VALUES = itemgetter(*_NAMES)


def _ends(lists) -> pa.Array:
    return pa.array([0, *accumulate(map(len, lists))], pa.int32())


def _element_batch(ids, urls, pieces, made) -> pa.RecordBatch:
    rows = list(chain.from_iterable(made))
    values = dict(zip(_NAMES, zip(*map(_VALUES, rows)))) if rows else dict.fromkeys(_NAMES, ())
    columns = {n: pa.array(values[n], pa.int32()) for n in _PLACES} | {n: pa.array(values[n], pa.string()) for n in _STRINGS}
    attrs, under = values["attrs"], values["under"]
    columns["attrs"] = pa.MapArray.from_arrays(_ends(attrs), pa.array(chain.from_iterable(attrs), pa.string()),
                                               pa.array(chain.from_iterable(map(dict.values, attrs)), pa.string()))
    columns["under"] = pa.ListArray.from_arrays(_ends(under), pa.array(chain.from_iterable(under), pa.string()))
    flat = pa.StructArray.from_arrays([columns[n] for n in _NAMES], fields=list(_ELEMENT))
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(pieces, pa.list_(pa.string())), pa.ListArray.from_arrays(_ends(made), flat)],
        names=["page_id", "url", "pieces", "elements"])


def _parse(selectors):
    """Slices of a batch, so that a task holds the elements of a few pages only."""
    def run(batches):
        for batch in batches:
            ids, urls, pieces, made, size = [], [], [], [], 0
            parts = (batch.slice(at, SLICE_PAGES) for at in range(0, batch.num_rows, SLICE_PAGES))
            for page_id, url, html in chain.from_iterable(zip(*[part.column(k).to_pylist() for k in range(3)]) for part in parts):
                text, rows = read_elements(html, selectors)
                ids.append(page_id)
                urls.append(url)
                pieces.append(text)
                made.append(rows)
                size += len(rows)
                if size >= SLICE_ELEMENTS:
                    yield _element_batch(ids, urls, pieces, made)
                    ids, urls, pieces, made, size = [], [], [], [], 0
            if ids:
                yield _element_batch(ids, urls, pieces, made)
    return run


def page_elements(pages: DataFrame, selectors=LINK_SELECTORS) -> DataFrame:
    """page_id, url, the text nodes and the elements of each page; the html itself is dropped.

    A null or empty page has no elements.  `selectors` are those that selector_candidates will ask for.
    """
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(_parse(selectors), ELEMENTS)


def text_of(e) -> Column:
    """The text of an element of page_elements, null for html, head and body; it costs as much as the text is long."""
    return F.when(e["n"].isNotNull(), F.array_join(F.slice(F.col("pieces"), e["first"] + 1, e["n"]), ""))


def explode_elements(elements: DataFrame) -> DataFrame:
    """A row per element, with its text."""
    named = [c for c in (*_PLACES, *_STRINGS, "attrs", "under")]
    shaped = F.transform("elements", lambda e: F.struct(*[e[c].alias(c) for c in named], text_of(e).alias("text")))
    return elements.select("page_id", "url", F.explode(shaped).alias("e")).select("page_id", "url", "e.*")


# ------------------------------------------------------------- native flat tags

_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
STRIPPED_TAGS = ("script", "style", "nav", "footer", "aside")
STRIPPED_TAGS_AND_HEADER = STRIPPED_TAGS + ("header",)


def unescape(c) -> Column:
    out = as_col(c)
    for entity, char in _ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _closed(c: Column, end: str, change) -> Column:
    """change() of c up to the last place where `end` stands, and the rest as it is.

    Behind that place nothing that `end` closes can match, and before it every search for an end is
    successful, so openings without an end are not searched for again and again.
    """
    return let(c, lambda x: F.when(F.contains(F.lower(x), F.lit(end)), let(
        F.regexp_extract(x, rf"(?is)^(.*{end})", 1),
        lambda head: F.concat(change(head), F.substring(x, F.length(head) + 1, F.length(x))))).otherwise(x))


def without_tags(c) -> Column:
    """Text of a fragment: comments and tags go, nothing is put in their place."""
    bare = _closed(as_col(c), "-->", lambda x: F.regexp_replace(x, r"(?s)<!--.*?-->", ""))
    return unescape(_closed(bare, ">", lambda x: F.regexp_replace(x, r"(?s)<[^>]*>", "")))


def strip_blocks(c, tags=STRIPPED_TAGS_AND_HEADER) -> Column:
    """c without the blocks of these tags; an opening tag ends before the next `<`, a block at its first end tag."""
    out = as_col(c)
    for tag in tags:
        out = _closed(out, f"</{tag}>", lambda x, tag=tag: F.regexp_replace(x, rf"(?is)<{tag}\b[^<>]*>.*?</{tag}>", ""))
    return out


def _block(c: Column, opening: str, tag: str) -> Column:
    """What stands between the first such opening tag that has an end tag behind it and that end tag, or the empty string."""
    head = F.regexp_extract(c, rf"(?is)^(.*</{tag}>)", 1)
    return F.regexp_extract(head, rf"(?is){opening}(.*?)</{tag}>", 1)


def page_text(c, tags=STRIPPED_TAGS) -> Column:
    """Whole text of a page without its boilerplate blocks."""
    return collapse(without_tags(strip_blocks(c, tags)))


def main_text(pages: DataFrame, max_chars: int = None, tags=STRIPPED_TAGS_AND_HEADER) -> DataFrame:
    """Text of <main>, else <article>, else a content div, else the page."""
    kept = strip_blocks("html", tags)

    def block(opening, tag):
        return F.nullif(_block(F.col("_kept"), opening, tag), F.lit(""))

    area = F.coalesce(block(r"<main\b[^<>]*>", "main"), block(r"<article\b[^<>]*>", "article"),
                      block(r"<div\b[^<>]*class=\"[^\"<>]*(?:content|main)[^\"<>]*\"[^<>]*>", "div"), F.col("_kept"))
    text = collapse(without_tags(area))
    if max_chars:
        text = F.left(text, F.lit(max_chars))
    return once(once(pages, _kept=kept).drop("html"), main_text=text).drop("_kept")


def title_of(c) -> Column:
    return collapse(unescape(_block(as_col(c), "<title[^<>]*>", "title")))


def _meta_parts(c):
    tags = F.regexp_extract_all(as_col(c), F.lit(r"(?is)(<meta\b[^>]*>)"), F.lit(1))

    def attr(tag, name):
        quoted = [F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*{q}", 1) for q in ('"([^"]*)"', "'([^']*)'", r"([^\s\"'>]+)")]
        return F.coalesce(*[F.nullif(q, F.lit("")) for q in quoted], F.lit(""))

    pair = F.transform(tags, lambda t: F.struct(
        F.lower(F.when(attr(t, "name") != "", attr(t, "name")).otherwise(attr(t, "property"))).alias("k"),
        attr(t, "content").alias("v")))
    return F.filter(pair, lambda p: (p["k"] != "") & (p["v"] != ""))


@F.pandas_udf(T.StringType())
def decoded(text: pd.Series) -> pd.Series:
    """All character references, for short texts such as titles."""
    return text.map(lambda x: _unescape(x) if x and "&" in x else x)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.StringType())])))
def _decoded_pairs(pairs: pd.Series) -> pd.Series:
    return pairs.map(lambda found: [{"k": p["k"], "v": _unescape(p["v"])} for p in found])


def page_meta(pages: DataFrame) -> DataFrame:
    """Title, description and the map of named meta tags (the last one wins), with all references decoded."""
    pages = once(pages, _title=_block(F.col("html"), "<title[^<>]*>", "title"), _meta=_meta_parts("html"))
    pages = pages.withColumns({"_title": collapse(decoded("_title")), "_meta": _decoded_pairs("_meta")})
    pairs = F.transform("_meta", lambda p: F.struct(p["k"].alias("k"), collapse(p["v"]).alias("v")))
    last = F.aggregate(pairs, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")),
                       lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["k"]), F.create_map(p["k"], p["v"])))
    return (pages.withColumns({"title": F.col("_title"), "meta": last})
            .withColumn("description", F.coalesce(F.try_element_at("meta", F.lit("description")), F.lit("")))
            .drop("html", "_title", "_meta"))


def _link_rows(batches):
    for pages in batches:
        rows = []
        for page_id, url, html in zip(pages.page_id, pages.url, pages.html):
            page = _read(html, only=("a",))
            links = [r for r in page.rows if r["tag"] == "a" and r["href"] is not None]
            rows += [(page_id, url, no, r["href"].strip(), "".join(page.pieces[r["first"]:r["first"] + r["n"]])) for no, r in enumerate(links)]
            if len(rows) >= SLICE_ELEMENTS:
                yield pd.DataFrame(rows, columns=["page_id", "url", "no", "href", "text"])
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=["page_id", "url", "no", "href", "text"])


def flat_links(pages: DataFrame) -> DataFrame:
    """(page_id, url, no, href, text) for every <a href=..>, from the reader of page_elements.

    Unquoted values, links that are never closed, all character references and nested tags are read
    as a browser would; the text is the stripped text nodes joined together.
    """
    return pages.select("page_id", "url", "html").mapInPandas(_link_rows, LINKS)


def links_of_elements(elements: DataFrame) -> DataFrame:
    """The rows of flat_links from pages that are already parsed."""
    shaped = F.transform(F.filter("elements", lambda e: (e["tag"] == "a") & e["href"].isNotNull()),
                         lambda e: F.struct(F.trim(e["href"]).alias("href"), text_of(e).alias("text")))
    return elements.select("page_id", "url", F.posexplode(shaped).alias("no", "_l")).select(
        "page_id", "url", "no", "_l.href", "_l.text")


def tag_counts(pages: DataFrame) -> DataFrame:
    """How many elements of each tag a page has, counted before anything leaves the page."""
    per_page = page_elements(pages, ()).select("page_id", F.explode("elements.tag").alias("tag"))
    return per_page.groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))


def short_description(c, n: int = None) -> Column:
    """Collapsed text; with n, at most n characters cut back to a word."""
    return cut_words(collapse(c), n) if n else collapse(c)
