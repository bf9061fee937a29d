"""Candidates from pages and texts: links, lists, tables, headings, structured data, names, entities."""

import re

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .. import rules
from ..functions.scan import is_plain, plain_hits, plain_lists, written_out
from ..functions.text import (any_pattern, any_word, before_first_separator, collapse, folded_away,
                              has, has_bit, hash_bits, may_hit, once, salvage_block, stripped, words)
from ..functions.url import host, host_label_name, is_http, resolve
from ..session import written
from .classify import is_institution, is_institution_strict, is_valid_name
from .html import flat_links, links_of_elements, page_elements, page_text, selector_name, text_of
from .score import heading_quality, link_quality, list_quality, pattern_confidence, table_quality

_SKIPPED_LINK = r"^(#|mailto:|tel:)"

# ---------------------------------------------------------- rows out of elements


def _el(pos) -> Column:
    return F.get("elements", pos)


def _pick(elements: DataFrame, keep, fields) -> DataFrame:
    """Explode the elements that pass `keep`, each reduced to the named fields first."""
    shaped = F.transform(F.filter("elements", keep), lambda e: F.struct(*[c.alias(n) for n, c in fields(e).items()]))
    return elements.select("page_id", "url", F.explode(shaped).alias("_e")).select("page_id", "url", "_e.*")


def _is_link(e) -> Column:
    return (e["tag"] == "a") & e["href"].isNotNull()


def picked_together(elements: DataFrame, picks: dict) -> dict:
    """For each named pick (keep, fields) its rows as _pick gives them, with their places among them in `no`.

    The elements are read once, and the rows of all picks are written as one flat table.  The elements
    are not written: a reader of such a table holds the elements of thousands of pages at a time.
    """
    own = {name: list(fields(_el(0))) for name, (_, fields) in picks.items()}
    every = dict.fromkeys(n for names in own.values() for n in names)

    def shaped(name, keep, fields):
        def row(e, i):
            made = fields(e)
            return F.struct(F.lit(name).alias("_pick"), i.alias("no"), *[made.get(n, F.lit(None)).alias(n) for n in every])
        return F.transform(F.filter("elements", keep), row)

    rows = elements.select("page_id", "url", F.explode(F.concat(*[shaped(n, *p) for n, p in picks.items()])).alias("_e"))
    rows = written(rows.select("page_id", "url", "_e.*"))
    return {name: rows.filter(F.col("_pick") == name).select("page_id", "url", "no", *names) for name, names in own.items()}


LINKS = (_is_link, lambda e: {"href": F.trim(e["href"]), "text": text_of(e)})  # as links_of_elements gives them


def _context(e, limit: int) -> Column:
    parent = _el(e["parent"])

    def short(x):
        return F.when((x["chars"] > 0) & (x["chars"] < limit), text_of(x))
    return F.array_join(F.array(short(parent), short(_el(parent["parent"]))), " ")


def link_context(elements: DataFrame, limit: int = 500) -> DataFrame:
    """Every link with the short texts of its two enclosing elements."""
    links = _pick(elements, _is_link, lambda e: {
        "pos": e["pos"], "href": e["href"], "text": text_of(e), "context": _context(e, limit), "attrs": e["attrs"]})
    return links.withColumn("target", resolve("url", "href"))


def recover_js_links(links: DataFrame) -> DataFrame:
    """`javascript:` links get the URL their attributes hide; without one they are dropped."""
    def usable(v):
        return F.startswith(v, F.lit("/")) | F.startswith(v, F.lit("http"))

    found = F.lit(None).cast("string")
    click = F.regexp_extract(F.coalesce(F.try_element_at("attrs", F.lit("onclick")), F.lit("")), rules.JS_ONCLICK, 1)
    found = F.when(usable(click), click).otherwise(found)
    for name in reversed(rules.JS_URL_ATTRIBUTES):
        value = F.trim(F.try_element_at("attrs", F.lit(name)))
        found = F.when(F.coalesce(usable(value), F.lit(False)), value).otherwise(found)
    is_js = F.startswith(F.trim("href"), F.lit("javascript:"))
    real = F.when(is_js, found).otherwise(F.trim("href"))
    return (links.withColumn("href", real).filter(F.col("href").isNotNull())
            .withColumn("target", resolve("url", "href")).filter(is_http("target")))


def external_links(links: DataFrame, internal: bool = False) -> DataFrame:
    """Links with text that lead to another host; internal=True also keeps the own host."""
    kept = links.filter((F.col("href") != "") & (F.col("text") != "") & ~F.lower("href").rlike(_SKIPPED_LINK))
    kept = once(kept, target=resolve("url", "href"))
    return kept if internal else kept.filter(host("target") != host("url"))


def simple_company_links(links: DataFrame, blocklist=rules.LINK_BLOCKLIST, internal: bool = False) -> DataFrame:
    """Distinct (name, target, source) links of plausible name length to another host."""
    n = F.length("text")
    kept = links.filter((F.col("href") != "") & (n > 3) & (n < 100) & ~F.lower("text").isin(*blocklist))
    kept = once(kept, target=resolve("url", "href")).filter(is_http("target"))
    if not internal:
        kept = kept.filter(host("target") != host("url"))
    return kept.groupBy(F.col("text").alias("name"), "target").agg(F.min_by("url", F.struct("page_id", "no")).alias("source"))


def _short(c: Column, limit: int) -> Column:
    return F.left(c, F.lit(limit)) if limit else c


def _own_or(e, around) -> Column:
    """The text of an element, or where that is empty the text of one around it."""
    return F.when(e["chars"] > 0, text_of(e)).otherwise(text_of(around))


def table_candidates(elements: DataFrame, first_cell: bool = True, description_chars: int = None) -> DataFrame:
    """Links in table cells, named by their text or else by the cell's."""
    def keep(e):
        inside = _is_link(e) & e["cell"].isNotNull() & e["table"].isNotNull()
        return inside & (_el(e["cell"])["cell_no"] == 1) if first_cell else inside

    return _pick(elements, keep, lambda e: {
        "pos": e["pos"], "name": _own_or(e, _el(e["cell"])), "href": e["href"],
        "description": _short(text_of(_el(e["cell"])), description_chars)}).withColumns(
        {"target": resolve("url", "href"), "method": F.lit("table_extraction")})


def _cell_fields(e) -> dict:
    return {"pos": e["pos"], "name": text_of(e), "href": e["inner"],
            "header_named": any_word(F.lower(text_of(_el(e["table"]))), ("university", "institution", "college"))}


CELLS = (lambda e: e["tag"].isin("td", "th") & e["table"].isNotNull(), _cell_fields)


def cell_rows(cells: DataFrame) -> DataFrame:
    """Picked cells that read like an institution."""
    return (cells.filter(is_institution("name"))
            .withColumns({"target": resolve("url", "href"), "method": F.lit("table_extraction"),
                          "confidence": F.lit(0.8), "quality": table_quality("header_named")}))


def cell_names(elements: DataFrame) -> DataFrame:
    """Cells that read like an institution, with their first link if any."""
    return cell_rows(_pick(elements, *CELLS))


def list_candidates(elements: DataFrame, description_chars: int = None) -> DataFrame:
    """Links in list items, named by their text or else by the item's."""
    return _pick(elements, lambda e: _is_link(e) & e["li"].isNotNull(), lambda e: {
        "pos": e["pos"], "name": _own_or(e, _el(e["li"])), "href": e["href"],
        "description": _short(text_of(_el(e["li"])), description_chars)}).withColumns(
        {"target": resolve("url", "href"), "method": F.lit("list_extraction")})


def selector_links(selectors=rules.LINK_SELECTORS) -> tuple:
    """The pick of links below the given enclosing tags, with a word in a class and a word in the href."""
    def keep(e):
        ok = F.lit(False)
        for rule in selectors:
            below = F.array_contains(e["under"], selector_name(rule))
            ok = ok | (below & F.contains(e["href"], F.lit(rule[2])) if rule[2] else below)
        return _is_link(e) & ok & (e["chars"] > 0)

    return keep, lambda e: {"pos": e["pos"], "name": text_of(e), "href": e["href"]}


def selector_rows(links: DataFrame) -> DataFrame:
    """Picked links that read like an institution."""
    return (links.filter(is_institution("name"))
            .withColumns({"target": resolve("url", "href"), "method": F.lit("list_extraction"),
                          "confidence": F.lit(0.85), "quality": list_quality("name", "href")}))


def selector_candidates(elements: DataFrame, selectors=rules.LINK_SELECTORS) -> DataFrame:
    """Links below the given enclosing tags, with a word in a class and a word in the href.

    The reader notes on each element which selectors its enclosing tags fulfil, so the elements must
    come from page_elements with these selectors.
    """
    return selector_rows(_pick(elements, *selector_links(selectors)))


HEADINGS = (lambda e: e["tag"].rlike("^h[1-6]$") & (e["chars"] > 0),
            lambda e: {"pos": e["pos"], "name": text_of(e), "level": F.right(e["tag"], F.lit(1)).cast("int"), "href": F.coalesce(e["inner"], e["next"])})


def heading_rows(headings: DataFrame) -> DataFrame:
    return headings.withColumns({"target": resolve("url", "href"), "method": F.lit("heading_extraction"),
                                 "confidence": F.lit(0.7), "quality": heading_quality("level")})


def heading_candidates(elements: DataFrame) -> DataFrame:
    """Headings with the link inside, else the next link of the document."""
    return heading_rows(_pick(elements, *HEADINGS))


def emphasis_candidates(elements: DataFrame) -> DataFrame:
    """strong and b texts with the first link below their parent."""
    rows = _pick(elements, lambda e: e["tag"].isin("strong", "b") & (e["chars"] > 0), lambda e: {
        "pos": e["pos"], "name": text_of(e), "href": e["near"]})
    return rows.withColumns({"target": resolve("url", "href"), "method": F.lit("emphasis")})


# --------------------------------------------------------------- structured data

def jsonld_entries(pages: DataFrame) -> DataFrame:
    """One row per object of the JSON-LD scripts; invalid scripts give none."""
    bodies = F.regexp_extract_all(
        "html", F.lit(r"(?is)<script\b[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    scripts = pages.select("page_id", "url", F.posexplode(bodies).alias("script_no", "_body"))
    body = F.trim("_body")
    listed = F.when(F.startswith(body, F.lit("[")), body).otherwise(F.concat(F.lit("["), body, F.lit("]")))
    entries = F.try_parse_json(listed).cast("array<variant>")
    rows = scripts.select("page_id", "url", "script_no", F.posexplode(entries).alias("no", "_v"))

    def text(path):
        return F.try_variant_get("_v", path, "string")

    return rows.select(
        "page_id", "url", "script_no", "no", text('$["@type"]').alias("type"), text("$.name").alias("name"),
        text("$.url").alias("target"), text("$.description").alias("description"),
        text("$.address.addressLocality").alias("location"))


def jsonld_orgs(pages: DataFrame, types=rules.JSONLD_TYPES, need_url: bool = True) -> DataFrame:
    rows = jsonld_entries(pages).filter(F.col("type").isin(*types) & (F.col("name") != ""))
    if need_url:
        rows = rows.filter(F.col("target") != "")
    return rows.withColumn("method", F.lit("structured_data"))


def microdata_orgs(elements: DataFrame, types: str = rules.MICRODATA_TYPES) -> DataFrame:
    """itemscope blocks of the wanted types with their name and url properties."""
    rows = _pick(elements, lambda e: F.coalesce(F.try_element_at(e["attrs"], F.lit("itemtype")).rlike(types), F.lit(False)),
                 lambda e: {"pos": e["pos"], "name": text_of(_el(e["item_name"])), "target": F.coalesce(e["item_url"], F.lit(""))})
    return rows.filter(F.col("name") != "").withColumns({"method": F.lit("microdata"), "confidence": F.lit(0.9)})


# ------------------------------------------------------------------------- hosts


def is_institution_host(url, parts=rules.INSTITUTION_HOST_PARTS, host_words=rules.INSTITUTION_HOST_WORDS) -> Column:
    low = F.lower(F.col(url))
    return any_word(low, parts) | any_word(host(url), host_words)


def host_named_orgs(links: DataFrame, parts=rules.INSTITUTION_HOST_PARTS, host_words=rules.INSTITUTION_HOST_WORDS,
                    text_test=is_institution) -> DataFrame:
    """Names for links to institution hosts: from the text (0.85) and from the host (0.7)."""
    wanted = once(links, target=resolve("url", "href")).filter(is_institution_host("target", parts, host_words))
    by_text = F.struct(F.col("text").alias("name"), F.lit(0.85).alias("confidence"), F.lit("link_analysis").alias("method"))
    by_host = F.struct(host_label_name("target").alias("name"), F.lit(0.7).alias("confidence"), F.lit("url_analysis").alias("method"))
    both = F.array(F.when(text_test("text") & (F.col("text") != ""), by_text), F.when(host_label_name("target") != "", by_host))
    return (wanted.withColumn("_n", F.explode(F.array_compact(both)))
            .select("page_id", "url", "no", "target", "_n.*"))


def link_pattern_names(links: DataFrame) -> DataFrame:
    """Institution links named by their text, else by their host (0.75)."""
    from .classify import is_institution_link
    named = F.when(is_institution("text"), F.col("text")).otherwise(host_label_name("target"))
    return (links.withColumn("target", resolve("url", "href")).filter(is_institution_link("href", "text"))
            .withColumns({"name": named, "confidence": F.lit(0.75), "method": F.lit("link_pattern"),
                          "quality": link_quality("href", "text")}).filter(F.col("name") != ""))


# ---------------------------------------------------------------- names in text


def clean_item(c) -> Column:
    """Name out of a list item: rank, trailing text and article titles go (then empty)."""
    raw = stripped(c)
    name = raw
    for p in rules.ITEM_RANK_PREFIXES:
        name = F.regexp_replace(name, p, "")
    name = before_first_separator(name, rules.ITEM_SEPARATORS)
    name = stripped(F.regexp_replace(name, "(?iu)" + rules.ITEM_TAIL, ""))
    return F.when(any_pattern(F.lower(raw), rules.ITEM_REJECTS), F.lit("")).otherwise(name)


def _spell_out(w) -> Column:
    bare = F.regexp_replace(F.lower(w), r"[.,]+$", "")
    out = w
    for full, short in reversed(list(rules.NAME_ABBREVIATIONS.items())):
        out = F.when(bare.isin(*short), F.lit(full.title())).otherwise(out)
    return out


def clean_name(df: DataFrame, source: str, target: str) -> DataFrame:
    """Cleaned institution name; empty when the text is not one."""
    raw = stripped(source)
    name = raw
    for p in rules.NAME_RANK_PREFIXES:
        name = F.regexp_replace(name, p, "")
    df = once(once(df, _c=name, _raw=F.lower(raw)), _c=before_first_separator("_c", rules.NAME_SEPARATORS))
    tail = F.col("_c")
    for p in rules.NAME_TAILS:
        tail = F.regexp_replace(tail, "(?iu)" + p, "")
    df = once(df, _c=F.array_join(F.transform(words(tail), _spell_out), " "))
    n = F.length("_c")
    ok = (~any_pattern("_raw", rules.NAME_REJECTS) & (n >= 3) & (n <= 150)
          & any_word(F.lower("_c"), rules.STRONG_INDICATORS))
    return once(df, **{target: F.when(ok, F.col("_c")).otherwise(F.lit(""))}).drop("_c", "_raw")


# ------------------------------------------------------------- hits with offsets


def _plain_groups(patterns):
    """Capturing groups become plain ones, so patterns can be joined and their hits counted."""
    return [re.sub(r"(?<!\\)\((?!\?)", "(?:", p) for p in patterns]


def _beside(pieces: str, first: str, pad: int, left: bool) -> str:
    """Up to `pad` characters of the joined pieces next to a hit; a few pieces nearly always do."""
    def cut(k):
        if left:
            return f"right(array_join(slice({pieces}, greatest({first} - {k}, 1), least({first}, {k + 1})), ''), {pad})"
        return f"left(array_join(slice({pieces}, {first}, {k + 1}), ''), {pad})"
    return f"CASE WHEN length({cut(8)}) >= {pad} THEN {cut(8)} ELSE {cut(2 * pad)} END"


_RUN = 64  # hits whose lengths are added up one by one

# lengths of a gap and its hit; sums of whole runs; where each run begins; where a hit begins
_LENGTHS = "transform(_h, (h, i) -> CAST(length(get(_g, i)) + length(h) AS bigint))"
_RUN_SUMS = f"transform(sequence(0, size(_l) DIV {_RUN}), b -> aggregate(slice(_l, b * {_RUN} + 1, {_RUN}), 0L, (t, x) -> t + x))"
_RUN_STARTS = "aggregate(_l, named_struct('a', array(0L), 't', 0L), (r, x) -> named_struct('a', array_append(r.a, r.t + x), 't', r.t + x)).a"
_START = f"CASE WHEN _no = 0 THEN CAST(length(get(_g, 0)) AS bigint) ELSE get(_l_starts, _no DIV {_RUN}) + aggregate(slice(_l, (_no DIV {_RUN}) * {_RUN} + 1, _no % {_RUN}), 0L, (t, x) -> t + x) + length(get(_g, _no)) END"


_MARK = "\ufdd0"  # no character


def _mark(text: str) -> Column:
    """A mark that does not stand in the text."""
    return F.when(F.contains(F.col(text), F.lit(_MARK)), F.concat(F.lit(_MARK), F.hex(F.xxhash64(text)))).otherwise(F.lit(_MARK))


def _scan(docs: DataFrame, key: str, text: str, scans, pad: int = 0, offsets: bool = False) -> DataFrame:
    """Hits of scans (labels, pattern, group): key, labels, hit_no, hit, part and, with pad, before and after;
    with offsets, start_pos and end_pos counted from 0.

    Plain texts meet the patterns that can be written out for it by columns (functions/scan.py); all
    others, and other patterns, are searched row by row.
    """
    fast = [(i, written_out(p), g > 0) for i, (_, p, g) in enumerate(scans) if g < 2 and written_out(p) is not None]
    if not fast:
        return _scan_rows(docs, key, text, scans, pad, offsets)
    plain, other = docs.filter(is_plain(text)), docs.filter(~is_plain(text))
    known = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in scans[i][0].items()]) for i, _, _ in fast])
    labels = [F.get(known, F.col("_i"))[n].alias(n) for n in scans[0][0]]
    shown = ["hit_no", "hit", F.coalesce("part", "hit").alias("part"), *["start_pos", "end_pos"] * offsets, *["before", "after"] * bool(pad)]
    found = plain_hits(plain, key, text, [x[1:] for x in fast], pad).select(key, *labels, *shown)
    rest = [s for i, s in enumerate(scans) if i not in {x[0] for x in fast}]
    if rest:
        found = found.unionByName(_scan_rows(plain, key, text, rest, pad, offsets))
    return found.unionByName(_scan_rows(other, key, text, scans, pad, offsets))


def _tried(docs: DataFrame, key: str, text: str, scans):
    """Texts, and for each scan its number, the text cut into gaps and hits, and the parts of the hits where a group is wanted."""
    none = F.array().cast("array<string>")

    def tries(i, p, group):
        hit = may_hit("_text", "_low", p, F.col("_odd"))
        marked = F.split(F.regexp_replace("_text", F.lit(p), F.concat("_mark", F.lit("$0"), "_mark")), F.col("_mark"), -1)
        part = F.when(hit, F.regexp_extract_all("_text", F.lit(p), F.lit(group))) if group else F.lit(None).cast("array<string>")
        return F.struct(F.lit(i).alias("_i"), F.when(hit, marked).otherwise(none).alias("_p"), part.alias("_part"))
    tried = F.array(*[tries(i, p, g) for i, (_, p, g) in enumerate(scans)])
    return once(docs.select(key, F.col(text).alias("_text")), _low=F.lower("_text"), _odd=folded_away("_text"), _mark=_mark("_text")), tried


def _scan_rows(docs: DataFrame, key: str, text: str, scans, pad: int, offsets: bool) -> DataFrame:
    """The hits of _scan, row by row.

    Every text meets the fixed list of patterns inside its row, but only those patterns whose needed
    literals stand in it; the others cannot hit.  One search sets marks around the hits, and the text is
    cut there into the gaps between hits and the hits; what stands beside a hit is joined from its
    neighbouring pieces, so hits may be close and nothing is quadratic.
    """
    df, tried = _tried(docs, key, text, scans)
    known = F.array(*[F.struct(F.lit(i).alias("_i"), *[F.lit(v).alias(n) for n, v in labels.items()]) for i, (labels, _, _) in enumerate(scans)])
    df = df.select(key, F.inline(F.filter(tried, lambda x: F.size(x["_p"]) > 1)))
    df = once(df, _k=F.get(known, F.col("_i")), _h=F.filter("_p", lambda x, i: i % 2 == 1), _g=F.filter("_p", lambda x, i: i % 2 == 0))
    df = df.select(key, "_p", "_h", "_g", F.coalesce("_part", "_h").alias("_n"), *[F.col(f"_k.{n}") for n in scans[0][0]])
    fields = ["_no AS hit_no", "_hit AS hit", "get(_n, _no) AS part"]
    if offsets:
        starts = _RUN_STARTS.replace("aggregate(_l,", f"aggregate({_RUN_SUMS},", 1)
        df = df.select("*", F.expr(f"inline(transform(array(CASE WHEN size(_h) > 1 THEN {_LENGTHS} END), _l -> struct(_l AS _l, CASE WHEN coalesce(size(_l), 0) < {_RUN} THEN array(0L) ELSE {starts} END AS _l_starts)))"))
        fields += [f"{_START} AS start_pos", f"{_START} + length(_hit) AS end_pos"]
    if pad:
        fields += [f"CASE WHEN length(get(_g, _no)) >= {pad} THEN right(get(_g, _no), {pad}) ELSE {_beside('_p', '(_no * 2 + 1)', pad, True)} END AS before",
                   f"CASE WHEN length(get(_g, _no + 1)) >= {pad} THEN left(get(_g, _no + 1), {pad}) ELSE {_beside('_p', '(_no * 2 + 3)', pad, False)} END AS after"]
    # what is taken from the pieces is an expression of its own for each column, so columns that nobody reads are left out
    return df.select("*", F.posexplode("_h").alias("_no", "_hit")).select(key, *scans[0][0], *map(F.expr, fields))


def pattern_hits(docs: DataFrame, key: str, text: str, pattern: str, group: int = 0) -> DataFrame:
    """(key, hit_no, start_pos, hit, group text) for every match."""
    return _scan(docs, key, text, [({}, pattern, group)], offsets=True).select(key, "hit_no", "start_pos", "hit", "part")


def match_contexts(docs: DataFrame, key: str, text: str, patterns, pad: int, flags: str = "iu") -> DataFrame:
    """Every hit of the joined patterns with up to `pad` characters on both sides; contexts may overlap."""
    joined = f"(?{flags})" + "|".join(f"(?:{p})" for p in _plain_groups(patterns))
    rows = _scan(docs, key, text, [({}, joined, 0)], pad)
    return rows.select(key, "hit_no", "before", "hit", "after", F.concat("before", "hit", "after").alias("context"))


def _bare(named: Column) -> Column:
    """Words joined to a name, without marks."""
    return F.trim(F.regexp_replace(F.array_join(named, " "), r"(?U)[^\w\s\-&]", ""))


def _is_name(name: str) -> Column:
    return (F.length(name) > 5) & F.exists(words(name), lambda w: w.rlike(r"^\p{Lu}"))


def name_from_context(contexts: DataFrame, context: str = "context", hit: str = "hit", name: str = "name") -> DataFrame:
    """Three words before and four from the first place of the hit, without marks; null if it is no name."""
    contexts = once(contexts, **{context: F.col(context)})  # joined from its parts once, not for each look at it
    at = F.instr(F.col(context), F.col(hit))
    before = words(F.left(F.col(context), at - 1))
    after = words(F.substring(F.col(context), at, F.length(context)))
    last3 = F.slice(before, F.greatest(F.size(before) - 2, F.lit(1)), F.lit(3))
    return once(contexts, _name=_bare(F.concat(last3, F.slice(after, 1, 4)))).withColumn(name, F.when(_is_name("_name"), F.col("_name"))).drop("_name")


def typed_entities(contexts: DataFrame, countries=rules.CONTEXT_COUNTRIES, name: str = "name", description_chars: int = None) -> DataFrame:
    """Country, city, amount, deadline, kind, provider and description (whole, unless cut on demand) of a context."""
    low = F.col("_low")
    country = F.lit("")
    for c in reversed(list(countries)):
        country = F.when(has(low, c.lower()), F.lit(c)).otherwise(country)
    kind = F.lit("university")
    kind = F.when(any_word(low, ("state", "public", "national")), F.lit("public")).otherwise(kind)
    kind = F.when(has(low, "private"), F.lit("private")).otherwise(kind)
    kind = F.when(any_word(F.lower(name), ("technical", "institute of technology", "polytechnic")), F.lit("technical")).otherwise(kind)
    flat = collapse("context")
    contexts = once(contexts, _low=F.lower("context"), _lead=_bare(F.slice(words("context"), 1, 4)))  # the first four words as a name
    return contexts.withColumns({
        "country": country,
        "city": F.regexp_extract("context", rules.CITY_PATTERN, 1),
        "currency": F.regexp_extract("context", rules.AMOUNT_PATTERN, 1),
        "amount": F.regexp_extract("context", rules.AMOUNT_PATTERN, 2),
        "deadline": F.regexp_extract("context", rules.DEADLINE_PATTERN, 1),
        "kind": kind,
        "provider": F.coalesce(F.when(_is_name("_lead"), F.col("_lead")), F.lit("")),
        "description": flat if not description_chars else F.when(
            F.length(flat) > description_chars, F.concat(F.left(flat, F.lit(description_chars)), F.lit("..."))).otherwise(flat),
    }).drop("_low", "_lead")


def _entity_scans(patterns) -> list:
    scans = []
    for kind, confidence, listed in patterns:
        for no, p in enumerate(listed):
            plain = _plain_groups([p])[0]
            group = 1 if kind == "deadline" and plain != p else 0
            labels = {"kind": kind, "pattern_no": no, "confidence": float(confidence)}
            scans.append((labels, "(?iu)" + (p if group else plain), group))
    return scans


def entity_lists(docs: DataFrame, key: str, text: str, patterns=rules.ENTITY_PATTERNS) -> DataFrame:
    """Every text with the kinds and texts of all rows that extract_entities gives for it: key, entities.

    They stay with their text, so no key travels with each of them.
    """
    scans = _entity_scans(patterns)
    fast = [(written_out(p), g > 0) for _, p, g in scans]
    kinds = F.array(*[F.lit(labels["kind"]) for labels, _, _ in scans])
    rows, tried = _tried(docs.filter(~is_plain(text)) if all(p for p, _ in fast) else docs, key, text, scans)
    parts = F.flatten(F.transform(F.filter(tried, lambda x: F.size(x["_p"]) > 1), lambda x: F.transform(
        F.coalesce(x["_part"], F.filter(x["_p"], lambda h, i: i % 2 == 1)), lambda h: F.struct(F.get(kinds, x["_i"]).alias("kind"), h.alias("entity")))))
    listed = rows.select(key, F.coalesce(parts, F.array().cast("array<struct<kind:string,entity:string>>")).alias("entities"))
    if not all(p for p, _ in fast):
        return listed
    named = F.transform("_found", lambda x: F.struct(F.get(kinds, x["_i"]).alias("kind"), x["part"].alias("entity")))
    return plain_lists(docs.filter(is_plain(text)), key, text, fast).select(key, named.alias("entities")).unionByName(listed)


def extract_entities(docs: DataFrame, key: str, text: str, patterns=rules.ENTITY_PATTERNS, pad: int = 50) -> DataFrame:
    """Long rows (key, kind, entity, confidence, start, end, context) for every match of every pattern.

    Patterns of a kind may overlap, so each is a scan of its own; all scans share one read.
    """
    rows = _scan(docs, key, text, _entity_scans(patterns), pad, offsets=True)
    return rows.select(key, "kind", "pattern_no", "hit_no", F.col("part").alias("entity"), "confidence", "start_pos", "end_pos",
                       (F.concat("before", "hit", "after") if pad else F.col("hit")).alias("context"))


def pattern_names(docs: DataFrame, key: str, text: str, families=rules.NAME_PATTERN_FAMILIES, pad: int = 100,
                  context_words=rules.PATTERN_CONTEXT_WORDS, clean: bool = True) -> DataFrame:
    """Institution names by pattern family, cleaned, checked and scored."""
    scans = [({"family": family, "base": float(base)}, "(?iu)" + p, 0)
             for family, base, listed in families for p in _plain_groups(listed)]
    # row by row: the texts are often made from pages, and _scan looks at each of them twice
    rows = _scan_rows(docs, key, text, scans, pad, offsets=False).withColumn("context", F.concat("before", "hit", "after"))
    rows = clean_name(rows, "hit", "name") if clean else rows.withColumn("name", F.col("hit"))
    return (rows.filter(is_valid_name("name"))
            .withColumn("confidence", pattern_confidence("base", "hit", "context", context_words))
            .withColumn("method", F.concat(F.lit("pattern_"), F.col("family")))
            .select(key, "family", "name", "hit", "confidence", "method"))


def first_word_bits(gazetteer: DataFrame) -> Column:
    """The bits of the first words of all phrases, however long the gazetteer is."""
    return hash_bits(gazetteer, F.get(F.split("phrase", " "), F.lit(0)))


def gazetteer_entities(docs: DataFrame, key: str, text: str, gazetteer: DataFrame) -> DataFrame:
    """Names of a gazetteer(phrase, label) found in texts; phrases are lower case and of any number of words.

    The longest phrase that starts at a word wins; a shorter one that starts at a later word inside
    it is reported as well.  Every text is cut inside its row into phrases of the lengths that the
    gazetteer has, and joined on equality, so no text meets the whole gazetteer.
    """
    length = F.size(F.split("phrase", " "))
    lengths = gazetteer.agg(F.array_sort(F.collect_set(length)).alias("_lengths")).scalar()
    df = once(docs.select(key, F.col(text).alias("_x")), _t=F.filter(F.split(F.lower("_x"), r"[^\p{L}\p{N}]+"), lambda w: w != "")).drop("_x")
    df = df.withColumns({"_lengths": lengths, "_bits": first_word_bits(gazetteer)})

    places = F.when(F.size("_t") > 0, F.filter(F.sequence(F.lit(0), F.size("_t") - 1), lambda i: has_bit("_bits", F.get("_t", i)))).otherwise(F.array().cast("array<int>"))
    df = df.select(key, "_t", "_lengths", places.alias("_at")).where(F.size("_at") > 0)
    grams = df.select(key, F.expr("""inline(flatten(transform(_lengths, n -> transform(filter(_at, i -> i + n <= size(_t)),
        i -> struct(i AS word_no, n AS n, CASE WHEN n = 1 THEN get(_t, i) ELSE array_join(slice(_t, i + 1, n), ' ') END AS phrase)))))"""))
    longest = grams.join(gazetteer.select("phrase").distinct(), "phrase", "left_semi").groupBy(key, "word_no").agg(F.max(F.struct("n", "phrase")).alias("_m"))
    return longest.select(key, "word_no", "_m.*").join(gazetteer, "phrase").select(key, "word_no", "n", "phrase", "label")


def split_organisations(entities: DataFrame, indicators=rules.ENTITY_INDICATORS) -> DataFrame:
    """ORG entities become universities or other organisations."""
    kind = (F.when((F.col("label") == "ORG") & any_word(F.lower("phrase"), indicators), F.lit("university"))
            .when(F.col("label") == "ORG", F.lit("organization")).when(F.col("label") == "GPE", F.lit("location"))
            .when(F.col("label") == "PERSON", F.lit("person")).when(F.col("label") == "MONEY", F.lit("amount"))
            .when(F.col("label") == "DATE", F.lit("deadline")).otherwise(F.lower("label")))
    return entities.withColumn("kind", kind)


def keyword_entities(docs: DataFrame, key: str, text: str, keywords=rules.FALLBACK_KEYWORDS) -> DataFrame:
    """Keywords present in a text, as entities of confidence 0.5."""
    low = F.lower(text)
    found = F.array_compact(F.array(*[F.when(has(low, w), F.lit(w)) for w in keywords]))
    return docs.select(key, F.explode(found).alias("entity")).withColumns(
        {"kind": F.lit("university"), "confidence": F.lit(0.5)})


def entity_guided_orgs(elements: DataFrame, entities: DataFrame) -> DataFrame:
    """Organisations for entities(page_id, kind, entity) known for a page.

    A university is the first link that shows its name, a program needs its name on the page, a
    scholarship falls back to the page itself.
    """
    per_page = entities.groupBy("page_id").agg(F.collect_set(F.struct("kind", "entity")).alias("_ents"))
    page_words = F.lower(F.array_join(F.transform(F.filter("elements", lambda e: e["depth"] <= 2),
                                                  lambda e: F.coalesce(text_of(e), F.lit(""))), " "))
    links = F.transform(F.filter("elements", lambda e: _is_link(e) & (e["href"] != "") & ~F.startswith(e["href"], F.lit("javascript:"))),
                        lambda e: F.struct(e["href"].alias("href"), F.lower(text_of(e)).alias("text")))
    # what a page shows is much less than its elements, which stay where they were made
    shown = once(elements, _page=page_words, _links=links).drop("elements", "pieces")
    rows = shown.join(per_page.hint("merge"), "page_id").withColumn("_x", F.explode("_ents"))
    hit = F.get(F.filter("_links", lambda a: F.contains(a["text"], F.lower(F.trim("_x.entity")))), F.lit(0))["href"]
    rows = rows.withColumns({"kind": F.col("_x.kind"), "_name": F.trim("_x.entity"), "_href": hit})
    target = F.when(F.col("_href").isNotNull(), resolve("url", "_href"))
    kind = F.col("kind")
    keep = ((kind == "university") & is_http("_target") | (kind == "scholarship")
            | (kind == "program") & F.contains("_page", F.lower("_name")))
    return (once(rows, _target=target).filter(F.coalesce(keep, F.lit(False))).select(
        "page_id", F.col("url").alias("source_url"), kind.alias("org_type"),
        F.when(kind == "university", F.col("_name")).otherwise(F.concat(F.initcap("kind"), F.lit(": "), F.col("_name"))).alias("name"),
        F.when(kind == "program", F.col("url")).otherwise(F.coalesce("_target", "url")).alias("target"),
        F.when(kind == "university", 0.9).when(kind == "program", 0.7).otherwise(0.8).alias("confidence"),
        F.when(kind == "university", "ner_guided").when(kind == "program", "ner_program").otherwise("ner_scholarship").alias("method")))


# ------------------------------------------------------------------ list articles


def is_list_article(title) -> Column:
    return any_pattern(F.lower(F.col(title)), rules.LIST_ARTICLE_PATTERNS)


def list_article_orgs(content: DataFrame, elements: DataFrame, min_conf: float = 0.7) -> DataFrame:
    """Institutions in the headings, items and emphasised text of list articles; best per name."""
    from .ordering import keep_best
    from .score import academic_confidence
    titles = (content.filter((F.col("content_type") == "blog_post") & is_list_article("title"))
              .groupBy(F.col("url").alias("_page")).agg(F.min("title").alias("article")))
    pages = elements.join(titles, elements.url == titles["_page"]).drop("_page")
    is_head = lambda e: e["tag"].rlike("^h[1-6]$")
    is_item = lambda e: e["tag"] == "li"
    is_bold = lambda e: e["tag"].isin("strong", "b") & (e["chars"] > 0)
    shaped = F.transform(F.filter("elements", lambda e: is_head(e) | is_item(e) | is_bold(e)), lambda e: F.struct(
        e["pos"].alias("pos"), text_of(e).alias("raw"),
        F.when(is_head(e), "blog_content_heading").when(is_item(e), "blog_content_list").otherwise("blog_content_emphasis").alias("method"),
        F.when(is_bold(e), e["near"]).otherwise(e["inner"]).alias("href")))
    rows = pages.select("page_id", "url", "article", F.explode(shaped).alias("_e")).select("page_id", "url", "article", "_e.*")
    rows = rows.filter((F.col("method") != "blog_content_heading") | ~any_word(F.lower("raw"), rules.ARTICLE_HEADING_REJECTS))
    rows = once(rows, name=F.when(F.col("method") == "blog_content_list", clean_item("raw")).otherwise(F.col("raw")))
    rows = rows.filter(is_institution_strict("raw") & is_institution_strict("name"))
    rows = rows.withColumn("target", F.when(F.col("href").isNotNull(), resolve("url", "href")).otherwise(F.lit("")))
    rows = academic_confidence(rows, "name", "target", "confidence").filter(F.col("confidence") >= min_conf)
    order = F.when(F.col("method") == "blog_content_heading", 0).when(F.col("method") == "blog_content_list", 1).otherwise(2)
    rows = rows.withColumn("_order", order).withColumn("_key", F.lower(F.trim("name")))
    return keep_best(rows, ["page_id", "_key"], "confidence", ["_order", "pos"]).drop("_order", "_key")


# ------------------------------------------------------------------------- JSON


def _read_fields(value: Column, kind: T.StructType, path: str, defaults: dict) -> Column:
    """The fields of a variant as a struct; a field that is missing, null or of another type has its default."""
    fields = []
    for f in kind.fields:
        here, default = f'{path}["{f.name}"]', defaults.get(f.name)
        if isinstance(f.dataType, T.StructType):
            fields.append(_read_fields(value, f.dataType, here, default or {}).alias(f.name))
            continue
        told = F.try_variant_get(value, here, f.dataType.simpleString())
        if default is not None:
            filled = F.array(*[F.lit(x) for x in default]) if isinstance(default, (list, tuple)) else F.lit(default)
            told = F.coalesce(told, filled.cast(f.dataType))
        fields.append(told.alias(f.name))
    return F.struct(*fields)


def salvage_json(df: DataFrame, text: str, schema=None, defaults: dict = None) -> DataFrame:
    """The JSON object inside free text, from the first { to the last }: `json` (variant) or an error label.

    With a schema (a StructType or its DDL), `record` has its fields, nested ones too; `defaults` name
    the values for fields that are missing, null or of another type, also where there is no object.
    """
    block = salvage_block(text)
    value = F.try_parse_json(F.col("_block"))
    rows = (df.withColumn("_block", block).withColumn("json", value)
            .withColumn("json_error", F.when(F.col("_block").isNull(), F.lit("No JSON content found"))
                        .when(F.col("json").isNull(), F.lit("Invalid JSON format")))
            .drop("_block"))
    if schema is None:
        return rows
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return rows.withColumn("record", _read_fields(F.col("json"), kind, "$", defaults or {}))


# ------------------------------------------------------------- extractors by method

#: method -> (input, extractor): the input is "elements" (page_elements), "links" (flat_links) or "pages".
EXTRACTORS = {
    "structured_data": ("pages", jsonld_orgs),
    "link_analysis": ("links", external_links),
    "table_extraction": ("elements", table_candidates),
    "list_extraction": ("elements", list_candidates),
    "selector": ("elements", selector_candidates),
    "heading_extraction": ("elements", heading_candidates),
    "emphasis": ("elements", emphasis_candidates),
    "microdata": ("elements", microdata_orgs),
    "host_names": ("links", host_named_orgs),
    "link_pattern": ("links", link_pattern_names),
}


def extract_by_method(pages: DataFrame, method: str, elements: DataFrame = None) -> DataFrame:
    """Candidates of one method from stored pages; parsed elements can be passed on to several methods."""
    kind, extractor = EXTRACTORS[method]
    if kind == "pages":
        return pages.transform(extractor)
    if kind == "links":
        return (links_of_elements(elements) if elements is not None else flat_links(pages)).transform(extractor)
    return (elements if elements is not None else page_elements(pages)).transform(extractor)


def page_names(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """X-14 over the text of stored pages."""
    return pattern_names(pages.select(key, page_text("html").alias("text")), key, "text")
