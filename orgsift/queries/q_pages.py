"""Queries over stored pages: the given `pages`, and catalog pages built from `part`."""

import uuid

from pyspark.sql import functions as F

from .. import rules
from ..functions.url import host
from ..operators import classify as C
from ..operators import crawlplan as P
from ..operators import extract as X
from ..operators import html as H
from ..operators import score as S
from ..plans import jobs as J
from ..session import dealt, shared_folder
from ..sources.tables import flatten_for_csv, read_pages, read_search_results, write_outputs
from .derived import CATALOG_SQL, NAMES_SQL, ODD_SQL, RESULTS_SQL, catalog_pages, institution_names, odd_pages, search_results
from .registry import (lit, query, s_any, s_cap_words, s_caps, s_collapse, s_count, s_home, s_host, s_ladder, s_pattern,
                       s_strip_blocks, s_unescape, s_untag, s_words, table)

A_TAG = r"(?is)(<a\b[^>]*>.*?</a>)"
HREF = r"""(?is)^<a\b[^>]*?\shref\s*=\s*["']([^"']*)["']"""
LINKS_SQL = f"""tags AS (SELECT page_id, url, regexp_extract_all(html, {lit(A_TAG)}, 1) AS l FROM pages),
flat AS (SELECT page_id, url, unnest(range(len(l)))::BIGINT AS no, unnest(l) AS tag FROM tags),
links AS (SELECT page_id, url, no, trim({s_unescape(f"regexp_extract(tag, {lit(HREF)}, 1)")}) AS href,
  {s_collapse(s_untag('tag'))} AS text, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) ||
  trim({s_unescape(f"regexp_extract(tag, {lit(HREF)}, 1)")}) AS target FROM flat)"""
TITLE_SQL = s_collapse(s_unescape("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))


def pages_of(spark, sf):
    return dealt(read_pages(spark, f"{sf}/pages.parquet"))


def titled(spark, sf):
    return pages_of(spark, sf).select("page_id", "url", H.title_of("html").alias("title"), H.page_text("html").alias("abstract"))


def links_of(spark, sf):
    return X.external_links(H.flat_links(pages_of(spark, sf)), internal=True)


@query("s2_read_pages", "SELECT page_id, url, length(html)::BIGINT AS html_chars FROM pages")
def _(spark, sf):
    return pages_of(spark, sf).select("page_id", "url", F.length("html").alias("html_chars"))


_BARE = "regexp_replace(html, '(?is)<(script|style)\\b([^>]*)>.*?</(?:script|style)>', '<\\1\\2>', 'g')"


@query("x1_page_elements", f"""SELECT page_id, tag, count(*)::BIGINT AS n FROM (SELECT page_id,
  unnest(regexp_extract_all({_BARE}, '<([a-z][a-z0-9]*)[\\s>/]', 1)) AS tag FROM pages) GROUP BY 1, 2""")
def _(spark, sf):
    return H.tag_counts(pages_of(spark, sf))


_KEPT = s_strip_blocks("html", H.STRIPPED_TAGS_AND_HEADER)
_AREA = """coalesce(nullif(regexp_extract(kept, '(?is)<main\\b[^>]*>(.*?)</main>', 1), ''),
  nullif(regexp_extract(kept, '(?is)<article\\b[^>]*>(.*?)</article>', 1), ''),
  nullif(regexp_extract(kept, '(?is)<div\\b[^>]*class="[^"]*(?:content|main)[^"]*"[^>]*>(.*?)</div>', 1), ''), kept)"""


MAIN_SQL = f"""main AS (SELECT page_id, url, title, {s_collapse(s_untag('area'))} AS main_text FROM (SELECT page_id, url, title, {_AREA} AS area
  FROM (SELECT page_id, url, {TITLE_SQL} AS title, {_KEPT} AS kept FROM pages)))"""


@query("x2_main_text", f"""WITH {MAIN_SQL} SELECT page_id, url, length(main_text)::BIGINT AS chars, md5(main_text) AS digest FROM main""")
def _(spark, sf):
    return H.main_text(pages_of(spark, sf)).select("page_id", "url", F.length("main_text").alias("chars"), F.md5("main_text").alias("digest"))


@query("x3_page_meta", f"SELECT page_id, {TITLE_SQL} AS title, '' AS description, 0::BIGINT AS metas FROM pages")
def _(spark, sf):
    return H.page_meta(pages_of(spark, sf)).select("page_id", "title", "description", F.size("meta").alias("metas"))


@query("x3_catalog_meta", f"""WITH {CATALOG_SQL} SELECT DISTINCT page_id, 'Best Universities Catalog ' || page_id AS title,
  'Institutions of block ' || page_id AS description, 1::BIGINT AS metas FROM parts""")
def _(spark, sf):
    return H.page_meta(catalog_pages(spark, sf)).select("page_id", "title", "description", F.size("meta").alias("metas"))


@query("x4_links", f"WITH {LINKS_SQL} SELECT page_id, no, href, text, target FROM links WHERE href <> '' AND text <> ''")
def _(spark, sf):
    return links_of(spark, sf).select("page_id", "no", "href", "text", "target")


@query("x4_external_links", f"""WITH {CATALOG_SQL} SELECT page_id, 'https://u' || k || '.example.edu/university/' AS target, name || ' University' AS text
  FROM parts WHERE size % 5 <> 0 UNION ALL SELECT page_id, 'https://a' || k || '.example.org/', 'site' FROM parts
  UNION ALL SELECT page_id, 'javascript:void(0)', name || ' School' FROM parts""")
def _(spark, sf):
    return X.external_links(H.flat_links(catalog_pages(spark, sf))).select("page_id", "target", "text")


@query("x4_odd_links", f"WITH {ODD_SQL} SELECT page_id, no, href, text, target FROM odd WHERE href <> '' AND text <> ''")
def _(spark, sf):
    return X.external_links(H.flat_links(odd_pages(spark, sf)), internal=True).select("page_id", "no", "href", "text", "target")


@query("x4_odd_links_of_elements", f"WITH {ODD_SQL} SELECT page_id, no, href, text FROM odd")
def _(spark, sf):
    return H.links_of_elements(H.page_elements(odd_pages(spark, sf))).select("page_id", "no", "href", "text")


@query("x5_odd_companies", f"""WITH {ODD_SQL} SELECT text AS name, target, arg_min(url, (page_id, no)) AS source FROM odd WHERE href <> '' AND length(text) > 3 AND length(text) < 100
  AND target NOT LIKE '%/unq%' GROUP BY 1, 2""")
def _(spark, sf):
    return J.simple_companies(odd_pages(spark, sf))


@query("x23_odd_hosts", f"""WITH {ODD_SQL} SELECT page_id, target, text AS name, 0.85::DOUBLE AS confidence, 'link_analysis' AS method FROM odd WHERE no = 1""")
def _(spark, sf):
    found = X.host_named_orgs(H.flat_links(odd_pages(spark, sf)), text_test=lambda c: F.col(c) != "")
    return found.filter("method = 'link_analysis'").select("page_id", "target", "name", "confidence", "method")


@query("x25_odd_frontier", f"WITH {ODD_SQL} SELECT target AS url, 5::BIGINT AS priority FROM odd WHERE href <> '' AND text IN ('FooBar', 'open')")
def _(spark, sf):
    return P.frontier_candidates(X.external_links(H.flat_links(odd_pages(spark, sf)), internal=True), ("foobar", "open"))


_BLOCK = ("from", "with", "nicht", "pour")


@query("x5_simple_companies", f"""WITH {LINKS_SQL} SELECT text AS name, target, arg_min(url, (page_id, no)) AS source FROM links
  WHERE href <> '' AND length(text) > 3 AND length(text) < 100 AND lower(text) NOT IN ({', '.join(map(lit, _BLOCK))}) GROUP BY 1, 2""")
def _(spark, sf):
    return J.simple_companies(pages_of(spark, sf), blocklist=_BLOCK, internal=True)


@query("x6_js_links", f"""WITH {CATALOG_SQL} SELECT page_id, name || ' School' AS text, 'https://catalog' || page_id || '.example.com/js/' || k AS target FROM parts""")
def _(spark, sf):
    links = X.link_context(H.page_elements(catalog_pages(spark, sf))).filter("href like 'javascript:%'")
    return X.recover_js_links(links).select("page_id", "text", "target")


@query("x7_table_links", f"""WITH {CATALOG_SQL} SELECT page_id, name || ' University' AS name, 'https://catalog' || page_id || '.example.com/part/' || k AS target,
  name || ' University' AS description FROM parts""")
def _(spark, sf):
    return X.table_candidates(H.page_elements(catalog_pages(spark, sf))).select("page_id", "name", "target", "description")


@query("x7_table_cells", f"""WITH {CATALOG_SQL} SELECT page_id, name || ' University' AS name, 'https://catalog' || page_id || '.example.com/part/' || k AS target,
  0.8::DOUBLE AS quality FROM parts UNION ALL SELECT DISTINCT page_id, 'University', NULL, 0.8 FROM parts""")
def _(spark, sf):
    return X.cell_names(H.page_elements(catalog_pages(spark, sf))).select("page_id", "name", "target", "quality")


@query("x8_list_links", f"WITH {LINKS_SQL} SELECT page_id, text AS name, target FROM links")
def _(spark, sf):
    return X.list_candidates(H.page_elements(pages_of(spark, sf))).select("page_id", "name", "target")


_ITEM_SQL = """SELECT page_id, k, CASE WHEN size % 5 = 0 THEN name || ' College' ELSE name || ' University' END AS name,
  CASE WHEN size % 5 = 0 THEN 'https://c' || k || '.example.com/' ELSE 'https://u' || k || '.example.edu/university/' END AS target, size FROM parts"""


@query("x8_catalog_list", f"WITH {CATALOG_SQL} SELECT page_id, name, target FROM ({_ITEM_SQL})")
def _(spark, sf):
    return X.list_candidates(H.page_elements(catalog_pages(spark, sf))).select("page_id", "name", "target")


@query("x9_selector_links", f"""WITH {CATALOG_SQL} SELECT page_id, name, target, 1.0::DOUBLE AS quality FROM ({_ITEM_SQL}) WHERE size % 5 <> 0""")
def _(spark, sf):
    return X.selector_candidates(H.page_elements(catalog_pages(spark, sf))).select("page_id", "name", "target", "quality")


@query("x10_headings", f"""WITH {CATALOG_SQL} SELECT page_id, name || ' College' AS name, 'https://catalog' || page_id || '.example.com/list/index.html?col=' || k AS target,
  0.7::DOUBLE AS quality FROM parts""")
def _(spark, sf):
    return X.heading_candidates(H.page_elements(catalog_pages(spark, sf))).select("page_id", "name", "target", "quality")


@query("x11_emphasis", f"""WITH {CATALOG_SQL} SELECT page_id, name || ' Institute of Technology' AS name, 'https://catalog' || page_id || '.example.com/inst/' || k AS target FROM parts""")
def _(spark, sf):
    return X.emphasis_candidates(H.page_elements(catalog_pages(spark, sf))).select("page_id", "name", "target")


@query("x12_jsonld", f"""WITH {CATALOG_SQL} SELECT page_id, name || ' Polytechnic University' AS name, 'https://p' || k || '.example.edu' AS target, 'd' || k AS description
  FROM parts WHERE size % 7 <> 0""")
def _(spark, sf):
    return X.jsonld_orgs(catalog_pages(spark, sf)).select("page_id", "name", "target", "description")


@query("x13_microdata", f"""WITH {CATALOG_SQL} SELECT page_id, name || ' Academy' AS name, 'https://a' || k || '.example.org/' AS target, 0.9::DOUBLE AS confidence FROM parts""")
def _(spark, sf):
    return X.microdata_orgs(H.page_elements(catalog_pages(spark, sf))).select("page_id", "name", "target", "confidence")


@query("x21_entity_guided", f"""WITH {CATALOG_SQL}, ents AS (SELECT DISTINCT page_id, url, name FROM parts)
  SELECT page_id, name AS name, 'university' AS org_type, 'https://catalog' || page_id || '.example.com/part/' || first_k AS target, 0.9::DOUBLE AS confidence
    FROM (SELECT e.page_id, e.name, min(p.k) AS first_k FROM ents e JOIN parts p ON p.page_id = e.page_id AND contains(lower(p.name), lower(e.name)) GROUP BY 1, 2)
  UNION ALL SELECT page_id, 'Program: ' || name || ' School', 'program', url, 0.7 FROM ents
  UNION ALL SELECT page_id, 'Scholarship: ' || name || ' Grant', 'scholarship', url, 0.8 FROM ents""")
def _(spark, sf):
    pages = catalog_pages(spark, sf)
    from .derived import catalog_rows
    rows = catalog_rows(spark, sf)
    kinds = F.explode(F.array(F.struct(F.lit("university").alias("kind"), F.col("name").alias("entity")),
                              F.struct(F.lit("program").alias("kind"), F.concat("name", F.lit(" School")).alias("entity")),
                              F.struct(F.lit("scholarship").alias("kind"), F.concat("name", F.lit(" Grant")).alias("entity"))))
    ents = rows.select("page_id", kinds.alias("_e")).select("page_id", "_e.*").distinct()
    return X.entity_guided_orgs(H.page_elements(pages), ents).select("page_id", "name", "org_type", "target", "confidence")


# the parent and its parent, as far as their texts are shorter than 500 characters
@query("x22_link_context", f"""WITH {CATALOG_SQL}, body AS (SELECT page_id, string_agg(CASE WHEN size % 5 = 0 THEN name || ' College.' ELSE name || ' Universityin town.' END, '' ORDER BY k) AS items FROM parts GROUP BY 1),
  l AS (SELECT page_id, k, '/part/' || k AS href, name || ' University' AS text, [name || ' University', name || ' University' || brand || '.'] AS up FROM parts
  UNION ALL SELECT page_id, k, 'https://c' || k || '.example.com/', '', [name || ' College', items] FROM parts JOIN body USING (page_id) WHERE size % 5 = 0
  UNION ALL SELECT page_id, k, 'https://u' || k || '.example.edu/university/', name || ' University', [name || ' Universityin town', items] FROM parts JOIN body USING (page_id) WHERE size % 5 <> 0
  UNION ALL SELECT page_id, k, '../inst/' || k, 'go', [name || ' Institute of Technologygo', NULL] FROM parts
  UNION ALL SELECT page_id, k, 'https://a' || k || '.example.org/', 'site', [name || ' Academysite', NULL] FROM parts
  UNION ALL SELECT page_id, k, 'javascript:void(0)', name || ' School', [name || ' School', NULL] FROM parts
  UNION ALL SELECT page_id, k, '?col=' || k, 'more research', ['seemore research', NULL] FROM parts)
  SELECT page_id, href, text, array_to_string(list_filter(up, lambda t: t IS NOT NULL AND length(t) > 0 AND length(t) < 500), ' ') AS context FROM l""")
def _(spark, sf):
    return X.link_context(H.page_elements(catalog_pages(spark, sf))).select("page_id", "href", "text", "context")


_HOSTED = f"""SELECT page_id, 'https://u' || k || '.example.edu/university/' AS target, name || ' University' AS name, 0.85::DOUBLE AS confidence,
  'link_analysis' AS method FROM parts WHERE size % 5 <> 0"""


@query("x23_host_names", f"WITH {CATALOG_SQL} {_HOSTED}")
def _(spark, sf):
    links = X.external_links(H.flat_links(catalog_pages(spark, sf)))
    return X.host_named_orgs(links.drop("target")).select("page_id", "target", "name", "confidence", "method")


@query("x23_host_labels", f"""WITH l AS (SELECT page_id, regexp_extract(regexp_replace(regexp_replace({s_host('url')}, '^www\\.', ''), '^m\\.', ''), '^([^.]*)\\.', 1) AS label FROM pages)
  SELECT page_id, CASE WHEN regexp_matches(label, '^\\p{{L}}{{3,}}$') THEN upper(label[1]) || label[2:] || ' University' ELSE '' END AS name FROM l""")
def _(spark, sf):
    from ..functions.url import host_label_name
    return pages_of(spark, sf).select("page_id", host_label_name("url").alias("name"))


@query("x24_list_articles", f"""WITH {CATALOG_SQL}, c AS (
   SELECT page_id, name || ' College' AS name, 'https://catalog' || page_id || '.example.com/list/index.html?col=' || k AS target, 'blog_content_heading' AS method, 0 AS o, k,
     0.0 AS conf FROM parts WHERE false
   UNION ALL SELECT page_id, name || ' College', 'https://c' || k || '.example.com/', 'blog_content_list', 1, k, 0.8 FROM parts WHERE size % 5 = 0
   UNION ALL SELECT page_id, name || ' College', '', 'blog_content_heading', 0, k, 0.8 FROM parts
   UNION ALL SELECT page_id, name || ' Institute of Technology', 'https://catalog' || page_id || '.example.com/inst/' || k, 'blog_content_emphasis', 2, k, 0.8 FROM parts)
  SELECT page_id, name, arg_min(target, (o, k)) AS target, arg_min(method, (o, k)) AS method, max(conf)::DOUBLE AS confidence, 'Best Universities Catalog ' || page_id AS article
  FROM c GROUP BY page_id, name""")
def _(spark, sf):
    pages = catalog_pages(spark, sf)
    content = C.classify_content(pages.select("url", H.title_of("html").alias("title")), "title")
    return X.list_article_orgs(content, H.page_elements(pages)).select("page_id", "name", "target", "method", "confidence", "article")


_FRONT = ("der", "the", "de", "und")


def _crawlable_sql(x, ext=rules.SKIPPED_EXTENSIONS, social=rules.SOCIAL_HOSTS):
    ends = " OR ".join(f"ends_with(lower({x}), {lit(e)})" for e in ext)
    return f"({s_host(x)} <> '' AND NOT ({ends}) AND NOT {s_any(s_host(x), social)})"


@query("x25_frontier", f"WITH {LINKS_SQL} SELECT target AS url, 5::BIGINT AS priority FROM links WHERE href <> '' AND text <> '' AND {s_any('lower(text)', _FRONT)} AND {_crawlable_sql('target')}")
def _(spark, sf):
    return P.frontier_candidates(links_of(spark, sf), _FRONT)


_EXT, _SOC = (".html", "/"), ("blog.", "www.th")


@query("f13_crawlable", f"""SELECT page_id, {s_host('url')} <> '' AND NOT ({' OR '.join(f"ends_with(lower(url), {lit(e)})" for e in _EXT)})
  AND NOT {s_any(s_host('url'), _SOC)} AS crawlable FROM pages""")
def _(spark, sf):
    return pages_of(spark, sf).select("page_id", C.is_crawlable("url", _EXT, _SOC).alias("crawlable"))


_AU, _AT = (r"\.org/", r"/fr/\d+$"), (r"(^|[^a-z])the[^a-z]", r"nicht")


@query("f14_academic", f"""SELECT page_id, {s_pattern('lower(url)', _AU)} OR {s_pattern(f"(lower(url) || ' ' || lower({TITLE_SQL}))", _AT)} AS academic FROM pages""")
def _(spark, sf):
    return titled(spark, sf).select("page_id", C.is_academic("url", "title", _AU, _AT).alias("academic"))


_KW, _HP, _CTX = ("the", "tion", "blog", "er"), (".org", ".net"), ("of", "de ")


@query("c4_crawl_confidence", f"""SELECT page_id, round(least(1.0, {s_count('t', _KW)} * 0.3 + {s_count('lower(url)', _KW)} * 0.2
  + CASE WHEN {s_any('lower(url)', _HP)} THEN 0.4 ELSE 0.0 END + CASE WHEN len({s_words('title')}) >= 2 AND {s_caps('title')} >= 2 THEN 0.2 ELSE 0.0 END
  + CASE WHEN {s_any('t', _CTX)} THEN 0.1 ELSE 0.0 END)::DOUBLE, 6) AS confidence FROM (SELECT page_id, url, {TITLE_SQL} AS title, lower({TITLE_SQL}) AS t FROM pages)""")
def _(spark, sf):
    return titled(spark, sf).select("page_id", S.crawl_confidence("title", "url", _KW, _HP, _CTX).alias("confidence"))


_TIERS = (("government", 1.0, (".org",)), ("official_org", 0.9, ("blog.ti",)), ("ranking_site", 0.8, ("www.th",)))
_LISTS = (("directory", 0.7, ("m.th", "/fr/")), ("database", 0.6, ("ththre", "/fr/1", "/de/")))
_CONT = (("university_list", 0.8, (r"the\s+of", r"of\s+the")), ("directory", 0.7, (r"der\s+die",)), ("official", 0.9, (r"de\s+la", r"que\s+de")))
_SKW, _SPW, _SLW = ("the", "nicht", "la ", "and"), ("blog", "www", "utm", "page"), ("/en/", "/fr/", "feed")
_TEXT = s_strip_blocks("html", H.STRIPPED_TAGS)


def _tier_sql(base, tiers, lists, contents, words, path_words, list_words):
    listed = "greatest(" + ", ".join(f"CASE WHEN {s_any('u', p)} THEN {v} ELSE 0.0 END" for _, v, p in lists) + ")"
    listed_type = "CASE " + " ".join(f"WHEN {s_any('u', p)} THEN {lit(t)}" for t, _, p in reversed(lists)) + " ELSE 'general' END"
    host_score = "CASE " + " ".join(f"WHEN {s_any('u', p)} THEN {v}" for _, v, p in tiers) + f" ELSE {listed} END"
    host_type = "CASE " + " ".join(f"WHEN {s_any('u', p)} THEN {lit(t)}" for t, _, p in tiers) + f" ELSE {listed_type} END"
    cont = "greatest(" + ", ".join(f"CASE WHEN {s_pattern('x', p, '')} THEN {v} ELSE 0.0 END" for _, v, p in contents) + ")"
    cont_type = "CASE " + " ".join(f"WHEN {s_pattern('x', p, '')} THEN {lit(t)}" for t, _, p in reversed(contents)) + " ELSE 'general' END"
    return f"""WITH {base},
  s AS (SELECT page_id, url, ({host_score})::DOUBLE AS hs, {host_type} AS ht, ({cont})::DOUBLE + least({s_count('x', words)} * 0.1, 0.3)::DOUBLE AS cs, {cont_type} AS ct,
    least({s_count('u', path_words)} * 0.1 + {s_count('u', list_words)} * 0.05, 0.5)::DOUBLE AS us FROM b)
  SELECT page_id, url, round(hs + cs + us, 6) AS score, CASE WHEN ct <> 'general' THEN ct ELSE ht END AS source_type FROM s"""


_PAGE_BASE = f"b AS (SELECT page_id, url, lower(url) AS u, lower({TITLE_SQL} || ' ' || {s_collapse(s_untag(_TEXT))}) AS x FROM pages)"


@query("c11_source_scores", _tier_sql(_PAGE_BASE, _TIERS, _LISTS, _CONT, _SKW, _SPW, _SLW))
def _(spark, sf):
    return S.score_sources(titled(spark, sf), _TIERS, _LISTS, _CONT, _SKW, _SPW, _SLW).select("page_id", "url", "score", "source_type")


_IND = (("english", ("the ", " of ", " and ", " is ")), ("french", (" le ", " la ", " les ", " que")), ("german", (" der ", " die ", " und ")),
        ("spanish", (" el ", " la ", " los ", " de ")))
_NON = ("###", "%%%", "$$$", "&&&")
_AH, _RH, _TW, _AB, _CO = (".org", ".uni-"), ("blog", "tion"), ("the", "der"), ("that", "von"), ("with", "pour")


def _verdict_sql(source, ind=_IND, non=_NON, ah=_AH, rh=_RH, tw=_TW, ab=_AB, co=_CO):
    scores = ", ".join(f"{s_count('t', w)} AS s_{k}" for k, w in ind)
    top = "greatest(" + ", ".join(f"s_{k}" for k, _ in ind) + ")"
    best = "CASE " + " ".join(f"WHEN s_{k} = top THEN '{k}'" for k, _ in ind) + " END"
    return f"""v0 AS (SELECT page_id, url, title, {s_host('url')} AS h, lower(title || ' ' || '' || ' ' || main_text) AS t FROM {source}),
  v1 AS (SELECT *, {s_count('t', non)} AS non, {scores}, (CASE WHEN {s_any('h', ah)} THEN 2.0 ELSE 0.0 END + CASE WHEN {s_any('h', rh)} THEN 1.0 ELSE 0.0 END
    + CASE WHEN {s_any('lower(title)', tw)} THEN 1.0 ELSE 0.0 END + CASE WHEN {s_any('t', ab)} THEN 1.0 ELSE 0.0 END + CASE WHEN {s_any('t', co)} THEN 0.5 ELSE 0.0 END)::DOUBLE AS bonus FROM v0),
  v2 AS (SELECT *, {top} AS top FROM v1),
  v3 AS (SELECT *, CASE WHEN {s_any('h', ah)} THEN 'university' ELSE {best} END AS kind, top + bonus AS score FROM v2),
  verdicts AS (SELECT page_id, url, title, non < 2 AND score >= 2 AS is_organization, CASE WHEN non >= 2 THEN 0.1 ELSE least(score / 5.0, 1.0) END::DOUBLE AS validation_score,
    CASE WHEN non < 2 AND score >= 2 THEN kind ELSE 'non_organization' END AS organization_type,
    CASE WHEN non >= 2 THEN 'Contains ' || non || ' non-organization indicators'
      ELSE printf('Score: %.1f, indicators for %s: %d, bonus: %.1f', score, kind, top, bonus) END AS reason FROM v3)"""


def judged(pages):
    texts = H.main_text(pages.withColumn("title", H.title_of("html"))).select("page_id", "url", "title", F.lit("").alias("description"), "main_text")
    return C.validate_homepages(texts, _IND, _NON, _AH, _RH, _TW, _AB, _CO)


@query("f8_homepage_verdicts", f"WITH {MAIN_SQL}, {_verdict_sql('main')} SELECT page_id, is_organization, validation_score, organization_type, reason FROM verdicts")
def _(spark, sf):
    return judged(pages_of(spark, sf)).select("page_id", "is_organization", "validation_score", "organization_type", "reason")


# organisations are the links of the pages; the first page of a site stands for its homepage
_HOME_SQL = f"""{LINKS_SQL}, {MAIN_SQL}, homes AS (SELECT arg_min(page_id, page_id) AS page_id, {s_home('url')} AS url, arg_min(title, page_id) AS title,
   arg_min(main_text, page_id) AS main_text FROM main GROUP BY {s_home('url')}), {_verdict_sql('homes')},
  joined AS (SELECT l.page_id, l.no, l.text AS name, {s_home('l.target')} AS homepage_url, v.* EXCLUDE (page_id, url) FROM links l JOIN verdicts v ON v.url = {s_home('l.target')}
   WHERE l.href <> '' AND l.text <> '')"""


def _joined(spark, sf):
    pages = pages_of(spark, sf)
    homes = pages.groupBy(C.homepage("url").alias("url")).agg(F.min_by(F.struct("page_id", "html"), "page_id").alias("_p")).select("url", "_p.*")
    orgs = X.external_links(H.flat_links(pages), internal=True).select(
        "page_id", "no", F.col("text").alias("name"), F.col("target").alias("url"), F.lit(0.4).alias("confidence"), F.lit("link").alias("description"),
        F.lit("organization").alias("org_type"))
    return C.attach_verdicts(orgs, judged(homes))


@query("f9_validated", f"""WITH {_HOME_SQL} SELECT page_id, no, CASE WHEN title <> '' THEN title ELSE name END AS name, homepage_url AS url, greatest(0.4, validation_score)::DOUBLE AS confidence,
  organization_type AS org_type, 'link' AS description FROM joined WHERE is_organization AND validation_score >= 0.3""")
def _(spark, sf):
    valid, _ = C.split_validated(_joined(spark, sf))
    return valid.select("page_id", "no", "name", "url", "confidence", "org_type", "description")


@query("f9_reclassified", f"""WITH {_HOME_SQL} SELECT page_id, no, name, homepage_url, reason AS reason_for_reclassification, 'homepage_validation_failed' AS rule_triggered, validation_score
  FROM joined WHERE NOT (is_organization AND validation_score >= 0.3)""")
def _(spark, sf):
    _, rest = C.split_validated(_joined(spark, sf))
    return rest.select("page_id", "no", "name", "homepage_url", "reason_for_reclassification", "rule_triggered", "validation_score")


@query("a5_validation_summary", f"""WITH {_HOME_SQL}, c AS (SELECT count(*) AS original, count(*) FILTER (is_organization AND validation_score >= 0.3) AS valid FROM joined)
  SELECT original::BIGINT AS original, valid::BIGINT AS valid, (original - valid)::BIGINT AS reclassified, round(valid / original * 100, 6) AS success_pct FROM c""")
def _(spark, sf):
    from ..operators.quality import validation_summary
    return validation_summary(_joined(spark, sf))


@query("j7_verdict_join", f"WITH {_HOME_SQL} SELECT page_id, no, homepage_url, organization_type FROM joined")
def _(spark, sf):
    return _joined(spark, sf).select("page_id", "no", "homepage_url", "organization_type")


# the group named for the agent stands before the group for all; the first fitting rule of it decides
_ROBOT_SQL = f"""hosts AS (SELECT DISTINCT {s_host('url')} AS host FROM pages WHERE NOT contains(url, '.org')),
 robots AS (SELECT host, '*' AS agent, 1 AS seq, '/fr/' AS path_prefix, false AS allow FROM hosts UNION ALL SELECT host, '*', 2, '/de/1', false FROM hosts
  UNION ALL SELECT host, 'other', 0, '/', false FROM hosts UNION ALL SELECT host, '*', 6, '/en', false FROM hosts
  UNION ALL SELECT host, 'Sifter', 3, '/en/8', false FROM hosts WHERE starts_with(host, 'm.') UNION ALL SELECT host, 'Sifter', 4, '/es/', true FROM hosts WHERE starts_with(host, 'm.')
  UNION ALL SELECT host, 'Sifter', 5, '/', true FROM hosts WHERE starts_with(host, 'm.')),
 own AS (SELECT host, max(agent) AS agent FROM robots WHERE agent IN ('*', 'Sifter') GROUP BY 1),
 asked AS (SELECT page_id, {s_host('url')} AS host, regexp_extract(url, '^[a-z]+://[^/?#]*(.*)$', 1) AS rest FROM pages),
 hit AS (SELECT p.page_id, r.seq, r.allow FROM asked p JOIN own USING (host) JOIN robots r ON r.host = p.host AND r.agent = own.agent
  AND starts_with(CASE WHEN rest = '' THEN '/' ELSE rest END, r.path_prefix))"""


@query("j8_robots", f"""WITH {_ROBOT_SQL} SELECT p.page_id, coalesce((SELECT arg_min(allow, seq) FROM hit h WHERE h.page_id = p.page_id), true) AS allowed FROM pages p""")
def _(spark, sf):
    pages = pages_of(spark, sf)
    hosts = pages.filter("url not like '%.org%'").select(host("url").alias("host")).distinct()
    rule = lambda agent, seq, prefix, allow: F.struct(F.lit(agent).alias("agent"), F.lit(seq).alias("seq"), F.lit(prefix).alias("path_prefix"), F.lit(allow).alias("allow"))
    every = [rule("*", 1, "/fr/", False), rule("*", 2, "/de/1", False), rule("other", 0, "/", False), rule("*", 6, "/en", False)]
    mobile = [rule("Sifter", 3, "/en/8", False), rule("Sifter", 4, "/es/", True), rule("Sifter", 5, "/", True)]
    listed = F.when(F.startswith("host", F.lit("m.")), F.array(*every, *mobile)).otherwise(F.array(*every))
    robots = hosts.select("host", F.explode(listed).alias("_r")).select("host", "_r.*")
    return P.robots_filter(pages.select("page_id", "url"), robots, "sifter/1.0").select("page_id", "allowed")


@query("j10_unvisited", f"""WITH {LINKS_SQL}, f AS (SELECT target AS url, min((page_id, no)) AS m FROM links GROUP BY 1)
  SELECT url, m[1]::BIGINT AS page_id, m[2]::BIGINT AS no FROM f WHERE url NOT IN (SELECT target FROM links WHERE page_id % 3 = 0)""")
def _(spark, sf):
    links = links_of(spark, sf)
    frontier = links.select(F.col("target").alias("url"), "page_id", "no")
    return P.unvisited(frontier, links.filter("page_id % 3 = 0").select(F.col("target").alias("url")), ["page_id", "no"])


@query("l6_frontier_order", f"""WITH {LINKS_SQL} SELECT target AS url, page_id, no, length(text) % 4 AS priority,
  row_number() OVER (ORDER BY length(text) % 4 DESC, page_id, no)::BIGINT AS place FROM links""")
def _(spark, sf):
    links = links_of(spark, sf).select(F.col("target").alias("url"), (F.length("text") % 4).alias("priority"), "page_id", "no")
    return P.order_frontier(links, ["page_id", "no"])


@query("w2_politeness_schedule", f"""SELECT page_id, host, slot::BIGINT AS slot, (slot * 1.5)::DOUBLE AS earliest_s FROM (SELECT page_id, {s_host('url')} AS host,
  row_number() OVER (PARTITION BY {s_host('url')} ORDER BY page_id) - 1 AS slot FROM pages)""")
def _(spark, sf):
    return P.politeness_schedule(pages_of(spark, sf).select("page_id", "url"), 1.5, "page_id", width=100).select("page_id", "host", "slot", "earliest_s")


@query("w2_politeness_audit", """SELECT event_id, round(gap, 6) AS gap_s, coalesce(gap < 600, false) AS too_soon FROM (SELECT event_id,
  (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts))) / 1000000.0 AS gap FROM events)""")
def _(spark, sf):
    log = table(spark, sf, "events").select("event_id", "user_id", "ts")
    return P.politeness_audit(log, 600.0, "user_id").select("event_id", F.round("gap_s", 6).alias("gap_s"), "too_soon")


@query("w2_search_gap_audit", """SELECT event_id, coalesce(gap < 3, false) AS too_soon FROM (SELECT event_id,
  (epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY ts))) / 1000000.0 AS gap FROM events)""")
def _(spark, sf):
    log = table(spark, sf, "events").select("event_id", F.lit("search").alias("service"), "ts")
    return P.politeness_audit(log, 3.0, "service").select("event_id", "too_soon")


@query("w3_retry_plan", """SELECT event_id, (event_id % 5 + 1)::BIGINT AS next_attempt, CASE WHEN event_id % 5 = 0 THEN 0.0 ELSE least(2.0 * pow(1.5, event_id % 5 - 1), 5.0) END::DOUBLE AS delay_s
  FROM events WHERE event_type = 'error' AND event_id % 5 < 4""")
def _(spark, sf):
    failures = table(spark, sf, "events").filter("event_type = 'error'").select("event_id", (F.col("event_id") % 5).alias("attempt"))
    return P.retry_plan(failures, 2.0, 1.5, 5.0, 4).select("event_id", "next_attempt", "delay_s")


@query("entry_best_link_per_page", f"""WITH {LINKS_SQL}, s AS (SELECT page_id, no, text, target, round(least(1.0, {s_count('lower(text)', _KW)} * 0.3 + {s_count('lower(target)', _KW)} * 0.2
  + CASE WHEN {s_any('lower(target)', _HP)} THEN 0.4 ELSE 0.0 END + CASE WHEN len({s_words('text')}) >= 2 AND {s_caps('text')} >= 2 THEN 0.2 ELSE 0.0 END
  + CASE WHEN {s_any('lower(text)', _CTX)} THEN 0.1 ELSE 0.0 END)::DOUBLE, 6) AS confidence FROM links WHERE href <> '' AND text <> '')
  SELECT page_id, no, text, target, confidence FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY confidence DESC, no) AS r FROM s) WHERE r = 1""")
def best_link_per_page(spark, sf):
    """Best scored link target of each page."""
    from ..operators.ordering import keep_best
    scored = links_of(spark, sf).withColumn("confidence", S.crawl_confidence("text", "target", _KW, _HP, _CTX))
    return keep_best(scored, ["page_id"], "confidence", "no").select("page_id", "no", "text", "target", "confidence")


# ---------------------------------------------------------------- the default rules on search results and links

_RES = f"""{RESULTS_SQL}, r AS (SELECT pos AS page_id, url, title, abstract FROM results)"""


def _as_pages(spark, sf):
    return search_results(spark, sf).select(F.col("pos").alias("page_id"), "url", "title", "abstract")


@query("c4_default_rules", f"""WITH {_RES} SELECT page_id, round(least(1.0, {s_count('lower(title)', rules.INSTITUTION_WORDS)} * 0.3 + {s_count('lower(url)', rules.INSTITUTION_WORDS)} * 0.2
  + CASE WHEN {s_any('lower(url)', ('.edu', '.ac.'))} THEN 0.4 ELSE 0.0 END + CASE WHEN len({s_words('title')}) >= 2 AND {s_caps('title')} >= 2 THEN 0.2 ELSE 0.0 END
  + CASE WHEN {s_any('lower(title)', rules.ACADEMIC_CONTEXT_WORDS)} THEN 0.1 ELSE 0.0 END)::DOUBLE, 6) AS confidence FROM r""")
def _(spark, sf):
    return _as_pages(spark, sf).select("page_id", S.crawl_confidence("title", "url").alias("confidence"))


@query("c11_default_rules", _tier_sql(f"{_RES}, b AS (SELECT page_id, url, lower(url) AS u, lower(title || ' ' || abstract) AS x FROM r)", rules.SOURCE_TIERS, rules.SOURCE_LISTINGS,
                                      rules.SOURCE_CONTENT, rules.SOURCE_KEYWORDS, rules.SOURCE_PATH_WORDS, rules.SOURCE_LIST_WORDS))
def _(spark, sf):
    return S.score_sources(_as_pages(spark, sf)).select("page_id", "url", "score", "source_type")


_DEFAULT_VERDICT = _verdict_sql("r2", rules.HOMEPAGE_INDICATORS, rules.NON_ORGANISATION_WORDS, rules.HOMEPAGE_ACADEMIC_HOST, rules.HOMEPAGE_RESEARCH_HOST,
                                rules.HOMEPAGE_TITLE_WORDS, rules.HOMEPAGE_ABOUT, rules.HOMEPAGE_CONTACT)


@query("f8_default_rules", f"""WITH {_RES}, r2 AS (SELECT page_id, url, title, abstract AS main_text FROM r), {_DEFAULT_VERDICT}
  SELECT page_id, is_organization, validation_score, organization_type, reason FROM verdicts""")
def _(spark, sf):
    pages = _as_pages(spark, sf).select("page_id", "url", "title", F.lit("").alias("description"), F.col("abstract").alias("main_text"))
    return C.validate_homepages(pages).select("page_id", "is_organization", "validation_score", "organization_type", "reason")


_FILES = ("", "/prospectus.PDF", "/map.png", "/data.zip", "/plan.docx", "/index.html")


@query("f13_default_rules", f"""WITH {_RES}, u AS (SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'https://www.facebook.com/' || page_id WHEN 1 THEN '/relative/' || page_id
  ELSE url || ([{', '.join(map(lit, _FILES))}])[page_id % 6 + 1] END AS url FROM r) SELECT page_id, {_crawlable_sql('url')} AS crawlable FROM u""")
def _(spark, sf):
    k = F.col("page_id")
    url = (F.when(k % 7 == 0, F.concat(F.lit("https://www.facebook.com/"), k.cast("string"))).when(k % 7 == 1, F.concat(F.lit("/relative/"), k.cast("string")))
           .otherwise(F.concat("url", F.element_at(F.array(*map(F.lit, _FILES)), (k % 6 + 1).cast("int")))))
    return _as_pages(spark, sf).select("page_id", C.is_crawlable(url).alias("crawlable"))


@query("f14_default_rules", f"""WITH {_RES} SELECT page_id, {s_pattern('lower(url)', rules.ACADEMIC_URL_PATTERNS)} OR {s_pattern("(lower(url) || ' ' || lower(title))", rules.ACADEMIC_TEXT_PATTERNS)} AS academic FROM r""")
def _(spark, sf):
    return _as_pages(spark, sf).select("page_id", C.is_academic("url", "title").alias("academic"))


# ---------------------------------------------------------------- files written and read back


def _folder(spark):
    return f"{shared_folder(spark)}/written/{uuid.uuid4().hex}"


@query("s1_read_search_results", f"""WITH {RESULTS_SQL} SELECT title || ', "quoted"' AS title, CASE WHEN pos % 4 = 0 THEN NULL ELSE abstract || chr(10) || 'second line' END AS abstract, url, query_id::VARCHAR AS original_query
  FROM results WHERE pos % 5 <> 0""")
def _(spark, sf):
    k = F.col("pos")
    rows = search_results(spark, sf).select(
        F.concat("title", F.lit(', "quoted"')).alias("title"), F.when(k % 4 != 0, F.concat("abstract", F.lit("\nsecond line"))).alias("abstract"),
        F.when(k % 5 != 0, F.col("url")).alias("url"), F.col("query_id").cast("string").alias("original_query"))
    folder = _folder(spark)
    write_outputs(rows, folder, "csv")
    return read_search_results(spark, folder)


@query("s3_written_organisations", f"""WITH {NAMES_SQL} SELECT pos, name, method, confidence, 'best, first' AS note FROM names""")
def _(spark, sf):
    rows = institution_names(spark, sf).select("pos", "name", "method", "confidence", F.array(F.lit("best"), F.lit("first")).alias("note"))
    folder = _folder(spark)
    write_outputs(flatten_for_csv(rows), folder, "parquet", score="confidence", partition_by=("method",))
    return spark.read.parquet(folder).select("pos", "name", "method", "confidence", "note")


@query("x_extractors_by_method", f"""WITH {CATALOG_SQL} SELECT page_id, 'table_extraction' AS extractor, count(*)::BIGINT AS n FROM parts GROUP BY 1
  UNION ALL SELECT page_id, 'list_extraction', count(*) FROM parts GROUP BY 1 UNION ALL SELECT page_id, 'structured_data', count(*) FILTER (size % 7 <> 0) FROM parts GROUP BY 1 HAVING count(*) FILTER (size % 7 <> 0) > 0
  UNION ALL SELECT page_id, 'microdata', count(*) FROM parts GROUP BY 1 UNION ALL SELECT page_id, 'heading_extraction', count(*) FROM parts GROUP BY 1 UNION ALL SELECT page_id, 'emphasis', count(*) FROM parts GROUP BY 1""")
def _(spark, sf):
    pages = catalog_pages(spark, sf)
    rows = None
    for method in ("table_extraction", "list_extraction", "structured_data", "microdata", "heading_extraction", "emphasis"):
        found = X.extract_by_method(pages, method).groupBy("page_id").agg(F.count(F.lit(1)).alias("n")).withColumn("extractor", F.lit(method))
        rows = found if rows is None else rows.unionByName(found)
    return rows.select("page_id", "extractor", "n")
