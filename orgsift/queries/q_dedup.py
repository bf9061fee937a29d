"""Queries about duplicates: keep-one rules, greedy passes, similar names, name groups and survivors."""

from pyspark.sql import functions as F

from .. import rules
from ..operators import dedup as D
from ..operators import quality as V
from ..plans import jobs as J
from ..session import cut_lineage
from .derived import CATALOG_SQL, NAMES_SQL, catalog_pages, catalog_rows, institution_names
from .registry import CORE_WORDS, query, s_cap_words, s_host, s_key, s_words, table

_NAME = "pos, name, source_url, confidence, quality, method"


@query("d1_keep_best", f"""WITH {NAMES_SQL} SELECT {_NAME} FROM (SELECT *, row_number() OVER (PARTITION BY lower(name), official_url ORDER BY confidence DESC, pos) AS r FROM names) WHERE r = 1""")
def _(spark, sf):
    return D.keep_best(institution_names(spark, sf), [F.lower("name"), "official_url"], "confidence", "pos").select(*_NAME.split(", "))


@query("d1_best_document", "SELECT md5(text) AS digest, arg_min(doc_id, doc_id) AS doc_id, count(*)::BIGINT AS copies FROM documents GROUP BY text")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("digest"), F.sha2("text", 256).alias("_key"))  # digests travel, texts stay
    return docs.groupBy("_key", "digest").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).select("digest", "doc_id", "copies")


@query("d2_keep_first", "SELECT arg_min(doc_id, doc_id) AS doc_id, lower(text) = arg_min(lower(text), doc_id) AS same FROM documents GROUP BY lower(text)")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.sha2(F.lower("text"), 256).alias("key"), F.sha2(F.lower("text"), 256).alias("own"))
    return D.keep_first(docs, ["key"], "doc_id").select("doc_id", (F.col("own") == F.col("key")).alias("same"))


# the sequential pass as a fold over all rows
@query("d3_greedy_two_keys", """WITH e AS (SELECT event_id, event_type || user_id AS name, CASE WHEN event_id % 10 = 0 THEN '' ELSE 'u' || (json_extract_string(props, '$.k')::INT * 7 + user_id % 5) END AS url FROM events),
 l AS (SELECT list(struct_pack(i := [event_id], n := [lower(trim(name))], u := CASE WHEN url = '' THEN []::VARCHAR[] ELSE [lower(trim(url))] END) ORDER BY event_id) AS l FROM e),
 f AS (SELECT list_reduce(l, lambda a, x: CASE WHEN list_has_any(a.n, x.n) OR list_has_any(a.u, x.u) THEN a ELSE struct_pack(i := list_concat(a.i, x.i), n := list_concat(a.n, x.n), u := list_concat(a.u, x.u)) END) AS k FROM l)
 SELECT unnest(k.i) AS event_id FROM f""")
def _(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    rows = table(spark, sf, "events").select(
        "event_id", F.concat("event_type", F.col("user_id").cast("string")).alias("name"),
        F.when(F.col("event_id") % 10 == 0, F.lit("")).otherwise(F.concat(F.lit("u"), (k * 7 + F.col("user_id") % 5).cast("string"))).alias("url"))
    return D.greedy_dedup(rows, order="event_id").select("event_id")


_WSET = "list_sort(list_distinct(" + s_words("lower(trim({}))") + "))"


def _similar_sql(source):
    """Best score first, exact links dropped, then a fold that keeps a name unless a kept one is similar."""
    return f"""u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY score DESC, pos) AS r FROM {source}) WHERE r = 1),
 w AS (SELECT pos, score, {_WSET.format('name')} AS w FROM u), l AS (SELECT list(struct_pack(i := [pos], w := [w]) ORDER BY score DESC, pos) AS l FROM w),
 f AS (SELECT list_reduce(l, lambda a, x: CASE WHEN len(x.w[1]) > 0 AND len(list_filter(a.w, lambda z: len(z) > 0 AND
   len(list_intersect(z, x.w[1])) >= 0.85 * (len(z) + len(x.w[1]) - len(list_intersect(z, x.w[1]))) - 1e-9)) > 0 THEN a
   ELSE struct_pack(i := list_concat(a.i, x.i), w := list_concat(a.w, x.w)) END) AS k FROM l)
 SELECT unnest(k.i)::BIGINT AS pos FROM f"""


_SHORT = f"""s AS (SELECT p_partkey AS pos, p_name || ' ' || lower(p_type) || ' college of ' || lower(p_brand) || CASE WHEN p_size % 2 = 0 THEN ' north' ELSE '' END || CASE WHEN p_size % 3 = 0 THEN ' campus' ELSE '' END AS name,
  'u' || (p_partkey % 1700) AS url, (p_size % 13) / 10.0::DOUBLE AS score FROM part)"""


def short_names(spark, sf):
    p = table(spark, sf, "part")
    extra = F.concat(F.when(F.col("p_size") % 2 == 0, F.lit(" north")).otherwise(""), F.when(F.col("p_size") % 3 == 0, F.lit(" campus")).otherwise(""))
    return p.select(F.col("p_partkey").alias("pos"), F.concat("p_name", F.lit(" "), F.lower("p_type"), F.lit(" college of "), F.lower("p_brand"), extra).alias("name"),
                    F.concat(F.lit("u"), (F.col("p_partkey") % 1700).cast("string")).alias("url"), (F.col("p_size") % 13 / 10.0).alias("score"))


@query("d4_similar_names", f"WITH {_SHORT}, {_similar_sql('s')}")
def _(spark, sf):
    return D.dedup_similar(short_names(spark, sf), "name", "url", "score", "pos").select("pos")


_LONG = "s AS (SELECT conv_id * 100 + turn AS pos, text AS name, conv_id || '/' || turn AS url, (length(text) % 17) / 10.0::DOUBLE AS score FROM conversations)"


@query("d4_similar_texts", f"WITH {_LONG}, {_similar_sql('s')}")
def _(spark, sf):
    c = table(spark, sf, "conversations")
    rows = c.select((F.col("conv_id") * 100 + F.col("turn")).alias("pos"), F.col("text").alias("name"), F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("url"), (F.length("text") % 17 / 10.0).alias("score"))
    return D.dedup_similar(rows, "name", "url", "score", "pos").select("pos")


@query("d4_similar_pairs", f"""WITH w AS (SELECT min(doc_id) AS id, w FROM (SELECT doc_id, {_WSET.format('text')} AS w FROM documents) GROUP BY w),
 t AS (SELECT id, len(w) AS n, unnest(w) AS tok FROM w), c AS (SELECT a.id, b.id AS other, a.n AS na, b.n AS nb, count(*) AS common FROM t a JOIN t b ON a.tok = b.tok AND a.id < b.id AND least(a.n, b.n) >= 0.85 * greatest(a.n, b.n) - 1e-9 GROUP BY 1, 2, 3, 4)
 SELECT id, other, round(common / (na + nb - common), 6) AS jaccard FROM c WHERE common / (na + nb - common) >= 0.85 - 1e-9""")
def _(spark, sf):
    sets = cut_lineage(D._word_sets(table(spark, sf, "documents"), "text").groupBy("_w").agg(F.min("doc_id").alias("id")))
    return D.similar_pairs(sets, 0.85).withColumn("jaccard", F.round("jaccard", 6))


_KEY5 = s_key("regexp_replace(lower(name), '\\b(?:the|a|an)\\b', '', 'g')")
_TOTAL = "round(confidence + quality, 9)"


@query("d5_group_variants", f"""WITH {NAMES_SQL}, g AS (SELECT *, {_KEY5} AS name_key, {_TOTAL} AS total FROM names)
 SELECT name_key, arg_max(pos, (total, -pos)) AS pos, arg_max(name, (total, -pos)) AS name, count(*)::BIGINT AS members, (count(DISTINCT name) - 1)::BIGINT AS other_spellings FROM g GROUP BY 1""")
def _(spark, sf):
    return D.group_variants(institution_names(spark, sf)).select("name_key", "pos", "name", "members", "other_spellings")


@query("d5_name_variants", f"""WITH {NAMES_SQL}, g AS (SELECT *, {_KEY5} AS name_key, {_TOTAL} AS total FROM names), b AS (SELECT name_key, arg_max(name, (total, -pos)) AS best_name FROM g GROUP BY 1)
 SELECT DISTINCT name_key, best_name, name AS variant FROM g JOIN b USING (name_key) WHERE name <> best_name""")
def _(spark, sf):
    return D.name_variants(institution_names(spark, sf))


@query("d6_within_source", f"""WITH {NAMES_SQL} SELECT source_url, name_key, arg_max(pos, (confidence, -pos)) AS pos FROM (SELECT *, {s_key('name')} AS name_key FROM names) GROUP BY 1, 2""")
def _(spark, sf):
    return D.dedup_within(institution_names(spark, sf), "source_url").select("source_url", "name_key", "pos")


_PRIO = "CASE method " + " ".join(f"WHEN '{m}' THEN {v}" for m, v in rules.METHOD_PRIORITY) + " ELSE 0.0 END"
_D7 = f"""g AS (SELECT *, {s_key('name', CORE_WORDS)} AS name_key, round(confidence + quality + {_PRIO}, 9) AS total FROM names)"""


@query("d7_global", f"""WITH {NAMES_SQL}, {_D7} SELECT name_key, arg_max(pos, (total, -pos)) AS pos, arg_max(name, (total, -pos)) AS name,
  arg_max(official_url, (total, -pos)) FILTER (official_url <> '') AS official_url, count(*)::BIGINT AS members FROM g GROUP BY 1""")
def _(spark, sf):
    return D.dedup_global(institution_names(spark, sf)).select("name_key", "pos", "name", "official_url", "members")


# the reference loop over a group, as a fold over its rows in rank order
_D8 = f"""o AS (SELECT pos, name, official_url AS url, confidence, {s_key('name', CORE_WORDS)} AS name_key, {s_host('official_url')} AS host FROM names),
 l AS (SELECT name_key, host, count(*) AS members, list(struct_pack(pos := pos, name := name, url := url, c := confidence) ORDER BY confidence DESC, length(name) DESC, pos) AS l FROM o GROUP BY 1, 2),
 f AS (SELECT name_key, host, members, list_reduce(l, lambda a, x: struct_pack(pos := a.pos, name := CASE WHEN length(x.name) > length(a.name) AND x.c >= 0.7 THEN x.name ELSE a.name END,
   url := CASE WHEN a.url = '' AND x.url <> '' THEN x.url WHEN x.url <> '' AND contains(x.url, 'edu') AND NOT contains(a.url, 'edu') THEN x.url ELSE a.url END, c := a.c)) AS k FROM l)
 SELECT name_key, host, k.pos AS pos, k.name AS name, k.url AS url, k.c AS confidence, members::BIGINT AS members FROM f"""


@query("d8_survivors", f"WITH {NAMES_SQL}, {_D8}")
def _(spark, sf):
    orgs = institution_names(spark, sf).select("pos", "name", F.col("official_url").alias("url"), "confidence")
    return D.merge_survivors(orgs)


@query("d9_best_per_host", f"""WITH {NAMES_SQL} SELECT pos FROM (SELECT pos, row_number() OVER (PARTITION BY lower(name), {s_host('official_url')} ORDER BY quality DESC, pos) AS r FROM names) WHERE r = 1""")
def _(spark, sf):
    orgs = institution_names(spark, sf).withColumnsRenamed({"official_url": "url", "quality": "relevance"})
    return D.best_per_name_and_host(orgs).select("pos")


# ---------------------------------------------------------------- unions and counts


@query("u1_union_candidates", f"""WITH {NAMES_SQL}, u AS (SELECT pos, name, 'a' AS part, confidence FROM names UNION ALL SELECT pos, lower(name), 'b', quality FROM names)
 SELECT name_key, arg_max(part, (confidence, -pos, part)) AS part, max(confidence) AS confidence FROM (SELECT *, lower(name) AS name_key FROM u) GROUP BY 1""")
def _(spark, sf):
    n = institution_names(spark, sf)
    both = n.select("pos", "name", F.lit("a").alias("part"), "confidence").unionByName(n.select("pos", F.lower("name").alias("name"), F.lit("b").alias("part"), F.col("quality").alias("confidence")))
    best = D.keep_max(both.withColumn("name_key", F.lower("name")), ["name_key"], F.struct("confidence", -F.col("pos"), "part"))
    return best.select("name_key", "part", "confidence")


_STATUS = f"""st AS (SELECT pos, CASE WHEN row_number() OVER (PARTITION BY lower(name), official_url ORDER BY pos) > 1 THEN 'duplicate' WHEN official_url = '' THEN 'invalid' WHEN confidence < 0.5 THEN 'filtered' ELSE 'kept' END AS status FROM names)"""


@query("a8_processing_summary", f"""WITH {NAMES_SQL}, {_STATUS} SELECT count(*)::BIGINT AS input, count(*) FILTER (status = 'duplicate')::BIGINT AS duplicates_removed, count(*) FILTER (status = 'invalid')::BIGINT AS invalid,
 count(*) FILTER (status = 'filtered')::BIGINT AS filtered, count(*) FILTER (status = 'kept')::BIGINT AS output FROM st""")
def _(spark, sf):
    n = institution_names(spark, sf).withColumn("key", F.lower("name"))
    first = n.groupBy("key", "official_url").agg(F.min("pos").alias("pos")).withColumn("first", F.lit(True))
    st = n.join(first.select("pos", "first"), "pos", "left").withColumn("status", F.when(F.col("first").isNull(), "duplicate").when(F.col("official_url") == "", "invalid")
                                                                      .when(F.col("confidence") < 0.5, "filtered").otherwise("kept"))
    return V.processing_summary(st)


# ------------------------------------------------------------------- jobs on pages

_MINED = """m AS (SELECT page_id, k, name || ' Polytechnic University' AS name, 'https://p' || k || '.example.edu' AS url, 'structured_data' AS method, 0 AS o, 1.3::DOUBLE AS c FROM parts WHERE size % 7 <> 0
 UNION ALL SELECT page_id, k, name || ' University', 'https://u' || k || '.example.edu/university/', 'link_analysis', 1, 1.1 FROM parts WHERE size % 5 <> 0
 UNION ALL SELECT page_id, k, name || ' University', 'https://catalog' || page_id || '.example.com/part/' || k, 'table_extraction', 2, 1.1 FROM parts
 UNION ALL SELECT page_id, k, CASE WHEN size % 5 = 0 THEN name || ' College' ELSE name || ' University' END, CASE WHEN size % 5 = 0 THEN 'https://c' || k || '.example.com/' ELSE 'https://u' || k || '.example.edu/university/' END, 'list_extraction', 3, 1.1 FROM parts)"""


@query("job_mine_pages", f"""WITH {NAMES_SQL}, {_MINED} SELECT page_id, arg_min(name, (-c, o, k)) AS name, url, 'university' AS org_type, max(c) AS confidence, arg_min(method, (-c, o, k)) AS method FROM m GROUP BY page_id, lower(name), url""")
def _(spark, sf):
    orgs, _ = J.mine_pages(catalog_pages(spark, sf))
    return orgs.select("page_id", "name", "url", "org_type", "confidence", "method")


@query("job_discover_institutions")
def _(spark, sf):
    """Sources, five extractors, cleaning and two merges over the catalog pages; no SQL for the whole chain."""
    pages = catalog_pages(spark, sf)
    results = pages.select(F.col("page_id").alias("query_id"), F.col("page_id").alias("pos"), "url", F.lit("Best universities").alias("title"), F.lit("list of universities").alias("abstract"))
    found = J.discover_institutions(results, pages)
    return found["names"].select("name_key", "name", "official_url", "confidence", "quality", "method", "is_verified")


@query("job_extract_for_intent")
def _(spark, sf):
    """Intent-driven extraction over the catalog pages, one search query per page; no SQL for the whole chain."""
    from .q_search import intents_of
    pages = catalog_pages(spark, sf).withColumn("query_id", F.col("page_id") + 1)
    return J.extract_for_intent(pages, intents_of(spark, sf))


# only the catalogs have a stored homepage; all their organisations take its title and address, and one per address stays
@query("job_validate_orgs", f"""WITH {CATALOG_SQL} SELECT DISTINCT 'Best Universities Catalog ' || page_id AS name, 'https://catalog' || page_id || '.example.com/' AS url,
  'university' AS org_type, 1.1::DOUBLE AS confidence FROM parts""")
def _(spark, sf):
    from .q_pages import judged
    orgs, _ = J.mine_pages(catalog_pages(spark, sf))
    homes = catalog_pages(spark, sf).withColumn("url", F.regexp_replace("url", "/list/.*", "/"))
    rows = orgs.withColumn("pos", F.xxhash64("page_id", "name", "url"))
    verdicts = J.homepage_verdicts(rows, homes)
    return J.validate_orgs(rows, verdicts)["valid"].select("name", "url", "org_type", "confidence")


@query("job_education_extract")
def _(spark, sf):
    """University and scholarship records of the catalog pages with their validation; no SQL for the whole chain."""
    return J.education_records(catalog_pages(spark, sf), "2024-01-31").drop("description")


@query("job_education_intents", f"""WITH {CATALOG_SQL}, p AS (SELECT DISTINCT page_id FROM parts) SELECT page_id, page_id % 3 = 0 AS scholarship, true AS has_records, true AS rated FROM p""")
def _(spark, sf):
    """Intents, records and page quality of the education pipeline meet on their page."""
    pages = catalog_pages(spark, sf).withColumn("query_id", F.col("page_id"))
    asked = pages.select("query_id", F.when(F.col("query_id") % 3 == 0, "scholarship money").otherwise("university admission").alias("query"))
    found = J.education_pipeline(pages, "2024-01-31", asked)
    intents = found["records"].groupBy("page_id").agg(F.max("student_intent").alias("intent"), F.count(F.lit(1)).alias("n"))
    return intents.join(found["quality"], "page_id").select(
        "page_id", (F.col("intent") == "scholarship_search").alias("scholarship"), (F.col("n") > 0).alias("has_records"),
        F.col("quality").between(0, 1).alias("rated"))
