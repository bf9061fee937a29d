"""Queries over texts: given documents and conversations, and offers built from orders."""

from pyspark.sql import functions as F

from .. import rules
from ..operators import classify as C
from ..operators import extract as X
from ..operators import intent as Q
from ..operators import quality as V
from ..operators import score as S
from ..operators.lexicon import label_by
from ..plans import jobs as J
from ..session import spread
from .derived import CATALOG_SQL, NAMES_SQL, OFFERS_SQL, QUERIES_SQL, catalog_pages, catalog_rows, countries, institution_names, offers
from .registry import lit, query, s_any, s_caps, s_count, s_ladder, s_pattern, s_words, table


def documents(spark, sf):
    return table(spark, sf, "documents")


# ------------------------------------------------------------- names by pattern

_FAMILIES = (
    ("standard", 0.85, (r"[A-Z][a-z]+ the [a-z]+", r"[A-Z][a-z]+ der [a-z]+")),
    ("international", 0.8, (r"[A-Z][a-z]+ de la [a-z]+", r"[A-Z][a-z]+ que [a-z]+")),
    ("acronym", 0.75, (r"[0-9]{2,6}\.[0-9]+",)),
)
_AROUND = ("der ", "the ", "de ", "and ")


def _hits_sql(source, key, text, pattern, cols, pad, group=0):
    """Hits of one pattern with start, end and the text around, from gap and hit lengths."""
    p = lit(pattern)
    return f"""SELECT {key}, {cols}, hit_no, hit, part, start_pos, start_pos + length(hit) AS end_pos,
  substr(t, greatest(start_pos - {pad}, 0) + 1, least(start_pos, {pad})) || hit || substr(t, start_pos + length(hit) + 1, {pad}) AS context FROM (
  SELECT {key}, t, hit_no, hit, part, (sum(length(gap) + length(hit)) OVER (PARTITION BY {key} ORDER BY hit_no) - length(hit))::BIGINT AS start_pos FROM (
   SELECT {key}, t, unnest(range(len(h))) AS hit_no, unnest(h) AS hit, unnest(p) AS part, unnest(g[1:len(h)]) AS gap FROM (
    SELECT {key}, {text} AS t, regexp_extract_all({text}, {p}, 0) AS h, regexp_extract_all({text}, {p}, {group}) AS p, string_split_regex({text}, {p}) AS g FROM {source}) WHERE len(h) > 0))"""


def _pattern_sql(source="documents", key="doc_id", families=_FAMILIES, around=_AROUND, before=""):
    parts = [_hits_sql(source, key, "text", "(?i)" + p, f"{lit(f)} AS family, {base} AS base", 100)
             for f, base, ps in families for p in ps]
    return f"""WITH {before} hits AS ({' UNION ALL '.join(parts)}) SELECT {key}, family, hit AS name, round(least(1.0, base
  + CASE WHEN length(hit) > 10 AND length(hit) - length(replace(hit, ' ', '')) >= 2 THEN 0.05 ELSE 0.0 END + {s_count('lower(context)', around)} * 0.02)::DOUBLE, 6) AS confidence
  FROM hits WHERE length(hit) BETWEEN 5 AND 120 AND NOT regexp_matches(hit, '^[\\d\\s\\-.,]+$') AND regexp_matches(hit, '[a-zA-Z]')"""


@query("x14_pattern_names", _pattern_sql())
def _(spark, sf):
    return X.pattern_names(documents(spark, sf), "doc_id", "text", _FAMILIES, context_words=_AROUND, clean=False).select("doc_id", "family", "name", "confidence")


_SENTENCES = ("{} University.", "The {} Medical College, Rome.", "Saint {} University of the North (public)", "see {} Institute of Technology; MIT University", "{} Law School / {} Academy of Sciences")


@query("x14_default_patterns", _pattern_sql("texts", "k", rules.NAME_PATTERN_FAMILIES, rules.PATTERN_CONTEXT_WORDS,
                                            f"{CATALOG_SQL}, texts AS (SELECT k, replace(([{', '.join(map(lit, _SENTENCES))}])[k % {len(_SENTENCES)} + 1], '{{}}', name) AS text FROM parts),"))
def _(spark, sf):
    rows = spread(catalog_rows(spark, sf))
    form = F.element_at(F.array(*map(F.lit, _SENTENCES)), (F.col("k") % len(_SENTENCES) + 1).cast("int"))
    texts = rows.select("k", F.replace(form, F.lit("{}"), F.col("name")).alias("text"))
    return X.pattern_names(texts, "k", "text", clean=False).select("k", "family", "name", "confidence")


@query("x14_institution_names")
def _(spark, sf):
    """All fixed name patterns with cleaning over the catalog pages; no SQL (look-around and Unicode word ends)."""
    return X.page_names(catalog_pages(spark, sf)).select("page_id", "name", "method", "confidence")


# -------------------------------------------------------------- hits in context

_TRIG = r"(?i)merit scholarship|\bcollege\b|institute"
_HIT_SQL = _hits_sql("offers", "offer_id", "text", _TRIG, "1 AS one", 100)


@query("x15_match_contexts", f"WITH {OFFERS_SQL} SELECT offer_id, hit_no::BIGINT AS hit_no, hit, context FROM ({_HIT_SQL})")
def _(spark, sf):
    return X.match_contexts(offers(spark, sf), "offer_id", "text", (r"merit scholarship", r"\bcollege\b", "institute"), 100).select("offer_id", "hit_no", "hit", "context")


_TOK = r"(?i)\$\$\$|that|nicht|pour"


@query("x15_document_contexts", f"SELECT doc_id, hit_no::BIGINT AS hit_no, hit, md5(context) AS digest FROM ({_hits_sql('documents', 'doc_id', 'text', _TOK, '1 AS one', 150)})")
def _(spark, sf):
    rows = X.match_contexts(documents(spark, sf), "doc_id", "text", (r"\$\$\$", "that", "nicht", "pour"), 150)
    return rows.select("doc_id", "hit_no", "hit", F.md5("context").alias("digest"))


@query("x15_hit_offsets", f"SELECT doc_id, hit_no::BIGINT AS hit_no, start_pos, hit, part FROM ({_hits_sql('documents', 'doc_id', 'text', '[A-Z]([a-z]+)tion', '1 AS one', 1, 1)})")
def _(spark, sf):
    return X.pattern_hits(documents(spark, sf), "doc_id", "text", "[A-Z]([a-z]+)tion", 1)


_BEFORE = s_words("left(context, instr(context, hit) - 1)")
_AFTER = s_words("substr(context, instr(context, hit))")
_NAME = f"trim(regexp_replace(array_to_string(list_concat(({_BEFORE})[-3:], ({_AFTER})[1:4]), ' '), '[^a-zA-Z0-9_\\s\\-&]', '', 'g'))"
_NAMED_SQL = f"""named AS (SELECT offer_id, hit_no, hit, context, CASE WHEN length(n) > 5 AND len(list_filter({s_words('n')}, lambda w: regexp_matches(w, '^\\p{{Lu}}'))) > 0 THEN n END AS name
  FROM (SELECT *, {_NAME} AS n FROM ({_HIT_SQL})))"""


@query("x16_context_names", f"WITH {OFFERS_SQL}, {_NAMED_SQL} SELECT offer_id, hit_no::BIGINT AS hit_no, name FROM named WHERE name IS NOT NULL")
def _(spark, sf):
    hits = X.match_contexts(offers(spark, sf), "offer_id", "text", (r"merit scholarship", r"\bcollege\b", "institute"), 100)
    return X.name_from_context(hits).filter("name is not null").select("offer_id", "hit_no", "name")


_COUNTRY_SQL = "CASE " + " ".join(f"WHEN contains(lower(context), {lit(c.lower())}) THEN {lit(c)}" for c in rules.CONTEXT_COUNTRIES) + " ELSE '' END"
_FIRST4 = f"trim(regexp_replace(array_to_string(({s_words('context')})[1:4], ' '), '[^a-zA-Z0-9_\\s\\-&]', '', 'g'))"
_TYPED = f"""SELECT offer_id, hit_no::BIGINT AS hit_no, {_COUNTRY_SQL} AS country, regexp_extract(context, {lit(rules.CITY_PATTERN)}, 1) AS city,
  regexp_extract(context, {lit(rules.AMOUNT_PATTERN)}, 1) AS currency, regexp_extract(context, {lit(rules.AMOUNT_PATTERN)}, 2) AS amount,
  regexp_extract(context, {lit(rules.DEADLINE_PATTERN)}, 1) AS deadline,
  CASE WHEN {s_any('lower(name)', ('technical', 'institute of technology', 'polytechnic'))} THEN 'technical' WHEN contains(lower(context), 'private') THEN 'private'
    WHEN {s_any('lower(context)', ('state', 'public', 'national'))} THEN 'public' ELSE 'university' END AS kind,
  CASE WHEN length({_FIRST4}) > 5 AND len(list_filter({s_words(_FIRST4)}, lambda w: regexp_matches(w, '^\\p{{Lu}}'))) > 0 THEN {_FIRST4} ELSE '' END AS provider
  FROM named WHERE name IS NOT NULL"""


@query("x17_typed_entities", f"WITH {OFFERS_SQL}, {_NAMED_SQL} {_TYPED}")
def _(spark, sf):
    hits = X.match_contexts(offers(spark, sf), "offer_id", "text", (r"merit scholarship", r"\bcollege\b", "institute"), 100)
    named = X.name_from_context(hits).filter("name is not null")
    return X.typed_entities(named).select("offer_id", "hit_no", "country", "city", "currency", "amount", "deadline", "kind", "provider")


# --------------------------------------------------------------------- entities


def _entity_sql(source, key, text, patterns=rules.ENTITY_PATTERNS):
    out = []
    for kind, conf, ps in patterns:
        for no, p in enumerate(ps):
            plain = X._plain_groups([p])[0]
            group = 1 if kind == "deadline" and plain != p else 0
            asked = p if group else plain
            # the accented alternatives never occur in these ASCII texts
            out.append(_hits_sql(source, key, text, "(?i)" + asked, f"{lit(kind)} AS kind, {no} AS pattern_no, {conf} AS confidence", 50, group))
    return " UNION ALL ".join(out)


@query("x18_entities", f"""WITH {OFFERS_SQL} SELECT offer_id, kind, pattern_no::BIGINT AS pattern_no, hit_no::BIGINT AS hit_no, part AS entity, confidence::DOUBLE AS confidence,
  start_pos, end_pos, context FROM ({_entity_sql('offers', 'offer_id', 'text')})""")
def _(spark, sf):
    return X.extract_entities(offers(spark, sf), "offer_id", "text")


_MONEY = (("amount", 0.9, (r"\$[0-9][0-9,]*", r"[0-9]{10,}")), ("token", 0.7, (r"[a-z]+@[a-z.]+", r"license[^.]*")), ("deadline", 0.8, (r"([0-9]{1,3})\.[0-9]{1,3}\.",)))


@query("x18_document_entities", f"""SELECT doc_id, kind, pattern_no::BIGINT AS pattern_no, hit_no::BIGINT AS hit_no, part AS entity, start_pos, end_pos, md5(context) AS digest
  FROM ({_entity_sql('documents', 'doc_id', 'text', _MONEY)})""")
def _(spark, sf):
    rows = X.extract_entities(documents(spark, sf), "doc_id", "text", _MONEY)
    return rows.select("doc_id", "kind", "pattern_no", "hit_no", "entity", "start_pos", "end_pos", F.md5("context").alias("digest"))


# a gazetteer of nations and part names, tagged in offers and conversations
_GAZ_SQL = """gaz AS (SELECT DISTINCT country AS phrase, 'GPE' AS label FROM countries UNION SELECT 'merit scholarship', 'MONEY' UNION SELECT 'plain university', 'ORG' UNION SELECT 'university', 'ORG'
  UNION SELECT 'high college of', 'ORG' UNION SELECT 'public school in springfield ma', 'GPE' UNION SELECT 'college of norway is a private', 'ORG' UNION SELECT DISTINCT lower(c_mktsegment), 'PERSON' FROM customer)"""


def gazetteer(spark, sf):
    n = countries(spark, sf).select(F.col("country").alias("phrase"), F.lit("GPE").alias("label"))
    fixed = [("merit scholarship", "MONEY"), ("plain university", "ORG"), ("university", "ORG"), ("high college of", "ORG"),
             ("public school in springfield ma", "GPE"), ("college of norway is a private", "ORG")]
    more = spark.createDataFrame(fixed, "phrase string, label string")
    seg = table(spark, sf, "customer").select(F.lower("c_mktsegment").alias("phrase"), F.lit("PERSON").alias("label"))
    return n.unionByName(more).unionByName(seg).distinct()


@query("x19_gazetteer_entities", f"""WITH {OFFERS_SQL}, {QUERIES_SQL}, {_GAZ_SQL}, tok AS (SELECT offer_id, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS t FROM offers),
  pos AS (SELECT offer_id, t, unnest(range(len(t))) AS word_no FROM tok), gram AS (SELECT offer_id, word_no, n, array_to_string(t[word_no + 1:word_no + n], ' ') AS phrase FROM pos, range(1, 7) r(n) WHERE word_no + n <= len(t)),
  hit AS (SELECT g.*, label FROM gram g JOIN gaz USING (phrase))
  SELECT offer_id, word_no::BIGINT AS word_no, n::BIGINT AS n, phrase, label, CASE WHEN label = 'ORG' AND {s_any('phrase', rules.ENTITY_INDICATORS)} THEN 'university' WHEN label = 'ORG' THEN 'organization'
    WHEN label = 'GPE' THEN 'location' WHEN label = 'PERSON' THEN 'person' WHEN label = 'MONEY' THEN 'amount' ELSE 'deadline' END AS kind
  FROM hit WHERE n = (SELECT max(n) FROM hit h WHERE h.offer_id = hit.offer_id AND h.word_no = hit.word_no)""")
def _(spark, sf):
    return X.split_organisations(X.gazetteer_entities(offers(spark, sf), "offer_id", "text", gazetteer(spark, sf)))


_KEYS = ("nicht", "that", "pour", "token", "license")


@query("x20_keyword_entities", "SELECT doc_id, entity, 'university' AS kind, 0.5::DOUBLE AS confidence FROM documents, (VALUES " + ", ".join(f"({lit(k)})" for k in _KEYS) + ") v(entity) WHERE contains(lower(text), entity)")
def _(spark, sf):
    return X.keyword_entities(documents(spark, sf), "doc_id", "text", _KEYS)


@query("x26_salvage_json", """SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, CASE WHEN event_id % 3 = 0 THEN 'No JSON content found' WHEN event_id % 3 = 1 THEN 'Invalid JSON format' END AS json_error FROM
  (SELECT event_id, CASE WHEN event_id % 3 = 2 THEN props END AS props FROM events)""")
def _(spark, sf):
    e = table(spark, sf, "events")
    told = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("here { it"), "props", F.lit(" ends } .."))).otherwise(
        F.concat(F.lit("Sure, this is it: "), "props", F.lit(" - done.")))
    rows = X.salvage_json(e.select("event_id", told.alias("answer")), "answer")
    return rows.select("event_id", F.try_variant_get("json", "$.k", "long").alias("k"), "json_error")


@query("x26_salvage_schema", """SELECT event_id, coalesce(k, -1)::BIGINT AS k, coalesce(kind, 'none') AS kind, coalesce(lengths, [0]::BIGINT[])::VARCHAR AS lengths, coalesce(inner_k, 0)::BIGINT AS inner_k, coalesce(flag, true) AS flag, json_error FROM (
  SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN json_extract_string(props, '$.k')::BIGINT END AS k, CASE WHEN event_id % 4 = 1 THEN event_type END AS kind,
   CASE WHEN event_id % 4 = 1 THEN [length(event_type), event_id % 7]::BIGINT[] END AS lengths, CASE WHEN event_id % 4 = 1 THEN json_extract_string(props, '$.k')::BIGINT END AS inner_k,
   CASE WHEN event_id % 4 = 1 THEN event_id % 3 = 0 END AS flag, CASE WHEN event_id % 4 = 3 THEN 'No JSON content found' WHEN event_id % 4 = 2 THEN 'Invalid JSON format' END AS json_error FROM events)""")
def _(spark, sf):
    """Whole, wrong, broken and missing objects, read into one schema with defaults."""
    e = table(spark, sf, "events")
    k = F.col("event_id")
    whole = F.concat(F.lit('Answer: {"k": '), F.get_json_object("props", "$.k"), F.lit(', "kind": "'), F.col("event_type"), F.lit('", "lengths": ['), F.length("event_type").cast("string"), F.lit(", "),
                     (k % 7).cast("string"), F.lit('], "inner": {"k": '), F.get_json_object("props", "$.k"), F.lit('}, "flag": '), (k % 3 == 0).cast("string"), F.lit("}. Done."))
    wrong = F.lit('{"k": "many", "kind": null, "lengths": "none", "inner": [1], "flag": "perhaps"}')
    told = F.when(k % 4 == 1, whole).when(k % 4 == 0, wrong).when(k % 4 == 2, F.lit("so { it ends }")).otherwise(F.col("event_type"))
    schema = "k long, kind string, lengths array<long>, inner struct<k: long>, flag boolean"
    rows = X.salvage_json(e.select(k, told.alias("answer")), "answer", schema, {"k": -1, "kind": "none", "lengths": [0], "inner": {"k": 0}, "flag": True})
    r = F.col("record")
    return rows.select("event_id", r["k"].alias("k"), r["kind"].alias("kind"), F.format_string("[%s]", F.array_join(r["lengths"].cast("array<string>"), ", ")).alias("lengths"),
                       r["inner"]["k"].alias("inner_k"), r["flag"].alias("flag"), "json_error")


@query("x26_conversation_json", """SELECT conv_id, turn, CASE WHEN instr(text, '{') > 0 AND instr(text, '}') > 0 THEN 'Invalid JSON format' ELSE 'No JSON content found' END AS json_error FROM conversations""")
def _(spark, sf):
    return X.salvage_json(table(spark, sf, "conversations"), "text").select("conv_id", "turn", "json_error")


# -------------------------------------------------------------- filters on texts

_EXCLUDE = (r"^(the|der|de)$", r"license", r"^\d+", r"token|@", r"\$\$\$")


@query("f1_exclude_rows", f"SELECT doc_id FROM documents WHERE NOT {s_pattern('lower(trim(text))', _EXCLUDE)}")
def _(spark, sf):
    return C.exclude_rows(documents(spark, sf), "text", _EXCLUDE).select("doc_id")


_LADDER = (("blog_post", ("that the", "nicht der")), ("navigation", ("pour les", "que la")), ("directory", ("license", "von", "del")))


@query("f5_content_classes", f"SELECT doc_id, {s_ladder('lower(text)', _LADDER)} AS content_type FROM documents WHERE {s_ladder('lower(text)', _LADDER)} IS NOT NULL")
def _(spark, sf):
    return C.classify_content(documents(spark, sf), "text", _LADDER).select("doc_id", "content_type")


@query("j9_content_classes", f"SELECT doc_id, {s_ladder('lower(text)', _LADDER)} AS content_type FROM documents WHERE {s_ladder('lower(text)', _LADDER)} IS NOT NULL")
def _(spark, sf):
    ladder = spark.createDataFrame([(label, w, seq) for seq, (label, ws) in enumerate(_LADDER) for w in ws], "label string, keyword string, seq int")
    return label_by(documents(spark, sf), "doc_id", "text", ladder)


@query("f5_general_content", f"""WITH {CATALOG_SQL} SELECT page_id, title, url, content_type FROM (SELECT DISTINCT page_id, 'Catalog home ' || page_id AS title, url, 'navigation' AS content_type FROM parts)""")
def _(spark, sf):
    pages = catalog_pages(spark, sf)
    extra = F.concat(F.lit('<a href="index.html">Catalog home '), F.col("page_id").cast("string"), F.lit("</a></body>"))
    _, content = J.mine_pages(pages.withColumn("html", F.replace("html", F.lit("</body>"), extra)))
    return content.select("page_id", "title", "url", "content_type")


_RULES = (("blog_posts", r"\d+\s+(the|der)\s", "blog_posts"), ("numbered_content", r"^\d+", "blog_posts"), ("social_media", r"(license|token)", "social_media"),
          ("navigation", r"^(the|it|on)", "navigation"), ("generic_codes", r"der die", "generic_codes"))


@query("f6_reclassify", f"""SELECT doc_id, CASE {' '.join(f"WHEN regexp_matches(t, {lit(p)}) THEN {lit(r)}" for r, p, _ in _RULES)} WHEN conf < 0.3 THEN 'low_confidence' END AS rule,
  CASE {' '.join(f"WHEN regexp_matches(t, {lit(p)}) THEN {lit(c)}" for _, p, c in _RULES)} WHEN conf < 0.3 THEN 'low_confidence' END AS category
  FROM (SELECT doc_id, lower(trim(text)) AS t, (n_chars % 10) / 10.0 AS conf FROM documents)""")
def _(spark, sf):
    docs = documents(spark, sf).withColumn("conf", F.col("n_chars") % 10 / 10.0)
    return C.apply_rules(docs, "text", "conf", _RULES).select("doc_id", "rule", "category")


_SPAM = (r"(license|token)", r"^(www\.|http)", r"\d{10,}")

def _spam_sql(x, key, source):
    return f"""w AS (SELECT {key}, {x} AS x, {s_words(f'lower({x})')} AS ws FROM {source}),
  top AS (SELECT {key}, max(n) AS most FROM (SELECT {key}, word, count(*) AS n FROM (SELECT {key}, unnest(ws) AS word FROM w) GROUP BY 1, 2) GROUP BY 1),
  spam AS (SELECT w.{key}, x = '' OR {s_pattern('lower(x)', _SPAM, '')} OR (len(ws) > 1 AND most > len(ws) // 2) AS is_spam FROM w LEFT JOIN top USING ({key}))"""


@query("f10_spam", f"WITH {_spam_sql('text', 'doc_id', 'documents')} SELECT doc_id, coalesce(is_spam, false) AS is_spam FROM spam")
def _(spark, sf):
    return documents(spark, sf).select("doc_id", F.coalesce(C.is_spam("text", _SPAM), F.lit(False)).alias("is_spam"))


@query("f11_quality_gate", f"""WITH {_spam_sql('text', 'doc_id', 'documents')} SELECT doc_id FROM spam JOIN documents USING (doc_id)
  WHERE (n_chars % 10) / 10.0 >= 0.5 AND length(text) >= 3 AND NOT coalesce(is_spam, false)""")
def _(spark, sf):
    docs = documents(spark, sf).select("doc_id", F.col("text").alias("name"), (F.col("n_chars") % 10 / 10.0).alias("confidence"))
    return C.quality_filter(docs, 0.5, _SPAM).select("doc_id")


_MARKS = (("fr", ("é", "ê", "ç", " que ")), ("de", ("ü", "ö", " der ")), ("es", ("ñ", "ó", " los ")))


@query("q3_language_confusion", f"SELECT lang, guessed, count(*)::BIGINT AS n FROM (SELECT lang, {s_ladder('lower(text)', _MARKS, 'en')} AS guessed FROM documents) GROUP BY 1, 2")
def _(spark, sf):
    return Q.guess_language(documents(spark, sf), "text", _MARKS, "en").groupBy("lang", "guessed").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------- name tests on the catalog

_FORMS = ("{} University", "University of {}", "{} of learning", "top {} colleges", "the {} institute for research", "{} College Admission", "{}")
_FORM_SQL = "SELECT k, unnest([" + ", ".join("replace(" + lit(f) + ", '{}', name)" for f in _FORMS) + "]) AS name FROM parts"


def name_forms(spark, sf):
    forms = [F.replace(F.lit(f), F.lit("{}"), F.col("name")) for f in _FORMS]
    return catalog_rows(spark, sf).select("k", F.explode(F.array(*forms)).alias("name"))


@query("f2_strict_institution", f"""WITH {CATALOG_SQL} SELECT k, name, length(name) BETWEEN 5 AND 100 AND NOT {s_pattern('lower(name)', rules.STRICT_NAME_REJECTS)}
  AND regexp_matches(lower(name), '\\b(university|college|institute|academy)\\b') AND {s_caps('name', 3)} >= 2 AS ok FROM ({_FORM_SQL})""")
def _(spark, sf):
    return name_forms(spark, sf).select("k", "name", C.is_institution_strict("name").alias("ok"))


def _lenient(words, rejects):
    return f"""length(name) >= 3 AND {s_any('lower(name)', words)} AND NOT {s_pattern('lower(name)', rejects)}
   AND (len({s_words('name')}) < 2 OR {s_caps('name')} >= len({s_words('name')}) * 0.5)"""


@query("f3_institution", f"""WITH {CATALOG_SQL} SELECT k, name, {_lenient(rules.LENIENT_INDICATORS, rules.LENIENT_REJECTS)} AS lenient,
  {_lenient(rules.STRONG_INDICATORS + rules.SPECIALIZED_INDICATORS, rules.NAME_REJECTS)} AS extracted FROM ({_FORM_SQL})""")
def _(spark, sf):
    return name_forms(spark, sf).select("k", "name", C.is_institution("name").alias("lenient"), C.is_extracted_institution("name").alias("extracted"))


@query("f4_valid_names", """SELECT doc_id, length(text) BETWEEN 5 AND 120 AND NOT regexp_matches(text, '^[\\d\\s\\-.,]+$') AND regexp_matches(text, '[a-zA-Z]') AND NOT regexp_matches(lower(text), '^https?://') AS ok FROM documents""")
def _(spark, sf):
    return documents(spark, sf).select("doc_id", C.is_valid_name("text").alias("ok"))


_TYPE_SQL = s_ladder("lower(name || ' ' || url)", rules.ACADEMIC_TYPE_LADDER, "academic_organization")


@query("f7_org_types", f"""WITH {CATALOG_SQL} SELECT k, name, {_TYPE_SQL} AS academic, {s_ladder("lower(name || ' ' || url)", rules.STATIC_TYPE_LADDER, 'organization')} AS crawl,
  CASE WHEN {s_any('lower(name)', rules.INSTITUTION_WORDS)} THEN 'university' WHEN {s_any('lower(name)', rules.RESEARCH_WORDS)} THEN 'research_center' ELSE '' END AS static
  FROM (SELECT k, name, 'https://x' || k || '.example.com/' AS url FROM ({_FORM_SQL}))""")
def _(spark, sf):
    df = name_forms(spark, sf).withColumn("url", F.concat(F.lit("https://x"), F.col("k").cast("string"), F.lit(".example.com/")))
    return df.select("k", "name", C.org_type("name", "url").alias("academic"), C.org_type("name", "url", rules.STATIC_TYPE_LADDER, "organization").alias("crawl"),
                     C.static_type("name").alias("static"))


@query("f23_institution_links", f"""WITH {CATALOG_SQL} SELECT k, name, {s_any('u', ('.edu', '.ac.', 'university.', 'college.', 'university', 'college', 'institute', 'academic'))} OR
  {s_any('lower(name)', ('university', 'college', 'institute'))} AS ok FROM (SELECT k, name, CASE WHEN k % 3 = 0 THEN 'https://u.example.edu/' ELSE 'https://u.example.com/' || k END AS u FROM ({_FORM_SQL}))""")
def _(spark, sf):
    df = name_forms(spark, sf).withColumn("u", F.when(F.col("k") % 3 == 0, F.lit("https://u.example.edu/")).otherwise(F.concat(F.lit("https://u.example.com/"), F.col("k").cast("string"))))
    return df.select("k", "name", C.is_institution_link("u", "name").alias("ok"))


# ----------------------------------------------------------------- name scoring

_SHAPE = s_pattern("name", rules.SCORE_SHAPES, "")
_ACAD = f"""WITH {CATALOG_SQL}, f AS (SELECT k, name, lower(name) AS n, CASE WHEN k % 4 = 0 THEN 'https://x.example.edu' WHEN k % 4 = 1 THEN 'https://x.example.edu/' WHEN k % 4 = 2 THEN 'https://www.ac.example.ac.uk/' ELSE '' END AS url FROM ({_FORM_SQL})),
 g AS (SELECT *, {s_pattern('url', rules.SCORE_HOSTS, '')} AS host_ok FROM f),
 h AS (SELECT *, round((CASE WHEN {_SHAPE} THEN 0.6 WHEN {s_any('n', rules.INSTITUTION_KEYWORDS)} AND NOT {s_any('n', ('best', 'top', 'list', 'guide'))} THEN 0.3 ELSE 0.0 END
   + CASE WHEN host_ok THEN 0.4 ELSE 0.0 END + CASE WHEN len({s_words('name')}) >= 2 AND {s_caps('name', 3)} >= 2 THEN 0.2 ELSE 0.0 END)::DOUBLE, 6) AS base FROM g)
 SELECT k, name, CASE WHEN {s_pattern('n', rules.SCORE_REJECTS)} OR base < 0.5 OR length(name) > 100 OR contains(name, ':') OR contains(name, ' - ') THEN 0.0
   ELSE round(least(base + CASE WHEN host_ok THEN 0.1 ELSE 0.0 END, 1.0), 6) END::DOUBLE AS confidence FROM h"""


@query("c3_academic_confidence", _ACAD)
def _(spark, sf):
    k = F.col("k") % 4
    url = F.when(k == 0, F.lit("https://x.example.edu")).when(k == 1, F.lit("https://x.example.edu/")).when(k == 2, F.lit("https://www.ac.example.ac.uk/")).otherwise(F.lit(""))
    return S.academic_confidence(name_forms(spark, sf).withColumn("url", url), "name", "url").select("k", "name", "confidence")


_STATIC = f"""round((CASE WHEN {s_any('lower(name)', rules.INSTITUTION_WORDS)} THEN 0.8 WHEN {s_any('lower(name)', rules.RESEARCH_WORDS)} THEN 0.7 ELSE 0.0 END
  + CASE WHEN {s_caps('name', 3)} >= 2 THEN 0.3 ELSE 0.0 END)::DOUBLE, 6)"""


@query("c2_static_confidence", f"WITH {CATALOG_SQL} SELECT k, name, {_STATIC} AS confidence FROM ({_FORM_SQL})")
def _(spark, sf):
    return name_forms(spark, sf).select("k", "name", S.static_confidence("name").alias("confidence"))


_QUAL = f"""round(least(1.0, CASE WHEN length(name) BETWEEN 15 AND 80 THEN 0.3 WHEN length(name) BETWEEN 10 AND 100 THEN 0.2 ELSE 0.1 END
  + CASE WHEN len({s_words('name')}) BETWEEN 2 AND 6 THEN 0.3 ELSE 0.1 END + ({s_caps('name')}::DOUBLE / len({s_words('name')})) * 0.2
  + least({s_count('lower(name)', rules.STRONG_INDICATORS)} * 0.1, 0.2))::DOUBLE, 6)"""


@query("c8_name_quality", f"WITH {CATALOG_SQL} SELECT k, name, {_QUAL} AS quality FROM ({_FORM_SQL})")
def _(spark, sf):
    return name_forms(spark, sf).select("k", "name", S.name_quality("name").alias("quality"))


@query("c9_tagged_confidence", f"""WITH {OFFERS_SQL} SELECT offer_id, round(least(1.0, 0.7 + CASE WHEN length(n) > 5 AND contains(n, ' ') THEN 0.1 ELSE 0.0 END
  + CASE WHEN {s_any('lower(n)', rules.STRONG_INDICATORS)} THEN 0.15 ELSE 0.0 END + {s_count('lower(text)', rules.TAGGED_CONTEXT_WORDS)} * 0.05)::DOUBLE, 6) AS confidence
  FROM (SELECT offer_id, text, word || ' ' || inst AS n FROM offers)""")
def _(spark, sf):
    df = offers(spark, sf).withColumn("n", F.concat_ws(" ", "word", "inst"))
    return df.select("offer_id", S.tagged_confidence("n", "text").alias("confidence"))


@query("f22_static_gate", f"""WITH {CATALOG_SQL} SELECT k, name, {_STATIC} AS confidence FROM ({_FORM_SQL}) WHERE length(name) BETWEEN 3 AND 150 AND NOT {s_pattern('lower(name)', rules.INTENT_EXCLUDES)} AND {_STATIC} >= 0.5""")
def _(spark, sf):
    return C.gate_candidates(name_forms(spark, sf)).select("k", "name", "confidence")


_DIRTY = ("1. {} University - best of all", "#12 {} Univ. of Tech", "3) {} College | campus", "{} Inst (private)", "• {} University Scholarships 2024", "top {} University", "{} St. Academy")
_CLEANED = ("{} University", "{} University of Institute", "{} College", "{} Institute", "{} University", "", "{} Saint Academy")


@query("x14_clean_names", f"""WITH {CATALOG_SQL} SELECT k, i::BIGINT AS form, replace(([{', '.join(map(lit, _CLEANED))}])[i + 1], '{{}}', name) AS cleaned FROM parts, range({len(_DIRTY)}) r(i)""")
def _(spark, sf):
    forms = F.array(*[F.replace(F.lit(f), F.lit("{}"), F.col("name")) for f in _DIRTY])
    rows = catalog_rows(spark, sf).select("k", F.posexplode(forms).alias("form", "raw"))
    return X.clean_name(rows, "raw", "cleaned").select("k", "form", "cleaned")


_ITEMS = ("7. {} University (private)", "=8. {} College – rank", "{} University for international students", "5 best {}", "{} Institute taught in English now")
_ITEMS_OUT = ("{} University", "{} College", "", "", "{} Institute")


@query("x8_clean_items", f"""WITH {CATALOG_SQL} SELECT k, i::BIGINT AS form, replace(([{', '.join(map(lit, _ITEMS_OUT))}])[i + 1], '{{}}', name) AS cleaned FROM parts, range({len(_ITEMS)}) r(i)""")
def _(spark, sf):
    forms = F.array(*[F.replace(F.lit(f), F.lit("{}"), F.col("name")) for f in _ITEMS])
    rows = catalog_rows(spark, sf).select("k", F.posexplode(forms).alias("form", "raw"))
    return rows.select("k", "form", X.clean_item("raw").alias("cleaned"))


# ------------------------------------------------------- gates and reports on names


@query("f12_final_names", f"""WITH {NAMES_SQL} SELECT pos, name, confidence >= 0.8 AND quality >= 0.7 AS is_verified, round(confidence + quality, 6) AS total FROM names
  WHERE confidence >= 0.6 AND quality >= 0.5 AND length(name) BETWEEN 5 AND 120""")
def _(spark, sf):
    return C.finalize_names(institution_names(spark, sf)).select("pos", "name", "is_verified", "total")


@query("f15_confidence_cut", f"WITH {NAMES_SQL} SELECT pos FROM names WHERE confidence >= 0.4")
def _(spark, sf):
    return C.filter_by_confidence(institution_names(spark, sf), 0.4).select("pos")


_HINTS = {"norway": ("old", "src3", ".edu")}


@query("f16_country", f"WITH {NAMES_SQL} SELECT pos, 'norway' AS country FROM names WHERE {s_any("lower(name || ' ' || source_url || ' ' || official_url)", _HINTS['norway'])}")
def _(spark, sf):
    return C.filter_country(institution_names(spark, sf), "norway", _HINTS).select("pos", "country")


@query("f24_names_to_orgs", f"WITH {NAMES_SQL} SELECT name, CASE WHEN official_url <> '' THEN official_url ELSE source_url END AS url, 'university' AS org_type, source_url, confidence, method, 'University discovered via ' || method AS description FROM names")
def _(spark, sf):
    return C.names_to_orgs(institution_names(spark, sf))


@query("a3_discovery_counts", f"WITH {NAMES_SQL} SELECT method, count(*)::BIGINT AS n, count(*) FILTER (confidence >= 0.8)::BIGINT AS high_confidence, count(*) FILTER (is_verified)::BIGINT AS verified FROM names GROUP BY 1")
def _(spark, sf):
    return V.discovery_counts(institution_names(spark, sf))


@query("a4_extraction_stats", f"WITH {NAMES_SQL} SELECT source_url, count(*)::BIGINT AS n, round(avg(confidence), 6) AS avg_confidence FROM names GROUP BY 1")
def _(spark, sf):
    return V.extraction_stats(institution_names(spark, sf), "source_url")


@query("a12_confidence_bands", f"""WITH {NAMES_SQL}, b AS (SELECT CASE WHEN c >= 2 THEN '2.0+' WHEN c >= 1 THEN '1.0-2.0' WHEN c >= 0.3 THEN '0.3-1.0' ELSE '<0.3' END AS band, method AS org_type FROM (SELECT round(confidence * 2.5, 6) AS c, method FROM names))
  SELECT band, org_type, count(*)::BIGINT AS n, round(count(*) / (SELECT count(*) FROM b), 6) AS share FROM b GROUP BY 1, 2""")
def _(spark, sf):
    return V.confidence_bands(institution_names(spark, sf).withColumn("confidence", F.round(F.col("confidence") * 2.5, 6)), kind="method")


@query("a9_kind_distribution", f"WITH {OFFERS_SQL}, e AS ({_entity_sql('offers', 'offer_id', 'text')}) SELECT kind, count(*)::BIGINT AS n, round(count(*) / (SELECT count(*) FROM e), 6) AS share FROM e GROUP BY 1")
def _(spark, sf):
    return V.kind_distribution(X.extract_entities(offers(spark, sf), "offer_id", "text"))


_KIND_SQL = "SELECT conv_id, role AS kind, length(text) % 5 / 4.0 AS completeness, text FROM conversations"


@query("c15_entity_set_quality", f"""WITH e AS ({_KIND_SQL}), q AS (SELECT conv_id, count(DISTINCT kind)::BIGINT AS kinds, count(*)::BIGINT AS entities,
  coalesce(avg(completeness) FILTER (kind IN ('user', 'system')), 0.0) AS c FROM e GROUP BY 1)
  SELECT conv_id, kinds, entities, round((least(1.0, kinds * 0.3) + least(1.0, entities / 10.0) + c)::DOUBLE / 3, 6) AS quality FROM q""")
def _(spark, sf):
    ents = table(spark, sf, "conversations").select("conv_id", F.col("role").alias("kind"), (F.length("text") % 5 / 4.0).alias("completeness"))
    return S.entity_set_quality(ents, "conv_id", ("user", "system")).select("conv_id", "kinds", "entities", "quality")


@query("a10_roll_up", """WITH once AS (SELECT lang AS kind, lower(trim(text)) AS n, lower(trim(source)) AS l, count(*) AS c FROM documents GROUP BY 1, 2, 3)
  SELECT kind, count(*)::BIGINT AS unique_entities, sum(c)::BIGINT AS entities, (SELECT count(*) FROM labels)::BIGINT AS sources, (SELECT round(avg(quality), 6) FROM labels) AS mean_quality FROM once GROUP BY 1""")
def _(spark, sf):
    docs = documents(spark, sf).select(F.col("lang").alias("kind"), F.col("text").alias("name"), F.col("source").alias("link"))
    return V.roll_up_sources(docs, table(spark, sf, "labels").select("quality"))


_WEIGHTS = (("click", 0.5), ("view", 0.3), ("purchase", 0.2), ("bonus", 0.9))


@query("c5_weighted_score", f"""WITH w(indicator, weight) AS (VALUES {', '.join(f"({lit(k)}, {v}::DOUBLE)" for k, v in _WEIGHTS)}), i AS (SELECT user_id, event_type AS indicator, count(*) AS n FROM events GROUP BY 1, 2),
  s AS (SELECT user_id, sum(least(n, 3) * coalesce(weight, 0)) AS s, sum(coalesce(weight, 0)) AS t FROM i LEFT JOIN w USING (indicator) GROUP BY 1)
  SELECT user_id, CASE WHEN t > 0 THEN round(least(s / t, 1.0), 6) ELSE 0.0 END::DOUBLE AS score FROM s""")
def _(spark, sf):
    found = table(spark, sf, "events").groupBy("user_id", F.col("event_type").alias("indicator")).agg(F.count(F.lit(1)).alias("count"))
    return S.weighted_score(found, spark.createDataFrame(list(_WEIGHTS), "indicator string, weight double"), "user_id")


@query("s6_originating_query", """SELECT source AS result_set_id, arg_min(q, doc_id) AS original_query FROM (SELECT source, doc_id, CASE WHEN doc_id % 7 > 3 THEN lang || n_chars END AS q FROM documents) WHERE q IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    from ..sources.tables import originating_query
    q = F.when(F.col("doc_id") % 7 > 3, F.concat("lang", F.col("n_chars").cast("string")))
    return originating_query(documents(spark, sf).select(F.col("source").alias("result_set_id"), F.col("doc_id").alias("position"), q.alias("original_query")))


@query("s7_append_reclassified", """WITH b AS (SELECT 'T' || doc_id AS title, lang AS abstract, source || '/' || (n_chars % 90) AS url, doc_id AS position, 0 AS part FROM documents WHERE n_chars % 2 = 1
   UNION ALL SELECT lang || doc_id, 'Reclassified: ' || CASE WHEN doc_id % 2 = 0 THEN 'reason' ELSE 'Homepage validation failed' END, source || '/' || (n_chars % 90), doc_id, 1 FROM documents WHERE n_chars % 2 = 0)
  SELECT url, arg_min(title, (part, position)) AS title, arg_min(abstract, (part, position)) AS abstract FROM b GROUP BY 1""")
def _(spark, sf):
    from ..sources.tables import append_reclassified
    d = documents(spark, sf).withColumn("url", F.concat("source", F.lit("/"), (F.col("n_chars") % 90).cast("string")))
    old = d.filter("n_chars % 2 = 1").select(F.concat(F.lit("T"), F.col("doc_id").cast("string")).alias("title"), F.col("lang").alias("abstract"), "url", F.col("doc_id").alias("position"))
    new = d.filter("n_chars % 2 = 0").select(F.concat("lang", F.col("doc_id").cast("string")).alias("name"), F.when(F.col("doc_id") % 2 == 0, F.lit("reason")).alias("reason_for_reclassification"),
                                             F.col("url").alias("homepage_url"), "url", F.col("doc_id").alias("position"))
    return append_reclassified(old, new).select("url", "title", "abstract")


@query("s4_flatten_lists", """SELECT source, string_agg(lang, ', ' ORDER BY lang) AS langs, count(*)::BIGINT AS n FROM (SELECT DISTINCT source, lang FROM documents) GROUP BY 1""")
def _(spark, sf):
    from ..sources.tables import flatten_for_csv
    langs = documents(spark, sf).select("source", "lang").distinct().groupBy("source").agg(F.sort_array(F.collect_list("lang")).alias("langs"), F.count(F.lit(1)).alias("n"))
    return flatten_for_csv(langs)
