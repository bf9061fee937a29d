"""Queries about search queries and results: understanding, intent, relevance and ranking."""

from pyspark.sql import functions as F

from .. import rules
from ..operators import classify as C
from ..operators import extract as X
from ..operators import intent as Q
from ..operators import lexicon as K
from ..operators import rank as R
from ..operators import score as S
from ..plans import jobs as J
from .derived import (AS_OF, CATALOG_SQL, NAMES_SQL, QUERIES_SQL, RESULTS_SQL, _pick, catalog_rows, countries, institution_names, search_queries, search_results)
from .q_text import _entity_sql
from .registry import CORE_WORDS, lit, query, s_any, s_count, s_host, s_join, s_key, s_ladder, s_pattern, s_tags, s_words, table

LOW = "lower(query)"


def queries_of(spark, sf):
    return search_queries(spark, sf).drop("nation")


# -------------------------------------------------------------- query understanding

_CLEAN = f"""array_to_string(CASE WHEN len({s_words(LOW)}) <= 3 THEN {s_words(LOW)} ELSE list_filter({s_words(LOW)},
  lambda w: NOT list_contains([{', '.join(map(lit, rules.STOP_WORDS))}], w)) END, ' ')"""


@query("q2_clean_queries", f"WITH {QUERIES_SQL} SELECT query_id, {_CLEAN} AS cleaned_query FROM search_queries")
def _(spark, sf):
    return Q.clean_queries(queries_of(spark, sf)).select("query_id", "cleaned_query")


@query("q4_query_types", f"WITH {QUERIES_SQL} SELECT query_id, {s_ladder(LOW, rules.QUERY_TYPES, 'general_search')} AS query_type FROM search_queries")
def _(spark, sf):
    return Q.query_type(queries_of(spark, sf)).select("query_id", "query_type")


_TAG_COLS = {("countries" if n == "country" else n + "s"): lex for n, lex in rules.QUERY_TAGS.items()}
_TAG_SQL = ", ".join(f"{s_tags(LOW, lex)} AS {c}" for c, lex in _TAG_COLS.items())


@query("q5_query_tags", f"WITH {QUERIES_SQL} SELECT query_id, " + ", ".join(f"{s_join(s_tags(LOW, lex))} AS {c}" for c, lex in _TAG_COLS.items()) + " FROM search_queries")
def _(spark, sf):
    return Q.tag_queries(queries_of(spark, sf)).drop("query")


@query("q5_long_tags", f"WITH {QUERIES_SQL}, t AS (SELECT query_id, {_TAG_SQL} FROM search_queries) " + " UNION ALL ".join(f"SELECT query_id, {lit(c)} AS tag_set, unnest({c}) AS tag FROM t" for c in _TAG_COLS))
def _(spark, sf):
    return Q.long_tags(Q.tag_queries(queries_of(spark, sf)), "query_id")


@query("q5_whole_word_countries", f"""WITH {QUERIES_SQL} SELECT query_id, {s_join("list_sort(list_filter([" + ", ".join("CASE WHEN regexp_matches(lower(query), " + lit('(^|[^a-z0-9])(' + '|'.join(w) + ')($|[^a-z0-9])') + f") THEN {lit(c)} END" for c, w in rules.COUNTRY_WORDS.items()) + "], lambda z: z IS NOT NULL))")} AS countries FROM search_queries""")
def _(spark, sf):
    return Q.tag_queries(queries_of(spark, sf), word_boundary=True).select("query_id", "countries")


_YEAR = int(AS_OF[:4])
_SEASON = s_ladder(LOW, rules.SEASON_WORDS)


@query("q6_temporal_context", f"""WITH {QUERIES_SQL} SELECT query_id, {s_ladder(LOW, rules.URGENCY_LADDER, 'flexible')} AS urgency,
  CASE {' '.join(f"WHEN contains(query, '{y}') THEN 'year_{y}'" for y in range(_YEAR, _YEAR + 3))} WHEN {_SEASON} IS NOT NULL THEN {_SEASON} || '_{_YEAR}' ELSE 'unknown' END AS year_context FROM search_queries""")
def _(spark, sf):
    return Q.temporal_context(queries_of(spark, sf), AS_OF).select("query_id", "urgency", "year_context")


@query("q7_specificity", f"""WITH {QUERIES_SQL} SELECT query_id, round((least(len({s_words('query')}) / 10.0, 1.0) + least({s_count(LOW, rules.SPECIFIC_TERMS)} / 5.0, 1.0)
  + CASE WHEN len({s_tags(LOW, rules.COUNTRY_WORDS)}) + len({s_tags(LOW, rules.REGION_WORDS)}) > 0 THEN 0.3 ELSE 0.0 END)::DOUBLE / 3, 6) AS specificity FROM search_queries""")
def _(spark, sf):
    return Q.specificity(Q.tag_queries(queries_of(spark, sf))).select("query_id", "specificity")


@query("q8_query_profile", f"WITH {QUERIES_SQL} SELECT query_id, {s_ladder(LOW, rules.DEPTH_LADDER, 'overview')} AS depth, {s_ladder(LOW, rules.PROFILE_LADDER, 'unknown')} AS user_profile, {s_ladder(LOW, rules.EXPERIENCE_LADDER, 'intermediate')} AS experience FROM search_queries")
def _(spark, sf):
    return Q.query_profile(queries_of(spark, sf)).select("query_id", "depth", "user_profile", "experience")


def _s_set(pairs):
    parts = ", ".join(f"CASE WHEN {cond} THEN [{', '.join(map(lit, terms))}] ELSE [] END" for cond, terms in pairs)
    return f"list_sort(list_distinct(flatten([{parts}])))"


_SYN = _s_set([(f"list_contains({s_words(LOW)}, {lit(w)})", t) for w, t in rules.SYNONYMS.items()])
_REL = _s_set([(s_any(LOW, trig), t) for trig, t in rules.RELATED_TERMS])
_DOM = _s_set([(f"list_contains({'fields' if k == 'field' else 'levels'}, {lit(v)})", t) for (k, v), t in rules.DOMAIN_TERMS.items()])


@query("q9_expand_queries", f"WITH {QUERIES_SQL}, t AS (SELECT *, {_TAG_SQL} FROM search_queries) SELECT query_id, {s_join(_SYN)} AS synonyms, {s_join(_REL)} AS related_terms, {s_join(_DOM)} AS domain_terms FROM t")
def _(spark, sf):
    return Q.expand_queries(Q.tag_queries(queries_of(spark, sf))).select("query_id", "synonyms", "related_terms", "domain_terms")


_FOCUS = {d: s_any(LOW, w) for d, w in rules.WEB_DOMAINS.items()}
for _label, _trigger, _ in rules.EXTRA_FOCUS:
    _FOCUS[_label] = f"({_FOCUS[_label]} OR {s_any(LOW, _trigger)})"
_FOCUS_SQL = "list_sort(list_filter([" + ", ".join(f"CASE WHEN {c} THEN {lit(d)} END" for d, c in _FOCUS.items()) + "], lambda z: z IS NOT NULL))"
_TYPES_SQL = _s_set([(s_any(LOW, w), w) for w in rules.WEB_DOMAINS.values()] + [(s_any(LOW, t), listed) for _, t, listed in rules.EXTRA_FOCUS])
_INTENT_SQL = f"""CASE {' '.join(f"WHEN {s_any(LOW, w)} THEN {lit(i)}" for i, w in rules.SEARCH_INTENTS)} WHEN list_contains(domain_focus, 'education') THEN 'academic' WHEN list_contains(domain_focus, 'business') THEN 'business' ELSE 'general' END"""
INTENTS_SQL = f"""{QUERIES_SQL}, i0 AS (SELECT *, {_FOCUS_SQL} AS domain_focus, {_TYPES_SQL} AS organization_types,
  [nation] AS geographic_focus FROM search_queries),
 intents AS (SELECT *, {_INTENT_SQL} AS search_intent FROM i0)"""


def intents_of(spark, sf):
    q = search_queries(spark, sf)
    tags = X.gazetteer_entities(q, "query_id", "query", countries(spark, sf).select(F.col("country").alias("phrase"), F.lit("GPE").alias("label")).distinct())
    return Q.analyze_intent(q.drop("nation"), places=tags)


@query("q1_intents", f"""WITH {INTENTS_SQL} SELECT query_id, {s_join('domain_focus')} AS domain_focus, {s_join('organization_types')} AS organization_types, {s_join('geographic_focus')} AS geographic_focus,
  search_intent, CASE search_intent WHEN 'academic' THEN 0.4 WHEN 'research' THEN 0.4 WHEN 'business' THEN 0.3 ELSE 0.0 END::DOUBLE AS domain_match, CASE WHEN len(geographic_focus) > 0 THEN 0.2 ELSE 0.0 END::DOUBLE AS geographic_match FROM intents""")
def _(spark, sf):
    return intents_of(spark, sf).select("query_id", "domain_focus", "organization_types", "geographic_focus", "search_intent", "factors.domain_match", "factors.geographic_match")


@query("q1_intent_patterns", f"""WITH {INTENTS_SQL}, inc(domain, pattern) AS (VALUES {', '.join(f'({lit(d)}, {lit(p)})' for d, ps in rules.INCLUDE_PATTERNS.items() for p in ps)}),
 exc(pattern) AS (VALUES {', '.join(f'({lit(p)})' for p in rules.INTENT_EXCLUDES)})
 SELECT DISTINCT query_id, 'include' AS use, pattern FROM intents JOIN inc ON list_contains(domain_focus, domain)
 UNION ALL SELECT query_id, 'exclude', pattern FROM intents, exc UNION ALL SELECT query_id, 'boost', '\\b' || unnest(geographic_focus) || '\\b' FROM intents
 UNION ALL SELECT query_id, 'domain', unnest(['\\.edu\\b', '\\.ac\\.']) FROM intents WHERE list_contains(domain_focus, 'education')""")
def _(spark, sf):
    return Q.intent_patterns(intents_of(spark, sf))


_STUDENT = [(label, words, focus, max(b.values())) for label, words, focus, b in rules.STUDENT_INTENTS]


@query("q11_student_intents", f"""WITH {QUERIES_SQL} SELECT query_id, {s_ladder(LOW, [(l, w) for l, w, _, _ in _STUDENT])} AS student_intent, {s_ladder(LOW, [(f, w) for _, w, f, _ in _STUDENT])} AS focus,
  CASE {' '.join(f"WHEN {s_any(LOW, w)} THEN {m}" for _, w, _, m in _STUDENT)} END::DOUBLE AS top_boost FROM search_queries""")
def _(spark, sf):
    return Q.student_intent(queries_of(spark, sf)).select("query_id", "student_intent", "focus", F.array_max(F.map_values("boosts")).alias("top_boost"))


_ASKED = f"asked AS ({_entity_sql('search_queries', 'query_id', 'query')})"
_N_ENT = "n AS (SELECT query_id, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in sorted({k for k, _, _ in rules.INTENT_ENTITY_WEIGHTS})) + " FROM asked GROUP BY 1)"


def _intent_score(intent):
    extra = " + ".join(f"coalesce(n_{k}, 0) * {w}" for k, t, w in rules.INTENT_ENTITY_WEIGHTS if t == intent) or "0"
    return f"round(({s_count(LOW, rules.INTENT_KEYWORDS[intent])} * 1.0 + {extra})::DOUBLE, 6)"


_TOP = "greatest(" + ", ".join(f"s_{i}" for i in rules.INTENT_KEYWORDS) + ")"


@query("q10_intent_scores", f"""WITH {QUERIES_SQL}, {_ASKED}, {_N_ENT}, s AS (SELECT query_id, {', '.join(f'{_intent_score(i)} AS s_{i}' for i in rules.INTENT_KEYWORDS)} FROM search_queries LEFT JOIN n USING (query_id))
  SELECT query_id, {_TOP} AS confidence, CASE WHEN {_TOP} = 0 THEN 'general' {' '.join(f"WHEN s_{i} = {_TOP} THEN '{i}'" for i in rules.INTENT_KEYWORDS)} END AS primary_intent FROM s""")
def _(spark, sf):
    q = queries_of(spark, sf)
    asked = X.extract_entities(q, "query_id", "query")
    return Q.score_intents(q, asked).select("query_id", "confidence", "primary_intent")


# ---------------------------------------------------------- intent-driven scoring

_CAND_SQL = f"""cands AS (SELECT k, k % (SELECT count(*) FROM customer) AS query_id, name || (CASE k % 3 WHEN 0 THEN ' University' WHEN 1 THEN ' company' ELSE ' laboratory' END) AS name,
  'https://' || (CASE k % 4 WHEN 0 THEN 'x.example.edu' WHEN 1 THEN 'germany.example.com' ELSE 'y.example.org' END) || '/' AS target FROM parts)"""


def candidates(spark, sf):
    n = table(spark, sf, "customer").agg(F.count(F.lit(1))).scalar()
    k = F.col("k")
    name = F.concat("name", _pick(k % 3, (" University", " company", " laboratory")))
    site = F.when(k % 4 == 0, F.lit("x.example.edu")).when(k % 4 == 1, F.lit("germany.example.com")).otherwise(F.lit("y.example.org"))
    return catalog_rows(spark, sf).select("k", (k % n).alias("query_id"), name.alias("name"), F.concat(F.lit("https://"), site, F.lit("/")).alias("target"))


def _factor(i):
    return "CASE search_intent " + " ".join(f"WHEN '{k}' THEN {v[i]}" for k, v in rules.CONFIDENCE_FACTORS.items()) + " ELSE 0.0 END"


_TX = "(lower(name) || ' ' || lower(target) || ' ')"
_DYN = f"""round(least(1.0, 0.5 + CASE WHEN {' OR '.join(f"(list_contains(domain_focus, {lit(d)}) AND {s_any(_TX, w)})" for d, w in rules.WEB_DOMAINS.items())} THEN {_factor(0)} ELSE 0.0 END
  + CASE WHEN len(list_filter(geographic_focus, lambda g: contains({_TX}, g))) > 0 THEN 0.2 ELSE 0.0 END
  + CASE WHEN search_intent = 'academic' AND {s_any('lower(target)', ('.edu', '.ac.', '.university'))} THEN {_factor(1)} ELSE 0.0 END
  + CASE WHEN {' OR '.join(f"(list_contains(domain_focus, {lit(d)}) AND {s_pattern('lower(name)', [p for p in ps])})" for d, ps in rules.INCLUDE_PATTERNS.items())} THEN {_factor(2)} ELSE 0.0 END)::DOUBLE, 6)"""
_BOTH = "(lower(name) || ' ' || lower(target))"


def _ladder_sql():
    out = "'organization'"
    for d, rungs in reversed(rules.INTENT_TYPE_LADDER):
        out = f"CASE WHEN list_contains(domain_focus, '{d}') THEN coalesce({s_ladder(_BOTH, rungs)}, {out}) ELSE {out} END"
    return out


@query("c1_dynamic_confidence", f"WITH {INTENTS_SQL}, {CATALOG_SQL}, {_CAND_SQL} SELECT k, {_DYN} AS confidence FROM cands JOIN intents USING (query_id)")
def _(spark, sf):
    df = candidates(spark, sf).join(intents_of(spark, sf), "query_id")
    return S.dynamic_confidence(df, "name", "target").select("k", "confidence")


@query("f22_intent_gate", f"WITH {INTENTS_SQL}, {CATALOG_SQL}, {_CAND_SQL} SELECT k, {_DYN} AS confidence, {_ladder_sql()} AS org_type FROM cands JOIN intents USING (query_id) WHERE {_DYN} >= 0.5")
def _(spark, sf):
    return C.gate_candidates(candidates(spark, sf), intents_of(spark, sf)).select("k", "confidence", "org_type")


@query("f17_include_filter", f"""WITH {INTENTS_SQL}, {CATALOG_SQL}, {_CAND_SQL} SELECT k FROM cands JOIN intents USING (query_id) WHERE NOT ({' OR '.join(f"list_contains(domain_focus, {lit(d)})" for d in rules.INCLUDE_PATTERNS)})
  OR {' OR '.join(f"(list_contains(domain_focus, {lit(d)}) AND {s_pattern('lower(name)', ps)})" for d, ps in rules.INCLUDE_PATTERNS.items())}""")
def _(spark, sf):
    return candidates(spark, sf).join(intents_of(spark, sf), "query_id").filter(C.matches_include("name", "domain_focus")).select("k")


_MATCH = f"""list_sort(list_distinct(list_concat(list_concat(list_filter([{', '.join(f"CASE WHEN list_contains(domain_focus, {lit(d)}) AND {s_any('lower(name)', w)} THEN {lit('domain:' + d)} END" for d, w in rules.WEB_DOMAINS.items())}], lambda z: z IS NOT NULL),
  list_transform(list_filter(geographic_focus, lambda g: contains(lower(name), g)), lambda g: 'location:' || g)), list_transform(list_filter(organization_types, lambda t: contains(lower(name), t)), lambda t: 'org_type:' || t))))"""
_OT = "lower(name || ' ' || org_type)"


@query("c6_org_relevance", f"""WITH {INTENTS_SQL}, {CATALOG_SQL}, {_CAND_SQL}, m AS (SELECT *, 'university' AS org_type, {_MATCH} AS matches FROM cands JOIN intents USING (query_id))
  SELECT k, {s_join('matches')} AS matches, round(least(1.0, len(matches) * 0.2 + ({' + '.join(f"CASE WHEN list_contains(domain_focus, {lit(d)}) THEN {s_count(_OT, w)} ELSE 0 END" for d, w in rules.WEB_DOMAINS.items())}) * 0.3
  + len(list_filter(geographic_focus, lambda g: contains({_OT}, g))) * 0.2)::DOUBLE, 6) AS relevance FROM m""")
def _(spark, sf):
    df = candidates(spark, sf).join(intents_of(spark, sf), "query_id").withColumn("org_type", F.lit("university"))
    df = df.withColumn("entity_matches", S.entity_matches_of(df, "name", rules.WEB_DOMAINS))
    return S.org_relevance(df, rules.WEB_DOMAINS).select("k", F.col("entity_matches").alias("matches"), "relevance")


_CNT = f"""(({' + '.join(f"(list_contains(domain_focus, {lit(d)}) AND {s_any('lower(name)', w)})::INT" for d, w in rules.WEB_DOMAINS.items())}) + len(list_filter(geographic_focus, lambda g: contains(lower(name), g))))"""


@query("c16_intent_relevance", f"""WITH {INTENTS_SQL}, {CATALOG_SQL}, {_CAND_SQL}, m AS (SELECT *, {_DYN} AS conf, lower(name) || ' ' || lower('about ' || target) AS t FROM cands JOIN intents USING (query_id))
  SELECT k, conf AS confidence, round(least(1.0, conf * 0.5 + {_CNT} * 0.1 + len(list_filter(domain_focus, lambda d: contains(t, d))) * 0.2 + len(list_filter(geographic_focus, lambda g: contains(t, g))) * 0.15)::DOUBLE, 6) AS relevance FROM m""")
def _(spark, sf):
    df = candidates(spark, sf).join(intents_of(spark, sf), "query_id")
    df = S.older_confidence(df, "name", "target", compat=False).withColumn("description", F.concat(F.lit("about "), "target"))
    return S.intent_relevance(df).select("k", "confidence", "relevance")


@query("c7_entity_boost", f"""WITH {INTENTS_SQL}, {CATALOG_SQL}, {_CAND_SQL} SELECT k, round(least(1.0, 0.5 + CASE WHEN contains(lower(name), 'university') THEN 0.2 ELSE 0.0 END + CASE WHEN len(list_filter(organization_types, lambda t: contains(lower(name), t))) > 0 THEN 0.15 ELSE 0.0 END
  + CASE WHEN k % 2 = 0 THEN 0.1 ELSE 0.0 END)::DOUBLE, 6) AS confidence FROM cands JOIN intents USING (query_id)""")
def _(spark, sf):
    df = candidates(spark, sf).join(intents_of(spark, sf), "query_id").withColumns({
        "confidence": F.lit(0.5), "method": F.when(F.col("k") % 2 == 0, "ner_guided").otherwise("links"), "q_university": F.array(F.lit("university")),
        "q_program": F.col("organization_types"), "q_scholarship": F.array().cast("array<string>")})
    return S.entity_boost(df).select("k", "confidence")


# ------------------------------------------------------------- entities of results

_FOUND = f"""texts AS (SELECT query_id, url, title || '. ' || abstract AS t, url AS ukey FROM results), found AS ({_entity_sql('texts', 'ukey', 't')}),
 f AS (SELECT t.query_id, t.url, kind, lower(part) AS entity FROM found JOIN texts t USING (ukey) WHERE kind IN ({', '.join(map(lit, rules.COMPARED_KINDS))})),
 a AS (SELECT query_id, max(kind) AS q_kind, lower(part) AS q_text FROM asked WHERE kind IN ({', '.join(map(lit, rules.COMPARED_KINDS))}) GROUP BY query_id, lower(part))"""
_PIPE = f"{QUERIES_SQL}, {RESULTS_SQL}, {_ASKED}, {_FOUND}"
_OVER = """p AS (SELECT f.query_id, f.url, f.entity, max(CASE WHEN a.q_text = f.entity THEN 1.0 WHEN contains(a.q_text, f.entity) OR contains(f.entity, a.q_text) THEN 0.5 ELSE 0.0 END) AS best, any_value(c) AS c
   FROM (SELECT query_id, url, entity, count(*) AS c FROM f GROUP BY 1, 2, 3) f LEFT JOIN a USING (query_id) GROUP BY 1, 2, 3),
 overlap AS (SELECT r.query_id, r.url, round(coalesce(sum(coalesce(best, 0) * c) / sum(c), 0.0)::DOUBLE, 6) AS relevance FROM results r LEFT JOIN p USING (query_id, url) GROUP BY 1, 2)"""


def entities_of(spark, sf):
    """Entities of the kinds that are compared, of results and of queries."""
    kinds = [p for p in rules.ENTITY_PATTERNS if p[0] in rules.COMPARED_KINDS]
    r = search_results(spark, sf)
    texts = r.select(F.struct("query_id", "url").alias("key"), F.concat_ws(". ", "title", "abstract").alias("t"))
    found = X.entity_lists(texts, "key", "t", kinds).select("key.query_id", "key.url", "entities")
    asked = X.extract_entities(queries_of(spark, sf), "query_id", "query", kinds, pad=0).select("query_id", "kind", "entity")
    return asked, found, r


@query("c14_entity_relevance", f"WITH {_PIPE}, {_OVER} SELECT * FROM overlap")
def _(spark, sf):
    return R.entity_relevance(*entities_of(spark, sf))


@query("j2_entity_matches", f"""WITH {_PIPE} SELECT query_id, q_text, q_kind, url, entity AS r_text, count(*)::BIGINT AS times FROM f JOIN a USING (query_id) WHERE contains(q_text, entity) OR contains(entity, q_text) GROUP BY 1, 2, 3, 4, 5""")
def _(spark, sf):
    asked, found, _ = entities_of(spark, sf)
    return R.entity_matches(asked, found)


@query("l3_relevance_cut", f"WITH {_PIPE}, {_OVER} SELECT query_id, url, relevance, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, url) AS place FROM overlap WHERE relevance >= 0.02")
def _(spark, sf):
    return R.relevance_cut(R.entity_relevance(*entities_of(spark, sf)), 0.02)


# ------------------------------------------------------------------ eight components


def _share(arr, t):
    return f"(CASE WHEN len({arr}) > 0 THEN len(list_filter({arr}, lambda z: contains({t}, z)))::DOUBLE / len({arr}) ELSE 0.0 END)"


def _listed(col, lists, t):
    return "(" + " + ".join(f"CASE WHEN list_contains({col}, {lit(l)}) THEN {s_count(t, w)}::DOUBLE / {len(w)} ELSE 0.0 END" for l, w in lists.items()) + ")"


_CTX = f"""ctx AS (SELECT query_id, {_CLEAN} AS cleaned, {s_ladder(LOW, rules.QUERY_TYPES, 'general_search')} AS query_type, {_TAG_SQL}, {_SYN} AS synonyms, {_REL} AS related, {s_ladder(LOW, rules.URGENCY_LADDER, 'flexible')} AS urgency,
  {s_ladder(LOW, rules.DEPTH_LADDER, 'overview')} AS depth, {s_ladder(LOW, rules.PROFILE_LADDER, 'unknown')} AS user_profile FROM search_queries)"""
_SEM = f"""(({_share('list_distinct(' + s_words('cleaned') + ')', 't')} + {_share('synonyms', 't')} * 0.8 + {_share('related', 't')} * 0.6 + least({_listed('fields', rules.RANK_FIELD_WORDS, 't')} * 0.7, 1.0)) / 4)"""
_AUTH = f"""least(greatest(CASE {' '.join(f"WHEN contains(u, '.{s}') THEN {v * 0.4}" for s, v in rules.AUTHORITY_SUFFIXES)} ELSE 0.0 END::DOUBLE
  + {' + '.join(f"CASE WHEN regexp_matches(u, {lit(p)}) THEN {v} ELSE 0.0 END::DOUBLE" for p, v in rules.AUTHORITY_URL_PATTERNS)} + least({s_count('lower(title)', rules.AUTHORITY_WORDS)} * 0.1, 0.3)::DOUBLE, 0.0), 1.0)"""
_SP = lambda c: f"list_transform({c}, lambda z: replace(z, '_', ' '))"
_GEO = f"""CASE WHEN len(countries) = 0 AND len(regions) = 0 THEN 0.5 ELSE least({_share(_SP('countries'), "(u || ' ' || t)")} * 0.7 + {_share(_SP('regions'), "(u || ' ' || t)")} * 0.5
  + {' + '.join(f"CASE WHEN list_contains(countries, {lit(c)}) AND contains(url, '.{code}') THEN 0.8 ELSE 0.0 END" for c, code in rules.COUNTRY_CODES.items())}, 1.0) END::DOUBLE"""
_LEV = f"CASE WHEN len(levels) = 0 THEN 0.5 ELSE least({_listed('levels', rules.RANK_LEVEL_WORDS, 't')} / len(levels), 1.0) END::DOUBLE"
_TMP = f"""least(CASE WHEN len(list_filter(regexp_extract_all(t, '\\b(202[0-9])\\b', 1), lambda y: y::INT >= {_YEAR - 1})) > 0 THEN 0.7 ELSE 0.3 END + CASE WHEN urgency = 'immediate' AND {s_any('t', rules.URGENT_WORDS)} THEN 0.3 ELSE 0.0 END, 1.0)::DOUBLE"""
_CMP = f"""(least(length(raw) / 500.0, 1.0) + least(CASE depth {' '.join(f"WHEN '{d}' THEN {s_count('t', w)} * 0.2" for d, w in rules.DEPTH_WORDS.items())} END, 1.0))::DOUBLE / 2"""
_PRF = f"""CASE user_profile {' '.join(f"WHEN '{p}' THEN {s_count('t', w)}::DOUBLE / {len(w)}" for p, w in rules.PROFILE_WORDS.items())} ELSE 0.5 END::DOUBLE"""
_COMPS = (("ner_relevance", "relevance"), ("semantic_alignment", _SEM), ("authority", _AUTH), ("geographic_relevance", _GEO), ("level_appropriateness", _LEV),
          ("temporal_relevance", _TMP), ("comprehensiveness", _CMP), ("profile_alignment", _PRF))
_RANK_SQL = f"""{_PIPE}, {_OVER}, {_CTX}, r0 AS (SELECT *, lower(url) AS u, title || ' ' || abstract AS raw, lower(title || ' ' || abstract) AS t FROM results JOIN ctx USING (query_id) JOIN overlap USING (query_id, url)),
 comp AS (SELECT *, {', '.join(f'round({e}, 6) AS {n}' for n, e in _COMPS)} FROM r0),
 scored AS (SELECT *, round({' + '.join(f'{n} * {w}' for n, w in rules.RELEVANCE_WEIGHTS)}, 8) AS overall, round(({' + '.join(f'({n} > 0.6)::INT' for n, _ in _COMPS)}) / 8.0::DOUBLE, 6) AS confidence FROM comp)"""


def ranked(spark, sf):
    asked, found, r = entities_of(spark, sf)
    contexts = Q.understand_queries(queries_of(spark, sf), AS_OF)
    return R.rank_components(r, contexts, AS_OF, R.entity_relevance(asked, found, r))


@query("c12_components", f"WITH {_RANK_SQL} SELECT query_id, url, {', '.join(n for n, _ in _COMPS)}, overall, confidence FROM scored")
def _(spark, sf):
    return ranked(spark, sf).select("query_id", "url", *[n for n, _ in _COMPS], "overall", "confidence")


_NEAR = "(lower(url) || lower(title))"
_PRIO = f"""round(least(1.0, overall + CASE {' '.join(f"WHEN query_type = '{q}' AND {s_any(_NEAR, w)} THEN {v}" for q, w, v in rules.PRIORITY_TYPE_BOOSTS)} ELSE 0.0 END
  + least({' + '.join(f"CASE WHEN list_contains(levels, {lit(l)}) AND {s_any('t', w)} THEN 0.1 ELSE 0.0 END" for l, w in rules.PRIORITY_LEVEL_WORDS.items())}, 0.2)
  + CASE WHEN len(list_filter(countries, lambda c: contains(t, replace(c, '_', ' ')) OR contains(t, replace(c, '_', '')))) > 0 THEN 0.15 ELSE 0.0 END
  + CASE {' '.join(f"WHEN user_profile = '{p}' AND {s_any('t', w)} THEN 0.1" for p, w in rules.PRIORITY_PROFILE_WORDS.items())} ELSE 0.0 END)::DOUBLE, 8)"""


@query("c13_priority", f"WITH {_RANK_SQL} SELECT query_id, url, {_PRIO} AS priority FROM scored")
def _(spark, sf):
    return R.priority_score(ranked(spark, sf)).select("query_id", "url", "priority")


_PLACED = f"""pr AS (SELECT query_id, url, overall, confidence, ner_relevance AS relevance, {_PRIO} AS priority FROM scored),
  placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY priority DESC, url) AS place FROM pr WHERE overall >= 0.2)"""


@query("l2_ranked_results", f"""WITH {_RANK_SQL}, {_PLACED} SELECT query_id, url, overall, priority, place FROM placed""")
def _(spark, sf):
    return R.top_results(R.priority_score(ranked(spark, sf))).select("query_id", "url", "overall", "priority", "place")


@query("job_rank_results", f"""WITH {_RANK_SQL}, {_PLACED} SELECT query_id, url, overall, confidence, priority, relevance,
  row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, place) AS place FROM placed WHERE relevance >= 0.02""")
def _(spark, sf):
    return J.rank_results(queries_of(spark, sf), search_results(spark, sf), AS_OF, cut=0.02)


@query("j1_attach_scores", f"""WITH {RESULTS_SQL}, s AS (SELECT query_id, url, round(pos % 97 / 100.0, 6) AS overall, (pos % 5) / 5.0 AS confidence, round(pos % 89 / 90.0, 6) AS priority FROM results WHERE pos % 3 > 0)
  SELECT query_id, url, coalesce(overall, 0.3)::DOUBLE AS recognition_score, coalesce(confidence, 0.0)::DOUBLE AS confidence, coalesce(priority, 0.3)::DOUBLE AS priority_score FROM results LEFT JOIN s USING (query_id, url)""")
def _(spark, sf):
    r = search_results(spark, sf)
    scores = r.filter("pos % 3 > 0").select("query_id", "url", F.round(F.col("pos") % 97 / 100.0, 6).alias("overall"), (F.col("pos") % 5 / 5.0).alias("confidence"), F.round(F.col("pos") % 89 / 90.0, 6).alias("priority"))
    return R.attach_scores(r, scores).select("query_id", "url", "recognition_score", "confidence", "priority_score")


@query("l1_sorted_scores", f"WITH {NAMES_SQL} SELECT pos, confidence, quality FROM names ORDER BY confidence DESC, quality DESC, pos")
def _(spark, sf):
    return R.sort_scored(institution_names(spark, sf), ["confidence", "quality"], "pos").select("pos", "confidence", "quality")


# the greedy pass over the 2k best sources of a query, as a fold over a list
_L4 = f"""src AS (SELECT query_id // 10 AS query_id, pos, url, {s_host('url')} AS h, 't' || (pos % 3) AS source_type, round(pos * 7 % 101 / 100.0, 6) AS score FROM results),
 best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rn FROM src),
 lists AS (SELECT query_id, list(struct_pack(pos := [pos], h := [h], t := [source_type]) ORDER BY rn) AS l FROM best WHERE rn <= 40 GROUP BY 1),
 fold AS (SELECT query_id, list_reduce(l, lambda a, x: CASE WHEN len(list_filter(a.h, lambda z: z = x.h[1])) < 3 AND len(list_filter(a.t, lambda z: z = x.t[1])) < 8
   THEN struct_pack(pos := list_concat(a.pos, x.pos), h := list_concat(a.h, x.h), t := list_concat(a.t, x.t)) ELSE a END) AS kept FROM lists)"""


@query("l4_diverse_sources", f"WITH {RESULTS_SQL}, {_L4} SELECT query_id, unnest(kept.pos[1:20]) AS pos, unnest(range(1, least(len(kept.pos), 20) + 1)) AS place FROM fold")
def _(spark, sf):
    r = search_results(spark, sf)
    src = r.select(F.floor(F.col("query_id") / 10).alias("query_id"), "pos", "url", F.concat(F.lit("t"), (F.col("pos") % 3).cast("string")).alias("source_type"), F.round(F.col("pos") * 7 % 101 / 100.0, 6).alias("score"))
    return R.diverse_top_k(src, 20).select("query_id", "pos", "place")


@query("j11_provider_links", f"""WITH orgs AS (SELECT n_nationkey AS org_id, 'The ' || n_name || ' College' AS name FROM nation WHERE n_regionkey < 3), one AS (SELECT {s_key('name', CORE_WORDS)} AS k, min(org_id) AS org_id, arg_min(name, org_id) AS org_name FROM orgs GROUP BY 1)
  SELECT c_custkey, one.org_id::BIGINT AS org_id, org_name FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN one ON one.k = {s_key("n_name || ' University!'", CORE_WORDS)}""")
def _(spark, sf):
    n = table(spark, sf, "nation")
    orgs = n.filter("n_regionkey < 3").select(F.col("n_nationkey").alias("org_id"), F.concat(F.lit("The "), "n_name", F.lit(" College")).alias("name"))
    sch = table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat("n_name", F.lit(" University!")).alias("provider"))
    return R.link_providers(sch, orgs).select("c_custkey", "org_id", "org_name")


# ------------------------------------------------------------- rule lists as tables

_ALL_TAGS_SQL = ", ".join(f"{s_tags(LOW, lex)} AS {c}" for c, lex in rules.QUERY_TAGS.items())


@query("j9_query_tags", f"WITH {QUERIES_SQL}, t AS (SELECT query_id, {_ALL_TAGS_SQL} FROM search_queries) " + " UNION ALL ".join(f"SELECT query_id, {lit(c)} AS tag_set, unnest({c}) AS tag FROM t" for c in rules.QUERY_TAGS))
def _(spark, sf):
    return K.tag_by(queries_of(spark, sf), "query_id", "query", K.rule_table(spark, rules.QUERY_TAGS))


# names of all parts and customers as one lexicon of the given tables, over the texts of conversations
@query("j9_given_lexicon", """WITH lex AS (SELECT DISTINCT 'part' AS domain, lower(left(p_name, 6)) AS keyword FROM part UNION SELECT 'customer', lower(substr(c_name, 15)) FROM customer UNION SELECT 'letters', substr(text, 1, 5) FROM conversations),
  d AS (SELECT conv_id * 1000 + turn AS text_id, lower(text) AS low FROM conversations)
  SELECT text_id, domain, count(*)::BIGINT AS n FROM d JOIN lex ON keyword <> '' AND contains(low, lower(keyword)) GROUP BY 1, 2""")
def _(spark, sf):
    part = table(spark, sf, "part").select(F.lit("part").alias("domain"), F.lower(F.left("p_name", F.lit(6))).alias("keyword"))
    names = table(spark, sf, "customer").select(F.lit("customer"), F.lower(F.substring("c_name", 15, 100)))
    conv = table(spark, sf, "conversations")
    lexicon = part.union(names).union(conv.select(F.lit("letters"), F.substring("text", 1, 5))).distinct()
    docs = conv.select((F.col("conv_id") * 1000 + F.col("turn")).alias("text_id"), "text")
    return K.lexicon_hits(docs, "text_id", "text", lexicon).groupBy("text_id", "domain").agg(F.count(F.lit(1)).alias("n"))
