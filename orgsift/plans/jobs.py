"""Whole jobs composed of the operators.  Each takes and returns DataFrames and plans lazily, but for steps
that write what they need several times: the duplicate rounds, the distinct entity texts, the candidates that
several extractors pick from elements, and the texts and hits of the education records."""

from pyspark.sql import Column, DataFrame, functions as F

from .. import rules
from ..functions.text import any_pattern, any_word
from ..functions.url import homepage, host, resolve
from ..operators import classify as C
from ..operators import dedup as D
from ..operators import extract as X
from ..operators import intent as Q
from ..operators import learning as L
from ..operators import quality as V
from ..operators import rank as R
from ..operators import records as O
from ..operators import score as S
from ..operators.html import flat_links, main_text, page_elements, page_meta, page_text, text_of, title_of
from ..operators.ordering import keep_best
from ..session import written
from ..sources.tables import append_reclassified

_CANDIDATE = "array<struct<method:string,pos:int,name:string,href:string,context:string,description:string>>"


def _ld_entries(types) -> Column:
    """JSON-LD organisations out of the script elements of a page."""
    scripts = F.filter("elements", lambda e: (e["tag"] == "script") & (F.try_element_at(e["attrs"], F.lit("type")) == "application/ld+json"))

    def entries(e):
        body = F.trim(F.try_element_at(e["attrs"], F.lit("#body")))
        listed = F.when(F.startswith(body, F.lit("[")), body).otherwise(F.concat(F.lit("["), body, F.lit("]")))
        get = lambda v, p: F.try_variant_get(v, p, "string")
        parsed = F.coalesce(F.try_parse_json(listed).cast("array<variant>"), F.array().cast("array<variant>"))
        wanted = F.filter(parsed, lambda v: get(v, '$["@type"]').isin(*types) & (get(v, "$.name") != "") & (get(v, "$.url") != ""))
        return F.transform(wanted, lambda v: F.struct(
            F.lit("structured_data").alias("method"), e["pos"].alias("pos"), get(v, "$.name").alias("name"), get(v, "$.url").alias("href"),
            F.lit("").alias("context"), get(v, "$.description").alias("description")))

    return F.flatten(F.transform(scripts, entries)).cast(_CANDIDATE)


def page_candidates(elements: DataFrame, types=rules.JSONLD_TYPES) -> DataFrame:
    """All candidates of a page in one pass over its elements: JSON-LD, links, first table cells, list items."""
    el = lambda pos: F.get("elements", pos)
    is_link = lambda e: (e["tag"] == "a") & e["href"].isNotNull() & (e["href"] != "") & ~F.lower(e["href"]).rlike(r"^(#|mailto:|tel:|javascript:)")
    named = lambda e, around: F.when(e["chars"] > 0, text_of(e)).otherwise(text_of(el(e[around])))

    def row(method, e, name, context):
        return F.struct(F.lit(method).alias("method"), e["pos"].alias("pos"), name.alias("name"), F.trim(e["href"]).alias("href"),
                        context.alias("context"), F.lit(None).cast("string").alias("description"))

    links = F.transform(F.filter("elements", lambda e: is_link(e) & (e["chars"] > 0)),
                        lambda e: row("link_analysis", e, text_of(e), X._context(e, 500)))
    cells = F.transform(F.filter("elements", lambda e: is_link(e) & (el(e["cell"])["cell_no"] == 1) & e["table"].isNotNull()),
                        lambda e: row("table_extraction", e, named(e, "cell"), F.lit("")))
    items = F.transform(F.filter("elements", lambda e: is_link(e) & e["li"].isNotNull()),
                        lambda e: row("list_extraction", e, named(e, "li"), F.lit("")))
    every = F.concat(_ld_entries(types), *[a.cast(_CANDIDATE) for a in (links, cells, items)])
    rows = elements.select("page_id", "url", F.explode(every).alias("_c")).select("page_id", "url", "_c.*")
    own = rows.withColumn("target", F.when(F.col("method") == "structured_data", F.col("href")).otherwise(resolve("url", "href")))
    return own.withColumn("other_host", host("target") != host("url"))


def score_candidates(cands: DataFrame, intents: DataFrame = None) -> DataFrame:
    """Candidates with org_type, confidence and is_org; with intents (query_id on both sides) the score follows them."""
    clean = F.lower(F.trim("name"))
    fits = F.length(F.trim("name")).between(3, 150) & ~any_pattern(clean, rules.INTENT_EXCLUDES)
    if intents is not None:
        df = S.dynamic_confidence(cands.join(intents.select("query_id", "domain_focus", "geographic_focus", "search_intent").hint("merge"), "query_id"),
                                  "name", "target", out="_base")
        df = df.withColumn("org_type", C.intent_type("name", "target", "domain_focus"))
    else:
        df = cands.withColumns({"_base": S.static_confidence("name"), "org_type": C.static_type("name")})
    extra = (F.when(F.col("method") == "structured_data", 0.2)
             .when((F.col("method") == "link_analysis") & any_word(F.lower("context"), rules.LINK_CONTEXT_WORDS), 0.2).otherwise(0.0))
    reaches = (F.col("method") != "link_analysis") | F.col("other_host")
    return df.withColumns({"is_org": fits & (F.col("_base") >= 0.5),
                           "confidence": F.round(F.col("_base") + extra, 6)}).withColumn(
        "counts", F.col("is_org") & reaches).drop("_base")


def mined_orgs(scored: DataFrame) -> DataFrame:
    """Best row per page, lower-case name and target."""
    place = (F.when(F.col("method") == "structured_data", 0).when(F.col("method") == "link_analysis", 1)
             .when(F.col("method") == "table_extraction", 2).otherwise(3) * 100000000 + F.col("pos"))
    rows = scored.filter("counts").withColumns({"_place": place, "_name": F.lower("name")})
    best = keep_best(rows, ["page_id", "_name", "target"], "confidence", "_place")
    return best.select("page_id", F.col("name"), F.col("target").alias("url"), "org_type", F.col("url").alias("source_url"),
                       "confidence", "method", F.coalesce("description", "context").alias("description"))


def mined_content(scored: DataFrame) -> DataFrame:
    """Links that are no organisation, by content class."""
    rest = scored.filter((F.col("method") == "link_analysis") & ~F.col("is_org"))
    return C.classify_content(rest, "name").select("page_id", F.col("name").alias("title"), F.col("target").alias("url"),
                                                   "content_type", F.col("url").alias("source_url"))


def mine_pages(pages: DataFrame, intents: DataFrame = None):
    """(organisations, general content) of stored pages.

    Both come from the scored candidates; to write both, write score_candidates(..) once and
    pass the written table to mined_orgs and mined_content.
    """
    scored = score_candidates(page_candidates(page_elements(pages)), intents)
    return mined_orgs(scored), mined_content(scored)


def homepage_verdicts(orgs: DataFrame, pages: DataFrame) -> DataFrame:
    """Each homepage that an organisation needs is judged once; other pages are not even parsed."""
    wanted = orgs.select(homepage("url").alias("url")).distinct()
    needed = pages.join(wanted.hint("merge"), "url", "left_semi")
    texts = main_text(needed.withColumn("_head", F.col("html")))
    heads = page_meta(texts.withColumnRenamed("_head", "html")).select("page_id", "url", "title", "description", "main_text")
    return C.validate_homepages(heads)


def validate_orgs(orgs: DataFrame, verdicts: DataFrame, search_results: DataFrame = None) -> dict:
    """Validated and de-duplicated organisations, the reclassified rest, the summary, and the
    search results with the rest fed back."""
    joined = C.attach_verdicts(orgs, verdicts)
    valid, rest = C.split_validated(joined)
    out = {"valid": D.dedup_similar(valid, "name", "url", "confidence", "pos"), "reclassified": rest,
           "summary": V.validation_summary(joined)}
    if search_results is not None:
        out["search_results"] = append_reclassified(search_results, rest.withColumn("position", F.col("pos")))
    return out


def extract_for_intent(pages: DataFrame, intents: DataFrame, gazetteer: DataFrame = None, least: float = 0.4) -> DataFrame:
    """Organisations of result pages(query_id, page_id, url, html) scored against the intent of their query."""
    focus = intents.select("query_id", "domain_focus", "geographic_focus", "organization_types", "entity_types", "search_intent")
    owner = pages.select("page_id", "query_id")
    ld = X.jsonld_orgs(pages).select("page_id", "url", "name", "target", "description", "method")
    links = X.external_links(flat_links(pages), internal=True).select(
        "page_id", "url", F.col("text").alias("name"), "target", F.lit("").alias("description"), F.lit("link_analysis").alias("method"))
    rows = ld.unionByName(links)
    if gazetteer is not None:
        texts = pages.select("page_id", page_text("html").alias("text"))
        tagged = X.gazetteer_entities(texts, "page_id", "text", gazetteer.filter("label = 'ORG'"))
        named = tagged.select("page_id", "phrase").distinct().join(pages.select("page_id", "url"), "page_id")
        rows = rows.unionByName(named.select("page_id", "url", F.initcap("phrase").alias("name"), F.col("url").alias("target"),
                                             F.lit("").alias("description"), F.lit("text_entities").alias("method")))
    rows = rows.join(owner.hint("merge"), "page_id").join(focus.hint("merge"), "query_id")
    scored = S.older_confidence(rows, "name", "target", "description", compat=False)
    gate = F.when(F.col("method") == "structured_data", 0.3).when(F.col("method") == "link_analysis", least).otherwise(0.5)
    kept = scored.filter((F.col("confidence") >= gate) & ((F.col("method") == "structured_data") | C.matches_include("name", "domain_focus")))
    kept = kept.withColumn("confidence", F.col("confidence") + F.when(F.col("method") == "structured_data", 0.2).otherwise(0.0))
    rated = S.intent_relevance(kept).withColumn("org_type", C.intent_type("name", "target", "domain_focus"))
    ordered = rated.withColumns({"pos": F.col("page_id"), "target_host": host("target"), "name_key": F.lower("name")})
    best = D.keep_max(ordered, ["query_id", "name_key", "target_host"],
                      F.struct("relevance", "confidence", -F.col("pos"), "target"))
    return best.select("query_id", "page_id", "name", "target", "org_type", "method", "confidence", "relevance")


def simple_companies(pages: DataFrame, results: DataFrame = None, blocklist=rules.LINK_BLOCKLIST, internal: bool = False) -> DataFrame:
    """Distinct outward links with a plausible name; with results only their pages are read."""
    if results is not None:
        pages = pages.join(results.select("url").distinct(), "url", "left_semi")
    return X.simple_company_links(flat_links(pages), blocklist, internal)


def rank_results(queries: DataFrame, results: DataFrame, as_of: str, patterns=rules.ENTITY_PATTERNS, least: float = 0.2, cut: float = 0.1) -> DataFrame:
    """Ranked results: query context, entity overlap, eight components, priority, scores joined back onto all
    results (one without a score gets the default), recognition threshold, order by priority, then the
    entity relevance threshold and order by it.

    The distinct entity texts of the queries are written once while the plan is made (R.entity_relevance).
    """
    contexts = Q.understand_queries(queries, as_of)
    texts = results.select("query_id", "url", F.concat_ws(". ", "title", "abstract").alias("text"))
    keyed = texts.withColumn("_key", F.struct("query_id", "url"))
    compared = [p for p in patterns if p[0] in rules.COMPARED_KINDS]  # other kinds are never looked up
    found = X.entity_lists(keyed, "_key", "text", compared).select("_key.query_id", "_key.url", "entities")
    asked = X.extract_entities(queries, "query_id", "query", compared, pad=0).select("query_id", "kind", "entity")
    overlap = R.entity_relevance(asked, found, results)
    ranked = R.priority_score(R.rank_components(results, contexts, as_of, overlap))
    scores = ranked.select("query_id", "url", "overall", "confidence", "priority")
    scored = R.attach_scores(results, scores).withColumns({"overall": F.col("recognition_score"), "priority": F.col("priority_score")})
    placed = R.top_results(scored, least).withColumnRenamed("place", "recognition_place")
    known = placed.join(overlap.hint("merge"), ["query_id", "url"], "left").withColumn("relevance", F.coalesce("relevance", F.lit(0.0)))
    return R.relevance_cut(known, cut, "relevance", "recognition_place").select(
        "query_id", "url", "overall", "confidence", "priority", "relevance", "place")


def discover_institutions(results: DataFrame, pages: DataFrame, k: int = 20, country: str = None) -> dict:
    """Institution names on the best sources of each query, merged over sources, with counts per method."""
    sources = R.diverse_top_k(S.score_sources(results), k)
    wanted = pages.join(sources.select("url").distinct().hint("merge"), "url", "left_semi")
    picked = X.picked_together(page_elements(wanted), {"selector": X.selector_links(), "cell": X.CELLS, "heading": X.HEADINGS, "link": X.LINKS})
    common = ["page_id", "source_url", "pos", "name", "confidence", "quality", "method", "official_url"]

    def shape(df, pos="pos"):
        named = X.clean_name(df.withColumn("_raw", F.col("name")), "_raw", "name").filter(F.col("name") != "")
        return named.select("page_id", F.col("url").alias("source_url"), F.col(pos).cast("long").alias("pos"), "name", "confidence",
                            "quality", "method", F.col("target").alias("official_url"))

    heads = X.heading_rows(picked["heading"].filter(C.is_institution("name")))
    links = X.link_pattern_names(picked["link"])
    texts = X.page_names(wanted).join(wanted.select("page_id", "url").hint("merge"), "page_id").select(
        "page_id", F.col("url").alias("source_url"), F.lit(0).cast("long").alias("pos"), "name", "confidence",
        S.name_quality("name").alias("quality"), "method", F.lit(None).cast("string").alias("official_url"))
    names = (shape(X.selector_rows(picked["selector"])).unionByName(shape(X.cell_rows(picked["cell"])))
             .unionByName(shape(heads)).unionByName(shape(links, "no")).unionByName(texts)).select(*common)
    if country:
        names = C.filter_country(names, country)
    within = D.dedup_within(names.withColumn("_pos", F.xxhash64("source_url", "method", "pos", "name")), "source_url", "_pos")
    merged = D.dedup_global(within.drop("name_key").withColumnRenamed("_pos", "rank_key"), "rank_key")
    final = C.finalize_names(merged)
    return {"sources": sources, "names": final, "counts": V.discovery_counts(final)}


def _page_texts(pages: DataFrame, text: Column = None) -> DataFrame:
    """page_id, url, text: the given text of a page, or its whole text without scripts and styles."""
    return pages.select("page_id", "url", (page_text("html", ("script", "style")) if text is None else text).alias("text"))


def education_records(pages: DataFrame, as_of: str, text: Column = None) -> DataFrame:
    """University and scholarship records around their trigger words, validated and accepted.

    Texts that are made from the pages here are written once, as several searches read them.
    """
    docs = written(_page_texts(pages)) if text is None else _page_texts(pages, text)
    rows = None
    for kind, (pad, patterns) in rules.EDUCATION_HITS.items():
        hits = X.match_contexts(docs, "page_id", "text", patterns, pad)
        named = X.typed_entities(X.name_from_context(hits).filter("name is not null"))
        named = named.withColumn("record_kind", F.lit("universities" if kind == "university" else "scholarships"))
        rows = named if rows is None else rows.unionByName(named)
    rows = rows.join(docs.select("page_id", F.col("url").alias("official_url")).hint("merge"), "page_id")
    link = F.when(F.col("record_kind") == "universities", F.col("official_url")).otherwise(F.col("provider"))
    rows = rows.withColumns({"_n": F.lower("name"), "_l": F.lower(link)})
    once = D.keep_first(rows, ["page_id", "record_kind", "_n", "_l"], ["hit_no"]).drop("_n", "_l")
    uni = once.filter("record_kind = 'universities'").withColumn("type", F.col("kind"))
    sch = once.filter("record_kind = 'scholarships'").withColumns(
        {"application_deadline": F.col("deadline"), "academic_level": F.array().cast("array<string>")})
    cols = ["page_id", "record_kind", "name", "official_url", "country", "city", "kind", "provider", "currency", "amount",
            "deadline", "description", "issues", "is_valid", "confidence_score", "completeness"]
    uni = V.completeness(V.validate_universities(uni), rules.COMPLETENESS_FIELDS["universities"]).select(*cols)
    sch = V.completeness(V.validate_scholarships(sch, as_of), rules.COMPLETENESS_FIELDS["scholarships"]).select(*cols)
    checked = uni.unionByName(sch)
    return V.accept(checked.withColumn("_k", F.col("kind")).withColumn("kind", F.col("record_kind"))).withColumn(
        "kind", F.col("_k")).drop("_k")


def education_offers(docs: DataFrame, keys, text: str, url: str, within: int = None) -> dict:
    """Validated and accepted records of programs, events and funding from docs(keys, text, url).

    The hits of all patterns are found and written once; each kind of record is a sweep over them.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    at = F.struct(*keys, url).alias("_at")
    hits = written(X.extract_entities(docs.select(at, text), "_at", text, pad=0).select("_at.*", "kind", "entity", "start_pos", "end_pos", "pattern_no", "hit_no"))
    checks = {"programs": V.validate_programs, "events": V.validate_events, "funding": V.validate_funding}
    out = {}
    for record, check in checks.items():
        rows = V.completeness(check(O.records_of(hits, keys, record, url, within)), rules.OFFER_FIELDS[record])
        out[record] = V.accept(rows.withColumn("kind", F.lit(record)), checked=tuple(checks)).drop("kind")
    return out


def education_quality(records: DataFrame) -> DataFrame:
    """Quality per page and the roll-up over pages come from the accepted records."""
    return S.entity_set_quality(records.select("page_id", F.col("record_kind").alias("kind"), "completeness"), "page_id")


def education_pipeline(pages: DataFrame, as_of: str, queries: DataFrame = None, text: Column = None) -> dict:
    """Records of pages with the quality of each page and the roll-up over all of them.

    With queries(query_id, query) and pages that carry a query_id, records also have the student
    intent and the focus of their query.  programs, events and funding are tables of their own.
    """
    docs = written(_page_texts(pages, text))  # read by the records and by the offers
    records = education_records(docs, as_of, F.col("text"))
    entities = records.select(F.col("record_kind").alias("kind"), "name", F.col("official_url").alias("link"))
    quality = education_quality(records)
    out = {"quality": quality, "totals": V.roll_up_sources(entities, quality)}
    if queries is not None:
        asked = Q.student_intent(queries).select("query_id", "student_intent", "focus")
        owner = pages.select("page_id", "query_id").join(asked.hint("merge"), "query_id", "left")
        records = records.join(owner.hint("merge"), "page_id")
    return {"records": records, **out, **education_offers(docs, "page_id", "text", "url")}


def study_session(vocab: DataFrame, progress: DataFrame, as_of: str, seed: str, new: int = 3, due: int = 2) -> DataFrame:
    """Per learner: random unseen items, then the items due first."""
    levels = L.user_levels(progress)
    fresh = L.sample_per_user(vocab, levels, new, seed, progress)
    waiting = L.first_per_user(L.due_items(vocab, progress, as_of), due, "next_review", "vocabulary_id")
    return L.build_session(fresh, waiting)


def study_report(vocab: DataFrame, reviews: DataFrame, as_of: str) -> DataFrame:
    """Statistics of every learner with the current streak."""
    progress = L.review_state(reviews)
    return L.study_stats(vocab, progress).join(L.streaks(reviews, as_of), "user_id", "left")
