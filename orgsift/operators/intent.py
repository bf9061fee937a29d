"""Query understanding: tags, ladders, expansion and intents of search queries."""

from pyspark.sql import Column, DataFrame, functions as F

from .. import rules
from ..functions.text import any_pattern, any_word, collapse, count_words, first_label, sorted_set, words


def clean_queries(queries: DataFrame, query: str = "query", stop_words=rules.STOP_WORDS) -> DataFrame:
    """Lower case, single spaces, no stop words unless the query has at most three words."""
    w = words(F.lower(collapse(query)))
    kept = F.when(F.size(w) <= 3, w).otherwise(F.filter(w, lambda x: ~x.isin(*stop_words)))
    return queries.withColumn("cleaned_query", F.array_join(kept, " "))


def guess_language(df: DataFrame, text: str, markers=rules.LANGUAGE_MARKERS, default: str = "english") -> DataFrame:
    """Language of the first marker word that occurs."""
    return df.withColumn("guessed", first_label(F.lower(F.col(text)), markers, default))


def query_type(queries: DataFrame, query: str = "query", ladder=rules.QUERY_TYPES) -> DataFrame:
    return queries.withColumn("query_type", first_label(F.lower(F.col(query)), ladder, "general_search"))


def tags_of(text: Column, lexicon: dict, word_boundary: bool = False) -> Column:
    """Sorted labels that have a word in the text; substrings count unless word_boundary is set."""
    def hit(wanted):
        if word_boundary:
            return any_pattern(text, [rf"(?<![\p{{L}}\p{{N}}]){w}(?![\p{{L}}\p{{N}}])" for w in wanted], flags="")
        return any_word(text, wanted)
    return F.array_sort(F.array_compact(F.array(*[F.when(hit(w), F.lit(label)) for label, w in lexicon.items()])))


def tag_queries(queries: DataFrame, query: str = "query", lexicon: dict = rules.QUERY_TAGS, word_boundary: bool = False) -> DataFrame:
    """One sorted array per tag set: level, field, mode, country, region, language."""
    low = F.lower(F.col(query))
    return queries.withColumns({f"{name}s" if name != "country" else "countries": tags_of(low, listed, word_boundary)
                                for name, listed in lexicon.items()})


def long_tags(tagged: DataFrame, key: str) -> DataFrame:
    """(key, tag_set, tag) rows of the tag arrays."""
    sets = ("levels", "fields", "modes", "countries", "regions", "languages")

    def labelled(name):
        return F.transform(name, lambda t: F.struct(F.lit(name).alias("tag_set"), t.alias("tag")))

    pairs = F.concat(*[labelled(name) for name in sets])
    return tagged.select(key, F.explode(pairs).alias("_t")).select(key, "_t.*")


def temporal_context(queries: DataFrame, as_of: str, query: str = "query") -> DataFrame:
    """Urgency, and the year or season a query names, relative to as_of."""
    low = F.lower(F.col(query))
    year = int(as_of[:4])
    named = F.coalesce(first_label(low, rules.SEASON_WORDS), F.lit(""))
    context = F.when(named != "", F.concat(named, F.lit(f"_{year}"))).otherwise(F.lit("unknown"))
    for y in (year + 2, year + 1, year):
        context = F.when(F.contains(low, F.lit(str(y))), F.lit(f"year_{y}")).otherwise(context)
    return queries.withColumns({"urgency": first_label(low, rules.URGENCY_LADDER, "flexible"), "year_context": context})


def specificity(tagged: DataFrame, query: str = "query", terms=rules.SPECIFIC_TERMS) -> DataFrame:
    """Mean of length, specific terms and a place; needs the countries and regions tags."""
    by_length = F.least(F.size(words(query)) / 10.0, F.lit(1.0))
    by_terms = F.least(count_words(F.lower(F.col(query)), terms) / 5.0, F.lit(1.0))
    place = F.when((F.size("countries") > 0) | (F.size("regions") > 0), 0.3).otherwise(0.0)
    return tagged.withColumn("specificity", F.round((by_length + by_terms + place) / 3, 6))


def query_profile(queries: DataFrame, query: str = "query") -> DataFrame:
    low = F.lower(F.col(query))
    return queries.withColumns({
        "depth": first_label(low, rules.DEPTH_LADDER, "overview"),
        "user_profile": first_label(low, rules.PROFILE_LADDER, "unknown"),
        "experience": first_label(low, rules.EXPERIENCE_LADDER, "intermediate")})


def _word_sets(pairs) -> Column:
    empty = F.array().cast("array<string>")
    return sorted_set(F.concat(empty, *[F.when(cond, F.array(*[F.lit(t) for t in terms])).otherwise(empty) for cond, terms in pairs]))


def expand_queries(tagged: DataFrame, query: str = "query", synonyms: dict = rules.SYNONYMS, related=rules.RELATED_TERMS,
                   domain_terms: dict = rules.DOMAIN_TERMS) -> DataFrame:
    """Synonyms of whole words, related terms and the terms of tagged fields and levels."""
    low = F.lower(F.col(query))
    own = words(low)
    by_tag = [(F.array_contains("fields" if kind == "field" else "levels", label), terms)
              for (kind, label), terms in domain_terms.items()]
    return tagged.withColumns({
        "synonyms": _word_sets([(F.array_contains(own, w), terms) for w, terms in synonyms.items()]),
        "related_terms": _word_sets([(any_word(low, trigger), terms) for trigger, terms in related]),
        "domain_terms": _word_sets(by_tag)})


def understand_queries(queries: DataFrame, as_of: str, query: str = "query", lexicon: dict = rules.QUERY_TAGS,
                       synonyms: dict = rules.SYNONYMS, related=rules.RELATED_TERMS) -> DataFrame:
    """All parts of the query context; projections only."""
    df = query_type(clean_queries(queries, query), query)
    df = guess_language(df, query).withColumnRenamed("guessed", "query_language")
    df = tag_queries(df, query, lexicon)
    df = specificity(temporal_context(df, as_of, query), query)
    return expand_queries(query_profile(df, query), query, synonyms, related)


# --------------------------------------------------------------------- intents


def analyze_intent(queries: DataFrame, query: str = "query", domains: dict = rules.WEB_DOMAINS, extra=rules.EXTRA_FOCUS,
                   intents=rules.SEARCH_INTENTS, places: DataFrame = None) -> DataFrame:
    """Focus domains, organisation types, search intent and confidence factors of a query.

    places(query_id, label, phrase) are gazetteer tags: GPE phrases become the geographic focus,
    the other labels the entity types.
    """
    low = F.lower(F.col(query))
    by_domain = {d: any_word(low, w) for d, w in domains.items()}
    focus = dict(by_domain)
    for label, trigger, _ in extra:
        focus[label] = focus.get(label, F.lit(False)) | any_word(low, trigger)
    types = [(by_domain[d], w) for d, w in domains.items()] + [(any_word(low, trigger), listed) for _, trigger, listed in extra]
    df = queries.withColumns({
        "domain_focus": F.array_sort(F.array_compact(F.array(*[F.when(hit, F.lit(d)) for d, hit in focus.items()]))),
        "organization_types": _word_sets(types)})
    fallback = (F.when(F.array_contains("domain_focus", "education"), F.lit("academic"))
                .when(F.array_contains("domain_focus", "business"), F.lit("business")).otherwise(F.lit("general")))
    df = df.withColumn("search_intent", F.coalesce(first_label(low, intents), fallback))
    if places is not None:
        found = places.groupBy("query_id").agg(
            F.array_sort(F.collect_set(F.when(F.col("label") == "GPE", F.col("phrase")))).alias("geographic_focus"),
            F.array_sort(F.collect_set(F.when(F.col("label") == "ORG", F.lit("organization"))
                                       .when(F.col("label").isin("PERSON", "MONEY", "DATE"), F.lower("label")))).alias("entity_types"))
        df = df.join(found, "query_id", "left")
    empty = F.array().cast("array<string>")
    geo = F.coalesce("geographic_focus", empty) if places is not None else empty
    ents = F.coalesce("entity_types", empty) if places is not None else empty
    df = df.withColumns({"geographic_focus": geo, "entity_types": ents})
    factor = {n: F.lit(0.0) for n in ("domain_match", "url_domain_bonus", "title_match_bonus")}
    for label, values in rules.CONFIDENCE_FACTORS.items():
        for n, v in zip(factor, values):
            factor[n] = F.when(F.col("search_intent") == label, F.lit(v)).otherwise(factor[n])
    return df.withColumn("factors", F.struct(
        F.lit(0.5).alias("base_organization"), *[c.alias(n) for n, c in factor.items()],
        F.when(F.size("geographic_focus") > 0, 0.2).otherwise(0.0).alias("geographic_match"),
        F.when(F.size("entity_types") > 0, 0.2).otherwise(0.0).alias("entity_type_match"),
        F.lit(0.2).alias("structured_data_bonus")))


def intent_patterns(intents: DataFrame, includes: dict = rules.INCLUDE_PATTERNS) -> DataFrame:
    """(query_id, use, pattern) rows: include patterns of the focus domains, excludes, and place boosts."""
    include = F.concat(*[F.when(F.array_contains("domain_focus", d), F.array(*[F.lit(p) for p in ps]))
                         .otherwise(F.array().cast("array<string>")) for d, ps in includes.items()])
    parts = F.concat(
        F.transform(include, lambda p: F.struct(F.lit("include").alias("use"), p.alias("pattern"))),
        F.transform(F.array(*[F.lit(p) for p in rules.INTENT_EXCLUDES]), lambda p: F.struct(F.lit("exclude").alias("use"), p.alias("pattern"))),
        F.transform("geographic_focus", lambda g: F.struct(F.lit("boost").alias("use"), F.concat(F.lit(r"\b"), g, F.lit(r"\b")).alias("pattern"))),
        F.when(F.array_contains("domain_focus", "education"), F.array(
            F.struct(F.lit("domain").alias("use"), F.lit(r"\.edu\b").alias("pattern")),
            F.struct(F.lit("domain").alias("use"), F.lit(r"\.ac\.").alias("pattern"))))
        .otherwise(F.array().cast("array<struct<use:string,pattern:string>>")))
    return intents.select("query_id", F.explode(F.array_distinct(parts)).alias("_p")).select("query_id", "_p.*")


def student_intent(queries: DataFrame, query: str = "query", rule_list=rules.STUDENT_INTENTS) -> DataFrame:
    """First student intent whose keyword occurs: intent, focus and its boost factors."""
    low = F.lower(F.col(query))
    hit = F.lit(None).cast("struct<student_intent:string,focus:string,boosts:map<string,double>>")
    for label, wanted, focus, boosts in reversed(list(rule_list)):
        pairs = [F.lit(x) for kv in boosts.items() for x in kv]
        hit = F.when(any_word(low, wanted), F.struct(F.lit(label).alias("student_intent"), F.lit(focus).alias("focus"),
                                                     F.create_map(*pairs).alias("boosts"))).otherwise(hit)
    return queries.withColumn("_h", hit).select("*", "_h.*").drop("_h")


def score_intents(queries: DataFrame, entities: DataFrame, query: str = "query", keywords: dict = rules.INTENT_KEYWORDS,
                  weights=rules.INTENT_ENTITY_WEIGHTS) -> DataFrame:
    """Primary intent of queries from keyword hits and weighted entity counts (query_id, kind)."""
    low = F.lower(F.col(query))
    kinds = sorted({k for k, _, _ in weights})
    counts = entities.groupBy("query_id").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds])
    df = queries.join(counts, "query_id", "left").fillna(0, [f"n_{k}" for k in kinds])
    totals = {}
    for intent, listed in keywords.items():
        total = count_words(low, listed) * 1.0
        for kind, target, w in weights:
            if target == intent:
                total = total + F.col(f"n_{kind}") * w
        totals[intent] = F.round(total, 6)
    df = df.withColumns({f"s_{i}": t for i, t in totals.items()})
    top = F.greatest(*[F.col(f"s_{i}") for i in totals])
    primary = F.lit(None).cast("string")
    for i in reversed(list(totals)):
        primary = F.when(F.col(f"s_{i}") == top, F.lit(i)).otherwise(primary)
    return (df.withColumn("confidence", top)
            .withColumn("primary_intent", F.when(F.col("confidence") > 0, primary).otherwise(F.lit("general"))))
