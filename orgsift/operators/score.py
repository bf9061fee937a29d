"""Scores of candidates, names, sources and entity sets.  All are sums of native conditions."""

from pyspark.sql import Column, DataFrame, functions as F

from .. import rules
from ..functions.text import (any_pattern, any_word, as_col, capital_ratio, capitalised, count_words, has, once, words)
from .classify import is_institution, is_institution_link


def _points(condition: Column, value: float) -> Column:
    return F.when(condition, F.lit(value)).otherwise(F.lit(0.0))


def _cap(score: Column, top: float = 1.0) -> Column:
    return F.round(F.least(score, F.lit(top)), 6)


def _in_focus(domains: Column, wanted: dict, test) -> Column:
    hit = F.lit(False)
    for domain, listed in wanted.items():
        hit = hit | (F.array_contains(domains, domain) & test(listed))
    return hit


def _named_place(text: Column, places) -> Column:
    return F.coalesce(F.exists(as_col(places), lambda p: F.contains(text, F.lower(p))), F.lit(False))


def _factor(intent: Column, which: int) -> Column:
    out = F.lit(0.0)
    for label, values in rules.CONFIDENCE_FACTORS.items():
        out = F.when(intent == label, F.lit(values[which])).otherwise(out)
    return out


def dynamic_confidence(df: DataFrame, name: str, url: str, description: str = None, tagged: Column = None,
                       domains: dict = rules.WEB_DOMAINS, includes: dict = rules.INCLUDE_PATTERNS,
                       academic_parts=(".edu", ".ac.", ".university"), out: str = "confidence") -> DataFrame:
    """Confidence from the factors of the query intent (domain_focus, geographic_focus, search_intent)."""
    parts = [F.lower(F.col(name)), F.lower(F.col(url)), F.lower(F.col(description)) if description else F.lit("")]
    df = once(df, _text=F.concat_ws(" ", *parts))
    focus, intent = F.col("domain_focus"), F.col("search_intent")
    score = (F.lit(0.5)
             + F.when(_in_focus(focus, domains, lambda w: any_word("_text", w)), _factor(intent, 0)).otherwise(0.0)
             + _points(_named_place(F.col("_text"), "geographic_focus"), 0.2)
             + F.when((intent == "academic") & any_word(F.lower(F.col(url)), academic_parts), _factor(intent, 1)).otherwise(0.0)
             + F.when(_in_focus(focus, includes, lambda p: any_pattern(F.lower(F.col(name)), p)), _factor(intent, 2)).otherwise(0.0))
    if tagged is not None:
        score = score + _points(tagged, 0.2)
    return once(df, **{out: _cap(score)}).drop("_text")


def static_confidence(name, tagged: Column = None, institution=rules.INSTITUTION_WORDS, research=rules.RESEARCH_WORDS) -> Column:
    """Keyword, tag and capital points; not capped."""
    low = F.lower(as_col(name))
    score = F.when(any_word(low, institution), 0.8).when(any_word(low, research), 0.7).otherwise(0.0)
    if tagged is not None:
        score = score + _points(tagged, 0.6)
    return F.round(score + _points(capitalised(name, 3) >= 2, 0.3), 6)


def academic_confidence(df: DataFrame, name: str, url: str, out: str = "confidence", rejects=rules.SCORE_REJECTS,
                        shapes=rules.SCORE_SHAPES, hosts=rules.SCORE_HOSTS, keywords=rules.INSTITUTION_KEYWORDS,
                        compat: bool = True) -> DataFrame:
    """Strict score of an institution name.  compat=False ends the prefix rejects at a word end."""
    if not compat:
        rejects = tuple(r + r"\b" if r.startswith("^(") and r.endswith(")") else r for r in rejects)
    n, low = F.col(name), F.lower(F.trim(F.col(name)))
    df = once(df, _host_ok=any_pattern(F.lower(F.col(url)), hosts, flags=""), _rejected=any_pattern(low, rejects))
    base = (F.when(any_pattern(n, shapes, flags=""), 0.6)
            .when(any_word(low, keywords) & ~any_word(low, ("best", "top", "list", "guide")), 0.3).otherwise(0.0)
            + _points(F.col("_host_ok"), 0.4)
            + _points((F.size(words(n)) >= 2) & (capitalised(n, 3) >= 2), 0.2))
    reads_like_text = ((F.length(n) > 100) | (F.size(F.split(n, ",")) > 3) | has(n, ":") | has(n, " - ")
                       | F.endswith(n, F.lit("?")) | low.rlike("^(how|what|why|when|where) "))
    df = once(df, _base=F.round(base, 6))
    good = ~F.col("_rejected") & (F.col("_base") >= 0.5) & ~reads_like_text
    score = F.when(good, F.least(F.col("_base") + _points(F.col("_host_ok"), 0.1), F.lit(1.0))).otherwise(0.0)
    return df.withColumn(out, F.round(score, 6)).drop("_host_ok", "_rejected", "_base")


def crawl_confidence(text, url, keywords=rules.INSTITUTION_WORDS, hosts=(".edu", ".ac."), context=rules.ACADEMIC_CONTEXT_WORDS) -> Column:
    low, low_url = F.lower(as_col(text)), F.lower(as_col(url))
    return _cap(count_words(low, keywords) * 0.3 + count_words(low_url, keywords) * 0.2
                + _points(any_word(low_url, hosts), 0.4)
                + _points((F.size(words(text)) >= 2) & (capitalised(text) >= 2), 0.2)
                + _points(any_word(low, context), 0.1))


def weighted_score(indicators: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    """indicators(key, indicator, count) against weights(indicator, weight): capped share of the weights hit."""
    joined = indicators.join(weights, "indicator", "left").withColumn("_w", F.coalesce("weight", F.lit(0.0)))
    sums = joined.groupBy(key).agg(F.sum(F.least("count", F.lit(3)) * F.col("_w")).alias("_s"), F.sum("_w").alias("_t"))
    return sums.select(key, F.when(F.col("_t") > 0, _cap(F.col("_s") / F.col("_t"))).otherwise(0.0).alias("score"))


def entity_matches_of(df: DataFrame, name: str, domains: dict = rules.ACADEMIC_DOMAINS) -> Column:
    """domain:, location: and org_type: labels of the intent that a name shows."""
    low = F.lower(F.col(name))
    by_domain = [F.when(F.array_contains("domain_focus", d) & any_word(low, w), F.lit(f"domain:{d}")) for d, w in domains.items()]
    places = F.transform(F.filter("geographic_focus", lambda p: F.contains(low, F.lower(p))), lambda p: F.concat(F.lit("location:"), p))
    types = F.transform(F.filter("organization_types", lambda t: F.contains(low, t)), lambda t: F.concat(F.lit("org_type:"), t))
    return F.array_sort(F.array_distinct(F.concat(F.array_compact(F.array(*by_domain)), places, types)))


def org_relevance(df: DataFrame, domains: dict = rules.ACADEMIC_DOMAINS, out: str = "relevance") -> DataFrame:
    """0.2 per entity match, 0.3 per keyword of a focus domain, 0.2 per place named; capped."""
    text = F.lower(F.concat_ws(" ", "name", "org_type"))
    hits = F.lit(0)
    for d, listed in domains.items():
        hits = hits + F.when(F.array_contains("domain_focus", d), count_words(text, listed)).otherwise(0)
    places = F.size(F.filter("geographic_focus", lambda p: F.contains(text, F.lower(p))))
    return df.withColumn(out, _cap(F.size("entity_matches") * 0.2 + hits * 0.3 + places * 0.2))


def intent_relevance(df: DataFrame, domains: dict = rules.WEB_DOMAINS, out: str = "relevance") -> DataFrame:
    """Older relevance: half the confidence, 0.1 per match, 0.2 per domain and 0.15 per place named."""
    low = F.lower(F.col("name"))
    text = F.concat_ws(" ", low, F.lower(F.coalesce("description", F.lit(""))))
    matched = F.size(F.filter("entity_types", lambda t: F.contains(low, t)))
    for d, listed in domains.items():
        matched = matched + (F.array_contains("domain_focus", d) & any_word(low, listed)).cast("int")
    matched = matched + F.size(F.filter("geographic_focus", lambda p: F.contains(low, F.lower(p))))
    named = F.size(F.filter("domain_focus", lambda d: F.contains(text, d)))
    places = F.size(F.filter("geographic_focus", lambda p: F.contains(text, F.lower(p))))
    return df.withColumn(out, _cap(F.col("confidence") * 0.5 + matched * 0.1 + named * 0.2 + places * 0.15))


def older_confidence(df: DataFrame, name: str, url: str, description: str = None, excludes=rules.INTENT_EXCLUDES,
                     compat: bool = True, out: str = "confidence") -> DataFrame:
    """Intent confidence without the tag bonus; an exclude pattern sets it to 0.

    compat tests the include patterns as plain text without their marks, so the title bonus hardly ever fires.
    """
    if compat:
        plain = {d: tuple(p.replace("\\b", "").replace("(", "").replace(")", "") for p in ps) for d, ps in rules.INCLUDE_PATTERNS.items()}
        literal = {d: tuple(r"\Q" + p + r"\E" for p in ps) for d, ps in plain.items()}
        df = dynamic_confidence(df, name, url, description, includes=literal, out=out)
    else:
        df = dynamic_confidence(df, name, url, description, out=out)
    return df.withColumn(out, F.when(any_pattern(F.lower(F.col(name)), excludes), 0.0).otherwise(F.col(out)))


def entity_boost(df: DataFrame, name: str = "name", method: str = "method", out: str = "confidence") -> DataFrame:
    """Raise confidence for names that contain entities of the query (arrays q_university, q_program, q_scholarship)."""
    low = F.lower(F.col(name))

    def named(column):
        return F.coalesce(F.exists(F.col(column), lambda t: F.contains(low, t)), F.lit(False))

    score = (F.col("confidence") + _points(named("q_university"), 0.2) + _points(named("q_program"), 0.15)
             + _points(named("q_scholarship"), 0.15) + _points(F.startswith(method, F.lit("ner")), 0.1))
    return df.withColumn(out, _cap(score))


def name_quality(c, indicators=rules.STRONG_INDICATORS) -> Column:
    c = as_col(c)
    n, w = F.length(c), F.size(words(c))
    by_length = F.when(n.between(15, 80), 0.3).when(n.between(10, 100), 0.2).otherwise(0.1)
    by_words = F.when(w.between(2, 6), 0.3).when((w == 1) | (w > 6), 0.1).otherwise(0.0)
    score = by_length + by_words + capital_ratio(c) * 0.2 + F.least(count_words(F.lower(c), indicators) * 0.1, F.lit(0.2))
    return F.when(F.length(c) > 0, _cap(score)).otherwise(0.0)


def pattern_confidence(base, found, context, context_words=rules.PATTERN_CONTEXT_WORDS) -> Column:
    spaces = F.length(found) - F.length(F.replace(as_col(found), F.lit(" "), F.lit("")))
    return _cap(as_col(base) + _points((F.length(found) > 10) & (spaces >= 2), 0.05)
                + count_words(F.lower(as_col(context)), context_words) * 0.02)


def tagged_confidence(name, context, context_words=rules.TAGGED_CONTEXT_WORDS, indicators=rules.STRONG_INDICATORS) -> Column:
    """Confidence of a gazetteer name: 0.7, more for several words, an indicator and the words around."""
    return _cap(F.lit(0.7) + _points((F.length(name) > 5) & has(name, " "), 0.1)
                + _points(any_word(F.lower(as_col(name)), indicators), 0.15)
                + count_words(F.lower(as_col(context)), context_words) * 0.05)


def list_quality(text, href) -> Column:
    return _cap(F.lit(0.6) + _points(F.length(as_col(text)).between(10, 80), 0.2)
                + _points((F.length(as_col(href)) > 0) & is_institution_link(href, text), 0.2))


def table_quality(header_named) -> Column:
    return _cap(F.lit(0.5) + _points(F.coalesce(as_col(header_named), F.lit(False)), 0.3))


def heading_quality(level) -> Column:
    return _cap(F.lit(0.4) + (F.lit(6) - as_col(level)) * 0.1)


def link_quality(href, text) -> Column:
    return _cap(F.lit(0.3) + _points(any_word(F.lower(as_col(href)), (".edu", ".ac.")), 0.4) + _points(is_institution(text), 0.3))


def score_sources(results: DataFrame, tiers=rules.SOURCE_TIERS, listings=rules.SOURCE_LISTINGS, content=rules.SOURCE_CONTENT,
                  keywords=rules.SOURCE_KEYWORDS, path_words=rules.SOURCE_PATH_WORDS, list_words=rules.SOURCE_LIST_WORDS) -> DataFrame:
    """score and source_type of results(url, title, abstract): host tier + content + URL words."""
    url = F.lower("url")
    df = once(results, _text=F.lower(F.concat_ws(" ", "title", "abstract")))
    listed, listed_type = F.lit(0.0), F.lit("general")
    for label, value, parts in listings:
        hit = any_word(url, parts)
        listed = F.greatest(listed, _points(hit, value))
        listed_type = F.when(hit, F.lit(label)).otherwise(listed_type)
    host_score, host_type = listed, listed_type
    for label, value, parts in reversed(list(tiers)):
        host_score = F.when(any_word(url, parts), F.lit(value)).otherwise(host_score)
        host_type = F.when(any_word(url, parts), F.lit(label)).otherwise(host_type)
    content_score, content_type = F.lit(0.0), F.lit("general")
    for label, value, patterns in content:
        hit = any_pattern("_text", patterns, flags="")
        content_score = F.greatest(content_score, _points(hit, value))
        content_type = F.when(hit, F.lit(label)).otherwise(content_type)
    content_score = content_score + F.least(count_words("_text", keywords) * 0.1, F.lit(0.3))
    url_score = F.least(count_words(url, path_words) * 0.1 + count_words(url, list_words) * 0.05, F.lit(0.5))
    return (once(df, _h=host_score, _ht=host_type, _c=content_score, _ct=content_type, _u=url_score)
            .withColumns({"score": F.round(F.col("_h") + F.col("_c") + F.col("_u"), 6),
                          "source_type": F.when(F.col("_ct") != "general", F.col("_ct")).otherwise(F.col("_ht"))})
            .drop("_text", "_h", "_ht", "_c", "_ct", "_u"))


def entity_set_quality(entities: DataFrame, key: str, required=rules.COMPLETENESS_FIELDS) -> DataFrame:
    """Diversity, volume, completeness and their mean for entities(key, kind, completeness)."""
    complete = F.when(F.col("kind").isin(*required), F.col("completeness"))
    kinds = entities.groupBy(key, "kind").agg(F.count(F.lit(1)).alias("_n"), F.sum(complete).alias("_c"), F.count(complete).alias("_m"))
    sums = kinds.groupBy(key).agg(F.count(F.lit(1)).alias("kinds"), F.sum("_n").alias("entities"),
                                  F.sum("_c").alias("_c"), F.sum("_m").alias("_m"))
    parts = sums.select(key, "kinds", "entities",
                        F.least(F.lit(1.0), F.col("kinds") * 0.3).alias("diversity"),
                        F.least(F.lit(1.0), F.col("entities") / 10.0).alias("volume"),
                        F.when(F.col("_m") > 0, F.col("_c") / F.col("_m")).otherwise(0.0).alias("completeness"))
    return parts.withColumn("quality", F.round((F.col("diversity") + F.col("volume") + F.col("completeness")) / 3, 6))
