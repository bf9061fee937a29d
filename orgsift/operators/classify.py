"""Filters, predicates and classifiers.  Predicates are column functions, the rest map tables."""

from pyspark.sql import Column, DataFrame, functions as F

from .. import rules
from ..functions.text import (any_pattern, any_word, as_col, capitalised, count_words, first_label, once, words)
from ..functions.url import homepage, host, is_crawlable as _crawlable

# ------------------------------------------------------------------- predicates


def _half_capitalised(c) -> Column:
    n = F.size(words(c))
    return (n < 2) | (capitalised(c) >= n * 0.5)


def is_institution_strict(c, keywords=rules.INSTITUTION_KEYWORDS, rejects=rules.STRICT_NAME_REJECTS) -> Column:
    c = as_col(c)
    low = F.lower(F.trim(c))
    named = low.rlike(rf"\b({'|'.join(keywords)})\b")
    return (F.length(c).between(5, 100) & ~any_pattern(low, rejects) & named & (capitalised(c, 3) >= 2))


def is_institution(c, indicators=rules.LENIENT_INDICATORS, rejects=rules.LENIENT_REJECTS) -> Column:
    c = as_col(c)
    low = F.lower(F.trim(c))
    return ((F.length(F.trim(c)) >= 3) & any_word(low, indicators) & ~any_pattern(low, rejects) & _half_capitalised(c))


def is_extracted_institution(c) -> Column:
    """Like is_institution, with the wider indicator list and the cleaner's exclusions."""
    return is_institution(c, rules.STRONG_INDICATORS + rules.SPECIALIZED_INDICATORS, rules.NAME_REJECTS)


def is_valid_name(c) -> Column:
    c = as_col(c)
    return (F.length(c).between(5, 120) & ~c.rlike(r"^[\d\s\-.,]+$") & c.rlike("[a-zA-Z]")
            & ~F.lower(c).rlike("^https?://"))


def is_spam(c, patterns=rules.NAME_SPAM) -> Column:
    """Spam phrases, URL-like starts, long digit runs, or one word making up more than half of the text."""
    c = as_col(c)
    low = F.lower(c)
    w = words(low)
    n = F.size(w)
    # a word that fills more than half of a sorted list sits in its middle
    middle = F.get(F.sort_array(w), F.floor(n / 2).cast("int"))
    most = n - F.size(F.array_remove(w, middle))
    return (c.isNull() | (c == "") | any_pattern(low, patterns, flags="")
            | ((n > 1) & (most > F.floor(n / 2))))


def is_academic(url, text, url_patterns=rules.ACADEMIC_URL_PATTERNS, text_patterns=rules.ACADEMIC_TEXT_PATTERNS) -> Column:
    low = F.lower(as_col(url))
    both = F.concat_ws(" ", low, F.lower(as_col(text)))
    return any_pattern(low, url_patterns) | any_pattern(both, text_patterns)


def is_crawl_excluded(url, text, patterns=rules.CRAWL_EXCLUDES) -> Column:
    return any_pattern(F.concat_ws(" ", F.lower(as_col(url)), F.lower(as_col(text))), patterns)


def is_crawlable(c, skipped=rules.SKIPPED_EXTENSIONS, social=rules.SOCIAL_HOSTS) -> Column:
    return _crawlable(c, skipped, social)


def is_institution_link(href, text, hosts=(".edu", ".ac.", "university.", "college."),
                        url_words=("university", "college", "institute", "academic"),
                        text_words=("university", "college", "institute")) -> Column:
    low = F.lower(as_col(href))
    return any_word(low, hosts) | any_word(low, url_words) | any_word(F.lower(as_col(text)), text_words)


def matches_include(c, domains, patterns=rules.INCLUDE_PATTERNS) -> Column:
    """An include pattern of a focus domain hits; no pattern at all lets everything through."""
    c, domains = as_col(c), as_col(domains)
    hit, has_any = F.lit(False), F.lit(False)
    for domain, listed in patterns.items():
        focus = F.array_contains(domains, domain)
        has_any = has_any | focus
        hit = hit | (focus & any_pattern(F.lower(c), listed))
    return ~has_any | hit


# ------------------------------------------------------------ filters on tables


def exclude_rows(df: DataFrame, column: str, patterns=rules.INTENT_EXCLUDES) -> DataFrame:
    return df.filter(~any_pattern(F.lower(F.trim(column)), patterns))


def filter_by_confidence(df: DataFrame, least: float, column: str = "confidence") -> DataFrame:
    return df.filter(F.col(column) >= least)


def quality_filter(df: DataFrame, least: float = 0.5, patterns=rules.NAME_SPAM) -> DataFrame:
    return df.filter((F.col("confidence") >= least) & (F.length("name") >= 3) & ~is_spam("name", patterns))


def finalize_names(df: DataFrame, min_confidence: float = 0.6, min_quality: float = 0.5, generic=rules.GENERIC_TERMS) -> DataFrame:
    """Gate by confidence and quality, drop generic words, flag verified names."""
    ok = ((F.col("confidence") >= min_confidence) & (F.col("quality") >= min_quality) & is_valid_name("name")
          & (F.col("confidence") >= 0.5) & ~F.lower(F.trim("name")).isin(*generic))
    return df.filter(ok).withColumns({
        "is_verified": (F.col("confidence") >= 0.8) & (F.col("quality") >= 0.7),
        "total": F.round(F.col("confidence") + F.col("quality"), 6)})


def filter_country(df: DataFrame, country: str, hints=rules.COUNTRY_HINTS, columns=("name", "source_url", "official_url")) -> DataFrame:
    """Rows that mention the country, stamped with it; a country without hints keeps all rows."""
    wanted = hints.get(country.lower(), ())
    if not wanted:
        return df
    text = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in columns]))
    return df.filter(any_word(text, wanted)).withColumn("country", F.lit(country))


def classify_content(df: DataFrame, title: str, ladder=rules.CONTENT_LADDER) -> DataFrame:
    """Content class of titles that are no organisation; unclassified ones are dropped."""
    return df.withColumn("content_type", first_label(F.lower(F.col(title)), ladder)).filter("content_type is not null")


def apply_rules(df: DataFrame, name: str, confidence: str = None, rule_list=rules.RECLASSIFY_RULES,
                least: float = rules.RECLASSIFY_MIN_CONFIDENCE) -> DataFrame:
    """First rule that hits gives category and rule name; a low score is the last rule."""
    low = F.lower(F.trim(F.col(name)))
    hit = F.lit(None).cast("struct<rule:string,category:string>")
    if confidence is not None:
        hit = F.when(F.col(confidence) < least, F.struct(F.lit("low_confidence").alias("rule"), F.lit("low_confidence").alias("category")))
    for rule, pattern, category in reversed(list(rule_list)):
        hit = F.when(low.rlike(pattern), F.struct(F.lit(rule).alias("rule"), F.lit(category).alias("category"))).otherwise(hit)
    return df.withColumn("_hit", hit).withColumns({"rule": F.col("_hit.rule"), "category": F.col("_hit.category")}).drop("_hit")


# --------------------------------------------------------------------- org types


def org_type(name, url, ladder=rules.ACADEMIC_TYPE_LADDER, default="academic_organization") -> Column:
    both = F.concat_ws(" ", F.lower(as_col(name)), F.lower(as_col(url)))
    return first_label(both, ladder, default)


def static_type(name) -> Column:
    low = F.lower(as_col(name))
    return (F.when(any_word(low, rules.INSTITUTION_WORDS), F.lit("university"))
            .when(any_word(low, rules.RESEARCH_WORDS), F.lit("research_center")).otherwise(F.lit("")))


def intent_type(name, url, domains, ladder=rules.INTENT_TYPE_LADDER) -> Column:
    """The type ladder of each focus domain in turn."""
    both = F.concat_ws(" ", F.lower(as_col(name)), F.lower(as_col(url)))
    out = F.lit("organization")
    for domain, rungs in reversed(list(ladder)):
        out = F.when(F.array_contains(as_col(domains), domain), F.coalesce(first_label(both, rungs), out)).otherwise(out)
    return out


# ---------------------------------------------------------------------- homepages


def validate_homepages(pages: DataFrame, indicators=rules.HOMEPAGE_INDICATORS, non_org=rules.NON_ORGANISATION_WORDS,
                       academic_host=rules.HOMEPAGE_ACADEMIC_HOST, research_host=rules.HOMEPAGE_RESEARCH_HOST,
                       title_words=rules.HOMEPAGE_TITLE_WORDS, about=rules.HOMEPAGE_ABOUT,
                       contact=rules.HOMEPAGE_CONTACT) -> DataFrame:
    """Verdict for pages(url, title, description, main_text): organisation or not, type, score, reason."""
    df = once(pages, _t=F.lower(F.concat_ws(" ", "title", "description", "main_text")), _host=host("url"))
    df = once(df, _non=count_words("_t", non_org), **{f"_s_{kind}": count_words("_t", listed) for kind, listed in indicators})
    top = F.greatest(*[F.col(f"_s_{kind}") for kind, _ in indicators])
    kind = F.lit(indicators[-1][0])
    for label, _ in reversed(list(indicators)):
        kind = F.when(F.col(f"_s_{label}") == top, F.lit(label)).otherwise(kind)
    bonus = (F.when(any_word("_host", academic_host), 2.0).otherwise(0.0)
             + F.when(any_word("_host", research_host), 1.0).otherwise(0.0)
             + F.when(any_word(F.lower("title"), title_words), 1.0).otherwise(0.0)
             + F.when(any_word("_t", about), 1.0).otherwise(0.0)
             + F.when(any_word("_t", contact), 0.5).otherwise(0.0))
    df = once(df, _top=top, _bonus=bonus, _kind=F.when(any_word("_host", academic_host), F.lit("university")).otherwise(kind))
    score = F.col("_top") + F.col("_bonus")
    rejected, is_org = F.col("_non") >= 2, score >= 2.0
    return df.withColumns({
        "is_organization": ~rejected & is_org,
        "validation_score": F.when(rejected, F.lit(0.1)).otherwise(F.least(score / 5.0, F.lit(1.0))),
        "organization_type": F.when(~rejected & is_org, F.col("_kind")).otherwise(F.lit("non_organization")),
        "reason": F.when(rejected, F.format_string("Contains %d non-organization indicators", "_non")).otherwise(
            F.format_string("Score: %.1f, indicators for %s: %d, bonus: %.1f", score, "_kind", "_top", "_bonus")),
    }).drop("_t", "_non", "_host", "_top", "_bonus", "_kind", *[f"_s_{k}" for k, _ in indicators])


def attach_verdicts(orgs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Each homepage is judged once; organisations meet the verdict through their homepage URL."""
    v = verdicts.select(F.col("url").alias("homepage_url"), "is_organization", "validation_score",
                        "organization_type", "reason", F.col("title").alias("homepage_title"),
                        F.col("description").alias("homepage_description"))
    joined = orgs.withColumn("homepage_url", homepage("url")).join(v.hint("merge"), "homepage_url", "left")
    return joined.withColumns({
        "is_organization": F.coalesce("is_organization", F.lit(False)),
        "validation_score": F.coalesce("validation_score", F.lit(0.0)),
        "organization_type": F.coalesce("organization_type", F.lit("unknown")),
        "reason": F.coalesce("reason", F.lit("Failed to access homepage"))})


def split_validated(joined: DataFrame, least: float = 0.3):
    """(validated, reclassified): validated rows take URL, type, name and text of their homepage."""
    ok = F.col("is_organization") & (F.col("validation_score") >= least)
    extra = ("is_organization", "validation_score", "organization_type", "reason", "homepage_title",
             "homepage_description", "homepage_url")
    valid = joined.filter(ok).withColumns({
        "url": F.col("homepage_url"),
        "confidence": F.greatest(F.coalesce("confidence", F.lit(0.0)), "validation_score"),
        "org_type": F.col("organization_type"),
        "name": F.coalesce(F.nullif("homepage_title", F.lit("")), "name"),
        "description": F.coalesce(F.nullif("homepage_description", F.lit("")), "description")}).drop(*extra)
    rest = joined.filter(~ok).withColumns({
        "reason_for_reclassification": F.col("reason"), "rule_triggered": F.lit("homepage_validation_failed")}).drop(
        "is_organization", "organization_type", "reason", "homepage_title", "homepage_description")
    return valid, rest


def names_to_orgs(names: DataFrame) -> DataFrame:
    return names.select(
        "name", F.coalesce(F.nullif("official_url", F.lit("")), "source_url").alias("url"),
        F.lit("university").alias("org_type"), "source_url", "confidence", "method",
        F.concat(F.lit("University discovered via "), "method").alias("description"))


def gate_candidates(cands: DataFrame, intents: DataFrame = None, name: str = "name", url: str = "target",
                    excludes=rules.INTENT_EXCLUDES) -> DataFrame:
    """Length and exclusion gate, then the intent-driven or the static score; kept from 0.5 on."""
    from .score import dynamic_confidence, static_confidence
    clean = F.trim(F.col(name))
    gated = cands.filter(F.length(clean).between(3, 150) & ~any_pattern(F.lower(clean), excludes))
    if intents is not None:
        scored = dynamic_confidence(gated.join(intents, "query_id"), name, url).withColumn(
            "org_type", intent_type(name, url, "domain_focus"))
    else:
        scored = gated.withColumns({"confidence": static_confidence(name), "org_type": static_type(name)})
    return scored.filter(F.col("confidence") >= 0.5)
