"""Relevance of search results to queries, entity matches, ranking and diversity."""

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import rules
from ..functions.text import any_word, as_col, count_words, key_core, once, words
from ..functions.url import host
from ..session import written
from .ordering import spread_row_number

# ------------------------------------------------------------ component scores


def _share(text: Column, terms) -> Column:
    terms = as_col(terms)
    return F.when(F.size(terms) > 0, F.size(F.filter(terms, lambda t: F.contains(text, t))) / F.size(terms)).otherwise(0.0)


def _listed_share(text: Column, tags: str, lists: dict) -> Column:
    """Sum over the tags in the array of the share of their words in the text."""
    total = F.lit(0.0)
    for label, listed in lists.items():
        total = total + F.when(F.array_contains(tags, label), count_words(text, listed) / float(len(listed))).otherwise(0.0)
    return total


def _semantic(text: Column, fields: dict) -> Column:
    direct = _share(text, F.array_distinct(words("cleaned_query")))
    field = F.least(_listed_share(text, "fields", fields) * 0.7, F.lit(1.0))
    return (direct + _share(text, "synonyms") * 0.8 + _share(text, "related_terms") * 0.6 + field) / 4


def _authority(url: Column, title: Column, suffixes, patterns, title_words) -> Column:
    tier = F.lit(0.0)
    for suffix, value in reversed(list(suffixes)):
        tier = F.when(F.contains(url, F.lit("." + suffix)), F.lit(value * 0.4)).otherwise(tier)
    score = tier
    for pattern, value in patterns:
        score = score + F.when(url.rlike(pattern), F.lit(value)).otherwise(0.0)
    score = score + F.least(count_words(title, title_words) * 0.1, F.lit(0.3))
    return F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))


def _geographic(text: Column, url: Column, codes: dict) -> Column:
    spaced = lambda arr: F.transform(arr, lambda c: F.replace(c, F.lit("_"), F.lit(" ")))
    in_url = F.lit(0.0)
    for country, code in codes.items():
        in_url = in_url + F.when(F.array_contains("countries", country) & F.contains(url, F.lit("." + code)), 0.8).otherwise(0.0)
    wanted = _share(text, spaced("countries")) * 0.7 + _share(text, spaced("regions")) * 0.5 + in_url
    return F.when((F.size("countries") == 0) & (F.size("regions") == 0), 0.5).otherwise(F.least(wanted, F.lit(1.0)))


def _level(text: Column, lists: dict) -> Column:
    return F.when(F.size("levels") == 0, 0.5).otherwise(
        F.least(_listed_share(text, "levels", lists) / F.size("levels"), F.lit(1.0)))


def _temporal(text: Column, year: int) -> Column:
    years = F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\p{N}_])(202[0-9])(?![\p{L}\p{N}_])"), F.lit(1))
    recent = F.exists(years, lambda y: y.cast("int") >= year - 1)
    urgent = (F.col("urgency") == "immediate") & any_word(text, rules.URGENT_WORDS)
    return F.least(F.when(recent, 0.7).otherwise(0.3) + F.when(urgent, 0.3).otherwise(0.0), F.lit(1.0))


def _comprehensive(text: Column) -> Column:
    depth = F.lit(0.0)
    for label, listed in rules.DEPTH_WORDS.items():
        depth = F.when(F.col("depth") == label, count_words(F.lower(text), listed) * 0.2).otherwise(depth)
    return (F.least(F.length(text) / 500.0, F.lit(1.0)) + F.least(depth, F.lit(1.0))) / 2


def _profile(text: Column) -> Column:
    out = F.lit(0.5)
    for label, listed in rules.PROFILE_WORDS.items():
        out = F.when(F.col("user_profile") == label, count_words(text, listed) / float(len(listed))).otherwise(out)
    return out


def rank_components(results: DataFrame, contexts: DataFrame, as_of: str, entity_scores: DataFrame = None,
                    suffixes=rules.AUTHORITY_SUFFIXES, url_patterns=rules.AUTHORITY_URL_PATTERNS,
                    title_words=rules.AUTHORITY_WORDS, fields=rules.RANK_FIELD_WORDS, codes=rules.COUNTRY_CODES) -> DataFrame:
    """Eight component scores, weighted sum, confidence and notes of results(query_id, url, title, abstract).

    Every result meets only the context of its own query.
    """
    df = results.join(contexts.drop("query").hint("merge"), "query_id")
    raw = F.concat_ws(" ", "title", "abstract")
    df = once(df, _raw=raw, _text=F.lower(raw), _url=F.lower("url"))
    text, url, title = F.col("_text"), F.col("_url"), F.lower("title")
    six = lambda c: F.round(c, 6)
    df = once(df, semantic_alignment=six(_semantic(text, fields)),
              authority=six(_authority(url, title, suffixes, url_patterns, title_words)),
              geographic_relevance=six(_geographic(F.concat_ws(" ", url, text), F.col("url"), codes)))
    df = once(df, level_appropriateness=six(_level(text, rules.RANK_LEVEL_WORDS)),
              temporal_relevance=six(_temporal(text, int(as_of[:4]))),
              comprehensiveness=six(_comprehensive(F.col("_raw"))), profile_alignment=six(_profile(text))).drop("_raw", "_url", "_text")
    if entity_scores is not None:  # joined when texts and contexts have been read, so they need not travel again
        df = df.join(entity_scores.select("query_id", "url", F.col("relevance").alias("ner_relevance")).hint("merge"), ["query_id", "url"], "left")
        df = df.withColumn("ner_relevance", F.coalesce("ner_relevance", F.lit(0.0)))
    present = [(n, w) for n, w in rules.RELEVANCE_WEIGHTS if n != "ner_relevance" or entity_scores is not None]
    overall, strong = F.lit(0.0), F.lit(0)
    for n, w in present:
        overall = overall + F.col(n) * w
        strong = strong + (F.col(n) > 0.6).cast("int")
    notes = [F.when(F.col(n) > limit, F.format_string(label + " (%.2f)", n)) for n, limit, label in rules.RELEVANCE_NOTES
             if n in [p for p, _ in present]]
    return df.withColumns({"overall": F.round(overall, 8), "confidence": six(strong / float(len(present))),
                           "notes": F.array_compact(F.array(*notes))})


def attach_scores(results: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores onto results; a result without one gets 0.3 with no confidence."""
    s = scores.select("query_id", "url", F.col("overall").alias("recognition_score"), F.col("confidence"), F.col("priority").alias("priority_score"))
    return results.join(s.hint("merge"), ["query_id", "url"], "left").withColumns({
        "recognition_score": F.coalesce("recognition_score", F.lit(0.3)),
        "confidence": F.coalesce("confidence", F.lit(0.0)),
        "priority_score": F.coalesce("priority_score", F.lit(0.3))})


def priority_score(ranked: DataFrame, boosts=rules.PRIORITY_TYPE_BOOSTS, levels=rules.PRIORITY_LEVEL_WORDS,
                   profiles=rules.PRIORITY_PROFILE_WORDS) -> DataFrame:
    """Overall score plus type, level, place and profile boosts, at most 1."""
    near = F.concat(F.lower("url"), F.lower("title"))
    text = F.lower(F.concat_ws(" ", "title", "abstract"))
    kind = F.lit(0.0)
    for label, listed, value in boosts:
        kind = F.when((F.col("query_type") == label) & any_word(near, listed), F.lit(value)).otherwise(kind)
    level = F.lit(0.0)
    for label, listed in levels.items():
        level = level + F.when(F.array_contains("levels", label) & any_word(text, listed), 0.1).otherwise(0.0)
    place = F.exists("countries", lambda c: F.contains(text, F.replace(c, F.lit("_"), F.lit(" ")))
                     | F.contains(text, F.replace(c, F.lit("_"), F.lit(""))))
    profile = F.lit(0.0)
    for label, listed in profiles.items():
        profile = F.when((F.col("user_profile") == label) & any_word(text, listed), 0.1).otherwise(profile)
    score = F.col("overall") + kind + F.least(level, F.lit(0.2)) + F.when(place, 0.15).otherwise(0.0) + profile
    return once(ranked, priority=F.round(F.least(score, F.lit(1.0)), 8))


# ------------------------------------------------------------------ entity overlap
#
# Two entity texts match when one contains the other.  The texts of a query with at most _FEW of them go
# to its results as one short array.  The texts of a result stay in one array, so its address travels once
# and not with each of them, and nothing leaves the query before its sums are made.  Larger queries meet by
# pieces: a contained text of four letters or more starts with a four-letter piece of the containing text,
# so texts meet on (query, piece) and not all against all; shorter texts meet on pieces of their own length.
# Only queries that have a text to contain send their texts into the join, and only where there are larger
# queries are the texts of results written, as several branches read them.  Joins are asked for by sorted
# shuffles: texts that are made from a small file look small to Spark as well, and would go whole through
# the driver.

_GRAM = 4
_FEW = 64


def _pieces(text: Column, sizes) -> Column:
    """Distinct pieces of the given sizes."""
    n = F.length(text)
    cut = [F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(k))) for k in sizes]
    return F.array_distinct(F.concat(*cut))


def contained_pairs(left: DataFrame, right: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """Distinct (group, a, b) where one text contains the other; left has (group, a), right has (group, b).

    A group whose left side has at most _FEW texts meets them in place, others by their pieces.
    """
    left, right = left.select(group, a).distinct(), right.select(group, b).distinct()
    sizes = left.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    few = left.join(sizes.where(F.col("_n") <= _FEW).hint("merge"), group).groupBy(group).agg(F.collect_list(a).alias("_texts"))
    met = F.filter("_texts", lambda t: F.contains(F.col(b), t) | F.contains(t, F.col(b)))
    near = right.join(few.hint("merge"), group).select(group, F.explode(met).alias(a), b)
    many = sizes.where(F.col("_n") > _FEW).select(group)
    if many.isEmpty():
        return near
    left = left.join(many.hint("merge"), group, "left_semi")

    def inside(small, s, big, t):
        parts = []
        for heads, sizes in ((small.filter(F.length(s) >= _GRAM), (_GRAM,)), (small.filter(F.length(s) < _GRAM), range(1, _GRAM))):
            near = big.join(heads.select(group).distinct().hint("merge"), group, "left_semi")
            pieces = near.withColumn("_g", F.explode(_pieces(F.col(t), sizes)))
            met = heads.withColumn("_g", F.left(F.col(s), F.lit(_GRAM))).join(pieces.hint("merge"), [group, "_g"])
            parts.append(met.filter(F.contains(F.col(t), F.col(s))).select(group, a, b))
        return parts[0].unionByName(parts[1])

    return near.unionByName(inside(left, a, right, b).unionByName(inside(right, b, left, a)).distinct())


def _texts(entities: DataFrame, kinds) -> DataFrame:
    return entities.filter(F.col("kind").isin(*kinds) & (F.col("entity") != "")).withColumn("entity", F.lower("entity"))


def _lists(result_ents: DataFrame, kinds) -> DataFrame:
    """query_id, url and the compared texts of a result; rows with an array `entities` are taken as they are, others are put together."""
    if "entities" not in result_ents.columns:
        result_ents = result_ents.groupBy("query_id", "url").agg(F.collect_list(F.struct("kind", "entity")).alias("entities"))
    texts = F.transform(F.filter("entities", lambda e: e["kind"].isin(*kinds) & (e["entity"] != "")), lambda e: F.lower(e["entity"]))
    return once(result_ents.select("query_id", "url", "entities"), _r=texts).drop("entities").filter(F.size("_r") > 0)


def _by_size(asked: DataFrame):
    """The texts of queries with at most _FEW of them as one array each (query_id, _q), and the other queries."""
    sizes = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
    few = asked.join(sizes.where(F.col("_n") <= _FEW).hint("merge"), "query_id").groupBy("query_id").agg(
        F.collect_list(F.struct(*[c for c in asked.columns if c != "query_id"])).alias("_q"))
    return few, sizes.where(F.col("_n") > _FEW).select("query_id")


def _meets(t, x) -> Column:
    return F.contains(t, x) | F.contains(x, t)


def entity_relevance(query_ents: DataFrame, result_ents: DataFrame, urls: DataFrame, kinds=rules.COMPARED_KINDS) -> DataFrame:
    """Per (query_id, url): mean over its entities of 1 for an equal and 0.5 for a partly equal query entity.

    result_ents has rows (query_id, url, kind, entity), or one row for each text with the array `entities`
    of (kind, entity), which goes to its query as it is.
    """
    q = written(_texts(query_ents, kinds).select("query_id", F.col("entity").alias("q_text")).distinct())
    few, many = _by_size(q)
    r = _lists(result_ents, kinds)
    crowded = not many.isEmpty()
    if crowded:
        r = written(r)
    points = F.transform("_r", lambda t: F.when(F.exists("_q", lambda x: x["q_text"] == t), 1.0).when(
        F.exists("_q", lambda x: _meets(t, x["q_text"])), 0.5).otherwise(0.0))
    sums = r.join(few.hint("merge"), "query_id").select(
        "query_id", "url", F.aggregate(points, F.lit(0.0), lambda a, x: a + x).alias("_p"), F.size("_r").cast("long").alias("_n"))
    if crowded:
        flat = r.join(many.hint("merge"), "query_id", "left_semi").select("query_id", "url", F.explode("_r").alias("entity")).groupBy(
            "query_id", "url", "entity").agg(F.count(F.lit(1)).alias("n"))
        pairs = contained_pairs(q.join(many.hint("merge"), "query_id", "left_semi"), flat.select("query_id", "entity"), "query_id", "q_text", "entity")
        best = pairs.groupBy("query_id", "entity").agg(F.max(F.when(F.col("q_text") == F.col("entity"), 1.0).otherwise(0.5)).alias("_p"))
        sums = sums.unionByName(flat.join(best.hint("merge"), ["query_id", "entity"], "left").select(
            "query_id", "url", (F.coalesce("_p", F.lit(0.0)) * F.col("n")).alias("_p"), F.col("n").alias("_n")))
    scored = sums.groupBy("query_id", "url").agg((F.sum("_p") / F.sum("_n")).alias("relevance"))
    return (urls.select("query_id", "url").distinct().join(scored.hint("merge"), ["query_id", "url"], "left")
            .withColumn("relevance", F.round(F.coalesce("relevance", F.lit(0.0)), 6)))


def entity_matches(query_ents: DataFrame, result_ents: DataFrame, kinds=rules.COMPARED_KINDS) -> DataFrame:
    """(query_id, query entity, its kind, url, result entity) for texts that contain one another; result_ents as for entity_relevance."""
    q = written(_texts(query_ents, kinds).groupBy("query_id", F.col("entity").alias("q_text")).agg(F.max("kind").alias("q_kind")))
    few, many = _by_size(q)
    r = _lists(result_ents, kinds)
    crowded = not many.isEmpty()
    if crowded:
        r = written(r)
    met = F.transform("_r", lambda t: F.transform(F.filter("_q", lambda x: _meets(t, x["q_text"])), lambda x: F.struct(
        x["q_text"].alias("q_text"), x["q_kind"].alias("q_kind"), t.alias("r_text"))))
    rows = r.join(few.hint("merge"), "query_id").select("query_id", "url", F.inline(F.flatten(met)))
    columns = ["query_id", "r_text", "q_text", "q_kind", "url"]
    rows = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("times"))
    if not crowded:
        return rows
    flat = r.join(many.hint("merge"), "query_id", "left_semi").select("query_id", "url", F.explode("_r").alias("r_text")).groupBy(
        "query_id", "url", "r_text").agg(F.count(F.lit(1)).alias("times"))
    large = q.join(many.hint("merge"), "query_id", "left_semi")
    pairs = contained_pairs(large, flat, "query_id", "q_text", "r_text")
    return rows.unionByName(pairs.join(large.hint("merge"), ["query_id", "q_text"]).join(flat.hint("merge"), ["query_id", "r_text"]).select(*columns, "times"))


# --------------------------------------------------------------------- cuts, top k


def sort_scored(df: DataFrame, scores, key: str) -> DataFrame:
    return df.orderBy(*[F.desc(s) for s in scores], key)


def _score_bucket(df: DataFrame, score: str, key: str) -> Column:
    """Equal scores are cut along the key, so a query whose results all tie is shared by tasks too."""
    text = dict(df.dtypes)[key] == "string"
    return F.struct((-F.col(score)).alias("s"), (F.left(key, F.lit(24)) if text else F.floor(F.col(key) / 1000)).alias("k"))


def top_results(scored: DataFrame, least: float = 0.2, score: str = "priority", key: str = "url") -> DataFrame:
    """Results with enough recognition, ranked by priority within their query."""
    kept = scored.filter(F.col("overall") >= least)
    return spread_row_number(kept, ["query_id"], _score_bucket(kept, score, key), [F.desc(score), F.col(key)], "place")


def relevance_cut(scored: DataFrame, least: float = 0.1, score: str = "relevance", key: str = "url") -> DataFrame:
    kept = scored.filter(F.col(score) >= least)
    return spread_row_number(kept, ["query_id"], _score_bucket(kept, score, key), [F.desc(score), F.col(key)], "place")


def diverse_top_k(sources: DataFrame, k: int = 20, per_host: int = 3, per_type: int = 8, pos: str = "pos") -> DataFrame:
    """The k best sources of a query, with at most per_host of a host and per_type of a type.

    Only the 2k best rows of a query reach the greedy pass, so a group is never larger than that.
    """
    order = W.partitionBy("query_id").orderBy(F.desc("score"), pos)
    best = sources.withColumn("host", host("url")).withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= 2 * k)
    schema = best.drop("_rn").schema.add("place", "long")

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        hosts, types, rows = {}, {}, []
        group = group.sort_values("_rn")
        for i, (h, t) in enumerate(zip(group.host, group.source_type)):
            if hosts.get(h, 0) < per_host and types.get(t, 0) < per_type:
                rows.append(i)
                hosts[h], types[t] = hosts.get(h, 0) + 1, types.get(t, 0) + 1
        out = group.iloc[rows[:k]].drop(columns="_rn")
        return out.assign(place=range(1, len(out) + 1))

    return best.groupBy("query_id").applyInPandas(pick, schema)


def link_providers(scholarships: DataFrame, orgs: DataFrame, provider: str = "provider") -> DataFrame:
    """Scholarships with the organisation whose core name equals the provider's (the first one per name)."""
    one = orgs.groupBy(key_core("name").alias("_k")).agg(F.min_by(F.struct("org_id", "name"), "org_id").alias("_o"))
    return (scholarships.withColumn("_k", key_core(provider)).join(one, "_k", "left")
            .withColumns({"org_id": F.col("_o.org_id"), "org_name": F.col("_o.name")}).drop("_k", "_o"))


