"""Rule lists as tables: keywords of any number, found as substrings of texts.

A keyword is looked up by one of its pieces of up to four characters, the one that fewest keywords
have (the anchor); texts are cut into their distinct pieces, and pieces meet anchors by equality.  Pieces
whose hash no anchor has are left where they are cut.  Only keywords whose anchor stands in a text are
compared with it, so no text meets the whole table, and the table may be as long as a caller likes: its
rows are counted, and only a short table is sent to all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import as_col, capitalised, has_bit, hash_bits, words
from ..session import cut_lineage, sent_if_short
from .score import _cap, _points

PIECE = 4


def rule_table(spark, lists, weight: float = 1.0) -> DataFrame:
    """lexicon(domain, label, keyword, weight, seq) from {domain: {label: words}} or {domain: words}."""
    rows = []
    for domain, listed in lists.items():
        labelled = listed.items() if isinstance(listed, dict) else [("", listed)]
        rows += [(domain, label, w, float(weight), seq) for seq, (label, ws) in enumerate(labelled) for w in ws]
    return spark.createDataFrame(rows, "domain string, label string, keyword string, weight double, seq int")


def _pieces(text, n: int) -> Column:
    """All runs of n characters; none where the text is shorter."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))


def anchored(lexicon: DataFrame) -> DataFrame:
    """(keyword, anchor) for the distinct lower-case keywords; empty ones are left out."""
    known = lexicon.select(F.lower("keyword").alias("keyword")).where("keyword <> ''").distinct()
    cut = _pieces("keyword", PIECE)
    for n in range(PIECE - 1, 0, -1):
        cut = F.when(F.length("keyword") == n, _pieces("keyword", n)).otherwise(cut)
    pieces = known.select("keyword", F.explode(F.array_distinct(cut)).alias("anchor"))
    shared = pieces.groupBy("anchor").agg(F.count(F.lit(1)).alias("_n"))
    return pieces.join(shared.hint("merge"), "anchor").groupBy("keyword").agg(F.min_by("anchor", F.struct("_n", "anchor")).alias("anchor"))


def keyword_hits(docs: DataFrame, key: str, text: str, lexicon: DataFrame) -> DataFrame:
    """(key, keyword): the distinct keywords of lexicon(keyword, ..) that stand anywhere in the lower case of a text.

    Keys name texts, so each key stands once.  Null and empty texts have no keywords; an empty table finds nothing.
    """
    anchors = cut_lineage(anchored(lexicon))
    low = docs.where(F.col(text).isNotNull()).select(key, F.lower(text).alias("_low"))
    sizes = anchors.agg(F.coalesce(F.collect_set(F.char_length("anchor")), F.array().cast("array<int>")).alias("_s")).scalar()
    marked = low.withColumns({"_sizes": sizes, "_bits": hash_bits(anchors, "anchor")})
    none = F.array().cast("array<string>")
    cut = F.concat(*[F.filter(F.when(F.array_contains("_sizes", n), _pieces("_low", n)).otherwise(none), lambda p: has_bit("_bits", p)) for n in range(1, PIECE + 1)])
    pieces = marked.select(key, F.explode(F.array_distinct(cut)).alias("anchor"))
    likely = pieces.join(sent_if_short(anchors), "anchor").groupBy(key).agg(F.collect_set("keyword").alias("_k"))
    return low.join(likely.hint("merge"), key).select(key, F.explode(F.filter("_k", lambda k: F.contains(F.col("_low"), k))).alias("keyword"))


def lexicon_hits(docs: DataFrame, key: str, text: str, lexicon: DataFrame) -> DataFrame:
    """keyword_hits with the other columns of the table; a keyword of several rows gives each of them."""
    rows = sent_if_short(lexicon.withColumn("keyword", F.lower("keyword")).distinct())
    return keyword_hits(docs, key, text, lexicon).join(rows, "keyword")


def tag_by(docs: DataFrame, key: str, text: str, lexicon: DataFrame) -> DataFrame:
    """(key, tag_set, tag): Q-5 with the tag sets of lexicon(domain, label, keyword)."""
    return lexicon_hits(docs, key, text, lexicon).select(key, F.col("domain").alias("tag_set"), F.col("label").alias("tag")).distinct()


def label_by(docs: DataFrame, key: str, text: str, lexicon: DataFrame) -> DataFrame:
    """(key, content_type): F-5 with the ladder of lexicon(label, keyword, seq); the lowest rung wins."""
    return lexicon_hits(docs, key, text, lexicon).groupBy(key).agg(F.min_by("label", "seq").alias("content_type"))


def crawl_confidence_by(docs: DataFrame, key: str, text: str, url: str, lexicon: DataFrame) -> DataFrame:
    """(key, confidence): C-4 with the keyword, host and context lists of lexicon(domain, keyword)."""
    def count(column, domain):
        return keyword_hits(docs, key, column, lexicon.where(F.col("domain") == domain)).groupBy(key).agg(F.count(F.lit(1)).alias(f"_{domain}_{column}"))

    rows = docs.select(key, text)
    for part in (count(text, "keyword"), count(url, "keyword"), count(url, "host"), count(text, "context")):
        rows = rows.join(part, key, "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    score = (n(f"_keyword_{text}") * 0.3 + n(f"_keyword_{url}") * 0.2 + _points(n(f"_host_{url}") > 0, 0.4)
             + _points((F.size(words(text)) >= 2) & (capitalised(as_col(text)) >= 2), 0.2) + _points(n(f"_context_{text}") > 0, 0.1))
    return rows.select(key, _cap(score).alias("confidence"))
