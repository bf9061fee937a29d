"""URL rules carried over redirect and canonical links.

Rules decide a url by host suffix and path prefix; the longest fitting rule wins.  Pages say with a
canonical link or an immediate refresh that another url is the same document.  These links make
alias classes (distributed connected components over url keys); a class with a blocked url blocks
its other members, unless a member of it is explicitly allowed.

A rule table may be long: rules are joined by host suffix, not written out as conditions.
"""

from __future__ import annotations

import html
import re
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .graph import components
from .store import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(\??[^#]*)"
DEFAULT = "allow"


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next / ? # with A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #; else empty."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def url_key(url: Column) -> Column:
    """Host, path (at least /) and query: the scheme and the fragment do not tell urls apart. Null without a host."""
    host, path = host_of(url), path_of(url)
    return F.when(host != "", F.concat(host, F.when(path == "", "/").otherwise(path), F.regexp_extract(url, _PARTS, 3)))


_OPENING = re.compile(r"<(?:!--|(script|link|meta)\b)", re.I)
_SCRIPT_END = re.compile(r"</script\s*+>", re.I)
_ATTRIBUTE = re.compile(r"""(?<![a-z\-])([a-z\-]++)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_REFRESH = re.compile(r"""^\s*\d+(?:\.\d*)?\s*[;,]\s*url\s*=\s*['"]?([^'"]*)""", re.I)
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*:")


def _tags(page: str):
    """link and meta tags outside comments and scripts, in one pass; what has no end anywhere behind it is not looked for again."""
    at, comments, scripts = 0, True, True
    while opening := _OPENING.search(page, at):
        at, kind = opening.end(), opening[1]
        if kind is None:
            end = page.find("-->", at) if comments else -1
            comments = end >= 0
            at = end + 3 if comments else at
        elif kind.lower() == "script":
            end = _SCRIPT_END.search(page, at) if scripts else None
            scripts = end is not None
            at = end.end() if scripts else at
        else:
            end = page.find(">", at)
            if end < 0:
                return
            yield page[opening.start() + 1:end]
            at = end + 1


def page_targets(url: str, page: str) -> list[str]:
    """Absolute urls that a page names as its canonical address or sends its reader to at once."""
    out = []
    for tag in _tags(page):
        values = {m[0].lower(): html.unescape(m[1] or m[2] or m[3]) for m in _ATTRIBUTE.findall(tag)}
        link = None
        if tag[:4].lower() == "link" and "canonical" in values.get("rel", "").lower().split():
            link = values.get("href")
        elif tag[:4].lower() == "meta" and values.get("http-equiv", "").lower() == "refresh":
            sent = _REFRESH.match(values.get("content", ""))
            link = sent and sent[1]
        link = (link or "").strip()
        if not link or link[0] == "#" or (_SCHEME.match(link) and "://" not in link):
            continue
        try:
            out.append(urljoin(url, link))
        except ValueError:  # a link that is no url, such as one with a broken [ in its host
            continue
    return out


def _link_batches(batches):
    for batch in batches:
        left, right = [], []
        for url, page in zip(batch.column(0), batch.column(1)):
            url = url.as_py()
            found = page_targets(url, page.as_py())
            left += [url] * len(found)
            right += found
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], names=["url", "target"])


def alias_links(pages: DataFrame) -> DataFrame:
    """(url, target) for the canonical links and refreshes of pages(url, html)."""
    return pages.where("url is not null and html is not null").select("url", "html").mapInArrow(
        _link_batches, "url string, target string")


def rule_table(spark, rules) -> DataFrame:
    """Rules as rows from (verdict, host, path) triples, path starting with /."""
    return spark.createDataFrame([(v, h, p) for v, h, p in rules], "verdict string, rule_host string, rule_path string")


def own_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """key, rule, verdict: the longest rule that fits each of urls(key, host, path).

    A host gives only suffixes of as many labels as rules have, so a host of any length is a few rows.
    """
    parts = lambda host: F.split(host, r"\.", -1)
    sizes = rules.select(F.size(parts("rule_host")).alias("n")).agg(F.coalesce(F.array_sort(F.collect_set("n")), F.array().cast("array<int>"))).scalar()
    spread = urls.where("host <> ''").select("key", "path", parts("host").alias("_labels"), F.explode(sizes).alias("_n")).where(
        "_n <= size(_labels)").select("key", "path", F.array_join(F.slice("_labels", F.size("_labels") - F.col("_n") + 1, F.col("_n")), ".").alias("rule_host"))
    fit = spread.join(rules, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    rule = F.concat("rule_host", "rule_path")
    # among rules of the same text the allowing one stands first
    best = fit.groupBy("key").agg(F.max(F.struct(F.length(rule).alias("n"), F.when(F.col("verdict") == "allow", 1).otherwise(0).alias("allows"),
                                                 rule.alias("rule"), F.col("verdict").alias("verdict"))).alias("best"))
    return best.select("key", "best.rule", "best.verdict")


def judge(pages: DataFrame, rules: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, alias_of for every row of pages(page_id, url, html).

    The verdict of a fitting rule stands.  Without one, a url takes part in the class of its
    aliases: `allow` if any of them is explicitly allowed, else `block` if any is blocked, else
    `allow`.  `links` are further redirects as (url, target), for example from a crawl log.
    alias_of is the class of a url that has aliases (its smallest url key), else null.

    A null url or one without :// has an empty host and path, no rule, no aliases and `allow`.
    Null html has no links; unreadable hrefs (empty, only a fragment, other schemes) are left out.
    Repeated rows are all judged; no rows give no rows; other columns are ignored.
    """
    found = alias_links(pages)
    found = found.unionByName(links.select("url", "target")) if links is not None else found
    edges = stored(found.select(url_key(F.col("url")).alias("a"), url_key(F.col("target")).alias("b"), "target")
                   .where("a is not null and b is not null and a <> b"))
    classes = components(edges.select("a", "b"))
    seen = pages.select("page_id", "url", url_key(F.col("url")).alias("key"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = seen.select("key", "host", "path").unionByName(
        edges.select(F.col("b").alias("key"), host_of(F.col("target")).alias("host"), path_of(F.col("target")).alias("path")))
    # one path per key, but for the empty path that stands for /
    own = stored(own_rules(urls.where("key is not null").distinct().select(
        F.struct("key", "path").alias("key"), "host", "path"), rules).select("key.key", "key.path", "rule", "verdict"))
    told = classes.join(own, F.col("id") == F.col("key")).groupBy("component").agg(
        F.max(F.col("verdict") == "allow").alias("allowed"), F.max(F.col("verdict") == "block").alias("blocked"))
    carried = classes.join(told, "component", "left").select(F.col("id").alias("key"), "component", "allowed", "blocked")
    final = seen.join(own, ["key", "path"], "left").join(carried, "key", "left")
    return final.select(
        "page_id", "host", "path", "rule",
        F.coalesce("verdict", F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block"), F.lit(DEFAULT)).alias("verdict"),
        F.col("component").alias("alias_of"))
