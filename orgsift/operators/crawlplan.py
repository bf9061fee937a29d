"""Crawl planning as table jobs: robots rules, frontier, politeness and retries."""

from pyspark.sql import Column, DataFrame, functions as F

from .. import rules
from ..functions.text import any_word
from ..functions.url import host, is_crawlable
from .ordering import global_places, keep_first, spread_previous, spread_row_number


def robots_filter(urls: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """Adds `allowed` by the usual rules of robots files(host, agent, seq, path_prefix, allow).

    The group of a host whose name stands in the agent's name counts (the first in the file), else
    the group *; groups are never merged.  The first rule of it whose prefix starts the path with
    its query decides; no rule, or an empty disallow, allows.  The rules of a host travel as one
    array (a robots file is small), so a URL row is never multiplied.
    """
    name = agent.split("/")[0].lower()
    fits = (F.col("agent") != "*") & F.contains(F.lit(name), F.lower("agent"))
    groups = (robots.filter((F.col("agent") == "*") | fits)
              .groupBy("host", F.lower("agent").alias("_agent"))
              .agg(F.array_sort(F.collect_list(F.struct("seq", "path_prefix", "allow"))).alias("_rules")))
    mine = groups.groupBy("host").agg(F.min_by("_rules", F.struct(F.col("_agent") == "*", F.get("_rules", F.lit(0))["seq"])).alias("_rules"))
    rest = F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*(.*)$", 1)
    with_path = urls.withColumn("host", host("url")).withColumn("_path", F.when(rest == "", "/").otherwise(rest))
    fitting = F.filter("_rules", lambda r: (r["path_prefix"] == "*") | F.startswith(F.col("_path"), r["path_prefix"]))
    decided = F.get(fitting, F.lit(0))
    return (with_path.join(mine, "host", "left")
            .withColumn("allowed", F.coalesce(decided["allow"] | (decided["path_prefix"] == ""), F.lit(True)))
            .drop("_rules", "_path"))


def frontier_candidates(links: DataFrame, words=rules.FRONTIER_WORDS, priority: int = 5,
                        skipped=rules.SKIPPED_EXTENSIONS, social=rules.SOCIAL_HOSTS) -> DataFrame:
    """Crawlable links whose text names a listing page, to be visited early."""
    return (links.filter(any_word(F.lower("text"), words) & is_crawlable("target", skipped, social))
            .select(F.col("target").alias("url"), F.lit(priority).alias("priority")))


def unvisited(frontier: DataFrame, visited: DataFrame, order="arrival") -> DataFrame:
    """First request per URL, by one or more order columns, that was not visited before."""
    return keep_first(frontier, ["url"], order).join(visited.select("url"), "url", "left_anti")


def order_frontier(frontier: DataFrame, arrival=("arrival",), capacity: int = None) -> DataFrame:
    """Adds `place`: highest priority first, then arrival (one or more columns).

    The whole frontier is numbered over range partitions, so no task sorts it all; a capacity keeps
    the first places only.
    """
    placed = global_places(frontier, [F.desc("priority"), *[F.asc(a) for a in arrival]], "place")
    return placed.filter(F.col("place") <= capacity) if capacity else placed


def politeness_schedule(urls: DataFrame, delay: float, arrival: str = "arrival", width: int = 100000) -> DataFrame:
    """Earliest fetch offset in seconds per URL: the n-th request of a host waits n delays.

    Hosts are cut every `width` arrivals, so a host with very many URLs is spread over tasks.
    """
    placed = spread_row_number(urls.withColumn("host", host("url")), ["host"],
                               F.floor(F.col(arrival) / width), [F.col(arrival)], "_slot")
    return (placed.withColumn("slot", F.col("_slot") - 1)
            .withColumn("earliest_s", F.col("slot") * F.lit(float(delay))).drop("_slot"))


def politeness_audit(log: DataFrame, delay: float, key: str = "host", ts: str = "ts", bucket: Column = None) -> DataFrame:
    """Seconds since the previous request of the same key, and whether that was too soon; a key is cut into minutes."""
    bucket = F.date_trunc("minute", F.col(ts)) if bucket is None else bucket
    with_last = spread_previous(log, [key], bucket, ts, "previous_ts")
    gap = (F.unix_micros(ts) - F.unix_micros("previous_ts")) / 1000000.0
    return with_last.withColumn("gap_s", gap).withColumn("too_soon", F.coalesce(gap < delay, F.lit(False)))


def retry_delay(attempt, initial: float, factor: float, longest: float) -> Column:
    attempt = F.col(attempt)
    return F.when(attempt == 0, F.lit(0.0)).otherwise(
        F.least(F.lit(float(initial)) * F.pow(F.lit(float(factor)), attempt - 1), F.lit(float(longest))))


def retry_plan(failures: DataFrame, initial: float = 1.0, factor: float = 2.0, longest: float = 60.0,
               attempts: int = 3) -> DataFrame:
    """Failures that may be tried again, with the wait before the next try."""
    return (failures.filter(F.col("attempt") < attempts)
            .withColumn("delay_s", retry_delay("attempt", initial, factor, longest))
            .withColumn("next_attempt", F.col("attempt") + 1))
