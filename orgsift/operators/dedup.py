"""Duplicate removal: exact, two-key greedy, similar names, name groups and survivorship."""

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .. import rules
from ..functions.text import has_bit, hash_bits, key_core, key_plain, key_without_articles, words
from ..functions.url import host
from ..session import cut_lineage
from .graph import components
from .ordering import keep_best, keep_first, keep_max  # noqa: F401  (part of this module's surface)

# ------------------------------------------------------- greedy, either key hits
#
# A sequential pass keeps a row unless an earlier kept row shares its name or its URL.  Rows that no
# chain of shared keys connects do not touch each other, so the pass runs per connected component:
# components are dealt to tasks, and each task walks its rows in order.  A component of more than
# PASS_ROWS rows is first taken apart: a row that is the earliest open one for both of its keys is
# kept, open rows that share a key with it go, and what is left falls into smaller components.

PASS_ROWS = 1_000_000


def _pass_in_order(batches):
    """Numbers of the rows that a pass over sorted rows keeps."""
    names, links = set(), set()
    for rows in batches:
        kept = []
        for r, a, b in zip(rows["_r"], rows["_a"], rows["_b"]):
            if (a is None or a not in names) and (b is None or b not in links):
                kept.append(r)
                names.add(a)
                links.add(b)
        yield pd.DataFrame({"_r": pd.Series(kept, dtype=rows["_r"].dtype)})


def _by_component(rows: DataFrame) -> DataFrame:
    """Adds the component of each row; a hash stands for a key, and one that two keys share only joins two components."""
    one, two = F.xxhash64(F.lit("a"), "_a"), F.xxhash64(F.lit("b"), "_b")
    linked = components(rows.filter("_a is not null and _b is not null").select(one.alias("a"), two.alias("b")))
    own = rows.withColumn("_node", F.when(F.col("_a").isNotNull(), one).otherwise(two))
    return own.join(linked, F.col("_node") == F.col("id"), "left").select("_r", "_a", "_b", F.coalesce("component", "_node").alias("_c"))


def _one_round(rows: DataFrame):
    """(kept, still open) after the earliest rows of both keys were kept and their neighbours dropped."""
    low_a = rows.filter(F.col("_a").isNotNull()).groupBy("_a").agg(F.min("_r").alias("_ma"))
    low_b = rows.filter(F.col("_b").isNotNull()).groupBy("_b").agg(F.min("_r").alias("_mb"))
    seen = rows.join(low_a, "_a", "left").join(low_b, "_b", "left")
    wins = (F.coalesce("_ma", "_r") == F.col("_r")) & (F.coalesce("_mb", "_r") == F.col("_r"))
    state = cut_lineage(seen.select("_r", "_a", "_b", wins.alias("_win")))
    won = state.filter("_win")
    rest = (state.filter("not _win").drop("_win")
            .join(won.select("_a").filter("_a is not null"), "_a", "left_anti")
            .join(won.select("_b").filter("_b is not null"), "_b", "left_anti"))
    return won.select("_r"), rest.select("_r", "_a", "_b")


def greedy_dedup(df: DataFrame, keys=("name", "url"), order: str = "pos", pass_rows: int = PASS_ROWS) -> DataFrame:
    """Rows the sequential pass would keep.  `order` must be a unique column; an empty or null key never matches."""
    first, second = [F.nullif(F.lower(F.trim(F.col(k))), F.lit("")) for k in keys]
    rows = df.select(F.col(order).alias("_r"), first.alias("_a"), second.alias("_b"))
    keyless = rows.filter("_a is null and _b is null").select("_r")
    # equal rows on both keys: the first stands for all
    rows = rows.filter("_a is not null or _b is not null").groupBy("_a", "_b").agg(F.min("_r").alias("_r")).select("_r", "_a", "_b")
    kept, open_rows = keyless, cut_lineage(rows)
    schema = rows.select("_r").schema
    while not open_rows.isEmpty():
        placed = cut_lineage(_by_component(open_rows))
        large = placed.groupBy("_c").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > pass_rows).select("_c")
        passed = placed.join(large, "_c", "left_anti").repartition("_c").sortWithinPartitions("_r").mapInPandas(_pass_in_order, schema)
        won, rest = _one_round(placed.join(large, "_c", "left_semi"))
        kept, open_rows = cut_lineage(kept.unionByName(passed).unionByName(won)), cut_lineage(rest)
    return df.join(kept, df[order] == kept["_r"], "left_semi")


# ------------------------------------------------------------------ similar names
#
# Two names collide when the Jaccard similarity of their word sets reaches t.  With sizes
# i+a and i+b around a common part of i words this says a + b <= i * (1 - t) / t.
#
# Short names (fewer than 2 / (1 - t) words) can lose at most one word each, so all their
# collisions are visible in groups keyed by the common part: the name itself and the name
# without one word.  A group is reduced to two numbers, the lowest rank of each kind, and no
# pair is written.  Pairs with a longer name come from a prefix join on rare words.
#
# Joins are asked for by sorted shuffles: Spark guesses the size of names that are made from a small
# file as the file's, and would send them whole through the driver.

_SLACK = 1e-9


def _word_sets(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn("_w", F.sort_array(F.array_distinct(words(F.lower(F.trim(F.col(name)))))))


def _short_limit(t: float) -> float:
    return 2.0 / (1.0 - t) - _SLACK


def _members(names: DataFrame, t: float) -> DataFrame:
    """(id, rank, common part, words left out) for the short names."""
    n = F.size("_w")
    short = names.filter((n > 0) & (n < _short_limit(t)))
    whole = F.array(F.struct(F.lit(0).alias("out"), F.col("_w").alias("part")))
    less_one = F.when(n * (1.0 - t) >= 1.0 - _SLACK, F.transform(
        F.col("_w"), lambda w: F.struct(F.lit(1).alias("out"), F.array_remove(F.col("_w"), w).alias("part"))))
    none = F.array().cast("array<struct<out:int,part:array<string>>>")
    return (short.select("id", "rank", F.explode(F.concat(whole, F.coalesce(less_one, none))).alias("_p"))
            .select("id", "rank", "_p.out", F.size("_p.part").alias("common"),
                    F.array_join("_p.part", " ").alias("part")))


_BUCKETS = 1 << 20  # hashed words; 16 of them share a number, with 4 bits each


def _rarity(sets: DataFrame) -> DataFrame:
    """One row: the size class (its logarithm) of each bucket of hashed words, in an array of a fixed size.

    It sorts words nearly as their own counts would; any order that is the same for all sets is right.
    """
    buckets = sets.select(F.explode("_w").alias("w")).select(F.pmod(F.xxhash64("w"), F.lit(_BUCKETS)).alias("b"))
    level = F.least(F.length(F.bin(F.count(F.lit(1)))) - 1, F.lit(15)).cast("long")
    levels = buckets.groupBy("b").agg(level.alias("c")).select(F.expr("b DIV 16").alias("k"), F.expr("shiftleft(c, CAST(b % 16 AS INT) * 4)").alias("v"))
    every = sets.sparkSession.range(_BUCKETS // 16).select(F.col("id").alias("k"), F.lit(0).cast("long").alias("v"))
    packed = levels.unionByName(every).groupBy("k").agg(F.bit_or("v").alias("v"))
    return packed.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("_f"))


_BY_RARITY = f"""array_sort(transform(_w, w -> struct(
    shiftright(get(_f, CAST(pmod(xxhash64(w), {_BUCKETS}) DIV 16 AS INT)), CAST(pmod(xxhash64(w), 16) AS INT) * 4) & 15 AS f, xxhash64(w) AS h, w AS w)))"""


_MAP = 16  # numbers of 64 bits that stand for a set


def _some_bits(no: int) -> Column:
    """64 bits for an eighth of all words, small enough to travel with every head."""
    at = f"CAST(pmod(xxhash64(w), 512) AS INT) - {no * 64}"
    return F.expr(f"aggregate(_w, 0L, (a, w) -> CASE WHEN {at} BETWEEN 0 AND 63 THEN a | shiftleft(1L, {at}) ELSE a END)").alias(f"s{no}")


def _apart(*maps) -> Column:
    """Bits that only one of two maps has."""
    return reduce(lambda x, y: x + y, [F.bit_count(F.col(a).bitwiseXOR(F.col(b))) for a, b in maps])


def _may_differ(sizes: Column, t: float) -> Column:
    """How many words may stand in one set only."""
    return sizes * ((1.0 - t) / (1.0 + t)) + _SLACK


def _alike(drafts: DataFrame, sets: DataFrame, t: float) -> DataFrame:
    """Drafts whose sets can be similar by their bit maps: every bit that only one map has is a word that only one set has."""
    bit = sets.select("id", "n", F.explode("_w").alias("w")).select("id", "n", F.pmod(F.xxhash64("w"), F.lit(_MAP * 64)).alias("b"))
    maps = bit.groupBy("id", "n").agg(*[F.coalesce(F.expr(f"bit_or(CASE WHEN b DIV 64 = {k} THEN shiftleft(1L, CAST(b % 64 AS INT)) END)"), F.lit(0).cast("long")).alias(f"m{k}") for k in range(_MAP)])
    other = maps.select(F.col("id").alias("other"), F.col("n").alias("_n"), *[F.col(f"m{k}").alias(f"o{k}") for k in range(_MAP)])
    met = drafts.join(maps.hint("merge"), "id").join(other.hint("merge"), "other")
    apart = _apart(*[(f"m{k}", f"o{k}") for k in range(_MAP)])
    return met.filter(apart <= _may_differ(F.col("n") + F.col("_n"), t)).select("id", "other")


def similar_pairs(names: DataFrame, t: float, long_only: bool = False) -> DataFrame:
    """Pairs (id, other) of distinct word sets with Jaccard >= t, in both directions.

    Words are sorted inside each set by how rare they are; two sets that are this similar share a word
    among their first n - ceil(t n) + 1, and only those travel, as hashes with their places.  Behind the
    first word that both share at most the shorter rest can be common.  Lengths and this bound are
    checked in the join, then bit maps of the sets, and the true similarity on the whole sets that are left.
    """
    sets = names.filter(F.size("_w") > 0).select("id", F.col("_w"), F.size("_w").alias("n"))
    rarity = F.broadcast(_rarity(sets))
    if long_only:
        sets = sets.filter(F.col("n") >= F.ceil(F.lit(_short_limit(t)) * t - _SLACK))
    prefix = F.slice(F.expr(_BY_RARITY), F.lit(1), (F.col("n") - F.ceil(F.col("n") * t - _SLACK) + 1).cast("int"))
    mapped = sets.select("id", "n", "_w", _some_bits(0), _some_bits(1))
    heads = mapped.crossJoin(rarity).select("id", "n", "s0", "s1", F.posexplode(F.transform(prefix, lambda x: x["h"])).alias("p", "h"))
    a, b = heads.alias("a"), heads.hint("merge").alias("b")
    common = F.least(F.col("a.n") - F.col("a.p"), F.col("b.n") - F.col("b.p"))
    fits = (F.col("a.h") == F.col("b.h")) & (F.col("a.id") < F.col("b.id")) & (
        F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * t - _SLACK) & (
        common >= (F.col("a.n") + F.col("b.n") - common) * t - _SLACK) & (
        _apart(("a.s0", "b.s0"), ("a.s1", "b.s1")) <= _may_differ(F.col("a.n") + F.col("b.n"), t))
    if long_only:
        fits = fits & (F.greatest("a.n", "b.n") >= _short_limit(t))
    drafts = a.join(b, fits).select(F.col("a.id").alias("id"), F.col("b.id").alias("other")).distinct()
    drafts = cut_lineage(_alike(drafts, sets, t))
    ends = drafts.select(F.explode(F.array("id", "other")).alias("id"))
    sets = sets.filter(has_bit(hash_bits(ends, "id"), F.col("id")))  # sets of no draft stay where they are
    left = sets.select("id", F.col("_w").alias("_wa")).hint("merge")
    right = sets.select(F.col("id").alias("other"), F.col("_w").alias("_wb")).hint("merge")
    both = F.size(F.array_intersect("_wa", "_wb"))
    true = drafts.join(left, "id").join(right, "other").withColumn(
        "jaccard", both / (F.size("_wa") + F.size("_wb") - both)).filter(F.col("jaccard") >= t - _SLACK)
    return true.select("id", "other", "jaccard")


def _room(common: Column, out: int, t: float) -> Column:
    return common * ((1.0 - t) / t) >= out - _SLACK


def _nearest(targets: DataFrame, sources: DataFrame, members: DataFrame, pairs: DataFrame, t: float) -> DataFrame:
    """For each target the lowest rank of a source it collides with (itself included if it is one)."""
    low = (members.join(sources.select("id").hint("merge"), "id", "left_semi").groupBy("part").agg(
        F.min(F.when(F.col("out") == 0, F.col("rank"))).alias("_m0"),
        F.min(F.when(F.col("out") == 1, F.col("rank"))).alias("_m1")))
    against = members.join(targets.select("id").hint("merge"), "id", "left_semi").join(low.hint("merge"), "part")
    one, two = _room(F.col("common"), 1, t), _room(F.col("common"), 2, t)
    hit = F.when(F.col("out") == 0, F.when(one, F.col("_m1"))).otherwise(
        F.least(F.when(one, F.col("_m0")), F.when(two, F.col("_m1"))))
    near = against.select("id", hit.alias("_hit"))
    far = (pairs.join(sources.select(F.col("id").alias("other"), F.col("rank").alias("_hit")).hint("merge"), "other")
           .join(targets.select("id").hint("merge"), "id", "left_semi").select("id", "_hit"))
    return near.unionByName(far).filter("_hit is not null").groupBy("id").agg(F.min("_hit").alias("_hit"))


def dedup_similar(df: DataFrame, name: str, url: str, score: str, pos: str, t: float = 0.85) -> DataFrame:
    """Best score first: drop exact URL copies, then names too similar to a kept one."""
    rank = F.struct((-F.col(score)).alias("s"), F.col(pos).alias("p"))
    ranked = _word_sets(df, name).withColumn("_rank", rank)
    by_url = keep_max(ranked, [url], F.struct(F.col(score), -F.col(pos)))
    wordless = by_url.filter(F.size("_w") == 0).select(pos)
    # equal word sets collide with each other and with the same others, so the first stands for all
    names = cut_lineage(by_url.filter(F.size("_w") > 0).groupBy("_w").agg(F.min("_rank").alias("rank"))
                        .select(F.col("rank.p").alias("id"), "rank", "_w"))
    members = cut_lineage(_members(names, t))
    half = similar_pairs(names, t, long_only=True).select("id", "other")
    pairs = cut_lineage(half.unionByName(half.select(F.col("other").alias("id"), F.col("id").alias("other"))))
    open_rows, kept = names.select("id", "rank"), None
    while not open_rows.isEmpty():
        near = _nearest(open_rows, open_rows, members, pairs, t)
        state = cut_lineage(open_rows.join(near.hint("merge"), "id", "left")
                            .select("id", "rank", F.coalesce(F.col("_hit") >= F.col("rank"), F.lit(True)).alias("_win")))
        won = state.filter("_win").select("id", "rank")
        kept = won.select("id") if kept is None else kept.unionByName(won.select("id"))
        rest = state.filter("not _win").select("id", "rank")
        gone = _nearest(rest, won, members, pairs, t)
        open_rows = cut_lineage(rest.join(gone.hint("merge"), "id", "left_anti"))
    ids = wordless if kept is None else wordless.unionByName(kept.select(F.col("id").alias(pos)))
    return df.join(ids.hint("merge"), pos, "left_semi")


# --------------------------------------------------------- name groups, survivors


def _best_of(score: Column, pos: str) -> Column:
    return F.struct(score, -F.col(pos))


def group_variants(names: DataFrame, pos: str = "pos") -> DataFrame:
    """Best spelling per comparison key by confidence + quality, with the number of other spellings."""
    total = F.round(F.col("confidence") + F.col("quality"), 9)
    keyed = names.withColumn("name_key", key_without_articles("name"))
    best = keyed.groupBy("name_key").agg(
        F.max_by(F.struct(*[F.col(c) for c in names.columns]), _best_of(total, pos)).alias("_row"),
        F.count(F.lit(1)).alias("members"))
    spellings = (keyed.select("name_key", "name").distinct()
                 .groupBy("name_key").agg((F.count(F.lit(1)) - 1).alias("other_spellings")))
    return best.join(spellings, "name_key").select("name_key", "_row.*", "members", "other_spellings")


def name_variants(names: DataFrame, pos: str = "pos") -> DataFrame:
    """(best name, other spelling) rows, one per spelling."""
    total = F.round(F.col("confidence") + F.col("quality"), 9)
    keyed = names.withColumn("name_key", key_without_articles("name"))
    best = keyed.groupBy("name_key").agg(F.max_by("name", _best_of(total, pos)).alias("best_name"))
    return (keyed.select("name_key", F.col("name").alias("variant")).distinct().join(best, "name_key")
            .filter(F.col("variant") != F.col("best_name")).select("name_key", "best_name", "variant"))


def dedup_within(names: DataFrame, source: str, pos: str = "pos") -> DataFrame:
    """Best confidence per normalised name inside each source."""
    keyed = names.withColumn("name_key", key_plain("name"))
    return keep_max(keyed, [source, "name_key"], _best_of(F.col("confidence"), pos))


def method_priority(method, priorities=rules.METHOD_PRIORITY) -> Column:
    out = F.lit(0.0)
    for label, value in priorities:
        out = F.when(F.col(method) == label, F.lit(value)).otherwise(out)
    return out


def dedup_global(names: DataFrame, pos: str = "pos", priorities=rules.METHOD_PRIORITY) -> DataFrame:
    """Best record per core name by confidence + quality + method; the first known official URL fills a gap."""
    total = F.round(F.col("confidence") + F.col("quality") + method_priority("method", priorities), 9)
    by = _best_of(total, pos)
    has_url = F.coalesce(F.col("official_url") != "", F.lit(False))
    rest = [c for c in names.columns if c != "official_url"]
    best = names.groupBy(key_core("name").alias("name_key")).agg(
        F.max_by(F.struct(*[F.col(c) for c in rest]), by).alias("_row"),
        F.max_by("official_url", F.when(has_url, by)).alias("official_url"),
        F.count(F.lit(1)).alias("members"))
    return best.select("name_key", "_row.*", "official_url", "members")


def merge_survivors(orgs: DataFrame, pos: str = "pos", min_conf: float = 0.7) -> DataFrame:
    """One record per core name and host: best by (confidence, name length); a longer trusted
    name is taken over, and so is the first URL, an edu one first."""
    by = F.struct(F.col("confidence"), F.length("name"), -F.col(pos))
    longer = F.when(F.col("confidence") >= min_conf, F.struct(F.length("name"), by))
    some_url = F.coalesce(F.col("url") != "", F.lit(False))
    merged = orgs.groupBy(key_core("name").alias("name_key"), host(F.coalesce("url", F.lit(""))).alias("host")).agg(
        F.max_by(F.struct(*[F.col(c) for c in orgs.columns]), by).alias("_row"),
        F.max_by("name", longer).alias("_long"),
        F.max_by("url", F.when(some_url & F.contains("url", F.lit("edu")), by)).alias("_edu"),
        F.max_by("url", F.when(some_url, by)).alias("_url"),
        F.count(F.lit(1)).alias("members"))
    flat = merged.select("name_key", "host", "_row.*", "_long", "_edu", "_url", "members")
    return (flat.withColumn("name", F.when(F.length("_long") > F.length("name"), F.col("_long")).otherwise(F.col("name")))
            .withColumn("url", F.coalesce("_edu", "_url", F.lit(""))).drop("_long", "_edu", "_url"))


def best_per_name_and_host(orgs: DataFrame, score: str = "relevance", pos: str = "pos") -> DataFrame:
    return keep_max(orgs, [F.lower("name"), host("url")], _best_of(F.col(score), pos))
