"""Keep-one-per-key, ranks and gaps that never put a whole key in one task.

The keep functions are aggregates, so each task first reduces its own rows and a hot key
reaches the shuffle as one row per task.  Ranks and gaps cut every key into buckets along
the order and stitch the buckets together with a small table of bucket totals.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut_lineage


def keep_max(df: DataFrame, keys, by) -> DataFrame:
    """The whole row with the greatest `by` value for each key."""
    keys = list(keys)
    row = F.struct(*[F.col(c) for c in df.columns])
    best = df.groupBy(*[_named(k, i) for i, k in enumerate(keys)]).agg(F.max_by(row, by).alias("_row"))
    return best.select("_row.*")


def keep_best(df: DataFrame, keys, score: str, position) -> DataFrame:
    """The best scored row for each key; the earlier position wins a tie."""
    return keep_max(df, keys, F.struct(F.col(score), *[-F.col(p) for p in _names(position)]))


def keep_first(df: DataFrame, keys, order) -> DataFrame:
    """The first row in the given order for each key."""
    keys = list(keys)
    row = F.struct(*[F.col(c) for c in df.columns])
    best = df.groupBy(*[_named(k, i) for i, k in enumerate(keys)]).agg(
        F.min_by(row, F.struct(*[F.col(o) for o in _names(order)])).alias("_row"))
    return best.select("_row.*")


def _names(x):
    return [x] if isinstance(x, str) else list(x)


def _named(k, i):
    return F.col(k) if isinstance(k, str) else k.alias(f"_k{i}")


def _same(a: DataFrame, b: DataFrame, cols):
    return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in cols])


def spread_row_number(df: DataFrame, keys, bucket: Column, order, name: str) -> DataFrame:
    """row_number() per key along `order`.

    `bucket` must never decrease along `order`; it decides how finely a key is cut.
    Only bucket counts, not rows, are gathered per key.
    """
    keys, order = list(keys), list(order)
    cut = df.withColumn("_b", bucket)
    counts = cut.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*(keys or [F.lit(0)])).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = cut.withColumn("_rn", F.row_number().over(W.partitionBy(*keys, "_b").orderBy(*order)))
    out = ranked.join(starts, _same(ranked, starts, [*keys, "_b"]))
    return out.select(*[ranked[c] for c in df.columns],
                      (F.col("_rn") + F.col("_before")).cast("long").alias(name))


def spread_previous(df: DataFrame, keys, bucket: Column, order: str, name: str) -> DataFrame:
    """lag(order) per key along `order`; `bucket` must never decrease along it."""
    keys = list(keys)
    cut = df.withColumn("_b", bucket)
    tops = cut.groupBy(*keys, "_b").agg(F.max(order).alias("_top"))
    links = tops.select(*keys, "_b", F.lag("_top").over(
        W.partitionBy(*(keys or [F.lit(0)])).orderBy("_b")).alias("_last"))
    inside = cut.withColumn("_prev", F.lag(order).over(W.partitionBy(*keys, "_b").orderBy(order)))
    out = inside.join(links, _same(inside, links, [*keys, "_b"]))
    return out.select(*[inside[c] for c in df.columns], F.coalesce("_prev", "_last").alias(name))


def global_places(df: DataFrame, order, name: str) -> DataFrame:
    """Places 1, 2, 3 .. of all rows along `order`, by two levels of sums over range partitions.

    Rows are dealt to ranges and numbered inside them; the second level adds up one count per
    range.  The numbered rows are written, so ranges and numbers cannot change between the levels.
    Rows that are equal in `order` get places of their own; add columns that tell them apart where
    that matters.  No rows give no rows.
    """
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    numbered = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order)
                           .withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    ranges = numbered.groupBy(part.alias("_range")).agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = ranges.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # one row per range: as many rows as the session has shuffle partitions
    out = numbered.withColumn("_range", part).join(F.broadcast(starts), "_range")
    place = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    return out.select(*[F.col(f"`{c}`") for c in df.columns], place.cast("long").alias(name))
