"""Temperature mixing of sources, realised as budgeted block permutations.

The weight of a source is its token share to the power a, normalised; a = 1 keeps the shares, a = 0
makes all sources equal.  The exponent is the largest one in [0, 1] that reaches a target entropy,
raised as far as a limit on repetition asks.  The search narrows an interval with sums over the
table of sources, so the sources themselves stay on the executors.

The token budget is the smallest one that cuts no source: every document is drawn at least once,
and no source is repeated more often than the limit.  Rows of a source are dealt into blocks by a
hash of the doc_id.  Each pass over a source takes its blocks in a permutation of its own; the
last pass ends after the block that comes closest to the budget.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .store import stored

TARGET_ENTROPY = 0.97  # of the logarithm of the number of sources
MAX_REPEATS = 2.0
BLOCKS = 64
_STEPS = 32


def n_tokens(text: Column) -> Column:
    """Words between ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _entropy_at(shares: DataFrame, exponents: list[float]) -> list[float]:
    """Entropy of the tempered weights for each exponent, from two sums each."""
    parts = []
    for i, a in enumerate(exponents):
        power = F.exp(F.lit(a) * F.col("log_share"))
        parts += [F.sum(power).alias(f"z{i}"), F.sum(power * F.col("log_share")).alias(f"s{i}")]
    row = shares.agg(*parts).first()
    return [math.log(row[f"z{i}"]) - a * row[f"s{i}"] / row[f"z{i}"] for i, a in enumerate(exponents)]


def exponent(shares: DataFrame, target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS) -> float:
    """The exponent for shares(log_share).

    Entropy falls and repetition falls as the exponent grows, so the answer is the larger one of the
    largest exponent with enough entropy and the smallest one within the repetition limit.
    """
    ends = shares.agg(F.count(F.lit(1)), F.min("log_share"), F.max("log_share")).first()
    if not ends[0] or ends[1] == ends[2]:
        return 1.0
    least = max(0.0, 1 - math.log(max(1.0, max_repeats)) / (ends[2] - ends[1]))
    wanted = target_entropy * math.log(ends[0])
    low, high = 0.0, 1.0
    while high - low > 1e-7:
        grid = [low + (high - low) * k / _STEPS for k in range(1, _STEPS + 1)]
        enough = sum(h >= wanted for h in _entropy_at(shares, grid))
        low, high = ([low] + grid)[enough], grid[min(enough, _STEPS - 1)]
        if enough == _STEPS:
            break
    return max(low, least)


def source_weights(docs: DataFrame, target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """source, tokens, share, weight, passes: how often a source is drawn under the budget.

    A null source is a source of its own.  A source without tokens gets weight 0 and one pass.
    """
    totals = stored(docs.select("source", n_tokens(F.col("text")).alias("tokens")).groupBy("source").agg(F.sum("tokens").alias("tokens")))
    total = totals.agg(F.sum("tokens")).first()[0] or 0
    shares = totals.withColumn("share", F.col("tokens") / F.lit(float(max(total, 1)))).withColumn(
        "log_share", F.when(F.col("tokens") > 0, F.log("share")))
    with_tokens = shares.where("tokens > 0")
    a = exponent(with_tokens, target_entropy, max_repeats)
    top = with_tokens.agg(F.sum(F.exp(F.lit(a) * F.col("log_share"))), F.max("log_share")).first()
    z, largest = top[0] or 1.0, top[1] or 0.0
    return shares.select(
        "source", "tokens", "share",
        F.coalesce(F.exp(F.lit(a) * F.col("log_share")) / F.lit(z), F.lit(0.0)).alias("weight"),
        F.coalesce(F.exp(F.lit(1 - a) * (F.lit(largest) - F.col("log_share"))), F.lit(1.0)).alias("passes"))


def _order(source, block, number, seed):
    """Where a block stands in one pass over its source: a hash, told apart by the block number."""
    return F.struct(F.xxhash64(source, block, number, F.lit(seed)), block)


def block_plan(docs: DataFrame, weights: DataFrame, blocks: int = BLOCKS, seed: int = 0) -> DataFrame:
    """(source, block, passes): how often the rows of each block are drawn.

    The table has `blocks` rows per source.
    """
    key = F.coalesce("source", F.lit(""))
    dealt = docs.select("source", _block(blocks, seed).alias("block"), n_tokens(F.col("text")).alias("n"))
    sums = dealt.groupBy("source", "block").agg(F.sum("n").alias("n"))
    near = sums.join(weights.select(F.col("source").alias("ws"), "tokens", "passes", "weight"), F.col("source").eqNullSafe(F.col("ws"))).drop("ws")
    whole = F.floor(F.col("passes") + 1e-9).cast("int")
    last = near.withColumn("whole", whole).withColumn("rest", (F.col("passes") - F.col("whole")) * F.col("tokens"))
    upto = F.sum("n").over(Window.partitionBy("source").orderBy(_order(key, F.col("block"), F.col("whole") + 1, seed))
                           .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    drawn = last.withColumn("upto", upto).withColumn("more", F.when(F.col("upto") - F.col("n") / 2 <= F.col("rest"), 1).otherwise(0) * (F.col("rest") > 0).cast("int"))
    return drawn.select("source", "block", "weight", (F.greatest("whole", F.lit(1)) + F.col("more")).cast("int").alias("passes"))


def _block(blocks: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(blocks)).cast("int")


def mixed(docs: DataFrame, target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS,
          blocks: int = BLOCKS, seed: int = 0) -> DataFrame:
    """The columns of docs(doc_id, text, source, ..), one row per draw, with mix_pass, mix_block and mix_weight.

    Every row of docs is drawn at least once, null and empty texts and null sources included.  Rows
    that repeat a doc_id lie in one block.  Columns of docs with the added names are replaced.  No
    rows give no rows.  Reading order is (mix_pass, then mix_order); the draws need no shuffle of
    texts, as the plan has `blocks` rows per source and joins by size.
    """
    weights = stored(source_weights(docs, target_entropy, max_repeats))
    plan = stored(block_plan(docs, weights, blocks, seed)).select(
        F.col("source").alias("_mix_source"), F.col("block").alias("_mix_block"), F.col("passes").alias("_mix_passes"), F.col("weight").alias("_mix_weight"))
    own = [c for c in docs.columns if c not in ("mix_pass", "mix_block", "mix_weight", "mix_order")]
    rows = docs.select(*[F.col(f"`{c}`") for c in own], _block(blocks, seed).alias("_mix_at"))
    drawn = rows.join(plan, F.col("source").eqNullSafe(F.col("_mix_source")) & (F.col("_mix_at") == F.col("_mix_block")))
    each = drawn.withColumn("mix_pass", F.explode(F.sequence(F.lit(1), F.col("_mix_passes"))))
    return each.select(*[F.col(f"`{c}`") for c in own], "mix_pass", F.col("_mix_block").alias("mix_block"), F.col("_mix_weight").alias("mix_weight"),
                       F.xxhash64(F.coalesce("source", F.lit("")), F.col("_mix_block"), F.col("mix_pass"), F.lit(seed)).alias("mix_order"))
