"""Vocabulary lookups, spaced-repetition state, sessions, mastery and streaks.

Tables: vocabulary(id, category, difficulty_level, ..), reviews(review_id, user_id,
vocabulary_id, submitted_level, is_correct, ts), progress(user_id, vocabulary_id,
proficiency_level, last_reviewed, next_review).
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import rules
from ..functions.text import as_like, unit_hash
from ..session import cut_lineage, sent_if_short
from .ordering import global_places, keep_max, spread_row_number

TOP_LEVEL = 5
DAY = 86400

# ------------------------------------------------------------------ vocabulary


def list_vocabulary(vocab: DataFrame, category=None, difficulty=None) -> DataFrame:
    if category:
        vocab = vocab.filter(F.col("category") == category)
    if difficulty:
        vocab = vocab.filter(F.col("difficulty_level") == difficulty)
    return vocab


def search_vocabulary(vocab: DataFrame, text: str, columns) -> DataFrame:
    hit = F.lit(False)
    for c in columns:
        hit = hit | as_like(c, text)
    return vocab.filter(hit)


def categories(vocab: DataFrame, column: str = "category") -> DataFrame:
    return vocab.select(column).distinct()


def page_of(df: DataFrame, key: str, offset: int, limit: int) -> DataFrame:
    """Rows offset + 1 to offset + limit along `key`; the places come from ranges, so a deep page costs no task more than its range."""
    placed = global_places(df, [key], "_place")
    return placed.where((F.col("_place") > offset) & (F.col("_place") <= offset + limit)).drop("_place")


def curriculum_or_default(requests: DataFrame, curriculum: DataFrame, levels: DataFrame) -> DataFrame:
    """Topics and level requirements per (language, level) request; a starter topic when none is known."""
    start = F.struct(
        F.lit("Getting Started").alias("topic"), F.lit("1 week").alias("duration"),
        F.concat(F.lit("https://example.com/"), F.col("language"), F.lit("/"), F.col("level"),
                 F.lit("/intro")).alias("resource_url"))
    known = curriculum.select("language", "level", F.struct("topic", "duration", "resource_url").alias("_t"))
    return (requests.join(known, ["language", "level"], "left").join(levels, "level", "left")
            .withColumn("_t", F.coalesce("_t", start)).select("*", "_t.*").drop("_t"))


def append_assessment(assessments: DataFrame, new: DataFrame) -> DataFrame:
    """Add assessments, but only for (level, language) pairs that are known."""
    known = assessments.select("level", "language").distinct()
    return assessments.unionByName(new.join(known, ["level", "language"], "left_semi"), allowMissingColumns=True)


def upsert_topics(curriculum: DataFrame, new: DataFrame) -> DataFrame:
    """Add topics to their (language, level), new pairs included."""
    return curriculum.unionByName(new, allowMissingColumns=True)


def recommend(profiles: DataFrame) -> DataFrame:
    """Advice by learning style and a starter recommendation from language and level."""
    advice = F.lit(None).cast("string")
    for style, text in reversed(rules.STYLE_ADVICE):
        advice = F.when(F.col("learning_style") == style, F.lit(text)).otherwise(advice)
    language = F.coalesce("language", F.lit("unknown"))
    level = F.coalesce("proficiency_level", F.lit("beginner"))
    return profiles.withColumns({
        "advice": advice,
        "resource_type": F.lit("video"),
        "resource": F.concat(F.lit("Basic "), language, F.lit(" lessons for "), level, F.lit(" level")),
        "focus_area": F.lit("general comprehension"),
        "estimated_timeline": F.lit("3 months"),
    })


# ---------------------------------------------------------------- review state
#
# One answer moves a level by +1 or -1 inside 0..5.  A run of answers is then the map
# x -> least(high, greatest(low, x + shift)), and two runs compose to such a map again, so a
# key may be cut anywhere: tasks fold their share of a key, and only run summaries meet.

_RUN = ("user_id long, vocabulary_id long, first_ts timestamp, first_id long, shift long, "
        "low long, high long, reviews long, last_ts timestamp, last_id long, last_level long, last_correct boolean")


def _compose(shift, low, high, i, j):
    """Run i followed by run j."""
    return (shift[i] + shift[j],
            np.clip(low[i] + shift[j], low[j], high[j]),
            np.clip(high[i] + shift[j], low[j], high[j]))


def _merge_sorted(runs: pd.DataFrame) -> pd.DataFrame:
    """Merge neighbouring runs of the same key, halving their number until one is left per key."""
    while True:
        same = ((runs.user_id.values[1:] == runs.user_id.values[:-1])
                & (runs.vocabulary_id.values[1:] == runs.vocabulary_id.values[:-1]))
        if not same.any():
            return runs
        start = np.concatenate([[True], ~same])
        place = np.arange(len(runs)) - np.maximum.accumulate(np.where(start, np.arange(len(runs)), 0))
        i = np.flatnonzero((place[:-1] % 2 == 0) & same)
        shift, low, high = (runs[c].to_numpy(copy=True) for c in ("shift", "low", "high"))
        shift[i], low[i], high[i] = _compose(shift, low, high, i, i + 1)
        n = runs.reviews.to_numpy(copy=True)
        n[i] += n[i + 1]
        merged = runs.assign(shift=shift, low=low, high=high, reviews=n)
        for c in ("last_ts", "last_id", "last_level", "last_correct"):
            v = runs[c].to_numpy(copy=True)
            v[i] = v[i + 1]
            merged[c] = v
        keep = np.ones(len(runs), bool)
        keep[i + 1] = False
        runs = merged[keep].reset_index(drop=True)


def _fold_sorted(batches):
    """One run per key and task from rows sorted by key and time."""
    open_run = None
    for rows in batches:
        if rows.empty:
            continue
        step = np.where(rows.is_correct.to_numpy(dtype=bool), 1, -1)
        runs = pd.DataFrame({
            "user_id": rows.user_id, "vocabulary_id": rows.vocabulary_id,
            "first_ts": rows.ts, "first_id": rows.review_id, "shift": step,
            "low": 0, "high": TOP_LEVEL, "reviews": 1,
            "last_ts": rows.ts, "last_id": rows.review_id, "last_level": rows.submitted_level,
            "last_correct": rows.is_correct,
        })
        if open_run is not None:
            runs = pd.concat([open_run, runs], ignore_index=True)
        runs = _merge_sorted(runs)
        yield runs.iloc[:-1]
        open_run = runs.iloc[-1:].reset_index(drop=True)
    if open_run is not None:
        yield open_run


def next_review_at(ts, submitted_level, is_correct, seed: str, *key) -> Column:
    """2^level days after a right answer, one day after a wrong one, with +-10 % spread."""
    base = F.when(F.col(is_correct), F.pow(F.lit(2.0), F.col(submitted_level))).otherwise(F.lit(1.0))
    spread = base * F.lit(0.2) * (unit_hash(F.lit(seed), *key) - F.lit(0.5))
    days = F.greatest(F.lit(1.0), base + spread)
    return F.timestamp_micros(F.unix_micros(F.col(ts)) + F.floor(days * DAY).cast("long") * 1000000)


def review_state(reviews: DataFrame, seed: str = "review") -> DataFrame:
    """Proficiency and next review per (user, item) after all answers, in time order."""
    rows = reviews.select(F.col("user_id").cast("long"), F.col("vocabulary_id").cast("long"), "ts",
                          F.col("review_id").cast("long"), F.col("submitted_level").cast("long"), "is_correct")
    order = ["user_id", "vocabulary_id", "ts", "review_id"]
    runs = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(_fold_sorted, _RUN)
    step = F.struct("first_ts", "first_id", "shift", "low", "high")
    last = F.struct("last_ts", "last_id", "last_level", "last_correct")
    whole = runs.groupBy("user_id", "vocabulary_id").agg(
        F.array_sort(F.collect_list(step)).alias("_runs"),
        F.max_by(last, F.struct("last_ts", "last_id")).alias("_last"),
        F.sum("reviews").alias("reviews"))
    level = F.aggregate("_runs", F.lit(0).cast("long"),
                        lambda x, r: F.least(r["high"], F.greatest(r["low"], x + r["shift"])))
    flat = whole.select("user_id", "vocabulary_id", level.cast("int").alias("proficiency_level"), "reviews", "_last.*")
    return flat.select(
        "user_id", "vocabulary_id", "proficiency_level", "reviews", F.col("last_ts").alias("last_reviewed"),
        next_review_at("last_ts", "last_level", "last_correct", seed, "user_id", "vocabulary_id", "last_id")
        .alias("next_review"))


# ------------------------------------------------------------ levels and stats


def _level_of_average(avg: Column) -> Column:
    return F.least(F.lit(TOP_LEVEL), F.floor(F.coalesce(avg, F.lit(0.0))) + 1).cast("int")


def user_levels(progress: DataFrame) -> DataFrame:
    return progress.groupBy("user_id").agg(
        _level_of_average(F.avg("proficiency_level")).alias("user_level"))


def study_stats(vocab: DataFrame, progress: DataFrame) -> DataFrame:
    """Totals, mastery, completion and level per learner."""
    total = vocab.agg(F.count(F.lit(1))).scalar()
    counted = progress.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("reviewed_items"),
        F.count_if(F.col("proficiency_level") >= 4).alias("mastered_items"),
        _level_of_average(F.avg("proficiency_level")).alias("current_level"))
    return (counted.withColumn("total_items", total)
            .withColumn("completion_rate", F.when(F.col("total_items") > 0,
                        F.col("reviewed_items") / F.col("total_items") * 100).otherwise(0.0)))


def streaks(reviews: DataFrame, as_of: str) -> DataFrame:
    """Consecutive review days that end at as_of; no review that day means 0."""
    days = reviews.select("user_id", F.to_date("ts").alias("day")).distinct()
    back = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("day")))
    hit = F.col("day") == F.date_sub(F.lit(as_of).cast("date"), back - 1)
    return (days.withColumn("_hit", hit)
            .groupBy("user_id").agg(F.count_if("_hit").cast("long").alias("streak")))


# -------------------------------------------------------------------- sessions


def new_items(vocab: DataFrame, progress: DataFrame) -> DataFrame:
    """Items nobody in the progress table has seen."""
    return vocab.join(progress.select(F.col("vocabulary_id").alias("id")), "id", "left_anti")


def due_items(vocab: DataFrame, progress: DataFrame, as_of: str) -> DataFrame:
    """Items whose next review has come and whose difficulty fits the learner."""
    due = progress.filter(F.col("next_review") <= F.lit(as_of).cast("timestamp"))
    return (due.join(vocab, due.vocabulary_id == vocab.id)
            .join(user_levels(progress), "user_id")
            .filter(F.col("difficulty_level") <= F.col("user_level"))
            .drop("id"))


def first_per_user(df: DataFrame, n: int, *order) -> DataFrame:
    place = F.row_number().over(W.partitionBy("user_id").orderBy(*order))
    return df.withColumn("place", place).filter(F.col("place") <= n)


def sample_per_user(vocab: DataFrame, levels: DataFrame, n: int, seed: str, seen: DataFrame = None) -> DataFrame:
    """n repeatable random items per learner, no harder than the learner's level.

    Items of a level form a ring in hash order and every learner starts at a place of its own,
    so a learner reads n places (and one more per item already seen) instead of the whole table.
    """
    reach = (vocab.filter(F.col("difficulty_level") <= TOP_LEVEL)
             .select("id", F.explode(F.sequence(F.greatest(F.col("difficulty_level"), F.lit(1)), F.lit(TOP_LEVEL))).alias("level"),
                     F.md5(F.concat_ws("|", F.lit(seed), F.col("id").cast("string"))).alias("_h")))
    ring = spread_row_number(reach, ["level"], F.substring("_h", 1, 3), ["_h", "id"], "_place")
    sizes = reach.groupBy("level").agg(F.count(F.lit(1)).alias("_size"))
    users = levels.join(sizes, levels.user_level == sizes.level)
    if seen is not None:
        known = seen.groupBy("user_id").agg(F.count_distinct("vocabulary_id").alias("_known"))
        users = users.join(known, "user_id", "left")
        steps = F.least(F.lit(n) + F.coalesce("_known", F.lit(0)), F.col("_size"))
    else:
        steps = F.least(F.lit(n), F.col("_size"))
    start = F.floor(unit_hash(F.lit(seed), "user_id") * F.col("_size"))
    block = 10000
    wanted = (users.select("user_id", "level", "_size", start.alias("_start"), steps.cast("long").alias("_steps"))
              .filter(F.col("_steps") > 0)
              .withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_steps") - 1, F.lit(block).cast("long"))))
              .withColumn("_off", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + block - 1, F.col("_steps") - 1))))
              .withColumn("_place", (F.col("_start") + F.col("_off")) % F.col("_size") + 1))
    got = wanted.join(ring, ["level", "_place"]).select("user_id", F.col("id").alias("vocabulary_id"), "_off")
    if seen is not None:
        got = got.join(seen.select("user_id", "vocabulary_id"), ["user_id", "vocabulary_id"], "left_anti")
    return first_per_user(got, n, "_off").drop("_off")


def build_session(new: DataFrame, due: DataFrame) -> DataFrame:
    """New items first, then due ones."""
    cols = ["user_id", "vocabulary_id", "place"]
    return (new.select(*cols, F.lit("new").alias("part"), F.lit(1).alias("part_no"))
            .unionByName(due.select(*cols, F.lit("due").alias("part"), F.lit(2).alias("part_no"))))


# --------------------------------------------------------------------- lessons


def lesson_items(lessons: DataFrame, vocab: DataFrame) -> DataFrame:
    ids = lessons.select("lesson_id", F.explode(F.array_distinct("vocabulary_ids")).alias("id"))
    return ids.join(vocab, "id")


def category_items(goals: DataFrame, vocab: DataFrame, n: int, order: str = "id") -> DataFrame:
    """The first n items of a goal's categories.  No category gives more than n items to a
    goal, so categories are cut to n before the join."""
    in_category = W.partitionBy("category").orderBy(order)
    heads = vocab.withColumn("_r", F.row_number().over(in_category)).filter(F.col("_r") <= n).drop("_r")
    wanted = goals.select("goal_id", F.explode(F.array_distinct("focus_categories")).alias("category"))
    in_goal = W.partitionBy("goal_id").orderBy(order)
    # a category has many goals: a shuffle by it would leave its goals to one task
    return (wanted.join(sent_if_short(cut_lineage(heads)), "category").withColumn("place", F.row_number().over(in_goal))
            .filter(F.col("place") <= n))


def latest_open_lesson(lessons: DataFrame, keys=("user_id",)) -> DataFrame:
    return keep_max(lessons.filter(~F.col("completed")), keys, F.struct("created_at", "lesson_id"))


# ------------------------------------------------------------------- streaming


def apply_review(level, is_correct: bool) -> int:
    """Level after one more answer; a first answer starts from 0."""
    return min(TOP_LEVEL, (level or 0) + 1) if is_correct else max(0, (level or 0) - 1)
