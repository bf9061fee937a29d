"""Streaming forms: review state, running best organisations, running statistics."""

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.html import page_elements
from ..operators.learning import apply_review, next_review_at
from ..plans.jobs import page_candidates, score_candidates
from ..session import cut_lineage

_UPDATE = ("user_id long, vocabulary_id long, proficiency_level int, reviews long, last_reviewed timestamp, "
           "last_id long, last_level long, last_correct boolean")
_STATE = "level int, seen long, last string, open string"


def _micros(ts) -> int:
    return pd.Timestamp(ts).value // 1000


def _advancer(expire_ms: int | None):
    def advance(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """Fold the answers of a key in time order.

        Answers younger than the watermark may still be preceded by others, so they stay in the state
        as they are; `level`, `seen` and `last` are what the older ones have come to.
        """
        if state.hasTimedOut:
            state.remove()
            return
        level, seen, last, waiting = state.get if state.exists else (0, 0, "null", "[]")
        last, waiting = json.loads(last), json.loads(waiting)
        newest = waiting[-1] if waiting else last
        if expire_ms and newest and newest[0] // 1000 + expire_ms < state.getCurrentWatermarkMs():
            level, seen, last, waiting = 0, 0, None, []  # new answers came in the trigger that would have ended the key
        for rows in batches:
            waiting += [[_micros(r.ts), int(r.review_id), int(r.submitted_level), bool(r.is_correct)] for r in rows.itertuples()]
        waiting.sort()
        settled = state.getCurrentWatermarkMs() * 1000
        now_level, now_seen, now_last, rest = int(level), int(seen), last, []
        for answer in waiting:
            now_level, now_seen, now_last = apply_review(now_level, answer[3]), now_seen + 1, answer
            if answer[0] < settled:
                level, seen, last = now_level, now_seen, answer
            else:
                rest.append(answer)
        state.update((int(level), int(seen), json.dumps(last), json.dumps(rest)))
        if expire_ms:
            state.setTimeoutTimestamp(max(now_last[0] // 1000, state.getCurrentWatermarkMs()) + expire_ms)
        yield pd.DataFrame({"user_id": [key[0]], "vocabulary_id": [key[1]], "proficiency_level": [now_level], "reviews": [now_seen],
                            "last_reviewed": [pd.Timestamp(now_last[0], unit="us")], "last_id": [now_last[1]], "last_level": [now_last[2]],
                            "last_correct": [now_last[3]]})
    return advance


def review_state_stream(reviews: DataFrame, seed: str = "review", late: str = "1 day", expire_days: int = None) -> DataFrame:
    """Running state per (user, item); every trigger emits the keys it changed (update mode).

    Event time rules, then the review id, as in review_state: answers that come up to `late` behind
    the newest one are put in their place, and the result is that of the batch job over all answers
    so far.  Answers later than that are left out.  With expire_days, a key without answers for so
    long is forgotten and starts anew.  A task holds the answers of one key of one trigger and those
    of the last `late`.
    """
    rows = reviews.select(F.col("user_id").cast("long"), F.col("vocabulary_id").cast("long"), "ts",
                          F.col("review_id").cast("long"), F.col("submitted_level").cast("long"), "is_correct").withWatermark("ts", late)
    expire_ms = expire_days * 86_400_000 if expire_days else None
    state = rows.groupBy("user_id", "vocabulary_id").applyInPandasWithState(
        _advancer(expire_ms), _UPDATE, _STATE, "update", GroupStateTimeout.EventTimeTimeout)
    return state.select("user_id", "vocabulary_id", "proficiency_level", "reviews", "last_reviewed", next_review_at(
        "last_reviewed", "last_level", "last_correct", seed, "user_id", "vocabulary_id", "last_id").alias("next_review"))


# ------------------------------------------------------------ best organisations

_ORG = ["name", "org_type", "source_url", "method", "confidence", "page_id", "pos"]


def _best_orgs(rows: DataFrame) -> DataFrame:
    """Best row per lower-case name and target; tasks reduce their rows before the shuffle."""
    order = F.struct("confidence", -F.col("page_id"), -F.col("pos"), "method")
    best = rows.groupBy("name_key", "target").agg(F.max_by(F.struct(*_ORG), order).alias("_r"))
    return best.select("name_key", "target", "_r.*")


def _found_orgs(pages: DataFrame) -> DataFrame:
    scored = score_candidates(page_candidates(page_elements(pages))).filter("counts")
    return scored.select(F.lower("name").alias("name_key"), "target", "name", "org_type", F.col("url").alias("source_url"),
                         "method", "confidence", "page_id", "pos")


def mine_pages_stream(pages: DataFrame) -> DataFrame:
    """Running best organisation per lower-case name and target (update mode), kept in the stream's state.

    The state has one row per organisation and does not expire; mine_pages_into keeps a table instead.
    """
    return _best_orgs(_found_orgs(pages)).drop("page_id", "pos")


def merge_best(found: DataFrame, folder: str, buckets: int = 64) -> None:
    """Merge organisations into the Parquet table at `folder`, best row per name and target.

    The table is cut into buckets by a hash of the key, and only buckets that the new rows touch are
    read and written.  Merging the same rows again changes nothing, so a repeated batch is harmless.
    """
    spark = found.sparkSession
    cut = lambda df: df.withColumn("bucket", F.pmod(F.xxhash64("name_key", "target"), F.lit(buckets)).cast("int"))
    new = cut_lineage(_best_orgs(found))
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        touched = cut(new).select("bucket").distinct()
        old = spark.read.parquet(folder).join(touched, "bucket", "left_semi")
        new = cut_lineage(_best_orgs(old.select(*new.columns).unionByName(new)))
    (cut(new).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("bucket").parquet(folder))


def mine_pages_into(pages: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start a query that merges the organisations of new pages into the table at `folder`.

    There is no state: the table itself is what is known so far.
    """
    writer = pages.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, epoch: merge_best(_found_orgs(batch), folder))
    return (writer.trigger(**trigger) if trigger else writer).start()


# -------------------------------------------------------------------- statistics


def review_stats_stream(reviews: DataFrame, late: str = "2 days") -> DataFrame:
    """Reviews, right answers and distinct items per learner and day, with late answers up to the watermark.

    Counts are exact: the state of a learner's day holds the items of that day, and is dropped once
    the watermark has passed it.
    """
    return (reviews.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("_w"), "user_id")
            .agg(F.count(F.lit(1)).alias("reviews"), F.count_if("is_correct").alias("right_answers"),
                 F.size(F.collect_set("vocabulary_id")).cast("long").alias("items"))
            .select(F.to_date("_w.start").alias("day"), "user_id", "reviews", "right_answers", "items"))


def discovery_stats_stream(names: DataFrame) -> DataFrame:
    """Running counts per extraction method (update mode)."""
    return names.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("confidence") >= 0.8).alias("high_confidence"))
