"""Readers, writers and the streaming forms."""

import random
import time

from pyspark.sql import functions as F

from orgsift.operators import learning as L
from orgsift.plans import jobs as J
from orgsift.sources import tables as S
from orgsift.streaming import live
from test_pages import HTML, URL


def test_search_results(spark, tmp_path):
    f = tmp_path / "r.csv"
    f.write_text('title,abstract,url,original_query\n"A, ""b""","two\nlines",https://x.org,q\nNo url,x,,q\n', encoding="utf-8")
    rows = S.read_search_results(spark, str(f)).collect()
    assert [(r.title, r.abstract, r.url) for r in rows] == [('A, "b"', "two\nlines", "https://x.org")]


def test_failures(spark, tmp_path):
    from pyspark.sql import types as T
    f = tmp_path / "n.csv"
    f.write_text("id,score\n1,0.5\nx,0.7\n3,abc\n")
    good, bad = S.read_with_failures(spark, str(f), T.StructType([T.StructField("id", T.IntegerType()), T.StructField("score", T.DoubleType())]))
    assert [r.id for r in good.collect()] == [1]
    assert sorted(r._broken for r in bad.collect()) == ["3,abc", "x,0.7"]


def test_write_outputs(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.1, ["x", "y"], "u"), ("b", 2.4, [], "c")], "name string, confidence double, tags array<string>, org_type string")
    for fmt in ("csv", "json", "parquet"):
        S.write_outputs(df, str(tmp_path / fmt), fmt, "confidence")
    csv = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert {(r.name, r.tags) for r in csv.collect()} == {("a", "x, y"), ("b", None)}
    S.write_outputs(df, str(tmp_path / "parts"), "parquet", "confidence", ["org_type"])
    assert spark.read.parquet(str(tmp_path / "parts")).filter("org_type = 'c'").first().name == "b"


def test_append_vocabulary(spark, tmp_path):
    path = str(tmp_path / "v")
    spark.createDataFrame([(1, "a"), (7, "b")], "id long, term string").write.parquet(path)
    new = spark.createDataFrame([("c", 1), ("d", 2)], "term string, arrival long")
    S.append_vocabulary(spark.read.parquet(path), new, path, "arrival")
    assert sorted((r.id, r.term) for r in spark.read.parquet(path).select("id", "term").collect()) == [(1, "a"), (7, "b"), (8, "c"), (9, "d")]


def _drain(df, mode, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()


def test_review_stream(spark, tmp_path):
    rng = random.Random(4)
    src = str(tmp_path / "reviews")
    rows = [(i, rng.randint(1, 3), rng.randint(1, 4), rng.randint(0, 5), rng.random() < 0.6, i) for i in range(300)]
    df = spark.createDataFrame(rows, "review_id long, user_id long, vocabulary_id long, submitted_level long, is_correct boolean, s long")
    df = df.withColumn("ts", F.timestamp_seconds(F.lit(1.7e9) + F.col("s"))).drop("s").coalesce(1)
    for k in range(3):
        df.filter(F.floor(F.col("review_id") / 100) == k).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    _drain(live.review_state_stream(stream), "update", "review_out")
    last = spark.table("review_out").groupBy("user_id", "vocabulary_id").agg(F.max_by(F.struct("proficiency_level", "reviews", "last_reviewed", "next_review"), "reviews").alias("r")).select("user_id", "vocabulary_id", "r.*")
    batch = L.review_state(df)
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, batch.select(*last.columns).collect()))


def test_late_and_repeated_answers(spark, tmp_path):
    """Answers that arrive out of order, and twice, come to what the batch job makes of them."""
    rng = random.Random(9)
    rows = [(i, rng.randint(1, 2), rng.randint(1, 3), rng.randint(0, 5), rng.random() < 0.6, i * 600) for i in range(240)]
    rows += rng.sample(rows, 20)
    arrival = sorted(rows, key=lambda r: r[5] + rng.randint(0, 30_000))
    src, schema = str(tmp_path / "late"), "review_id long, user_id long, vocabulary_id long, submitted_level long, is_correct boolean, s long"
    frame = lambda part: spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_seconds(F.lit(1.7e9) + F.col("s"))).drop("s").coalesce(1)
    for k in range(0, len(arrival), 26):
        frame(arrival[k:k + 26]).write.mode("append").parquet(src)
        time.sleep(0.02)  # files are taken by their time
    stream = spark.readStream.schema(frame(rows[:1]).schema).option("maxFilesPerTrigger", 1).parquet(src)
    _drain(live.review_state_stream(stream, late="2 days"), "update", "late_out")
    last = spark.table("late_out").groupBy("user_id", "vocabulary_id").agg(F.max_by(F.struct("proficiency_level", "reviews", "last_reviewed", "next_review"), "reviews").alias("r")).select("user_id", "vocabulary_id", "r.*")
    batch = L.review_state(frame(rows))
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, batch.select(*last.columns).collect()))


def test_forgotten_keys(spark, tmp_path):
    src = str(tmp_path / "old")
    for k, day in enumerate((0, 1, 40, 41)):
        user = 2 if day == 40 else 1
        spark.range(1).select(F.lit(k).cast("long").alias("review_id"), F.lit(user).cast("long").alias("user_id"), F.lit(1).cast("long").alias("vocabulary_id"), F.lit(1).cast("long").alias("submitted_level"),
                              F.lit(True).alias("is_correct"), F.timestamp_seconds(F.lit(1.7e9 + day * 86400)).alias("ts")).write.mode("append").parquet(src)
        time.sleep(0.05)
    schema = spark.read.parquet(src).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    _drain(live.review_state_stream(stream, late="1 hour", expire_days=10), "update", "old_out")
    assert {(r.user_id, r.reviews) for r in spark.table("old_out").collect()} == {(1, 1), (1, 2), (2, 1)}  # user 1 starts anew


def test_merging_sink(spark, tmp_path):
    src, table = str(tmp_path / "in"), str(tmp_path / "table")
    pages = spark.createDataFrame([(1, URL, HTML), (2, "https://other.example.com/", HTML)], "page_id long, url string, html string")
    stream = lambda: spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(src)
    for page in (1, 2):
        pages.filter(f"page_id = {page}").coalesce(1).write.mode("append").parquet(src)
        live.mine_pages_into(stream(), table, str(tmp_path / "cp"), availableNow=True).awaitTermination(120)
    live.merge_best(live._found_orgs(pages), table)  # a repeated batch
    orgs, _ = J.mine_pages(pages)
    want = {(r.k, r.url): r.c for r in orgs.groupBy(F.lower("name").alias("k"), "url").agg(F.max("confidence").alias("c")).collect()}
    got = spark.read.parquet(table).collect()
    assert {(r.name_key, r.target): r.confidence for r in got} == want and len(got) == len(want)


def test_page_stream(spark, tmp_path):
    src = str(tmp_path / "pages")
    pages = spark.createDataFrame([(1, URL, HTML), (2, "https://other.example.com/", HTML)], "page_id long, url string, html string")
    pages.filter("page_id = 1").coalesce(1).write.mode("append").parquet(src)
    pages.filter("page_id = 2").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(src)
    _drain(live.mine_pages_stream(stream), "complete", "page_out")
    orgs, _ = J.mine_pages(pages)
    want = {(r.k, r.url): r.c for r in orgs.groupBy(F.lower("name").alias("k"), "url").agg(F.max("confidence").alias("c")).collect()}
    assert {(r.name_key, r.target): r.confidence for r in spark.table("page_out").collect()} == want


def test_stats_streams(spark, tmp_path):
    src = str(tmp_path / "ev")
    df = spark.range(60).select(F.timestamp_seconds(F.lit(1.7e9) + F.col("id") * 3600).alias("ts"), (F.col("id") % 2).alias("user_id"), (F.col("id") % 5).alias("vocabulary_id"), (F.col("id") % 3 > 0).alias("is_correct"))
    df.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    _drain(live.review_stats_stream(stream), "complete", "stats_out")
    got = spark.table("stats_out").agg(F.sum("reviews"), F.sum("right_answers")).first()
    assert tuple(got) == (60, 40)
    days = df.groupBy(F.to_date("ts").alias("day"), "user_id").agg(F.count_distinct("vocabulary_id").alias("items"))
    assert {(r.day, r.user_id, r["items"]) for r in spark.table("stats_out").collect()} == {(r.day, r.user_id, r["items"]) for r in days.collect()}
    names = df.select(F.when(F.col("is_correct"), "list").otherwise("link").alias("method"), F.lit(0.9).alias("confidence"))
    names.coalesce(1).write.parquet(str(tmp_path / "n"))
    _drain(live.discovery_stats_stream(spark.readStream.schema(names.schema).parquet(str(tmp_path / "n"))), "complete", "disc_out")
    assert {(r.method, r.n) for r in spark.table("disc_out").collect()} == {("list", 40), ("link", 20)}
