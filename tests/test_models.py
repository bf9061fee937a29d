"""Order-dependent operators against plain sequential models on random rows."""

import random

import pytest
from pyspark.sql import functions as F

from orgsift.operators import crawlplan as P
from orgsift.operators import dedup as D
from orgsift.operators import learning as L
from orgsift.operators import ordering as O
from orgsift.operators import rank as R


def fold_two_keys(rows):
    names, urls, kept = set(), set(), []
    for pos, name, url in rows:
        n, u = (name or "").lower().strip(), (url or "").lower().strip()
        if n in names or u in urls:
            continue
        kept.append(pos)
        names |= {n} - {""}
        urls |= {u} - {""}
    return kept


@pytest.mark.parametrize("seed", range(4))
def test_greedy_dedup(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["", None, *"abcdefgh"]), rng.choice(["", None, *"pqrstu"])) for i in range(40)]
    df = spark.createDataFrame(rows, "pos int, name string, url string").repartition(5)
    assert sorted(r.pos for r in D.greedy_dedup(df).collect()) == fold_two_keys(rows)


def test_greedy_dedup_chain(spark):
    """Every row shares a key with the next one only."""
    rows = [(i, f"n{i // 2}", f"u{(i + 1) // 2}") for i in range(12)]
    df = spark.createDataFrame(rows, "pos int, name string, url string")
    assert sorted(r.pos for r in D.greedy_dedup(df).collect()) == fold_two_keys(rows)


def fold_similar(rows, t=0.85):
    kept, urls, sets = [], set(), []
    for pos, name, url, score in sorted(rows, key=lambda r: (-r[3], r[0])):
        if url in urls:
            continue
        urls.add(url)
        w = set(name.lower().split())
        if w and any(len(w & s) / len(w | s) >= t for s in sets if s):
            continue
        kept.append(pos)
        sets.append(w)
    return sorted(kept)


@pytest.mark.parametrize("seed,size", [(0, 4), (1, 8), (2, 13), (3, 16), (4, 22)])
def test_similar_names(spark, seed, size):
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(size)]
    rows = []
    for i in range(60):
        words = list(base) if i % 2 else [f"v{rng.randint(0, 3)}_{j}" for j in range(size)]
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(words) + 1)
            words = words[:k] + rng.choice([[], [f"x{rng.randint(0, 5)}"]]) + words[k + rng.randint(0, 1):]
        rows.append((i, " ".join(words), f"u{rng.randint(0, 50)}", rng.randint(0, 9) / 10))
    df = spark.createDataFrame(rows, "pos long, name string, url string, score double").repartition(3)
    assert sorted(r.pos for r in D.dedup_similar(df, "name", "url", "score", "pos").collect()) == fold_similar(rows)


def test_survivors(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["The Ring University", "Ring", "ring college", "Ring Institute!", "RING"]), rng.choice(["", "https://a.com/1", "https://a.com/edu", "https://a.com/2"]), rng.randint(0, 10) / 10) for i in range(60)]
    df = spark.createDataFrame(rows, "pos int, name string, url string, confidence double")
    groups = {}
    for r in rows:
        groups.setdefault("a.com" if r[2] else "", []).append(r)
    for got in D.merge_survivors(df).collect():
        g = sorted(groups[got.host], key=lambda r: (-r[3], -len(r[1]), r[0]))
        name, url = g[0][1], g[0][2]
        for _, n, u, c in g[1:]:
            if len(n) > len(name) and c >= 0.7:
                name = n
            if not url and u:
                url = u
            elif u and "edu" in u and "edu" not in url:
                url = u
        assert (got.name, got.url, got.pos, got.members) == (name, url, g[0][0], len(g))


def fold_reviews(rows):
    level = 0
    for _, _, right in sorted(rows):
        level = min(5, level + 1) if right else max(0, level - 1)
    return level


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_review_state(spark, parts):
    rng = random.Random(parts)
    rows = [(i, rng.choice([1, 1, 1, 2, 3]), rng.choice([7, 7, 8]), rng.randint(0, 5), rng.random() < 0.55, rng.randint(0, 60)) for i in range(3000)]
    df = spark.createDataFrame(rows, "review_id long, user_id long, vocabulary_id long, submitted_level int, is_correct boolean, s long")
    df = df.withColumn("ts", F.timestamp_seconds(F.lit(1.7e9) + F.col("s"))).drop("s").repartition(parts)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    got = {(r.user_id, r.vocabulary_id): (r.proficiency_level, r.reviews) for r in L.review_state(df).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for i, u, v, _, right, s in rows:
        want.setdefault((u, v), []).append((s, i, right))
    assert got == {k: (fold_reviews(v), len(v)) for k, v in want.items()}


def test_diverse_top_k(spark):
    rng = random.Random(1)
    rows = [(rng.randint(1, 3), i, f"https://h{rng.randint(0, 5)}.com/{i}", f"t{rng.randint(0, 2)}", rng.randint(0, 20) / 20) for i in range(150)]
    got = R.diverse_top_k(spark.createDataFrame(rows, "query_id int, pos int, url string, source_type string, score double"), 10, 3, 8).collect()
    for q in (1, 2, 3):
        best = sorted([r for r in rows if r[0] == q], key=lambda r: (-r[4], r[1]))[:20]
        hosts, types, want = {}, {}, []
        for _, pos, url, kind, _ in best:
            h = url.split("/")[2]
            if hosts.get(h, 0) < 3 and types.get(kind, 0) < 8:
                want.append(pos)
                hosts[h], types[kind] = hosts.get(h, 0) + 1, types.get(kind, 0) + 1
        assert [r.pos for r in sorted(got, key=lambda r: r.place) if r.query_id == q] == want[:10]


def test_contained_pairs(spark):
    rng = random.Random(2)
    text = lambda: "".join(rng.choice("ab ") for _ in range(rng.randint(1, 7)))
    left, right = [(rng.randint(0, 1), text()) for _ in range(40)], [(rng.randint(0, 1), text()) for _ in range(40)]
    got = R.contained_pairs(spark.createDataFrame(left, "g int, a string"), spark.createDataFrame(right, "g int, b string"), "g", "a", "b").collect()
    want = {(g, a, b) for g, a in left for h, b in right if g == h and (a in b or b in a)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_spread_rank_of_a_hot_key(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("key"), F.col("id").alias("o")).repartition(9)
    got = O.spread_row_number(df, ["key"], F.floor(F.col("o") / 64), [F.col("o")], "rn")
    bad = got.withColumn("want", F.expr("row_number() over (partition by key order by o)")).filter("rn <> want").count()
    assert bad == 0 and got.count() == 5000
    prev = O.spread_previous(df, ["key"], F.floor(F.col("o") / 64), "o", "p")
    assert prev.withColumn("want", F.expr("lag(o) over (partition by key order by o)")).filter("not (p <=> want)").count() == 0


def test_retry_and_schedule(spark):
    got = [r.delay_s for r in P.retry_plan(spark.createDataFrame([(0,), (1,), (2,), (3,)], "attempt int"), 3.0, 2.0, 5.0, 3).orderBy("attempt").collect()]
    assert got == [0.0, 3.0, 5.0]


def test_greedy_dedup_takes_large_components_apart(spark):
    rnd = random.Random(11)
    rows = [(i, f"n{rnd.randrange(60)}", rnd.choice(["", f"u{rnd.randrange(60)}"])) for i in range(400)]
    df = spark.createDataFrame(rows, "pos long, name string, url string")
    assert sorted(r.pos for r in D.greedy_dedup(df, pass_rows=20).collect()) == fold_two_keys(rows)


def test_greedy_dedup_of_a_long_chain(spark):
    n = 30_000
    df = spark.range(n).select(F.col("id").alias("pos"), F.concat(F.lit("n"), F.floor((F.col("id") + 1) / 2)).alias("name"),
                               F.concat(F.lit("u"), F.floor(F.col("id") / 2)).alias("url"))
    assert D.greedy_dedup(df).count() == n // 2
