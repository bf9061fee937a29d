"""Records around hits: the sweep against all pairs, and hits that a text does not have."""

import random

from orgsift.operators.records import RECORDS, nearest_hits, records_of
from orgsift.plans.jobs import education_offers

SCHEMA = "k long, url string, kind string, entity string, start_pos long, end_pos long, pattern_no int, hit_no int"


def some(seed):
    rng = random.Random(seed)
    kinds = ["program", "university", "degree", "subject", "event", "deadline", "amount", "scholarship"]
    return sorted({(rng.randrange(12), "u", rng.choice(kinds), f"e{rng.randrange(40)}", s := rng.randrange(60), s + rng.randrange(1, 9), rng.randrange(3), i) for i in range(400)})


def test_nearest_like_all_pairs(spark):
    rows = some(1)
    for within in (None, 4):
        for anchor, fields in RECORDS.values():
            got = {(r.k, r.start_pos, r.end_pos, r.pattern_no, r.hit_no): tuple(r[f] for f in fields)
                   for r in nearest_hits(spark.createDataFrame(rows, SCHEMA), "k", anchor, fields, within).collect()}
            order = lambda r: (r[4], r[5], r[2], r[6], r[7])
            for a in (r for r in rows if r[2] == anchor):
                wanted = []
                for kind in fields.values():
                    near = sorted((abs(x[4] - a[4]), order(x) > order(a), [-v if isinstance(v, int) and order(x) < order(a) else v for v in order(x)], x[3])
                                  for x in rows if x[0] == a[0] and x[2] == kind)
                    wanted.append(near[0][3] if near and (within is None or near[0][0] <= within) else None)
                assert got[a[0], a[4], a[5], a[6], a[7]] == tuple(wanted)


def test_records_of_texts_without_companions(spark):
    hits = spark.createDataFrame([(1, "u", "amount", "$5,000", 3, 9, 0, 0), (1, "u", "amount", "$5,000", 30, 36, 0, 1), (2, "u", "event", "Big  Fair", 0, 9, 0, 0)], SCHEMA)
    money = records_of(hits, "k", "funding", "url").collect()
    assert [(r.k, r.currency, r.amount, r.program_name, r.funding_type) for r in money] == [(1, "$", "5,000", None, "")]
    assert [(r.event_name, r.event_type, r.organizer) for r in records_of(hits, "k", "events", "url").collect()] == [("Big Fair", "fair", None)]
    assert records_of(hits.where("false"), "k", "programs", "url").count() == 0


def test_offers_are_validated(spark):
    text = "Oslo University offers a Travel Fellowship of $2,000. Apply by: May 1, 2024. The Nordic Physics Conference is near; Master of Science in computer science."
    docs = spark.createDataFrame([(1, "https://a.edu", text), (2, "https://b.edu", ""), (3, "https://c.edu", None)], "k long, url string, text string")
    found = education_offers(docs, "k", "text", "url")
    money = [r for r in found["funding"].collect() if r.funding_type == "fellowship"]
    assert money and all(r.k == 1 and r.is_valid and r.completeness == 1.0 for r in money if r.amount == "2,000")
    assert {r.event_type for r in found["events"].collect()} >= {"conference"}
    assert all(r.confidence_score >= 0.7 for kind in found.values() for r in kind.collect())
