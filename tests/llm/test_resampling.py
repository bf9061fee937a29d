"""Importance resampling against a plain version, word by word."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from orgsift.llm.resampling import collapsed, feature_buckets, resample
from cases import awkward, lowered, none


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(text))


def runs(text, most_n):
    w = words(text)
    return [" ".join(w[i:i + n]) for n in range(1, most_n + 1) for i in range(len(w) - n + 1)]


def plain(rows, target, most_n, buckets, percent, least, seed):
    def counts(texts):
        return Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in runs(t, most_n))
    s, t = counts(x for _, x in rows), counts(target)
    sa, ta = sum(s.values()), sum(t.values())
    out = []
    for doc_id, text in rows:
        found = [math.floor(1000 * math.log((t[b] + 1) * (sa + buckets) / ((s[b] + 1) * (ta + buckets))))
                 for b in (zlib.crc32(f.encode()) % buckets for f in runs(text, most_n))]
        weight = sum(found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0], -r[2], r[1]))
    for k, r in enumerate(able[:math.floor(percent * len(able) / 100)]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def found(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=repr)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("aZ09é日 .\n-\x00"), max_size=60), st.integers(1, 4))
def test_spans_are_all_runs_of_words(text, most_n):
    got = feature_buckets(collapsed(text.encode()), most_n, 997)
    assert sorted(got.tolist()) == sorted(zlib.crc32(r.encode()) % 997 for r in runs(text, most_n))


TARGET = ["the lazy dog again", None, "", "the MIT license 123", "été"]


@pytest.mark.parametrize("most_n, buckets, percent, least", [(1, 10_000, 10, 20), (1, 10_000, 50, 1), (3, 70_000, 100, 0), (2, 64, 30, 3)])
def test_like_the_plain_version(spark, most_n, buckets, percent, least):
    docs = awkward(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    target = spark.createDataFrame([(t, 1) for t in TARGET], "text string, doc_id int")
    got = resample(docs, target, most_n, buckets, percent, least)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    assert found(got) == plain(rows, TARGET, most_n, buckets, percent, least, 2024)


def test_empty_tables(spark):
    assert resample(none(spark), none(spark)).collect() == []
    assert len(found(resample(awkward(spark), none(spark)))) == awkward(spark).count()


def test_ties_of_copies_and_repeated_rows(spark):
    text = " ".join(["word"] * 30)
    rows = [(5, text)] * 40 + [(k, text) for k in range(100, 160)] + [(None, text)] * 3
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, rank string").repartition(5)
    got = found(resample(docs, docs, percent=60))
    assert sorted(r[4] for r in got if r[4]) == list(range(1, 62))
    assert [r[:4] for r in got] == [r[:4] for r in plain(rows, [t for _, t in rows], 1, 10_000, 60, 20, 2024)]
    assert sorted(r[3] for r in got if r[4])[0] >= sorted(r[3] for r in got if not r[4])[-1]


def test_draws_follow_the_weights():
    """Gumbel scores draw in proportion to exp(weight / 1000)."""
    from orgsift.llm.resampling import SEED
    rng = [int(hashlib.sha256(f"{SEED}:{k}".encode()).hexdigest()[:8], 16) for k in range(40_000)]
    noise = -1000 * np.log(-np.log((np.array(rng) + 0.5) / 4294967296))
    weight = np.where(np.arange(40_000) % 2, 700, 0)
    pairs = (weight + noise).reshape(-1, 2)
    share = (pairs[:, 1] > pairs[:, 0]).mean()
    assert abs(share - 1 / (1 + math.exp(-0.7))) < 0.01
