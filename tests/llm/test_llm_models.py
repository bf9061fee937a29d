"""Severity, quality and language models: gradients, held-out accuracy and awkward rows; mixing against its definition."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from orgsift.llm import language, mixing, quality, toxicity
from cases import HAVE_SF, TEXTS, awkward, none

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def corpus(spark):
    """Texts in two languages; bad ones shout, toxic ones hold two or more of some words."""
    rnd, docs, labels = random.Random(4), [], []
    words = {"en": [f"{a}{b}" for a in ("th", "sho", "wa", "ing") for b in ("ere", "at", "on", "ly")],
             "de": [f"{a}{b}" for a in ("sch", "ge", "ung", "für") for b in ("keit", "en", "ach", "ü")]}
    for i in range(900):
        lang = rnd.choice(["en", "de"])
        text = [rnd.choice(words[lang]) for _ in range(rnd.randrange(20, 80))]
        toxic, bad = rnd.random() < 0.2, rnd.random() < 0.3
        if toxic:
            text += rnd.choices(["vilex", "scumx", "nastyx"], k=rnd.randrange(2, 6))
            rnd.shuffle(text)
        text = " ".join(w.upper() + "!!" if bad else w for w in text)
        docs.append((i, text, lang))
        if i % 5:
            labels.append((i, int(not bad), int(toxic)))
    truth = {d: (lang, q, t) for (d, _, lang), (_, q, t) in zip([x for x in docs if x[0] % 5], labels)}
    return spark.createDataFrame(docs, "doc_id long, text string, lang string").cache(), spark.createDataFrame(labels, LABELS).cache(), truth


def test_severity_rises_with_toxic_words(spark, corpus):
    docs, labels, truth = corpus
    model = toxicity.train(docs, labels)
    assert (np.diff(model.thresholds) > 0).all()
    out = {r.doc_id: r for r in toxicity.severity(docs, model).collect()}
    assert np.mean([(out[d].p_toxic >= 0.5) == bool(t) for d, (_, _, t) in truth.items()]) > 0.99
    for r in out.values():
        assert 0 <= r.severity <= len(model.thresholds) and 0 <= r.grade <= len(model.thresholds)
    one, many = toxicity.severity(spark.createDataFrame([(1, "there vilex"), (2, "there vilex scumx nastyx")], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert one.severity < many.severity
    kept = {r.doc_id for r in toxicity.without_toxic(docs, model).collect()}
    assert kept == {d for d, r in out.items() if r.p_toxic < 0.5}


def test_ordinal_gradient_reaches_the_maximum():
    """Shared weights and ordered thresholds recover the grades of separable rows."""
    columns = np.array([c for g in range(4) for _ in range(50) for c in range(g + 1)])
    counts = np.array([g + 1 for g in range(4) for _ in range(50)])
    grade = np.repeat(np.arange(4), 50)
    model = toxicity.fit(columns, np.concatenate([[0], np.cumsum(counts)]), grade)
    score = np.array([model.weights[:g + 1].sum() for g in range(4)])
    assert [(model.at_least(np.array([s])) >= 0.5).sum() for s in score] == [0, 1, 2, 3]


def test_awkward_rows_of_severity(spark, corpus):
    model = toxicity.train(corpus[0], corpus[1])
    out = toxicity.severity(awkward(spark), model)
    assert out.columns.count("severity") == 1 and dict(out.dtypes)["severity"] == "double"
    assert Counter(r.doc_id for r in out.collect()) == Counter(d for d, *_ in TEXTS)
    kept = toxicity.without_toxic(awkward(spark), model)
    assert kept.columns == awkward(spark).columns and kept.count() == len(TEXTS)
    assert toxicity.severity(none(spark), model).collect() == []
    blank = toxicity.train(corpus[0], spark.createDataFrame([(1, None, None), (None, 1, 1)], LABELS))
    assert {r.grade for r in toxicity.severity(awkward(spark), blank).collect()} == {0}


# ------------------------------------------------------------------ quality

def test_quality_of_held_out_documents(spark, corpus):
    docs, labels, truth = corpus
    model = quality.train(docs, labels)
    assert len(model.labels) == sum(zlib.crc32(str(d).encode()) % 4 != 2 for d in truth)
    out = {r.doc_id: r for r in quality.quality_scores(docs, model).collect()}
    held = [d for d in truth if zlib.crc32(str(d).encode()) % 4 == 2]
    assert all(out[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d in out)
    assert np.mean([out[d].predicted == truth[d][1] for d in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out.values())


def test_votes_are_exact():
    rng = np.random.default_rng(3)
    counts = rng.poisson(0.01, (80, quality.TERMS)).astype(np.float32)
    model = quality.fit(counts[:60], (np.arange(60) % 3 > 0).astype(int), 8)
    for row, score in zip(counts[60:], model.score(counts[60:])):
        v = model.latent(row[None])[0]
        cosine = model.vectors @ v
        near = np.argsort(-cosine)[:quality.NEIGHBOURS]
        w = np.maximum(cosine[near], 0)
        assert score == pytest.approx((w * model.labels[near]).sum() / w.sum(), abs=1e-5)


def test_awkward_rows_of_quality(spark, corpus):
    model = quality.train(corpus[0], corpus[1])
    out = quality.quality_scores(awkward(spark), model).collect()
    assert Counter(r.doc_id for r in out) == Counter(d for d, *_ in TEXTS)
    empty = [r.score for r in out if r.doc_id in (4, 5)]
    assert empty == [pytest.approx(model.labels.mean())] * 2 and not any(r.held_out for r in out if r.doc_id is None)
    assert quality.quality_scores(none(spark), model).collect() == []
    blank = quality.train(corpus[0], spark.createDataFrame([], LABELS))
    assert {r.score for r in quality.quality_scores(awkward(spark), blank).collect()} == {0.5}


# ------------------------------------------------------------------ language

def test_gradients_through_time():
    rng = np.random.default_rng(0)
    size = 4
    way = language.Direction(*[rng.standard_normal(s) * 0.5 for s in ((256, 3 * size), (size, 2 * size), (size, size))])
    words, target = rng.integers(0, 256, (3, 5)), rng.standard_normal((5, 3, size))
    loss = lambda: float((language.states(way, words) * target).sum())
    trace = []
    language.states(way, words, trace)
    grad = language.back_through_time(way, words, trace, target.astype(np.float32))
    for values, found in ((way.table, grad.table), (way.gates, grad.gates), (way.fresh, grad.fresh)):
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in values.shape) if values is not way.table else (words[0, 2], rng.integers(0, 3 * size))
            old, eps = values[at], 1e-3
            values[at] = old + eps
            up = loss()
            values[at] = old - eps
            down = loss()
            values[at] = old
            assert found[at] == pytest.approx((up - down) / (2 * eps), abs=2e-3)


def test_language_of_held_out_documents(spark, corpus):
    docs, _, truth = corpus
    model = language.train(docs)
    out = {r.doc_id: r for r in language.languages(docs, model).collect()}
    held = [d for d in truth if zlib.crc32(str(d).encode()) % 4 == 2]
    assert np.mean([out[d].lang_pred == truth[d][0] for d in held]) > 0.98
    odd = language.languages(awkward(spark), model).collect()
    assert Counter(r.doc_id for r in odd) == Counter(d for d, *_ in TEXTS)
    by = {r.doc_id: r for r in odd if r.doc_id is not None}
    assert all(by[d].lang_pred == "und" for d in (4, 5, 6, 9)) and all(by[d].lang_pred != "und" for d in (7, 12, 14, 15))
    assert all(0 <= r.score <= 1 for r in odd)
    assert language.languages(none(spark), model).collect() == []
    blank = language.train(docs.where("false"))
    assert {r.lang_pred for r in language.languages(awkward(spark), blank).collect()} == {"und"}


def test_pooling_covers_every_position():
    """Distinct words run once give what running every word gives."""
    rng = np.random.default_rng(1)
    model = language.fit([b"ab", b"cd", b"ef"], np.array([0, 1, 1]), ["x", "y"], steps=5)
    texts = ["ab cd ab " * 3 + "z" * 130, "", "1 2", "é ab"]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    got, positions = language.pooled(model, np.frombuffer(b"".join(raw), np.uint8), offsets)
    for t, text in enumerate(raw):
        words = [w[i:i + language.WINDOW] for w in text.split() if w not in (b"1", b"2") for i in range(0, len(w), language.WINDOW)]
        parts = [language.position_labels(model, np.frombuffer(w, np.uint8)[None]).sum(axis=(0, 1)) for w in words]
        assert positions[t] == sum(map(len, words))
        assert got[t] == pytest.approx(sum(parts) / max(1, positions[t]) if parts else [0, 0], abs=1e-4)


# ------------------------------------------------------------------ mixing

def test_exponent_meets_its_targets(spark):
    tokens = [1000, 100, 100, 10]
    shares = np.array(tokens) / sum(tokens)
    frame = spark.createDataFrame([(float(math.log(p)),) for p in shares], "log_share double")

    def entropy(a):
        w = shares ** a / (shares ** a).sum()
        return -(w * np.log(w)).sum()

    a = mixing.exponent(frame, 0.9, 1e9)
    assert entropy(a) == pytest.approx(0.9 * math.log(4), abs=1e-5)
    a = mixing.exponent(frame, 1.0, 2.0)
    assert (shares.max() / shares.min()) ** (1 - a) == pytest.approx(2.0, abs=1e-5)
    assert mixing.exponent(frame, 0.0, 5.0) == pytest.approx(1.0, abs=1e-6)
    assert mixing.exponent(frame.where("false"), 0.9, 2.0) == 1.0


def test_draws_follow_the_weights(spark):
    rnd = random.Random(2)
    rows = [(i, "w " * rnd.randrange(1, 40), rnd.choices(["big", "mid", None], [80, 15, 5])[0]) for i in range(4000)] + [(9000, "", "none"), (9001, None, "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    out = mixing.mixed(docs, 0.95, 3.0).withColumn("n", mixing.n_tokens(F.col("text"))).collect()
    draws = Counter(r.doc_id for r in out)
    assert set(draws) == {d for d, *_ in rows} and max(draws.values()) <= 3
    drawn, weight = defaultdict(int), {}
    for r in out:
        drawn[r.source] += r.n
        weight[r.source] = r.mix_weight
    assert sum(weight.values()) == pytest.approx(1.0)
    for s, n in drawn.items():
        assert n / sum(drawn.values()) == pytest.approx(weight[s], abs=0.02)
    by = defaultdict(set)
    for r in out:
        by[r.source, r.mix_block].add(draws[r.doc_id])
    assert all(len(v) == 1 for v in by.values())  # whole blocks are drawn


def test_awkward_rows_of_mixing(spark):
    docs = awkward(spark)
    out = mixing.mixed(docs)
    assert set(out.columns) == set(docs.columns) | {"mix_pass", "mix_block", "mix_weight", "mix_order"}
    once = Counter(r.doc_id for r in out.where("mix_pass = 1").collect())
    assert once == Counter(d for d, *_ in TEXTS)
    assert mixing.mixed(none(spark)).collect() == []
