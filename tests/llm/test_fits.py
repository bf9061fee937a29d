"""Fits: gradients of the ordinal model, held-out figures on the given tables, and bounds of the samples."""

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from orgsift.llm import language, quality, toxicity

BIG = "/root/testdata/sf0.1"
given_tables = pytest.mark.skipif(not os.path.isdir(BIG), reason="needs the given tables")


def plain_loss(x, words, rows, grade, shrink):
    """The definition, row by row."""
    cuts = [x[words] + sum(np.exp(x[words + 1 + k]) for k in range(j)) for j in range(len(x) - words)]
    total = 0.0
    for cols, g in zip(rows, grade):
        score = sum(x[c] for c in cols)
        at_least = [1.0] + [1 / (1 + np.exp(t - score)) for t in cuts] + [0.0]
        total -= np.log(at_least[g] - at_least[g + 1])
    return total / len(rows) + shrink / 2 * sum(v * v for v in x[:words])


def test_ordinal_likelihood_and_its_gradient():
    rng = np.random.default_rng(0)
    words, n = 6, 25
    rows = [rng.choice(words, rng.integers(0, 4), replace=False).tolist() for _ in range(n)]
    grade = np.concatenate([np.arange(4), rng.integers(0, 4, n - 4)])
    row = np.repeat(np.arange(n), [len(r) for r in rows])
    col = np.array([c for r in rows for c in r])
    x = rng.normal(size=words + 3)
    loss, grad = toxicity.loss_and_gradient(x, words, row, col, grade, 0.01)
    assert abs(loss - plain_loss(x, words, rows, grade, 0.01)) < 1e-12
    for k in range(len(x)):
        step = np.zeros_like(x)
        step[k] = 1e-6
        slope = (plain_loss(x + step, words, rows, grade, 0.01) - plain_loss(x - step, words, rows, grade, 0.01)) / 2e-6
        assert abs(slope - grad[k]) < 1e-6


def test_fit_finds_a_likelier_model_than_no_weights():
    grade = np.repeat([0, 0, 0, 1, 2], 40)
    lists = [[[0], [1], [1, 2]][g] for g in grade]
    columns = np.array([c for x in lists for c in x])
    starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    model = toxicity.fit(columns, starts, grade)
    score = np.array([model.weights[x].sum() for x in lists])
    p = model.at_least(score)
    assert ((p >= 0.5).sum(axis=1) == grade).mean() > 0.95 and (np.diff(model.thresholds) > 0).all()


@given_tables
def test_held_out_toxic_rows(spark):
    docs, labels = spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")
    half = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    model = toxicity.train(docs, labels.where(half))
    rows = toxicity.severity(docs.select("doc_id", "text"), model).join(labels.where(~half), "doc_id").select("toxic", "grade").toPandas()
    toxic, clean = rows[rows.toxic == 1], rows[rows.toxic == 0]
    assert len(toxic) > 100 and (toxic.grade > 0).mean() >= 0.8 and (clean.grade > 0).mean() <= 0.02


@given_tables
def test_held_out_language_and_quality(spark):
    docs, labels = spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")
    told = language.languages(docs, language.train(docs)).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("lang is not null and lang_pred <> 'und'")
    assert told.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0] >= 0.98
    scored = quality.quality_scores(docs, quality.train(docs, labels)).where("held_out").join(labels, "doc_id").where("quality is not null")
    assert scored.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0] >= 0.97


def test_bounds_hold_for_rows(spark):
    """A doc_id on very many rows gives one of them; a rare language is learned."""
    text = "some words that stand here"
    docs = spark.createDataFrame([(4, f"{text} {k}", "en") for k in range(400)] + [(k, text, "en") for k in range(10, 60)] + [(999, "ein ganz anderer Satz", "de")],
                                 "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1, k % 2) for k in [4, *range(10, 60)]], "doc_id long, quality int, toxic int")
    toxic, _, starts = toxicity.training_sample(docs, labels, most=20)
    assert len(toxic) == len(starts) - 1 <= 20
    assert len(quality.train(docs, labels, most=20).vectors) <= 20
    ids = [k for k in range(990, 1010) if zlib.crc32(str(k).encode()) % 4 != 2]
    rare = docs.where("doc_id <> 999").union(spark.createDataFrame([(ids[0], "ein ganz anderer Satz", "de")], docs.schema))
    assert language.train(rare, most=5).languages == ["de", "en"]
