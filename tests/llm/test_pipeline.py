"""The corpus pipeline, stage by stage, against brute force on its own input."""

import hashlib

import numpy as np
import pytest

import corpus_pipeline as pipeline
from orgsift.llm.mixing import mixed
from orgsift.llm.packing import Encoder, default_tokenizer
from orgsift.llm.queries import QUERIES
from cases import HAVE_SF, SF, TEXTS, awkward, lowered
from test_dups import brute

pytestmark = pytest.mark.skipif(not HAVE_SF, reason="needs the given tables")


def test_stages_follow_each_other(spark):
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    out = pipeline.drop_toxic(spark, docs, SF)
    assert out.columns == docs.columns
    clean = {r.doc_id: r.text for r in out.collect()}
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    assert set(clean) <= set(before) and len(set(before) - set(clean)) <= 3 * max(1, len(toxic))

    unique = pipeline.drop_copies(spark, out, SF).collect()
    tops = {}
    for d, t in clean.items():
        sha = hashlib.sha256(lowered(t).encode()).hexdigest()
        tops[sha] = max(d, tops.get(sha, d))
    assert {r.doc_id for r in unique} == set(tops.values()) and len(unique) == len(tops)

    kept = pipeline.drop_near_copies(spark, spark.createDataFrame(unique, docs.schema), SF).collect()
    assert {r.doc_id for r in kept} == {c for _, c in brute([(r.doc_id, r.text) for r in unique]).values()}

    drawn = pipeline.mix_sources(spark, spark.createDataFrame(kept, docs.schema), SF)
    assert drawn.columns == docs.columns
    rows = drawn.collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in kept}

    pieces = pipeline.pack_windows(spark, drawn, SF).collect()
    encoder = Encoder(default_tokenizer())
    assert sum(p.length for p in pieces) == sum(len(x) for x in encoder.encode([r.text.encode() for r in rows]))
    assert all(np.frombuffer(p.ids, "<u4").size == p.length for p in pieces)


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, SF).collect() == []


def test_all_are_registered():
    assert {int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")} == set(range(1, 14))


def pairs(rows):
    return {(r.doc_id, r.text) for r in rows}


def test_rows_without_a_number_are_told_apart(spark):
    kept = pairs(pipeline.drop_near_copies(spark, awkward(spark), SF).collect())
    assert {(None, "a text without a number"), (None, None), (4, None), (5, ""), (6, " \t\n ")} <= kept
    assert {d for d, _ in kept if d in (1, 2, 3, 10, 11)} == {1, 10}
    rows = [(None, "only here in this table", "en", "a"), (None, "a copy of a row with a number", "en", "a"), (5, "a copy of a row with a number", "en", "a")]
    wanted = {(None, "only here in this table"), (5, "a copy of a row with a number")}
    for stage in (pipeline.drop_copies, pipeline.drop_near_copies):
        assert pairs(stage(spark, awkward(spark, rows), SF).collect()) == wanted


def test_repeated_rows_and_ids_with_two_texts(spark):
    a, b = "the first text of two under one number", "quite another one that stands nowhere else"
    rows = [(7, a, "en", "a"), (7, b, "en", "a"), (9, a, "en", "b"), (8, b + " too", "fr", "c"), (8, b + " too", "fr", "c"), (8, b + " too", "de", "c"),
            (None, "x y z", "en", "a"), (None, "x y z", "en", "a"), (6, "", "en", "a"), (6, "", "en", "a"), (6, None, "en", "a")]
    ordered = lambda stage: sorted(((r.doc_id, r.text) for r in stage(spark, awkward(spark, rows), SF).collect()), key=repr)
    copies = ordered(pipeline.drop_copies)
    assert len(copies) == 5 and [p for p in copies if p[1]] == sorted([(9, a), (7, b), (8, b + " too"), (None, "x y z")], key=repr)
    near = ordered(pipeline.drop_near_copies)
    assert near == sorted([(7, a), (7, b), (None, "x y z"), (6, ""), (6, None)], key=repr)


def test_draws_come_in_their_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*pipeline.COLUMNS)
    wanted = [r.doc_id for r in sorted(mixed(docs).collect(), key=lambda r: (r.mix_pass, r.mix_order, r.doc_id))]
    assert [r.doc_id for r in pipeline.mix_sources(spark, docs, SF).collect()] == wanted


@pytest.mark.parametrize("name, stage", pipeline.STAGES)
def test_every_stage_takes_awkward_rows(spark, name, stage):
    docs = awkward(spark)
    out = stage(spark, docs, SF).collect()
    if name == "exact_dedup":
        assert {lowered(r.text) for r in out} == {lowered(t) for _, t, *_ in TEXTS}
    elif name == "mixing":
        assert pairs(out) == {(d, t) for d, t, *_ in TEXTS}
    elif name == "packing":
        assert {r.doc_id for r in out} == {d for d, *_ in TEXTS}
    else:
        assert (None, "a text without a number") in pairs(out)


def test_packing_follows_the_drawn_order(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*pipeline.COLUMNS)
    drawn = pipeline.mix_sources(spark, docs, SF)
    drawn.write.parquet(f"{tmp_path}/drawn")
    wanted = [r.doc_id for r in sorted(mixed(docs).collect(), key=lambda r: (r.mix_pass, r.mix_order, r.doc_id))]
    read = spark.read.parquet(f"{tmp_path}/drawn")
    assert [r.doc_id for r in pipeline.as_written(read).collect()] == wanted
    assert pipeline.as_written(docs.groupBy("source").count()).columns == ["source", "count"]
    # every task packs a run of the order: a document's draws meet sequences in the same order
    firsts = pipeline.pack_windows(spark, read, SF).where("start = 0").selectExpr("doc_id", "sequence_id >> 36 AS task").collect()
    tasks = {}
    for r in firsts:
        tasks.setdefault(r.task, set()).add(r.doc_id)
    at = 0
    for task in sorted(tasks):
        n = sum(r.task == task for r in firsts)
        assert set(wanted[at:at + n]) == tasks[task]
        at += n
    assert at == len(wanted)
