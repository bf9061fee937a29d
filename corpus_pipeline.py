"""Corpus preparation: toxicity, exact copies, near copies, source mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from orgsift.llm.keepers import one_of_equal_texts, one_of_near_copies
from orgsift.llm.mixing import mixed
from orgsift.llm.packing import pack
from orgsift.llm.store import as_written, stored
from orgsift.llm.toxicity import train, without_toxic

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of any toxic grade is under one half; fitted on labelled documents.

    Null and empty texts have no toxic words and stay; repeated rows are judged alike; no rows give no rows.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return without_toxic(docs.select(*COLUMNS), train(docs, labels))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest doc_id; a null doc_id only if there is no other.

    A null text is empty; of rows that repeat the doc_id that stays, one does; no rows give no rows.
    """
    return one_of_equal_texts(docs.select(*COLUMNS))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked texts: the one with the smallest doc_id; a null doc_id only if there is no other.

    Texts without words are all kept, each doc_id and text of them once; no rows give no rows.
    """
    return one_of_near_copies(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per draw of a document, in drawn order; no document is left out, and none of a small source is drawn more than three times.

    The hash of the text tells rows of one doc_id apart, so that no range is a single doc_id.
    """
    order = ["mix_pass", "mix_order", "doc_id", "_text"]
    drawn = mixed(docs.select(*COLUMNS)).withColumn("_text", F.xxhash64("text"))
    return drawn.repartitionByRange(*order).sortWithinPartitions(*order).select(*COLUMNS)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 4096 tokens, with their ids; a written table is packed in the order in which it was written.

    Null and empty texts are the end id alone; repeated rows, such as further draws, are packed one by one; no rows give no rows.
    """
    return pack(as_written(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: Ordinal regression, the exponent search and least squares have no SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written and read again by the next.

    No documents give no pieces; null, empty and repeated rows go through the stages as each of them says.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
