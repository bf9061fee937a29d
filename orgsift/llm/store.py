"""Tables written once and read again, in the shared folder named by spark.checkpoint.dir."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

from ..session import shared_folder


def stored(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends here, lost tasks reread the files."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def checkpointed(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder, for small tables of loops."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


BATCH_BYTES = "8m"
_BATCH, _SPARKS_OWN = "spark.sql.execution.arrow.maxBytesPerBatch", ("67108864b", "64MB", "64m")


def small_batches(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches hold at most BATCH_BYTES (and one row); a bound that the session names itself stays."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH) in _SPARKS_OWN:
        conf.set(_BATCH, BATCH_BYTES)
    return df


def one_row_each(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of docs(doc_id, text) whose doc_id is in chosen(doc_id, ..), one for each doc_id: the smallest by a hash of the text.

    The smallest hash is found first, over numbers; each task keeps one row of a doc_id before texts travel.
    """
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").withColumn("_hash", F.xxhash64("text"))
    return rows.groupBy("doc_id", *[c for c in chosen.columns if c != "doc_id"]).agg(
        F.min_by("text", F.struct("_hash", "text")).alias("text")).select("doc_id", "text", *[c for c in chosen.columns if c != "doc_id"])


def as_written(df: DataFrame) -> DataFrame:
    """The rows of files that were just read, in the order of their files and of the rows in them; another df as it is.

    Spark deals files to tasks by their size.  Here ranges of the order are dealt instead, so task
    after task holds what was written one after the other.
    """
    try:
        placed = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_place"))
    except AnalysisException:  # not a plain read of files
        return df
    return placed.repartitionByRange("_file", "_place").sortWithinPartitions("_file", "_place").drop("_file", "_place")
