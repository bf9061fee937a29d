"""One document of each group of copies: which rows of a table stay.

The operators that find copies name rows by a whole number.  A doc_id can be null or stand on several
rows, so every row first gets a number of its own, which it keeps however often it is read again.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

from .exact_dups import deduplicated
from .near_dups import near_duplicates
from .store import stored


def numbered(docs: DataFrame) -> DataFrame:
    """docs with a number of its own for each row, `_row`, that is the same whenever the row is read.

    Rows of files are numbered by their file and their place in it, so nothing is copied; the files
    are counted once, and their table has one row per file.  Another table is written with its numbers.
    """
    try:
        placed = docs.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_place"))
    except AnalysisException:  # not a plain read of files
        return stored(docs.withColumn("_row", F.monotonically_increasing_id()))
    files = sorted(r[0] for r in docs.select("_metadata.file_path").distinct().collect())
    if not files:
        return docs.withColumn("_row", F.lit(0).cast("long"))
    names = docs.sparkSession.createDataFrame(list(enumerate(files)), "_no long, _file string")
    return placed.join(F.broadcast(names), "_file").withColumn("_row", F.shiftleft("_no", 36) + F.col("_place")).drop("_no", "_file", "_place")


def _named(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("_row").alias("doc_id"), "text")


def _without_others(rows: DataFrame, grouped: DataFrame, best: Column) -> DataFrame:
    """rows without those that are in a group of grouped(_row, group, ..) and not its best one.

    Only groups of two rows or more are looked at, and only numbers of dropped rows meet the texts.
    """
    several = grouped.groupBy("group").agg(best.alias("_best"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    dropped = stored(grouped.join(stored(several.select("group", F.col("_best._row").alias("_stays"))), "group").where("_row <> _stays").select("_row"))
    return rows.join(dropped, "_row", "left_anti").drop("_row")


def one_of_equal_texts(docs: DataFrame) -> DataFrame:
    """The rows of docs(doc_id, text, ..) without copies: of texts that are equal with A-Z lower-cased, the largest doc_id stays.

    A null doc_id stays only if its group has no other; of rows that repeat the doc_id that stays, one
    does.  A null text is empty.  No rows give no rows; other columns stay as they are.
    """
    rows = numbered(docs)
    found = deduplicated(_named(rows)).select(F.col("doc_id").alias("_row"), F.col("text_sha256").alias("group"))
    grouped = found.join(rows.select("_row", "doc_id"), "_row")
    return _without_others(rows, grouped, F.max(F.struct(F.col("doc_id").isNotNull().alias("_named"), "doc_id", (-F.col("_row")).alias("_first"), "_row")))


def one_of_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs(doc_id, text, ..) without near copies: of each component of linked texts, the smallest doc_id stays.

    A null doc_id stays only if its component has no other; of rows that repeat the doc_id that stays,
    one does.  Texts without words are linked with nothing, so they stay; rows that repeat the doc_id
    and the text of such a row count once.  No rows give no rows; other columns stay as they are.
    """
    rows = numbered(docs)
    found = stored(near_duplicates(_named(rows)).select(F.col("doc_id").alias("_row"), "n_shingles", "component_id"))
    wordless = F.col("n_shingles") == 0
    alone = found.where(wordless).select("_row")
    linked = found.where(~wordless).join(rows.select("_row", "doc_id"), "_row").select(
        "_row", "doc_id", F.struct("component_id", F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("text")).alias("group"))
    empty = rows.join(alone, "_row", "left_semi").select(
        "_row", "doc_id", F.struct(F.lit(None).cast("long").alias("component_id"), F.col("doc_id").alias("id"), "text").alias("group"))
    return _without_others(rows, linked.unionByName(empty), F.min(F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", "_row")))
