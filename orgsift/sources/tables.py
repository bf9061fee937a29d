"""Readers and writers: search results, stored pages, outputs and failure tables."""

from pyspark.sql import DataFrame, SparkSession, types as T, functions as F

from ..operators.ordering import global_places, keep_first

SEARCH_RESULTS = T.StructType([T.StructField(n, T.StringType()) for n in ("title", "abstract", "url", "original_query")])
ORGANISATIONS = T.StructType([
    T.StructField("organization_name", T.StringType()), T.StructField("url", T.StringType()),
    T.StructField("type", T.StringType()), T.StructField("source_url", T.StringType()),
    T.StructField("confidence_score", T.DoubleType()), T.StructField("extraction_method", T.StringType()),
    T.StructField("description", T.StringType())])
CONTENT = T.StructType([T.StructField(n, T.StringType()) for n in ("title", "url", "content_type", "source_url", "description")])
PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return (spark.read.schema(schema).option("header", True).option("multiLine", True)
            .option("quote", '"').option("escape", '"').option("enforceSchema", True).csv(path))


def read_search_results(spark: SparkSession, path: str) -> DataFrame:
    """Search results without rows that have no URL.  Files without original_query are read too."""
    return read_csv(spark, path, SEARCH_RESULTS).dropna(subset=["url"])


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Stored pages; they stand for fetched ones."""
    return spark.read.parquet(path).select("page_id", "url", "html")


def read_organisations(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, ORGANISATIONS)


def read_with_failures(spark: SparkSession, path: str, schema: T.StructType):
    """(rows, failures): lines that do not fit the schema become rows of a failure table."""
    marked = T.StructType(schema.fields + [T.StructField("_broken", T.StringType())])
    rows = (spark.read.schema(marked).option("header", True).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_broken").csv(path))
    return split_failures(rows, F.col("_broken").isNull(), "_broken")


def split_failures(df: DataFrame, ok, reason: str = None):
    """(good, failed) by a condition; `reason` is dropped from the good rows and kept in the failed ones."""
    good = df.filter(F.coalesce(ok, F.lit(False)))
    failed = df.filter(~F.coalesce(ok, F.lit(False)))
    return (good.drop(reason) if reason else good), failed


def flatten_for_csv(df: DataFrame, separator: str = ", ") -> DataFrame:
    """Array columns become joined strings, maps and structs JSON."""
    out = {}
    for field in df.schema.fields:
        if isinstance(field.dataType, T.ArrayType):
            out[field.name] = F.array_join(F.col(field.name).cast("array<string>"), separator)
        elif isinstance(field.dataType, (T.MapType, T.StructType)):
            out[field.name] = F.to_json(field.name)
    return df.withColumns(out) if out else df


def write_outputs(df: DataFrame, path: str, fmt: str = "parquet", score: str = None, partition_by=(), mode: str = "overwrite") -> None:
    """Write a table, best score first when a score column is named: over all files, or in each partition."""
    if fmt == "csv":
        df = flatten_for_csv(df)
    if partition_by:
        order = [F.desc(score)] if score else []
        df = df.repartitionByRange(*partition_by, *order).sortWithinPartitions(*partition_by, *order)
    elif score:
        df = df.orderBy(F.desc(score))
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def originating_query(results: DataFrame, result_set: str = "result_set_id", position: str = "position") -> DataFrame:
    """The query behind each result set: the first one that is filled."""
    return (results.filter(F.col("original_query").isNotNull()).groupBy(result_set)
            .agg(F.min_by("original_query", position).alias("original_query")))


def append_reclassified(results: DataFrame, reclassified: DataFrame, position: str = "position") -> DataFrame:
    """Reclassified rows join the search results as new entries; the first row per URL stays."""
    fresh = reclassified.select(
        F.col("name").alias("title"),
        F.concat(F.lit("Reclassified: "), F.coalesce("reason_for_reclassification", F.lit("Homepage validation failed"))).alias("abstract"),
        F.coalesce("homepage_url", "url").alias("url"), F.col(position), F.lit(1).alias("part"))
    both = results.withColumn("part", F.lit(0)).unionByName(fresh, allowMissingColumns=True)
    return keep_first(both, ["url"], ["part", position]).drop("part")


def with_new_ids(existing: DataFrame, new: DataFrame, order: str, key: str = "id") -> DataFrame:
    """New rows numbered on from the greatest existing id, in the given order."""
    top = existing.agg(F.coalesce(F.max(key), F.lit(0))).scalar()
    numbered = global_places(new, [order], "_n")
    return numbered.withColumn(key, F.col("_n") + top).drop("_n")


def append_vocabulary(existing: DataFrame, new: DataFrame, path: str, order: str) -> None:
    with_new_ids(existing, new, order).write.mode("append").parquet(path)
