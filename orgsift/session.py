"""Session settings and checkpoints."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SCAN_PARTITIONS = "spark.orgsift.scan.partitions"
TASKS_PER_CORE = 8
SENT_ROWS = 100_000


def local_session(name: str = "orgsift", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine.

    The given tables are single files there, so scans of pages and texts are dealt over the cores;
    a cluster leaves SCAN_PARTITIONS unset and sizes its splits with spark.sql.files.maxPartitionBytes.
    """
    builder = SparkSession.builder.config(SCAN_PARTITIONS, cores) if cores.isdigit() else SparkSession.builder
    return (builder.master(f"local[{cores}]").appName(name)
            .config("spark.sql.shuffle.partitions", str(partitions))
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
            .config("spark.driver.memory", "8g")
            .config("spark.driver.host", "127.0.0.1")
            .config("spark.python.sql.dataFrameDebugging.enabled", "false")
            .config("spark.sql.adaptive.enabled", "true")
            .config("spark.sql.adaptive.skewJoin.enabled", "true")
            .getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    A cluster names a folder that all executors share in spark.checkpoint.dir.  Only a session on one
    machine that names none gets a folder of its own.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="orgsift-")
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df to the checkpoint folder and go on from the written copy."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """A table that several steps read, written as Parquet to the checkpoint folder: steps read only the columns they need."""
    folder = f"{shared_folder(df.sparkSession)}/written/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def sent_if_short(df: DataFrame) -> DataFrame:
    """A table for a join, counted first: a short one is sent to all tasks, a longer one meets the other by a sorted shuffle."""
    return df.hint("broadcast" if df.limit(SENT_ROWS + 1).count() <= SENT_ROWS else "merge")


def spread(df: DataFrame, *keys) -> DataFrame:
    """Rows of a narrow table over all cores, before each becomes a page or a text that takes long.

    Such a table is a small file that is read as a few splits, so the work on its rows would stay in a
    few tasks.  With keys, rows that agree in them meet in one task and a grouping needs no more shuffle.
    """
    spark = df.sparkSession
    partitions = spark.conf.get(SCAN_PARTITIONS, None) or TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    return df.repartition(int(partitions), *keys)


def dealt(df: DataFrame) -> DataFrame:
    """A scan over as many partitions as SCAN_PARTITIONS says; as it is read when that is not set."""
    partitions = df.sparkSession.conf.get(SCAN_PARTITIONS, None)
    return df.repartition(int(partitions)) if partitions else df
