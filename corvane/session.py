"""Session settings and the one way the engine cuts lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings of a local session for tests and the bench; a cluster brings its own.
LOCAL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.host": "127.0.0.1",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cores: str | int = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").config(map=LOCAL_CONF)
    builder = builder.config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", partitions)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate data: spark.checkpoint.dir, which all executors must reach.

    Where it is unset, a local session gets a temporary folder; a cluster has none that all of it can read, so that
    is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not (context.master == "local" or context.master.startswith("local[")):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="corvane-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def settle(df: DataFrame, keep_partitioning: bool = False) -> DataFrame:
    """Writes df to the shared folder and returns it without its lineage, as rows in Spark's own form.

    With keep_partitioning later joins and aggregates know how its rows lie and don't shuffle them again; an adaptive
    plan tells nothing of that, so that this one plan is made without adaption.

    The files survive the loss of an executor, which a local checkpoint doesn't. For narrow rows that are used soon.
    """
    spark = df.sparkSession
    shared_folder(spark)
    if not keep_partitioning:
        return df.checkpoint()
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        # a new plan is made under the setting
        return df.select("*").checkpoint()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def stored(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder as a compressed columnar table and returns a scan of it.

    For wide rows, or where later steps read some of the columns only.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its scan has fewer parts than there are, as with one small file; else df itself.

    For plain scans before maps that are heavy on CPU; behind a shuffle, asking for the number of parts would run it.
    A table of many files is left as it lies, so no shuffle is added at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df
