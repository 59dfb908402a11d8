"""Session settings the library expects; a cluster may set its own."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: str = "8", memory: str = "8g", **extra: str) -> SparkSession:
    """A session for tests and the bench; the UI is off so no port is opened for it."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tagspark")
    settings = {
        **SETTINGS,
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **extra,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see (``spark.checkpoint.dir``).

    A cluster names its own; where the session names none, one inside the warehouse, which is shared too, is set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for a scan that would leave most of them idle.

    One unsplittable file (a zipped register, a single row group) is read by one
    task. If a scan has fewer partitions than there are cores, its rows are dealt
    out evenly; larger tables pass unchanged. Meant for plain scans.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def keep_table(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of a table that is read several times: it is written to the shared folder and read back,
    so a lost executor costs no reader its input, and numbers given to rows stay. ``release`` removes the files."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept._kept_at = path
    return kept


def release(*tables: DataFrame) -> None:
    """Remove the files behind tables of :func:`keep_table`; nothing may read them any more."""
    for table in tables:
        where = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._kept_at)
        where.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
