"""Tables kept between jobs in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; only a local session without one gets its own."""
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if shared is None:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="spark-marlstone-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared)
    return shared


#: How many times larger a table's rows may be in memory than its columnar files, from which Spark estimates.
PACKED = 32


def measured_broadcasts(spark: SparkSession) -> None:
    """Have the session broadcast tables by their measured size; an estimate from files counts :data:`PACKED` times.

    Columns of few distinct values take a thirtieth of their rows' size on disk. The driver holds what it broadcasts, so
    that a table of a million rows, estimated at 1 MB, takes its memory. The limit itself stays: tables that turn out
    smaller when they are shuffled are broadcast then.
    """
    measured, estimated = "spark.sql.adaptive.autoBroadcastJoinThreshold", "spark.sql.autoBroadcastJoinThreshold"
    if spark.conf.get(measured, None) is None:
        limit = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
        spark.conf.set(measured, str(limit))
        spark.conf.set(estimated, str(limit // PACKED if limit > 0 else limit))


def checkpointed(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept in the shared folder, with its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame, name: str = "kept") -> DataFrame:
    """The same as a Parquet table in the shared folder: smaller than a checkpoint. It goes when the session's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _goes(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def kept_buckets(df: DataFrame, name: str, keys: list[str], compression: str = "snappy") -> DataFrame:
    """The same as a Parquet table dealt by ``keys`` into as many buckets as shuffles have partitions, each sorted by them.

    Joins and groupings by these keys read it without an exchange.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{table}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).option("compression", compression).option("path", path).saveAsTable(table)
    _goes(spark, path)
    return spark.table(table)


def _goes(spark: SparkSession, path: str) -> None:
    """Have the folder deleted when the session's JVM ends."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
