"""Session settings.  Everything here is a plain Spark SQL option; nothing is sized for one machine."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SQL_OPTIONS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Let AQE split a hot (page_id, ancestor) key even when that costs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # The scan budget is 20,000 nodes: keep the per-partition top-k cut for limits of that size.
    "spark.sql.optimizer.windowGroupLimitThreshold": "50000",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # The JVM leaves methods of more bytes than this interpreted; Spark then cuts such a stage into smaller ones.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime options to an existing session."""
    for key, value in SQL_OPTIONS.items():
        spark.conf.set(key, value)
    return spark


def build(app_name: str = "pagefacts", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**SQL_OPTIONS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder that every executor can reach, from `spark.checkpoint.dir`.

    A session on a cluster that names none is refused; one that runs in a single process gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = spark.conf.get("spark.pagefacts.localFolder", None)
    if local is None:
        local = tempfile.mkdtemp(prefix="pagefacts-")
        spark.conf.set("spark.pagefacts.localFolder", local)
    return local


def checkpointed(rows: DataFrame) -> DataFrame:
    """`rows` written to the shared folder: lineage ends there, and a lost executor costs one read."""
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(rows.sparkSession))
    return rows.checkpoint(eager=True)


def written(rows: DataFrame) -> DataFrame:
    """`rows` as a Parquet table in the shared folder: as safe as `checkpointed`, smaller, and read by column."""
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/written/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
