"""Sources and sinks of the streaming jobs: file streams in, tables written once per batch out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagefacts.session import STATE_STORE, shared_folder


def file_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Stream of the parquet table `name` below `folder`, a file or a folder of files; the schema is read, never inferred from data.

    A pattern that fits this one name: Spark lists the files of what it finds by it, while a plain path would have to be a folder.
    """
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/[{name[0]}]{name[1:]}")


def write_committed(path: str):
    """Batch writer that replaces its own batch when it is retried, so every row is committed once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over everything that is there now and return the committed table."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    number = spark.conf.get("spark.pagefacts.runs", "0")
    spark.conf.set("spark.pagefacts.runs", str(int(number) + 1))
    base = f"{shared_folder(spark)}/streams/{spark.sparkContext.applicationId}/{name}-{number}"
    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint")
        .foreachBatch(write_committed(f"{base}/table")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch_id", T.LongType())])).option("basePath", f"{base}/table").parquet(f"{base}/table").drop("batch_id")


def latest_per_key(table: DataFrame, key: str, order: str) -> DataFrame:
    """Newest row per key of an update-mode table."""
    rest = [c for c in table.columns if c != key]
    newest = table.groupBy(key).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("_r"))
    return newest.select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])
