"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLANK = r"[\x20\x09-\x0D]+"
NOT_BLANK = r"[^\x20\x09-\x0D]"
BATCH_BYTES = "4m"
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from `spark.checkpoint.dir`; a local session that names none gets its own.

    A session that runs on a cluster and names no shared folder is refused: executors would not see each other's files.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    named = spark.conf.get("spark.llm.checkpoint.dir", None)
    if named is None:
        named = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.llm.checkpoint.dir", named)
    return named


def checkpointed(rows: DataFrame) -> DataFrame:
    """`rows` written to the shared folder: lineage ends there, and a lost executor costs one read."""
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(rows.sparkSession))
    return rows.checkpoint(eager=True)


def bounded_batches(rows: DataFrame) -> DataFrame:
    """Whole texts are long rows: what goes to Python at once is bounded in bytes."""
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return rows


def texts(rows: DataFrame, *keep: str, data: str = "data") -> DataFrame:
    """Only the named columns and the text, a null text as the empty one."""
    return bounded_batches(rows).select(*keep, F.coalesce(F.col(data), F.lit("")).alias(data))


def quantile_bounds(rows: DataFrame, key: str, parts: int) -> list:
    """At most `parts` ascending values of `key` that cut `rows` into about equal ranges; the lowest value comes first."""
    steps = [i / parts for i in range(1, parts)]
    found = rows.agg(F.min(key).alias("low"), F.percentile_approx(key, steps, 10_000).alias("cuts")).first()
    return [] if found.low is None else sorted({found.low, *(found.cuts or [])})


def range_of(key: str | Column, bounds: list) -> Column:
    """Number of the range of `quantile_bounds` that `key` falls in, from 1; a null key is in range 0."""
    key = F.col(key) if isinstance(key, str) else key
    sorted_bounds = F.array(*map(F.lit, bounds))
    return F.when(key.isNull(), 0).otherwise(F.size(F.filter(sorted_bounds, lambda bound: bound <= key)))
