"""Derived shapes written once per session to the cluster's shared folder and read back as tables.

A written table is what recorded nodes and observations are in production; it also cuts lineage in a way
that survives the loss of executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagefacts.session import shared_folder, tune

_WRITTEN: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    return spark.read.parquet(stored_path(spark, sf_dir, name, build))


def stored_path(spark: SparkSession, sf_dir: str, name: str, build: Callable[[SparkSession, str], DataFrame]) -> str:
    tune(spark)
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _WRITTEN:
        label = sf_dir.strip("/").replace("/", "_")
        path = f"{shared_folder(spark)}/shapes/{key[0]}/{label}/{name}"
        build(spark, sf_dir).write.mode("overwrite").parquet(path)
        _WRITTEN[key] = path
    return _WRITTEN[key]


def stored_json(spark: SparkSession, sf_dir: str, name: str, build: Callable[[SparkSession, str], DataFrame]) -> str:
    """Path of a shape written as JSON lines (for readers of nested JSON)."""
    tune(spark)
    key = (spark.sparkContext.applicationId, sf_dir, f"{name}.json")
    if key not in _WRITTEN:
        path = f"{shared_folder(spark)}/shapes/{key[0]}/{sf_dir.strip('/').replace('/', '_')}/{name}_json"
        build(spark, sf_dir).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
        _WRITTEN[key] = path
    return _WRITTEN[key]


def stored_text(spark: SparkSession, sf_dir: str, name: str, build: Callable[[SparkSession, str], DataFrame]) -> str:
    """Path of a shape written as plain lines (column `value`)."""
    tune(spark)
    key = (spark.sparkContext.applicationId, sf_dir, f"{name}.txt")
    if key not in _WRITTEN:
        path = f"{shared_folder(spark)}/shapes/{key[0]}/{sf_dir.strip('/').replace('/', '_')}/{name}_text"
        build(spark, sf_dir).write.mode("overwrite").text(path)
        _WRITTEN[key] = path
    return _WRITTEN[key]
