"""Recorded snapshots: nested JSON lines with a fixed schema; unreadable rows are kept apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SNAPSHOT_SCHEMA = (
    "session_id string, snapshot_id string, observation_index int, captured_at string, status string, requested_profile string, "
    "inner_width double, inner_height double, process_state string, page_fingerprint string, "
    "elements array<struct<node_id: string, document_order: int, binding_state: string, overflowing: boolean>>, "
    "_corrupt_record string"
)


def read_snapshots(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(snapshots, elements, corrupt)."""
    rows = spark.read.schema(SNAPSHOT_SCHEMA).option("mode", "PERMISSIVE").json(path)
    good = rows.filter("snapshot_id IS NOT NULL AND session_id IS NOT NULL").drop("_corrupt_record")
    elements = good.select("session_id", "snapshot_id", F.posexplode("elements").alias("position", "e")).select(
        "session_id", "snapshot_id", "position", "e.*")
    # A filter on the corrupt column alone would prune every other column and change what is read.
    corrupt = rows.filter("snapshot_id IS NULL OR session_id IS NULL").select("_corrupt_record", "snapshot_id")
    return good.drop("elements"), elements, corrupt
