"""Evidence sink: artifact rows to partitioned tables plus a manifest of paths, sizes and digests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagefacts.functions.digests import digest

MANIFEST = "package-manifest.json"
CHECKSUMS = "checksums.sha256"


def package_manifest(artifacts: DataFrame) -> DataFrame:
    """(package_id, path, bytes, sha256) of artifact rows with a binary `content`."""
    return artifacts.select("package_id", "path", F.octet_length("content").cast("bigint").alias("bytes"), digest(F.col("content")).alias("sha256"))


def package_checksums(manifest: DataFrame) -> DataFrame:
    return manifest.select("package_id", "path", F.concat("sha256", F.lit("  "), "path").alias("line"))


def write_evidence(artifacts: DataFrame, path: str, partitions: list[str]) -> DataFrame:
    """Write the artifacts, then return the manifest of what is on disk (path order within a package).

    Rows are spread over tasks by package and path, so that one large package does not become one file.
    """
    spark = artifacts.sparkSession
    artifacts.repartition(*[F.col(c) for c in ("package_id", "path")]).write.mode("overwrite").partitionBy(*partitions).parquet(f"{path}/artifacts")
    written = spark.read.schema(artifacts.schema).parquet(f"{path}/artifacts")
    manifest = package_manifest(written)
    manifest.write.mode("overwrite").parquet(f"{path}/manifest")
    return spark.read.schema(manifest.schema).parquet(f"{path}/manifest")
