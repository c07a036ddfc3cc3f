"""Package archives: one row per entry, with the issue that makes an entry unusable."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagefacts import fixed

#: What a worker holds of entries before it hands them on.
HELD_BYTES = 8_000_000
HELD_ENTRIES = 10_000
ENTRY_SCHEMA = "package_id string, path string, content binary, issue string"


def _unsafe(path: str) -> str | None:
    if not path or path[0] in "/\\" or re.match(r"[A-Za-z]:", path):
        return "PATH_NOT_RELATIVE"
    if "\\" in path or any(part in ("", ".", "..") for part in path.split("/")):
        return "PATH_UNSAFE"
    if any(c < " " or c == "\x7f" for c in path):
        return "PATH_CONTROL_CHARACTER"
    return "PATH_TOO_LONG" if len(path.encode()) > fixed.MAX_PATH_BYTES else None


def _entries(package: str, data: bytes) -> Iterator[tuple]:
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile:
        yield package, "", None, "ARCHIVE_INVALID"
        return
    for info in archive.infolist():
        issue = _unsafe(info.orig_filename)
        content = None
        if info.compress_type != zipfile.ZIP_STORED:
            issue = issue or "ENTRY_COMPRESSED"
        elif info.file_size > fixed.MAX_PACKAGE_ENTRY_BYTES:
            issue = issue or "ENTRY_TOO_LARGE"
        else:
            try:
                content = archive.read(info)
            except zipfile.BadZipFile:
                issue = issue or "ENTRY_CHECKSUM"
        yield package, info.orig_filename, content, issue


def _open(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Entries of many archives at once, as a frame for each costs more than reading it; contents held are bounded in bytes."""
    columns = ["package_id", "path", "content", "issue"]
    for batch in batches:
        held, size = [], 0
        for package, data in zip(batch["package_id"], batch["content"], strict=True):
            for row in _entries(package, data):
                held.append(row)
                size += len(row[2] or b"")
                if size > HELD_BYTES or len(held) >= HELD_ENTRIES:
                    yield pd.DataFrame(held, columns=columns)
                    held, size = [], 0
        if held:
            yield pd.DataFrame(held, columns=columns)


def open_packages(archives: DataFrame) -> DataFrame:
    """Entries of archives given as (package_id, content).  Too large archives are reported, not opened."""
    length = F.octet_length("content")
    small = length.between(1, fixed.MAX_PACKAGE_BYTES)
    opened = archives.filter(small).select("package_id", "content").mapInPandas(_open, ENTRY_SCHEMA)
    refused = archives.filter(~small).select(
        "package_id", F.lit("").alias("path"), F.lit(None).cast("binary").alias("content"), F.lit("ARCHIVE_SIZE").alias("issue"))
    return opened.unionByName(refused)


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """Entries of all archives below `path`."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path)
    return open_packages(files.select(
        F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.zip\z", "").alias("package_id"), "content"))


def package_entry_issues(entries: DataFrame) -> DataFrame:
    """Entry issues, repeated paths and packages with too many entries."""
    own = entries.filter("issue IS NOT NULL").select("package_id", "path", "issue")
    twice = entries.filter("path <> ''").groupBy("package_id", "path").count().filter("count > 1").select("package_id", "path", F.lit("DUPLICATE_PATH").alias("issue"))
    many = entries.groupBy("package_id").count().filter(F.col("count") > fixed.MAX_PACKAGE_ENTRIES).select(
        "package_id", F.lit("").alias("path"), F.lit("TOO_MANY_ENTRIES").alias("issue"))
    return own.unionByName(twice).unionByName(many)
