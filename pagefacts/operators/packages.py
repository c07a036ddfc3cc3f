"""Integrity of exported packages: inventory, checksums, verdicts, version routes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagefacts import fixed
from pagefacts.functions.digests import digest
from pagefacts.functions.patterns import matches
from pagefacts.sources.evidence import CHECKSUMS, MANIFEST

_KEYS = ["package_id", "path"]


def with_digest(files: DataFrame) -> DataFrame:
    """Size and digest of every file, worked out once; the content itself is not carried further."""
    return files.select(*_KEYS, F.octet_length("content").cast("bigint").alias("actual_bytes"), digest(F.col("content")).alias("actual_sha256"))


def path_difference(left: DataFrame, right: DataFrame, keys: list[str] = _KEYS) -> DataFrame:
    """Paths of `right` missing from `left`, and extra ones."""
    sided = left.select(*keys, F.lit(1).alias("_side")).unionByName(right.select(*keys, F.lit(2).alias("_side")))
    found = sided.groupBy(*keys).agg(F.bit_or("_side").alias("_in")).filter(F.col("_in") < 3)
    return found.select(*keys, F.when(F.col("_in") == 2, "MISSING").otherwise("EXTRA").alias("difference"))


def parsed_checksums(checksums: DataFrame) -> DataFrame:
    """Checksum lines as (digest, path); a line that is none has a null path."""
    line = F.col("line")
    ok = matches(line, fixed.CHECKSUM_LINE)
    return checksums.select("package_id", "line_no", F.when(ok, F.regexp_extract(line, fixed.CHECKSUM_LINE, 2)).alias("path"),
                            F.when(ok, F.regexp_extract(line, fixed.CHECKSUM_LINE, 1)).alias("sha256"))


def exact_inventory(files: DataFrame, manifest: DataFrame, checksums: DataFrame) -> DataFrame:
    """Actual paths and checksum paths against what the manifest implies, and repeats in any of the three."""
    packages = manifest.select("package_id").distinct()
    listed = manifest.select(*_KEYS)
    with_manifest = listed.unionByName(packages.withColumn("path", F.lit(MANIFEST)))
    expected = with_manifest.unionByName(packages.withColumn("path", F.lit(CHECKSUMS)))
    lines = parsed_checksums(checksums).filter("path IS NOT NULL").select(*_KEYS)

    def named(frame: DataFrame, label: str) -> DataFrame:
        return frame.select(*_KEYS, F.concat(F.lit(f"{label}_"), "difference").alias("issue"))

    def repeated(frame: DataFrame, label: str) -> DataFrame:
        return frame.groupBy(*_KEYS).count().filter("count > 1").select(*_KEYS, F.lit(f"{label}_DUPLICATE").alias("issue"))

    parts = [
        named(path_difference(files.select(*_KEYS), expected), "FILE"), named(path_difference(lines, with_manifest), "CHECKSUM"),
        repeated(files, "FILE"), repeated(listed, "MANIFEST"), repeated(lines, "CHECKSUM"),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def verify_files(files: DataFrame, manifest: DataFrame, checksums: DataFrame) -> DataFrame:
    """Sizes and digests of listed files, and malformed checksum lines."""
    actual = with_digest(files)
    declared = manifest.select(*_KEYS, "bytes", F.col("sha256").alias("_declared")).join(actual, _KEYS, "left")
    by_manifest = declared.select(*_KEYS, F.explode(F.array_compact(F.array(
        F.when(F.col("actual_bytes").isNull(), "MANIFEST_FILE_MISSING"), F.when(F.col("actual_bytes") != F.col("bytes"), "MANIFEST_SIZE"),
        F.when(F.col("actual_sha256") != F.col("_declared"), "MANIFEST_DIGEST")))).alias("issue"))
    lines = parsed_checksums(checksums)
    by_line = lines.filter("path IS NOT NULL").join(actual, _KEYS, "left").select(*_KEYS, F.explode(F.array_compact(F.array(
        F.when(F.col("actual_sha256").isNull(), "CHECKSUM_FILE_MISSING"), F.when(F.col("actual_sha256") != F.col("sha256"), "CHECKSUM_DIGEST")))).alias("issue"))
    malformed = lines.filter("path IS NULL").select("package_id", F.concat(F.lit("line "), F.col("line_no").cast("string")).alias("path"), F.lit("CHECKSUM_LINE_MALFORMED").alias("issue"))
    return by_manifest.unionByName(by_line).unionByName(malformed)


# Order in which a validator meets the rules; the first issue of a package is the lowest of these.
ISSUE_ORDER = (
    "MANIFEST_DUPLICATE", "FILE_DUPLICATE", "FILE_MISSING", "FILE_EXTRA", "SCHEMA_NOT_REGISTERED", "NOT_CANONICAL", "MANIFEST_FILE_MISSING",
    "MANIFEST_SIZE", "MANIFEST_DIGEST", "CHECKSUM_LINE_MALFORMED", "CHECKSUM_DUPLICATE", "CHECKSUM_MISSING", "CHECKSUM_EXTRA",
    "CHECKSUM_FILE_MISSING", "CHECKSUM_DIGEST", "NO_SNAPSHOTS", "DUPLICATE_OBSERVATION_INDEX", "NON_CONTIGUOUS_OBSERVATION_INDEX", "DUPLICATE_SNAPSHOT",
    "OBSERVATION_SET_MISSING", "MISSING_SNAPSHOT", "REPEATED_REFERENCE", "OBSERVATION_INDEX_DISAGREES", "SNAPSHOT_PATH_DISAGREES", "ORPHAN_SNAPSHOT",
    "READINESS_MISSING", "SOURCE_CONTEXT_REQUIRED", "SOURCE_CONTEXT_INCOMPATIBLE", "INSUFFICIENT_RUNTIME_OBSERVATIONS", "INSUFFICIENT_DISTINCT_VIEWPORTS",
    "REQUIRED_VIEWPORT_PROFILE_MISSING", "PAGE_FINGERPRINT_MISMATCH", "PYTHON_FEED_NOT_READY",
)


def package_verdicts(packages: DataFrame, *issue_tables: DataFrame) -> DataFrame:
    """PASS or FAIL per package with the first issue and the number of issues."""
    every = reduce(lambda a, b: a.unionByName(b), [t.select(*_KEYS, "issue") for t in issue_tables])
    rank = F.array_position(F.array(*[F.lit(i) for i in ISSUE_ORDER]), F.col("issue"))
    worst = every.groupBy("package_id").agg(F.min(F.struct(rank.alias("rank"), "issue", "path")).alias("_first"), F.count("*").alias("_n"))
    out = packages.select("package_id").distinct().join(worst, "package_id", "left")
    return out.select("package_id", F.when(F.col("_first").isNull(), "PASS").otherwise("FAIL").alias("state"),
                      F.col("_first.issue").alias("first_issue"), F.col("_first.path").alias("first_path"), F.coalesce("_n", F.lit(0)).alias("n_issues"))


def canonical_issues(artifacts: DataFrame, registered: list[str]) -> DataFrame:
    """JSON artifacts (package_id, path, text) that are not canonical or declare an unknown schema id."""
    from pagefacts.functions.digests import canonical_json

    parsed = artifacts.withColumn("_c", canonical_json(F.col("text")))
    canonical = F.concat(F.col("_c.text"), F.lit("\n")) == F.col("text")
    schema = F.get_json_object("text", "$.schema_id")
    found = F.array_compact(F.array(
        F.when(~F.coalesce(canonical, F.lit(False)), "NOT_CANONICAL"), F.when(~F.coalesce(schema.isin(*registered), F.lit(False)), "SCHEMA_NOT_REGISTERED")))
    return parsed.select(*_KEYS, F.explode(found).alias("issue"))


def snapshot_graph_issues(packages: DataFrame, snapshots: DataFrame, references: DataFrame, sets: DataFrame) -> DataFrame:
    """`package_id`, `path`, `issue` where the snapshots of a package and the references of its observation set do not agree, in either direction.

    `packages` has package_id; `snapshots` package_id, path, snapshot_id, observation_index; `references` package_id, snapshot_id, snapshot_path,
    observation_index; `sets` the package_id of those with an observation set.  Edges are joined by (package, snapshot), so a package with a third of all
    snapshots is spread.
    """
    key = ["package_id", "snapshot_id"]
    keys = snapshots.groupBy(*key).agg(F.count("*").alias("_copies"), F.min("path").alias("path"), F.min("observation_index").alias("_index"))
    places = snapshots.groupBy("package_id", "observation_index").agg(F.count("*").alias("_n")).groupBy("package_id").agg(
        F.sum("_n").alias("_snapshots"), F.count("*").alias("_distinct"), F.min("observation_index").alias("_low"), F.max("observation_index").alias("_high"))
    whole = packages.select("package_id").distinct().join(places, "package_id", "left").join(
        sets.select("package_id", F.lit(True).alias("_set")).distinct(), "package_id", "left")
    repeats = F.col("_distinct") < F.col("_snapshots")
    gaps = (F.col("_low") != 0) | (F.col("_high") != F.col("_distinct") - 1)
    of_package = whole.select("package_id", F.lit("").alias("path"), F.explode(F.array_compact(F.array(
        F.when(F.col("_snapshots").isNull(), "NO_SNAPSHOTS"), F.when(repeats, "DUPLICATE_OBSERVATION_INDEX"), F.when(gaps, "NON_CONTIGUOUS_OBSERVATION_INDEX"),
        F.when(F.col("_set").isNull(), "OBSERVATION_SET_MISSING")))).alias("issue"))
    listed = references.join(sets.select("package_id").distinct(), "package_id", "left_semi")
    edges = listed.groupBy(*key).agg(F.count("*").alias("_times"), F.min("snapshot_path").alias("_path"), F.max("snapshot_path").alias("_other_path"),
                                     F.min("observation_index").alias("_named"), F.max("observation_index").alias("_other_named"))
    there = sets.select("package_id", F.lit(True).alias("_set")).distinct()
    met = keys.join(edges, key, "full").join(there, "package_id", "left")
    known, named = F.col("_copies").isNotNull(), F.col("_times").isNotNull()
    of_edge = met.select("package_id", F.coalesce("path", "_path").alias("path"), F.explode(F.array_compact(F.array(
        F.when(F.col("_copies") > 1, "DUPLICATE_SNAPSHOT"), F.when(~known, "MISSING_SNAPSHOT"), F.when(F.col("_times") > 1, "REPEATED_REFERENCE"),
        F.when(known & ((F.col("_named") != F.col("_index")) | (F.col("_other_named") != F.col("_index"))), "OBSERVATION_INDEX_DISAGREES"),
        F.when(known & ((F.col("_path") != F.col("path")) | (F.col("_other_path") != F.col("path"))), "SNAPSHOT_PATH_DISAGREES"),
        F.when(F.col("_set") & ~named, "ORPHAN_SNAPSHOT")))).alias("issue"))
    return of_package.unionByName(of_edge)


def readiness_agreement(packages: DataFrame, snapshots: DataFrame, readiness: DataFrame, contexts: DataFrame) -> DataFrame:
    """`package_id`, `path`, `issue` where a package says it is ready and its snapshots or its source context do not bear that out.

    `snapshots` adds page_fingerprint, inner_width and requested_profile; `readiness` has package_id, state, export_allowed, n_blocking; `contexts` has
    package_id, context_sha256 (null: no context), and of the reference confirmation_state and imported_sha256, with has_reference.
    """
    facts = snapshots.groupBy("package_id").agg(
        F.count("*").alias("_n"), F.count_distinct("inner_width").alias("_widths"), F.min("page_fingerprint").alias("_one"), F.max("page_fingerprint").alias("_two"),
        *[F.bool_or(F.col("requested_profile") == p).alias(f"_{p}") for p in fixed.REQUIRED_PROFILES])
    rows = packages.select("package_id").distinct().join(readiness, "package_id", "left").join(contexts, "package_id", "left").join(facts, "package_id", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    ready = yes(F.col("state") == "READY")
    there = F.col("context_sha256").isNotNull() & yes(F.col("has_reference"))
    fits = yes(F.col("confirmation_state") == "CONFIRMED") & yes(F.col("imported_sha256") == F.col("context_sha256"))
    profiles = F.lit(True)
    for p in fixed.REQUIRED_PROFILES:
        profiles = profiles & yes(F.col(f"_{p}"))
    return rows.select("package_id", F.lit("").alias("path"), F.explode(F.array_compact(F.array(
        F.when(F.col("state").isNull(), "READINESS_MISSING"), F.when(ready & ~there, "SOURCE_CONTEXT_REQUIRED"),
        F.when(ready & there & ~fits, "SOURCE_CONTEXT_INCOMPATIBLE"), F.when(ready & ~yes(F.col("_n") >= 3), "INSUFFICIENT_RUNTIME_OBSERVATIONS"),
        F.when(ready & ~yes(F.col("_widths") >= 3), "INSUFFICIENT_DISTINCT_VIEWPORTS"), F.when(ready & ~profiles, "REQUIRED_VIEWPORT_PROFILE_MISSING"),
        F.when(ready & yes(F.col("_one") != F.col("_two")), "PAGE_FINGERPRINT_MISMATCH"),
        F.when(ready & ~(yes(F.col("export_allowed")) & yes(F.col("n_blocking") == 0)), "PYTHON_FEED_NOT_READY")))).alias("issue"))


ROUTES = (("runtime_package", "1.4.0", "RUNTIME_1_4"), ("runtime_package", "1.3.0", "RUNTIME_1_3"), ("source_bundle", None, "SOURCE"))
ADDED_IN_1_4 = ("incomplete_image_count_total", "capture_state", "capture_environment", "document_instances", "source_runtime_cardinality")


def route_by_version(packages: DataFrame) -> DataFrame:
    """Reader route from family and version.  What an older version did not have stays null."""
    family, version = F.col("family"), F.col("schema_version")
    route: Column | None = None
    for name, number, target in ROUTES:
        hit = (family == name) if number is None else (family == name) & (version == number)
        route = F.when(hit, target) if route is None else route.when(hit, target)
    number = F.transform(F.split(version, r"\."), lambda p: p.try_cast("int"))
    older = (family == "runtime_package") & (number < F.array(F.lit(1), F.lit(3), F.lit(0)))
    out = packages.withColumn("route", route.when(older, "RUNTIME_LEGACY").otherwise("UNSUPPORTED"))
    present = [c for c in ADDED_IN_1_4 if c in packages.columns]
    return out.withColumns({c: F.when(F.col("route") == "RUNTIME_1_4", F.col(c)) for c in present})
