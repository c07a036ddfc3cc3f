"""Queries over records with contracts and over the artifact graph of packages, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagefacts import fixed
from pagefacts.operators import contracts, packages
from pagefacts.plans import derive
from pagefacts.plans.session_queries import OBSERVED

# --- contracts -----------------------------------------------------------------------------------

_COUNT = {"type": "integer", "minimum": 0, "maximum": 1000}
CONTRACTS = {
    "envelope": {
        "type": "object", "required": ["schema_id", "version", "captured_at", "producer", "data"], "properties": {
            "schema_id": {"type": "string", "minLength": 3, "pattern": "^[a-z-]+$"}, "version": {"const": "1.4.0"}, "captured_at": {"type": "string", "format": "date-time"},
            "producer": {"type": "object", "additionalProperties": False, "required": ["name"], "properties": {
                "name": {"type": "string", "maxLength": 12}, "build": {"type": ["integer", "null"], "minimum": 1}}}}},
    "session": {"allOf": [{"$ref": "envelope"}], "properties": {"data": {
        "type": "object", "additionalProperties": False, "required": ["session_id", "status", "observations"], "properties": {
            "session_id": {"type": "string", "format": "uuid"}, "status": {"enum": ["READY", "PARTIAL"]},
            "observations": {"type": "array", "maxItems": 3, "uniqueItems": True, "items": {
                "type": "object", "required": ["index"], "properties": {"index": {"type": "integer", "minimum": 0}}}}}}}},
    "diagnostic": {"allOf": [{"$ref": "envelope"}], "properties": {"data": {
        "type": "object", "required": ["code", "severity"], "properties": {
            "code": {"type": "string", "pattern": "^[A-Z][A-Z_]*$"}, "severity": {"enum": ["INFO", "WARNING", "ERROR"]},
            "context": {"type": "object", "additionalProperties": {"type": ["string", "number", "boolean", "null"]}}}}}},
    "coverage": {"allOf": [{"$ref": "envelope"}], "properties": {"data": {
        "type": "object", "required": ["counts"], "properties": {
            "counts": {"type": "object", "required": ["found", "kept"], "properties": {"found": _COUNT, "kept": _COUNT}},
            "target": {"anyOf": [{"type": "null"}, {"type": "object", "required": ["width"], "properties": {"width": {"type": "integer"}}}]}}}}},
}
# Records with faults planted by k; the kind of a record follows from the event.
_DATA = """CASE event_id % 3
  WHEN 0 THEN CASE k % 13 WHEN 0 THEN '{"session_id":"no","status":"OTHER","observations":[]}'
    WHEN 1 THEN '{"session_id":"123e4567-e89b-12d3-a456-426614174000","status":"READY","observations":[{"index":0},{"index":0},{"index":-1},{}]}'
    WHEN 2 THEN '{"status":"READY","observations":{},"more":1}' ELSE '{"session_id":"123e4567-e89b-12d3-a456-426614174000","status":"PARTIAL","observations":[{"index":0},{"index":1}]}' END
  WHEN 1 THEN CASE k % 5 WHEN 0 THEN '{"code":"Bad Code","severity":"FATAL","context":{"a":[],"b":1}}' WHEN 1 THEN '[]'
    ELSE '{"code":"SOME_CODE","severity":"INFO","context":{"a":null,"b":"x","c":2.5,"d":true}}' END
  ELSE CASE k % 4 WHEN 0 THEN '{"counts":{"found":-1,"kept":1001},"target":"x"}' WHEN 1 THEN '{"counts":{"found":1},"target":{"width":1.5}}'
    WHEN 2 THEN '{"counts":{"found":1,"kept":2},"target":{"width":3}}' ELSE '{"counts":{"found":0,"kept":0},"target":null}' END END"""
_RECORD = f"""concat('{{"schema_id":"', CASE WHEN k % 17 = 3 THEN 'X1' ELSE 'record' END, '","version":', CASE WHEN k % 7 = 0 THEN '"1.3.0"' ELSE '"1.4.0"' END,
  ',"captured_at":', CASE k % 10 WHEN 0 THEN '"2026-02-30T12:00:00Z"' WHEN 1 THEN '7' ELSE '"2026-02-28T12:00:00Z"' END,
  CASE k % 11 WHEN 0 THEN ',"producer":{{"name":"much too long a name","build":0}}' WHEN 1 THEN ',"producer":{{"build":1.5,"zz":1}}' WHEN 2 THEN ''
    ELSE ',"producer":{{"name":"collector","build":null}}' END,
  ',"data":', {_DATA}, CASE WHEN k % 29 = 0 THEN '' ELSE '}}' END)"""
_KIND = "CASE WHEN k % 31 = 1 THEN 'nothing' WHEN event_id % 3 = 0 THEN 'session' WHEN event_id % 3 = 1 THEN 'diagnostic' ELSE 'coverage' END"


def schema_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Checking a record costs far more than reading it: a few small files are dealt to all tasks first, while rows are short.
    dealt = derive.observations(spark, sf_dir).select("snapshot_id", "event_id", "k").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = dealt.select("snapshot_id", F.expr(_RECORD).alias("record"), F.expr(_KIND).alias("name"))
    return contracts.schema_issues(rows, "record", F.col("name"), contracts.contract_rules(spark, CONTRACTS), ["snapshot_id"])


# --- the artifact graph --------------------------------------------------------------------------


def _graph(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Sessions as packages, observations as snapshots; references, sets, readiness and contexts with planted faults; and packages that hold nothing."""
    e, u = F.col("event_id"), F.col("user_id")
    path = lambda name: F.concat(F.lit("snapshots/"), name, F.lit(".json"))
    rows = derive.observations(spark, sf_dir).withColumn("package_id", F.col("session_id"))
    there = rows.select("package_id", "snapshot_id", path(F.col("snapshot_id")).alias("path"), "observation_index", "page_fingerprint", "inner_width", "requested_profile", "event_id")
    extra = there.filter("event_id % 61 = 1").withColumns({
        "snapshot_id": F.concat("snapshot_id", F.lit("-x")), "path": path(F.concat("snapshot_id", F.lit("-x"))), "observation_index": F.col("observation_index") + 1000})
    named = rows.select(
        "package_id", F.when(e % 53 == 0, F.concat(F.lit("ghost-"), "snapshot_id")).otherwise(F.col("snapshot_id")).alias("snapshot_id"),
        F.when(e % 43 == 3, "elsewhere.json").otherwise(path(F.col("snapshot_id"))).alias("snapshot_path"),
        (F.col("observation_index") + F.when(e % 59 == 2, 1).otherwise(0)).alias("observation_index"), "event_id")
    heads = derive.sessions(spark, sf_dir).select(F.col("session_id").alias("package_id"), "user_id", "confirmation_state")
    bare = heads.filter("user_id % 23 = 5").withColumn("package_id", F.concat(F.lit("bare-"), "package_id"))
    text = F.concat(F.lit("context-"), u.cast("string"))
    return {
        "packages": heads.unionByName(bare), "snapshots": there.unionByName(extra), "references": named.unionByName(named.filter("event_id % 67 = 4")),
        "sets": heads,
        "readiness": heads.select(
            "package_id", F.when(u % 2 == 0, "READY").otherwise("BLOCKED").alias("state"), (u % 14 != 0).alias("export_allowed"), F.when(u % 10 == 0, 1).otherwise(0).alias("n_blocking")),
        "contexts": heads.select(
            "package_id", F.when(u % 6 != 0, F.sha2(text, 256)).alias("context_sha256"), (u % 8 != 0).alias("has_reference"), "confirmation_state",
            F.sha2(F.when(u % 16 == 6, "other").otherwise(text), 256).alias("imported_sha256")),
        "artifacts": heads.select("package_id", F.lit("session.json").alias("path"), F.expr(_ARTIFACT).alias("text")),
    }


_ARTIFACT = r"""CASE WHEN user_id % 15 = 1 THEN '{"schema_id":"session","n":1}' WHEN user_id % 15 = 2 THEN '{"n":1.0,"schema_id":"session"}' WHEN user_id % 21 = 2 THEN '{"n":1,"schema_id":"other"}'
  ELSE '{"n":1,"schema_id":"session"}' END"""


def _with_newline(artifacts: DataFrame) -> DataFrame:
    return artifacts.withColumn("text", F.concat("text", F.lit("\n")))


def snapshot_graph_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = _graph(spark, sf_dir)
    return packages.snapshot_graph_issues(graph["packages"], graph["snapshots"], graph["references"], graph["sets"])


def readiness_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = _graph(spark, sf_dir)
    return packages.readiness_agreement(graph["packages"], graph["snapshots"], graph["readiness"], graph["contexts"])


def graph_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of a package from its artifacts, their graph and the agreement of readiness."""
    graph = _graph(spark, sf_dir)
    return packages.package_verdicts(
        graph["packages"], packages.canonical_issues(_with_newline(graph["artifacts"]), ["session"]),
        packages.snapshot_graph_issues(graph["packages"], graph["snapshots"], graph["references"], graph["sets"]),
        packages.readiness_agreement(graph["packages"], graph["snapshots"], graph["readiness"], graph["contexts"]))


QUERIES = {f.__name__: f for f in (schema_issues, snapshot_graph_issues, readiness_agreement, graph_verdicts)}

# --- oracle SQL ----------------------------------------------------------------------------------

_SESSION, _DIAGNOSTIC, _COVERAGE = "event_id % 3 = 0", "event_id % 3 = 1", "event_id % 3 = 2"
_EXPECTED = (
    ("$.schema_id", "min_length", "k % 17 = 3"), ("$.schema_id", "pattern", "k % 17 = 3"), ("$.version", "const", "k % 7 = 0"), ("$.captured_at", "date_time", "k % 10 = 0"),
    ("$.captured_at", "type", "k % 10 = 1"), ("$.producer.name", "max_length", "k % 11 = 0"), ("$.producer.build", "minimum", "k % 11 = 0"), ("$.producer.name", "required", "k % 11 = 1"),
    ("$.producer.build", "type", "k % 11 = 1"), ("$.producer.zz", "unexpected", "k % 11 = 1"), ("$.producer", "required", "k % 11 = 2"),
    ("$.data.session_id", "uuid", f"{_SESSION} AND k % 13 = 0"), ("$.data.status", "enum", f"{_SESSION} AND k % 13 = 0"), ("$.data.observations", "max_items", f"{_SESSION} AND k % 13 = 1"),
    ("$.data.observations[1]", "unique_items", f"{_SESSION} AND k % 13 = 1"), ("$.data.observations[2].index", "minimum", f"{_SESSION} AND k % 13 = 1"),
    ("$.data.observations[3].index", "required", f"{_SESSION} AND k % 13 = 1"), ("$.data.session_id", "required", f"{_SESSION} AND k % 13 = 2"),
    ("$.data.observations", "type", f"{_SESSION} AND k % 13 = 2"), ("$.data.more", "unexpected", f"{_SESSION} AND k % 13 = 2"),
    ("$.data.code", "pattern", f"{_DIAGNOSTIC} AND k % 5 = 0"), ("$.data.severity", "enum", f"{_DIAGNOSTIC} AND k % 5 = 0"), ("$.data.context.a", "type", f"{_DIAGNOSTIC} AND k % 5 = 0"),
    ("$.data", "type", f"{_DIAGNOSTIC} AND k % 5 = 1"), ("$.data.counts.found", "minimum", f"{_COVERAGE} AND k % 4 = 0"), ("$.data.counts.kept", "maximum", f"{_COVERAGE} AND k % 4 = 0"),
    ("$.data.target", "any_of", f"{_COVERAGE} AND k % 4 IN (0, 1)"), ("$.data.counts.kept", "required", f"{_COVERAGE} AND k % 4 = 1"))


def _issues(frame: str, items: tuple) -> str:
    return "\nUNION ALL ".join(f"SELECT snapshot_id, '{p}' AS path, '{m}' AS message FROM {frame} WHERE {w}" for p, m, w in items)


_GRAPH = """, sn AS MATERIALIZED (SELECT session_id AS package_id, snapshot_id, 'snapshots/' || snapshot_id || '.json' AS path, observation_index AS ix, page_fingerprint AS fp, inner_width AS w, requested_profile AS pr FROM ob
  UNION ALL SELECT session_id, snapshot_id || '-x', 'snapshots/' || snapshot_id || '-x.json', observation_index + 1000, page_fingerprint, inner_width, requested_profile FROM ob WHERE event_id % 61 = 1),
pk AS MATERIALIZED (SELECT session_id AS package_id, user_id, true AS has_set, confirmation_state FROM ses UNION ALL SELECT 'bare-' || session_id, user_id, false, NULL FROM ses WHERE user_id % 23 = 5),
rf AS MATERIALIZED (SELECT session_id AS package_id, CASE WHEN event_id % 53 = 0 THEN 'ghost-' ELSE '' END || snapshot_id AS snapshot_id, CASE WHEN event_id % 43 = 3 THEN 'elsewhere.json' ELSE 'snapshots/' || snapshot_id || '.json' END AS path,
  observation_index + CASE WHEN event_id % 59 = 2 THEN 1 ELSE 0 END AS ix, unnest(CASE WHEN event_id % 67 = 4 THEN [1, 2] ELSE [1] END) AS c FROM ob JOIN pk ON session_id = package_id AND has_set),
gi AS MATERIALIZED (SELECT package_id, '' AS path, 'NO_SNAPSHOTS' AS issue FROM pk WHERE package_id NOT IN (SELECT package_id FROM sn)
  UNION ALL SELECT package_id, '', 'DUPLICATE_OBSERVATION_INDEX' FROM sn GROUP BY package_id HAVING count(DISTINCT ix) < count(*)
  UNION ALL SELECT package_id, '', 'NON_CONTIGUOUS_OBSERVATION_INDEX' FROM sn GROUP BY package_id HAVING min(ix) <> 0 OR max(ix) <> count(DISTINCT ix) - 1
  UNION ALL SELECT package_id, '', 'OBSERVATION_SET_MISSING' FROM pk WHERE NOT has_set
  UNION ALL SELECT DISTINCT package_id, path, 'MISSING_SNAPSHOT' FROM (SELECT package_id, snapshot_id, min(path) AS path FROM rf GROUP BY ALL) r WHERE NOT EXISTS (SELECT 1 FROM sn WHERE sn.package_id = r.package_id AND sn.snapshot_id = r.snapshot_id)
  UNION ALL SELECT r.package_id, coalesce(sn.path, r.path), 'REPEATED_REFERENCE' FROM (SELECT package_id, snapshot_id, min(path) AS path FROM rf GROUP BY ALL HAVING count(*) > 1) r LEFT JOIN sn USING (package_id, snapshot_id)
  UNION ALL SELECT DISTINCT sn.package_id, sn.path, 'OBSERVATION_INDEX_DISAGREES' FROM rf JOIN sn USING (package_id, snapshot_id) WHERE rf.ix <> sn.ix
  UNION ALL SELECT DISTINCT sn.package_id, sn.path, 'SNAPSHOT_PATH_DISAGREES' FROM rf JOIN sn USING (package_id, snapshot_id) WHERE rf.path <> sn.path
  UNION ALL SELECT sn.package_id, sn.path, 'ORPHAN_SNAPSHOT' FROM sn JOIN pk USING (package_id) WHERE has_set AND NOT EXISTS (SELECT 1 FROM rf WHERE rf.package_id = sn.package_id AND rf.snapshot_id = sn.snapshot_id)),
rd AS MATERIALIZED (SELECT *, NOT has_set AS absent, has_set AND user_id % 2 = 0 AS ready, user_id % 6 <> 0 AND user_id % 8 <> 0 AS there, coalesce(confirmation_state = 'CONFIRMED', false) AND user_id % 16 <> 6 AS fits
  FROM pk LEFT JOIN (SELECT package_id, count(*) AS n, count(DISTINCT w) AS ws, count(DISTINCT fp) AS fps, count(DISTINCT pr) FILTER (pr IN ('DESKTOP', 'TABLET', 'MOBILE')) AS prs FROM sn GROUP BY ALL) USING (package_id)),
ri AS MATERIALIZED (SELECT package_id, '' AS path, unnest(list_filter([CASE WHEN absent THEN 'READINESS_MISSING' END, CASE WHEN ready AND NOT there THEN 'SOURCE_CONTEXT_REQUIRED' END, CASE WHEN ready AND there AND NOT fits THEN 'SOURCE_CONTEXT_INCOMPATIBLE' END,
  CASE WHEN ready AND coalesce(n, 0) < 3 THEN 'INSUFFICIENT_RUNTIME_OBSERVATIONS' END, CASE WHEN ready AND coalesce(ws, 0) < 3 THEN 'INSUFFICIENT_DISTINCT_VIEWPORTS' END, CASE WHEN ready AND coalesce(prs, 0) < 3 THEN 'REQUIRED_VIEWPORT_PROFILE_MISSING' END,
  CASE WHEN ready AND fps > 1 THEN 'PAGE_FINGERPRINT_MISMATCH' END, CASE WHEN ready AND (user_id % 14 = 0 OR user_id % 10 = 0) THEN 'PYTHON_FEED_NOT_READY' END], lambda x: x IS NOT NULL)) AS issue FROM rd)"""
_ORDER = "[" + ", ".join(f"'{i}'" for i in packages.ISSUE_ORDER) + "]"

ORACLES = {
    "schema_issues": f"WITH {OBSERVED}\n" + _issues("(SELECT * FROM ob WHERE k % 29 <> 0 AND k % 31 <> 1)", _EXPECTED)
    + "\nUNION ALL SELECT snapshot_id, '$', 'malformed' FROM ob WHERE k % 29 = 0 UNION ALL SELECT snapshot_id, '$', 'contract_unknown' FROM ob WHERE k % 31 = 1",
    "snapshot_graph_issues": f"WITH {OBSERVED}{_GRAPH} SELECT package_id, path, issue FROM gi",
    "readiness_agreement": f"WITH {OBSERVED}{_GRAPH} SELECT package_id, path, issue FROM ri",
    "graph_verdicts": f"""WITH {OBSERVED}{_GRAPH}, ar AS (SELECT package_id, 'session.json' AS path, unnest(list_filter([CASE WHEN user_id % 15 IN (1, 2) THEN 'NOT_CANONICAL' END,
  CASE WHEN user_id % 15 NOT IN (1, 2) AND user_id % 21 = 2 THEN 'SCHEMA_NOT_REGISTERED' END], lambda x: x IS NOT NULL)) AS issue FROM pk WHERE has_set),
every AS (SELECT * FROM gi UNION ALL SELECT * FROM ri UNION ALL SELECT * FROM ar), rk AS (SELECT *, list_position({_ORDER}, issue) AS r FROM every)
SELECT package_id, CASE WHEN ni IS NULL THEN 'PASS' ELSE 'FAIL' END AS state, first_issue, first_path, coalesce(ni, 0) AS n_issues FROM pk
LEFT JOIN (SELECT package_id, count(*) AS ni, arg_min(issue, (r, issue, path)) AS first_issue, arg_min(path, (r, issue, path)) AS first_path FROM rk GROUP BY package_id) USING (package_id)""",
}
