"""Queries over derived observations and sessions, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagefacts import fixed
from pagefacts.functions import digests
from pagefacts.functions.redaction import safe_context
from pagefacts.operators import binding, conformance, coverage, nodes, sessions
from pagefacts.plans import derive, rules
from pagefacts.plans.page_queries import joined

MODULES = {"relationships": "include_relationships", "interaction": "include_interaction", "text": "include_text"}


def _stamp(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def _capture_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = derive.capture_rows(spark, sf_dir).groupBy("session_id").agg(F.count("*").alias("capture_count"))
    return derive.sessions(spark, sf_dir).join(counts, "session_id", "left").withColumn("capture_count", F.coalesce("capture_count", F.lit(0)))


def admin_bar_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.admin_bar_state(derive.observations(spark, sf_dir)).select("snapshot_id", "admin_bar_state")


def environment_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derive.observations(spark, sf_dir).withColumns({"dialogs": F.col("k") % 12 == 0, "aria_modals": F.col("k") % 18 == 1})
    rows = rows.withColumns({"dialogs": F.col("dialogs").cast("int"), "aria_modals": F.col("aria_modals").cast("int")})
    return sessions.environment_warnings(rows).select("snapshot_id", joined("warning_codes").alias("warning_codes"))


def modal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order nodes of the tree stand in for dialogs."""
    rows, order = derive.measured_tree(spark, sf_dir), F.col("depth") == 3
    mapped = rows.withColumn("attrs", F.map_filter(F.create_map(
        F.lit("open"), F.when(order & (F.col("orderkey") % 5 == 0), ""), F.lit("aria-modal"), F.when(order & (F.col("orderkey") % 7 == 0), "true"),
        F.lit("role"), F.when(order & (F.col("orderkey") % 4 == 0), "dialog")), lambda _, v: v.isNotNull())).withColumn(
        "tag", F.when(order, "dialog").otherwise("div"))
    visible = ~F.coalesce(F.col("styles")["display"] == "none", F.lit(False))
    return sessions.modal_counts(mapped, visible)


def client_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.client_mix(derive.observations(spark, sf_dir))


def gate_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = derive.observations(spark, sf_dir).select("snapshot_id", *MODULES.values())
    rows = derive.observed_elements(spark, sf_dir).join(flags, "snapshot_id")
    out = nodes.gate_modules(rows, {module: F.col(flag) for module, flag in MODULES.items()})
    return out.select("snapshot_id", "i", *[f"{m}_availability" for m in MODULES])


def export_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _capture_counted(spark, sf_dir).withColumn("blocking_count", F.when(F.col("status").isin("FAILED", "CAPTURING"), 1).otherwise(0))
    strict = sessions.export_policy(rows, F.lit(fixed.STRICT_MODE))
    return strict.select("session_id", "effective_mode", "allowed", "fallback")


def deterministic_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derive.observations(spark, sf_dir)
    text = F.concat("session_id", F.lit(":"), F.col("observation_index").cast("string"))
    return rows.select("session_id", "snapshot_id", digests.uuid_of("pagefacts.snapshot", text).alias("uuid"),
                       digests.node_id(F.col("event_id")).alias("node_id"))


def artifact_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known shape: the canonical text is Spark's own JSON; rows grouped by equal digest."""
    text = digests.canonical_struct({c: F.col(c) for c in ("requested_profile", "page_binding_state", "prerendering", "incomplete_total", "reference_text", "reasons")})
    rows = derive.observations(spark, sf_dir).withColumn("cj1", text)
    return rows.groupBy(digests.digest(F.col("cj1")).alias("digest")).agg(F.count("*").alias("n"), F.min("cj1").alias("cj1"))


def semantic_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free-form JSON through the Arrow path, operational facts left out."""
    raw = F.to_json(F.struct("status", "requested_profile", "snapshot_id", "captured_at", F.col("value").alias("value"), F.struct("k", "session_id").alias("detail")))
    rows = derive.observations(spark, sf_dir).select(digests.semantic_json(raw).alias("s"))
    return rows.groupBy("s.text").agg(F.count("*").alias("n"))


def observation_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = coverage.observation_set(derive.observations(spark, sf_dir), derive.screenshots(spark, sf_dir))
    return out.select("session_id", "snapshot_id", "observation_index", "inner_width", "snapshot_path", F.coalesce("screenshot_path", F.lit("-")).alias("screenshot_path"),
                      "artifact_type", "schema_version", "canonicalization_profile")


def adopt_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _capture_counted(spark, sf_dir).withColumn("binding_state", F.lit("EXACT"))
    rows = rows.withColumn("status", F.when(F.col("session_id").startswith("empty"), "CREATED").otherwise(F.col("status")))
    offer = rows.select("session_id", digests.digest(F.concat(F.lit("new-"), "session_id")).alias("reference_digest"), "selected_document_id", "confirmation_state")
    return sessions.adopt_context(rows, offer).select("session_id", "adopted", "reference_digest", "binding_state")


def redact_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = derive.diagnostics(spark, sf_dir).withColumn("context", safe_context(F.col("context")))
    return out.select("snapshot_id", joined(F.array_sort(F.map_keys("context"))).alias("context_keys"), F.coalesce(F.col("context")["page_url"], F.lit("-")).alias("page_url"),
                      F.coalesce(F.length(F.col("context")["detail"]), F.lit(0)).alias("detail_length"))


def index_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.index_check(derive.observations(spark, sf_dir))


def observation_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.observation_order(derive.observations(spark, sf_dir)).select("session_id", "snapshot_id", "position")


def latest_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.latest_capture(derive.capture_rows(spark, sf_dir)).withColumn("captured_at", _stamp("captured_at"))


def session_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = derive.sessions(spark, sf_dir).withColumn("status", F.when(F.col("user_id") % 8 == 3, F.lit(None)).otherwise(F.col("status")))
    return sessions.session_listing(broken, derive.capture_rows(spark, sf_dir)).withColumn("created_at", _stamp("created_at"))


def corrupt_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = derive.sessions(spark, sf_dir).withColumn("status", F.when(F.col("user_id") % 8 == 3, F.lit(None)).otherwise(F.col("status")))
    return sessions.corrupt_sessions(broken)


def upgrade_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks as three stored versions: full, without length, without a usable hash."""
    rows = derive.table(spark, sf_dir, "documents").select(
        "doc_id", F.col("text").alias("data"), F.expr(_STORED_HASH).alias("sha256"),
        F.when(F.col("doc_id") % 3 != 0, F.octet_length("text")).alias("byte_length"))
    rows = rows.withColumn("sha256", F.when(F.col("sha256") == "true", F.sha2("data", 256)).otherwise(F.col("sha256")))
    return sessions.upgrade_legacy(rows, "chunks").select("doc_id", "sha256", "byte_length", "integrity_status")


def upgrade_legacy_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derive.sessions(spark, sf_dir).withColumn("schema_version", F.when(F.col("user_id") % 3 == 0, "1.0.0").otherwise("1.1.0"))
    return sessions.upgrade_legacy(rows, "sessions").select("session_id", "schema_version", "workflow_mode")


def upgrade_legacy_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derive.jobs(spark, sf_dir).select(
        "job_id", F.when(F.col("doc_id") % 3 == 0, fixed.STRICT_MODE).alias("workflow_mode"), F.when(F.col("doc_id") % 2 == 0, F.col("updated_at")).alias("captured_at"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("created_at"))
    out = sessions.upgrade_legacy(rows, "jobs")
    return out.select("job_id", "workflow_mode", _stamp("captured_at").alias("captured_at"))


_STORED_HASH = "CASE WHEN doc_id % 4 = 1 THEN NULL WHEN doc_id % 4 = 2 THEN 'ABC' ELSE 'true' END"


def observation_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.observation_integrity(derive.observations(spark, sf_dir), derive.capture_rows(spark, sf_dir))


def screenshot_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.screenshot_match(derive.observations(spark, sf_dir), derive.screenshots(spark, sf_dir))


def reference_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.reference_match(derive.observations(spark, sf_dir), derive.sessions(spark, sf_dir)).select("session_id", "snapshot_id", "consistent")


def missing_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sessions.missing_profiles(derive.observations(spark, sf_dir))
    return out.select("session_id", joined("present").alias("present"), joined("missing").alias("missing"))


def capture_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = derive.observations(spark, sf_dir).select(
        "snapshot_id", F.expr("CASE k % 3 WHEN 0 THEN 750 WHEN 1 THEN 1000 ELSE 500 END").alias("max_elements"),
        F.expr("CASE k % 4 WHEN 0 THEN 24 ELSE 40 END").alias("max_depth"))
    return sessions.capture_profile(config)


def admission_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = sessions.context_match(derive.sessions(spark, sf_dir), derive.imported_contexts(spark, sf_dir))
    out = sessions.admission_audit(derive.observations(spark, sf_dir), known)
    return out.select("session_id", "snapshot_id", joined("codes").alias("codes"), "allowed")


def readiness_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sessions.readiness_verdict(derive.readiness_samples(spark, sf_dir), 1500, 1000)
    return out.select("capture_id", "process_state", "availability", "sample_count", F.coalesce("final_document_width", F.lit(-1.0)).alias("final_document_width"))


def image_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = derive.observations(spark, sf_dir).select(
        "session_id", (F.col("k") % 3 != 0).alias("complete"), (F.col("k") % 5).alias("natural_width"),
        (F.col("k") % 4 == 1).alias("decode_failed"), (F.col("k") % 2 == 0).alias("timed_out"))
    return sessions.image_readiness(images)


def merge_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sessions.merge_sessions(derive.sessions(spark, sf_dir), derive.capture_rows(spark, sf_dir), derive.observations(spark, sf_dir))
    return out.withColumn("last_captured_at", _stamp("last_captured_at"))


def capture_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sessions.capture_summaries(derive.observations(spark, sf_dir), derive.observed_elements(spark, sf_dir), derive.screenshots(spark, sf_dir), derive.diagnostics(spark, sf_dir))
    return out.withColumns({"captured_at": _stamp("captured_at"), "reasons": joined("reasons")})


def semantic_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.semantic_completeness(derive.diagnostics(spark, sf_dir)).withColumn("reasons", joined("reasons"))


def feed_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sessions.feed_readiness(derive.sessions(spark, sf_dir), derive.observations(spark, sf_dir), derive.imported_contexts(spark, sf_dir))
    return out.withColumns({c: joined(c) for c in ("blocking_codes", "profiles", "missing_profiles")})


def feed_offenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.feed_offenders(derive.observations(spark, sf_dir))


def _snapshot_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.observations(spark, sf_dir).select("session_id", "snapshot_id", (F.col("k") * 40_000).cast("bigint").alias("n_bytes"))


def resource_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.resource_usage(_snapshot_bytes(spark, sf_dir), derive.screenshots(spark, sf_dir))


def export_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sessions.export_preflight(
        derive.sessions(spark, sf_dir), derive.observations(spark, sf_dir), derive.screenshots(spark, sf_dir),
        derive.imported_contexts(spark, sf_dir), resource_usage(spark, sf_dir), fixed.STRICT_MODE)
    return out.withColumns({"blockers": joined("blockers"), "warnings": joined("warnings")})


def runtime_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.runtime_coverage(*[f(spark, sf_dir) for f in (derive.observations, derive.observed_elements, derive.screenshots, derive.diagnostics)])


def module_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.module_availability(derive.observed_elements(spark, sf_dir), derive.observations(spark, sf_dir), MODULES)


def binding_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.binding_coverage(derive.observed_elements(spark, sf_dir), derive.observations(spark, sf_dir), derive.sessions(spark, sf_dir))


def evidence_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.evidence_coverage(derive.observed_elements(spark, sf_dir), derive.observations(spark, sf_dir), derive.screenshots(spark, sf_dir))


def coverage_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.coverage_diagnostics(derive.observations(spark, sf_dir), derive.observed_elements(spark, sf_dir), derive.screenshots(spark, sf_dir))


def diagnostic_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.diagnostic_set(derive.diagnostics(spark, sf_dir), ["session_id"]).select("session_id", F.sha2("cj1", 256).alias("digest"))


def merge_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derive.diagnostics(spark, sf_dir)
    out = coverage.merge_diagnostics(["session_id"], rows.filter("k < 60"), rows.filter("k > 30"))
    return out.groupBy("session_id", "code").agg(F.count("*").alias("n"))


def page_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.page_diagnostics(derive.observed_elements(spark, sf_dir), ["session_id"])


def budget_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.budget_totals(derive.observations(spark, sf_dir))


def evidence_binding_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = derive.observations(spark, sf_dir).select(
        "snapshot_id", (F.col("k") % 2 == 0).alias("origin_matches"), (F.col("k") % 3 == 0).alias("document_matches"),
        (F.col("k") % 5).alias("ids_overlap"), (F.col("k") % 7 == 0).alias("conflicting"))
    return binding.evidence_binding_state(evidence).select("snapshot_id", "binding_state")


def _faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    return derive.observations(spark, sf_dir).withColumns({
        "status": F.when(k % 20 == 3, "BROKEN").otherwise(F.col("status")), "page_fingerprint": F.when(k % 25 == 4, "sha256:x").otherwise(F.col("page_fingerprint")),
        "inner_width": F.when(k % 30 == 5, F.lit(float("inf"))).otherwise(F.col("inner_width")),
        "elements_emitted": F.when(k % 35 == 6, 1001).otherwise(F.col("elements_emitted")),
        "observation_index": F.when(k % 40 == 7, -1).otherwise(F.col("observation_index")), "process_state": F.when(k % 45 == 8, F.lit(None)).otherwise(F.col("process_state")),
        "snapshot_id": F.when(k % 50 == 9, F.concat(F.lit("snap-"), F.col("event_id").cast("string"))).otherwise(F.col("snapshot_id"))})


def snapshot_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conformance.snapshot_issues(_faulty(spark, sf_dir))


def element_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of observations with planted faults: gaps in order, repeated ids and references, wrong totals."""
    event, i = F.col("event_id"), F.col("i")
    rows = derive.observed_elements(spark, sf_dir).withColumns({
        "document_order": F.when((event % 31 == 1) & (i > 1), i).otherwise(i - 1),
        "node_id": F.when(event % 37 == 2, digests.node_id(F.lit(0))).when(event % 41 == 3, F.lit("n1")).otherwise(digests.node_id(i - 1)),
        "reference_sha256": digests.digest(F.when(event % 43 == 4, F.lit("same")).otherwise(i.cast("string"))),
        "unique_in_document": F.lit(True), "area": F.when((event % 47 == 5) & (i == 1), F.lit(float("nan"))).otherwise(F.lit(1.0))})
    declared = derive.observations(spark, sf_dir).select("snapshot_id", (1 + F.col("k") % 5 + F.when(F.col("event_id") % 53 == 6, 1).otherwise(0)).alias("elements_emitted"))
    return conformance.element_issues(rows, ["snapshot_id"], declared)


COVERAGE_CONTRACT = {
    "state": {"type": "string", "enum": list(fixed.BINDING_STATES), "required": True},
    "count": {"type": "integer", "minimum": 0, "maximum": 90, "required": True},
    "label": {"type": ["string", "null"], "pattern": r"^[a-z-]{1,12}$", "max_length": 12},
    "page": {"type": "object", "required": True},
    "page.profile": {"const": "CJ1"},
    "page.draft": {"const": None},
    "codes": {"type": "array", "min_items": 1, "max_items": 3, "unique_items": True},
    "codes[]": {"type": "string", "pattern": r"^[A-Z]+$"},
}
# One text rule for both sides; faults are planted by k.
_RECORD = """concat('{"state":', CASE WHEN k % 11 = 0 THEN '"OTHER"' WHEN k % 11 = 1 THEN '7' ELSE concat('"', page_binding_state, '"') END,
  CASE WHEN k % 13 = 0 THEN '' WHEN k % 13 = 1 THEN ',"count":1.5' ELSE concat(',"count":', CAST(k AS VARCHAR(20))) END,
  ',"label":', CASE WHEN k % 7 = 0 THEN 'null' WHEN k % 7 = 1 THEN '"BAD"' ELSE '"fine"' END,
  CASE WHEN k % 17 = 2 THEN '' ELSE concat(',"page":{"profile":', CASE WHEN k % 19 = 0 THEN '"X"' WHEN k % 19 = 1 THEN 'null' ELSE '"CJ1"' END, CASE WHEN k % 9 = 0 THEN ',"draft":1' WHEN k % 9 = 1 THEN ',"draft":null' ELSE '' END, CASE WHEN k % 31 = 0 THEN ',"zz":1' ELSE '' END, '}') END,
  ',"codes":', CASE k % 8 WHEN 0 THEN '[]' WHEN 1 THEN '["A","B","C","D"]' WHEN 2 THEN '["A","A"]' WHEN 3 THEN '["A",1]' WHEN 4 THEN '["a"]' WHEN 5 THEN '{}' ELSE '["A","B"]' END,
  CASE WHEN k % 23 = 0 THEN ',"extra":1' ELSE '' END, CASE WHEN k % 29 = 0 THEN '' ELSE '}' END)"""


def contract_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derive.observations(spark, sf_dir).withColumn("record", F.expr(_RECORD))
    return conformance.contract_issues(rows, "record", COVERAGE_CONTRACT, ["snapshot_id"])


def exportable(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, captures = derive.observations(spark, sf_dir), derive.capture_rows(spark, sf_dir)
    return conformance.exportable(derive.sessions(spark, sf_dir), rows, sessions.observation_integrity(rows, captures), sessions.index_check(rows), fixed.STRICT_MODE)


def job_snapshot_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derive.observations(spark, sf_dir)
    k = F.col("k")
    jobs = rows.select(
        F.concat(F.lit("job-"), "snapshot_id").alias("job_id"), F.when(k % 21 == 1, "other").otherwise(F.col("session_id")).alias("session_id"),
        F.when(k % 22 == 2, F.concat("snapshot_id", F.lit("x"))).otherwise(F.col("snapshot_id")).alias("snapshot_id"),
        F.when(k % 23 == 3, F.timestamp_add("SECOND", F.lit(1), "captured_at")).otherwise(F.col("captured_at")).alias("captured_at"),
        F.when(k % 24 == 4, 50).otherwise(750).alias("max_elements"),
        F.when(F.col("user_id") % 3 == 0, fixed.STRICT_MODE).otherwise(fixed.PLAIN_MODE).alias("workflow_mode"),
        F.when(k % 26 == 6, "sha256:old").otherwise(F.col("page_fingerprint")).alias("expected_fingerprint"),
        F.when(k % 27 == 7, 1.0).otherwise(F.col("inner_width")).alias("expected_width"))
    return conformance.job_snapshot_issues(jobs, rows)


def diagnostic_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conformance.diagnostic_issues(derive.diagnostics(spark, sf_dir), ["snapshot_id"])


def read_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations written as nested JSON (some lines cut off), read back and counted per session."""
    from pagefacts.plans.stored import stored_text
    from pagefacts.sources.snapshots import read_snapshots as read

    path = stored_text(spark, sf_dir, "snapshots", _snapshot_lines)
    good, elements, corrupt = read(spark, path)
    counted = good.groupBy("session_id").agg(F.count("*").alias("n_snapshots"))
    nested = elements.groupBy("session_id").agg(F.count("*").alias("n_elements"), F.count_if("overflowing").alias("n_overflowing"))
    lost = corrupt.groupBy().agg(F.lit("-").alias("session_id"), F.count("*").alias("n_snapshots"))
    every = counted.join(nested, "session_id", "left").unionByName(lost, allowMissingColumns=True)
    return every.fillna(0, ["n_elements", "n_overflowing"])


def _snapshot_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.struct(digests.node_id(F.col("i") - 1).alias("node_id"), (F.col("i") - 1).alias("document_order"), "binding_state", "overflowing")
    elements = derive.observed_elements(spark, sf_dir).groupBy("snapshot_id").agg(F.array_sort(F.collect_list(item)).alias("elements"))  # at most five per snapshot
    rows = derive.observations(spark, sf_dir).join(elements, "snapshot_id")
    text = F.to_json(F.struct("session_id", "snapshot_id", "observation_index", F.col("captured_at").cast("string").alias("captured_at"), "status", "requested_profile",
                              "inner_width", "inner_height", "process_state", "page_fingerprint", "elements"))
    return rows.select(F.when(F.col("event_id") % 71 == 0, F.substring(text, 1, 40)).otherwise(text).alias("value"))


QUERIES = {f.__name__: f for f in (
    admin_bar_state, environment_warnings, modal_counts, client_mix, gate_modules, export_policy, deterministic_ids, artifact_digests,
    semantic_digests, observation_set, adopt_context, redact_context, index_check, observation_order, latest_capture, session_listing, corrupt_sessions,
    upgrade_legacy, upgrade_legacy_sessions, upgrade_legacy_jobs, observation_integrity, screenshot_match, reference_match, missing_profiles, capture_profile, admission_audit,
    readiness_verdict, image_readiness, merge_sessions, capture_summaries, semantic_completeness, feed_readiness, feed_offenders,
    resource_usage, export_preflight, runtime_coverage, module_availability, binding_coverage, evidence_coverage, coverage_diagnostics,
    diagnostic_set, merge_diagnostics, page_diagnostics, budget_totals, evidence_binding_state, snapshot_issues, element_issues,
    contract_issues, exportable, job_snapshot_issues, diagnostic_issues, read_snapshots)}

# --- oracle SQL ----------------------------------------------------------------------------------


def _cols(columns: dict[str, str]) -> str:
    return ", ".join(f"({text}) AS {name}" for name, text in columns.items())


_PROFILE = rules.OBSERVATION_COLUMNS["requested_profile"]
OBSERVED = f"""
ev AS (SELECT event_id, ts, user_id, event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events),
full_rows AS (SELECT *, 'user' AS kind, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS pure_index FROM ev),
guided_rows AS (SELECT event_id, ts, user_id, event_type, value, k, 'guided' AS kind, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS pure_index
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id, {_PROFILE} ORDER BY ts, event_id) AS rn FROM ev) WHERE rn = 1),
rows_all AS (SELECT *, CASE WHEN user_id % 17 = 0 AND pure_index >= 3 THEN pure_index + 1 WHEN user_id % 19 = 0 AND pure_index = 2 THEN 1 ELSE pure_index END AS observation_index FROM full_rows
  UNION ALL SELECT *, pure_index FROM guided_rows),
ob AS MATERIALIZED (SELECT *, ts AS captured_at, 'sha256:' || sha256(fingerprint_text) AS page_fingerprint, 'sha256:' || sha256(reference_text) AS reference_digest,
  CASE WHEN admin_visible THEN 'PRESENT' WHEN body_admin_class OR admin_element THEN 'AMBIGUOUS' ELSE 'ABSENT' END AS admin_bar_state,
  img_broken + img_pending + img_failed + img_timed_out AS unresolved, abs(scroll_x) > 1 OR abs(scroll_y) > 1 AS off_scroll
  FROM (SELECT *, {_cols(rules.OBSERVATION_COLUMNS)} FROM rows_all)),
sess0 AS (SELECT kind, user_id, min(ts) AS created_at FROM rows_all GROUP BY ALL UNION ALL SELECT 'empty', user_id, min(ts) FROM rows_all WHERE kind = 'user' AND user_id % 10 = 2 GROUP BY ALL),
ses AS MATERIALIZED (SELECT *, 'sha256:' || sha256(reference_text) AS reference_digest FROM (SELECT *, {_cols(rules.SESSION_COLUMNS)} FROM sess0)),
cap AS MATERIALIZED (SELECT session_id, snapshot_id, captured_at, completeness AS status FROM ob WHERE event_id % 23 <> 0
  UNION ALL SELECT session_id, 'missing-' || event_id, captured_at, completeness FROM ob WHERE event_id % 29 = 0
  UNION ALL SELECT session_id, snapshot_id, captured_at, completeness FROM ob WHERE event_id % 101 = 5),
shot AS MATERIALIZED (SELECT session_id, snapshot_id, CAST(1000 + k * 100 AS BIGINT) AS n_bytes FROM ob WHERE k % 3 = 0 AND event_id % 5 <> 0
  UNION ALL SELECT session_id, snapshot_id, CAST(1000 + k * 100 AS BIGINT) FROM ob WHERE k % 3 = 0 AND event_id % 41 = 0
  UNION ALL SELECT session_id, 'foreign-' || event_id, CAST(1000 + k * 100 AS BIGINT) FROM ob WHERE event_id % 37 = 0),
oe AS MATERIALIZED (SELECT *, {_cols(rules.ELEMENT_COLUMNS)} FROM (SELECT session_id, snapshot_id, event_id, k, unnest(generate_series(1, 1 + k % 5)) AS i FROM ob)),
dg AS MATERIALIZED (SELECT session_id, snapshot_id, event_id, event_type, k, {_cols(rules.DIAGNOSTIC_COLUMNS)} FROM ob),
known AS (SELECT DISTINCT user_id % 10 AS n FROM rows_all WHERE user_id % 10 <> 9)"""


def _observed(body: str, clauses: str = "") -> str:
    return f"WITH {OBSERVED}{clauses}\n{body}"


def _list(*items: str) -> str:
    return f"array_to_string(list_sort(list_distinct(list_filter([{', '.join(items)}], lambda c: c IS NOT NULL))), ',')"


def _when(condition: str, code: str) -> str:
    return f"CASE WHEN {condition} THEN '{code}' END"


_ENV = (("off_scroll", "PAGE_NOT_AT_CANONICAL_SCROLL"), ("visibility_state <> 'visible'", "PAGE_NOT_VISIBLE"), ("prerendering", "PAGE_PRERENDERING"),
        ("admin_bar_state <> 'ABSENT'", "WORDPRESS_ADMIN_BAR_PRESENT_OR_AMBIGUOUS"), ("editor_preview", "ELEMENTOR_EDITOR_PREVIEW_NOT_CANONICAL"),
        ("iframe", "IFRAME_CAPTURE_NOT_CANONICAL"), ("unresolved > 0", "VIEWPORT_IMAGES_NOT_READY"))
_SHORT = ("scroll", "hidden", "prerendering", "admin_bar", "preview", "iframe", "images")
_FEED = f"""
, agg AS (SELECT o.session_id, count(*) AS n, count(DISTINCT observation_index) AS d, min(observation_index) AS lo, max(observation_index) AS hi, count(DISTINCT inner_width) AS widths,
  array_to_string(list_sort(list_distinct(list(requested_profile))), ',') AS profiles, count(DISTINCT requested_profile) FILTER (requested_profile <> 'CUSTOM') AS req,
  bool_or(requested_profile = 'DESKTOP') AS pd, bool_or(requested_profile = 'TABLET') AS pt, bool_or(requested_profile = 'MOBILE') AS pmob,
  count(DISTINCT page_fingerprint) AS fps, bool_and(o.reference_digest IS NOT DISTINCT FROM s.reference_digest) AS same_ref, bool_or(process_state = 'ERROR') AS err,
  {', '.join(f"count_if({c}) AS n_{s}" for (c, _), s in zip(_ENV, _SHORT, strict=True))} FROM ob o JOIN ses s ON s.session_id = o.session_id GROUP BY o.session_id),
fj AS (SELECT ses.*, agg.* EXCLUDE (session_id), user_id % 10 <> 9 AND user_id % 9 <> 0 AS known_ctx, coalesce(user_id % 9 <> 0 AND user_id % 13 <> 0 AND user_id % 11 <> 0 AND user_id % 10 <> 9, false) AS ctx_ok,
  coalesce(confirmation_state = 'CONFIRMED', false) AND selected_document_id IS NOT NULL AS confirmed FROM ses LEFT JOIN agg USING (session_id)),
fc AS MATERIALIZED (SELECT *, {_list(_when("NOT known_ctx", "SOURCE_CONTEXT_REQUIRED"), _when("known_ctx AND (NOT confirmed OR NOT ctx_ok)", "SOURCE_CONTEXT_INCOMPATIBLE"),
    _when("n > 0 AND (d <> n OR lo <> 0 OR hi <> n - 1)", "OBSERVATION_INDEX_INVALID"), _when("coalesce(n, 0) < 3", "INSUFFICIENT_RUNTIME_OBSERVATIONS"),
    _when("coalesce(widths, 0) < 3", "INSUFFICIENT_DISTINCT_VIEWPORTS"), _when("coalesce(req, 0) < 3", "REQUIRED_VIEWPORT_PROFILE_MISSING"), _when("fps > 1", "PAGE_FINGERPRINT_MISMATCH"),
    _when("NOT same_ref", "SOURCE_CONTEXT_REFERENCE_MISMATCH"), _when("err", "READINESS_ERROR"), *[_when(f"n_{s} > 0", c) for (_, c), s in zip(_ENV, _SHORT, strict=True)])} AS blocking_codes FROM fj),
fr AS MATERIALIZED (SELECT *, CASE WHEN blocking_codes = '' THEN 'READY' WHEN regexp_matches(blocking_codes, '(OBSERVATION_INDEX_INVALID|PAGE_FINGERPRINT_MISMATCH|SOURCE_CONTEXT_REFERENCE_MISMATCH|SOURCE_CONTEXT_INCOMPATIBLE)') THEN 'INVALID' ELSE 'INSUFFICIENT_EVIDENCE' END AS state FROM fc)"""
_USAGE = """
, us AS (SELECT o.session_id, CAST(sum(CAST(k AS BIGINT) * 40000) AS BIGINT) AS snapshot_bytes, CAST(coalesce(sum(b), 0) AS BIGINT) AS screenshot_bytes, count(*) AS capture_count FROM ob o
  LEFT JOIN (SELECT session_id, snapshot_id, max(n_bytes) AS b FROM shot GROUP BY ALL) s USING (session_id, snapshot_id) GROUP BY o.session_id)"""
_STATES = ("EXACT", "PROBABLE", "AMBIGUOUS", "UNMATCHED")
_SHOTS = ", sc AS (SELECT session_id, count(*) AS screenshots FROM shot WHERE EXISTS (SELECT 1 FROM ob WHERE ob.session_id = shot.session_id AND ob.snapshot_id = shot.snapshot_id) GROUP BY ALL)"
_CONTEXT_JSON = """'{' || array_to_string(list_filter(['"Bad Key":"' || c_limit || '"', '"auth_token":"' || c_token || '"', '"detail":"' || c_long || '"', '"limit":"' || c_limit || '"', '"page_url":"' || c_url || '"'], lambda x: x IS NOT NULL), ',') || '}'"""
_DIAGNOSTIC = f"""'{{"code":"' || code || '","context":' || {_CONTEXT_JSON} || CASE WHEN failure_boundary IS NULL THEN '' ELSE ',"failure_boundary":"' || failure_boundary || '"' END
  || ',"message_key":"' || message_key || '","scope":"' || scope || '","severity":"' || severity || '"}}'"""
_INTEGRITY = """
, lf AS (SELECT session_id, snapshot_id, count(*) AS a FROM ob GROUP BY ALL), rg AS (SELECT session_id, snapshot_id, count(*) AS b FROM cap GROUP BY ALL),
oi AS MATERIALIZED (SELECT session_id, snapshot_id, unnest(list_filter([CASE WHEN b IS NULL THEN 'ORPHAN_SNAPSHOT' END, CASE WHEN a IS NULL THEN 'MISSING_SNAPSHOT' END, CASE WHEN a > 1 THEN 'DUPLICATE_SNAPSHOT' END,
  CASE WHEN b > 1 THEN 'DUPLICATE_SUMMARY' END], lambda x: x IS NOT NULL)) AS issue FROM lf FULL OUTER JOIN rg USING (session_id, snapshot_id))"""
_INDEX = ", ic AS MATERIALIZED (SELECT session_id, count(*) = count(DISTINCT observation_index) AS uniq, count(*) = count(DISTINCT observation_index) AND min(observation_index) = 0 AND max(observation_index) = count(*) - 1 AS cont FROM ob GROUP BY session_id)"
_BEFORE = "EXISTS (SELECT 1 FROM ob e WHERE e.session_id = o.session_id AND (e.observation_index, e.snapshot_id) < (o.observation_index, o.snapshot_id) AND {})"
_FAMILY = """CASE WHEN user_agent LIKE '%Edg/%' THEN 'Edge' WHEN user_agent LIKE '%Chrome/%' THEN 'Chrome' WHEN user_agent LIKE '%Firefox/%' THEN 'Firefox' WHEN user_agent LIKE '%Version/%Safari%' THEN 'Safari' ELSE 'Unknown' END"""
_VERSION = f"""CASE {_FAMILY} WHEN 'Edge' THEN regexp_extract(user_agent, 'Edg/([0-9.]+)', 1) WHEN 'Chrome' THEN regexp_extract(user_agent, 'Chrome/([0-9.]+)', 1) WHEN 'Firefox' THEN regexp_extract(user_agent, 'Firefox/([0-9.]+)', 1) WHEN 'Safari' THEN regexp_extract(user_agent, 'Version/([0-9.]+)', 1) END"""


def _rows(frame: str, keep: str, *items: tuple[str, str, str]) -> str:
    return "\nUNION ALL ".join(f"SELECT {keep}, '{p}' AS path, '{m}' AS message FROM {frame} WHERE {w}" for p, m, w in items)


_J = "json_extract_string(record, '$.{}')"

ORACLES = {
    "admin_bar_state": _observed("SELECT snapshot_id, admin_bar_state FROM ob"),
    "environment_warnings": _observed(f"""SELECT snapshot_id, {_list(_when("admin_bar_state <> 'ABSENT'", "WORDPRESS_ADMIN_BAR_PRESENT"), _when("editor_preview", "ELEMENTOR_EDITOR_PREVIEW_PRESENT"), _when("iframe", "IFRAME_CAPTURE"),
  _when("NOT has_focus", "DOCUMENT_NOT_FOCUSED"), _when("off_scroll", "PAGE_NOT_AT_TOP"), _when("k % 12 = 0 OR k % 18 = 1", "SEMANTIC_DIALOG_EVIDENCE_PRESENT"), _when("animations > 0", "ACTIVE_ANIMATIONS_PRESENT"),
  _when("incomplete_in_viewport > 0", "IMAGES_IN_VIEWPORT_INCOMPLETE"))} AS warning_codes FROM ob"""),
    "modal_counts": """SELECT CAST(c_nationkey AS BIGINT) AS page_id, count_if(v AND o_orderkey % 5 = 0) AS dialogs, count_if(v AND o_orderkey % 7 = 0) AS aria_modals, count_if(v AND (o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 OR o_orderkey % 4 = 0)) AS modal_count
  FROM (SELECT *, o_orderkey % 11 <> 0 AS v FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY 1""",
    "client_mix": _observed(f"""SELECT {_FAMILY} AS family, {_VERSION} AS version, CASE WHEN regexp_matches(lower(user_agent), 'tablet|ipad') THEN 'TABLET' WHEN regexp_matches(lower(user_agent), 'mobile|android|iphone') THEN 'MOBILE'
  WHEN regexp_matches(lower(user_agent), 'windows|macintosh|linux|cros') THEN 'DESKTOP' ELSE 'UNKNOWN' END AS platform, count(*) AS n FROM ob GROUP BY ALL"""),
    "gate_modules": _observed("""SELECT oe.snapshot_id, i, CASE WHEN include_relationships THEN relationships_availability ELSE 'DISABLED' END AS relationships_availability,
  CASE WHEN include_interaction THEN interaction_availability ELSE 'DISABLED' END AS interaction_availability, CASE WHEN include_text THEN text_availability ELSE 'DISABLED' END AS text_availability FROM oe JOIN ob USING (snapshot_id)"""),
    "export_policy": _observed("""SELECT session_id, coalesce(workflow_mode, CASE WHEN c.n > 0 THEN 'RUNTIME_EVIDENCE' END) AS effective_mode, coalesce(workflow_mode = 'MINIMUM_PYTHON_FEED', false) AS allowed,
  coalesce(workflow_mode = 'MINIMUM_PYTHON_FEED' AND status NOT IN ('FAILED', 'CAPTURING'), false) AS fallback FROM ses LEFT JOIN (SELECT session_id, count(*) AS n FROM cap GROUP BY ALL) c USING (session_id)"""),
    "deterministic_ids": _observed("""SELECT session_id, snapshot_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', CAST(('0x' || substr(h, 17, 1)) AS INT) % 16 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid,
  'node-' || lpad(CAST(event_id + 1 AS VARCHAR), CAST(greatest(6, length(CAST(event_id + 1 AS VARCHAR))) AS INT), '0') AS node_id FROM (SELECT *, sha256('pagefacts.snapshot' || chr(0) || session_id || ':' || observation_index) AS h FROM ob)"""),
    "artifact_digests": _observed("""SELECT 'sha256:' || sha256(t) AS digest, count(*) AS n, min(t) AS cj1 FROM (SELECT '{"incomplete_total":' || incomplete_total || ',"page_binding_state":"' || page_binding_state || '","prerendering":' || CASE WHEN prerendering THEN 'true' ELSE 'false' END
  || ',"reasons":' || CASE reason_text WHEN '' THEN '[]' ELSE '["' || replace(reason_text, ',', '","') || '"]' END || ',"reference_text":' || coalesce('"' || reference_text || '"', 'null') || ',"requested_profile":"' || requested_profile || '"}' AS t FROM ob) GROUP BY 1"""),
    "semantic_digests": _observed("""SELECT '{"detail":{"k":' || k || '},"requested_profile":"' || requested_profile || '","status":"' || status || '","value":' || CASE WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE CAST(value AS VARCHAR) END || '}' AS text, count(*) AS n FROM ob GROUP BY 1"""),
    "observation_set": _observed("""SELECT session_id, snapshot_id, observation_index, inner_width, f || '/snapshot.json' AS snapshot_path, CASE WHEN EXISTS (SELECT 1 FROM shot WHERE shot.snapshot_id = x.snapshot_id AND shot.session_id = x.session_id) THEN f || '/screenshot.png' ELSE '-' END AS screenshot_path,
  'observation_set' AS artifact_type, '1.1.0' AS schema_version, 'CJ1' AS canonicalization_profile FROM (SELECT *, 'observations/observation-' || lpad(CAST(n AS VARCHAR), CAST(greatest(4, length(CAST(n AS VARCHAR))) AS INT), '0') AS f
  FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY observation_index, captured_at, snapshot_id) AS n FROM ob)) x"""),
    "adopt_context": _observed("""SELECT session_id, t AS adopted, CASE WHEN t THEN 'sha256:' || sha256('new-' || session_id) ELSE reference_digest END AS reference_digest,
  CASE WHEN NOT t THEN 'EXACT' WHEN selected_document_id IS NOT NULL AND confirmation_state = 'CONFIRMED' THEN 'PROBABLE' ELSE 'UNMATCHED' END AS binding_state FROM (SELECT *, coalesce((status = 'CREATED' OR kind = 'empty') AND coalesce(c.n, 0) = 0, false) AS t
  FROM ses LEFT JOIN (SELECT session_id, count(*) AS n FROM cap GROUP BY ALL) c USING (session_id))"""),
    "redact_context": _observed("""SELECT snapshot_id, array_to_string(list_filter([CASE WHEN c_long IS NOT NULL THEN 'detail' END, 'limit', CASE WHEN c_url IS NOT NULL THEN 'page_url' END], lambda x: x IS NOT NULL), ',') AS context_keys,
  CASE WHEN c_url IS NULL THEN '-' WHEN k % 4 = 0 THEN 'https://h.example/a?redacted' ELSE 'https://h.example/a' END AS page_url, CASE WHEN c_long IS NULL THEN 0 ELSE 500 END AS detail_length FROM dg"""),
    "index_check": _observed("SELECT session_id, uniq AS \"unique\", cont AS contiguous FROM ic", _INDEX),
    "observation_order": _observed("SELECT session_id, snapshot_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY observation_index, captured_at, snapshot_id) - 1 AS INT) AS position FROM ob"),
    "latest_capture": _observed("""SELECT session_id, count(*) AS capture_count, arg_max(snapshot_id, (captured_at, snapshot_id)) AS snapshot_id, strftime(max(captured_at), '%Y-%m-%d %H:%M:%S') AS captured_at, arg_max(status, (captured_at, snapshot_id)) AS status FROM cap GROUP BY session_id"""),
    "session_listing": _observed("""SELECT session_id, 'Session ' || session_id AS name, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, status, workflow_mode, coalesce(c.n, 0) AS capture_count, c.l AS latest_snapshot_id
  FROM ses LEFT JOIN (SELECT session_id, count(*) AS n, arg_max(snapshot_id, (captured_at, snapshot_id)) AS l FROM cap GROUP BY ALL) c USING (session_id) WHERE user_id % 8 <> 3"""),
    "corrupt_sessions": _observed("SELECT count(*) AS corrupt_count FROM ses WHERE user_id % 8 = 3"),
    "upgrade_legacy": """SELECT doc_id, CASE WHEN doc_id % 4 IN (0, 3) THEN sha256(text) ELSE 'LEGACY_UNVERIFIED' END AS sha256, CAST(octet_length(encode(text)) AS INT) AS byte_length,
  CASE WHEN doc_id % 4 IN (0, 3) THEN 'VERIFIED' ELSE 'LEGACY_UNVERIFIED' END AS integrity_status FROM documents""",
    "upgrade_legacy_sessions": _observed("SELECT session_id, '1.1.0' AS schema_version, workflow_mode FROM ses"),
    "upgrade_legacy_jobs": """SELECT 'job-' || doc_id AS job_id, CASE WHEN doc_id % 3 = 0 THEN 'MINIMUM_PYTHON_FEED' ELSE 'RUNTIME_EVIDENCE' END AS workflow_mode,
  strftime(TIMESTAMP '2024-01-01 00:00:00' + CASE WHEN doc_id % 2 = 0 THEN to_seconds(doc_id) ELSE to_seconds(0) END, '%Y-%m-%d %H:%M:%S') AS captured_at FROM documents""",
    "observation_integrity": _observed("SELECT session_id, snapshot_id, issue FROM oi", _INTEGRITY),
    "screenshot_match": _observed("""SELECT session_id, snapshot_id, coalesce(screenshot_requested, false) AS requested, n IS NOT NULL AS available, CASE WHEN screenshot_requested IS NULL THEN 'FOREIGN_SCREENSHOT' WHEN n > 1 THEN 'DUPLICATE_SCREENSHOT' END AS issue
  FROM ob FULL OUTER JOIN (SELECT session_id, snapshot_id, count(*) AS n FROM shot GROUP BY ALL) s USING (session_id, snapshot_id)"""),
    "reference_match": _observed("SELECT ob.session_id, snapshot_id, ob.reference_digest IS NOT DISTINCT FROM ses.reference_digest AS consistent FROM ob JOIN ses USING (session_id)"),
    "missing_profiles": _observed("""SELECT session_id, array_to_string(list_sort(list_distinct(list(requested_profile))), ',') AS present, array_to_string(list_filter(['DESKTOP', 'TABLET', 'MOBILE'], lambda p: NOT list_contains(list(requested_profile), p)), ',') AS missing FROM ob GROUP BY session_id""").replace(
        "SELECT session_id, array_to_string(list_sort(list_distinct(list(requested_profile))), ',') AS present, array_to_string(list_filter(['DESKTOP', 'TABLET', 'MOBILE'], lambda p: NOT list_contains(list(requested_profile), p)), ',') AS missing FROM ob GROUP BY session_id",
        "SELECT session_id, array_to_string(list_sort(l), ',') AS present, array_to_string(list_filter(['DESKTOP', 'TABLET', 'MOBILE'], lambda p: NOT list_contains(l, p)), ',') AS missing FROM (SELECT session_id, list(DISTINCT requested_profile) AS l FROM ob GROUP BY session_id)"),
    "capture_profile": _observed("""SELECT snapshot_id, max_elements, max_depth, CASE WHEN max_elements = 750 AND max_depth = 24 THEN 'STANDARD' WHEN max_elements = 1000 AND max_depth = 40 THEN 'DEEP_DOM' ELSE 'CUSTOM' END AS profile
  FROM (SELECT snapshot_id, CASE k % 3 WHEN 0 THEN 750 WHEN 1 THEN 1000 ELSE 500 END AS max_elements, CASE k % 4 WHEN 0 THEN 24 ELSE 40 END AS max_depth FROM ob)"""),
    "admission_audit": _observed(f"""SELECT session_id, snapshot_id, codes, codes = '' AS allowed FROM (SELECT o.session_id, o.snapshot_id, {_list(
        _when("NOT (user_id % 9 <> 0 AND user_id % 10 <> 9)", "SOURCE_CONTEXT_REQUIRED"),
        _when("(user_id % 9 <> 0 AND user_id % 10 <> 9 AND (user_id % 11 = 0 OR user_id % 5 = 1)) OR (user_id % 9 <> 0 AND " + _BEFORE.format("e.reference_digest IS DISTINCT FROM ('sha256:' || sha256('ref-' || o.user_id))") + ")", "SOURCE_CONTEXT_INCOMPATIBLE"),
        _when("requested_profile = 'CUSTOM'", "REQUIRED_VIEWPORT_PROFILE_MISSING"), _when(_BEFORE.format("e.requested_profile = o.requested_profile"), "REQUIRED_PROFILE_ALREADY_CAPTURED"),
        _when(_BEFORE.format("e.inner_width = o.inner_width"), "DUPLICATE_MEASURED_VIEWPORT"), _when(_BEFORE.format("e.page_fingerprint <> o.page_fingerprint"), "PAGE_FINGERPRINT_MISMATCH"),
        *[_when(c, code) for c, code in _ENV])} AS codes FROM ob o)"""),
    "readiness_verdict": _observed("""SELECT capture_id, CASE WHEN failed THEN 'ERROR' WHEN stop IS NOT NULL THEN 'STABLE' WHEN last_e >= 1500 THEN 'TIMEOUT' ELSE 'UNSTABLE' END AS process_state,
  CASE WHEN failed THEN 'ERROR' WHEN stop IS NULL AND last_e >= 1500 THEN 'PARTIAL' ELSE 'AVAILABLE' END AS availability, CASE WHEN failed THEN bad_at ELSE coalesce(stop, last_n) END + 1 AS sample_count,
  CAST(CASE WHEN failed THEN -1.0 ELSE coalesce(stop_w, last_w) END AS DOUBLE) AS final_document_width FROM (SELECT *, coalesce(bad_at <= coalesce(stop, last_n), false) AS failed FROM (
  SELECT capture_id, min(CASE WHEN run THEN n END) AS stop, max(n) AS last_n, arg_max(e, n) AS last_e, arg_max(w, n) AS last_w, arg_min(w, n) FILTER (run) AS stop_w, min(CASE WHEN bad THEN n END) AS bad_at FROM rr WHERE seen GROUP BY capture_id))""",
        """, rs0 AS (SELECT session_id AS capture_id, pure_index AS n, pure_index * 100.0 AS e, CASE WHEN k < 50 THEN 1000.0 ELSE 1010.0 END AS w, k = 97 AND user_id % 3 = 0 AS bad, k % 25 <> 0 AND k % 20 <> 1 AND k % 15 <> 2 AS ready FROM ob),
rs1 AS (SELECT *, n = 0 OR coalesce(lag(e) OVER w1 < 1500, false) AS seen, coalesce(lag(w) OVER w1 = w AND NOT bad AND NOT lag(bad) OVER w1, false) AND ready AS ok FROM rs0 WINDOW w1 AS (PARTITION BY capture_id ORDER BY n)),
rr AS (SELECT *, seen AND ok AND coalesce(lag(ok, 1) OVER w2, false) AND coalesce(lag(ok, 2) OVER w2, false) AS run FROM rs1 WINDOW w2 AS (PARTITION BY capture_id ORDER BY n))"""),
    "image_readiness": _observed("""SELECT *, broken + pending + decode_failed + timed_out AS unresolved FROM (SELECT session_id, count(*) AS candidates, count_if(k % 3 <> 0 AND k % 5 > 0) AS loaded, count_if(k % 3 <> 0 AND k % 5 = 0) AS broken, count_if(k % 3 = 0 AND k % 4 = 1) AS decode_failed,
  count_if(k % 3 = 0 AND k % 4 <> 1 AND k % 2 = 0) AS timed_out, count_if(k % 3 = 0 AND k % 4 <> 1 AND k % 2 <> 0) AS pending FROM ob GROUP BY session_id)"""),
    "merge_sessions": _observed(f"""SELECT session_id, CASE WHEN c.n IS NULL THEN status WHEN c.a THEN 'COMPLETE' ELSE 'PARTIAL' END AS status, coalesce(c.n, 0) AS capture_count, strftime(c.t, '%Y-%m-%d %H:%M:%S') AS last_captured_at, o.f AS browser_family, o.v AS browser_version, coalesce(sb.s, 'UNMATCHED') AS source_binding_state, o.r AS reference_digest
  FROM ses LEFT JOIN (SELECT session_id, CASE max(CASE page_binding_state WHEN 'EXACT' THEN 3 WHEN 'PROBABLE' THEN 2 WHEN 'AMBIGUOUS' THEN 1 ELSE 0 END) WHEN 3 THEN 'EXACT' WHEN 2 THEN 'PROBABLE' WHEN 1 THEN 'AMBIGUOUS' ELSE 'UNMATCHED' END AS s FROM ob GROUP BY ALL) sb USING (session_id) LEFT JOIN (SELECT session_id, count(DISTINCT snapshot_id) AS n, bool_and(status = 'COMPLETE') AS a, max(captured_at) AS t FROM cap GROUP BY ALL) c USING (session_id)
  LEFT JOIN (SELECT session_id, {_FAMILY} AS f, {_VERSION} AS v, reference_digest AS r FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY captured_at DESC, snapshot_id DESC) AS rn FROM ob) WHERE rn = 1) o USING (session_id)"""),
    "capture_summaries": _observed(f"""SELECT session_id, snapshot_id, strftime(captured_at, '%Y-%m-%d %H:%M:%S') AS captured_at, inner_width, inner_height, page_fingerprint, page_binding_state, truncated AS truncated_branch_count, e.n AS element_count, e.o AS overflow_count, coalesce(d.n, 0) AS diagnostic_count, {', '.join(f'e.{s} AS n_{s.lower()}' for s in _STATES)},
  EXISTS (SELECT 1 FROM shot WHERE shot.snapshot_id = ob.snapshot_id) AS screenshot_available, completeness AS completeness_status, reason_text AS reasons, CASE status WHEN 'AVAILABLE' THEN 'COMPLETE' ELSE 'PARTIAL' END AS status
  FROM ob JOIN (SELECT snapshot_id, count(*) AS n, count_if(overflowing OR clipped) AS o, {', '.join(f"count_if(binding_state = '{s}') AS {s}" for s in _STATES)} FROM oe GROUP BY ALL) e USING (snapshot_id)
  LEFT JOIN (SELECT snapshot_id, count(*) AS n FROM dg GROUP BY ALL) d USING (snapshot_id)"""),
    "semantic_completeness": _observed("""SELECT session_id, array_to_string(list_sort(coalesce(l, [])), ',') AS reasons, CASE WHEN len(coalesce(l, [])) = 0 THEN 'COMPLETE' ELSE 'PARTIAL' END AS status FROM (SELECT session_id, list(DISTINCT code) FILTER (scope = 'SEMANTIC') AS l FROM dg GROUP BY session_id)"""),
    "feed_readiness": _observed(f"""SELECT session_id, state, blocking_codes, coalesce(n, 0) AS observation_count, coalesce(widths, 0) AS distinct_viewport_widths, coalesce(profiles, '') AS profiles,
  array_to_string(list_filter([CASE WHEN NOT coalesce(pd, false) THEN 'DESKTOP' END, CASE WHEN NOT coalesce(pt, false) THEN 'TABLET' END, CASE WHEN NOT coalesce(pmob, false) THEN 'MOBILE' END], lambda x: x IS NOT NULL), ',') AS missing_profiles,
  coalesce(fps <= 1, true) AS page_fingerprint_consistent, {', '.join(f'coalesce(n_{s}, 0) AS n_{s}' for s in _SHORT)} FROM fr""", _FEED),
    "feed_offenders": _observed("\nUNION ALL ".join(f"SELECT session_id, observation_index, '{c}' AS code FROM ob WHERE {w}" for w, c in _ENV if "EDITOR" not in c and "IFRAME" not in c)),
    "resource_usage": _observed("""SELECT session_id, snapshot_bytes, screenshot_bytes, capture_count, snapshot_bytes + screenshot_bytes AS total_bytes, snapshot_bytes + screenshot_bytes <= 220000000 AS exportable,
  snapshot_bytes + screenshot_bytes + 12000000 + 16000000 <= 220000000 AND capture_count < 1000 AS admissible FROM us""", _USAGE),
    "export_preflight": _observed(f"""SELECT session_id, coalesce(n, 0) AS observations, {_list(_when("coalesce(n, 0) = 0", "NO_RUNTIME_OBSERVATIONS"), _when("status = 'CAPTURING'", "SESSION_CAPTURE_IN_PROGRESS"), _when("status = 'FAILED'", "SESSION_FAILED"),
    _when("workflow_mode IS NULL OR workflow_mode <> 'MINIMUM_PYTHON_FEED'", "SESSION_WORKFLOW_MODE_MISMATCH"), _when("total > 220000000", "STORAGE_QUOTA_EXCEEDED"), _when("err", "READINESS_ERROR")).replace("list_filter([", "list_concat(string_split(nullif(blocking_codes, ''), ','), list_filter([", 1).replace("lambda c: c IS NOT NULL)", "lambda c: c IS NOT NULL))", 1)} AS blockers,
  {_list(_when("reference_digest IS NULL", "SOURCE_CONTEXT_NOT_IMPORTED"), _when("coalesce(dims, 0) < 2", "SINGLE_VIEWPORT_ONLY"), _when("shots IS NULL", "SCREENSHOT_NOT_REQUESTED"), _when("NOT coalesce(hid, false)", "HIDDEN_ELEMENTS_EXCLUDED"), _when("coalesce(inc, 0) > 0", "INCOMPLETE_IMAGES_OBSERVED"))} AS warnings,
  state AS feed_state, coalesce(workflow_mode = 'MINIMUM_PYTHON_FEED' AND n > 0 AND status NOT IN ('CAPTURING', 'FAILED') AND NOT err AND coalesce(total, 0) <= 220000000, false) AS fallback
  FROM fr LEFT JOIN (SELECT session_id, count(DISTINCT (inner_width, inner_height)) AS dims, bool_or(include_hidden) AS hid, sum(incomplete_total) AS inc FROM ob GROUP BY ALL) USING (session_id)
  LEFT JOIN (SELECT session_id, count(*) AS shots FROM shot GROUP BY ALL) USING (session_id) LEFT JOIN (SELECT session_id, snapshot_bytes + screenshot_bytes AS total FROM us) USING (session_id)""", _FEED + _USAGE),
    "runtime_coverage": _observed(f"""SELECT session_id, observations, elements_discovered, complete_observations, distinct_dimensions, screenshots_requested, {', '.join(f'readiness_{s.lower()}' for s in fixed.PROCESS_STATES)}, coalesce(e.n, 0) AS elements_emitted, coalesce(screenshots, 0) AS screenshots, coalesce(d.n, 0) AS error_diagnostics,
  element_budget_total, element_budget_used, scan_budget_total, scan_budget_used, maximum_depth_observed, truncated_branch_count, CASE WHEN coalesce(d.n, 0) > 0 THEN 'ERROR' WHEN clean THEN 'AVAILABLE' ELSE 'PARTIAL' END AS runtime_availability,
  observations - complete_observations AS partial_observations, greatest(0, screenshots_requested - coalesce(screenshots, 0)) AS screenshots_failed, CASE WHEN distinct_dimensions > 1 THEN 'AVAILABLE' ELSE 'INSUFFICIENT' END AS multi_viewport
  FROM (SELECT session_id, count(*) AS observations, CAST(sum(elements_visited) AS BIGINT) AS elements_discovered, count_if(completeness = 'COMPLETE') AS complete_observations, count(DISTINCT (inner_width, inner_height)) AS distinct_dimensions, count_if(screenshot_requested) AS screenshots_requested,
    {', '.join(f"count_if(process_state = '{s}') AS readiness_{s.lower()}" for s in fixed.PROCESS_STATES)}, bool_and(status = 'AVAILABLE' AND completeness = 'COMPLETE') AS clean, CAST(sum(element_budget) AS BIGINT) AS element_budget_total, CAST(sum(elements_emitted) AS BIGINT) AS element_budget_used,
    CAST(sum(scan_budget) AS BIGINT) AS scan_budget_total, CAST(sum(scan_used) AS BIGINT) AS scan_budget_used, max(max_depth) AS maximum_depth_observed, CAST(sum(truncated) AS BIGINT) AS truncated_branch_count FROM ob GROUP BY session_id)
  LEFT JOIN (SELECT session_id, count(*) AS n FROM oe GROUP BY ALL) e USING (session_id) LEFT JOIN sc USING (session_id)
  LEFT JOIN (SELECT session_id, count(DISTINCT t) AS n FROM (SELECT session_id, {_DIAGNOSTIC} AS t FROM dg WHERE scope = 'SEMANTIC' AND severity = 'ERROR') GROUP BY ALL) d USING (session_id)""", _SHOTS),
    "module_availability": _observed("SELECT session_id, " + ", ".join(
        f"CASE WHEN NOT bool_or({flag}) THEN 'DISABLED' WHEN bool_or({flag} AND {m}_availability = 'ERROR') THEN 'ERROR' WHEN bool_or({flag} AND {m}_availability = 'UNAVAILABLE') THEN 'UNAVAILABLE' WHEN bool_or({flag} AND {m}_availability IN ('PARTIAL', 'INSUFFICIENT')) THEN 'PARTIAL' ELSE 'AVAILABLE' END AS {m}_module"
        for m, flag in MODULES.items()) + """, 'AVAILABLE' AS geometry_module, 'AVAILABLE' AS computed_styles_module, any_value(ready) AS capture_readiness_module FROM ob JOIN (SELECT snapshot_id, """
        + ", ".join(f"{m}_availability" for m in MODULES) + """ FROM oe) USING (snapshot_id) JOIN (SELECT session_id, CASE WHEN bool_or(process_state = 'ERROR') THEN 'ERROR'
          WHEN bool_or(process_state IN ('TIMEOUT', 'INSUFFICIENT')) THEN 'PARTIAL' ELSE 'AVAILABLE' END AS ready FROM ob GROUP BY session_id) USING (session_id) GROUP BY session_id"""),
    "binding_coverage": _observed(f"""SELECT session_id, p.* EXCLUDE (session_id, imp), e.* EXCLUDE (session_id), imp AS source_context_imported, CASE WHEN imp THEN selected_document_id END AS selected_document_id,
  CASE WHEN NOT imp OR selected_document_id IS NULL THEN 'INSUFFICIENT' WHEN elements_ambiguous > 0 THEN 'PARTIAL' ELSE 'AVAILABLE' END AS availability, elements_total - elements_unmatched AS elements_with_evidence
  FROM (SELECT session_id, count(*) AS pages_total, {', '.join(f"count_if(page_binding_state = '{s}') AS pages_{s.lower()}" for s in _STATES)}, bool_or(reference_digest IS NOT NULL) AS imp FROM ob GROUP BY ALL) p
  JOIN (SELECT session_id, count(*) AS elements_total, {', '.join(f"count_if(binding_state = '{s}') AS elements_{s.lower()}" for s in _STATES)} FROM oe GROUP BY ALL) e USING (session_id) JOIN ses USING (session_id)"""),
    "evidence_coverage": _observed(f"""SELECT session_id, o.* EXCLUDE (session_id), e.* EXCLUDE (session_id), coalesce(screenshots, 0) AS screenshots, CASE WHEN source_context_imported THEN 'AVAILABLE' ELSE 'INSUFFICIENT' END AS source_context_status,
  CASE WHEN NOT source_context_imported THEN 'INSUFFICIENT' WHEN n_ambiguous > 0 OR (n_exact + n_probable > 0 AND n_unmatched > 0) THEN 'PARTIAL' WHEN n_exact + n_probable > 0 THEN 'AVAILABLE' ELSE 'INSUFFICIENT' END AS binding_status,
  CASE WHEN distinct_viewports > 1 THEN 'AVAILABLE' ELSE 'INSUFFICIENT' END AS responsive_status, CASE WHEN coalesce(screenshots, 0) = 0 THEN 'INSUFFICIENT' WHEN screenshots = observations THEN 'AVAILABLE' ELSE 'PARTIAL' END AS visual_status
  FROM (SELECT session_id, count(*) AS observations, count(DISTINCT (inner_width, inner_height)) AS distinct_viewports, bool_or(reference_digest IS NOT NULL) AS source_context_imported, bool_or(include_hidden) AS hidden_included, bool_or(include_colors) AS colors_included, bool_or(include_text) AS text_included FROM ob GROUP BY ALL) o
  JOIN (SELECT session_id, count(*) AS n_total, {', '.join(f"count_if(binding_state = '{s}') AS n_{s.lower()}" for s in _STATES)} FROM oe GROUP BY ALL) e USING (session_id) LEFT JOIN sc USING (session_id)""", _SHOTS),
    "coverage_diagnostics": _observed("\nUNION ALL ".join(f"SELECT session_id, '{code}' AS code, '{sev}' AS severity, '{scope}' AS scope, CAST({n} AS BIGINT) AS count FROM g WHERE {w}" for code, sev, scope, n, w in (
        ("SOURCE_CONTEXT_NOT_IMPORTED", "INFO", "SEMANTIC", "nodes", "NOT ctx"), ("SINGLE_VIEWPORT_ONLY", "INFO", "SEMANTIC", "n", "dims < 2"), ("SCREENSHOT_NOT_REQUESTED", "INFO", "SEMANTIC", "0", "shots = 0"),
        ("HIDDEN_ELEMENTS_EXCLUDED", "INFO", "SEMANTIC", "0", "NOT hid"), ("INCOMPLETE_IMAGES_OUTSIDE_VIEWPORT", "INFO", "SEMANTIC", "outside", "outside > 0"), ("DOCUMENT_NOT_FOCUSED", "WARNING", "OPERATIONAL", "unf", "unf > 0"),
        ("PAGE_NOT_AT_CANONICAL_SCROLL", "WARNING", "OPERATIONAL", "scr", "scr > 0"), ("PAGE_NOT_VISIBLE", "WARNING", "OPERATIONAL", "inv", "inv > 0"), ("PAGE_PRERENDERING", "WARNING", "OPERATIONAL", "pre", "pre > 0"),
        ("WORDPRESS_ADMIN_BAR_PRESENT_OR_AMBIGUOUS", "WARNING", "OPERATIONAL", "adm", "adm > 0"), ("VIEWPORT_IMAGES_NOT_READY", "WARNING", "OPERATIONAL", "img", "img > 0"))),
        """, g AS MATERIALIZED (SELECT o.*, coalesce(e.nodes, 0) AS nodes, coalesce(s.shots, 0) AS shots FROM (SELECT session_id, count(*) AS n, count(DISTINCT (inner_width, inner_height)) AS dims, bool_or(reference_digest IS NOT NULL) AS ctx, bool_or(include_hidden) AS hid, sum(greatest(0, incomplete_total - incomplete_in_viewport)) AS outside,
  count_if(NOT has_focus) AS unf, count_if(off_scroll) AS scr, count_if(visibility_state <> 'visible') AS inv, count_if(prerendering) AS pre, count_if(admin_bar_state <> 'ABSENT') AS adm, count_if(unresolved > 0) AS img FROM ob GROUP BY ALL) o
  LEFT JOIN (SELECT session_id, count(*) AS nodes FROM oe GROUP BY ALL) e USING (session_id) LEFT JOIN (SELECT session_id, count(*) AS shots FROM shot GROUP BY ALL) s USING (session_id))"""),
    "diagnostic_set": _observed(f"SELECT DISTINCT session_id, sha256({_DIAGNOSTIC}) AS digest FROM dg"),
    "merge_diagnostics": _observed(f"SELECT session_id, code, count(DISTINCT {_DIAGNOSTIC}) AS n FROM dg GROUP BY ALL"),
    "page_diagnostics": _observed("\nUNION ALL ".join(f"SELECT session_id, '{c}' AS code, count_if({w}) AS count FROM oe GROUP BY ALL HAVING count_if({w}) > 0" for c, w in (
        ("IDENTITY_COLLISION", "identity_status = 'AMBIGUOUS'"), ("TEXT_SHAPE_LIMIT_REACHED", "text_over_limit"), ("SOURCE_BINDING_AMBIGUOUS", "binding_state = 'AMBIGUOUS'"), ("PARTIAL_IDENTITY", "identity_status <> 'UNIQUE'")))),
    "budget_totals": _observed("""SELECT session_id, CAST(sum(element_budget) AS BIGINT) AS element_budget_total, CAST(sum(elements_emitted) AS BIGINT) AS element_budget_used, CAST(sum(scan_budget) AS BIGINT) AS scan_budget_total, CAST(sum(scan_used) AS BIGINT) AS scan_budget_used,
  max(max_depth) AS maximum_depth_observed, CAST(sum(truncated) AS BIGINT) AS truncated_branch_count FROM ob GROUP BY session_id"""),
    "evidence_binding_state": _observed("SELECT snapshot_id, CASE WHEN k % 7 = 0 THEN 'AMBIGUOUS' WHEN k % 2 = 0 AND k % 3 = 0 AND k % 5 > 0 THEN 'EXACT' WHEN k % 2 = 0 AND (k % 3 = 0 OR k % 5 > 0) THEN 'PROBABLE' ELSE 'UNMATCHED' END AS binding_state FROM ob"),
    "snapshot_issues": _observed(_rows("(SELECT *, CASE WHEN k % 50 = 9 THEN 'snap-' || event_id ELSE snapshot_id END AS sid FROM ob)", "session_id, sid AS snapshot_id", ("status", "enum", "k % 20 = 3"), ("snapshot_id", "pattern", "k % 50 = 9"), ("observation_index", "range", "k % 40 = 7"),
        ("page_fingerprint", "pattern", "k % 25 = 4"), ("inner_width", "finite", "k % 30 = 5"), ("elements_emitted", "maximum", "k % 35 = 6"), ("process_state", "required", "k % 45 = 8"))),
    "element_issues": _observed("""SELECT snapshot_id, 'node_id' AS path, 'pattern' AS message, 1 + k % 5 AS n FROM ob WHERE event_id % 41 = 3 AND event_id % 37 <> 2
UNION ALL SELECT snapshot_id, 'area', 'finite', 1 FROM ob WHERE event_id % 47 = 5
UNION ALL SELECT snapshot_id, 'document_order', 'contiguous', 1 FROM ob WHERE event_id % 31 = 1 AND k % 5 >= 1
UNION ALL SELECT snapshot_id, 'node_id', 'unique', 1 FROM ob WHERE k % 5 >= 1 AND (event_id % 37 = 2 OR event_id % 41 = 3)
UNION ALL SELECT snapshot_id, 'stable_reference', 'unique', 1 FROM ob WHERE event_id % 43 = 4 AND k % 5 >= 1
UNION ALL SELECT snapshot_id, 'elements_emitted', 'agreement', 1 FROM ob WHERE event_id % 53 = 6"""),
    "contract_issues": _observed(_rows("(SELECT * FROM ob WHERE k % 29 <> 0)", "snapshot_id", ("state", "enum", "k % 11 = 0"), ("state", "type", "k % 11 = 1"), ("count", "required", "k % 13 = 0"), ("count", "type", "k % 13 = 1"), ("count", "maximum", "k > 90 AND k % 13 > 1"),
        ("label", "pattern", "k % 7 = 1"), ("page", "required", "k % 17 = 2"), ("page.profile", "const", "k % 19 < 2 AND k % 17 <> 2"), ("page.draft", "const", "k % 9 = 0 AND k % 17 <> 2"), ("page.zz", "unexpected", "k % 31 = 0 AND k % 17 <> 2"),
        ("codes", "min_items", "k % 8 = 0"), ("codes", "max_items", "k % 8 = 1"), ("codes", "unique_items", "k % 8 = 2"), ("codes[]", "type", "k % 8 = 3"), ("codes[]", "pattern", "k % 8 = 4"), ("codes", "type", "k % 8 = 5"), ("extra", "unexpected", "k % 23 = 0")) + "\nUNION ALL SELECT snapshot_id, '$', 'malformed' FROM ob WHERE k % 29 = 0"),
    "exportable": _observed(_rows("x", "session_id", ("snapshots", "NO_SNAPSHOTS", "kind = 'empty'"), ("status", "SESSION_NOT_EXPORTABLE", "status IN ('FAILED', 'CAPTURING')"), ("workflow_mode", "SESSION_WORKFLOW_MODE_MISMATCH", "workflow_mode IS NULL OR workflow_mode <> 'MINIMUM_PYTHON_FEED'"),
        ("observation_index", "DUPLICATE_OBSERVATION_INDEX", "NOT uniq"), ("observation_index", "NON_CONTIGUOUS_OBSERVATION_INDEX", "uniq AND NOT cont"), ("process_state", "READINESS_ERROR", "err"),
        *[("captures", c, f"list_contains(iss, '{c}')") for c in ("ORPHAN_SNAPSHOT", "MISSING_SNAPSHOT", "DUPLICATE_SNAPSHOT", "DUPLICATE_SUMMARY")]),
        _INTEGRITY + _INDEX + ", x AS MATERIALIZED (SELECT * FROM ses LEFT JOIN ic USING (session_id) LEFT JOIN (SELECT session_id, bool_or(process_state = 'ERROR') AS err FROM ob GROUP BY ALL) USING (session_id) LEFT JOIN (SELECT session_id, list(DISTINCT issue) AS iss FROM oi GROUP BY ALL) USING (session_id))"),
    "job_snapshot_issues": _observed(_rows("(SELECT *, 'job-' || snapshot_id AS job_id, k % 22 <> 2 AS there, user_id % 3 = 0 AS strict FROM ob)", "job_id", ("snapshot_id", "missing", "NOT there"), ("session_id", "identity", "there AND k % 21 = 1"), ("captured_at", "time", "there AND k % 23 = 3"),
        ("elements_emitted", "budget", "there AND k % 24 = 4"), ("page_fingerprint", "changed", "there AND strict AND k % 26 = 6"), ("inner_width", "changed", "there AND strict AND k % 27 = 7"), ("process_state", "error", "there AND process_state = 'ERROR'"),
        ("environment", "changed", "there AND strict AND (" + " OR ".join(c for c, _ in _ENV) + ")"))),
    "diagnostic_issues": _observed(_rows("dg", "snapshot_id", ("code", "enum", "code = 'not-a-code'"), ("severity", "enum", "severity = 'FATAL'"), ("message_key", "pattern", "message_key = 'Bad Key'"), ("failure_boundary", "enum", "failure_boundary = 'NOWHERE'"))),
    "read_snapshots": _observed("""SELECT session_id, count(DISTINCT snapshot_id) AS n_snapshots, count(*) AS n_elements, count_if(overflowing) AS n_overflowing FROM oe WHERE event_id % 71 <> 0 GROUP BY session_id
UNION ALL SELECT '-', count(*), 0, 0 FROM ob WHERE event_id % 71 = 0"""),
}
