"""Coverage and diagnostics of sessions: one aggregation per input, joined on the session."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagefacts import fixed
from pagefacts.functions.digests import canonical_struct
from pagefacts.operators.ranking import ordinal
from pagefacts.operators.sessions import admin_state, off_scroll, unresolved_images


def module_state(enabled: Column, availability: Column) -> Column:
    """Availability of a module from its element states: disabled, insufficient, then the worst one wins."""
    seen = F.when(enabled, availability)
    return (
        F.when(~F.coalesce(F.bool_or(enabled), F.lit(False)), "DISABLED").when(F.count(seen) == 0, "INSUFFICIENT")
        .when(F.bool_or(seen == "ERROR"), "ERROR").when(F.bool_or(seen == "UNAVAILABLE"), "UNAVAILABLE")
        .when(F.bool_or(seen.isin("PARTIAL", "INSUFFICIENT")), "PARTIAL").otherwise("AVAILABLE")
    )


def module_availability(elements: DataFrame, observations: DataFrame, modules: dict[str, str]) -> DataFrame:
    """State of every module of a session; `modules` maps those that a flag enables to the observation's flag.

    Geometry and computed styles are there as soon as one element is; readiness is always on and goes by the process states.
    """
    flags = observations.select("session_id", "snapshot_id", *dict.fromkeys(modules.values()))
    joined = flags.join(elements.select("snapshot_id", F.lit(True).alias("_element"), *[f"{m}_availability" for m in modules]), "snapshot_id", "left")
    measured = F.when(F.count("_element") > 0, "AVAILABLE").otherwise("INSUFFICIENT")
    by_element = joined.groupBy("session_id").agg(measured.alias("geometry_module"), measured.alias("computed_styles_module"), *[
        module_state(F.col(flag), F.col(f"{module}_availability")).alias(f"{module}_module") for module, flag in modules.items()])
    process = F.col("process_state")
    ready = F.when(process.isin("STABLE", "UNSTABLE"), "AVAILABLE").when(process == "TIMEOUT", "PARTIAL").otherwise(process)
    by_sample = observations.groupBy("session_id").agg(module_state(F.lit(True), ready).alias("capture_readiness_module"))
    return by_element.join(by_sample, "session_id")


def budget_totals(observations: DataFrame) -> DataFrame:
    return observations.groupBy("session_id").agg(
        F.sum("element_budget").alias("element_budget_total"), F.sum("elements_emitted").alias("element_budget_used"),
        F.sum("scan_budget").alias("scan_budget_total"), F.sum("scan_used").alias("scan_budget_used"),
        F.max("max_depth").alias("maximum_depth_observed"), F.sum("truncated").alias("truncated_branch_count"))


def _shots(screenshots: DataFrame, observations: DataFrame) -> DataFrame:
    known = screenshots.join(observations.select("session_id", "snapshot_id"), ["session_id", "snapshot_id"], "left_semi")
    return known.groupBy("session_id").agg(F.count("*").alias("screenshots"))


def _dimensions() -> Column:
    return F.countDistinct(F.struct("inner_width", "inner_height"))


def runtime_coverage(observations: DataFrame, elements: DataFrame, screenshots: DataFrame, diagnostics: DataFrame) -> DataFrame:
    base = observations.groupBy("session_id").agg(
        F.count("*").alias("observations"), F.sum("elements_visited").alias("elements_discovered"),
        F.count_if(F.col("completeness") == "COMPLETE").alias("complete_observations"), _dimensions().alias("distinct_dimensions"),
        F.count_if("screenshot_requested").alias("screenshots_requested"),
        F.bool_and((F.col("status") == "AVAILABLE") & (F.col("completeness") == "COMPLETE")).alias("_clean"),
        *[F.count_if(F.col("process_state") == s).alias(f"readiness_{s.lower()}") for s in fixed.PROCESS_STATES])
    emitted = elements.groupBy("session_id").agg(F.count("*").alias("elements_emitted"))
    # The package's diagnostics are a set: equal records count once.
    errors = diagnostic_set(diagnostics, ["session_id"]).groupBy("session_id").agg(
        F.count_if((F.col("scope") == "SEMANTIC") & (F.col("severity") == "ERROR")).alias("error_diagnostics"))
    out = reduce(lambda left, right: left.join(right, "session_id", "left"),
                 [emitted, _shots(screenshots, observations), errors, budget_totals(observations)], base)
    out = out.fillna(0, ["elements_emitted", "screenshots", "error_diagnostics"])
    state = F.when(F.col("error_diagnostics") > 0, "ERROR").when(F.col("_clean"), "AVAILABLE").otherwise("PARTIAL")
    return out.withColumns({
        "runtime_availability": state, "partial_observations": F.col("observations") - F.col("complete_observations"),
        "screenshots_failed": F.greatest(F.lit(0), F.col("screenshots_requested") - F.col("screenshots")),
        "multi_viewport": F.when(F.col("distinct_dimensions") > 1, "AVAILABLE").otherwise("INSUFFICIENT"),
    }).drop("_clean")


def _state_counts(frame: DataFrame, column: str, prefix: str) -> DataFrame:
    return frame.groupBy("session_id").agg(F.count("*").alias(f"{prefix}total"), *[
        F.count_if(F.col(column) == s).alias(f"{prefix}{s.lower()}") for s in fixed.BINDING_STATES])


def binding_coverage(elements: DataFrame, observations: DataFrame, sessions: DataFrame) -> DataFrame:
    pages = _state_counts(observations, "page_binding_state", "pages_")
    bound = _state_counts(elements, "binding_state", "elements_")
    context = observations.groupBy("session_id").agg(F.bool_or(F.col("reference_digest").isNotNull()).alias("_imported"))
    own = sessions.select("session_id", "selected_document_id")
    out = pages.join(bound, "session_id", "left").join(context, "session_id").join(own, "session_id", "left")
    out = out.fillna(0, [c for c in bound.columns if c != "session_id"])
    selected = F.when(F.col("_imported"), F.col("selected_document_id"))
    state = F.when(selected.isNull(), "INSUFFICIENT").when(F.col("elements_ambiguous") > 0, "PARTIAL").otherwise("AVAILABLE")
    return out.withColumns({
        "availability": state, "source_context_imported": F.col("_imported"), "selected_document_id": selected,
        "elements_with_evidence": F.col("elements_total") - F.col("elements_unmatched")}).drop("_imported")


def evidence_coverage(elements: DataFrame, observations: DataFrame, screenshots: DataFrame) -> DataFrame:
    bound = _state_counts(elements, "binding_state", "n_")
    base = observations.groupBy("session_id").agg(
        F.count("*").alias("observations"), _dimensions().alias("distinct_viewports"),
        F.bool_or(F.col("reference_digest").isNotNull()).alias("source_context_imported"), F.bool_or("include_hidden").alias("hidden_included"),
        F.bool_or("include_colors").alias("colors_included"), F.bool_or("include_text").alias("text_included"))
    out = base.join(bound, "session_id", "left").join(_shots(screenshots, observations), "session_id", "left").fillna(
        0, ["n_total", "n_exact", "n_probable", "n_ambiguous", "n_unmatched", "screenshots"])
    hits = F.col("n_exact") + F.col("n_probable")
    return out.withColumns({
        "source_context_status": F.when(F.col("source_context_imported"), "AVAILABLE").otherwise("INSUFFICIENT"),
        "binding_status": F.when(~F.col("source_context_imported"), "INSUFFICIENT")
        .when((F.col("n_ambiguous") > 0) | ((hits > 0) & (F.col("n_unmatched") > 0)), "PARTIAL").when(hits > 0, "AVAILABLE").otherwise("INSUFFICIENT"),
        "responsive_status": F.when(F.col("distinct_viewports") > 1, "AVAILABLE").otherwise("INSUFFICIENT"),
        "visual_status": F.when(F.col("screenshots") == 0, "INSUFFICIENT").when(F.col("screenshots") == F.col("observations"), "AVAILABLE").otherwise("PARTIAL"),
    })


def coverage_diagnostics(observations: DataFrame, elements: DataFrame, screenshots: DataFrame) -> DataFrame:
    """Up to eleven diagnostics per session with the count each one carries."""
    outside = F.greatest(F.lit(0), F.col("incomplete_total") - F.col("incomplete_in_viewport"))
    facts = observations.groupBy("session_id").agg(
        F.count("*").alias("_n"), _dimensions().alias("_dims"), F.bool_or(F.col("reference_digest").isNotNull()).alias("_context"),
        F.bool_or("include_hidden").alias("_hidden"), F.sum(outside).alias("_outside"), F.count_if(~F.col("has_focus")).alias("_unfocused"),
        F.count_if(off_scroll()).alias("_scroll"), F.count_if(F.col("visibility_state") != "visible").alias("_invisible"),
        F.count_if("prerendering").alias("_prerendering"), F.count_if(admin_state() != "ABSENT").alias("_admin"),
        F.count_if(unresolved_images() > 0).alias("_images"))
    nodes = elements.groupBy("session_id").agg(F.count("*").alias("_nodes"))
    shots = screenshots.groupBy("session_id").agg(F.count("*").alias("_shots"))
    out = facts.join(nodes, "session_id", "left").join(shots, "session_id", "left").fillna(0, ["_nodes", "_shots"])

    def row(fires: Column, code: str, severity: str, scope: str, count: Column) -> Column:
        return F.when(fires, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(scope).alias("scope"),
                                      count.cast("bigint").alias("count")))

    def counted(column: str, code: str, severity: str = "WARNING", scope: str = "OPERATIONAL") -> Column:
        return row(F.col(column) > 0, code, severity, scope, F.col(column))

    rows = F.array_compact(F.array(
        row(~F.col("_context"), "SOURCE_CONTEXT_NOT_IMPORTED", "INFO", "SEMANTIC", F.col("_nodes")),
        row(F.col("_dims") < 2, "SINGLE_VIEWPORT_ONLY", "INFO", "SEMANTIC", F.col("_n")),
        row(F.col("_shots") == 0, "SCREENSHOT_NOT_REQUESTED", "INFO", "SEMANTIC", F.lit(0)),
        row(~F.col("_hidden"), "HIDDEN_ELEMENTS_EXCLUDED", "INFO", "SEMANTIC", F.lit(0)),
        counted("_outside", "INCOMPLETE_IMAGES_OUTSIDE_VIEWPORT", "INFO", "SEMANTIC"), counted("_unfocused", "DOCUMENT_NOT_FOCUSED"),
        counted("_scroll", "PAGE_NOT_AT_CANONICAL_SCROLL"), counted("_invisible", "PAGE_NOT_VISIBLE"),
        counted("_prerendering", "PAGE_PRERENDERING"), counted("_admin", "WORDPRESS_ADMIN_BAR_PRESENT_OR_AMBIGUOUS"),
        counted("_images", "VIEWPORT_IMAGES_NOT_READY")))
    return out.select("session_id", F.explode(rows).alias("d")).select("session_id", "d.*")


def diagnostic_text() -> Column:
    """Canonical text of a diagnostic: context keys in order, an absent failure boundary left out."""
    context = F.map_from_entries(F.array_sort(F.map_entries("context")))
    fields = {"code": F.col("code"), "context": context, "message_key": F.col("message_key"), "scope": F.col("scope"), "severity": F.col("severity")}
    with_boundary = canonical_struct({**fields, "failure_boundary": F.col("failure_boundary")})
    return F.when(F.col("failure_boundary").isNull(), canonical_struct(fields)).otherwise(with_boundary)


def diagnostic_set(diagnostics: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct diagnostics by canonical text."""
    return diagnostics.withColumn("cj1", diagnostic_text()).dropDuplicates([*keys, "cj1"])


def merge_diagnostics(keys: list[str], *groups: DataFrame) -> DataFrame:
    return diagnostic_set(reduce(lambda left, right: left.unionByName(right), groups), keys)


def page_diagnostics(elements: DataFrame, keys: list[str]) -> DataFrame:
    """Identity, text and ambiguity diagnostics of a snapshot from its elements; `text_over_limit` is `over_limit` of `text_shape`."""
    facts = elements.groupBy(*keys).agg(
        F.count_if(F.col("identity_status") == "AMBIGUOUS").alias("_collisions"),
        F.count_if("text_over_limit").alias("_bounded"),
        F.count_if(F.col("binding_state") == "AMBIGUOUS").alias("_ambiguous"),
        F.count_if(F.col("identity_status") != "UNIQUE").alias("_partial"))
    rows = F.array_compact(F.array(*[
        F.when(F.col(c) > 0, F.struct(F.lit(code).alias("code"), F.col(c).alias("count"))) for c, code in (
            ("_collisions", "IDENTITY_COLLISION"), ("_bounded", "TEXT_SHAPE_LIMIT_REACHED"),
            ("_ambiguous", "SOURCE_BINDING_AMBIGUOUS"), ("_partial", "PARTIAL_IDENTITY"))]))
    return facts.select(*keys, F.explode(rows).alias("d")).select(*keys, "d.*")


def observation_set(observations: DataFrame, screenshots: DataFrame) -> DataFrame:
    """One row per observation with its package paths and the header of the set."""
    ordered = ordinal(observations, ["session_id"], ["observation_index", "captured_at", "snapshot_id"],
                      F.floor(F.col("observation_index") / 10_000), "position")
    number = (F.col("position") + 1).cast("string")
    folder = F.concat(F.lit("observations/observation-"), F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number))
    shots = screenshots.select("session_id", "snapshot_id").distinct().withColumn("_shot", F.lit(True))
    out = ordered.join(shots, ["session_id", "snapshot_id"], "left")
    return out.withColumns({
        "snapshot_path": F.concat(folder, F.lit("/snapshot.json")),
        "screenshot_path": F.when(F.col("_shot"), F.concat(folder, F.lit("/screenshot.png"))),
        "artifact_type": F.lit("observation_set"), "schema_version": F.lit("1.1.0"), "canonicalization_profile": F.lit("CJ1"), "hash_algorithm": F.lit("sha256"),
    }).drop("_shot")
