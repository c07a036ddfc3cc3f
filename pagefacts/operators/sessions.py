"""Operators over recorded observations and the sessions they belong to.

Everything per session is an aggregation with map-side partials; lists of offending observations stay rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagefacts import fixed
from pagefacts.functions.patterns import compact, sorted_set
from pagefacts.operators.ranking import ordinal

ADMISSION_CODES = (
    "PAGE_NOT_AT_CANONICAL_SCROLL", "PAGE_NOT_VISIBLE", "PAGE_PRERENDERING", "WORDPRESS_ADMIN_BAR_PRESENT_OR_AMBIGUOUS",
    "ELEMENTOR_EDITOR_PREVIEW_NOT_CANONICAL", "IFRAME_CAPTURE_NOT_CANONICAL", "VIEWPORT_IMAGES_NOT_READY",
)


def admin_state() -> Column:
    """Visible bar is present; class or element alone is ambiguous; a margin alone means nothing."""
    return F.when(F.col("admin_visible"), "PRESENT").when(
        F.col("body_admin_class") | F.col("admin_element"), "AMBIGUOUS").otherwise("ABSENT")


def admin_bar_state(observations: DataFrame) -> DataFrame:
    return observations.withColumn("admin_bar_state", admin_state())


def unresolved_images() -> Column:
    return F.col("img_broken") + F.col("img_pending") + F.col("img_failed") + F.col("img_timed_out")


def off_scroll() -> Column:
    return (F.abs("scroll_x") > fixed.SCROLL_TOLERANCE) | (F.abs("scroll_y") > fixed.SCROLL_TOLERANCE)


def environment_conditions() -> dict[str, Column]:
    """The seven conditions under which an observation is not canonical."""
    return dict(zip(ADMISSION_CODES, (
        off_scroll(), F.col("visibility_state") != "visible", F.col("prerendering"), admin_state() != "ABSENT",
        F.col("editor_preview"), F.col("iframe"), unresolved_images() > 0), strict=True))


def environment_warnings(observations: DataFrame) -> DataFrame:
    """Sorted warning codes; `dialogs` and `aria_modals` are counts of visible ones."""
    codes = compact(
        F.when(admin_state() != "ABSENT", "WORDPRESS_ADMIN_BAR_PRESENT"), F.when(F.col("editor_preview"), "ELEMENTOR_EDITOR_PREVIEW_PRESENT"),
        F.when(F.col("iframe"), "IFRAME_CAPTURE"), F.when(~F.col("has_focus"), "DOCUMENT_NOT_FOCUSED"), F.when(off_scroll(), "PAGE_NOT_AT_TOP"),
        F.when((F.col("dialogs") > 0) | (F.col("aria_modals") > 0), "SEMANTIC_DIALOG_EVIDENCE_PRESENT"),
        F.when(F.col("animations") > 0, "ACTIVE_ANIMATIONS_PRESENT"), F.when(F.col("incomplete_in_viewport") > 0, "IMAGES_IN_VIEWPORT_INCOMPLETE"))
    return observations.withColumn("warning_codes", sorted_set(codes))


def modal_counts(nodes: DataFrame, visible: Column) -> DataFrame:
    """Open dialogs, aria modals and their union with role=dialog, visible ones only."""
    dialog = (F.col("tag") == "dialog") & F.map_contains_key("attrs", "open")
    modal = F.coalesce(F.col("attrs")["aria-modal"] == "true", F.lit(False))
    role = F.coalesce(F.col("attrs")["role"] == "dialog", F.lit(False))
    return nodes.groupBy("page_id").agg(
        F.count_if(visible & dialog).alias("dialogs"), F.count_if(visible & modal).alias("aria_modals"),
        F.count_if(visible & (dialog | modal | role)).alias("modal_count"))


def client_facts(agent: Column) -> dict[str, Column]:
    found = [(name, F.regexp_extract(agent, pattern, 1)) for name, pattern in fixed.CLIENT_FAMILIES]
    lowered = F.lower(agent)
    return {
        "family": F.coalesce(*[F.when(version != "", name) for name, version in found], F.lit("Unknown")),
        "version": F.coalesce(*[F.when(version != "", version) for _, version in found]),
        "platform": F.coalesce(*[F.when(lowered.rlike(p), name) for name, p in fixed.CLIENT_PLATFORMS], F.lit("UNKNOWN")),
    }


def client_mix(observations: DataFrame) -> DataFrame:
    facts = observations.select(*[c.alias(n) for n, c in client_facts(F.col("user_agent")).items()])
    return facts.groupBy("family", "version", "platform").agg(F.count("*").alias("n"))


# --- order and integrity -------------------------------------------------------------------------


def index_check(observations: DataFrame) -> DataFrame:
    """Whether indexes are unique and run from zero without a gap.  No sort: count, distinct, lowest, highest."""
    index = F.col("observation_index")
    out = observations.groupBy("session_id").agg(
        F.count("*").alias("_n"), F.countDistinct(index).alias("_d"), F.min(index).alias("_low"), F.max(index).alias("_high"))
    unique = F.col("_d") == F.col("_n")
    return out.select("session_id", unique.alias("unique"),
                      (unique & (F.col("_low") == 0) & (F.col("_high") == F.col("_n") - 1)).alias("contiguous"))


def observation_order(observations: DataFrame) -> DataFrame:
    bucket = F.floor(F.col("observation_index") / 10_000)
    return ordinal(observations, ["session_id"], ["observation_index", "captured_at", "snapshot_id"], bucket, "position")


def latest_capture(capture_summaries: DataFrame) -> DataFrame:
    return capture_summaries.groupBy("session_id").agg(
        F.count("*").alias("capture_count"), F.max(F.struct("captured_at", "snapshot_id", "status")).alias("_last")).select(
        "session_id", "capture_count", F.col("_last.snapshot_id").alias("snapshot_id"), F.col("_last.captured_at").alias("captured_at"),
        F.col("_last.status").alias("status"))


def observation_integrity(observations: DataFrame, capture_summaries: DataFrame) -> DataFrame:
    """Snapshots without a summary, summaries without a snapshot, and repeats on either side."""
    keys = ["session_id", "snapshot_id"]
    left = observations.groupBy(*keys).agg(F.count("*").alias("n_snapshots"))
    right = capture_summaries.groupBy(*keys).agg(F.count("*").alias("n_summaries"))
    both = left.join(right, keys, "full_outer")
    found = compact(
        F.when(F.col("n_summaries").isNull(), "ORPHAN_SNAPSHOT"), F.when(F.col("n_snapshots").isNull(), "MISSING_SNAPSHOT"),
        F.when(F.col("n_snapshots") > 1, "DUPLICATE_SNAPSHOT"), F.when(F.col("n_summaries") > 1, "DUPLICATE_SUMMARY"))
    return both.select(*keys, F.explode(found).alias("issue"))


def screenshot_match(observations: DataFrame, screenshots: DataFrame) -> DataFrame:
    """Requested against available, and screenshots that repeat or belong elsewhere."""
    keys = ["session_id", "snapshot_id"]
    shots = screenshots.groupBy(*keys).agg(F.count("*").alias("n_shots"))
    out = observations.select(*keys, "screenshot_requested").join(shots, keys, "full_outer")
    issue = F.when(F.col("screenshot_requested").isNull(), "FOREIGN_SCREENSHOT").when(F.col("n_shots") > 1, "DUPLICATE_SCREENSHOT")
    return out.select(*keys, F.coalesce("screenshot_requested", F.lit(False)).alias("requested"), F.col("n_shots").isNotNull().alias("available"),
                      issue.alias("issue"))


def reference_match(observations: DataFrame, sessions: DataFrame) -> DataFrame:
    """Whether every observation carries the context reference of its session."""
    own = sessions.select("session_id", F.col("reference_digest").alias("_session_reference"))
    return observations.join(own, "session_id").withColumn(
        "consistent", F.col("reference_digest").eqNullSafe(F.col("_session_reference"))).drop("_session_reference")


def missing_profiles(observations: DataFrame) -> DataFrame:
    required = F.array(*[F.lit(p) for p in fixed.REQUIRED_PROFILES])
    return observations.groupBy("session_id").agg(F.collect_set("requested_profile").alias("_seen")).select(
        "session_id", F.array_sort("_seen").alias("present"), F.array_except(required, "_seen").alias("missing"))


# --- context, policy, legacy ---------------------------------------------------------------------


def effective_mode(mode: Column, capture_count: Column) -> Column:
    return F.coalesce(mode, F.when(capture_count > 0, fixed.PLAIN_MODE))


def purpose_allowed(mode: Column, purpose: Column) -> Column:
    """One way only: strict sessions may leave as plain evidence, never the reverse."""
    return (purpose == fixed.PLAIN_MODE) | F.coalesce(mode == fixed.STRICT_MODE, F.lit(False))


def export_policy(sessions: DataFrame, purpose: Column) -> DataFrame:
    """`sessions` carries capture_count and blocking_count (runtime blockers)."""
    mode = F.col("workflow_mode")
    return sessions.withColumns({
        "effective_mode": effective_mode(mode, F.col("capture_count")), "allowed": purpose_allowed(mode, purpose),
        "fallback": F.coalesce((mode == fixed.STRICT_MODE) & (purpose == fixed.STRICT_MODE) & (F.col("blocking_count") == 0), F.lit(False)),
    })


def adopt_context(sessions: DataFrame, reference: DataFrame) -> DataFrame:
    """Sessions that are created and still empty take the new reference offered to them."""
    offered = reference.select("session_id", *[F.col(c).alias(f"_{c}") for c in ("reference_digest", "selected_document_id", "confirmation_state")],
                               F.lit(True).alias("_offered"))
    out = sessions.join(offered, "session_id", "left")
    takes = F.coalesce(F.col("_offered") & (F.col("status") == "CREATED") & (F.col("capture_count") == 0), F.lit(False))
    confirmed = F.col("_selected_document_id").isNotNull() & F.coalesce(F.col("_confirmation_state") == "CONFIRMED", F.lit(False))
    return out.withColumns({
        "adopted": takes,
        "reference_digest": F.when(takes, F.col("_reference_digest")).otherwise(F.col("reference_digest")),
        "binding_state": F.when(takes, F.when(confirmed, "PROBABLE").otherwise("UNMATCHED")).otherwise(F.col("binding_state")),
    }).drop("_reference_digest", "_selected_document_id", "_confirmation_state", "_offered")


def capture_profile(config: DataFrame) -> DataFrame:
    def of(limits: tuple[int, int]) -> Column:
        return (F.col("max_elements") == limits[0]) & (F.col("max_depth") == limits[1])

    return config.withColumn("profile", F.when(of(fixed.STANDARD_LIMITS), "STANDARD").when(of(fixed.DEEP_LIMITS), "DEEP_DOM").otherwise("CUSTOM"))


def session_listing(sessions: DataFrame, capture_summaries: DataFrame) -> DataFrame:
    """Light listing of readable sessions; order by created_at desc, session_id when shown."""
    last = latest_capture(capture_summaries).select("session_id", "capture_count", F.col("snapshot_id").alias("latest_snapshot_id"))
    readable = sessions.filter("session_id IS NOT NULL AND created_at IS NOT NULL AND status IS NOT NULL")
    return readable.select("session_id", "name", "created_at", "status", "workflow_mode").join(last, "session_id", "left").withColumn(
        "capture_count", F.coalesce("capture_count", F.lit(0)))


def corrupt_sessions(sessions: DataFrame) -> DataFrame:
    return sessions.agg(F.count_if(F.col("session_id").isNull() | F.col("created_at").isNull() | F.col("status").isNull()).alias("corrupt_count"))


def upgrade_legacy(frame: DataFrame, kind: str) -> DataFrame:
    """Fill what older versions did not store; nothing is invented beyond the published defaults."""
    if kind == "sessions":
        return frame.withColumn("schema_version", F.when(F.col("schema_version") == "1.0.0", "1.1.0").otherwise(F.col("schema_version")))
    if kind == "jobs":
        return frame.withColumns({"workflow_mode": F.coalesce("workflow_mode", F.lit(fixed.PLAIN_MODE)),
                                  "captured_at": F.coalesce("captured_at", "created_at")})
    verified = F.coalesce(F.col("sha256").rlike(fixed.HEX64.replace("$", r"\z")), F.lit(False))
    return frame.withColumns({
        "byte_length": F.coalesce("byte_length", F.octet_length("data")),
        "sha256": F.when(verified, F.col("sha256")).otherwise(fixed.LEGACY_CHUNK_HASH),
        "integrity_status": F.when(verified, "VERIFIED").otherwise("LEGACY_UNVERIFIED"),
    })


# --- admission and readiness ---------------------------------------------------------------------


def admission_audit(observations: DataFrame, sessions: DataFrame) -> DataFrame:
    """Each attempt against all earlier ones of its session (batch audit).

    "Seen before" is `index > first index of that value`, so values are aggregated and joined back instead of
    collecting everything that precedes a row.
    """
    at = F.struct("observation_index", "snapshot_id")
    rows = observations.withColumn("_at", at)

    def first_of(column: str, name: str) -> DataFrame:
        return rows.groupBy("session_id", column).agg(F.min("_at").alias(name))

    prints = first_of("page_fingerprint", "_first")
    leader = prints.groupBy("session_id").agg(F.min(F.struct("_first", "page_fingerprint")).alias("_lead"))
    second = prints.join(leader, "session_id").filter(F.col("page_fingerprint") != F.col("_lead.page_fingerprint")).groupBy(
        "session_id").agg(F.min("_first").alias("_second"))
    order = leader.join(second, "session_id", "left")
    own = sessions.select("session_id", F.col("reference_digest").alias("_reference"), "selected_document_id", "confirmation_state", "context_known")
    out = (
        rows.join(first_of("inner_width", "_width_at"), ["session_id", "inner_width"])
        .join(first_of("requested_profile", "_profile_at"), ["session_id", "requested_profile"])
        .join(order, "session_id").join(own, "session_id")
    )
    mismatched = out.withColumn("_odd", ~F.col("reference_digest").eqNullSafe(F.col("_reference"))).filter("_odd").groupBy("session_id").agg(
        F.min("_at").alias("_odd_at"))
    out = out.join(mismatched, "session_id", "left")
    other_at = F.when(F.col("page_fingerprint") == F.col("_lead.page_fingerprint"), F.col("_second")).otherwise(F.col("_lead._first"))
    required = F.col("_reference").isNull() | ~F.coalesce(F.col("context_known"), F.lit(False))
    unfit = F.col("selected_document_id").isNull() | F.coalesce(F.col("confirmation_state") != "CONFIRMED", F.lit(True))
    earlier_odd = F.col("_reference").isNotNull() & F.coalesce(F.col("_odd_at") < F.col("_at"), F.lit(False))
    codes = compact(
        F.when(required, "SOURCE_CONTEXT_REQUIRED"), F.when((~required & unfit) | earlier_odd, "SOURCE_CONTEXT_INCOMPATIBLE"),
        F.when(~F.col("requested_profile").isin(*fixed.REQUIRED_PROFILES), "REQUIRED_VIEWPORT_PROFILE_MISSING"),
        F.when(F.col("_profile_at") < F.col("_at"), "REQUIRED_PROFILE_ALREADY_CAPTURED"),
        F.when(F.col("_width_at") < F.col("_at"), "DUPLICATE_MEASURED_VIEWPORT"),
        F.when(other_at < F.col("_at"), "PAGE_FINGERPRINT_MISMATCH"),
        *[F.when(bad, code) for code, bad in environment_conditions().items()])
    return out.select("session_id", "snapshot_id", "observation_index", F.array_sort(codes).alias("codes")).withColumn(
        "allowed", F.size("codes") == 0)


def readiness_verdict(samples: DataFrame, timeout_ms: float = fixed.READINESS_TIMEOUT_MS, rows_per_bucket: int = 10_000) -> DataFrame:
    """First run of three stable samples within the timeout, else TIMEOUT, UNSTABLE or ERROR.

    Only the three samples before a row matter, so each bucket of samples also gets the last three of the
    bucket before it and no capture is sorted as a whole.
    """
    limit = float(min(max(int(timeout_ms), 0), fixed.MAX_READINESS_TIMEOUT_MS))
    own = F.floor(F.col("sample_no") / rows_per_bucket)
    spill = F.col("sample_no") % rows_per_bucket >= rows_per_bucket - fixed.STABLE_SAMPLES
    copies = samples.withColumn("_own", own).withColumn(
        "_bucket", F.explode(F.when(spill, F.array(own, own + 1)).otherwise(F.array(own))))
    w = Window.partitionBy("capture_id", "_bucket").orderBy("sample_no")
    sides = ("doc_w", "doc_h", "view_w", "view_h")
    same = F.lit(True)
    for side in sides:
        same = same & (F.lag(side).over(w) == F.col(side))
    bad = F.lit(False)
    for side in sides:
        bad = bad | F.isnan(side)
    ready = (F.col("ready_state") == "complete") & F.col("fonts_loaded") & (F.col("unresolved_images") == 0)
    flagged = copies.withColumns({
        "_seen": (F.col("sample_no") == 0) | F.coalesce(F.lag("elapsed_ms").over(w) < limit, F.lit(False)), "_bad": bad,
        "_ok": F.coalesce(same & ready, F.lit(False))})
    run = F.col("_ok")
    for back in range(1, fixed.STABLE_SAMPLES):
        run = run & F.coalesce(F.lag("_ok", back).over(w), F.lit(False))
    rows = flagged.withColumn("_run", run & F.col("_seen")).filter("_own = _bucket AND _seen")
    row = F.struct("sample_no", "elapsed_ms", "doc_w", "doc_h")
    out = rows.groupBy("capture_id").agg(
        F.min(F.when(F.col("_run"), row)).alias("_stop"), F.max(row).alias("_last"), F.min(row).alias("_first"),
        F.min(F.when(F.col("_bad"), F.col("sample_no"))).alias("_bad_at"))
    end = F.coalesce("_stop", "_last")
    failed = F.coalesce(F.col("_bad_at") <= end["sample_no"], F.lit(False))
    timed_out = F.col("_stop").isNull() & (F.col("_last.elapsed_ms") >= limit)
    state = F.when(failed, "ERROR").when(F.col("_stop").isNotNull(), "STABLE").when(timed_out, "TIMEOUT").otherwise("UNSTABLE")
    return out.select(
        "capture_id", state.alias("process_state"),
        F.when(failed, "ERROR").when(timed_out, "PARTIAL").otherwise("AVAILABLE").alias("availability"),
        (F.when(failed, F.col("_bad_at")).otherwise(end["sample_no"]) + 1).alias("sample_count"),
        F.when(failed, F.lit(None)).otherwise(end["elapsed_ms"]).alias("settle_duration_ms"),
        F.col("_first.doc_w").alias("initial_document_width"), F.when(~failed, end["doc_w"]).alias("final_document_width"))


def image_readiness(images: DataFrame) -> DataFrame:
    """Tallies over image rows: complete, natural_width, decode_failed, timed_out."""
    loaded, broken = F.col("complete") & (F.col("natural_width") > 0), F.col("complete") & (F.col("natural_width") == 0)
    rest = ~F.col("complete")
    out = images.groupBy("session_id").agg(
        F.count("*").alias("candidates"), F.count_if(loaded).alias("loaded"), F.count_if(broken).alias("broken"),
        F.count_if(rest & F.col("decode_failed")).alias("decode_failed"),
        F.count_if(rest & ~F.col("decode_failed") & F.col("timed_out")).alias("timed_out"),
        F.count_if(rest & ~F.col("decode_failed") & ~F.col("timed_out")).alias("pending"))
    return out.withColumn("unresolved", F.col("broken") + F.col("pending") + F.col("decode_failed") + F.col("timed_out"))


# --- roll-ups ------------------------------------------------------------------------------------


def merge_sessions(sessions: DataFrame, capture_summaries: DataFrame, observations: DataFrame) -> DataFrame:
    """Sessions after their captures: complete only when all are, latest environment wins, and so does the strongest page binding."""
    once = capture_summaries.groupBy("session_id", "snapshot_id").agg(F.max(F.struct("captured_at", "status")).alias("_s"))
    merged = once.groupBy("session_id").agg(
        F.count("*").alias("capture_count"), F.bool_and(F.col("_s.status") == "COMPLETE").alias("_all"), F.max("_s.captured_at").alias("last_captured_at"))
    strength = F.array_position(F.array(*[F.lit(s) for s in ("UNMATCHED", "AMBIGUOUS", "PROBABLE", "EXACT")]), F.col("page_binding_state"))
    newest = observations.groupBy("session_id").agg(
        F.max(F.struct("captured_at", "snapshot_id", "user_agent", "reference_digest")).alias("_o"), F.max_by("page_binding_state", strength).alias("_strongest"))
    out = sessions.select("session_id", "status").join(merged, "session_id", "left").join(newest, "session_id", "left")
    facts = client_facts(F.col("_o.user_agent"))
    return out.select(
        "session_id", F.when(F.col("_all").isNull(), F.col("status")).when(F.col("_all"), "COMPLETE").otherwise("PARTIAL").alias("status"),
        F.coalesce("capture_count", F.lit(0)).alias("capture_count"), "last_captured_at",
        F.when(F.col("_o").isNotNull(), facts["family"]).alias("browser_family"), F.when(F.col("_o").isNotNull(), facts["version"]).alias("browser_version"),
        F.coalesce("_strongest", F.lit("UNMATCHED")).alias("source_binding_state"), F.col("_o.reference_digest").alias("reference_digest"))


def capture_summaries(observations: DataFrame, elements: DataFrame, screenshots: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """One summary row per observation.  An element overflows by itself or by leaving a clipping ancestor."""
    states = [F.count_if(F.col("binding_state") == s).alias(f"n_{s.lower()}") for s in fixed.BINDING_STATES]
    rolled = elements.groupBy("snapshot_id").agg(F.count("*").alias("element_count"), F.count_if(F.col("overflowing") | F.col("clipped")).alias("overflow_count"), *states)
    shots = screenshots.select("snapshot_id").distinct().withColumn("_shot", F.lit(True))
    said = diagnostics.groupBy("snapshot_id").agg(F.count("*").alias("diagnostic_count"))
    out = observations.join(rolled, "snapshot_id", "left").join(shots, "snapshot_id", "left").join(said, "snapshot_id", "left")
    counts = ["element_count", "overflow_count", "diagnostic_count", *[f"n_{s.lower()}" for s in fixed.BINDING_STATES]]
    return out.select(
        "session_id", "snapshot_id", "captured_at", "inner_width", "inner_height", "page_fingerprint", "page_binding_state",
        F.col("truncated").alias("truncated_branch_count"), *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
        F.col("_shot").isNotNull().alias("screenshot_available"), F.col("completeness").alias("completeness_status"), "reasons",
        F.when(F.col("status") == "AVAILABLE", "COMPLETE").otherwise("PARTIAL").alias("status"))


def semantic_completeness(diagnostics: DataFrame) -> DataFrame:
    out = diagnostics.groupBy("session_id").agg(F.array_sort(F.collect_set(F.when(F.col("scope") == "SEMANTIC", F.col("code")))).alias("reasons"))
    return out.withColumn("status", F.when(F.size("reasons") == 0, "COMPLETE").otherwise("PARTIAL"))


def feed_offenders(observations: DataFrame) -> DataFrame:
    """Observations that break a readiness rule, one row per rule."""
    hits = compact(*[F.when(bad, code) for code, bad in environment_conditions().items()
                     if code not in ("ELEMENTOR_EDITOR_PREVIEW_NOT_CANONICAL", "IFRAME_CAPTURE_NOT_CANONICAL")])
    return observations.select("session_id", "observation_index", F.explode(hits).alias("code"))


def context_match(sessions: DataFrame, imported: DataFrame) -> DataFrame:
    """Add `context_known` and `context_matches`: the reference of a session against the imported catalogue.

    `imported` has one row per catalogue document.
    """
    heads = imported.groupBy("context_id").agg(*[F.min(c).alias(f"_{c}") for c in ("imported_sha256", "export_root_sha256", "site_fingerprint")])
    listed = imported.select("context_id", F.col("document_id").alias("selected_document_id"), F.col("document_fingerprint").alias("_doc_fp"))
    out = sessions.join(heads, "context_id", "left").join(listed, ["context_id", "selected_document_id"], "left")
    same = F.lit(True)
    for name in ("imported_sha256", "export_root_sha256", "site_fingerprint"):
        same = same & (F.col(name) == F.col(f"_{name}"))
    same = same & (F.col("selected_document_fingerprint") == F.col("_doc_fp"))
    return out.withColumns({
        "context_known": F.col("_imported_sha256").isNotNull(), "context_matches": F.coalesce(same, F.lit(False)),
    }).drop("_imported_sha256", "_export_root_sha256", "_site_fingerprint", "_doc_fp")


def feed_readiness(sessions: DataFrame, observations: DataFrame, imported: DataFrame) -> DataFrame:
    """State, blocking codes and tallies of every session."""
    index = F.col("observation_index")
    environment = environment_conditions()
    # Counted per reference before the sessions are joined, so no observation is shuffled for that; each value to be distinct has its own grouping.
    counted = observations.groupBy("session_id", "reference_digest").agg(
        F.count("*").alias("n"), F.min(index).alias("_low"), F.max(index).alias("_high"), F.array_sort(F.collect_set("requested_profile")).alias("_profiles"),
        F.min("page_fingerprint").alias("_first_page"), F.max("page_fingerprint").alias("_last_page"),
        F.bool_or(F.col("process_state") == "ERROR").alias("_error"), *[F.count_if(bad).alias(f"_{code}") for code, bad in environment.items()])
    facts = reference_match(counted, sessions).groupBy("session_id").agg(
        F.sum("n").alias("n"), F.min("_low").alias("_low"), F.max("_high").alias("_high"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("_profiles")))).alias("_profiles"),
        (F.min("_first_page") == F.max("_last_page")).alias("_same_page"), F.bool_and("consistent").alias("_same_reference"),
        F.bool_or("_error").alias("_error"), *[F.sum(f"_{code}").alias(f"_{code}") for code in environment])
    for name, value in (("_d", index), ("_widths", F.col("inner_width"))):
        facts = facts.join(observations.groupBy("session_id").agg(F.countDistinct(value).alias(name)), "session_id")
    out = context_match(sessions, imported).join(facts, "session_id", "left")
    n = F.coalesce("n", F.lit(0))
    profiles = F.coalesce("_profiles", F.array().cast("array<string>"))
    missing = F.array_except(F.array(*[F.lit(p) for p in fixed.REQUIRED_PROFILES]), profiles)
    present = F.col("context_known") & F.col("reference_digest").isNotNull()
    confirmed = F.coalesce(F.col("confirmation_state") == "CONFIRMED", F.lit(False)) & F.col("selected_document_id").isNotNull() & F.col(
        "selected_document_fingerprint").isNotNull()
    bad_index = (n > 0) & ((F.col("_d") != n) | (F.col("_low") != 0) | (F.col("_high") != n - 1))
    fires = {code: F.coalesce(F.col(f"_{code}"), F.lit(0)) for code in environment}
    codes = F.array_sort(F.array_distinct(compact(
        F.when(~present, "SOURCE_CONTEXT_REQUIRED"), F.when(present & (~confirmed | ~F.col("context_matches")), "SOURCE_CONTEXT_INCOMPATIBLE"),
        F.when(bad_index, "OBSERVATION_INDEX_INVALID"), F.when(n < 3, "INSUFFICIENT_RUNTIME_OBSERVATIONS"),
        F.when(F.coalesce("_widths", F.lit(0)) < 3, "INSUFFICIENT_DISTINCT_VIEWPORTS"), F.when(F.size(missing) > 0, "REQUIRED_VIEWPORT_PROFILE_MISSING"),
        F.when(~F.col("_same_page"), "PAGE_FINGERPRINT_MISMATCH"), F.when(~F.col("_same_reference"), "SOURCE_CONTEXT_REFERENCE_MISMATCH"),
        F.when(F.col("_error"), "READINESS_ERROR"), *[F.when(fires[code] > 0, code) for code in environment])))
    out = out.withColumns({"blocking_codes": codes, "missing_profiles": missing, "profiles": profiles, "n": n})
    invalid = F.arrays_overlap("blocking_codes", F.array(*[F.lit(c) for c in fixed.INVALID_READINESS_CODES]))
    state = F.when(F.size("blocking_codes") == 0, "READY").when(invalid, "INVALID").otherwise("INSUFFICIENT_EVIDENCE")
    return out.select(
        "session_id", state.alias("state"), "blocking_codes", F.col("n").alias("observation_count"),
        F.coalesce("_widths", F.lit(0)).alias("distinct_viewport_widths"), "profiles", "missing_profiles",
        F.coalesce("_same_page", F.lit(True)).alias("page_fingerprint_consistent"),
        *[fires[code].alias(f"n_{short}") for code, short in zip(ADMISSION_CODES, ("scroll", "hidden", "prerendering", "admin_bar", "preview", "iframe", "images"), strict=True)])


def export_preflight(sessions: DataFrame, observations: DataFrame, screenshots: DataFrame, imported: DataFrame, usage: DataFrame, purpose: str) -> DataFrame:
    """Blockers, warnings and tallies before an export, for every session."""
    feed = feed_readiness(sessions, observations, imported).select("session_id", F.col("state").alias("feed_state"), "blocking_codes")
    facts = observations.groupBy("session_id").agg(
        F.count("*").alias("n"), F.countDistinct(F.struct("inner_width", "inner_height")).alias("_dims"),
        F.bool_or(F.col("process_state") == "ERROR").alias("_error"), F.bool_or("include_hidden").alias("_hidden"),
        F.sum("incomplete_total").alias("incomplete_images_total"))
    shots = screenshots.groupBy("session_id").agg(F.count("*").alias("n_screenshots"))
    out = (sessions.join(feed, "session_id").join(facts, "session_id", "left").join(shots, "session_id", "left")
           .join(usage.select("session_id", "total_bytes"), "session_id", "left"))
    n = F.coalesce("n", F.lit(0))
    allowed = purpose_allowed(F.col("workflow_mode"), F.lit(purpose))
    runtime = compact(
        F.when(n == 0, "NO_RUNTIME_OBSERVATIONS"), F.when(F.col("status") == "CAPTURING", "SESSION_CAPTURE_IN_PROGRESS"),
        F.when(F.col("status") == "FAILED", "SESSION_FAILED"), F.when(~allowed, "SESSION_WORKFLOW_MODE_MISMATCH"),
        F.when(F.coalesce("total_bytes", F.lit(0)) > fixed.MAX_SESSION_BYTES, "STORAGE_QUOTA_EXCEEDED"), F.when(F.col("_error"), "READINESS_ERROR"))
    out = out.withColumn("_runtime", runtime)
    every = F.array_distinct(F.concat("_runtime", "blocking_codes")) if purpose == fixed.STRICT_MODE else F.col("_runtime")
    warnings = compact(
        F.when(F.col("reference_digest").isNull(), "SOURCE_CONTEXT_NOT_IMPORTED"), F.when(F.coalesce("_dims", F.lit(0)) < 2, "SINGLE_VIEWPORT_ONLY"),
        F.when(F.col("n_screenshots").isNull(), "SCREENSHOT_NOT_REQUESTED"), F.when(~F.coalesce("_hidden", F.lit(False)), "HIDDEN_ELEMENTS_EXCLUDED"),
        F.when(F.coalesce("incomplete_images_total", F.lit(0)) > 0, "INCOMPLETE_IMAGES_OBSERVED"))
    fallback = F.coalesce((F.col("workflow_mode") == fixed.STRICT_MODE) & (F.size("_runtime") == 0), F.lit(False)) & F.lit(purpose == fixed.STRICT_MODE)
    return out.select("session_id", n.alias("observations"), F.array_sort(every).alias("blockers"), F.array_sort(warnings).alias("warnings"),
                      "feed_state", fallback.alias("fallback"))


def resource_usage(snapshot_bytes: DataFrame, screenshots: DataFrame) -> DataFrame:
    """Bytes per session against the limit, and whether one more capture would fit."""
    shots = screenshots.groupBy("session_id", "snapshot_id").agg(F.max("n_bytes").alias("_shot"))
    rows = snapshot_bytes.join(shots, ["session_id", "snapshot_id"], "left")
    out = rows.groupBy("session_id").agg(
        F.sum("n_bytes").alias("snapshot_bytes"), F.coalesce(F.sum("_shot"), F.lit(0)).alias("screenshot_bytes"), F.count("*").alias("capture_count"))
    total = F.col("snapshot_bytes") + F.col("screenshot_bytes")
    projected = total + fixed.MAX_SNAPSHOT_BYTES + fixed.MAX_SCREENSHOT_BYTES
    return out.withColumns({
        "total_bytes": total, "exportable": total <= fixed.MAX_SESSION_BYTES,
        "admissible": (projected <= fixed.MAX_SESSION_BYTES) & (F.col("capture_count") < fixed.MAX_SESSION_CAPTURES)})
