"""Conformance jobs: tables of records in, tables of issues out.

Rules are a list of (path, message, violated-when) compiled on the driver into one projection; a row emits
its violated rules, so a check over any number of rules is a single narrow pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagefacts import fixed
from pagefacts.functions.geometry import is_finite
from pagefacts.functions.patterns import matches, utf16_length

Rule = tuple[str, str, Column]


def issues(frame: DataFrame, rules: Iterable[Rule], keep: list[str]) -> DataFrame:
    """One row per violated rule."""
    fired = [
        F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(path).alias("path"), F.lit(message).alias("message")))
        for path, message, bad in rules
    ]
    return frame.select(*keep, F.explode(F.array_compact(F.array(*fired))).alias("i")).select(*keep, "i.path", "i.message")


# --- catalogue -----------------------------------------------------------------------------------


def context_integrity(source_documents: DataFrame, source_elements: DataFrame, context: DataFrame) -> DataFrame:
    """Repeated documents and keys, elements of unlisted documents, unknown selections."""

    def named(frame: DataFrame, issue: str, subject: Column) -> DataFrame:
        return frame.select("context_id", F.lit(issue).alias("issue"), subject.alias("subject"), "n")

    listed = source_documents.groupBy("context_id", "document_id").agg(F.count("*").alias("n"))
    keys = source_elements.groupBy("context_id", "document_id", "source_element_key").agg(F.count("*").alias("n"))
    foreign = source_elements.groupBy("context_id", "document_id").agg(F.count("*").alias("n")).join(
        listed, ["context_id", "document_id"], "left_anti")
    selected = context.filter("selected_document_id IS NOT NULL").select(
        "context_id", F.col("selected_document_id").alias("document_id"), F.lit(1).cast("bigint").alias("n"))
    unknown = selected.join(listed, ["context_id", "document_id"], "left_anti")
    return (
        named(listed.filter("n > 1"), "DUPLICATE_DOCUMENT", F.col("document_id"))
        .unionByName(named(foreign, "ELEMENT_DOCUMENT_MISMATCH", F.col("document_id")))
        .unionByName(named(keys.filter("n > 1"), "DUPLICATE_SOURCE_ELEMENT_KEY", F.concat("document_id", F.lit(":"), "source_element_key")))
        .unionByName(named(unknown, "UNKNOWN_SELECTION", F.col("document_id")))
    )


def default_selection(source_documents: DataFrame) -> DataFrame:
    """The only document of a context is selected by default; several documents select none."""
    return source_documents.groupBy("context_id").agg(
        F.when(F.count("*") == 1, F.min("document_id")).alias("selected_document_id"))


def context_bounds(source_elements: DataFrame) -> DataFrame:
    c = F.col
    rules: list[Rule] = [
        ("source_element_key", "pattern", ~matches(c("source_element_key"), fixed.DIGEST)),
        ("source_record_sha256", "pattern", ~matches(c("source_record_sha256"), fixed.DIGEST)),
        ("element_id", "pattern", ~matches(c("element_id"), fixed.SAFE_IDENTIFIER)),
        ("parent_element_id", "pattern", ~matches(c("parent_element_id"), fixed.SAFE_IDENTIFIER)),
        ("ancestor_element_ids", "pattern", F.exists("ancestor_element_ids", lambda a: ~matches(a, fixed.SAFE_IDENTIFIER))),
        ("id_occurrence_count", "range", ~c("id_occurrence_count").between(0, 100_000)),
        ("id_uniqueness", "enum", ~c("id_uniqueness").isin(*fixed.ID_UNIQUENESS)),
        ("source_path", "length", utf16_length(c("source_path")) > 2_000),
        ("document_order", "range", c("document_order") < 0),
        ("editor_label", "length", utf16_length(c("editor_label")) > 300),
        *[(name, "required", c(name).isNull()) for name in (
            "document_id", "source_element_key", "source_record_sha256", "id_occurrence_count", "id_uniqueness",
            "source_path", "document_order", "element_kind", "architecture_kind")],
    ]
    return issues(source_elements, rules, ["context_id", "document_id", "record"] if "record" in source_elements.columns else ["context_id", "document_id"])


# --- snapshots -----------------------------------------------------------------------------------


def snapshot_issues(snapshots: DataFrame) -> DataFrame:
    """Header rules of recorded snapshots (one row per snapshot)."""
    c = F.col
    return issues(snapshots, [
        ("status", "enum", ~c("status").isin(*fixed.SNAPSHOT_STATES)),
        ("snapshot_id", "pattern", ~matches(c("snapshot_id"), fixed.UUID)),
        ("observation_index", "range", ~c("observation_index").between(0, 10_000)),
        ("requested_profile", "enum", ~c("requested_profile").isin(*fixed.PROFILES)),
        ("process_state", "enum", ~c("process_state").isin(*fixed.PROCESS_STATES)),
        ("page_fingerprint", "pattern", ~matches(c("page_fingerprint"), fixed.DIGEST)),
        ("inner_width", "finite", ~is_finite(c("inner_width"))),
        ("scroll_y", "finite", ~is_finite(c("scroll_y"))),
        ("elements_emitted", "maximum", c("elements_emitted") > fixed.MAX_EMITTED_ELEMENTS),
        *[(n, "required", c(n).isNull()) for n in ("status", "snapshot_id", "session_id", "observation_index", "process_state")],
    ], ["session_id", "snapshot_id"])


def element_issues(elements: DataFrame, keys: list[str], declared: DataFrame | None = None) -> DataFrame:
    """Element rules of a snapshot: ids, order, unique references, counts.

    Order is contiguous from zero exactly when values are distinct and run from 0 to count-1, so
    aggregations per snapshot are enough and no snapshot is sorted.
    """
    c = F.col
    rows = issues(elements, [
        ("node_id", "pattern", ~matches(c("node_id"), fixed.NODE_ID)),
        ("reference_sha256", "pattern", ~matches(c("reference_sha256"), fixed.DIGEST)),
        ("area", "finite", ~is_finite(c("area"))),
    ], keys).groupBy(*keys, "path", "message").agg(F.count("*").alias("n"))
    # One grouping for each value that has to be distinct: several distinct counts in one aggregation would hold every element several times.
    ordered = elements.groupBy(*keys, "document_order").agg(F.count("*").alias("_n")).groupBy(*keys).agg(
        F.sum("_n").alias("_n"), F.count("document_order").alias("_orders"), F.min("document_order").alias("_low"), F.max("document_order").alias("_high"))
    named = elements.select(*keys, "node_id").distinct().groupBy(*keys).agg(F.count("node_id").alias("_ids"))
    unique = elements.filter("unique_in_document").groupBy(*keys, "reference_sha256").agg(F.count("*").alias("_n")).groupBy(*keys).agg(
        F.count("reference_sha256").alias("_refs"), F.sum("_n").alias("_unique"))
    every = ordered.unionByName(named, allowMissingColumns=True).unionByName(unique, allowMissingColumns=True)
    facts = every.groupBy(*keys).agg(*[F.max(n).alias(n) for n in ("_n", "_orders", "_low", "_high", "_ids", "_refs", "_unique")])
    if declared is not None:
        facts = facts.join(declared, keys, "left")
    else:
        facts = facts.withColumn("elements_emitted", c("_n"))
    whole = issues(facts, [
        ("document_order", "contiguous", (c("_orders") != c("_n")) | (c("_low") != 0) | (c("_high") != c("_n") - 1)),
        ("node_id", "unique", c("_ids") != c("_n")),
        ("stable_reference", "unique", c("_refs") != c("_unique")),
        ("elements_emitted", "agreement", c("elements_emitted") != c("_n")),
    ], keys).withColumn("n", F.lit(1).cast("bigint"))
    return rows.unionByName(whole)


def diagnostic_issues(diagnostics: DataFrame, keep: list[str]) -> DataFrame:
    c = F.col
    return issues(diagnostics, [
        ("code", "enum", ~c("code").isin(*fixed.DIAGNOSTIC_CODES)),
        ("severity", "enum", ~c("severity").isin(*fixed.SEVERITIES)),
        ("scope", "enum", ~c("scope").isin(*fixed.SCOPES)),
        ("message_key", "pattern", ~matches(c("message_key"), fixed.MESSAGE_KEY)),
        ("failure_boundary", "enum", ~c("failure_boundary").isin(*fixed.FAILURE_BOUNDARIES)),
        *[(n, "required", c(n).isNull()) for n in ("code", "severity", "scope", "message_key", "context")],
    ], keep)


# --- contracts -----------------------------------------------------------------------------------
# A contract is a flat mapping path -> rule dict with the keys type, enum, const, pattern, minimum, maximum,
# max_length, required, min_items, max_items, unique_items.  Paths of nested objects are dotted, and a last part `name[]` gives
# the rules of each item of an array.  Objects are closed: keys without a path are unexpected, at every level.

_TYPE_OF = {"string": "STRING", "boolean": "BOOLEAN", "null": "VOID", "array": "ARRAY", "object": "OBJECT"}


def _kind(value: Column) -> Column:
    return F.regexp_replace(F.schema_of_variant(value), r"[(<].*", "")


def _faults(value: Column, rule: dict) -> list[tuple[str, Column]]:
    """(message, violated-when) of a variant that is there."""
    kind, text, number = _kind(value), F.try_variant_get(value, "$", "string"), F.try_variant_get(value, "$", "double")
    found: list[tuple[str, Column]] = []
    wanted = rule.get("type")
    if wanted:
        def fits(name: str) -> Column:
            if name == "integer":
                return (kind == "BIGINT") | ((kind == "DECIMAL") & (number == F.floor(number)))
            return kind.isin("BIGINT", "DECIMAL", "DOUBLE") if name == "number" else kind == _TYPE_OF[name]

        allowed = [fits(name) for name in (wanted if isinstance(wanted, list) else [wanted])]
        found.append(("type", ~F.coalesce(F.greatest(*allowed, F.lit(False)), F.lit(False))))
    if "enum" in rule:
        found.append(("enum", (kind == "STRING") & ~text.isin(*rule["enum"])))
    if "const" in rule:
        same = kind == "VOID" if rule["const"] is None else text == str(rule["const"])
        found.append(("const", ~F.coalesce(same, F.lit(False))))
    if "pattern" in rule:
        found.append(("pattern", (kind == "STRING") & ~matches(text, rule["pattern"])))
    if "max_length" in rule:
        found.append(("max_length", (kind == "STRING") & (utf16_length(text) > rule["max_length"])))
    if "minimum" in rule:
        found.append(("minimum", number < rule["minimum"]))
    if "maximum" in rule:
        found.append(("maximum", number > rule["maximum"]))
    if rule.keys() & {"min_items", "max_items", "unique_items"}:
        items = F.try_variant_get(value, "$", "array<variant>")
        if "min_items" in rule:
            found.append(("min_items", F.size(items) < rule["min_items"]))
        if "max_items" in rule:
            found.append(("max_items", F.size(items) > rule["max_items"]))
        if rule.get("unique_items"):
            texts = F.transform(items, lambda item: F.to_json(item))
            found.append(("unique_items", F.size(F.array_distinct(texts)) < F.size(texts)))
    return found


def _item_fault(rule: dict, message: str) -> Callable[[Column], Column]:
    return lambda item: F.coalesce(dict(_faults(item, rule))[message], F.lit(False))


def _below(parent: str) -> Callable[[Column], Column]:
    return lambda name: F.concat(F.lit(f"{parent}." if parent else ""), name)


def contract_issues(frame: DataFrame, column: str, contract: dict[str, dict], keep: list[str]) -> DataFrame:
    """Issues of JSON records against a contract that is compiled once into one projection.

    The text is parsed once per row into a variant; each rule then reads a typed path of it.
    """
    staged = frame.withColumn("_v", F.try_parse_json(F.col(column)))
    rules: list[Rule] = [("$", "malformed", F.col("_v").isNull())]
    for path, rule in contract.items():
        if path.endswith("[]"):
            items = F.try_variant_get(F.col("_v"), f"$.{path[:-2]}", "array<variant>")
            rules += [(path, message, F.exists(items, _item_fault(rule, message))) for message, _ in _faults(F.col("_v"), rule)]
            continue
        spot = F.try_variant_get(F.col("_v"), f"$.{path}", "variant")
        if rule.get("required"):
            rules.append((path, "required", F.col("_v").isNotNull() & spot.isNull()))
        rules += [(path, message, spot.isNotNull() & bad) for message, bad in _faults(spot, rule)]
    found = issues(staged, rules, keep)
    known: dict[str, set[str]] = {"": set()}
    for path in contract:
        parts = path.removesuffix("[]").split(".")
        for depth in range(len(parts)):
            known.setdefault(".".join(parts[:depth]), set()).add(parts[depth])
    extras = []
    for parent, names in sorted(known.items()):
        keys = F.json_object_keys(F.get_json_object(F.col(column), f"$.{parent}") if parent else F.col(column))
        unknown = F.array_except(keys, F.array(*[F.lit(name) for name in sorted(names)]))
        extras.append(F.coalesce(F.transform(unknown, _below(parent)), F.array().cast("array<string>")))
    extra = staged.filter("_v IS NOT NULL").select(*keep, F.explode(F.concat(*extras)).alias("path"))
    return found.unionByName(extra.withColumn("message", F.lit("unexpected")))


# --- sessions and jobs ---------------------------------------------------------------------------


def exportable(sessions: DataFrame, observations: DataFrame, integrity: DataFrame, checks: DataFrame, purpose: str) -> DataFrame:
    """Why a session cannot be exported.  `integrity` and `checks` come from the session operators."""
    from pagefacts.operators.sessions import purpose_allowed

    facts = observations.groupBy("session_id").agg(F.count("*").alias("_n"), F.bool_or(F.col("process_state") == "ERROR").alias("_error"))
    broken = integrity.groupBy("session_id").agg(*[
        F.bool_or(F.col("issue") == code).alias(f"_{code}") for code in ("ORPHAN_SNAPSHOT", "MISSING_SNAPSHOT", "DUPLICATE_SNAPSHOT", "DUPLICATE_SUMMARY")])
    out = sessions.join(facts, "session_id", "left").join(broken, "session_id", "left").join(checks, "session_id", "left")
    return issues(out, [
        ("snapshots", "NO_SNAPSHOTS", F.col("_n").isNull()),
        ("status", "SESSION_NOT_EXPORTABLE", F.col("status").isin("FAILED", "CAPTURING")),
        ("workflow_mode", "SESSION_WORKFLOW_MODE_MISMATCH", ~purpose_allowed(F.col("workflow_mode"), F.lit(purpose))),
        ("observation_index", "DUPLICATE_OBSERVATION_INDEX", ~F.col("unique")),
        ("observation_index", "NON_CONTIGUOUS_OBSERVATION_INDEX", F.col("unique") & ~F.col("contiguous")),
        ("process_state", "READINESS_ERROR", F.col("_error")),
        *[("captures", code, F.col(f"_{code}")) for code in ("ORPHAN_SNAPSHOT", "MISSING_SNAPSHOT", "DUPLICATE_SNAPSHOT", "DUPLICATE_SUMMARY")],
    ], ["session_id"])


def job_snapshot_issues(jobs: DataFrame, observations: DataFrame) -> DataFrame:
    """Snapshots that disagree with the job that was to produce them.

    `jobs` has job_id, session_id, snapshot_id, captured_at, max_elements, workflow_mode, expected_fingerprint
    and expected_width.
    """
    from pagefacts.operators.sessions import environment_conditions

    renamed = jobs.select("job_id", F.col("session_id").alias("_session"), "snapshot_id", F.col("captured_at").alias("_at"), "max_elements",
                          "workflow_mode", "expected_fingerprint", "expected_width")
    out = renamed.join(observations, "snapshot_id", "left")
    strict = F.coalesce(F.col("workflow_mode") == fixed.STRICT_MODE, F.lit(False))
    spoiled = F.lit(False)
    for bad in environment_conditions().values():
        spoiled = spoiled | bad
    return issues(out, [
        ("snapshot_id", "missing", F.col("session_id").isNull()), ("session_id", "identity", F.col("session_id") != F.col("_session")),
        ("captured_at", "time", F.col("captured_at") != F.col("_at")), ("elements_emitted", "budget", F.col("elements_emitted") > F.col("max_elements")),
        ("page_fingerprint", "changed", strict & (F.col("page_fingerprint") != F.col("expected_fingerprint"))),
        ("inner_width", "changed", strict & (F.col("inner_width") != F.col("expected_width"))),
        ("process_state", "error", F.col("process_state") == "ERROR"), ("environment", "changed", strict & spoiled),
    ], ["job_id"])
