"""Operators over the table of pages: capturability, locators, display facts, fingerprints, page binding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagefacts import fixed
from pagefacts.functions import urls
from pagefacts.functions.digests import canonical_struct, digest
from pagefacts.functions.patterns import compact
from pagefacts.functions.redaction import plain_label, stable_id


def _with_parts(pages: DataFrame) -> DataFrame:
    """Add the split address as hidden columns, one projection per stage so no pattern runs twice."""
    staged = pages.withColumn("_text", urls.cleaned(F.col("url")))
    parts = urls.address_parts(F.col("_text"))
    staged = staged.withColumns({f"_{name}": part for name, part in parts.items()})
    staged = staged.withColumn("_ascii", urls.ascii_host(F.col("_host")))
    reject = urls.reject_reason(*[F.col(c) for c in ("url", "_text", "_userinfo", "_host", "_ascii", "_port")])
    staged = staged.withColumn("_reject", reject)
    staged = staged.withColumn("_path", urls.encode_path(F.col("_path")))
    return staged.withColumn("_path", urls.drop_dot_segments(F.col("_path")))


def _drop_hidden(frame: DataFrame) -> DataFrame:
    return frame.drop(*[c for c in frame.columns if c.startswith("_")])


def read_pages(pages: DataFrame) -> DataFrame:
    """Pages with the reason why one cannot be captured (null when it can)."""
    staged = _with_parts(pages)
    host = F.col("_ascii")
    store = host.isin(*fixed.STORE_HOSTS) | F.endswith(host, F.lit(fixed.STORE_HOST_SUFFIX))
    invalid = F.col("_reject").isin("URL_INVALID", "PORT_INVALID") | (F.length("url") == 0)
    reason = (
        F.when(F.col("_reject") == "UNSUPPORTED_SCHEME", "UNSUPPORTED_SCHEME")
        .when(F.coalesce(invalid, F.lit(False)), "URL_INVALID")
        .when(store, "STORE_PAGE")
    )
    return _drop_hidden(staged.withColumn("reject_reason", reason))


def page_locators(pages: DataFrame, scope: str | Column = "/") -> DataFrame:
    """Locator facts, redaction count and reject reason for every page."""
    staged = _with_parts(pages).withColumn("_segments", urls.redact_segments(F.col("_path")))
    ok = F.col("_reject").isNull()
    wanted = scope if isinstance(scope, Column) else F.lit(scope)
    out = staged.withColumns(
        {
            "scheme": F.when(ok, F.col("_scheme")),
            "host": F.when(ok, F.col("_ascii")),
            "port": F.when(ok, urls.written_port(F.col("_scheme"), F.col("_port"))),
            "path": F.when(ok, urls.join_segments(F.col("_segments"))),
            "scope": F.when(ok, urls.normal_scope(wanted)),
            "redacted_segment_count": F.when(ok, urls.hidden_count(F.col("_segments"))),
            "reject": F.col("_reject"),
        }
    )
    return _drop_hidden(out)


def normalize_paths(pages: DataFrame, scope: str | Column = "/") -> DataFrame:
    located = page_locators(pages, scope)
    return located.drop("scheme", "host", "port", "reject", "redacted_segment_count")


def redact_path_segments(pages: DataFrame) -> DataFrame:
    return page_locators(pages).drop("scheme", "host", "port", "scope", "reject")


def with_locator_digest(located: DataFrame) -> DataFrame:
    facts = [F.col(c) for c in ("scheme", "host", "port", "path", "scope")]
    return located.withColumn("locator_sha256", F.when(F.col("reject").isNull(), urls.locator_digest(*facts)))


def locator_groups(pages: DataFrame, scope: str = "/") -> DataFrame:
    """One row per locator.  Page ids stay rows of their own table, so a hot locator is only counted here."""
    keyed = with_locator_digest(page_locators(pages, scope)).filter("reject IS NULL")
    return keyed.groupBy("locator_sha256").agg(
        F.count("*").alias("n_pages"),
        F.min("page_id").alias("first_page_id"),
        F.max("page_id").alias("last_page_id"),
    )


def duplicate_locator_pages(pages: DataFrame, scope: str = "/") -> DataFrame:
    """The pages behind every locator that occurs more than once."""
    keyed = with_locator_digest(page_locators(pages, scope)).filter("reject IS NULL").select("page_id", "locator_sha256")
    repeated = keyed.groupBy("locator_sha256").count().filter("count > 1").select("locator_sha256")
    return keyed.join(repeated, "locator_sha256", "left_semi")


def display_paths(pages: DataFrame) -> DataFrame:
    staged = _with_parts(pages)
    port = urls.written_port(F.col("_scheme"), F.col("_port"))
    origin = F.concat(F.col("_scheme"), F.lit("://"), F.col("_ascii"),
                      F.coalesce(F.concat(F.lit(":"), port.cast("string")), F.lit("")))
    ok = F.col("_reject").isNull() | (F.col("_reject") == "CREDENTIALS_REJECTED")
    out = staged.withColumns(
        {"origin": F.when(ok, origin), "display_path": F.when(ok, urls.display_path(F.col("_path")))})
    return _drop_hidden(out)


def page_ids(nodes: DataFrame) -> DataFrame:
    """Sorted distinct page ids per page."""
    raw = stable_id(F.col("attrs")[fixed.PAGE_ID_ATTRIBUTE])
    distinct = nodes.select("page_id", raw.alias("id")).filter("id IS NOT NULL").distinct()
    return distinct.groupBy("page_id").agg(F.array_sort(F.collect_list("id")).alias("raw_page_ids"))


def page_marker_present(nodes: DataFrame) -> DataFrame:
    """Whether a page carries any builder marker."""
    hit = (
        ((F.col("tag") == "html") & F.array_contains("class_tokens", fixed.PAGE_ROOT_CLASS))
        | ((F.col("tag") == "body") & F.array_contains("class_tokens", fixed.PAGE_BODY_CLASS))
        | F.map_contains_key("attrs", fixed.PAGE_ID_ATTRIBUTE)
    )
    return nodes.groupBy("page_id").agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("present"))


def page_fingerprints(pages: DataFrame, nodes: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """Fingerprint and context id of a page from its locator, marker, page ids and selected document."""
    located = with_locator_digest(page_locators(pages)).filter("reject IS NULL").drop("html")
    joined = located.join(page_marker_present(nodes), "page_id", "left").join(page_ids(nodes), "page_id", "left")
    if context is None:
        joined = joined.withColumns({"selected_document_fingerprint": F.lit(None).cast("string"),
                                     "site_fingerprint": F.lit(None).cast("string")})
    else:
        joined = joined.join(
            context.select("page_id", "selected_document_fingerprint", "site_fingerprint"), "page_id", "left")
    locator = F.struct(F.col("host").alias("host_ascii"), "path", "port", "scheme", F.col("scope").alias("site_path_scope"))
    fingerprint = digest(canonical_struct({
        "locator": locator,
        "page_marker_present": F.coalesce("present", F.lit(False)),
        "raw_data_elementor_ids": F.coalesce("raw_page_ids", F.array().cast("array<string>")),
        "selected_document_fingerprint": F.col("selected_document_fingerprint"),
    }))
    joined = joined.withColumn("page_fingerprint", fingerprint)
    context_id = digest(canonical_struct({
        name: F.col(name) for name in ("page_fingerprint", "selected_document_fingerprint", "site_fingerprint")}))
    return joined.withColumn("page_context_id", context_id)


def disclosure(facts: DataFrame, include_path: Column, include_title: Column) -> DataFrame:
    """Apply the disclosure policy: digests stay, plain facts only where allowed."""
    plain = ["scheme", "host", "port", "path", "scope", "display_path"]
    out = facts.withColumns({c: F.when(include_path, F.col(c)) for c in plain if c in facts.columns})
    out = out.withColumn("locator_disclosure", F.when(include_path, "RAW").otherwise("HASH_ONLY"))
    return out.withColumn("title", F.when(include_title, plain_label(F.col("title"))))


def bind_pages(pages: DataFrame, source_documents: DataFrame, context: DataFrame) -> DataFrame:
    """Binding of a page to its selected document from locator, marker and confirmation.

    `pages` needs page_id, locator_sha256 and raw_page_ids; `context` one row per page with a context.
    """
    candidates = source_documents.select(
        F.col("context_id").alias("_ctx"), F.col("document_id").alias("_doc"),
        F.col("document_fingerprint").alias("_doc_fp"), F.col("page_locator_candidates").alias("_locators"))
    joined = (
        pages.join(context.select("page_id", "context_id", "selected_document_id", "confirmation_state"), "page_id", "left")
        .join(candidates, (F.col("context_id") == F.col("_ctx")) & (F.col("selected_document_id") == F.col("_doc")), "left")
    )
    ids = F.coalesce("raw_page_ids", F.array().cast("array<string>"))
    no_context, no_document = F.col("context_id").isNull(), F.col("_doc").isNull()
    marker = F.array_contains(ids, F.col("_doc"))
    locator = F.coalesce(F.array_contains("_locators", F.col("locator_sha256")), F.lit(False))
    conflict = (F.size(ids) > 0) & ~marker
    weak = marker | locator | (F.col("confirmation_state") == "CONFIRMED")
    state = (
        F.when(no_context | no_document, "UNMATCHED").when(conflict, "AMBIGUOUS")
        .when(marker & locator, "EXACT").when(weak, "PROBABLE").otherwise("UNMATCHED")
    )
    reasons = (
        F.when(no_context, F.array(F.lit("SOURCE_CONTEXT_NOT_IMPORTED")))
        .when(no_document, F.array(F.lit("SOURCE_DOCUMENT_NOT_SELECTED")))
        .when(conflict, F.array(F.lit("DOCUMENT_MISMATCH")))
        .when(marker & locator, F.array().cast("array<string>"))
        .when(weak, compact(F.when(~marker, "PAGE_DOCUMENT_MARKER_NOT_OBSERVED"),
                            F.when(~locator, "PAGE_LOCATOR_NOT_MATCHED")))
        .otherwise(F.array(F.lit("NO_COMPATIBLE_DOCUMENT_MATCH_EVIDENCE")))
    )
    usable = ~no_context & ~no_document
    binding = F.struct(
        F.when(usable, "AVAILABLE").otherwise("INSUFFICIENT").alias("availability"),
        state.alias("binding_state"),
        F.when(usable, F.col("_doc")).alias("source_document_id"),
        F.when(usable, F.col("_doc_fp")).alias("source_document_fingerprint"),
        F.coalesce(usable & locator, F.lit(False)).alias("page_locator_candidate_match"),
        F.when(usable & marker, F.col("_doc")).alias("page_document_id"),
        F.coalesce("confirmation_state", F.lit("NOT_CONFIRMED")).alias("confirmation_state"),
        reasons.alias("reason_codes"),
    )
    return joined.withColumn("page_binding", binding).drop("_ctx", "_doc", "_doc_fp", "_locators")
