"""Queries over the given pages (and nodes extracted from them), with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagefacts.functions import markers
from pagefacts.functions.digests import digest
from pagefacts.operators import nodes as node_ops
from pagefacts.operators import pages as page_ops
from pagefacts.plans import derive
from pagefacts.plans.oracle_base import EMAIL, JWT, RANDOM, WORD, private, stable, with_tags
from pagefacts.sources.nodes import extract_nodes


def joined(column: Column | str) -> Column:
    return F.array_join(column, ",")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.table(spark, sf_dir, "pages")


def _varied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page addresses with planted path forms, so that every path rule is met."""
    extra = F.expr(_VARIANT)
    parts = F.regexp_extract("url", "^([^?#]*)", 1)
    return _pages(spark, sf_dir).select("page_id", F.concat(parts, extra, F.lit("?q=1#f")).alias("url"))


_VARIANT = """CASE page_id % 9 WHEN 0 THEN '/%7euser/%41/%2f' WHEN 1 THEN '/a/./b/../c' WHEN 2 THEN '/person%40example.com/x'
  WHEN 3 THEN '/wp_nonce/1//2' WHEN 4 THEN '/a%3ab/%3fkeep/..' WHEN 5 THEN '/AAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAA'
  WHEN 6 THEN '/%ZZ/k' WHEN 7 THEN '/auth-token/é' ELSE '/Case/' END"""


def entry_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per host: pages, distinct locators, nodes and interactive candidates."""
    pages = _pages(spark, sf_dir)
    located = page_ops.with_locator_digest(page_ops.page_locators(pages.select("page_id", "url"))).filter("reject IS NULL")
    nodes = node_ops.interactive_nodes(extract_nodes(pages))
    counts = nodes.groupBy("page_id").agg(F.count("*").alias("n"), F.count_if("interactive").alias("i"))
    return located.join(counts, "page_id", "left").groupBy("host").agg(
        F.count("*").alias("n_pages"), F.countDistinct("locator_sha256").alias("n_locators"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_nodes"), F.coalesce(F.sum("i"), F.lit(0)).alias("n_interactive"))


def read_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = _pages(spark, sf_dir).select("page_id", F.expr(_MIXED_URL).alias("url"))
    return page_ops.read_pages(mixed).select("page_id", "url", "reject_reason")


_MIXED_URL = """CASE page_id % 8 WHEN 1 THEN concat('ftp', substr(url, 5)) WHEN 2 THEN 'https://chrome.google.com/webstore'
  WHEN 3 THEN 'https://eu.addons.mozilla.org/x' WHEN 4 THEN 'no address' ELSE url END"""


def extract_nodes_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = extract_nodes(_pages(spark, sf_dir))
    return nodes.select("page_id", "node_ix", "tag", F.coalesce(markers.attr("href"), F.lit("-")).alias("href"))


def node_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tree links of the extracted nodes (no SQL twin: DuckDB cannot build the tree)."""
    nodes = extract_nodes(_pages(spark, sf_dir))
    return nodes.groupBy("page_id").agg(
        F.count("*").alias("n_nodes"), F.max("depth").alias("max_depth"), F.sum("child_count").alias("n_children"),
        F.count_if(F.col("parent_ix").isNull()).alias("n_roots"))


def page_locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = page_ops.page_locators(_pages(spark, sf_dir), "/en")
    return out.select("page_id", "scheme", "host", F.coalesce("port", F.lit(-1)).alias("port"), "path", "scope", "reject")


def normalize_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_ops.normalize_paths(_varied(spark, sf_dir), "/a/%7eb").select("page_id", "path", "scope")


def redact_path_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_ops.redact_path_segments(_varied(spark, sf_dir)).select("page_id", "path", "redacted_segment_count")


def _repeating(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses where many pages share a locator once query and fragment are dropped."""
    site = F.regexp_extract("url", "^([a-z]+://[^/]+)", 1)
    return _pages(spark, sf_dir).select("page_id", F.concat(site, F.lit("/list?p="), F.col("page_id").cast("string")).alias("url"))


def locator_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_ops.locator_groups(_repeating(spark, sf_dir))


def duplicate_locator_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_ops.duplicate_locator_pages(_repeating(spark, sf_dir)).select("page_id", "locator_sha256")


def display_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_ops.display_paths(_varied(spark, sf_dir)).select("page_id", "origin", "display_path")


def class_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = derive.page_nodes(spark, sf_dir)
    strict = node_ops.class_tokens(nodes, "STRICT").withColumnRenamed("class_tokens_safe", "strict")
    both = node_ops.class_tokens(strict, "STANDARD")
    return both.select("page_id", "node_ix", joined("strict").alias("strict_tokens"), joined("class_tokens_safe").alias("standard_tokens"))


def node_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = node_ops.node_markers(derive.page_nodes(spark, sf_dir))
    return out.select("page_id", "node_ix", "page_marker", "data_id", "matched", joined("reasons").alias("reasons"),
                      joined("widget").alias("widget"), joined("structure").alias("structure"))


def page_marker_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_ops.page_marker_present(derive.page_nodes(spark, sf_dir))


def interactive_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return node_ops.interactive_nodes(extract_nodes(_pages(spark, sf_dir))).select("page_id", "node_ix", "tag", "interactive")


def sanitize_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    noisy = F.concat(F.lit("\t "), title, F.lit("\n"), F.repeat(title, 6))
    role = F.expr("CASE page_id % 3 WHEN 0 THEN ' Main ' WHEN 1 THEN '9x' ELSE 'nav-2' END")
    frame = _pages(spark, sf_dir).select("page_id", noisy.alias("title"), role.alias("role"))
    return node_ops.sanitize_labels(frame).select("page_id", "title", "role")


def _context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One selected document per page; every fifth page has no context."""
    return _pages(spark, sf_dir).filter("page_id % 5 <> 4").select(
        "page_id", F.concat(F.lit("ctx-"), F.col("page_id").cast("string")).alias("context_id"),
        F.expr("CASE WHEN page_id % 7 = 6 THEN NULL WHEN page_id % 3 = 2 THEN 'page-x' ELSE concat('page-', CAST(page_id AS VARCHAR(20))) END").alias("selected_document_id"),
        digest(F.concat(F.lit("doc"), F.col("page_id").cast("string"))).alias("selected_document_fingerprint"),
        digest(F.lit("site")).alias("site_fingerprint"),
        F.expr("CASE WHEN page_id % 2 = 0 THEN 'CONFIRMED' ELSE 'NOT_CONFIRMED' END").alias("confirmation_state"))


def page_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = page_ops.page_fingerprints(_pages(spark, sf_dir), derive.page_nodes(spark, sf_dir), _context(spark, sf_dir))
    return out.select("page_id", "page_fingerprint", "page_context_id")


def disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = page_ops.with_locator_digest(page_ops.page_locators(_pages(spark, sf_dir)))
    facts = facts.withColumn("title", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1))
    out = page_ops.disclosure(facts, F.col("page_id") % 2 == 0, F.col("page_id") % 3 == 0)
    return out.select("page_id", "host", "path", "locator_sha256", "locator_disclosure", "title")


def bind_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    located = page_ops.with_locator_digest(page_ops.page_locators(_pages(spark, sf_dir).select("page_id", "url")))
    # Pages whose marker was not recorded have no ids.
    recorded = F.when(F.col("page_id") % 4 != 3, F.col("raw_page_ids"))
    ids = page_ops.page_ids(derive.page_nodes(spark, sf_dir)).withColumn("raw_page_ids", recorded)
    context = _context(spark, sf_dir)
    documents = located.join(context, "page_id").filter("selected_document_id IS NOT NULL").select(
        "context_id", F.col("selected_document_id").alias("document_id"),
        F.col("selected_document_fingerprint").alias("document_fingerprint"),
        F.when(F.col("page_id") % 2 == 0, F.array("locator_sha256")).otherwise(F.array(digest(F.lit("other")))).alias("page_locator_candidates"))
    out = page_ops.bind_pages(located.join(ids, "page_id", "left"), documents, context)
    b = F.col("page_binding")
    return out.select("page_id", b["availability"].alias("availability"), b["binding_state"].alias("binding_state"),
                      b["source_document_id"].alias("source_document_id"), b["page_locator_candidate_match"].alias("locator_match"),
                      b["page_document_id"].alias("page_document_id"), joined(b["reason_codes"]).alias("reasons"))


# --- oracle SQL ----------------------------------------------------------------------------------

_SPLIT_SQL = """
parts AS (
  SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+):', 1)) AS scheme, regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) AS host,
         CASE WHEN regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/'
              ELSE regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) END AS raw_path FROM src),
enc AS (
  SELECT *, array_to_string(list_transform(string_split(raw_path, ''), lambda c: CASE WHEN ord(c) > 127
         THEN regexp_replace(hex(encode(c)), '(..)', '%\\1', 'g') ELSE c END), '') AS enc_path FROM parts),
segs AS (
  SELECT *, list_reduce(list_transform(string_split(enc_path, '/')[2:], lambda s: [s]),
         lambda a, b: CASE WHEN b[1] = '..' THEN a[:-2] WHEN b[1] = '.' THEN a ELSE list_concat(a, b) END, []::VARCHAR[]) AS folded FROM enc),
dotless AS (
  SELECT *, '/' || array_to_string(CASE WHEN regexp_matches(enc_path, '/[.]{1,2}$') THEN list_concat(folded, ['']) ELSE folded END, '/') AS path0 FROM segs),
decoded AS (
  SELECT *, list_transform(string_split(path0, '/'), lambda s: array_to_string(list_transform(
      regexp_extract_all(s, '%[0-9a-fA-F]{2}|[^%]+|%'),
      lambda t: CASE WHEN regexp_matches(t, '^%[0-9a-fA-F]{2}$') THEN
        CASE WHEN regexp_matches(chr(('0x' || t[2:3])::INT), '^[A-Za-z0-9._~-]$') THEN chr(('0x' || t[2:3])::INT) ELSE upper(t) END
        ELSE t END), '')) AS dec FROM dotless),
hidden AS (
  SELECT *, list_transform(dec, lambda s: s <> '' AND (regexp_matches(s, '%([^0-9A-Fa-f]|.[^0-9A-Fa-f]|.?$)')
      OR length(url_decode(s)) > 180 OR regexp_matches(url_decode(s), '^[^/@\\s]+@[^/@\\s]+[.][^/@\\s]+$')
      OR regexp_matches(url_decode(s), '^eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{4,}$')
      OR regexp_matches(url_decode(s), '^[A-Za-z0-9_-]{48,}$')
      OR regexp_matches(url_decode(s), '(^|[-_.])(token|nonce|secret|password|passwd|auth|session|jwt|key)($|[-_.])', 'i'))) AS hid FROM decoded),
loc AS MATERIALIZED (
  SELECT page_id, scheme, host, path0, array_to_string(list_transform(list_zip(dec, hid), lambda z: CASE WHEN z[2] THEN '[REDACTED_SEGMENT]' ELSE z[1] END), '/') AS path,
         CAST(len(list_filter(hid, lambda h: h)) AS INT) AS redacted_segment_count FROM hidden)"""

_PLAIN = f"src AS (SELECT page_id, url FROM pages),{_SPLIT_SQL}"
_VARIED = f"src AS (SELECT page_id, regexp_extract(url, '^([^?#]*)', 1) || ({_VARIANT}) || '?q=1#f' AS url FROM pages),{_SPLIT_SQL}"
_REPEATING = f"src AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/]+)', 1) || '/list?p=' || page_id AS url FROM pages),{_SPLIT_SQL}"
_FACTS_TEXT = """'{"host_ascii":"' || host || '","path":"' || path || '","port":null,"scheme":"' || scheme || '","site_path_scope":"/"}'"""
_LOCATOR = f"'sha256:' || sha256({_FACTS_TEXT})"
_CONTEXT = """
ctx AS (
  SELECT page_id, 'ctx-' || page_id AS context_id, CASE WHEN page_id % 7 = 6 THEN NULL WHEN page_id % 3 = 2 THEN 'page-x' ELSE 'page-' || page_id END AS sel,
         'sha256:' || sha256('doc' || page_id) AS doc_fp, 'sha256:' || sha256('site') AS site_fp,
         CASE WHEN page_id % 2 = 0 THEN 'CONFIRMED' ELSE 'NOT_CONFIRMED' END AS conf FROM pages WHERE page_id % 5 <> 4)"""
_SAFE = f"(length(t) <= 64 AND regexp_matches(t, '^[A-Za-z0-9_-]+$') AND NOT {private('t')})"
_TOKENS = "list_filter(string_split(mapped_class, ' '), lambda t: t <> '')"


def _class_list(extra: str) -> str:
    return (f"array_to_string(list_sort(list_distinct(list_filter({_TOKENS}, lambda t: {_SAFE}{extra}))), ',')")


QUERIES = {
    "host_summary": entry_query, "read_pages": read_pages, "extract_nodes": extract_nodes_query, "node_tree": node_tree,
    "page_locators": page_locators, "normalize_paths": normalize_paths, "redact_path_segments": redact_path_segments,
    "locator_groups": locator_groups, "duplicate_locator_pages": duplicate_locator_pages, "display_paths": display_paths,
    "class_tokens": class_tokens, "node_markers": node_markers, "page_marker_present": page_marker_present,
    "interactive_nodes": interactive_nodes, "sanitize_labels": sanitize_labels, "page_fingerprints": page_fingerprints,
    "disclosure": disclosure, "bind_pages": bind_pages,
}

ORACLES = {
    "host_summary": with_tags(f"""{''}, {_PLAIN}, cnt AS (SELECT page_id, count(*) AS n, count_if((tag = 'a' AND href IS NOT NULL) OR tag IN ('button', 'input', 'select', 'textarea', 'summary')) AS i FROM tags GROUP BY page_id)
SELECT host, count(*) AS n_pages, count(DISTINCT {_LOCATOR}) AS n_locators, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_nodes, CAST(coalesce(sum(i), 0) AS BIGINT) AS n_interactive
FROM loc LEFT JOIN cnt USING (page_id) GROUP BY host"""),
    "read_pages": f"""SELECT page_id, url, CASE WHEN url LIKE 'ftp%' THEN 'UNSUPPORTED_SCHEME' WHEN url = 'no address' THEN 'URL_INVALID'
  WHEN url LIKE 'https://chrome.google.com/%' OR url LIKE '%.addons.mozilla.org/%' THEN 'STORE_PAGE' END AS reject_reason FROM (SELECT page_id, {_MIXED_URL} AS url FROM pages)""",
    "extract_nodes": with_tags("SELECT page_id, node_ix, tag, coalesce(href, '-') AS href FROM tags"),
    "page_locators": f"WITH {_PLAIN} SELECT page_id, scheme, host, -1 AS port, path, '/en/' AS scope, NULL::VARCHAR AS reject FROM loc",
    "normalize_paths": f"WITH {_VARIED} SELECT page_id, path, '/a/~b/' AS scope FROM loc",
    "redact_path_segments": f"WITH {_VARIED} SELECT page_id, path, redacted_segment_count FROM loc",
    "locator_groups": f"WITH {_REPEATING} SELECT {_LOCATOR} AS locator_sha256, count(*) AS n_pages, min(page_id) AS first_page_id, max(page_id) AS last_page_id FROM loc GROUP BY 1",
    "duplicate_locator_pages": f"WITH {_REPEATING}, d AS (SELECT page_id, {_LOCATOR} AS locator_sha256, count(*) OVER (PARTITION BY {_LOCATOR}) AS n FROM loc) SELECT page_id, locator_sha256 FROM d WHERE n > 1",
    "display_paths": f"""WITH {_VARIED}, sq AS (SELECT page_id, scheme || '://' || host AS origin, regexp_replace(path0, '/{{2,}}', '/', 'g') AS p FROM loc),
  cut AS (SELECT page_id, origin, CASE WHEN length(p) > 1 AND p LIKE '%/' THEN p[:-2] ELSE p END AS p FROM sq)
SELECT page_id, origin, array_to_string(list_transform(string_split(p, '/'), lambda s: CASE WHEN s = '' THEN s
  WHEN regexp_matches(s, '%([^0-9A-Fa-f]|.[^0-9A-Fa-f]|.?$)') OR length(url_decode(s)) > 120 OR regexp_matches(url_decode(s), '{RANDOM}')
    OR regexp_matches(url_decode(s), '{WORD}', 'i') OR regexp_matches(url_decode(s), '{EMAIL}', 'i') OR regexp_matches(url_decode(s), '{JWT}') THEN ':redacted' ELSE s END), '/') AS display_path FROM cut""",
    "class_tokens": with_tags(f"""SELECT page_id, node_ix, {_class_list(" AND regexp_matches(t, '^(elementor|e-|widget|section|container|grid|flex|button|heading|image|menu|nav)', 'i')")} AS strict_tokens,
  {_class_list('')} AS standard_tokens FROM nd"""),
    "node_markers": with_tags(f"""SELECT page_id, node_ix, {stable('a_page_id')} AS page_marker, {stable('a_data_id')} AS data_id,
  coalesce({stable('a_page_id')} IS NOT NULL, false) OR tag IN ('article', 'div') AS matched,
  array_to_string(list_filter([CASE WHEN {stable('a_page_id')} IS NOT NULL THEN 'DATA_ELEMENTOR_ID' END,
    CASE WHEN {stable('a_data_id')} IS NOT NULL AND tag IN ('article', 'div') THEN 'DATA_ID_WITH_ELEMENTOR_CLASS' END,
    CASE WHEN tag IN ('article', 'div') THEN 'ELEMENTOR_CLASS' END], lambda r: r IS NOT NULL), ',') AS reasons,
  CASE WHEN tag IN ('article', 'div') THEN 'elementor-widget-text' ELSE '' END AS widget, CASE WHEN tag IN ('article', 'div') THEN 'e-con' ELSE '' END AS structure FROM nd"""),
    "page_marker_present": with_tags("SELECT page_id, bool_or(a_page_id IS NOT NULL) AS present FROM nd GROUP BY page_id"),
    "interactive_nodes": with_tags("SELECT page_id, node_ix, tag, (tag = 'a' AND href IS NOT NULL) OR tag IN ('button', 'input', 'select', 'textarea', 'summary') AS interactive FROM tags"),
    "sanitize_labels": """SELECT page_id, substr(trim(regexp_replace(chr(9) || ' ' || t || chr(10) || repeat(t, 6), '[\\x00-\\x1F\\x7F]', ' ', 'g')), 1, 300) AS title,
  CASE page_id % 3 WHEN 0 THEN 'main' WHEN 1 THEN NULL ELSE 'nav-2' END AS role FROM (SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1, 's') AS t FROM pages)""",
    "page_fingerprints": with_tags(f""", {_PLAIN}, {_CONTEXT}, has AS (SELECT page_id, bool_or(a_page_id IS NOT NULL) AS present FROM nd GROUP BY page_id),
fp AS (SELECT page_id, doc_fp, site_fp, 'sha256:' || sha256('{{"locator":' || {_FACTS_TEXT} || ',"page_marker_present":' || CASE WHEN coalesce(present, false) THEN 'true' ELSE 'false' END
  || ',"raw_data_elementor_ids":' || CASE WHEN coalesce(present, false) THEN '["page-' || page_id || '"]' ELSE '[]' END
  || ',"selected_document_fingerprint":' || coalesce('"' || doc_fp || '"', 'null') || '}}') AS page_fingerprint FROM loc LEFT JOIN has USING (page_id) LEFT JOIN ctx USING (page_id))
SELECT page_id, page_fingerprint, 'sha256:' || sha256('{{"page_fingerprint":"' || page_fingerprint || '","selected_document_fingerprint":' || coalesce('"' || doc_fp || '"', 'null')
  || ',"site_fingerprint":' || coalesce('"' || site_fp || '"', 'null') || '}}') AS page_context_id FROM fp"""),
    "disclosure": f"""WITH {_PLAIN} SELECT page_id, CASE WHEN page_id % 2 = 0 THEN host END AS host, CASE WHEN page_id % 2 = 0 THEN path END AS path, {_LOCATOR} AS locator_sha256,
  CASE WHEN page_id % 2 = 0 THEN 'RAW' ELSE 'HASH_ONLY' END AS locator_disclosure,
  CASE WHEN page_id % 3 = 0 THEN substr(trim(regexp_replace(regexp_extract(html, '<title>(.*?)</title>', 1, 's'), '[\\x00-\\x1F\\x7F]', ' ', 'g')), 1, 300) END AS title
  FROM loc JOIN pages USING (page_id)""",
    "bind_pages": with_tags(f""", {_CONTEXT}, has AS (SELECT page_id, bool_or(a_page_id IS NOT NULL) AS present FROM nd WHERE page_id % 4 <> 3 GROUP BY page_id),
b AS (SELECT page_id, context_id, sel, conf, coalesce(present, false) AS present, coalesce(present, false) AND sel = 'page-' || page_id AS marker, page_id % 2 = 0 AS locator
  FROM pages LEFT JOIN ctx USING (page_id) LEFT JOIN has USING (page_id))
SELECT page_id, CASE WHEN sel IS NULL THEN 'INSUFFICIENT' ELSE 'AVAILABLE' END AS availability,
  CASE WHEN sel IS NULL THEN 'UNMATCHED' WHEN present AND NOT marker THEN 'AMBIGUOUS' WHEN marker AND locator THEN 'EXACT'
       WHEN marker OR locator OR conf = 'CONFIRMED' THEN 'PROBABLE' ELSE 'UNMATCHED' END AS binding_state, sel AS source_document_id,
  coalesce(sel IS NOT NULL AND locator, false) AS locator_match, CASE WHEN marker THEN sel END AS page_document_id,
  CASE WHEN context_id IS NULL THEN 'SOURCE_CONTEXT_NOT_IMPORTED' WHEN sel IS NULL THEN 'SOURCE_DOCUMENT_NOT_SELECTED' WHEN present AND NOT marker THEN 'DOCUMENT_MISMATCH'
       WHEN marker AND locator THEN '' WHEN marker OR locator OR conf = 'CONFIRMED' THEN array_to_string(list_filter([CASE WHEN NOT marker THEN 'PAGE_DOCUMENT_MARKER_NOT_OBSERVED' END,
         CASE WHEN NOT locator THEN 'PAGE_LOCATOR_NOT_MATCHED' END], lambda r: r IS NOT NULL), ',') ELSE 'NO_COMPATIBLE_DOCUMENT_MATCH_EVIDENCE' END AS reasons FROM b"""),
}
