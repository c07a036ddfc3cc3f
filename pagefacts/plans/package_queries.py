"""Queries over documents as chunks, packages and text, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagefacts.operators import chunks as chunk_ops
from pagefacts.operators import packages, text
from pagefacts.plans import derive
from pagefacts.plans.stored import stored
from pagefacts.session import checkpointed, shared_folder
from pagefacts.sources import evidence
from pagefacts.sources import packages as archive_source



def _clock(text: str) -> Column:
    """Every rule with a clock takes a literal, so that results repeat."""
    return F.lit(text).cast("timestamp")


def redact_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = text.redact_corpus(derive.table(spark, sf_dir, "documents"), 160)
    return out.select("doc_id", "preview", "truncated", "redacted_length", "n_email", "n_jwt", "n_keyed", "n_number", "n_entropy")


def redaction_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.redaction_totals(text.redact_corpus(derive.table(spark, sf_dir, "documents"), 160), ["source", "lang"])


def text_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, texts = derive.document_text(spark, sf_dir)
    out = text.text_shape(texts, nodes)
    return out.select("page_id", "node_ix", "status", "availability", "text_node_count", "over_limit",
                      *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("word_count", "grapheme_count", "longest_token")])


def page_text_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text shape of the given pages with grapheme counts (DuckDB has no tree to follow)."""
    from pagefacts.sources.nodes import extract_nodes, extract_text_nodes

    texts = stored(spark, sf_dir, "page_text_nodes", lambda s, d: extract_text_nodes(derive.table(s, d, "pages")))
    found = stored(spark, sf_dir, "page_element_nodes", lambda s, d: extract_nodes(derive.table(s, d, "pages")))
    return text.text_shape(texts, found)


def bound_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, texts = derive.document_text(spark, sf_dir)
    return text.bound_text(texts, 100, 30_000, 380).select("page_id", "text_ix", "limit_reached")


def orphan_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_ops.orphan_chunks(derive.chunks(spark, sf_dir), derive.jobs(spark, sf_dir)).select("job_id", "chunk_index", "copy")


def chunk_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_ops.chunk_totals(derive.chunks(spark, sf_dir), derive.jobs(spark, sf_dir))


def chunk_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_ops.chunk_issues(derive.chunks(spark, sf_dir), derive.jobs(spark, sf_dir))


def assemble_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunk_ops.assemble_chunks(derive.chunks(spark, sf_dir), derive.jobs(spark, sf_dir))
    return out.select("job_id", "ok", "reason", F.sha2("text", 256).alias("text_sha256"), "n_chunks", "n_bytes")


def stale_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_ops.stale_jobs(derive.jobs(spark, sf_dir), derive.chunks(spark, sf_dir), _clock("2024-01-01 00:10:00"))


def retention_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_ops.retention_candidates(derive.jobs(spark, sf_dir), _clock("2024-01-31 00:08:20"), last_run=_clock("2024-01-30 00:00:00")).select("job_id", "status")


def active_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_ops.active_conflicts(derive.jobs(spark, sf_dir))


def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_ops.job_states(derive.job_events(spark, sf_dir))


def read_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One archive per document, with planted unsafe paths, repeated paths and broken bytes."""
    entries = archive_source.open_packages(derive.archives(spark, sf_dir))
    # Archives are opened once: what meets below are digests, not contents.
    listed = checkpointed(entries.select("package_id", "path", F.sha2("content", 256).alias("sha256"), "issue"))
    twice = archive_source.package_entry_issues(listed).filter("issue = 'DUPLICATE_PATH'").select("package_id", "path", F.lit(True).alias("repeated"))
    out = listed.join(twice, ["package_id", "path"], "left")
    return out.select("package_id", "path", "sha256", F.coalesce("issue", F.when(F.col("repeated"), "DUPLICATE_PATH")).alias("issue"))


def exact_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packages.exact_inventory(*derive.packages(spark, sf_dir))


def verify_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packages.verify_files(*derive.packages(spark, sf_dir))


def path_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, manifest, _ = derive.packages(spark, sf_dir)
    return packages.path_difference(files, manifest)


def package_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source as a package, plus one package per document that only some rules hit."""
    files, manifest, checksums = derive.packages(spark, sf_dir)
    return packages.package_verdicts(files, packages.exact_inventory(files, manifest, checksums), packages.verify_files(files, manifest, checksums))


def route_by_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = derive.table(spark, sf_dir, "documents").select("doc_id", F.expr(_FAMILY).alias("family"), F.expr(_VERSION).alias("schema_version"), F.lit("{}").alias("capture_state"))
    return packages.route_by_version(heads).groupBy("route").agg(F.count("*").alias("n"), F.count("capture_state").alias("n_with_state"))


_FAMILY = "CASE WHEN doc_id % 10 = 0 THEN 'other' WHEN doc_id % 10 = 1 THEN 'source_bundle' ELSE 'runtime_package' END"
_VERSION = "CASE doc_id % 4 WHEN 0 THEN '1.4.0' WHEN 1 THEN '1.3.0' WHEN 2 THEN '1.2.10' ELSE '1.10.0' END"


def write_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, _, _ = derive.packages(spark, sf_dir)
    target = f"{shared_folder(spark)}/evidence/{spark.sparkContext.applicationId}/{sf_dir.strip('/').replace('/', '_')}"
    manifest = evidence.write_evidence(files, target, ["package_id"])
    return manifest.select("package_id", "path", "bytes", "sha256")


QUERIES = {f.__name__: f for f in (
    redact_corpus, redaction_totals, text_shape, page_text_shape, bound_text, orphan_chunks, chunk_totals, chunk_issues, assemble_chunks,
    stale_jobs, retention_candidates, active_conflicts, job_states, read_packages, exact_inventory, verify_files, path_difference, package_verdicts,
    route_by_version, write_evidence)}

# --- oracle SQL ----------------------------------------------------------------------------------

_SP = "[\\s\\x0B\\p{Z}\\x{FEFF}]"
_RULES = (("email", "\\b[A-Z0-9._%+-]+@[A-Z0-9.-]+[.][A-Z]{2,}\\b", "[REDACTED_EMAIL]", "i"), ("jwt", "\\beyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{4,}\\b", "[REDACTED_TOKEN]", ""),
          ("keyed", "\\b(?:bearer|token|secret|password)\\s*[:=]?\\s*[A-Za-z0-9._~+/-]{8,}\\b", "[REDACTED_TOKEN]", "i"), ("number", "\\b(?:[0-9][ -]?){13,19}\\b", "[REDACTED_NUMBER]", ""),
          ("entropy", "\\b[A-Za-z0-9_-]{48,}\\b", "[REDACTED_TOKEN]", ""))


def _redaction() -> str:
    steps = [f"r0 AS (SELECT doc_id, source, lang, trim(regexp_replace(text, '{_SP}+', ' ', 'g')) AS t FROM documents)"]
    for i, (name, pattern, mark, flag) in enumerate(_RULES):
        inline = f"(?i){pattern}" if flag else pattern
        steps.append(f"r{i + 1} AS (SELECT * EXCLUDE (t), CAST(len(regexp_extract_all(t, '{inline}')) AS INT) AS n_{name}, regexp_replace(t, '{inline}', '{mark}', 'g') AS t FROM r{i})")
    return ", ".join(steps)


_CHUNKS = """
jb AS MATERIALIZED (SELECT 'job-' || doc_id AS job_id, source AS session_id, doc_id, (doc_id // 3) % 400 AS tab_id, ['PREPARED', 'INJECTED', 'RECEIVING', 'ASSEMBLING', 'COMPLETE', 'FAILED'][doc_id % 6 + 1] AS status, doc_id % 6 < 4 AS active,
  TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id) AS updated_at, CAST(greatest(1, ceil(length(text) / 2000)) AS INT) AS expected_chunks, CASE WHEN doc_id % 5 <> 0 THEN sha256(CASE WHEN doc_id % 97 = 3 THEN text || '!' ELSE text END) END AS full_sha256, text FROM documents),
pc AS (SELECT doc_id, chunk_index, substr(text, 2000 * chunk_index + 1, 2000) AS piece FROM (SELECT doc_id, text, unnest(generate_series(0, expected_chunks - 1)) AS chunk_index FROM jb)),
ch AS MATERIALIZED (SELECT *, CASE WHEN (doc_id + chunk_index) % 47 = 0 THEN sha256('wrong') WHEN (doc_id + chunk_index) % 53 = 0 THEN 'LEGACY_UNVERIFIED' ELSE sha256(data) END AS sha, octet_length(encode(data)) + CASE WHEN (doc_id + chunk_index) % 59 = 0 THEN 1 ELSE 0 END AS bl
  FROM (SELECT 'job-' || doc_id AS job_id, doc_id, CAST(chunk_index AS INT) AS chunk_index, copy, CASE WHEN copy = 2 THEN 'x' || piece ELSE piece END AS data
    FROM (SELECT *, unnest(CASE WHEN (doc_id + chunk_index) % 41 = 0 THEN [0, 1] WHEN (doc_id + chunk_index) % 43 = 0 THEN [0, 2] ELSE [0] END) AS copy FROM pc WHERE (doc_id + chunk_index) % 37 <> 0))),
dc AS MATERIALIZED (SELECT job_id, chunk_index, count(DISTINCT data) > 1 AS conflict, bool_and(octet_length(encode(data)) = bl AND (sha = 'LEGACY_UNVERIFIED' OR sha = sha256(data))) AS intact, min(octet_length(encode(data))) AS nb, bool_or(sha = 'LEGACY_UNVERIFIED') AS legacy, min(data) AS data FROM ch GROUP BY ALL),
jt AS MATERIALIZED (SELECT jb.*, coalesce(c.n, 0) AS n, c.lo, c.hi, CAST(coalesce(c.b, 0) AS BIGINT) AS b, c.conflict, c.intact, c.legacy FROM jb LEFT JOIN (SELECT job_id, count(*) AS n, min(chunk_index) AS lo, max(chunk_index) AS hi, sum(nb) AS b, bool_or(conflict) AS conflict, bool_and(intact) AS intact, bool_or(legacy) AS legacy FROM dc GROUP BY ALL) c USING (job_id))"""
_PACKAGES = """
pf AS MATERIALIZED (SELECT source AS package_id, 'docs/' || doc_id || '.txt' AS path, sha256(text) AS sha, octet_length(encode(text)) AS nb, doc_id FROM documents),
hd AS (SELECT DISTINCT source AS package_id, doc_id % 20 AS n FROM documents),
fl AS MATERIALIZED (SELECT package_id, path, sha, nb FROM pf WHERE doc_id % 67 <> 0 UNION ALL SELECT package_id, 'checksums.sha256', sha256('{}'), 2 FROM hd UNION ALL SELECT package_id, 'package-manifest.json', sha256('{}'), 2 FROM hd WHERE n <> 4),
mf AS MATERIALIZED (SELECT package_id, path, nb + CASE WHEN doc_id % 53 = 0 THEN 1 ELSE 0 END AS bytes, CASE WHEN doc_id % 83 = 0 THEN sha256('wrong') ELSE sha END AS sha FROM pf, (SELECT unnest([1, 2]) AS c) WHERE doc_id % 31 <> 0 AND (c = 1 OR doc_id % 71 = 5)
  UNION ALL SELECT package_id, 'docs/none.txt', 1, sha256('none') FROM hd WHERE n % 5 = 1),
cl AS MATERIALIZED (SELECT package_id, path, CASE WHEN doc_id % 59 = 0 THEN sha256('other') ELSE sha END AS sha, doc_id % 61 = 0 AS malformed, doc_id AS line_no FROM pf WHERE doc_id % 31 <> 0 UNION ALL SELECT package_id, 'package-manifest.json', sha256('{}'), false, -1 FROM hd),
wm AS (SELECT package_id, path FROM mf UNION SELECT package_id, 'package-manifest.json' FROM mf), ex AS (SELECT * FROM wm UNION SELECT package_id, 'checksums.sha256' FROM mf), lp AS (SELECT package_id, path FROM cl WHERE NOT malformed),
inv AS MATERIALIZED (SELECT package_id, path, 'FILE_MISSING' AS issue FROM (SELECT * FROM ex EXCEPT SELECT package_id, path FROM fl) UNION ALL SELECT package_id, path, 'FILE_EXTRA' FROM (SELECT package_id, path FROM fl EXCEPT SELECT * FROM ex)
  UNION ALL SELECT package_id, path, 'CHECKSUM_MISSING' FROM (SELECT * FROM wm EXCEPT SELECT * FROM lp) UNION ALL SELECT package_id, path, 'CHECKSUM_EXTRA' FROM (SELECT * FROM lp EXCEPT SELECT * FROM wm)
  UNION ALL SELECT package_id, path, 'MANIFEST_DUPLICATE' FROM mf GROUP BY ALL HAVING count(*) > 1),
ver AS MATERIALIZED (SELECT mf.package_id, mf.path, unnest(list_filter([CASE WHEN fl.sha IS NULL THEN 'MANIFEST_FILE_MISSING' END, CASE WHEN fl.nb <> mf.bytes THEN 'MANIFEST_SIZE' END, CASE WHEN fl.sha <> mf.sha THEN 'MANIFEST_DIGEST' END], lambda x: x IS NOT NULL)) AS issue FROM mf LEFT JOIN fl ON fl.package_id = mf.package_id AND fl.path = mf.path
  UNION ALL SELECT cl.package_id, cl.path, unnest(list_filter([CASE WHEN fl.sha IS NULL THEN 'CHECKSUM_FILE_MISSING' END, CASE WHEN fl.sha <> cl.sha THEN 'CHECKSUM_DIGEST' END], lambda x: x IS NOT NULL)) FROM cl LEFT JOIN fl ON fl.package_id = cl.package_id AND fl.path = cl.path WHERE NOT malformed
  UNION ALL SELECT package_id, 'line ' || line_no, 'CHECKSUM_LINE_MALFORMED' FROM cl WHERE malformed)"""
_ORDER = "[" + ", ".join(f"'{i}'" for i in packages.ISSUE_ORDER) + "]"
_TEXTS = """
dl AS (SELECT doc_id, doc_id % 40 AS page_id, CAST(doc_id // 40 + 1 AS INT) AS ix, CASE WHEN doc_id % 13 = 0 THEN 'script' WHEN doc_id % 17 = 0 THEN 'textarea' ELSE 'p' END AS tag, doc_id % 19 = 0 AS editable, text FROM documents),
tx AS MATERIALIZED (SELECT page_id, ix, tag, editable, CAST(ix AS BIGINT) * 10000000 + pos AS text_ix, data FROM (SELECT *, unnest(string_split(text, chr(10))) AS data, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM dl))"""

ORACLES = {
    "redact_corpus": f"WITH {_redaction()} SELECT doc_id, substr(t, 1, 160) AS preview, length(t) > 160 AS truncated, length(t) AS redacted_length, n_email, n_jwt, n_keyed, n_number, n_entropy FROM r5",
    "redaction_totals": f"WITH {_redaction()} SELECT source, lang, {', '.join(f'CAST(sum(n_{n}) AS BIGINT) AS n_{n}' for n, *_ in _RULES)}, count_if(length(t) > 160) AS n_truncated FROM r5 GROUP BY ALL",
    "text_shape": f"""WITH {_TEXTS}, el AS (SELECT page_id, 0 AS ix, 'html' AS tag, false AS editable FROM dl GROUP BY page_id UNION ALL SELECT page_id, ix, tag, editable FROM dl),
bt AS (SELECT page_id, ix, text_ix, data FROM tx WHERE tag = 'p' AND NOT editable UNION ALL SELECT page_id, 0, text_ix, data FROM tx WHERE tag = 'p' AND NOT editable),
g AS (SELECT page_id, ix, count(*) AS n, sum(length(data) + 1) - 1 AS chars, regexp_replace(string_agg(data, ' ' ORDER BY text_ix), '^{_SP}+|{_SP}+$', '', 'g') AS t FROM bt GROUP BY ALL),
s AS (SELECT el.*, n, chars, coalesce(t, '') AS t, CASE WHEN tag = 'textarea' THEN 'EXCLUDED_SENSITIVE_CONTROL' WHEN editable THEN 'EXCLUDED_CONTENTEDITABLE' WHEN tag = 'script' OR coalesce(t, '') = '' THEN 'NO_TEXT' ELSE 'MEASURED' END AS status FROM el LEFT JOIN g USING (page_id, ix)),
m AS (SELECT *, status = 'MEASURED' AS m, regexp_split_to_array(t, '{_SP}+') AS w FROM s)
SELECT page_id, ix AS node_ix, status, CASE status WHEN 'MEASURED' THEN 'AVAILABLE' WHEN 'NO_TEXT' THEN 'NOT_APPLICABLE' ELSE 'INSUFFICIENT' END AS availability, CASE WHEN m THEN n ELSE 0 END AS text_node_count,
  CASE WHEN m THEN CAST(len(w) AS INT) ELSE -1 END AS word_count, CASE WHEN m THEN CAST(length_grapheme(t) AS INT) ELSE -1 END AS grapheme_count,
  CASE WHEN m THEN CAST(list_max(list_transform(w, lambda x: length(x))) AS INT) ELSE -1 END AS longest_token, coalesce(m AND (n > 500 OR chars > 200000), false) AS over_limit FROM m""",
    "bound_text": f"""WITH {_TEXTS} SELECT page_id, text_ix, NOT (row_number() OVER w <= 100 AND sum(length(data)) OVER w <= 30000 AND 4 * row_number() OVER w <= 380) AS limit_reached FROM tx WINDOW w AS (PARTITION BY page_id ORDER BY text_ix)""",
    "orphan_chunks": f"WITH {_CHUNKS} SELECT job_id, chunk_index, copy FROM ch WHERE NOT EXISTS (SELECT 1 FROM jb WHERE jb.job_id = ch.job_id AND active)",
    "chunk_totals": f"WITH {_CHUNKS} SELECT job_id, n AS count, b AS bytes, n > 10000 OR b > 12000000 AS over_limit FROM jt WHERE active",
    "chunk_issues": f"""WITH {_CHUNKS} SELECT job_id, chunk_index, 'BYTE_LENGTH' AS issue FROM ch WHERE octet_length(encode(data)) <> bl UNION ALL SELECT job_id, chunk_index, 'CHECKSUM' FROM ch WHERE sha <> 'LEGACY_UNVERIFIED' AND sha <> sha256(data)
UNION ALL SELECT ch.job_id, chunk_index, 'LEGACY_WITHOUT_FULL_CHECKSUM' FROM ch JOIN jb USING (job_id) WHERE sha = 'LEGACY_UNVERIFIED' AND full_sha256 IS NULL UNION ALL SELECT job_id, -1, 'CHUNK_SEQUENCE' FROM jt WHERE n > 0 AND n <> expected_chunks""",
    "assemble_chunks": f"""WITH {_CHUNKS}, whole AS (SELECT job_id, sha256(string_agg(data, '' ORDER BY chunk_index)) AS h FROM dc GROUP BY ALL),
rs AS (SELECT jt.job_id, h, n, b, CASE WHEN n <> expected_chunks OR lo <> 0 OR hi <> expected_chunks - 1 THEN 'CHUNK_SEQUENCE' WHEN conflict THEN 'CONFLICTING_DUPLICATE' WHEN legacy AND full_sha256 IS NULL THEN 'LEGACY_INTEGRITY_UNAVAILABLE' WHEN b > 12000000 THEN 'ASSEMBLED_SIZE' WHEN NOT intact THEN 'CHUNK_INTEGRITY' WHEN full_sha256 <> h THEN 'ASSEMBLED_CHECKSUM' END AS reason FROM jt LEFT JOIN whole USING (job_id))
SELECT job_id, reason IS NULL AS ok, reason, CASE WHEN reason IS NULL THEN h END AS text_sha256, n AS n_chunks, b AS n_bytes FROM rs""",
    "stale_jobs": f"""WITH {_CHUNKS} SELECT job_id, status, CASE WHEN legacy THEN 'FAILED' WHEN n = expected_chunks AND hi = expected_chunks - 1 THEN 'FINALIZE' WHEN TIMESTAMP '2024-01-01 00:10:00' - updated_at >= INTERVAL 30 SECOND THEN 'INTERRUPTED' ELSE 'KEEP' END AS action FROM jt WHERE active""",
    "retention_candidates": f"WITH {_CHUNKS} SELECT job_id, status FROM jb WHERE NOT active AND TIMESTAMP '2024-01-31 00:08:20' - updated_at >= INTERVAL 30 DAY",
    "active_conflicts": f"WITH {_CHUNKS} SELECT job_id, count(*) OVER (PARTITION BY tab_id) > 1 AS tab_conflict, count(*) OVER (PARTITION BY session_id) > 1 AS session_conflict FROM jb WHERE active",
    "job_states": """WITH ev AS (SELECT event_id, ts, 'job-' || user_id || '-' || CAST(floor(epoch(ts) / 86400) AS BIGINT) AS job_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events),
je AS (SELECT *, CASE k % 40 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'CANCELLED' WHEN 2 THEN 'COMPLETE' ELSE ['PREPARED', 'INJECTED', 'RECEIVING', 'ASSEMBLING'][k % 4 + 1] END AS status, k % 40 < 3 AS term FROM ev)
SELECT job_id, coalesce(arg_min(status, (ts, event_id)) FILTER (term), arg_max(status, (ts, event_id))) AS status, bool_or(term) AS terminal, count(*) AS n_events FROM je GROUP BY job_id""",
    "read_packages": """SELECT 'doc-' || doc_id AS package_id, CASE WHEN doc_id % 29 = 0 THEN '' WHEN doc_id % 11 = 0 THEN '../a.txt' WHEN doc_id % 13 = 0 THEN '/a.txt' ELSE 'docs/a.txt' END AS path, CASE WHEN doc_id % 29 <> 0 THEN sha256(text) END AS sha256,
  CASE WHEN doc_id % 29 = 0 THEN 'ARCHIVE_INVALID' WHEN doc_id % 11 = 0 THEN 'PATH_UNSAFE' WHEN doc_id % 13 = 0 THEN 'PATH_NOT_RELATIVE' WHEN doc_id % 17 = 0 THEN 'DUPLICATE_PATH' END AS issue FROM documents
UNION ALL SELECT 'doc-' || doc_id, CASE WHEN doc_id % 11 = 0 THEN '../a.txt' WHEN doc_id % 13 = 0 THEN '/a.txt' ELSE 'docs/a.txt' END, sha256(text), CASE WHEN doc_id % 11 = 0 THEN 'PATH_UNSAFE' WHEN doc_id % 13 = 0 THEN 'PATH_NOT_RELATIVE' ELSE 'DUPLICATE_PATH' END FROM documents WHERE doc_id % 17 = 0 AND doc_id % 29 <> 0
UNION ALL SELECT 'doc-' || doc_id, 'manifest.json', sha256('{}'), NULL FROM documents WHERE doc_id % 29 <> 0""",
    "exact_inventory": f"WITH {_PACKAGES} SELECT package_id, path, issue FROM inv",
    "verify_files": f"WITH {_PACKAGES} SELECT package_id, path, issue FROM ver",
    "path_difference": f"WITH {_PACKAGES} SELECT package_id, path, 'MISSING' AS difference FROM (SELECT package_id, path FROM mf EXCEPT SELECT package_id, path FROM fl) UNION ALL SELECT package_id, path, 'EXTRA' FROM (SELECT package_id, path FROM fl EXCEPT SELECT package_id, path FROM mf)",
    "package_verdicts": f"""WITH {_PACKAGES}, allx AS (SELECT * FROM inv UNION ALL SELECT * FROM ver), rk AS (SELECT *, list_position({_ORDER}, issue) AS r FROM allx)
SELECT package_id, CASE WHEN ni IS NULL THEN 'PASS' ELSE 'FAIL' END AS state, first_issue, first_path, coalesce(ni, 0) AS n_issues FROM hd LEFT JOIN (SELECT package_id, count(*) AS ni, arg_min(issue, (r, issue, path)) AS first_issue, arg_min(path, (r, issue, path)) AS first_path FROM rk GROUP BY ALL) USING (package_id)""",
    "route_by_version": f"""SELECT route, count(*) AS n, count_if(route = 'RUNTIME_1_4') AS n_with_state FROM (SELECT CASE WHEN f = 'runtime_package' AND v = '1.4.0' THEN 'RUNTIME_1_4' WHEN f = 'runtime_package' AND v = '1.3.0' THEN 'RUNTIME_1_3' WHEN f = 'source_bundle' THEN 'SOURCE' WHEN f = 'runtime_package' AND v = '1.2.10' THEN 'RUNTIME_LEGACY' ELSE 'UNSUPPORTED' END AS route
  FROM (SELECT {_FAMILY} AS f, {_VERSION} AS v FROM documents)) GROUP BY route""",
    "write_evidence": f"WITH {_PACKAGES} SELECT package_id, path, CAST(nb AS BIGINT) AS bytes, 'sha256:' || sha AS sha256 FROM fl",
}
