"""Streaming queries: file streams over the given tables, run to the end, with oracle SQL of the batch meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagefacts import fixed
from pagefacts.operators import sessions
from pagefacts.plans import derive
from pagefacts.plans.package_queries import _CHUNKS
from pagefacts.plans.session_queries import _observed
from pagefacts.plans.stored import stored_path
from pagefacts.streaming import processors
from pagefacts.streaming.runner import file_stream, latest_per_key, run_available


def _chunk_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk messages cut from the streamed documents (stateless, so it runs inside the stream)."""
    documents = file_stream(spark, sf_dir, "documents.parquet").select("doc_id", "text")
    total = F.greatest(F.lit(1), F.ceil(F.length("text") / derive.CHUNK_CHARACTERS)).cast("int").alias("total")
    pieces = documents.select("doc_id", "text", total, F.explode(F.sequence(F.lit(0), total - 1)).alias("chunk_index"))
    pieces = pieces.withColumn("data", F.expr(f"substring(text, {derive.CHUNK_CHARACTERS} * chunk_index + 1, {derive.CHUNK_CHARACTERS})")).drop("text")
    rows = derive.chunk_columns(pieces, "total")
    return rows.withColumns({"job_active": F.col("doc_id") % 6 < 4, "max_bytes": F.lit(fixed.MAX_SNAPSHOT_BYTES).cast("bigint")})


def ingest_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = run_available(processors.ingest_chunks(_chunk_stream(spark, sf_dir)), "ingest")
    return out.select("job_id", "chunk_index", "copy", "outcome", F.coalesce("reason", F.lit("-")).alias("reason"))


def read_chunk_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk messages committed once each, counted per job."""
    committed = run_available(_chunk_stream(spark, sf_dir), "commit")
    return committed.groupBy("job_id").agg(F.count("*").alias("n_messages"), F.sum("byte_length").cast("bigint").alias("n_bytes"))


def assemble_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    intact = _chunk_stream(spark, sf_dir).filter("copy < 2 AND sha256 = sha2(data, 256)")
    return run_available(processors.assemble_stream(intact), "assemble").drop("text")


def _job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = file_stream(spark, sf_dir, "events.parquet").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"))
    status = F.when(F.col("k") % 40 == 0, "FAILED").when(F.col("k") % 40 == 1, "CANCELLED").when(F.col("k") % 40 == 2, "COMPLETE").otherwise(
        F.element_at(F.array(*[F.lit(s) for s in ("PREPARED", "INJECTED", "RECEIVING", "ASSEMBLING")]), F.col("k") % 4 + 1))
    return derive.job_event_columns(events, status)


def job_state_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last applied event per job."""
    out = run_available(processors.job_state_stream(_job_events(spark, sf_dir)), "jobs").filter("applied")
    last = out.groupBy("job_id").agg(F.max(F.struct("event_time", "event_id", "status")).alias("l"), F.count("*").alias("n_applied"))
    return last.select("job_id", F.col("l.status").alias("status"), "n_applied")


def stale_job_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that timers interrupted: all silent ones but those inside the watermark at the end of the stream."""
    out = run_available(processors.stale_job_stream(_job_events(spark, sf_dir)), "stale", "append")
    return out.filter("status = 'INTERRUPTED'").select("job_id", F.date_format("event_time", "yyyy-MM-dd HH:mm:ss").alias("interrupted_at"))


def readiness_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = stored_path(spark, sf_dir, "readiness_samples", derive.readiness_samples)
    stream = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
    out = run_available(processors.readiness_stream(stream), "readiness")
    return out.select("capture_id", "process_state", "sample_count", F.coalesce("final_document_width", F.lit(-1.0)).alias("final_document_width"))


def readiness_timeout_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures begin an hour apart by user; most stop before they are stable."""
    folder = stored_path(spark, sf_dir, "timed_samples", _timed_samples)
    stream = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
    out = run_available(processors.readiness_timeout_stream(stream, watermark="1 hour"), "readiness-timeout")
    return out.select("capture_id", "process_state", "sample_count", F.coalesce("final_document_width", F.lit(-1.0)).alias("final_document_width"))


def _timed_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.regexp_extract("capture_id", "([0-9]+)", 1).cast("bigint") * 3_600_000 + 1_704_067_200_000
    millis = start + F.when(F.startswith("capture_id", F.lit("guided")), 1_800_000).otherwise(0) + F.col("elapsed_ms").cast("bigint")
    samples = derive.readiness_samples(spark, sf_dir)
    return samples.withColumn("event_time", F.timestamp_millis(millis))


def job_recovery_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a job and its chunks, from one stream of documents; the last minute of jobs stays open."""
    documents = file_stream(spark, sf_dir, "documents.parquet").select("doc_id", "text")
    at = F.timestamp_add("SECOND", F.col("doc_id").cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("event_time")
    jobs = derive.job_columns(documents).select("job_id", at, F.lit("JOB").alias("kind"), "status", F.col("expected_chunks").alias("total"), "max_bytes", "full_sha256")
    chunks = derive.chunk_columns(derive.pieces(documents)).select("job_id", at, F.lit("CHUNK").alias("kind"), "chunk_index", "data", "byte_length", "sha256")
    out = run_available(processors.job_recovery_stream(jobs.unionByName(chunks, allowMissingColumns=True), watermark="61500 milliseconds"), "recovery")
    return out.select("job_id", "action", F.coalesce("reason", F.lit("-")).alias("reason"), "n_chunks", "n_bytes", F.coalesce("text_sha256", F.lit("-")).alias("text_sha256"))


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = sessions.context_match(derive.sessions(spark, sf_dir), derive.imported_contexts(spark, sf_dir)).select(
        "session_id", "context_known", F.col("reference_digest").alias("session_reference"),
        (F.col("selected_document_id").isNotNull() & F.coalesce(F.col("confirmation_state") == "CONFIRMED", F.lit(False))).alias("context_confirmed"))
    rows = derive.observations(spark, sf_dir).join(known, "session_id")
    return rows.select("session_id", "snapshot_id", "observation_index", "requested_profile", "inner_width", "page_fingerprint", "reference_digest",
                       "context_known", "session_reference", "context_confirmed", processors.environment_code_column().alias("environment_codes"))


def admission_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = stored_path(spark, sf_dir, "attempts", _attempts)
    stream = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
    return run_available(processors.admission_stream(stream), "admission")


def _capture_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures in files of the size that Spark's advice names: a batch is a few files, and small ones make many batches."""
    return derive.capture_rows(spark, sf_dir).hint("rebalance")


def session_rollup_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = stored_path(spark, sf_dir, "captures", _capture_files)
    stream = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 2).parquet(folder)
    table = run_available(processors.session_rollup_stream(stream), "rollup", "update")
    out = latest_per_key(table, "session_id", "version")
    return out.select("session_id", "status", "capture_count", F.date_format("last_captured_at", "yyyy-MM-dd HH:mm:ss").alias("last_captured_at"))


QUERIES = {f.__name__: f for f in (
    ingest_chunks, read_chunk_stream, assemble_stream, job_state_stream, stale_job_stream, job_recovery_stream, readiness_stream, readiness_timeout_stream, admission_stream, session_rollup_stream)}

_JOBS = """ev AS (SELECT event_id, ts, 'job-' || user_id || '-' || CAST(floor(epoch(ts) / 86400) AS BIGINT) AS job_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events),
je AS (SELECT *, CASE k % 40 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'CANCELLED' WHEN 2 THEN 'COMPLETE' ELSE ['PREPARED', 'INJECTED', 'RECEIVING', 'ASSEMBLING'][k % 4 + 1] END AS status, k % 40 < 3 AS term FROM ev),
ja AS (SELECT *, coalesce(bool_or(term) OVER (PARTITION BY job_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS ended FROM je)"""

_SAMPLES = """, rs0 AS (SELECT session_id AS capture_id, pure_index AS n, pure_index * 100.0 AS e, CASE WHEN k < 50 THEN 1000.0 ELSE 1010.0 END AS w, k = 97 AND user_id % 3 = 0 AS bad, k % 25 <> 0 AND k % 20 <> 1 AND k % 15 <> 2 AS ready FROM ob),
rs1 AS (SELECT *, n = 0 OR coalesce(lag(e) OVER w1 < 1500, false) AS seen, coalesce(lag(w) OVER w1 = w AND NOT bad AND NOT lag(bad) OVER w1, false) AND ready AS ok FROM rs0 WINDOW w1 AS (PARTITION BY capture_id ORDER BY n)),
rr AS (SELECT *, seen AND ok AND coalesce(lag(ok, 1) OVER w2, false) AND coalesce(lag(ok, 2) OVER w2, false) AS run FROM rs1 WINDOW w2 AS (PARTITION BY capture_id ORDER BY n))"""

ORACLES = {
    # The byte cap is sequential: a chunk that does not fit is left out and later, smaller ones may still fit.
    "ingest_chunks": f"""WITH RECURSIVE {_CHUNKS}, base AS (SELECT ch.*, jb.active, octet_length(encode(data)) AS nb, octet_length(encode(data)) = bl AND sha = sha256(data) AS good FROM ch JOIN jb USING (job_id)),
c0 AS MATERIALIZED (SELECT job_id, chunk_index, nb, row_number() OVER (PARTITION BY job_id ORDER BY chunk_index) AS rn FROM base WHERE copy = 0 AND good AND active),
rec AS (SELECT job_id, chunk_index, rn, nb <= 12000000 AS fits, CASE WHEN nb <= 12000000 THEN nb ELSE 0 END AS used FROM c0 WHERE rn = 1
  UNION ALL SELECT c.job_id, c.chunk_index, c.rn, r.used + c.nb <= 12000000, r.used + CASE WHEN r.used + c.nb <= 12000000 THEN c.nb ELSE 0 END FROM rec r JOIN c0 c ON c.job_id = r.job_id AND c.rn = r.rn + 1),
v AS (SELECT base.*, CASE WHEN NOT active THEN 'JOB_NOT_ACTIVE' WHEN NOT good THEN 'CHUNK_INTEGRITY' WHEN NOT fits THEN 'SNAPSHOT_SIZE_LIMIT' WHEN copy = 2 THEN 'CONFLICTING_DUPLICATE' END AS r FROM base LEFT JOIN rec USING (job_id, chunk_index))
SELECT job_id, chunk_index, copy, CASE WHEN r IS NOT NULL THEN 'REJECTED' WHEN copy = 1 THEN 'DUPLICATE' ELSE 'ACCEPTED' END AS outcome, coalesce(r, '-') AS reason FROM v""",
    "read_chunk_stream": f"WITH {_CHUNKS} SELECT job_id, count(*) AS n_messages, CAST(sum(bl) AS BIGINT) AS n_bytes FROM ch GROUP BY job_id",
    "assemble_stream": f"""WITH {_CHUNKS}, okc AS (SELECT DISTINCT job_id, chunk_index, data FROM ch WHERE copy < 2 AND sha = sha256(data)),
a AS (SELECT job_id, count(*) AS n, CAST(sum(octet_length(encode(data))) AS BIGINT) AS b, sha256(string_agg(data, '' ORDER BY chunk_index)) AS h FROM okc GROUP BY ALL)
SELECT job_id, CAST(a.n AS INT) AS n_chunks, a.b AS n_bytes, h AS text_sha256 FROM a JOIN jb USING (job_id) WHERE a.n = expected_chunks""",
    "job_state_stream": f"WITH {_JOBS} SELECT job_id, arg_max(status, (ts, event_id)) AS status, count(*) AS n_applied FROM ja WHERE NOT ended GROUP BY job_id",
    "readiness_stream": _observed("""SELECT capture_id, CASE WHEN failed THEN 'ERROR' WHEN stop IS NOT NULL THEN 'STABLE' ELSE 'TIMEOUT' END AS process_state, CAST(CASE WHEN failed THEN bad_at ELSE coalesce(stop, last_n) END + 1 AS INT) AS sample_count,
  CAST(CASE WHEN failed THEN -1.0 ELSE coalesce(stop_w, last_w) END AS DOUBLE) AS final_document_width FROM (SELECT *, coalesce(bad_at <= coalesce(stop, last_n), false) AS failed FROM (
  SELECT capture_id, min(CASE WHEN run THEN n END) AS stop, max(n) FILTER (seen) AS last_n, arg_max(w, n) FILTER (seen) AS last_w, arg_min(w, n) FILTER (run) AS stop_w, min(CASE WHEN bad AND seen THEN n END) AS bad_at, bool_or(NOT seen) AS more FROM rr GROUP BY capture_id)) WHERE failed OR stop IS NOT NULL OR more""",
        _SAMPLES),
    "readiness_timeout_stream": _observed("""SELECT capture_id, CASE WHEN failed THEN 'ERROR' WHEN stop IS NOT NULL THEN 'STABLE' ELSE 'TIMEOUT' END AS process_state, CAST(CASE WHEN failed THEN bad_at ELSE coalesce(stop, last_n) END + 1 AS INT) AS sample_count,
  CAST(CASE WHEN failed THEN -1.0 ELSE coalesce(stop_w, last_w) END AS DOUBLE) AS final_document_width FROM (SELECT *, coalesce(bad_at <= coalesce(stop, last_n), false) AS failed FROM (
  SELECT capture_id, min(CASE WHEN run THEN n END) AS stop, max(n) FILTER (seen) AS last_n, arg_max(w, n) FILTER (seen) AS last_w, arg_min(w, n) FILTER (run) AS stop_w, min(CASE WHEN bad AND seen THEN n END) AS bad_at, bool_or(NOT seen) AS more FROM rr GROUP BY capture_id)) JOIN (SELECT capture_id, CAST(regexp_extract(capture_id, '([0-9]+)', 1) AS BIGINT) * 3600000 + CASE WHEN capture_id LIKE 'guided%' THEN 1800000 ELSE 0 END AS began FROM rs0 GROUP BY ALL) b USING (capture_id)
  WHERE failed OR stop IS NOT NULL OR more OR began + 1500 <= (SELECT max(CAST(regexp_extract(capture_id, '([0-9]+)', 1) AS BIGINT) * 3600000 + CASE WHEN capture_id LIKE 'guided%' THEN 1800000 ELSE 0 END + e) - 3600000 FROM rs0)""",
        _SAMPLES),
    # A job that is active at its last event is interrupted once the stream's time has passed that event by the stale time.
    "stale_job_stream": f"""WITH {_JOBS}, l AS (SELECT job_id, arg_max(status, (ts, event_id)) AS status, max(ts) AS last_at FROM ja WHERE NOT ended GROUP BY job_id)
SELECT job_id, strftime(last_at + INTERVAL 30 SECOND, '%Y-%m-%d %H:%M:%S') AS interrupted_at FROM l WHERE status IN ('PREPARED', 'INJECTED', 'RECEIVING', 'ASSEMBLING') AND last_at + INTERVAL 30 SECOND <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM ev)""",
    "job_recovery_stream": f"""WITH {_CHUNKS}, whole AS (SELECT job_id, sha256(string_agg(data, '' ORDER BY chunk_index)) AS h FROM dc GROUP BY ALL),
rs AS (SELECT jt.job_id, updated_at, active, h, n, b, CASE WHEN n <> expected_chunks OR lo <> 0 OR hi <> expected_chunks - 1 THEN 'CHUNK_SEQUENCE' WHEN conflict THEN 'CONFLICTING_DUPLICATE'
  WHEN legacy AND full_sha256 IS NULL THEN 'LEGACY_INTEGRITY_UNAVAILABLE' WHEN b > 12000000 THEN 'ASSEMBLED_SIZE' WHEN NOT intact THEN 'CHUNK_INTEGRITY' WHEN full_sha256 IS NOT NULL AND full_sha256 <> h THEN 'ASSEMBLED_CHECKSUM' END AS r
  FROM jt LEFT JOIN whole USING (job_id))
SELECT job_id, CASE WHEN r IS NULL THEN 'COMPLETE' WHEN r = 'CHUNK_SEQUENCE' THEN 'INTERRUPTED' ELSE 'FAILED' END AS action, coalesce(r, '-') AS reason, CAST(n AS INT) AS n_chunks, b AS n_bytes, CASE WHEN r IS NULL THEN h ELSE '-' END AS text_sha256
FROM rs WHERE active AND updated_at + INTERVAL 30 SECOND <= (SELECT max(updated_at) - INTERVAL 61500 MILLISECOND FROM rs)""",
    "session_rollup_stream": _observed("""SELECT session_id, CASE WHEN bool_and(status = 'COMPLETE') THEN 'COMPLETE' ELSE 'PARTIAL' END AS status, CAST(count(DISTINCT snapshot_id) AS INT) AS capture_count, strftime(max(captured_at), '%Y-%m-%d %H:%M:%S') AS last_captured_at FROM cap GROUP BY session_id"""),
}
