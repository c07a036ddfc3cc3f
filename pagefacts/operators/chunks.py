"""Chunked transfers and the jobs that own them (batch side; `streaming` holds the live twins)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagefacts import fixed
from pagefacts.functions.patterns import compact, utf16_length


def is_active() -> Column:
    return F.col("status").isin(*fixed.ACTIVE_JOB_STATES)


def orphan_chunks(chunks: DataFrame, jobs: DataFrame) -> DataFrame:
    return chunks.join(jobs.filter(is_active()).select("job_id"), "job_id", "left_anti")


def distinct_chunks(chunks: DataFrame) -> DataFrame:
    """One row per (job, index): repeats collapse, differing repeats are marked, the bytes are checked once."""
    checked = chunks.withColumns({"_actual": F.sha2("data", 256), "_size": F.octet_length("data")})
    intact = (F.col("_size") == F.col("byte_length")) & ((F.col("sha256") == F.col("_actual")) | (F.col("sha256") == fixed.LEGACY_CHUNK_HASH))
    return checked.withColumn("_intact", F.coalesce(intact, F.lit(False))).groupBy("job_id", "chunk_index").agg(
        F.count("*").alias("n_copies"), (F.min("_actual") != F.max("_actual")).alias("conflicting"), F.bool_and("_intact").alias("intact"),
        F.min("_size").alias("n_bytes"), F.bool_or(F.col("sha256") == fixed.LEGACY_CHUNK_HASH).alias("legacy"))


def chunk_totals(chunks: DataFrame, jobs: DataFrame) -> DataFrame:
    """Stored chunks and bytes per active job against its limits."""
    totals = distinct_chunks(chunks).groupBy("job_id").agg(F.count("*").alias("count"), F.sum("n_bytes").alias("bytes"))
    out = jobs.filter(is_active()).select("job_id", "max_bytes").join(totals, "job_id", "left").fillna(0, ["count", "bytes"])
    return out.withColumn("over_limit", (F.col("count") > fixed.MAX_CHUNKS) | (F.col("bytes") > F.col("max_bytes"))).drop("max_bytes")


def chunk_issues(chunks: DataFrame, jobs: DataFrame) -> DataFrame:
    """Chunks that fail their own checks, and jobs whose sequence is broken."""
    rows = chunks.join(jobs.select("job_id", "expected_chunks", "full_sha256"), "job_id")
    legacy = F.col("sha256") == fixed.LEGACY_CHUNK_HASH
    found = compact(
        F.when(F.octet_length("data") != F.col("byte_length"), "BYTE_LENGTH"), F.when(~legacy & (F.sha2("data", 256) != F.col("sha256")), "CHECKSUM"),
        F.when(legacy & F.col("full_sha256").isNull(), "LEGACY_WITHOUT_FULL_CHECKSUM"),
        F.when((F.col("chunk_index") < 0) | (F.col("chunk_index") >= F.col("expected_chunks")), "INDEX_RANGE"),
        F.when((utf16_length(F.col("data")) > fixed.MAX_CHUNK_CHARACTERS) | (F.col("byte_length") > fixed.MAX_CHUNK_BYTES), "CHUNK_SIZE"))
    each = rows.select("job_id", "chunk_index", F.explode(found).alias("issue"))
    counted = chunks.groupBy("job_id").agg(F.countDistinct("chunk_index").alias("_d"), F.min("chunk_index").alias("_low"), F.max("chunk_index").alias("_high"))
    broken = jobs.join(counted, "job_id").filter(
        (F.col("_d") != F.col("expected_chunks")) | (F.col("_low") != 0) | (F.col("_high") != F.col("expected_chunks") - 1))
    return each.unionByName(broken.select("job_id", F.lit(-1).alias("chunk_index"), F.lit("CHUNK_SEQUENCE").alias("issue")))


def assemble_chunks(chunks: DataFrame, jobs: DataFrame) -> DataFrame:
    """Whole texts of complete jobs, or the reason why a job has none.

    Every rule but the last is decided on aggregates.  Text is gathered only for jobs that passed them, which
    bounds a gathered group by the byte limit of its job and by the chunk limit.
    """
    parts = distinct_chunks(chunks).groupBy("job_id").agg(
        F.count("*").alias("n_chunks"), F.min("chunk_index").alias("_low"), F.max("chunk_index").alias("_high"), F.sum("n_bytes").alias("n_bytes"),
        F.bool_or("conflicting").alias("_conflict"), F.bool_and("intact").alias("_intact"), F.bool_or("legacy").alias("_legacy"))
    out = jobs.join(parts, "job_id", "left").fillna(0, ["n_chunks", "n_bytes"])
    reason = (
        F.when((F.col("n_chunks") > fixed.MAX_CHUNKS) | (F.col("n_chunks") != F.col("expected_chunks")) | (F.col("_low") != 0)
               | (F.col("_high") != F.col("expected_chunks") - 1), "CHUNK_SEQUENCE")
        .when(F.col("_conflict"), "CONFLICTING_DUPLICATE").when(F.col("_legacy") & F.col("full_sha256").isNull(), "LEGACY_INTEGRITY_UNAVAILABLE")
        .when(F.col("n_bytes") > F.col("max_bytes"), "ASSEMBLED_SIZE").when(~F.col("_intact"), "CHUNK_INTEGRITY")
    )
    judged = out.withColumn("_reason", reason)
    fit = judged.filter("_reason IS NULL").select("job_id")
    gathered = chunks.join(fit, "job_id", "left_semi").dropDuplicates(["job_id", "chunk_index"]).groupBy("job_id").agg(
        F.array_sort(F.collect_list(F.struct("chunk_index", "data"))).alias("_parts"))
    texts = gathered.select("job_id", F.array_join(F.transform("_parts", lambda p: p["data"]), "").alias("text"))
    joined = judged.join(texts, "job_id", "left")
    wrong = F.col("text").isNotNull() & F.col("full_sha256").isNotNull() & (F.sha2("text", 256) != F.col("full_sha256"))
    final = F.coalesce("_reason", F.when(wrong, "ASSEMBLED_CHECKSUM"))
    return joined.select("job_id", final.isNull().alias("ok"), final.alias("reason"), F.when(final.isNull(), F.col("text")).alias("text"), "n_chunks", "n_bytes")


def stale_jobs(jobs: DataFrame, chunks: DataFrame, now: Column, seconds: int = fixed.STALE_JOB_SECONDS) -> DataFrame:
    """What recovery does with every active job at `now`."""
    parts = distinct_chunks(chunks).groupBy("job_id").agg(F.count("*").alias("_n"), F.max("chunk_index").alias("_high"), F.bool_or("legacy").alias("_legacy"))
    out = jobs.filter(is_active()).join(parts, "job_id", "left")
    whole = F.coalesce((F.col("_n") == F.col("expected_chunks")) & (F.col("_high") == F.col("expected_chunks") - 1), F.lit(False))
    stale = F.coalesce(F.unix_micros(now) - F.unix_micros("updated_at") >= seconds * 1_000_000, F.lit(True))
    action = F.when(F.col("_legacy"), "FAILED").when(whole, "FINALIZE").when(stale, "INTERRUPTED").otherwise("KEEP")
    return out.select("job_id", "status", action.alias("action"))


def retention_candidates(jobs: DataFrame, now: Column, days: int = fixed.RETENTION_DAYS, last_run: Column | None = None) -> DataFrame:
    """Terminal jobs that were last touched before the retention window; none before maintenance is due again, where `last_run` is given."""
    old = F.coalesce(F.unix_micros(now) - F.unix_micros("updated_at") >= days * 86_400_000_000, F.lit(True))
    due = F.lit(True) if last_run is None else maintenance_due(last_run, now)
    return jobs.filter(~is_active() & old & due)


def maintenance_due(last_run: Column, now: Column, seconds: int = fixed.MAINTENANCE_INTERVAL_SECONDS) -> Column:
    return F.coalesce(F.unix_micros(now) - F.unix_micros(last_run) >= seconds * 1_000_000, F.lit(True))


def active_conflicts(jobs: DataFrame) -> DataFrame:
    """Active jobs that share their tab or their session with another active job."""
    def busy(key: str) -> DataFrame:
        return jobs.filter(is_active()).groupBy(key).agg(F.count("*").alias(f"_n_{key}"))

    active = jobs.filter(is_active())
    out = active.join(busy("tab_id"), "tab_id").join(busy("session_id"), "session_id")
    return out.select("job_id", (F.col("_n_tab_id") > 1).alias("tab_conflict"), (F.col("_n_session_id") > 1).alias("session_conflict"))


def job_states(events: DataFrame) -> DataFrame:
    """Current state per job: the first terminal state absorbs everything after it."""
    at = F.struct("event_time", "event_id")
    terminal = F.col("status").isin(*fixed.TERMINAL_JOB_STATES)
    out = events.groupBy("job_id").agg(
        F.min(F.when(terminal, F.struct(at.alias("at"), "status"))).alias("_end"), F.max(F.struct(at.alias("at"), "status")).alias("_last"), F.count("*").alias("n_events"))
    return out.select("job_id", F.coalesce("_end.status", "_last.status").alias("status"), F.col("_end").isNotNull().alias("terminal"), "n_events")
