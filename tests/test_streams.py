import datetime as dt
import hashlib
import os

import pytest

from pyspark.sql import Row

from pagefacts import fixed
from pagefacts.streaming import processors
from pagefacts.streaming.runner import file_stream, run_available

SAMPLES = ("capture_id string, sample_no int, elapsed_ms double, doc_w double, doc_h double, view_w double, view_h double, ready_state string, fonts_loaded boolean, "
           "unresolved_images int, event_time timestamp")
EVENTS = ("job_id string, event_time timestamp, kind string, status string, total int, max_bytes long, full_sha256 string, chunk_index int, data string, byte_length long, "
          "sha256 string")


@pytest.fixture
def streamed(spark, tmp_path):
    """A stream that reads the given rows in the given batches, one file each."""

    def make(batches, schema):
        folder = tmp_path / f"in-{len(os.listdir(tmp_path))}"
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
            for name in os.listdir(folder):
                if name.startswith("part") and not os.path.exists(f"{folder}/.{name}.seen"):
                    open(f"{folder}/.{name}.seen", "w").close()
                    os.utime(f"{folder}/{name}", (1_700_000_000 + i * 10,) * 2)
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))

    return make


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def sample(capture, no, second, elapsed, width=1000.0):
    return (capture, no, elapsed, width, 1.0, 1.0, 1.0, "complete", True, 0, at(second))


@pytest.mark.parametrize("cut", [1, 2, 5])
def test_silent_captures_get_a_verdict(streamed, cut):
    """Whatever the cut into batches: one capture is stable, one falls silent, one is still within its time when the stream ends."""
    rows = [sample("silent", 0, 0, 0.0), sample("silent", 1, 1, 1000.0, 1010.0), *(sample("stable", i, 2 + i, i * 100.0) for i in range(5)), sample("late", 0, 9, 0.0)]
    batches = [rows[i::cut] for i in range(cut)]
    batches = [sorted(b, key=lambda r: r[-1]) for b in batches]
    out = run_available(processors.readiness_timeout_stream(streamed(batches, SAMPLES), 1500, "5 seconds"), "timed").collect()
    assert sorted((r.capture_id, r.process_state, r.sample_count) for r in out) in (
        [("silent", "TIMEOUT", 2), ("stable", "STABLE", 4)],)


def chunk(job, second, index, data, sha=None):
    return (job, at(second), "CHUNK", None, None, None, None, index, data, len(data.encode()), sha or hashlib.sha256(data.encode()).hexdigest())


def job(name, second, total, text, status="RECEIVING", most=100):
    return (name, at(second), "JOB", status, total, most, None if text is None else hashlib.sha256(text.encode()).hexdigest(), None, None, None, None)


@pytest.mark.parametrize("cut", [1, 3])
def test_recovery_decides_by_what_is_there(streamed, cut):
    rows = [
        job("whole", 0, 2, "abcd"), chunk("whole", 1, 1, "cd"), chunk("whole", 2, 0, "ab"), chunk("whole", 2, 0, "ab"),
        job("gap", 0, 3, "abcd"), chunk("gap", 1, 0, "ab"), job("conflict", 0, 1, "x"), chunk("conflict", 1, 0, "x"), chunk("conflict", 1, 0, "y"),
        job("wrong", 0, 1, "other"), chunk("wrong", 1, 0, "x"), job("large", 0, 1, "xyz", most=2), chunk("large", 1, 0, "xyz"),
        job("broken", 0, 1, None), chunk("broken", 1, 0, "x", "0" * 64), job("done", 0, 1, "x", status="COMPLETE"), chunk("orphan", 1, 0, "x"),
        job("open", 95, 1, "x"), job("clock", 100, 1, "x")]
    batches = [rows[i::cut] for i in range(cut - 1)] + [rows[cut - 1::cut]] if cut > 1 else [rows]
    late = [r for r in rows if r[0] in ("open", "clock")]
    batches = [[r for r in b if r not in late] for b in batches] + [late]
    out = run_available(processors.job_recovery_stream(streamed(batches, EVENTS), 30, "20 seconds"), "recovered").collect()
    assert {(r.job_id, r.action, r.reason, r.text_sha256) for r in out} == {
        ("whole", "COMPLETE", None, hashlib.sha256(b"abcd").hexdigest()), ("gap", "INTERRUPTED", "CHUNK_SEQUENCE", None), ("conflict", "FAILED", "CONFLICTING_DUPLICATE", None),
        ("wrong", "FAILED", "ASSEMBLED_CHECKSUM", None), ("large", "FAILED", "ASSEMBLED_SIZE", None), ("broken", "FAILED", "CHUNK_INTEGRITY", None)}
    assert next(r.decided_at for r in out if r.job_id == "whole") == at(32)


@pytest.mark.parametrize("files", [1, 3])
def test_a_table_streams_from_a_file_and_from_a_folder_of_files(spark, tmp_path, files):
    made = spark.createDataFrame([(i, f"t{i}") for i in range(30)], "doc_id long, text string")
    made.repartition(files).write.parquet(str(tmp_path / "made"))
    found = sorted(n for n in os.listdir(tmp_path / "made") if n.startswith("part"))
    if files == 1:
        os.rename(tmp_path / "made" / found[0], tmp_path / "documents.parquet")
    else:
        os.rename(tmp_path / "made", tmp_path / "documents.parquet")
    made.limit(3).coalesce(1).write.parquet(str(tmp_path / "other.parquet"))
    out = run_available(file_stream(spark, str(tmp_path), "documents.parquet"), "table").collect()
    assert sorted(r.doc_id for r in out) == list(range(30))


class Calls:
    """State of one key in memory; counts the calls, each of which is a round trip to the state store."""

    def __init__(self):
        self.n, self.values, self.timers = 0, {}, []

    def get(self):
        self.n += 1
        return self.values.get(None)

    def update(self, value):
        self.n += 1
        self.values[None] = value

    def getValue(self, key):
        self.n += 1
        return self.values.get(key)

    def updateValue(self, key, value):
        self.n += 1
        self.values[key] = value

    def registerTimer(self, at_ms):
        self.n += 1
        self.timers.append(at_ms)

    def listTimers(self):
        self.n += 1
        return iter(list(self.timers))

    def deleteTimer(self, at_ms):
        self.n += 1
        self.timers.remove(at_ms)


def test_a_new_job_takes_three_state_calls():
    jobs, state, timers = processors.JobStates(30), Calls(), Calls()
    jobs.state, jobs.handle = state, timers
    event = lambda no, us, status: Row(job_id="j", event_id=no, at_us=us, status=status)
    out = list(jobs.handleInputRows(("j",), iter([event(3, None, "RECEIVING"), event(2, 2_000_000, "INJECTED"), event(1, 1_000_000, "PREPARED")]), None))
    assert [(r.event_id, r.applied) for r in out] == [(1, True), (2, True), (3, True)] and (state.n, timers.n) == (2, 1)
    list(jobs.handleInputRows(("j",), iter([event(4, 9_000_000, "RECEIVING")]), None))
    assert timers.timers == [39_000]
    assert [(r.at_us, r.status) for r in jobs.handleExpiredTimer(("j",), None, None)] == [(39_000_000, "INTERRUPTED")]
    ended = "INTERRUPTED" in fixed.TERMINAL_JOB_STATES
    assert [r.applied for r in jobs.handleInputRows(("j",), iter([event(5, 99_000_000, "COMPLETE")]), None)] == [not ended]


def test_known_captures_are_not_written_again():
    rollup, totals, captures = processors.SessionRollup(), Calls(), Calls()
    rollup.totals, rollup.captures = totals, captures
    capture = lambda name, us, status="COMPLETE": Row(session_id="s", snapshot_id=name, at_us=us, status=status)
    first = list(rollup.handleInputRows(("s",), iter([capture("b", 2), capture("a", 1, "PARTIAL"), capture("b", 2)]), None))
    assert [(r.version, r.status, r.capture_count, r.last_us) for r in first] == [(1, "PARTIAL", 2, 2)] and captures.n == 2
    then = list(rollup.handleInputRows(("s",), iter([capture("b", 2), capture("a", 5)]), None))
    assert [(r.version, r.status, r.capture_count, r.last_us) for r in then] == [(2, "COMPLETE", 2, 5)] and captures.n == 5


class Value(Calls):
    def exists(self):
        self.n += 1
        return None in self.values

    def clear(self):
        self.n += 1
        self.values.clear()


def test_a_small_session_takes_two_state_calls_a_batch():
    rollup, calls = processors.CompactRollup(), [Calls(), Calls(), Calls()]
    rollup.totals, rollup.captures, rollup.held = calls
    rollup.MOST_HELD = 4
    capture = lambda name, us, status="COMPLETE": Row(session_id="s", snapshot_id=name, at_us=us, status=status)
    batches = [[capture("b", 2), capture("a", 1, "PARTIAL"), capture("b", 2)], [capture("c", None), capture("a", 5)], [capture("d", 3, "PARTIAL"), capture("e", 4)], [capture("d", 9)]]
    plain = processors.SessionRollup()
    plain.totals, plain.captures = Calls(), Calls()
    said = []
    for number, batch in enumerate(batches):
        said += list(rollup.handleInputRows(("s",), iter(batch), None))
        assert number > 1 or [c.n for c in calls] == [0, 0, 2 * (number + 1)]
    assert said == [row for batch in batches for row in plain.handleInputRows(("s",), iter(batch), None)]
    assert (said[-1].capture_count, said[-1].status, calls[1].n) == (5, "COMPLETE", 7)


def test_a_new_job_is_recovered_by_few_state_calls():
    recovery, first, later, timers = processors.Recovery(30), Value(), Value(), Calls()
    recovery.first, recovery.later, recovery.handle = first, later, timers
    names = [part.split()[0] for part in EVENTS.split(", ")]
    row = lambda values: Row(**dict(zip(names, values, strict=True)), at_us=int((values[1] - at(0)).total_seconds() * 1e6))
    events = [job("j", 0, 2, "abcd"), chunk("j", 1, 1, "cd"), chunk("j", 2, 0, "ab"), chunk("j", 2, 0, "ab")]
    assert not list(recovery.handleInputRows(("j",), iter(map(row, events)), None))
    assert (first.n, later.n, timers.n, timers.timers) == (2, 0, 1, [32_000])
    said = list(recovery.handleExpiredTimer(("j",), None, None))
    assert [(r.decided_us, r.action, r.n_chunks, r.n_bytes) for r in said] == [(32_000_000, "COMPLETE", 2, 4)] and first.n + later.n == 5


@pytest.mark.parametrize("cut", [1, 2, 4])
def test_silent_jobs_of_a_bucket_are_interrupted(streamed, monkeypatch, cut):
    """All jobs share a bucket: two fall silent at different times, one of them speaks again afterwards, one ends, one is open when the stream ends."""
    monkeypatch.setattr(processors, "JOB_BUCKETS", 1)
    rows = [("a", 1, at(0), "PREPARED"), ("b", 2, at(1), "PREPARED"), ("b", 3, at(20), "RECEIVING"), ("c", 4, at(21), "COMPLETE"), ("c", 5, at(22), "RECEIVING"), ("d", 6, at(95), "INJECTED")]
    size = -(-len(rows) // cut)
    batches = [rows[i:i + size] for i in range(0, len(rows), size)] + [[("e", 7, at(100), "PREPARED")], [("a", 8, at(101), "RECEIVING")]]
    events = streamed(batches, "job_id string, event_id long, event_time timestamp, status string")
    out = run_available(processors.stale_job_stream(events, 30, "10 seconds"), "silent").collect()
    assert sorted((r.job_id, r.event_time, r.event_id) for r in out if r.status == "INTERRUPTED") == [("a", at(30), 1), ("b", at(50), 3)]
    assert {r.event_id: r.applied for r in out if r.status != "INTERRUPTED"} == {
        1: True, 2: True, 3: True, 4: True, 5: False, 6: True, 7: True, 8: "INTERRUPTED" not in fixed.TERMINAL_JOB_STATES}


def test_new_jobs_of_a_bucket_take_a_state_call_each():
    jobs, timer, active, ended, timers = processors.SilentJobs(30), Value(), Value(), Value(), Calls()
    jobs.timer, jobs.active, jobs.ended, jobs.handle = timer, active, ended, timers
    events = [Row(job_id=f"j{i}", event_id=i, at_us=i * 1_000_000, status="COMPLETE" if i % 5 == 0 else "INJECTED") for i in range(100)]
    assert all(r.applied for r in jobs.handleInputRows((0,), iter(events), None))
    assert (timer.n, active.n, ended.n, timers.timers) == (2, 80, 20, [31_000])
