"""Stateful processors.  Each keeps a small, bounded state per key; decisions follow the batch operators.

Rows of a key arrive in any order within a micro-batch, so a processor sorts what it was handed.

A live query passes `ttl_ms`: the state of an idle key then ends after that time.  Time-to-live needs the
processing-time mode, which schedules batches for ever, so a run over "all that is there now" leaves it out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pagefacts import fixed
from pagefacts.operators.sessions import environment_conditions

DAY_MS = 86_400_000
#: How late an event may come before the stream's time passes it.
LATENESS = "10 minutes"
#: Milliseconds that an event without a time is taken to have: before all others.
_NO_TIME = -9_223_372_036_855
#: A time after all others, of a timer that is not set.
_NEVER = 9_223_372_036_854_775_807
#: Jobs whose silence is watched are dealt into so many buckets.
JOB_BUCKETS = 4096
_NAN = float("nan")


class _Keyed(StatefulProcessor):
    """Processor with an optional time-to-live for its state."""

    def __init__(self, ttl_ms: int | None = None) -> None:
        self.ttl_ms = ttl_ms

    def close(self) -> None:
        pass



def _sorted(rows: Iterator[pd.DataFrame], by: list[str]) -> list:
    frames = list(rows)
    whole = pd.concat(frames, ignore_index=True) if frames else pd.DataFrame(columns=by)
    return list(whole.sort_values(by, kind="stable").itertuples(index=False))


class IngestChunks(_Keyed):
    """Accept a chunk once, reject what contradicts the job or an earlier chunk."""

    schema = "job_id string, chunk_index int, copy int, outcome string, reason string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "chunk_index int", "digest string", self.ttl_ms)
        self.job = handle.getValueState("job", "total int, count int, bytes long", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        total, count, size = self.job.get() if self.job.exists() else (None, 0, 0)
        out = []
        for row in _sorted(rows, ["chunk_index", "copy"]):
            data = row.data.encode()
            digest = hashlib.sha256(data).hexdigest()
            reason = None
            if not row.job_active:
                reason = "JOB_NOT_ACTIVE"
            elif total is not None and row.total != total:
                reason = "TOTAL_CHANGED"
            elif len(data) != row.byte_length or digest != row.sha256:
                reason = "CHUNK_INTEGRITY"
            elif self.seen.containsKey((int(row.chunk_index),)):
                if self.seen.getValue((int(row.chunk_index),))[0] != digest:
                    reason = "CONFLICTING_DUPLICATE"
                out.append((key[0], row.chunk_index, row.copy, "REJECTED" if reason else "DUPLICATE", reason))
                continue
            elif count + 1 > fixed.MAX_CHUNKS or size + len(data) > row.max_bytes:
                reason = "SNAPSHOT_SIZE_LIMIT"
            if reason is None:
                self.seen.updateValue((int(row.chunk_index),), (digest,))
                total, count, size = int(row.total), count + 1, size + len(data)
            out.append((key[0], row.chunk_index, row.copy, "REJECTED" if reason else "ACCEPTED", reason))
        if total is not None:
            self.job.update((total, count, size))
        yield pd.DataFrame(out, columns=["job_id", "chunk_index", "copy", "outcome", "reason"])


class AssembleChunks(_Keyed):
    """Collect accepted chunks and emit the whole text once all of them are there; what comes later is not kept."""

    schema = "job_id string, n_chunks int, n_bytes bigint, text_sha256 string, text string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.parts = handle.getMapState("parts", "chunk_index int", "data string", self.ttl_ms)
        self.done = handle.getValueState("done", "done boolean", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        total = 0
        if self.done.exists():
            return
        for row in _sorted(rows, ["chunk_index"]):
            total = int(row.total)
            if not self.parts.containsKey((int(row.chunk_index),)):
                self.parts.updateValue((int(row.chunk_index),), (row.data,))
        held = {int(k[0]): v[0] for k, v in self.parts.iterator()}
        out = []
        if total and set(held) == set(range(total)):
            text = "".join(held[i] for i in range(total))
            data = text.encode()
            out.append((key[0], total, len(data), hashlib.sha256(data).hexdigest(), text))
            self.done.update((True,))
            self.parts.clear()
        yield pd.DataFrame(out, columns=["job_id", "n_chunks", "n_bytes", "text_sha256", "text"])


class JobStates(_Keyed):
    """Follow the state of a job; a terminal state absorbs later events, silence interrupts the job.

    Jobs are many and short, so their events are handled as plain rows, which cost far less per key than a data frame; times are microseconds (`at_us`).
    """

    schema = "job_id string, event_id bigint, at_us bigint, status string, applied boolean"

    def __init__(self, stale_seconds: int | None = None) -> None:
        super().__init__()
        self.stale_ms = None if stale_seconds is None else stale_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "status string, at long, event_id long")

    def _arm(self, at_ms: int, known: bool) -> None:
        if self.stale_ms is not None:
            for timer in list(self.handle.listTimers()) if known else ():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(at_ms + self.stale_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.state.get()
        status, at, last = held or (None, 0, 0)
        # Events without a time come last.
        for row in sorted(rows, key=lambda r: (r.at_us is None, r.at_us or 0, r.event_id)):
            applied = status not in fixed.TERMINAL_JOB_STATES
            if applied:
                status, at, last = row.status, _NO_TIME if row.at_us is None else row.at_us // 1000, row.event_id
            yield Row(job_id=key[0], event_id=row.event_id, at_us=row.at_us, status=row.status, applied=applied)
        self.state.update((status, at, last))
        if status in fixed.ACTIVE_JOB_STATES:
            self._arm(at, held is not None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        status, at, last = self.state.get()
        if status in fixed.ACTIVE_JOB_STATES:
            self.state.update(("INTERRUPTED", at, last))
            yield Row(job_id=key[0], event_id=last, at_us=(at + (self.stale_ms or 0)) * 1000, status="INTERRUPTED", applied=True)


class SilentJobs(_Keyed):
    """`JobStates` with timers, for all jobs of a bucket at once: keys, timers and frames cost their calls once for a bucket, not for each job.

    Active jobs and others have a map each, so what a timer looks through is bounded by the active jobs.  A bucket has one timer, for the job that
    is due first.
    """

    schema = JobStates.schema

    def __init__(self, stale_seconds: int) -> None:
        super().__init__()
        self.stale_ms = stale_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.timer = handle.getValueState("timer", "at long")
        self.active = handle.getMapState("active", "job_id string", "status string, at long, event_id long")
        self.ended = handle.getMapState("ended", "job_id string", "status string")

    def _arm(self, held: int | None, at_ms: int | None) -> None:
        """The timer of the bucket, which is at `held` (`_NEVER`: there is none, None: there never was one), goes to `at_ms`."""
        if held is not None and held != _NEVER:
            self.handle.deleteTimer(held)
        if at_ms is not None:
            self.handle.registerTimer(at_ms)
        self.timer.update((_NEVER if at_ms is None else at_ms,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        jobs: dict[str, list[Row]] = {}
        for row in rows:
            jobs.setdefault(row.job_id, []).append(row)
        held = (self.timer.get() or (None,))[0]
        due = None
        for job_id, events in jobs.items():
            # A bucket that is new knows no jobs.
            known = None if held is None else self.active.getValue((job_id,))
            status, at, last = known or (None, 0, 0)
            if held is not None and known is None:
                status = (self.ended.getValue((job_id,)) or (None,))[0]
            # Events without a time come last.
            for row in sorted(events, key=lambda r: (r.at_us is None, r.at_us or 0, r.event_id)):
                applied = status not in fixed.TERMINAL_JOB_STATES
                if applied:
                    status, at, last = row.status, _NO_TIME if row.at_us is None else row.at_us // 1000, row.event_id
                yield Row(job_id=job_id, event_id=row.event_id, at_us=row.at_us, status=row.status, applied=applied)
            if status in fixed.ACTIVE_JOB_STATES:
                self.active.updateValue((job_id,), (status, at, last))
                due = at + self.stale_ms if due is None else min(due, at + self.stale_ms)
            else:
                self.ended.updateValue((job_id,), (status,))
                if known is not None:
                    self.active.removeKey((job_id,))
        if held is None or (due is not None and due < held):
            self._arm(held, due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, rest, silent = timerValues.getCurrentWatermarkInMs(), [], []
        for (job_id,), (_, at, last) in list(self.active.iterator()):
            (silent if at + self.stale_ms < now else rest).append((job_id, at, last))
        if silent and not rest:
            self.active.clear()
        for job_id, at, last in silent:
            if rest:
                self.active.removeKey((job_id,))
            self.ended.updateValue((job_id,), ("INTERRUPTED",))
            yield Row(job_id=job_id, event_id=last, at_us=(at + self.stale_ms) * 1000, status="INTERRUPTED", applied=True)
        # The timer that expired is gone.
        self._arm(None, min(at for _, at, _ in rest) + self.stale_ms if rest else None)


def _job_states(events: DataFrame, seconds: int | None) -> DataFrame:
    rows = events.select("job_id", "event_id", "event_time", F.unix_micros("event_time").alias("at_us"), "status")
    if seconds is None:
        out = by_rows(rows, "job_id", JobStates(), time="None")
    else:
        dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64("job_id"), F.lit(JOB_BUCKETS)).cast("int"))
        out = by_rows(dealt, "_bucket", SilentJobs(seconds), time="EventTime")
    return out.select("job_id", "event_id", F.timestamp_micros("at_us").alias("event_time"), "status", "applied")


def _number(value: float | None) -> float:
    return _NAN if value is None else float(value)


class Readiness(_Keyed):
    """Run counter over readiness samples; one verdict per capture.  Samples are plain rows, as captures are many and short."""

    schema = "capture_id string, process_state string, sample_count int, final_document_width double"

    def __init__(self, timeout_ms: float = fixed.READINESS_TIMEOUT_MS, ttl_ms: int | None = None) -> None:
        super().__init__(ttl_ms)
        self.limit = float(min(max(int(timeout_ms), 0), fixed.MAX_READINESS_TIMEOUT_MS))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState(
            "state", "run int, seen int, elapsed double, doc_w double, doc_h double, view_w double, view_h double, verdict string", self.ttl_ms)

    def _judged(self, held: tuple | None, rows: list[Row]) -> tuple:
        """The state after `rows`, which are in order."""
        run, seen, elapsed, w, h, vw, vh, verdict = held or (0, 0, -1.0, 0.0, 0.0, 0.0, 0.0, None)
        for row in rows:
            if verdict is not None:
                break
            if seen and elapsed >= self.limit:
                verdict = "TIMEOUT"
                break
            size = tuple(_number(v) for v in (row.doc_w, row.doc_h, row.view_w, row.view_h))
            ready = row.ready_state == "complete" and bool(row.fonts_loaded) and row.unresolved_images == 0
            run = run + 1 if seen and size == (w, h, vw, vh) and ready else 0
            seen, elapsed = seen + 1, _number(row.elapsed_ms)
            w, h, vw, vh = size
            if any(v != v for v in size):
                verdict = "ERROR"
            elif run >= fixed.STABLE_SAMPLES:
                verdict = "STABLE"
        return run, seen, elapsed, w, h, vw, vh, verdict

    def _ordered(self, rows: Iterator[Row]) -> list[Row]:
        return sorted(rows, key=lambda r: (r.sample_no is None, r.sample_no or 0))

    def _said(self, key: tuple, held: tuple | None, state: tuple) -> Iterator[Row]:
        verdict = state[7]
        if verdict is not None and (held is None or held[7] is None):
            yield Row(capture_id=key[0], process_state=verdict, sample_count=state[1], final_document_width=None if verdict == "ERROR" else state[3])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.state.get()
        state = self._judged(held, self._ordered(rows))
        self.state.update(state)
        yield from self._said(key, held, state)


class TimedReadiness(Readiness):
    """The same with an event-time timer: a capture whose samples stop gets its verdict when its time is up.

    The time of a sample, in microseconds (`at_us`), is when it was taken, so a capture began `elapsed_ms` before its first one.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.handle = handle

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held, ordered = self.state.get(), self._ordered(rows)
        state = self._judged(held, ordered)
        self.state.update(state)
        # A capture that is new has no timer to look for.
        timers = list(self.handle.listTimers()) if held is not None else []
        if state[7] is not None:
            for timer in timers:
                self.handle.deleteTimer(timer)
        elif not timers:
            first = ordered[0]
            at = _NO_TIME if first.at_us is None else first.at_us // 1000
            self.handle.registerTimer(int(at - _number(first.elapsed_ms) + self.limit))
        yield from self._said(key, held, state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.state.get()
        if held[7] is None:
            state = (*held[:7], "TIMEOUT")
            self.state.update(state)
            yield from self._said(key, held, state)


class Recovery(_Keyed):
    """What becomes of a job once it has been silent: finalised, failed or interrupted, by what was assembled until then.

    Job and chunk events of a job come in any order.  A timer runs from the latest of them; when it expires, the rules of `assemble_chunks` decide and
    the state of the job is cleared.  Chunks of a job that was never announced decide nothing.

    Events are plain rows with their time in microseconds (`at_us`).  What comes first is written as one value, as most jobs come whole; what follows
    goes to a value and a map of its own, so the first is not written again.
    """

    schema = "job_id string, decided_us bigint, action string, reason string, n_chunks int, n_bytes bigint, text_sha256 string"
    _JOB = "at long, announced boolean, status string, total int, max_bytes long, full_sha256 string"

    def __init__(self, stale_seconds: int) -> None:
        super().__init__()
        self.stale_ms = stale_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", f"{self._JOB}, spots array<int>, texts array<string>, sizes array<bigint>, marks array<int>")
        self.later = handle.getValueState("later", self._JOB)
        self.parts = handle.getMapState("parts", "chunk_index int", "data string, n_bytes long, intact boolean, legacy boolean, conflict boolean")

    @staticmethod
    def _merged(old: tuple | None, new: tuple) -> tuple:
        if old is None:
            return new
        return min(old[0], new[0]), min(old[1], new[1]), old[2] and new[2], old[3] or new[3], old[4] or new[4] or old[0] != new[0]

    def _followed(self, job: tuple, rows: Iterator[Row]) -> tuple[tuple, dict[int, tuple]]:
        """The job after `rows`, and the chunks among them."""
        at, rest, parts = job[0], job[1:], {}
        # Events without a time come last and leave the time as it is.
        for row in sorted(rows, key=lambda r: (r.at_us is None, r.at_us or 0)):
            at = at if row.at_us is None else max(at, row.at_us // 1000)
            if row.kind == "JOB":
                rest = (True, row.status, int(row.total), int(row.max_bytes), row.full_sha256)
                continue
            data = row.data.encode()
            legacy = row.sha256 == "LEGACY_UNVERIFIED"
            intact = len(data) == int(row.byte_length) and (legacy or hashlib.sha256(data).hexdigest() == row.sha256)
            spot = int(row.chunk_index)
            parts[spot] = self._merged(parts.get(spot), (row.data, len(data), intact, legacy, False))
        return (at, *rest), parts

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if not self.first.exists():
            job, parts = self._followed((0, False, None, None, None, None), rows)
            marks = [p[2] + 2 * p[3] + 4 * p[4] for p in parts.values()]
            self.first.update((*job, list(parts), [p[0] for p in parts.values()], [p[1] for p in parts.values()], marks))
        else:
            job, parts = self._followed(tuple(self.later.get() or self.first.get()[:6]), rows)
            for spot, part in parts.items():
                self.parts.updateValue((spot,), self._merged(self.parts.getValue((spot,)), part))
            self.later.update(job)
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        self.handle.registerTimer(job[0] + self.stale_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held, later = self.first.get(), self.later.get()
        at, announced, status, total, max_bytes, full = later or held[:6]
        self.first.clear()
        parts = {spot: (data, size, bool(mark & 1), bool(mark & 2), bool(mark & 4)) for spot, data, size, mark in zip(*held[6:], strict=True)}
        if later is not None:
            for spot, part in self.parts.iterator():
                parts[spot[0]] = self._merged(parts.get(spot[0]), tuple(part))
            self.later.clear()
            self.parts.clear()
        if announced and status in fixed.ACTIVE_JOB_STATES:
            size = sum(p[1] for p in parts.values())
            reason, digest = self._judged(parts, total, size, max_bytes, full)
            action = "COMPLETE" if reason is None else "INTERRUPTED" if reason == "CHUNK_SEQUENCE" else "FAILED"
            yield Row(job_id=key[0], decided_us=(at + self.stale_ms) * 1000, action=action, reason=reason, n_chunks=len(parts), n_bytes=size, text_sha256=digest)

    @staticmethod
    def _judged(parts: dict[int, tuple], total: int, size: int, max_bytes: int, full: str | None) -> tuple[str | None, str | None]:
        if set(parts) != set(range(total)) or len(parts) > fixed.MAX_CHUNKS:
            return "CHUNK_SEQUENCE", None
        if any(p[4] for p in parts.values()):
            return "CONFLICTING_DUPLICATE", None
        if full is None and any(p[3] for p in parts.values()):
            return "LEGACY_INTEGRITY_UNAVAILABLE", None
        if size > max_bytes:
            return "ASSEMBLED_SIZE", None
        if not all(p[2] for p in parts.values()):
            return "CHUNK_INTEGRITY", None
        whole = hashlib.sha256()
        for i in range(total):
            whole.update(parts[i][0].encode())
        return (None, whole.hexdigest()) if full in (None, whole.hexdigest()) else ("ASSEMBLED_CHECKSUM", None)


class Admission(_Keyed):
    """Accept or reject capture attempts of a session one after another.  Attempts are plain rows, as sessions are many and short.

    Only accepted attempts count as captured, and each needs a required profile of its own, so the state
    never holds more than these, and is one value.
    """

    schema = "session_id string, snapshot_id string, allowed boolean, codes string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        slots = ", ".join(f"profile{i} string, width{i} double, fingerprint{i} string, reference{i} string" for i in range(len(fixed.REQUIRED_PROFILES)))
        self.accepted = handle.getValueState("accepted", slots, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = self.accepted.get() or ()
        held = {before[i]: tuple(before[i + 1:i + 4]) for i in range(0, len(before), 4) if before[i] is not None}
        known = len(held)
        for row in sorted(rows, key=lambda r: (r.observation_index is None, r.observation_index or 0, r.snapshot_id is None, r.snapshot_id or "")):
            codes = set(filter(None, row.environment_codes.split(",")))
            if not row.context_known or row.session_reference is None:
                codes.add("SOURCE_CONTEXT_REQUIRED")
            elif not row.context_confirmed:
                codes.add("SOURCE_CONTEXT_INCOMPATIBLE")
            if row.session_reference is not None and any(v[2] != row.session_reference for v in held.values()):
                codes.add("SOURCE_CONTEXT_INCOMPATIBLE")
            if row.requested_profile not in fixed.REQUIRED_PROFILES:
                codes.add("REQUIRED_VIEWPORT_PROFILE_MISSING")
            if row.requested_profile in held:
                codes.add("REQUIRED_PROFILE_ALREADY_CAPTURED")
            width = _number(row.inner_width)
            if any(v[0] == width for v in held.values()):
                codes.add("DUPLICATE_MEASURED_VIEWPORT")
            if any(v[1] != row.page_fingerprint for v in held.values()):
                codes.add("PAGE_FINGERPRINT_MISMATCH")
            if not codes:
                held[row.requested_profile] = (width, row.page_fingerprint, row.reference_digest)
            yield Row(session_id=key[0], snapshot_id=row.snapshot_id, allowed=not codes, codes=",".join(sorted(codes)))
        if len(held) > known:
            values = [x for profile, value in held.items() for x in (profile, *value)]
            self.accepted.update((*values, *[None] * (4 * len(fixed.REQUIRED_PROFILES) - len(values))))


class SessionRollup(_Keyed):
    """Roll-up of a session's captures, re-emitted whenever the session changes.  Captures are plain rows with their time in microseconds (`at_us`)."""

    schema = "session_id string, version int, status string, capture_count int, last_us bigint"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", "version int, count int, partial int, last long", self.ttl_ms)
        self.captures = handle.getMapState("captures", "snapshot_id string", "complete boolean", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.totals.get()
        version, count, partial, last = held or (0, 0, 0, 0)
        newest: dict[str, bool] = {}
        # Captures without a time come last.
        for row in sorted(rows, key=lambda r: (r.at_us is None, r.at_us or 0, r.snapshot_id)):
            newest[row.snapshot_id] = row.status == "COMPLETE"
            last = max(last, row.at_us or 0)
        for snapshot_id, complete in newest.items():
            # A session that is new has no captures to look up; what is known already is not written again.
            known = None if held is None else self.captures.getValue((snapshot_id,))
            if known is None:
                count += 1
            else:
                partial -= not known[0]
            partial += not complete
            if known is None or known[0] != complete:
                self.captures.updateValue((snapshot_id,), (complete,))
        self.totals.update((version + 1, count, partial, last))
        yield Row(session_id=key[0], version=version + 1, status="PARTIAL" if partial else "COMPLETE", capture_count=count, last_us=last)


class CompactRollup(SessionRollup):
    """The same, with the captures of a session of up to `MOST_HELD` in one value beside its totals; beyond, they go to the map, as values are written whole."""

    MOST_HELD = 256

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        # A version below zero: the session has gone over to totals and map.
        self.held = handle.getValueState("held", "version int, last long, snapshots array<string>, complete array<boolean>", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        version, last, snapshots, complete = self.held.get() or (0, 0, [], [])
        if version < 0:
            yield from super().handleInputRows(key, rows, timerValues)
            return
        captures = dict(zip(snapshots, complete, strict=True))
        # Captures without a time come last.
        for row in sorted(rows, key=lambda r: (r.at_us is None, r.at_us or 0, r.snapshot_id)):
            captures[row.snapshot_id] = row.status == "COMPLETE"
            last = max(last, row.at_us or 0)
        version, count, partial = version + 1, len(captures), sum(not x for x in captures.values())
        if count <= self.MOST_HELD:
            self.held.update((version, last, list(captures), list(captures.values())))
        else:
            for snapshot_id, whole in captures.items():
                self.captures.updateValue((snapshot_id,), (whole,))
            self.totals.update((version, count, partial, last))
            self.held.update((-1, 0, [], []))
        yield Row(session_id=key[0], version=version, status="PARTIAL" if partial else "COMPLETE", capture_count=count, last_us=last)


def stateful(rows: DataFrame, key: str, processor: _Keyed, mode: str = "Append", time: str | None = None) -> DataFrame:
    chosen = time or ("None" if processor.ttl_ms is None else "ProcessingTime")
    return rows.groupBy(key).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=processor.schema, outputMode=mode, timeMode=chosen)


def by_rows(rows: DataFrame, key: str, processor: _Keyed, mode: str = "Append", time: str | None = None) -> DataFrame:
    """`stateful` for processors that take and give plain rows."""
    chosen = time or ("None" if processor.ttl_ms is None else "ProcessingTime")
    return rows.groupBy(key).transformWithState(processor, processor.schema, mode, chosen)


def ingest_chunks(stream: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    return stateful(stream, "job_id", IngestChunks(ttl_ms))


def assemble_stream(accepted: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    return stateful(accepted, "job_id", AssembleChunks(ttl_ms))


def job_state_stream(events: DataFrame) -> DataFrame:
    """Applied and absorbed events per job."""
    return _job_states(events, None)


def stale_job_stream(events: DataFrame, seconds: int = fixed.STALE_JOB_SECONDS, watermark: str = LATENESS) -> DataFrame:
    """The same with event-time timers that interrupt silent jobs; events may come as late as `watermark`."""
    return _job_states(events.withWatermark("event_time", watermark), seconds)


def readiness_stream(samples: DataFrame, timeout_ms: float = fixed.READINESS_TIMEOUT_MS, ttl_ms: int | None = None) -> DataFrame:
    return by_rows(samples, "capture_id", Readiness(timeout_ms, ttl_ms))


def readiness_timeout_stream(samples: DataFrame, timeout_ms: float = fixed.READINESS_TIMEOUT_MS, watermark: str = LATENESS) -> DataFrame:
    """`readiness_stream` of samples with `event_time`, with a verdict for captures that fall silent."""
    rows = samples.withColumn("at_us", F.unix_micros("event_time")).withWatermark("event_time", watermark)
    return by_rows(rows, "capture_id", TimedReadiness(timeout_ms), time="EventTime")


def job_recovery_stream(events: DataFrame, seconds: int = fixed.STALE_JOB_SECONDS, watermark: str = LATENESS) -> DataFrame:
    """Recovery of silent jobs from one stream of job and chunk events.

    `events`: job_id, event_time, kind (JOB or CHUNK), of a job status, total, max_bytes, full_sha256, of a chunk chunk_index, data, byte_length, sha256.
    """
    rows = events.withColumn("at_us", F.unix_micros("event_time")).withWatermark("event_time", watermark)
    out = by_rows(rows, "job_id", Recovery(seconds), time="EventTime")
    return out.select("job_id", F.timestamp_micros("decided_us").alias("decided_at"), "action", "reason", "n_chunks", "n_bytes", "text_sha256")


def admission_stream(attempts: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    return by_rows(attempts, "session_id", Admission(ttl_ms))


def session_rollup_stream(captures: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    rows = captures.select("session_id", "snapshot_id", F.unix_micros("captured_at").alias("at_us"), "status")
    out = by_rows(rows, "session_id", CompactRollup(ttl_ms), "Update")
    return out.select("session_id", "version", "status", "capture_count", F.timestamp_micros("last_us").alias("last_captured_at"))


def environment_code_column() -> Column:
    """Codes of the environment conditions an attempt breaks, comma-joined."""
    codes = [F.when(bad, code) for code, bad in environment_conditions().items()]
    return F.array_join(F.array_compact(F.array(*codes)), ",")
