"""Work is done once, on plain rows, and without values held several times over."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Row
from pyspark.sql import functions as F

from llm import lines
from pagefacts.operators import conformance, contracts, sessions
from pagefacts.plans import package_queries
from pagefacts.sources import packages
from pagefacts.streaming import processors


def plan_of(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def archive(text):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as file:
        file.writestr("a.txt", text)
        file.writestr("b.txt", "b")
    return held.getvalue()


def test_entries_of_many_archives_come_in_one_frame():
    batch = pd.DataFrame({"package_id": [f"p{i}" for i in range(50)], "content": [archive(f"text {i}") for i in range(49)] + [b"none"]})
    frames = list(packages._open(iter([batch])))
    assert len(frames) == 1
    found = [tuple(r) for r in frames[0].itertuples(index=False)]
    expected = [x for i in range(49) for x in ((f"p{i}", "a.txt", f"text {i}".encode(), None), (f"p{i}", "b.txt", b"b", None))]
    assert found == [*expected, ("p49", "", None, "ARCHIVE_INVALID")]


def test_large_entries_are_handed_on_in_parts(monkeypatch):
    monkeypatch.setattr(packages, "HELD_BYTES", 10)
    batch = pd.DataFrame({"package_id": ["p", "q"], "content": [archive("x" * 11), archive("y" * 11)]})
    frames = list(packages._open(iter([batch])))
    assert [len(f) for f in frames] == [1, 2, 1]


def test_archives_are_opened_once(spark, tmp_path):
    spark.createDataFrame([(34, "a"), (1, "b"), (29, "c"), (22, "d")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = package_queries.read_packages(spark, str(tmp_path))
    assert "MapInPandas" not in plan_of(found)
    issues = sorted((r.package_id, r.path, r.issue or "") for r in found.collect())
    assert issues == [("doc-1", "docs/a.txt", ""), ("doc-1", "manifest.json", ""), ("doc-22", "../a.txt", "PATH_UNSAFE"), ("doc-22", "manifest.json", ""),
                      ("doc-29", "", "ARCHIVE_INVALID"), ("doc-34", "docs/a.txt", "DUPLICATE_PATH"), ("doc-34", "docs/a.txt", "DUPLICATE_PATH"), ("doc-34", "manifest.json", "")]


def test_records_are_taken_apart_once_and_values_are_not_shuffled(spark):
    choice = {"anyOf": [{"type": "null"}, {"type": "object", "required": ["w"]}]}
    rules = contracts.contract_rules(spark, {"c": {"type": "object", "properties": {"t": choice, "n": {"type": "integer"}}}})
    rows = spark.createDataFrame([(1, '{"t":{}}'), (2, '{"t":null,"n":"x"}'), (3, '{"t":5,"n":1}'), (4, '{"t":{"w":1}}'), (5, "{")], "id int, record string")
    found = contracts.schema_issues(rows, "record", F.lit("c"), rules, ["id"])
    plan = plan_of(found)
    assert plan.count("Generate explode") == 2 and "SortMergeJoin" not in plan
    assert sorted(tuple(r) for r in found.collect()) == [(1, "$.t", "any_of"), (2, "$.n", "type"), (3, "$.t", "any_of"), (5, "$", "malformed")]


def test_element_issues_hold_each_element_once(spark):
    digest, node = "sha256:" + "0" * 64, "n000000"
    rows = spark.createDataFrame([
        ("a", node, 0, digest, True, 1.0), ("a", node, 2, digest, True, 1.0), ("b", node, 0, digest, True, 1.0), ("c", None, 0, None, True, 1.0), ("c", node, 0, digest, False, 1.0),
        (None, node, 1, digest, False, 1.0)],
        "snapshot_id string, node_id string, document_order int, reference_sha256 string, unique_in_document boolean, area double")
    found = conformance.element_issues(rows, ["snapshot_id"])
    assert "Expand" not in plan_of(found)
    whole = sorted((r.snapshot_id or "", r.path, r.message) for r in found.collect() if r.message in ("contiguous", "unique", "agreement"))
    assert whole == [("", "document_order", "contiguous"), ("a", "document_order", "contiguous"), ("a", "node_id", "unique"), ("a", "stable_reference", "unique"),
                     ("c", "document_order", "contiguous"), ("c", "node_id", "unique"), ("c", "stable_reference", "unique")]


def test_feed_readiness_counts_before_it_joins(spark):
    calm = {**dict.fromkeys(("scroll_x", "scroll_y"), 0.0), **dict.fromkeys(("img_broken", "img_pending", "img_failed", "img_timed_out"), 0), "visibility_state": "visible",
            **dict.fromkeys(("prerendering", "editor_preview", "iframe", "body_admin_class", "admin_element", "admin_visible"), False), "process_state": "STABLE"}
    seen = [("a", "r", 0, 390.0, "MOBILE", "p"), ("a", "r", 1, 820.0, "TABLET", "p"), ("a", "x", 2, 1440.0, "DESKTOP", "q"), ("b", None, 0, 390.0, None, "p"), ("b", None, 0, None, "CUSTOM", "p"),
            (None, "r", 0, 390.0, "MOBILE", "p")]
    rows = spark.createDataFrame(seen, "session_id string, reference_digest string, observation_index int, inner_width double, requested_profile string, page_fingerprint string")
    rows = rows.withColumns({name: F.lit(value) for name, value in calm.items()})
    context = "context_id string, imported_sha256 string, export_root_sha256 string, site_fingerprint string, {0}document_id string, {0}document_fingerprint string"
    listed = [("a", "r", "CONFIRMED", "c", "i", "e", "s", "d", "f"), ("b", None, None, None, None, None, None, None, None), ("c", "r", "CONFIRMED", "c", "i", "e", "s", "d", "f")]
    held = spark.createDataFrame(listed, "session_id string, reference_digest string, confirmation_state string, " + context.format("selected_"))
    found = sessions.feed_readiness(held, rows, spark.createDataFrame([("c", "i", "e", "s", "d", "f")], context.format("")))
    assert "Expand" not in plan_of(found)
    told = {r.session_id: (r.observation_count, r.distinct_viewport_widths, r.profiles, r.page_fingerprint_consistent, r.state) for r in found.collect()}
    assert told == {"a": (3, 3, ["DESKTOP", "MOBILE", "TABLET"], False, "INVALID"), "b": (2, 1, ["CUSTOM"], True, "INVALID"),
                    "c": (0, 0, [], True, "INSUFFICIENT_EVIDENCE")}
    codes = {r.session_id: r.blocking_codes for r in found.collect()}
    assert codes["a"] == ["PAGE_FINGERPRINT_MISMATCH", "SOURCE_CONTEXT_REFERENCE_MISMATCH"] and "OBSERVATION_INDEX_INVALID" in codes["b"]


class _Value:
    """A value state that counts calls."""

    def __init__(self):
        self.value, self.calls = None, 0

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value


class _Handle:
    def __init__(self):
        self.state, self.timers, self.calls = _Value(), [], 0

    def getValueState(self, *_):
        return self.state

    def listTimers(self):
        self.calls += 1
        return iter(self.timers)

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


def attempt(index, profile, width):
    return Row(snapshot_id=f"s{index}", observation_index=index, requested_profile=profile, inner_width=width, page_fingerprint="f", reference_digest="r", session_reference="r",
               context_known=True, context_confirmed=True, environment_codes="")


def test_admission_takes_plain_rows_and_two_state_calls():
    handle, processor = _Handle(), processors.Admission()
    processor.init(handle)
    said = list(processor.handleInputRows(("k",), iter([attempt(1, "TABLET", 820.0), attempt(0, "DESKTOP", 1440.0), attempt(2, "TABLET", 390.0)]), None))
    assert [(r.snapshot_id, r.allowed, r.codes) for r in said] == [("s0", True, ""), ("s1", True, ""), ("s2", False, "REQUIRED_PROFILE_ALREADY_CAPTURED")]
    assert handle.state.calls == 2
    again = list(processor.handleInputRows(("k",), iter([attempt(3, "MOBILE", 820.0), attempt(4, "MOBILE", 390.0)]), None))
    assert [(r.allowed, r.codes) for r in again] == [(False, "DUPLICATE_MEASURED_VIEWPORT"), (True, "")]


def sample(number, **other):
    return Row(**{"sample_no": number, "elapsed_ms": number * 100.0, "doc_w": 1.0, "doc_h": 2.0, "view_w": 3.0, "view_h": 4.0, "ready_state": "complete", "fonts_loaded": True,
                  "unresolved_images": 0, "at_us": 5_000_000 + number * 100_000, **other})


def test_timed_readiness_takes_plain_rows_and_asks_for_timers_only_where_there_may_be_one():
    handle, processor = _Handle(), processors.TimedReadiness(1500)
    processor.init(handle)
    assert list(processor.handleInputRows(("k",), iter([sample(1), sample(0)]), None)) == []
    assert handle.timers == [6500] and handle.calls == 1 and handle.state.calls == 2
    said = list(processor.handleInputRows(("k",), iter([sample(2), sample(3)]), None))
    assert [tuple(r) for r in said] == [("k", "STABLE", 4, 1.0)] and handle.timers == []


def test_a_sample_without_a_size_is_an_error():
    handle, processor = _Handle(), processors.Readiness(1500)
    processor.init(handle)
    said = list(processor.handleInputRows(("k",), iter([sample(0, doc_h=None)]), None))
    assert [tuple(r) for r in said] == [("k", "ERROR", 1, None)]


def test_lines_are_not_rewritten_to_see_whether_they_are_blank(spark):
    rows = spark.createDataFrame([(1, "a\n \t\n \n\nb")], "page_id int, data string")
    found = lines.page_lines(rows)
    assert "regexp_replace" not in plan_of(found)
    assert [(r.line_no, r.line) for r in found.orderBy("line_no").collect()] == [(0, "a"), (2, " "), (4, "b")]
