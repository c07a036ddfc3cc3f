"""Canonical JSON: published cases and refusals (fixed values)."""

import json

import pytest

from pagefacts.functions.digests import canonical_text

CASES = [
    ('{"z":0,"a":1,"middle":{"b":2,"a":1}}', '{"a":1,"middle":{"a":1,"b":2},"z":0}'),
    ('{"array":[{},[],null,true,false],"empty":""}', '{"array":[{},[],null,true,false],"empty":""}'),
    ('{"control":"\\b\\t\\n\\f\\r\\u0001","quote":"\\\\\\"","slash":"a/b"}', '{"control":"\\b\\t\\n\\f\\r\\u0001","quote":"\\\\\\"","slash":"a/b"}'),
    ("-0.0", "0"), ("1.25", "1.25"), ("-12.5", "-12.5"), ("1e-07", "1e-7"), ("9007199254740991", "9007199254740991"), ('"🧭"', '"🧭"'),
    ("0.00001", "0.00001"), ("100.0", "100"), ('"é"', '"é"'),
]


@pytest.mark.parametrize("text,wanted", CASES)
def test_cases(text, wanted):
    assert canonical_text(json.loads(text)) == wanted


@pytest.mark.parametrize("value", [float("nan"), float("inf"), -float("inf"), 9007199254740992, 1e21, -1e21, 10**21, {"__proto__": 1}])
def test_refusals(value):
    with pytest.raises(ValueError):
        canonical_text(value)


def test_unpaired_surrogate():
    with pytest.raises(UnicodeEncodeError):
        canonical_text("\ud800")


def test_semantic_text_leaves_operational_facts_out():
    value = {"session_id": 1, "b": 1, "diagnostics": [
        {"code": "B", "severity": "INFO", "scope": "SEMANTIC", "context": {"captured_at": 1}, "message_key": "m"},
        {"code": "A", "severity": "INFO", "scope": "OPERATIONAL", "context": {}}]}
    assert canonical_text(value, True) == '{"b":1,"diagnostics":[{"code":"B","context":{},"scope":"SEMANTIC","severity":"INFO"}]}'
