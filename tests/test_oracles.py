"""Every registered query against its oracle SQL; what has none against a model in Python."""

import pytest
from compare import difference, open_oracle

from pagefacts import fixed
from pagefacts.plans import registry, stream_queries

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracles()


@pytest.fixture(scope="session")
def oracle():
    return open_oracle(SF)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_matches_oracle(spark, oracle, name):
    problem, rows = difference(QUERIES[name](spark, SF), oracle, ORACLES[name])
    assert problem is None, problem


def test_no_query_without_rows(spark):
    for name in ("node_tree", "page_text_shape"):
        assert QUERIES[name](spark, SF).limit(1).count() == 1


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_admission_stream_equals_a_model(spark):
    """Attempts of a session one after another; only what was allowed counts as captured."""
    want, held = {}, {}
    rows = stream_queries._attempts(spark, SF).collect()
    for row in sorted(rows, key=lambda r: (r.session_id, r.observation_index, r.snapshot_id)):
        before = held.setdefault(row.session_id, {})
        rules = {
            "SOURCE_CONTEXT_REQUIRED": not row.context_known or row.session_reference is None,
            "SOURCE_CONTEXT_INCOMPATIBLE": bool(row.context_known and row.session_reference is not None and not row.context_confirmed)
            or row.session_reference is not None and any(reference != row.session_reference for _, _, reference in before.values()),
            "REQUIRED_VIEWPORT_PROFILE_MISSING": row.requested_profile not in fixed.REQUIRED_PROFILES,
            "REQUIRED_PROFILE_ALREADY_CAPTURED": row.requested_profile in before,
            "DUPLICATE_MEASURED_VIEWPORT": any(width == row.inner_width for width, _, _ in before.values()),
            "PAGE_FINGERPRINT_MISMATCH": any(mark != row.page_fingerprint for _, mark, _ in before.values()),
        }
        codes = {code for code, broken in rules.items() if broken} | set(filter(None, row.environment_codes.split(",")))
        if not codes:
            before[row.requested_profile] = (row.inner_width, row.page_fingerprint, row.reference_digest)
        want[(row.session_id, row.snapshot_id)] = (not codes, ",".join(sorted(codes)))
    found = {(r.session_id, r.snapshot_id): (r.allowed, r.codes) for r in QUERIES["admission_stream"](spark, SF).collect()}
    assert found == want and any(allowed for allowed, _ in want.values())
