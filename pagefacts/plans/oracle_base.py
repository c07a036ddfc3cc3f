"""DuckDB side of the test shapes (WITH clauses that oracle queries are prefixed with)."""

from __future__ import annotations

from pagefacts.plans import rules


def _cols(names: list[str]) -> str:
    return ",\n  ".join(f"({rules.TREE_COLUMNS[n]}) AS {n}" for n in names)


TREE = f"""
tr_base AS (
  SELECT CAST(n_nationkey AS BIGINT) AS page_id, 0 AS lvl, NULL::VARCHAR AS seg, NULL::BIGINT AS custkey, NULL::BIGINT AS orderkey,
         NULL::INT AS linenumber, NULL::BIGINT AS partkey, NULL::BIGINT AS suppkey, NULL::DOUBLE AS quantity, NULL::DOUBLE AS price FROM nation
  UNION ALL SELECT DISTINCT CAST(c_nationkey AS BIGINT), 1, c_mktsegment, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM customer
  UNION ALL SELECT CAST(c_nationkey AS BIGINT), 2, c_mktsegment, c_custkey, NULL, NULL, NULL, NULL, NULL, NULL FROM customer
  UNION ALL SELECT CAST(c_nationkey AS BIGINT), 3, c_mktsegment, c_custkey, o_orderkey, NULL, NULL, NULL, NULL, NULL
            FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT CAST(c_nationkey AS BIGINT), 4, c_mktsegment, c_custkey, o_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
tr_ix AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY page_id ORDER BY seg NULLS FIRST, custkey NULLS FIRST, orderkey NULLS FIRST,
         linenumber NULLS FIRST, partkey, suppkey, price, quantity) - 1 AS INT) AS node_ix FROM tr_base),
tr_up AS (
  SELECT *, CASE WHEN lvl >= 2 THEN min(node_ix) OVER (PARTITION BY page_id, seg) END AS seg_ix,
         CASE WHEN lvl >= 3 THEN min(node_ix) OVER (PARTITION BY page_id, custkey) END AS cust_ix,
         CASE WHEN lvl >= 4 THEN min(node_ix) OVER (PARTITION BY page_id, orderkey) END AS order_ix FROM tr_ix),
tr_par AS (
  SELECT *, CASE lvl WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN seg_ix WHEN 3 THEN cust_ix ELSE order_ix END AS parent_ix FROM tr_up),
tr_kids AS (SELECT page_id AS kid_page, parent_ix AS kid_parent, CAST(count(*) AS INT) AS child_count FROM tr_par WHERE lvl > 0 GROUP BY ALL),
tr AS MATERIALIZED (
  SELECT tr_par.*, coalesce(child_count, 0) AS child_count,
  {_cols(list(rules.TREE_COLUMNS))}
  FROM tr_par LEFT JOIN tr_kids ON kid_page = page_id AND kid_parent = node_ix),
tr_anc AS (
  SELECT page_id, node_ix, 0 AS anc_ix, lvl AS dist FROM tr WHERE lvl >= 1
  UNION ALL SELECT page_id, node_ix, seg_ix, lvl - 1 FROM tr WHERE lvl >= 2
  UNION ALL SELECT page_id, node_ix, cust_ix, lvl - 2 FROM tr WHERE lvl >= 3
  UNION ALL SELECT page_id, node_ix, order_ix, 1 FROM tr WHERE lvl = 4)"""


def with_tree(body: str) -> str:
    return f"WITH {TREE}\n{body}"


def private(x: str) -> str:
    """Condition: the text looks private."""
    return (f"(regexp_matches({x}, '{RANDOM}') OR regexp_matches({x}, '{WORD}', 'i') OR "
            f"regexp_matches({x}, '{EMAIL}', 'i') OR regexp_matches({x}, '{JWT}'))")


def stable(x: str) -> str:
    t = f"trim({x})"
    return (f"CASE WHEN length({t}) BETWEEN 1 AND 80 AND regexp_matches({t}, '^[A-Za-z0-9][A-Za-z0-9_:-]*$') "
            f"AND NOT {private(t)} THEN {t} END")


RANDOM = "^([a-f0-9]{16,}|[A-Za-z0-9_-]{24,})$"
WORD = "(password|passwd|passcode|token|secret|auth|login|credit|card|cc-number|cvv|cvc|iban|ssn|message|chat)"
EMAIL = "[A-Z0-9._%+-]+@[A-Z0-9.-]+[.][A-Z]{2,}"
JWT = "eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}"

# Flat start tags of the given pages, in order.
TAGS = """
tag_text AS (
  SELECT page_id, unnest(regexp_extract_all(html, '<[a-zA-Z][a-zA-Z0-9]*(?:[^>]*>)?')) AS raw,
         generate_subscripts(regexp_extract_all(html, '<[a-zA-Z][a-zA-Z0-9]*(?:[^>]*>)?'), 1) - 1 AS node_ix FROM pages),
tags AS MATERIALIZED (
  SELECT page_id, CAST(node_ix AS INT) AS node_ix, lower(regexp_extract(raw, '^<([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag,
         CASE WHEN regexp_matches(raw, '\\shref="') THEN regexp_extract(raw, '\\shref="([^"]*)"', 1) END AS href,
         CASE WHEN regexp_matches(raw, '\\sclass="') THEN regexp_extract(raw, '\\sclass="([^"]*)"', 1) ELSE '' END AS class_text,
         row_number() OVER (PARTITION BY page_id, lower(regexp_extract(raw, '^<([a-zA-Z][a-zA-Z0-9]*)', 1)) ORDER BY node_ix) AS nth
  FROM tag_text),
nd AS MATERIALIZED (
  SELECT *, CASE WHEN tag IN ('p', 'li', 'article') THEN tag || nth END AS a_data_id,
         CASE WHEN tag = 'body' THEN 'page-' || page_id END AS a_page_id,
         CASE WHEN tag IN ('article', 'div') THEN trim(class_text || ' elementor-element elementor-widget-text e-con') ELSE class_text END AS mapped_class
  FROM tags)"""


def with_tags(body: str) -> str:
    return f"WITH {TAGS}\n{body}"


# Tree with the derived facts that many oracles share.
FACTS = """
tf AS MATERIALIZED (
  SELECT *, {stable_page} AS page_marker, {stable_data} AS data_id, {stable_id} AS html_id, {stable_test} AS test_id,
    list_filter(string_split(class_text, ' '), lambda t: t <> '') AS tokens,
    regexp_matches(' ' || class_text, ' (elementor-|e-)') AS class_marker,
    (display = 'none' OR CAST(opacity AS DOUBLE) <= 0) AS hides_subtree,
    (visibility IN ('hidden', 'collapse') OR display = 'none' OR CAST(opacity AS DOUBLE) <= 0) AS hides,
    (overflow_x IN ('auto', 'scroll') OR overflow_y IN ('auto', 'scroll')) AS scrolls,
    (overflow_x IN ('hidden', 'clip', 'auto', 'scroll') OR overflow_y IN ('hidden', 'clip', 'auto', 'scroll')) AS clips,
    coalesce((tag = 'a' AND a_href IS NOT NULL) OR tag IN ('button', 'input', 'select', 'textarea', 'summary')
      OR a_role IN ('button', 'link') OR a_tabindex IS NOT NULL, false) AS interactive
  FROM tr)""".format(stable_page=stable("a_page_id"), stable_data=stable("a_data_id"), stable_id=stable("a_id"), stable_test=stable("a_testid"))


def with_facts(body: str) -> str:
    return f"WITH {TREE},{FACTS}\n{body}"


REGION_KIND = """CASE WHEN list_has_any(tokens, ['elementor-section', 'elementor-inner-section']) THEN 'ELEMENTOR_SECTION'
  WHEN list_has_any(tokens, ['e-con', 'e-con-inner', 'elementor-container']) THEN 'ELEMENTOR_CONTAINER'
  WHEN list_has_any(tokens, ['e-grid', 'e-flexbox', 'e-div-block']) THEN 'ATOMIC_CONTAINER'
  WHEN landmark IS NOT NULL THEN 'HTML_LANDMARK' WHEN tag IN ('section', 'article') THEN 'HTML_SECTION' END"""
LANDMARK = """CASE WHEN lower(trim(a_role)) IN ('banner', 'main', 'navigation', 'contentinfo', 'complementary', 'region', 'search', 'form')
  THEN lower(trim(a_role)) ELSE CASE tag WHEN 'header' THEN 'banner' WHEN 'main' THEN 'main' WHEN 'nav' THEN 'navigation'
  WHEN 'aside' THEN 'complementary' WHEN 'footer' THEN 'contentinfo' END END"""
