"""Queries over the tree forest (nodes with recorded boxes), with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagefacts.functions import markers
from pagefacts.operators import ancestors, nodes, tree
from pagefacts.plans.derive import measured_tree, tree_nodes, written_nodes
from pagefacts.plans.oracle_base import LANDMARK, REGION_KIND, with_facts
from pagefacts.plans.page_queries import joined

MAX_ELEMENTS, MAX_DEPTH = 60, 3
WIDTH, HEIGHT = F.lit, F.lit


def _ix(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(-1)).alias(column)


def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = nodes.stable_ids(tree_nodes(spark, sf_dir), markers.attr("id"))
    return out.select("page_id", "node_ix", "stable_id")


def interaction_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = nodes.interaction_facts(tree_nodes(spark, sf_dir))
    i = F.col("interaction")
    flags = [F.coalesce(i[n].cast("string"), F.lit("-")).alias(n) for n in (
        "native_interactive_kind", "role", "disabled", "aria_disabled", "aria_expanded", "aria_controls_present",
        "href_present", "input_type", "contenteditable")]
    return out.select("page_id", "node_ix", *flags)


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = nodes.regions(tree_nodes(spark, sf_dir))
    return out.select("page_id", "node_ix", "region_kind", "role", "label", "label_source")


def normalize_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = nodes.normalize_rects(measured_tree(spark, sf_dir))
    return out.select("page_id", "node_ix", *[F.col(f"rect.{s}").alias(s) for s in ("left", "top", "right", "bottom")])


def rect_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.rect_rejects(measured_tree(spark, sf_dir))


def viewport_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    layout = nodes.normalize_rects(measured_tree(spark, sf_dir))
    out = nodes.viewport_intersection(layout, F.lit(1280.0), F.lit(800.0), F.lit(0.5), F.lit(120.25))
    return out.select("page_id", "node_ix", "intersects", "ratio", "area", "document_x", "document_y")


def overflow_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = nodes.overflow_flags(measured_tree(spark, sf_dir))
    return out.select("page_id", "node_ix", "h_overflow", "v_overflow", "h_clip", "v_clip")


def style_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two planted entries: a property outside the list and one value above the length limit."""
    long = F.when(F.col("node_ix") % 5 == 0, F.repeat(F.lit("x"), 2049)).otherwise("none")
    extra = F.create_map(F.lit("clip-path"), long, F.lit("behavior"), F.lit("none"), F.lit("color"), F.lit("red"))
    layout = measured_tree(spark, sf_dir).withColumn("styles", F.map_concat("styles", extra))
    out = nodes.style_facts(layout)
    return out.select("page_id", "node_ix", F.size("styles").alias("n_styles"), "omitted", "hidden", "scrolls", "clips", "position")


def capped_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = nodes.capped_lists(tree_nodes(spark, sf_dir))
    return out.select("page_id", "node_ix", joined("frontend_markers").alias("frontend_markers"), joined("widget_markers").alias("widget_markers"))


def ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.ordinals(tree_nodes(spark, sf_dir)).select("page_id", "node_ix", "sibling_index", "nth_of_type", "sibling_count")


def emission_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = nodes.normalize_rects(measured_tree(spark, sf_dir)).filter("tag <> 'script'")
    return tree.emission_ids(kept).select("page_id", "node_ix", "document_order", "node_id")


def marker_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.marker_index(tree_nodes(spark, sf_dir)).select("page_id", "attr", "value", "n", "complete")


def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.identities(written_nodes(spark, sf_dir)).select(
        "page_id", "node_ix", "reference", "identity_source", "identity_strategy", "identity_status",
        "identity_confidence", "collision_count")


def structural_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.structural_refs(written_nodes(spark, sf_dir)).select("page_id", "node_ix", "structural_ref")


def select_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tree.select_nodes(measured_tree(spark, sf_dir), MAX_ELEMENTS, MAX_DEPTH)
    return out.filter("scanned").select("page_id", "node_ix", "scan_rank", "visited", "selected")


def selection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tree.selection_summary(tree.select_nodes(measured_tree(spark, sf_dir), MAX_ELEMENTS, MAX_DEPTH), MAX_ELEMENTS, MAX_DEPTH)
    return out.select("page_id", "scanned_nodes", "visited_elements", "selected_elements", "maximum_depth", "truncated_branches",
                      _ix("first_truncated_ix"), "skipped_hidden_subtrees", "skipped_hidden_children", "scan_limited",
                      "depth_limited", "element_limited")


def selection_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tree.selection_summary(tree.select_nodes(measured_tree(spark, sf_dir), MAX_ELEMENTS, MAX_DEPTH), MAX_ELEMENTS, MAX_DEPTH)
    return tree.selection_diagnostics(out)


def prune_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.prune_hidden(measured_tree(spark, sf_dir)).select("page_id", "node_ix")


def traversal_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.traversal_metrics(tree.select_nodes(measured_tree(spark, sf_dir), MAX_ELEMENTS, MAX_DEPTH))


def emitted_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_nodes = tree_nodes(spark, sf_dir)
    emitted = tree.emission_ids(all_nodes.filter("(node_ix + depth) % 3 <> 0").select("page_id", "node_ix"))
    out = ancestors.emitted_parents(all_nodes, emitted)
    return out.select("page_id", "node_ix", "parent_node_id", "parent_emitted")


def nearest_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ancestors.nearest_ancestors(measured_tree(spark, sf_dir))
    return out.select("page_id", "node_ix", *[_ix(f"nearest_{n}") for n in ("hidden", "positioned", "scroll", "clipping")], "visible")


def clipped_by_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ancestors.clipped_by_ancestor(nodes.normalize_rects(measured_tree(spark, sf_dir))).select("page_id", "node_ix", "clipped")


def visible_in_viewport(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ancestors.visible_in_viewport(measured_tree(spark, sf_dir), F.lit(1280.0), F.lit(800.0))
    return out.select("page_id", "node_ix", "in_viewport")


def parent_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_nodes = tree_nodes(spark, sf_dir)
    out = ancestors.parent_regions(nodes.regions(all_nodes), all_nodes)
    return out.select("page_id", "node_ix", _ix("parent_region"))


QUERIES = {
    "stable_ids": stable_ids, "interaction_facts": interaction_facts, "regions": regions, "normalize_rects": normalize_rects,
    "rect_rejects": rect_rejects, "viewport_intersection": viewport_intersection, "overflow_flags": overflow_flags,
    "style_facts": style_facts, "capped_lists": capped_lists, "ordinals": ordinals, "emission_ids": emission_ids,
    "marker_index": marker_index, "identities": identities, "structural_refs": structural_refs, "select_nodes": select_nodes,
    "selection_summary": selection_summary, "selection_diagnostics": selection_diagnostics, "prune_hidden": prune_hidden,
    "traversal_metrics": traversal_metrics, "emitted_parents": emitted_parents, "nearest_ancestors": nearest_ancestors,
    "clipped_by_ancestor": clipped_by_ancestor, "visible_in_viewport": visible_in_viewport, "parent_regions": parent_regions,
}

# --- oracle SQL ----------------------------------------------------------------------------------


def _r6(x: str) -> str:
    return f"(floor(({x}) * 1e6 + 0.5) / 1e6)"


_ROLE = "CASE WHEN regexp_matches(lower(trim(a_role)), '^[a-z][a-z0-9-]{0,63}$') THEN lower(trim(a_role)) END"
_STRUCTURE = """list_sort(list_filter(tokens, lambda t: t IN ('elementor-section', 'elementor-inner-section', 'elementor-container',
  'e-con', 'e-con-inner', 'e-grid', 'e-flexbox', 'e-div-block')))[1]"""
REGIONS = f"""
lm AS (SELECT *, {LANDMARK} AS landmark FROM tf),
rg AS MATERIALIZED (SELECT * FROM (SELECT *, {REGION_KIND} AS region_kind, {_STRUCTURE} AS technical FROM lm) WHERE region_kind IS NOT NULL)"""
_MARKS = """
mk AS (SELECT page_id, 'data-elementor-id' AS attr, page_marker AS value FROM tf
  UNION ALL SELECT page_id, 'data-id', data_id FROM tf
  UNION ALL SELECT page_id, 'id', html_id FROM tf
  UNION ALL SELECT page_id, 'data-testid', test_id FROM tf),
mi AS MATERIALIZED (SELECT page_id, attr, value, count(*) AS n, any_value(complete) AS complete FROM mk
  JOIN (SELECT page_id, count(*) <= 20000 AS complete FROM tf GROUP BY page_id) USING (page_id) WHERE value IS NOT NULL GROUP BY ALL)"""
_ESCAPED = """array_to_string(list_transform(string_split(html_id, ''), lambda c, i: CASE WHEN regexp_matches(c, '^[A-Za-z0-9_-]$') AND NOT (i = 1 AND regexp_matches(c, '^[0-9]$'))
  THEN c ELSE chr(92) || lower(to_hex(ascii(c))) || ' ' END), '')"""
_STEPS = f"""{_MARKS},
st AS MATERIALIZED (
  SELECT tf.page_id, tf.node_ix, tf.lvl, CASE WHEN a.n = 1 AND a.complete THEN tag || '#' || {_ESCAPED}
      WHEN b.n = 1 AND b.complete THEN tag || '[data-testid="' || test_id || '"]' END AS anchor,
    CASE WHEN a.n = 1 AND a.complete THEN 'HTML_ID' WHEN b.n = 1 AND b.complete THEN 'DATA_TEST_ID' END AS anchor_source,
    tag || ':nth-of-type(' || row_number() OVER (PARTITION BY tf.page_id, coalesce(parent_ix, -1), tag ORDER BY tf.node_ix) || ')' AS step
  FROM tf LEFT JOIN mi a ON a.page_id = tf.page_id AND a.attr = 'id' AND a.value = html_id
  LEFT JOIN mi b ON b.page_id = tf.page_id AND b.attr = 'data-testid' AND b.value = test_id),
pth AS (
  SELECT a.page_id, a.node_ix, a.dist, coalesce(s.anchor, s.step) AS seg, s.anchor IS NOT NULL AS anchored
  FROM (SELECT * FROM tr_anc UNION ALL SELECT page_id, node_ix, node_ix, 0 FROM tf) a JOIN st s ON s.page_id = a.page_id AND s.node_ix = a.anc_ix),
stop AS (SELECT page_id, node_ix, coalesce(min(CASE WHEN anchored THEN dist END), 99) AS stop FROM pth GROUP BY ALL),
rf AS MATERIALIZED (SELECT page_id, node_ix, string_agg(seg, '>' ORDER BY dist DESC) AS structural_ref FROM pth JOIN stop USING (page_id, node_ix) WHERE dist <= stop GROUP BY ALL)"""
_SKIPS = "tag IN ('base', 'head', 'link', 'meta', 'noscript', 'script', 'style', 'template', 'title')"
_REACH = f"""
fl AS MATERIALIZED (SELECT *, {_SKIPS} AS skip_tag, hides_subtree AND child_count > 0 AND NOT {_SKIPS} AS pruned FROM tf),
blk AS (SELECT DISTINCT a.page_id, a.node_ix FROM tr_anc a JOIN fl ON fl.page_id = a.page_id AND fl.node_ix = a.anc_ix WHERE skip_tag OR pruned)"""
SELECTED = f"""{_REACH},
rk AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY node_ix) - 1 AS scan_rank FROM fl
  WHERE lvl <= {MAX_DEPTH} AND NOT EXISTS (SELECT 1 FROM blk WHERE blk.page_id = fl.page_id AND blk.node_ix = fl.node_ix)),
sc AS (SELECT *, scan_rank < {max(1000, MAX_ELEMENTS * 20)} AS scanned, scan_rank < {max(1000, MAX_ELEMENTS * 20)} AND NOT skip_tag AS visited FROM rk),
sl AS MATERIALIZED (SELECT *, visited AND NOT hides AND count_if(visited AND NOT hides) OVER (PARTITION BY page_id ORDER BY node_ix) <= {MAX_ELEMENTS} AS selected FROM sc)"""
_SUMMARY = f"""{SELECTED},
wait AS (SELECT s.page_id, count(*) AS waiting FROM sl s JOIN sl p ON p.page_id = s.page_id AND p.node_ix = s.parent_ix WHERE NOT s.scanned AND p.scanned GROUP BY ALL),
c AS (SELECT page_id, count_if(scanned) AS scanned_nodes, count_if(visited) AS visited_elements, count_if(selected) AS selected_elements,
  max(CASE WHEN scanned THEN lvl END) AS maximum_depth, count_if(scanned AND lvl >= {MAX_DEPTH} AND child_count > 0 AND NOT skip_tag AND NOT pruned) AS cut,
  min(CASE WHEN scanned AND lvl >= {MAX_DEPTH} AND child_count > 0 AND NOT skip_tag AND NOT pruned THEN node_ix END) AS first_cut,
  min(CASE WHEN NOT scanned THEN node_ix END) AS nxt, count_if(scanned AND pruned) AS skipped_hidden_subtrees,
  CAST(coalesce(sum(CASE WHEN scanned AND pruned THEN child_count END), 0) AS BIGINT) AS skipped_hidden_children,
  max(CASE WHEN visited THEN node_ix END) AS lv, max(CASE WHEN selected THEN node_ix END) AS ls FROM sl GROUP BY page_id),
sm AS MATERIALIZED (SELECT page_id, scanned_nodes, visited_elements, selected_elements, maximum_depth, cut + coalesce(waiting, 0) AS truncated_branches,
  coalesce(first_cut, CASE WHEN coalesce(waiting, 0) > 0 THEN nxt END, -1) AS first_truncated_ix, skipped_hidden_subtrees, skipped_hidden_children,
  coalesce(waiting, 0) > 0 AS scan_limited, cut + coalesce(waiting, 0) > 0 AND maximum_depth >= {MAX_DEPTH} AS depth_limited,
  selected_elements >= {MAX_ELEMENTS} AND lv > ls AS element_limited FROM c LEFT JOIN wait USING (page_id))"""


def _nearest(name: str, condition: str) -> str:
    return (f"coalesce((SELECT arg_min(a.anc_ix, a.dist) FROM tr_anc a JOIN tf f ON f.page_id = a.page_id AND f.node_ix = a.anc_ix "
            f"WHERE a.page_id = t.page_id AND a.node_ix = t.node_ix AND {condition}), -1) AS {name}")


def _metric(name: str, condition: str) -> str:
    return (f"count_if(visited AND {condition}) AS discovered_{name}, count_if(selected AND NOT isnan(w) AND {condition}) AS emitted_{name}, "
            f"count_if(visited AND {condition}) - count_if(selected AND NOT isnan(w) AND {condition}) AS skipped_{name}")


_BOX_AREA = _r6(f"greatest(0, {_r6('w')} * {_r6('h')})")
_CROSS = _r6(f"greatest(0, {_r6('least(1280.0, xr)')} - {_r6('greatest(0.0, x0)')})")
_DOWN = _r6(f"greatest(0, {_r6('least(800.0, yb)')} - {_r6('greatest(0.0, y0)')})")
_BOX = f"bx AS (SELECT *, {_r6('x')} AS x0, {_r6('x + w')} AS xr, {_r6('y')} AS y0, {_r6('y + h')} AS yb FROM tf WHERE NOT isnan(w))"

ORACLES = {
    "stable_ids": with_facts("SELECT page_id, node_ix, html_id AS stable_id FROM tf"),
    "interaction_facts": with_facts(f"""SELECT page_id, node_ix,
  coalesce(CASE tag WHEN 'button' THEN 'BUTTON' WHEN 'a' THEN 'ANCHOR' WHEN 'input' THEN 'INPUT' END, '-') AS native_interactive_kind, coalesce({_ROLE}, '-') AS role,
  CASE WHEN tag IN ('button', 'input') AND a_disabled IS NOT NULL THEN 'true' ELSE 'false' END AS disabled,
  CASE WHEN lower(a_aria_disabled) IN ('true', 'false') THEN lower(a_aria_disabled) ELSE '-' END AS aria_disabled,
  CASE WHEN lower(a_aria_expanded) IN ('true', 'false') THEN lower(a_aria_expanded) ELSE '-' END AS aria_expanded,
  CASE WHEN a_aria_controls IS NOT NULL THEN 'true' ELSE 'false' END AS aria_controls_present,
  CASE WHEN tag = 'a' AND a_href IS NOT NULL THEN 'true' ELSE 'false' END AS href_present,
  CASE WHEN tag <> 'input' THEN '-' WHEN a_type IS NULL THEN 'text' WHEN a_type = 'a b' THEN '-' ELSE lower(a_type) END AS input_type,
  CASE WHEN lower(a_contenteditable) <> 'false' THEN 'true' ELSE 'false' END AS contenteditable FROM tf"""),
    "regions": with_facts(f""",{REGIONS} SELECT page_id, node_ix, region_kind, landmark AS role,
  coalesce(html_id, tag || ':' || landmark, technical) AS label,
  CASE WHEN html_id IS NOT NULL THEN 'HTML_ID' WHEN landmark IS NOT NULL THEN 'LANDMARK_TAG' WHEN technical IS NOT NULL THEN 'TECHNICAL_MARKER' ELSE 'NONE' END AS label_source FROM rg"""),
    "normalize_rects": with_facts(f"""SELECT page_id, node_ix, {_r6('x')} AS "left", {_r6('y')} AS top, {_r6('x + w')} AS "right", {_r6('y + h')} AS bottom FROM tf WHERE NOT isnan(w)"""),
    "rect_rejects": with_facts("SELECT page_id, node_ix, 'NON_FINITE_GEOMETRY' AS code, 'WARNING' AS severity FROM tf WHERE isnan(w)"),
    "viewport_intersection": with_facts(f""", {_BOX} SELECT page_id, node_ix, {_CROSS} > 0 AND {_DOWN} > 0 AS intersects,
  CASE WHEN {_BOX_AREA} = 0 THEN 0.0 ELSE {_r6(f"least(1.0, {_r6(f'{_CROSS} * {_DOWN}')} / {_BOX_AREA})")} END AS ratio, {_BOX_AREA} AS area,
  {_r6('x0 + 0.5')} AS document_x, {_r6('y0 + 120.25')} AS document_y FROM bx"""),
    "overflow_flags": with_facts("""SELECT page_id, node_ix, w + extra_w > w + 1 AS h_overflow, h + extra_h > h + 1 AS v_overflow,
  w + extra_w > w + 1 AND overflow_x IN ('hidden', 'clip') AS h_clip, h + extra_h > h + 1 AND overflow_y IN ('hidden', 'clip') AS v_clip FROM tf""").replace(
        "w + extra_w > w + 1 AS", "coalesce(NOT isnan(w) AND w + extra_w > w + 1, false) AS").replace(
        "w + extra_w > w + 1 AND", "NOT isnan(w) AND w + extra_w > w + 1 AND"),
    "style_facts": with_facts("""SELECT page_id, node_ix, CASE WHEN node_ix % 5 = 0 THEN 6 ELSE 7 END AS n_styles, CASE WHEN node_ix % 5 = 0 THEN 1 ELSE 0 END AS omitted,
  hides AS hidden, scrolls, clips, CASE WHEN position = 'odd' THEN 'other' ELSE position END AS position FROM tf"""),
    "capped_lists": with_facts("""SELECT page_id, node_ix, array_to_string(list_sort(list_distinct(list_filter(tokens, lambda t: regexp_matches(t, '^(elementor-|e-)') AND length(t) < 24))), ',') AS frontend_markers,
  array_to_string(list_sort(list_filter(tokens, lambda t: t LIKE 'elementor-widget-%')), ',') AS widget_markers FROM tf"""),
    "ordinals": with_facts("""SELECT page_id, node_ix, CAST(row_number() OVER (PARTITION BY page_id, coalesce(parent_ix, -1) ORDER BY node_ix) - 1 AS INT) AS sibling_index,
  CAST(row_number() OVER (PARTITION BY page_id, coalesce(parent_ix, -1), tag ORDER BY node_ix) AS INT) AS nth_of_type,
  CAST(count(*) OVER (PARTITION BY page_id, coalesce(parent_ix, -1)) AS INT) AS sibling_count FROM tf"""),
    "emission_ids": with_facts("""SELECT page_id, node_ix, CAST(n AS INT) AS document_order, 'node-' || CASE WHEN n + 1 > 999999 THEN CAST(n + 1 AS VARCHAR) ELSE lpad(CAST(n + 1 AS VARCHAR), 6, '0') END AS node_id
  FROM (SELECT page_id, node_ix, row_number() OVER (PARTITION BY page_id ORDER BY node_ix) - 1 AS n FROM tf WHERE NOT isnan(w) AND tag <> 'script')"""),
    "marker_index": with_facts(f",{_MARKS} SELECT page_id, attr, value, n, complete FROM mi"),
    "structural_refs": with_facts(f",{_STEPS} SELECT page_id, node_ix, structural_ref FROM rf"),
    "identities": with_facts(f""",{_STEPS},
r AS (SELECT page_id, node_ix, coalesce(anchor, structural_ref) AS reference, anchor_source, lvl FROM st JOIN rf USING (page_id, node_ix)),
o AS (SELECT *, count(*) OVER (PARTITION BY page_id, reference) AS n FROM r)
SELECT page_id, node_ix, reference, coalesce(anchor_source, 'STRUCTURAL_PATH') AS identity_source,
  CASE WHEN anchor_source = 'HTML_ID' THEN 'STABLE_HTML_ID' WHEN anchor_source = 'DATA_TEST_ID' THEN 'STABLE_DATA_TEST_ID' WHEN lvl = 0 THEN 'DOCUMENT_ROOT' ELSE 'STRUCTURAL_PATH' END AS identity_strategy,
  CASE WHEN n = 1 THEN 'UNIQUE' ELSE 'AMBIGUOUS' END AS identity_status,
  CASE WHEN n > 1 THEN 'WEAK' WHEN anchor_source IS NULL THEN 'PROBABLE' ELSE 'STRONG' END AS identity_confidence, n - 1 AS collision_count FROM o"""),
    "select_nodes": with_facts(f",{SELECTED} SELECT page_id, node_ix, CAST(scan_rank AS INT) AS scan_rank, visited, selected FROM sl WHERE scanned"),
    "selection_summary": with_facts(f",{_SUMMARY} SELECT * FROM sm"),
    "selection_diagnostics": with_facts(f""",{_SUMMARY} SELECT page_id, 'SCAN_LIMIT_REACHED' AS code, 'WARNING' AS severity, {max(1000, MAX_ELEMENTS * 20)} AS "limit", truncated_branches FROM sm WHERE scan_limited
UNION ALL SELECT page_id, 'DEPTH_LIMIT_REACHED', 'WARNING', maximum_depth, truncated_branches FROM sm WHERE depth_limited
UNION ALL SELECT page_id, 'ELEMENT_LIMIT_REACHED', 'WARNING', {MAX_ELEMENTS}, truncated_branches FROM sm WHERE element_limited"""),
    "prune_hidden": with_facts(f",{_REACH} SELECT page_id, node_ix FROM fl WHERE NOT EXISTS (SELECT 1 FROM blk WHERE blk.page_id = fl.page_id AND blk.node_ix = fl.node_ix)"),
    "traversal_metrics": with_facts(f""",{SELECTED} SELECT page_id, {_metric('builder', '(page_marker IS NOT NULL OR class_marker)')}, {_metric('interactive', 'interactive')},
  {_metric('fixed', "position = 'fixed'")}, {_metric('sticky', "position = 'sticky'")}, NULL::VARCHAR AS issue FROM sl GROUP BY page_id"""),
    "emitted_parents": with_facts("""
, em AS (SELECT page_id, node_ix, row_number() OVER (PARTITION BY page_id ORDER BY node_ix) AS n FROM tf WHERE (node_ix + lvl) % 3 <> 0),
np AS (SELECT a.page_id, a.node_ix, arg_min(n, dist) AS n, min(dist) AS dist FROM tr_anc a JOIN em ON em.page_id = a.page_id AND em.node_ix = a.anc_ix GROUP BY ALL)
SELECT tf.page_id, tf.node_ix, 'node-' || CASE WHEN n > 999999 THEN CAST(n AS VARCHAR) ELSE lpad(CAST(n AS VARCHAR), 6, '0') END AS parent_node_id, coalesce(dist = 1, false) AS parent_emitted FROM tf LEFT JOIN np USING (page_id, node_ix)"""),
    "nearest_ancestors": with_facts(f"""SELECT page_id, node_ix, {_nearest('nearest_hidden', 'f.hides_subtree')}, {_nearest('nearest_positioned', "f.position <> 'static'")},
  {_nearest('nearest_scroll', 'f.scrolls')}, {_nearest('nearest_clipping', 'f.clips')},
  NOT hides AND NOT EXISTS (SELECT 1 FROM tr_anc a JOIN tf f ON f.page_id = a.page_id AND f.node_ix = a.anc_ix WHERE a.page_id = t.page_id AND a.node_ix = t.node_ix AND f.hides_subtree) AS visible FROM tf t"""),
    "clipped_by_ancestor": with_facts(f""", {_BOX}, cb AS (SELECT a.page_id, a.node_ix, bool_or(c.x0 < p.x0 - 0.5 OR c.xr > p.xr + 0.5 OR c.y0 < p.y0 - 0.5 OR c.yb > p.yb + 0.5) AS clipped
  FROM tr_anc a JOIN bx p ON p.page_id = a.page_id AND p.node_ix = a.anc_ix JOIN bx c ON c.page_id = a.page_id AND c.node_ix = a.node_ix WHERE p.clips GROUP BY ALL)
SELECT page_id, node_ix, coalesce(clipped, false) AS clipped FROM bx LEFT JOIN cb USING (page_id, node_ix)"""),
    "visible_in_viewport": with_facts(""", hid AS MATERIALIZED (SELECT DISTINCT a.page_id, a.node_ix, true AS hidden FROM tr_anc a JOIN tf f ON f.page_id = a.page_id AND f.node_ix = a.anc_ix WHERE f.hides_subtree)
SELECT page_id, node_ix, NOT hides AND NOT isnan(w) AND w > 0 AND h > 0 AND y + h > 0 AND x + w > 0 AND y < 800 AND x < 1280 AND hidden IS NULL AS in_viewport FROM tf LEFT JOIN hid USING (page_id, node_ix)"""),
    "parent_regions": with_facts(f""",{REGIONS}, pr AS (SELECT a.page_id, a.node_ix, arg_min(a.anc_ix, a.dist) AS p FROM tr_anc a JOIN rg ON rg.page_id = a.page_id AND rg.node_ix = a.anc_ix GROUP BY ALL)
SELECT rg.page_id, rg.node_ix, coalesce(p, -1) AS parent_region FROM rg LEFT JOIN pr USING (page_id, node_ix)"""),
}
