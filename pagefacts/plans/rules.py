"""Derivation rules of the test shapes, as SQL text that Spark and DuckDB read alike.

Only the shapes are derived here (which markers, boxes or flags a row carries); what operators make of them
is written twice, once in Spark and once in the oracle SQL.
"""

TREE_COLUMNS = {
    "tag": """CASE lvl WHEN 0 THEN 'html' WHEN 1 THEN 'section'
        WHEN 2 THEN CASE WHEN custkey % 9 = 0 THEN 'nav' WHEN custkey % 10 = 1 THEN 'main' ELSE 'div' END
        WHEN 3 THEN CASE WHEN orderkey % 17 = 0 THEN 'noscript' WHEN orderkey % 5 = 0 THEN 'button'
                         WHEN orderkey % 5 = 1 THEN 'a' ELSE 'article' END
        ELSE CASE partkey % 7 WHEN 0 THEN 'a' WHEN 1 THEN 'input' WHEN 2 THEN 'img' WHEN 3 THEN 'script' ELSE 'p' END END""",
    "a_page_id": """CASE WHEN lvl = 0 AND page_id % 5 = 2 THEN concat('other-', CAST(page_id AS VARCHAR(20)))
        WHEN lvl = 0 AND page_id % 5 <> 1 THEN concat('page-', CAST(page_id AS VARCHAR(20)))
        WHEN lvl = 1 AND page_id % 5 = 4 AND seg = 'MACHINERY' THEN 'extra-1' END""",
    "a_data_id": """CASE WHEN lvl = 1 THEN concat('s', seg)
        WHEN lvl = 2 THEN concat('c', CAST(custkey % 400 AS VARCHAR(20)))
        WHEN lvl = 3 AND orderkey % 3 = 0 THEN concat('o', CAST(orderkey AS VARCHAR(20))) END""",
    "a_id": """CASE WHEN lvl = 2 THEN concat('cust-', CAST(custkey % 700 AS VARCHAR(20)))
        WHEN lvl = 3 AND orderkey % 9 = 0 THEN concat('auth-', CAST(orderkey AS VARCHAR(20)))
        WHEN lvl = 3 AND orderkey % 4 = 0 THEN concat(' 7order:', CAST(orderkey AS VARCHAR(20)), ' ') END""",
    "a_testid": """CASE WHEN lvl = 3 AND orderkey % 4 = 1 THEN concat('tid', CAST(orderkey AS VARCHAR(20)))
        WHEN lvl = 4 AND partkey % 3 = 0 THEN concat('t', CAST(partkey AS VARCHAR(20))) END""",
    "a_role": """CASE WHEN lvl = 2 AND custkey % 8 = 0 THEN 'region' WHEN lvl = 2 AND custkey % 8 = 1 THEN ' Search'
        WHEN lvl = 3 AND orderkey % 7 = 3 THEN 'button' WHEN lvl = 3 AND orderkey % 7 = 4 THEN '9bad' END""",
    "a_href": "CASE WHEN lvl = 4 AND partkey % 3 <> 0 THEN '/p' WHEN lvl = 3 AND orderkey % 2 = 0 THEN '/o' END",
    "a_tabindex": "CASE WHEN lvl = 4 AND partkey % 13 = 0 THEN '0' END",
    "a_disabled": "CASE WHEN lvl = 4 AND partkey % 5 = 0 THEN '' WHEN lvl = 3 AND orderkey % 10 = 0 THEN '' END",
    "a_aria_disabled": "CASE WHEN lvl = 3 AND orderkey % 6 = 0 THEN 'TRUE' WHEN lvl = 3 AND orderkey % 6 = 1 THEN 'false' WHEN lvl = 3 AND orderkey % 6 = 2 THEN 'mixed' END",
    "a_aria_expanded": "CASE WHEN lvl = 3 AND orderkey % 8 = 0 THEN 'false' END",
    "a_aria_controls": "CASE WHEN lvl = 3 AND orderkey % 8 = 0 THEN 'x' END",
    "a_type": "CASE WHEN lvl = 4 AND partkey % 4 = 0 THEN 'EMAIL' WHEN lvl = 4 AND partkey % 4 = 1 THEN 'a b' WHEN lvl = 4 AND partkey % 4 = 2 THEN 'text' END",
    "a_contenteditable": "CASE WHEN lvl = 4 AND partkey % 17 = 0 THEN 'true' WHEN lvl = 3 AND orderkey % 37 = 0 THEN 'FALSE' END",
    "class_text": """CASE lvl WHEN 0 THEN CASE WHEN page_id % 3 = 0 THEN 'elementor-html' ELSE '' END
        WHEN 1 THEN CASE WHEN seg = 'BUILDING' THEN 'plain' ELSE 'elementor-section elementor-top-section' END
        WHEN 2 THEN CASE WHEN custkey % 6 = 0 THEN 'plain box' WHEN custkey % 6 = 1 THEN 'e-grid e-flex' ELSE 'e-con e-flex' END
        WHEN 3 THEN CASE WHEN orderkey % 2 = 0 THEN 'elementor-widget-heading elementor-widget-button elementor-element wrap'
                         ELSE 'elementor-element wrap elementor-element' END
        ELSE CASE WHEN partkey % 11 = 0 THEN 'item auth-box zz' WHEN partkey % 11 = 1 THEN 'grid-col item a.b' ELSE 'item' END END""",
    "x": "CASE lvl WHEN 4 THEN CAST(partkey % 1500 AS DOUBLE) + 0.12345678 * CAST(linenumber AS DOUBLE) WHEN 3 THEN CAST(orderkey % 900 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END",
    "y": "CASE lvl WHEN 4 THEN CAST(suppkey * 40 AS DOUBLE) - CAST(200 AS DOUBLE) WHEN 3 THEN CAST(orderkey % 3000 AS DOUBLE) WHEN 2 THEN CAST(custkey % 2000 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END",
    "w": """CASE lvl WHEN 4 THEN CASE WHEN partkey % 97 = 0 THEN CAST('NaN' AS DOUBLE) ELSE quantity * CAST(10 AS DOUBLE) END
        WHEN 3 THEN CAST(300 + orderkey % 200 AS DOUBLE) WHEN 2 THEN CAST(1000 + custkey % 300 AS DOUBLE) ELSE CAST(1440 AS DOUBLE) END""",
    "h": "CASE lvl WHEN 4 THEN CAST((linenumber - 1) * 20 AS DOUBLE) WHEN 3 THEN CAST(200 AS DOUBLE) WHEN 2 THEN CAST(2500 AS DOUBLE) ELSE CAST(9000 AS DOUBLE) END",
    "display": "CASE WHEN lvl = 3 AND orderkey % 11 = 0 THEN 'none' ELSE 'block' END",
    "visibility": "CASE WHEN lvl = 3 AND orderkey % 13 = 0 THEN 'hidden' WHEN lvl = 4 AND partkey % 43 = 0 THEN 'collapse' ELSE 'visible' END",
    "opacity": "CASE WHEN lvl = 4 AND partkey % 31 = 0 THEN '0' WHEN lvl = 2 AND custkey % 41 = 0 THEN '0.0' ELSE '1' END",
    "position": """CASE WHEN lvl = 2 AND custkey % 5 = 0 THEN 'relative' WHEN lvl = 3 AND orderkey % 19 = 0 THEN 'fixed'
        WHEN lvl = 3 AND orderkey % 23 = 0 THEN 'sticky' WHEN lvl = 3 AND orderkey % 29 = 0 THEN 'odd' ELSE 'static' END""",
    "overflow_x": "CASE WHEN lvl = 2 AND custkey % 7 = 0 THEN 'auto' WHEN lvl = 3 AND orderkey % 7 = 0 THEN 'hidden' ELSE 'visible' END",
    "overflow_y": "CASE WHEN lvl = 2 AND custkey % 14 = 0 THEN 'scroll' WHEN lvl = 3 AND orderkey % 14 = 0 THEN 'clip' ELSE 'visible' END",
    "extra_w": "CASE lvl WHEN 4 THEN CAST(suppkey % 4 AS DOUBLE) WHEN 3 THEN CAST(orderkey % 3 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END",
    "extra_h": "CASE lvl WHEN 4 THEN CAST(partkey % 3 AS DOUBLE) WHEN 2 THEN CAST(custkey % 5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END",
}

ATTRIBUTES = {
    "data-elementor-id": "a_page_id", "data-id": "a_data_id", "id": "a_id", "data-testid": "a_testid",
    "role": "a_role", "href": "a_href", "tabindex": "a_tabindex", "disabled": "a_disabled",
    "aria-disabled": "a_aria_disabled", "aria-expanded": "a_aria_expanded", "aria-controls": "a_aria_controls",
    "type": "a_type", "contenteditable": "a_contenteditable",
}
STYLES = {
    "display": "display", "visibility": "visibility", "opacity": "opacity", "position": "position",
    "overflow-x": "overflow_x", "overflow-y": "overflow_y",
}

# Catalogue rows: (filter on tree rows, columns).  `cx` is the page's context.
CATALOGUE_ROWS = "page_id < 23 AND (lvl = 1 OR (lvl = 2 AND custkey % 2 = 0) OR (lvl = 3 AND orderkey % 6 = 0))"
CATALOGUE_COLUMNS = {
    "context_id": "concat('ctx-', CAST(page_id AS VARCHAR(20)))",
    "document_id": """CASE WHEN lvl = 2 AND custkey % 3 = 0 THEN 'loop' WHEN lvl = 2 AND custkey % 3 = 1 THEN 'header'
        ELSE concat('page-', CAST(page_id AS VARCHAR(20))) END""",
    "element_id": """CASE lvl WHEN 1 THEN concat('s', seg) WHEN 2 THEN concat('c', CAST(custkey % 400 AS VARCHAR(20)))
        ELSE concat('o', CAST(orderkey AS VARCHAR(20))) END""",
    "record_text": "concat(CAST(page_id AS VARCHAR(20)), ':', CAST(lvl AS VARCHAR(20)), ':', seg, ':', CAST(coalesce(orderkey, custkey, 0) AS VARCHAR(20)))",
    "parent_element_id": "CASE lvl WHEN 2 THEN concat('s', seg) WHEN 3 THEN concat('c', CAST(custkey % 400 AS VARCHAR(20))) END",
    "ancestor_text": "CASE lvl WHEN 1 THEN '' WHEN 2 THEN concat('s', seg) ELSE concat('s', seg, ',c', CAST(custkey % 400 AS VARCHAR(20))) END",
    "element_kind": "CASE WHEN lvl = 1 THEN 'Section' WHEN lvl = 2 AND custkey % 3 <> 0 THEN 'container' ELSE 'widget' END",
    "el_type": "CASE WHEN lvl = 3 AND orderkey % 12 = 0 THEN 'E-Grid' WHEN lvl = 3 THEN 'widget' END",
    "widget_type": "CASE WHEN lvl = 2 AND custkey % 3 = 0 THEN 'loop-grid' WHEN lvl = 3 THEN 'button' END",
    "architecture_kind": "'classic'",
    "editor_label": "CASE WHEN lvl = 2 AND custkey % 10 = 0 THEN concat('Label ', CAST(custkey AS VARCHAR(20))) END",
}
CONTEXT_COLUMNS = {
    "context_id": "concat('ctx-', CAST(page_id AS VARCHAR(20)))",
    "selected_document_id": "CASE WHEN page_id <> 22 THEN concat('page-', CAST(page_id AS VARCHAR(20))) END",
    "confirmation_state": "CASE WHEN page_id % 4 = 0 THEN 'NOT_CONFIRMED' ELSE 'CONFIRMED' END",
}

# Observation columns over (kind, event_id, user_id, event_type, value, k); later entries may use earlier ones.
_CLEAN = "(kind = 'guided' AND user_id % 4 = 0)"
OBSERVATION_COLUMNS = {
    "session_id": "concat(kind, '-', CAST(user_id AS VARCHAR(20)))",
    "snapshot_id": "concat('00000000-0000-5000-', CASE WHEN kind = 'guided' THEN '8001' ELSE '8000' END, '-', lpad(CAST(event_id AS VARCHAR(20)), 12, '0'))",
    "inner_width": """CAST(CASE WHEN kind = 'guided' THEN CASE event_type WHEN 'click' THEN 1440 WHEN 'view' THEN 820 WHEN 'purchase' THEN 390 ELSE 1280 END
        ELSE CASE k % 5 WHEN 0 THEN 1440 WHEN 1 THEN 820 WHEN 2 THEN 390 WHEN 3 THEN 1280 ELSE 1920 END END AS DOUBLE)""",
    "inner_height": "CAST(CASE WHEN k % 2 = 0 THEN 900 ELSE 800 END AS DOUBLE)",
    "requested_profile": "CASE event_type WHEN 'click' THEN 'DESKTOP' WHEN 'view' THEN 'TABLET' WHEN 'purchase' THEN 'MOBILE' ELSE 'CUSTOM' END",
    "page_binding_state": "CASE k % 4 WHEN 0 THEN 'EXACT' WHEN 1 THEN 'PROBABLE' WHEN 2 THEN 'AMBIGUOUS' ELSE 'UNMATCHED' END",
    "scroll_x": "CAST(0 AS DOUBLE)",
    "scroll_y": f"CASE WHEN NOT {_CLEAN} AND k % 10 = 0 THEN value ELSE CAST(0 AS DOUBLE) END",
    "visibility_state": f"CASE WHEN NOT {_CLEAN} AND k % 25 = 3 THEN 'hidden' ELSE 'visible' END",
    "prerendering": f"NOT {_CLEAN} AND k % 33 = 7",
    "has_focus": "k % 6 <> 0",
    "body_admin_class": f"NOT {_CLEAN} AND k % 20 = 5",
    "admin_element": f"NOT {_CLEAN} AND k % 20 IN (5, 6)",
    "admin_visible": f"NOT {_CLEAN} AND k % 40 = 6",
    "editor_preview": f"NOT {_CLEAN} AND k % 49 = 11",
    "iframe": f"NOT {_CLEAN} AND k % 47 = 13",
    "animations": "k % 3",
    "process_state": f"CASE WHEN NOT {_CLEAN} AND event_type = 'error' AND k < 5 THEN 'ERROR' WHEN k % 9 = 0 THEN 'TIMEOUT' WHEN k % 11 = 0 THEN 'UNSTABLE' ELSE 'STABLE' END",
    "img_broken": f"CASE WHEN NOT {_CLEAN} AND k % 14 = 5 THEN 1 ELSE 0 END",
    "img_pending": f"CASE WHEN NOT {_CLEAN} AND k % 28 = 6 THEN 1 ELSE 0 END",
    "img_failed": f"CASE WHEN NOT {_CLEAN} AND k % 35 = 4 THEN 1 ELSE 0 END",
    "img_timed_out": f"CASE WHEN NOT {_CLEAN} AND k % 42 = 3 THEN 2 ELSE 0 END",
    "incomplete_total": "k % 4",
    "incomplete_in_viewport": "CASE WHEN k % 4 = 3 THEN 1 ELSE 0 END",
    "elements_visited": "100 + k",
    "elements_emitted": "100 + k - k % 9",
    "element_budget": "750",
    "scan_budget": "15000",
    "scan_used": "150 + k",
    "max_depth": "k % 30",
    "truncated": "k % 5",
    "include_hidden": "k % 4 = 0",
    "include_colors": "k % 5 = 0",
    "include_text": "k % 6 = 1",
    "include_relationships": "user_id % 10 <> 0",
    "include_interaction": "k % 8 <> 0",
    "screenshot_requested": "k % 3 = 0",
    "status": "CASE WHEN k % 8 = 1 THEN 'PARTIAL' ELSE 'AVAILABLE' END",
    "completeness": "CASE WHEN k % 6 = 5 THEN 'PARTIAL' ELSE 'COMPLETE' END",
    "reason_text": "CASE WHEN k % 6 <> 5 THEN '' WHEN k % 12 = 5 THEN 'SCAN_LIMIT_REACHED' ELSE 'DEPTH_LIMIT_REACHED,SCAN_LIMIT_REACHED' END",
    "fingerprint_text": "CASE WHEN user_id % 7 = 0 AND k % 10 = 0 THEN 'fp-x' ELSE concat('fp-', CAST(user_id AS VARCHAR(20))) END",
    "reference_text": f"CASE WHEN user_id % 9 = 0 THEN NULL WHEN NOT {_CLEAN} AND k % 31 = 30 THEN 'ref-other' ELSE concat('ref-', CAST(user_id AS VARCHAR(20))) END",
    "user_agent": """CASE event_id % 6 WHEN 0 THEN 'Mozilla/5.0 (Windows NT 10.0) AppleWebKit/537.36 Chrome/120.0.1 Safari/537.36 Edg/120.0.2'
        WHEN 1 THEN 'Mozilla/5.0 (Macintosh) AppleWebKit/605 Version/17.2 Safari/605' WHEN 2 THEN 'Mozilla/5.0 (Linux; Android 14) Chrome/119.0 Mobile'
        WHEN 3 THEN 'Mozilla/5.0 (iPad; CPU OS 17) Version/16.1 Mobile Safari/604' WHEN 4 THEN 'Mozilla/5.0 (X11; Linux) Gecko Firefox/121.0' ELSE 'curl/8' END""",
}
SESSION_COLUMNS = {
    "session_id": "concat(kind, '-', CAST(user_id AS VARCHAR(20)))",
    "status": "CASE user_id % 6 WHEN 0 THEN 'CREATED' WHEN 1 THEN 'CAPTURING' WHEN 2 THEN 'COMPLETE' WHEN 3 THEN 'PARTIAL' WHEN 4 THEN 'FAILED' ELSE 'CANCELLED' END",
    "workflow_mode": f"CASE WHEN {_CLEAN} OR user_id % 3 = 0 THEN 'MINIMUM_PYTHON_FEED' WHEN user_id % 3 = 1 THEN 'RUNTIME_EVIDENCE' END",
    "reference_text": "CASE WHEN user_id % 9 <> 0 THEN concat('ref-', CAST(user_id AS VARCHAR(20))) END",
    "context_id": "CASE WHEN user_id % 9 <> 0 THEN concat('ectx-', CAST(user_id % 10 AS VARCHAR(20))) END",
    "site_text": "CASE WHEN user_id % 9 = 0 THEN NULL WHEN user_id % 13 = 0 THEN 'other' ELSE concat('site-', CAST(user_id % 10 AS VARCHAR(20))) END",
    "selected_document_id": "CASE WHEN user_id % 9 <> 0 AND user_id % 11 <> 0 THEN concat('d-', CAST(user_id % 10 AS VARCHAR(20))) END",
    "confirmation_state": "CASE WHEN user_id % 9 = 0 THEN NULL WHEN user_id % 5 = 1 THEN 'NOT_CONFIRMED' ELSE 'CONFIRMED' END",
}
ELEMENT_COLUMNS = {
    "clipped": "(k + i) % 13 = 0",
    "binding_state": "CASE (event_id + i) % 4 WHEN 0 THEN 'EXACT' WHEN 1 THEN 'PROBABLE' WHEN 2 THEN 'AMBIGUOUS' ELSE 'UNMATCHED' END",
    "relationships_availability": "CASE WHEN (event_id + i) % 331 = 0 THEN 'ERROR' WHEN (event_id + i) % 237 = 0 THEN 'UNAVAILABLE' WHEN (event_id + i) % 117 = 0 THEN 'PARTIAL' ELSE 'AVAILABLE' END",
    "interaction_availability": "CASE WHEN (event_id + i) % 411 = 0 THEN 'INSUFFICIENT' ELSE 'AVAILABLE' END",
    "text_availability": "CASE WHEN (event_id + i) % 5 = 0 THEN 'NOT_APPLICABLE' ELSE 'AVAILABLE' END",
    "overflowing": "(event_id + i) % 3 = 0",
    "identity_status": "CASE WHEN (event_id + i) % 53 = 0 THEN 'AMBIGUOUS' ELSE 'UNIQUE' END",
    "text_over_limit": "(event_id + i) % 61 = 0",
}
DIAGNOSTIC_COLUMNS = {
    "code": """CASE event_type WHEN 'click' THEN CASE k % 4 WHEN 0 THEN 'SCAN_LIMIT_REACHED' WHEN 1 THEN 'DEPTH_LIMIT_REACHED' WHEN 2 THEN 'IDENTITY_COLLISION' ELSE 'PARTIAL_IDENTITY' END
        WHEN 'view' THEN CASE k % 4 WHEN 0 THEN 'READINESS_TIMEOUT' WHEN 1 THEN 'SOURCE_BINDING_AMBIGUOUS' WHEN 2 THEN 'not-a-code' ELSE 'DOCUMENT_NOT_FOCUSED' END
        ELSE 'ELEMENT_LIMIT_REACHED' END""",
    "severity": "CASE k % 7 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'FATAL' WHEN 2 THEN 'INFO' ELSE 'WARNING' END",
    "scope": "CASE WHEN k % 2 = 0 THEN 'SEMANTIC' ELSE 'OPERATIONAL' END",
    "message_key": "CASE WHEN k % 10 = 9 THEN 'Bad Key' ELSE 'diagnostic.derived' END",
    "failure_boundary": "CASE WHEN k % 13 = 0 THEN 'LISTENER_FAILURE' WHEN k % 13 = 1 THEN 'NOWHERE' END",
    "c_limit": "CAST(k % 5 AS VARCHAR(20))",
    "c_url": "CASE WHEN k % 2 = 0 THEN concat('https://u:p@h.example/a', CASE WHEN k % 4 = 0 THEN '?q=1' ELSE '' END, '#f') END",
    "c_token": "CASE WHEN k % 3 = 0 THEN 'secret' END",
    "c_long": "CASE WHEN k % 5 = 0 THEN repeat('y', 600) END",
}
