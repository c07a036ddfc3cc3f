"""Queries that bind the tree forest to its catalogue, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagefacts import fixed
from pagefacts.operators import binding, nodes
from pagefacts.plans import derive, rules
from pagefacts.plans.oracle_base import FACTS, LANDMARK, REGION_KIND, TREE
from pagefacts.plans.page_queries import joined


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return derive.source_elements(spark, sf_dir), derive.source_documents(spark, sf_dir), derive.contexts(spark, sf_dir)


_SHOWN = ("availability", "binding_state", "source_document_id", "source_element_key", "source_section_key", "source_editor_label",
          "source_parent_id", "runtime_ancestor_id", "runtime_count", "unique_in_runtime", "confirmation_state", "page_document_id")


def _shown(bound: DataFrame) -> DataFrame:
    b = F.col("binding")
    return bound.select("page_id", "node_ix", *[b[n].alias(n) for n in _SHOWN], F.coalesce(b["source_count"], F.lit(-1)).alias("source_count"),
                        joined(b["reason_codes"]).alias("reasons"))


def bind_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(binding.bind_direct(derive.written_nodes(spark, sf_dir), *_inputs(spark, sf_dir)))


def bind_nearest_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(binding.bind_nearest_ancestor(derive.written_nodes(spark, sf_dir), *_inputs(spark, sf_dir)))


def bind_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(binding.bind_fallback(derive.written_nodes(spark, sf_dir), *_inputs(spark, sf_dir)))


def read_source_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue written as nested JSON and read back: two tables, counted per context with bound checks."""
    from pagefacts.plans.stored import stored_json
    from pagefacts.sources.catalogue import context_bounds_summary, read_source_context as read

    path = stored_json(spark, sf_dir, "source_context", _nested_context)
    documents, elements, _ = read(spark, path)
    return context_bounds_summary(documents, elements)


def _nested_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested JSON records; a document is cut into records of at most about a thousand elements."""
    elements, documents, _ = _inputs(spark, sf_dir)
    part = F.floor(F.col("document_order") / 1000)
    listed = elements.groupBy("context_id", "document_id", part.alias("part")).agg(
        F.collect_list(F.struct(*elements.columns[2:], "document_id")).alias("elements"))
    whole = documents.join(listed, ["context_id", "document_id"], "left").withColumn(
        "elements", F.coalesce("elements", F.array().cast(listed.schema["elements"].dataType)))
    return whole.select("context_id", F.array(F.struct("document_id", "document_type", "document_fingerprint", "elements")).alias("documents"))


def default_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In every other context the page document stands alone; the others are a context of their own."""
    from pagefacts.operators import conformance

    documents = derive.source_documents(spark, sf_dir)
    number = F.regexp_extract("context_id", "([0-9]+)", 1).cast("int")
    apart = (number % 2 == 0) & (F.col("document_type") != "page")
    return conformance.default_selection(documents.withColumn("context_id", F.when(apart, F.concat("context_id", F.lit("-rest"))).otherwise(F.col("context_id"))))


def source_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = binding.source_sections(derive.source_elements(spark, sf_dir))
    return out.select("context_id", "source_element_key", "section_key", "section_element_id", "section_kind")


def page_marker_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binding.page_marker_state(derive.tree_nodes(spark, sf_dir), derive.contexts(spark, sf_dir))


def region_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements = derive.bound_tree(spark, sf_dir)
    out = binding.region_bindings(nodes.regions(elements.select(*derive.NODE_COLUMNS)), elements)
    return out.select("page_id", "node_ix", "region_kind", "source_binding_state", "source_document_id", "source_section_key", "label", "label_source")


def runtime_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements = derive.bound_tree(spark, sf_dir).drop("instance")
    from pagefacts.functions.digests import digest

    out = binding.runtime_instances(elements, digest(F.concat(F.lit("page-context-"), F.col("page_id").cast("string"))))
    i = F.col("instance")
    return out.select("page_id", "node_ix", i["availability"].alias("availability"), i["instance_state"].alias("instance_state"),
                      i["instance_group_id"].alias("instance_group_id"), F.coalesce(i["instance_index"], F.lit(-1)).alias("instance_index"),
                      i["observed_instance_count"].alias("n"))


def _instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements = derive.bound_tree(spark, sf_dir)
    _, documents, context = _inputs(spark, sf_dir)
    return binding.document_instances(elements, derive.written_nodes(spark, sf_dir), documents, context)


def document_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _instances(spark, sf_dir)


def instance_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _instances(spark, sf_dir).groupBy("page_id", "document_id").agg(
        F.count("*").alias("n_instances"), F.min("instance_index").alias("first_index"), F.max("instance_index").alias("last_index"))


def _cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements, documents, context = _inputs(spark, sf_dir)
    return binding.source_cardinality(elements, documents, derive.bound_tree(spark, sf_dir), context)


def source_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _cardinality(spark, sf_dir)
    return out.withColumn("absence_reason_codes", joined("absence_reason_codes"))


def candidate_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binding.candidate_nodes(derive.bound_tree(spark, sf_dir))


def cardinality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binding.cardinality_summary(_cardinality(spark, sf_dir), derive.bound_tree(spark, sf_dir))


def unbound_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binding.unbound_nodes(derive.bound_tree(spark, sf_dir))


def documents_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, documents, context = _inputs(spark, sf_dir)
    out = binding.documents_present(derive.bound_tree(spark, sf_dir), documents, context)
    return out.withColumn("binding_states", joined("binding_states"))


def document_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, documents, context = _inputs(spark, sf_dir)
    return binding.document_scope(derive.bound_tree(spark, sf_dir), documents, context).select("page_id", "document_id", "observed")


def aggregate_binding_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements = derive.bound_tree(spark, sf_dir).withColumn("document_id", F.coalesce("binding.source_document_id", F.lit("-")))
    return binding.aggregate_binding_state(elements, ["page_id", "document_id"])


def session_binding_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements = derive.bound_tree(spark, sf_dir).withColumn("document_id", F.coalesce("binding.source_document_id", F.lit("-")))
    return binding.session_binding_state(elements, ["page_id", "document_id"])


def relationship_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emitted parents with every 50th reference broken on purpose."""
    elements = derive.bound_tree(spark, sf_dir).withColumns({
        "nearest_parent": F.when(F.col("node_ix") % 50 == 0, F.concat(F.lit("node-x"), F.col("node_ix").cast("string"))).otherwise(F.col("parent_node_id")),
        "nearest_scroll": F.col("parent_node_id"),
    })
    return binding.relationship_issues(elements, ["nearest_parent", "nearest_scroll"])


def exact_binding_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements = derive.bound_tree(spark, sf_dir)
    lost = F.col("binding").withField("source_record_sha256", F.when(F.col("node_ix") % 3 == 0, F.lit(None)).otherwise(F.col("binding.source_record_sha256")))
    return binding.exact_binding_issues(elements.withColumn("binding", lost))


def structure_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements = derive.bound_tree(spark, sf_dir)
    found = nodes.regions(elements.select(*derive.NODE_COLUMNS))
    return binding.structure_summary(elements, found, _instances(spark, sf_dir))


def structure_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structure of every page, over all its elements."""
    elements = derive.bound_tree(spark, sf_dir)
    from pagefacts.functions.digests import digest

    named = elements.withColumn("reference_sha256", digest(F.concat_ws(":", F.lit("ref"), "tag", F.col("node_ix").cast("string"))))
    return binding.structure_digest(named)


def context_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagefacts.operators import conformance

    elements, documents, context = _broken_catalogue(spark, sf_dir)
    return conformance.context_integrity(documents, elements, context)


def _broken_catalogue(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The catalogue with planted faults: repeated documents and keys, foreign documents, lost selections."""
    elements, documents, context = _inputs(spark, sf_dir)
    documents = documents.unionByName(documents.filter("document_id = 'footer' AND context_id IN ('ctx-3', 'ctx-4')"))
    repeated = elements.filter("document_order % 40 = 7")
    foreign = elements.filter("document_order % 60 = 9").withColumn("document_id", F.lit("nowhere"))
    context = context.withColumn("selected_document_id", F.when(F.col("page_id") == 6, "gone").otherwise(F.col("selected_document_id")))
    return elements.unionByName(repeated).unionByName(foreign), documents, context


def context_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagefacts.operators import conformance

    order = F.col("document_order")
    elements = derive.source_elements(spark, sf_dir).withColumns({
        "element_id": F.when(order % 30 == 1, F.concat(F.lit("bad id "), F.col("element_id"))).otherwise(F.col("element_id")),
        "source_element_key": F.when(order % 50 == 2, F.upper("source_element_key")).otherwise(F.col("source_element_key")),
        "id_uniqueness": F.when(order % 70 == 3, "MAYBE").otherwise(F.col("id_uniqueness")),
        "id_occurrence_count": F.when(order % 90 == 4, 100001).otherwise(F.col("id_occurrence_count")),
        "document_order": F.when(order % 110 == 5, -1).otherwise(order), "record": F.col("source_record_sha256"),
    })
    return conformance.context_bounds(elements).select("context_id", "record", "path", "message")


QUERIES = {
    "bind_direct": bind_direct, "bind_nearest_ancestor": bind_nearest_ancestor, "bind_fallback": bind_fallback,
    "read_source_context": read_source_context, "source_sections": source_sections, "page_marker_state": page_marker_state,
    "region_bindings": region_bindings, "runtime_instances": runtime_instances, "document_instances": document_instances,
    "instance_index": instance_index, "source_cardinality": source_cardinality, "candidate_nodes": candidate_nodes,
    "cardinality_summary": cardinality_summary, "unbound_nodes": unbound_nodes, "documents_present": documents_present,
    "document_scope": document_scope, "aggregate_binding_state": aggregate_binding_state, "session_binding_state": session_binding_state,
    "relationship_issues": relationship_issues, "exact_binding_issues": exact_binding_issues, "structure_summary": structure_summary,
    "structure_digest": structure_digest, "context_integrity": context_integrity, "context_bounds": context_bounds, "default_selection": default_selection,
}

# --- oracle SQL ----------------------------------------------------------------------------------

_CC = ", ".join(f"({text}) AS {name}" for name, text in rules.CATALOGUE_COLUMNS.items())
CATALOGUE = f"""
cx AS MATERIALIZED (SELECT page_id, {', '.join(f'({t}) AS {n}' for n, t in rules.CONTEXT_COLUMNS.items())} FROM (SELECT CAST(n_nationkey AS BIGINT) AS page_id FROM nation WHERE n_nationkey < 24)),
sd AS MATERIALIZED (SELECT page_id, context_id, unnest(['page-' || page_id, 'header', 'loop', 'footer']) AS document_id, unnest(['page', 'header', 'loop-item', 'footer']) AS document_type FROM cx WHERE page_id < 23),
se0 AS (SELECT lvl, page_id, {_CC}, node_ix AS document_order FROM tf WHERE {rules.CATALOGUE_ROWS}
  UNION ALL BY NAME SELECT page_id, context_id, 'zero-' || page_id AS element_id, 'page-' || page_id AS document_id, 'Container' AS element_kind, 'extra:' || page_id || ':Container' AS record_text, '' AS ancestor_text, 'classic' AS architecture_kind, 0 AS document_order FROM cx WHERE page_id < 23
  UNION ALL BY NAME SELECT page_id, context_id, NULL AS element_id, 'header' AS document_id, 'widget' AS element_kind, 'extra:' || page_id || ':widget' AS record_text, '' AS ancestor_text, 'classic' AS architecture_kind, 0 AS document_order FROM cx WHERE page_id < 23),
se AS MATERIALIZED (SELECT *, 'sha256:' || sha256('key:' || record_text) AS source_element_key, 'sha256:' || sha256('rec:' || record_text) AS source_record_sha256,
  CASE WHEN element_id IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY context_id, document_id, element_id) END AS occ,
  lower(element_kind) IN ('section', 'container', 'inner_section', 'e-div-block', 'e-grid', 'e-flexbox') OR coalesce(lower(el_type) IN ('section', 'container', 'inner_section', 'e-div-block', 'e-grid', 'e-flexbox'), false) AS structural FROM se0),
up AS (SELECT se.context_id, se.source_element_key, s.source_element_key AS k, s.element_id AS e, s.element_kind AS kind, i.pos
  FROM se, (SELECT 1 AS pos UNION ALL SELECT 2) i, se s
  WHERE s.context_id = se.context_id AND s.document_id = se.document_id AND s.structural AND s.occ = 1 AND s.element_id = string_split(se.ancestor_text, ',')[i.pos]),
ss AS MATERIALIZED (SELECT se.*, coalesce(b.k, CASE WHEN structural THEN se.source_element_key END) AS section_key,
  CASE WHEN b.k IS NOT NULL THEN b.e WHEN structural THEN element_id END AS section_element_id, CASE WHEN b.k IS NOT NULL THEN b.kind WHEN structural THEN element_kind END AS section_kind
  FROM se LEFT JOIN (SELECT context_id, source_element_key, arg_max(k, pos) AS k, arg_max(e, pos) AS e, arg_max(kind, pos) AS kind FROM up GROUP BY ALL) b USING (context_id, source_element_key)),
cand AS (SELECT page_id, element_id, count(*) AS nc, greatest(count(*), max(occ)) AS sc,
  CASE WHEN count(*) = 1 THEN min(document_id) END AS c_doc, CASE WHEN count(*) = 1 THEN min(source_element_key) END AS c_key, CASE WHEN count(*) = 1 THEN min(source_record_sha256) END AS c_rec,
  CASE WHEN count(*) = 1 THEN min(section_key) END AS c_section, CASE WHEN count(*) = 1 THEN min(editor_label) END AS c_label, CASE WHEN count(*) = 1 THEN min(parent_element_id) END AS c_parent,
  CASE WHEN count(*) = 1 THEN min(widget_type) END AS c_widget, CASE WHEN count(*) = 1 THEN min(occ) END AS c_occ FROM ss WHERE element_id IS NOT NULL GROUP BY ALL),
pm AS MATERIALIZED (SELECT page_id, CASE WHEN selected_document_id IS NULL OR count(a_page_id) = 0 THEN 'ABSENT' WHEN count(DISTINCT a_page_id) = 1 AND min(a_page_id) = selected_document_id THEN 'MATCH' ELSE 'CONFLICT' END AS marker_state
  FROM tf LEFT JOIN cx USING (page_id) GROUP BY page_id, selected_document_id),
rc AS (SELECT page_id, data_id, count(*) AS rc FROM tf WHERE data_id IS NOT NULL GROUP BY ALL),
hit AS MATERIALIZED (SELECT tf.page_id, tf.node_ix, tf.data_id AS hit_id, cand.* EXCLUDE (page_id, element_id) FROM tf JOIN cand ON cand.page_id = tf.page_id AND cand.element_id = tf.data_id WHERE tf.class_marker),
near AS (SELECT a.page_id, a.node_ix, arg_min(a.anc_ix, a.dist) AS up_ix FROM tr_anc a JOIN hit ON hit.page_id = a.page_id AND hit.node_ix = a.anc_ix GROUP BY ALL),
bj AS (SELECT tf.page_id, tf.node_ix, tf.data_id, tf.class_marker, coalesce(rc.rc, 0) AS rcount, cx.context_id, cx.selected_document_id AS sel, cx.confirmation_state AS conf, pm.marker_state AS ms, tf.page_id < 23 AS has_docs,
    h.node_ix IS NOT NULL AS is_direct, u.node_ix IS NOT NULL AS is_up, u.hit_id AS up_id, coalesce(h.nc, u.nc) AS nc, coalesce(h.sc, u.sc) AS sc,
    CASE WHEN h.node_ix IS NULL THEN 0 ELSE coalesce(rc.rc, 0) END AS r, CASE WHEN h.node_ix IS NOT NULL THEN h.c_doc ELSE u.c_doc END AS doc, CASE WHEN h.node_ix IS NOT NULL THEN h.c_key ELSE u.c_key END AS key,
    CASE WHEN h.node_ix IS NOT NULL THEN h.c_rec ELSE u.c_rec END AS rec, CASE WHEN h.node_ix IS NOT NULL THEN h.c_section ELSE u.c_section END AS section, CASE WHEN h.node_ix IS NOT NULL THEN h.c_label ELSE u.c_label END AS label,
    CASE WHEN h.node_ix IS NOT NULL THEN h.c_parent ELSE u.c_parent END AS parent, CASE WHEN h.node_ix IS NOT NULL THEN h.c_widget ELSE u.c_widget END AS widget_type, CASE WHEN h.node_ix IS NOT NULL THEN h.c_occ ELSE u.c_occ END AS occ
  FROM tf LEFT JOIN cx USING (page_id) LEFT JOIN pm USING (page_id) LEFT JOIN rc ON rc.page_id = tf.page_id AND rc.data_id = tf.data_id
  LEFT JOIN hit h ON h.page_id = tf.page_id AND h.node_ix = tf.node_ix LEFT JOIN near ON near.page_id = tf.page_id AND near.node_ix = tf.node_ix
  LEFT JOIN hit u ON u.page_id = tf.page_id AND u.node_ix = near.up_ix),
bk AS (SELECT *, coalesce(is_direct AND nc = 1 AND occ = 1 AND sc = 1 AND r = 1 AND ms <> 'CONFLICT' AND (doc <> sel OR sel IS NULL OR ms = 'MATCH'), false) AS exact,
  coalesce(nc > 1 OR sc > 1 OR r > 1, false) AS dup, coalesce(doc = sel, false) AS mine FROM bj),
bd AS MATERIALIZED (SELECT page_id, node_ix, is_direct, is_up,
  CASE WHEN is_direct OR is_up THEN 'AVAILABLE' WHEN context_id IS NULL OR NOT has_docs OR sel IS NULL THEN 'INSUFFICIENT' ELSE 'AVAILABLE' END AS availability,
  CASE WHEN is_direct OR is_up THEN CASE WHEN exact THEN 'EXACT' WHEN ms = 'CONFLICT' OR dup THEN 'AMBIGUOUS' ELSE 'PROBABLE' END
       WHEN context_id IS NULL OR NOT has_docs OR data_id IS NULL THEN 'UNMATCHED' ELSE 'PROBABLE' END AS binding_state,
  CASE WHEN is_direct OR is_up THEN doc WHEN context_id IS NULL OR NOT has_docs THEN NULL ELSE sel END AS source_document_id,
  CASE WHEN is_direct OR is_up THEN key END AS source_element_key, CASE WHEN is_direct OR is_up THEN rec END AS rec, CASE WHEN is_direct OR is_up THEN section END AS source_section_key, CASE WHEN is_direct OR is_up THEN label END AS source_editor_label,
  CASE WHEN is_direct OR is_up THEN widget_type END AS widget_type,
  CASE WHEN is_direct OR is_up THEN parent END AS source_parent_id, CASE WHEN is_up AND NOT is_direct THEN up_id END AS runtime_ancestor_id,
  CASE WHEN is_direct OR is_up THEN r ELSE rcount END AS runtime_count, CASE WHEN is_direct OR is_up THEN is_direct AND r = 1 ELSE rcount = 1 END AS unique_in_runtime,
  CASE WHEN is_direct OR is_up THEN nc = 1 AND occ = 1 AND sc = 1 END AS unique_in_source,
  CASE WHEN is_direct OR is_up THEN conf WHEN context_id IS NULL OR NOT has_docs THEN 'NOT_CONFIRMED' ELSE conf END AS confirmation_state,
  CASE WHEN context_id IS NOT NULL AND (has_docs OR is_direct OR is_up) AND ms = 'MATCH' THEN sel END AS page_document_id,
  CASE WHEN is_direct OR is_up THEN sc WHEN context_id IS NULL OR NOT has_docs THEN -1 ELSE 0 END AS source_count,
  CASE WHEN is_direct OR is_up THEN array_to_string(list_sort(list_filter([CASE WHEN NOT exact AND NOT dup AND ms <> 'CONFLICT' THEN 'BINDING_NOT_EXACT' END,
      CASE WHEN NOT is_direct THEN 'BOUND_TO_NEAREST_VALIDATED_ANCESTOR' END, CASE WHEN doc IS NOT NULL AND NOT mine THEN 'ADDITIONAL_SOURCE_DOCUMENT' END, CASE WHEN ms = 'CONFLICT' THEN 'DOCUMENT_MISMATCH' END,
      CASE WHEN ms = 'ABSENT' AND mine THEN 'PAGE_DOCUMENT_MARKER_NOT_OBSERVED' END, CASE WHEN nc > 1 OR sc > 1 THEN 'DUPLICATE_SOURCE_ID' END, CASE WHEN r > 1 THEN 'DUPLICATE_RUNTIME_ID' END], lambda x: x IS NOT NULL)), ',')
    WHEN context_id IS NULL THEN 'SOURCE_CONTEXT_NOT_IMPORTED' WHEN NOT has_docs THEN 'SOURCE_CONTEXT_HAS_NO_DOCUMENTS' WHEN sel IS NULL THEN 'SOURCE_DOCUMENT_NOT_SELECTED'
    WHEN data_id IS NOT NULL THEN 'SOURCE_ID_NOT_FOUND' WHEN class_marker THEN 'ELEMENTOR_WRAPPER_WITHOUT_SOURCE_ID' ELSE 'OUTSIDE_ELEMENTOR_CONTENT' END AS reasons FROM bk)"""
_COLUMNS = ", ".join(("page_id", "node_ix", *_SHOWN, "source_count", "reasons"))
ELEMENTS = f"""{CATALOGUE},
el0 AS (SELECT tf.*, bd.* EXCLUDE (page_id, node_ix, widget_type), bd.widget_type AS source_widget_type, row_number() OVER (PARTITION BY tf.page_id ORDER BY tf.node_ix) AS n FROM tf JOIN bd USING (page_id, node_ix) WHERE NOT isnan(w) AND tag NOT IN ('script', 'noscript')),
el1 AS MATERIALIZED (SELECT *, 'node-' || CASE WHEN n > 999999 THEN CAST(n AS VARCHAR) ELSE lpad(CAST(n AS VARCHAR), 6, '0') END AS node_id FROM el0),
ea AS MATERIALIZED (SELECT a.page_id, a.node_ix, a.anc_ix, a.dist, e.node_id AS anc_id FROM tr_anc a JOIN el1 e ON e.page_id = a.page_id AND e.node_ix = a.anc_ix),
el AS MATERIALIZED (SELECT el1.*, p.parent_node_ix, p.parent_node_id FROM el1 LEFT JOIN (SELECT page_id, node_ix, arg_min(anc_ix, dist) AS parent_node_ix, arg_min(anc_id, dist) AS parent_node_id FROM ea GROUP BY ALL) p USING (page_id, node_ix))"""
SCOPE = f"""{ELEMENTS},
scope AS MATERIALIZED (SELECT u.page_id, u.document_id, bool_or(observed) AS observed, any_value(sd.document_type) AS document_type FROM (SELECT DISTINCT page_id, source_document_id AS document_id, true AS observed FROM el WHERE source_document_id IS NOT NULL
  UNION ALL SELECT page_id, selected_document_id, false FROM cx WHERE selected_document_id IS NOT NULL) u JOIN sd ON sd.page_id = u.page_id AND sd.document_id = u.document_id GROUP BY ALL),
cd AS MATERIALIZED (SELECT scope.page_id, scope.document_id, se.source_element_key, observed, coalesce(c.n, 0) AS n, c.lo, c.hi FROM scope JOIN se ON se.page_id = scope.page_id AND se.document_id = scope.document_id
  LEFT JOIN (SELECT page_id, source_document_id, source_element_key, count(*) AS n, min(node_id) AS lo, max(node_id) AS hi FROM el WHERE is_direct AND source_element_key IS NOT NULL GROUP BY ALL) c
  ON c.page_id = scope.page_id AND c.source_document_id = scope.document_id AND c.source_element_key = se.source_element_key)"""
INSTANCES = f"""{SCOPE},
roots AS (SELECT *, row_number() OVER (PARTITION BY page_id, source_document_id ORDER BY node_ix) - 1 AS ii FROM el
  WHERE source_document_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM el p WHERE p.page_id = el.page_id AND p.node_ix = el.parent_node_ix AND p.source_document_id = el.source_document_id)),
mem AS (SELECT page_id, node_ix, node_ix AS anc_ix FROM el UNION ALL SELECT ea.page_id, ea.node_ix, ea.anc_ix FROM ea JOIN el USING (page_id, node_ix)),
di AS MATERIALIZED (SELECT r.page_id, 'document-instance-' || substr(sha256('document-instance:' || r.page_id || ':' || r.source_document_id || ':' || r.node_id || ':' || r.ii), 1, 16) AS document_instance_id, r.source_document_id AS document_id, any_value(sd.document_type) AS document_type,
  r.node_id AS root_node_id, count(*) AS bound_runtime_node_count, CAST(r.ii AS INT) AS instance_index,
  CASE WHEN bool_or(m.binding_state = 'AMBIGUOUS') THEN 'AMBIGUOUS' WHEN bool_and(m.binding_state = 'EXACT') THEN 'EXACT' WHEN bool_or(m.binding_state IN ('EXACT', 'PROBABLE')) THEN 'PROBABLE' ELSE 'UNMATCHED' END AS binding_state
  FROM roots r JOIN mem ON mem.page_id = r.page_id AND mem.anc_ix = r.node_ix JOIN el m ON m.page_id = mem.page_id AND m.node_ix = mem.node_ix AND m.source_document_id = r.source_document_id
  JOIN sd ON sd.page_id = r.page_id AND sd.document_id = r.source_document_id GROUP BY r.page_id, r.source_document_id, r.node_id, r.ii)"""
RUNTIME = """
grp AS (SELECT page_id, source_element_key, count(*) AS g FROM el WHERE is_direct AND source_element_key IS NOT NULL GROUP BY ALL),
ri AS MATERIALIZED (SELECT el.page_id, el.node_ix, is_direct, is_up AND NOT is_direct AND source_element_key IS NOT NULL AS nested, is_direct AND source_element_key IS NOT NULL AS dir, coalesce(g, 0) AS g, g IS NOT NULL AS has_group, source_element_key,
  (source_document_id = 'loop') AS loop, row_number() OVER (PARTITION BY el.page_id, source_element_key, is_direct ORDER BY el.node_ix) - 1 AS ix FROM el LEFT JOIN grp USING (page_id, source_element_key)),
rs AS MATERIALIZED (SELECT page_id, node_ix, CASE WHEN dir THEN 'AVAILABLE' WHEN nested THEN 'PARTIAL' ELSE 'INSUFFICIENT' END AS availability,
  CASE WHEN dir THEN CASE WHEN g = 1 THEN 'SINGLE_RENDER' WHEN loop THEN 'REPEATED_TEMPLATE' ELSE 'MULTIPLE_RUNTIME_ROOTS' END WHEN nested THEN 'NESTED_COMPONENT' ELSE 'UNKNOWN' END AS instance_state,
  CASE WHEN (dir OR nested) AND has_group THEN 'sha256:' || sha256('runtime-instance-group:sha256:' || sha256('page-context-' || page_id) || ':' || source_element_key) END AS instance_group_id,
  CASE WHEN dir THEN CAST(ix AS INT) ELSE -1 END AS instance_index, CASE WHEN dir OR nested THEN g ELSE 0 END AS n FROM ri)"""
_EL_REGIONS = f"""
elm AS (SELECT *, {LANDMARK} AS landmark FROM el), erg AS MATERIALIZED (SELECT * FROM (SELECT *, {REGION_KIND} AS region_kind,
  list_sort(list_filter(tokens, lambda t: t IN ('elementor-section', 'elementor-inner-section', 'elementor-container', 'e-con', 'e-con-inner', 'e-grid', 'e-flexbox', 'e-div-block')))[1] AS technical FROM elm) WHERE region_kind IS NOT NULL)"""
_FAULTY = f"""{CATALOGUE},
fd AS (SELECT context_id, document_id FROM sd UNION ALL SELECT context_id, document_id FROM sd WHERE document_id = 'footer' AND context_id IN ('ctx-3', 'ctx-4')),
fe AS (SELECT context_id, document_id, source_element_key FROM se UNION ALL SELECT context_id, document_id, source_element_key FROM se WHERE document_order % 40 = 7
  UNION ALL SELECT context_id, 'nowhere', source_element_key FROM se WHERE document_order % 60 = 9),
fx AS (SELECT context_id, CASE WHEN page_id = 6 THEN 'gone' ELSE selected_document_id END AS sel FROM cx)"""


def _with(clauses: str, body: str) -> str:
    return f"WITH {TREE},{FACTS},{clauses}\n{body}"



ORACLES = {
    "bind_direct": _with(CATALOGUE, f"SELECT {_COLUMNS} FROM bd WHERE is_direct"),
    "bind_nearest_ancestor": _with(CATALOGUE, f"SELECT {_COLUMNS} FROM bd WHERE is_up AND NOT is_direct"),
    "bind_fallback": _with(CATALOGUE, f"SELECT {_COLUMNS} FROM bd WHERE NOT is_up AND NOT is_direct"),
    "read_source_context": _with(CATALOGUE, """SELECT context_id, count(DISTINCT document_id) AS n_documents, (SELECT count(*) FROM se WHERE se.context_id = sd.context_id) AS n_elements,
  false AS too_many_documents, (SELECT count(*) FROM se WHERE se.context_id = sd.context_id) > 50000 AS too_many_elements FROM sd GROUP BY context_id"""),
    "default_selection": _with(CATALOGUE, "SELECT context_id, CASE WHEN count(*) = 1 THEN min(document_id) END AS selected_document_id FROM (SELECT document_id, CASE WHEN page_id % 2 = 0 AND document_type <> 'page' THEN context_id || '-rest' ELSE context_id END AS context_id FROM sd) GROUP BY context_id"),
    "source_sections": _with(CATALOGUE, "SELECT context_id, source_element_key, section_key, section_element_id, section_kind FROM ss"),
    "page_marker_state": _with(CATALOGUE, "SELECT page_id, marker_state FROM pm"),
    "region_bindings": _with(f"{ELEMENTS},{_EL_REGIONS}", """SELECT page_id, node_ix, region_kind, binding_state AS source_binding_state, source_document_id, source_section_key,
  coalesce(source_editor_label, html_id, tag || ':' || landmark, technical) AS label,
  CASE WHEN source_editor_label IS NOT NULL THEN 'ELEMENTOR_EDITOR_LABEL' WHEN html_id IS NOT NULL THEN 'HTML_ID' WHEN landmark IS NOT NULL THEN 'LANDMARK_TAG' WHEN technical IS NOT NULL THEN 'TECHNICAL_MARKER' ELSE 'NONE' END AS label_source FROM erg"""),
    "runtime_instances": _with(f"{ELEMENTS},{RUNTIME}", "SELECT page_id, node_ix, availability, instance_state, instance_group_id, instance_index, n FROM rs"),
    "document_instances": _with(INSTANCES, "SELECT * FROM di"),
    "instance_index": _with(INSTANCES, "SELECT page_id, document_id, count(*) AS n_instances, min(instance_index) AS first_index, max(instance_index) AS last_index FROM di GROUP BY ALL"),
    "source_cardinality": _with(SCOPE, """SELECT page_id, document_id, source_element_key, n AS runtime_candidate_count, CASE WHEN n = 0 THEN 'ZERO' WHEN n = 1 THEN 'ONE' ELSE 'ONE_TO_MANY' END AS cardinality_state, lo AS first_node_id, hi AS last_node_id,
  CASE WHEN n > 0 THEN '' WHEN observed THEN 'RUNTIME_CANDIDATE_NOT_OBSERVED' ELSE 'SOURCE_DOCUMENT_NOT_PRESENT,RUNTIME_CANDIDATE_NOT_OBSERVED' END AS absence_reason_codes FROM cd"""),
    "candidate_nodes": _with(ELEMENTS, "SELECT page_id, source_document_id AS document_id, source_element_key, node_id FROM el WHERE is_direct AND source_element_key IS NOT NULL"),
    "cardinality_summary": _with(SCOPE, """SELECT page_id, count_if(NOT (is_direct AND source_element_key IS NOT NULL)) AS n_without_source, coalesce(any_value(c.t), 0) AS source_elements_imported, coalesce(any_value(c.z), 0) AS n_zero,
  coalesce(any_value(c.o), 0) AS n_one, coalesce(any_value(c.m), 0) AS n_many, CASE WHEN any_value(c.t) IS NULL THEN 'INSUFFICIENT' WHEN bool_or(binding_state = 'AMBIGUOUS') THEN 'PARTIAL' ELSE 'AVAILABLE' END AS availability
  FROM el LEFT JOIN (SELECT page_id, count(*) AS t, count_if(n = 0) AS z, count_if(n = 1) AS o, count_if(n > 1) AS m FROM cd GROUP BY ALL) c USING (page_id) GROUP BY page_id"""),
    "unbound_nodes": _with(ELEMENTS, "SELECT page_id, count_if(NOT (is_direct AND source_element_key IS NOT NULL)) AS n FROM el GROUP BY page_id"),
    "documents_present": _with(SCOPE, """SELECT scope.page_id, scope.document_id, document_type, 'sha256:' || sha256('doc:ctx-' || scope.page_id || ':' || scope.document_id) AS document_fingerprint,
  coalesce(s, '') AS binding_states, coalesce(n, 0) AS bound_runtime_node_count FROM scope LEFT JOIN (SELECT page_id, source_document_id AS document_id, array_to_string(list_sort(list_distinct(list(binding_state))), ',') AS s, count(*) AS n FROM el WHERE source_document_id IS NOT NULL GROUP BY ALL) USING (page_id, document_id)"""),
    "document_scope": _with(SCOPE, "SELECT page_id, document_id, observed FROM scope"),
    "aggregate_binding_state": _with(ELEMENTS, """SELECT page_id, coalesce(source_document_id, '-') AS document_id, CASE WHEN count_if(binding_state = 'AMBIGUOUS') > 0 THEN 'AMBIGUOUS' WHEN count_if(binding_state <> 'EXACT') = 0 THEN 'EXACT'
  WHEN count_if(binding_state IN ('EXACT', 'PROBABLE')) > 0 THEN 'PROBABLE' ELSE 'UNMATCHED' END AS binding_state, count(*) AS n FROM el GROUP BY ALL"""),
    "session_binding_state": _with(ELEMENTS, """SELECT page_id, coalesce(source_document_id, '-') AS document_id, CASE WHEN count_if(binding_state = 'EXACT') > 0 THEN 'EXACT' WHEN count_if(binding_state = 'PROBABLE') > 0 THEN 'PROBABLE'
  WHEN count_if(binding_state = 'AMBIGUOUS') > 0 THEN 'AMBIGUOUS' ELSE 'UNMATCHED' END AS binding_state FROM el GROUP BY ALL"""),
    "relationship_issues": _with(ELEMENTS, "SELECT page_id, node_id, 'nearest_parent' AS relation, 'node-x' || node_ix AS ref FROM el WHERE node_ix % 50 = 0"),
    "exact_binding_issues": _with(ELEMENTS, "SELECT page_id, node_id, 'EXACT_BINDING_WITHOUT_EVIDENCE' AS issue FROM el WHERE binding_state = 'EXACT' AND node_ix % 3 = 0"),
    "structure_summary": _with(f"{INSTANCES},{RUNTIME},{_EL_REGIONS}", """SELECT page_id, count(DISTINCT source_document_id) AS source_document_count, count(DISTINCT source_section_key) AS source_section_count, count(source_widget_type) AS source_widget_count,
  count_if(len(list_filter(tokens, lambda t: t LIKE 'elementor-widget-%')) > 0) AS runtime_widget_marker_count, count_if(binding_state = 'EXACT') AS exact_binding_count, count_if(binding_state = 'PROBABLE') AS probable_binding_count,
  count_if(binding_state = 'AMBIGUOUS') AS ambiguous_binding_count, count_if(binding_state = 'UNMATCHED') AS unmatched_runtime_node_count, count(DISTINCT CASE WHEN instance_state = 'REPEATED_TEMPLATE' THEN instance_group_id END) AS repeated_runtime_instance_group_count,
  coalesce(any_value(r.a), 0) AS runtime_region_count, coalesce(any_value(r.s), 0) AS runtime_section_region_count, coalesce(any_value(r.c), 0) AS runtime_container_region_count, coalesce(any_value(d.n), 0) AS document_instance_count
  FROM el JOIN (SELECT page_id, node_ix, instance_state, instance_group_id FROM rs) USING (page_id, node_ix) LEFT JOIN (SELECT page_id, count(*) AS a, count_if(region_kind IN ('HTML_SECTION', 'ELEMENTOR_SECTION')) AS s, count_if(region_kind IN ('ELEMENTOR_CONTAINER', 'ATOMIC_CONTAINER')) AS c FROM erg GROUP BY ALL) r USING (page_id)
  LEFT JOIN (SELECT page_id, count(*) AS n FROM di GROUP BY ALL) d USING (page_id) GROUP BY page_id"""),
    "structure_digest": _with(f"""{ELEMENTS}, part AS (SELECT page_id, (n - 1) // 1000 AS part, count(*) AS c, 'sha256:' || sha256('[' || string_agg('{{"node_id":"' || node_id || '","parent_node_id":' || coalesce('"' || parent_node_id || '"', 'null') || ',"reference_sha256":"sha256:' || sha256('ref:' || tag || ':' || node_ix)
  || '","source_element_key":' || coalesce('"' || source_element_key || '"', 'null') || '}}', ',' ORDER BY node_ix) || ']') AS d FROM el GROUP BY ALL)""",
"""SELECT page_id, CAST(sum(c) AS BIGINT) AS n_elements, CASE WHEN count(*) = 1 THEN min(d) ELSE 'sha256:' || sha256('["' || string_agg(d, '","' ORDER BY part) || '"]') END AS structure_sha256, sum(c) > 1000 AS over_published_limit FROM part GROUP BY page_id"""),
    "context_integrity": _with(_FAULTY, """SELECT context_id, 'DUPLICATE_DOCUMENT' AS issue, document_id AS subject, count(*) AS n FROM fd GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT context_id, 'ELEMENT_DOCUMENT_MISMATCH', document_id, count(*) FROM fe WHERE NOT EXISTS (SELECT 1 FROM fd WHERE fd.context_id = fe.context_id AND fd.document_id = fe.document_id) GROUP BY ALL
UNION ALL SELECT context_id, 'DUPLICATE_SOURCE_ELEMENT_KEY', document_id || ':' || source_element_key, count(*) FROM fe GROUP BY context_id, document_id, source_element_key HAVING count(*) > 1
UNION ALL SELECT context_id, 'UNKNOWN_SELECTION', sel, 1 FROM fx WHERE sel IS NOT NULL AND NOT EXISTS (SELECT 1 FROM fd WHERE fd.context_id = fx.context_id AND fd.document_id = fx.sel)"""),
    "context_bounds": _with(CATALOGUE, """SELECT context_id, source_record_sha256 AS record, 'element_id' AS path, 'pattern' AS message FROM se WHERE document_order % 30 = 1 AND element_id IS NOT NULL
UNION ALL SELECT context_id, source_record_sha256, 'source_element_key', 'pattern' FROM se WHERE document_order % 50 = 2
UNION ALL SELECT context_id, source_record_sha256, 'id_uniqueness', 'enum' FROM se WHERE document_order % 70 = 3
UNION ALL SELECT context_id, source_record_sha256, 'id_occurrence_count', 'range' FROM se WHERE document_order % 90 = 4
UNION ALL SELECT context_id, source_record_sha256, 'document_order', 'range' FROM se WHERE document_order % 110 = 5"""),
}
