"""Binding of page elements to catalogue records, and what follows from it.

The catalogue side is always reduced to one row per (context, element id) before it meets the elements, so an
id that a third of all nodes carry only makes the element side of a join large, which AQE splits.  Whether the
reduced catalogue is broadcast is left to Spark's size check.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagefacts import fixed
from pagefacts.functions import markers
from pagefacts.functions.digests import canonical_struct, digest
from pagefacts.functions.patterns import compact
from pagefacts.operators.intervals import enclosed_owners, enclosing
from pagefacts.operators.ranking import join_page_facts, node_bucket, ordinal, running_totals
from pagefacts.session import written

DIRECT, ANCESTOR = "DIRECT_VALIDATED_MARKER", "ANCESTOR_VALIDATED_MARKER"
_RECORD = (
    "document_id", "document_type", "source_element_key", "source_record_sha256", "parent_element_id",
    "element_kind", "widget_type", "architecture_kind", "editor_label", "id_uniqueness",
    "section_key", "section_element_id", "section_kind",
)


def is_structural() -> Column:
    hits = [F.lower(F.coalesce(F.col(c), F.lit(""))).isin(*fixed.STRUCTURAL_KINDS) for c in ("element_kind", "el_type", "architecture_kind")]
    return hits[0] | hits[1] | hits[2]


def source_sections(source_elements: DataFrame) -> DataFrame:
    """Deepest unique structural ancestor of every catalogue record, else the record itself if structural."""
    keyed = source_elements.withColumn("_structural", is_structural())
    sections = keyed.filter("_structural AND id_uniqueness = 'UNIQUE' AND element_id IS NOT NULL").select(
        "context_id", "document_id", F.col("element_id").alias("_anc"), F.col("source_element_key").alias("_key"),
        F.col("element_kind").alias("_kind"))
    up = keyed.select("context_id", "document_id", "source_element_key", F.posexplode("ancestor_element_ids").alias("_pos", "_anc"))
    best = up.join(sections, ["context_id", "document_id", "_anc"]).groupBy("context_id", "document_id", "source_element_key").agg(
        F.max(F.struct("_pos", "_key", "_anc", "_kind")).alias("_best"))
    out = keyed.join(best, ["context_id", "document_id", "source_element_key"], "left")
    own = F.col("_best").isNull() & F.col("_structural")
    return out.withColumns({
        "section_key": F.coalesce("_best._key", F.when(own, F.col("source_element_key"))),
        "section_element_id": F.coalesce("_best._anc", F.when(own, F.col("element_id"))),
        "section_kind": F.coalesce("_best._kind", F.when(own, F.col("element_kind"))),
    }).drop("_best", "_structural")


def candidates(source_elements: DataFrame, source_documents: DataFrame) -> DataFrame:
    """One row per (context, element id): how many records share it, and the record when there is one."""
    typed = source_sections(source_elements).join(
        source_documents.select("context_id", "document_id", "document_type"), ["context_id", "document_id"])
    grouped = typed.filter("element_id IS NOT NULL").groupBy("context_id", "element_id").agg(
        F.count("*").alias("n_candidates"), F.max("id_occurrence_count").alias("_occurrences"), F.min(F.struct(*_RECORD)).alias("_record"))
    return grouped.select(
        "context_id", "element_id", "n_candidates", F.greatest("n_candidates", "_occurrences").alias("source_count"),
        F.when(F.col("n_candidates") == 1, F.col("_record")).alias("record"))


def page_marker_state(nodes: DataFrame, context: DataFrame) -> DataFrame:
    """MATCH, ABSENT or CONFLICT of the raw page markers with the selected document."""
    raw = F.when(F.col("attrs")[fixed.PAGE_ID_ATTRIBUTE] != "", F.col("attrs")[fixed.PAGE_ID_ATTRIBUTE])
    # Extremes of texts sort what they group, so only nodes that carry a marker are grouped by them.
    carried = nodes.select(F.col("page_id").alias("_page"), raw.alias("_raw")).filter("_raw IS NOT NULL").groupBy("_page").agg(
        F.min("_raw").alias("_low"), F.max("_raw").alias("_high"))
    pages = nodes.select("page_id").distinct()
    seen = pages.join(carried, pages["page_id"].eqNullSafe(carried["_page"]), "left")
    selected = F.col("selected_document_id")
    state = (
        F.when(selected.isNull() | F.col("_low").isNull(), "ABSENT")
        .when((F.col("_low") == F.col("_high")) & (F.col("_low") == selected), "MATCH").otherwise("CONFLICT")
    )
    return seen.join(context.select("page_id", "selected_document_id"), "page_id", "left").select("page_id", state.alias("marker_state"))


def _from_candidates(basis: str, element_id: Column, runtime_count: Column, found: Column) -> Column:
    """Binding record of an element whose marker (or whose ancestor's) has catalogue records.

    `found` is a struct (n_candidates, source_count, record); page facts are columns of the row.
    """
    record, many, total = found["record"], found["n_candidates"] > 1, found["source_count"] > 1
    single = record.isNotNull()
    unique_source = F.coalesce(single & (record["id_uniqueness"] == "UNIQUE") & (found["source_count"] == 1), F.lit(False))
    unique_runtime = F.coalesce(element_id.isNotNull() & (runtime_count == 1), F.lit(False))
    duplicate = many | total | (runtime_count > 1)
    conflict = F.col("marker_state") == "CONFLICT"
    selected = F.coalesce(single & (record["document_id"] == F.col("selected_document_id")), F.lit(False))
    exact = unique_source & unique_runtime & ~conflict & (~selected | (F.col("marker_state") == "MATCH"))
    reasons = compact(
        F.when(~exact & ~duplicate & ~conflict, "BINDING_NOT_EXACT"),
        F.lit("BOUND_TO_NEAREST_VALIDATED_ANCESTOR" if basis == ANCESTOR else None).cast("string"),
        F.when(single & ~selected, "ADDITIONAL_SOURCE_DOCUMENT"),
        F.when(conflict, "DOCUMENT_MISMATCH"),
        F.when(~conflict & selected & (F.col("marker_state") == "ABSENT"), "PAGE_DOCUMENT_MARKER_NOT_OBSERVED"),
        F.when(many | total, "DUPLICATE_SOURCE_ID"),
        F.when(runtime_count > 1, "DUPLICATE_RUNTIME_ID"),
    )
    state = F.when(exact, "EXACT" if basis == DIRECT else "PROBABLE").when(conflict | duplicate, "AMBIGUOUS").otherwise("PROBABLE")
    return _record(
        availability=F.lit("AVAILABLE"), binding_state=state, binding_basis=F.lit(basis), reason_codes=F.array_sort(reasons),
        source_document_id=record["document_id"], source_document_type=record["document_type"],
        source_element_key=record["source_element_key"], source_record_sha256=record["source_record_sha256"],
        source_element_kind=record["element_kind"], source_widget_type=record["widget_type"],
        source_architecture_kind=record["architecture_kind"], source_editor_label=record["editor_label"],
        source_section_key=record["section_key"], source_section_element_id=record["section_element_id"],
        source_section_kind=record["section_kind"], element_id=F.when(single, element_id),
        source_parent_id=record["parent_element_id"], runtime_ancestor_id=F.lit(None).cast("string"),
        runtime_count=runtime_count, source_count=found["source_count"], unique_in_runtime=unique_runtime,
        unique_in_source=unique_source, confirmation_state=F.col("confirmation_state"),
        page_document_id=F.when(F.col("marker_state") == "MATCH", F.col("selected_document_id")),
    )


_BINDING_TYPES = {
    "availability": "string", "binding_state": "string", "binding_basis": "string", "reason_codes": "array<string>",
    "source_document_id": "string", "source_document_type": "string", "source_element_key": "string",
    "source_record_sha256": "string", "source_element_kind": "string", "source_widget_type": "string",
    "source_architecture_kind": "string", "source_editor_label": "string", "source_section_key": "string",
    "source_section_element_id": "string", "source_section_kind": "string", "element_id": "string",
    "source_parent_id": "string", "runtime_ancestor_id": "string", "runtime_count": "bigint", "source_count": "bigint",
    "unique_in_runtime": "boolean", "unique_in_source": "boolean", "confirmation_state": "string", "page_document_id": "string",
}


def _record(**values: Column) -> Column:
    fields = [values.get(n, F.lit(None)).cast(t).alias(n) for n, t in _BINDING_TYPES.items()]
    return F.struct(*fields)


def _fallback() -> Column:
    """Binding record of an element without any catalogue record on its path."""
    no_context, no_documents = F.col("context_id").isNull(), ~F.coalesce(F.col("has_documents"), F.lit(False))
    no_selection, no_marker = F.col("selected_document_id").isNull(), F.col("_data_id").isNull()
    reason = (
        F.when(no_context, "SOURCE_CONTEXT_NOT_IMPORTED").when(no_documents, "SOURCE_CONTEXT_HAS_NO_DOCUMENTS")
        .when(no_selection, "SOURCE_DOCUMENT_NOT_SELECTED").when(~no_marker, "SOURCE_ID_NOT_FOUND")
        .when(F.col("_class_marker"), "ELEMENTOR_WRAPPER_WITHOUT_SOURCE_ID").otherwise("OUTSIDE_ELEMENTOR_CONTENT")
    )
    out = no_context | no_documents
    basis = F.when(no_context, "NO_SOURCE_CONTEXT").when(no_documents | no_marker, "NO_MATCH").otherwise("RAW_MARKER_ONLY")
    return _record(
        availability=F.when(out | no_selection, "INSUFFICIENT").otherwise("AVAILABLE"),
        binding_state=F.when(out | no_marker, "UNMATCHED").otherwise("PROBABLE"), binding_basis=basis,
        reason_codes=F.array(reason), source_document_id=F.when(~out, F.col("selected_document_id")),
        runtime_count=F.col("_runtime_count"), source_count=F.when(~out, F.lit(0)),
        unique_in_runtime=F.col("_runtime_count") == 1, unique_in_source=F.when(~out, F.lit(False)),
        confirmation_state=F.when(out, "NOT_CONFIRMED").otherwise(F.col("confirmation_state")),
        page_document_id=F.when(~out & (F.col("marker_state") == "MATCH"), F.col("selected_document_id")),
    )


def _record_key(found: str) -> Column:
    return F.col(f"{found}.record.source_element_key")


class _Catalogue:
    """What the three bases of a binding share: page facts, marked nodes, and those of them that the catalogue knows."""

    def __init__(self, nodes: DataFrame, source_elements: DataFrame, source_documents: DataFrame, context: DataFrame) -> None:
        documents = source_documents.groupBy("context_id").agg(F.lit(True).alias("has_documents"))
        self.nodes = nodes
        pages = page_marker_state(nodes, context).join(context.drop("site_fingerprint"), "page_id", "left").join(documents, "context_id", "left")
        # Facts of a page that come twice are told apart by `_copy`, so that what is worked out from one of them meets its own rows only.
        self.pages = written(pages.withColumn("_copy", F.row_number().over(Window.partitionBy("page_id").orderBy("page_id"))))
        # Only rows that carry a marker meet the catalogue; attributes are read once.
        marked = written(nodes.select("page_id", "node_ix", markers.data_id().alias("_data_id"), markers.class_marker().alias("_class_marker")).filter(
            "_data_id IS NOT NULL"))
        counts = marked.groupBy("page_id", "_data_id").agg(F.count("*").alias("_runtime_count"))
        marked = written(marked.join(counts, ["page_id", "_data_id"], "left"))
        known = candidates(source_elements, source_documents).withColumnRenamed("element_id", "_data_id")
        hits = join_page_facts(marked.filter("_class_marker"), context.select("page_id", "context_id"), nodes).join(known, ["context_id", "_data_id"])
        self.own = marked.select("page_id", "node_ix", "_data_id", "_runtime_count")
        self.hits = written(hits.select("page_id", "node_ix", "_data_id", "_runtime_count", F.struct("n_candidates", "source_count", "record").alias("_found")))

    @cached_property
    def _owners(self) -> DataFrame:
        nearest_hit = enclosing(self.nodes, self.hits.select("page_id", "node_ix", F.lit(True).alias("bearing")), "bearing")
        return written(nearest_hit.select("page_id", F.col("owner_ix").alias("parent_ix"), F.col("_best_bearing.node_ix").alias("_up")))

    def owners(self) -> DataFrame:
        """(page_id, parent_ix, _up): where the nearest known node from a parent up is."""
        return self._owners

    def found(self) -> DataFrame:
        """(page_id, _up, _above, _above_id): what the known nodes hand down."""
        return self.hits.select("page_id", F.col("node_ix").alias("_up"), F.col("_found").alias("_above"), F.col("_data_id").alias("_above_id"))

    def above(self) -> DataFrame:
        """(page_id, parent_ix, _above, _above_id): the nearest known node from a parent up."""
        return self.owners().join(self.found(), ["page_id", "_up"]).drop("_up")

    def placed(self, rows: DataFrame, hits: DataFrame) -> DataFrame:
        """`rows` of nodes (page_id, node_ix, parent_ix, …) with page facts, own marker, columns of `hits` and `_up`; only the few known nodes have a record here.

        Nodes below none get an `_up` that names no node, another one in each bucket of their page.
        """
        out = join_page_facts(rows, self.pages, self.nodes, "left").join(self.owners(), ["page_id", "parent_ix"], "left")
        out = out.join(self.own, ["page_id", "node_ix"], "left").join(hits, ["page_id", "node_ix"], "left")
        return out.withColumns({"_runtime_count": F.coalesce("_runtime_count", F.lit(0)), "_up": F.coalesce("_up", (-1 - node_bucket()).cast("int"))})

    def direct(self, elements: DataFrame) -> DataFrame:
        """(page_id, node_ix, _key): the rows of `elements` that have a record of their own, once for each time their binding comes."""
        own = elements.select("page_id", "node_ix").join(
            self.hits.select("page_id", "node_ix", _record_key("_found").alias("_key")).filter("_key IS NOT NULL"), ["page_id", "node_ix"])
        up = self.nodes.select("page_id", "node_ix", "parent_ix").join(self.hits.select("page_id", "node_ix").distinct(), ["page_id", "node_ix"])
        up = up.join(self.owners(), ["page_id", "parent_ix"], "left").join(self.found().select("page_id", "_up"), ["page_id", "_up"], "left")
        return own.join(up.select("page_id", "node_ix"), ["page_id", "node_ix"]).join(self.own.select("page_id", "node_ix"), ["page_id", "node_ix"])

    def bound(self, rows: DataFrame, binding: Column) -> DataFrame:
        """`rows` with their page facts and then `binding`; nothing else is left of either."""
        columns = self.nodes.columns
        return join_page_facts(rows, self.pages, self.nodes, "left").withColumns({
            "_runtime_count": F.coalesce("_runtime_count", F.lit(0)), "_class_marker": markers.class_marker()}).select(*columns, binding.alias("binding"))


def _direct_binding() -> Column:
    return _from_candidates(DIRECT, F.col("_data_id"), F.col("_runtime_count"), F.col("_found"))


def _inherited_binding() -> Column:
    inherited = _from_candidates(ANCESTOR, F.lit(None).cast("string"), F.lit(0).cast("bigint"), F.col("_above"))
    return inherited.withField("runtime_ancestor_id", F.col("_above_id"))


def _binding() -> Column:
    return F.when(F.col("_found").isNotNull(), _direct_binding()).when(F.col("_above").isNotNull(), _inherited_binding()).otherwise(_fallback())


def bind_elements(nodes: DataFrame, source_elements: DataFrame, source_documents: DataFrame, context: DataFrame) -> DataFrame:
    """Add `binding`: direct marker, else nearest validated ancestor, else the reason for neither.

    `context` has one row per page: page_id, context_id, selected_document_id, confirmation_state.
    """
    known = _Catalogue(nodes, source_elements, source_documents, context)
    rows = known.placed(nodes.withColumn("_class_marker", markers.class_marker()), known.hits.select("page_id", "node_ix", "_found"))
    return rows.join(known.found(), ["page_id", "_up"], "left").select(*nodes.columns, _binding().alias("binding"))


def bind_direct(nodes: DataFrame, source_elements: DataFrame, source_documents: DataFrame, context: DataFrame) -> DataFrame:
    """The elements of `bind_elements` whose own marker is known; nothing is searched for the others."""
    known = _Catalogue(nodes, source_elements, source_documents, context)
    return known.bound(nodes.join(known.hits, ["page_id", "node_ix"]), _direct_binding())


def bind_nearest_ancestor(nodes: DataFrame, source_elements: DataFrame, source_documents: DataFrame, context: DataFrame) -> DataFrame:
    """The elements of `bind_elements` that inherit the binding of a node above them."""
    known = _Catalogue(nodes, source_elements, source_documents, context)
    below = nodes.join(known.above(), ["page_id", "parent_ix"]).join(known.hits.select("page_id", "node_ix"), ["page_id", "node_ix"], "left_anti")
    return known.bound(below.withColumn("_runtime_count", F.lit(0).cast("bigint")), _inherited_binding())


def bind_fallback(nodes: DataFrame, source_elements: DataFrame, source_documents: DataFrame, context: DataFrame) -> DataFrame:
    """The elements of `bind_elements` that neither carry a known marker nor lie below one."""
    known = _Catalogue(nodes, source_elements, source_documents, context)
    hits = known.hits.select("page_id", "node_ix", F.lit(True).alias("bearing"))
    below = enclosed_owners(nodes, hits, "bearing").withColumnRenamed("owner_ix", "parent_ix")
    rest = nodes.join(hits, ["page_id", "node_ix"], "left_anti").join(below, ["page_id", "parent_ix"], "left_anti").join(known.own, ["page_id", "node_ix"], "left")
    return known.bound(rest, _fallback())


# --- after binding -------------------------------------------------------------------------------
# `elements` below has page_id, node_ix, node_id, binding and, where used, parent_node_ix.


def _direct(elements: DataFrame) -> DataFrame:
    return elements.filter((F.col("binding.binding_basis") == DIRECT) & F.col("binding.source_element_key").isNotNull())


def unbound_nodes(elements: DataFrame) -> DataFrame:
    bound = F.coalesce((F.col("binding.binding_basis") == DIRECT) & F.col("binding.source_element_key").isNotNull(), F.lit(False))
    return elements.groupBy("page_id").agg(F.count_if(~bound).alias("n"))


def _instance(direct: Column, key: Column, page_context_id: Column) -> Column:
    """The struct `instance` of a row with `binding`, `_n` and `_index`."""
    repeated = F.col("_n") > 1
    template = repeated & F.coalesce(F.lower("binding.source_document_type") == "loop-item", F.lit(False))
    nested = (F.col("binding.binding_basis") == ANCESTOR) & key.isNotNull()
    group_id = digest(F.concat(F.lit("runtime-instance-group:"), page_context_id, F.lit(":"), key))
    return F.struct(
        F.when(direct, "AVAILABLE").when(nested, "PARTIAL").otherwise("INSUFFICIENT").alias("availability"),
        F.when(direct, F.when(~repeated, "SINGLE_RENDER").when(template, "REPEATED_TEMPLATE").otherwise("MULTIPLE_RUNTIME_ROOTS"))
        .when(nested, "NESTED_COMPONENT").otherwise("UNKNOWN").alias("instance_state"),
        F.when((direct | nested) & F.col("_n").isNotNull(), group_id).alias("instance_group_id"),
        F.col("_index").alias("instance_index"),
        F.when(direct | nested, F.coalesce("_n", F.lit(0))).otherwise(0).alias("observed_instance_count"),
        F.when(direct | nested, "SHARED_SOURCE_ELEMENT_KEY").otherwise("NO_VALIDATED_SOURCE_KEY").alias("instance_basis"),
    )


def _instance_counts(direct: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups, numbered) of the direct rows (page_id, _key, node_ix): rows of a record, and the place of each among them."""
    numbered = ordinal(direct, ["page_id", "_key"], ["node_ix"], node_bucket(), "_index")
    return direct.groupBy("page_id", "_key").agg(F.count("*").alias("_n")), numbered.drop("_key")


def _bound_directly() -> Column:
    return F.coalesce((F.col("binding.binding_basis") == DIRECT) & F.col("binding.source_element_key").isNotNull(), F.lit(False))


def runtime_instances(elements: DataFrame, page_context_id: Column) -> DataFrame:
    """Add `instance`: which rendering of its catalogue record an element is."""
    key = F.col("binding.source_element_key")
    keyed = elements.withColumns({"_key": F.coalesce(key, F.concat(F.lit("\u0000"), F.col("node_ix").cast("string"))), "_direct": _bound_directly()})
    groups, numbered = _instance_counts(keyed.filter("_direct").select("page_id", "_key", "node_ix"))
    out = keyed.join(groups, ["page_id", "_key"], "left").join(numbered, ["page_id", "node_ix"], "left")
    return out.withColumn("instance", _instance(F.col("_direct"), key, page_context_id)).drop("_key", "_direct", "_n", "_index")


def bound_instances(
    elements: DataFrame, nodes: DataFrame, source_elements: DataFrame, source_documents: DataFrame, context: DataFrame, page_context_id: Column,
    places: DataFrame | None = None
) -> DataFrame:
    """`runtime_instances` of what `bind_elements` makes of `nodes`, for the rows of `elements` (page_id, node_ix, …).

    Records are counted where they are, on the few known nodes; what the rows below inherit is made there too, once for each facts of the page, and
    handed down by the last join, so no shuffle carries a record for every row.  `places`: page_id, node_ix of `elements`, where they are at hand.
    """
    known = _Catalogue(nodes, source_elements, source_documents, context)
    groups, numbered = _instance_counts(written(known.direct(elements if places is None else places)))
    hits = written(known.hits.withColumn("_key", _record_key("_found")).join(groups, ["page_id", "_key"], "left").drop("_key"))
    handed = join_page_facts(hits.withColumnsRenamed({"_found": "_above", "_data_id": "_above_id"}), known.pages, nodes).select(
        "page_id", F.col("node_ix").alias("_up"), "_copy", _inherited_binding().alias("_inherited"), F.col("_n").alias("_above_n"))
    marked = nodes.select("page_id", "node_ix", "parent_ix", markers.class_marker().alias("_class_marker"))
    placed = known.placed(marked, hits.select("page_id", "node_ix", "_found", "_n")).drop("parent_ix")
    rows = elements.join(placed, ["page_id", "node_ix"]).join(numbered, ["page_id", "node_ix"], "left")
    own = F.when(F.col("_found").isNotNull(), _direct_binding()).when(F.col("_inherited").isNotNull(), F.col("_inherited")).otherwise(_fallback())
    rows = rows.join(handed, ["page_id", "_up", "_copy"], "left").withColumns({
        "binding": own, "_n": F.when(F.col("_found").isNotNull(), F.col("_n")).otherwise(F.col("_above_n"))})
    return rows.withColumn("instance", _instance(_bound_directly(), F.col("binding.source_element_key"), page_context_id)).select(
        *elements.columns, "binding", "instance")


def aggregated_state() -> Column:
    """Ambiguity wins; exact only when all are."""
    state = F.col("binding.binding_state")
    return (
        F.when(F.bool_or(state == "AMBIGUOUS"), "AMBIGUOUS").when(F.bool_and(state == "EXACT"), "EXACT")
        .when(F.bool_or(state.isin("EXACT", "PROBABLE")), "PROBABLE").otherwise("UNMATCHED")
    )


def aggregate_binding_state(elements: DataFrame, keys: list[str]) -> DataFrame:
    return elements.groupBy(*keys).agg(aggregated_state().alias("binding_state"), F.count("*").alias("n"))


def strongest_state() -> Column:
    """The other rule: the strongest single state."""
    state = F.col("binding.binding_state")
    rank = F.max(F.when(state == "EXACT", 3).when(state == "PROBABLE", 2).when(state == "AMBIGUOUS", 1).otherwise(0))
    return F.when(rank == 3, "EXACT").when(rank == 2, "PROBABLE").when(rank == 1, "AMBIGUOUS").otherwise("UNMATCHED")


def session_binding_state(elements: DataFrame, keys: list[str]) -> DataFrame:
    return elements.groupBy(*keys).agg(strongest_state().alias("binding_state"))


def evidence_binding_state(evidence: DataFrame) -> DataFrame:
    """State from origin, document and id overlap; a conflict makes it ambiguous, confirmation changes nothing."""
    origin, document, overlap = F.col("origin_matches"), F.col("document_matches"), F.col("ids_overlap") > 0
    state = (
        F.when(F.col("conflicting"), "AMBIGUOUS").when(origin & document & overlap, "EXACT")
        .when(origin & (document | overlap), "PROBABLE").otherwise("UNMATCHED")
    )
    return evidence.withColumn("binding_state", state)


def document_scope(elements: DataFrame, source_documents: DataFrame, context: DataFrame) -> DataFrame:
    """Observed and selected catalogue documents per page."""
    observed = elements.filter(F.col("binding.source_document_id").isNotNull()).select(
        "page_id", F.col("binding.source_document_id").alias("document_id")).distinct().withColumn("observed", F.lit(True))
    selected = context.filter("selected_document_id IS NOT NULL").select(
        "page_id", F.col("selected_document_id").alias("document_id"), F.lit(False).alias("observed"))
    union = observed.unionByName(selected).groupBy("page_id", "document_id").agg(F.bool_or("observed").alias("observed"))
    listed = context.select("page_id", "context_id").join(source_documents.select("context_id", "document_id"), "context_id")
    return union.join(listed, ["page_id", "document_id"])


def source_cardinality(source_elements: DataFrame, source_documents: DataFrame, elements: DataFrame, context: DataFrame) -> DataFrame:
    """How often each catalogue record in scope was rendered.  The nodes stay rows (`candidate_nodes`)."""
    counts = _direct(elements).groupBy(
        "page_id", F.col("binding.source_document_id").alias("document_id"), F.col("binding.source_element_key").alias("source_element_key")
    ).agg(F.count("*").alias("n"), F.min("node_id").alias("first_node_id"), F.max("node_id").alias("last_node_id"))
    scoped = document_scope(elements, source_documents, context).join(
        source_elements.select("context_id", "document_id", "source_element_key"), ["context_id", "document_id"])
    out = scoped.join(counts, ["page_id", "document_id", "source_element_key"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select(
        "page_id", "document_id", "source_element_key", F.col("n").alias("runtime_candidate_count"),
        F.when(F.col("n") == 0, "ZERO").when(F.col("n") == 1, "ONE").otherwise("ONE_TO_MANY").alias("cardinality_state"),
        "first_node_id", "last_node_id",
        F.when(F.col("n") > 0, F.array().cast("array<string>")).when(F.col("observed"), F.array(F.lit("RUNTIME_CANDIDATE_NOT_OBSERVED")))
        .otherwise(F.array(F.lit("SOURCE_DOCUMENT_NOT_PRESENT"), F.lit("RUNTIME_CANDIDATE_NOT_OBSERVED"))).alias("absence_reason_codes"))


def candidate_nodes(elements: DataFrame) -> DataFrame:
    """The nodes behind `source_cardinality`, one row each."""
    return _direct(elements).select("page_id", F.col("binding.source_document_id").alias("document_id"),
                                    F.col("binding.source_element_key").alias("source_element_key"), "node_id")


def cardinality_summary(cardinality: DataFrame, elements: DataFrame) -> DataFrame:
    per_page = cardinality.groupBy("page_id").agg(
        F.count("*").alias("source_elements_imported"),
        *[F.count_if(F.col("cardinality_state") == s).alias(n) for s, n in (("ZERO", "n_zero"), ("ONE", "n_one"), ("ONE_TO_MANY", "n_many"))])
    ambiguous = elements.groupBy("page_id").agg(F.bool_or(F.col("binding.binding_state") == "AMBIGUOUS").alias("_ambiguous"))
    out = ambiguous.join(unbound_nodes(elements), "page_id").join(per_page, "page_id", "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("source_elements_imported", "n_zero", "n_one", "n_many")}
    state = F.when(F.col("source_elements_imported").isNull(), "INSUFFICIENT").when(F.col("_ambiguous"), "PARTIAL").otherwise("AVAILABLE")
    return out.withColumn("availability", state).withColumns(zero).withColumnRenamed("n", "n_without_source").drop("_ambiguous")


def document_instances(elements: DataFrame, nodes: DataFrame, source_documents: DataFrame, context: DataFrame) -> DataFrame:
    """Disconnected roots of each catalogue document on a page, with their members.

    The members of a root are the bound elements of its document within its interval: the running tally of the document at the root's end, less
    that in front of the root.
    """
    bound = elements.filter(F.col("binding.source_document_id").isNotNull()).select(
        "page_id", "node_ix", "node_id", "parent_ix", "parent_node_ix", F.col("binding.source_document_id").alias("document_id"),
        F.col("binding.binding_state").alias("state"))
    above = bound.select("page_id", F.col("node_ix").alias("parent_node_ix"), "document_id", F.lit(True).alias("_same"))
    roots = bound.join(above, ["page_id", "parent_node_ix", "document_id"], "left").filter("_same IS NULL")
    roots = ordinal(roots.select("page_id", "document_id", "node_ix", "node_id"), ["page_id", "document_id"], ["node_ix"], node_bucket(), "instance_index")
    names = ["n", *[f"n_{s}" for s in fixed.BINDING_STATES]]
    counted = {"n": F.lit(1), **{f"n_{s}": (F.col("state") == s).cast("int") for s in fixed.BINDING_STATES}}
    tallies = bound.select("page_id", "document_id", F.col("node_ix").alias("_at"), F.lit(1).alias("_turn"), F.lit(None).cast("int").alias("_root"),
                           *[c.alias(n) for n, c in counted.items()])
    ends = nodes.select("page_id", "node_ix", "subtree_end").join(roots.select("page_id", "node_ix", "document_id"), ["page_id", "node_ix"])
    turns = F.array(*[F.struct(F.col(at).alias("_at"), F.lit(turn).alias("_turn")) for at, turn in (("node_ix", 0), ("subtree_end", 2))])
    asked = ends.withColumn("_ask", F.explode(turns)).select(
        "page_id", "document_id", "_ask._at", "_ask._turn", F.col("node_ix").alias("_root"), *[F.lit(0).alias(n) for n in names])
    running = running_totals(tallies.unionByName(asked), ["page_id", "document_id"], ["_at", "_turn"], node_bucket("_at"), {f"_{n}": F.col(n) for n in names})
    members = running.filter("_turn <> 1").groupBy("page_id", F.col("_root").alias("node_ix"), "document_id").agg(
        *[(F.max(f"_{n}") - F.min(f"_{n}")).alias(n) for n in names])
    out = roots.join(members, ["page_id", "node_ix", "document_id"])
    state = (
        F.when(F.col("n_AMBIGUOUS") > 0, "AMBIGUOUS").when(F.col("n_EXACT") == F.col("n"), "EXACT")
        .when(F.col("n_EXACT") + F.col("n_PROBABLE") > 0, "PROBABLE").otherwise("UNMATCHED")
    )
    types = context.select("page_id", "context_id").join(source_documents.select("context_id", "document_id", "document_type"), "context_id")
    name = F.concat_ws(":", F.lit("document-instance"), F.col("page_id").cast("string"), "document_id", "node_id", F.col("instance_index").cast("string"))
    return out.join(types.drop("context_id"), ["page_id", "document_id"]).select(
        "page_id", F.concat(F.lit("document-instance-"), F.substring(F.sha2(name, 256), 1, 16)).alias("document_instance_id"),
        "document_id", "document_type", F.col("node_id").alias("root_node_id"), F.col("n").alias("bound_runtime_node_count"),
        "instance_index", state.alias("binding_state"))


def documents_present(elements: DataFrame, source_documents: DataFrame, context: DataFrame) -> DataFrame:
    seen = elements.filter(F.col("binding.source_document_id").isNotNull()).groupBy(
        "page_id", F.col("binding.source_document_id").alias("document_id")).agg(
        F.array_sort(F.collect_set("binding.binding_state")).alias("binding_states"), F.count("*").alias("bound_runtime_node_count"))
    scope = document_scope(elements, source_documents, context)
    facts = source_documents.select("context_id", "document_id", "document_type", "document_fingerprint")
    out = scope.join(seen, ["page_id", "document_id"], "left").join(facts, ["context_id", "document_id"])
    return out.select("page_id", "document_id", "document_type", "document_fingerprint",
                      F.coalesce("binding_states", F.array().cast("array<string>")).alias("binding_states"),
                      F.coalesce("bound_runtime_node_count", F.lit(0)).alias("bound_runtime_node_count"))


def region_bindings(regions: DataFrame, elements: DataFrame) -> DataFrame:
    facts = elements.select("page_id", "node_ix", F.col("binding.binding_state").alias("source_binding_state"),
                            F.col("binding.source_document_id").alias("source_document_id"),
                            F.col("binding.source_section_key").alias("source_section_key"),
                            F.substring("binding.source_editor_label", 1, fixed.MAX_LABEL_LENGTH).alias("_editor"))
    out = regions.join(facts, ["page_id", "node_ix"])
    return out.withColumns({
        "label": F.coalesce("_editor", "label"),
        "label_source": F.when(F.col("_editor").isNotNull(), "ELEMENTOR_EDITOR_LABEL").otherwise(F.col("label_source")),
    }).drop("_editor")


def relationship_issues(elements: DataFrame, references: list[str]) -> DataFrame:
    """Node references that point at rows that were not emitted."""
    named = F.explode(F.filter(F.array(*[F.struct(F.lit(c).alias("relation"), F.col(c).alias("ref")) for c in references]),
                               lambda r: r["ref"].isNotNull()))
    stacked = elements.select("page_id", "node_id", named.alias("r")).select("page_id", "node_id", "r.relation", "r.ref")
    known = elements.select("page_id", F.col("node_id").alias("ref"))
    return stacked.join(known, ["page_id", "ref"], "left_anti")


def exact_binding_issues(elements: DataFrame) -> DataFrame:
    b = F.col("binding")
    incomplete = b["source_element_key"].isNull() | b["source_record_sha256"].isNull() | ~F.coalesce(
        b["unique_in_runtime"], F.lit(False)) | ~F.coalesce(b["unique_in_source"], F.lit(False))
    return elements.filter((b["binding_state"] == "EXACT") & incomplete).select(
        "page_id", "node_id", F.lit("EXACT_BINDING_WITHOUT_EVIDENCE").alias("issue"))


def structure_summary(elements: DataFrame, regions: DataFrame, instances: DataFrame) -> DataFrame:
    """Thirteen counts per page.  `elements` carries `binding`, `instance` and `widget`."""
    b, state = F.col("binding"), F.col("binding.binding_state")
    counted = elements.groupBy("page_id").agg(
        F.countDistinct(b["source_document_id"]).alias("source_document_count"),
        F.countDistinct(b["source_section_key"]).alias("source_section_count"),
        F.count_if(b["source_widget_type"].isNotNull()).alias("source_widget_count"),
        F.count_if(F.size("widget") > 0).alias("runtime_widget_marker_count"),
        *[F.count_if(state == s).alias(n) for s, n in zip(fixed.BINDING_STATES, (
            "exact_binding_count", "probable_binding_count", "ambiguous_binding_count", "unmatched_runtime_node_count"), strict=True)],
        F.countDistinct(F.when(F.col("instance.instance_state") == "REPEATED_TEMPLATE", F.col("instance.instance_group_id"))).alias(
            "repeated_runtime_instance_group_count"))
    kinds = regions.groupBy("page_id").agg(
        F.count("*").alias("runtime_region_count"),
        F.count_if(F.col("region_kind").isin("HTML_SECTION", "ELEMENTOR_SECTION")).alias("runtime_section_region_count"),
        F.count_if(F.col("region_kind").isin("ELEMENTOR_CONTAINER", "ATOMIC_CONTAINER")).alias("runtime_container_region_count"))
    roots = instances.groupBy("page_id").agg(F.count("*").alias("document_instance_count"))
    out = counted.join(kinds, "page_id", "left").join(roots, "page_id", "left")
    return out.fillna(0)


def structure_digest(elements: DataFrame, published: int = fixed.MAX_EMITTED_ELEMENTS) -> DataFrame:
    """Digest of the ordered structure of an emitted page, over all its elements.

    `published` elements in order make a part, and only a part is gathered.  The digest of a page of one part is the published one;
    beyond, where none is published, it is the digest of the digests of its parts, in order, as a list of texts.
    """
    item = F.struct("document_order", "node_id", "reference_sha256", "parent_node_id", F.col("binding.source_element_key").alias("key"))
    parts = elements.groupBy("page_id", F.floor(F.col("document_order") / published).alias("_part")).agg(
        F.count("*").alias("_n"), F.array_sort(F.collect_list(item)).alias("_items"))
    text = F.to_json(F.transform("_items", lambda i: F.struct(
        i["node_id"].alias("node_id"), i["parent_node_id"].alias("parent_node_id"), i["reference_sha256"].alias("reference_sha256"),
        i["key"].alias("source_element_key"))), {"ignoreNullFields": "false"})
    pages = parts.select("page_id", "_part", "_n", digest(text).alias("_digest")).groupBy("page_id").agg(
        F.sum("_n").alias("n_elements"), F.array_sort(F.collect_list(F.struct("_part", "_digest"))).alias("_parts"))
    listed = F.transform("_parts", lambda p: p["_digest"])
    whole = F.when(F.size(listed) == 1, listed[0]).otherwise(digest(F.to_json(listed)))
    return pages.select("page_id", "n_elements", whole.alias("structure_sha256"), (F.col("n_elements") > published).alias("over_published_limit"))


def page_context(context: DataFrame) -> DataFrame:
    return context.withColumn("reference_digest", digest(canonical_struct(
        {c: F.col(c) for c in ("context_id", "selected_document_id", "confirmation_state")})))
