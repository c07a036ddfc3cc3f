"""Tree-wide operators: ordinals, identities, structural references, bounded selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagefacts import fixed
from pagefacts.functions import geometry, markers
from pagefacts.functions.digests import node_id
from pagefacts.functions.redaction import stable_id
from pagefacts.operators.intervals import enclosed_owners, joined_paths
from pagefacts.operators.ranking import node_bucket, ordinal, running_total, running_totals
from pagefacts.session import checkpointed


def _keyed_by_parent(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("_parent", F.coalesce("parent_ix", F.lit(-1)))


def nth_of_type(nodes: DataFrame) -> DataFrame:
    out = ordinal(_keyed_by_parent(nodes), ["page_id", "_parent", "tag"], ["node_ix"], node_bucket(), "_nth")
    return out.withColumn("nth_of_type", F.col("_nth") + 1).drop("_parent", "_nth")


def ordinals(nodes: DataFrame) -> DataFrame:
    """Sibling index, nth-of-type and sibling count."""
    out = running_total(_keyed_by_parent(nodes), ["page_id", "_parent"], ["node_ix"], node_bucket(), F.lit(1), "sibling_index", "sibling_count")
    return nth_of_type(out.withColumns({c: F.col(c).cast("int") for c in ("sibling_index", "sibling_count")}).drop("_parent"))


def emission_ids(nodes: DataFrame) -> DataFrame:
    """Contiguous document order and node ids over the rows that are left."""
    out = ordinal(nodes, ["page_id"], ["node_ix"], node_bucket(), "document_order")
    return out.withColumn("node_id", node_id(F.col("document_order")))


def value_counts(nodes: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """How often each stable value of the named attributes occurs in a page."""
    entries = F.array(*[F.struct(F.lit(name).alias("attr"), stable_id(markers.attr(name)).alias("value")) for name in names])
    return nodes.select("page_id", F.explode(F.filter(entries, lambda e: e["value"].isNotNull())).alias("e")).groupBy(
        "page_id", "e.attr", "e.value").agg(F.count("*").alias("n"))


def marker_index(nodes: DataFrame) -> DataFrame:
    """How often each stable attribute value occurs in a page; `complete`: the page is within the published index limit."""
    counted = value_counts(nodes, tuple(fixed.INDEXED_ATTRIBUTES))
    sizes = nodes.groupBy("page_id").agg((F.count("*") <= fixed.IDENTITY_INDEX_LIMIT).alias("complete"))
    return counted.join(sizes, "page_id")


def _anchors(nodes: DataFrame) -> DataFrame:
    """Nodes with the id or test id that is unique in their page.

    A value that occurs once names its node, so unique values are grouped back to nodes and joined on the
    node key; nothing is joined on attribute values.
    """
    entries = F.array(*[F.struct(F.lit(n).alias("attr"), stable_id(markers.attr(n)).alias("value")) for n in ("id", "data-testid")])
    unique = (
        nodes.select("page_id", "node_ix", F.explode(F.filter(entries, lambda e: e["value"].isNotNull())).alias("e"))
        .groupBy("page_id", "e.attr", "e.value").agg(F.count("*").alias("_n"), F.min("node_ix").alias("node_ix")).filter("_n = 1")
    )
    named = unique.groupBy("page_id", "node_ix").agg(
        F.max(F.when(F.col("attr") == "id", F.col("value"))).alias("_id"), F.max(F.when(F.col("attr") == "data-testid", F.col("value"))).alias("_test"))
    tag = F.col("tag")
    anchor = F.when(F.col("_id").isNotNull(), F.concat(tag, F.lit("#"), markers.css_identifier(F.col("_id")))).when(
        F.col("_test").isNotNull(), F.concat(tag, F.lit('[data-testid="'), markers.css_attribute(F.col("_test")), F.lit('"]')))
    source = F.when(F.col("_id").isNotNull(), "HTML_ID").when(F.col("_test").isNotNull(), "DATA_TEST_ID")
    return nodes.join(named, ["page_id", "node_ix"], "left").withColumns({"anchor": anchor, "anchor_source": source}).drop("_id", "_test")


def structural_refs(nodes: DataFrame) -> DataFrame:
    """`tag:nth-of-type(n)` steps from the nearest unique anchor down to the node."""
    own = F.coalesce("anchor", F.concat("tag", F.lit(":nth-of-type("), F.col("nth_of_type").cast("string"), F.lit(")")))
    # Steps are worked out once: they are read for the references of parents and again for the nodes themselves.
    steps = checkpointed(nth_of_type(_anchors(nodes)).select(
        "page_id", "node_ix", "parent_ix", "depth", "child_count", "nth_of_type", "anchor", "anchor_source", own.alias("_step")))
    # One reference per parent; siblings share it.
    owners = steps.filter("child_count > 0").select("page_id", "node_ix", "parent_ix", "depth", F.col("_step").alias("step"), F.col("anchor").isNotNull().alias("last"))
    prefixes = joined_paths(owners, ">").select("page_id", F.col("node_ix").alias("parent_ix"), F.col("path").alias("_prefix"))
    below = F.when(F.col("anchor").isNull(), F.col("_prefix"))
    named = steps.join(prefixes, ["page_id", "parent_ix"], "left").select(
        "page_id", "node_ix", "nth_of_type", "anchor", "anchor_source", F.concat_ws(">", below, "_step").alias("structural_ref"))
    return nodes.join(named, ["page_id", "node_ix"])


def identities(nodes: DataFrame) -> DataFrame:
    """Reference, source, status, confidence and collisions of every node."""
    out = structural_refs(nodes).withColumns({
        "reference": F.coalesce("anchor", "structural_ref"),
        "identity_source": F.coalesce("anchor_source", F.lit("STRUCTURAL_PATH")),
        "identity_strategy": F.when(F.col("anchor_source") == "HTML_ID", "STABLE_HTML_ID")
        .when(F.col("anchor_source") == "DATA_TEST_ID", "STABLE_DATA_TEST_ID")
        .when(F.col("parent_ix").isNull(), "DOCUMENT_ROOT").otherwise("STRUCTURAL_PATH"),
    })
    # A reference names one node of a sound tree, so these groups are single rows and a window over them is even.
    out = out.withColumn("occurrences", F.count("*").over(Window.partitionBy("page_id", F.md5("reference"))))
    unique = F.col("occurrences") == 1
    strong = F.when(F.col("anchor_source").isNotNull(), "STRONG").otherwise("PROBABLE")
    return out.withColumns({
        "identity_status": F.when(unique, "UNIQUE").otherwise("AMBIGUOUS"),
        "identity_confidence": F.when(unique, strong).otherwise("WEAK"),
        "unique_in_document": unique,
        "collision_count": F.col("occurrences") - 1,
    })


def scan_budget(max_elements: int) -> int:
    return min(fixed.MAX_SCAN_BUDGET, max(fixed.MIN_SCAN_BUDGET, max_elements * 20))


def reachable(measured: DataFrame, max_depth: int, include_hidden: bool) -> DataFrame:
    """Nodes a traversal can reach: no skipped tag, pruned node or too deep level above them."""
    prunes = F.lit(False) if include_hidden else geometry.hides_subtree() & (F.col("child_count") > 0)
    flagged = measured.withColumns({
        "skip_tag": F.col("tag").isin(*fixed.SKIPPED_TAGS),
        "pruned": prunes & ~F.col("tag").isin(*fixed.SKIPPED_TAGS),
    })
    blockers = flagged.select("page_id", "node_ix", (F.col("skip_tag") | F.col("pruned")).alias("blocks"))
    below = enclosed_owners(flagged, blockers, "blocks").withColumnRenamed("owner_ix", "parent_ix")
    return flagged.filter(F.col("depth") <= max_depth).join(below, ["page_id", "parent_ix"], "left_anti")


def select_nodes(measured: DataFrame, max_elements: int = 750, max_depth: int = 24, include_hidden: bool = False) -> DataFrame:
    """Pre-order selection within scan and element budgets.

    Returns the reachable nodes with `scanned`, `visited` and `selected` flags: the cut is the feature, and
    the flags keep what was left out countable.
    """
    reach = reachable(measured, max_depth, include_hidden)
    # Hidden ancestors prune their subtree unless hidden nodes are wanted, so only the node itself matters here.
    wanted = ~F.col("skip_tag") & (F.lit(True) if include_hidden else ~geometry.hides_element())
    # Scanned nodes are a prefix of the order, so counting wanted nodes over all reachable ones numbers the
    # wanted scanned ones too: both counts come from one pass.
    ranked = running_totals(reach.withColumn("_wanted", wanted), ["page_id"], ["node_ix"], node_bucket(),
                            {"scan_rank": F.lit(1), "_pick": F.col("_wanted").cast("int")})
    out = ranked.withColumn("scan_rank", F.col("scan_rank").cast("int")).withColumn("scanned", F.col("scan_rank") < scan_budget(max_elements))
    return out.withColumns({
        "visited": F.col("scanned") & ~F.col("skip_tag"),
        "selected": F.col("scanned") & F.col("_wanted") & (F.col("_pick") < max_elements),
    }).drop("_wanted", "_pick")


def selection_summary(selected: DataFrame, max_elements: int = 750, max_depth: int = 24) -> DataFrame:
    """Budgets used, truncation and hidden-subtree counts per page, from `select_nodes` output."""
    cut = F.col("scanned") & (F.col("depth") >= max_depth) & (F.col("child_count") > 0) & ~F.col("skip_tag") & ~F.col("pruned")
    counts = selected.groupBy("page_id").agg(
        F.count_if("scanned").alias("scanned_nodes"),
        F.count_if("visited").alias("visited_elements"),
        F.count_if("selected").alias("selected_elements"),
        F.max(F.when(F.col("scanned"), F.col("depth"))).alias("maximum_depth"),
        F.count_if(cut).alias("_cut"),
        F.min(F.when(cut, F.col("node_ix"))).alias("_first_cut"),
        F.min(F.when(~F.col("scanned"), F.col("node_ix"))).alias("_next"),
        F.count_if(F.col("scanned") & F.col("pruned")).alias("skipped_hidden_subtrees"),
        F.coalesce(F.sum(F.when(F.col("scanned") & F.col("pruned"), F.col("child_count"))), F.lit(0)).alias("skipped_hidden_children"),
        F.max(F.when(F.col("visited"), F.col("node_ix"))).alias("_last_visited"),
        F.max(F.when(F.col("selected"), F.col("node_ix"))).alias("_last_selected"),
    )
    # Nodes still on the stack: not scanned, while their parent was.
    scanned = selected.filter("scanned").select("page_id", F.col("node_ix").alias("parent_ix"))
    waiting = selected.filter("NOT scanned").join(scanned, ["page_id", "parent_ix"], "left_semi").groupBy("page_id").agg(
        F.count("*").alias("_waiting"))
    out = counts.join(waiting, "page_id", "left").withColumn("_waiting", F.coalesce("_waiting", F.lit(0)))
    truncated = F.col("_cut") + F.col("_waiting")
    full = (F.col("selected_elements") >= max_elements) & (F.col("_last_visited") > F.col("_last_selected"))
    return out.withColumns({
        "scan_budget": F.lit(scan_budget(max_elements)), "element_budget": F.lit(max_elements),
        "truncated_branches": truncated,
        "first_truncated_ix": F.coalesce("_first_cut", F.when(F.col("_waiting") > 0, F.col("_next"))),
        "scan_limited": F.col("_waiting") > 0,
        "depth_limited": (truncated > 0) & (F.col("maximum_depth") >= max_depth),
        "element_limited": F.coalesce(full, F.lit(False)),
    }).drop("_cut", "_first_cut", "_next", "_waiting", "_last_visited", "_last_selected")


def selection_diagnostics(summary: DataFrame) -> DataFrame:
    """One row per budget that was reached."""
    rows = F.array_compact(F.array(
        F.when(F.col("scan_limited"), F.struct(F.lit("SCAN_LIMIT_REACHED").alias("code"), F.col("scan_budget").alias("limit"))),
        F.when(F.col("depth_limited"), F.struct(F.lit("DEPTH_LIMIT_REACHED").alias("code"), F.col("maximum_depth").alias("limit"))),
        F.when(F.col("element_limited"), F.struct(F.lit("ELEMENT_LIMIT_REACHED").alias("code"), F.col("element_budget").alias("limit"))),
    ))
    return summary.select("page_id", F.explode(rows).alias("d"), "truncated_branches").select(
        "page_id", "d.code", F.lit("WARNING").alias("severity"), "d.limit", "truncated_branches")


def prune_hidden(measured: DataFrame) -> DataFrame:
    """Nodes outside irreversibly hidden subtrees (the hidden node itself stays)."""
    return reachable(measured, 2_147_483_647, False).drop("skip_tag", "pruned")


def traversal_metrics(selected: DataFrame) -> DataFrame:
    """Discovered, emitted and skipped counts per page, with the invariant checked."""
    kinds = {
        "builder": markers.marker_matched(), "interactive": markers.interactive(),
        "fixed": F.coalesce(geometry.style("position") == "fixed", F.lit(False)),
        "sticky": F.coalesce(geometry.style("position") == "sticky", F.lit(False)),
    }
    emitted = F.col("selected") & geometry.rect_finite(F.col("rect"))
    aggregates: list[Column] = []
    for name, hit in kinds.items():
        aggregates += [F.count_if(F.col("visited") & hit).alias(f"discovered_{name}"), F.count_if(emitted & hit).alias(f"emitted_{name}")]
    out = selected.groupBy("page_id").agg(*aggregates)
    return out.withColumns({f"skipped_{n}": F.col(f"discovered_{n}") - F.col(f"emitted_{n}") for n in kinds}).withColumn(
        "issue", F.when(F.col("emitted_builder") > F.col("discovered_builder"), "ELEMENTOR_METRIC_INVARIANT_VIOLATION"))
