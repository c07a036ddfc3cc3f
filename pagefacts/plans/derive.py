"""Test shapes derived from the given tables: the tree forest, the catalogue, observations, packages."""

from __future__ import annotations

import io
import warnings
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagefacts import fixed
from pagefacts.functions import markers
from pagefacts.functions.digests import digest
from pagefacts.operators import ancestors, binding
from pagefacts.operators import nodes as node_ops
from pagefacts.operators import tree as tree_ops
from pagefacts.operators.ranking import node_bucket, ordinal, running_total, small_group_total
from pagefacts.plans import rules
from pagefacts.plans.stored import stored
from pagefacts.session import written
from pagefacts.sources.nodes import extract_nodes

_NODES_PER_BUCKET = 65_536
_ORDERS_PER_BUCKET = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sized_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("orderkey")).agg(F.count("*").alias("n_children"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("orderkey"), F.col("o_custkey").alias("custkey"))
    return orders.join(n_lines, "orderkey", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))


def _forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per nation: nation, market segment, customer, order, line.

    Pre-order numbers come from subtree sizes, top down, so no page is ever sorted as a whole.  Lines are shuffled and sorted once, by their order.
    """
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("page_id"))
    customer = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").cast("bigint").alias("page_id"), F.col("c_mktsegment").alias("seg"),
        F.col("c_custkey").alias("custkey"))
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("linenumber"),
        F.col("l_partkey").alias("partkey"), F.col("l_suppkey").alias("suppkey"),
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"))

    sized_orders = stored(spark, sf_dir, "sized_orders", _sized_orders).withColumn("size", F.col("n_children") + 1)
    of_customer = sized_orders.groupBy("custkey").agg(F.sum("size").alias("below"), F.count("*").alias("n_children"))
    sized_customers = customer.join(of_customer, "custkey", "left").withColumns(
        {"n_children": F.coalesce("n_children", F.lit(0)), "size": F.coalesce("below", F.lit(0)) + 1}).drop("below")
    segments = sized_customers.groupBy("page_id", "seg").agg(F.sum("size").alias("below"), F.count("*").alias("n_children"))
    before = Window.partitionBy("page_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    segments = segments.withColumn("size", F.col("below") + 1).withColumn(
        "seg_ix", 1 + F.coalesce(F.sum("size").over(before), F.lit(0)))
    n_segments = segments.groupBy("page_id").agg(F.count("*").alias("n_children"), (F.sum("size") + 1).alias("size"))

    placed_customers = running_total(
        sized_customers, ["page_id", "seg"], ["custkey"], F.floor(F.col("custkey") / _NODES_PER_BUCKET), F.col("size"), "_b")
    placed_customers = placed_customers.join(segments.select("page_id", "seg", "seg_ix"), ["page_id", "seg"]).withColumn(
        "cust_ix", F.col("seg_ix") + 1 + F.col("_b")).drop("_b")
    placed_orders = small_group_total(sized_orders, "custkey", ["orderkey"], F.floor(F.col("orderkey") / _ORDERS_PER_BUCKET), F.col("size"), "_b")
    placed_orders = placed_orders.join(placed_customers.drop("n_children", "size"), "custkey").withColumn(
        "order_ix", F.col("cust_ix") + 1 + F.col("_b")).drop("_b")
    line_bucket = F.col("linenumber") * 1_000_000 + F.floor(F.col("partkey") / 1_000_000)
    placed_lines = small_group_total(lines, "orderkey", ["linenumber", "partkey", "suppkey", "price", "quantity"], line_bucket, F.lit(1), "_b")
    placed_lines = placed_lines.join(placed_orders.drop("n_children", "size"), "orderkey").withColumn(
        "line_ix", F.col("order_ix") + 1 + F.col("_b").cast("int"))

    level = lambda n, ix, parent: [
        "page_id", F.lit(n).alias("lvl"), F.col(ix).alias("node_ix"), parent.alias("parent_ix"), (F.col(ix) + F.col("size") - 1).alias("subtree_end")]
    children = F.col("n_children").alias("child_count")
    root = nation.join(n_segments, "page_id", "left").withColumns({"_ix": F.lit(0), "size": F.coalesce("size", F.lit(1))}).select(
        *level(0, "_ix", F.lit(None).cast("int")), F.coalesce("n_children", F.lit(0)).alias("child_count"))
    parts = [
        root,
        segments.select(*level(1, "seg_ix", F.lit(0)), children, "seg"),
        placed_customers.select(*level(2, "cust_ix", F.col("seg_ix")), children, "seg", "custkey"),
        placed_orders.select(*level(3, "order_ix", F.col("cust_ix")), children, "seg", "custkey", "orderkey"),
        placed_lines.withColumn("size", F.lit(1)).select(
            *level(4, "line_ix", F.col("order_ix")), F.lit(0).cast("bigint").alias("child_count"), "seg", "custkey", "orderkey", "linenumber", "partkey", "suppkey", "quantity"),
    ]
    nodes = parts[0]
    for part in parts[1:]:
        nodes = nodes.unionByName(part, allowMissingColumns=True)
    return nodes.withColumns({
        **{name: F.col(name).cast("int") for name in ("node_ix", "parent_ix", "subtree_end", "child_count")}, "depth": F.col("lvl"),
    })


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and keys of the forest's nodes.  What a node carries follows from them, so only these few numbers are written."""
    return stored(spark, sf_dir, "forest", _forest)


def _string_map(named: dict[str, str]) -> Column:
    """A map of the columns that are not null; only these become entries, as most are null."""
    return F.map_from_entries(F.array_compact(F.array(*[
        F.when(F.col(column).isNotNull(), F.struct(F.lit(key).alias("key"), F.col(column).alias("value"))) for key, column in named.items()])))


def measured_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forest in the shape of an extracted node table with its recorded boxes and styles; a query works out the columns that it reads."""
    rows = tree(spark, sf_dir).withColumns({name: F.expr(text) for name, text in rules.TREE_COLUMNS.items()})
    rect = F.struct(
        F.col("x"), F.col("y"), F.col("y").alias("top"), (F.col("x") + F.col("w")).alias("right"),
        (F.col("y") + F.col("h")).alias("bottom"), F.col("x").alias("left"), F.col("w").alias("width"), F.col("h").alias("height"))
    return rows.select(
        "page_id", "node_ix", "parent_ix", "depth", "tag", _string_map(rules.ATTRIBUTES).alias("attrs"),
        F.array_distinct(F.array_remove(F.split("class_text", " "), "")).alias("class_tokens"),
        "subtree_end", "child_count", rect.alias("rect"), F.col("w").alias("client_w"), F.col("h").alias("client_h"),
        (F.col("w") + F.col("extra_w")).alias("scroll_w"), (F.col("h") + F.col("extra_h")).alias("scroll_h"),
        _string_map(rules.STYLES).alias("styles"), "seg", "custkey", "orderkey", "linenumber", "partkey")


NODE_COLUMNS = ("page_id", "node_ix", "parent_ix", "depth", "tag", "attrs", "class_tokens", "subtree_end", "child_count")


def tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured_tree(spark, sf_dir).select(*NODE_COLUMNS)


def written_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a written table, for operators that read attributes more than once."""
    return stored(spark, sf_dir, "tree_nodes", tree_nodes)


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = extract_nodes(table(spark, sf_dir, "pages"))
    keyed = ordinal(nodes, ["page_id", "tag"], ["node_ix"], node_bucket(), "nth")
    number = F.concat("tag", (F.col("nth") + 1).cast("string"))
    extra = F.map_filter(
        F.create_map(F.lit("data-id"), F.when(F.col("tag").isin("p", "li", "article"), number),
                     F.lit("data-elementor-id"), F.when(F.col("tag") == "body", F.concat(F.lit("page-"), F.col("page_id").cast("string")))),
        lambda _, v: v.isNotNull())
    marks = F.when(F.col("tag").isin("article", "div"), F.concat("class_tokens", F.array(
        F.lit("elementor-element"), F.lit("elementor-widget-text"), F.lit("e-con")))).otherwise(F.col("class_tokens"))
    return keyed.withColumns({"attrs": F.map_concat("attrs", extra), "class_tokens": marks}).drop("nth")


def page_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the given pages with the mapped markers."""
    return stored(spark, sf_dir, "page_nodes", _mapped)


# --- catalogue -----------------------------------------------------------------------------------


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One context per page but the last; one of them has no documents, one no selection."""
    pages = table(spark, sf_dir, "nation").filter("n_nationkey < 24").select(F.col("n_nationkey").cast("bigint").alias("page_id"))
    return pages.withColumns({name: F.expr(text) for name, text in rules.CONTEXT_COLUMNS.items()})


def source_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = F.array(*[F.struct(i.alias("document_id"), F.lit(t).alias("document_type")) for i, t in (
        (F.concat(F.lit("page-"), F.col("page_id").cast("string")), "page"), (F.lit("header"), "header"),
        (F.lit("loop"), "loop-item"), (F.lit("footer"), "footer"))])
    listed = contexts(spark, sf_dir).filter("page_id < 23").select("context_id", F.explode(documents).alias("d"))
    return listed.select("context_id", "d.document_id", "d.document_type",
                         digest(F.concat_ws(":", F.lit("doc"), "context_id", "d.document_id")).alias("document_fingerprint"))


def _catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tree(spark, sf_dir).filter(rules.CATALOGUE_ROWS)
    listed = rows.select("lvl", "page_id", *[F.expr(text).alias(name) for name, text in rules.CATALOGUE_COLUMNS.items()], F.col("node_ix").alias("document_order"))
    planted = contexts(spark, sf_dir).filter("page_id < 23").select("page_id", "context_id", F.explode(F.array(*[
        F.struct(i.alias("element_id"), d.alias("document_id"), F.lit(k).alias("element_kind")) for i, d, k in (
            (F.concat(F.lit("zero-"), F.col("page_id").cast("string")), F.concat(F.lit("page-"), F.col("page_id").cast("string")), "Container"),
            (F.lit(None).cast("string"), F.lit("header"), "widget"))])).alias("e")).select(
        "page_id", "context_id", "e.*", F.concat(F.lit("extra:"), F.col("page_id").cast("string"), F.lit(":"), F.col("e.element_kind")).alias("record_text"),
        F.lit("").alias("ancestor_text"), F.lit("classic").alias("architecture_kind"), F.lit(0).alias("document_order"))
    every = listed.unionByName(planted, allowMissingColumns=True)
    counts = every.filter("element_id IS NOT NULL").groupBy("context_id", "document_id", "element_id").agg(F.count("*").cast("int").alias("_n"))
    joined = every.join(counts, ["context_id", "document_id", "element_id"], "left")
    return joined.select(
        "context_id", "document_id", digest(F.concat(F.lit("key:"), "record_text")).alias("source_element_key"),
        digest(F.concat(F.lit("rec:"), "record_text")).alias("source_record_sha256"), "element_id",
        F.coalesce("_n", F.lit(0)).alias("id_occurrence_count"),
        F.when(F.col("element_id").isNull(), "MISSING").when(F.col("_n") > 1, "DUPLICATE").otherwise("UNIQUE").alias("id_uniqueness"),
        "parent_element_id", F.filter(F.split("ancestor_text", ","), lambda a: a != "").alias("ancestor_element_ids"),
        F.concat(F.lit("/"), "record_text").alias("source_path"), "document_order", "element_kind", "el_type", "widget_type",
        "architecture_kind", "editor_label")


def source_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "source_elements", _catalogue)


def _bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emitted elements (finite box, no script) with binding, ids, emitted parent and instance."""
    nodes = written_nodes(spark, sf_dir)
    finite = node_ops.normalize_rects(measured_tree(spark, sf_dir)).filter("tag NOT IN ('script', 'noscript')").select(*NODE_COLUMNS)
    kept = tree_ops.emission_ids(finite)
    # Ids and parents are written, as they are read more than once; what else an element carries goes through the joins once.
    ids = written(kept.select("page_id", "node_ix", "node_id"))
    linked = written(ancestors.emitted_parents(nodes, ids).select("page_id", "node_ix", F.col("nearest_emitted").alias("parent_node_ix"), "parent_node_id"))
    out = kept.join(linked, ["page_id", "node_ix"])
    places = ids.select("page_id", "node_ix").join(linked.select("page_id", "node_ix"), ["page_id", "node_ix"])
    bound = binding.bound_instances(out, nodes, source_elements(spark, sf_dir), source_documents(spark, sf_dir), contexts(spark, sf_dir),
                                    digest(F.concat(F.lit("page-context-"), F.col("page_id").cast("string"))), places)
    return bound.withColumn("widget", markers.widget_markers())


def bound_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "bound_tree", _bound)


# --- observations --------------------------------------------------------------------------------


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"))


def _with(frame: DataFrame, columns: dict[str, str]) -> DataFrame:
    for name, text in columns.items():
        frame = frame.withColumn(name, F.expr(text))
    return frame


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full sessions (all events of a user) and guided ones (the first event of each profile)."""
    events = _events(spark, sf_dir)
    day = F.floor(F.unix_micros("ts") / 86_400_000_000)
    full = ordinal(events, ["user_id"], ["ts", "event_id"], day, "pure_index").withColumn("kind", F.lit("user"))
    planted = (
        F.when((F.col("user_id") % 17 == 0) & (F.col("pure_index") >= 3), F.col("pure_index") + 1)
        .when((F.col("user_id") % 19 == 0) & (F.col("pure_index") == 2), F.lit(1)).otherwise(F.col("pure_index"))
    )
    full = full.withColumn("observation_index", planted)
    profile = F.expr(rules.OBSERVATION_COLUMNS["requested_profile"])
    first = events.groupBy("user_id", profile.alias("_profile")).agg(
        F.min(F.struct("ts", "event_id", "event_type", "value", "k")).alias("e")).select("user_id", "e.*")
    of_user = Window.partitionBy("user_id").orderBy("ts", "event_id")  # at most one row per profile
    guided = first.withColumns({"kind": F.lit("guided"), "pure_index": F.row_number().over(of_user) - 1})
    both = full.unionByName(guided.withColumn("observation_index", F.col("pure_index")))
    out = _with(both, rules.OBSERVATION_COLUMNS)
    return out.withColumns({
        "captured_at": F.col("ts"), "page_fingerprint": digest(F.col("fingerprint_text")),
        "reference_digest": digest(F.col("reference_text")),
        "reasons": F.filter(F.split("reason_text", ","), lambda r: r != ""),
    })


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "observations", _observations)


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = observations(spark, sf_dir).groupBy("kind", "user_id").agg(F.min("captured_at").alias("created_at"))
    empty = grouped.filter("kind = 'user' AND user_id % 10 = 2").withColumn("kind", F.lit("empty"))
    rows = _with(grouped.unionByName(empty), rules.SESSION_COLUMNS)
    return rows.withColumns({
        "name": F.concat(F.lit("Session "), "session_id"), "reference_digest": digest(F.col("reference_text")),
        "site_fingerprint": digest(F.col("site_text")), "imported_sha256": digest(F.col("context_id")),
        "export_root_sha256": digest(F.concat(F.lit("root-"), "context_id")),
        "selected_document_fingerprint": digest(F.concat(F.lit("fp-"), "selected_document_id")),
    })


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "sessions", _sessions)


def imported_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imported catalogues that sessions refer to, one row per document (nine of the ten ids exist)."""
    ids = observations(spark, sf_dir).select((F.col("user_id") % 10).alias("n")).distinct().filter("n <> 9")
    name = F.col("n").cast("string")
    context = F.concat(F.lit("ectx-"), name)
    return ids.select(
        context.alias("context_id"), digest(context).alias("imported_sha256"), digest(F.concat(F.lit("root-"), context)).alias("export_root_sha256"),
        digest(F.concat(F.lit("site-"), name)).alias("site_fingerprint"), F.concat(F.lit("d-"), name).alias("document_id"),
        digest(F.concat(F.lit("fp-d-"), name)).alias("document_fingerprint"))


def capture_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capture summaries: some are lost, some point at snapshots that do not exist."""
    rows = observations(spark, sf_dir)
    keep = rows.filter("event_id % 23 <> 0").select("session_id", "snapshot_id", "captured_at", "completeness")
    foreign = rows.filter("event_id % 29 = 0").select(
        "session_id", F.concat(F.lit("missing-"), F.col("event_id").cast("string")).alias("snapshot_id"), "captured_at", "completeness")
    twice = rows.filter("event_id % 101 = 5").select("session_id", "snapshot_id", "captured_at", "completeness")
    return keep.unionByName(foreign).unionByName(twice).withColumn("status", F.col("completeness"))


def screenshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).withColumn("n_bytes", (1000 + F.col("k") * 100).cast("bigint"))
    keep = rows.filter("k % 3 = 0 AND event_id % 5 <> 0").select("session_id", "snapshot_id", "n_bytes")
    twice = rows.filter("k % 3 = 0 AND event_id % 41 = 0").select("session_id", "snapshot_id", "n_bytes")
    foreign = rows.filter("event_id % 37 = 0").select(
        "session_id", F.concat(F.lit("foreign-"), F.col("event_id").cast("string")).alias("snapshot_id"), "n_bytes")
    return keep.unionByName(twice).unionByName(foreign)


def observed_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).select(
        "session_id", "snapshot_id", "event_id", "k", F.explode(F.sequence(F.lit(1), 1 + F.col("k") % 5)).alias("i"))
    return _with(rows, rules.ELEMENT_COLUMNS)


def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with(observations(spark, sf_dir).select("session_id", "snapshot_id", "event_id", "event_type", "k"), rules.DIAGNOSTIC_COLUMNS)
    context = {"limit": "c_limit", "page_url": "c_url", "auth_token": "c_token", "detail": "c_long", "Bad Key": "c_limit"}
    return rows.withColumn("context", _string_map(context))


def readiness_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir)
    nan = F.lit(float("nan"))
    return rows.select(
        F.col("session_id").alias("capture_id"), F.col("pure_index").alias("sample_no"), (F.col("pure_index") * 100.0).alias("elapsed_ms"),
        F.when(F.col("k") < 50, 1000.0).otherwise(1010.0).alias("doc_w"),
        F.when((F.col("k") == 97) & (F.col("user_id") % 3 == 0), nan).otherwise(2000.0).alias("doc_h"),
        F.lit(1440.0).alias("view_w"), F.lit(900.0).alias("view_h"),
        F.when(F.col("k") % 25 == 0, "interactive").otherwise("complete").alias("ready_state"),
        (F.col("k") % 20 != 1).alias("fonts_loaded"), F.when(F.col("k") % 15 == 2, 1).otherwise(0).alias("unresolved_images"))


# --- documents as chunks, packages and text ------------------------------------------------------

CHUNK_CHARACTERS = 2000


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return job_columns(table(spark, sf_dir, "documents"))


def job_columns(documents: DataFrame) -> DataFrame:
    """One job per document, which was to be sent in chunks."""
    text = F.col("text")
    status = F.element_at(F.array(*[F.lit(s) for s in ("PREPARED", "INJECTED", "RECEIVING", "ASSEMBLING", "COMPLETE", "FAILED")]), (F.col("doc_id") % 6 + 1).cast("int"))
    source = F.col("source") if "source" in documents.columns else F.lit(None).cast("string")
    return documents.select(
        F.concat(F.lit("job-"), F.col("doc_id").cast("string")).alias("job_id"), source.alias("session_id"), "doc_id",
        (F.floor(F.col("doc_id") / 3) % 400).alias("tab_id"), status.alias("status"),
        F.timestamp_add("SECOND", F.col("doc_id").cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("updated_at"),
        F.greatest(F.lit(1), F.ceil(F.length(text) / CHUNK_CHARACTERS)).cast("int").alias("expected_chunks"), F.lit(fixed.MAX_SNAPSHOT_BYTES).cast("bigint").alias("max_bytes"),
        F.when(F.col("doc_id") % 5 != 0, F.sha2(F.when(F.col("doc_id") % 97 == 3, F.concat(text, F.lit("!"))).otherwise(text), 256)).alias("full_sha256"))


def pieces(documents: DataFrame) -> DataFrame:
    last = F.greatest(F.lit(0), F.ceil(F.length("text") / CHUNK_CHARACTERS).cast("int") - 1)
    rows = documents.select("doc_id", "text", F.explode(F.sequence(F.lit(0), last)).alias("chunk_index"))
    return rows.withColumn("data", F.expr(f"substring(text, {CHUNK_CHARACTERS} * chunk_index + 1, {CHUNK_CHARACTERS})")).drop("text")


def chunk_columns(pieces: DataFrame, *extra: str) -> DataFrame:
    """Chunks with planted faults: lost, repeated, differing, wrongly hashed and unhashed ones."""
    n = F.col("doc_id") + F.col("chunk_index")
    copies = F.when(n % 41 == 0, F.array(F.lit(0), F.lit(1))).when(n % 43 == 0, F.array(F.lit(0), F.lit(2))).otherwise(F.array(F.lit(0)))
    rows = pieces.filter(n % 37 != 0).withColumn("copy", F.explode(copies))
    rows = rows.withColumn("data", F.when(F.col("copy") == 2, F.concat(F.lit("x"), "data")).otherwise(F.col("data")))
    hashed = F.when(n % 47 == 0, F.sha2(F.lit("wrong"), 256)).when(n % 53 == 0, "LEGACY_UNVERIFIED").otherwise(F.sha2("data", 256))
    return rows.select(F.concat(F.lit("job-"), F.col("doc_id").cast("string")).alias("job_id"), "doc_id", "chunk_index", "copy", "data", *extra, hashed.alias("sha256"),
                       (F.octet_length("data") + F.when(n % 59 == 0, 1).otherwise(0)).alias("byte_length"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_columns(pieces(table(spark, sf_dir, "documents").select("doc_id", "text")))


def packages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, manifest, checksums): documents by source with planted faults."""
    documents = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("package_id"), "text")
    path = F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    named = documents.select("package_id", path.alias("path"), "doc_id", F.encode("text", "UTF-8").alias("content"))
    heads = documents.select("package_id", (F.col("doc_id") % 20).alias("n")).distinct()
    controls = heads.select("package_id", F.explode(F.when(F.col("n") == 4, F.array(F.lit("checksums.sha256"))).otherwise(
        F.array(F.lit("checksums.sha256"), F.lit("package-manifest.json")))).alias("path"), F.encode(F.lit("{}"), "UTF-8").alias("content"))
    files = named.filter("doc_id % 67 <> 0").select("package_id", "path", "content").unionByName(controls)
    sized = named.select("package_id", "path", "doc_id", (F.octet_length("content") + F.when(F.col("doc_id") % 53 == 0, 1).otherwise(0)).cast("bigint").alias("bytes"),
                         digest(F.when(F.col("doc_id") % 83 == 0, F.encode(F.lit("wrong"), "UTF-8")).otherwise(F.col("content"))).alias("sha256"))
    none = heads.filter("n % 5 = 1").select("package_id", F.lit("docs/none.txt").alias("path"), F.lit(1).cast("bigint").alias("bytes"), digest(F.lit("none")).alias("sha256"))
    clean = sized.filter("doc_id % 31 <> 0").drop("doc_id")
    manifest = clean.unionByName(none).unionByName(sized.filter("doc_id % 71 = 5 AND doc_id % 31 <> 0").drop("doc_id"))
    true_digest = digest(F.when(F.col("doc_id") % 59 == 0, F.encode(F.lit("other"), "UTF-8")).otherwise(F.col("content")))
    gap = F.when(F.col("doc_id") % 61 == 0, " ").otherwise("  ")
    lines = named.filter("doc_id % 31 <> 0").select("package_id", F.col("doc_id").alias("line_no"), F.concat(true_digest, gap, "path").alias("line"))
    control = heads.select("package_id", F.lit(-1).cast("bigint").alias("line_no"), F.concat(digest(F.lit("{}")), F.lit("  package-manifest.json")).alias("line"))
    return files, manifest, lines.unionByName(control)


def document_text(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, text nodes): forty pages whose elements are documents and whose texts are their lines."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    page, ix = F.col("doc_id") % 40, (F.floor(F.col("doc_id") / 40) + 1).cast("int")
    tag = F.when(F.col("doc_id") % 13 == 0, "script").when(F.col("doc_id") % 17 == 0, "textarea").otherwise("p")
    attrs = F.when(F.col("doc_id") % 19 == 0, F.create_map(F.lit("contenteditable"), F.lit("true"))).otherwise(F.create_map().cast("map<string,string>"))
    leaves = documents.select(page.alias("page_id"), ix.alias("node_ix"), F.lit(0).alias("parent_ix"), F.lit(1).alias("depth"), ix.alias("subtree_end"),
                              F.lit(0).alias("child_count"), tag.alias("tag"), attrs.alias("attrs"))
    roots = documents.groupBy(page.alias("page_id")).agg(F.max(ix).alias("subtree_end"), F.count("*").cast("int").alias("child_count")).select(
        "page_id", F.lit(0).alias("node_ix"), F.lit(None).cast("int").alias("parent_ix"), F.lit(0).alias("depth"), "subtree_end", "child_count", F.lit("html").alias("tag"),
        F.create_map().cast("map<string,string>").alias("attrs"))
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "data"))
    texts = lines.select(page.alias("page_id"), (ix.cast("bigint") * 10_000_000 + F.col("pos")).alias("text_ix"), ix.alias("parent_ix"), F.lit(2).alias("depth"), "data")
    return roots.unionByName(leaves), texts


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State events of jobs (one job per user and day)."""
    status = F.when(F.col("k") % 40 == 0, "FAILED").when(F.col("k") % 40 == 1, "CANCELLED").when(F.col("k") % 40 == 2, "COMPLETE").otherwise(
        F.element_at(F.array(*[F.lit(s) for s in ("PREPARED", "INJECTED", "RECEIVING", "ASSEMBLING")]), F.col("k") % 4 + 1))
    return job_event_columns(_events(spark, sf_dir), status)


def job_event_columns(events: DataFrame, status: Column) -> DataFrame:
    day = F.floor(F.unix_seconds("ts") / 86_400)
    return events.select(F.concat_ws("-", F.lit("job"), F.col("user_id").cast("string"), day.cast("string")).alias("job_id"), "event_id",
                         F.col("ts").alias("event_time"), status.alias("status"))


def _zip_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        made = []
        for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
            path = "../a.txt" if doc_id % 11 == 0 else "/a.txt" if doc_id % 13 == 0 else "docs/a.txt"
            held = io.BytesIO()
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")  # repeated names are planted on purpose
                with zipfile.ZipFile(held, "w", zipfile.ZIP_STORED) as archive:
                    for _ in range(2 if doc_id % 17 == 0 else 1):
                        archive.writestr(path, text)
                    archive.writestr("manifest.json", "{}")
            data = held.getvalue()
            made.append((f"doc-{doc_id}", b"no archive" if doc_id % 29 == 0 else data))
        yield pd.DataFrame(made, columns=["package_id", "content"])


def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One small archive per document."""
    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInPandas(_zip_rows, "package_id string, content binary")
