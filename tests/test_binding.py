"""Binding with instances in one pass against the two operators one after another."""

import pytest
from pyspark.sql import functions as F

from pagefacts.operators import binding

NODES = "page_id long, node_ix int, parent_ix int, depth int, tag string, attrs map<string,string>, class_tokens array<string>, subtree_end int, child_count int"
SOURCE = ("context_id string, document_id string, source_element_key string, source_record_sha256 string, element_id string, id_occurrence_count int, id_uniqueness string, "
          "parent_element_id string, ancestor_element_ids array<string>, element_kind string, el_type string, widget_type string, architecture_kind string, editor_label string")
MARK = ["elementor-element"]


def node(page, ix, parent, depth, end, children, data=None, classes=MARK):
    return (page, ix, parent, depth, "div", {} if data is None else {"data-id": data}, classes, end, children)


def record(element, document="page", number=1, context="c1"):
    key = f"key-{document}-{element}"
    return (context, document, key, f"rec-{key}", element, number, "UNIQUE" if number == 1 else "DUPLICATE", None, [], "widget", None, None, "classic", f"label {element}")


@pytest.fixture(scope="module")
def made(spark):
    rows = [
        node(1, 0, None, 0, 7, 2), node(1, 1, 0, 1, 4, 3, "a"), node(1, 2, 1, 2, 2, 0), node(1, 3, 1, 2, 3, 0, "a"), node(1, 4, 1, 2, 4, 0, "many"),
        node(1, 5, 0, 1, 7, 2, "b", []), node(1, 6, 5, 2, 6, 0, "unknown"), node(1, 7, 5, 2, 7, 0, "b"), node(2, 0, None, 0, 1, 1, "a"), node(2, 1, 0, 1, 1, 0)]
    source = [record("a", "loop"), record("b"), record("many"), record("many", "header")]
    return (spark.createDataFrame(rows, NODES), spark.createDataFrame(source, SOURCE),
            spark.createDataFrame([("c1", d, t) for d, t in (("page", "page"), ("header", "header"), ("loop", "loop-item"))], "context_id string, document_id string, document_type string"),
            spark.createDataFrame([(1, "c1", "page", "CONFIRMED", "s")], "page_id long, context_id string, selected_document_id string, confirmation_state string, site_fingerprint string"))


def listed(frame):
    return sorted(map(str, frame.select("page_id", "node_ix", "node_id", "binding", "instance").collect()))


@pytest.mark.parametrize("copies", [1, 2])
def test_instances_in_one_pass_equal_both_operators(made, copies):
    """Also where nodes come twice; one node is not emitted."""
    nodes, *catalogue = made
    nodes = nodes.withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(copies)))).drop("_i")
    elements = nodes.filter("NOT (page_id = 1 AND node_ix = 2)").withColumn("node_id", F.concat(F.lit("n"), F.col("node_ix").cast("string")))
    context = F.concat(F.lit("p"), F.col("page_id").cast("string"))
    bound = binding.bind_elements(nodes, *catalogue).select("page_id", "node_ix", "binding")
    want = binding.runtime_instances(elements.join(bound, ["page_id", "node_ix"]), context)
    found = binding.bound_instances(elements, nodes, *catalogue, context)
    assert listed(found) == listed(want)
    if copies == 1:
        state = {(r.page_id, r.node_ix): r.instance for r in found.collect()}
        assert (state[1, 1].instance_state, state[1, 3].instance_index, state[1, 7].instance_state) == ("REPEATED_TEMPLATE", 1, "SINGLE_RENDER")


def test_records_cross_one_join_of_all_rows(made):
    """Bindings are made above all joins, so no shuffle carries them."""
    nodes, *catalogue = made
    found = binding.bound_instances(nodes, nodes, *catalogue, F.lit("p"))
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "AS binding#" in text.split("Join", 1)[0]


def test_facts_of_a_page_that_come_twice(made):
    """Each row meets what is inherited under its own facts."""
    nodes, source, documents, context = made
    twice = context.unionByName(context.withColumns({"confirmation_state": F.lit("NOT_CONFIRMED"), "selected_document_id": F.lit("header")}))
    elements = nodes.withColumn("node_id", F.concat(F.lit("n"), F.col("node_ix").cast("string")))
    places = {str(r) for r in binding.bind_elements(nodes, source, documents, twice).select("page_id", "node_ix", "binding").collect()}
    found = binding.bound_instances(elements, nodes, source, documents, twice, F.lit("p"))
    assert {str(r) for r in found.select("page_id", "node_ix", "binding").collect()} == places


def test_what_rows_inherit_is_made_on_the_known_nodes(made):
    nodes, *catalogue = made
    text = binding.bound_instances(nodes, nodes, *catalogue, F.lit("p"))._jdf.queryExecution().optimizedPlan().toString()
    above, below = text.split("Join", 1)
    assert "BOUND_TO_NEAREST_VALIDATED_ANCESTOR" in below and "BOUND_TO_NEAREST_VALIDATED_ANCESTOR" not in above
