"""Plans as a large cluster makes them, where nothing is small enough to broadcast: rows of a page are never shuffled by the page alone."""

import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pagefacts.operators import ancestors, binding, tree
from pagefacts.operators.ranking import small_group_total
from pagefacts.plans import derive

SF = "/root/testdata/sf0.001"


PLAIN = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}


@pytest.fixture
def plain_joins(spark):
    """Call it after the tables are there: deriving them tunes the session."""
    before = {key: spark.conf.get(key) for key in PLAIN}
    yield lambda: [spark.conf.set(key, value) for key, value in PLAIN.items()]
    for key, value in before.items():
        spark.conf.set(key, value)


def exchanges(frame):
    """(keys, columns) of every shuffle by keys."""
    found, waiting = [], [frame._jdf.queryExecution().executedPlan()]
    while waiting:
        node = waiting.pop()
        hit = re.search(r"hashpartitioning\((.*?), \d+\)", node.simpleString(200)) if node.nodeName() == "Exchange" else None
        if hit:
            columns = re.findall(r"([A-Za-z_]\w*)#", node.output().mkString(","))
            found.append(([key.split("#")[0] for key in hit[1].split(", ")], columns))
        waiting += [node.children().apply(i) for i in range(node.children().size())]
    return found


def crowded(frame):
    return [(keys, columns) for keys, columns in exchanges(frame) if keys == ["page_id"] and "node_ix" in columns]


def test_rows_of_a_page_are_spread(spark, plain_joins):
    nodes = derive.tree_nodes(spark, SF)
    bound = binding.bind_elements(nodes, derive.source_elements(spark, SF), derive.source_documents(spark, SF), derive.contexts(spark, SF))
    plain_joins()
    for frame in (tree.emission_ids(nodes), tree.ordinals(nodes), tree.identities(nodes), tree.structural_refs(nodes), bound):
        assert exchanges(frame) and not crowded(frame)


def test_places_are_written_and_columns_worked_out(spark):
    forest = derive.tree(spark, SF)
    assert not [f.name for f in forest.schema if f.dataType.typeName() in ("map", "array", "struct")]
    assert forest.inputFiles() and sorted(derive.measured_tree(spark, SF).inputFiles()) == sorted(forest.inputFiles())


def test_small_groups_are_shuffled_once(spark, plain_joins):
    rows = [(k, o, o * 7 % 5) for k in range(40) for o in range(4)] + [(90, o, o % 3) for o in range(200)] + [(None, 1, 1), (5, None, 1), (90, None, 2)]
    frame = spark.createDataFrame(rows, "k int, o int, v int")
    plain = F.coalesce(F.sum("v").over(Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    want = sorted(map(tuple, frame.withColumn("got", plain).filter("k IS NOT NULL AND o IS NOT NULL").collect()))
    few, some = (small_group_total(frame, "k", ["o"], F.floor(F.col("o") / 13), F.col("v"), "got", limit) for limit in (1000, 50))
    assert sorted(map(tuple, few.collect())) == want == sorted(map(tuple, some.collect()))
    plain_joins()
    few = small_group_total(frame, "k", ["o"], F.floor(F.col("o") / 13), F.col("v"), "got")
    assert [keys for keys, _ in exchanges(few)] == [["k"]]


def test_ids_of_parents_are_looked_up_once_for_each_parent(spark, plain_joins):
    nodes = derive.tree_nodes(spark, SF)
    emitted = tree.emission_ids(nodes.filter("node_ix % 3 <> 0").select("page_id", "node_ix"))
    plain_joins()
    found = ancestors.emitted_parents(nodes, emitted).select("page_id", "node_ix", "parent_node_id")
    assert not [keys for keys, _ in exchanges(found) if "nearest_emitted" in keys]
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000  # longer methods are not compiled by the JVM
