import random
import time
import tracemalloc

import pytest
from pyspark.sql import functions as F

from pagefacts.operators import intervals, ranking, tree
from pagefacts.operators.text import text_shape
from pagefacts.sources import nodes as source
from pagefacts.sources.nodes import extract_nodes, extract_text_nodes
from test_operators import random_tree

NODES = "page_id long, node_ix int, parent_ix int, depth int, subtree_end int, child_count int, p boolean, q boolean, low double"


def shaped(seed, n, chain=False):
    """(parents, paths, ends) of a random tree or of one chain."""
    parents, _, paths, _, _, _ = random_tree(seed, n)
    if chain:
        parents, paths = [None, *range(n - 1)], [list(range(i)) for i in range(n)]
    ends = list(range(n))
    for i in reversed(range(1, n)):
        ends[parents[i]] = max(ends[parents[i]], ends[i])
    return parents, paths, ends


def frame_of(spark, trees):
    rng, rows = random.Random(8), []
    for page, (parents, paths, ends) in trees.items():
        rows += [(page, i, parents[i], len(paths[i]), ends[i], parents.count(i), rng.random() < 0.3, rng.random() < 0.05, rng.random()) for i in range(len(parents))]
    return spark.createDataFrame(rows, NODES), {(r[0], r[1]): r for r in rows}


@pytest.fixture(scope="module")
def trees():
    return {1: shaped(3, 150), 2: shaped(4, 90), 3: shaped(0, 70, chain=True), 4: shaped(9, 1)}


@pytest.mark.parametrize("bucket", [8, 32_768])
def test_nearest_equals_a_walk_up(spark, trees, bucket, monkeypatch):
    """With buckets of eight nodes, nearly all that encloses a node lies in earlier buckets."""
    monkeypatch.setattr(ranking, "NODES_PER_BUCKET", bucket)
    nodes, rows = frame_of(spark, trees)
    found = intervals.enclosing(nodes, nodes.select("page_id", "node_ix", "p", "q", "low"), "p", "q", payload="low")
    got = {(r.page_id, r.node_ix): r for r in intervals.with_nearest(nodes.select("page_id", "node_ix", "parent_ix", "depth"), found, ("p", "q"), ["low"]).collect()}
    for page, (_, paths, _) in trees.items():
        for node, path in enumerate(paths):
            for name, at in (("p", 6), ("q", 7)):
                near = next((a for a in reversed(path) if rows[page, a][at]), None)
                want = (near, None, None) if near is None else (near, len(path) - path.index(near), rows[page, near][8])
                row = got[page, node]
                assert (row[f"nearest_{name}"], row[f"nearest_{name}_dist"], row[f"nearest_{name}_low"]) == want


def test_enclosed_owners(spark, trees):
    nodes, rows = frame_of(spark, trees)
    got = {tuple(r) for r in intervals.enclosed_owners(nodes, nodes.select("page_id", "node_ix", "q"), "q").collect()}
    assert got == {(page, i) for page, (_, paths, _) in trees.items() for i in range(len(paths)) if rows[page, i][5] and any(rows[page, a][7] for a in [*paths[i], i])}


def test_extremes_of_all_that_enclose(spark, trees):
    nodes, rows = frame_of(spark, trees)
    facts = nodes.select("page_id", "node_ix", "p", F.col("low").alias("most"), F.col("low").alias("least"))
    got = {(r.page_id, r.owner_ix): (r.most, r.least) for r in intervals.enclosing_extremes(nodes, facts, "p", ["most"], ["least"]).collect()}
    want = {}
    for page, (_, paths, _) in trees.items():
        for i in range(len(paths)):
            values = [rows[page, a][8] for a in [*paths[i], i] if rows[page, a][6]]
            if rows[page, i][5] and values:
                want[page, i] = (max(values), min(values))
    assert got == want


def test_subtree_aggregates(spark, trees):
    nodes, rows = frame_of(spark, trees)
    values = nodes.filter("q").select("page_id", "node_ix", F.col("node_ix").alias("n"), F.col("low").alias("least"), F.col("low").alias("most"))
    got = {(r.page_id, r.node_ix): (r.n, r.least, r.most) for r in intervals.subtree_aggregates(nodes, values, ["n"], ["least"], ["most"]).collect()}
    want = {}
    for page, (_, paths, _) in trees.items():
        for i in range(len(paths)):
            below = [j for j in range(len(paths)) if (j == i or i in paths[j]) and rows[page, j][7]]
            if below:
                lows = [rows[page, j][8] for j in below]
                want[page, i] = (sum(below), min(lows), max(lows))
    assert got == want


def test_joined_paths(spark, trees):
    nodes, rows = frame_of(spark, trees)
    steps = nodes.select("page_id", "node_ix", "parent_ix", "depth", F.col("node_ix").cast("string").alias("step"), F.col("q").alias("last"))
    got = {(r.page_id, r.node_ix): r.path for r in intervals.joined_paths(steps, ">").collect()}
    for page, (_, paths, _) in trees.items():
        for i in range(len(paths)):
            whole = [*paths[i], i]
            begin = max((k for k, a in enumerate(whole) if rows[page, a][7]), default=0)
            assert got[page, i] == ">".join(map(str, whole[begin:]))


def test_unclosed_tags_need_linear_memory():
    """100,000 tags that nobody closes, each with an end tag that fits nothing: no paths, no scans of what is open."""
    html = "<div></p><li>" * 50_000 + "text"
    tracemalloc.start()
    begin = time.perf_counter()
    built = source._tree_of(html)
    took, (_, peak) = time.perf_counter() - begin, tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(built.nodes) == 100_000 and built.nodes[0][4] == 99_999 and built.texts == [(99_999, 100_000, "text")]
    assert peak < 150_000_000 and took < 20


def test_intervals_of_markup_are_subtrees(spark):
    """Misnested, implied and unclosed tags: an interval holds exactly the nodes whose parents lead to it."""
    html = "<ul><li>a<li>b<table><tr><td>c<td>d<p>e<div>f</ul><p>g<p>h<b>i</p>j<section><p>k<section>l</div></td>"
    rows = extract_nodes(spark.createDataFrame([(1, html), (2, ""), (3, None)], "page_id long, html string")).collect()
    parent = {r.node_ix: r.parent_ix for r in rows}

    def above(node):
        while node is not None:
            yield node
            node = parent[node]

    for r in rows:
        assert [n for n in parent if r.node_ix in above(n)] == list(range(r.node_ix, r.subtree_end + 1))
        assert r.depth == len(list(above(r.node_ix))) - 1 and r.child_count == sum(p == r.node_ix for p in parent.values())


def test_text_of_nested_elements(spark):
    """Numbers of a subtree as if its texts were joined; what is below a control counts for nobody."""
    html = "<div> one <p>two  three<b>\n</b></p> <textarea>hidden words</textarea><p>four<code>five</code></p>longest-token </div><p> </p>"
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    got = {r.node_ix: r for r in text_shape(extract_text_nodes(pages), extract_nodes(pages)).collect()}
    names = [r.tag for r in extract_nodes(pages).orderBy("node_ix").collect()]
    div, p, last = got[0], got[1], got[names.index("p", 4) if "p" in names[4:] else 4]
    assert div.status == "MEASURED" and p.word_count == 2 and p.text_node_count == 2 and p.grapheme_count == len("two  three")
    code_counts = "code" not in __import__("pagefacts.fixed", fromlist=["fixed"]).TEXT_EXCLUDED_TAGS
    words = ["one", "two", "three", "four", *(["five"] if code_counts else []), "longest-token"]
    assert div.word_count == len(words) and div.longest_token == max(map(len, words))
    assert got[max(got)].status == "NO_TEXT" and last is not None


def test_references_on_a_deep_page(spark):
    html = "<div>" * 40 + "<p id=x><a><i></i></a></p>"
    nodes = extract_nodes(spark.createDataFrame([(1, html)], "page_id long, html string"))
    got = {r.node_ix: r.structural_ref for r in tree.structural_refs(nodes).collect()}
    assert got[39] == ">".join(["div:nth-of-type(1)"] * 40) and got[42] == "p#x>a:nth-of-type(1)>i:nth-of-type(1)"


def test_long_texts_reach_the_diagnostics(spark):
    """An element with more texts than the published limit is flagged by `text_shape` and shows up in the diagnostics of its page."""
    from pagefacts import fixed
    from pagefacts.operators.coverage import page_diagnostics

    html = "<div>" + "<b>x</b>" * (fixed.TEXT_NODE_LIMIT + 1) + "</div><p>short</p>"
    pages = spark.createDataFrame([(1, html), (2, "<p>short</p>")], "page_id long, html string")
    shape = text_shape(extract_text_nodes(pages), extract_nodes(pages))
    elements = shape.select("page_id", F.col("over_limit").alias("text_over_limit"), F.lit("UNIQUE").alias("identity_status"), F.lit("EXACT").alias("binding_state"))
    assert [tuple(r) for r in page_diagnostics(elements, ["page_id"]).collect()] == [(1, "TEXT_SHAPE_LIMIT_REACHED", 1)]
