"""Small fixtures against brute force: what plain windows, loops and lists would give."""

import random
import zipfile

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagefacts import fixed
from pagefacts.operators import ancestors, binding, chunks, sessions, text, tree
from pagefacts.operators.ranking import ordinal, running_total
from pagefacts.sources.nodes import extract_nodes, extract_text_nodes
from pagefacts.sources.packages import package_entry_issues, read_packages

HTML = "<html><body><ul><li>one<li>two <b>x</b></ul><p>first<p>second<br>more<script>var t='</p>';</script></p><div><div><a href=x>go</a></div></div></body></html>"


def random_tree(seed: int, n: int):
    rng = random.Random(seed)
    parents, depth, paths = [None], [0], [[]]
    for ix in range(1, n):
        chain = paths[-1] + [ix - 1]
        parent = rng.choice(chain)
        parents.append(parent)
        paths.append(paths[parent] + [parent])
        depth.append(len(paths[-1]))
    kids = [parents.count(i) for i in range(n)]
    styles = [{"display": "none" if rng.random() < 0.08 else "block", "position": rng.choice(["static", "static", "fixed"]),
               "overflow-x": rng.choice(["visible", "visible", "auto"]), "opacity": "1", "visibility": "visible"} for _ in range(n)]
    tags = [rng.choice(["div", "p", "a", "script"]) for _ in range(n)]
    return parents, depth, paths, kids, styles, tags


def frame_of(spark, made, page=1):
    parents, depth, paths, kids, styles, tags = made
    ends = [max(j for j in range(len(parents)) if j == i or i in paths[j]) for i in range(len(parents))]
    rows = [(page, i, parents[i], depth[i], tags[i], {}, [], ends[i], kids[i], styles[i]) for i in range(len(parents))]
    return spark.createDataFrame(rows, "page_id long, node_ix int, parent_ix int, depth int, tag string, attrs map<string,string>, "
                                       "class_tokens array<string>, subtree_end int, child_count int, styles map<string,string>")


def test_running_total_equals_plain_window(spark):
    frame = spark.range(500).select((F.col("id") % 3).alias("k"), (F.col("id") * 7 % 501).alias("o"), (F.col("id") % 11).alias("v"))
    plain = F.coalesce(F.sum("v").over(Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = running_total(frame.withColumn("want", plain), ["k"], ["o"], F.floor(F.col("o") / 13), F.col("v"), "got")
    assert out.count() == 500 and out.filter("want <> got").count() == 0
    ranked = ordinal(frame, ["k"], ["o"], F.floor(F.col("o") / 13), "n")
    assert ranked.groupBy("k").agg((F.max("n") + 1 == F.count("*")).alias("ok")).filter("NOT ok").count() == 0


def test_nearest_ancestors_equal_loops(spark):
    made = random_tree(3, 120)
    _, _, paths, _, styles, _ = made
    got = {r.node_ix: r for r in ancestors.nearest_ancestors(frame_of(spark, made)).collect()}
    for i, path in enumerate(paths):
        near = next((a for a in reversed(path) if styles[a]["overflow-x"] == "auto"), None)
        hidden = next((a for a in reversed(path) if styles[a]["display"] == "none"), None)
        assert (got[i].nearest_scroll, got[i].nearest_hidden) == (near, hidden)
        assert got[i].visible == (hidden is None and styles[i]["display"] != "none")


def test_selection_equals_traversal(spark):
    for seed, most, deepest in ((5, 10, 4), (6, 400, 2), (7, 400, 30)):
        made = random_tree(seed, 300)
        parents, depth, _, kids, styles, tags = made
        children = {i: [j for j in range(300) if parents[j] == i] for i in range(300)}
        stack, selected, scanned, cut = [0], [], 0, 0
        while stack and scanned < tree.scan_budget(most):
            node = stack.pop()
            scanned += 1
            skip, hidden = tags[node] in fixed.SKIPPED_TAGS, styles[node]["display"] == "none"
            if not skip and len(selected) < most and not hidden:
                selected.append(node)
            if skip or (hidden and kids[node]):
                continue
            if depth[node] >= deepest:
                cut += kids[node] > 0
                continue
            stack.extend(reversed(children[node]))
        out = tree.select_nodes(frame_of(spark, made), most, deepest)
        assert sorted(r.node_ix for r in out.filter("selected").collect()) == sorted(selected)
        row = tree.selection_summary(out, most, deepest).first()
        assert (row.scanned_nodes, row.truncated_branches) == (scanned, cut + len(stack))


def test_tree_profile(spark):
    pages = spark.createDataFrame([(1, HTML)], "page_id long, html string")
    rows = {r.node_ix: r for r in extract_nodes(pages).collect()}
    tags = [rows[i].tag for i in range(len(rows))]
    assert tags == ["html", "body", "ul", "li", "li", "b", "p", "p", "br", "script", "div", "div", "a"]
    assert [rows[i].parent_ix for i in range(len(rows))] == [None, 0, 1, 2, 2, 4, 1, 1, 7, 7, 1, 10, 11]
    assert rows[12].attrs == {"href": "x"} and rows[1].child_count == 4
    texts = [r.data for r in extract_text_nodes(pages).orderBy("text_ix").collect()]
    assert texts[:4] == ["one", "two ", "x", "first"]


def test_nodes_in_sql(spark):
    from pagefacts.sources.nodes import register_page_nodes

    register_page_nodes(spark)
    spark.createDataFrame([(1, HTML)], "page_id long, html string").createOrReplaceTempView("some_pages")
    rows = spark.sql("SELECT page_id, n.node_ix, n.tag FROM some_pages, LATERAL page_nodes(html) n ORDER BY node_ix").collect()
    assert [r.tag for r in rows][:4] == ["html", "body", "ul", "li"] and len(rows) == 13


def test_text_shape_graphemes(spark):
    pages = spark.createDataFrame([(1, "<p>é \U0001F468‍\U0001F469‍\U0001F467 x</p>")], "page_id long, html string")
    row = text.text_shape(extract_text_nodes(pages), extract_nodes(pages)).first()
    assert (row.status, row.grapheme_count, row.word_count) == ("MEASURED", 5, 3)


def test_two_state_rules_differ(spark):
    rows = [(1, "EXACT"), (1, "AMBIGUOUS"), (2, "EXACT"), (2, "UNMATCHED")]
    frame = spark.createDataFrame(rows, "k int, s string").select("k", F.struct(F.col("s").alias("binding_state")).alias("binding"))
    assert {r.k: r.binding_state for r in binding.aggregate_binding_state(frame, ["k"]).collect()} == {1: "AMBIGUOUS", 2: "PROBABLE"}
    assert {r.k: r.binding_state for r in binding.session_binding_state(frame, ["k"]).collect()} == {1: "EXACT", 2: "EXACT"}


def test_readiness_does_not_depend_on_buckets(spark):
    rng = random.Random(1)
    rows = [(f"c{c}", i, i * 100.0, rng.choice([1.0, 1.0, 1.0, 2.0]), 1.0, 1.0, 1.0, "complete", rng.random() > 0.2, 0) for c in range(20) for i in range(30)]
    frame = spark.createDataFrame(rows, "capture_id string, sample_no int, elapsed_ms double, doc_w double, doc_h double, view_w double, view_h double, "
                                        "ready_state string, fonts_loaded boolean, unresolved_images int")
    whole = {tuple(r) for r in sessions.readiness_verdict(frame).collect()}
    assert whole == {tuple(r) for r in sessions.readiness_verdict(frame, rows_per_bucket=4).collect()}


def test_assembly_restores_the_text(spark):
    body = "".join(chr(97 + i % 26) for i in range(1000))
    parts = [("j", i, body[i * 100:(i + 1) * 100]) for i in range(10)]
    random.Random(2).shuffle(parts)
    frame = spark.createDataFrame(parts, "job_id string, chunk_index int, data string").withColumns({"sha256": F.sha2("data", 256), "byte_length": F.octet_length("data")})
    jobs = spark.createDataFrame([("j", 10, 5000, None)], "job_id string, expected_chunks int, max_bytes long, full_sha256 string")
    assert chunks.assemble_chunks(frame, jobs).first().text == body
    short = jobs.withColumn("max_bytes", F.lit(999).cast("long"))
    assert chunks.assemble_chunks(frame, short).first().reason == "ASSEMBLED_SIZE"


def test_archives_from_files(spark, tmp_path):
    for name, entries in (("good", ["a.txt", "b/c.txt"]), ("bad", ["../x"])):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w", zipfile.ZIP_STORED) as archive:
            for entry in entries:
                archive.writestr(entry, "data")
    (tmp_path / "broken.zip").write_bytes(b"nothing")
    found = {(r.package_id, r.path, r.issue) for r in package_entry_issues(read_packages(spark, str(tmp_path))).collect()}
    assert found == {("bad", "../x", "PATH_UNSAFE"), ("broken", "", "ARCHIVE_INVALID")}


def test_plans_stay_in_the_jvm(spark):
    """Binding and readiness run without Python, without a cross join and without a nested-loop join."""
    from pagefacts.plans import registry

    for name in ("bind_direct", "feed_readiness", "page_locators", "assemble_chunks"):
        plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan, name
