import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from llm import prefix_trie

SEGMENTS = "page_id long, position long, kind string, segment string"


def naive(paths):
    """`paths`: page_id to its list of (kind, segment)."""
    members = defaultdict(list)
    for page, path in paths.items():
        for depth in range(len(path) + 1):
            members[tuple(path[:depth])].append(page)
    rows = []
    for prefix, pages in members.items():
        below = [p for p in members if p[:len(prefix)] == prefix]
        childless = [p for p in below if not any(len(q) == len(p) + 1 and q[:len(p)] == p for q in below)]
        ends = ",".join(str(p) for p in sorted(pages) if len(paths[p]) == len(prefix))
        rows.append((min(pages), len(prefix), min(members[prefix[:-1]]) if prefix else None, len(pages), sum(len(p) == len(prefix) + 1 for p in below),
                     len(childless), sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=repr)


def found(spark, paths, local_nodes, pages=None):
    rows = [(page, i, *step) for page, path in paths.items() for i, step in enumerate(path)]
    random.Random(3).shuffle(rows)
    segments = spark.createDataFrame(rows, SEGMENTS).withColumns({n: F.lit("other") for n in ("depth", "node", "top", "load", "n_segments")})
    frame = spark.createDataFrame([(p,) for p in (pages or paths)], "page_id long").withColumn("node", F.lit("other"))
    return sorted((tuple(r) for r in prefix_trie.prefix_tree(frame, segments, local_nodes).collect()), key=repr)


def shapes():
    """A random tree, a star and a chain under one root."""
    random_ = random.Random(5)
    step = lambda: (random_.choice(["HOST", "SEGMENT"]), random_.choice(["a", "bb", "ccc", ""]))
    paths = {i * 3: [step() for _ in range(random_.randint(0, 6))] for i in range(40)}
    paths |= {200 + i: [("HOST", "star"), ("SEGMENT", f"s{i}")] for i in range(20)}
    return paths | {300 + i: [("HOST", "chain"), *(("SEGMENT", "x" * (j % 3)) for j in range(n))] for i, n in ((0, 20), (1, 13))}


@pytest.mark.parametrize("local_nodes", [6, 4096])
def test_against_brute_force(spark, local_nodes):
    """With a limit of six nodes most splits are joins; with the usual one all are local."""
    assert found(spark, shapes(), local_nodes) == naive(shapes())


def test_blocks_of_a_long_page(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "FOLD_SEGMENTS", 4)
    paths = {1: [("SEGMENT", str(i // 2)) for i in range(23)], 2: [("SEGMENT", str(i // 2)) for i in range(19)], 3: [("SEGMENT", "0")]}
    assert found(spark, paths, 4096) == naive(paths)


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, 0, "HOST", "a"), (1, 0, "HOST", "a"), (None, 0, "HOST", "lost"), (2, 5, "", ""), (2, 9, "HOST", "a"), (8, 0, "HOST", "no page"),
            (4, 0, "SEGMENT", "long " * 50_000)]
    pages = spark.createDataFrame([(1,), (1,), (2,), (4,), (None,), (6,)], "page_id long")
    out = prefix_trie.prefix_tree(pages, spark.createDataFrame(rows, SEGMENTS))
    paths = {1: [("", ""), ("HOST", "a"), ("HOST", "a")], 2: [("", ""), ("HOST", "a")], 4: [("SEGMENT", "long " * 50_000)], 6: []}
    assert sorted((tuple(r) for r in out.collect()), key=repr) == naive(paths)


def test_empty_tables(spark):
    none, page = spark.createDataFrame([], "page_id long"), spark.createDataFrame([(5,), (4,)], "page_id long")
    segments = spark.createDataFrame([], SEGMENTS)
    assert prefix_trie.prefix_tree(none, segments).count() == 0
    assert [tuple(r) for r in prefix_trie.prefix_tree(page, segments).collect()] == [
        (4, 0, None, 2, 0, 1, 0, hashlib.sha256(b"4,5").hexdigest())]


def test_paths_of_pages(spark):
    """The operator on page locators: pages of a site share the beginnings of their paths."""
    pages = spark.createDataFrame([(1, "https://example.org/en/news/1"), (2, "https://example.org/en/news/2"), (3, "https://example.org/"), (4, None), (5, "ftp://x")],
                                  "page_id long, url string")
    tree = prefix_trie.prefix_tree(pages, prefix_trie.locator_segments(pages)).collect()
    host = next(r for r in tree if r.page_id == 1 and r.depth == 1)
    assert (host.n_pages, host.n_children, host.n_leaves) == (3, 1, 2)
    assert host.saved_chars == 2 * len("example.org") + len("en") + len("news")
    assert {r.n_pages for r in tree if r.depth == 0} == {5}
