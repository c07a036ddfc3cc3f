import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import negatives

ELEMENTS = "element_ref long, element_kind string, measures array<double>"


def product(a, b):
    return sum(int(x) * int(y) for x, y in zip(a, b))


def naive(rows, every, scale=1.0):
    items = {}
    for ref, kind, measures in rows:
        if ref is None or kind is None or measures is None or not all(x is not None and math.isfinite(x) for x in measures):
            continue
        items[ref] = min(items.get(ref, (kind, measures)), (kind, measures))
    items = {r: (k, [math.floor(scale * x) for x in m]) for r, (k, m) in items.items()}
    out = []
    for ref, (kind, measures) in items.items():
        if ref % every:
            continue
        scored = sorted((-product(measures, m), r, k == kind) for r, (k, m) in items.items() if r != ref)
        for score, positive, _ in [s for s in scored if s[2]][:5]:
            fits = [(-n, r) for n, r, same in scored if not same and 50 * -score <= 100 * -n <= 95 * -score][:3]
            out += [(ref, positive, rank, r, -score, n) for rank, (n, r) in enumerate(fits, 1)]
    return sorted(out)


def found(spark, rows, every, **more):
    frame = spark.createDataFrame(rows, ELEMENTS).withColumns({n: F.lit("other") for n in ("shard", "is_anchor", "windows", "rank", "anchor_ref", "found_ref")})
    return sorted(tuple(r) for r in negatives.hard_negatives(frame, F.col("element_ref") % every == 0, **more).collect())


@pytest.mark.parametrize("shard_rows", [40, 1000])
def test_against_brute_force(spark, shard_rows):
    """Two crowded places, copies, ties and a spread of single elements, in one shard and in many."""
    random_ = random.Random(2)
    places = [[random_.uniform(-1, 1) for _ in range(6)] for _ in range(9)]
    rows = [(i, random_.choice("abc"), [x + random_.gauss(0, 0.05) for x in random_.choice(places)]) for i in range(250)]
    rows += [(1000 + i, "abc"[i % 3], places[0]) for i in range(60)]
    assert found(spark, rows, 10, scale=64.0, shard_rows=shard_rows) == naive(rows, 10, 64.0)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, "a", [10.0, 1.0]), (1, "a", [9.0, 0.0]), (2, "b", [8.0, 0.0]), (2, "b", [8.0, 0.0]), (2, "c", [99.0, 0.0]), (3, None, [8.0, 0.0]), (4, "b", None),
            (5, "b", [nan, 1.0]), (6, "b", [inf, 1.0]), (7, "b", [None, 8.0]), (None, "b", [8.0, 0.0]), (8, "b", []), (9, "b", [8.0]), (10, "b", [7.0, 0.0, 5.0]),
            (20, "z", [1.0, 1.0]), (30, "a", [0.0, 0.0])]
    assert found(spark, rows, 10) == naive(rows, 10)
    large = [(i, "ab"[i % 2], [1e9 + i, -1e9 + 3 * i, 1.0]) for i in range(40)] + [(40, "a", [-1e9, 1e9, 0.0])]
    assert found(spark, large, 10) == naive(large, 10)


def test_empty_tables(spark):
    assert found(spark, [], 10) == [] and found(spark, [(1, "a", [1.0]), (2, "b", [1.0])], 10) == []


def test_radii_cover_and_the_descent_skips():
    """Every node holds its members within its radius, and a query near one place reads few of the others."""
    random_ = np.random.default_rng(4)
    places = random_.uniform(-400, 400, (40, 4))
    vectors = np.floor(np.repeat(places, 50, axis=0) + random_.normal(0, 2, (2000, 4)))
    tree = negatives.CoverTree(vectors)
    squares = (vectors * vectors).sum(axis=1)
    lifted = np.column_stack([vectors, np.sqrt(squares.max() - squares)])

    def under(node):
        if tree.members[node] is not None:
            return tree.members[node]
        return np.concatenate([under(c) for c in tree.children(np.array([node]))])

    assert sorted(under(0)) == list(range(2000))
    for node in range(len(tree.centre)):
        gaps = lifted[under(node)] - lifted[tree.centre[node]]
        assert np.sqrt((gaps * gaps).sum(axis=1)).max() <= tree.radius[node] * (1 + 1e-9) + 1e-9
    shard, read = negatives.ShardTree(list(range(2000)), ["a"] * 2000, vectors), []
    plain = shard._verify
    shard._verify = lambda rows, *more: read.append(len(rows)) or plain(rows, *more)
    wanted = [[negatives.Wanted(True, -math.inf, math.inf, 5)]]
    best = int((vectors @ vectors[0]).argmax())
    shard.search([-1], ["a"], vectors[:1], wanted)
    assert wanted[0][0].best[0] == (-float(vectors[best] @ vectors[0]), best)
    assert sum(read) < 1000


def test_on_recorded_elements(spark):
    """Boxes of one tag are positives of each other; boxes of another tag about as large are the hard negatives."""
    rows = [(1, i, tag, (0.0, 0.0, float(w), 10.0)) for i, (tag, w) in enumerate([("p", 100), ("p", 98), ("li", 80), ("li", 20), ("a", 97)])]
    measured = spark.createDataFrame(rows, "page_id long, node_ix int, tag string, rect struct<left:double,top:double,width:double,height:double>")
    elements = negatives.element_measures(measured)
    out = negatives.hard_negatives(elements, F.col("element_ref") % (1 << 32) == 0).collect()
    assert [(r.anchor_ref & 0xFF, r.positive_ref & 0xFF, r.negative_ref & 0xFF) for r in out] == [(0, 1, 2)]
