import math
import random

import numpy as np
from pyspark.sql import functions as F

from llm import nearest, negatives

ELEMENTS = "element_ref long, measures array<double>"


def naive(rows, every, k=5):
    items = {}
    for ref, measures in rows:
        if ref is not None and measures and all(x is not None and math.isfinite(x) for x in measures) and any(measures):
            items[ref] = min(items.get(ref, measures), measures)
    return {ref: [(r, -s) for s, r in sorted((-nearest.cosine(m, v), r) for r, v in items.items() if r != ref)[:k]]
            for ref, m in items.items() if ref % every == 0}


def found(spark, rows, every, **more):
    frame = spark.createDataFrame(rows, ELEMENTS).withColumns({n: F.lit("other") for n in ("part", "is_query", "list", "lists", "rank", "score", "query_ref")})
    out = {}
    for r in sorted(nearest.nearest_elements(frame, F.col("element_ref") % every == 0, **more).collect()):
        out.setdefault(r.query_ref, []).append((r.element_ref, r.score))
    return out


def test_all_lists_probed_is_brute_force(spark):
    """With every list probed only the tests on partial distances can lose a neighbour; crowded places and exact copies have many ties."""
    random_ = random.Random(6)
    places = [[random_.gauss(0, 1) for _ in range(40)] for _ in range(12)]
    rows = [(i, [x + random_.gauss(0, 0.2) for x in places[i % 12]]) for i in range(600)] + [(1000 + i, places[0]) for i in range(80)]
    assert found(spark, rows, 20, probed=1.0, part_rows=200) == naive(rows, 20)


def test_recall(spark):
    """Vectors without any structure are the hardest for lists."""
    random_ = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate(random_.standard_normal((3000, 64)))]
    best, out = naive(rows, 50), found(spark, rows, 50)
    hits = sum(len({r for r, _ in best[q]} & {r for r, _ in out[q]}) for q in best)
    assert hits >= 0.93 * 5 * len(best)
    assert all(len(out[q]) == 5 for q in best)


def test_candidates_are_given_up_early():
    random_ = np.random.default_rng(3)
    places = random_.standard_normal((30, 64))
    vectors = np.repeat(places, 100, axis=0) + random_.normal(0, 0.1, (3000, 64))
    turned = nearest.rotation(64)
    assert np.allclose(turned @ turned.T, np.eye(64))
    part = nearest.Part(list(range(3000)), vectors.tolist(), turned)
    query = (nearest._units(vectors[:1]) @ turned)[0]
    best = sorted((-nearest.cosine(vectors[0].tolist(), v), i) for i, v in enumerate(vectors.tolist()) if i)[:5]
    assert part.nearest(0, vectors[0].tolist(), query, 5) == [(i, -s) for s, i in best]
    assert part.read < 0.5 * vectors.size


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (2, [3.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf]), (7, [None, 1.0]),
            (None, [1.0, 0.0]), (8, []), (9, [5.0]), (10, [0.0, 0.0, 4.0]), (11, [1e300, 1e300]), (12, [-1e-300, 0.0])]
    out = found(spark, rows, 10)
    assert out == naive(rows, 10)
    assert out[0][0] == (1, 1.0) and out[0][-1][0] in (10, 11)


def test_empty_tables(spark):
    assert found(spark, [], 10) == {} and found(spark, [(1, [1.0]), (2, [1.0])], 10) == {} and found(spark, [(0, [1.0])], 10) == {}


def test_on_recorded_elements(spark):
    rows = [(1, i, "p", (0.0, 0.0, float(w), float(h))) for i, (w, h) in enumerate([(100, 10), (200, 21), (10, 100), (50, 5)])]
    measured = spark.createDataFrame(rows, "page_id long, node_ix int, tag string, rect struct<left:double,top:double,width:double,height:double>")
    out = nearest.nearest_elements(negatives.element_measures(measured), F.col("element_ref") % (1 << 32) == 0, k=2).orderBy("rank").collect()
    assert [r.element_ref & 0xFF for r in out] == [3, 1]
