import zlib

import numpy as np
import pandas as pd

from llm import quality, queries

SF = "/root/testdata/sf0.01"


def test_statistics_of_odd_texts():
    for text in ("", " \n", "x", "!!!", "😀 😀", "a" * 100_000, "the cat. " * 5000):
        assert np.isfinite(quality.statistics(text)).all() and len(quality.statistics(text)) == len(quality.STATISTICS)


def test_pooling_is_the_isotonic_fit():
    places, levels = quality._pooled(np.array([0.0, 1, 2, 3]), np.array([1.0, 0, 4, 3]), np.array([2.0, 2, 4, 4]))
    assert (np.diff(levels) >= 0).all() and len(places) == 2 and np.allclose(places, [0.5, 2.5])


def test_features_approximate_a_gaussian_kernel():
    random = np.random.default_rng(0)
    d, wide = len(quality.STATISTICS), 20_000
    model = quality.QualityModel(np.zeros(d), np.ones(d), random.normal(size=(d, wide)) * 0.25, random.uniform(0, 2 * np.pi, wide),
                                 np.zeros(wide + 1), np.zeros(1), np.zeros(1))
    points = random.normal(size=(6, d)) * 0.5
    exact = np.exp(-0.25 ** 2 * ((points[:, None] - points[None]) ** 2).sum(-1) / 2)
    assert np.abs(model.features(points) @ model.features(points).T - exact).max() < 0.05


def test_odd_tables(spark, odd_texts, page_texts):
    measured = quality.page_statistics(odd_texts)
    reviews = spark.createDataFrame([(k, s) for k in range(2, 10) for s in ("PASS", "FAIL", "NOT_RUN", None)], "page_id long, validation_state string")
    scored = quality.score(measured, quality.fit(measured, reviews, features=8)).toPandas()
    assert len(scored) == 12 and scored.score.between(0, 1).all()
    assert quality.fit(measured, reviews.limit(0)) is None
    assert quality.score(measured, None).where("score = 0.5 AND predicted = 1").count() == 12
    empty = quality.page_statistics(page_texts([]))
    assert quality.fit(empty, reviews) is None and quality.score(empty, None).count() == 0


def test_partition_sums_do_not_depend_on_partitions(spark):
    rows = spark.createDataFrame([(bytearray(np.array([float(i), 1.0]).tobytes()),) for i in range(100)], "sums binary")
    assert quality._tree_sum(rows.repartition(40)).tolist() == quality._tree_sum(rows.coalesce(1)).tolist() == [4950.0, 100.0]


def test_held_out_accuracy(spark):
    found = queries.op2_quality_scores(spark, SF).toPandas()
    labels = pd.read_parquet(f"{SF}/labels.parquet")
    assert (found.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in found.doc_id]).all()
    assert (found.predicted == (found.score >= 0.5)).all() and found.score.between(0, 1).all()
    known = found[found.held_out].merge(labels, on="doc_id")
    assert (known.predicted == known.quality).mean() > 0.93
    assert len(found) == len(pd.read_parquet(f"{SF}/documents.parquet", columns=["doc_id"]))
