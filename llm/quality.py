"""Quality of page texts: random Fourier features of text statistics, ridge regression, isotonic calibration.

Statistics are taken from the whole text.  Standardised and clipped, they are mapped to cosines of random projections, which approximate a
Gaussian kernel.  The normal equations of the ridge fit are sums over rows: every partition sums its own, and sums of sums
meet in a tree, so no labelled row leaves its partition and there is no bound on their number.  Scores of labelled rows kept out of the
fit are counted in bins and pooled to a monotone curve, which turns a score into a share of passing pages.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm.common import texts

STATISTICS = (
    "log_chars", "log_words", "mean_word", "deviation_word", "distinct_words", "word_entropy", "top_word", "adjacent_repeats", "distinct_pairs",
    "upper", "digits", "marks", "wordless", "mark_endings", "short_words", "full_stops", "commas", "bars", "log_lines", "mean_line",
    "distinct_lines", "beyond_ascii", "compressed",
)
FEATURES = 512
BINS = 1000


def statistics(data: str) -> list[float]:
    """The values of `STATISTICS` for one text; zeros for an empty one."""
    words = data.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n_chars, n = len(data), len(words)
    sizes = np.fromiter(map(len, words), np.float64, n)
    counts = Counter(words)
    shares = np.fromiter(counts.values(), np.float64, len(counts)) / n
    repeats = sum(map(str.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:])))
    codes = np.frombuffer(data.encode("utf-32-le"), "<u4")
    seen = np.bincount(np.minimum(codes, 128), minlength=129)
    letters = seen[65:91].sum() + seen[97:123].sum() + seen[128]
    marks = seen[33:48].sum() + seen[58:65].sum() + seen[91:97].sum() + seen[123:127].sum()
    endings = Counter(word[-1] for word in words)
    lines = [line for line in data.split("\n") if line.strip()]
    raw = data.encode()
    solid = n_chars - seen[9:14].sum() - seen[32]
    return [
        math.log1p(n_chars), math.log1p(n), sizes.mean(), sizes.std(), len(counts) / n, -float(shares @ np.log(shares)) / math.log(n + 1),
        shares.max(), repeats / n, (pairs + 1) / n, seen[65:91].sum() / max(1, letters), seen[48:58].sum() / solid, marks / solid,
        sum(not any(map(str.isalpha, word)) for word in counts) / len(counts),
        sum(v for end, v in endings.items() if not end.isalnum() and end not in ".,") / n,
        float((sizes <= 3).mean()), endings["."] / n, endings[","] / n, seen[124] / n, math.log1p(len(lines)),
        math.log1p(n_chars / max(1, len(lines))), len(set(lines)) / max(1, len(lines)), seen[128] / n_chars,
        len(zlib.compress(raw, 1)) / len(raw),
    ]


def page_statistics(page_texts: DataFrame, page_id: str = "page_id", data: str = "data") -> DataFrame:
    """`page_id`, `statistics` (doubles, in the order of `STATISTICS`) of each row; a null text counts as empty."""

    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([statistics(x) for x in batch], dtype=object)

    rows = texts(page_texts, page_id, data=data)
    return rows.select(page_id, F.pandas_udf(measured, T.ArrayType(T.DoubleType()))(data).alias("statistics"))


@dataclass(frozen=True)
class QualityModel:
    """Everything a score needs; small and independent of the number of rows."""

    centre: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, values: np.ndarray) -> np.ndarray:
        scaled = np.clip((values - self.centre) / self.scale, -6, 6)
        return np.cos(scaled @ self.directions + self.phases) * math.sqrt(2 / len(self.phases))

    def raw(self, values: np.ndarray) -> np.ndarray:
        return self.features(values) @ self.weights[:-1] + self.weights[-1]

    def score(self, values: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(values), self.knots, self.levels)


def _matrix(batch: pd.DataFrame, column: str = "statistics") -> np.ndarray:
    return np.stack(batch[column].to_numpy()).astype(np.float64) if len(batch) else np.zeros((0, len(STATISTICS)))


def _tree_sum(rows: DataFrame, width: int = 8) -> np.ndarray | None:
    """Sum of the arrays in the binary column `sums`, over ever fewer partitions; the driver reads `width` of them at most."""

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            for raw in batch["sums"]:
                part = np.frombuffer(raw, np.float64)
                total = part.copy() if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"sums": [total.tobytes()]})

    parts = rows.rdd.getNumPartitions()
    while parts > width:
        parts = max(width, parts // 16)
        rows = rows.repartition(parts).mapInPandas(added, "sums binary")
    found = [np.frombuffer(row.sums, np.float64) for row in rows.collect()]
    return sum(found) if found else None


def _pooled(scores: np.ndarray, passed: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling adjacent violators: block centres and levels, ascending."""
    blocks: list[list[float]] = []
    for place, good, n in zip(scores, passed, counts):
        blocks.append([place * n, good, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    total = np.array(blocks)
    return total[:, 0] / total[:, 2], (total[:, 1] + 0.5) / (total[:, 2] + 1)


def fit(page_stats: DataFrame, reviews: DataFrame, page_id: str = "page_id", validation_state: str = "validation_state",
        features: int = FEATURES, ridge: float = 1e-3, spread: float = 0.25, seed: int = 7) -> QualityModel | None:
    """Model from `reviews`: `page_id`, `validation_state` PASS or FAIL; other states, null ids and unknown pages are left out.

    One row in four, by the hash of its id, is kept out of the fit for calibration.  None where no reviewed page is left.
    Several reviews of a page all count.
    """
    told = reviews.select(page_id, F.when(F.col(validation_state) == "PASS", 1.0).when(F.col(validation_state) == "FAIL", 0.0).alias("passed"))
    rows = page_stats.select(page_id, "statistics").join(told.where("passed IS NOT NULL"), page_id)
    rows = rows.select("statistics", "passed", (F.pmod(F.xxhash64(page_id), F.lit(4)) == 0).alias("kept_out"))
    sizes = range(len(STATISTICS))
    moments = rows.agg(F.count("*").alias("n"), F.avg("passed").alias("share"),
                       *(f(F.col("statistics")[i]).alias(f"{name}_{i}") for i in sizes for name, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    if not moments.n:
        return None
    centre = np.array([moments[f"m_{i}"] for i in sizes])
    scale = np.maximum(np.array([moments[f"s_{i}"] for i in sizes]), 1e-6)
    random = np.random.default_rng(seed)
    directions = random.normal(size=(len(STATISTICS), features)) * spread
    phases = random.uniform(0, 2 * math.pi, features)
    bare = QualityModel(centre, scale, directions, phases, np.zeros(features + 1), np.zeros(1), np.zeros(1))
    share = min(max(float(moments.share), 1e-3), 1 - 1e-3)

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((features + 1, features + 2))
        for batch in batches:
            for start in range(0, len(batch), 4096):
                part = batch.iloc[start:start + 4096]
                known = part["passed"].to_numpy(float)
                weight = np.where(known > 0.5, 0.5 / share, 0.5 / (1 - share))[:, None]
                left = np.hstack([bare.features(_matrix(part)), np.ones((len(part), 1))])
                total += left.T @ (np.hstack([left, known[:, None]]) * weight)
        yield pd.DataFrame({"sums": [total.tobytes()]})

    def solved(some: DataFrame) -> np.ndarray | None:
        sums = _tree_sum(some.select("statistics", "passed").mapInPandas(summed, "sums binary"))
        if sums is None:
            return None
        sums = sums.reshape(features + 1, features + 2)
        penalty = np.eye(features + 1) * ridge * max(1.0, sums[-1, features])
        penalty[-1, -1] = 1e-9
        return np.linalg.solve(sums[:, :-1] + penalty, sums[:, -1])

    weights = solved(rows.where("NOT kept_out"))
    fitted = QualityModel(centre, scale, directions, phases, weights, np.zeros(1), np.zeros(1))
    binned = (rows.where("kept_out").withColumn("bin", F.floor((_apply(fitted.raw)("statistics") + 1) * BINS / 3))
              .withColumn("bin", F.greatest(F.lit(0), F.least(F.lit(BINS), "bin")))
              .groupBy("bin").agg(F.sum("passed").alias("passed"), F.count("*").alias("n")).orderBy("bin").collect())
    if not binned:
        return QualityModel(centre, scale, directions, phases, weights, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    places = (np.array([row.bin for row in binned]) + 0.5) * 3 / BINS - 1
    knots, levels = _pooled(places, np.array([row.passed for row in binned]), np.array([float(row.n) for row in binned]))
    return QualityModel(centre, scale, directions, phases, weights, knots, levels)


def _apply(scorer):
    def applied(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(scorer(_matrix(batch.to_frame("statistics"))), dtype="float64")

    return F.pandas_udf(applied, T.DoubleType())


def score(page_stats: DataFrame, model: QualityModel | None, page_id: str = "page_id") -> DataFrame:
    """`page_id`, `score` (0 to 1, higher: PASS likelier), `predicted` (1 from 0.5 on) of each row; 0.5 where there is no model."""
    found = F.lit(0.5) if model is None else _apply(model.score)("statistics")
    return page_stats.select(page_id, found.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
