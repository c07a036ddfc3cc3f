"""Nearest elements by cosine of their measures: inverted lists whose members are scanned a few dimensions at a time.

Unit vectors are dealt into lists by their nearest centroid (fitted on a bounded sample), and lists into parts of about `PART_ROWS` rows, so a list with a
third of all elements is many parts.  A query goes to the parts of the lists it probes.  There all vectors are turned by one random rotation and
kept in blocks of `BLOCK` columns.  After each block the distance so far, scaled to all dimensions, is held against the query's k-th best distance: a
candidate is given up where it is larger than chance allows (hypothesis test at `EPSILON` deviations), else its next block is read.  Those that last to
the end are scored exactly on the vectors as given.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm.common import checkpointed
from llm.negatives import usable

#: Rows the centroids are fitted on: those with the smallest hash of their reference.  Every row is in a list.
SAMPLE_ROWS, LISTS, ROUNDS = 8192, 64, 8
#: The share of lists that a query probes, nearest first.
PROBED = 0.75
PART_ROWS = 4096
BLOCK, EPSILON = 16, 2.1
#: Rows of a part that are measured in full before any is given up.
SEED_ROWS = 128
QUERIES = 256


def _units(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors, scaled by a power of two first so that squares neither overflow nor vanish."""
    largest = np.abs(vectors).max(axis=1, initial=0.0)
    scaled = np.ldexp(vectors, -np.frexp(largest)[1][:, None])
    return scaled / np.sqrt((scaled * scaled).sum(axis=1))[:, None]


def _matrix(measures: list[list[float]], width: int) -> np.ndarray:
    out = np.zeros((len(measures), width))
    for i, row in enumerate(measures):
        out[i, :len(row)] = row
    return out


def fit_centroids(vectors: np.ndarray, lists: int) -> np.ndarray:
    """Unit centroids of unit `vectors` by Lloyd's rounds on cosine, from evenly spread rows; an emptied list keeps its centroid."""
    centroids = vectors[np.linspace(0, len(vectors) - 1, lists).astype(int)].copy()
    for _ in range(ROUNDS):
        owner = (vectors @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, owner, vectors)
        lengths = np.sqrt((sums * sums).sum(axis=1))
        filled = lengths > 0
        centroids[filled] = sums[filled] / lengths[filled, None]
    return centroids


def rotation(width: int) -> np.ndarray:
    """The same random rotation everywhere: the orthogonal factor of a seeded normal matrix."""
    turned, upper = np.linalg.qr(np.random.default_rng(7).standard_normal((width, width)))
    return turned * np.where(np.diag(upper) < 0, -1.0, 1.0)


class Part:
    """A part of a list: rotated unit vectors in column blocks, with the squares of each block."""

    def __init__(self, refs: list[int], measures: list[list[float]], turned: np.ndarray) -> None:
        order = np.argsort(np.array(refs, dtype=np.int64), kind="stable")
        self.refs = np.array(refs, dtype=np.int64)[order]
        self.measures = [measures[i] for i in order]
        self.turned, self.width = turned, len(turned)
        whole = _units(_matrix(self.measures, self.width)) @ turned
        self.blocks = [np.ascontiguousarray(whole[:, a:a + BLOCK]) for a in range(0, self.width, BLOCK)]
        self.squares = [(b * b).sum(axis=1) for b in self.blocks]
        self.read = 0

    def _partial(self, j: int, rows: np.ndarray | slice, query: np.ndarray) -> np.ndarray:
        part = query[j * BLOCK:(j + 1) * BLOCK]
        block = self.blocks[j][rows]
        self.read += block.size
        return self.squares[j][rows] + part @ part - 2 * (block @ part)

    def nearest(self, ref: int, measures: list[float], query: np.ndarray, k: int) -> list[tuple[int, float]]:
        """The `k` best (reference, cosine) other than `ref`; `query` is its rotated unit vector."""
        others = np.flatnonzero(self.refs != ref)
        seed, rest = others[:max(SEED_ROWS, k)], others[max(SEED_ROWS, k):]
        far = sum(self._partial(j, seed, query) for j in range(len(self.blocks)))
        limit = np.partition(far, k - 1)[k - 1] if len(far) >= k else np.inf
        sofar = np.zeros(len(rest))
        for j in range(len(self.blocks)):
            if not len(rest):
                break
            sofar = sofar + self._partial(j, rest, query)
            done = min(self.width, (j + 1) * BLOCK)
            allowed = limit if done == self.width else limit * done / self.width * (1 + EPSILON / math.sqrt(done)) ** 2
            stay = sofar <= allowed + 1e-12
            rest, sofar = rest[stay], sofar[stay]
        rows, far = np.concatenate([seed, rest]), np.concatenate([far, sofar])
        if len(rows) > k:
            rows = rows[far <= np.partition(far, k - 1)[k - 1] + 1e-9]
        scored = sorted((-cosine(measures, self.measures[i]), int(self.refs[i])) for i in rows)
        return [(r, -s) for s, r in scored[:k]]


def cosine(a: list[float], b: list[float]) -> float:
    """In double precision, from sums without loss; the shorter vector goes on with zeros."""
    scale = [math.ldexp(1.0, -max(-1000, min(1000, math.frexp(max(map(abs, v)))[1]))) for v in (a, b)]
    a, b = [x * scale[0] for x in a], [x * scale[1] for x in b]
    n = min(len(a), len(b))
    return math.sumprod(a[:n], b[:n]) / math.sqrt(math.sumprod(a, a)) / math.sqrt(math.sumprod(b, b))


def _answers(batches: Iterator[pa.RecordBatch], turned: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """Rows of a task: of each part in turn first the elements, then the queries."""
    number, part, elements, asked = None, None, [], []

    def answered() -> pa.RecordBatch:
        queries = _units(_matrix([q["measures"] for q in asked], len(turned))) @ turned
        rows = [(q["element_ref"], *found) for q, v in zip(asked, queries, strict=True) for found in part.nearest(q["element_ref"], q["measures"], v, k)]
        columns = list(zip(*rows, strict=True)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)],
                                          ["query_ref", "element_ref", "score"])

    for batch in batches:
        for row in batch.to_pylist():
            if row["part"] != number:
                if asked and part:
                    yield answered()
                number, part, elements, asked = row["part"], None, [], []
            if not row["is_query"]:
                elements.append(row)
                continue
            if part is None:
                if not elements:
                    continue
                part, elements = Part([e["element_ref"] for e in elements], [e["measures"] for e in elements], turned), []
            asked.append(row)
            if len(asked) == QUERIES:
                yield answered()
                asked = []
    if asked and part:
        yield answered()


def _listed(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, probes: int, sizes: np.ndarray | None = None, least: int = 0) -> Iterator[pa.RecordBatch]:
    """Each element with the `probes` lists whose centroids are nearest, nearest first, and further ones while those hold fewer than `least` rows."""
    for batch in batches:
        refs, measures = batch.column(0), batch.column(1).to_pylist()
        near = _units(_matrix(measures, centroids.shape[1])) @ centroids.T
        order = np.argsort(-near, axis=1, kind="stable").astype(np.int32)
        counts = np.full(len(order), probes) if sizes is None else np.maximum(probes, (np.cumsum(sizes[order], axis=1) < least).sum(axis=1) + 1)
        lists = [row[:n] for row, n in zip(order, counts, strict=True)]
        yield pa.RecordBatch.from_arrays([refs, batch.column(1), pa.array(lists, pa.list_(pa.int32()))], ["element_ref", "measures", "lists"])


def nearest_elements(elements: DataFrame, is_query: Column, k: int = 5, probed: float = PROBED, part_rows: int = PART_ROWS) -> DataFrame:
    """`query_ref`, `rank` (from 1), `element_ref`, `score`: the `k` elements found nearest to each query by cosine, ties to the smaller reference.

    `elements` has `element_ref` and `measures` (see `negatives.element_measures`); `is_query` says over these columns which of them ask.  A query
    never finds itself; where fewer than `k` others are in its lists, all of those are returned.

    Elements with a null reference or vector, a null or non-finite component, or only zeros take no part.  Of rows that share a reference the smallest
    vector counts, so repeated rows are one element.  Of vectors of different length the shorter one goes on with zeros.  No elements or no queries
    give no rows; other columns are not read.
    """
    rows = elements.select(F.col("element_ref").cast("long").alias("element_ref"), F.col("measures").cast("array<double>").alias("measures")).where(
        F.col("element_ref").isNotNull() & usable("measures") & F.exists("measures", lambda x: x != 0))
    rows = checkpointed(rows.groupBy("element_ref").agg(F.min("measures").alias("measures")))
    found = T.StructType([T.StructField("query_ref", T.LongType()), T.StructField("element_ref", T.LongType()), T.StructField("score", T.DoubleType())])
    sample = [r.measures for r in rows.orderBy(F.xxhash64("element_ref"), "element_ref").select("measures").limit(SAMPLE_ROWS).collect()]
    width = rows.agg(F.max(F.size("measures"))).first()[0] or 1
    units = _units(_matrix(sample, width)) if sample else np.ones((1, width))
    centroids = fit_centroids(units, max(1, min(LISTS, len(sample) // 32)))
    probes, turned = max(1, math.ceil(probed * len(centroids))), rotation(width)

    def listed(some: DataFrame, *how: object) -> DataFrame:
        return some.select("element_ref", "measures").mapInArrow(
            lambda batches: _listed(batches, centroids, *how), "element_ref long, measures array<double>, lists array<int>")

    placed = checkpointed(listed(rows, 1).withColumn("list", F.col("lists")[0]).drop("lists"))
    sizes = {r["list"]: r["count"] for r in placed.groupBy("list").count().collect()}
    counts = [max(1, math.ceil(sizes.get(i, 0) / part_rows)) for i in range(len(centroids))]
    starts = [0, *np.cumsum(counts).tolist()]
    of = lambda values, at: F.element_at(F.array(*map(F.lit, values)), at + 1)
    part = (of(starts, F.col("list")) + F.pmod(F.xxhash64("element_ref"), of(counts, F.col("list")))).cast("int")
    held = placed.select(part.alias("part"), F.lit(False).alias("is_query"), "element_ref", "measures")
    probing = listed(rows.where(is_query), probes, np.array([sizes.get(i, 0) for i in range(len(centroids))]), k + 1).select("element_ref", "measures", F.explode("lists").alias("list"))
    asked = probing.select(F.explode(F.sequence(of(starts, F.col("list")), of(starts, F.col("list") + 1) - 1)).alias("part"),
                           F.lit(True).alias("is_query"), "element_ref", "measures")
    dealt = held.unionByName(asked).repartitionById(starts[-1], F.col("part")).sortWithinPartitions("part", "is_query")
    near = dealt.mapInArrow(lambda batches: _answers(batches, turned, k), found)
    rank = F.row_number().over(Window.partitionBy("query_ref").orderBy(F.desc("score"), "element_ref"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_ref", "rank", "element_ref", "score")
