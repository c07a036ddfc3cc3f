"""Hard negatives among measured elements: elements of another kind that score nearly as high as those of the anchor's own kind.

The score is the inner product of whole-number measures.  Candidates are dealt into shards of about `SHARD_ROWS`; a task builds a cover tree over its
shard and then answers the anchors that follow, a block at a time.  An extra coordinate brings all candidates of a shard to one norm, so that the distance
to a node's centre bounds the inner product: a node with centre c and covering radius r holds products within |q| r of (q, c).  The
descent takes the nodes with the best bound first, in growing handfuls, skips those outside every window that is still open, and verifies the members of
leaves exactly.  What shards find is merged by score.

Anchors are a stated query set that meets all elements: the work is anchors times elements, less what the tree skips, and no pair becomes a row.
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

SHARD_ROWS = 4096
#: A node splits into nodes of a radius smaller by this factor, until it has at most `LEAF_ROWS` members or one place.
SHRINK, LEAF_ROWS = 1.3, 16
#: Nodes taken at first in a descent, and how many times more in each later turn; anchors that descend together.
HANDFUL, WIDER, ANCHORS = 256, 8, 64
_EXACT = 2.0 ** 53


def whole_measures(measures: Column | str, scale: float = 1.0) -> Column:
    """floor(scale * x) of each measure, as doubles."""
    column = F.col(measures) if isinstance(measures, str) else measures
    return F.transform(column.cast("array<double>"), lambda x: F.floor(F.lit(float(scale)) * x).cast("double"))


def usable(measures: str) -> Column:
    """Whether the vector and each of its components is there and finite."""
    return F.col(measures).isNotNull() & F.forall(
        F.col(measures), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))


def element_measures(measured: DataFrame) -> DataFrame:
    """`element_ref`, `element_kind`, `measures` of recorded elements: their tag, and place and size in whole pixels."""
    box = F.array(*(F.round(F.col("rect")[side]).cast("double") for side in ("left", "top", "width", "height")))
    return measured.select((F.col("page_id") * F.lit(1 << 32) + F.col("node_ix")).alias("element_ref"), F.col("tag").alias("element_kind"), box.alias("measures"))


class CoverTree:
    """A cover tree over the rows of `vectors`; nodes are numbered level by level, the children of one in a row."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.vectors = vectors
        squares = (vectors * vectors).sum(axis=1)
        top = squares.max(initial=0.0)
        self.norm = math.sqrt(top)
        lifted = np.column_stack([vectors, np.sqrt(np.maximum(top - squares, 0.0))])
        near = (lifted / max(self.norm, 1e-300)).astype(np.float32)
        near = near @ near.T
        self.centre, self.radius, self.first_child, self.n_children, self.members = [], [], [], [], []
        level, limit = [(0, np.arange(len(vectors)))], math.inf
        while level:
            below: list[tuple[int, np.ndarray]] = []
            begin = len(self.centre) + len(level)
            for centre, members in level:
                gaps = lifted[members] - lifted[centre]
                radius = math.sqrt((gaps * gaps).sum(axis=1).max())
                split = len(members) > LEAF_ROWS and radius > 0
                children = _cover(near, centre, members, min(limit, radius / SHRINK) / max(self.norm, 1e-300)) if split else []
                if len(children) == 1:
                    split, children = False, []
                self.centre.append(centre)
                self.radius.append(radius)
                self.first_child.append(begin + len(below))
                self.n_children.append(len(children))
                self.members.append(None if split else members)
                below += children
            limit = max(self.radius[begin - len(level):begin]) / SHRINK
            level = below
        self.centre, self.radius = np.array(self.centre), np.array(self.radius)
        self.first_child, self.n_children = np.array(self.first_child), np.array(self.n_children)

    def children(self, nodes: np.ndarray) -> np.ndarray:
        counts = self.n_children[nodes]
        return np.repeat(self.first_child[nodes] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())


def _cover(near: np.ndarray, centre: int, members: np.ndarray, radius: float) -> list[tuple[int, np.ndarray]]:
    """Greedy cover of `members`: centres more than `radius` apart (of unit vectors), each with the free members within it; the old centre first."""
    least, out = 1.0 - radius * radius / 2, []
    free = np.concatenate([[centre], members[members != centre]])
    while len(free):
        inside = near[free[0], free] >= least
        inside[0] = True
        out.append((int(free[0]), free[inside]))
        free = free[~inside]
    return out


class Wanted:
    """The best `k` scores of one anchor within [low, high], ties to the smaller reference; `same`: of its own kind or of others."""

    def __init__(self, same: bool, low: float, high: float, k: int, tag: tuple = ()) -> None:
        self.same, self.low, self.high, self.k, self.tag, self.best = same, low, high, k, tag, []
        self.floor = low

    def offer(self, scores: np.ndarray, refs: np.ndarray) -> None:
        """`refs` ascend."""
        fits = np.flatnonzero((scores >= self.floor) & (scores <= self.high))
        if not len(fits):
            return
        if len(fits) > 4 * self.k and scores.dtype != object:
            least = np.partition(scores[fits], len(fits) - self.k)[len(fits) - self.k]
            fits = fits[scores[fits] >= least]
        fits = fits[np.argsort(-scores[fits], kind="stable")[:self.k]]
        self.best = sorted([*self.best, *zip((-scores[fits]).tolist(), refs[fits].tolist(), strict=True)])[:self.k]
        if len(self.best) == self.k:
            self.floor = max(self.low, -self.best[-1][0])


class ShardTree:
    """Elements of a shard, in ascending order of their reference, under a cover tree."""

    def __init__(self, refs: list[int], kinds: list, vectors: np.ndarray) -> None:
        order = np.argsort(np.array(refs, dtype=np.int64), kind="stable")
        self.refs = np.array(refs, dtype=np.int64)[order]
        self.codes: dict = {}
        self.kinds = np.array([self.codes.setdefault(kinds[i], len(self.codes)) for i in order])
        self.tree = CoverTree(vectors[order])

    def search(self, refs: list[int], kinds: list, vectors: np.ndarray, wanted: list[list[Wanted]]) -> None:
        """Fill `wanted` of each anchor, which never finds itself."""
        tree, held = self.tree, self.tree.vectors
        lengths = np.sqrt((vectors * vectors).sum(axis=1))
        slack = 1e-9 * lengths * tree.norm + 1e-9
        exact = np.abs(vectors).max(initial=0.0) * np.abs(held).max(initial=0.0) * vectors.shape[1] < _EXACT
        codes = [self.codes.get(k, -1) for k in kinds]
        pool, upper, lower = np.zeros(1, dtype=np.int64), np.full((1, len(refs)), np.inf), np.full((1, len(refs)), -np.inf)
        size = HANDFUL
        while len(pool):
            floors = np.array([min((w.floor for w in ws), default=np.inf) for ws in wanted])
            highs = np.array([max((w.high for w in ws), default=-np.inf) for ws in wanted])
            open_ = (upper >= floors) & (lower <= highs)
            stay = np.flatnonzero(open_.any(axis=1))
            if not len(stay):
                break
            pool, upper, lower = pool[stay], upper[stay], lower[stay]
            best = np.where(open_[stay], upper, -np.inf).max(axis=1)
            first = np.argsort(-best, kind="stable")
            taken, later = pool[first[:size]], first[size:]
            inner = tree.children(taken[tree.n_children[taken] > 0])
            products = held[tree.centre[inner]] @ vectors.T
            reach = tree.radius[inner][:, None] * lengths + slack
            pool = np.concatenate([pool[later], inner])
            upper, lower = np.concatenate([upper[later], products + reach]), np.concatenate([lower[later], products - reach])
            leaves = [tree.members[n] for n in taken if tree.members[n] is not None]
            if leaves:
                self._verify(np.sort(np.concatenate(leaves)), refs, codes, vectors, wanted, exact)
                size *= WIDER

    def _verify(self, rows: np.ndarray, refs: list[int], codes: list[int], vectors: np.ndarray, wanted: list[list[Wanted]], exact: bool) -> None:
        found, kinds = self.refs[rows], self.kinds[rows]
        if exact:
            scores = vectors @ self.tree.vectors[rows].T
        else:  # beyond the whole numbers of a double: with Python's
            scores = _integers(vectors).dot(_integers(self.tree.vectors[rows]).T)
        for i, ws in enumerate(wanted):
            for same in {w.same for w in ws}:
                some = np.flatnonzero((kinds == codes[i]) & (found != refs[i]) if same else kinds != codes[i])
                picked, names = scores[i][some], found[some]
                for w in ws:
                    if w.same == same:
                        w.offer(picked, names)


def _integers(vectors: np.ndarray) -> np.ndarray:
    return np.array([[int(x) for x in row] for row in vectors.tolist()], dtype=object).reshape(vectors.shape)


def _matrix(measures: list[list[float]], width: int) -> np.ndarray:
    """Rows of equal length; missing components are zero, those beyond `width` are left out."""
    out = np.zeros((len(measures), width))
    for i, row in enumerate(measures):
        out[i, :min(width, len(row))] = row[:width]
    return out


def _long(score: float) -> int:
    return max(-2 ** 63, min(2 ** 63 - 1, int(score)))


def _found(batches: Iterator[pa.RecordBatch], wanted_of) -> Iterator[pa.RecordBatch]:
    """Rows of a task: of each shard in turn first the elements, then the anchors."""
    shard, tree, elements, anchors = None, None, [], []

    def answered() -> pa.RecordBatch:
        width = tree.tree.vectors.shape[1]
        wanted = [wanted_of(a) for a in anchors]
        tree.search([a["element_ref"] for a in anchors], [a["element_kind"] for a in anchors], _matrix([a["measures"] for a in anchors], width), wanted)
        rows = [(a["element_ref"], *w.tag, ref, _long(-score)) for a, ws in zip(anchors, wanted, strict=True) for w in ws for score, ref in w.best]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["anchor_ref", "positive_ref", "positive_score", "found_ref", "found_score"])

    for batch in batches:
        for row in batch.to_pylist():
            if row["shard"] != shard:
                if anchors and tree:
                    yield answered()
                shard, tree, elements, anchors = row["shard"], None, [], []
            if not row["is_anchor"]:
                elements.append(row)
                continue
            if tree is None:
                if not elements:
                    continue
                tree = ShardTree([e["element_ref"] for e in elements], [e["element_kind"] for e in elements],
                                 _matrix([e["measures"] for e in elements], max(len(e["measures"]) for e in elements)))
                elements = []
            anchors.append(row)
            if len(anchors) == ANCHORS:
                yield answered()
                anchors = []
    if anchors and tree:
        yield answered()


def _searched(elements: DataFrame, anchors: DataFrame, shards: int, wanted_of) -> DataFrame:
    """`anchors` (with `windows`) put to every shard of `elements`."""
    kinds = "array<struct<ref:bigint,score:bigint>>"
    placed = elements.select(F.pmod(F.xxhash64("element_ref"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("is_anchor"),
                             "element_ref", "element_kind", "measures", F.lit(None).cast(kinds).alias("windows"))
    asked = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("is_anchor"),
                           "element_ref", "element_kind", "measures", F.col("windows").cast(kinds).alias("windows"))
    dealt = placed.unionByName(asked).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "is_anchor")
    names = ("anchor_ref", "positive_ref", "positive_score", "found_ref", "found_score")
    return dealt.mapInArrow(lambda batches: _found(batches, wanted_of), T.StructType([T.StructField(n, T.LongType()) for n in names]))


def hard_negatives(elements: DataFrame, is_anchor: Column, scale: float = 1.0, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
                   shard_rows: int = SHARD_ROWS) -> DataFrame:
    """`anchor_ref`, `positive_ref`, `rank`, `negative_ref`, `positive_score`, `negative_score`.

    `elements` has `element_ref`, `element_kind`, `measures` (see `element_measures`); `is_anchor` says over these columns which of them ask.
    Measures become floor(`scale` * x); a score is the inner product of two elements.  An anchor's positives are the first `positives` others of its
    kind by descending score, ties to the smaller reference.  For each, the first `negatives` elements of other kinds are returned whose score is
    `low` to `high` per cent of the positive's.

    Elements with a null reference, kind, vector, or a null or non-finite component take no part.  Of rows that share a reference the smallest (kind,
    measures) counts, so repeated rows are one element.  Of vectors of different length the shorter one goes on with zeros; empty vectors score 0 with
    all.  Measures and scores that no long holds become the nearest one.  An empty table, or no anchor, gives no rows; other columns are not read.
    """
    rows = elements.select(F.col("element_ref").cast("long").alias("element_ref"), "element_kind", "measures").where(
        F.col("element_ref").isNotNull() & F.col("element_kind").isNotNull() & usable("measures"))
    rows = rows.groupBy("element_ref").agg(F.min(F.struct("element_kind", "measures")).alias("_one")).select(
        "element_ref", "_one.element_kind", whole_measures("_one.measures", scale).alias("measures"))
    rows = checkpointed(rows)
    shards = max(1, math.ceil(rows.count() / shard_rows))
    anchors = rows.where(is_anchor)

    def all_of_kind(_: dict) -> list[Wanted]:
        return [Wanted(True, -math.inf, math.inf, positives, (None, None))]

    def in_windows(anchor: dict) -> list[Wanted]:
        return [Wanted(False, -(-low * p["score"] // 100), high * p["score"] // 100, negatives, (p["ref"], p["score"])) for p in anchor["windows"]
                if low * p["score"] <= high * p["score"]]

    near = _searched(rows, anchors.withColumn("windows", F.lit(None)), shards, all_of_kind)
    place = F.row_number().over(Window.partitionBy("anchor_ref").orderBy(F.desc("found_score"), "found_ref"))
    chosen = near.withColumn("_place", place).where(F.col("_place") <= positives).groupBy("anchor_ref").agg(
        F.collect_list(F.struct(F.col("found_ref").alias("ref"), F.col("found_score").alias("score"))).alias("windows"))
    asking = checkpointed(anchors.join(chosen, anchors.element_ref == chosen.anchor_ref).drop("anchor_ref"))
    found = _searched(rows, asking, shards, in_windows)
    rank = F.row_number().over(Window.partitionBy("anchor_ref", "positive_ref").orderBy(F.desc("found_score"), "found_ref"))
    return found.withColumn("rank", rank).where(F.col("rank") <= negatives).select(
        "anchor_ref", "positive_ref", "rank", F.col("found_ref").alias("negative_ref"), "positive_score", F.col("found_score").alias("negative_score"))
