"""The tree of shared beginnings of page paths, with totals of every subtree.

The records are page locators taken apart: `page_id`, `position`, `kind` (host or path segment) and `segment`; pages of a site share the
first segments of their paths.  A node is a distinct sequence of first (kind, segment) pairs; it is named by its smallest page and its depth.

Subtree totals come from a centroid decomposition of the parent-edge forest.  A component is a connected piece of the tree.  Its heavy
nodes, those with at least half of the component's load in their subtree, are one path from its top; the lowest of them is the centroid.
Taking it out leaves pieces of at most half the load each.  The values below the centroid are totals of those pieces; they are added to
every node on the path from the centroid to the top, and each piece is split again.  Components of more than `LOCAL_NODES` nodes are split by joins,
all of one round together; a smaller component is split to the end inside one task.  A star and a chain are alike: rounds grow
with the logarithm of the largest component, and no path is ever stored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.common import checkpointed, quantile_bounds, range_of
from pagefacts.operators.pages import page_locators
from pagefacts.operators.ranking import running_total

#: Components of at most so many nodes meet in one task; larger ones are split by joins.
LOCAL_NODES = 4096
#: Segments of one page whose digests are folded together in a task; further blocks start from the totals of the earlier ones.
FOLD_SEGMENTS = 1024
_ENDS = "node long, depth int, ends_sha256 string"
_TOTALS = "node long, depth int, n_leaves long, saved_chars long"


def locator_segments(pages: DataFrame) -> DataFrame:
    """`page_id`, `position`, `kind`, `segment` of the locators of `pages` (`page_id`, `url`): host first, then the segments of the path.

    Addresses that have no locator give no rows; an empty path has the host alone.
    """
    located = page_locators(pages.select("page_id", "url")).where("host IS NOT NULL")
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    steps = F.concat(
        F.array(F.struct(F.lit("HOST").alias("kind"), F.col("host").alias("segment"))),
        F.transform(parts, lambda s: F.struct(F.lit("SEGMENT").alias("kind"), s.alias("segment"))))
    return located.select("page_id", F.posexplode(steps).alias("position", "_step")).select(
        "page_id", F.col("position").cast("long").alias("position"), "_step.kind", "_step.segment")


def ranked_segments(segments: DataFrame, parts: int | None = None) -> DataFrame:
    """`page_id`, `depth` (from 1, by position, null first; ties by kind and segment), `kind`, `segment`, `n_segments` of the page.

    The position is cut at quantiles first, so a page with a third of all segments is numbered in many tasks.
    """
    spark = segments.sparkSession
    rows = segments.where("page_id IS NOT NULL").select(
        F.col("page_id").cast("long").alias("page_id"), "position", F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("segment", F.lit("")).alias("segment"))
    bounds = quantile_bounds(rows, "position", parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    bucket = range_of("position", bounds) if bounds else F.lit(0)
    order = [F.col("position").asc_nulls_first(), "kind", "segment"]
    numbered = running_total(rows, ["page_id"], order, bucket, F.lit(1), "_before", "n_segments")
    return numbered.select("page_id", (F.col("_before") + 1).cast("int").alias("depth"), "kind", "segment", F.col("n_segments").cast("int").alias("n_segments"))


def _prefix_digests(ranked: DataFrame) -> DataFrame:
    """`page_id`, `depth`, `n_segments`, `chars` and `_a`, `_b`: 128 bits that stand for the first `depth` pairs of the page.

    They are the exclusive or of hashes of each (depth, kind, segment), so blocks of a long page fold separately.
    """
    rows = ranked.select(
        "page_id", "depth", "n_segments", F.length("segment").alias("chars"), F.floor((F.col("depth") - 1) / FOLD_SEGMENTS).cast("int").alias("_block"),
        *(F.xxhash64(F.lit(seed), "depth", "kind", "segment").alias(name) for seed, name in ((1, "_a"), (2, "_b"))))
    names = ("_a", "_b")
    totals = rows.where(F.col("n_segments") > FOLD_SEGMENTS).groupBy("page_id", "_block").agg(*(F.bit_xor(n).alias(n) for n in names))
    earlier = Window.partitionBy("page_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("page_id", "_block", *(F.bit_xor(n).over(earlier).alias(f"_carried{n}") for n in names)).where("_block > 0")
    so_far = Window.partitionBy("page_id", "_block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    folded = rows.withColumns({n: F.bit_xor(n).over(so_far) for n in names}).join(carried, ["page_id", "_block"], "left")
    return folded.select("page_id", "depth", "n_segments", "chars",
                         *(F.col(n).bitwiseXOR(F.coalesce(f"_carried{n}", F.lit(0))).alias(n) for n in names))


def _ends_digests(ends: DataFrame, bounds: list) -> DataFrame:
    """`node`, `depth`, `ends_sha256`: SHA-256 of the decimal page ids that end at a node, ascending and comma-joined.

    Ids are joined within ranges of ids first, cut at `bounds`; the ranges of a node then stream through one running digest.
    """
    pieces = ends.withColumn("_range", range_of("page_id", bounds) if bounds else F.lit(0)).groupBy("node", "depth", "_range").agg(
        F.array_join(F.sort_array(F.collect_list("page_id")), ",").alias("piece"))

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, running, done = None, None, []
        for batch in batches:
            for node, depth, _, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (node, depth) != key:
                    if running is not None:
                        done.append((*key, running.hexdigest()))
                    key, running = (node, depth), hashlib.sha256(piece.encode())
                else:
                    running.update(b"," + piece.encode())
            if done:
                yield _batch(done, ("node", "depth", "ends_sha256"))
                done = []
        if running is not None:
            yield _batch([(*key, running.hexdigest())], ("node", "depth", "ends_sha256"))

    return pieces.repartition("node", "depth").sortWithinPartitions("node", "depth", "_range").mapInArrow(digested, _ENDS)


def _batch(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    types = {"depth": pa.int32(), "ends_sha256": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(x, types.get(n, pa.int64())) for n, x in zip(names, zip(*rows), strict=True)], list(names))


def _local_totals(depth: np.ndarray, parent: np.ndarray, leaf: np.ndarray, saved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Subtree sums of one component by centroid decomposition; rows ascend by depth, `parent` is a row number or -1 at the top."""
    sums = np.zeros((len(depth), 2), dtype=np.int64)
    values = np.stack([leaf, saved], axis=1)
    up = parent.tolist()
    open_pieces = [list(range(len(up)))]
    while open_pieces:
        piece = open_pieces.pop()
        if len(piece) == 1:
            sums[piece[0]] += values[piece[0]]
            continue
        sizes = dict.fromkeys(piece, 1)
        for row in reversed(piece[1:]):
            sizes[up[row]] += sizes[row]
        centroid = next(row for row in reversed(piece) if 2 * sizes[row] >= len(piece))
        below: dict[int, list[int]] = {}
        label: dict[int, int] = {}
        rest = []
        for row in piece:
            if row == centroid:
                continue
            tag = row if up[row] == centroid else label.get(up[row])
            if tag is None:
                rest.append(row)
            else:
                label[row] = tag
                below.setdefault(tag, []).append(row)
        total = values[[centroid, *label]].sum(axis=0)
        at, top = centroid, piece[0]
        while True:
            sums[at] += total
            if at == top:
                break
            at = up[at]
        open_pieces += [*below.values(), *([rest] if rest else [])]
    return sums[:, 0], sums[:, 1]


def _whole_components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by component and depth; the components of a batch are settled once the next one begins."""
    held: list[tuple] = []
    for batch in batches:
        held += zip(*(c.to_pylist() for c in batch.columns), strict=True)
        opens = [i for i in range(1, len(held)) if held[i][:2] != held[i - 1][:2]]
        if opens:
            yield _settled(held[:opens[-1]])
            held = held[opens[-1]:]
    if held:
        yield _settled(held)


def _settled(rows: list[tuple]) -> pa.RecordBatch:
    out, begin = [], 0
    for end in range(1, len(rows) + 1):
        if end < len(rows) and rows[end][:2] == rows[begin][:2]:
            continue
        _, _, node, depth, parent, leaf, saved, more_leaves, more_saved = zip(*rows[begin:end], strict=True)
        place = {key: i for i, key in enumerate(zip(node, depth, strict=True))}
        ups = np.array([-1, *(place[p, d - 1] for p, d in zip(parent[1:], depth[1:], strict=True))])
        leaves, chars = _local_totals(np.array(depth), ups, np.array(leaf), np.array(saved))
        out += zip(node, depth, (leaves + more_leaves).tolist(), (chars + more_saved).tolist(), strict=True)
        begin = end
    return _batch(out, ("node", "depth", "n_leaves", "saved_chars"))


def subtree_totals(nodes: DataFrame, members: DataFrame, local_nodes: int = LOCAL_NODES) -> DataFrame:
    """`node`, `depth`, `n_leaves`, `saved_chars` of each subtree, by centroid decomposition.

    `nodes`: `node`, `depth`, `parent` (the parent's node; null at a root), `load` (any positive weight, summed over the subtree), `leaf`, `saved`, and
    `top`, `top_depth`, which name the component: one name for all, at first.
    `members`: `page_id`, `depth`, `node`, `parent` of each page on its way down, which tells a node's ancestor at a depth.
    """
    none = F.lit(0).cast("long")
    state = nodes.select("node", "depth", "parent", "top", "top_depth", "load", "leaf", "saved", none.alias("more_leaves"), none.alias("more_saved"))
    small, finished = [], []
    steps = members.select(F.col("page_id").alias("node"), F.col("depth").alias("_step_depth"), F.col("node").alias("_step"), F.col("parent").alias("_step_parent"))
    while True:
        pieces = state.groupBy("top", "top_depth").agg(F.count("*").alias("_n"), F.max("load").alias("_whole")).where(F.col("_n") > local_nodes)
        pieces = checkpointed(pieces)
        key = ["top", "top_depth"]
        small.append(state.join(pieces.select(*key), key, "left_anti"))
        if pieces.isEmpty():
            break
        large = state.join(pieces.select(*key, "_whole"), key).withColumn("_heavy", 2 * F.col("load") >= F.col("_whole"))
        lowest = F.max(F.when(F.col("_heavy"), F.struct("depth", "node", "load")))
        centroids = large.groupBy(*key).agg(lowest.alias("_c")).select(
            *key, F.col("_c.node").alias("_node"), F.col("_c.depth").alias("_depth"), F.col("_c.load").alias("_load"))
        split = large.join(centroids, key).withColumns({
            "_is": (F.col("node") == F.col("_node")) & (F.col("depth") == F.col("_depth")), "_step_depth": F.col("_depth") + 1})
        deeper = split.join(steps, ["node", "_step_depth"], "left").withColumn(
            "_below", F.coalesce((F.col("depth") >= F.col("_step_depth")) & (F.col("_step_parent") == F.col("_node")), F.lit(False)))
        deeper = checkpointed(deeper)
        totals = deeper.where("_is OR _below").groupBy(*key).agg(F.sum("leaf").alias("_leaves"), F.sum("saved").alias("_saved"))
        on_path = lambda column: F.when(F.col("_heavy"), F.col(column)).otherwise(0)
        added = deeper.join(totals, key).withColumns({
            "more_leaves": F.col("more_leaves") + on_path("_leaves"), "more_saved": F.col("more_saved") + on_path("_saved"),
            "load": F.col("load") - F.when(~F.col("_is"), on_path("_load")).otherwise(0)})
        added = checkpointed(added.withColumns({
            "top": F.when(F.col("_below"), F.col("_step")).otherwise(F.col("top")),
            "top_depth": F.when(F.col("_below"), F.col("_step_depth")).otherwise(F.col("top_depth"))}).select(*state.columns, "_is"))
        finished.append(added.where("_is").select("node", "depth", F.col("more_leaves").alias("n_leaves"), F.col("more_saved").alias("saved_chars")))
        state = added.where("NOT _is").drop("_is")
    rest = small[0]
    for rows in small[1:]:
        rest = rest.unionByName(rows)
    found = rest.select("top", "top_depth", "node", "depth", "parent", "leaf", "saved", "more_leaves", "more_saved").repartition(
        "top", "top_depth").sortWithinPartitions("top", "top_depth", "depth", "node").mapInArrow(_whole_components, _TOTALS)
    for rows in finished:
        found = found.unionByName(rows)
    return found


def prefix_tree(pages: DataFrame, segments: DataFrame, local_nodes: int = LOCAL_NODES) -> DataFrame:
    """One row per distinct beginning of page paths: `page_id` (smallest member), `depth`, `parent_page_id`, `n_pages`, `n_children`, `n_leaves`,
    `saved_chars`, `ends_sha256`.

    `pages` has every `page_id`; `segments` has `page_id`, `position`, `kind`, `segment` (see `locator_segments`).  All pages are members of
    the root (depth 0, no parent).  `n_leaves` counts childless nodes of a subtree, its top included; `saved_chars` sums (`n_pages` - 1) times the
    code points of the last segment over the subtree; `ends_sha256` is the digest of the ids of pages that end there (see `_ends_digests`).

    Rows with a null `page_id` take no part; repeated pages count once; segments of pages not in `pages` are ignored.  Null `kind` and `segment` are
    empty; null positions come first, and equal ones go by kind and segment, so repeated rows are repeated steps.  No pages give no rows; other
    columns are not read.
    """
    pages = checkpointed(pages.where("page_id IS NOT NULL").select(F.col("page_id").cast("long").alias("page_id")).distinct())
    return tree_of_ranked(pages, ranked_segments(segments.join(pages, "page_id", "left_semi")), local_nodes)


def tree_of_ranked(pages: DataFrame, ranked: DataFrame, local_nodes: int = LOCAL_NODES) -> DataFrame:
    """`prefix_tree` of distinct `pages` and segments in the form of `ranked_segments`."""
    steps = checkpointed(_prefix_digests(ranked))
    prefix = ["depth", "_a", "_b"]
    nodes = checkpointed(steps.groupBy(*prefix).agg(
        F.min("page_id").alias("node"), F.count("*").alias("n_pages"), F.max("chars").alias("chars"),
        F.sum(F.col("n_segments") - F.col("depth") + 1).alias("load"), (F.max("n_segments") == F.col("depth")).alias("_childless")))
    whole = pages.agg(F.min("page_id").alias("node"), F.count("*").alias("n_pages")).first()
    below = nodes.agg(F.count("*").alias("n"), F.sum(F.when(F.col("depth") == 1, F.col("load"))).alias("load")).first()
    root = pages.sparkSession.createDataFrame(
        [(whole.node, 0, whole.n_pages, 0, (below.load or 0) + whole.n_pages, below.n == 0, None)][:whole.n_pages],
        "node long, depth int, n_pages long, chars int, load long, _childless boolean, parent long")
    ways = steps.join(nodes.select(*prefix, "node"), prefix).select("page_id", "depth", "n_segments", "node")
    above = ways.select("page_id", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    first = F.lit(whole.node).cast("long")
    members = checkpointed(ways.join(above, ["page_id", "depth"], "left").withColumn("parent", F.when(F.col("depth") == 1, first).otherwise(F.col("parent"))))
    named = nodes.select("node", "depth", "n_pages", "chars", "load", "_childless").join(
        members.select(F.col("page_id").alias("node"), "depth", "parent"), ["node", "depth"]).unionByName(root)
    named = checkpointed(named.withColumns({"top": F.lit(0).cast("long"), "top_depth": F.lit(-1)}))
    weighed = named.select("node", "depth", "parent", "top", "top_depth", "load", F.col("_childless").cast("long").alias("leaf"),
                           ((F.col("n_pages") - 1) * F.col("chars")).alias("saved"))
    totals = subtree_totals(weighed, members, local_nodes)
    children = named.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    short = pages.join(members.where("depth = 1").select("page_id"), "page_id", "left_anti").select(first.alias("node"), F.lit(0).alias("depth"), "page_id")
    ends = members.where("depth = n_segments").select("node", "depth", "page_id").unionByName(short)
    bounds = quantile_bounds(pages, "page_id", 4 * int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    key = ["node", "depth"]
    out = named.join(totals, key).join(children, key, "left").join(_ends_digests(ends, bounds), key, "left")
    return out.select(
        F.col("node").alias("page_id"), F.col("depth").cast("long").alias("depth"), F.col("parent").alias("parent_page_id"), "n_pages",
        F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_chars", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
