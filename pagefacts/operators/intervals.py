"""Ancestor facts from nested intervals.

A node is the interval from its own pre-order number to that of the last node below it (`subtree_end`), so its ancestors are the intervals that
enclose it, and no node carries a path.  For a predicate p, the nodes that satisfy it open at their number and close at their end; running counts of
both tell at how many levels of p a node lies.  The nearest enclosing node at level L is the last one that opened at that level: those that opened
since lie within it or deeper.  So two running windows over the nodes in order, cut into buckets, find every nearest ancestor in linear work, whether a
tree is flat or one chain.

Only nodes with children are looked at; siblings share what is above them and get it by their parent.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagefacts.operators.ranking import node_bucket, running_max, running_totals
from pagefacts.session import checkpointed


def _levels(nodes: DataFrame, facts: DataFrame, names: tuple[str, ...], carried: list[str]) -> DataFrame:
    """Nodes with children, each with `_is_<name>` (0 or 1) and `_level_<name>`: how many nodes above it satisfy the predicate."""
    holders = facts.filter(F.greatest(*[F.col(n) for n in names], F.lit(False))).select("page_id", "node_ix", *names, *carried)
    inner = nodes.filter("child_count > 0").select("page_id", "node_ix", "subtree_end", "depth").join(holders, ["page_id", "node_ix"], "left")
    inner = inner.withColumns({f"_is_{n}": F.coalesce(F.col(n), F.lit(False)).cast("int") for n in names}).drop(*names)
    held = F.greatest(*[F.col(f"_is_{n}") for n in names], F.lit(0)) == 1
    turn = lambda at, close: F.struct(F.col(at).alias("at"), F.lit(close).alias("close"))
    events = inner.withColumn("_turn", F.explode(F.when(held, F.array(turn("node_ix", 0), turn("subtree_end", 1))).otherwise(F.array(turn("node_ix", 0)))))
    sign = F.when(F.col("_turn.close") == 0, 1).otherwise(-1)
    counted = running_totals(events, ["page_id"], ["_turn.at", "_turn.close"], node_bucket("_turn.at"),
                             {f"_level_{n}": sign * F.col(f"_is_{n}") for n in names})
    return counted.filter("_turn.close = 0").drop("_turn", "subtree_end")


def _last_at_level(rows: DataFrame) -> DataFrame:
    """`rows`: page_id, _name, _level, node_ix and `_offer` (a struct that starts with node_ix, or null).  Adds `_best`: the last offer so far."""
    return running_max(rows, ["page_id", "_name", "_level"], ["node_ix"], node_bucket(), F.col("_offer"), "_best")


def enclosing(nodes: DataFrame, facts: DataFrame, *names: str, payload: str | None = None) -> DataFrame:
    """(page_id, owner_ix, _best_<name> …) for nodes with children: the nearest node that satisfies the predicate, the owner itself included.

    `facts` has page_id, node_ix and one boolean column per name.  `_best_<name>` is a struct of node_ix, depth and the `payload` column of `facts`.
    """
    carried = [] if payload is None else [payload]
    levelled = _levels(nodes, facts, names, carried)
    offer = F.struct("node_ix", "depth", *carried)
    one = lambda n: F.struct(
        F.lit(n).alias("_name"), (F.col(f"_level_{n}") + F.col(f"_is_{n}")).alias("_level"), F.when(F.col(f"_is_{n}") == 1, offer).alias("_offer"))
    rows = levelled.select("page_id", "node_ix", F.explode(F.filter(F.array(*map(one, names)), lambda r: r["_level"] > 0)).alias("_row"))
    best = _last_at_level(rows.select("page_id", "node_ix", "_row.*"))
    return best.groupBy("page_id", F.col("node_ix").alias("owner_ix")).agg(
        *[F.max(F.when(F.col("_name") == n, F.col("_best"))).alias(f"_best_{n}") for n in names])


def enclosed_owners(nodes: DataFrame, facts: DataFrame, name: str) -> DataFrame:
    """(page_id, owner_ix) of nodes with children that satisfy the predicate or lie below one that does."""
    levelled = _levels(nodes, facts, (name,), [])
    return levelled.filter(F.col(f"_level_{name}") + F.col(f"_is_{name}") > 0).select("page_id", F.col("node_ix").alias("owner_ix"))


def enclosing_extremes(nodes: DataFrame, facts: DataFrame, name: str, largest: list[str], smallest: list[str]) -> DataFrame:
    """(page_id, owner_ix, …): extremes of columns of `facts` over all nodes that satisfy the predicate, from the owner up.

    The extremes of a satisfying node include those of the next one above it; following that link twice as far in each round
    takes as many rounds as the logarithm of the deepest level.
    """
    values = [*largest, *smallest]
    levelled = _levels(nodes, facts, (name,), values)
    level, is_one = F.col(f"_level_{name}"), F.col(f"_is_{name}") == 1
    offer = F.struct("node_ix")
    places = F.filter(F.array(
        F.struct(F.lit("own").alias("_name"), (level + F.col(f"_is_{name}")).alias("_level")),
        F.when(is_one, F.struct(F.lit("above").alias("_name"), level.alias("_level")))), lambda p: p.isNotNull() & (p["_level"] > 0))
    rows = levelled.withColumn("_place", F.explode(places)).select(
        "page_id", "node_ix", F.lit("").alias("_name"), F.col("_place._level").alias("_level"), F.col("_place._name").alias("_asks"),
        F.when(is_one & (F.col("_place._name") == "own"), offer).alias("_offer"))
    found = checkpointed(_last_at_level(rows).select("page_id", "node_ix", "_asks", "_level", F.col("_best.node_ix").alias("_at")))
    above = found.filter("_asks = 'above'").select("page_id", "node_ix", F.col("_at").alias("_up"))
    chain = checkpointed(levelled.filter(is_one).select("page_id", "node_ix", *values).join(above, ["page_id", "node_ix"], "left"))
    deepest = found.filter("_asks = 'own'").agg(F.max("_level")).first()[0] or 1
    for _ in range(math.ceil(math.log2(deepest))):
        higher = chain.select("page_id", F.col("node_ix").alias("_up"), F.col("_up").alias("_next"), *[F.col(v).alias(f"_{v}") for v in values])
        joined = chain.join(higher, ["page_id", "_up"], "left")
        chain = checkpointed(joined.select("page_id", "node_ix", F.col("_next").alias("_up"), *[F.greatest(v, f"_{v}").alias(v) for v in largest],
                                           *[F.least(v, f"_{v}").alias(v) for v in smallest]))
    owners = found.filter("_asks = 'own'").select("page_id", F.col("node_ix").alias("owner_ix"), F.col("_at").alias("node_ix"))
    return owners.join(chain.drop("_up"), ["page_id", "node_ix"]).drop("node_ix")


def subtree_aggregates(nodes: DataFrame, values: DataFrame, sums: list[str], smallest: list[str] = (), largest: list[str] = ()) -> DataFrame:
    """(page_id, node_ix, …): sums and extremes of the columns of `values` over each subtree; nodes with nothing below them are absent.

    `values` has one row per page_id, node_ix.  After round k a node holds what lies less than 2^k levels below it; the next round adds, grouped by the
    ancestor 2^k levels up, what those nodes hold.
    """
    ways = {**dict.fromkeys(sums, F.sum), **dict.fromkeys(smallest, F.min), **dict.fromkeys(largest, F.max)}
    inner = nodes.select("page_id", "node_ix", F.col("parent_ix").alias("_up"))
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    held, links = values.select("page_id", "node_ix", *ways), checkpointed(inner)
    for k in range(math.ceil(math.log2(deepest + 1)) if deepest else 0):
        sent = held.join(links.filter("_up IS NOT NULL"), ["page_id", "node_ix"]).select("page_id", F.col("_up").alias("node_ix"), *ways)
        held = checkpointed(held.unionByName(sent).groupBy("page_id", "node_ix").agg(*[way(c).alias(c) for c, way in ways.items()]))
        if 2 ** (k + 1) <= deepest:
            higher = links.select("page_id", F.col("node_ix").alias("_up"), F.col("_up").alias("_next"))
            links = checkpointed(links.filter("_up IS NOT NULL").join(higher, ["page_id", "_up"]).select("page_id", "node_ix", F.col("_next").alias("_up")))
    return held


def joined_paths(steps: DataFrame, separator: str) -> DataFrame:
    """(page_id, node_ix, path): the `step` of each node behind those above it, up to and with the first one that is `last`, else to the root.

    `steps`: page_id, node_ix, parent_ix, depth, step, last.  Each round puts the text of the node the last one ended under in front, so texts double
    and the rounds are the logarithm of the depth.
    """
    state = checkpointed(steps.select("page_id", "node_ix", F.when(~F.col("last"), F.col("parent_ix")).alias("_up"), F.col("step").alias("path"), "depth"))
    deepest = state.filter("_up IS NOT NULL").agg(F.max("depth")).first()[0]
    for _ in range(math.ceil(math.log2(deepest + 1)) if deepest else 0):
        higher = state.select("page_id", F.col("node_ix").alias("_up"), F.col("_up").alias("_next"), F.col("path").alias("_above"))
        state = checkpointed(state.join(higher, ["page_id", "_up"], "left").select(
            "page_id", "node_ix", F.col("_next").alias("_up"), F.concat_ws(separator, "_above", "path").alias("path"), "depth"))
    return state.select("page_id", "node_ix", "path")


def with_nearest(nodes: DataFrame, found: DataFrame, names: tuple[str, ...], carried: list[str]) -> DataFrame:
    """`nodes` with what `enclosing` found for their parents: `nearest_<name>`, `nearest_<name>_dist`, and the payload."""
    out = nodes.join(found.withColumnRenamed("owner_ix", "parent_ix"), ["page_id", "parent_ix"], "left")
    at: dict[str, Column] = {}
    for n in names:
        at |= {f"nearest_{n}": F.col(f"_best_{n}.node_ix"), f"nearest_{n}_dist": F.col("depth") - F.col(f"_best_{n}.depth"),
               **{f"nearest_{n}_{c}": F.col(f"_best_{n}.{c}") for c in carried}}
    return out.withColumns(at).drop(*[f"_best_{n}" for n in names])
