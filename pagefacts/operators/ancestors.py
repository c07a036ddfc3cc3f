"""Nearest-ancestor facts, by nested intervals (see `intervals`).

Searches go up to the root; distances come along, so a published limit is a comparison with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagefacts.functions import geometry
from pagefacts.operators.intervals import enclosing, enclosing_extremes, with_nearest


def nearest(nodes: DataFrame, facts: DataFrame, *names: str, payload: str | None = None) -> DataFrame:
    """Add `nearest_<name>` and `nearest_<name>_dist` for the boolean columns `names` of `facts`.

    `facts` has page_id, node_ix and one boolean column per name.  A `payload` column of `facts` comes along as
    `nearest_<name>_<payload>`, which saves a join on the ancestor found.
    """
    return with_nearest(nodes, enclosing(nodes, facts, *names, payload=payload), names, [] if payload is None else [payload])


def nearest_ancestors(measured: DataFrame) -> DataFrame:
    """Nearest hidden, positioned, scrolling and clipping ancestor, and effective visibility."""
    facts = measured.select(
        "page_id", "node_ix", geometry.hides_subtree().alias("hidden"), geometry.positioned().alias("positioned"),
        geometry.scrolls().alias("scroll"), geometry.clips().alias("clipping"))
    out = nearest(measured, facts, "hidden", "positioned", "scroll", "clipping")
    return out.withColumns({
        "direct_hidden": geometry.hides_element(),
        "visible": ~geometry.hides_element() & F.col("nearest_hidden").isNull(),
    })


def clipped_by_ancestor(measured: DataFrame) -> DataFrame:
    """Whether a box leaves one of its clipping ancestors by more than half a pixel.

    The boxes above a parent reduce to one bound per side, so no pair of boxes is ever formed.
    """
    def side(name: str) -> Column:
        return F.when(~F.isnan(F.col("rect")[name]), F.col("rect")[name])

    facts = measured.select("page_id", "node_ix", geometry.clips().alias("clipping"), *[side(n).alias(f"_{n}") for n in ("left", "top", "right", "bottom")])
    bounds = enclosing_extremes(measured, facts, "clipping", ["_left", "_top"], ["_right", "_bottom"]).withColumnRenamed("owner_ix", "parent_ix")
    out = measured.join(bounds, ["page_id", "parent_ix"], "left")
    rect = F.col("rect")
    beyond = (
        (rect["left"] < F.col("_left") - 0.5) | (rect["right"] > F.col("_right") + 0.5)
        | (rect["top"] < F.col("_top") - 0.5) | (rect["bottom"] > F.col("_bottom") + 0.5)
    )
    return out.withColumn("clipped", F.coalesce(beyond, F.lit(False))).drop("_left", "_top", "_right", "_bottom")


def visible_in_viewport(measured: DataFrame, width: Column, height: Column) -> DataFrame:
    rect = F.col("rect")
    box = (
        (rect["width"] > 0) & (rect["height"] > 0) & (rect["bottom"] > 0) & (rect["right"] > 0)
        & (rect["top"] < height) & (rect["left"] < width) & geometry.rect_finite(rect)
    )
    return nearest_ancestors(measured).withColumn("in_viewport", F.col("visible") & box)


def emitted_parents(nodes: DataFrame, emitted: DataFrame) -> DataFrame:
    """Nearest emitted ancestor of every node.  `emitted` has page_id, node_ix, node_id.

    Its id is looked up for the parents, which are few, and not for each of their children.
    """
    facts = emitted.select("page_id", "node_ix", F.lit(True).alias("emitted"))
    parent = emitted.select("page_id", F.col("node_ix").alias("_above"), F.col("node_id").alias("parent_node_id"))
    found = enclosing(nodes, facts, "emitted").withColumn("_above", F.col("_best_emitted.node_ix")).join(parent, ["page_id", "_above"], "left").drop("_above")
    return with_nearest(nodes, found, ("emitted",), []).withColumn("parent_emitted", F.coalesce(F.col("nearest_emitted_dist") == 1, F.lit(False)))


def parent_regions(regions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nearest ancestor region of every region."""
    facts = regions.select("page_id", "node_ix", F.lit(True).alias("region"))
    linked = nearest(nodes, facts, "region")
    return regions.join(
        linked.select("page_id", "node_ix", F.col("nearest_region").alias("parent_region")), ["page_id", "node_ix"])
