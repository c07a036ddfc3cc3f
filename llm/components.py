"""Connected components of a link table, by alternating large-star and small-star steps.

Every step is a grouped minimum (with partial sums on the map side) and a join back, so a component with a third of all nodes is
never gathered: its links are rows of a join that Spark may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import checkpointed


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("low").alias("high"), F.col("high").alias("low")))
    lowest = both.groupBy("high").agg(F.least(F.col("high"), F.min("low")).alias("hub"))
    return (both.join(lowest, "high").where("low > high").select(F.col("low").alias("high"), F.col("hub").alias("low"))
            .where("high <> low").distinct())


def _small_star(links: DataFrame) -> DataFrame:
    lowest = links.groupBy("high").agg(F.min("low").alias("hub"))
    moved = links.join(lowest, "high").where("low <> hub").select(F.col("low").alias("high"), F.col("hub").alias("low"))
    return moved.unionByName(lowest.select("high", F.col("hub").alias("low"))).distinct()


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("high", "low")), F.count_distinct("low")).first())


def components(links: DataFrame, left: str = "left", right: str = "right") -> DataFrame:
    """`links`: two columns of node ids.  Returns `node`, `component`: the smallest node reachable, for each node with a link.

    Null ends and loops are ignored; repeated and reversed links count once; no links give no rows.
    """
    state = (links.select(F.greatest(left, right).alias("high"), F.least(left, right).alias("low"))
             .where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right))).distinct())
    state = checkpointed(state)
    before, now = None, _mark(state)
    while now != before:
        state = checkpointed(_small_star(_large_star(state)))
        before, now = now, _mark(state)
    hubs = state.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct()
    return state.select(F.col("high").alias("node"), F.col("low").alias("component")).unionByName(hubs)
