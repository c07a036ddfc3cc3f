"""Ordinals and running totals that hold when one group has a third of all rows.

A plain window puts a whole group into one task.  Here the order column is cut into buckets: totals per
(group, bucket) are pre-aggregated and summed over the few buckets, and only rows of one bucket meet in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagefacts.session import checkpointed

NODES_PER_BUCKET = 32_768
#: A group of up to this many rows is sorted as a whole by `small_group_total`.
ROWS_OF_SMALL_GROUP = 32_768


def node_bucket(column: str = "node_ix") -> Column:
    return F.floor(F.col(column) / NODES_PER_BUCKET)


def join_page_facts(rows: DataFrame, facts: DataFrame, nodes: DataFrame, how: str = "inner") -> DataFrame:
    """`rows` (page_id, node_ix, …) with the columns of `facts`, which has one row per page.

    Where Spark does not broadcast the facts, they are copied to every bucket of the page's `nodes`, so the rows of a page with a third of all
    nodes are shuffled by (page_id, bucket) and meet in many tasks.
    """
    copies = nodes.select("page_id", node_bucket().alias("_bucket")).distinct().join(facts, "page_id")
    return rows.withColumn("_bucket", node_bucket()).join(copies, ["page_id", "_bucket"], how).drop("_bucket")


def running_totals(
    frame: DataFrame, keys: list[str], order: list[str | Column], bucket: Column, values: dict[str, Column], totals_of: dict[str, str] | None = None
) -> DataFrame:
    """Add each name of `values`: the sum of its value over the earlier rows of the group.

    `totals_of` names columns that get the sum over the whole group.  `keys` must not be null and `bucket` must
    never fall while `order` rises.
    """
    before = (Window.unboundedPreceding, -1)
    staged = frame.withColumns({"_bucket": bucket, **{f"_value_{n}": v for n, v in values.items()}})
    totals = staged.groupBy(*keys, "_bucket").agg(*[F.sum(f"_value_{n}").alias(f"_total_{n}") for n in values])
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(*before)
    offsets = totals.select(
        *keys, "_bucket", *[F.coalesce(F.sum(f"_total_{n}").over(earlier), F.lit(0)).alias(f"_offset_{n}") for n in values],
        *[F.sum(f"_total_{n}").over(Window.partitionBy(*keys)).alias(whole) for n, whole in (totals_of or {}).items()])
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(*before)
    out = staged.join(offsets, [*keys, "_bucket"]).withColumns(
        {n: F.col(f"_offset_{n}") + F.coalesce(F.sum(f"_value_{n}").over(inside), F.lit(0)) for n in values})
    return out.drop("_bucket", *[f"_value_{n}" for n in values], *[f"_offset_{n}" for n in values])


def running_total(frame: DataFrame, keys: list[str], order: list[str | Column], bucket: Column, value: Column, name: str,
                  total: str | None = None) -> DataFrame:
    """Add `name`: the sum of `value` over the earlier rows of the group; and `total`, the sum over all of them."""
    return running_totals(frame, keys, order, bucket, {name: value}, None if total is None else {name: total})


def small_group_total(frame: DataFrame, key: str, order: list[str | Column], bucket: Column, value: Column, name: str,
                      limit: int = ROWS_OF_SMALL_GROUP) -> DataFrame:
    """`running_total` over very many groups, most of them small: these are sorted as a whole, after one shuffle; groups above `limit` rows take buckets.

    As there, rows without key are left out, and rows without bucket too, once they have counted as the first of their group.
    """
    rows = frame.filter(F.col(key).isNotNull()).withColumn("_placed", bucket.isNotNull())
    crowded = checkpointed(rows.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > limit).select(key))
    earlier = Window.partitionBy(key).orderBy("_placed", *order).rowsBetween(Window.unboundedPreceding, -1)
    total = F.coalesce(F.sum(value).over(earlier), F.lit(0))
    none_crowded = crowded.isEmpty()
    small = (rows if none_crowded else rows.join(crowded, key, "left_anti")).withColumn(name, total).filter("_placed").drop("_placed")
    if none_crowded:
        return small
    return small.unionByName(running_total(rows.drop("_placed").join(crowded, key, "left_semi"), [key], order, bucket, value, name))


def ordinal(frame: DataFrame, keys: list[str], order: list[str | Column], bucket: Column, name: str) -> DataFrame:
    """Add `name`: the zero-based position of the row in its group."""
    return running_total(frame, keys, order, bucket, F.lit(1), name).withColumn(name, F.col(name).cast("int"))


def running_max(frame: DataFrame, keys: list[str], order: list[str | Column], bucket: Column, value: Column, name: str) -> DataFrame:
    """Add `name`: the largest `value` (nulls aside) over the rows of the group up to and with this one; `keys` and `bucket` as in `running_totals`."""
    staged = frame.withColumns({"_bucket": bucket, "_value": value})
    largest = staged.groupBy(*keys, "_bucket").agg(F.max("_value").alias("_largest"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = largest.select(*keys, "_bucket", F.max("_largest").over(earlier).alias("_offset")).filter("_offset IS NOT NULL")
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = staged.withColumn("_inside", F.max("_value").over(inside)).join(offsets, [*keys, "_bucket"], "left")
    return out.withColumn(name, F.greatest("_inside", "_offset")).drop("_bucket", "_value", "_inside", "_offset")
