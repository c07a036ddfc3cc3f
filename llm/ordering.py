"""Each row's successor in the order of a key, without one task that sees all rows.

The key's range is cut at quantiles.  A row whose key opens a range is also a guest at the end of the range before, and the rows with the
lowest key are guests behind the last row: the order is a ring.  Then a window within each range sees every successor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from llm.common import quantile_bounds, range_of


def ring(rows: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """`rows` with `ring_range` and `ring_turn` (0: the row itself, 1: a guest), guests added; drop them with `ring_turn = 0`.

    A row without key is in range 0, where `ring_window` must not be trusted: it has no successor.
    """
    spark = rows.sparkSession
    bounds = quantile_bounds(rows, key, parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    if not bounds:
        return rows.withColumns({"ring_range": F.lit(0), "ring_turn": F.lit(0)})
    here = range_of(key, bounds)
    at = lambda place, turn: F.struct(place.cast("int").alias("ring_range"), F.lit(turn).alias("ring_turn"))
    places = F.when(F.col(key) == F.lit(bounds[0]), F.array(at(here, 0), at(F.lit(len(bounds)), 1)))
    if len(bounds) > 1:
        places = places.when(F.col(key).isin(bounds[1:]), F.array(at(here, 0), at(here - 1, 1)))
    return rows.withColumn("ring_place", F.explode(places.otherwise(F.array(at(here, 0))))).select(
        *rows.columns, "ring_place.ring_range", "ring_place.ring_turn")


def ring_window(*order: str) -> WindowSpec:
    return Window.partitionBy("ring_range").orderBy("ring_turn", *order)
