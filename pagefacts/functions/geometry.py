"""Box arithmetic: six decimals, half rounds up, non-finite input gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("x", "y", "top", "right", "bottom", "left", "width", "height")


def is_finite(value: Column) -> Column:
    limit = F.lit(1.7976931348623157e308)
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) <= limit)


def six_decimals(value: Column) -> Column:
    rounded = F.floor(value * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)
    big = F.abs(value) >= F.lit(9.0e12)
    return F.when(big, value).otherwise(rounded)


def rect_finite(rect: Column) -> Column:
    ok = is_finite(rect["x"])
    for side in SIDES[1:]:
        ok = ok & is_finite(rect[side])
    return F.coalesce(ok, F.lit(False))


def normal_rect(rect: Column) -> Column:
    return F.struct(*[six_decimals(rect[side]).alias(side) for side in SIDES])


def area(rect: Column) -> Column:
    return six_decimals(F.greatest(F.lit(0.0), rect["width"] * rect["height"]))


def intersection(rect: Column, width: Column, height: Column) -> Column:
    left, top = F.greatest(F.lit(0.0), rect["left"]), F.greatest(F.lit(0.0), rect["top"])
    right, bottom = F.least(width, rect["right"]), F.least(height, rect["bottom"])
    across = six_decimals(F.greatest(F.lit(0.0), six_decimals(right) - six_decimals(left)))
    down = six_decimals(F.greatest(F.lit(0.0), six_decimals(bottom) - six_decimals(top)))
    whole = area(rect)
    share = F.when(whole == 0, 0.0).otherwise(six_decimals(F.least(F.lit(1.0), six_decimals(across * down) / whole)))
    return F.struct(
        ((across > 0) & (down > 0)).alias("intersects"), share.alias("ratio"),
        F.struct(six_decimals(left).alias("x"), six_decimals(top).alias("y"), six_decimals(top).alias("top"),
                 six_decimals(right).alias("right"), six_decimals(bottom).alias("bottom"),
                 six_decimals(left).alias("left"), across.alias("width"), down.alias("height")).alias("rect"),
    )


def style(name: str) -> Column:
    return F.col("styles")[name]


def hides_subtree() -> Column:
    """Hidden in a way no descendant can undo."""
    opacity = F.regexp_extract(style("opacity"), r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1)
    return (
        F.coalesce(style("display") == "none", F.lit(False))
        | F.coalesce(style("content-visibility") == "hidden", F.lit(False))
        | F.coalesce(opacity.try_cast("double") <= 0, F.lit(False))
    )


def hides_element() -> Column:
    return F.coalesce(style("visibility").isin("hidden", "collapse"), F.lit(False)) | hides_subtree()


def _any_axis(*values: str) -> Column:
    return F.coalesce(style("overflow-x").isin(*values), F.lit(False)) | F.coalesce(
        style("overflow-y").isin(*values), F.lit(False))


def scrolls() -> Column:
    return _any_axis("auto", "scroll")


def clips() -> Column:
    return _any_axis("hidden", "clip", "scroll", "auto")


def positioned() -> Column:
    return F.coalesce(style("position") != "static", F.lit(False))


def position_kind() -> Column:
    known = style("position").isin("static", "relative", "absolute", "fixed", "sticky")
    return F.when(known, style("position")).otherwise("other")
