"""Marker, role and region rules over a node row (columns tag, attrs, class_tokens)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagefacts import fixed
from pagefacts.functions.patterns import compact, matches
from pagefacts.functions.redaction import name_token, stable_id

TAG = F.col  # readable alias in the expressions below


def attr(name: str) -> Column:
    return F.col("attrs")[name]


def has_attr(name: str) -> Column:
    return F.map_contains_key("attrs", name)


def class_marker() -> Column:
    first, second = fixed.MARKER_CLASS_PREFIXES
    return F.exists("class_tokens", lambda t: F.startswith(t, F.lit(first)) | F.startswith(t, F.lit(second)))


def page_marker() -> Column:
    return stable_id(attr(fixed.PAGE_ID_ATTRIBUTE))


def data_id() -> Column:
    return stable_id(attr(fixed.ELEMENT_ID_ATTRIBUTE))


def marker_matched() -> Column:
    return page_marker().isNotNull() | class_marker()


def marker_reasons() -> Column:
    return compact(
        F.when(page_marker().isNotNull(), "DATA_ELEMENTOR_ID"),
        F.when(data_id().isNotNull() & class_marker(), "DATA_ID_WITH_ELEMENTOR_CLASS"),
        F.when(class_marker(), "ELEMENTOR_CLASS"),
    )


def widget_markers() -> Column:
    """All of them, sorted."""
    found = F.filter("class_tokens", lambda t: matches(t, fixed.WIDGET_MARKER))
    return F.array_sort(found)


def structure_markers() -> Column:
    return F.array_sort(F.filter("class_tokens", lambda t: t.isin(*fixed.STRUCTURE_CLASSES)))


def interactive() -> Column:
    return F.coalesce(
        ((F.col("tag") == "a") & has_attr("href"))
        | F.col("tag").isin(*fixed.INTERACTIVE_TAGS)
        | F.coalesce(attr("role").isin(*fixed.INTERACTIVE_ROLES), F.lit(False))
        | has_attr("tabindex"),
        F.lit(False),
    )


def landmark_role() -> Column:
    explicit = name_token(attr("role"))
    implicit = F.coalesce(*[F.when(F.col("tag") == tag, role) for tag, role in fixed.LANDMARK_TAGS])
    return F.coalesce(F.when(explicit.isin(*fixed.LANDMARK_ROLES), explicit), implicit)


def region_kind() -> Column:
    has = lambda names: F.arrays_overlap("class_tokens", F.array(*[F.lit(n) for n in names]))
    return (
        F.when(has(fixed.SECTION_CLASSES), "ELEMENTOR_SECTION")
        .when(has(fixed.CONTAINER_CLASSES), "ELEMENTOR_CONTAINER")
        .when(has(fixed.ATOMIC_CLASSES), "ATOMIC_CONTAINER")
        .when(landmark_role().isNotNull(), "HTML_LANDMARK")
        .when(F.col("tag").isin("section", "article"), "HTML_SECTION")
    )


def boolean_attr(name: str) -> Column:
    return F.when(F.lower(attr(name)) == "true", True).when(F.lower(attr(name)) == "false", False)


def editable() -> Column:
    return F.coalesce(F.lower(attr("contenteditable")) != "false", F.lit(False))


def css_identifier(value: Column) -> Column:
    """Identifier with unsafe characters and a leading digit written as code points."""

    def one(char: Column, index: Column) -> Column:
        safe = matches(char, "^[A-Za-z0-9_-]$") & ~((index == 0) & matches(char, "^[0-9]$"))
        return F.when(safe, char).otherwise(F.concat(F.lit("\\"), F.lower(F.hex(F.ascii(char))), F.lit(" ")))

    return F.array_join(F.transform(F.split(value, ""), one), "")


def css_attribute(value: Column) -> Column:
    return F.regexp_replace(value, r'(["\\])', r"\\$1")
