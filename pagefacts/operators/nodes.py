"""Row-wise facts of nodes.  All of these are projections: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagefacts import fixed
from pagefacts.functions import geometry, markers
from pagefacts.functions.patterns import matches
from pagefacts.functions.redaction import class_tokens as safe_tokens
from pagefacts.functions.redaction import name_token, plain_label, stable_id


def stable_ids(nodes: DataFrame, column: str | Column) -> DataFrame:
    return nodes.withColumn("stable_id", stable_id(F.col(column) if isinstance(column, str) else column))


def class_tokens(nodes: DataFrame, mode: str = "STRICT") -> DataFrame:
    return nodes.withColumn("class_tokens_safe", safe_tokens(F.col("class_tokens"), mode))


def node_markers(nodes: DataFrame) -> DataFrame:
    return nodes.withColumns({
        "page_marker": markers.page_marker(),
        "data_id": markers.data_id(),
        "class_marker": markers.class_marker(),
        "matched": markers.marker_matched(),
        "reasons": markers.marker_reasons(),
        "widget": markers.widget_markers(),
        "structure": markers.structure_markers(),
    })


def interactive_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("interactive", markers.interactive())


def interaction_facts(nodes: DataFrame, enabled: Column | bool = True) -> DataFrame:
    kind = F.coalesce(*[F.when(F.col("tag") == tag, value) for tag, value in fixed.NATIVE_KINDS])
    input_type = F.coalesce(F.when(F.coalesce(markers.attr("type"), F.lit("")) == "", "text"), markers.attr("type"))
    interaction = F.struct(
        F.when(enabled if isinstance(enabled, Column) else F.lit(enabled), "AVAILABLE").otherwise("DISABLED").alias("availability"),
        F.col("tag").alias("tag_name"),
        name_token(markers.attr("role")).alias("role"),
        kind.alias("native_interactive_kind"),
        (F.col("tag").isin(*fixed.DISABLEABLE_TAGS) & markers.has_attr("disabled")).alias("disabled"),
        markers.boolean_attr("aria-disabled").alias("aria_disabled"),
        markers.boolean_attr("aria-expanded").alias("aria_expanded"),
        markers.has_attr("aria-controls").alias("aria_controls_present"),
        (F.col("tag").isin("a", "area") & markers.has_attr("href")).alias("href_present"),
        F.when(F.col("tag") == "input", name_token(input_type, fixed.INPUT_TYPE_TOKEN)).alias("input_type"),
        markers.editable().alias("contenteditable"),
    )
    return nodes.withColumn("interaction", interaction)


def regions(nodes: DataFrame, mode: str = "STANDARD", editor_label: Column | None = None) -> DataFrame:
    """Regions of a page with role and label; labels are taken from the first source that has one."""
    found = nodes.withColumns({
        "region_kind": markers.region_kind(), "role": markers.landmark_role(), "_structure": markers.structure_markers(),
        "_id": F.lit(None).cast("string") if mode == "STRICT" else stable_id(markers.attr("id")),
        "_editor": editor_label if editor_label is not None else F.lit(None).cast("string"),
    }).filter("region_kind IS NOT NULL")
    technical = F.try_element_at("_structure", F.lit(1))
    label = F.coalesce(F.substring("_editor", 1, fixed.MAX_LABEL_LENGTH), F.col("_id"),
                       F.concat("tag", F.lit(":"), "role"), technical)
    source = (
        F.when(F.col("_editor").isNotNull(), "ELEMENTOR_EDITOR_LABEL").when(F.col("_id").isNotNull(), "HTML_ID")
        .when(F.col("role").isNotNull(), "LANDMARK_TAG").when(technical.isNotNull(), "TECHNICAL_MARKER").otherwise("NONE")
    )
    return found.withColumns({"label": label, "label_source": source}).drop("_structure", "_id", "_editor")


def sanitize_labels(frame: DataFrame, title: str = "title", role: str = "role") -> DataFrame:
    return frame.withColumns({"title": plain_label(F.col(title)), "role": name_token(F.col(role))})


def gate_modules(elements: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """Availability per module: DISABLED where its flag is off, else what was recorded."""
    return elements.withColumns({
        f"{module}_availability": F.when(flag, F.col(f"{module}_availability")).otherwise("DISABLED")
        for module, flag in flags.items()
    })


# --- recorded boxes and styles -------------------------------------------------------------------


def normalize_rects(layout: DataFrame) -> DataFrame:
    """Layout rows whose eight sides are finite, rounded."""
    return layout.filter(geometry.rect_finite(F.col("rect"))).withColumn("rect", geometry.normal_rect(F.col("rect")))


def rect_rejects(layout: DataFrame) -> DataFrame:
    """The rows `normalize_rects` leaves out, as diagnostics."""
    return layout.filter(~geometry.rect_finite(F.col("rect"))).select(
        "page_id", "node_ix", F.lit("NON_FINITE_GEOMETRY").alias("code"), F.lit("WARNING").alias("severity"))


def viewport_intersection(layout: DataFrame, width: Column, height: Column,
                          scroll_x: Column | None = None, scroll_y: Column | None = None) -> DataFrame:
    rect = F.col("rect")
    zero = F.lit(0.0)
    return layout.withColumn("viewport", geometry.intersection(rect, width, height)).withColumns({
        "intersects": F.col("viewport.intersects"), "ratio": F.col("viewport.ratio"), "area": geometry.area(rect),
        "document_x": geometry.six_decimals(rect["x"] + (zero if scroll_x is None else scroll_x)),
        "document_y": geometry.six_decimals(rect["y"] + (zero if scroll_y is None else scroll_y)),
    })


def overflow_flags(layout: DataFrame) -> DataFrame:
    horizontal = F.col("scroll_w") > F.col("client_w") + 1
    vertical = F.col("scroll_h") > F.col("client_h") + 1
    return layout.withColumns({
        "h_overflow": horizontal, "v_overflow": vertical,
        "h_clip": horizontal & F.coalesce(geometry.style("overflow-x").isin("hidden", "clip"), F.lit(False)),
        "v_clip": vertical & F.coalesce(geometry.style("overflow-y").isin("hidden", "clip"), F.lit(False)),
    })


def style_facts(layout: DataFrame, include_colors: bool = False) -> DataFrame:
    """Allow-listed styles with omissions counted, and the predicates derived from styles."""
    names = fixed.BASE_STYLES + (fixed.COLOR_STYLES if include_colors else ())
    allowed = F.map_filter("styles", lambda k, _: k.isin(*names))
    trimmed = F.transform_values(allowed, lambda _, v: F.trim(v))
    return layout.withColumns({
        "hidden": geometry.hides_element(), "hides_subtree": geometry.hides_subtree(), "scrolls": geometry.scrolls(),
        "clips": geometry.clips(), "position": geometry.position_kind(), "_trimmed": trimmed,
    }).withColumns({
        "styles": F.map_filter("_trimmed", lambda _, v: F.length(v) <= fixed.MAX_STYLE_VALUE_LENGTH),
        "omitted": F.size(F.map_filter("_trimmed", lambda _, v: F.length(v) > fixed.MAX_STYLE_VALUE_LENGTH)),
    }).drop("_trimmed")


def capped_lists(nodes: DataFrame) -> DataFrame:
    """Frontend markers of the root, cut to their published number."""
    first, second = fixed.MARKER_CLASS_PREFIXES
    kept = F.filter("class_tokens", lambda t: F.startswith(t, F.lit(first)) | F.startswith(t, F.lit(second)))
    return nodes.withColumns({
        "frontend_markers": F.slice(safe_tokens(kept, "STANDARD"), 1, fixed.MAX_FRONTEND_MARKERS),
        "widget_markers": markers.widget_markers(),
    })


def reference_ok(column: Column) -> Column:
    return matches(column, fixed.DIGEST)
