"""Text operators: corpus redaction, text budgets, text shape of elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagefacts import fixed
from pagefacts.functions import markers
from pagefacts.functions.redaction import WHITE_SPACE as _SPACE
from pagefacts.functions.redaction import redaction_stages
from pagefacts.operators.intervals import enclosed_owners, subtree_aggregates
from pagefacts.operators.ranking import running_total, running_totals
from pagefacts.session import checkpointed

_TEXTS_PER_BUCKET = 32_768


def collapsed(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, _SPACE + "+", " "))


def redact_corpus(documents: DataFrame, limit: int = 160) -> DataFrame:
    """Redacted preview of every document, from its whole text, and how often each rule fired."""
    staged = redaction_stages(documents.withColumn("_text", collapsed(F.col("text"))), "_text")
    return staged.withColumns({
        "preview": F.substring("_text", 1, limit), "truncated": F.length("_text") > limit, "redacted_length": F.length("_text"),
    }).drop("_text")


def redaction_totals(redacted: DataFrame, keys: list[str]) -> DataFrame:
    counts = [f"n_{name}" for name, _, _ in fixed.PREVIEW_RULES]
    return redacted.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts], F.count_if("truncated").alias("n_truncated"))


def _bucket() -> Column:
    return F.floor(F.col("text_ix") / _TEXTS_PER_BUCKET)


def bound_text(text_nodes: DataFrame, max_nodes: int = fixed.TEXT_SCAN_NODE_LIMIT, max_chars: int = fixed.TEXT_SCAN_CHARACTER_LIMIT,
               max_steps: int = fixed.TEXT_SCAN_ANCESTOR_STEP_LIMIT) -> DataFrame:
    """Flag the text nodes of a page that lie within its scan budgets.

    All three budgets only grow along the document, so the scan stops at the first row beyond any of them.
    """
    out = running_totals(text_nodes, ["page_id"], ["text_ix"], _bucket(), {
        "_rank": F.lit(1), "_chars": F.length("data").cast("bigint"), "_steps": (2 * F.col("depth")).cast("bigint")})
    inside = (
        (F.col("_rank") + 1 <= max_nodes) & (F.col("_chars") + F.length("data") <= max_chars)
        & (F.col("_steps") + 2 * F.col("depth") <= max_steps)
    )
    return out.withColumn("limit_reached", ~inside).drop("_rank", "_chars", "_steps")


def holding_text(nodes: DataFrame, text_nodes: DataFrame) -> DataFrame:
    """`nodes` where a text counts as a child: `child_count` is 1 at least for elements that hold text themselves."""
    holds = text_nodes.select("page_id", F.col("parent_ix").alias("node_ix")).distinct().withColumn("_holds", F.lit(True))
    inner = F.when(F.col("_holds"), F.greatest(F.coalesce("child_count", F.lit(0)), F.lit(1))).otherwise(F.coalesce("child_count", F.lit(0)))
    return nodes.join(holds, ["page_id", "node_ix"], "left").withColumn("child_count", inner).drop("_holds")


def text_shape(text_nodes: DataFrame, nodes: DataFrame, max_nodes: int = fixed.TEXT_NODE_LIMIT, max_chars: int = fixed.TEXT_CHARACTER_LIMIT) -> DataFrame:
    """Node, grapheme, word and token counts of all the text below every element.

    Text below a control, code or editable element counts for nobody above it.  Each text is measured once; its numbers are summed by element and
    then over subtrees, as if the texts were joined by spaces and trimmed.  `over_limit` says that an element holds more than
    the published numbers of texts or characters.
    """
    excluded = nodes.select("page_id", "node_ix", (F.col("tag").isin(*fixed.TEXT_EXCLUDED_TAGS) | F.coalesce(markers.editable(), F.lit(False))).alias("excludes"))
    words = F.filter(F.split("data", _SPACE + "+"), lambda t: t != "")
    blank = F.size(words) == 0
    graphemes = lambda text: F.regexp_count(text, F.lit("\\X")).cast("bigint")
    measured = text_nodes.select(
        "page_id", "text_ix", F.col("parent_ix").alias("node_ix"), blank.alias("_blank"), F.size(words).cast("bigint").alias("_words"), F.array_max(F.transform(words, F.length)).alias("_longest"),
        F.length("data").cast("bigint").alias("_chars"), graphemes(F.concat(F.lit(" "), "data")).alias("_graphemes"),
        graphemes(F.concat(F.lit(" "), F.regexp_extract("data", f"^{_SPACE}*", 0))).alias("_lead"),
        graphemes(F.regexp_extract("data", f"{_SPACE}*\\z", 0)).alias("_trail"))
    barred = enclosed_owners(holding_text(nodes, text_nodes), excluded, "excludes").withColumnRenamed("owner_ix", "node_ix")
    kept = checkpointed(measured.join(barred, ["page_id", "node_ix"], "left_anti"))
    text = F.when(~F.col("_blank"), F.col("text_ix"))
    own = kept.groupBy("page_id", "node_ix").agg(
        F.count("*").alias("_n"), F.sum(F.col("_chars") + 1).alias("_all_chars"), F.sum("_words").alias("_all_words"), F.max("_longest").alias("_longest_word"),
        F.min(text).alias("_first"), F.max(text).alias("_last"))
    ends = subtree_aggregates(nodes, own, ["_n", "_all_chars", "_all_words"], ["_first"], ["_longest_word", "_last"])
    # Graphemes run from the first text that is not blank to the last: what lies outside is trimmed, like the white space at both ends.  The texts of a
    # subtree follow each other, so their sum is a difference of running totals.
    running = running_total(kept, ["page_id"], ["text_ix"], _bucket(), F.col("_graphemes"), "_before").filter("NOT _blank")
    begins = running.select("page_id", F.col("text_ix").alias("_first"), (F.col("_before") + F.col("_lead")).alias("_from"))
    stops = running.select("page_id", F.col("text_ix").alias("_last"), (F.col("_before") + F.col("_graphemes") - F.col("_trail")).alias("_to"))
    inner = ends.select("page_id", "node_ix", "_first", "_last").join(begins, ["page_id", "_first"]).join(stops, ["page_id", "_last"]).select(
        "page_id", "node_ix", (F.col("_to") - F.col("_from")).alias("_grapheme_count"))
    out = nodes.select("page_id", "node_ix", "tag", markers.editable().alias("_editable")).join(ends, ["page_id", "node_ix"], "left").join(
        inner, ["page_id", "node_ix"], "left")
    empty = F.col("_first").isNull()
    out = out.withColumn("status", F.when(F.col("tag").isin(*fixed.CONTROL_TAGS), "EXCLUDED_SENSITIVE_CONTROL")
                         .when(F.col("_editable"), "EXCLUDED_CONTENTEDITABLE").when(F.col("tag").isin(*fixed.CODE_TAGS) | empty, "NO_TEXT").otherwise("MEASURED"))
    known = F.col("status") == "MEASURED"
    return out.select(
        "page_id", "node_ix", "status",
        F.when(known, "AVAILABLE").when(F.col("status") == "NO_TEXT", "NOT_APPLICABLE").otherwise("INSUFFICIENT").alias("availability"),
        F.when(known, F.col("_n")).otherwise(0).alias("text_node_count"), F.when(known, F.col("_all_words")).cast("int").alias("word_count"),
        F.when(known, F.col("_grapheme_count")).cast("int").alias("grapheme_count"), F.when(known, F.col("_longest_word")).alias("longest_token"),
        F.when(known, (F.col("_n") > max_nodes) | (F.col("_all_chars") - 1 > max_chars)).otherwise(False).alias("over_limit"))
