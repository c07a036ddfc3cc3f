"""Mixing hosts to target weights by temperature, and the mixture as block permutations.

Token shares are raised to an exponent from 1 (as they are) down to 0 (all equal); the exponent is bisected until the mixture meets a target
entropy or a limit on repetition.  Each host then gives its part of the token budget as whole permutations of its pages, one block each,
and the beginning of one more.  Only column expressions, joins and grouped sums are used, and a host's pages are ranked in hash buckets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.common import WORD, checkpointed

STEPS = 24
PAGES_A_BUCKET = 4096


def tokens_of(data: str | Column) -> Column:
    """Tokens of a text as mixing counts them: runs without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(data, F.lit(WORD)), F.lit(0)).cast("long")


def host_totals(pages: DataFrame, host: str = "host", tokens: str = "tokens") -> DataFrame:
    """`host`, `pages`, `tokens`, `share` of each host; a null host is a host of its own.  Partial sums come before the shuffle."""
    whole = pages.agg(F.sum(tokens)).first()[0] or 1
    totals = pages.groupBy(host).agg(F.count("*").alias("pages"), F.sum(tokens).alias("tokens"))
    return totals.select(F.col(host).alias("host"), "pages", "tokens", (F.col("tokens") / F.lit(whole)).alias("share"))


def _of_exponent(totals: DataFrame, exponent: float) -> tuple[float, float, float]:
    """Entropy (nats) of the weights, their repetition when the least repeated host is used once, and the sum that normalises them."""
    raised = totals.where("tokens > 0").select("share", F.pow("share", F.lit(exponent)).alias("raised"))
    found = raised.agg(F.sum("raised").alias("total"), F.sum(F.col("raised") * F.log("raised")).alias("log_sum"),
                       (F.max(F.col("raised") / F.col("share")) / F.min(F.col("raised") / F.col("share"))).alias("repetition")).first()
    if not found.total:
        return 0.0, 1.0, 1.0
    return math.log(found.total) - found.log_sum / found.total, found.repetition, found.total


def exponent_for(totals: DataFrame, target_entropy: float | None = None, max_repetition: float | None = None) -> float:
    """The exponent whose weights have `target_entropy`, as a share of the largest possible one, as far as `max_repetition` allows.

    Entropy and repetition both grow as the exponent falls from 1 to 0; `STEPS` bisections over the totals find it.  A target that the plain
    shares meet gives 1, one that equal weights do not meet gives 0.
    """
    hosts = totals.where("tokens > 0").count()
    goal = math.inf if target_entropy is None else target_entropy * math.log(max(1, hosts))
    limit = math.inf if max_repetition is None else max_repetition

    def enough(exponent: float) -> bool:
        entropy, repetition, _ = _of_exponent(totals, exponent)
        return entropy >= goal or repetition > limit

    if hosts < 2 or enough(1.0):
        return 1.0
    if not enough(0.0):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(STEPS):
        middle = (low + high) / 2
        low, high = (middle, high) if enough(middle) else (low, middle)
    return high if max_repetition is not None and _of_exponent(totals, low)[1] > limit else low


def weights(totals: DataFrame, exponent: float, budget: int | None = None) -> DataFrame:
    """`totals` with `weight` (they sum to 1) and `budget_tokens`: the weight's part of `budget`.

    Without a budget it is the smallest one that uses every host in full at least once.  Hosts without tokens have weight 0 and budget 0.
    """
    total = _of_exponent(totals, exponent)[2]
    weight = F.when(F.col("tokens") > 0, F.pow("share", F.lit(exponent)) / total).otherwise(0.0)
    weighted = totals.withColumn("weight", weight)
    if budget is None:
        scale = weighted.where("tokens > 0").agg(F.max(F.col("tokens") / F.col("weight"))).first()[0] or 0.0
        return weighted.withColumn("budget_tokens", F.greatest(F.when(F.col("tokens") > 0, F.col("tokens")).otherwise(0),
                                                               F.floor(F.col("weight") * scale + 0.5)).cast("long"))
    return weighted.withColumn("budget_tokens", F.floor(F.col("weight") * budget + 0.5).cast("long"))


def mixture(pages: DataFrame, weighted: DataFrame, page_id: str = "page_id", host: str = "host", tokens: str = "tokens",
            seed: str = "0") -> DataFrame:
    """Rows `page_id`, `host`, `tokens`, `block`, `position`, `weight`: each page once in every full block of its host, in hash order.

    The last block of a host ends with the page that reaches its budget.  `position` ascends within (`host`, `block`) but has gaps: it
    is the digest that orders the block.  A page without tokens is in the full blocks, and in a last one if its turn comes.
    A host's rows are counted per bucket of the digest, so only the bucket in which its budget ends is ranked row by row.
    """
    hosts = weighted.select(
        F.col("host").alias("mix_host"), "weight", F.col("pages").alias("mix_pages"), F.col("tokens").alias("mix_tokens"),
        F.when(F.col("tokens") > 0, F.floor(F.col("budget_tokens") / F.col("tokens"))).otherwise(1).cast("int").alias("full"),
        F.when(F.col("tokens") > 0, F.col("budget_tokens") % F.col("tokens")).otherwise(0).cast("long").alias("rest"))
    slim = pages.select(page_id, F.col(host).alias("host"), F.col(tokens).alias("tokens"))
    joined = slim.join(hosts, F.col("host").eqNullSafe(F.col("mix_host")))
    blocks = F.sequence(F.lit(0), F.col("full") - F.when(F.col("rest") > 0, 0).otherwise(1))
    dealt = joined.where("full > 0 OR rest > 0").withColumn("block", F.explode(blocks))
    dealt = dealt.withColumn("position", F.sha2(F.concat_ws("\x1f", F.lit(seed), F.col("block").cast("string"), F.coalesce(F.col(page_id).cast("string"), F.lit(""))), 256))
    columns = [page_id, "host", "tokens", "block", "position", "weight"]
    whole = dealt.where("block < full").select(*columns)
    buckets = F.greatest(F.lit(1), F.ceil(F.col("mix_pages") / PAGES_A_BUCKET))
    last = dealt.where("block = full").withColumn(
        "bucket", F.floor(F.conv(F.substring("position", 1, 8), 16, 10).cast("long") * buckets / F.lit(1 << 32)).cast("int"))
    sums = last.groupBy("host", "bucket").agg(F.sum("tokens").alias("bucket_tokens"))
    before = Window.partitionBy("host").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("host").alias("sum_host"), F.col("bucket").alias("sum_bucket"), F.coalesce(F.sum("bucket_tokens").over(before), F.lit(0)).alias("earlier"))
    within = Window.partitionBy("host", "bucket").orderBy("position", page_id).rowsBetween(Window.unboundedPreceding, -1)
    placed = last.join(sums, F.col("host").eqNullSafe(F.col("sum_host")) & (F.col("bucket") == F.col("sum_bucket"))).where("earlier < rest")
    part = placed.withColumn("reached", F.col("earlier") + F.coalesce(F.sum("tokens").over(within), F.lit(0))).where("reached < rest")
    return whole.unionByName(part.select(*columns))


def mix(pages: DataFrame, page_id: str = "page_id", host: str = "host", tokens: str = "tokens", target_entropy: float | None = None,
        max_repetition: float | None = None, budget: int | None = None, seed: str = "0") -> DataFrame:
    """The mixture of `pages` (`page_id`, `host`, `tokens`) for a target.  Null tokens count as 0; an empty table gives no rows."""
    slim = pages.select(F.col(page_id).alias(page_id), F.col(host).alias(host), F.coalesce(F.col(tokens), F.lit(0)).cast("long").alias(tokens))
    slim = checkpointed(slim)
    totals = checkpointed(host_totals(slim, host, tokens))
    exponent = exponent_for(totals, target_entropy, max_repetition)
    return mixture(slim, weights(totals, exponent, budget), page_id, host, tokens, seed)
