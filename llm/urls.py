"""Verdicts on page URLs: rules first, and logistic regression on hashed character n-grams of host and path for the rest.

All of it is DataFrame work in the JVM.  The model learns from a small table of URLs with a verdict.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 17
GRAMS = (3, 4, 5)
MAX_LABELLED = 5000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"

#: Names of unwanted and of ordinary sites, from which `labelled_urls` makes its table.
UNWANTED = (
    "casino casino-bonus online-casino win-casino bets best-bets betting free-bet poker slots jackpot lottery-win big-win pills diet-pills cheap-meds "
    "viagra pharma-cheap adult adult-chat xxx xxx-videos porn porn-hub sex-cams escort dating-adult spam spam-host link-farm seo-farm ads ads-server "
    "adserver click-ads track tracker click-tracker pixel-track popup-ads free-money free-gift free-prizes payday-loans quick-loan replica-watches "
    "fake-bags cheap-deals cheap-shoes crack-keys keygen warez torrent-free malware-test phishing-login").split()
ORDINARY = (
    "news daily-news herald tribune gazette library city-library university school college academy museum gallery theatre orchestra science "
    "research institute journal archive history heritage nature garden weather travel railway airport hospital clinic health council parliament "
    "justice bank insurance engineering software docs manual wiki forum recipes kitchen cooking music books reader letters language dictionary "
    "translate maps atlas mountain river ocean forest animals birds farm-museum bakery brewery market craft pottery sports football chess "
    "cycling running community village harbour bridge station tower castle church other another then there thing shore stone").split()


def labelled_urls() -> list[tuple[str, str]]:
    """A small table of (url, verdict): each name on a few kinds of hosts and paths, so that neither alone decides."""
    ends, starts = ("example.com", "example.net", "example.org"), ("", "www.", "blog.", "m.")
    paths = ("/en/{}", "/de/{}.html", "/fr/{}/", "/es/{}", "/en/{}.html")
    names = [(name, "block") for name in UNWANTED] + [(name, "allow") for name in ORDINARY]
    return [(f"https://{starts[(i + k) % 4]}{name}.{ends[(i + k) % 3]}{paths[(i + 2 * k) % 5].format((37 * i + 911 * k) % 9973)}", verdict)
            for i, (name, verdict) in enumerate(names) for k in range(3)]


def host_of(url: str | Column) -> Column:
    """Between the first `://` and the next `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://` or for null."""
    return F.translate(F.coalesce(F.regexp_extract(url, _SPLIT, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: str | Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty without `://` or for null."""
    return F.coalesce(F.regexp_extract(url, _SPLIT, 2), F.lit(""))


def page_locations(pages: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    return pages.select(page_id, host_of(url).alias("host"), path_of(url).alias("path"))


def _fits(rule: str, host: Column, path: Column) -> Column:
    name, _, start = rule.partition("/")
    return ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{start}")


def rule_of(rules: Sequence[tuple[str, str]], host: str | Column = "host", path: str | Column = "path") -> Column:
    """The longest of the (verdict, `host/path`) rules that fits, as `struct(verdict, rule)`; null if none does.

    A rule holds for its host and all subdomains where the path starts with the rule's.  Rules are few: they become one expression.
    """
    host, path = (F.col(x) if isinstance(x, str) else x for x in (host, path))
    longest = sorted(rules, key=lambda x: (-len(x[1]), x[1]))
    options = [F.when(_fits(rule, host, path), F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))) for verdict, rule in longest]
    return F.coalesce(*options) if options else F.lit(None).cast("struct<verdict:string,rule:string>")


def _grams(text: Column, mark: str) -> Column:
    """Distinct n-grams; characters are split off once, so a long path costs its length."""
    padded = F.concat(F.lit("^"), text, F.lit("$"))

    def of_size(chars: Column, n: int) -> Column:
        joined = F.transform(F.sequence(F.lit(0), F.length(padded) - n), lambda i: F.concat(F.lit(mark), *(F.get(chars, i + k) for k in range(n))))
        return F.when(F.length(padded) >= n, joined).otherwise(F.array().cast("array<string>"))

    found = F.transform(F.array(F.split(padded, "")), lambda chars: F.flatten(F.array(*(of_size(chars, n) for n in GRAMS))))
    return F.array_distinct(F.element_at(found, 1))


def _featured(locations: DataFrame) -> DataFrame:
    numberless = F.translate("path", "123456789", "000000000")
    grams = F.concat(_grams(F.col("host"), "h"), _grams(numberless, "p"))
    return HashingTF(numFeatures=BUCKETS, binary=True, inputCol="grams", outputCol="features").transform(locations.withColumn("grams", grams))


def train(labelled: DataFrame, url: str = "url", verdict: str = "verdict", limit: int = MAX_LABELLED) -> LogisticRegressionModel | None:
    """Model of `labelled`: `url`, `verdict` (allow or block; others and null URLs are left out).

    Distinct rows, at most `limit` in the order of a hash.  None where no row is left.
    """
    rows = labelled.where(F.col(verdict).isin("allow", "block") & F.col(url).isNotNull()).select(
        F.col(url).alias("url"), F.when(F.col(verdict) == "block", 1.0).otherwise(0.0).alias("label")).distinct()
    rows = rows.orderBy(F.xxhash64("url"), "url", "label").limit(limit)
    known = rows.select(host_of("url").alias("host"), path_of("url").alias("path"), "label")
    if known.isEmpty():
        return None
    return LogisticRegression(maxIter=40, regParam=0.02, featuresCol="features", labelCol="label").fit(
        _featured(known).select("features", "label"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], model: LogisticRegressionModel | None, page_id: str = "page_id",
          url: str = "url") -> DataFrame:
    """`page_id`, `host`, `path`, `rule`, `verdict`, `block_score` of each page; repeated rows stay.

    The verdict is the rule's; else block from a score of 0.5 on.  Without a model the score is 0, so pages without a rule are allowed.
    A null URL has empty host and path, which the model judges like any other.
    """
    rows = page_locations(pages, page_id, url).withColumn("found", rule_of(rules))
    if model is None:
        scored = rows.withColumn("block_score", F.lit(0.0))
    elif model.numClasses < 2 or len(model.coefficients) == 0:
        scored = rows.withColumn("block_score", F.lit(float(model.intercept > 0)))
    else:
        scored = model.transform(_featured(rows)).withColumn("block_score", vector_to_array("probability")[1])
    guessed = F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")
    return scored.select(page_id, "host", "path", F.col("found.rule").alias("rule"),
                         F.coalesce("found.verdict", guessed).alias("verdict"), "block_score")
