import re

import pandas as pd

from llm import queries, urls

SF = "/root/testdata/sf0.01"


def test_query_against_the_rules(spark):
    pages = pd.read_parquet(f"{SF}/pages.parquet").set_index("page_id")
    found = queries.op10_url_verdicts(spark, SF).toPandas()
    assert len(found) == len(pages)
    for row in found.itertuples():
        host, path = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", pages.url[row.page_id]).groups()
        fitting = [(len(rule), verdict, rule) for verdict, rule in queries.URL_RULES
                   if f".{host.lower()}".endswith("." + rule.split("/")[0]) and path.startswith("/" + rule.partition("/")[2])]
        assert (row.host, row.path) == (host.lower(), path)
        if fitting:
            assert (row.verdict, row.rule) == max(fitting)[1:]
        else:
            assert row.rule is None and row.verdict == ("block" if row.block_score >= 0.5 else "allow")


def test_the_model_tells_unseen_names_apart(spark):
    model = urls.train(spark.createDataFrame(urls.labelled_urls(), "url string, verdict string"))
    unseen = [("https://royal-casino-club.example.net/en/12", "block"), ("https://m.free-bets-today.example.com/de/7.html", "block"),
              ("https://public-library-friends.example.net/fr/9/", "allow"), ("https://www.weathermap.example.com/es/3", "allow")]
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(unseen)], "page_id long, url string")
    assert [r.verdict for r in urls.judge(pages, (), model).orderBy("page_id").collect()] == [v for _, v in unseen]


def test_odd_urls(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "a://"), (5, "x://HOST.Org"), (6, "x://a.org/\n/p?q#f"), (None, "x://b.org/"), (7, "x://" + "h" * 5000 + "/" + "p" * 50_000),
            (8, "x://forg/"), (8, "x://forg/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'x' AS host", "'x' AS path", "'x' AS rule", "'x' AS features", "'x' AS grams")
    model = urls.train(spark.createDataFrame(urls.labelled_urls()[::5], "url string, verdict string"))
    for some in (model, None):
        found = {r.page_id: r for r in urls.judge(pages, (("block", "org/"), ("allow", "org/\n")), some).collect()}
        assert [(found[i].host, found[i].path) for i in (1, 2, 3, 4, 5)] == [("", "")] * 4 + [("host.org", "")]
        assert found[6].rule == "org/\n" and found[6].verdict == "allow" and found[None].rule == "org/" and found[5].rule is None and found[8].rule is None
        assert urls.judge(pages, (), some).count() == 10 and urls.judge(pages.limit(0), (), some).count() == 0
    assert urls.train(spark.createDataFrame([(None, "block"), ("u", "maybe")], "url string, verdict string")) is None
    one = urls.train(spark.createDataFrame([("x://a.b/", "block")], "url string, verdict string"))
    assert urls.judge(pages, (), one).count() == 10
