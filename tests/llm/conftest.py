import pytest
from pyspark.sql import functions as F

CLASHING = ("simhash", "node", "component", "component_id", "key", "line", "line_no", "digest", "start", "score", "ring_range", "term", "shard", "tokens_", "text", "class", "role")


@pytest.fixture(scope="session")
def page_texts(spark):
    """Makes page texts (`page_id`, `data`) with further columns whose names operators use themselves."""

    def make(rows):
        found = spark.createDataFrame(rows, "page_id long, data string")
        return found.withColumns({name: F.lit("other") for name in CLASHING})

    return make


@pytest.fixture(scope="session")
def odd_texts(page_texts):
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows."""
    long = "one line that goes on and on without an end " * 6000
    return page_texts([(None, "text without a page"), (None, None), (1, None), (2, ""), (3, " \n\t "), (4, long), (5, "same text twice"), (5, "same text twice"),
                       (6, "same text twice"), (7, "ünï çödé 😀   \x1c x"), (8, "x"), (9, long + "more")])
