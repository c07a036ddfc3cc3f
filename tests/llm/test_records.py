"""The text operators on the project's own records: the text nodes of extracted pages, in document order."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from llm import chunking, lines, mixing, packing, quality, search, simhash, syncmers
from pagefacts.sources.nodes import extract_text_nodes

STORY = " ".join(f"word{i % 37} of the story number {i}" for i in range(60))
OTHER = " ".join(f"another{i % 11} tale that differs {i * 7}" for i in range(60))


@pytest.fixture(scope="module")
def page_texts(spark):
    pages = spark.createDataFrame([
        (1, f"<body><h1>Title</h1><p>{STORY}</p></body>"), (2, f"<html><div><h1>Title</h1><section><p>{STORY}</p></section></div></html>"),
        (3, f"<body><h1>Else</h1><p>{OTHER}</p></body>"), (4, "<body></body>")], "page_id long, html string")
    nodes = extract_text_nodes(pages)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("text_ix", "data"))), lambda t: t["data"]), "\n")
    return pages.select("page_id").join(nodes.groupBy("page_id").agg(joined.alias("data")), "page_id", "left")


def test_fingerprints(page_texts):
    found = {r.page_id: r.f for r in page_texts.select("page_id", syncmers.fingerprint_of(F.coalesce("data", F.lit(""))).alias("f")).collect()}
    assert found[1] == found[2] != found[3]


def test_near_duplicates(page_texts):
    found = {r.page_id: r.component_id for r in simhash.near_duplicates(page_texts).collect()}
    assert found == {1: 1, 2: 1, 3: 3, 4: 4}


def test_lines(page_texts):
    found = {(r.page_id, r.line_no): (r.first_page_id, r.kept) for r in lines.line_classes(page_texts).collect()}
    assert found[2, 0] == (1, False) and found[2, 1] == (1, False) and found[3, 1] == (3, True)


def test_spans(page_texts):
    assert {(r.page_id, r.first_page_id) for r in chunking.repeated_spans(page_texts).collect()} == {(1, 1), (2, 1)}


def test_search(page_texts):
    found = search.search(page_texts, page_texts.where("page_id = 2"), k=2).collect()
    assert [r.page_id for r in sorted(found, key=lambda r: r.rank)] == [1, 2]


def test_pieces(page_texts):
    found = packing.packed_pieces(page_texts, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert {r.page_id for r in found} == {1, 2, 3, 4} and len({r.sequence_id for r in found}) == 1


def test_mixture(page_texts):
    rows = page_texts.select("page_id", F.when(F.col("page_id") < 3, "one.example").otherwise("two.example").alias("host"), mixing.tokens_of("data").alias("tokens"))
    assert {r.page_id for r in mixing.mix(rows).collect()} == {1, 2, 3, 4}


def test_statistics(page_texts):
    assert quality.page_statistics(page_texts).count() == 4
