import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm import packing, queries

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")


def test_ids_are_the_tokenizers():
    plain = Tokenizer.from_file(PATH)
    random_ = random.Random(1)
    signs = [chr(c) for c in range(0x250)] + list("ςΣ́ K　 😀가ก٠ﬁ‍") + ["<|endoftext|>", "'s", "'LL", " the", " Über"]
    for _ in range(1500):
        text = "".join(random_.choices(signs, k=random_.randint(0, 40)))
        assert packing.token_ids(text, PATH).tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize(("histogram", "limit"), [
    ({5: 1000}, 2048), ({2048: 10, 1: 3}, 2048), ({1500: 100, 500: 70, 48: 10}, 2048), ({i: (i * 37) % 90 for i in range(1, 2049)}, 2048), ({}, 2048),
    ({1: 5, 2: 5, 3: 5, 8: 2}, 8), ({1: 7}, 1)])
def test_plans_place_every_piece_once(histogram, limit):
    groups = packing.plan(histogram, limit)
    placed = Counter()
    for group in groups:
        assert sum(length * each for length, each in group.runs) <= limit
        for length, each in group.runs:
            placed[length] += each * group.repeats
    assert placed == Counter({k: v for k, v in histogram.items() if v})
    total = sum(k * v for k, v in histogram.items())
    best = sum(g.repeats for g in packing._best_fit([], dict(histogram), limit))
    assert sum(g.repeats for g in groups) <= max(best * 1.01 + 1, -(-total // limit))


def test_least_squares_are_not_negative_and_optimal():
    counts = np.array([0, 6, 4, 3, 2])
    patterns = packing._patterns(counts, 4, 2)
    found = packing._fitted(patterns, counts)
    used = {tuple(int(x) for x in patterns[k] if x): v for k, v in found.items()}
    assert used == pytest.approx({(3, 1): 4.5, (2, 2): 2.0})


def check(found, limit):
    for _, rows in found.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert (rows.offset == rows.length.cumsum() - rows.length).all() and rows.length.sum() <= limit


def test_odd_texts(odd_texts, page_texts, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET", 3)
    found = packing.packed_pieces(odd_texts, PATH, limit=64).toPandas()
    check(found, 64)
    assert found[found.page_id.isin([1, 2, 3])].length.tolist() == [1, 1, 1] and len(found[(found.page_id == 5)]) == 2
    assert packing.packed_pieces(page_texts([]), PATH).count() == 0


def test_query_against_the_tokenizer(spark):
    plain = Tokenizer.from_file(PATH)
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    want = {}
    for key, text in zip(docs.doc_id, docs.text.fillna("")):
        ids = plain.encode(text, add_special_tokens=False).ids + [0]
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[start:start + 2048], "<u4")
            want[(key, piece)] = (start, len(part), zlib.crc32(part.tobytes()))
    found = queries.op6_packed_sequences(spark, SF).toPandas()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in found.itertuples()} == want and len(found) == len(want)
    check(found, 2048)
    assert found.sequence_id.nunique() <= -(-found.length.sum() // 2048) + 2


def test_other_columns_are_kept_whatever_their_names(spark):
    names = ("bucket", "buckets", "earlier", "rank", "n", "first", "beyond", "base", "repeats", "at")
    pieces = spark.createDataFrame([(i, 0, 1 + i % 5) for i in range(20)], "page_id long, piece int, length long")
    pieces = pieces.withColumns({name: F.concat(F.lit(name), F.col("page_id").cast("string")) for name in names})
    rows = packing.pack(pieces, limit=10).collect()
    assert len(rows) == 20 and all(row[name] == f"{name}{row.page_id}" for row in rows for name in names)
    assert sum(row.length for row in rows) == 60 and len({(row.sequence_id, row.offset) for row in rows}) == 20
