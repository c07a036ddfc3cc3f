import hashlib
import random

import pandas as pd
import pytest

from llm import ordering, queries, syncmers

SF = "/root/testdata/sf0.001"


def naive_syncmers(data, k, s):
    """Positions by the definition, with the operator's hash of inner strings."""
    values = {}

    def value(text):
        if text not in values:
            values[text] = int(syncmers._grams(syncmers._mixed(__import__("numpy").frombuffer(text.encode("utf-32-le"), "<u4").astype("uint64") + syncmers._ODD), s)[0])
        return values[text]

    found = []
    for i in range(len(data) - k + 1):
        inner = [value(data[j:j + s]) for j in range(i, i + k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            found.append(i)
    return found


@pytest.mark.parametrize("seed", range(3))
def test_anchors_follow_the_definition(seed):
    text = "".join(random.Random(seed).choices("abcdé 😀", k=300))
    assert syncmers.closed_syncmers(text, 12, 5)[0].tolist() == naive_syncmers(text, 12, 5)


def test_anchors_do_not_depend_on_context_or_blocks(monkeypatch):
    passage = "".join(random.Random(5).choices("abcdefg hij", k=500))
    alone = dict(zip(*(x.tolist() for x in syncmers.closed_syncmers(passage))))
    inside = dict(zip(*(x.tolist() for x in syncmers.closed_syncmers("before " * 9 + passage + " after"))))
    assert {p + 63: h for p, h in alone.items()}.items() <= inside.items()
    monkeypatch.setattr(syncmers, "_BLOCK", 64)
    assert dict(zip(*(x.tolist() for x in syncmers.closed_syncmers(passage)))) == alone


def test_likeness_is_exact_for_small_sets():
    words = [f"word{i} and some more text" for i in range(12)]
    one, other = " ".join(words[:8]), " ".join(words[4:])
    a, b = (set(syncmers.closed_syncmers(x)[1].tolist()) for x in (one, other))
    assert len(a | b) <= syncmers.SIZE
    assert syncmers.likeness_of(syncmers.fingerprint(one), syncmers.fingerprint(other)) == pytest.approx(len(a & b) / len(a | b))
    assert syncmers.likeness_of("", "") == 1.0 and syncmers.likeness_of("", syncmers.fingerprint(one)) == 0.0


def test_odd_texts(odd_texts, page_texts):
    found = syncmers.fingerprints(odd_texts).toPandas()
    assert len(found) == 12 and found.fingerprint.notna().all()
    assert found[found.page_id.isin([5, 6])].fingerprint.nunique() == 1
    assert (found[found.page_id.isin([1, 2])].fingerprint == "").all()
    assert syncmers.anchors(odd_texts).where("page_id = 2").count() == 0
    assert syncmers.fingerprints(page_texts([])).count() == 0 and syncmers.anchors(page_texts([])).count() == 0


def test_ring_gives_every_row_its_successor(spark):
    from pyspark.sql import functions as F
    keys = random.Random(1).sample(range(-500, 500), 200)
    rows = spark.createDataFrame([(k,) for k in keys], "page_id long")
    placed = ordering.ring(rows, "page_id", parts=9)
    after = placed.withColumn("next", F.lead("page_id").over(ordering.ring_window("page_id"))).where("ring_turn = 0")
    ordered = sorted(keys)
    assert {r.page_id: r.next for r in after.collect()} == dict(zip(ordered, ordered[1:] + ordered[:1]))
    assert ordering.ring(rows.limit(0), "page_id").count() == 0


def test_query_against_brute_force(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id")
    texts = list(docs.text.fillna(""))
    prints = [syncmers.fingerprint(x) for x in texts]
    found = queries.op1_syncmer_fingerprints(spark, SF).toPandas().set_index("doc_id")
    assert len(found) == len(docs)
    for i, key in enumerate(docs.doc_id):
        after = (i + 1) % len(texts)
        half = len(texts[i]) // 2
        edited = texts[i][:len(texts[i]) - half] + texts[after][:half]
        row = found.loc[key]
        assert (row.n_chars, row.fingerprint, row.edited_fingerprint) == (len(texts[i]), prints[i], syncmers.fingerprint(edited))
        assert row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert row.near_next == pytest.approx(syncmers.likeness_of(prints[i], prints[after]))
        assert row.near_edited == pytest.approx(syncmers.likeness_of(prints[i], syncmers.fingerprint(edited)))
