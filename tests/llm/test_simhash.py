import random
import re

import pandas as pd
import pytest
import xxhash

from llm import components, queries, simhash

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\\x20\\x09-\\x0D]+")


def naive_simhash(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def naive_components(nodes, linked):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("limit", [64, 2])
def test_links_keep_components_whole(spark, limit):
    random_ = random.Random(limit)
    base = [random_.getrandbits(64) for _ in range(6)]
    prints = {b for b in base}
    for b in base:
        at = b
        for _ in range(30):
            at = random_.choice([b, at]) ^ sum({1 << random_.randrange(64) for _ in range(random_.randint(1, 3))})
            prints.add(at)
    prints = sorted(prints)
    rows = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)], "node long, simhash long")
    links = simhash.links(rows, list_limit=limit)
    assert all(bin(prints[r.left] ^ prints[r.right]).count("1") <= 2 for r in links.collect())
    found = {r.node: r.component for r in components.components(links).collect()}
    want = naive_components(list(range(len(prints))), lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 2)
    assert {i: found.get(i, i) for i in want} == want


def test_components_of_paths_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 140)] + [(7, 7), (None, 3), (200, 199), (199, 200)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "left long, right long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, 199: 199, 200: 199}
    assert components.components(spark.createDataFrame([], "left long, right long")).count() == 0


def test_odd_texts(odd_texts, page_texts):
    found = simhash.near_duplicates(odd_texts).toPandas()
    assert len(found) == 12
    assert (found[found.page_id.isin([1, 2, 3])].fingerprint == "0" * 16).all() and (found[found.page_id.isin([1, 2, 3])].component_id == 1).all()
    assert (found[found.page_id.isin([5, 6])].component_id == 5).all()
    assert simhash.near_duplicates(page_texts([])).count() == 0


def test_query_against_brute_force(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    prints = dict(zip(docs.doc_id, map(naive_simhash, docs.text)))
    want = naive_components(sorted(prints), lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 2)
    found = queries.op3_simhash_near_duplicates(spark, SF).toPandas()
    assert dict(zip(found.doc_id, found.fingerprint)) == {k: f"{v:016x}" for k, v in prints.items()}
    assert dict(zip(found.doc_id, found.component_id)) == want
