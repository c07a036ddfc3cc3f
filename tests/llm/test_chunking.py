import random
from collections import defaultdict

import pandas as pd

from llm import chunking, queries

SF = "/root/testdata/sf0.001"


def naive_cuts(raw):
    gear = chunking._gear().tolist()
    ends, last = [], 0
    for i in range(1, len(raw)):
        if i - last > chunking.LARGEST:
            last += chunking.LARGEST
            while raw[last] & 0xC0 == 0x80:
                last -= 1
            ends.append(last)
        rolled = sum(gear[raw[j]] << (i - 1 - j) for j in range(max(0, i - 16), i)) & 0xFFFF
        if rolled >> 11 == 0 and raw[i] & 0xC0 != 0x80 and i - last >= chunking.SMALLEST:
            ends.append(i)
            last = i
    return [*ends, len(raw)]


def naive_spans(texts, min_chars):
    rows = []
    for key in sorted(texts):
        raw = texts[key].encode()
        last = 0
        for end in chunking.cuts(raw):
            rows.append((key, len(raw[:last].decode()), len(raw[last:end].decode()), raw[last:end]))
            last = end
    seen = defaultdict(list)
    for key, start, n, chunk in rows:
        seen[chunk].append((key, start))
    runs = []
    for key, start, n, chunk in rows:
        if len(seen[chunk]) < 2:
            continue
        kept = seen[chunk][0] == (key, start)
        if runs and runs[-1][0] == key and runs[-1][1] + runs[-1][2] == start and runs[-1][6] == kept:
            last = runs[-1]
            runs[-1] = (key, last[1], last[2] + n, last[3] + 1, min(last[4], seen[chunk][0][0]), max(last[5], len(seen[chunk])), kept)
        else:
            runs.append((key, start, n, 1, seen[chunk][0][0], len(seen[chunk]), kept))
    return sorted(r for r in runs if r[2] >= min_chars)


def test_cuts_follow_the_definition_and_resist_shifts():
    random_ = random.Random(2)
    text = "".join(random_.choices("abcdé fgh\n", k=4000))
    raw = text.encode()
    assert chunking.cuts(raw) == naive_cuts(raw)
    pieces = lambda x: {x[a:b] for a, b in zip([0, *chunking.cuts(x)], chunking.cuts(x))}
    assert len(pieces(raw) - pieces(raw[:1500] + b"inserted" + raw[1500:])) <= 4
    long = chunking.cuts(("é" * 5000).encode())
    assert all(b - a <= chunking.LARGEST for a, b in zip([0, *long], long)) and all(x % 2 == 0 for x in long)


def test_odd_texts(odd_texts, page_texts):
    spans = chunking.repeated_spans(odd_texts)
    found = spans.toPandas()
    assert set(found.page_id) <= {4, 9} and {4, 9} <= set(found.page_id)
    left = chunking.without_repeats(odd_texts, spans).toPandas().set_index("page_id").data
    assert len(left) == 12 and len(left[9]) < 2000 and left[2] == "" and left[8] == "x"
    assert chunking.repeated_spans(page_texts([])).count() == 0


def test_query_against_brute_force(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    want = naive_spans(dict(zip(docs.doc_id, docs.text.fillna(""))), chunking.MIN_CHARS)
    names = ["doc_id", "start", "n_chars", "n_chunks", "first_doc_id", "copies", "kept"]
    found = queries.op7_repeated_spans(spark, SF).select(*names).collect()
    assert sorted(map(tuple, found)) == want


def test_passages_of_fifty_words_are_found(spark):
    random_ = random.Random(4)
    word = lambda: "".join(random_.choices("abcdefghij", k=random_.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(55) for _ in range(40)]
    rows = [(i, prose(60) + " " + passages[i // 2] + " " + prose(70)) for i in range(80)] + [(i, prose(200)) for i in range(80, 160)]
    found = {r.page_id for r in chunking.repeated_spans(spark.createDataFrame(rows, "page_id long, data string")).collect()}
    assert found <= set(range(80)) and len(found) >= 78


def test_extended_spans_reach_the_ends_of_short_passages(spark):
    random_ = random.Random(9)
    prose = lambda n: "".join(random_.choices("abcdefghij é", k=n))
    passages = [prose(254) for _ in range(150)]
    rows = [(i, prose(300) + "<" + passages[i // 2] + ">" + prose(300)) for i in range(298)] + [(298, "(" + passages[149] + ")"), (299, passages[149])]
    texts = spark.createDataFrame(rows, "page_id long, data string")
    plain = {r.page_id for r in chunking.repeated_spans(texts).collect()}
    spans = chunking.extended_spans(texts, beside=8)
    found = {r.page_id: r for r in spans.collect()}
    assert plain < set(found) and len(found) >= 296
    text = dict(rows)
    for page, span in found.items():
        assert passages[page // 2] in text[page][span.start:span.start + span.n_chars] and span.n_chars <= 256 + 8 and span.kept == (page % 2 == 0)
    left = {r.page_id: r.data for r in chunking.without_repeats(texts, spans).collect()}
    assert all(passages[p // 2] not in left[p] and len(left[p]) <= 602 for p in found if p % 2) and all(left[p] == text[p] for p in found if p % 2 == 0)


def test_extended_spans_of_odd_texts(odd_texts, page_texts):
    found = chunking.extended_spans(odd_texts).toPandas()
    assert {4, 9} <= set(found.page_id) <= {4, 9} and chunking.extended_spans(page_texts([])).count() == 0
    left = chunking.without_repeats(odd_texts, chunking.extended_spans(odd_texts)).toPandas().set_index("page_id").data
    assert len(left) == 12 and len(left[4]) >= 44 and left[9] == "more" and left[8] == "x"
