import hashlib
import math
import random

import pytest

from llm import mixing


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, host string, tokens long, weight string, block string, share string")


def some_rows(seed=0):
    random_ = random.Random(seed)
    return [(i, random_.choice(["big"] * 12 + ["a", "b", "c", None]), random_.randint(0, 50), "x", "x", "x") for i in range(600)]


def naive(rows, target, limit, budget=None):
    hosts = {}
    for page, host, tokens, *_ in rows:
        hosts.setdefault(host, []).append((page, tokens))
    totals = {h: sum(t for _, t in v) for h, v in hosts.items()}
    all_tokens = sum(totals.values())
    shares = {h: t / all_tokens for h, t in totals.items()}

    def measured(e):
        raised = {h: s ** e for h, s in shares.items()}
        z = sum(raised.values())
        ratios = [raised[h] / shares[h] for h in shares]
        return -sum(r / z * math.log(r / z) for r in raised.values()), max(ratios) / min(ratios), {h: r / z for h, r in raised.items()}

    low, high = 0.0, 1.0
    enough = lambda e: measured(e)[0] >= target * math.log(len(shares)) or measured(e)[1] > limit
    if enough(1.0):
        low = high = 1.0
    else:
        for _ in range(mixing.STEPS):
            middle = (low + high) / 2
            low, high = (middle, high) if enough(middle) else (low, middle)
    e = high if measured(low)[1] > limit else low
    weights = measured(e)[2]
    scale = max(totals[h] / weights[h] for h in totals)
    out = set()
    for host, members in hosts.items():
        goal = math.floor(weights[host] * budget + 0.5) if budget else max(totals[host], math.floor(weights[host] * scale + 0.5))
        block = 0
        while goal > 0:
            left = goal if goal < totals[host] else None
            for position, page, tokens in sorted((hashlib.sha256(f"0\x1f{block}\x1f{p}".encode()).hexdigest(), p, t) for p, t in members):
                if left is None or left > 0:
                    out.add((page, block, position))
                    left = None if left is None else left - tokens
            goal -= totals[host]
            block += 1
    return e, out


@pytest.mark.parametrize(("target", "limit", "budget"), [(0.95, 100.0, None), (0.99, 1.5, None), (0.1, 4.0, None), (0.95, 4.0, 5000)])
def test_against_brute_force(spark, monkeypatch, target, limit, budget):
    monkeypatch.setattr(mixing, "PAGES_A_BUCKET", 7)
    rows = some_rows()
    exponent, want = naive(rows, target, limit, budget)
    pages = pages_of(spark, rows)
    assert mixing.exponent_for(mixing.host_totals(pages), target, limit) == pytest.approx(exponent, abs=1e-6)
    found = mixing.mix(pages, target_entropy=target, max_repetition=limit, budget=budget)
    assert {(r.page_id, r.block, r.position) for r in found.collect()} == want


def test_no_page_is_left_out_without_a_budget(spark):
    rows = some_rows(3)
    found = mixing.mix(pages_of(spark, rows), target_entropy=0.9, max_repetition=4.0)
    assert {r.page_id for r in found.collect()} == {r[0] for r in rows}


def test_odd_tables(spark):
    rows = [(1, None, None, "x", None, None), (None, None, 3, "x", "x", "x"), (2, "a", 0, "x", "x", "x"), (3, "b", 5, "x", "x", "x"), (3, "b", 5, "x", "x", "x")]
    found = [(r.page_id, r.host, r.block) for r in mixing.mix(pages_of(spark, rows), target_entropy=1.0).collect()]
    assert found.count((3, "b", 0)) == 2 and (2, "a", 0) in found and (1, None, 0) in found and (None, None, 0) in found
    assert mixing.mix(pages_of(spark, []), target_entropy=0.9).count() == 0
    assert spark.range(1).select(mixing.tokens_of(__import__("pyspark").sql.functions.lit(None).cast("string")).alias("n")).first().n == 0
