"""Near-duplicate page texts by SimHash and an inverted index on byte positions.

A 64-bit fingerprint is eight positional bytes.  Two fingerprints that differ in at most `max_bits` (2) bits share at least
`8 - max_bits` (6) positional bytes: the guaranteed minimum.  An index on single bytes has 256 keys a position, and its lists grow with
the corpus.  So the index keys are groups of four positional bytes: any two bytes fall in at most two of the four byte
pairs, and the other two pairs make up one of the six groups, so every link is met under one key at least.  Pairs that meet
are tallied byte by byte, kept from six shared bytes on, and verified by counting bits.

Keys with more than `list_limit` fingerprints do not emit pairs.  Two fingerprints within two bits have a common
neighbour within one bit; so each fingerprint of such a key is posted at its 65 neighbours, at most 65 meet at each, all of them are
linked, and linking each to the smallest keeps every component whole.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm.common import checkpointed, texts
from llm.components import components

MAX_BITS = 2
LIST_LIMIT = 64
_hash = functools.partial(xxhash.xxh64_intdigest, seed=42)


def simhash(data: str, shingle: int = 3) -> int:
    """Fingerprint of one text, signed: words split at ASCII white space, A-Z lower-cased, shingles counted with repeats."""
    words = data.encode().lower().split()
    if not words:
        return 0
    width = min(shingle, len(words))
    grams = map(b" ".join, zip(*(words[i:] for i in range(width))))
    total = len(words) - width + 1
    hashes = np.fromiter(map(_hash, grams), np.uint64, total)
    counts = np.zeros(64, np.int64)
    for start in range(0, total, 1 << 15):
        part = hashes[start:start + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * counts > total), bitorder="little")
    return int(bits.view("<i8")[0])


def _simhashes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for data in batches:
        yield pd.Series([simhash(x) for x in data], dtype="int64")


def fingerprints(page_texts: DataFrame, page_id: str = "page_id", data: str = "data") -> DataFrame:
    """`page_id`, `simhash` (signed 64 bits) of each row; a null text counts as empty, an empty one has fingerprint 0."""
    rows = texts(page_texts, page_id, data=data)
    return rows.select(page_id, F.pandas_udf(_simhashes, T.LongType())(data).alias("simhash"))


def _byte_groups() -> list[int]:
    pairs = [0xFFFF << (16 * i) for i in range(4)]
    masks = [a | b for a, b in combinations(pairs, 2)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _shared_bytes(difference: Column) -> Column:
    return sum(F.when(F.shiftrightunsigned(difference, 8 * i).bitwiseAND(F.lit(255)) == 0, 1).otherwise(0) for i in range(8))


def links(prints: DataFrame, max_bits: int = MAX_BITS, list_limit: int = LIST_LIMIT) -> DataFrame:
    """`prints`: distinct `simhash` with an id `node`.  Returns `left`, `right`: links that keep all components whole.

    All links of index keys with up to `list_limit` fingerprints are there; above it, one link for each fingerprint and neighbour.
    """
    if max_bits != 2:
        raise ValueError("the byte groups and the neighbour step are made for two bits")
    masks = F.array(*(F.lit(m) for m in _byte_groups()))
    posted = prints.select("node", "simhash", F.posexplode(masks).alias("group", "mask")).select(
        "node", "simhash", "group", F.col("simhash").bitwiseAND(F.col("mask")).alias("key"))
    sized = posted.join(posted.groupBy("group", "key").agg(F.count("*").alias("n")).where("n > 1"), ["group", "key"])

    short = sized.where(F.col("n") <= list_limit)
    left = short.select("group", "key", F.col("node").alias("left"), F.col("simhash").alias("x"))
    right = short.select("group", "key", F.col("node").alias("right"), F.col("simhash").alias("y"))
    met = left.join(right, ["group", "key"]).where("left < right").withColumn("difference", F.col("x").bitwiseXOR(F.col("y")))
    counted = met.where(_shared_bytes(F.col("difference")) >= 8 - max_bits)
    verified = counted.where(F.bit_count("difference") <= max_bits).select("left", "right").distinct()

    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(64)))
    around = sized.where(F.col("n") > list_limit).select(
        "node", F.explode(F.transform(flips, lambda flip: F.col("simhash").bitwiseXOR(flip))).alias("point")).distinct()
    nearest = around.withColumn("left", F.min("node").over(Window.partitionBy("point")))
    starred = nearest.where("left <> node").select("left", F.col("node").alias("right")).distinct()
    return verified.unionByName(starred)


def near_duplicates(page_texts: DataFrame, page_id: str = "page_id", data: str = "data", max_bits: int = MAX_BITS,
                    list_limit: int = LIST_LIMIT) -> DataFrame:
    """One row for each row of `page_texts`: `page_id`, `fingerprint` (16 hex digits), `component_id`.

    Pages whose fingerprints differ in at most `max_bits` bits are linked; `component_id` is the smallest `page_id` reachable, the page's own
    included.  Null and empty texts have fingerprint zero and are linked like any other; a row without `page_id` keeps its
    fingerprint and takes the component of its text; repeated rows stay repeated; an empty table gives no rows.
    """
    prints = checkpointed(fingerprints(page_texts, page_id, data))
    nodes = checkpointed(prints.groupBy("simhash").agg(F.min(page_id).alias("node")))
    found = components(links(nodes.where("node IS NOT NULL"), max_bits, list_limit))
    named = nodes.join(found, "node", "left").select("simhash", F.coalesce("component", "node").alias("component_id"))
    return prints.join(named, "simhash").select(
        page_id, F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")
