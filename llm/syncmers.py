"""Page-text fingerprints from closed syncmers.

A k-mer of code points is a closed syncmer if the smallest of its inner s-mers (by hash) is its first or its last.  That depends on the
k-mer alone, so the same passage yields the same anchors in any context, and a long text can be worked on in blocks.  `anchors`
gives them with their positions, for positional matching.  A fingerprint keeps the `size` smallest distinct anchor hashes, and the
likeness of two is the estimate of the Jaccard index of their anchor sets, exact where both sets are that small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm.common import texts

K, S, SIZE = 20, 10, 128
_BLOCK = 1 << 20
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * _MIX
    return values ^ (values >> np.uint64(29))


def _grams(codes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` codes: polynomials of doubling length, put together by the binary digits of `width`."""
    power, part, whole, done = int(_ODD), codes, None, 0
    step = 1
    while True:
        if width & step:
            if whole is None:
                whole, done = part, step
            else:
                n = len(codes) - done - step + 1
                whole = whole[:n] * np.uint64(power) + part[done:done + n]
                done += step
        if 2 * step > width:
            return _mixed(whole)
        part = part[:len(part) - step] * np.uint64(power) + part[step:]
        power = power * power % (1 << 64)
        step *= 2


def _window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    covered = 1
    while covered < width:
        step = min(covered, width - covered)
        values = np.minimum(values[:-step], values[step:])
        covered += step
    return values


def closed_syncmers(data: str, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Positions and 32-bit hashes of the anchors of one text.  A text without any (shorter than about 2k) is one anchor itself."""
    codes = _mixed(np.frombuffer(data.encode("utf-32-le"), "<u4").astype(np.uint64) + _ODD)
    places, hashes = [], []
    for start in range(0, max(0, len(codes) - k + 1), _BLOCK):
        block = codes[start:start + _BLOCK + k - 1]
        inner = _grams(block, s)
        lowest = _window_minimum(inner, k - s + 1)
        edge = np.flatnonzero((inner[:len(lowest)] == lowest) | (inner[k - s:] == lowest))
        places.append(edge + start)
        hashes.append((_grams(block, k)[edge] >> np.uint64(32)).astype(np.uint32))
    if not sum(map(len, places)):
        if not len(codes):
            return np.zeros(0, np.int64), np.zeros(0, np.uint32)
        return np.zeros(1, np.int64), (_grams(codes, len(codes)) >> np.uint64(32)).astype(np.uint32)
    return np.concatenate(places), np.concatenate(hashes)


def fingerprint(data: str, k: int = K, s: int = S, size: int = SIZE) -> str:
    return np.unique(closed_syncmers(data, k, s)[1])[:size].astype(">u4").tobytes().hex()


def likeness_of(one: str | None, other: str | None, size: int = SIZE) -> float | None:
    if one is None or other is None:
        return None
    if one == other:
        return 1.0
    if not one or not other:
        return 0.0
    a, b = (np.frombuffer(bytes.fromhex(x), ">u4") for x in (one, other))
    both = np.sort(np.concatenate([a, b]), kind="stable")
    repeated = np.zeros(len(both), bool)
    repeated[1:] = both[1:] == both[:-1]
    lowest = both[~repeated][:size]
    return float(np.count_nonzero(repeated & (both <= lowest[-1]))) / len(lowest)


def fingerprint_of(data: str | Column, k: int = K, s: int = S, size: int = SIZE) -> Column:
    """Fingerprint of a text column, as a column: hexadecimal digits, eight for each kept anchor; the empty text has the empty one."""

    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([fingerprint(x or "", k, s, size) for x in batch], dtype=object)

    return F.pandas_udf(prints, T.StringType())(data)


def likeness(one: str | Column, other: str | Column, size: int = SIZE) -> Column:
    """0 to 1; 1 for equal fingerprints, 0 where just one is empty, null where one is null."""

    def likes(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([likeness_of(x, y, size) for x, y in zip(left, right)], dtype="float64")

    return F.pandas_udf(likes, T.DoubleType())(one, other)


def fingerprints(page_texts: DataFrame, page_id: str = "page_id", data: str = "data", k: int = K, s: int = S, size: int = SIZE) -> DataFrame:
    """`page_id`, `fingerprint` for each row.  Null text counts as empty; equal texts have equal fingerprints; repeated rows stay."""
    rows = texts(page_texts, page_id, data=data)
    return rows.select(page_id, fingerprint_of(data, k, s, size).alias("fingerprint"))


def anchors(page_texts: DataFrame, page_id: str = "page_id", data: str = "data", k: int = K, s: int = S) -> DataFrame:
    """`page_id`, `position`, `anchor` (unsigned 32 bits) of every closed syncmer; an empty or null text has none."""

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, text in zip(batch.iloc[:, 0], batch.iloc[:, 1]):
                places, hashes = closed_syncmers(text, k, s)
                yield pd.DataFrame({page_id: [key] * len(places), "position": places, "anchor": hashes.astype("int64")})

    rows = texts(page_texts, page_id, data=data)
    kept = T.StructType([rows.schema[page_id], T.StructField("position", T.LongType()), T.StructField("anchor", T.LongType())])
    return rows.mapInPandas(found, kept)
