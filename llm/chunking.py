"""Passages that repeat within or across page texts, by content-defined chunks.

A gear hash rolls over the last sixteen bytes; where its top bits are zero, a chunk ends, so the same passage is cut alike wherever it
stands and an insertion disturbs only the chunks around it.  Chunks are counted by digest; runs of neighbouring repeated
chunks make a span.  The first occurrence, by the smallest `page_id` and position, is the one to keep.

The head and tail of a passage lie in chunks that straddle its edges.  `extended_spans` compares the texts beside a run of any length with those beside its
first occurrence (beside the next one, for the first itself), to where they stop agreeing, before it asks for a length.
"""

from __future__ import annotations

import os.path
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm.common import checkpointed, texts

#: A run of one repeated word has no content-defined end.  The largest size is a multiple of most short periods, so its chunks are equal.
SMALLEST, LARGEST, BITS = 16, 240, 5
MIN_CHARS = 100
_WINDOW = 16
#: Characters beside a run that are compared at first; where all agree, the next `WIDER` times as many are.
BESIDE, WIDER = 256, 16


def _gear(seed: int = 2024) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 16, 256, dtype=np.uint16)


def cuts(raw: bytes, smallest: int = SMALLEST, largest: int = LARGEST, bits: int = BITS) -> list[int]:
    """Ends of the chunks of one UTF-8 text, in bytes; no character is cut in two.  An empty text has none."""
    if not raw:
        return []
    codes = np.frombuffer(raw, np.uint8)
    rolled, step = _gear()[codes], 1
    while step < _WINDOW:
        longer = rolled.copy()
        longer[step:] += rolled[:-step] << np.uint16(step)
        rolled, step = longer, 2 * step
    ends = np.flatnonzero(rolled >> np.uint16(16 - bits) == 0) + 1
    ends = ends[ends < len(raw)]
    ends = ends[(codes[ends] & 0xC0) != 0x80]
    found, last = [], 0
    for end in [*ends.tolist(), len(raw)]:
        while end - last > largest:
            last += largest
            while raw[last] & 0xC0 == 0x80:
                last -= 1
            found.append(last)
        if end - last >= smallest or end == len(raw):
            found.append(end)
            last = end
    return found


def chunks(page_texts: DataFrame, page_id: str = "page_id", data: str = "data", smallest: int = SMALLEST, largest: int = LARGEST,
           bits: int = BITS) -> DataFrame:
    """Rows `page_id`, `digest` (64 bits), `start`, `n_chars` (code points) of every chunk; a null or empty text has none."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, digests, starts, sizes = [], [], [], []
            for row, text in enumerate(batch.column(1)):
                raw = text.as_buffer().to_pybytes()
                ends = cuts(raw, smallest, largest, bits)
                if not ends:
                    continue
                view = memoryview(raw)
                edges = np.array([0, *ends])
                digests.extend(map(xxhash.xxh3_64_intdigest, map(view.__getitem__, map(slice, edges[:-1].tolist(), ends))))
                if not raw.isascii():
                    seen = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
                    edges = np.concatenate([[0], seen[edges[1:] - 1]])
                rows.append(np.full(len(ends), row))
                starts.append(edges[:-1])
                sizes.append(np.diff(edges))
            if not rows:
                continue
            columns = [batch.column(0).take(pa.array(np.concatenate(rows))), pa.array(np.array(digests, np.uint64).view(np.int64)),
                       pa.array(np.concatenate(starts).astype(np.int32)), pa.array(np.concatenate(sizes).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = texts(page_texts, page_id, data=data)
    fields = [rows.schema[page_id], T.StructField("digest", T.LongType()), T.StructField("start", T.IntegerType()),
              T.StructField("n_chars", T.IntegerType())]
    names = [field.name for field in fields]
    return rows.mapInArrow(cut, T.StructType(fields))


def repeated_spans(page_texts: DataFrame, page_id: str = "page_id", data: str = "data", min_chars: int = MIN_CHARS, smallest: int = SMALLEST,
                   largest: int = LARGEST, bits: int = BITS) -> DataFrame:
    """Rows `page_id`, `start`, `n_chars`, `n_chunks`, `first_page_id`, `copies`, `kept`: runs of repeated chunks of `min_chars` or more.

    `first_page_id` is the smallest page that has a chunk of the run; `copies` the largest count of one; `kept` marks runs of first
    occurrences.  Pages without such runs are not there.  Rows without `page_id` take no part; repeated rows count as copies of each
    other within one page; an empty table gives no rows.
    """
    found = chunks(page_texts.where(F.col(page_id).isNotNull()), page_id, data, smallest, largest, bits)
    counted = found.groupBy("digest").agg(F.count("*").alias("copies"), F.min(page_id).alias("first_page_id")).where("copies > 1")
    repeated = found.join(counted, "digest")
    again = F.row_number().over(Window.partitionBy(page_id, "digest").orderBy("start"))
    marked = repeated.withColumn("kept", (F.col(page_id) == F.col("first_page_id")) & (again == 1))
    order = Window.partitionBy(page_id).orderBy("start", "kept")
    joined = (F.lag("start").over(order) + F.lag("n_chars").over(order) == F.col("start")) & (F.lag("kept").over(order) == F.col("kept"))
    runs = marked.withColumn("opens", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("opens").over(order))
    return runs.groupBy(page_id, "run").agg(
        F.min("start").alias("start"), F.sum("n_chars").alias("n_chars"), F.count("*").alias("n_chunks"),
        F.min("first_page_id").alias("first_page_id"), F.max("copies").alias("copies"), F.first("kept").alias("kept"),
    ).where(F.col("n_chars") >= min_chars).drop("run")


def _agreed(edges: DataFrame, page_texts: DataFrame, page_id: str, data: str, beside: int) -> DataFrame:
    """`edges`: `page`, `run`, `right` (the side), `here`, `there_page`, `there`.  Returns `page`, `run`, `right`, `gained`: how far both texts agree."""
    rows = texts(page_texts.where(F.col(page_id).isNotNull()), page_id, data=data).select(F.col(page_id).alias("page"), F.col(data).alias("data"))

    @F.pandas_udf(T.IntegerType())
    def same(one: pd.Series, other: pd.Series) -> pd.Series:
        return pd.Series([len(os.path.commonprefix(pair)) for pair in zip(one, other)], dtype="int32")

    found, width = None, beside
    while True:
        asked = edges.select("page", F.col("here").alias("at"), "right").union(edges.select("there_page", "there", "right")).distinct()
        asked = asked.groupBy("page").agg(F.collect_list(F.struct("at", "right")).alias("asked"))
        # Which of the rows of a repeated page a run is in is not known: it has no slices, and its runs stay as they are.
        single = rows.join(asked, "page").groupBy("page").agg(F.count("*").alias("rows"), F.first("data").alias("data"), F.first("asked").alias("asked")).where("rows = 1")
        slices = single.select("page", "data", F.explode("asked").alias("edge")).select("page", "edge.*", F.when(
            F.col("edge.right"), F.substring(F.col("data"), F.col("edge.at") + 1, F.lit(width))).otherwise(F.reverse(F.substring(
                F.col("data"), F.greatest(F.col("edge.at") - width, F.lit(0)) + 1, F.least(F.col("edge.at"), F.lit(width))))).alias("slice"))
        slices = checkpointed(slices)
        here = slices.select("page", F.col("at").alias("here"), "right", F.col("slice").alias("one"))
        there = slices.select(F.col("page").alias("there_page"), F.col("at").alias("there"), "right", F.col("slice").alias("other"))
        met = edges.join(here, ["page", "here", "right"]).join(there, ["there_page", "there", "right"])
        met = checkpointed(met.withColumn("gained", same("one", "other")).drop("one", "other"))
        gains = met.select("page", "run", "right", "gained")
        found = gains if found is None else found.unionByName(gains)
        step = F.when(F.col("right"), width).otherwise(-width)
        edges = met.where(F.col("gained") == width).select("page", "run", "right", (F.col("here") + step).alias("here"), "there_page", (F.col("there") + step).alias("there"))
        if edges.isEmpty():
            return found.groupBy("page", "run", "right").agg(F.sum("gained").alias("gained"))
        width *= WIDER


def extended_spans(page_texts: DataFrame, page_id: str = "page_id", data: str = "data", min_chars: int = MIN_CHARS, smallest: int = SMALLEST,
                   largest: int = LARGEST, bits: int = BITS, beside: int = BESIDE) -> DataFrame:
    """Columns as of `repeated_spans`: runs of repeated chunks of any length, extended to their true ends, that then have `min_chars` or more.

    Runs that extend to the same span are one row.  What is not `kept` is a copy of text at an earlier place: by `page_id`, then position.
    """
    found = chunks(page_texts.where(F.col(page_id).isNotNull()), page_id, data, smallest, largest, bits).withColumnRenamed(page_id, "page")
    place = F.struct("page", "start")
    counted = found.groupBy("digest").agg(F.count("*").alias("copies"), F.min(place).alias("first")).where("copies > 1")
    again = F.row_number().over(Window.partitionBy("page", "digest").orderBy("start"))
    marked = checkpointed(found.join(counted, "digest").withColumn("kept", (F.col("page") == F.col("first.page")) & (again == 1)))
    later = marked.where("NOT kept").groupBy("digest").agg(F.min(place).alias("there"))
    firsts = marked.where("kept").join(later, "digest")
    sided = firsts.unionByName(marked.where("NOT kept").withColumn("there", F.col("first")))
    order = Window.partitionBy("page").orderBy("start", "kept")
    joined = (F.lag("start").over(order) + F.lag("n_chars").over(order) == F.col("start")) & (F.lag("kept").over(order) == F.col("kept"))
    runs = sided.withColumn("opens", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("opens").over(order))
    after = F.struct(F.col("there.page").alias("page"), (F.col("there.start") + F.col("n_chars")).alias("start"))
    runs = checkpointed(runs.groupBy("page", "run").agg(
        F.min("start").alias("start"), F.sum("n_chars").cast("int").alias("n_chars"), F.count("*").alias("n_chunks"), F.min("first.page").alias("first_page_id"),
        F.max("copies").alias("copies"), F.first("kept").alias("kept"), F.min_by("there", "start").alias("before"), F.max_by(after, "start").alias("after")))
    edge = lambda right, here, there: F.struct(F.lit(right).alias("right"), here.alias("here"), there["page"].alias("there_page"), there["start"].alias("there"))
    both = F.array(edge(False, F.col("start"), F.col("before")), edge(True, F.col("start") + F.col("n_chars"), F.col("after")))
    edges = runs.select("page", "run", F.explode(both).alias("edge")).select("page", "run", "edge.*").where("right OR (here > 0 AND there > 0)")
    gained = _agreed(edges, page_texts, page_id, data, beside).groupBy("page", "run").agg(
        *(F.coalesce(F.sum(F.when(F.col("right") == side, F.col("gained"))), F.lit(0)).alias(name) for side, name in ((False, "head"), (True, "tail"))))
    whole = runs.join(gained, ["page", "run"], "left").fillna(0, ["head", "tail"])
    whole = whole.withColumns({"start": (F.col("start") - F.col("head")).cast("int"), "n_chars": F.col("n_chars") + F.col("head") + F.col("tail")})
    return whole.where(F.col("n_chars") >= min_chars).groupBy(F.col("page").alias(page_id), "start", "n_chars", "kept").agg(
        F.sum("n_chunks").alias("n_chunks"), F.min("first_page_id").alias("first_page_id"), F.max("copies").alias("copies")).select(
        page_id, "start", "n_chars", "n_chunks", "first_page_id", "copies", "kept")


def without_repeats(page_texts: DataFrame, spans: DataFrame, page_id: str = "page_id", data: str = "data") -> DataFrame:
    """`page_texts` (`page_id`, `data`) with every span that is not `kept` cut out of its text; null texts become empty."""
    cut = spans.where("NOT kept").groupBy(page_id).agg(F.sort_array(F.collect_list(F.struct("start", "n_chars"))).alias("spans"))
    rows = texts(page_texts, page_id, data=data).join(cut, page_id, "left")

    def trimmed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for whole, some in batches:
            out = []
            for text, parts in zip(whole, some):
                kept, at = [], 0
                for part in parts if parts is not None else ():
                    kept.append(text[at:part["start"]])
                    at = max(at, part["start"] + part["n_chars"])
                out.append("".join([*kept, text[at:]]))
            yield pd.Series(out, dtype=object)

    starts = F.transform("spans", lambda span: F.struct(span["start"].alias("start"), span["n_chars"].cast("int").alias("n_chars")))
    return rows.select(page_id, F.pandas_udf(trimmed, T.StringType())(data, starts).alias(data))
