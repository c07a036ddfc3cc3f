"""Page texts as token pieces, packed into sequences by length patterns.

The number of pieces of each length is all that a plan needs, and there are at most `limit` lengths.  Patterns of few lengths that fill a
sequence are enumerated over length bins, and their repeat counts are fitted to the histogram by non-negative least squares, which leaves
few patterns in use.  Rounded down, they take pieces of exact lengths; what is left over goes best-fit into the gaps and into new
sequences.  All that happens on counts.  The plan, a bounded table, then gives the k-th piece of a length its place.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from llm.common import checkpointed, texts

LIMIT = 2048
BINS = 128
BUCKET = 50_000
_CACHED = 300_000
_SEPARATORS = re.compile("[\x1c-\x1f]")
_PLAIN = re.compile("[\x21-\x7e\xa1-ɏ]+")
_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


class _Chunks(dict):
    """Token ids (as bytes) of runs of text without white space, in two generations: when the young one is full it becomes the old one, so runs that
    come again and again are never worked out twice.

    The vocabulary drops white space, so a text's ids are those of its runs.  Runs of plain Latin letters and marks are cut into
    words here and looked up in the model; all others go through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.spelt = [i.to_bytes(4, "little") for i in range(1 + max(self.tokenizer.get_vocab().values()))]
        self.old: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [byte for byte in range(256) if byte not in shown]
        self.bytes = {**{byte: byte for byte in shown}, **{byte: 256 + i for i, byte in enumerate(rest)}}

    def encoded(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, chunk: str) -> bytes:
        found = self.old.get(chunk)
        if found is not None:
            pass
        elif "<|" in chunk or not _PLAIN.fullmatch(chunk):
            found = self.encoded(chunk)
        else:
            # Most runs are one word, or one with a mark behind it; the pattern would cut them just so.
            low = chunk.lower()
            if low.isalpha():
                found = self.word(low)
            elif low[-1] in ".,;:!?" and low[:-1].isalpha():
                found = self.word(low[:-1]) + self.word(low[-1])
            else:
                found = b"".join(map(self.word, _PARTS.findall(low)))
        self[chunk] = found
        return found

    def word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            found = self.old_words.get(word)
            if found is not None:
                self.words[word] = found
                return found
            spelled = word if word.isascii() else word.encode().decode("latin-1").translate(self.bytes)
            found = b"".join([self.spelt[token.id] for token in self.model.tokenize(spelled)])
            self.words[word] = found
        return found

    def ids(self, text: str) -> bytes:
        if _SEPARATORS.search(text):
            return self.encoded(text)
        if len(self) > _CACHED:
            self.old = dict(self)
            self.clear()
        if len(self.words) > _CACHED:
            self.old_words, self.words = self.words, {}
        return b"".join(map(self.__getitem__, text.split()))


@functools.cache
def _chunks(path: str) -> _Chunks:
    return _Chunks(path)


def token_ids(text: str, tokenizer: str) -> np.ndarray:
    """Ids of a text by the tokenizer file of white-space-free words at that path, without special tokens."""
    return np.frombuffer(_chunks(tokenizer).ids(text), "<u4")


def token_pieces(page_texts: DataFrame, tokenizer: str, page_id: str = "page_id", data: str = "data", limit: int = LIMIT,
                 end: int = 0, with_ids: bool = False) -> DataFrame:
    """Rows `page_id`, `piece`, `start`, `length`, `ids_crc32` (and `ids`, little-endian 32-bit, on demand).

    A text's ids, then the id `end`, cut into pieces of `limit`, the last shorter.  A null or empty text is one piece of one id.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, last = _chunks(tokenizer), end.to_bytes(4, "little")
        for batch in batches:
            rows, numbers, starts, lengths, sums, kept = [], [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                ids = chunks.ids(text.as_py()) + last
                for piece, start in enumerate(range(0, len(ids), 4 * limit)):
                    part = ids[start:start + 4 * limit]
                    rows.append(row)
                    numbers.append(piece)
                    starts.append(start // 4)
                    lengths.append(len(part) // 4)
                    sums.append(zlib.crc32(part))
                    if with_ids:
                        kept.append(part)
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()),
                       pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * with_ids, names)

    rows = texts(page_texts, page_id, data=data)
    fields = [rows.schema[page_id], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
              T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    fields += [T.StructField("ids", T.BinaryType())] * with_ids
    names = [field.name for field in fields]
    return rows.mapInArrow(cut, T.StructType(fields))


def _patterns(counts: np.ndarray, total: int, size: int) -> np.ndarray:
    """All ways to reach `total` with `size` filled bins (1 to the last), each in descending order, zero-padded to four."""
    bins = np.flatnonzero(counts)
    bins = bins[bins > 0][::-1]
    rows = bins[:, None]
    for used in range(1, size):
        left = total - rows.sum(axis=1)
        if used == size - 1:
            here = (left > 0) & (left <= rows[:, -1]) & (left < len(counts))
            here[here] = counts[left[here]] > 0
            rows = np.hstack([rows[here], left[here, None]])
        else:
            pairs = (bins[None, :] <= rows[:, -1:]) & (bins[None, :] * (size - used) >= left[:, None]) & (bins[None, :] < left[:, None])
            one, two = np.nonzero(pairs)
            rows = np.hstack([rows[one], bins[two, None]])
    return np.pad(rows, ((0, 0), (0, 4 - size))) if size > 1 else np.zeros((0, 4), int)


def _fitted(patterns: np.ndarray, counts: np.ndarray) -> dict[int, float]:
    """Non-negative least squares by an active set: repeat counts for the few patterns in use."""
    goal = counts.astype(float)
    goal[0] = 0.0
    used: list[int] = []
    repeats = np.zeros(0)
    columns = np.zeros((0, len(goal)))
    left = goal.copy()
    for _ in range(3 * len(goal)):
        slope = np.where(patterns > 0, left[patterns], 0.0).sum(axis=1)
        slope[used] = -np.inf
        best = int(slope.argmax())
        if slope[best] <= 1e-7 * max(1.0, goal.max()):
            break
        used.append(best)
        column = np.bincount(patterns[best][patterns[best] > 0], minlength=len(goal)).astype(float)
        columns, repeats = np.vstack([columns, column]), np.append(repeats, 0.0)
        while True:
            solved = np.linalg.solve(columns @ columns.T + 1e-9 * np.eye(len(used)), columns @ goal)
            if (solved > 0).all():
                repeats = solved
                break
            low = solved <= 0
            step = np.min(repeats[low] / np.maximum(repeats[low] - solved[low], 1e-12))
            repeats = repeats + step * (solved - repeats)
            stay = repeats > 1e-9
            used, columns, repeats = [u for u, s in zip(used, stay) if s], columns[stay], repeats[stay]
            if not used:
                break
        left = goal - repeats @ columns
    return dict(zip(used, repeats))


@dataclass
class _Group:
    """`repeats` sequences that hold the same runs of (length, how many), in this order."""

    runs: list[tuple[int, int]]
    repeats: int
    room: int


def _segments(slots: list[list[list[int]]], repeats: int) -> Iterator[tuple[list[int], int]]:
    """Exact lengths side by side: each slot is a list of [length, count] that hold `repeats` in total."""
    at, left = [0] * len(slots), repeats
    while left:
        now = [slot[i] for slot, i in zip(slots, at)]
        n = min(count for _, count in now)
        yield [length for length, _ in now], n
        for k, part in enumerate(now):
            part[1] -= n
            at[k] += part[1] == 0
        left -= n


def plan(histogram: dict[int, int], limit: int = LIMIT) -> list[_Group]:
    """Sequences for `histogram` (length: pieces), as groups of equal ones; every piece has a place."""
    width = max(1, limit // BINS)
    close = width // 8
    free = {length: count for length, count in histogram.items() if count > 0}
    groups = [_Group([(limit, 1)], free.pop(limit), 0)] if limit in free else []
    last = -(-limit // width)
    counts = np.zeros(last + 1, np.int64)
    for length, count in free.items():
        counts[-(-length // width)] += count
    patterns = np.vstack([_patterns(counts, last + int(size * (width - 1) / 2 // width), size) for size in (2, 3, 4)])
    taken = _fitted(patterns, counts) if len(patterns) else {}
    by_bin = defaultdict(list)
    for length in sorted(free):
        by_bin[-(-length // width)].append(length)
    for pattern, repeats in sorted(taken.items(), key=lambda x: -x[1]):
        parts = [int(b) for b in patterns[pattern] if b]
        wanted = {b: parts.count(b) for b in parts}
        n = min([int(repeats), *(sum(free[x] for x in by_bin[b]) // times for b, times in wanted.items())])
        if not n:
            continue
        slots = []
        for number, b in enumerate(parts):
            slot, missing = [], n
            for length in by_bin[b] if number % 2 else reversed(by_bin[b]):
                count = min(missing, free[length])
                if count:
                    free[length] -= count
                    missing -= count
                    slot.append([length, count])
            slots.append(sorted(slot, reverse=number % 2 == 0))
        for lengths, count in _segments(slots, n):
            room = limit - sum(lengths)
            if 0 <= room <= close:
                groups.append(_Group([(length, 1) for length in lengths], count, room))
            else:
                for length in lengths:
                    free[length] += count
    return _best_fit(groups, free, limit)


def _best_fit(groups: list[_Group], free: dict[int, int], limit: int) -> list[_Group]:
    """The rest, longest first: each piece into the smallest gap that holds it, else into a new sequence."""
    by_room: dict[int, list[_Group]] = defaultdict(list)
    for group in groups:
        by_room[group.room].append(group)
    full: list[_Group] = []
    for length in sorted((x for x in free if free[x]), reverse=True):
        left = free[length]
        for room in sorted(r for r in by_room if r >= length and by_room[r]):
            waiting = by_room[room]
            while left and waiting:
                group = waiting.pop()
                each = min(room // length, left)
                whole = min(group.repeats, left // each)
                if whole < group.repeats:
                    waiting.append(_Group(group.runs, group.repeats - whole, room))
                by_room[room - each * length].append(_Group([*group.runs, (length, each)], whole, room - each * length))
                left -= whole * each
            if not left:
                break
        each = limit // length
        if left >= each:
            by_room[limit - each * length].append(_Group([(length, each)], left // each, limit - each * length))
        if left % each:
            by_room[limit - left % each * length].append(_Group([(length, left % each)], 1, limit - left % each * length))
    return full + [group for room in sorted(by_room) for group in by_room[room]]


def places(groups: list[_Group]) -> list[tuple[int, int, int, int, int, int]]:
    """The plan as rows: of `length`, the ranks from `first` up to `beyond` go to `repeats` sequences from `base` on, at `offset` first."""
    rows, used, base = [], defaultdict(int), 0
    for group in groups:
        offset = 0
        for length, each in group.runs:
            first = used[length]
            used[length] += each * group.repeats
            rows.append((length, first, used[length], base, group.repeats, offset))
            offset += each * length
        base += group.repeats
    return rows


def pack(pieces: DataFrame, page_id: str = "page_id", limit: int = LIMIT) -> DataFrame:
    """`pieces` (`page_id`, `piece`, `length` of 1 to `limit`, other columns kept) with `sequence_id` and `offset`.

    The pieces of a sequence lie side by side from offset 0.  Rows are read more than once: hand in a written table.
    Repeated rows each get a place; an empty table stays empty.
    """
    spark = pieces.sparkSession
    histogram = {row.length: row.n for row in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    planned = places(plan(histogram, limit))
    sizes = spark.createDataFrame([(length, -(-n // BUCKET)) for length, n in histogram.items()], "length long, _buckets long")
    place = spark.createDataFrame(planned, "_length long, _first long, _beyond long, _base long, _repeats long, _at long")
    hashed = F.pmod(F.xxhash64(page_id, "piece"), F.col("_buckets")).cast("int")
    dealt = pieces.join(F.broadcast(sizes), "length").withColumn("_bucket", hashed).drop("_buckets")
    counted = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_earlier"))
    within = Window.partitionBy("length", "_bucket").orderBy(page_id, "piece")
    ranked = (dealt.withColumn("_rank", F.row_number().over(within) - 1).join(counted, ["length", "_bucket"])
              .withColumn("_rank", F.col("_rank") + F.col("_earlier")))
    found = ranked.join(F.broadcast(place), (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_beyond")))
    inner = F.col("_rank") - F.col("_first")
    return found.select(*pieces.columns, (F.col("_base") + inner % F.col("_repeats")).alias("sequence_id"),
                        (F.col("_at") + F.floor(inner / F.col("_repeats")) * F.col("length")).cast("long").alias("offset"))


def packed_pieces(page_texts: DataFrame, tokenizer: str, page_id: str = "page_id", data: str = "data", limit: int = LIMIT, end: int = 0) -> DataFrame:
    """Rows `page_id`, `piece`, `start`, `length`, `ids_crc32`, `sequence_id`, `offset` of all `page_texts`."""
    return pack(checkpointed(token_pieces(page_texts, tokenizer, page_id, data, limit, end)), page_id, limit)
