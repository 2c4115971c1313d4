"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Documents become token ids plus an end id.  Only longer ones are cut; the remainder
is the first piece, so that all others are full.  Lengths are packed by large-item
matching: pieces above a third of the capacity go at most two to a sequence, the
longest with the longest partner that fits; smaller pieces, longest first, best-fit
the remaining gaps.

Only the histogram of lengths (at most ``capacity`` rows, whatever the input) reaches
the driver.  The plan is made on runs of like sequences, and says for each length
which ranks go where; ranks within a length come from counts by written part and a
running sum, so no length, however frequent, meets in one task.

Defined cases: null and empty texts are the end id alone; repeated rows are packed
each; a null doc_id is kept.  Empty table: no rows.  Other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .tokens import encoder

CAPACITY, END_ID = 2048, 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long"


def cuts(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: a shorter one can only be the first."""
    first = length % capacity or capacity
    return [(0, min(first, length)), *((s, capacity) for s in range(first, length, capacity))]


def tokenised(documents: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of all documents, by task and place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, encode = TaskContext.get().partitionId(), 0, encoder(vocabulary)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                for n, (start, length) in enumerate(cuts(len(ids), capacity)):
                    rows.append((doc, n, start, length, zlib.crc32(ids[start : start + length]), part, place))
                    place += 1
            columns = list(zip(*rows)) or [()] * 7
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in PIECES.split(", ")])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


class Plan:
    """Segments (length, first rank, count, first sequence, pieces a sequence, offset) and the number of sequences."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.segments: list[tuple[int, int, int, int, int, int]] = []
        self.used: dict[int, int] = defaultdict(int)
        self.runs: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: (first sequence, how many)
        self.gaps: list[int] = []
        left = {n: k for n, k in counts.items() if k}
        self.match({n: k for n, k in left.items() if 3 * n > capacity})
        for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
            self.fill(length, left[length])

    def put(self, length: int, count: int, sequence: int, each: int, offset: int) -> None:
        self.segments.append((length, self.used[length], count, sequence, each, offset))
        self.used[length] += count

    def leave(self, gap: int, sequence: int, count: int) -> None:
        if gap and count:
            if not self.runs[gap]:
                insort(self.gaps, gap)
            self.runs[gap].append((sequence, count))

    def match(self, left: dict[int, int]) -> None:
        lengths = sorted(left)
        for length in sorted(left, reverse=True):
            while left[length]:
                at = bisect_left(lengths, self.capacity - length + 1) - 1
                while at >= 0 and (lengths[at] > length or left[lengths[at]] < 1 + (lengths[at] == length)):
                    at -= 1
                if at < 0:
                    count = left[length]
                    self.put(length, count, self.sequences, 1, 0)
                    self.leave(self.capacity - length, self.sequences, count)
                    left[length] = 0
                elif (other := lengths[at]) == length:
                    count = left[length] // 2
                    self.put(length, 2 * count, self.sequences, 2, 0)
                    self.leave(self.capacity - 2 * length, self.sequences, count)
                    left[length] -= 2 * count
                else:
                    count = min(left[length], left[other])
                    self.put(length, count, self.sequences, 1, 0)
                    self.put(other, count, self.sequences, 1, length)
                    self.leave(self.capacity - length - other, self.sequences, count)
                    left[length] -= count
                    left[other] -= count
                self.sequences += count
            lengths.pop()

    def fill(self, length: int, count: int) -> None:
        at = bisect_left(self.gaps, length)
        todo = self.gaps[at:]
        for gap in todo:
            if not count:
                return
            runs, each = self.runs.pop(gap), gap // length
            self.gaps.remove(gap)
            for sequence, many in runs:
                count -= self.place(length, min(count, many * each), sequence, many, each, gap)
        if count:
            each = self.capacity // length
            many = -(-count // each)
            self.sequences += many
            self.place(length, count, self.sequences - many, many, each, self.capacity)

    def place(self, length: int, count: int, sequence: int, many: int, each: int, gap: int) -> int:
        """``count`` pieces into a run of ``many`` sequences, ``each`` to one."""
        whole, rest = divmod(count, each)
        if whole:
            self.put(length, whole * each, sequence, each, self.capacity - gap)
            self.leave(gap - each * length, sequence, whole)
        if rest:
            self.put(length, rest, sequence + whole, rest, self.capacity - gap)
            self.leave(gap - rest * length, sequence + whole, 1)
        self.leave(gap, sequence + whole + bool(rest), many - whole - bool(rest))
        return count


def assigned(pieces: DataFrame, plan: Plan) -> DataFrame:
    """``pieces`` (length, rank, ...) with sequence_id and offset."""
    table = np.array(sorted(plan.segments), np.int64).reshape(-1, 6)
    wide = int(table[:, 1].max(initial=0)) + int(table[:, 2].max(initial=0)) + 1
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = table[:, 0].astype(object) * wide + table[:, 1] if wide > 2**50 else table[:, 0] * wide + table[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = table[np.searchsorted(keys, length * wide + rank, side="right") - 1]
            nth = rank - at[:, 1]
            sequence, offset = at[:, 3] + nth // at[:, 4], at[:, 5] + nth % at[:, 4] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return pieces.select(*names, "rank").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(documents: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = documents.sparkSession
    pieces = written(spark, tokenised(documents, vocabulary, capacity, end_id), "pieces")
    held = pieces.groupBy("length", "part").agg(F.count("*").alias("many"))
    plan = Plan({r["length"]: r["many"] for r in held.groupBy("length").agg(F.sum("many").alias("many")).collect()}, capacity)
    before = F.coalesce(F.sum("many").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = held.select("length", "part", before.alias("base"))
    nth = F.row_number().over(Window.partitionBy("part", "length").orderBy("place")) - 1
    ranked = pieces.withColumn("nth", nth).join(base, ["part", "length"]).withColumn("rank", (F.col("base") + F.col("nth")).cast("long"))
    return assigned(ranked, plan)
