"""Matching texts that arrive in chunks.

Rows are (key, seq, chunk, is_last).  Buffered: a key's chunks are kept until its end
marker, then matched as one text; every pattern will do.  Incremental: only the live
search is kept, and a match is reported as soon as no further input can change it.

Both come as batch operators and as stateful streaming operators with the same
results.  Within a micro-batch a key's chunks are put in order of seq; a seq that has
been read is ignored (sources may deliver twice), and one that is ahead of a gap waits
in the state until the gap is filled.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..functions import columns
from ..operators import matching
from ..plans.pattern import Pattern, as_pattern, streamable


def assembled(chunks: DataFrame, key: str = "stream_id") -> DataFrame:
    """(key, text): each key's chunks as one text, in order of seq."""
    held = chunks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", "chunk"))).alias("held"))
    binary = dict(chunks.dtypes)["chunk"] == "binary"
    if binary:
        return held.select(key, F.unhex(F.array_join(F.transform("held", lambda x: F.hex(x["chunk"])), "")).alias("text"))
    return held.select(key, F.array_join(F.transform("held", lambda x: x["chunk"]), "").alias("text"))


def all_stream_matches(chunks: DataFrame, pattern: str | Pattern, key: str = "stream_id", start: int = 0, *, overlapping: bool = False, **options) -> DataFrame:
    """(key, nth, match): the matches of each key's whole text."""
    found = columns.all_matches(F.col("text"), pattern, start, overlapping=overlapping, **options)
    return assembled(chunks, key).select(key, F.posexplode(found).alias("nth", "match"))


def scan_stream(chunks: DataFrame, pattern: str | Pattern, key: str = "stream_id", start: int = 0, **options) -> DataFrame:
    """(key, match): the first match of each key's whole text, NULL if there is none."""
    return assembled(chunks, key).select(key, columns.scan(F.col("text"), pattern, start, **options).alias("match"))


class Buffer:
    """One key's chunks, until the end."""

    def __init__(self, pattern: Pattern, start: int = 0, overlapping: bool = False, timeout: float | None = None):
        self.pattern, self.start, self.overlapping, self.timeout = pattern, start, overlapping, timeout
        self.reset()

    def reset(self) -> None:
        self.parts: list = []
        self.finished, self.results, self.delivered = False, None, 0

    @property
    def text(self):
        return (b"" if self.pattern.byte_mode else "").join(self.parts)

    @property
    def length(self) -> int:
        return sum(map(len, self.parts))

    def feed(self, chunk, start: int = 0, end: int | None = None) -> None:
        if self.finished:
            raise ValueError("the stream has ended")
        stop = matching.bounds(self.pattern, chunk, start, end)
        self.parts.append(chunk[start:stop])

    def finish(self, deliver: Callable[[matching.Match], object] | None = None) -> list[matching.Match]:
        """All matches; again the same ones if called again.  A failure leaves the stream open.

        deliver: called with each match in order, once; if it raises, the next call goes
        on with the first match that it has not taken.
        """
        if self.results is None:
            more = {} if self.timeout is None else {"timeout": self.timeout}
            self.results = list(matching.each(self.pattern, self.text, self.start, None, self.overlapping, **more))
            self.finished = True
        while deliver is not None and self.delivered < len(self.results):
            deliver(self.results[self.delivered])
            self.delivered += 1
        return self.results


class Incremental:
    """One key's live search; it keeps no input but what an undecided match needs."""

    def __init__(self, pattern: Pattern, start: int = 0, timeout: float | None = None):
        streamable(pattern)
        self.pattern, self.start, self.timeout = pattern, start, timeout
        self.reset()

    def reset(self) -> None:
        self.scanner, self.finished, self.last = matching.scanner(self.pattern, self.start), False, None

    @property
    def position(self) -> int:
        return self.scanner.at + len(self.scanner.partial)

    def feed(self, chunk) -> list[matching.Match]:
        """The matches that are now certain; a failure leaves the search as it was."""
        if self.finished:
            raise ValueError("the stream has ended")
        matching.bounds(self.pattern, chunk, 0, None)
        trial = self.scanner.copy()
        found = [matching.scanned(s) for s in trial.feed(chunk, self.clock())]
        self.scanner = trial
        return found

    def clock(self) -> matching.Clock | None:
        return None if self.timeout is None else matching.Clock(self.timeout)

    def finish(self) -> list[matching.Match]:
        """The matches that the end makes certain; again the same ones if called again."""
        if not self.finished:
            trial = self.scanner.copy()
            self.last = [matching.scanned(s) for s in trial.finish(self.clock())]
            self.scanner, self.finished = trial, True
        return list(self.last)


class Keyed:
    """A key's state: what is being matched, the next seq, and chunks ahead of a gap."""

    def __init__(self, matcher: Buffer | Incremental):
        self.matcher, self.next, self.waiting, self.ended = matcher, 0, {}, False

    def read(self, rows: list[tuple]) -> list[matching.Match]:
        """rows of (seq, chunk, is_last); the matches that become certain."""
        for seq, chunk, last in rows:
            if seq >= self.next and not self.ended:
                self.waiting[seq] = (chunk, last)
        out: list[matching.Match] = []
        while not self.ended and self.next in self.waiting:
            chunk, last = self.waiting.pop(self.next)
            self.next += 1
            if chunk is not None:
                out += self.matcher.feed(chunk) or []
            if last:
                out += self.matcher.finish()
                self.ended, self.waiting = True, {}
        return out


def _stateful(chunks: DataFrame, make, key: str, binary: bool, keep_ms: int | None) -> DataFrame:
    """applyInPandasWithState over a stream of chunks.

    Of an ended key only a bare mark stays, so that chunks delivered again are ignored;
    with ``keep_ms`` it goes so much processing time later (such a query then runs batches
    without data, as Spark's timeouts need).
    """
    out = StructType([chunks.schema[key], StructField("start", T_INT), StructField("end", T_INT), StructField("groups", T_SPANS)])

    def step(ident: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        if state.exists and state.get[0] is None:
            if keep_ms:
                state.setTimeoutDuration(keep_ms)
            return
        held = pickle.loads(state.get[0]) if state.exists else Keyed(make())
        rows = [r for f in frames for r in f[["seq", "chunk", "is_last"]].itertuples(index=False, name=None)]
        found = held.read([(int(s), bytes(c) if binary and c is not None else c, bool(e)) for s, c, e in rows])
        state.update((None if held.ended else pickle.dumps(held),))
        if held.ended and keep_ms:
            state.setTimeoutDuration(keep_ms)
        yield pd.DataFrame({key: [ident[0]] * len(found), "start": [m.start for m in found], "end": [m.end for m in found], "groups": [columns.spans_of(m) for m in found]})

    return chunks.groupBy(key).applyInPandasWithState(step, out, "state binary", "append", GroupStateTimeout.ProcessingTimeTimeout if keep_ms else GroupStateTimeout.NoTimeout)


def buffered_stream(chunks: DataFrame, pattern: str | Pattern, key: str = "stream_id", start: int = 0, *, overlapping: bool = False, keep_ms: int | None = None, **options) -> DataFrame:
    """A stream of (key, start, end, groups): the matches of each key's whole text, once its end has come."""
    p = as_pattern(pattern, **options)
    return _stateful(chunks, lambda: Buffer(p, start, overlapping), key, p.byte_mode, keep_ms)


def incremental_stream(chunks: DataFrame, pattern: str | Pattern, key: str = "stream_id", start: int = 0, *, keep_ms: int | None = None, **options) -> DataFrame:
    """A stream of (key, start, end, groups): each match once no further input can change it."""
    p = as_pattern(pattern, **options)
    streamable(p)
    return _stateful(chunks, lambda: Incremental(p, start), key, p.byte_mode, keep_ms)


def deliver(found: DataFrame, take: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Hands every micro-batch of a stream of matches to ``take(matches, batch number)``.

    If ``take`` raises, the query fails; started again with the same checkpoint it goes on
    with the first batch that has not been taken, under the same number, so a sink that
    remembers the numbers gets each match once.
    """
    return found.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def incremental_matches(chunks: DataFrame, pattern: str | Pattern, key: str = "stream_id", start: int = 0, **options) -> DataFrame:
    """The batch form: (key, start, end, groups) from chunks in order, a chunk at a time.

    A key's chunks are sorted on disk by Spark and stream past; only the live search is
    in memory, whatever the text's length.
    """
    p = as_pattern(pattern, **options)
    streamable(p)
    schema = StructType([chunks.schema[key], StructField("start", T_INT), StructField("end", T_INT), StructField("groups", T_SPANS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, live = None, None

        def rows(ident, found):
            return [(ident, m.start, m.end, columns.spans_of(m)) for m in found]

        def table(out):
            ids, starts, ends, groups = list(zip(*out)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(ids, key_type), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(groups, columns.SPANS)], [key, "start", "end", "groups"])

        key_type = None
        for batch in batches:
            key_type = batch.schema.field(key).type
            out = []
            for ident, chunk in zip(batch.column(key).to_pylist(), batch.column("chunk").to_pylist()):
                if live is None or ident != now:
                    if live is not None:
                        out += rows(now, live.finish())
                    now, live = ident, Incremental(p, start)
                if chunk is not None:
                    out += rows(now, live.feed(chunk))
            yield table(out)
        if live is not None:
            yield table(rows(now, live.finish()))

    ordered = chunks.filter(F.col(key).isNotNull()).select(key, "seq", "chunk").repartition(key).sortWithinPartitions(key, "seq")
    return ordered.select(key, "chunk").mapInArrow(run, schema)


T_INT = IntegerType()
T_SPANS = ArrayType(StructType([StructField("start", T_INT), StructField("end", T_INT)]))
