"""Many patterns on each text.

A ``PatternSet`` is an ordered list of compiled patterns on the driver; its column
functions are unrolled into Spark's own expressions where every member has a native
form and there are few, else run in one Arrow-batched function.  There an index of the
literals that members require leaves few of a large set for a text; regular members
without a native form are merged into one program that scans the text once; the others
are matched one by one.  A table of patterns is joined to texts in one pass, in blocks
of bounded size if it is very large.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import columns
from ..plans.pattern import Options, Pattern, compile, compile_bytes
from . import matching, vm

#: Members that are unrolled into expressions; rows of a table of patterns that a task holds at once.
UNROLLED, BLOCK_PATTERNS = 64, 65_536
#: Members from which on an index of their literals pays, and the shortest literal in it.
INDEXED, LITERAL = 8, 2


@dataclass(frozen=True)
class PatternSet:
    members: tuple[Pattern, ...]

    @property
    def patterns(self) -> list[str]:
        return [p.source for p in self.members]

    def __len__(self) -> int:
        return len(self.members)

    @property
    def empty(self) -> bool:
        return not self.members

    @property
    def byte_mode(self) -> bool:
        return any(p.byte_mode for p in self.members)

    @cached_property
    def native(self) -> bool:
        return len(self.members) <= UNROLLED and all(p.java is not None for p in self.members)

    @cached_property
    def index(self) -> tuple[object, tuple[int, ...]] | None:
        """(automaton over required literals, members without one); None for small sets and octets."""
        held = [() if p.byte_mode or len(p.required) < LITERAL else (p.required,) for p in self.members]
        if sum(map(len, held)) < INDEXED:
            return None
        try:
            import ahocorasick
        except ImportError:
            return None
        by_text: dict[str, list[int]] = {}
        for i, found in enumerate(held):
            for text in found:
                by_text.setdefault(text, []).append(i)
        automaton = ahocorasick.Automaton()
        for text, ids in by_text.items():
            automaton.add_word(text, tuple(ids))
        automaton.make_automaton()
        return automaton, tuple(i for i, found in enumerate(held) if not found)

    @cached_property
    def merged(self) -> tuple[list[tuple], dict[int, int]]:
        """The regular members without a form in the standard library's engine, as one program."""
        return vm.merged({i: p.program for i, p in enumerate(self.members) if not p.advanced and p.python is None})

    def __getstate__(self) -> tuple[Pattern, ...]:
        return self.members

    def __setstate__(self, members: tuple[Pattern, ...]) -> None:
        self.__dict__["members"] = members

    # On one text.

    def possible(self, text) -> list[int]:
        """The members that a look for what every match must hold leaves, in order."""
        if self.index is None:
            return [i for i, p in enumerate(self.members) if p.byte_mode or not p.required or p.required in text]
        automaton, others = self.index
        return sorted({i for _, ids in automaton.iter(text) for i in ids}.union(others)) if len(automaton) else list(others)

    def _by_scan(self, some: list[int], text, start: int, end: int | None, any_one: bool, clock: vm.Clock | None) -> set[int]:
        code, entries = self.merged
        held = {i: entries[i] for i in some if i in entries}
        if not held:
            return set()
        stop = matching.bounds(self.members[some[0]], text, start, end)
        return vm.members(code, held, text, start, stop, any_one=any_one, clock=clock)

    def matches(self, text, start: int = 0, end: int | None = None, timeout: float | None = None) -> list[int]:
        """The indexes of the members that match."""
        some = self.possible(text)
        scanned = self._by_scan(some, text, start, end, False, vm.Clock(timeout) if timeout else None)
        more = {} if timeout is None else {"timeout": timeout}
        return [i for i in some if i in scanned or i not in self.merged[1] and matching.is_match(self.members[i], text, start, end, **more)]

    def any(self, text, start: int = 0, end: int | None = None, timeout: float | None = None) -> bool:
        some = self.possible(text)
        more = {} if timeout is None else {"timeout": timeout}
        if any(matching.is_match(self.members[i], text, start, end, **more) for i in some if i not in self.merged[1]):
            return True
        return bool(self._by_scan(some, text, start, end, True, vm.Clock(timeout) if timeout else None))

    def search(self, text, start: int = 0, end: int | None = None, timeout: float | None = None) -> tuple[int, matching.Match] | None:
        """The member with the earliest match (of equal starts the first), and the match."""
        best = None
        more = {} if timeout is None else {"timeout": timeout}
        for i in self.possible(text):
            found = matching.find(self.members[i], text, start, end, **more)
            if found and (best is None or found.start < best[1].start):
                best = i, found
        return best


def compile_set(patterns: Iterable[str], *, byte_mode: bool = False, **options) -> PatternSet:
    """A set of patterns under shared options; the size limit holds for all together."""
    if isinstance(patterns, (str, bytes)):
        raise TypeError("a set needs a sequence of patterns")
    held, size = [], 0
    shared = Options(**options)
    made = compile_bytes if byte_mode else compile
    for source in patterns:
        member = made(source, **options)
        size += len(member.program.code)
        if not member.advanced and size > shared.size_limit:
            from ..plans.errors import PatternSyntaxError

            raise PatternSyntaxError(source, 0, "the compiled set is too large")
        held.append(member)
    return PatternSet(tuple(held))


def compile_byte_set(patterns: Iterable[str], **options) -> PatternSet:
    return compile_set(patterns, byte_mode=True, **options)


def set_matches(text: Column, patterns: PatternSet, start=0, end=None, *, engine: str | None = None, timeout: float | None = None) -> Column:
    """array<int>: the sorted indexes of all members that match."""
    whole, place = columns.ranged(start, end)
    if whole and engine != "exact" and timeout is None and patterns.native:
        hits = F.array(*(F.when(columns.is_match(text, p), i) for i, p in enumerate(patterns.members))).cast("array<int>")
        return F.when(text.isNotNull(), F.filter(hits, lambda x: x.isNotNull()))
    return columns.exact(text, lambda t, a, b: patterns.matches(t, a, b, timeout), "array<int>", pa.list_(pa.int32()), *place)


def set_matches_bits(text: Column, patterns: PatternSet, start=0, end=None, *, engine: str | None = None, timeout: float | None = None) -> Column:
    """array<boolean>: for each member whether it matches."""
    whole, place = columns.ranged(start, end)
    if whole and engine != "exact" and timeout is None and patterns.native:
        return F.when(text.isNotNull(), F.array(*(columns.is_match(text, p) for p in patterns.members)).cast("array<boolean>"))

    def run(t, a, b):
        hits = set(patterns.matches(t, a, b, timeout))
        return [i in hits for i in range(len(patterns))]

    return columns.exact(text, run, "array<boolean>", pa.list_(pa.bool_()), *place)


def set_match_p(text: Column, patterns: PatternSet, start=0, end=None, *, engine: str | None = None, timeout: float | None = None) -> Column:
    """Does any member match?"""
    whole, place = columns.ranged(start, end)
    if whole and engine != "exact" and timeout is None and patterns.native:
        found = F.lit(False)
        for p in patterns.members:
            found = found | columns.is_match(text, p)
        return F.when(text.isNotNull(), found)
    return columns.exact(text, lambda t, a, b: patterns.any(t, a, b, timeout), "boolean", pa.bool_(), *place)


def set_search(text: Column, patterns: PatternSet, start=0, end=None, *, timeout: float | None = None) -> Column:
    """struct<pattern_index, match>: the earliest match, of equal starts the first member's."""
    probe = patterns.members[0] if patterns.members else None
    if probe is None:
        return F.lit(None).cast("struct<pattern_index:int,match:struct<start:int,end:int>>")
    _, spark_type, _, arrow = columns.kinds(probe)

    def run(t, a, b):
        found = patterns.search(t, a, b, timeout)
        return None if found is None else {"pattern_index": found[0], "match": columns.record(found[1], t)}

    return columns.exact(text, run, f"struct<pattern_index:int,match:{spark_type}>", pa.struct([("pattern_index", pa.int32()), ("match", arrow)]), *columns.ranged(start, end)[1])


def match_table(texts: DataFrame, patterns: DataFrame, text: str = "text", *, engine: str | None = None, **options) -> DataFrame:
    """Every text row with the ``pattern_id`` of each row of ``patterns`` (pattern_id, pattern) that matches.

    The texts are never shuffled.  Distinct patterns come to the driver and go with the
    tasks, which read the texts in one pass; of a table of more than BLOCK_PATTERNS
    distinct rows a block at a time, in the order of their ids, a pass for each block.
    A row that stands n times gives n rows.  A text without a match gives none; NULL
    texts and patterns match nothing.
    """
    rows = patterns.select(F.col("pattern_id").cast("long").alias("pattern_id"), "pattern").filter("pattern IS NOT NULL AND pattern_id IS NOT NULL").groupBy("pattern_id", "pattern").agg(F.count("*").alias("n")).orderBy("pattern_id", "pattern")
    out, last = None, None
    while True:
        block = (rows if last is None else rows.filter((F.col("pattern_id") > last[0]) | (F.col("pattern_id") == last[0]) & (F.col("pattern") > last[1]))).limit(BLOCK_PATTERNS).collect()
        if not block and out is not None:
            return out
        ids: dict[str, list[int]] = {}
        for r in block:
            ids.setdefault(r["pattern"], []).extend([r["pattern_id"]] * r["n"])
        part = _matched(texts, compile_set(ids, **options), list(ids.values()), text, engine)
        out = part if out is None else out.unionByName(part)
        if len(block) < BLOCK_PATTERNS:
            return out
        last = (block[-1]["pattern_id"], block[-1]["pattern"])


def _matched(texts: DataFrame, found: PatternSet, ids: list[list[int]], text: str, engine: str | None) -> DataFrame:
    """ids: the pattern_ids that each member stands for."""
    if found.native and engine != "exact":
        hits = F.array(*(F.when(columns.is_match(F.col(text), p), F.array(*map(F.lit, i))) for i, p in zip(ids, found.members))).cast("array<array<bigint>>")
        return texts.withColumn("pattern_id", F.explode(F.flatten(F.filter(hits, lambda x: x.isNotNull()))))
    names = texts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, hit = [], []
            for row, value in enumerate(batch.column(text).to_pylist()):
                if value is not None:
                    for member in found.matches(value):
                        at += [row] * len(ids[member])
                        hit += ids[member]
            rows = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(hit, pa.int64())], [*names, "pattern_id"])

    return texts.mapInArrow(run, StructType([*texts.schema.fields, StructField("pattern_id", LongType())]))


def hits_per_pattern(texts: DataFrame, patterns: DataFrame, text: str = "text", **options) -> DataFrame:
    """(pattern_id, hits): how many texts each pattern matches, zeros too."""
    # Counted where the texts are, then added up: a row for each pattern and task is shuffled.
    hits = match_table(texts.select(text), patterns, text, **options).groupBy("pattern_id").agg(F.count("*").alias("hits"))
    return patterns.select(F.col("pattern_id").cast("long").alias("pattern_id")).distinct().join(hits, "pattern_id", "left").select("pattern_id", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"))


__all__ = ["PatternSet", "compile_byte_set", "compile_set", "hits_per_pattern", "match_table", "set_match_p", "set_matches", "set_matches_bits", "set_search"]
