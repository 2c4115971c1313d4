"""Matching as Column expressions.

Every function takes a column of texts and a pattern (text or compiled) and plans on
the driver: Spark's own expressions where the pattern has a provably equal form there,
else one Arrow-batched function that runs the exact engines.  ``engine`` can ask for
"native" or "exact"; the results are the same.  NULL texts give NULL.

Offsets are code points from 0, half-open; octets for byte patterns, whose columns are
binary.  ``start`` and ``end`` are numbers or columns.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from ..operators import matching
from ..operators.matching import Match
from ..plans import analysis
from ..plans.errors import LimitError, NotTranslatable
from ..plans.pattern import SPECIAL, Pattern, as_pattern

SPAN = "struct<start:int,end:int>"
#: A literal shorter than this is no use as a guard.
GUARD = 3


def kinds(pattern: Pattern) -> tuple[str, str, pa.DataType, pa.DataType]:
    """(text type, match type) in Spark's words and in Arrow's."""
    text, arrow = ("binary", pa.binary()) if pattern.byte_mode else ("string", pa.string())
    group = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", arrow)])
    match = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", arrow), ("groups", pa.list_(group)), ("mark", pa.string()), ("edit_distance", pa.int32())])
    return text, f"struct<start:int,end:int,text:{text},groups:array<struct<start:int,end:int,text:{text}>>,mark:string,edit_distance:int>", arrow, match


def record(found: Match | None, text) -> dict | None:
    """A match as a row value; a group that took no part is NULL."""
    if found is None:
        return None
    groups = [None if s is None else {"start": s[0], "end": s[1], "text": text[s[0] : s[1]]} for s in found.spans]
    return {"start": found.start, "end": found.end, "text": groups[0]["text"], "groups": groups, "mark": found.mark, "edit_distance": found.edits}


def spans_of(found: Match | None) -> list | None:
    return None if found is None else [None if s is None else {"start": s[0], "end": s[1]} for s in found.spans]


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def exact(text: Column, fn: Callable, returns: str | DataType, arrow: pa.DataType, *more: Column) -> Column:
    """``fn(text, *more)`` row by row in Arrow batches; NULL text gives NULL."""

    def run(*columns: pa.Array) -> pa.Array:
        lists = [c.to_pylist() for c in columns]
        return pa.array([None if row[0] is None else fn(*row) for row in zip(*lists)], arrow)

    if len(more) == 0:
        return F.arrow_udf(lambda a: run(a), returns)(text)
    if len(more) == 1:
        return F.arrow_udf(lambda a, b: run(a, b), returns)(text, *more)
    return F.arrow_udf(lambda a, b, c: run(a, b, c), returns)(text, *more)


def candidates(text: Column, p: Pattern) -> Column:
    """The texts that can match at all, NULL for the rest: those never reach Python's loops."""
    return text if len(p.required) < GUARD else F.when(text.contains(p.required), text)


def otherwise(found: Column, text: Column, p: Pattern, value: Column) -> Column:
    """``value`` for the texts that were no candidates."""
    return found if len(p.required) < GUARD else F.when(text.isNotNull(), F.coalesce(found, value))


def ranged(start, end) -> tuple[bool, tuple[Column, Column]]:
    """Whether the range is the whole text, and its columns."""
    column = lambda x: x if isinstance(x, Column) else F.lit(x).cast("int")
    return (not isinstance(start, Column) and start == 0 and end is None), (column(start), column(end))


def native(pattern: Pattern, whole: bool, engine: str | None) -> str | None:
    """The pattern for Spark's expressions, if they may be used."""
    if engine == "exact" or not whole:
        return None
    if pattern.java is None and engine == "native":
        raise NotTranslatable(pattern.source)
    return pattern.java


# --- predicates ---------------------------------------------------------------


def is_match(text: Column, pattern: str | Pattern, start=0, end=None, *, engine: str | None = None, timeout: float | None = None, **options) -> Column:
    """Is there a match?  Anchored literals become comparisons that reach the scan.

    timeout: seconds for each text, by the exact engine; beyond them the job fails.
    """
    p = as_pattern(pattern, **options)
    whole, place = ranged(start, end)
    if timeout is not None:
        return exact(text, lambda t, a, b: matching.is_match(p, t, a, b, timeout=timeout), "boolean", pa.bool_(), *place)
    java = native(p, whole, engine)
    if java is None:
        if whole:
            return otherwise(exact(candidates(text, p), lambda t: matching.is_match(p, t), "boolean", pa.bool_()), text, p, F.lit(False))
        return exact(text, lambda t, a, b: matching.is_match(p, t, a, b), "boolean", pa.bool_(), *place)
    plain = analysis.anchored_literal(p.node)
    if plain:
        return {"equals": lambda: text == plain[1], "prefix": lambda: text.startswith(plain[1]), "suffix": lambda: text.endswith(plain[1]), "contains": lambda: text.contains(plain[1])}[plain[0]]()
    guard, java = p.required, p.run_java
    return text.contains(guard) & text.rlike(java) if len(guard) >= GUARD else text.rlike(java)


is_match_at = is_match


def full_match_p(text: Column, pattern: str | Pattern, start=0, end=None, *, engine: str | None = None, **options) -> Column:
    """Does some path match the whole range?"""
    p = as_pattern(pattern, **options)
    whole, place = ranged(start, end)
    java = None if p.advanced else native(p, whole, engine)
    if java is None:
        return exact(text, lambda t, a, b: matching.full_match(p, t, a, b) is not None, "boolean", pa.bool_(), *place)
    held = analysis.literal_text(p.node)
    return text == held if held is not None else text.rlike(rf"\A(?:{java})\z")


# --- one match ----------------------------------------------------------------


def _one(fn: Callable):
    def column(text: Column, pattern: str | Pattern, start=0, end=None, *, timeout: float | None = None, **options) -> Column:
        p = as_pattern(pattern, **options)
        _, spark_type, _, arrow = kinds(p)
        more = {} if timeout is None else {"timeout": timeout}
        return exact(candidates(text, p), lambda t, a, b: record(fn(p, t, a, b, **more), t), spark_type, arrow, *ranged(start, end)[1])

    return column


scan = _one(matching.find)
scan.__doc__ = "The leftmost match, by priority, as a MATCH struct; NULL if there is none."
scan_at = captures = captures_at = match = scan
longest_match = _one(matching.longest)
full_match = _one(matching.full_match)
run_advanced = _one(lambda p, t, a, b, timeout=None: matching.advanced(p, t, a, b, clock=matching.Clock(timeout) if timeout else None))


def shortest_match(text: Column, pattern: str | Pattern, start=0, end=None, *, timeout: float | None = None, **options) -> Column:
    """The earliest end at the leftmost start."""
    p = as_pattern(pattern, **options)
    more = {} if timeout is None else {"timeout": timeout}
    return exact(candidates(text, p), lambda t, a, b: matching.shortest(p, t, a, b, **more), "int", pa.int32(), *ranged(start, end)[1])


def captures_spans(text: Column, pattern: str | Pattern, start=0, end=None, *, timeout: float | None = None, **options) -> Column:
    """The spans of the first match's groups: array<struct<start,end>>, NULL where one took no part."""
    p = as_pattern(pattern, **options)
    more = {} if timeout is None else {"timeout": timeout}
    return exact(candidates(text, p), lambda t, a, b: spans_of(matching.find(p, t, a, b, **more)), f"array<{SPAN}>", SPANS, *ranged(start, end)[1])


def match_text(text: Column, pattern: str | Pattern, *, engine: str | None = None, **options) -> Column:
    """The first match's text; NULL if there is none."""
    p = as_pattern(pattern, **options)
    java = None if p.nullable else native(p, True, engine)  # the native form takes an empty match for none
    if java is None:
        kind, _, arrow, _ = kinds(p)
        return exact(candidates(text, p), lambda t: None if (m := matching.find(p, t)) is None else m.string(t), kind, arrow)
    return F.regexp_substr(text, F.lit(java))


def match_start(text: Column, pattern: str | Pattern, *, engine: str | None = None, **options) -> Column:
    """Where the first match starts."""
    p = as_pattern(pattern, **options)
    java = None if p.nullable else native(p, True, engine)
    if java is None:
        return exact(candidates(text, p), lambda t: None if (m := matching.find(p, t)) is None else m.start, "int", pa.int32())
    return F.when(text.rlike(java), F.length(F.get(F.split(text, java, 2), F.lit(0))))


def match_end(text: Column, pattern: str | Pattern, *, engine: str | None = None, **options) -> Column:
    """Where the first match ends."""
    p = as_pattern(pattern, **options)
    java = None if p.nullable else native(p, True, engine)
    if java is None:
        return exact(candidates(text, p), lambda t: None if (m := matching.find(p, t)) is None else m.end, "int", pa.int32())
    return match_start(text, p) + F.length(F.regexp_substr(text, F.lit(java)))


def match_group(text: Column, pattern: str | Pattern, key: int | str, *, engine: str | None = None, **options) -> Column:
    """A group's text in the first match, by index or name; NULL if it took no part."""
    p = as_pattern(pattern, **options)
    indexes = p.group_indexes(key)
    java = native(p, True, engine) if p.static_capture_count == p.capture_count and len(indexes) == 1 else None
    if java is None:
        kind, _, arrow, _ = kinds(p)

        def run(t):
            found = matching.find(p, t)
            span = found and found.span(p, key)
            return None if span is None else t[span[0] : span[1]]

        return exact(candidates(text, p), run, kind, arrow)
    return F.when(text.rlike(java), F.regexp_extract(text, java, indexes[0]))


def match_group_span(text: Column, pattern: str | Pattern, key: int | str, **options) -> Column:
    """A group's span in the first match: struct<start,end>."""
    p = as_pattern(pattern, **options)
    indexes = p.group_indexes(key)
    spans = captures_spans(text, p)
    return F.coalesce(*(F.get(spans, F.lit(i)) for i in indexes))


def match_captures(text: Column, pattern: str | Pattern, *, engine: str | None = None, **options) -> Column:
    """The texts of all groups of the first match, the whole first: array<string>."""
    p = as_pattern(pattern, **options)
    java = native(p, True, engine) if p.static_capture_count == p.capture_count else None
    if java is None:
        kind, _, arrow, _ = kinds(p)
        return exact(candidates(text, p), lambda t: None if (m := matching.find(p, t)) is None else m.captures(t), f"array<{kind}>", pa.list_(arrow))
    return F.when(text.rlike(java), F.array(*(F.regexp_extract(text, java, i) for i in range(p.capture_count))))


def captures_struct(text: Column, pattern: str | Pattern, **options) -> Column:
    """The named groups of the first match as a struct with a field for each name."""
    p = as_pattern(pattern, **options)
    held = match_captures(text, p)
    names = list(dict.fromkeys(n for n in p.names if n))
    return F.when(held.isNotNull(), F.struct(*(F.coalesce(*(F.get(held, F.lit(i)) for i in p.group_indexes(n))).alias(n) for n in names)))


# --- all matches --------------------------------------------------------------


def all_matches(text: Column, pattern: str | Pattern, start=0, end=None, *, overlapping: bool = False, timeout: float | None = None, **options) -> Column:
    """array<MATCH>, left to right; an empty match right after another match is left out."""
    p = as_pattern(pattern, **options)
    _, spark_type, _, arrow = kinds(p)
    more = {} if timeout is None else {"timeout": timeout}
    found = exact(candidates(text, p), lambda t, a, b: [record(m, t) for m in matching.each(p, t, a, b, overlapping, **more)], f"array<{spark_type}>", pa.list_(arrow), *ranged(start, end)[1])
    return otherwise(found, text, p, F.array().cast(f"array<{spark_type}>"))


def all_matches_overlapping(text: Column, pattern: str | Pattern, start=0, end=None, **options) -> Column:
    """array<MATCH> where each search starts one unit after the last match's start."""
    return all_matches(text, pattern, start, end, overlapping=True, **options)


def all_texts(text: Column, pattern: str | Pattern, *, overlapping: bool = False, engine: str | None = None, **options) -> Column:
    """The texts of all matches."""
    p = as_pattern(pattern, **options)
    java = None if p.nullable or overlapping else native(p, True, engine)
    if java is None:
        kind, _, arrow, _ = kinds(p)
        found = exact(candidates(text, p), lambda t: [m.string(t) for m in matching.each(p, t, overlapping=overlapping)], f"array<{kind}>", pa.list_(arrow))
        return otherwise(found, text, p, F.array().cast(f"array<{kind}>"))
    return F.regexp_extract_all(text, F.lit(java), F.lit(0))


def all_spans(text: Column, pattern: str | Pattern, *, overlapping: bool = False, engine: str | None = None, **options) -> Column:
    """The spans of all matches: array<struct<start,end>>."""
    p = as_pattern(pattern, **options)
    found = exact(candidates(text, p), lambda t: [{"start": m.start, "end": m.end} for m in matching.each(p, t, overlapping=overlapping)], f"array<{SPAN}>", SPANS)
    return otherwise(found, text, p, F.array().cast(f"array<{SPAN}>"))


def count_matches(text: Column, pattern: str | Pattern, *, overlapping: bool = False, engine: str | None = None, **options) -> Column:
    """How many matches there are."""
    p = as_pattern(pattern, **options)
    java = None if p.nullable or overlapping else native(p, True, engine)
    if java is None:
        found = exact(candidates(text, p), lambda t: sum(1 for _ in matching.each(p, t, overlapping=overlapping)), "int", pa.int32())
        return otherwise(found, text, p, F.lit(0))
    guard = p.required
    found = F.regexp_count(text, F.lit(java))
    return F.when(text.contains(guard), found).when(text.isNotNull(), 0) if len(guard) >= GUARD else found


# --- splitting ----------------------------------------------------------------


def _split(text: Column, p: Pattern, n: int | None, mode: str, start, end, timeout: float | None = None) -> Column:
    kind, _, arrow, _ = kinds(p)
    more = {} if timeout is None else {"timeout": timeout}
    return exact(text, lambda t, a, b: matching.split(p, t, n, mode=mode, start=a, end=b, **more), f"array<{kind}>", pa.list_(arrow), *ranged(start, end)[1])


def _split_native(p: Pattern, start, end, engine: str | None, timeout: float | None) -> str | None:
    return None if p.nullable or timeout is not None else native(p, ranged(start, end)[0], engine)


def split(text: Column, pattern: str | Pattern, start=0, end=None, *, engine: str | None = None, timeout: float | None = None, **options) -> Column:
    """The fields between the matches."""
    p = as_pattern(pattern, **options)
    java = _split_native(p, start, end, engine, timeout)
    return _split(text, p, None, "plain", start, end, timeout) if java is None else F.split(text, java, -1)


def split_n(text: Column, pattern: str | Pattern, n: int, start=0, end=None, *, engine: str | None = None, timeout: float | None = None, **options) -> Column:
    """At most n fields; none for 0."""
    if not isinstance(n, int) or n < 0:
        raise TypeError("a count must not be negative")
    p = as_pattern(pattern, **options)
    java = _split_native(p, start, end, engine, timeout)
    if java is None:
        return _split(text, p, n, "plain", start, end, timeout)
    return F.split(text, java, n) if n else F.when(text.isNotNull(), F.array().cast("array<string>"))


def split_terminator(text: Column, pattern: str | Pattern, start=0, end=None, *, engine: str | None = None, timeout: float | None = None, **options) -> Column:
    """The fields, without the empty one after a match that ends the text."""
    p = as_pattern(pattern, **options)
    java = _split_native(p, start, end, engine, timeout)
    if java is None:
        return _split(text, p, None, "terminator", start, end, timeout)
    fields = F.split(text, java, -1)
    return F.when((F.size(fields) > 1) & (F.element_at(fields, -1) == ""), F.slice(fields, 1, F.size(fields) - 1)).otherwise(fields)


def split_inclusive(text: Column, pattern: str | Pattern, start=0, end=None, *, engine: str | None = None, timeout: float | None = None, **options) -> Column:
    """The fields, each with the match that ends it."""
    p = as_pattern(pattern, **options)
    java = _split_native(p, start, end, engine, timeout)
    if java is None:
        return _split(text, p, None, "inclusive", start, end, timeout)
    fields, found = F.split(text, java, -1), F.regexp_extract_all(text, F.lit(java), F.lit(0))
    joined = F.zip_with(fields, F.concat(found, F.array(F.lit(""))), lambda a, b: F.concat(a, b))
    return F.when((F.size(found) > 0) & (F.element_at(fields, -1) == ""), F.slice(joined, 1, F.size(found))).otherwise(joined)


# --- replacing ----------------------------------------------------------------


def java_template(p: Pattern, template: str) -> str | None:
    """A template for Spark's expressions; None if a group could be missing."""
    out = ""
    for part in matching.template(p, template):
        if isinstance(part, str):
            out += part.replace("\\", "\\\\").replace("$", "\\$")
        elif len(part) == 1:
            if part[0] and p.static_capture_count != p.capture_count:
                return None
            out += f"${part[0]}"
        elif part:
            return None
    return out


def _digits_follow(p: Pattern, template: str) -> bool:
    """Would a digit after a group number be read as part of it?"""
    parts = matching.template(p, template)
    return any(isinstance(a, list) and a and isinstance(b, str) and b[:1].isdigit() for a, b in zip(parts, parts[1:]))


def replace_all(text: Column, pattern: str | Pattern, replacement, start=0, end=None, *, engine: str | None = None, timeout: float | None = None, **options) -> Column:
    """Every match replaced by a template ($1, $name, ${name}, $$) or by fn(match, text)."""
    return _replace(text, as_pattern(pattern, **options), replacement, None, start, end, engine, timeout)


def replace_n(text: Column, pattern: str | Pattern, replacement, n: int, start=0, end=None, *, engine: str | None = None, timeout: float | None = None, **options) -> Column:
    """At most n matches replaced."""
    if not isinstance(n, int) or n < 0:
        raise TypeError("a count must not be negative")
    return _replace(text, as_pattern(pattern, **options), replacement, n, start, end, engine, timeout)


def replace_first(text: Column, pattern: str | Pattern, replacement, start=0, end=None, *, engine: str | None = None, timeout: float | None = None, **options) -> Column:
    """The first match replaced."""
    return _replace(text, as_pattern(pattern, **options), replacement, 1, start, end, engine, timeout)


def _replace(text: Column, p: Pattern, replacement, n: int | None, start, end, engine: str | None, timeout: float | None) -> Column:
    if not callable(replacement) and type(replacement) is not (bytes if p.byte_mode else str):
        raise TypeError("a replacement must be of the text's type, or callable")
    java = None if p.nullable or callable(replacement) or n not in (None, 1) or timeout is not None else native(p, ranged(start, end)[0], engine)
    if java is not None:
        new = java_template(p, replacement)
        if new is not None and not _digits_follow(p, replacement):
            if n is None:
                return F.regexp_replace(text, F.lit(java), F.lit(new))
            head = F.get(F.split(text, java, 2), F.lit(0))
            plain = matching.template(p, replacement)
            if all(isinstance(x, str) or x in ([], [0]) for x in plain):
                found = F.regexp_substr(text, F.lit(java))
                made = F.concat(F.lit(""), *(F.lit(x) if isinstance(x, str) else found for x in plain if x))
                rest = F.substr(text, F.length(head) + F.length(found) + 1)
                return F.when(text.rlike(java), F.concat(head, made, rest)).otherwise(text)
    kind, _, arrow, _ = kinds(p)
    more = {} if timeout is None else {"timeout": timeout}
    return otherwise(exact(candidates(text, p), lambda t, a, b: matching.replace(p, t, replacement, n, start=a, end=b, **more), kind, arrow, *ranged(start, end)[1]), text, p, text)


# --- others -------------------------------------------------------------------


def escape(text: Column) -> Column:
    """Patterns that match exactly these texts."""
    return F.regexp_replace(text, "([" + "".join("\\" + c for c in SPECIAL) + "])", r"\\$1")


def fuzzy_scan(text: Column, pattern: str | Pattern, max_edits: int = 1, start=0, end=None, *, state_limit: int = matching.STATE_LIMIT, timeout: float | None = None, **options) -> Column:
    """The leftmost match within max_edits edits, there the one of fewest edits, as a MATCH struct."""
    p = as_pattern(pattern, **options)
    if p.advanced:
        matching.fuzzy(p, b"" if p.byte_mode else "")  # the error
    _, spark_type, _, arrow = kinds(p)
    return exact(text, lambda t, a, b: record(matching.fuzzy(p, t, max_edits, a, b, state_limit=state_limit, timeout=timeout), t), spark_type, arrow, *ranged(start, end)[1])


fuzzy_scan_at = fuzzy_match = fuzzy_scan


def match_errors(text: Column, pattern: str | Pattern, *, max_edits: int | None = None, state_limit: int = matching.STATE_LIMIT, **options) -> Column:
    """struct<kind,limit,used> for texts whose match (with max_edits: approximate match) exceeds a budget, NULL for others; never taken for no match."""
    p = as_pattern(pattern, **options)

    def run(t):
        try:
            matching.find(p, t) if max_edits is None else matching.fuzzy(p, t, max_edits, state_limit=state_limit)
        except LimitError as e:
            return {"kind": e.kind, "limit": e.limit, "used": e.used}
        return None

    return exact(text, run, "struct<kind:string,limit:bigint,used:bigint>", pa.struct([("kind", pa.string()), ("limit", pa.int64()), ("used", pa.int64())]))
