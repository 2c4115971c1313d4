"""All operators on one text, with exact semantics: what the batches run row by row.

The standard library's engine does the work where the pattern has a provably equal form
there; otherwise the exact engines do.  Offsets are code points (octets in byte mode).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from ..plans.errors import FuzzyUnsupported
from ..plans.pattern import Pattern, streamable
from . import vm
from .backtrack import Backtracker
from .vm import Clock

Text = str | bytes


@dataclass(frozen=True)
class Match:
    """spans[0] is the whole match; a group that took no part is None."""

    spans: tuple[tuple[int, int] | None, ...]
    mark: str | None = None
    edits: int = 0

    @property
    def start(self) -> int:
        return self.spans[0][0]

    @property
    def end(self) -> int:
        return self.spans[0][1]

    def span(self, pattern: Pattern, key: int | str) -> tuple[int, int] | None:
        """A group's span, by index or name (of several of a name the first that took part)."""
        return next((self.spans[i] for i in pattern.group_indexes(key) if self.spans[i] is not None), None)

    def string(self, text: Text, span: tuple[int, int] | None = None) -> Text:
        a, b = span or self.spans[0]
        return text[a:b]

    def captures(self, text: Text) -> list[Text | None]:
        return [None if s is None else text[s[0] : s[1]] for s in self.spans]


def _match(slots: vm.Slots, mark: str | None = None, edits: int = 0) -> Match:
    return Match(tuple((slots[i], slots[i + 1]) if slots[i] is not None and slots[i + 1] is not None else None for i in range(0, len(slots), 2)), mark, edits)


def bounds(pattern: Pattern, text: Text, start: int, end: int | None) -> int:
    """The end of the range, once text and range have been checked."""
    if isinstance(text, bytes) != pattern.byte_mode or not isinstance(text, (str, bytes)):
        raise TypeError("a pattern over strings needs a string, one over octets a binary value")
    stop = len(text) if end is None else end
    if not isinstance(start, int) or not isinstance(stop, int) or not 0 <= start <= stop <= len(text):
        raise TypeError("the range is not inside the text")
    return stop


def quick_search(pattern: Pattern, text: Text, at: int) -> re.Match | None:
    """The standard library's leftmost match from ``at`` on; a run that the pattern starts with is tried once."""
    if pattern.run_python is None:
        return pattern.python.search(text, at)
    return pattern.python.match(text, at) or pattern.run_python.search(text, at + 1)


def find(pattern: Pattern, text: Text, start: int = 0, end: int | None = None, *, policy: str = "first", must_end: int | None = None, anchored: bool = False, timeout: float | None = None) -> Match | None:
    """A match inside text[start:end]; anchors look at the whole text."""
    stop = bounds(pattern, text, start, end)
    if timeout is not None and not timeout > 0:
        raise TypeError("timeout must be positive")
    clock = Clock(timeout) if timeout is not None else None
    plain = policy == "first" and must_end is None and clock is None and stop == len(text)
    if plain and pattern.python is not None:
        found = pattern.python.match(text, start) if anchored else quick_search(pattern, text, start)
        if found is None:
            return None
        return Match(tuple(None if (s := found.span(i))[0] < 0 else s for i in range(pattern.group_count + 1)))
    if policy != "first" and not anchored and clock is None and stop == len(text) and pattern.python is not None and not pattern.advanced:
        found = quick_search(pattern, text, start)  # the leftmost start
        if found is None:
            return None
        start, anchored = found.start(), True
    if pattern.advanced:
        return advanced(pattern, text, start, stop, policy=policy, must_end=must_end, anchored=anchored, clock=clock)
    slots = vm.run(pattern.program, text, start, stop, anchored=anchored, policy=policy, must_end=must_end, clock=clock)
    return slots and _match(slots)


def advanced(pattern: Pattern, text: Text, start: int = 0, end: int | None = None, *, policy: str = "first", must_end: int | None = None, anchored: bool = False, clock: Clock | None = None) -> Match | None:
    """A match by the backtracking engine, whatever the pattern."""
    stop = bounds(pattern, text, start, end)
    o = pattern.options
    limit = o.step_limit or (o.size_limit if o.size_limit < 1_000 else None)
    engine = Backtracker(pattern.backtracked, text, start, stop, step_limit=limit, nest_limit=o.nest_limit, callout=o.callout, end_is_text_end=o.end_is_text_end, clock=clock)
    found = engine.search(policy, must_end, anchored)
    return found and _match(found.slots, found.mark)


def is_match(pattern: Pattern, text: Text, start: int = 0, end: int | None = None, **more) -> bool:
    return find(pattern, text, start, end, **more) is not None


def full_match(pattern: Pattern, text: Text, start: int = 0, end: int | None = None, **more) -> Match | None:
    stop = bounds(pattern, text, start, end)
    return find(pattern, text, start, stop, must_end=stop, anchored=True, **more)


def shortest(pattern: Pattern, text: Text, start: int = 0, end: int | None = None, **more) -> int | None:
    """The earliest end at the leftmost start."""
    found = find(pattern, text, start, end, policy="shortest", **more)
    return found and found.end


def longest(pattern: Pattern, text: Text, start: int = 0, end: int | None = None, **more) -> Match | None:
    return find(pattern, text, start, end, policy="longest", **more)


def each(pattern: Pattern, text: Text, start: int = 0, end: int | None = None, overlapping: bool = False, **more) -> Iterator[Match]:
    """All matches from left to right.

    An empty match right after another match is left out.  Overlapping: the next search
    starts one unit after the last match's start.
    """
    stop, last = bounds(pattern, text, start, end), -1
    if not more and not overlapping and stop == len(text) and pattern.python is not None:
        yield from _each_fast(pattern, text, start)
        return
    at = start
    while at <= stop:
        found = find(pattern, text, at, end, **more)
        if found is None:
            return
        if overlapping:
            yield found
            at = max(at, found.start) + 1
        elif found.start == found.end == last:
            at = max(at, found.end) + 1
        else:
            yield found
            last = found.end
            at = found.end if found.end > at else at + (found.start == found.end or found.end < at)


def _each_fast(pattern: Pattern, text: Text, start: int) -> Iterator[Match]:
    """The same by the standard library's engine, one search for each match."""
    stop, groups = len(text), range(1, pattern.group_count + 1)
    at, last = start, -1
    while at <= stop:
        found = quick_search(pattern, text, at)
        if found is None:
            return
        whole = a, b = found.span()
        if a != b or b != last:
            yield Match((whole, *(None if (s := found.span(i))[0] < 0 else s for i in groups)))
            last = b
        at = b + (a == b)


def split(pattern: Pattern, text: Text, n: int | None = None, *, mode: str = "plain", start: int = 0, end: int | None = None, **more) -> list[Text]:
    """Fields between the matches.

    n: at most so many fields (0: none).  mode terminator: without the empty field after
    a match at the text's end; inclusive: a match stays with the field before it.
    """
    if n is not None and (not isinstance(n, int) or n < 0):
        raise TypeError("a count must not be negative")
    if n == 0:
        return []
    out, at, last = [], 0, None
    if n != 1:
        for found in each(pattern, text, start, end, **more):
            out.append(text[at : found.end if mode == "inclusive" else found.start])
            at = last = found.end
            if n is not None and len(out) == n - 1:
                break
    if mode == "plain" or not (last == len(text) and at == len(text)):
        out.append(text[at:])
    return out


Parts = list[Text | list[int]]


def template(pattern: Pattern, text: Text) -> Parts:
    """A replacement template as literals and the group indexes that stand for a group."""
    byte = isinstance(text, bytes)
    held = text.decode("latin-1") if byte else text
    out: list = []
    run = ""
    at = 0

    def group(name: str) -> list[int]:
        if name.isdigit() and name.isascii():
            return [int(name)] if int(name) <= pattern.group_count else []
        return [i for i, x in enumerate(pattern.names, 1) if x == (name.encode("latin-1").decode("utf-8", "replace") if byte else name)]

    while at < len(held):
        c = held[at]
        if c != "$" or at + 1 == len(held):
            run += c
            at += 1
            continue
        nxt = held[at + 1]
        if nxt == "$":
            run += "$"
            at += 2
            continue
        if nxt == "{":
            to = held.find("}", at)
            if to < 0:
                run += held[at:]
                break
            name, at = held[at + 2 : to], to + 1
        else:
            to = at + 1
            if nxt.isascii() and nxt.isdigit():
                while to < len(held) and held[to].isascii() and held[to].isdigit():
                    to += 1
            else:
                while to < len(held) and held[to].isascii() and (held[to].isalnum() or held[to] == "_"):
                    to += 1
            name = held[at + 1 : to]
            if not name:
                run += "$"
                at += 1
                continue
            at = to
        if run:
            out.append(run.encode("latin-1") if byte else run)
            run = ""
        out.append(group(name))
    if run:
        out.append(run.encode("latin-1") if byte else run)
    return out


def expand(parts: Parts, found: Match, text: Text) -> Text:
    empty = text[:0]
    return empty.join(p if not isinstance(p, list) else next((text[s[0] : s[1]] for i in p if (s := found.spans[i]) is not None), empty) for p in parts)


def replace(pattern: Pattern, text: Text, replacement: Text | Callable, n: int | None = None, *, start: int = 0, end: int | None = None, **more) -> Text:
    """At most n matches (None: all) replaced by a template or by fn(match, text)."""
    if n is not None and (not isinstance(n, int) or n < 0):
        raise TypeError("a count must not be negative")
    if not callable(replacement) and type(replacement) is not type(text):
        raise TypeError("a replacement must be of the text's type, or callable")
    parts = None if callable(replacement) else template(pattern, replacement)
    out, at = [], 0
    bounds(pattern, text, start, end)
    if n != 0:
        for i, found in enumerate(each(pattern, text, start, end, **more), 1):
            new = replacement(found, text) if parts is None else expand(parts, found, text)
            if type(new) is not type(text):
                raise TypeError("a replacement function must return the text's type")
            out += [text[at : found.start], new]
            at = found.end
            if n is not None and i >= n:
                break
    return text[:0].join([*out, text[at:]])


STATE_LIMIT = 1_000_000


def fuzzy(pattern: Pattern, text: Text, max_edits: int = 1, start: int = 0, end: int | None = None, *, state_limit: int = STATE_LIMIT, timeout: float | None = None) -> Match | None:
    """The leftmost match within max_edits insertions, deletions and substitutions."""
    if pattern.advanced:
        raise FuzzyUnsupported(pattern.source, "approximate matching needs a regular pattern")
    if not isinstance(max_edits, int) or max_edits < 0:
        raise TypeError("max_edits must not be negative")
    stop = bounds(pattern, text, start, end)
    if not max_edits:
        return find(pattern, text, start, end, timeout=timeout)
    found = vm.fuzzy(pattern.program, text, start, stop, max_edits, state_limit, pattern.options.never_newline, Clock(timeout) if timeout else None)
    return found and _match(found[0], None, found[1])


def scanner(pattern: Pattern, start: int = 0) -> vm.Scanner:
    """An incremental search; the pattern must be regular, without assertions, and consume."""
    return vm.Scanner(pattern.program, start, streamable(pattern))


def scanned(slots: vm.Slots) -> Match:
    return _match(slots)
