"""The exact engine of regular patterns: all threads side by side, in order of priority.

A thread is (instruction, captures, wait): in octets a character of several octets
makes its thread wait.  A match ends the threads of lower priority; those above go on
and may yet replace it, so a match is never lost when they die.
"""

from __future__ import annotations

import re
import time

from ..plans import charset
from ..plans.emit import Python
from ..plans.errors import MatchTimeout
from ..plans.nodes import Chars
from ..plans.program import Program
from ..plans.text import decode, holds, tester

Slots = tuple[int | None, ...]


class Clock:
    """Raises when a call takes longer than its seconds."""

    def __init__(self, seconds: float | None):
        self.seconds, self.until, self.ticks = seconds, None if seconds is None else time.monotonic() + seconds, 0

    def tick(self) -> None:
        self.ticks += 1
        if self.until is not None and not self.ticks & 63 and time.monotonic() > self.until:
            raise MatchTimeout(self.seconds)


def starters(program: Program) -> re.Pattern | None:
    """Finds the next character that a match can start with; None if a match can be empty or octets are read as characters."""
    if "starters" not in program.__dict__:
        found, todo, seen = [], [0], set()
        ok = True
        while todo and ok:
            pc = todo.pop()
            if pc in seen:
                continue
            seen.add(pc)
            op = program.code[pc]
            if op[0] == "split":
                todo += [op[1], op[2]]
            elif op[0] == "jump":
                todo.append(op[1])
            elif op[0] in ("save", "assert", "not_next"):
                todo.append(pc + 1)
            elif op[0] == "chars":
                found.append(op[1])
                ok = op[2]
            else:
                ok = False
        held = charset.union(*found)
        program.starters = re.compile(Python().chars(Chars(held))) if ok and len(held) < 200 else None
    return program.starters


def follow(code: list[tuple], out: list, seen: set, pc: int, slots: Slots, text: str | bytes, at: int, search_start: int, length: int) -> None:
    """Adds the threads that an instruction leads to without consuming, by priority."""
    stack = [(pc, slots)]
    while stack:
        pc, slots = stack.pop()
        if pc in seen:
            continue
        seen.add(pc)
        op = code[pc]
        kind = op[0]
        if kind == "split":
            stack.append((op[2], slots))
            stack.append((op[1], slots))
        elif kind == "jump":
            stack.append((op[1], slots))
        elif kind == "save":
            stack.append((pc + 1, (*slots[: op[1]], at, *slots[op[1] + 1 :])))
        elif kind == "assert":
            if holds(op[1], text, at, search_start, length):
                stack.append((pc + 1, slots))
        elif kind == "not_next":
            if at >= length or (ord(text[at]) if isinstance(text, str) else text[at]) != op[1]:
                stack.append((pc + 1, slots))
        else:
            out.append((pc, slots, 0))


def consume(op: tuple, text: str | bytes, at: int, end: int) -> int:
    """Units that a consuming instruction takes at a place before ``end``: 0 if it does not match."""
    if isinstance(text, str):
        return 1 if tester(op[1])(ord(text[at])) else 0
    if op[2]:
        return 1 if tester(op[1])(text[at]) else 0
    found = decode(text, at)
    return found[1] if found and at + found[1] <= end and tester(op[1])(found[0]) else 0


def run(program: Program, text: str | bytes, start: int, end: int, *, anchored: bool = False, policy: str = "first", must_end: int | None = None, clock: Clock | None = None) -> Slots | None:
    """The captures of a match in text[start:end], or None.

    policy first: by priority; shortest, longest: by end, at the leftmost start.
    must_end: only paths that end there count.
    """
    if policy != "first" and not anchored:
        found = run(program, text, start, end, clock=clock)
        return found and run(program, text, found[0], end, anchored=True, policy=policy, clock=clock)
    code, length, empty = program.code, len(text), (None,) * (2 * program.groups + 2)
    now: list = []
    best: Slots | None = None
    at = start
    seen: set = set()
    jump = starters(program) if not anchored and isinstance(text, str) else None
    while True:
        if clock:
            clock.tick()
        if jump and not now and best is None:
            found = jump.search(text, at, end)
            if found is None:
                return None
            at = found.start()
        if best is None and (not anchored or at == start):
            follow(code, now, seen, 0, (at, *empty[1:]), text, at, start, length)
        if not now:
            if best is not None or anchored or at >= end:
                return best
            at += 1
            seen = set()
            continue
        after: list = []
        seen_after: set = set()
        for pc, slots, wait in now:
            if wait:
                if at >= end:
                    continue
                if wait == 1:
                    follow(code, after, seen_after, pc, slots, text, at + 1, start, length)
                else:
                    after.append((pc, slots, wait - 1))
                continue
            op = code[pc]
            if op[0] == "match":
                if must_end is not None and at != must_end:
                    continue
                if policy == "longest" and best is not None and best[1] >= at:
                    continue
                best = (slots[0], at, *slots[2:])
                if policy == "shortest" or must_end is not None:
                    return best
                if policy == "first":
                    break
            elif at < end and (taken := consume(op, text, at, end)):
                if taken == 1:
                    follow(code, after, seen_after, pc + 1, slots, text, at + 1, start, length)
                else:
                    after.append((pc + 1, slots, taken - 1))
        if at >= end:
            return best
        now, seen, at = after, seen_after, at + 1


def merged(programs: dict[int, Program]) -> tuple[list[tuple], dict[int, int]]:
    """One program from the members' regular ones: (code, each member's entry).  Its matches name their member; captures are left out."""
    code: list[tuple] = []
    entries: dict[int, int] = {}
    for member, program in programs.items():
        base = entries[member] = len(code)
        for at, op in enumerate(program.code):
            if op[0] == "split":
                op = ("split", op[1] + base, op[2] + base, *op[3:])
            elif op[0] == "jump":
                op = ("jump", op[1] + base)
            elif op[0] == "save":
                op = ("jump", at + 1 + base)
            elif op[0] == "match":
                op = ("match", member)
            code.append(op)
    return code, entries


def members(code: list[tuple], entries: dict[int, int], text: str | bytes, start: int, end: int, *, any_one: bool = False, clock: Clock | None = None) -> set[int]:
    """The members of a merged program that match in text[start:end], by one scan; any_one: the first that is found."""
    found: set[int] = set()
    length, now, seen = len(text), [], set()
    for at in range(start, end + 1):
        if clock:
            clock.tick()
        for member, pc in entries.items():
            if member not in found:
                follow(code, now, seen, pc, (), text, at, start, length)
        after: list = []
        seen_after: set = set()
        for pc, slots, wait in now:
            op = code[pc]
            if wait:
                if at < end and wait == 1:
                    follow(code, after, seen_after, pc, slots, text, at + 1, start, length)
                elif at < end:
                    after.append((pc, slots, wait - 1))
            elif op[0] == "match":
                found.add(op[1])
            elif at < end and (taken := consume(op, text, at, end)):
                if taken == 1:
                    follow(code, after, seen_after, pc + 1, slots, text, at + 1, start, length)
                else:
                    after.append((pc + 1, slots, taken - 1))
        if found and any_one or len(found) == len(entries):
            break
        now, seen = after, seen_after
    return found


def fuzzy(program: Program, text: str | bytes, start: int, end: int, edits: int, limit: int, never_newline: bool, clock: Clock | None = None) -> tuple[Slots, int] | None:
    """The leftmost match within so many edits: there the fewest edits, then the earliest end."""
    from ..plans.errors import FuzzyLimitError

    code, length, empty = program.code, len(text), (None,) * (2 * program.groups + 2)
    newline = lambda i: never_newline and (text[i] == "\n" if isinstance(text, str) else text[i] == 10)
    for first in range(start, end + 1):
        layer: dict[tuple[int, int], Slots] = {}
        used = 0
        todo: list[tuple[int, int, Slots]] = [(0, first, (first, *empty[1:]))]
        settled: set[tuple[int, int]] = set()
        for cost in range(edits + 1):
            # Everything that this many edits reach, exact moves first.
            found: tuple[int, Slots] | None = None
            layer = {}
            stack = list(reversed(todo))
            while stack:
                pc, at, slots = stack.pop()
                threads: list = []
                follow(code, threads, set(), pc, slots, text, at, start, length)
                fresh = []
                for pc, slots, _ in threads:
                    if (pc, at) in settled:
                        continue
                    settled.add((pc, at))
                    used += 1
                    if used > limit:
                        raise FuzzyLimitError("states", limit, used)
                    if clock:
                        clock.tick()
                    layer[(pc, at)] = slots
                    op = code[pc]
                    if op[0] == "match":
                        if found is None or at < found[0]:
                            found = (at, slots)
                    elif at < end and (taken := consume(op, text, at, end)):
                        fresh.append((pc + 1, at + taken, slots))
                stack.extend(reversed(fresh))
            if found:
                at, slots = found
                return (slots[0], at, *slots[2:]), cost
            todo = []
            for (pc, at), slots in layer.items():
                op = code[pc]
                if op[0] == "match":
                    continue
                width = 1
                if at < end and isinstance(text, bytes) and not op[2]:
                    held = decode(text, at)
                    width = held[1] if held else 1
                if at < end and not consume(op, text, at, end) and not newline(at):
                    todo.append((pc + 1, at + width, slots))  # substitution
                todo.append((pc + 1, at, slots))  # deletion
                if at < end and not newline(at):
                    todo.append((pc, at + width, slots))  # insertion
    return None


class Scanner:
    """A search that is fed piece by piece and reports matches as soon as no input can change them.

    Only the input since the best match so far is kept, and only while a thread of
    higher priority lives; of an unfinished character at most 3 octets.  It pickles, so
    it can be a stream's state.
    """

    def __init__(self, program: Program, start: int = 0, whole_characters: bool = False):
        self.program, self.at = program, start
        self.whole = whole_characters  # octets are read as characters
        self.threads: list = []
        self.best: Slots | None = None
        self.found: Slots | None = None
        self.kept: list[tuple[int, int]] = []  # units and widths since the best match's end
        self.partial = b""

    def copy(self) -> Scanner:
        """The same search, to be fed on its own."""
        twin = Scanner(self.program, self.at, self.whole)
        twin.threads, twin.best, twin.found, twin.kept, twin.partial = list(self.threads), self.best, self.found, list(self.kept), self.partial
        return twin

    def units(self, chunk: str | bytes, last: bool) -> list[tuple[int, int]]:
        if isinstance(chunk, str):
            return [(ord(c), 1) for c in chunk]
        if not self.whole:
            return [(b, 1) for b in chunk]
        data, at, out = self.partial + chunk, 0, []
        while at < len(data):
            held = decode(data, at)
            if held is None and not last and len(data) - at < 4 and unfinished(data[at:]):
                break
            out.append(held or (-1, 1))
            at += out[-1][1]
        self.partial = data[at:]
        return out

    def read(self, todo: list[tuple[int, int]], clock: Clock | None = None) -> list[Slots]:
        code, out = self.program.code, []
        empty = (None,) * (2 * self.program.groups + 2)
        todo.reverse()
        while todo:
            unit, width = todo.pop()
            if clock:
                clock.tick()
            if self.best is None:
                self.spread(self.threads, {t[0] for t in self.threads}, 0, (self.at, *empty[1:]))
            else:
                self.kept.append((unit, width))
            after: list = []
            seen: set = set()
            self.at += width
            for pc, slots in self.threads:
                if unit >= 0 and tester(code[pc][1])(unit) and self.spread(after, seen, pc + 1, slots):
                    self.best, self.kept = self.found, []
                    break
            self.threads = after
            if self.best is not None and not self.threads:
                todo += reversed(self.settle(out))
        return out

    def settle(self, out: list[Slots]) -> list[tuple[int, int]]:
        """Reports the best match; what was read since is to be read again."""
        out.append(self.best)
        kept, self.best, self.kept, self.threads = self.kept, None, [], []
        self.at -= sum(w for _, w in kept)
        return kept

    def spread(self, out: list, seen: set, pc: int, slots: Slots) -> bool:
        """Follows without consuming; True if a match is met (then ``found``)."""
        code, stack = self.program.code, [(pc, slots)]
        while stack:
            pc, slots = stack.pop()
            if pc in seen:
                continue
            seen.add(pc)
            op = code[pc]
            if op[0] == "split":
                stack += [(op[2], slots), (op[1], slots)]
            elif op[0] == "jump":
                stack.append((op[1], slots))
            elif op[0] == "save":
                stack.append((pc + 1, (*slots[: op[1]], self.at, *slots[op[1] + 1 :])))
            elif op[0] == "match":
                self.found = (slots[0], self.at, *slots[2:])
                return True
            else:
                out.append((pc, slots))
        return False

    def feed(self, chunk: str | bytes, clock: Clock | None = None) -> list[Slots]:
        jump = starters(self.program) if isinstance(chunk, str) else None
        if jump is None:
            return self.read(self.units(chunk, False), clock)
        # Characters that start nothing are passed over while no thread lives.
        out: list[Slots] = []
        at = 0
        while at < len(chunk):
            if not self.threads and self.best is None:
                found = jump.search(chunk, at)
                to = found.start() if found else len(chunk)
                self.at += to - at
                at = to
                if found is None:
                    break
            out += self.read([(ord(chunk[at]), 1)], clock)
            at += 1
        return out

    def finish(self, clock: Clock | None = None) -> list[Slots]:
        out = self.read(self.units(b"", True), clock) if self.whole else []
        while self.best is not None:
            out += self.read(self.settle(out), clock)
        return out


def unfinished(data: bytes) -> bool:
    """Could these octets be the start of a character?"""
    lead = data[0]
    width = 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 1
    return len(data) < width and all(b & 0xC0 == 0x80 for b in data[1:])
