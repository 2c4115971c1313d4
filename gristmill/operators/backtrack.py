"""The exact engine of advanced patterns: ordered backtracking on an explicit stack.

Nothing recurses on the text, so long texts are safe.  A state is a place, captures and
a few linked lists, all immutable; a choice point is a state put on the stack.  Control
verbs are choice points that, when they are reached again, cut the stack, move the
search on or end it.
"""

from __future__ import annotations

from ..plans.errors import AdvancedLimitError
from ..plans.program import Program
from ..plans.segments import cluster_end
from ..plans.text import decode, fold_equal, holds, tester
from .vm import Clock, Slots

#: Steps allowed for each unit of text where no budget is given, and at least.
STEPS_PER_UNIT, LEAST_STEPS = 2_000, 100_000


class Result:
    __slots__ = ("slots", "mark")

    def __init__(self, slots: Slots, mark: str | None):
        self.slots, self.mark = slots, mark


class Backtracker:
    def __init__(self, program: Program, text: str | bytes, start: int, end: int, *, step_limit: int | None, nest_limit: int, callout=None, end_is_text_end: bool = False, clock: Clock | None = None):
        self.program, self.text, self.start, self.end = program, text, start, end
        self.length = end if end_is_text_end else len(text)
        self.steps, self.limit = 0, step_limit or max(LEAST_STEPS, STEPS_PER_UNIT * (end - start + 1))
        self.nest_limit, self.callout, self.clock = nest_limit, callout, clock

    def search(self, policy: str = "first", must_end: int | None = None, anchored: bool = False) -> Result | None:
        if self.program.depth > self.nest_limit:
            raise AdvancedLimitError("nest-depth", self.nest_limit, self.nest_limit + 1)
        at = self.start
        while at <= self.end:
            found, following = self.match(at, policy, must_end)
            if found or following is None or anchored:
                return found
            at = following
        return None

    def match(self, first: int, policy: str, must_end: int | None) -> tuple[Result | None, int | None]:
        """A match that starts at a place, else where to go on: None for nowhere."""
        program, text, end = self.program, self.text, self.end
        code, is_text = program.code, isinstance(text, str)
        at, pc, keep, mark = first, 0, first, None
        slots: Slots = (None,) * (2 * program.groups + 2)
        notes: tuple = (-1,) * program.registers
        calls = frames = scope = marks = None  # linked lists
        history: tuple = (None,) * (program.groups + 1)
        stack: list[tuple] = []
        best: Result | None = None
        skip_to: int | None = None

        while True:
            self.steps += 1
            if self.steps > self.limit:
                raise AdvancedLimitError("steps", self.limit, self.steps)
            if self.clock:
                self.clock.tick()
            op = code[pc]
            kind = op[0]
            ok = True
            if kind == "chars":
                if at < end:
                    if is_text:
                        taken = 1 if tester(op[1])(ord(text[at])) else 0
                    elif op[2]:
                        taken = 1 if tester(op[1])(text[at]) else 0
                    else:
                        held = decode(text, at)
                        taken = held[1] if held and at + held[1] <= end and tester(op[1])(held[0]) else 0
                    ok = taken > 0
                    at += taken
                    pc += 1
                else:
                    ok = False
            elif kind == "split":
                stack.append(("go", op[2], at, slots, notes, calls, frames, scope, mark, marks, keep, history))
                pc = op[1]
            elif kind == "jump":
                pc = op[1]
            elif kind == "save":
                slots = (*slots[: op[1]], at, *slots[op[1] + 1 :])
                if program.balanced and op[1] & 1:
                    group = op[1] >> 1
                    history = (*history[:group], ((slots[op[1] - 1], at), history[group]), *history[group + 1 :])
                pc += 1
            elif kind == "assert":
                ok = holds(op[1], text, at, self.start, self.length)
                pc += 1
            elif kind == "not_next":
                ok = at >= self.length or (ord(text[at]) if is_text else text[at]) != op[1]
                pc += 1
            elif kind == "note":
                notes = (*notes[: op[1]], at, *notes[op[1] + 1 :])
                pc += 1
            elif kind == "progress":
                ok = notes[op[1]] != at
                pc += 1
            elif kind == "enter":
                frames = (len(stack), at, op[1], frames)
                pc += 1
            elif kind == "leave":
                height, place, _, frames = frames
                if op[1] != "look_open":
                    del stack[height:]
                if op[1] != "cut":
                    at = place
                pc += 1
            elif kind == "enter_not" or kind == "enter_if":
                stack.append(("go", op[1], at, slots, notes, calls, frames, scope, mark, marks, keep, history))
                frames = (len(stack) - 1, at, kind, frames)
                pc += 1
            elif kind == "leave_not":
                del stack[frames[0] :]
                ok = False
            elif kind == "leave_if":
                height, at, _, frames = frames
                del stack[height:]
                pc += 1
            elif kind == "behind":
                low, high = op[1], op[2]
                origin = at
                begin = max(0, at - high) if high is not None else 0
                frames = (origin, origin - low, "behind", frames)
                if begin > origin - low:
                    ok = False
                else:
                    if begin < origin - low:
                        stack.append(("behind", pc + 1, begin + 1, slots, notes, calls, frames, scope, mark, marks, keep, history))
                    at = begin
                    pc += 1
            elif kind == "reached":
                ok = at == frames[0]
                frames = frames[3]
                pc += 1
            elif kind == "keep":
                keep = at
                pc += 1
            elif kind == "backref":
                ok, at = self.backref(op, slots, at)
                pc += 1
            elif kind == "grapheme":
                ok, at = self.cluster(at)
                pc += 1
            elif kind == "if":
                test = op[1]
                if test[0] == "group":
                    yes = any(slots[2 * i + 1] is not None for i in test[1])
                else:
                    yes = calls is not None and (test[1] is None or calls[1] == test[1])
                pc = pc + 1 if yes else op[2]
            elif kind == "call":
                target, outer, nested = op[1], calls, 0
                while outer is not None and ok:
                    ok = not (outer[1] == target and outer[2] == at)
                    outer, nested = outer[4], nested + 1
                if nested * max(1, program.depth) > self.nest_limit:
                    raise AdvancedLimitError("nest-depth", self.nest_limit, nested * program.depth)
                if ok:
                    calls = (pc + 1, target, at, slots[2 * target : 2 * target + 2] if target else None, calls)
                    pc = program.entries[target]
            elif kind == "ret":
                back, target, _, before, calls = calls
                if before and before[1] is not None:
                    slots = (*slots[: 2 * target], *before, *slots[2 * target + 2 :])
                pc = back
            elif kind == "pop":
                held = history[op[1]]
                ok = held is not None
                if ok:
                    history = (*history[: op[1]], held[1], *history[op[1] + 1 :])
                    top = held[1][0] if held[1] else (None, None)
                    slots = (*slots[: 2 * op[1]], *top, *slots[2 * op[1] + 2 :])
                pc += 1
            elif kind == "callout":
                if self.callout is not None:
                    said = self.callout(op[1], op[2], at, text)
                    if said not in (None, "continue", "fail"):
                        raise ValueError("a callout must return None, 'continue' or 'fail'")
                    ok = said != "fail"
                pc += 1
            elif kind == "then_in":
                scope = (len(stack), scope)
                pc += 1
            elif kind == "then_set":
                scope = (len(stack), scope[1])
                pc += 1
            elif kind == "then_out":
                scope = scope[1]
                pc += 1
            elif kind == "verb":
                name, tag = op[1], op[2]
                pc += 1
                if name == "fail":
                    ok = False
                elif name == "mark":
                    mark, marks = tag, (tag, at, marks)
                elif name == "accept":
                    if calls is not None:
                        back, target, _, before, calls = calls
                        pc = back
                    elif any(f == "look" for f in kinds(frames)):
                        while frames[2] not in ("look", "enter_not", "enter_if"):
                            frames = frames[3]
                        pc = self.look_end(pc, frames[2])
                    elif any(f in ("enter_not", "enter_if") for f in kinds(frames)):
                        while frames[2] not in ("enter_not", "enter_if"):
                            frames = frames[3]
                        pc = self.look_end(pc, frames[2])
                    else:
                        pc = next(i for i, x in enumerate(code) if x[0] == "match")
                elif name == "skip":
                    to = at
                    if tag is not None:
                        held = marks
                        while held is not None and held[0] != tag:
                            held = held[2]
                        to = held[1] if held else None
                    if to is not None:
                        stack.append(("skip", to))
                elif name == "then":
                    stack.append(("then", scope[0]) if scope else ("prune",))
                else:
                    stack.append((name,))
            else:  # match
                ok = must_end is None or at == must_end
                if ok:
                    found = Result((keep, at, *slots[2:]), mark)
                    if policy == "first" or must_end is not None:
                        return found, None
                    if best is None or (at < best.slots[1] if policy == "shortest" else at > best.slots[1]):
                        best = found
                    ok = False
            if ok:
                continue
            # Back to the last choice.
            while True:
                if not stack:
                    return (best, None) if best else (None, first + 1)
                top = stack.pop()
                if top[0] == "go":
                    _, pc, at, slots, notes, calls, frames, scope, mark, marks, keep, history = top
                    break
                if top[0] == "behind":
                    _, pc, at, slots, notes, calls, frames, scope, mark, marks, keep, history = top
                    if at < frames[1]:
                        stack.append(("behind", pc, at + 1, *top[3:]))
                    break
                if top[0] == "then":
                    del stack[top[1] :]
                elif top[0] == "skip":
                    return best, (None if best else max(first + 1, top[1]))
                elif top[0] == "prune":
                    return best, (None if best else first + 1)
                elif top[0] == "commit":
                    return best, None

    def look_end(self, pc: int, kind: str) -> int:
        """The end of the lookaround that an instruction stands in."""
        ends = {"look": ("leave",), "enter_not": ("leave_not",), "enter_if": ("leave_if",)}[kind]
        return next(i for i in range(pc, len(self.program.code)) if self.program.code[i][0] in ends and (self.program.code[i][0] != "leave" or self.program.code[i][1] != "cut"))

    def backref(self, op: tuple, slots: Slots, at: int) -> tuple[bool, int]:
        _, targets, fold, unicode = op
        index = next((i for i in targets if slots[2 * i + 1] is not None), None)
        if index is None:
            return False, at
        held = self.text[slots[2 * index] : slots[2 * index + 1]]
        to = at + len(held)
        if to > self.end:
            return False, at
        now = self.text[at:to]
        if now == held:
            return True, to
        if not fold:
            return False, at
        if isinstance(held, bytes):
            try:
                a, b = (held.decode(), now.decode()) if unicode else (held.decode("latin-1"), now.decode("latin-1"))
            except UnicodeDecodeError:
                return False, at
        else:
            a, b = held, now
        return len(a) == len(b) and all(fold_equal(ord(x), ord(y), unicode) for x, y in zip(a, b)), to

    def cluster(self, at: int) -> tuple[bool, int]:
        if at >= self.end:
            return False, at
        if isinstance(self.text, str):
            return True, min(self.end, cluster_end(self.text, at))
        try:
            rest = self.text[at : self.end].decode()
        except UnicodeDecodeError as bad:
            if not bad.start:
                return False, at
            rest = self.text[at : at + bad.start].decode()
        return True, at + len(rest[: cluster_end(rest, 0)].encode())


def kinds(frames):
    while frames is not None:
        yield frames[2]
        frames = frames[3]
