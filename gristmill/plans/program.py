"""Syntax trees as instruction lists, for the two exact engines.

An instruction is a tuple whose first item names it; plain tuples pickle to workers.
Sets are compiled to fast tests on first use in a process.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from . import analysis, charset
from .errors import PatternSyntaxError
from .nodes import Alt, Anchor, Atomic, Backref, Call, Callout, Cat, Chars, Cond, Grapheme, Group, Keep, LineBreak, Look, Node, Rep, Verb, walk


@dataclass
class Program:
    code: list[tuple]
    groups: int
    registers: int = 0
    entries: dict[int, int] = field(default_factory=dict)
    balanced: bool = False
    depth: int = 0


class Compiler:
    def __init__(self, source: str, groups: int, names: list[str | None], byte_mode: bool, limit: int | None):
        self.source, self.groups, self.bytes, self.limit = source, groups, byte_mode, limit
        self.indexes: dict[str, list[int]] = {}
        for i, name in enumerate(names, 1):
            if name:
                self.indexes.setdefault(name, []).append(i)
        self.code: list[tuple] = []
        self.registers = 0
        self.open: list[int] = []

    def put(self, *instruction) -> int:
        self.code.append(instruction)
        if self.limit is not None and len(self.code) > self.limit:
            raise PatternSyntaxError(self.source, len(self.source), "the compiled pattern is too large")
        return len(self.code) - 1

    def fix(self, at: int, *instruction) -> None:
        self.code[at] = instruction

    @property
    def here(self) -> int:
        return len(self.code)

    def program(self, root: Node, advanced: bool | None = None) -> Program:
        """advanced: for the backtracking engine, whose loops must make progress; by default if the tree needs it."""
        advanced = analysis.is_advanced(root) if advanced is None else advanced
        self.advanced = advanced
        self.balanced = any(isinstance(n, Group) and n.balance for n in walk(root))
        self.emit(root)
        self.put("match")
        entries: dict[int, int] = {}
        found = {n.index: n for n in walk(root) if isinstance(n, Group) and n.index}
        for target in sorted({self.target(n.target) for n in walk(root) if isinstance(n, Call)}):
            entries[target] = self.here
            self.open = []
            self.emit(found[target] if target else root)
            self.put("ret", target)
        return Program(self.code, self.groups, self.registers, entries, self.balanced, analysis.depth(root))

    def target(self, target: int | str) -> int:
        return self.indexes[target][0] if isinstance(target, str) else target

    def emit(self, node: Node) -> None:
        if isinstance(node, Chars):
            self.put("chars", node.set, node.raw or not self.bytes)
        elif isinstance(node, Cat):
            for item in node.items:
                self.emit(item)
        elif isinstance(node, Alt):
            self.alternation(node)
        elif isinstance(node, Rep):
            self.repetition(node)
        elif isinstance(node, Group):
            if node.balance:
                if node.balance in self.indexes:
                    self.put("pop", self.target(node.balance))
                else:  # nothing to balance: never matches
                    self.put("chars", (), True)
            if node.index is None:
                self.emit(node.item)
            else:
                self.put("save", 2 * node.index)
                self.open.append(node.index)
                self.emit(node.item)
                self.open.pop()
                self.put("save", 2 * node.index + 1)
        elif isinstance(node, Anchor):
            self.put("assert", node)
        elif isinstance(node, LineBreak):
            self.line_break(node)
        elif isinstance(node, Keep):
            self.put("keep")
        elif isinstance(node, Atomic):
            self.put("enter", "atomic")
            self.emit(node.item)
            self.put("leave", "cut")
        elif isinstance(node, Look):
            self.look(node)
        elif isinstance(node, Backref):
            targets = self.indexes[node.target] if isinstance(node.target, str) else [node.target]
            self.put("backref", tuple(targets), node.fold, node.unicode)
        elif isinstance(node, Grapheme):
            self.put("grapheme")
        elif isinstance(node, Cond):
            self.conditional(node)
        elif isinstance(node, Call):
            self.put("call", self.target(node.target))
        elif isinstance(node, Callout):
            self.put("callout", node.number, node.tag)
        elif isinstance(node, Verb):
            if node.name == "accept":
                for index in reversed(self.open):
                    self.put("save", 2 * index + 1)
            self.put("verb", node.name, node.tag)
        else:
            raise TypeError(node)

    def alternation(self, node: Alt) -> None:
        scoped = any(isinstance(n, Verb) and n.name == "then" for n in walk(node))
        if scoped:
            self.put("then_in")
        ends = []
        for item in node.items[:-1]:
            split = self.put("split")
            if scoped:
                self.put("then_set")
            self.emit(item)
            ends.append(self.put("jump"))
            self.fix(split, "split", split + 1, self.here)
        if scoped:
            self.put("then_set")
        self.emit(node.items[-1])
        for at in ends:
            self.fix(at, "jump", self.here)
        if scoped:
            self.put("then_out")

    def repetition(self, node: Rep) -> None:
        if node.possessive:
            self.put("enter", "atomic")
        for _ in range(node.least):
            self.emit(node.item)
        if node.most is None:
            guarded = self.advanced and analysis.nullable(node.item)
            split = self.put("split")
            if guarded:
                register = self.registers
                self.registers += 1
                self.put("note", register)
            self.emit(node.item)
            if guarded:
                self.put("progress", register)
            self.put("jump", split)
            self.branch(split, split + 1, self.here, node.greedy)
        else:
            splits = []
            for _ in range(node.most - node.least):
                splits.append(self.put("split"))
                if self.advanced and analysis.nullable(node.item):
                    register = self.registers
                    self.registers += 1
                    self.put("note", register)
                    self.emit(node.item)
                    self.put("progress", register)
                else:
                    self.emit(node.item)
            for at in splits:
                self.branch(at, at + 1, self.here, node.greedy)
        if node.possessive:
            self.put("leave", "cut")

    def branch(self, at: int, inside: int, after: int, greedy: bool) -> None:
        self.fix(at, "split", *((inside, after) if greedy else (after, inside)))

    def line_break(self, node: LineBreak) -> None:
        """CR LF is one unit: CR alone only where no LF follows."""
        lone = charset.ranges([(11, 12), (0x85, 0x85), *([(0x2028, 0x2029)] if node.unicode else []), *([] if node.never_newline else [(10, 10)])])
        if self.bytes and not node.unicode:
            lone = charset.intersect(lone, ((0, 127),))
        items: list[Node] = [] if node.never_newline else [Cat((Chars(((13, 13),), self.bytes), Chars(((10, 10),), self.bytes)))]
        split = []
        for item in items:
            split.append(self.put("split"))
            self.emit(item)
            done = self.put("jump")
            self.fix(split[0], "split", split[0] + 1, self.here)
        cr = self.put("split")
        self.put("chars", ((13, 13),), True)
        self.put("not_next", 10)
        cr_done = self.put("jump")
        self.fix(cr, "split", cr + 1, self.here)
        self.put("chars", lone, not self.bytes)
        if items:
            self.fix(done, "jump", self.here)
        self.fix(cr_done, "jump", self.here)

    def look(self, node: Look) -> None:
        if node.negative:
            enter = self.put("enter_not")
        else:
            self.put("enter", "look")
        if node.behind:
            low, high = (0, None) if self.bytes else analysis.widths(node.item)
            self.put("behind", low, high)
        self.emit(node.item)
        if node.behind:
            self.put("reached")
        if node.negative:
            self.put("leave_not")
            self.fix(enter, "enter_not", self.here)
        else:
            self.put("leave", "look" if node.atomic else "look_open")

    def conditional(self, node: Cond) -> None:
        if isinstance(node.test, Look):
            look = node.test
            no = self.put("enter_if")
            if look.behind:
                self.put("behind", *((0, None) if self.bytes else analysis.widths(look.item)))
            self.emit(look.item)
            if look.behind:
                self.put("reached")
            self.put("leave_if")
            first, second = (node.no, node.yes) if look.negative else (node.yes, node.no)
            self.emit(first)
            done = self.put("jump")
            self.fix(no, "enter_if", self.here)
            self.emit(second)
            self.fix(done, "jump", self.here)
            return
        kind, *rest = node.test
        if kind == "define":
            skip = self.put("jump")
            self.emit(node.yes)
            self.fix(skip, "jump", self.here)
            self.emit(node.no)
            return
        if kind == "group":
            targets = self.indexes[rest[0]] if isinstance(rest[0], str) else [rest[0]]
            at, test = self.put("if"), ("group", tuple(targets))
        else:
            at, test = self.put("if"), ("recursion", None if rest[0] is None else self.target(rest[0]))
        self.emit(node.yes)
        done = self.put("jump")
        self.fix(at, "if", test, self.here)
        self.emit(node.no)
        self.fix(done, "jump", self.here)
