"""The syntax tree of a pattern."""

from __future__ import annotations

from dataclasses import dataclass, field

from .charset import Ranges


class Node:
    __slots__ = ()

    def children(self) -> tuple[Node, ...]:
        return ()


@dataclass(frozen=True, slots=True)
class Chars(Node):
    """One unit out of a set: a code point, or an octet if ``raw``.  ``named`` is a native spelling of the set."""

    set: Ranges
    raw: bool = False
    named: str | None = None


@dataclass(frozen=True, slots=True)
class LineBreak(Node):
    unicode: bool
    never_newline: bool = False


@dataclass(frozen=True, slots=True)
class Cat(Node):
    items: tuple[Node, ...] = ()

    def children(self):
        return self.items


@dataclass(frozen=True, slots=True)
class Alt(Node):
    items: tuple[Node, ...]

    def children(self):
        return self.items


@dataclass(frozen=True, slots=True)
class Rep(Node):
    item: Node
    least: int
    most: int | None
    greedy: bool = True
    possessive: bool = False

    def children(self):
        return (self.item,)


@dataclass(frozen=True, slots=True)
class Group(Node):
    item: Node
    index: int | None = None
    name: str | None = None
    balance: str | None = None

    def children(self):
        return (self.item,)


@dataclass(frozen=True, slots=True)
class Anchor(Node):
    kind: str
    multiline: bool = False
    crlf: bool = False
    terminator: int = 10
    unicode: bool = True


@dataclass(frozen=True, slots=True)
class Keep(Node):
    """Resets the reported start."""


@dataclass(frozen=True, slots=True)
class Look(Node):
    item: Node
    behind: bool
    negative: bool
    atomic: bool = True

    def children(self):
        return (self.item,)


@dataclass(frozen=True, slots=True)
class Atomic(Node):
    item: Node

    def children(self):
        return (self.item,)


@dataclass(frozen=True, slots=True)
class Backref(Node):
    target: int | str
    fold: bool = False
    unicode: bool = True


@dataclass(frozen=True, slots=True)
class Grapheme(Node):
    pass


@dataclass(frozen=True, slots=True)
class Cond(Node):
    """test: ("group", index or name), ("recursion", None, index or name), ("define",) or a Look."""

    test: tuple | Look
    yes: Node
    no: Node

    def children(self):
        return (*((self.test,) if isinstance(self.test, Look) else ()), self.yes, self.no)


@dataclass(frozen=True, slots=True)
class Call(Node):
    """Runs a group (0: the whole pattern) as a subroutine."""

    target: int | str


@dataclass(frozen=True, slots=True)
class Verb(Node):
    name: str
    tag: str | None = None


@dataclass(frozen=True, slots=True)
class Callout(Node):
    number: int
    tag: str | None = field(default=None)


def walk(node: Node):
    """A node and all below it."""
    stack = [node]
    while stack:
        now = stack.pop()
        yield now
        stack.extend(reversed(now.children()))
