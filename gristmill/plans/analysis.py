"""What a syntax tree tells before any text is read."""

from __future__ import annotations

from . import charset
from .charset import size
from .nodes import Alt, Anchor, Atomic, Backref, Call, Callout, Cat, Chars, Cond, Grapheme, Group, Keep, LineBreak, Look, Node, Rep, Verb, walk

#: Anchors that only the backtracking engine evaluates.
ADVANCED_ANCHORS = frozenset(("search_start", "text_end_newline", "grapheme_boundary", "word_break", "sentence_break"))


def is_advanced(root: Node) -> bool:
    """Does the pattern need backtracking?"""
    for n in walk(root):
        if isinstance(n, (Keep, Look, Atomic, Backref, Grapheme, Cond, Call, Verb, Callout)):
            return True
        if isinstance(n, Rep) and n.possessive or isinstance(n, Group) and n.balance or isinstance(n, Anchor) and n.kind in ADVANCED_ANCHORS:
            return True
    return False


def widths(node: Node) -> tuple[int, int | None]:
    """The least and the most code points (or octets of raw sets) that a node consumes; None: no bound known."""
    if isinstance(node, Chars):
        return 1, 1
    if isinstance(node, LineBreak):
        return 1, 2
    if isinstance(node, Cat):
        low, high = 0, 0
        for item in node.items:
            a, b = widths(item)
            low, high = low + a, None if high is None or b is None else high + b
        return low, high
    if isinstance(node, Alt):
        held = [widths(x) for x in node.items]
        return min(a for a, _ in held), None if any(b is None for _, b in held) else max(b for _, b in held)
    if isinstance(node, Rep):
        a, b = widths(node.item)
        return a * node.least, 0 if node.most == 0 or b == 0 else None if node.most is None or b is None else b * node.most
    if isinstance(node, (Group, Atomic)):
        return widths(node.item)
    if isinstance(node, Cond):
        (a, b), (c, d) = widths(node.yes), widths(node.no)
        return min(a, c), None if b is None or d is None else max(b, d)
    if isinstance(node, (Backref, Call)):
        return 0, None
    if isinstance(node, Grapheme):
        return 1, None
    if isinstance(node, Verb) and node.name == "accept":
        return 0, None
    return 0, 0


def nullable(node: Node) -> bool:
    """Can it match without consuming?  True where that is not known."""
    if any(isinstance(n, (Verb, Keep)) for n in walk(node)):
        return True
    return widths(node)[0] == 0


def static_captures(node: Node) -> int | None:
    """How many groups take part in every match, or None if that varies."""
    if isinstance(node, Group):
        held = static_captures(node.item)
        return None if held is None else held + (node.index is not None)
    if isinstance(node, Alt):
        held = {static_captures(x) for x in node.items}
        return held.pop() if len(held) == 1 else None
    if isinstance(node, Rep):
        held = static_captures(node.item)
        if node.most == 0:
            return 0
        return held if node.least or held == 0 else None
    if isinstance(node, Look):
        return 0 if node.negative else static_captures(node.item)
    if isinstance(node, (Cond, Call)):
        held = {static_captures(x) for x in node.children()}
        return 0 if held <= {0} else None
    total = 0
    for item in node.children():
        held = static_captures(item)
        if held is None:
            return None
        total += held
    return total


def literal_text(node: Node) -> str | None:
    """The one text that a node matches, if it is a literal without case variants."""
    if isinstance(node, Chars):
        return chr(node.set[0][0]) if not node.raw and size(node.set) == 1 else None
    if isinstance(node, Cat):
        parts = [literal_text(x) for x in node.items]
        return None if any(p is None for p in parts) else "".join(parts)
    if isinstance(node, Group) and node.index is None and not node.balance:
        return literal_text(node.item)
    if isinstance(node, Rep) and node.most == node.least and node.least <= 16 and not node.possessive:
        held = literal_text(node.item)
        return None if held is None else held * node.least
    return None


def flat(node: Node) -> list[Node]:
    """The top-level items of a concatenation, through plain groups."""
    if isinstance(node, Cat):
        return [y for x in node.items for y in flat(x)]
    if isinstance(node, Group) and not node.balance:
        return flat(node.item)
    return [node]


def required_literal(root: Node) -> str:
    """The longest text that every match must hold ('' if none is known)."""
    if any(isinstance(n, (Verb, Cond, Call, Keep)) for n in walk(root)):
        return ""
    best = run = ""
    for item in flat(root):
        held = literal_text(item)
        if held is None and isinstance(item, Rep) and item.least:
            held_once = literal_text(item.item)
            best = max(best, run, key=len)
            run = held_once * item.least if held_once is not None else ""
            best = max(best, run, key=len)
            run = ""
            continue
        if held is None and isinstance(item, (Anchor, Look)):
            continue
        if held is None:
            best, run = max(best, run, key=len), ""
        else:
            run += held
    return max(best, run, key=len)


def anchored_literal(root: Node) -> tuple[str, str] | None:
    """("equals" | "prefix" | "suffix" | "contains", text) if that is all the pattern asks."""
    items = flat(root)
    start = bool(items) and isinstance(items[0], Anchor) and (items[0].kind == "text_start" or items[0].kind == "line_start" and not items[0].multiline)
    items = items[start:]
    end = bool(items) and isinstance(items[-1], Anchor) and (items[-1].kind == "text_end" or items[-1].kind == "line_end" and not items[-1].multiline)
    items = items[: len(items) - end]
    text = literal_text(Cat(tuple(items)))
    if text is None:
        return None
    return {(True, True): "equals", (True, False): "prefix", (False, True): "suffix", (False, False): "contains"}[(start, end)], text


def depth(node: Node) -> int:
    return max((1 + depth(x) for x in node.children()), default=0)


def loops_in_frames(root: Node) -> bool:
    """Does an engine that recurses on repeated groups need a frame for each round?"""
    def single(x: Node) -> bool:
        return isinstance(x, Chars) or isinstance(x, Group) and x.index is None and not x.balance and single(x.item)

    return any(isinstance(n, Rep) and (n.most is None or n.most > 64) and not single(n.item) for n in walk(root))


def empty_loops(root: Node) -> bool:
    """Is something repeated that can match nothing?  Engines differ there."""
    return any(isinstance(n, Rep) and (n.most is None or n.most > 1) and nullable(n.item) for n in walk(root))


def first(node: Node) -> charset.Ranges | None:
    """The set of what a node's matches start with; None if it can be empty or that is not known."""
    if isinstance(node, Chars):
        return node.set
    if isinstance(node, (Group, Atomic)):
        return first(node.item)
    if isinstance(node, Rep):
        return first(node.item) if node.least else None
    if isinstance(node, Alt):
        held = [first(x) for x in node.items]
        return None if any(h is None for h in held) else charset.union(*held)
    if isinstance(node, Cat):
        at = [x for x in node.items if not isinstance(x, (Anchor, Look))]
        return first(at[0]) if at else None
    return None


def decided(node: Node) -> bool:
    """Is there one way at most to match a text by rounds of this node, seen one character ahead?"""
    if isinstance(node, Alt):
        starts = [first(x) for x in node.items]
        if any(s is None for s in starts) or any(charset.intersect(a, b) for i, a in enumerate(starts) for b in starts[:i]):
            return False
        return all(decided(x) for x in node.items)
    items = [x for x in flat(node) if not isinstance(x, Anchor)]
    for i, item in enumerate(items):
        if isinstance(item, Chars):
            continue
        if isinstance(item, Alt) and decided(item):
            continue
        if isinstance(item, Rep) and isinstance(item.item, Chars):
            after = first(Cat(tuple(items[i + 1 :]))) if i + 1 < len(items) else first(Cat(tuple(items)))
            if item.least == item.most or item.possessive or after is not None and not charset.intersect(after, item.item.set):
                continue
        return False
    return True


def leading_run(root: Node) -> Chars | None:
    """The set of an unbounded repetition that a regular pattern starts with, if it is one set.

    A match that starts inside a run of that set could start one character earlier, so the
    leftmost match of a whole text starts at the run's start; engines that try every start
    take quadratic time on a long run unless they are told.
    """
    if is_advanced(root):
        return None
    items = flat(root)
    if not items or not isinstance(items[0], Rep) or items[0].most is not None:
        return None
    item = items[0].item
    while isinstance(item, Group) and not item.balance:
        item = item.item
    return item if isinstance(item, Chars) and item.set else None


def explosive(root: Node) -> bool:
    """Could a backtracking engine without a budget take exponential time?  True unless that is ruled out."""
    def single(x: Node) -> bool:
        return isinstance(x, Chars) or isinstance(x, Group) and not x.balance and single(x.item)

    return any(isinstance(n, Rep) and not n.possessive and (n.most is None or n.most > 8) and not single(n.item) and not decided(n.item) for n in walk(root))
