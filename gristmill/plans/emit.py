"""Pattern trees in the dialects of the native engines.

``to_java`` is for Spark's own expressions, ``to_python`` for the standard library's
engine in Arrow batches.  Text is made from the tree, never patched, so whatever has
no provably equal form raises ``NotTranslatable`` and goes to the exact engine.
"""

from __future__ import annotations

from . import analysis, charset, unidata
from .charset import Ranges
from .errors import NotTranslatable
from .nodes import Alt, Anchor, Atomic, Backref, Cat, Chars, Group, LineBreak, Look, Node, Rep


class Emitter:
    """What both dialects share; groups are numbered, names are left out."""

    def __init__(self, byte_mode: bool = False):
        self.bytes = byte_mode
        self.next_group = 1
        self.seen: set[int] = set()

    def unit(self, cp: int) -> str:
        raise NotImplementedError

    end_text = r"\z"

    def members(self, found: Ranges) -> str:
        return "".join(self.unit(lo) if lo == hi else f"{self.unit(lo)}-{self.unit(hi)}" for lo, hi in found)

    def chars(self, node: Chars) -> str:
        found = node.set
        if not found:
            return "(?!)"
        if charset.size(found) == 1:
            return self.unit(found[0][0])
        if not node.raw and found == charset.ALL:
            return "(?s:.)"
        rest = charset.complement(found, charset.OCTETS if node.raw else charset.ALL)
        return f"[^{self.members(rest)}]" if rest and len(rest) < len(found) else f"[{self.members(found)}]"

    def emit(self, node: Node) -> str:
        if isinstance(node, Chars):
            if self.bytes and not node.raw and node.set and node.set[-1][1] > 127:
                raise NotTranslatable("a Unicode set in a byte pattern")
            return self.chars(node)
        if isinstance(node, Cat):
            return "".join(f"(?:{self.emit(x)})" if isinstance(x, Alt) else self.emit(x) for x in node.items)
        if isinstance(node, Alt):
            return "|".join(self.emit(x) for x in node.items)
        if isinstance(node, Rep):
            item = self.emit(node.item)
            if not isinstance(node.item, (Chars, Group, Atomic)) or not item:
                item = f"(?:{item})"
            bounds = {(0, None): "*", (1, None): "+", (0, 1): "?"}.get((node.least, node.most)) or (f"{{{node.least}}}" if node.least == node.most else f"{{{node.least},{'' if node.most is None else node.most}}}")
            return item + bounds + ("+" if node.possessive else "" if node.greedy else "?")
        if isinstance(node, Group):
            if node.balance:
                raise NotTranslatable("balancing group")
            if node.index is None:
                return f"(?:{self.emit(node.item)})"
            if node.index != self.next_group:
                raise NotTranslatable("shared group numbers")
            self.next_group += 1
            inside = self.emit(node.item)
            self.seen.add(node.index)
            return f"({inside})"
        if isinstance(node, Atomic):
            return f"(?>{self.emit(node.item)})"
        if isinstance(node, Look):
            if not node.atomic:
                raise NotTranslatable("non-atomic lookaround")
            if node.behind:
                self.behind(node)
            return f"(?{'<' if node.behind else ''}{'!' if node.negative else '='}{self.emit(node.item)})"
        if isinstance(node, LineBreak):
            if node.never_newline or self.bytes:
                raise NotTranslatable("line break")
            more = charset.ranges([(10, 13), (0x85, 0x85), *(((0x2028, 0x2029),) if node.unicode else ())])
            return f"(?>{self.unit(13)}{self.unit(10)}|[{self.members(more)}])"
        if isinstance(node, Backref):
            if not isinstance(node.target, int) or node.fold or node.target not in self.seen:
                raise NotTranslatable("back reference")
            return f"(?:\\{node.target})"
        if isinstance(node, Anchor):
            return self.anchor(node)
        raise NotTranslatable(type(node).__name__)

    def behind(self, node: Look) -> None:
        raise NotImplementedError

    def word(self, node: Anchor) -> str:
        return f"[{self.members(unidata.word() if node.unicode else unidata.POSIX['word'])}]"

    def anchor(self, node: Anchor) -> str:
        end, kind = self.end_text, node.kind
        if self.bytes and node.unicode and "word" in kind + ("word" if "boundary" in kind else ""):
            raise NotTranslatable("a Unicode boundary in a byte pattern")
        if kind == "text_start" or kind == "line_start" and not node.multiline:
            return r"\A"
        if kind == "text_end" or kind == "line_end" and not node.multiline:
            return end
        cr, lf = self.unit(13), self.unit(10)
        if kind == "line_start":
            return rf"(?:\A|(?<={lf})|(?<={cr})(?!{lf}))" if node.crlf else rf"(?:\A|(?<={self.unit(node.terminator)}))"
        if kind == "line_end":
            return rf"(?:{end}|(?={cr})|(?<!{cr})(?={lf}))" if node.crlf else rf"(?:{end}|(?={self.unit(node.terminator)}))"
        if kind in ("boundary", "non_boundary", "word_start", "word_end", "word_start_half", "word_end_half"):
            w = self.word(node)
            return {
                "boundary": f"(?:(?<={w})(?!{w})|(?<!{w})(?={w}))",
                "non_boundary": f"(?:(?<={w})(?={w})|(?<!{w})(?!{w}))",
                "word_start": f"(?:(?<!{w})(?={w}))",
                "word_end": f"(?:(?<={w})(?!{w}))",
                "word_start_half": f"(?<!{w})",
                "word_end_half": f"(?!{w})",
            }[kind]
        return self.refuse(kind)

    def refuse(self, what: str) -> str:
        raise NotTranslatable(what)


class Java(Emitter):
    """``java.util.regex``, without flags."""

    def unit(self, cp: int) -> str:
        return chr(cp) if cp < 128 and chr(cp).isalnum() else f"\\x{{{cp:x}}}"

    def chars(self, node: Chars) -> str:
        if node.named:
            return f"[{node.named}]"
        if len(node.set) > 200:
            for name in ("IsAlphabetic", "L", "Lu", "Ll", "M", "N", "P", "S", "Z", "Nd"):
                if node.set == charset.complement(unidata.property_set(name.removeprefix("Is"), None) or ()):
                    return rf"[^\p{{{name}}}]"
            if node.set == charset.complement(unidata.word()):
                return r"[^\p{IsAlphabetic}\p{M}\p{Nd}\p{Pc}\x{200c}\x{200d}]"
            raise NotTranslatable("a set of too many ranges")
        return super().chars(node)

    def word(self, node: Anchor) -> str:
        return r"[\p{IsAlphabetic}\p{M}\p{Nd}\p{Pc}\x{200c}\x{200d}]" if node.unicode else "[0-9A-Z_a-z]"

    def behind(self, node: Look) -> None:
        if analysis.widths(node.item)[1] is None:
            raise NotTranslatable("unbounded lookbehind")


class Python(Emitter):
    end_text = r"\Z"

    def unit(self, cp: int) -> str:
        if cp < 128 and chr(cp).isalnum():
            return chr(cp)
        return f"\\x{cp:02x}" if cp < 256 else f"\\u{cp:04x}" if cp < 65536 else f"\\U{cp:08x}"

    def behind(self, node: Look) -> None:
        low, high = analysis.widths(node.item)
        if low != high:
            raise NotTranslatable("lookbehind of varying width")
        if any(isinstance(n, Group) and n.index for n in analysis.walk(node.item)):
            raise NotTranslatable("captures in a lookbehind")


def to_java(root: Node) -> str:
    """A Java pattern that finds the same matches in whole texts."""
    if analysis.empty_loops(root) or analysis.loops_in_frames(root) or analysis.explosive(root):
        raise NotTranslatable("loops")
    return Java().emit(root)


def to_python(root: Node, byte_mode: bool = False) -> str | bytes:
    if analysis.empty_loops(root):
        raise NotTranslatable("loops")
    found = Python(byte_mode).emit(root)
    return found.encode("latin-1") if byte_mode else found
