"""Pattern text to syntax tree, by recursive descent on the driver."""

from __future__ import annotations

import string
import unicodedata
from dataclasses import dataclass, replace

from . import charset, unidata
from .charset import ALL, Ranges
from .errors import PatternSyntaxError
from .nodes import Alt, Anchor, Atomic, Backref, Call, Callout, Cat, Chars, Cond, Grapheme, Group, Keep, LineBreak, Look, Node, Rep, Verb, walk

MOST_REPEATS = 1000
LETTERS = string.ascii_letters + string.digits
FLAGS = {"i": "fold", "m": "multiline", "s": "dotall", "U": "swap", "x": "extended", "u": "unicode", "R": "crlf", "n": "nameless", "J": "duplicates"}
#: Spellings of lookarounds (behind, negative, atomic) and of control verbs.
LOOKS = {
    "positive_lookahead": (False, False, True), "pla": (False, False, True), "negative_lookahead": (False, True, True), "nla": (False, True, True),
    "positive_lookbehind": (True, False, True), "plb": (True, False, True), "negative_lookbehind": (True, True, True), "nlb": (True, True, True),
    "non_atomic_positive_lookahead": (False, False, False), "napla": (False, False, False), "non_atomic_positive_lookbehind": (True, False, False), "naplb": (True, False, False),
}
VERBS = {"FAIL": "fail", "F": "fail", "ACCEPT": "accept", "A": "accept", "COMMIT": "commit", "C": "commit", "PRUNE": "prune", "P": "prune", "SKIP": "skip", "S": "skip", "THEN": "then", "MARK": "mark"}
BOUNDARIES = {"start": "word_start", "end": "word_end", "start-half": "word_start_half", "end-half": "word_end_half", "g": "grapheme_boundary", "wb": "word_break", "sb": "sentence_break"}


@dataclass(frozen=True)
class Flags:
    fold: bool = False
    multiline: bool = False
    dotall: bool = False
    swap: bool = False
    extended: bool = False
    unicode: bool = True
    crlf: bool = False
    nameless: bool = False
    duplicates: bool = False


@dataclass
class Parsed:
    node: Node
    groups: int
    names: list[str | None]
    duplicates: bool


class Parser:
    def __init__(self, pattern: str, flags: Flags, *, byte_mode: bool = False, never_newline: bool = False, octal: bool = True, terminator: int = 10, nest_limit: int = 250):
        if not isinstance(pattern, str):
            raise PatternSyntaxError(pattern, 0, "a pattern must be a string")
        for i, c in enumerate(pattern):
            if 0xD800 <= ord(c) <= 0xDFFF:
                raise PatternSyntaxError(pattern, i, "a pattern must not hold surrogates")
        self.text, self.at, self.flags = pattern, 0, flags
        self.bytes, self.never_newline, self.octal, self.terminator, self.nest_limit = byte_mode, never_newline, octal, terminator, nest_limit
        self.depth = self.groups = 0
        self.names: dict[int, str] = {}
        self.quoted = False  # inside \Q...\E

    # --- text -------------------------------------------------------------

    def fail(self, reason: str, at: int | None = None):
        raise PatternSyntaxError(self.text, self.at if at is None else at, reason)

    def peek(self, n: int = 1) -> str:
        return self.text[self.at : self.at + n]

    def take(self, what: str) -> bool:
        if self.text.startswith(what, self.at):
            self.at += len(what)
            return True
        return False

    def need(self, what: str, reason: str) -> None:
        if not self.take(what):
            self.fail(reason)

    def until(self, end: str, reason: str) -> str:
        to = self.text.find(end, self.at)
        if to < 0:
            self.fail(reason, len(self.text))
        found, self.at = self.text[self.at : to], to + len(end)
        return found

    def skip(self) -> None:
        """Comments, and in extended mode white space and line comments."""
        while self.at < len(self.text):
            if self.take("(?#"):
                self.until(")", "unclosed comment")
            elif self.flags.extended and self.peek().isspace():
                self.at += 1
            elif self.flags.extended and self.peek() == "#":
                to = self.text.find("\n", self.at)
                self.at = len(self.text) if to < 0 else to + 1
            else:
                return

    def squeezed(self, text: str) -> str:
        """The inside of braces; in extended mode without blanks and comments."""
        if not self.flags.extended:
            return text
        return "".join(c for line in text.split("\n") for c in line.split("#")[0] if not c.isspace())

    # --- sets -------------------------------------------------------------

    @property
    def raw(self) -> bool:
        return self.bytes and not self.flags.unicode

    def domain(self) -> Ranges:
        return charset.OCTETS if self.raw else ALL

    def chars(self, found: Ranges, named: str | None = None, negated: bool = False) -> Chars:
        """A set under the flags in force: folded, then negated, then without what may not be consumed."""
        if self.flags.fold:
            wide = unidata.folded(found, self.raw or not self.flags.unicode)
            named = named if wide == found else None
            found = wide
        if negated:
            found, named = charset.complement(found, self.domain()), None
        if self.never_newline and charset.intersect(found, ((10, 10),)):
            found, named = charset.subtract(found, ((10, 10),)), None
        return Chars(found, self.raw, named)

    def literal(self, cp: int) -> Chars:
        if self.raw and cp > 255:
            self.fail("a code point above 255 needs Unicode mode")
        return self.chars(((cp, cp),))

    def checked(self, node: Chars, start: int) -> Chars:
        """Character patterns must not admit parts of characters."""
        if not self.bytes and not self.flags.unicode and node.set and node.set[-1][1] > 127:
            self.fail("the set would match invalid UTF-8", start)
        return node

    def class_escape(self, c: str) -> tuple[Ranges, str | None] | None:
        """The set and native spelling of d, w, s or h, not negated."""
        low, wide = c.lower(), self.flags.unicode
        if low == "d":
            return (unidata.category("Nd"), r"\p{Nd}") if wide else (unidata.POSIX["digit"], None)
        if low == "w":
            return (unidata.word(), r"\p{IsAlphabetic}\p{M}\p{Nd}\p{Pc}\x{200c}\x{200d}") if wide else (unidata.POSIX["word"], None)
        if low == "s":
            return (unidata.space(), r"\p{IsWhite_Space}") if wide else (unidata.POSIX["space"], None)
        if low == "h":
            return (unidata.HORIZONTAL, None) if wide else (unidata.POSIX["blank"], None)
        return None

    # --- structure --------------------------------------------------------

    def parse(self) -> Parsed:
        node = self.alternation()
        if self.at < len(self.text):
            self.fail("unmatched ')'")
        names = [self.names.get(i) for i in range(1, self.groups + 1)]
        held = [n for n in names if n]
        self.validate(node, set(held))
        return Parsed(node, self.groups, names, len(set(held)) < len(held))

    def alternation(self, reset: bool = False) -> Node:
        self.depth += 1
        if self.depth > self.nest_limit:
            self.fail("the pattern is nested too deeply")
        first = most = self.groups
        items = [self.sequence()]
        while self.take("|"):
            if reset:
                most, self.groups = max(most, self.groups), first
            items.append(self.sequence())
        if reset:
            self.groups = max(most, self.groups)
        self.depth -= 1
        return items[0] if len(items) == 1 else Alt(tuple(items))

    def sequence(self) -> Node:
        items: list[Node] = []
        while True:
            self.skip_quotes()
            if not self.quoted:
                self.skip()
                self.skip_quotes()
            if self.at >= len(self.text) or not self.quoted and self.peek() in "|)":
                return items[0] if len(items) == 1 else Cat(tuple(items))
            item = self.atom()
            if item is not None:
                items.append(self.quantified(item))

    def skip_quotes(self) -> None:
        while True:
            if self.quoted and self.take("\\E"):
                self.quoted = False
            elif not self.quoted and self.take("\\Q"):
                self.quoted = True
            elif not self.quoted and self.take("\\E"):
                pass
            else:
                return

    def quantified(self, item: Node) -> Node:
        self.skip_quotes()
        if self.quoted:
            return item
        self.skip()
        c = self.peek()
        if c == "{":
            start = self.at
            self.at += 1
            inside = self.squeezed(self.until("}", "unclosed repetition"))
            low, comma, high = inside.partition(",")
            if not low.isascii() or not low.isdigit() or comma and high and not (high.isascii() and high.isdigit()):
                self.fail("malformed repetition", start)
            least, most = int(low), (int(high) if high else None) if comma else int(low)
            if max(least, most or 0) > MOST_REPEATS:
                self.fail("repetition count is too large", start)
            if most is not None and least > most:
                self.fail("repetition range is reversed", start)
        elif c and c in "*+?":
            self.at += 1
            least, most = {"*": (0, None), "+": (1, None), "?": (0, 1)}[c]
        else:
            return item
        self.skip()
        lazy = possessive = False
        if self.take("?"):
            lazy = True
        elif self.take("+"):
            possessive = True
        self.skip()
        if self.peek() in ("*", "+", "?", "{"):
            self.fail("a quantifier cannot follow a quantifier")
        return Rep(item, least, most, True if possessive else lazy == self.flags.swap, possessive)

    def atom(self) -> Node | None:
        if self.quoted:
            self.at += 1
            return self.literal(ord(self.text[self.at - 1]))
        c, start = self.peek(), self.at
        self.at += 1
        if c == "(":
            return self.group()
        if c == "[":
            return self.checked(self.bracket(), start)
        if c == ".":
            return self.dot(start)
        if c in "^$":
            kind = "line_start" if c == "^" else "line_end"
            return self.anchor(kind, multiline=self.flags.multiline)
        if c == "\\":
            return self.escape(start)
        if c in "*+?{}":
            self.fail(f"unexpected metacharacter {c!r}", start)
        return self.literal(ord(c))

    def anchor(self, kind: str, multiline: bool = False) -> Anchor:
        return Anchor(kind, multiline, self.flags.crlf, self.terminator, self.flags.unicode)

    def dot(self, start: int) -> Chars:
        if self.flags.dotall:
            found = self.domain()
        else:
            found = charset.subtract(self.domain(), charset.of("\r\n") if self.flags.crlf else ((self.terminator, self.terminator),))
        node = Chars(charset.subtract(found, ((10, 10),)) if self.never_newline else found, self.raw)
        return self.checked(node, start)

    # --- escapes ----------------------------------------------------------

    def escape(self, start: int) -> Node:
        if self.at >= len(self.text):
            self.fail("a pattern cannot end in a backslash", start)
        c = self.text[self.at]
        self.at += 1
        if found := self.class_escape(c):
            return self.checked(self.chars(found[0], found[1], c.isupper()), start)
        simple = {"A": "text_start", "z": "text_end", "Z": "text_end_newline", "G": "search_start", "B": "non_boundary", "<": "word_start", ">": "word_end"}
        if c in simple:
            return self.anchor(simple[c])
        if c == "b":
            return self.boundary()
        if c == "K":
            return Keep()
        if c == "R":
            return LineBreak(self.flags.unicode, self.never_newline)
        if c == "X":
            return Grapheme()
        if c == "C":
            if not self.bytes:
                self.fail("\\C is for byte patterns", start)
            return Chars(charset.subtract(charset.OCTETS, ((10, 10),)) if self.never_newline else charset.OCTETS, True)
        if c == "N" and self.peek() != "{":
            dot = self.flags
            self.flags = replace(dot, dotall=False)
            node = self.dot(start)
            self.flags = dot
            return node
        if c in "pP":
            found = self.property(c == "P", start)
            return self.checked(found, start)
        if c in "gk":
            return self.reference(c, start)
        if c in "123456789":
            return self.numbered(start)
        return self.checked(self.literal(self.code_point(c, start, False)), start)

    def boundary(self) -> Node:
        if self.peek() != "{":
            return self.anchor("boundary")
        inside = self.text[self.at + 1 : (self.text.find("}", self.at) + 1 or len(self.text) + 1) - 1]
        name = self.squeezed(inside)
        if name in BOUNDARIES and "}" in self.text[self.at :]:
            self.at += len(inside) + 2
            return self.anchor(BOUNDARIES[name])
        if name[:1].isdigit() and name.isascii():
            return self.anchor("boundary")  # a repetition follows
        self.fail("unknown boundary")

    def numbered(self, start: int) -> Node:
        """A back reference if so many groups have been opened, else an octal escape."""
        self.at = start + 1
        to = self.at
        while to < len(self.text) and self.text[to] in string.digits:
            to += 1
        number = int(self.text[self.at : to])
        if number <= self.groups:
            self.at = to
            return Backref(number, self.flags.fold, self.flags.unicode)
        return self.literal(self.octal_digits(start))

    def octal_digits(self, start: int) -> int:
        self.at = start + 1
        digits = ""
        while len(digits) < 3 and self.peek() and self.peek() in string.octdigits:
            digits += self.peek()
            self.at += 1
        if not digits or not self.octal:
            self.fail("invalid escape or reference", start)
        if int(digits, 8) > 0o377:
            self.fail("octal escape is too large", start)
        return int(digits, 8)

    def code_point(self, c: str, start: int, in_class: bool) -> int:
        """The code point of an escape that is one."""
        fixed = {"a": 7, "e": 27, "f": 12, "n": 10, "r": 13, "t": 9, "v": 11} | ({"b": 8} if in_class else {})
        if c in fixed:
            return fixed[c]
        if c in "01234567" and (in_class or c == "0"):
            return self.octal_digits(start)
        if c == "o":
            self.need("{", "\\o needs braces")
            digits = self.squeezed(self.until("}", "unclosed \\o{"))
            if not digits or any(d not in string.octdigits for d in digits):
                self.fail("malformed octal escape", start)
            return self.scalar(int(digits, 8), start)
        if c in "xuU":
            if self.take("{"):
                digits = self.squeezed(self.until("}", "unclosed escape"))
            else:
                digits = self.peek({"x": 2, "u": 4, "U": 8}[c])
                if len(digits) < {"x": 2, "u": 4, "U": 8}[c]:
                    self.fail("too few hexadecimal digits", start)
                self.at += len(digits)
            if not digits or any(d not in string.hexdigits for d in digits):
                self.fail("malformed hexadecimal escape", start)
            return self.scalar(int(digits, 16), start)
        if c == "N":
            self.need("{", "\\N needs a name here")
            name = self.until("}", "unclosed \\N{")
            try:
                return ord(unicodedata.lookup(name.strip().replace("_", " ")))
            except (KeyError, TypeError):
                self.fail("unknown character name", start)
        if c in LETTERS:
            self.fail("invalid escape sequence", start)
        return ord(c)

    def scalar(self, value: int, start: int) -> int:
        if value > charset.TOP or 0xD800 <= value <= 0xDFFF:
            self.fail("not a Unicode scalar value", start)
        return value

    def property(self, negated: bool, start: int) -> Chars:
        if self.take("{"):
            text = self.squeezed(self.until("}", "unclosed property"))
        else:
            text = self.peek()
            self.at += 1
        if text.startswith("^"):
            negated, text = not negated, text[1:]
        value = None
        for sign in ("!=", "=", ":"):
            if sign in text:
                text, _, value = text.partition(sign)
                negated = negated != (sign == "!=")
                break
        found = unidata.property_set(text, value) if text else None
        if found is None:
            self.fail("unknown property", start)
        short = unidata.loose(value or text)
        named = unidata._SHORT.get(short) if value is None or unidata.loose(text) in ("gc", "generalcategory") else None
        return self.chars(found, rf"\p{{{named}}}" if named else None, negated)

    def reference(self, c: str, start: int) -> Node:
        pairs = {"{": "}", "<": ">", "'": "'"}
        opened = self.peek()
        if c == "g" and opened and opened in "-0123456789":
            to = self.at + (opened == "-")
            while to < len(self.text) and self.text[to] in string.digits:
                to += 1
            name, self.at = self.text[self.at : to], to
        elif opened in pairs and opened:
            self.at += 1
            name = self.until(pairs[opened], "unclosed reference")
        else:
            self.fail("malformed reference", start)
        if name.lstrip("+-").isdigit():
            number = int(name)
            if name[0] == "-":
                number = self.groups + 1 + number
            elif name[0] == "+":
                number = self.groups + number
            if number < 0 or not number and name != "0":
                self.fail("reference to a missing group", start)
            target: int | str = number
        else:
            self.valid_name(name, start)
            target = name
        if c == "g" and opened == "'":
            return Call(target)
        if target == 0:
            self.fail("reference to a missing group", start)
        return Backref(target, self.flags.fold, self.flags.unicode)

    def valid_name(self, name: str, start: int) -> str:
        ok = name and (name[0] == "_" or name[0].isalpha()) and all(c == "_" or c in ".[]" or c.isalpha() or unicodedata.category(c) in ("Nd", "Nl", "No") for c in name)
        if not ok:
            self.fail("invalid group name", start)
        return name

    # --- classes ----------------------------------------------------------

    def class_skip(self) -> None:
        if self.flags.extended:
            while self.peek() and (self.peek().isspace() or self.peek() == "#"):
                if self.peek() == "#":
                    to = self.text.find("\n", self.at)
                    self.at = len(self.text) if to < 0 else to + 1
                else:
                    self.at += 1

    def bracket(self) -> Chars:
        found, negated, named = self.class_body()
        return self.chars(found, named, negated)

    def class_operator(self) -> str | None:
        self.class_skip()
        save = self.at
        sign = self.peek()
        if sign and sign in "&-~":
            self.at += 1
            if self.flags.extended:
                self.class_skip()
            if self.peek() == sign:
                self.at += 1
                return sign
        self.at = save
        return None

    def class_body(self) -> tuple[Ranges, bool, str | None]:
        """After '[': the set, whether negated, and its native spelling if it is one escape."""
        start = self.at - 1
        self.depth += 1
        if self.depth > self.nest_limit:
            self.fail("the pattern is nested too deeply")
        self.class_skip()
        negated = self.take("^")
        total: Ranges | None = None
        pending: str | None = None
        items: list[tuple[Ranges, str | None]] = []

        def settle() -> Ranges:
            held = charset.union(*(s for s, _ in items))
            if total is None:
                return held
            return {"&": charset.intersect, "-": charset.subtract, "~": charset.symmetric}[pending](total, held)

        while True:
            self.class_skip()
            if self.at >= len(self.text):
                self.fail("unclosed class", start)
            if self.take("]"):
                if pending and not items:
                    self.fail("a set operation needs a right side")
                self.depth -= 1
                named = items[0][1] if total is None and len(items) == 1 else None
                return settle(), negated, named
            if items or total is not None:
                if sign := self.class_operator():
                    if pending and not items:
                        self.fail("a set operation needs a right side")
                    total, pending, items = settle(), sign, []
                    continue
            items.append(self.class_item())

    def class_item(self) -> tuple[Ranges, str | None]:
        start = self.at
        if self.take("[:"):
            negated = self.take("^")
            name = self.until(":]", "unclosed POSIX class")
            if name not in unidata.POSIX:
                self.fail("unknown POSIX class", start)
            found = unidata.POSIX[name]
            return (charset.complement(found, self.domain()) if negated else found), None
        if self.take("["):
            found, negated, _ = self.class_body()
            return (charset.complement(found, self.domain()) if negated else found), None
        low = self.class_unit()
        if isinstance(low, tuple):
            self.class_skip()
            if self.peek() == "-" and self.peek(2) not in ("-]", "--") and self.text[self.at + 1 : self.at + 2]:
                self.fail("a set cannot start a range")
            return low
        self.class_skip()
        save = self.at
        if self.take("-"):
            self.class_skip()
            nxt = self.peek()
            if nxt and nxt not in "]-":
                if nxt == "[":
                    self.at = save
                    return ((low, low),), None
                high = self.class_unit()
                if isinstance(high, tuple):
                    self.fail("a set cannot end a range", start)
                if high < low:
                    self.fail("a range is reversed", start)
                return charset.intersect(((low, high),), self.domain()), None
            self.at = save
        return ((low, low),), None

    def class_unit(self) -> int | tuple[Ranges, str | None]:
        start, c = self.at, self.peek()
        self.at += 1
        if c != "\\":
            return ord(c)
        if self.at >= len(self.text):
            self.fail("unclosed class", start)
        c = self.text[self.at]
        self.at += 1
        if found := self.class_escape(c):
            return (charset.complement(found[0], self.domain()), None) if c.isupper() else found
        if c in "pP":
            keep = self.flags
            self.flags = replace(keep, fold=False)
            node = self.property(c == "P", start)
            self.flags = keep
            return node.set, node.named
        if c in "RXgk":
            self.fail("not allowed in a class", start)
        if c in "AGKzZB<>CQ":
            return ord(c)
        return self.code_point(c, start, True)

    # --- groups -----------------------------------------------------------

    def scoped(self, flags: Flags | None = None, reset: bool = False) -> Node:
        """The inside of a group up to its ')': flags set inside end with it."""
        outer = self.flags
        if flags is not None:
            self.flags = flags
        node = self.alternation(reset)
        self.need(")", "unclosed group")
        self.flags = outer
        return node

    def capture(self, name: str | None = None, balance: str | None = None) -> Node:
        self.groups += 1
        index = self.groups
        if name:
            if name in self.names.values() and self.names.get(index) != name and not self.flags.duplicates:
                self.fail("duplicate group name")
            self.names[index] = name
        return Group(self.scoped(), index, name, balance)

    def group(self) -> Node | None:
        start = self.at - 1
        if self.take("*"):
            return self.starred(start)
        if not self.take("?"):
            if self.flags.nameless:
                return Group(self.scoped())
            return self.capture()
        if self.take(":"):
            return Group(self.scoped())
        if self.take("|"):
            return Group(self.scoped(reset=True))
        if self.take(">"):
            return Atomic(self.scoped())
        for sign, spec in (("=", (False, False, True)), ("!", (False, True, True)), ("<=", (True, False, True)), ("<!", (True, True, True)), ("*", (False, False, False)), ("<*", (True, False, False))):
            if self.take(sign):
                if sign == "<!" and self.peek() == "*":
                    self.fail("malformed lookbehind", start)
                return Look(self.scoped(), *spec)
        if self.take("P"):
            if self.take("="):
                name = self.valid_name(self.until(")", "unclosed reference"), start)
                return Backref(name, self.flags.fold, self.flags.unicode)
            if self.take(">"):
                return Call(self.valid_name(self.until(")", "unclosed call"), start))
            if self.peek() not in ("<", "'") or not self.peek():
                self.fail("malformed group", start)
        if self.take("<"):
            return self.named(">", start)
        if self.take("'"):
            return self.named("'", start)
        if self.take("&"):
            return Call(self.valid_name(self.until(")", "unclosed call"), start))
        if self.take("R"):
            if self.take(")"):
                return Call(0)
            self.at -= 1
        elif self.take("C"):
            return self.callout(start)
        elif self.take("("):
            return self.conditional(start)
        elif self.peek() and (self.peek() in string.digits or self.peek() in "+-" and self.peek(2)[1:].isdigit()):
            text = self.until(")", "unclosed call")
            if not text.lstrip("+-").isdigit():
                self.fail("malformed call", start)
            number = int(text)
            if text[0] == "-":
                number += self.groups + 1
            elif text[0] == "+":
                number += self.groups
            if number < 0 or number == 0 and text != "0":
                self.fail("call of a missing group", start)
            return Call(number)
        return self.set_flags(start)

    def named(self, end: str, start: int) -> Node:
        text = self.until(end, "unclosed group name")
        name, dash, balance = text.partition("-")
        if dash:
            self.valid_name(balance, start)
            if not name:
                return Group(self.scoped(), None, None, balance)
        return self.capture(self.valid_name(name, start), balance if dash else None)

    def set_flags(self, start: int) -> Node | None:
        flags, on, seen = self.flags, True, set()
        while True:
            c = self.peek()
            self.at += 1
            if c == ")":
                if not seen and on:
                    self.fail("malformed group", start)
                self.flags = flags
                return None
            if c == ":":
                return Group(self.scoped(flags))
            if c == "-" and on:
                on = False
            elif c and c in FLAGS and c not in seen:
                seen.add(c)
                flags = replace(flags, **{FLAGS[c]: on})
            else:
                self.fail("malformed flags", start)

    def starred(self, start: int) -> Node:
        """(*name:...) lookarounds and (*VERB:tag)."""
        to = self.at
        while to < len(self.text) and (self.text[to].isalpha() or self.text[to] == "_"):
            to += 1
        name, self.at = self.text[self.at : to], to
        if name.lower() in LOOKS:
            self.need(":", "malformed lookaround")
            return Look(self.scoped(), *LOOKS[name.lower()])
        verb = "mark" if not name else VERBS.get(name.upper())
        if verb is None:
            self.fail("unknown control verb", start)
        tag = None
        if self.take(":"):
            tag = self.until(")", "unclosed control verb")
            if verb not in ("mark", "skip") or not tag or "\\" in tag:
                self.fail("malformed control verb", start)
        else:
            self.need(")", "unclosed control verb")
        if verb == "mark" and not tag:
            self.fail("a mark needs a tag", start)
        return Verb(verb, tag)

    def callout(self, start: int) -> Node:
        if self.take(")"):
            return Callout(0)
        c = self.peek()
        if c and c in string.digits:
            text = self.until(")", "unclosed callout")
            if not text.isdigit() or int(text) > 255:
                self.fail("malformed callout", start)
            return Callout(int(text))
        if c and c in "\"'^%#${":
            self.at += 1
            tag = self.until("}" if c == "{" else c, "unclosed callout")
            if "\\" in tag:
                self.fail("malformed callout", start)
            self.need(")", "unclosed callout")
            return Callout(0, tag)
        self.fail("malformed callout", start)

    def conditional(self, start: int) -> Node:
        outer = self.flags
        test: tuple | Look
        if self.peek() in ("?", "*") and self.peek():
            found = self.group()
            if not isinstance(found, Look):
                self.fail("a condition must be a lookaround", start)
            test = found
        else:
            text = self.until(")", "unclosed condition")
            if text == "DEFINE":
                test = ("define",)
            elif text == "R":
                test = ("recursion", None)
            elif text[:1] == "R" and text[1:].isdigit():
                test = ("recursion", int(text[1:]))
            elif text[:2] == "R&":
                test = ("recursion", self.valid_name(text[2:], start))
            elif text.isdigit():
                test = ("group", int(text))
            elif text[:1] in "+-" and text[1:].isdigit():
                test = ("group", self.groups + int(text) + (text[0] == "-"))
            else:
                if text[:1] + text[-1:] in ("<>", "''") and len(text) > 2:
                    text = text[1:-1]
                test = ("group", self.valid_name(text, start))
        body = self.alternation()
        self.need(")", "unclosed conditional")
        self.flags = outer
        items = body.items if isinstance(body, Alt) else (body,)
        if len(items) > 2 or test == ("define",) and len(items) > 1:
            self.fail("a conditional has at most two branches", start)
        return Cond(test, items[0], items[1] if len(items) > 1 else Cat())

    def validate(self, root: Node, names: set[str]) -> None:
        """Every reference has its group."""
        groups = {n.index for n in walk(root) if isinstance(n, Group) and n.index}

        def known(target: int | str) -> bool:
            return target in names if isinstance(target, str) else target == 0 or target in groups

        for node in walk(root):
            targets: list[int | str] = []
            if isinstance(node, (Backref, Call)):
                targets.append(node.target)
            elif isinstance(node, Cond) and isinstance(node.test, tuple) and len(node.test) > 1 and node.test[1] is not None:
                targets.append(node.test[1])
            if not all(map(known, targets)):
                self.fail("reference to a missing group", len(self.text))
