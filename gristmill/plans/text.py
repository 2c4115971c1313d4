"""Reading units and testing positions, in texts and in octets."""

from __future__ import annotations

from functools import lru_cache

from . import charset, unidata
from .charset import Ranges, Test
from .nodes import Anchor


@lru_cache(maxsize=4096)
def tester(found: Ranges) -> Test:
    return Test(found)


@lru_cache(maxsize=2)
def word_test(unicode: bool) -> Test:
    return Test(unidata.word() if unicode else unidata.POSIX["word"])


def decode(data: bytes, at: int) -> tuple[int, int] | None:
    """The code point at a place of octets and its width, if there is a whole character."""
    if at >= len(data):
        return None
    lead = data[at]
    width = 1 if lead < 0x80 else 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 0
    if not width or at + width > len(data):
        return None
    if width == 1:
        return lead, 1
    try:
        return ord(data[at : at + width].decode()), width
    except UnicodeDecodeError:
        return None


def decode_before(data: bytes, at: int) -> tuple[int, int] | None:
    for width in range(1, min(4, at) + 1):
        found = decode(data, at - width)
        if found and found[1] == width:
            return found
    return None


def inside_character(data: bytes, at: int) -> bool:
    """Is a place in the middle of a character's octets?"""
    if not 0 < at < len(data) or data[at] & 0xC0 != 0x80:
        return False
    return any((found := decode(data, at - back)) and found[1] > back for back in range(1, min(3, at) + 1))


def neighbours(text: str | bytes, at: int, unicode: bool) -> tuple[int | None, int | None]:
    """The code points before and after a place."""
    if isinstance(text, str):
        return ord(text[at - 1]) if at > 0 else None, ord(text[at]) if at < len(text) else None
    if not unicode:
        return text[at - 1] if at > 0 else None, text[at] if at < len(text) else None
    before, after = decode_before(text, at), decode(text, at)
    return before[0] if before else None, after[0] if after else None


def holds(anchor: Anchor, text: str | bytes, at: int, search_start: int, length: int) -> bool:
    """Does an anchor hold at a place?  ``length`` is where the text counts as ended."""
    kind = anchor.kind
    unit = (lambda i: ord(text[i])) if isinstance(text, str) else (lambda i: text[i])
    if kind == "text_start" or kind == "line_start" and not anchor.multiline:
        return at == 0
    if kind == "text_end" or kind == "line_end" and not anchor.multiline:
        return at == length
    if kind == "line_start":
        if at == 0:
            return True
        before = unit(at - 1)
        if anchor.crlf:
            return before == 10 or before == 13 and not (at < length and unit(at) == 10)
        return before == anchor.terminator
    if kind == "line_end":
        if at == length:
            return True
        now = unit(at)
        if anchor.crlf:
            return now == 13 or now == 10 and not (at > 0 and unit(at - 1) == 13)
        return now == anchor.terminator
    if kind == "text_end_newline":
        last = length
        if length and unit(length - 1) == 10:
            last = length - (2 if length > 1 and unit(length - 2) == 13 else 1)
        return at == length and last == length or at == last
    if kind == "search_start":
        return at == search_start
    if kind in ("grapheme_boundary", "word_break", "sentence_break"):
        from . import segments

        return segments.is_boundary(kind, text, at)
    if isinstance(text, bytes) and anchor.unicode and inside_character(text, at):
        return False
    before, after = neighbours(text[:length] if length < len(text) else text, at, anchor.unicode)
    test = word_test(anchor.unicode)
    left, right = before is not None and test(before), after is not None and test(after)
    return {
        "boundary": left != right,
        "non_boundary": left == right,
        "word_start": not left and right,
        "word_end": left and not right,
        "word_start_half": not left,
        "word_end_half": not right,
    }[kind]


def fold_equal(a: int, b: int, unicode: bool) -> bool:
    if a == b:
        return True
    if not unicode or a < 128 and b < 128:
        return a < 128 and b < 128 and chr(a).lower() == chr(b).lower()
    return b in unidata.partners().get(a, ())


__all__ = ["charset", "decode", "fold_equal", "holds", "inside_character", "neighbours", "tester"]
