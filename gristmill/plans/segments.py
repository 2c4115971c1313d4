"""Grapheme clusters, and word and sentence boundaries, by the rules of UAX #29."""

from __future__ import annotations

from functools import lru_cache

from . import unidata
from .charset import Test

#: The classes of each property.
CLASSES = {
    "GCB": ("CR", "LF", "Control", "Extend", "ZWJ", "Regional_Indicator", "Prepend", "SpacingMark", "L", "V", "T", "LV", "LVT"),
    "WB": ("CR", "LF", "Newline", "Extend", "ZWJ", "Format", "Katakana", "Hebrew_Letter", "ALetter", "Single_Quote", "Double_Quote", "MidNumLet", "MidLetter", "MidNum", "Numeric", "ExtendNumLet", "Regional_Indicator", "WSegSpace"),
    "SB": ("CR", "LF", "Sep", "Extend", "Format", "Sp", "Lower", "Upper", "OLetter", "Numeric", "ATerm", "SContinue", "STerm", "Close"),
}

@lru_cache(maxsize=4)
def tests(prop: str) -> list[tuple[str, Test]]:
    out = []
    for name in CLASSES[prop]:
        found = unidata.probe(f"{prop}={name}")
        if found is None and prop == "GCB" and unidata.probe("GCB=CR") is None:
            raise RuntimeError("text segmentation needs the regex module's property data")
        out.append((name, Test(found or ())))
    return out


@lru_cache(maxsize=1 << 16)
def kind(prop: str, cp: int) -> str:
    return next((name for name, test in tests(prop) if test(cp)), "Other")


@lru_cache(maxsize=1)
def pictographic() -> Test:
    return Test(unidata.probe("Extended_Pictographic") or ())


@lru_cache(maxsize=3)
def conjunct(role: str) -> Test:
    """Characters of a role in Indic conjuncts."""
    return Test(unidata.probe(f"InCB={role}") or ())


def grapheme_break(cps: list[int], at: int) -> bool:
    """Is there a boundary between cps[at - 1] and cps[at]?"""
    a, b = kind("GCB", cps[at - 1]), kind("GCB", cps[at])
    if a == "CR" and b == "LF":
        return False
    if a in ("Control", "CR", "LF") or b in ("Control", "CR", "LF"):
        return True
    if a == "L" and b in ("L", "V", "LV", "LVT") or a in ("LV", "V") and b in ("V", "T") or a in ("LVT", "T") and b == "T":
        return False
    if b in ("Extend", "ZWJ", "SpacingMark") or a == "Prepend":
        return False
    if conjunct("Consonant")(cps[at]):  # consonant, marks with a linker among them, consonant
        i, linked = at - 1, False
        while i >= 0 and (conjunct("Linker")(cps[i]) or conjunct("Extend")(cps[i])):
            linked = linked or conjunct("Linker")(cps[i])
            i -= 1
        if linked and i >= 0 and conjunct("Consonant")(cps[i]):
            return False
    if a == "ZWJ" and pictographic()(cps[at]):
        i = at - 2
        while i >= 0 and kind("GCB", cps[i]) == "Extend":
            i -= 1
        if i >= 0 and pictographic()(cps[i]):
            return False
    if a == b == "Regional_Indicator":
        i = at - 1
        while i >= 0 and kind("GCB", cps[i]) == "Regional_Indicator":
            i -= 1
        return (at - 1 - i) % 2 == 0
    return True


AH = ("ALetter", "Hebrew_Letter")
SKIPPED = ("Extend", "Format", "ZWJ")


def _near(prop: str, cps: list[int], at: int, step: int, skipped: tuple[str, ...]) -> tuple[int, str]:
    at += step
    while 0 <= at < len(cps) and kind(prop, cps[at]) in skipped:
        at += step
    return at, kind(prop, cps[at]) if 0 <= at < len(cps) else ""


def word_break(cps: list[int], at: int) -> bool:
    raw_a, b = kind("WB", cps[at - 1]), kind("WB", cps[at])
    if raw_a == "CR" and b == "LF":
        return False
    if raw_a in ("Newline", "CR", "LF") or b in ("Newline", "CR", "LF"):
        return True
    if raw_a == "ZWJ" and pictographic()(cps[at]) or raw_a == b == "WSegSpace" or b in SKIPPED:
        return False
    i, a = _near("WB", cps, at, -1, SKIPPED)
    _, before = _near("WB", cps, i, -1, SKIPPED) if i >= 0 else (0, "")
    _, after = _near("WB", cps, at, 1, SKIPPED)
    quote = ("Single_Quote", "MidNumLet")
    if a in AH and (b in AH or b in ("MidLetter", *quote) and after in AH):
        return False
    if a in ("MidLetter", *quote) and before in AH and b in AH:
        return False
    if a == "Hebrew_Letter" and (b == "Single_Quote" or b == "Double_Quote" and after == "Hebrew_Letter") or a == "Double_Quote" and before == b == "Hebrew_Letter":
        return False
    if a == "Numeric" and (b == "Numeric" or b in AH or b in ("MidNum", *quote) and after == "Numeric") or a in AH and b == "Numeric":
        return False
    if a in ("MidNum", *quote) and before == b == "Numeric" or a == b == "Katakana":
        return False
    if a in (*AH, "Numeric", "Katakana", "ExtendNumLet") and b == "ExtendNumLet" or a == "ExtendNumLet" and b in (*AH, "Numeric", "Katakana"):
        return False
    if a == b == "Regional_Indicator":
        many = 0
        while i >= 0 and kind("WB", cps[i]) == "Regional_Indicator":
            many += 1
            i, _ = _near("WB", cps, i, -1, SKIPPED)
        return many % 2 == 0
    return True


def sentence_break(cps: list[int], at: int) -> bool:
    raw_a, b = kind("SB", cps[at - 1]), kind("SB", cps[at])
    if raw_a == "CR" and b == "LF":
        return False
    if raw_a in ("Sep", "CR", "LF"):
        return True
    if b in ("Extend", "Format"):
        return False
    skipped = ("Extend", "Format")
    i, a = _near("SB", cps, at, -1, skipped)
    if a == "ATerm" and b == "Numeric":
        return False
    if a == "ATerm" and b == "Upper" and i >= 0 and _near("SB", cps, i, -1, skipped)[1] in ("Upper", "Lower"):
        return False
    # Before here: a terminator, closers, spaces.
    j, now, spaces, closers = i, a, 0, 0
    while now == "Sp":
        spaces += 1
        j, now = _near("SB", cps, j, -1, skipped)
    while now == "Close":
        closers += 1
        j, now = _near("SB", cps, j, -1, skipped)
    if now not in ("ATerm", "STerm"):
        return False
    if now == "ATerm":
        k, nxt = at, b
        while nxt and nxt not in ("OLetter", "Upper", "Lower", "Sep", "CR", "LF", "STerm", "ATerm"):
            k, nxt = _near("SB", cps, k, 1, skipped)
        if nxt == "Lower":
            return False
    if b in ("SContinue", "ATerm", "STerm"):
        return False
    if not spaces and b in ("Close", "Sp", "Sep", "CR", "LF"):
        return False
    return b not in ("Sp", "Sep", "CR", "LF")


BREAKS = {"grapheme_boundary": grapheme_break, "word_break": word_break, "sentence_break": sentence_break}


def is_boundary(name: str, text: str | bytes, at: int) -> bool:
    if isinstance(text, bytes):
        try:
            left, right = text[:at].decode(), text[at:].decode()
        except UnicodeDecodeError:
            return False
    else:
        left, right = text[:at], text[at:]
    if not left or not right:
        return bool(left or right)
    return BREAKS[name]([*map(ord, left + right)], len(left))


def cluster_end(text: str, at: int) -> int:
    """The end of the grapheme cluster that starts at a place, which is before the text's end."""
    near = max(0, at - 64)
    cps = [ord(c) for c in text[near : at + 1]]
    end = at + 1
    while end < len(text):
        cps.append(ord(text[end]))
        if grapheme_break(cps[at - near :], len(cps) - 1 - (at - near)):
            return end
        end += 1
    return end
