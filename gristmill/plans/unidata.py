"""Unicode properties and case folding, as sets of code points, on the driver."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from . import charset
from .charset import Ranges

#: The 14 ASCII classes.
POSIX: dict[str, Ranges] = {
    "alnum": charset.ranges([(48, 57), (65, 90), (97, 122)]),
    "alpha": charset.ranges([(65, 90), (97, 122)]),
    "ascii": ((0, 127),),
    "blank": charset.of("\t "),
    "cntrl": ((0, 31), (127, 127)),
    "digit": ((48, 57),),
    "graph": ((33, 126),),
    "lower": ((97, 122),),
    "print": ((32, 126),),
    "punct": ((33, 47), (58, 64), (91, 96), (123, 126)),
    "space": ((9, 13), (32, 32)),
    "upper": ((65, 90),),
    "word": charset.ranges([(48, 57), (65, 90), (95, 95), (97, 122)]),
    "xdigit": charset.ranges([(48, 57), (65, 70), (97, 102)]),
}
#: Fixed value: horizontal space.
HORIZONTAL: Ranges = charset.ranges([(9, 9), (32, 32), (0xA0, 0xA0), (0x1680, 0x1680), (0x180E, 0x180E), (0x2000, 0x200A), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)])
#: Long names of general categories.
CATEGORIES = {
    "letter": "L", "casedletter": "LC", "uppercaseletter": "Lu", "lowercaseletter": "Ll", "titlecaseletter": "Lt", "modifierletter": "Lm", "otherletter": "Lo",
    "mark": "M", "combiningmark": "M", "nonspacingmark": "Mn", "spacingmark": "Mc", "enclosingmark": "Me", "number": "N", "decimalnumber": "Nd", "decimaldigitnumber": "Nd", "digit": "Nd", "letternumber": "Nl", "othernumber": "No",
    "punctuation": "P", "punct": "P", "connectorpunctuation": "Pc", "dashpunctuation": "Pd", "openpunctuation": "Ps", "closepunctuation": "Pe", "initialpunctuation": "Pi", "finalpunctuation": "Pf", "otherpunctuation": "Po",
    "symbol": "S", "mathsymbol": "Sm", "currencysymbol": "Sc", "modifiersymbol": "Sk", "othersymbol": "So", "separator": "Z", "spaceseparator": "Zs", "lineseparator": "Zl", "paragraphseparator": "Zp",
    "other": "C", "control": "Cc", "cntrl": "Cc", "format": "Cf", "surrogate": "Cs", "privateuse": "Co", "unassigned": "Cn",
}
_SHORT = {c.lower(): c for c in CATEGORIES.values()}


@lru_cache(maxsize=1)
def category_runs() -> dict[str, Ranges]:
    """The ranges of every two-letter category."""
    held: dict[str, list[tuple[int, int]]] = {}
    start, last = 0, unicodedata.category("\0")
    for cp in range(1, charset.TOP + 2):
        now = unicodedata.category(chr(cp)) if cp <= charset.TOP else ""
        if now != last:
            held.setdefault(last, []).append((start, cp - 1))
            start, last = cp, now
    return {k: tuple(v) for k, v in held.items()}


@lru_cache(maxsize=64)
def category(name: str) -> Ranges:
    wanted = ("Lu", "Ll", "Lt") if name == "LC" else tuple(k for k in category_runs() if k.startswith(name))
    return charset.intersect(charset.union(*(category_runs().get(k, ()) for k in wanted)), charset.ALL)


def loose(name: str) -> str:
    """A property name without case, blanks, underscores and hyphens."""
    found = "".join(c for c in name.lower() if c not in " _-")
    return found[2:] if found.startswith("is") and len(found) > 2 else found


@lru_cache(maxsize=1)
def every() -> list[tuple[int, str]]:
    """All characters in order, as strings with the first one's code point."""
    return [(lo, "".join(map(chr, range(lo, hi + 1)))) for lo, hi in charset.ALL]


@lru_cache(maxsize=256)
def probe(spelling: str) -> Ranges | None:
    """The set of a property that the standard library lacks, read off the ``regex`` module."""
    try:
        import regex
    except ImportError:
        return None
    try:
        found = regex.compile(rf"\p{{{spelling}}}+", regex.V1)
    except regex.error:
        return None
    out: list[tuple[int, int]] = []
    for lo, held in every():
        out += [(lo + m.start(), lo + m.end() - 1) for m in found.finditer(held)]
    return charset.ranges(out)


# The versions that added characters, in order.
VERSIONS = ("1.1", "2.0", "2.1", "3.0", "3.1", "3.2", "4.0", "4.1", "5.0", "5.1", "5.2", "6.0", "6.1", "6.2", "6.3", "7.0", "8.0", "9.0", "10.0", "11.0", "12.0", "12.1", "13.0", "14.0", "15.0", "15.1", "16.0")


def age(value: str) -> Ranges | None:
    """The code points that were added in a version ("15.1", "V15_1", "v151", "5"); None if there is none such.

    Read off the Unicode library that comes with Spark, so a session must be running.
    """
    held = "".join(c for c in value.lower().replace("_", ".") if c.isalnum() or c == ".").removeprefix("v")
    whole = {v.partition(".")[0]: v for v in VERSIONS if v.endswith(".0")}
    version = held if held in VERSIONS else whole.get(held) or {v.replace(".", ""): v for v in VERSIONS}.get(held)
    return None if version is None else _added(version)


@lru_cache(maxsize=32)
def _added(version: str) -> Ranges:
    from pyspark import SparkContext

    context = SparkContext._active_spark_context
    if context is None:
        raise RuntimeError("the Age property needs a running Spark session")
    nth = VERSIONS.index(version)
    older = f"-[:age={VERSIONS[nth - 1]}:]" if nth else ""
    found = context._jvm.com.ibm.icu.text.UnicodeSet(f"[[:age={version}:]{older}]")
    return charset.intersect(charset.ranges([(found.getRangeStart(i), found.getRangeEnd(i)) for i in range(found.getRangeCount())]), charset.ALL)


@lru_cache(maxsize=256)
def property_set(name: str, value: str | None) -> Ranges | None:
    """The set of ``name`` or ``name=value``; None if there is no such property."""
    key = loose(name)
    if value is None:
        if key in _SHORT or key in CATEGORIES:
            return category(_SHORT.get(key) or CATEGORIES[key])
        if key == "any":
            return charset.ALL
        if key == "ascii":
            return ((0, 127),)
        if key == "assigned":
            return charset.complement(category("Cn"))
        if key in ("punct", "digit", "cntrl") or not key:
            return None
        return probe(name.strip()) if name.strip().replace("_", "").replace(" ", "").replace("-", "").isalnum() else None
    held = loose(value)
    if key in ("gc", "generalcategory"):
        found = _SHORT.get(held) or CATEGORIES.get(held)
        return category(found) if found else None
    if key == "age":
        return age(value)
    if not held or not key or not all(c.isalnum() for c in key + held):
        return None
    return probe(f"{name.strip()}={value.strip()}")


@lru_cache(maxsize=1)
def word() -> Ranges:
    """Characters of words: alphabetic, marks, decimal digits, connectors, joiners."""
    alphabetic = probe("Alphabetic") or charset.union(category("L"), category("Nl"))
    return charset.union(alphabetic, category("M"), category("Nd"), category("Pc"), ((0x200C, 0x200D),))


@lru_cache(maxsize=1)
def space() -> Ranges:
    """White_Space."""
    return charset.ranges([(9, 13), (32, 32), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)])


def simple_fold(c: str) -> str:
    for found in (c.casefold(), c.lower()):
        if len(found) == 1:
            return found
    return c


@lru_cache(maxsize=1)
def partners() -> dict[int, tuple[int, ...]]:
    """For each code point with case the others of the same simple folding."""
    classes: dict[str, list[int]] = {}
    for cp in range(0x20000):
        if not 0xD800 <= cp <= 0xDFFF:
            c = chr(cp)
            if (key := simple_fold(c)) != c:
                classes.setdefault(key, [ord(key)]).append(cp)
    return {cp: tuple(x for x in held if x != cp) for held in classes.values() for cp in held}


@lru_cache(maxsize=256)
def folded(a: Ranges, ascii_only: bool = False) -> Ranges:
    """The set with the case variants of its members."""
    more: list[tuple[int, int]] = []
    if ascii_only:
        for lo, hi in a:
            for x, y, d in ((65, 90, 32), (97, 122, -32)):
                if lo <= y and hi >= x:
                    more.append((max(lo, x) + d, min(hi, y) + d))
    else:
        test = charset.Test(a)
        more = [(p, p) for cp, others in partners().items() if test(cp) for p in others]
    return charset.ranges([*a, *more])
