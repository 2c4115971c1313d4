"""The pattern language on one text: rule by rule, against engines of other makers or a brute-force reading.

Where Python's ``re`` or the ``regex`` module says the same thing, they are the oracle;
rules that are this language's own are checked by what the rule says.
"""

import itertools
import random
import re

import pytest
import regex

from gristmill.operators import matching as m
from gristmill.plans import analysis
from gristmill.plans.errors import AdvancedLimitError, FuzzyLimitError, FuzzyUnsupported, MatchTimeout, PatternError, PatternSyntaxError
from gristmill.plans.pattern import compile, compile_bytes, escape

SUBJECTS = ["", "q", "river bank", "Oslo 2031, Rome 7", "x=1;y=22;;z=", "kayak level noon", "tab\there\nline two\r\nline three", "ÅngströmßΣσς", "((a)(b(c)))", "aaabbbccc", "\U0001f600 smile", "naïve café", "2024-05-17T08:09", "<b>bold</b><i>x</i>", "_under_score9"]


def span(found):
    return found and found.spans[0]


def spans(found):
    return [x.spans[0] for x in found]


def by(engine, pattern, text):
    """(first match with groups, all whole matches that are not empty) by another engine."""
    found = engine.search(pattern, text)
    first = found and [None if s[0] < 0 else s for s in (found.span(i) for i in range(len(found.groups()) + 1))]
    return first, [x.span() for x in engine.finditer(pattern, text) if x.end() > x.start()]


#: Patterns that ``re`` reads in the same way.
SAME_AS_RE = [
    "bank", "r|b|k", "(o|O)(s|n)", "[A-Z][a-z]+", "[^a-z ]+", "[0-9]{2,4}", "[0-9]{2,4}?", "[a-c]{3}", "(?:ab|b)+c?", "(a+)(b*)", "(x)?=", "(?P<key>[a-z])=(?P<value>[0-9]*)", r"\Ariver", r"k\Z", r"\bnoon\b", r"\Boo\B",
    r"(?m:^line [a-z]+$)", "(?s:here.line)", "(?i:OSLO|rome)", r"([a-z])\1", r"(?P<c>[a-z])[a-z]?(?P=c)", "(?<==)[0-9]+", "(?<!=)[0-9]", "[a-z]+(?==)", "[a-z](?!=)", r"\.|;|,", r"[\]\[^-]|[-_]", r"[\t\n]", r"\x41|\u00e9", "a{2}b{2}", "[a-z]*?9", "(?:a|aa)(?:b|ab)", r"(?:[a-z]+[ ,])+", "(a|b|c)*", "(?>aa|a)b", "a++b", "[a-z]*+ ", "(?:ab?)?+b",
]


@pytest.mark.parametrize("pattern", SAME_AS_RE)
def test_as_re(pattern):
    own = compile(pattern.replace(r"\Z", r"\z"))
    for text in SUBJECTS:
        first, every = by(re, pattern, text)
        found = m.find(own, text)
        assert (found and list(found.spans)) == first, text
        assert [s for s in spans(m.each(own, text)) if s[0] < s[1]] == every, text
        exact = m.advanced(own, text)  # the backtracking engine says the same
        assert (exact and exact.spans[0]) == (first and first[0]), text


#: Patterns that the ``regex`` module reads in the same way.
SAME_AS_REGEX = [
    r"\((?:[^()]|(?R))*\)", r"(?P<p>\((?:[^()]|(?P>p))*\))", r"(?|(Oslo)|(Rome)) ([0-9]+)", r"[a-z]+\K=", r"\p{Lu}\p{Ll}+", r"\P{L}+", r"\p{Greek}+", r"\X", r"(?i:ΣΣ)", r"(?i)ångström", r"(?(?=[0-9])[0-9]{4}|[a-z]{3})", r"(<)?b(?(1)>|o)", r"\b(?:[a-z])(?&w)?\b(?(DEFINE)(?P<w>[a-z]+))", r"(?<=[a-z]+)\d", r"(?<=\b[A-Z][a-z]+ )[0-9]+", r"[\w--[a-z_]]+", r"[\w&&[^\d]]+", r"[[a-m]~~[h-z]]+", r"\G[a-z]", r"(?:(?=([a-z]+))\1)+", r"(\w)(?:\w?|(?1))\1", r"[^\W\d_]+", r"\h+",
]


@pytest.mark.parametrize("pattern", SAME_AS_REGEX)
def test_as_regex(pattern):
    own = compile(pattern)
    for text in SUBJECTS:
        found = regex.search(pattern, text, flags=regex.V1)
        assert span(m.find(own, text)) == (found and found.span()), text
        every = [x.span() for x in regex.finditer(pattern, text, flags=regex.V1) if x.end() > x.start()]
        if r"\K" not in pattern and r"\G" not in pattern:
            assert [s for s in spans(m.each(own, text)) if s[0] < s[1]] == every, text


def random_pattern(rng, depth=0):
    kind = rng.randrange(8 if depth < 3 else 3)
    if kind < 2:
        return rng.choice("abc.")
    if kind == 2:
        return rng.choice(["[ab]", "[^b]", "[a-c]", r"\b", "^", "$" if depth else "c"])
    inner = random_pattern(rng, depth + 1)
    if kind == 3:
        return f"({inner})"
    if kind == 4:
        return f"(?:{inner})" + rng.choice(["*", "+", "?", "{1,2}", "*?", "+?", "??"])
    if kind == 5:
        return f"(?:{inner}|{random_pattern(rng, depth + 1)})"
    return inner + random_pattern(rng, depth + 1)


def test_random_patterns():
    """Thousands of small patterns on all texts of a few letters: both exact engines and ``re`` agree on whole matches."""
    rng = random.Random(77)
    texts = ["".join(t) for n in range(5) for t in itertools.product("abc", repeat=n)]
    for _ in range(300):
        pattern = random_pattern(rng)
        own = compile(pattern)
        for text in rng.sample(texts, 12):
            want = re.search(pattern.replace("$", r"\Z"), text)
            want = want and want.span()
            assert span(m.find(own, text)) == want, (pattern, text)
            if not analysis.explosive(own.node):
                assert span(m.advanced(own, text)) == want, (pattern, text)
            whole = re.fullmatch(pattern.replace("$", r"\Z"), text)
            assert (m.full_match(own, text) is not None) == (whole is not None), (pattern, text)


def test_policies_by_brute_force():
    """Shortest and longest: over all ends that a full match reaches from the leftmost start."""
    rng = random.Random(78)
    texts = ["".join(t) for n in range(6) for t in itertools.product("ab", repeat=n)]
    for _ in range(150):
        pattern = random_pattern(rng).replace(r"\b", "a").replace("^", "b").replace("$", "c")
        own = compile(pattern)
        for text in rng.sample(texts, 8):
            ends = next(((i, e) for i in range(len(text) + 1) if (e := [j for j in range(i, len(text) + 1) if re.fullmatch(pattern, text[i:j])])), None)
            assert m.shortest(own, text) == (ends and min(ends[1])), (pattern, text)
            assert span(m.longest(own, text)) == (ends and (ends[0], max(ends[1]))), (pattern, text)


#: One malformed pattern for each rule, and what the rule is.
MALFORMED = {
    "open group": "river(", "open named group": "(?<bank>q", "group without end": "(?:q|r", "close without open": "q)", "quantifier first": "+q", "two quantifiers": "q{2}{3}", "lazy possessive": "q?+?", "bounds in disorder": "q{5,2}", "bound too large": "q{1001}", "open bound": "q{7", "lone brace": "q}",
    "range in disorder": "[q-b]", "open class": "[qr", "open nested class": "[q[r]", "class name": "[[:vowel:]]", "range up to a class": r"[q-\w]", "operator without operand": "[q--", "escape of a letter": r"\y", "escape at the end": "q\\", "two digits": r"\x4", "brace without digits": r"\x{}", "beyond Unicode": r"\x{200000}", "surrogate": r"\u{DFFF}", "four digits": r"\u00e", "octal beyond a byte": r"\777", "octal without braces": r"\o17", "octal digit": r"\o{9}",
    "unknown property": r"\p{Riverness}", "unknown script": r"\p{Script=Bankish}", "open property": r"\p{Lu", "unknown boundary": r"\b{paragraph}", "group name": "(?<4x>q)", "name twice": "(?<q>a)(?<q>b)", "unknown flag": "(?k)q", "flag twice": "(?ss)q", "second minus": "(?s-i-m)q", "no such group": r"(q)\g{4}", "no such name": r"\k<bank>", "call of no group": "(?3)", "call of no name": "(?&bank)", "condition on no group": "(?(2)q)", "condition open": "(?(1", "comment open": "(?#q", "verb": "(*RIVER)", "mark without name": "(*MARK)", "fail with a name": "(*FAIL:q)", "three branches": "(q)(?(1)a|b|c)", "raw set in text": r"(?-u:[^q])", "raw octet in text": r"(?-u:\xFF)", "empty unknown class escape": r"[\R]",
}


@pytest.mark.parametrize("rule", list(MALFORMED))
def test_malformed(rule):
    with pytest.raises(PatternSyntaxError) as e:
        compile(MALFORMED[rule])
    assert isinstance(e.value, PatternError) and e.value.pattern == MALFORMED[rule] and 0 <= e.value.position <= len(MALFORMED[rule]) and e.value.reason


def test_readers():
    p = compile(r"(?<year>\d{4})-(\d\d)(?:-(?<day>\d\d))?", case_insensitive=True)
    assert (p.group_count, p.capture_count, p.capture_names) == (3, 4, (None, "year", None, "day"))
    assert [p.group_index(n) for n in ("year", "day", "month")] == [1, 3, None] and not p.advanced and p.options.case_insensitive
    for pattern, want in (("(a)(b)", 3), ("(a)|(b)", 2), ("(a)|b", None), ("(a)?", None), ("(a)+", 2), ("a", 1), ("(?=(a))a", 2), ("(?!(a))b", 1)):
        assert compile(pattern).static_capture_count == want, pattern
    assert [compile(x).advanced for x in ("a+b", "(?=a)", r"(a)\1", "a++", r"\X", "(?>a)")] == [False, True, True, True, True, True]
    with pytest.raises(TypeError):
        compile("a", size_limit="many")
    with pytest.raises(TypeError):
        compile("a", line_terminator="ab")
    with pytest.raises(PatternSyntaxError):
        compile(7)


def test_options():
    f = lambda pattern, text, **o: span(m.find(compile(pattern, **o), text))
    assert f("RIVER", "a river", case_insensitive=True) == (2, 7) and f("^two$", "one\ntwo\n", multi_line=True) == (4, 7) and f("e.t", "one\ntwo", dot_matches_new_line=True) == (2, 5)
    assert f("w+", "www", swap_greed=True) == (0, 1) and f("w+?", "www", swap_greed=True) == (0, 3) and f("r i v  # comment\n er", "river", ignore_whitespace=True) == (0, 5)
    assert f("a.b", "axb a.b", literal=True) == (4, 7) and compile("(a)(?<n>b)", never_capture=True).group_count == 1 and f(r"[^x]+", "a\nb", never_newline=True) == (0, 1)
    assert f("^b$", "a;b;c", multi_line=True, line_terminator=";") == (2, 3) and f("^b$", "a\r\nb\r\n", multi_line=True, crlf=True) == (3, 4) and f(r"\w+", "é", unicode=False) is None
    assert f(r"\101", "A") == (0, 1) and f(r"\12", "\n") == (0, 1)
    with pytest.raises(PatternSyntaxError):
        compile(r"\101", octal=False)


def test_ranges():
    """A range limits matches; anchors and look-behind see the whole text; bad ranges are errors."""
    p = compile("[a-z]+")
    assert span(m.find(p, "river bank", 2)) == (2, 5) and span(m.find(p, "river bank", 6, 8)) == (6, 8) and m.find(compile("^bank"), "river bank", 6) is None
    assert span(m.find(compile("(?<=r )bank"), "river bank", 6)) == (6, 10) and m.full_match(p, "river bank", 6, 10) and not m.full_match(p, "river bank", 5, 10)
    for start, end in ((-1, None), (3, 2), (0, 99)):
        with pytest.raises(TypeError):
            m.find(p, "river", start, end)
    with pytest.raises(TypeError):
        m.find(p, b"river")


def test_groups():
    p = compile("(?<w>[a-z]+)(?:,(?<n>[0-9]+))?")
    found = m.find(p, "bank;")
    assert found.captures("bank;") == ["bank", "bank", None] and found.span(p, "n") is None and found.span(p, 1) == (0, 4)
    with pytest.raises(TypeError):
        found.span(p, "other")
    either = compile("(?J)(?<v>q)x|(?<v>r)y")
    assert m.find(either, "ry").span(either, "v") == (0, 1) and m.find(compile("q(*MARK:here)r|s(*:there)"), "s").mark == "there"
    assert m.find(compile("([a-z])+"), "xyz").spans[1] == (2, 3)  # the last round's


def test_verbs():
    """What each verb gives up, seen on a text where plain backtracking would find something."""
    f = lambda pattern, text: span(m.find(compile(pattern), text))
    assert f("x(*ACCEPT)y|z", "xq") == (0, 1) and f("x+(*COMMIT)y|x", "xxz") is None and f("x+y|x", "xxz") == (0, 1)
    assert f("x+(*PRUNE)y|x", "xxz") is None and f("x+(*PRUNE)y|q", "xxq") == (2, 3) and f("xx(*SKIP)y|x", "xxx") == (2, 3) and f("xx(*PRUNE)y|x", "xxx") == (2, 3)
    assert f("(?:x(*THEN)y|xz)", "xz") == (0, 2) and f("x(*MARK:a)x(*SKIP:a)y|x", "xxw") == (1, 2) and f("[a-z](*FAIL)|[0-9]", "q7") == (1, 2)


def test_balancing():
    p = compile(r"\A(?:(?<up>\{)|(?<-up>\})|[a-z])*(?(up)(*FAIL))\z")
    for text in map("".join, itertools.product("{}a", repeat=4)):
        depth, ok = 0, True
        for c in text:
            depth += (c == "{") - (c == "}")
            ok = ok and depth >= 0
        assert m.is_match(p, text) == (ok and depth == 0), text


def test_look_forms():
    """Verbal names are the signs' other names; a non-atomic look goes back into itself."""
    for verbal, sign in (("(*pla:ab)", "(?=ab)"), ("(*nla:ab)", "(?!ab)"), ("(*plb:ab)", "(?<=ab)"), ("(*nlb:ab)", "(?<!ab)")):
        for text in ("abab", "aab", "ba", "b"):
            assert spans(m.each(compile(verbal + "[ab]"), text)) == spans(m.each(compile(sign + "[ab]"), text)), (verbal, text)
    text = "q:ab ab"
    assert m.find(compile(r"q:(?=[a-z]*([a-z]))\w+ \1"), "q:ab ac") is None and span(m.find(compile(r"q:(?*([a-z]+))\w+ \1"), text)) == (0, 7)
    assert span(m.find(compile(r"(?*.*?([0-9]))q.*=\1\z"), "q 1 2 =2")) == (0, 8) and m.find(compile(r"(?=.*?([0-9]))q.*=\1\z"), "q 1 2 =2") is None


def test_callouts():
    seen = []
    p = compile("(?:[a-z](?C3))+", callout=lambda *x: seen.append(x))
    assert span(m.find(p, "ab")) == (0, 2) and seen == [(3, None, 1, "ab"), (3, None, 2, "ab")]
    assert span(m.find(compile('(?:[a-z](?C"vowel"))+', callout=lambda n, tag, at, text: "fail" if text[at - 1] in "aeiou" else None), "aboard")) == (1, 2)
    with pytest.raises(Exception):  # noqa: B017
        m.find(compile("(?C)a", callout=lambda *x: "perhaps"), "a")
    with pytest.raises(TypeError):
        compile("a", callout=3)


def test_limits():
    with pytest.raises(AdvancedLimitError) as e:
        m.find(compile(r"(?=([a-z]+))\1\1", step_limit=20), "riverbank" * 5)
    assert e.value.kind == "steps" and e.value.used > e.value.limit == 20
    with pytest.raises(AdvancedLimitError) as e:
        m.find(compile("(?:(?=q)(?:(?=q)q))", nest_limit=2), "q")
    assert e.value.kind == "nest-depth" and e.value.used > e.value.limit
    with pytest.raises(PatternSyntaxError):
        compile("(?:[a-z]{50}[0-9]{50}){400}", size_limit=10_000)
    with pytest.raises(PatternSyntaxError):
        compile("(" * 40 + "q" + ")" * 40, nest_limit=30)
    with pytest.raises(MatchTimeout) as t:
        m.find(compile(r"(?=(?:q|qq)+\z)(?=(?:q+)+r)q", step_limit=10**9), "q" * 3_000, timeout=0.002)
    assert t.value.seconds == 0.002
    with pytest.raises(TypeError):
        m.find(compile("q"), "q", timeout=0)


@pytest.mark.parametrize("pattern", ["(?:q|qq)+r", "(?:q+)+r", "(?:q?){25}q{25}r", "(?:q*s?)*r"])
def test_no_exponential_time(pattern):
    p = compile(pattern)
    assert p.python is None and p.java is None and m.find(p, "q" * 400) is None


@pytest.mark.parametrize("pattern", ["[a-z0-9._]+@[a-z]+", "([a-z]+)!", "(?:[a-z]*)7", "[a-z]+?;", r"\w+#"])
def test_long_runs_take_linear_time(pattern):
    import time

    p, took = compile(pattern), []
    for n in (200_000, 400_000):
        start = time.perf_counter()
        assert m.find(p, "q" * n) is None and list(m.each(p, "q" * n)) == []
        took.append(time.perf_counter() - start)
    assert took[1] < 4 * took[0] + 1 and took[1] < 5


@pytest.mark.parametrize("pattern", ["[ab]+c", "([ab]+)(c)", "a*b", "a*?c", "[ab]{1,}c?", "(?:a)+b"])
def test_runs_lose_no_match(pattern):
    """Searches that skip the inside of a run find what ``re`` finds, from every start."""
    p = compile(pattern)
    assert p.run_python is not None
    for text in map("".join, itertools.product("abc", repeat=5)):
        assert [s for s in spans(m.each(p, text)) if s[0] < s[1]] == [x.span() for x in re.finditer(pattern, text) if x.end() > x.start()], text
        for start in range(6):
            found = re.compile(pattern).search(text, start)
            assert span(m.find(p, text, start)) == (found and found.span())


def test_empty_matches():
    """An empty match right after another match is left out; found by a plain reading of that rule."""

    def plain(pattern, text):
        out, at, last = [], 0, -1
        while at <= len(text):
            found = re.compile(pattern).search(text, at)
            if not found:
                break
            if found.end() > found.start() or found.end() != last:
                out.append(found.span())
                last = found.end()
            at = found.end() + (found.start() == found.end())
        return out

    for pattern in ("x*", "x*?", "", "x|", "|x", "(?:xy)*", "y??x?"):
        for text in map("".join, itertools.product("xy", repeat=4)):
            want = plain(pattern, text)
            assert spans(m.each(compile(pattern), text)) == want, (pattern, text)
            assert spans(m.each(compile(f"(?:{pattern})(?=)"), text, timeout=60)) == want, (pattern, text)


def test_overlapping():
    for pattern in ("xx", "x[xy]", "xyx", "x*y"):
        for text in map("".join, itertools.product("xy", repeat=5)):
            want, at = [], 0
            while at <= len(text) and (found := re.compile(pattern).search(text, at)):
                want.append(found.span())
                at = found.start() + 1
            assert spans(m.each(compile(pattern), text, overlapping=True)) == want


def test_split():
    semi = compile(";")
    for text in ("", ";", "q", "q;", ";q", "q;;r", "q;r;"):
        fields = text.split(";")
        assert m.split(semi, text) == fields
        assert m.split(semi, text, mode="terminator") == (fields[:-1] if text.endswith(";") else fields)
        assert m.split(semi, text, mode="inclusive") == ([f + ";" for f in fields[:-1]] + ([fields[-1]] if fields[-1] or len(fields) == 1 else []))
        for n in (1, 2, 3):
            assert m.split(semi, text, n) == text.split(";", n - 1)
        assert m.split(semi, text, 0) == []
    assert m.split(compile("[0-9]+"), "q12r3s", start=3) == ["q12r", "s"]
    with pytest.raises(TypeError):
        m.split(semi, "q", -2)


def test_replace():
    dates = compile(r"(?<y>\d{4})-(?<m>\d\d)")
    r = lambda template, n=None: m.replace(dates, "2031-07 2032-11", template, n)
    assert r("$m/$y") == "07/2031 11/2032" and r("${m}_${y}", 1) == "07_2031 2032-11" and r("[$0]", 0) == "2031-07 2032-11" and r("$$1") == "$1 $1"
    assert r("$2$1") == "072031 112032" and r("$nobody|${}|$9") == "|| ||" and r("${y") == "${y ${y" and r("$") == "$ $" and r("$-") == "$- $-" and r(r"\1") == r"\1 \1" and r("$1x") == "2031x 2032x"[:0] + "2031x 2032x"
    assert r(lambda found, text: found.string(text)[::-1]) == "70-1302 11-2302"
    for wrong in (b"x", 3):
        with pytest.raises(TypeError):
            r(wrong)
    with pytest.raises(TypeError):
        r(lambda found, text: None)


def test_fuzzy_by_edit_distance():
    """Anchored at both ends, the least edits are the edit distance in which nothing is inserted after the last character."""

    def distance(pattern, text):
        rows = [list(range(len(text) + 1))]
        for i, x in enumerate(pattern, 1):
            row = [i]
            for j, y in enumerate(text, 1):
                row.append(min(rows[-1][j] + 1, rows[-1][j - 1] + (x != y), *([row[-1] + 1] if i < len(pattern) else [])))
            rows.append(row)
        return rows[-1][-1]

    p = compile("^bank$")
    for text in ["bank", "bnak", "ban", "banks", "xbank", "tank", "", "bk", "river", "bannk", "kbank"]:
        found, want = m.fuzzy(p, text, 2), distance("bank", text)
        assert (found and found.edits) == (want if want <= 2 else None), text
        assert m.fuzzy(p, text, 0) is None or text == "bank"
    assert span(m.fuzzy(compile("river"), "a rivver", 1)) == (2, 8) and m.fuzzy(compile_bytes("bank"), b"bonk", 1).edits == 1
    assert span(m.fuzzy(compile("bank"), "bonk tonk", 1, 5)) is None
    with pytest.raises(FuzzyUnsupported):
        m.fuzzy(compile("(?=q)q"), "q")
    with pytest.raises(FuzzyLimitError) as e:
        m.fuzzy(compile("riverbank"), "qqqqqqq", 3, state_limit=5)
    assert e.value.used > e.value.limit == 5


def test_bytes():
    p = compile_bytes("é[a-z]")
    assert span(m.find(p, "caféx".encode())) == (3, 6) and m.find(compile_bytes(r"(?-u:\xA9)"), "é".encode()).spans[0] == (1, 2)
    assert m.find(compile_bytes("."), b"\xff") is None and span(m.find(compile_bytes("(?-u:.)"), b"\xff")) == (0, 1) and span(m.find(compile_bytes(r"\C"), b"\xffq")) == (0, 1)
    assert m.replace(compile_bytes("(?<w>[a-z]+)"), b"12ab", b"<$w>") == b"12<ab>" and m.split(compile_bytes("(?-u:\\x00)"), b"q\x00r") == [b"q", b"r"]
    assert span(m.find(compile_bytes("(?i)BANK"), b"bank")) == (0, 4) and span(m.find(compile_bytes("^r$", multi_line=True, line_terminator=0), b"q\x00r\x00")) == (2, 3)
    for text in ("naïve", "日本 q", "\U0001f600x"):
        own = spans(m.each(compile_bytes(r"\w+"), text.encode()))
        assert own == [(len(text[: x.start()].encode()), len(text[: x.end()].encode())) for x in re.finditer(r"\w+", text)]


def test_escape():
    for text in [*SUBJECTS, r"\.^$|?*+()[]{}#&-~", "a b"]:
        assert m.full_match(compile(escape(text)), text) and m.find(compile(escape(text)), text + "q").end == len(text)
        assert m.full_match(compile(escape(text), ignore_whitespace=False), text + "q") is None
    with pytest.raises(TypeError):
        escape(b"q")


def test_age(spark):
    """Versions are disjoint, and what came up to 3.2 is what Unicode 3.2's own table has."""
    import unicodedata

    from gristmill.plans import charset, unidata

    seen = charset.union()
    for version in unidata.VERSIONS:
        held = unidata.property_set("Age", version)
        assert held and not charset.intersect(seen, held)
        seen = charset.union(seen, held)
        if version == "3.2":
            test, old = charset.Test(seen), unicodedata.ucd_3_2_0
            wrong = [cp for cp in range(0x30000) if not 0xD800 <= cp <= 0xDFFF and test(cp) != (old.category(chr(cp)) != "Cn") and cp & 0xFFFE != 0xFFFE and not 0xFDD0 <= cp <= 0xFDEF]
            assert not wrong
    for spelling in ("Age=V15_0", "age=15.0", r"AGE=v150", "Age=15"):
        assert m.find(compile(rf"\p{{{spelling}}}"), "a\U0001fae8").start == 1
    with pytest.raises(PatternSyntaxError):
        compile(r"\p{Age=99.9}")
