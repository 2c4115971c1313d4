"""Laws on generated patterns and texts."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from gristmill.operators import matching as m
from gristmill.operators import sets, vm
from gristmill.plans.errors import AdvancedLimitError, PatternSyntaxError
from gristmill.plans.pattern import compile, compile_bytes, escape

TEXTS = st.text("ab", max_size=24)


def regular(inner):
    return st.one_of(
        st.tuples(inner, inner).map("".join),
        st.tuples(inner, inner).map(lambda x: f"(?:{x[0]}|{x[1]})"),
        st.tuples(inner, st.sampled_from(["*", "+", "?", "*?", "+?", "??", "{1,2}"])).map(lambda x: f"(?:{x[0]}){x[1]}"),
        inner.map(lambda x: f"({x})"),
    )


PATTERNS = st.recursive(st.sampled_from(["a", "b", "[ab]", ".", "ab"]), regular, max_leaves=6)


@given(PATTERNS, TEXTS)
@settings(max_examples=150, deadline=None)
def test_engines_agree(source, text):
    p = compile(source)
    thread = vm.run(p.program, text, 0, len(text))
    try:
        back = m.advanced(p, text)
    except AdvancedLimitError:  # nested loops: told, not taken for no match
        return
    assert (thread and thread[:2]) == (back and back.spans[0])
    fast = m.find(p, text)
    assert (fast and fast.spans[0]) == (back and back.spans[0])
    assert back is None or p.required in text
    longest = m.longest(p, text)
    if longest:
        ends = [e for e in range(longest.start, len(text) + 1) if m.full_match(p, text, longest.start, e)]
        assert longest.end == max(ends) and m.shortest(p, text) == min(ends)


@given(PATTERNS, TEXTS)
@settings(max_examples=100, deadline=None)
def test_traversal(source, text):
    p = compile(source)
    found = list(m.each(p, text))
    assert [x.spans for x in found] == [x.spans for x in m.each(p, text, timeout=60)]
    last = 0
    for x in found:
        assert last <= x.start <= x.end <= len(text)
        last = x.end
    assert "".join(m.split(p, text, mode="inclusive")) == text
    assert m.replace(p, text, "$0") == text
    # Octets, character by character, give the same.
    data = text.encode()
    assert [x.spans[0] for x in m.each(compile_bytes(source), data)] == [x.spans[0] for x in found]


@given(PATTERNS, TEXTS, st.integers(1, 5))
@settings(max_examples=100, deadline=None)
def test_chunks(source, text, size):
    p = compile(source)
    if p.nullable:
        return
    scanner, found = m.scanner(p), []
    for i in range(0, len(text), size):
        found += scanner.feed(text[i : i + size])
    found += scanner.finish()
    assert [m.scanned(x).spans for x in found] == [x.spans for x in m.each(p, text)]


@given(st.lists(PATTERNS, min_size=1, max_size=4), TEXTS)
@settings(max_examples=60, deadline=None)
def test_sets(sources, text):
    held = sets.compile_set(sources)
    assert held.matches(text) == [i for i, s in enumerate(sources) if m.is_match(compile(s), text)]
    assert held.any(text) == bool(held.matches(text))


@given(st.text(max_size=20))
@settings(max_examples=100, deadline=None)
def test_escape(text):
    assert m.full_match(compile(escape(text)), text)


@given(st.text("ab()[]{}|*+?\\^$.-&~x12,:<>=!PRi", max_size=16))
@settings(max_examples=300, deadline=None)
def test_any_pattern_compiles_or_is_refused(source):
    try:
        compile(source)
    except PatternSyntaxError:
        pass


@given(PATTERNS, st.text("ab", max_size=6), st.integers(0, 2))
@settings(max_examples=60, deadline=None)
def test_fuzzy_has_an_exact_base(source, text, edits):
    p = compile(source)
    found, plain = m.fuzzy(p, text, edits), m.find(p, text)
    if plain:
        assert found and found.start <= plain.start
    if found:
        assert found.edits <= edits


def test_python_form_is_real():
    assert isinstance(compile("a+(b|c)").python, re.Pattern)
