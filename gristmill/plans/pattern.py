"""Compiled patterns: immutable driver-side values that travel to tasks by pickling."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

from . import analysis, emit
from .errors import NotTranslatable, PatternSyntaxError
from .nodes import Cat, Chars, Node, walk
from .parser import Flags, Parser
from .program import Compiler, Program

SPECIAL = r"\.^$|?*+()[]{}#&-~"
SIZE_LIMIT, NEST_LIMIT = 100_000, 250


def escape(text: str) -> str:
    """A pattern that matches exactly this text."""
    if not isinstance(text, str):
        raise TypeError("escape needs a string")
    return "".join("\\" + c if c in SPECIAL else c for c in text)


@dataclass(frozen=True)
class Options:
    """Compile options, by keyword."""

    case_insensitive: bool = False
    multi_line: bool = False
    dot_matches_new_line: bool = False
    swap_greed: bool = False
    ignore_whitespace: bool = False
    crlf: bool = False
    unicode: bool = True
    literal: bool = False
    never_capture: bool = False
    never_newline: bool = False
    octal: bool = True
    line_terminator: str | int = "\n"
    size_limit: int = SIZE_LIMIT
    nest_limit: int = NEST_LIMIT
    step_limit: int | None = None
    end_is_text_end: bool = False
    callout: Callable | None = field(default=None, compare=False)

    def __post_init__(self):
        for name in ("case_insensitive", "multi_line", "dot_matches_new_line", "swap_greed", "ignore_whitespace", "crlf", "unicode", "literal", "never_capture", "never_newline", "octal", "end_is_text_end"):
            if not isinstance(getattr(self, name), bool):
                raise TypeError(f"{name} must be true or false")
        for name in ("size_limit", "nest_limit"):
            held = getattr(self, name)
            if not isinstance(held, int) or isinstance(held, bool) or held < (name == "size_limit"):
                raise TypeError(f"{name} must be a positive integer")
        if self.callout is not None and not callable(self.callout):
            raise TypeError("callout must be callable")


@dataclass(frozen=True)
class Pattern:
    """A compiled pattern.  ``byte_mode``: it reads binary values, offsets are octets."""

    source: str
    options: Options
    byte_mode: bool
    node: Node
    group_count: int
    names: tuple[str | None, ...]

    @property
    def capture_count(self) -> int:
        return self.group_count + 1

    @property
    def capture_names(self) -> tuple[str | None, ...]:
        """By index; 0 is the whole match."""
        return (None, *self.names)

    def group_index(self, name: str) -> int | None:
        return next((i for i, n in enumerate(self.names, 1) if n == name), None)

    def group_indexes(self, key: int | str) -> list[int]:
        """The indexes that a name or number stands for; an unknown one is an error."""
        found = [i for i, n in enumerate(self.names, 1) if n == key] if isinstance(key, str) else [key] if isinstance(key, int) and 0 <= key <= self.group_count else []
        if not found:
            raise TypeError(f"no group {key!r}")
        return found

    @cached_property
    def static_capture_count(self) -> int | None:
        held = analysis.static_captures(self.node)
        return None if held is None else held + 1

    @cached_property
    def advanced(self) -> bool:
        return analysis.is_advanced(self.node)

    @cached_property
    def nullable(self) -> bool:
        return analysis.nullable(self.node)

    @cached_property
    def program(self) -> Program:
        # The size limit is the instructions of a regular pattern, the steps of an advanced one.
        limit = None if self.advanced else self.options.size_limit
        return Compiler(self.source, self.group_count, list(self.names), self.byte_mode, limit).program(self.node)

    @cached_property
    def backtracked(self) -> Program:
        """The program for the backtracking engine, whatever the pattern."""
        if self.advanced or not analysis.empty_loops(self.node):
            return self.program
        return Compiler(self.source, self.group_count, list(self.names), self.byte_mode, None).program(self.node, True)

    @cached_property
    def budgeted(self) -> bool:
        """Asks for a budget that only the exact engine counts."""
        o = self.options
        return self.advanced and (o.step_limit is not None or o.size_limit < 1_000 or o.nest_limit < analysis.depth(self.node))

    @cached_property
    def java(self) -> str | None:
        """The pattern in the dialect of Spark's expressions, if it is provably equal."""
        if self.byte_mode or self.options.callout or self.budgeted:
            return None
        try:
            return emit.to_java(self.node)
        except NotTranslatable:
            return None

    @cached_property
    def python(self) -> re.Pattern | None:
        """The standard library's form of the pattern, if it is provably equal and its time is bounded."""
        if self.options.callout or self.budgeted or analysis.explosive(self.node):
            return None
        try:
            return re.compile(emit.to_python(self.node, self.byte_mode))
        except (NotTranslatable, re.error, OverflowError, RecursionError):
            return None

    @cached_property
    def run_java(self) -> str | None:
        """``java`` told not to start inside the run that the pattern starts with: for whether there is a match, in linear time."""
        run = analysis.leading_run(self.node)
        if self.java is None or run is None or run.raw:
            return self.java
        return f"(?<!{emit.to_java(run)})(?:{self.java})"

    @cached_property
    def run_python(self) -> re.Pattern | None:
        """``python`` told not to start inside the run that the pattern starts with; None if that is no matter."""
        run = analysis.leading_run(self.node)
        if self.python is None or run is None:
            return None
        try:
            return re.compile(f"(?<!{emit.to_python(run, self.byte_mode)})(?:{self.python.pattern})" if not self.byte_mode else b"(?<!" + emit.to_python(run, True) + b")(?:" + self.python.pattern + b")")
        except (NotTranslatable, re.error, TypeError):
            return None

    @cached_property
    def required(self) -> str:
        return "" if self.byte_mode else analysis.required_literal(self.node)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("python", "run_python")}

    def __setstate__(self, state):
        self.__dict__.update(state)


def _build(source: str, options: Options, byte_mode: bool) -> Pattern:
    if not isinstance(source, str):
        raise PatternSyntaxError(source, 0, "a pattern must be a string")
    end = options.line_terminator
    terminator = ord(end) if isinstance(end, str) and len(end) == 1 else end
    if not isinstance(terminator, int) or not 0 <= terminator <= (255 if byte_mode else 127):
        raise TypeError("line_terminator must be an ASCII character, or an octet for byte patterns")
    flags = Flags(options.case_insensitive, options.multi_line, options.dot_matches_new_line, options.swap_greed, options.ignore_whitespace, options.unicode, options.crlf, options.never_capture)
    parser = Parser("" if options.literal else source, flags, byte_mode=byte_mode, never_newline=options.never_newline, octal=options.octal, terminator=terminator, nest_limit=max(1, options.nest_limit) if options.nest_limit < NEST_LIMIT else options.nest_limit)
    if options.nest_limit < 8:  # a limit for running, not for reading
        parser.nest_limit = NEST_LIMIT
    if options.literal:
        node: Node = Cat(tuple(parser.literal(ord(c)) for c in source))
        return Pattern(source, options, byte_mode, node, 0, ())
    parsed = parser.parse()
    pattern = Pattern(source, options, byte_mode, parsed.node, parsed.groups, tuple(parsed.names))
    pattern.program  # size errors belong to compiling
    return pattern


@lru_cache(maxsize=512)
def _cached(source: str, options: Options, byte_mode: bool) -> Pattern:
    return _build(source, options, byte_mode)


def compile(source: str, **options) -> Pattern:  # noqa: A001
    """A pattern over strings."""
    found = Options(**options)
    return _build(source, found, False) if found.callout or not isinstance(source, str) else _cached(source, found, False)


def compile_bytes(source: str, **options) -> Pattern:
    """A pattern over binary values."""
    found = Options(**options)
    return _build(source, found, True) if found.callout or not isinstance(source, str) else _cached(source, found, True)


def as_pattern(what: str | Pattern, **options) -> Pattern:
    return what if isinstance(what, Pattern) else compile(what, **options)


def streamable(pattern: Pattern) -> bool:
    """Checks that a pattern can be matched without keeping its input; True if octets are read as characters."""
    if any(op[0] not in ("chars", "split", "jump", "save", "match") for op in pattern.program.code):
        raise PatternSyntaxError(pattern.source, 0, "incremental matching needs a regular pattern without assertions")
    if pattern.nullable:
        raise PatternSyntaxError(pattern.source, 0, "incremental matching needs a pattern that consumes")
    kinds = {n.raw for n in walk(pattern.node) if isinstance(n, Chars)}
    if pattern.byte_mode and len(kinds) > 1:
        raise PatternSyntaxError(pattern.source, 0, "raw and Unicode sets cannot be mixed in incremental matching")
    return pattern.byte_mode and kinds == {False}
