"""Errors of compiling and running patterns."""

from __future__ import annotations


class PatternError(Exception):
    """Base of all errors about patterns."""


class PatternSyntaxError(PatternError):
    """The pattern text is malformed at ``position``."""

    def __init__(self, pattern: object, position: int, reason: str):
        super().__init__(pattern, position, reason)
        self.pattern, self.position, self.reason = pattern, position, reason

    def __str__(self) -> str:
        return f"{self.reason} at {self.position} in {self.pattern!r}"


class MatchTimeout(PatternError):
    """A call took longer than its ``seconds``."""

    def __init__(self, seconds: float):
        super().__init__(seconds)
        self.seconds = seconds


class FuzzyUnsupported(PatternError):
    """Approximate matching of a pattern that needs backtracking."""

    def __init__(self, pattern: str, reason: str):
        super().__init__(pattern, reason)
        self.pattern, self.reason = pattern, reason


class LimitError(PatternError):
    """A budget (``kind``) of ``limit`` units was exceeded by ``used``: not the same as no match."""

    def __init__(self, kind: str, limit: int, used: int):
        super().__init__(kind, limit, used)
        self.kind, self.limit, self.used = kind, limit, used


class FuzzyLimitError(LimitError):
    """The states of an approximate search."""


class AdvancedLimitError(LimitError):
    """The steps or the nesting of backtracking."""


class NotTranslatable(Exception):
    """A pattern has no provably equal form in another engine."""
