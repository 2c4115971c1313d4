"""The operators under SQL names: ``register(spark)`` adds functions and a table function.

The pattern is an argument, compiled once for each distinct value in a task.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import matching
from ..plans.pattern import Pattern, compile
from . import columns

_PROBE = compile("a")
_, MATCH, _, MATCH_ARROW = columns.kinds(_PROBE)


def _rows(fn: Callable, arrow: pa.DataType) -> Callable:
    def run(text: pa.Array, pattern: pa.Array) -> pa.Array:
        return pa.array([None if t is None or p is None else fn(compile(p), t) for t, p in zip(text.to_pylist(), pattern.to_pylist())], arrow)

    return run


def _replace(text: pa.Array, pattern: pa.Array, new: pa.Array) -> pa.Array:
    rows = zip(text.to_pylist(), pattern.to_pylist(), new.to_pylist())
    return pa.array([None if t is None or p is None or r is None else matching.replace(compile(p), t, r) for t, p, r in rows], pa.string())


def _full(p: Pattern, t: str) -> bool:
    return matching.full_match(p, t) is not None


def _scan(p: Pattern, t: str) -> dict | None:
    return columns.record(matching.find(p, t), t)


def _all(p: Pattern, t: str) -> list[dict]:
    return [columns.record(m, t) for m in matching.each(p, t)]


def _fuzzy(p: Pattern, t: str) -> dict | None:
    return columns.record(matching.fuzzy(p, t), t)


class AllMatches:
    """LATERAL rx_matches(text, pattern): a row for each match."""

    def eval(self, text: str, pattern: str):
        if text is not None and pattern is not None:
            for nth, found in enumerate(matching.each(compile(pattern), text)):
                yield nth, found.start, found.end, found.string(text)


def register(spark: SparkSession) -> None:
    """rx_is_match, rx_full_match, rx_scan, rx_all_matches, rx_split, rx_replace_all, rx_fuzzy and the table function rx_matches."""
    for name, fn, returns, arrow in (
        ("rx_is_match", matching.is_match, "boolean", pa.bool_()),
        ("rx_full_match", _full, "boolean", pa.bool_()),
        ("rx_scan", _scan, MATCH, MATCH_ARROW),
        ("rx_all_matches", _all, f"array<{MATCH}>", pa.list_(MATCH_ARROW)),
        ("rx_split", matching.split, "array<string>", pa.list_(pa.string())),
        ("rx_fuzzy", _fuzzy, MATCH, MATCH_ARROW),
    ):
        spark.udf.register(name, F.arrow_udf(_rows(fn, arrow), returns))
    spark.udf.register("rx_replace_all", F.arrow_udf(_replace, "string"))
    spark.udtf.register("rx_matches", F.udtf(AllMatches, returnType="nth int, start int, end int, text string"))
