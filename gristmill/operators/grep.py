"""Lines that match, and how many."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns


def grep(lines: DataFrame, pattern: str, *, ignore_case: bool = False, invert: bool = False, count: bool = False, line_number: bool = True, **options) -> DataFrame:
    """The lines of (label, line_no, line) that match, or with ``count`` (label, n) for every label, zeros too."""
    hit = columns.is_match(F.col("line"), pattern, case_insensitive=ignore_case, **options)
    hit = ~hit if invert else hit
    if count:
        return lines.groupBy("label").agg(F.coalesce(F.sum(hit.cast("long")), F.lit(0)).alias("n"))
    found = lines.filter(hit)
    return found if line_number else found.drop("line_no")


def formatted(found: DataFrame, *, labels: bool, count: bool = False, line_number: bool = False) -> DataFrame:
    """(out): the found lines, or counts, as a terminal shows them."""
    parts = [F.concat(F.col("label"), F.lit(":"))] if labels else []
    if count:
        return found.select("label", F.concat(*parts, F.col("n").cast("string")).alias("out"))
    parts += [F.concat(F.col("line_no").cast("string"), F.lit(":"))] if line_number else []
    return found.select("label", "line_no", F.concat(*parts, F.col("line")).alias("out"))
