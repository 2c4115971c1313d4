"""python -m gristmill.grep [-i] [-v] [-c] [-n] PATTERN [FILE...]: exit 0 matched, 1 none, 2 error."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .operators import grep as op
from .plans.errors import PatternError
from .plans.pattern import compile as compile_pattern
from .sources.lines import file_lines, numbered_lines


def main(args: list[str] | None = None, spark: SparkSession | None = None, out=sys.stdout) -> int:
    parser = argparse.ArgumentParser(prog="grep", description=__doc__)
    for flag, name in (("-i", "ignore_case"), ("-v", "invert"), ("-c", "count"), ("-n", "line_number")):
        parser.add_argument(flag, dest=name, action="store_true")
    parser.add_argument("pattern")
    parser.add_argument("files", nargs="*")
    try:
        given = parser.parse_args(args)
    except SystemExit as stop:
        return 2 if stop.code else 0
    try:
        compile_pattern(given.pattern, case_insensitive=given.ignore_case)
    except PatternError as bad:
        print(bad, file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.appName("grep").getOrCreate()
    try:
        if given.files:
            lines = file_lines(spark, given.files)
        else:
            lines = numbered_lines(spark.createDataFrame([("-", sys.stdin.read())], "label string, text string"))
        found = op.grep(lines, given.pattern, ignore_case=given.ignore_case, invert=given.invert, count=given.count)
        shown = op.formatted(found, labels=len(given.files) > 1, count=given.count, line_number=given.line_number)
        shown = shown.orderBy("label") if given.count else shown.orderBy("label", "line_no")
        matched = 0
        for row in shown.toLocalIterator():
            print(row["out"], file=out)
            matched += int(row["out"].rpartition(":")[2]) if given.count else 1
        if given.count and given.files and not matched:
            return 1
    except Exception as bad:  # noqa: BLE001  whatever reading or matching raises is exit 2
        print(bad, file=sys.stderr)
        return 2
    return 0 if matched else 1


if __name__ == "__main__":
    sys.exit(main())
