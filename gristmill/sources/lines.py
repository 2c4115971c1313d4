"""Texts by line, and texts in chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(texts: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """(label, line_no from 1, line) of each text; a line feed at the end starts no line."""
    held = F.split(F.col(text), "\n", -1)
    size = F.size(held) - F.when(F.element_at(held, -1) == "", 1).otherwise(0)
    lines = F.when(size > 0, F.slice(held, 1, size)).otherwise(F.array().cast("array<string>"))
    cut = texts.filter(F.col(text).isNotNull()).select(F.col(label).alias("label"), F.posexplode(lines).alias("place", "line"))
    return cut.select("label", (F.col("place") + 1).cast("long").alias("line_no"), "line")


def file_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(label, line_no from 1, line) of text files, however large: files are read in splits.

    A line's number is its place in its split plus the lines of the splits before it in
    the file, of which a row for each split is gathered.
    """
    held = spark.read.option("lineSep", "\n").text(paths).select(F.col("_metadata.file_path").alias("label"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, count = None, 0
        for batch in batches:
            places = []
            for split in zip(batch.column("label").to_pylist(), batch.column("block").to_pylist()):
                count = count + 1 if split == now else 1
                now = split
                places.append(count)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], ["label", "block", "line", "place"])

    rows = held.mapInArrow(numbered, "label string, block long, line string, place long")
    sizes = held.groupBy("label", "block").agg(F.count("*").alias("lines"))
    before = F.coalesce(F.sum("lines").over(Window.partitionBy("label").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(sizes.select("label", "block", before.alias("before")), ["label", "block"]).select("label", (F.col("before") + F.col("place")).alias("line_no"), "line")


def whole_texts(spark: SparkSession, paths: list[str], binary: bool = False) -> DataFrame:
    """(label, text) of files; binary: (label, text) with octets."""
    if binary:
        return spark.read.format("binaryFile").load(paths).select(F.col("path").alias("label"), F.col("content").alias("text"))
    return spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("label"), F.col("value").alias("text"))


def chunks(texts: DataFrame, size: int = 4096, key: str = "stream_id", text: str = "text") -> DataFrame:
    """(key, seq, chunk, is_last): each text in pieces of so many characters; an empty text is one piece."""
    if size < 1:
        raise ValueError("a chunk has one character at least")
    pieces = F.regexp_extract_all(F.col(text), F.lit(f"(?s:.{{1,{size}}})"), F.lit(0))  # one pass over the text
    held = texts.filter(F.col(text).isNotNull()).select(key, F.when(F.col(text) == "", F.array(F.lit(""))).otherwise(pieces).alias("pieces"))
    cut = held.select(key, F.size("pieces").alias("many"), F.posexplode("pieces").alias("seq", "chunk"))
    return cut.select(key, F.col("seq").cast("long").alias("seq"), "chunk", (F.col("seq") == F.col("many") - 1).alias("is_last"))


def limited(texts: DataFrame, end: int, text: str = "text") -> DataFrame:
    """The first ``end`` characters of each text; a shorter text is an error."""
    short = F.raise_error(F.lit("a text ends before the range does"))
    return texts.withColumn(text, F.when(F.length(text) >= end, F.substr(F.col(text), F.lit(1), F.lit(end))).when(F.col(text).isNotNull(), short.cast("string")))
