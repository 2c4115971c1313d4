"""Token counts of flat token files by a scan for separators.

A flat token file is nothing but little-endian numbers of one width: token ids plus
SHIFT, documents ended by END, with PAD between records; it has no index.  The scan
cuts files into blocks at any place; a vectorised search finds a block's ends of
documents, and a prefix scan over the blocks of a stream (the files that one task
wrote, or one foreign file) stitches the documents that cross blocks and files.
Neither text nor tokens are shuffled.

``write_token_files`` writes a table's documents by Spark's text writer, so any store
will do.  The numbers are 16 bits wide if every id of the vocabulary fits, else 32.  A
record has at most RECORD bytes and a file FILE_RECORDS records, however long a text
is: a document's tokens go on in the next record, or file.  Where ``named``, the
NAME numbers before a document's end are its doc_id, so a document's count carries its
id in the data's own order; they are not counted.

The strings of special tokens count as ordinary text here (in packing they become the
special token's id, as the vocabulary's own library has it).

Defined cases: null and empty texts are documents of 0 tokens; tokens after the last
end are a document without end (``ended`` false); repeated rows are counted each; a
null doc_id stays null; a file with a part of a number is an error, and so are written
files with a document without end.  Empty table, empty file: no rows.  Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tokens import encoder, highest_id

#: Bytes of a block that is scanned, bytes of a record, records of a file.
BLOCK, RECORD, FILE_RECORDS = 1 << 20, 1 << 20, 16
#: Numbers that are no tokens, and what is added to the ids.
END, PAD, SHIFT = 0, 1, 2
#: Numbers of a name, and bits of a doc_id in each; the bit beyond the 64 stands for null.
NAME, NAME_BITS = 5, 13


@dataclass(frozen=True)
class Layout:
    """How the files are to be read: the numbers' type, whether PAD is no token, whether names stand before the ends."""

    number: str = "<u2"
    padded: bool = True
    named: bool = True

    @property
    def width(self) -> int:
        return np.dtype(self.number).itemsize


def layout_of(highest: int) -> Layout:
    """The narrowest layout that holds ids up to ``highest``."""
    return Layout("<u2" if highest + SHIFT <= 0xFFFF else "<u4")


def named_tail(doc_id: int | None, number: str) -> bytes:
    """A document's name and end."""
    value = 1 << 64 if doc_id is None else doc_id % (1 << 64)
    words = [(value >> (NAME_BITS * k) & ((1 << NAME_BITS) - 1)) + SHIFT for k in range(NAME)]
    return np.array([*words, END], number).tobytes()


def names_of(words: np.ndarray) -> pa.Array:
    """The doc_ids of rows of NAME numbers."""
    held = words.astype(np.uint64) - np.uint64(SHIFT)
    value = np.zeros(len(held), np.uint64)
    for k in range(NAME):
        value |= held[:, k] << np.uint64(NAME_BITS * k)
    return pa.array(value.view(np.int64), mask=held[:, NAME - 1] >> np.uint64(64 - NAME_BITS * (NAME - 1)) > 0)


def records(pieces: Iterator[tuple[bytes, bytes]], size: int) -> Iterator[bytes]:
    """The stream of (tokens, tail) in records of at most ``size`` bytes; a tail is never cut."""
    held, room = [], size
    for body, tail in pieces:
        at = 0
        while len(body) - at > room:
            held.append(body[at : at + room])
            yield b"".join(held)
            at, held, room = at + room, [], size
        held.append(body[at:])
        room -= len(body) - at
        if room < len(tail):
            yield b"".join(held)
            held, room = [], size
        held.append(tail)
        room -= len(tail)
    if held:
        yield b"".join(held)


def write_token_files(documents: DataFrame, vocabulary: str, path: str, layout: Layout | None = None) -> Layout:
    """The documents' tokens as flat files with names; how to read them."""
    layout = layout or layout_of(highest_id(vocabulary))
    number, size = layout.number, RECORD // layout.width * layout.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, special=False)

        def pieces() -> Iterator[tuple[bytes, bytes]]:
            for batch in batches:
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                    yield (encode(text.as_py() or "") + SHIFT).astype(number).tobytes(), named_tail(doc_id, number)

        for record in records(pieces(), size):
            # The bytes go through as they are; the text writer puts a PAD after each row.
            yield pa.RecordBatch.from_arrays([pa.StringArray.from_buffers(1, pa.py_buffer(np.array([0, len(record)], np.int32).tobytes()), pa.py_buffer(record))], ["value"])

    pad = np.array([PAD], number).tobytes().decode("ascii")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "value string")
    rows.write.option("lineSep", pad).option("compression", "none").option("maxRecordsPerFile", FILE_RECORDS).text(path)
    return layout


def token_files(spark: SparkSession, path: str) -> DataFrame:
    """(stream, seq, data) of what ``write_token_files`` wrote to a folder: the files of each task, in order."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).filter("length > 0")
    # part-00012-...-c003: the fourth file of task 12.
    number = lambda pattern: F.regexp_extract("path", pattern, 1).cast("int")
    return files.select(number(r"part-(\d+)-[^/]*$").cast("string").alias("stream"), number(r"-c(\d+)[^-/]*$").alias("seq"), F.col("content").alias("data"))


def foreign_files(spark: SparkSession, path: str) -> DataFrame:
    """(stream, seq, data) of any flat files, each a stream of its own; up to Spark's limit of 2 GB each."""
    return spark.read.format("binaryFile").load(path).filter("length > 0").select(F.col("path").alias("stream"), F.lit(0).alias("seq"), F.col("content").alias("data"))


def ends_of(files: DataFrame, layout: Layout, block: int = BLOCK) -> DataFrame:
    """(stream, seq, block, n_tokens, ends): places of the separators among the numbers of each block, and the names before them."""
    step = max(1, block // layout.width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stream, seq, data in zip(batch.column("stream"), batch.column("seq"), batch.column("data")):
                raw = data.as_buffer()
                if raw.size % layout.width:
                    raise ValueError("a token file ends within a number")
                numbers = np.frombuffer(raw, layout.number)
                for nth, lo in enumerate(range(0, len(numbers), step)):
                    part = numbers[lo : lo + step]
                    ends = np.flatnonzero(part == END)
                    pads = np.flatnonzero(part == PAD) if layout.padded else ends[:0]
                    at = pa.array(ends - np.searchsorted(pads, ends), pa.int64())
                    # Writers never cut a name, so it may reach into the block before, not out of the file.
                    names = names_of(numbers[(ends + lo)[:, None] + np.arange(-NAME, 0)]) if layout.named else pa.nulls(len(ends), pa.int64())
                    found = pa.ListArray.from_arrays(pa.array([0, len(ends)], pa.int32()), pa.StructArray.from_arrays([at, names], ["at", "doc_id"]))
                    yield pa.RecordBatch.from_arrays([pa.array([stream.as_py()]), pa.array([seq.as_py()], pa.int32()), pa.array([nth], pa.int32()), pa.array([len(part) - len(pads)], pa.int64()), found], ["stream", "seq", "block", "n_tokens", "ends"])

    return files.mapInArrow(run, "stream string, seq int, block int, n_tokens long, ends array<struct<at:long,doc_id:long>>")


def count_tokens(files: DataFrame, layout: Layout, block: int = BLOCK) -> DataFrame:
    """(stream, nth, doc_id, start, n_tokens, ended): each document of each stream, by place; neither end nor name is a token."""
    found = ends_of(files, layout, block)
    within = Window.partitionBy("stream").orderBy("seq", "block")
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    many, extra = F.size("ends"), NAME if layout.named else 0
    scanned = found.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).withColumn("nth", F.coalesce(F.sum(many).over(before), F.lit(0)))
    scanned = scanned.withColumn("last", F.when(many > 0, F.col("base") + F.element_at("ends", -1)["at"]))
    scanned = scanned.withColumn("open", F.coalesce(F.last("last", ignorenulls=True).over(before) + 1, F.lit(0)))
    # Whatever follows a stream's last end.
    final = F.lead("block").over(within).isNull()
    scanned = scanned.withColumn("rest", F.when(final, F.col("base") + F.col("n_tokens") - F.coalesce(F.col("last") + 1, F.col("open"))))
    start = lambda i: F.when(i == 0, F.col("open")).otherwise(F.col("base") + F.get("ends", i - 1)["at"] + 1)
    docs = F.transform("ends", lambda e, i: F.struct((F.col("nth") + i).alias("nth"), e["doc_id"].alias("doc_id"), start(i).alias("start"), (F.col("base") + e["at"] - start(i) - extra).alias("n_tokens"), F.lit(True).alias("ended")))
    tail = F.struct((F.col("nth") + many).alias("nth"), F.lit(None).cast("long").alias("doc_id"), F.coalesce(F.col("last") + 1, F.col("open")).alias("start"), F.col("rest").alias("n_tokens"), F.lit(False).alias("ended"))
    none = F.array().cast("array<struct<nth:bigint,doc_id:bigint,start:bigint,n_tokens:bigint,ended:boolean>>")
    return scanned.select("stream", F.inline(F.concat(docs, F.when(F.col("rest") > 0, F.array(tail)).otherwise(none))))


def named_counts(documents: DataFrame, vocabulary: str, path: str) -> DataFrame:
    """part, nth, doc_id, start, n_tokens of each document, from flat files written to ``path``."""
    layout = write_token_files(documents, vocabulary, path)
    counts = count_tokens(token_files(documents.sparkSession, path), layout)
    cut_off = F.raise_error(F.lit("a token file ends within a document"))
    return counts.select(F.col("stream").cast("int").alias("part"), "nth", "doc_id", "start", F.when(F.col("ended"), F.col("n_tokens")).otherwise(cut_off.cast("long")).alias("n_tokens"))
