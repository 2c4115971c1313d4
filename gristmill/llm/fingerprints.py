"""Document fingerprints: weighted SimHash, found again by permuted block tables.

A text's terms are its pairs of adjacent words, weighted by 1 + ln(count); each term's
128-bit hash votes on signed bits with its weight, and a bit is set where the votes
are positive.  Likeness is the share of equal bits.

``edited_pairs`` gives each document with the next one by id in one shuffle: ids are
cut into ranges, a range's rows are sorted and streamed, and each range also gets the
first row of the following one, so that no task sees more than its own ranges.

Defined cases: null and empty texts have no terms and fingerprint zero; a text of one
word has that word as its term.  Documents are in order of (doc_id, text), null ids
first, so ties and repeated rows have a next document too; after the last comes the
first; a lone document is next to itself.  Empty table: no rows.  Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .hamming import near_counts

BITS, RADIUS = 128, 7
#: Terms that vote at once; rows that a range of ids aims at, and the most ranges.
VOTES, RANGE_ROWS, MOST_RANGES = 1 << 14, 500, 20_000


def fingerprint(text: str | None) -> bytes:
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not words:
        return bytes(BITS // 8)
    terms = Counter(map(b" ".join, zip(words, words[1:]))) if len(words) > 1 else Counter(words)
    weight = 1 + np.log(np.fromiter(terms.values(), np.float32, len(terms)))
    names, hash_of, votes = list(terms), xxhash.xxh3_128_digest, np.zeros(BITS)
    for lo in range(0, len(names), VOTES):
        hashes = np.frombuffer(b"".join(map(hash_of, names[lo : lo + VOTES])), np.uint8)
        held = weight[lo : lo + VOTES]
        votes += 2 * (held @ np.unpackbits(hashes.reshape(-1, BITS // 8), axis=1).astype(np.float32)).astype(np.float64) - held.sum(dtype=np.float64)
    return np.packbits(votes > 1e-6).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    return 1 - (int.from_bytes(a) ^ int.from_bytes(b)).bit_count() / (8 * len(a))


def edited(text: str, other: str) -> str:
    """The last half replaced by the first as many code points of the other text, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def edited_pairs(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, print, edited_print, near_edited, near_next."""
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    many = rows.count()
    ranges = min(MOST_RANGES, max(64, many // RANGE_ROWS))
    # At most MOST_RANGES ids reach the driver.
    cut = rows.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 100_000).alias("at")).first()["at"] or []
    places = rows.withColumn("range", range_of(sorted(set(cut))))
    firsts = written(spark, places.groupBy("range").agg(F.min(F.struct("doc_id", "text")).alias("first")), "firsts")
    # One row for each range: a bounded window.
    turn = Window.partitionBy(F.lit(0)).orderBy("range")
    before = firsts.select("range", F.coalesce(F.lag("range").over(turn), F.max("range").over(Window.partitionBy(F.lit(0)))).alias("before"))
    moved = firsts.join(before, "range").select("first.doc_id", "first.text", F.col("before").alias("range"), F.lit(1).alias("after"))
    dealt = places.withColumn("after", F.lit(0)).unionByName(moved)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), many // 20_000)
    ordered = dealt.repartition(parts, "range").sortWithinPartitions("range", "after", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (doc_id, text, print)
        for batch in batches:
            out = []
            for doc, text, after in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("after").to_pylist()):
                text = text.as_py()
                own = fingerprint(text)
                if held is not None:
                    changed = edited(held[1], text)
                    fresh = held[2] if changed == held[1] else fingerprint(changed)
                    out.append((held[0], len(held[1]), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), held[2], fresh, likeness(held[2], fresh), likeness(held[2], own)))
                held = None if after else (doc, text, own)
            columns = list(zip(*out)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64())
            names = ("doc_id", "n_chars", "edited_sha256", "print", "edited_print", "near_edited", "near_next")
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], list(names))

    return ordered.select("doc_id", "text", "after").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, print binary, edited_print binary, near_edited double, near_next double")


def range_of(cut: list[int]) -> Column:
    """-1 for a null id, else the number of cuts below it, by binary search in a constant array."""
    held = F.from_json(F.lit(str(cut)), "array<bigint>")
    steps = [1 << i for i in reversed(range(len(cut).bit_length()))]
    found = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(F.get(held, at + step - 1) < F.col("doc_id"), at + step).otherwise(at)) if steps else F.lit(0)
    return F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(found)


def near_documents(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(print, n_near): how many other documents have a print within the radius; ``prints`` has one row for each document."""
    spark = prints.sparkSession
    # Numbered as they are written, so each print has a number of its own, the same at every later reading.
    numbered = written(spark, prints.groupBy("print").agg(F.count("*").alias("docs")).select("print", F.monotonically_increasing_id().alias("rep"), "docs"), "print-groups")
    near = near_counts(numbered, BITS, radius)
    return numbered.join(near, "rep", "left").select("print", (F.col("docs") - 1 + F.coalesce("near", F.lit(0))).alias("n_near"))
