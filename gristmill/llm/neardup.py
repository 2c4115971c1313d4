"""SimHash near-duplicate detection: fingerprints, a binary trie self-join, components.

A text's words (ASCII letters lower-cased, split at ASCII white space) form 4-word
shingles, repeats included; a bit of the fingerprint is set if it is set in over half
of the shingles' XXH64 hashes (seed 42).  Fingerprints within ``radius`` bits link;
a document's component is the smallest doc_id that its fingerprint's links reach.

Equal fingerprints are joined as one before the search, so copies, however many, are
one string; near copies meet in buckets of permuted block tables, where tries of the
strings are joined with themselves (``hamming``).

Defined cases: null and empty texts have no words and fingerprint zero, linked like
any other; texts of fewer than 4 words are one shingle.  Rows with a null doc_id
get a fingerprint, join no component and have component null.  A repeated doc_id is a
row each; its rows' components may differ if its texts do.  Empty table: no rows.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .components import components
from .hamming import star_links

BITS, RADIUS, SHINGLE, SEED = 64, 4, 4, 42
#: Shingles that vote at once.
VOTES = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE) -> bytes:
    """The 64-bit print of one text, big-endian."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    lasts = ends[shingle - 1 :].tolist() or [len(joined)]
    hash_of, total, ones = xxhash.xxh64_digest, len(lasts), np.zeros(64, np.int64)
    for lo in range(0, total, VOTES):
        hashes = b"".join([hash_of(joined[a:b], SEED) for a, b in zip(starts[lo : lo + VOTES], lasts[lo : lo + VOTES])])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > total).tobytes()


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id long, print binary) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(x.as_py()) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.binary())], ["doc_id", "print"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, print binary")


def near_duplicates(documents: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of each row."""
    spark = documents.sparkSession
    prints = written(spark, fingerprints(documents), "prints")
    reps = written(spark, prints.filter("doc_id IS NOT NULL").groupBy("print").agg(F.min("doc_id").alias("first")), "reps")
    # A document may hold several prints (repeated ids), so strings are numbered by rep only if that is unique.
    distinct = reps.select("print", F.col("first").alias("rep"), F.lit(1).cast("long").alias("docs"))
    found = components(star_links(distinct, BITS, radius))
    placed = written(spark, reps.join(found, reps["first"] == found["node"], "left").select("print", F.coalesce("component", "first").alias("component_id")), "placed")
    named = prints.join(placed, "print", "left")
    return named.select("doc_id", F.lower(F.hex("print")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_firsts(documents: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One document of each component: the one with the smallest id.

    Rows with a null id stay.  Rows that repeat an id and its text are one: the first by
    the JSON of its other columns; rows of one id with different texts stay or go together.
    """
    found = written(documents.sparkSession, near_duplicates(documents.filter("doc_id IS NOT NULL"), radius).select("doc_id", "component_id"), "components")
    firsts = found.filter("doc_id = component_id").groupBy(F.col("doc_id").alias("first_id")).agg(F.count("*").alias("rows"))
    firsts = written(documents.sparkSession, firsts, "firsts")
    # The ids grow with the documents: a merge join at every size, no broadcast where they happen to be few.
    kept = documents.join(firsts.hint("merge"), documents["doc_id"] == firsts["first_id"], "left_semi")
    if firsts.filter("rows > 1").limit(1).count():
        others = F.to_json(F.struct(*(F.col(f"`{c}`") for c in documents.columns if c not in ("doc_id", "text")), F.lit(0).alias("__none")))
        place = F.row_number().over(Window.partitionBy("doc_id", "text").orderBy(others))
        kept = kept.withColumn("__place", place).filter("__place = 1").drop("__place")
    return kept.unionByName(documents.filter("doc_id IS NULL"))
