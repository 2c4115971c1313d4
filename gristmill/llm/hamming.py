"""Pairs of bit strings within a Hamming radius, by permuted block tables.

The bits are cut into blocks; two strings within the radius agree on all but at most
``radius`` blocks.  A table is a choice of blocks whose bits are permuted to the front;
strings that agree on them share a bucket, and every close pair meets in some bucket.
More blocks, hence longer keys, are taken as the strings grow in number, so that a
bucket of unrelated strings stays small.

A bucket above ``CELL_ROWS`` strings (many near copies of one text) is dealt by a
salt: strings get one of R salts and each pair of salts is a cell, so that no task
holds more than a bounded part and every pair still meets in exactly one cell.

Cells are streamed to a kernel by partition; only a run of cells is in memory.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread

#: Most strings of a cell (twice that where two salts meet), strings handed to a kernel at once, mean strings of a bucket.
CELL_ROWS, RUN_ROWS, BUCKET_ROWS = 2_048, 16_384, 64


def blocks(bits: int, count: int) -> list[range]:
    edge = [round(i * bits / count) for i in range(count + 1)]
    return [range(a, b) for a, b in zip(edge, edge[1:])]


def tables(bits: int, radius: int, strings: int) -> list[list[int]]:
    """For each table the bit places (0: first) that form its key."""
    for count in range(radius + 1, radius + 6):
        held = blocks(bits, count)
        found = [[b for part in chosen for b in part] for chosen in combinations(held, count - radius)]
        if strings / 2 ** min(len(x) for x in found) <= BUCKET_ROWS:
            break
    return found


def as_bits(strings: pa.Array, width: int) -> np.ndarray:
    """Fixed-size binary values as rows of 0 and 1."""
    raw = np.frombuffer(b"".join(strings.to_pylist()), np.uint8).reshape(-1, width)
    return np.unpackbits(raw, axis=1)


def keyed(distinct: DataFrame, bits: int, found: list[list[int]]) -> DataFrame:
    """(table, key, print, rep, docs) of each string in each table; the print's bits are permuted, the key's first."""
    orders = [[*key, *(b for b in range(bits) if b not in set(key))] for key in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = as_bits(batch.column("print"), bits // 8)
            for n, (key, order) in enumerate(zip(found, orders, strict=True)):
                packed = np.packbits(given[:, order], axis=1)
                head = np.zeros((len(given), 64), np.uint8)
                head[:, 64 - min(63, len(key)) :] = given[:, key[:63]]
                value = np.packbits(head, axis=1).view(">i8").astype(np.int64)[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(given), n, np.int32)), pa.array(value), pa.array([x.tobytes() for x in packed], pa.binary()), batch.column("rep"), batch.column("docs")], ["table", "key", "print", "rep", "docs"])

    return distinct.select("print", "rep", "docs").mapInArrow(run, "table int, key long, print binary, rep long, docs long")


def cells(distinct: DataFrame, bits: int, radius: int, kernel: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """Run ``kernel`` over all cells.  ``distinct`` has (print binary, rep long, docs long), prints unique.

    kernel(table, cell_start, cross, prints, salt, reps, docs): rows sorted by cell and
    print; cell_start marks each cell's first row; in a ``cross`` cell only rows of
    different salts are to be paired.
    """
    spark = distinct.sparkSession
    strings = distinct.count()
    found = tables(bits, radius, max(1, strings))
    rows = keyed(distinct, bits, found)
    hot = rows.groupBy("table", "key").agg(F.count("*").alias("many")).filter(F.col("many") > CELL_ROWS).select("table", "key", F.ceil(F.col("many") / (CELL_ROWS / 2)).cast("int").alias("salts"))
    salted = rows.join(hot, ["table", "key"], "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    salted = salted.withColumn("salt", F.pmod(F.xxhash64("print", "rep"), F.col("salts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    dealt = salted.select("table", "key", F.least("salt", "other").alias("low"), F.greatest("salt", "other").alias("high"), "print", "salt", "rep", "docs")
    parts = spread(spark, strings * len(found), 200_000)
    sorted_rows = dealt.repartition(parts, "table", "key", "low", "high").sortWithinPartitions("table", "key", "low", "high", "print")
    names = ["table", "key", "low", "high", "salt", "rep", "docs"]

    def handle(held: dict[str, np.ndarray], prints: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
        return kernel(held["table"], start, held["low"] != held["high"], prints, held["salt"], held["rep"], held["docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, rows
            whole = pa.Table.from_batches(held).combine_chunks()
            columns = {n: whole.column(n).to_numpy() for n in names}
            change = np.flatnonzero(np.any([columns[n][1:] != columns[n][:-1] for n in ("table", "key", "low", "high")], axis=0)) + 1
            end = len(whole) if last else (int(change[-1]) if len(change) else 0)
            if end:
                prints = np.frombuffer(b"".join(whole.column("print").slice(0, end).to_pylist()), np.uint8).reshape(end, -1)
                yield handle({n: columns[n][:end] for n in names}, prints, np.concatenate([[0], change[change < end]]))
            held, rows = [b for b in whole.slice(end).to_batches()], len(whole) - end

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= RUN_ROWS:
                yield from flush(False)
        if rows:
            yield from flush(True)

    return sorted_rows.mapInArrow(run, schema)


def words_of(prints: np.ndarray) -> np.ndarray:
    """Prints as rows of big-endian 64-bit words."""
    return np.ascontiguousarray(prints).view(">u8").astype(np.uint64)


def close_pairs(prints: np.ndarray, start: np.ndarray, cross: np.ndarray, salt: np.ndarray, radius: int, most: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs (i < j) of each cell within the radius, in parts of bounded size."""
    words, n = words_of(prints), len(prints)
    end = np.repeat(np.append(start[1:], n), np.diff(np.append(start, n)))
    many = end - np.arange(n) - 1
    total = np.concatenate([[0], np.cumsum(many)])
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + most, side="right")) - 1)
        i = np.repeat(np.arange(lo, hi), many[lo:hi])
        j = i + 1 + np.arange(len(i)) - np.repeat(total[lo:hi] - total[lo], many[lo:hi])
        apart = np.zeros(len(i), np.uint8)
        for w in range(words.shape[1]):
            apart += np.bitwise_count(words[i, w] ^ words[j, w])
        keep = (apart <= radius) & (~cross[i] | (salt[i] != salt[j]))
        yield i[keep], j[keep]
        lo = hi


def first_table(prints: np.ndarray, i: np.ndarray, j: np.ndarray, table: np.ndarray, found: list[list[int]], bits: int) -> np.ndarray:
    """True for the pairs that meet in no earlier table."""
    keep = np.ones(len(i), bool)
    for n in np.unique(table[i]):
        of = np.flatnonzero(table[i] == n)
        own = [*found[n], *(b for b in range(bits) if b not in set(found[n]))]
        differ = np.unpackbits(prints[i[of]] ^ prints[j[of]], axis=1)
        place = np.argsort(own)  # where each bit went
        for earlier in found[:n]:
            keep[of] &= differ[:, place[earlier]].any(axis=1)
    return keep


def near_counts(distinct: DataFrame, bits: int, radius: int) -> DataFrame:
    """(rep, near): the documents whose prints are within the radius of a print, its own aside."""
    found = tables(bits, radius, max(1, distinct.count()))

    def kernel(table, start, cross, prints, salt, reps, docs):
        near = np.zeros(len(reps), np.int64)
        for i, j in close_pairs(prints, start, cross, salt, radius):
            new = first_table(prints, i, j, table, found, bits)
            np.add.at(near, i[new], docs[j[new]])
            np.add.at(near, j[new], docs[i[new]])
        some = np.flatnonzero(near)
        return pa.RecordBatch.from_arrays([pa.array(reps[some]), pa.array(near[some])], ["rep", "near"])

    return cells(distinct, bits, radius, kernel, "rep long, near long").groupBy("rep").agg(F.sum("near").alias("near"))


def least_label(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n rows the smallest row that the links i - j reach."""
    label = np.arange(n)
    while len(i):
        a, b = label[i], label[j]
        live = a != b
        if not live.any():
            break
        i, j, a, b = i[live], j[live], a[live], b[live]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]
    return label


def trie_links(start: np.ndarray, cross: np.ndarray, prints: np.ndarray, salt: np.ndarray, radius: int, most: int = 1 << 17) -> np.ndarray:
    """Each row's smallest row in its cell's link graph, by a self-join of binary tries.

    The sorted prints are a trie: a node is a range of rows that share leading bits.
    Pairs of nodes are walked down together, a bit at a time, with the number of bits
    in which they differ; a pair beyond the radius is dropped with all below it.
    """
    words, n = words_of(prints)[:, 0], len(prints)
    edges = np.append(start, n)
    label = np.arange(n)
    stack = [(63, edges[:-1].astype(np.int32), edges[1:].astype(np.int32), edges[:-1].astype(np.int32), edges[1:].astype(np.int32), np.zeros(len(start), np.uint8))]
    zeros: dict[int, np.ndarray] = {}
    found_i: list[np.ndarray] = []
    found_j: list[np.ndarray] = []
    held = 0
    while stack:
        bit, alo, ahi, blo, bhi, apart = stack.pop()
        if len(alo) > most:
            half = len(alo) // 2
            stack += [(bit, alo[:half], ahi[:half], blo[:half], bhi[:half], apart[:half]), (bit, alo[half:], ahi[half:], blo[half:], bhi[half:], apart[half:])]
            continue
        # Pairs of single rows need no further descent: the rest of their bits is compared at once.
        lone = (ahi - alo == 1) & (bhi - blo == 1)
        if lone.any():
            i, j = alo[lone], blo[lone]
            close = (i != j) & (np.bitwise_count(words[i] ^ words[j]) <= radius)
            i, j = i[close], j[close]
            fit = ~cross[i] | (salt[i] != salt[j])
            found_i.append(i[fit])
            found_j.append(j[fit])
            held += int(fit.sum())
            if held > most:
                label = least_label(n, np.concatenate([np.arange(n), *found_i]), np.concatenate([label, *found_j]))
                found_i, found_j, held = [], [], 0
            alo, ahi, blo, bhi, apart = (x[~lone] for x in (alo, ahi, blo, bhi, apart))
        if bit < 0 or not len(alo):
            continue
        if bit not in zeros:
            zeros[bit] = np.concatenate([[0], np.cumsum((words >> np.uint64(bit)) & np.uint64(1) == 0)]).astype(np.int32)
        z = zeros[bit]
        amid, bmid = alo + z[ahi] - z[alo], blo + z[bhi] - z[blo]
        same = alo == blo
        children = [(alo, amid, blo, bmid, apart), (amid, ahi, bmid, bhi, apart), (alo, amid, bmid, bhi, apart + 1), (amid[~same], ahi[~same], blo[~same], bmid[~same], apart[~same] + 1)]
        alo, ahi, blo, bhi, apart = (np.concatenate(x) for x in zip(*children, strict=True))
        keep = (ahi > alo) & (bhi > blo) & (apart <= radius) & ~((alo == blo) & (ahi - alo == 1))
        stack.append((bit - 1, alo[keep], ahi[keep], blo[keep], bhi[keep], apart[keep]))
    return least_label(n, np.concatenate([np.arange(n), *found_i]), np.concatenate([label, *found_j]))


def star_links(distinct: DataFrame, bits: int, radius: int) -> DataFrame:
    """(src, dst) links of reps that span the components of every cell: at most one for each row, dst the smaller."""

    def kernel(table, start, cross, prints, salt, reps, docs):
        label = trie_links(start, cross, prints, salt, radius)
        least = np.full(len(reps), np.iinfo(np.int64).max)
        np.minimum.at(least, label, reps)
        dst = least[label]
        some = np.flatnonzero(dst != reps)
        return pa.RecordBatch.from_arrays([pa.array(reps[some]), pa.array(dst[some])], ["src", "dst"])

    return cells(distinct, bits, radius, kernel, "src long, dst long").distinct()
