"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors become integer weights floor(scale * x).  A candidate block is turned into
postings (for each component the rows that hold a weight, and the weights); every
query then scatters its weighted postings into a dense score array of the block,
the block's k best are selected by partition, and blocks are merged by rank.

Queries and candidates meet in a grid of cells: candidates are dealt to blocks by a
hash of their id, queries to bands, and one equi-join cell holds one band and one
block, both of bounded size.  Nothing is broadcast and no pair of rows leaves a cell
other than a band's k best of the block.

Defined cases: a row without id, and a vector that is null, or holds a null or a
non-finite component, takes no part.  A repeated vec_id counts once (the smallest
vector in array order).  Missing trailing components count as 0.  An empty vector
scores 0 against everything.  Fewer than k candidates: all are returned.  Empty
table: no rows.  Equal scores rank by the smaller id.  Components so large that a score
could exceed 64 bits are an error.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import spread

#: Most components of a block of candidates and of a band of queries: they bound a cell's memory.
#: Larger cells mean fewer of them, and so fewer copies of the rows.
BLOCK_VALUES, BAND_VALUES = 1 << 22, 1 << 20
OUT = "query_id long, vec_id long, score long"


def weights(vector: Column, scale: float = 64.0) -> Column:
    """floor(scale * x) of every component, x as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def usable(vector: Column) -> Column:
    """True unless the vector is null or has a null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def dense(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of integers as a matrix; short lists are filled with 0."""
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], lists.type)
    offsets = lists.offsets.to_numpy()
    lengths = np.diff(offsets)
    out = np.zeros((len(lists), int(lengths.max(initial=0))), np.int64)
    values = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]] if len(lists) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(lists)), lengths)
    out[row, np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], lengths)] = values
    return out


def score_type(q: np.ndarray, c: np.ndarray) -> type:
    """The fastest number type in which every partial sum is exact."""
    bound = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(c.astype(float)).max(initial=0)) * max(1, min(q.shape[1], c.shape[1]))
    if bound >= 2**63:
        raise OverflowError("scores could exceed 64 bits: scale the vectors down")
    return np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties to the smaller id; ``ids`` ascend."""
    if len(scores) <= k:
        at = np.arange(len(scores))
    else:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > least)
        at = np.concatenate([above, np.flatnonzero(scores == least)[: k - len(above)]])
    return at[np.lexsort((ids[at], -scores[at]))]


def search_cell(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(c_ids, kind="stable")
    c_ids, c = c_ids[order], c[order]
    kind, n = score_type(q, c), len(c_ids)
    postings: list[tuple[np.ndarray | None, np.ndarray]] = []
    for column in c.T:
        rows = np.flatnonzero(column)
        full = 2 * len(rows) > n  # a posting list of most rows is kept as a whole column
        postings.append((None, np.ascontiguousarray(column, dtype=kind)) if full else (rows, column[rows].astype(kind)))
    scores, part = np.zeros(n, kind), np.zeros(n, kind)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for own, row in zip(q_ids, q, strict=True):
        scores[:] = 0
        for term in np.flatnonzero(row):
            if term < len(postings):
                rows, held = postings[term]
                if rows is None:
                    np.multiply(held, kind(row[term]), out=part)
                    np.add(scores, part, out=scores)
                else:
                    scores[rows] += held * kind(row[term])
        found = best(scores, c_ids, k + 1)
        found = found[c_ids[found] != own][:k]
        out.append((np.full(len(found), own), c_ids[found], scores[found].astype(np.int64)))
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20, block_rows: int | None = None, band_rows: int | None = None) -> DataFrame:
    """Each query's k best candidates by integer inner product, its own id excluded.

    ``queries`` and ``candidates`` have (vec_id long, weights array<long>), ids unique.
    Returns query_id, rank (from 1), vec_id, score.
    """
    spark = queries.sparkSession
    many = candidates.agg(F.count("*").alias("rows"), F.coalesce(F.max(F.size("weights")), F.lit(1)).alias("wide")).first()
    wide = max(1, many["wide"])
    blocks = spread(spark, many["rows"], block_rows or max(1, BLOCK_VALUES // wide), 2 * spark.sparkContext.defaultParallelism)
    bands = spread(spark, queries.count(), band_rows or max(1, BAND_VALUES // wide), 1)
    block_of, band_of = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)), F.pmod(F.xxhash64("vec_id"), F.lit(bands))
    cell = lambda band, block: (band * blocks + block).alias("cell")
    left = queries.select("vec_id", "weights", band_of.alias("band")).select("vec_id", "weights", "band", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")).select("vec_id", "weights", cell(F.col("band"), F.col("block")))
    right = candidates.select("vec_id", "weights", block_of.alias("block")).select("vec_id", "weights", "block", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band")).select("vec_id", "weights", cell(F.col("band"), F.col("block")))

    def search(q: pa.Table, c: pa.Table) -> pa.Table:
        ids = lambda t: t.column("vec_id").to_numpy()
        found = search_cell(ids(q), dense(q.column("weights")), ids(c), dense(c.column("weights")), k)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, found), strict=True)))

    part = left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(search, OUT)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id")))
    return part.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def prepared(embeddings: DataFrame, scale: float = 64.0) -> DataFrame:
    """(vec_id, weights) of the rows that take part, one for each id."""
    rows = embeddings.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    return rows.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(weights(F.col("embedding"), scale)).alias("weights"))
