"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are embedded and convolved with learned filters over overlapping
chunks that cover the whole text; each filter is max-pooled over a chunk, the chunks'
pooled features are averaged, and a logistic unit turns them into one probability.

Training is on the driver, on a sample of labelled rows that is bounded in rows and in
bytes: of each label, rows in the order of a hash of doc_id, at most ``per_class`` of
them, taken while their texts together stay within ``class_bytes``.  Every epoch learns
from every byte of every sampled text.  Scoring reads every byte of every text on the
executors.  Both work in blocks of bounded size.

Defined cases: null and empty texts are scored as a run of zero bytes; a row whose
doc_id is null is scored and never learned from; a label is used once for each doc_id
(the smallest); null labels are not used.  No usable label: every score is 0.5; one
class only: the scores are that class's share.  A text longer than ``class_bytes`` is
never in the sample, and scored like any other.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Bytes of a chunk, bytes a filter sees, size of a byte's embedding, filters.
CHUNK, WIDTH, DEPTH, FILTERS = 512, 8, 6, 20
STEP = CHUNK - WIDTH + 1
#: Bounds of the training sample, for each label: rows, and bytes of their texts.
PER_CLASS, CLASS_BYTES = 1_500, 64 << 20
#: Filter places that are computed at once.
BLOCK = 1 << 14


@dataclass
class Net:
    embed: np.ndarray  # 256 x DEPTH
    kernel: np.ndarray  # WIDTH * DEPTH x FILTERS
    bias: np.ndarray
    head: np.ndarray
    offset: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [self.embed, self.kernel, self.bias, self.head, self.offset]


def windows(net: Net, data: np.ndarray) -> np.ndarray:
    """The embedded bytes under the filter at every place: places x WIDTH * DEPTH."""
    flat = net.embed[data].reshape(*data.shape[:-1], -1)
    return np.lib.stride_tricks.sliding_window_view(flat, WIDTH * DEPTH, axis=-1)[..., ::DEPTH, :]


def features(net: Net, data: np.ndarray) -> np.ndarray:
    """Max-pooled filters, averaged over the chunks of one text."""
    if len(data) < WIDTH:
        data = np.concatenate([data, np.zeros(WIDTH - len(data), np.uint8)])
    places, step = len(data) - WIDTH + 1, STEP
    total, block = np.zeros(FILTERS), BLOCK // step * step
    for lo in range(0, places, block):
        hi = min(places, lo + block)
        seen = np.ascontiguousarray(windows(net, data[lo : hi + WIDTH - 1])) @ net.kernel
        pooled = np.maximum.reduceat(seen, np.arange(0, hi - lo, step), axis=0)
        total += np.maximum(pooled + net.bias, 0).sum(axis=0, dtype=np.float64)
    return total / -(-places // step)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start in data, filter places, first chunk of each text and the end) of the chunks that cover all texts, WIDTH bytes long at least."""
    places = np.diff(offsets) - WIDTH + 1
    first = np.concatenate([[0], np.cumsum(-(-places // STEP))])
    nth = np.arange(first[-1]) - np.repeat(first[:-1], np.diff(first))
    return np.repeat(offsets[:-1], np.diff(first)) + nth * STEP, np.minimum(STEP, np.repeat(places, np.diff(first)) - nth * STEP), first


def pooled_chunks(net: Net, data: np.ndarray, start: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each chunk's largest response of each filter, and the place in ``data`` that has it; a block of chunks at a time."""
    best, where = np.empty((len(start), FILTERS), np.float32), np.empty((len(start), FILTERS), np.int64)
    for lo in range(0, len(start), BLOCK // STEP):
        s, n = start[lo : lo + BLOCK // STEP], places[lo : lo + BLOCK // STEP]
        seen = windows(net, data[s[:, None] + np.minimum(np.arange(CHUNK), n[:, None] + WIDTH - 2)])
        out = (net.kernel.T @ np.ascontiguousarray(seen).reshape(-1, WIDTH * DEPTH).T).reshape(FILTERS, len(s), STEP)
        for i in np.flatnonzero(n < STEP):  # only what the text has
            out[:, i, n[i] :] = -np.inf
        at = out.argmax(axis=2)
        best[lo : lo + len(s)] = np.take_along_axis(out, at[:, :, None], axis=2)[:, :, 0].T
        where[lo : lo + len(s)] = s[:, None] + at.T
    return best + net.bias, where


def gradients(net: Net, data: np.ndarray, where: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of embedding and kernel, from the chosen places and the slopes there; a block of chunks at a time."""
    grad_embed, grad_kernel = np.zeros_like(net.embed), np.zeros_like(net.kernel)
    for lo in range(0, len(where), BLOCK // STEP * 8):
        touched = data[where[lo : lo + BLOCK // STEP * 8, :, None] + np.arange(WIDTH)]  # n x FILTERS x WIDTH
        slope = back[lo : lo + BLOCK // STEP * 8]
        under = net.embed[touched].reshape(*touched.shape[:2], WIDTH * DEPTH)
        grad_kernel += np.stack([slope[:, f] @ under[:, f] for f in range(FILTERS)], axis=1)
        down = (slope[:, :, None] * net.kernel.T[None]).reshape(-1, DEPTH)
        byte = touched.reshape(-1)
        grad_embed += np.stack([np.bincount(byte, down[:, d], 256) for d in range(DEPTH)], axis=1).astype(np.float32)
    return grad_embed, grad_kernel


def fit(data: np.ndarray, offsets: np.ndarray, label: np.ndarray, weight: np.ndarray, epochs: int = 6, batch: int = 16, rate: float = 0.01, seed: int = 7) -> Net:
    """Adam on weighted log loss over texts data[offsets[i] : offsets[i + 1]], each of WIDTH bytes at least; an epoch reads all of them whole."""
    rng = np.random.default_rng(seed)
    normal = lambda *shape: rng.normal(size=shape).astype(np.float32)
    net = Net(normal(256, DEPTH) * 0.5, normal(WIDTH * DEPTH, FILTERS) / np.sqrt(WIDTH * DEPTH), np.zeros(FILTERS, np.float32), normal(FILTERS) * 0.1, np.zeros(1, np.float32))
    prior = float((weight * label).sum() / weight.sum())
    net.offset[0] = np.log(prior / (1 - prior))
    start, places, first = cut(data, offsets)
    mean = [np.zeros_like(a) for a in net.arrays()]
    var = [np.zeros_like(a) for a in net.arrays()]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(label))
        speed = rate * (0.5 * (1 + np.cos(np.pi * epoch / epochs)) + 0.02)
        for lo in range(0, len(order), batch):
            docs = order[lo : lo + batch]
            many = first[docs + 1] - first[docs]
            rows = np.concatenate([np.arange(first[d], first[d + 1]) for d in docs])
            edge = np.cumsum(many) - many
            pooled, where = pooled_chunks(net, data, start[rows], places[rows])
            feats = np.add.reduceat(np.maximum(pooled, 0), edge, axis=0) / many[:, None]
            chance = sigmoid(feats @ net.head + net.offset[0])
            slope = (chance - label[docs]) * weight[docs] / weight[docs].sum()
            back = (np.repeat(slope / many, many)[:, None] * net.head[None, :] * (pooled > 0)).astype(np.float32)  # chunks x FILTERS
            grads = [*gradients(net, data, where, back), back.sum(axis=0), feats.T @ slope + 1e-3 * net.head, np.array([slope.sum()])]
            step += 1
            for a, g, m, v in zip(net.arrays(), grads, mean, var, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                a -= (speed * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column (nulls empty) and the offsets of its rows."""
    held = column.cast(pa.large_string()).fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1] if len(held) else np.zeros(1, np.int64)
    data = held.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def in_fold(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 5."""
    return F.crc32(F.col(doc_id).cast("string")) % 5


def train(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, class_bytes: int = CLASS_BYTES) -> Net | float:
    """A net, or a constant score where the labels leave nothing to learn."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (in_fold() != 0)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    counts = {r["quality"]: r["count"] for r in usable.groupBy("quality").count().collect()}
    if len(counts) < 2:
        return float(next(iter(counts), 0.5))
    some = [usable.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for q in (0, 1)]
    # At most 2 * per_class rows: a fixed bound.
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("text")).join(F.broadcast(some[0].union(some[1])), "doc_id").select("doc_id", "quality", "text")
    rows = rows.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("text").alias("text"))
    so_far = F.sum(F.octet_length("text")).over(Window.partitionBy("quality").orderBy(F.xxhash64("doc_id"), "doc_id"))
    taken = rows.withColumn("__bytes", so_far).filter(F.col("__bytes") <= class_bytes).select("doc_id", "quality", "text").toArrow().sort_by("doc_id")
    label = taken.column("quality").to_numpy().astype(np.float64)
    if len(set(label)) < 2:
        return float(label[0]) if len(label) else 0.5
    texts = [t.ljust(WIDTH, b"\0") for t in taken.column("text").to_pylist()]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    weight = np.where(label == 1, counts[1] / (label == 1).sum(), counts[0] / (label == 0).sum())
    return fit(np.frombuffer(b"".join(texts), np.uint8), offsets, label, weight / weight.mean())


def score_documents(documents: DataFrame, model: Net | float, out: str = "score") -> DataFrame:
    """``documents`` with a column ``out``: the probability of label 1 of the whole text.  One of that name is replaced."""
    names = [c for c in documents.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if isinstance(model, float):
                scores = np.full(batch.num_rows, model)
            else:
                data, at = as_bytes(batch.column("text"))
                rows = [features(model, data[lo:hi]) for lo, hi in zip(at, at[1:])]
                scores = sigmoid(np.array(rows).reshape(-1, FILTERS) @ model.head.astype(np.float64) + float(model.offset[0]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(scores, pa.float64())], [*names, out])

    held = documents.select(*names)
    return held.mapInArrow(run, StructType([*held.schema.fields, StructField(out, DoubleType())]))
