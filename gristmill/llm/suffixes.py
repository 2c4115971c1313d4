"""Removal of repeated byte strings by a hash-compared sort of suffixes.

Every text is its UTF-8 bytes.  A byte goes if a ``LENGTH``-byte string that covers it
also starts in a document with a smaller id.  A suffix therefore matters up to its
first ``LENGTH`` bytes only.

Suffixes are merge-sorted.  Runs of the sort are formed by the first SEED bytes; from
there two suffixes are compared by their common extension, found by a binary search
over prefix polynomial hashes (modulo 2**64): the hash of any stretch takes one
subtraction and one product.  Suffixes of one hash go as one, and all comparisons of a
merge step are made at once.  The
sorted order is then verified by the bytes themselves; where hashes collided, the run
is sorted by its bytes.  A class of equal suffixes loses all but its smallest
document's.

Steps, each by groups of bounded size:

1. Documents are dealt to groups of some megabytes (compressed Arrow blobs).
2. Every suffix has a key: the least hash of its GRAM-byte substrings.  Equal suffixes
   have equal keys, and neighbouring suffixes mostly share one.  Each group sends its
   distinct keys, 4 bytes each, to the keys' buckets, which answer with one bit: does
   another group have it too?  Texts that are whole copies are found along with them.
3. Groups sort their suffixes of repeated keys, settle repeats among their own
   documents, and send what else another group may have (only the smallest
   holder's, however many of the group's documents hold it), as stretches of text, to the keys' buckets.
4. Buckets sort the stretches' suffixes; what repeats a smaller document is sent back.
5. Groups take the covered bytes out.

Frequent passages are thus joined within a group before they travel: a bucket gets a
string at most once from each group.  Beyond FAN groups buckets form a tree: a task
settles the stretches of FAN groups (of one bucket), and sends on what is left, a
string once; so no task gets a string from more than FAN senders, however common it is.
Rows are dealt to groups by id and text, so neither rows without an id nor many rows of
one id meet in one group.

Defined cases: null text is empty; texts shorter than LENGTH lose nothing; rows with
a null doc_id lose nothing and take nothing from others; rows of one doc_id don't
take from each other.  Empty table: no rows.  Extra columns ride along in
``cleaned``; other uses ignore them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LENGTH, GRAM = 50, 24
#: Bytes that form the first runs of the sort.
SEED = 16
#: Suffixes hashed at once, and sorted at once.
STRETCH, SORTED = 1 << 18, 1 << 18
#: Senders of stretches that one task takes.
FAN = 2_048


def plan_sizes(size: int, parts: int) -> tuple[int, int]:
    """How many groups and buckets for so many bytes.

    A row goes from each group to each bucket, so both grow with the square root of the
    input (rows in proportion to it) until a task's memory bounds them: at 32 MB of text
    for a group, 128 MB of input for a bucket.
    """
    root = math.isqrt(max(0, size))
    group, bucket = min(32 << 20, max(4 << 20, 128 * root)), min(128 << 20, max(16 << 20, 512 * root))
    return max(parts, -(-size // group)), max(parts, -(-size // bucket))


_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
NO_ID = np.iinfo(np.int64).max


@lru_cache(maxsize=4)
def powers_of(bits: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(1 << bits, _BASE, np.uint64), np.full(1 << bits, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's first ``size`` powers at least, and their inverses, modulo 2**64."""
    return powers_of(max(16, size.bit_length()))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads a hash over all 64 bits (in place)."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """P with P[i] the polynomial hash of the first i bytes."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[0][: len(data)], out=out[1:])
    return out


def stretch_hashes(prefix: np.ndarray, length: int) -> np.ndarray:
    """The hash of the ``length`` bytes that start at each place, comparable between places."""
    many = len(prefix) - length
    return mix((prefix[length:] - prefix[:many]) * powers(many)[1][:many])


def least_of(h: np.ndarray, width: int) -> np.ndarray:
    """The least of ``width`` consecutive values, by doubling."""
    size = 1
    while 2 * size <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    rest = width - size
    return np.minimum(h[:-rest], h[rest:]) if rest else h


def suffix_hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The hash of the LENGTH bytes at each of the ascending places."""
    out = np.empty(len(at), np.uint64)
    lo = 0
    while lo < len(at):
        start = int(at[lo])
        hi = int(np.searchsorted(at, start + STRETCH - LENGTH))
        prefix = prefix_hashes(data[start : start + STRETCH])
        i = at[lo:hi] - start
        out[lo:hi] = (prefix[i + LENGTH] - prefix[i]) * powers(len(prefix))[1][i]
        lo = hi
    return mix(out)


def key_runs(data: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, count, key) of the runs of neighbouring valid suffixes with one key."""
    starts, counts, keys = [], [], []
    for a in range(0, len(valid), STRETCH - LENGTH):
        part = data[a : a + STRETCH - 1]
        live = valid[a : a + STRETCH - LENGTH]
        if not live.any():
            continue
        key = least_of(stretch_hashes(prefix_hashes(part), GRAM), LENGTH - GRAM + 1)
        edge = np.flatnonzero((key[1:] != key[:-1]) | (live[1:] != live[:-1])) + 1
        first = np.concatenate([[0], edge])
        size = np.diff(np.append(first, len(key)))
        keep = live[first]
        starts.append(first[keep] + a)
        counts.append(size[keep])
        keys.append(key[first[keep]])
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(counts), mix(np.concatenate(keys) * np.uint64(0xC2B2AE3D27D4EB4F))


def expand(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the runs, and the run of each."""
    run = np.repeat(np.arange(len(start)), count)
    return np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count) + start[run], run


def words_at(data: np.ndarray) -> np.ndarray:
    """The 8 bytes that start at each place, as one number."""
    held = np.ascontiguousarray(data)
    return np.ndarray((len(held) - 7,), "<u8", held, 0, (1,))


class Sorter:
    """Suffixes at ascending places of ``data``, up to LENGTH bytes each, to be merge-sorted."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        # The bytes that the suffixes cover, as one stretch for each run of them.
        head = np.flatnonzero(np.diff(at, prepend=-LENGTH) >= LENGTH) if len(at) else np.zeros(0, np.int64)
        size = np.append(at[head[1:] - 1], at[-1:]) + LENGTH - at[head]
        base = np.cumsum(size) - size
        places, stretch = expand(at[head], size)
        self.data = data[places]
        shift = np.repeat(base - at[head], np.diff(np.append(head, len(at))))
        self.at = at + shift  # in self.data
        up, down = powers(int(size.max(initial=0)))
        self.prefix = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[np.arange(len(self.data)) - base[stretch]], out=self.prefix[1:])
        self.before = self.prefix[self.at]
        self.scale = down[self.at - np.repeat(base, np.diff(np.append(head, len(at))))]
        self.whole = self.hashes(np.arange(len(at)), LENGTH)

    def hashes(self, i: np.ndarray, length) -> np.ndarray:
        """The hashes of the first ``length`` bytes of suffixes i."""
        return (self.prefix[self.at[i] + length] - self.before[i]) * self.scale[i]

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many bytes suffixes i and j have in common, SEED at least: by binary search over prefix hashes."""
        low, high = np.full(len(i), SEED), np.full(len(i), LENGTH)
        for _ in range((LENGTH - SEED).bit_length()):
            middle = (low + high + 1) >> 1
            same = self.hashes(i, middle) == self.hashes(j, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def below(self, i: np.ndarray, j: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Is suffix i less than j?  Of equal ones, what ``ties`` says."""
        out = ties.copy()
        differ = np.flatnonzero(self.whole[i] != self.whole[j])
        i, j = i[differ], j[differ]
        common = np.minimum(self.extension(i, j), LENGTH - 1)
        out[differ] = self.data[self.at[i] + common] < self.data[self.at[j] + common]
        return out

    def seeds(self) -> tuple[np.ndarray, np.ndarray]:
        words = words_at(self.data)
        return words[self.at].byteswap(), words[self.at + 8].byteswap()

    def order(self) -> tuple[np.ndarray, np.ndarray]:
        """(suffixes in order, for each but the first whether it equals the one before)."""
        first, second = self.seeds()
        runs = np.lexsort((self.whole, second, first))
        same = (first[runs[1:]] == first[runs[:-1]]) & (second[runs[1:]] == second[runs[:-1]])
        # Suffixes of one hash are merged as one.
        twin = same & (self.whole[runs[1:]] == self.whole[runs[:-1]])
        head = np.flatnonzero(np.concatenate([[True], ~twin]))
        many = np.diff(np.append(head, len(runs)))
        ones = runs[head]
        seed = np.flatnonzero(np.concatenate([[True], ~same[head[1:] - 1]]))
        size = np.diff(np.append(seed, len(ones)))
        merged = ones.copy()
        self.merge(merged, np.repeat(seed, size), np.repeat(size, size))
        place = np.full(len(runs), -1)
        place[ones] = np.arange(len(ones))
        # Hashes that collide may contradict each other, so that merges lose suffixes: those seeds are as they were.
        lost = np.add.reduceat(np.bincount(place[merged], minlength=len(ones)) != 1, seed) if len(seed) else seed
        merged = np.where(np.repeat(lost > 0, size), ones, merged)
        at, _ = expand(head[place[merged]], many[place[merged]])
        order = runs[at]
        return order, self.verified(order, same)

    def merge(self, order: np.ndarray, head: np.ndarray, size: np.ndarray) -> None:
        """Merges the runs of each seed, of 1, 2, 4, ... suffixes, in place.  head, size: of each place's seed."""
        live, width = np.flatnonzero(size > 1), 1
        head, size = head[live], size[live]
        while len(live):
            mine = live - head
            run = mine // width
            other = np.minimum((run ^ 1) * width, size)  # where the sibling run starts, and its length
            length = np.minimum(other + width, size) - other
            low, high = np.zeros(len(live), np.int64), length.copy()
            right = run % 2 == 1  # of equal suffixes the left run's come first
            busy = np.flatnonzero(low < high)
            while len(busy):
                middle = (low[busy] + high[busy]) >> 1
                # Does the sibling's suffix stand before mine?
                before = self.below(order[head[busy] + other[busy] + middle], order[live[busy]], right[busy])
                low[busy], high[busy] = np.where(before, middle + 1, low[busy]), np.where(before, high[busy], middle)
                busy = busy[low[busy] < high[busy]]
            order[head + (run & ~1) * width + mine - run * width + low] = order[live]
            width *= 2
            more = size > width
            live, head, size = live[more], head[more], size[more]

    def words(self, i: np.ndarray) -> list[np.ndarray]:
        held = words_at(self.data)
        return [held[self.at[i] + k].byteswap() for k in (*range(0, LENGTH - 8, 8), LENGTH - 8)]

    def verified(self, order: np.ndarray, same_seed: np.ndarray) -> np.ndarray:
        """Which neighbours are equal, by their bytes; seeds whose order is wrong are sorted anew by their bytes."""
        less, equal = self.neighbours(order)
        wrong = np.flatnonzero(~less & ~equal)
        if len(wrong):
            for lo, hi in class_bounds(same_seed, wrong):
                order[lo:hi] = sorted(order[lo:hi].tolist(), key=lambda i: self.data[self.at[i] : self.at[i] + LENGTH].tobytes())
            _, equal = self.neighbours(order)
        return equal

    def neighbours(self, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each suffix but the last: is it less than the next, are they equal; by their bytes."""
        less, equal = np.zeros(len(order) - 1, bool), np.ones(len(order) - 1, bool)
        for word in self.words(order):
            less |= equal & (word[:-1] < word[1:])
            equal &= word[:-1] == word[1:]
        return less, equal


def classes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For suffixes at ascending places a number that equal ones share, from 0, in their order."""
    if not len(at):
        return np.zeros(0, np.int64)
    order, equal = Sorter(data, at).order()
    out = np.empty(len(at), np.int64)
    out[order] = np.cumsum(np.concatenate([[False], ~equal]))
    return out


def repeats(data: np.ndarray, at: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For suffixes at ascending places of ``data`` the smallest owner of the same LENGTH bytes."""
    label = classes(data, at)
    least = np.full(int(label.max(initial=-1)) + 1, NO_ID)
    np.minimum.at(least, label, owner)
    return least[label]


def settled(data: np.ndarray, start: np.ndarray, count: np.ndarray, key: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, run of each, smallest owner of the same bytes) of all suffixes of the runs, in parts of about SORTED.

    Parts are of whole keys, so that equal suffixes meet; a key of more suffixes is
    split by their hashes, and then goes through the sort piece by piece, with one
    suffix for each string that has been seen.
    """
    by_key = np.argsort(key, kind="stable")
    size = np.cumsum(count[by_key])
    ends = np.append(np.flatnonzero(np.diff(key[by_key])) + 1, len(by_key))  # of each key
    lo = 0
    while lo < len(by_key):
        before = size[lo - 1] if lo else 0
        nth = int(np.searchsorted(ends, np.searchsorted(size, before + SORTED, side="right"), side="right"))
        hi = int(ends[nth - 1]) if nth and ends[nth - 1] > lo else int(ends[np.searchsorted(ends, lo, side="right")])
        some = np.sort(by_key[lo:hi])
        if size[hi - 1] - before <= SORTED:
            places, run = expand(start[some], count[some])
            yield places, some[run], repeats(data, places, owner[some][run])
        else:
            yield from piecewise(data, start[some], count[some], owner[some], some)
        lo = hi


def piecewise(data: np.ndarray, start: np.ndarray, count: np.ndarray, owner: np.ndarray, name: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``settled`` for runs whose suffixes are too many for one sort."""
    many = -(-count // SORTED)
    nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    of = np.repeat(np.arange(len(start)), many)
    start, count = start[of] + nth * SORTED, np.minimum(SORTED, count[of] - nth * SORTED)
    edge = np.cumsum(count)
    cuts = np.unique([0, *np.searchsorted(edge, np.arange(SORTED, int(edge[-1]) + SORTED, SORTED), side="left") + 1])
    splits = int(-(-edge[-1] // (4 * SORTED)))

    def parts(split: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for lo, hi in zip(cuts, np.minimum(cuts[1:], len(start))):
            places, run = expand(start[lo:hi], count[lo:hi])
            mine = np.flatnonzero(suffix_hashes(data, places) % np.uint64(splits) == split)
            if len(mine):
                yield places[mine], of[lo:hi][run[mine]]

    def with_seen(seen: tuple[np.ndarray, np.ndarray], places: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, who = np.concatenate([seen[0], places]), np.concatenate([seen[1], own])
        order = np.argsort(at, kind="stable")
        label = np.empty(len(at), np.int64)
        label[order] = classes(data, at[order])
        least = np.full(int(label.max()) + 1, NO_ID)
        np.minimum.at(least, label, who)
        first = np.full(len(least), len(at))
        np.minimum.at(first, label, np.arange(len(at)))
        return label, least, at[first]

    for split in range(splits):
        seen = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for places, run in parts(split):
            _, least, at = with_seen(seen, places, owner[run])
            seen = at, least
        for places, run in parts(split):
            label, least, _ = with_seen(seen, places, owner[run])
            yield places, name[run], least[label[len(seen[0]) :]]


def class_bounds(same: np.ndarray, pairs: np.ndarray) -> list[tuple[int, int]]:
    """The sorted ranges of the classes that hold the given neighbour pairs."""
    head = np.flatnonzero(np.concatenate([[True], ~same]))
    ends = np.append(head[1:], len(same) + 1)
    return [(int(head[k]), int(ends[k])) for k in np.unique(np.searchsorted(head, pairs, side="right") - 1)]


def joined(places: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending places as (first index, count) of runs of neighbours in one unit."""
    if not len(places):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    head = np.concatenate([[0], np.flatnonzero((np.diff(places) != 1) | (np.diff(unit) != 0)) + 1])
    return head, np.diff(np.append(head, len(places)))


class Group:
    """The documents of a group in order of (doc_id, text), as one stretch of bytes."""

    def __init__(self, blobs: pa.ChunkedArray):
        rows = pa.concat_tables([pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(b)).read_all() for b in blobs.to_pylist()])
        texts = [x.as_py() or b"" for x in rows.column("__bytes")]
        ids = [NO_ID if x is None else x for x in rows.column("doc_id").to_pylist()]
        order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        self.rows = rows.take(pa.array(order, pa.int64()))
        self.texts = [texts[i] for i in order]
        self.ids = np.array([ids[i] for i in order], np.int64)
        self.size = np.array([len(t) for t in self.texts], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        self.data = np.frombuffer(b"".join(self.texts), np.uint8)
        self.digest = [hashlib.blake2b(t, digest_size=16).digest() if len(t) >= LENGTH and i != NO_ID else b"" for t, i in zip(self.texts, self.ids)]
        # Later copies of a text in the group: gone as a whole if their id is larger.
        seen: dict[bytes, int] = {}
        self.copy = np.zeros(len(self.ids), bool)  # not searched: an equal text of no larger id is in the group
        self.gone = np.zeros(len(self.ids), bool)
        for i, d in enumerate(self.digest):
            if d:
                first = seen.setdefault(d, i)
                self.copy[i] = first != i
                self.gone[i] = self.ids[first] < self.ids[i]
        self.originals = seen

    def drop_copies(self, digests: dict[bytes, int]) -> None:
        """Texts that are copies of other groups' documents with a smaller id."""
        for i, d in enumerate(self.digest):
            if d and digests.get(d, NO_ID) < self.ids[i]:
                self.copy[i] = self.gone[i] = True

    def valid(self) -> np.ndarray:
        """The places where a suffix to search starts."""
        edge = np.zeros(max(0, len(self.data) - LENGTH + 1) + 1, np.int32)
        some = (self.size >= LENGTH) & ~self.copy & (self.ids != NO_ID)
        np.add.at(edge, self.start[:-1][some], 1)
        np.add.at(edge, self.start[:-1][some] + self.size[some] - LENGTH + 1, -1)
        return np.cumsum(edge[:-1]) > 0

    def doc_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, places, side="right") - 1


def packed_arrays(*arrays: np.ndarray) -> bytes:
    head = np.array([len(a) for a in arrays], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(a.tobytes() for a in arrays))


def unpacked_arrays(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes, at, out = np.frombuffer(raw, "<i8", len(kinds)), 8 * len(kinds), []
    for kind, n in zip(kinds, sizes, strict=True):
        out.append(np.frombuffer(raw, kind, n, at))
        at += out[-1].nbytes
    return out


ROW = "bucket int, grp int, kind int, blob binary"
DIGESTS, KEYS, SPANS, STRETCHES = 0, 1, 2, 3


def row_table(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    a, b, c, d = list(zip(*rows)) or [()] * 4
    return pa.table({"bucket": pa.array(a, pa.int32()), "grp": pa.array(b, pa.int32()), "kind": pa.array(c, pa.int32()), "blob": pa.array(d, pa.binary())})


def grouped_blobs(documents: DataFrame, groups: int) -> DataFrame:
    """(grp, blob): the documents of each group, a blob from each batch."""
    names = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            table = pa.Table.from_batches([batch])
            group = table.column("__group").to_numpy()
            table = table.drop_columns(["__group"])
            order = np.argsort(group, kind="stable")
            table, group = table.take(pa.array(order)), group[order]
            heads = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1]) if len(group) else []
            blobs = []
            for lo, hi in zip(heads, [*heads[1:], len(group)]):
                sink = pa.BufferOutputStream()
                part = table.slice(lo, hi - lo).combine_chunks()
                with pa.ipc.new_stream(sink, part.schema) as out:
                    out.write_table(part)
                blobs.append(pack.compress(sink.getvalue()))
            yield pa.RecordBatch.from_arrays([pa.array(group[heads] if len(group) else [], pa.int32()), pa.array(blobs, pa.binary())], ["grp", "blob"])

    dealt = documents.select(*[F.col(f"`{c}`") for c in names], F.encode(F.coalesce(F.col("text"), F.lit("")), "utf-8").alias("__bytes"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int").alias("__group"))
    return dealt.drop("text").mapInArrow(run, "grp int, blob binary")


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def send_keys(buckets: int):
    """Step 2, a group: distinct keys and whole-text digests to their buckets."""

    def run(key: tuple[pa.Scalar], table: pa.Table) -> pa.Table:
        group, number = Group(table.column("blob")), key[0].as_py()
        _, _, keys = key_runs(group.data, group.valid())
        distinct = np.unique(keys)
        bucket = bucket_of(distinct, buckets)
        edges = np.searchsorted(bucket, np.arange(buckets + 1))
        low = (distinct & np.uint64(0xFFFFFFFF)).astype("<u4")
        rows = [(b, number, KEYS, low[lo:hi].tobytes()) for b, (lo, hi) in enumerate(zip(edges, edges[1:])) if hi > lo]
        digests: dict[int, list[bytes]] = {}
        for d, i in group.originals.items():
            digests.setdefault(int.from_bytes(d[:4]) % buckets, []).append(d + int(group.ids[i]).to_bytes(8, "little", signed=True))
        rows += [(b, number, DIGESTS, b"".join(x)) for b, x in digests.items()]
        return row_table(rows)

    return run


def answer_keys(key: tuple[pa.Scalar], table: pa.Table) -> pa.Table:
    """Step 2, a bucket: which keys other groups have, and the smallest document of each repeated text."""
    kinds, groups, blobs = table.column("kind").to_numpy(), table.column("grp").to_numpy(), table.column("blob")
    bucket, rows = key[0].as_py(), []
    held = {i: np.frombuffer(blobs[i].as_py(), "<u4") for i in np.flatnonzero(kinds == KEYS)}
    if held:
        every = np.sort(np.concatenate(list(held.values())))
        shared = np.unique(every[1:][every[1:] == every[:-1]])
        for i, keys in held.items():
            at = np.searchsorted(shared, keys)
            at[at == len(shared)] = 0
            bits = shared[at] == keys if len(shared) else np.zeros(len(keys), bool)
            rows.append((bucket, int(groups[i]), KEYS, np.packbits(bits).tobytes()))
    least: dict[bytes, int] = {}
    named = {i: np.frombuffer(blobs[i].as_py(), np.dtype([("d", "V16"), ("id", "<i8")])) for i in np.flatnonzero(kinds == DIGESTS)}
    for held_rows in named.values():
        for d, n in zip(held_rows["d"].tolist(), held_rows["id"].tolist()):
            d = bytes(d)
            least[d] = min(n, least.get(d, n))
    for i, held_rows in named.items():
        told = b"".join(bytes(d) + least[bytes(d)].to_bytes(8, "little", signed=True) for d, n in zip(held_rows["d"].tolist(), held_rows["id"].tolist()) if least[bytes(d)] < n)
        if told:
            rows.append((bucket, int(groups[i]), DIGESTS, told))
    return row_table(rows)


def known_digests(table: pa.Table) -> dict[bytes, int]:
    kinds, out = table.column("kind").to_numpy(), {}
    for i in np.flatnonzero(kinds == DIGESTS):
        raw = table.column("blob")[int(i)].as_py()
        out |= {raw[j : j + 16]: int.from_bytes(raw[j + 16 : j + 24], "little", signed=True) for j in range(0, len(raw), 24)}
    return out


def send_stretches(buckets: int):
    """Step 3, a group: its own repeats, and stretches that another group may repeat."""

    def run(key: tuple[pa.Scalar], table: pa.Table, told: pa.Table) -> pa.Table:
        number = key[0].as_py()
        if not table.num_rows:
            return row_table([])
        group = Group(table.column("blob"))
        start, count, keys = key_runs(group.data, group.valid())
        distinct, inverse, many = np.unique(keys, return_inverse=True, return_counts=True)
        edges = np.searchsorted(bucket_of(distinct, buckets), np.arange(buckets + 1))
        shared = np.zeros(len(distinct), bool)
        kinds, of, blobs = told.column("kind").to_numpy(), told.column("bucket").to_numpy(), told.column("blob")
        for i in np.flatnonzero(kinds == KEYS):
            lo, hi = edges[of[i]], edges[of[i] + 1]
            shared[lo:hi] = np.unpackbits(np.frombuffer(blobs[int(i)].as_py(), np.uint8), count=hi - lo).astype(bool)
        digests = known_digests(told)
        group.drop_copies(digests)
        # The runs to sort; those of a text that another group has whole are settled by it.
        doc = group.doc_of(start)
        keep = (shared | (many > 1))[inverse] & ~group.copy[doc]
        start, count, keys, doc, shared = start[keep], count[keep], keys[keep], doc[keep], shared[inverse[keep]]
        rows: list[tuple[int, int, int, bytes]] = []
        spans: list[np.ndarray] = []
        sent: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for places, run, least in settled(group.data, start, count, keys, group.ids[doc]):
            owner = group.ids[doc[run]]
            lost = least < owner
            head, many_of = joined(places[lost], run[lost])
            at = places[lost][head]
            spans.append(np.stack([group.doc_of(at), at, many_of + LENGTH - 1]))
            out = ~lost & shared[run]
            head, many_of = joined(places[out], run[out])
            sent.append((places[out][head], many_of, run[out][head]))
        if spans:
            all_spans = np.concatenate(spans, axis=1)
            if all_spans.shape[1]:
                o, s, n = all_spans
                rows.append((number % buckets, number, SPANS, packed_arrays(o.astype("<i4"), (s - group.start[o]).astype("<i8"), n.astype("<i4"))))
        if sent:
            at, many_of, run = (np.concatenate(x) for x in zip(*sent, strict=True))
            bucket = bucket_of(keys[run], buckets)
            order = np.lexsort((at, bucket))
            at, many_of, run, bucket = at[order], many_of[order], run[order], bucket[order]
            for b, lo, hi in zip(*cut(bucket)):
                o = doc[run[lo:hi]]
                rows.append((int(b), number, STRETCHES, packed_stretches(group.data, keys[run[lo:hi]] & np.uint64(0xFFFFFFFF), group.ids[o], np.full(len(o), number), o, at[lo:hi] - group.start[o], many_of[lo:hi], at[lo:hi])))
        return row_table(rows)

    return run


def cut(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, from, to) of the runs of equal values."""
    if not len(sorted_values):
        return (np.zeros(0, np.int64),) * 3
    head = np.concatenate([[0], np.flatnonzero(np.diff(sorted_values)) + 1])
    return sorted_values[head], head, np.append(head[1:], len(sorted_values))


#: Of each stretch: key, owner, group, document in the group, start in it, suffixes; then the bytes of all.
STRETCH_KINDS = ("<u8", "<i8", "<i4", "<i4", "<i8", "<i4", "u1")


def packed_stretches(data: np.ndarray, keys, ids, groups, docs, starts, counts, places: np.ndarray) -> bytes:
    """Stretches whose bytes start at ``places`` of ``data``."""
    at, _ = expand(places, counts.astype(np.int64) + LENGTH - 1)
    return packed_arrays(*(a.astype(k) for a, k in zip((keys, ids, groups, docs, starts, counts), STRETCH_KINDS)), data[at])


def settle_stretches(last: bool):
    """Step 4, a bucket (or a part of its senders): the suffixes that repeat one of a smaller document; unless ``last``, the others go on."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        kinds, groups, blobs = table.column("kind").to_numpy(), table.column("grp").to_numpy(), table.column("blob")
        bucket, sender = key[0].as_py(), key[-1].as_py()
        rows = [(bucket, int(groups[i]), SPANS, blobs[int(i)].as_py()) for i in np.flatnonzero(kinds == SPANS)]
        parts = [unpacked_arrays(blobs[int(i)].as_py(), *STRETCH_KINDS) for i in np.flatnonzero(kinds == STRETCHES)]
        if not parts:
            return row_table(rows)
        keys, ids, group, docs, starts, counts, data = (np.concatenate([p[k] for p in parts]) for k in range(len(STRETCH_KINDS)))
        counts = counts.astype(np.int64)
        base = np.cumsum(counts + LENGTH - 1) - (counts + LENGTH - 1)
        found, left = [], []
        for places, of, least in settled(data, base, counts, keys, ids):
            lost = least < ids[of]
            head, many = joined(places[lost], of[lost])
            run_of = of[lost][head]
            found.append(np.stack([group[run_of], docs[run_of], starts[run_of] + places[lost][head] - base[run_of], many + LENGTH - 1]))
            if not last:
                head, many = joined(places[~lost], of[~lost])
                left.append(np.stack([of[~lost][head], places[~lost][head], many]))
        g, o, s, n = np.concatenate(found, axis=1)
        order = np.lexsort((s, o, g))
        g, o, s, n = g[order], o[order], s[order], n[order]
        rows += [(bucket, int(v), SPANS, packed_arrays(o[lo:hi].astype("<i4"), s[lo:hi].astype("<i8"), n[lo:hi].astype("<i4"))) for v, lo, hi in zip(*cut(g))]
        if left:
            of, at, many = np.concatenate(left, axis=1)
            rows.append((bucket, sender, STRETCHES, packed_stretches(data, keys[of], ids[of], group[of], docs[of], starts[of] + at - base[of], many, at)))
        return row_table(rows)

    return run


def removed_spans(group: Group, told: pa.Table) -> list[list[tuple[int, int]]]:
    """For each document the maximal runs of removed bytes."""
    group.drop_copies(known_digests(told))
    size = len(group.data)
    edge = np.zeros(size + 1, np.int32)
    kinds = told.column("kind").to_numpy()
    for i in np.flatnonzero(kinds == SPANS):
        o, s, n = unpacked_arrays(told.column("blob")[int(i)].as_py(), "<i4", "<i8", "<i4")
        at = group.start[o] + s
        np.add.at(edge, at, 1)
        np.add.at(edge, at + n, -1)
    cover = np.cumsum(edge[:-1]) > 0
    # Copies within the group that are not gone share their original's fate: only their ids are equal.
    out: list[list[tuple[int, int]]] = []
    for i, (lo, hi) in enumerate(zip(group.start, group.start[1:])):
        if group.gone[i]:
            out.append([(0, int(hi - lo))])
            continue
        if group.copy[i]:
            out.append(out[group.originals[group.digest[i]]])
            continue
        part = np.diff(np.concatenate([[0], cover[lo:hi].astype(np.int8), [0]]))
        out.append(list(zip(np.flatnonzero(part == 1).tolist(), np.flatnonzero(part == -1).tolist())))
    return out


def kept_bytes(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for lo, hi in spans:
        out.append(text[at:lo])
        at = hi
    return b"".join([*out, text[at:]])


def deduplicated(documents: DataFrame, finish, schema: str | StructType) -> DataFrame:
    """``finish(group, spans)`` of every group: an Arrow table of ``schema``."""
    spark = documents.sparkSession
    size = documents.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups, buckets = plan_sizes(size, parts)
    blobs = grouped_blobs(documents, groups)
    keys = blobs.groupBy("grp").applyInArrow(send_keys(buckets), ROW)
    told = keys.groupBy("bucket").applyInArrow(answer_keys, ROW)
    stretches = blobs.groupBy("grp").cogroup(told.groupBy("grp")).applyInArrow(send_stretches(buckets), ROW)
    senders, answers = groups, [told.filter(F.col("kind") == DIGESTS)]
    while senders > FAN:  # a level of the tree: FAN senders' stretches become one's
        level = stretches.groupBy("bucket", F.floor(F.col("grp") / FAN).cast("int").alias("sender")).applyInArrow(settle_stretches(False), ROW)
        answers.append(level.filter(F.col("kind") == SPANS))
        stretches, senders = level.filter(F.col("kind") == STRETCHES), -(-senders // FAN)
    answers.append(stretches.groupBy("bucket").applyInArrow(settle_stretches(True), ROW))
    told_all = reduce(DataFrame.union, answers)

    def run(key: tuple[pa.Scalar], table: pa.Table, answers: pa.Table) -> pa.Table:
        group = Group(table.column("blob"))
        return finish(group, removed_spans(group, answers))

    return blobs.groupBy("grp").cogroup(told_all.groupBy("grp")).applyInArrow(run, schema)


def digest(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row."""

    def finish(group: Group, spans: list[list[tuple[int, int]]]) -> pa.Table:
        return pa.table({
            "doc_id": pa.array([None if i == NO_ID else int(i) for i in group.ids], pa.int64()),
            "n_bytes": pa.array(group.size),
            "n_removed": pa.array([sum(hi - lo for lo, hi in s) for s in spans], pa.int64()),
            "n_spans": pa.array([len(s) for s in spans], pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(kept_bytes(t, s)).hexdigest() for t, s in zip(group.texts, spans)], pa.string()),
        })

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return deduplicated(rows, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cleaned(documents: DataFrame) -> DataFrame:
    """``documents`` without the repeated bytes; halves of characters left at a cut go too."""
    names = documents.columns

    def finish(group: Group, spans: list[list[tuple[int, int]]]) -> pa.Table:
        null = group.rows.column("__null").to_pylist()
        texts = [None if gone else kept_bytes(t, s).decode("utf-8", "ignore") for gone, t, s in zip(null, group.texts, spans)]
        return pa.table({c: pa.array(texts, pa.string()) if c == "text" else group.rows.column(c) for c in names})

    rows = documents.withColumn("__null", F.col("text").isNull())
    return deduplicated(rows, finish, documents.schema)
