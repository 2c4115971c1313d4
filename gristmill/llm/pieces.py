"""SentencePiece encoding and decoding: an Aho-Corasick automaton drives Viterbi.

The automaton reads the UTF-8 bytes of a text; at each byte the output links give all
pieces that end there, longest first, and each relaxes the best score of the prefix.
One pass finds the segmentation of the largest total score; ties go to the longer last
piece.  A character that is no piece costs the least score less 10 and becomes byte
pieces.

A text is encoded as ``▁`` plus the text, blanks as ``▁`` (empty texts as nothing).  No
piece has a ``▁`` after another character, so units (blanks and the run that follows,
cut at line feeds where no piece has one) are independent: a task keeps the pieces of
the units that it has seen, and the automaton walks all new units of a batch abreast.
Units of more than LONG bytes (text without blanks) are walked one by one in a plain
loop, whose memory is a few numbers for each byte.

The segmentation is the unigram model's, whatever model the file holds: with a unigram
model the ids are those of the file's own library; a BPE model's library merges by
rank, so its ids differ (README has the figures).

A ``▁`` of the text itself is written as byte pieces, so that decoding gives back every
text exactly.

Defined cases: null text gives null pieces; empty text gives none; repeated rows are
encoded each; unpaired surrogates cannot occur in a column.  Empty table: no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

BLANK = "▁"
#: Units kept by a task, cells of a lattice that is walked at once.
KEPT_UNITS, LATTICE = 200_000, 1 << 20
#: Bytes of a unit that is walked alone, and of the longest that is kept.
LONG = 256
UNKNOWN_COST = 10.0
#: Stands for a ``▁`` of the text among units, none of which is empty.
OWN = ""


class Pieces:
    """The vocabulary of a model file, as an automaton over bytes."""

    def __init__(self, model: str):
        import sentencepiece

        held = sentencepiece.SentencePieceProcessor(model_file=model)
        names = [held.id_to_piece(i) for i in range(held.get_piece_size())]
        kind = ["byte" if held.is_byte(i) else "other" if held.is_control(i) or held.is_unknown(i) or held.is_unused(i) else "text" for i in range(len(names))]
        self.byte_ids = np.zeros(256, np.int32)
        for i, name in enumerate(names):
            if kind[i] == "byte":
                self.byte_ids[int(name[3:5], 16)] = i
        texts = {i: names[i].encode() for i in range(len(names)) if kind[i] == "text"}
        self.score = np.array([held.get_score(i) if kind[i] == "text" else 0.0 for i in range(len(names))])
        self.length = np.array([len(texts.get(i, b"")) for i in range(len(names))], np.int32)
        self.unknown = min(self.score[i] for i in texts) - UNKNOWN_COST
        self.sizes, self.costs = self.length.tolist(), self.score.tolist()
        self.text = [texts[i].replace(BLANK.encode(), b" ") if i in texts else bytes([int(n[3:5], 16)]) if kind[i] == "byte" else b"" for i, n in enumerate(names)]
        self.build(texts)
        lines = not any(b"\n" in t and len(t) > 1 for t in texts.values())
        inner = any(BLANK in names[i].lstrip(BLANK) for i in texts)
        cut = "" if inner else r"▁*[^▁\n]+|▁+|\n" if lines else r"▁*[^▁]+|▁+"
        self.units = re.compile(cut).findall if cut else lambda text: [text]
        self.kept: dict[str, bytes] = {}
        self.flat: tuple | None = None

    def build(self, texts: dict[int, bytes]) -> None:
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for i, text in texts.items():
            at = 0
            for b in text:
                if b not in children[at]:
                    children[at][b] = len(children)
                    children.append({})
                    ends.append(-1)
                at = children[at][b]
            ends[at] = i
        n = len(children)
        self.goto = np.zeros((n, 256), np.uint16 if n < 1 << 16 else np.int32)
        self.ends, self.link = np.array(ends, np.int32), np.zeros(n, np.int32)  # link: the next shorter piece's state, 0 for none
        fail = np.zeros(n, np.int32)
        level = [0]
        while level:
            below = []
            for at in level:
                row = self.goto[fail[at]].copy() if at else self.goto[0]
                for b, child in children[at].items():
                    fail[child] = row[b] if at else 0
                    self.link[child] = fail[child] if self.ends[fail[child]] >= 0 else self.link[fail[child]]
                    below.append(child)
                for b, child in children[at].items():
                    row[b] = child
                self.goto[at] = row
            level = below

    def segment(self, units: list[bytes]) -> list[bytes]:
        """The int32 ids of each unit, by a Viterbi pass over all units abreast; long ones alone."""
        out = [self.walk(u) if len(u) > LONG else b"" for u in units]
        order = sorted((i for i in range(len(units)) if len(units[i]) <= LONG), key=lambda i: len(units[i]))
        lo = 0
        while lo < len(order):
            hi = lo + 1
            while hi < len(order) and (hi - lo + 1) * (len(units[order[hi]]) + 1) <= LATTICE:
                hi += 1
            some = order[lo:hi]
            for i, ids in zip(some, self.lattice([units[i] for i in some]), strict=True):
                out[i] = ids
            lo = hi
        return out

    def lattice(self, units: list[bytes]) -> list[bytes]:
        sizes = np.array([len(u) for u in units])
        wide, n = int(sizes.max(initial=0)), len(units)
        data = np.frombuffer(b"".join(u.ljust(wide, b"\0") for u in units), np.uint8).reshape(n, wide)
        best = np.full((n, wide + 1), -np.inf)
        back = np.zeros((n, wide + 1), np.int32)  # a piece, or minus the bytes of a character that is none
        best[:, 0] = 0
        state, begun = np.zeros(n, np.int64), np.zeros(n, np.int64)
        alone = np.zeros(n, bool)  # the last character is a piece
        for i in range(wide):
            byte = data[:, i]
            begun = np.where((byte & 0xC0) != 0x80, i, begun)
            state = self.goto[state, byte].astype(np.int64)
            alone[:] = False
            rows = np.flatnonzero(i < sizes)
            at = np.where(self.ends[state[rows]] >= 0, state[rows], self.link[state[rows]])
            while True:
                live = at > 0
                rows, at = rows[live], at[live]
                if not len(rows):
                    break
                piece = self.ends[at]
                start = i + 1 - self.length[piece]
                alone[rows[start == begun[rows]]] = True
                score = best[rows, start] + self.score[piece]
                better = score > best[rows, i + 1]
                best[rows[better], i + 1] = score[better]
                back[rows[better], i + 1] = piece[better]
                at = self.link[at]
            # A whole character ends here, and is no piece.
            ends = (i + 1 == sizes) | (i + 1 < sizes) & ((data[:, min(i + 1, wide - 1)] & 0xC0) != 0x80)
            rows = np.flatnonzero(ends & ~alone & (i < sizes))
            score = best[rows, begun[rows]] + self.unknown
            better = score > best[rows, i + 1]
            rows = rows[better]
            best[rows, i + 1] = score[better]
            back[rows, i + 1] = begun[rows] - (i + 1)
        found_row, found_id = [], []
        at, rows = sizes.copy(), np.flatnonzero(sizes)
        while len(rows):
            piece = back[rows, at[rows]]
            bare = piece < 0
            for k in range(1, 5):  # the bytes of a character, last first
                some = rows[bare & (piece <= -k)]
                if len(some):
                    found_row.append(some)
                    found_id.append(self.byte_ids[data[some, at[some] - k]])
            found_row.append(rows[~bare])
            found_id.append(piece[~bare])
            at[rows] -= np.where(bare, -piece, self.length[np.maximum(piece, 0)])
            rows = rows[at[rows] > 0]
        if not found_row:
            return [b""] * n
        row, ids = np.concatenate(found_row), np.concatenate(found_id).astype("<i4")
        order = np.lexsort((-np.arange(len(row)), row))
        row, ids = row[order], ids[order]
        edge = np.searchsorted(row, np.arange(n + 1))
        return [ids[a:b].tobytes() for a, b in zip(edge, edge[1:])]

    def walk(self, unit: bytes) -> bytes:
        """The int32 ids of one unit: as ``lattice``, byte by byte."""
        if self.flat is None:  # plain numbers: quicker one at a time
            self.flat = memoryview(np.ascontiguousarray(self.goto).reshape(-1)), self.ends.tolist(), self.link.tolist()
        goto, ends, link = self.flat
        sizes, costs, unknown, size = self.sizes, self.costs, self.unknown, len(unit)
        best, back = array("d", bytes(8 * (size + 1))), array("i", bytes(4 * (size + 1)))
        state = begun = 0
        for i, byte in enumerate(unit, 1):
            if byte & 0xC0 != 0x80:
                begun = i - 1
            state = goto[state << 8 | byte]
            top, piece_of, alone = -math.inf, 0, False
            at = state if ends[state] >= 0 else link[state]
            while at:
                piece = ends[at]
                start = i - sizes[piece]
                alone = alone or start == begun
                score = best[start] + costs[piece]
                if score > top:
                    top, piece_of = score, piece
                at = link[at]
            if not alone and (i == size or unit[i] & 0xC0 != 0x80):  # a whole character ends here, and is no piece
                score = best[begun] + unknown
                if score > top:
                    top, piece_of = score, begun - i
            best[i], back[i] = top, piece_of
        out, at = array("i"), size
        while at:
            piece = back[at]
            if piece < 0:
                out.extend(int(self.byte_ids[unit[k]]) for k in range(at - 1, at + piece - 1, -1))
                at += piece
            else:
                out.append(piece)
                at -= sizes[piece]
        out.reverse()
        return np.frombuffer(out, np.int32).astype("<i4").tobytes() if out else b""

    def encode_all(self, texts: list[str | None]) -> list[bytes | None]:
        """The int32 ids of each text."""
        cuts = [None if t is None else [] if not t else self.marked(t) if BLANK in t else self.units(BLANK + t.replace(" ", BLANK)) for t in texts]
        fresh = {u for units in cuts if units for u in units}.difference(self.kept)
        if len(self.kept) + len(fresh) > KEPT_UNITS:
            self.kept.clear()
            fresh = {u for units in cuts if units for u in units}
        self.kept[OWN] = self.byte_ids[list(BLANK.encode())].astype("<i4").tobytes()
        new = [u for u in fresh if u != OWN]
        found = dict(zip(new, self.segment([u.encode() for u in new]), strict=True))
        self.kept.update((u, ids) for u, ids in found.items() if len(u) <= LONG)  # long ones hardly come again
        return [None if units is None else b"".join(found[u] if u in found else self.kept[u] for u in units) for units in cuts]

    def marked(self, text: str) -> list[str]:
        """Units of a text that has ``▁`` itself: OWN stands for one."""
        out: list[str] = []
        for i, part in enumerate((" " + text).split(BLANK)):
            if i:
                out.append(OWN)
            if part:
                out += self.units(part.replace(" ", BLANK))
        return out

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.text.__getitem__, np.frombuffer(ids, "<i4").tolist()))
        return (text[1:] if text[:1] == b" " else text).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def pieces(model: str) -> Pieces:
    return Pieces(model)


def encode(documents: DataFrame, model: str, column: str = "text", out: str = "pieces") -> DataFrame:
    """``documents`` with the ids of a text column; a column of the same name is replaced."""
    return _with(documents, model, column, out, True)


def decode(encoded: DataFrame, model: str, column: str = "pieces", out: str = "text") -> DataFrame:
    """The texts of a column of ids; a column of the same name is replaced."""
    return _with(encoded, model, column, out, False)


def _with(df: DataFrame, model: str, column: str, out: str, forward: bool) -> DataFrame:
    names = [c for c in df.columns if c != out or c == column]
    kept = [c for c in names if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pieces(model)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                given = part.column(column)
                if forward:
                    ids = held.encode_all(given.to_pylist())
                    made = list_array(ids)
                else:
                    made = pa.array([None if not x.is_valid else held.decode(np.asarray(x.values, dtype="<i4").tobytes()) for x in given], pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), made], [*kept, out])

    fields = [df.schema[c] for c in kept] + [StructField(out, ArrayType(IntegerType()) if forward else StringType())]
    return df.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, StructType(fields))


def list_array(ids: list[bytes | None]) -> pa.Array:
    sizes = np.array([len(x or b"") // 4 for x in ids], np.int64)
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=np.array([x is None for x in ids] + [False]))
    return pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(x or b"" for x in ids), "<i4"), pa.int32()))


def round_trip(documents: DataFrame, model: str) -> DataFrame:
    """doc_id, n_pieces, pieces, decoded_sha256: encoded, and read back from the pieces, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pieces(model)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                ids = held.encode_all(part.column("text").to_pylist())
                read = [None if x is None else hashlib.sha256(held.decode(x).encode()).hexdigest() for x in ids]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([None if x is None else len(x) // 4 for x in ids], pa.int64()), list_array(ids), pa.array(read, pa.string())], ["doc_id", "n_pieces", "pieces", "decoded_sha256"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_pieces long, pieces array<int>, decoded_sha256 string")
