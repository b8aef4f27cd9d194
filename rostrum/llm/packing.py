"""Packing: documents as token ids in sequences of one size, by best-fit decreasing, with little padding.

A document's ids, closed by the end id, are first cut into full windows of `size` ids, which are sequences at once. The rests
are dealt by a hash into blocks of about BLOCK_IDS ids, whose number is counted, and each block is one task: its rests go, longest
first, to the open window with the least room that holds them; a segment tree indexed by remaining room finds it in
log2(size) steps. Windows that stay open by more than a WASTE-th (there are few, unless rests are mostly long) are filled
by cutting rests of the emptiest ones, and what is left of the last one is cut at powers of two, which need no padding.

Sequences are written as a table in the shared folder and read back: sequence_id, ids (little-endian, 2 bytes each if
the vocabulary allows, else 4), and for each piece doc_id, its start in the document, its length and the document's ids.
Full windows and rests are written by kind, so that the first aren't read for the second. Sequence ids are unique, but have gaps.

Texts are encoded by chunks: this tokenizer never forms a token across the border of a blank after a character that isn't white space, nor
across that of a stop after a Latin letter, so the ids of a text are those of its chunks in order. A text that
holds a special token's opening is encoded whole.

Null or empty texts are the end id alone. Repeated rows and rows of equal doc_id, null included, are documents each. A very long text's
ids are in one task, but only its windows and one rest leave it. Further columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.llm import wordbytes as wb
from rostrum.llm.common import eager, frugal, give_back, new_path
from rostrum.llm.repair import _gather
from rostrum.llm.token_output import Coder

SIZE = 2048
END_ID = 1
BLOCK_IDS = 8_000_000
#: A window may stay open by one part in so many.
WASTE = 64
BATCH_BYTES = 4 << 20

BLANK = np.zeros(256, bool)
BLANK[[9, 10, 13, 32]] = True
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
#: The second bytes of letters that begin with C3: all but those of the signs for times and divided by.
LATIN = np.zeros(256, bool)
LATIN[128:192] = True
LATIN[[0x97, 0xB7]] = False
STOP = np.zeros(256, bool)
STOP[list(b".,;:!?()")] = True

_coders: dict[str, ByteCoder] = {}


class ByteCoder(Coder):
    """Whole texts to ids of a byte-level tokenizer that keeps white space and case."""

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = wb.raw(texts)
        n = len(offsets) - 1
        # surely no white space: visible ASCII, and the characters of two bytes from U+00C0 on
        solid = (data > 32) & (data < 127)
        solid[1:] |= (data[:-1] >= 0xC3) & (data[:-1] <= 0xDF)
        begin = np.zeros(len(data), bool)
        letter = LETTER[data]
        letter[1:] |= (data[:-1] == 0xC3) & LATIN[data[1:]]
        begin[1:] = BLANK[data[1:]] & solid[:-1] | STOP[data[1:]] & letter[:-1]
        begin[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(begin)
        place, ids, at, size = self._chunks(data, np.append(starts, len(data)))
        # one chunk more: the end id, behind the chunks of each text
        ids, at, size = np.append(ids, np.uint32(end_id)), np.append(at, len(ids)), np.append(size, 1)
        chunk = np.insert(place, np.searchsorted(starts, offsets[1:]), len(at) - 1)
        out = _gather(ids, at[chunk], size[chunk])
        bounds = np.cumsum(size[chunk])[np.flatnonzero(chunk == len(at) - 1)] if n else np.zeros(0, np.int64)
        each = np.diff(bounds, prepend=0)
        special = np.unique(np.searchsorted(offsets, np.flatnonzero((data[:-1] == 60) & (data[1:] == 124)), "right") - 1)
        if len(special):
            parts = np.split(out, bounds[:-1])
            for i in special:
                parts[i] = np.append(self.whole(bytes(data[offsets[i] : offsets[i + 1]]).decode()), np.uint32(end_id))
            out, each = np.concatenate(parts), np.array([len(p) for p in parts])
        return out, each


def coder(path: str) -> ByteCoder:
    if path not in _coders:
        _coders[path] = ByteCoder(path)
    return _coders[path]


class Room:
    """Open windows by their remaining room: a segment tree over 0 .. size - 1 that knows where there are any."""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << max(1, (size - 1).bit_length())
        self.any = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(self.leaves)]

    def _count(self, room: int, by: int) -> None:
        at = self.leaves + room
        while at:
            self.any[at] += by
            at >>= 1

    def put(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        self._count(room, 1)

    def tightest(self, need: int) -> int | None:
        """The least room of `need` or more that a window has."""
        at = self.leaves + need
        if not self.any[at]:
            # up until a branch to the right holds windows, then down to its first
            while at > 1 and (at & 1 or not self.any[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.any[2 * at] else 2 * at + 1
        return at - self.leaves

    def take(self, room: int) -> int:
        self._count(room, -1)
        return self.windows[room].pop()


def best_fit_decreasing(lengths: list[int], size: int) -> list[list[int]]:
    """Windows of places in `lengths` (each 1 to size - 1), longest first, each in the fullest window that has room for it."""
    room, windows = Room(size), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        free = room.tightest(lengths[i])
        if free is None:
            windows.append([i])
            w, free = len(windows) - 1, size
        else:
            w = room.take(free)
            windows[w].append(i)
        if free > lengths[i]:
            room.put(free - lengths[i], w)
    return windows


Piece = tuple[int, int, int]  # which rest, from where, to where


def filled(windows: list[list[Piece]], size: int, waste: int) -> list[list[Piece]]:
    """The windows with rooms over `waste` filled by pieces of the emptiest ones, which are cut where they don't fit; the
    last one is cut at powers of two if it stays open by more than that."""
    held = lambda w: sum(hi - lo for _, lo, hi in w)
    full = [w for w in windows if size - held(w) <= waste]
    loose = sorted((w for w in windows if size - held(w) > waste), key=held)
    while len(loose) > 1:
        taker = loose.pop()
        free = size - held(taker)
        while free and loose:
            i, lo, hi = loose[0].pop()
            to = min(hi, lo + free)
            taker.append((i, lo, to))
            free -= to - lo
            if to < hi:
                loose[0].append((i, to, hi))
            elif not loose[0]:
                loose.pop(0)
        # it stays open only if there is nothing left to fill it with
        (full if free <= waste else loose).append(taker)
    for w in loose:
        left = held(w)
        if size - left <= waste:
            full.append(w)
            continue
        while left:
            power = 1 << left.bit_length() - 1
            part: list[Piece] = []
            room = power
            while room:
                i, lo, hi = w.pop(0)
                to = min(hi, lo + room)
                part.append((i, lo, to))
                room -= to - lo
                if to < hi:
                    w.insert(0, (i, to, hi))
            full.append(part)
            left -= power
    return full


COLUMNS = ["sequence_id", "ids", "doc_ids", "starts", "lengths", "doc_tokens"]
SEQUENCES = "sequence_id long, ids binary, doc_ids array<long>, starts array<long>, lengths array<int>, doc_tokens array<long>"


def _table(rows: list[tuple]) -> list[pa.Array]:
    kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())]
    return [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]


def _cut_up(path: str, size: int, end_id: int):
    """Full windows and rests of the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = coder(path)
        kind = np.dtype("<u2" if use.vocabulary <= 1 << 16 else "<u4")
        number = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []
        kinds: list[str] = []
        held = 0
        for batch in batches:
            for part in wb.pieces(batch, "text", 1 << 20):
                ids, each = use.encode(part.column("text"), end_id)
                raw = memoryview(ids.astype(kind).tobytes())
                ends = np.cumsum(each)
                for doc_id, end, n in zip(part.column("doc_id").to_pylist(), ends.tolist(), each.tolist(), strict=True):
                    for start in range(0, n, size):
                        length = min(size, n - start)
                        at = (end - n + start) * kind.itemsize
                        rows.append((2 * number, bytes(raw[at : at + length * kind.itemsize]), [doc_id], [start], [length], [n]))
                        kinds.append("window" if length == size else "rest")
                        number += 1
                        held += length * kind.itemsize
                        if held >= BATCH_BYTES:
                            yield pa.RecordBatch.from_arrays([*_table(rows), pa.array(kinds)], [*COLUMNS, "kind"])
                            rows, kinds, held = [], [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([*_table(rows), pa.array(kinds)], [*COLUMNS, "kind"])

    return run


def _packed(size: int, waste: int):
    """One block's rests as sequences."""

    def run(group: pa.Table) -> pa.Table:
        # in one order, whatever order rows come in
        group = group.sort_by("sequence_id").combine_chunks()
        block = group.column("block")[0].as_py()
        one = lambda c: group.column(c).combine_chunks().flatten().to_pylist()
        ids, doc_ids, starts, lengths, totals = group.column("ids").to_pylist(), one("doc_ids"), one("starts"), one("lengths"), one("doc_tokens")
        windows = [[(i, 0, lengths[i]) for i in w] for w in best_fit_decreasing(lengths, size)]
        rows = []
        for w in filled(windows, size, waste):
            width = [len(ids[i]) // lengths[i] for i, _, _ in w]
            data = b"".join(ids[i][lo * b : hi * b] for (i, lo, hi), b in zip(w, width, strict=True))
            rows.append((2 * (block << 32 | len(rows)) + 1, data, [doc_ids[i] for i, _, _ in w], [starts[i] + lo for i, lo, _ in w], [hi - lo for _, lo, hi in w], [totals[i] for i, _, _ in w]))
        out = pa.table(_table(rows), COLUMNS)
        give_back()
        return out

    return run


def write_sequences(docs: DataFrame, tokenizer: str, path: str, size: int = SIZE, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Write the sequences of all rows of `docs` (doc_id, text) to `path`; `tokenizer`: path of a byte-level tokenizers file."""
    spark = docs.sparkSession
    with eager(spark):
        cut = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(frugal(_cut_up(tokenizer, size, end_id)), f"{SEQUENCES}, kind string")
        cut.write.partitionBy("kind").parquet(path)
        rests = spark.read.schema(f"{SEQUENCES}, kind string").parquet(path).where("kind = 'rest'").drop("kind")
        blocks = -(-(rests.agg(F.sum(F.get("lengths", F.lit(0)).cast("long"))).first()[0] or 0) // block_ids)
        if blocks:
            dealt = rests.withColumn("block", F.pmod(F.xxhash64("sequence_id"), F.lit(blocks)))
            dealt.groupBy("block").applyInArrow(_packed(size, size // WASTE), SEQUENCES).write.parquet(f"{path}/kind=packed")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        each = [b.column(c).flatten() for c in ("doc_ids", "starts", "lengths", "doc_tokens")]
        sequence, offset, crc = [], [], []
        for s, raw, lengths in zip(b.column("sequence_id").to_pylist(), b.column("ids").to_pylist(), b.column("lengths").to_pylist(), strict=True):
            wide = np.frombuffer(raw, f"<u{len(raw) // sum(lengths)}").astype("<u4")
            at = 0
            for n in lengths:
                sequence.append(s)
                offset.append(at)
                crc.append(zlib.crc32(wide[at : at + n]))
                at += n
        arrays = [each[0], each[1], each[2].cast(pa.int64()), pa.array(crc, pa.int64()), each[3], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def read_pieces(spark, path: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece in the sequences at `path`."""
    rows = spark.read.schema(f"{SEQUENCES}, kind string").parquet(path).where("kind <> 'rest'").drop("kind")
    return rows.mapInArrow(frugal(_pieces), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def packing(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Write `docs` as sequences to `path`, where they stay, and return their pieces as read back; without a path they lie
    in the shared folder until the driver ends."""
    path = path or new_path(docs.sparkSession, "sequences")
    write_sequences(docs, tokenizer, path, size, end_id)
    return read_pieces(docs.sparkSession, path)
