"""Vectorised work on the UTF-8 bytes of Arrow string columns: word borders, word hashes, n-gram hashes.

A word is a run of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after A-Z are lower-cased. In UTF-8 that is a run of
digits, ASCII letters and bytes from 0x80 on, so no text needs to be decoded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[65:91] = IS_WORD[97:123] = IS_WORD[128:] = True

_RNG = np.random.Generator(np.random.PCG64(20240607))
RAW_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
GRAM_CODE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)

_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept, and grown when a longer text comes."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        grown = np.full(max(n, 1 << 16), base, np.uint64)
        grown[0] = 1
        _powers[int(base)] = have = np.multiply.accumulate(grown)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Strings of more bytes are hashed by hashlib, one by one.
LONG = 256
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(8)] + [2**64 - 1], np.uint64)
_STEP = np.arange(8)


def string_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], from 8 bytes at a time, each mixed with what came before; no sum or polynomial,
    whose collisions could be spelled out. Equal hashes aren't proof of equal strings."""
    size = ends - starts
    out = mix(size.astype(np.uint64) * BASE)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    live = np.flatnonzero(size <= LONG)
    at = starts[live]
    while len(live):
        left = np.minimum(ends[live] - at, 8)
        block = padded[at[:, None] + _STEP].view("<u8").ravel() & _KEEP[left]
        out[live] = mix((out[live] ^ block) * BASE + INVERSE)
        at = at + 8
        more = at < ends[live]
        live, at = live[more], at[more]
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column (null: empty) and each row's offsets into them."""
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of `batch` with about `most` bytes of `column` each; a longer text comes alone."""
    if not batch.num_rows:
        return
    lengths = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = lengths[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(lengths, before + most, "right")))
        yield batch.slice(at, end - at)
        at = end


@dataclass
class Words:
    data: np.ndarray  # lower-cased bytes of all rows
    starts: np.ndarray  # byte position of each word
    ends: np.ndarray
    hashes: np.ndarray  # uint64
    rows: np.ndarray  # offsets of the rows' words, one more than rows


def words(column: pa.Array) -> Words:
    data, offsets = raw(column)
    n = len(data)
    inside = IS_WORD[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < n)]
    begin[edges] = inside[edges]
    starts = np.flatnonzero(begin)
    if not len(starts):
        return Words(data, starts, starts, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    stop = np.zeros(n + 1, bool)
    stop[1:n] = inside[:-1] & ~inside[1:]
    stop[n] = inside[n - 1]
    stop[edges] |= inside[edges - 1]
    ends = np.flatnonzero(stop)
    lowered = LOWER[data]
    return Words(lowered, starts, ends, string_hashes(lowered, starts, ends), np.searchsorted(starts, offsets))


def joined(w: Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All rows' words, one blank between those of a row, and each word's borders in that string. A blank is no byte of a
    word, so different runs of words are different strings."""
    keep = np.zeros(len(w.data), np.int8)
    # +1 at a word's start, -1 at its end: the bytes inside; the byte before a word that isn't its row's first becomes the blank
    keep[w.starts] += 1
    keep[w.ends[w.ends < len(w.data)]] -= 1
    keep = np.cumsum(keep, dtype=np.int8).astype(bool)
    first = np.zeros(len(w.starts), bool)
    first[w.rows[:-1][np.diff(w.rows) > 0]] = True
    blank = w.starts[~first] - 1
    data = w.data.copy()
    data[blank] = 32
    keep[blank] = True
    at = np.cumsum(keep)
    return data[keep].tobytes(), at[w.starts] - 1, at[w.ends - 1]


def sequence_digests(w: Words) -> list[bytes | None]:
    """SHA-256 of each row's words, as `joined` spells them; None without words."""
    out: list[bytes | None] = [None] * (len(w.rows) - 1)
    spelled, lo, hi = joined(w)
    rows = np.flatnonzero(np.diff(w.rows) > 0)
    for i, s, e in zip(rows.tolist(), lo[w.rows[rows]].tolist(), hi[w.rows[rows + 1] - 1].tolist(), strict=True):
        out[i] = hashlib.sha256(spelled[s:e]).digest()
    return out


def grams(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's runs of k words, and offsets; a row of fewer words, but not none, has one gram of all its words."""
    count = np.diff(w.rows)
    total = len(w.hashes)
    sums = np.zeros(total, np.uint64)
    row = np.repeat(np.arange(len(count)), count)
    for j in range(k):
        if j == 0:
            sums += w.hashes * GRAM_CODE[0]
            continue
        if total <= j:
            break
        same = row[j:] == row[:-j]
        sums[:-j] += np.where(same, w.hashes[j:] * GRAM_CODE[j], np.uint64(0))
    position = np.arange(total) - np.repeat(w.rows[:-1], count)
    keep = position <= np.maximum(np.repeat(count, count) - k, 0)
    each = np.where(count > 0, np.maximum(count - k + 1, 1), 0)
    return mix(sums[keep]), np.concatenate([[0], np.cumsum(each)])


def known_words(column: pa.Array, known: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of words of each text, and for each known word in a text: the text, the word's place in `known`, how often).

    Words are told apart by their bytes; each distinct one of the column is looked up once.
    """
    data, offsets = raw(column)
    solid = IS_WORD[data]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    edges = offsets[:-1][np.diff(offsets) > 0]
    begin[edges] = solid[edges]
    starts = np.flatnonzero(begin)
    each = np.diff(np.searchsorted(starts, offsets))
    if not len(starts):
        return each, *(np.zeros(0, np.int64) for _ in range(3))
    at = np.append(np.cumsum(solid)[starts] - 1, np.count_nonzero(solid)).astype(np.int64)
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(LOWER[data[solid]])]).dictionary_encode()
    place = pc.fill_null(pc.index_in(coded.dictionary, value_set=known), -1).to_numpy().astype(np.int64)
    word = place[coded.indices.to_numpy()]
    hit = word >= 0
    pairs, times = np.unique(np.repeat(np.arange(len(each)), each)[hit] * len(known) + word[hit], return_counts=True)
    return each, pairs // max(len(known), 1), pairs % max(len(known), 1), times
