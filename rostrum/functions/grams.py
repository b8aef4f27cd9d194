"""Hashes of tokens and of their runs over whole Arrow batches, as numpy works on the UTF-8 bytes.

A token is a run of `[a-z0-9']` of a lower-cased text (`text.tokens`), so no byte of another character belongs to one. Hashes have 64
bits and mix each part with what came before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_IN_TOKEN = np.zeros(256, bool)
_IN_TOKEN[[*b"abcdefghijklmnopqrstuvwxyz0123456789'"]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(8)] + [2**64 - 1], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _token_spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, where its tokens start and end, and how many each text has."""
    column = column.cast(pa.large_string())
    borders = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[borders[0] : borders[-1]]
    borders = borders - borders[0]
    inside = _IN_TOKEN[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    # texts lie end to end: a token neither begins before its text nor goes on into the next
    at = borders[1:-1][(borders[1:-1] > 0) & (borders[1:-1] < len(data))]
    first[at] = inside[at]
    last[at - 1] = inside[at - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return data, starts, ends, np.diff(np.searchsorted(starts, borders))


def _token_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    size = ends - starts
    out = _mix(size.astype(np.uint64) * _BASE)
    if not len(out):
        return out
    eight = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    live = np.arange(len(size))
    for done in range(0, int(size.max()), 8):
        live = live[size[live] > done] if done else live
        word = eight[starts[live] + done].view(np.uint64).ravel() & _KEEP[np.minimum(size[live] - done, 8)]
        out[live] = _mix((out[live] ^ word) * _BASE + np.uint64(done + 1))
    return out


def _gram_hashes(token: np.ndarray, sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's different k-grams, in order of texts, and how many each text has; fewer tokens than k are one gram."""
    grams = np.where(sizes >= k, sizes - k + 1, np.minimum(sizes, 1))
    row = np.repeat(np.arange(len(sizes)), grams)
    at = (np.cumsum(sizes) - sizes - np.cumsum(grams) + grams)[row] + np.arange(len(row))
    long = np.minimum(sizes, k)[row]
    h = _mix(long.astype(np.uint64))
    for i in range(k):
        part = token[np.minimum(at + i, max(len(token) - 1, 0))] if len(token) else h
        h = np.where(long > i, _mix(h * _BASE + part), h)
    own = _mix(h + _mix(row.astype(np.uint64) * _BASE))
    order = np.argsort(own)
    again = order[1:][own[order[1:]] == own[order[:-1]]]
    keep = np.ones(len(h), bool)
    keep[again] = False
    return h[keep].view(np.int64), np.bincount(row[keep], minlength=len(sizes))


def hashed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The other columns with exact_hash in place of lower_text: the first 16 hex digits of the SHA-256 of the tokens, joined by spaces."""
    for batch in batches:
        data, starts, ends, sizes = _token_spans(batch.column("lower_text"))
        # each token with a space after it
        length = ends - starts + 1
        to = np.concatenate([[0], np.cumsum(length)])
        flat = np.full(to[-1], 32, np.uint8)
        filled = np.ones(len(flat), bool)
        filled[to[1:] - 1] = False
        flat[filled] = data[_IN_TOKEN[data]]
        flat = flat.tobytes()
        upto = to[np.concatenate([[0], np.cumsum(sizes)])]
        digests = [hashlib.sha256(flat[a : max(a, b - 1)]).hexdigest()[:16] for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
        yield _replaced(batch, {"exact_hash": pa.array(digests, pa.string())})


def hashed_shingles(k: int, part: int = 0, parts: int = 1):
    """The other columns with n and s in place of lower_text: how many different k-grams of tokens a text has, and the hashes of those that
    are `part` of so many `parts`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts, ends, sizes = _token_spans(batch.column("lower_text"))
            grams, n = _gram_hashes(_token_hashes(data, starts, ends), sizes, k)
            own = grams.view(np.uint64) % np.uint64(parts) == part
            kept = np.bincount(np.repeat(np.arange(len(n)), n)[own], minlength=len(n))
            at = pa.array(np.concatenate([[0], np.cumsum(kept)]), pa.int32())
            yield _replaced(batch, {"n": pa.array(n, pa.int32()), "s": pa.ListArray.from_arrays(at, pa.array(grams[own]))})

    return run


def _replaced(batch: pa.RecordBatch, more: dict[str, pa.Array]) -> pa.RecordBatch:
    kept = [c for c in batch.schema.names if c != "lower_text"]
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *more.values()], [*kept, *more])
