"""Re-Pair grammar compression of token-ID shards, with random access.

`compress` replaces frequent pairs of adjacent symbols by nonterminals, round after round, until no pair stands LEAST
times. A round counts every pair exactly and ranks the frequent ones; where occurrences overlap, the more frequent pair
takes its place, and of a run of one symbol every second occurrence is taken, from the left. A pair that loses most of
its places to others gets no rule yet and is counted again in the next round; the most frequent pair always gets one, so
every round shortens the sequence. A pair that holds the end id is never replaced, so a document's end stays a symbol of
its own and every document can be decoded alone. That symbol, the first after the vocabulary, stands for the end id,
which may be an ordinary id elsewhere in a document. Rules aren't limited in number: symbols are stored with as many bits
as the largest needs.

`Shard.ids` reads any range of ids: the documents' first ids lead to its symbols, and while nonterminals are left, what
lies outside of the range by its expansion length is dropped and the rest is expanded by one level.

Layout of a shard, little-endian but for the bit fields, which are big-endian and padded to whole bytes:
    magic b"RPG2", uint32 vocabulary, uint32 end id, uint32 rules, uint32 documents, uint32 bits of a symbol, uint64 symbols
    rules     x 2 symbols: left and right side
    rules     x uint32: expansion length in ids
    documents x uint64: first symbol of each document
    documents x uint64: first id of each document within the shard
    symbols
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_HEAD = struct.Struct("<4sIIIIIQ")
MAGIC = b"RPG2"
LEAST = 8
#: Times that a round looks for places next to those taken already.
LOOKS = 3


#: Pairs are counted in 2**SLOTS slots first.
SLOTS = 20


def pair_counts(seq: np.ndarray, may: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(positions, the number of each one's pair, the pairs as left << 32 | right, their counts) of all pairs at the
    positions `may` that stand `least` times there, and of some others.

    No pair stands more often than all pairs of its slot together, so those of rare slots are left out before the exact count.
    """
    at = np.flatnonzero(may)
    code = seq[at].astype(np.uint64) << np.uint64(32) | seq[at + 1]
    slot = (code * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOTS)).astype(np.int64)
    busy = (np.bincount(slot, minlength=1 << SLOTS) >= least)[slot]
    at = at[busy]
    coded = pa.array(code[busy]).dictionary_encode()
    which, pairs = coded.indices.to_numpy(), coded.dictionary.to_numpy()
    return at, which, pairs, np.bincount(which, minlength=len(pairs))


def _taken(rank: np.ndarray, none: int) -> np.ndarray:
    """Positions of the pairs to replace: none overlap, and better (lower) ranks go first."""
    rank, out = np.concatenate([[none], rank, [none]]), []
    for _ in range(LOOKS):
        live = np.flatnonzero(rank != none)
        if not len(live):
            break
        # runs of neighbours of one rank are overlapping occurrences of one pair
        new = np.ones(len(live), bool)
        new[1:] = (live[1:] != live[:-1] + 1) | (rank[live[1:]] != rank[live[:-1]])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(live)) - 1
        best = (rank[live[first] - 1] > rank[live[first]]) & (rank[live[last] + 1] > rank[live[last]])
        run = np.cumsum(new) - 1
        chosen = live[best[run] & ((np.arange(len(live)) - first[run]) % 2 == 0)]
        out.append(chosen - 1)
        for near in (-1, 0, 1):
            rank[chosen + near] = none
    return np.sort(np.concatenate(out)) if out else np.zeros(0, np.int64)


def _round(seq: np.ndarray, may: np.ndarray, end: int, first: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One round: the shorter sequence, its positions that may hold a frequent pair, and the new rules (left << 32 | right,
    for nonterminals first, first + 1 ...). A pair that isn't frequent can only become so by a new symbol."""
    nothing = np.zeros(0, np.uint64)
    at, which, pairs, counts = pair_counts(seq, may, least)
    often = np.flatnonzero(counts >= least)
    if not len(often):
        return seq, may, nothing
    often = often[np.lexsort((pairs[often], -counts[often]))]
    place = np.full(len(pairs), len(often), np.int32)
    place[often] = np.arange(len(often), dtype=np.int32)
    rank = np.full(len(seq) - 1, len(often), np.int32)
    rank[at] = place[which]
    chosen = _taken(rank, len(often))
    used = np.bincount(rank[chosen], minlength=len(often))
    ruled = np.flatnonzero(used >= max(least // 2, 1))
    symbol = np.full(len(often), -1, np.int64)
    symbol[ruled] = first + np.arange(len(ruled))
    chosen = chosen[symbol[rank[chosen]] >= 0]
    out = seq.copy()
    out[chosen] = symbol[rank[chosen]]
    keep = np.ones(len(seq), bool)
    keep[chosen + 1] = False
    frequent = np.append(rank < len(often), False)[keep]
    out = out[keep]
    new = out >= first
    inner = out != end
    return out, (frequent[:-1] | new[:-1] | new[1:]) & inner[:-1] & inner[1:], pairs[often[ruled]]


def packed(values: np.ndarray, bits: int) -> bytes:
    """The lowest `bits` bits of each value, one after another."""
    spread = np.unpackbits(values.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)[:, 32 - bits :]
    return np.packbits(spread.ravel()).tobytes()


def unpacked(data: np.ndarray, bits: int, first: int, last: int) -> np.ndarray:
    """Values first .. last - 1 of `packed` ones."""
    n, lo = last - first, first * bits
    if n <= 0:
        return np.zeros(0, np.int64)
    flat = np.unpackbits(data[lo // 8 : -(-last * bits // 8)])[lo % 8 : lo % 8 + n * bits].reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, 32 - bits :] = flat
    return np.packbits(wide, axis=1).view(">u4").ravel().astype(np.int64)


def compress(ids: np.ndarray, sizes: np.ndarray, vocabulary: int, end_id: int, least: int = LEAST) -> bytes:
    """A shard's bytes for documents of `sizes` ids each, every one closed by `end_id`."""
    vocabulary = max(vocabulary, int(ids.max()) + 1 if len(ids) else 0)
    seq, rules = ids.astype(np.uint32), []
    seq[np.cumsum(sizes) - 1] = vocabulary
    total = vocabulary + 1
    inner = seq != vocabulary
    may = inner[:-1] & inner[1:]
    while True:
        seq, may, pairs = _round(seq, may, vocabulary, total, least)
        if not len(pairs):
            break
        rules.append(pairs)
        total += len(pairs)
    rules = np.concatenate(rules) if rules else np.zeros(0, np.uint64)
    left, right = (rules >> np.uint64(32)).astype(np.int64), (rules & np.uint64(0xFFFFFFFF)).astype(np.int64)
    lengths = _lengths(left, right, vocabulary + 1)
    ends = np.flatnonzero(seq == vocabulary)
    symbol_at = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else np.zeros(0, np.int64)
    id_at = np.cumsum(sizes) - sizes
    bits = max(1, int(total - 1).bit_length())
    head = _HEAD.pack(MAGIC, vocabulary, end_id, len(rules), len(ends), bits, len(seq))
    sides = packed(np.stack([left, right], 1).ravel(), bits)
    return b"".join([head, sides, lengths.astype("<u4").tobytes(), symbol_at.astype("<u8").tobytes(), id_at.astype("<u8").tobytes(), packed(seq, bits)])


def _levels(left: np.ndarray, right: np.ndarray, first: int):
    """Slices of the rules that refer to ids and rules before their slice only."""
    newest = np.maximum(left, right) - first
    at = 0
    while at < len(left):
        later = np.flatnonzero(newest[at:] >= at)
        end = at + int(later[0]) if len(later) else len(left)
        yield at, end
        at = end


def _lengths(left: np.ndarray, right: np.ndarray, first: int) -> np.ndarray:
    known = np.ones(first + len(left), np.int64)
    for at, end in _levels(left, right, first):
        known[first + at : first + end] = known[left[at:end]] + known[right[at:end]]
    return known[first:]


@dataclass
class Shard:
    vocabulary: int
    end_id: int
    left: np.ndarray
    right: np.ndarray
    lengths: np.ndarray
    symbol_at: np.ndarray
    id_at: np.ndarray
    bits: int
    n_symbols: int
    data: np.ndarray  # packed symbols

    @classmethod
    def read(cls, data: bytes) -> Shard:
        magic, vocabulary, end_id, rules, documents, bits, symbols = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        raw, at = np.frombuffer(data, np.uint8), _HEAD.size
        sides = unpacked(raw[at:], bits, 0, 2 * rules).reshape(-1, 2)
        at += -(-2 * rules * bits // 8)
        lengths = np.frombuffer(data, "<u4", rules, at).astype(np.int64)
        at += 4 * rules
        symbol_at, id_at = (np.frombuffer(data, "<u8", documents, at + k * 8 * documents).astype(np.int64) for k in (0, 1))
        return cls(vocabulary, end_id, sides[:, 0], sides[:, 1], lengths, symbol_at, id_at, bits, symbols, raw[at + 16 * documents :])

    def symbols(self, first: int, last: int) -> np.ndarray:
        return unpacked(self.data, self.bits, first, last)

    def __len__(self) -> int:
        """Number of ids."""
        size = self.sizes(self.symbols(int(self.symbol_at[-1]), self.n_symbols)) if len(self.id_at) else np.zeros(1, np.int64)
        return int(self.id_at[-1] + size.sum()) if len(self.id_at) else 0

    def sizes(self, symbols: np.ndarray) -> np.ndarray:
        """Expansion lengths."""
        rule = symbols - self.vocabulary - 1
        return np.where(rule >= 0, self.lengths[np.maximum(rule, 0)] if len(self.lengths) else 1, 1)

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids first .. last - 1 of the shard, expanding only nonterminals that reach into that range."""
        if last <= first or not len(self.id_at):
            return np.zeros(0, np.uint32)
        a, b = (int(np.searchsorted(self.id_at, x, "right")) - 1 for x in (first, last - 1))
        part = self.symbols(int(self.symbol_at[a]), int(self.symbol_at[b + 1]) if b + 1 < len(self.symbol_at) else self.n_symbols)
        start = int(self.id_at[a])
        while True:
            size = self.sizes(part)
            end = start + np.cumsum(size)
            keep = np.flatnonzero((end > first) & (end - size < last))
            start = int(end[keep[0]] - size[keep[0]]) if len(keep) else start
            part = part[keep]
            rule = part - self.vocabulary - 1
            if not (rule >= 0).any():
                break
            wide = np.repeat(part, 1 + (rule >= 0))
            at = (np.cumsum(1 + (rule >= 0)) - 1)[rule >= 0]
            wide[at - 1], wide[at] = self.left[rule[rule >= 0]], self.right[rule[rule >= 0]]
            part = wide
        return np.where(part == self.vocabulary, self.end_id, part).astype(np.uint32)

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.id_at[i]), int(self.id_at[i + 1]) if i + 1 < len(self.id_at) else len(self))

    def decode(self) -> np.ndarray:
        """All ids; every rule is expanded once."""
        first = self.vocabulary + 1
        size = np.concatenate([np.ones(first, np.int64), self.lengths])
        at = np.concatenate([[0], np.cumsum(size)])
        flat = np.zeros(at[-1], np.uint32)
        flat[:first] = np.arange(first)
        flat[self.vocabulary] = self.end_id
        for lo, hi in _levels(self.left, self.right, first):
            both = np.stack([self.left[lo:hi], self.right[lo:hi]], 1).ravel()
            flat[at[first + lo] : at[first + hi]] = _gather(flat, at[both], size[both])
        part = self.symbols(0, self.n_symbols)
        return _gather(flat, at[part], size[part])


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[start[i] : start[i] + size[i]] for all i, joined."""
    if not len(start):
        return np.zeros(0, flat.dtype)
    shift = np.repeat(start - (np.cumsum(size) - size), size)
    return flat[shift + np.arange(len(shift))]
