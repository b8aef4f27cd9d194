"""Suffix-array deduplication of repeated byte strings, by deep-shallow suffix sorting.

A byte goes if it lies in a `length`-byte string that also starts earlier: in a smaller doc_id, or earlier in the document.

0. A document that repeats an earlier one whole (by its SHA-256) is covered whole; the rest of the work has one of each.
1. Anchors: in every window of `length` bytes the smallest hash of its GRAM-byte strings (the leftmost of equals) is its
   anchor. Equal windows have equal anchors at the same place, so only windows of anchors that occur twice or more
   can repeat. An anchor's windows start in one interval.
2. Anchors are counted by their hash; those that occur once go. The rest fetch the bytes that their windows span.
3. The strings of one anchor hash are sorted together, first the whole spans, then the windows (suffixes) of the distinct
   ones: multikey quicksort on 8-byte words down to SHALLOW
   bytes, then blind tries on the groups that still share a prefix. Neighbours that agree in `length` bytes are one string; its
   first occurrence stays, the others' bytes are covered. Hot anchors (more than HOT occurrences) are sorted in blocks
   first; each block passes on only the windows that it doesn't cover, each as a row of its own, and those meet by a hash
   of the window: equal ones come together, an anchor's different ones don't.
4. Covered runs return to their documents, which are rewritten.

Null or empty texts have no bytes. Documents stand in order of doc_id, null first, then of a hash of the text; of fully
repeated rows, one comes first. Further columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.llm import wordbytes as wb
from rostrum.llm.common import cut, discard, frugal, small, whole_groups

LENGTH = 100
GRAM = 32
SHALLOW = 16
HOT = 8_000
#: Bytes of one row whose anchors are found at once; their places need fewer than PLACE_BITS bits.
STRETCH = 1 << 22
PLACE_BITS = np.uint64(24)


def byte_words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, as a big-endian number; zeros beyond the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.zeros(len(data), np.uint64)
    for j in range(8):
        out |= padded[j : j + len(data)].astype(np.uint64) << np.uint64(56 - 8 * j)
    return out


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Group numbers of sorted keys."""
    change = np.zeros(len(keys[0]), bool)
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.cumsum(change)


def deep_shallow_sort(words: np.ndarray, starts: np.ndarray, group: np.ndarray, length: int | np.ndarray = LENGTH, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at `starts` within their `group`, by their first `length` bytes, and numbers of equal strings.

    `words` is `byte_words` of the text; bytes from `length` on (one number, or one for each suffix, the same within a
    group and `shallow` at least) are not compared. The order is stable.
    Returns (order, number): suffixes order[i] and order[i + 1] are equal strings of one group iff number[i] == number[i + 1].
    """
    order = np.argsort(group, kind="stable")
    rank = _groups(group[order]) if len(order) else np.zeros(0, np.int64)
    length = np.broadcast_to(np.asarray(length, np.int64), len(starts))
    # shallow: multikey quicksort, a word of 8 bytes at a time, on the groups that are not single yet
    for depth in range(0, shallow, 8):
        live = _several(rank)
        if not len(live):
            break
        key = words[starts[order[live]] + depth]
        inner = np.lexsort((key, rank[live]))
        order[live] = order[live][inner]
        order, rank = _refined(order, rank, live, key[inner])
    # deep: one blind trie for each group that shares its first bytes. The first member is the path; every other one
    # leaves it at the first differing byte, left or right, and those that leave at one branch are the next group.
    pending = _several(rank)
    done = np.zeros(len(order), bool)
    while len(pending):
        r = rank[pending]
        new = np.ones(len(pending), bool)
        new[1:] = r[1:] != r[:-1]
        leader = order[pending][new][np.cumsum(new) - 1]
        size = length[order[pending]]
        shared, less, byte = _branch(words, starts[order[pending]], starts[leader], size)
        # in the order of the strings: left branches by depth, the path itself, right branches by falling depth
        place = np.where(less | (shared == size), shared, 2 * size + 1 - shared)
        key = place << 8 | byte
        inner = np.lexsort((key, r))
        order[pending] = order[pending][inner]
        order, rank = _refined(order, rank, pending, key[inner])
        done[pending] = (place == size)[inner]
        pending = _several(rank)
        pending = pending[~done[pending]]
    return order, rank


def _several(rank: np.ndarray) -> np.ndarray:
    """Positions whose rank is shared with a neighbour."""
    same = rank[1:] == rank[:-1]
    out = np.zeros(len(rank), bool)
    out[1:] |= same
    out[:-1] |= same
    return np.flatnonzero(out)


def _refined(order: np.ndarray, rank: np.ndarray, live: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks after the groups at `live` were split by `key`, which is sorted within them."""
    change = np.zeros(len(rank), bool)
    change[1:] = rank[1:] != rank[:-1]
    split = np.zeros(len(live), bool)
    split[1:] = (key[1:] != key[:-1]) & (rank[live][1:] == rank[live][:-1])
    change[live[split]] = True
    return order, np.cumsum(change)


def _branch(words: np.ndarray, at: np.ndarray, path: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many bytes agree with the path, whether the suffix is less there, and its byte at the branch."""
    n = len(at)
    shared = length.copy()
    less = np.zeros(n, bool)
    byte = np.zeros(n, np.int64)
    open_ = np.flatnonzero(at != path)
    for depth in range(0, int(length.max()) if n else 0, 8):
        open_ = open_[length[open_] > depth]
        if not len(open_):
            break
        a, b = words[at[open_] + depth], words[path[open_] + depth]
        over = np.maximum(depth + 8 - length[open_], 0)
        if over.any():
            drop = (8 * over).astype(np.uint64)
            a, b = a >> drop << drop, b >> drop << drop
        differ = np.flatnonzero(a != b)
        if len(differ):
            x, y, i = a[differ], b[differ], open_[differ]
            z = x ^ y
            lead = np.zeros(len(z), np.int64)
            for bits in (32, 16, 8):
                small = z >> np.uint64(64 - bits) == 0
                lead += np.where(small, bits // 8, 0)
                z = np.where(small, z << np.uint64(bits), z)
            shared[i] = depth + lead
            less[i] = x < y
            byte[i] = (x >> (np.uint64(56) - 8 * lead.astype(np.uint64))) & np.uint64(255)
            open_ = np.delete(open_, differ)
    return shared, less, byte


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(hash, row, place, first, last): each anchor, its place in its row and the first and last window start it stands for.

    Long rows are taken in stretches, each with the bytes that its last windows reach into; an anchor at the border of two
    stretches comes twice, with the windows that start in either.
    """
    if len(data) <= STRETCH + length:
        return _anchors(data, offsets, length, gram)
    found = []
    for i, (begin, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        for s in range(begin, end - length + 1, STRETCH):
            part = data[s : min(s + STRETCH + length - 1, end)]
            h, row, place, first, last = _anchors(part, np.array([0, len(part)]), length, gram)
            found.append((h, row + i, place + s - begin, first + s - begin, last + s - begin))
    return tuple(map(np.concatenate, zip(*found, strict=True))) if found else _anchors(data[:0], np.zeros(1, np.int64), length, gram)


def _anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    n, wide = len(data), length - gram + 1
    nothing = tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64, np.int64))
    if n < length or not (np.diff(offsets) >= length).any():
        return nothing
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(wb.RAW_CODE[data] * wb.powers(wb.BASE, n), out=sums[1:])
    h = wb.mix((sums[gram:] - sums[:-gram]) * wb.powers(wb.INVERSE, n)[: n - gram + 1])
    room = len(h)
    # the hash's upper bits above, the place below: the minimum is the leftmost of the smallest. As many bits of the hash
    # count in every stretch, so that equal windows have their anchors at one place, whatever stands around them
    packed = (h >> PLACE_BITS << PLACE_BITS) | np.arange(room, dtype=np.uint64)
    blocks = -(-room // wide)
    grid = np.full(blocks * wide, np.uint64(2**64 - 1))
    grid[:room] = packed
    ahead = np.minimum.accumulate(grid.reshape(blocks, wide), axis=1).ravel()
    behind = np.minimum.accumulate(grid.reshape(blocks, wide)[:, ::-1], axis=1)[:, ::-1].ravel()
    last_start = n - length
    low = np.minimum(behind[: last_start + 1], ahead[wide - 1 : wide + last_start])
    place = (low & np.uint64((1 << int(PLACE_BITS)) - 1)).astype(np.int64)
    row_end = np.repeat(offsets[1:], np.diff(offsets))
    starts = np.flatnonzero(np.arange(last_start + 1) + length <= row_end[: last_start + 1])
    if not len(starts):
        return nothing
    place = place[starts]
    new = np.ones(len(starts), bool)
    row = np.searchsorted(offsets, starts, "right") - 1
    new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    r = row[first]
    base = offsets[r]
    return h[place[first]], r, place[first] - base, starts[first] - base, starts[last] - base


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in wb.pieces(batch, "text"):
            data, offsets = wb.raw(part.column("text"))
            h, row, place, first, last = anchors(data, offsets)
            if len(h):
                at = place << 14 | (place - first) << 7 | (place - last)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), part.column("id").take(pa.array(row)), pa.array(at)], ["h", "id", "at"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes from an anchor's first window start to its last window's end."""
    for batch in batches:
        for part in wb.pieces(batch, "text"):
            data, offsets = wb.raw(part.column("text"))
            at = part.column("anchors")
            flat = at.flatten()
            row = np.repeat(np.arange(part.num_rows), np.diff(at.offsets.to_numpy()))
            h, p, size = (flat.field(k) for k in ("h", "at", "size"))
            p = p.to_numpy(zero_copy_only=False)
            place = p >> 14
            lo = place - (p >> 7 & 127)
            hi = place - (p & 127) + LENGTH
            begin = offsets[row] + lo
            length = hi - lo
            bounds = np.concatenate([[0], np.cumsum(length)])
            index = np.arange(bounds[-1]) + np.repeat(begin - bounds[:-1], length)
            spans = pa.BinaryArray.from_buffers(pa.binary(), len(lo), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data[index])])
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [h, size, part.column("doc_id").take(take), part.column("tie").take(take), part.column("id").take(take), pa.array(place), pa.array(lo), spans],
                ["h", "size", "doc_id", "tie", "id", "place", "first", "bytes"],
            )


def _sorted_windows(hot: bool):
    """Covered runs (id, lo, hi) from rows sorted by h (and block), and, of hot anchors, the windows that aren't covered, one a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["h", "block"]):
            t = t.combine_chunks()
            for s, e in _runs_of(t):
                yield from windows(t.slice(s, e - s))

    def windows(t: pa.Table) -> Iterator[pa.RecordBatch]:
        data, offsets = wb.raw(t.column("bytes").combine_chunks() if isinstance(t.column("bytes"), pa.ChunkedArray) else t.column("bytes"))
        h, block, place, first, ids, size = (t.column(k).to_numpy() for k in ("h", "block", "place", "first", "id", "size"))
        before = _document_order(t)
        span = np.diff(offsets)
        words = byte_words(data)
        # whole contexts first: of equal ones all windows are equal, so only the first is taken apart
        by_place = np.lexsort((first, before))
        group = _number(h, block, place - first, span)
        order, rank = deep_shallow_sort(words, offsets[:-1][by_place], group[by_place], span[by_place])
        order = by_place[order]
        copies = order[np.flatnonzero(rank[1:] == rank[:-1]) + 1]
        single = np.ones(len(h), bool)
        single[copies] = False
        apart = np.flatnonzero(single)
        # an anchor left with one context has nothing to compare
        left = _number(h[apart], block[apart])
        apart = apart[np.bincount(left, minlength=1)[left] > 1] if len(apart) else apart
        count = span[apart] - LENGTH + 1
        row = np.repeat(apart, count)
        step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        starts = offsets[row] + step
        start = first[row] + step
        # windows of one anchor and one distance from it
        group = _number(h[row], block[row], place[row] - start)
        by_place = np.lexsort((start, before[row]))
        order, rank = deep_shallow_sort(words, starts[by_place], group[by_place])
        order = by_place[order]
        again = np.zeros(len(order), bool)
        again[1:] = rank[1:] == rank[:-1]
        covered = np.zeros(len(order), bool)
        covered[order[again]] = True
        # of each context: runs of covered window starts
        edge = np.ones(len(covered), bool)
        edge[1:] = (row[1:] != row[:-1]) | ~covered[:-1]
        lo = np.flatnonzero(covered & edge)
        tail = np.ones(len(covered), bool)
        tail[:-1] = (row[1:] != row[:-1]) | ~covered[1:]
        hi = np.flatnonzero(covered & tail)
        runs = [np.concatenate(x) for x in ((ids[row[lo]], ids[copies]), (start[lo], first[copies]), (start[hi] + LENGTH, first[copies] + span[copies]))]
        out = [*map(pa.array, runs), *(pa.nulls(len(runs[0]), k) for k in (*[pa.int64()] * 6, pa.binary()))]
        yield pa.RecordBatch.from_arrays(out, _WINDOW_NAMES)
        if hot:
            # what isn't a copy here may still be one of another block's
            alone = np.setdiff1d(np.flatnonzero(single), apart)
            count = span[alone] - LENGTH + 1
            step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            lone = np.repeat(alone, count)
            of = np.concatenate([row[~covered], lone])
            at = np.concatenate([starts[~covered], offsets[lone] + step])
            start = np.concatenate([start[~covered], first[lone] + step])
            keep = np.flatnonzero(size[of] > HOT)
            for i in range(0, len(keep), WINDOW_ROWS):
                part = keep[i : i + WINDOW_ROWS]
                spelled = np.lib.stride_tricks.sliding_window_view(data, LENGTH)[at[part]]
                k = t.take(pa.array(of[part])).combine_chunks()
                col = lambda c: k.column(c).chunk(0) if isinstance(k.column(c), pa.ChunkedArray) else k.column(c)  # noqa: B023, E731
                held = pa.BinaryArray.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(np.arange(0, LENGTH * len(part) + 1, LENGTH, np.int32)), pa.py_buffer(spelled.ravel())])
                out = [col("id"), *(pa.nulls(len(part), pa.int64()) for _ in range(2)), col("h"), col("size"), col("doc_id"), col("tie"), col("place"), pa.array(start[part]), held]
                yield pa.RecordBatch.from_arrays(out, _WINDOW_NAMES)

    return run


_WINDOW_NAMES = ["id", "lo", "hi", "h", "size", "doc_id", "tie", "place", "first", "bytes"]
_WINDOWS = "id long, lo long, hi long, h long, size long, doc_id long, tie long, place long, first long, bytes binary"
#: Up to this many ids of whole copies are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 400_000
#: About this many bytes of contexts are sorted together.
SORT_BYTES = 1 << 21
#: Windows of hot anchors in one batch.
WINDOW_ROWS = 20_000


def _number(*keys: np.ndarray) -> np.ndarray:
    """Group numbers of unsorted keys."""
    order = np.lexsort(keys)
    out = np.zeros(len(order), np.int64)
    out[order] = _groups(*(k[order] for k in keys)) if len(order) else 0
    return out


def _document_order(t: pa.Table) -> np.ndarray:
    doc = t.column("doc_id")
    known = np.array(doc.is_valid().to_pylist())
    value = doc.fill_null(0).to_numpy()
    order = np.lexsort((t.column("id").to_numpy(), t.column("tie").to_numpy(), value, known))
    out = np.zeros(len(order), np.int64)
    out[order] = _groups(*(x[order] for x in (t.column("id").to_numpy(), value, known)))
    return out


def _runs_of(t: pa.Table) -> Iterator[tuple[int, int]]:
    """Slices of whole groups, about SORT_BYTES each."""
    h, block = t.column("h").to_numpy(), t.column("block").to_numpy()
    change = np.ones(len(h), bool)
    change[1:] = (h[1:] != h[:-1]) | (block[1:] != block[:-1])
    starts = np.append(np.flatnonzero(change), len(h))
    size = np.concatenate([[0], np.cumsum(pc.binary_length(t.column("bytes")).to_numpy())])
    at = 0
    while at < len(starts) - 1:
        end = max(at + 1, int(np.searchsorted(size[starts], size[starts[at]] + SORT_BYTES, "right")) - 1)
        yield int(starts[at]), int(starts[end])
        at = end


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in wb.pieces(batch, "text"):
            data, offsets = wb.raw(part.column("text"))
            runs = part.column("runs")
            flat = runs.flatten()
            row = np.repeat(np.arange(part.num_rows), np.diff(runs.offsets.to_numpy()))
            change = np.zeros(len(data) + 1, np.int64)
            if len(row):
                lo, hi = (flat.field(k).to_numpy(zero_copy_only=False) + offsets[row] for k in ("lo", "hi"))
                np.add.at(change, lo, 1)
                np.add.at(change, hi, -1)
            gone = np.cumsum(change[:-1]) > 0
            edge = gone.copy()
            edge[1:] &= ~gone[:-1]
            inner = offsets[:-1][np.diff(offsets) > 0]
            edge[inner] = gone[inner]
            removed, spans = (np.concatenate([[0], np.cumsum(x)]) for x in (gone, edge))
            kept, keep = [], ~gone
            for i in range(part.num_rows):
                s, e = offsets[i], offsets[i + 1]
                kept.append(data[s:e][keep[s:e]].tobytes() if removed[e] > removed[s] else data[s:e].tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(removed[offsets[1:]] - removed[offsets[:-1]]),
                    pa.array(spans[offsets[1:]] - spans[offsets[:-1]]), pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array(kept, pa.binary()),
                ],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )


def whole_copies(rows: DataFrame) -> DataFrame:
    """id and n, the bytes, of documents of LENGTH bytes or more whose whole text an earlier document has; counted by the
    text's SHA-256, never grouped in memory."""
    keyed = rows.select("id", "doc_id", F.octet_length("text").alias("n"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("k")).where(F.col("n") >= LENGTH)
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "id")
    first = keyed.groupBy("k").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("of")).where("of > 1")
    return keyed.join(first.drop("of"), "k").where(F.col("id") != F.col("first.id")).select("id", "n")


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (binary) for each row of `docs` (doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    # numbers are written with their rows: numbered anew in each pass, they would shift with the splits of the files
    rows = cut(docs.select("doc_id", text).withColumn("id", F.monotonically_increasing_id()), "documents")
    copies = cut(whole_copies(rows), "copies")
    gone = small(copies.select("id"), BROADCAST_ROWS)
    found = cut(rows.join(gone, "id", "left_anti").select("id", "text").mapInArrow(frugal(_anchor_rows), "h long, id long, at long"), "anchors")
    # counts are summed before the shuffle, and a frequent anchor's partition of the join can be split
    often = cut(found.groupBy("h").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "often")
    by_row = cut(found.join(small(often, BROADCAST_ROWS), "h").groupBy("id").agg(F.collect_list(F.struct("h", "at", "size")).alias("anchors")), "repeated")
    discard(found)
    discard(often)
    parts = rows.join(by_row, "id").withColumn("tie", F.xxhash64("text")).select("id", "doc_id", "tie", "text", "anchors")
    contexts = parts.mapInArrow(frugal(_contexts), "h long, size long, doc_id long, tie long, id long, place long, first long, bytes binary")
    blocks = F.ceil(F.col("size") / HOT)
    contexts = contexts.withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("long"))
    once = cut(_in_groups(contexts).mapInArrow(frugal(_sorted_windows(True)), _WINDOWS), "windows")
    covered = once.where("lo is not null").select("id", "lo", "hi")
    hot = once.where("lo is null").withColumn("block", F.xxhash64("bytes", F.col("place") - F.col("first")))
    twice = _in_groups(hot).mapInArrow(frugal(_sorted_windows(False)), _WINDOWS).select("id", "lo", "hi")
    whole = copies.select("id", F.lit(0).cast("long").alias("lo"), F.col("n").cast("long").alias("hi"))
    runs = covered.unionByName(twice).unionByName(whole).groupBy("id").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    nothing = F.array().cast("array<struct<lo: bigint, hi: bigint>>")
    final = rows.join(runs, "id", "left").select("doc_id", "text", F.coalesce("runs", nothing).alias("runs"))
    return final.mapInArrow(frugal(_rewrite), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def _in_groups(contexts: DataFrame) -> DataFrame:
    return contexts.repartition("h", "block").sortWithinPartitions("h", "block")
