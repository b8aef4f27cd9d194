"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The symbols are words (A-Z lower-cased, runs of digits, letters and code points from U+0080). Patterns are all windows of
13 words of the benchmark items; an item of 1-12 words is one pattern. Patterns of like length share a table: `m` is
the shortest of them, a block is the last two words of a text's m words (one word where m is 1). SHIFT tells for each
block hash how far no pattern can end; a shift of 0 leads to the bucket of the patterns with that block hash, the
prefix hash and then the bytes themselves are compared. All texts of a batch are searched side by side.

Benchmark texts are taken in blocks of at most BLOCK_BYTES, and one block at a time is broadcast, as text; each worker
compiles it into arrays of, by reckoning, 25 bytes for each byte of text and keeps one block. A larger benchmark is searched for
block by block over all documents, each pass is written before the next begins, and the hits are merged for each row.

Nulls and empty texts have no words: as documents they are clean with n_words 0, as items they have no window. A null
doc_id is kept. Repeated document rows give repeated results; rows of one item_id are one item with all their windows, and
a null item_id is the item ''. Further columns are ignored. An empty benchmark leaves every document clean.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from rostrum.llm import wordbytes as wb
from rostrum.llm.common import cut, discard, frugal

WINDOW = 13
BLOCK_BYTES = 4 << 20
#: Shortest lengths of the pattern classes, each with a table of its own.
CLASSES = (1, 2, 4, 8, WINDOW)
LANE = 48


@dataclass
class Table:
    m: int
    block: int
    shift: np.ndarray  # by block hash, uint8
    keys: np.ndarray  # sorted block hashes of the patterns' m-word prefixes (their buckets)
    patterns: np.ndarray  # pattern number of each bucket entry
    prefix: np.ndarray  # hash of the first m words of each bucket entry


@dataclass
class Patterns:
    """Distinct windows: pattern p is spelled[lo[p] : hi[p]], has size[p] words and is of items[of[begin[p]] ...]."""

    spelled: bytes
    lo: np.ndarray
    hi: np.ndarray
    size: np.ndarray
    begin: np.ndarray
    of: np.ndarray
    items: list[str]
    tables: list[Table] = field(default_factory=list)

    def owners(self, p: int) -> list[str]:
        return [self.items[i] for i in self.of[self.begin[p] : self.begin[p + 1]].tolist()]


def block_hash(h: np.ndarray, ends: np.ndarray, block: int) -> np.ndarray:
    """Hash of the `block` words that end at `ends`."""
    return h[ends] if block == 1 else h[ends - 1] * wb.GRAM_CODE[1] + h[ends] * wb.GRAM_CODE[2]


def run_hash(h: np.ndarray, starts: np.ndarray, m: int) -> np.ndarray:
    total = np.zeros(len(starts), np.uint64)
    for j in range(m):
        total += h[starts + j] * wb.GRAM_CODE[8 + j]
    return total


def compile_patterns(items: list[tuple[str, str | None]], window: int = WINDOW, bits: int = 16) -> Patterns:
    """Shift tables and buckets for the windows of (item_id, text) pairs."""
    w = wb.words(pa.array([t or "" for _, t in items], pa.string()))
    spelled, lo, hi = wb.joined(w)
    names = sorted({i for i, _ in items})
    number = {x: n for n, x in enumerate(names)}
    count = np.diff(w.rows)
    size = np.minimum(window, count)
    each = np.where(size > 0, count - size + 1, 0)
    row = np.repeat(np.arange(len(count)), each)
    first = w.rows[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
    size, item = size[row], np.array([number[i] for i, _ in items], np.int64)[row]
    # equal windows are one pattern: those of equal hashes are neighbours, and their bytes are compared
    whole = np.zeros(len(first), np.uint64)
    for j in range(window):
        live = np.flatnonzero(size > j)
        whole[live] += w.hashes[first[live] + j] * wb.GRAM_CODE[8 + j]
    order = np.lexsort((item, whole, size))
    first, size, item, whole = first[order], size[order], item[order], whole[order]
    new = np.ones(len(first), bool)
    for i in np.flatnonzero((whole[1:] == whole[:-1]) & (size[1:] == size[:-1])) + 1:
        a, b = first[i - 1], first[i]
        new[i] = spelled[lo[a] : hi[a + size[i] - 1]] != spelled[lo[b] : hi[b + size[i] - 1]]
    begin = np.append(np.flatnonzero(new), len(new))
    first, size = first[new], size[new].astype(np.int64)
    out = Patterns(spelled, lo[first], hi[first + size - 1], size, begin, item, names)
    for low, high in zip(CLASSES, (*CLASSES[1:], window + 1), strict=True):
        chosen = np.flatnonzero((low <= size) & (size < high))
        if not len(chosen):
            continue
        m = int(size[chosen].min())
        block = min(2, m)
        slots = 1 << max(bits, int(np.ceil(np.log2(4 * m * len(chosen)))))
        begins = first[chosen]
        shift = np.full(slots, m - block + 1, np.uint8)
        for end in range(block - 1, m):
            h = wb.mix(block_hash(w.hashes, begins + end, block))
            np.minimum.at(shift, (h & np.uint64(slots - 1)).astype(np.int64), m - 1 - end)
        order = np.argsort(h, kind="stable")  # of the last block
        out.tables.append(Table(m, block, shift, h[order], chosen[order], run_hash(w.hashes, begins, m)[order]))
    return out


def search(w: wb.Words, found: Patterns) -> list[tuple[int, int, int]]:
    """(row, first word, pattern) of every occurrence of every pattern."""
    out = []
    count = np.diff(w.rows)
    own = None
    for t in found.tables:
        # lanes of LANE positions each, so that a long text is searched side by side as well
        room = count - t.m + 1
        lanes = np.where(room > 0, -(-room // LANE), 0)
        row = np.repeat(np.arange(len(count)), lanes)
        within = np.arange(len(row)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = w.rows[:-1][row] + within * LANE + t.m - 1
        stop = np.minimum(at + LANE, w.rows[1:][row])
        mask = np.uint64(len(t.shift) - 1)
        while len(at):
            h = wb.mix(block_hash(w.hashes, at, t.block))
            step = t.shift[(h & mask).astype(np.int64)].astype(np.int64)
            zero = np.flatnonzero(step == 0)
            if len(zero):
                lo = np.searchsorted(t.keys, h[zero], "left")
                hi = np.searchsorted(t.keys, h[zero], "right")
                zero, lo, hi = zero[hi > lo], lo[hi > lo], hi[hi > lo]
                if len(zero):
                    each = hi - lo
                    which = np.repeat(np.arange(len(zero)), each)
                    entry = np.arange(len(which)) - np.repeat(np.cumsum(each) - each, each) + np.repeat(lo, each)
                    start = at[zero][which] - (t.m - 1)
                    r, p = row[zero][which], t.patterns[entry]
                    same = (run_hash(w.hashes, start, t.m) == t.prefix[entry]) & (start + found.size[p] <= w.rows[r + 1])
                    start, r, p = start[same], r[same], p[same]
                    if len(p):
                        own = own or wb.joined(w)
                        borders = zip(own[1][start].tolist(), own[2][start + found.size[p] - 1].tolist(), found.lo[p].tolist(), found.hi[p].tolist(), strict=True)
                        equal = [own[0][a:b] == found.spelled[c:d] for a, b, c, d in borders]
                        out += [x for x, yes in zip(zip(r.tolist(), (start - w.rows[r]).tolist(), p.tolist(), strict=True), equal, strict=True) if yes]
            at = at + np.maximum(step, 1)
            live = at < stop
            at, stop, row = at[live], stop[live], row[live]
    return out


_kept: dict[str, Patterns] = {}


def _compiled(key: str, block: list[tuple[str, str | None]]) -> Patterns:
    """The block's patterns; a worker keeps those of one block."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = compile_patterns(block)
    return _kept[key]


def _hits(shared, make: Callable[[pa.RecordBatch, wb.Words, dict, dict], pa.RecordBatch]):
    """`make` of each piece, its words, and by row the hit word runs and the items."""
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _compiled(key, shared.value)
        for batch in batches:
            for part in wb.pieces(batch, "text"):
                w = wb.words(part.column("text"))
                spans: dict[int, list] = {}
                items: dict[int, set] = {}
                for r, s, p in search(w, found):
                    spans.setdefault(r, []).append((s, s + int(found.size[p])))
                    items.setdefault(r, set()).update(found.owners(p))
                yield make(part, w, spans, items)

    return frugal(run)


def _with_items(part: pa.RecordBatch, w: wb.Words, spans: dict, items: dict) -> pa.RecordBatch:
    n, own = part.num_rows, [c for c in part.schema.names if c != "text"]
    return pa.RecordBatch.from_arrays(
        [
            *(part.column(c) for c in own), pa.array(np.diff(w.rows)),
            pa.array([merged(spans.get(i, [])) for i in range(n)], pa.list_(pa.int64())),
            pa.array([sorted(items.get(i, ())) for i in range(n)], pa.list_(pa.string())),
        ],
        [*own, "n_words", "runs", "items"],
    )


def _with_runs(part: pa.RecordBatch, w: wb.Words, spans: dict, items: dict) -> pa.RecordBatch:
    """The runs of earlier passes and these."""
    old = part.column("runs").to_pylist()
    runs = [merged(spans.get(i, []) + [(x[j], x[j + 1]) for j in range(0, len(x), 2)]) for i, x in enumerate(old)]
    own = [c for c in part.schema.names if c not in ("runs", "n_words")]
    return pa.RecordBatch.from_arrays([*(part.column(c) for c in own), pa.array(np.diff(w.rows)), pa.array(runs, pa.list_(pa.int64()))], [*own, "n_words", "runs"])


def merged(spans: list[tuple[int, int]]) -> list[int]:
    """Disjoint runs, flat: start, end, start, end ..."""
    out: list[int] = []
    for s, e in sorted(spans):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        runs = [merged([(x[i], x[i + 1]) for x in r for i in range(0, len(x), 2)]) for r in b.column("runs").to_pylist()]
        items = [sorted({y for x in r for y in x}) for r in b.column("items").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), pa.array(runs, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], ["doc_id", "n_words", "runs", "items"])


def _blocks(benchmark: DataFrame, most: int) -> Iterator[list]:
    block, size = [], 0
    for r in benchmark.where("text is not null").select(F.col("item_id").cast("string"), "text").toLocalIterator():
        if block and size + len(r[1]) > most:
            yield block
            block, size = [], 0
        block.append((r[0] if r[0] is not None else "", r[1]))
        size += len(r[1])
    yield block


def contamination(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, runs (array<long>: start, end of the hit word runs, flat) and items (array<string>, sorted) for each row."""
    spark = docs.sparkSession
    texts = docs.select("doc_id", "text")
    shape = "n_words long, runs array<long>, items array<string>"
    blocks = _blocks(benchmark, block_bytes)
    block, more = next(blocks), next(blocks, None)
    if more is None:
        return texts.mapInArrow(_hits(spark.sparkContext.broadcast(block), _with_items), f"doc_id long, {shape}")
    # rows are numbered once and kept, so that the passes agree on them; a pass writes a row's words and hits
    numbered = cut(texts.withColumn("row", F.monotonically_increasing_id()), "documents")
    every = None
    while block is not None:
        shared = spark.sparkContext.broadcast(block)
        found = numbered.mapInArrow(_hits(shared, _with_items), f"doc_id long, row long, {shape}")
        found = cut(found if every is None else found.where(F.size("runs") > 0), "hits")
        shared.destroy()
        every = found if every is None else every.unionByName(found)
        block, more = more, next(blocks, None)
    every = every.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.collect_list("runs").alias("runs"), F.collect_list("items").alias("items"))
    return every.select("doc_id", "n_words", "runs", "items").mapInArrow(frugal(_merge), f"doc_id long, {shape}")


def _judged(found: DataFrame, percent: int) -> DataFrame:
    """`found` with n_hit and contaminated."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("sign"))
    hit = F.aggregate("runs", zero, lambda a, x: F.struct((a["n"] + a["sign"] * x).alias("n"), (-a["sign"]).alias("sign")), lambda a: a["n"])
    return found.withColumn("n_hit", hit).withColumn("contaminated", (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, percent: int = 5) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated (hit words make up `percent` of all, or more)."""
    return _judged(contamination(docs, benchmark), percent).select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def with_contamination(docs: DataFrame, benchmark: DataFrame, percent: int = 5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`docs` and a column `contaminated`, which replaces one of that name."""
    spark = docs.sparkSession
    docs = docs.drop("contaminated")
    # every pass adds its runs to the row itself, so nothing is shuffled however many passes there are
    names = {c: f"_own_{i}" for i, c in enumerate(docs.columns) if c != "text"}
    now = docs.withColumnsRenamed(names).withColumn("n_words", F.lit(0).cast("long")).withColumn("runs", F.array().cast("array<long>"))
    shape = StructType([*now.schema.fields[:-2], StructField("n_words", LongType()), StructField("runs", ArrayType(LongType()))])
    blocks, written = _blocks(benchmark, block_bytes), None
    block, more = next(blocks), next(blocks, None)
    while block is not None:
        shared = spark.sparkContext.broadcast(block)
        now = now.mapInArrow(_hits(shared, _with_runs), shape)
        if more is not None:
            before, written = written, cut(now, "searched")
            now = written
            shared.destroy()
            if before is not None:
                discard(before)
        block, more = more, next(blocks, None)
    return _judged(now, percent).select(*(F.col(names.get(c, c)).alias(c) for c in docs.columns), "contaminated")
