"""Token-ID output: documents in ascending doc_id order, encoded, Re-Pair compressed, written as shards and read back.

Documents are dealt by ranges of doc_id and sorted; each task encodes its texts, appends the end id to each document and
writes a shard (see `repair`) for about SHARD_IDS ids, one row of a Parquet table in the shared folder: partition, seq,
n_docs, n_ids, doc_ids, data. Spark commits that table, so a lost executor only repeats its own tasks. Reading decodes
shard by shard; `start` is a running sum over the shards' sizes.

Texts are encoded by chunks, which begin after a blank or where a stop follows an ASCII letter: this tokenizer composes
(NFC), lower-cases and never forms a token across those borders, so the ids of a text are those of its chunks in order;
each distinct chunk of a batch, told apart by its bytes, is encoded once and kept for the next batch (at most CACHE of
them). A text that holds a special token's opening is encoded whole.

Null or empty texts are the end id alone. Documents of equal doc_id, null first, stand in order of a hash of
their texts; repeated rows are repeated documents. Further columns are ignored. An empty table gives no shard.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rostrum.llm import wordbytes as wb
from rostrum.llm.common import eager, frugal, give_back, new_path, small
from rostrum.llm.repair import Shard, _gather, compress

SHARD_IDS = 1_000_000
CACHE = 800_000
FRESH = 150_000
KEPT_BYTES = 64
END_ID = 2
#: The tokenizer drops white space and lower-cases, so both may be done to the bytes before; but it composes first, and
#: 'h' + U+0331 has a composed form where 'H' + U+0331 has none, so a capital before a byte that isn't ASCII stays as it is.
PLAIN = wb.LOWER.copy()
PLAIN[[9, 10, 11, 12, 13]] = 32
CAPITAL = np.zeros(256, bool)
CAPITAL[65:91] = True
LETTER = np.zeros(256, bool)
LETTER[97:123] = True
SPLITS = np.zeros(256, bool)
SPLITS[list(b".,;:!?()")] = True

_coders: dict[str, Coder] = {}


class Store:
    """Ids of chunks by their bytes; a hash in sorted arrays leads to the chunk, whose bytes are compared."""

    def __init__(self) -> None:
        self.keys, self.words = np.zeros(0, np.uint64), pa.array([], pa.large_binary())
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def find(self, keys: np.ndarray, words: pa.Array) -> np.ndarray:
        """Places of the chunks, -1 for unknown ones."""
        out = np.full(len(keys), -1)
        if not len(self.keys):
            return out
        p = np.searchsorted(self.keys, keys)
        p[p == len(self.keys)] = 0
        may = np.flatnonzero(self.keys[p] == keys)
        same = pc.equal(self.words.take(pa.array(p[may])), words.take(pa.array(may))).to_numpy(zero_copy_only=False)
        out[may[same]] = p[may[same]]
        return out

    def add(self, keys: np.ndarray, words: pa.Array, size: np.ndarray, ids: np.ndarray) -> None:
        order = np.argsort(np.concatenate([self.keys, keys]), kind="stable")
        join = lambda old, new: np.concatenate([old, new.astype(old.dtype)])[order]
        self.at = join(self.at, len(self.ids) + np.cumsum(size) - size)
        self.keys, self.size = join(self.keys, keys), join(self.size, size)
        self.words = pa.concat_arrays([self.words, words]).take(pa.array(order))
        self.ids = np.concatenate([self.ids, ids])


class Coder:
    """Whole texts to ids by the tokenizers library, distinct chunks once; at most CACHE chunks are kept between batches."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.known, self.fresh = Store(), Store()

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def spell(self, spelled: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks, joined, and each chunk's number of ids."""
        ids, sizes = [], []
        for at in range(0, len(spelled), 4096):
            part = spelled[at : at + 4096]
            e = self.tokenizer.encode_batch([part], is_pretokenized=True, add_special_tokens=False)[0]
            ids.append(np.array(e.ids, np.uint32))
            sizes.append(np.bincount(np.array(e.word_ids, np.int64), minlength=len(part)) if len(e.ids) else np.zeros(len(part), np.int64))
        return (np.concatenate(ids), np.concatenate(sizes)) if ids else (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each closed by `end_id`, joined, and each text's number of ids."""
        data, offsets = wb.raw(texts)
        n = len(offsets) - 1
        plain = PLAIN[data]
        capital = np.flatnonzero(CAPITAL[data[:-1]] & (data[1:] > 127))
        plain[capital] = data[capital]
        opening = np.flatnonzero((plain[:-1] == 60) & (plain[1:] == 124))
        special = np.unique(np.searchsorted(offsets, opening, "right") - 1)
        begin = plain != 32
        begin[1:] &= plain[:-1] == 32
        begin[1:] |= SPLITS[plain[1:]] & LETTER[plain[:-1]]
        begin[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(begin)
        bounds = np.searchsorted(starts, offsets)
        solid = plain != 32
        # a chunk ends before its blanks, so that it is the same before a blank and before a stop
        cuts = np.append(np.cumsum(solid)[starts] - solid[starts], np.count_nonzero(solid)) if len(starts) else np.zeros(1, np.int64)
        place, ids, at, size = self._chunks(plain[solid], cuts)
        # one chunk more: the end id
        ids, at, size = np.append(ids, np.uint32(end_id)), np.append(at, len(ids)), np.append(size, 1)
        chunk = np.full(len(starts) + n, len(at) - 1)
        inside = np.ones(len(chunk), bool)
        inside[bounds[1:] + np.arange(n)] = False
        chunk[inside] = place
        out = _gather(ids, at[chunk], size[chunk])
        each = np.add.reduceat(size[chunk], bounds[:-1] + np.arange(n)) if n else np.zeros(0, np.int64)
        if len(special):
            cuts = np.concatenate([[0], np.cumsum(each)])
            parts = [out[cuts[i] : cuts[i + 1]] for i in range(n)]
            for i in special:
                parts[i] = np.append(self.whole(bytes(data[offsets[i] : offsets[i + 1]]).decode()), np.uint32(end_id))
            out, each = np.concatenate(parts), np.array([len(p) for p in parts])
        return out, each

    def _chunks(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, ...]:
        """(number of each chunk, ids of the distinct ones joined, where each one's ids begin, how many it has)."""
        n = len(cuts) - 1
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        coded = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        place, words = coded.indices.to_numpy(), coded.dictionary
        raw, bounds = wb.raw(words)
        keys = wb.string_hashes(raw, bounds[:-1], bounds[1:])
        known, fresh = self.known.find(keys, words), self.fresh.find(keys, words)
        missing = np.flatnonzero((known < 0) & (fresh < 0))
        ids, sizes = self.spell([x.decode() for x in words.take(pa.array(missing)).to_pylist()])
        at, size = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        at[missing], size[missing] = len(self.known.ids) + len(self.fresh.ids) + np.cumsum(sizes) - sizes, sizes
        for store, found, base in ((self.known, known, 0), (self.fresh, fresh, len(self.known.ids))):
            hit = np.flatnonzero(found >= 0)
            at[hit], size[hit] = base + store.at[found[hit]], store.size[found[hit]]
        every = np.concatenate([self.known.ids, self.fresh.ids, ids])
        # long chunks are rarely met again, so they aren't kept
        short = np.diff(bounds)[missing] <= KEPT_BYTES
        room = CACHE - len(self.known.keys) - len(self.fresh.keys)
        if room > 0:
            keep = np.flatnonzero(short)[:room]
            kept = missing[keep]
            self.fresh.add(keys[kept], words.take(pa.array(kept)), sizes[keep], _gather(ids, (np.cumsum(sizes) - sizes)[keep], sizes[keep]))
            if len(self.fresh.keys) > FRESH or len(keep) == room:
                new, size_ = self.fresh, self.fresh.size.astype(np.int64)
                self.known.add(new.keys, new.words, size_, _gather(new.ids, new.at, size_))
                self.fresh = Store()
        return place, every, at, size


def coder(path: str) -> Coder:
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def _shards(path: str, end_id: int, shard_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = coder(path)
        held: list = []
        total, seq = 0, 0
        partition = TaskContext.get().partitionId()

        def flush() -> pa.RecordBatch:
            nonlocal held, total, seq
            ids = np.concatenate([x[1] for x in held])
            docs = pa.chunked_array([x[0] for x in held]).combine_chunks()
            row = [[partition], [seq], [len(docs)], [len(ids)]]
            data = compress(ids, np.concatenate([x[2] for x in held]), use.vocabulary, end_id)
            out = pa.RecordBatch.from_arrays(
                [*(pa.array(x, pa.int64()) for x in row), pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs), pa.array([data], pa.binary())],
                ["partition", "seq", "n_docs", "n_ids", "doc_ids", "data"],
            )
            held, total, seq = [], 0, seq + 1
            give_back()
            return out

        for batch in batches:
            for part in wb.pieces(batch, "text", 1 << 20):
                ids, each = use.encode(part.column("text"), end_id)
                held.append((part.column("doc_id"), ids, each))
                total += len(ids)
                if total >= shard_ids:
                    yield flush()
        if held:
            yield flush()

    return run


SHARDS = "partition long, seq long, n_docs long, n_ids long, doc_ids array<long>, data binary"


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> None:
    """Write the shards of all rows of `docs` (doc_id, text) to `path`; `tokenizer`: path of a tokenizers file."""
    placed = docs.select("doc_id", "text").withColumn("h", F.xxhash64("text"))
    placed = placed.repartitionByRange("doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h").select("doc_id", "text")
    with eager(docs.sparkSession):
        placed.mapInArrow(frugal(_shards(tokenizer, end_id, shard_ids)), SHARDS).write.parquet(path)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            shard = Shard.read(b.column("data")[i].as_buffer())
            ids = shard.decode()
            cuts = np.append(shard.id_at, len(ids)).astype(np.int64)
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(cuts[:-1], cuts[1:], strict=True)]
            n = len(crc)
            docs = b.column("doc_ids")[i].values
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, b.column(c)[i].as_py())) for c in ("partition", "seq")]
                + [docs, pa.array(cuts[:-1]), pa.array(np.diff(cuts)), pa.array(crc, pa.int64())],
                ["partition", "seq", "doc_id", "at", "n_tokens", "ids_crc32"],
            )


def read_tokens(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the shards at `path`."""
    shards = spark.read.schema(SHARDS).parquet(path)
    sizes = shards.select("partition", "seq", "n_ids")
    # a running sum over partitions, then one within each
    by_partition = sizes.groupBy("partition").agg(F.sum("n_ids").alias("ids"))
    before = by_partition.select("partition", (F.sum("ids").over(Window.orderBy("partition")) - F.col("ids")).alias("before"))
    within = sizes.withColumn("in", F.sum("n_ids").over(Window.partitionBy("partition").orderBy("seq")) - F.col("n_ids"))
    offsets = within.join(before, "partition").select("partition", "seq", (F.col("in") + F.col("before")).alias("offset"))
    rows = shards.select("partition", "seq", "doc_ids", "data").mapInArrow(frugal(_decoded), "partition long, seq long, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(small(offsets, 200_000), ["partition", "seq"]).select("doc_id", (F.col("at") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, tokenizer: str, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Write `docs` as token shards to `path`, where they stay, and return what is read back from them; without a path
    they lie in the shared folder until the driver ends."""
    path = path or new_path(docs.sparkSession, "tokens")
    write_tokens(docs, tokenizer, path, end_id)
    return read_tokens(docs.sparkSession, path)
