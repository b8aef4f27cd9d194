"""N-gram Jaccard join by MinHash banding.

1. Every whole text becomes its set of hashed word 5-grams (a text of 1-4 words has one gram of all of them) and
   `bands * rows` minhashes. Texts with the same word sequence form one class, so copies are never paired.
2. Classes are shuffled by band hash. Buckets with the same members are kept once. A bucket of more than BLOCK
   members is dealt out as pairs of blocks, so that no task holds it whole.
3. A task compares full gram sets, in the first bucket that a pair shares only, and returns for each class the number
   of documents linked to it and one link to its local component: sums and stars, never all pairs of a group.
4. Components of the stars give `class_id`.

Bands and rows come from `choose_bands`: the least work at which a pair exactly at the threshold meets with
the target recall. A text without words, or null, has no grams: it is linked to nothing and is a class of its own, as
is every repeated row of it. Repeated rows of other texts count as copies. Ties in `class_id` go to the smallest
doc_id; a null doc_id is kept in the result and never names a class unless the class has no other id. Further columns
are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from rostrum.llm import wordbytes as wb
from rostrum.llm.common import cut, frugal, small, whole_groups
from rostrum.operators.graph import components

BLOCK = 512
#: Up to this many candidate ids are broadcast to fetch their texts; more are joined by a shuffle.
BROADCAST_ROWS = 400_000
_SEEDS = np.random.Generator(np.random.PCG64(77)).integers(1, 2**32, (2, 1024), dtype=np.uint32) | np.uint32(1)


def choose_bands(threshold: float, recall: float, most: int = 128) -> tuple[int, int]:
    """(bands, rows): the most selective banding of at most `most` hashes that finds a pair at `threshold` with `recall`."""
    best = (1, 1)
    for rows in range(1, 33):
        p = threshold**rows
        bands = max(1, int(np.ceil(np.log(1 - recall) / np.log1p(-p)))) if p < 1 else 1
        if bands * rows <= most:
            best = (bands, rows)
    return best


def _sketch(bands: int, rows: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wb.pieces(batch, "text"):
                w = wb.words(part.column("text"))
                grams, at = wb.grams(w, k)
                n = part.num_rows
                full = np.flatnonzero(np.diff(at) > 0)
                band = np.zeros((n, bands), np.uint64)
                if len(full):
                    g = (grams >> np.uint64(32)).astype(np.uint32)
                    v = np.empty_like(g)
                    t = np.empty_like(g)
                    for b in range(bands):
                        acc = np.full(len(full), b + 1, np.uint64)
                        for r in range(b * rows, (b + 1) * rows):
                            np.bitwise_xor(g, _SEEDS[0, r], out=v)
                            np.multiply(v, _SEEDS[1, r], out=v)
                            np.right_shift(v, 15, out=t)
                            np.bitwise_xor(v, t, out=v)
                            np.multiply(v, np.uint32(0x2C1B3C6D), out=v)
                            acc = wb.mix(acc * wb.BASE + np.minimum.reduceat(v, at[full]))
                        band[full, b] = acc
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(wb.sequence_digests(w), pa.binary()),
                        pa.array(np.diff(at)),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, n * bands + 1, bands, dtype=np.int32)), pa.array(band.view(np.int64).ravel())),
                    ],
                    ["doc_id", "node", "n_grams", "bands"],
                )

    return run


def _gram_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wb.pieces(batch, "text"):
                w = wb.words(part.column("text"))
                grams, at = wb.grams(w, k)
                sets = [np.unique(grams[at[i] : at[i + 1]]).tobytes() for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([pa.array(wb.sequence_digests(w), pa.binary()), pa.array(sets, pa.binary())], ["node", "grams"])

    return run


def overlaps(left: list[np.ndarray], right: list[np.ndarray], wanted: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sorted sets, for the pairs marked in `wanted` at least."""
    out = np.zeros(wanted.shape, np.float32)
    pairs = np.argwhere(wanted)
    if len(pairs) <= 48:
        for i, j in pairs:
            a, b = left[i], right[j]
            at = np.searchsorted(b, a)
            at[at == len(b)] = 0
            out[i, j] = np.count_nonzero(b[at] == a)
        return out
    sides = [np.concatenate(s) if s else np.zeros(0, np.uint64) for s in (left, right)]
    shared = np.intersect1d(np.unique(sides[0]), np.unique(sides[1]), assume_unique=True) if left is not right else _repeated(sides[0])
    owners = [np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in (left, right)]
    found = []
    for values, owner in zip(sides, owners, strict=True):
        at = np.searchsorted(shared, values)
        at[at == len(shared)] = 0
        hit = shared[at] == values if len(shared) else np.zeros(len(values), bool)
        order = np.argsort(at[hit], kind="stable")
        found.append((at[hit][order], owner[hit][order]))
    for begin in range(0, len(shared), 2048):
        dense = []
        for (column, owner), rows in zip(found, wanted.shape, strict=True):
            lo, hi = np.searchsorted(column, [begin, begin + 2048])
            m = np.zeros((rows, min(2048, len(shared) - begin)), np.float32)
            m[owner[lo:hi], column[lo:hi] - begin] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out


def _repeated(values: np.ndarray) -> np.ndarray:
    u, n = np.unique(values, return_counts=True)
    return u[n > 1]


def _verify(threshold: float):
    """Links of one task at a time: members of block `bi` against members of block `bj` of one bucket."""

    def task(t: pa.Table) -> list | None:
        band, bi, bj = (t.column(c)[0].as_py() for c in ("band", "bi", "bj"))
        block = t.column("block").to_numpy()
        nodes = t.column("node").to_pylist()
        copies = t.column("copies").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in t.column("grams").to_pylist()]
        size = np.array([len(x) for x in sets])
        signs = np.array(t.column("bands").to_pylist(), np.int64).reshape(len(nodes), -1)
        if bi == bj:
            rows = columns = np.arange(len(nodes))
            wanted = np.triu(np.ones((len(nodes), len(nodes)), bool), 1)
        else:
            rows, columns = np.flatnonzero(block == bi), np.flatnonzero(block == bj)
            wanted = np.ones((len(rows), len(columns)), bool)
        for b in range(band):
            wanted &= signs[rows, b][:, None] != signs[columns, b][None, :]
        a, c = size[rows][:, None], size[columns][None, :]
        wanted &= np.minimum(a, c) >= threshold * np.maximum(a, c) - 1e-9
        if not wanted.any():
            return None
        left = [sets[i] for i in rows]
        both = overlaps(left, left if bi == bj else [sets[i] for i in columns], wanted)
        linked = wanted & (both >= threshold * (a + c - both) - 1e-6)
        if not linked.any():
            return None
        links = np.zeros(len(nodes), np.int64)
        links[rows] += linked @ copies[columns]
        links[columns] += linked.T @ copies[rows]
        label = np.arange(len(nodes))
        while True:
            far = len(nodes)
            new = label.copy()
            new[rows] = np.minimum(new[rows], np.where(linked, label[columns][None, :], far).min(1))
            new[columns] = np.minimum(new[columns], np.where(linked, label[rows][:, None], far).min(0))
            new = new[new]
            if (new == label).all():
                break
            label = new
        return [(nodes[i], int(links[i]), nodes[label[i]]) for i in np.flatnonzero(links)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["band", "bucket", "bi", "bj"]
        for t in whole_groups(batches, keys):
            t = t.combine_chunks()
            at = np.zeros(t.num_rows, bool)
            at[0] = True
            for k in keys:
                v = t.column(k).to_numpy()
                at[1:] |= v[1:] != v[:-1]
            starts = np.append(np.flatnonzero(at), t.num_rows)
            out = []
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                if e - s > 1:
                    out += task(t.slice(s, e - s)) or []
            if out:
                node, links, root = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array(links, pa.int64()), pa.array(root, pa.binary())], ["node", "links", "root"])

    return run


def near_duplicates(docs: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.9999) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node, n_grams) of each row, node null without words; and (node, first_doc, copies, class_id, class_size,
    n_links, leader) of each node, where leader is the node of the class that has its smallest doc_id."""
    bands, rows = choose_bands(threshold, recall)
    texts = docs.select("doc_id", "text")
    signs = cut(texts.mapInArrow(frugal(_sketch(bands, rows, n)), "doc_id long, node binary, n_grams long, bands array<long>"), "signatures")
    classes = signs.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies"))
    members = signs.where("node is not null").groupBy("node").agg(F.min("bands").alias("bands"))

    placed = members.select("node", F.posexplode("bands").alias("band", "bucket"))
    buckets = (
        placed.groupBy("band", "bucket")
        .agg(F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
        .where("size > 1")
        .groupBy("size", "x", "y")
        .agg(F.min(F.struct("band", "bucket")).alias("b"))
        .select("b.band", "b.bucket", "size")
    )
    held = (
        placed.join(buckets, ["band", "bucket"])
        .withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("node", F.lit(2)), F.col("blocks")).cast("int"))
    )
    held = cut(held.select("band", "bucket", "node", "block", "blocks"), "buckets")
    wanted = held.select("node").distinct()
    # one text for each candidate class: its first document's
    chosen = cut(
        signs.where("node is not null").join(small(wanted, BROADCAST_ROWS), "node", "left_semi")
        .groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.min("bands").alias("bands")),
        "candidates",
    )
    source = texts.join(small(chosen.select("doc_id"), BROADCAST_ROWS), texts["doc_id"].eqNullSafe(chosen["doc_id"]), "left_semi")
    # a doc_id may repeat with the same or another text: the node is taken from the text again, and each kept once
    sets = source.select("text").mapInArrow(frugal(_gram_sets(n)), "node binary, grams binary").groupBy("node").agg(F.first("grams").alias("grams"))
    sets = sets.join(chosen.select("node", "copies", "bands"), "node")
    tasks = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "node", F.col("band").cast("long").alias("band"), "bucket", F.col("block").cast("long").alias("block"),
        F.least("block", "other").cast("long").alias("bi"), F.greatest("block", "other").cast("long").alias("bj"),
    )
    work = tasks.join(sets, "node")
    keys = ["band", "bucket", "bi", "bj"]
    found = (
        work.repartition(*keys).sortWithinPartitions(*keys)
        .select(*keys, "block", "node", "copies", "bands", "grams")
        .mapInArrow(frugal(_verify(threshold)), "node binary, links long, root binary")
    )
    found = cut(found, "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    linked = links.join(parts, "node").join(classes, "node")
    order = F.struct(F.col("first_doc").isNull().alias("unknown"), "first_doc", "node")
    roots = linked.groupBy("root").agg(F.min(order).alias("lead"), F.sum("copies").alias("class_size"))
    info = classes.join(linked.select("node", "links", "root").join(roots, "root"), "node", "left").select(
        "node", "first_doc", "copies",
        F.coalesce("lead.first_doc", "first_doc").alias("class_id"),
        F.coalesce("class_size", "copies").alias("class_size"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("lead.node", "node").alias("leader"),
    )
    return signs.select("doc_id", "node", "n_grams"), info


def ngram_jaccard_join(docs: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.9999) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): doc_id, class_id, class_size, n_links, n_grams.

    class_id: smallest doc_id of the documents that links of similarity >= threshold connect; class_size: their number.
    n_links: other documents at least this similar to the row's own, copies included.
    """
    signs, info = near_duplicates(docs, threshold, n, recall)
    return signs.join(info.drop("first_doc", "copies", "leader"), "node", "left").select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        "n_grams",
    )


def _with_node(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in wb.pieces(batch, "text"):
            w = wb.words(part.column("text"))
            node = pa.array(wb.sequence_digests(w), pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns, node], [*part.schema.names, "node"])


def keep_one(docs: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.9999) -> DataFrame:
    """`docs` with one row of each class: one with its smallest doc_id. Texts without words all stay.

    Only nodes with something to drop are joined to the rows, by the key of the text itself.
    """
    own = {c: f"_own_{i}" for i, c in enumerate(docs.columns) if c != "text"}
    keyed = docs.withColumnsRenamed(own)
    keyed = keyed.mapInArrow(frugal(_with_node), StructType([*keyed.schema.fields, StructField("node", BinaryType())]))
    signs, info = near_duplicates(docs, threshold, n, recall)
    touched = info.where("copies > 1 or node <> leader").select("node", "first_doc", (F.col("node") == F.col("leader")).alias("leads"))
    same = signs.join(touched.where("leads"), "node").where("doc_id <=> first_doc").groupBy("node").agg((F.count(F.lit(1)) > 1).alias("repeated"))
    touched = cut(touched.join(same, "node", "left").withColumnRenamed("node", "touched"), "touched")
    rows = keyed.join(small(touched, BROADCAST_ROWS), F.col("node") == F.col("touched"), "left")
    rows = rows.where(f"touched is null or (leads and {own['doc_id']} <=> first_doc)")
    if touched.where("repeated").limit(1).count():
        rows = rows.where("repeated is null or not repeated").unionByName(rows.where("repeated").dropDuplicates(["node"]))
    return rows.select(*(F.col(own.get(c, c)).alias(c) for c in docs.columns))
