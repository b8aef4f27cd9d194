"""Ranked lexical search by TPUT (three-phase uniform threshold) over term-partitioned postings.

Terms are runs of `[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]` with A-Z lower-cased; scores are sums of integer impacts, one for
each term of an item that a document holds. One pass over the documents keeps the number of terms and the frequencies of
the items' terms; a second one turns them into postings, in cells of one term and one block of documents, with the cell's
largest impacts beside them. The cells are rebalanced by term, so a frequent term's list lies in several partitions. Then:

1. the K first postings of every list give partial sums, and the K-th of an item's is its first lower bound;
2. every list is cut at the same threshold for an item, `ALPHA` of that bound divided by its terms; what is above is summed by
   document, block by block. A posting that is not seen is below the threshold, and not above its list's largest, so each
   document has a lower and an upper bound; the K-th lower bound leaves only candidates whose upper bound reaches it;
3. the candidates' other postings are looked up in their cells, and the exact scores are ranked.

Nothing is approximate: a document outside the candidates can't be among the first K, equal scores included.

Items are the benchmark's rows by item_id: rows of one item_id are one item with all their terms, and null is an id like
others. They are searched for in chunks of ITEM_BYTES of text, so what the driver and the broadcasts hold is bounded; each chunk is one
search over all documents. Items without terms, and those of which no term is in any document, give no rows. Null or
empty texts have no terms and aren't counted. Repeated rows are documents each; a null doc_id comes last among
equal scores. Further columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from rostrum.llm import wordbytes as wb
from rostrum.llm.common import cut, frugal

K = 10
#: The threshold's share of the first lower bound. Below 1 more postings are fetched and fewer candidates stay.
ALPHA = 0.5
ITEM_BYTES = 4_000_000
BLOCK_DOCS = 16_384
BLOCK_ENTRIES = 2_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass
class Items:
    """Items by number, each one's terms (by number) in `flat` from at[i] to at[i + 1]."""

    ids: list
    words: list[str]
    flat: np.ndarray
    at: np.ndarray


@dataclass
class Bounds:
    """first: each item's bound of phase 1; cut: its threshold; most: each list's largest impact; least: the smallest threshold among a list's items."""

    first: np.ndarray
    cut: np.ndarray
    most: np.ndarray
    least: np.ndarray


def item_terms(items: DataFrame) -> DataFrame:
    """item_id and its distinct terms, sorted, of (item_id, text)."""
    words = F.array_remove(F.split(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), BETWEEN), "")
    return items.select("item_id", F.explode(words).alias("term")).groupBy("item_id").agg(F.sort_array(F.collect_set("term")).alias("terms"))


def numbered(rows: list) -> Items:
    """Items and terms in order of their ids and letters; a null id comes first."""
    rows = sorted(rows, key=lambda r: (False,) if r["item_id"] is None else (True, r["item_id"]))
    words = sorted({w for r in rows for w in r["terms"]})
    number = {w: i for i, w in enumerate(words)}
    flat = np.array([number[w] for r in rows for w in r["terms"]], np.int64)
    return Items([r["item_id"] for r in rows], words, flat, np.concatenate([[0], np.cumsum([len(r["terms"]) for r in rows])]).astype(np.int64))


FORWARD = "block long, ord int, doc_id long, n long, terms array<int>, times array<long>"


def _forward(shared):
    """A row for each document with terms; a block has BLOCK_DOCS documents or about BLOCK_ENTRIES terms at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array([w.encode() for w in shared.value.words], pa.large_binary())
        block, held, entries = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            for part in wb.pieces(batch, "text"):
                each, row, term, times = wb.known_words(part.column("text"), known)
                rows = np.flatnonzero(each)
                if not len(rows):
                    continue
                if held and (held + len(rows) > BLOCK_DOCS or entries + len(row) > BLOCK_ENTRIES):
                    block, held, entries = block + 1, 0, 0
                at = np.append(np.searchsorted(row, rows), len(row)).astype(np.int32)
                lists = lambda values, kind, at=at: pa.ListArray.from_arrays(pa.array(at), pa.array(values, kind))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), block)), pa.array(np.arange(held, held + len(rows), dtype=np.int32)), part.column("doc_id").take(pa.array(rows)).cast(pa.int64()),
                     pa.array(each[rows]), lists(term, pa.int32()), lists(times, pa.int64())],
                    ["block", "ord", "doc_id", "n", "terms", "times"],
                )
                held, entries = held + len(rows), entries + len(row)

    return run


CELLS = "term int, block long, ords array<int>, impacts array<long>, head_ords array<int>, head_impacts array<long>"


def _cells(weights, documents: int, total: int, k: int):
    """The postings of the documents that come, as one cell for each term and block in a batch, in order of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = weights.value
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(np.diff(blocks)) + 1, [len(blocks)]])
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                size = pc.list_value_length(part.column("terms")).to_numpy()
                term = part.column("terms").flatten().to_numpy().astype(np.int64)
                times = part.column("times").flatten().to_numpy()
                m = np.array([10 + 90 * n * documents // total for n in part.column("n").to_pylist()], np.int64)
                ord_ = np.repeat(part.column("ord").to_numpy(), size)
                impact = weight[term] * (10**9 * times // (1000 * times + 8 * np.repeat(m, size)))
                keep = impact > 0
                term, ord_, impact = term[keep], ord_[keep], impact[keep]
                if not len(term):
                    continue
                order = np.argsort(term, kind="stable")
                starts, lists = _lists(term[order], ord_[order], impact[order])
                best = np.lexsort((ord_, -impact, term))
                at = np.searchsorted(term[best], term[best])
                best = best[np.arange(len(best)) - at < k]
                _, heads = _lists(term[best], ord_[best], impact[best])
                terms = term[order][starts]
                yield pa.RecordBatch.from_arrays([pa.array(terms, pa.int32()), pa.array(np.full(len(terms), blocks[lo])), *lists, *heads], ["term", "block", "ords", "impacts", "head_ords", "head_impacts"])

    return run


def _lists(term: np.ndarray, ord_: np.ndarray, impact: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """Where each term begins in a sorted array, and its documents and impacts as lists."""
    starts = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
    at = pa.array(np.append(starts, len(term)), pa.int32())
    return starts, [pa.ListArray.from_arrays(at, pa.array(ord_, pa.int32())), pa.ListArray.from_arrays(at, pa.array(impact, pa.int64()))]


def _above(bounds):
    """Of each cell the postings at the smallest threshold of the items that have its term, or above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = bounds.value.least
        for batch in batches:
            terms = batch.column("term").to_numpy()
            size = pc.list_value_length(batch.column("ords")).to_numpy()
            ord_, impact = (batch.column(c).flatten().to_numpy() for c in ("ords", "impacts"))
            cell = np.repeat(np.arange(len(terms)), size)
            keep = impact >= least[terms[cell]]
            left = np.bincount(cell[keep], minlength=len(terms))
            at = pa.array(np.concatenate([[0], np.cumsum(left)]), pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(x[keep])) for x in (ord_, impact)]
            out = pa.RecordBatch.from_arrays([batch.column("term"), batch.column("block"), *lists], ["term", "block", "ords", "impacts"])
            yield out.filter(pa.array(left > 0))

    return run


CANDIDATES = "item int, block long, ord int, lower long, upper long"


def _bounded(items, bounds, k: int):
    """Lower and upper bounds of one block's documents, for each item those that may still be among its first k."""

    def run(group: pa.Table) -> pa.Table:
        its, b = items.value, bounds.value
        lists: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in group.to_batches():
            ords, impacts = batch.column("ords"), batch.column("impacts")
            for i, t in enumerate(batch.column("term").to_pylist()):
                lists.setdefault(t, []).append((ords[i].values.to_numpy(), impacts[i].values.to_numpy()))
        size = 1 + max((int(o.max()) for found in lists.values() for o, _ in found), default=-1)
        out: list[list[np.ndarray]] = []
        for i in range(len(its.ids)):
            terms = its.flat[its.at[i] : its.at[i + 1]]
            unseen = np.minimum(b.cut[i] - 1, b.most[terms])
            lower, more, seen = np.zeros(size, np.int64), np.zeros(size, np.int64), False
            for t, bound in zip(terms.tolist(), unseen.tolist(), strict=True):
                for ord_, impact in lists.get(t, ()):
                    if b.least[t] < b.cut[i]:
                        above = impact >= b.cut[i]
                        ord_, impact = ord_[above], impact[above]
                    lower[ord_] += impact
                    more[ord_] += impact - bound
                    seen = True
            if not seen:
                continue
            upper = more + int(unseen.sum())
            some = np.flatnonzero(lower)
            floor = int(b.first[i])
            if len(some) >= k:
                floor = max(floor, int(np.partition(lower[some], len(some) - k)[len(some) - k]))
            some = some[upper[some] >= floor]
            out.append([np.full(len(some), i, np.int32), some.astype(np.int32), lower[some], upper[some]])
        item, ord_, lower, upper = (np.concatenate(x) for x in zip(*out, strict=True)) if out else [np.zeros(0, np.int64)] * 4
        block = np.full(len(item), group.column("block")[0].as_py())
        return pa.table([pa.array(item, pa.int32()), pa.array(block), pa.array(ord_, pa.int32()), pa.array(lower), pa.array(upper)], ["item", "block", "ord", "lower", "upper"])

    return run


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Impacts of the wanted documents in their cells; those that aren't in it have none."""
    for batch in batches:
        out: list[tuple] = []
        for i in range(batch.num_rows):
            have, impacts = (batch.column(c)[i].values.to_numpy() for c in ("ords", "impacts"))
            item, ord_ = (batch.column("wanted")[i].values.field(c).to_numpy() for c in ("item", "ord"))
            order = np.argsort(have)
            at = np.minimum(np.searchsorted(have, ord_, sorter=order), len(have) - 1)
            hit = have[order[at]] == ord_
            out.append((item[hit], np.full(np.count_nonzero(hit), batch.column("block")[i].as_py()), ord_[hit], impacts[order[at]][hit]))
        item, block, ord_, impact = (np.concatenate(x) for x in zip(*out, strict=True)) if out else [np.zeros(0, np.int64)] * 4
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(block, pa.int64()), pa.array(ord_, pa.int32()), pa.array(impact, pa.int64())], ["item", "block", "ord", "impact"])


def _kth(rows: DataFrame, by: str, k: int) -> DataFrame:
    """item and its k-th largest `by`, if it has as many rows."""
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc(by), "block", "ord"))
    return rows.select("item", by, place.alias("place")).where(F.col("place") <= k).groupBy("item").agg(F.count(F.lit(1)).alias("of"), F.min(by).alias("kth")).where(F.col("of") == k).select("item", "kth")


def _search(docs: DataFrame, items: Items, kinds: StructType, k: int, alpha: float) -> DataFrame:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(items)
    forward = cut(docs.select("doc_id", "text").mapInArrow(frugal(_forward(shared)), FORWARD), "forward")
    of = forward.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    often = forward.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(F.lit(1000.0) * F.ln((F.lit(2.0 * of["n"] + 2)) / (2 * F.col("df") + 1)))
    weights = np.zeros(len(items.words), np.int64)
    for r in often.select("term", weight.alias("w")).collect():  # one for each term of the chunk at most
        weights[r["term"]] = r["w"]
    made = forward.mapInArrow(frugal(_cells(spark.sparkContext.broadcast(weights), of["n"], of["total"], k)), CELLS)
    cells = cut(made.hint("rebalance", "term"), "postings")

    pairs = [(int(t), i, int(items.at[i + 1] - items.at[i])) for i in range(len(items.ids)) for t in items.flat[items.at[i] : items.at[i + 1]]]
    pairs = F.broadcast(spark.createDataFrame(pairs, "term int, item int, of int"))
    # 1: heads
    heads = cells.select("term", "block", F.explode(F.arrays_zip("head_ords", "head_impacts")).alias("h")).select("term", "block", F.col("h.head_ords").alias("ord"), F.col("h.head_impacts").alias("impact"))
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("impact"), "block", "ord"))
    heads = cut(heads.withColumn("place", place).where(F.col("place") <= k), "heads")
    sums = heads.join(pairs, "term").groupBy("item", "block", "ord").agg(F.sum("impact").alias("sum"))
    first, most = np.zeros(len(items.ids), np.int64), np.zeros(len(items.words), np.int64)
    for r in _kth(sums, "sum", k).collect():
        first[r["item"]] = r["kth"]
    for r in heads.where("place = 1").collect():
        most[r["term"]] = r["impact"]
    # 2: one threshold for all lists of an item
    size = np.diff(items.at)
    cuts = np.maximum(1, (alpha * first / size).astype(np.int64))
    least = np.full(len(items.words), np.iinfo(np.int64).max)
    np.minimum.at(least, items.flat, np.repeat(cuts, size))
    bounds = spark.sparkContext.broadcast(Bounds(first, cuts, most, least))
    above = cells.select("term", "block", "ords", "impacts").mapInArrow(frugal(_above(bounds)), "term int, block long, ords array<int>, impacts array<long>")
    candidates = cut(above.groupBy("block").applyInArrow(_bounded(shared, bounds, k), CANDIDATES), "candidates")
    floor = F.broadcast(_kth(candidates, "lower", k))  # a row for each item of the chunk at most
    candidates = candidates.join(floor, "item", "left").where(F.col("kth").isNull() | (F.col("upper") >= F.col("kth"))).select("item", "block", "ord")
    # 3: exact scores
    wanted = candidates.join(pairs, "item").groupBy("term", "block").agg(F.collect_list(F.struct("item", "ord")).alias("wanted"))
    found = cells.select("term", "block", "ords", "impacts").join(wanted, ["term", "block"]).mapInArrow(frugal(_looked_up), "item int, block long, ord int, impact long")
    scores = found.groupBy("item", "block", "ord").agg(F.sum("impact").alias("score")).join(forward.select("block", "ord", "doc_id"), ["block", "ord"])
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "block", "ord"))
    ranked = scores.withColumn("rank", place).where(F.col("rank") <= k)
    names = F.broadcast(spark.createDataFrame(list(enumerate(items.ids)), StructType([StructField("item", IntegerType()), kinds["item_id"]])))
    return ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")


def lexical_search(docs: DataFrame, items: DataFrame, k: int = K, alpha: float = ALPHA, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the `k` best documents (doc_id, text) of each item (item_id, text)."""
    spark = docs.sparkSession
    items = items.select("item_id", "text")
    chunks = -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // item_bytes)
    terms = item_terms(items)
    if chunks > 1:
        terms = cut(terms, "items")
    found = []
    for c in range(chunks):
        rows = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(chunks)) == c).collect() if chunks > 1 else terms.collect()
        if rows:
            found.append(_search(docs, numbered(rows), items.schema, k, alpha))
    if not found:
        return spark.createDataFrame([], StructType([items.schema["item_id"], StructField("rank", IntegerType()), StructField("doc_id", LongType()), StructField("score", LongType())]))
    return reduce(DataFrame.unionByName, found)
