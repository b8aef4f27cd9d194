"""Reduced text vectors and their clusters, for all dockets in one plan: truncated SVD, HDBSCAN and average linkage.

Reduction is a randomised SVD by subspace iteration on the side of the terms, of which a docket has a bounded number (see
`linkage.tfidf`); its texts are dealt into blocks of BLOCK_ROWS. A block turns the basis V into its part of X'XV; parts are
summed by ranges of terms, and V is made orthogonal from the sum of the ranges' Gram matrices. Of the texts nothing but
their own rows is ever moved. A docket of one block runs all its rounds within its task.

Neighbours are exact: blocks of NEAR_ROWS vectors meet in pairs as matrix products, and a pair returns a row for each vector or
component, never one for each pair of vectors. The products grow with the square of a docket's units, as the exact
methods do; what is written and shuffled is linear but for a block's vectors, which go to each block of its docket.
Merging components and cutting the tree take a docket's edges, three numbers for a unit, in one task. Average linkage takes up to
WITHIN connected clusters in one task, with time by the square of their number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rostrum.operators.graph import components
from rostrum.operators.ranks import ranked
from rostrum.storage import cut, discard, small

DIMENSIONS = 256
OVERSAMPLED = 10
ROUNDS = 7
BLOCK_ROWS = 16_384
RANGE = 1_024
NEAR_ROWS = 2_048
CLUSTER_SIZE = 3
AVERAGE_DISTANCE = 0.35
#: Blocks of density clusters and of the first pass of average linkage have so many times the rows. Average linkage: up to so many clusters are merged within a task.
LINKED = 4
WITHIN = 65_536
#: Density clusters: pairs of blocks go in parts that hold about so many copies of the vectors.
COPIES = 3
#: Cells of a product at a time: their rows, 266 numbers each, stay in a core's cache.
STRIP = 512
#: Up to this many ids are broadcast with their places; more are joined by a shuffle.
PLACES = 1_000_000
#: Density where units are equal.
DENSEST = 1e9


# reduction


class Rows:
    """Sparse rows: cells in order of rows, and again in order of terms."""

    def __init__(self, terms: list[np.ndarray], weights: list[np.ndarray], width: int) -> None:
        self.n, self.width = len(terms), width
        self.row = np.repeat(np.arange(self.n), [len(t) for t in terms])
        self.term = np.concatenate(terms).astype(np.int64) if terms else np.zeros(0, np.int64)
        self.weight = np.concatenate(weights).astype(np.float32) if weights else np.zeros(0, np.float32)
        self.by_term = np.argsort(self.term, kind="stable")

    def _sum(self, into: np.ndarray, of: np.ndarray, matrix: np.ndarray, weight: np.ndarray, height: int) -> np.ndarray:
        """Rows of `matrix` by `of`, times weight, summed by the sorted numbers `into`."""
        out = np.zeros((height, matrix.shape[1]), matrix.dtype)
        for lo in range(0, len(into), STRIP):
            part = into[lo : lo + STRIP]
            first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            out[part[first]] += np.add.reduceat(matrix[of[lo : lo + STRIP]] * weight[lo : lo + STRIP, None], first, axis=0)
        return out

    def times(self, v: np.ndarray) -> np.ndarray:
        return self._sum(self.row, self.term, v, self.weight, self.n)

    def back(self, y: np.ndarray) -> np.ndarray:
        o = self.by_term
        return self._sum(self.term[o], self.row[o], y, self.weight[o], self.width)


def start(width: int, height: int) -> np.ndarray:
    """The seeded basis, alike in every task."""
    return np.random.Generator(np.random.PCG64(0)).standard_normal((width, height)).astype(np.float32)


def whitening(gram: np.ndarray) -> np.ndarray:
    """T such that ZT has orthonormal columns, of Z'Z; directions without length become 0."""
    value, vector = np.linalg.eigh(gram)
    kept = value > 1e-10 * max(value[-1], 1e-300)
    return vector * np.where(kept, 1 / np.sqrt(np.where(kept, value, 1)), 0)


def turning(gram: np.ndarray, k: int) -> np.ndarray:
    """The k main directions of B, of B'B; each one's largest entry is positive."""
    value, vector = np.linalg.eigh(gram)
    vector = vector[:, np.argsort(-value, kind="stable")[:k]]
    return vector * np.sign(vector[np.abs(vector).argmax(axis=0), np.arange(vector.shape[1])])


def unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length > 1e-12, length, 1)


def gram(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x.T @ x


def _sizes(group: pd.DataFrame) -> tuple[int, int, int]:
    width, k = int(group["width"].iat[0]), int(group["k"].iat[0])
    return width, k, min(k + OVERSAMPLED, width)


def _sparse(group: pd.DataFrame) -> Rows:
    return Rows(list(group["terms"]), list(group["weights"]), int(group["width"].iat[0]))


def _local(group: pd.DataFrame) -> pd.DataFrame:
    """All rounds of a docket of one block."""
    group = group.sort_values("id")
    width, k, q = _sizes(group)
    x = _sparse(group)
    v = start(width, q)
    for _ in range(ROUNDS + 1):
        z = x.back(x.times(v))
        v = (z @ whitening(gram(z))).astype(np.float32)
    b = x.times(v).astype(np.float64)
    return pd.DataFrame({"docket_id": group["docket_id"], "id": group["id"], "vector": list(unit(b @ turning(gram(b), k)))})


PARTS = "docket_id string, range int, z binary"


def _parts(group: pd.DataFrame, v: np.ndarray) -> pd.DataFrame:
    """X'XV of one block, by ranges of terms."""
    x = _sparse(group)
    z = x.back(x.times(v))
    at = range(0, x.width, RANGE)
    return pd.DataFrame({"docket_id": group["docket_id"].iat[0], "range": [a // RANGE for a in at], "z": [z[a : a + RANGE].tobytes() for a in at]})


def _summed(width: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        z = reduce(np.add, (np.frombuffer(x, np.float32) for x in group["z"]))
        own = gram(z.reshape(-1, width))
        return pd.DataFrame({"docket_id": group["docket_id"].iloc[:1], "range": group["range"].iloc[:1], "z": [z.tobytes()], "gram": [own.tobytes()]})

    return run


def _turned_ranges(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            turned = [(np.frombuffer(z, np.float32).reshape(-1, width) @ np.frombuffer(t, np.float64).reshape(width, width)).astype(np.float32) for z, t in zip(p["z"], p["t"], strict=True)]
            yield pd.DataFrame({"docket_id": p["docket_id"], "range": p["range"], "z": [x.tobytes() for x in turned]})

    return run


def _basis(ranges: pd.DataFrame, q: int) -> np.ndarray:
    return np.concatenate([np.frombuffer(z, np.float32).reshape(-1, q) for z in ranges.sort_values("range")["z"]])


def _in_blocks(blocks: DataFrame, width: int) -> DataFrame:
    """docket_id, id, vector of dockets of several blocks, whose bases have `width` columns: blocks (docket_id, block, width, k, id, terms, weights)."""
    of = blocks.groupBy("docket_id", "block")
    keys = cut(blocks.select("docket_id", "block").distinct(), "keys")
    square = lambda column: reduce(np.add, (np.frombuffer(x, np.float64).reshape(width, width) for x in column))
    one = lambda g, t: pd.DataFrame({"docket_id": g["docket_id"].iloc[:1], "t": [t.tobytes()]})

    def projected(b: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        y = _sparse(b).times(_basis(r, width)).astype(np.float64)
        return pd.DataFrame({"docket_id": b["docket_id"].iloc[:1], "k": b["k"].iloc[:1], "ids": [list(b["id"].astype(str))], "b": [y.tobytes()], "gram": [gram(y).tobytes()]})

    def turned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for d, ids, b, t in zip(p["docket_id"], p["ids"], p["b"], p["t"], strict=True):
                vectors = unit(np.frombuffer(b, np.float64).reshape(-1, width) @ np.frombuffer(t, np.float64).reshape(width, -1))
                yield pd.DataFrame({"docket_id": d, "id": ids, "vector": list(vectors)})

    parts = of.applyInPandas(lambda b: _parts(b, start(int(b["width"].iat[0]), width)), PARTS)
    z = None
    for i in range(ROUNDS + 1):
        old = z
        z = cut(parts.groupBy("docket_id", "range").applyInPandas(_summed(width), f"{PARTS}, gram binary"), "ranges")
        if old:
            discard(old)
        t = z.select("docket_id", "gram").groupBy("docket_id").applyInPandas(lambda g: one(g, whitening(square(g["gram"]))), "docket_id string, t binary")
        # a range is turned once, before it goes to each block
        basis = z.drop("gram").join(t, "docket_id").mapInPandas(_turned_ranges(width), PARTS).join(keys, "docket_id").groupBy("docket_id", "block")
        if i < ROUNDS:
            parts = of.cogroup(basis).applyInPandas(lambda b, r: _parts(b, _basis(r, width)), PARTS)
    y = cut(of.cogroup(basis).applyInPandas(projected, "docket_id string, k int, ids array<string>, b binary, gram binary"), "projected")
    t = y.select("docket_id", "k", "gram").groupBy("docket_id").applyInPandas(lambda g: one(g, turning(square(g["gram"]), int(g["k"].iat[0]))), "docket_id string, t binary")
    return y.select("docket_id", "ids", "b").join(t, "docket_id").mapInPandas(turned, "docket_id string, id string, vector array<double>")


def reduced(weights: DataFrame, dimensions: int = DIMENSIONS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """docket_id, id, vector: of (docket_id, id, term, w) the unit rows of each docket's truncated SVD.

    At most `dimensions` of them, one fewer than the docket's texts and its terms; a docket of one or two texts has two if it
    has as many terms. Vectors are alike up to the turn that a subspace of equal singular values allows; their cosines are alike.
    Texts without terms aren't in `weights` and have no vector.
    """
    return reduced_rows(sparse_rows(weights), dimensions, block_rows)


def sparse_rows(weights: DataFrame) -> DataFrame:
    """docket_id, id, terms, weights of (docket_id, id, term, w): a row for each text, its terms by their numbers in the docket."""
    numbered = weights.select("docket_id", "term").distinct().withColumn("no", F.row_number().over(Window.partitionBy("docket_id").orderBy("term")) - 1)
    texts = weights.join(numbered, ["docket_id", "term"]).groupBy("docket_id", "id").agg(F.sort_array(F.collect_list(F.struct("no", F.col("w").cast("double").alias("w")))).alias("cells"))
    return cut(texts.select("docket_id", "id", F.col("cells.no").alias("terms"), F.col("cells.w").alias("weights")), "texts")


def reduced_rows(texts: DataFrame, dimensions: int = DIMENSIONS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """As `reduced`, of written `sparse_rows`."""
    n, width = F.count(F.lit(1)), F.max(F.array_max("terms")) + 1
    k = F.when(F.col("n") > 2, F.least(F.lit(dimensions), F.greatest(F.lit(2), F.col("width") - 1), F.col("n") - 1)).otherwise(2)
    dockets = texts.groupBy("docket_id").agg(n.alias("n"), width.alias("width"))
    dockets = cut(dockets.select("docket_id", F.ceil(F.col("n") / block_rows).alias("blocks"), "width", F.least(k, "width").cast("int").alias("k")), "dockets")
    rows = texts.join(dockets, "docket_id").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    kind = texts.schema["id"].dataType.simpleString()
    out = rows.where("blocks = 1").groupBy("docket_id").applyInPandas(_local, f"docket_id string, id {kind}, vector array<double>")
    # matrices of one width go through the rounds together: there are at most as many widths as dimensions, and one where dockets are large
    q = F.least(F.col("k") + OVERSAMPLED, "width")
    for w in sorted(r["q"] for r in dockets.where("blocks > 1").select(q.alias("q")).distinct().collect()):
        large = rows.where((F.col("blocks") > 1) & (q == w))
        out = out.unionByName(_in_blocks(large, w).withColumn("id", F.col("id").cast(kind)))
    return out


# neighbours


def packed(vectors: DataFrame, rows: int = NEAR_ROWS) -> DataFrame:
    """docket_id, block, blocks (of the docket), n, ids, v: the vectors (docket_id, id, vector) in blocks of `rows`, in order of their ids. A vector's
    number in its docket is block * 2**32 + its place, so numbers are in order of ids."""
    sizes = vectors.groupBy("docket_id").agg(F.ceil(F.count(F.lit(1)) / rows).alias("blocks"))
    places = small(cut(ranked(vectors.select("docket_id", "id"), ["docket_id"], [F.col("id")], "place"), "places"), PLACES)
    dealt = vectors.select("docket_id", "id", "vector").join(places, ["docket_id", "id"]).join(sizes, "docket_id")
    dealt = dealt.withColumn("block", F.floor((F.col("place") - 1) / rows))
    blocks = dealt.groupBy("docket_id", "block", "blocks").agg(F.sort_array(F.collect_list(F.struct("id", "vector"))).alias("rows"))
    return cut(blocks.select("docket_id", "block", F.col("blocks").cast("int").alias("blocks"), F.size("rows").alias("n"), F.col("rows.id").alias("ids"), F.flatten("rows.vector").alias("v")), "blocks")


def nodes(blocks: DataFrame) -> DataFrame:
    return blocks.select("docket_id", "block", F.posexplode("ids").alias("p", "id")).select("docket_id", "id", (F.shiftleft("block", 32) + F.col("p")).alias("node"))


def _pairs(blocks: DataFrame, part: int = 0, parts: int = 1) -> DataFrame:
    """Every pair of a docket's blocks once, a block with itself included; of those, `part`. Blocks are copied to their pairs before they are
    joined, by the pair's numbers, so a docket of many blocks is dealt out."""
    kept = [c for c in blocks.columns if c not in ("docket_id", "block", "blocks")]
    own = F.pmod(F.col("block") + F.col("pair"), F.lit(parts)) == part
    side = lambda s, pair: blocks.withColumn("pair", F.explode(pair)).where(own).select("docket_id", *pairs_of[s], *(F.col(c).alias(f"{c}_{s}") for c in kept))
    pairs_of = {"a": [F.col("block").alias("block_a"), F.col("pair").alias("block_b")], "b": [F.col("pair").alias("block_a"), F.col("block").alias("block_b")]}
    a = side("a", F.sequence(F.col("block"), F.col("blocks").cast("long") - 1))
    return a.join(side("b", F.sequence(F.lit(0).cast("long"), F.col("block"))), ["docket_id", "block_a", "block_b"])


def pair_parts(blocks: DataFrame) -> int:
    """In how many parts `_pairs` hold about COPIES of the vectors each."""
    copies, all_ = blocks.agg(F.sum(F.col("n").cast("double") * (F.col("blocks") + 1)), F.sum("n")).first()
    return max(1, math.ceil((copies or 0) / (COPIES * (all_ or 1))))


def _matrix(flat: np.ndarray, n: int) -> np.ndarray:
    return np.asarray(flat, np.float64).reshape(n, -1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * a @ b.T
    return np.sqrt(np.where(square < 1e-12, 0, square))


def _strips(p: dict) -> Iterator[tuple[int, np.ndarray]]:
    """Distances of a pair of blocks, a few rows at a time."""
    a, b = _matrix(p["v_a"], p["n_a"]), _matrix(p["v_b"], p["n_b"])
    step = max(1, 4_000_000 // max(len(b), 1))
    for lo in range(0, len(a), step):
        yield lo, distances(a[lo : lo + step], b)


def _each_pair(run, names: list[str]):
    """`run` for each row, as of a pair of blocks, as rows of `names`."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                p = {}
                for name, column in zip(batch.schema.names, batch.columns, strict=True):
                    value = column[i]
                    p[name] = value.values.to_numpy(zero_copy_only=False) if isinstance(value, pa.ListScalar) else value.as_py()
                found = run(p)
                if len(found[0]):
                    rows.append([pa.array([p["docket_id"]] * len(found[0]), pa.string()), *map(pa.array, found)])
            if rows:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(*rows, strict=True)], ["docket_id", *names])

    return wrapped


def _numbers(block: int, n: int) -> np.ndarray:
    return (block << 32) + np.arange(n)


def core_distances(blocks: DataFrame, k: int) -> DataFrame:
    """docket_id, node, core: the distance to the k-th nearest vector of the docket, itself included; of fewer, to the farthest."""

    def nearest(p: dict) -> list[np.ndarray]:
        n, m = p["n_a"], p["n_b"]
        mine, other = np.full((n, k), np.inf), np.full((m, k), np.inf)
        for lo, d in _strips(p):
            few = min(k, m)
            mine[lo : lo + len(d), :few] = np.partition(d, few - 1, axis=1)[:, :few]
            if p["block_a"] != p["block_b"]:
                other = np.partition(np.concatenate([other, d.T], axis=1), k - 1, axis=1)[:, :k]
        rows = [(_numbers(p["block_a"], n), mine)] + ([(_numbers(p["block_b"], m), other)] if p["block_a"] != p["block_b"] else [])
        return [np.concatenate([x for x, _ in rows]), list(np.concatenate([x for _, x in rows]))]

    def part(i: int) -> DataFrame:
        found = _pairs(blocks.drop("ids"), i, parts).mapInArrow(_each_pair(nearest, ["node", "near"]), "docket_id string, node long, near array<double>")
        least = F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k)
        return cut(found.groupBy("docket_id", "node").agg(least.alias("near")), "near") if parts > 1 else found

    parts = pair_parts(blocks)
    found = reduce(DataFrame.unionByName, [part(i) for i in range(parts)])
    near = F.filter(F.sort_array(F.flatten(F.collect_list("near"))), lambda x: x < float("inf"))
    return found.groupBy("docket_id", "node").agg(near.alias("near")).select("docket_id", "node", F.coalesce(F.get("near", F.lit(k - 1)), F.array_max("near")).alias("core"))


# density clusters


def _least_edges(p: dict) -> list[np.ndarray]:
    """Of each component in a pair of blocks its least edge to another component there, by mutual reachability."""
    ca, cb = p["component_a"], p["component_b"]
    na, nb = _numbers(p["block_a"], p["n_a"]), _numbers(p["block_b"], p["n_b"])
    if len(np.unique(np.concatenate([ca, cb]))) == 1:
        return [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]
    best_a, at_a = np.full(len(ca), np.inf), np.zeros(len(ca), np.int64)
    best_b, at_b = np.full(len(cb), np.inf), np.zeros(len(cb), np.int64)
    for lo, d in _strips(p):
        mine = slice(lo, lo + len(d))
        d = np.maximum(np.maximum(d, p["core_a"][mine, None]), p["core_b"][None])
        d[ca[mine, None] == cb[None]] = np.inf
        at_a[mine] = d.argmin(axis=1)
        best_a[mine] = d[np.arange(len(d)), at_a[mine]]
        near = d.argmin(axis=0)
        better = d[near, np.arange(d.shape[1])] < best_b
        best_b[better], at_b[better] = d[near, np.arange(d.shape[1])][better], near[better] + lo
    component, weight = np.concatenate([ca, cb]), np.concatenate([best_a, best_b])
    u, v = np.concatenate([na, nb]), np.concatenate([nb[at_a], na[at_b]])
    u, v = np.minimum(u, v), np.maximum(u, v)
    order = np.lexsort((v, u, weight, component))
    order = order[np.append(True, component[order][1:] != component[order][:-1])]
    order = order[np.isfinite(weight[order])]
    return [component[order], u[order], v[order], weight[order]]


def _find(parent: dict[int, int], x: int) -> int:
    while parent[x] != x:
        parent[x] = x = parent[parent[x]]
    return x


def _merged(group: pd.DataFrame) -> pd.DataFrame:
    """Each component's new one, from a docket's least edges, and the edge by which it came there; an edge that joins nothing (it may be that
    of two components) isn't told."""
    group = group.sort_values(["weight", "u", "v"])
    parent = {int(c): int(c) for c in pd.concat([group["component"], group["other"]])}
    edges = []
    for c, o, u, v, w in group[["component", "other", "u", "v", "weight"]].itertuples(index=False):
        a, b = _find(parent, c), _find(parent, o)
        if a != b:
            parent[max(a, b)] = min(a, b)
            edges.append((c, u, v, w))
    moved = pd.DataFrame({"docket_id": group["docket_id"].iat[0], "component": list(parent), "now": [_find(parent, c) for c in parent]})
    return moved.merge(pd.DataFrame(edges, columns=["component", "u", "v", "weight"]).astype({"u": "Int64", "v": "Int64"}), "left", "component")


def spanning_tree(blocks: DataFrame, cores: DataFrame) -> DataFrame:
    """docket_id, u, v, weight: the least spanning tree of each docket's mutual reachability, by Boruvka rounds.

    Edges are ordered by weight, then by their ends, so equal distances make no circle. Each round gives at most a row for each
    component and pair of blocks, and at least halves the components; dockets of one component are left out.
    """
    state = cut(cores.select("docket_id", F.shiftright("node", 32).alias("block"), "node", "core", F.col("node").alias("component")), "state")
    tree, parts = None, pair_parts(blocks)
    while True:
        open_ = state.groupBy("docket_id").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("docket_id")
        now = state.join(open_, "docket_id").groupBy("docket_id", "block").agg(F.sort_array(F.collect_list(F.struct("node", "core", "component"))).alias("s"))
        now = now.select("docket_id", "block", F.size("s").alias("n"), F.col("s.core").alias("core"), F.col("s.component").alias("component"))
        dealt = blocks.select("docket_id", "block", "blocks", "v").join(now, ["docket_id", "block"])
        least = lambda df: df.groupBy("docket_id", "component").agg(F.min(F.struct("weight", "u", "v")).alias("e")).select("docket_id", "component", "e.*")
        edges = lambda i: _pairs(dealt, i, parts).mapInArrow(_each_pair(_least_edges, ["component", "u", "v", "weight"]), "docket_id string, component long, u long, v long, weight double")  # noqa: E731,B023
        found = [cut(least(edges(i)), "edges") for i in range(parts)]
        found = cut(least(reduce(DataFrame.unionByName, found)), "edges") if parts > 1 else found[0]
        if not found.limit(1).count():
            break
        of = lambda c: state.select("docket_id", F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
        other = F.when(F.col("of_u") == F.col("component"), F.col("of_v")).otherwise(F.col("of_u"))
        moves = found.join(of("u"), ["docket_id", "u"]).join(of("v"), ["docket_id", "v"]).withColumn("other", other)
        moves = cut(moves.groupBy("docket_id").applyInPandas(_merged, "docket_id string, component long, now long, u long, v long, weight double"), "moves")
        joined = moves.where("u is not null").select("docket_id", "u", "v", "weight")
        tree = joined if tree is None else tree.unionByName(joined)
        old = state
        state = cut(state.join(moves.select("docket_id", "component", "now"), ["docket_id", "component"], "left").withColumn("component", F.coalesce("now", "component")).drop("now"), "state")
        discard(old)
    return (tree or found).select("docket_id", "u", "v", "weight")


def condensed(n: int, u: np.ndarray, v: np.ndarray, weight: np.ndarray, least: int) -> np.ndarray:
    """Labels (-1: noise) of n points from the n - 1 edges of their spanning tree, in order of weight: the tree of merges is
    condensed to clusters of at least `least` points, and those are taken whose stability is above that of what they split into."""
    # merges: node n + i joins the nodes below[i] at weight[i]
    parent, below, size = list(range(2 * n - 1)), [], [1] * n + [0] * (n - 1)

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i, (a, b) in enumerate(zip(u.tolist(), v.tolist(), strict=True)):
        a, b = top(a), top(b)
        below.append((a, b))
        size[n + i] = size[a] + size[b]
        parent[a] = parent[b] = n + i
    density = [1 / w if w > 1 / DENSEST else DENSEST for w in weight.tolist()]
    leaves = lambda x: _leaves(x, n, below)
    cluster_of, born, stability, children, fell = {2 * n - 2: 0}, [0.0], [0.0], [[]], [-1] * n
    todo = [2 * n - 2]
    while todo:
        x = todo.pop()
        c, (a, b), at = cluster_of[x], below[x - n], density[x - n]
        large = [y for y in (a, b) if size[y] >= least]
        if len(large) == 2 and at < DENSEST:
            for y in large:
                cluster_of[y] = len(born)
                children[c].append(len(born))
                born.append(at)
                stability.append(0.0)
                children.append([])
            stability[c] += (at - born[c]) * size[x]
        else:
            out = [y for y in (a, b) if y not in large] if at < DENSEST else [a, b]
            for y in out:
                stability[c] += (at - born[c]) * size[y]
                for p in leaves(y):
                    fell[p] = c
            large = [y for y in large if y not in out]
            for y in large:
                cluster_of[y] = c
        todo += [y for y in large if y >= n]
    chosen = [False] * len(born)
    for c in range(len(born) - 1, 0, -1):
        deeper = sum(stability[k] for k in children[c])
        chosen[c] = not deeper > stability[c]
        stability[c] = max(stability[c], deeper)
    # a chosen cluster has all that is below it; the root is none
    label, names = [-1] * len(born), 0
    for c in range(len(born)):
        if label[c] < 0 and chosen[c] and c:
            label[c] = names
            names += 1
        for k in children[c]:
            label[k] = label[c] if label[c] >= 0 else -1
    return np.array([label[c] for c in fell], np.int64)


def _leaves(x: int, n: int, below: list[tuple[int, int]]) -> Iterator[int]:
    todo = [x]
    while todo:
        y = todo.pop()
        if y < n:
            yield y
        else:
            todo += below[y - n]


def density_clusters(vectors: DataFrame, least: int = CLUSTER_SIZE, rows: int = LINKED * NEAR_ROWS) -> DataFrame:
    """docket_id, id, cluster_id (-1: noise) of (docket_id, id, vector): HDBSCAN on Euclidean distances.

    The core distance is that to the `least`-th nearest unit, itself included; clusters are numbered in order of their smallest id.
    Dockets of fewer than 2 * `least` units, or 6, have none. Equal units are as dense as DENSEST and are never told apart.
    """
    enough = vectors.groupBy("docket_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(2 * least, 6)).select("docket_id")
    blocks = packed(vectors.join(enough, "docket_id", "left_semi"), rows)
    cores = cut(core_distances(blocks, least), "cores")
    tree = cut(spanning_tree(blocks, cores), "tree")

    def label(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["weight", "u", "v"])
        numbers, place = np.unique(np.concatenate([g["u"], g["v"]]), return_inverse=True)
        labels = condensed(len(numbers), place[: len(g)], place[len(g) :], g["weight"].to_numpy(), least)
        return pd.DataFrame({"docket_id": g["docket_id"].iat[0], "node": numbers, "label": labels})

    labels = tree.groupBy("docket_id").applyInPandas(label, "docket_id string, node long, label long")
    return _named(vectors, nodes(blocks).join(labels, ["docket_id", "node"]).where("label >= 0").select("docket_id", "id", "label"))


def _named(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """docket_id, id, cluster_id: clusters numbered from 0 in order of their smallest ids, -1 for those without."""
    labels = cut(labels, "labels")
    first = labels.groupBy("docket_id", "label").agg(F.min("id").alias("first"))
    number = first.withColumn("cluster_id", F.row_number().over(Window.partitionBy("docket_id").orderBy("first")) - 1).drop("first")
    own = labels.join(number, ["docket_id", "label"]).select("docket_id", "id", "cluster_id")
    return vectors.select("docket_id", "id").join(own, ["docket_id", "id"], "left").withColumn("cluster_id", F.coalesce("cluster_id", F.lit(-1)))


# average linkage


def _closest(p: dict) -> list[np.ndarray]:
    """Of each cluster in a pair of blocks the closest other one there: one less the product of the means is the mean distance."""
    na, nb = p["cluster_a"], p["cluster_b"]
    a, b = (_matrix(p[f"v_{s}"], p[f"n_{s}"]) / p[f"of_{s}"][:, None] for s in "ab")
    step = max(1, 4_000_000 // len(b))
    found = []
    for lo in range(0, len(a), step):
        d = np.round(1 - a[lo : lo + step] @ b.T, 12)
        d[na[lo : lo + step, None] == nb[None]] = np.inf
        # of equal ones the smallest number: both blocks are in order of numbers
        at, of = d.argmin(axis=1), d.argmin(axis=0)
        found.append((na[lo : lo + step], nb[at], d[np.arange(len(d)), at]))
        if p["block_a"] != p["block_b"]:
            found.append((nb, na[lo : lo + step][of], d[of, np.arange(len(nb))]))
    cluster, other, distance = (np.concatenate(x) for x in zip(*found, strict=True))
    fine = np.isfinite(distance)
    return [cluster[fine], other[fine], distance[fine]]


def _joined(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of each place the smallest one that it is connected with, after the places i and j are as well."""
    while True:
        a, b = root[i], root[j]
        open_ = a != b
        if not open_.any():
            return root
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def _connected(below: float):
    def run(p: dict) -> list[np.ndarray]:
        """Of a pair of blocks the vectors that distances under `below` connect there, each with the smallest number of those it is connected with."""
        a, b = (np.asarray(p[f"v_{s}"], np.float32).reshape(p[f"n_{s}"], -1) for s in "ab")
        same = p["block_a"] == p["block_b"]
        number = _numbers(p["block_a"], len(a)) if same else np.concatenate([_numbers(p["block_a"], len(a)), _numbers(p["block_b"], len(b))])
        root = np.arange(len(number))
        # a product of 32 bits may err by this; a connection too many does no harm
        least = np.float32(1 - below - 1.2e-7 * (a.shape[1] + 16))
        step = max(1, 4_000_000 // len(b))
        for lo in range(0, len(a), step):
            i, j = np.divmod(np.flatnonzero(a[lo : lo + step] @ b.T > least), len(b))
            root = _joined(root, i + lo, j if same else j + len(a))
        moved = np.flatnonzero(root != np.arange(len(root)))
        return [number[moved], number[root[moved]]]

    return run


def _chained(below: float):
    def run(p: dict) -> list[np.ndarray]:
        """Each cluster's last one, of clusters in order of their numbers: a chain of closest ones is followed until two are each
        other's, which are merged. Takes about three products of all means with one for each cluster, and memory for the means."""
        number, of, total = p["cluster"], np.array(p["of"], np.float64), _matrix(p["v"], p["n"]).copy()
        # rows of the clusters that may still be merged, and which they are; they stay in order of numbers
        mean, at = total / of[:, None], np.arange(len(of))
        into, left = np.arange(len(of)), np.ones(len(of), bool)
        chain, start = [], 0
        while True:
            if not chain:
                while start < len(at) and not left[start]:
                    start += 1
                if start == len(at):
                    break
                if 2 * np.count_nonzero(left) < len(at):
                    mean, total, of, at, left, start = mean[left], total[left], of[left], at[left], left[left], 0
                chain.append(start)
            x = chain[-1]
            d = np.round(1 - mean @ mean[x], 12)
            d[x] = np.inf
            d[~left] = np.inf
            # of equal ones the smallest number
            y = int(d.argmin())
            if len(chain) == 1 and not d[y] < below:
                # no later cluster is closer than its parts
                left[x] = False
                chain.pop()
                continue
            if d[y] < below and y not in chain:
                chain.append(y)
                continue
            # it is the last but one; by a rounding it may be another that is as close
            y = chain[-2]
            del chain[-2:]
            lo, hi = min(x, y), max(x, y)
            total[lo] += total[hi]
            of[lo] += of[hi]
            mean[lo] = total[lo] / of[lo]
            into[at[hi]], left[hi] = at[lo], False
        while (into[into] != into).any():
            into = into[into]
        return [number, number[into]]

    return run


def _copies(live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`live` with equal unit vectors of a part, whose distance is 0, as one cluster, and (docket_id, cluster, lo) of those merged."""
    length = F.aggregate("sum", F.lit(0.0), lambda t, x: t + x * x)
    keyed = live.withColumn("own", F.when(F.abs(length - 1) < 1e-9, F.lit(-1).cast("long")).otherwise(F.col("cluster")))
    keys = ["docket_id", "part", "own", "sum"]
    first = cut(keyed.groupBy(*keys).agg(F.min("cluster").alias("lo"), F.sum("of").alias("of")), "copies")
    merges = cut(keyed.drop("of").join(first, keys).where("cluster <> lo").select("docket_id", "cluster", "lo"), "merges")
    return first.select("docket_id", "part", F.col("lo").alias("cluster"), F.transform("sum", lambda x: x * F.col("of")).alias("sum"), "of"), merges


def average_linkage(vectors: DataFrame, below: float = AVERAGE_DISTANCE, rows: int = NEAR_ROWS, within: int = WITHIN) -> DataFrame:
    """docket_id, id, cluster_id of (docket_id, id, vector), unit vectors: clusters whose mean cosine distance is under `below` are merged.

    Clusters under that mean have members under it, so one pass over all pairs finds the parts of a docket that such pairs connect, and no cluster
    goes beyond its part. Parts of up to `within` clusters are merged within a task each; larger ones go through rounds until they are that small.
    Each round merges all pairs that are each other's closest, which gives the tree that merging the closest pair each time does:
    a merged cluster is never closer to others than its parts were. So a cluster whose closest one is too far is
    done and leaves the rounds. Of equal distances the smaller numbers come first.
    """
    blocks = packed(vectors, LINKED * rows)
    near = _pairs(blocks.select("docket_id", "block", "blocks", "n", F.col("v").cast("array<float>").alias("v")))
    links = near.mapInArrow(_each_pair(_connected(below), ["node", "other"]), "docket_id string, node long, other long")
    end = lambda c: F.struct("docket_id", F.col(c).alias("node"))
    parts = components(cut(links.select(end("node").alias("a"), end("other").alias("b")), "links"))
    parts = cut(parts.select("node.docket_id", F.col("node.node").alias("cluster"), F.col("root.node").alias("part")), "parts")
    # numbers follow blocks and places; sums of members stand for their means
    size = F.size("ids")
    width = (F.size("v") / size).cast("int")
    members = cut(nodes(blocks).select("docket_id", "id", F.col("node").alias("cluster")), "members")
    each = blocks.select("docket_id", "block", F.posexplode(F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.slice("v", i * width + 1, width))).alias("p", "sum"))
    each = each.select("docket_id", (F.shiftleft("block", 32) + F.col("p")).alias("cluster"), "sum", F.lit(1.0).alias("of"))
    live = cut(each.join(parts, ["docket_id", "cluster"]), "live")
    add = lambda c: F.aggregate(F.slice(c, 2, F.size(c)), F.get(c, F.lit(0)), lambda t, x: F.zip_with(t, x, lambda a, b: a + b))
    into = F.coalesce("lo", "cluster").alias("cluster")
    moved_to = lambda members, merges: cut(members.join(merges, ["docket_id", "cluster"], "left").select("docket_id", "id", into), "members")
    ended, first = None, True
    while True:
        of_part = cut(live.groupBy("docket_id", "part").agg(F.count(F.lit(1)).alias("size")), "sizes")
        whole = live.join(of_part.where(F.col("size") <= within), ["docket_id", "part"]).groupBy("docket_id", "part").agg(F.sort_array(F.collect_list(F.struct("cluster", "of", "sum"))).alias("s"))
        whole = whole.select("docket_id", F.size("s").alias("n"), F.col("s.cluster").alias("cluster"), F.col("s.of").alias("of"), F.flatten("s.sum").alias("v"))
        now = cut(whole.mapInArrow(_each_pair(_chained(below), ["cluster", "lo"]), "docket_id string, cluster long, lo long"), "ended")
        ended = now if ended is None else ended.unionByName(now)
        large = of_part.where(F.col("size") > within).select("docket_id", "part")
        if not large.limit(1).count():
            break
        live = live.join(large, ["docket_id", "part"])
        if first:
            first = False
            live, merges = _copies(live)
            live, members = cut(live, "live"), moved_to(members, merges)
            continue
        sizes = live.groupBy("docket_id").agg(F.ceil(F.count(F.lit(1)) / rows).alias("blocks"))
        dealt = live.join(sizes, "docket_id").withColumn("block", F.pmod(F.xxhash64("cluster"), F.col("blocks")))
        now = dealt.groupBy("docket_id", "block", "blocks").agg(F.sort_array(F.collect_list(F.struct("cluster", "of", "sum"))).alias("s"))
        now = cut(now.select("docket_id", "block", "blocks", F.size("s").alias("n"), F.col("s.cluster").alias("cluster"), F.col("s.of").alias("of"), F.flatten("s.sum").alias("v")), "means")
        found = _pairs(now).mapInArrow(_each_pair(_closest, ["cluster", "other", "distance"]), "docket_id string, cluster long, other long, distance double")
        order = F.struct("distance", F.least("cluster", "other").alias("lo"), F.greatest("cluster", "other").alias("hi"))
        best = cut(found.groupBy("docket_id", "cluster").agg(F.min(order).alias("e")).where(F.col("e.distance") < below), "closest")
        merges = best.groupBy("docket_id", F.col("e.lo").alias("lo"), F.col("e.hi").alias("hi")).agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("docket_id", F.col("hi").alias("cluster"), "lo")
        merges = cut(merges, "merges")
        if not merges.limit(1).count():
            break
        moved = live.join(best.select("docket_id", "cluster"), ["docket_id", "cluster"], "left_semi").join(merges, ["docket_id", "cluster"], "left").select("docket_id", "part", into, "sum", "of")
        before = members
        live = cut(moved.groupBy("docket_id", "part", "cluster").agg(F.collect_list("sum").alias("sums"), F.sum("of").alias("of")).select("docket_id", "part", "cluster", add("sums").alias("sum"), "of"), "live")
        members = moved_to(members, merges)
        discard(before)
    return _named(vectors, moved_to(members, ended).withColumnRenamed("cluster", "label"))
