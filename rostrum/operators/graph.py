"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014), all in DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum.storage import cut, small

#: Up to this many nodes are broadcast with their minima; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: With how many centers a node is compared before its other candidates.
CENTERS = 4
#: Candidates that meet are gone through in parts of about so many rows for each row of the buckets, or LEAST_MET.
MET = 4
LEAST_MET = 2_000_000


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root) for every node of `edges` (a, b of one orderable type); root is the component's smallest node.

    Nulls and loops are ignored. Every round is written to the shared folder, so no lineage grows.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    edges = cut(edges, "edges")
    state = None
    for _ in range(rounds):
        both = edges.select(F.col("v").alias("n"), F.col("u").alias("m")).unionByName(edges.select(F.col("u").alias("n"), F.col("v").alias("m")))
        # minima are summed before their shuffle and cut off, so that a hub's part of the joins can be split
        low = cut(both.groupBy("n").agg(F.min("m").alias("low")).select("n", F.least("n", "low").alias("low")), "minima")
        large = both.join(small(low, BROADCAST_ROWS), "n").where("m > n").select(F.col("m").alias("v"), F.col("low").alias("u"))
        large = cut(large.where("v <> u").distinct(), "edges")
        least = cut(large.groupBy("v").agg(F.min("u").alias("low")), "minima")
        star = large.join(small(least, BROADCAST_ROWS), "v").select("v", "u", "low")
        star = star.select(F.explode(F.array(F.struct(F.col("v").alias("v"), F.col("low").alias("u")), F.struct(F.col("u").alias("v"), F.col("low").alias("u")))).alias("e")).select("e.*")
        edges = cut(star.where("v <> u").distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("v", "u")), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    nodes = edges.groupBy("v").agg(F.min("u").alias("root")).select(F.col("v").alias("node"), "root")
    return nodes.unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def linked(left: DataFrame, right: DataFrame, verify: Callable[[DataFrame], DataFrame], may: Column) -> DataFrame:
    """(node, root) of all nodes that verified candidates connect, as `components` gives them, without listing the candidates.

    left, right: (bucket, node, n, place), a node once in a bucket. Candidates are a node of `left` and another node of `right` in one bucket; `verify`
    keeps the rows of (a, na, b, nb, ..) that are linked, and `may` tells from (na, nb, met, pa, pb), the number of buckets in which two nodes meet
    and their last places there, whether they may be; a link may be refused as (a, b) if it isn't as (b, a). A node first meets the CENTERS commonest ones among the first nodes of its buckets. Then nodes
    meet whose components still differ, which are grouped by component before they are joined: a bucket of one component, however
    large, makes no candidates. Each candidate is verified or lies in one component, so no link is lost.
    """
    size = F.struct("n", "node")
    first = right.groupBy("bucket").agg(F.min(size).alias("c"))
    near = left.unionByName(right).select("bucket", "node", "n").distinct().join(first, "bucket").where("c.node <> node").groupBy("node", "n", "c").agg(F.count(F.lit(1)).alias("times"))
    near = near.groupBy("node", "n").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("times")).alias("t"), "c"))), 1, CENTERS).alias("cs"))
    near = near.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.explode("cs.c").alias("c")).select(F.col("c.node").alias("a"), F.col("c.n").alias("na"), "b", "nb")
    parts = cut(components(verify(near).select("a", "b")), "parts")

    known = small(parts, BROADCAST_ROWS)
    xs, ys = (t.join(known, "node", "left").withColumn("root", F.coalesce("root", "node")) for t in (left, right))
    x = cut(xs.select("bucket", F.col("root").alias("ra"), F.col("node").alias("a"), F.col("n").alias("na"), F.col("place").alias("pa")), "x")
    y = cut(ys.select("bucket", F.col("root").alias("rb"), F.col("node").alias("b"), F.col("n").alias("nb"), F.col("place").alias("pb")), "y")
    between = cut(x.select("bucket", "ra").distinct().join(y.select("bucket", "rb").distinct(), "bucket").where("ra <> rb"), "between")
    # they are few that may be linked, of many that meet: those go by parts of `a`, and are written before anything is joined to them
    one, none = F.lit(1).cast("double"), F.lit(0).cast("double")
    of_root = x.select("bucket", F.col("ra").alias("r"), one.alias("x"), none.alias("y")).unionByName(y.select("bucket", F.col("rb").alias("r"), none.alias("x"), one.alias("y")))
    of_root = of_root.groupBy("bucket", "r").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).groupBy("bucket").agg((F.sum("x") * F.sum("y") - F.sum(F.col("x") * F.col("y"))).alias("met"))
    parts_of_a = int(max(1, -(-(of_root.agg(F.sum("met")).first()[0] or 0) // max(LEAST_MET, MET * y.count()))))

    def candidates(part: int) -> DataFrame:
        own = x.where(F.pmod(F.xxhash64("a"), F.lit(parts_of_a)) == part)
        met = between.join(own, ["bucket", "ra"]).join(y, ["bucket", "rb"]).groupBy("a", "na", "b", "nb").agg(F.count(F.lit(1)).alias("met"), F.max("pa").alias("pa"), F.max("pb").alias("pb"))
        return cut(met.where(may).select("a", "na", "b", "nb"), "candidates")

    rest = reduce(DataFrame.unionByName, [candidates(i) for i in range(parts_of_a)])
    rest = cut(verify(rest).select("a", "b"), "links")
    of = lambda c, r: known.select(F.col("node").alias(c), F.col("root").alias(r))
    rest = rest.join(of("a", "ra"), "a", "left").join(of("b", "rb"), "b", "left").select("a", F.coalesce("ra", "a").alias("ra"), "b", F.coalesce("rb", "b").alias("rb"))
    if not rest.limit(1).count():
        return parts
    merged = components(rest.select(F.col("ra").alias("a"), F.col("rb").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("low"))
    every = parts.unionByName(rest.select(F.col("a").alias("node"), F.col("ra").alias("root"))).unionByName(rest.select(F.col("b").alias("node"), F.col("rb").alias("root")))
    return every.distinct().join(merged, "root", "left").select("node", F.coalesce("low", "root").alias("root"))
