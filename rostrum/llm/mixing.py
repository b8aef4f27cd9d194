"""Mixing sources to target weights by subset-sum budget fitting.

Size is a text's number of words. Sources in code point order, null last, weigh 1, 2, 3, repeating; together they take
100 % of all words. A target stops at 3 times its source's size; the excess goes to the others by weight until none is
above: that is min(3 size, level * weight) for one level, found with a running sum over the sources.

A source takes all its documents floor(target / size) times and fits the rest by length: documents are counted by exact
length, each length gives its share of the rest (rounded down), and a bounded-knapsack dynamic programme over bitsets
fills what is missing with further documents by length. Where that doesn't meet the rest, shares are given back, a fourth
of DP_BUDGET and then all of it, and the programme runs again over more documents: a rest of up to DP_BUDGET words is met
as nearly as any choice of documents can, a larger one as nearly as the best of the three. What then is missing still is
given to second and third copies; if the nearest choice beyond the target is nearer, that is taken. Within a length, documents are
selected by a seeded hash of doc_id and text. Groups of one source and length are counted by the hash's leading bits
first, so that only the bucket in which a quota ends is ranked.

Null or empty texts have size 0 and are never taken. Repeated rows are documents of their own; rows of one doc_id and text
are alike to the mix, so which of them it takes isn't told by their further columns. A null doc_id or source is a value like any other. Further columns are kept by `mix`. An empty table gives
an empty mix.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostrum.llm.common import cut, small

WEIGHTS = (1, 2, 3)
MOST = 3
SEED = 20240607
BUCKET_BITS = 8
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target from (source, source_size), one row for each source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(weights)
    weighted = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).cast("double"))
    cap = (most * F.col("source_size")).cast("double")
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = Window.orderBy(F.col("fill"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # sources are full in order of cap / weight; the level is the first at which the rest's weights share what is left
    levels = (
        weighted.withColumn("cap", cap).withColumn("fill", F.col("cap") / F.col("weight"))
        .withColumn("all", F.sum("source_size").over(everything).cast("double"))
        .withColumn("weight_all", F.sum("weight").over(everything))
        .withColumn("cap_before", F.sum("cap").over(filled) - F.col("cap"))
        .withColumn("weight_before", F.sum("weight").over(filled) - F.col("weight"))
        .withColumn("level", (F.col("all") - F.col("cap_before")) / (F.col("weight_all") - F.col("weight_before")))
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("fill"), F.col("level"))).over(everything))
    )
    return levels.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of `counts` documents of each length to take, so that their lengths sum to `budget` or as near below as can be."""
    total = int(lengths @ counts)
    want = min(budget, total)
    best, missing = np.zeros(len(lengths), np.int64), max(want, 0)
    if want <= 0:
        return best
    for given_back in (0, DP_BUDGET // 4, DP_BUDGET):
        taken = _shares(lengths, counts, max(want - given_back, 0), total)
        left = want - int(lengths @ taken)
        # what is too much for the programme is given out once more by length, the longest first, one each and then all
        for most in (1, None):
            for i in np.argsort(-lengths, kind="stable"):
                if left <= DP_BUDGET:
                    break
                n = min(int(counts[i] - taken[i]), (left - DP_BUDGET) // int(lengths[i]) if lengths[i] else 0, most or want)
                taken[i] += n
                left -= n * int(lengths[i])
        taken = taken + knapsack(lengths, counts - taken, left)
        short = want - int(lengths @ taken)
        if short < missing or given_back == 0:
            best, missing = taken, short
        if missing == 0 or given_back >= want:
            break
    return best


def _shares(lengths: np.ndarray, counts: np.ndarray, budget: int, total: int) -> np.ndarray:
    """Of each length the share budget / total of its documents, rounded down."""
    return counts * budget // total if total < 2**31 else np.array([int(c) * budget // total for c in counts], np.int64)


#: Budgets up to this are filled by dynamic programming.
DP_BUDGET = 1 << 15


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Bounded subset sum: counts of each length that sum to the largest reachable total up to `budget`."""
    taken = np.zeros(len(lengths), np.int64)
    mask = (1 << (budget + 1)) - 1
    reach, steps = 1, []
    for i in np.flatnonzero((lengths > 0) & (lengths <= budget) & (counts > 0)):
        if reach >> budget & 1:
            break
        size, n, part = int(lengths[i]), min(int(counts[i]), budget // int(lengths[i])), 1
        while n > 0:  # 1, 2, 4 ... documents at once
            k = min(part, n)
            steps.append((int(i), k, reach))
            reach |= reach << (size * k) & mask
            n, part = n - k, part * 2
    total = reach.bit_length() - 1
    for i, k, before in reversed(steps):
        if not before >> total & 1:
            total -= int(lengths[i]) * k
            taken[i] += k
    return taken


def _fit_source(pdf: pd.DataFrame) -> pd.DataFrame:
    source_size, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
    pdf = pdf.sort_values("size", ignore_index=True)
    whole = int(target // source_size) if source_size else 0
    gap = int(round(target - whole * source_size))
    lengths, counts = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
    more = np.zeros(len(lengths), np.int64)
    # one copy more of some documents; where that can't reach the target, a second and third of the shorter ones
    for _ in range(MOST - whole):
        got = fit(lengths, counts, gap)
        more += got
        gap -= int(lengths @ got)
        if gap <= 0 or not got.any():
            break
    # the nearest choice beyond the target leaves the most that fits into what lies beyond it; taken if that is nearer
    if gap > 0:
        most = counts * (MOST - whole)
        aim = int(lengths @ more) + gap
        over = most - fit(lengths, most, int(lengths @ most) - aim)
        if int(lengths @ over) - aim < gap:
            more = over
    return pd.DataFrame({"source": pdf["source"], "size": pdf["size"], "source_size": source_size, "target": target, "whole": whole + more // np.maximum(counts, 1), "more": more % np.maximum(counts, 1)})


def sized(docs: DataFrame) -> DataFrame:
    """`docs` with size, the seeded hash h and its leading bits, bucket."""
    h = F.xxhash64("doc_id", "text", F.lit(SEED))
    return docs.withColumns({"size": size_of(F.col("text")), "h": h, "bucket": F.shiftrightunsigned(h, 64 - BUCKET_BITS)})


def quotas(lengths: DataFrame) -> DataFrame:
    """For each source and size of `lengths` (source, size, bucket): source_size, target, whole (times that each document is
    taken) and the one document more that each gets in the buckets before `edge`, and `quota` documents of `edge_n` in it."""
    counted = cut(lengths.groupBy("source", "size", "bucket").agg(F.count(F.lit(1)).alias("n")), "counts")
    totals = counted.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    aims = cut(targets(totals), "targets").withColumnRenamed("source", "s")
    by_size = counted.groupBy("source", "size").agg(F.sum("n").alias("n"))
    by_size = by_size.join(small(aims, 200_000), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    fitted = by_size.groupBy("source").applyInPandas(_fit_source, "source string, size long, source_size long, target double, whole long, more long")
    fitted = fitted.withColumnsRenamed({"source": "s", "size": "z"})
    before = F.sum("n").over(Window.partitionBy("source", "size").orderBy("bucket")) - F.col("n")
    got = F.least(F.greatest(F.col("more") - F.col("before"), F.lit(0)), F.col("n"))
    shares = counted.withColumn("before", before).join(fitted, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))).withColumn("got", got)
    edge = F.min(F.when(F.col("got") < F.col("n"), F.struct("bucket", "got", "n")))
    out = shares.groupBy("s", "z", "source_size", "target", "whole").agg(edge.alias("e"))
    return out.select(
        "s", "z", "source_size", "target", "whole",
        F.coalesce("e.bucket", F.lit(1 << BUCKET_BITS)).alias("edge"), F.coalesce("e.got", F.lit(0)).alias("quota"),
    )


def choose(rows: DataFrame, shares: DataFrame) -> DataFrame:
    """`rows` (as `sized` gives them) with source_size, target and copies, how many times the mix takes the row."""
    joined = rows.join(small(shares, 200_000), F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")))
    ranked = (F.col("bucket") == F.col("edge")) & (F.col("quota") > 0)
    rank = F.row_number().over(Window.partitionBy("source", "size").orderBy("h", "doc_id"))
    edge = joined.where(ranked).withColumn("copies", F.col("whole") + (rank <= F.col("quota")).cast("long"))
    rest = joined.where(~ranked).withColumn("copies", F.col("whole") + (F.col("bucket") < F.col("edge")).cast("long"))
    both = edge.unionByName(rest).withColumn("copies", F.when(F.col("size") > 0, F.col("copies")).otherwise(0))
    return both.drop("s", "z", "whole", "edge", "quota", "h", "bucket")


def mixture(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of `docs` (doc_id, text, source)."""
    rows = cut(sized(docs.select("doc_id", "source", "text")).drop("text"), "sizes")
    found = choose(rows, cut(quotas(rows.select("source", "size", "bucket")), "quotas"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The rows of `docs` (doc_id, text, source and any other columns), each as many times as the mix takes it."""
    own = {c: f"_own_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "source")}
    rows = sized(docs.withColumnsRenamed(own))
    shares = cut(quotas(rows.select("source", "size", "bucket")), "quotas")
    taken = choose(rows, shares).where("copies > 0")
    repeated = taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return repeated.select(*(F.col(own.get(c, c)).alias(c) for c in docs.columns))
