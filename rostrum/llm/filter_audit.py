"""Filter interaction audit: what each of five filters removes, in every order, from one CUBE over their failure flags.

The filters, on whole texts (null: empty; words are runs of `[^\\x20\\x09-\\x0D]`, case-sensitive):

* A: fewer than 200 words;
* B: fewer distinct words than half the words;
* C: capitals A-Z make more than 3 % of the code points;
* D: the text holds one of `#$%&*|`;
* E: the text is identical to that of a smaller doc_id, in the whole table.

Flags are counted by part first; the CUBE over part and flags runs on those counts. A grouping set stands for a subset of
the filters, and its row with all selected flags false holds what survives the subset, so a subset that nobody survives has
no row and counts 0. Pairs of subsets that differ by one filter then give what that filter removes after the others; every
step of each order is one of those 80 pairs, and a filter's Shapley count is their sum, weighted by how many orders have
the pair.

Rows that are equal but for their number are counted before anything is joined, copies are found by joining each document
with the smallest doc_id of its text (SHA-256), and labels meet counts, so no hot text, doc_id or part gathers in a task.

A null lang is the part ''. A null doc_id is never a copy, is no smaller doc_id and has no label. Repeated rows count each;
of repeated labels any with value 1 counts, null labels don't. Empty texts fail A only (and E, if repeated). Further columns are
ignored. An empty table has no parts and gives no rows.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostrum.llm.common import cut

FILTERS = "ABCDE"
LEAST_WORDS = 200
DISTINCT_PERCENT = 50
CAPITALS_PERCENT = 3
ALL = (1 << len(FILTERS)) - 1


def flags(docs: DataFrame) -> DataFrame:
    """doc_id, part, key (SHA-256 of the text) and the flags A to D of each row of `docs` (doc_id, text, lang)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n, distinct, chars = F.size(words), F.size(F.array_distinct(words)), F.length(text)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return docs.select(
        "doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("key"),
        (n < LEAST_WORDS).alias("A"), (100 * distinct < DISTINCT_PERCENT * n).alias("B"),
        (100 * capitals > CAPITALS_PERCENT * chars).alias("C"), text.rlike("[#$%&*|]").alias("D"),
    )


def counted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, A to E, n, good, toxic: how many documents have those flags, and how many of them those labels."""
    own = ["doc_id", "part", *"ABCD"]
    rows = cut(flags(docs).groupBy("key", *own).agg(F.count(F.lit(1)).alias("n")), "flags")
    first = rows.groupBy("key").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    copy = F.col("first").isNull() & F.col("doc_id").isNotNull()
    rows = rows.join(first, ["key", "doc_id"], "left").withColumn("E", copy).groupBy(*own, "E").agg(F.sum("n").alias("n"))
    has = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(f"is_{c}")
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(has("quality"), has("toxic"))
    of = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    joined = rows.join(known, "doc_id", "left")
    return joined.groupBy("part", *FILTERS).agg(F.sum("n").alias("n"), of("is_quality").alias("good"), of("is_toxic").alias("toxic"))


def survivors(counts: DataFrame) -> DataFrame:
    """part, subset (bit i: filter i is selected), n, good, toxic: what passes all filters of each subset; part null: of all parts."""
    sums = [F.sum(c).alias(c) for c in ("n", "good", "toxic")]
    sets = counts.cube("part", *FILTERS).agg(*sums, F.grouping_id().alias("left_out"), F.grouping("part").alias("whole"))
    passed = ~F.greatest(*(F.coalesce(F.col(f), F.lit(False)) for f in FILTERS))
    # grouping_id has the last column as its lowest bit, and a bit is set for a column that isn't selected
    bits: Column = sum((F.lit(1 << i) * (1 - F.getbit("left_out", F.lit(len(FILTERS) - 1 - i))) for i in range(len(FILTERS))), F.lit(0))
    kept = sets.where(passed).select("part", "whole", bits.cast("int").alias("subset"), "n", "good", "toxic")
    every = counts.select("part").distinct().withColumn("whole", F.lit(0)).unionByName(counts.select(F.lit(None).cast("string").alias("part"), F.lit(1).alias("whole")).distinct())
    every = every.withColumn("subset", F.explode(F.sequence(F.lit(0), F.lit(ALL))))
    same = F.expr("e.part <=> k.part and e.whole = k.whole and e.subset = k.subset")
    zero = lambda c: F.coalesce(f"k.{c}", F.lit(0)).alias(c)
    return every.alias("e").join(kept.alias("k"), same, "left").select("e.part", "e.subset", zero("n"), zero("good"), zero("toxic"))


def steps() -> tuple[list[tuple], list[tuple]]:
    """The 80 pairs (before, after, filter, number of orders that have the pair), and the 600 rows (filter_order, step, before, filter)."""
    last = len(FILTERS) - 1
    size = lambda s: s.bit_count()
    pairs = [(s, s | 1 << i, f, factorial(size(s)) * factorial(last - size(s))) for s in range(ALL + 1) for i, f in enumerate(FILTERS) if not s >> i & 1]
    rows = []
    for order in permutations(FILTERS):
        before = 0
        for k, f in enumerate(order, 1):
            rows.append(("".join(order), k, before, f))
            before |= 1 << FILTERS.index(f)
    return pairs, rows


def filter_audit(docs: DataFrame, labels: DataFrame, whole: bool = False) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: each step of each order
    of the filters, for every part; with `whole` also for all parts together, as part null.

    docs: (doc_id, text, lang); labels: (doc_id, quality, toxic).
    """
    spark = docs.sparkSession
    pairs, rows = steps()
    found = cut(survivors(cut(counted(docs, labels), "counts")), "survivors")
    found = found if whole else found.where("part is not null")
    # both tables are of fixed size
    pairs = F.broadcast(spark.createDataFrame(pairs, "before int, after int, filter string, orders int"))
    rows = F.broadcast(spark.createDataFrame(rows, "filter_order string, step int, before int, filter string"))
    sums = lambda when: [F.col(c).alias(f"{when}_{c}") for c in ("n", "good", "toxic")]
    first = found.select(F.col("part"), F.col("subset").alias("before"), *sums("b")).join(pairs, "before")
    then = found.select(F.col("part").alias("part_"), F.col("subset").alias("after_"), *sums("a"))
    lost = first.join(then, F.expr("part <=> part_ and after = after_")).select(
        "part", "before", "filter", "orders", F.col("a_n").alias("kept"), (F.col("b_n") - F.col("a_n")).alias("removed"),
        (F.col("b_good") - F.col("a_good")).alias("good_lost"), (F.col("b_toxic") - F.col("a_toxic")).alias("toxic_lost"),
    )
    own = Window.partitionBy("part", "filter")
    removed = lambda when: F.sum(F.when(when, F.col("removed")).otherwise(0)).over(own)
    alone = F.bit_count("before") == len(FILTERS) - 1
    lost = lost.withColumns({
        "fails": removed(F.col("before") == 0), "unique_fails": removed(alone), "shapley": F.sum(F.col("removed") * F.col("orders")).over(own),
    })
    return lost.join(rows, ["before", "filter"]).select(
        "part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"),
        "unique_fails", "good_lost", "toxic_lost", "shapley",
    )
