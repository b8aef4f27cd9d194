"""Campaigns: exact families, near duplicates, templates with inserts. Every submission keeps its row.

Similarity is exact: shingles become 64-bit hashes, candidate pairs come from an inverted index with prefix and size
filters, and overlaps are counted on whole sets. Work runs on one representative for each exact family.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostrum.functions import text as tx
from rostrum.functions.grams import hashed_shingles, hashed_texts
from rostrum.operators.graph import linked
from rostrum.operators.ranks import ranked
from rostrum.storage import cut, discard, small

NEAR = 0.85
CONTAINED = 0.75
LEAST_SHINGLES = 8
SIZE_FACTOR = 4
#: Shingles are counted in so many parts, one after the other, by their hashes; only one part's rows lie on disk at a time.
SHINGLE_PARTS = 4
#: Up to this many ids of copies or members are broadcast to the texts; more are joined by a shuffle.
COPIES = 500_000


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def fingerprints(comments: DataFrame) -> DataFrame:
    """docket_id, comment_id, full_text and exact_hash of every comment with text."""
    return comments.where("full_text is not null").select("docket_id", "comment_id", "full_text", tx.exact_hash(tx.tokens(F.col("full_text"))).alias("exact_hash"))


def hashes(comments: DataFrame) -> DataFrame:
    """docket_id, comment_id, exact_hash and chars, the length of its text, of every comment: null text has no tokens. The hash is that of `fingerprints`."""
    rows = comments.select("docket_id", "comment_id", F.length("full_text").alias("chars"), F.lower(F.coalesce("full_text", F.lit(""))).alias("lower_text"))
    return cut(rows.mapInArrow(hashed_texts, f"docket_id {_kind(comments, 'docket_id')}, comment_id {_kind(comments, 'comment_id')}, chars int, exact_hash string"), "hashes")


def families(hashed: DataFrame) -> DataFrame:
    """One row for each exact family of a docket: rep_id, its size and its representative's text."""
    first = F.min_by(F.struct("comment_id", "full_text"), "comment_id")
    return hashed.groupBy("docket_id", "exact_hash").agg(first.alias("r"), F.count(F.lit(1)).alias("n")).select("docket_id", "exact_hash", F.col("r.comment_id").alias("rep_id"), "n", F.col("r.full_text").alias("full_text"))


def _same(a: str, b: str, *keys: str) -> Column:
    return reduce(Column.__and__, (F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys))


def representatives(comments: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The `hashes` of comments with text; one row for each exact family, as `families` gives them, with its representative's chars in place of the text; and
    docket_id, rep_id, full_text of the representatives. Copies are few or hashed away by their ids: no text is shuffled to find them."""
    comments = comments.where("full_text is not null")
    hashed = hashes(comments)
    family = hashed.groupBy("docket_id", "exact_hash").agg(F.min(F.struct("comment_id", "chars")).alias("r"), F.count(F.lit(1)).alias("n"))
    family = cut(family.select("docket_id", "exact_hash", F.col("r.comment_id").alias("rep_id"), "n", F.col("r.chars").alias("chars")), "families")
    copies = hashed.alias("h").join(family.where("n > 1").alias("f"), _same("h", "f", "docket_id", "exact_hash")).where("comment_id <> rep_id").select("h.docket_id", "h.comment_id")
    copies = small(cut(copies, "copies"), COPIES)
    texts = comments.alias("c").join(copies.alias("d"), _same("c", "d", "docket_id", "comment_id"), "left_anti")
    return hashed, family, texts.select("docket_id", F.col("comment_id").alias("rep_id"), "full_text")


def _sets(reps: DataFrame) -> DataFrame:
    """docket_id, rep_id, n (shingles of the text), s: hashes of those shingles that another text of the docket has too, rarest first.

    A text's shingles that no other has are rarer than all others; they are no part of any overlap and stay behind after the one shuffle that counts.
    That goes by SHINGLE_PARTS, for each of which texts are hashed anew.
    """
    lower = reps.select("docket_id", "rep_id", F.lower(F.coalesce("full_text", F.lit(""))).alias("lower_text"))
    kinds = f"docket_id {_kind(reps, 'docket_id')}, rep_id {_kind(reps, 'rep_id')}, n int, s array<long>"

    def shared(part: int) -> DataFrame:
        rows = lower.mapInArrow(hashed_shingles(tx.SHINGLE, part, SHINGLE_PARTS), kinds).select("docket_id", "rep_id", "n", F.explode("s").alias("shingle"))
        return cut(rows.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("shingle", "docket_id"))).where("df > 1"), "shared")

    parts = [shared(i) for i in range(SHINGLE_PARTS)]
    sets = reduce(DataFrame.unionByName, parts).groupBy("docket_id", "rep_id", "n").agg(F.array_sort(F.collect_set(F.struct("df", "shingle"))).alias("s"))
    sets = cut(sets.select("docket_id", "rep_id", "n", F.col("s.shingle").alias("s")), "sets")
    for part in parts:
        discard(part)
    return sets


def _prefixes(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The `_sets`; and docket_id, shingle, rep_id, n, place, of_x: the first shingles of each text, of_x those on the side of x, in buckets that hold a pair.

    Shingles are ordered by how many documents have them, rarest first; `place` is that among all of the text's. Of a pair in which y
    holds CONTAINED of x (or which is NEAR, which asks for more), one of x's first shingles is among y's first ones, so frequent shingles make no
    pairs.
    """
    sets = _sets(reps)
    m = F.size("s")
    first = lambda share: m - F.ceil(share * F.col("n")) + 1
    own = sets.select("docket_id", "rep_id", "n", first(CONTAINED).alias("of_x"), (F.col("n") - m).alias("alone"), F.slice("s", 1, F.greatest(first(CONTAINED / SIZE_FACTOR), F.lit(0)).cast("int")).alias("s"))
    rows = own.select("docket_id", "rep_id", "n", "of_x", "alone", F.posexplode("s").alias("at", "shingle"))
    rows = rows.select("docket_id", "shingle", "rep_id", "n", (F.col("at") + F.col("alone") + 1).alias("place"), (F.col("at") < F.col("of_x")).alias("of_x"))
    bucket = Window.partitionBy("shingle", "docket_id")
    met = rows.withColumn("all", F.count(F.lit(1)).over(bucket)).withColumn("xs", F.count_if("of_x").over(bucket)).where("all > 1 and xs > 0")
    return sets, cut(met.drop("all", "xs"), "prefixes")


def overlaps(reps: DataFrame) -> DataFrame:
    """docket_id, x, y, shared, nx, ny of the ordered pairs that may be near or contained; the overlap is counted on the whole sets.

    All pairs: `connected` is for those that need the components only.
    """
    sets, rows = _prefixes(reps)
    left = rows.where("of_x").select("docket_id", "shingle", F.col("rep_id").alias("x"), F.col("n").alias("nx"), F.col("place").alias("px"))
    right = rows.select("docket_id", "shingle", F.col("rep_id").alias("y"), F.col("n").alias("ny"), F.col("place").alias("py"))
    lo, hi = F.least("nx", "ny"), F.greatest("nx", "ny")
    may = (lo >= NEAR * hi) | ((F.col("nx") >= LEAST_SHINGLES) & (F.col("ny") >= LEAST_SHINGLES) & (F.col("ny") <= SIZE_FACTOR * F.col("nx")))
    pairs = left.join(right, ["shingle", "docket_id"]).where(F.col("x") != F.col("y")).where(may)
    # what a pair shares beyond the last shingle in which its first ones meet is no more than what either has left
    pairs = pairs.groupBy("docket_id", "x", "y", "nx", "ny").agg(F.count(F.lit(1)).alias("met"), F.max("px").alias("px"), F.max("py").alias("py"))
    pairs = pairs.where(F.col("met") + F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py")) >= CONTAINED * F.col("nx"))
    side = lambda c, name: sets.select("docket_id", F.col("rep_id").alias(c), F.col("s").alias(name))
    both = pairs.join(side("x", "sx"), ["docket_id", "x"]).join(side("y", "sy"), ["docket_id", "y"])
    return both.select("docket_id", "x", "y", F.size(F.array_intersect("sx", "sy")).alias("shared"), "nx", "ny")


def connected(reps: DataFrame) -> DataFrame:
    """docket_id, rep_id, root: components of the near and contained pairs of `overlaps`, without a row for each pair of a campaign."""
    found, prefixes = _prefixes(reps)
    rows = lambda t: t.select(F.struct("docket_id", "shingle").alias("bucket"), F.struct("docket_id", F.col("rep_id").alias("id")).alias("node"), "n", "place")
    sets = lambda c, name: found.select(F.struct("docket_id", F.col("rep_id").alias("id")).alias(c), F.col("s").alias(name))

    lo, hi = F.least("na", "nb"), F.greatest("na", "nb")
    inside = (lo >= LEAST_SHINGLES) & (hi <= SIZE_FACTOR * lo)
    fit = (lo >= NEAR * hi) | inside

    def verify(pairs: DataFrame) -> DataFrame:
        both = pairs.where(fit).join(sets("a", "sa"), "a").join(sets("b", "sb"), "b")
        both = both.withColumn("shared", F.size(F.array_intersect("sa", "sb"))).drop("sa", "sb")
        shared = F.col("shared")
        return both.where((shared >= NEAR * (lo + hi - shared)) | (inside & (shared >= CONTAINED * lo)))

    # as in `overlaps`; of a linked pair the one with fewer shingles, or either, is an x whose first shingles tell
    most = F.col("met") + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    may = fit & (F.col("na") <= F.col("nb")) & (most >= CONTAINED * F.col("na"))
    return linked(rows(prefixes.where("of_x")), rows(prefixes), verify, may).select("node.docket_id", F.col("node.id").alias("rep_id"), F.col("root.id").alias("root"))


def jaccard_edges(pairs: DataFrame, threshold: float = NEAR) -> DataFrame:
    return pairs.where(F.col("x") < F.col("y")).where(F.col("shared") >= threshold * (F.col("nx") + F.col("ny") - F.col("shared")))


def containment_edges(pairs: DataFrame, threshold: float = CONTAINED) -> DataFrame:
    """Directed: most of x lies in y, both long enough, y at most four times as long."""
    fit = (F.col("nx") >= LEAST_SHINGLES) & (F.col("ny") >= LEAST_SHINGLES) & (F.col("ny") <= SIZE_FACTOR * F.col("nx"))
    return pairs.where(fit & (F.col("shared") >= threshold * F.col("nx")))


def placed(family: DataFrame, texts: DataFrame) -> DataFrame:
    """The families of `representatives` with the root of their component, which is their own where they are alone."""
    return family.join(cut(connected(texts), "parts"), ["docket_id", "rep_id"], "left").withColumn("root", F.coalesce("root", "rep_id"))


def numbered(roots: DataFrame) -> DataFrame:
    """`roots` (docket_id, root, ..) with campaign_id: C0001 and so on in order of the roots of each docket."""
    names = ranked(roots.select("docket_id", "root"), ["docket_id"], [F.col("root")], "number")
    return roots.join(names, ["docket_id", "root"]).withColumn("campaign_id", F.format_string("C%04d", F.col("number"))).drop("number")


def detect(comments: DataFrame) -> DataFrame:
    """The dedup table: docket_id, comment_id, exact_hash, campaign_id (null: alone), is_exemplar, template_ratio, insert_text."""
    hashed, family, texts = representatives(comments)
    parts = cut(placed(family, texts), "placed")
    whole = parts.groupBy("docket_id", "root").agg(F.sum("n").alias("size"), F.min(F.struct("chars", "rep_id")).alias("least"))
    named = numbered(cut(whole.where("size > 1").select("docket_id", "root", F.col("least.rep_id").alias("exemplar_id")), "campaigns"))
    member = parts.select("docket_id", "exact_hash", "root").join(named, ["docket_id", "root"])
    joined = cut(hashed.drop("chars").join(member.drop("root"), ["docket_id", "exact_hash"], "left"), "members")
    own = F.col("comment_id") == F.col("exemplar_id")
    # only members other than exemplars are compared, and only their texts and those of exemplars move
    asked = joined.where("campaign_id is not null and comment_id <> exemplar_id").select("docket_id", "comment_id", "exemplar_id")
    theirs = comments.join(small(asked, COPIES), ["docket_id", "comment_id"]).select("docket_id", "comment_id", "exemplar_id", "full_text")
    exemplars = comments.join(small(named.select("docket_id", F.col("exemplar_id").alias("comment_id")), COPIES), ["docket_id", "comment_id"]).select("docket_id", F.col("comment_id").alias("exemplar_id"), F.col("full_text").alias("exemplar"))
    split = theirs.join(exemplars, ["docket_id", "exemplar_id"]).select("docket_id", "comment_id", tx.split_template("exemplar", "full_text").alias("t"))
    split = cut(split.select("docket_id", "comment_id", "t.ratio", F.nullif(F.col("t.insert"), F.lit("")).alias("insert_text")), "split")
    return joined.join(split, ["docket_id", "comment_id"], "left").select(
        "docket_id", "comment_id", "exact_hash", "campaign_id", F.coalesce(own, F.lit(False)).alias("is_exemplar"),
        F.when(F.col("campaign_id").isNull(), 0.0).when(own, 1.0).otherwise(F.col("ratio")).alias("template_ratio"), "insert_text",
    )


def summary(dedup: DataFrame) -> DataFrame:
    n, inside, campaigns = F.count(F.lit(1)), F.count("campaign_id"), F.countDistinct("campaign_id")
    agg = dedup.groupBy("docket_id").agg(n.alias("comments"), campaigns.alias("campaigns"), inside.alias("in_campaigns"), F.count("insert_text").alias("personal_inserts"))
    units = F.col("comments") - F.col("in_campaigns") + F.col("campaigns")
    return agg.select("*", (F.col("comments") - F.col("in_campaigns")).alias("singletons"), units.alias("units_to_analyze"), F.bround(1 - units / F.greatest(F.col("comments"), F.lit(1)), 4).alias("reduction"))


def siblings(dedup: DataFrame, docket_id: str, campaign_id: str, top: int = 25) -> DataFrame:
    """Members of a campaign with words of their own."""
    return dedup.where((F.col("docket_id") == docket_id) & (F.col("campaign_id") == campaign_id) & F.col("insert_text").isNotNull()).orderBy("comment_id").limit(top)
