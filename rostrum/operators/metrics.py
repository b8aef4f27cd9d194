"""Outcome metrics over analysis units: every figure is a DataFrame keyed by docket, so all dockets come in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostrum.functions import text as tx
from rostrum.operators.ranks import median, null_safe, order_statistic, ranked
from rostrum.storage import cut, small

#: Figures of up to so many dockets are broadcast to their units.
DOCKETS = 100_000

#: The reporting bands of significance.
BANDS = ((0, 19), (20, 39), (40, 59), (60, 79), (80, 100))
CHANGED = ("modified", "rewritten", "added", "removed")
HIGH = 60
DISCRIMINATING = 0.80
STANDOUT = 0.60


def base(comments: DataFrame, dedup: DataFrame, analysis: DataFrame, linkage: DataFrame, responses: DataFrame) -> DataFrame:
    """Units left-joined to their analysis, their link and its response. Responses are few; they're broadcast if counted small."""
    units = comments.join(dedup.drop("docket_id"), "comment_id").where(F.col("campaign_id").isNull() | F.col("is_exemplar"))
    joined = units.join(analysis, "comment_id", "left").join(linkage, "comment_id", "left")
    return joined.join(small(responses.select("response_id", "fr_page"), 100_000), "response_id", "left")


def is_answered() -> Column:
    return F.col("response_id").isNotNull()


def of_docket(rows: DataFrame, figures: DataFrame) -> DataFrame:
    """`rows` with the figures of their docket, if it has any; a null docket is one like others."""
    return rows.join(small(null_safe(figures, ["docket_id"]), DOCKETS), F.col("docket_id").eqNullSafe(F.col("_of_docket_id")), "left").drop("_of_docket_id")


def shape(units: DataFrame) -> DataFrame:
    """Per docket: units, analysed, with attachments, campaigns, median length, linked, response rate."""
    units = cut(units.select("docket_id", "significance", "n_attachments", "campaign_id", "n_chars", "response_id"), "units")
    found = units.groupBy("docket_id").agg(
        F.count(F.lit(1)).alias("units"),
        F.count("significance").alias("analyzed"),
        F.count_if(F.col("n_attachments") > 0).alias("with_attachments"),
        F.count("campaign_id").alias("campaigns"),
        F.count("response_id").alias("linked"),
        F.round(F.avg(is_answered().cast("double")), 4).alias("response_rate"),
    )
    middle = median(units, ["docket_id"], F.col("n_chars"), "middle")
    joined = of_docket(found, cut(middle, "medians"))
    return joined.select("docket_id", "units", "analyzed", "with_attachments", "campaigns", F.floor("middle").cast("long").alias("median_chars"), "linked", "response_rate")


def histogram(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy("docket_id", F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def by_band(units: DataFrame) -> DataFrame:
    """Response rate by significance band; empty bands stay, with a null rate."""
    label = None
    for lo, hi in BANDS:
        test = F.col("significance").between(lo, hi)
        label = F.when(test, f"{lo}-{hi}") if label is None else label.when(test, f"{lo}-{hi}")
    facts = units.select("docket_id", label.alias("band"), is_answered().alias("a")).groupBy("docket_id", "band").agg(F.count(F.lit(1)).alias("n"), F.count_if("a").alias("answered"))
    every = units.select("docket_id").distinct().withColumn("band", F.explode(F.array(*(F.lit(f"{lo}-{hi}") for lo, hi in BANDS))))
    joined = every.join(facts, ["docket_id", "band"], "left")
    n = F.coalesce("n", F.lit(0))
    return joined.select("docket_id", "band", n.alias("n"), F.coalesce("answered", F.lit(0)).alias("answered"), F.when(n > 0, F.round(F.col("answered") / n, 4)).alias("rate"))


def by_argument(units: DataFrame) -> DataFrame:
    """Which grounds move an agency; a tag given twice counts twice."""
    tags = units.where("significance is not null").select("docket_id", "verdict", is_answered().alias("a"), F.explode(tx.json_list(F.col("argument_types"))).alias("type"))
    got = lambda v: F.count_if(F.col("a") & (F.col("verdict") == v))
    agg = tags.groupBy("docket_id", "type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("a").alias("answered"), got("accepted").alias("accepted"), got("partial").alias("partial"), got("rejected").alias("rejected")
    )
    return agg.withColumns({
        "rate": F.round(F.col("answered") / F.col("n"), 4),
        "thin": F.col("n") < 10,
        "win": F.when(F.col("answered") > 0, F.round((F.col("accepted") + 0.5 * F.col("partial")) / F.col("answered"), 4)),
    })


def contested_provisions(units: DataFrame, top: int = 12) -> DataFrame:
    """The most cited provisions of each docket; one comment counts a provision once."""
    cited = units.where("significance is not null").select("docket_id", is_answered().alias("a"), F.explode(F.array_distinct(tx.json_list(F.col("provisions")))).alias("provision"))
    counts = cited.groupBy("docket_id", "provision").agg(F.count(F.lit(1)).alias("n"), F.count_if("a").alias("answered"))
    place = F.row_number().over(Window.partitionBy("docket_id").orderBy(F.desc("n"), "provision"))
    return counts.withColumn("place", place.cast("long")).where(F.col("place") <= top)


def evidence(units: DataFrame) -> DataFrame:
    known = units.where("significance is not null")
    return known.groupBy("docket_id", F.coalesce("novel_evidence", F.lit(False)).alias("with_evidence")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(is_answered().cast("double")), 4).alias("rate")
    )


def orphans(responses: DataFrame, documents: DataFrame, linkage: DataFrame) -> DataFrame:
    """Responses of a docket's own document that no comment is linked to."""
    own = responses.join(small(documents, 100_000), F.col("fr_doc_number") == F.col("document_id"))
    linked = linkage.where("response_id is not null").select("response_id").distinct()
    return own.join(linked, "response_id", "left_anti").groupBy("docket_id").agg(F.count(F.lit(1)).alias("orphans"))


def _moved(diffs: DataFrame) -> DataFrame:
    return diffs.where(F.col("change_kind").isin(*CHANGED)).select("docket_id", "section", F.coalesce("magnitude", F.lit(0.0)).alias("magnitude"))


def diff_summary(diffs: DataFrame) -> DataFrame:
    """Base rates of section changes; the median is the upper one."""
    moved = F.col("change_kind").isin(*CHANGED)
    middle = order_statistic(_moved(diffs), ["docket_id"], F.col("magnitude"), F.floor(F.col("n") / 2) + 1).select("docket_id", F.round("value", 4).alias("median_magnitude"))
    agg = diffs.groupBy("docket_id").agg(F.count(F.lit(1)).alias("sections"), F.count_if(moved).alias("changed"))
    rate = F.col("changed") / F.col("sections")
    return of_docket(agg, cut(middle, "medians")).select(
        "docket_id", "sections", "changed", F.round(rate, 4).alias("change_rate"), F.coalesce("median_magnitude", F.lit(0.0)).alias("median_magnitude"),
        (rate < DISCRIMINATING).alias("discriminating"),
    )


def standout_floor(diffs: DataFrame) -> DataFrame:
    """docket_id, floor: on a wholesale rewrite, the magnitude that a section must reach to count as evidence."""
    at = order_statistic(_moved(diffs), ["docket_id"], F.col("magnitude"), F.floor(F.col("n") * STANDOUT) + 1)
    totals = diffs.groupBy("docket_id").agg(F.count(F.lit(1)).alias("sections"))
    wholesale = (F.col("n") / F.col("sections") >= DISCRIMINATING) & (F.col("n") >= 4)
    return of_docket(totals, cut(at, "floors")).select("docket_id", F.when(wholesale, F.col("value")).otherwise(0.0).alias("floor"))


def outcome_map(units: DataFrame, diffs: DataFrame) -> DataFrame:
    """docket_id, comment_id, n, top_magnitude: cited sections that changed by the floor or more."""
    cited = units.select("docket_id", "comment_id", F.explode(tx.json_list(F.col("provisions"))).alias("p")).withColumn("section", tx.section_of(F.col("p"))).where("section is not null")
    hits = cited.join(_moved(diffs), ["docket_id", "section"]).join(small(cut(standout_floor(diffs), "floors"), DOCKETS), "docket_id").where("magnitude >= floor")
    return hits.groupBy("docket_id", "comment_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("magnitude"), 3).alias("top_magnitude"))


def outcome_grid(units: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Per docket: answered and changed, answered only, changed only, neither."""
    flagged = units.select("docket_id", "comment_id", is_answered().alias("a")).join(outcomes.select("comment_id", F.lit(True).alias("m")), "comment_id", "left")
    a, m = F.col("a"), F.coalesce("m", F.lit(False))
    return flagged.groupBy("docket_id").agg(
        F.count_if(a & m).alias("answered_changed"), F.count_if(a & ~m).alias("answered_only"), F.count_if(~a & m).alias("changed_only"), F.count_if(~a & ~m).alias("neither")
    )


def silent_wins(units: DataFrame, outcomes: DataFrame, top: int = 15) -> DataFrame:
    """Unanswered units whose cited text changed, the largest change first."""
    joined = units.where(~is_answered()).join(outcomes.select("comment_id", "n", "top_magnitude"), "comment_id")
    order = [F.desc("top_magnitude"), F.desc(F.coalesce("significance", F.lit(0))), F.col("comment_id")]
    place = F.row_number().over(Window.partitionBy("docket_id").orderBy(*order))
    return joined.withColumn("place", place.cast("long")).where(F.col("place") <= top).select("docket_id", "comment_id", who().alias("who"), "top_magnitude", "place")


def who() -> Column:
    return tx.display_name(F.col("organization"), F.col("submitter"))


def unanswered_significant(units: DataFrame, top: int = 20) -> DataFrame:
    rows = units.where(~is_answered() & (F.col("significance") >= HIGH))
    place = F.row_number().over(Window.partitionBy("docket_id").orderBy(F.desc("significance"), "comment_id"))
    return rows.withColumn("place", place.cast("long")).where(F.col("place") <= top).select("docket_id", "comment_id", who().alias("who"), "significance", "place")


def ledger(units: DataFrame, campaign_sizes: DataFrame, by: str = "unanswered") -> DataFrame:
    """The units of each docket in order: "unanswered" first, then by significance and campaign size; by "weight", the
    campaign size; or by "significance". The bar is the size as a share of the largest."""
    joined = units.join(campaign_sizes, ["docket_id", "campaign_id"], "left").withColumn("size", F.coalesce("size", F.lit(1).cast("long")))
    joined = cut(joined.select("docket_id", "comment_id", who().alias("who"), "size", "significance", is_answered().alias("answered")), "ledger")
    weight, significance = F.desc("size"), F.desc(F.coalesce("significance", F.lit(0)))
    orders = {"unanswered": [F.col("answered").cast("int"), significance, weight], "weight": [weight], "significance": [significance]}
    placed = ranked(joined, ["docket_id"], [*orders[by], F.col("comment_id")], "place")
    top = cut(joined.groupBy("docket_id").agg(F.max("size").alias("top")), "tops")
    bar = F.greatest(F.lit(2), F.round(100 * F.col("size") / F.col("top"))).cast("long")
    return of_docket(placed, top).select("docket_id", "comment_id", "who", "size", "significance", "answered", bar.alias("bar"), F.col("place").cast("long").alias("place"))


def campaign_sizes(dedup: DataFrame) -> DataFrame:
    return dedup.where("campaign_id is not null").groupBy("docket_id", "campaign_id").agg(F.count(F.lit(1)).alias("size"))


def tokens(analysis: DataFrame, comments: DataFrame) -> DataFrame:
    joined = analysis.join(comments.select("comment_id", "docket_id"), "comment_id")
    both = F.sum(F.coalesce("tokens_in", F.lit(0)) + F.coalesce("tokens_out", F.lit(0)))
    return joined.groupBy("docket_id").agg(
        F.coalesce(F.sum("tokens_in"), F.lit(0)).alias("tokens_in"), F.coalesce(F.sum("tokens_out"), F.lit(0)).alias("tokens_out"),
        F.round(both / F.count(F.lit(1))).cast("long").alias("per_unit"),
    )


def docket_stats(comments: DataFrame, dedup: DataFrame, analysis: DataFrame, linkage: DataFrame) -> DataFrame:
    """The tile set of a docket in one pass."""
    joined = comments.select("comment_id", "docket_id").join(dedup.drop("docket_id"), "comment_id", "left")
    joined = joined.join(analysis.select("comment_id", F.lit(1).alias("analyzed"), "tokens_in", "tokens_out"), "comment_id", "left")
    joined = joined.join(linkage.select("comment_id", "response_id").distinct(), "comment_id", "left")
    return joined.groupBy("docket_id").agg(
        F.countDistinct("comment_id").alias("comments"), F.countDistinct("campaign_id").alias("campaigns"),
        F.count_if(F.col("campaign_id").isNull() | F.col("is_exemplar")).alias("units"), F.count("analyzed").alias("analyzed"),
        F.count("response_id").alias("linked"), F.coalesce(F.sum("tokens_in"), F.lit(0)).alias("tokens_in"),
    )
