"""Watch list: what state each rulemaking is in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostrum.functions import text as tx

#: States from the most actionable on.
STATES = ("open", "analyzable", "closed")


def docket_of(raw: Column) -> Column:
    return F.coalesce(tx.normalize_id(raw), raw)


def finalized(finals: DataFrame) -> DataFrame:
    """The earliest final rule of each docket: later entries of a newest-first list win."""
    rows = finals.select("document_number", "publication_date", F.explode("docket_ids").alias("raw")).withColumn("docket_id", docket_of(F.col("raw")))
    return rows.groupBy("docket_id").agg(F.min(F.struct("publication_date", "document_number")).alias("f")).select("docket_id", F.col("f.document_number").alias("final_document"), F.col("f.publication_date").alias("final_date"))


def scan(proposals: DataFrame, finals: DataFrame, pulled: DataFrame, today: Column) -> DataFrame:
    """One row for each docket: its most actionable proposal, with days left and whether its comments are here."""
    raw = F.element_at("docket_ids", 1)
    rows = proposals.where(F.size("docket_ids") > 0).withColumns({"docket_id": docket_of(raw), "id_ok": tx.normalize_id(raw).isNotNull(), "days_left": F.datediff(F.col("comments_close_on").try_cast("date"), today)})
    rows = rows.join(finalized(finals), "docket_id", "left")
    status = F.when(F.col("final_document").isNotNull(), "analyzable").when(F.col("days_left") >= 0, "open").otherwise("closed")
    note = (
        F.when(F.col("final_document").isNotNull(), F.concat(F.lit("final rule "), F.col("final_date").cast("string")))
        .when(F.col("days_left") == 0, "closes today").when(F.col("days_left") > 0, F.concat(F.col("days_left").cast("string"), F.lit(" days to comment")))
        .otherwise("comment period over, no final rule yet")
    )
    rows = rows.withColumns({"status": status, "note": note}).withColumn("rank", F.array_position(F.array(*map(F.lit, STATES)), F.col("status")))
    first = F.row_number().over(Window.partitionBy("docket_id").orderBy("rank", F.desc("publication_date"), "document_number"))
    best = rows.withColumn("first", first).where("first = 1")
    have = pulled.select("docket_id").distinct().withColumn("here", F.lit(True))
    return best.join(have, "docket_id", "left").select(
        "docket_id", "document_number", "days_left", "status", "note", "final_document", "id_ok", F.coalesce("here", F.lit(False)).alias("pulled"),
        F.coalesce("days_left", F.lit(999)).alias("order_days"), "rank",
    )


def ordered(scanned: DataFrame) -> DataFrame:
    return scanned.orderBy("rank", "order_days", "docket_id")


def counts(scanned: DataFrame) -> DataFrame:
    return scanned.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def closing_soon(proposals: DataFrame, today: Column, days: int = 30) -> DataFrame:
    left = F.datediff(F.col("comments_close_on").try_cast("date"), today)
    rows = proposals.where(F.size("docket_ids") > 0).withColumn("days_left", left).where(F.col("days_left").between(0, days))
    return rows.select(docket_of(F.element_at("docket_ids", 1)).alias("docket_id"), "document_number", "days_left").orderBy("days_left", "docket_id")
