"""Proposed against final text, section by section."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.functions import text as tx
from rostrum.operators.parsing import register

STORED = 20_000


def split(documents: DataFrame) -> DataFrame:
    """docket_id, section, title, body of (docket_id, text)."""
    register(documents.sparkSession)
    return documents.sparkSession.sql("select d.docket_id, s.* from {d} d, lateral sections(d.text) s", d=documents)


def compare(proposed: DataFrame, final: DataFrame) -> DataFrame:
    """The textdiff table from two tables of sections (docket_id, section, body)."""
    a = proposed.select("docket_id", "section", F.col("body").alias("a"))
    b = final.select("docket_id", "section", F.col("body").alias("b"))
    joined = a.join(b, ["docket_id", "section"], "full")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    ratio = joined.withColumn("ratio", F.when(both, tx.word_similarity(F.coalesce("a", F.lit("")), F.coalesce("b", F.lit("")))).otherwise(0.0))
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise(tx.change_kind(F.col("ratio")))
    return ratio.select(
        "docket_id", "section", tx.sort_key(F.col("section")).alias("sort_key"), kind.alias("change_kind"), F.bround("ratio", 4).alias("similarity"),
        F.bround(1 - F.col("ratio"), 4).alias("magnitude"), tx.word_count(F.col("a")).alias("words_proposed"), tx.word_count(F.col("b")).alias("words_final"),
        F.substring("a", 1, STORED).alias("proposed_text"), F.substring("b", 1, STORED).alias("final_text"),
    )
