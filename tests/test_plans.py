"""Plans: filters and columns reach the scan, small sides are broadcast, nothing leaves the JVM that needn't."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from rostrum.plans import registry
from rostrum.storage import small


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_filters_and_columns_reach_the_scan(spark, sf):
    text = plan(registry.QUERIES["F1_F4_docket_range"](spark, sf))
    assert "EqualTo(source,src3)" in text and "ReadSchema: struct<doc_id:bigint,source:string,n_chars:bigint>" in text


@pytest.mark.parametrize("name", ["A7_A9_shape", "A11_T19_by_argument", "A18_N1_quota", "T15_structural_pairs", "J14_page_as_of", "N5_J16_W11_T25_watch", "T3_exact_families"])
def test_no_python_and_no_cross_join(spark, sf, name):
    text = plan(registry.QUERIES[name](spark, sf))
    assert not any(k in text for k in ("Python", "Pandas", "Arrow", "CartesianProduct"))


def test_small_broadcasts_only_what_it_counted(spark):
    few, many = spark.range(10).withColumnRenamed("id", "k"), spark.range(5000).withColumnRenamed("id", "k")
    big = spark.range(10_000).select((F.col("id") % 7).alias("k"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in plan(big.join(small(few, 100), "k"))
        assert "BroadcastHashJoin" not in plan(big.join(small(many, 100), "k"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
