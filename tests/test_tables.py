"""Stored tables in buckets: what a change touches, what a failed one leaves, and tables of the older layout."""

import random

import pytest
from pyspark.sql import functions as F

from rostrum import schema
from rostrum.sources.tables import Tables


def files(table, name):
    return {r[0] for r in table.read(name).select(F.input_file_name()).distinct().collect()}


def dockets(spark, ids, title):
    return spark.createDataFrame([(i, title) for i in ids], "docket_id string, title string")


def test_an_upsert_rewrites_the_buckets_that_it_touches(spark, tmp_path):
    t = Tables(spark, str(tmp_path), buckets=8)
    ids = [f"d{i}" for i in range(60)]
    t.upsert("dockets", dockets(spark, ids, "first"))
    before, places = files(t, "dockets"), t.manifest("dockets", 0)
    assert len(places) == 8 and len(before) == 8
    t.upsert("dockets", dockets(spark, ["d3", "new"], "second"))
    after, now = files(t, "dockets"), t.manifest("dockets", 1)
    changed = {b for b in now if now[b] != places[b]}
    assert len(changed) in (1, 2) and before & after == {f for f in before if int(f.split("_bucket=")[1].split("/")[0]) not in changed}
    got = {r.docket_id: r.title for r in t.read("dockets").collect()}
    assert got == {**dict.fromkeys(ids, "first"), "d3": "second", "new": "second"}


def test_a_failed_change_leaves_the_version_before(spark, tmp_path):
    t = Tables(spark, str(tmp_path), buckets=4)
    t.upsert("dockets", dockets(spark, ["a", "b", "c"], "x"))
    broken = dockets(spark, ["a", "z"], "y").withColumn("title", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        t.upsert("dockets", broken)
    assert {(r.docket_id, r.title) for r in t.read("dockets").collect()} == {("a", "x"), ("b", "x"), ("c", "x")} and t.versions("dockets") == [0]
    t.upsert("dockets", dockets(spark, ["a"], "y"))
    assert {(r.docket_id, r.title) for r in t.read("dockets").collect()} == {("a", "y"), ("b", "x"), ("c", "x")}


def test_random_changes_as_a_dictionary(spark, tmp_path):
    rng = random.Random(5)
    t, want = Tables(spark, str(tmp_path), buckets=5), {}
    ddl = "docket_id string, comment_id string, campaign_id string"
    for step in range(5):
        rows = {(f"d{rng.randrange(6)}", f"c{rng.randrange(9)}"): str(step) for _ in range(12)}
        df = spark.createDataFrame([(*k, v) for k, v in rows.items()], ddl)
        if step % 2:
            gone = f"d{rng.randrange(6)}"
            t.refresh("dedup", df, spark.createDataFrame([(gone,)], "d string"))
            scopes = {k[0] for k in rows} | {gone}
            want = {k: v for k, v in want.items() if k[0] not in scopes} | rows
        else:
            t.upsert("dedup", df)
            want |= rows
        assert {(r.docket_id, r.comment_id): r.campaign_id for r in t.read("dedup").collect()} == want
    assert len(t.versions("dedup")) == 2
    t.refresh("dedup", df.limit(0), spark.createDataFrame([(f"d{i}",) for i in range(6)], "d string"))
    assert t.read("dedup").count() == 0
    t.upsert("dedup", df)
    assert t.read("dedup").count() == len(rows)


def test_tables_without_manifest_are_taken_over(spark, tmp_path):
    schema.align(dockets(spark, ["a", "b"], "old"), schema.table_schema("dockets")).drop("agency").write.parquet(f"{tmp_path}/dockets/v000000003")
    t = Tables(spark, str(tmp_path))
    assert {(r.docket_id, r.title, r.agency) for r in t.read("dockets").collect()} == {("a", "old", None), ("b", "old", None)}
    t.upsert("dockets", dockets(spark, ["b"], "new"))
    t.upsert("dockets", dockets(spark, ["c"], "new"))
    assert {(r.docket_id, r.title) for r in t.read("dockets").collect()} == {("a", "old"), ("b", "new"), ("c", "new")}
    assert not (tmp_path / "dockets" / "v000000003").exists()
    for _ in range(2):
        t.log("stage", "detail")
    assert t.read("runlog").count() == 2
