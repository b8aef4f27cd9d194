"""The rolling quota as state against the batch query, after every micro-batch."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from rostrum.operators import usage
from rostrum.streaming import live


def test_rolling_quota_equals_the_batch(spark, tmp_path):
    rng = random.Random(8)
    ddl = "ts timestamp, service string"
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    (tmp_path / "in").mkdir()
    try:
        stream = live.rolling_quota(spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), "2 hours")
        latest = {}

        def keep(df, _):
            for r in df.collect():
                latest[r.service] = (r.ts, r.used)

        begin, rows, query = datetime(2024, 1, 1), [], None
        for batch in range(4):
            now = begin + timedelta(minutes=25 * batch)
            # some come up to an hour and a half late
            new = [(now - timedelta(seconds=rng.choice([0, 5, 700, 3599, 3600, 3601, 5400])), rng.choice(["a", "b"])) for _ in range(30)]
            rows += new
            spark.createDataFrame(new, ddl).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            if query is None:
                query = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/checkpoint").start()
            query.processAllAvailable()
            batch_rows = usage.rolling(spark.createDataFrame(rows, ddl)).groupBy("service").agg(F.max_by("used", F.struct("ts", "used")).alias("used"), F.max("ts").alias("ts"))
            assert latest == {r.service: (r.ts, r.used) for r in batch_rows.collect()}, batch
        query.stop()
    finally:
        spark.conf.unset(key)
