"""Quota, spend and cost projections over the API call log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PER_HOUR = 950
LINKAGE_SHARE = 0.9


def prices(spark, table: dict[str, tuple[float, float]]) -> DataFrame:
    """model, ord, price_in, price_out (USD per million tokens) from {model: (in, out)}; `_default` is for all others."""
    return spark.createDataFrame([(k, i, *map(float, v)) for i, (k, v) in enumerate(table.items())], "price_model string, ord int, price_in double, price_out double")


def priced(models: DataFrame, price_table: DataFrame) -> DataFrame:
    """`models` (model, ...) with the price of the model itself, else of the first that is a prefix of it, else the default."""
    fit = (F.col("model") == F.col("price_model")) | ((F.col("price_model") != "_default") & F.startswith("model", "price_model")) | (F.col("price_model") == "_default")
    rank = F.when(F.col("model") == F.col("price_model"), -1).when(F.col("price_model") == "_default", 1 << 30).otherwise(F.col("ord"))
    known = models.select("model").distinct().join(F.broadcast(price_table), fit)
    best = known.groupBy("model").agg(F.min_by(F.struct("price_in", "price_out"), rank).alias("p")).select("model", "p.*")
    return models.join(best, "model")


def micros(tokens_in: Column, tokens_out: Column) -> Column:
    """Cost in millionths of a dollar: sums of whole numbers where prices are whole, so their order doesn't matter."""
    return tokens_in * F.col("price_in") + tokens_out * F.col("price_out")


def quota(calls: DataFrame, now: Column, hours: int = 1, default_limit: int = PER_HOUR) -> DataFrame:
    """Per service within the window: used, limit, remaining (as the server last said, else counted), throttled, pct, resets_in."""
    since = now - F.make_interval(hours=F.lit(hours))
    inside = calls.where(F.col("ts") >= since)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("ts", c)))
    agg = inside.groupBy("service").agg(
        F.count(F.lit(1)).alias("used"), F.coalesce(F.nullif(last("limit_total"), F.lit(0)), F.lit(default_limit)).cast("long").alias("limit"), last("remaining").alias("reported"),
        F.count_if(F.col("status") == 429).alias("throttled"), F.min("ts").alias("oldest"),
    )
    remaining = F.coalesce("reported", F.greatest(F.col("limit") - F.col("used"), F.lit(0)))
    seconds = F.timestamp_diff("SECOND", now, F.col("oldest") + F.make_interval(hours=F.lit(hours)))
    return agg.select(
        "service", "used", "limit", remaining.alias("remaining"), F.when(F.col("reported").isNotNull(), "server header").otherwise("local count").alias("source"),
        "throttled", F.round(100 * remaining / F.col("limit"), 1).alias("pct"), F.greatest(seconds, F.lit(0)).alias("resets_in"),
    )


def spend(calls: DataFrame, price_table: DataFrame, since: Column) -> DataFrame:
    """model, calls, tokens_in, tokens_out, cost; calls without a model are left out."""
    by_model = calls.where((F.col("ts") >= since) & (F.coalesce("model", F.lit("")) != "")).groupBy("model").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out")
    )
    return priced(by_model, price_table).select("model", "calls", "tokens_in", "tokens_out", F.round(micros(F.col("tokens_in"), F.col("tokens_out")) / 1e6, 4).alias("cost"))


def requests(comments: Column) -> Column:
    """Requests that a pull takes: one for each comment, one for 250 headers, three lookups."""
    return comments + F.greatest(F.lit(1), F.floor(comments / 250)) + 3


def preflight(totals: DataFrame) -> DataFrame:
    """`totals` (docket_id, comments) with requests, hours and a verdict."""
    n = requests(F.coalesce("comments", F.lit(0)))
    verdict = F.when(n <= PER_HOUR, "fits").when(n <= 5000, "hours").otherwise("mirror")
    return totals.select("docket_id", "comments", n.cast("long").alias("requests"), F.round(n / PER_HOUR, 2).alias("hours"), verdict.alias("verdict"))


def estimate(comments: DataFrame, units: DataFrame, analysis: DataFrame, price_table: DataFrame, totals: DataFrame) -> DataFrame:
    """What finishing each docket will cost, from what it has cost so far; null where nothing was analysed yet."""
    pulled = comments.groupBy("docket_id").agg(F.count(F.lit(1)).alias("pulled"))
    unit_n = units.groupBy("docket_id").agg(F.count(F.lit(1)).alias("units"))
    done = analysis.join(comments.select("comment_id", "docket_id"), "comment_id").withColumn("model", F.coalesce("model", F.lit("")))
    done = priced(done, price_table).groupBy("docket_id").agg(F.count(F.lit(1)).alias("analyzed"), F.sum(micros(F.col("tokens_in"), F.col("tokens_out"))).alias("spent"))
    joined = pulled.join(unit_n, "docket_id", "left").join(done, "docket_id", "left").join(totals, "docket_id", "left")
    unit, n = F.coalesce("units", F.lit(0)), F.coalesce("analyzed", F.lit(0))
    each = F.when(n > 0, F.round(F.col("spent") / n) / 1e6)
    projected = F.round(F.col("total_comments") * unit / F.col("pulled"))
    return joined.select(
        "docket_id", "pulled", unit.alias("units"), n.alias("analyzed"), F.round(F.coalesce("spent", F.lit(0.0)) / 1e6, 4).alias("spent_analysis"), each.alias("per_unit_cost"),
        F.greatest(unit - n, F.lit(0)).alias("units_remaining"), F.round(F.greatest(unit - n, F.lit(0)) * each, 4).alias("cost_to_finish_pulled"),
        projected.cast("long").alias("projected_units"), F.round(1 - unit / F.col("pulled"), 4).alias("collapse_ratio"),
        F.round(projected * each * (1 + LINKAGE_SHARE), 2).alias("projected_total"), requests(F.col("total_comments")).cast("long").alias("api_requests"),
    )


def recent(calls: DataFrame, top: int = 25) -> DataFrame:
    return calls.orderBy(F.desc("ts"), "service", "endpoint").limit(top)


def record(calls: DataFrame) -> DataFrame:
    """Raw log rows (ts, service, endpoint, status, headers, model, tokens) as the call table: headers that aren't numbers are null."""
    header = lambda k: F.coalesce(F.col("headers")[k], F.col("headers")[k.lower()]).try_cast("int")
    return calls.select(
        "ts", "service", F.substring("endpoint", 1, 120).alias("endpoint"), "status", header("X-RateLimit-Remaining").alias("remaining"), header("X-RateLimit-Limit").alias("limit_total"),
        F.nullif("model", F.lit("")).alias("model"), F.coalesce("tokens_in", F.lit(0)).alias("tokens_in"), F.coalesce("tokens_out", F.lit(0)).alias("tokens_out"),
    )


def rolling(calls: DataFrame) -> DataFrame:
    """For each call, how many of its service fell in the hour up to it."""
    w = Window.partitionBy("service").orderBy(F.col("ts").cast("timestamp").cast("long")).rangeBetween(-3600, 0)
    return calls.withColumn("used", F.count(F.lit(1)).over(w))
