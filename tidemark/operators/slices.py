"""Time buckets and between-quote intervals with the trades and orders they hold.

Inputs are DataFrames of the views' columns: quotes (code, ts_ms, seq, trading_day, volume, turnover, bid,
ask), trades and orders (code, ts_ms, seq, price, side, volume).  Lists are in order of arrival (ts_ms,
seq).  A code's day of quotes shares one sort; ticks are only hashed to their bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.calendar import in_session
from ..sources import views

_TICK = ["ts_ms", "seq", "price", "side", "volume"]


def _mid():
    return F.when((F.col("bid") > 0) & (F.col("ask") > 0), (F.col("bid") + F.col("ask")) / 2)


def _listed(ticks: DataFrame, keys: list[str], name: str) -> DataFrame:
    return ticks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*_TICK))).alias(name))


def time_buckets(quotes: DataFrame, trades: DataFrame, orders: DataFrame, size_ms: int = 1000, emit_empty: bool = False) -> DataFrame:
    """(code, bucket_start_ms, bucket_end_ms, amount_sum, volume_sum, midprice_last, trans, orders).

    Events outside continuous trading count for nothing.  The first quote of a trading day brings its whole
    cumulative amount; a volume never falls, an amount may.  Without a valid mid a bucket has 0.
    emit_empty: also the buckets without events between a code's first and last event, in session or not.
    """
    b = (F.col("ts_ms") - F.col("ts_ms") % size_ms).alias("bucket_start_ms")
    day = Window.partitionBy("code", "trading_day").orderBy("ts_ms", "seq")
    q = quotes.filter(in_session("ts_ms")).select(
        "code", b, F.struct("ts_ms", "seq").alias("at"), _mid().alias("mid"),
        (F.col("turnover") - F.coalesce(F.lag("turnover").over(day), F.lit(0.0))).alias("amount"), F.greatest(F.col("volume") - F.coalesce(F.lag("volume").over(day), F.lit(0)), F.lit(0)).alias("volume"))
    out = q.groupBy("code", "bucket_start_ms").agg(F.sum("amount").alias("amount_sum"), F.sum("volume").alias("volume_sum"), F.expr("max_by(mid, at) FILTER (WHERE mid IS NOT NULL)").alias("midprice_last"))
    keys = ["code", "bucket_start_ms"]
    for ticks, name in ((trades, "trans"), (orders, "orders")):
        out = out.join(_listed(ticks.filter(in_session("ts_ms")).select("*", b), keys, name), keys, "full")
    if emit_empty:
        every = quotes.select("code", "ts_ms").unionAll(trades.select("code", "ts_ms")).unionAll(orders.select("code", "ts_ms"))
        ends = every.groupBy("code").agg(F.min("ts_ms").alias("lo"), F.max("ts_ms").alias("hi"))
        grid = ends.select("code", F.explode(F.sequence(F.col("lo") - F.col("lo") % size_ms, F.col("hi") - F.col("hi") % size_ms, F.lit(size_ms).cast("long"))).alias("bucket_start_ms"))
        out = grid.join(out, keys, "left")
    none = F.expr("CAST(array() AS array<struct<ts_ms: bigint, seq: bigint, price: double, side: int, volume: bigint>>)")
    return out.select(
        "code", "bucket_start_ms", (F.col("bucket_start_ms") + size_ms).alias("bucket_end_ms"), F.coalesce("amount_sum", F.lit(0.0)).alias("amount_sum"),
        F.coalesce("volume_sum", F.lit(0)).cast("long").alias("volume_sum"), F.coalesce("midprice_last", F.lit(0.0)).alias("midprice_last"),
        *(F.coalesce(n, none).alias(n) for n in ("trans", "orders")))


def intervals(quotes: DataFrame, trades: DataFrame, orders: DataFrame) -> DataFrame:
    """(code, ts_ms, seq, trans, orders) at every quote but a code's first: what came after the quote before.

    Ticks at the opening quote's own time are dropped.  One sort by code numbers the intervals.
    """
    rows = quotes.select("code", "ts_ms", "seq", F.lit(0).alias("src"), F.lit(0.0).alias("price"), F.lit(0).alias("side"), F.lit(0).cast("long").alias("volume"))
    for k, ticks in ((1, trades), (2, orders)):
        rows = rows.unionByName(ticks.select("code", "ts_ms", "seq", F.lit(k).alias("src"), "price", "side", "volume"))
    order = Window.partitionBy("code").orderBy("ts_ms", "src", "seq")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"k": F.count(F.when(F.col("src") == 0, 1)).over(so_far), "opened": F.max(F.when(F.col("src") == 0, F.col("ts_ms"))).over(so_far)})
    # a quote closes the interval before it
    rows = rows.withColumn("k", F.when(F.col("src") == 0, F.col("k") - 1).otherwise(F.col("k"))).filter("k > 0 AND (src = 0 OR ts_ms > opened)")
    tick = F.struct(*_TICK)
    done = rows.groupBy("code", "k").agg(
        F.max(F.when(F.col("src") == 0, F.struct("ts_ms", "seq"))).alias("closed"),
        *(F.array_sort(F.collect_list(F.when(F.col("src") == s, tick))).alias(n) for s, n in ((1, "trans"), (2, "orders"))))
    return done.filter("closed IS NOT NULL").select("code", "closed.ts_ms", "closed.seq", "trans", "orders")


def _seqs(name: str):
    return F.array_join(F.transform(name, lambda x: x["seq"].cast("string")), ",").alias(name)


def _views(spark: SparkSession, sf_dir: str):
    return (view(spark, sf_dir) for view in (views.quotes, views.trades, views.orders))


def bucket_query(spark: SparkSession, sf_dir: str, size_ms: int = 3_600_000, emit_empty: bool = True) -> DataFrame:
    done = time_buckets(*_views(spark, sf_dir), size_ms, emit_empty)
    return done.select("code", "bucket_end_ms", F.round("amount_sum", 6).alias("amount"), F.col("volume_sum").alias("volume"), F.round("midprice_last", 6).alias("midprice"), _seqs("trans"), _seqs("orders"))


def interval_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals(*_views(spark, sf_dir)).select("code", "ts_ms", "seq", _seqs("trans"), _seqs("orders"))


def bucket_sql(size: int = 3_600_000) -> str:
    """All buckets between the first and last event of a code, for the check engine."""
    from .sql_factors import buckets, check_sql

    def seqs(name):
        return f"(SELECT code, ts_ms - ts_ms % {size} + {size} AS b, string_agg(CAST(seq AS VARCHAR), ',' ORDER BY ts_ms, seq) AS s FROM {{{name}}} WHERE {in_session('ts_ms')} GROUP BY 1, 2)"

    return check_sql(f"""SELECT g.code, g.b AS bucket_end_ms, coalesce(f.amount, 0e0) AS amount, CAST(coalesce(f.volume, 0) AS BIGINT) AS volume, coalesce(f.midprice, 0e0) AS midprice, coalesce(t.s, '') AS trans, coalesce(o.s, '') AS orders FROM (
  SELECT code, unnest(range(lo - lo % {size} + {size}, hi - hi % {size} + {size} + 1, {size})) AS b FROM (
    SELECT code, min(ts_ms) AS lo, max(ts_ms) AS hi FROM (SELECT code, ts_ms FROM {{quotes}} UNION ALL SELECT code, ts_ms FROM {{trades}} UNION ALL SELECT code, ts_ms FROM {{orders}}) GROUP BY code)) g
  LEFT JOIN ({buckets(size)}) f ON g.code = f.code AND g.b = f.bucket_end_ms LEFT JOIN {seqs("trades")} t ON g.code = t.code AND g.b = t.b LEFT JOIN {seqs("orders")} o ON g.code = o.code AND g.b = o.b""")


def interval_sql() -> str:
    from .sql_factors import _TAGGED, _TICKS, check_sql

    one = lambda s: f"coalesce(string_agg(CASE WHEN src = {s} THEN CAST(seq AS VARCHAR) END, ',' ORDER BY ts_ms, seq), '')"
    return check_sql(f"""SELECT q.code, q.ts_ms, q.seq, coalesce(a.trans, '') AS trans, coalesce(a.orders, '') AS orders FROM (SELECT code, ts_ms, seq, k FROM {_TAGGED} WHERE src = 0 AND k > 1) q LEFT JOIN (
  SELECT code, k + 1 AS k, {one(1)} AS trans, {one(2)} AS orders FROM {_TICKS} WHERE src > 0 AND ts_ms > opened GROUP BY code, k) a ON q.code = a.code AND q.k = a.k""")


QUERIES = {"bucket_slices": bucket_query, "interval_slices": interval_query}
ORACLES = {"bucket_slices": bucket_sql(), "interval_slices": interval_sql()}
