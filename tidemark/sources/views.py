"""Market-data views over the test tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DAY = 86_400_000
_ROW = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of every supplier; one hash aggregation, combined before its shuffle."""
    px, key = F.col("l_extendedprice") / F.col("l_quantity"), F.struct(*_ROW)
    days = _read(spark, sf_dir, "lineitem").withColumn("px", px).withColumn("day", F.to_date("l_shipdate"))
    out = days.groupBy(F.col("l_suppkey").alias("code"), "day").agg(
        F.min_by("px", key).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", key).alias("close"),
        F.sum("l_quantity").alias("volume"), F.sum("l_extendedprice").alias("turnover"))
    return out.select("code", (F.unix_date("day").cast("long") * DAY).alias("ts_ms"), "open", "high", "low", "close", "volume", "turnover")


def tick_bars(spark: SparkSession, sf_dir: str, size: int = 5) -> DataFrame:
    """Bars of five consecutive rows of a supplier; only full ones.  ts_ms is the bar's number."""
    order = Window.partitionBy("l_suppkey").orderBy("l_shipdate", *_ROW)
    rows = _read(spark, sf_dir, "lineitem").withColumn("px", F.col("l_extendedprice") / F.col("l_quantity")).withColumn("n", F.row_number().over(order) - 1)
    rows = rows.withColumn("bar", F.floor(F.col("n") / size))
    out = rows.groupBy(F.col("l_suppkey").alias("code"), F.col("bar").cast("long").alias("ts_ms")).agg(
        F.min_by("px", "n").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "n").alias("close"),
        F.sum("l_quantity").alias("volume"), F.sum("l_extendedprice").alias("turnover"), F.count("*").alias("rows"))
    return out.filter(F.col("rows") == size).drop("rows")


def millis(ts: str):
    """Milliseconds of a time stamp without zone, whatever the session's zone."""
    seconds = F.expr(f"extract(SECOND FROM {ts})") * 1000
    return F.unix_date(F.to_date(ts)).cast("long") * DAY + F.hour(ts) * 3_600_000 + F.minute(ts) * 60_000 + F.floor(seconds).cast("long")


def _events(spark: SparkSession, sf_dir: str, kinds: list[str]) -> DataFrame:
    e = _read(spark, sf_dir, "events").filter(F.col("event_type").isin(kinds))
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select((F.col("user_id") % 10).alias("code"), millis("ts").alias("ts_ms"), F.col("event_id").alias("seq"), "value", k.alias("k"))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best bid and ask with volume and turnover accumulated over the day."""
    e = _events(spark, sf_dir, ["view", "signup"]).withColumn("day", F.floor(F.col("ts_ms") / DAY))
    run = Window.partitionBy("code", "day").orderBy("ts_ms", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return e.select("code", "ts_ms", "seq", F.col("day").cast("long").alias("trading_day"), F.sum(F.col("k") + 1).over(run).alias("volume"), F.sum((F.col("k") + 1) * F.col("value")).over(run).alias("turnover"), (F.col("value") - 0.01).alias("bid"), (F.col("value") + 0.01).alias("ask"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir, ["purchase", "click"])
    return e.select("code", "ts_ms", "seq", F.col("value").alias("price"), F.when(F.col("k") % 2 == 0, 1).otherwise(-1).alias("side"), (F.col("k") + 1).alias("volume"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir, ["error"])
    side = F.when(F.col("k") % 3 == 1, 1).when(F.col("k") % 3 == 2, -1).otherwise(0)
    return e.select("code", "ts_ms", "seq", F.col("value").alias("price"), side.alias("side"), (F.col("k") + 1).alias("volume"))


VIEWS = {"bars": bars, "tick_bars": tick_bars, "quotes": quotes, "trades": trades, "orders": orders}

_KEY = "l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice"
_EV = f"(SELECT user_id % 10 AS code, epoch_us(ts) // 1000 AS ts_ms, event_id AS seq, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, epoch_us(ts) // {DAY * 1000} AS day, event_type FROM events)"
#: The same views for an engine that has the tables; integer division is written //.
SQL = {
    "bars": f"""(SELECT code, epoch_ms(day) AS ts_ms, max(CASE WHEN n = 1 THEN px END) AS open, max(px) AS high, min(px) AS low, max(CASE WHEN n = m THEN px END) AS close, sum(q) AS volume, sum(x) AS turnover
  FROM (SELECT l_suppkey AS code, CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) AS day, l_quantity AS q, l_extendedprice AS x, l_extendedprice / l_quantity AS px,
               row_number() OVER (PARTITION BY l_suppkey, date_trunc('day', l_shipdate) ORDER BY {_KEY}) AS n, count(*) OVER (PARTITION BY l_suppkey, date_trunc('day', l_shipdate)) AS m FROM lineitem) GROUP BY code, day)""",
    "tick_bars": f"""(SELECT code, bar AS ts_ms, max(CASE WHEN n % 5 = 0 THEN px END) AS open, max(px) AS high, min(px) AS low, max(CASE WHEN n % 5 = 4 THEN px END) AS close, sum(q) AS volume, sum(x) AS turnover
  FROM (SELECT *, n // 5 AS bar FROM (SELECT l_suppkey AS code, l_quantity AS q, l_extendedprice AS x, l_extendedprice / l_quantity AS px, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, {_KEY}) - 1 AS n FROM lineitem)) GROUP BY code, bar HAVING count(*) = 5)""",
    "quotes": f"""(SELECT code, ts_ms, seq, day AS trading_day, sum(k + 1) OVER w AS volume, sum((k + 1) * value) OVER w AS turnover, value - 0.01e0 AS bid, value + 0.01e0 AS ask
  FROM {_EV} WHERE event_type IN ('view', 'signup') WINDOW w AS (PARTITION BY code, day ORDER BY ts_ms, seq ROWS UNBOUNDED PRECEDING))""",
    "trades": f"(SELECT code, ts_ms, seq, value AS price, CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END AS side, k + 1 AS volume FROM {_EV} WHERE event_type IN ('purchase', 'click'))",
    "orders": f"(SELECT code, ts_ms, seq, value AS price, CASE k % 3 WHEN 1 THEN 1 WHEN 2 THEN -1 ELSE 0 END AS side, k + 1 AS volume FROM {_EV} WHERE event_type = 'error')",
}
