"""Topic reads over the long factor table (code, window, topic, ts_ms, seq, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CAPACITY = 120
KEY = ["topic", "code", "window"]


def _newest(values: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy(*KEY).orderBy(F.col("seq").desc())
    return values.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= n)


def held(values: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """What a topic of a capacity still holds: the newest by order of publishing."""
    return _newest(values, capacity).drop("_k")


def last_n(values: DataFrame, n: int, capacity: int = CAPACITY) -> DataFrame:
    """The last n values, `place` 1 being the oldest of them."""
    own = _newest(values, min(n, capacity))
    return own.withColumn("place", F.max("_k").over(Window.partitionBy(*KEY)) + 1 - F.col("_k")).drop("_k")


def latest(values: DataFrame) -> DataFrame:
    """The last value published of every key; combined before the shuffle."""
    return values.groupBy(*KEY).agg(F.max_by("ts_ms", "seq").alias("ts_ms"), F.max_by("value", "seq").alias("value"))


def exact(values: DataFrame, asked: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """For rows of (topic, code, window, ts_ms): the oldest held value of exactly that time."""
    own = held(values, capacity).groupBy(*KEY, "ts_ms").agg(F.min_by("value", "seq").alias("value"))
    return asked.join(own, [*KEY, "ts_ms"])


def at_least(values: DataFrame, asked: DataFrame) -> DataFrame:
    """For rows of (topic, code, window, ts_ms): the last value published, if its time is not before."""
    return asked.withColumnRenamed("ts_ms", "asked_ms").join(latest(values), KEY).filter(F.col("ts_ms") >= F.col("asked_ms"))


def resolve(values: DataFrame, code: str) -> DataFrame:
    """Values of a bare code; an error if it has several windows, of which the bare name cannot choose one."""
    own = values.filter(F.col("code") == code)
    if own.select("window").distinct().limit(2).count() > 1:
        raise ValueError(f"{code} has several windows")
    return own
