"""Sinks of the leverage analysis: walk-forward rows by factor and code, and one summary row for each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPLITS = ("train", "val", "test")


def write_path(path: DataFrame, folder: str, factor: str, form: str = "csv") -> None:
    """Appends the rows under factor=.../code=...; rows of a code meet in one task, hence in one file."""
    rows = path.withColumn("factor", F.lit(factor)).repartition("code").sortWithinPartitions("code", "ts_ms")
    rows.write.format(form).option("header", "true").partitionBy("factor", "code").mode("append").save(folder)


def summary(report: DataFrame, best: DataFrame, factor: str, window: int) -> DataFrame:
    """A row for each code: sizes, dates and scores of its segments beside the best candidate."""
    own = [f"max(CASE WHEN split = '{s}' THEN {c} END) AS {s}_{n}" for s in SPLITS for c, n in (("n", "size"), ("first_ms", "start_ms"), ("last_ms", "end_ms"), ("score", "score"), ("baseline_score", "baseline_score"))]
    own += [f"max(CASE WHEN split = 'val' THEN {c} END) AS val_{c}" for c in ("final_equity", "dd_rms", "trade_days")]
    wide = report.groupBy("code").agg(*map(F.expr, own))
    rows = wide.join(best.select("code", "theta", "c_scale"), "code")
    return rows.select(F.lit(factor).alias("factor"), F.lit(window).alias("window"), *rows.columns)


def append_summary(rows: DataFrame, folder: str, form: str = "csv") -> None:
    rows.write.format(form).option("header", "true").mode("append").save(folder)
