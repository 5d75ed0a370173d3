"""Daily K-line readers: a directory of CSV files and Parquet with discovered columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Alternative names of each column, by preference (fixed values, with the numeric field ids).
ALIASES = {
    "date": ["date", "trading_day", "trade_date", "9"], "code": ["code", "symbol", "instrument_id", "13"],
    "open": ["open", "open_price", "3000002"], "high": ["high", "high_price", "3000003"], "low": ["low", "low_price", "3000004"], "close": ["close", "close_price", "3000005"],
    "volume": ["volume", "qty", "3000008"], "turnover": ["turnover", "amount", "amt", "3000009"],
}
INTERVAL = 86_400_000


def _number(c):
    """A cell with thousands commas or blanks; null if it is no number."""
    return F.expr(f"try_cast(regexp_replace(`{c}`, '[,\\\\s]', '') AS DOUBLE)")


def read_csv(spark: SparkSession, folder: str, codes: list[str] | None = None, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """Bars of `<code>-*.csv` or `<code>.csv`: date, open, high, low, close, ..., 9 volume, 10 turnover.

    A missing open, high or low is the close; rows without date or close are dropped; a bar is stamped
    15:00 UTC of its date, and both ends of the range are inclusive.
    """
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(11)])
    raw = spark.read.csv(f"{folder}/*.csv", schema=schema, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, enforceSchema=True)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^([^-]*?)(?:-.*)?\.[^.]*$", 1)
    day = F.try_make_timestamp(*(F.expr(f"try_cast(regexp_extract(c0, '^(\\\\d+)-(\\\\d+)-(\\\\d+)$', {k}) AS INT)") for k in (1, 2, 3)), F.lit(15), F.lit(0), F.lit(0), F.lit("UTC"))
    close = _number("c4")
    bars = raw.select(F.url_decode(name).alias("code"), F.unix_millis(day).alias("ts_ms"), *(F.coalesce(_number(f"c{i}"), close).alias(n) for i, n in ((1, "open"), (2, "high"), (3, "low"))), close.alias("close"), F.coalesce(_number("c9").cast("long"), F.lit(0)).alias("volume"), F.coalesce(_number("c10"), F.lit(0.0)).alias("turnover"), F.lit(INTERVAL).alias("interval_ms"))
    bars = bars.filter("ts_ms is not null and close is not null")
    if codes:
        bars = bars.filter(F.col("code").isin(codes))
    if start_ms is not None:
        bars = bars.filter(F.col("ts_ms") >= start_ms)
    if end_ms is not None:
        bars = bars.filter(F.col("ts_ms") <= end_ms)
    return bars


def discover(columns: list[str]) -> dict[str, str]:
    """The first alias found of every column, whatever its case; date and close must be there."""
    lower = {c.lower(): c for c in columns}
    found = {n: next((lower[a] for a in names if a in lower), None) for n, names in ALIASES.items()}
    if not found["date"] or not found["close"]:
        raise ValueError("date and close columns are needed")
    return {n: c for n, c in found.items() if c}


def read_parquet(spark: SparkSession, path: str, codes: list[str] | None = None, first_day: int | None = None, last_day: int | None = None) -> DataFrame:
    """Bars of a Parquet path; whole-number prices are hundredths, each by its own column; quantities are taken times 0.01 and
    amounts times 0.1, whatever the type.

    Only the resolved columns are read, and code and whole-number date ranges reach the scan.
    """
    raw = spark.read.parquet(path)
    own = discover(raw.columns)
    whole = lambda n: isinstance(raw.schema[own[n]].dataType, T.IntegralType)
    date = F.col(f"`{own['date']}`")
    if codes and "code" in own:
        raw = raw.filter(F.col(f"`{own['code']}`").cast("string").isin(codes))
    if first_day is not None:
        raw = raw.filter(date >= first_day)
    if last_day is not None:
        raw = raw.filter(date <= last_day)
    price = lambda n: (F.col(f"`{own[n]}`") / (100 if whole(n) else 1)).cast("double")
    cols = [F.coalesce(price(n), price("close")).alias(n) if n in own else price("close").alias(n) for n in ("open", "high", "low")]
    day = F.to_timestamp(F.concat(date.cast("string"), F.lit(" 15")), "yyyyMMdd HH") if isinstance(raw.schema[own["date"]].dataType, T.IntegralType) else date.cast("timestamp")
    amount = lambda n, k: (F.col(f"`{own[n]}`") * k).cast("double") if n in own else F.lit(0.0)
    return raw.select(F.col(f"`{own['code']}`").cast("string").alias("code") if "code" in own else F.lit("").alias("code"), F.unix_millis(day).alias("ts_ms"), *cols, price("close").alias("close"), amount("volume", 0.01).alias("volume"), amount("turnover", 0.1).alias("turnover")).filter("close is not null")
