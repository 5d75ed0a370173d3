"""Raw exchange rows to quotes, ticks and bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRICE_UNIT = 10_000


def code_text(c: Column) -> Column:
    """Six digits with leading zeros; longer numbers as they are."""
    s = c.cast("string")
    return F.when(F.length(s) < 6, F.lpad(s, 6, "0")).otherwise(s)


def quotes(raw: DataFrame) -> DataFrame:
    """raw: security_id, trading_day, time (hhmmss-like count of seconds), volume, turnover, bid, ask (in PRICE_UNIT)."""
    return raw.select(code_text(F.col("security_id")).alias("instrument_id"), (F.col("time").cast("long") * 1000).alias("data_time_ms"), F.col("trading_day").cast("int"), F.col("volume").cast("long"), F.col("turnover").cast("double"), (F.col("bid") / PRICE_UNIT).alias("bid_price"), (F.col("ask") / PRICE_UNIT).alias("ask_price"))


def side(c: Column) -> Column:
    return F.when(c == "B", 1).when(c == "S", -1).otherwise(0)


def order_number(channel: Column, buy_no: Column) -> Column:
    """Channel in the upper, order in the lower 32 bits."""
    return F.shiftleft(channel.cast("long"), 32).bitwiseOR(buy_no.cast("long"))


def ticks(raw: DataFrame) -> DataFrame:
    """raw: security_id, time, seq, channel, price, quantity, side, buy_no, sell_no.  A row with a traded quantity is a trade, else
    an order; price and volume are those of the traded columns for both, so an order's volume is never positive."""
    trade = F.col("quantity") > 0
    return raw.select(
        code_text(F.col("security_id")).alias("instrument_id"), (F.col("time").cast("long") * 1000).alias("data_time_ms"), F.col("seq").cast("long").alias("main_seq"), F.when(trade, "Trade").otherwise("Order").alias("kind"),
        (F.col("price") / PRICE_UNIT).alias("price"), side(F.col("side")).alias("side"), F.col("quantity").cast("long").alias("volume"),
        F.when(trade, F.col("buy_no").cast("long")).alias("bid_no"), F.when(trade, F.col("sell_no").cast("long")).alias("ask_no"), F.when(~trade, order_number(F.col("channel"), F.col("buy_no"))).alias("order_id"))


def union_ticks(trades: DataFrame, orders: DataFrame) -> DataFrame:
    return trades.withColumn("kind", F.lit("Trade")).unionByName(orders.withColumn("kind", F.lit("Order")), allowMissingColumns=True)
