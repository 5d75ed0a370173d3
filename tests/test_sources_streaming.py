import pytest
from pyspark.sql import functions as F

from tidemark.operators import bus
from tidemark.sources import kline, normalise
from tidemark.streaming import live


def test_csv_directory(spark, tmp_path):
    (tmp_path / "000001-daily.csv").write_text('date,o,h,l,c,x,x,x,x,vol,amt\n2024-01-02,"1,000.5",,9,10,,,,,"1,234.7",5\n\n2024-01-03,1,2,3,,,,,,1,1\nbad,1,1,1,1,,,,,1,1\n2024-01-04,1,2,0.5,"""x""",,,,,1,1\n')
    (tmp_path / "600000.csv").write_text("date,o,h,l,c,x,x,x,x,vol,amt\n2024-01-05,1,2,0.5,1.5,,,,,,\n")
    (tmp_path / "notes.txt").write_text("x")
    got = {(r.code, r.ts_ms): r for r in kline.read_csv(spark, str(tmp_path)).collect()}
    assert len(got) == 2
    r = got["000001", 1704207600000]
    assert (r.open, r.high, r.low, r.close, r.volume, r.turnover) == (1000.5, 10.0, 9.0, 10.0, 1234, 5.0)
    assert got["600000", 1704466800000].volume == 0
    assert kline.read_csv(spark, str(tmp_path), codes=["600000"], start_ms=1704466800000, end_ms=1704466800000).count() == 1


def test_parquet_discovery(spark, tmp_path):
    spark.createDataFrame([(20240102, 1, 1050, 1100, 1000, 1075, 300, 50)], ["9", "13", "3000002", "3000003", "3000004", "3000005", "3000008", "3000009"]).write.parquet(str(tmp_path / "a"))
    r = kline.read_parquet(spark, str(tmp_path / "a"), first_day=20240101).first()
    assert (r.code, r.open, r.close, r.volume, r.turnover) == ("1", 10.5, 10.75, 3.0, 5.0)
    spark.createDataFrame([("x", 20240102, 1.5, 160, 300.0, 50.0)], "code string, date int, close double, high long, volume double, amount double").write.parquet(str(tmp_path / "c"))
    r = kline.read_parquet(spark, str(tmp_path / "c")).first()
    assert (r.high, r.low, r.close, r.volume, r.turnover) == (1.6, 1.5, 1.5, 3.0, 5.0)  # each price by its own type, amounts always
    spark.createDataFrame([("x", 1.5, None)], "Date string, CLOSE double, high double").write.parquet(str(tmp_path / "b"))
    assert kline.discover(["Date", "CLOSE"]) == {"date": "Date", "close": "CLOSE"}
    with pytest.raises(ValueError):
        kline.discover(["close"])


def test_normalise(spark):
    raw = spark.createDataFrame([(1, 34200, 7, 3, 101500, 20, 0, "B", 5, 6), (1234567, 34201, 8, 3, 101600, 0, 30, "S", 9, 0)], "security_id long, time long, seq long, channel long, price long, quantity long, order_quantity long, side string, buy_no long, sell_no long")
    a, b = normalise.ticks(raw).orderBy("main_seq").collect()
    assert (a.instrument_id, a.data_time_ms, a.kind, a.price, a.side, a.volume, a.order_id) == ("000001", 34200000, "Trade", 10.15, 1, 20, None)
    assert (b.instrument_id, b.kind, b.side, b.volume, b.order_id) == ("1234567", "Order", -1, 0, (3 << 32) | 9)


def test_bus(spark):
    v = spark.createDataFrame([("t", "a", 0, ts, i, float(x)) for i, (ts, x) in enumerate([(10, 1), (20, 2), (30, 3), (20, 4)])] + [("t", "b", w, 5, 0, 1.0) for w in (3, 4)], "topic string, code string, window int, ts_ms long, seq long, value double")
    assert [(r.ts_ms, r.value, r.place) for r in bus.last_n(v, 5, 2).filter("code = 'a'").orderBy("place").collect()] == [(30, 3.0, 1), (20, 4.0, 2)]
    asked = spark.createDataFrame([("t", "a", 0, 20)], "topic string, code string, window int, ts_ms long")
    assert bus.exact(v, asked).first().value == 2.0 and bus.exact(v, asked, 2).first().value == 4.0
    assert bus.latest(v).filter("code = 'a'").first().value == 4.0
    assert bus.at_least(v, asked).count() == 1 and bus.at_least(v, asked.withColumn("ts_ms", F.lit(21).cast("long"))).count() == 0
    with pytest.raises(ValueError):
        bus.resolve(v, "b")


def test_streams_equal_batch(spark, tmp_path):
    rows = [(c, 1000 * i + j, i, "Trade" if (i * 7 + j) % 3 else "Order") for j, c in enumerate("ab") for i in range(60)]
    schema = "code string, ts_ms long, seq long, kind string"
    for part in range(3):
        spark.createDataFrame([r for r in rows if r[2] // 20 == part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = live.hawkes(stream).writeStream.format("memory").queryName("hawkes_live").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda r: (r.code, r.ts_ms, round(r.value, 12))
    batch = live.batch_hawkes(spark.createDataFrame(rows, schema))
    assert sorted(map(key, spark.table("hawkes_live").collect())) == sorted(map(key, batch.collect()))
    values = stream.select("code", "ts_ms", "seq", (F.col("seq") * 7 % 11).cast("double").alias("value"))
    q = live.gaussian_rank(values, 5).writeStream.format("memory").queryName("rank_live").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("rank_live").count() == 120
    first = spark.table("rank_live").filter("code = 'a'").orderBy("ts_ms").first()
    assert abs(first.value) < 1e-12
