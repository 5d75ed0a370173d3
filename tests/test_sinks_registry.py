import pytest
from pyspark.sql import functions as F

from tidemark.operators import event_factors, slices
from tidemark.plans import catalog, registry
from tidemark.sources import sinks

SF = "/root/testdata/sf0.001"
QUOTE = "code string, ts_ms long, seq long, trading_day long, volume long, turnover double, bid double, ask double"
TICK = "code string, ts_ms long, seq long, price double, side int, volume long"
OPEN = (9 * 60 + 30) * 60_000


def test_buckets_hold_what_arrived(spark):
    quotes = spark.createDataFrame([("a", OPEN + 100, 1, 0, 1000, 1e4, 10.0, 10.02), ("a", OPEN + 600, 2, 0, 1500, 15500.0, 10.01, 10.03), ("a", OPEN + 2700, 3, 0, 1400, 17000.0, 0.0, 10.04)], QUOTE)
    trades = spark.createDataFrame([("a", OPEN + 700, 5, 10.0, 1, 3), ("a", OPEN + 650, 4, 10.0, -1, 2), ("a", OPEN - 700, 3, 10.0, 1, 3)], TICK)
    none = trades.limit(0)
    got = {r.bucket_end_ms - OPEN: r for r in slices.time_buckets(quotes, trades, none, 500).collect()}
    assert sorted(got) == [500, 1000, 3000]
    assert (got[500].amount_sum, got[500].volume_sum, round(got[500].midprice_last, 6)) == (1e4, 1000, 10.01)
    assert (got[1000].amount_sum, got[1000].volume_sum) == (5500.0, 500) and [t.seq for t in got[1000].trans] == [4, 5]
    assert (got[3000].amount_sum, got[3000].volume_sum, got[3000].midprice_last, got[3000].orders) == (1500.0, 0, 0.0, [])
    full = slices.time_buckets(quotes, trades, none, 500, emit_empty=True)
    assert sorted(r.bucket_end_ms - OPEN for r in full.collect()) == list(range(-500, 3001, 500))
    assert slices.time_buckets(quotes.limit(0), none, none, 500, True).count() == 0


def test_intervals_drop_ties(spark):
    quotes = spark.createDataFrame([("a", 100, 1, 0, 1, 1.0, 1.0, 1.0), ("a", 500, 2, 0, 1, 1.0, 1.0, 1.0)], QUOTE)
    trades = spark.createDataFrame([("a", 150, 9, 1.0, 1, 5), ("a", 120, 8, 1.0, 1, 10), ("a", 100, 7, 1.0, 1, 1), ("a", 50, 6, 1.0, 1, 1), ("a", 600, 6, 1.0, 1, 1)], TICK)
    orders = spark.createDataFrame([("a", 130, 3, 1.0, 1, 5)], TICK)
    (r,) = slices.intervals(quotes, trades, orders).collect()
    assert (r.ts_ms, [t.seq for t in r.trans], [t.seq for t in r.orders]) == (500, [8, 9], [3])


def test_windows_are_bounded():
    assert event_factors.windows(lambda w: f"SELECT {w}", [3, 0, 3, 900]).count("SELECT CAST") == 3
    with pytest.raises(ValueError):
        event_factors.windows(lambda w: f"SELECT {w}", range(1, 10))


def test_sinks(spark, tmp_path):
    get = lambda n: catalog.QUERIES[n](spark, SF)
    path, best = get("leverage_path"), get("leverage_search")
    sinks.write_path(path, str(tmp_path / "wf"), "ret")
    back = spark.read.csv(str(tmp_path / "wf"), header=True)
    assert back.count() == path.count() and {"factor", "code", "theta"} <= set(back.columns)
    rows = sinks.summary(get("leverage_report"), best, "ret", 250)
    for _ in range(2):
        sinks.append_summary(rows, str(tmp_path / "best"))
    assert spark.read.csv(str(tmp_path / "best"), header=True).count() == 2 * best.count() == 2 * rows.count() > 0
    assert len(rows.columns) == 23


def test_every_binding_resolves(spark):
    for key in registry.BINDINGS:
        df = registry.resolve(spark, SF, key)
        assert df.columns == ["topic", "code", "ts_ms", "value"]
    assert registry.resolve(spark, SF, "hmm2_logodds").filter(F.col("value").isNotNull()).count() > 0
    with pytest.raises(ValueError):
        registry.resolve(spark, SF, "nothing")
