import statistics

import duckdb
import pytest

from tidemark.functions import calendar, config, mathx
from tidemark.plans import catalog

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in ("lineitem", "events", "embeddings"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = db.execute(catalog.ORACLES[name])
    names = [c[0] for c in want.description]
    got = catalog.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    exact = lambda r: tuple(str(v) for v in r if not isinstance(v, float)) + tuple(v for v in r if isinstance(v, float))
    a = sorted((tuple(r[c] for c in names) for r in got.collect()), key=exact)
    b = sorted(want.fetchall(), key=exact)
    assert len(a) == len(b) > 0
    bad = [(x, y) for x, y in zip(a, b) if any(u != v and not (isinstance(u, float) and isinstance(v, float) and abs(u - v) <= 2e-6 + 1e-9 * abs(v)) for u, v in zip(x, y))]
    assert not bad, bad[:3]


def test_normal_functions():
    db, n = duckdb.connect(), statistics.NormalDist()
    for x in (-6.5, -3, -1, -0.1, 0.0, 0.4, 2.5, 6.9):
        assert abs(db.execute(f"select {mathx.normal_cdf('x')} from (select {x}::double x)").fetchone()[0] - n.cdf(x)) < 1e-12
    for p in (1e-9, 1e-4, 0.07, 0.3, 0.5, 0.81, 0.999, 1 - 1e-9):
        assert abs(db.execute(f"select {mathx.normal_ppf('p')} from (select {p}::double p)").fetchone()[0] - n.inv_cdf(p)) < 1e-9


def test_calendar():
    db = duckdb.connect()
    at = lambda h, m, d=0: d * calendar.DAY + h * calendar.HOUR + m * calendar.MINUTE
    one = lambda e, ts: db.execute(f"select {e('t')} from (select {ts}::bigint t)").fetchone()[0]
    assert [one(calendar.in_session, at(h, m)) for h, m in ((9, 29), (9, 30), (11, 30), (13, 0), (15, 0))] == [False, True, False, True, False]
    assert one(calendar.in_auction, at(14, 58)) and not one(calendar.in_auction, at(9, 25))
    assert one(calendar.next_session, at(9, 30)) == at(13, 0) and one(calendar.next_session, at(16, 0)) == at(9, 30, 1)
    assert [bool(one(calendar.is_weekday, at(1, 0, d))) for d in range(5)] == [True, True, False, False, True]


def test_config():
    assert config.read_ini("[a]\nx = 1 ; c\n# c\n[b]\ny=on")["a.x"] == "1"
    assert config.truthy("Yes") and not config.truthy("0")
    assert config.windows("5, 0,7,5,x,9999") == [5, 7, 500]
    assert config.duration_ms("5min") == 300_000 and config.duration_ms("2天") == 172_800_000 and config.duration_ms("7") == 7
