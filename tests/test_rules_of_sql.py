"""Rules that SQL counterparts state, on tables small enough to work out by hand."""

from __future__ import annotations

import datetime

import duckdb
from kpiscope.plans import catalogue


def test_fanout_sql_takes_one_base_per_channel():
    """Averages of the same hours that differ in the last bit must not count as several base values."""
    con = duckdb.connect()
    con.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE)")
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(hours=i % 700), 5 * (i % 400), "click", (i * 37 % 1000) / 100) for i in range(60000)]
    con.executemany("INSERT INTO events VALUES (?, ?, ?, ?, ?)", rows[:2000])
    sql = catalogue.oracle_sql()["pt_fanout_forecast"]
    assert "DISTINCT" not in sql.split(", bs AS", 1)[1]
    base = con.execute(f"SELECT station_id, tgt, count(DISTINCT base_mean) FROM ({sql}) WHERE src = tgt GROUP BY 1, 2").fetchall()
    assert base and all(n == 1 for *_, n in base)
    largest = con.execute(f"SELECT max(base_mean) FROM ({sql}) WHERE tgt = 'click'").fetchone()[0]
    assert largest <= 10.0001
