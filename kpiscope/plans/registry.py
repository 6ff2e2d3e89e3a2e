"""Query registry and the SQL fragments shared by the counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its operator name, with the SQL that must give the same rows."""

    def keep(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def rnd(expr: str, digits: int) -> str:
    """SQL twin of functions.exprs.settle."""
    return f"(round(({expr}) + 1e-9, {digits}) + 0.0)"


def rnd_wide(expr: str, digits: int) -> str:
    """SQL twin of functions.exprs.settle_wide."""
    return f"(CASE WHEN abs({expr}) >= 1e6 THEN {rnd(f'({expr}) / 1e6', digits)} * 1e6 ELSE {rnd(expr, digits)} END)"


#: Hourly panel with gaps filled by the last known value.
PANEL = """WITH obs AS (
  SELECT user_id // 5 AS station_id, event_type AS kpi,
         CAST(date_diff('hour', TIMESTAMP '2024-01-01', ts) AS INTEGER) AS t,
         CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS value
  FROM events GROUP BY 1, 2, 3),
grid AS (
  SELECT s.station_id, s.kpi, CAST(g.t AS INTEGER) AS t
  FROM (SELECT DISTINCT station_id, kpi FROM obs) s, range(720) g(t)),
panel AS (
  SELECT g.station_id, g.kpi, g.t,
         coalesce(last_value(o.value IGNORE NULLS) OVER (
           PARTITION BY g.station_id, g.kpi ORDER BY g.t ROWS UNBOUNDED PRECEDING), 0.0) AS value
  FROM grid g LEFT JOIN obs o ON o.station_id = g.station_id AND o.kpi = g.kpi AND o.t = g.t)
"""

#: Daily seasonal-naive forecast of the held-out week, beside the truth.
FORECAST = PANEL + """, fc AS (
  SELECT a.station_id, a.kpi, a.t - 552 AS h, b.value AS pred, a.value AS truth
  FROM panel a JOIN panel b ON a.station_id = b.station_id AND a.kpi = b.kpi
   AND b.t = 528 + (a.t - 552) % 24
  WHERE a.t >= 552)
"""

#: Moments of the last observed week.
MOMENTS = FORECAST + """, base AS (
  SELECT station_id, kpi, t - 384 AS t, value, value - lag(value) OVER (
    PARTITION BY station_id, kpi ORDER BY t) AS d
  FROM panel WHERE t >= 384 AND t < 552),
mom AS (
  SELECT station_id, kpi, avg(value) AS mu,
         CASE WHEN stddev_pop(value) = 0 THEN 1e-8 ELSE stddev_pop(value) END AS sigma,
         CASE WHEN stddev_pop(d) = 0 THEN 1e-8 ELSE stddev_pop(d) END AS dsigma,
         max(CASE WHEN t = 167 THEN value END) AS last_value
  FROM base GROUP BY 1, 2)
"""
