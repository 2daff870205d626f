"""Field layers made of general tables, by arithmetic that any engine does alike. The same text serves Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from furrow.functions.geometry import box

#: Points on a jittered lattice four metres wide.
POINTS = """SELECT rid, seq, x, y, 100e0 + 2e-2 * x + 1e-2 * y + CAST(rid * 31 % 17 AS DOUBLE) * 5e-2 AS z, v, pass_number, t, crop_type FROM (
  SELECT event_id AS rid, event_id AS seq, CAST(event_id % 100 AS DOUBLE) * 4e0 + CAST(event_id * 7919 % 1000 AS DOUBLE) * 3e-3 AS x,
    CAST(floor(CAST(event_id AS DOUBLE) / 100e0) AS DOUBLE) * 4e0 + CAST(event_id * 104729 % 1000 AS DOUBLE) * 3e-3 AS y, value AS v, user_id AS pass_number, ts AS t, event_type AS crop_type FROM events) AS e"""

#: Rectangles of 38 by 38 metres, 40 metres apart.
PLOTS = """SELECT s_suppkey AS rid, CAST(s_suppkey % 10 AS DOUBLE) * 40e0 AS x0, CAST(floor(CAST(s_suppkey AS DOUBLE) / 10e0) AS DOUBLE) * 40e0 AS y0, 38e0 AS w, 38e0 AS h, s_acctbal AS target FROM supplier"""

SIDE = 38.0


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(POINTS.replace("FROM events", "FROM {events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def plots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles with their geometry."""
    rows = spark.sql(PLOTS.replace("FROM supplier", "FROM {supplier}"), supplier=spark.read.parquet(f"{sf_dir}/supplier.parquet"))
    return rows.selectExpr("*", f"{box('x0', 'y0', 'w', 'h')} AS geometry")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
