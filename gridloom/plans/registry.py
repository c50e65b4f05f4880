"""Registry of queries over the driver's tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S

QUERIES: dict = {}
SQL: dict[str, str] = {}
HOUR = 3600


def query(name: str, sql: str | None = None):
    """Registers a function of (table reader, session) under a name."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))

        run.__name__ = f.__name__
        run.__doc__ = f.__doc__
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return f

    return add


# events stand in for sensors: user_id for the turbine, value for a channel
READ = """
e AS (SELECT user_id AS turbine, extract(year FROM ts)::INT AS year, epoch_us(ts) // 1000000 AS t,
             (epoch_us(ts) // 3600000000) * 3600 AS step, event_type AS cause, value FROM events),
g AS (SELECT turbine, year, step, round(avg(value), 6) AS power, count(*) AS n FROM e GROUP BY 1, 2, 3),
s AS (SELECT turbine, t AS start, t + floor(value * 20)::BIGINT AS "end", cause FROM e)"""


def readings(T) -> DataFrame:
    """turbine, year, step, power, n per hour with data."""
    rows = raw(T).groupBy("turbine", "year", "step").agg(F.round(F.avg("value"), 6).alias("power"), F.count("*").alias("n"))
    return rows


def raw(T) -> DataFrame:
    e = T("events")
    return e.select(
        F.col("user_id").alias("turbine"), F.year("ts").alias("year"), S.epoch_seconds(F.col("ts")).alias("t"),
        S.step_floor(F.col("ts"), HOUR).alias("step"), F.col("event_type").alias("cause"), "value",
    )


def stops(T) -> DataFrame:
    """turbine, start, end, cause: events as intervals."""
    return raw(T).select("turbine", F.col("t").alias("start"), (F.col("t") + F.floor(F.col("value") * 20)).alias("end"), "cause")
