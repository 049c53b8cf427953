"""Queries that run as streams over the events, checked against the same rows in one batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from resonant.plans.registry import query
from resonant.streaming import streams as T

_CLOSED = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"


@query(
    "t_tumbling",
    f"""SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2
HAVING time_bucket(INTERVAL 1 DAY, any_value(ts)) + INTERVAL 1 DAY <= {_CLOSED}""",
)
def t_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.to_end(T.tumbling(T.event_stream(spark, sf_dir), "1 day"))


@query(
    "t_sliding",
    f"""WITH w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) - k * INTERVAL 6 HOUR AS start, value FROM events, (SELECT unnest(range(2)) AS k))
SELECT start, count(*) AS n, round(max(value), 6) AS peak FROM w GROUP BY 1 HAVING start + INTERVAL 12 HOUR <= {_CLOSED}""",
)
def t_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.to_end(T.sliding(T.event_stream(spark, sf_dir), "12 hours", "6 hours"))


@query(
    "t_session",
    f"""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 8 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 8 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 8 HOUR <= {_CLOSED}""",
)
def t_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.to_end(T.sessions(T.event_stream(spark, sf_dir), "8 hours"))


@query("t_without_replays", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def t_without_replays(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = T.event_stream(spark, sf_dir)
    return T.to_end(T.without_replays(stream.unionByName(stream)).select("event_id", "event_type")).groupBy("event_type").count().withColumnRenamed("count", "n")


@query("t_stateful_filter")
def t_stateful_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recursion over each user's events: tested against a plain loop."""
    return T.to_end(T.smoothed(T.event_stream(spark, sf_dir), 0.25))
