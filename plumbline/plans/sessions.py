"""Session windows over the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import adapters
from ..streaming import sessions, windows
from .evaluation import DIGITS, rounded

QUERIES: dict = {}
SQL: dict[str, str] = {}


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXT Z-05: a user's events less than 45 minutes apart."""
    events = adapters.table(spark, sf_dir, "events")
    scores = windows.event_scores(events, "user_id")
    out = rounded(sessions.sessions(scores, "45 minutes"), "mean_score")
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.select("user_id", text("start"), text("end"), "count", "tp", "fp", "mean_score")


QUERIES["event_sessions"] = event_sessions
SQL["event_sessions"] = f"""WITH e AS (SELECT user_id, ts AS t, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y, least(greatest(value / 100, 0), 1) AS s FROM events WHERE value IS NOT NULL),
  n AS (SELECT *, CASE WHEN t - lag(t) OVER w < INTERVAL 45 MINUTE THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)),
  g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM n)
  SELECT user_id, strftime(min(t), '%Y-%m-%d %H:%M:%S') AS "start", strftime(max(t) + INTERVAL 45 MINUTE, '%Y-%m-%d %H:%M:%S') AS "end", count(*) AS count, count(*) FILTER (y = 1 AND s >= 0.5) AS tp,
    count(*) FILTER (y = 0 AND s >= 0.5) AS fp, round(avg(s), {DIGITS}) AS mean_score FROM g GROUP BY user_id, k"""
