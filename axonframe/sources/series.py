"""The shapes that operators work on, built from stored tables: channels, series, trials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def day_number(ts: str = "ts") -> Column:
    """Days from 2023-12-31, so equal days of different months stay apart."""
    return F.datediff(F.col(ts).cast("date"), F.lit("2023-12-31").cast("date")).cast("long")


def daily_channels(events: DataFrame) -> DataFrame:
    """(ch, tr, v): the mean of ``value`` for each event type and day, days counted from 2024-01-01 as 1."""
    return events.groupBy(F.col("event_type").alias("ch"), day_number().alias("tr")).agg(F.avg("value").alias("v"))


def user_series(events: DataFrame) -> DataFrame:
    """(sid, t, v, event_id, event_type): the events of a user, numbered in time order."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(F.col("user_id").alias("sid"), F.row_number().over(order).cast("long").alias("t"), F.col("value").alias("v"), "event_id", "event_type")


def trial_features(embeddings: DataFrame) -> DataFrame:
    """(trial, image, k, x): trial patterns in long form, feature by feature."""
    return embeddings.select(F.col("vec_id").alias("trial"), F.col("label").alias("image"), F.posexplode("embedding").alias("k", "x0")).select("trial", "image", F.col("k").cast("long").alias("k"), F.col("x0").cast("double").alias("x"))


DAY = "date_diff('day', DATE '2023-12-31', CAST(ts AS DATE))"
DAILY = f"long AS (SELECT event_type AS ch, {DAY} AS tr, avg(value) AS v FROM events GROUP BY 1, 2)"
SERIES = "s AS (SELECT user_id AS sid, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t, value AS v, event_id, event_type FROM events)"
TRIALS = "f AS (SELECT vec_id AS trial, label AS image, unnest(generate_series(0, len(embedding) - 1)) AS k, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"
