"""Design matrices in long form: events to frames, responses by a join on the lag, readiness of trials."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from axonframe.sources.tables import table


def double_gamma(tr: float, n: int) -> list[float]:
    """The canonical response (shapes 6 and 16, ratio 1/6) sampled every ``tr`` seconds, with peak 1."""

    def density(t: float, k: float) -> float:
        return t ** (k - 1) * math.exp(-t) / math.gamma(k) if t > 0 else 0.0

    h = [density(i * tr, 6) - density(i * tr, 16) / 6 for i in range(n)]
    top = max(h) or 1.0
    return [x / top for x in h]


def impulses(events: DataFrame, tr: float) -> DataFrame:
    """(run, tr): frames with an event, onsets rounded half to even, repeats set once."""
    return events.select("run", F.bround(F.col("onset") / tr, 0).cast("long").alias("tr")).distinct()


def convolve(points: DataFrame, response: list[float]) -> DataFrame:
    """(keys, tr, x): the causal convolution, as a lag explode and a sum. The response has a fixed length."""
    taps = F.array(*(F.struct(F.lit(i).alias("lag"), F.lit(h).alias("h")) for i, h in enumerate(response)))
    keys = [c for c in points.columns if c != "tr"]
    return points.withColumn("tap", F.explode(taps)).groupBy(*keys, (F.col("tr") + F.col("tap.lag")).alias("tr")).agg(F.sum("tap.h").alias("x"))


def single_trial(points: DataFrame, response: list[float]) -> DataFrame:
    """(run, trial, tr, probe, rest): for each trial its own response, and what the other trials of the run add."""
    probe = convolve(points.withColumn("trial", F.col("tr")), response).withColumnRenamed("x", "probe")
    whole = convolve(points, response).withColumnRenamed("x", "whole")
    return probe.join(whole, ["run", "tr"]).select("run", "trial", "tr", "probe", (F.col("whole") - F.col("probe")).alias("rest"))


def lookup(trials: DataFrame, frames: DataFrame, delay: int) -> DataFrame:
    """Frames ``delay`` after each trial; trials whose frame is out of range are dropped."""
    return trials.withColumn("tr", F.col("tr") + delay).join(frames, ["run", "tr"])


def latest_ready(trials: DataFrame, frames: DataFrame, wait: int) -> DataFrame:
    """(run, tr, trial, ready): per frame the latest trial whose window has passed, and how many have; no theta join, one pass along the run."""
    marks = trials.select("run", (F.col("tr") + wait).alias("tr"), F.lit(0).alias("kind"), F.col("tr").alias("trial"))
    both = marks.unionByName(frames.select("run", "tr", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("trial")))
    upto = W.partitionBy("run").orderBy("tr", "kind", "trial").rowsBetween(W.unboundedPreceding, 0)
    seen = both.withColumns({"latest": F.max("trial").over(upto), "ready": F.count("trial").over(upto)})
    return seen.filter("kind = 1").select("run", "tr", F.col("latest").alias("trial"), "ready")


TR = 21600.0
HRF = double_gamma(3.0, 8)


def _onsets(spark: SparkSession, d: str) -> DataFrame:
    """Seconds since the run's first event; a run is a user."""
    s = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, d, "events").select(F.col("user_id").alias("run"), (s - F.min(s).over(W.partitionBy("user_id"))).alias("onset"))


def event_impulses(spark: SparkSession, d: str) -> DataFrame:
    return impulses(_onsets(spark, d), TR)


def hrf_convolve(spark: SparkSession, d: str) -> DataFrame:
    return convolve(impulses(_onsets(spark, d), TR), HRF).select("run", "tr", F.round("x", 6).alias("x"))


def lss_design(spark: SparkSession, d: str) -> DataFrame:
    return single_trial(impulses(_onsets(spark, d), TR), HRF).select("run", "trial", "tr", F.round("probe", 6).alias("probe"), (F.round("rest", 6) + 0.0).alias("rest"))


def run_offset_lookup(spark: SparkSession, d: str) -> DataFrame:
    points = impulses(_onsets(spark, d), TR)
    return lookup(points.withColumn("trial", F.col("tr")), convolve(points, HRF), 2).select("run", "trial", "tr", F.round("x", 6).alias("x"))


def ready_trials(spark: SparkSession, d: str) -> DataFrame:
    points = impulses(_onsets(spark, d), TR)
    return latest_ready(points, points, 8)


_IMP = f"""o AS (SELECT user_id AS run, epoch_us(ts) / 1e6 AS s FROM events), i AS (SELECT DISTINCT run, CAST(round_even((s - m) / {TR}, 0) AS BIGINT) AS tr
    FROM (SELECT run, s, min(s) OVER (PARTITION BY run) AS m FROM o))"""
_TAPS = "h AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, CAST({x!r} AS DOUBLE))" for k, x in enumerate(HRF)) + ") v(lag, h))"
_CONV = f"{_IMP}, {_TAPS}, c AS (SELECT run, tr + lag AS tr, sum(h) AS x FROM i, h GROUP BY 1, 2)"
QUERIES = {f.__name__: f for f in (event_impulses, hrf_convolve, lss_design, run_offset_lookup, ready_trials)}
ORACLES = {
    "event_impulses": f"WITH {_IMP} SELECT run, tr FROM i",
    "hrf_convolve": f"WITH {_CONV} SELECT run, tr, round(x, 6) AS x FROM c",
    "lss_design": f"WITH {_CONV} SELECT i.run, i.tr AS trial, c.tr, round(h, 6) AS probe, round(x - h, 6) + 0.0 AS rest FROM i, h, c WHERE c.run = i.run AND c.tr = i.tr + lag",
    "run_offset_lookup": f"WITH {_CONV} SELECT i.run, i.tr AS trial, c.tr, round(x, 6) AS x FROM i JOIN c ON c.run = i.run AND c.tr = i.tr + 2",
    "ready_trials": f"WITH {_IMP} SELECT f.run, f.tr, max(t.tr) AS trial, count(t.tr) AS ready FROM i f LEFT JOIN i t ON t.run = f.run AND t.tr + 8 <= f.tr GROUP BY 1, 2",
}
