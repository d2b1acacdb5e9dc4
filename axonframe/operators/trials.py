"""Trials and repeats: first, k-th and averaged repeats, weighted parcels, latency."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from axonframe.sources.series import SERIES, TRIALS, trial_features, user_series
from axonframe.sources.tables import table


def repeats_mean(features: DataFrame) -> DataFrame:
    """(image, k, x): the mean pattern of each image."""
    return features.groupBy("image", "k").agg(F.avg("x").alias("x"))


def first_repeats(trials: DataFrame, k: int = 1) -> DataFrame:
    """The first ``k`` trials of each image; images with fewer are left out."""
    over = W.partitionBy("image").orderBy("trial")
    kept = trials.withColumn("rep", F.row_number().over(over)).filter(F.col("rep") <= k)
    full = kept.filter(F.col("rep") == k).select("image")
    return kept.join(full, "image", "left_semi")


def parcels(values: DataFrame, weights: DataFrame) -> DataFrame:
    """Mean sum(w mu) and variance sum(w^2 var) of (unit, mean, var) over (unit, parcel, w), weights normalised in the parcel."""
    w = weights.withColumn("w", F.col("w") / F.sum("w").over(W.partitionBy("parcel")))
    return values.join(w, "unit").groupBy("parcel").agg(F.sum(F.col("w") * F.col("mean")).alias("mean"), F.sum(F.col("w") ** 2 * F.col("var")).alias("var"))


def latency(rows: DataFrame, correct: str) -> DataFrame:
    """Per series: first correct step, spread, share and last step correct."""
    c = F.expr(correct)
    return rows.groupBy("sid").agg(
        F.min(F.when(c, F.col("t"))).alias("latency"), F.stddev_samp("v").alias("sd"), (F.stddev_samp("v") / F.avg("v")).alias("cv"),
        F.avg(F.when(c, 1.0).otherwise(0.0)).alias("share"), F.max_by(F.when(c, 1).otherwise(0), "t").alias("last_correct"), F.countDistinct("event_type").cast("long").alias("kinds"),
    )


def _features(spark: SparkSession, d: str) -> DataFrame:
    return trial_features(table(spark, d, "embeddings"))


def _trials(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("trial"), F.col("label").alias("image"))


def repeat_avg(spark: SparkSession, d: str) -> DataFrame:
    return repeats_mean(_features(spark, d)).select("image", "k", F.round("x", 6).alias("x"))


def k_rep_avg(spark: SparkSession, d: str) -> DataFrame:
    kept = first_repeats(_trials(spark, d), 3).select("trial")
    return repeats_mean(_features(spark, d).join(kept, "trial", "left_semi")).select("image", "k", F.round("x", 6).alias("x"))


def first_rep(spark: SparkSession, d: str) -> DataFrame:
    return first_repeats(_trials(spark, d), 1).select("image", "trial")


def parcel_mean_var(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "events").groupBy(F.col("user_id").alias("unit")).agg(F.avg("value").alias("mean"), (F.coalesce(F.var_samp("value"), F.lit(0.0)) / F.count("*")).alias("var"))
    w = v.select("unit", (F.col("unit") % 7).alias("parcel"), (1.0 + F.col("unit") % 3).alias("w"))
    return parcels(v, w).select("parcel", F.round("mean", 6).alias("mean"), F.round("var", 6).alias("var"))


def latency_to_correct(spark: SparkSession, d: str) -> DataFrame:
    return latency(user_series(table(spark, d, "events")), "v >= 20").select("sid", "latency", *(F.round(c, 6).alias(c) for c in ("sd", "cv", "share")), F.col("last_correct").cast("long").alias("last_correct"), "kinds")


QUERIES = {f.__name__: f for f in (repeat_avg, k_rep_avg, first_rep, parcel_mean_var, latency_to_correct)}
ORACLES = {
    "repeat_avg": f"WITH {TRIALS} SELECT image, k, round(avg(x), 6) AS x FROM f GROUP BY 1, 2",
    "k_rep_avg": f"""WITH {TRIALS}, r AS (SELECT vec_id AS trial, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rep, count(*) OVER (PARTITION BY label) AS n FROM embeddings)
        SELECT image, k, round(avg(x), 6) AS x FROM f JOIN r USING (trial) WHERE rep <= 3 AND n >= 3 GROUP BY 1, 2""",
    "first_rep": "SELECT label AS image, min(vec_id) AS trial FROM embeddings GROUP BY 1",
    "parcel_mean_var": """WITH v AS (SELECT user_id AS unit, avg(value) AS m, coalesce(var_samp(value), 0) / count(*) AS s FROM events GROUP BY 1),
        w AS (SELECT *, unit % 7 AS parcel, (1.0 + unit % 3) / sum(1.0 + unit % 3) OVER (PARTITION BY unit % 7) AS w FROM v) SELECT parcel, round(sum(w * m), 6) AS mean, round(sum(w * w * s), 6) AS var FROM w GROUP BY 1""",
    "latency_to_correct": f"""WITH {SERIES} SELECT sid, min(t) FILTER (v >= 20) AS latency, round(stddev_samp(v), 6) AS sd, round(stddev_samp(v) / avg(v), 6) AS cv, round(avg(CASE WHEN v >= 20 THEN 1.0 ELSE 0 END), 6) AS share,
        CAST(arg_max(CASE WHEN v >= 20 THEN 1 ELSE 0 END, t) AS BIGINT) AS last_correct, count(DISTINCT event_type) AS kinds FROM s GROUP BY 1""",
}
