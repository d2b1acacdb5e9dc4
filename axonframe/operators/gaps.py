"""Filling censored samples: as-of in both directions, run lengths, choice of method."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from axonframe.sources.series import SERIES, user_series
from axonframe.sources.tables import table


def order() -> WindowSpec:
    return W.partitionBy("sid").orderBy("t")


def fill_linear(rows: DataFrame, valid: Column) -> DataFrame:
    """Adds ``filled``: invalid samples from the nearest valid ones, weighted by inverse distance; one side alone if there is one, else 0."""
    x = F.when(valid, F.struct("t", "v"))
    left = F.last(x, ignorenulls=True).over(order().rowsBetween(W.unboundedPreceding, -1))
    right = F.last(x, ignorenulls=True).over(W.partitionBy("sid").orderBy(F.desc("t")).rowsBetween(W.unboundedPreceding, -1))  # a running value; one that looks ahead would be sought anew for each row
    both = rows.withColumns({"l": left, "r": right})
    wl, wr = 1 / (F.col("t") - F.col("l.t")), 1 / (F.col("r.t") - F.col("t"))
    blend = (F.col("l.v") * wl + F.col("r.v") * wr) / (wl + wr)
    return both.withColumn("filled", F.when(valid, F.col("v")).otherwise(F.coalesce(blend, "l.v", "r.v", F.lit(0.0)))).drop("l", "r")


def islands(rows: DataFrame, valid: Column) -> DataFrame:
    """(sid, start, length) of the runs of invalid samples."""
    marked = rows.withColumn("ok", valid).withColumn("run", F.sum(F.when(F.col("ok"), 1).otherwise(0)).over(order()))
    return marked.filter(~F.col("ok")).groupBy("sid", "run").agg(F.min("t").alias("start"), F.count("*").alias("length")).drop("run")


def fill_method(rows: DataFrame, valid: Column, most_linear: int = 3) -> DataFrame:
    """Adds ``method``: keep, linear in gaps of up to ``most_linear`` samples, else spectral."""
    marked = rows.withColumn("ok", valid).withColumn("run", F.sum(F.when(F.col("ok"), 1).otherwise(0)).over(order()))
    gap = F.sum(F.when(~F.col("ok"), 1).otherwise(0)).over(W.partitionBy("sid", "run"))
    return marked.withColumn("method", F.when(F.col("ok"), "keep").when(gap <= most_linear, "linear").otherwise("spectral")).drop("ok", "run")


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return user_series(table(spark, d, "events"))


def linear_fill(spark: SparkSession, d: str) -> DataFrame:
    return fill_linear(_rows(spark, d), F.col("event_id") % 5 != 0).select("sid", "t", F.round("filled", 6).alias("filled"))


def censor_runs(spark: SparkSession, d: str) -> DataFrame:
    return islands(_rows(spark, d), F.col("v") >= 5)


def hybrid_fill_mask(spark: SparkSession, d: str) -> DataFrame:
    return fill_method(_rows(spark, d), F.col("v") >= 5).select("sid", "t", "method")


_O = "(PARTITION BY sid ORDER BY t"
QUERIES = {f.__name__: f for f in (linear_fill, censor_runs, hybrid_fill_mask)}
ORACLES = {
    "linear_fill": f"""WITH {SERIES}, m AS (SELECT *, CASE WHEN event_id % 5 <> 0 THEN t END AS vt, CASE WHEN event_id % 5 <> 0 THEN v END AS vv FROM s),
        w AS (SELECT *, last_value(vt IGNORE NULLS) OVER p AS lt, last_value(vv IGNORE NULLS) OVER p AS lv, first_value(vt IGNORE NULLS) OVER f AS rt, first_value(vv IGNORE NULLS) OVER f AS rv FROM m
            WINDOW p AS {_O} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), f AS {_O} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
        SELECT sid, t, round(coalesce(vv, (lv / (t - lt) + rv / (rt - t)) / (1.0 / (t - lt) + 1.0 / (rt - t)), lv, rv, 0), 6) AS filled FROM w""",
    "censor_runs": f"""WITH {SERIES}, m AS (SELECT *, t - row_number() OVER (PARTITION BY sid, v >= 5 ORDER BY t) AS g FROM s)
        SELECT sid, min(t) AS start, count(*) AS length FROM m WHERE v < 5 GROUP BY sid, g""",
    "hybrid_fill_mask": f"""WITH {SERIES}, m AS (SELECT *, t - row_number() OVER (PARTITION BY sid, v >= 5 ORDER BY t) AS g FROM s)
        SELECT sid, t, CASE WHEN v >= 5 THEN 'keep' WHEN count(*) OVER (PARTITION BY sid, v >= 5, g) <= 3 THEN 'linear' ELSE 'spectral' END AS method FROM m""",
}
