"""Session-level passes along a series: autocorrelation, running repeats, windowed signatures, bins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from axonframe.operators.windows import causal_z, order
from axonframe.sources.series import SERIES, user_series
from axonframe.sources.tables import table


def lag_one(rows: DataFrame, most: float = 0.95, default: float = 0.3) -> DataFrame:
    """(sid, rho): lag-1 autocorrelation of the centred series, clipped; the default where it isn't defined."""
    r = rows.withColumn("r", F.col("v") - F.avg("v").over(W.partitionBy("sid")))
    p = r.withColumn("before", F.lag("r").over(order()))
    rho = F.sum(F.col("r") * F.col("before")) / F.nullif(F.sum(F.col("before") ** 2), F.lit(0.0))
    return p.groupBy("sid").agg(F.coalesce(F.greatest(F.least(rho, F.lit(most)), F.lit(-most)), F.lit(default)).alias("rho"))


def running_repeats(rows: DataFrame, image: str) -> DataFrame:
    """Causal z, then the mean over the image's repeats so far."""
    upto = W.partitionBy("sid", image).orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    return causal_z(rows).withColumn("mean", F.avg("z").over(upto)).withColumn("rep", F.count("z").over(upto))


def windowed_levy(rows: DataFrame, a: str, b: str, width: int) -> DataFrame:
    """Levy area of the last ``width`` rows at every row; before the start stands the first row, which adds nothing."""
    pa, pb = F.lag(a).over(order()), F.lag(b).over(order())
    terms = rows.withColumn("term", F.coalesce(pa * (F.col(b) - pb) - pb * (F.col(a) - pa), F.lit(0.0)))
    frame, inner = order().rowsBetween(1 - width, 0), order().rowsBetween(2 - width, 0)
    a0, b0 = F.first(a).over(frame), F.first(b).over(frame)
    return terms.withColumn("area", 0.5 * (F.sum("term").over(inner) - a0 * (F.col(b) - b0) + b0 * (F.col(a) - a0)))


def binned(rows: DataFrame, ratio: int) -> DataFrame:
    """Means of ``ratio`` consecutive samples."""
    return rows.groupBy("sid", F.floor((F.col("t") - 1) / ratio).alias("bin")).agg(F.avg("v").alias("v"), F.count("*").alias("n"))


def prior_shrink(rows: DataFrame, train: str) -> DataFrame:
    """Each series' mean on its test rows, shrunk to the mean and variance of its training rows by precision."""
    c = F.expr(train)
    s = rows.groupBy("sid").agg(
        F.avg(F.when(c, F.col("v"))).alias("pm"), F.var_pop(F.when(c, F.col("v"))).alias("pv"),
        F.avg(F.when(~c, F.col("v"))).alias("m"), (F.var_samp(F.when(~c, F.col("v"))) / F.count(F.when(~c, 1))).alias("var"),
    )
    p = 1 / F.col("var") + 1 / F.col("pv")
    return s.filter("pv > 0 AND var > 0").select("sid", ((F.col("m") / F.col("var") + F.col("pm") / F.col("pv")) / p).alias("mean"), (1 / p).alias("var"))


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return user_series(table(spark, d, "events")).withColumn("turn", (F.col("event_id") % 7).cast("double"))


def session_rho(spark: SparkSession, d: str) -> DataFrame:
    return lag_one(_rows(spark, d)).select("sid", F.round("rho", 6).alias("rho"))


def running_repeat_avg(spark: SparkSession, d: str) -> DataFrame:
    return running_repeats(_rows(spark, d), "event_type").select("sid", "t", F.round("mean", 4).alias("mean"), "rep")


def levy_windows(spark: SparkSession, d: str) -> DataFrame:
    return windowed_levy(_rows(spark, d), "v", "turn", 20).select("sid", "t", F.round("area", 4).alias("area"))


def bin_average(spark: SparkSession, d: str) -> DataFrame:
    return binned(_rows(spark, d), 4).select("sid", "bin", F.round("v", 6).alias("v"), "n")


def train_prior_shrink(spark: SparkSession, d: str) -> DataFrame:
    return prior_shrink(_rows(spark, d), "event_id % 2 = 0").select("sid", F.round("mean", 5).alias("mean"), F.round("var", 5).alias("var"))


_O = "(PARTITION BY sid ORDER BY t"
QUERIES = {f.__name__: f for f in (session_rho, running_repeat_avg, levy_windows, bin_average, train_prior_shrink)}
ORACLES = {
    "session_rho": f"""WITH {SERIES}, r AS (SELECT sid, t, v - avg(v) OVER (PARTITION BY sid) AS r FROM s), p AS (SELECT *, lag(r) OVER {_O}) AS b FROM r)
        SELECT sid, round(coalesce(greatest(least(sum(r * b) / nullif(sum(b * b), 0), 0.95), -0.95), 0.3), 6) AS rho FROM p GROUP BY 1""",
    "running_repeat_avg": f"""WITH {SERIES}, w AS (SELECT *, count(v) OVER p AS n, avg(v) OVER p AS m, stddev_pop(v) OVER p AS sd FROM s WINDOW p AS {_O} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        z AS (SELECT sid, t, event_type, CASE n WHEN 0 THEN v WHEN 1 THEN v - m ELSE (v - m) / (sd + 1e-8) END AS z FROM w)
        SELECT sid, t, round(avg(z) OVER q, 4) AS mean, count(z) OVER q AS rep FROM z WINDOW q AS (PARTITION BY sid, event_type ORDER BY t ROWS UNBOUNDED PRECEDING)""",
    "levy_windows": f"""WITH {SERIES}, p AS (SELECT sid, t, v AS a, CAST(event_id % 7 AS DOUBLE) AS b FROM s),
        j AS (SELECT x.sid, x.t, y.a, y.b, lag(y.a) OVER w AS pa, lag(y.b) OVER w AS pb, first_value(y.a) OVER w AS a0, first_value(y.b) OVER w AS b0 FROM p x JOIN p y ON x.sid = y.sid AND y.t BETWEEN x.t - 19 AND x.t WINDOW w AS (PARTITION BY x.sid, x.t ORDER BY y.t))
        SELECT sid, t, round(0.5 * coalesce(sum((pa - a0) * (b - pb) - (pb - b0) * (a - pa)), 0), 4) AS area FROM j GROUP BY 1, 2""",
    "bin_average": f"WITH {SERIES} SELECT sid, (t - 1) // 4 AS bin, round(avg(v), 6) AS v, count(*) AS n FROM s GROUP BY 1, 2",
    "train_prior_shrink": f"""WITH {SERIES}, a AS (SELECT sid, avg(v) FILTER (event_id % 2 = 0) AS pm, var_pop(v) FILTER (event_id % 2 = 0) AS pv, avg(v) FILTER (event_id % 2 = 1) AS m, var_samp(v) FILTER (event_id % 2 = 1) / count(*) FILTER (event_id % 2 = 1) AS q FROM s GROUP BY 1)
        SELECT sid, round((m / q + pm / pv) / (1 / q + 1 / pv), 5) AS mean, round(1 / (1 / q + 1 / pv), 5) AS var FROM a WHERE pv > 0 AND q > 0""",
}
