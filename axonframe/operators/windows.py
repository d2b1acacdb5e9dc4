"""Window operators along a series. Every window has a total order (series, t) and is partitioned by series."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from axonframe.operators.moments import guarded_corr, pairs
from axonframe.sources.series import DAILY, SERIES, daily_channels, user_series
from axonframe.sources.tables import table


def order() -> WindowSpec:
    return W.partitionBy("sid").orderBy("t")


def causal_z(rows: DataFrame, eps: float = 1e-8, inclusive: bool = False) -> DataFrame:
    """Adds z. Exclusive: row i by rows before it; the first row raw, the second less the first. Inclusive: by rows up to it; fewer than two stay raw."""
    over = order().rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    n, m, s = F.count("v").over(over), F.avg("v").over(over), F.stddev_pop("v").over(over)
    z = (F.col("v") - m) / (s + eps)
    if inclusive:
        return rows.withColumn("z", F.when(n < 2, F.col("v")).otherwise(z))
    return rows.withColumn("z", F.when(n == 0, F.col("v")).when(n == 1, F.col("v") - m).otherwise(z))


def train_z(rows: DataFrame, train: Column, eps: float = 1e-8) -> DataFrame:
    """z with the statistics of the training rows of the series alone."""
    x = F.when(train, F.col("v"))
    over = W.partitionBy("sid")
    return rows.withColumn("z", (F.col("v") - F.avg(x).over(over)) / (F.stddev_pop(x).over(over) + eps))


def sliding(long: DataFrame, width: int) -> DataFrame:
    """(win, ch, tr, v): every row in each of the ``width`` windows that hold it; incomplete windows are the caller's to drop."""
    return long.withColumn("win", F.explode(F.sequence(F.col("tr").cast("long") - width + 1, F.col("tr").cast("long"))))


def sliding_pairs(long: DataFrame, width: int) -> DataFrame:
    w = sliding(long, width)
    a, b = w.select("win", "tr", F.col("ch").alias("ch_i"), F.col("v").alias("x")), w.select("win", "tr", F.col("ch").alias("ch_j"), F.col("v").alias("y"))
    return a.join(b, ["win", "tr"])


def sliding_connectivity(long: DataFrame, width: int, estimator: str = "corr") -> DataFrame:
    stat = guarded_corr("x", "y") if estimator == "corr" else F.covar_samp("x", "y")
    return sliding_pairs(long, width).groupBy("win", "ch_i", "ch_j").agg(stat.alias("stat"), F.count("*").alias("n")).filter(F.col("n") == width).drop("n")


def swc_scaled(long: DataFrame, width: int) -> DataFrame:
    """Population z-scores divided by width - 1: the correlation times width / (width - 1), as a ring buffer gives it."""
    return sliding_connectivity(long, width).withColumn("stat", F.col("stat") * width / (width - 1))


def displacement(rows: DataFrame, cols: list[str]) -> DataFrame:
    """Framewise displacement: the sum of absolute differences to the row before, 0 for the first."""
    return rows.withColumn("fd", F.coalesce(sum((F.abs(F.col(c) - F.lag(c).over(order())) for c in cols[1:]), F.abs(F.col(cols[0]) - F.lag(cols[0]).over(order()))), F.lit(0.0)))


def unwrap(rows: DataFrame, period: float = 2 * math.pi) -> DataFrame:
    """Adds ``unwrapped``: jumps of half a period or more are replaced by their complement, summed up."""
    d = F.col("v") - F.lag("v").over(order())
    wrapped = F.pmod(d + period / 2, F.lit(period)) - period / 2
    wrapped = F.when((wrapped == -period / 2) & (d > 0), period / 2).otherwise(wrapped)
    steps = rows.withColumn("fix", F.when(F.abs(d) < period / 2, 0.0).otherwise(F.coalesce(wrapped - d, F.lit(0.0))))
    return steps.withColumn("unwrapped", F.col("v") + F.sum("fix").over(order().rowsBetween(W.unboundedPreceding, 0))).drop("fix")


def levy(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Levy area of the path (a, b) of each series: half the sum of a db - b da from the start."""
    start = order().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    path = rows.select("sid", "t", (F.col(a) - F.first(a).over(start)).alias("a"), (F.col(b) - F.first(b).over(start)).alias("b"))
    pa, pb = F.lag("a").over(order()), F.lag("b").over(order())
    return path.withColumn("term", pa * (F.col("b") - pb) - pb * (F.col("a") - pa)).groupBy("sid").agg((0.5 * F.coalesce(F.sum("term"), F.lit(0.0))).alias("area"))


def roughness(rows: DataFrame, times: int) -> DataFrame:
    """Mean squared n-th difference of each series."""
    for _ in range(times):
        rows = rows.withColumn("v", F.col("v") - F.lag("v").over(order()))
    return rows.groupBy("sid").agg(F.avg(F.col("v") * F.col("v")).alias("roughness"))


def _series(spark: SparkSession, d: str) -> DataFrame:
    return user_series(table(spark, d, "events"))


def causal_zscore(spark: SparkSession, d: str) -> DataFrame:
    return causal_z(_series(spark, d)).select("sid", "t", F.round("z", 5).alias("z"))


def inclusive_zscore(spark: SparkSession, d: str) -> DataFrame:
    return causal_z(_series(spark, d), 1e-6, True).select("sid", "t", F.round("z", 5).alias("z"))


def train_only_zscore(spark: SparkSession, d: str) -> DataFrame:
    return train_z(_series(spark, d), F.col("event_type") != "click").select("sid", "t", F.round("z", 5).alias("z"))


def sliding_corr(spark: SparkSession, d: str) -> DataFrame:
    return sliding_connectivity(daily_channels(table(spark, d, "events")), 7).select("win", "ch_i", "ch_j", F.round("stat", 5).alias("r"))


def dynamic_cov(spark: SparkSession, d: str) -> DataFrame:
    return sliding_connectivity(daily_channels(table(spark, d, "events")), 7, "cov").select("win", "ch_i", "ch_j", F.round("stat", 5).alias("c"))


def swc_ring(spark: SparkSession, d: str) -> DataFrame:
    return swc_scaled(daily_channels(table(spark, d, "events")), 7).select("win", "ch_i", "ch_j", F.round("stat", 5).alias("r"))


def framewise_displacement(spark: SparkSession, d: str) -> DataFrame:
    rows = _series(spark, d).withColumn("turn", (F.col("event_id") % 7).cast("double"))
    return displacement(rows, ["v", "turn"]).select("sid", "t", F.round("fd", 5).alias("fd"), (F.col("fd") >= 0.5).alias("censored"))


def unwrap_phase(spark: SparkSession, d: str) -> DataFrame:
    rows = _series(spark, d).withColumn("v", F.pmod(F.col("v") * 1.3, F.lit(2 * math.pi)))
    return unwrap(rows).select("sid", "t", F.round("unwrapped", 5).alias("unwrapped"))


def levy_area(spark: SparkSession, d: str) -> DataFrame:
    rows = _series(spark, d).withColumn("turn", (F.col("event_id") % 7).cast("double"))
    return levy(rows, "v", "turn").select("sid", F.round("area", 4).alias("area"))


def smoothness(spark: SparkSession, d: str) -> DataFrame:
    return roughness(_series(spark, d), 2).select("sid", F.round("roughness", 4).alias("roughness"))


_O = "(PARTITION BY sid ORDER BY t"
_WIN = f"{DAILY}, w AS (SELECT *, unnest(generate_series(tr - 6, tr)) AS win FROM long), p AS (SELECT a.win, a.ch AS ch_i, b.ch AS ch_j, a.v AS x, b.v AS y FROM w a JOIN w b ON a.win = b.win AND a.tr = b.tr)"
_R = "coalesce(covar_samp(x, y) / nullif(stddev_samp(x) * stddev_samp(y), 0), 0)"
_TAU = repr(2 * math.pi)

QUERIES = {f.__name__: f for f in (causal_zscore, inclusive_zscore, train_only_zscore, sliding_corr, dynamic_cov, swc_ring, framewise_displacement, unwrap_phase, levy_area, smoothness)}
ORACLES = {
    "causal_zscore": f"""WITH {SERIES}, w AS (SELECT *, count(v) OVER p AS n, avg(v) OVER p AS m, stddev_pop(v) OVER p AS sd FROM s WINDOW p AS {_O} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT sid, t, round(CASE n WHEN 0 THEN v WHEN 1 THEN v - m ELSE (v - m) / (sd + 1e-8) END, 5) AS z FROM w""",
    "inclusive_zscore": f"""WITH {SERIES}, w AS (SELECT *, count(v) OVER p AS n, avg(v) OVER p AS m, stddev_pop(v) OVER p AS sd FROM s WINDOW p AS {_O} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
        SELECT sid, t, round(CASE WHEN n < 2 THEN v ELSE (v - m) / (sd + 1e-6) END, 5) AS z FROM w""",
    "train_only_zscore": f"""WITH {SERIES} SELECT sid, t, round((v - avg(v) FILTER (event_type <> 'click') OVER p) / (stddev_pop(v) FILTER (event_type <> 'click') OVER p + 1e-8), 5) AS z FROM s WINDOW p AS (PARTITION BY sid)""",
    "sliding_corr": f"WITH {_WIN} SELECT win, ch_i, ch_j, round({_R}, 5) AS r FROM p GROUP BY 1, 2, 3 HAVING count(*) = 7",
    "dynamic_cov": f"WITH {_WIN} SELECT win, ch_i, ch_j, round(covar_samp(x, y), 5) AS c FROM p GROUP BY 1, 2, 3 HAVING count(*) = 7",
    "swc_ring": f"WITH {_WIN} SELECT win, ch_i, ch_j, round({_R} * 7 / 6, 5) AS r FROM p GROUP BY 1, 2, 3 HAVING count(*) = 7",
    "framewise_displacement": f"""WITH {SERIES}, f AS (SELECT sid, t, coalesce(abs(v - lag(v) OVER o) + abs(event_id % 7 - lag(event_id % 7) OVER o), 0) AS fd FROM s WINDOW o AS {_O}))
        SELECT sid, t, round(fd, 5) AS fd, fd >= 0.5 AS censored FROM f""",
    "unwrap_phase": f"""WITH {SERIES}, a AS (SELECT sid, t, (v * 1.3 % {_TAU} + {_TAU}) % {_TAU} AS v FROM s), b AS (SELECT *, v - lag(v) OVER {_O}) AS d FROM a),
        c AS (SELECT *, CASE WHEN d IS NULL OR abs(d) < {math.pi!r} THEN 0 ELSE -{_TAU} * sign(d) END AS fix FROM b)
        SELECT sid, t, round(v + sum(fix) OVER {_O}), 5) AS unwrapped FROM c""",
    "levy_area": f"""WITH {SERIES}, p AS (SELECT sid, t, v - first_value(v) OVER o AS a, CAST(event_id % 7 - first_value(event_id % 7) OVER o AS DOUBLE) AS b FROM s WINDOW o AS {_O})),
        q AS (SELECT *, lag(a) OVER o AS pa, lag(b) OVER o AS pb FROM p WINDOW o AS {_O})) SELECT sid, round(0.5 * coalesce(sum(pa * (b - pb) - pb * (a - pa)), 0), 4) AS area FROM q GROUP BY 1""",
    "smoothness": f"""WITH {SERIES}, a AS (SELECT sid, t, v - lag(v) OVER {_O}) AS v FROM s), b AS (SELECT sid, t, v - lag(v) OVER {_O}) AS v FROM a) SELECT sid, round(avg(v * v), 4) AS roughness FROM b GROUP BY 1""",
}
