"""Three-column regressions of every series as sums: normal equations by aggregates, a closed-form 3 x 3 inverse, t, F and AR(1).

A series of any length costs its partial sums; no series is gathered into one row. The expressions are
SQL text over the sums, which Spark plans like any other projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from axonframe.operators.gaps import fill_linear, fill_method
from axonframe.sources.series import SERIES, user_series
from axonframe.sources.tables import table

#: Sums of the products of three columns x0, x1, x2 and y.
SUMS = {"a00": "x0 * x0", "a01": "x0 * x1", "a02": "x0 * x2", "a11": "x1 * x1", "a12": "x1 * x2", "a22": "x2 * x2", "c0": "x0 * y", "c1": "x1 * y", "c2": "x2 * y", "yy": "y * y"}


def cofactors(ridge: float) -> dict[str, str]:
    """Entries of the inverse of (A + ridge I), as SQL over the sums; ``det`` has to be a column."""
    a, d, f = (f"(a{k}{k} + {ridge!r})" for k in range(3))
    return {"det": f"({a} * ({d} * {f} - a12 * a12) - a01 * (a01 * {f} - a12 * a02) + a02 * (a01 * a12 - {d} * a02))",
            "i00": f"({d} * {f} - a12 * a12) / det", "i01": f"(a02 * a12 - a01 * {f}) / det", "i02": f"(a01 * a12 - a02 * {d}) / det",
            "i11": f"({a} * {f} - a02 * a02) / det", "i12": f"(a01 * a02 - {a} * a12) / det", "i22": f"({a} * {d} - a01 * a01) / det"}


B = {f"b{k}": " + ".join(f"i{min(k, m)}{max(k, m)} * c{m}" for m in range(3)) for k in range(3)}
RSS = "greatest(yy - 2 * (b0 * c0 + b1 * c1 + b2 * c2) + b0 * b0 * a00 + b1 * b1 * a11 + b2 * b2 * a22 + 2 * (b0 * b1 * a01 + b0 * b2 * a02 + b1 * b2 * a12), 0.0)"


def solved(rows: DataFrame, keys: list[str], ridge: float = 1e-6) -> DataFrame:
    """(keys, n, sums, inverse i.., coefficients b.., rss) of y on x0, x1, x2."""
    sums = rows.groupBy(*keys).agg(F.count("y").alias("n"), *(F.sum(F.expr(e)).alias(n) for n, e in SUMS.items()))
    inverse = cofactors(ridge)
    sums = sums.withColumn("det", F.expr(inverse["det"])).filter("det <> 0")
    sums = sums.withColumns({n: F.expr(e) for n, e in inverse.items() if n != "det"}).withColumns({n: F.expr(e) for n, e in B.items()})
    return sums.withColumn("rss", F.expr(RSS))


def with_drift(series: DataFrame) -> DataFrame:
    """(sid, t, y, x0, x1, x2): intercept, centred trend and one cosine over the n samples of a series, t from 0."""
    n = F.count("*").over(W.partitionBy("sid"))
    rows = series.select("sid", (F.col("t") - 1).alias("t"), F.col("v").alias("y")).withColumn("n", n)
    return rows.select("sid", "t", "y", F.lit(1.0).alias("x0"), (F.col("t") - (F.col("n") - 1) / 2).alias("x1"), F.cos(2 * F.pi() * F.col("t") / F.col("n")).alias("x2"))


def two_tailed_p(t: Column, df: Column, steps: int = 400) -> Column:
    """Student's t: the share of cos(u)^(df - 1) over 0 to pi / 2 that lies beyond atan(t / sqrt(df)), by Simpson's rule."""
    start = F.atan(F.abs(t) / F.sqrt(df))

    def area(low: Column, high: Column) -> Column:
        h = (high - low) / steps
        of = lambda i: F.when((i == 0) | (i == steps), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0) * F.pow(F.greatest(F.cos(low + i * h), F.lit(0.0)), df - 1)
        return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(steps)), of), F.lit(0.0), lambda s, x: s + x) * h

    half = F.pi() / 2
    return area(start, half) / area(F.lit(0.0), half)


def tested(fit: DataFrame) -> DataFrame:
    """Adds t of the second coefficient, its two-tailed p, and F of the second and third being 0."""
    s2 = F.greatest(F.col("rss") / (F.col("n") - 3), F.lit(1e-300))
    joint = F.expr("(b1 * b1 * i22 - 2 * b1 * b2 * i12 + b2 * b2 * i11) / (i11 * i22 - i12 * i12)")
    rows = fit.filter("n > 3").withColumns({"t": F.col("b1") / F.sqrt(s2 * F.col("i11")), "f": joint / 2 / s2, "df": F.col("n") - 3})
    return rows.withColumn("p", two_tailed_p(F.col("t"), F.col("df").cast("double")))


def lagged(rows: DataFrame, *columns: str) -> DataFrame:
    """Adds the value before, as p_<name>; null on a series' first row."""
    along = W.partitionBy("sid").orderBy("t")
    return rows.withColumns({f"p_{c}": F.lag(c).over(along) for c in columns})


def lag_one(rows: DataFrame, fit: DataFrame, mean: float = 0.5, var: float = 0.09) -> DataFrame:
    """(sid, rho): lag-1 autocorrelation of the residuals, shrunk to a Gaussian prior and clipped to 0.99."""
    r = rows.join(fit.select("sid", "b0", "b1", "b2"), "sid").withColumn("r", F.expr("y - b0 * x0 - b1 * x1 - b2 * x2")).select("sid", "t", "r")
    sums = lagged(r, "r").groupBy("sid").agg(F.count("p_r").alias("m"), F.sum(F.col("r") * F.col("p_r")).alias("num"), F.sum(F.col("p_r") ** 2).alias("den"))
    raw = F.col("num") / F.greatest("den", F.lit(1e-12))
    own = F.greatest((1 - F.least(raw * raw, F.lit(0.999))) / F.greatest("m", F.lit(1)), F.lit(1e-12))
    return sums.select("sid", F.greatest(F.least((raw / own + mean / var) / (1 / own + 1 / var), F.lit(0.99)), F.lit(-0.99)).alias("rho"))


def ar1_posterior(rows: DataFrame, rho: DataFrame, precision: float = 0.01, a0: float = 0.01, b0: float = 0.01) -> DataFrame:
    """(sid, mean, var, rho) of the second coefficient: both sides less rho times their last value, then the normal-inverse-gamma update."""
    names = ("y", "x0", "x1", "x2")
    white = lagged(rows, *names).filter("p_y IS NOT NULL").join(rho, "sid").select("sid", "rho", *((F.col(c) - F.col("rho") * F.col(f"p_{c}")).alias(c) for c in names))
    fit = solved(white, ["sid", "rho"], precision)
    sigma2 = F.greatest((b0 + 0.5 * F.col("rss")) / (a0 + F.col("n") / 2 - 1), F.lit(1e-10))
    return fit.select("sid", F.col("b1").alias("mean"), (sigma2 * F.col("i11")).alias("var"), "rho")


def detrended(series: DataFrame) -> DataFrame:
    """(sid, t, v): what a quadratic of each series leaves, t scaled to 0..1."""
    n = F.count("*").over(W.partitionBy("sid"))
    u = (F.col("t") - 1) / F.greatest(n - 1, F.lit(1))
    rows = series.select("sid", "t", F.col("v").alias("y"), F.lit(1.0).alias("x0"), u.alias("x1")).withColumn("x2", F.col("x1") * F.col("x1"))
    return rows.join(solved(rows, ["sid"], 0.0).select("sid", "b0", "b1", "b2"), "sid").select("sid", "t", F.expr("y - b0 - b1 * x1 - b2 * x2").alias("v"))


def hybrid_filled(series: DataFrame, valid: Column, most_linear: int = 3) -> DataFrame:
    """Adds ``filled``: short gaps linearly, longer ones by mean and first harmonic of the series' valid samples."""
    n = F.count("*").over(W.partitionBy("sid"))
    turn = 2 * F.pi() * (F.col("t") - 1) / n
    rows = fill_method(fill_linear(series, valid), valid, most_linear).withColumns({"x0": F.lit(1.0), "x1": F.cos(turn), "x2": F.sin(turn)})
    known = rows.filter(F.col("method") == "keep").withColumn("y", F.col("v"))
    fit = solved(known, ["sid"], 1e-6).select("sid", "b0", "b1", "b2")
    by_waves = F.coalesce(F.expr("b0 + b1 * x1 + b2 * x2"), F.lit(0.0))
    return rows.join(fit, "sid", "left").withColumn("filled", F.when(F.col("method") == "spectral", by_waves).otherwise(F.col("filled"))).drop("x0", "x1", "x2", "b0", "b1", "b2")


def _drift(spark: SparkSession, d: str) -> DataFrame:
    return with_drift(user_series(table(spark, d, "events")))


def glm_multi(spark: SparkSession, d: str) -> DataFrame:
    return tested(solved(_drift(spark, d), ["sid"])).select("sid", *(F.round(c, 4).alias(c) for c in ("b0", "b1", "b2", "t", "p")))


def glm_fstat(spark: SparkSession, d: str) -> DataFrame:
    return tested(solved(_drift(spark, d), ["sid"])).filter("n > 4").select("sid", F.round("f", 4).alias("f"), "df")


def ar1_conjugate(spark: SparkSession, d: str) -> DataFrame:
    rows = _drift(spark, d)
    fit = solved(rows, ["sid"]).filter("n > 5")
    post = ar1_posterior(rows, lag_one(rows, fit))
    snr = F.abs("mean") / F.sqrt(F.greatest("var", F.lit(1e-30)))
    return post.select("sid", F.round("mean", 5).alias("mean"), F.round("var", 6).alias("var"), F.round(snr, 4).alias("snr"), F.round("rho", 5).alias("rho"))


def quadratic_detrend(spark: SparkSession, d: str) -> DataFrame:
    return detrended(user_series(table(spark, d, "events"))).select("sid", "t", F.round("v", 5).alias("v"))


def hybrid_fill(spark: SparkSession, d: str) -> DataFrame:
    return hybrid_filled(user_series(table(spark, d, "events")), F.col("v") >= 5).select("sid", "t", "method", F.round("filled", 5).alias("filled"))


def _solved_sql(name: str, source: str, keys: str, ridge: float) -> str:
    inverse = cofactors(ridge)
    return f"""{name}_s AS (SELECT {keys}, count(y) AS n, {', '.join(f'sum({e}) AS {n}' for n, e in SUMS.items())} FROM {source} GROUP BY {keys}),
        {name}_d AS (SELECT *, {inverse['det']} AS det FROM {name}_s), {name}_i AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in inverse.items() if n != 'det')} FROM {name}_d WHERE det <> 0),
        {name}_b AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in B.items())} FROM {name}_i), {name} AS (SELECT *, {RSS} AS rss FROM {name}_b)"""


_DRIFT = f"""{SERIES}, c AS (SELECT sid, t - 1 AS t, v AS y, count(*) OVER (PARTITION BY sid) AS n FROM s),
    x AS (SELECT sid, t, y, 1.0::DOUBLE AS x0, t - (n - 1) / 2 AS x1, cos(2 * pi() * t / n) AS x2 FROM c), {_solved_sql('f', 'x', 'sid', 1e-6)}"""
_AREA = "list_sum([CASE WHEN i = 0 OR i = 400 THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END * pow(greatest(cos({a} + i * (pi() / 2 - {a}) / 400), 0.0), n - 4) FOR i IN range(0, 401)]) * (pi() / 2 - {a}) / 400"
QUERIES = {f.__name__: f for f in (glm_multi, glm_fstat, ar1_conjugate, quadratic_detrend, hybrid_fill)}
ORACLES = {
    "glm_multi": f"""WITH {_DRIFT}, t AS (SELECT *, b1 / sqrt(greatest(rss / (n - 3), 1e-300) * i11) AS t FROM f WHERE n > 3)
        SELECT sid, round(b0, 4) AS b0, round(b1, 4) AS b1, round(b2, 4) AS b2, round(t, 4) AS t, round(({_AREA.format(a='atan(abs(t) / sqrt(n - 3))')}) / ({_AREA.format(a='0')}), 4) AS p FROM t""",
    "glm_fstat": f"WITH {_DRIFT} SELECT sid, round((b1 * b1 * i22 - 2 * b1 * b2 * i12 + b2 * b2 * i11) / (i11 * i22 - i12 * i12) / 2 / greatest(rss / (n - 3), 1e-300), 4) AS f, n - 3 AS df FROM f WHERE n > 4",
    "ar1_conjugate": f"""WITH {_DRIFT}, r AS (SELECT sid, t, y - b0 - b1 * x1 - b2 * x2 AS r FROM x JOIN f USING (sid) WHERE n > 5), l AS (SELECT *, lag(r) OVER (PARTITION BY sid ORDER BY t) AS p FROM r),
        m AS (SELECT sid, count(p) AS m, sum(r * p) / greatest(sum(p * p), 1e-12) AS raw FROM l GROUP BY 1), o AS (SELECT *, greatest((1 - least(raw * raw, 0.999)) / m, 1e-12) AS own FROM m),
        h AS (SELECT sid, greatest(least((raw / own + 0.5 / 0.09) / (1 / own + 1 / 0.09), 0.99), -0.99) AS rho FROM o),
        g AS (SELECT sid, rho, {', '.join(f'{c} - rho * lag({c}) OVER (PARTITION BY sid ORDER BY t) AS {c}' for c in ('y', 'x0', 'x1', 'x2'))} FROM x JOIN h USING (sid)),
        w AS (SELECT * FROM g WHERE y IS NOT NULL), {_solved_sql('q', 'w', 'sid, rho', 0.01)},
        z AS (SELECT sid, b1 AS mean, greatest((0.01 + 0.5 * rss) / (0.01 + n / 2 - 1), 1e-10) * i11 AS var, rho FROM q)
        SELECT sid, round(mean, 5) AS mean, round(var, 6) AS var, round(abs(mean) / sqrt(greatest(var, 1e-30)), 4) AS snr, round(rho, 5) AS rho FROM z""",
    "quadratic_detrend": f"""WITH {SERIES}, x AS (SELECT sid, t, v AS y, 1.0::DOUBLE AS x0, (t - 1) / greatest(count(*) OVER p - 1, 1) AS x1, ((t - 1) / greatest(count(*) OVER p - 1, 1)) ** 2 AS x2 FROM s WINDOW p AS (PARTITION BY sid)),
        {_solved_sql('f', 'x', 'sid', 0.0)} SELECT sid, t, round(y - b0 - b1 * x1 - b2 * x2, 5) AS v FROM x JOIN f USING (sid)""",
    "hybrid_fill": f"""WITH {SERIES}, m AS (SELECT *, t - row_number() OVER (PARTITION BY sid, v >= 5 ORDER BY t) AS g, CASE WHEN v >= 5 THEN t END AS vt, CASE WHEN v >= 5 THEN v END AS vv,
            cos(2 * pi() * (t - 1) / count(*) OVER (PARTITION BY sid)) AS x1, sin(2 * pi() * (t - 1) / count(*) OVER (PARTITION BY sid)) AS x2 FROM s),
        w AS (SELECT *, CASE WHEN v >= 5 THEN 'keep' WHEN count(*) OVER (PARTITION BY sid, v >= 5, g) <= 3 THEN 'linear' ELSE 'spectral' END AS method,
            last_value(vt IGNORE NULLS) OVER a AS lt, last_value(vv IGNORE NULLS) OVER a AS lv, first_value(vt IGNORE NULLS) OVER b AS rt, first_value(vv IGNORE NULLS) OVER b AS rv FROM m
            WINDOW a AS (PARTITION BY sid ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), b AS (PARTITION BY sid ORDER BY t ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
        k AS (SELECT sid, v AS y, 1.0::DOUBLE AS x0, x1, x2 FROM w WHERE method = 'keep'), {_solved_sql('f', 'k', 'sid', 1e-6)}
        SELECT sid, t, method, round(CASE method WHEN 'spectral' THEN coalesce(b0 + b1 * x1 + b2 * x2, 0) ELSE coalesce(vv, (lv / (t - lt) + rv / (rt - t)) / (1.0 / (t - lt) + 1.0 / (rt - t)), lv, rv, 0) END, 5) AS filled FROM w LEFT JOIN f USING (sid)""",
}
