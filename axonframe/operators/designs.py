"""Regression of every series on any number of columns: packed cross products by partial aggregates, solved by sweeps.

A series of any length costs k (k + 1) / 2 sums, added up before the shuffle, so a series that holds a
third of all rows is spread like any other. The sums of a series are one small matrix; sweeping its
columns one after the other gives inverse, coefficients and residual sum of squares together. A
column that the earlier ones explain (its pivot falls below ``TINY`` of its sum of squares) gets
coefficient 0. Rows with a null column are left out.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from axonframe.operators.design import double_gamma
from axonframe.operators.normal import lagged, two_tailed_p
from axonframe.operators.resampling import shuffled
from axonframe.plans.session import cut
from axonframe.sources.series import SERIES, daily_channels, user_series
from axonframe.sources.tables import table

TINY = 1e-9


def crossed(rows: DataFrame, keys: list[str], columns: Sequence[str], y: str = "y") -> DataFrame:
    """(keys, n, cross): sums of the products of the columns and y, as a full (k + 1) x (k + 1) matrix."""
    names = [*columns, y]
    whole = rows.filter(functools.reduce(operator.and_, (F.col(c).isNotNull() for c in names)))
    pairs = {(i, j): F.sum(F.col(a).cast("double") * F.col(b)).alias(f"__{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j}
    sums = whole.groupBy(*keys).agg(F.count("*").alias("n"), *pairs.values())
    matrix = F.array(*(F.array(*(F.col(f"__{min(i, j)}_{max(i, j)}") for j in range(len(names)))) for i in range(len(names))))
    return sums.select(*keys, "n", matrix.alias("cross"))


def swept(matrix: Column, first: Column, k: int) -> Column:
    """``matrix`` after sweeping its first k columns; ``first`` is the matrix that pivots are compared with."""

    def step(m: Column, p: Column) -> Column:
        d, fine = m[p][p], m[p][p] > TINY * first[p][p]

        def entry(v: Column, i: Column, j: Column) -> Column:
            there = F.when((i == p) & (j == p), -1 / d).when((i == p) | (j == p), v / d).otherwise(v - m[i][p] * m[p][j] / d)
            gone = F.when((i == p) | (j == p), F.lit(0.0)).otherwise(v)
            return F.when(fine, there).otherwise(gone)

        return F.transform(m, lambda row, i: F.transform(row, lambda v, j: entry(v, i, j)))

    return F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), matrix, step)


def ridged(matrix: Column, k: int, ridge: Column | float) -> Column:
    return F.transform(matrix, lambda row, i: F.transform(row, lambda v, j: F.when((i == j) & (i < k), v + ridge).otherwise(v)))


def solved(sums: DataFrame, k: int, ridge: Column | float = 0.0) -> DataFrame:
    """Adds beta ARRAY, inverse ARRAY OF ARRAYS, rss and r2 (of y around 0) to (.., cross)."""
    plain = isinstance(ridge, (int, float)) and ridge == 0
    m = sums.withColumn("__first", F.col("cross") if plain else ridged(F.col("cross"), k, ridge))
    m = m.withColumn("__swept", swept(F.col("__first"), F.col("__first"), k))
    cut_off = lambda row: F.slice(row, 1, k)
    found = m.withColumns({"beta": F.transform(cut_off(F.col("__swept")), lambda row: row[k]), "inverse": F.transform(cut_off(F.col("__swept")), lambda row: F.transform(cut_off(row), lambda v: -v))})
    length = F.aggregate("beta", F.lit(0.0), lambda s, b: s + b * b)
    left = F.col("__swept")[k][k] - (F.lit(0.0) if plain else ridge * length)
    found = found.withColumn("rss", F.greatest(left, F.lit(0.0)))
    return found.withColumn("r2", F.when(F.col("cross")[k][k] > 0, 1 - F.col("rss") / F.col("cross")[k][k])).drop("__first", "__swept")


def fitted(rows: DataFrame, keys: list[str], columns: Sequence[str], y: str = "y", ridge: Column | float = 0.0) -> DataFrame:
    return solved(crossed(rows, keys, columns, y), len(columns), ridge)


def weighed(array: Column, weights: Sequence[float]) -> Column:
    return functools.reduce(operator.add, (w * array[i] for i, w in enumerate(weights) if w), F.lit(0.0))


def contrast(fit: DataFrame, weights: Sequence[float], name: str = "c", with_p: bool = True) -> DataFrame:
    """Adds effect, t and two-tailed p of a weighted sum of the coefficients, named after ``name``."""
    effect, df = weighed(F.col("beta"), weights), F.col("n") - len(weights)
    var = functools.reduce(operator.add, (a * b * F.col("inverse")[i][j] for i, a in enumerate(weights) for j, b in enumerate(weights) if a and b), F.lit(0.0))
    s2 = F.greatest(F.col("rss") / df, F.lit(1e-300))
    t = F.when(var > 0, effect / F.sqrt(s2 * var))
    found = fit.withColumns({f"{name}_effect": effect, f"{name}_t": t})
    return found if not with_p else found.withColumn(f"{name}_p", two_tailed_p(F.col(f"{name}_t"), df.cast("double")))


def joint(fit: DataFrame, weights: Sequence[Sequence[float]], name: str = "f") -> DataFrame:
    """Adds F of all rows of ``weights`` being 0 together: their covariance is swept like a cross product."""
    q, k = len(weights), len(weights[0])
    effects = [weighed(F.col("beta"), w) for w in weights]
    cov = [[functools.reduce(operator.add, (a * b * F.col("inverse")[i][j] for i, a in enumerate(u) for j, b in enumerate(v) if a and b), F.lit(0.0)) for v in weights] for u in weights]
    whole = F.array(*(F.array(*row, effects[i]) for i, row in enumerate(cov)), F.array(*effects, F.lit(0.0)))
    rows = fit.withColumn("__joint", whole)
    s2 = F.greatest(F.col("rss") / (F.col("n") - k), F.lit(1e-300))
    return rows.withColumn(name, -swept(F.col("__joint"), F.col("__joint"), q)[q][q] / q / s2).drop("__joint")


def residuals(rows: DataFrame, fit: DataFrame, keys: list[str], columns: Sequence[str], y: str = "y") -> DataFrame:
    """``rows`` with ``residual``: y less what the columns explain."""
    by = fit.select(*keys, F.col("beta").alias("__beta"))
    explained = functools.reduce(operator.add, (F.col("__beta")[i] * F.col(c) for i, c in enumerate(columns)))
    return rows.join(by, keys).withColumn("residual", F.col(y) - explained).drop("__beta")


def lag_one(rows: DataFrame, fit: DataFrame, columns: Sequence[str], mean: float = 0.5, var: float = 0.09) -> DataFrame:
    """(sid, rho): lag-1 autocorrelation of the residuals, shrunk to a Gaussian prior and clipped to 0.99."""
    left = residuals(rows, fit, ["sid"], columns).select("sid", "t", F.col("residual").alias("r"))
    sums = lagged(left, "r").groupBy("sid").agg(F.count("p_r").alias("m"), F.sum(F.col("r") * F.col("p_r")).alias("num"), F.sum(F.col("p_r") ** 2).alias("den"))
    raw = F.col("num") / F.greatest("den", F.lit(1e-12))
    own = F.greatest((1 - F.least(raw * raw, F.lit(0.999))) / F.greatest("m", F.lit(1)), F.lit(1e-12))
    return sums.select("sid", F.greatest(F.least((raw / own + mean / var) / (1 / own + 1 / var), F.lit(0.99)), F.lit(-0.99)).alias("rho"))


def ar1_posterior(rows: DataFrame, rho: DataFrame, columns: Sequence[str], precision: float = 0.01, a0: float = 0.01, b0: float = 0.01) -> DataFrame:
    """(sid, rho, n, beta, var ARRAY): both sides less rho times their last value, then the normal-inverse-gamma update of all coefficients."""
    names = ("y", *columns)
    white = lagged(rows, *names).filter("p_y IS NOT NULL").join(rho, "sid").select("sid", "rho", *((F.col(c) - F.col("rho") * F.col(f"p_{c}")).alias(c) for c in names))
    fit = fitted(white, ["sid", "rho"], columns, ridge=precision)
    sigma2 = F.greatest((b0 + 0.5 * F.col("rss")) / (a0 + F.col("n") / 2 - 1), F.lit(1e-10))
    return fit.withColumn("var", F.transform("inverse", lambda row, i: sigma2 * row[i])).select("sid", "rho", "n", "beta", "var")


def conjugate(rows: DataFrame, columns: Sequence[str], precision: float = 0.01, a0: float = 0.01, b0: float = 0.01) -> DataFrame:
    """(sid, n, beta, var ARRAY): the normal-inverse-gamma posterior of any design with white noise."""
    fit = fitted(rows, ["sid"], columns, ridge=precision)
    energy = 0.5 * (F.col("rss") + precision * F.aggregate("beta", F.lit(0.0), lambda s, b: s + b * b))
    sigma2 = (b0 + energy) / F.greatest(a0 + F.col("n") / 2 - 1, F.lit(1e-3))
    return fit.withColumn("var", F.transform("inverse", lambda row, i: sigma2 * row[i])).select("sid", "n", "beta", "var")


def column_curve(rows: DataFrame, keys: list[str], base: Sequence[str], more: Sequence[str], y: str = "y") -> DataFrame:
    """(keys, columns, n, r2): how well y is fitted by ``base`` (its first column constant) with none, one, .. all of ``more``, all from one set of sums.

    Groups without spread have no r2; those with fewer rows than columns are left out.
    """
    names = [*base, *more]
    sums = cut(crossed(rows, keys, names, y))
    found = None
    for k in range(len(more) + 1):
        p = len(base) + k
        keep = lambda a: F.concat(F.slice(a, 1, p), F.slice(a, len(names) + 1, 1))  # noqa: B023, E731
        part = sums.filter(F.col("n") > p).withColumn("cross", F.transform(keep(F.col("cross")), keep))
        spread = F.col("cross")[p][p] - F.col("cross")[0][p] * F.col("cross")[0][p] / F.col("cross")[0][0]
        fit = solved(part, p).select(*keys, F.lit(k).cast("long").alias("columns"), "n", F.when(spread > 1e-12, 1 - F.col("rss") / spread).alias("r2"))
        found = fit if found is None else found.union(fit)
    return found


def permutation_max_t(rows: DataFrame, design: DataFrame, columns: Sequence[str], weights: Sequence[float], times: int) -> DataFrame:
    """(perm, t): the largest |t| of a contrast over all series (sid, t, y), with the rows of ``design`` (t, columns) as they are (perm 0) and in ``times`` other orders.

    An order is shared by all series. Only times are put in order, in stretches; the fits are sums by permutation and series.
    """
    axis = cut(shuffled(design.select(F.col("t").alias("trial"), F.lit(0).alias("k"), F.col("t").alias("x")), times).select("draw", "pos", F.col("x").alias("t")))
    moved = axis.join(axis.filter("draw = 0").select("pos", F.col("t").alias("from")), "pos").select(F.col("draw").alias("perm"), "t", "from")
    drawn = moved.join(design.withColumnRenamed("t", "from"), "from").select("perm", "t", *columns)
    fit = fitted(rows.select("sid", "t", "y").join(drawn, "t"), ["perm", "sid"], columns)
    return contrast(fit.filter(F.col("n") > len(columns)), weights, with_p=False).groupBy("perm").agg(F.max(F.abs("c_t")).alias("t"))


def best_response(frames: DataFrame, onsets: DataFrame, library: list[list[float]], nuisance: Sequence[str]) -> DataFrame:
    """(sid, response, r2, beta): for each series the response of ``library`` that explains most beside the ``nuisance`` columns of ``frames`` (sid, t, y, ..).

    Onsets (sid, t) are spread over their taps and summed by frame; the library is of fixed size.
    """
    taps = F.array(*(F.struct(F.lit(k).alias("response"), F.lit(i).cast("long").alias("lag"), F.lit(h).alias("h")) for k, r in enumerate(library) for i, h in enumerate(r)))
    hits = onsets.select("sid", "t", F.explode(taps).alias("tap")).groupBy("sid", (F.col("t") + F.col("tap.lag")).alias("t"), F.col("tap.response").alias("response")).agg(F.sum("tap.h").alias("signal"))
    each = frames.withColumn("response", F.explode(F.sequence(F.lit(0), F.lit(len(library) - 1))))
    rows = each.join(hits, ["sid", "t", "response"], "left").withColumn("signal", F.coalesce("signal", F.lit(0.0)))
    fit = fitted(rows, ["sid", "response"], [*nuisance, "signal"])
    best = fit.groupBy("sid").agg(F.max_by(F.struct("response", "r2", "n", F.col("beta")[len(nuisance)].alias("beta")), F.struct("r2", -F.col("response"))).alias("x"))
    return best.select("sid", "x.*")


COLUMNS = ("one", "line", "square", "cos1", "sin1", "cos2", "sin2", "onset")
LIBRARY = [double_gamma(step, 6) for step in (1.5, 3.0, 4.5)]


def _design(spark: SparkSession, d: str) -> DataFrame:
    """Series of users with eight columns: a quadratic, two harmonics and purchases."""
    n = F.count("*").over(W.partitionBy("sid"))
    s = user_series(table(spark, d, "events")).withColumn("u", (F.col("t") - 1) / n)
    turn = 2 * F.pi() * F.col("u")
    waves = {"cos1": F.cos(turn), "sin1": F.sin(turn), "cos2": F.cos(2 * turn), "sin2": F.sin(2 * turn)}
    return s.withColumns({"y": F.col("v"), "one": F.lit(1.0), "line": F.col("u"), "square": F.col("u") * F.col("u"), **waves, "onset": (F.col("event_type") == "purchase").cast("double")})


def glm_design(spark: SparkSession, d: str) -> DataFrame:
    """Eight coefficients of every series, in long form."""
    fit = fitted(_design(spark, d), ["sid"], COLUMNS).filter(F.col("n") > len(COLUMNS) + 2)
    return fit.select("sid", F.posexplode("beta").alias("col", "beta")).select("sid", "col", F.round("beta", 3).alias("beta"))


def glm_contrasts(spark: SparkSession, d: str) -> DataFrame:
    """t and p of purchases against the line, and F of the four waves."""
    fit = fitted(_design(spark, d), ["sid"], COLUMNS).filter(F.col("n") > len(COLUMNS) + 2)
    waves = [[float(i == j) for i in range(8)] for j in range(3, 7)]
    rows = joint(contrast(fit, [0, -1, 0, 0, 0, 0, 0, 1], "c"), waves)
    return rows.select("sid", *(F.round(c, 4).alias(c) for c in ("c_effect", "c_t", "c_p", "f", "r2")))


def ar1_design(spark: SparkSession, d: str) -> DataFrame:
    """The AR(1) posterior of eight coefficients."""
    rows = _design(spark, d)
    fit = fitted(rows, ["sid"], COLUMNS, ridge=1e-6).filter(F.col("n") > len(COLUMNS) + 2)
    post = ar1_posterior(rows, lag_one(rows, fit, COLUMNS), COLUMNS)
    return post.select("sid", F.round("rho", 5).alias("rho"), F.round(F.col("beta")[7], 4).alias("onset"), F.round(F.col("var")[7], 5).alias("var"))


def conjugate_design(spark: SparkSession, d: str) -> DataFrame:
    post = conjugate(_design(spark, d), COLUMNS)
    return post.select("sid", F.round(F.col("beta")[7], 4).alias("onset"), F.round(F.col("var")[7], 4).alias("var"), F.round(F.col("beta")[0], 4).alias("one"))


def perm_contrast_t(spark: SparkSession, d: str) -> DataFrame:
    """The weekly wave of the channels' days against 200 orders of the days: the largest t, its 95th percentile by chance and the corrected p."""
    days = daily_channels(table(spark, d, "events")).select(F.col("ch").alias("sid"), F.col("tr").alias("t"), F.col("v").alias("y"))
    turn = 2 * F.pi() * F.col("t") / 7
    design = days.select("t").distinct().select("t", F.lit(1.0).alias("one"), F.col("t").cast("double").alias("line"), F.cos(turn).alias("cos"), F.sin(turn).alias("sin"))
    found = permutation_max_t(days, design, ["one", "line", "cos", "sin"], [0.0, 0.0, 1.0, 0.0], 200)
    seen = found.filter("perm = 0").select(F.col("t").alias("observed"))
    return found.filter("perm > 0").join(F.broadcast(seen)).groupBy("observed").agg(F.percentile("t", F.lit(0.95)).alias("fwer95"), F.avg((F.col("t") >= F.col("observed")).cast("double")).alias("p"), F.count("*").alias("perms"))


def response_choice(spark: SparkSession, d: str) -> DataFrame:
    frames = _design(spark, d)
    best = best_response(frames, frames.filter("onset = 1").select("sid", "t"), LIBRARY, ["one", "line"])
    return best.filter("n > 5").select("sid", "response", F.round("r2", 6).alias("r2"), F.round("beta", 4).alias("beta"))


def solve_sql(name: str, source: str, keys: str, columns: Sequence[str], ridge: float = 0.0, y: str = "y") -> str:
    """The same sweeps for DuckDB: ``name`` has (keys, n, sums, m), m being the swept matrix."""
    names, k = [*columns, y], len(columns)
    rows = ", ".join("[" + ", ".join(f"sum(({a})::DOUBLE * ({b}))" for b in names) + "]" for a in names)
    again = ", ".join(f"s.{x.strip()}" for x in keys.split(","))
    gone = "CASE WHEN i - 1 = s.p OR j - 1 = s.p THEN 0.0 ELSE v END"
    there = "CASE WHEN i - 1 = s.p AND j - 1 = s.p THEN -1 / s.m[s.p + 1][s.p + 1] WHEN i - 1 = s.p OR j - 1 = s.p THEN v / s.m[s.p + 1][s.p + 1] ELSE v - s.m[i][s.p + 1] * s.m[s.p + 1][j] / s.m[s.p + 1][s.p + 1] END"
    entry = f"CASE WHEN s.m[s.p + 1][s.p + 1] > {TINY!r} * s.diagonal[s.p + 1] THEN {there} ELSE {gone} END"
    return f"""{name}_c AS (SELECT {keys}, count(*) AS n, [{rows}] AS sums FROM {source} WHERE {' AND '.join(f'({c}) IS NOT NULL' for c in names)} GROUP BY {keys}),
        {name}_r AS (SELECT *, list_transform(sums, lambda line_, i: list_transform(line_, lambda v, j: CASE WHEN i = j AND i <= {k} THEN v + {ridge!r} ELSE v END)) AS m FROM {name}_c),
        {name}_s AS (SELECT *, 0 AS p, [m[i][i] FOR i IN range(1, {k + 1})] AS diagonal FROM {name}_r UNION ALL
            SELECT {again}, s.n, s.sums, list_transform(s.m, lambda line_, i: list_transform(line_, lambda v, j: {entry})), s.p + 1, s.diagonal FROM {name}_s s WHERE s.p < {k}),
        {name} AS (SELECT * FROM {name}_s WHERE p = {k})"""


_X = f"""{SERIES}, u AS (SELECT *, (t - 1)::DOUBLE / count(*) OVER (PARTITION BY sid) AS u FROM s),
    x AS (SELECT sid, t, v AS y, 1.0 AS one, u AS line, u * u AS square, cos(2 * pi() * u) AS cos1, sin(2 * pi() * u) AS sin1, cos(4 * pi() * u) AS cos2, sin(4 * pi() * u) AS sin2, (event_type = 'purchase')::DOUBLE AS onset FROM u)"""
_P = "list_sum([CASE WHEN i = 0 OR i = 400 THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END * pow(greatest(cos({a} + i * (pi() / 2 - {a}) / 400), 0.0), n - 9) FOR i IN range(0, 401)]) * (pi() / 2 - {a}) / 400"
_JOINT = """w AS (SELECT sid, n, greatest(m[9][9], 0) / (n - 8) AS s2, sums, m, [[-m[a][b] FOR b IN range(4, 8)] || [m[a][9]] FOR a IN range(4, 8)] || [[m[a][9] FOR a IN range(4, 8)] || [0.0]] AS g FROM f WHERE n > 10),
    js AS (SELECT sid, g AS m, 0 AS p FROM w UNION ALL SELECT sid, list_transform(m, lambda line_, i: list_transform(line_, lambda v, j: CASE WHEN i - 1 = p AND j - 1 = p THEN -1 / m[p + 1][p + 1]
        WHEN i - 1 = p OR j - 1 = p THEN v / m[p + 1][p + 1] ELSE v - m[i][p + 1] * m[p + 1][j] / m[p + 1][p + 1] END)), p + 1 FROM js WHERE p < 4)"""
QUERIES = {f.__name__: f for f in (glm_design, glm_contrasts, ar1_design, conjugate_design, response_choice, perm_contrast_t)}
_F8 = solve_sql("f", "x", "sid", COLUMNS)
ORACLES = {
    "glm_design": f"WITH RECURSIVE {_X}, {_F8} SELECT sid, unnest(range(0, 8))::INT AS col, round(unnest([m[i][9] FOR i IN range(1, 9)]), 3) AS beta FROM f WHERE n > 10",
    "glm_contrasts": f"""WITH RECURSIVE {_X}, {_F8}, {_JOINT}, t AS (SELECT w.*, js.m AS j, w.m[8][9] - w.m[2][9] AS effect, (w.m[8][9] - w.m[2][9]) / sqrt(greatest(s2, 1e-300) * -(w.m[8][8] + w.m[2][2] - 2 * w.m[2][8])) AS t FROM w JOIN js USING (sid) WHERE js.p = 4)
        SELECT sid, round(effect, 4) AS c_effect, round(t, 4) AS c_t, round(({_P.format(a='atan(abs(t) / sqrt(n - 8))')}) / ({_P.format(a='0')}), 4) AS c_p, round(-j[5][5] / 4 / greatest(s2, 1e-300), 4) AS f, round(1 - greatest(m[9][9], 0) / sums[9][9], 4) AS r2 FROM t""",
    "ar1_design": f"""WITH RECURSIVE {_X}, {solve_sql("f", "x", "sid", COLUMNS, 1e-6)}, r AS (SELECT x.sid, t, y - ({' + '.join(f'm[{i + 1}][9] * {c}' for i, c in enumerate(COLUMNS))}) AS r FROM x JOIN f USING (sid) WHERE n > 10),
        l AS (SELECT *, lag(r) OVER (PARTITION BY sid ORDER BY t) AS p FROM r), q AS (SELECT sid, count(p) AS m, sum(r * p) / greatest(sum(p * p), 1e-12) AS raw FROM l GROUP BY 1),
        o AS (SELECT *, greatest((1 - least(raw * raw, 0.999)) / m, 1e-12) AS own FROM q), h AS (SELECT sid, greatest(least((raw / own + 0.5 / 0.09) / (1 / own + 1 / 0.09), 0.99), -0.99) AS rho FROM o),
        g AS (SELECT sid, rho, {', '.join(f'{c} - rho * lag({c}) OVER (PARTITION BY sid ORDER BY t) AS {c}' for c in ('y', *COLUMNS))} FROM x JOIN h USING (sid)), {solve_sql("z", "g", "sid, rho", COLUMNS, 0.01)}
        SELECT sid, round(rho, 5) AS rho, round(m[8][9], 4) AS onset, round(greatest((0.01 + 0.5 * greatest(m[9][9] - 0.01 * list_sum([m[i][9] ** 2 FOR i IN range(1, 9)]), 0)) / (0.01 + n / 2 - 1), 1e-10) * -m[8][8], 5) AS var FROM z""",
    "conjugate_design": f"""WITH RECURSIVE {_X}, {solve_sql("f", "x", "sid", COLUMNS, 0.01)}
        SELECT sid, round(m[8][9], 4) AS onset, round((0.01 + 0.5 * (greatest(m[9][9] - 0.01 * list_sum([m[i][9] ** 2 FOR i IN range(1, 9)]), 0) + 0.01 * list_sum([m[i][9] ** 2 FOR i IN range(1, 9)]))) / greatest(0.01 + n / 2 - 1, 1e-3) * -m[8][8], 4) AS var, round(m[1][9], 4) AS one FROM f""",
    "response_choice": f"""WITH RECURSIVE {_X}, h AS (SELECT * FROM (VALUES {', '.join(f'({k}, {i}, {v!r}::DOUBLE)' for k, r in enumerate(LIBRARY) for i, v in enumerate(r))}) v(response, lag, h)),
        c AS (SELECT sid, t + lag AS t, response, sum(h) AS signal FROM x, h WHERE onset = 1 GROUP BY ALL),
        e AS (SELECT x.sid, x.t, r.response, y, one, line, coalesce(signal, 0) AS signal FROM x, (SELECT DISTINCT response FROM h) r LEFT JOIN c ON c.sid = x.sid AND c.t = x.t AND c.response = r.response), {solve_sql("f", "e", "sid, response", ("one", "line", "signal"))},
        b AS (SELECT *, 1 - greatest(m[4][4], 0) / sums[4][4] AS r2 FROM f WHERE sums[4][4] > 0), k AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY r2 DESC, response) AS k FROM b)
        SELECT sid, response, round(r2, 6) AS r2, round(m[3][4], 4) AS beta FROM k WHERE k = 1 AND n > 5""",
}
