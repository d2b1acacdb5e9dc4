"""Single-trial decoders by name: one least-squares fit of each unit and trial, with the unit's own response, and what is done to the estimates.

A variant is a function from frames, trials and settings to estimates; ``create_variant`` looks it up,
``register_variant`` adds one. Designs depend on the response, not on the unit, so units with one response share one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from axonframe.operators.design import double_gamma
from axonframe.operators.normal import _solved_sql, solved
from axonframe.operators.regression import shrink
from axonframe.sources.series import DAILY, daily_channels
from axonframe.sources.tables import table

VARIANTS: dict[str, Callable[..., DataFrame]] = {}


def register_variant(name: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        VARIANTS[name] = f
        return f

    return add


def create_variant(name: str, **settings: object) -> Callable[[DataFrame, DataFrame], DataFrame]:
    if name not in VARIANTS:
        raise ValueError(f"unknown variant {name}, known are {sorted(VARIANTS)}")
    return lambda frames, trials: VARIANTS[name](frames, trials, **settings)


def basis_design(frames: DataFrame, trials: DataFrame, basis: list[list[float]]) -> DataFrame:
    """(b, trial, tr, probe, rest): for each response b of ``basis`` and each trial (trial, tr) its own response and that of all other trials, at every frame (tr)."""
    taps = F.array(*(F.struct(F.lit(b).alias("b"), F.lit(i).alias("lag"), F.lit(h).alias("h")) for b, response in enumerate(basis) for i, h in enumerate(response)))
    hits = trials.withColumn("tap", F.explode(taps)).select("trial", (F.col("tr") + F.col("tap.lag")).alias("tr"), F.col("tap.b").alias("b"), F.col("tap.h").alias("h"))
    whole = hits.groupBy("b", "tr").agg(F.sum("h").alias("whole"))
    own = hits.groupBy("b", "trial", "tr").agg(F.sum("h").alias("probe"))
    cells = frames.select("tr").distinct().withColumn("one", F.lit(1)).join(trials.select("trial", F.lit(1).alias("one"), F.explode(F.sequence(F.lit(0), F.lit(len(basis) - 1))).alias("b")), "one").drop("one")
    rows = cells.join(whole, ["b", "tr"], "left").join(own, ["b", "trial", "tr"], "left")
    probe = F.coalesce("probe", F.lit(0.0))
    return rows.select("b", "trial", "tr", probe.alias("probe"), (F.coalesce("whole", F.lit(0.0)) - probe).alias("rest"))


def with_cosine(design: DataFrame) -> DataFrame:
    """Adds the slow column cos(2 pi t), t from 0 to 1 over the frames; the constant is taken out by centring."""
    span = design.agg(F.min("tr").alias("first"), F.greatest(F.max("tr") - F.min("tr"), F.lit(1)).alias("span"))
    return design.join(F.broadcast(span)).withColumn("cos", F.cos(2 * F.pi() * (F.col("tr") - F.col("first")) / F.col("span"))).drop("first", "span")


@register_variant("C")
def per_unit_response(frames: DataFrame, trials: DataFrame, library: list[list[float]]) -> DataFrame:
    """(unit, trial, beta, var) of frames (unit, b, tr, y), where b is the unit's response in ``library``."""
    design = with_cosine(basis_design(frames, trials, library))
    rows = frames.join(design, ["b", "tr"])
    own = W.partitionBy("unit", "trial")
    columns = {"y": "y", "x0": "probe", "x1": "rest", "x2": "cos"}
    fit = solved(rows.select("unit", "trial", *((F.col(c) - F.avg(c).over(own)).alias(n) for n, c in columns.items())), ["unit", "trial"])
    return fit.filter("n > 4").select("unit", "trial", F.col("b0").alias("beta"), (F.greatest(F.col("rss") / (F.col("n") - 4), F.lit(1e-10)) * F.col("i00")).alias("var"))


@register_variant("A")
def one_response(frames: DataFrame, trials: DataFrame, response: list[float]) -> DataFrame:
    return per_unit_response(frames.withColumn("b", F.lit(0)), trials, [response])


def shrunk(estimates: DataFrame) -> DataFrame:
    """Towards the mean of the unit's other trials by precision; units whose trials agree fully keep their estimates."""
    own = W.partitionBy("unit")
    rows = estimates.withColumns({"pm": F.avg("beta").over(own), "pv": F.var_pop("beta").over(own)})
    mean, var = shrink(F.col("beta"), F.col("var"), F.col("pm"), F.col("pv"))
    return rows.select("unit", "trial", F.when(F.col("pv") > 0, mean).otherwise(F.col("beta")).alias("beta"), F.when(F.col("pv") > 0, var).otherwise(F.col("var")).alias("var"))


@register_variant("D")
def one_response_shrunk(frames: DataFrame, trials: DataFrame, response: list[float]) -> DataFrame:
    return shrunk(one_response(frames, trials, response))


@register_variant("CD")
def per_unit_shrunk(frames: DataFrame, trials: DataFrame, library: list[list[float]]) -> DataFrame:
    return shrunk(per_unit_response(frames, trials, library))


LIBRARY = [double_gamma(step, 6) for step in (2.0, 3.0, 4.0)]


def _frames(spark: SparkSession, d: str) -> DataFrame:
    return daily_channels(table(spark, d, "events")).select(F.col("ch").alias("unit"), (F.length("ch") % 3).alias("b"), "tr", F.col("v").alias("y"))


def _trials(spark: SparkSession, d: str) -> DataFrame:
    return _frames(spark, d).select("tr").distinct().filter("tr % 7 = 3").select(F.col("tr").alias("trial"), "tr")


def _run(name: str, spark: SparkSession, d: str, **settings: object) -> DataFrame:
    return create_variant(name, **settings)(_frames(spark, d), _trials(spark, d)).select("unit", "trial", F.round("beta", 4).alias("beta"), F.round("var", 4).alias("var"))


def flobs_design(spark: SparkSession, d: str) -> DataFrame:
    """Three responses, each with a probe and a rest column, and the slow column."""
    rows = with_cosine(basis_design(_frames(spark, d), _trials(spark, d), LIBRARY))
    return rows.select("b", "trial", "tr", *((F.round(c, 6) + 0.0).alias(c) for c in ("probe", "rest", "cos")))


def variant_a(spark: SparkSession, d: str) -> DataFrame:
    return _run("A", spark, d, response=LIBRARY[1])


def variant_c(spark: SparkSession, d: str) -> DataFrame:
    return _run("C", spark, d, library=LIBRARY)


def variant_d(spark: SparkSession, d: str) -> DataFrame:
    return _run("D", spark, d, response=LIBRARY[1])


def variant_cd(spark: SparkSession, d: str) -> DataFrame:
    return _run("CD", spark, d, library=LIBRARY)


def _sql(single: bool) -> str:
    taps = ", ".join(f"({b}, {i}, CAST({h!r} AS DOUBLE))" for b, r in enumerate(LIBRARY[1:2] if single else LIBRARY) for i, h in enumerate(r))
    return f"""{DAILY}, fr AS (SELECT ch AS unit, {'0' if single else 'length(ch) % 3'} AS b, tr, v AS y FROM long), tl AS (SELECT DISTINCT tr AS trial FROM long WHERE tr % 7 = 3), h AS (SELECT * FROM (VALUES {taps}) v(b, lag, h)),
        bs AS (SELECT DISTINCT b FROM h), hit AS (SELECT b, trial, trial + lag AS tr, h FROM tl, h), ds AS (SELECT b, trial, f.tr, coalesce((SELECT sum(h) FROM hit WHERE hit.b = bs.b AND hit.trial = tl.trial AND hit.tr = f.tr), 0) AS probe,
            coalesce((SELECT sum(h) FROM hit WHERE hit.b = bs.b AND hit.trial <> tl.trial AND hit.tr = f.tr), 0) AS rest FROM bs, tl, (SELECT DISTINCT tr FROM long) f),
        dc AS (SELECT *, cos(2 * pi() * (tr - (SELECT min(tr) FROM long)) / (SELECT greatest(max(tr) - min(tr), 1) FROM long)) AS cos FROM ds),
        xr AS (SELECT unit, trial, {', '.join(f'{c} - avg({c}) OVER w AS {n}' for n, c in (('y', 'y'), ('x0', 'probe'), ('x1', 'rest'), ('x2', 'cos')))} FROM fr JOIN dc USING (b, tr) WINDOW w AS (PARTITION BY unit, trial)),
        {_solved_sql('q', 'xr', 'unit, trial', 1e-6)}, e AS (SELECT unit, trial, b0 AS beta, greatest(rss / (n - 4), 1e-10) * i00 AS var FROM q WHERE n > 4),
        sh AS (SELECT *, avg(beta) OVER (PARTITION BY unit) AS pm, var_pop(beta) OVER (PARTITION BY unit) AS pv FROM e)"""


_PLAIN = "SELECT unit, trial, round(beta, 4) AS beta, round(var, 4) AS var FROM e"
_SHRUNK = "SELECT unit, trial, round(CASE WHEN pv > 0 THEN (beta / var + pm / pv) / (1 / var + 1 / pv) ELSE beta END, 4) AS beta, round(CASE WHEN pv > 0 THEN 1 / (1 / var + 1 / pv) ELSE var END, 4) AS var FROM sh"
QUERIES = {f.__name__: f for f in (flobs_design, variant_a, variant_c, variant_d, variant_cd)}
ORACLES = {
    "flobs_design": f"WITH {_sql(False)} SELECT b, trial, tr, round(probe, 6) + 0.0 AS probe, round(rest, 6) + 0.0 AS rest, round(cos, 6) + 0.0 AS cos FROM dc",
    "variant_a": f"WITH {_sql(True)} {_PLAIN}",
    "variant_c": f"WITH {_sql(False)} {_PLAIN}",
    "variant_d": f"WITH {_sql(True)} {_SHRUNK}",
    "variant_cd": f"WITH {_sql(False)} {_SHRUNK}",
}
