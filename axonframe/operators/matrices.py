"""Small matrices as edge tables: inversion by sweeps, what follows from precision, packing and unpacking.

A sweep of one channel is two joins of the matrix with that channel's row; channels are few by nature. Each
matrix row lives on its own, so a matrix of some thousand channels is spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from axonframe.operators.moments import covariance, pairs
from axonframe.plans.session import cut
from axonframe.sources.series import DAILY, daily_channels
from axonframe.sources.tables import table


def swept(matrix: DataFrame, names: list[str]) -> DataFrame:
    """(i, j, v) after sweeping the channels ``names`` of a symmetric matrix; of all its channels this is minus the inverse.

    A step uses the last matrix four times, so lineage is cut after each.
    """
    for k in names:
        row = matrix.filter(F.col("i") == F.lit(k)).select("j", F.col("v").alias("r"))
        left = row.select(F.col("j").alias("i"), F.col("r").alias("l"))
        d = matrix.filter((F.col("i") == F.lit(k)) & (F.col("j") == F.lit(k))).select(F.col("i").alias("k"), F.col("v").alias("d"))
        met = matrix.join(row, "j").join(left, "i").withColumn("k", F.lit(k)).join(d, "k")
        i, j = F.col("i") == F.col("k"), F.col("j") == F.col("k")
        new = F.when(i & j, -1 / F.col("d")).when(i | j, F.col("v") / F.col("d")).otherwise(F.col("v") - F.col("l") * F.col("r") / F.col("d"))
        matrix = cut(met.select("i", "j", new.alias("v")))
    return matrix


def inverse(matrix: DataFrame, ridge: float = 1e-6) -> DataFrame:
    """(i, j, v) of the inverse of a symmetric positive definite matrix plus ridge; every pair has to be there."""
    v = F.col("v") + F.when(F.col("i") == F.col("j"), ridge).otherwise(0.0)
    names = sorted(r["i"] for r in matrix.select("i").distinct().collect())
    return swept(matrix.select("i", "j", v.alias("v")), names).select("i", "j", (-F.col("v")).alias("v"))


def with_diagonals(matrix: DataFrame) -> DataFrame:
    d = matrix.filter("i = j").select("i", F.col("v").alias("di"))
    return matrix.join(d, "i").join(d.select(F.col("i").alias("j"), F.col("di").alias("dj")), "j")


def partial_correlation(precision: DataFrame) -> DataFrame:
    """-P_ij / sqrt(P_ii P_jj), 1 on the diagonal."""
    r = F.when(F.col("i") == F.col("j"), 1.0).otherwise(-F.col("v") / F.sqrt(F.col("di") * F.col("dj")))
    return with_diagonals(precision).select("i", "j", r.alias("v"))


def partial_covariance(precision: DataFrame) -> DataFrame:
    """-P_ij / (P_ii P_jj^2): neither symmetric nor a conditional variance, but the definition; see ``conditional_variance``."""
    return with_diagonals(precision).select("i", "j", (-F.col("v") / (F.col("di") * F.col("dj")) / F.col("dj")).alias("v"))


def conditional_variance(precision: DataFrame) -> DataFrame:
    return precision.filter("i = j").select("i", (1 / F.col("v")).alias("v"))


def mutual_information(precision: DataFrame) -> DataFrame:
    """(i, j, v) in nats: what two channels share given all others, -log(1 - r^2) / 2 of the partial correlation; 0 on the diagonal."""
    return partial_correlation(precision).select("i", "j", F.when(F.col("i") == F.col("j"), 0.0).otherwise(-0.5 * F.log(1 - F.col("v") ** 2)).alias("v"))


def mardia(long: DataFrame, precision: DataFrame) -> DataFrame:
    """Mean squared Mahalanobis distance to the power of two, over the times that have all channels."""
    means = long.groupBy("ch").agg(F.avg("v").alias("m"))
    centred = long.join(means, "ch").select("ch", "tr", (F.col("v") - F.col("m")).alias("v"))
    d2 = pairs(centred).join(precision.select(F.col("i").alias("ch_i"), F.col("j").alias("ch_j"), F.col("v").alias("p")), ["ch_i", "ch_j"])
    return d2.groupBy("tr").agg(F.sum(F.col("x") * F.col("y") * F.col("p")).alias("d2")).agg(F.avg(F.col("d2") ** 2).alias("kurtosis"), F.count("*").alias("n"))


def toeplitz(column: DataFrame, row: DataFrame | None = None) -> DataFrame:
    """(i, j, v) from the first column (k, v) and row, by default the same: cell (i, j) has lag i - j."""
    row = column if row is None else row
    lags = column.select(F.col("k").alias("lag"), "v").union(row.filter("k > 0").select(-F.col("k"), "v"))
    n = column.agg(F.max("k").alias("last"))
    cells = column.select(F.col("k").alias("i")).join(F.broadcast(n)).select("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("j"))
    return cells.withColumn("lag", F.col("i") - F.col("j")).join(lags, "lag").select("i", "j", "v")


def packed_upper(matrix: DataFrame) -> DataFrame:
    """(k, v): the cells above the diagonal, row by row; i and j count from 0."""
    n = F.col("n")
    sized = matrix.filter("i < j").join(F.broadcast(matrix.agg((F.max("i") + 1).alias("n"))))
    return sized.select((F.col("i") * n - F.expr("i * (i + 1) div 2") + F.col("j") - F.col("i") - 1).alias("k"), "v")


def unpacked(vector: DataFrame, diagonal: float = 0.0) -> DataFrame:
    """(i, j, v): the symmetric matrix of a vector (k, v) of upper cells, row by row; n follows from the length."""
    n = vector.agg(((1 + F.sqrt(1 + 8 * F.count("*"))) / 2).cast("long").alias("n"))
    i = F.ceil(F.col("n") - 0.5 - F.sqrt((F.col("n") - 0.5) ** 2 - 2 * (F.col("k") + 1)) - 1e-9).cast("long") - 1
    rows = vector.join(F.broadcast(n)).withColumn("i", i)
    upper = rows.select("i", (F.col("k") - (F.col("i") * F.col("n") - F.expr("i * (i + 1) div 2")) + F.col("i") + 1).alias("j"), "v")
    cells = upper.union(upper.select("j", "i", "v"))
    return cells.union(n.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i")).select("i", "i", F.lit(diagonal)))


def _cov(spark: SparkSession, d: str) -> DataFrame:
    return covariance(daily_channels(table(spark, d, "events"))).select(F.col("ch_i").alias("i"), F.col("ch_j").alias("j"), F.col("c").alias("v"))


def _named(df: DataFrame, name: str, places: int = 5) -> DataFrame:
    return df.select(F.col("i").alias("ch_i"), F.col("j").alias("ch_j"), F.round("v", places).alias(name))


def precision(spark: SparkSession, d: str) -> DataFrame:
    return _named(inverse(_cov(spark, d)), "p")


def partial_corr(spark: SparkSession, d: str) -> DataFrame:
    return _named(partial_correlation(inverse(_cov(spark, d))), "r")


def partial_cov(spark: SparkSession, d: str) -> DataFrame:
    return _named(partial_covariance(inverse(_cov(spark, d))), "c")


def pair_cmi(spark: SparkSession, d: str) -> DataFrame:
    return _named(mutual_information(inverse(_cov(spark, d), 1e-4)), "cmi")


def conditional_cov(spark: SparkSession, d: str) -> DataFrame:
    """Covariance of the channels given the last one: its sweep alone."""
    m = _cov(spark, d)
    last = m.agg(F.max("i")).first()[0]
    return _named(swept(m, [] if last is None else [last]).filter((F.col("i") != F.lit(last)) & (F.col("j") != F.lit(last))), "c")


def kurtosis_mardia(spark: SparkSession, d: str) -> DataFrame:
    long = daily_channels(table(spark, d, "events"))
    return mardia(long, inverse(_cov(spark, d), 0.0)).select(F.round("kurtosis", 4).alias("kurtosis"), "n")


def toeplitz_lags(spark: SparkSession, d: str) -> DataFrame:
    """The autocovariance sums of the first channel, as a matrix over lags 0 to 4."""
    long = daily_channels(table(spark, d, "events")).filter("ch = 'click'").select("tr", "v")
    lag = long.select(F.col("tr").alias("u"), F.col("v").alias("w"))
    found = long.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long")))).join(lag, F.col("u") == F.col("tr") + F.col("k")).groupBy("k").agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    return toeplitz(found).select("i", "j", F.round("v", 5).alias("v"))


def vector_to_matrix(spark: SparkSession, d: str) -> DataFrame:
    """The covariances of the channels, by their places, packed into a vector and laid out again with 1 on the diagonal."""
    m = _cov(spark, d)
    names = m.filter("i = j").select("i", (F.row_number().over(W.orderBy("i")) - 1).cast("long").alias("a"))
    placed = m.join(names, "i").join(names.select(F.col("i").alias("j"), F.col("a").alias("b")), "j").select(F.col("a").alias("i"), F.col("b").alias("j"), "v")
    return unpacked(packed_upper(placed), 1.0).select("i", "j", F.round("v", 6).alias("v"))


def _sweeps(ridge: float, last_only: bool = False) -> str:
    steps = [f"""{DAILY}, o AS (SELECT ch, row_number() OVER (ORDER BY ch) AS k FROM (SELECT DISTINCT ch FROM long)),
        m0 AS MATERIALIZED (SELECT a.ch AS i, b.ch AS j, covar_samp(a.v, b.v) + CASE WHEN a.ch = b.ch THEN {ridge!r} ELSE 0 END AS v FROM long a JOIN long b ON a.tr = b.tr GROUP BY 1, 2)"""]
    for k in ((5,) if last_only else range(1, 6)):
        old = "m0" if last_only else f"m{k - 1}"
        steps.append(f"""m{k} AS MATERIALIZED (SELECT a.i, a.j, CASE WHEN a.i = o.ch AND a.j = o.ch THEN -1 / p.v WHEN a.i = o.ch OR a.j = o.ch THEN a.v / p.v ELSE a.v - l.v * r.v / p.v END AS v
            FROM {old} a JOIN o ON o.k = {k} JOIN {old} p ON p.i = o.ch AND p.j = o.ch JOIN {old} l ON l.i = a.i AND l.j = o.ch JOIN {old} r ON r.i = o.ch AND r.j = a.j)""")
    return ", ".join([*steps, "p AS (SELECT i, j, -v AS v FROM m5), q AS (SELECT p.i, p.j, p.v, a.v AS di, b.v AS dj FROM p JOIN p a ON a.i = p.i AND a.j = p.i JOIN p b ON b.i = p.j AND b.j = p.j)"])


QUERIES = {f.__name__: f for f in (precision, partial_corr, partial_cov, pair_cmi, conditional_cov, kurtosis_mardia, toeplitz_lags, vector_to_matrix)}
ORACLES = {
    "precision": f"WITH {_sweeps(1e-6)} SELECT i AS ch_i, j AS ch_j, round(v, 5) AS p FROM p",
    "partial_corr": f"WITH {_sweeps(1e-6)} SELECT i AS ch_i, j AS ch_j, round(CASE WHEN i = j THEN 1.0 ELSE -v / sqrt(di * dj) END, 5) AS r FROM q",
    "partial_cov": f"WITH {_sweeps(1e-6)} SELECT i AS ch_i, j AS ch_j, round(-v / (di * dj) / dj, 5) AS c FROM q",
    "pair_cmi": f"WITH {_sweeps(1e-4)} SELECT i AS ch_i, j AS ch_j, round(CASE WHEN i = j THEN 0.0 ELSE -0.5 * ln(1 - v * v / (di * dj)) END, 5) AS cmi FROM q",
    "conditional_cov": f"WITH {_sweeps(0.0, True)} SELECT i AS ch_i, j AS ch_j, round(v, 5) AS c FROM m5 WHERE i <> (SELECT max(ch) FROM o) AND j <> (SELECT max(ch) FROM o)",
    "kurtosis_mardia": f"""WITH {_sweeps(0.0)}, e AS (SELECT ch, tr, v - avg(v) OVER (PARTITION BY ch) AS v FROM long), d AS (SELECT a.tr, sum(a.v * b.v * p.v) AS d2 FROM e a JOIN e b ON a.tr = b.tr JOIN p ON p.i = a.ch AND p.j = b.ch GROUP BY 1)
        SELECT round(avg(d2 * d2), 4) AS kurtosis, count(*) AS n FROM d""",
    "toeplitz_lags": f"""WITH {DAILY}, c AS (SELECT tr, v FROM long WHERE ch = 'click'), k AS (SELECT b.tr - a.tr AS k, sum(a.v * b.v) AS v FROM c a JOIN c b ON b.tr - a.tr BETWEEN 0 AND 4 GROUP BY 1)
        SELECT CAST(i.k AS BIGINT) AS i, CAST(j.k AS BIGINT) AS j, round(x.v, 5) AS v FROM k i, k j JOIN k x ON x.k = abs(i.k - j.k)""",
    "vector_to_matrix": f"""WITH {DAILY}, o AS (SELECT ch, row_number() OVER (ORDER BY ch) - 1 AS k FROM (SELECT DISTINCT ch FROM long))
        SELECT x.k AS i, y.k AS j, round(CASE WHEN x.k = y.k THEN 1.0 ELSE covar_samp(a.v, b.v) END, 6) AS v FROM long a JOIN long b ON a.tr = b.tr JOIN o x ON x.ch = a.ch JOIN o y ON y.ch = b.ch GROUP BY x.k, y.k""",
}
