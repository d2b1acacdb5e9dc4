"""Resampling: permutations, bootstraps and splits as seeded hashes, so that reruns agree and nothing is drawn on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from axonframe.operators.evaluation import rdm, rdm_agreement
from axonframe.operators.trials import repeats_mean
from axonframe.plans.session import cut
from axonframe.sources.series import daily_channels, trial_features
from axonframe.sources.tables import table


#: Bits of a hash.
BITS = 40


def hashed(*keys: Column) -> Column:
    """A whole number of ``BITS`` bits that depends on the keys alone."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << BITS))


def uniform(*keys: Column) -> Column:
    """A number in [0, 1) that depends on the keys alone."""
    return hashed(*keys) / float(1 << BITS)


def repeated(df: DataFrame, times: int, name: str) -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def shuffled(flat: DataFrame, draws: int, salts: int = 32) -> DataFrame:
    """(draw, pos, k, x) of (trial, k, x): in draws from 1 each feature in an order of its own, in draw 0 all in the same.

    The order is that of a hash; rows are numbered within stretches of it, whose counts are summed up.
    """
    u = F.when(F.col("draw") == 0, uniform(F.lit(0), F.col("trial"))).otherwise(uniform(F.col("draw"), F.col("k"), F.col("trial")))
    placed = repeated(flat, draws + 1, "draw").withColumn("u", u).withColumn("salt", F.floor(F.col("u") * salts).cast("int"))
    cells = placed.groupBy("draw", "k", "salt").agg(F.count("*").alias("n"))
    based = cells.withColumn("base", F.coalesce(F.sum("n").over(W.partitionBy("draw", "k").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    own = F.row_number().over(W.partitionBy("draw", "k", "salt").orderBy("u", "trial"))
    return placed.withColumn("own", own).join(based, ["draw", "k", "salt"]).select("draw", (F.col("base") + F.col("own")).alias("pos"), "k", "x")


def permutation_max(long: DataFrame, times: int) -> DataFrame:
    """(perm, stat): max over channels of |corr(v, permuted time)|; permutation 0 is the data. Exactly ``times`` permutations follow.

    One permutation of the time axis is shared by all channels; only the time axis, not the data, is sorted.
    """
    axis = repeated(long.select("tr").distinct(), times + 1, "perm")
    by = lambda c: F.row_number().over(W.partitionBy("perm").orderBy(c, "tr"))
    drawn = axis.select("perm", "tr", F.when(F.col("perm") == 0, by(F.col("tr"))).otherwise(by(uniform(F.col("perm"), F.col("tr")))).alias("x"))
    r = F.coalesce(F.covar_samp("v", "x") / F.nullif(F.stddev_samp("v") * F.stddev_samp("x"), F.lit(0.0)), F.lit(0.0))
    return long.join(drawn, "tr").groupBy("perm", "ch").agg(F.abs(r).alias("r")).groupBy("perm").agg(F.max("r").alias("stat"))


def poisson_bootstrap(rows: DataFrame, key: str, value: str, times: int) -> DataFrame:
    """(draw, mean): each row enters each draw with a Poisson(1) count, so no draw needs the size of the table and sums are taken map-side."""
    u = uniform(F.col("draw"), F.col(key))
    steps = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119]
    count = sum(F.when(u >= s, 1).otherwise(0) for s in steps)
    return repeated(rows.select(key, value), times, "draw").withColumn("n", count).groupBy("draw").agg((F.sum(F.col("n") * F.col(value)) / F.sum("n")).alias("mean"))


def interval(draws: DataFrame, alpha: float = 0.05) -> DataFrame:
    return draws.agg(F.avg("mean").alias("mean"), F.percentile("mean", F.lit(alpha / 2)).alias("low"), F.percentile("mean", F.lit(1 - alpha / 2)).alias("high"), F.avg((F.col("mean") <= 0).cast("double")).alias("p"))


def perm_max_t(spark: SparkSession, d: str) -> DataFrame:
    stats = permutation_max(daily_channels(table(spark, d, "events")), 200)
    return stats.agg(F.max(F.when(F.col("perm") == 0, F.col("stat"))).alias("observed"), F.percentile(F.when(F.col("perm") > 0, F.col("stat")), F.lit(0.95)).alias("fwer95"), F.count(F.when(F.col("perm") > 0, 1)).alias("perms"))


def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    return interval(poisson_bootstrap(table(spark, d, "events"), "event_id", "value", 500))


def noise_ceiling(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of image distances from random halves of the features, over 10 splits."""
    f = trial_features(table(spark, d, "embeddings"))
    mean = cut(repeats_mean(f))
    out = None
    for split in range(10):
        side = uniform(F.lit(split), F.col("k")) < 0.5
        rho = rdm_agreement(rdm(mean.filter(side)), rdm(mean.filter(~side))).select(F.lit(split).alias("split"), "rho")
        out = rho if out is None else out.unionByName(rho)
    return out.agg(F.avg("rho").alias("lower"), F.max("rho").alias("upper"), F.count("*").alias("splits"))


QUERIES = {f.__name__: f for f in (perm_max_t, bootstrap_ci, noise_ceiling)}
ORACLES: dict[str, str] = {}
