"""Tables that decide and report: noise pools, leaders, weighted parcels, condition designs, intervals, simplex gradients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from axonframe.operators.moments import guarded_corr, pairs
from axonframe.plans.ranks import ranked, running_before
from axonframe.sources.series import DAILY, SERIES, TRIALS, daily_channels, trial_features, user_series
from axonframe.sources.tables import table


def noise_pool(r2: DataFrame, threshold: float = 0.0, most: float = 0.5) -> DataFrame:
    """(unit, mean, pool) of (unit, run, r2): units whose fit is low on average and in every run, at most a share of all; without any the lowest."""
    per = r2.groupBy("unit").agg(F.avg("r2").alias("mean"), F.max("r2").alias("max"))
    eligible = (F.col("mean") < threshold) & (F.col("max") < max(threshold, 0.0) + 0.05)
    rows = per.withColumn("e", eligible)
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("e").cast("int")), F.lit(0)).alias("es")).withColumn("one", F.lit(1))
    low = rows.withColumn("one", F.lit(1)).join(F.broadcast(total), "one").filter("es = 0 OR e")
    kept = ranked(low, ["mean", "unit"], "k").filter(F.col("k") <= F.floor(F.col("n") * most)).select("unit", F.lit(True).alias("pool"))
    return per.join(kept, "unit", "left").select("unit", "mean", F.coalesce("pool", F.lit(False)).alias("pool"))


def leaders(rows: DataFrame, group: str, item: str, score: str, k: int) -> DataFrame:
    """The ``k`` items with the largest score of each group, with their place; ties go to the smaller item."""
    place = F.row_number().over(W.partitionBy(group).orderBy(F.desc(score), item))
    return rows.withColumn("place", place.cast("long")).filter(F.col("place") <= k)


def softmax_parcels(values: DataFrame, logits: DataFrame, mean: bool = True) -> DataFrame:
    """(parcel, t, v) of (unit, t, v) over (unit, parcel, logit): softmax weights over the units of a parcel, or sums of their exponentials."""
    own = W.partitionBy("parcel")
    e = F.exp(F.col("logit") - F.max("logit").over(own)) if mean else F.exp("logit")
    w = logits.withColumn("w", e).withColumn("w", F.col("w") / F.sum("w").over(own) if mean else F.col("w"))
    return values.join(w, "unit").groupBy("parcel", "t").agg(F.sum(F.col("w") * F.col("v")).alias("v"))


def condition_design(events: DataFrame, tr: float) -> DataFrame:
    """(run, tr, col): one column for each distinct image of the session, by name; repeated cells count once."""
    names = events.select("image").distinct().withColumn("col", (F.row_number().over(W.orderBy("image")) - 1).cast("long"))
    first = F.min("onset").over(W.partitionBy("run"))
    rows = events.withColumn("tr", F.bround((F.col("onset") - first) / tr, 0).cast("long"))
    return rows.join(names, "image").select("run", "tr", "col").distinct()


def concatenated(runs: DataFrame) -> DataFrame:
    """(run, t, at, v): runs one after the other along time; lengths are summed up along ranges of runs."""
    sizes = runs.groupBy("run").agg(F.max("t").alias("n"))
    offset = running_before(sizes, ["run"], "n", "offset").select("run", "offset")
    return runs.join(offset, "run").select("run", "t", (F.col("offset") + F.col("t")).alias("at"), "v")


def cosine_drift(rows: DataFrame, t: str, tr: float, high_pass: float) -> DataFrame:
    """Each row with (k, drift): the first floor(2 n tr f) + 1 discrete cosines, two at least, over the n = max(t) samples, t from 1; cosine 0 is constant."""
    n = rows.agg(F.max(t).alias("__n")).withColumn("__k", F.greatest(F.lit(2), F.floor(2 * F.col("__n") * tr * high_pass) + 1))
    spread = rows.join(F.broadcast(n)).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__k") - 1)))
    return spread.withColumn("drift", F.cos(F.pi() * F.col("k") * (2 * F.col(t) - 1) / (2 * F.col("__n")))).drop("__n", "__k")


def hashed_uniform(seed: str, *parts: Column) -> Column:
    """A number in [0, 1) from a hash of ``parts``, the same on every run and in SQL."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *(p.cast("string") for p in parts))), 1, 8), 16, 10).cast("double") / 4294967296.0


def paired_interval(diffs: DataFrame, resamples: int = 200) -> DataFrame:
    """mean, quantiles 0.025 and 0.975 of the resampled means and the share of these at or below 0, of (i, diff) with i from 0 without gaps.

    Each resample draws as many positions as there are pairs, by a hash.
    """
    n = diffs.agg(F.count("*").alias("n"), F.avg("diff").alias("mean"))
    draws = diffs.select("i").join(F.broadcast(n)).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    drawn = draws.withColumn("at", F.floor(hashed_uniform("pair", F.col("b"), F.col("i")) * F.col("n")).cast("long")).select("b", "at", "n", "mean")
    boot = drawn.join(diffs.select(F.col("i").alias("at"), "diff"), "at").groupBy("b", "n", "mean").agg(F.avg("diff").alias("m"))
    return boot.groupBy("n", "mean").agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"), F.avg(F.when(F.col("m") <= 0, 1.0).otherwise(0.0)).alias("p"))


def natural_gradient(rows: DataFrame, least: float = 1e-8) -> DataFrame:
    """(key, k, metric, natural, next) of (key, k, p, g): the Fisher metric 1 / p, the gradient it turns p g into, and the simplex after a step of 0.01 in logs."""
    p = F.greatest("p", F.lit(least))
    up = F.log(p) - 0.01 * p * F.col("g")
    own = W.partitionBy("key")
    e = F.exp(up - F.max(up).over(own))
    rows = rows.select("key", "k", (1 / p).alias("metric"), (p * F.col("g")).alias("natural"), e.alias("e"))
    return rows.withColumn("next", F.col("e") / F.sum("e").over(own)).drop("e")


def overlapping_windows(length: Column, size: int, count: int, seed: str) -> Column:
    """Sorted starts 0 .. length - size, drawn with replacement by a hash."""
    return F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.floor(hashed_uniform(seed, i) * (length - size + 1)).cast("long")))


def windowed_modularity(long: DataFrame, group: Column, size: int) -> DataFrame:
    """(win, q): modularity of the positive correlations of every window of ``size`` times, for fixed groups of channels."""
    windows = long.withColumn("win", F.explode(F.sequence(F.col("tr") - size + 1, F.col("tr"))))
    full = windows.groupBy("win").agg(F.countDistinct("tr").alias("n")).filter(F.col("n") == size).select("win")
    kept = windows.join(full, "win", "left_semi").select("win", "ch", "tr", "v", group.alias("g"))
    a, b = (kept.select("win", "tr", *(F.col(c).alias(f"{c}_{s}") for c in ("ch", "v", "g"))) for s in "ij")
    r = a.join(b, ["win", "tr"]).filter("ch_i <> ch_j").groupBy("win", "ch_i", "ch_j", "g_i", "g_j").agg(F.greatest(guarded_corr("v_i", "v_j"), F.lit(0.0)).alias("w"))
    k = r.groupBy("win", "ch_i", "g_i").agg(F.sum("w").alias("k"))
    inside = r.groupBy("win").agg(F.sum("w").alias("m"), F.sum(F.when(F.col("g_i") == F.col("g_j"), F.col("w")).otherwise(0.0)).alias("in"))
    null = k.groupBy("win", "g_i").agg((F.sum("k") ** 2 - F.sum(F.col("k") ** 2)).alias("e")).groupBy("win").agg(F.sum("e").alias("e"))
    m = F.when(F.col("m") == 0, 1.0).otherwise(F.col("m"))
    return inside.join(null, "win").select("win", ((F.col("in") - F.col("e") / m) / m).alias("q"))


def soft_modularity(edges: DataFrame, soft: DataFrame, gamma: float = 1.0) -> DataFrame:
    """q of soft groups (i, g, c), the diagonal left out: sums over groups, no null matrix is formed."""
    k = edges.groupBy("i").agg(F.sum("w").alias("k"))
    c = soft.join(k, "i", "left").withColumn("k", F.coalesce("k", F.lit(0.0)))
    inside = edges.filter("i <> j").join(soft, "i").join(soft.select(F.col("i").alias("j"), "g", F.col("c").alias("d")), ["j", "g"]).agg(F.coalesce(F.sum(F.col("w") * F.col("c") * F.col("d")), F.lit(0.0)).alias("in"))
    null = c.groupBy("g").agg((F.sum(F.col("c") * F.col("k")) ** 2 - F.sum((F.col("c") * F.col("k")) ** 2)).alias("e")).agg(F.sum("e").alias("e"))
    m = edges.agg(F.when(F.coalesce(F.sum("w"), F.lit(0.0)) == 0, 1.0).otherwise(F.sum("w")).alias("m"))
    one = lambda df: df.withColumn("one", F.lit(1))
    return one(inside).join(one(null), "one").join(one(m), "one").select(((F.col("in") - gamma * F.col("e") / F.col("m")) / F.col("m")).alias("q"))


def select_noise_pool(spark: SparkSession, d: str) -> DataFrame:
    s = user_series(table(spark, d, "events"))
    r2 = s.groupBy(F.col("sid").alias("unit"), (F.col("t") % 2).alias("run")).agg(F.regr_r2("v", "t").alias("r2")).filter("r2 IS NOT NULL")
    return noise_pool(r2, 0.02).select("unit", F.round("mean", 6).alias("mean"), "pool")


def top3_features(spark: SparkSession, d: str) -> DataFrame:
    means = trial_features(table(spark, d, "embeddings")).groupBy("image", "k").agg(F.avg("x").alias("x"))
    return leaders(means, "image", "k", "x", 3).select("image", "place", "k", F.round("x", 6).alias("x"))


def leaderboard(spark: SparkSession, d: str) -> DataFrame:
    """Images by the share of variance that they don't leave within, best first."""
    f = trial_features(table(spark, d, "embeddings"))
    score = f.groupBy("image", "k").agg(F.avg("x").alias("m"), F.var_pop("x").alias("v")).groupBy("image").agg((F.sum(F.col("m") ** 2) / F.sum(F.col("m") ** 2 + F.col("v"))).alias("score"))
    return ranked(score, [F.desc("score"), "image"], "place").select("place", "image", F.round("score", 6).alias("score"))


def atlas_softmax(spark: SparkSession, d: str) -> DataFrame:
    v = user_series(table(spark, d, "events")).select(F.col("sid").alias("unit"), "t", "v")
    w = v.select("unit").distinct().select("unit", (F.col("unit") % 6).alias("parcel"), (F.col("unit") % 11 / 5.0).alias("logit"))
    return softmax_parcels(v, w).select("parcel", "t", F.round("v", 6).alias("v"))


def cortical_projection(spark: SparkSession, d: str) -> DataFrame:
    """Block start: a unit weighs most in the parcel of its own block."""
    v = user_series(table(spark, d, "events")).select(F.col("sid").alias("unit"), "t", "v")
    units = v.select("unit").distinct().withColumn("parcel", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))
    return softmax_parcels(v, units.withColumn("logit", F.when(F.col("unit") % 4 == F.col("parcel"), 2.0).otherwise(0.0))).select("parcel", "t", F.round("v", 6).alias("v"))


def condition_columns(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_type").alias("image"), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("onset"))
    return condition_design(e, 3600.0)


def concat_runs(spark: SparkSession, d: str) -> DataFrame:
    s = user_series(table(spark, d, "events"))
    return concatenated(s.select(F.col("sid").alias("run"), "t", "v")).select("run", "t", "at", F.round("v", 6).alias("v"))


def drift_basis(spark: SparkSession, d: str) -> DataFrame:
    """What the cosines explain of each channel's days: products with the basis."""
    rows = cosine_drift(daily_channels(table(spark, d, "events")), "tr", 1.5, 0.05)
    return rows.groupBy("ch", "k").agg(F.round(F.sum(F.col("v") * F.col("drift")), 5).alias("c"))


def paired_diff_ci(spark: SparkSession, d: str) -> DataFrame:
    """Odd against even trials of each image, mean of all features."""
    f = trial_features(table(spark, d, "embeddings")).withColumn("x", F.col("x") * F.col("x"))
    odd = lambda r: F.avg(F.when(F.col("trial") % 2 == r, F.col("x")))
    diffs = f.groupBy("image").agg((odd(1) - odd(0)).alias("diff")).filter("diff IS NOT NULL")
    numbered = diffs.select((F.row_number().over(W.orderBy("image")) - 1).cast("long").alias("i"), "diff")
    return paired_interval(numbered).select("n", *(F.round(c, 6).alias(c) for c in ("mean", "low", "high", "p")))


def fisher_rao(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("key"), F.col("event_type").alias("k")).agg(F.count("*").alias("n"), F.avg("value").alias("g"))
    p = e.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy("key")))
    return natural_gradient(p).select("key", "k", *(F.round(c, 6).alias(c) for c in ("metric", "natural", "next")))


def window_samples(spark: SparkSession, d: str) -> DataFrame:
    """Mean of each channel in 6 windows of 7 days, drawn with replacement."""
    days = daily_channels(table(spark, d, "events"))
    starts = F.posexplode(overlapping_windows(F.col("n"), 7, 6, "over")).alias("win", "start")
    rows = days.agg(F.max("tr").alias("n")).select(starts).withColumn("tr", F.explode(F.sequence(F.col("start") + 1, F.col("start") + 7)))
    return rows.join(days, "tr").groupBy(F.col("win").cast("long").alias("win"), "start", "ch").agg(F.round(F.avg("v"), 6).alias("v"))


def window_modularity(spark: SparkSession, d: str) -> DataFrame:
    return windowed_modularity(daily_channels(table(spark, d, "events")), F.length("ch") % 2, 10).select("win", F.round("q", 6).alias("q"))


def modularity_soft(spark: SparkSession, d: str) -> DataFrame:
    r = pairs(daily_channels(table(spark, d, "events"))).groupBy("ch_i", "ch_j").agg(F.greatest(guarded_corr("x", "y"), F.lit(0.0)).alias("w"))
    edges = r.filter("ch_i <> ch_j").select(F.col("ch_i").alias("i"), F.col("ch_j").alias("j"), "w")
    n = F.length("i") % 4 / 4.0 + 0.1
    soft = edges.select("i").distinct().select("i", F.explode(F.array(F.struct(F.lit(0).alias("g"), n.alias("c")), F.struct(F.lit(1).alias("g"), (1 - n).alias("c")))).alias("x")).select("i", "x.*")
    return soft_modularity(edges, soft).select(F.round("q", 6).alias("q"))


def input_concat(spark: SparkSession, d: str) -> DataFrame:
    """Patterns and the logs of their squares as variances, each z-scored by feature over the session, side by side."""
    f = trial_features(table(spark, d, "embeddings"))
    n = f.agg((F.max("k") + 1).alias("width"))
    both = f.unionByName(f.join(F.broadcast(n)).select("trial", "image", (F.col("k") + F.col("width")).alias("k"), F.log(F.col("x") ** 2 + 1e-6).alias("x")))
    own = W.partitionBy("k")
    return both.select("trial", "k", F.round((F.col("x") - F.avg("x").over(own)) / (F.stddev_pop("x").over(own) + 1e-6), 5).alias("z"))


_U = "CAST('0x' || substr(md5({0}), 1, 8) AS BIGINT) / 4294967296.0"
QUERIES = {f.__name__: f for f in (
    select_noise_pool, top3_features, leaderboard, atlas_softmax, cortical_projection, condition_columns, concat_runs, drift_basis, paired_diff_ci, fisher_rao, window_samples, window_modularity, modularity_soft, input_concat,
)}
ORACLES = {
    "select_noise_pool": f"""WITH {SERIES}, r AS (SELECT sid AS unit, t % 2 AS run, regr_r2(v, t) AS r2 FROM s GROUP BY 1, 2), p AS (SELECT unit, avg(r2) AS mean, max(r2) AS most FROM r WHERE r2 IS NOT NULL GROUP BY 1),
        e AS (SELECT *, mean < 0.02 AND most < 0.07 AS ok FROM p), l AS (SELECT *, row_number() OVER (PARTITION BY ok OR NOT (SELECT bool_or(ok) FROM e) ORDER BY mean, unit) AS k FROM e)
        SELECT unit, round(mean, 6) AS mean, (ok OR NOT (SELECT bool_or(ok) FROM e)) AND k <= floor((SELECT count(*) FROM e) * 0.5) AS pool FROM l""",
    "top3_features": f"WITH {TRIALS}, m AS (SELECT image, k, avg(x) AS x FROM f GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY x DESC, k) AS place FROM m) SELECT image, place, k, round(x, 6) AS x FROM r WHERE place <= 3",
    "leaderboard": f"""WITH {TRIALS}, m AS (SELECT image, k, avg(x) AS m, var_pop(x) AS v FROM f GROUP BY 1, 2), s AS (SELECT image, sum(m * m) / sum(m * m + v) AS score FROM m GROUP BY 1)
        SELECT row_number() OVER (ORDER BY score DESC, image) AS place, image, round(score, 6) AS score FROM s""",
    "atlas_softmax": f"""WITH {SERIES}, u AS (SELECT DISTINCT sid FROM s), w AS (SELECT sid, sid % 6 AS parcel, exp(sid % 11 / 5.0) / sum(exp(sid % 11 / 5.0)) OVER (PARTITION BY sid % 6) AS w FROM u)
        SELECT parcel, t, round(sum(w * v), 6) AS v FROM s JOIN w USING (sid) GROUP BY 1, 2""",
    "cortical_projection": f"""WITH {SERIES}, u AS (SELECT DISTINCT sid FROM s), e AS (SELECT sid, parcel, CASE WHEN sid % 4 = parcel THEN exp(2.0) ELSE 1.0 END AS e FROM u, range(4) r(parcel)), w AS (SELECT sid, parcel, e / sum(e) OVER (PARTITION BY parcel) AS w FROM e)
        SELECT parcel, t, round(sum(w * v), 6) AS v FROM s JOIN w USING (sid) GROUP BY 1, 2""",
    "condition_columns": """WITH n AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS col FROM (SELECT DISTINCT event_type FROM events)), o AS (SELECT user_id AS run, event_type, floor(epoch(ts)) AS o FROM events)
        SELECT DISTINCT run, CAST(round_even((o - min(o) OVER (PARTITION BY run)) / 3600.0, 0) AS BIGINT) AS tr, col FROM o JOIN n USING (event_type)""",
    "concat_runs": f"WITH {SERIES}, n AS (SELECT sid, max(t) AS n FROM s GROUP BY 1), o AS (SELECT sid, sum(n) OVER (ORDER BY sid) - n AS o FROM n) SELECT sid AS run, t, CAST(o + t AS BIGINT) AS at, round(v, 6) AS v FROM s JOIN o USING (sid)",
    "drift_basis": f"""WITH {DAILY}, n AS (SELECT max(tr) AS n FROM long), k AS (SELECT n, unnest(range(0, CAST(greatest(2, floor(2 * n * 1.5 * 0.05) + 1) AS BIGINT))) AS k FROM n)
        SELECT ch, k, round(sum(v * cos(pi() * k * (2 * tr - 1) / (2 * n))), 5) + 0.0 AS c FROM long, k GROUP BY 1, 2""",
    "paired_diff_ci": f"""WITH {TRIALS}, a AS (SELECT image, avg(x * x) FILTER (trial % 2 = 1) - avg(x * x) FILTER (trial % 2 = 0) AS diff FROM f GROUP BY 1), i AS (SELECT row_number() OVER (ORDER BY image) - 1 AS i, diff FROM a WHERE diff IS NOT NULL),
        b AS (SELECT b, avg(j.diff) AS m FROM i, range(200) r(b), i j WHERE j.i = CAST(floor({_U.format("'pair:' || b || ':' || i.i")} * (SELECT count(*) FROM i)) AS BIGINT) GROUP BY 1)
        SELECT (SELECT count(*) FROM i) AS n, round((SELECT avg(diff) FROM i), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, round(avg(CASE WHEN m <= 0 THEN 1.0 ELSE 0 END), 6) AS p FROM b""",
    "fisher_rao": """WITH e AS (SELECT user_id AS key, event_type AS k, count(*) AS n, avg(value) AS g FROM events GROUP BY 1, 2), p AS (SELECT *, n / sum(n) OVER (PARTITION BY key) AS p FROM e)
        SELECT key, k, round(1 / p, 6) AS metric, round(p * g, 6) AS natural, round(p * exp(-0.01 * p * g) / sum(p * exp(-0.01 * p * g)) OVER (PARTITION BY key), 6) AS next FROM p""",
    "window_samples": f"""WITH {DAILY}, d AS (SELECT CAST(floor({_U.format("'over:' || i")} * ((SELECT max(tr) FROM long) - 6)) AS BIGINT) AS start FROM range(6) r(i)), n AS (SELECT row_number() OVER (ORDER BY start) - 1 AS win, start FROM d)
        SELECT win, start, ch, round(avg(v), 6) AS v FROM n JOIN long ON tr BETWEEN start + 1 AND start + 7 GROUP BY 1, 2, 3""",
    "window_modularity": f"""WITH {DAILY}, w AS (SELECT t - 9 AS win FROM (SELECT DISTINCT tr AS t FROM long) GROUP BY t HAVING (SELECT count(DISTINCT tr) FROM long WHERE tr BETWEEN t - 9 AND t) = 10),
        r AS (SELECT win, a.ch AS i, b.ch AS j, greatest(coalesce(covar_samp(a.v, b.v) / nullif(stddev_samp(a.v) * stddev_samp(b.v), 0), 0), 0) AS w FROM w JOIN long a ON a.tr BETWEEN win AND win + 9 JOIN long b ON a.tr = b.tr AND a.ch <> b.ch GROUP BY 1, 2, 3),
        k AS (SELECT win, i, sum(w) AS k FROM r GROUP BY 1, 2), m AS (SELECT win, sum(k) AS m FROM k GROUP BY 1)
        SELECT r.win, round(sum(CASE WHEN length(r.i) % 2 = length(r.j) % 2 THEN (r.w - a.k * b.k / m) / m ELSE 0 END), 6) AS q FROM r JOIN k a ON a.win = r.win AND a.i = r.i JOIN k b ON b.win = r.win AND b.i = r.j JOIN m ON m.win = r.win GROUP BY 1""",
    "modularity_soft": f"""WITH {DAILY}, r AS (SELECT a.ch AS i, b.ch AS j, greatest(coalesce(covar_samp(a.v, b.v) / nullif(stddev_samp(a.v) * stddev_samp(b.v), 0), 0), 0) AS w FROM long a JOIN long b ON a.tr = b.tr AND a.ch <> b.ch GROUP BY 1, 2),
        k AS (SELECT i, sum(w) AS k, length(i) % 4 / 4.0 + 0.1 AS c FROM r GROUP BY 1), m AS (SELECT sum(k) AS m FROM k)
        SELECT round(sum((r.w - a.k * b.k / m) * (a.c * b.c + (1 - a.c) * (1 - b.c)) / m), 6) AS q FROM r JOIN k a ON a.i = r.i JOIN k b ON b.i = r.j, m""",
    "input_concat": f"""WITH {TRIALS}, b AS (SELECT trial, k, x FROM f UNION ALL SELECT trial, k + (SELECT max(k) + 1 FROM f), ln(x * x + 1e-6) FROM f)
        SELECT trial, k, round((x - avg(x) OVER w) / (stddev_pop(x) OVER w + 1e-6), 5) AS z FROM b WINDOW w AS (PARTITION BY k)""",
}
