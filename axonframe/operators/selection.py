"""Masks, transforms, indices and thresholds: projections and small aggregates around trials and grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from axonframe.operators.resampling import uniform
from axonframe.sources.series import DAY, TRIALS, daily_channels, day_number, trial_features, user_series
from axonframe.sources.tables import table


def confident(mean: Column, var: Column, threshold: float) -> Column:
    """|mean| / sqrt(max(var, 1e-30)) > threshold; a threshold of 0 lets none through, an infinite one all."""
    if threshold == 0 or threshold == float("inf"):
        return F.lit(threshold != 0)
    return F.abs(mean) / F.sqrt(F.greatest(var, F.lit(1e-30))) > threshold


def z_then_filter(rows: DataFrame, keep: Column) -> DataFrame:
    """z by feature over the whole session first, the filter after it: the window holds the filter back."""
    over = W.partitionBy("k")
    return rows.withColumn("z", (F.col("x") - F.avg("x").over(over)) / (F.stddev_pop("x").over(over) + 1e-8)).filter(keep)


def variance_inputs(mean: Column, var: Column, threshold: float = 1.0) -> dict[str, Column]:
    """The three input flavours of a decoder: as is, weighted by the noise, gated by it."""
    return {"baseline": mean, "weighted": mean / F.sqrt(var + 1e-6), "gated": F.when(confident(mean, var, threshold), mean).otherwise(0.0)}


def stimulus_mean(rows: DataFrame, key: str, stimulus: Column) -> DataFrame:
    """Mean over stimulus frames, over all frames where a trial has none."""
    return rows.groupBy(key).agg(F.coalesce(F.avg(F.when(stimulus, F.col("v"))), F.avg("v")).alias("beta"))


def nuisance(rows: DataFrame) -> DataFrame:
    """(tissue, tr, v, dv): mean series of each mask, with backward differences (first 0)."""
    mean = rows.groupBy("tissue", "tr").agg(F.avg("v").alias("v"))
    return mean.withColumn("dv", F.coalesce(F.col("v") - F.lag("v").over(W.partitionBy("tissue").orderBy("tr")), F.lit(0.0)))


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, index): distinct keys by first appearance; one row per key is numbered."""
    return rows.groupBy(key).agg(F.min(order).alias("at")).select(key, (F.row_number().over(W.orderBy("at", key)) - 1).cast("long").alias("index"))


def softmax_rank(scores: DataFrame) -> DataFrame:
    """(trial, p, rank) of the true candidate: softmax over the trial's candidates (trial, candidate, truth, s)."""
    over = W.partitionBy("trial")
    e = scores.withColumn("e", F.exp(F.col("s") - F.max("s").over(over)))
    p = e.withColumns({"p": F.col("e") / F.sum("e").over(over), "rank": F.rank().over(over.orderBy(F.desc("s"))).cast("long")})
    return p.filter("truth").select("trial", "p", "rank")


def eroded(voxels: DataFrame) -> DataFrame:
    """Voxels (id, x, y, z) whose six neighbours are all in the mask."""
    steps = F.array(*(F.struct(*(F.lit(c).alias(n) for n, c in zip("xyz", s, strict=True))) for s in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))))
    near = voxels.withColumn("d", F.explode(steps)).select("id", *((F.col(c) + F.col(f"d.{c}")).alias(c) for c in "xyz"))
    return near.join(voxels.drop("id"), ["x", "y", "z"], "left_semi").groupBy("id").count().filter("count = 6").select("id")


def upper_vector(cells: DataFrame, offset: int = 1) -> DataFrame:
    """(pos, v) of the upper triangle of (i, j, n, v), row-major; positions follow from the indices alone."""
    kept = cells.filter(F.col("j") >= F.col("i") + offset)
    m = F.col("n") - offset
    before = F.col("i") * m - F.col("i") * (F.col("i") - 1) / 2
    return kept.select((before + F.col("j") - F.col("i") - offset).cast("long").alias("pos"), "v")


def symmetric(cells: DataFrame, skew: bool = False) -> DataFrame:
    """(X + X') / 2, or (X - X') / 2."""
    other = cells.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("v").alias("w"))
    return cells.join(other, ["i", "j"]).select("i", "j", ((F.col("v") - F.col("w") if skew else F.col("v") + F.col("w")) / 2).alias("v"))


def otsu(values: DataFrame, bins: int = 256) -> DataFrame:
    """The cut of (v > 0) with the largest variance between classes, on a fixed histogram."""
    v = values.filter("v > 0")
    top = v.agg(F.max("v").alias("m"))
    hist = v.withColumn("one", F.lit(1)).join(top.withColumn("one", F.lit(1)), "one").groupBy(F.least(F.floor(F.col("v") / F.col("m") * bins), F.lit(bins - 1)).alias("b"), "m").count()
    low, whole = W.orderBy("b").rowsBetween(W.unboundedPreceding, 0), W.partitionBy()
    c = (F.col("b") + 0.5) * F.col("count")
    s = hist.withColumns({"w0": F.sum("count").over(low), "s0": F.sum(c).over(low), "w": F.sum("count").over(whole), "s": F.sum(c).over(whole)})
    gap = F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / F.nullif(F.col("w") - F.col("w0"), F.lit(0))
    between = F.col("w0") * (F.col("w") - F.col("w0")) * gap * gap
    return s.withColumn("between", F.coalesce(between, F.lit(0.0))).groupBy("m").agg(F.max_by("b", F.struct("between", -F.col("b"))).alias("b")).select(((F.col("b") + 1) * F.col("m") / bins).alias("threshold"))


def tiles(long: DataFrame, width: int, take: int, seed: str) -> DataFrame:
    """(win, start): a seeded choice of ``take`` whole tiles of ``width``."""
    whole = long.groupBy(F.floor((F.col("tr") - 1) / width).alias("win")).agg(F.countDistinct("tr").alias("n")).filter(F.col("n") == width)
    return whole.orderBy(F.md5(F.concat(F.lit(seed), F.col("win").cast("string")))).limit(take).select("win", (F.col("win") * width + 1).alias("start"))


def _posterior(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("user_id").alias("sid")).agg(F.avg("value").alias("m"), (F.coalesce(F.var_samp("value"), F.lit(0.0)) / F.count("*")).alias("v"))


def _voxels(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").filter("p_size > 2").select(k.alias("id"), (k % 10).alias("x"), (F.floor(k / 10) % 10).alias("y"), F.floor(k / 100).alias("z"))


def confidence_mask(spark: SparkSession, d: str) -> DataFrame:
    return _posterior(spark, d).select("sid", confident(F.col("m"), F.col("v"), 12.0).alias("kept"))


def input_flavours(spark: SparkSession, d: str) -> DataFrame:
    return _posterior(spark, d).select("sid", *(F.round(c, 6).alias(n) for n, c in variance_inputs(F.col("m"), F.col("v"), 12.0).items()))


def zscore_then_filter(spark: SparkSession, d: str) -> DataFrame:
    f = trial_features(table(spark, d, "embeddings"))
    return z_then_filter(f, F.col("image") == 3).select("trial", "k", F.round("z", 5).alias("z"))


def prefix_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter(F.col("source").startswith("src1")).select("doc_id", "source", F.substring(F.md5("source"), 1, 8).alias("key"))


def stimulus_betas(spark: SparkSession, d: str) -> DataFrame:
    return stimulus_mean(user_series(table(spark, d, "events")), "sid", F.col("event_type") == "purchase").select("sid", F.round("beta", 6).alias("beta"))


def nuisance_regressors(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select((F.col("user_id") % 2).alias("tissue"), day_number().alias("tr"), F.col("value").alias("v"))
    return nuisance(rows).select("tissue", "tr", F.round("v", 6).alias("v"), F.round("dv", 6).alias("dv"))


def image_index(spark: SparkSession, d: str) -> DataFrame:
    return first_seen(table(spark, d, "events"), "event_type", "event_id")


def truth_rank(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "events").groupBy(F.col("user_id").alias("trial"), F.col("event_type").alias("candidate")).agg(F.avg(F.col("value") / 10).alias("s"))
    return softmax_rank(n.withColumn("truth", F.col("candidate") == "purchase")).select("trial", F.round("p", 6).alias("p"), "rank")


def mask_erosion(spark: SparkSession, d: str) -> DataFrame:
    return eroded(_voxels(spark, d))


def triangle_vector(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("i"), F.col("n_regionkey").alias("r"))
    cells = e.join(e.select(F.col("i").alias("j"), F.col("r").alias("s")).withColumn("one", F.lit(1)), F.lit(1) == F.col("one")).select("i", "j", F.lit(25).alias("n"), (F.col("r") * 10 + F.col("s")).cast("double").alias("v"))
    return upper_vector(symmetric(cells).withColumn("n", F.lit(25)))


def vessel_threshold(spark: SparkSession, d: str) -> DataFrame:
    return otsu(table(spark, d, "events").select(F.col("value").alias("v"))).select(F.round("threshold", 6).alias("threshold"))


def window_tiles(spark: SparkSession, d: str) -> DataFrame:
    return tiles(daily_channels(table(spark, d, "events")), 5, 3, "tiles")


def event_props(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").groupBy(k.alias("k")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("v"))


def shuffle_null(spark: SparkSession, d: str) -> DataFrame:
    """Mean within-image similarity to the template, for the data (perm 0) and 20 shuffles of the labels."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("trial"), F.col("label").alias("image"))
    perms = e.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(20))))
    place = lambda c: F.row_number().over(W.partitionBy("perm").orderBy(c, "trial"))
    drawn = perms.select("perm", "trial", "image", place(F.col("trial")).alias("a"), place(uniform("perm", "trial")).alias("b"))
    moved = drawn.select("perm", F.col("a").alias("pos"), "trial", F.col("image").alias("own")).join(drawn.select("perm", F.col("b").alias("pos"), "image"), ["perm", "pos"])
    label = moved.select("perm", "trial", F.when(F.col("perm") == 0, F.col("own")).otherwise(F.col("image")).alias("image"))
    x = trial_features(table(spark, d, "embeddings")).drop("image").join(label, "trial")
    mean = x.groupBy("perm", "image", "k").agg(F.avg("x").alias("m"))
    r = x.join(mean, ["perm", "image", "k"]).groupBy("perm", "trial").agg(F.corr("x", "m").alias("r"))
    return r.groupBy("perm").agg(F.avg("r").alias("reliability"))


_POST = "u AS (SELECT user_id AS sid, avg(value) AS m, coalesce(var_samp(value), 0) / count(*) AS v FROM events GROUP BY 1)"
QUERIES = {f.__name__: f for f in (confidence_mask, input_flavours, zscore_then_filter, prefix_filter, stimulus_betas, nuisance_regressors, image_index, truth_rank, mask_erosion, triangle_vector, vessel_threshold, window_tiles, event_props, shuffle_null)}
ORACLES = {
    "confidence_mask": f"WITH {_POST} SELECT sid, abs(m) / sqrt(greatest(v, 1e-30)) > 12 AS kept FROM u",
    "input_flavours": f"WITH {_POST} SELECT sid, round(m, 6) AS baseline, round(m / sqrt(v + 1e-6), 6) AS weighted, round(CASE WHEN abs(m) / sqrt(greatest(v, 1e-30)) > 12 THEN m ELSE 0 END, 6) AS gated FROM u",
    "zscore_then_filter": f"WITH {TRIALS}, z AS (SELECT *, (x - avg(x) OVER p) / (stddev_pop(x) OVER p + 1e-8) AS z FROM f WINDOW p AS (PARTITION BY k)) SELECT trial, k, round(z, 5) AS z FROM z WHERE image = 3",
    "prefix_filter": "SELECT doc_id, source, substr(md5(source), 1, 8) AS key FROM documents WHERE starts_with(source, 'src1')",
    "stimulus_betas": "SELECT user_id AS sid, round(coalesce(avg(value) FILTER (event_type = 'purchase'), avg(value)), 6) AS beta FROM events GROUP BY 1",
    "nuisance_regressors": f"""WITH m AS (SELECT user_id % 2 AS tissue, {DAY} AS tr, avg(value) AS v FROM events GROUP BY 1, 2)
        SELECT tissue, tr, round(v, 6) AS v, round(coalesce(v - lag(v) OVER (PARTITION BY tissue ORDER BY tr), 0), 6) AS dv FROM m""",
    "image_index": "SELECT event_type, row_number() OVER (ORDER BY min(event_id)) - 1 AS index FROM events GROUP BY 1",
    "truth_rank": """WITH s AS (SELECT user_id AS trial, event_type AS c, avg(value / 10) AS s FROM events GROUP BY 1, 2), p AS (SELECT *, exp(s - max(s) OVER w) AS e, rank() OVER (PARTITION BY trial ORDER BY s DESC) AS rank FROM s WINDOW w AS (PARTITION BY trial)),
        q AS (SELECT *, e / sum(e) OVER (PARTITION BY trial) AS p FROM p) SELECT trial, round(p, 6) AS p, rank FROM q WHERE c = 'purchase'""",
    "mask_erosion": """WITH v AS (SELECT p_partkey AS id, p_partkey % 10 AS x, p_partkey // 10 % 10 AS y, p_partkey // 100 AS z FROM part WHERE p_size > 2)
        SELECT a.id FROM v a JOIN v b ON abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) = 1 GROUP BY 1 HAVING count(*) = 6""",
    "triangle_vector": """WITH c AS (SELECT a.n_nationkey AS i, b.n_nationkey AS j, a.n_regionkey * 10 + b.n_regionkey AS v, b.n_regionkey * 10 + a.n_regionkey AS w FROM nation a, nation b)
        SELECT row_number() OVER (ORDER BY i, j) - 1 AS pos, CAST(v + w AS DOUBLE) / 2 AS v FROM c WHERE j > i""",
    "vessel_threshold": """WITH m AS (SELECT max(value) AS m FROM events WHERE value > 0), h AS (SELECT least(floor(value / m * 256), 255) AS b, any_value(m) AS m, count(*) AS n FROM events, m WHERE value > 0 GROUP BY 1),
        c AS (SELECT *, sum(n) OVER o AS w0, sum((b + 0.5) * n) OVER o AS s0, sum(n) OVER () AS w, sum((b + 0.5) * n) OVER () AS s FROM h WINDOW o AS (ORDER BY b)),
        g AS (SELECT b, m, coalesce(w0 * (w - w0) * (s0 / w0 - (s - s0) / nullif(w - w0, 0)) ** 2, 0) AS x FROM c) SELECT round((b + 1) * m / 256, 6) AS threshold FROM g ORDER BY x DESC, b LIMIT 1""",
    "window_tiles": f"WITH t AS (SELECT ({DAY} - 1) // 5 AS win FROM events GROUP BY 1 HAVING count(DISTINCT {DAY}) = 5) SELECT win, win * 5 + 1 AS start FROM t ORDER BY md5('tiles' || win) LIMIT 3",
    "event_props": "SELECT CAST(props->>'$.k' AS BIGINT) AS k, count(*) AS n, round(avg(value), 6) AS v FROM events GROUP BY 1",
}
