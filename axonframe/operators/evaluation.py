"""Retrieval, discriminability and representational similarity.

Retrieval compares trials with image templates (the mean pattern of each image), so its work is trials
times images. Measures over all pairs of trials come from moments where they can; only the rank
statistic makes the pairs, in tiles that keep their counts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from axonframe.operators.trials import repeats_mean
from axonframe.plans.session import cut
from axonframe.sources.series import TRIALS, trial_features
from axonframe.sources.tables import table


def similarity(features: DataFrame, templates: DataFrame) -> DataFrame:
    """(trial, image, candidate, cos, dist): cosine and Euclidean distance of every trial to every template, by feature."""
    c = templates.select(F.col("image").alias("candidate"), "k", F.col("x").alias("y"))
    both = features.join(c, "k").groupBy("trial", "image", "candidate").agg(
        F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") ** 2).alias("xx"), F.sum(F.col("y") ** 2).alias("yy"), F.sum((F.col("x") - F.col("y")) ** 2).alias("d2")
    )
    return both.select("trial", "image", "candidate", (F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))).alias("cos"), F.sqrt("d2").alias("dist"))


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def packed(features: DataFrame, key: str) -> DataFrame:
    """(key, v): long features back in one array, in order of k."""
    return features.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda p: p["x"]).alias("v"))


def similarity_packed(trials: DataFrame, templates: DataFrame, most_bytes: int = 8_000_000) -> DataFrame:
    """As ``similarity``, of trials (trial, image, v) in arrays: small templates, measured, are broadcast and nothing is shuffled; others meet by feature."""
    t = cut(packed(templates, "image").select(F.col("image").alias("candidate"), F.col("v").alias("w")))
    if t.agg(F.coalesce(F.sum(8 * F.size("w") + 50), F.lit(0))).first()[0] > most_bytes:
        return similarity(trials.select("trial", "image", F.posexplode("v").alias("k", "x")).withColumn("k", F.col("k").cast("long")), templates)
    both = trials.withColumn("one", F.lit(1)).join(F.broadcast(t.withColumn("one", F.lit(1))), "one")
    d = F.zip_with("v", "w", lambda a, b: a - b)
    return both.select("trial", "image", "candidate", (dot(F.col("v"), F.col("w")) / F.sqrt(dot(F.col("v"), F.col("v")) * dot(F.col("w"), F.col("w")))).alias("cos"), F.sqrt(dot(d, d)).alias("dist"))


def unit_patterns(features: DataFrame, centre: bool = False) -> DataFrame:
    """Patterns of length one, by trial; with ``centre`` their mean is taken out first, so products are Pearson's r."""
    own = W.partitionBy("trial")
    rows = features.withColumn("x", F.col("x") - F.avg("x").over(own)) if centre else features
    return rows.withColumn("x", F.col("x") / F.nullif(F.sqrt(F.sum(F.col("x") ** 2).over(own)), F.lit(0.0))).filter("x IS NOT NULL")


def pair_moments(units: DataFrame, group: list[str]) -> DataFrame:
    """(group, pairs, s, q): number, sum and sum of squares of the products of all trial pairs i < j, without making them.

    With u of length one the sum of all products is |sum u|^2, and of their squares the squared norm of
    the sum of u u'; each trial's product with itself, 1, is taken off. Linear in trials.
    """
    first = units.groupBy(*group, "k").agg(F.sum("x").alias("m"), F.count("*").alias("n"))
    sums = first.groupBy(*group).agg(F.max("n").alias("n"), F.sum(F.col("m") ** 2).alias("mm"))
    v = units.groupBy(*group, "trial").agg(F.collect_list(F.struct("k", "x")).alias("v"))
    cells = v.select(*group, F.explode("v").alias("a"), "v").select(*group, "a", F.explode("v").alias("b")).filter("a.k <= b.k")
    outer = cells.groupBy(*group, F.col("a.k").alias("k"), F.col("b.k").alias("l")).agg(F.sum(F.col("a.x") * F.col("b.x")).alias("m"))
    squares = outer.groupBy(*group).agg(F.sum(F.when(F.col("k") == F.col("l"), 1.0).otherwise(2.0) * F.col("m") ** 2).alias("qq"))
    both = sums.join(squares, group) if group else sums.withColumn("one", F.lit(1)).join(squares.withColumn("one", F.lit(1)), "one")
    n = F.col("n")
    return both.select(*group, (n * (n - 1) / 2).alias("pairs"), ((F.col("mm") - n) / 2).alias("s"), ((F.col("qq") - n) / 2).alias("q"))


def pair_distances(trials: DataFrame, blocks: int) -> DataFrame:
    """(dist, s, d): how many pairs i < j of one image and of two have each cosine distance, of (trial, image, v) in unit arrays of one length.

    Every pair meets once, in the tile of its two blocks, as a product of two small matrices; distances
    that agree to twelve places are one.
    """

    def run(tile: pa.Table) -> pa.Table:
        v, own, trial, image = (tile.column(c).combine_chunks() for c in ("v", "own", "trial", "image"))
        x, own, trial, image = v.flatten().to_numpy().reshape(len(v), -1), own.to_numpy(), trial.to_numpy(), image.to_numpy(zero_copy_only=False)
        pairs = trial[:, None] < trial[None]
        if own.min() != own.max():
            pairs &= own[:, None] != own[None]
        else:
            pairs &= tile.column("i")[0].as_py() == tile.column("j")[0].as_py()
        dist, place = np.unique(np.round(1 - (x @ x.T)[pairs], 12), return_inverse=True)
        same = (image[:, None] == image[None])[pairs]
        return pa.table({"dist": dist + 0.0, "s": np.bincount(place, same, len(dist)).astype(np.int64), "d": np.bincount(place, ~same, len(dist)).astype(np.int64)})

    own = F.pmod(F.xxhash64("trial"), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    rows = trials.withColumn("own", own).withColumn("other", every).select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "trial", "image", "v")
    return rows.groupBy("i", "j").applyInArrow(run, "dist double, s long, d long")


#: A distance is a number of 1e-12; 2 ** SPAN of them hold all. A pass counts 2 ** BINS bins, in 2 ** PARTS parts.
SPAN, BINS, PARTS, CHUNK = 41, 21, 6, 1024
#: Trials whose pairs may be rows, by distance; beyond that they are counted in bins.
FEW = 6_000


def pair_counts(trials: DataFrame, blocks: int, start: int, bits: int) -> list[tuple]:
    """(part, s, d, cross, tie) by parts of the distances [start, start + 2 ** bits): how many pairs i < j of one image (s) and of two (d)
    they hold, how many (same, diff) pairs of these lie in rising bins, and how many in one bin.

    ``trials``: (trial, image, v), unit arrays of one length. Every pair meets once, in the tile of its two blocks, and only counts leave a tile.
    """
    shift = max(0, bits - BINS)
    size = 1 << (bits - shift)
    width = max(1, min(CHUNK, size >> PARTS))

    def run(tile: pa.Table) -> pa.Table:
        v, own, trial, image = (tile.column(c).combine_chunks() for c in ("v", "own", "trial", "image"))
        x, own, trial, image = v.flatten().to_numpy().reshape(len(v), -1), own.to_numpy(), trial.to_numpy(), image.to_numpy()
        i, j = tile.column("i")[0].as_py(), tile.column("j")[0].as_py()
        a, b = np.flatnonzero(own == i), np.flatnonzero(own == j)
        counts = np.zeros(2 * size, np.int64)
        step = max(1, (1 << 22) // max(len(b), 1))
        for k in range(0, len(a), step):
            rows = a[k : k + step]
            key = np.rint((1 - x[rows] @ x[b].T) * 1e12).astype(np.int64)
            np.clip(key, 0, (1 << SPAN) - 1, out=key)
            key -= start
            fine = (key >= 0) & (key < 1 << bits) & (trial[rows, None] < trial[None, b] if i == j else trial[rows, None] != trial[None, b])
            at = (key >> shift) * 2 + (image[rows, None] == image[None, b])
            counts += np.bincount(at[fine], minlength=2 * size)
        whole = counts.reshape(-1, width, 2)
        full = np.flatnonzero(whole.any((1, 2)))
        lists = lambda m: pa.array(list(m), pa.list_(pa.int64()))
        return pa.table({"chunk": pa.array(full.astype(np.int32)), "s": lists(whole[full, :, 1]), "d": lists(whole[full, :, 0])})

    def summed(rows: pa.Table) -> pa.Table:
        s, d = (sum(c.to_numpy().reshape(-1, width).sum(0) for c in (part.flatten() for part in rows.column(k).chunks)).astype(float) for k in ("s", "d"))
        return pa.table({"chunk": rows.column("chunk")[:1], "s": [s.sum()], "d": [d.sum()], "cross": [d @ (np.cumsum(s) - s)], "tie": [d @ s if shift else 0.0]})

    own = F.pmod(F.xxhash64("trial"), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    rows = trials.withColumn("own", own).withColumn("other", every).select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "trial", "image", "v")
    tiles = rows.groupBy("i", "j").applyInArrow(run, "chunk int, s array<long>, d array<long>")
    chunks = tiles.groupBy("chunk").applyInArrow(summed, "chunk int, s double, d double, cross double, tie double")
    part = F.floor(F.col("chunk") * width / (max(size >> PARTS, 1))).cast("int")
    before = F.coalesce(F.sum("s").over(W.partitionBy("part").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    placed = chunks.withColumn("part", part).withColumn("cross", F.col("cross") + F.col("d") * before)
    return sorted(tuple(r) for r in placed.groupBy("part").agg(*(F.sum(c).alias(c) for c in ("s", "d", "cross", "tie"))).collect())


def joined_counts(parts: list[tuple]) -> tuple[float, float, float, float]:
    """(s, d, cross, tie) of parts (s, d, cross, tie) that follow each other."""
    s = d = cross = tie = 0.0
    for ps, pd, pc, pt in parts:
        s, d, cross, tie = s + ps, d + pd, cross + pc + pd * s, tie + pt
    return s, d, cross, tie


def exact_auc(trials: DataFrame, blocks: int, digits: int) -> tuple[float | None, int, int]:
    """(auc, n_same, n_diff): the share of (same, diff) pairs of trial pairs with a strictly greater diff distance, right to ``digits``.

    Distances that agree to twelve places are equal. Bins give a lower and an upper bound; as long as these round to different
    numbers, the part that leaves most open is counted in finer bins, at last one by one. So no pair is stored, and the work
    of a pass is all pairs.
    """
    parts = {k << (SPAN - PARTS): (SPAN - PARTS, r) for k, *r in pair_counts(trials, blocks, 0, SPAN)}
    while True:
        s, d, cross, tie = joined_counts([r for _, (_, r) in sorted(parts.items())])
        if not s * d:
            return None, int(s), int(d)
        low, high = cross / (s * d), (cross + tie) / (s * d)
        if tie == 0 or math.floor(low * 10**digits + 0.5) == math.floor(high * 10**digits + 0.5):
            return low, int(s), int(d)
        start = max(parts, key=lambda k: parts[k][1][3])
        bits = parts.pop(start)[0]
        finer = max(0, bits - PARTS)
        parts |= {start + (k << finer): (finer, r) for k, *r in pair_counts(trials, blocks, start, bits)}


def ranked(sim: DataFrame) -> DataFrame:
    """Adds the 1-based rank of each candidate of a trial; ties go to the smaller candidate."""
    return sim.withColumn("rank", F.row_number().over(W.partitionBy("trial").orderBy(F.desc("cos"), "candidate")).cast("long"))


def strict_auc(scores: DataFrame, per_unit: int = 4096) -> DataFrame:
    """Share of (same, diff) pairs with a strictly greater diff distance; exact, and no pairs are made.

    ``scores``: (dist, s, d), counts of same and diff ones. Equal distances are counted together, and counts
    of same ones are summed up along the distances, in blocks of a fixed width.
    """
    part = scores.groupBy("dist").agg(F.sum("s").alias("s"), F.sum("d").alias("d")).withColumn("block", F.floor(F.col("dist") * per_unit))
    blocks = part.groupBy("block").agg(F.sum("s").alias("bs"))
    before = blocks.withColumn("base", F.coalesce(F.sum("bs").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inner = W.partitionBy("block").orderBy("dist").rowsBetween(W.unboundedPreceding, -1)
    below = part.withColumn("in", F.coalesce(F.sum("s").over(inner), F.lit(0))).join(before, "block")
    return below.agg((F.sum((F.col("base") + F.col("in")) * F.col("d")) / (F.sum("s").cast("double") * F.sum("d"))).alias("auc"), F.sum("s").alias("n_same"), F.sum("d").alias("n_diff"))


def pattern_pairs(templates: DataFrame) -> DataFrame:
    """(i, j, x, y) of all image pairs i < j, by feature."""
    a, b = templates.select(F.col("image").alias("i"), "k", "x"), templates.select(F.col("image").alias("j"), "k", F.col("x").alias("y"))
    return a.join(b, "k").filter("i < j")


def rdm(templates: DataFrame, metric: str = "correlation") -> DataFrame:
    stat = 1 - F.corr("x", "y") if metric == "correlation" else F.sqrt(F.sum((F.col("x") - F.col("y")) ** 2))
    return pattern_pairs(templates).groupBy("i", "j").agg(stat.alias("d"))


def ordinal_rank(value: Column, *ties: str) -> Column:
    return F.row_number().over(W.orderBy(value, *ties)) - 1


def rdm_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Correlation of the ordinal ranks of two matrices' upper triangles (images squared, small by nature)."""
    both = a.join(b.withColumnRenamed("d", "e"), ["i", "j"])
    ranks = both.select(ordinal_rank(F.col("d"), "i", "j").alias("r"), ordinal_rank(F.col("e"), "i", "j").alias("s"))
    return ranks.agg(F.corr("r", "s").alias("rho"), F.count("*").alias("n"))


def dprime(features: DataFrame) -> DataFrame:
    """(k, image, d): selectivity of each feature for each category; pooled population variances weighted by n - 1, 0 counts as 1."""
    one = features.groupBy("k", "image").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") ** 2).alias("q"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    over = W.partitionBy("k")
    rest = one.withColumns({"on": F.sum("n").over(over) - F.col("n"), "os": F.sum("s").over(over) - F.col("s"), "oq": F.sum("q").over(over) - F.col("q")})
    om = F.col("os") / F.col("on")
    ov = F.greatest(F.col("oq") / F.col("on") - om * om, F.lit(0.0))
    sd = F.sqrt(((F.col("n") - 1) * F.col("v") + (F.col("on") - 1) * ov) / (F.col("n") + F.col("on") - 2))
    return rest.filter("on > 0").select("k", "image", ((F.col("m") - om) / F.when(sd == 0, 1.0).otherwise(sd)).alias("d"))


def wasserstein_sorted(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean absolute difference of the sorted values of two equally long edge lists (col ``v``)."""
    number = lambda df, c: df.select(F.row_number().over(W.orderBy("v")).alias("i"), F.col("v").alias(c))
    return number(a, "x").join(number(b, "y"), "i").agg(F.avg(F.abs(F.col("x") - F.col("y"))).alias("w1"))


def _f(spark: SparkSession, d: str) -> DataFrame:
    return trial_features(table(spark, d, "embeddings"))


def _sim(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    trials = e.select(F.col("vec_id").alias("trial"), F.col("label").alias("image"), F.col("embedding").cast("array<double>").alias("v"))
    return similarity_packed(trials, repeats_mean(trial_features(e)))


def retrieval_topk(spark: SparkSession, d: str) -> DataFrame:
    hit = ranked(_sim(spark, d)).filter("candidate = image")
    return hit.groupBy("image").agg(F.count("*").alias("n"), *(F.sum(F.when(F.col("rank") <= k, 1).otherwise(0)).alias(f"top{k}") for k in (1, 5)))


def brain_retrieval(spark: SparkSession, d: str) -> DataFrame:
    best = _sim(spark, d).groupBy("candidate").agg(F.max_by(F.struct("trial", "image"), F.struct("cos", -F.col("trial"))).alias("b"))
    return best.select("candidate", "b.trial", (F.col("b.image") == F.col("candidate")).alias("hit"))


def pair_auc(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of trials: those of one image against those of two. Work grows with the square of the trials; of many, tiles keep counts, not pairs."""
    v = F.col("embedding").cast("array<double>")
    norm = F.sqrt(dot(v, v))
    rows = cut(table(spark, d, "embeddings").filter((norm > 0) & F.col("label").isNotNull()).select(F.col("vec_id").alias("trial"), F.col("label").alias("image"), F.transform(v, lambda x: x / norm).alias("v")))
    n = rows.count()
    if n <= FEW:
        return strict_auc(pair_distances(rows, max(1, round(n / 1000)))).select(F.round("auc", 5).alias("auc"), "n_same", "n_diff")
    auc, same, diff = exact_auc(rows, max(8, -(-n // 8192)), 5)
    return spark.range(1).select(F.round(F.lit(auc).cast("double"), 5).alias("auc"), F.lit(same).cast("long").alias("n_same"), F.lit(diff).cast("long").alias("n_diff"))


def cohens_d(spark: SparkSession, d: str) -> DataFrame:
    """Of the cosine distances of trial pairs of two images and of one image, from moments."""
    u = cut(unit_patterns(_f(spark, d)))
    whole = pair_moments(u, []).select(*(F.col(c).alias(f"all_{c}") for c in ("pairs", "s", "q")), F.lit(1).alias("one"))
    same = pair_moments(u, ["image"]).agg(*(F.sum(c).alias(c) for c in ("pairs", "s", "q"))).withColumn("one", F.lit(1))
    both = whole.join(same, "one").select(*(F.col(c).alias(f"same_{c}") for c in ("pairs", "s", "q")), *((F.col(f"all_{c}") - F.col(c)).alias(f"diff_{c}") for c in ("pairs", "s", "q")))
    mean = lambda k: F.col(f"{k}_s") / F.col(f"{k}_pairs")
    var = lambda k: F.col(f"{k}_q") / F.col(f"{k}_pairs") - mean(k) ** 2
    return both.select(F.round((mean("same") - mean("diff")) / (F.sqrt((var("diff") + var("same")) / 2) + 1e-8), 5).alias("d"))


def beta_reliability(spark: SparkSession, d: str) -> DataFrame:
    """Mean correlation of all pairs of an image's repeats, after z by feature; from sums of standardised patterns."""
    over = W.partitionBy("k")
    z = _f(spark, d).withColumn("x", (F.col("x") - F.avg("x").over(over)) / (F.stddev_pop("x").over(over) + 1e-6))
    sums = unit_patterns(z, centre=True).groupBy("image", "k").agg(F.sum("x").alias("m"), F.count("*").alias("n"))
    r = sums.groupBy("image").agg(F.max("n").alias("n"), F.sum(F.col("m") ** 2).alias("mm")).filter("n >= 2")
    return r.select("image", F.round((F.col("mm") - F.col("n")) / (F.col("n") * (F.col("n") - 1)), 6).alias("reliability"), "n")


def template_auc(spark: SparkSession, d: str) -> DataFrame:
    """The cheaper variant: trials against image templates, own trial included."""
    same = (F.col("image") == F.col("candidate")).cast("long")
    s = _sim(spark, d).select((1 - F.col("cos")).alias("dist"), same.alias("s"), (1 - same).alias("d"))
    return strict_auc(s).select(F.round("auc", 4).alias("auc"), "n_same", "n_diff")


def template_d(spark: SparkSession, d: str) -> DataFrame:
    x = 1 - F.col("cos")
    same, diff = F.when(F.col("image") == F.col("candidate"), x), F.when(F.col("image") != F.col("candidate"), x)
    return _sim(spark, d).agg(F.round((F.avg(diff) - F.avg(same)) / F.sqrt((F.var_pop(diff) + F.var_pop(same)) / 2), 6).alias("d"))


def loo_reliability(spark: SparkSession, d: str) -> DataFrame:
    """Mean correlation of each image's repeats with the mean of its other repeats (leave-one-out)."""
    f = _f(spark, d)
    over = W.partitionBy("image", "k")
    rest = f.withColumn("n", F.count("*").over(over)).withColumn("y", (F.sum("x").over(over) - F.col("x")) / (F.col("n") - 1)).filter("n >= 2")
    return rest.groupBy("image", "trial").agg(F.corr("x", "y").alias("r")).groupBy("image").agg(F.round(F.avg("r"), 6).alias("reliability"), F.count("*").alias("n"))


def image_identifiability(spark: SparkSession, d: str) -> DataFrame:
    """Is the nearest of the templates, its own without the trial, the trial's image?"""
    f = _f(spark, d)
    t = f.groupBy("image", "k").agg(F.sum("x").alias("s"), F.count("*").alias("n")).select(F.col("image").alias("candidate"), "k", "s", "n")
    own = (F.col("candidate") == F.col("image")).cast("int")
    y = (F.col("s") - own * F.col("x")) / (F.col("n") - own)
    both = f.join(t, "k").filter((F.col("n") > 1) | (F.col("candidate") != F.col("image"))).withColumn("y", y)
    cos = both.groupBy("trial", "image", "candidate").agg((F.sum(F.col("x") * F.col("y")) / F.sqrt(F.sum(F.col("x") ** 2) * F.sum(F.col("y") ** 2))).alias("cos"))
    best = cos.groupBy("trial", "image").agg(F.max_by("candidate", F.struct("cos", -F.col("candidate"))).alias("best"))
    return best.groupBy("image").agg(F.avg((F.col("best") == F.col("image")).cast("double")).alias("a")).select("image", F.round("a", 6).alias("accuracy"))


def rdm_corr(spark: SparkSession, d: str) -> DataFrame:
    return rdm(repeats_mean(_f(spark, d))).select("i", "j", F.round("d", 6).alias("d"))


def rdm_euclid(spark: SparkSession, d: str) -> DataFrame:
    return rdm(repeats_mean(_f(spark, d)), "euclidean").select("i", "j", F.round("d", 6).alias("d"))


def rdm_spearman(spark: SparkSession, d: str) -> DataFrame:
    f = _f(spark, d)
    odd, even = rdm(repeats_mean(f.filter("trial % 2 = 1"))), rdm(repeats_mean(f.filter("trial % 2 = 0")))
    return rdm_agreement(odd, even).select(F.round("rho", 6).alias("rho"), "n")


def category_dprime(spark: SparkSession, d: str) -> DataFrame:
    return dprime(_f(spark, d)).select("k", "image", F.round("d", 5).alias("d"))


def w1_fc(spark: SparkSession, d: str) -> DataFrame:
    f = _f(spark, d)
    half = lambda r: rdm(repeats_mean(f.filter(f"trial % 2 = {r}"))).select(F.col("d").alias("v"))
    return wasserstein_sorted(half(0), half(1)).select(F.round("w1", 6).alias("w1"))


_T = f"{TRIALS}, t AS (SELECT image AS candidate, k, avg(x) AS y FROM f GROUP BY 1, 2), s AS (SELECT trial, image, candidate, sum(x * y) / sqrt(sum(x * x) * sum(y * y)) AS cos FROM f JOIN t USING (k) GROUP BY 1, 2, 3)"
_P = """v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    p AS (SELECT a.label = b.label AS same, 1 - list_cosine_similarity(a.e, b.e) AS x FROM v a JOIN v b ON a.vec_id < b.vec_id)"""
_HALF = "{h} AS (SELECT image, k, avg(x) AS x FROM f WHERE trial % 2 = {r} GROUP BY 1, 2), d{h} AS (SELECT a.image AS i, b.image AS j, 1 - corr(a.x, b.x) AS d FROM {h} a JOIN {h} b ON a.k = b.k AND a.image < b.image GROUP BY 1, 2)"
_HALVES = f"{TRIALS}, {_HALF.format(h='od', r=1)}, {_HALF.format(h='ev', r=0)}"
_M = f"{TRIALS}, m AS (SELECT image, k, avg(x) AS x FROM f GROUP BY 1, 2)"
QUERIES = {f.__name__: f for f in (retrieval_topk, brain_retrieval, pair_auc, cohens_d, beta_reliability, template_auc, template_d, loo_reliability, image_identifiability, rdm_corr, rdm_euclid, rdm_spearman, category_dprime, w1_fc)}
ORACLES = {
    "retrieval_topk": f"""WITH {_T}, r AS (SELECT *, row_number() OVER (PARTITION BY trial ORDER BY cos DESC, candidate) AS rank FROM s)
        SELECT image, count(*) AS n, CAST(sum(CASE WHEN rank <= 1 THEN 1 ELSE 0 END) AS BIGINT) AS top1, CAST(sum(CASE WHEN rank <= 5 THEN 1 ELSE 0 END) AS BIGINT) AS top5 FROM r WHERE candidate = image GROUP BY 1""",
    "brain_retrieval": f"WITH {_T}, r AS (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY cos DESC, trial) AS rank FROM s) SELECT candidate, trial, image = candidate AS hit FROM r WHERE rank = 1",
    "template_auc": f"""WITH {_T}, p AS (SELECT image = candidate AS same, 1 - cos AS x FROM s), a AS (SELECT x FROM p WHERE same), b AS (SELECT x FROM p WHERE NOT same)
        SELECT round((SELECT count(*) FROM a, b WHERE b.x > a.x) / (CAST((SELECT count(*) FROM a) AS DOUBLE) * (SELECT count(*) FROM b)), 4) AS auc, (SELECT count(*) FROM a) AS n_same, (SELECT count(*) FROM b) AS n_diff""",
    "template_d": f"WITH {_T}, p AS (SELECT image = candidate AS same, 1 - cos AS x FROM s) SELECT round((avg(x) FILTER (NOT same) - avg(x) FILTER (same)) / sqrt((var_pop(x) FILTER (NOT same) + var_pop(x) FILTER (same)) / 2), 6) AS d FROM p",
    "loo_reliability": f"""WITH {TRIALS}, r AS (SELECT trial, image, x, count(*) OVER p AS n, (sum(x) OVER p - x) / (count(*) OVER p - 1) AS y FROM f WINDOW p AS (PARTITION BY image, k)),
        c AS (SELECT image, trial, corr(x, y) AS r FROM r WHERE n >= 2 GROUP BY 1, 2) SELECT image, round(avg(r), 6) AS reliability, count(*) AS n FROM c GROUP BY 1""",
    "pair_auc": f"""WITH {_P}, a AS (SELECT x FROM p WHERE same), b AS (SELECT x FROM p WHERE NOT same)
        SELECT round((SELECT count(*) FROM a, b WHERE b.x > a.x) / (CAST((SELECT count(*) FROM a) AS DOUBLE) * (SELECT count(*) FROM b)), 5) AS auc, (SELECT count(*) FROM a) AS n_same, (SELECT count(*) FROM b) AS n_diff""",
    "cohens_d": f"WITH {_P} SELECT round((avg(x) FILTER (NOT same) - avg(x) FILTER (same)) / (sqrt((var_pop(x) FILTER (NOT same) + var_pop(x) FILTER (same)) / 2) + 1e-8), 5) AS d FROM p",
    "beta_reliability": f"""WITH {TRIALS}, z AS (SELECT trial, image, k, (x - avg(x) OVER w) / (stddev_pop(x) OVER w + 1e-6) AS x FROM f WINDOW w AS (PARTITION BY k)),
        c AS (SELECT a.image, a.trial, b.trial AS other, corr(a.x, b.x) AS r FROM z a JOIN z b ON a.image = b.image AND a.trial < b.trial AND a.k = b.k GROUP BY ALL)
        SELECT image, round(avg(r), 6) AS reliability, (SELECT count(*) FROM embeddings WHERE label = image) AS n FROM c GROUP BY image""",
    "image_identifiability": f"""WITH {TRIALS}, t AS (SELECT image AS candidate, k, sum(x) AS s, count(*) AS n FROM f GROUP BY 1, 2),
        y AS (SELECT trial, image, candidate, x, CASE WHEN image = candidate THEN (s - x) / (n - 1) ELSE s / n END AS y FROM f JOIN t USING (k)),
        c AS (SELECT trial, image, candidate, sum(x * y) / sqrt(sum(x * x) * sum(y * y)) AS cos FROM y GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY trial ORDER BY cos DESC, candidate) AS rank FROM c)
        SELECT image, round(avg(CASE WHEN image = candidate THEN 1.0 ELSE 0 END), 6) AS accuracy FROM r WHERE rank = 1 GROUP BY 1""",
    "rdm_corr": f"WITH {_M} SELECT a.image AS i, b.image AS j, round(1 - corr(a.x, b.x), 6) AS d FROM m a JOIN m b ON a.k = b.k AND a.image < b.image GROUP BY 1, 2",
    "rdm_euclid": f"WITH {_M} SELECT a.image AS i, b.image AS j, round(sqrt(sum((a.x - b.x) ** 2)), 6) AS d FROM m a JOIN m b ON a.k = b.k AND a.image < b.image GROUP BY 1, 2",
    "rdm_spearman": f"WITH {_HALVES}, r AS (SELECT row_number() OVER (ORDER BY o.d, i, j) AS a, row_number() OVER (ORDER BY e.d, i, j) AS b FROM dod o JOIN dev e USING (i, j)) SELECT round(corr(a, b), 6) AS rho, count(*) AS n FROM r",
    "category_dprime": f"""WITH {TRIALS}, c AS (SELECT DISTINCT image AS c FROM f), s AS (SELECT k, c AS image, avg(x) FILTER (image = c) - avg(x) FILTER (image <> c) AS m, sqrt(((count(*) FILTER (image = c) - 1) * var_pop(x) FILTER (image = c)
        + (count(*) FILTER (image <> c) - 1) * var_pop(x) FILTER (image <> c)) / (count(*) - 2)) AS sd FROM f, c GROUP BY 1, 2) SELECT k, image, round(m / CASE WHEN sd = 0 THEN 1 ELSE sd END, 5) AS d FROM s""",
    "w1_fc": f"WITH {_HALVES}, a AS (SELECT d, row_number() OVER (ORDER BY d) AS i FROM dod), b AS (SELECT d, row_number() OVER (ORDER BY d) AS i FROM dev) SELECT round(avg(abs(a.d - b.d)), 6) AS w1 FROM a JOIN b USING (i)",
}
