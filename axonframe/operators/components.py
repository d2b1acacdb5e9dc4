"""Principal components and what follows from covariances, over all features of vectors of any number.

Every task adds up the products of the features of its own rows; Spark sums these by (group, feature,
feature) in long form. So a group with a third of all rows is spread over all tasks, and what meets in
one task afterwards is a matrix of features by features, whose size doesn't depend on the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axonframe.functions import kernels as K
from axonframe.plans.session import cut
from axonframe.sources.tables import table

#: Groups whose sums a task holds at a time.
GROUPS = 256
#: Values of a cell of a shuffle, about: what meets in a task at a time.
CELL = 1 << 20


def products(rows: DataFrame, keys: list[str], column: str = "v") -> DataFrame:
    """(keys, i, j, n, si, sj, sij) of vectors in ``column``: rows, sums and sums of products of features, for i <= j.

    Rows with a null vector or a null or non-finite entry are left out, and so are vectors shorter than their group's longest.
    """
    return _summed(_added(_finite(rows, keys, column), keys), keys)


def _added(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The parts of finite vectors (keys, v), added up over the rows of each task."""
    schema = _parts(rows.select(*keys).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def flush() -> pa.RecordBatch:
            out = [(*key[:-1], key[-1], i, n, float(s[i]), xx[i].tolist()) for key, (n, s, xx) in held.items() for i in range(key[-1])]
            held.clear()
            columns = list(zip(*out, strict=True))
            arrays = [pa.array(list(c), f.type) for c, f in zip(columns, fields, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, schema=pa.schema(fields))

        for b in batches:
            fields = [*(b.schema.field(k) for k in keys), pa.field("p", pa.int32()), pa.field("i", pa.int32()), pa.field("n", pa.int64()), pa.field("s", pa.float64()), pa.field("row", pa.list_(pa.float64()))]
            groups: dict[tuple, list[int]] = {}
            sizes = np.diff(np.asarray(b.column("v").offsets))
            for k, key in enumerate(zip(*(b.column(c).to_pylist() for c in keys), sizes.tolist(), strict=True)):
                groups.setdefault(key, []).append(k)
            for key, at in groups.items():
                x = b.column("v").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), key[-1])
                if key not in held and len(held) >= GROUPS:
                    yield flush()
                now = held.setdefault(key, [0, np.zeros(key[-1]), np.zeros((key[-1], key[-1]))])
                now[0] += len(x)
                now[1] += x.sum(0)
                now[2] += x.T @ x
        if held:
            yield flush()

    return rows.mapInArrow(run, schema)


def _parts(keys: T.StructType) -> T.StructType:
    """(keys, p, i, n, s, row ARRAY): of some rows of a group with p features their number, the sum of feature i and its products with all features."""
    fields = [("p", T.IntegerType()), ("i", T.IntegerType()), ("n", T.LongType()), ("s", T.DoubleType()), ("row", T.ArrayType(T.DoubleType()))]
    return T.StructType([*keys.fields, *(T.StructField(*f) for f in fields)])


def _finite(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, v) of the vectors whose entries are all finite."""
    v = F.col(column).cast("array<double>")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(fine).select(*keys, v.alias("v"))


def _summed(parts: DataFrame, keys: list[str]) -> DataFrame:
    """``products`` from parts of the groups' rows; parts of vectors shorter than their group's longest are left out."""
    sums = parts.select(*keys, "p", "i", "n", "s", F.posexplode("row").alias("j", "x")).filter("i <= j")
    whole = sums.groupBy(*keys, "p", "i", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("si"), F.sum("x").alias("sij"))
    first = whole.filter("i = j").select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("p").alias("__p"), F.col("i").alias("__j"), F.col("si").alias("sj"))
    met = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col("p") == F.col("__p"), F.col("j") == F.col("__j")]
    joined = whole.join(first, met).select(*keys, "p", "i", "j", "n", "si", "sj", "sij")
    most = joined.groupBy(*keys).agg(F.max("p").alias("__most")).select(*(F.col(k).alias(f"__{k}") for k in keys), "__most")
    return joined.join(most, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]).filter("p = __most").select(*keys, "i", "j", "n", "si", "sj", "sij")


def shuffled_products(rows: DataFrame, row_id: str, draws: int, column: str = "v") -> DataFrame:
    """``products`` by draw: of the vectors themselves in draw 0, of vectors with each feature in an order of its own in draws from 1.

    The orders are those of ``resampling.shuffled`` (a hash, then the row's number), but values travel in arrays. Tasks deal the values
    of their rows to stretches of the hash; a stretch's values are ordered feature by feature and, as counts say where they begin, dealt
    to blocks of places; a block adds up the products of its features. Stretches and blocks hold about ``CELL`` values whatever the rows.
    """
    from axonframe.operators.resampling import BITS, hashed

    fine = _finite(rows, [F.col(row_id).cast("long").alias("trial")], column)
    p, n = fine.groupBy(F.size("v").alias("p")).count().orderBy(F.desc("p")).first() or (1, 0)
    size = max(CELL // p, 1)
    stretches = max(-(-n // size), 1)
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, n * p * draws // (4 * CELL))
    stored = cut(fine.filter(F.size("v") == p).repartition(tasks))
    drawn = stored.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))

    features = F.sequence(F.lit(0), F.lit(p - 1))
    stretch = F.shiftright(hashed(F.col("draw"), F.col("k"), F.col("trial")) * stretches, BITS)
    counts = drawn.select("draw", "trial", F.explode(features).alias("k")).groupBy("draw", stretch.alias("stretch"), "k").agg(F.count("*").alias("n"))
    before = W.partitionBy("draw", "k").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select("draw", "stretch", "k", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    low = 63 - BITS
    coded = drawn.select("draw", "trial", "v", F.transform(features, lambda k: F.xxhash64("draw", k, "trial")).alias("code"))
    array = lambda of, start, values: pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(start)], pa.int32()), pa.array(values, of))
    flat = lambda column: column.combine_chunks().flatten().to_numpy() if isinstance(column, pa.ChunkedArray) else column.flatten().to_numpy()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            held.clear()
            draw, x = t["draw"].to_numpy(), flat(t["v"]).reshape(-1, p)
            # As ``hashed``, the last bits of the hash; below them those of the row's number.
            key = (flat(t["code"]).reshape(-1, p) & (1 << BITS) - 1) << low | (t["trial"].to_numpy() & (1 << low) - 1)[:, None]
            for one in np.unique(draw):
                at = np.flatnonzero(draw == one)
                values, keys = x[at].T.ravel(), key[at].T.ravel()
                stretch = (keys >> low) * stretches >> BITS
                order = np.argsort(stretch.astype(np.min_scalar_type(stretches)), kind="stable")
                cells = np.bincount(stretch * p + np.repeat(np.arange(p), len(at)), minlength=stretches * p).reshape(stretches, p)
                some = np.flatnonzero(cells.sum(1))
                total = cells[some].sum(1)
                columns = [pa.array(np.full(len(some), one), pa.int32()), pa.array(some, pa.int64()), array(pa.int64(), np.full(len(some), p), cells[some].ravel()), array(pa.int64(), total, keys[order]), array(pa.float64(), total, values[order])]
                yield pa.RecordBatch.from_arrays(columns, ["draw", "stretch", "n", "key", "x"])

        for b in batches:
            held.append(b)
            if sum(h.num_rows for h in held) * p >= 4 * CELL:
                yield from flush()
        if held:
            yield from flush()

    def ordered(dealt: pa.Table, bases: pa.Table) -> pa.Table:
        cells, keys, x = flat(dealt["n"]).reshape(-1, p), flat(dealt["key"]), flat(dealt["x"])
        feature = np.repeat(np.tile(np.arange(p, dtype=np.min_scalar_type(p)), len(cells)), cells.ravel())
        order = np.argsort(feature, kind="stable")
        keys, x, ends = keys[order], x[order], np.cumsum(cells.sum(0))
        base = dict(zip(bases["k"].to_pylist(), bases["base"].to_pylist(), strict=True))
        out, values = [], []
        for k in np.flatnonzero(cells.sum(0)).tolist():
            own, y = keys[ends[k - 1] if k else 0 : ends[k]], x[ends[k - 1] if k else 0 : ends[k]]
            order = np.argsort(own)
            if (np.diff(own[order]) == 0).any():
                order = np.lexsort((y, own))
            first, last = base[k], base[k] + len(y)
            for block in range(first // size, (last - 1) // size + 1):
                a, e = max(first, block * size), min(last, (block + 1) * size)
                out.append((block, k, a - block * size))
                values.append(y[order[a - first : e - first]])
        block, k, start = zip(*out, strict=True)
        columns = [pa.array([dealt["draw"][0].as_py()] * len(out), pa.int32()), pa.array(block, pa.int64()), pa.array(k, pa.int32()), pa.array(start, pa.int64()), array(pa.float64(), [len(y) for y in values], np.concatenate(values))]
        return pa.Table.from_arrays(columns, ["draw", "block", "k", "start", "x"])

    def added(t: pa.Table) -> pa.Table:
        x = np.zeros((p, min(size, n - t["block"][0].as_py() * size)))
        for k, start, y in zip(t["k"].to_pylist(), t["start"].to_pylist(), t["x"], strict=True):
            x[k, start : start + len(y)] = y.values
        columns = [pa.array([t["draw"][0].as_py()] * p, pa.int32()), pa.array([p] * p, pa.int32()), pa.array(range(p), pa.int32()), pa.array([x.shape[1]] * p, pa.int64()), pa.array(x.sum(1)), array(pa.float64(), [p] * p, (x @ x.T).ravel())]
        return pa.Table.from_arrays(columns, ["draw", "p", "i", "n", "s", "row"])

    cells = coded.mapInArrow(deal, "draw int, stretch long, n array<long>, key array<long>, x array<double>")
    placed = cells.groupBy("draw", "stretch").cogroup(bases.groupBy("draw", "stretch")).applyInArrow(ordered, "draw int, block long, k int, start long, x array<double>")
    parts = placed.groupBy("draw", "block").applyInArrow(added, _parts(placed.select("draw").schema))
    return _summed(cut(_added(stored.select(F.lit(0).alias("draw"), "v"), ["draw"]).unionByName(parts)), ["draw"])


def covariance(sums: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, i, j, n, c): sample covariances for i <= j, of groups with two rows at least."""
    return sums.filter("n > 1").select(*keys, "i", "j", "n", ((F.col("sij") - F.col("si") * F.col("sj") / F.col("n")) / (F.col("n") - 1)).alias("c"))


def by_matrix(cells: DataFrame, keys: list[str], value: str, kernel: Callable[[np.ndarray, int], list[tuple]], schema: str) -> DataFrame:
    """``kernel`` of each group's symmetric matrix and number of rows; only features by features meet in a task."""
    names = [c.strip().split()[0] for c in schema.split(",")]
    head = cells.select(*keys).schema

    def run(g: pd.DataFrame) -> pd.DataFrame:
        p = int(g["j"].max()) + 1
        m = np.zeros((p, p))
        m[g["i"], g["j"]] = m[g["j"], g["i"]] = g[value]
        rows = kernel(m, int(g["n"].iloc[0]))
        out = pd.DataFrame(rows, columns=names)
        for at, k in enumerate(keys):
            out.insert(at, k, [g[k].iloc[0]] * len(out))
        return out

    whole = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in head), schema])
    return cells.groupBy(*keys).applyInPandas(run, whole)


def leading(m: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest eigenvalues, 0 at least, and their vectors as columns, the largest entry positive."""
    w, v = np.linalg.eigh(m)
    return np.maximum(w[::-1][:k], 0), K.fix_signs(v[:, ::-1][:, :k])


def components(cov: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(keys, component, value, share, vector ARRAY) of the k largest components."""

    def of(m: np.ndarray, n: int) -> list[tuple]:
        w, v = leading(m, k)
        whole = max(np.trace(m), 1e-300)
        return [(c, float(w[c]), float(w[c] / whole), v[:, c].tolist()) for c in range(len(w))]

    return by_matrix(cov, keys, "c", of, "component long, value double, share double, vector array<double>")


def causal_shares(rows: DataFrame, run: str, k: int, column: str = "v") -> DataFrame:
    """(run, past, share): how much of each run's variance lies in the k components of all runs before it.

    The sums of the runs before are a running sum over the runs for each pair of features.
    """
    sums = cut(products(rows, [run], column))
    before = W.partitionBy("i", "j").orderBy(run).rowsBetween(W.unboundedPreceding, -1)
    past = sums.select(run, "i", "j", *(F.sum(c).over(before).alias(c) for c in ("n", "si", "sj", "sij")))
    then = covariance(past, [run]).select(run, "i", "j", F.col("n").alias("past"), F.col("c").alias("old"))
    now = covariance(sums, [run]).select(run, "i", "j", "n", "c").join(then, [run, "i", "j"])
    kind = rows.select(run).schema[0].dataType.simpleString()

    def of(g: pd.DataFrame) -> pd.DataFrame:
        p = int(g["j"].max()) + 1
        m, old = np.zeros((p, p)), np.zeros((p, p))
        for to, name in ((m, "c"), (old, "old")):
            to[g["i"], g["j"]] = to[g["j"], g["i"]] = g[name]
        v = leading(old, k)[1]
        return pd.DataFrame({run: [g[run].iloc[0]], "past": [int(g["past"].iloc[0])], "share": [float(np.trace(v.T @ m @ v) / max(np.trace(m), 1e-300))]})

    return now.groupBy(run).applyInPandas(of, f"`{run}` {kind}, past long, share double")


# -- from covariances of groups ----------------------------------------------------------------------


def canonical(m: np.ndarray, a: int) -> np.ndarray:
    """Canonical correlations of the first a features and the others; directions without variance count as 0."""

    def half(c: np.ndarray) -> np.ndarray:
        w, v = np.linalg.eigh(c)
        ok = w > 1e-9 * max(w.max(), 1e-300)
        return v[:, ok] / np.sqrt(w[ok])

    return np.clip(np.linalg.svd(half(m[:a, :a]).T @ m[:a, a:] @ half(m[a:, a:]), compute_uv=False), 0, 1)


def information(m: np.ndarray, a: int, b: int, reg: float = 1e-4) -> float:
    """Gaussian mutual information of a and b features given all others."""
    q = np.linalg.inv(m + reg * np.eye(len(m)))
    of = lambda x: np.linalg.slogdet(x)[1]
    return 0.5 * float(of(q[:a, :a]) + of(q[a : a + b, a : a + b]) - of(q[: a + b, : a + b]))


def block_information(m: np.ndarray, k: int, reg: float = 1e-4) -> list[tuple]:
    """(i, j, information) of all pairs of blocks of k features given all others, from the blocks of the inverse; features after the last whole block only count as given."""
    q, one = np.linalg.inv(m + reg * np.eye(len(m))), np.eye(k)
    at = [slice(a, a + k) for a in range(0, len(m) - k + 1, k)]
    inner = [np.linalg.inv(q[a, a] + reg * one) for a in at]
    return [(i, j, -0.5 * float(np.linalg.slogdet(one - inner[j] @ q[at[j], at[i]] @ inner[i] @ q[at[i], at[j]])[1])) for i in range(len(at)) for j in range(i + 1, len(at))]


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("label").alias("image"), "vec_id", F.col("embedding").alias("v"))


def _cov(spark: SparkSession, d: str) -> DataFrame:
    return covariance(products(_vectors(spark, d), ["image"]), ["image"])


def _spd(spark: SparkSession, d: str) -> DataFrame:
    return _cov(spark, d).withColumn("c", F.col("c") + F.when(F.col("i") == F.col("j"), 1e-6).otherwise(0.0))


def clamped(cells: DataFrame, keys: list[str], least: float = 1e-6) -> DataFrame:
    """(keys, i, j, v): matrices (keys, i, j, n, c) with eigenvalues of ``least`` at least, whole."""
    return by_matrix(cells, keys, "c", lambda m, n: _cells(K.spectral(m, lambda w: np.maximum(w, least))), "i long, j long, v double")


def prewhitened(rows: DataFrame, run: str, column: str = "v", least: float = 1e-6) -> DataFrame:
    """``rows`` with ``column`` multiplied by the inverse root of the log-Euclidean mean of the runs' covariances.

    Logs are taken run by run and averaged cell by cell; the mean, one matrix of features by features, goes to every row.
    """
    cov = covariance(products(rows, [run], column), [run])
    logs = by_matrix(cov, [run], "c", lambda m, n: _cells(K.logm(m)), "i long, j long, l double")
    mean = logs.groupBy("i", "j").agg(F.avg("l").alias("l"), F.count("*").alias("n")).withColumn("one", F.lit(1))
    root = by_matrix(mean, ["one"], "l", lambda m, n: _cells(K.spectral(K.expm(m), lambda w: 1 / np.sqrt(np.maximum(w, least)))), "i long, j long, v double")
    lines = root.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda x: x["v"]).alias("line"))
    whole = lines.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]).alias("__root"))
    times = lambda line, v: F.aggregate(F.zip_with(line, v, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    v = F.col(column).cast("array<double>")
    return rows.join(F.broadcast(whole)).withColumn(column, F.transform("__root", lambda line: times(line, v))).drop("__root")


def consensus(rows: DataFrame, row_id: str, draws: int, share: float, column: str = "v") -> DataFrame:
    """(draw, dimension): components above the broken stick in subsamples without replacement of ``share`` of the rows, ten at least."""
    from axonframe.operators.resampling import shuffled

    ids = cut(rows.select(F.col(row_id).alias("trial")))
    k = max(int(ids.count() * share), 10)
    drawn = shuffled(ids.select("trial", F.lit(0).alias("k"), F.col("trial").alias("x")), draws).filter((F.col("draw") > 0) & (F.col("pos") <= k)).select("draw", F.col("x").alias(row_id))

    def of(m: np.ndarray, n: int) -> list[tuple]:
        w = leading(m, len(m))[0]
        return [(int(K.leading_above(w / max(w.sum(), 1e-300), K.broken_stick(len(w)))),)]

    return by_matrix(covariance(products(drawn.join(rows, row_id), ["draw"], column), ["draw"]), ["draw"], "c", of, "dimension long")


def label_covariance(spark: SparkSession, d: str) -> DataFrame:
    return _cov(spark, d).select("image", "i", "j", "n", F.round("c", 6).alias("c"))


def pca(spark: SparkSession, d: str) -> DataFrame:
    return components(_cov(spark, d), ["image"], 3).select("image", "component", "share", F.array_max(F.transform("vector", lambda x: F.abs(x))).alias("top"))


def eigenspectrum(spark: SparkSession, d: str) -> DataFrame:
    """All components' shares beside those of a broken stick."""

    def of(m: np.ndarray, n: int) -> list[tuple]:
        w = leading(m, len(m))[0]
        return [(c, float(s), float(b)) for c, (s, b) in enumerate(zip(w / max(w.sum(), 1e-300), K.broken_stick(len(w)), strict=True))]

    return by_matrix(_cov(spark, d), ["image"], "c", of, "component long, share double, stick double")


def broken_stick(spark: SparkSession, d: str) -> DataFrame:
    above = eigenspectrum(spark, d).groupBy("image").agg(F.min(F.when(F.col("share") <= F.col("stick"), F.col("component"))).alias("first"), F.count("*").alias("p"))
    return above.select("image", F.greatest(F.coalesce("first", "p"), F.lit(1)).cast("long").alias("dimension"))


def cca(spark: SparkSession, d: str) -> DataFrame:
    """Canonical correlations of the first four features and the next four, and of the halves where there are rows enough."""
    first = _cov(spark, d).filter("j < 8")
    return by_matrix(first, ["image"], "c", lambda m, n: [(c, float(r)) for c, r in enumerate(canonical(m, len(m) // 2))] if n > 8 else [], "component long, r double")


def mv_cmi(spark: SparkSession, d: str) -> DataFrame:
    """Information of the first two features and the next two given all the others."""
    return by_matrix(_cov(spark, d), ["image"], "c", lambda m, n: [(information(m, 2, 2),)], "information double")


def spd_tangent(spark: SparkSession, d: str) -> DataFrame:
    """Norm of each image's covariance in the tangent space at the identity."""
    return by_matrix(_spd(spark, d), ["image"], "c", lambda m, n: [(float(np.linalg.norm(K.logm(m))),)], "norm double")


def _cells(m: np.ndarray) -> list[tuple]:
    return [(i, j, float(m[i, j])) for i in range(len(m)) for j in range(len(m))]


def spd_mean_logeuc(spark: SparkSession, d: str) -> DataFrame:
    """exp of the mean log: logs in tasks, the mean of each cell by Spark, the exp of one matrix at the end."""
    logs = by_matrix(_spd(spark, d), ["image"], "c", lambda m, n: _cells(K.logm(m)), "i long, j long, v double")
    mean = logs.groupBy("i", "j").agg(F.avg("v").alias("v"), F.count("*").alias("n")).withColumn("one", F.lit(1))
    return by_matrix(mean, ["one"], "v", lambda m, n: _cells(K.expm(m)), "i long, j long, v double").drop("one")


def geometric_mean(spd: DataFrame, keys: list[str], steps: int = 10) -> DataFrame:
    """(i, j, v): the mean moves along the average of the groups' tangents; a step is one pass over the groups, whose tangents Spark averages by cell."""
    mean = cut(spd.groupBy("i", "j").agg(F.avg("c").alias("v"), F.count("*").alias("n")))
    for _ in range(steps):
        both = spd.join(mean.select("i", "j", "v"), ["i", "j"])

        def tangent(g: pd.DataFrame) -> pd.DataFrame:
            p = int(g["j"].max()) + 1
            m, at = np.zeros((p, p)), np.zeros((p, p))
            for to, name in ((m, "c"), (at, "v")):
                to[g["i"], g["j"]] = to[g["j"], g["i"]] = g[name]
            return pd.DataFrame([x for x in _cells(K.tangent(m, at)) if x[0] <= x[1]], columns=["i", "j", "t"])

        tangents = both.groupBy(*keys).applyInPandas(tangent, "i int, j int, t double").groupBy("i", "j").agg(F.avg("t").alias("t"))

        def moved(g: pd.DataFrame) -> pd.DataFrame:
            p = int(g["j"].max()) + 1
            m, at = np.zeros((p, p)), np.zeros((p, p))
            for to, name in ((m, "t"), (at, "v")):
                to[g["i"], g["j"]] = to[g["j"], g["i"]] = g[name]
            return pd.DataFrame([x for x in _cells(K.from_tangent(m, at)) if x[0] <= x[1]], columns=["i", "j", "v"])

        mean = cut(tangents.join(mean.select("i", "j", "v"), ["i", "j"]).withColumn("one", F.lit(1)).groupBy("one").applyInPandas(moved, "i int, j int, v double"))
    return mean


def spd_mean_geom(spark: SparkSession, d: str) -> DataFrame:
    half = geometric_mean(cut(_spd(spark, d)), ["image"])
    return half.union(half.filter("i < j").select(F.col("j").alias("i"), F.col("i").alias("j"), "v")).select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "v")


def nordic(spark: SparkSession, d: str) -> DataFrame:
    """Singular values of each image's trials by features above the noise level: from the eigenvalues of the products, the noise from the differences of consecutive trials.

    (kept, norm of what is kept); the noise is 1.4826 times the median absolute difference of a feature, by the root of two.
    """
    rows = _vectors(spark, d)
    flat = rows.select("image", "vec_id", F.posexplode(F.col("v").cast("array<double>")).alias("k", "x"))
    step = flat.withColumn("d", F.col("x") - F.lag("x").over(W.partitionBy("image", "k").orderBy("vec_id"))).filter("d IS NOT NULL")
    middle = step.groupBy("image").agg(F.percentile("d", F.lit(0.5)).alias("m"))
    noise = step.join(middle, "image").groupBy("image").agg((F.percentile(F.abs(F.col("d") - F.col("m")), F.lit(0.5)) / 0.6745 / F.sqrt(F.lit(2.0))).alias("sigma"))
    sums = products(rows, ["image"]).join(noise, "image")

    def of(g: pd.DataFrame) -> pd.DataFrame:
        p, n = int(g["j"].max()) + 1, int(g["n"].iloc[0])
        m = np.zeros((p, p))
        m[g["i"], g["j"]] = m[g["j"], g["i"]] = g["sij"]
        s2 = np.maximum(np.linalg.eigvalsh(m)[::-1][: min(n, p)], 0)
        keep = np.sqrt(s2) > K.noise_threshold(p, n, float(g["sigma"].iloc[0]))
        return pd.DataFrame({"image": [g["image"].iloc[0]], "kept": [int(keep.sum())], "norm": [float(np.sqrt(s2[keep].sum()))]})

    return sums.groupBy("image").applyInPandas(of, "image int, kept long, norm double")


def parallel_analysis(spark: SparkSession, d: str, draws: int = 20) -> DataFrame:
    """Shares of all features' components against shuffles of each feature over the trials (95th percentile of ``draws``)."""

    def of(m: np.ndarray, n: int) -> list[tuple]:
        w = leading(m, len(m))[0]
        return [(c, float(s)) for c, s in enumerate(w / max(w.sum(), 1e-300))]

    shares = by_matrix(covariance(shuffled_products(_vectors(spark, d), "vec_id", draws), ["draw"]), ["draw"], "c", of, "component long, share double")
    return shares.groupBy("component").agg(F.max(F.when(F.col("draw") == 0, F.col("share"))).alias("share"), F.percentile(F.when(F.col("draw") > 0, F.col("share")), F.lit(0.95)).alias("null95"))


def _blocks(spark: SparkSession, d: str, k: int) -> DataFrame:
    whole = _vectors(spark, d).withColumn("one", F.lit(1))
    rows = by_matrix(covariance(products(whole, ["one"]), ["one"]), ["one"], "c", lambda m, n: block_information(m, k), "i long, j long, cmi double")
    return rows.select("i", "j", (F.round("cmi", 5) + 0.0).alias("cmi"))


def block_cmi2(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, d, 2)


def block_cmi3(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, d, 3)


def spd_clamp(spark: SparkSession, d: str) -> DataFrame:
    """Covariances of labels, whose trials may be fewer than their features, with eigenvalues of 0.001 at least."""
    return clamped(_cov(spark, d), ["image"], 1e-3)


def prewhitened_runs(spark: SparkSession, d: str) -> DataFrame:
    """Five runs, whitened by their mean covariance: what is left between the features, which the identity is near."""
    rows = _vectors(spark, d).withColumn("run", F.col("vec_id") % 5)
    white = covariance(products(prewhitened(rows, "run").withColumn("one", F.lit(1)), ["one"]), ["one"])
    return white.select("i", "j", F.round("c", 6).alias("c"))


def consensus_dimensionality(spark: SparkSession, d: str) -> DataFrame:
    dims = consensus(_vectors(spark, d).filter("v IS NOT NULL"), "vec_id", 20, 0.8)
    return dims.agg(F.percentile("dimension", F.lit(0.5)).alias("median"), (F.percentile("dimension", F.lit(0.75)) - F.percentile("dimension", F.lit(0.25))).alias("iqr"), F.count("*").alias("draws"))


def causal_components(spark: SparkSession, d: str) -> DataFrame:
    """Runs are stretches of 100 trials."""
    return causal_shares(_vectors(spark, d).withColumn("run", F.floor(F.col("vec_id") / 100)), "run", 8)


QUERIES = {f.__name__: f for f in (label_covariance, pca, eigenspectrum, broken_stick, cca, mv_cmi, spd_tangent, spd_mean_logeuc, spd_mean_geom, nordic, parallel_analysis, causal_components, block_cmi2, block_cmi3, spd_clamp, prewhitened_runs, consensus_dimensionality)}


def _blocks_sql(k: int) -> str:
    """Blocks of the inverse by sweeps of lists; determinants of what remains by expansion."""
    e = lambda m, i, j: f"{m}[{i + 1}][{j + 1}]"

    def det(m: str) -> str:
        if k == 2:
            return f"({e(m, 0, 0)} * {e(m, 1, 1)} - {e(m, 0, 1)} * {e(m, 1, 0)})"
        return " + ".join(f"{e(m, 0, c)} * ({e(m, 1, (c + 1) % 3)} * {e(m, 2, (c + 2) % 3)} - {e(m, 1, (c + 2) % 3)} * {e(m, 2, (c + 1) % 3)})" for c in range(3))

    def inverse(m: str) -> str:
        if k == 2:
            return f"[[{e(m, 1, 1)} / d, -{e(m, 0, 1)} / d], [-{e(m, 1, 0)} / d, {e(m, 0, 0)} / d]]"
        co = lambda i, j: f"({e(m, (j + 1) % 3, (i + 1) % 3)} * {e(m, (j + 2) % 3, (i + 2) % 3)} - {e(m, (j + 1) % 3, (i + 2) % 3)} * {e(m, (j + 2) % 3, (i + 1) % 3)}) / d"
        return "[" + ", ".join("[" + ", ".join(co(i, j) for j in range(3)) + "]" for i in range(3)) + "]"

    def times(a: str, b: str) -> str:
        return "[" + ", ".join("[" + ", ".join(" + ".join(f"{e(a, i, x)} * {e(b, x, j)}" for x in range(k)) for j in range(k)) + "]" for i in range(k)) + "]"

    cut_out = lambda r, c: f"[[q[{r} * {k} + i][{c} * {k} + j] FOR j IN range(1, {k + 1})] FOR i IN range(1, {k + 1})]"
    return f"""WITH RECURSIVE f AS (SELECT vec_id, unnest(generate_series(0, len(embedding) - 1)) AS k, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
        c AS (SELECT a.k AS i, b.k AS j, covar_samp(a.x, b.x) + CASE WHEN a.k = b.k THEN 1e-4 ELSE 0 END AS v FROM f a JOIN f b USING (vec_id) GROUP BY 1, 2),
        l AS (SELECT i, list(v ORDER BY j) AS line FROM c GROUP BY i), m AS (SELECT list(line ORDER BY i) AS m, 0 AS p, count(*) AS n FROM l UNION ALL
            SELECT list_transform(m, lambda line_, i: list_transform(line_, lambda v, j: CASE WHEN i - 1 = p AND j - 1 = p THEN -1 / m[p + 1][p + 1] WHEN i - 1 = p OR j - 1 = p THEN v / m[p + 1][p + 1] ELSE v - m[i][p + 1] * m[p + 1][j] / m[p + 1][p + 1] END)), p + 1, n FROM m WHERE p < n),
        q AS (SELECT list_transform(m, lambda line_: list_transform(line_, lambda v: -v)) AS q, n // {k} AS blocks FROM m WHERE p = n),
        b AS (SELECT x.b, list_transform({cut_out('x.b', 'x.b')}, lambda line_, i: list_transform(line_, lambda v, j: CASE WHEN i = j THEN v + 1e-4 ELSE v END)) AS s FROM q, (SELECT unnest(range(0, (SELECT blocks FROM q))) AS b) x),
        d AS (SELECT b, s, {det('s')} AS d FROM b), v AS (SELECT b, {inverse('s')} AS s FROM d),
        o AS (SELECT a.b AS i, b.b AS j, a.s AS si, b.s AS sj, {cut_out('b.b', 'a.b')} AS ji, {cut_out('a.b', 'b.b')} AS ij FROM v a JOIN v b ON a.b < b.b, q),
        t AS (SELECT i, j, {times('sj', 'ji')} AS l, {times('si', 'ij')} AS r FROM o), u AS (SELECT i, j, {times('l', 'r')} AS z FROM t), w AS (SELECT i, j, list_transform(z, lambda line_, a: list_transform(line_, lambda v, b: CASE WHEN a = b THEN 1 - v ELSE -v END)) AS z FROM u)
        SELECT i, j, round(-0.5 * ln(abs({det('z')})), 5) + 0.0 AS cmi FROM w"""


ORACLES = {
    "block_cmi2": _blocks_sql(2),
    "block_cmi3": _blocks_sql(3),
    "label_covariance": """WITH f AS (SELECT vec_id, label AS image, unnest(generate_series(0, len(embedding) - 1)) AS k, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
        SELECT a.image, CAST(a.k AS INT) AS i, CAST(b.k AS INT) AS j, count(*) AS n, round(covar_samp(a.x, b.x), 6) + 0.0 AS c FROM f a JOIN f b ON a.vec_id = b.vec_id AND a.k <= b.k GROUP BY 1, 2, 3""",
}
