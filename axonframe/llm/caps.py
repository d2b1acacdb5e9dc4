"""Embedding near-duplicates by spherical-cap filters.

A filter is a direction and holds all vectors whose inner product with it exceeds a threshold: a cap
of the sphere. Directions are structured: after a random rotation the vector is split in two blocks
with ``b`` random sub-directions each, and every pair of sub-directions is a filter. So a vector is
decoded to all filters that it exceeds from 2 b products: both lists are sorted and pairs are read
while their sum exceeds the threshold. No list is filled up or cut off. Two blocks of a random unit
vector with random unit sub-directions make a random direction, so the threshold is the quantile of
one coordinate on the sphere that leaves ``lists`` filters to a vector on average, at any size.

The code grows with the root of the largest label's rows, so that a filter holds ``bucket`` of them.
A larger code misses a pair at the limit more often, so there are several, with rotations and
sub-directions of their own: a random rotation makes the chance of a miss the same for every pair of
one cosine, and independent codes multiply it. It is measured for one code on random pairs at the
limit, and the number of codes is the least that brings the product to ``miss``. In dimension 64 one
code finds 0.81 of the pairs at cosine 0.93 among 5,000 vectors, 0.67 among 100,000, 0.59 among 1M
and 0.47 among 1G; with a margin for the measurement 6, 9, 12 and 17 codes are taken. Codes for less than
16 dimensions are those of vectors filled up with zeros, which changes no cosine.

Vectors that share a filter and the label meet in tiles of bounded size; there the cosines of the
original vectors are computed in double precision. A pair is counted by the first filter that both
have, so counts need no list of pairs: a tile returns, for each of its vectors, the number of links and
one edge towards its local component. Buckets of any size are split into tiles.

Equal vectors of a label are one class, which is compared once and counts for all its members; so a
group of copies costs one row, not its square. Members get their class's result by class and salt.

Defined results: null, zero and non-finite vectors, null labels and null ids link with nothing. Rows
that repeat a vec_id are one vector, see ``valid_vectors``; each is returned. Labels may be of any
type. Vectors of another dimension than most are compared with those of their own. Pairs at exactly 0.93
link. An empty table gives an empty result. Columns other than vec_id, embedding and label are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axonframe.llm.components import connected_components
from axonframe.llm.vectors import groups, matrix, rotation, valid_vectors
from axonframe.plans.session import cut


@dataclass(frozen=True)
class Settings:
    """``lists``: filters a vector has on average in one code; ``bucket``: vectors of the largest label in a filter on average; ``miss``: chance that a pair at the limit shares no filter in any code; ``codes``: a code that needs more is halved; ``tile``: rows of one side of a tile."""

    cosine: float = 0.93
    lists: int = 6
    bucket: int = 512
    miss: float = 1e-4
    codes: int = 24
    trials: int = 2000
    tile: int = 512
    salts: int = 32
    seed: int = 3


def sub_directions(rows: int, s: Settings = Settings()) -> int:
    """Sub-directions of a block, so that ``rows`` vectors that may meet leave ``s.bucket`` to a filter."""
    return max(8, math.ceil(math.sqrt(s.lists * rows / s.bucket)))


def cap(share: float, dim: int) -> float:
    """The inner product with a random unit vector that this share of the unit sphere exceeds."""
    at = np.linspace(0, 1, 400_001)
    tail = np.cumsum(((1 - at * at) ** ((dim - 3) / 2))[::-1])[::-1]
    return float(at[np.searchsorted(-tail, -2 * min(0.5, share) * tail[0])])


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; their largest component is divided out first, so squares neither overflow nor vanish."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Code:
    LEAST_DIM = 16

    def __init__(self, dim: int, b: int, s: Settings, number: int = 0):
        rng = np.random.default_rng([s.seed, dim, number])
        full = max(self.LEAST_DIM, dim + dim % 2)
        self.half, self.b, self.first = full // 2, b, number * b * b
        self.turn = rotation(full, s.seed + number)[:dim]
        self.parts = []
        for _ in range(2):
            c = rng.normal(size=(self.half, b))
            self.parts.append(c / np.linalg.norm(c, axis=0))
        self.threshold = cap(s.lists / b**2, full) * math.sqrt(2)

    def decode(self, x: np.ndarray) -> list[list[int]]:
        """The filters that each row of unit length exceeds, ascending."""
        step = max(1, 2**20 // self.b)
        return [fs for at in range(0, len(x), step) for fs in self.part(x[at : at + step])]

    def part(self, x: np.ndarray) -> list[list[int]]:
        x = x @ self.turn
        left, right = x[:, : self.half] @ self.parts[0], x[:, self.half :] @ self.parts[1]
        by = np.argsort(-right, axis=1, kind="stable")
        best = np.take_along_axis(right, by, 1)
        out = []
        for i in range(len(x)):
            firsts = np.flatnonzero(left[i] + best[i, 0] > self.threshold)
            fits = np.searchsorted(-best[i], left[i, firsts] - self.threshold)
            out.append(sorted(self.first + f for a, n in zip(firsts.tolist(), fits, strict=True) for f in (a * self.b + by[i, :n]).tolist()))
        return out


def codes_needed(dim: int, b: int, s: Settings) -> int:
    """The codes that bring the chance to miss a pair at the limit to ``s.miss``, from random pairs in one code (upper bound at two sigma)."""
    rng = np.random.default_rng([s.seed, dim, b])
    x, z = rng.normal(size=(2, s.trials, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    y = s.cosine * x + math.sqrt(1 - s.cosine**2) * z
    missed, runs = 0, 5
    for k in range(runs):
        code, at = Code(dim, b, s, 1000 + k), slice(k, None, runs)
        missed += sum(set(p).isdisjoint(q) for p, q in zip(code.decode(x[at]), code.decode(y[at]), strict=True))
    chance = min(0.99, (missed + 2 * math.sqrt(missed) + 2) / s.trials)
    return max(1, math.ceil(math.log(s.miss) / math.log(chance)))


def fitted(dim: int, b: int, s: Settings) -> tuple[int, int]:
    """Sub-directions and codes: fewer and larger filters where a small dimension would need too many codes."""
    while (codes := codes_needed(dim, b, s)) > s.codes and b > 8:
        b = max(8, b // 2)
    return b, codes


def decoded(classes: DataFrame, b: int, s: Settings) -> DataFrame:
    """Adds ``filters`` of all codes to the rows, which have v."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fitted(d, b, s) for d in batch.column("dim").to_pylist()]
            yield pa.record_batch([batch.column("dim"), *(pa.array([x[k] for x in found], pa.int32()) for k in range(2))], ["dim", "b", "codes"])

    needed = {r["dim"]: (r["b"], r["codes"]) for r in classes.select(F.size("v").alias("dim")).distinct().mapInArrow(count, "dim int, b int, codes int").collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, list[Code]] = {}
        for batch in batches:
            found: list[list[int] | None] = [None] * batch.num_rows
            sizes = batch.column("v").value_lengths().to_numpy()
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                if dim not in codes:
                    codes[dim] = [Code(dim, needed[dim][0], s, k) for k in range(needed[dim][1])]
                x = unit(matrix(batch.column("v").take(pa.array(at))))
                for i, fs in zip(at.tolist(), zip(*(c.decode(x) for c in codes[dim]), strict=True), strict=True):
                    found[i] = [f for part in fs for f in part]
            yield pa.record_batch([*batch.columns, pa.array(found, pa.list_(pa.int64()))], [*batch.schema.names, "filters"])

    return classes.mapInArrow(run, T.StructType([*classes.schema.fields, T.StructField("filters", T.ArrayType(T.LongType()))]))


def local_roots(near: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id of each row's component in a tile."""
    low = ids.copy()
    while True:
        new = np.minimum(low, np.where(near, low[None], np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max))
        if (new == low).all():
            return low
        low = new


def compared(tiles: DataFrame, s: Settings) -> DataFrame:
    """(vec_id, links, root) of the classes that link inside a tile; links to a class count its copies."""
    keys = ["room", "filter", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, i, j), rows in groups(batches, keys):
            if rows.num_rows < 2:
                continue
            x = unit(matrix(rows.column("v").combine_chunks()))
            near = x @ x.T >= s.cosine
            np.fill_diagonal(near, False)
            if i != j:
                side = rows.column("own").to_numpy()
                near &= side[:, None] != side[None]
            at = np.flatnonzero(near.any(1))
            if not len(at):
                continue
            near, ids, copies = near[np.ix_(at, at)], rows.column("vec_id").to_numpy()[at], rows.column("copies").to_numpy()[at]
            lists = rows.column("before").take(pa.array(at)).to_pylist()
            place = {g: k for k, g in enumerate({g for fs in lists for g in fs})}
            has = np.zeros((len(at), len(place)), np.float32)
            for k, fs in enumerate(lists):
                has[k, [place[g] for g in fs]] = 1
            first = near & (has @ has.T == 0)
            yield pa.record_batch([pa.array(ids), pa.array(first @ copies, pa.int64()), pa.array(local_roots(near, ids))], ["vec_id", "links", "root"])

    lists = tiles.select(*keys, "own", "vec_id", "copies", "v", F.slice("filters", 1, F.col("pos")).alias("before"))
    return lists.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "vec_id long, links long, root long")


def near_duplicates(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of (vec_id, embedding, label)."""
    s = settings
    same = ["room", "a", "b"]
    valid = valid_vectors(rows.filter("label IS NOT NULL"), "label").withColumn("room", F.xxhash64("label", F.size("v")))
    vectors = cut(valid.select("vec_id", "room", F.xxhash64("v").alias("a"), F.xxhash64(F.lit(1), "v").alias("b"), "v"))
    least = cut(vectors.groupBy(*same).agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.first("v").alias("v")))
    largest = least.groupBy("room").count().agg(F.max("count")).first()[0] or 0
    classes = cut(decoded(least, sub_directions(largest, s), s))
    held = classes.select("vec_id", "room", F.posexplode("filters").alias("pos", "filter"))
    sizes = held.groupBy("room", "filter").agg(F.ceil(F.count("*") / s.tile).cast("int").alias("blocks"), F.count("*").alias("n")).filter("n > 1").drop("n")
    split = held.join(sizes, ["room", "filter"]).withColumn("own", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    pairs = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = pairs.select("room", "filter", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "vec_id", "pos")
    found = cut(compared(tiles.join(classes.select("vec_id", "copies", "v", "filters"), "vec_id"), s))
    links = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    labels = connected_components(found.select(F.col("vec_id").alias("u"), F.col("root").alias("v")))
    results = (
        classes.select("vec_id", *same, "copies").join(links, "vec_id", "left").join(labels.withColumnRenamed("id", "vec_id"), "vec_id", "left")
        .select("vec_id", *same, "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    )
    done = ["vec_id", "n_links", "component_id"]
    salted = results.filter("copies > 1").drop("vec_id").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(s.salts - 1))))
    members = vectors.select("vec_id", *same, F.pmod(F.xxhash64("vec_id"), F.lit(s.salts)).cast("int").alias("salt")).join(salted, [*same, "salt"])
    each = results.filter("copies = 1").select(*done).union(members.select(*done))
    return (
        rows.select("vec_id").join(each, "vec_id", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )
