"""Approximate nearest neighbours over learned partitions.

The rows are divided into a tree of parts, as many as the table asks for: a node of more than
``Settings.leaf`` rows is split into up to ``parts`` children. For that the graph of nearest
neighbours of a bounded sample of its rows (those with the smallest hashes of their id, ``sample`` on
average) is cut into equal parts by recursive bisection: the slowest mode of each half, split at its
median, then improved by swaps. A small network learns which parts hold a point's neighbours. Every
row is indexed under its most probable part. A query goes to its most probable parts until their
probabilities reach a sum that is calibrated on sample rows the network has not seen, so that
``recall`` is reached against brute force; so a query inside a cluster visits one or two parts and one
among uniform vectors many. The leaves' rows are compared exactly.

The nodes of a level are fitted in tasks, one group of a sample each. Fitted nodes of a small measured
size are broadcast to the rows; beyond that rows and nodes meet by node and block. Leaves are split
into blocks of bounded size and their queries into slices, so no leaf, however many equal vectors it
holds, becomes one task. Queries whose leaves hold less than k rows are compared with all rows.

Defined results: null, zero and non-finite vectors and null ids take no part; rows that repeat a vec_id
are one vector. Vectors of different dimensions have no distance: each dimension is an index of its
own, with its own queries. Ties go to the smaller vec_id. With fewer candidates than k all are
returned. Blocks with components whose squares leave the range of doubles are compared by scaled
differences. An empty table gives an empty result. Columns other than vec_id and embedding are not read, whatever their names.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from axonframe.llm.vectors import groups, matrix, valid_vectors
from axonframe.plans.session import cut


@dataclass(frozen=True)
class Settings:
    """``leaf``: rows of a node that is not split; ``parts``: most children of a node, a power of two; ``batch``: rows that meet a node in one group; ``merged``: results that a task puts together; ``broadcast_*``: what is broadcast at most."""

    k: int = 10
    leaf: int = 256
    sample: int = 6000
    graph: int = 10
    parts: int = 64
    hidden: int = 64
    steps: int = 400
    recall: float = 0.95
    block: int = 2048
    slice: int = 1024
    batch: int = 20_000
    merged: int = 400_000
    broadcast_bytes: int = 16_000_000
    broadcast_nodes: int = 100_000
    seed: int = 7


def nearest(x: np.ndarray, q: np.ndarray, k: int, skip_self: bool) -> np.ndarray:
    """Indices of the k nearest rows of x for each row of q, in chunks."""
    out, norms = [], (x * x).sum(1)
    for i in range(0, len(q), 512):
        d = norms - 2 * q[i : i + 512] @ x.T
        if skip_self:
            d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        out.append(np.argpartition(d, k - 1, axis=1)[:, :k])
    return np.concatenate(out)


def bisect(members: np.ndarray, neighbours: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of ``members`` that cut few edges: power iteration, a median split, then swaps of the best gains."""
    n = len(members)
    place = np.full(len(neighbours), -1)
    place[members] = np.arange(n)
    to = place[neighbours[members]]
    a, b = np.repeat(np.arange(n), to.shape[1])[to.ravel() >= 0], to.ravel()[to.ravel() >= 0]
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    degree = np.maximum(np.bincount(a, minlength=n), 1)
    y = rng.normal(size=n)
    for _ in range(60):
        y = y - (y * degree).sum() / degree.sum()
        y = 0.5 * y + 0.5 * np.bincount(a, y[b], n) / degree
        y /= max(np.abs(y).max(), 1e-300)
    right = np.zeros(n, bool)
    right[np.argsort(y, kind="stable")[n // 2 :]] = True
    for _ in range(20):
        across = np.bincount(a, right[a] != right[b], n)
        gain = 2 * across - degree
        left_best = np.flatnonzero(~right)[np.argsort(-gain[~right], kind="stable")]
        right_best = np.flatnonzero(right)[np.argsort(-gain[right], kind="stable")]
        m = min(len(left_best), len(right_best))
        swap = np.flatnonzero(gain[left_best[:m]] + gain[right_best[:m]] > 2)
        swap = swap[: max(1, len(swap) // 4)]
        if not len(swap):
            break
        right[left_best[swap]], right[right_best[swap]] = True, False
    return members[~right], members[right]


def partition(neighbours: np.ndarray, parts: int, seed: int) -> np.ndarray:
    rng, pieces = np.random.default_rng(seed), [np.arange(len(neighbours))]
    while len(pieces) < parts:
        pieces = [half for p in pieces for half in bisect(p, neighbours, rng)]
    part = np.zeros(len(neighbours), int)
    for k, p in enumerate(pieces):
        part[p] = k
    return part


class Router:
    """One hidden layer and a softmax over the parts; ``most`` is the sum of probabilities up to which a query visits parts."""

    def __init__(self, mean: np.ndarray, scale: float, w: list[np.ndarray], most: float = 1.0):
        self.mean, self.scale, self.w, self.most = mean, scale, w, most

    def packed(self) -> bytes:
        return pickle.dumps((self.mean, self.scale, self.w, self.most))

    def forward(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.maximum(z @ self.w[0] + self.w[1], 0)
        y = h @ self.w[2] + self.w[3] + z @ self.w[4]
        y = np.exp(y - y.max(1, keepdims=True))
        return h, y / y.sum(1, keepdims=True)

    def ranked(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parts of each row, most probable first, and the probability of all before each."""
        y = self.forward((x - self.mean) / self.scale)[1]
        order = np.argsort(-y, axis=1, kind="stable")
        return order, np.cumsum(np.take_along_axis(y, order, 1), 1) - np.take_along_axis(y, order, 1)


def trained(x: np.ndarray, target: np.ndarray, s: Settings) -> Router:
    """Adam on the cross entropy with the share of each part in a point's neighbours."""
    rng = np.random.default_rng(s.seed)
    n, d, p = len(x), x.shape[1], target.shape[1]
    router = Router(x.mean(0), x.std() + 1e-12, [rng.normal(0, d**-0.5, (d, s.hidden)), np.zeros(s.hidden), rng.normal(0, s.hidden**-0.5, (s.hidden, p)), np.zeros(p), np.zeros((d, p))])
    w = router.w
    m, u = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    z = (x - router.mean) / router.scale
    for step in range(1, s.steps + 1):
        at = rng.integers(0, n, min(n, 512))
        h, y = router.forward(z[at])
        g = (y - target[at]) / len(at)
        gh = g @ w[2].T * (h > 0)
        for k, grad in enumerate([z[at].T @ gh, gh.sum(0), h.T @ g, g.sum(0), z[at].T @ g]):
            m[k] += 0.1 * (grad - m[k])
            u[k] += 0.01 * (grad * grad - u[k])
            w[k] -= 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(u[k] / (1 - 0.99**step)) + 1e-8)
    return router


def tame(*arrays: np.ndarray) -> float:
    """A power of two by which components are divided so that squares stay in range; 1 for ordinary vectors."""
    top = max((float(np.abs(a).max(initial=0)) for a in arrays), default=0.0)
    return 1.0 if top == 0 or 1e-120 < top < 1e120 else 2.0 ** math.frexp(top)[1]


def fit(x: np.ndarray, rows: int, recall: float, s: Settings) -> Router:
    """A router of a node of ``rows`` rows from a sample of them, calibrated on a tenth of it."""
    held = len(x) // 10
    index = x[held:]
    k, parts = min(s.graph, len(index) - 1), 1
    while parts < min(s.parts, rows / s.leaf) and len(index) >= 64 * parts:
        parts *= 2
    neighbours = nearest(index, index, k, True) if k > 0 else np.zeros((len(index), 0), int)
    part = partition(neighbours, parts, s.seed)
    target = np.zeros((len(index), parts))
    np.add.at(target, (np.repeat(np.arange(len(index)), k + 1), np.column_stack([part, part[neighbours]]).ravel()), 1 / (k + 1))
    router = trained(index, target, s)
    if held and parts > 1:
        home = router.ranked(index)[0][:, 0]
        true = home[nearest(index, x[:held], min(s.k, len(index)), False)]
        order, before = router.ranked(x[:held])
        needed = np.take_along_axis(before, np.take_along_axis(np.argsort(order, axis=1), true, 1), 1)
        router.most = float(np.quantile(needed, recall, method="higher")) + 1e-9
    return router


def fitted(index: DataFrame, large: DataFrame, recall: float, level: int, s: Settings) -> DataFrame:
    """(node, model) of the nodes ``large`` (node, count), each fitted in one group of its bounded sample."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("vec_id")
        x = matrix(rows.column("v").combine_chunks())
        x = x[np.random.default_rng(s.seed).permutation(len(x))]
        router = fit(x / tame(x), rows.column("count")[0].as_py(), recall, s)
        return pa.table({"node": pa.array([key[0].as_py()]), "model": pa.array([router.packed()], pa.binary())})

    drawn = F.pmod(F.xxhash64("vec_id", F.lit(level)), F.lit(1_000_000_007)) < F.lit(1_000_000_007.0) * s.sample / F.col("count")
    return index.join(F.broadcast(large) if large.count() <= s.broadcast_nodes else large, "node").filter(drawn).groupBy("node").applyInArrow(run, "node string, model binary")


def sent(router: Router, x: np.ndarray, several: bool) -> list[list[int]]:
    order, before = router.ranked(x / tame(x))
    if not several:
        return order[:, :1].tolist()
    return [o[:n].tolist() for o, n in zip(order, np.maximum(1, (before < router.most).sum(1)), strict=True)]


def route(rows: DataFrame, models: DataFrame, several: bool, s: Settings) -> DataFrame:
    """(vec_id, v, node): rows of fitted nodes move to their most probable child, or to ``several``; others stay."""
    schema = "vec_id long, v array<double>, node string"

    def moved(batch: pa.RecordBatch | pa.Table, held: dict[str, Router]) -> Iterator[pa.RecordBatch]:
        node = batch.column("node").to_pylist()
        for name in dict.fromkeys(node):
            part = batch.take(pa.array([i for i, n in enumerate(node) if n == name]))
            v = part.column("v").combine_chunks() if isinstance(part, pa.Table) else part.column("v")
            to = sent(held[name], matrix(v), several) if name in held else [[]] * part.num_rows
            at = pa.array([i for i, t in enumerate(to) for _ in t or [0]], pa.int64())
            names = pa.array([f"{name}/{c}" if t else name for t in to for c in (t or [0])], pa.string())
            yield pa.record_batch([part.column("vec_id").take(at).combine_chunks() if isinstance(part, pa.Table) else part.column("vec_id").take(at), v.take(at), names], ["vec_id", "v", "node"])

    if models.agg(F.coalesce(F.sum(F.length("model")), F.lit(0))).first()[0] <= s.broadcast_bytes:
        known = rows.sparkSession.sparkContext.broadcast({r["node"]: r["model"] for r in models.collect()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = {n: Router(*pickle.loads(m)) for n, m in known.value.items()}
            for b in batches:
                yield from moved(b, held)

        return rows.mapInArrow(run, schema)
    blocks = rows.join(models.select("node"), "node", "left_semi").groupBy("node").agg(F.ceil(F.count("*") / s.batch).cast("int").alias("blocks"))
    dealt = rows.join(blocks, "node", "left").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.coalesce("blocks", F.lit(1))).cast("int"))
    copies = models.join(blocks, "node").select("node", "model", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        held = {n: Router(*pickle.loads(m)) for n, m in zip(right.column("node").to_pylist(), right.column("model").to_pylist(), strict=True)}
        return pa.Table.from_batches(list(moved(left, held)), pa.schema({"vec_id": pa.int64(), "v": pa.list_(pa.float64()), "node": pa.string()}))

    stay = dealt.filter("blocks IS NULL").select("vec_id", "v", "node")
    return dealt.filter("blocks IS NOT NULL").select("vec_id", "v", "node", "block").groupBy("node", "block").cogroup(copies.groupBy("node", "block")).applyInArrow(meet, schema).union(stay)


def indexed(vectors: DataFrame, is_query: str, s: Settings) -> tuple[DataFrame, DataFrame]:
    """(vec_id, v, node) of all rows with their leaf, and of the queries with each leaf that they visit."""
    index = vectors.withColumn("node", F.size("v").cast("string"))
    asked = index.filter(is_query)
    most = index.groupBy("node").count().agg(F.max("count")).first()[0] or 0
    levels = math.ceil(math.log(max(1.0, most / s.leaf)) / math.log(s.parts))
    for level in range(levels):
        large = index.groupBy("node").count().filter(F.col("count") > s.leaf)
        models = cut(fitted(index, large, s.recall ** (1 / levels), level, s))
        index, asked = cut(route(index, models, False, s)), cut(route(asked, models, True, s))
    return index, asked


def distances(c: np.ndarray, q: np.ndarray, plain: bool) -> np.ndarray:
    """Euclidean; unless ``plain`` each row's largest difference is divided out first."""
    if plain or not len(c):
        return np.sqrt(((c - q) ** 2).sum(1))
    d = np.abs(c - q)
    top = np.maximum(d.max(1, keepdims=True), 5e-324)
    return top[:, 0] * np.sqrt(((d / top) ** 2).sum(1))


def compared(here: DataFrame, there: DataFrame, s: Settings) -> DataFrame:
    """(query_id, vec_id, score): the k nearest rows of ``here`` (vec_id, v, node) for each row of ``there``, node by node and block by block."""
    sizes = here.groupBy("node").agg(F.ceil(F.count("*") / s.block).cast("int").alias("blocks"))
    dealt = cut(sizes.join(there.groupBy("node").agg(F.ceil(F.count("*") / s.slice).cast("int").alias("slices")), "node"))
    dealt = F.broadcast(dealt) if dealt.count() <= s.broadcast_nodes else dealt
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys, names = ["node", "block", "slice"], ["query_id", "vec_id", "score"]
    candidates = here.join(dealt, "node").withColumn("block", own("blocks")).select("node", "block", every("slices").alias("slice"), F.lit(False).alias("query"), "vec_id", "v")
    queries = there.join(dealt, "node").withColumn("slice", own("slices")).select("node", every("blocks").alias("block"), "slice", F.lit(True).alias("query"), "vec_id", "v")

    def best_of(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, c, d = (np.concatenate(z) for z in zip(*parts, strict=True))
        order = np.lexsort((c, d, q))
        q, c, d = q[order], c[order], d[order]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        keep = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)])) < s.k
        return q[keep], c[keep], d[keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's leaves are put together: of a query that visits several, only the k nearest go on."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0
        for _, rows_of in groups(batches, keys):
            asks = rows_of.column("query").to_numpy()
            ids, x = rows_of.column("vec_id").to_numpy(), matrix(rows_of.column("v").combine_chunks())
            if not asks.any() or asks.all():
                continue
            c, cid, plain = x[~asks], ids[~asks], tame(x) == 1.0
            norms = (c * c).sum(1) if plain else None
            for q, qid in zip(x[asks], ids[asks], strict=True):
                near = cid != qid
                if plain:
                    rough = np.where(near, norms - 2 * c @ q + q @ q, np.inf)
                    kth = np.partition(rough, min(s.k, len(rough)) - 1)[min(s.k, len(rough)) - 1]
                    near &= rough <= kth + 1e-9 * (1 + q @ q + norms.max())
                near = np.flatnonzero(near)
                exact = distances(c[near], q, plain)
                best = np.lexsort((cid[near], exact))[: s.k]
                out.append((np.full(len(best), qid), cid[near[best]], exact[best]))
                held += len(best)
            if held > s.merged:
                out = [best_of(out)]
                held = len(out[0][0])
                if 2 * held > s.merged:
                    yield pa.record_batch(list(map(pa.array, out[0])), names)
                    out, held = [], 0
        if out:
            yield pa.record_batch(list(map(pa.array, best_of(out))), names)

    met = queries.unionByName(candidates).repartition(*keys).sortWithinPartitions(*keys)
    return met.mapInArrow(run, "query_id long, vec_id long, score double")


def nearest_neighbours(rows: DataFrame, is_query: str = "vec_id % 100 = 0", settings: Settings = Settings()) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance): the k nearest found of every query row."""
    s = settings
    vectors = cut(valid_vectors(rows))
    index, asked = indexed(vectors, is_query, s)
    found = cut(compared(index, asked, s))
    dims = vectors.groupBy(F.size("v").alias("dim")).count()
    got = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("n"))
    wanted = vectors.filter(is_query).withColumn("dim", F.size("v")).join(dims, "dim").join(got, "vec_id", "left")
    short = cut(wanted.filter(F.coalesce("n", F.lit(0)) < F.least(F.lit(s.k), F.col("count") - 1)).select("vec_id", "v", F.col("dim").cast("string").alias("node")))
    if not short.isEmpty():
        again = compared(vectors.withColumn("node", F.size("v").cast("string")), short, s)
        found = found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(again)
    best = W.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= s.k).select("query_id", "rank", "vec_id", "score")
