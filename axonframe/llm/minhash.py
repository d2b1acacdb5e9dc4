"""MinHash near-duplicates by min-max hashing: each permutation keeps its smallest and its largest value.

Half as many hash evaluations give the same number of signature values as plain MinHash, still
unbiased and with lower variance, because the extremes of one permutation are negatively related.
Signatures are banded; what shares a band is a candidate, and a link needs
``den * |A & B| >= num * |A | B|`` on the full shingle sets (64-bit hashes of word tuples).

No pairs of a bucket are listed. Equal sets are one class, kept under its smallest doc_id. Each bucket
has a hub, the class in the largest buckets, and every other class is compared with the hubs of its
buckets. Two classes that link with their hub are one component. A pair with a class that doesn't is
compared in a tile of bounded size, where a class is held as its difference from the hub:
``|A & B| = |H| - |H - A| - |H - B| + |D(A) & D(B)|`` with D the difference from H both ways. Tiles
return an edge per class, not the pairs. So all pairs of all buckets are decided on full sets, and
the rows that move stay in proportion to the buckets' entries.

With 5 values in each of 28 bands a pair at similarity 0.8 is missed with probability 2e-5, at 0.9
with less than 1e-10.

Defined results: null text is empty; a text with fewer words than a shingle is one shingle; a text
without words has the empty set and links with nothing. A null doc_id links with nothing, its
component_id is null and it is kept. Rows that repeat a doc_id are one node. Columns other than
doc_id and text are neither read nor returned, whatever their names. Texts of any length are read whole. Pairs at exactly the
limit link, as the test is in whole numbers. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axonframe.llm.components import connected_components
from axonframe.llm.text import slices, utf8
from axonframe.llm.vectors import groups
from axonframe.plans.session import cut


@dataclass(frozen=True)
class Settings:
    """``bands`` counts those of the minima and of the maxima together."""

    words: int = 5
    num: int = 80
    den: int = 100
    bands: int = 28
    rows: int = 5
    seed: int = 11
    #: Members that meet a hub in one run, and the sides of a tile in rows and in bytes of differences.
    fan: int = 512
    outer: int = 128
    inner: int = 512
    side_bytes: int = 4_000_000
    #: Parts of a class of equal sets, when its members get their component.
    salts: int = 32
    #: At most so many ids are broadcast to the scan that rebuilds sets; beyond, the scan is joined by shuffle.
    broadcast_ids: int = 400_000


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


class Shingles:
    """Sorted distinct 64-bit hashes of the word shingles of a text; the word cache is bounded by number and by the words' length."""

    CACHE, LONGEST = 150_000, 64

    def __init__(self, words: int):
        self.words, self.cache = words, {}
        self.odd = [np.uint64(0x9E3779B97F4A7C15 + 2 * 0x1234567 * k) for k in range(words)]

    def _hash(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= self.LONGEST:
            if len(self.cache) >= self.CACHE:
                self.cache.clear()
            self.cache[word] = h
        return h

    def __call__(self, text: bytes) -> np.ndarray:
        tokens, cache = text.lower().split(), self.cache
        if not tokens:
            return np.zeros(0, np.uint64)
        if len(tokens) < self.words:
            return np.array([xxhash.xxh64_intdigest(b" ".join(tokens), seed=len(tokens))], np.uint64)
        h = np.array([cache.get(t) or self._hash(t) for t in tokens], np.uint64)
        n = len(h) - self.words + 1
        x = np.zeros(n, np.uint64)
        for k in range(self.words):
            x = mix(x + h[k : k + n] * self.odd[k])
        return np.unique(x)


class MinMax:
    """Band hashes of the minima and maxima over the permutations."""

    CHUNK = 4096

    def __init__(self, s: Settings):
        self.half = s.bands // 2
        rng = np.random.default_rng(s.seed)
        full = np.iinfo(np.uint64).max
        n = self.half * s.rows
        self.shape = (self.half, s.rows)
        self.a, self.b = rng.integers(0, full, n, np.uint64) | np.uint64(1), rng.integers(0, full, n, np.uint64)
        self.c = rng.integers(0, full, s.rows, np.uint64) | np.uint64(1)
        self.salt = mix(np.arange(1, s.bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        low = high = None
        for i in range(0, len(shingles), self.CHUNK):
            v = (shingles[i : i + self.CHUNK, None] ^ self.b) * self.a
            lo, hi = v.min(0), v.max(0)
            low, high = (lo, hi) if low is None else (np.minimum(low, lo), np.maximum(high, hi))
        both = np.concatenate([low.reshape(self.shape), high.reshape(self.shape)])
        return mix(mix((mix(both) * self.c).sum(1)) ^ self.salt).view(np.int64)


def sketches(docs: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, n, same, bands): set size, 128-bit digest of the set and band hashes; both null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, minmax = Shingles(s.words), MinMax(s)
        for b in slices(batches):
            size, same, bands = [], [], []
            for t in b.column("text").to_pylist():
                x = shingles(t)
                size.append(len(x))
                same.append(xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None)
                bands.append(minmax(x) if len(x) else None)
            yield pa.record_batch([b.column("doc_id"), pa.array(size, pa.int64()), pa.array(same, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n", "same", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text")).mapInArrow(run, "doc_id long, n long, same binary, bands array<long>")


def shingle_sets(docs: DataFrame, ids: DataFrame, s: Settings) -> DataFrame:
    """(id, set): sorted shingle hashes, as bytes, of the documents whose id is in ``ids`` (id, distinct)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(s.words)
        for b in slices(batches):
            yield pa.record_batch([b.column("id"), pa.array([shingles(t).tobytes() for t in b.column("text").to_pylist()], pa.binary())], ["id", "set"])

    wanted = F.broadcast(ids) if ids.count() <= s.broadcast_ids else ids
    return docs.select(F.col("doc_id").cast("long").alias("id"), utf8().alias("text")).join(wanted, "id", "left_semi").mapInArrow(run, "id long, set binary")


def stars(pairs: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """(hub, member, hub_n, n, missing, linked, diff) of each pair (hub, member).

    ``diff`` holds the shingles that one of the two sets has and the other hasn't, ``missing`` of them
    are the hub's. A hub's set is sent once per ``fan`` members, ahead of them.
    """
    fans = pairs.groupBy("hub").agg(F.ceil(F.count("*") / s.fan).cast("int").alias("fans"))
    left = fans.select("hub", F.explode(F.sequence(F.lit(0), F.col("fans") - 1)).alias("fan")).join(sets.withColumnRenamed("id", "hub"), "hub").withColumn("member", F.lit(None).cast("long"))
    right = pairs.join(fans, "hub").withColumn("fan", F.pmod(F.xxhash64("member"), "fans").cast("int")).drop("fans").join(sets.withColumnRenamed("id", "member"), "member")
    names = ["hub", "member", "hub_n", "n", "missing", "linked", "diff"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = np.zeros(0, np.uint64)
        for b in slices(batches):
            rows = []
            for hub, member, found in zip(b.column("hub").to_pylist(), b.column("member").to_pylist(), b.column("set"), strict=True):
                y = np.frombuffer(found.as_buffer(), np.uint64)
                if member is None:  # the hub comes before its members
                    x = y.copy()
                    continue
                diff = np.setxor1d(x, y, assume_unique=True)
                missing = (len(diff) + len(x) - len(y)) // 2
                both = len(x) - missing
                rows.append((hub, member, len(x), len(y), missing, both > 0 and s.den * both >= s.num * (len(x) + len(y) - both), diff.tobytes()))
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            yield pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names)

    met = left.unionByName(right).select("hub", "fan", "member", "set").repartition("hub", "fan").sortWithinPartitions("hub", "fan", F.col("member").asc_nulls_first())
    return met.mapInArrow(run, "hub long, member long, hub_n long, n long, missing long, linked boolean, diff binary")


def overlaps(diffs: list[np.ndarray], first: int) -> np.ndarray:
    """Sizes of the intersections of the first ``first`` sets with the others; shingles of one set alone are left out."""
    flat, rows = np.concatenate(diffs), np.repeat(np.arange(len(diffs)), [len(d) for d in diffs])
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    rows, column = rows[times[column] > 1], column[times[column] > 1]
    out = np.zeros((first, len(diffs) - first), np.float32)
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], np.unique(column[order], return_inverse=True)[1]
    for at in range(0, int(column.max(initial=-1)) + 1, 2048):
        low, high = np.searchsorted(column, [at, at + 2048])
        has = np.zeros((len(diffs), 2048), np.float32)
        has[rows[low:high], column[low:high] - at] = 1
        out += has[:first] @ has[first:].T
    return out


def bipartite_roots(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id of the component of each row and column that ``near`` links."""
    none = np.iinfo(np.int64).max
    while True:
        low = np.minimum(left, np.where(near, right[None], none).min(1, initial=none))
        high = np.minimum(right, np.where(near, low[:, None], none).min(0, initial=none))
        if (low == left).all() and (high == right).all():
            return low, high
        left, right = low, high


def tile_links(star: DataFrame, s: Settings) -> DataFrame:
    """(u, v): for classes that don't link with their hub, and those they link with, the smallest class of their component in each tile."""
    out = lambda x: F.sum(F.when(F.col("linked"), 0).otherwise(x))
    hubs = star.groupBy("hub").agg(out(1).alias("outs"), F.count("*").alias("all"), out(F.length("diff")).alias("out_bytes"), F.sum(F.length("diff")).alias("bytes")).filter("outs > 0 AND all > 1")
    sides = lambda n, rows, size: F.ceil(F.greatest(F.col(n) / rows, F.col(size) / s.side_bytes)).cast("int")
    hubs = hubs.select("hub", sides("outs", s.outer, "out_bytes").alias("is"), sides("all", s.inner, "bytes").alias("js"))
    met = star.join(hubs, "hub").withColumn("h", F.xxhash64("member"))
    own = lambda n: F.pmod("h", F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keep = ["member", "hub_n", "n", "missing", "diff"]
    outer = met.filter("NOT linked").withColumn("i", own("is")).select("hub", "i", every("js").alias("j"), F.lit(0).alias("side"), *keep)
    inner = met.withColumn("j", own("js")).select("hub", every("is").alias("i"), "j", F.lit(1).alias("side"), *keep)
    keys = ["hub", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groups(batches, [*keys]):
            first = rows.num_rows - int(rows.column("side").to_numpy().sum())
            if first in (0, rows.num_rows):
                continue
            ids, n, missing = (rows.column(c).to_numpy() for c in ("member", "n", "missing"))
            hub_n = int(rows.column("hub_n")[0].as_py())
            both = hub_n - missing[:first, None] - missing[None, first:] + overlaps([np.frombuffer(d.as_buffer(), np.uint64) for c in rows.column("diff").chunks for d in c], first)
            near = (both > 0) & (s.den * both >= s.num * (n[:first, None] + n[None, first:] - both)) & (ids[:first, None] != ids[None, first:])
            a, b = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
            if len(a):
                roots = bipartite_roots(near[np.ix_(a, b)], ids[:first][a], ids[first:][b])
                yield pa.record_batch([pa.array(np.concatenate([ids[:first][a], ids[first:][b]])), pa.array(np.concatenate(roots))], ["u", "v"])

    return outer.unionByName(inner).repartition(*keys).sortWithinPartitions(*keys, "side").mapInArrow(run, "u long, v long")


def class_components(docs: DataFrame, classes: DataFrame, s: Settings) -> DataFrame:
    """(id, component) of the classes (id, bands) that are linked with a smaller one."""
    entries = classes.select("id", F.posexplode("bands").alias("band", "h")).select("id", F.xxhash64("band", "h").alias("key"))
    shared = entries.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    members = cut(entries.join(shared, "key"))
    weight = members.groupBy("id").agg(F.sum("size").alias("weight"))
    sets = cut(shingle_sets(docs, weight.select("id"), s))
    top = F.max(F.struct("weight", (-F.col("id")).alias("down")))
    hub = members.join(weight, "id").groupBy("key").agg((-top["down"]).alias("hub"))
    pairs = members.join(hub, "key").filter("id <> hub").select("hub", F.col("id").alias("member")).distinct()
    star = cut(stars(pairs, sets, s))
    links = star.filter("linked").select(F.col("hub").alias("u"), F.col("member").alias("v"))
    return connected_components(links.union(tile_links(star, s)))


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    rows = cut(sketches(docs, settings))
    ids = cut(rows.filter("same IS NOT NULL AND doc_id IS NOT NULL").groupBy("same").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies")))
    classes = rows.select(F.col("doc_id").alias("id"), "same", "bands").join(ids.drop("copies"), ["id", "same"], "left_semi").dropDuplicates(["id", "same"])
    labels = class_components(docs, classes, settings)
    salt = F.pmod(F.xxhash64("doc_id", "n"), F.lit(settings.salts)).cast("int")
    several = ids.filter("copies > 1").select("same", "id", F.explode(F.sequence(F.lit(0), F.lit(settings.salts - 1))).alias("salt"))
    classed = rows.select("doc_id", "n", "same", salt.alias("salt")).join(several, ["same", "salt"], "left")
    of_class = ids.select("id").join(labels, "id")
    salted = of_class.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(settings.salts - 1))))
    return (
        classed.withColumn("id", F.coalesce("id", "doc_id")).join(salted, ["id", "salt"], "left")
        .withColumn("component_id", F.when(F.col("doc_id").isNull(), None).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "id")))
        .select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
    )


def without_near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, in the same columns, whatever their names; of rows with equal id and text one stays."""
    kept = near_duplicates(docs, settings).filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), F.struct("*").alias("row"))
    known = rows.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "h"])
    return known.select("row.*").union(docs.filter("doc_id IS NULL"))
