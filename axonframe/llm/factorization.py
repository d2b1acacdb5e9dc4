"""Factorisation machines over hashed words: screened features, numpy training, linear-time scoring.

A document is the set of its active features, all with value 1: hashed words, hashed word beginnings
and ends, and bins of structure statistics and of the length. The score is
``sigmoid(b + sum w_i + 1/2 sum_f((sum_i v_if)^2 - sum_i v_if^2))``; the sum-of-squares identity makes
the pairwise part linear in the number of features.

The model is fitted on at most ``Settings.sample`` labelled rows (those with the smallest hash of
their id). Features are counted by class and screened in Spark; only the ``Settings.kept`` best of
them and the rows' features among these, two bytes each, reach the driver, so what it holds and what
travels to the tasks has a fixed size, however long the texts are. Scoring covers every whole text.

Defined results: null text scores as empty text; an empty text has only its bins; null ids are never
learnt from; labels that repeat an id count once, by their largest value; without labelled rows of
both classes every score is the share of label 1 (0.5 without any). Tables may be empty, and columns
other than the named ones are neither read nor returned.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axonframe.llm.text import fold, slices, utf8
from axonframe.plans.session import cut

UPPER, LOWER, DIGITS = (bytes(range(a, b + 1)) for a, b in ((65, 90), (97, 122), (48, 57)))
SPACES = bytes([32, *range(9, 14)])
PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())


@dataclass(frozen=True)
class Settings:
    """``affix``: lengths of word beginnings (positive) and ends (negative) that are features too."""

    buckets: int = 1 << 20
    affix: tuple[int, ...] = (5, -3)
    sample: int = 12_000
    kept: int = 3_000
    rank: int = 6
    epochs: int = 14
    batch: int = 1_000
    rate: float = 0.05
    l2: float = 2e-5
    least_docs: int = 4
    least_z: float = 2.5


@dataclass(frozen=True)
class Model:
    """``ids``: kept features in order; ``w`` and ``v`` in the same order; ``prior`` is used if nothing was learnt."""

    settings: Settings
    ids: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray
    prior: float | None


def word_features(word: bytes, s: Settings) -> list[int]:
    found = [zlib.crc32(word) % s.buckets]
    for n in s.affix:
        if len(word) > abs(n):
            found.append(zlib.crc32(word[:n] if n > 0 else word[n:], 7 * n & 0xFFFF) % s.buckets)
    return found


def structure(text: bytes, tokens: list[bytes], distinct: int) -> list[float]:
    """Statistics of the raw bytes and words; each becomes a bin."""
    n = max(1, len(text))
    letters = n - len(text.translate(None, UPPER + LOWER))
    lines = text.count(b"\n") + 1
    return [
        min(20.0, math.log2(1 + len(tokens))),
        20 * (len(text) - len(text.translate(None, UPPER))) / max(1, letters),
        40 * (len(text) - len(text.translate(None, PUNCTUATION))) / n,
        40 * (len(text) - len(text.translate(None, DIGITS))) / n,
        20 * distinct / max(1, len(tokens)),
        min(30.0, 2 * n / max(1, len(tokens))),
        min(20.0, 2 * math.log2(1 + n / lines)),
        min(10.0, math.log2(1 + text.count(b"|"))),
        min(10.0, math.log2(1 + text.count(b"!!") + text.count(b"***") + text.count(b"###"))),
    ]


def bins(text: bytes, tokens: list[bytes], distinct: int, s: Settings) -> list[int]:
    """Ids of the bins: they lie above the hashed words."""
    return [s.buckets + 64 * k + int(x) for k, x in enumerate(structure(text, tokens, distinct))]


class Features:
    """Maps texts to features, with a word cache bounded by number and by the words' length; ``kept`` limits it to screened ids."""

    CACHE, LONGEST = 80_000, 64

    def __init__(self, s: Settings, kept: np.ndarray | None = None):
        self.s, self.cache = s, {}
        self.place = None if kept is None else {int(x): i for i, x in enumerate(kept)}

    def of_word(self, word: bytes) -> tuple[int, ...]:
        found = word_features(word, self.s)
        if self.place is not None:
            found = [self.place[x] for x in found if x in self.place]
        got = tuple(found)
        if len(word) <= self.LONGEST:
            if len(self.cache) >= self.CACHE:
                self.cache.clear()
            self.cache[word] = got
        return got

    def __call__(self, text: bytes) -> list[int]:
        tokens = text.lower().split()
        distinct, cache, active = set(tokens), self.cache, set()
        for word in distinct:
            got = cache.get(word)
            if got is None:
                got = self.of_word(word)
            if got:
                active.update(got)
        extra = bins(text, tokens, len(distinct), self.s)
        if self.place is not None:
            extra = [self.place[x] for x in extra if x in self.place]
        active.update(extra)
        return sorted(active)


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, s: Settings, parts: int) -> DataFrame:
    """(doc_id, label, features) of at most ``s.sample`` documents outside fold 0; the bounded ids are broadcast to the texts."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.least(F.lit(1), F.greatest(F.lit(0), F.col(label).cast("int"))).alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & (fold("doc_id", parts) != 0))
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.sample)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(s)
        for b in slices(batches):
            rows = [np.asarray(features(t), dtype="<i4").tobytes() for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), b.column("label"), pa.array(rows, pa.binary())], ["doc_id", "label", "features"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text")).join(F.broadcast(chosen), "doc_id")
    found = rows.mapInArrow(run, "doc_id long, label int, features binary")
    return cut(found.groupBy("doc_id").agg(F.min(F.struct("features", "label")).alias("row")).select("doc_id", "row.*"))


def screened(rows: DataFrame, s: Settings) -> np.ndarray:
    """The features whose presence differs most between the classes, by a smoothed log odds ratio over its deviation."""
    of = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((2, s.buckets + 64 * 16), np.int32)
        for b in batches:
            for label, x in zip(b.column("label").to_pylist(), b.column("features").to_pylist(), strict=True):
                found[label, np.frombuffer(x, "<i4")] += 1  # a row has a feature once
        at = np.flatnonzero(found.any(0))
        yield pa.record_batch([pa.array(at, pa.int64()), *(pa.array(found[k, at].astype(np.int64)) for k in range(2))], ["id", "zero", "one"])

    counts = rows.select("label", "features").mapInArrow(run, "id long, zero long, one long").groupBy("id").agg(F.sum("zero").alias("zero"), F.sum("one").alias("one"))
    side = lambda n, c: F.log((F.col(c) + 0.5) / (F.lit(n) - F.col(c) + 0.5))
    z = F.abs(side(of.get(1, 0), "one") - side(of.get(0, 0), "zero")) / F.sqrt(1 / (F.col("one") + 0.5) + 1 / (F.col("zero") + 0.5))
    enough = (F.col("zero") + F.col("one") >= s.least_docs) | (F.col("id") >= s.buckets)
    best = counts.filter(enough).withColumn("z", F.round(z, 9)).filter(F.col("z") > s.least_z).orderBy(F.desc("z"), "id").limit(s.kept)
    return np.sort(np.array([r["id"] for r in best.select("id").collect()], np.int64))


def kept_features(rows: DataFrame, ids: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(label, places among ``ids``) of the rows, by the hash of their id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.flatnonzero(np.isin(ids, np.frombuffer(x, "<i4"), assume_unique=True)).astype("<u2").tobytes() for x in b.column("features").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), b.column("label"), pa.array(found, pa.binary())], ["doc_id", "label", "places"])

    got = rows.mapInArrow(run, "doc_id long, label int, places binary").toArrow()
    order = sorted(range(got.num_rows), key=lambda k: zlib.crc32(str(got.column("doc_id")[k].as_py()).encode()))
    labels, places = got.column("label").to_pylist(), got.column("places").to_pylist()
    return [(labels[k], np.frombuffer(places[k], "<u2").astype(np.int64)) for k in order]


def sums(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive slices; empty slices are 0."""
    out = np.zeros((len(starts), *values.shape[1:]))
    if (full := sizes > 0).any():
        out[full] = np.add.reduceat(values, starts[full], axis=0)
    return out


def logits(model_bias: float, w: np.ndarray, v: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(int) if len(sizes) else np.zeros(0, int)
    s = sums(v[flat], starts, sizes)
    pairs = 0.5 * ((s * s).sum(1) - sums((v * v).sum(1)[flat], starts, sizes))
    return model_bias + sums(w[flat], starts, sizes) + pairs, s


def train(sample: list[tuple[int, np.ndarray]], ids: np.ndarray, s: Settings) -> Model:
    """Adam on the logistic loss, in batches of rows; the rows come in the order of their hash, their features as places among ``ids``."""
    y = np.array([a for a, _ in sample], dtype=float)
    if len(y) == 0 or y.min() == y.max():
        return Model(s, np.zeros(0, np.int64), 0.0, np.zeros(0), np.zeros((0, s.rank)), float(y.mean()) if len(y) else 0.5)
    sizes, flat = np.array([len(r) for _, r in sample]), np.concatenate([r for _, r in sample])
    rows, ends = np.repeat(np.arange(len(y)), sizes), np.concatenate([[0], np.cumsum(sizes)])
    rng = np.random.default_rng(17)
    p = [np.array([math.log(y.mean() / (1 - y.mean()))]), np.zeros(len(ids)), rng.normal(0, 0.02, (len(ids), s.rank))]
    m, u = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    for step in range(1, s.epochs * -(-len(y) // s.batch) + 1):
        a = (step - 1) * s.batch % (-(-len(y) // s.batch) * s.batch)
        b = min(len(y), a + s.batch)
        part, of = flat[ends[a] : ends[b]], rows[ends[a] : ends[b]] - a
        z, mix = logits(p[0][0], p[1], p[2], part, np.diff(ends[a : b + 1]))
        g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[a:b]) / (b - a)
        per = g[of]
        gv = np.stack([np.bincount(part, per * mix[of, f], len(ids)) for f in range(s.rank)], 1) - np.bincount(part, per, len(ids))[:, None] * p[2]
        grads = [np.array([g.sum()]), np.bincount(part, per, len(ids)) + s.l2 * p[1], gv + 4 * s.l2 * p[2]]
        for k, d in enumerate(grads):
            m[k], u[k] = 0.9 * m[k] + 0.1 * d, 0.99 * u[k] + 0.01 * d * d
            p[k] = p[k] - s.rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(u[k] / (1 - 0.99**step)) + 1e-8)
    return Model(s, ids, float(p[0][0]), p[1], p[2], None)


def fit(docs: DataFrame, labels: DataFrame, label: str, settings: Settings, parts: int = 5) -> Model:
    rows = labelled_rows(docs, labels, label, settings, parts)
    ids = screened(rows, settings)
    return train(kept_features(rows, ids), ids, settings)


def probabilities(model: Model, texts: list[bytes], features: Features) -> np.ndarray:
    if model.prior is not None:
        return np.full(len(texts), model.prior)
    active = [features(t) for t in texts]
    sizes = np.array([len(a) for a in active], dtype=int)
    flat = np.fromiter((i for a in active for i in a), int, int(sizes.sum()))
    z, _ = logits(model.bias, model.w, model.v, flat, sizes)
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def score(docs: DataFrame, model: Model, keep: list[str], into: str = "score") -> DataFrame:
    """The columns ``keep`` of ``docs`` and the probability of label 1 of every whole text, without a shuffle."""
    schema = docs.select(*keep).schema.add(into, "double", False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(model.settings, model.ids)
        for b in slices(batches):
            got = probabilities(model, b.column(b.num_columns - 1).to_pylist(), features)
            yield pa.record_batch([*b.columns[:-1], pa.array(got, pa.float64())], [*keep, into])

    return docs.select(*keep, utf8().alias("__utf8")).mapInArrow(run, schema)
