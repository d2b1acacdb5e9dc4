"""Language model scoring: a log-bilinear model over word classes, trained with noise contrast.

Words map to ``classes`` classes that are learnt: the end and the most frequent words one each, and all
others by where they stand. The ``words`` most frequent words, and groups of the rest by their last letters,
are counted beside first classes of their left and right neighbours over the whole training fold; these
context vectors (positive pointwise mutual information, reduced by a singular value decomposition)
are clustered. The model predicts a class from the two before it:
``s(c | c1, c2) = (A1 r_c1 + A2 r_c2) . q_c + b_c``, with the word inside its class by its smoothed
count. A token costs one lookup, because one batched matrix product over all ``classes ** 2``
contexts, normalised by a log-sum-exp, gives every class probability.

The classes are a fixed size, whatever the corpus; counts of words grow with it. On sf0.1, held out, a
token costs 4.25 by the base, 4.03 with classes by frequency and endings alone, 3.79 with learnt ones and
3.78 with 192 of them.

Training sees the whole training fold through its class trigram counts: their number is fixed by
``classes``, whatever the corpus. Noise contrastive estimation separates counted trigrams from
classes drawn by their overall share; bias b starts at the log of that share.

Word counts grow with the corpus, so they are not broadcast whole: the ``common`` most frequent words
are, and tokens of other words are looked up by a join on the word.

Defined results: null text is empty, and an empty text is one end token; words never seen in training
score by the smoothing alone; very long texts are scored whole; without training rows N and V are 0, and every base token costs
log10(0.1 / 0.1) = 0. Null ids belong to fold 0, which is held out. Rows that repeat an id are scored
one by one. Columns other than doc_id and text are neither read nor returned.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axonframe.llm.text import fold, slices, utf8
from axonframe.plans.session import cut

END = b"\n"
LN10 = np.log(10.0)


@dataclass(frozen=True)
class Settings:
    """``first``: classes by frequency and ending that neighbours are counted by; ``words`` and ``ends``: what is clustered."""

    classes: int = 128
    singles: int = 31
    first: int = 64
    words: int = 4096
    ends: int = 2048
    reduced: int = 32
    rounds: int = 12
    common: int = 150_000
    parts: int = 10
    smooth: float = 0.1
    width: int = 16
    noise: int = 12
    steps: int = 1200
    batch: int = 4096
    rate: float = 0.02
    #: Distinct words that a task holds back before it hands their counts on.
    held: int = 500_000


def count_words(docs: DataFrame, s: Settings) -> DataFrame:
    """(word, n) over the texts, the end included; partly summed within each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            got = pa.record_batch([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "n"])
            found.clear()
            return got

        for b in batches:
            for t in b.column("text"):
                found.update(t.as_py().lower().split())
                found[END] += 1
                if len(found) > s.held:
                    yield out()
        yield out()

    return docs.select(utf8().alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def common_words(counts: DataFrame, s: Settings) -> dict[bytes, int]:
    """The most frequent words: those above the least frequency that ``s.common`` words or fewer exceed."""
    step = F.floor(16 * F.log2("n"))
    left, least = s.common, None
    for r in counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        left -= r["count"]
        if left < 0:
            break
        least = r["step"]
    if least is None:
        return {}
    got = counts.filter(step >= least).toArrow()
    return dict(zip(got.column("word").to_pylist(), got.column("n").to_pylist(), strict=True))


class Classes:
    """The class of a word: by itself, or else by its last letters."""

    def __init__(self, of: dict[bytes, int], ends: list[int]):
        self.of, self.ends = of, ends

    def end(self, word: bytes) -> int:
        return zlib.crc32(word.rstrip(b".,;:!?")[-3:]) % len(self.ends)

    def __call__(self, word: bytes) -> int:
        got = self.of.get(word)
        return self.ends[self.end(word)] if got is None else got


def first_classes(singles: list[bytes], s: Settings) -> Classes:
    of = {END: 0} | {w: k + 1 for k, w in enumerate(singles)}
    return Classes(of, list(range(len(of), max(len(of) + 1, s.first))))


def count_neighbours(docs: DataFrame, first: Classes, rows: Classes, height: int, s: Settings) -> np.ndarray:
    """For each row (a word or an ending) the first classes on its left and right. At most ``height * 2 * s.first`` cells reach the driver."""
    n = max(first.ends) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, of, at = np.zeros(height * 2 * n, np.int64), Cached(first), Cached(rows)
        for b in slices(batches):
            ws: list[bytes] = []
            for t in b.column("text").to_pylist():
                ws += t.lower().split()
                ws.append(END)
            near, row = np.array(list(map(of.__getitem__, ws))), np.array(list(map(at.__getitem__, ws))) * 2 * n
            left = np.concatenate([[0], near[:-1]])  # after an end comes the next text's first word: the end is 0
            right = (near != 0)[:-1]
            total += np.bincount(np.concatenate([row + left, (row[:-1] + n + near[1:])[right]]), minlength=len(total))
        at_cells = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at_cells, pa.int64()), pa.array(total[at_cells])], ["cell", "n"])

    got = docs.select(utf8().alias("text")).mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(height * 2 * n)
    counts[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return counts.reshape(height, 2 * n)


def clusters(counts: np.ndarray, k: int, s: Settings) -> np.ndarray:
    """The cluster of each row by its context vector, weighted by its tokens; rows without tokens are in cluster 0."""
    total = counts.sum(1)
    label = np.zeros(len(counts), int)
    seen = np.flatnonzero(total)
    if not len(seen):
        return label
    expected = total[seen, None] * counts.sum(0)[None] / total.sum()
    info = np.log(np.maximum(counts[seen], 1e-9) / np.maximum(expected, 1e-9))
    x = np.maximum(info, 0) * np.minimum(1, total[seen, None] / 20)
    weight = total[seen]
    _, _, vt = np.linalg.svd(x * weight[:, None] ** 0.25, full_matrices=False)
    x = x @ vt[: s.reduced].T
    rng = np.random.default_rng(5)
    centres = x[rng.choice(len(seen), min(k, len(seen)), replace=False, p=weight / total.sum())]
    for _ in range(s.rounds):
        own = ((centres * centres).sum(1) - 2 * x @ centres.T).argmin(1)
        mass = np.bincount(own, weight, len(centres))
        sums = np.stack([np.bincount(own, weight * x[:, f], len(centres)) for f in range(x.shape[1])], 1)
        centres = np.where(mass[:, None] > 0, sums / np.maximum(mass[:, None], 1e-9), centres)
    label[seen] = own
    return label


def learnt_classes(docs: DataFrame, common: dict[bytes, int], s: Settings) -> Classes:
    order = [w for w in sorted(common, key=lambda w: (-common[w], w)) if w != END]
    singles, top = order[: s.singles], order[s.singles : s.singles + s.words]
    fixed = {END: 0} | {w: k + 1 for k, w in enumerate(singles)}
    # rows to cluster: the top words, then the endings; the end and the singles share a last row that is left out
    rows = Classes({w: k for k, w in enumerate(top)} | dict.fromkeys(fixed, len(top) + s.ends), list(range(len(top), len(top) + s.ends)))
    counts = count_neighbours(docs, first_classes(singles, s), rows, len(top) + s.ends + 1, s)[:-1]
    label = (len(fixed) + clusters(counts, s.classes - len(fixed), s)).tolist()
    return Classes(fixed | dict(zip(top, label, strict=False)), label[len(top) :])


class Cached(dict):
    """Classes of words, looked up once; cleared when it has grown to its bound."""

    BOUND = 200_000

    def __init__(self, classes: Classes):
        super().__init__()
        self.classes = classes

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.BOUND:
            self.clear()
        got = self[word] = self.classes(word)
        return got


class Coded(dict):
    """The place of a common word, or -1 less the class of any other."""

    def __init__(self, classes: Classes, places: dict[bytes, int]):
        super().__init__(places)
        self.classes = classes

    def __missing__(self, word: bytes) -> int:
        return -1 - self.classes(word)


def contexts(c: np.ndarray, n: int) -> np.ndarray:
    """Cells (c2 * n + c1) * n + c of a token stream; before the text stands the end."""
    padded = np.concatenate([[0, 0], c])
    return (padded[:-2] * n + padded[1:-1]) * n + c


def count_trigrams(docs: DataFrame, classes: Classes, s: Settings) -> np.ndarray:
    """Class trigram counts of the texts. At most classes ** 3 cells reach the driver."""
    n = s.classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, of = np.zeros(n**3, np.int64), Cached(classes)
        for b in batches:
            for part in slices([b]):
                cells = [contexts(np.array([*map(of.__getitem__, t.lower().split()), 0]), n) for t in part.column("text").to_pylist()]
                total += np.bincount(np.concatenate(cells), minlength=n**3)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(total[at])], ["cell", "n"])

    got = docs.select(utf8().alias("text")).mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(n**3)
    counts[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return counts


def train(counts: np.ndarray, s: Settings) -> np.ndarray:
    """log10 probabilities of each class after each pair of classes, classes**2 rows."""
    n, d, k = s.classes, s.width, s.noise
    rng = np.random.default_rng(5)
    share = counts.reshape(-1, n).sum(0) + 1.0
    share /= share.sum()
    b, r, q = np.log(share), rng.normal(0, 0.1, (n, d)), rng.normal(0, 0.1, (n, d))
    a1, a2 = np.eye(d) + rng.normal(0, 0.02, (d, d)), np.eye(d) * 0.5 + rng.normal(0, 0.02, (d, d))
    params = [b, r, q, a1, a2]
    m, u = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
    seen = np.flatnonzero(counts)
    along = np.cumsum(counts[seen])
    noise_along, log_noise = np.cumsum(share), np.log(k * share)
    for step in range(1, s.steps + 1 if len(seen) else 1):
        cell = seen[np.searchsorted(along, rng.random(s.batch) * along[-1], side="right")]
        c2, c1, c = cell // (n * n), cell // n % n, cell % n
        drawn = np.minimum(np.searchsorted(noise_along, rng.random((s.batch, k)), side="right"), n - 1)
        target = np.concatenate([c[:, None], drawn], 1)
        h = r[c1] @ a1 + r[c2] @ a2
        delta = np.einsum("bd,bkd->bk", h, q[target]) + b[target] - log_noise[target]
        g = 1 / (1 + np.exp(-np.clip(delta, -30, 30)))
        g[:, 0] -= 1
        g /= s.batch
        flat = target.ravel()
        gh = np.einsum("bk,bkd->bd", g, q[target])
        gq = np.stack([np.bincount(flat, (g * h[:, f : f + 1]).ravel(), n) for f in range(d)], 1)
        g1, g2 = gh @ a1.T, gh @ a2.T
        gr = np.stack([np.bincount(c1, g1[:, f], n) + np.bincount(c2, g2[:, f], n) for f in range(d)], 1)
        rate = s.rate * (1 - step / (s.steps + 1)) + 1e-4
        for x, grad, mm, uu in zip(params, [np.bincount(flat, g.ravel(), n), gr, gq, r[c1].T @ gh, r[c2].T @ gh], m, u, strict=True):
            mm += 0.1 * (grad - mm)
            uu += 0.01 * (grad * grad - uu)
            x -= rate * (mm / (1 - 0.9**step)) / (np.sqrt(uu / (1 - 0.99**step)) + 1e-8)
    left, right = r @ a2, r @ a1
    z = (left[:, None] + right[None]).reshape(-1, d) @ q.T + b
    z -= z.max(1, keepdims=True)
    return (z - np.log(np.exp(z).sum(1, keepdims=True))) / LN10


def score(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    s = settings
    training = docs.filter(fold("doc_id", s.parts) != 0)
    counts = cut(count_words(training, s))
    common = common_words(counts, s)
    classes = learnt_classes(training, common, s)

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [classes(w) for w in b.column("word").to_pylist()]
            yield pa.record_batch([pa.array(got, pa.int32()), b.column("n")], ["class", "n"])

    by_class = counts.mapInArrow(classed, "class int, n long").groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    class_n, class_v = np.zeros(s.classes), np.zeros(s.classes)
    for r in by_class:
        class_n[r["class"]], class_v[r["class"]] = r["n"], r["v"]
    total, distinct = int(class_n.sum()), int(class_v.sum())
    table = train(count_trigrams(training, classes, s), s).astype(np.float32)
    base_log = float(np.log10(total + s.smooth * (distinct + 1)))
    class_log = np.log10(class_n + s.smooth * (class_v + 1))
    spark, floor = docs.sparkSession, float(np.log10(s.smooth))
    held = spark.sparkContext.broadcast((common, table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, logs = held.value
        flat = logs.ravel()
        class_of = np.array([classes(w) for w in known], np.int64)
        log_of = np.log10(np.array(list(known.values()), float) + s.smooth)
        code = Coded(classes, {w: i for i, w in enumerate(known)})
        for b in batches:
            tokens, found, smooth, model, words, times = [], [], [], [], [], []
            for t in b.column("text"):
                ws = t.as_py().lower().split()
                ws.append(END)
                codes = np.array(list(map(code.__getitem__, ws)))
                seen = codes >= 0
                stream = -1 - codes
                stream[seen] = class_of[codes[seen]]
                rare = Counter([ws[i] for i in np.flatnonzero(~seen).tolist()])
                tokens.append(len(ws))
                found.append(int(seen.sum()))
                smooth.append(float(log_of[codes[seen]].sum()))
                model.append(float(flat[contexts(stream, s.classes)].sum(dtype=float)) - float(class_log[stream].sum()))
                words.append(list(rare))
                times.append(list(rare.values()))
            yield pa.record_batch(
                [*(b.column(c) for c in ("doc_id", "held_out")), pa.array(tokens, pa.int64()), pa.array(found, pa.int64()), pa.array(smooth, pa.float64()), pa.array(model, pa.float64()), pa.array(words, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int64()))],
                ["doc_id", "held_out", "n_tokens", "found", "smooth", "model", "words", "times"],
            )

    schema = docs.select("doc_id").schema.add("held_out", "boolean").add("n_tokens", "long").add("found", "long").add("smooth", "double").add("model", "double")
    schema = schema.add("words", T.ArrayType(T.BinaryType())).add("times", T.ArrayType(T.LongType()))
    rows = docs.select("doc_id", (fold("doc_id", s.parts) == 0).alias("held_out"), utf8().alias("text")).mapInArrow(run, schema)
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    rare = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("t"))
    looked = rare.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("t")).otherwise(0)).alias("more"),
        F.sum(F.col("t") * F.when(F.col("n").isNotNull(), F.log10(F.col("n") + s.smooth)).otherwise(floor)).alias("extra"),
    )
    done = rows.drop("words", "times").join(looked, "row", "left").withColumn("counted", F.col("smooth") + F.coalesce("extra", F.lit(0.0)))
    return done.select(
        "doc_id", "held_out", "n_tokens", (F.col("found") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("counted") - F.col("n_tokens") * base_log).alias("base_score"), (F.col("counted") + F.col("model")).alias("score"),
    )
