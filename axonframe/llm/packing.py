"""Packing by non-negative least squares on the histogram of piece lengths.

A document's tokens are cut at multiples of the window; what remains is one piece, whatever its
length, so most documents are one piece. Pieces count by their length rounded up to ``grain``, which
makes 256 lengths whatever the corpus, all of them in the equations. Shallow combinations that
fill a window (up to ``deep`` pieces, or two lengths repeated as often as fits) are enumerated,
non-negative least squares gives how often each is repeated so that the histogram is met, the counts
are rounded, and the residual is packed greedily, largest first. Padding is what rounding up costs
(some 3.5 tokens a piece) and what the last greedy sequences leave open.

Only the histogram reaches the driver. The plan says, for the j-th piece of a length, which sequence
and offset it takes; pieces are numbered within (length, salt) cells with the cells' counts summed
up, so no length is numbered in one task.

Defined results: null text is empty and has only the closing id; a special token's name in a text is that token, as the
tokenizer reads it by default; equal rows and null ids are packed
like any others, very long texts in as many pieces as windows; an empty table gives an empty result.
Columns other than doc_id and text are neither read nor returned.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from axonframe.llm.text import slices
from axonframe.plans.session import cut


@dataclass(frozen=True)
class Settings:
    """``tokenizer``: a file of the tokenizers library. ``deep``: most pieces of an enumerated combination."""

    tokenizer: str = "word_bpe_49k.json"
    end: int = 1
    window: int = 2048
    grain: int = 8
    deep: int = 4


#: Python's split() takes these as white space and the tokenizer doesn't; and special tokens begin so. Texts that have them are encoded whole.
ODD = re.compile("[\x1c-\x1f]|<\\|")


def is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


#: Lower-case Latin letters with punctuation after them: two stretches that the tokenizer never joins or parts.
PLAIN = re.compile(r"([a-zß-öø-ÿ]+)([.,;:!?*&#$%|()]*)")


class Words(dict):
    """Ids of words as bytes, learnt on first sight.

    Of plain words, letters and punctuation go to the library's merge model straight away, each
    distinct stretch once; all other words go through the whole tokenizer. Words over ``LONGEST``
    characters aren't kept, so the cache is bounded in bytes too.
    """

    LONGEST = 64

    def __init__(self, s: Settings):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(s.tokenizer))
        self.merges, self.stretches = self.tokenizer.model.tokenize, {}
        steps = self.tokenizer.pre_tokenizer
        spell = {chr(c): "".join(t for t, _ in steps.pre_tokenize_str(chr(c))) for c in [*range(97, 123), *range(0xDF, 0x100)]}
        self.spell = str.maketrans({c: t for c, t in spell.items() if t != c})
        self.packed = [np.uint32(i).tobytes() for i in range(self.tokenizer.get_vocab_size())]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def stretch(self, text: str) -> bytes:
        got = self.stretches.get(text)
        if got is None:
            packed = self.packed
            found = self.merges(text if text.isascii() else text.translate(self.spell))
            got = b"".join([packed[t.id] for t in found])
            if len(text) <= self.LONGEST:
                self.stretches[text] = got
        return got

    def __missing__(self, word: str) -> bytes:
        m = PLAIN.fullmatch(word)
        if m is None:
            got = self.whole(word)
        else:
            letters, marks = m.groups()
            got = self.stretch(letters) + self.stretch(marks) if marks else self.stretch(letters)
        if len(word) <= self.LONGEST:
            self[word] = got
        return got


class Encoder:
    """Token ids of texts. White space always parts tokens, so each word is encoded once and looked up.

    Latin letters may be lower-cased first, as the tokenizer does that itself; texts with odd white
    space are encoded whole. The caches have a bounded size.
    """

    CACHE = 250_000

    def __init__(self, s: Settings):
        self.words, self.end = Words(s), np.array([s.end], "<u4").tobytes()
        self.tokenizer = self.words.tokenizer

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text and the closing id, as little-endian 32-bit numbers."""
        words = self.words
        of = words.__getitem__
        for t in texts:
            if len(words) > self.CACHE:
                words.clear()
                words.stretches.clear()
            if ODD.search(t):
                yield words.whole(t) + self.end
            else:
                yield b"".join(map(of, (t.lower() if is_latin(t) else t).split())) + self.end


def cuts(n: int, s: Settings) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    return [(a, min(s.window, n - a)) for a in range(0, n, s.window)]


def pieces(docs: DataFrame, s: Settings) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(s)
        for b in slices(batches):
            row, start, length, crc, total = [], [], [], [], []
            for k, ids in enumerate(encoder(b.column("text").to_pylist())):
                for a, n in cuts(len(ids) // 4, s):
                    row.append(k)
                    start.append(a)
                    length.append(n)
                    crc.append(zlib.crc32(ids[4 * a : 4 * (a + n)]))
                    total.append(len(ids) // 4)
            yield pa.record_batch([b.column("doc_id").take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    schema = docs.select("doc_id").schema
    for name in names[1:]:
        schema = schema.add(name, "long")
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


def combinations(lengths: list[int], window: int, deep: int) -> list[tuple[int, ...]]:
    """Multisets of at most ``deep`` lengths with exactly the sum ``window``; and two lengths, each repeated so often that they fill it."""
    have = set(lengths)

    @functools.cache
    def filling(left: int, most: int, parts: int) -> list[tuple[int, ...]]:
        if left == 0:
            return [()]
        if parts == 1:
            return [(left,)] if left <= most and left in have else []
        return [(x, *rest) for x in lengths if x <= min(left, most) and x * parts >= left for rest in filling(left - x, x, parts - 1)]

    found = set(filling(window, window, deep))
    for x in lengths:
        for times in range(1, window // x + 1):
            left = window - times * x
            if left == 0:
                found.add((x,) * times)
            for more in range(1, left // x + 1):
                y, rest = divmod(left, more)
                if rest == 0 and y > x and y in have:
                    found.add((y,) * more + (x,) * times)
                elif y <= x:
                    break
    return sorted(found)


def nnls(index: np.ndarray, count: np.ndarray, b: np.ndarray, near: float = 0.0) -> np.ndarray:
    """min |a x - b| with x >= 0, by the active set method of Lawson and Hanson; column j of a has ``count[j]`` in the rows ``index[j]``.

    Ends early where the sum of |a x - b| is at most ``near``.
    """

    def dense(columns: np.ndarray) -> np.ndarray:
        a = np.zeros((len(b), len(columns)))
        np.add.at(a, (index[columns].ravel(), np.repeat(np.arange(len(columns)), index.shape[1])), count[columns].ravel())
        return a

    x, left = np.zeros(len(index)), b.astype(float)
    active = np.zeros(len(index), bool)
    for _ in range(2 * len(b)):
        w = (left[index] * count).sum(1)
        w[active] = -np.inf
        least, used = max(1e-9 * max(1.0, np.abs(b).max()), 0.5 * w.max()), np.zeros(len(b), bool)
        if w.max() < least or np.abs(left).sum() <= near:
            break
        top = np.flatnonzero(w >= least)
        for j in top[np.argsort(-w[top], kind="stable")[: len(b)]]:  # columns without a row in common come in together
            if not used[index[j]].any():
                active[j] = True
                used[index[j]] = True
        while True:
            cols = np.flatnonzero(active)
            a = dense(cols)
            z = np.linalg.solve(a.T @ a + 1e-9 * np.eye(len(cols)), a.T @ b)
            if (z > 1e-12).all():
                x[:] = 0
                x[cols] = z
                break
            low = z <= 1e-12
            now = x[cols]
            step = np.min(now[low] / np.maximum(now[low] - z[low], 1e-300))
            now = now + step * (z - now)
            x[:] = 0
            x[cols] = np.where(now > 1e-12, now, 0)
            active = x > 0
            if not active.any():
                return x
        cols = np.flatnonzero(active)
        left = b - dense(cols) @ x[cols]
    return x


def solved(histogram: dict[int, int], s: Settings) -> list[tuple[tuple[int, ...], float]]:
    """(combination, repeats) that come nearest to the histogram."""
    lengths = sorted((x for x, n in histogram.items() if n > 0), reverse=True)
    combos = combinations(lengths, s.window, s.deep) if lengths else []
    if not combos:
        return []
    place = {x: i for i, x in enumerate(lengths)}
    index, count = np.zeros((len(combos), s.deep), np.int32), np.zeros((len(combos), s.deep))
    for j, c in enumerate(combos):
        for k, x in enumerate(dict.fromkeys(c)):
            index[j, k], count[j, k] = place[x], c.count(x)
    times = nnls(index, count, np.array([histogram[x] for x in lengths], float), 0.005 * sum(histogram[x] for x in lengths))  # rounding costs more
    return [(combos[j], float(times[j])) for j in np.flatnonzero(times)]


def plan(histogram: dict[int, int], s: Settings) -> tuple[list[tuple[tuple[int, ...], int]], int]:
    """(lengths of a sequence, repeats) that use every piece of the histogram exactly once; and how many of these steps the equations gave."""
    left = dict(histogram)
    found: list[tuple[tuple[int, ...], int]] = []

    def take(combo: tuple[int, ...], times: int) -> None:
        need = {x: combo.count(x) for x in combo}
        times = min(times, *(left[x] // n for x, n in need.items()))
        if times > 0:
            found.append((combo, times))
            for x, n in need.items():
                left[x] -= n * times

    if left.get(s.window):
        take((s.window,), left[s.window])
    steps = solved(left, s)
    for combo, times in sorted(steps, key=lambda x: (-x[1], x[0])):
        take(combo, int(times + 1e-9))
    for combo, _ in sorted(steps, key=lambda x: (-(x[1] % 1), x[0])):
        take(combo, 1)
    by_equations = len(found)
    while any(left.values()):
        combo, room = [], s.window
        for x in sorted(left, reverse=True):
            n = min(left[x], room // x)
            combo += [x] * n
            room -= n * x
        take(tuple(combo), max(left.values()))
    return found, by_equations


def slots(steps: list[tuple[tuple[int, ...], int]]) -> dict[int, list[np.ndarray]]:
    """For each length: first rank, first sequence, pieces a sequence and first offset of every step that uses it, by rank."""
    rank: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for combo, times in steps:
        offset = 0
        for x in dict.fromkeys(combo):
            n = combo.count(x)
            rows.setdefault(x, []).append((rank.get(x, 0), sequence, n, offset))
            rank[x] = rank.get(x, 0) + n * times
            offset += n * x
        sequence += times
    return {x: [np.array(c, np.int64) for c in zip(*r, strict=True)] for x, r in rows.items()}


def pack(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece."""
    s = settings
    rows = cut(pieces(docs, s).withColumn("kind", F.ceil(F.col("length") / s.grain) * s.grain))
    counted = rows.groupBy("kind").count().collect()
    table = slots(plan({r["kind"]: r["count"] for r in counted}, s)[0])
    n = 32 * max(1, round((sum(r["count"] for r in counted) / 1e6) ** 0.5))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(n)).cast("int"))
    cells = salted.groupBy("kind", "salt").agg(F.count("*").alias("n"))
    before = W.partitionBy("kind").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    based = cells.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    ranked = salted.withColumn("i", F.row_number().over(W.partitionBy("kind", "salt").orderBy("doc_id", "start", "ids_crc32"))).join(based, ["kind", "salt"])
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind, j = b.column("kind").to_numpy(), b.column("rank").to_numpy()
            sequence, place = np.zeros(len(j), np.int64), np.zeros(len(j), np.int64)
            for x in np.unique(kind):
                of = kind == x
                first, begins, each, start = table[int(x)]
                k = np.searchsorted(first, j[of], side="right") - 1
                within = j[of] - first[k]
                sequence[of] = begins[k] + within // each[k]
                place[of] = start[k] + within % each[k] * x
            yield pa.record_batch([*(b.column(c) for c in names), pa.array(sequence), pa.array(place)], [*names, "sequence_id", "place"])

    schema = rows.select(*names).schema.add("sequence_id", "long").add("place", "long")
    placed = ranked.select(*names, "kind", (F.col("base") + F.col("i") - 1).alias("rank")).mapInArrow(run, schema)
    ahead = W.partitionBy("sequence_id").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    return placed.select(*names, "sequence_id", F.coalesce(F.sum("length").over(ahead), F.lit(0)).alias("offset"))
