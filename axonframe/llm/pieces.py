"""SentencePiece encoding and decoding by a table of each prefix's last token.

The encoder merges, again and again, the adjacent pair whose joined text is the piece of the best
score, leftmost first. What it makes of a prefix ends in exactly one token: of the pieces that end
there (found by one automaton over all pieces), the only one that is compatible with the last token
of the prefix before it. Two tokens are compatible if merging their joined text gives these two
again. So the table is filled from left to right in one pass, and the ids are recovered from its end
backwards. That takes time in proportion to the text, without a queue of merges.

Compatibility is tested along the seam: the tokens that touch it, each from its first character to
its whole, with the score of the merge that takes it up. Tokens whose score others share (the runs
of spaces) are tested by merging their joined text, as ties go by place.

Single characters needn't be looked for: where no longer piece is compatible, the last token is the last character.

Texts are first cut where no merge can cross, as the pieces say: before spaces (if no piece has a
space after another character), at line ends (if in no piece), and between a Latin letter and a mark
that follows a letter in no piece. Each distinct stretch is encoded once and kept in a cache of two
generations, bounded by number and by length, so by bytes; longer stretches go through the table as a whole.

Defined results: null text is empty and has no ids; its decoded text is empty. Texts of any length
are encoded whole. Characters that no piece has become their UTF-8 bytes. The special symbols'
names in a text are ordinary text. Equal rows give equal results, a null doc_id stays null, an empty
table gives an empty result. Columns other than doc_id and text are neither read nor returned.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType
from sentencepiece import SentencePieceProcessor

from axonframe.llm.text import slices

SPACE = "▁"
LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"


@dataclass(frozen=True)
class Settings:
    """``model``: a BPE model file of the sentencepiece library. ``cached``: stretches kept in a generation, of at most ``longest`` characters."""

    model: str = "piece_bpe_32k.model"
    cached: int = 200_000
    longest: int = 64


class Model:
    """Pieces of a model as tokens: texts (with plain spaces), scores, and how each is merged."""

    def __init__(self, s: Settings):
        sp = SentencePieceProcessor(model_file=public_tokenizers.path(s.model))
        if sp.normalize(" aä  B\n") != f"{SPACE * 2}aä{SPACE * 2}B\n":
            raise ValueError("the model must keep texts as they are and put one space before them")
        size = sp.vocab_size()
        self.surface = [self._surface(sp, i) for i in range(size)]
        self.is_byte = np.array([sp.is_byte(i) for i in range(size)])
        self.is_silent = np.array([sp.is_control(i) for i in range(size)])
        self.is_spaced = np.array([sp.id_to_piece(i).startswith(SPACE) and not sp.is_unknown(i) for i in range(size)])
        self.byte_id = {self.surface[i][0]: i for i in np.flatnonzero(self.is_byte).tolist()}
        normal = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.texts = [sp.id_to_piece(i).replace(SPACE, " ") for i in normal]
        self.scores = [sp.get_score(i) for i in normal]
        self.ids: list[tuple[int, ...]] = [(i,) for i in normal]
        known = {t: k for k, t in enumerate(self.texts)}
        for c in sorted({c for t in self.texts for c in t} - known.keys()):  # characters within pieces that are no piece: they merge, or end as bytes
            known[c] = len(self.texts)
            self.texts.append(c)
            self.scores.append(-math.inf)
            self.ids.append(self.bytes_of(c))
        self.known = known
        seen, twice = set(), set()
        for x in self.scores:
            (twice if x in seen else seen).add(x)
        self.tied = [x in twice for x in self.scores]
        self.parts_at_spaces = not any(" " in t.lstrip(" ") for t in self.texts)
        self.parts_at_lines = not any("\n" in t for t in self.texts)

    @staticmethod
    def _surface(sp: SentencePieceProcessor, i: int) -> bytes:
        if sp.is_byte(i):
            return bytes([int(sp.id_to_piece(i)[3:5], 16)])
        if sp.is_control(i):
            return b""
        return (" ⁇ " if sp.is_unknown(i) else sp.id_to_piece(i).replace(SPACE, " ")).encode()

    def bytes_of(self, char: str) -> tuple[int, ...]:
        return tuple(self.byte_id[b] for b in char.encode())

    def merged(self, text: str) -> tuple[list[int], tuple[int, int] | None]:
        """The tokens of a text of known characters by the rule itself, and the pair of the last merge."""
        tokens, last = [self.known[c] for c in text], None
        while len(tokens) > 1:
            best, at = -math.inf, -1
            for k in range(len(tokens) - 1):
                t = self.known.get(self.texts[tokens[k]] + self.texts[tokens[k + 1]])
                if t is not None and self.scores[t] > best:
                    best, at = self.scores[t], k
            if at < 0:
                break
            last = (tokens[at], tokens[at + 1])
            tokens[at : at + 2] = [self.known[self.texts[last[0]] + self.texts[last[1]]]]
        return tokens, last


class Encoder(dict):
    """Packed ids of stretches of text, learnt on first sight."""

    def __init__(self, s: Settings):
        super().__init__()
        self.s, self.m = s, Model(s)
        m = self.m
        self.lengths = [len(t) for t in m.texts]
        self.automaton = ahocorasick.Automaton()
        # The tokens at a token's left and right edge, from the character to the whole, each with the score of the merge that takes it up.
        self.at_left: list[tuple[tuple[int, float], ...]] = [()] * len(m.texts)
        self.at_right: list[tuple[tuple[int, float], ...]] = [()] * len(m.texts)
        for t in sorted(range(len(m.texts)), key=self.lengths.__getitem__):
            tokens, split = m.merged(m.texts[t])
            if len(tokens) > 1:
                continue  # never the result of merges
            if split is not None:
                self.automaton.add_word(m.texts[t], t)
            own = ((t, -math.inf),)
            if split is None:
                self.at_left[t] = self.at_right[t] = own
            else:
                left, right = self.at_left[split[0]], self.at_right[split[1]]
                self.at_left[t] = (*left[:-1], (split[0], m.scores[t]), *own)
                self.at_right[t] = (*right[:-1], (split[1], m.scores[t]), *own)
        self.automaton.make_automaton()
        self.joined = {(m.known[t[:k]] << 20) | m.known[t[k:]]: m.scores[m.known[t]] for t in m.texts for k in range(1, len(t)) if t[:k] in m.known and t[k:] in m.known}
        self.fits: dict[int, bool] = {}
        self.single = {t: k for k, t in enumerate(m.texts) if len(t) == 1}
        after_letters = {c for t in m.texts for c in re.findall(rf"(?s)(?<=[{LATIN}]).", t)}
        marks = "".join(re.escape(c) for c in self.single if not c.isalnum() and not c.isspace() and c not in after_letters)
        whole = rf" *[{LATIN}]+(?=[{marks}])| *[^ \n]+| +|\n" if marks else r" *[^ \n]+| +|\n"
        self.stretches = re.compile(whole if m.parts_at_spaces and m.parts_at_lines else r"(?s:.+)")
        self.older: dict[str, bytes] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the joined text of two tokens gives these two."""
        key = (a << 20) | b
        found = self.fits.get(key)
        if found is None:
            if len(self.fits) > 1_000_000:
                self.fits.clear()
            found = self.fits[key] = self.by_merging(a, b) if self.m.tied[a] or self.m.tied[b] else self.along_seam(a, b)
        return found

    def by_merging(self, a: int, b: int) -> bool:
        return self.m.merged(self.m.texts[a] + self.m.texts[b])[0] == [a, b]

    def along_seam(self, a: int, b: int) -> bool:
        """In the order of scores, the seam's tokens are taken up by merges on their own side, unless they merge with each other first."""
        lefts, rights, joined = self.at_right[a], self.at_left[b], self.joined
        i = j = 0
        while True:
            (x, x_goes), (y, y_goes) = lefts[i], rights[j]
            across = joined.get((x << 20) | y)
            if across is not None and across > x_goes and across >= y_goes:  # of equal scores the leftmost goes first
                return False
            if x_goes == y_goes == -math.inf:
                return True
            if x_goes >= y_goes:
                i += 1
            else:
                j += 1

    def table(self, text: str) -> list[int]:
        """For each prefix its last token; -1 for the empty prefix and after a character that no piece has."""
        last, lengths, fits, single, filled = [-1] * (len(text) + 1), self.lengths, self.fits, self.single, 0
        for end, t in self.automaton.iter(text):
            while filled < end:  # the prefixes before are complete
                filled += 1
                if last[filled] < 0:
                    last[filled] = single.get(text[filled - 1], -1)
            end += 1
            if last[end] < 0:
                before = last[end - lengths[t]]
                if before >= 0:
                    fit = fits.get((before << 20) | t)
                    if fit is None:
                        fit = self.compatible(before, t)
                    if not fit:
                        continue
                last[end] = t
        while filled < len(text):
            filled += 1
            if last[filled] < 0:
                last[filled] = single.get(text[filled - 1], -1)
        return last

    def recovered(self, text: str) -> list[int]:
        last, end, found = self.table(text), len(text), []
        while end:
            t = last[end]
            if t < 0:
                found.extend(reversed(self.m.bytes_of(text[end - 1])))
                end -= 1
            else:
                found.extend(reversed(self.m.ids[t]))
                end -= self.lengths[t]
        found.reverse()
        return found

    def __missing__(self, stretch: str) -> bytes:
        got = self.older.get(stretch)
        if got is None:
            got = np.array(self.recovered(stretch), "<i4").tobytes()
        if len(stretch) <= self.s.longest:
            if len(self) >= self.s.cached:
                self.older = dict(self)
                self.clear()
            self[stretch] = got
        return got

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit numbers."""
        if not text:
            return b""
        return b"".join(map(self.__getitem__, self.stretches.findall(" " + text.replace(SPACE, " "))))


class Decoder:
    """Texts of ids: surfaces put together, the space before the text taken off; bytes that are no UTF-8 become U+FFFD each."""

    def __init__(self, m: Model):
        self.m, self.surfaces = m, pa.array(m.surface, pa.binary())

    def __call__(self, ids: pa.ListArray) -> pa.Array:
        flat, starts = ids.flatten(), np.asarray(ids.offsets) - ids.offsets[0].as_py()
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), self.surfaces.take(flat)), b"")
        numbers = flat.to_numpy(zero_copy_only=False)
        texts = [self.text(t, numbers[a:z]) for t, a, z in zip(texts.to_pylist(), starts[:-1], starts[1:], strict=True)]
        return pa.array(texts, pa.string())

    def text(self, joined: bytes, ids: np.ndarray) -> str:
        silent = np.flatnonzero(self.m.is_silent[ids])
        heard = next((i for i in ids.tolist() if not self.m.is_silent[i]), None)
        if heard is not None and self.m.is_spaced[heard]:
            joined = joined[1:]
        try:
            return self.between(ids, silent) if heard is not None and len(silent) else joined.decode()
        except UnicodeDecodeError:
            return "".join(self.spelled(joined))

    def between(self, ids: np.ndarray, silent: np.ndarray) -> str:
        """Control ids part characters that are spelled in bytes."""
        parts = [b"".join(self.m.surface[i] for i in x.tolist()) for x in np.split(ids, silent)]
        first = next(k for k, x in enumerate(parts) if x)
        if self.m.is_spaced[next(i for i in ids.tolist() if not self.m.is_silent[i])]:
            parts[first] = parts[first][1:]
        return "".join(c for x in parts for c in self.spelled(x))

    @staticmethod
    def spelled(data: bytes) -> Iterator[str]:
        at = 0
        while at < len(data):
            for n in (1, 2, 3, 4):
                try:
                    char = data[at : at + n].decode()
                except UnicodeDecodeError:
                    continue
                yield char
                at += n
                break
            else:
                yield "�"
                at += 1


@functools.cache
def encoder(s: Settings) -> Encoder:
    """One for each Python worker."""
    return Encoder(s)


def encode(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, ids and decoded (the text of these ids) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(s)
        decode = Decoder(e.m)
        for b in slices(batches, 256):
            packed = [e.encode(t) for t in b.column("text").to_pylist()]
            starts = np.concatenate([[0], np.cumsum([len(x) // 4 for x in packed])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(starts), pa.array(np.frombuffer(b"".join(packed), "<i4"), pa.int32()))
            yield pa.record_batch([b.column("doc_id"), ids, decode(ids)], ["doc_id", "ids", "decoded"])

    schema = docs.select("doc_id").schema.add("ids", ArrayType(IntegerType())).add("decoded", "string")
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


def decode(rows: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id and text of rows (doc_id, ids); null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_text = Decoder(encoder(s).m)
        for b in slices(batches, 256):
            yield pa.record_batch([b.column("doc_id"), to_text(b.column("ids").cast(pa.list_(pa.int32())))], ["doc_id", "text"])

    schema = rows.select("doc_id").schema.add("text", "string")
    return rows.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).mapInArrow(run, schema)


def digests(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encode(docs, s).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
