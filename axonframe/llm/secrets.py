"""Secret scans by one deterministic automaton compiled from all rules.

Every text is read once, byte by byte, through the transition array of the combined minimal
automaton, which reports where the least form of a rule has just matched. Only around such places a rule's own
automata find the leftmost start (backwards) and the longest end. Matches of a kind don't overlap;
those shorter than their rule asks are dropped after they have taken their place, as a regex search
followed by a filter does.

Spans count code points. Null text is empty; texts of any length are read whole. Columns other than
doc_id and text are neither read nor returned by ``scan``; ``redact`` keeps all columns, whatever their names.
Rows are read one by one, so repeated rows give repeated results and an empty table none. Spans of two
kinds that begin at one place are given in the order of the kinds; where they overlap ``redact`` writes
the mark of the first and leaves out the rest.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axonframe.llm.automaton import compile_rules, lead, parse, reverse
from axonframe.llm.text import utf8


@dataclass(frozen=True)
class Rule:
    """``least`` characters in the match or, with ``group``, in what follows its separator."""

    kind: str
    pattern: str
    least: int = 0
    fold: bool = False
    group: bool = False


#: The base kinds come first, in the order in which they are listed.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=\-]+""", 6, True, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{8,}", 24),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9\-]+", 20),
    Rule("google", r"AIza[A-Za-z0-9_\-]+", 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+", 40),
    Rule("pem", r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"),
)
BASE = 3


class Automaton:
    """Anchored at its first byte, or searching; ``dead`` is the state without a way on."""

    def __init__(self, trees: list[tuple], search: bool):
        self.table, self.marks = compile_rules(trees, search)
        n = len(self.marks)
        self.first_marked = 256 * next((s for s in range(n) if self.marks[s]), n)
        self.dead = next((256 * s for s in range(n) if not self.marks[s] and set(self.table[256 * s : 256 * s + 256]) == {256 * s}), -1)

    def longest(self, data: Iterator[int]) -> int:
        """The length of the longest prefix of ``data`` that matches, -1 if none does."""
        table, marked, dead, state, best = self.table, self.first_marked, self.dead, 0, -1
        for i, b in enumerate(data):
            state = table[state + b]
            if state == dead:
                break
            if state >= marked:
                best = i + 1
        return best

    def first(self, data: bytes, start: int, stop: int) -> int:
        """The first position up to ``stop`` where a match that starts at ``start`` or later ends; -1 if there is none."""
        table, marked, state = self.table, self.first_marked, 0
        for i in range(start, stop):
            state = table[state + data[i]]
            if state >= marked:
                return i + 1
        return -1

    def runs(self, data: bytes) -> list[list[int]]:
        """[first, last, rules]: stretches of positions up to which the same rules match. The one pass over a text."""
        table, marks, marked, state, found = self.table, self.marks, self.first_marked, 0, []
        for i, b in enumerate(data):
            state = table[state + b]
            if state >= marked:
                mask = marks[state >> 8]
                if found and found[-1][1] == i and found[-1][2] == mask:
                    found[-1][1] = i + 1
                else:
                    found.append([i + 1, i + 1, mask])
        return found


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        trees = [parse(r.pattern, r.fold) for r in rules]
        self.rules = rules
        leads = [lead(t) for t in trees]
        self.all = Automaton(leads, search=True)
        self.search = [Automaton([t], search=True) for t in leads]
        self.forward = [Automaton([t], search=False) for t in trees]
        self.back = [Automaton([reverse(t)], search=False) for t in leads]

    def spans(self, data: bytes) -> list[tuple[str, int, int]]:
        """(kind, start, end) in bytes, by start and then by the order of the rules."""
        end, found = [0] * len(self.rules), []
        for first, last, mask in self.all.runs(data):
            for k, rule in enumerate(self.rules):
                while mask >> k & 1 and last > end[k]:
                    back = self.back[k].longest(data[j] for j in range(first - 1, end[k] - 1, -1)) if first > end[k] else -1
                    at = first
                    if back < 0:  # that match began inside the one before: look for the next that doesn't
                        at = self.search[k].first(data, end[k], last)
                        if at < 0:
                            break
                        back = self.back[k].longest(data[j] for j in range(at - 1, end[k] - 1, -1))
                    start = at - back
                    end[k] = start + self.forward[k].longest(data[j] for j in range(start, len(data)))
                    taken = data[start : end[k]]
                    if (self.value(taken) if rule.group else len(taken)) >= rule.least:
                        found.append((start, k, end[k]))
        return [(self.rules[k].kind, a, b) for a, k, b in sorted(found)]

    @staticmethod
    def value(taken: bytes) -> int:
        """Length of the last group: what follows the first separator, spaces and one quote."""
        rest = taken[re.search(rb"[:=]", taken).end() :].lstrip(b" ")
        return len(rest[1:] if rest[:1] in (b'"', b"'") else rest)


@functools.cache
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def code_points(data: bytes, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    if not spans or data.isascii():
        return spans
    places = sorted({x for _, a, b in spans for x in (a, b)})
    at, before, points = 0, 0, {}
    for p in places:
        before += len(data[at:p].decode("utf-8", "replace"))
        at, points[p] = p, before
    return [(k, points[a], points[b]) for k, a, b in spans]


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, counts of the base kinds, the digest of the base spans and all spans of every document."""
    kinds = [r.kind for r in rules[:BASE]]
    ready = scanner(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, digests, all_spans = [[] for _ in kinds], [], []
            for t in b.column("text"):
                data = t.as_py()
                spans = code_points(data, ready.spans(data))
                base = [s for s in spans if s[0] in kinds]
                for k, kind in enumerate(kinds):
                    counts[k].append(sum(s[0] == kind for s in base))
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                all_spans.append(written(spans))
            yield pa.record_batch([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(all_spans, pa.string())], names)

    names = ["doc_id", *(f"n_{k}" for k in kinds), "base_sha256", "spans"]
    schema = docs.select("doc_id").schema
    for k in kinds:
        schema = schema.add(f"n_{k}", "long")
    return docs.select("doc_id", utf8().alias("text")).mapInArrow(run, schema.add("base_sha256", "string").add("spans", "string"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[{}]") -> DataFrame:
    """``docs`` with every found span of the text replaced by its kind; n_chars, if there, follows. Null texts stay null."""
    ready, names = scanner(rules), docs.columns
    place = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for t in b.column(place):
                data = None if t.as_py() is None else t.as_py().encode()
                at, parts = 0, []
                for kind, start, end in ready.spans(data) if data else ():
                    if start >= at:
                        parts += [data[at:start], mark.format(kind).encode()]
                    at = max(at, end)
                texts.append(None if data is None else b"".join([*parts, data[at:]]).decode() if parts else t.as_py())
            yield pa.record_batch([*b.columns[:place], pa.array(texts, pa.string()), *b.columns[place + 1 :]], names)

    done = docs.mapInArrow(run, docs.schema)
    return done.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else done
