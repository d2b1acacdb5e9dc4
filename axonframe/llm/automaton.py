"""Regexes to one minimal deterministic automaton: parsing, subset construction, minimisation, arrays.

The dialect is what secret rules need: literals, escapes, classes, ``. ? * + {m,n}``, groups and
alternation, over bytes.
"""

from __future__ import annotations

import numpy as np

ALL = frozenset(range(256))


class Nfa:
    """Thompson automaton: ``eps[s]`` and ``step[s] = (bytes, target)``."""

    def __init__(self) -> None:
        self.eps: list[list[int]] = []
        self.step: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.eps.append([])
        self.step.append(None)
        return len(self.eps) - 1

    def add(self, tree: tuple, start: int) -> int:
        """Adds ``tree`` after ``start``; returns its end."""
        kind = tree[0]
        if kind == "set":
            a, b = self.state(), self.state()
            self.eps[start].append(a)
            self.step[a] = (tree[1], b)
            return b
        if kind == "cat":
            for part in tree[1]:
                start = self.add(part, start)
            return start
        if kind == "alt":
            end = self.state()
            for part in tree[1]:
                self.eps[self.add(part, start)].append(end)
            return end
        _, part, least, most = tree
        for _ in range(least):
            start = self.add(part, start)
        end = self.state()
        self.eps[start].append(end)
        if most is None:
            loop = self.state()
            self.eps[start].append(loop)
            back = self.add(part, loop)
            self.eps[back] += [loop, end]
        else:
            for _ in range(most - least):
                start = self.add(part, start)
                self.eps[start].append(end)
        return end

    def closure(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.eps[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


class Parser:
    def __init__(self, text: str, fold: bool):
        self.t, self.i, self.fold = text, 0, fold

    def bytes_of(self, codes: set[int]) -> tuple:
        if self.fold:
            codes = codes | {c ^ 32 for c in codes if chr(c).isascii() and chr(c).isalpha()}
        return ("set", frozenset(codes))

    def alternatives(self) -> tuple:
        parts = [self.sequence()]
        while self.i < len(self.t) and self.t[self.i] == "|":
            self.i += 1
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def sequence(self) -> tuple:
        parts = []
        while self.i < len(self.t) and self.t[self.i] not in "|)":
            parts.append(self.repeated(self.atom()))
        return ("cat", parts)

    def repeated(self, part: tuple) -> tuple:
        while self.i < len(self.t) and self.t[self.i] in "?*+{":
            c = self.t[self.i]
            self.i += 1
            if c == "{":
                end = self.t.index("}", self.i)
                low, _, high = self.t[self.i : end].partition(",")
                part = ("rep", part, int(low), int(low) if "," not in self.t[self.i : end] else int(high) if high else None)
                self.i = end + 1
            else:
                part = ("rep", part, int(c == "+"), 1 if c == "?" else None)
        return part

    def code(self) -> int:
        c = self.t[self.i]
        self.i += 1
        if c != "\\":
            return ord(c)
        c = self.t[self.i]
        self.i += 1
        if c == "x":
            self.i += 2
            return int(self.t[self.i - 2 : self.i], 16)
        return ord({"n": "\n", "t": "\t", "r": "\r"}.get(c, c))

    def atom(self) -> tuple:
        c = self.t[self.i]
        if c == "(":
            self.i += 1
            part = self.alternatives()
            self.i += 1
            return part
        if c == ".":
            self.i += 1
            return ("set", ALL - {10})
        if c != "[":
            return self.bytes_of({self.code()})
        self.i += 1
        negated = self.t[self.i] == "^"
        self.i += negated
        codes: set[int] = set()
        while self.t[self.i] != "]":
            low = self.code()
            if self.t[self.i] == "-" and self.t[self.i + 1] != "]":
                self.i += 1
                codes |= set(range(low, self.code() + 1))
            else:
                codes.add(low)
        self.i += 1
        return ("set", ALL - codes) if negated else self.bytes_of(codes)


def parse(pattern: str, fold: bool = False) -> tuple:
    return Parser(pattern, fold).alternatives()


def reverse(tree: tuple) -> tuple:
    if tree[0] == "set":
        return tree
    if tree[0] == "rep":
        return ("rep", reverse(tree[1]), *tree[2:])
    parts = [reverse(p) for p in tree[1]]
    return (tree[0], parts[::-1] if tree[0] == "cat" else parts)


def lead(tree: tuple) -> tuple:
    """``tree`` with a closing ``+`` taken as one: each match begins with a match of this, which ends sooner."""
    if tree[0] == "cat" and tree[1][-1][0] == "rep" and tree[1][-1][2:] == (1, None):
        return ("cat", [*tree[1][:-1], tree[1][-1][1]])
    return tree


def byte_classes(sets: set[frozenset[int]]) -> np.ndarray:
    """The class of each byte: bytes that no set tells apart share one."""
    keys: dict[tuple[bool, ...], int] = {}
    order = sorted(sets, key=sorted)
    return np.array([keys.setdefault(tuple(b in s for s in order), len(keys)) for b in range(256)])


def minimal(table: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merges states that no continuation tells apart (partition refinement).

    State 0 stays the start; states with a mark come last.
    """
    block = np.unique(marks, return_inverse=True)[1]
    while True:
        _, first, finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_index=True, return_inverse=True)
        finer = finer.ravel()
        if len(first) == block.max() + 1:
            break
        block = finer
    order = np.lexsort((first, marks[first] != 0))
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    keep = first[order]
    return rank[finer][table[keep]], marks[keep]


def compile_rules(trees: list[tuple], search: bool) -> tuple[list[int], list[int]]:
    """(transitions, marks) of one automaton for all rules.

    ``transitions[256 * state + byte]`` is 256 times the next state; ``marks[state]`` has bit k set
    if rule k matches up to here. With ``search`` a match may start anywhere.
    """
    nfa = Nfa()
    start = nfa.state()
    ends = {nfa.add(t, start): k for k, t in enumerate(trees)}
    classes = byte_classes({s[0] for s in nfa.step if s})
    sample = [int(np.argmax(classes == c)) for c in range(classes.max() + 1)]
    base = nfa.closure({start})
    known, todo, table, marks = {base: 0}, [base], [], []
    while todo:
        states = todo.pop(0)
        marks.append(sum(1 << k for k in {ends[s] for s in states if s in ends}))
        steps = [nfa.step[s] for s in states if nfa.step[s]]
        row = []
        for byte in sample:
            to = nfa.closure({t for chars, t in steps if byte in chars})
            if search:
                to |= base
            if to not in known:
                known[to] = len(known)
                todo.append(to)
            row.append(known[to])
        table.append(row)
    small, marked = minimal(np.array(table), np.array(marks, dtype=np.int64))
    return (256 * small[:, classes]).ravel().tolist(), marked.tolist()
