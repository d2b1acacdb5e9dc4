import hashlib
import random
import re
import zlib

import pytest

from axonframe.llm import prefixes, queries

from ..compare import SMALL, connect, rows, same

SCHEMA = "conv_id long, turn long, role string, text string, i int, key string, words int, depth int, members int"


def conversations(spark, turns):
    return spark.createDataFrame([(*t, 1, "k", 2, 3, 4) for t in turns], SCHEMA)


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def by_hand(turns):
    """The nodes by definition: every prefix of every rebuilt conversation."""
    own = {}
    for c, turn, role, text in turns:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(x)] for c, x in own.items()}
    built = {c: (own.get(c - c % 20, [])[: zlib.crc32(str(c).encode()) % 4] + x[zlib.crc32(str(c).encode()) % 4 :]) for c, x in own.items()}
    found = {}
    for c, x in built.items():
        for d in range(len(x) + 1):
            found.setdefault(tuple(x[:d]), []).append(c)
    children = {}
    for p in found:
        if p:
            children.setdefault(p[:-1], []).append(p)
    below = {}
    for p in sorted(found, key=len, reverse=True):
        n = len(found[p])
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        mine = [below[x] for x in children.get(p, [])]
        below[p] = (sum(x[0] for x in mine) or 1, sum(x[1] for x in mine) + (n - 1) * words)
    for p, ids in found.items():
        ends = ",".join(map(str, sorted(c for c in ids if len(built[c]) == len(p))))
        yield min(ids), len(p), min(found[p[:-1]]) if p else None, len(ids), len(children.get(p, [])), *below[p], hashlib.sha256(ends.encode()).hexdigest()


def check(spark, turns, s=prefixes.Settings()):
    got = prefixes.shared_prefixes(conversations(spark, turns), s=s)
    assert rows(prefixes.NODE, [tuple(r) for r in got.select(*prefixes.NODE).collect()]) == rows(prefixes.NODE, list(by_hand(turns)))


def some(rng, n, deep):
    """Conversations of few distinct turns, so that many share prefixes, some are equal and some end where others go on."""
    turns = []
    for c in rng.sample(range(4 * n), n):
        for i in range(rng.randrange(1, deep)):
            turns.append((c, i, rng.choice(["user", "assistant", None]), rng.choice(["a b", "c", "", None]) if i > 1 else "hello you"))
    return turns


def test_small_parts_are_dealt_out_again_and_again(spark):
    """Parts of at most 6 turns, buckets of 20, slices of 3 ids and windows of 2 nodes: several rounds, chains and hashed slices."""
    check(spark, some(random.Random(5), 120, 7), prefixes.Settings(most=6, bucket=20, ids=3, chain=2))


def test_shared_long_openings_copies_and_odd_rows(spark):
    """Two very long conversations that differ at the end, one alone, copies, nulls, ties, repeated rows, no turns left."""
    long = [("user", f"t {i}") for i in range(60)]
    turns = [(c, i, r, t) for c in (20, 40, 60, 80, 100) for i, (r, t) in enumerate(long[: 60 if c < 60 else 50])]
    turns += [(40, 60, "user", "end")] + [(200, i, "user", f"alone {i}") for i in range(50)] + [(c, 0, "user", "same") for c in range(300, 340)]
    turns += [(1, None, None, None), (1, 0, "user", "x" * 100_000 + " y"), (1, 0, "user", "tie"), (1, 0, "user", "tie"), (None, 0, "user", "lost"), (2005, 0, "user", "gone"), (2001, 0, "user", "gone"), (2002, 0, "u", "Ä 中")]
    check(spark, turns, prefixes.Settings(most=20, bucket=40, ids=4, chain=7))


def test_empty_and_single(spark):
    assert prefixes.shared_prefixes(conversations(spark, [(0, 0, "", "")]).limit(0)).count() == 0
    check(spark, [(20, 0, "user", "a b c")])


@pytest.mark.parametrize("folder", [SMALL, SMALL.replace("0.001", "0.01")])
def test_trie_equals_sql(spark, folder):
    same(queries.QUERIES["op13_prefixes"](spark, folder), queries.ORACLES["op13_prefixes"], connect(folder))
