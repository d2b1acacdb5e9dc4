import collections
import hashlib
import random
import zlib

import pytest

from axonframe.llm import merkle, queries

from ..compare import SMALL, connect, same
from .fixtures import documents, odd_texts


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(leaves, arity):
    """All levels of a tree; a level is a list of runs."""
    found, nodes = [], leaves
    while len(nodes) > 1:
        runs = [nodes[a : a + arity] for a in range(0, len(nodes), arity)]
        found.append(runs)
        nodes = [H("".join(r)) for r in runs]
    return found, nodes[0]


def way(tree, at, arity):
    for runs in tree:
        yield at % arity, runs[at // arity]
        at //= arity


def by_hand(rows, arity):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of rows (doc_id, source, lang, n_chars, text)."""
    sources = collections.defaultdict(list)
    for r in rows:
        sources[r[1]].append(r)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        sources[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
    trees = {s: levels([leaf_of(r) for r in sources[s]], arity) for s in order}
    top, root = levels([trees[s][1] for s in order], arity)
    for k, s in enumerate(order):
        for i, r in enumerate(sources[s]):
            path = [*way(trees[s][0], i, arity), *way(top, k, arity)]
            text = r[4]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                text = text.encode().lower().decode()
            node = leaf_of((*r[:4], text))
            for j, run in path:
                node = H("".join([*run[:j], node, *run[j + 1 :]]))
            beside = "".join(d for j, run in path for i, d in enumerate(run) if i != j)
            yield r[0], leaf_of(r), trees[s][1], root, H(beside), node, node == root


def table_of(spark, rng, n, sources):
    texts = [rng.choice([None, "", "Upper Lower", "lower", "Ä ß 中", f"T{i}"]) for i in range(n)]
    return documents(spark, texts, ids=list(range(n)), sources=[rng.choices(sources, [50] + [1] * (len(sources) - 1))[0] for _ in range(n)])


@pytest.mark.parametrize(("arity", "levels_a_block", "n"), [(2, 1, 70), (3, 2, 300)])
def test_manifest_equals_a_tree_built_by_hand(spark, arity, levels_a_block, n):
    """Small runs and blocks, so that trees have several traversals; one source holds most rows."""
    docs = table_of(spark, random.Random(n), n, ["hot", None, "", "a", "é", "中", "one"])
    got = merkle.tamper_check(docs, merkle.Settings(arity, levels_a_block)).collect()
    want = by_hand([tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()], arity)
    assert sorted(map(tuple, got)) == sorted(want)


def test_proofs_fold_to_the_root_and_hold_real_siblings(spark):
    docs = table_of(spark, random.Random(3), 90, ["hot", None, "b"])
    for r in merkle.manifest(docs, s=merkle.Settings(4, 2)).collect():
        node = r.leaf
        for step in r.proof:
            node = H(step["before"] + node + step["after"])
            assert (len(step["before"]) + len(step["after"])) % 64 == 0
        assert node == r.root


def test_odd_rows_repeats_and_empty_tables(spark):
    texts = [*odd_texts(), "same", "same", "same", "x" * 3_000_000]
    ids = [*range(len(texts) - 4), 7, 7, None, None]
    docs = documents(spark, texts, ids=ids, sources=["s", None] * (len(texts) // 2) + ["s"] * (len(texts) % 2))
    got = sorted(map(repr, map(tuple, merkle.tamper_check(docs).collect())))
    assert got == sorted(map(repr, by_hand([tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()], 16)))
    clash = docs.selectExpr("*", "1 as leaf", "2 as root", "3 as tree", "4 as digest", "5 as pos", "6 as total", "7 as proof", "8 as block", "9 as now")
    assert sorted(map(repr, map(tuple, merkle.tamper_check(clash).collect()))) == got
    assert merkle.tamper_check(docs.limit(0)).count() == 0
    assert merkle.tamper_check(docs.limit(1)).select("subroot", "leaf", "root").distinct().first()[:] == (merkle.tamper_check(docs.limit(1)).first().leaf,) * 3


def test_manifest_equals_sql(spark):
    same(queries.QUERIES["op11_merkle"](spark, SMALL), queries.ORACLES["op11_merkle"], connect())
