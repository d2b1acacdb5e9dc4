import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from axonframe.llm import caps, components, minhash, partitions, queries

from .fixtures import documents, odd_texts, prose, run_sql


def brute_minhash(texts, k):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in range(len(texts))}


def families(seed):
    """Copies of one text with a few words changed, around the threshold, some only linked through others."""
    rng = random.Random(seed)
    texts = []
    for _ in range(3):
        base = prose(rng, 100).split()
        for edits in (0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12):
            w = [*base]
            for p in rng.sample(range(len(w)), edits):
                w[p] = f"n{rng.randrange(30)}"
            texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize("words", [2, 5])
def test_minhash_equals_brute_force(spark, words):
    texts = [*odd_texts(), *families(3)]
    docs = documents(spark, texts)
    got = minhash.near_duplicates(docs, minhash.Settings(words=words, outer=4, inner=6, fan=3)).collect()
    want = brute_minhash(texts, words)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(texts)


def test_minhash_sql_and_odd_ids(spark):
    texts = odd_texts()
    docs = documents(spark, texts)
    got = minhash.near_duplicates(docs, minhash.Settings(words=2)).collect()
    want = run_sql(queries.OP4_SQL, documents=docs.select("doc_id", "text").toPandas())
    assert sorted(tuple(r) for r in got) == sorted(want)
    repeated = documents(spark, ["a b c d e f"] * 3 + [None], ids=[5, 5, None, None])
    rows = minhash.near_duplicates(repeated).collect()
    assert [r.component_id for r in rows if r.doc_id == 5] == [5, 5] and all(r.kept for r in rows)
    kept = minhash.without_near_duplicates(repeated)
    assert kept.columns == repeated.columns and sorted((r.doc_id is None) for r in kept.collect()) == [False, True, True]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


@settings(max_examples=20, deadline=None)
@given(st.lists(st.sets(st.integers(0, 40), min_size=1), min_size=2, max_size=8))
def test_overlaps(sets):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    got = minhash.overlaps(arrays, 1)
    assert got[0].tolist() == [len(sets[0] & s) for s in sets[1:]]


def test_components(spark):
    rng = random.Random(0)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)] + [(7, 7)]
    got = {r.id: r.component for r in components.connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    label = {x: x for p in pairs for x in p}
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert {k: got.get(k, k) for k in label} == label


def vectors(spark, n=260, dim=16, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x[40:80] = x[0] + 0.12 * rng.normal(size=(40, dim))
    x[80:90] = x[1]
    rows = [(i, [float(c) for c in v], int(i % 2), 1.0) for i, v in enumerate(x)]
    odd = [None, [0.0] * dim, [None] * dim, [float("nan")] * dim, [float("inf")] * dim]
    rows += [(1000 + k, v, 0, 1.0) for k, v in enumerate(odd)] + [(2000, rows[0][1], None, 1.0), rows[3]]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, score double")


def test_caps_equal_brute_force(spark):
    df = vectors(spark)
    got = caps.near_duplicates(df, caps.Settings(tile=8)).toPandas()
    v = {r.vec_id: (np.array(r.embedding), r.label) for r in df.filter("vec_id < 1000").collect()}
    unit = {i: x / np.linalg.norm(x) for i, (x, _) in v.items()}
    near = {i: {j for j in v if j != i and v[i][1] == v[j][1] and unit[i] @ unit[j] >= 0.93} for i in v}
    label = {i: i for i in v}
    for _ in range(len(v)):
        new = {i: min([label[i], *(label[j] for j in near[i])]) for i in v}
        if new == label:
            break
        label = new
    assert len(got) == df.count()
    for r in got.itertuples():
        assert r.n_links == len(near.get(r.vec_id, ())) and r.component_id == label.get(r.vec_id, r.vec_id) and r.kept == (r.vec_id == r.component_id)
    assert caps.near_duplicates(df.limit(0)).count() == 0


def test_caps_count_copies(spark):
    """Copies of two near vectors and of one far from both, in two labels: all links count, whatever the size of a group."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=16)
    kinds = [base, base + 0.05 * rng.normal(size=16), rng.normal(size=16)]
    rows = [(900 - i, [float(c) for c in kinds[i % 3]], i % 2) for i in range(300)] + [(901, [float(c) for c in kinds[0]], None)]
    got = caps.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), caps.Settings(tile=8)).collect()
    want = {i: (49 if i % 3 == 2 else 99, min(900 - j for j in range(300) if j % 2 == i % 2 and (j % 3 == 2) == (i % 3 == 2))) for i in range(300)}
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {900 - i: x for i, x in want.items()} | {901: (0, 901)}
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def pairs_at(n, dim, low, high, seed=9):
    """Pairs of unit vectors with cosines from ``low`` to ``high``."""
    rng = np.random.default_rng(seed)
    x, z = rng.normal(size=(2, n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    c = np.linspace(low, high, n)[:, None]
    return x, c * x + np.sqrt(1 - c**2) * z / np.linalg.norm(z, axis=1, keepdims=True)


@pytest.mark.parametrize("dim, rows", [(16, 10**6), (64, 10**3), (64, 10**5), (64, 10**6), (64, 10**8), (64, 10**9), (128, 10**8)])
def test_caps_recall_at_the_limit_is_the_same_at_any_size(dim, rows):
    """At cosine 0.93, by the code that a table of 1e3 to 1e9 vectors that may meet gets; lists are as long as set, not filled up."""
    s = caps.Settings(trials=1000)
    b, codes = caps.fitted(dim, caps.sub_directions(rows, s), s)
    x, y = pairs_at(400, dim, 0.93, 0.93)
    left, right = [set() for _ in x], [set() for _ in x]
    for k in range(codes):
        code = caps.Code(dim, b, s, k)
        for found, v in ((left, x), (right, y)):
            for fs, more in zip(found, code.decode(v), strict=True):
                fs.update(more)
    assert sum(p.isdisjoint(q) for p, q in zip(left, right, strict=True)) <= 1
    assert dim < 64 or 0.7 * s.lists <= np.mean([len(p) for p in left]) / codes <= 1.4 * s.lists


def test_caps_find_planted_links_in_dimension_64(spark):
    """Links at cosine 0.93 to 0.95 among random vectors, and components beyond what squares can hold."""
    x, y = pairs_at(300, 64, 0.9301, 0.95)
    noise = np.random.default_rng(3).normal(size=(2000, 64))
    huge = [noise[0] * 1e200, noise[0] * 2e-200]
    rows = [(i, v.tolist(), 1) for i, v in enumerate([*x, *y, *noise, *huge])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(8)
    got = {r.vec_id: (r.n_links, r.component_id) for r in caps.near_duplicates(df).collect()}
    assert all(got[i] == (1, i) and got[300 + i] == (1, i) for i in range(300))
    assert all(got[k] == (2, 600) for k in (600, 2600, 2601)) and sum(n for n, _ in got.values()) == 606


def test_partitions_recall_ties_and_odd_rows(spark):
    df = vectors(spark, 900)
    got = partitions.nearest_neighbours(df, "vec_id % 10 = 0", partitions.Settings(block=64, slice=16)).toPandas()
    v = {r.vec_id: np.array(r.embedding) for r in df.filter("vec_id < 1000 OR vec_id = 2000").collect()}
    hits = 0
    asked = [i for i in v if i % 10 == 0]
    for i in asked:
        d = sorted((float(np.sqrt(((v[j] - v[i]) ** 2).sum())), j) for j in v if j != i)[:10]
        mine = got[got.query_id == i].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 11)) and mine.score.is_monotonic_increasing
        assert all(abs(s - np.sqrt(((v[j] - v[i]) ** 2).sum())) < 1e-12 for s, j in zip(mine.score, mine.vec_id, strict=True))
        hits += len(set(mine.vec_id) & {j for _, j in d})
    assert hits / (10 * len(asked)) >= 0.9 and set(got.query_id) == set(asked)
    few = partitions.nearest_neighbours(df.filter("vec_id IN (0, 1, 2)"), "vec_id = 0").collect()
    assert len(few) == 2 and partitions.nearest_neighbours(df.limit(0)).count() == 0


def clustered(n, dim, clusters, seed=6):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(clusters, dim))[rng.integers(0, clusters, n)] + 0.25 * rng.normal(size=(n, dim))


@pytest.mark.parametrize("broadcast", [16_000_000, 0])
def test_partitions_grow_and_clustered_queries_visit_few(spark, broadcast):
    """Two levels of learned parts, whether fitted nodes are broadcast or meet the rows by block."""
    x = clustered(6000, 24, 60)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(8)
    s = partitions.Settings(leaf=128, parts=8, sample=1500, steps=250, block=64, slice=16, batch=700, broadcast_bytes=broadcast)
    index, asked = partitions.indexed(partitions.valid_vectors(df), "vec_id % 20 = 0", s)
    sizes = {r["node"]: r["count"] for r in index.groupBy("node").count().collect()}
    assert sum(sizes.values()) == 6000 and len(sizes) >= 30 and max(n.count("/") for n in sizes) == 2
    pairs = sum(sizes.get(r["node"], 0) for r in asked.collect())
    assert pairs <= 0.2 * 300 * 6000
    got = partitions.nearest_neighbours(df, "vec_id % 20 = 0", s).toPandas()
    near = {q: set(np.argsort(((x - x[q]) ** 2).sum(1) + (np.arange(len(x)) == q) * 1e9, kind="stable")[:10]) for q in range(0, 6000, 20)}
    assert len(got) == 3000 and sum(len(set(g.vec_id) & near[q]) for q, g in got.groupby("query_id")) >= 0.9 * 3000


def test_partitions_serve_every_dimension_and_size_of_component(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8 if i % 3 else 5).tolist()) for i in range(300)] + [(1000 + k, (rng.normal(size=8) * 1e200).tolist()) for k in range(12)] + [(2000 + k, [1e-190 * (k + 1)] * 3) for k in range(4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = partitions.nearest_neighbours(df, "vec_id % 10 = 0").toPandas()
    v = {i: np.array(x) for i, x in rows}
    for q in (i for i in v if i % 10 == 0):
        d = sorted((float(np.abs(v[j] - v[q]).max() * np.sqrt((((v[j] - v[q]) / np.abs(v[j] - v[q]).max()) ** 2).sum())), j) for j in v if j != q and len(v[j]) == len(v[q]))[:10]
        mine = got[got.query_id == q].sort_values("rank")
        assert mine.vec_id.tolist() == [j for _, j in d] and np.allclose(mine.score, [a for a, _ in d], rtol=1e-9, atol=0)


def test_partitions_look_further_where_leaves_are_short(spark):
    """Copies of two vectors: a leaf with less than k rows is no excuse."""
    rows = [(i, [0.0, 1.0] if i < 3 else [float(i % 7 - 3), 5.0]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = partitions.nearest_neighbours(df, "vec_id % 100 = 0", partitions.Settings(leaf=16, parts=16, sample=400, steps=100)).toPandas()
    assert len(got) == 40 and (got.groupby("query_id")["rank"].max() == 10).all()


def compared_share(index, asked):
    """Pairs that the visited leaves hold, as a share of brute force; and leaves visited by a query."""
    sizes = {r.node: r["count"] for r in index.groupBy("node").count().collect()}
    visits = asked.collect()
    queries_, rows = len({r.vec_id for r in visits}), sum(sizes.values())
    return sum(sizes.get(r.node, 0) for r in visits) / (queries_ * rows), len(visits) / queries_, len(sizes)


def test_partitions_are_used_on_the_given_table(spark):
    """2,000 nearly uniform vectors: several leaves, some not visited, recall as promised. Columns named like the operator's own change nothing."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    x = {r.vec_id: np.array(r.embedding, float) for r in df.collect()}
    ids, m = np.array(list(x)), np.stack(list(x.values()))
    share, visits, leaves = compared_share(*partitions.indexed(partitions.valid_vectors(df), "vec_id % 100 = 0", partitions.Settings()))
    assert leaves >= 8 and visits < leaves and share < 0.95
    got = partitions.nearest_neighbours(df.selectExpr("*", "1 as node", "2 as v", "3 as count", "4 as block", "5 as rank")).toPandas()
    hits = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((m - x[q]) ** 2).sum(1))
        d[ids == q] = np.inf
        hits += len(set(ids[np.lexsort((ids, d))[:10]]) & set(got[got.query_id == q].vec_id))
    assert hits >= 0.95 * 10 * (ids % 100 == 0).sum()
    assert partitions.nearest_neighbours(df.limit(0)).count() == 0


def test_partitions_prune_clustered_vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    m = centres[rng.integers(0, 40, 4000)] + 0.1 * rng.normal(size=(4000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>").repartition(4)
    share, visits, leaves = compared_share(*partitions.indexed(partitions.valid_vectors(df), "vec_id % 100 = 0", partitions.Settings()))
    assert leaves >= 8 and share < 0.25 and visits < leaves / 2
