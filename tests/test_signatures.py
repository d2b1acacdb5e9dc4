import itertools

import numpy as np
import pytest

from axonframe.operators import signatures


def direct(x):
    """Iterated integrals of a piecewise linear path, each by its own sum over ordered pieces, and their logarithm by word."""
    d = np.diff(x, axis=0)
    n, c = d.shape
    s1 = d.sum(0)
    s2 = sum(np.outer(d[a], d[b]) for a in range(n) for b in range(a + 1, n)) + sum(np.outer(d[a], d[a]) for a in range(n)) / 2
    s3 = np.zeros((c, c, c))
    for a, b, e in itertools.combinations_with_replacement(range(n), 3):
        s3 += np.einsum("i,j,k->ijk", d[a], d[b], d[e]) / (6 if a == b == e else 2 if a == b or b == e else 1)
    l2 = s2 - np.outer(s1, s1) / 2
    l3 = s3 - (np.einsum("i,jk->ijk", s1, s2) + np.einsum("ij,k->ijk", s2, s1)) / 2 + np.einsum("i,j,k->ijk", s1, s1, s1) / 3
    return {"".join(map(str, w)): (s1, l2, l3)[len(w) - 1][w] for w in signatures.words(c)}


@pytest.fixture(scope="module")
def paths(spark):
    rng = np.random.default_rng(1)
    x = {sid: rng.normal(size=(n, 3)).cumsum(0) for sid, n in ((1, 25), (2, 8), (3, 1), (4, 2))}
    rows = [(sid, t + 1, *map(float, p[t])) for sid, p in x.items() for t in range(len(p))]
    return x, spark.createDataFrame(rows, "sid long, t long, a double, b double, c double")


@pytest.mark.parametrize("stretch", [1, 4, 1000])
def test_log_signature_of_any_cut_equals_ordered_sums(paths, stretch):
    x, df = paths
    got = {}
    for r in signatures.log_signatures(df, ["a", "b", "c"], stretch).collect():
        got.setdefault(r.sid, {})[r.word] = r.v
    assert set(got) == {1, 2, 4}
    for sid, found in got.items():
        want = direct(x[sid])
        assert set(found) == set(want) and all(abs(found[w] - want[w]) < 1e-8 for w in want)


def test_windows_are_the_signatures_of_their_samples(paths):
    x, df = paths
    got = {(r.sid, r.win, r.word): r.v for r in signatures.windowed(df, ["a", "b", "c"], 8, 5).collect()}
    want = {(sid, k, w): v for sid, p in x.items() for k in range(30) if k * 5 + 8 <= len(p) for w, v in direct(p[k * 5 : k * 5 + 8]).items()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-8 for k in want)


def test_words_are_as_many_as_witts_formula_says():
    assert [len(signatures.words(c)) for c in (1, 2, 3, 4)] == [1, 5, 14, 30]
