import numpy as np
import pytest

from axonframe.operators import classifiers, components, designs


def optimum(x, y, penalty):
    """Newton's method on the whole matrix, with halved steps."""
    z = np.column_stack([x, np.ones(len(x))])
    w = np.r_[np.full(x.shape[1], penalty), 0.0]
    f = lambda b: np.logaddexp(0, z @ b).sum() - y @ (z @ b) + 0.5 * w @ b**2
    b = np.zeros(z.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-(z @ b)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(w), z.T @ (p - y) + w * b)
        while f(b - step) > f(b) + 1e-12:
            step = step / 2
            if np.abs(step).max() < 1e-14:
                return b
        b = b - step
    return b


def trials_of(spark, seed, n=150, p=4, scale=1.5):
    rng = np.random.default_rng(seed)
    label = rng.integers(0, 3, n)
    x = rng.normal(size=(n, p)) + scale * np.eye(3, p)[label]
    run = rng.integers(1, 4, n)
    df = spark.createDataFrame([(int(r), int(c), [float(a) for a in v]) for r, c, v in zip(run, label, x, strict=True)], "run long, label long, x array<double>")
    return run, label, x, df.repartition(5)


@pytest.mark.parametrize("scale, penalty", [(1.5, 1.0), (8.0, 0.01)])
def test_all_folds_and_pairs_reach_the_optimum(spark, scale, penalty):
    run, label, x, df = trials_of(spark, 1, scale=scale)
    models = classifiers.fitted(df, penalty)
    assert set(models) == {(a, b, f) for a, b in ((0, 1), (0, 2), (1, 2)) for f in (-1, 1, 2, 3)}
    for (a, b, fold), beta in models.items():
        at = np.isin(label, [a, b]) & (run != fold)
        want = optimum(x[at], (label[at] == a) * 1.0, penalty)
        assert np.allclose(beta, want, atol=1e-4 * max(1, np.abs(want).max()))


def test_held_out_accuracy_is_that_of_left_out_runs(spark):
    run, label, x, df = trials_of(spark, 2)
    models = classifiers.fitted(df)
    got = {(r.a, r.b): r for r in classifiers.held_out(df, models).collect()}
    for (a, b), r in got.items():
        shares = []
        for fold in (1, 2, 3):
            at = np.isin(label, [a, b]) & (run == fold)
            shares.append(np.mean((np.column_stack([x[at], np.ones(at.sum())]) @ models[a, b, fold] > 0) == (label[at] == a)))
        assert r.runs == 3 and r.n == np.isin(label, [a, b]).sum() and abs(r.accuracy - np.mean(shares)) < 1e-12
    assert all(r.accuracy > 0.7 for r in got.values())


def test_odd_trials_and_classes_of_one_run(spark):
    rows = [(1, 0, [0.0, 1.0]), (2, 0, [0.5, 1.0]), (1, 1, [2.0, 0.0]), (2, 1, [2.5, 0.1]), (2, 2, [9.0, 9.0]), (None, 0, [1.0, 1.0]), (1, None, [1.0, 1.0]), (1, 0, None), (1, 0, [float("nan"), 1.0])]
    df = spark.createDataFrame(rows, "run long, label long, x array<double>")
    got = {(r.a, r.b): r.runs for r in classifiers.held_out(df, classifiers.fitted(df)).collect()}
    assert got == {(0, 1): 2, (0, 2): 1, (1, 2): 1}  # class 2 is in run 2 alone, so leaving that out leaves no classifier
    assert classifiers.fitted(df.limit(0)) == {}
    with pytest.raises(ValueError):
        classifiers.fitted(df, most_bytes=10)


def test_block_information_of_independent_and_shared_blocks():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 7))
    x[:, 2] += x[:, 0]
    found = {(i, j): v for i, j, v in components.block_information(np.cov(x.T), 2)}
    assert set(found) == {(0, 1), (0, 2), (1, 2)} and found[0, 1] > 0.3 and abs(found[0, 2]) < 0.01 and abs(found[1, 2]) < 0.01
    q = np.linalg.inv(np.cov(x.T))
    det = np.linalg.det
    assert abs(found[0, 1] - 0.5 * np.log(det(q[:2, :2]) * det(q[2:4, 2:4]) / det(q[:4, :4]))) < 1e-3


def test_largest_t_under_orders_of_the_design(spark):
    rng = np.random.default_rng(4)
    n, x = 40, rng.normal(size=40)
    y = {s: rng.normal(size=n) + (2 * x if s == 0 else 0) for s in range(4)}
    rows = spark.createDataFrame([(s, t, float(y[s][t])) for s in y for t in range(n)], "sid long, t long, y double")
    design = spark.createDataFrame([(t, 1.0, float(x[t])) for t in range(n)], "t long, one double, x double")
    got = {r.perm: r.t for r in designs.permutation_max_t(rows, design, ["one", "x"], [0, 1], 60).collect()}

    def largest(order):
        z = np.column_stack([np.ones(n), x[order]])
        out = []
        for s in y:
            b, v = np.linalg.lstsq(z, y[s], rcond=None)[0], np.linalg.inv(z.T @ z)
            out.append(abs(b[1]) / np.sqrt(((y[s] - z @ b) ** 2).sum() / (n - 2) * v[1, 1]))
        return max(out)

    assert set(got) == set(range(61)) and abs(got[0] - largest(np.arange(n))) < 1e-9
    null = np.array([got[k] for k in range(1, 61)])
    by_hand = np.array([largest(rng.permutation(n)) for _ in range(300)])
    assert got[0] > null.max() and abs(np.median(null) - np.median(by_hand)) < 0.35
