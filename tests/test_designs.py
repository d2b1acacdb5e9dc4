import numpy as np
import pytest

from axonframe.operators import designs


def table_of(spark, rng, k, sizes):
    rows = []
    for sid, n in enumerate(sizes):
        x = rng.normal(size=(n, k))
        y = x @ rng.normal(size=k) + rng.normal(size=n)
        rows += [(sid, t, *map(float, x[t]), float(y[t])) for t in range(n)]
    return spark.createDataFrame(rows, ", ".join(["sid long", "t long", *(f"x{i} double" for i in range(k)), "y double"])), [f"x{i}" for i in range(k)]


@pytest.mark.parametrize("k", [1, 2, 5, 12])
def test_coefficients_inverse_and_tests_against_numpy(spark, k):
    rng = np.random.default_rng(k)
    df, names = table_of(spark, rng, k, [40, 25, 300])
    weights = [float(i % 3 - 1) or 0.5 for i in range(k)]
    pair = [[float(i == j) for i in range(k)] for j in range(min(k, 3))]
    fit = designs.joint(designs.contrast(designs.fitted(df, ["sid"], names), weights), pair)
    frame = df.toPandas()
    for r in fit.collect():
        g = frame[frame.sid == r.sid]
        x, y = g[names].to_numpy(), g.y.to_numpy()
        beta, v = np.linalg.lstsq(x, y, rcond=None)[0], np.linalg.inv(x.T @ x)
        s2 = ((y - x @ beta) ** 2).sum() / (len(y) - k)
        c, m = np.array(weights), np.array(pair)
        assert np.allclose(r.beta, beta) and np.allclose(r.inverse, v) and np.isclose(r.rss, s2 * (len(y) - k))
        assert np.isclose(r.c_t, c @ beta / np.sqrt(s2 * c @ v @ c)) and np.isclose(r.f, (m @ beta) @ np.linalg.solve(m @ v @ m.T, m @ beta) / len(m) / s2)


def test_ridge_collinear_columns_and_nulls(spark):
    rng = np.random.default_rng(3)
    df, names = table_of(spark, rng, 3, [50])
    frame = df.toPandas()
    x, y = frame[names].to_numpy(), frame.y.to_numpy()
    r = designs.fitted(df, ["sid"], names, ridge=2.0).first()
    beta = np.linalg.solve(x.T @ x + 2 * np.eye(3), x.T @ y)
    assert np.allclose(r.beta, beta) and np.isclose(r.rss, ((y - x @ beta) ** 2).sum())
    twice = designs.fitted(df.selectExpr("*", "2 * x0 as x3"), ["sid"], [*names, "x3"]).first()
    assert np.allclose(twice.beta, [*np.linalg.lstsq(x, y, rcond=None)[0], 0.0])
    nulls = df.selectExpr("sid", "t", "x0", "x1", "if(t = 3, null, x2) as x2", "if(t = 5, null, y) as y")
    assert designs.fitted(nulls, ["sid"], names).first().n == 48
    assert designs.fitted(df.limit(0), ["sid"], names).count() == 0


def test_posterior_of_a_known_ar1_process(spark):
    rng = np.random.default_rng(4)
    n, e, rows = 2000, 0.0, []
    for t in range(n):
        e = 0.6 * e + rng.normal()
        x = [1.0, t / n, float(rng.random() < 0.1), float(np.cos(t / 9))]
        rows.append((1, t, *x, float(np.dot(x, [2, -1, 3, 0.5]) + e)))
    names = ["x0", "x1", "x2", "x3"]
    df = spark.createDataFrame(rows, "sid long, t long, x0 double, x1 double, x2 double, x3 double, y double")
    rho = designs.lag_one(df, designs.fitted(df, ["sid"], names), names)
    post = designs.ar1_posterior(df, rho, names).first()
    assert abs(post.rho - 0.6) < 0.06 and abs(post.beta[2] - 3) < 4 * post["var"][2] ** 0.5 and post["var"][2] < 0.01
    left = designs.residuals(df, designs.fitted(df, ["sid"], names), ["sid"], names).selectExpr("avg(residual)").first()[0]
    assert abs(left) < 1e-9


def test_the_true_response_is_chosen(spark):
    rng = np.random.default_rng(5)
    onsets = [(s, int(t)) for s in range(6) for t in rng.choice(180, 12, replace=False)]
    rows = []
    for s in range(6):
        y = rng.normal(size=200) * 0.2
        for a, t in onsets:
            if a == s:
                y[t : t + 6] += designs.LIBRARY[s % 3]
        rows += [(s, t, float(y[t]), 1.0) for t in range(200)]
    df = spark.createDataFrame(rows, "sid long, t long, y double, one double")
    got = designs.best_response(df, spark.createDataFrame(onsets, "sid long, t long"), designs.LIBRARY, ["one"]).collect()
    assert {r.sid: r.response for r in got} == {s: s % 3 for s in range(6)} and all(abs(r.beta - 1) < 0.2 for r in got)
