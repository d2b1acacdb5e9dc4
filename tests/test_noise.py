import numpy as np

from axonframe.operators import dense


def test_products_of_days_need_no_join_of_the_days(spark, capsys):
    rng = np.random.default_rng(2)
    v = np.where(rng.uniform(size=(30, 8)) < 0.8, rng.normal(size=(30, 8)), np.nan)
    days = spark.createDataFrame([(u, t, float(v[u, t])) for u, t in zip(*np.nonzero(np.isfinite(v)), strict=True) for u, t in [(int(u), int(t))]], "sid long, tr long, v double")
    out = dense.day_products(days, "sid")
    out.explain()
    plan = capsys.readouterr().out
    assert "Join" not in plan and plan.count("Exchange") == 2
    c = np.nan_to_num(v - np.nanmean(v, axis=1)[:, None])
    got = np.zeros((8, 8))
    for r in out.collect():
        got[r.tr, r.ts] = r.g
    assert np.allclose(got, c.T @ c)
