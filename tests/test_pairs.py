import numpy as np
import pytest

from axonframe.operators import evaluation


@pytest.mark.parametrize("bins", [16, 21])
def test_auc_of_all_pairs_keeps_no_pairs(spark, monkeypatch, bins):
    """Coarse bins are refined until the bounds round alike."""
    rng = np.random.default_rng(7)
    x, image = rng.normal(size=(60, 6)), rng.integers(0, 4, 60)
    x += 0.5 * np.eye(6)[image]
    x /= np.linalg.norm(x, axis=1)[:, None]
    monkeypatch.setattr(evaluation, "BINS", bins)
    df = spark.createDataFrame([(i, int(k), v.tolist()) for i, (k, v) in enumerate(zip(image, x, strict=True))], "trial long, image int, v array<double>")
    a, b = np.triu_indices(len(x), 1)
    dist, same = np.round(1 - (x @ x.T)[a, b], 12) + 0.0, (image[:, None] == image)[a, b]
    want = (dist[~same][None] > dist[same][:, None]).mean()
    auc, n_same, n_diff = evaluation.exact_auc(df, 3, 5)
    assert (round(auc, 5), n_same, n_diff) == (round(want, 5), same.sum(), (~same).sum())
    rows = evaluation.pair_counts(df, 3, 0, evaluation.SPAN)
    assert len(rows) <= 64 and sum(r[1] for r in rows) == same.sum()
    assert evaluation.exact_auc(df.limit(1), 1, 5) == (None, 0, 0)
