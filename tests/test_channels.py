import datetime as dt

import numpy as np
import pandas as pd
import pytest

from axonframe.operators import matrices


def test_channel_matrices_place_days_by_key(spark, tmp_path):
    """A channel that misses a day keeps its other days in place, and no day of another channel is lost."""
    rng = np.random.default_rng(4)
    wide = pd.DataFrame(rng.normal(size=(24, 3)) @ rng.normal(size=(3, 3)), columns=["a", "b", "c"])
    wide.loc[2, "b"] = np.nan
    cells = [(k, dt.datetime(2024, 1, 1 + d), 1, ch, float(v)) for k, ((d, ch), v) in enumerate(wide.stack().dropna().items())]
    spark.createDataFrame(cells, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    c = wide.cov().to_numpy()
    want = np.linalg.inv(c + 1e-6 * np.eye(3))
    got = {(r.ch_i, r.ch_j): r.p for r in matrices.precision(spark, str(tmp_path)).collect()}
    assert got == {(a, b): pytest.approx(want[i, j], rel=1e-4, abs=2e-5) for i, a in enumerate("abc") for j, b in enumerate("abc")}
    schur = c[:2, :2] - np.outer(c[:2, 2], c[2, :2]) / (c[2, 2] + 1e-6)
    got = {(r.ch_i, r.ch_j): r.c for r in matrices.conditional_cov(spark, str(tmp_path)).collect()}
    assert got == {(a, b): pytest.approx(schur[i, j], rel=1e-4, abs=2e-5) for i, a in enumerate("ab") for j, b in enumerate("ab")}
