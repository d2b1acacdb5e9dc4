import numpy as np
import pandas as pd
import pytest

from axonframe.operators.moments import pairs
from axonframe.operators.windows import swc_scaled
from axonframe.sources.series import daily_channels, user_series
from axonframe.sources.tables import table
from axonframe.streaming import decode, kalman

from .compare import SMALL


def test_rls_stream_equals_batch(spark, tmp_path):
    frames = user_series(table(spark, SMALL, "events")).select("sid", "t", "v").filter("sid < 4").toPandas()
    for k, part in enumerate(np.array_split(frames.sort_values("t"), 3)):
        part.to_parquet(tmp_path / f"{k}.parquet")
        (tmp_path / f"{k}.parquet").touch()
    stream = spark.readStream.schema(decode.frames_schema()).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    got = decode.run_to_end(decode.rls_stream(stream), "update", "rls_frames").toPandas()
    last = got.sort_values("t").groupby("sid").tail(1).set_index("sid")
    want = decode.rls_batch(spark.createDataFrame(frames)).toPandas().set_index("sid")
    assert set(last.index) == set(want.index)
    for c in ("t", "level", "slope", "sigma2"):
        assert np.allclose(last[c].sort_index().astype(float), want[c].sort_index().astype(float), rtol=1e-6)


def test_ring_stream_equals_windows(spark, tmp_path):
    long = daily_channels(table(spark, SMALL, "events"))
    p = pairs(long).select("ch_i", "ch_j", "tr", "x", "y").toPandas().rename(columns={"tr": "t"}).astype({"t": "int64"})
    p.to_parquet(tmp_path / "0.parquet")
    stream = spark.readStream.schema("ch_i string, ch_j string, t long, x double, y double").parquet(str(tmp_path))
    got = decode.run_to_end(decode.ring_stream(stream, 7), "append", "ring_pairs").toPandas()
    want = swc_scaled(long, 7).toPandas()
    both = got.assign(win=got.t - 6).merge(want, on=["ch_i", "ch_j", "win"])
    assert len(both) == len(want) == len(got)
    off = both.ch_i != both.ch_j
    assert np.allclose(both.r[off], both["stat"][off], atol=1e-8)


def test_event_windows_stream(spark, tmp_path):
    table(spark, SMALL, "events").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(table(spark, SMALL, "events").schema).parquet(str(tmp_path / "e"))
    got = decode.run_to_end(decode.event_windows(stream), "update", "event_days").toPandas()
    want = decode.event_windows(table(spark, SMALL, "events")).toPandas()
    assert isinstance(got, pd.DataFrame) and got.n.sum() == want.n.sum()


def test_trial_stream_equals_batch_and_leaves_last_in_first_out(spark, tmp_path):
    from axonframe.streaming import trials

    frames = trials.event_frames(spark, SMALL).filter("run < 3").toPandas().sort_values("t")
    for k, part in enumerate(np.array_split(np.arange(len(frames)), 3)):
        frames.iloc[part].to_parquet(tmp_path / f"{k}.parquet")
    schema = "run long, t long, v double, onset boolean"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    got = decode.run_to_end(trials.decode_stream(stream), "append", "trial_frames").toPandas().sort_values(["run", "t"])
    want = trials.decode_batch(spark.createDataFrame(frames)).toPandas().sort_values(["run", "t"])
    assert len(want) > 3 and got[["run", "t", "trial"]].values.tolist() == want[["run", "t", "trial"]].values.tolist()
    assert np.allclose(got["mean"], want["mean"]) and np.allclose(got.snr, want.snr)
    d = trials.Decoder(wait=2, least=8)
    left = [trial for _, (trial, *_) in d.run([1.0, 2, 1, 3, 1, 2, 4, 1, 2, 1, 3, 2], [True, True, True] + [False] * 9)]
    assert left == [3, 2, 1]


@pytest.mark.parametrize("kind, step", [(kalman.DIAGONAL, kalman.diagonal_step), (kalman.AR1, kalman.ar1_step)])
def test_kalman_streams_equal_ordered_folds(spark, tmp_path, kind, step):
    frames = user_series(table(spark, SMALL, "events")).select("sid", "t", "v").filter("sid < 4").toPandas()
    for k, part in enumerate(np.array_split(frames.sort_values("t"), 3)):
        part.to_parquet(tmp_path / f"{k}.parquet")
    stream = spark.readStream.schema(decode.frames_schema()).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    got = decode.run_to_end(kalman.streamed(stream, kind, step), "update", f"kalman_{len(kind)}").toPandas()
    last = got.sort_values("t").groupby("sid").tail(1).sort_values("sid").reset_index(drop=True)
    want = kalman.folded(spark.createDataFrame(frames), kind, step).toPandas().sort_values("sid").reset_index(drop=True)
    assert len(want) == 4 and last["sid"].tolist() == want["sid"].tolist() and np.allclose(last.drop(columns="sid"), want.drop(columns="sid"), rtol=1e-9)


def test_ar1_noise_is_found(spark):
    """A trend under AR(1) noise: rho and the slope come near the truth, the first frame is a plain update."""
    rng = np.random.default_rng(1)
    e, v = 0.0, []
    for t in range(1, 1501):
        e = 0.6 * e + rng.normal()
        v.append((1, t, 3 + 0.02 * t + e))
    got = kalman.folded(spark.createDataFrame(v, "sid long, t long, v double"), kalman.AR1, kalman.ar1_step).first()
    assert abs(got.rho - 0.6) < 0.08 and abs(got.slope - 0.2) < 0.02
    assert kalman.ar1_step(kalman.START[kalman.AR1], 10, 2.0)[:2] == pytest.approx((2000 / 2001, 2000 / 2001))
