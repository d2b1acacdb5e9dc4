"""Chained stateful streams against their batch twins and against numpy."""

import uuid

import numpy as np
import pandas as pd
import pytest

from axonframe.functions import kernels as K
from axonframe.streaming import decode, frames


def with_rocksdb(spark, build, name):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        return decode.run_to_end(build(), "append", f"{name}_{uuid.uuid4().hex}").toPandas()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def long_frames(rng, n, nodes):
    start = pd.Timestamp("2024-01-01")
    rows = [(sid, t, start + pd.Timedelta(seconds=t), f"n{k}", float(rng.normal())) for sid in (1, 2) for t in range(n) for k in range(nodes)]
    return pd.DataFrame(rows, columns=["sid", "t", "ts", "node", "v"]).astype({"ts": "datetime64[us]"})


def test_one_streaming_query_equals_the_batch_chain_and_numpy(spark, tmp_path):
    rng = np.random.default_rng(1)
    n, nodes, vertices, parcels = 40, 12, 8, 4
    f = long_frames(rng, n, nodes)
    w1, w2 = rng.random((nodes, vertices)), rng.random((vertices, parcels))
    first = spark.createDataFrame([(f"n{i}", j, float(w1[i, j])) for i in range(nodes) for j in range(vertices)], "node string, vertex int, w double")
    second = spark.createDataFrame([(i, j, float(w2[i, j])) for i in range(vertices) for j in range(parcels)], "vertex int, parcel int, w double")
    weights = frames.composed(first, second)
    measure = frames.Connectivity(8, 3)
    for k, part in enumerate(np.array_split(np.argsort(f.t.to_numpy() + rng.uniform(0, 3, len(f)), kind="stable"), 4)):  # nodes of a frame come in several batches
        f.iloc[part].to_parquet(tmp_path / f"{k}.parquet")

    def build():
        source = spark.readStream.schema("sid long, t long, ts timestamp_ntz, node string, v double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
        return frames.chain(source.selectExpr("sid", "t", "cast(ts as timestamp) as ts", "node", "v"), weights, measure)

    got = with_rocksdb(spark, build, "chain").sort_values(["sid", "t"])
    whole = spark.createDataFrame(f).selectExpr("sid", "t", "cast(ts as timestamp) as ts", "node", "v")
    want = frames.chain(whole, weights, measure, frames.batch).toPandas().sort_values(["sid", "t"])
    assert len(want) == 2 * (n - 7)
    both = want.merge(got, on=["sid", "t"], suffixes=("", "_s"))
    closed = want[want.t < n - 11]  # the last frames wait for the watermark
    assert len(both) == len(got) >= len(closed) and np.allclose(both.q, both.q_s) and np.allclose(np.stack(both.r), np.stack(both.r_s))
    x = f[f.sid == 1].pivot(index="t", columns="node", values="v")[[f"n{k}" for k in range(nodes)]].to_numpy() @ w1 @ w2
    for r in want[want.sid == 1].itertuples():
        c = np.corrcoef(x[r.t - 7 : r.t + 1].T) * 8 / 7
        assert np.allclose(r.r, c[np.triu_indices(parcels, 1)])
        a = np.maximum(c, 0)
        np.fill_diagonal(a, 0)
        v = K.fix_signs(np.linalg.eigh(a)[1][:, -3:])
        s = np.exp(v) / np.exp(v).sum(1, keepdims=True)
        b = a - np.outer(a.sum(0), a.sum(0)) / a.sum()
        np.fill_diagonal(b, 0)
        assert np.isclose(r.q, np.trace(s.T @ b @ s) / a.sum())


@pytest.mark.parametrize("pieces", [1, 3])
def test_low_rank_windows_equal_whole_decompositions_for_any_cut_and_replays(spark, tmp_path, pieces):
    rng = np.random.default_rng(pieces)
    z = (rng.normal(size=(30, 2)) + 1j * rng.normal(size=(30, 2))) @ (rng.normal(size=(2, 20)) * 4) + 0.1 * (rng.normal(size=(30, 20)) + 1j * rng.normal(size=(30, 20)))
    rows = pd.DataFrame({"sid": 7, "t": np.arange(30), "re": z.real.tolist(), "im": z.imag.tolist()})
    parts = np.array_split(np.arange(30), pieces)
    for k, part in enumerate(parts):
        pd.concat([rows.iloc[part], rows.iloc[parts[k - 1][-2:]]] if k else [rows.iloc[part]]).to_parquet(tmp_path / f"{k}.parquet")
    measure = frames.LowRank(10, 0.1)
    schema = "sid long, t long, re array<double>, im array<double>"
    got = with_rocksdb(spark, lambda: frames.streamed(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path)), measure), "low").sort_values("t")
    want = frames.batch(spark.createDataFrame(rows, schema), measure).toPandas().sort_values("t")
    assert got.t.tolist() == want.t.tolist() == list(range(1, 30)) and np.allclose(np.stack(got.re), np.stack(want.re))
    for r in want.itertuples():
        m = z[max(0, r.t - 9) : r.t + 1].T
        u, s, vh = np.linalg.svd(m, full_matrices=False)
        keep = s > K.noise_threshold(*m.shape, 0.1)
        clean = (u[:, keep] * s[keep]) @ vh[keep]
        assert r.kept == keep.sum() and np.allclose(np.array(r.re) + 1j * np.array(r.im), clean[:, -1], atol=1e-9)
    assert frames.batch(spark.createDataFrame(rows, schema).limit(0), measure).count() == 0
