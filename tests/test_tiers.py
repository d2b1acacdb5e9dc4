"""Per-trial tiers: the running cross products against direct solutions, streams against the ordered pass."""

import math
import uuid

import numpy as np
import pandas as pd
import pytest

from axonframe.streaming import decode, tiers

SCHEMA = "sid long, t long, ts timestamp, v double, onset boolean, extra array<double>"
SMALL = tiers.Tiers(frames=12, response=(0.0, 0.5, 1.0, 0.3), delays=(("fast", 2), ("slow", 5), ("end", None)), extra=1)


def session(rng, sid, n):
    start = pd.Timestamp("2024-01-01")
    return pd.DataFrame({
        "sid": sid, "t": np.arange(n), "ts": [start + pd.Timedelta(seconds=int(t)) for t in range(n)], "v": rng.normal(size=n), "onset": rng.random(n) < 0.2, "extra": [[float(x)] for x in rng.normal(size=n)],
    })


def direct(f, s, last=None):
    """Every estimate by building the whole design up to its decode frame, out of the frames there are."""
    onsets = f.t[f.onset].tolist()
    last = f.t.max() if last is None else last
    for i, o in enumerate(onsets):
        for tier, delay in s.delays:
            d = min((o // s.frames + 1) * s.frames - 1 if delay is None else o + delay, last)
            g = f[f.t <= d]
            t = g.t.to_numpy()
            runs = range(max(t) // s.frames + 1)
            x = [np.array([e[0] for e in g.extra])]
            for r in runs:
                x += [(t // s.frames == r) * 1.0, (t // s.frames == r) * np.cos(math.pi * (2 * (t % s.frames) + 1) / (2 * s.frames))]
            for j in onsets[: i + 1]:
                x.append(np.array([s.response[k - j] if 0 <= k - j < len(s.response) else 0.0 for k in t]))
            x = np.array(x).T
            size = (s.scarce if len(t) < x.shape[1] else s.ridge) * (x * x).sum() / x.shape[1]
            beta = np.linalg.solve(x.T @ x + size * np.eye(x.shape[1]), x.T @ g.v.to_numpy())
            yield int(f.sid.iloc[0]), i, tier, o, d, len(t), x.shape[1], beta[-1]


def tidy(rows):
    return sorted((int(r[0]), int(r[1]), r[2], int(r[3]), int(r[4]), int(r[5]), int(r[6]), round(float(r[7]), 6) + 0.0) for r in rows)


def test_one_pass_equals_direct_solutions(spark):
    rng = np.random.default_rng(1)
    frames = pd.concat([session(rng, k, n) for k, n in ((1, 50), (2, 31), (3, 1))])
    want = [r for _, f in frames.groupby("sid") for r in direct(f, SMALL)]
    df = spark.createDataFrame(frames, SCHEMA)
    assert tidy(tiers.batch(df, SMALL).collect()) == tidy(want)
    assert tidy(tiers.batch(df.union(df), SMALL).collect()) == tidy(want)  # repeated frames change nothing
    assert tiers.batch(df.limit(0), SMALL).count() == 0


def streamed(spark, folder, cuts, late="1 hour"):
    for k, part in enumerate(cuts):
        part.astype({"ts": "datetime64[us]"}).to_parquet(folder / f"{k:02}.parquet")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        source = spark.readStream.schema(SCHEMA.replace("timestamp", "timestamp_ntz")).option("maxFilesPerTrigger", 1).parquet(str(folder)).selectExpr("sid", "t", "cast(ts as timestamp) as ts", "v", "onset", "extra")
        return decode.run_to_end(tiers.stream(source, SMALL, late), "append", f"tiers_{uuid.uuid4().hex}").collect()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        spark.conf.set("spark.sql.shuffle.partitions", "8")


@pytest.mark.parametrize("pieces", [1, 4])
def test_stream_equals_the_pass_for_any_cut_with_late_and_replayed_frames(spark, tmp_path, pieces):
    rng = np.random.default_rng(pieces)
    frames = pd.concat([session(rng, k, 30) for k in (1, 2)])
    order = np.argsort(frames.t.to_numpy() + rng.uniform(0, 4, len(frames)), kind="stable")  # some come after later ones
    shuffled = frames.iloc[order]
    cuts = [shuffled.iloc[p] for p in np.array_split(np.arange(len(shuffled)), pieces)]
    cuts = [pd.concat([c, cuts[k - 1].tail(3)]) if k else c for k, c in enumerate(cuts)]  # and some twice
    want = tiers.batch(spark.createDataFrame(frames, SCHEMA), SMALL, to_end=False).collect()
    assert len(want) > 10 and tidy(streamed(spark, tmp_path, cuts)) == tidy(want)


def test_timers_close_gaps_that_the_watermark_has_passed(spark, tmp_path):
    """Frames 8 and 9 never come: the tiers wait for the watermark and are then solved without them."""
    rng = np.random.default_rng(9)
    f = session(rng, 5, 40)
    f["onset"] = f.t.isin([2, 7, 20])
    there = f[~f.t.isin([8, 9])]
    got = streamed(spark, tmp_path, [there[there.t < 15], there[(there.t >= 15) & (there.t < 30)], there[there.t >= 30]], "2 seconds")
    want = [r for r in direct(there, SMALL, last=39) if r[4] <= 36]
    assert tidy(r for r in got if r.frame <= 36) == tidy(want) and {(r.trial, r.tier) for r in got} >= {(1, "fast"), (1, "slow"), (0, "end")}
