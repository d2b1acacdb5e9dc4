import numpy as np
import pytest

from axonframe import registry
from axonframe.functions import kernels as K
from axonframe.operators import components

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def vectors(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").orderBy("vec_id").collect()
    return np.array([r.label for r in rows]), np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])


def got(spark, name):
    return registry.QUERIES[name](spark, FOLDER).toPandas()


def covs(label, x):
    return {int(k): np.cov(x[label == k].T) for k in np.unique(label)}


def test_shares_of_all_features_equal_singular_values_of_the_data(spark, vectors):
    label, x, _ = vectors
    pca, spectrum, stick = (got(spark, n) for n in ("pca", "eigenspectrum", "broken_stick"))
    assert len(spectrum) == 64 * len(np.unique(label))
    for k in np.unique(label):
        m = x[label == k] - x[label == k].mean(0)
        s = np.zeros(64)
        s[: min(m.shape)] = np.linalg.svd(m, compute_uv=False) ** 2
        share = s / s.sum()
        assert np.allclose(spectrum[spectrum.image == k].sort_values("component").share, share, atol=1e-9)
        assert np.allclose(pca[pca.image == k].sort_values("component").share, share[:3], atol=1e-9)
        assert stick[stick.image == k].dimension.iloc[0] == K.leading_above(share, K.broken_stick(64))
        assert np.allclose(pca[(pca.image == k) & (pca.component == 0)].top, np.abs(np.linalg.svd(m, full_matrices=False)[2][0]).max(), atol=1e-6)


def test_canonical_correlations_and_information(spark, vectors):
    label, x, _ = vectors
    cca, cmi = got(spark, "cca"), got(spark, "mv_cmi")
    for k in np.unique(label):
        m = x[label == k]
        assert np.allclose(cca[cca.image == k].sort_values("component").r, K.canonical(m[:, :4], m[:, 4:8]), atol=1e-6)
        assert np.isclose(cmi[cmi.image == k].information.iloc[0], K.conditional_information(m[:, :2], m[:, 2:4], m[:, 4:]), rtol=1e-4)


def test_means_of_covariances(spark, vectors):
    label, x, _ = vectors
    all_ = [c + 1e-6 * np.eye(64) for c in covs(label, x).values()]
    square = lambda df: df.pivot(index="i", columns="j", values="v").to_numpy()
    assert np.allclose(square(got(spark, "spd_mean_logeuc")), K.expm(np.mean([K.logm(c) for c in all_], 0)), atol=1e-8)
    tangent = got(spark, "spd_tangent").sort_values("image").norm
    assert np.allclose(tangent, [np.linalg.norm(K.logm(c)) for c in all_], rtol=1e-4)


def test_geometric_mean_of_groups(spark):
    rng = np.random.default_rng(1)
    ms = [(lambda a: a @ a.T + np.eye(3))(rng.normal(size=(3, 3))) for _ in range(4)]
    cells = spark.createDataFrame([(k, i, j, 1, float(m[i, j])) for k, m in enumerate(ms) for i in range(3) for j in range(i, 3)], "g int, i int, j int, n long, c double")
    mean = np.zeros((3, 3))
    for r in components.geometric_mean(cells, ["g"]).collect():
        mean[r.i, r.j] = mean[r.j, r.i] = r.v
    assert np.allclose(mean, K.geometric_mean(ms), atol=1e-8)


def test_noise_level_and_causal_shares(spark, vectors):
    label, x, ids = vectors
    nordic = got(spark, "nordic").set_index("image")
    for k in np.unique(label):
        z, kept = K.low_rank(x[label == k].T)
        sigma_free = nordic.loc[k]
        assert abs(sigma_free.kept - kept) <= 64 and sigma_free.norm <= np.linalg.norm(x[label == k]) + 1e-9
    shares = got(spark, "causal_components").sort_values("run")
    run = ids // 100
    for r in shares.itertuples():
        old, now = x[run < r.run], x[run == r.run]
        v = np.linalg.svd(old - old.mean(0), full_matrices=False)[2][:8].T
        c = np.cov(now.T)
        assert r.past == len(old) and np.isclose(r.share, np.trace(v.T @ c @ v) / np.trace(c), atol=1e-9)
    assert shares.run.tolist() == sorted(set(run.tolist()))[1:]


def test_shuffles_keep_each_feature_and_break_their_ties(spark, vectors):
    _, x, _ = vectors
    p = got(spark, "parallel_analysis").sort_values("component")
    w = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    assert np.allclose(p["share"], w / w.sum(), atol=1e-9) and len(p) == 64 and (p.null95 > 0).all()
    rng = np.random.default_rng(2)
    u = rng.normal(size=(300, 1)) @ rng.normal(size=(1, 6)) + 0.3 * rng.normal(size=(300, 6))
    from axonframe.operators.resampling import shuffled

    flat = spark.createDataFrame([(t, k, float(u[t, k])) for t in range(300) for k in range(6)], "trial long, k int, x double")
    rows = shuffled(flat, 2, salts=4).toPandas()
    for _, g in rows.groupby("draw"):
        m = g.pivot(index="pos", columns="k", values="x")
        assert m.shape == (300, 6) and m.index.tolist() == list(range(1, 301)) and np.allclose(np.sort(m.to_numpy(), 0), np.sort(u, 0))
    c = rows[rows.draw == 1].pivot(index="pos", columns="k", values="x").corr().to_numpy()
    assert np.abs(c - np.eye(6)).max() < 0.25


def test_odd_rows_and_many_groups(spark, monkeypatch):
    rows = [(g, [float(g), float(i), 1.0]) for g in range(30) for i in range(4)] + [(1, None), (1, [1.0, None, 2.0]), (1, [float("nan"), 1.0, 2.0]), (1, []), (1, [1.0]), (None, [1.0, 2.0, 3.0]), (None, [2.0, 2.0, 5.0])]
    df = spark.createDataFrame(rows, "g int, v array<double>").repartition(3)
    monkeypatch.setattr(components, "GROUPS", 4)
    got_ = {(r.g, r.i, r.j): (r.n, r.c) for r in components.covariance(components.products(df, ["g"]), ["g"]).collect()}
    assert len(got_) == 31 * 6 and got_[1, 1, 1] == (4, pytest.approx(5 / 3)) and got_[None, 0, 2] == (2, pytest.approx(1.0)) and got_[7, 0, 0] == (4, 0.0)
    assert components.products(df.limit(0), ["g"]).count() == 0


def test_clamped_whitened_and_consensus(spark, vectors):
    label, x, ids = vectors
    clamp = got(spark, "spd_clamp")
    m = clamp[clamp.image == 3].pivot(index="i", columns="j", values="v").to_numpy()
    w, v = np.linalg.eigh(np.cov(x[label == 3].T))
    assert np.allclose(m, (v * np.maximum(w, 1e-3)) @ v.T, atol=1e-9) and np.linalg.eigvalsh(m)[0] > 1e-3 - 1e-9
    rng = np.random.default_rng(1)
    a = rng.normal(size=(3, 3)) + 2 * np.eye(3)
    z = rng.normal(size=(900, 3)) @ a
    run = np.arange(900) % 3
    df = spark.createDataFrame([(int(r), [float(c) for c in v]) for r, v in zip(run, z, strict=True)], "run long, v array<double>")
    white = np.array([r.v for r in components.prewhitened(df, "run").collect()])
    mean = K.expm(np.mean([K.logm(np.cov(z[run == r].T)) for r in range(3)], 0))
    root = K.spectral(mean, lambda w: w**-0.5)
    assert np.allclose(np.sort(white, 0), np.sort(z @ root, 0), atol=1e-8) and np.allclose(root @ mean @ root, np.eye(3), atol=1e-9)
    one = components.prewhitened(df.withColumn("run", df.run * 0), "run")  # one run: its own covariance, so the identity is left
    assert np.allclose(np.cov(np.array([r.v for r in one.collect()]).T), np.eye(3), atol=1e-6)
    row = got(spark, "consensus_dimensionality").iloc[0]
    assert row.draws == 20 and 1 <= row["median"] <= 64 and row.iqr >= 0


def test_fits_with_more_and_more_columns(spark):
    from axonframe.operators import designs

    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 3))
    y = x @ [1.0, 0.5, 0.0] + rng.normal(size=60)
    df = spark.createDataFrame([(t % 2, 1.0, *map(float, x[t]), float(y[t])) for t in range(60)], "g long, one double, a double, b double, c double, y double")
    for r in designs.column_curve(df, ["g"], ["one", "a"], ["b", "c"]).collect():
        at = np.arange(60) % 2 == r.g
        z = np.column_stack([np.ones(30), x[at][:, : 1 + r.columns]])
        left = y[at] - z @ np.linalg.lstsq(z, y[at], rcond=None)[0]
        assert abs(r.r2 - (1 - left @ left / ((y[at] - y[at].mean()) ** 2).sum())) < 1e-9
    rows = registry.QUERIES["glmdenoise"](spark, FOLDER).collect()
    assert sorted(r.components for r in rows) == [0, 1, 2, 3] and [r.components for r in rows if r.chosen] == [max(rows, key=lambda r: (r.r2, -r.components)).components]


def test_shuffles_in_arrays_equal_rows_numbered_one_by_one(spark, monkeypatch):
    from axonframe.operators.resampling import shuffled

    rng = np.random.default_rng(4)
    u = rng.normal(size=(300, 6))
    df = spark.createDataFrame([(t * 7 - 900, u[t].tolist()) for t in range(300)], "trial long, v array<double>").repartition(5)
    flat = spark.createDataFrame([(t * 7 - 900, k, float(u[t, k])) for t in range(300) for k in range(6)], "trial long, k int, x double")
    want = {d: g.pivot(index="pos", columns="k", values="x").to_numpy() for d, g in shuffled(flat, 3).toPandas().groupby("draw")}
    for cell in (1 << 20, 6 * 40, 6 * 7):  # one stretch; some; stretches shorter than what their counts differ by
        monkeypatch.setattr(components, "CELL", cell)
        sums = components.shuffled_products(df, "trial", 3).toPandas()
        assert len(sums) == 4 * 21 and (sums.n == 300).all()
        for d, m in want.items():
            g = sums[sums.draw == d]
            assert np.allclose(g.sij, (m.T @ m)[g.i, g.j], atol=1e-9) and np.allclose(g.si, m.sum(0)[g.i], atol=1e-9) and np.allclose(g.sj, m.sum(0)[g.j], atol=1e-9)


def test_parallel_analysis_leaves_out_odd_rows_whole(spark, vectors, tmp_path):
    label, x, ids = vectors
    rows = [(int(i), v.tolist(), int(k)) for i, v, k in zip(ids, x, label, strict=True)]
    odd = [None, [], [1.0] * 40, [*[1.0] * 63, None], [float("nan")] * 64, [*[5.0] * 63, float("inf")]]
    rows += [(10_000 + i, v, 0) for i, v in enumerate(odd)]
    schema = "vec_id long, embedding array<double>, label int"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/odd/embeddings.parquet")
    p, clean = (registry.QUERIES["parallel_analysis"](spark, d).toPandas().sort_values("component") for d in (f"{tmp_path}/odd", FOLDER))
    assert np.allclose(p["share"], clean["share"], atol=1e-9) and np.allclose(p.null95, clean.null95, atol=1e-9)
    again = spark.createDataFrame([r for r in rows for _ in range(2)][:1000], schema)  # every number twice: a trial's features stay together
    again.write.parquet(f"{tmp_path}/twice/embeddings.parquet")
    w = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    assert np.allclose(registry.QUERIES["parallel_analysis"](spark, f"{tmp_path}/twice").toPandas().sort_values("component")["share"], w / w.sum(), atol=1e-9)
    spark.createDataFrame(rows[-6:-4], schema).write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert registry.QUERIES["parallel_analysis"](spark, f"{tmp_path}/none").count() == 0


def test_parallel_analysis_shuffles_arrays_not_values(spark, vectors):
    x = vectors[1]
    sc = spark.sparkContext
    store, none, no = sc._jsc.sc().statusStore(), sc._jvm.java.util.ArrayList(), sc._gateway.new_array(sc._jvm.double, 0)

    def stages():
        found = store.stageList(none, False, False, no, none)
        return {(s := found.apply(i)).stageId(): s.shuffleWriteRecords() for i in range(found.size())}

    last = max(stages(), default=-1)
    assert len(got(spark, "parallel_analysis")) == 64
    assert 0 < sum(n for k, n in stages().items() if k > last) < 20 * x.size / 2  # each of 20 draws moves every value
