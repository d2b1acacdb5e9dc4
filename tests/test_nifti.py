import contextlib
import gzip
import io

import numpy as np
import pytest

from axonframe.sources import nifti, volumes

AFFINE = np.array([[2.0, 0, 0.1, -90], [0, 2.5, 0, -126], [0, 0.2, 3, -72], [0, 0, 0, 1]])


def image(v, kind="f4", affine=AFFINE):
    return nifti.header_bytes(v.shape, affine.ravel(), kind) + v.astype(f"<{kind}").tobytes(order="F")


@pytest.fixture
def session(tmp_path):
    """Two runs of a session, one compressed, and their values."""
    rng = np.random.default_rng(1)
    folder = tmp_path / "sub-005" / "ses-03" / "func"
    folder.mkdir(parents=True)
    a, b = rng.integers(0, 90, (5, 4, 3, 6)).astype(float), rng.integers(0, 90, (5, 4, 3, 2)).astype(float)
    (folder / "sub-005_ses-03_task-C_run-01_bold.nii").write_bytes(image(a, "i2"))
    (folder / "sub-005_ses-03_task-C_run-02_bold.nii.gz").write_bytes(gzip.compress(image(b)))
    return tmp_path, {1: a, 2: b}


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("extended")
    return out.getvalue()


def test_voxels_names_and_slabs(spark, session):
    folder, runs = session
    df = nifti.voxels(spark, str(folder), slab_bytes="100")
    rows = df.toPandas()
    assert len(rows) == sum(v.size for v in runs.values()) and all(runs[r.run][r.x, r.y, r.z, r.t] == r.value for r in rows.itertuples())
    assert set(rows.subject) == {"005"} and set(rows.session) == {"03"} and set(rows.task) == {"C"}
    assert df.rdd.getNumPartitions() == 10  # 18 planes of 40 bytes by twos, and the compressed file whole
    one = nifti.voxels(spark, str(folder / "sub-005/ses-03/func/sub-005_ses-03_task-C_run-01_bold.nii"), "value double, t int")
    assert one.columns == ["value", "t"] and one.count() == runs[1].size
    assert nifti.voxels(spark, f"{folder}/*/*/func/*run-02*").select("run").distinct().first().run == 2


def test_filters_reach_the_reader(spark, session):
    folder, runs = session
    df = nifti.voxels(spark, str(folder)).filter("run = 1 and t >= 4 and z in (0, 2) and x < 2 and value <> 0 and y > 0")
    want = {(x, y, z, t): runs[1][x, y, z, t] for x in range(2) for y in range(1, 4) for z in (0, 2) for t in (4, 5) if runs[1][x, y, z, t]}
    assert {(r.x, r.y, r.z, r.t): r.value for r in df.collect()} == want
    physical = plan(df).split("Physical Plan")[1]
    assert "Filter (" not in physical and "BatchScan" in physical  # nothing is left for Spark to filter
    reader = nifti.VoxelReader({"path": str(folder)}, df.schema)
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, StringContains

    left = list(reader.pushFilters([EqualTo(("run",), 1), GreaterThanOrEqual(("t",), 4), StringContains(("path",), "x")]))
    assert [type(f) for f in left] == [StringContains] and sum(n for s in reader.partitions() for _, n in s.runs) == 6  # planes of two volumes of one file


def test_masks_of_images_and_arrays_are_counted(spark, session, tmp_path):
    folder, runs = session
    mask = np.zeros((5, 4, 3), bool)
    mask[1, 2, 0] = mask[4, 3, 2] = True
    np.save(tmp_path / "mask.npy", mask)
    (tmp_path / "mask.img").write_bytes(b"")
    (folder / "m.nii").write_bytes(image(mask.astype(float)))
    for name in (tmp_path / "mask.npy", folder / "m.nii"):
        rows = nifti.voxels(spark, str(folder / "sub-005"), mask=str(name), mask_count="2").filter("run = 1").collect()
        assert len(rows) == 12 and {(r.x, r.y, r.z) for r in rows} == {(1, 2, 0), (4, 3, 2)}
    with pytest.raises(Exception, match="has 2 voxels, not 3"):
        nifti.voxels(spark, str(folder / "sub-005"), mask=str(folder / "m.nii"), mask_count="3").count()


def test_inventory_reads_headers_only(spark, session):
    folder, _ = session
    cut = folder / "sub-006" / "ses-01" / "recognition"
    cut.mkdir(parents=True)
    (cut / "run_01_bet.nii").write_bytes(nifti.header_bytes((64, 64, 30, 500), AFFINE.ravel(), "f4"))  # no voxel is there
    got = {(r.subject, r.session, r.branch): r for r in nifti.inventory(spark, str(folder)).collect()}
    r = got["006", "01", "recognition"]
    assert r.runs == 1 and r.shape == [64, 64, 30, 500] and r.first == "run_01_bet.nii" and r.bytes == 64 * 64 * 30 * 500 * 4
    assert np.allclose(r.zooms, np.sqrt((AFFINE[:3, :3] ** 2).sum(0)), rtol=1e-6)
    assert got["005", "03", "func"].runs == 2 and got["005", "03", "func"].shape == [5, 4, 3, 6]


def test_round_trip_with_affine(spark, tmp_path):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(4, 3, 2, 3)).astype(np.float32).astype(float)
    rows = [(name, x, y, z, t, float(v[x, y, z, t]) * k) for k, name in enumerate(("a", "b"), 1) for x in range(4) for y in range(3) for z in range(2) for t in range(3) if (x, t) != (0, 1)]
    df = spark.createDataFrame(rows, "image string, x int, y int, z int, t int, value double").repartition(5)
    nifti.save(df, str(tmp_path / "out"), (4, 3, 2), AFFINE)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.nii", "b.nii"]
    back = nifti.voxels(spark, str(tmp_path / "out")).filter("path like '%/b.nii'").collect()
    assert len(back) == v.size and all(r.value == (0.0 if (r.x, r.t) == (0, 1) else np.float32(2 * v[r.x, r.y, r.z, r.t])) for r in back)
    heads = spark.read.format("nifti_headers").load(str(tmp_path / "out")).collect()
    assert all(np.allclose(np.array(h.affine).reshape(4, 4), AFFINE, rtol=1e-6) and h.shape == [4, 3, 2, 3] for h in heads)
    with pytest.raises(Exception, match="there already"):
        nifti.save(df, str(tmp_path / "out"), (4, 3, 2), AFFINE)
    nifti.save(df.filter("image = 'a'"), str(tmp_path / "out"), (4, 3, 2), AFFINE, "f8", overwrite=True)
    with pytest.raises(Exception, match="outside"):
        nifti.save(df, str(tmp_path / "small"), (2, 3, 2))
    assert not list((tmp_path / "small").glob("*.nii"))
    assert np.allclose(volumes.parse_nifti((tmp_path / "out" / "a.nii").read_bytes())[1:], v[1:])


def test_affines_without_a_stored_matrix():
    raw = bytearray(image(np.zeros((4, 4, 4))))
    raw[254:256] = b"\0\0"
    assert np.allclose(np.array(nifti.parse_header(bytes(raw)).affine).reshape(4, 4)[:3, 3], [3.0, -1.5 * np.hypot(2.5, 0.2), -1.5 * np.hypot(3, 0.1)], rtol=1e-6)
    raw[252:254] = np.int16(1).tobytes()
    raw[256:280] = np.array([0, 0, np.sqrt(0.5), 10, 20, 30], "<f4").tobytes()  # a quarter turn around z
    m = np.array(nifti.parse_header(bytes(raw)).affine).reshape(4, 4)
    assert np.allclose(m[:3, 3], [10, 20, 30]) and np.allclose(m[:2, :2], [[0, -np.hypot(2.5, 0.2)], [2.0, 0]], atol=1e-6)
