import gzip

import numpy as np

from axonframe.sources import volumes


def test_round_trip_and_mask(spark, tmp_path):
    v = np.arange(2 * 3 * 4 * 2, dtype=float).reshape(2, 3, 4, 2)
    (tmp_path / "a.nii").write_bytes(volumes.write_nifti(v))
    (tmp_path / "b.nii.gz").write_bytes(gzip.compress(volumes.write_nifti(v[..., 0])))
    rows = volumes.nifti(spark, str(tmp_path)).toPandas()
    a = rows[rows.path.str.endswith("a.nii")]
    assert len(rows) == 48 + 24 and all(v[r.x, r.y, r.z, r.t] == r.value for r in a.itertuples())
    mask = spark.createDataFrame([(0, 0, 0), (1, 2, 3)], "x int, y int, z int")
    assert volumes.nifti(spark, str(tmp_path / "a.nii"), mask).count() == 4
    grid = volumes.nifti(spark, str(tmp_path / "b.nii.gz"))
    assert volumes.mask_of(grid).count() == 23
    betas = spark.createDataFrame([(1, 2, 3, 5.0)], "x int, y int, z int, value double")
    assert volumes.scatter(grid, betas).agg({"value": "sum"}).first()[0] == 5.0


def test_side_files(spark, tmp_path):
    (tmp_path / "e.tsv").write_text("onset\tduration\timage_name\n10\t1\ta\n13.5\t1\tb\n")
    assert [r.onset_rel for r in volumes.events(spark, str(tmp_path / "e.tsv")).orderBy("onset").collect()] == [0.0, 3.5]
    (tmp_path / "m.par").write_text(" 0.1 0.2  -0.3 0 0 1\n")
    assert volumes.motion(spark, str(tmp_path / "m.par")).first().m == [0.1, 0.2, -0.3, 0.0, 0.0, 1.0]
    (tmp_path / "h.tsv").write_text("1\t-4\n2\t2\n")
    got = {(r.k, r.t): r.h for r in volumes.response_library(spark, str(tmp_path / "h.tsv"), 2).collect()}
    assert got == {(0, 0): 0.5, (0, 1): 1.0, (1, 0): -1.0, (1, 1): 0.5}
    cells = spark.createDataFrame([("ols", 1, 0.5), ("ar1", 1, 0.6)], "cell string, trial long, beta double")
    volumes.save_cell(cells, str(tmp_path / "cells"))
    assert spark.read.parquet(str(tmp_path / "cells")).filter("cell = 'ar1'").first().beta == 0.6
