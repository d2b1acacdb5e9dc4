"""Volumes and side files: NIfTI-1 images to voxel rows and back, event and motion tables, masks.

Files are listed and read by Spark (``binaryFile``, ``csv``, ``text``), so any store works and each file is
a task's work. An image must fit a task's memory; that is one run of one session.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed values of the format: data type codes.
TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}
VOXELS = "path string, x int, y int, z int, t int, value double"


def parse_nifti(content: bytes) -> np.ndarray:
    """The image as doubles with 4 axes, scaled as its header says."""
    raw = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    order = "<" if int(np.frombuffer(raw, "<i4", 1)[0]) == 348 else ">"
    if int(np.frombuffer(raw, f"{order}i4", 1)[0]) != 348:
        raise ValueError("not a NIfTI-1 file")
    dim = np.frombuffer(raw, f"{order}i2", 8, 40).astype(int)
    code = int(np.frombuffer(raw, f"{order}i2", 1, 70)[0])
    offset, slope, inter = np.frombuffer(raw, f"{order}f4", 3, 108)
    shape = tuple(int(n) for n in dim[1 : dim[0] + 1])
    data = np.frombuffer(raw, f"{order}{TYPES[code]}", int(np.prod(shape)), int(offset)).astype(float)
    if slope not in (0.0, 1.0) or inter != 0:
        data = data * (slope or 1.0) + inter
    return data.reshape(shape + (1,) * (4 - len(shape)), order="F")


def write_nifti(volume: np.ndarray) -> bytes:
    """A little-endian single-file image of doubles."""
    v = np.asarray(volume, float)
    head = bytearray(352)
    head[0:4] = np.int32(348).tobytes()
    head[40:56] = np.array([v.ndim, *v.shape, *[1] * (7 - v.ndim)], "<i2").tobytes()
    head[70:74] = np.array([64, 64], "<i2").tobytes()
    head[76:108] = np.ones(8, "<f4").tobytes()
    head[108:120] = np.array([352, 1, 0], "<f4").tobytes()
    head[344:348] = b"n+1\0"
    return bytes(head) + v.astype("<f8").tobytes(order="F")


def nifti(spark: SparkSession, path: str, mask: DataFrame | None = None) -> DataFrame:
    """Voxel rows of all images under ``path``; with ``mask`` (x, y, z) only those inside, ``t`` counts volumes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, content in zip(b["path"], b["content"], strict=True):
                v = parse_nifti(bytes(content))
                for t in range(v.shape[3]):
                    x, y, z = (a.ravel().astype(np.int32) for a in np.indices(v.shape[:3]))
                    yield pd.DataFrame({"path": p, "x": x, "y": y, "z": z, "t": np.int32(t), "value": v[..., t].ravel()})

    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, VOXELS)
    return rows if mask is None else rows.join(mask.select("x", "y", "z"), ["x", "y", "z"], "left_semi").select("path", "x", "y", "z", "t", "value")


def mask_of(voxels: DataFrame) -> DataFrame:
    """(x, y, z) of the voxels that aren't 0."""
    return voxels.filter("value <> 0").select("x", "y", "z").distinct()


def scatter(grid: DataFrame, betas: DataFrame) -> DataFrame:
    """Betas back on the whole grid, 0 outside."""
    return grid.select("x", "y", "z").join(betas, ["x", "y", "z"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def events(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated events with the onset relative to the first of the file."""
    rows = spark.read.schema("onset double, duration double, image_name string").option("header", True).option("sep", "\t").csv(path).withColumn("path", F.col("_metadata.file_path"))
    return rows.withColumn("onset_rel", F.col("onset") - F.min("onset").over(W.partitionBy("path")))


def motion(spark: SparkSession, path: str) -> DataFrame:
    """(path, m ARRAY<DOUBLE>) of white-space separated parameter rows."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.split(F.trim("value"), r"\s+").alias("p"))
    return rows.filter(F.size("p") > 1).select("path", F.transform("p", lambda c: c.cast("double")).alias("m"))


def response_library(spark: SparkSession, path: str, columns: int) -> DataFrame:
    """(k, t, h) of a tab-separated table of responses, each scaled to a peak of 1."""
    schema = ", ".join(f"c{k} double" for k in range(columns))
    rows = spark.read.schema(schema).option("sep", "\t").csv(path).withColumn("row", F.monotonically_increasing_id())
    long = rows.select("row", F.posexplode(F.array(*(F.col(f"c{k}") for k in range(columns)))).alias("k", "v"))
    return long.select("k", (F.row_number().over(W.partitionBy("k").orderBy("row")) - 1).alias("t"), (F.col("v") / F.max(F.abs("v")).over(W.partitionBy("k"))).alias("h"))


def save_cell(betas: DataFrame, path: str) -> None:
    """Betas by cell as Parquet, one folder for each cell."""
    betas.write.mode("overwrite").partitionBy("cell").parquet(path)
