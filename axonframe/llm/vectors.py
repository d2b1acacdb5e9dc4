"""What the vector operators share: valid vectors, rotations and groups of sorted batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid_vectors(rows: DataFrame, *more: str) -> DataFrame:
    """(vec_id, *more, v): one row per id with a vector that takes part, as doubles.

    Null and zero vectors and those with a null or non-finite component take no part, nor do null
    ids. Of rows that repeat an id the least (by vector, then by the other columns) counts.
    """
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    kept = rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(fine)
    return kept.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(F.struct(v.alias("v"), *more)).alias("x")).select("vec_id", *(f"x.{c}" for c in more), "x.v")


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equally long lists."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """The runs of rows with equal keys in batches that are sorted by them. Holds one run at a time."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(b.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        edges = [0, *(np.flatnonzero(change) + 1).tolist(), b.num_rows]
        for a, z in zip(edges[:-1], edges[1:], strict=True):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield last, pa.Table.from_batches(held)
                held = []
            held.append(b.slice(a, z - a))
            last = key
    if held:
        yield last, pa.Table.from_batches(held)


def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))
