"""Kernels on the sphere: points meet by cells of equal size, and distances are along great circles.

A ring of latitude is ``radius`` high, and is parted into as many cells as are ``radius`` wide at its widest
edge; a point looks for others in the rings beside its own, in the cells of each ring that its reach in
longitude can touch, all of them where a pole is within reach. So pairs grow with the hits, also at the poles and across
the seam, and the join is on equal cells.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from axonframe.plans.session import cut
from axonframe.sources.tables import table


def geodesic(lat: Column, lon: Column, lat2: Column, lon2: Column) -> Column:
    """Angle between two points in radians, by the haversine, which keeps small angles exact."""
    h = F.pow(F.sin((lat2 - lat) / 2), 2) + F.cos(lat) * F.cos(lat2) * F.pow(F.sin((lon2 - lon) / 2), 2)
    return 2 * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def rings(radius: float) -> int:
    return max(1, math.ceil(math.pi / radius))


def ring_of(lat: Column, radius: float) -> Column:
    return F.least(F.floor((lat + math.pi / 2) / radius), F.lit(rings(radius) - 1)).cast("int")


def cells_in(ring: Column, radius: float) -> Column:
    """Cells of a ring: as many as its widest circle has radii, one at least."""
    low, high = ring * radius - math.pi / 2, (ring + 1) * radius - math.pi / 2
    widest = F.when((low <= 0) & (high >= 0), 1.0).otherwise(F.greatest(F.cos(low), F.cos(high)))
    return F.greatest(F.floor(2 * math.pi * widest / radius), F.lit(1)).cast("int")


def cell_of(lon: Column, count: Column) -> Column:
    return F.pmod(F.least(F.floor(F.pmod(lon, F.lit(2 * math.pi)) / (2 * math.pi) * count), count - 1), count).cast("int")


def reached(lat: Column, lon: Column, radius: float) -> Column:
    """All (ring, cell) that hold points within ``radius`` of a point."""
    own = ring_of(lat, radius)
    around = F.filter(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: own + d), lambda r: (r >= 0) & (r < rings(radius)))
    span = F.when(F.abs(lat) + radius >= math.pi / 2, math.pi).otherwise(F.asin(F.least(F.lit(math.sin(radius)) / F.cos(lat), F.lit(1.0))))

    def of(ring: Column) -> Column:
        count = cells_in(ring, radius)
        first, last = F.floor((lon - span) / (2 * math.pi) * count - 1e-9), F.floor((lon + span) / (2 * math.pi) * count + 1e-9)
        every = F.least(last - first + 1, count)
        return F.transform(F.sequence(F.lit(0), (every - 1).cast("int")), lambda k: F.struct(ring.alias("ring"), F.pmod(first + k, count).cast("int").alias("cell")))

    return F.array_distinct(F.flatten(F.transform(around, of)))


def within(points: DataFrame, others: DataFrame, radius: float) -> DataFrame:
    """(id, other, angle) of all pairs within ``radius`` (below a quarter turn) of points (id, lat, lon) and others, a point itself too. Null coordinates meet nothing."""
    if not 0 < radius < math.pi / 2:
        raise ValueError("a radius lies between 0 and a quarter turn")
    fine = lambda df: df.filter("lat IS NOT NULL AND lon IS NOT NULL")
    a = fine(points).withColumn("c", F.explode(reached(F.col("lat"), F.col("lon"), radius))).select("id", "lat", "lon", "c.ring", "c.cell")
    ring = ring_of(F.col("lat"), radius)
    b = fine(others).select(F.col("id").alias("other"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), ring.alias("ring"), cell_of(F.col("lon"), cells_in(ring, radius)).alias("cell"))
    met = a.join(b, ["ring", "cell"]).withColumn("angle", geodesic(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")))
    return met.filter(F.col("angle") <= radius).select("id", "other", "angle")


def gaussian(angle: np.ndarray, scale: float) -> np.ndarray:
    return np.exp(-angle * angle / (2 * scale * scale))


def exponential(angle: np.ndarray, scale: float) -> np.ndarray:
    return np.exp(-angle / scale)


KERNELS = {"gaussian": gaussian, "exponential": exponential}
#: Places of a cell in a tile, and distances that a task holds at a time.
TILE, HELD = 16_384, 1 << 17


def units(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    return np.column_stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)])


def tile_sums(p: np.ndarray, q: np.ndarray, x: np.ndarray, n: np.ndarray, radius: float, kernel: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Columns of sums over the places q (unit vectors) within ``radius`` of each of p: kernel by x, kernel by n, and n."""
    out, step, both = np.zeros((len(p), 3)), max(1, HELD // max(len(q), 1)), np.column_stack([x, n])
    for a in range(0, len(p), step):
        rows = p[a : a + step]
        c = rows @ q.T
        hit = np.flatnonzero(c >= math.cos(radius) - 1e-12)
        h = (1 - c.ravel()[hit]) / 2
        close = np.flatnonzero(h < 1e-4)  # there the product has lost its digits
        row, other = np.divmod(hit[close], len(q))
        h[close] = ((rows[row] - q[other]) ** 2).sum(1) / 4
        angle = 2 * np.arcsin(np.sqrt(h))
        inside = angle <= radius
        c[:] = 0
        c.ravel()[hit] = inside
        out[a : a + step, 2] = c @ n
        c.ravel()[hit] = kernel(angle) * inside
        out[a : a + step, :2] = c @ both
    return out


def convolved(points: DataFrame, value: str, radius: float, scale: float, kernel: str = "gaussian") -> DataFrame:
    """(id, v, n): the kernel mean of ``value`` over all points within ``radius``, and how many these are. Null values weigh nothing.

    Pairs grow with the square of the points' density, so none is a row: a place (points of one place are one) goes to the cells
    it can reach, and a cell's own places meet these in tiles of a bounded size, which give sums only.
    """
    if not 0 < radius < math.pi / 2:
        raise ValueError("a radius lies between 0 and a quarter turn")
    weigh = KERNELS[kernel]
    fine = points.filter("lat IS NOT NULL AND lon IS NOT NULL").select("id", "lat", "lon", F.col(value).cast("double").alias("x"))
    ring = ring_of(F.col("lat"), radius)
    own = F.struct(ring.alias("ring"), cell_of(F.col("lon"), cells_in(ring, radius)).alias("cell"))
    found = cut(fine.groupBy("lat", "lon").agg(F.coalesce(F.sum("x"), F.lit(0.0)).alias("x"), F.count("x").cast("double").alias("n")).withColumn("own", own))
    most = found.groupBy("own").count().agg(F.max("count")).first()[0] or 0
    slices = max(1, -(-most // TILE))
    part, every = F.pmod(F.xxhash64("lat", "lon"), F.lit(slices)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))
    near = found.filter("n > 0").select(F.lit(False).alias("centre"), "lat", "lon", "x", "n", F.explode(reached(F.col("lat"), F.col("lon"), radius)).alias("at"), part.alias("b"))
    centres = found.select(F.lit(True).alias("centre"), "lat", "lon", "x", "n", F.col("own").alias("at"), part.alias("a"))
    tiles = near.select("*", every.alias("a")).unionByName(centres.select("*", every.alias("b")))

    def run(tile: pa.Table) -> pa.Table:
        centre, lat, lon, x, n = (tile.column(c).to_numpy() for c in ("centre", "lat", "lon", "x", "n"))
        u = units(lat, lon)
        sums = tile_sums(u[centre], u[~centre], x[~centre], n[~centre], radius, lambda angle: weigh(angle, scale))
        return pa.table({"lat": lat[centre], "lon": lon[centre], **{k: sums[:, c] for c, k in enumerate(("wx", "w", "n"))}})

    sums = tiles.groupBy("at.ring", "at.cell", "a", "b").applyInArrow(run, "lat double, lon double, wx double, w double, n double")
    whole = sums.groupBy("lat", "lon").agg(F.sum("wx").alias("wx"), F.sum("w").alias("w"), F.sum("n").cast("long").alias("n")).filter("n > 0")
    rows = fine.select("id", "lat", "lon").join(whole.hint("merge"), ["lat", "lon"])
    return rows.groupBy("id").agg((F.sum("wx") / F.sum("w")).alias("v"), F.sum("n").alias("n"))


def _points(spark: SparkSession, d: str) -> DataFrame:
    """Customers on the sphere, by their keys: even over its area."""
    k = F.col("c_custkey")
    lat = F.asin(2 * (k * 7919 % 100_003) / 100_003.0 - 1)
    return table(spark, d, "customer").select(k.alias("id"), lat.alias("lat"), (2 * math.pi * (k * 104_729 % 99_991) / 99_991.0 - math.pi).alias("lon"), F.col("c_acctbal").cast("double").alias("x"))


RADIUS, SCALE = 0.12, 0.05


def sphere_smooth(spark: SparkSession, d: str) -> DataFrame:
    return convolved(_points(spark, d), "x", RADIUS, SCALE).select("id", F.round("v", 5).alias("v"), "n")


QUERIES = {"sphere_smooth": sphere_smooth}
ORACLES = {
    "sphere_smooth": f"""WITH p AS (SELECT c_custkey AS id, asin(2 * (c_custkey * 7919 % 100003) / 100003.0::DOUBLE - 1) AS lat, 2 * pi() * (c_custkey * 104729 % 99991) / 99991.0::DOUBLE - pi() AS lon, c_acctbal::DOUBLE AS x FROM customer),
        q AS (SELECT a.id, b.x, 2 * asin(sqrt(least(sin((b.lat - a.lat) / 2) ** 2 + cos(a.lat) * cos(b.lat) * sin((b.lon - a.lon) / 2) ** 2, 1.0))) AS angle FROM p a JOIN p b ON abs(a.lat - b.lat) <= {RADIUS} + 1e-9)
        SELECT id, round(sum(exp(-angle * angle / {2 * SCALE * SCALE!r}) * x) / sum(exp(-angle * angle / {2 * SCALE * SCALE!r})), 5) AS v, count(*) AS n FROM q WHERE angle <= {RADIUS} GROUP BY id""",
}
