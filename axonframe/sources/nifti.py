"""NIfTI-1 images as Spark data sources: ``nifti`` (voxels, read and written) and ``nifti_headers`` (one row a file).

    register(spark)
    spark.read.format("nifti").schema("session string, t int, value double").load("/data/*/func").filter("t < 10")

Reading is planned from headers alone: a few hundred bytes a file give shape, type and scale, and files
are cut into slabs of whole planes, so an image of any size is read by several tasks. Only the columns
of the schema that is asked for are made. Filters on names (path, subject, session, task, run) drop
files, those on t and z planes, before anything is read; those on x, y and value drop voxels as they
are read. A mask image (option ``mask``: .nii, .nii.gz or .npy; ``mask_count``: how many voxels it must have) does the
same. Compressed files can't be cut, so each is one task.

Writing needs the rows of an image in one task, sorted by t; ``save`` sees to it, and two tasks with one image
are an error. Volumes go out one by one to temporary names, which the commit renames.

Files are opened through Arrow's file systems (local, HDFS, object stores). ``volumes.nifti`` reads what only
Spark can reach. Filters are pushed if ``spark.sql.python.filterPushdown.enabled`` is set, as ``register`` does.
"""

from __future__ import annotations

import fnmatch
import functools
import gzip
import re
import uuid
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Fixed values of the format: data type codes.
TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}
VOXELS = "path string, subject string, session string, task string, run int, x int, y int, z int, t int, value double"
HEADERS = "path string, subject string, session string, task string, run int, shape array<int>, zooms array<double>, dtype string, affine array<double>, slope double, inter double, bytes long"
NAMES = {"subject": r"sub-([A-Za-z0-9]+)", "session": r"ses-([A-Za-z0-9]+)", "task": r"task-([A-Za-z0-9]+)", "run": r"run[-_]?(\d+)"}
AXES = ("x", "y", "z", "t")
ARROW = {"path": pa.string(), "subject": pa.string(), "session": pa.string(), "task": pa.string(), "run": pa.int32(), **{a: pa.int32() for a in AXES}, "value": pa.float64()}


@dataclass(frozen=True)
class Header:
    shape: tuple[int, ...]
    kind: str
    zooms: tuple[float, ...]
    offset: int
    slope: float
    inter: float
    affine: tuple[float, ...]

    @property
    def grid(self) -> tuple[int, int, int, int]:
        return (*self.shape, 1, 1, 1, 1)[:4] if len(self.shape) <= 4 else (*self.shape[:3], int(np.prod(self.shape[3:])))


def parse_header(raw: bytes) -> Header:
    order = next((o for o in "<>" if len(raw) >= 348 and int(np.frombuffer(raw, f"{o}i4", 1)[0]) == 348), None)
    if order is None:
        raise ValueError("not a NIfTI-1 file")
    of = lambda kind, at, n: np.frombuffer(raw, order + kind, n, at)
    dim, pixdim = of("i2", 40, 8).astype(int), of("f4", 76, 8).astype(float)
    shape = tuple(int(n) for n in dim[1 : dim[0] + 1])
    offset, slope, inter = of("f4", 108, 3).astype(float)
    code = int(of("i2", 70, 1)[0])
    if code not in TYPES:
        raise ValueError(f"data type {code} is not read")
    return Header(shape, order + TYPES[code], tuple(pixdim[1 : 1 + len(shape)]), int(offset), slope or 1.0, inter if slope else 0.0, tuple(affine_of(of, pixdim, shape).ravel()))


def affine_of(of, pixdim: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """Voxel to world: the stored matrix, else the rotation and offset, else the zooms around the middle of the grid."""
    qform, sform = of("i2", 252, 2)
    m = np.eye(4)
    if sform > 0:
        m[:3] = of("f4", 280, 12).reshape(3, 4)
        return m
    zooms = np.array([*pixdim[1:4]])
    if qform > 0:
        b, c, d, *at = of("f4", 256, 6).astype(float)
        a = max(0.0, 1 - b * b - c * c - d * d) ** 0.5
        turn = np.array([[a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)], [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)], [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c]])
        m[:3, :3], m[:3, 3] = turn * zooms * [1, 1, -1 if pixdim[0] < 0 else 1], at
        return m
    zooms = zooms * [-1, 1, 1]
    m[:3, :3], m[:3, 3] = np.diag(zooms), -zooms * ([(n - 1) / 2 for n in shape[:3]] + [0, 0, 0])[:3] if len(shape) < 3 else -zooms * (np.array(shape[:3]) - 1) / 2
    return m


def header_bytes(shape: tuple[int, ...], affine: Iterable[float], kind: str) -> bytes:
    """352 bytes of a little-endian single-file image."""
    m = np.array(list(affine), float).reshape(4, 4)
    head = bytearray(352)
    code = next(c for c, k in TYPES.items() if k == kind)
    zooms = np.sqrt((m[:3, :3] ** 2).sum(0))
    for at, value in ((0, np.array([348], "<i4")), (40, np.array([len(shape), *shape, *[1] * (7 - len(shape))], "<i2")), (70, np.array([code, np.dtype(kind).itemsize * 8], "<i2")),
                      (76, np.array([1, *zooms, 1, 1, 1, 1], "<f4")), (108, np.array([352, 1, 0], "<f4")), (252, np.array([0, 1], "<i2")), (280, m[:3].astype("<f4").ravel())):
        head[at : at + value.nbytes] = value.tobytes()
    head[344:348] = b"n+1\0"
    return bytes(head)


def located(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def listed(path: str, ends: tuple[str, ...] = (".nii", ".nii.gz")) -> list[str]:
    """Files of a folder, a pattern or a single name, in order."""
    store, name = located(path.split("*")[0].rpartition("/")[0] or "/") if "*" in path else located(path)
    if "*" not in path and store.get_file_info(name).type == pafs.FileType.File:
        return [path]
    scheme = path[: path.index("://") + 3] if "://" in path else ""
    found = sorted(i.path for i in store.get_file_info(pafs.FileSelector(name, recursive=True)) if i.type == pafs.FileType.File and i.path.endswith(ends))
    if "*" in path:
        wanted = path.removeprefix(scheme)
        found = [p for p in found if fnmatch.fnmatch(p, wanted) or fnmatch.fnmatch(p, wanted.rstrip("/") + "/*")]
    return [scheme + p for p in found]


def opened(path: str):
    store, name = located(path)
    return store.open_input_stream(name, compression=None) if path.endswith(".gz") else store.open_input_file(name)


def header(path: str) -> Header:
    with opened(path) as f:
        if path.endswith(".gz"):
            with gzip.open(f) as g:
                return parse_header(g.read(352))
        return parse_header(f.read(352))


def headers(paths: list[str]) -> list[Header]:
    with ThreadPoolExecutor(32) as pool:
        return list(pool.map(header, paths))


def names_in(path: str) -> dict[str, str | int | None]:
    """What the last match of each name in a path says."""
    found = {k: re.findall(rule, path) for k, rule in NAMES.items()}
    return {k: (int(v[-1]) if k == "run" else v[-1]) if v else None for k, v in found.items()}


@functools.lru_cache(4)
def mask_volume(path: str, count: int | None) -> np.ndarray:
    """(x, y, z) BOOLEAN of a mask image or array; its voxels are counted if their number is given."""
    with opened(path) as f:
        if path.endswith(".npy"):
            mask = np.load(pa.BufferReader(f.read())) != 0
        else:
            raw = gzip.decompress(f.read()) if path.endswith(".gz") else f.read()
            h = parse_header(raw)
            mask = np.frombuffer(raw, h.kind, int(np.prod(h.grid[:3])), h.offset).reshape(h.grid[:3], order="F") != 0
    if count is not None and int(mask.sum()) != count:
        raise ValueError(f"mask {path} has {int(mask.sum())} voxels, not {count}")
    return mask


TESTS = {D.EqualTo: "==", D.GreaterThan: ">", D.GreaterThanOrEqual: ">=", D.LessThan: "<", D.LessThanOrEqual: "<="}


def passes(op: str, values, bound):
    return {"==": lambda: values == bound, "!=": lambda: values != bound, ">": lambda: values > bound, ">=": lambda: values >= bound, "<": lambda: values < bound, "<=": lambda: values <= bound, "in": lambda: np.isin(values, bound)}[op]()


@dataclass
class Slab(D.InputPartition):
    """Runs of planes (first, count) of a file."""

    path: str
    header: Header | None = None
    runs: list[tuple[int, int]] = field(default_factory=list)


class VoxelReader(D.DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.options, self.names = dict(options), [f.name for f in schema]
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        for f in filters:
            plain, op = (f.child, "!=") if isinstance(f, D.Not) and isinstance(f.child, D.EqualTo) else (f, TESTS.get(type(f)))
            name = plain.attribute[0] if getattr(plain, "attribute", None) and len(plain.attribute) == 1 else None
            if name in ARROW and op:
                self.tests.append((name, op, plain.value))
            elif name in ARROW and isinstance(f, D.In):
                self.tests.append((name, "in", list(f.value)))
            elif not (isinstance(f, D.IsNotNull) and name in (*AXES, "value", "path")):
                yield f

    def kept(self, axis: str, n: int) -> np.ndarray:
        ok = np.ones(n, bool)
        for name, op, bound in self.tests:
            if name == axis:
                ok &= passes(op, np.arange(n), bound)
        return ok

    def partitions(self) -> list[Slab]:
        """Slabs of about ``slab_bytes``; files whose names don't pass aren't opened."""
        most, wanted = int(self.options.get("slab_bytes", 64 << 20)), []
        for path in listed(self.options["path"]):
            own = names_in(path) | {"path": path}
            if all(own[name] is not None and bool(passes(op, np.array(own[name]), bound)) for name, op, bound in self.tests if name in own):
                wanted.append(path)
        slabs = []
        for path, h in zip(wanted, headers(wanted), strict=True):
            nx, ny, nz, nt = h.grid
            planes = np.flatnonzero((self.kept("t", nt)[:, None] & self.kept("z", nz)[None, :]).ravel())
            if not len(planes):
                continue
            size = len(planes) if path.endswith(".gz") else max(1, most // max(1, nx * ny * np.dtype(h.kind).itemsize))
            for a in range(0, len(planes), size):
                part = planes[a : a + size]
                edges = np.flatnonzero(np.diff(part) != 1) + 1
                slabs.append(Slab(path, h, [(int(r[0]), len(r)) for r in np.split(part, edges)]))
        return slabs or [Slab("")]

    def read(self, slab: Slab) -> Iterator[pa.RecordBatch]:
        if not slab.path:
            return
        h, own = slab.header, names_in(slab.path) | {"path": slab.path}
        nx, ny, nz, _ = h.grid
        plane = nx * ny * np.dtype(h.kind).itemsize
        mask = mask_volume(self.options["mask"], int(self.options["mask_count"]) if "mask_count" in self.options else None) if "mask" in self.options else None
        if mask is not None and mask.shape != (nx, ny, nz):
            raise ValueError(f"mask of shape {mask.shape} for an image of shape {h.grid[:3]}")
        inner = self.kept("y", ny)[:, None] & self.kept("x", nx)[None, :]
        at_once = max(1, 500_000 // max(1, nx * ny))
        with opened(slab.path) as f:
            source = gzip.open(f) if slab.path.endswith(".gz") else f
            for first, count in slab.runs:
                source.seek(h.offset + first * plane)
                for a in range(first, first + count, at_once):
                    n = min(at_once, first + count - a)
                    values = np.frombuffer(source.read(n * plane), h.kind).reshape(n, ny, nx).astype(float) * h.slope + h.inter
                    t, z = np.divmod(np.arange(a, a + n), nz)
                    ok = np.broadcast_to(inner, values.shape).copy()
                    if mask is not None:
                        ok &= mask.transpose(2, 1, 0)[z]
                    for name, op, bound in self.tests:
                        if name == "value":
                            ok &= passes(op, values, bound)
                    k, y, x = np.nonzero(ok)
                    made = {"x": lambda: x, "y": lambda: y, "z": lambda: z[k], "t": lambda: t[k], "value": lambda: values[ok]}  # noqa: B023
                    columns = [pa.array(made[c]().astype(ARROW[c].to_pandas_dtype())) if c in made else pa.array([own[c]] * len(k), ARROW[c]) for c in self.names]
                    yield pa.RecordBatch.from_arrays(columns, self.names)


class VoxelWriter(D.DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite, self.job = options["path"].rstrip("/"), overwrite, uuid.uuid4().hex
        self.shape = tuple(int(n) for n in options["shape"].split(","))
        self.affine = [float(v) for v in options.get("affine", "1,0,0,0,0,1,0,0,0,0,1,0,0,0,0,1").split(",")]
        self.kind = options.get("dtype", "f4")

    def write(self, batches: Iterator[pa.RecordBatch]) -> D.WriterCommitMessage:
        nx, ny, nz, nt = (*self.shape, 1)[:4]
        store, folder = located(f"{self.path}/_temporary-{self.job}")
        done: list[tuple[str, str]] = []
        out, image, at, volume = None, None, 0, np.zeros(nx * ny * nz, self.kind)

        def through(t: int) -> None:
            nonlocal at
            while at < t:
                out.write(volume.tobytes())
                volume[:] = 0
                at += 1

        def close() -> None:
            if out is not None:
                through(nt)
                out.close()

        for b in batches:
            names = b.column("image").to_pylist()
            x, y, z, t = (b.column(c).to_numpy().astype(np.int64) for c in AXES)
            if (np.stack([x, y, z, t]) < 0).any() or (x >= nx).any() or (y >= ny).any() or (z >= nz).any() or (t >= nt).any():
                raise ValueError(f"a voxel lies outside of {(nx, ny, nz, nt)}")
            value, cell = b.column("value").to_numpy(), x + nx * (y + ny * z)
            edges = [0, *(i for i in range(1, len(t)) if names[i] != names[i - 1] or t[i] != t[i - 1]), len(t)]
            for a, e in zip(edges[:-1], edges[1:], strict=True):
                if a == e:
                    continue
                if names[a] != image:
                    close()
                    image, at = names[a], 0
                    if image in {i for i, _ in done}:
                        raise ValueError(f"rows of {image} aren't together")
                    store.create_dir(folder, recursive=True)
                    name = f"{folder}/{uuid.uuid4().hex}"
                    done.append((image, name))
                    out = store.open_output_stream(name, compression=None)
                    out.write(header_bytes(self.shape, self.affine, self.kind))
                if t[a] < at:
                    raise ValueError(f"rows of {image} aren't sorted by t")
                through(int(t[a]))
                volume[cell[a:e]] = value[a:e]
        close()
        message = D.WriterCommitMessage()
        message.done = done
        return message

    def commit(self, messages: list[D.WriterCommitMessage | None]) -> None:
        done = [x for m in messages if m for x in m.done]
        if len({image for image, _ in done}) < len(done):
            self.abort(messages)
            raise ValueError("an image has rows in several tasks; use save")
        store, folder = located(self.path)
        taken = [image for image, _ in done if store.get_file_info(f"{folder}/{image}.nii").type != pafs.FileType.NotFound]
        if taken and not self.overwrite:
            self.abort(messages)
            raise ValueError(f"{taken[0]} is there already")
        for image, name in done:
            store.move(name, f"{folder}/{image}.nii")
        self.clear()

    def abort(self, messages: list[D.WriterCommitMessage | None]) -> None:
        self.clear()

    def clear(self) -> None:
        store, folder = located(f"{self.path}/_temporary-{self.job}")
        if store.get_file_info(folder).type == pafs.FileType.Directory:
            store.delete_dir(folder)


class Nifti(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "nifti"

    def schema(self) -> str:
        return VOXELS

    def reader(self, schema: StructType) -> VoxelReader:
        return VoxelReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> VoxelWriter:
        return VoxelWriter(dict(self.options), overwrite)


@dataclass
class Files(D.InputPartition):
    paths: list[str]


class HeaderReader(D.DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.options, self.names = dict(options), [f.name for f in schema]

    def partitions(self) -> list[Files]:
        paths, n = listed(self.options["path"]), int(self.options.get("files", 200))
        return [Files(paths[a : a + n]) for a in range(0, max(1, len(paths)), n)]

    def read(self, part: Files) -> Iterator[tuple]:
        for path, h in zip(part.paths, headers(part.paths), strict=True):
            size = int(np.prod(h.shape)) * np.dtype(h.kind).itemsize
            row = names_in(path) | {"path": path, "shape": list(h.shape), "zooms": [float(z) for z in h.zooms], "dtype": h.kind[1:], "affine": [float(v) for v in h.affine], "slope": float(h.slope), "inter": float(h.inter), "bytes": size}
            yield tuple(row[c] for c in self.names)


class NiftiHeaders(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "nifti_headers"

    def schema(self) -> str:
        return HEADERS

    def reader(self, schema: StructType) -> HeaderReader:
        return HeaderReader(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Nifti)
    spark.dataSource.register(NiftiHeaders)


def voxels(spark: SparkSession, path: str, columns: str = VOXELS, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("nifti").schema(columns).options(**options).load(path)


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(subject, session, branch, runs, first, shape, zooms): the images of each folder of a session, from headers alone."""
    register(spark)
    rows = spark.read.format("nifti_headers").load(path).withColumn("branch", F.element_at(F.split("path", "/"), -2))
    return rows.groupBy("subject", "session", "branch").agg(F.count("*").alias("runs"), F.min_by(F.struct("path", "shape", F.slice("zooms", 1, 3).alias("zooms")), "path").alias("x"), F.sum("bytes").alias("bytes")).select("subject", "session", "branch", "runs", F.element_at(F.split("x.path", "/"), -1).alias("first"), "x.shape", "x.zooms", "bytes")


def save(rows: DataFrame, path: str, shape: tuple[int, int, int], affine: Iterable[float] | None = None, dtype: str = "f4", overwrite: bool = False) -> None:
    """Rows (image, x, y, z, t, value) as one file for each image, 0 where no row is; all get as many volumes as the longest."""
    register(rows.sparkSession)
    volumes = (rows.agg(F.max("t")).first()[0] or 0) + 1
    placed = rows.select("image", *AXES, F.col("value").cast("double").alias("value")).repartition("image").sortWithinPartitions("image", "t")
    w = placed.write.format("nifti").option("shape", ",".join(map(str, (*shape, volumes)))).option("dtype", dtype)
    if affine is not None:
        w = w.option("affine", ",".join(repr(float(v)) for v in np.array(list(affine), float).ravel()))
    w.mode("overwrite" if overwrite else "append").save(path)
