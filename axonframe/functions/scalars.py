"""Scalar helpers as columns: parts of paths, times in names, linear resampling, reshaped arrays, lookups in small maps."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from axonframe.sources.series import day_number
from axonframe.sources.tables import table


def basename(path: Column) -> Column:
    """What follows the last slash, query and fragment left out."""
    return F.regexp_extract(path, r"([^/?#]*)(?:[?#].*)?$", 1)


def stem(path: Column) -> Column:
    """The name without its endings: ``a.nii.gz`` gives ``a``."""
    return F.regexp_extract(basename(path), r"^\.*[^.]*", 0)


def stamped(name: Column) -> Column:
    """The time of a name with YYYYMMDD-HHMMSS or YYYYMMDD_HHMMSS; null without one."""
    found = F.regexp_extract(name, r"(\d{8})[-_](\d{6})", 0)
    return F.try_to_timestamp(F.regexp_replace(found, "_", "-"), F.lit("yyyyMMdd-HHmmss"))


def resampled(values: Column, step: float, points: int, new_step: float) -> Column:
    """Values ``step`` apart, read every ``new_step`` by straight lines; beyond the last value that one."""
    last = F.size(values) - 1

    def read(i: Column) -> Column:
        at = F.least(i * new_step / step, last.cast("double"))
        low = F.floor(at).cast("int")
        a, b = F.element_at(values, low + 1), F.element_at(values, F.least(low + 1, last) + 1)
        return a + (b - a) * (at - low)

    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), read)


def reshaped(values: Column, width: int) -> Column:
    """Rows of ``width`` values; a last row that isn't full is left out."""
    rows = F.floor(F.size(values) / width).cast("int")
    return F.transform(F.filter(F.sequence(F.lit(0), rows), lambda r: r < rows), lambda r: F.slice(values, r * width + 1, F.lit(width)))


def looked_up(key: Column, known: Mapping, default: object) -> Column:
    """The value of a key in a small fixed map."""
    if not known:
        return F.lit(default)
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in known.items() for x in pair)), key), F.lit(default))


WEIGHTS = {"click": 1, "purchase": 5, "signup": 3}


def path_parts(spark: SparkSession, d: str) -> DataFrame:
    named = F.concat(F.col("url"), F.lit("/run"), (F.col("page_id") % 9).cast("string"), F.lit("_2024"), F.lpad((F.col("page_id") % 12 + 1).cast("string"), 2, "0"), F.lit("05-101500.nii.gz"))
    name = F.when(F.col("page_id") % 2 == 0, named).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", basename(name).alias("name"), stem(name).alias("stem"), F.date_format(stamped(name), "yyyy-MM-dd HH:mm:ss").alias("at"))


def resample_linear(spark: SparkSession, d: str) -> DataFrame:
    """Patterns read at every one and a half places, 40 points."""
    v = resampled(F.col("embedding").cast("array<double>"), 1.0, 40, 1.5)
    return table(spark, d, "embeddings").select("vec_id", F.posexplode(v).alias("i", "v")).select("vec_id", F.col("i").cast("long").alias("i"), F.round("v", 6).alias("v"))


def reshape_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = reshaped(F.col("embedding").cast("array<double>"), 10)
    total = F.aggregate("row", F.lit(0.0), lambda s, x: s + x)
    return table(spark, d, "embeddings").select("vec_id", F.posexplode(rows).alias("r", "row")).select("vec_id", F.col("r").cast("long").alias("r"), F.size("row").cast("long").alias("n"), F.round(total, 5).alias("total"))


def map_lookup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(day_number().alias("day")).agg(F.sum(looked_up(F.col("event_type"), WEIGHTS, 0)).alias("weight"))


QUERIES = {f.__name__: f for f in (path_parts, resample_linear, reshape_rows, map_lookup)}
ORACLES = {
    "path_parts": r"""WITH p AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url || '/run' || page_id % 9 || '_2024' || lpad(CAST(page_id % 12 + 1 AS VARCHAR), 2, '0') || '05-101500.nii.gz' ELSE url END AS u FROM pages),
        n AS (SELECT page_id, u, regexp_extract(u, '([^/?#]*)([?#].*)?$', 1) AS name FROM p)
        SELECT page_id, name, regexp_extract(name, '^\.*[^.]*') AS stem, strftime(try_strptime(replace(regexp_extract(u, '\d{8}[-_]\d{6}'), '_', '-'), '%Y%m%d-%H%M%S'), '%Y-%m-%d %H:%M:%S') AS at FROM n""",
    "resample_linear": """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), r AS (SELECT vec_id, v, i, least(i * 1.5, len(v) - 1) AS p FROM e, range(40) r(i))
        SELECT vec_id, i, round(v[CAST(floor(p) AS INT) + 1] + (v[CAST(least(floor(p) + 1, len(v) - 1) AS INT) + 1] - v[CAST(floor(p) AS INT) + 1]) * (p - floor(p)), 6) AS v FROM r""",
    "reshape_rows": "SELECT vec_id, r, 10::BIGINT AS n, round(list_sum(CAST(embedding AS DOUBLE[])[r * 10 + 1 : r * 10 + 10]), 5) AS total FROM embeddings, range(6) t(r)",
    "map_lookup": """SELECT date_diff('day', DATE '2023-12-31', CAST(ts AS DATE)) AS day, CAST(sum(CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN 5 WHEN 'signup' THEN 3 ELSE 0 END) AS BIGINT) AS weight FROM events GROUP BY 1""",
}
