"""Mixing sources to target weights by systematic sampling, in DataFrame functions alone.

Each document expects ``rate = target / size`` copies of its source. With the expected copies summed
up in a fixed order within the source and one random offset u, a document is emitted once for each
integer boundary that its stretch of the sum crosses: ``floor(rate * i + u) - floor(rate * (i - 1) + u)``
for the i-th document (the running sum of equal rates is taken as a product, so it has no drift).

The order is by size band, then by a salt (a hash of id and size), then by size and id. So the words taken come
near the target at every size, and no source is numbered in one task: documents are numbered within
(source, band, salt) cells, and only the cells' counts are summed up along a source. The number of
salts grows with the root of the number of documents.

Defined results: null text has size 0, and so has a source of empty texts, which gets target 0. Null
sources are one source, the last; null ids sort first. Equal rows share out their copies among
themselves. An empty table gives an empty result. Very long texts are
only counted. Extra columns of any name are not read by ``shares`` and kept by ``mixed``. Reruns agree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from axonframe.llm.text import WORD
from axonframe.plans.session import cut


@dataclass(frozen=True)
class Settings:
    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5
    most: int = 2
    seed: str = "mix"


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def salts(rows: int) -> int:
    return 32 * max(1, round((rows / 1e6) ** 0.5))


def targets(sources: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Adds ``target`` to (__source, source_size): shares by weight, capped, the excess reshared until none is above.

    That ends where one level per unit of weight fits: sources are taken by their cap per weight, and
    the level is what the capped ones leave, divided by the weights of the rest. One row per source.
    """
    by_name = W.orderBy(F.col("__source").asc_nulls_last())
    k = (F.row_number().over(by_name) - 1) % len(s.weights)
    weighted = sources.withColumn("__w", F.element_at(F.array(*map(F.lit, s.weights)), k + 1)).withColumn("__cap", s.most * F.col("source_size"))
    order = W.orderBy(F.col("__cap") / F.col("__w"), F.col("__source").asc_nulls_last())
    before, whole = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    level = (s.share * F.sum("source_size").over(whole) - F.coalesce(F.sum("__cap").over(before), F.lit(0))) / (F.sum("__w").over(whole) - F.coalesce(F.sum("__w").over(before), F.lit(0)))
    leveled = weighted.withColumn("__level", level).withColumn("__at", F.row_number().over(order))
    fits = F.when(F.col("__level") <= F.col("__cap") / F.col("__w"), F.struct("__at", "__level"))
    return leveled.withColumn("__level", F.min(fits).over(whole)["__level"]).select(
        "__source", "source_size", F.least(F.col("__cap").cast("double"), F.col("__w") * F.col("__level")).alias("target")
    )


def allot(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``docs``, which has doc_id, source and __size, with __source_size, __target and __copies. All other columns are kept."""
    n = salts(docs.select("doc_id").count())
    digits = F.length(F.bin("__size"))
    band = digits * 8 + F.expr("shiftright(__size, greatest(length(bin(__size)) - 3, 0))")
    keys = ["__source", "__band", "__salt"]
    of_row = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("__size").cast("string"))), 1, 8), 16, 10).cast("long")
    placed = docs.withColumns({"__source": F.col("source"), "__band": band.cast("int"), "__salt": F.pmod(of_row, F.lit(n)).cast("int")})
    cells = placed.groupBy(*keys).agg(F.count("*").alias("__n"), F.sum("__size").alias("__sum"))
    wanted = targets(cells.groupBy("__source").agg(F.sum("__sum").alias("source_size")), s)
    along = W.partitionBy("__source").orderBy("__band", "__salt").rowsBetween(W.unboundedPreceding, -1)
    based = cells.withColumn("__base", F.coalesce(F.sum("__n").over(along), F.lit(0))).drop("__n", "__sum")
    based = based.alias("b").join(wanted.alias("t"), F.col("b.__source").eqNullSafe(F.col("t.__source"))).select("b.*", F.col("t.source_size").alias("__source_size"), F.col("t.target").alias("__target"))
    numbered = placed.withColumn("__i", F.row_number().over(W.partitionBy(*keys).orderBy("__size", "doc_id")))
    on = [F.col(f"d.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
    joined = numbered.alias("d").join(based.alias("c"), on).select("d.*", "c.__base", "c.__source_size", "c.__target")
    rate = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(0.0)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(s.seed), F.coalesce(F.col("source"), F.lit("")))), 1, 8), 16, 10).cast("double") / 4294967296.0
    i = F.col("__base") + F.col("__i")
    return joined.withColumns({"__rate": rate, "__offset": offset}).withColumn(
        "__copies", (F.floor(F.col("__rate") * i + F.col("__offset")) - F.floor(F.col("__rate") * (i - 1) + F.col("__offset"))).cast("int")
    ).drop(*keys, "__base", "__i", "__rate", "__offset")


def shares(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, size, source_size, target and taken (words, repeats counted) of every document."""
    sized = cut(docs.select("doc_id", "source", size_of().alias("__size")))  # texts are read and split once
    return allot(sized, s).select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__copies") * F.col("__size")).alias("taken"))


def mixed(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, in the same columns, whatever their names."""
    dealt = allot(docs.select("doc_id", "source", size_of().alias("__size"), F.struct("*").alias("__row")), s)
    return dealt.select(F.explode(F.array_repeat("__row", F.col("__copies"))).alias("row")).select("row.*")
