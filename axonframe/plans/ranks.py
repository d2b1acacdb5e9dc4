"""Places and running sums along an order, without a task that holds a group or the whole table.

Rows are dealt by ranges of (group, order), so a group of any size is spread over tasks that follow
each other; within a task a row's place is its number less that of the first row of its group, and
only the counts or sums of (group, task) cells are added up along a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from axonframe.plans.session import cut


def numbered(rows: DataFrame, by: str, order: list, pos: str = "pos", total: str = "total") -> DataFrame:
    """``rows`` with their place from 0 in the group ``by`` (never null) and the rows of that group.

    Ties in ``order`` are numbered in any way. Rows are read twice (once for the ranges' bounds), so
    they should be stored; the dealt rows are written to the shared folder, so that numbers hold
    when a task is run again.
    """
    dealt = rows.repartitionByRange(by, *order).sortWithinPartitions(by, *order)
    dealt = cut(dealt.withColumn("__at", F.monotonically_increasing_id())).withColumn("__task", F.shiftright("__at", 33))
    cells = dealt.groupBy(by, "__task").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    group = W.partitionBy(by)
    along = group.orderBy("__task").rowsBetween(W.unboundedPreceding, -1)
    based = cells.withColumns({"__base": F.coalesce(F.sum("__n").over(along), F.lit(0)) - F.col("__first"), total: F.sum("__n").over(group)}).drop("__first", "__n")
    return dealt.join(based, [by, "__task"]).withColumn(pos, F.col("__at") + F.col("__base")).drop("__at", "__task", "__base")


def ranked(rows: DataFrame, order: list, name: str) -> DataFrame:
    """``rows`` with their place from 1 along the whole order."""
    placed = numbered(rows.withColumn("__all", F.lit(0)), "__all", order, "__pos", "__total")
    return placed.withColumn(name, F.col("__pos") + 1).drop("__all", "__pos", "__total")


def running_before(rows: DataFrame, order: list, value: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over all rows before them along the whole order, which has no ties."""
    dealt = cut(rows.repartitionByRange(*order).withColumn("__task", F.spark_partition_id()))
    cells = dealt.groupBy("__task").agg(F.sum(value).alias("__sum"))
    base = cells.select("__task", F.coalesce(F.sum("__sum").over(W.orderBy("__task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__base"))  # one row a task
    own = W.partitionBy("__task").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return dealt.join(base, "__task").withColumn(name, F.coalesce(F.sum(value).over(own), F.lit(0)) + F.col("__base")).drop("__task", "__base")
