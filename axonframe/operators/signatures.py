"""Log-signatures of depth three of paths in long tables, by Chen's identity.

A piece of a path has iterated integrals of one, two and three channels; those of two pieces one after the
other follow from those of each. So a series is cut into stretches that are reduced on their own, and
the stretches of a series in turn: no series has to lie in one task, and the cut doesn't change the result.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from axonframe.sources.series import SERIES, user_series
from axonframe.sources.tables import table


def words(channels: int, depth: int = 3) -> list[tuple[int, ...]]:
    """Lyndon words: those before all their rotations. A log-signature has one number for each."""
    every = (w for n in range(1, depth + 1) for w in itertools.product(range(channels), repeat=n))
    return [w for w in every if all(w < w[k:] + w[:k] for k in range(1, len(w)))]


def name(*word: int) -> str:
    return "s" + "".join(map(str, word))


def tensors(channels: int) -> list[tuple[int, ...]]:
    return [w for n in (1, 2, 3) for w in itertools.product(range(channels), repeat=n)]


def linear(steps: Sequence[Column]) -> dict[str, Column]:
    """Integrals of a straight piece: products of its steps over the factorial of their number."""
    found = {}
    for w in tensors(len(steps)):
        x = steps[w[0]]
        for c in w[1:]:
            x = x * steps[c]
        found[name(*w)] = x / (1, 2, 6)[len(w) - 1]
    return found


def chained(pieces: DataFrame, group: list[str], order: str, channels: int) -> DataFrame:
    """(group, s..): integrals of the pieces of each group one after the other."""
    before = W.partitionBy(*group).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    c = range(channels)
    so_far = lambda x: F.coalesce(F.sum(x).over(before), F.lit(0.0))
    rows = pieces.withColumns({f"a{i}": so_far(F.col(name(i))) for i in c})
    rows = rows.withColumns({f"e{i}{j}": F.col(name(i, j)) + F.col(f"a{i}") * F.col(name(j)) for i in c for j in c})
    rows = rows.withColumns({f"a{i}{j}": so_far(F.col(f"e{i}{j}")) for i in c for j in c})
    third = lambda i, j, k: F.col(name(i, j, k)) + F.col(f"a{i}{j}") * F.col(name(k)) + F.col(f"a{i}") * F.col(name(j, k))
    return rows.groupBy(*group).agg(
        *(F.sum(name(i)).alias(name(i)) for i in c), *(F.sum(f"e{i}{j}").alias(name(i, j)) for i in c for j in c), *(F.sum(third(i, j, k)).alias(name(i, j, k)) for i in c for j in c for k in c)
    )


def logarithm(channels: int) -> dict[str, Column]:
    """The numbers of the log-signature by word, from the integrals."""
    s = lambda *w: F.col(name(*w))

    def of(w: tuple[int, ...]) -> Column:
        if len(w) == 1:
            return s(*w)
        if len(w) == 2:
            return s(*w) - s(w[0]) * s(w[1]) / 2
        i, j, k = w
        return s(*w) - (s(i) * s(j, k) + s(i, j) * s(k)) / 2 + s(i) * s(j) * s(k) / 3

    return {"".join(map(str, w)): of(w) for w in words(channels)}


def steps(rows: DataFrame, channels: Sequence[str]) -> DataFrame:
    """(sid, t, s..): the straight pieces of each series (sid, t, channels), t without gaps, by a join with the sample before."""
    last = rows.select("sid", (F.col("t") + 1).alias("t"), *(F.col(c).cast("double").alias(f"__{c}") for c in channels))
    met = rows.join(last, ["sid", "t"])
    return met.select("sid", "t", *(x.alias(n) for n, x in linear([F.col(c) - F.col(f"__{c}") for c in channels]).items()))


def in_words(sums: DataFrame, keys: list[str], channels: int) -> DataFrame:
    """(keys, word, v) in long form."""
    cells = F.array(*(F.struct(F.lit(w).alias("word"), x.alias("v")) for w, x in logarithm(channels).items()))
    return sums.select(*keys, F.explode(cells).alias("x")).select(*keys, "x.word", "x.v")


def log_signatures(rows: DataFrame, channels: Sequence[str], stretch: int = 4096) -> DataFrame:
    """(sid, word, v) of whole series, reduced by stretches of samples first. Series of one sample have none."""
    parts = chained(steps(rows, channels).withColumn("part", F.floor(F.col("t") / stretch)), ["sid", "part"], "t", len(channels))
    return in_words(chained(parts, ["sid"], "part", len(channels)), ["sid"], len(channels))


def windowed(rows: DataFrame, channels: Sequence[str], width: int, stride: int) -> DataFrame:
    """(sid, win, word, v) of windows of ``width`` samples from win * stride + 1 on; only whole windows."""
    last = rows.groupBy("sid").agg(F.max("t").alias("last"))
    first = F.greatest(F.ceil((F.col("t") - width) / stride), F.lit(0))
    held = steps(rows, channels).withColumn("win", F.explode(F.sequence(first.cast("long"), F.floor((F.col("t") - 2) / stride).cast("long"))))
    whole = held.join(last, "sid").filter(F.col("win") * stride + width <= F.col("last")).drop("last")
    return in_words(chained(whole, ["sid", "win"], "t", len(channels)), ["sid", "win"], len(channels))


CHANNELS = ("v", "a", "b")
#: Many of the queries' numbers end in 5 at the fourth decimal; this keeps them from being rounded by their last bit.
TIE = 1e-6


def _path(spark: SparkSession, d: str) -> DataFrame:
    s = user_series(table(spark, d, "events"))
    return s.select("sid", "t", "v", (F.col("event_id") % 7).alias("a"), (F.col("event_id") % 5).alias("b"))


def log_signature(spark: SparkSession, d: str) -> DataFrame:
    return log_signatures(_path(spark, d), CHANNELS, 16).select("sid", "word", (F.round(F.col("v") + TIE, 3) + 0.0).alias("v"))


def signature_windows(spark: SparkSession, d: str) -> DataFrame:
    return windowed(_path(spark, d), CHANNELS, 20, 10).select("sid", "win", "word", (F.round(F.col("v") + TIE, 3) + 0.0).alias("v"))


def _sql(source: str, keys: str) -> str:
    """Running integrals over straight pieces (keys, t, d0, d1, d2) without any cut."""
    c = range(3)
    o = f"OVER (PARTITION BY {keys} ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    one = ", ".join(f"coalesce(sum(d{i}) {o}, 0) AS a{i}" for i in c)
    two = ", ".join(f"a{i} * d{j} + d{i} * d{j} / 2 AS e{i}{j}" for i in c for j in c)
    run = ", ".join(f"coalesce(sum(e{i}{j}) {o}, 0) AS a{i}{j}" for i in c for j in c)
    total = ", ".join([*(f"sum(d{i}) AS s{i}" for i in c), *(f"sum(e{i}{j}) AS s{i}{j}" for i in c for j in c), *(f"sum(a{i}{j} * d{k} + a{i} * d{j} * d{k} / 2 + d{i} * d{j} * d{k} / 6) AS s{i}{j}{k}" for i in c for j in c for k in c)])

    def of(w: tuple[int, ...]) -> str:
        if len(w) == 1:
            return name(*w)
        if len(w) == 2:
            return f"{name(*w)} - {name(w[0])} * {name(w[1])} / 2"
        i, j, k = w
        return f"{name(*w)} - ({name(i)} * {name(j, k)} + {name(i, j)} * {name(k)}) / 2 + {name(i)} * {name(j)} * {name(k)} / 3"

    cells = ", ".join(f"{{'word': '{''.join(map(str, w))}', 'v': round({of(w)} + {TIE!r}, 3) + 0.0}}" for w in words(3))
    return f"""r1 AS (SELECT *, {one} FROM {source}), r2 AS (SELECT *, {two} FROM r1), r3 AS (SELECT *, {run} FROM r2), r4 AS (SELECT {keys}, {total} FROM r3 GROUP BY {keys}),
        r5 AS (SELECT {keys}, unnest([{cells}]) AS x FROM r4) SELECT {keys}, x.word AS word, x.v AS v FROM r5"""


_STEPS = f"""{SERIES}, p AS (SELECT sid, t, max(t) OVER (PARTITION BY sid) AS last, v - lag(v) OVER o AS d0, (event_id % 7 - lag(event_id % 7) OVER o)::DOUBLE AS d1, (event_id % 5 - lag(event_id % 5) OVER o)::DOUBLE AS d2 FROM s WINDOW o AS (PARTITION BY sid ORDER BY t)),
    g AS (SELECT * FROM p WHERE d0 IS NOT NULL)"""
QUERIES = {f.__name__: f for f in (log_signature, signature_windows)}
ORACLES = {
    "log_signature": f"WITH {_STEPS}, {_sql('g', 'sid')}",
    "signature_windows": f"WITH {_STEPS}, w AS (SELECT g.*, k AS win FROM g, range(0, 1000000) r(k) WHERE k * 10 + 1 < t AND t <= k * 10 + 20 AND k * 10 + 20 <= last AND k <= t), {_sql('w', 'sid, win')}".replace("range(0, 1000000) r(k)", "(SELECT unnest(range(0, (SELECT max(t) // 10 + 1 FROM s))) AS k) r"),
}
