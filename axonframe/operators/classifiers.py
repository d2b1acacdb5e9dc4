"""Pairwise logistic classifiers with one run left out at a time, all of them fitted together.

A pass over the trials adds up, in every task, gradient and Hessian of each pair of classes and each fold; Spark sums
them and one small system is solved for each. So a Newton step of all classifiers is one pass, whatever
their number, and no trial is copied for a pair or a fold. What goes out to the tasks is the coefficients: pairs
times folds times features, checked against ``most_bytes``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axonframe.plans.session import cut
from axonframe.sources.tables import table

Models = dict[tuple[int, int, int], np.ndarray]
SUMS = "a long, b long, fold long, part long, g array<double>, loss double, n long"


def checked(trials: DataFrame) -> DataFrame:
    """(run, label, x): trials with a run, a class and a whole, finite vector."""
    x = F.col("x").cast("array<double>")
    fine = F.col("run").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return trials.filter(fine).select(F.col("run").cast("long").alias("run"), F.col("label").cast("long").alias("label"), x.alias("x"))


def blocks(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    return batch.column("run").to_numpy(), batch.column("label").to_numpy(), np.column_stack([x, np.ones(len(x))])


def newton_sums(trials: DataFrame, models: Models) -> DataFrame:
    """(a, b, fold, part, g, loss, n): row ``part`` of the Hessian of each model, -1 for its gradient."""
    held = trials.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            runs, labels, x = blocks(batch)
            for (a, b, fold), beta in held.value.items():
                at = ((labels == a) | (labels == b)) & (runs != fold)
                if at.any():
                    z, y = x[at], np.where(labels[at] == a, 1.0, 0.0)
                    m = z @ beta
                    p = 1 / (1 + np.exp(-np.clip(m, -500, 500)))
                    now = sums.setdefault((a, b, fold), [np.zeros(len(beta)), np.zeros((len(beta), len(beta))), 0.0, 0])
                    now[0] += z.T @ (p - y)
                    now[1] += (z * (p * (1 - p))[:, None]).T @ z
                    now[2] += float(np.sum(np.logaddexp(0, m) - y * m))
                    now[3] += int(at.sum())
        rows = [(*key, part, v.tolist(), loss if part < 0 else 0.0, n if part < 0 else 0) for key, (g, h, loss, n) in sums.items() for part, v in enumerate([g, *h], -1)]
        if rows:
            columns = list(zip(*rows, strict=True))
            kinds = [*[pa.int64()] * 4, pa.list_(pa.float64()), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["a", "b", "fold", "part", "g", "loss", "n"])

    parts = trials.mapInArrow(run, SUMS).select("a", "b", "fold", "part", "loss", "n", F.posexplode("g").alias("k", "v"))
    cells = parts.groupBy("a", "b", "fold", "part", "k").agg(F.sum("v").alias("v"), F.sum("loss").alias("loss"), F.sum("n").alias("n"))
    return cells.groupBy("a", "b", "fold", "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda c: c["v"]).alias("g"), F.max("loss").alias("loss"), F.max("n").alias("n"))


def stepped(sums: DataFrame, models: Models, penalty: float) -> list[tuple]:
    """(a, b, fold, coefficients, largest gradient, objective) after a Newton step of each model; one small system a group."""
    held = sums.sparkSession.sparkContext.broadcast(models)

    def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        beta = held.value[tuple(int(k) for k in key)]
        weight = np.r_[np.full(len(beta) - 1, penalty), 0.0]  # the intercept isn't penalised
        rows = rows.sort_values("part")
        g = np.array(rows["g"].iloc[0]) + weight * beta
        h = np.array(rows["g"].iloc[1:].tolist()) + np.diag(weight) + 1e-12 * np.eye(len(beta))
        objective = float(rows["loss"].iloc[0]) + 0.5 * float(weight @ beta**2)
        return pd.DataFrame([(*key, (beta - np.linalg.solve(h, g)).tolist(), float(np.abs(g).max()), objective)], columns=["a", "b", "fold", "beta", "gradient", "objective"])

    return sums.groupBy("a", "b", "fold").applyInPandas(solve, "a long, b long, fold long, beta array<double>, gradient double, objective double").collect()


def fitted(trials: DataFrame, penalty: float = 1.0, steps: int = 40, tolerance: float = 1e-8, most_bytes: int = 64_000_000) -> Models:
    """Coefficients (the intercept last) by (a, b, left out run), -1 being the fit on all runs, for classes a < b; a is the class with positive score.

    Minimises the sum of log losses plus ``penalty`` / 2 times the squared weights. A step that raises the objective is halved.
    """
    kept = cut(checked(trials))
    labels, runs = (sorted(r[0] for r in kept.select(c).distinct().collect()) for c in ("label", "run"))
    if not labels:
        return {}
    p = kept.select(F.size("x")).first()[0] + 1
    size = 8 * p * len(labels) * (len(labels) - 1) // 2 * (len(runs) + 1)
    if size > most_bytes:
        raise ValueError(f"{size} bytes of coefficients are more than {most_bytes}")
    now: Models = {(a, b, f): np.zeros(p) for i, a in enumerate(labels) for b in labels[i + 1 :] for f in (-1, *runs)}
    best: dict[tuple, tuple[float, np.ndarray]] = {}
    done: Models = {}
    for _ in range(steps):
        tried = {tuple(r[:3]): r for r in stepped(newton_sums(kept, now), now, penalty)}
        following: Models = {}
        for key, beta in now.items():
            if key not in tried:  # no trial of either class
                continue
            r = tried[key]
            if key in best and r.objective > best[key][0] + 1e-9 * abs(best[key][0]):
                following[key] = (beta + best[key][1]) / 2
                continue
            best[key] = (r.objective, beta)
            if r.gradient < tolerance:
                done[key] = beta
            else:
                following[key] = np.array(r.beta)
        now = following
        if not now:
            break
    return done | {k: best[k][1] for k in now if k in best}


def held_out(trials: DataFrame, models: Models) -> DataFrame:
    """(a, b, runs, n, accuracy): the share of a left out run's trials that its classifier gets right, averaged over the runs whose fold has both classes."""
    held = trials.sparkSession.sparkContext.broadcast({k: v for k, v in models.items() if k[2] >= 0})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            if batch.num_rows:
                runs, labels, x = blocks(batch)
                for (a, b, fold), beta in held.value.items():
                    at = ((labels == a) | (labels == b)) & (runs == fold)
                    if at.any():
                        rows.append((a, b, fold, int(at.sum()), int(((x[at] @ beta > 0) == (labels[at] == a)).sum())))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["a", "b", "fold", "n", "right"])

    kept = checked(trials)
    by_run = kept.mapInArrow(run, "a long, b long, fold long, n long, right long").groupBy("a", "b", "fold").agg(F.sum("n").alias("n"), F.sum("right").alias("right"))
    sizes = cut(kept.groupBy("label", "run").agg(F.count("*").alias("n")))
    whole = sizes.groupBy("label").agg(F.sum("n").alias("whole"))
    for side in "ab":  # a class that is only in the left out run has no classifier
        own = sizes.withColumnsRenamed({"label": side, "run": "fold", "n": "here"})
        by_run = by_run.join(whole.withColumnRenamed("label", side), side).join(own, [side, "fold"], "left").filter(F.col("whole") > F.coalesce("here", F.lit(0))).drop("whole", "here")
    return by_run.groupBy("a", "b").agg(F.count("*").alias("runs"), F.sum("n").alias("n"), F.avg(F.col("right") / F.col("n")).alias("accuracy"))


def pair_classifiers(spark: SparkSession, d: str) -> DataFrame:
    """Images as classes, five runs; patterns are scaled to a mean square of 1."""
    e = table(spark, d, "embeddings").filter("embedding IS NOT NULL")
    trials = cut(e.select((F.col("vec_id") % 5).alias("run"), "label", F.transform("embedding", lambda v: v.cast("double") * math.sqrt(64)).alias("x")))
    return held_out(trials, fitted(trials)).select("a", "b", "runs", "n", F.round("accuracy", 6).alias("accuracy"))


QUERIES = {"pair_classifiers": pair_classifiers}
ORACLES: dict[str, str] = {}
