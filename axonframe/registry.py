"""All queries of the library by name, with their oracle SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from axonframe.functions import scalars
from axonframe.operators import classifiers, components, dense, design, designs, evaluation, gaps, graph, lookups, losses, matrices, moments, normal, phasor, regression, resampling, selection, session, signatures, spatial, sphere, summaries, trials, variants, windows
from axonframe.streaming import decode, frames, kalman, tiers
from axonframe.streaming import trials as decoding

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

for _module in (moments, regression, normal, designs, matrices, phasor, summaries, variants, spatial, windows, gaps, design, lookups, trials, evaluation, graph, losses, dense, components, classifiers, resampling, selection, session, signatures, sphere, decode, decoding, kalman, tiers, frames, scalars):
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
