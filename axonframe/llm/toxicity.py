"""Toxicity: a factorisation machine whose pairwise terms score, say, an insult beside a group mention.

Defined results: null text scores as empty text, empty texts by their bins alone, texts of any length
whole. Null ids are never learnt from; labels that repeat an id count once, by their largest value; rows
that repeat an id are scored one by one. A score at the threshold is toxic. Without labelled rows of both classes every
score is the share of label 1 (0.5 without any). Empty tables give an empty result, and columns other than the
named ones are neither read nor returned, but kept by ``clean``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axonframe.llm import factorization as fm
from axonframe.llm.quality import PARTS, classify

SETTINGS = fm.Settings(affix=(4, 5, -3))
THRESHOLD = 0.5


def detect(docs: DataFrame, labels: DataFrame, settings: fm.Settings = SETTINGS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    return classify(docs, labels, "toxic", settings, threshold)


def clean(docs: DataFrame, labels: DataFrame, settings: fm.Settings = SETTINGS, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents scored as toxic, in the same columns, whatever their names. Rows are judged one by one, so nothing is joined back."""
    model = fm.fit(docs, labels, "toxic", settings, PARTS)
    rows = docs.select(F.struct("*").alias("row"), "text")
    return fm.score(rows, model, ["row"]).filter(F.col("score") < threshold).select("row.*")
