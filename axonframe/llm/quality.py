"""Quality classifier: a factorisation machine over hashed words, structure statistics and lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axonframe.llm import factorization as fm
from axonframe.llm.text import fold

SETTINGS = fm.Settings(affix=(-3,), kept=4_000)
THRESHOLD, PARTS = 0.3, 5


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", settings: fm.Settings = SETTINGS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; see ``factorization`` for the defined cases."""
    model = fm.fit(docs, labels, label, settings, PARTS)
    return fm.score(docs, model, ["doc_id"]).select(
        "doc_id", (fold("doc_id", PARTS) == 0).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted")
    )
