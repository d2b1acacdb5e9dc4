"""The corpus pipeline: toxicity, near-duplicates, secrets, mixing and packing, one stage after the other.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last
return the columns of documents: toxic documents go, one document of each group of near-duplicates
(five-word shingles, similarity 0.8 or more) stays, secrets are replaced in the text, documents are
repeated or left out as the mix asks. The last returns the packed pieces.

Defined results: null text counts as empty; empty texts are scored by their model, link with nothing and
are mixed like any other row of their source; a source without a word gets no copy. Rows are judged for
toxicity one by one; of near-duplicates the smallest doc_id stays, of rows with equal id and text one;
rows with a null doc_id are kept as they are. Texts of any length go through whole, ties are broken by id, and
columns other than those a stage needs are carried along whatever their names. Empty tables give an
empty result; without labels every score is 0.5, so every document counts as toxic. Each run writes its
stages to a folder of its own in the shared folder, which is left to whoever clears that.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from axonframe.llm import minhash, mixing, packing, secrets, toxicity
from axonframe.plans.session import shared_folder
from axonframe.sources.tables import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.without_near_duplicates(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The toxicity stage learns a model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
