import corpus_pipeline
import numpy as np
import pytest

from ..compare import SMALL
from .fixtures import odd_texts

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Names that stages use themselves, and those of the result.
CLASHING = ["score", "label", "id", "set", "target", "source_size", "size", "salt", "kept", "__toxicity", "__utf8", "__text", "__size", "features", "length", "start"]


def test_stages_hand_on_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == columns, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash", "secrets", "mixing", "packing"]


def test_run_packs_what_is_left(spark):
    got = corpus_pipeline.run(spark, SMALL).toPandas()
    assert len(got) and got.groupby("sequence_id").length.sum().max() <= 2048


def chain(spark, docs):
    """All stages one after the other, each written and read again as ``run`` does."""
    out = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        out.append((name, docs.columns, docs.count()))
    return docs, out


def test_odd_rows_and_repeated_rows_go_through_all_stages(spark):
    texts = [*odd_texts(), "secret = abcdef123456 and on", "secret = abcdef123456 and on", "long " * 20_000]
    rows = [(None if i in (1, 2) else i, t, None if i % 3 else "en", None if i % 4 == 0 else f"s{i % 2}", None) for i, t in enumerate(texts)] + [(5, texts[5], "en", "s1", 3), (5, texts[5], "en", "s1", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got, sizes = chain(spark, docs)
    assert [c for _, c, _ in sizes[:-1]] == [COLUMNS] * 4 and 0 < sizes[1][2] < len(rows)
    p = got.toPandas()
    assert len(p) and (p.groupby("sequence_id").length.sum() <= 2048).all() and np.isfinite(p.length).all()


def test_empty_table_goes_through_all_stages(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    _, sizes = chain(spark, docs)
    assert [n for _, _, n in sizes] == [0] * 5


@pytest.mark.parametrize("half", [0, 1])
def test_extra_columns_of_any_name_are_kept(spark, half):
    extra = CLASHING[half::2]
    rows = [(i, t, "en", f"s{i % 2}", 1, *[f"{c}{i}" for c in extra]) for i, t in enumerate(odd_texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in extra))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == [*COLUMNS, *extra], name
        assert all(r[c] == f"{c}{r.doc_id}" for r in docs.collect() for c in extra), name
