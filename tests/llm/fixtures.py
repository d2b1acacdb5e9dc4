"""Small documents with every odd case: nulls, empties, ties, repeated rows and columns whose names clash."""

from __future__ import annotations

import random

import duckdb

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label int, score double, id long, set string, target double, source_size long, size long"


def documents(spark, texts, ids=None, sources=None):
    rows = [((ids[i] if ids else i), t, "en", (sources[i] if sources else f"s{i % 3}"), len(t) if t is not None else None, 1, 0.5, -i, "x", 0.1, 7, 8) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def odd_texts(seed=1):
    rng = random.Random(seed)
    base = prose(rng, 120)
    words = base.split()
    near = [*words]
    near[50] = "changed"
    return [None, "", "   ", "one", "One", "two words", base, base, base.upper(), " ".join(near), prose(rng, 5000), "Ä äß中文  x y", *(prose(rng, 40) for _ in range(6))]


def run_sql(sql, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame)
    return con.execute(sql).fetchall()
