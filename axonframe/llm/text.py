"""What the text operators share: words, hold-out folds and Arrow plumbing."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of the contracts, as Java, Python and DuckDB regexes read it.
WORD = r"[^\x20\x09-\x0D]+"


def words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z only) words: bytes.lower and bytes.split know ASCII letters and x20, x09-x0D alone."""
    return text.lower().split()


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty string (fold 0)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts


def utf8(text: str = "text") -> Column:
    """The whole text as bytes; null counts as empty."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that few texts are Python objects at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
