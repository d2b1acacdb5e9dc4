import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from axonframe.llm import pieces, queries
from axonframe.sources.tables import table

from ..compare import SMALL
from .fixtures import documents, odd_texts

LIBRARY = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
PARTS = ["a", "aa", "in", "er", "the", " t", " ", "  ", "\n", "\t", ".", "1", "2", "é", "ß", "中", "▁", "<s>", "<0x0A>", "\x00", "🙂", "\u200d"]


@pytest.fixture(scope="module")
def encoder():
    return pieces.Encoder(pieces.Settings())


def own(encoder, text):
    return np.frombuffer(encoder.encode(text), "<i4").tolist()


@settings(max_examples=500, deadline=None)
@given(st.one_of(st.text(max_size=40), st.lists(st.sampled_from(PARTS), max_size=30).map("".join)))
def test_ids_equal_the_librarys(encoder, text):
    assert own(encoder, text) == LIBRARY.encode(text)


def test_joined_pieces_and_runs_of_spaces(encoder):
    rng = random.Random(1)
    for _ in range(5000):
        text = "".join(rng.choice(encoder.m.texts) for _ in range(rng.randrange(5)))
        assert own(encoder, text) == LIBRARY.encode(text)
    for n in range(70):
        assert own(encoder, " " * n + "the" + " " * (n // 2)) == LIBRARY.encode(" " * n + "the" + " " * (n // 2))


def test_compatibility_along_the_seam_is_the_definition(encoder):
    rng = random.Random(2)
    whole = [t for t in range(len(encoder.m.texts)) if encoder.at_left[t] and not encoder.m.tied[t]]
    pairs = [(rng.choice(whole), rng.choice(whole)) for _ in range(3000)]
    pairs += [divmod(k, 1 << 20) for k in rng.sample(sorted(encoder.joined), 5000)]
    for a, b in pairs:
        if encoder.at_left[a] and encoder.at_left[b] and not (encoder.m.tied[a] or encoder.m.tied[b]):
            assert encoder.along_seam(a, b) == encoder.by_merging(a, b)


def test_last_tokens_are_those_of_the_prefixes(encoder):
    text = " understandingly internationalisation"
    table = encoder.table(text)
    for n in range(1, len(text) + 1):
        assert encoder.m.ids[table[n]] == (LIBRARY.encode(text[1:n])[-1] if n > 1 else LIBRARY.piece_to_id(pieces.SPACE),)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31999), st.integers(0, 258), st.sampled_from([13, 259, 28705])), max_size=10))
def test_any_ids_decode_as_the_library_does(encoder, ids):
    assert pieces.Decoder(encoder.m)(pa.array([ids], pa.list_(pa.int32())))[0].as_py() == LIBRARY.decode(ids)


def test_odd_rows_long_texts_and_empty_tables(spark):
    texts = [*odd_texts(), "same", "same", "x" * 300_000, "QUJD" * 50_000, "中文字" * 30_000, " " * 5000, "a  b\n\n c\t", "tab\x0bline\r\n"]
    docs = documents(spark, texts, ids=[*range(len(texts) - 2), None, 0]).selectExpr("*", "1 as ids", "2 as decoded", "3 as n_tokens")
    got = sorted((repr((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256)) for r in pieces.digests(docs).collect()))
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = LIBRARY.encode(r.text or "")
        want.append(repr((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest())))
    assert got == sorted(want) and pieces.digests(docs.limit(0)).count() == 0
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(documents(spark, texts))).collect()}
    assert all(back[i] == (t or "").replace(pieces.SPACE, " ") for i, t in enumerate(texts))
    assert pieces.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).first().text == ""


def test_query_equals_the_library_on_all_documents(spark):
    want = {}
    for r in table(spark, SMALL, "documents").select("doc_id", "text").collect():
        ids = LIBRARY.encode(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest())
    assert {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op12_pieces"](spark, SMALL).collect()} == want
