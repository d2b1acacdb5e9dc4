import random
import zlib
from collections import Counter

import numpy as np

from axonframe.llm import bilinear, factorization, quality, toxicity

from .fixtures import documents, odd_texts, prose


def labelled(spark, n=240):
    """An insult beside a group mention is toxic; either alone isn't."""
    rng = random.Random(4)
    texts, labels = [], []
    for i in range(n):
        insult, group = i % 2 == 0, i // 2 % 2 == 0
        words = prose(rng, 30, 60).split() + ["insult"] * insult + ["group"] * group
        rng.shuffle(words)
        texts.append(" ".join(words))
        labels.append((i, int(insult and group), int(insult and group)))
    return documents(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_interaction_is_learnt_and_held_out_rows_score_well(spark):
    docs, labels = labelled(spark)
    got = toxicity.detect(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert len(held) > 20 and (held.predicted == held.toxic).mean() >= 0.9
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()


def test_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    w, v = rng.normal(size=9), rng.normal(size=(9, 3))
    flat, sizes = np.array([0, 3, 5, 8, 2]), np.array([4, 0, 1])
    z, _ = factorization.logits(0.5, w, v, flat, sizes)
    for got, ids in zip(z, ([0, 3, 5, 8], [], [2]), strict=True):
        pairs = sum(v[a] @ v[b] for k, a in enumerate(ids) for b in ids[k + 1 :])
        assert np.isclose(got, 0.5 + w[ids].sum() + pairs)


def test_odd_rows_and_missing_labels(spark):
    texts = odd_texts()
    docs = documents(spark, texts, ids=[None, *range(1, len(texts))])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, none).toPandas()
    assert len(got) == len(texts) and (got.score == 0.5).all() and list(got.columns) == ["doc_id", "held_out", "score", "predicted"]
    assert got.held_out[got.doc_id.isna()].all()
    odd = spark.createDataFrame([(None, 1, 1), (3, None, None), (6, 1, 0), (6, 0, 1), (7, 0, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.classify(docs, odd).count() == len(texts)
    assert quality.classify(docs.limit(0), odd).count() == 0
    assert toxicity.clean(docs, none, threshold=0.4).count() == 0 and toxicity.clean(docs, none, threshold=0.6).columns == docs.columns


def test_language_model_base_scores_and_normalisation(spark):
    texts = [*odd_texts(), *odd_texts(2)]
    docs = documents(spark, texts, ids=[None, *range(1, len(texts))])
    got = bilinear.score(docs, bilinear.Settings(common=20, steps=60)).toPandas()
    tokens = {i: [*(t or "").encode().lower().split(), b"\n"] for i, t in enumerate(texts)}
    count = {}
    for i, ws in tokens.items():
        if i and zlib.crc32(str(i).encode()) % 10:
            for w in ws:
                count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    assert len(got) == len(texts) and (got.train_tokens == n).all()
    for r in got.itertuples():
        ws = tokens[0 if np.isnan(r.doc_id) else int(r.doc_id)]
        want = sum(np.log10((count.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert abs(r.base_score - want) < 1e-6 and r.n_tokens == len(ws) and r.n_known == sum(w in count for w in ws)
        assert np.isfinite(r.score) and r.score < 0


def test_noise_contrast_learns_a_bigram_table():
    s = bilinear.Settings(classes=6, steps=800)
    counts = np.zeros((6, 6, 6))
    for a in range(6):
        counts[:, a, (a + 1) % 6] = 500
        counts[:, a, (a + 2) % 6] = 50
    logs = bilinear.train(counts.ravel(), s).reshape(6, 6, 6)
    assert np.allclose((10**logs).sum(-1), 1)
    assert (logs[0, np.arange(6), (np.arange(6) + 1) % 6] > np.log10(0.6)).all()


def test_language_model_without_rows(spark):
    docs = documents(spark, ["a b"]).limit(0)
    assert bilinear.score(docs).count() == 0


def test_scores_against_all_pairs_of_features(spark):
    """Every score recomputed from the fitted model by a loop over all pairs of a text's features."""
    docs, labels = labelled(spark, 120)
    s = toxicity.SETTINGS
    model = factorization.fit(docs, labels, "toxic", s)
    place = {int(x): k for k, x in enumerate(model.ids)}
    got = {r.doc_id: r.score for r in toxicity.detect(docs, labels).collect()}
    assert len(model.ids) and len({round(x, 6) for x in got.values()}) > 20
    for r in docs.collect():
        words = r.text.lower().encode().split()
        ids = {zlib.crc32(w) % s.buckets for w in words}
        ids |= {zlib.crc32(w[:n] if n > 0 else w[n:], 7 * n & 0xFFFF) % s.buckets for w in words for n in s.affix if len(w) > abs(n)}
        ids |= set(factorization.bins(r.text.encode(), words, len(set(words)), s))
        on = [place[x] for x in ids if x in place]
        z = model.bias + sum(model.w[a] for a in on) + sum(model.v[a] @ model.v[b] for k, a in enumerate(on) for b in on[k + 1 :])
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-z))) < 1e-9


def test_screening_against_counts(spark):
    """The features kept are those with the largest smoothed log odds ratios, counted one by one."""
    docs, labels = labelled(spark, 120)
    s = factorization.Settings(kept=15)
    rows = factorization.labelled_rows(docs, labels, "toxic", s, 5)
    sets = [(r.label, set(np.frombuffer(r.features, "<i4").tolist())) for r in rows.collect()]
    n = [sum(y == k for y, _ in sets) for k in (0, 1)]
    z = {}
    for f in set().union(*(x for _, x in sets)):
        zero, one = (sum(f in x for y, x in sets if y == k) for k in (0, 1))
        if zero + one >= s.least_docs or f >= s.buckets:
            odds = np.log((one + 0.5) / (n[1] - one + 0.5)) - np.log((zero + 0.5) / (n[0] - zero + 0.5))
            z[f] = round(abs(odds) / np.sqrt(1 / (one + 0.5) + 1 / (zero + 0.5)), 9)
    want = sorted(sorted((f for f in z if z[f] > s.least_z), key=lambda f: (-z[f], f))[: s.kept])
    assert factorization.screened(rows, s).tolist() == want and len(want) > 2


def test_repeated_ids_and_very_long_texts(spark):
    rng = random.Random(8)
    texts = [prose(rng, 20_000, 3000), "a b", "a b", *(prose(rng, 30) for _ in range(40))]
    docs = documents(spark, texts, ids=[0, 1, 1, *range(3, len(texts))])
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(len(texts))], "doc_id long, quality int, toxic int")
    for got in (quality.classify(docs, labels), toxicity.detect(docs, labels), bilinear.score(docs, bilinear.Settings(common=20, steps=20))):
        rows = got.toPandas()
        assert len(rows) == len(texts) and rows.score.notna().all() and rows[rows.doc_id == 1].score.nunique() == 1


def test_language_model_scores_against_a_direct_sum(spark):
    """Every score recomputed token by token from the learnt classes, the trained table and the counts."""
    rng = random.Random(3)
    texts = [*odd_texts(), *(prose(rng, 60, 150) for _ in range(60))]
    docs = documents(spark, texts, ids=[None, *range(1, len(texts))])
    s = bilinear.Settings(common=40, words=30, ends=16, classes=24, singles=5, first=12, steps=50)
    training = docs.filter("doc_id IS NOT NULL AND crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 10 <> 0")
    counts = {r.word: r.n for r in bilinear.count_words(training, s).collect()}
    counts = {bytes(w): n for w, n in counts.items()}
    common = bilinear.common_words(bilinear.count_words(training, s), s)
    classes = bilinear.learnt_classes(training, common, s)
    table = bilinear.train(bilinear.count_trigrams(training, classes, s), s)
    assert np.allclose((10**table).sum(1), 1) and len({classes(w) for w in counts}) > 8
    size, kinds = Counter(), Counter()
    for w, n in counts.items():
        size[classes(w)] += n
        kinds[classes(w)] += 1
    got = bilinear.score(docs, s).collect()
    assert len(got) == len(texts)
    for r in got:
        want, c2, c1 = 0.0, 0, 0
        for w in [*(texts[r.doc_id or 0] or "").encode().lower().split(), bilinear.END]:
            c = classes(w)
            want += table[c2 * s.classes + c1, c] + np.log10((counts.get(w, 0) + 0.1) / (size[c] + 0.1 * (kinds[c] + 1)))
            c2, c1 = c1, c
        assert abs(r.score - want) < 1e-3 + 1e-6 * abs(want)


def test_words_of_one_place_share_a_class(spark):
    """Two kinds of words that stand after different markers are told apart by their neighbours, not by their endings."""
    rng = random.Random(6)
    kinds = {"after": [f"x{k}q" for k in range(20)], "before": [f"y{k}q" for k in range(20)]}
    texts = [" ".join(f"{m} {rng.choice(ws)}" for m, ws in rng.choices(list(kinds.items()), k=40)) for _ in range(120)]
    s = bilinear.Settings(classes=8, singles=2, first=6, words=60, ends=8)
    common = bilinear.common_words(bilinear.count_words(documents(spark, texts), s), s)
    classes = bilinear.learnt_classes(documents(spark, texts), common, s)
    a, b = ({classes(w.encode()) for w in ws} for ws in kinds.values())
    assert a.isdisjoint(b)
