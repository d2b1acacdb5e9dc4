"""The queries of this subpackage, and their SQL where DuckDB can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from axonframe.llm import bilinear, caps, merkle, minhash, mixing, packing, partitions, pieces, prefixes, quality, secrets, toxicity, wrappers
from axonframe.sources.tables import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partitions.nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), minhash.Settings(words=2))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op6_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(table(spark, sf_dir, "pages"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bilinear.score(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(table(spark, sf_dir, "documents"))


def op10_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tamper_check(table(spark, sf_dir, "documents"))


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"))


def op13_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.shared_prefixes(table(spark, sf_dir, "conversations"))


_WORDS = r"[^\x20\x09-\x0D]+"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORDS}') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN coalesce(len(ws), 0) = 0 THEN [] WHEN len(ws) = 1 THEN ws
    ELSE list_distinct([ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))]) END AS set FROM w),
one AS (SELECT min(doc_id) AS id, list_sort(set) AS set, len(set) AS n FROM s WHERE len(set) > 0 GROUP BY list_sort(set), len(set)),
e AS (SELECT id, n, unnest(set) AS sh FROM one),
c AS (SELECT a.id AS u, b.id AS v, a.n AS un, b.n AS vn, count(*) AS both FROM e a JOIN e b ON a.sh = b.sh AND a.id <> b.id
    AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r(id, c) AS (SELECT id, id FROM one UNION SELECT r.id, c.v FROM r JOIN c ON r.c = c.u),
m AS (SELECT id, min(c) AS component FROM r GROUP BY id)
SELECT s.doc_id, CAST(len(s.set) AS BIGINT) AS n_shingles, coalesce(m.component, s.doc_id) AS component_id, s.doc_id = coalesce(m.component, s.doc_id) AS kept
FROM s LEFT JOIN one ON list_sort(s.set) = one.set LEFT JOIN m ON m.id = one.id
"""

OP9_SQL = f"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{_WORDS}')), 0) AS BIGINT) AS size FROM documents),
src AS (SELECT source, CAST(sum(size) AS DOUBLE) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM src),
l AS (SELECT *, row_number() OVER o AS pos, (1.5 * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER p, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER p, 0)) AS level FROM w
    WINDOW o AS (ORDER BY 2 * source_size / w, source NULLS LAST), p AS (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(2 * source_size, w * (SELECT arg_min(level, pos) FROM l WHERE level <= 2 * source_size / w)) AS target,
    CAST('0x' || substr(md5('mix' || coalesce(source, '')), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM l),
i AS (SELECT d.*, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    row_number() OVER (PARTITION BY d.source ORDER BY length(bin(size)) * 8 + (size >> greatest(length(bin(size)) - 3, 0)),
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || size), 1, 8) AS BIGINT) % CAST(32 * greatest(1, round(sqrt((SELECT count(*) FROM d) / 1e6))) AS BIGINT), size, doc_id NULLS FIRST) AS i
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
    CAST(size * (floor(rate * i + u) - floor(rate * (i - 1) + u)) AS BIGINT) AS taken FROM i
"""

OP10_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
e AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.93),
r(id, c) AS (SELECT u, u FROM e UNION SELECT r.id, e.v FROM r JOIN e ON r.c = e.u),
m AS (SELECT id, min(c) AS component FROM r GROUP BY id), n AS (SELECT u, count(*) AS n FROM e GROUP BY u)
SELECT t.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(m.component, t.vec_id) AS component_id, t.vec_id = coalesce(m.component, t.vec_id) AS kept
FROM embeddings t LEFT JOIN n ON n.u = t.vec_id LEFT JOIN m ON m.id = t.vec_id
"""



def _crc32(text: str) -> str:
    """Unsigned crc32 of ASCII text: bit by bit, as DuckDB has no function for it."""
    return f"""xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split({text}, ''), lambda ch: ord(ch)::UBIGINT)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda d, i: xor(d >> 1, (d & 1) * 3988292384::UBIGINT))), 4294967295::UBIGINT)"""


def _leaf(text: str) -> str:
    fields = ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)
    return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in fields) + ")"


_TREE = """{name}(tree, level, pos, digest) AS (SELECT tree, 0, pos, digest FROM {leaves} UNION ALL
    SELECT tree, level + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {name}) WHERE n > 1 GROUP BY tree, level, pos // 16)"""
_WALK = """{name}(tree, place, level, pos, proof, node) AS (SELECT {key}, 0, pos, {proof}, {node} FROM {start} UNION ALL
    SELECT w.tree, w.place, w.level + 1, w.pos // 16, w.proof || array_to_string(r.ds[1:w.pos % 16], '') || array_to_string(r.ds[w.pos % 16 + 2:], ''),
    sha256(array_to_string(r.ds[1:w.pos % 16], '') || w.node || array_to_string(r.ds[w.pos % 16 + 2:], ''))
    FROM {name} w JOIN {runs} r ON r.tree = w.tree AND r.level = w.level AND r.run = w.pos // 16)"""
_RUNS = "{name} AS (SELECT tree, level, pos // 16 AS run, list(digest ORDER BY pos) AS ds FROM (SELECT *, count(*) OVER (PARTITION BY tree, level) AS n FROM {nodes}) WHERE n > 1 GROUP BY tree, level, pos // 16)"
_ENDS = "{name} AS (SELECT tree, place, arg_max(proof, level) AS proof, arg_max(node, level) AS node FROM {walk} GROUP BY tree, place)"

OP11_SQL = f"""
WITH RECURSIVE l AS (SELECT doc_id, coalesce('=' || source, '') AS tree, {_leaf("text")} AS digest, CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 5 = 0
    THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS now FROM documents),
d AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos FROM l),
{_TREE.format(name="t", leaves="d")}, {_RUNS.format(name="tr", nodes="t")},
s AS (SELECT tree AS of, arg_max(digest, level) AS digest, 0 AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos FROM t GROUP BY of),
{_TREE.format(name="u", leaves="s")}, {_RUNS.format(name="ur", nodes="u")},
{_WALK.format(name="w", start="d", key="tree, pos", proof="''", node="coalesce(now, digest)", runs="tr")}, {_ENDS.format(name="we", walk="w")},
a AS (SELECT doc_id, d.digest AS leaf, s.digest AS subroot, we.proof, we.node, 0 AS tree, s.pos, row_number() OVER () AS place FROM d JOIN s ON s.of = d.tree JOIN we ON we.tree = d.tree AND we.place = d.pos),
{_WALK.format(name="x", start="a", key="tree, place", proof="proof", node="node", runs="ur")}, {_ENDS.format(name="z", walk="x")},
top AS (SELECT arg_max(digest, level) AS root FROM u)
SELECT doc_id, leaf, subroot, root, sha256(z.proof) AS proof_sha256, z.node AS folded_root, z.node = root AS verified FROM a JOIN z USING (place), top
"""

OP13_SQL = f"""
WITH a AS (SELECT conv_id, turn, coalesce(len(regexp_extract_all(text, '{_WORDS}')), 0) AS words, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS key FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) AS i, count(*) OVER (PARTITION BY conv_id) AS turns FROM a),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS p, {_crc32("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM own WHERE i = 1),
r AS (SELECT c.conv_id, i, key, words FROM c JOIN own o ON o.conv_id = c.p AND o.i <= c.h UNION ALL
    SELECT o.conv_id, o.i - c.h + least(c.h, coalesce(f.turns, 0)), o.key, o.words FROM own o JOIN c ON o.conv_id = c.conv_id AND o.i > c.h LEFT JOIN own f ON f.conv_id = c.p AND f.i = 1),
k AS (SELECT conv_id, CAST(i AS BIGINT) AS depth, words, sha256(string_agg(key, '') OVER (PARTITION BY conv_id ORDER BY i)) AS node FROM r),
m AS (SELECT *, coalesce(lag(node) OVER (PARTITION BY conv_id ORDER BY depth), '') AS parent, count(*) OVER (PARTITION BY conv_id) AS last FROM k UNION ALL
    SELECT conv_id, 0, 0, '', NULL, (SELECT count(*) FROM r WHERE r.conv_id = c.conv_id) FROM c),
n AS (SELECT node, depth, parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last = depth), '')) AS ends_sha256 FROM m GROUP BY ALL),
d AS (SELECT parent AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY parent),
x AS (SELECT n.*, coalesce(d.n_children, 0) AS n_children FROM n LEFT JOIN d USING (node)),
s AS (SELECT m.node, sum(CAST(x.n_children = 0 AS INT)) AS n_leaves, sum((x.n_convs - 1) * x.words) AS saved_tokens FROM x JOIN m ON m.conv_id = x.conv_id AND m.depth <= x.depth GROUP BY m.node)
SELECT x.conv_id, x.depth, p.conv_id AS parent_conv_id, x.n_convs, x.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, x.ends_sha256
FROM x JOIN s USING (node) LEFT JOIN n p ON p.node = x.parent
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_toxicity": op2_toxicity,
    "op3_partitions": op3_partitions,
    "op4_minhash": op4_minhash,
    "op5_secrets": op5_secrets,
    "op6_wrappers": op6_wrappers,
    "op7_packing": op7_packing,
    "op8_bilinear": op8_bilinear,
    "op9_mixing": op9_mixing,
    "op10_caps": op10_caps,
    "op11_merkle": op11_merkle,
    "op12_pieces": op12_pieces,
    "op13_prefixes": op13_prefixes,
}
ORACLES: dict[str, str] = {"op4_minhash": OP4_SQL, "op9_mixing": OP9_SQL, "op10_caps": OP10_SQL, "op11_merkle": OP11_SQL, "op13_prefixes": OP13_SQL}
