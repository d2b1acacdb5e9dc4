"""A Merkle manifest of a dataset: leaves by source, subroots, one root, and each leaf's proof.

H is the lowercase hex SHA-256 of its inputs put together, digests as hex text. A leaf is H of the
row's columns, each ``-`` if null, else its UTF-8 length in bytes, a colon and the value. A tree has
the leaves of a source by doc_id; while it has more than one node, every 16 consecutive nodes (the
last run may have fewer, even one) become their H. The subroots make one more tree, in the order of
their sources.

Rows are dealt by ranges of (source, doc_id), so a source of any size is spread, and numbered within
their source. Blocks of 16^3 consecutive leaves are aligned with the tree, so each is a whole
subtree: a recursive traversal in postorder returns its digest and, while it unwinds, appends the
siblings of every child to the leaves below that child. Block roots are the leaves of the next
distributed traversal, blocks again, until a tree has one node; then the siblings found above are
handed down to the blocks, whose leaves get their whole proof. No task holds more than a block, and
the driver sees only how many nodes the largest tree has.

Defined results: null sources are one tree, the first. Null doc_ids come first in their tree; rows
that repeat a doc_id are leaves of their own, ordered by digest, and equal rows have equal leaves and
proofs by place. Null and empty texts differ. Very long texts are only hashed. An empty table has no
leaf and no root, so the result is empty. Columns other than the five aren't read or returned,
whatever their names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axonframe.plans.ranks import numbered
from axonframe.plans.session import cut

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "array<struct<before: string, after: string>>"


@dataclass(frozen=True)
class Settings:
    """``arity``: nodes of a run; a block has ``arity ** levels`` leaves."""

    arity: int = 16
    levels: int = 3

    @property
    def block(self) -> int:
        return self.arity**self.levels

    def height(self, nodes: int) -> int:
        """Levels from ``nodes`` to one."""
        n = 0
        while nodes > 1:
            nodes, n = -(-nodes // self.arity), n + 1
        return n


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: dict[str, Column] | None = None) -> Column:
    """The digest of a row; ``columns`` replaces some of its values."""
    values = {c: F.col(c) for c in COLUMNS} | (columns or {})
    return F.sha2(F.concat(*(field(values[c]) for c in COLUMNS)), 256)


def folded(start: Column, proof: Column) -> Column:
    """The root that follows from a leaf's digest and its proof."""
    return F.aggregate(proof, start, lambda node, level: F.sha2(F.concat(level["before"], node, level["after"]), 256))


def siblings(proof: Column) -> Column:
    """All sibling digests of a proof, put together level by level, left to right."""
    return F.aggregate(proof, F.lit(""), lambda text, level: F.concat(text, level["before"], level["after"]))


def traverse(digests: list[str], height: int, arity: int) -> tuple[str, list[list[tuple[str, str]]]]:
    """The digest of the subtree over ``digests``; and for each of them the digests before and after it in its run, by level."""
    proofs: list[list[tuple[str, str]]] = [[] for _ in digests]

    def visit(first: int, last: int, level: int) -> str:
        if level == 0:
            return digests[first]
        step = arity ** (level - 1)
        starts = range(first, last, step)
        children = [visit(a, min(a + step, last), level - 1) for a in starts]
        for k, a in enumerate(starts):
            beside = ("".join(children[:k]), "".join(children[k + 1 :]))
            for i in range(a, min(a + step, last)):
                proofs[i].append(beside)
        return hashlib.sha256("".join(children).encode()).hexdigest()

    return visit(0, len(digests), height), proofs


def block_height(total: int, s: Settings) -> int:
    """Blocks of a tree with several are whole levels high; the only block of a tree is as high as the tree."""
    return s.levels if total > s.block else s.height(total)


def block_roots(nodes: DataFrame, s: Settings) -> DataFrame:
    """(tree, pos, total, digest) of the blocks of (tree, pos, total, digest, block): the leaves of the next traversal."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        total = rows["total"][0].as_py()
        digest, _ = traverse(rows["digest"].to_pylist(), block_height(total, s), s.arity)
        return pa.table({"tree": rows["tree"].slice(0, 1), "pos": rows["block"].slice(0, 1), "total": pa.array([-(-total // s.block)], pa.int64()), "digest": [digest]})

    return nodes.select("tree", "block", "pos", "total", "digest").groupBy("tree", "block").applyInArrow(run, "tree string, pos long, total long, digest string")


def hand_down(nodes: DataFrame, above: DataFrame, s: Settings) -> DataFrame:
    """``nodes`` with their proof: their siblings within the block, then those of the block's root in ``above`` (tree, block, and the columns to pass on)."""
    passed = [f for f in above.schema if f.name not in ("tree", "block", "proof")]

    def run(rows: pa.Table, top: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        _, own = traverse(rows["digest"].to_pylist(), block_height(rows["total"][0].as_py(), s), s.arity)
        rest = [(x["before"], x["after"]) for x in top["proof"][0].as_py()]
        flat = [x for proof in own for x in (*proof, *rest)]
        pairs = pa.StructArray.from_arrays([pa.array([x[i] for x in flat], pa.string()) for i in (0, 1)], ["before", "after"])
        each = (len(own[0]) + len(rest)) if own else 0
        rows = rows.append_column("proof", pa.ListArray.from_arrays(pa.array(range(0, each * len(own) + 1, each) if each else [0] * (len(own) + 1), pa.int32()), pairs))
        for f in passed:
            rows = rows.append_column(f.name, pa.array([top[f.name][0].as_py()] * len(own), pa.string()))
        return rows

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema), f"proof {PROOF}", *(f"`{f.name}` string" for f in passed)])
    return nodes.groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInArrow(run, schema)


def blocked(nodes: DataFrame, s: Settings) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / s.block))


def climb(nodes: DataFrame, s: Settings) -> DataFrame:
    """(tree, pos, proof, top) of (tree, pos, total, digest): traversals of blocks of blocks, until trees have one node."""
    if (nodes.agg(F.max("total")).first()[0] or 0) <= 1:
        return nodes.select("tree", "pos", F.array().cast(PROOF).alias("proof"), F.col("digest").alias("top"))
    nodes = blocked(nodes.select("tree", "pos", "total", "digest"), s)
    above = climb(cut(block_roots(nodes, s)), s).withColumnRenamed("pos", "block")
    return hand_down(nodes, above, s).select("tree", "pos", "proof", "top")


def manifest(docs: DataFrame, carry: dict[str, Column] | None = None, s: Settings = Settings()) -> DataFrame:
    """doc_id, leaf, subroot, root and proof of every row, and the strings of ``carry``.

    ``proof`` has, from the leaf's run up to the root's, the digests ``before`` and ``after`` the
    node on its way; ``folded(leaf, proof)`` gives the root.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))  # null first, then by bytes
    more = {f"carried_{name}": value.cast("string") for name, value in (carry or {}).items()}
    rows = cut(docs.select(tree.alias("tree"), F.col("doc_id").alias("id"), leaf().alias("digest"), *(v.alias(k) for k, v in more.items())))  # texts are read once
    leaves = blocked(numbered(rows, "tree", ["id", "digest"]), s)
    within = cut(climb(cut(block_roots(leaves, s)), s))
    subroots = within.filter("pos = 0").select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("top").alias("digest"))
    placed = cut(numbered(subroots, "tree", ["of"]))
    over = climb(placed, s).select("pos", F.col("proof").alias("rest"), F.col("top").alias("root"))
    over = placed.select(F.col("of").alias("tree"), "pos").join(over, "pos").drop("pos")
    above = within.join(over, "tree").select("tree", F.col("pos").alias("block"), F.concat("proof", "rest").alias("proof"), F.col("top").alias("subroot"), "root")
    found = hand_down(leaves, above, s)
    return found.select(F.col("id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", "proof", *(F.col(f"carried_{name}").alias(name) for name in carry or {}))


def tamper_check(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The manifest, and what the proofs say where texts were tampered with: A-Z lower-cased in rows whose crc32 of the id divides by 5."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = manifest(docs, {"now": F.when(hit, leaf({"text": lower})).otherwise(F.lit(None))}, s)
    found = found.withColumn("folded_root", folded(F.coalesce("now", "leaf"), F.col("proof")))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
