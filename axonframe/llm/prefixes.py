"""A trie of conversations by their turns, and what its nodes share.

Every node is a distinct sequence of first turns; its members are the conversations that start with
it. Conversations with the same turns are one class, found by an order-aware digest that is summed up
before the shuffle, and travel once with their number. Classes are dealt out by the digest of their
first turn: a bucket holds the subtries of many first turns, built as pointer dictionaries (a node's
children by the digest of their turn) inside one grouped call, and summed up from the leaves by an
iterative postorder.

A first-turn subtrie of more than ``most`` turns isn't built in a task. The stretch that all its
classes share is one chain of nodes, taken from its smallest conversation; behind it the classes are
dealt out again by their next turn, and so on until every part is small. The nodes above are summed
up from the tops of the parts below. So no task holds a popular opening, a long shared opening or a
very long conversation, and nothing is left out.

Ids of members that end at a node are joined and hashed: in one expression where they are few; else
in slices that one task reads in order, one after the other, with a running hash.

Defined results: turns are ordered by number (null first), ties by the digest of role and text; null
role or text is empty. Rows without conv_id belong to no conversation. A conversation without turns is a member of
the root alone. Texts of any length are read once, for digest and words. Conversations that repeat
rows have the turn twice. An empty table has no conversation, so no root, and gives an empty result.
Columns other than conv_id, turn, role and text are neither read nor returned, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from axonframe.llm.mixing import size_of
from axonframe.plans.ranks import numbered
from axonframe.plans.session import cut

NONE = hashlib.sha256(b"").hexdigest()
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@dataclass(frozen=True)
class Settings:
    """``most``: turns of a subtrie that is built in one call; ``bucket``: turns of a bucket, on average; ``ids``: of a slice; ``chain``: nodes whose tokens are summed up in one window."""

    most: int = 2000
    bucket: int = 8000
    ids: int = 512
    chain: int = 4096


@dataclass(frozen=True)
class Borrow:
    """How conversations are rebuilt: the first crc32(id) % ``heads`` turns are those of the first id of their ``block``."""

    block: int = 20
    heads: int = 4


def read(conversations: DataFrame) -> DataFrame:
    """(conv_id, i from 1, turns of the conversation, key, words): the digest of role and text, and the words of the text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", key.alias("key"), size_of().alias("words"))
    return numbered(cut(rows), "conv_id", ["turn", "key"], total="turns").select("conv_id", (F.col("pos") + 1).alias("i"), "turns", "key", "words")


def rebuilt(own: DataFrame, b: Borrow = Borrow()) -> DataFrame:
    """(conv_id, i, key, words) with the first turns borrowed. Conversations may end up without turns."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % b.heads
    of = F.col("conv_id") - F.col("conv_id") % b.block
    firsts = own.filter((F.col("conv_id") % b.block == 0) & (F.col("i") < b.heads)).select(F.col("conv_id").alias("of"), "i", "turns", "key", "words")
    each = own.filter("i = 1").select("conv_id", h.alias("h"), of.alias("of"))
    lent = each.join(firsts, "of").filter("i <= h").select("conv_id", "i", "key", "words")
    have = firsts.filter("i = 1").select("of", F.col("turns").alias("there"))
    kept = own.select("conv_id", "i", "key", "words", h.alias("h"), of.alias("of")).filter("i > h").join(have, "of", "left")
    return lent.union(kept.select("conv_id", F.col("i") - F.col("h") + F.least("h", F.coalesce("there", F.lit(0))), "key", "words"))


def classes(turns: DataFrame, ids: DataFrame, s: Settings) -> DataFrame:
    """(conv_id, turns, members, ends): one row for each distinct sequence of turns, under its smallest id, with the hash of its ids."""
    digest = F.md5(F.concat(F.col("i").cast("string"), F.lit(":"), F.hex("key")))
    parts = [F.conv(F.substring(digest, at, 15), 16, 10).cast("long") for at in (1, 16)]
    whole = turns.groupBy("conv_id").agg(F.count("*").alias("n"), *(F.bit_xor(x).alias(f"x{k}") for k, x in enumerate(parts)))
    same = ids.join(whole, "conv_id", "left").select("conv_id", F.concat_ws(":", *(F.coalesce(c, F.lit(0)).cast("string") for c in ("n", "x0", "x1"))).alias("class"), F.coalesce("n", F.lit(0)).alias("turns"))
    placed = numbered(cut(same), "class", ["conv_id"], total="members").withColumn("slice", F.floor(F.col("pos") / s.ids))
    joined = F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",")
    sliced = placed.groupBy("class", "slice", "turns", "members").agg(joined.alias("text"), F.min("conv_id").alias("conv_id"))
    few = sliced.filter(F.col("members") <= s.ids).select("conv_id", "turns", "members", F.sha2("text", 256).alias("ends"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []  # class, first row, hash

        def done() -> pa.RecordBatch:
            return pa.record_batch([*(pa.array([x], pa.int64()) for x in held[1]), pa.array([held[2].hexdigest()])], ["conv_id", "turns", "members", "ends"])

        for b in batches:
            for name, conv, n, members, text in zip(*(b.column(c).to_pylist() for c in ("class", "conv_id", "turns", "members", "text")), strict=True):
                if held and held[0] == name:
                    held[2].update(b"," + text.encode())
                    continue
                if held:
                    yield done()
                held[:] = [name, (conv, n, members), hashlib.sha256(text.encode())]
        if held:
            yield done()

    many = sliced.filter(F.col("members") > s.ids).repartition("class").sortWithinPartitions("class", "slice")
    many = many.select("class", "conv_id", "turns", "members", "text").mapInArrow(run, "conv_id long, turns long, members long, ends string")
    return few.union(many)


def build(rows: pa.Table) -> pa.Table:
    """The nodes of a bucket: pointer dictionaries filled class by class, then sums from the leaves up."""
    rows = rows.sort_by([("group", "ascending"), ("conv_id", "ascending"), ("i", "ascending")])
    columns = [rows[c].to_pylist() for c in ("group", "depth", "above", "above_conv", "conv_id", "i", "key", "words", "turns", "members", "ends")]
    tops: dict[bytes, int] = {}
    children: list[dict[bytes, int]] = []
    parent, conv, depth, words, n, ends = [], [], [], [], [], []
    above: dict[int, tuple[bytes | None, int]] = {}
    node = -1
    for group, first, over, over_conv, conv_id, i, key, w, turns, members, hashed in zip(*columns, strict=True):
        before, known = (-1, tops) if i == first else (node, children[node])
        name = group if i == first else key
        node = known.get(name, -1)
        if node < 0:
            node = known[name] = len(conv)
            if i == first:
                above[node] = (over, over_conv)
            parent.append(before)
            conv.append(conv_id)
            depth.append(i)
            words.append(w)
            n.append(0)
            ends.append(NONE)
            children.append({})
        n[node] += members
        conv[node] = min(conv[node], conv_id)
        if i == turns:
            ends[node] = hashed
    leaves, saved = [0] * len(conv), [(n[x] - 1) * words[x] for x in range(len(conv))]
    order, stack = [], list(tops.values())
    while stack:
        order.append(x := stack.pop())
        stack.extend(children[x].values())
    for x in reversed(order):  # children come before their parents
        leaves[x] = leaves[x] or 1
        if parent[x] >= 0:
            leaves[parent[x]] += leaves[x]
            saved[parent[x]] += saved[x]
    up = [above[x][1] if x in above else conv[parent[x]] for x in range(len(conv))]
    numbers = [conv, depth, up, n, [len(c) for c in children], leaves, saved]
    return pa.table({**{c: pa.array(v, pa.int64()) for c, v in zip(NODE[:-1], numbers, strict=True)}, "ends_sha256": ends, "is_top": [x in above for x in range(len(conv))], "above": pa.array([above[x][0] if x in above else None for x in range(len(conv))], pa.binary())})


def tries(turns: DataFrame, parts: DataFrame, s: Settings) -> DataFrame:
    """The nodes of all small subtries."""
    rows = turns.join(parts.select("conv_id", "group", "depth", "above", "above_conv"), "conv_id").filter("i >= depth")
    total = parts.select((F.col("turns") - F.col("depth") + 1).alias("n")).agg(F.sum("n")).first()[0] or 0
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("group"), F.lit(max(1, -(-total // s.bucket)))))
    schema = ", ".join([*(f"{c} long" for c in NODE[:-1]), "ends_sha256 string, is_top boolean, above binary"])
    return dealt.groupBy("bucket").applyInArrow(lambda t: build(t), schema)


def split(turns: DataFrame, over: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of subtries that are too large: their shared stretch (group, ..., fork: the depth where it ends), and their classes dealt out by the turn at the fork."""
    rows = cut(turns.select("conv_id", "i", "key").join(over, "conv_id").filter("i >= depth"))
    at = rows.groupBy("group", "i").agg(F.min("key").alias("least"), F.max("key").alias("most"), F.count("*").alias("n"), F.first("classes").alias("classes"))
    forks = at.filter((F.col("least") != F.col("most")) | (F.col("n") < F.col("classes"))).groupBy("group").agg(F.min("i").alias("at"))
    last = over.groupBy("group", "depth", "above", "above_conv", "top_conv", "n_convs").agg(F.max("turns").alias("last"))
    shared = last.join(forks, "group", "left").withColumn("fork", F.coalesce("at", F.col("last") + 1))
    ended = over.join(shared.select("group", "fork"), "group").filter(F.col("turns") == F.col("fork") - 1).select("group", F.col("ends").alias("ended"))
    chains = cut(shared.join(ended, "group", "left").select("group", "depth", "above", "above_conv", "top_conv", "n_convs", "fork", F.coalesce("ended", F.lit(NONE)).alias("ends")))
    behind = rows.join(chains.select("group", "fork"), "group").filter(F.col("i") == F.col("fork"))
    dealt = behind.select("conv_id", "turns", "members", "ends", F.unhex(F.sha2(F.concat("group", "key"), 256)).alias("group"), F.col("fork").alias("depth"), F.col("group").alias("above"), F.col("top_conv").alias("above_conv"))
    return chains, dealt


def sums(tops: DataFrame) -> DataFrame:
    """What the nodes on top of the parts below bring to (above)."""
    return tops.groupBy("above").agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("below"))


def chain_nodes(turns: DataFrame, chains: DataFrame, tops: DataFrame, s: Settings) -> DataFrame:
    """The nodes of shared stretches; ``tops``: those of the parts behind them."""
    path = turns.select(F.col("conv_id").alias("top_conv"), "i", "words").join(chains, "top_conv").filter("i >= depth and i < fork")
    path = cut(path.withColumns({"each": (F.col("n_convs") - 1) * F.col("words"), "stretch": F.floor(F.col("i") / s.chain)}))
    whole = path.groupBy("group", "stretch").agg(F.sum("each").alias("sum"))
    after = W.partitionBy("group").orderBy(F.desc("stretch")).rowsBetween(W.unboundedPreceding, -1)
    whole = whole.select("group", "stretch", F.coalesce(F.sum("sum").over(after), F.lit(0)).alias("after"))
    within = W.partitionBy("group", "stretch").orderBy(F.desc("i")).rowsBetween(W.unboundedPreceding, 0)
    below = sums(tops).withColumnRenamed("above", "group")
    found = path.join(whole, ["group", "stretch"]).withColumn("own", F.sum("each").over(within) + F.col("after")).join(below, "group", "left")
    is_top, is_last = F.col("i") == F.col("depth"), F.col("i") == F.col("fork") - 1
    return found.select(
        F.col("top_conv").alias("conv_id"), F.col("i").alias("depth"), F.when(is_top, F.col("above_conv")).otherwise(F.col("top_conv")).alias("parent_conv_id"), "n_convs",
        F.when(is_last, F.coalesce("children", F.lit(0))).otherwise(1).cast("long").alias("n_children"), F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"),
        (F.col("own") + F.coalesce("below", F.lit(0))).alias("saved_tokens"), F.when(is_last, F.col("ends")).otherwise(NONE).alias("ends_sha256"), is_top.alias("is_top"), "above",
    )


def nodes(turns: DataFrame, ids: DataFrame, s: Settings = Settings()) -> DataFrame:
    """All nodes of the trie of (conv_id, i from 1, key, words), with ``ids`` the conv_id of every conversation, those without turns too."""
    each = cut(classes(turns, ids, s))
    smallest, count = each.agg(F.min("conv_id"), F.sum("members")).first()
    turns = cut(turns.join(each, "conv_id"))
    part = turns.filter("i = 1").select("conv_id", "turns", "members", "ends", F.col("key").alias("group"), F.lit(1).cast("long").alias("depth"), F.lit(None).cast("binary").alias("above"), F.lit(smallest).cast("long").alias("above_conv"))
    small, chained = [], []
    while True:
        sizes = part.groupBy("group").agg(F.sum(F.col("turns") - F.col("depth") + 1).alias("size"), F.min("conv_id").alias("top_conv"), F.sum("members").alias("n_convs"), F.count("*").alias("classes"))
        sized = cut(part.join(sizes, "group"))
        small.append(sized.filter(F.col("size") <= s.most))
        over = sized.filter(F.col("size") > s.most)
        if over.isEmpty():
            break
        chains, part = split(turns, over)
        chained.append(chains)
    parts = small[0]
    for more in small[1:]:
        parts = parts.union(more)
    found = cut(tries(turns, parts, s))
    for chains in reversed(chained):
        found = cut(found.union(chain_nodes(turns, chains, found.filter("is_top"), s)))
    top = found.filter("is_top and above is null").agg(F.count("*").alias("n_children"), F.coalesce(F.sum("n_leaves"), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"))
    if smallest is None:
        return found.select(*NODE)
    ended = each.filter("turns = 0").agg(F.max("ends")).first()[0] or NONE
    root = top.select(*(x.cast("long").alias(c) for x, c in ((F.lit(smallest), "conv_id"), (F.lit(0), "depth"), (F.lit(None), "parent_conv_id"), (F.lit(count), "n_convs"))), "n_children", "n_leaves", "saved_tokens", F.lit(ended).alias("ends_sha256"))
    return found.select(*NODE).union(root.select(*NODE))


def shared_prefixes(conversations: DataFrame, borrow: Borrow = Borrow(), s: Settings = Settings()) -> DataFrame:
    """The trie of the rebuilt conversations."""
    own = cut(read(conversations))
    return nodes(rebuilt(own, borrow), own.filter("i = 1").select("conv_id"), s)
