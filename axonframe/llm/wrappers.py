"""HTML extraction by wrapper induction: the trees of a host's pages are aligned by simple tree matching.

Pages of a host with the same layout (the containers from the root down to a fixed depth) are one
group, and one of them is its reference tree. Every page of the group is aligned with the reference:
matched nodes have equal tags and classes, and of all order-preserving matchings of two nodes'
children the one with the largest total subtree match is taken. Many inner-less siblings of one kind
(paragraphs, items) are one slot. Nodes without a partner are slots of their own below the
last matched node. Spark counts, over all different pages of a group, which texts each slot has:

- a text that ``constant`` of the pages have in its slot, two pages at least, is template;
- a slot in which few different texts keep recurring (rotating adverts, menus, footers) is template
  too, if ``many`` were seen and all such slots together are the smaller part of the group's text;
- all other slots vary. The content is the deepest reference node with ``share`` of the varying text
  that no name marks, and with the headings beside it.

A page is read by aligning it with the wrapper of its group, a page whose layout is its own with that of
its host's largest group: the content node without template. Names decide only what counts don't:
varying parts marked as menus, comments, adverts and so on by tag, role or a whole class or id are
left out, an article within such a part with it. Pages without a wrapper (hosts with one page, no
host) are read by names alone: the articles, or the main element, or the page. What would be empty is
read again with template texts, but never with marked parts: a page of menus, notices or forms alone has no text. Two or three pages that share over half of their texts
are taken for near copies, whose content is kept.

Wrappers are broadcast only if their measured size is small; otherwise pages and wrappers meet by
group and salt.

Defined results: null html is empty and gives an empty text; a null or odd url has no host and no wrapper;
equal rows give equal rows, and count once; very long pages are read whole, elements nest at any
depth. Children beyond ``cells`` pairs of two nodes are matched in order of their kinds instead of by
the best sum. Columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axonframe.llm.dom import BLOCK, HEADINGS, Page, clean, parse
from axonframe.llm.text import slices
from axonframe.plans.session import cut


@dataclass(frozen=True)
class Settings:
    """``constant``: the share of a group's pages in which a template text is the same; ``least``: pages for a wrapper; of less than ``few`` pages that share over half of their texts, all are content; ``rotating``: different texts among those of a slot at most, for a template slot."""

    least: int = 2
    few: int = 4
    constant: float = 0.8
    many: int = 8
    rotating: float = 0.5
    share: float = 0.9
    salts: int = 32
    broadcast_refs: int = 100_000
    broadcast_bytes: int = 8_000_000


CELLS, DEEP, ALIKE = 40_000, 40, 3
#: The elements that make a layout, and how deep they count.
FRAME = frozenset("html body div section main article header footer nav aside form".split())
FRAME_DEPTH = 5


def host_of(url: str = "url") -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def hashed(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def layout_of(page: Page) -> str:
    """The containers of a page by path, without repeats; what an article or main holds is content."""
    paths: dict[int, str] = {0: ""}
    for i in range(1, len(page.tag)):
        up = paths.get(page.parent[i])
        if up is not None and page.tag[i] in FRAME and up.count(">") < FRAME_DEPTH and page.tag[page.parent[i]] not in ("article", "main"):
            paths[i] = f"{up}>{page.key[i]}"
    return "\n".join(sorted(set(paths.values())))


def own_texts(page: Page) -> list[str]:
    """For each block what stands in it and in its inline elements, not in blocks inside it; nothing for hidden parts."""
    found: dict[int, list[str]] = {}
    stack, events, at = [0], page.events, 1
    while at < len(events) - 1:
        e = events[at]
        at += 1
        if isinstance(e, str):
            found.setdefault(stack[-1], []).append(e)
        elif e < 0:
            if stack[-1] == ~e:
                stack.pop()
        elif page.hidden[e]:
            at = page.closed[e] + 1
        elif page.tag[e] == "br":
            found.setdefault(stack[-1], []).append(" ")
        elif page.tag[e] in BLOCK:
            stack.append(e)
    out = [""] * len(page.tag)
    for i, parts in found.items():
        out[i] = " ".join("".join(parts).split())
    return out


class Shape:
    """A page's blocks as a tree: children that are blocks or hold some, subtree sizes and signatures."""

    def __init__(self, page: Page):
        n = len(page.tag)
        self.page, self.size, self.children = page, [1] * n, [[] for _ in range(n)]
        self.signature: list[int] = [0] * n
        blocks = [False] * n
        for i in range(n - 1, -1, -1):
            children = self.children[i]
            children.reverse()
            self.signature[i] = hash((page.key[i], *(self.signature[c] for c in children)))
            if i and (children or blocks[i] or page.tag[i] in BLOCK):
                up = page.parent[i]
                self.children[up].append(i)
                self.size[up] += self.size[i]
        #: Kinds of which a node has several children without inner blocks.
        self.alike = [{k for k, m in Counter(page.key[c] for c in cs if not self.children[c]).items() if m >= ALIKE} if len(cs) >= ALIKE else () for cs in self.children]


class Matching:
    """Simple tree matching of a page with a reference."""

    def __init__(self, a: Shape, b: Shape):
        self.a, self.b, self.known = a, b, {}

    def weight(self, i: int, j: int, depth: int = 0) -> int:
        """Nodes of the best matching of two subtrees; 0 if their roots differ."""
        a, b = self.a, self.b
        if a.page.key[i] != b.page.key[j]:
            return 0
        if a.signature[i] == b.signature[j]:
            return a.size[i]
        if depth >= DEEP:
            return 1
        if (i, j) not in self.known:
            self.known[i, j] = 1 + sum(self.weight(x, y, depth + 1) for x, y in self.pairs(a.children[i], b.children[j], depth + 1))
        return self.known[i, j]

    def pairs(self, xs: list[int], ys: list[int], depth: int = 0) -> list[tuple[int, int]]:
        """Matched children in order, with the largest sum of weights."""
        s, t = self.a.signature, self.b.signature
        n = 0
        while n < min(len(xs), len(ys)) and s[xs[n]] == t[ys[n]]:
            n += 1
        found = list(zip(xs[:n], ys[:n], strict=True))
        xs, ys = xs[n:], ys[n:]
        m = 0
        while m < min(len(xs), len(ys)) and s[xs[-1 - m]] == t[ys[-1 - m]]:
            m += 1
        last = list(zip(xs[len(xs) - m :], ys[len(ys) - m :], strict=True))
        xs, ys = xs[: len(xs) - m], ys[: len(ys) - m]
        return found + (self.best(xs, ys, depth) if xs and ys else []) + last

    def best(self, xs: list[int], ys: list[int], depth: int) -> list[tuple[int, int]]:
        a, b = self.a.page.key, self.b.page.key
        if len(xs) * len(ys) > CELLS:
            found, j = [], 0
            where: dict[str, list[int]] = {}
            for k, y in enumerate(ys):
                where.setdefault(b[y], []).append(k)
            used = dict.fromkeys(where, 0)
            for x in xs:
                places = where.get(a[x], ())
                u = used.get(a[x], 0)
                while u < len(places) and places[u] < j:
                    u += 1
                if u < len(places):
                    found.append((x, ys[places[u]]))
                    j, used[a[x]] = places[u] + 1, u + 1
            return found
        w = [[self.weight(x, y, depth) for y in ys] for x in xs]
        top = [[0] * (len(ys) + 1)]
        for row in w:
            last, line = top[-1], [0]
            for j, v in enumerate(row):
                line.append(max(last[j + 1], line[j], last[j] + v if v else 0))
            top.append(line)
        found, i, j = [], len(xs), len(ys)
        while i and j:
            if top[i][j] == top[i - 1][j]:
                i -= 1
            elif top[i][j] == top[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                found.append((xs[i], ys[j]))
        return found[::-1]

    def slots(self) -> tuple[list[tuple[int, int]], dict[int, int]]:
        """(reference node, tail) of each node, where a tail of 0 is the reference node itself; and the page's node of each matched reference node."""
        a, b, page = self.a, self.b, self.a.page
        slot: list[tuple[int, int]] = [(0, 0)] * len(page.tag)
        partner, todo = {0: 0}, [(0, 0)]
        while todo:
            i, j = todo.pop()
            slot[i] = (j, 0)
            partner[j] = i
            alike = b.alike[j]
            some = [c for c in a.children[i] if page.key[c] not in alike or a.children[c]]
            matched = self.pairs(some, [c for c in b.children[j] if b.page.key[c] not in alike or b.children[c]])
            todo += matched
            with_partner = {x for x, _ in matched}
            for c in a.children[i]:
                if c not in with_partner:
                    slot[c] = (j, zlib.crc32(page.key[c].encode("utf-8", "surrogatepass")))
                    for d in range(c + 1, page.end[c]):
                        slot[d] = (j, zlib.crc32(page.key[d].encode("utf-8", "surrogatepass"), slot[page.parent[d]][1]))
        return slot, partner


def place(slot: tuple[int, int]) -> int:
    return slot[0] << 32 | slot[1]


class Wrapper:
    """What is known of a group: its reference, template texts by slot, template slots and the content's reference node (-1 if unknown)."""

    def __init__(self, html: str, texts: list[int], slots: list[int], content: int):
        self.shape, self.texts, self.slots, self.content = Shape(parse(html)), set(texts), set(slots), content


def read(page: Page, wrapper: Wrapper | None = None, by_name: bool = True) -> str:
    """The main text of a page. If nothing is left, template texts are read too; what names, roles or tags mark never is, unless ``by_name`` is taken away."""
    template = [False] * len(page.tag)
    target = None
    if wrapper:
        slot, partner = Matching(Shape(page), wrapper.shape).slots()
        for i, own in enumerate(own_texts(page)):
            if own:
                template[i] = place(slot[i]) in wrapper.slots or hashed(str(place(slot[i])), own) in wrapper.texts
        target = partner.get(wrapper.content) if wrapper.content >= 0 else None
    skip = page.aside if by_name else page.hidden
    for strict in (True, False):
        if got := "\n".join(blocks(page, content_roots(page, target, skip), skip, by_name, template if strict else None)):
            return got
    return ""


def content_roots(page: Page, target: int | None, skip: list[bool]) -> list[int]:
    """The content node that the alignment found. Without it the outer articles, or mains, or all."""
    if target is not None:
        return [target]
    outer: dict[str, list[int]] = {"article": [], "main": []}
    i = 1
    while i < len(page.tag):
        if skip[i]:
            i = page.end[i]
            continue
        kind = outer.get(page.tag[i])
        if kind is not None and not (kind and page.inside(i, kind[-1])):
            kind.append(i)
        i += 1
    return outer["article"] or outer["main"] or [0]


def blocks(page: Page, roots: list[int], skip: list[bool], named: bool, template: list[bool] | None) -> Iterator[str]:
    """The block texts below the roots; a header outside of an article is the site's."""
    events = page.events
    for root in roots:
        begin = 0 if root == 0 else next(k for k in range(root, len(events)) if events[k] == root)
        own = page.tag[root] not in ("#", "html", "body")
        articles, stack, parts, at = int(own), [root], [], begin + 1
        while at < page.closed[root]:
            e = events[at]
            at += 1
            if isinstance(e, str):
                if template is None or not template[stack[-1]]:
                    parts.append(e)
                continue
            i = e if e >= 0 else ~e
            tag = page.tag[i]
            if e >= 0 and (skip[i] or tag == "header" and named and not articles):
                at = page.closed[i] + 1
                continue
            articles += (tag in ("article", "main")) * (1 if e >= 0 else -1)
            if tag == "br":
                parts.append(" ")
            elif tag in BLOCK:
                if parts and (done := clean("".join(parts))):
                    yield done
                parts = []
                if e >= 0:
                    stack.append(i)
                else:
                    stack.pop()
        if parts and (done := clean("".join(parts))):
            yield done


def group_of(host: int | None, page: Page) -> int | None:
    """A hash of host and layout, null without a host."""
    return None if host is None else hashed(str(host), layout_of(page))


def with_layout(pages: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [group_of(h, parse(p or "")) for h, p in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True)]
            yield pa.record_batch([*b.columns, pa.array(found, pa.int64())], [*b.schema.names, "layout"])

    return pages.mapInArrow(run, T.StructType([*pages.schema.fields, T.StructField("layout", T.LongType())]))


def references(pages: DataFrame, s: Settings) -> DataFrame:
    """(group, layout, n, html): different pages and reference of each layout of ``least`` pages, and of a host as its own group those of its largest such layout."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, int] = {}
        for b in slices(batches):
            layouts, contents, kept = [], [], []
            for h, p in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
                layout, content = group_of(h, parse(p or "")), hashed(p or "")
                first = content < least.get(layout, 1 << 63)
                if first:
                    if len(least) >= 100_000:
                        least.clear()
                    least[layout] = content
                layouts.append(layout)
                contents.append(content)
                kept.append(p or "" if first else None)
            yield pa.record_batch([b.column("host"), pa.array(layouts, pa.int64()), pa.array(contents, pa.int64()), pa.array(kept, pa.string())], ["host", "layout", "content", "html"])

    seen = cut(pages.filter("host IS NOT NULL").select("host", "html").mapInArrow(run, "host long, layout long, content long, html string"))
    sizes = seen.select("host", "layout", "content").distinct().groupBy("host", "layout").agg(F.count("*").alias("n"), F.min("content").alias("content")).filter(F.col("n") >= s.least)
    texts = seen.filter("html IS NOT NULL").groupBy("layout", "content").agg(F.first("html").alias("html"))
    found = cut(sizes.join(texts, ["layout", "content"]).select("host", "layout", "n", "html"))
    largest = found.withColumn("k", F.row_number().over(W.partitionBy("host").orderBy(F.desc("n"), "layout"))).filter("k = 1")
    return found.select(F.col("layout").alias("group"), "layout", "n", "html").union(largest.select(F.col("host").alias("group"), "layout", "n", "html"))


class Known:
    """Wrappers by group, built once; cleared when they have grown to their bound. ``held`` are the rows that are broadcast, if any."""

    BOUND = 256

    def __init__(self, held: Broadcast | None):
        self.held, self.built = held and held.value, {}

    def of(self, host: int | None, layout: int | None, w: dict | None) -> tuple[dict | None, Wrapper | None]:
        """What is known of a page's layout, or else of its host."""
        if self.held is not None:
            w = self.held.get(layout) or self.held.get(host)
        if w is None:
            return None, None
        if w["group"] not in self.built:
            if len(self.built) >= self.BOUND:
                self.built.clear()
            self.built[w["group"]] = Wrapper(w["html"], w.get("texts", []), w.get("slots", []), w.get("content", -1))
        return w, self.built[w["group"]]


def met(pages: DataFrame, held: DataFrame, s: Settings) -> tuple[DataFrame, Broadcast | None]:
    """``held`` by group as a broadcast, if its measured size is small; else pages with a column ``w``, what it has for their layout or host."""
    lists = [f.name for f in held.schema if isinstance(f.dataType, T.ArrayType)]
    size = sum((8 * F.size(c) for c in lists), F.length("html") + 50)
    count, total = held.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    if count <= s.broadcast_refs and total <= s.broadcast_bytes:
        return pages.withColumn("w", F.lit(None).cast(held.schema)), pages.sparkSession.sparkContext.broadcast({r["group"]: r.asDict() for r in held.collect()})
    packed = held.select("group", F.struct(*held.columns).alias("x"), F.explode(F.sequence(F.lit(0), F.lit(s.salts - 1))).alias("salt"))
    pages = with_layout(pages).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(s.salts)).cast("int"))
    for key in ("layout", "host"):
        pages = pages.join(packed.withColumnsRenamed({"group": key, "x": f"of_{key}"}), [key, "salt"], "left")
    return pages.withColumn("w", F.coalesce("of_layout", "of_host")), None


def seen_texts(pages: DataFrame, refs: DataFrame, s: Settings) -> DataFrame:
    """(group, n, anchor, tail, text, size, pages): in how many different pages of a group each slot has each text."""
    names = ["group", "n", "anchor", "tail", "text", "size", "content"]
    pages, held = met(pages.filter("host IS NOT NULL"), refs, s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(held)
        for b in slices(batches):
            rows = []
            for text, host, w in zip(*(b.column(c).to_pylist() for c in ("html", "host", "w")), strict=True):
                page = parse(text or "")
                layout = group_of(host, page)
                w, wrapper = known.of(host, layout, w)
                if w and w["group"] == layout:  # lone layouts are read with the host's wrapper and don't teach it
                    content = hashed(text or "")
                    slot, _ = Matching(Shape(page), wrapper.shape).slots()
                    rows += [(layout, w["n"], *slot[i], hashed(str(place(slot[i])), own), len(own), content) for i, own in enumerate(own_texts(page)) if own]
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            yield pa.record_batch([pa.array(list(c), pa.int64()) for c in columns], names)

    found = pages.select("html", "host", "w").mapInArrow(run, ", ".join(f"{c} long" for c in names))
    return found.distinct().groupBy("group", "n", "anchor", "tail", "text").agg(F.first("size").alias("size"), F.count("*").alias("pages"))


def induced(refs: DataFrame, seen: DataFrame, s: Settings) -> DataFrame:
    """(group, html, texts, slots, content): the wrapper of each group."""
    fixed = (F.col("pages") >= s.least) & (F.col("pages") >= s.constant * F.col("n"))
    varies = lambda x: F.sum(F.when(fixed, 0).otherwise(x))
    slots = seen.groupBy("group", "anchor", "tail").agg(
        varies(F.lit(1)).alias("kinds"), varies(F.col("pages")).alias("seen"), varies(F.col("pages") * F.col("size")).alias("chars"),
        F.sum(F.when(fixed, F.col("pages")).otherwise(0)).alias("same"), F.collect_list(F.when(fixed, F.col("text"))).alias("texts"),
    )
    once = F.col("same") + F.col("seen") <= 1  # slots of one page count where they hang, so a group's row is bounded by its reference and by what pages share
    numbers = [F.sum(c).alias(c) for c in ("kinds", "seen", "chars", "same")]
    slots = slots.groupBy("group", "anchor", F.when(once, F.lit(-1)).otherwise(F.col("tail")).alias("tail")).agg(*numbers, F.flatten(F.collect_list(F.when(~once, F.col("texts")))).alias("texts"))
    gathered = slots.groupBy("group").agg(F.collect_list(F.struct("anchor", "tail", "kinds", "seen", "chars", "same", "texts")).alias("stats"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for group, n, html, got in zip(*(b.column(c).to_pylist() for c in ("group", "n", "html", "stats")), strict=True):
                stats = got or []
                copies = n < s.few and 2 * sum(x["same"] for x in stats) > sum(x["same"] + x["seen"] for x in stats)
                texts = [] if copies else [t for x in stats for t in x["texts"]]
                rotating = [x for x in stats if x["seen"] >= s.many and x["kinds"] <= s.rotating * x["seen"]]
                if 2 * sum(x["chars"] for x in rotating) > sum(x["chars"] for x in stats):
                    rotating = []
                places = [place((x["anchor"], x["tail"])) for x in rotating]
                left = [x for x in stats if place((x["anchor"], x["tail"])) not in set(places)]
                rows.append((group, html, texts, places, content_node(parse(html), left, s)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64())
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["group", "html", "texts", "slots", "content"])

    return refs.join(gathered, "group", "left").mapInArrow(run, "group long, html string, texts array<long>, slots array<long>, content long")


def content_node(page: Page, stats: list[dict], s: Settings) -> int:
    """The deepest node with ``share`` of the varying text that isn't marked by names, and with the headings beside it."""
    n = len(page.tag)
    chars, marked = [0] * n, list(page.aside)
    for x in stats:
        chars[x["anchor"]] += x["chars"]
    for i in range(1, n):
        marked[i] = marked[i] or marked[page.parent[i]]
    varying = [0 if m else c for c, m in zip(chars, marked, strict=True)]
    total = list(varying)
    for i in range(n - 1, 0, -1):
        total[page.parent[i]] += total[i]
    if not total[0]:
        return -1
    at = max(i for i in range(n) if total[i] >= s.share * total[0])
    while at and page.tag[at] not in ("body", "article", "main"):
        up = page.parent[at]
        beside = [i for i in range(up + 1, page.end[up]) if varying[i] and not page.inside(i, at)]
        if page.tag[up] in ("html", "#") or not any(page.tag[i] in HEADINGS for i in beside) or any(page.tag[page.parent[i]] in ("nav", "footer") for i in beside):
            break
        at = up
    return at


def extract(rows: DataFrame, settings: Settings = Settings(), by_name: bool = True) -> DataFrame:
    """page_id, url, text and n_chars of every page; ``by_name`` may be taken away to see what the alignment alone finds."""
    s = settings
    pages = rows.select("page_id", "url", "html", F.when(host_of() != "", F.xxhash64(host_of())).alias("host"))
    refs = cut(references(pages, s))
    own = induced(refs.filter(F.col("group") == F.col("layout")), cut(seen_texts(pages, refs, s)), s)
    held = cut(refs.select("group", "layout").join(own.withColumnRenamed("group", "layout"), "layout").drop("layout"))

    pages, known_rows = met(pages, held, s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(known_rows)
        for b in slices(batches):
            texts = []
            for text, host, w in zip(*(b.column(c).to_pylist() for c in ("html", "host", "w")), strict=True):
                page = parse(text or "")
                texts.append(read(page, known.of(host, group_of(host, page) if known_rows else None, w)[1], by_name))
            yield pa.record_batch([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    schema = rows.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")
    return pages.select("page_id", "url", "html", "host", "w").mapInArrow(run, schema)
