import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from axonframe.llm import dom, mixing, packing, queries, secrets, wrappers

from ..compare import SMALL
from .fixtures import documents, odd_texts, run_sql

RULES = {
    "assign": (re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I), lambda m: len(m[2]) >= 6),
    "access": (re.compile(rb"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": (re.compile(rb"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
}
PIECES = ["token", "secret", "TOKEN", "api_key", "apikey", "passwd", "password", "=", ":", '"', "'", " ", "  ", "AKIA", "0123456789abcdef", "deadbeef", "A" * 9, "b" * 25, "é", "-", ".", "x", "abc", "==", "\n"]


def base_spans(text):
    data = text.encode()
    found = sorted((m.start(), k, m.end()) for k, (rule, keep) in enumerate(RULES.values()) for m in rule.finditer(data) if keep(m))
    point = lambda p: len(data[:p].decode("utf-8", "ignore"))
    return [(list(RULES)[k], point(a), point(b)) for a, k, b in found]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25).map("".join))
def test_automaton_finds_what_regexes_find(text):
    data = text.encode()
    got = secrets.code_points(data, secrets.scanner(secrets.RULES).spans(data))
    assert [s for s in got if s[0] in RULES] == base_spans(text)


def test_secret_scan_and_redaction(spark):
    rng = random.Random(5)
    texts = [*odd_texts(), "key: gh" + "p_" + "a1B2" * 9, *("".join(rng.choice(PIECES) for _ in range(30)) for _ in range(40))]
    docs = documents(spark, texts)
    got = {r.doc_id: r for r in secrets.scan(docs).collect()}
    for i, t in enumerate(texts):
        want = base_spans(t or "")
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(s[0] == k for s in want) for k in RULES)
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
    assert "github" in got[texts.index("key: gh" + "p_" + "a1B2" * 9)].spans
    clean = secrets.redact(docs)
    assert clean.columns == docs.columns and secrets.scan(clean).filter("n_access + n_hex > 0").count() == 0
    plain = {r.doc_id: r.text for r in clean.collect()}
    assert all(plain[i] == texts[i] for i in range(12)) and secrets.scan(docs.limit(0)).count() == 0


def test_packing_is_an_exact_round_trip(spark):
    texts = [*odd_texts(), *odd_texts(7), "don't <|endoftext|> 3.14", "a<|endoftext|>b <|ENDOFTEXT|> <|startoftext|>", "QUJDRA" * 5000 + " <| |>", "x\x1cy \x1f z", "Σίσυφος İ"]
    docs = documents(spark, texts)
    got = packing.pack(docs).toPandas()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, text in enumerate(texts):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        mine = got[got.doc_id == i].sort_values("start")
        assert mine.length.sum() == len(ids) and (mine.doc_tokens == len(ids)).all() and mine.start.tolist() == [0, *mine.length.cumsum()[:-1]]
        assert all(zlib.crc32(ids[a : a + n].tobytes()) == c for a, n, c in zip(mine.start, mine.length, mine.ids_crc32, strict=True))
    for _, rows in got.sort_values("offset").groupby("sequence_id"):
        assert rows.offset.tolist() == [0, *rows.length.cumsum()[:-1]] and rows.length.sum() <= 2048
    assert packing.pack(docs.limit(0)).count() == 0


@settings(max_examples=15, deadline=None)
@given(st.dictionaries(st.sampled_from(range(8, 2049, 8)), st.integers(1, 50), min_size=1, max_size=20))
def test_plan_uses_every_piece_once(histogram):
    used = {}
    for combo, times in packing.plan(histogram, packing.Settings())[0]:
        assert sum(combo) <= 2048 and times > 0
        for x in combo:
            used[x] = used.get(x, 0) + times
    assert used == histogram


def test_combinations_are_all_shallow_ones():
    lengths = [16, 24, 40, 64, 96, 128]
    want = {c for n in (1, 2, 3) for c in itertools.combinations_with_replacement(lengths[::-1], n) if sum(c) == 256}
    got = packing.combinations(lengths[::-1], 256, 3)
    assert {c for c in got if len(c) <= 3} == want and (64,) * 4 in got and (96,) + (40,) * 4 in got and all(sum(c) == 256 for c in got)


def test_equations_place_most_pieces():
    """Lengths like those of documents: nearly all pieces are placed by the solution, and little is padded."""
    rng = np.random.default_rng(2)
    lengths = np.minimum(2048, np.maximum(1, rng.lognormal(6.4, 0.8, 20_000))).astype(int)
    histogram = dict(zip(*(x.tolist() for x in np.unique(-(-lengths // 8) * 8, return_counts=True)), strict=True))
    steps, by_equations = packing.plan(histogram, packing.Settings())
    placed = sum(len(c) * t for c, t in steps[:by_equations])
    assert placed >= 0.95 * len(lengths) and lengths.sum() >= 0.99 * 2048 * sum(t for _, t in steps)


def test_nnls_against_projected_gradient():
    rng = np.random.default_rng(1)
    index, count, b = np.array([rng.permutation(12)[:3] for _ in range(20)]), rng.random((20, 3)), rng.random(12)
    a = np.zeros((12, 20))
    for j in range(20):
        a[index[j], j] = count[j]
    x, y = packing.nnls(index, count, b), np.zeros(20)
    for _ in range(40000):
        y = np.maximum(0, y - a.T @ (a @ y - b) / np.linalg.norm(a, 2) ** 2)
    assert (x >= 0).all() and np.linalg.norm(a @ x - b) <= np.linalg.norm(a @ y - b) + 1e-5


def test_mixing_equals_sql_and_meets_targets(spark):
    rng = random.Random(9)
    texts = [*odd_texts(), *(" ".join(["w"] * rng.randrange(1, 60)) for _ in range(400))]
    sources = [None if i % 9 == 0 else ["a", "b", "é", "Z", "big", "big", "big"][i % 7] for i in range(len(texts))]
    docs = documents(spark, texts, ids=[None, None, *range(2, len(texts))], sources=sources)
    got = mixing.shares(docs)
    want = run_sql(queries.OP9_SQL, documents=docs.select("doc_id", "text", "source").toPandas().astype({"doc_id": "Int64"}))
    tidy = lambda rows: sorted((-1 if r[0] is None else r[0], *(round(float(x), 6) for x in r[1:])) for r in rows)
    assert tidy(got.collect()) == tidy(want) and tidy(mixing.shares(docs).collect()) == tidy(want)
    p = got.toPandas()
    assert (p.taken <= 2 * p["size"]).all() and abs(p.groupby("source_size").target.first().sum() - 1.5 * p["size"].sum()) < 1e-6
    for _, rows in p.groupby(["source_size", "target"]):
        assert abs(rows.taken.sum() - rows.target.iloc[0]) <= 0.05 * rows.target.iloc[0] + 2 * rows["size"].max()
    mix = mixing.mixed(docs)
    assert mix.columns == docs.columns and mix.count() > 0 and mixing.shares(docs.limit(0)).count() == 0


def page(k, host="a.example"):
    return (k, f"http://{host}/p{k}", f"<html><head><title>t{k}</title><script>var a='</p>';</script></head><body><header><a href=/>Site</a></header><nav><ul><li>n{k}</li></ul></nav><div class=layout><div class='sidebar'>s{k}</div><div id=main-text><h2>Title {k}</h2><p>Hello &amp; <b>bold</b> {k}<br>more<p>Share this page</p><div class='ad'>buy</div><p>End&nbsp;{k} &lt;x&gt;</p></div><ol class=comments><li>nice {k}</li></ol></div><footer>f{k}</footer></body></html>")


def test_wrappers(spark):
    odd = [(100, None, None), (101, "nonsense", ""), (102, "http://b.example/", "<p>only</p> one"), (None, "http://a.example/x", page(50)[2]), page(3), (103, "http://c.example/", "<" * 50 + "x" + "<div>" * 3000 + "deep")]
    df = spark.createDataFrame([page(k) for k in range(9)] + odd, "page_id long, url string, html string")
    rows = wrappers.extract(df).collect()
    got = {r.page_id: r.text for r in rows}
    assert len(rows) == 15 and got[4] == "Title 4\nHello & bold 4 more\nEnd 4 <x>"
    assert got[None] == "Title 50\nHello & bold 50 more\nEnd 50 <x>" and got[100] == "" and got[101] == "" and got[102] == "only\none"
    assert all(r.n_chars == len(r.text) for r in rows) and wrappers.extract(df.limit(0)).count() == 0
    salted = wrappers.extract(df, wrappers.Settings(broadcast_bytes=0, broadcast_refs=0))
    assert sorted((r.page_id or -1, r.text) for r in salted.collect()) == sorted((r.page_id or -1, r.text) for r in rows)


def two_layouts(k, host):
    """Pages of two layouts by turns, each with a fixed line of its own that no name gives away."""
    kind = "ab"[k % 2]
    return (k, f"http://{host}/p{k}", f"<html><body><div class={kind}><div class=text><p>Story {k} of {host}</p><p>Fixed line {kind}</p><p>Body {k}</p></div></div></body></html>")


def test_wrappers_learn_every_layout_and_small_hosts(spark):
    small = [(100 + k, f"http://small.example/{k}", f"<body><div><p>Fixed line</p><p>Story {k}</p></div></body>") for k in range(2)]
    copies = [(200 + k, f"http://copies.example/{k}", f"<body><div><p>One</p><p>Two</p><p>Three</p><p>Edit {k}</p></div></body>") for k in range(2)]
    df = spark.createDataFrame([two_layouts(k, "two.example") for k in range(30)] + small + copies, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in wrappers.extract(df).collect()}
    assert got == {k: f"Story {k} of two.example\nBody {k}" for k in range(30)} | {100 + k: f"Story {k}" for k in range(2)} | {200 + k: f"One\nTwo\nThree\nEdit {k}" for k in range(2)}


@pytest.mark.parametrize(
    "html, text",
    [
        ("<body class='has-sidebar'><p>One</p></body>", "One"),
        ("<body class='no-sidebar home'><div class='content with-sidebar'><p>One</p></div><div class=sidebar>x</div></body>", "One"),
        ("<body><form id=aspnetForm><div class=search><input>find</div><div><p>One two three</p></div></form></body>", "One two three"),
        ("<body><article><h1 class='post-header'>Head</h1><p class='legal'>Law</p><p class='related-work'>Work</p><p>One</p></article></body>", "Head\nLaw\nWork\nOne"),
        ("<body><div class='site-footer'>f</div><div class='cookie-banner'>c</div><div class='mainNav'>n</div><p>One</p></body>", "One"),
        ("<body><div class='notice'><article><p>One</p></article></div><p>Other</p></body>", "One"),
        ("<body><div class='comments'>Only this</div><p hidden>never</p></body>", ""),
        ("<body><nav>Menu one</nav><footer>Foot</footer></body>", ""),
        ("<body><div class='cookie-notice'>We use cookies</div></body>", ""),
        ("<body><form><p>Your name</p><input><button>Send</button></form></body>", ""),
    ],
)
def test_names_drop_no_content(html, text):
    assert wrappers.read(dom.parse(html)) == text


@pytest.mark.parametrize("name", ["legal", "social-policy", "share-price", "search-results-article", "rail-transport", "header-story", "post comment-of-the-week", "article-form"])
def test_no_name_empties_an_article(name):
    assert wrappers.read(dom.parse(f"<body><nav>menu</nav><article class='{name}'><p>One</p><div class='legal'>Law</div><div class='ad'>buy</div></article></body>")) == "One\nLaw"


BESIDE = {
    "comments in the article": "<article><h1>Head {k}</h1><p>Body {k} of the story</p><section id='comments'><article class='comment'><p>Nice {k} says {j}</p></article></section></article>",
    "comments beside the article": "<article><h1>Head {k}</h1><p>Body {k} of the story</p></article><section class='comments'><article class='comment'><p>Nice {k} says {j}</p></article><article class='comment'><p>No {k} {j} and many more words than the story has</p></article></section>",
    "related posts": "<article><h1>Head {k}</h1><p>Body {k} of the story</p></article><div class='related-posts'><article><p>Other {j} {k}</p></article></div>",
    "related posts in the article": "<article><h1>Head {k}</h1><p>Body {k} of the story</p><div class='related-posts'><article><p>Other {j} {k}</p></article></div></article>",
    "advert in a paragraph": "<article><h1>Head {k}</h1><p class='ad'>BUY {j} {k}</p><p>Body {k} of the story</p></article>",
    "article in a form": "<form><div class='search'><input>find</div><article><h1>Head {k}</h1><p>Body {k} of the story</p></article></form>",
}


def beside(kind, k):
    return f"<html><body><nav><a>Menu {k}</a></nav><main>{BESIDE[kind].format(k=k, j=k * 7 % 11)}</main><footer>Foot</footer></body></html>"


@pytest.mark.parametrize("kind", sorted(BESIDE))
def test_parts_beside_the_article_are_left_out_of_single_pages(kind):
    assert wrappers.read(dom.parse(beside(kind, 3))) == "Head 3\nBody 3 of the story"


def test_parts_beside_the_article_are_left_out_with_wrappers(spark):
    """Twelve pages for each kind of markup on a host of its own, and pages that have no content; extra columns of any name."""
    rows = [(100 * h + k, f"http://h{h}.example/{k}", beside(kind, k), 1, "x") for h, kind in enumerate(sorted(BESIDE)) for k in range(12)]
    empty = [(9000 + k, f"http://empty.example/{k}", f"<body><nav>Menu {k}</nav><form><p>Name {k}</p><input></form><footer>Foot {k}</footer></body>", 1, "x") for k in range(5)]
    df = spark.createDataFrame(rows + empty, "page_id long, url string, html string, layout int, w string")
    got = {r.page_id: r.text for r in wrappers.extract(df).collect()}
    assert got == {r[0]: f"Head {r[0] % 100}\nBody {r[0] % 100} of the story" for r in rows} | {r[0]: "" for r in empty}


def test_very_long_pages_are_read_whole(spark):
    lines = [f"Line {i} of many" for i in range(30_000)]
    long = "<body><nav>m</nav><article>" + "".join(f"<p>{x}</p>" for x in lines) + "</article></body>"
    other = [(k, f"http://long.example/{k}", f"<body><nav>m</nav><article><p>Short {k}</p></article></body>") for k in range(3)]
    df = spark.createDataFrame([(9, "http://long.example/9", long), *other], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in wrappers.extract(df).collect()}
    assert got[9] == "\n".join(lines) and got[1] == "Short 1"


def test_depth_leaks_nothing():
    deep = 5000
    assert wrappers.read(dom.parse("<body>" + "<div>" * deep + "<nav>MENU</nav><p>One</p>" + "</div>" * deep + "<p>Two</p></body>")) == "One\nTwo"
    assert wrappers.read(dom.parse("<article>" + "<div>" * deep + "<p>One</p><div class=ad>buy</div>")) == "One"


def brute_matching(a, b, i, j):
    """Nodes of the best order-preserving matching of two subtrees, by trying all."""
    if a.page.key[i] != b.page.key[j]:
        return 0

    def of(xs, ys):
        if not xs or not ys:
            return 0
        return max(of(xs[1:], ys), of(xs, ys[1:]), brute_matching(a, b, xs[0], ys[0]) + of(xs[1:], ys[1:]) if brute_matching(a, b, xs[0], ys[0]) else 0)

    return 1 + of(a.children[i], b.children[j])


TREES = st.recursive(st.sampled_from(["<p>x</p>", "<h2>y</h2>", "<ul></ul>"]), lambda inner: st.tuples(st.sampled_from(["div", "section", "ul"]), st.lists(inner, max_size=4)).map(lambda t: f"<{t[0]}>{''.join(t[1])}</{t[0]}>"), max_leaves=7)


@settings(max_examples=150, deadline=None)
@given(TREES, TREES)
def test_tree_matching_against_brute_force(left, right):
    a, b = (wrappers.Shape(dom.parse(f"<body>{t}</body>")) for t in (left, right))
    assert wrappers.Matching(a, b).weight(0, 0) == brute_matching(a, b, 0, 0)


def stripped(html):
    """The page without what tells a reader its parts: article, nav, lists and names become plain containers."""
    html = re.sub(r"<(/?)(article|nav|footer|ul|li)\b[^>]*>", r"<\1div>", html)
    return re.sub(r"<div class=\"ad\">", "<div>", html)


def test_alignment_finds_articles_without_tags_and_names(spark):
    """Pages of the test data with article, nav, footer and names taken away: the text must come from the alignment."""
    pages = spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/pages.parquet")
    host = F.element_at(F.split("url", "/"), 3)
    rows = pages.join(pages.groupBy(host.alias("h")).count().filter("count >= 8"), host == F.col("h")).select("page_id", F.concat(F.lit("http://"), "h", F.lit("/"), F.col("page_id").cast("string")).alias("url"), "html")
    want = {r.page_id: r.text for r in wrappers.extract(rows).collect()}
    bare = spark.createDataFrame([(r.page_id, r.url, stripped(r.html)) for r in rows.collect()], rows.schema).repartition(4)
    got = {r.page_id: r.text for r in wrappers.extract(bare).collect()}
    alone = {r.page_id: wrappers.read(dom.parse(r.html)) for r in bare.collect()}
    assert len(want) >= 30 and sum(got[k] == want[k] for k in want) >= 0.95 * len(want) and not any(alone[k] == want[k] for k in want)
    assert {r.page_id: r.text for r in wrappers.extract(rows, by_name=False).collect()} == got
