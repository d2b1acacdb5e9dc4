"""A page as its elements in document order, and the events of reading it: opened and closed elements and text.

Nothing here recurses, so elements may be nested at any depth.
"""

from __future__ import annotations

import html
import re

#: Fixed values of HTML: elements without content, with raw content, and those that make blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
#: An opening tag closes these open ones, if nothing of the second set stands between.
CLOSES = {
    **{t: ({"p"}, {"button", "table", "td"}) for t in BLOCK - {"body", "html", "head", "option", "td", "th", "tr", "tbody", "thead", "tfoot"}},
    "li": ({"li", "p"}, {"ul", "ol"}),
    "dd": ({"dd", "dt", "p"}, {"dl"}),
    "dt": ({"dd", "dt", "p"}, {"dl"}),
    "tr": ({"tr", "td", "th", "p"}, {"table"}),
    "td": ({"td", "th", "p"}, {"table", "tr"}),
    "th": ({"td", "th", "p"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}
#: Names of what is no part of an article.
ASIDE_TAGS = frozenset("script style noscript template nav footer aside form iframe svg button select textarea input head object canvas dialog menu option".split())
UNREAD = frozenset("script style noscript template iframe svg head object canvas".split())  # no reader sees these
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
ASIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer bottombar sidebar aside rail cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login comment comments commentlist reply replies respond discussion disqus social share sharing related recommended recommendations widget toolbar pagination pager search copyright legal disclaimer form".split()
)

#: Of these names, those that name no part of an article even inside one.
ASIDE_WITHIN = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo nav navbar navigation menu menubar breadcrumb breadcrumbs footer sidebar cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe signup login comment comments commentlist disqus share sharing widget toolbar pagination pager".split()
)

#: Tags and names of parts that hold no article of the page, even if they hold article elements.
NEVER_TAGS = frozenset("aside nav footer menu".split())
NEVER_NAMES = frozenset("comment comments commentlist reply replies respond discussion disqus related recommended recommendations nav navbar navigation menu menubar breadcrumb breadcrumbs footer ad ads advert adverts advertisement sponsored promo".split())
#: What a reader fills in.
CONTROLS = frozenset("input textarea select button".split())

#: Elements that hold a page or its article, so that no name makes them an aside.
HOLDERS = frozenset("# html body main article".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*+)>", re.S
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: What a name may have before or after a listed word and still be that part, not something that merely has or follows it.
PARTS = frozenset("site page main top bottom left right global primary secondary sub mobile desktop wrapper wrap container box block area section inner outer bar list item items link links button buttons content header footer icon icons text form title widget unit slot group col column row panel posts articles stories entries".split())
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
DIGITS = re.compile(r"\d+")


def names_aside(name: str, listed: frozenset[str]) -> bool:
    """Whether a class or id, as a whole, names a part that is no article: ``ad``, ``site-footer``, not ``has-sidebar`` or ``related-work``."""
    words = [w.lower() for w in NAME.findall(name)]
    return any(w in listed for w in words) and all(w in ASIDE_NAMES or w in PARTS for w in words)


class Page:
    """Elements by number, in document order; 0 is the page itself. ``end`` is the number after an element's last inner one.

    ``events`` holds texts, ``i`` where element i opens and ``~i`` where it closes; ``closed`` is the place of the latter.
    """

    def __init__(self) -> None:
        self.tag, self.key, self.parent, self.end, self.closed = ["#"], ["#"], [-1], [0], [0]
        self.aside, self.within, self.hidden, self.never = [False], [False], [False], [False]
        self.named: dict[int, bool] = {}  # articles with the name of a part, and whether it counts anywhere
        self.events: list[str | int] = [0]

    def open(self, tag: str, attrs: str, parent: int) -> int:
        i = len(self.tag)
        key, aside, hidden = tag, tag in ASIDE_TAGS, tag in UNREAD
        within, never = aside, tag in NEVER_TAGS
        if attrs and not attrs.isspace():
            found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attrs)}
            if "class" in found or "id" in found:
                key = DIGITS.sub("0", f"{tag}.{found.get('class', '')}")
            if tag not in HOLDERS:
                names = () if tag in HEADINGS else (*found.get("id", "").split(), *found.get("class", "").split())
                hidden |= "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
                role = found.get("role", "").lower() in ASIDE_ROLES
                within |= hidden or role or any(names_aside(n, ASIDE_WITHIN) for n in names)
                aside |= within or any(names_aside(n, ASIDE_NAMES) for n in names)
                never |= any(names_aside(n, NEVER_NAMES) for n in names)
            elif tag == "article":
                names = (*found.get("id", "").split(), *found.get("class", "").split())
                if any(names_aside(n, ASIDE_NAMES) for n in names):
                    self.named[i] = any(names_aside(n, ASIDE_WITHIN) for n in names)
        self.tag.append(tag)
        self.key.append(key)
        self.parent.append(parent)
        self.end.append(i + 1)
        self.closed.append(0)
        self.aside.append(aside)
        self.within.append(within)
        self.hidden.append(hidden)
        self.never.append(never)
        self.events.append(i)
        return i

    def close(self, i: int) -> None:
        self.end[i], self.closed[i] = len(self.tag), len(self.events)
        self.events.append(~i)

    def inside(self, i: int, outer: int) -> bool:
        return outer <= i < self.end[outer]


def parse(text: str) -> Page:
    page = Page()
    stack, opened, at, size = [0], {}, 0, len(text)

    def drop_from(k: int) -> None:
        for i in reversed(stack[k:]):
            page.close(i)
            opened[page.tag[i]] -= 1
        del stack[k:]

    while at < size:
        begin = text.find("<", at)
        m = None
        while begin >= 0 and not (m := TOKEN.match(text, begin)):
            begin = text.find("<", begin + 1)
        if not m:
            page.events.append(text[at:])
            break
        if begin > at:
            page.events.append(text[at:begin])
        at = m.end()
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        if m["end"]:
            if opened.get(tag):
                k = len(stack) - 1
                while page.tag[stack[k]] != tag:
                    k -= 1
                drop_from(k)
            continue
        if (rule := CLOSES.get(tag)) and any(opened.get(t) for t in rule[0]):
            lowest = len(stack)
            for k in range(len(stack) - 1, 0, -1):
                if page.tag[stack[k]] in rule[1]:
                    break
                if page.tag[stack[k]] in rule[0]:
                    lowest = k
            drop_from(lowest)
        i = page.open(tag, m["attrs"], stack[-1])
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(text, at)
            page.events.append(text[at : end.start() if end else size])
            at = end.end() if end else size
            page.close(i)
        elif tag in VOID or m["attrs"].endswith("/"):
            page.close(i)
        else:
            stack.append(i)
            opened[tag] = opened.get(tag, 0) + 1
    drop_from(1)
    page.close(0)
    settle(page)
    return page


def settle(page: Page) -> None:
    """Which marks hold, once the whole page is known.

    What holds the page's article is no aside, unless it is a part like comments or related posts, or
    another article stands outside of all marked parts; so is a form around paragraphs that has few
    fields. Of articles in an article those with a part's name are asides. In an article fewer names
    count, but what holds more articles keeps its mark. Hidden parts stay so.
    """
    n, parent, tag = len(page.tag), page.parent, page.tag
    in_article, in_main, unseen = [False] * n, [False] * n, list(page.hidden)
    for i in range(1, n):
        up = parent[i]
        in_article[i] = in_article[up] or tag[up] == "article"
        in_main[i] = in_main[up] or tag[up] == "main"
        unseen[i] = unseen[i] or unseen[up]
    outer = [i for i in range(1, n) if tag[i] == "article" and not in_article[i] and not unseen[i]]
    plain = [i for i in outer if not page.named.get(i)] or outer
    for i in range(1, n):
        if i in page.named and (in_article[i] or i not in plain):
            page.aside[i] = page.within[i] = True
    free_forms(page)
    held = plain or [i for i in range(1, n) if tag[i] == "main" and not unseen[i]]
    above = {i: marked_above(page, i) for i in held}
    if all(above.values()):
        for marks in above.values():
            if not any(page.never[k] for k in marks):
                for k in marks:
                    page.aside[k] = page.within[k] = False
    holds = [False] * n
    for i in range(n - 1, 0, -1):
        holds[parent[i]] = holds[parent[i]] or holds[i] or tag[i] == "article"
    for i in range(1, n):
        if (in_article[i] or in_main[i] and not plain) and page.aside[i] and not page.within[i] and not page.hidden[i] and not holds[i]:
            page.aside[i] = False


def marked_above(page: Page, i: int) -> list[int]:
    found = []
    while (i := page.parent[i]) > 0:
        if page.aside[i]:
            found.append(i)
    return found


def free_forms(page: Page) -> None:
    """Forms with at least half of the page's words in their paragraphs, headings and items, and at most a field for 20 of these, parts marked within not counted."""
    n = len(page.tag)
    if not any(page.tag[i] == "form" and page.aside[i] and not page.hidden[i] for i in range(1, n)):
        return
    prose, fields, words, total = [0] * n, [0] * n, [0] * n, 0
    for i in range(1, n):
        fields[i] = int(page.tag[i] in CONTROLS)
    off, stack = [page.hidden[0]], [0]
    for e in page.events[1:-1]:
        if isinstance(e, str):
            if not off[-1]:
                words[stack[-1]] += len(e.split())
        elif e >= 0:
            stack.append(e)
            off.append(off[-1] or page.hidden[e])
        else:
            stack.pop()
            off.pop()
    total = sum(words)
    in_prose = [False] * n
    for i in range(1, n):
        in_prose[i] = in_prose[page.parent[i]] or page.tag[i] == "p" or page.tag[i] == "li" or page.tag[i] in HEADINGS
        prose[i] = words[i] if in_prose[i] else 0
    for i in range(n - 1, 0, -1):
        if not (page.aside[i] and page.tag[i] not in CONTROLS):
            prose[page.parent[i]] += prose[i]
            fields[page.parent[i]] += fields[i]
        if page.tag[i] == "form" and page.aside[i] and not page.hidden[i] and total and 2 * prose[i] >= total and 20 * fields[i] <= prose[i]:
            page.aside[i] = page.within[i] = False


def clean(text: str) -> str:
    return " ".join(html.unescape(text).split())
