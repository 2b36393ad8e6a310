"""Main text of web pages through wrappers: union-free regular expressions inferred from the pages of one host.

A page becomes the stream of its block elements and text slots, as a tree. A host's pages are aligned one after another into
one wrapper, level by level: siblings of one label pair by their ordinal while every page has the same number of them; where
the numbers differ they become one repeated element; what some pages lack becomes optional; siblings that come in both orders
become a repeated group; and a slot whose texts differ becomes a variable one. `expression` writes the result as a regular
expression. Alignment only ever takes unions, minima, maxima and sums, so the wrapper is the same in whatever order, and over
whatever partitions, the pages come.

The wrapper then decides what a page's text is. Slots that hold the same text on TEMPLATE_PAGES differing pages or more, and
nothing else on any, are template. Of the rest, the element that holds most of the variable text not in links is followed
down from the root while it holds DOMINANT of its parent's; the elements beside it go if they hold less than BESIDE of it, on
pages that have it.
Names only settle what alignment leaves open: an article (else main) element with text is the place to look in; navigation, headers,
footers, sidebars, forms, hidden parts, and classes that name notices, adverts or comments go, though their texts vary.

Tasks align their pages as they read; partial wrappers of a host merge in two steps (host and salt, then host), so a host with
a third of all pages never meets in one task page by page. Wrappers are joined by a broadcast only while their measured size
stays under BROADCAST_BYTES, else by a shuffle of the pages. A wrapper grows with the variety of its host's pages, not with
their number. Reading and matching are linear in a page's length, whatever its markup, and no walk recurses.

Defined results: null or empty html, or html without text, gives an empty text; pages without a host, or on a host of
fewer than TEMPLATE_PAGES differing pages, stand alone: only names decide. Inside an article or main element template goes
only up to TEMPLATE_WORDS words and outside headings. <br> and table cells part words but not blocks. Malformed markup is read
as it comes: unclosed elements end with their parents, stray end tags part blocks but close nothing, a tag whose quotes never close ends at its
first '>'. Equal pages count as one where template is told. Extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import common as c
from quire.llm.urlfilter import host_path

TEMPLATE_PAGES, TEMPLATE_WORDS = 3, 8
#: Share of the variable text that makes an element the one to follow, and the share of that one below which its neighbours go.
DOMINANT, BESIDE = 2 / 3, 1 / 10
#: Elements read by a task before it hands on the wrappers it holds.
HELD_NODES = 500_000
BROADCAST_BYTES = 8 << 20
SALTS = 64

#: HTML elements by their part in a page.
RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "html", "hr", "legend", "li", "main", "menu", "nav", "ol", "p", "pre",
    "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul", "caption",
    "button", "select", "option", "iframe", "object", "svg", "math", "canvas", "noscript", "template", "audio", "video", "label",
}
APART = {"br", "td", "th", "img", "wbr"}
DROPPED = {"nav", "footer", "aside", "form", "head", "button", "select", "iframe", "object", "svg", "math", "canvas", "noscript", "template", "dialog", "menu", "audio", "video", "fieldset", "label"}
DROPPED_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "sponsor", "sponsored", "promo", "promotion", "nav", "navbar", "navigation", "menu",
    "breadcrumb", "breadcrumbs", "sidebar", "footer", "masthead", "cookie", "cookies", "consent", "gdpr", "notice", "notification", "popup", "modal", "overlay", "newsletter",
    "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "related", "recommended", "recommendations", "comment", "comments", "disqus", "respond",
    "replies", "reply", "discussion", "commentlist", "adbox", "adslot", "adunit", "adsbygoogle", "leaderboard", "cookiebar", "topnav", "sitenav", "subnav", "mainnav", "widget", "toolbar", "pagination", "pager", "copyright", "legal", "disclaimer", "alert", "skip",
}
HEADER_WORDS = {"header", "topbar"}
DROPPED_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
#: Elements of running text.
RUNNING = {"p", "pre", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "dt", "dd", "li", "figcaption", "caption", "summary"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "option": {"option"}, "tbody": {"tbody", "thead"}, "tfoot": {"tbody", "thead"}}

_TAG = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_EDGE = re.compile("[\"'>]")
_ATTR = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_WORD = re.compile(r"[a-z]+|[0-9]+")
_RAW_END = {name: re.compile(rf"</{name}\b", re.I) for name in RAW}


def _words(value: str) -> list[str]:
    return _WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())


class Node:
    """A block element of a page: its items are Nodes and (text, hash, characters in links) slots in page order."""

    __slots__ = ("name", "label", "dropped", "soft", "header", "items", "chars", "holds", "text", "inner")

    def __init__(self, name: str, label: str, dropped: bool):
        self.name, self.label, self.dropped, self.items = name, label, dropped, []
        self.soft, self.header = False, name == "header"


def _open(name: str, attrs: str) -> Node:
    dropped, label, soft, header = name in DROPPED, name, False, name == "header"
    if attrs:
        for key, value in _ATTR.findall(attrs):
            key, value = key.lower(), value.strip("\"'")
            if key in ("class", "id"):
                words = _words(value)
                if name not in ("body", "html", "article", "main") or "comment" in words:
                    soft |= not DROPPED_WORDS.isdisjoint(words)
                    header |= not HEADER_WORDS.isdisjoint(words)
                if key == "class":
                    label += "." + ".".join(w for w in words if w.isalpha())
            elif key == "role":
                dropped |= value.lower() in DROPPED_ROLES
            elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
                dropped = True
    node = Node(name, label, dropped)
    node.soft, node.header = soft, header
    return node


def _settle(node: Node) -> None:
    """Drop the children whose class or id says so, unless they hold an article, or a main heading and most of the page.

    Called from the leaves up. Also notes what text and which article or main elements are left below.
    """
    chars, holds, soft = 0, node.name in ("article", "main", "h1") and not node.soft, []
    for x in node.items:
        if not isinstance(x, Node):
            chars += len(x[0])
            continue
        chars += x.chars
        holds |= x.holds and not x.dropped
        if x.soft and not x.holds:
            x.dropped = True
        elif x.soft or x.header:
            soft.append(x)
    for x in soft:
        if 2 * x.chars > chars:
            x.header = False
        elif x.soft:
            x.dropped = True
    node.chars, node.holds = chars, holds
    left = [x for x in node.items if not isinstance(x, Node) or not x.dropped]
    node.text = any(not isinstance(x, Node) or x.text for x in left)
    node.inner = {n for n in ("article", "main") if any(isinstance(x, Node) and ((x.name == n and x.text) or n in x.inner) for x in left)}


class _Ends:
    """Where tags end: at the first '>' outside quotes. What a failed scan passed is not scanned again."""

    def __init__(self, html: str):
        self.html, self.failed, self.last = html, set(), html.rfind(">")

    def of(self, at: int) -> int:
        """The index of the closing '>' of the tag whose name ends at `at`, -1 without any."""
        if at > self.last:
            return -1
        html, passed, x = self.html, [], at
        while True:
            m = _EDGE.search(html, x)
            if m is None or m.start() in self.failed:
                break
            if m.group() == ">":
                return m.start()
            passed.append(m.start())
            x = html.find(m.group(), m.end()) + 1
            if not x:
                break
        self.failed.update(passed)
        return html.find(">", at)


def parse(html: str) -> list[Node]:
    """A page's block elements in page order, the root first; white space and character references are resolved."""
    root = Node("", "", False)
    order, stack, open_, text, at, n, ends = [root], [root], {}, [], 0, len(html), _Ends(html)
    link, linked = False, 0

    def flush():
        nonlocal linked
        if text:
            joined = "".join(text)
            text.clear()
            t = " ".join((entities.unescape(joined) if "&" in joined else joined).split())
            if t:
                stack[-1].items.append((t, zlib.crc32(t.encode("utf-8", "surrogatepass")), min(linked, len(t))))
        linked = 0

    def leave(k: int):
        for x in stack[k:]:
            open_[x.name] -= 1
        del stack[k:]

    while at < n:
        m = _TAG.search(html, at)
        start = m.start() if m else n
        if start > at:
            text.append(html[at:start])
            linked += link * (start - at)
        if m is None:
            break
        if m[1]:
            end = html.find("-->", m.end())
            at = end + 3 if end >= 0 else n
            continue
        end = html.find(">", m.end()) if m[2] and m.end() <= ends.last else -1 if m[2] else ends.of(m.end())
        if end < 0:
            text.append(html[start : m.end()])
            at = m.end()
            continue
        at = end + 1
        if m[2]:
            continue
        closing, name = m[3], m[4].lower()
        if name == "a":
            link = not closing
        if name in APART:
            text.append(" ")
            continue
        if name in RAW and not closing:
            stop = _RAW_END[name].search(html, at)
            end = html.find(">", stop.end()) if stop else -1
            at = end + 1 if end >= 0 else n
            continue
        if name not in BLOCK:
            continue
        flush()
        if closing:
            link = False
            if open_.get(name):
                k = len(stack) - 1
                while stack[k].name != name:
                    k -= 1
                leave(k)
            continue
        if stack[-1].name == "p" or stack[-1].name in CLOSES.get(name, ()):
            leave(len(stack) - 1)
            link = False
        if name in VOID:
            continue
        attrs = html[m.end() : end]
        node = _open(name, attrs)
        stack[-1].items.append(node)
        order.append(node)
        if not attrs.endswith("/") or name not in ("svg", "math", "iframe", "object"):
            stack.append(node)
            open_[name] = open_.get(name, 0) + 1
    flush()
    for node in reversed(order):
        _settle(node)
    return order


class Slot:
    """A text slot: the least and greatest hash of its texts, the pages that hold it (the smallest, TEMPLATE_PAGES at most), and its characters."""

    __slots__ = ("low", "high", "pages", "chars", "linked")

    def __init__(self, low: int, high: int, pages: list[int], chars: int, linked: int):
        self.low, self.high, self.pages, self.chars, self.linked = low, high, pages, chars, linked

    @property
    def template(self) -> bool:
        return self.low == self.high and len(self.pages) >= TEMPLATE_PAGES

    def take(self, other: Slot) -> None:
        self.low, self.high = min(self.low, other.low), max(self.high, other.high)
        if self.pages != other.pages:
            self.pages = sorted({*self.pages, *other.pages})[:TEMPLATE_PAGES]
        self.chars += other.chars
        self.linked += other.linked


class Element:
    """An element of a wrapper. columns: label -> [how many instances have it, whether it repeats, its Elements or Slots by
    ordinal]; pairs: (label, ordinal) of neighbours, ordinal 0 of what repeats. Set by decide(): `lead`, the child that holds
    the text, and `aside`, whether it stands beside its parent's lead."""

    __slots__ = ("n", "columns", "pairs", "lead", "aside")

    def __init__(self):
        self.n, self.columns, self.pairs, self.lead, self.aside = 1, {}, set(), None, False


TEXT = "#"


def _label(node: Node) -> str:
    """Name and classes; '~' marks elements without block elements inside, '!' those that names drop."""
    return node.label + "~" * (not any(isinstance(x, Node) for x in node.items)) + "!" * node.dropped


def page_wrapper(order: list[Node]) -> Element:
    """The wrapper of one page: its own tree."""
    page = 0
    for node in order:
        for x in node.items:
            page = zlib.crc32(b"%d" % x[1] if not isinstance(x, Node) else x.label.encode(), page)
        page = zlib.crc32(b"/", page)
    made = {}
    for node in reversed(order):
        e = Element()
        before = None
        for x in node.items:
            label = _label(x) if isinstance(x, Node) else TEXT
            part = made.pop(id(x)) if isinstance(x, Node) else Slot(x[1], x[1], [page], len(x[0]), x[2])
            column = e.columns.setdefault(label, [1, False, []])
            sign = (label, len(column[2]))
            column[2].append(part)
            if before:
                e.pairs.add((before, sign))
            before = sign
        made[id(node)] = e
    return made[id(order[0])]


def _repeat(e: Element, label: str) -> None:
    """The pairs of an element whose children of this label now repeat: their ordinals no longer count."""
    one = lambda s: (label, 0) if s[0] == label else s
    e.pairs = {(one(a), one(b)) for a, b in e.pairs}


def align(a: Element, b: Element) -> Element:
    """Align b into a, which becomes the wrapper of both; b is used up."""
    work = [(a, b)]
    while work:
        x, y = work.pop()
        if isinstance(x, Slot):
            x.take(y)
            continue
        x.n += y.n
        for label, (k, repeats, parts) in y.columns.items():
            column = x.columns.get(label)
            if column is None:
                x.columns[label] = [k, repeats, parts]
                continue
            column[0] += k
            mine = column[2]
            if column[1] or repeats or len(mine) != len(parts):
                if not column[1]:
                    _repeat(x, label)
                if not repeats:
                    _repeat(y, label)
                work += [(mine[0], p) for p in (*mine[1:], *parts)]
                column[1], column[2] = True, mine[:1]
            else:
                work += zip(mine, parts)
        x.pairs |= y.pairs
    return a


def dump(root: Element) -> str:
    """A wrapper as flat JSON rows, children before parents."""
    order, todo = [], [root]
    while todo:
        x = todo.pop()
        order.append(x)
        if isinstance(x, Element):
            todo += [p for label in sorted(x.columns) for p in x.columns[label][2]]
    rows, place = [], {}
    for x in reversed(order):
        if isinstance(x, Slot):
            rows.append([x.low, x.high, x.pages, x.chars, x.linked])
        else:
            rows.append([x.n, [[label, k, repeats, [place[id(p)] for p in parts]] for label, (k, repeats, parts) in sorted(x.columns.items())], sorted(x.pairs)])
        place[id(x)] = len(rows) - 1
    return json.dumps(rows, separators=(",", ":"))


def load(text: str) -> Element:
    made: list = []
    for row in json.loads(text):
        if len(row) == 5:
            made.append(Slot(*row))
            continue
        e = Element()
        e.n, e.pairs = row[0], {(tuple(a), tuple(b)) for a, b in row[2]}
        e.columns = {label: [k, repeats, [made[p] for p in parts]] for label, k, repeats, parts in row[1]}
        made.append(e)
    return made[-1]


def _elements(root: Element) -> list[Element]:
    order, todo = [], [root]
    while todo:
        x = todo.pop()
        order.append(x)
        todo += [p for _, _, parts in x.columns.values() for p in parts if isinstance(p, Element)]
    return order


def pages_of(root: Element) -> int:
    """How many differing pages a wrapper is known to have, counted up to TEMPLATE_PAGES."""
    return len({p for e in _elements(root) for s in (e.columns[TEXT][2] if TEXT in e.columns else ()) for p in s.pages})


def decide(root: Element) -> Element:
    """Follow the variable text down from the root and mark the elements beside it."""
    mass: dict[int, int] = {}
    for e in reversed(_elements(root)):
        own = sum(max(0, s.chars - s.linked) for s in (e.columns[TEXT][2] if TEXT in e.columns else ()) if not s.template)
        mass[id(e)] = own + sum(mass[id(p)] for label, c in e.columns.items() if label != TEXT and label[-1] != "!" for p in c[2])
    at, name = root, ""
    while name not in ("article", "main"):
        inside = [(mass[id(p)], label, i, p) for label, c in at.columns.items() if label != TEXT and label[-1] != "!" and re.split(r"[.~]", label)[0] not in RUNNING for i, p in enumerate(c[2])]
        if not inside:
            break
        most, label, _, best = max(inside, key=lambda x: x[:3])
        if not most or most < DOMINANT * mass[id(at)]:
            break
        for m, _, _, p in inside:
            p.aside = m < BESIDE * most
        at.lead = best
        at, name = best, re.split(r"[.~]", label)[0]
    return root


def _ranks(e: Element) -> list[list[tuple]]:
    """An element's (label, ordinal) children in order; those that come in both orders share a rank."""
    signs = sorted((label, i) for label, c in e.columns.items() for i in range(len(c[2])))
    after = {s: {s} for s in signs}
    for a, b in e.pairs:
        after[a].add(b)
    for k in signs:  # transitive closure
        for s in signs:
            if k in after[s]:
                after[s] |= after[k]
    ranks: list[list[tuple]] = []
    first = {s: min(t for t in after[s] if s in after[t]) for s in signs}
    for s in sorted(signs, key=lambda s: (-len(after[s]), first[s], s)):
        if ranks and first[ranks[-1][0]] == first[s]:
            ranks[-1].append(s)
        else:
            ranks.append([s])
    return ranks


def expression(root: Element) -> str:
    """The wrapper as a union-free regular expression over the tokens of `tokens`."""
    made: dict[int, str] = {}
    for e in reversed(_elements(root)):
        out = []
        for rank in _ranks(e):
            group = []
            for label, i in rank:
                k, repeats, parts = e.columns[label]
                one = "#" if label == TEXT else re.escape(f"<{label}>") + made[id(parts[i])] + "</>"
                maybe = k < e.n or len(rank) > 1
                group.append(f"(?:{one})" + ("*" if repeats and maybe else "+" if repeats else "?" if maybe else ""))
            out.append(group[0] if len(group) == 1 else "(?:" + "".join(group) + ")+")
        made[id(e)] = "".join(out)
    return made[id(root)]


def tokens(order: list[Node]) -> str:
    """A page's stream as `expression` reads it: '#' a text, '<label>' and '</>' an element's ends."""
    made: dict[int, str] = {}
    for node in reversed(order):
        made[id(node)] = "".join(f"<{_label(x)}>{made.pop(id(x))}</>" if isinstance(x, Node) else "#" for x in node.items)
    return made[id(order[0])]


def main_text(html: str | None, wrapper: Element | None) -> str:
    """The text of a page, given its host's decided wrapper, or none."""
    if not html:
        return ""
    root = parse(html)[0]
    within = next((n for n in ("article", "main") if n in root.inner), None)
    out: list[str] = []
    todo: list[tuple] = [(root, wrapper, False, False, False, False)]
    while todo:
        x, w, aside, inside, header, heading = todo.pop()
        if not isinstance(x, Node):
            if within and not inside or header and not heading:
                continue
            if w is not None and w.template and w.low == x[1] and (not inside or not heading and len(x[0].split()) <= TEMPLATE_WORDS):
                continue
            out.append(x[0])
            continue
        if x.dropped or (not inside and (x.header or (aside and not within))):
            continue
        state = (inside or (x.name != "" and x.name == within), header or x.header, heading or x.name in HEADINGS)
        below, ordinal = [], {}
        for item in x.items:
            label = _label(item) if isinstance(item, Node) else TEXT
            i = ordinal[label] = ordinal.get(label, -1) + 1
            column = w.columns.get(label) if w is not None else None
            part = None if column is None else column[2][0] if column[1] else column[2][i] if i < len(column[2]) else None
            if isinstance(part, Slot) and column[1]:
                part = None  # a repeated slot holds many texts; none of them is template
            below.append((item, part))
        # what stands beside the text goes only where this page has that text
        led = w is not None and w.lead is not None and any(part is w.lead and not item.dropped and item.text for item, part in below)
        todo += [(item, part, led and isinstance(part, Element) and part.aside, *state) for item, part in reversed(below)]
    return "\n".join(out)


def _partial(it):
    salt = (TaskContext.get().partitionId() if TaskContext.get() else 0) % SALTS
    held: dict[str, Element] = {}
    nodes = 0

    def flush():
        rows = [(h, dump(w)) for h, w in held.items()]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([salt] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.string())], ["host", "salt", "wrapper"])

    for batch in it:
        for at, col in c.slices(batch.column(1)):
            for host, html in zip(batch.column(0).slice(at, len(col)).to_pylist(), col.to_pylist()):
                order = parse(html)
                one = page_wrapper(order)
                held[host] = align(held[host], one) if host in held else one
                nodes += len(order)
                if nodes > HELD_NODES:
                    yield flush()
                    nodes = 0
    if held:
        yield flush()


def _reduce(pdf):
    import pandas as pd

    got = None
    for w in pdf["wrapper"]:
        got = load(w) if got is None else align(got, load(w))
    return pd.DataFrame({"host": [pdf["host"].iloc[0]], "wrapper": [dump(got)]})


def _finish(pdf):
    done = _reduce(pdf)
    return done[[pages_of(load(w)) >= TEMPLATE_PAGES for w in done["wrapper"]]]


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper as JSON) for every host with TEMPLATE_PAGES differing pages or more of pages(host, html)."""
    rows = pages.where("host <> '' and html is not null and html <> ''").select("host", "html")
    part = rows.mapInArrow(_partial, "host string, salt int, wrapper string")
    part = part.groupBy("host", "salt").applyInPandas(_reduce, "host string, wrapper string")
    return part.groupBy("host").applyInPandas(_finish, "host string, wrapper string")


def _extract(it):
    known: dict[str, Element] = {}
    for batch in it:
        names = batch.schema.names
        for at, col in c.slices(batch.column(names.index("html"))):
            out = []
            for html, w in zip(col.to_pylist(), batch.column(names.index("wrapper")).slice(at, len(col)).to_pylist()):
                if w is not None and w not in known:
                    if len(known) > 500:
                        known.clear()
                    known[w] = decide(load(w))
                out.append(main_text(html, known[w] if w is not None else None))
            part = batch.slice(at, len(col))
            yield pa.RecordBatch.from_arrays([part.column(names.index("page_id")), part.column(names.index("url")), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages(page_id, url, html)."""
    host, _ = host_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))
    learned = c.stash(wrappers(rows))
    size = learned.agg(F.sum(F.length("wrapper") + F.length("host"))).first()[0] or 0
    small = learned.withColumnRenamed("host", "h")
    joined = rows.join(F.broadcast(small) if size <= BROADCAST_BYTES else small, F.col("host") == F.col("h"), "left")
    return joined.select("page_id", "url", "html", "wrapper").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    return extract(c.read(spark, sf_dir, "pages"))
