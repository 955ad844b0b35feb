"""Main text of web pages by wrapper induction.

1. Every page becomes a tree of its block elements in which siblings of one label (tag, class and role, and ids that name a part of a page) are one node. Blocks of
   text hang on nodes.
2. The most frequent tree of a host, of equals the largest, is its reference. Every other tree of the host is aligned with it by simple tree matching: children are
   matched in order so that the most nodes find a partner of equal label.
3. Over all pages of the host, a text that stands on one aligned node of most pages is template; what varies is a slot. Pages that agree in title
   and longest blocks count once, so copies of one article do not turn it into template.
4. Slots inside the host's main node are content. It is chosen by the text that varies over the host's pages, equal texts counted once:
   article and main elements if they hold at least half of it (only the one with most of their text, if there is one), else the deepest
   node that holds most of the text outside them. A page on which more text stands in nodes without a partner than in the main node gets
   the main node of these by the same rule as well. Elements that are no article text by tag, class, id or role (menus, headers, footers,
   sidebars, notices, adverts, forms, reader comments) are left out, and so are nodes whose text is nearly all links. Words in classes and ids are
   evidence only: a node that holds most of the text is kept whatever it is called, see :func:`left_out`.

Counting is by aggregates over (host, node, text hash), so a host with a third of all pages is no single group; only one row per host, its
reference with a verdict for each node, is joined to the pages.

Defined results: null, empty or markup-only html gives an empty text; pages of a host with fewer than three different pages have no
template; a null or unparsable url is a host of its own; repeated rows each get a result; html cut off anywhere is read as far
as it goes; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litprops.llm.store import Scratch
from litprops.llm.url_filter import url_parts
from litprops.llm.words import STEP, batches, word_hashes

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|</[^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
# Elements of HTML that make a block of their own.
BLOCKS = frozenset(
    "address article aside blockquote body button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html iframe legend li main menu nav noscript object ol optgroup option p pre section select summary svg table tbody td template textarea "
    "tfoot th thead title tr ul video".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements, class or id words, and roles that are no article text.
BOILER_TAGS = frozenset("head title nav footer aside form button select option optgroup textarea noscript template svg canvas iframe object video dialog menu fieldset legend".split())
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner nav navbar navigation menu sidebar side aside footer foot cookie cookies "
    "consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login register share sharing social follow comment comments commentlist "
    "reply replies respond discussion disqus related recommended recommendations breadcrumb breadcrumbs pagination pager paging widget toolbar skip copyright legal disclaimer search tags masthead topbar".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist reply replies respond discussion disqus".split())
HEADER_WORDS = frozenset(("header", "head", "top"))
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar note".split())
CLOSED_BY = {"li": ("li", ("ul", "ol", "menu", "dir")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "tr": ("tr td th", ("table", "tbody", "thead", "tfoot")), "option": ("option", ("select",))}
#: Different pages that a text must stand on, and the share of the host's pages, to be template.
LEAST, SHARE = 3, 0.6
LINKED = 0.9
#: Share of the text that a main node has at least.
MOST = 0.7
#: How many times the remaining text a node must hold for its names to be overruled without further evidence.
OVERRULE = 3
#: A page is known by its title and so many of its longest blocks; pages that agree in these count once.
KNOWN_BY = 3


class Page:
    """Merged tree of a page: ``parent`` and ``label`` of each node, and its blocks ``(node, text, linked characters)``."""

    def __init__(self, html: str | None):
        self.parent, self.label, self.kids, self.blocks = [-1], ["#"], [{}], []
        stack, buffer, linked, in_link, at = [("#", 0)], [], 0, False, 0
        html = html or ""

        def text(piece: str):
            nonlocal linked
            if piece:
                piece = unescape(piece) if "&" in piece else piece
                buffer.append(piece)
                if in_link:
                    linked += len(piece.strip())

        def flush():
            nonlocal linked, in_link
            if buffer:
                words = " ".join("".join(buffer).split())
                if words:
                    self.blocks.append((stack[-1][1], words, linked))
                buffer.clear()
            linked, in_link = 0, False

        for m in TOKEN.finditer(html):
            text(html[at : m.start()])
            at = m.end()
            name = m[3] or m[6]
            if name is None:
                continue
            name, closing, rest = name.lower(), m[2] or m[5], m[4] if m[3] else m[7]
            if name == "a":
                in_link = not closing
            elif name == "br":
                buffer.append(" ")
            elif name not in BLOCKS:
                continue
            elif closing:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        flush()
                        del stack[k:]
                        break
                else:
                    flush()
            else:
                flush()
                if stack[-1][0] == "p":
                    stack.pop()
                ends, inside = CLOSED_BY.get(name, ("", ()))
                if ends:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] in inside:
                            break
                        if stack[k][0] in ends.split():
                            del stack[k:]
                            break
                if name not in VOID:
                    stack.append((name, self._child(stack[-1][1], name + self._names(rest))))
        text(html[at:])
        flush()

    @staticmethod
    def _names(rest: str) -> str:
        """Class, id and role words and hidden state, in a fixed order, without digits."""
        if not rest or "=" not in rest and "hidden" not in rest.lower():
            return ""
        found = []
        for k, v in ATTRIBUTE.findall(rest):
            k, v = k.lower(), v.strip("\"'").lower()
            if k in ("class", "id", "role"):
                words = sorted({w for w in re.split(r"[^a-z]+", v) if w and (k != "id" or w in BOILER_WORDS or w in HEADER_WORDS)})  # other ids name the page
                found += [("@" if k == "role" else ".") + w for w in words]
            elif k == "hidden" or k == "style" and re.search(r"display\s*:\s*none", v):
                found.append("!hidden")
        return "".join(sorted(set(found)))

    def _child(self, parent: int, label: str) -> int:
        at = self.kids[parent].get(label)
        if at is None:
            at = self.kids[parent][label] = len(self.label)
            self.parent.append(parent)
            self.label.append(label)
            self.kids.append({})
        return at

    @property
    def skeleton(self) -> str:
        return "\n".join(f"{p} {x}" for p, x in zip(self.parent, self.label))


def _tree(skeleton: str) -> tuple[list[int], list[str], list[list[int]]]:
    parent, label = [], []
    for line in skeleton.split("\n"):
        p, _, x = line.partition(" ")
        parent.append(int(p))
        label.append(x)
    kids: list[list[int]] = [[] for _ in parent]
    for i, p in enumerate(parent):
        if p >= 0:
            kids[p].append(i)
    return parent, label, kids


def simple_tree_matching(a: str, b: str) -> list[int]:
    """For each node of skeleton ``a`` its partner in ``b``, or -1: the largest matching that keeps order and parents."""
    pa_, la, ka = _tree(a)
    _, lb, kb = _tree(b)
    size: dict[tuple[int, int], int] = {}

    def pairs(i, j):
        return [(x, y) for x in ka[i] for y in kb[j] if la[x] == lb[y]]

    todo, order = [(0, 0)], []
    while todo:  # pairs of nodes that can meet, parents first
        p = todo.pop()
        order.append(p)
        todo.extend(pairs(*p))

    def table(i, j):
        t = np.zeros((len(ka[i]) + 1, len(kb[j]) + 1), np.int64)
        for x, u in enumerate(ka[i], 1):
            for y, v in enumerate(kb[j], 1):
                t[x, y] = max(t[x - 1, y], t[x, y - 1], t[x - 1, y - 1] + size.get((u, v), 0))
        return t

    for i, j in reversed(order):
        size[i, j] = 1 + int(table(i, j)[-1, -1]) if ka[i] and kb[j] else 1
    out, todo = [-1] * len(pa_), [(0, 0)]
    while todo:
        i, j = todo.pop()
        out[i] = j
        t, x, y = table(i, j), len(ka[i]), len(kb[j])
        while x and y:
            if t[x, y] == t[x - 1, y]:
                x -= 1
            elif t[x, y] == t[x, y - 1]:
                y -= 1
            else:
                x, y = x - 1, y - 1
                todo.append((ka[i][x], kb[j][y]))
    return out


_matched = lru_cache(maxsize=4096)(simple_tree_matching)


def _describe(iterator):
    """One row per page: its tree, its title, and hash, length and linked length of each block."""
    for piece in batches(iterator, rows=300):
        host, skeleton, title, count, node, size, link, texts = [], [], [], [], [], [], [], []
        for h, html in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
            page = Page(html)
            named = [t for n, t, _ in page.blocks if page.label[n].startswith("title")]
            host.append(h)
            skeleton.append(page.skeleton)
            longest = sorted({t for _, t, _ in page.blocks}, key=lambda t: (-len(t), t))[:KNOWN_BY]
            title.append("\n".join([*named[:1], *longest]))
            count.append(len(page.blocks))
            for n, t, k in page.blocks:
                node.append(n)
                size.append(len(t))
                link.append(min(k, len(t)))
                texts.append(t)
        ends = np.concatenate(([0], np.cumsum(count))).astype(np.int32)
        blocks = pa.StructArray.from_arrays(
            [pa.array(node, pa.int32()), pa.array(_text_hashes(texts)), pa.array(size, pa.int64()), pa.array(link, pa.int64())], names=["node", "text", "size", "link"]
        )
        yield pa.RecordBatch.from_arrays(
            [pa.array(host, pa.string()), pa.array(skeleton, pa.string()), pa.array(_text_hashes(title)), pa.ListArray.from_arrays(pa.array(ends), blocks)],
            names=["host", "skeleton", "title", "blocks"],
        )


def _text_hashes(texts: list[str]) -> np.ndarray:
    first, words = word_hashes(pa.array(texts, pa.string()))
    out = np.array([int((words[a:b] * (STEP[60] + np.arange(b - a, dtype=np.uint64) * STEP[61])).sum(dtype=np.uint64)) for a, b in zip(first[:-1], first[1:])], np.uint64)
    return out.view(np.int64)


def _align(iterator):
    for batch in iterator:
        got = [simple_tree_matching(a, b) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.list_(pa.int32()))], names=["host", "tree", "partner"])


@lru_cache(maxsize=1 << 16)
def boiler(label: str, in_article: bool) -> int:
    """Whether an element is no article text by its own names: 2 by tag, role or hidden state, 1 by a class or id word or as a form, else 0."""
    tag, *names = re.split(r"(?=[.@!])", label)
    if tag in BOILER_TAGS and tag != "form" or "!hidden" in names or (tag == "header" and not in_article) or any(n[0] == "@" and n[1:] in BOILER_ROLES for n in names):
        return 2
    if tag in ("html", "body"):
        return 0
    words = {n[1:] for n in names if n[0] == "."}
    return int(tag == "form" or bool(words & BOILER_WORDS) or bool(words & HEADER_WORDS) and not in_article and tag not in ("article", "main"))


def sums_below(parent: list[int], own: np.ndarray) -> np.ndarray:
    below = own.astype(float)
    for i in range(len(parent) - 1, 0, -1):  # parents come before their children
        below[parent[i]] += below[i]
    return below


def left_out(parent: list[int], label: list[str], own: np.ndarray, lifted: list[bool] | None = None) -> tuple[list[bool], list[bool], list[bool]]:
    """Per node: whether it is no article text, whether it stands in an article or main element, and whether its names were overruled.

    Names are evidence, weighed against the text below a node (``own``: text on each node). From the top, a node that only its words (or being a
    form) speak against is taken in all the same if it holds more text than all that would stay without it and also the page's main heading, main
    element or largest article, or if it holds :data:`OVERRULE` times as much and is not named after reader comments. ``lifted`` nodes are taken in anyway.
    """
    n = len(parent)
    hard = [False] * n
    for i in range(1, n):
        hard[i] = hard[parent[i]] or boiler(label[i], True) == 2
    text = np.where(hard, 0.0, own)
    below = sums_below(parent, text)
    core = np.array([not h and (x.startswith("h1") or x.startswith("main") or "@main" in x) for h, x in zip(hard, label)], float)
    articles = [i for i in range(1, n) if not hard[i] and label[i].startswith("article")]
    largest = max(articles, key=lambda i: below[i], default=0)
    if largest and 2 * below[largest] >= sum(below[i] for i in articles):
        core[largest] = 1
    core = sums_below(parent, core)
    out, article, free = [False] * n, [False] * n, list(lifted or [False] * n)

    def walk():
        for i in range(1, n):
            p = parent[i]
            kind = boiler(label[i], article[p])
            out[i] = out[p] or kind == 2 or kind == 1 and not free[i]
            article[i] = article[p] or (_is_main(label[i]) and not out[i])

    walk()
    while True:
        stays = sum(t for t, o in zip(text, out) if not o)
        top = [i for i in range(1, n) if out[i] and not out[parent[i]] and not free[i] and not hard[i] and boiler(label[i], article[parent[i]]) == 1]
        best = max(top, key=lambda i: below[i], default=0)
        if not best or below[best] <= stays:
            return out, article, free
        commented = {w[1:] for w in re.split(r"(?=[.@!])", label[best])[1:]} & COMMENT_WORDS
        if not core[best] and (commented or below[best] < OVERRULE * stays):
            return out, article, free
        free[best] = True
        walk()


def _is_main(label: str) -> bool:
    return label.startswith(("article", "main")) or "@main" in label or "@article" in label


def main_nodes(parent: list[int], label: list[str], article: list[bool], text: np.ndarray) -> list[bool]:
    """Which nodes are or stand in the main node, by the text on each node; ``article``: nodes in article or main elements."""
    n = len(parent)

    below = sums_below(parent, text)
    roots = [i for i in range(1, n) if article[i] and not article[parent[i]]]
    held = sum(below[i] for i in roots)
    if roots and 2 * held >= below[0]:
        roots = [i for i in roots if held and below[i] >= MOST * held] or roots
    else:
        below, at = sums_below(parent, np.where(article, 0.0, text)), 0
        while below[0] > 0 and (big := [k for k in range(at + 1, n) if parent[k] == at and below[k] >= MOST * below[0] and not label[k].startswith(("p", "h1", "h2", "h3"))]):
            at = big[0]
        roots = [at]
    main = [i in roots for i in range(n)]
    for i in range(1, n):
        main[i] = main[i] or main[parent[i]]
    return main


class Wrapper:
    """What a host's reference says about its nodes."""

    def __init__(self, reference: str, sizes, template):
        self.reference = reference
        self.parent, self.label, _ = _tree(reference)
        n = len(self.label)
        self.template = {(t["node"], t["text"]) for t in template or ()}
        own, link, vary = np.zeros(n), np.zeros(n), np.zeros(n)
        for s in sizes or ():
            own[s["node"]], link[s["node"]], vary[s["node"]] = s["size"], s["link"], s["once"]
        for t in template or ():
            vary[t["node"]] -= t["once"]
        self.menu = (own > 0) & (link >= LINKED * own)
        self.boiler, self.article, self.lifted = left_out(self.parent, self.label, np.where(self.menu, 0.0, vary))
        self.main = main_nodes(self.parent, self.label, self.article, np.where(np.array(self.boiler) | self.menu, 0.0, vary))


#: Wrappers of the hosts that a worker has met lately.
_wrappers: dict[tuple, Wrapper] = {}


def extract(html: str | None, wrapper: Wrapper) -> str:
    page = Page(html)
    if not page.blocks:
        return ""
    partner = _matched(page.skeleton, wrapper.reference)
    n = len(page.label)
    own = np.zeros(n)
    for node, text, linked in page.blocks:
        own[node] += len(text) if linked < LINKED * len(text) else 0
    out_, article, _ = left_out(page.parent, page.label, own, [j >= 0 and wrapper.lifted[j] for j in partner])
    main = [False] * n
    for i, j in enumerate(partner):
        out_[i] = out_[i] or i > 0 and (out_[page.parent[i]] or (j >= 0 and bool(wrapper.menu[j])))
    for i, j in enumerate(partner):
        main[i] = wrapper.main[j] if j >= 0 else main[page.parent[i]]
    hashes = _text_hashes([t for _, t, _ in page.blocks]) if wrapper.template else None
    slots = [
        (node, text)
        for k, (node, text, _) in enumerate(page.blocks)
        if not out_[node] and not (wrapper.template and (partner[node], int(hashes[k])) in wrapper.template)
    ]
    strange = np.zeros(n)
    for node, text in slots:
        if partner[node] < 0 and not main[node]:
            strange[node] += len(text)
    if strange.sum() > (known := sum(len(text) for node, text in slots if main[node])):
        own = main_nodes(page.parent, page.label, article, strange)
        if strange[own].sum() > known:
            main = [m or (o and j < 0) for m, o, j in zip(main, own, partner)]
    kept = [text for node, text in slots if main[node]]
    return " ".join(kept)


def _extract(iterator):
    for piece in batches(iterator, rows=300):
        texts = []
        for host, html, reference, sizes, template in zip(*(piece.column(i).to_pylist() for i in (2, 3, 4, 5, 6))):
            key = (host, reference, len(sizes or ()), sum(s["size"] for s in sizes or ()), sum(s["once"] for s in sizes or ()), tuple(sorted((t["node"], t["text"]) for t in template or ())))
            if key not in _wrappers:
                if len(_wrappers) > 2000:
                    _wrappers.clear()
                _wrappers[key] = Wrapper(reference, sizes, template)
            texts.append(extract(html, _wrappers[key]))
        yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def main_texts(pages: DataFrame) -> DataFrame:
    """``page_id, url, text`` for every row of ``page_id, url, html``."""
    scratch = Scratch(pages.sparkSession, "html")
    host = url_parts(F.col("url"))[0]
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), "html")
    block = "array<struct<node:int,text:long,size:long,link:long>>"
    seen = pages.select("host", "html").mapInArrow(_describe, f"host string, skeleton string, title long, blocks {block}")
    seen = scratch.put(seen.withColumn("tree", F.xxhash64("skeleton")), "seen")
    trees = seen.groupBy("host", "tree").agg(F.first("skeleton").alias("skeleton"), F.count("*").alias("n"))
    trees = scratch.put(trees, "trees")
    reference = trees.groupBy("host").agg(F.max_by("skeleton", F.struct("n", F.length("skeleton"), "skeleton")).alias("reference"))
    aligned = trees.join(reference, "host").select("host", "tree", "skeleton", "reference").mapInArrow(_align, "host string, tree long, partner array<int>")
    aligned = scratch.put(aligned, "aligned")
    rows = seen.join(aligned, ["host", "tree"]).select("host", "title", "partner", F.explode("blocks").alias("b"))
    rows = rows.select("host", "title", F.get("partner", F.col("b.node")).alias("node"), "b.text", "b.size", "b.link").filter("node >= 0")
    texts = rows.groupBy("host", "node", "text", "title").agg(F.sum("size").alias("size"), F.sum("link").alias("link"), F.max("size").alias("once"))
    texts = texts.groupBy("host", "node", "text").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.sum("link").alias("link"), F.max("once").alias("once"))
    texts = scratch.put(texts, "texts")
    sizes = texts.groupBy("host", "node").agg(F.sum("size").alias("size"), F.sum("link").alias("link"), F.sum("once").alias("once"))
    sizes = sizes.groupBy("host").agg(F.collect_list(F.struct("node", "size", "link", "once")).alias("sizes"))
    titles = seen.select("host", "title").distinct().groupBy("host").agg(F.count("*").alias("titles"))
    often = texts.filter(F.col("n") >= LEAST)
    template = often.join(titles, "host").filter(F.col("n") >= SHARE * F.col("titles")).groupBy("host").agg(F.collect_list(F.struct("node", "text", "once")).alias("template"))
    wrappers = scratch.put(reference.join(sizes, "host", "left").join(template, "host", "left"), "wrappers")
    scratch.drop("seen", "trees", "aligned", "texts")
    joined = pages.join(wrappers, "host").select("page_id", "url", "host", "html", "reference", "sizes", "template")
    return joined.mapInArrow(_extract, "page_id long, url string, text string")
