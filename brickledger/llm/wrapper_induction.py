"""Main text of web pages by wrapper induction.

Pages of a host are instances of a template. The template is a tree counted over
all pages of the host: equal labels under one parent are one slot, so a repeated
element is a single slot however often it stands there, and a slot is known by
the labels above it. The pages that have a slot are counted, and those that have
it next to the same left neighbour. Slots on at least one page in ``SHARED_BY``
make the template, so it holds at most that many times the slots of a mean page
however many pages there are; the neighbours give the order of its children.

Every page is then aligned with its host's template by simple tree matching (the
heaviest order- and ancestor-preserving match of nodes with equal labels). A
slot's children have different labels, so the best match of two child lists is a
heaviest rising sequence: it takes n log n time and linear memory for any number
of siblings. What has no partner belongs to the nearest slot above. Each slot is
measured over all pages: how much text it holds, how much of that is links, and whether
the text is one throughout. A slot with one text is template, links are menus;
the rest is content. The wrapper's content root is the innermost container that
holds nearly all of the content. A page's text is what stands there, less what
navigation, header, footer, sidebar, advert, notice, form and comment elements
hold; a page on which the root holds nothing is read by its article element, or
as a whole.

Pages are parsed and aligned in tasks; counts and measures are sums that combine
before the shuffle, so a host of any size meets no task as a whole.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from brickledger.llm.support import broadcast_if_small, map_batches, rows_batch, stored

#: A slot belongs to its host's template if at least one page in so many has it; up to that many pages, every slot does.
SHARED_BY = 50
DOMINANT = 0.8

# Element names and words of class, id and role attributes that decide what an element is for.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "xmp", "noembed", "noframes"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark",
          "math", "mfrac", "mi", "mn", "mo", "mover", "mroot", "mrow", "ms", "msqrt", "msub", "msubsup", "msup", "mtext", "munder", "semantics",
          "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "label"}
APART_TAGS = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "input", "head", "fieldset",
              "canvas", "audio", "video"} | RAW
APART_WORDS = {
    "nav", "navbar", "navigation", "menu", "topbar", "toolbar", "breadcrumb", "breadcrumbs", "pagination", "pager", "header", "masthead",
    "footer", "foot", "copyright", "sidebar", "aside", "widget", "widgets", "rail", "ad", "ads", "adv", "advert", "advertisement", "adverts",
    "advertising", "adsense", "banner", "sponsor", "sponsored", "promo", "promotion", "notice", "notices", "cookie", "cookies", "consent",
    "gdpr", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "search", "share", "sharing",
    "social", "related", "recommended", "recommendations", "comment", "comments", "commentlist", "disqus", "discussion", "reply", "replies",
    "respond", "complementary", "contentinfo", "form",
}
#: Words that may stand beside those in a class name of an element within the article.
BESIDE = {"block", "box", "section", "area", "wrap", "wrapper", "container", "content", "bar", "list", "item", "items", "links", "unit", "slot", "panel",
          "top", "bottom", "left", "right", "main", "site", "page", "post", "article", "inline"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ARTICLE_TAGS = {"article", "main"}
#: Elements that the content root may be; lists, paragraphs and the like are content themselves.
CONTAINERS = {"", "html", "body", "div", "section", "main", "article", "center", "table", "tbody", "tr", "td"}
CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1",
            "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
             "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
HOLDS = {"ul", "ol", "dl", "table", "tr", "tbody", "thead", "tfoot", "select", "div", "section", "article", "body", "html"}

MARKUP = re.compile(
    r"<!--(?:.*?--!?>|.*\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|</?([a-zA-Z][^\s/>]*)((?:[^>\"'=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[\"'=])*+)(>|\Z)", re.DOTALL)
ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
SPACE = re.compile(r"\s+")
TOKEN = re.compile(r"[a-z]+")


class Node:
    """An element that is not inline. ``blocks``: (place among the children, text, characters of it in links) of its own."""

    __slots__ = ("label", "tag", "apart", "article", "children", "blocks")

    def __init__(self, label: str, tag: str, apart: bool, article: bool):
        self.label, self.tag, self.apart, self.article = label, tag, apart, article
        self.children: list[Node] = []
        self.blocks: list[tuple[int, str, int]] = []


def set_apart(tag: str, named: dict[str, str], in_article: bool) -> bool:
    """Whether an element's names tell that it is no part of the text.

    Outside an article any word of class, id or role tells. Inside, an id may be
    a heading's anchor and a class may speak of the subject, so only class names
    and roles count that consist of such words and words for boxes.
    """
    if tag in APART_TAGS:
        return True
    if tag in ("html", "body"):
        return False
    if not in_article:
        return bool(set(TOKEN.findall(" ".join(named.values()).lower())) & APART_WORDS)
    if tag in HEADINGS:
        return False
    for name in f"{named.get('class', '')} {named.get('role', '')}".lower().split():
        parts = set(TOKEN.findall(name))
        if parts & APART_WORDS and parts <= APART_WORDS | BESIDE:
            return True
    return False


def parse(html: str) -> Node:
    """Tolerant tree of a page. Character references are decoded, white space inside a block becomes one space.

    Inline elements belong to the block they are in. An element that is not
    closed ends with its parent or where HTML lets it end; a tag cut off at the
    end of the page is no text.
    """
    root = Node("", "", False, False)
    open_: list[Node] = [root]
    words: list[str] = []
    place, linked, in_link = 0, 0, False

    def take(part: str) -> None:
        nonlocal linked
        words.append(part)
        if in_link:
            linked += len(part.strip())

    def flush() -> None:
        nonlocal linked
        text = SPACE.sub(" ", unescape("".join(words))).strip()
        words.clear()
        if text:
            open_[-1].blocks.append((len(open_[-1].children), text, min(linked, len(text))))
        linked = 0

    def close(names: set[str], within: set[str]) -> None:
        """End the nearest open element of one of the names, unless it lies outside ``within``."""
        for at in range(len(open_) - 1, 0, -1):
            if open_[at].tag in names:
                flush()
                del open_[at:]
                return
            if open_[at].tag in within:
                return

    while True:
        found = MARKUP.search(html, place)
        if found is None:
            take(html[place:])
            break
        take(html[place:found.start()])
        place = found.end()
        if found.group(1) is None:
            continue
        if not found.group(3):
            break  # cut off inside a tag
        tag, closing = found.group(1).lower(), found.group(0)[1] == "/"
        if tag == "a":
            in_link = not closing and not found.group(0).endswith("/>")
        if closing:
            if tag in INLINE:
                continue
            if tag == "br" or tag in VOID:
                words.append(" ")
            elif tag == "p":
                close({"p"}, {"article", "body", "td", "li", "blockquote", "section", "div"})
            else:
                close({tag}, set())
            continue
        if tag == "br":
            words.append(" ")
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(html, place)
            if not found.group(0).endswith("/>"):
                place = end.end() if end else len(html)
            continue
        if tag in INLINE or tag in ("img", "wbr", "col", "source", "track", "param", "area", "base", "link", "meta"):
            continue
        flush()
        if tag in CLOSES_P:
            close({"p"}, HOLDS | {"td", "th", "li", "blockquote", "button"})
        if tag in CLOSED_BY:
            close(CLOSED_BY[tag], HOLDS - {"tr", "tbody", "thead"} if tag in ("tr", "tbody", "tfoot") else HOLDS)
        named = {k.lower(): (a or b or c) for k, a, b, c in ATTRIBUTE.findall(found.group(2))}
        above = open_[-1]
        apart = above.apart or set_apart(tag, named, above.article)
        node = Node(f"{tag}.{'.'.join(sorted(named.get('class', '').lower().split()))}", tag, apart,
                    above.article or tag in ARTICLE_TAGS)
        above.children.append(node)
        if tag not in VOID and not found.group(0).endswith("/>"):
            open_.append(node)
    flush()
    return root


class Slot:
    """A node of a template, or all nodes of a page that are one slot. Its children have different labels and an order."""

    __slots__ = ("label", "tag", "children")

    def __init__(self, label: str, tag: str):
        self.label, self.tag = label, tag
        self.children: dict[str, Slot] = {}


def drawn_together(root: Node) -> tuple[Slot, dict[int, Slot]]:
    """A page as slots, and the slot of every node by ``id``."""
    top = Slot(root.label, root.tag)
    of = {id(root): top}
    stack = [(top, [root])]
    while stack:
        slot, nodes = stack.pop()
        groups: dict[str, list[Node]] = {}
        for node in nodes:
            for child in node.children:
                groups.setdefault(child.label, []).append(child)
        for label, group in groups.items():
            below = slot.children[label] = Slot(label, group[0].tag)
            of.update((id(n), below) for n in group)
            stack.append((below, group))
    return top, of


def heaviest_rise(pairs: list[tuple[int, int]]) -> tuple[int, list[int]]:
    """Of (place, weight) pairs with different places, the heaviest choice with rising places: its weight and indices.

    A tree of running maxima over the places gives each pair its best predecessor.
    """
    rank = {place: i + 1 for i, place in enumerate(sorted(p for p, _ in pairs))}
    tree: list[tuple[int, int]] = [(0, -1)] * (len(pairs) + 1)
    before, top = [], (0, -1)
    for i, (place, weight) in enumerate(pairs):
        best, at = (0, -1), rank[place] - 1
        while at:
            best, at = max(best, tree[at]), at & (at - 1)
        before.append(best[1])
        here, at = (best[0] + weight, i), rank[place]
        top = max(top, here)
        while at < len(tree):
            tree[at] = max(tree[at], here)
            at += at & -at
    chosen, at = [], top[1]
    while at >= 0:
        chosen.append(at)
        at = before[at]
    return top[0], chosen[::-1]


def match(page: Slot, template: Slot) -> tuple[int, dict[int, Slot]]:
    """Simple tree matching from the roots down: its size, and the template's partner of each page slot by ``id``. Nothing recurses: pages nest deeply."""
    weight: dict[int, int] = {}
    chosen: dict[int, list[str]] = {}
    stack = [(page, template, False)]
    while stack:
        a, b, ready = stack.pop()
        shared = [label for label in a.children if label in b.children]
        if not ready:
            stack.append((a, b, True))
            stack += [(a.children[x], b.children[x], False) for x in shared]
            continue
        place = {label: i for i, label in enumerate(b.children)} if len(shared) > 1 else dict.fromkeys(shared, 0)
        total, kept = heaviest_rise([(place[x], weight[id(a.children[x])]) for x in shared])
        weight[id(a)], chosen[id(a)] = 1 + total, [shared[i] for i in kept]
    found, stack = {}, [(page, template)]
    while stack:
        a, b = stack.pop()
        found[id(a)] = b
        stack += [(a.children[x], b.children[x]) for x in chosen[id(a)]]
    return weight[id(page)], found


def slot_counts(pages: list[str]) -> dict[tuple[int, int], list]:
    """Of a host's pages: [parent, label, tag, pages, sum of the places among its siblings] by (slot, left neighbour).

    A slot is the hash of the labels from the root, which is 0, as is the left neighbour of a first child.
    """
    out: dict[tuple[int, int], list] = {}
    for html in pages:
        stack = [(0, drawn_together(parse(html))[0])]
        while stack:
            parent, slot = stack.pop()
            left = 0
            for place, (label, child) in enumerate(slot.children.items()):
                own = xxhash.xxh64_intdigest(f"{parent}/{label}".encode()) - (1 << 63)
                held = out.setdefault((own, left), [parent, label, child.tag, 0, 0])
                held[3] += 1
                held[4] += place
                stack.append((own, child))
                left = own
    return out


def in_order(children: dict[int, tuple[float, dict[int, int]]]) -> list[int]:
    """Slots of one parent, given by (mean place, pages by left neighbour), in the order of the pages.

    Next is the slot with the fewest pages on which its left neighbour is still
    to come: 0 as long as no two pages contradict each other.
    """
    right: dict[int, list[tuple[int, int]]] = {}
    waiting: dict[int, int] = {}
    for slot, (_, lefts) in children.items():
        known = [(left, n) for left, n in lefts.items() if left in children]
        waiting[slot] = sum(n for _, n in known)
        for left, n in known:
            right.setdefault(left, []).append((slot, n))
    heap = [(n, children[slot][0], slot) for slot, n in waiting.items()]
    heapq.heapify(heap)
    out = []
    while heap:
        n, _, slot = heapq.heappop(heap)
        if waiting.get(slot) != n:
            continue  # placed already, or waits for fewer pages by now
        del waiting[slot]
        out.append(slot)
        for after, pages in right.get(slot, ()):
            if after in waiting:
                waiting[after] -= pages
                heapq.heappush(heap, (waiting[after], children[after][0], after))
    return out


def built(slots: list[tuple[int, int, str, str, float, dict[int, int]]]) -> Slot:
    """The template of (slot, parent, label, tag, mean place, pages by left neighbour) rows in any order."""
    below: dict[int, dict[int, tuple]] = {}
    for own, parent, label, tag, place, lefts in slots:
        below.setdefault(parent, {})[own] = (label, tag, place, lefts)
    top = Slot("", "")
    stack = [(0, top)]
    while stack:
        above, slot = stack.pop()
        known = below.get(above, {})
        for own in in_order({i: (place, lefts) for i, (_, _, place, lefts) in known.items()}):
            label, tag, _, _ = known[own]
            slot.children[label] = Slot(label, tag)
            stack.append((own, slot.children[label]))
    return top


def numbered(template: Slot) -> list[tuple[int, Slot]]:
    """(number of the parent, slot) in document order; numbers are places in this list, the root's parent is -1."""
    out, stack = [], [(-1, template)]
    while stack:
        parent, slot = stack.pop()
        out.append((parent, slot))
        stack += [(len(out) - 1, child) for child in reversed(slot.children.values())]
    return out


def packed(template: Slot) -> str:
    return json.dumps([(parent, slot.label, slot.tag) for parent, slot in numbered(template)])


def unpacked(text: str) -> tuple[Slot, list[int]]:
    """The template, and each slot's parent."""
    rows = json.loads(text)
    made = [Slot(label, tag) for _, label, tag in rows]
    for (parent, label, _), slot in zip(rows[1:], made[1:]):
        made[parent].children[label] = slot
    return made[0], [parent for parent, _, _ in rows]


def template_of(pages: list[str]) -> Slot:
    """The template of all slots of the pages."""
    found: dict[int, list] = {}
    for (own, left), (parent, label, tag, n, place) in slot_counts(pages).items():
        held = found.setdefault(own, [parent, label, tag, 0, 0, {}])
        held[3] += n
        held[4] += place
        held[5][left] = n
    return built([(own, parent, label, tag, place / n, lefts) for own, (parent, label, tag, n, place, lefts) in found.items()])


def blocks_of(page: Node, template: Slot, number: dict[int, int]) -> list[tuple[int, str, int, bool, bool]]:
    """(slot, text, characters in links, apart, in article) of the page's blocks in order.

    A block of a node without a partner belongs to the slot of the nearest node above that has one.
    """
    top, of = drawn_together(page)
    _, partner = match(top, template)
    out: list[tuple[int, str, int, bool, bool]] = []
    stack: list[tuple[Node, int, int, int]] = [(page, 0, 0, 0)]
    while stack:
        node, child, block, slot = stack.pop()
        while block < len(node.blocks) and node.blocks[block][0] <= child:
            _, text, links = node.blocks[block]
            out.append((slot, text, links, node.apart, node.article))
            block += 1
        if child < len(node.children):
            below = node.children[child]
            mine = partner.get(id(of[id(below)]))
            stack.append((node, child + 1, block, slot))
            stack.append((below, 0, 0, slot if mine is None else number[id(mine)]))
    return out


def content_slots(template: str, measures: list[tuple[int, int]], names: bool = True) -> list[int]:
    """Numbers of the slots in the content root and below it.

    ``measures``: (slot, characters of content over all pages). From the top the
    search goes into the child that holds ``DOMINANT`` of its parent's content,
    as long as that is a container with slots of its own, and not below an
    article element if names count.
    """
    top, parents = unpacked(template)
    slots = [slot for _, slot in numbered(top)]
    mass = [0] * len(slots)
    for slot, chars in measures:
        mass[slot] += chars
    for i in range(len(slots) - 1, 0, -1):
        mass[parents[i]] += mass[i]
    below: list[list[int]] = [[] for _ in slots]
    for i in range(1, len(slots)):
        below[parents[i]].append(i)
    root = 0
    while not (names and slots[root].tag in ARTICLE_TAGS):
        first = max(below[root], key=lambda i: mass[i], default=None)
        if first is None or mass[first] < DOMINANT * mass[root] or not mass[first] or not below[first] or slots[first].tag not in CONTAINERS:
            break
        root = first
    inside = [False] * len(slots)
    inside[root] = True
    for i in range(root + 1, len(slots)):
        inside[i] = inside[parents[i]]
    return [i for i, held in enumerate(inside) if held]


def host_of(url: Column) -> Column:
    """Lower-case host of a URL; empty when there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1), F.lit("")))


_COUNTED = pa.schema([("host", pa.string()), ("slot", pa.int64()), ("left", pa.int64()), ("parent", pa.int64()), ("label", pa.string()),
                      ("tag", pa.string()), ("pages", pa.int64()), ("places", pa.int64())])
_COUNTED_SQL = "host string, slot long, left long, parent long, label string, tag string, pages long, places long"


def _slot_counts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    own: dict[str, list[str]] = {}
    for host, html in zip(*(c.to_pylist() for c in batch.columns)):
        own.setdefault(host, []).append(html)
    rows = [(host, *key, *held) for host, pages in own.items() for key, held in slot_counts(pages).items()]
    yield rows_batch(_COUNTED, list(map(list, zip(*rows))) or [[] for _ in _COUNTED])


_TEMPLATE = pa.schema([("host", pa.string()), ("template", pa.string())])


def _templates(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    hosts, slots = (c.to_pylist() for c in batch.columns)
    yield rows_batch(_TEMPLATE, [hosts, [packed(built([
        (s["slot"], s["parent"], s["label"], s["tag"], s["places"] / s["pages"], {x["left"]: x["pages"] for x in s["lefts"]})
        for s in own or []])) for own in slots]])


def templates(rows: DataFrame, shared_by: int = SHARED_BY) -> DataFrame:
    """``host`` and ``template`` of every host of ``rows`` (host, html), counted over all its pages.

    A slot, or a left neighbour of one, counts if at least one page in
    ``shared_by`` has it: a slot's parent then counts too, a slot has at most
    ``shared_by`` neighbours and a template that many times the slots of a mean page.
    """
    hosts = stored(rows.groupBy("host").agg(F.count(F.lit(1)).alias("all_pages")), "hosts")
    near = broadcast_if_small(hosts, F.octet_length("host") + 8)
    enough = F.sum("pages") * shared_by >= F.first("all_pages")
    said = [F.min(c).alias(c) for c in ("parent", "label", "tag")]  # the same on all rows of a slot
    sums = [F.sum(c).alias(c) for c in ("pages", "places")]
    sided = map_batches(rows.select("host", "html"), _slot_counts, _COUNTED_SQL).groupBy("host", "slot", "left").agg(*said, *sums)
    often = F.when((F.col("left") != 0) & (F.col("pages") * shared_by >= F.col("all_pages")), F.struct("left", "pages"))
    slots = sided.join(near, "host").groupBy("host", "slot").agg(*said, *sums, F.collect_list(often).alias("lefts"), enough.alias("enough"))
    held = F.struct("slot", "parent", "label", "tag", "pages", "places", "lefts")
    of_host = slots.where("enough").groupBy("host").agg(F.collect_list(held).alias("slots"))  # bounded as said
    return map_batches(hosts.join(of_host, "host", "left").select("host", "slots"), _templates, "host string, template string")


_ALIGNED = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()),
    ("blocks", pa.list_(pa.struct([("slot", pa.int32()), ("text", pa.string()), ("apart", pa.bool_()), ("article", pa.bool_())]))),
    ("measures", pa.list_(pa.struct([("slot", pa.int32()), ("chars", pa.int64()), ("digest", pa.int64())])))])
_ALIGNED_SQL = ("page_id long, url string, host string, blocks array<struct<slot: int, text: string, apart: boolean, article: boolean>>, "
                "measures array<struct<slot: int, chars: bigint, digest: bigint>>")


def _aligned(names: bool):
    known: dict[str, tuple[Slot, dict[int, int]]] = {}

    def template(text: str) -> tuple[Slot, dict[int, int]]:
        if text not in known:
            if len(known) > 256:
                known.clear()
            top, _ = unpacked(text)
            known[text] = top, {id(slot): i for i, (_, slot) in enumerate(numbered(top))}
        return known[text]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for page_id, url, host, html, text in zip(*(c.to_pylist() for c in batch.columns)):
            found = blocks_of(parse(html), *template(text))
            if not names:
                found = [(slot, t, links, False, False) for slot, t, links, _, _ in found]
            held: dict[int, list] = {}
            for slot, t, links, apart, _ in found:
                if not apart:
                    held.setdefault(slot, []).append((t, links))
            measures = [{"slot": slot, "chars": sum(len(t) - links for t, links in own),
                         "digest": xxhash.xxh64_intdigest("\n".join(t for t, _ in own).encode()) - (1 << 63)} for slot, own in held.items()]
            rows.append((page_id, url, host, [{"slot": slot, "text": t, "apart": apart, "article": article}
                                              for slot, t, _, apart, article in found if not apart or article], measures))
        yield rows_batch(_ALIGNED, list(map(list, zip(*rows))))

    return run


_ROOTS = pa.schema([("host", pa.string()), ("inside", pa.list_(pa.int32()))])


def _roots(names: bool):
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        hosts, texts, measures = (c.to_pylist() for c in batch.columns)
        yield rows_batch(_ROOTS, [hosts, [content_slots(t, [(m["slot"], m["chars"]) for m in own], names) for t, own in zip(texts, measures)]])

    return run


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", names: bool = True) -> DataFrame:
    """Per page: its id, url, ``text`` (blocks joined by two line ends, empty if none) and ``n_chars``.

    With ``names`` false element and class names are not looked at and the
    template alone decides. Null and empty html give an empty text. Pages without
    a host in their url form one host. Repeated rows come back as often as they
    went in; an empty table gives no rows. Other columns are not read.
    """
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"),
                        F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    wrappers = stored(templates(rows.select("host", "html")), "templates")
    near = broadcast_if_small(wrappers, F.octet_length("host") + F.octet_length("template"))
    aligned = stored(map_batches(rows.join(near, "host").select("page_id", "url", "host", "html", "template"), _aligned(names), _ALIGNED_SQL), "aligned")
    # a row a slot and host: a slot with one text on all of several pages is template
    slots = aligned.select("host", F.explode("measures").alias("m")).groupBy("host", "m.slot").agg(
        F.count(F.lit(1)).alias("pages"), F.sum("m.chars").alias("chars"), F.min("m.digest").alias("low"), F.max("m.digest").alias("high"))
    varying = slots.withColumn("chars", F.when((F.col("pages") > 1) & (F.col("low") == F.col("high")), 0).otherwise(F.col("chars")))
    measured = varying.groupBy("host").agg(F.collect_list(F.struct("slot", "chars")).alias("measures"))  # bounded by the template
    none = F.array().cast("array<struct<slot:int,chars:bigint>>")
    roots = stored(map_batches(wrappers.join(measured, "host", "left").select("host", "template", F.coalesce("measures", none).alias("measures")),
                               _roots(names), "host string, inside array<int>"), "roots")
    placed = aligned.join(broadcast_if_small(roots, F.octet_length("host") + F.size("inside") * 4), "host")
    open_ = F.filter("blocks", lambda b: ~b["apart"])
    held = F.filter(open_, lambda b: F.array_contains("inside", b["slot"]))
    narrow = lambda part: F.when(F.exists(part, lambda b: b["article"]), F.filter(part, lambda b: b["article"])).otherwise(part)
    has_article = F.exists("blocks", lambda b: b["article"])
    kept = F.when(F.size(held) > 0, narrow(held)).when(has_article, F.filter(open_, lambda b: b["article"])).otherwise(open_)
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n\n")
    return placed.select(F.col("page_id").alias(id_col), F.col("url").alias(url_col), text.alias("text")).withColumn(
        "n_chars", F.length("text").cast("bigint"))
