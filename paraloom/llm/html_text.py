"""HTML extraction by wrapper induction: same-host pages are aligned, what stays constant is template, the slot that varies is content.

Pages of a host are dealt into groups of about GROUP pages, so a host's size does not matter and every page takes part. Trees are built
leniently (implied end tags, unclosed and truncated markup, raw text elements). They are aligned page by page with the group's wrapper
by simple tree matching (maximum over ordered pairs of equal signature, neighbours with one signature being one repeated node). A wrapper node is constant if
its own text is the same on two or more distinct pages and on all that have it. The content slot is found from the root downwards: the child with most of the varying
text is entered as long as no varying heading or paragraph stays beside it; but an article or main element that varies is entered before any longer neighbour,
several of them end the search, and inside main no child is entered while another holds prose that varies. In the slot, place tells what pages
share: a constant container (div, section, list, details) with varying paragraphs, list items or tables both before and after it is content, one at the
edge, before the first or after the last of them, is template; paragraphs, tables, quotations and headings, repeated or not, are content wherever they stand.

Names break ties only: elements that are menus, footers, sidebars, forms, adverts and the like by tag, role or by a whole class or id word are
not entered on the way to the slot while others can be, and are left out inside it unless they hold an article or main element. Where no single child has most of the varying text
and the articles of the slot have half of its text or more, they are the content, all of them. A page without others is its own wrapper, so names alone decide there.
What a page shares is told from the pages of its group (GROUP of its host, dealt by a hash of their html), so with other neighbours the same page may get another text.
Copies of a page on a host share a group and are learned once, so they tell nothing about the template; of a page with more than COPIES copies one
stands in the group, and the others get its text by join.

Defined cases: null or empty html, and a page with nothing but template, give the empty string; a repeated page gives the same text each time; a page with null or odd url
belongs to the host of no name; trees may be as deep and lists as long as they like; extra columns pass through, whatever their names.
"""

from __future__ import annotations

import html
import re
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paraloom.llm.common import cut, numbered, read_table, renamed, small
from paraloom.llm.url_filter import host_of

GROUP = 32
#: Copies of a page that go through its group at most; of more, one does.
COPIES = 16
#: Hosts that are broadcast with their number of pages at most; more are joined by shuffle.
BROADCAST_HOSTS = 500_000
#: Share of the varying text that a container must hold for the slot to lie in it.
SLOT_SHARE = 0.7
#: Cells of an alignment's table that are held at once; a longer pair of lists is halved first, which gives the same maximum.
TABLE_CELLS = 4_000_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
#: Not shown as text of the page, or controls.
NEVER = RAW | frozenset("head noscript template button select option datalist input dialog".split())
NAMED = frozenset("nav footer aside form menu".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("#root html body div section article main center table tbody tr td details header nav footer aside form ul ol fieldset".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li dd dt td th tr tbody table figure figcaption caption header".split())
ARTICLES = frozenset(["article", "main"])
#: Prose that bounds an article's body: a constant container between two of these is part of it.
BODY = frozenset("p pre blockquote li dd dt td th tr tbody table figure".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status note".split())
LABELS = frozenset(
    "nav navbar navigation menu menus submenu topbar sidebar sidebars rail footer masthead ad ads advert adverts advertisement advertising adsense banner banners sponsor sponsored promo promos promotion"
    " cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended breadcrumb breadcrumbs crumbs"
    " comment comments commentlist respond replies disqus widget widgets pagination pager toolbar search skip hidden".split()
)
#: Words that tell nothing beside a label in a hyphenated name.
NEUTRAL = frozenset("box bar block list item items area wrap wrapper container section inner outer site page top bottom left right main global links form unit slot".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th", "tbody"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(?P<tag>/?[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)|<[!?/][^>]*(?:>|$)|[^<]+|<", re.S)
_ATTR = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("tag", "sig", "parts", "named")

    def __init__(self, tag: str, sig: str, named: bool):
        self.tag, self.sig, self.named, self.parts = tag, sig, named, []  # parts: strings and nodes in page order


def labelled(names: str, words: frozenset[str]) -> bool:
    """Whether a class or id word is a label, alone or with neutral words by hyphen."""
    for name in names.lower().split():
        parts = [x for x in re.split(r"[-_\d]+", name) if x]
        if not words.isdisjoint(parts) and all(x in words or x in NEUTRAL for x in parts):
            return True
    return False


def _named(attrs: str, tag: str, inside: bool) -> tuple[str, bool]:
    """(signature, named) of an element; a header names nothing inside an article or main element."""
    named = tag in NAMED or (tag == "header" and not inside)
    if not attrs.strip():
        return tag, named
    found = {m[0].lower(): html.unescape(m[1] or m[2] or m[3]) for m in _ATTR.findall(attrs)}
    named = named or found.get("role", "").lower() in ROLES or "hidden" in found or found.get("aria-hidden") == "true" or bool(_HIDDEN.search(found.get("style", "")))
    if not named and tag not in ("html", "body", "article", "main"):
        words = LABELS if inside else LABELS | {"header"}
        named = labelled(f"{found.get('class', '')} {found.get('id', '')}", words)
    elif tag == "article":  # a reader's comment may be an article
        named = labelled(found.get("class", ""), frozenset(["comment", "comments"]))
    return f"{tag}.{found.get('class', '')}", named


def parse(page: str) -> tuple[Node, int]:
    """The tree of what a page shows, and its depth."""
    root = Node("#root", "#root", False)
    stack, at, depth, inside = [root], 0, 1, 0
    kept = [True]  # whether each open element is shown

    def close(k: int) -> None:
        nonlocal inside
        for x in stack[k:]:
            inside -= x.tag in ("article", "main")
        del stack[k:]
        del kept[k:]

    while at < len(page):
        m = _TOKEN.match(page, at)
        at, name = m.end(), m["tag"]
        if name is None:
            if kept[-1] and (m[0][0] != "<" or m[0] == "<"):
                stack[-1].parts.append(m[0])
            continue
        tag = name.lower()
        if tag[0] == "/":
            tag = tag[1:]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close(k)
                    break
            continue
        if tag in BLOCKS:
            for k in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag in BLOCKS:
                    break
        if tag in CLOSES:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in SCOPES.get(tag, ()):
                    break
                if stack[k].tag in CLOSES[tag]:
                    close(k)
                    break
        sig, named = _named(m["attrs"], tag, inside > 0)
        node = Node(tag, sig, named)
        shown = kept[-1] and tag not in NEVER
        if shown:
            stack[-1].parts.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            if end is None:
                break
            stop = page.find(">", end.start())
            at = stop + 1 if stop >= 0 else len(page)
        elif tag not in VOID:  # a slash does not close an HTML element
            stack.append(node)
            kept.append(shown)
            inside += tag in ("article", "main")
            depth = max(depth, len(stack))
    return root, depth


def keep_holders(node: Node) -> bool:
    """Take the name from elements that hold an article or main element; whether this one does or is one."""
    found = False
    for x in node.parts:
        if not isinstance(x, str) and keep_holders(x):
            found = True
    if found:
        node.named = False
    return found or (node.tag in ("article", "main") and not node.named)


def size(node: Node, skip: frozenset | set = frozenset()) -> int:
    """Characters of text, white space aside, without the skipped subtrees."""
    total = 0
    for x in node.parts:
        if isinstance(x, str):
            total += len("".join(x.split()))
        elif id(x) not in skip:
            total += size(x, skip)
    return total


def blocks(node: Node, skip: frozenset | set = frozenset()) -> list[str]:
    """The texts of a subtree's blocks in page order, decoded, with single spaces."""
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join(html.unescape("".join(line)).split())
        line.clear()
        if text:
            out.append(text)

    def walk(x: Node) -> None:
        for part in x.parts:
            if isinstance(part, str):
                line.append(part)
            elif id(part) in skip:
                flush()
            elif part.tag == "br":
                line.append(" ")
            elif part.tag in BLOCKS:
                flush()
                walk(part)
                flush()
            else:
                walk(part)

    walk(node)
    flush()
    return out


def form(node: Node) -> tuple[str, ...]:
    """Signatures and texts of a tree in page order: equal for copies of a page."""
    out: list[str] = []

    def walk(x: Node) -> None:
        out.append(f"<{x.sig}")
        for part in x.parts:
            if not isinstance(part, str):
                walk(part)
            elif text := " ".join(part.split()):
                out.append(f" {text}")
        out.append(">")

    walk(node)
    return tuple(out)


class Slot:
    """A wrapper node: what the aligned nodes of the pages have in common."""

    __slots__ = ("sig", "tag", "named", "texts", "pages", "chars", "children", "constant", "varying", "own", "marked", "prose")

    def __init__(self, like: Node):
        self.sig, self.tag, self.named, self.texts, self.pages, self.chars, self.children = like.sig, like.tag, like.named, set(), 0, 0, []
        self.constant, self.varying, self.own, self.marked, self.prose = False, 0, False, False, False


def runs(node: Node) -> list[list[Node]]:
    """Child elements, neighbours with one signature together."""
    out: list[list[Node]] = []
    for x in node.parts:
        if not isinstance(x, str) and x.tag not in VOID:
            if out and out[-1][0].sig == x.sig:
                out[-1].append(x)
            else:
                out.append([x])
    return out


def _is_leaf(group: list[Node]) -> bool:
    return len(group) > 1 or group[0].tag not in CONTAINERS


def own_text(nodes: list[Node]) -> str:
    """The text that belongs to a wrapper node itself: all of it where several or prose nodes stand for one."""
    if _is_leaf(nodes):
        return " ".join(line for x in nodes for line in blocks(x))
    return " ".join("".join(x for x in nodes[0].parts if isinstance(x, str)).split())


class Matcher:
    """Simple tree matching over numbered shapes: trees with equal signatures all over have one number, so each pair of shapes is matched once."""

    def __init__(self):
        self.numbers: dict[tuple, int] = {}
        self.sigs: list[str] = []
        self.kids: list[tuple[int, ...]] = []
        self.known: dict[tuple[int, int], int] = {}

    def _number(self, sig: str, kids: list[int]) -> int:
        key = (sig, *kids)
        if key not in self.numbers:
            self.numbers[key] = len(self.sigs)
            self.sigs.append(sig)
            self.kids.append(tuple(kids))
        return self.numbers[key]

    def of_group(self, group: list[Node]) -> int:
        kids = []
        if not _is_leaf(group):
            for x in runs(group[0]):
                kids.append(self.of_group(x))
        return self._number(group[0].sig, kids)

    def of_slot(self, slot: Slot) -> int:
        kids = []
        for x in slot.children:
            kids.append(self.of_slot(x))
        return self._number(slot.sig, kids)

    def score(self, a: int, b: int) -> int:
        """How many nodes of two trees match, roots with roots."""
        if self.sigs[a] != self.sigs[b]:
            return 0
        if (a, b) not in self.known:
            total = 1
            if self.kids[a] and self.kids[b]:
                for i, j in self.pairs(self.kids[a], self.kids[b]):
                    total += self.score(self.kids[a][i], self.kids[b][j])
            self.known[a, b] = total
        return self.known[a, b]

    def pairs(self, a: tuple[int, ...], b: tuple[int, ...]) -> list[tuple[int, int]]:
        """Places of two child lists that are matched, in order, with the most matched nodes below them."""
        left, right = [self.sigs[x] for x in a], {self.sigs[x]: j for j, x in enumerate(b)}
        if len(right) == len(b) and len(set(left)) == len(left):  # each signature once: if none cross, all that are in both
            both = [(i, right[x]) for i, x in enumerate(left) if x in right]
            if all(x[1] < y[1] for x, y in zip(both, both[1:], strict=False)):
                return both
        of_a, of_b = sorted(set(a)), sorted(set(b))
        weight = np.zeros((len(of_a), len(of_b)), dtype=np.int32)
        for i, x in enumerate(of_a):
            for j, y in enumerate(of_b):
                weight[i, j] = self.score(x, y)
        ia, ib = np.searchsorted(of_a, a), np.searchsorted(of_b, b)
        return best_pairs(weight, ia, ib)


def _last_row(weight: np.ndarray, ia: np.ndarray, ib: np.ndarray) -> np.ndarray:
    """The best total of all of ia with each beginning of ib."""
    best = np.zeros(len(ib) + 1, dtype=np.int64)
    for i in ia:
        row = best.copy()
        np.maximum(row[1:], best[:-1] + weight[i, ib], out=row[1:])
        best = np.maximum.accumulate(row)
    return best


def best_pairs(weight: np.ndarray, ia: np.ndarray, ib: np.ndarray) -> list[tuple[int, int]]:
    """The ordered pairs of two lists with the largest total weight; pairs of weight 0 are none."""
    if not len(ia) or not len(ib):
        return []
    if len(ia) > 1 and len(ia) * len(ib) > TABLE_CELLS:
        half = len(ia) // 2
        cut_at = int(np.argmax(_last_row(weight, ia[:half], ib) + _last_row(weight, ia[half:][::-1], ib[::-1])[::-1]))
        return best_pairs(weight, ia[:half], ib[:cut_at]) + [(i + half, j + cut_at) for i, j in best_pairs(weight, ia[half:], ib[cut_at:])]
    table = np.zeros((len(ia) + 1, len(ib) + 1), dtype=np.int64)
    for k, i in enumerate(ia):
        row = table[k].copy()
        np.maximum(row[1:], table[k, :-1] + weight[i, ib], out=row[1:])
        table[k + 1] = np.maximum.accumulate(row)
    found, i, j = [], len(ia), len(ib)
    while i and j and table[i, j]:
        if table[i, j] == table[i - 1, j]:
            i -= 1
        elif table[i, j] == table[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            found.append((i, j))
    return found[::-1]


def learn(slot: Slot, group: list[Node], placed: dict[int, Slot], matcher: Matcher) -> None:
    """Align a page's nodes with a wrapper node; nodes that it lacks are added in their place."""
    text = own_text(group)
    slot.texts.add(hash(text))
    slot.pages += 1
    slot.chars += len(text)
    for x in group:
        placed[id(x)] = slot
    if _is_leaf(group):
        return
    below = runs(group[0])
    met: dict[int, int] = {}
    if slot.children and below:
        a, b = [], []
        for x in slot.children:
            a.append(matcher.of_slot(x))
        for x in below:
            b.append(matcher.of_group(x))
        met = {j: i for i, j in matcher.pairs(tuple(a), tuple(b))}
    children, at = [], 0
    for j, other in enumerate(below):
        if j in met:
            children += slot.children[at : met[j] + 1]
            at = met[j] + 1
        else:
            children.append(Slot(other[0]))
        learn(children[-1], other, placed, matcher)
    slot.children = children + slot.children[at:]


def place_copy(node: Node, like: Node, placed: dict[int, Slot]) -> None:
    """Give the nodes of a tree the places of those of a tree with an equal form."""
    if id(like) in placed:
        placed[id(node)] = placed[id(like)]
    for x, y in zip(*([p for p in n.parts if not isinstance(p, str)] for n in (node, like)), strict=True):
        place_copy(x, y, placed)


def mark(slot: Slot) -> None:
    """Tell whether a wrapper node is or holds an article or main element, and prose, that varies; what is template by name holds none."""
    slot.marked, slot.prose = slot.tag in ARTICLES, slot.tag in BODY
    for x in slot.children:
        slot.marked = slot.marked or x.marked
        slot.prose = slot.prose or x.prose
    if slot.named or not slot.varying:
        slot.marked = slot.prose = False


def settle(slot: Slot) -> None:
    """Tell for each wrapper node whether it is constant, and how many characters vary."""
    slot.own = own = slot.pages > 1 and len(slot.texts) == 1
    slot.constant, slot.varying = own, 0 if own else slot.chars
    for x in slot.children:
        settle(x)
        slot.constant = slot.constant and x.constant
        slot.varying += x.varying
    mark(slot)


def content_slot(wrapper: Slot) -> Slot:
    """The wrapper node whose text is the content: the child with most of the varying text is entered while nothing that reads as content stays beside it."""
    inside = False
    while wrapper.tag != "article":
        inside = inside or wrapper.tag == "main"
        marked = [c for c in wrapper.children if c.marked]
        if len(marked) > 1:
            break
        most = max(marked or wrapper.children, key=lambda c: c.varying, default=None)
        total = wrapper.varying
        if most is None or not most.varying:
            break
        if not marked and (most.named or most.tag not in CONTAINERS or most.varying <= SLOT_SHARE * total):
            # no child by the alignment alone: names break the tie
            others = [c for c in wrapper.children if not c.named]
            most = max(others, key=lambda c: c.varying, default=None)
            total -= sum(c.varying for c in wrapper.children if c.named)
            if most is None or not most.varying or most.tag not in CONTAINERS or most.varying <= SLOT_SHARE * total:
                break
        rest = [c for c in wrapper.children if c is not most and c.varying and not c.named]
        if any(c.tag in PROSE or (inside and c.prose) for c in rest):
            break
        wrapper = most
    return wrapper


def articles_of(node: Node, skip: set) -> list[Node]:
    """The outermost article elements of a subtree, those left out aside."""
    found = []
    for x in node.parts:
        if not isinstance(x, str) and id(x) not in skip:
            if x.tag == "article":
                found.append(x)
            else:
                found += articles_of(x, skip)
    return found


def page_text(root: Node, slot: Slot, placed: dict[int, Slot], constants: bool = True) -> str:
    """A page's text in the slot; without the slot, that of the whole page without what is template by name."""
    found: list[Node] = []
    skip: set[int] = set()
    shared: list[tuple[int, int]] = []  # constant containers of the slot, and how many pieces of varying prose stand before each
    prose = 0

    def look(node: Node, inside: bool) -> None:
        nonlocal prose
        here = placed.get(id(node))
        if here is slot and not inside:
            found.append(node)
            inside = True
        elif node.named:
            skip.add(id(node))
            return
        elif inside and here is not None and here.constant and here.tag not in PROSE:
            shared.append((id(node), prose))
            return
        elif inside and here is not None and here.tag in BODY and not here.own and size(node):
            prose += 1
        for x in node.parts:
            if not isinstance(x, str):
                look(x, inside)

    look(root, False)
    skip.update(k for k, before in shared if constants and not 0 < before < prose)
    out = []
    for x in found or [root]:
        articles = articles_of(x, skip) if x.tag != "article" else []
        held = 0
        for y in articles:
            held += size(y, skip)
        for y in articles if articles and 2 * held >= size(x, skip) else [x]:
            out += blocks(y, skip)
    return "\n".join(out)


def extract(pages: list[str | None]) -> list[str]:
    """The main texts of pages of one host; what a page shows is learned once, however many copies it has."""
    known = list(dict.fromkeys(page or "" for page in pages))
    roots, deepest = [], 0
    limit = sys.getrecursionlimit()
    for page in known:
        root, depth = parse(page)
        roots.append(root)
        deepest = max(deepest, depth)
    try:
        # calls of Python functions take no C stack, so trees may be as deep as their pages are
        sys.setrecursionlimit(max(limit, 4 * deepest + 2000))
        wrapper, matcher = Slot(Node("#root", "#root", False)), Matcher()
        placed: dict[int, Slot] = {}
        learned: dict[tuple[str, ...], Node] = {}
        for root in roots:
            keep_holders(root)
            like = learned.setdefault(form(root), root)
            if like is root:
                learn(wrapper, [root], placed, matcher)
            else:
                place_copy(root, like, placed)
        settle(wrapper)
        slot = content_slot(wrapper)
        out = []
        for root in roots:
            out.append(page_text(root, slot, placed) or page_text(root, slot, placed, constants=False))
    finally:
        sys.setrecursionlimit(limit)
    texts = dict(zip(known, out, strict=True))
    return [texts[page or ""] for page in pages]


def extract_pages(
    pages: DataFrame, url_col: str = "url", html_col: str = "html", group: int = GROUP, broadcast_hosts: int = BROADCAST_HOSTS, copies: int = COPIES, out: str = "main_text"
) -> DataFrame:
    """pages with the column `out`, the main text; a column of that name is replaced."""
    kept = [c for c in pages.columns if c != out]
    at = f"c{kept.index(html_col)}"
    plain = numbered(pages, kept)
    keyed = plain.select("*", host_of(F.col(f"c{kept.index(url_col)}")).alias("host"), F.xxhash64(at).alias("page"))
    keys = cut(keyed.groupBy("host", "page").agg(F.count("*").alias("n")))
    counts = cut(keys.groupBy(F.col("host").alias("h")).agg(F.ceil(F.count("*") / group).alias("groups")))
    rows = keyed.join(small(counts, broadcast_hosts), F.col("host") == F.col("h")).drop("h")
    rows = rows.withColumn("g", F.pmod(F.xxhash64(F.lit(3), "page"), F.col("groups"))).drop("groups")
    types = {f.name: f.dataType.simpleString() for f in plain.schema}
    fields = "".join(f"{c} {t}, " for c, t in types.items())

    def run(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("page", kind="stable")
        texts = extract([None if not isinstance(t, str) else t for t in x[at]])
        return x[list(types)].assign(found=texts)

    often = cut(keys.where(F.col("n") > copies).select("host", "page", F.lit(True).alias("often")))
    if often.isEmpty():
        return renamed(rows.groupBy("host", "g").applyInPandas(run, f"{fields}found string"), kept, F.col("found").alias(out))

    def run_marked(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("page", kind="stable")
        return run(x).assign(host=x["host"], page=x["page"], often=x["often"])

    marked = rows.join(small(often, broadcast_hosts), ["host", "page"], "left").withColumn("often", F.coalesce("often", F.lit(False)))
    few, many = marked.where(~F.col("often")), marked.where("often")
    # a set of one page each, so copies are merged before they are dealt
    one = many.groupBy("host", "page", "g", "often").agg(F.get(F.collect_set(at), F.lit(0)).alias(at))
    one = one.select(*few.columns[:2], *[F.col(c) if c == at else F.lit(None).cast(types[c]).alias(c) for c in types], "g", "often")
    texts = lambda df: df.unionByName(one).groupBy("host", "g").applyInPandas(run_marked, f"{fields}found string, host string, page long, often boolean")
    concerned = one.select("host", "g").distinct()
    of_many = texts(few.join(concerned, ["host", "g"], "left_semi")).where("often").select("host", "page", "found")
    whole = texts(few).where(~F.col("often")).select(*types, "found").unionByName(many.join(of_many, ["host", "page"]).select(*types, "found"))
    return renamed(whole, kept, F.col("found").alias(out))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_pages(pages).select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))
