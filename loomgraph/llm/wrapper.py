"""Main text of web pages by wrapper induction.

1. Each page becomes a tree of its block elements, tolerant of missing end tags, and its skeleton: the tree in
   which runs of equal siblings count as one.
2. The ``SKELETONS`` most frequent skeletons of a host are aligned by simple tree matching: the most frequent one
   starts the template, and what of another one does not match is grafted into it. Every skeleton is then
   aligned with the finished template, page by page and in parallel; nodes without a partner (of the other skeletons, or
   beyond ``SLOTS``) are in path slots, one for each path of labels below a slot, which are counted and judged like the others.
3. The template's slots are judged over all distinct pages of the host: on how many pages a slot stands, how much
   of a page's text it holds, how much of that is links, and how often its texts come again. The region that holds
   the bulk of the text that varies is the content. Beside it, slots of links, of texts that come again and again,
   and short ones on most pages are template. A text that stands in one slot on ``CONSTANT`` of the pages that have
   the slot is template wherever it is; with fewer than ``PAGES`` of them only texts up to ``SHORT`` characters are.
   Other slots are left open.
4. A page's text is its content region and what of the open slots is not marked as a menu, header, footer,
   sidebar, notice, advert, form or comment by element, role, class or id. The marks of elements around the content
   region do not count. Pages without a region (hosts with fewer than ``REGION_PAGES`` pages, addresses without a
   host, other kinds of pages) are judged by marks alone: those around the article are lifted, as are those around
   the bulk of the page, and text outside article elements counts if they hold little of it.

If a page has nothing in the content region and the template would leave less than ``LEAST`` of what the marks leave,
the marks decide; if constant texts are more than half of a page's text, the page is a copy and keeps them. ``lists=False`` leaves out step 4's marks (tests use
it to see what induction does alone); script, style, title, select and the like are never text.

Null pages count as empty and give an empty text; empty tables give none. Repeated rows stay, and count as one page
of the host. Ties are broken by the skeleton's hash. Pages are read whole, twice, so that no text is written
between the passes. Templates (``SLOTS`` nodes at most, and the path slots that two pages or more share; one on a single page counts to the nearest
node above, as no verdict comes from a single page) are the only thing that grows with hosts and reaches tasks:
as one broadcast up to ``BROADCAST_BYTES``, else by a join on the host. Other columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import json
import re
from bisect import bisect_left
from collections import defaultdict

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from loomgraph.llm.arrow import bound_batches, map_rows
from loomgraph.plans.workspace import Workspace

PAGES = 8
SHORT = 200
REGION_PAGES = 3
CONSTANT = 0.9
SKELETONS = 32
SLOTS = 5000
LEAST = 0.25
#: The part of the pages' text that a region must hold; that beside it which is light; texts that come again.
BULK, LIGHT, REPEATED = 0.6, 0.25, 0.5
BROADCAST_BYTES = 8_000_000
#: Comparisons of one alignment; beyond them the children of two nodes are matched in order of their labels.
MATCH_CELLS = 400_000
#: A node with more runs of equal children than this has its equal children counted as one, wherever they stand.
WIDE = 64

_TOKEN = re.compile(
    r"""<(?:!--.*?(?:--!?>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|([a-zA-Z][^\s/>]*)[^>]*>|[!?/][^>]*(?:>|\Z))""", re.S
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_STRUCTURE = re.compile("[(),]")  # what skeletons are written with
_NUMBER = re.compile("[0-9]+")
#: Elements below this depth add no nodes of their own to the tree; their text counts all the same.
_DEEPEST = 200
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
_BLOCK = frozenset(
    "html head body p div section article main h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre "
    "figure figcaption hr header footer nav aside form fieldset legend address details summary center hgroup menu dialog template search".split()
)
_ENDS_P = _BLOCK - frozenset("html head body td th tr thead tbody tfoot caption template legend".split())
# An element ends open ones of the second column, up to the nearest of the third.
_SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements of running text: beside the content region they are left open, however short.
_RUNNING = _HEADINGS | frozenset("p ul ol dl table blockquote pre figure hgroup".split())
#: Never text, whatever a page's layout.
_NEVER = frozenset("head template select button object svg audio video canvas datalist".split())
# Marks of regions that are not main text.
_ELEMENTS = frozenset("nav footer aside form dialog search menu".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
_MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup "
    "modal overlay newsletter subscribe subscription signup login sidebar widget widgets menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments "
    "commentlist disqus respond replies share sharing social related recommended recommendations".split()
)
#: With one of these words a class describes a layout, not what the element is.
_LAYOUT = frozenset("has no with without layout is not hide show hidden enabled disabled active open page two three one".split())
#: What may stand beside marks in the class of an article that is a comment or a teaser.
_PARTS = frozenset("body list item form card area box entry".split())


class Mark:
    """An element that bars its text (``kind`` "mark"), or an article or main element ("main")."""

    __slots__ = ("kind", "node", "above", "element")

    def __init__(self, kind: str, node: Node, above: Mark | None, element: bool):
        self.kind, self.node, self.above, self.element = kind, node, above, element


class Node:
    __slots__ = ("label", "children", "blocks", "parent")

    def __init__(self, label: str, parent: Node | None = None):
        self.label, self.children, self.blocks, self.parent = label, [], [], parent


class Block:
    """A block's text, its characters inside links, and the innermost mark around it."""

    __slots__ = ("text", "links", "mark")

    def __init__(self, text: str, links: int, mark: Mark | None):
        self.text, self.links, self.mark = text, links, mark

    @property
    def weight(self) -> int:
        return max(0, len(self.text) - self.links)


def _class_marks(tag: str, value: str) -> bool:
    names = [[p.lower() for p in re.split(r"[^A-Za-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", x)) if p] for x in value.split()]
    if tag in ("article", "main"):
        return any(names) and all(p in _MARKS or p in _PARTS for parts in names for p in parts) and any(p in _MARKS for parts in names for p in parts)
    return any(not _MARKS.isdisjoint(parts) and _LAYOUT.isdisjoint(parts) for parts in names)


def _element(tag: str, attributes: str, in_main: bool) -> tuple[bool, bool, str]:
    """(whether marked by element or role, whether by class or id, its class as part of its label)"""
    by_element = tag in _ELEMENTS or tag == "header" and not in_main
    by_class, label = False, ""
    if attributes and not attributes.isspace():
        for m in _ATTRIBUTE.finditer(attributes):
            name = m[1].lower()
            if name in ("class", "id", "role"):
                value = m[2] or m[3] or m[4] or ""
                if name == "role":
                    by_element = by_element or value.strip().lower() in _ROLES
                elif tag not in ("html", "body"):
                    by_class = by_class or _class_marks(tag, value)
                    if "header" in re.split(r"[^a-z0-9]+", value.lower()) and not in_main and tag not in ("article", "main"):
                        by_class = True
                    if name == "class" and tag not in ("article", "main"):
                        label = "." + ".".join(sorted(set(_NUMBER.sub("0", _STRUCTURE.sub("_", value)).split())))
    return by_element, by_class, label


def parse(page: str, lists: bool = True) -> tuple[Node, list[Block]]:
    """The tree of block elements, and the blocks of text in page order."""
    root = Node("")
    blocks: list[Block] = []
    # Open elements: tag, node of the nearest block element, whether never text, mark, inside article or main.
    stack: list[tuple[str, Node, bool, Mark | None, bool]] = [("", root, False, None, False)]
    buffer: list[str] = []
    linked = 0
    node, never, mark, in_main = root, False, None, False
    opened: dict[str, int] = {}

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text:
                node.blocks.append(len(blocks))
                blocks.append(Block(text, min(linked, len(text)), mark))
            linked = 0

    def close(upto: int) -> None:
        nonlocal node, never, mark, in_main
        while len(stack) > upto:
            tag = stack.pop()[0]
            opened[tag] -= 1
            _, above, n, m, i = stack[-1]
            if tag in _BLOCK or m is not mark:
                flush()
            node, never, mark, in_main = above, n, m, i

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else size
        if stop > at and not never:
            text = page[at:stop]
            text = html_lib.unescape(text) if "&" in text else text
            buffer.append(text)
            if opened.get("a"):
                linked += len(text.strip())
        if m is None:
            break
        at = m.end()
        tag = m[2] or m[4]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if opened.get(tag):
                bounds = {"table"} if tag not in ("table",) and opened.get("table") else ()
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        close(i)
                        break
                    if stack[i][0] in bounds and tag in ("p", "b", "i", "span", "a", "em", "strong"):
                        break
            elif tag in _BLOCK:
                flush()
            continue
        if tag == "br" or tag == "img":
            if not never:
                buffer.append(" ")
            continue
        block = tag in _BLOCK
        if block:
            flush()
            if tag in _ENDS_P and opened.get("p"):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == "p":
                        close(i)
                        break
                    if stack[i][0] in ("table", "td", "th", "button", "object"):
                        break
            if tag in _SIBLINGS:
                ended, bound = _SIBLINGS[tag]
                cut = 0
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in bound:
                        break
                    if stack[i][0] in ended:
                        cut = i
                if cut:
                    close(cut)
        if tag in _VOID:
            continue
        by_element, by_class, label = _element(tag, m[3] or "", in_main)
        if tag in _RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = end.start() if end else size
            done = page.find(">", at)
            at = size if done < 0 else done + 1
            continue
        marked = lists and (by_element or by_class)
        main = lists and tag in ("article", "main")
        if marked and not block:
            flush()
        if (block or marked) and len(stack) < _DEEPEST:
            child = Node(tag + label, node)
            node.children.append(child)
            node = child
        never = never or tag in _NEVER
        if marked:
            mark = Mark("mark", node, mark, by_element and tag != "form")
        elif main:
            mark = Mark("main", node, mark, False)
        in_main = in_main or main
        stack.append((tag, node, never, mark, in_main))
        opened[tag] = opened.get(tag, 0) + 1
    close(1)
    flush()
    return root, blocks


def skeleton(root: Node) -> tuple[str, dict[int, int], dict[int, int]]:
    """The tree in which equal siblings are one, as text; each block's node in it, in preorder; each Node's (by id)."""
    sig: dict[int, str] = {}

    def grouped(children: list[Node]) -> list[list[Node]]:
        runs: list[list[Node]] = []
        for c in children:
            if runs and sig[id(runs[-1][0])] == sig[id(c)]:
                runs[-1].append(c)
            else:
                runs.append([c])
        if len(runs) <= WIDE:
            return runs
        equal: dict[str, list[Node]] = {}
        for c in children:
            equal.setdefault(sig[id(c)], []).append(c)
        return list(equal.values())

    def write(n: Node) -> str:
        for c in n.children:
            write(c)
        parts = [sig[id(g[0])] for g in grouped(n.children)]
        out = sig[id(n)] = f"{n.label}({','.join(parts)})" if parts else n.label
        return out

    place: dict[int, int] = {}
    of: dict[int, int] = {}

    def number(members: list[Node], k: int) -> int:
        """Numbers the node that stands for ``members``, from k; returns the next number."""
        for n in members:
            of[id(n)] = k
            for b in n.blocks:
                place[b] = k
        k += 1
        for same in zip(*(grouped(n.children) for n in members)):
            k = number([c for run in same for c in run], k)
        return k

    text = write(root)
    number([root], 0)
    return text, place, of


# ---- templates


class Slot:
    """A node of a skeleton or template; ``id`` is its preorder number or its place in the template.

    ``further`` are path slots below it, with their place among its children.
    """

    __slots__ = ("label", "children", "id", "further")

    def __init__(self, label: str, ident: int):
        self.label, self.children, self.id, self.further = label, [], ident, []

    def below(self) -> list[Slot]:
        """Children and path slots, in their order."""
        if not self.further:
            return self.children
        placed = [(((i + 1) << _PLACES) - 1, c) for i, c in enumerate(self.children)]
        return [c for _, c in sorted([*placed, *self.further], key=lambda x: (x[0], x[1].id))]


#: Bits for the place of a path slot between two children of a template's slot.
_PLACES = 20


def path_slot(above: int, label: str) -> int:
    """The key of the path slot for nodes of that label below a slot or path slot; never a slot's id."""
    return _hash(f"{above}/{label}") & (1 << 62) - 1 | 1 << 62


def read_skeleton(text: str) -> list[Slot]:
    """The skeleton's nodes in preorder."""
    nodes: list[Slot] = []
    open_: list[Slot] = []
    label: list[str] = []

    def add() -> Slot:
        slot = Slot("".join(label), len(nodes))
        label.clear()
        nodes.append(slot)
        if open_:
            open_[-1].children.append(slot)
        return slot

    closed = False
    for c in text:
        if c == "(":
            open_.append(add())
            closed = False
        elif c in ",)":
            if not closed:
                add()
            closed = c == ")"
            if c == ")":
                open_.pop()
        else:
            label.append(c)
            closed = False
    if label or not nodes:
        add()
    return nodes


class Matching:
    """Simple tree matching: the most node pairs that keep labels, order and ancestry."""

    def __init__(self, cells: int = MATCH_CELLS):
        self.cells = cells
        self.memo: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}

    def match(self, a: Slot, b: Slot) -> int:
        key = (a.id, b.id)
        if key in self.memo:
            return self.memo[key][0]
        if a.label != b.label:
            return 0
        x, y = a.children, b.children
        self.cells -= len(x) * len(y)
        pairs, total = self._in_order(x, y) if self.cells < 0 else self._best(x, y)
        self.memo[key] = (total + 1, pairs)
        return total + 1

    def _best(self, x: list[Slot], y: list[Slot]) -> tuple[list[tuple[int, int]], int]:
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(1, len(x) + 1):
            row, before = best[i], best[i - 1]
            for j in range(1, len(y) + 1):
                pair = before[j - 1] + self.match(x[i - 1], y[j - 1]) if x[i - 1].label == y[j - 1].label else 0
                row[j] = max(before[j], row[j - 1], pair)
        i, j, pairs = len(x), len(y), []
        while i and j:
            pair = self.match(x[i - 1], y[j - 1]) if x[i - 1].label == y[j - 1].label else 0
            if pair and best[i][j] == best[i - 1][j - 1] + pair:
                i, j = i - 1, j - 1
                pairs.append((i, j))
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i -= 1
        return pairs[::-1], best[-1][-1]

    def _in_order(self, x: list[Slot], y: list[Slot]) -> tuple[list[tuple[int, int]], int]:
        places = defaultdict(list)
        for i, s in enumerate(x):
            places[s.label].append(i)
        after, pairs, total = 0, [], 0
        for j, s in enumerate(y):
            of = places.get(s.label, ())
            k = bisect_left(of, after)
            if k < len(of):
                pairs.append((of[k], j))
                total += self.match(x[of[k]], s)
                after = of[k] + 1
        return pairs, total


def match_trees(a: Slot, b: Slot) -> int:
    return Matching().match(a, b)


class Template:
    """Slots by id, and once judged a verdict for each and the constant texts of some.

    What a skeleton has beside the slots is in path slots: one for each label below each slot or path slot. They have keys
    until ``extend`` makes slots of those that pages share.
    """

    def __init__(self, labels: list[str] | None = None, children: list[list[int]] | None = None):
        self.slots = [Slot(label, i) for i, label in enumerate(labels or [""])]
        for s, below in zip(self.slots, children or [[]]):
            s.children = [self.slots[c] for c in below]
        self.region, self.verdicts, self.constants = None, "", {}
        self.paths: dict[int, int] = {}
        self._known: dict[str, tuple[list[int], list[bool], dict[int, tuple[int, str, int]]]] = {}

    @property
    def root(self) -> Slot:
        return self.slots[0]

    def parents(self) -> list[int]:
        out = [-1] * len(self.slots)
        for s in self.slots:
            for c in s.below():
                out[c.id] = s.id
        return out

    def extend(self, paths: list[tuple[int, int, str, int]]) -> None:
        """Makes slots of path slots (key, that of the slot above, label, place), in the order of their keys."""
        first = len(self.slots)
        made = {key: Slot(label, first + i) for i, (key, _, label, _) in enumerate(sorted(paths))}
        for key, above, _, place in paths:
            (made[above] if above in made else self.slots[above]).further.append((place, made[key]))
        self.slots += made.values()
        self.paths = {key: s.id for key, s in made.items()}

    def align(self, text: str, grow: bool = False) -> tuple[list[int], list[bool]]:
        """For each skeleton node its slot, or that of the nearest node above that has one, and whether it is its own."""
        to, own, paths = self.trace(text, grow)
        if not paths:
            return to, own
        to, own = list(to), list(own)
        for k, s in enumerate(to):
            while s in paths and s not in self.paths:
                s, own[k] = paths[s][0], False
            to[k] = self.paths.get(s, s)
        return to, own

    def trace(self, text: str, grow: bool = False) -> tuple[list[int], list[bool], dict[int, tuple[int, str, int]]]:
        """For each skeleton node its slot or path slot's key, and whether it is its own; path slots by key: that of the slot above, label, place.

        With ``grow``, nodes without a partner are grafted into the template, up to ``SLOTS`` nodes; the others, as all without
        ``grow``, are in path slots.
        """
        if not grow and text in self._known:
            return self._known[text]
        nodes = read_skeleton(text)
        to, own = [0] * len(nodes), [False] * len(nodes)
        paths: dict[int, tuple[int, str, int]] = {}
        matching = Matching()
        matching.match(self.root, nodes[0])

        def graft(n: Slot) -> Slot:
            slot = Slot(n.label, len(self.slots))
            self.slots.append(slot)
            to[n.id], own[n.id] = slot.id, True
            slot.children = [graft(c) for c in n.children]
            return slot

        def hang(n: Slot, above: int, place: int) -> None:
            key = path_slot(above, n.label)
            to[n.id], own[n.id] = key, True
            paths[key] = above, n.label, max(place, paths[key][2] if key in paths else 0)
            for j, c in enumerate(n.children):
                hang(c, key, j)

        def size(n: Slot) -> int:
            return 1 + sum(map(size, n.children))

        def walk(t: Slot, n: Slot) -> None:
            to[n.id], own[n.id] = t.id, True
            partner = {j: i for i, j in matching.memo[(t.id, n.id)][1]}
            old, merged, at = t.children, [], 0
            for j, c in enumerate(n.children):
                if j in partner:
                    merged += old[at : partner[j] + 1]
                    at = partner[j] + 1
                    walk(old[partner[j]], c)
                elif grow and len(self.slots) + size(c) <= SLOTS:
                    merged.append(graft(c))
                else:
                    hang(c, t.id, (at << _PLACES) + min(j, (1 << _PLACES) - 2))
            t.children = merged + old[at:]

        walk(self.root, nodes[0])
        if not grow:
            if len(self._known) > 256:
                self._known.clear()
            self._known[text] = to, own, paths
        return to, own, paths

    def write(self) -> str:
        """Path slots are written as their keys, in order."""
        slots = self.slots[: len(self.slots) - len(self.paths)]
        rules = [self.region, self.verdicts, [[k, sorted(v)] for k, v in self.constants.items()], sorted(self.paths)]
        return json.dumps([[s.label for s in slots], [[c.id for c in s.children] for s in slots], *rules], ensure_ascii=False)

    @staticmethod
    def read(text: str) -> Template:
        labels, children, region, verdicts, constants, keys = json.loads(text)
        out = Template(labels, children)
        out.paths = {key: len(labels) + i for i, key in enumerate(keys)}
        out.region, out.verdicts, out.constants = region, verdicts, {int(k): set(v) for k, v in constants}
        return out

    # Verdicts: T template, C content, U open.

    def judge(self, pages: dict[int, int], share: dict[int, float], chars: dict[int, int], links: dict[int, int], texts: dict[int, int], again: dict[int, int], constants: dict[int, list[int]]) -> None:
        """From sums over the host's distinct pages by slot: pages, shares of the page's text, characters, those in
        links; texts (distinct ones a page) of the slot and what is below it, and how many of them are not the first of their kind."""
        total = pages.get(0, 0)
        self.constants = {k: set(v) for k, v in constants.items()}
        verdict = ["U"] * len(self.slots)
        whole = lambda s: share.get(s.id, 0.0) / total if total else 0.0
        path = [self.root]
        while True:
            below = [c for c in path[-1].below() if pages.get(c.id)]
            best = max(below, key=lambda c: (whole(c), -c.id), default=None)
            if best is None or whole(best) < BULK or not any(pages.get(c.id) for c in best.below()):
                break
            path.append(best)
            if best.label in ("article", "main"):
                break
        region = path[-1] if path[-1].label not in ("", "html", "body") and total >= REGION_PAGES else None

        def mark(s: Slot, v: str) -> None:
            verdict[s.id] = v
            for c in s.below():
                mark(c, v)

        def beside(s: Slot, before: bool) -> str:
            n = pages.get(s.id, 0)
            if n < 2 or total < REGION_PAGES:
                return "U"
            if links.get(s.id, 0) >= 0.5 * chars.get(s.id, 0):
                return "T"
            tag = s.label.split(".", 1)[0]
            if before and tag in _HEADINGS:
                return "C"
            if n >= PAGES and again.get(s.id, 0) >= REPEATED * texts.get(s.id, 1) and share.get(s.id, 0.0) < LIGHT * n:
                return "T"
            short = chars.get(s.id, 0) <= SHORT * n and share.get(s.id, 0.0) < LIGHT * n and 2 * n >= total
            return "T" if region is not None and short and tag not in _RUNNING else "U"

        for above, on in zip(path, [*path[1:], None]):
            if above is region:
                mark(region, "C")
                break
            below = above.below()
            at = below.index(on) if on is not None else -1
            for i, c in enumerate(below):
                if c is not on and pages.get(c.id):
                    mark(c, beside(c, i < at))
        self.region, self.verdicts = (region.id if region else None), "".join(verdict)


def host_of(url: Column) -> Column:
    """The lower-case host of an address, null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:\[\]]+)", 1))
    return F.when(host != "", host)


def _barred(b: Block, lifted: set[int]) -> bool:
    m = b.mark
    while m is not None:
        if m.kind == "mark" and id(m) not in lifted:
            return True
        m = m.above
    return False


def _around(m: Mark | None) -> list[Mark]:
    out = []
    while m is not None:
        out.append(m)
        m = m.above
    return out


def by_marks(blocks: list[Block], lifted: set[int] = frozenset()) -> list[bool]:
    """Which blocks are main text as far as marks tell."""
    lifted = set(lifted)
    weight = [b.weight for b in blocks]
    chains = [_around(b.mark) for b in blocks]

    def free() -> list[int]:
        return [i for i, b in enumerate(blocks) if not _barred(b, lifted)]

    def within(m: Mark) -> int:
        """Text below a mark that no further mark bars."""
        total = 0
        for i, chain in enumerate(chains):
            for x in chain:
                if x is m:
                    total += weight[i]
                    break
                if x.kind == "mark" and id(x) not in lifted:
                    break
        return total

    some = {id(m): m for chain in chains for m in chain}
    open_ = free()
    if len(open_) < len(blocks) and not any(m.kind == "main" for i in open_ for m in chains[i]):
        mains = [(within(m), m) for m in some.values() if m.kind == "main"]
        best = max(mains, key=lambda x: x[0], default=(0, None))
        if best[0] and best[0] >= sum(weight[i] for i in open_):
            lifted |= {id(x) for x in _around(best[1])}
            open_ = free()
    if len(open_) < len(blocks) and sum(weight[i] for i in open_) < LEAST * sum(weight):
        outer = [m for m in some.values() if m.kind == "mark" and not m.element and id(m) not in lifted]
        best = max(((within(m), m) for m in outer), key=lambda x: x[0], default=(0, None))
        if best[0] > SHORT and best[0] >= BULK * sum(weight):
            lifted |= {id(x) for x in _around(best[1])}
            open_ = free()
    inside = [i for i in open_ if any(m.kind == "main" for m in chains[i])]
    if inside and sum(weight[i] for i in inside) >= LEAST * sum(weight[i] for i in open_):
        open_ = inside
    out = [False] * len(blocks)
    for i in open_:
        out[i] = True
    return out


def _hash(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass")) - (1 << 63)


def page_blocks(page: str | None, template: Template | None = None, lists: bool = True) -> list[str]:
    """The main text's blocks."""
    root, blocks = parse(page or "", lists)
    if template is None:
        return [b.text for b, kept in zip(blocks, by_marks(blocks)) if kept]
    text, place, of = skeleton(root)
    to, own = template.align(text)
    lifted: set[int] = set()
    if template.region is not None:
        around: set[int] = set()
        work = [root]
        while work:
            n = work.pop()
            if to[of[id(n)]] == template.region and own[of[id(n)]]:
                while n is not None and id(n) not in around:
                    around.add(id(n))
                    n = n.parent
            else:
                work += n.children
        lifted = {id(m) for b in blocks for m in _around(b.mark) if id(m.node) in around}
    fallback = by_marks(blocks, lifted)
    kept, constant, found = [], [], False
    for i, b in enumerate(blocks):
        k = place[i]
        verdict = template.verdicts[to[k]]
        keep = not _barred(b, lifted) if verdict == "C" else fallback[i] and verdict == "U"
        if keep:
            kept.append(i)
            found = found or verdict == "C"
            if own[k] and _hash(b.text) in template.constants.get(to[k], ()):
                constant.append(i)
    weigh = lambda rows: sum(blocks[i].weight for i in rows)
    by_fallback = [i for i, x in enumerate(fallback) if x]
    if not found and weigh(kept) < LEAST * weigh(by_fallback):
        kept, constant = by_fallback, []
    if 2 * weigh(constant) <= weigh(kept):
        gone = set(constant)
        kept = [i for i in kept if i not in gone]
    return [blocks[i].text for i in kept]


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", lists: bool = True) -> DataFrame:
    """id, url, text, n_chars of every page."""
    spark = pages.sparkSession
    work = Workspace(spark, "wrapper")
    known = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"),
        host_of(F.col(url_col).cast("string")).alias("host"),
    )

    def make_shapes():
        def one(host, html):
            root, blocks = parse(html or "", lists)
            shape, place, _ = skeleton(root)
            body = _hash("\n".join(f"{place[i]} {b.text}" for i, b in enumerate(blocks)))
            yield host, _hash(shape), shape, body, [place[i] for i in range(len(blocks))], [_hash(b.text) for b in blocks], [len(b.text) for b in blocks], [b.links for b in blocks]

        return one

    lists_of = [("nodes", "int", pa.int32()), ("hashes", "long", pa.int64()), ("chars", "int", pa.int32()), ("links", "int", pa.int32())]
    seen = map_rows(
        known.where("host is not null and html is not null").select("host", "html"), make_shapes,
        "host string, shape long, skeleton string, body long, " + ", ".join(f"{n} array<{t}>" for n, t, _ in lists_of),
        pa.schema([("host", pa.string()), ("shape", pa.int64()), ("skeleton", pa.string()), ("body", pa.int64()), *((n, pa.list_(t)) for n, _, t in lists_of)]),
    )
    firsts = [F.first(c).alias(c) for c in ("skeleton", *(n for n, _, _ in lists_of))]
    distinct = work.save(seen.groupBy("host", "shape", "body").agg(*firsts))
    shapes = distinct.groupBy("host", "shape").agg(F.count("*").alias("pages"), F.first("skeleton").alias("skeleton"))
    rank = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("pages"), "shape"))
    frequent = shapes.withColumn("rank", rank).where(F.col("rank") <= SKELETONS)

    def induce(pdf):
        import pandas as pd

        template = Template()
        for s in pdf.sort_values("rank")["skeleton"]:
            template.trace(s, grow=True)
        return pd.DataFrame([(pdf["host"].iloc[0], template.write())], columns=["host", "template"])

    bound_batches(spark)
    templates = work.save(frequent.groupBy("host").applyInPandas(induce, "host string, template string"))
    columns = ["skeleton", *(n for n, _, _ in lists_of)]
    paired, template_of = _with_templates(distinct.select("host", *columns), templates)

    def make_counts():
        find = template_of()
        nowhere = (-1, "", 0)

        def one(host, text, nodes, hashes, chars, links, *joined):
            template, above = find(host, *joined)
            to, _, paths = template.trace(text)
            total = sum(c - l for c, l in zip(chars, links)) or 1
            sums: dict[int, list] = {}
            texts: dict[tuple[int, int], int] = {}
            for k, h, c, l in zip(nodes, hashes, chars, links):
                s = to[k]
                first = (s, h) not in texts
                texts[(s, h)] = c
                while s >= 0:
                    x = sums.setdefault(s, [0, 0, 0])
                    x[0] += c
                    x[1] += l
                    x[2] += first
                    s = paths[s][0] if s in paths else above[s]
            if not sums:
                sums[0] = [0, 0, 0]
            for s, (c, l, t) in sums.items():
                yield host, s, None, 1, c, l, max(0.0, (c - l) / total), t, *paths.get(s, nowhere)
            for (s, h), c in texts.items():
                yield host, s, h, 1, c, 0, 0.0, 0, *nowhere

        return one

    fields = [("host", "string", pa.string()), ("slot", "long", pa.int64()), ("hash", "long", pa.int64()), ("n", "long", pa.int64()), ("chars", "long", pa.int64()), ("links", "long", pa.int64()), ("share", "double", pa.float64())]
    fields += [("texts", "long", pa.int64()), ("above", "long", pa.int64()), ("label", "string", pa.string()), ("place", "long", pa.int64())]
    counted = map_rows(paired, make_counts, ", ".join(f"{n} {t}" for n, t, _ in fields), pa.schema([(n, t) for n, _, t in fields]))
    counted = work.save(counted.groupBy("host", "slot", "hash").agg(F.sum("n").alias("n"), F.max("chars").alias("longest"), F.sum("chars").alias("chars"), F.sum("links").alias("links"), F.sum("share").alias("share"), F.sum("texts").alias("texts"), *(F.max(c).alias(c) for c in ("above", "label", "place"))))
    # A path slot on one page has no verdict or constants of its own, which takes two.
    of_slot = counted.where("hash is null and (above < 0 or n > 1)").select("host", "slot", F.col("n").alias("pages"), "chars", "links", "share", "texts", "above", "label", "place")
    repeats = counted.where("hash is not null").groupBy("host", "slot").agg(F.sum(F.col("n") - 1).alias("again"))
    slots = work.save(of_slot.join(repeats, ["host", "slot"], "left"))
    constant = (
        counted.where("hash is not null and n > 1").select("host", "slot", "hash", "n", "longest").join(slots.select("host", "slot", "pages"), ["host", "slot"])
        .where((F.col("n") >= CONSTANT * F.col("pages")) & ((F.col("pages") >= PAGES) | (F.col("longest") <= SHORT)))
        .groupBy("host", "slot").agg(F.sort_array(F.collect_list("hash")).alias("constant"))
    )
    # A host has at most SLOTS rows here, and one for each path slot that pages share.
    facts = slots.join(constant, ["host", "slot"], "left")

    def judge(pdf, of_host):
        import pandas as pd

        template = Template.read(of_host["template"].iloc[0])
        beside = pdf.loc[pdf["above"] >= 0, ["slot", "above", "label", "place"]]
        template.extend([(int(r.slot), int(r.above), r.label, int(r.place)) for r in beside.itertuples(index=False)])
        above = template.parents()
        pdf["slot"] = [template.paths.get(s, s) for s in pdf["slot"]]
        pages, share, chars, links, texts, again, constants = {}, {}, {}, {}, {}, defaultdict(int), {}
        for r in pdf.itertuples(index=False):
            pages[r.slot], share[r.slot], chars[r.slot], links[r.slot] = int(r.pages), float(r.share), int(r.chars), int(r.links)
            if r.constant is not None and not isinstance(r.constant, float):
                constants[int(r.slot)] = [int(x) for x in r.constant]
            if r.texts:
                texts[r.slot] = int(r.texts)
            if r.again == r.again and r.again is not None:
                s = r.slot
                while s >= 0:
                    again[s] += int(r.again)
                    s = above[s]
        template.judge(pages, share, chars, links, texts, again, constants)
        return pd.DataFrame([(of_host["host"].iloc[0], template.write())], columns=["host", "template"])

    rules = work.save(facts.groupBy("host").cogroup(templates.groupBy("host")).applyInPandas(judge, "host string, template string"))
    ruled, rule_of = _with_templates(known.select("host", "id", "url", "html"), rules)

    def make_text():
        find = rule_of()

        def one(host, key, url, html, *joined):
            found = find(host, *joined)
            text = "\n".join(page_blocks(html, found and found[0], lists))
            yield key, url, text, len(text)

        return one

    fields = [(id_col, "long", pa.int64()), ("url", "string", pa.string()), ("text", "string", pa.string()), ("n_chars", "long", pa.int64())]
    return map_rows(ruled, make_text, ", ".join(f"{n} {t}" for n, t, _ in fields), pa.schema([(n, t) for n, _, t in fields]))


#: A host is hot that has more rows than this and than a ten-thousandth of all.
HOT_ROWS = 100_000


def _with_templates(rows: DataFrame, templates: DataFrame):
    """``rows`` (host first), with the host's template as the last column if it must be joined, and how a task finds it:
    a function that gives (template, parents) for the host and that column, or None."""
    size = templates.agg(F.coalesce(F.sum(F.length("template") + F.length("host")), F.lit(0)).alias("n")).first()["n"]
    shared = None
    if size <= BROADCAST_BYTES:
        shared = rows.sparkSession.sparkContext.broadcast({r["host"]: r["template"] for r in templates.collect()})
    else:
        counts = rows.where("host is not null").groupBy("host").agg(F.count("*").alias("rows"))
        limit = max(HOT_ROWS, counts.agg(F.sum("rows")).first()[0] // 10_000)  # so at most 10,000 hosts are hot
        parts = F.ceil(F.col("rows") / limit)
        hot = F.broadcast(counts.where(F.col("rows") > limit).select("host", parts.alias("_parts")))
        part = F.floor(F.rand(1) * F.coalesce("_parts", F.lit(1)))
        names = rows.columns
        spread = templates.join(hot, "host", "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
        rows = rows.join(hot, "host", "left").withColumn("_part", part).drop("_parts").join(spread, ["host", "_part"], "left").select(*names, "template")

    def make():
        read: dict[str, tuple[Template, list[int]]] = {}

        def find(host, text=None):
            if shared is not None:
                text = shared.value.get(host)
            if text is None:
                return None
            if host not in read:
                if len(read) > 1000:
                    read.clear()
                template = Template.read(text)
                read[host] = template, template.parents()
            return read[host]

        return find

    return rows, make
