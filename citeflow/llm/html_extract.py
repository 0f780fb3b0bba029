"""Main text of web pages by union-free wrapper inference.

Pages of one host come from a few templates. Each page is a stream of tags and texts; level by level its
children are aligned with those of the host's wrapper so far. A tag that the wrapper does not expect is
resolved without unions: the same tag again is a repeat, a tag from further back repeats the whole stretch
since (whose members become optional), a tag from further on makes what lies between optional, and a new
tag is optional itself. Texts that differ become slots, texts that stay equal are template text. The
wrapper counts what its slots hold over all pages of the host, and these counts decide where the article is.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeflow.llm.shared import materialise

#: Labels of one tag among siblings; further ones go by their tag alone, so that class names that are data do not grow a wrapper.
VARIANTS = 64
#: Levels of a wrapper; what lies deeper belongs to the element at this depth.
DEPTH = 200
#: Wrappers that one task merges, and nodes that a task holds before it hands its wrappers on.
FAN, HELD = 64, 200_000
#: Different pages that a text must stand alike on to be template text, and what its characters then weigh.
ALIKE, TEMPLATE = 3, 0.05
#: Bytes of all wrappers up to which each task gets all of them.
SHIPPED = 16 << 20

# Elements by what they mean for reading text.
RAW = frozenset("script style noscript template iframe textarea title svg math object select button canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img input".split())
LEFT_OUT = frozenset("nav aside footer form menu dialog fieldset".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("html body div section article main table tbody tr td center form header font span".split())
# Words in class, id or role that mark what is not the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "notices alert popup modal overlay newsletter subscribe subscription signup login sidebar widget widgets menu nav navbar navigation "
    "breadcrumb breadcrumbs header masthead topbar footer copyright comment comments respond reply replies disqus related recommended "
    "recommendations share sharing social toolbar pagination pager complementary contentinfo search hidden skip".split()
)
# What else a compound name such as site-footer or cookie-bar may have and still be a mark.
AFFIXES = frozenset("site top bottom left right primary secondary global bar box list link links area block slot unit item items button buttons icon icons inner outer bg text".split())

_START = re.compile(r"<(?:[!?]|/?[a-zA-Z])")
_TAG = re.compile(r"""<(/?)([a-zA-Z][\w:.-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_NAME = re.compile(r"<(/?)([a-zA-Z][\w:.-]*)")
#: Characters of a tag within which quotes are followed; a longer one ends at its first closing bracket.
LONGEST_TAG = 1 << 16
_ATTR = re.compile(r"""([\w:-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPACE = re.compile(r"\s+")
_PART = re.compile(r"[a-z0-9]+")
_DIGITS = re.compile(r"\d+")


@cache
def _end_of(name: str) -> re.Pattern[str]:
    """The end tag of a raw element, in ASCII letters of either case."""
    return re.compile(rf"</{re.escape(name)}[^>]*>?", re.I | re.A)


@cache
def is_mark(token: str) -> bool:
    """Whether a whole class, id or role says that its element is not the article: each part of it does,
    or belongs to such names. States of a page (has-sidebar, comments-open, header-fixed) do not."""
    parts = _PART.findall(token)
    return any(x in MARKS for x in parts) and all(x in MARKS or x in AFFIXES or x.isdigit() for x in parts)


def label_of(name: str, attrs: str) -> str:
    """The tag with its classes, id and role (numbers in them are one), and ``!`` where it is hidden."""
    low = attrs.lower()
    if "=" not in low and "hidden" not in low:
        return name
    if not any(x in low for x in ("class", "id", "role", "style")):
        return name
    found = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attrs)}
    tokens = sorted({_DIGITS.sub("0", t) for k in ("class", "id", "role") for t in found.get(k, "").lower().split()})
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I)
    return name + ("." + " ".join(tokens) if tokens else "") + ("!" if hidden else "")


def whole_or_digest(text: str) -> str:
    """What a slot remembers of a text: a short one, or the digest of a long one."""
    return text if len(text) <= 64 else xxhash.xxh3_128_hexdigest(text)


def split_label(label: str) -> tuple[str, list[str], bool]:
    """(tag, class, id and role tokens, hidden)."""
    name, _, rest = label.removesuffix("!").partition(".")
    return name.partition(":")[0], rest.split(), label.endswith("!")


class Page:
    """A page as a flat tree in page order: parallel lists of labels (``#`` is text, an empty label blank
    text), parents and texts. Element 0 is the page. Tolerates what is unclosed or misplaced."""

    def __init__(self, page: str):
        self.labels, self.parents, self.texts = ["page"], [-1], [""]
        stack, names, open_count = [0], ["page"], {}
        labels, parents, texts = self.labels, self.parents, self.texts

        def text(raw: str) -> None:
            if raw:
                blank = not raw.strip()
                labels.append("" if blank else "#")
                parents.append(stack[-1])
                texts.append(" " if blank else html.unescape(raw) if "&" in raw else raw)

        def close(at: int) -> None:
            for n in names[at:]:
                open_count[n] -= 1
            del stack[at:], names[at:]

        pos, size, close_at, endless = 0, len(page), -1, set()
        while pos < size:
            m = _START.search(page, pos)
            if m is None:
                text(page[pos:])
                break
            at = m.start()
            text(page[pos:at])
            if page[at + 1] in "!?":
                comment = page.startswith("<!--", at)
                end = page.find("-->" if comment else ">", at + 2 + 2 * comment)
                pos = size if end < 0 else end + (3 if comment else 1)
                continue
            if close_at < at:
                close_at = page.find(">", at)
                if close_at < 0:
                    break  # A tag that the page's end cuts off is no text.
            m = _TAG.match(page, at, min(size, at + LONGEST_TAG))
            if m:
                pos, attrs = m.end(), m[3]
            else:
                m = _NAME.match(page, at, close_at)
                pos, attrs = close_at + 1, page[m.end() : close_at]
            closing, name = m[1], m[2].lower()
            if closing:
                if name not in VOID and open_count.get(name):
                    at = len(names) - 1
                    while names[at] != name:
                        at -= 1
                    close(at)
                continue
            if name in RAW:
                if not attrs.endswith("/"):
                    end = None if name in endless else _end_of(name).search(page, pos)
                    if end is None:
                        endless.add(name)
                    pos = end.end() if end else size if name in ("script", "style") else pos
                continue
            if name in CLOSES_P and open_count.get("p"):
                at = len(names) - 1
                while names[at] in INLINE:
                    at -= 1
                if names[at] == "p":
                    close(at)
            elif name in ("li", "option", "tr", "td", "th", "dd", "dt") and names[-1] == name:
                close(len(names) - 1)
            labels.append(label_of(name, attrs) if attrs else name)
            parents.append(stack[-1])
            texts.append("")
            if name not in VOID and not attrs.endswith("/"):
                stack.append(len(labels) - 1)
                names.append(name)
                open_count[name] = open_count.get(name, 0) + 1
        self._number()

    def _number(self) -> None:
        """Boxes without class or id are told apart by their place among their siblings, up to the eighth."""
        count: dict[tuple[int, str], int] = {}
        for i, label in enumerate(self.labels):
            if label in ("div", "section", "td", "table"):
                n = count[self.parents[i], label] = count.get((self.parents[i], label), 0) + 1
                if n > 1:
                    self.labels[i] = f"{label}:{min(n, 8)}"

    def children(self) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in self.labels]
        for i in range(1, len(self.labels)):
            if self.labels[i]:
                out[self.parents[i]].append(i)
        return out


class Wrapper:
    """A union-free regular expression over tags and texts, as a flat tree of items.

    The items inside an element are in order and have different labels; each may be optional or repeated,
    and stretches of them (``loops``, by their first and last item) may repeat as a whole.
    """

    LISTS = ("label", "parent", "kids", "optional", "repeated", "loops", "occurs", "chars", "linked", "constant", "pages")

    def __init__(self):
        self.label, self.parent, self.kids, self.optional, self.repeated, self.loops = [], [], [], [], [], []
        self.occurs, self.chars, self.linked, self.constant, self.pages = [], [], [], [], []
        self.at: list[dict[str, int]] = []
        self.known: list[set[tuple[str, ...]]] = []
        self.total = 0
        self._new("page", -1)

    def _new(self, label: str, parent: int) -> int:
        for name, value in zip(self.LISTS, (label, parent, [], False, False, [], 0, 0, 0, None, []), strict=True):
            getattr(self, name).append(value)
        self.at.append({})
        self.known.append(set())
        return len(self.label) - 1

    def find(self, node: int, label: str) -> int | None:
        """The item for a label: its own, else that of its bare tag where that stands for all variants."""
        found = self.at[node].get(label)
        return found if found is not None else self.at[node].get("~" + split_label(label)[0])

    def _add(self, node: int, label: str, place: int) -> int:
        name = split_label(label)[0]
        if sum(split_label(x)[0] == name for x in self.at[node]) >= VARIANTS:
            label = "~" + name
        made = self._new(label, node)
        self.at[node][label] = made
        self.kids[node].insert(place, made)
        return made

    def align(self, node: int, labels: tuple[str, ...]) -> list[int]:
        """Make the items inside ``node`` accept one more sequence; the items that it meets."""
        at = self.at[node]
        if labels in self.known[node]:
            return [self.find(node, x) for x in labels]
        kids, first, cursor = self.kids[node], not self.occurs[node], -1
        place = {k: i for i, k in enumerate(kids)}
        met, out = set(), []
        for label in labels:
            item = self.find(node, label)
            if item is None:
                cursor += 1
                item = self._add(node, label, cursor)
                self.optional[item] = not first
                place = {k: i for i, k in enumerate(kids)}
            elif place[item] == cursor:
                self.repeated[item] = True
            elif place[item] < cursor:
                loop = kids[place[item] : cursor + 1]
                for k in loop:
                    self.optional[k] = True
                if [loop[0], loop[-1]] not in self.loops[node]:
                    self.loops[node].append([loop[0], loop[-1]])
                cursor = place[item]
            else:
                cursor = place[item]
            met.add(item)
            out.append(item)
        for k in kids:
            if k not in met:
                self.optional[k] = True
        if len(self.known[node]) < 1000 and len(at) < VARIANTS:
            self.known[node].add(labels)
        return out

    def add(self, page: Page, key: int) -> None:
        """One more page; ``key`` tells different pages apart."""
        self.total += 1
        children, n = page.children(), len(page.labels)
        node, depth, link = [0] * n, [0] * n, [False] * n
        for i, kids in enumerate(children):
            if page.labels[i] == "#" or not page.labels[i]:
                continue
            here = node[i]
            if depth[i] >= DEPTH:
                for c in kids:
                    depth[c], link[c] = DEPTH, link[i] or page.labels[c].startswith("a.") or page.labels[c] == "a"
                    node[c] = here if page.labels[c] != "#" else self.find(here, "#") or self._add(here, "#", 0)
            else:
                for c, item in zip(kids, self.align(here, tuple(page.labels[c] for c in kids)), strict=True):
                    node[c], depth[c] = item, depth[i] + 1
                    link[c] = link[i] or page.labels[c] == "a" or page.labels[c].startswith("a.")
            self.occurs[here] += 1
            for c in kids:
                if page.labels[c] == "#":
                    text = page.texts[c].strip()
                    self._text(node[c], whole_or_digest(text), len(text), len(text) if link[c] else 0, [key], 1)

    def _text(self, slot: int, text: str | None, chars: int, linked: int, keys: list[int], times: int) -> None:
        """Count a text, or some equal ones; None where they differ."""
        if not self.occurs[slot]:
            self.constant[slot] = text
        elif self.constant[slot] != text:
            self.constant[slot] = None
        self.occurs[slot] += times
        self.chars[slot] += chars
        self.linked[slot] += linked
        if len(self.pages[slot]) < ALIKE and keys != self.pages[slot]:
            self.pages[slot] = sorted({*self.pages[slot], *keys})[:ALIKE]

    def merge(self, other: Wrapper) -> None:
        """Make this accept, and count, what ``other`` does."""
        self.total += other.total
        todo = [(0, 0)]
        while todo:
            a, b = todo.pop()
            if other.label[b] == "#":
                self._text(a, other.constant[b], other.chars[b], other.linked[b], other.pages[b], other.occurs[b])
                continue
            if not other.occurs[b] and not other.kids[b]:
                continue
            items = dict(zip(other.kids[b], self.align(a, tuple(other.label[k] for k in other.kids[b])), strict=True))
            self.occurs[a] += other.occurs[b]
            for k, item in items.items():
                self.optional[item] |= other.optional[k]
                self.repeated[item] |= other.repeated[k]
                todo.append((item, k))
            place = {k: i for i, k in enumerate(self.kids[a])}
            order = {k: i for i, k in enumerate(other.kids[b])}
            for lo, hi in other.loops[b]:
                inside = sorted(place[items[k]] for k in other.kids[b][order[lo] : order[hi] + 1])
                ends = [self.kids[a][inside[0]], self.kids[a][inside[-1]]]
                for k in self.kids[a][inside[0] : inside[-1] + 1]:
                    self.optional[k] = True
                if ends not in self.loops[a]:
                    self.loops[a].append(ends)

    def dumps(self) -> str:
        return json.dumps([self.total, *(getattr(self, x) for x in self.LISTS)])

    @staticmethod
    def loads(raw: str) -> Wrapper:
        w = Wrapper()
        w.total, *lists = json.loads(raw)
        for name, value in zip(Wrapper.LISTS, lists, strict=True):
            setattr(w, name, value)
        w.at = [{w.label[k]: k for k in kids} for kids in w.kids]
        w.known = [set() for _ in w.label]
        return w

    def runs(self, node: int) -> list[tuple[list[int], bool]]:
        """The items inside a node as stretches, with whether a stretch repeats as a whole."""
        place = {k: i for i, k in enumerate(self.kids[node])}
        spans: list[list[int]] = []
        for lo, hi in sorted((place[a], place[b]) for a, b in self.loops[node]):
            if spans and lo <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], hi)
            else:
                spans.append([lo, hi])
        out, i = [], 0
        for lo, hi in spans:
            out += [([k], False) for k in self.kids[node][i:lo]] + [(self.kids[node][lo : hi + 1], True)]
            i = hi + 1
        return out + [([k], False) for k in self.kids[node][i:]]

    def expression(self) -> str:
        """The wrapper as a pattern for ``re`` over a page's token stream (see ``tokens``)."""
        text: dict[int, str] = {}
        for node in range(len(self.label)):
            for k in (k for run, loop in self.runs(node) if loop for k in run):
                self.optional[k] = True
        for node in range(len(self.label) - 1, -1, -1):
            self_text = "".join(f"(?:{''.join(text[k] for k in run)})*" if loop else text[run[0]] for run, loop in self.runs(node))
            label = r"[^<>]*" if self.label[node].startswith("~") else re.escape(self.label[node])
            whole = "#" if self.label[node] == "#" else f"<{label}>{self_text}</>"
            mark = "*" if self.optional[node] and self.repeated[node] else "+" if self.repeated[node] else "?" if self.optional[node] else ""
            text[node] = f"(?:{whole}){mark}"
        return text[0]

    # --- what the counts say ---

    def decide(self) -> list[int]:
        """For each item: 0 outside of the article, 1 in it, 2 in it but left out.

        From the page down, the box that holds most of the unlinked, varying text of all pages is
        followed. The lowest <article> or <main> on that way that holds half of it is the article, else
        the lowest box with four fifths; a single <article> or <main> off that way is the article, too.
        Class words only lower a box's weight, and not where they stand around an article, or around half
        of all text, of a page that has no article elsewhere. Text that stands alike on all pages weighs
        little, unless an article holds it, and is part of the article where a box of its own holds it;
        where the body itself is the article, what is alike before and after all other text is left out.
        """
        n = len(self.label)
        names, marked, hidden = [], [], []
        for label in self.label:
            name, tokens, hid = split_label(label.removeprefix("~"))
            names.append(name)
            hidden.append(hid)
            marked.append(name not in ("html", "body") and any(map(is_mark, tokens)))
        holds = [x in ("article", "main") or "role=main" in self.label[i] for i, x in enumerate(names)]
        raw, inner = self.chars[:], [h and not m for h, m in zip(holds, marked, strict=True)]
        gone = [x in LEFT_OUT - {"form"} or h for x, h in zip(names, hidden, strict=True)]
        for i in range(n - 1, 0, -1):
            if not gone[i]:
                raw[self.parent[i]] += raw[i]
                inner[self.parent[i]] |= inner[i]
        free = [True] * n
        for i in range(1, n):
            free[i] = free[self.parent[i]] and not marked[i] and not gone[i]
        plain = any(free[i] and holds[i] and raw[i] for i in range(n))
        template = [self.label[i] == "#" and self.constant[i] is not None and len(self.pages[i]) >= ALIKE and names[self.parent[i]] not in HEADINGS and not self.repeated[i] for i in range(n)]
        for i in range(n):
            up = i
            while template[i] and up > 0:
                template[i] = not self.repeated[up] and names[up] not in HEADINGS
                up = self.parent[up]
        held = [False] * n
        for i in range(1, n):
            held[i] = held[self.parent[i]] or holds[i] and free[i]
            template[i] = template[i] and not held[i]
        mass = [float(c - k) * (TEMPLATE if t else 1.0) for c, k, t in zip(self.chars, self.linked, template, strict=True)]
        soft = marked[:]
        for i in range(n - 1, 0, -1):
            if marked[i] and not plain and (inner[i] and not holds[i] or 2 * raw[i] > raw[0]):
                soft[i] = False
            weight = 0.0 if gone[i] else 0.01 if soft[i] else 1.0
            if names[i] in ("form", "header") and 2 * raw[i] <= raw[0]:
                weight *= 0.1 if names[i] == "header" else 0.0
            mass[i] *= weight
            mass[self.parent[i]] += mass[i]
        way, here = [0], 0
        while True:
            boxes = [k for k in self.kids[here] if names[k] in CONTAINERS]
            best = max(boxes, key=lambda k: mass[k], default=None)
            if best is None or mass[best] <= 0 or 2 * mass[best] < mass[here]:
                break
            way.append(best)
            here = best
        named = [v for v in way if holds[v] and 2 * mass[v] >= mass[0]]
        if not named:
            single = [i for i in range(1, n) if holds[i] and free[i] and not self.repeated[i] and not held[self.parent[i]] and 10 * raw[i] >= raw[0] > 0]
            named = single if len(single) == 1 else []
        region = named[-1] if named else [v for v in way if mass[v] >= 0.8 * mass[0]][-1]
        status, heading = [0] * n, None
        if not named and region and any(names[k] in ("h1", "h2") for k in self.kids[self.parent[region]]):
            heading = self.parent[region]
        status[region] = 1
        around = self._around(region, template, gone, soft) if names[region] in ("page", "html", "body") else set()
        for i in range(1, n):
            up = self.parent[i]
            if status[i]:
                continue
            if up == heading and names[i] in ("h1", "h2"):
                status[i] = 1
            elif status[up] == 2:
                status[i] = 2
            elif status[up] == 1:
                out = names[i] in LEFT_OUT or hidden[i] or i in around or soft[i] and 2 * raw[i] <= raw[region]
                out = out or names[up] == "header" and names[i] not in HEADINGS and names[i] != "header" and not self._has_heading(i, names)
                status[i] = 2 if out else 1
        return status

    def _around(self, region: int, template: list[bool], gone: list[bool], soft: list[bool]) -> set[int]:
        """The template texts below ``region`` before the first and after the last of its other texts."""
        texts, todo = [], [region]
        while todo:
            k = todo.pop()
            if self.label[k] == "#":
                texts.append(k)
            elif not gone[k] and not soft[k]:
                todo += reversed(self.kids[k])
        own = [at for at, k in enumerate(texts) if not template[k] and self.chars[k] > self.linked[k]]
        return {k for at, k in enumerate(texts) if template[k] and own and not own[0] < at < own[-1]}

    def _has_heading(self, node: int, names: list[str]) -> bool:
        todo = [node]
        while todo:
            k = todo.pop()
            if names[k] in HEADINGS:
                return True
            todo += self.kids[k]
        return False


def tokens(page: Page) -> str:
    """A page's stream of tags and texts, as ``Wrapper.expression`` reads it."""
    out, stack = [], []
    for i, label in enumerate(page.labels):
        if not label:
            continue
        while stack and stack[-1] != page.parents[i]:
            out.append("</>")
            stack.pop()
        if label == "#":
            out.append("#")
        else:
            out.append(f"<{label}>")
            stack.append(i)
    return "".join(out) + "</>" * len(stack)


class Reader:
    """Reads the article of pages by a wrapper's decisions."""

    def __init__(self, wrapper: Wrapper):
        self.wrapper, self.status = wrapper, wrapper.decide()

    def text(self, page: Page) -> str | None:
        """The article's blocks, one a line; None where the page lacks the wrapper's article."""
        w, status = self.wrapper, self.status
        n = len(page.labels)
        node, depth = [0] * n, [0] * n
        out: list[list[str]] = [[]]
        met = status[0] == 1
        stack = [0]
        for i in range(1, n):
            up, label = page.parents[i], page.labels[i]
            while stack[-1] != up:
                if split_label(page.labels[stack.pop()])[0] not in INLINE:
                    out.append([])
            at = node[up]
            if at < 0:
                node[i] = -1
            elif label:
                depth[i] = depth[up] + 1
                found = w.find(at, label)
                node[i] = at if depth[i] > DEPTH and label != "#" else -1 if found is None else found
            if not label or label == "#":
                if at >= 0 and status[at] == 1 and (not label or node[i] >= 0 and status[node[i]] == 1):
                    out[-1].append(page.texts[i])
                continue
            name = split_label(label)[0]
            met = met or node[i] >= 0 and status[node[i]] == 1
            if name == "br":
                out[-1].append(" ")
            elif name not in INLINE:
                out.append([])
            if i + 1 < n and page.parents[i + 1] == i:
                stack.append(i)
            elif name not in INLINE and name != "br":
                out.append([])
        lines = (_SPACE.sub(" ", "".join(parts)).strip() for parts in out)
        return "\n".join(x for x in lines if x) if met else None


def read_page(page: str | None, reader: Reader | None) -> tuple[str, bool]:
    """(text, whether the host's wrapper gave it). A page without the wrapper's article is its own wrapper."""
    if not page:
        return "", reader is not None
    tree = Page(page)
    text = reader.text(tree) if reader else None
    if text is not None:
        return text, True
    own = Wrapper()
    own.add(tree, 0)
    return Reader(own).text(tree) or "", False


def main_text(page: str | None, wrapper: Wrapper | None = None) -> str:
    return read_page(page, Reader(wrapper) if wrapper else None)[0]


def induce(pages: list[str]) -> Wrapper:
    """The wrapper of some pages."""
    out = Wrapper()
    for page in pages:
        out.add(Page(page), xxhash.xxh64_intdigest(page) >> 1)
    return out


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def wrappers(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper as JSON, pages): inferred from all pages of each host.

    Each partition infers a wrapper of its pages of a host; these are merged FAN at a time, level by
    level, so that a host with any share of all pages is no more than FAN wrappers in a task.
    """
    given = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).where(F.length("html") > 0)

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, nodes = TaskContext.get().partitionId(), {}, 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array([part] * len(held), pa.int64()), pa.array([w.dumps() for w in held.values()], pa.string())], names=["host", "part", "wrapper"]
            )

        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                wrapper = held.setdefault(host, Wrapper())
                before = len(wrapper.label)
                wrapper.add(Page(page), xxhash.xxh64_intdigest(page) >> 1)
                nodes += len(wrapper.label) - before
                if nodes > HELD:
                    yield out()
                    held, nodes = {}, 0
        if held:
            yield out()

    found = materialise(given.mapInArrow(infer, "host string, part long, wrapper string"), "wrappers")

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        whole = Wrapper()
        for raw in frame.sort_values(["part", "wrapper"]).wrapper:
            whole.merge(Wrapper.loads(raw))
        return pd.DataFrame({"host": [frame.host.iloc[0]], "part": [frame.part.iloc[0] // FAN], "wrapper": [whole.dumps()]})

    parts = (found.agg(F.max("part")).first()[0] or 0) + 1
    while parts > 1:
        found = found.groupBy("host", F.expr(f"part div {FAN}").alias("_to")).applyInPandas(merge, "host string, part long, wrapper string")
        parts = -(-parts // FAN)
    count = F.get_json_object("wrapper", "$[0]").cast("long")
    return materialise(found.select("host", "wrapper", count.alias("pages")), "merged")


def extract_main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", hot: int = 4096) -> DataFrame:
    """One row per input row: id, url, ``text``, ``n_chars`` (code points), ``by_wrapper``.

    Null or empty html gives an empty text; null urls form one host. The wrapper of a host decides for
    all its pages that have its article; other pages are decided by a wrapper of their own
    (``by_wrapper`` false). Repeated rows get equal answers; an empty table gives an empty result; other
    columns are ignored; pages may be of any length and depth. Hosts with more than a ``hot``-th of all
    pages are spread over many tasks.
    """
    known = wrappers(pages, url_col=url_col, html_col=html_col)
    kind = pages.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars long, by_wrapper boolean"
    given = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    read = _reading([id_col, url_col, "text", "n_chars", "by_wrapper"])
    size, total = known.agg(F.sum(F.octet_length("wrapper")), F.sum("pages")).first()
    if (size or 0) <= SHIPPED:
        # All wrappers go to all tasks, as their size is known and small; pages stay where they are.
        sent = pages.sparkSession.sparkContext.broadcast(dict(known.select("host", "wrapper").collect()))

        def with_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from read(batches, sent.value)

        return given.mapInArrow(with_all, schema)
    # Else a host's wrapper comes before its pages in the order in which a task reads them.
    limit = max(10_000, total // hot)
    parts = F.ceil(F.col("pages") / limit).cast("int")
    # Fewer than `hot` hosts have more than the limit.
    heavy = F.broadcast(known.where(F.col("pages") > limit).select(F.col("host").alias("_hot"), parts.alias("_parts")))
    rows = given.join(heavy, F.col("host") == F.col("_hot"), "left").select("host", F.pmod(F.xxhash64("id", "url"), F.coalesce("_parts", F.lit(1))).cast("int").alias("part"), F.lit(None).cast("string").alias("wrapper"), "id", "url", "html")
    first = known.select("host", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "wrapper", *[F.lit(None).cast(t).alias(c) for c, t in (("id", kind), ("url", "string"), ("html", "string"))])
    dealt = first.unionByName(rows).repartition("host", "part").sortWithinPartitions("host", "part", F.asc_nulls_last("wrapper"))

    def in_turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from read(batches, {})

    return dealt.select("id", "url", "html", "host", "wrapper").mapInArrow(in_turn, schema)


def _reading(names: list[str]):
    """A function from batches (id, url, html, host and perhaps wrapper) and wrappers by host to answers.
    A row with a wrapper has no page: the wrapper is that of the rows after it."""

    def read(batches: Iterator[pa.RecordBatch], wrappers: dict[str, str]) -> Iterator[pa.RecordBatch]:
        readers: dict[str, Reader | None] = {}
        for batch in batches:
            kept, texts, known = [], [], []
            columns = [c.to_pylist() for c in batch.columns[2:]]
            for i, (page, host, *wrapper) in enumerate(zip(*columns, strict=True)):
                if wrapper and wrapper[0] is not None:
                    readers = {host: Reader(Wrapper.loads(wrapper[0]))}
                    continue
                if host not in readers:
                    if len(readers) >= 64:
                        readers = {}
                    readers[host] = Reader(Wrapper.loads(wrappers[host])) if host in wrappers else None
                text, ours = read_page(page, readers[host])
                kept.append(i)
                texts.append(text.encode("utf-8", "replace").decode())
                known.append(ours)
            at = pa.array(kept, pa.int64())
            out = [batch.column(0).take(at), batch.column(1).take(at), pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], np.int64)), pa.array(known, pa.bool_())]
            yield pa.RecordBatch.from_arrays(out, names=names)

    return read
