"""Main text of web pages, with wrappers inferred as union-free regular expressions.

A page is read as a stream of tags, texts, comments and raw elements. Two things follow.

*Wrappers.* The pages of one host are aligned one after another, element by element; where
they differ, texts become slots, elements that not all pages have become optional, and
neighbouring elements of one key are folded to a repeated group. The key is the element's
name and class with numbers made equal, so running ids don't part what belongs together. The
result is a regular expression without unions. Wrappers are built inside the partitions as
pages go by and then merged by host in two steps, as a wrapper aligns with a wrapper as with
a page: first those of partitions with one integer root, then the roots', so that of P
partitions no task merges more than about 2 sqrt(P) wrappers of a host. What is shuffled is
one wrapper for each host and partition; optional nodes of few pages leave it (``merged``).

*Region.* The wrapper chooses where the main text stands: from the root, the way goes on to
the child that holds two thirds of the slots' characters (links don't count), as long as it is
on most pages and not repeated (``main_region``). A page's text is what it has in that
element, with the headings beside the way to it. So changing link lists, teasers and adverts
outside are left out without a telling class, and constant texts inside stay. Where the page
marks articles, a region that is one gives way to marked ones of more than twice its text,
and another region is taken only if it has twice their text and none of it. Where the host has no region (fewer than three pages, no
child that stands out) or the page lacks it, the text is that of the page's article or main;
else what is left of the body without texts constant over most pages of the host.

*Extraction.* Elements that hold no main text (navigation, headers, footers, sidebars,
notices, adverts, forms, scripts, styles, reader comments; by name, role, class or id) are
left out everywhere. A class or id counts as a whole name: all its parts must be of the lists
below, so ``has-sidebar`` or ``related-work`` say nothing, and a head in an article is its own.
An element isn't left out by class or id if it holds the page's only articles or more than
half of its text; reader comments only if there is no other text. Character references are
decoded, white space inside a block becomes one space, blocks are joined by a newline.
Nothing is capped.

Wrappers are broadcast only while small (their size is measured), else joined by host.
Defined results: null html counts as empty and gives an empty text; a null url is a host of
its own; repeated rows are read each on its own; unclosed and misnested markup is read on,
an element left out whose end tag is missing ends where HTML closes it, and from a tag whose
quotes never close tags end at their first >;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import json
import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from gatemeter.llm.textbatch import filled

_RAW = r"<!--.*?(?:-->|$)|<(?P<raw>script|style|noscript|template|textarea|svg|iframe|title)(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|$)"
_TAG = r"<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)"
_REST = r"|<[!?/][^>]*>|[^<]+|<"
#: a tag ends at the first > outside of quotes
_LEX = re.compile(rf"{_RAW}|{_TAG}(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>{_REST}", re.DOTALL | re.IGNORECASE)
#: the same where quotes aren't closed: a tag ends at the first >
_LOOSE = re.compile(rf"{_RAW}|{_TAG}(?P<attrs>[^>]*+)>{_REST}", re.DOTALL | re.IGNORECASE)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
_LEFT_OUT = frozenset("nav header footer aside form button select option dialog menu head object audio video canvas fieldset".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: parts of a class or id that name what is no main text; the other parts of the name must be of _BESIDE
_COMMENTS = frozenset("comment comments disqus replies reply respond".split())
_HEADS = frozenset(("header", "masthead"))
_NAMES = _COMMENTS | _HEADS | frozenset(
    "ad ads advert adverts advertisement advertisements advertising advertorial adsense banner banners sponsor sponsors sponsored sponsorship promo promos promotion promotions promotional cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login paywall nav navs navbar navigation navmenu navlinks menu menus menubar breadcrumb breadcrumbs sidebar side topbar footer related recommended recommend recommendation recommendations recommends share sharing social widget toolbar pagination pager skip".split()
)
_BESIDE = frozenset(
    "site page main global top bottom left right upper lower primary secondary first second container wrapper wrap box block area region section list item items link links button buttons bar bars inner outer panel column col row group holder slot unit zone label title text form icon icons media posts articles stories sticky fixed floating mobile desktop dark light active open google the js id default".split()
)
#: what an article's parts are called after; with a head, its own title
_OWN = frozenset("post entry article story blog".split())
_PART = re.compile(r"[-_]+")
_ATTR = re.compile(r"""([a-zA-Z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
_SPACE = re.compile(r"\s+")
#: an opening tag closes an open one of these names first
_CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

#: names whose open elements an opening tag closes, a block also an open p; end tags may be missing
_CELLS = frozenset("td th tr tbody thead tfoot".split())
_IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "option": ("option",)} | dict.fromkeys(("tbody", "thead", "tfoot"), (*_CELLS, "caption"))
_MARKED = frozenset(("article", "main"))
_TITLES = frozenset("h1 h2 h3 h4 h5 h6".split())
#: elements that may be the region of the main text
_HOLDERS = frozenset("html body div section main article center".split())
_DIGITS = re.compile("[0-9]+")
#: depth of a wrapper's nodes; what is deeper stands beside one another at that depth
MOST_DEPTH = 60
#: wrappers that a task holds before it gives them out; a host's wrappers of one partition are merged later anyway
MOST_HOSTS = 20_000
#: end tags that reach through an open article
_WHOLE = frozenset(("article", "main", "body", "html"))
#: an end tag reaches no further up: of a cell or row, of another block, of an inline element
_CELL_STOPS = frozenset("table td th caption button object template".split())
_STOPS = _BLOCK | _CELL_STOPS
_LIST_STOPS = _STOPS - {"address", "div", "p"}
_SCOPES = dict.fromkeys(_CELLS, frozenset(("table",))) | {"table": frozenset(), "li": _CELL_STOPS | {"ul", "ol"}} | dict.fromkeys(_WHOLE, frozenset())


def _tokens(page: str) -> Iterator[tuple[str | None, str, str | None]]:
    """(text, "", None), (None, name, attributes) of an opening tag, (None, name, None) of an end tag; one pass.

    Comments and raw elements are empty texts. From a tag on whose quotes never close, tags
    end at their first >; after the last > all is text.
    """
    at, last, lex = 0, page.rfind(">"), _LEX
    while at <= last:
        for m in lex.finditer(page, at):
            said, name = m[0], m["name"]
            if said == "<" and lex is _LEX and m.end() <= last and page[m.end()].isalpha():
                lex, at = _LOOSE, m.start()
                break
            at = m.end()
            if name is not None:
                yield None, name.lower(), None if m["end"] else m["attrs"]
            else:
                yield (said if said[0] != "<" or said == "<" else ""), "", None
            if at > last:
                break
        else:
            break
    if at < len(page):
        yield page[at:].partition("<!--")[0], "", None


def _named(name: str, attrs: str, articles: int = 0) -> str:
    """What a class or id says that the element is: "comments" or "other" (no main text), or "" (nothing)."""
    said = ""
    if "=" in attrs and name not in ("html", "body", "main"):
        for key, value in _ATTR.findall(attrs):
            if key.lower() in ("class", "id"):
                for whole in value.strip("\"'").lower().split():
                    parts = [x for x in _PART.split(whole) if x and not x.isdigit()]
                    hits = _NAMES.intersection(parts)
                    if not hits or any(x not in _NAMES and x not in _BESIDE and x not in _OWN for x in parts):
                        continue
                    if hits <= _HEADS and (articles or name in _TITLES or not _OWN.isdisjoint(parts)):
                        continue
                    if hits.isdisjoint(_COMMENTS):
                        return "other"
                    said = "comments"
    return said


def _boilerplate(name: str, attrs: str) -> bool:
    """Whether an element is left out by its name, role or attributes."""
    if name in _LEFT_OUT:
        return True
    if "=" in attrs and name not in ("html", "body", "article", "main"):
        for key, value in _ATTR.findall(attrs):
            key, value = key.lower(), value.strip("\"'")
            if key == "role" and value.lower() in _ROLES or key == "aria-hidden" and value == "true":
                return True
    return "hidden" in attrs and re.search(r"(?:^|\s)hidden(?:\s|$|=)", attrs) is not None


def _kept_open(names: list[str], counts: dict[str, int], name: str) -> int:
    """How many of the open elements stay open when an element of this name begins."""
    keep = len(names)
    closed = _IMPLIED.get(name, ())
    if any(counts.get(n) for n in closed):
        cell = name in _CELLS
        for k in range(len(names) - 1, -1, -1):
            if names[k] in closed:
                keep = k
                if not cell:
                    break
            elif names[k] == "table" if cell else names[k] in _LIST_STOPS:
                break
    if name in _BLOCK and counts.get("p"):
        for k in range(keep - 1, -1, -1):
            if names[k] == "p":
                return k
            if names[k] in _STOPS:
                break
    return keep


def _ended(names: list[str], counts: dict[str, int], name: str, read: int) -> int:
    """How many of the open elements stay open after an end tag; the first `read` of them are read, not left out."""
    if counts.get(name):
        stops = _SCOPES.get(name, _CELL_STOPS if name in _STOPS else _STOPS)
        for k in range(len(names) - 1, -1, -1):
            if names[k] == name:
                return k
            if names[k] in stops or k < read and names[k] in _MARKED and name not in _WHOLE:
                break
    return len(names)


class _Events:
    """Texts and tags of a page, and where the element of each opening tag ends."""

    def __init__(self, page: str):
        self.text: list[str | None] = []  # None: a tag
        self.name: list[str] = []
        self.attrs: list[str | None] = []  # None: an end tag
        self.end: dict[int, int] = {}  # the first event after the element
        self.own: set[int] = set()  # elements with an end tag of their own
        names: list[str] = []
        starts: list[int] = []
        counts: dict[str, int] = {}
        read: int | None = None  # open elements that lie outside of all that may be left out

        def cut(keep: int, at: int, by_tag: bool) -> None:
            nonlocal read
            for k in range(keep, len(names)):
                counts[names[k]] -= 1
                self.end[starts[k]] = at
            if by_tag:
                self.own.add(starts[keep])
                self.end[starts[keep]] = at + 1
            del names[keep:], starts[keep:]
            if read is not None and read >= keep:
                read = None

        for text, name, attrs in _tokens(page):
            at = len(self.text)
            if text is not None:
                self.add(text, "", None)
                continue
            if attrs is None:
                keep = _ended(names, counts, name, len(names) if read is None else read)
                if keep < len(names):
                    cut(keep, at, True)
                self.add(None, name, None)
                continue
            keep = _kept_open(names, counts, name)
            if keep < len(names):
                cut(keep, at, False)
            self.add(None, name, attrs)
            if name not in _VOID and not attrs.endswith("/"):
                if read is None and (_boilerplate(name, attrs) or _named(name, attrs)):
                    read = len(names)
                names.append(name)
                starts.append(at)
                counts[name] = counts.get(name, 0) + 1
        cut(0, len(self.text), False)

        self.begun = [i for i, (name, attrs) in enumerate(zip(self.name, self.attrs, strict=True)) if attrs is not None and name in _MARKED]

    def past(self, at: int, articles: int) -> int:
        """The first event after an element left out; if its end tag is missing, an article ends it."""
        end = self.end[at]
        if at not in self.own and self.name[at] != "article" and not articles:
            k = bisect_right(self.begun, at)
            end = min(end, self.begun[k]) if k < len(self.begun) else end
        return end

    def add(self, text: str | None, name: str, attrs: str | None) -> None:
        self.text.append(text)
        self.name.append(name)
        self.attrs.append(attrs)


class _Weights:
    """Characters of a page outside of what names and roles leave out, and where its articles begin."""

    def __init__(self, events: _Events):
        self.upto = [0]  # characters before each event
        self.begun: list[int] = []  # articles and mains that may be read
        self.depths: list[int] = []  # how many named elements each of them stands in
        self.named: dict[int, int] = {}  # the same of elements whose class or id says no main text, themselves counted
        ends: list[int] = []
        articles, at = 0, -1
        while (at := at + 1) < len(events.text):
            text, name, attrs = events.text[at], events.name[at], events.attrs[at]
            self.upto.append(self.upto[-1] + (len(text.strip()) if text else 0))
            if text is not None:
                continue
            if attrs is not None and at in events.end and not (articles and name == "header"):
                if _boilerplate(name, attrs):
                    end = events.past(at, articles)
                    self.upto += [self.upto[-1]] * (end - at - 1)
                    at = end - 1
                    continue
                while ends and ends[-1] <= at:
                    ends.pop()
                if _named(name, attrs, articles):
                    ends.append(events.end[at])
                    self.named[at] = len(ends)
            if name in _MARKED:
                if attrs is not None:
                    self.begun.append(at)
                    self.depths.append(len(ends))
                articles = max(0, articles - 1) if attrs is None else articles + 1

    def chars(self, start: int, end: int) -> int:
        return self.upto[end] - self.upto[start]

    def least(self, start: int, end: int) -> int | None:
        """The least depth of the articles that begin there."""
        return min(self.depths[bisect_left(self.begun, start) : bisect_left(self.begun, end)], default=None)


def blocks(page: str, region: Sequence[str] = ()) -> tuple[list[str], str]:
    """(texts of the blocks in page order, where they stand: "article", "region" or "body")."""
    inside: list[list[str]] = [[], [], []]  # of the body, of articles, of the region
    held: list[str] = []
    articles = beside = shared = at = begun = 0
    spared = None  # the end of a named element that is read as it holds the articles or most of the text
    weights: _Weights | None = None
    plain = sure = False  # whether an article stands outside of named elements left out, and of all

    def end_block() -> None:
        nonlocal beside, shared
        if held:
            text = _SPACE.sub(" ", html.unescape("".join(held))).strip()
            held.clear()
            if text:
                inside[0].append(text)
                if articles:
                    inside[1].append(text)
                if any(a <= begun < b for a, b in spans):
                    inside[2].append(text)
                    shared += len(text) if articles else 0
                if spared is None or at > spared:
                    beside += len(text)

    def left_out(kind: str) -> bool:
        """Whether the named element that begins here is left out; else its articles count as the page's."""
        nonlocal weights, plain, sure, spared
        if weights is None:
            weights = _Weights(events)
            plain = sure = weights.least(0, len(events.text)) == 0
        end = events.end.get(at, at + 1)
        own, whole = weights.chars(at, end), weights.upto[-1]
        least = None if plain or articles else weights.least(at, end)
        if kind == "comments":
            kept = own == whole > 0
        elif plain and not articles:
            kept = False
        else:
            kept = least is not None or 2 * own > whole
        if kept and not articles and (spared is None or at >= spared):
            spared = end
        plain = plain or kept and least == weights.named.get(at, 0)
        return not kept

    events = _Events(page)
    spans = _spans(events, region) if region else []
    at = -1
    while (at := at + 1) < len(events.text):
        text, name, attrs = events.text[at], events.name[at], events.attrs[at]
        if text is not None:
            if not held or not text.isspace() and not any(map(str.strip, held)):
                begun = at
            held.append(text)
            continue
        if attrs is not None and name not in _VOID and not (articles and name == "header"):  # an article's own header holds its title
            kind = "" if (gone := _boilerplate(name, attrs)) else _named(name, attrs, articles)
            if gone or kind:
                end_block()
                past = events.past(at, articles) if at in events.end else at + 1
                if gone or past < events.end.get(at, past) or left_out(kind):
                    at = past - 1
                    continue
        if name in _BLOCK:
            end_block()
        elif name in ("br", "td", "th"):
            held.append(" ")
        if name in _MARKED:
            articles = max(0, articles - 1) if attrs is None else articles + 1
    end_block()
    marked = bool(inside[1]) and (spared is None or sure or sum(map(len, inside[1])) >= beside)
    own, articled = (sum(map(len, inside[k])) for k in (2, 1))
    if own and (not marked or (2 * own >= articled if region[-1].partition(".")[0] in _MARKED else own >= 2 * articled and not shared)):
        return inside[2], "region"
    return (inside[1], "article") if marked else (inside[0], "body")


# A wrapper: {"n": pages, "c": [node]}; a node is [key, pages, repeated, children] or ["#", pages, text or None, characters].


def _key(name: str, attrs: str) -> str:
    """What an element aligns by: its name and the first word of its class, numbers made equal."""
    if "class" in attrs:
        for key, value in _ATTR.findall(attrs):
            if key.lower() == "class" and (words := value.strip("\"'").lower().split()):
                return f"{name}.{_DIGITS.sub('0', words[0])}"
    return name


def tree(page: str) -> dict:
    """The wrapper of one page. Deeper than MOST_DEPTH, elements stand beside one another."""
    events = _Events(page)
    root: list = []
    stack: list[tuple[int, list]] = [(len(events.text) + 1, root)]
    for at, text in enumerate(events.text):
        while stack[-1][0] <= at:
            stack.pop()
        if text is not None:
            said = _SPACE.sub(" ", html.unescape(text)).strip()
            if said:
                stack[-1][1].append(["#", 1, said, len(said)])
        elif (attrs := events.attrs[at]) is not None:
            node = [_key(events.name[at], attrs), 1, False, []]
            stack[-1][1].append(node)
            end = events.end.get(at)
            if end is not None and len(stack) < MOST_DEPTH:
                stack.append((end, node[3]))
    return {"n": 1, "c": folded(root)}


def _joined_text(a: list, b: list, pages: int) -> list:
    return ["#", pages, a[2] if a[2] == b[2] else None, a[3] + b[3]]


def folded(nodes: list) -> list:
    """Neighbouring elements of one key as one repeated group, neighbouring texts as one."""
    out: list = []
    for node in nodes:
        if node[0] != "#":
            node[3] = folded(node[3])
            if out and out[-1][0] == node[0]:
                out[-1] = [node[0], out[-1][1], True, aligned(out[-1][3], node[3])]
                continue
        elif out and out[-1][0] == "#":
            out[-1] = _joined_text(out[-1], node, 1)
            continue
        out.append(node)
    return out


def aligned(a: list, b: list) -> list:
    """The two sequences as one: equal keys merge, the rest becomes optional."""
    out: list = []
    keys_a, keys_b = [x[0] for x in a], [x[0] for x in b]
    same = keys_a == keys_b
    for tag, i, j, k, n in [("equal", 0, len(a), 0, len(b))] if same else SequenceMatcher(None, keys_a, keys_b, autojunk=False).get_opcodes():
        if tag == "equal":
            for x, y in zip(a[i:j], b[k:n], strict=True):
                if x[0] == "#":
                    out.append(_joined_text(x, y, x[1] + y[1]))
                else:
                    out.append([x[0], x[1] + y[1], x[2] or y[2], aligned(x[3], y[3])])
        else:
            out += a[i:j] + b[k:n]
    return out if same else refolded(out)


def refolded(nodes: list) -> list:
    """Optional elements that came to stand next to their like are one repeated group."""
    out: list = []
    for node in nodes:
        if out and out[-1][0] == node[0]:
            last = out[-1]
            if node[0] == "#":
                out[-1] = _joined_text(last, node, max(last[1], node[1]))
            else:
                out[-1] = [node[0], max(last[1], node[1]), True, aligned(last[3], node[3])]
        else:
            out.append(node)
    return out


def pruned(nodes: list, least: float) -> list:
    """Without what fewer pages have; a text that goes leaves a slot's place to its neighbours."""
    return [x if x[0] == "#" else [x[0], x[1], x[2], pruned(x[3], least)] for x in nodes if x[1] >= least]


def merged(a: dict | None, b: dict) -> dict:
    """The wrapper of both; each time its pages double past 64, nodes that fewer than a 32nd of them have go.

    So a wrapper has a bounded number of optional nodes for each it needs, however many pages
    a host has; only nodes of most pages decide anything.
    """
    if a is None:
        return b
    n = a["n"] + b["n"]
    nodes = aligned(a["c"], b["c"])
    if n >= 64 and n.bit_length() > max(a["n"], b["n"]).bit_length():
        nodes = pruned(nodes, n / 32)
    return {"n": n, "c": nodes}


def expression(wrapper: dict) -> str:
    """The wrapper as a regular expression over tags: (..)+ repeated, (..)? optional, #PCDATA slots."""

    def show(nodes: list, n: int) -> str:
        parts = []
        for node in nodes:
            own = (node[2] if node[2] is not None else "#PCDATA") if node[0] == "#" else f"<{node[0]}>{show(node[3], node[1])}</{node[0]}>"
            many = node[0] != "#" and node[2]
            parts.append(f"({own}){'+' if many else ''}{'?' if node[1] < n else ''}" if node[1] < n or many else own)
        return "".join(parts)

    return show(wrapper["c"], wrapper["n"])


def template_texts(wrapper: dict, least: int = 3, share: float = 0.6) -> list[str]:
    """Texts that are constant over most of the host's pages, outside of articles."""
    out: list[str] = []

    def walk(nodes: list) -> None:
        for node in nodes:
            if node[0] == "#":
                if node[2] and node[1] >= max(least, share * wrapper["n"]):
                    out.append(node[2])
            elif node[0].split(".")[0] not in ("article", "main"):
                walk(node[3])

    walk(wrapper["c"])
    return sorted(set(out))


def _slots(nodes: list) -> int:
    """Characters of the slots, but for those of links and of elements left out."""
    total = 0
    for node in nodes:
        if node[0] == "#":
            total += node[3] if node[2] is None else 0
        else:
            name, _, label = node[0].partition(".")
            if name != "a" and not _boilerplate(name, "") and not (label and _named(name, f"class={label}")):
                total += _slots(node[3])
    return total


def main_region(wrapper: dict, least: int = 3, share: float = 0.6, most_of: float = 2 / 3) -> list[str]:
    """Keys from the root to the element whose slots hold the pages' main text; [] if none stands out.

    From the root, the way goes on to a child as long as that child alone holds two thirds
    of the slots' characters, is on most pages, isn't repeated and may hold blocks. It goes
    no further than an article or main.
    """
    path: list[str] = []
    nodes = wrapper["c"]
    if wrapper["n"] < least:
        return path
    while True:
        weights = [0 if x[0] == "#" else _slots([x]) for x in nodes]
        whole = sum(weights) + sum(x[3] for x in nodes if x[0] == "#" and x[2] is None)
        k = max(range(len(nodes)), key=weights.__getitem__, default=None)
        if k is None or not whole or weights[k] < most_of * whole:
            break
        key, pages, repeated, children = nodes[k]
        if repeated or key.partition(".")[0] not in _HOLDERS or pages < share * wrapper["n"] or sum(x[0] == key for x in nodes) > 1:
            break
        path.append(key)
        nodes = children
        if key.partition(".")[0] in _MARKED:
            break
    return path if path and path[-1].partition(".")[0] not in ("html", "body") else []


def _spans(events: _Events, region: Sequence[str]) -> list[tuple[int, int]]:
    """Where the region's elements stand on a page, and the headings that stand beside the way to them."""
    out: list[tuple[int, int]] = []
    titles = region[-1].partition(".")[0] not in _MARKED  # an article has its own
    stack: list[tuple[int, int]] = [(len(events.text) + 1, 0)]  # (end, how many keys of the way are behind; -1 off it)
    for at, name in enumerate(events.name):
        attrs, end = events.attrs[at], events.end.get(at)
        if attrs is None or end is None:
            continue
        while stack[-1][0] <= at:
            stack.pop()
        done = stack[-1][1]
        if done >= 0 and name in _TITLES and titles:
            out.append((at, end))
        if done < 0 or done == len(region) or _key(name, attrs) != region[done]:
            done = -1
        else:
            done += 1
            if done == len(region):
                out.append((at, end))
        stack.append((end, done))
    return out if any(events.name[a] not in _TITLES for a, _ in out) else []


def host_column(url: str):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1))


def wrappers(pages: DataFrame, url: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper as JSON): one row for each host."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        root = math.isqrt(context.partitionId()) if context else 0
        made: dict[str, dict] = {}
        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), filled(batch.column(1)).to_pylist(), strict=True):
                made[host] = merged(made.get(host), tree(page))
            if len(made) > MOST_HOSTS:
                yield out(made, root)
                made = {}
        yield out(made, root)

    def out(made: dict[str, dict], root: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(made), pa.string()), pa.array([json.dumps(w) for w in made.values()], pa.string()), pa.array([root] * len(made), pa.int32())], names=["host", "wrapper", "root"])

    def combine(key, table):
        whole = None
        for text in sorted(table.column("wrapper").to_pylist()):
            whole = merged(whole, json.loads(text))
        return pa.table({"host": pa.array([key[0].as_py()], pa.string()), "wrapper": pa.array([json.dumps(whole)], pa.string())})

    local = pages.select(host_column(url).alias("host"), F.col(html_col).alias("html")).mapInArrow(build, "host string, wrapper string, root int")
    some = local.groupBy("host", "root").applyInArrow(combine, "host string, wrapper string")
    return some.groupBy("host").applyInArrow(combine, "host string, wrapper string")


def templates(own: DataFrame) -> DataFrame:
    """(host, texts, region) of wrappers: the constant texts and the way to the main text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [json.loads(w) for w in batch.column(1).to_pylist()]
            of = lambda f: pa.array(list(map(f, made)), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), of(template_texts), of(main_region)], names=["host", "texts", "region"])

    return own.select("host", "wrapper").mapInArrow(run, "host string, texts array<string>, region array<string>")


def main_text(page: str, template: frozenset[str] | set[str] = frozenset(), region: Sequence[str] = ()) -> str:
    """The page's main text: the region that the wrapper chose, else marked articles, else the body without template texts."""
    found, where = blocks(page, region)
    if where == "body" and template:
        found = [b for b in found if b not in template] or found
    return "\n".join(found)


def extract(pages: DataFrame, broadcast_bytes: int = 32 << 20, id_col: str = "page_id", url: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    from gatemeter.llm.shared import Scratch

    known = Scratch(pages.sparkSession).cut(templates(wrappers(pages, url, html_col)))
    size = known.select(F.sum(F.length("host") + F.aggregate(F.concat("texts", "region"), F.lit(0), lambda s, t: s + F.length(t))).alias("n")).first()["n"] or 0
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url).alias("url"), F.col(html_col).alias("html"), host_column(url).alias("host"))
    both = rows.join(F.broadcast(known) if size <= broadcast_bytes else known, "host", "left").select("page_id", "url", "html", "texts", "region")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages_, texts, regions = filled(batch.column(2)), batch.column(3), batch.column(4)
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                made = [main_text(pages_[k].as_py(), set(texts[k].as_py() or ()), regions[k].as_py() or ()) for k in range(i, i + part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(made, pa.string()), pa.array([len(t) for t in made], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return both.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")


def query(pages: DataFrame) -> DataFrame:
    return extract(pages)
