"""Main text of web pages through wrappers inferred by union-free regular expressions.

Pages of one host come from one template. A wrapper describes that template as a regular expression
without unions over tags and texts: sequences, optional parts, repeated groups, fixed text and text
slots. It grows page by page: the levels of two token streams are aligned by their likest common run,
where nodes that share a text are liker than nodes that share a tag. What one side lacks becomes
optional; neighbours of which some pages show fewer become a repeated group; differing text becomes a
slot. Every node counts the pages that show it and every text the pages that agree on it, so an odd
page changes little; parts that hardly any page shows are forgotten, so a wrapper follows the template
and not the pages. Wrappers are built where pages lie and merged twice, by host and a salt and then
by host, so a host with a third of all pages sends one small wrapper per task and never its pages.

A page is then read along its host's wrapper. The article (else the main part, else the body) is
kept without menus, headers, footers, sidebars, notices, adverts, forms, scripts and comments, as far as
tags, roles and class names tell them. Text on which `FIXED_SHARE` of the host's pages agree, of which
three or more differ, belongs to the template and goes, in articles as elsewhere: where a site has no
telling tags, the wrapper alone decides. Slots stay, and so does all text in parts that fewer pages
show. An article that is template by half or more of its words is a near copy of the others rather than
made from one template with them, and stays whole.

Nulls and special cases: null html is empty and gives an empty text; pages with a null or odd url have
no host and no wrapper; repeated rows are read alike, and copies of one page are no evidence of a
template; tags nested deeper than `DEPTH` stay on one level, with their text, but articles, main parts
and left-out elements hold theirs at any depth. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache, reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from servicelens.llm.common import durable, only, sliced

DEPTH = 150
FIXED_PAGES = 3                 # different pages that must agree before fixed text counts as template
FIXED_SHARE = 0.7               # of a host's pages; text of 85 in 100 always reaches it, of 70 or fewer never
RARE_PAGES = 20                 # pages from which on rare parts are forgotten
RARE_SHARE = 0.1
LONG_LEVEL = 40_000             # pairs of nodes from which on neighbours are folded before they are compared
BROADCAST_BYTES = 32_000_000
HELD_HOSTS = 500                # of a task at a time, each with a wrapper and up to `HELD_PAGES` pages
HELD_PAGES = 8
SALTS = 32

# Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg textarea title select option object "
                "canvas audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark "
                   "q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math mi mn mo ms mtext "
                   "mrow msub msup msubsup mfrac msqrt mroot munder mover munderover mfenced mspace".split())
LEFT_OUT = frozenset("head nav header footer aside form button menu dialog input".split()) | RAW
UNBROKEN = INLINE | RAW | {"button", "input"}           # left out without ending a block
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu "
                  "menubar toolbar".split())
MARKS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion "
                  "banner sidebar aside menu nav navbar navigation breadcrumb breadcrumbs header masthead "
                  "footer cookie cookies consent notice notices gdpr newsletter subscribe signup share "
                  "sharing social related comment comments commentlist reply replies respond disqus popup "
                  "modal overlay widget toolbar pagination pager login teaser teasers".split())
TITLE_MARKS = frozenset("header banner masthead".split())       # with these a title can be meant
FILLERS = frozenset("slot box wrap wrapper container block list bar area section top bottom left right site page "
                    "global main form link links button buttons icon icons unit inner outer item items label row "
                    "XX".split())
CONTENT_WORDS = frozenset("post posts article articles entry story stories news blog user reader content".split())
WHOLE = frozenset("html body main".split())             # never left out for their class alone
CLOSES = {                      # start tag: open elements that it ends
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 "
                   "h5 h6 header hr main menu nav ol p pre section table ul".split())
BARRIERS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"},
            "th": {"table"}}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|itemprop|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?",
                        re.I)
_ATTRIBUTE_START = re.compile(r"(?:^|[\s\"'/])(?=(?:class|id|role|hidden)\b)", re.I)
_PART = re.compile(r"[^a-z0-9]+")


@lru_cache(4096)
def is_mark(token: str) -> bool:
    """Whether a class or id names a part that is no article: a mark by itself, or a mark first or last
    beside words of layout (`ad-slot`) or, unless a title can be meant, of content (`post-comments`)."""
    parts = [p for p in _PART.split(token) if p and not p.isdigit()]
    if not parts or not (parts[0] in MARKS or parts[-1] in MARKS):
        return False
    others = [p for p in parts if p not in MARKS]
    if all(p in FILLERS for p in others):
        return True
    titled = any(p in TITLE_MARKS for p in parts)
    return not titled and all(p in FILLERS or p in CONTENT_WORDS for p in others)


@lru_cache(4096)
def signature(tag: str, attributes: str) -> str:
    """The tag, with `!` in front if the element is no part of an article."""
    if tag in LEFT_OUT:
        return f"!{tag}"
    if tag in WHOLE:
        return tag
    for start in _ATTRIBUTE_START.finditer(attributes):
        found = _ATTRIBUTE.match(attributes, start.end())
        if not found:
            continue
        name = found[1].lower()
        value = next((v for v in found.groups()[1:] if v is not None), "").lower()
        if name == "hidden" or name == "role" and value.strip() in ROLES:
            return f"!{tag}"
        if name in ("class", "id"):
            tokens = value.split()
            if any(t in MARKS for t in tokens) if tag == "article" else any(map(is_mark, tokens)):
                return f"!{tag}"
        if name == "role" and value.strip() in ("main", "article"):
            return value.strip()
    return tag


def parse(page: str) -> list:
    """The page as a tree: an element is [signature, children], a text is a string."""
    root: list = ["", []]
    stack, tags, at = [root], [""], 0
    places: dict[str, list[int]] = {}               # where the open elements of each tag stand
    deep: dict[str, int] = {}                       # the same of regions beyond `DEPTH`
    scan = _TOKEN.match
    find = page.find

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            name, inner = stack.pop()
            places[tags.pop()].pop()
            if len(stack) >= DEPTH:
                if inner is not stack[-1][1]:
                    deep.pop(name, None)
                elif name not in INLINE and name[0] != "!":
                    inner.append([name, []])        # the end of a block on the same level

    def last(names: set) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=0)

    def close_open(names: set, barriers: set) -> None:
        depth = last(names)
        if depth > last(barriers):
            pop_to(depth)

    size = len(page)
    while at < size:
        start = find("<", at)
        if start < 0:
            start = size
        if start > at:
            stack[-1][1].append(page[at:start])
        if start == size:
            break
        token = scan(page, start)
        if not token:                               # a lone "<" is text
            stack[-1][1].append("<")
            at = start + 1
            continue
        at = token.end()
        tag = (token[2] or token[5] or "").lower()
        if not tag:
            continue
        if token[1] or token[4]:
            if places.get(tag):
                pop_to(places[tag][-1])
            elif tag in ("p", "br"):
                stack[-1][1].append(["br", []])
            continue
        attributes = token[3] if token[2] else token[6] or ""
        if tag in ("script", "style", "textarea", "title", "noscript", "iframe"):
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else size
            stack[-1][1].append([f"!{tag}", []])
            continue
        if tag in ENDS_P:
            close_open({"p"}, {"table", "td", "th", "button", "article", "div", "section", "li", "body"})
        if tag in CLOSES:
            close_open(CLOSES[tag], BARRIERS.get(tag, set()))
        name = signature(tag, attributes)
        if name == "!header" and tag == "header" and places.get("article") and not any(
                x[0].startswith("!") for x in stack):
            name = "header"                         # the heading of an article belongs to it
        element = [name, []]
        above, level = stack[-1]
        level.append(element)
        if tag not in VOID and not attributes.endswith("/"):
            if len(stack) >= DEPTH:                 # a level of its own only where the reader needs it
                if above.startswith("!"):
                    element = [above, level]
                elif name in ("article", "main") and name not in deep:
                    deep[name] = len(stack)
                elif not name.startswith("!"):
                    element = [name, level]
            places.setdefault(tag, []).append(len(stack))
            stack.append(element)
            tags.append(tag)
    return root


# A wrapper node is [name, pages that show it, repeated, children]; a text is ["#", pages, digest, pages that
# agree on it] with digest "" for a slot; a group of several nodes that repeat has the name "(a b)".

def _digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def _lead(node: list) -> tuple[str, int]:
    """The first text of a node and how many pages agree on it; ("", 0) for a slot or none."""
    while node[0] != "#":
        if not node[3]:
            return "", 0
        node = node[3][0]
    return node[2], node[3]


def _same(a: list, b: list, one_page: bool = False) -> list:
    """Two nodes of one name as one. Nodes of different pages add up, those of one page do not.

    Where texts differ, the pages that hold another text count against the more frequent one, so one
    odd page does not turn a template's text into a slot.
    """
    pages = max(a[1], b[1]) if one_page else a[1] + b[1]
    if a[0] != "#":
        return [a[0], pages, a[2] or b[2], align(a[3], b[3], a[1], b[1], one_page)]
    if a[2] == b[2]:
        return ["#", pages, a[2], max(a[3], b[3]) if one_page else a[3] + b[3]]
    kept = max(a, b, key=lambda n: n[3])
    left = abs(a[3] - b[3])
    return ["#", pages, kept[2] if left else "", left]


def _repeated(a: list, b: list) -> list:
    """Two neighbours as one repeated node."""
    node = _same(a, b, True)
    return [node[0], node[1], True, node[3]]


def _likeness(a: list, b: list) -> int:
    """0: not to be matched; more if the texts agree. Text that pages agree on is no slot for another."""
    if a[0] != b[0]:
        return 0
    (x, n), (y, m) = _lead(a), _lead(b)
    if x and x == y:
        return 3
    return 0 if max(n, m) >= FIXED_PAGES else 1


def _foldable(node: list, pages: int) -> bool:
    return node[0] != "#" and not (_lead(node)[1] >= max(2, FIXED_SHARE * pages))


def fold(nodes: list, pages: int) -> list:
    """Neighbours, or runs of two or three nodes, of one structure become one repeated node or group.

    The evidence of a repetition is that some pages show one and some both, or that one is repeated
    already. Text that the pages agree on is not folded.
    """
    def more(run: list, other: list) -> bool:
        missing = [all(n[1] < pages for n in r) for r in (run, other)]
        return missing[0] != missing[1] or any(n[2] is True for n in run + other)

    done: list = []
    for node in nodes:
        if (done and done[-1][0] == node[0] and _foldable(node, pages) and _foldable(done[-1], pages)
                and more([done[-1]], [node])):
            done[-1] = _repeated(done[-1], node)
        else:
            done.append(node)
    for period in (2, 3):
        at = 0
        while at + 2 * period <= len(done):
            one, two = done[at:at + period], done[at + period:at + 2 * period]
            body = [n[0] for n in one]
            if (body != [n[0] for n in two] or "#" in body or any(x.startswith("(") for x in body)
                    or not all(_foldable(n, pages) for n in one + two) or not more(one, two)):
                at += 1
                continue
            group = [_same(x, y, True) for x, y in zip(one, two)]
            done[at:at + 2 * period] = [[f"({' '.join(body)})", max(n[1] for n in group), True, group]]
            while [n[0] for n in done[at + 1:at + 1 + period]] == body:
                done[at][3] = [_same(x, y, True) for x, y in zip(done[at][3], done[at + 1:at + 1 + period])]
                del done[at + 1:at + 1 + period]
            at += 1
    return done


def _grouped(nodes: list, other: list) -> list:
    """Runs that the other side knows as a repeated group become a group here, too."""
    for name in {n[0] for n in other if n[0].startswith("(")} - {n[0] for n in nodes}:
        body, done, at = name[1:-1].split(" "), [], 0
        while at < len(nodes):
            run = nodes[at:at + len(body)]
            if [n[0] for n in run] != body:
                done.append(nodes[at])
                at += 1
                continue
            if done and done[-1][0] == name:
                done[-1][3] = [_same(x, y, True) for x, y in zip(done[-1][3], run)]
            else:
                done.append([name, max(n[1] for n in run), True, run])
            at += len(body)
        nodes = done
    return nodes


def _squeezed(nodes: list) -> list:
    """All neighbours of one name as one: how very long levels are compared."""
    done: list = []
    for node in nodes:
        if done and node[0] != "#" and done[-1][0] == node[0]:
            done[-1] = _repeated(done[-1], node)
        else:
            done.append(node)
    return done


def align(a: list, b: list, pages_a: int, pages_b: int, one_page: bool = False) -> list:
    """Two levels, of so many pages, as one: the likest common run of nodes is merged, the rest is
    optional, as fewer pages show it than there are."""
    if [n[0] for n in a] == [n[0] for n in b]:
        return [_same(x, y, one_page) for x, y in zip(a, b)]
    pages = max(pages_a, pages_b) if one_page else pages_a + pages_b
    a, b = _grouped(a, b), _grouped(b, a)
    if len(a) * len(b) > LONG_LEVEL:
        a, b = _squeezed(a), _squeezed(b)
    like = [[_likeness(x, y) for y in b] for x in a]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        row, below, own = best[i], best[i + 1], like[i]
        for j in range(len(b) - 1, -1, -1):
            row[j] = max(below[j], row[j + 1], below[j + 1] + own[j])
    done, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and like[i][j] and best[i][j] == best[i + 1][j + 1] + like[i][j]:
            done.append(_same(a[i], b[j], one_page))
            i, j = i + 1, j + 1
        elif i == len(a) or j < len(b) and best[i][j + 1] >= best[i + 1][j]:
            done.append(b[j])
            j += 1
        else:
            done.append(a[i])
            i += 1
    return fold(done, pages)


def pruned(nodes: list, pages: int) -> list:
    """Without the parts that fewer than `RARE_SHARE` of the pages show: as these parts' pages add up
    to all pages' nodes at most, a wrapper is no larger than 1 / RARE_SHARE average pages."""
    if pages < RARE_PAGES:
        return nodes
    return [n if n[0] == "#" else [n[0], n[1], n[2], pruned(n[3], pages)]
            for n in nodes if n[1] >= RARE_SHARE * pages]


def _parts(children: list) -> Iterator[list | tuple]:
    """The children in order; neighbouring texts and inline elements are one tuple."""
    run: list = []
    for child in children:
        if isinstance(child, str) or child[0] in INLINE or child[0] == "br":
            run.append(child)
            continue
        if run:
            yield tuple(run)
            run = []
        yield child
    if run:
        yield tuple(run)


def _inner(children: list | tuple) -> str:
    return "".join(c if isinstance(c, str) else " " if c[0] == "br" else _inner(c[1]) for c in children)


def _words(run: tuple) -> str:
    return " ".join(_inner(run).split())


def page_wrapper(tree: list) -> list:
    """The children of a page's tree as a wrapper of that page alone; inline elements are text."""
    nodes: list = []
    for part in _parts(tree[1]):
        if isinstance(part, tuple):
            if text := _words(part):
                nodes.append(["#", 1, _digest(text), 1])
        else:
            nodes.append([part[0], 1, False, [] if part[0].startswith("!") else page_wrapper(part)])
    return nodes


def _has(tree: list, name: str) -> bool:
    return any(not isinstance(c, str) and not c[0].startswith("!") and (c[0] == name or _has(c, name))
               for c in tree[1])


def compiled(nodes: list, pages: int) -> list:
    """The parts of a wrapper that matter for reading: (name, repeated, fixed text or "", children).

    Levels without fixed text are empty. A text is fixed if nearly all pages agree on it.
    """
    least = max(FIXED_PAGES, FIXED_SHARE * pages)
    done, fixed = [], False
    for node in nodes:
        if node[0] == "#":
            text = node[2] if node[3] >= least else ""
            done.append(("#", False, text, []))
            fixed |= bool(text)
            continue
        inner = compiled(node[3], pages)
        fixed |= bool(inner)
        if node[0].startswith("("):
            done += [(name, True, text, level) for name, _, text, level in inner]
        else:
            done.append((node[0], node[2], "", inner))
    return done if fixed else []


def _first_fixed(node: tuple) -> str:
    while node[0] != "#":
        if not node[3]:
            return ""
        node = node[3][0]
    return node[2]


def _first_text(part: list | tuple) -> str:
    while not isinstance(part, tuple):
        part = next((p for p in _parts(part[1]) if not isinstance(p, tuple) or _inner(p).strip()), ())
    return _digest(_words(part)) if part else ""


def matched(parts: list, nodes: list) -> list:
    """For each part of a page's level its node of the wrapper, or None: the likest common run again.

    A repeated node takes any number of parts; a node whose first text is fixed takes no other text.
    """
    names = [("#" if isinstance(p, tuple) else p[0]) for p in parts]
    firsts = [_first_text(p) if any(n[0] == name and _first_fixed(n) for n in nodes) else ""
              for p, name in zip(parts, names)]
    like = [[0 if name != n[0] else 1 if not (x := _first_fixed(n)) else 3 if x == first else 0 for n in nodes]
            for name, first in zip(names, firsts)]
    wide = len(nodes)
    best = [[0] * (wide + 1) for _ in range(len(parts) + 1)]
    for i in range(len(parts) - 1, -1, -1):
        for j in range(wide - 1, -1, -1):
            after = best[i + 1][j if nodes[j][1] else j + 1]
            best[i][j] = max(best[i + 1][j], best[i][j + 1], like[i][j] and after + like[i][j])
    found: list = [None] * len(parts)
    i = j = 0
    while i < len(parts) and j < wide:
        after = best[i + 1][j if nodes[j][1] else j + 1]
        if like[i][j] and best[i][j] == after + like[i][j]:
            found[i] = nodes[j]
            i, j = i + 1, j if nodes[j][1] else j + 1
        elif best[i][j] == best[i][j + 1]:
            j += 1
        else:
            i += 1
    return found


def _read(tree: list, wrapper: list, inside: bool, region: str, out: list[str], gone: list[str]) -> None:
    """Append the texts of a tree; `\n` stands between blocks. `wrapper` is the compiled level beside it.

    Template texts are appended to `gone`.
    """
    parts = [p for p in _parts(tree[1]) if not wrapper or not isinstance(p, tuple) or _inner(p).strip()]
    nodes = matched(parts, wrapper) if wrapper else [None] * len(parts)
    for part, node in zip(parts, nodes):
        if isinstance(part, tuple):
            if inside and node and node[2] and node[2] == _digest(text := _words(part)):
                gone.append(text)
            elif inside:
                for child in part:
                    if isinstance(child, str):
                        out.append(html.unescape(child).replace("\n", " "))
                    elif child[0] == "br":
                        out.append(" ")
                    else:
                        _read(child, [], inside, region, out, gone)
        elif part[0].startswith("!"):
            if part[0][1:] not in UNBROKEN:
                out.append("\n")
        else:
            out.append("\n")
            _read(part, node[3] if node else [], inside or part[0] == region, region, out, gone)
            out.append("\n")


def _joined(out: list[str]) -> str:
    blocks = (" ".join(b.split()) for b in "".join(out).split("\n"))
    return " ".join(b for b in blocks if b)


def _text(tree: list, wrapper: Sequence = ()) -> str:
    region = next((r for r in ("article", "main") if _has(tree, r)), "")
    out: list[str] = []
    gone: list[str] = []
    _read(tree, list(wrapper), not region, region, out, gone)
    text = _joined(out)
    if region and gone and sum(len(g.split()) for g in gone) >= len(text.split()):
        return _text(tree)
    return text


def reader(wrapper: Sequence) -> list:
    """The compiled form of [pages, nodes, digests of some of the pages' texts]; empty where different
    pages are too few to tell a template from copies."""
    pages, nodes, texts = wrapper
    return compiled(nodes, pages) if pages >= FIXED_PAGES and len(texts) >= FIXED_PAGES else []


def main_text(page: str | None, wrapper: Sequence | None = None) -> str:
    """The article of a page, blocks joined by one blank.

    `wrapper`: pages it is made of, nodes, and digests of some of their texts, if these are known.
    """
    return _text(parse(page or ""), reader(wrapper) if wrapper else ())


def merged(a: list, b: list) -> list:
    """Two wrappers of a host as one."""
    pages = a[0] + b[0]
    return [pages, pruned(align(a[1], b[1], a[0], b[0]), pages), sorted({*a[2], *b[2]})[:FIXED_PAGES]]


def _digests(nodes: list) -> Iterator[str]:
    for node in nodes:
        if node[0] == "#":
            yield node[2]
        else:
            yield from _digests(node[3])


def merged_all(wrappers: Sequence[list]) -> list:
    """Wrappers of a host as one: large ones first, then those that share most texts with the others,
    so that an odd page meets a template that others have shaped."""
    texts = [set(_digests(w[1])) - {""} for w in wrappers]
    shared = Counter(t for of in texts for t in of)
    order = sorted(range(len(wrappers)), key=lambda i: (-wrappers[i][0], -sum(shared[t] - 1 for t in texts[i]), i))
    return reduce(merged, (wrappers[i] for i in order))


def with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")),
                                    r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return only(pages, "page_id", "url", "html").withColumn("host", host)


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper): one row per host, the wrapper as JSON of the page count, the nodes and digests
    of `FIXED_PAGES` different texts, or of all if they are fewer: copies are no evidence of a template.
    """
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[list]] = {}

        def flush() -> pa.RecordBatch:
            rows = [(h, json.dumps(merged_all(w))) for h, w in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string())
                                               for i in (0, 1)], ["host", "wrapper"])

        for batch in sliced(batches):
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                tree = parse(page or "")
                known = held.setdefault(host, [])
                enough = known and len(known[0][2]) >= FIXED_PAGES
                known.append([1, page_wrapper(tree), [] if enough else [_digest(_text(tree))]])
                if len(known) > HELD_PAGES:
                    held[host] = [merged_all(known)]
                if len(held) > HELD_HOSTS:
                    yield flush()
        yield flush()

    def united(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": frame["host"].iloc[:1], "wrapper": [json.dumps(merged_all([json.loads(w) for w in frame["wrapper"]]))]})

    parts = (with_host(pages).select("host", "html").where("host <> ''").mapInArrow(local, "host string, wrapper string")
             .withColumn("salt", F.spark_partition_id() % SALTS))
    halfway = parts.groupBy("host", "salt").applyInPandas(united, "host string, wrapper string")
    return durable(halfway.groupBy("host").applyInPandas(united, "host string, wrapper string"))


def extract(pages: DataFrame, wrappers: DataFrame | None = None) -> DataFrame:
    """page_id, url and text (never null) for every page."""
    found = infer_wrappers(pages) if wrappers is None else wrappers
    size = found.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host"))).first()[0] or 0
    found = found.withColumnRenamed("host", "wrapper_host")
    found = F.broadcast(found) if size <= BROADCAST_BYTES else found
    rows = with_host(pages)
    joined = rows.join(found, rows.host == found.wrapper_host, "left").select(
        F.col("page_id").cast("long"), "url", "html", "wrapper")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = lru_cache(256)(lambda text: reader(json.loads(text)))
        for batch in sliced(batches):
            texts = [_text(parse(page or ""), loaded(w) if w else ()) for page, w in
                     zip(batch.column("html").to_pylist(), batch.column("wrapper").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())],
                ["page_id", "url", "text"])

    return joined.mapInArrow(read, "page_id bigint, url string, text string")
