"""Main text of web pages through wrappers: union-free regular expressions inferred per host.

A page is a stream of block tags and text slots. Its structure is a tree whose nodes are tags with their class and id words;
siblings that repeat, one tag or a run of up to ``RUN`` different ones, are aligned with each other and become one
repeated group. A host's wrapper comes of aligning its pages' structures one after another: matching tags are merged, tags
that only one side has become optional groups, runs that the other side repeats join its group, and where texts differ
the slot is a text slot, otherwise it holds the host's constant text. Such a wrapper is a union-free regular expression:
tags, repeats, optional groups and text slots, without alternatives.

Every slot of a page is looked up in its host's wrapper, which decides:
- text that is constant on ``CONSTANT_PAGES`` distinct pages or more, and on ``SHARE`` or more of the host's, goes, but inside
  article and main what names variable text there stays: a heading, a term or a table's head that stands right before it, and
  a plain block with variable blocks of the same parent on both sides;
- blocks of links in repeated groups that are links for the most part go; inside article and main only if so many
  of the host's pages have the group, and not if it has no class or id, or one that says references, and variable text precedes it;
- menus, headers, footers, sidebars, forms and what is hidden go, by tag and role; adverts, notices, comments and the like by
  words of class, id and role, unless the wrapper shows the element to be the host's body: over half of its variable
  text, not a repeated group of elements. Words that are subjects of articles too (``_TOPICS``, and inside article and main ``_LOOSE`` unless one
  is a whole class or id) count only where the wrapper shows the element to be constant, to be links for the most part, or to
  repeat a group of elements; so does a word that has one of ``_REMARKS`` in it, in the last of these cases;
- where a page has an article or main element, only slots in there are left. If all would go as constant, it stays.
Pages of equal html or equal slots are one page of their host here. Blocks keep the page's order; nothing is cut.

Scale: pages meet in their own task first, so a host has one small structure per task, whatever its pages; these are
aligned by host in two steps, ``FAN`` parts first, so that no task gets a hot host's pages. A structure is bounded: a node
with more than ``WIDTH`` kinds of children forgets their classes and ids, as the whole does beyond ``NODES`` nodes; elements
below ``DEPTH`` levels count as their ancestor's there. That makes a wrapper coarser; texts stay whole. Wrappers join the pages
by host, broadcast if their measured size is small.

Null html is empty and gives empty text. A null or unusable url has no host: its page is its own wrapper, without
constants, and outside article and main every block of links goes. Repeated rows, null page_ids and cut-off pages are read as they are: an open tag at the end is markup, an open
element ends there. Very long and very deep pages are read whole. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.llm._shared import Scratch

CONSTANT_PAGES, SHARE, FAN = 3, 0.5, 64
RUN, WIDTH, NODES, DEPTH = 4, 64, 4096, 48

# Names of HTML elements, and words of classes, ids and roles.
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base basefont br col embed frame hr img input keygen link meta param source track wbr".split())
_DROPPED = frozenset("applet audio button canvas datalist head iframe math noembed noframes noscript object option optgroup script select style svg template textarea title video".split())
_RAW = frozenset("script style textarea title noscript iframe noframes noembed template svg math".split())
_ASIDE = frozenset("aside nav footer form menu dialog search".split())
_PARTS = frozenset("ad ads adbox adsense advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr masthead menu modal nav navbar newsletter notification overlay pagination paywall popup promo promoted replies respond share sharing sidebar skip sponsor sponsored subscribe toolbar topbar widget widgets".split())
_TOPICS = frozenset("advertising copyright disclaimer discussion feedback legal navigation notice promotion recommended related reply social subscription".split())
_LOOSE = frozenset("banner comment comments consent cookie cookies menu modal notification overlay replies respond share sharing skip toolbar widget".split())
_REMARKS = ("comment", "discussion", "reaction", "remark", "replies", "reply", "response")
_SOURCES = frozenset("bibliography citation citations footnotes literature reference references refs source sources".split())
_LABELS = frozenset("caption dt figcaption h1 h2 h3 h4 h5 h6 legend summary th".split())
_PLAIN = frozenset("blockquote dd li p pre td".split())
_ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())
_ENDS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}}
_SCOPES = {"li": {"ul", "ol", "menu", "dir"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>"']|"[^"<]*"|'[^'<]*'|["'])*)(?:>|(?=<)|\Z)|</[^>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PIECES = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Slot:
    """One block's text: its path of keys, whether tags show it to stand apart from the main text, and how much of it is links."""

    __slots__ = ("path", "apart", "article", "text", "linked")

    def __init__(self, path: tuple[str, ...], apart: bool, article: bool, text: str, linked: int):
        self.path, self.apart, self.article, self.text, self.linked = path, apart, article, text, linked


def _described(tag: str, raw: str, in_article: bool) -> tuple[str, bool, bool]:
    """A tag's key in the wrapper, whether tag, role or state set apart what it holds, and whether it is the main text by role."""
    key, apart, main = tag, tag in _ASIDE or (tag == "header" and not in_article), tag in ("article", "main")
    if "=" in raw or "hidden" in raw:
        for name, *values in _ATTRIBUTE.findall(raw):
            name = name.lower()
            if name == "hidden":
                apart = True
            elif name in ("class", "id", "role"):
                value = next((v for v in values if v), "")
                if name == "role":
                    value = value.strip().lower()
                    apart, main = apart or value in _ROLES, main or value == "main"
                else:
                    names = ("-".join(_PIECES.findall(_CAMEL.sub(" ", x).lower())) for x in value.split())
                    found = "_".join(x for x in names if x)
                    if found:
                        key += ("." if name == "class" else "#") + found
    return key, apart, main


def _tag(key: str) -> str:
    return re.split("[.#]", key)[0]


def _words(key: str, article: bool) -> tuple[set[str], set[str]]:
    """Words of a key that speak against it, and further words that need evidence; a page's outermost elements and its main text are not judged by theirs."""
    tag, *names = re.split("[.#_]", key)
    if tag in ("html", "body", "article", "main"):
        return set(), set()
    words = {w for x in names for w in x.split("-")}
    strong = {w for w in words & _PARTS if not article or w not in _LOOSE or w in names}
    return strong, words - strong


def _clean(pieces: list[str]) -> str:
    text = "".join(pieces)
    return " ".join((html.unescape(text) if "&" in text else text).split())


def slots(page: str) -> list[Slot]:
    """The page's texts by block, in order. Follows the rules by which browsers close what authors leave open."""
    out: list[Slot] = []
    stack: list[tuple[str, str, bool, bool]] = []  # tag, key, apart, article
    pieces: list[str] = []
    linked: list[str] = []
    link = 0

    def flush() -> None:
        nonlocal link
        if pieces:
            text = _clean(pieces)
            if text:
                _, _, apart, article = stack[-1] if stack else ("", "", False, False)
                out.append(Slot(tuple(x[1] for x in stack[:DEPTH]), apart, article, text, len(_clean(linked))))
            pieces.clear()
            linked.clear()
        link = 0

    def say(text: str) -> None:
        if text:
            pieces.append(text)
            if link:
                linked.append(text)

    at, n = 0, len(page)
    while at < n:
        open_ = page.find("<", at)
        if open_ < 0:
            say(page[at:])
            break
        if open_ > at:
            say(page[at:open_])
        m = _TOKEN.match(page, open_)
        if not m:
            say("<")
            at = open_ + 1
            continue
        at = m.end()
        tag = m[2].lower() if m[2] else ""
        if not tag:
            continue
        if m[1]:
            if tag == "a":
                link = 0
            elif tag in _BLOCKS:
                depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), -1)
                if depth >= 0 or tag == "p":
                    flush()
                if depth >= 0:
                    del stack[depth:]
            continue
        if tag in _DROPPED:
            if tag not in _VOID and not m[3].endswith("/"):
                at = _after(page, at, tag)
            say(" ")
            continue
        if tag == "a":
            link = 1
        elif tag == "br" or tag == "img":
            say(" ")
        if tag not in _BLOCKS:
            continue
        flush()
        if tag == "hr":
            continue
        if stack and stack[-1][0] == "p":
            stack.pop()
        ends = _ENDS.get(tag)
        if ends:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ends:
                    del stack[k:]
                elif stack[k][0] in _SCOPES[tag]:
                    break
        above = stack[-1] if stack else ("", "", False, False)
        key, apart, main = _described(tag, m[3], above[3])
        stack.append((tag, key, apart or above[2], above[3] or main))
    flush()
    return out


def _after(page: str, at: int, tag: str) -> int:
    """Where the content of an element that is dropped whole ends."""
    if tag == "head":
        m = re.compile(r"</head\s*>|(?=<body\b)", re.I).search(page, at)
    elif tag in _RAW:
        m = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
    else:
        m = re.compile(rf"</{tag}\s*>|(?=<(?:/?(?:{'|'.join(sorted(_BLOCKS))}))\b)", re.I).search(page, at)
    return m.end() if m else len(page)


# A wrapper's node is [key, pages, repeated, optional, text, letters, linked, children]. text: None, a constant's hash, or "*".
# The key of a group of several tags is "(" and theirs.


def _node(key: str) -> list:
    return [key, 1, False, False, None, 0, 0, []]


def structure(found: list[Slot]) -> list:
    """A page's slots as a tree; siblings that repeat, alone or as a run, are one repeated group."""
    root = _node("")
    trail, last = [root], ()
    for slot in found:
        common = 0
        while common < min(len(last), len(slot.path)) and last[common] == slot.path[common]:
            common += 1
        if common == len(slot.path) and common:
            common -= 1  # another element of the same path
        del trail[common + 1 :]
        for key in slot.path[common:]:
            children = trail[-1][7]
            if children and children[-1][0] == key:
                children[-1][2] = True
            else:
                children.append(_node(key))
            trail.append(children[-1])
        last = slot.path
        here = trail[-1]
        mark = xxhash.xxh3_64_hexdigest(slot.text)
        here[4] = mark if here[4] is None else here[4] if here[4] == mark else "*"
        here[5] += len(slot.text)
        here[6] += len(slot.text) if slot.apart else slot.linked
    order = [root]
    for node in order:
        order += node[7]
    for node in reversed(order):
        node[7] = _folded(node[7])
    return _bounded(root)


def _keys(nodes: list[list]) -> list[str]:
    return [k[0] for k in nodes]


def _folded(kids: list[list]) -> list[list]:
    """Children of one element with their repeats aligned: one tag, or a run of several, becomes a repeated group."""
    out: list[list] = []
    for k in kids:
        if out and out[-1][0] == k[0]:
            out[-1] = align(out[-1], k, same=True)
            out[-1][2] = True
        else:
            out.append(k)
    for n in range(2, RUN + 1):
        i = 0
        while i + 2 * n <= len(out):
            keys = _keys(out[i : i + n])
            if keys == _keys(out[i + n : i + 2 * n]):
                group = _group(out[i : i + n])
                while _keys(out[i + n : i + 2 * n]) == keys:
                    group = align(group, _group(out[i + n : i + 2 * n]), same=True)
                    del out[i + n : i + 2 * n]
                group[2] = True
                out[i : i + n] = [group]
            i += 1
    return _general(out) if len(out) > WIDTH else out


def _group(nodes: list[list]) -> list:
    """One turn of a group of several tags."""
    return ["(" + " ".join(_keys(nodes)) + ")", max(k[1] for k in nodes), False, False, None, 0, 0, nodes]


def _met(nodes: list[list], groups: list[list]) -> list[list]:
    """``nodes`` with each run that is a turn of one of the other side's groups made that group."""
    for g in groups:
        keys, i = _keys(g[7]), 0
        while g[0] not in _keys(nodes) and i + len(keys) <= len(nodes):
            if _keys(nodes[i : i + len(keys)]) == keys:
                nodes = [*nodes[:i], _group(nodes[i : i + len(keys)]), *nodes[i + len(keys) :]]
            i += 1
    return nodes


def _general(kids: list[list]) -> list[list]:
    """Children by tag alone, each once."""
    out: dict[str, list] = {}
    waiting = kids[::-1]
    while waiting:
        k = waiting.pop()
        if k[0].startswith("("):
            waiting += k[7][::-1]
            continue
        tag = _tag(k[0])
        k = [tag, *k[1:]]
        if tag in out:
            out[tag] = align(out[tag], k, same=True)
            out[tag][2] = True
        else:
            out[tag] = k
    return list(out.values())


def _bounded(wrapper: list) -> list:
    """The same expression, coarser if it has more than ``NODES`` nodes: without classes and ids, then without depth."""
    depth = 2 * DEPTH
    while True:
        levels = [[wrapper]]
        while levels[-1]:
            levels.append([k for node in levels[-1] for k in node[7]])
        if sum(map(len, levels)) <= NODES:
            return wrapper
        for level in reversed(levels[:depth]):
            for node in level:
                node[7] = _general(node[7])
        for node in levels[depth] if depth < len(levels) else ():
            order = [node]
            for k in order:
                order += k[7]
            node[4] = next((k[4] for k in order if k[4] is not None), None) if len({k[4] for k in order} - {None}) < 2 else "*"
            node[5:] = sum(k[5] for k in order), sum(k[6] for k in order), []
        depth //= 2


def align(a: list, b: list, same: bool = False) -> list:
    """The union-free expression of both: merges what matches, in order; what only one has is optional. ``same``: turns of one page's group."""
    text = b[4] if a[4] is None else a[4] if b[4] is None or a[4] == b[4] else "*"
    out = [a[0], max(a[1], b[1]) if same else a[1] + b[1], a[2] or b[2], a[3] or b[3], text, a[5] + b[5], a[6] + b[6], []]
    x, y = a[7], b[7]
    if _keys(x) == _keys(y):
        out[7] = [align(p, q, same) for p, q in zip(x, y, strict=True)]
        return out
    x, y = _met(x, [k for k in y if k[0].startswith("(")]), _met(y, [k for k in x if k[0].startswith("(")])
    kids: list[list] = []
    i = j = 0
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for p in range(len(x) - 1, -1, -1):
        for q in range(len(y) - 1, -1, -1):
            best[p][q] = best[p + 1][q + 1] + 1 if x[p][0] == y[q][0] else max(best[p + 1][q], best[p][q + 1])
    while i < len(x) and j < len(y):
        if x[i][0] == y[j][0]:
            kids.append(align(x[i], y[j], same))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            kids.append([*x[i][:3], True, *x[i][4:]])
            i += 1
        else:
            kids.append([*y[j][:3], True, *y[j][4:]])
            j += 1
    kids += [[*k[:3], True, *k[4:]] for k in x[i:] + y[j:]]
    out[7] = _folded(kids)
    return out


def expression(node: list) -> str:
    """The wrapper as text: tags, #text or a constant, ( )+ for repeats and ( )? for optional groups."""
    inner = "".join(expression(k) for k in node[7])
    own = "" if node[4] is None else "#text" if node[4] == "*" else "#constant"
    body = f"<{node[0]}>{own}{inner}</>" if node[0] and not node[0].startswith("(") else own + inner
    return f"({body})" + ("*" if node[2] and node[3] else "+" if node[2] else "?") if node[2] or node[3] else body


#: What a wrapper says of a slot, the weakest first.
KEEP, LINKS, COMMON_LINKS, CONSTANT, APART = range(5)


class Wrapper:
    """What a host's expression says of its pages' slots."""

    def __init__(self, expression: list):
        self.pages = expression[1]
        self.known: dict[tuple[str, ...], int] = {}
        self.root: dict = {}
        order = [expression]
        for node in order:
            order += node[7]
        # what each element holds: letters that vary and are no links, letters of links, whether it repeats a group of elements
        held: dict[int, tuple[int, int, bool]] = {}
        for node in reversed(order):
            inner = [held[id(k)] for k in node[7]]
            own = 0 if node[4] is None or self._constant(node) else max(0, node[5] - node[6])
            lists = any(x[2] for x in inner) or any(k[2] and k[7] for k in node[7])
            held[id(node)] = own + sum(x[0] for x in inner), node[6] + sum(x[1] for x in inner), lists
        body = held[id(expression)][0] / 2
        waiting = [(expression, self.root, False, False, False, None)]
        said: list[list] = []  # [node, place, what it says, whether it is inside article or main, the node above], in the page's order
        while waiting:
            node, place, repeated, apart, article, above = waiting.pop()
            if not node[0].startswith("("):
                own, linked, lists = held[id(node)]
                article = article or _tag(node[0]) in ("article", "main")
                strong, weak = _words(node[0], article)
                apart = apart or bool(strong) and (own <= body or node[2] or lists)
                apart = apart or not (_TOPICS | _LOOSE).isdisjoint(weak) and (not own or linked > own or lists)
                apart = apart or lists and any(x in w for w in weak for x in _REMARKS)
                said.append([node, place, self._says(node, repeated, apart), article, above])
                above = node
            for k in reversed(node[7]):
                waiting.append((k, place if k[0].startswith("(") else place.setdefault(k[0], {}), repeated or k[2], apart, article, above))
        self._names(said, held)
        for _, place, what, _, _ in said:
            place[""] = min(place.get("", APART), what)

    def _names(self, said: list[list], held: dict[int, tuple[int, int, bool]]) -> None:
        """Inside article and main, lets stay what is constant and names variable text, and plain lists of links that follow some."""
        before, plain = False, {id(None): True}
        for x in said:
            node, _, what, article, above = x
            tag, *names = re.split("[.#_]", node[0])
            before = article and (before or what == KEEP and node[4] is not None and not self._constant(node))
            plain[id(node)] = tag in ("article", "main") or plain[id(above)] and _SOURCES.issuperset(names)
            if what == COMMON_LINKS and before and plain[id(node)]:
                x[2] = KEEP
        around: dict[int, list[int]] = {}
        for i, (node, _, what, _, above) in enumerate(said):
            if what == KEEP and held[id(node)][0]:
                around.setdefault(id(above), []).append(i)
        ahead: str | None = None  # the tag of the next variable text, if nothing but labels lie between
        stay: list[int] = []
        for i in range(len(said) - 1, -1, -1):
            node, _, what, article, above = said[i]
            tag = _tag(node[0])
            if node[4] is None:
                continue
            if what == KEEP:
                ahead = tag
            elif what != CONSTANT or not article:
                ahead = None
            elif tag in _LABELS:
                if ahead is not None and (tag[0] != "h" or ahead not in _LABELS or ahead[0] != "h" or ahead > tag):
                    stay.append(i)
            elif tag in _PLAIN and node[0] == tag and (beside := around.get(id(above))) and beside[0] < i < beside[-1]:
                stay.append(i)
            else:
                ahead = None
        for i in stay:
            said[i][2] = KEEP

    def _common(self, node: list) -> bool:
        return node[1] >= CONSTANT_PAGES and node[1] >= SHARE * self.pages

    def _constant(self, node: list) -> bool:
        return node[4] not in (None, "*") and self._common(node)

    def _says(self, node: list, repeated: bool, apart: bool) -> int:
        if apart:
            return APART
        if repeated and node[6] * 2 > node[5]:
            return COMMON_LINKS if self._common(node) else LINKS
        return CONSTANT if self._constant(node) else KEEP

    def says(self, path: tuple[str, ...]) -> int:
        found = self.known.get(path)
        if found is None:
            place, exact = self.root, True
            for key in path:
                below = place.get(key)
                exact = exact and below is not None
                below = below or place.get(_tag(key))
                if below is None:
                    break
                place = below
            found = place.get("", KEEP)
            if not exact and any(_words(k, not {"article", "main"}.isdisjoint(map(_tag, path)))[0] for k in path):
                found = APART  # a coarse wrapper has no words to judge
            if len(self.known) >= 1 << 14:
                self.known.clear()
            self.known[path] = found
        return found


def extract(page: str | None, wrapper: list | None = None) -> str:
    """Main text of a page, given its host's wrapper."""
    return _extract(page, wrapper and Wrapper(wrapper))


def _extract(page: str | None, wrapper: Wrapper | None) -> str:
    every = slots(page or "")
    alone, wrapper = wrapper is None, wrapper or Wrapper(structure(every))
    found = [(s, what) for s in every if not s.apart and (what := wrapper.says(s.path)) != APART]
    inside = [x for x in found if x[0].article]
    # an article's lists of links are its own unless the host's pages have them in general
    links = (COMMON_LINKS,) if inside else (KEEP, LINKS, COMMON_LINKS) if alone else (LINKS, COMMON_LINKS)
    left = [(s, what) for s, what in inside or found if what not in links or s.linked * 2 <= len(s.text)]
    return "\n\n".join(s.text for s, _ in [x for x in left if x[1] != CONSTANT] or left or inside)


def host(url: Column) -> Column:
    """A url's host in lower case; null if there is none."""
    found = F.lower(F.regexp_extract(url, r"^\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#\s]+)", 1))
    return F.when(found != "", found)


def wrappers(scratch: Scratch, pages: DataFrame) -> DataFrame:
    """(host, wrapper) for ``pages(page_id, url, html)``: each host's expression as JSON. Copies of a page count once."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        seen: set[tuple[str, str]] = set()
        for batch in batches:
            for site, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                texts = slots(page.as_py() or "")
                mark = site, xxhash.xxh3_128_hexdigest("\0".join(x for s in texts for x in (*s.path, s.text)))
                if mark in seen:
                    continue
                seen.add(mark)
                found = structure(texts)
                held[site] = _bounded(align(held[site], found)) if site in held else found
        yield _batch(list(held), [json.dumps(x, separators=(",", ":")) for x in held.values()])

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        out = None
        for x in sorted(table.column("wrapper").to_pylist()):
            out = json.loads(x) if out is None else _bounded(align(out, json.loads(x)))
        return pa.table({"host": [key[0].as_py()], "wrapper": [json.dumps(out, separators=(",", ":"))]})

    kind = "host string, wrapper string"
    rows = pages.select(host(F.col("url").cast("string")).alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).where("host is not null")
    rows = rows.withColumn("mark", F.xxhash64("html"))
    copies = scratch.keep(rows.groupBy("host", "mark").agg(F.count("*").alias("n")).where("n > 1").select("host", "mark"), "copies")
    once, more = (rows.join(scratch.small(copies, "copies"), ["host", "mark"], how) for how in ("left_anti", "left_semi"))
    parts = once.union(more.dropDuplicates(["host", "mark"])).select("host", "html").mapInArrow(collect, kind)
    parts = parts.withColumn("part", F.pmod(F.xxhash64("wrapper"), F.lit(FAN)))
    return parts.groupBy("host", "part").applyInArrow(merge, kind).groupBy("host").applyInArrow(merge, kind)


def _batch(hosts: list[str], found: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(found, pa.string())], ["host", "wrapper"])


def main_text(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages(page_id, url, html)``."""
    scratch = Scratch(spark, "html-extraction")
    found = scratch.keep(wrappers(scratch, pages), "wrappers").select(F.col("host").alias("site"), "wrapper")
    scratch.clear("wrappers")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.join(scratch.small(found, "wrappers"), host(F.col("url")) == F.col("site"), "left").select("page_id", "url", "wrapper", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, Wrapper | None] = {None: None}
        for batch in batches:
            texts = []
            for wrapper, page in zip(batch.column(2), batch.column(3), strict=True):
                key = wrapper.as_py()
                if key not in known:
                    if len(known) > 256:
                        known = {None: None}
                    known[key] = Wrapper(json.loads(key))
                texts.append(_extract(page.as_py(), known[key]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
