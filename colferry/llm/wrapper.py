"""Main text of HTML pages by union-free wrappers, inferred by aligning the pages of a host.

A page becomes a tree of block elements with text slots; runs of equal siblings (or of equal groups of siblings) fold
into a repeated group. Two trees of a host are aligned child by child: what both have is merged, what one lacks turns
optional, texts that differ turn into a variable slot, texts that agree stay constant. This goes on page by page; the
wrappers of parts of a host are merged as the pages are.

The host's wrapper decides what is main text, for every page: its region is the element that holds the host's
variable text outside links (article and main elements count more), and in the region, slots that stay constant over
the host are template. Each page is aligned with the wrapper and read through it. Tags (nav, footer, ...) and whole
names in class, id and role (sidebar, ad, ...) say which elements of the wrapper are no text. Pages which the region
does not occur in are read through a wrapper of their own, as is the only page of a host.
"""

from __future__ import annotations

import html as entities
import json
import re
import sys
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colferry.llm.common import Scratch, slices, small_batches
from colferry.llm.url_rules import host_path

_RAW = "script|style|noscript|template|textarea|title|select|svg|math|iframe|object|canvas|video|audio"
#: Attributes to the tag's end; where a quote never closes, the next > ends the tag. No two starts scan the same quotes for long: the scan stays linear.
_REST = r"(?:(?:\"[^\"]*+\"|'[^']*+'|[^'\"<>])*+>|[^<>]*+>)"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<({_RAW})\b{_REST}.*?(?:</\1\s*>|\Z)"
    rf"|<(/?)([a-zA-Z][^\s/>]*+)({_REST})|<[!?/][^>]*+>|<[!?/a-zA-Z][^<]*+\Z|[^<]++|<",
    re.S | re.I,
)
_NAME = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_DIGITS = re.compile("[0-9]{2,}")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a start tag ends, if open, up to the given container.
CLOSES = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "option": ("option", {"select"})}
BOILERPLATE_TAGS = frozenset("nav footer aside form menu button dialog head fieldset".split())
#: Whole names of elements without main text; names made of several count if all parts are here or neutral.
BOILERPLATE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs header footer masthead comment comments "
    "disqus respond replies notice notices cookie cookies consent gdpr popup modal newsletter subscribe signup login share sharing social related recommended pagination pager widget widgets toolbar skip copyright".split()
)
NEUTRAL_WORDS = frozenset("site page main global top bottom left right box block list item area container wrapper wrap section bar link links button buttons slot unit form content text title inner outer".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar".split())
#: Elements that the region may lie in or be; what else holds text is part of a region.
CONTAINERS = frozenset("div section article main table tbody tr td center form fieldset".split())
#: Elements that are never main text, whatever else there is.
NEVER = frozenset("nav footer aside header menu button dialog head".split())
#: A constant slot counts as template from so many pages on, if at least half of the host's pages have it.
TEMPLATE_PAGES = 3
#: Share of the variable text that the region must hold; how much more text counts in article and main elements.
MAIN_SHARE, ARTICLE_WEIGHT = 0.6, 4
#: An element outside articles whose text is in links to this share is a menu.
MENU_SHARE = 0.8
BROADCAST_BYTES = 16 << 20
#: Nodes of pages that a task aligns before it tells of its wrappers; bytes of wrappers in a batch.
ALIGNED_NODES, BATCH_WRAPPERS = 400_000, 8 << 20
#: Tasks whose wrappers of a host are merged before all are.
TOGETHER = 256

#: Trees are walked by plain recursion (its frames are on the heap), and pages may nest at any depth.
sys.setrecursionlimit(max(sys.getrecursionlimit(), 1 << 28))

#: Node: [label, kids]; slot: ["#", hash of the text or None, pages, characters, those in links]; kid: [node or slot, optional, repeated].


class Text(str):
    """A text with the number of its characters that are in links."""

    links = 0


def label_of(tag: str, attributes: str) -> str:
    """The tag and the element's names: classes without numbers, #id if it has none, @role."""
    names = set()
    for name, *values in _NAME.findall(attributes) if len(attributes) > 1 else ():
        words = "".join(values).lower().split()
        if name.lower() == "class":
            names.update(_DIGITS.sub("", w) for w in words)
        elif len(words) == 1 and not _DIGITS.search(words[0]):
            names.add(("#" if name.lower() == "id" else "@") + words[0])
    return " ".join([tag, *sorted(names - {""})])


def parse(page: str) -> list:
    """The tree of a page: nodes [label, kids], texts as strings (Text where some of it is in links)."""
    root: list = ["html", []]
    stack, names_open = [root], ["html"]
    count: Counter[str] = Counter()  # of the open elements' names
    text: list[str] = []
    in_link, links = False, 0

    def flush() -> None:
        nonlocal links
        if text:
            if words := " ".join(entities.unescape("".join(text)).split()):
                if links:
                    words = Text(words)
                    words.links = min(links, len(words))
                stack[-1][1].append(words)
            text.clear()
            links = 0

    def close(k: int) -> None:
        count.subtract(names_open[k:])
        del stack[k:], names_open[k:]

    for m in _TOKEN.finditer(page):
        raw, end, tag, attributes = m.groups()
        if raw:
            if raw.lower() in ("textarea", "select", "title", "iframe", "object", "canvas", "video", "audio", "template"):
                flush()
            continue
        if not tag:
            piece = m.group()
            if piece[0] != "<" or piece == "<":
                text.append(piece if piece != "<" else "&lt;")
                if in_link:
                    links += len(piece.strip())
            continue
        tag = tag.lower()
        if tag == "br":
            text.append(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = not end
            continue
        flush()
        if end:
            if count[tag] > 0:
                close(next(k for k in range(len(stack) - 1, 0, -1) if names_open[k] == tag))
            continue
        if tag in ("html", "body") or tag in VOID:
            continue
        if tag in CLOSES:
            closed, within = CLOSES[tag]
            for k in range(len(stack) - 1, 0, -1) if any(count[c] > 0 for c in closed.split()) else ():
                if names_open[k] in within:
                    break
                if names_open[k] in closed.split():
                    close(k)
                    break
        elif names_open[-1] == "p":
            close(len(stack) - 1)
        node = [label_of(tag, attributes), []]
        stack[-1][1].append(node)
        stack.append(node)
        names_open.append(tag)
        count[tag] += 1
    flush()
    return root


@lru_cache(100_000)
def boilerplate(label: str, in_region: bool) -> bool:
    """Whether an element's tag or one of its whole names says that it holds no main text. An article's header does."""
    tag, *names = label.split(" ")
    if tag in BOILERPLATE_TAGS or tag == "header" and not in_region:
        return True
    return any(map(_unwanted, names)) and tag not in ("h1", "header")


def _unwanted(name: str) -> bool:
    if name[0] == "@":
        return name[1:] in ROLES
    parts = [p for p in re.split("[-_]+", name.lstrip("#")) if p]
    return any(p in BOILERPLATE_WORDS for p in parts) and all(p in BOILERPLATE_WORDS or p in NEUTRAL_WORDS for p in parts)


# --- wrappers ---


def _key(kid: list) -> str:
    return kid[0][0]


def fold(kids: list) -> list:
    """Runs of up to 4 siblings that come again at once become a repeated group (each of its kids repeated)."""
    for period in (1, 2, 3, 4):
        out: list = []
        i, keys = 0, [_key(k) for k in kids]
        while i < len(kids):
            n = 1
            while keys[i : i + period] == keys[i + n * period : i + (n + 1) * period] and i + (n + 1) * period <= len(kids):
                n += 1
            if n > 1 and len(set(keys[i : i + period])) == period:
                group = kids[i : i + period]
                for r in range(1, n):
                    group = [merge_kid(a, b, True) for a, b in zip(group, kids[i + r * period : i + (r + 1) * period])]
                out += [[k[0], k[1], True] for k in group]
                i += n * period
            else:
                out.append(kids[i])
                i += 1
        kids = out
    return kids


def wrapper(tree: list) -> list:
    """The wrapper of one page."""
    kids = [[_slot(x) if isinstance(x, str) else wrapper(x), False, False] for x in tree[1]]
    return [tree[0], fold(kids)]


def _slot(text: str) -> list:
    return ["#", xxhash.xxh3_64_intdigest(text.encode()), 1, len(text), getattr(text, "links", 0)]


def merge_kid(a: list, b: list, same_page: bool = False) -> list:
    x, y = a[0], b[0]
    if x[0] == "#":
        node = ["#", x[1] if x[1] == y[1] else None, max(x[2], y[2]) if same_page else x[2] + y[2], x[3] + y[3], x[4] + y[4]]
    else:
        node = merge(x, y, same_page)
    return [node, a[1] or b[1], a[2] or b[2]]


def _lengths(a: list[str], b: list[str]) -> list[int]:
    """For every j, how long a common subsequence of a and b[:j] gets; a bit a label of b."""
    places: dict[str, int] = {}
    for j, label in enumerate(b):
        places[label] = places.get(label, 0) | 1 << j
    full = v = (1 << len(b)) - 1
    for label in a:
        if u := v & places.get(label, 0):
            v = (v + u | v - u) & full
    out = [0]
    for bit in reversed(f"{v:0{len(b)}b}"):
        out.append(out[-1] + (bit == "0"))
    return out


def matches(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Indices of a longest alignment of two label sequences, in linear space (Hirschberg), at any size."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, p, j, q = todo.pop()
        while i < p and j < q and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < p and j < q and a[p - 1] == b[q - 1]:
            p, q = p - 1, q - 1
            out.append((p, q))
        if i == p or j == q:
            continue
        if p - i == 1:
            if a[i] in b[j:q]:
                out.append((i, b.index(a[i], j, q)))
            continue
        mid = (i + p) // 2
        left, right = _lengths(a[i:mid], b[j:q]), _lengths(a[mid:p][::-1], b[j:q][::-1])[::-1]
        cut = j + max(range(q - j + 1), key=lambda k: left[k] + right[k])
        todo += [(i, mid, j, cut), (mid, p, cut, q)]
    return sorted(out)


def merge(a: list, b: list, same_page: bool = False) -> list:
    """The wrapper of both: mismatches become optional kids, unlike texts variable slots."""
    x, y = a[1], b[1]
    out: list = []
    i = j = 0
    for p, q in [*matches([_key(k) for k in x], [_key(k) for k in y]), (len(x), len(y))]:
        out += [[k[0], True, k[2]] for k in x[i:p]] + [[k[0], True, k[2]] for k in y[j:q]]
        if p < len(x):
            out.append(merge_kid(x[p], y[q], same_page))
        i, j = p + 1, q + 1
    return [a[0], fold(out)]


# --- what the wrapper decides ---


def weigh(node: list, pages: int, allowed: frozenset, everything: bool, in_article: bool, out: dict[int, int]) -> int:
    """Fills out with each node's characters of variable slots outside links and boilerplate (everything: of all slots
    outside boilerplate), as they count towards the region."""
    if node[0] == "#":
        return node[3] if everything else 0 if _constant(node, pages) else node[3] - node[4]
    weight = ARTICLE_WEIGHT if not in_article and _is_article(node[0]) else 1
    total = 0
    for k in node[1]:  # no generator: recursion through sum() would be on the C stack
        own = weigh(k[0], pages, allowed, everything, in_article or weight > 1, out)
        if k[0][0] == "#" or id(k[0]) in allowed or not boilerplate(k[0][0], in_article or weight > 1):
            total += own
    out[id(node)] = total * weight
    return total * weight


def mass(node: list, pages: int = 0) -> int:
    """Characters that count towards the region, of a whole wrapper."""
    return weigh(node, pages, frozenset(), False, False, {})


def _constant(slot: list, pages: int) -> bool:
    return slot[1] is not None and slot[2] >= max(TEMPLATE_PAGES, pages / 2)


def _tag(label: str) -> str:
    return label.split(" ", 1)[0]


def _is_article(label: str) -> bool:
    return _tag(label) in ("article", "main") or "@main" in label.split(" ")


class Guide:
    """A node of a wrapper with what it decides: whether it is a region's root, and whether its text is dropped."""

    __slots__ = ("drop", "keys", "kids", "repeated", "root")

    def __init__(self) -> None:
        self.keys, self.kids, self.repeated, self.drop, self.root = [], [], {}, False, False


def judge(whole: list, pages: int) -> Guide:
    """The wrapper of a host of so many pages, ready to read pages through."""
    allowed, everything, of = _allowed(whole, pages), False, {}
    total = weigh(whole, pages, allowed, False, False, of)
    if not total:  # all pages are alike, or all text is in links
        everything, total = True, weigh(whole, pages, allowed, True, False, of)
    path, in_article = [whole], False
    while total:
        node, found = path[-1], None
        for k in node[1]:
            label = k[0][0]
            if _tag(label) not in CONTAINERS or k[2] and not _is_article(label) or _is_article(node[0]) and not _is_article(label):
                continue
            if boilerplate(label, in_article) and id(k[0]) not in allowed:
                continue
            if of[id(k[0])] * (ARTICLE_WEIGHT if in_article else 1) >= MAIN_SHARE * total:
                found = k[0]
                break
        if found is None:
            break
        path.append(found)
        in_article = in_article or _is_article(found[0])
    region = path[-1]
    roots = {id(region)}
    if not in_article:  # headings stand before the element of the text
        for above, below in zip(path, path[1:]):
            for k in above[1]:
                if k[0] is below:
                    break
                if _tag(k[0][0]) in ("h1", "h2") and of[id(k[0])]:
                    roots.add(id(k[0]))
    templates = not everything and _fixed(region, pages) <= of[id(region)]
    menus: set[int] = set()
    if not in_article:
        _menus(region, menus)
    return _guide(whole, pages, roots, allowed, menus, False, templates)


def _allowed(whole: list, pages: int) -> frozenset:
    """Boilerplate elements that hold all text there is, where there is no article: a form around a page, say."""
    found: list[list] = []
    todo = [whole]
    while todo:
        node = todo.pop()
        if _is_article(node[0]):
            return frozenset()
        inner = [k[0] for k in node[1] if k[0][0] != "#" and _tag(k[0][0]) not in NEVER]
        found += [k for k in inner if boilerplate(k[0], False)]
        todo += inner
    strict: dict[int, int] = {}
    loose: dict[int, int] = {}
    weigh(whole, pages, frozenset(), False, False, strict)
    if not found or strict[id(whole)]:
        return frozenset()
    weigh(whole, pages, frozenset(map(id, found)), False, False, loose)
    out, node = set(), whole
    while not strict[id(node)]:
        inner = [k[0] for k in node[1] if k[0][0] != "#" and loose[id(k[0])] and _tag(k[0][0]) not in NEVER]
        if not inner:
            break
        node = max(inner, key=lambda x: loose[id(x)])
        out.add(id(node))
    return frozenset(out)


def _fixed(node: list, pages: int) -> int:
    """Characters of constant slots."""
    if node[0] == "#":
        return node[3] if _constant(node, pages) else 0
    total = 0
    for k in node[1]:
        total += _fixed(k[0], pages)
    return total


def _menus(node: list, out: set[int]) -> tuple[int, int, int]:
    """Slots, characters and characters in links below a node; elements below it that are menus go to out."""
    slots = chars = links = 0
    for k in node[1]:
        if k[0][0] == "#":
            own = (1, k[0][3], k[0][4])
        else:
            own = _menus(k[0], out)
            if _tag(k[0][0]) in ("ul", "ol", "div", "section", "table") and (own[0] > 1 or k[2]) and own[2] >= MENU_SHARE * own[1] > 0:
                out.add(id(k[0]))
        slots, chars, links = slots + own[0], chars + own[1], links + own[2]
    return slots, chars, links


def _guide(node: list, pages: int, roots: set, allowed: frozenset, menus: set, in_region: bool, templates: bool) -> Guide:
    g = Guide()
    if node[0] == "#":
        g.drop = in_region and templates and _constant(node, pages)
        return g
    g.root = id(node) in roots
    inside = in_region or g.root
    g.keys = [_key(k) for k in node[1]]
    for k in node[1]:
        label = k[0][0]
        below = _guide(k[0], pages, roots, allowed, menus, inside, templates and _tag(node[0]) != "h1")
        if label != "#" and not below.root:
            below.drop = id(k[0]) in menus or id(k[0]) not in allowed and boilerplate(label, inside)
        g.kids.append(below)
        if k[2]:
            g.repeated.setdefault(label, below)
    return g


# --- extraction ---


def folded(keys: list[str]) -> tuple[list[str], list[list[int]]]:
    """A sequence of labels with its runs folded as fold does it, and the places that each one left stands for."""
    places = [[i] for i in range(len(keys))]
    for period in (1, 2, 3, 4):
        if len(keys) < 2 * period:
            break
        out_keys: list[str] = []
        out: list[list[int]] = []
        i = 0
        while i < len(keys):
            n = 1
            while keys[i : i + period] == keys[i + n * period : i + (n + 1) * period] and i + (n + 1) * period <= len(keys):
                n += 1
            if n > 1 and len(set(keys[i : i + period])) == period:
                out_keys += keys[i : i + period]
                out += [[x for r in range(n) for x in places[i + r * period + j]] for j in range(period)]
                i += n * period
            else:
                out_keys.append(keys[i])
                out.append(places[i])
                i += 1
        keys, places = out_keys, out
    return keys, places


def aligned(tree: list, g: Guide) -> list[Guide | None]:
    """The wrapper's node for each kid of a page's node."""
    keys, places = folded(["#" if isinstance(x, str) else x[0] for x in tree[1]])
    out: list[Guide | None] = [None] * len(tree[1])
    for p, q in matches(keys, g.keys) if keys != g.keys else ((i, i) for i in range(len(keys))):
        for i in places[p]:
            out[i] = g.kids[q]
    for key, own in zip(keys, places):  # what comes out of turn may be one more of a repeated group
        if out[own[0]] is None and key in g.repeated:
            for i in own:
                out[i] = g.repeated[key]
    return out


def _read(tree: list, g: Guide | None, inside: bool, out: list[str]) -> bool:
    """Adds the region's texts below a node; whether there is a region."""
    seen = inside
    kinds = aligned(tree, g) if g is not None else [None] * len(tree[1])
    for x, kid in zip(tree[1], kinds):
        if isinstance(x, str):
            if inside and not (kid is not None and kid.drop):
                out.append(x)
        elif kid is None:
            if inside and not boilerplate(x[0], True):
                _read(x, None, True, out)
        elif not kid.drop:
            if _read(x, kid, inside or kid.root, out):
                seen = True
    return seen


def extract(page: str | None, known: list | Guide | None, pages: int = 1) -> str:
    """Main text of a page, read through the wrapper of its host, or, where that has no place for it, through its own."""
    tree = parse(page or "")
    if known is not None:
        g = known if isinstance(known, Guide) else judge(known, pages)
        out: list[str] = []
        if _read(tree, g, g.root, out):
            return "\n".join(out)
    g = judge(wrapper(tree), 1)
    out = []
    _read(tree, g, g.root, out)
    return "\n".join(out)


# --- over tables ---


def dumps(node: list) -> str:
    """A wrapper as flat JSON, nodes before their kids: nested JSON of deep pages would be beyond the C stack."""
    out, todo = [], [[node, False, False]]
    while todo:
        x, *marks = todo.pop()
        if x[0] == "#":
            out.append([*x, *marks])
        else:
            out.append([x[0], len(x[1]), *marks])
            todo += reversed(x[1])
    return json.dumps(out)


def loads(text: str) -> list:
    top: list = []
    todo = [[top, 1]]
    for row in json.loads(text):
        while not todo[-1][1]:
            todo.pop()
        todo[-1][1] -= 1
        node = row[:-2] if row[0] == "#" else [row[0], []]
        todo[-1][0].append([node, *row[-2:]])
        if row[0] != "#":
            todo.append([node[1], row[1]])
    return top[0][0]


def nodes_of(node: list) -> int:
    total, todo = 0, [node]
    while todo:
        x = todo.pop()
        total += 1
        if x[0] != "#":
            todo += [k[0] for k in x[1]]
    return total


def infer(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, pages, wrapper (JSON): each task aligns its own pages of a host, then the tasks' wrappers are aligned.

    What is shuffled is one wrapper for a host and about ALIGNED_NODES nodes of pages at most (texts are hashes in it),
    which also bounds what a task holds. They are merged by TOGETHER tasks first, so that a hot host meets in one task
    as few wrappers.
    """
    schema = "host string, part int, pages long, wrapper string"

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list] = {}
        size = 0
        part = TaskContext.get().partitionId() // TOGETHER

        def told() -> Iterator[pa.RecordBatch]:
            rows: list[tuple] = []
            held = 0
            for host, (n, w) in known.items():
                rows.append((host, part, n, dumps(w)))
                held += len(rows[-1][-1])
                if held > BATCH_WRAPPERS:
                    yield batch_of(rows)
                    rows, held = [], 0
            yield batch_of(rows)
            known.clear()

        for whole in batches:
            for batch in slices(whole):
                for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    host, own = host_path(url)[0], wrapper(parse(page or ""))
                    size += nodes_of(own)
                    if host in known:
                        n, w = known[host]
                        known[host] = [n + 1, merge(w, own)]
                    else:
                        known[host] = [1, own]
                    if size > ALIGNED_NODES:
                        yield from told()
                        size = 0
        yield from told()

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.string()))], names=["host", "part", "pages", "wrapper"])

    def together(rows: pd.DataFrame) -> pd.DataFrame:
        both = None
        for w in map(loads, sorted(rows["wrapper"])):
            both = w if both is None else merge(both, w)
        return pd.DataFrame({"host": [rows["host"].iloc[0]], "part": [int(rows["part"].iloc[0])], "pages": [int(rows["pages"].sum())], "wrapper": [dumps(both)]})

    src = small_batches(pages).select(pages[url_col].alias("url"), pages[html_col].alias("html"))
    partly = src.mapInArrow(align, schema).groupBy("host", "part").applyInPandas(together, schema)
    return partly.groupBy("host").applyInPandas(together, schema).select("host", "pages", "wrapper")


def extract_main(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text: the main text of every page, by its host's wrapper.

    Null, empty or tagless html: the text as it is (empty if none). A null url or one without `://` belongs to the
    empty host. Null ids stay; repeated rows are pages each; pages of any length are read whole; an empty table gives
    none; other columns are not read. Every page is read through its host's wrapper.
    """
    scratch = Scratch(pages.sparkSession)
    wrappers = scratch.write(infer(pages, url_col, html_col), "wrappers")
    size = wrappers.agg(F.sum(F.length("wrapper") + F.length("host"))).first()[0] or 0
    host = F.translate(F.regexp_extract(F.coalesce(pages[url_col], F.lit("")), "^(?s).*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    src = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html"), host.alias("host"))
    joined = src.join(F.broadcast(wrappers) if size <= BROADCAST_BYTES else wrappers, "host", "left").select("page_id", "url", "html", "pages", "wrapper")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, Guide | None] = {None: None}
        for whole in batches:
            for batch in slices(whole):
                out = []
                for page, n, w in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4))):
                    if w not in known:
                        if len(known) > 1000:
                            known.clear()
                            known[None] = None
                        known[w] = judge(loads(w), n)
                    out.append(extract(page, known[w]))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    return joined.mapInArrow(read, "page_id long, url string, text string")
