"""Main text of web pages through wrappers inferred from pages of the same host.

A wrapper is a union-free regular expression over a page's tokens (tags and texts), as in
road-runner inference (Crescenzi, Mecca and Merialdo, 2001). Pages of a host with the same
paths of labels form a template. Its wrapper begins as one page and is aligned with every
other, per partition and then the partitions' wrappers with each other: runs that repeat become
repeated groups, tokens that only one side has become optional, and texts that differ
become slots. Streams are aligned level by level, in the nesting that HTML's implied end
tags give.

The wrapper decides what a page's text is. Its region is the part that most of the text in
slots goes through, headline included; every page is aligned with its template's wrapper, and
what falls into the region is its text, apart from texts that stand in one place on all pages
of the host. Tags and class names only say which parts of a page are menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles and comments, whose texts vary as well, and
which part to take where pages do not differ: a host with one page has only its article.
"""

from __future__ import annotations

import html as html_lib
import json
import pickle
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bound_batches, keeps_names, stage, table
from .words import tidy

#: Wrappers that a task holds before it passes them on, and partial wrappers that are merged at a time.
HELD_WRAPPERS, MERGED_PARTS = 2_000, 32
#: Wrapper tables up to so many bytes (as staged) and hosts are broadcast, larger ones joined by host.
BROADCAST_BYTES, BROADCAST_HOSTS = 8 << 20, 20_000
#: In a list of more parts than this, what stands between articles is generalised to "anything", which no longer tells slots from template.
WIDEST = 2_000
#: Elements nested deeper than this lie flat in the one at this depth; their ends and their noise still count.
DEPTH = 120

# Fixed values of HTML: elements without end tag, elements within a line, raw text, implied ends.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img".split())
_RAW = frozenset("script style textarea title noscript template iframe".split())
_CLOSES = {
    "p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"]),
}
_BOILERPLATE = frozenset("nav header footer aside form script style noscript template iframe head menu button select textarea dialog title svg canvas object".split())
# Words of class, id and role names that mark parts which are no text, and words that may stand beside them.
_NOISE = frozenset(
    "ad ads advert adverts advertisement advertising banner banners promo promotion sponsor sponsored sponsors cookie cookies consent notice notices notification notifications popup modal alert alerts "
    "disclaimer contentinfo complementary menu menubar nav navbar navigation breadcrumb breadcrumbs sidebar sidebars header footer masthead comment comments disqus reply replies share sharing social related "
    "recommended recommendations newsletter subscribe signup login search pagination pager toolbar widget widgets".split()
)
_BESIDE = frozenset(
    "box wrap wrapper container inner outer main bar area section list block group row column col holder panel slot unit top bottom left right center middle primary secondary global site page text form field "
    "link links item items icon icons button buttons btn posts post articles stories message msg body content thread card cards title heading label user reader article entry".split()
)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)>|[^<]+|<", re.DOTALL)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


@dataclass(eq=False)
class Node:
    """An element, or a text (label '#')."""

    label: str
    noisy: bool = False
    text: str = ""
    children: list[Node] = field(default_factory=list)


def is_noise(name: str) -> bool:
    """Whether a class, id or role says that its element is no text: a noise word, with none but neutral words beside it."""
    words = [w.lower() for w in _PARTS.findall(name)]
    return any(w in _NOISE for w in words) and all(w in _NOISE or w in _BESIDE or w.isdigit() for w in words) and words[0] not in ("main", "content", "article", "entry", "body", "post")


def parse(page: str) -> Node:
    """The page's tree. Elements within a line only carry their text."""
    root = Node("html")
    stack: list[tuple[str, Node]] = [("html", root)]
    position, end = 0, len(page)
    while position < end:
        m = _TOKEN.match(page, position)
        position = m.end()
        name = m[2]
        if name is None:
            if m[0][0] != "<" or m[0] == "<":
                _add_text(stack[-1][1], m[0])
            continue
        name = name.lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            continue
        if name == "br":
            _add_text(stack[-1][1], "\n")
        if name in ("html", "body"):
            continue
        noisy, mark = False, ""
        if "=" in m[3]:
            for a in _ATTRIBUTE.finditer(m[3]):
                value = a[2] or a[3] or a[4] or ""
                noisy = noisy or any(map(is_noise, value.split()))
                if a[1].lower() == "role":
                    mark = f".{value}" if value == "main" else mark
                elif not mark and a[1].lower() == "class":
                    mark = "." + (value.split() or [""])[0]
        if name in _RAW:
            close = re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(page, position)
            position = close.end() if close else end
            continue
        if name in _INLINE and not noisy or name in _VOID:
            if name == "hr" and stack[-1][1].children:
                stack[-1][1].children.append(Node("hr"))
            continue
        while len(stack) > 1 and name in _CLOSES.get(stack[-1][0], ()):
            stack.pop()
        above = stack[-1][1]
        noisy = noisy or name in _BOILERPLATE and not (name == "header" and any(_is_article(n.label) for _, n in stack))
        if len(stack) <= DEPTH or noisy and not above.noisy:
            node = Node(name + mark, noisy)
            above.children.append(node)
        else:  # flat, but a block of its own
            above.children.append(Node("hr"))
            node = above
        stack.append((name, node))
    _clear(root)
    return root


def _clear(root: Node) -> None:
    """Texts are cleaned; what holds an article is no noise by its class alone, while articles that are comments stay noise."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        if node.label == "#":
            node.text = clean(node.text)
        stack += node.children
    holds: set[int] = set()
    for node in reversed(order):
        article = _is_article(node.label) and not node.noisy
        if article or any(id(c) in holds for c in node.children):
            holds.add(id(node))
            if node.noisy and node.label.split(".")[0] not in _BOILERPLATE:
                node.noisy = False


def _add_text(node: Node, raw: str) -> None:
    if node.children and node.children[-1].label == "#":
        node.children[-1].text += raw
    elif raw.strip():
        node.children.append(Node("#", text=raw))


def clean(raw: str) -> str:
    return " ".join(html_lib.unescape(raw).split())


@dataclass(eq=False)
class Part:
    """A part of a wrapper: an element, a text (label '#', const None in a slot), a group (label '()') or anything ('*')."""

    label: str
    noisy: bool = False
    repeated: bool = False
    optional: bool = False
    const: str | None = None
    weight: float = 0.0  # characters of text on the pages seen
    children: list[Part] = field(default_factory=list)
    kinds: tuple[int, ...] = ()  # checksums of up to three different texts
    tags: frozenset = frozenset()  # labels of the elements in it
    nodes: list[Node] = field(default_factory=list)  # of a page that is aligned

    def key(self) -> tuple:
        return (self.label, tuple(c.label for c in self.children)) if self.label == "()" else (self.label,)


def from_page(node: Node) -> Part:
    """The page as an expression."""
    if node.label == "#":
        return Part("#", const=node.text, weight=len(node.text), kinds=(zlib.crc32(node.text.encode()),))
    children = _bounded(_fold([from_page(c) for c in node.children if c.label != "hr"]))
    return Part(node.label, node.noisy, weight=sum(c.weight for c in children), children=children, tags=_tags(node))


def _level(node: Node) -> list[Part]:
    """The page's expression one level below a node, with the nodes that each part stands for."""
    return _fold([Part(c.label, c.noisy, tags=_tags(c), nodes=[c]) for c in node.children if c.label != "hr"])


def _tags(node: Node) -> frozenset:
    return frozenset(c.label for c in node.children if c.label not in ("#", "hr"))


def _bounded(parts: list[Part]) -> list[Part]:
    return _generalised(parts) if len(parts) > WIDEST else parts


def _generalised(parts: list[Part]) -> list[Part]:
    """Runs of parts without an article as one part that stands for anything."""
    out: list[Part] = []
    for p in parts:
        if _holds_article(p):
            out.append(p)
            continue
        if not out or out[-1].label != "*":
            out.append(Part("*", repeated=True, optional=True))
        out[-1].weight += 0 if p.noisy else p.weight
        out[-1].nodes += p.nodes
    return out


def _holds_article(part: Part) -> bool:
    stack = [part]
    while stack:
        p = stack.pop()
        if _is_article(p.label):
            return True
        stack += p.children
    return False


def _alike(a: Part, b: Part) -> bool:
    """Whether neighbours of one label can be one repeated part: texts alone, or mostly the same labels in them."""
    return a.label == b.label and (a.tags == b.tags or 2 * len(a.tags & b.tags) >= len(a.tags | b.tags))


def _fold(parts: list[Part]) -> list[Part]:
    """Adjacent repeats become one repeated part or group; of those that begin at one place, the one that covers most."""
    labels = [p.label for p in parts]
    if len(set(labels)) == len(labels):
        return parts
    out: list[Part] = []
    again: dict[str, list[int]] = {}
    for i, label in enumerate(labels):
        again.setdefault(label, []).append(i)
    seen = dict.fromkeys(again, 0)
    i = 0
    while i < len(parts):
        places = again[labels[i]]
        while places[seen[labels[i]]] <= i:
            seen[labels[i]] += 1
            if seen[labels[i]] == len(places):
                break
        best = (0, 0)
        for j in places[seen[labels[i]] :]:
            p, r = j - i, 1
            if i + 2 * p > len(parts):
                break
            unit = labels[i:j]
            while labels[i + r * p : i + (r + 1) * p] == unit and all(map(_alike, parts[i : i + p], parts[i + r * p : i + (r + 1) * p])):
                r += 1
            if r > 1 and r * p > best[0] * best[1]:
                best = (p, r)
            if best[0] * best[1] >= len(parts) - i - p:  # no longer period covers more
                break
        p, r = best
        if not p:
            out.append(parts[i])
            i += 1
            continue
        units = [parts[i + k * p] if p == 1 else Part("()", weight=sum(x.weight for x in parts[i + k * p : i + (k + 1) * p]), children=parts[i + k * p : i + (k + 1) * p]) for k in range(r)]
        unit = units[0]
        for other in units[1:]:
            unit = merge(unit, other)
        unit.repeated = True
        out.append(unit)
        i += p * r
    return out


def merge(a: Part, b: Part) -> Part:
    """The least wrapper of both, for parts with one key."""
    kinds = a.kinds if a.kinds == b.kinds else tuple(sorted({*a.kinds, *b.kinds})[:3])
    out = Part(a.label, a.noisy or b.noisy, a.repeated or b.repeated, a.optional or b.optional, a.const if a.const == b.const else None, a.weight + b.weight, kinds=kinds)
    out.tags, out.nodes = a.tags if a.tags == b.tags else a.tags | b.tags, a.nodes + b.nodes
    if a.children or b.children:
        out.children = _bounded(align(a.children, b.children))
    return out


def align(a: list[Part], b: list[Part]) -> list[Part]:
    """Longest common subsequence; what only one side has becomes optional."""
    keys_a, keys_b = [p.key() for p in a], [p.key() for p in b]
    if keys_a == keys_b:
        return [merge(x, y) for x, y in zip(a, b)]
    wide = ("*",) in keys_a or ("*",) in keys_b
    if wide:
        a, b = _generalised(a), _generalised(b)
    out, i, j = [], 0, 0
    for x, y in [*pairs([p.key() for p in a], [p.key() for p in b]), (len(a), len(b))]:
        for alone in (*a[i:x], *b[j:y]):
            alone.optional = True
            out.append(alone)
        if x < len(a):
            out.append(merge(a[x], b[y]))
        i, j = x + 1, y + 1
    return _generalised(out) if wide else out


def pairs(a: list[tuple], b: list[tuple]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence; long lists in linear space (Hirschberg, 1975), equal ends first."""
    n, m = len(a), len(b)
    head = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(n, m))
    tail = next((k for k, (x, y) in enumerate(zip(reversed(a[head:]), reversed(b[head:]))) if x != y), min(n, m) - head)
    if head or tail:
        inner = [(head + i, head + j) for i, j in pairs(a[head : n - tail], b[head : m - tail])]
        return [(k, k) for k in range(head)] + inner + [(n - k, m - k) for k in range(tail, 0, -1)]
    if not n or not m:
        return []
    if n * m > 250_000:
        if n < m:
            return [(j, i) for i, j in pairs(b, a)]
        half = n // 2
        left, right = _lengths(a[:half], b), _lengths(a[half:][::-1], b[::-1])[::-1]
        cut = max(range(m + 1), key=lambda j: left[j] + right[j])
        return pairs(a[:half], b[:cut]) + [(half + i, cut + j) for i, j in pairs(a[half:], b[cut:])]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def _lengths(a: list[tuple], b: list[tuple]) -> list[int]:
    """Length of the longest common subsequence of a and each beginning of b."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            here = row[j + 1]
            row[j + 1] = before + 1 if x == y else max(here, row[j])
            before = here
    return row


def infer(pages: list[str]) -> Part:
    wrapper = from_page(parse(pages[0]))
    for page in pages[1:]:
        wrapper = merge(wrapper, from_page(parse(page)))
    return wrapper


def expression(part: Part) -> str:
    """The wrapper as a regular expression over tokens, for people."""
    if part.label == "#":
        body = "#text" if part.const is None else json.dumps(part.const, ensure_ascii=False)
    elif part.label == "*":
        body = "#any"
    else:
        inner = " ".join(expression(c) for c in part.children)
        body = f"( {inner} )" if part.label == "()" else f"<{part.label}> {inner} </>" if inner else f"<{part.label}> </>"
    mark = "*" if part.repeated and part.optional else "+" if part.repeated else "?" if part.optional else ""
    return f"( {body} ){mark}" if mark and part.label != "()" else body + mark


def _is_article(label: str) -> bool:
    return label.split(".")[0] in ("article", "main") or label.endswith(".main")


def _is_heading(label: str) -> bool:
    return label.split(".")[0] in ("h1", "h2")


def _weights(wrapper: Part, varying: bool) -> dict[int, float]:
    """Characters of text in each part's slots (or in all its texts), noisy parts left out."""
    order, stack = [], [wrapper]
    while stack:
        part = stack.pop()
        if not part.noisy:
            order.append(part)
            stack += part.children
    out: dict[int, float] = {}
    for part in reversed(order):
        own = part.weight if part.label == "#" and not (varying and part.const is not None) or part.label == "*" and not varying else 0.0
        out[id(part)] = own + sum(out.get(id(c), 0.0) for c in part.children)
    return out


def main_region(wrapper: Part, several: bool) -> list[tuple[int, ...]]:
    """Places (child numbers from the root) of the parts that hold a page's text.

    several: whether the wrapper has seen different pages. Then the text is where their slots
    are: in articles if these hold half of the text in slots, else in the innermost part with
    three fifths of it and with the headline. Otherwise it is the article, or else the innermost
    part with three fifths of all text.
    """
    weight = _weights(wrapper, True) if several else {}
    several = bool(weight.get(id(wrapper)))
    weight = weight if several else _weights(wrapper, False)
    total = weight.get(id(wrapper), 0.0)
    found: dict[tuple, list[tuple[float, tuple[int, ...]]]] = {}
    stack: list[tuple[Part, tuple[int, ...], tuple[str, ...]]] = [(wrapper, (), ())]
    while stack:
        part, at, labels = stack.pop()
        if part.noisy:
            continue
        if _is_article(part.label):
            found.setdefault(labels, []).append((weight[id(part)], at))
            continue
        stack += [(c, (*at, k), (*labels, part.label)) for k, c in enumerate(part.children)]
    if found and (not several or 2 * sum(w for places in found.values() for w, _ in places) >= total):
        places = max(sorted(found.items()), key=lambda x: sum(w for w, _ in x[1]))[1]
        return sorted(at for _, at in places)
    part, at = wrapper, ()
    while True:
        useful = [(weight.get(id(c), 0.0), -k) for k, c in enumerate(part.children) if not c.noisy and c.label not in ("#", "*", "()") and not c.repeated]
        if not useful:
            break
        most, k = max(useful)
        if most < 0.6 * weight[id(part)] or any(_has_heading(c, weight) for j, c in enumerate(part.children) if j != -k):
            break
        part, at = part.children[-k], (*at, -k)
    return [at]


def _has_heading(part: Part, weight: dict[int, float]) -> bool:
    stack = [part]
    while stack:
        p = stack.pop()
        if not p.noisy and weight.get(id(p), 0.0) > 0:
            if _is_heading(p.label):
                return True
            stack += p.children
    return False


def fixed_texts(region: Part, common: set[str]) -> set[int]:
    """Parts (by id) of the region that are template: one text in one place on all pages of the host.

    None unless at least three different texts stand in the region's slots and these hold four
    fifths of its text, so that copies of one page do not make each other's text a template.
    """
    fixed, held, slots, kinds = set(), 0.0, 0.0, 0
    stack = [(region, True)]
    while stack:
        part, sure = stack.pop()
        if part.noisy:
            continue
        sure = sure and not part.repeated and not part.optional and part.label != "()"
        if part.label == "#" and part.const is not None:
            if sure and part.const in common:
                fixed.add(id(part))
            held += part.weight
        elif part.label in "#*":
            slots, kinds = slots + part.weight, max(kinds, len(part.kinds) if part.label == "#" else 3)
        stack += [(c, sure) for c in part.children]
    return fixed if kinds >= 3 and slots >= 4 * held else set()


def template_of(wrapper: Part, pages: int, common: set[str]) -> list:
    """What a page needs of a wrapper, as JSON values: [key, in the region, template text, children].

    pages: how many different ones the wrapper has seen, up to three; with fewer no text is
    template. Children are given on the way to the region and to template texts; elsewhere the
    key alone.
    """
    places = main_region(wrapper, pages > 1)
    inside = set(places)
    fixed: set[int] = set()
    for at in places:
        part = wrapper
        for k in at:
            part = part.children[k]
        fixed |= fixed_texts(part, common) if pages > 2 else set()

    def shape(part: Part, at: tuple[int, ...]) -> list:
        here = at in inside
        children = [shape(c, (*at, k)) for k, c in enumerate(part.children)]
        needed = any(c[1] or c[2] is not None or c[3] for c in children)
        return [repr(part.key()), here, part.const if id(part) in fixed else None, children if needed else []]

    return shape(wrapper, ())


def by_template(root: Node, template: list) -> list[str]:
    """The page's blocks that its alignment with the template puts into the region."""
    chosen: list[Node] = [root] if template[1] else []
    dropped: set[int] = set()

    def match(parts: list[Part], shapes: list[list]) -> None:
        for i, j in pairs([repr(p.key()) for p in parts], [shape[0] for shape in shapes]):
            part, (_, inside, fixed, below) = parts[i], shapes[j]
            if inside:
                chosen.extend(n for n in part.nodes if not n.noisy)
            if fixed is not None:
                dropped.update(id(n) for n in part.nodes if n.text == fixed)
            if below and part.label == "()":
                match(part.children, below)
            elif below:
                for node in part.nodes:
                    match(_level(node), below)

    match(_level(root), template[3])
    return _blocks(chosen if len(chosen) < 2 else _in_order(root, chosen), dropped)


def _in_order(root: Node, chosen: list[Node]) -> list[Node]:
    """The chosen nodes in the page's order, without those inside others."""
    wanted, out, stack = set(map(id, chosen)), [], [root]
    while stack:
        node = stack.pop()
        if id(node) in wanted:
            out.append(node)
        else:
            stack += node.children[::-1]
    return out


def signature(root: Node) -> str:
    """Name of a page's template: the set of its paths of labels, up to articles and boilerplate."""
    paths: set[str] = set()
    stack = [(root, "")]
    while stack:
        node, path = stack.pop()
        if node.label != "#":
            path = f"{path} {node.label}"
            paths.add(path)
            if not node.noisy and not _is_article(node.label):
                stack += [(c, path) for c in node.children]
    text = "\n".join(sorted(paths)).encode()
    return f"{zlib.crc32(text):08x}{zlib.adler32(text):08x}"


def extract(page: str, templates: dict | None) -> tuple[str, bool]:
    """The page's main text by its template, and whether that came from several pages; a page without one is its own."""
    root = parse(page)
    known = (templates or {}).get(signature(root))
    blocks = by_template(root, known["shape"]) if known else []
    wrapped = bool(blocks) and known["pages"] > 1
    if not blocks:
        blocks = by_template(root, template_of(from_page(root), 1, set()))
    return "\n".join(blocks), wrapped


def _blocks(nodes: list[Node], dropped: set[int] = frozenset()) -> list[str]:
    out = []
    stack = nodes[::-1]
    while stack:
        node = stack.pop()
        if node.label == "#":
            if node.text and id(node) not in dropped:
                out.append(node.text)
        elif not node.noisy:
            stack += node.children[::-1]
    return out


def _host(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


@dataclass
class Host:
    """What pages of a host show: a wrapper and up to three different pages of each template, texts that stand on all pages."""

    wrappers: dict[str, Part] = field(default_factory=dict)
    different: dict[str, set[int]] = field(default_factory=dict)
    common: set[str] | None = None

    def add(self, root: Node) -> None:
        texts, name = _blocks([root]), signature(root)
        self._merge(name, from_page(root), {zlib.crc32("\n".join(texts).encode())})
        self._see(set(texts))

    def join(self, other: Host) -> None:
        for name, new in other.wrappers.items():
            self._merge(name, new, other.different[name])
        self._see(other.common or set())

    def _merge(self, name: str, new: Part, different: set[int]) -> None:
        self.wrappers[name] = merge(self.wrappers[name], new) if name in self.wrappers else new
        self.different[name] = set(sorted(self.different.get(name, set()) | different)[:3])

    def _see(self, texts: set[str]) -> None:
        self.common = texts if self.common is None else self.common & texts

    def templates(self) -> dict[str, dict]:
        """The shape of each template, and the number of its different pages, up to three."""
        return {name: {"shape": template_of(w, len(self.different[name]), self.common or set()), "pages": len(self.different[name])} for name, w in sorted(self.wrappers.items())}


def infer_wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(_host, _templates as JSON, _wrapper for people) of every host, from all its pages.

    Every partition merges its pages of a host first; what partitions made of a host is merged
    MERGED_PARTS at a time, so no task holds all partitions' wrappers of a host, however many
    pages it has.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[str, Host] = {}
        mine = TaskContext.get().partitionId()

        def passed() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_pydict({"_host": pa.array(list(held), pa.string()), "_slot": pa.array([mine] * len(held), pa.int32()), "_part": pa.array([pickle.dumps(h) for h in held.values()], pa.binary())})
            held.clear()
            return rows

        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(host, Host()).add(parse(page))
                if sum(len(h.wrappers) for h in (held.values() if len(held) % 100 == 0 else ())) > HELD_WRAPPERS:
                    yield passed()
        if held:
            yield passed()

    def merged(rows: list[bytes]) -> Host:
        host = Host()
        for row in rows:
            host.join(pickle.loads(row))
        return host

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                done = pickle.dumps(merged(batch.column(2)[k].as_py()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[k : k + 1], batch.column(1)[k : k + 1], pa.array([done], pa.binary())], ["_host", "_slot", "_part"])

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                host = merged(batch.column(1)[k].as_py())
                shown = "\n".join(expression(w) for _, w in sorted(host.wrappers.items()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[k : k + 1], pa.array([json.dumps(host.templates())]), pa.array([shown])], ["_host", "_templates", "_wrapper"])

    each = pages.filter(F.col(html).isNotNull()).select(_host(F.col(url)).alias("_host"), F.col(html).alias("_html"))
    slots = each.rdd.getNumPartitions()
    parts = each.mapInArrow(tidy(partial), "_host string, _slot int, _part binary")
    collected = F.array_sort(F.collect_list("_part")).alias("_parts")
    while slots > MERGED_PARTS:
        parts = parts.groupBy("_host", F.expr(f"_slot div {MERGED_PARTS}").cast("int").alias("_slot")).agg(collected).mapInArrow(tidy(between), "_host string, _slot int, _part binary")
        slots = -(-slots // MERGED_PARTS)
    return parts.groupBy("_host").agg(collected).mapInArrow(tidy(last), "_host string, _templates string, _wrapper string")


@keeps_names
def extract_main_text(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """pages without the HTML, with main_text and by_wrapper (whether several pages of its template decided).

    Blocks are joined by a line feed, white space within a block (line breaks included) is
    one space. Null and empty pages have an empty text; a null url has the empty host.
    Repeated pages stay. Columns of these names are replaced.
    """
    spark = pages.sparkSession
    bound_batches(spark)
    pages = pages.drop("main_text", "by_wrapper")
    wrappers, _ = stage(infer_wrappers(pages, url, html).select("_host", "_templates"), "wrappers")
    hosts, held = wrappers.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("_templates")), F.lit(0))).first()
    wrappers = F.broadcast(wrappers) if held <= BROADCAST_BYTES and hosts <= BROADCAST_HOSTS else wrappers
    kept = [f for f in pages.schema.fields if f.name != html]
    names = [f.name for f in kept]
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["main_text string", "by_wrapper boolean"])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict] = {}
        for batch in batches:
            found = []
            for page, region in zip(batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist(), strict=True):
                if region is not None and region not in known:
                    if len(known) >= HELD_WRAPPERS:
                        known.clear()
                    known[region] = json.loads(region)
                found.append(extract(page or "", known.get(region)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array([t for t, _ in found], pa.string()), pa.array([w for _, w in found], pa.bool_())], [*names, "main_text", "by_wrapper"])

    joined = pages.withColumn("_host", _host(F.col(url))).join(wrappers, "_host", "left")
    return joined.select(*names, html, "_templates").mapInArrow(run, ddl)


def op8_wrappers(spark, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_main_text(pages).select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))
