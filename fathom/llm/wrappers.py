"""HTML extraction (7): wrapper induction on the pages of a host.

A host's layouts are found on all of its pages that have text. Their sets of label paths are taken by falling number of pages; a set that is alike to
that of an earlier layout counts to the one it is most alike to, any other begins a layout, whose template is a page with this very set. Layouts of one page are left out, since one page
shows nothing and no other is alike to it. Every page's tree is aligned with the template most alike to it by simple tree matching: the largest
set of node pairs that keeps order and ancestors, found by dynamic programming over the children of two nodes of the same
label, where a pair of equal texts counts twice. Over all pages of the layout that have text it is counted how often a template's text node is matched, and how often by the same text:
nodes that are the same on CONSTANT of these pages are template. All other text, matched with a varying node or with
none, is in a slot, and slots are the content, except those within elements whose label says that they hold no content.
"""

from __future__ import annotations

import hashlib
import html
import json
import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .durable import table

#: Part of a layout's pages on which a node must have the same text to be template. One page alone shows nothing.
CONSTANT = 0.9
#: Different sets of paths of a host that one task takes. Where a host has more, layouts are found in blocks of as many, then among the blocks' layouts.
SETS = 50_000
#: Least Jaccard coefficient of the label paths of two pages of one layout. A page that has it with no template is all content.
ALIKE = 0.5
#: Largest set of templates, in bytes as written, that is sent to every executor; beyond it pages and templates are joined by shuffle.
BROADCAST_BYTES = 16 << 20
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset(("script", "style", "textarea", "title", "noscript"))
#: A begin tag ends open elements of these labels, up to the nearest of the others.
CLOSES = {"p": ("p",), "li": ("li",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)} | {k: ("p",) for k in "div ul ol table section article h1 h2 h3 h4 h5 h6 pre blockquote nav footer header aside form".split()}
SCOPE = frozenset("ul ol table div article section body html td th nav footer header aside form blockquote".split())
#: Left out by their label: what is not shown as text, navigation and advertisements. In all else the alignment decides.
HIDDEN = frozenset("head script style noscript template iframe svg nav footer".split())
HIDDEN_CLASSES = frozenset("ad ads advert advertisement".split())
BLOCK = frozenset("p div li tr h1 h2 h3 h4 h5 h6 br article section ul ol table pre blockquote dt dd".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|[^<]+|<", re.S)
_CLASS = re.compile(r"\bclass\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Elements nested deeper are taken as children of the one at this depth.
DEPTH = 200
#: Hosts, and templates, that a task keeps.
TEMPLATES_KEPT = 500
#: Cells of an alignment's table, above which it is cut in two (Hirschberg) to bound memory.
CELLS = 4_000_000


class Node:
    """label is a tag's name, and its class if it has one; '' is text."""

    __slots__ = ("label", "text", "kids", "shape", "size", "number")

    def __init__(self, label: str, text: str = ""):
        self.label, self.text, self.kids, self.shape, self.size, self.number = label, text, [], -1, 1, -1


def parse(page: str) -> Node:
    """The tree of a page. End tags without a begin tag are skipped, elements without an end tag end with what holds them."""
    root = Node("#")
    stack, pos = [root], 0
    for m in _TOKEN.finditer(page):
        if m.start() < pos:
            continue
        end, tag = m.group(1), m.group(2)
        if tag is None:
            piece = m.group(0)
            if not piece.startswith(("<!", "<?")):
                text = " ".join(html.unescape(piece).split())
                if text:
                    last = stack[-1].kids
                    if last and last[-1].label == "":
                        last[-1].text += " " + text
                    else:
                        last.append(Node("", text))
            continue
        tag = tag.lower()
        if end:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].label.partition(".")[0] == tag:
                    del stack[k:]
                    break
            continue
        for k in range(len(stack) - 1, 0, -1):
            name = stack[k].label.partition(".")[0]
            if name in CLOSES.get(tag, ()):
                del stack[k:]
                break
            if name in SCOPE:
                break
        c = _CLASS.search(m.group(3)) if m.group(3) else None
        name = " ".join(next(x for x in c.groups() if x is not None).split()) if c else ""
        node = Node(f"{tag}.{name}" if name else tag)
        stack[-1].kids.append(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, m.end())
            stop = close.start() if close else len(page)
            text = " ".join(html.unescape(page[m.end() : stop]).split())
            if text:
                node.kids.append(Node("", text))
            pos = close.end() if close else len(page)
        elif tag not in VOID and not m.group(3).endswith("/") and len(stack) < DEPTH:
            stack.append(node)
    return root


def _post_order(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        out.append(n)
        stack += n.kids
    return out[::-1]


class Matcher:
    """Simple tree matching. Of texts, two that are the same count 2 and others 1, so that a node which the pages share is matched
    with itself rather than with a neighbour. Scores are kept by pairs of shapes: a subtree with those of its texts that the
    template has, and no others."""

    def __init__(self):
        self.shapes: dict[tuple, int] = {}
        self.scores: dict[tuple[int, int], int] = {}

    def prepare(self, root: Node, known: set[str] | frozenset[str] = frozenset()) -> Node:
        """Sets shape and size; known: the template's texts."""
        if len(self.shapes) > 200_000:
            raise OverflowError
        for n in _post_order(root):
            same = n.label == "" and n.text in known
            n.shape = self.shapes.setdefault((n.label, hash(n.text)) if same else (n.label, *[k.shape for k in n.kids]), len(self.shapes))
            n.size = 1 + same + sum(k.size for k in n.kids)
        return root

    def score(self, a: Node, b: Node) -> int:
        """Size of the largest matching of two trees; trees of different labels have none."""
        if a.label != b.label:
            return 0
        if a.shape == b.shape:
            return a.size
        if a.label == "":
            return 1
        key = a.shape, b.shape
        got = self.scores.get(key)
        if got is None:
            if len(self.scores) > 500_000:
                self.scores.clear()
            got = self.scores[key] = 1 + int(self._last(self._weights(a.kids, b.kids))[-1])
        return got

    def _weights(self, a: list[Node], b: list[Node]) -> np.ndarray:
        """Scores of all pairs; each pair of shapes is looked up once."""
        if not a or not b:
            return np.zeros((len(a), len(b)), np.int32)
        ka, kb = {n.shape: n for n in a}, {n.shape: n for n in b}
        pa_, pb = {s: i for i, s in enumerate(ka)}, {s: i for i, s in enumerate(kb)}
        small = np.array([[self.score(x, y) for y in kb.values()] for x in ka.values()], np.int32)
        if len(ka) == len(a) and len(kb) == len(b):
            return small
        return small[np.array([pa_[n.shape] for n in a])[:, None], np.array([pb[n.shape] for n in b])]

    @staticmethod
    def _last(w: np.ndarray) -> np.ndarray:
        """The last row of the table of best scores: of all of a with the first 0, 1, .. of b."""
        row = np.zeros(w.shape[1] + 1, np.int64)
        for weights in w:
            row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + weights))
        return row

    def pairs(self, a: list[Node], b: list[Node]) -> list[tuple[Node, Node]]:
        """The matching of two lists of siblings. Where several are best, the one that takes the last pair first."""
        out: list[tuple[Node, Node]] = []
        head = 0
        while head < min(len(a), len(b)) and a[head].shape == b[head].shape:
            out.append((a[head], b[head]))
            head += 1
        if head:
            a, b = a[head:], b[head:]
        tail = 0
        while tail < min(len(a), len(b)) and a[-1 - tail].shape == b[-1 - tail].shape:
            out.append((a[-1 - tail], b[-1 - tail]))
            tail += 1
        if tail:
            a, b = a[: len(a) - tail], b[: len(b) - tail]
        if len(a) == 1 == len(b):
            if self.score(a[0], b[0]):
                out.append((a[0], b[0]))
            return out
        work = [(a, b)]
        while work:
            a, b = work.pop()
            if not a or not b:
                continue
            w = self._weights(a, b)
            if w.size > CELLS and len(a) > 1:
                half = len(a) // 2
                cut = int(np.argmax(self._last(w[:half]) + self._last(w[half:][::-1, ::-1])[::-1]))
                work += [(a[:half], b[:cut]), (a[half:], b[cut:])]
                continue
            t = np.zeros((len(a) + 1, len(b) + 1), np.int64)
            for i in range(len(a)):
                t[i + 1, 1:] = np.maximum.accumulate(np.maximum(t[i, 1:], t[i, :-1] + w[i]))
            i, j = len(a), len(b)
            while i and j:
                if w[i - 1, j - 1] and t[i, j] == t[i - 1, j - 1] + w[i - 1, j - 1]:
                    i, j = i - 1, j - 1
                    out.append((a[i], b[j]))
                elif t[i, j] == t[i - 1, j]:
                    i -= 1
                else:
                    j -= 1
        return out

    def match(self, template: Node, page: Node) -> None:
        """Sets the number of every matched node of the page to that of its partner; of others it is -1."""
        work = [(template, page)]
        while work:
            t, p = work.pop()
            p.number = t.number
            if t.kids and p.kids:
                work += zip(t.kids, p.kids) if t.shape == p.shape else self.pairs(t.kids, p.kids)


def _number(root: Node, first: int = 0) -> Node:
    for k, n in enumerate(_post_order(root), first):
        n.number = k
    return root


@lru_cache(1 << 16)
def _label(label: str) -> int:
    return int.from_bytes(hashlib.blake2b(label.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def paths(root: Node) -> set[int]:
    """Hashes of the labels from the root to each element, the same in every process."""
    out: set[int] = set()
    stack = [(root, 0)]
    while stack:
        n, above = stack.pop()
        here = hash((above, _label(n.label)))  # of integers: no seed takes part
        out.add(here)
        stack += [(k, here) for k in n.kids if k.label]
    return out


def _alike(a: set[int], b: set[int]) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both)


class Likeness:
    """Sets of paths, and which of them is most alike to another."""

    def __init__(self):
        self.sets: list[set[int]] = []
        self.having: dict[int, list[int]] = {}

    def add(self, own: set[int]) -> None:
        for x in own:
            self.having.setdefault(x, []).append(len(self.sets))
        self.sets.append(own)

    def find(self, own: set[int]) -> int:
        """The set most alike to own, of several the first, or -1 if none is as alike as ALIKE."""
        near = range(len(self.sets))
        if len(near) > 8:
            # such a set has at least ALIKE of own's paths, so it has one of any that are more than the rest
            rare = sorted(own, key=lambda x: len(self.having.get(x, ())))[: len(own) - math.ceil(ALIKE * len(own)) + 1]
            near = sorted({k for x in rare for k in self.having.get(x, ())})
        best = max(near, key=lambda k: _alike(own, self.sets[k]), default=-1)
        return best if best >= 0 and _alike(own, self.sets[best]) >= ALIKE else -1


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of paths of pages with text: how many pages have each, and the least draw of these."""
    found: dict[tuple[str, bytes], list[int]] = {}

    def flush() -> pa.RecordBatch:
        keys, values = list(found), list(found.values())
        return pa.RecordBatch.from_pydict({"host": pa.array([h for h, _ in keys], pa.string()), "paths": pa.array([x for _, x in keys], pa.binary()), "pages": pa.array([n for n, _ in values], pa.int64()), "draw": pa.array([d for _, d in values], pa.int64())})

    for b in batches:
        for host, page, draw in zip(*(b.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("host", "html", "draw"))):
            tree = parse(page)
            if next(_texts(tree), None) is None:
                continue
            own = paths(tree)
            key = host, np.sort(np.fromiter(own, np.int64, len(own))).tobytes()
            n, least = found.get(key, (0, draw))
            found[key] = [n + 1, min(least, draw)]
            if len(found) > 20_000:
                yield flush()
                found.clear()
    if found:
        yield flush()


def _layouts(group: pa.Table) -> pa.Table:
    """Of sets of paths those that begin a layout, with the number of its pages."""
    group = group.sort_by([("pages", "descending"), ("draw", "ascending"), ("paths", "ascending")])
    found, first, pages = Likeness(), [], []
    for at, (x, n) in enumerate(zip(group.column("paths"), group.column("pages").to_pylist())):
        own = set(np.frombuffer(x.as_py(), np.int64).tolist())
        k = found.find(own)
        if k < 0:
            found.add(own)
            first.append(at)
            pages.append(n)
        else:
            pages[k] += n
    out = group.take(pa.array(first, pa.int64()))
    return pa.table({"host": out.column("host"), "paths": out.column("paths"), "pages": pa.array(pages, pa.int64()), "draw": out.column("draw")})


def _texts(root: Node) -> Iterator[Node]:
    stack = [root]
    while stack:
        n = stack.pop()
        if n.label == "":
            yield n
        stack += n.kids[::-1]


def _hidden(label: str) -> bool:
    tag, _, classes = label.partition(".")
    return tag in HIDDEN or bool(HIDDEN_CLASSES.intersection(classes.lower().split()))


def content(page: Node, constant: set[int]) -> tuple[str, int, int, int]:
    """(text of the slots, number of slots, of template nodes left out, of text nodes left out by their label); blocks are lines."""
    lines: list[list[str]] = [[]]
    slots = left = hidden = 0
    stack: list[Node | None] = [page]
    while stack:
        n = stack.pop()
        if n is None:
            lines.append([])
        elif n.label == "":
            if n.number in constant:
                left += 1
            else:
                slots += 1
                lines[-1].append(n.text)
        elif _hidden(n.label):
            hidden += sum(1 for _ in _texts(n))
        else:
            block = n.label.partition(".")[0] in BLOCK
            stack += ([None] if block else []) + n.kids[::-1] + ([None] if block else [])
    return "\n".join(" ".join(x) for x in lines if x), slots, left, hidden


class Aligner:
    """Aligns pages with their hosts' templates; the hosts last used and the templates last used are kept parsed."""

    def __init__(self):
        self.matcher = Matcher()
        self.hosts: dict[str, tuple[Likeness, list[str], list[int]]] = {}
        self.templates: dict[tuple[str, int], tuple[Node, dict[int, str], frozenset[str]]] = {}

    def host(self, host: str, template: bytes | None) -> tuple[Likeness, list[str], list[int]]:
        """By layout: the paths, the page, and its first number. Numbers differ between layouts."""
        if host not in self.hosts:
            if len(self.hosts) >= TEMPLATES_KEPT:
                del self.hosts[next(iter(self.hosts))]
            alike, firsts, first = Likeness(), [], 0
            pages = json.loads(zlib.decompress(template)) if template is not None else []
            for page in pages:
                tree = _number(parse(page), first)
                firsts.append(first)
                first = tree.number + 1
                alike.add(paths(tree))
            self.hosts[host] = alike, pages, firsts
        return self.hosts[host]

    def template(self, host: str, template: bytes | None, layout: int) -> tuple[Node, dict[int, str], frozenset[str]]:
        """The tree, its texts by number, and the set of them."""
        if (host, layout) not in self.templates:
            _, pages, firsts = self.host(host, template)
            tree = _number(parse(pages[layout]), firsts[layout])
            texts = {n.number: n.text for n in _texts(tree)}
            known = frozenset(texts.values())
            self.matcher.prepare(tree, known)
            if len(self.templates) >= TEMPLATES_KEPT:
                del self.templates[next(iter(self.templates))]
            self.templates[host, layout] = tree, texts, known
        return self.templates[host, layout]

    def __call__(self, host: str, template: bytes | None, page: str) -> tuple[Node, int]:
        """The page's tree, with numbers, and its layout, or -1 if it has none."""
        tree = parse(page)
        layout = self.host(host, template)[0].find(paths(tree)) if template is not None else -1
        if layout >= 0:
            try:
                self.matcher.prepare(tree, self.template(host, template, layout)[2])
            except OverflowError:  # too many shapes are remembered: start anew
                self.matcher = Matcher()
                self.templates.clear()
                self.matcher.prepare(tree, self.template(host, template, layout)[2])
            self.matcher.match(self.template(host, template, layout)[0], tree)
        return tree, layout


def _sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows of each batch by host."""
    for b in batches:
        host = b.column("host").to_pylist()
        columns = {c: b.column(c) for c in b.schema.names}
        for k in sorted(range(b.num_rows), key=host.__getitem__):
            yield {c: v[k].as_py() for c, v in columns.items()}


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    align = Aligner()
    counts: dict[tuple[str, int, int], int] = {}  # at node -1 the layout's pages

    def flush() -> pa.RecordBatch:
        keys = list(counts)
        return pa.RecordBatch.from_pydict({"host": pa.array([h for h, _, _ in keys], pa.string()), "layout": pa.array([k for _, k, _ in keys], pa.int32()), "node": pa.array([n for _, _, n in keys], pa.int32()), "same": pa.array(list(counts.values()), pa.int64())})

    for r in _sorted(batches):
        tree, layout = align(r["host"], r["template"], r["html"])
        texts = list(_texts(tree))
        if layout >= 0 and texts:
            known = align.template(r["host"], r["template"], layout)[1]
            for n in (-1, *(n.number for n in texts if n.number >= 0 and known[n.number] == n.text)):
                key = r["host"], layout, n
                counts[key] = counts.get(key, 0) + 1
        if len(counts) > 200_000:
            yield flush()
            counts.clear()
    if counts:
        yield flush()


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    align = Aligner()
    rows: list[tuple] = []
    size = 0
    names = ["page_id", "host", "content", "slots", "template_nodes", "hidden_nodes"]
    types = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
    flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
    for r in _sorted(batches):
        text, slots, left, hidden = content(align(r["host"], r["template"], r["html"])[0], set(r["constant"] or ()))
        rows.append((r["page_id"], r["host"], text, slots, left, hidden))
        size += len(text)
        if size > 4 << 20:
            yield flush()
            rows, size = [], 0
    if rows:
        yield flush()


def _templates(group: pa.Table) -> pa.Table:
    found = group.sort_by([("pages", "descending"), ("draw", "ascending")]).column("html").to_pylist()
    return pa.table({"host": pa.array([group.column("host")[0].as_py()], pa.string()), "template": pa.array([zlib.compress(json.dumps(found).encode(), 1)], pa.binary())})


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """For every row of pages: page_id, host, content (text of its slots, a line for each block), slots, template_nodes (text nodes
    left out as template) and hidden_nodes (text nodes left out because of an element's label, HIDDEN or HIDDEN_CLASSES).

    The host is the URL's, in lower case, without port and user; pages without a URL, or with one that has no host, share
    the empty host. A null or empty page has an empty content and no slot, and is neither template nor counted among a layout's
    pages. A layout of one page, and a page of no layout, have no template nodes. Repeated rows are extracted each for itself. Other columns are not read, no rows give no rows."""
    host = F.regexp_extract(F.lower(F.coalesce(F.col(url_col), F.lit(""))), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    p = pages.select(F.col(id_col).cast("bigint").alias("page_id"), host.alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    p = p.withColumn("draw", F.xxhash64("html"))  # by it a template's page is found again
    kind = "host string, paths binary, pages bigint, draw bigint"
    signed = p.where(F.col("html").rlike("\\S")).select("host", "html", "draw").mapInArrow(_signed, kind)
    signed = table(signed.groupBy("host", "paths").agg(F.sum("pages").alias("pages"), F.min("draw").alias("draw")), "paths")
    begin = signed.df
    if (begin.groupBy("host").count().agg(F.max("count")).first()[0] or 0) > SETS:
        blocks = F.ceil(F.count("*").over(Window.partitionBy("host")) / SETS)
        begin = begin.withColumn("block", F.pmod(F.xxhash64("paths"), blocks)).groupBy("host", "block").applyInArrow(_layouts, kind)
    begin = begin.groupBy("host").applyInArrow(_layouts, kind).where(F.col("pages") > 1)
    found = table(begin.select(F.col("host").alias("h"), F.col("draw").alias("d"), "pages"), "layouts")
    signed.drop()
    least = F.broadcast(found.df) if found.bytes <= BROADCAST_BYTES else found.df
    heads = p.join(least, (F.col("host") == F.col("h")) & (F.col("draw") == F.col("d"))).groupBy("host", "draw").agg(F.min("html").alias("html"), F.max("pages").alias("pages"))
    templates = table(heads.groupBy("host").applyInArrow(_templates, "host string, template binary"), "templates")

    def joined(t: DataFrame, size: int) -> DataFrame:
        t = t.withColumnRenamed("host", "h")
        return p.join(F.broadcast(t) if size <= BROADCAST_BYTES else t, F.col("host") == F.col("h"), "left").drop("h")

    pairs = joined(templates.df, templates.bytes)
    same = pairs.select("host", "html", "template").mapInArrow(_counted, "host string, layout int, node int, same bigint").groupBy("host", "layout", "node").agg(F.sum("same").alias("same"))
    pages_of = F.max(F.when(F.col("node") == -1, F.col("same"))).over(Window.partitionBy("host", "layout"))
    same = same.withColumn("pages", pages_of).where((F.col("node") >= 0) & (F.col("pages") > 1) & (F.col("same") >= F.col("pages") * CONSTANT))
    constant = same.groupBy("host").agg(F.collect_list("node").alias("constant"))
    wrappers = table(templates.df.join(constant, "host", "left").select("host", "template", "constant"), "wrappers")
    found.drop()
    return joined(wrappers.df, wrappers.bytes).select("page_id", "host", "html", "template", "constant").mapInArrow(_extracted, "page_id bigint, host string, content string, slots int, template_nodes int, hidden_nodes int")
