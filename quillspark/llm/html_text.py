"""Main text of web pages by wrapper induction.

Every page becomes a skeleton: its DOM tree without texts, where siblings of one shape in a row are one repeated node.
Pages of a host that have a skeleton in common are counted; each skeleton of the host is aligned with the host's most
frequent ones of each template (at most 15, found in four rounds) by simple tree matching (Yang, "Identifying Syntactic
Differences Between Two Programs"), and with the best match nodes in the same role share a number. Over all pages of the
host a node whose text never differs is template, one whose text varies is a slot. The region of the content is found by
going down from the root to the child that holds most of the text in slots, until such a child is a paragraph or has
headings or paragraphs that vary beside it. Only where a host tells nothing (one page, or no text that varies) <article>,
<main> or the body stand in. Inside the region template nodes are left out where other nodes vary, and so are menus, page
headers, footers, asides, forms, scripts, adverts, notices and reader comments, which vary too and are known by element,
role or class; headings and paragraphs that never differ stay.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.session import Kept

# Elements of HTML (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
NEVER = frozenset("script style noscript template head title iframe object svg canvas math select option button textarea input audio video nav aside footer form dialog menu".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre".split())
#: Names in class, id or role that mark what is no article text (our own list).
NOISE = re.compile(r"^(?:ads?|advert\w*|adsense|banner\w*|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|side|aside|footer|foot|header|masthead|topbar|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|newsletter|subscribe\w*|signup|comments?|commentlist|respond|disqus\w*|discussion|replies|reply|share\w*|sharing|social\w*|related|recommend\w*|widget\w*|toolbar|search\w*|login|pagination|pager|complementary|contentinfo|navigation|dialog)$")
INLINE = frozenset("br wbr b i em strong a span u s small sub sup font code img".split())
#: New lead skeletons of a host in each round, at most; a skeleton whose places match one by this share needs no further one.
LEADS, LEAD_SHARE = (1, 2, 4, 8), 0.75


class Node:
    __slots__ = ("tag", "noise", "children", "depth")

    def __init__(self, tag: str, noise: bool, depth: int):
        self.tag, self.noise, self.depth, self.children = tag, noise, depth, []


class Tree(HTMLParser):
    """A DOM tree with the implied ends that matter for text. Children are nodes and strings.

    path holds the open nodes, open those of each tag and blocks the block elements of them, so no tag walks the ancestors.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", False, 0)
        self.path, self.open, self.blocks = [self.root], defaultdict(list), []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in CLOSES_P:
            self._close(("p",), stop=("table", "td", "th", "caption", "button", "object"))
        if tag == "li":
            self._close(("li",), stop=("ul", "ol", "menu"))
        elif tag in ("dt", "dd"):
            self._close(("dt", "dd"), stop=("dl",))
        elif tag in ("td", "th"):
            self._close(("td", "th"), stop=("table", "tr"))
        elif tag == "tr":
            self._close(("tr",), stop=("table",))
        elif tag == "option":
            self._close(("option",), stop=("select",))
        words = " ".join(v for k, v in attrs if k in ("class", "id", "role") and v)
        noise = tag in NEVER or any(k == "hidden" for k, _ in attrs) or any(NOISE.match(p) for w in words.lower().split() for p in (w, *re.split(r"[-_]+", w)))
        node = Node(tag, noise and tag not in ("html", "body", "article", "main"), len(self.path))
        if tag == "header" and not self._deepest(("article", "main")):
            node.noise = True
        self.path[-1].children.append(node)
        if tag not in VOID:
            self.path.append(node)
            self.open[tag].append(node)
            if tag in BLOCK:
                self.blocks.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        at = self._deepest((tag,))
        # an inline end tag doesn't close blocks
        if at and (tag in BLOCK or not self.blocks or self.blocks[-1].depth < at):
            self._leave(at)

    def handle_data(self, data: str) -> None:
        self.path[-1].children.append(data)

    def _deepest(self, tags: tuple) -> int:
        """Depth of the deepest open node with one of the tags, or 0."""
        return max((self.open[t][-1].depth for t in tags if self.open.get(t)), default=0)

    def _leave(self, depth: int) -> None:
        while len(self.path) > depth:
            x = self.path.pop()
            self.open[x.tag].pop()
            if x.tag in BLOCK:
                self.blocks.pop()

    def _close(self, tags: tuple, stop: tuple) -> None:
        at = self._deepest(tags)
        if at > self._deepest(stop):
            self._leave(at)


def parse(page: str) -> Node:
    t = Tree()
    # a tag that the page's end cuts off is no text
    cut = re.search(r"<[a-zA-Z/!][^<>]*$", page)
    t.feed(page[: cut.start()] if cut else page)
    t.close()
    return t.root


Skeleton = list  # [tag, noise, [children]]
Numbered = list  # (tag, noise, children's numbers) of each node, in pre-order


def skeleton(root: Node, slots: dict[int, int] | None = None) -> Numbered:
    """The tree of elements, siblings in a row with equal shapes merged. slots gets the number of each node, in pre-order;
    merged siblings share theirs."""
    kids: dict[int, list[Node]] = {}
    shape: dict[int, int] = {}
    sizes: dict[int, int] = {}
    known: dict[tuple, int] = {}
    todo = [root]
    while todo:
        x = todo[-1]
        if id(x) not in kids:  # inline elements are part of their block's text
            kids[id(x)] = [c for c in x.children if not isinstance(c, str) and (c.noise or c.tag not in INLINE or any(isinstance(g, Node) and g.tag in BLOCK for g in c.children))]
            todo += kids[id(x)]
            continue
        todo.pop()
        own = [shape[id(c)] for c in kids[id(x)]]
        own = tuple(s for k, s in enumerate(own) if not k or own[k - 1] != s)
        shape[id(x)] = mine = known.setdefault((x.tag, x.noise, own), len(known))
        sizes[mine] = 1 + sum(sizes[s] for s in own)
    out: list = [None] * sizes[shape[id(root)]]
    work = [(root, 0)]
    while work:
        x, k = work.pop()
        if slots is not None:
            slots[id(x)] = k
        numbers, last, at = [], None, k + 1
        for c in kids[id(x)]:
            s = shape[id(c)]
            if s != last:
                numbers.append(at)
                last, at = s, at + sizes[s]
            work.append((c, numbers[-1]))
        out[k] = (x.tag, int(x.noise), numbers)
    return out


def written(s: Numbered) -> str:
    """A skeleton as text: tag, noise and number of children of each node, so that deep trees don't nest."""
    return json.dumps([[t, z, len(c)] for t, z, c in s], separators=(",", ":"))


def read(text: str) -> Numbered:
    out: list = []
    above: list = []  # [children's numbers, how many are missing]
    for k, (t, z, n) in enumerate(json.loads(text)):
        while above and not above[-1][1]:
            above.pop()
        if above:
            above[-1][0].append(k)
            above[-1][1] -= 1
        out.append((t, z, []))
        above.append([out[k][2], n])
    return out


def numbered(s: Skeleton) -> Numbered:
    """The same of nested lists."""
    out: list = []
    todo = [(s, None)]
    while todo:
        x, up = todo.pop()
        if up is not None:
            up.append(len(out))
        out.append((x[0], x[1], []))
        todo += [(c, out[-1][2]) for c in reversed(x[2])]
    return out


def longest(rows, before) -> Iterator:
    """Rows of the table of best sums, each from the one before; a row of weights for each of a's children."""
    for w in rows:
        if len(w) > 64:
            before = np.maximum.accumulate(np.maximum(before, np.concatenate(([0], np.asarray(before)[:-1] + w))))
        else:
            now = [0]
            for t, v in enumerate(w):
                now.append(max(now[t], before[t + 1], before[t] + v))
            before = now
        yield before


class Matching:
    """Simple tree matching of two trees over all children: equal shapes match whole, equal ends of two lists are taken
    off, and the rest is aligned row by row; rows in between are kept at every square root, so memory is not squared."""

    def __init__(self, x: Numbered, y: Numbered):
        known: dict[tuple, int] = {}
        self.nodes: list[tuple] = []  # of each shape: (tag, noise), children's shapes
        self.size: list[int] = []
        self.of = tuple([0] * len(t) for t in (x, y))
        self.trees, self.memo = (x, y), {}
        for t, of in zip(self.trees, self.of, strict=True):
            for k in range(len(t) - 1, -1, -1):
                key = (t[k][:2], tuple([of[c] for c in t[k][2]]))
                if key not in known:
                    known[key] = len(known)
                    self.nodes.append(key)
                    self.size.append(1 + sum(self.size[c] for c in key[1]))
                of[k] = known[key]
        self.whole = self._solve(self.of[0][0], self.of[1][0])

    def _ends(self, a: int, b: int) -> tuple[int, int, tuple, tuple]:
        """(children that are equal at the beginning, at the end, what lies between on both sides)."""
        p, q = self.nodes[a][1], self.nodes[b][1]
        n, lo, hi = min(len(p), len(q)), 0, 0
        while lo < n and p[lo] == q[lo]:
            lo += 1
        while hi < n - lo and p[len(p) - 1 - hi] == q[len(q) - 1 - hi]:
            hi += 1
        return lo, hi, p[lo : len(p) - hi], q[lo : len(q) - hi]

    def _weight(self, a: int, b: int) -> int | None:
        if a == b:
            return self.size[a]
        return 0 if self.nodes[a][0] != self.nodes[b][0] else self.memo.get((a, b))

    def _rows(self, p: tuple, q: tuple) -> Iterator:
        """Weights of each of p against all of q; one row for each shape."""
        kinds = list(dict.fromkeys(q))
        at = {b: k for k, b in enumerate(kinds)}
        where = np.array([at[b] for b in q]) if len(q) > 64 else [at[b] for b in q]
        rows: dict = {}
        for a in p:
            if a not in rows:
                w = [self._weight(a, b) for b in kinds]
                rows[a] = np.array(w)[where] if len(q) > 64 else [w[k] for k in where]
            yield rows[a]

    def _solve(self, a: int, b: int) -> int:
        todo = [(a, b)] if self._weight(a, b) is None else []
        while todo:
            i, j = todo[-1]
            if (i, j) in self.memo:
                todo.pop()
                continue
            lo, hi, p, q = self._ends(i, j)
            missing = [(s, t) for s in dict.fromkeys(p) for t in dict.fromkeys(q) if self._weight(s, t) is None]
            if missing:
                todo += missing
                continue
            todo.pop()
            ends = self.nodes[i][1]
            total = 1 + sum(self.size[s] for s in (*ends[:lo], *ends[len(ends) - hi :]))
            if p and q:
                for row in longest(self._rows(p, q), [0] * (len(q) + 1)):
                    pass
                total += int(row[-1])
            self.memo[i, j] = total
        return self._weight(a, b)

    def _children(self, a: int, b: int) -> list[tuple[int, int]]:
        """Positions of the children that are matched."""
        lo, hi, p, q = self._ends(a, b)
        out = [(k, k) for k in range(lo)]
        m, n = len(self.nodes[a][1]), len(self.nodes[b][1])
        out += [(m - 1 - k, n - 1 - k) for k in range(hi)]
        if not (p and q):
            return out
        step = int(len(p) ** 0.5) + 1
        marks = {0: [0] * (len(q) + 1)}
        for s, row in enumerate(longest(self._rows(p, q), marks[0]), 1):
            if s % step == 0:
                marks[s] = row
        t, first = len(q), (len(p) - 1) // step * step
        for base in range(first, -1, -step):
            s = min(len(p), base + step)
            block = [marks[base], *longest(self._rows(p[base:s], q), marks[base])]
            while s > base and t:
                if block[s - base][t] == block[s - 1 - base][t]:
                    s -= 1
                elif block[s - base][t] == block[s - base][t - 1]:
                    t -= 1
                else:
                    s, t = s - 1, t - 1
                    out.append((lo + s, lo + t))
        return out

    def share(self) -> float:
        """Matched nodes of all nodes on both sides."""
        return 2 * self.whole / (len(self.of[0]) + len(self.of[1]))

    def kinds(self) -> float:
        """Share of the first tree's places (tags from the root) that have a match, however often they occur."""
        known: dict[tuple, int] = {}
        of = [known.setdefault((-1, self.trees[0][0][:2]), 0)] * len(self.of[0])
        for k, (_, _, children) in enumerate(self.trees[0]):
            for c in children:
                of[c] = known.setdefault((of[k], self.trees[0][c][:2]), len(known))
        return len({of[k] for k in self.pairs()}) / len(known)

    def pairs(self) -> dict[int, int]:
        out: dict[int, int] = {}
        (x, y), todo = self.trees, [(0, 0)] if self.whole else []
        cache: dict = {}
        while todo:
            i, j = todo.pop()
            a, b = self.of[0][i], self.of[1][j]
            if a == b:
                out |= {i + k: j + k for k in range(self.size[a])}
                continue
            out[i] = j
            if (a, b) not in cache:
                cache[a, b] = self._children(a, b)
            todo += [(x[i][2][s], y[j][2][t]) for s, t in cache[a, b]]
        return out


def simple_tree_matching(a: Skeleton, b: Skeleton) -> dict[int, int]:
    """Numbers of a's nodes with those of b that they match in the largest matching that keeps order and ancestry."""
    return Matching(numbered(a), numbered(b)).pairs()


def inside(node: Node, enter) -> Iterator[tuple[int, Node | str]]:
    """What lies below a node in the page's order: (0, string), (1, node) at its beginning and (2, node) at its end. Nodes that
    enter refuses are left out with all below."""
    todo: list = [iter(node.children)]
    open_: list = [node]
    while todo:
        c = next(todo[-1], None)
        if c is None:
            todo.pop()
            x = open_.pop()
            if open_:
                yield 2, x
        elif isinstance(c, str):
            yield 0, c
        elif enter(c):
            yield 1, c
            todo.append(iter(c.children))
            open_.append(c)


def own_texts(node: Node, slots: dict[int, int], out: dict[int, list[str]]) -> None:
    """Text of each node of the skeleton, without that of deeper ones."""
    mine: list = [[]]

    def end(x: Node) -> None:
        text = " ".join("".join(mine.pop()).split())
        if text:
            out.setdefault(slots[id(x)], []).append(text)

    for what, c in inside(node, lambda c: True):
        if what == 0:
            mine[-1].append(c)
        elif id(c) in slots:
            if what == 1:
                mine.append([])
            else:
                end(c)
    end(node)


def digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def regions(root: Node, test) -> list[Node]:
    """The topmost nodes that pass the test, outside of noise; without a test <article>, or else <main>."""
    tops: list[Node] = []

    for t in (test,) if test else (lambda c: c.tag == "article", lambda c: c.tag == "main"):

        def enter(c: Node, t=t) -> bool:
            if not c.noise and t(c):
                tops.append(c)
                return False
            return not c.noise

        for _ in inside(root, enter):
            pass
        if tops:
            break
    return tops


def content(page: str, template: frozenset[int] = frozenset(), region: int | None = None) -> str:
    """Text of the blocks of the article; template and region are numbers of skeleton nodes."""
    root = parse(page)
    slots: dict[int, int] = {}
    if template or region is not None:
        skeleton(root, slots)
    tops = (regions(root, lambda c: slots.get(id(c)) == region) if region is not None else []) or regions(root, None) or regions(root, lambda c: c.tag == "body")
    blocks: list[str] = []
    run: list[str] = []

    def end() -> None:
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            blocks.append(text)

    for top in tops or [root]:
        for what, c in inside(top, lambda c: c.tag == "br" or not c.noise and slots.get(id(c)) not in template):
            if what == 0:
                run.append(c)
            elif c.tag == "br":
                run.append(" " * (what == 1))
            elif c.tag in BLOCK:
                end()
        end()
    return "\n".join(blocks)


def page_host(url) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)), F.lit(""))


def page_key(page: F.Column) -> F.Column:
    return F.xxhash64(F.coalesce(page, F.lit("")))


def best_lead(own: str, flat: Numbered, leads: list) -> tuple[int, Matching]:
    """(shape, matching) of the lead that a skeleton matches best; the earlier one of equals."""
    best = None
    for r in sorted(leads, key=lambda r: r["skeleton"] != own):
        if best is None or best[1].share() < 1:
            m = Matching(flat, read(r["skeleton"]))
            if best is None or m.share() > best[1].share():
                best = (r["shape"], m)
    return best


def lead_skeletons(shapes: DataFrame, kept: Kept) -> DataFrame:
    """(host, leads: array of (rank, shape, skeleton)): the most frequent skeleton of each host, and in further rounds the most
    frequent ones of those whose places match no lead yet by LEAD_SHARE."""

    def like(own: str, flat: Numbered, refs: list) -> bool:
        return any(own == r["skeleton"] for r in refs) or any(Matching(flat, read(r["skeleton"])).kinds() >= LEAD_SHARE for r in refs)

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for refs in b.column(1).to_pylist():
                out.append([])
                for r in refs:
                    if not like(r["skeleton"], read(r["skeleton"]), out[-1]):
                        out[-1].append(r)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, b.column(1).type)], names=["host", "leads"])

    def unlike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[tuple, bool] = {}
        for b in batches:
            keep = []
            for own, refs in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                key = (own, *[r["shape"] for r in refs])
                if key not in memo:
                    if len(memo) > 4096:
                        memo.clear()
                    memo[key] = not like(own, read(own), refs)
                keep.append(memo[key])
            yield pa.RecordBatch.from_arrays(b.columns[:4], names=b.schema.names[:4]).filter(pa.array(keep, pa.bool_()))

    rest, rounds = shapes, []
    for k, n in enumerate(LEADS):
        rank = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("pages"), "shape"))
        top = rest.withColumn("rank", rank).where(F.col("rank") <= n).select("host", F.struct((F.col("rank") + 100 * k).alias("rank"), "shape", "skeleton").alias("lead"))
        now = top.groupBy("host").agg(F.array_sort(F.collect_list("lead")).alias("leads"))  # at most n rows of a host
        now = kept.keep(now.mapInArrow(apart, now.schema), "leads")
        rounds.append(now)
        if k + 1 < len(LEADS):
            rest = rest.join(now, "host").select("host", "shape", "pages", "skeleton", "leads").mapInArrow(unlike, "host string, shape long, pages long, skeleton string")
            rest = kept.keep(rest, "unlike")
            if rest.isEmpty():
                break
    every = rounds[0]
    for r in rounds[1:]:
        every = every.unionByName(r)
    return every.groupBy("host").agg(F.array_sort(F.flatten(F.collect_list("leads"))).alias("leads"))  # at most sum(LEADS) rows of a host


def induce(pages: DataFrame, kept: Kept, url: str, page: str) -> tuple[DataFrame, DataFrame]:
    """(pages with host and shape, wrappers by host and shape: numbers of template nodes and of the region)."""
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                shapes, nodes = [], []
                for x in b.column(0).to_pylist():
                    root, slots, texts = parse(x or ""), {}, {}
                    s = written(skeleton(root, slots))
                    own_texts(root, slots, texts)
                    shapes.append((digest(s), s))
                    nodes.append([{"node": k, "text": digest("\n".join(v)), "size": sum(map(len, v))} for k, v in sorted(texts.items())])
                cols = [pa.array([s for s, _ in shapes], pa.int64()), pa.array([s for _, s in shapes]), pa.array(nodes, NODES_ARROW)]
                yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), *cols], names=["host", "page", "shape", "skeleton", "nodes"])

    seen = pages.select(F.col(f"`{page}`").alias("x"), page_host(F.col(f"`{url}`")).alias("host"), page_key(F.col(f"`{page}`")).alias("page")).mapInArrow(look, "host string, page long, shape long, skeleton string, nodes array<struct<node:int,text:bigint,size:bigint>>")
    seen = kept.keep(seen, "seen")
    # partial sums by host, shape and node: a host may hold any share of the pages
    flat = seen.select("host", "shape", F.explode("nodes").alias("n"))
    stats = kept.keep(flat.groupBy("host", "shape", "n.node").agg(F.count("*").alias("pages"), F.min("n.text").alias("lo"), F.max("n.text").alias("hi"), F.sum("n.size").alias("size")), "stats")
    shapes = kept.keep(seen.groupBy("host", "shape").agg(F.count("*").alias("pages"), F.first("skeleton").alias("skeleton")), "shapes")
    leads = lead_skeletons(shapes, kept)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[tuple, tuple] = {}
        for b in batches:
            found = []
            for own, refs in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                key = (own, *[r["shape"] for r in refs])
                if key not in memo:
                    if len(memo) > 4096:
                        memo.clear()
                    flat, above = read(own), {}
                    lead, m = best_lead(own, flat, refs)
                    pairs = m.pairs()
                    for k, (_, _, children) in enumerate(flat):
                        above |= dict.fromkeys(children, k)
                    memo[key] = (lead, [{"own": k, "ref": pairs.get(k, -1 - k), "up": above.get(k, -1), "tag": t, "noise": bool(z)} for k, (t, z, _) in enumerate(flat)])
                found.append(memo[key])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x for x, _ in found], pa.int64()), pa.array([m for _, m in found], ALIGNED_ARROW)], names=["host", "shape", "lead", "map"])

    aligned = shapes.join(leads, "host").select("host", "shape", "skeleton", "leads").mapInArrow(align, "host string, shape long, lead long, map array<struct<own:int,ref:int,up:int,tag:string,noise:boolean>>")
    aligned = kept.keep(aligned.select("host", "shape", "lead", F.explode("map").alias("m")).select("host", "shape", "lead", "m.*"), "aligned")
    known = aligned.join(stats.select("host", "shape", F.col("node").alias("own"), "pages", "lo", "hi", "size"), ["host", "shape", "own"], "left")
    known = known.join(shapes.groupBy("host").agg((F.sum("pages") > 1).alias("several")), "host")
    # a node that no other skeleton matches stands for itself
    ref = F.when(F.col("ref") >= 0, F.col("ref").cast("long")).otherwise(F.xxhash64("shape", "own"))
    known = known.withColumn("ref", ref)
    slot = known.groupBy("host", "lead", "ref").agg(F.sum("pages").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    known = known.join(slot.select("host", "lead", "ref", "n", (F.col("lo") == F.col("hi")).alias("same")), ["host", "lead", "ref"])
    # what a single page of a larger host holds tells no template, so it counts as varying
    varies = F.coalesce(~F.col("same") | (F.col("several") & (F.col("n") == 1)), F.lit(False)) & ~F.col("noise")
    constant = F.coalesce(F.col("same") & (F.col("n") >= 3) & ~F.col("tag").isin(*HEADING), F.lit(False))
    node = F.struct("own", "up", "tag", "noise", F.when(varies, F.col("size")).otherwise(0).alias("size"), constant.alias("constant"), F.col("same").isNotNull().alias("texts"))
    trees = known.groupBy("host", "shape").agg(F.collect_list(node).alias("tree"))  # the nodes of one skeleton

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [wrapper({n["own"]: n for n in t}) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([t for t, _ in found], pa.list_(pa.int32())), pa.array([r for _, r in found], pa.int32())], names=["host", "shape", "template", "region"])

    wrappers = trees.mapInArrow(decide, "host string, shape long, template array<int>, region int")
    # pages whose host tells something of them
    told = seen.select("host", "shape", "page").join(wrappers, ["host", "shape"]).where((F.size("template") > 0) | F.col("region").isNotNull())
    return told.select("host", "page", "template", "region").dropDuplicates(["host", "page"])


NODES_ARROW = pa.list_(pa.struct([("node", pa.int32()), ("text", pa.int64()), ("size", pa.int64())]))
ALIGNED_ARROW = pa.list_(pa.struct([("own", pa.int32()), ("ref", pa.int32()), ("up", pa.int32()), ("tag", pa.string()), ("noise", pa.bool_())]))


def wrapper(nodes: dict[int, dict], share: float = 0.7) -> tuple[list[int], int | None]:
    """(template nodes, region) of one skeleton, whose numbers are in pre-order; the region is None where no text varies.

    A node is template if its text and that of all nodes below is constant, provided that other text varies. The region is
    reached from the root through children that hold at least that share of the varying text outside noise; the way ends
    above a heading or paragraph, and where one that varies lies beside the next child.
    """
    noise, total, below = {}, {}, defaultdict(list)
    for k in sorted(nodes):
        n = nodes[k]
        noise[k] = bool(n["noise"]) or noise.get(n["up"], False)
        total[k] = 0 if noise[k] else n["size"] or 0
        below[n["up"]].append(k)
    fixed = {k: n["constant"] or not n["texts"] for k, n in nodes.items()}
    some = {k: n["constant"] for k, n in nodes.items()}
    for k in sorted(nodes, reverse=True):
        up = nodes[k]["up"]
        if up in total:
            total[up] += total[k]
            fixed[up] &= fixed[k]
            some[up] |= some[k]
    whole, at = total.get(0, 0), 0
    if not whole:
        return [], None
    while True:
        most = next((k for k in below[at] if total[k] >= share * whole), None)
        if most is None or nodes[most]["tag"] in HEADING or any(total[k] and nodes[k]["tag"] in HEADING for k in below[at] if k != most):
            return [k for k in sorted(nodes) if fixed[k] and some[k]], at
        at = most


def extract(pages: DataFrame, url: str = "url", page: str = "html", out: str = "text") -> DataFrame:
    """pages with the main text of each whole page; empty where there is none. Null pages are empty; null urls share a host.

    A column of that name is replaced, all others stay. Pages of any length and depth are read whole; of lead skeletons that
    are as frequent the one with the smaller digest comes first; repeated rows have the same text; an empty table gives an
    empty one. Wrappers join the pages by host and a hash of the page, so a large host is spread; the pages themselves are
    shuffled once at most.
    """
    kept = Kept(pages.sparkSession, "html-text")
    pages = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c != out])
    wrappers = kept.keep(induce(pages, kept, url, page), "wrappers")
    names = pages.columns
    at = names.index(page)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                x, t, r = (b.column(k).to_pylist() for k in (at, len(names), len(names) + 1))
                texts = [content(p or "", frozenset(i or ()), j) for p, i, j in zip(x, t, r, strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(texts, pa.string())], names=[*names, out])

    joined = pages.withColumn("__host", page_host(F.col(f"`{url}`"))).withColumn("__page", page_key(F.col(f"`{page}`")))
    joined = joined.join(wrappers, (F.col("__host") == wrappers["host"]) & (F.col("__page") == wrappers["page"]), "left")
    joined = joined.select(*[pages[f"`{c}`"] for c in names], wrappers["template"].alias("__template"), wrappers["region"].alias("__region"))
    return joined.mapInArrow(take, T.StructType([*pages.schema.fields, T.StructField(out, T.StringType(), False)]))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


QUERIES = {"op4_html_text": op4_html_text}
ORACLES: dict[str, str] = {}
