"""HTML extraction by wrapper induction: pages of a host are aligned by simple tree matching; constant nodes are template."""

from __future__ import annotations

import bisect
import collections
import functools
import hashlib
import html
import re
from collections.abc import Generator, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmeter.llm.common import join_small, materialize, slices

#: Fixed values of HTML: elements without content, raw-text elements, and elements that end an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Elements that are no part of a text.
DROPPED = frozenset("script style noscript template iframe svg math head title nav header footer aside form button select option textarea input label menu dialog object embed canvas audio video".split())
#: Words in class, id and role that name such parts.
DROPPED_NAMES = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted promotion related replies respond reply share sharing sidebar skip social sponsor sponsored subscribe subscription toolbar topbar widget complementary contentinfo search".split())
#: A start tag of one of these ends open ones of those.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|([^\s=/>\"']+)")
NAME = re.compile(r"[a-z]+")
#: Distinct pages of a host from which a node with one text in all of them is template, and the share that must have it.
LEAST_PAGES, LEAST_SHARE = 5, 0.9
#: Of two alignments the one with more nodes in equal subtrees wins, then the one with more nodes, however many there are.
EQUAL = 1 << 31
#: Cells of a table of matches that is kept whole; of a larger one only the rows between PARTS parts are, and parts are filled
#: again. Numbers of rows of matches that a page keeps; dropped ones are found again. No result depends on either.
CELLS, PARTS, KEPT_ROWS = 1 << 18, 64, 1 << 25
#: Hosts whose reference trees a task keeps.
KEPT_HOSTS = 64


class Page:
    """Elements of a page in order (tag, dropped), and events: an element opens (i), closes (~i), or text."""

    __slots__ = ("tags", "dropped", "events")

    def __init__(self):
        self.tags, self.dropped, self.events = [], [], []


def tag_end(text: str, at: int) -> tuple[int, bool]:
    """Where the tag's `>` is, not within quotes; if all later ones are quoted, the first of all, and False."""
    place = at
    while m := STOP.search(text, place):
        if m[0] == ">":
            return m.start(), True
        close = text.find(m[0], m.end())
        # A quote that nothing closes is a character like others.
        place = close + 1 if close >= 0 else m.end()
    return text.find(">", at), False


def parse(text: str) -> Page:
    """The elements of a page, with HTML's rules for those whose end may be left out; never fails, in linear time."""
    page = Page()
    events = page.events
    stack: list[int] = []  # open elements
    places: dict[str, list[int]] = {}  # where each tag lies in the stack
    blocks: list[int] = []  # where blocks lie in the stack
    last, quotes = text.rfind(">"), True

    def pop(to: int) -> None:
        while len(stack) > to:
            i = stack.pop()
            tag = page.tags[i]
            places[tag].pop()
            if tag in BLOCK:
                blocks.pop()
            events.append(~i)

    at, n = 0, len(text)
    while at < n:
        begin = text.find("<", at)
        if begin < 0 or begin > last:
            events.append(text[at:])
            break
        if begin > at:
            events.append(text[at:begin])
        at = begin
        if text.startswith("<!--", at):
            end = text.find("-->", at + 4)
            at = n if end < 0 else end + 3
            continue
        if text.startswith(("<!", "<?"), at):
            at = text.find(">", at) + 1
            continue
        m = TAG.match(text, at)
        if m is None:
            events.append("<")
            at += 1
            continue
        if quotes:
            end, quotes = tag_end(text, m.end())
        else:
            end = text.find(">", m.end())
        if end < 0:
            events.append(text[at:])
            break
        tag, attributes, at = m[2].lower(), text[m.end() : end], end + 1
        if m[1]:
            held = places.get(tag)
            # An end tag of inline markup doesn't close the blocks around it.
            if held and (tag in BLOCK or not blocks or held[-1] > blocks[-1]):
                pop(held[-1])
            continue
        if tag in BLOCK:
            # A new block ends an open paragraph, with the inline elements that were left open in it.
            if blocks and page.tags[stack[blocks[-1]]] == "p":
                pop(blocks[-1])
            ends = ENDS.get(tag)
            while ends and stack and page.tags[stack[-1]] in ends:
                pop(len(stack) - 1)
        dropped = tag in DROPPED
        if attributes and not attributes.isspace():
            told = {k.lower() or b.lower(): x or y or z for k, x, y, z, b in ATTRIBUTE.findall(attributes)}
            names = " ".join(told.get(k, "") for k in ("class", "id", "role")).lower()
            if names.strip():
                if tag not in ("html", "body", "article", "main"):
                    dropped |= not DROPPED_NAMES.isdisjoint(NAME.findall(names))
            dropped |= "hidden" in told or told.get("aria-hidden") == "true" or "display:none" in told.get("style", "").replace(" ", "")
        i = len(page.tags)
        page.tags.append(tag)
        page.dropped.append(dropped)
        events.append(i)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(text, at)
            events += [text[at : end.start() if end else n], ~i]
            at = end.end() if end else n
        elif tag in VOID or attributes.rstrip().endswith("/"):
            events.append(~i)
        else:
            places.setdefault(tag, []).append(len(stack))
            if tag in BLOCK:
                blocks.append(len(stack))
            stack.append(i)
    pop(0)
    return page


def tidy(text: str) -> str:
    return " ".join(html.unescape(text).split())


def mark(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(errors="surrogatepass"), digest_size=8).digest(), "little", signed=True)


class Tree:
    """The blocks of a page in order: parents, labels and marks of texts (of text leaves; 0 for elements).

    Labels are tags alone: classes and ids often name the page, and would keep its nodes from their places on the host.

    form tells subtrees of the same labels, whole those of the same labels and texts; count is the nodes of a subtree.
    """

    __slots__ = ("parent", "label", "mark", "children", "form", "whole", "count")

    def __init__(self, parent: list[int], label: list[int], marks: list[int]):
        n = len(parent)
        self.parent, self.label, self.mark = parent, label, marks
        self.children: list[list[int]] = [[] for _ in range(n)]
        for i in range(1, n):
            self.children[parent[i]].append(i)
        self.form, self.whole, self.count = [0] * n, [0] * n, [1] * n
        for i in range(n - 1, -1, -1):
            below = self.children[i]
            self.form[i] = hash((label[i], *(self.form[c] for c in below)))
            self.whole[i] = hash((label[i], marks[i], *(self.whole[c] for c in below)))
            self.count[i] += sum(self.count[c] for c in below)

    def data(self) -> bytes:
        return np.array(self.label, np.int64).tobytes() + np.array(self.mark, np.int64).tobytes() + np.array(self.parent, np.int32).tobytes()

    @staticmethod
    def of(data: bytes) -> Tree:
        n = len(data) // 20
        wide = np.frombuffer(data, np.int64, 2 * n).tolist()
        return Tree(np.frombuffer(data, np.int32, n, 16 * n).tolist(), wide[:n], wide[n:])

    def paths(self) -> list[int]:
        """A hash of the labels from the root to each node."""
        out: list[int] = []
        for i, label in enumerate(self.label):
            out.append(hash((out[self.parent[i]] if i else 0, label)))
        return out


@functools.lru_cache(100_000)
def label_mark(label: str) -> int:
    return mark(label)


def skeleton(page: Page) -> tuple[Tree, list[tuple[int, str]]]:
    """The tree of a page's blocks, and its article: (text leaf, text) in order.

    The article lies in the outermost article and main elements, or is the whole page where there are none. Dropped parts
    are left out, inline markup belongs to its block, and each run of text between blocks is a leaf.
    """
    tags, dropped, events = page.tags, page.dropped, page.events

    def shown() -> Iterator[int | str]:
        skipped = -1
        for e in events:
            if skipped >= 0:
                skipped = -1 if e == ~skipped else skipped
            elif isinstance(e, int) and e >= 0 and dropped[e]:
                skipped = e
            else:
                yield e

    whole = not any(isinstance(e, int) and e >= 0 and tags[e] in ("article", "main") for e in shown())
    parent, label, marks, open_, texts = [0], [label_mark("#root")], [0], [0], []
    words: list[str] = []
    text_label, collecting, outermost = label_mark("#text"), whole, -1

    def flush() -> None:
        text = tidy("".join(words))
        words.clear()
        if text:
            texts.append((len(parent), text))
            parent.append(open_[-1])
            label.append(text_label)
            marks.append(mark(text))

    for e in shown():
        if isinstance(e, str):
            if collecting:
                words.append(e)
        elif e >= 0:
            if tags[e] == "br":
                words.append(" ")
            elif tags[e] in BLOCK:
                flush()
                parent.append(open_[-1])
                label.append(label_mark(tags[e]))
                marks.append(0)
                open_.append(len(parent) - 1)
                if not collecting and tags[e] in ("article", "main"):
                    collecting, outermost = True, e
        elif tags[~e] in BLOCK:
            flush()
            open_.pop()
            if ~e == outermost:
                collecting, outermost = False, -1
    flush()
    return Tree(parent, label, marks), texts


class Group:
    """Forms of one label at one depth of a page, with the places of their children in the level below, one form after the other."""

    def __init__(self, page: Tree, level: Level, places: list[int], below: Level):
        self.all = np.array(places, np.int64)
        kids = [(k, [below.code[page.form[c]] for c in page.children[level.nodes[k]]]) for k in places]
        kids = [(k, codes) for k, codes in kids if codes]
        self.columns = np.array([k for k, _ in kids], np.int64)
        self.kids = np.array([c for _, codes in kids for c in codes], np.int64)
        lengths = np.array([len(codes) for _, codes in kids], np.int64)
        self.longest = int(lengths.max(initial=0))
        self.ends = lengths.cumsum() - 1
        self.starts = self.ends + 1 - lengths
        self.owner = np.repeat(np.arange(len(kids)), lengths)
        # How often each form has each kind of child.
        kinds = [(n, code, times) for n, (_, codes) in enumerate(kids) for code, times in collections.Counter(codes).items()]
        self.kind_owner, self.kind, self.times = np.array(kinds, np.int64).reshape(-1, 3).T

    def largest(self, weights: np.ndarray, n: int) -> np.ndarray:
        """For each form the best total of n equal children: the sum of its n largest weights."""
        w = weights[self.kind].astype(np.int64)
        order = np.lexsort((-w, self.kind_owner))
        times, first = self.times[order], np.searchsorted(self.kind_owner, np.arange(len(self.columns)))
        before = times.cumsum() - times
        taken = np.clip(n - (before - before[first][self.kind_owner]), 0, times)
        return np.add.reduceat(taken * w[order], first)


class Level:
    """The distinct forms at one depth of a page: nodes, places by form, places by label."""

    def __init__(self, page: Tree, nodes: list[int]):
        self.code: dict[int, int] = {}
        self.nodes: list[int] = []
        self.labels: dict[int, list[int]] = {}
        self.groups: dict[int, Group] = {}
        for q in nodes:
            if page.form[q] not in self.code:
                self.labels.setdefault(page.label[q], []).append(len(self.nodes))
                self.code[page.form[q]] = len(self.nodes)
                self.nodes.append(q)


class Memo(dict):
    """Rows of matches of a reference with one page, by depth and form of the reference's subtree (see row)."""

    def __init__(self):
        super().__init__()
        self.numbers, self.levels = 0, []

    def level(self, page: Tree, depth: int) -> Level:
        while len(self.levels) <= depth:
            self.levels.append(Level(page, [c for q in self.levels[-1].nodes for c in page.children[q]] if self.levels else [0]))
        return self.levels[depth]

    def row(self, a: Tree, p: int, page: Tree, depth: int) -> np.ndarray:
        """Nodes of the largest match of subtree p with each form at a depth of the page."""
        kept = self.get((depth, a.form[p]))
        if kept is not None:
            return kept
        # Generators stand for calls, as pages may be deeper than calls.
        open_, value = [self._row(a, p, page, depth)], None
        while open_:
            try:
                p, depth = open_[-1].send(value)
            except StopIteration as done:
                open_.pop()
                value = done.value
                continue
            value = self.get((depth, a.form[p]))
            if value is None:
                open_.append(self._row(a, p, page, depth))
        return value

    def _row(self, a: Tree, p: int, page: Tree, depth: int) -> Generator[tuple[int, int], np.ndarray, np.ndarray]:
        """Asks for the rows of children, one at a time."""
        level, below = self.level(page, depth), self.level(page, depth + 1)
        out, label = np.zeros(len(level.nodes), np.int32), a.label[p]
        if label in level.labels:
            if label not in level.groups:
                level.groups[label] = Group(page, level, level.labels[label], below)
            group = level.groups[label]
            out[group.all] = 1
            # Children whose label the level below lacks match nothing.
            kids = [c for c in a.children[p] if a.label[c] in below.labels] if len(group.kids) else []
            if len({a.form[c] for c in kids}) == 1:
                out[group.columns] += group.largest((yield kids[0], depth + 1), len(kids))
            elif kids:
                # Each form's totals lie above all those of the form before, so one running maximum serves all.
                floor = np.arange(len(group.columns)) * (a.count[p] + 1)
                last, form, run = floor[group.owner], None, 0
                ahead = np.empty_like(last)
                for c in kids:
                    if a.form[c] != form:
                        w, form, run = (yield c, depth + 1)[group.kids], a.form[c], 0
                    run += 1
                    # Of equal children in a row no more than the longest list has can match.
                    if run <= group.longest:
                        ahead[1:] = last[:-1]
                        ahead[group.starts] = floor
                        ahead += w
                        np.maximum(ahead, last, out=ahead)
                        np.maximum.accumulate(ahead, out=last)
                out[group.columns] += last[group.ends] - floor
        if self.numbers > KEPT_ROWS:
            self.clear()
            self.numbers = 0
        self[depth, a.form[p]] = out
        self.numbers += len(out) + 32
        return out


class Weights:
    """Weights of the matches of children x of one node with children y of another, row by row."""

    def __init__(self, a: Tree, x: list[int], page: Tree, y: list[int], depth: int, memo: Memo):
        self.a, self.x, self.page, self.depth, self.memo = a, x, page, depth, memo
        code = memo.level(page, depth).code
        self.code = np.array([code[page.form[q]] for q in y], np.int64)
        places: dict[int, list[int]] = {}
        for k, q in enumerate(y):
            places.setdefault(page.whole[q], []).append(k)
        self.equal = {w: np.array(places[w]) for w in {a.whole[p] for p in x} & places.keys()}
        self.rows: dict[int, np.ndarray] = {}

    def row(self, i: int) -> np.ndarray:
        node = self.x[i]
        form = self.a.form[node]
        if form not in self.rows:
            if len(self.rows) * len(self.code) > CELLS:
                self.rows.clear()
            self.rows[form] = self.memo.row(self.a, node, self.page, self.depth)[self.code].astype(np.int64)
        w, equal = self.rows[form], self.equal.get(self.a.whole[node])
        if equal is not None:
            w = w.copy()
            w[equal] *= 1 + EQUAL
        return w

    def after(self, last: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The best totals with each beginning of the columns, after one more row."""
        out = np.zeros_like(last)
        new = out[1:]
        np.add(last[:-1], w[: len(new)], out=new)
        np.maximum(new, last[1:], out=new)
        np.maximum.accumulate(new, out=new)
        return out

    def pairs(self) -> list[tuple[int, int]]:
        """Rows and columns of a best alignment, the same however a table is divided."""
        out, j = [], len(self.code)
        todo = [(0, len(self.x), np.zeros(j + 1, np.int64))]
        while todo and j:
            lo, hi, last = todo.pop()
            last = last[: j + 1]
            if (hi - lo) * j > CELLS and hi - lo > 1:
                step = -(-(hi - lo) // PARTS)
                for begin in range(lo, hi, step):
                    todo.append((begin, min(begin + step, hi), last))
                    for i in range(begin, begin + step if begin + step < hi else begin):
                        last = self.after(last, self.row(i))
                continue
            weights = [self.row(i) for i in range(lo, hi)]
            held = [last]
            for w in weights:
                held.append(self.after(held[-1], w))
            i = hi - lo
            while i and j:
                w = weights[i - 1][j - 1]
                if w and held[i][j] == held[i - 1][j - 1] + w:
                    i, j = i - 1, j - 1
                    out.append((lo + i, j))
                elif held[i][j] == held[i - 1][j]:
                    i -= 1
                else:
                    j -= 1
        return out


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of pairs in the order of their first numbers, a longest run whose second ones rise."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        place = bisect.bisect_left(tops, j)
        back[k] = at[place - 1] if place else -1
        tops[place : place + 1], at[place : place + 1] = [j], [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def matched(a: Tree, i: int, b: Tree, j: int, memo: Memo) -> int:
    """Nodes of the largest match of two subtrees that keeps labels, ancestors and order (simple tree matching), for any sizes."""
    depth, above = 0, j
    while above:
        depth, above = depth + 1, b.parent[above]
    place = memo.level(b, depth).code[b.form[j]]
    return int(memo.row(a, i, b, depth)[place])


def slots(page: Tree, reference: Tree, memo: Memo) -> list[int]:
    """The node of the reference that each node of the page is aligned with, or -1."""
    out = [-1] * len(page.parent)
    out[0], todo = 0, [(0, 0, 0)]
    while todo:
        i, j, depth = todo.pop()
        n = page.count[j]
        if reference.whole[i] == page.whole[j]:
            out[j : j + n] = range(i, i + n)
            continue
        x, y = reference.children[i], page.children[j]
        same = lambda p, q: reference.whole[p] == page.whole[q]
        head, least = 0, min(len(x), len(y))
        while head < least and same(x[head], y[head]):
            head += 1
        tail = 0
        while tail < least - head and same(x[-1 - tail], y[-1 - tail]):
            tail += 1
        met = [(x[k], y[k]) for k in range(head)] + [(x[-1 - k], y[-1 - k]) for k in range(tail)]
        x, y = x[head : len(x) - tail], y[head : len(y) - tail]
        if len(x) == len(y) == 1:
            met += [(x[0], y[0])] if reference.label[x[0]] == page.label[y[0]] else []
        elif x and y:
            met += [(x[k], y[m]) for k, m in Weights(reference, x, page, y, depth + 1, memo).pairs()]
        for p, q in met:
            out[q] = p
        todo += [(p, q, depth + 1) for p, q in met]
    return out


def keys(page: Tree, texts: list[tuple[int, str]], reference: Tree) -> list[int]:
    """What each text leaf counts as: its node in the reference and its text; without such a node its labels and text."""
    at, paths = slots(page, reference, Memo()), None
    out = []
    for leaf, _ in texts:
        place = at[leaf]
        if place < 0:
            paths = paths or page.paths()
            place = paths[leaf]
        out.append(hash((place, page.mark[leaf])))
    return out


def extract(text: str, template: frozenset[int] = frozenset(), reference: Tree | None = None) -> str:
    """The blocks of the page's article in order, without those that the host's template holds."""
    tree, texts = skeleton(parse(text))
    if not template or reference is None:
        return "\n\n".join(t for _, t in texts)
    held = keys(tree, texts, reference)
    return "\n\n".join(t for (_, t), key in zip(texts, held, strict=True) if key not in template)


class References:
    """The trees of hosts, as far as a task keeps them."""

    def __init__(self):
        self.held: dict[str, Tree] = {}

    def get(self, host: str, data: pa.Scalar) -> Tree:
        if host not in self.held:
            if len(self.held) >= KEPT_HOSTS:
                self.held.clear()
            self.held[host] = Tree.of(data.as_py())
        return self.held[host]


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page's digest and tree."""
    for whole in batches:
        for batch in slices(whole, "html"):
            pages = batch.column(1).to_pylist()
            trees = [skeleton(parse(t))[0].data() for t in pages]
            digests = [hashlib.blake2b(t.encode(), digest_size=16).digest() for t in pages]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(trees, pa.binary())], names=["host", "digest", "tree"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct keys of each page's text leaves."""
    references, text = References(), label_mark("#text")
    for batch in batches:
        at, out = [], []
        for i, (host, data) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            tree = Tree.of(data)
            leaves = [(k, "") for k, x in enumerate(tree.label) if x == text and tree.mark[k]]
            held = set(keys(tree, leaves, references.get(host, batch.column(2)[i])))
            at += [i] * len(held)
            out += held
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(out, pa.int64())], names=["host", "key"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    references = References()
    for whole in batches:
        for batch in slices(whole, "html"):
            texts = []
            for i, (text, host, marks) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 3, 4)), strict=True)):
                texts.append(extract(text or "", frozenset(marks), references.get(host, batch.column(5)[i])) if marks else extract(text or ""))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def host_of(url: str) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def wrappers(pages: DataFrame) -> DataFrame:
    """host, marks, reference: the constant text nodes of each host, counted over all its distinct pages (host, html).

    Pages are made distinct by digest. The one of the smallest digest is the host's reference; every page's tree is aligned
    with it, so a text leaf has a place: its node in the reference, or, where it has none, its own labels. A leaf that has
    one place and text in LEAST_SHARE of the pages is constant. Counts are exact, follow neither partitions nor row order,
    and are added up before they are shuffled, so a host may have any share of the pages.
    """
    told = pages.mapInArrow(_trees, "host string, digest binary, tree binary")
    distinct = materialize(told.groupBy("host", "digest").agg(F.first("tree").alias("tree")), "trees")
    hosts = distinct.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.min_by("tree", "digest").alias("reference")).where(F.col("pages") >= LEAST_PAGES)
    hosts = materialize(hosts, "hosts")
    aligned = join_small(distinct.select("host", "tree"), hosts.select("host", "reference"), "host", "inner").mapInArrow(_keys, "host string, key long")
    counts = aligned.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n"))
    often = F.when(F.col("n") >= F.col("pages") * LEAST_SHARE, F.col("key"))
    # Pages in which nothing varies are copies of one page, and tell nothing.
    found = join_small(counts, hosts.select("host", "pages"), "host", "inner").groupBy("host").agg(F.sort_array(F.collect_list(often)).alias("marks"), F.bool_or(F.col("n") < F.col("pages")).alias("varied"))
    return found.where("varied and size(marks) > 0").join(hosts.select("host", "reference"), "host").select("host", "marks", "reference")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of each row's whole html.

    The text is the page's article (or main element; without one the body) without menus, headers, footers, sidebars,
    notices, adverts, forms, scripts, styles and comments, and without blocks that are constant on the host: those that
    simple tree matching puts in one place with one text in LEAST_SHARE of its distinct pages, if it has LEAST_PAGES at
    least and something varies. Nodes match by tag and order; classes and ids only tell what is dropped. Matching is exact for pages of
    any size, so its time grows with the product of the blocks of a page and its reference at each depth, and nothing is cut off.
    Character references are decoded; white space inside a block becomes one space; blocks are joined by two newlines. Null
    html: empty, so is its text; a null or odd url has host '' and no template. Repeated rows stay, and count once for a
    template; other columns are ignored; an empty table gives no rows.
    """
    source = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html"), F.col(url_col).alias("url"), host_of(url_col).alias("host"))
    told = materialize(wrappers(source.where("host <> '' and html is not null").select("host", "html")), "wrappers")
    joined = join_small(source, told, "host", "left").select("page_id", "html", "url", "host", "marks", "reference")
    kinds = {c: source.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return joined.mapInArrow(_extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
