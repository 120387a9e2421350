"""HTML extraction by wrapper induction.

A page is read into a tree of its block elements with their text blocks (references
decoded, white space made one space, trimmed). Siblings of one label (tag, class with its
digits made alike, and whether it is boilerplate by kind or name) that follow each other
are folded to one node, so a page is a small tree.

Pages of one host are aligned by simple tree matching: of two nodes with equal labels, the
children are paired in order so that as many nodes as possible match.

1. Each host's wrapper is the alignment of its REFERENCE pages of least hash, equal pages
   once, in that order: the same tree however the rows are partitioned, and of bounded size.
   Its nodes are the host's slots.
2. Every page of the host is aligned with the wrapper, and texts, characters and pages are
   counted by slot; a node without a slot counts for the one above it. Counts are plain
   sums over all pages, exact and combined map-side, so no task sees all pages of a host.
3. A text that is on SHARE of a slot's pages, and surely (95 %) on half of such pages, is
   template; what varies is content. Where nearly all texts of an article or body recur (a
   host of copies), none is template.
4. The host's content lies in the slot to which one comes from the root by going, as long
   as there is one, to the container that holds MASS of the varying characters. What lies in
   other slots (menus, adverts, notices, footers, be they constant or not) is left out by
   its place. An article or main part is not entered further, and a varying headline
   beside the way is kept.

Pages of hosts of one page, or whose texts are spread, have their content taken from their
articles (else the main part, else the body). Within the content, elements that are
boilerplate by kind, role or name are left out; within an article a name must say so itself
(adverts, comments, consent, ...), and all other names are left to the wrapper.

Defined results: null or empty html gives an empty text; urls without a host have no
wrapper; unclosed and misnested elements are closed as browsers do; repeated rows are
extracted each; an empty table gives an empty one; names that begin with `__hx_` are its
own. `__hx_blocks` counts a page's text blocks and `__hx_placed` those that the wrapper
alone left out (as template, or by their place).
"""

from __future__ import annotations

import hashlib
import pickle
import re
from bisect import insort
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulon.llm.runtime import table, written

REFERENCE, SHARE, MASS, SALTS = 16, 0.85, 0.7, 16
#: No text on fewer pages than this is surely on half of them.
SURE = 4
#: Elements nested deeper are read as if each ended where it begins.
DEPTH = 250
#: Where more of an article's texts than this recur, the host's pages are copies.
COPIES = 0.8

# Kinds of elements and names.
DROPPED = frozenset("head script style noscript template iframe object embed svg canvas form button input select textarea option datalist nav aside footer menu dialog audio video map".split())
RAW = frozenset("script style noscript template iframe textarea title svg noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul caption title".split()
)
CLOSED_BY_BLOCK = frozenset(["p"])
CLOSES_P = BLOCKS - frozenset("html head body td th tr tbody thead tfoot caption option optgroup legend title summary".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}, "option": {"option"}, "body": {"head"}}
SCOPES = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select", "datalist"}, "body": set()}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
NAMES = re.compile(
    r"(?:^|[-_\s])(ads?|advert\w*|adsense|adslot|banner|sponsor\w*|promo\w*|side-?bar|menu|nav|navbar|navigation|breadcrumbs?|masthead|header|footer|notice|notification|alert|cookies?|consent|gdpr|pop-?up|modal|overlay|comments?|comment-?list|disqus|respond|replies|share|sharing|social|related|recommend\w*|newsletter|subscri\w+|sign-?up|login|search|widget|pagination|pager|toolbar|skip-?link)(?=$|[-_\s])",
    re.I,
)
#: Names that say even within an article that an element is no part of it.
WITHIN = re.compile(r"(?:^|[-_\s])(ads?|advert\w*|adsense|adslot|banner|sponsor\w*|promo\w*|side-?bar|nav|navbar|navigation|breadcrumbs?|cookies?|consent|gdpr|pop-?up|modal|comments?|comment-?list|disqus|respond|replies|newsletter)(?=$|[-_\s])", re.I)
DIGITS = re.compile(r"\d+")
#: Elements that hold others; of the rest none is the whole content.
CONTAINERS = frozenset("html body div section article main center table tbody tr td".split())
NOT_MAIN = re.compile(r"(?:^|[-_\s])(?:comments?|reply|ads?|advert\w*|sponsor\w*|promo\w*|related|teaser)(?:$|[-_\s])", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
SPACE = re.compile(r"\s+")


class Node:
    """A block element. kids: nodes and texts, in page order."""

    __slots__ = ("tag", "label", "dropped", "by_name", "kids")

    def __init__(self, tag: str, label: str, dropped: bool, by_name: bool = False):
        self.tag, self.label, self.dropped, self.by_name, self.kids = tag, label, dropped, by_name, []


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(raw):
        out.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return out


def made(tag: str, raw: str, inside: str | None) -> Node:
    """inside: article or main, where the element is in one. A name alone drops an element only while no article or main part begins in it, and a header's name not within one."""
    label, dropped, by_name = tag, tag in DROPPED or tag == "header" and not inside, False
    if raw and not raw.isspace() and raw != "/":
        a = attributes(raw)
        names = f"{a.get('id', '')} {a.get('class', '')}"
        label = f"{tag}.{' '.join(sorted(DIGITS.sub('0', a['class']).split()))}" if a.get("class") else tag
        if tag in ("article", "main"):
            dropped = bool(NOT_MAIN.search(names))
        elif tag not in ("html", "body"):
            found = {m[1].lower() for m in (WITHIN if inside == "article" else NAMES).finditer(names)}
            by_name = bool(found - {"header", "masthead"} if inside else found)
        dropped = dropped or a.get("role", "").lower() in ROLES or "hidden" in a or a.get("aria-hidden") == "true" or bool(HIDDEN.search(a.get("style", "")))
    return Node(tag, label, dropped or by_name, by_name and not dropped)


def tree(html: str) -> Node:
    root = Node("", "", False)
    stack, text = [root], []

    def flush() -> None:
        if text:
            block = "".join(text)
            text.clear()
            block = SPACE.sub(" ", unescape(block) if "&" in block else block).strip()
            if block:
                stack[-1].kids.append(block)

    def close(upto: int) -> None:
        flush()
        del stack[upto:]

    at, n, lower = 0, len(html), None
    hidden: list[str] = []  # inline elements whose text does not count
    while at < n:
        m = TOKEN.match(html, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            own = m[0]
            if own[0] != "<" or own == "<":
                if not hidden:
                    text.append(own)
            continue
        tag = tag.lower()
        if m[1]:
            if hidden and tag == hidden[-1]:
                hidden.pop()
            elif tag in BLOCKS:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        close(k)
                        hidden.clear()
                        break
            continue
        if tag == "br" or tag == "hr" and tag not in BLOCKS:
            text.append(" ")
            continue
        if tag in RAW:
            lower = lower or html.lower()
            end = lower.find("</" + tag, at)
            end = n if end < 0 else end
            at = html.find(">", end) + 1 or n
            continue
        if tag in BLOCKS:
            flush()
            if tag in CLOSES_P and stack[-1].tag in CLOSED_BY_BLOCK:
                close(len(stack) - 1)
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in SCOPES.get(tag, ()):
                    break
                if stack[k].tag in CLOSES.get(tag, ()):
                    close(k)
                    if tag not in ("tr", "tbody", "tfoot"):
                        break
            node = made(tag, m[3], next((t for t in ("article", "main") if any(s.tag == t for s in stack)), None))
            if tag in ("article", "main") and not node.dropped:
                for above in stack:
                    above.dropped = above.dropped and not above.by_name
            stack[-1].kids.append(node)
            if tag not in VOID and len(stack) < DEPTH:
                stack.append(node)
        elif tag not in VOID and (tag in DROPPED or m[3] and made(tag, m[3], "article").dropped) and not m[3].endswith("/"):
            if not hidden:
                text.append(" ")
            hidden.append(tag)
        elif hidden and tag == hidden[-1]:
            hidden.append(tag)
    flush()
    return root


# Folded trees: [label, children, nodes of the page]. Wrappers: [label, children, slot].


def number(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def folded(node: Node) -> list:
    """Siblings of one label that follow each other are one node."""
    kids: list[list] = []
    for kid in node.kids:
        if isinstance(kid, Node):
            own = folded(kid)
            if kids and kids[-1][0] == own[0]:
                kids[-1] = merged(kids[-1], own)
            else:
                kids.append(own)
    return [node.label + "!" * node.dropped, kids, [node]]


def matching(a: list[list], b: list[list], known: dict | None = None) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching of two lists of children: (nodes matched, pairs). known: counts of pairs of nodes, for one alignment."""
    known = {} if known is None else known

    def within(x: list, y: list) -> int:
        key = (id(x), id(y))
        if key not in known:
            known[key] = 1 + matching(x[1], y[1], known)[0] if x[1] and y[1] else 1
        return known[key]

    if [x[0] for x in a] == [x[0] for x in b]:
        return sum(map(within, a, b)), [(k, k) for k in range(len(a))]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    own: dict[tuple[int, int], int] = {}
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            score = max(best[i][j + 1], best[i + 1][j])
            if x[0] == y[0]:
                own[i, j] = within(x, y)
                score = max(score, best[i][j] + own[i, j])
            best[i + 1][j + 1] = score
    pairs, i, j = [], len(a), len(b)
    while i and j:
        if (i - 1, j - 1) in own and best[i][j] == best[i - 1][j - 1] + own[i - 1, j - 1]:
            i, j = i - 1, j - 1
            pairs.append((i, j))
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return best[-1][-1], pairs[::-1]


def merged(a: list, b: list, known: dict | None = None) -> list:
    """Two folded trees of one label, aligned."""
    known = {} if known is None else known
    kids, i, j = [], 0, 0
    for x, y in [*matching(a[1], b[1], known)[1], (len(a[1]), len(b[1]))]:
        kids += a[1][i:x] + b[1][j:y]
        if x < len(a[1]):
            kids.append(merged(a[1][x], b[1][y], known))
        i, j = x + 1, y + 1
    return [a[0], kids, a[2] + b[2]]


def bare(tree_: list) -> list:
    return [tree_[0], [bare(k) for k in tree_[1]], []]


def numbered(wrapper: list) -> list:
    """With slots: numbers in page order."""
    n = 0

    def slot(w: list) -> list:
        nonlocal n
        n += 1
        own = n
        return [w[0], [slot(k) for k in w[1]], own]

    return slot(wrapper)


def slots_of(page: list, wrapper: list) -> dict[int, int]:
    """By id of a page's node: its slot, or that of the node above it."""
    out: dict[int, int] = {}
    known: dict = {}

    def place(tree_: list, own: list | None, slot: int) -> None:
        slot = own[2] if own else slot
        for node in tree_[2]:
            out[id(node)] = slot
        pairs = dict(matching(tree_[1], own[1], known)[1]) if own else {}
        for k, kid in enumerate(tree_[1]):
            place(kid, own[1][pairs[k]] if k in pairs else None, slot)

    place(page, wrapper, wrapper[2])
    return out


def nodes_of(node: Node) -> Iterator[Node]:
    yield node
    for kid in node.kids:
        if isinstance(kid, Node):
            yield from nodes_of(kid)


def counted(html: str, wrapper: list) -> dict[tuple[int, int | None], list[int]]:
    """A page's counts, by slot and text (None: all of the slot): pages, characters, texts."""
    page = tree(html)
    slots = slots_of(folded(page), wrapper)
    out: dict[tuple[int, int | None], list[int]] = {}
    for node in nodes_of(page):
        whole = out.setdefault((slots[id(node)], None), [1, 0, 0])
        for text in node.kids:
            if isinstance(text, str):
                whole[1] += len(text)
                own = out.setdefault((slots[id(node)], number(text)), [1, 0, 1])
                own[1] += len(text)
                whole[2] += own[1] == len(text)  # each text once
    return out


class Plan:
    """A host's wrapper with its template texts (slot, number) and its content slots."""

    def __init__(self, wrapper: list, slots: dict[int, tuple[int, int, int]], common: dict[tuple[int, int], tuple[int, int]]):
        """slots: pages, characters, texts; common: pages and characters of template texts."""
        self.wrapper, self.template, self.roots = wrapper, set(common), set()
        recur: dict[int, tuple[int, int]] = {}
        for (slot, _), (n, chars) in common.items():
            a, b = recur.get(slot, (0, 0))
            recur[slot] = (a + n, b + chars)

        def texts(w: list) -> tuple[int, int]:
            """(places of texts that recur, of all texts)"""
            return tuple(map(sum, zip((recur.get(w[2], (0, 0))[0], slots.get(w[2], (0, 0, 0))[2]), *map(texts, w[1]), strict=True)))

        def spare(w: list) -> None:
            recurring, every = texts(w)
            if w[0].split(".")[0] in ("article", "main", "body") and recurring > COPIES * every:
                inside = {x[2] for x in self._below(w)}
                self.template = {t for t in self.template if t[0] not in inside}
            else:
                for k in w[1]:
                    spare(k)

        spare(wrapper)
        lost = {s: recur[s][1] for s in {s for s, _ in self.template}}
        self.mass = {w[2]: slots.get(w[2], (0, 0, 0))[1] - lost.get(w[2], 0) for w in self._below(wrapper)}
        self._descend(wrapper)

    def _below(self, w: list) -> Iterator[list]:
        yield w
        for k in w[1]:
            yield from self._below(k)

    def _whole(self, w: list) -> int:
        """Varying characters of a slot and those below that may be content."""
        return 0 if w[0].endswith("!") else self.mass[w[2]] + sum(map(self._whole, w[1]))

    def _descend(self, root: list) -> None:
        w, beside = root, []
        while True:
            whole = self._whole(w)
            tag = w[0].split(".")[0]
            found = [k for k in w[1] if self._whole(k) >= MASS * whole and whole and k[0].split(".")[0] in CONTAINERS and self.mass[k[2]] * 2 < self._whole(k)]
            if tag in ("article", "main") or not found:
                break
            beside += [k[2] for k in w[1] if k[0].split(".")[0] in ("h1", "h2") and self.mass[k[2]]]
            w = found[0]
        if w[0].split(".")[0] not in ("", "html", "body"):
            self.roots = {w[2], *beside}


def content(page: Node, plan: Plan | None) -> tuple[str, int, int]:
    """(text, text blocks in the page, blocks that the wrapper left out)"""
    slots = slots_of(folded(page), plan.wrapper) if plan else {}
    template = plan.template if plan else ()
    every = [(node, text) for node in nodes_of(page) for text in node.kids if isinstance(text, str)]

    def tops(node: Node, wanted) -> Iterator[Node]:
        for kid in node.kids:
            if isinstance(kid, Node) and not kid.dropped:
                if wanted(kid):
                    yield kid
                else:
                    yield from tops(kid, wanted)

    def blocks(node: Node) -> Iterator[str]:
        slot = slots.get(id(node))
        for kid in node.kids:
            if isinstance(kid, str):
                if not template or (slot, number(kid)) not in template:
                    yield kid
            elif not kid.dropped:
                yield from blocks(kid)

    def left_out(parts: list[Node] | None) -> int:
        if plan is None:
            return 0
        inside = {id(n) for part in parts for n in nodes_of(part)} if parts is not None else None
        return sum(inside is not None and id(node) not in inside or (slots[id(node)], number(text)) in template for node, text in every)

    if plan and plan.roots:
        parts = list(tops(page, lambda n: slots[id(n)] in plan.roots))
        if found := [b for part in parts for b in blocks(part)]:
            return "\n\n".join(found), len(every), left_out(parts)
    for tag in ("article", "main"):
        found = [b for part in tops(page, lambda n: n.tag == tag) for b in blocks(part)]
        if found:
            break
    else:
        found = list(blocks(page))
    return "\n\n".join(found), len(every), left_out(None)


def host_of(url: Column) -> Column:
    """Lower case, without user, port and the rest; null if there is none."""
    found = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:\[]+)", 1))
    return F.when(found != "", found)


#: Bytes of trees that a task holds before it hands them on.
HELD = 64 << 20


def induce(pages: DataFrame) -> DataFrame:
    """pages: __hx_host, html. A row per host of at least two different pages: __hx_host, __hx_wrapper (pickled)."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[int, bytes]]] = {}
        size = 0

        def out() -> pa.RecordBatch:
            rows = [(host, *x) for host, own in held.items() for x in own]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.binary()), strict=True)], ["__hx_host", "hash", "tree"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for host, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    own = held.setdefault(host, [])
                    key = number(html)
                    if len(own) == REFERENCE and key > own[-1][0] or any(key == k for k, _ in own):
                        continue
                    data = pickle.dumps(bare(folded(tree(html))), 5)
                    insort(own, (key, data))
                    size += len(data)
                    if len(own) > REFERENCE:
                        size -= len(own.pop()[1])
            if size > HELD:
                yield out()
                size = 0
        if held:
            yield out()

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, last, n, wrapper = None, None, 0, None

        def out() -> Iterator[pa.RecordBatch]:
            if n > 1:
                yield pa.RecordBatch.from_arrays([pa.array([host], pa.string()), pa.array([pickle.dumps(numbered(wrapper), 5)], pa.binary())], ["__hx_host", "__hx_wrapper"])

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for own, key, data in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns), strict=True):
                    if own != host:
                        yield from out()
                        host, last, n, wrapper = own, key, 1, pickle.loads(data)
                    elif key != last and n < REFERENCE:
                        last, n, wrapper = key, n + 1, merged(wrapper, pickle.loads(data))
        yield from out()

    found = pages.filter("__hx_host is not null and html <> ''").select("__hx_host", "html").mapInArrow(local, "__hx_host string, hash long, tree binary")
    least = Window.partitionBy("__hx_host", F.pmod("hash", F.lit(SALTS))).orderBy("hash")
    first = found.withColumn("rank", F.dense_rank().over(least)).filter(F.col("rank") <= REFERENCE).drop("rank")
    return first.repartition("__hx_host").sortWithinPartitions("__hx_host", "hash").mapInArrow(align, "__hx_host string, __hx_wrapper binary")


class Loaded:
    """Unpickled values, a bounded number of them."""

    def __init__(self):
        self.known: dict[bytes, object] = {}

    def __call__(self, raw: bytes):
        if raw not in self.known:
            if len(self.known) >= 256:
                self.known.clear()
            self.known[raw] = pickle.loads(raw)
        return self.known[raw]


def plans(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """A row per host that has a wrapper: __hx_host, __hx_plan (pickled)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = Loaded()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                sums: dict[tuple, list[int]] = {}
                for host, html, raw in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    for (slot, text), own in counted(html, loaded(raw)).items():
                        all_ = sums.setdefault((host, slot, text), [0, 0, 0])
                        for k in range(3):
                            all_[k] += own[k]
                rows = [(*key, *own) for key, own in sums.items()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.int32(), *[pa.int64()] * 4))], ["__hx_host", "slot", "text", "n", "chars", "texts"])

    given = pages.filter("__hx_host is not null and html <> ''").select("__hx_host", "html").join(wrappers, "__hx_host")
    sums = given.mapInArrow(count, "__hx_host string, slot int, text long, n long, chars long, texts long").groupBy("__hx_host", "slot", "text").agg(*(F.sum(c).alias(c) for c in ("n", "chars", "texts")))
    # Every slot, and texts on SURE pages at least: what varies is left behind here.
    sums = written(sums.filter(F.col("text").isNull() | (F.col("n") >= SURE)), "slots")
    slots = sums.filter("text is null").select("__hx_host", "slot", F.col("n").alias("pages"), F.struct("slot", "n", "chars", "texts").alias("own"))
    share, z = F.col("n") / F.col("pages"), 1.96**2
    sure = (share + z / 2 / F.col("pages") - F.sqrt(z * (share * (1 - share) / F.col("pages") + z / 4 / F.col("pages") ** 2))) / (1 + z / F.col("pages"))
    common = sums.filter("text is not null").join(slots.drop("own"), ["__hx_host", "slot"]).filter((share >= SHARE) & (sure >= 0.5))
    # A host has few slots, and of texts that most pages have no more than a page has.
    by_host = slots.groupBy("__hx_host").agg(F.collect_list("own").alias("slots"))
    texts = common.groupBy("__hx_host").agg(F.collect_list(F.struct("slot", "text", "n", "chars")).alias("common"))

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                host, raw, own, all_ = (c[k].as_py() for c in batch.columns)
                made = Plan(pickle.loads(raw), {s["slot"]: (s["n"], s["chars"], s["texts"]) for s in own}, {(t["slot"], t["text"]): (t["n"], t["chars"]) for t in all_ or []})
                yield pa.RecordBatch.from_arrays([pa.array([host], pa.string()), pa.array([pickle.dumps(made, 5)], pa.binary())], ["__hx_host", "__hx_plan"])

    return wrappers.join(by_host, "__hx_host").join(texts, "__hx_host", "left").select("__hx_host", "__hx_wrapper", "slots", "common").mapInArrow(plan, "__hx_host string, __hx_plan binary")


def extract(df: DataFrame, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """df with __hx_text, __hx_blocks and __hx_placed; columns of names that begin with `__hx_` are replaced."""
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    df = df.drop(*(c for c in df.columns if c.startswith("__hx_")))
    host = host_of(F.col(url_col))
    pages = df.select(host.alias("__hx_host"), F.col(html_col).alias("html"))
    # Written, so their sizes are known: they are sent to all tasks if they are small, else pages are
    # dealt by host and a host of very many pages is split.
    wrappers = written(induce(pages), "wrappers")
    given = df.withColumn("__hx_host", host).join(written(plans(pages, wrappers), "plans"), "__hx_host", "left").drop("__hx_host")
    at, plan_at = given.columns.index(html_col), given.columns.index("__hx_plan")
    names = [c for c in given.columns if c != "__hx_plan"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = Loaded()
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                rows = [content(tree(html), loaded(raw) if raw is not None else None) if html else ("", 0, 0) for html, raw in zip(part.column(at).to_pylist(), part.column(plan_at).to_pylist(), strict=True)]
                made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(part.columns) if i != plan_at), *made], [*names, "__hx_text", "__hx_blocks", "__hx_placed"])

    fields = [f for f in given.schema.fields if f.name != "__hx_plan"]
    return given.mapInArrow(run, StructType([*fields, StructField("__hx_text", StringType()), StructField("__hx_blocks", LongType()), StructField("__hx_placed", LongType())]))


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("__hx_text").alias("text"), F.length("__hx_text").cast("long").alias("n_chars"), F.col("__hx_blocks").alias("n_blocks"), F.col("__hx_placed").alias("n_placed"))


QUERIES = {"op7_html_extract": op7_html_extract}
