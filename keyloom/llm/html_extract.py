"""HTML extraction by wrapper induction.

1. Every page becomes a tree of its block elements. Siblings of one label (tag, class and id words, role, whether
   hidden) are one repeating node, so elements that differ in what could hide them are never one node. Counts per
   host and node, added up by Spark in any order, give the host's consensus tree: the nodes that at least SHARE of
   its pages have, siblings in their mean order.
2. Every page is aligned with its host's consensus tree by simple tree matching. As labels are unique among
   siblings, the best matching of two nodes' children is a heaviest increasing subsequence, so a page takes n log n
   steps. Texts are counted at the nodes they are matched to.
3. The wrapper of a host says for each node whether it is template or content. Template are texts that at least
   SUPPORT different pages and CONSTANT of all pages matched at the node share, nodes that hold links above all
   (menus, whatever their texts), and furniture: adverts, forms, comments and the like, told by element and class.
   Where the host's article and main elements hold most of its varying text, they alone are content. All other
   slots vary: they are content.
4. A page is aligned again and the texts of its content slots are its main text. A part that matches no node of
   the wrapper varies, too; its own element and class decide, else what it lies in.

Defined results: a null or empty html has no text. A page is never emptied by what its host's pages share: if
nothing at all would be left, constant texts and menus stay. Repeated rows are pages of their own, but count once
as different pages. A host is told by the url's authority, lower-cased; all urls without one (null too) are one
host. An empty table gives an empty one. Pages of any length are read whole, in one pass.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.llm.shared import BROADCAST_BYTES, scratch, written

SHARE, SUPPORT, CONSTANT = 0.1, 8, 0.8
#: A menu: at least this many links a page, and at least this share of the node's characters in links.
MENU_LINKS, MENU_SHARE = 3, 0.6
#: Counts that a task holds before it hands them on.
PARTIAL = 200_000
#: Hosts whose wrappers a task keeps at hand.
WRAPPERS = 500

# Elements by role.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE_ELEMENTS = frozenset("nav footer aside menu dialog button select option textarea input fieldset noscript iframe object svg canvas audio video head title template script style xmp noframes".split())
CONTENT_ELEMENTS = frozenset(("article", "main"))
#: Elements whose text is no markup; what an unclosed one of the first four swallows is lost.
RAW = {n: re.compile(rf"</{n}(?=[\s/>])", re.I) for n in ("script", "style", "xmp", "noframes", "iframe", "title", "textarea")}
CLOSES_P = frozenset("p div ul ol dl table section article aside header footer nav form h1 h2 h3 h4 h5 h6 pre blockquote hr main figure address fieldset".split())
P_STOPS = ("article", "main", "div", "section", "td", "li", "button", "table")
#: Elements that a start tag of the same group closes, and where the search for them ends.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SIBLING_STOPS = ("ul", "ol", "dl", "table", "select")
# Words of class and id names that mark furniture wherever they stand in a name, ...
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored navbar nav navigation menu sidebar footer masthead topbar toolbar breadcrumb breadcrumbs pagination pager cookie cookies consent gdpr popup modal newsletter".split()
)
# ... those of reader comments, ...
COMMENTS = frozenset("comment comments comentarios disqus respond replies".split())
# ... and words that do so alone or beside a word for a box.
LOOSE_MARKS = frozenset("banner side notice notices alert overlay subscribe subscription signup login search share sharing social related recommended recommendations teaser widget promo promotion discussion reply header".split())
BOXES = frozenset("box bar button buttons link links list lists widget widgets area section block wrapper container posts post form panel icons site page top main right left col column".split())
#: A name that says what an element has or lacks, not what it is.
ABOUT = frozenset("has with no without".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())

_NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_TO_END = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>""")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_MAY_HIDE = re.compile("hidden|none", re.I)
_DIGITS = re.compile(r"\d+")

# What an element's own label says: nothing, part of the page's frame, content, furniture, furniture unless it holds an
# article (forms, and what only a name marks), a header (an article's own holds its title), never shown.
NOTHING, FRAME, ARTICLE, FURNITURE_HINT, NAMED, HEADER, HIDDEN_HINT = range(7)
# Roles of nodes.
HIDDEN, FURNITURE, LOOSE, PLAIN, CONTENT = range(5)
ROOT = 0


def marked(name: str) -> int:
    """The hint of one class or id name in lower case."""
    parts = [w for w in re.split(r"[^a-z0-9]+", name) if w]
    if not parts or parts[0] in ABOUT:
        return NOTHING
    if COMMENTS.intersection(parts):
        return FURNITURE_HINT
    if MARKS.intersection(parts):
        return NAMED
    loose = LOOSE_MARKS.intersection(parts)
    if not loose or not all(w in loose or w in BOXES or w.isdigit() for w in parts):
        return NOTHING
    return HEADER if loose == {"header"} else NAMED


@lru_cache(1 << 14)
def described(name: str, attributes: str) -> tuple[str, int]:
    """Label and hint of an element; the hint follows from the label."""
    words: set[str] = set()
    hidden, role = False, ""
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key == "class":
                words.update(value.split())
            elif key == "id" and value:
                words.add("#" + value.strip())
            elif key == "role":
                role = value.strip()
            elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                hidden = True
    names = sorted({_DIGITS.sub("0", w) for w in words})
    hints = {marked(w) for w in names}
    if hidden:
        hint = HIDDEN_HINT
    elif name in ("html", "body"):
        hint = FRAME
    elif name == "header":
        hint = FURNITURE_HINT if FURNITURE_HINT in hints or NAMED in hints else HEADER
    elif name in FURNITURE_ELEMENTS or role in ROLES or FURNITURE_HINT in hints:
        hint = FURNITURE_HINT
    elif NAMED in hints or name == "form":
        hint = NAMED
    elif name in CONTENT_ELEMENTS or role == "main":
        hint = ARTICLE
    else:
        hint = HEADER if HEADER in hints else NOTHING
    return " ".join((name, *names, f"@{role}" if role in ROLES or role == "main" else "", "hidden" if hidden else "")), hint


def role_below(above: int, hint: int) -> int:
    """The role of an element of that hint inside a node of role above."""
    if above == HIDDEN or hint == HIDDEN_HINT:
        return HIDDEN
    if hint == FRAME:
        return PLAIN
    if hint == FURNITURE_HINT or above == FURNITURE:
        return FURNITURE
    if hint == ARTICLE:
        return CONTENT
    return LOOSE if hint == NAMED or (hint == HEADER and above != CONTENT) else above


@lru_cache(1 << 16)
def child_key(parent: int, label: str) -> int:
    return int.from_bytes(hashlib.blake2b(label.encode("utf-8", "surrogatepass"), digest_size=8, salt=parent.to_bytes(8, "little", signed=True)).digest(), "little", signed=True)


def text_key(node: int, text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8, key=node.to_bytes(8, "little", signed=True)).digest(), "little", signed=True)


def tokens(page: str) -> Iterator[tuple[str, str, str, str]]:
    """(text before, "/" of an end tag, name, attributes) of every tag; the last text comes with an empty name.

    Positions only go forward. A tag ends at the first ">" outside quoted values, or, once such an end was missing,
    at the first ">"; a tag or comment that the page's end cuts is dropped.
    """
    begin = at = 0
    quoted, unclosed = True, set()
    while (lt := page.find("<", at)) >= 0:
        if page.startswith(("<!", "<?"), lt):
            mark = "-->" if page.startswith("<!--", lt) else ">"
            end = page.find(mark, lt + 2 if mark == ">" else lt + 4)
            yield page[begin:lt], "", "", ""
            begin = at = end + len(mark) if end >= 0 else len(page)
            continue
        m = _NAME.match(page, lt)
        if m is None:  # a plain "<"
            at = lt + 1
            continue
        gt = page.find(">", m.end())
        yield page[begin:lt], "", "", ""
        if gt < 0:
            return
        attributes = page[m.end() : gt]
        if quoted and ('"' in attributes or "'" in attributes):
            whole = _TO_END.match(page, m.end())
            if whole:
                gt = whole.end() - 1
                attributes = page[m.end() : gt]
            else:
                quoted = False
        name = m[2].lower()
        yield "", m[1], name, attributes
        begin = at = gt + 1
        if name in RAW and not m[1] and name not in unclosed:
            end = RAW[name].search(page, at)
            if end:
                begin = at = end.start()
            elif name in ("title", "textarea", "iframe"):
                unclosed.add(name)
            else:
                return
    yield page[begin:], "", "", ""


class Tree:
    """A page's nodes, parents before children, and its text blocks (node, text, characters in links, links)."""

    def __init__(self) -> None:
        self.keys, self.parents, self.hints, self.places = [ROOT], [-1], [FRAME], [0]
        self.kids: list[dict[str, int]] = [{}]
        self.blocks: list[tuple[int, str, int, int]] = []

    def child(self, parent: int, label: str, hint: int) -> int:
        found = self.kids[parent].get(label)
        if found is None:
            found = len(self.keys)
            self.keys.append(child_key(self.keys[parent], label))
            self.parents.append(parent)
            self.hints.append(hint)
            self.places.append(len(self.kids[parent]))
            self.kids[parent][label] = found
            self.kids.append({})
        return found


def parse(page: str) -> Tree:
    """The page's tree and text blocks; white space in a block is one space."""
    tree = Tree()
    elements: list[tuple[str, int, bool]] = [("", 0, False)]  # open ones: name, node, hidden inline element
    places: dict[str, list[int]] = {}  # of open elements by name
    blocks = [0]  # places of open block elements
    held: list[str] = []
    linked = links = inside_links = inside_hidden = 0

    def flush() -> None:
        nonlocal linked, links
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if text:
                tree.blocks.append((elements[blocks[-1]][1], text, min(linked, len(text)), links))
        linked = links = 0

    def last(names: tuple[str, ...]) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=0)

    def push(name: str, node: int, hidden: bool, block: bool) -> None:
        nonlocal inside_links, inside_hidden
        places.setdefault(name, []).append(len(elements))
        if block:
            blocks.append(len(elements))
        elements.append((name, node, hidden))
        inside_links += name == "a"
        inside_hidden += hidden

    def cut(place: int) -> None:
        """Close the element at a place and all in it."""
        nonlocal inside_links, inside_hidden
        while len(elements) > place:
            name, _, hidden = elements.pop()
            places[name].pop()
            inside_links -= name == "a"
            inside_hidden -= hidden
            if blocks[-1] == len(elements):
                blocks.pop()

    for text, closing, name, attributes in tokens(page):
        if text and not inside_hidden:
            held.append(text)
            if inside_links:
                linked += len(text)
        if not name:
            continue
        if name in INLINE:
            if closing:
                place = last((name,))
                if place > blocks[-1]:
                    cut(place)
                continue
            if name == "a" and places.get("a") and places["a"][-1] > blocks[-1]:
                cut(places["a"][-1])
            links += name == "a"
            push(name, elements[-1][1], bool(_MAY_HIDE.search(attributes)) and described(name, attributes)[1] == HIDDEN_HINT, False)
            continue
        if name in ("br", "wbr"):
            if name == "br":
                held.append(" ")
            continue
        if closing:
            if places.get(name):
                flush()
                cut(places[name][-1])
            elif name == "p":
                flush()
            continue
        flush()
        if name in VOID:
            continue
        if name in CLOSES_P and places.get("p") and places["p"][-1] > last(P_STOPS):
            cut(places["p"][-1])
        if name in SIBLINGS:
            place = last(SIBLINGS[name])
            if place > last(SIBLING_STOPS):
                cut(place)
        label, hint = described(name, attributes)
        push(name, tree.child(elements[blocks[-1]][1], label, hint), False, True)
    flush()
    return tree


def heaviest(ranks: list[int], weights: list[int]) -> tuple[int, list[int]]:
    """Weight and places of the heaviest subsequence of increasing (different) ranks."""
    if all(a < b for a, b in zip(ranks, ranks[1:], strict=False)):
        return sum(weights), list(range(len(ranks)))
    tops: list[int] = []
    best: list[tuple[int, int]] = []  # weight up to the top at the same place, and its own place
    before = [-1] * len(ranks)
    for k, (rank, weight) in enumerate(zip(ranks, weights, strict=True)):
        at = bisect_left(tops, rank)
        total = weight
        if at:
            total += best[at - 1][0]
            before[k] = best[at - 1][1]
        end = at
        while end < len(tops) and best[end][0] <= total:
            end += 1
        if end > at or at == len(tops) or tops[at] != rank:
            tops[at:end], best[at:end] = [rank], [(total, k)]
    k, chosen = best[-1][1], []
    while k >= 0:
        chosen.append(k)
        k = before[k]
    return best[-1][0], chosen[::-1]


def aligned(tree: Tree, ranks: dict[int, int]) -> list[bool]:
    """Which nodes the largest order-preserving matching of the tree with a consensus tree matches.

    ranks: the place of every consensus node among its siblings. Nodes match whose labels on the way from the root
    are equal, so the pairs are known; what is chosen is which of them keep their order.
    """
    n, keys, parents = len(tree.keys), tree.keys, tree.parents
    pair = [keys[0] in ranks] + [False] * (n - 1)
    kids: list[list[int]] = [[] for _ in range(n)]
    for i in range(1, n):
        if pair[parents[i]] and keys[i] in ranks:
            pair[i] = True
            kids[parents[i]].append(i)
    weight, chosen = [1] * n, [[]] * n
    for i in range(n - 1, -1, -1):
        if kids[i]:
            more, places = heaviest([ranks[keys[k]] for k in kids[i]], [weight[k] for k in kids[i]])
            weight[i] += more
            chosen[i] = [kids[i][p] for p in places]
    matched = [pair[0]] + [False] * (n - 1)
    for i in range(n):
        if matched[i]:
            for k in chosen[i]:
                matched[k] = True
    return matched


class Wrapper:
    """A host's nodes with their ranks and roles, the keys of its constant texts, and whether articles alone are content."""

    def __init__(self, keys: list[int], ranks: list[int], roles: list[int], only: bool, fixed: list[int] | None = None):
        self.ranks, self.roles = dict(zip(keys, ranks, strict=True)), dict(zip(keys, roles, strict=True))
        self.only, self.fixed = only, frozenset(fixed or ())

    def read(self, tree: Tree) -> tuple[list[bool], list[int]]:
        """The tree's matched nodes and all nodes' roles."""
        matched = aligned(tree, self.ranks)
        roles = [PLAIN] * len(tree.keys)
        for i in range(1, len(roles)):
            roles[i] = self.roles[tree.keys[i]] if matched[i] else role_below(roles[tree.parents[i]], tree.hints[i])
        return matched, roles


def decided(nodes: list[tuple]) -> tuple[list[int], list[int], list[int], bool]:
    """(keys, ranks, roles, only) of a host's consensus nodes (key, parent, hint, n, place, chars, linked, links)."""
    below: dict[int, list[tuple]] = {}
    for node in nodes:
        if node[0] != ROOT:
            below.setdefault(node[1], []).append(node)
    order = [node for node in nodes if node[0] == ROOT]
    ranks = {ROOT: 0}
    for node in order:  # grows while it is walked: parents before children
        kids = sorted(below.get(node[0], ()), key=lambda x: (x[4] / x[3], x[0]))
        ranks.update((kid[0], k) for k, kid in enumerate(kids))
        order += kids
    sums = {key: [chars, linked, links, hint == ARTICLE] for key, _, hint, _, _, chars, linked, links in order}
    for key, parent, *_ in reversed(order[1:]):
        sums[parent] = [a + b for a, b in zip(sums[parent][:3], sums[key][:3], strict=True)] + [sums[parent][3] or sums[key][3]]
    roles = {ROOT: PLAIN}
    size = [0] * (CONTENT + 1)
    for key, parent, hint, n, _, chars, linked, _ in order[1:]:
        role = role_below(roles[parent], hint)
        total, in_links, links, holds_article = sums[key]
        if role == PLAIN and hint != FRAME and not holds_article and links >= MENU_LINKS * n and in_links >= MENU_SHARE * total:
            role = FURNITURE
        roles[key] = role
        size[role] += chars - linked
    return list(ranks), list(ranks.values()), [roles[k] for k in ranks], size[CONTENT] > 0 and size[CONTENT] >= size[PLAIN]


def hinted(tree: Tree) -> list[int]:
    """Roles by elements and classes alone."""
    roles = [PLAIN] * len(tree.keys)
    for i in range(1, len(roles)):
        roles[i] = role_below(roles[tree.parents[i]], tree.hints[i])
    return roles


def main_text(page: str | None, wrapper: Wrapper | None) -> str:
    """The page's main text by its host's wrapper; all its text without one."""
    if not page:
        return ""
    tree = parse(page)
    if wrapper is None:
        return " ".join(b[1] for b in tree.blocks)
    matched, roles = wrapper.read(tree)
    shown = [b for b in tree.blocks if roles[b[0]] >= PLAIN]
    if not shown:  # nothing but menus
        roles = hinted(tree)
        shown = [b for b in tree.blocks if roles[b[0]] >= PLAIN]
    if wrapper.only and any(roles[b[0]] == CONTENT for b in shown):
        shown = [b for b in shown if roles[b[0]] == CONTENT]
    if wrapper.fixed:
        shown = [b for b in shown if not matched[b[0]] or text_key(tree.keys[b[0]], b[1]) not in wrapper.fixed] or shown
    return " ".join(b[1] for b in shown)


def with_host(pages: DataFrame) -> DataFrame:
    return pages.withColumn("__host", F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))))


NODES = T.StructType([T.StructField("host", T.StringType())] + [T.StructField(n, T.LongType()) for n in ("node", "parent", "hint", "n", "place", "chars", "linked", "links")])
TEXTS = T.StructType([T.StructField("host", T.StringType()), T.StructField("node", T.LongType()), T.StructField("text", T.LongType()), T.StructField("n", T.LongType()), T.StructField("own", T.ArrayType(T.LongType()))])
WRAPPER = T.StructType(
    [T.StructField("host", T.StringType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("ranks", T.ArrayType(T.LongType())), T.StructField("roles", T.ArrayType(T.LongType())), T.StructField("only", T.BooleanType())]
)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """NODES rows from (host, html)."""
    counts: dict[tuple, list] = {}

    def rows() -> pa.RecordBatch:
        columns = list(zip(*((h, k, *v) for (h, k), v in counts.items()), strict=True)) or [()] * 9
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=NODES.names)

    for batch in batches:
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if not page:
                continue
            tree = parse(page)
            entries = []
            for key, parent, hint, place in zip(tree.keys, tree.parents, tree.hints, tree.places, strict=True):
                entry = counts.get((host, key))
                if entry is None:
                    entry = counts[host, key] = [tree.keys[parent] if parent >= 0 else ROOT, hint, 0, 0, 0, 0, 0]
                entry[2] += 1
                entry[3] += place
                entries.append(entry)
            for node, text, linked, links in tree.blocks:
                entry = entries[node]
                entry[4] += len(text)
                entry[5] += linked
                entry[6] += links
            if len(counts) > PARTIAL:
                yield rows()
                counts.clear()
    yield rows()


def consensus(pages: DataFrame) -> DataFrame:
    """(host, keys, ranks, roles, only): every host's consensus tree. pages: __host, html."""
    nodes = pages.select("__host", "html").mapInArrow(_counted, NODES)
    nodes = written(nodes.groupBy("host", "node").agg(F.min("parent").alias("parent"), F.min("hint").alias("hint"), *[F.sum(c).alias(c) for c in ("n", "place", "chars", "linked", "links")]), "html-nodes")
    pages_of = nodes.where(F.col("node") == ROOT).select("host", F.col("n").alias("pages"))
    few = pages_of.count() * 64 <= BROADCAST_BYTES
    common = nodes.join(F.broadcast(pages_of) if few else pages_of, "host").where(F.col("n") >= F.lit(SHARE) * F.col("pages"))
    # At most 1 / SHARE times the nodes of a mean page of the host.
    trees = common.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("node", "parent", "hint", "n", "place", "chars", "linked", "links"))).alias("nodes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [decided([tuple(x.values()) for x in nodes]) for nodes in batch.column(1).to_pylist()]
            columns = list(zip(*made, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.list_(pa.int64())) for c in columns[:3]), pa.array(columns[3], pa.bool_())], names=WRAPPER.names)

    return trees.mapInArrow(run, WRAPPER)


def _wrappers(batch: pa.RecordBatch, at: int, known: dict[str, Wrapper | None]) -> Iterator[Wrapper | None]:
    """The wrapper of every row from its columns host, keys, ranks, roles, only and, if there, fixed, from place at on."""
    for i, host in enumerate(batch.column(at).to_pylist()):
        if host not in known:
            if len(known) >= WRAPPERS:
                known.clear()
            values = [batch.column(k)[i].as_py() for k in range(at + 1, batch.num_columns)]
            known[host] = Wrapper(*values) if values[0] is not None else None
        yield known[host]


def _observed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """TEXTS rows from (html, host, keys, ranks, roles, only); a row without a text counts a node's pages."""
    counts: dict[tuple, list] = {}
    known: dict[str, Wrapper | None] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        found = list(counts.items())
        for a in range(0, len(found), 20_000):
            part = found[a : a + 20_000]
            columns = [pa.array([k[j] for k, _ in part], t) for j, t in enumerate((pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([v[0] for _, v in part], pa.int64()), pa.array([v[1] for _, v in part], pa.list_(pa.int64()))], names=TEXTS.names)
        counts.clear()

    for batch in batches:
        for page, host, wrapper in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _wrappers(batch, 1, known), strict=True):
            if not page or wrapper is None:
                continue
            tree = parse(page)
            matched, roles = wrapper.read(tree)
            texts = {(node, text) for node, text, *_ in tree.blocks if matched[node] and roles[node] >= PLAIN}
            own = text_key(ROOT, "\n".join(b[1] for b in tree.blocks if roles[b[0]] >= PLAIN))
            for node in {node for node, _ in texts}:
                counts.setdefault((host, tree.keys[node], None), [0, []])[0] += 1
            for node, text in texts:
                entry = counts.setdefault((host, tree.keys[node], text_key(tree.keys[node], text)), [0, []])
                entry[0] += 1
                if len(entry[1]) < SUPPORT and own not in entry[1]:
                    entry[1].append(own)
        if len(counts) > PARTIAL:
            yield from rows()
    yield from rows()


def with_wrappers(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """pages joined with their hosts' wrappers: no table of wrappers is too large, beyond a bound pages are shuffled by host."""
    size = wrappers.select(F.sum(64 + 24 * F.size("keys") + (8 * F.size("fixed") if "fixed" in wrappers.columns else 0))).first()[0] or 0
    return pages.join(F.broadcast(wrappers) if size <= BROADCAST_BYTES else wrappers, pages["__host"] == wrappers["host"], "left")


def induce(pages: DataFrame) -> DataFrame:
    """(host, keys, ranks, roles, only, fixed): every host's wrapper. pages: __host, html."""
    trees = written(consensus(pages), "html-consensus")
    seen = with_wrappers(pages.select("__host", "html"), trees).select("html", F.col("__host").alias("host"), *WRAPPER.names[1:])
    counts = seen.mapInArrow(_observed, TEXTS).groupBy("host", "node", "text").agg(F.sum("n").alias("n"), F.flatten(F.collect_list("own")).alias("own"))
    # Different pages are told apart up to SUPPORT of them a task, so their number is exact as far as it decides.
    counts = counts.select("host", "node", "text", "n", F.size(F.array_distinct("own")).alias("different")).where((F.col("n") >= SUPPORT) & (F.col("text").isNull() | (F.col("different") >= SUPPORT)))
    counts = written(counts, "html-texts")
    of = counts.where("text IS NULL").select("host", "node", F.col("n").alias("of"))
    fixed = counts.where("text IS NOT NULL").join(of, ["host", "node"]).where(F.col("n") >= F.lit(CONSTANT) * F.col("of"))
    fixed = fixed.groupBy("host").agg(F.sort_array(F.collect_list("text")).alias("fixed"))
    return trees.join(fixed, "host", "left").select(*WRAPPER.names, F.coalesce("fixed", F.array().cast("array<bigint>")).alias("fixed"))


def html_extract(pages: DataFrame, keep: list[str]) -> DataFrame:
    """The columns keep of pages (which has url and html) with text and n_chars; such input columns are replaced."""
    passed = [c for c in keep if c.lower() not in ("text", "n_chars")]
    rows = with_host(pages)
    with scratch() as made:
        wrappers = written(induce(rows), "html-wrappers")
        made.remove(wrappers)
    rows = with_wrappers(rows.select(*passed, "__host", F.col("html").alias("__html")), wrappers)
    rows = rows.select(*passed, "__html", F.col("__host").alias("__of"), *[wrappers[c].alias(f"__{c}") for c in (*WRAPPER.names[1:], "fixed")])
    schema = T.StructType([rows.schema[c] for c in passed] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Wrapper | None] = {}
        at = len(passed)
        for batch in batches:
            texts = [main_text(page, wrapper) for page, wrapper in zip(batch.column(at).to_pylist(), _wrappers(batch, at + 1, known), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return rows.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), ["page_id", "url"])
