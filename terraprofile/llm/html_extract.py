"""Main text of web pages by wrapper induction.

Every page becomes a small tree: containers, and the text blocks in them. Pages of
one host and layout are aligned with the first of them by simple tree matching, which
pairs nodes of equal kind in order, as many as possible. A block that is paired and says the
same on most pages of the host belongs to the template; blocks that vary are slots for
content, also inside article and main elements. Of the slots, menus, headers, footers,
adverts, notices, forms and comments are none by what the page says itself; article and
main elements are a hint to the content, weighed against the slots outside them.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraprofile.session import materialize

TAG = re.compile(r"<(!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
# up to the tag's end: a quote opens a value behind an equals sign only
REST = re.compile(r"((?>[^>\"'=]+|=\s*+(?:\"[^\"]*\"|'[^']*')|[=\"'])*+)>")
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
WORDS = re.compile(r"[^\W_]+")
WHITE = re.compile(r"[ \t\n\r\f\v\xa0]+")
# fixed values of HTML: elements by what they do
RAW = frozenset("script style noscript template iframe textarea select svg title object canvas math video audio".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table tbody thead tfoot".split())
PLAIN = frozenset(f"{t}." for t in "# p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure".split())
DIGITS = re.compile(r"\d+")
# elements and words in class, id or role that mark what is not the article
ASIDE_TAGS = frozenset("nav footer aside form button menu dialog head search fieldset".split())
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay sidebar nav navbar navigation menu breadcrumb breadcrumbs footer masthead comment comments reply replies respond disqus share sharing social related recommended recommendations newsletter subscribe subscription signup login widget toolbar pagination pager search complementary contentinfo".split()
)
ASIDE_PARTS = ("sidebar", "comment", "advert", "cookie", "newsletter")
# tables up to this size are held whole, wider ones by parts; weights of containers are held up to the second
MATCH_CELLS, WEIGHT_CELLS = 250_000, 4_000_000
TEMPLATE_SHARE, TEMPLATE_PAGES = 0.5, 3
# containers nested deeper belong to the one at this depth, as browsers do at a depth of their own
MAX_DEPTH = 120
BROADCAST_BYTES = 32_000_000
# text in article and main elements weighs so much against text outside
MAIN_HINT = 2


class Node:
    """A container, or a text block (``text`` is set)."""

    __slots__ = ("kind", "text", "children", "aside", "main", "key")

    def __init__(self, kind: str, text: str | None = None, aside: bool = False, main: bool = False):
        self.kind, self.text, self.children, self.aside, self.main, self.key = kind, text, [], aside, main, 0


def _marks(tag: str, raw: str, inside_main: bool) -> tuple[str, bool, bool]:
    """Kind, whether the element is beside the article, and whether it holds it."""
    if not raw.strip(" /"):
        words, attributes = (), {}
    else:
        attributes = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(raw)}
        words = [w.lower() for k in ("class", "id", "role") for w in WORDS.findall(attributes.get(k, ""))]
    hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()
    aside = hidden or tag in ASIDE_TAGS or (tag == "header" and not inside_main) or any(w in ASIDE_WORDS or any(p in w for p in ASIDE_PARTS) for w in words)
    if tag in ("html", "body"):
        aside = hidden
    main = not aside and (tag in ("article", "main") or attributes.get("role") == "main" or attributes.get("itemprop") == "articleBody")
    return f"{tag}.{attributes.get('class', '')}", aside, main


class Tags:
    """The tags of a page in order, each character looked at a bounded number of times."""

    def __init__(self, page: str):
        self.page, self.lower, self.quoted = page, None, True
        self.last_close: dict[str, int] = {}

    def after(self, at: int) -> tuple[int, int, str, str, str] | None:
        """Start, end, slash, name and attributes of the next tag; comments have no name. None if there is no other."""
        page = self.page
        m = TAG.search(page, at)
        if not m:
            return None
        if m[1] == "!--":
            end = page.find("-->", m.end())
            return m.start(), end + 3 if end >= 0 else len(page), "", "", ""
        rest = REST.match(page, m.end()) if self.quoted and m[3] else None
        if rest:
            return m.start(), rest.end(), m[2], m[3], rest[1]
        if m[3]:
            # a quote is not closed up to the end of the page: from here on quotes are as other characters
            self.quoted = False
        end = page.find(">", m.end())
        return None if end < 0 else (m.start(), end + 1, m[2] or "", m[3] or "", page[m.end() : end])

    def closing(self, tag: str, at: int) -> int | None:
        """Behind the end tag of an element that was opened before ``at``; None if there is none."""
        if self.lower is None:
            self.lower = self.page.lower()
        if tag not in self.last_close:
            self.last_close[tag] = self.lower.rfind(f"</{tag}")
        if at > self.last_close[tag]:
            return None
        depth, first = 1, None
        for m in re.compile(rf"<(/?){re.escape(tag)}(?=[\s/>])[^>]*>", re.I).finditer(self.page, at):
            depth += -1 if m[1] else 1
            first = first or (m.end() if m[1] else None)
            if not depth:
                return m.end()
        return first


def parse(page: str | None) -> Node:
    """The tree of a page; unclosed and stray tags are taken as browsers take them, roughly."""
    root = Node("root")
    if not page:
        return root
    # open elements: tag, node to add to, whether text in it is beside the article, whether inside main
    stack: list[tuple[str, Node, bool, bool]] = [("", root, False, False)]
    opened: Counter[str] = Counter()
    levels, tags = {id(root): 0}, Tags(page)
    held: list[str] = []

    def flush() -> None:
        if held:
            text = WHITE.sub(" ", entities.unescape("".join(held))).strip(" ")
            held.clear()
            if text:
                top = stack[-1]
                top[1].children.append(Node("#", text, aside=top[2]))

    def close(depth: int) -> None:
        while len(stack) > depth:
            if stack[-1][0] in BLOCKS:
                flush()
            opened[stack.pop()[0]] -= 1

    at = 0
    while True:
        found = tags.after(at)
        if not found:
            held.append(page[at:])
            break
        start, end, slash, name, attributes = found
        if start > at:
            held.append(page[at:start])
        at, tag = end, name.lower()
        if not tag:
            continue
        if slash:  # an end tag closes up to its element, if that is open
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0) if opened[tag] else 0
            if depth:
                close(depth)
            elif tag == "p":
                flush()
            continue
        if tag in RAW:
            close_tag = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = close_tag.end() if close_tag else len(page)
            held.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                held.append(" ")
            continue
        if tag in BLOCKS:
            if any(opened[t] for t in CLOSES.get(tag, ())):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in SCOPES:
                        break
                    if stack[i][0] in CLOSES[tag]:
                        close(i)
                        break
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] in BLOCKS), 0) if opened["p"] else 0
            if depth and stack[depth][0] == "p":
                close(depth)
            flush()
        _, parent, aside, inside = stack[-1]
        kind, own_aside, own_main = _marks(tag, attributes, inside)
        if tag in BLOCKS:
            level = levels[id(parent)] + 1
            node = parent
            if level <= MAX_DEPTH:
                node = Node(kind, aside=aside or own_aside, main=own_main)
                levels[id(node)] = level
                parent.children.append(node)
            stack.append((tag, node, aside or own_aside, inside or own_main))
            opened[tag] += 1
        else:
            if own_aside and not aside:
                # an inline element beside the article: its text is left out of the block
                at = tags.closing(tag, at) or at
                continue
            stack.append((tag, parent, aside, inside))
            opened[tag] += 1
    close(1)
    flush()
    return root


def _key(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) or 1  # 0 stands for a container


def compact(node: Node) -> list:
    """[kind, text key, children]; a container of one block is that block; empty ones go."""
    if node.text is not None:
        return [node.kind, _key(node.text), []]
    children = [c for c in map(compact, node.children) if c[1] or c[2]]
    if len(children) == 1 and children[0][0] == "#":
        return [node.kind, children[0][1], []]
    return [node.kind, 0, children]


def _hash(parts) -> int:
    return int.from_bytes(hashlib.blake2b("\n".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def layout(tree: list) -> int:
    """A hash of the kinds that frame a page: down to where it branches, and two levels from there.

    Plain elements of running text on the second level, and digits in class names, make no other layout.
    """
    frame = []
    while True:
        inner = [c for c in tree[2] if not c[0].startswith("head.")]
        if len(inner) != 1 or not inner[0][2]:
            break
        tree = inner[0]
        frame.append(tree[0])
    kinds = {(c[0],) for c in inner} | {(c[0], d[0]) for c in inner for d in c[2] if d[0] not in PLAIN}
    return _hash(DIGITS.sub("0", k) for k in ["/".join(frame), *sorted(" ".join(k) for k in kinds)])


def own_text(root: Node) -> int:
    """A hash of what is not beside the article: equal for copies of a page."""

    def walk(node: Node):
        if node.text is not None:
            if not node.aside:
                yield node.text
        for c in node.children:
            yield from walk(c)

    return _hash(walk(root))


def _equal_ends(x: list, y: list) -> tuple[int, int]:
    """How many nodes at the head and at the tail say the same throughout; pairing them is always best."""
    n, head, tail = min(len(x), len(y)), 0, 0
    while head < n and x[head] == y[head]:
        head += 1
    while tail < n - head and x[-1 - tail] == y[-1 - tail]:
        tail += 1
    return head, tail


def _whole(a: list) -> tuple[int, list]:
    """What :func:`match` gives for a tree and its equal."""
    if not a[2]:
        return 1 + (a[1] != 0), []
    found = [_whole(c) for c in a[2]]
    return 1 + sum(n for n, _ in found), [(i, i, pairs) for i, (_, pairs) in enumerate(found)]


def match(a: list, b: list) -> tuple[int, list]:
    """Simple tree matching of two trees: its size, and what pairs children of ``a`` and ``b``.

    Nodes pair only if their kinds are equal; paired blocks count one more if they say the same.
    """
    if a[0] != b[0]:
        return 0, []
    x, y = a[2], b[2]
    if not x or not y:
        return 1 + (a[1] == b[1] and a[1] != 0), []
    head, tail = _equal_ends(x, y)
    ends = [(i, i, *_whole(x[i])) for i in range(head)] + [(len(x) - k, len(y) - k, *_whole(x[-k])) for k in range(tail, 0, -1)]
    size, pairs = 1 + sum(e[2] for e in ends), [(i, j, inner) for i, j, _, inner in ends]
    x, y = x[head : len(x) - tail], y[head : len(y) - tail]
    n, found = (_align_wide if len(x) * len(y) > MATCH_CELLS else _align)(x, y)
    return size + n, pairs[:head] + [(head + i, head + j, inner) for i, j, inner in found] + pairs[head:]


def _align(x: list, y: list) -> tuple[int, list]:
    """The heaviest pairing in order of two lists of nodes, by the whole table."""
    inner = [[match(c, d) if c[0] == d[0] else (0, []) for d in y] for c in x]
    best = [[0] * (len(y) + 1)]
    for i in range(len(x)):
        row, above = [0], best[-1]
        for j in range(len(y)):
            row.append(max(above[j + 1], row[j], above[j] + inner[i][j][0]))
        best.append(row)
    i, j, found = len(x), len(y), []
    while i and j:
        if inner[i - 1][j - 1][0] and best[i][j] == best[i - 1][j - 1] + inner[i - 1][j - 1][0]:
            i, j = i - 1, j - 1
            found.append((i, j, inner[i][j][1]))
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return best[len(x)][len(y)], found[::-1]


def _align_wide(x: list, y: list) -> tuple[int, list]:
    """The same pairing as :func:`_align` gives; of the table, every k-th row and k rows are held at a time, k being the root of the rows."""
    codes: dict[str, int] = {}
    kinds, keys = (np.array(v, np.int64) for v in ([codes.setdefault(d[0], len(codes)) for d in y], [d[1] for d in y]))
    inside: dict[int, np.ndarray] = {}
    for j, d in enumerate(y):
        if d[2]:
            inside.setdefault(codes[d[0]], []).append(j)
    inside = {k: np.array(v) for k, v in inside.items()}
    kept: dict[int, np.ndarray] = {}
    keep = sum(len(inside.get(codes.get(c[0], -1), ())) for c in x if c[2]) <= WEIGHT_CELLS

    def weights(i: int) -> np.ndarray:
        c = x[i]
        same = kinds == codes.get(c[0], -1)
        w = same.astype(np.int64)
        if not c[2]:
            return w + (same & (keys == c[1])) if c[1] else w
        at = inside.get(codes.get(c[0], -1))
        if at is not None:  # containers against containers of their kind
            found = kept.get(i)
            if found is None:
                found = np.array([match(c, y[j])[0] for j in at], np.int32)
                if keep:
                    kept[i] = found
            w[at] = found
        return w

    def below(above: np.ndarray, w: np.ndarray) -> np.ndarray:
        row = np.zeros_like(above)
        row[1:] = np.maximum.accumulate(np.maximum(above[1:], above[:-1] + w[: len(above) - 1]))
        return row

    step, row, marks = math.isqrt(len(x)) + 1, np.zeros(len(y) + 1, np.int64), []
    for i in range(len(x)):
        if i % step == 0:
            marks.append(row)
        row = below(row, weights(i))
    size, i, j, found = int(row[-1]), len(x), len(y), []
    while i and j:
        low = (i - 1) // step * step
        block, own = [marks[low // step][: j + 1]], []
        for r in range(low, i):
            own.append(weights(r)[:j])
            block.append(below(block[-1], own[-1]))
        while i > low and j:
            w, here = own[i - 1 - low][j - 1], block[i - low][j]
            if w and here == block[i - 1 - low][j - 1] + w:
                i, j = i - 1, j - 1
                found.append((i, j, match(x[i], y[j])[1]))
            elif here == block[i - 1 - low][j]:
                i -= 1
            else:
                j -= 1
    return size, found[::-1]


def _numbers(tree: list, at: int, out: dict[int, int]) -> int:
    """Preorder number of every node, by identity."""
    out[id(tree)] = at
    at += 1
    for c in tree[2]:
        at = _numbers(c, at, out)
    return at


def _paired(a: list, b: list, pairs: list):
    yield a, b
    for i, j, inner in pairs:
        yield from _paired(a[2][i], b[2][j], inner)


def votes(first: list, page: list) -> list[tuple[int, int]]:
    """For each block of the first page that the page pairs: its number, and whether both say the same."""
    numbers: dict[int, int] = {}
    _numbers(first, 0, numbers)
    return [(numbers[id(a)], int(a[1] == b[1])) for a, b in _paired(first, page, match(first, page)[1]) if a[1] and not a[2] and b[1]]


def text_blocks(root: Node) -> list:
    """For each text block in page order: its text, null beside the article, and the number of the outermost main element around it, or -1."""
    found, mains = [], iter(range(1 << 60))

    def walk(node: Node, main: int) -> None:
        if main < 0 and node.main:
            main = next(mains)
        if node.text is not None:
            found.append((None if node.aside else node.text, main))
        for c in node.children:
            walk(c, main)

    walk(root, -1)
    return found


def _constant(tree: list, template: tuple[list, set[int]]) -> set[int]:
    """Which of a page's text blocks are those of the template."""
    first, blocks = template
    numbers: dict[int, int] = {}
    _numbers(first, 0, numbers)
    leaves: dict[int, int] = {}

    def order(node: list) -> None:
        if node[1]:
            leaves[id(node)] = len(leaves)
        for c in node[2]:
            order(c)

    order(tree)
    pairs = _paired(first, tree, match(first, tree)[1])
    return {leaves[id(b)] for a, b in pairs if numbers[id(a)] in blocks and a[1] == b[1]}


def extract(texts: list, tree: list, template: tuple[list, set[int]] | None) -> str:
    """The main text: blocks in page order, one per line.

    Template blocks go first, wherever they stand. Of the slots, a single main element is the content if it
    holds at least half of what is outside, several if one holds as much as is outside. Several that hold less
    than half together are teasers beside the content. Else nothing more is left out.
    """
    constant = _constant(tree, template) if template else set()
    slots = [(t, main) for k, (t, main) in enumerate(texts) if t is not None and k not in constant]
    sizes: dict[int, int] = {}
    for t, main in slots:
        sizes[main] = sizes.get(main, 0) + len(t)
    rest, total = sizes.pop(-1, 0), sum(sizes.values())
    if MAIN_HINT * total < rest and len(sizes) > 1:
        slots = [s for s in slots if s[1] < 0]
    elif MAIN_HINT * total >= rest and (len(sizes) == 1 or max(sizes.values(), default=0) >= rest):
        slots = [s for s in slots if s[1] >= 0] if sizes else slots
    return "\n".join(t for t, _ in slots)


def host_of(url):
    """The host of a URL, A-Z lower-cased; null without ``://``."""
    host = F.regexp_extract(url, r"^.*?://([^/?#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.lower(host))


def induce(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Templates by host and layout, the commonest layout of each host, and the layouts with a reference.

    A template is a reference page's tree and the numbers of its template blocks. Each layout of at least
    ``TEMPLATE_PAGES`` different pages has a reference of its own; pages of the others are aligned with a page of
    the host's commonest layout. Pages without blocks are no references, and copies of a page vote once.
    """

    def trees(batches):
        for batch in batches:
            roots = [parse(h.as_py()) for h in batch.column(2)]
            packed = [compact(r) for r in roots]
            columns = [pa.array([layout(t) for t in packed], pa.int64()), pa.array(map(own_text, roots), pa.int64()), pa.array([json.dumps(t).encode() if t[2] else None for t in packed], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["host", "page", "layout", "own", "tree"])

    source = pages.select(host_of(F.col(url_col)).alias("host"), F.col(id_col).cast("string").alias("page"), F.col(html_col).alias("h")).where("host is not null")
    found = source.mapInArrow(trees, "host string, page string, layout long, own long, tree binary").where("tree is not null")
    # copies, page counts and first pages are summed in the tasks before they meet
    distinct = found.groupBy("host", "layout", "own").agg(F.min(F.struct("page", "tree")).alias("p"))
    packed = materialize(distinct.select("host", "layout", "p.page", "p.tree"), "page-trees")
    counted = packed.groupBy("host", "layout").agg(F.count(F.lit(1)).alias("pages"), F.min(F.struct("page", "tree")).alias("p"))
    layouts = materialize(counted.select("host", "layout", "pages", "p.page", F.col("p.tree").alias("first")), "layouts")
    commonest = layouts.groupBy("host").agg(F.sum("pages").alias("all"), F.min(F.struct((-F.col("pages")).alias("n"), "page", "layout", "first")).alias("c"))
    commonest = commonest.where(f"all >= {TEMPLATE_PAGES}").select("host", "c.layout", "c.first", (-F.col("c.n")).alias("pages"))
    own = layouts.where(f"pages >= {TEMPLATE_PAGES}").select("host", "layout", "first")
    firsts = materialize(own.unionByName(commonest.where(f"pages < {TEMPLATE_PAGES}").drop("pages")), "first-pages")
    usual = materialize(commonest.select("host", F.col("layout").alias("usual")), "commonest-layouts")

    def vote(batches):
        counts: dict[tuple[str, int, int], list[int]] = {}
        known: tuple[tuple | None, list] = (None, [])
        for batch in batches:
            for host, to, tree, first in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if known[0] != (host, to):
                    known = ((host, to), json.loads(first))
                for number, same in votes(known[1], json.loads(tree)):
                    held = counts.setdefault((host, to, number), [0, 0])
                    held[0] += 1
                    held[1] += same
            if len(counts) > 200_000:
                yield rows(counts)
                counts.clear()
        yield rows(counts)

    def rows(counts):
        keys = {name: pa.array([k[i] for k in counts], kind) for i, (name, kind) in enumerate((("host", pa.string()), ("layout", pa.int64()), ("number", pa.int64())))}
        return pa.RecordBatch.from_pydict({**keys, "seen": pa.array([v[0] for v in counts.values()], pa.int64()), "same": pa.array([v[1] for v in counts.values()], pa.int64())})

    paired = referred(packed, own.select("host", "layout"), usual).join(sized(firsts.withColumnRenamed("layout", "to"), "first"), ["host", "to"])
    found = paired.select("host", "to", "tree", "first").mapInArrow(vote, "host string, layout long, number long, seen long, same long")
    blocks = found.groupBy("host", "layout", "number").agg(F.sum("seen").alias("seen"), F.sum("same").alias("same")).where(f"seen >= {TEMPLATE_PAGES} and same > {TEMPLATE_SHARE} * seen")
    numbers = blocks.groupBy("host", "layout").agg(F.collect_list("number").alias("blocks"))
    templates = firsts.join(numbers, ["host", "layout"]).select("host", F.col("layout").alias("to"), "first", "blocks")
    return templates, usual, own.select("host", "layout")


def referred(pages: DataFrame, own: DataFrame, usual: DataFrame) -> DataFrame:
    """``pages`` with ``to``: the layout whose reference a page is aligned with, null without any."""
    known = own.withColumn("to", F.col("layout"))
    return pages.join(sized(known, "host"), ["host", "layout"], "left").join(sized(usual, "host"), "host", "left").withColumn("to", F.coalesce("to", "usual")).drop("usual")


def sized(side: DataFrame, column: str) -> DataFrame:
    """``side``, marked for broadcast if its measured size is under the bound; else joined by shuffle."""
    size = side.agg(F.sum(F.octet_length(column) + 200)).first()[0] or 0
    return F.broadcast(side) if size <= BROADCAST_BYTES else side


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page row: page_id, url, text.

    Null or empty html, or a page without content, gives ''. A null url has no host and no template.
    Hosts with fewer than three different pages have no template; pages of a layout with fewer are
    aligned with the host's commonest layout. Repeated rows give repeated results.
    Character references are decoded, white space in a block is one space, blocks are lines.
    Other columns are not read. An empty table gives an empty result.
    """
    templates, usual, own = induce(pages, id_col, url_col, html_col)
    templates = materialize(templates, "templates")
    kind = pages.schema[id_col].dataType.simpleString()
    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("h"))

    def read(batches):
        for batch in batches:
            layouts, trees, blocks = [], [], []
            for page in batch.column(3):
                root = parse(page.as_py())
                tree = compact(root)
                layouts.append(layout(tree))
                trees.append(json.dumps(tree).encode())
                blocks.append(json.dumps(text_blocks(root)).encode())
            columns = [pa.array(layouts, pa.int64()), pa.array(trees, pa.binary()), pa.array(blocks, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=["page_id", "url", "host", "layout", "tree", "texts"])

    parsed = source.mapInArrow(read, f"page_id {kind}, url string, host string, layout long, tree binary, texts binary")
    joined = referred(parsed, own, usual).join(sized(templates, "first"), ["host", "to"], "left").select("page_id", "url", "host", "to", "tree", "texts", "first", "blocks")

    def run(batches):
        known: tuple[tuple | None, tuple | None] = (None, None)
        for batch in batches:
            texts = []
            for host, to, tree, held, first, blocks in zip(*(batch.column(i) for i in range(2, 8))):
                key = (host.as_py(), to.as_py())
                if None in key or key != known[0]:
                    first = first.as_py()
                    known = (key, (json.loads(first), set(blocks.as_py())) if first is not None else None)
                texts.append(extract(json.loads(held.as_py()), json.loads(tree.as_py()), known[1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return joined.mapInArrow(run, f"page_id {kind}, url string, text string")
