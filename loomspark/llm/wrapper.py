"""Main text of web pages by wrapper induction.

Pages of one host share a template. Each page becomes a tree of its containers, in which text blocks that follow each
other (headings, paragraphs) are one node. The tree that most different pages of the host have is the wrapper's skeleton, in
which siblings of equal shape in a row are one; every page's tree is aligned with it by simple tree matching. A node is known by
its path, in the skeleton if it is matched and in its page's own tree if not, so that pages of a host's other templates
vote together as well. Over all pages of the host, a node whose text is the same on all of at least three different
pages that have it is template; a node whose text varies is a slot.

A page's content is the deepest slot that holds most of the varying text outside links (descent stops where headings or
much text stand beside it), without what is constant inside it, and without menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles and comments. Where votes are lacking a page's own text takes their place. Elements
that say what they are (`nav`, `aside`, class `cookie-notice`) are left out; names count as whole words, prefixes such
as `has-` cancel them, and vaguer names (`search`, `related`) need votes, links or form fields beside them.

Scale: three passes over the pages, none of which shuffles them: skeletons and votes are summed within tasks before
they are shuffled, so a hot host is no hot task. A host's wrapper has the paths on three different pages and one in
200 of its pages at least, so it is as large as its templates are; wrappers are broadcast if their size is small, and joined
by host and salt beyond.

Edge cases: null and empty pages have no text; pages with a null or odd url are a host of their own, ""; pages without
votes are judged by themselves; copies add no votes, and where what is constant holds nearly all text of a page and no
heading varies, as with near copies, it is content; containers below DEPTH levels are one node; repeated rows get equal results; of slots
with equal text the first counts. Pages are used whole. Other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, read_table, ship, slices

#: Elements of HTML by what they mean here. All others are inline.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav noscript ol p pre section summary table tbody td template tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("noscript template head nav footer aside form button select svg object canvas audio video dialog menu".split())
RAW = frozenset("script style title textarea iframe".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
SCOPE = frozenset("ul ol dl table tbody thead tfoot tr article section main body div nav aside footer header blockquote".split())
ROW_SCOPE = SCOPE - {"tr"}
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt blockquote pre figcaption summary address caption hr".split())
LEAVES = frozenset("ul ol dl figure".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Last words of class names and ids that name what is not content, and those that need more evidence.
NOT_CONTENT = frozenset("ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo nav navbar navigation breadcrumb breadcrumbs sidebar footer footnav masthead cookie cookies consent gdpr notice notices alert newsletter popup overlay disqus comment comments replies pagination pager".split())
VAGUE = frozenset("menu widget subscribe signup login modal share sharing social related recommended respond search toolbar banner copyright promotion reply teaser teasers tags".split())
#: Words that a name's last word may be followed by, words that cancel a name, and words that a header of a site begins with.
HOLDERS = frozenset("area section box container wrapper wrap block list slot unit content inner bar links buttons form thread body text item group panel region banner".split())
CANCEL = frozenset("has with without no not is show hide".split())
SITE = frozenset("site global top".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar toolbar".split())
DEPTH = 100
LEAST_PAGES, SUPPORT = 3, 200
MAX_BROADCAST_CHARS = 32_000_000
SALTS = 32

_TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s/>="']++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?""")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in RAW}
_TELLING = re.compile(r"class|id|role|hidden|style", re.I)
PLAIN, DOUBTFUL, LEFT_OUT, HIDDEN = range(4)


def judge_name(token: str) -> int:
    """What a class name or id says: PLAIN, DOUBTFUL or LEFT_OUT."""
    words = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", token).lower()) if len(w) > 1]
    while len(words) > 1 and words[-1] in HOLDERS:
        words.pop()
    if not words or len(words) > 1 and words[0] in CANCEL:
        return PLAIN
    if words[-1] in NOT_CONTENT or words[-1] == "header" and words[0] in SITE:
        return LEFT_OUT
    return DOUBTFUL if words[-1] in VAGUE else PLAIN


@lru_cache(maxsize=1 << 14)
def _attributes(raw: str) -> tuple[str, int]:
    """The name that tells like elements from others, and what the attributes say."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    classes, ids = found.get("class", "").split(), found.get("id", "").split()
    # numbers of three digits and more are those of pages and posts; shorter ones tell columns and parts of a layout apart
    name = re.sub(r"\d{3,}", "", " ".join([*classes[:2], *(f"#{i}" for i in ids[:1])]))
    if "hidden" in found or "display:none" in found.get("style", "").replace(" ", "").lower():
        return name, HIDDEN
    if found.get("role", "").lower() in ROLES:
        return name, LEFT_OUT
    return name, max(map(judge_name, classes + ids), default=PLAIN)


class Element:
    """A block; kids are texts and elements, in order; text inside links is counted."""

    __slots__ = ("tag", "name", "kids", "inline", "said", "skip", "links", "chars", "digest", "holds")

    def __init__(self, tag: str, name: str = "", said: int = PLAIN, inline: bool = False):
        self.tag, self.name, self.kids, self.inline, self.said = tag, name, [], inline, said
        self.skip = self.holds = False
        self.links = self.chars = self.digest = 0


def parse(html: str | None) -> Element:
    """The tree of a page's blocks, with sums of their text."""
    html = html or ""
    root = Element("#root")
    open_: list[tuple] = [("#root", root, False)]  # tag, the block that takes its text, whether it is in a link
    order, at, search = [root], 0, _TOKEN.search

    def close(tags, stop) -> None:
        for i in range(len(open_) - 1, 0, -1):
            if open_[i][0] in tags:
                del open_[i:]
                return
            if open_[i][0] in stop:
                return

    while at < len(html):
        m = search(html, at)
        text = html[at : m.start()] if m else html[at:]
        if text:
            _, block, link = open_[-1]
            text = unescape(text) if "&" in text else text
            block.kids.append(text)
            if link:
                block.links += len(text.strip())
        if not m:
            break
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            for i in range(len(open_) - 1, 0, -1):
                if open_[i][0] == tag:
                    del open_[i:]
                    break
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(html, at)
            at = end.end() if end else len(html)
            continue
        if tag == "br":
            open_[-1][1].kids.append(" ")
            continue
        if tag in CLOSES_P:
            close(("p",), SCOPE)
        if tag in SAME:
            close(SAME[tag], ROW_SCOPE if tag == "tr" else SCOPE)
        raw = m[3]
        name, said = _attributes(raw) if raw and _TELLING.search(raw) else ("", PLAIN)
        inline = tag not in BLOCK
        _, block, link = open_[-1]
        if inline and said < LEFT_OUT and tag not in NEVER:
            if tag not in VOID and not raw.endswith("/"):
                open_.append((tag, block, link or tag == "a"))
            continue
        e = Element(tag, name, said, inline)
        block.kids.append(e)
        order.append(e)
        if tag not in VOID and not raw.endswith("/"):
            open_.append((tag, e, link))
    for e in reversed(order):
        chars, digest = -e.links, 0
        for k in e.kids:
            if isinstance(k, str):
                k = k.strip()
                if k:
                    chars += len(k)
                    digest = zlib.crc32(k.encode("utf-8", "surrogatepass"), digest)
            else:
                plain = k.said < LEFT_OUT
                e.holds = e.holds or plain and (k.holds or k.tag in ("article", "main", "h1"))
                if not k.skip:
                    chars += k.chars
                    e.links += k.links
                    if k.chars or k.links:
                        digest = zlib.crc32(k.digest.to_bytes(4, "little"), digest)
        e.chars, e.digest = max(0, chars), digest
        whole = e.tag in ("article", "main", "body", "html", "#root") and e.said != HIDDEN
        # a form or a name that goes around a whole article says nothing
        rescued = e.said < HIDDEN and (e.holds or e.tag == "form" and e.chars >= 500 and any(not isinstance(k, str) and k.tag in TEXT_BLOCKS for k in e.kids)) and (e.tag not in NEVER or e.tag == "form")
        e.skip = not whole and not rescued and (e.tag in NEVER or e.said >= LEFT_OUT)
    return root


def blocks(top: Element, drop=frozenset()) -> list[str]:
    """The texts of the blocks under an element, in order, without elements that are left out or in drop (by id())."""
    out, now = [], []

    def end():
        text = " ".join("".join(now).split())
        if text:
            out.append(text)
        now.clear()

    todo = [(top, 0)]
    while todo:
        e, i = todo.pop()
        kids = e.kids
        while i < len(kids):
            k = kids[i]
            i += 1
            if isinstance(k, str):
                now.append(k)
            elif k.skip or id(k) in drop:
                if not k.inline:
                    end()
            else:
                if not k.inline:
                    end()
                todo.append((e, i))
                e, i, kids = k, 0, k.kids
        if not e.inline:
            end()
    end()
    return out


class Node:
    """Elements that are one node of a page's tree, or a node of a skeleton, which has none. Nodes of equal shape are equal trees of labels."""

    __slots__ = ("label", "kids", "elements", "key", "shape", "size")

    def __init__(self, label: str, kids: list, elements: list):
        self.label, self.kids, self.elements, self.key = label, kids, elements, 0
        self.shape = xxhash.xxh64_intdigest(label.encode() + b"\0" + b"".join(k.shape.to_bytes(8, "little") for k in kids))
        self.size = 1 + sum(k.size for k in kids)

    def chars(self) -> int:
        return sum(e.chars for e in self.elements)

    def links(self) -> int:
        return sum(e.links for e in self.elements)


def _is_layout(table: Element) -> bool:
    """Whether a table's cells hold blocks."""
    todo = [table]
    while todo:
        for k in todo.pop().kids:
            if not isinstance(k, str):
                if k.tag in ("tbody", "thead", "tfoot", "tr", "td", "th"):
                    todo.append(k)
                elif k.tag in ("div", "table", "article", "section", "main", "p", "h1", "h2", "ul"):
                    return True
    return False


def tree(root: Element) -> Node:
    """The page's containers; text blocks in a row are one node, "flow"."""

    def node(elements: list[Element], depth: int) -> Node:
        first, kids = elements[0], []
        if depth < DEPTH and first.tag not in LEAVES and (first.tag != "table" or any(map(_is_layout, elements))):
            inner = [k for e in elements for k in e.kids if not isinstance(k, str) and not k.skip and not k.inline]
            groups: list[tuple] = []
            for k in inner:
                label = "flow" if k.tag in TEXT_BLOCKS else f"{k.tag}.{k.name}"
                if groups and groups[-1][0] == label == "flow":
                    groups[-1][1].append(k)
                else:
                    groups.append((label, [k]))
            kids = [Node(label, [], es) if label == "flow" else node(es, depth + 1) for label, es in groups]
        return Node(f"{first.tag}.{first.name}", kids, elements)

    return node([root], 0)


def skeleton(t: Node) -> list:
    """The labels of a tree, as nested lists; of siblings of equal shape in a row, as items of a list are, one stands for all."""
    return [t.label, [skeleton(k) for i, k in enumerate(t.kids) if not i or k.shape != t.kids[i - 1].shape]]


def _nodes(nested: list) -> Node:
    return Node(nested[0], [_nodes(k) for k in nested[1]], [])


def match(a: list | Node, b: Node) -> tuple[int, list]:
    """Simple tree matching of a skeleton and a tree: the largest number of nodes that pair up in order, roots paired, and the pairs.

    Trees of equal shape pair up whole, and siblings of equal shape at either end of both rows do with each other, as no other pairing has
    more; what is between them is aligned, and each two shapes are compared once.
    """
    known: dict[tuple[int, int], int] = {}

    def score(x: Node, y: Node) -> int:
        if x.label != y.label:
            return 0
        if x.shape == y.shape:
            return x.size
        at = x.shape, y.shape
        if at not in known:
            known[at] = 1 + sum(score(p, q) for p, q in aligned(x.kids, y.kids))
        return known[at]

    def aligned(xs: list, ys: list) -> list:
        head = 0
        while head < min(len(xs), len(ys)) and xs[head].shape == ys[head].shape:
            head += 1
        tail = 0
        while tail < min(len(xs), len(ys)) - head and xs[-1 - tail].shape == ys[-1 - tail].shape:
            tail += 1
        mid = _aligned(xs[head : len(xs) - tail], ys[head : len(ys) - tail], score)
        return [*zip(xs[:head], ys[:head], strict=True), *mid, *zip(xs[len(xs) - tail :], ys[len(ys) - tail :], strict=True)]

    a = _nodes(a) if isinstance(a, list) else a
    if a.label != b.label:
        return 0, []
    pairs, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        pairs.append((x, y))
        todo += aligned(x.kids, y.kids) if x.shape != y.shape else zip(x.kids, y.kids, strict=True)
    return score(a, b), pairs


def _aligned(xs: list, ys: list, score) -> list:
    """Pairs of two rows of siblings, in order, whose scores sum to the most; halves of long rows are aligned by themselves, so that memory stays that of one row."""
    if not xs or not ys:
        return []
    kinds: dict[int, int] = {}
    at = np.array([kinds.setdefault(y.shape, len(kinds)) for y in ys])
    of = {y.shape: y for y in ys}
    rows: dict[int, np.ndarray] = {}

    def gains(x: Node) -> np.ndarray:
        if x.shape not in rows:
            rows[x.shape] = np.array([score(x, of[k]) for k in kinds])[at]
        return rows[x.shape]

    def last(xs, lo: int, hi: int, back: bool) -> np.ndarray:
        best = np.zeros(hi - lo + 1, np.int64)
        for x in reversed(xs) if back else xs:
            g = gains(x)[lo:hi]
            best[1:] = np.maximum.accumulate(np.maximum(best[1:], best[:-1] + (g[::-1] if back else g)))
        return best

    out, todo = [], [(0, len(xs), 0, len(ys))]
    while todo:
        a, b, lo, hi = todo.pop()
        if a == b or lo == hi:
            continue
        if b - a == 1:
            g = gains(xs[a])[lo:hi]
            if g.max() > 0:
                out.append((a, lo + int(g.argmax())))
            continue
        mid = (a + b) // 2
        cut = lo + int((last(xs[a:mid], lo, hi, False) + last(xs[mid:b], lo, hi, True)[::-1]).argmax())
        todo += [(a, mid, lo, cut), (mid, b, cut, hi)]
    return [(xs[i], ys[j]) for i, j in sorted(out)]


def _below(key: int, label: str, n: int) -> int:
    return xxhash.xxh64_intdigest(f"{label}\0{n}", key & (1 << 64) - 1)


@lru_cache(maxsize=256)
def _numbered(text: str) -> Node:
    """A skeleton with the key of each of its nodes."""
    sk = _nodes(json.loads(text))
    sk.key = 1
    todo = [sk]
    while todo:
        t = todo.pop()
        seen: dict[str, int] = {}
        for k in t.kids:
            seen[k.label] = n = seen.get(k.label, -1) + 1
            k.key = _below(t.key, k.label, n)
            todo.append(k)
    return sk


def assign_keys(t: Node, text: str | None) -> None:
    """Give each node of a page's tree its key: its path in the skeleton if it is matched there, else in its own tree."""
    paired: dict[int, int] = {}
    if text:
        sk = _numbered(text)
        score, pairs = match(sk, t)
        if score >= 0.6 * min(t.size, sk.size):
            paired = {id(p): s.key for s, p in pairs}
    t.key = 1
    todo = [t]
    while todo:
        at = todo.pop()
        seen: dict[str, int] = {}
        for k in at.kids:
            key = paired.get(id(k))
            if key is None:
                label = "+" + k.label if paired else k.label
                seen[label] = n = seen.get(label, -1) + 1
                key = _below(at.key, label, n)
            k.key = key
            todo.append(k)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def skeletons(pages: DataFrame) -> DataFrame:
    """(host, skeleton) of pages (host, html): one row a host, the tree that most different pages have (of several, the last by text)."""
    ship(pages.sparkSession)

    def run(batches):
        found: dict[tuple, list] = {}

        def rows():
            cols = [[k[0] for k in found], [k[1] for k in found], [v[0] for v in found.values()], [v[1] for v in found.values()]]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["host", "skeleton", "bits", "n"])
            found.clear()
            return out

        for b in slices(batches, 200):
            for host, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = found.setdefault((host, json.dumps(skeleton(tree(parse(html))))), [0, 0])
                s[0] |= 1 << zlib.crc32((html or "").encode("utf-8", "surrogatepass")) % 62
                s[1] += 1
            if len(found) > 20_000:
                yield rows()
        yield rows()

    each = pages.where("html is not null").mapInArrow(run, "host string, skeleton string, bits bigint, n bigint")
    each = each.groupBy("host", "skeleton").agg(F.bit_count(F.bit_or("bits")).alias("different"), F.sum("n").alias("n"))
    return each.groupBy("host").agg(F.max(F.struct("different", "n", "skeleton")).alias("s")).select("host", "s.skeleton")


def votes(pages: DataFrame) -> DataFrame:
    """(host, key, n, different, constant, chars) of pages (host, skeleton, html): what each node's text is like.

    different: different pages that have the node, up to 62; constant: its text never varies; chars: mean length of its text outside links.
    """

    def run(batches):
        sums: dict[tuple, list] = {}

        def rows():
            keys = list(sums)
            cols = list(zip(*sums.values(), strict=True)) or [[]] * 6
            out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([_signed(k[1]) for k in keys], pa.int64()), *(pa.array(c, pa.int64()) for c in cols)], names=["host", "key", "n", "bits", "lo", "hi", "texts", "chars"])
            sums.clear()
            return out

        for b in slices(batches, 200):
            for host, sk, html in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                t = tree(parse(html))
                assign_keys(t, sk)
                bit = 1 << zlib.crc32((html or "").encode("utf-8", "surrogatepass")) % 62
                todo = [t]
                while todo:
                    p = todo.pop()
                    todo += p.kids
                    digest = p.elements[0].digest if len(p.elements) == 1 else zlib.crc32(b"".join(e.digest.to_bytes(4, "little") for e in p.elements))
                    s = sums.get((host, p.key))
                    if s is None:
                        sums[host, p.key] = [1, bit, digest, digest, 1 << digest % 62, p.chars()]
                    else:
                        s[0] += 1
                        s[1] |= bit
                        s[2] = min(s[2], digest)
                        s[3] = max(s[3], digest)
                        s[4] |= 1 << digest % 62
                        s[5] += p.chars()
            if len(sums) > 50_000:
                yield rows()
        yield rows()

    found = pages.select("host", "skeleton", "html").mapInArrow(run, "host string, key bigint, n bigint, bits bigint, lo bigint, hi bigint, texts bigint, chars bigint")
    sums = found.groupBy("host", "key").agg(F.sum("n").alias("n"), F.bit_or("bits").alias("bits"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.bit_or("texts").alias("texts"), F.sum("chars").alias("chars"))
    return sums.select("host", "key", "n", F.bit_count("bits").alias("different"), (F.col("lo") == F.col("hi")).alias("constant"), F.bit_count("texts").alias("texts"), (F.col("chars") / F.col("n")).cast("int").alias("chars"))


def _joined(pages: DataFrame, found: DataFrame, size: Column) -> DataFrame:
    """pages with the row of found of their host: by broadcast if found is small, else by host and salt, so that a hot host is dealt out."""
    total = found.agg(F.sum(size)).first()[0] or 0
    if total <= MAX_BROADCAST_CHARS:
        return pages.join(F.broadcast(found), "host", "left")
    salted = found.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return pages.withColumn("_salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int")).join(salted, ["host", "_salt"], "left").drop("_salt")


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, skeleton, keys, chars) of pages (host, html): nodes of the host's templates; chars is -1 for constant ones."""
    sk = materialize(skeletons(pages), "skeletons")
    voted = materialize(votes(_joined(pages.where("html is not null"), sk, F.length("skeleton"))), "votes")
    top = voted.where("key = 1").select("host", F.col("n").alias("of"), F.col("texts").alias("top_texts"))
    enough = voted.join(top, "host").where((F.col("different") >= LEAST_PAGES) & (F.col("n") * SUPPORT >= F.col("of")) & (F.col("top_texts") >= LEAST_PAGES))
    value = F.struct("key", F.when(F.col("constant"), -1).otherwise(F.col("chars")).alias("chars"))
    nodes = enough.groupBy("host").agg(F.array_sort(F.collect_list(value)).alias("nodes"))  # at most SUPPORT times the nodes of a page
    return materialize(sk.join(nodes, "host", "left").select("host", "skeleton", F.col("nodes.key").alias("keys"), F.col("nodes.chars").alias("chars")), "wrappers")


def _value(t: Node, known: dict[int, int]) -> int:
    """The varying text of a node: the host's mean, or the page's own without votes."""
    n = known.get(t.key)
    if n is None:
        return t.chars()
    if n < 0 and t.label.startswith(("article.", "main.")):
        return t.chars()
    return max(0, n)


def _has(e: Element, tags: frozenset) -> bool:
    todo = [e]
    while todo:
        for k in todo.pop().kids:
            if not isinstance(k, str):
                if k.tag in tags:
                    return True
                todo.append(k)
    return False


_WIDE = ("#root", "html", "body")
_FIELDS = frozenset(("form", "button", "select", "svg"))


def _reads_on(t: Node, known: dict[int, int]) -> bool:
    """Whether a container looks like part of the text beside it: varying, with a heading, and not mostly links."""
    return _value(t, known) > 0 and t.links() <= t.chars() and not any(e.said == DOUBTFUL or e.tag == "header" for e in t.elements) and any(_has(e, HEADINGS) for e in t.elements)


def _place(t: Node, known: dict[int, int]) -> Node:
    """The deepest slot that holds most of the varying text outside links."""
    while True:
        if t.label.startswith("article."):
            return t
        total = max(1, sum(_value(k, known) for k in t.kids))
        articles = [k for k in t.kids if k.label.startswith("article.") and 0 < k.links() + k.chars() >= 2 * k.links()]
        if len(articles) > 1 and sum(k.chars() for k in articles) >= 0.6 * sum(k.chars() for k in t.kids):
            return t  # a page of several articles
        best, most = None, 0.0
        for k in t.kids:
            v = float(_value(k, known))
            if k.label == "flow":
                has_heading = any(e.tag in HEADINGS for e in k.elements)
                if v and (v >= 0.15 * total or has_heading):
                    return t
                continue
            if k.label.startswith(("article.", "main.")):
                v = min(1.0, 2 * v / (total + v)) * total
            if v > most:
                best, most = k, v
        if best is None or most < 0.6 * total or best.label.partition(".")[0] in ("ul", "ol", "dl", "table", "td", "th", "tr", "tbody", "figure") and not best.kids:
            return t
        if (most < 0.8 * total or t.label.partition(".")[0] not in _WIDE) and any(k is not best and k.label != "flow" and _reads_on(k, known) for k in t.kids):
            return t
        t = best


def main_text(html: str | None, text: str | None = None, known: dict[int, int] | None = None) -> str:
    """A page's main text, given its host's skeleton and what its nodes are (mean chars by key, -1: constant)."""
    root = parse(html)
    top = tree(root)
    assign_keys(top, text)
    known = known or {}
    if known:
        left, heads, todo = 0, False, [top]
        while todo:  # what varies
            t = todo.pop()
            n = known.get(t.key)
            if n is not None and n < 0 and not t.label.startswith(("article.", "main.")):
                continue
            if t.kids:
                todo += t.kids
            else:
                left, heads = left + t.chars(), heads or any(e.tag in HEADINGS or _has(e, HEADINGS) for e in t.elements)
        if left < 400 and left < 0.2 * top.chars() and not heads:
            known = {}  # the host's pages are copies of each other
    place = _place(top, known)
    page_wide = place.label.partition(".")[0] in _WIDE
    drop, todo = set(), list(place.kids)
    while todo:
        t = todo.pop()
        tag, n = t.label.partition(".")[0], known.get(t.key)
        constant = n is not None and n < 0 and tag not in ("article", "main")
        chars, links = t.chars(), t.links()
        gone = constant and (page_wide or t.label != "flow")
        if not gone and t.label != "flow":
            mostly_links = links > chars
            if any(e.said == DOUBTFUL for e in t.elements):
                gone = mostly_links or any(_has(e, _FIELDS) for e in t.elements) or n is None and chars + links < 200
            elif page_wide and links >= 4 * max(chars, 1):
                gone = True
            elif tag == "header":
                gone = page_wide or not any(_has(e, HEADINGS) for e in t.elements)
        if gone:
            drop.update(map(id, t.elements))
        else:
            todo += t.kids
    return "\n".join(x for e in place.elements for x in blocks(e, drop))


def extract(pages: DataFrame, html_col="html", url_col="url", keep: dict[str, Column] | None = None) -> DataFrame:
    """The columns of keep (by name), with text and n_chars."""
    ship(pages.sparkSession)
    keep = keep or {}
    own = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    found = wrappers(own)
    names = [f"_keep{i}" for i in range(len(keep))]
    cols = pages.select(*[c.alias(n) for n, c in zip(names, keep.values(), strict=True)], host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    cols = _joined(cols, found, F.length("skeleton") + 12 * F.greatest(F.size("keys"), F.lit(0))).select(*names, "host", "html", "skeleton", "keys", "chars")
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in cols.schema.fields[: len(names)])

    def run(batches):
        known: dict[str, dict] = {}  # of this task only
        for b in slices(batches, 200):
            n = len(names)
            host, html, sk = (b.column(n + i).to_pylist() for i in range(3))
            for i, h in enumerate(host):
                if h not in known:
                    if len(known) > 1000:
                        known.clear()
                    keys, chars = b.column(n + 3)[i].as_py(), b.column(n + 4)[i].as_py()
                    known[h] = dict(zip((k & (1 << 64) - 1 for k in keys), chars, strict=True)) if keys else {}
            texts = [main_text(x, s, known.get(h)) for h, x, s in zip(host, html, sk, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*names, "_text", "_n"])

    out = cols.mapInArrow(run, f"{schema}_text string, _n bigint")
    return out.select(*[F.col(n).alias(k) for n, k in zip(names, keep, strict=True)], F.col("_text").alias("text"), F.col("_n").alias("n_chars"))


def query(spark, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"), keep={"page_id": F.col("page_id"), "url": F.col("url")})
