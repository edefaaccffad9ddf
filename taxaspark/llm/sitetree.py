"""Main text of web pages by a site style tree.

Every page is parsed into block elements with their own text blocks. The elements of all pages of a
host are merged by their path of names (tag, classes and cue). Of each node of the merged tree two
entropies are taken over the host's pages: that of its presentation (the sequences of children that it
shows) and that of its contents (text blocks that recur from page to page). From the leaves up they
give each branch one importance, by the composite of the published site style trees: a node of l
presentations has (1 - g^l) of its own entropy and g^l of its children's mean.

How an element presents itself (tag, role, class words), how much of the page's text stands in it and
whether an article stands beside it weigh on that importance; a branch whose score stays low is removed
from every page, whole. Paths on too few pages have no entropy; a middle importance stands for it, so
that only their presentation decides.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxaspark.llm.common import cut, parts

#: A tag, in one pass: quotes count only after an equals sign, and nothing is tried twice.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|[\"'=])*+)>")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"']++))""")
#: Elements by their role.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes", "annotation", "annotation-xml"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "nobr"}
#: Elements that hold what is read in place: formulas, and what stands for a sound or a picture.
INLINE |= {"math", "semantics", "mrow", "mi", "mn", "mo", "ms", "mtext", "mspace", "mstyle", "mfrac", "msqrt", "mroot", "msub", "msup", "msubsup", "munder", "mover", "munderover", "mtable", "mtr", "mtd", "object", "audio", "video"}
UNSEEN = {"head", "button", "select", "option", "datalist", "svg", "canvas"}
STRUCTURAL = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "fieldset"}
MAIN = {"article", "main"}
#: What an opening tag ends, up to the elements that bound the search.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
LOW_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "alertdialog", "menu", "menubar", "status", "toolbar"}
COMMENT_WORDS = {"comment", "comments", "commentlist", "disqus", "discussion", "replies", "reply", "respond"}
LOW_WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "adslot", "banner", "breadcrumb", "breadcrumbs", "captcha",
    "consent", "cookie", "cookies", "copyright", "disclaimer", "footer", "gdpr", "header", "masthead", "menu",
    "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "outbrain", "overlay", "pager", "pagination", "paywall", "popup", "promo",
    "promoted", "promotion", "recommended", "related", "share", "sharing", "sidebar", "signup", "social",
    "sponsor", "sponsored", "subscribe", "subscription", "taboola", "toolbar", "topbar", "widget", "widgets",
}
#: Words that say little where they only begin a compound.
LOOSE_WORDS = {"social", "notice", "header", "disclaimer", "copyright", "promotion", "subscription", "overlay"}
HIGH_WORDS = {"article", "body", "content", "entry", "main", "post", "story", "text"}
MODIFIERS = {"with", "has", "no", "without", "is"}
#: How an element presents itself, from nothing to what is never content.
PLAIN, HINT, CLAIM, ROLE = range(4)
#: By these: what the importance and the share of the page's text count.
WEIGHTS = ((1.0, 1.0), (0.25, 1.0), (0.2, 0.5), (0.1, 0.15))
#: What the importance counts beside an article that has half of a page's text.
BESIDE = 0.7
#: Importance of a path on too few pages.
UNKNOWN = 0.5


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(text)}


def _cue(tag: str, found: dict[str, str], inside: bool) -> int:
    """How an element presents itself; ``inside``: of an article."""
    if tag in STRUCTURAL:
        return PLAIN if tag == "header" and inside else ROLE
    if found.get("role", "").lower() in LOW_ROLES:
        return ROLE
    if not inside and "display:none" in found.get("style", "").replace(" ", "").lower():
        return ROLE  # what an article hides is still its text
    if tag in MAIN or tag in ("html", "body"):
        return PLAIN
    cue, high = PLAIN, False
    for token in re.sub(r"([a-z])([A-Z])", r"\1-\2", f"{found.get('class', '')} {found.get('id', '')}").lower().split():
        words = [w for w in re.split(r"[^a-z]+", token) if w]
        if not words or words[0] in MODIFIERS:
            continue
        first, last = words[0], words[-1]
        high |= last in HIGH_WORDS
        if (first in COMMENT_WORDS or last in COMMENT_WORDS) and last not in HIGH_WORDS:
            return ROLE
        if last in LOW_WORDS and not (last == "header" and inside):
            cue = max(cue, CLAIM)
        elif first in LOW_WORDS - LOOSE_WORDS:
            cue = max(cue, HINT)
    return PLAIN if high else cue


@dataclass
class Node:
    """An element of a page."""

    path: int
    parent: int
    depth: int
    cue: int
    own: bool  # below article or main, by bare elements only
    inside: bool
    above: Node | None
    shape: int = 0
    chars: int = 0
    links: int = 0
    holds: bool = False  # an article


@dataclass
class Page:
    """Nodes in page order, and (node, text, digest) of the blocks."""

    nodes: list[Node] = field(default_factory=list)
    blocks: list[tuple[Node, str]] = field(default_factory=list)


def _hash(*values: object) -> int:
    return xxhash.xxh64_intdigest("\0".join(map(str, values)).encode("utf-8", "replace")) - 2**63


#: Levels of block elements that are nodes of their own; what lies deeper belongs to the last.
LEVELS = 48
_NAMES: dict[tuple, tuple] = {}


def _named(parent: Node, tag: str, attributes: str) -> tuple[int, int, bool]:
    """Path, cue and whether it is an article's own, of an element below ``parent``."""
    key = (parent.path, parent.own, parent.inside, tag, attributes)
    if (known := _NAMES.get(key)) is None:
        if len(_NAMES) > 200_000:
            _NAMES.clear()
        found = _attributes(attributes) if attributes else {}
        cue = _cue(tag, found, parent.inside)
        classes = sorted(re.sub(r"\d+", "0", found.get("class", "")).split())
        own = tag in MAIN or (parent.own and not classes and cue == PLAIN)
        known = _NAMES[key] = (_hash(parent.path, tag, *classes, cue), cue, own)
    return known


def parse(page: str) -> Page:
    """Block elements and text blocks of a page; time grows with its length only."""
    out = Page()
    root = Node(_hash("root"), 0, 0, PLAIN, False, False, None)
    out.nodes.append(root)
    stack: list[tuple[str, Node, bool]] = []  # tag, node that holds its text, unseen
    opened: dict[str, int] = {}
    buffer: list[str] = []
    unseen = anchors = linked = blocks_open = 0

    def here() -> Node:
        return stack[-1][1] if stack else root

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join(entities.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                node = here()
                out.blocks.append((node, text))
                node.shape = (node.shape * 1_000_003 + 7) % (1 << 62)
                node.chars += len(text)
                node.links += min(linked, len(text))
        linked = 0

    def pop() -> None:
        nonlocal unseen, anchors, blocks_open
        tag, _, was = stack[-1]
        if tag not in INLINE:
            flush()
            blocks_open -= 1
        anchors -= tag == "a"
        stack.pop()
        opened[tag] -= 1
        unseen -= was

    def put(run: str) -> None:
        nonlocal linked
        if run and not unseen:
            buffer.append(run)
            if anchors:
                linked += len(run)

    at = start = 0
    last = page.rfind(">")
    while True:
        lt = page.find("<", at)
        if lt < 0 or lt + 1 >= len(page):
            put(page[start:])
            break
        head = page[lt + 1]
        if head in "!?":
            put(page[start:lt])
            comment = page.startswith("<!--", lt)
            end = page.find("-->" if comment else ">", lt + 4 if comment else lt)
            if end < 0:
                break
            at = start = end + (3 if comment else 1)
            continue
        if not (head == "/" or head.isascii() and head.isalpha()):
            at = lt + 1
            continue
        if lt > last:  # a tag that never ends
            put(page[start:lt])
            break
        m = TAG.match(page, lt)
        if not m:
            at = lt + 1
            continue
        put(page[start:lt])
        at = start = m.end()
        tag, attributes = m[2].lower(), m[3].strip().rstrip("/")
        if m[1]:
            if opened.get(tag):
                inline = tag in INLINE
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        while len(stack) > k:
                            pop()
                        break
                    if inline and stack[k][0] not in INLINE:
                        break
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            gone = page.find(">", close.start()) if close else -1
            if gone < 0:
                break
            at = start = gone + 1
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag in ("br", "img", "input"):
                put(" ")
            continue
        if tag in INLINE:
            stack.append((tag, here(), False))
            opened[tag] = opened.get(tag, 0) + 1
            anchors += tag == "a"
            continue
        if opened.get("p"):
            while stack[-1][0] in INLINE or stack[-1][0] == "p":
                was = stack[-1][0]
                pop()
                if was == "p":
                    break
        if tag in CLOSES:
            ends, bounds = CLOSES[tag]
            if any(opened.get(x) for x in ends):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in bounds:
                        break
                    if stack[k][0] in ends:
                        while len(stack) > k:
                            pop()
                        break
        flush()
        parent = here()
        if blocks_open < LEVELS:
            path, cue, own = _named(parent, tag, attributes)
            node = Node(path, parent.path, parent.depth + 1, cue, own, parent.inside or tag in MAIN, parent, holds=tag in MAIN)
            parent.shape = (parent.shape * 1_000_003 + path) % (1 << 62)
            out.nodes.append(node)
        else:
            node = parent
        stack.append((tag, node, tag in UNSEEN))
        opened[tag] = opened.get(tag, 0) + 1
        unseen += tag in UNSEEN
        blocks_open += 1
    flush()
    for node in reversed(out.nodes):  # children come after their parents
        if node.above:
            node.above.chars += node.chars
            node.above.links += node.links
            node.above.holds |= node.holds
    return out


@dataclass
class Merged:
    """A path on one page: all its elements together."""

    node: Node
    shapes: set[int] = field(default_factory=set)
    chars: int = 0
    links: int = 0
    beside: bool = True
    contents: set[int] = field(default_factory=set)


def merge(page: Page) -> dict[int, Merged]:
    """The page's elements by path; a path beside an article that has half of the text is marked."""
    total = page.nodes[0].chars
    inside = sum(n.chars for n in page.nodes if n.inside and not (n.above and n.above.inside))
    out: dict[int, Merged] = {}
    for n in page.nodes:
        own = out.setdefault(n.path, Merged(n))
        own.shapes.add(n.shape)
        own.chars += n.chars
        own.links += n.links
        own.beside &= 2 * inside >= total > 0 and not n.inside and not n.holds
    for node, text in page.blocks:
        out[node.path].contents.add(xxhash.xxh64_intdigest(text) - 2**63)
    return out


def score(importance: float, cue: int, share: float, beside: float) -> float:
    weight, of_share = WEIGHTS[cue]
    return importance * weight * (1 - (1 - BESIDE) * beside) + share * of_share


def main_text(html: str | None, low: set[int], spared: set[int], least: float) -> str:
    """Blocks of a page outside its low branches. ``low`` and ``spared``: paths that the host's tree
    judged; the others are judged by the page alone."""
    if not html:
        return ""
    page = parse(html)
    merged, total = merge(page), max(1, page.nodes[0].chars)
    gone: dict[int, bool] = {0: False}
    for path, m in merged.items():  # parents come first
        n = m.node
        if path in low:
            own = True
        elif path in spared or n.own or not n.above:
            own = False
        else:
            own = score(UNKNOWN, n.cue, m.chars / total, m.beside) < least
        gone[path] = own or gone[n.parent]
    return "\n\n".join(text for node, text in page.blocks if not gone[node.path])


NODES = "array<struct<path:bigint,parent:bigint,depth:int,cue:int,own:boolean,shape:bigint,share:double,linked:double,beside:int,contents:array<bigint>>>"


def page_nodes(pages: DataFrame) -> DataFrame:
    """(host, page_digest, nodes) of every row of ``pages(page_digest, host, html)``, not null."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("path", pa.int64()), ("parent", pa.int64()), ("depth", pa.int32()), ("cue", pa.int32()), ("own", pa.bool_()), ("shape", pa.int64()), ("share", pa.float64()), ("linked", pa.float64()), ("beside", pa.int32()), ("contents", pa.list_(pa.int64()))]))
        for whole in batches:
            for batch in parts(whole, 2):
                rows = []
                for html in batch.column(2).to_pylist():
                    page = parse(html)
                    total = max(1, page.nodes[0].chars)
                    rows.append([
                        {"path": p, "parent": m.node.parent, "depth": m.node.depth, "cue": m.node.cue, "own": m.node.own, "shape": _hash(*sorted(m.shapes)), "share": m.chars / total,
                         "linked": m.links / max(1, m.chars), "beside": int(m.beside), "contents": sorted(m.contents)}
                        for p, m in merge(page).items()])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, kind)], ["page_digest", "host", "nodes"])

    return pages.select("page_digest", "host", "html").mapInArrow(of, f"page_digest long, host string, nodes {NODES}")


def site_tree(nodes: DataFrame) -> DataFrame:
    """The merged tree: a row per host and path with its sums over the host's pages, stored.

    Equal pages count once. m: pages; styles: different presentations; shown: sum of k log k over
    them, k being their pages; recurring and blocks: the same sum over contents, and their number.
    """
    once = nodes.groupBy("host", "page_digest").agg(F.first("nodes").alias("nodes"))
    n = once.select("host", F.explode("nodes").alias("n")).select("host", "n.*")
    key = ("host", "path", "parent", "depth", "cue", "own")
    style = F.struct(F.lit(True).alias("style"), F.col("shape").alias("value"))
    content = F.transform("contents", lambda x: F.struct(F.lit(False).alias("style"), x.alias("value")))
    spread = n.select(*key, "share", "linked", "beside", F.explode(F.concat(F.array(style), content)).alias("v"))
    held = spread.groupBy(*key, "v").agg(F.count("*").alias("k"), F.sum("share").alias("share"), F.sum("linked").alias("linked"), F.sum("beside").alias("beside"))
    is_style, times = F.col("v.style"), F.col("k") * F.log("k")
    on = lambda c: F.sum(F.when(is_style, c))
    tree = held.groupBy(*key).agg(
        on(F.col("k")).alias("m"), F.count_if(is_style).alias("styles"), on(times).alias("shown"), F.coalesce(F.sum(F.when(~is_style, F.col("k"))), F.lit(0)).alias("blocks"),
        F.coalesce(F.sum(F.when(~is_style, times)), F.lit(0.0)).alias("recurring"), on(F.col("share")).alias("share"), on(F.col("linked")).alias("linked"), on(F.col("beside")).alias("beside"))
    return cut(tree.withColumns({c: F.col(c) / F.col("m") for c in ("share", "linked", "beside")}))


def importances(tree: DataFrame, decay: float = 0.9) -> DataFrame:
    """``tree`` with importance: from the deepest level up, each a sum over the level below."""
    deepest = tree.agg(F.max("depth")).first()[0]
    log = F.log(F.greatest("m", F.lit(2)))
    own = F.when(F.col("m") > 1, (log - F.col("shown") / F.col("m")) / log).otherwise(1.0)
    text = F.when(F.col("blocks") > 0, (1 - F.col("recurring") / F.col("blocks") / log) * (1 - 0.8 * F.col("linked")))
    held = F.when(F.col("blocks") > 0, F.col("m")).otherwise(0)
    tree = tree.withColumns({"presentation": own, "content": text, "held": held})
    done, below = None, None
    for depth in range(deepest if deepest is not None else -1, -1, -1):
        level = tree.filter(F.col("depth") == depth)
        if below is None:
            level = level.withColumns({"sum": F.lit(0.0), "pages": F.lit(0).cast("long")})
        else:
            under = below.groupBy("host", F.col("parent").alias("path")).agg(F.sum(F.col("m") * F.col("importance")).alias("sum"), F.sum("m").alias("pages"))
            level = level.join(under, ["host", "path"], "left").fillna({"sum": 0.0, "pages": 0})
        all_pages = F.col("pages") + F.col("held")
        inner = F.when(all_pages > 0, (F.col("sum") + F.col("held") * F.coalesce("content", F.lit(0.0))) / all_pages).otherwise(0.0)
        keep = F.pow(F.lit(decay), F.col("styles"))
        level = cut(level.withColumn("importance", (1 - keep) * F.col("presentation") + keep * inner).select("host", "path", "parent", "depth", "cue", "own", "m", "share", "beside", "presentation", "content", "importance"))
        below, done = level, level if done is None else done.unionByName(level)
    return tree.select("host", "path", "parent", "depth", "cue", "own", "m", "share", "beside", "presentation", "content", F.lit(0.0).alias("importance")) if done is None else done


def verdicts(tree: DataFrame, min_pages: int = 5, least: float = 0.3) -> DataFrame:
    """(host, low, spared): paths on ``min_pages`` pages or more whose score is below ``least``, and
    those of a low presentation whose score isn't. An article's own bare elements are no branches."""
    weigh = lambda k: F.element_at(F.array(*[F.lit(w[k]) for w in WEIGHTS]), F.col("cue") + 1)
    got = F.col("importance") * weigh(0) * (1 - (1 - BESIDE) * F.col("beside")) + F.col("share") * weigh(1)
    judged = tree.filter((F.col("m") >= min_pages) & ~F.col("own") & (F.col("depth") > 0)).select("host", "path", "cue", (got < least).alias("low"))
    judged = judged.filter("low or cue > 0")
    return judged.groupBy("host").agg(F.collect_set(F.when(F.col("low"), F.col("path"))).alias("low"), F.collect_set(F.when(~F.col("low"), F.col("path"))).alias("spared"))


def extract(pages: DataFrame, min_pages: int = 5, least: float = 0.3) -> DataFrame:
    """One row per row of ``pages(page_id, url, html)``: page_id, url, text.

    text: the blocks outside low branches in page order, parted by an empty line; empty for null and
    empty html and for pages without content. A null url belongs to the host without a name. Repeated
    rows are returned as often as they come and count once in the tree; other columns are ignored.
    Pages are parsed twice, for the tree and for their text, so that no text is written or shuffled.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][\w+.-]*:)?//(?:[^/@]*@)?([^/:?#]*)", 1))
    pages = pages.select("page_id", "url", "html", host.alias("host"))
    tree = site_tree(page_nodes(pages.filter("html is not null").withColumn("page_digest", F.xxhash64("html"))))
    judged = cut(verdicts(importances(tree), min_pages, least))
    kind = pages.schema["page_id"].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole, 2):
                low, spared = ([set(x or ()) for x in batch.column(k).to_pylist()] for k in (3, 4))
                texts = [main_text(h, a, b, least) for h, a, b in zip(batch.column(2).to_pylist(), low, spared, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return pages.join(judged, "host", "left").select("page_id", "url", "html", "low", "spared").mapInArrow(of, f"page_id {kind}, url string, text string")
