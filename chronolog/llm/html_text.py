"""Main text of web pages by wrapper induction.

Pages become trees of elements. Pages of one host and layout are aligned with the tree of the shortest of them by
simple tree matching; text that stands at one place of that tree and is the same in nearly all of these
different pages is template, what varies in its place is content. The content of a page is then its article, or,
without one, the element that holds most of the varying text; parts that by element, role or class are menus,
headers, footers, sidebars, notices, adverts, forms or comments are left out. A block goes as template when all of its
text is constant; headings and captions of an article stay, and an element of an article whose class only partly
tells that it is no main text goes when it is constant or made of links as well.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolog.llm.shared import written

#: Text at one place is template when so much of the host's different pages that have the place agree,
CONSTANT = 0.9
#: and at least so many pages have it.
PAGES = 5
#: Layouts' shortest pages and constants are broadcast up to so many bytes.
BROADCAST_BYTES = 32 << 20
#: Elements nested deeper stand beside each other at this depth, in page order.
DEEPEST = 200
#: Beyond so many pairs of siblings of two pages, the same alignment is found by array operations a row at a time.
PAIRS = 40_000
#: Sizes of matched siblings are remembered up to so many.
SIZES = 4_000_000

TAG = re.compile(
    r"""<!--.*?(?:-->|$)|<(script|style|noscript|template|textarea|iframe|svg|math)\b(?:"[^"]*"|'[^']*'|[^'">])*>.*?(?:</\1\s*>|$)
    |<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>|([^<]+|<)""",
    re.S | re.I | re.X,
)
MARKS = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(\bhidden\b)""")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin a block of their own; they also end an open paragraph. Fixed values.
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
#: Elements, roles and words of class or id that are not main text. Fixed values.
OUTSIDE = set("head title nav footer aside form script style noscript template iframe button select textarea dialog svg math object canvas menu".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
WORDS = set(
    "ad ads adv advert advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "popup modal overlay newsletter subscribe subscription signup sidebar aside widget menu nav navbar navigation breadcrumb breadcrumbs "
    "pagination pager share sharing social related recommended comment comments disqus replies respond reply footer header masthead "
    "login search toolbar skip copyright".split()
)
#: Words that tell what holds something, not what it is. Fixed values.
HOLDERS = set(
    "area bar bottom box block btn button buttons container content entry group inner item items left link links list module outer panel "
    "post posts right section slot stories thread title top unit view wrap wrapper".split()
)
MAIN = {"article", "main"}
#: Headings and captions, which stay in an article even if all pages have them.
HEADS = set("h1 h2 h3 h4 h5 h6 caption figcaption th dt summary".split())
#: Elements that make up a page's layout.
FRAMES = set("article aside center div footer form header main nav section table".split())


class Node:
    __slots__ = ("tag", "label", "kids", "out", "main", "maybe", "shape")

    def __init__(self, tag: str, label: str, out: bool = False, main: bool = False, maybe: bool = False) -> None:
        self.tag, self.label, self.out, self.main, self.maybe = tag, label, out, main, maybe
        self.kids: list[Node | str] = []
        self.shape = 0


def _told(value: str) -> tuple[bool, bool]:
    """Whether a class or id tells that the element is no main text, and whether a part of it does."""
    surely = partly = False
    for name in value.split():
        words = [w for w in re.split(r"[^a-z0-9]+", name) if w and not w.isdigit()]
        if not WORDS.isdisjoint(words):
            partly = True
            surely |= WORDS.union(HOLDERS).issuperset(words)
    return surely, partly


def _open(tag: str, rest: str) -> Node:
    """An element with its class as label, and whether it is outside of the main text, surely or maybe."""
    names, out, main, maybe = "", tag in OUTSIDE, tag in MAIN, False
    if rest:
        for key, a, b, c, hidden in MARKS.findall(rest):
            key, value = key.lower(), (a or b or c).lower()
            if hidden and not key:
                out = True
            elif key in ("class", "id"):
                names += f".{value}" if key == "class" else ""
                if tag not in ("html", "body", "article", "main"):
                    surely, partly = _told(value)
                    out |= surely
                    maybe |= partly
            elif key == "role":
                out |= value in ROLES
                main |= value in ("main", "article")
            elif key == "aria-hidden":
                out |= value == "true"
            elif key == "style":
                out |= "display:none" in value.replace(" ", "")
    return Node(tag, tag + names, out, main, maybe and not out)


def parse(page: str) -> Node:
    """The page's tree. Unclosed and stray tags are mended much as browsers do."""
    root = Node("#root", "#root")
    path = [root]
    for m in TAG.finditer(page):
        text = m[8]
        if text is not None:
            path[-1].kids.append(text)
            continue
        tag = m[3] or m[6]
        if tag is None:
            continue
        tag = tag.lower()
        if m[2] or m[5]:
            for k in range(len(path) - 1, 0, -1):
                if path[k].tag == tag:
                    del path[k:]
                    break
                if path[k].tag in ("table", "article", "body") and tag not in ("body", "html", "main", "section", "div"):
                    break
            continue
        if tag in BLOCK and tag not in ("html", "body"):
            _end_paragraph(path)
        if tag in CLOSES:
            for k in range(len(path) - 1, 0, -1):
                if path[k].tag in CLOSES[tag]:
                    del path[k:]
                    break
                if path[k].tag in HOLDS[tag]:
                    break
        node = _open(tag, m[4] or m[7] or "")
        path[min(len(path), DEEPEST) - 1].kids.append(node)
        if tag not in VOID and not (m[4] or m[7] or "").rstrip().endswith("/"):
            path.append(node)
    _shape(root)
    return root


def _shape(node: Node) -> int:
    """A number for the labels of the elements below, the same for equal trees."""
    node.shape = hash((node.label, *[_shape(k) for k in node.kids if not isinstance(k, str)]))
    return node.shape


def layout(tree: Node) -> int:
    """A number for the frames that make up a page: labels down to two levels below its body."""
    tops = [k for k in tree.kids if not isinstance(k, str)]
    while len(tops) == 1 and tops[0].tag in ("html", "body") or any(k.tag in ("html", "body") for k in tops):
        tops = [k for t in tops for k in ([x for x in t.kids if not isinstance(x, str)] if t.tag in ("html", "body") else [t])]
    frames = [k for k in tops if k.tag in FRAMES]
    inner = {f"{t.label}>{k.label}" for t in frames for k in t.kids if not isinstance(k, str) and k.tag in FRAMES}
    return text_code("|".join(sorted({t.label for t in frames} | inner)))


def _end_paragraph(path: list[Node]) -> None:
    for k in range(len(path) - 1, 0, -1):
        tag = path[k].tag
        if tag == "p":
            del path[k:]
            return
        if tag in BLOCK:
            return


def squeezed(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


def _alignment(left: list[Node], right: list[Node]) -> list[tuple[int, int]]:
    """Places of the siblings that pair up in the best alignment, for long lists.

    Equal trees are matched once. Only some rows of the table are kept, others are worked out again on the way back.
    """
    kinds: dict[tuple[str, int], int] = {}
    codes = np.array([kinds.setdefault((y.label, y.shape), len(kinds)) for y in right])
    models = [right[i] for i in np.unique(codes, return_index=True)[1]]
    known: dict[tuple[str, int], np.ndarray] = {}

    def below(above: np.ndarray, x: Node) -> np.ndarray:
        kind = x.label, x.shape
        if kind not in known:
            known.clear() if len(known) * len(models) > SIZES else None
            known[kind] = np.array([matched(x, y)[0] for y in models], np.int64)
        row = above.copy()
        np.maximum(row[1:], above[:-1] + known[kind][codes], out=row[1:])
        return np.maximum.accumulate(row)

    step = isqrt(len(left)) + 1
    row, kept = np.zeros(len(right) + 1, np.int64), []
    for i, x in enumerate(left):
        if i % step == 0:
            kept.append(row)
        row = below(row, x)
    found, j = [], len(right)
    for start in reversed(range(0, len(left), step)):
        rows = [kept.pop()]
        for x in left[start : start + step]:
            rows.append(below(rows[-1], x))
        i = len(rows) - 1
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                found.append((start + i, j))
    return found


def matched(a: Node, b: Node) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching: the most nodes of two trees that pair up, order and parents kept.

    Roots pair up if their labels are the same; children are aligned like sequences. Returns the number of
    pairs and the pairs.
    """
    if a.label != b.label:
        return 0, []
    left = [k for k in a.kids if not isinstance(k, str)]
    right = [k for k in b.kids if not isinstance(k, str)]
    result, size = [(a, b)], 1

    def pair(x: Node, y: Node) -> None:
        nonlocal size
        found = matched(x, y)
        size += found[0]
        result.extend(found[1])

    # equal trees at both ends pair up in some best alignment
    while left and right and left[0].shape == right[0].shape and left[0].label == right[0].label:
        pair(left.pop(0), right.pop(0))
    while left and right and left[-1].shape == right[-1].shape and left[-1].label == right[-1].label:
        pair(left.pop(), right.pop())
    if len(left) * len(right) > PAIRS:
        for i, j in _alignment(left, right):
            pair(left[i], right[j])
        return size, result
    width = len(right) + 1
    rows = [[0] * width]
    pairs: dict[tuple[int, int], tuple[int, list]] = {}
    for i, x in enumerate(left, 1):
        above, row = rows[-1], [0] * width
        for j, y in enumerate(right, 1):
            best = above[j] if above[j] >= row[j - 1] else row[j - 1]
            if x.label == y.label:
                found = matched(x, y)
                pairs[i, j] = found
                if above[j - 1] + found[0] > best:
                    best = above[j - 1] + found[0]
            row[j] = best
        rows.append(row)
    i, j = len(left), len(right)
    while i and j:
        if rows[i][j] == rows[i - 1][j]:
            i -= 1
        elif rows[i][j] == rows[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            result.extend(pairs[i + 1, j + 1][1])
    return rows[-1][-1] + size, result


def places(page: Node, seed: Node) -> list[tuple[int, Node, str]]:
    """Texts of the page at places of the seed: the place's number in the seed, the page's element and its text."""
    number: dict[int, int] = {}
    queue = [seed]
    while queue:
        node = queue.pop()
        number[id(node)] = len(number)
        queue.extend(k for k in reversed(node.kids) if not isinstance(k, str))
    own = lambda n: squeezed([html.unescape(k) for k in n.kids if isinstance(k, str)])
    return [(number[id(y)], x, text) for x, y in matched(page, seed)[1] if (text := own(x))]


def text_code(text: str) -> int:
    return zlib.crc32(text.encode()) << 31 ^ zlib.adler32(text.encode())


def _holds_main(node: Node) -> bool:
    return any(not isinstance(k, str) and not k.out and (k.main or _holds_main(k)) for k in node.kids)


def _mass(node: Node, skip: set[int], linked: bool = False) -> tuple[int, int]:
    """Characters of text under a node that count, outside and inside of links."""
    if node.out or id(node) in skip:
        return 0, 0
    free = bound = 0
    for kid in node.kids:
        if isinstance(kid, str):
            size = len(kid.strip())
            free, bound = (free, bound + size) if linked else (free + size, bound)
        else:
            a, b = _mass(kid, skip, linked or kid.tag == "a")
            free, bound = free + a, bound + b
    return free, bound


def roots(tree: Node, skip: set[int]) -> list[Node]:
    """Where the main text is: articles or main elements; else the smallest element with most of the free text."""
    found: list[Node] = []

    def articles(node: Node) -> None:
        for kid in node.kids:
            if isinstance(kid, str) or kid.out:
                continue
            if kid.main and not (kid.tag == "main" and _holds_main(kid)):
                found.append(kid)
            else:
                articles(kid)

    articles(tree)
    if found:
        return found
    node, total = tree, _mass(tree, skip)[0]
    while True:
        inner = [(k, _mass(k, skip)[0]) for k in node.kids if not isinstance(k, str) and k.tag in BLOCK]
        best = max(inner, key=lambda x: x[1], default=None)
        if best is None or best[0].tag == "p" or best[1] < 0.8 * total or not best[1]:
            return [node]
        node = best[0]


def _constant(node: Node, skip: set[int]) -> bool:
    """Whether a node holds text, and all of it is constant."""
    own = any(isinstance(k, str) and k.strip() for k in node.kids)
    inner = [k for k in node.kids if not isinstance(k, str) and any(_mass(k, set()))]
    return (own or bool(inner)) and (not own or id(node) in skip) and all(_constant(k, skip) for k in inner)


def blocks(root: Node, skip: set[int]) -> list[str]:
    """The texts of the blocks under a node, in page order, without those that are constant throughout.

    Under an article, constant headings stay; elements that their class partly tells to be no main text go there only if
    they are constant or at least half of links.
    """
    done: list[str] = []
    parts: list[str] = []
    varies = False
    article = root.main

    def flush() -> None:
        nonlocal varies
        text = squeezed(parts)
        if text and varies:
            done.append(text)
        parts.clear()
        varies = False

    def outside(node: Node) -> bool:
        if node.out or not node.maybe:
            return node.out
        free, bound = _mass(node, set())
        return not article or bound >= free or _constant(node, skip)

    def walk(node: Node, head: bool) -> None:
        nonlocal varies
        head = head or article and node.tag in HEADS
        if node.tag in BLOCK:
            flush()
        for kid in node.kids:
            if isinstance(kid, str):
                parts.append(html.unescape(kid))
                varies |= head or id(node) not in skip and bool(kid.strip())
            elif kid.tag == "br":
                parts.append(" ")
            elif not outside(kid):
                walk(kid, head)
        if node.tag in BLOCK:
            flush()

    walk(root, False)
    flush()
    return done


def main_text(page: str, seed: Node | None = None, constant: dict[int, int] | None = None, tree: Node | None = None) -> str:
    """The page's main text, without what is template at the seed's places."""
    tree = tree or parse(page)
    skip: set[int] = set()
    if seed is not None and constant:
        for k, node, text in places(tree, seed):
            if constant.get(k) == text_code(text):
                skip.add(id(node))
    return "\n\n".join(b for n in roots(tree, skip) for b in blocks(n, skip))


def _light(df: DataFrame, size: Column) -> DataFrame:
    """``df``, marked for broadcast if its rows' sizes are counted to sum up to little."""
    total = df.agg(F.sum(size)).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def extract(pages: DataFrame) -> DataFrame:
    """Each row's ``page_id``, ``url``, ``text`` and ``n_chars``, its code points.

    Null or empty html has an empty text. Pages without a host in their url, or of a layout that its host has few pages
    of, are judged by themselves. Equal pages of a host count once for what is constant; repeated rows give repeated
    results. Rows of a host need not meet: the layouts' shortest pages and constants go to all of them while they are
    few bytes; beyond, they are joined by host and layout.
    """
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)", 1))
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.nullif(host, F.lit("")).alias("host"))
    kind = pages.schema["page_id"].dataType.simpleString()

    def laid_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [layout(parse(page)) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.int64())], names=["page_id", "url", "html", "host", "layout"])

    rows = rows.mapInArrow(laid_out, f"page_id {kind}, url string, html string, host string, layout bigint")
    full = rows.where("host IS NOT NULL AND html <> ''")
    shortest = F.min(F.struct(F.length("html").alias("n"), "html")).alias("s")
    grouped = full.groupBy("host", "layout").agg(shortest, F.count("*").alias("pages")).where(F.col("pages") >= PAGES)
    seeds = written(grouped.select("host", "layout", F.col("s.html").alias("seed")))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Node] = {}
        for batch in batches:
            hosts, layouts, numbers, codes, marks = [], [], [], [], []
            for host, code, page, seed in zip(*(c.to_pylist() for c in batch.columns)):
                if seed not in known:
                    known.clear() if len(known) > 200 else None
                    known[seed] = parse(seed)
                for k, _, text in places(parse(page), known[seed]):
                    hosts.append(host)
                    layouts.append(code)
                    numbers.append(k)
                    codes.append(text_code(text))
                    marks.append(text_code(page))
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(layouts, pa.int64()), pa.array(numbers, pa.int32()), pa.array(codes, pa.int64()), pa.array(marks, pa.int64())],
                names=["host", "layout", "place", "code", "page"],
            )

    key = ["host", "layout"]
    met = full.select(*key, "html").join(_light(seeds, F.octet_length("seed")), key).select(*key, "html", "seed")
    aligned = met.mapInArrow(align, "host string, layout bigint, place int, code bigint, page bigint")
    agreed = aligned.distinct().groupBy(*key, "place", "code").count().groupBy(*key, "place")
    constant = agreed.agg(F.sum("count").alias("pages"), F.max(F.struct("count", "code")).alias("top"))
    constant = constant.where((F.col("pages") >= PAGES) & (F.col("top.count") >= CONSTANT * F.col("pages")))
    places_ = F.map_from_entries(F.collect_list(F.struct("place", "top.code"))).alias("constant")
    wrappers = written(constant.groupBy(*key).agg(places_).join(seeds, key))
    size = F.octet_length("seed") + 16 * F.size("constant")
    joined = rows.join(_light(wrappers, size), key, "left").select("page_id", "url", "html", "seed", "constant")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Node] = {}
        for batch in batches:
            texts = []
            for page, seed, constant in zip(*(batch.column(k).to_pylist(maps_as_pydicts="strict") for k in (2, 3, 4))):
                if seed is not None and seed not in known:
                    known.clear() if len(known) > 200 else None
                    known[seed] = parse(seed)
                texts.append(main_text(page, known.get(seed), constant))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    done = joined.mapInArrow(work, f"page_id {kind}, url string, text string")
    return done.withColumn("n_chars", F.char_length("text").cast("bigint"))
