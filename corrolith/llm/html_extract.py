"""Main text of pages by the maximum-scoring subsequence of words and tags.

A page becomes a sequence of text nodes and tags. Words score positive and tags negative; the weights are log-odds of lying
in the main content, counted over all pages whose content is marked by an article or main element. On such pages the place
of a word or tag tells whether it lies inside the mark, so words and tags there learn their own weights, and those around
it score negative; on other pages the place is the block that holds it. One linear scan finds the contiguous region with the
largest sum, and that region is the result. Menus, sidebars, adverts, forms, reader comments and the like are left out of
the region by what their elements are and are called.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrolith.llm.common import map_text

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^'\">]|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre section summary table tbody tfoot thead title tr ul".split())
GAP = frozenset("br td th img wbr".split()) - {"wbr"}
#: Elements that are never content.
LEFT_OUT = frozenset("nav footer aside form script style noscript template svg canvas iframe object embed audio video select button textarea input head title menu dialog noembed noframes datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Classes (whole tokens) and ids (whole values) that name what is not content.
NAMES = re.compile(
    r"(?:ads?|adv|advert\w*|adsense|adbox|adslot|(?:ads?|advert\w*)[_-](?:box|slot|unit|banner|container|wrapper)|banner|sponsor\w*|promo\w*|side-?bar|sidebar[_-](?:left|right|primary|secondary)|side-?nav|nav|navbar|navigation|(?:main|site)[_-]?nav(?:igation)?|"
    r"nav[_-](?:menu|links|bar)|menu|menus|topbar|breadcrumbs?|pagination|pager|footer|site-?footer|page-?footer|masthead|site-?header|page-?header|cookies?|consent|gdpr|cookie[_-](?:banner|notice|consent|bar)|notices?|alert|popup|modal|overlay|"
    r"newsletter|newsletter[_-](?:signup|form|box)|subscribe|subscription|signup|login|paywall|share|sharing|social|(?:social|share|sharing)[_-](?:share|sharing|links|buttons|bar|icons)|related|related[_-](?:posts|articles|stories|links|content)|recommend\w*|"
    r"widget\w*|comments?|comments?[_-](?:list|form|area|section|body|respond)|disqus\w*|respond|replies|reply|discussion|skip-?link|toolbar|search-?form)",
    re.I,
)
#: Of these, classes that also mark passages of an article; inside one they don't count.
PASSAGES = frozenset("notice notices alert discussion".split())
HEADED = frozenset("section h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCK - {"option", "optgroup", "legend", "caption", "body", "html", "head", "summary", "title"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
#: Weight of a word inside an element that is left out; tags there weigh nothing.
DROPPED = -0.2
#: Places inside and outside the mark of a page that has one, and the weights of words and tags in places not counted.
IN, OFF = "in/", "off/"
UNSEEN = {IN: (1.0, -0.001), OFF: (-1.0, -0.5), "": (1.0, -0.1)}
#: Largest weight of a place.
MOST = 3.0


class Node:
    """A text node or a tag. key: what its weight hangs on. words: 0 for tags. marked: number of the article or main
    element around it, 0 for none. out: inside an element that is left out. cut: a block ends here."""

    __slots__ = ("key", "words", "text", "marked", "out", "cut")

    def __init__(self, key: str, words: int, text: str, marked: int, out: bool, cut: bool):
        self.key, self.words, self.text, self.marked, self.out, self.cut = key, words, text, marked, out, cut


#: Why an element is left out: its class or id, or what it is.
NAMED, KIND = 1, 2


def _left_out(name: str, attributes: str, inside: bool) -> int:
    """NAMED or KIND, 0 where the element stays."""
    if name in LEFT_OUT or name == "header" and not inside:
        return KIND
    if not attributes or name in ("body", "html", "article", "main") and "comment" not in attributes.lower():
        return 0
    named = 0
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key == "class" and any(NAMES.fullmatch(c) and not (inside and c.lower() in PASSAGES) for c in value.split()):
            named = NAMED
        if key == "id" and NAMES.fullmatch(value.strip()) and not (inside and name in HEADED):
            named = NAMED
        if key == "role" and value.lower() in ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return KIND
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return KIND
    return named


def parse(page: str) -> list[Node]:
    """The sequence of a page. Where all that the page marks lies in elements left out by name, their articles stay."""
    nodes = _parse(page, False)
    if not any(x.marked and x.words and not x.out for x in nodes) and re.search(r"<article\b", page, re.I):
        return _parse(page, True)
    return nodes


def _parse(page: str, articles: bool) -> list[Node]:
    """One pass. Unclosed and crossing tags are closed as browsers do in the common cases. A main element, and with
    articles an article too, ends what an element around it leaves out by name."""
    nodes: list[Node] = []
    stack: list[tuple[str, int, int]] = []  # element, why left out, marked
    count, at, n = 0, 0, len(page)
    out, marked = 0, 0

    def text(s: str) -> None:
        s = html.unescape(s) if "&" in s else s
        words = len(s.split())
        if words:
            link = any(e[0] == "a" for e in stack[-3:])
            holder = next((e[0] for e in reversed(stack) if e[0] in BLOCK), "")
            nodes.append(Node(f"{'a:' if link else ''}{holder}", words, s, marked, out > 0, False))
        elif s:
            nodes.append(Node("", 0, " ", marked, out > 0, False))

    def tag(name: str, cut: bool) -> None:
        nodes.append(Node(f"<{name}>", 0, " " if name in GAP else "", marked, out > 0, cut))

    def pop() -> None:
        nonlocal out, marked
        name, _, _ = stack.pop()
        tag(name, name in BLOCK)
        out, marked = (stack[-1][1], stack[-1][2]) if stack else (0, 0)

    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        if m[0].startswith("<![CDATA["):
            text(m[0][9:].removesuffix("]]>"))
            continue
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = m[1] or m[4], (m[3] or m[6] or "").strip()
        if closing:
            if name == "p" and all(e[0] != "p" for e in stack):
                tag("p", True)
            elif any(e[0] == name for e in reversed(stack)):
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if name in CLOSES_P:
            for k in range(len(stack) - 1, -1, -1):  # a paragraph ends where a block begins
                if stack[k][0] == "p":
                    while len(stack) > k:
                        pop()
                    break
                if stack[k][0] in BLOCK:
                    break
        if name in SAME:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in SCOPE[name]:
                    break
                if stack[k][0] in SAME[name]:
                    while len(stack) > k:
                        pop()
                    break
        if name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(page, at)
            tag(name, name in BLOCK)
            at = n if not close else (page.find(">", close.end()) + 1 or n)
            continue
        own = _left_out(name, attributes, marked > 0)
        around = 0 if out == NAMED and (name == "main" or articles and name == "article") else out
        drop = max(around, own)
        if name in VOID:
            if not drop:
                tag(name, name in BLOCK)
            continue
        if name in ("article", "main") and not drop and not marked:
            count += 1
            marked = count
        out = drop
        stack.append((name, out, marked))
        tag(name, name in BLOCK)
    return nodes


class Weights:
    """words and tags: weight of a word in each place and of each tag; other places have those of UNSEEN."""

    def __init__(self, words: dict[str, float] | None = None, tags: dict[str, float] | None = None):
        self.words, self.tags = words or {}, tags or {}

    def of(self, node: Node, has_mark: bool) -> float:
        place = (IN if node.marked else OFF) if has_mark else ""
        if node.words:
            return node.words * (DROPPED if node.out else self.words.get(place + node.key, UNSEEN[place][0]))
        return self.tags.get(place + node.key, UNSEEN[place][1]) if node.key and not node.out else 0.0


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run with the largest sum; the first and longest of equals; empty if none is positive."""
    best, at, total, start, end = 0.0, 0, 0.0, 0, 0
    for i, s in enumerate(scores):
        if total < 0:
            total, at = 0.0, i
        total += s
        if total > best:
            best, start, end = total, at, i + 1
    return start, end


def has_mark(nodes: list[Node]) -> bool:
    """Whether the page marks its content."""
    return any(x.marked and x.words and not x.out for x in nodes)


def main_text(page: str | None, weights: Weights) -> str:
    """The main text: blocks joined by blank lines. Words of the region that score negative by themselves are no part."""
    if not page:
        return ""
    nodes = parse(page)
    mark = has_mark(nodes)
    scores = [weights.of(x, mark) for x in nodes]
    start, end = best_region(scores)
    region = [x for x, w in zip(nodes[start:end], scores[start:end]) if not x.words or w > 0]
    blocks: list[str] = []
    parts: list[str] = []
    for x in region:
        if x.cut:
            if parts:
                blocks.append(" ".join("".join(parts).split()))
                parts = []
        elif not x.out and (x.words or x.text):
            parts.append(x.text)
    if parts:
        blocks.append(" ".join("".join(parts).split()))
    return "\n\n".join(b for b in blocks if b)


_INLINE = ("<a>", "<b>", "<i>", "<em>", "<strong>", "<span>", "<br>", "<img>", "<td>", "<th>", "a:", "")


def _counted(key: str) -> str:
    """The place under which a node counts; unknown element names share one."""
    return key if key.strip("<>a:") in BLOCK or key in _INLINE else "<?>" if key.startswith("<") else "?"


def learn_weights(pages: DataFrame, html_col: str = "html") -> Weights:
    """Weights from all pages that mark their content, the labelled pages: log-odds of lying inside the mark.

    Only counts by place come to the driver, and there are as many places as element names in three kinds. Without
    labelled pages the weights of UNSEEN hold. Null and empty pages, and an empty table, count nothing.
    """

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            inside, outside = Counter(), Counter()
            for page in batch.column(0).to_pylist():
                nodes = parse(page)
                if has_mark(nodes):
                    for x in nodes:
                        if x.key and not x.out:
                            for place in ((IN if x.marked else OFF) + _counted(x.key), _counted(x.key)):
                                (inside if x.marked else outside)[place] += max(1, x.words)
            keys = sorted(inside.keys() | outside.keys())
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([inside[k] for k in keys], pa.int64()), pa.array([outside[k] for k in keys], pa.int64())], ["place", "inside", "outside"])

        return each

    rows = pages.filter(F.col(html_col).isNotNull()).select(F.col(html_col).cast("string").alias("html"))
    counts = map_text(rows, "place string, inside long, outside long", "html", make).groupBy("place").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).collect()
    words, tags = {}, {}
    for place, inside, outside in counts:
        odds = max(-MOST, min(MOST, math.log((inside + 1) / (outside + 1))))
        kind = IN if place.startswith(IN) else OFF if place.startswith(OFF) else ""
        if place[len(kind) :].startswith("<"):
            tags[place] = UNSEEN[IN][1] if kind == IN else -0.2 - max(0.0, -odds)
        else:
            words[place] = odds if kind == OFF else max(0.1, odds)
    return Weights(words, tags)


def extract(pages: DataFrame, weights: Weights, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars long (code points).

    A null or empty page, and one without content, has an empty text; repeated rows and null ids stay; an empty table gives
    none; other columns are not carried, so they may have any names. Whole pages are read, however long or deeply nested;
    of regions with equal sums the first and longest stays.
    """

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [main_text(p, weights) for p in batch.column(2).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

        return each

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return map_text(rows, "page_id long, url string, text string, n_chars long", "html", make)
