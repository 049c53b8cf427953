"""Main text of web pages by consensus host paths.

Every page scores its own containers: a container gains the text of the blocks it holds, less what is link text, and
half of what its child containers gain. The page votes for its best container's generalised path: tags from the root
on, each with its classes, digits made #. Votes are summed per host in Spark, pre-aggregated by batch. A path wins with at
least two votes and half of the best path's, among the host's MAX_PATHS paths of most votes. Pages are then extracted again
from the host's winning paths, which helps pages with little text of their own or with a long advert; a page that has none
of these paths, or whose host has none, uses its own best container.

What is extracted is the whole article that such a container is part of: the article element around it, else the main
element; where there is neither, the lowest ancestor below the body whose other text is not mostly link text. Text that
lies right in the ancestors above (up to main for an article element, to the body else), outside their other
containers, goes with it unless it is mostly link text. Captions, formulas, text of drawings and the content of objects
are text.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments are left out by element name,
by words of their class or id, and by hidden markers. A class or id counts by what it names: the word stands last
(cookie-notice), or before general words only (ad-slot, menu-item), not behind a modifier (has-sidebar, no-comments). Such
words, and a form element, are no evidence on a wrapper: an element that holds the main element, or most of the page's text
with an article element or three paragraphs in it; words for comments, adverts and consent always count. Character references are decoded, white space becomes one space,
blocks are joined by one space.

Defined cases: a null html is empty and has the text ""; a null url, or one without a host, belongs to the host "";
very long and deeply nested pages take time and memory in proportion to their length; markup cut off at the end, unclosed elements and stray end tags are tolerated; ties go to the path that sorts first;
repeated rows vote and are extracted each for itself; extra columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from resonant.llm.common import lookup, materialize, releasing

#: Winning paths of up to so many bytes together are broadcast; above it the join shuffles.
BROADCAST_BYTES = 32_000_000
#: A path wins if it has this share of the votes of its host's best path.
WIN_SHARE = 0.5
#: Winning paths of a host; a page with none of them is extracted by its own best container.
MAX_PATHS = 16

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^>]*\Z""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "noframes", "xmp"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img",
    "math", "mfenced", "mfrac", "mi", "mn", "mo", "mover", "mpadded", "mphantom", "mroot", "mrow", "ms", "mspace", "msqrt", "mstyle", "msub", "msubsup", "msup", "mtext", "munder", "munderover", "semantics",
}
_CONTAINERS = {"article", "main", "section", "div", "td", "body"}
_CLOSES_P = {
    "address", "article", "aside", "blockquote", "center", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul",
}
_SAME_KIND = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
_SCOPES = {"table", "ul", "ol", "dl", "article", "section", "main", "body", "html", "div", "td", "th"}
_LEFT_OUT = {"head", "nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "audio", "video", "canvas", "fieldset", "annotation", "annotation-xml", "defs", "desc", "metadata"}
# What a class or id names. Words of the first kind count even on a wrapper.
_ALWAYS_WORDS = re.compile(r"(ads?|advert\w*|adsense|sponsor\w*|cookies?|consent|gdpr|popup|modal|comments?|commentlist|disqus|replies|reactions|respond)\Z")
_WORDS = re.compile(
    r"(promo\w*|banner|notices?|newsletter|subscribe|subscription|signup|sidebar|widgets?|nav|navbar|navigation|menu|breadcrumbs?|pagination|pager|header|masthead|footer|share|sharing|social|related|recommend\w*|toolbar|login|searchform)\Z"
)
# General words, which leave what stands before them as what is named.
_GENERAL = re.compile(
    r"(area|bar|block|bottom|box|boxes|button|buttons|card|cards|center|col|column|container|content|fixed|floating|form|group|holder|icons?|inner|item|items|label|left|link|links|list|message|outer|overlay|panel|placeholder|position|primary|region|right|row|secondary|section|slot|space|sticky|text|thread|title|top|unit|wrap|wrapper|zone|[a-z]|[a-z]{0,2}#+)\Z"
)
_MODIFIERS = {"has", "have", "no", "non", "with", "without", "hide", "hidden", "show", "is", "not", "toggle", "enable", "disable", "open", "opened", "closed", "before", "after", "under", "above", "below"}
_SEGMENTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_ALWAYS, _UNLESS_WRAPPER = 1, 2


@dataclass(slots=True)
class Node:
    tag: str
    #: The last step of the path from the root on, and a hash of the whole path.
    step: str
    mark: int
    #: The element whose evidence leaves this one out, itself or one above.
    left_out: Node | None
    #: The nearest container above, and the nearest one from here on up.
    outer: Node | None
    container: Node | None = None
    #: The element above that has a step, and whether this one has.
    parent: Node | None = None
    #: A container's text is pieces[first:last] of the page; own: its blocks' text less their link text.
    first: int = 0
    last: int = 0
    own: float = 0.0
    gain: float = 0.0
    #: links: its blocks' link text less their other text. all_own and all_links count the containers in it too.
    links: float = 0.0
    all_own: float = 0.0
    all_links: float = 0.0
    #: Of an element left out by evidence that doesn't hold for wrappers: its place among all elements and what it holds.
    place: int = -1
    plain: int = 0
    paragraphs: int = 0
    article: bool = False
    main: bool = False

    @property
    def path(self) -> str:
        steps, node = [], self
        while node is not None:
            steps.append(node.step)
            node = node.parent
        return ">".join(reversed(steps))


@dataclass(slots=True)
class Page:
    pieces: list[str] = field(default_factory=list)
    containers: list[Node] = field(default_factory=list)
    #: The elements left out by evidence that doesn't hold for wrappers.
    doubtful: list[Node] = field(default_factory=list)

    def text(self, nodes: list[Node]) -> str:
        """White space made one space, ends trimmed, of these containers in page order, none twice."""
        return self._joined([(node.first, node.last) for node in nodes])

    def _joined(self, spans: list[tuple[int, int]]) -> str:
        out, at = [], 0
        for first, last in sorted(spans):
            out += [*self.pieces[max(at, first) : last], " "]
            at = max(at, last)
        return " ".join("".join(out).split())

    def article(self, nodes: list[Node]) -> str:
        """The text of the articles that these containers are part of, in page order, none twice."""
        inside: dict[int, list[Node]] = {}
        for c in self.containers:
            inside.setdefault(id(c.outer), []).append(c)
        spans, seen = [], set()
        for node in nodes:
            top = _enclosing(node)
            spans.append((top.first, top.last))
            up = top.outer if top.tag != "main" and (top.tag != "article" or _above(top, "main")) else None
            while up is not None and id(up) not in seen:
                seen.add(id(up))
                if up.own > up.links:
                    at = up.first
                    for c in inside.get(id(up), ()):
                        spans.append((at, c.first))
                        at = c.last
                    spans.append((at, up.last))
                up = up.outer if up.tag != "main" else None
        return self._joined(spans)

    def best(self) -> Node | None:
        """The container with the largest score; of equal ones the path that sorts first."""
        most = max((c.gain for c in self.containers), default=0)
        ties = [c for c in self.containers if c.gain == most > 0]
        return min(ties, key=lambda c: c.path) if len(ties) > 1 else ties[0] if ties else None

    def at(self, path: str) -> list[Node]:
        """The containers of this path."""
        mark = _mark(path.split(">"))
        return [c for c in self.containers if c.mark == mark]

    def wrappers(self) -> set[int]:
        """Places of the elements that were left out though they wrap the page's text."""
        kept = self.containers[0].all_own
        return {d.place for d in self.doubtful if d.main or (d.article or d.paragraphs > 2) and d.plain > 4 * (kept + sum(o.plain for o in self.doubtful if o is not d))}


def _mark(steps: list[str]) -> int:
    mark = 0
    for step in steps:
        mark = hash((mark, step))
    return mark


def _above(node: Node, tag: str) -> Node | None:
    """The nearest container of this tag from here on up."""
    while node is not None and node.tag != tag:
        node = node.outer
    return node


def _enclosing(node: Node) -> Node:
    """The container that holds the whole article: see the module's text."""
    if named := _above(node, "article") or _above(node, "main"):
        return named
    up = node.outer
    while up is not None and up.tag not in ("body", ""):
        if up.all_own - node.all_own > up.all_links - node.all_links:
            return up
        up = up.outer
    return node


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw)} if raw.strip(" /") else {}


def _step(tag: str, attributes: dict[str, str]) -> str:
    classes = sorted(set(re.sub(r"\d+", "#", attributes.get("class", "")).lower().replace(">", "_").split()))
    return ".".join([tag, *classes])


def _names(token: str) -> int:
    """What kind of evidence a class or id is that its element is no part of an article."""
    words = [w.lower() if not w.isdigit() else "#" for w in _SEGMENTS.findall(token)]
    if not words or words[0] in _MODIFIERS:
        return 0
    joined = ["".join(words[k : k + 2]) for k in range(len(words))]  # side-bar, nav-bar, search-form
    for k in range(len(words) - 1, -1, -1):
        word, pair = words[k], joined[k]
        if _ALWAYS_WORDS.match(word):
            return _ALWAYS
        if _WORDS.match(word) or _WORDS.match(pair):
            return _UNLESS_WRAPPER
        if not _GENERAL.match(word):
            return 0
    return 0


def _evidence(tag: str, attributes: dict[str, str]) -> int:
    if tag == "form":
        return _UNLESS_WRAPPER
    if tag in _LEFT_OUT or "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return _ALWAYS
    if not attributes or tag in ("html", "body", "main"):
        return 0
    if attributes.get("role", "") in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert"):
        return _ALWAYS
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", "")):
        return _ALWAYS
    kinds = {_names(t) for t in f"{attributes.get('class', '')} {attributes.get('id', '')}".split()}
    return _ALWAYS if _ALWAYS in kinds else _UNLESS_WRAPPER if _UNLESS_WRAPPER in kinds else 0


def parse(page: str | None) -> Page:
    """The text pieces that are not left out, and the containers in page order with their scores."""
    parsed = _parse(page, set())
    spared: set[int] = set()
    while (more := parsed.wrappers()) - spared:
        spared |= more
        parsed = _parse(page, spared)
    return parsed


def _parse(page: str | None, spared: set[int]) -> Page:
    out = Page()
    root = Node("", "", _mark([""]), None, None)
    root.container = root
    stack, out.containers = [root], [root]
    links = foreign = place = 0
    opened: Counter[str] = Counter()
    block = [0, 0]  # characters of the open block that are not link text, and those that are

    def close_block() -> None:
        if block[0] > block[1]:
            stack[-1].container.own += block[0] - block[1]
        else:
            stack[-1].container.links += block[1] - block[0]
        block[:] = [0, 0]
        out.pieces.append(" ")

    def pop_to(k: int) -> None:
        nonlocal links, foreign
        while len(stack) > k:
            node = stack[-1]
            if node.tag not in _INLINE:
                close_block()
            links -= node.tag == "a"
            foreign -= node.tag in ("svg", "math")
            opened[node.tag] -= 1
            node.last = len(out.pieces)
            stack.pop()

    page = page or ""
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        raw = page[at : m.start() if m else n]
        if raw and not stack[-1].left_out:
            text = html_lib.unescape(raw)
            out.pieces.append(text)
            block[links > 0] += len(text.strip())
        elif raw and not links and stack[-1].left_out.place >= 0:
            stack[-1].left_out.plain += len(raw.strip())
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if opened[tag] > 0:
                pop_to(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))
            continue
        if (foreign or tag in ("svg", "math")) and (m[3] or m[6] or "").endswith("/"):
            continue
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.IGNORECASE).search(page, at)
            close = page.find(">", end.start()) if end else -1
            at = close + 1 if close >= 0 else n
            continue
        if tag in _VOID:
            if tag == "br":
                out.pieces.append(" ")
            elif tag not in _INLINE:
                close_block()
            continue
        ends = _SAME_KIND.get(tag, set()) | ({"p"} if tag in _CLOSES_P else set())
        for k in range(len(stack) - 1, 0, -1) if any(opened[x] > 0 for x in ends) else ():
            if stack[k].tag in ends:
                pop_to(k)
                break
            if stack[k].tag in _SCOPES:
                break
        above, attributes = stack[-1], _attributes(m[3] or m[6] or "")
        if tag not in _INLINE:
            close_block()
        evidence = 0 if above.left_out and above.left_out.place < 0 else _evidence(tag, attributes)
        if place in spared:
            evidence = 0
        step = "" if tag in _INLINE else _step(tag, attributes)
        node = Node(tag, step or above.step, hash((above.mark, step)) if step else above.mark, above.left_out, above.container, parent=above if step else above.parent, first=len(out.pieces))
        if (doubt := above.left_out) is not None and doubt.place >= 0 and not evidence:
            doubt.main |= tag == "main"
            doubt.article |= tag == "article"
            doubt.paragraphs += tag == "p"
        if evidence and (above.left_out is None or evidence == _ALWAYS):
            node.left_out = node
            if evidence == _UNLESS_WRAPPER:
                node.place = place
                out.doubtful.append(node)
        place += 1
        node.container = node if tag in _CONTAINERS and node.left_out is None else above.container
        if node.container is node:
            out.containers.append(node)
        stack.append(node)
        opened[tag] += 1
        links += tag == "a"
        foreign += tag in ("svg", "math")
    pop_to(1)
    close_block()
    root.last = len(out.pieces)
    for node in reversed(out.containers):
        node.gain += node.own
        node.all_own += node.own
        node.all_links += node.links
        if node.outer is not None:
            node.outer.gain += node.gain / 2
            node.outer.all_own += node.all_own
            node.outer.all_links += node.all_links
    return out


def extract(page: str | None, paths: list[str] | None) -> str:
    """The text of the article at the first of these paths that the page has, else at its own best container."""
    parsed = parse(page)
    for path in paths or ():
        if nodes := parsed.at(path):
            return parsed.article(nodes)
    best = parsed.best()
    return parsed.article([best]) if best else ""


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def host_paths(pages: DataFrame, win_share: float = WIN_SHARE) -> DataFrame:
    """host and paths, the winning ones from most votes on."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes: Counter[tuple[str, str]] = Counter()
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if best := parse(page.as_py()).best():
                    votes[host, best.path] += 1
            keys = list(votes)
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in keys], pa.string()), pa.array([p for _, p in keys], pa.string()), pa.array([votes[k] for k in keys], pa.int64())], names=["host", "path", "votes"])

    votes = pages.select(host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html")).mapInArrow(releasing(vote), "host string, path string, votes long")
    total = votes.groupBy("host", "path").agg(F.sum("votes").alias("votes")).where("votes > 1")
    order = Window.partitionBy("host").orderBy(F.desc("votes"), "path")
    best = total.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= MAX_PATHS)
    won = best.withColumn("most", F.max("votes").over(Window.partitionBy("host"))).where(F.col("votes") >= win_share * F.col("most"))
    ranked = won.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("rank", "path"))).alias("ranked"))
    return ranked.select("host", F.transform("ranked", lambda r: r["path"]).alias("paths"))


def main_text(pages: DataFrame, win_share: float = WIN_SHARE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    winners = materialize(host_paths(pages, win_share))
    size = winners.agg(F.sum(F.octet_length(F.concat_ws(">", "host", "paths")))).first()[0] or 0
    source = lookup(pages.select("page_id", "url", "html"), host_of(F.col("url")), winners, size <= broadcast_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(page.as_py(), paths) for page, paths in zip(batch.column(2), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return source.mapInArrow(releasing(run), f"page_id {source.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
