"""Main text of web pages by composite text density."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from cubewright.llm.common import batches_of, map_arrow

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text for the parser, up to their end tag.
RAW = frozenset("script style textarea title noscript template xmp iframe noembed noframes".split())
#: Elements that hold no article text.
DROPPED = frozenset(
    "script style noscript template iframe object embed svg math canvas audio video map head title nav footer aside button input select textarea label menu dialog xmp noembed noframes".split()
)
BLOCKS = frozenset(
    "html body article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption header main address hr details summary center form fieldset".split()
)
#: Furniture like what a mark names, but these may hold the whole page.
WRAPPERS = frozenset("form fieldset".split())
#: What can be a bar of links within an article that no article or main element bounds, and what
#: else can be one where the chosen subtree lays out a page rather than holds an article.
BARS = frozenset("div section center address details".split())
LISTS = frozenset("ul ol dl table thead tbody tfoot tr".split())
PAGE_BARS = BARS | LISTS | {"td", "th"}
LAYOUT = frozenset("#page html body table thead tbody tfoot tr".split())
#: Links that a bar has at least; it is a bar if they make up over half of it, a list or table if
#: over nine tenths.
BAR_LINKS = 3
#: What a start tag of each name closes, and where that search stops.
_P_CLOSERS = BLOCKS - {"html", "body", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "dt", "dd", "li"} | {"nav", "aside", "footer", "menu"}
_IMPLIED = {
    "li": (frozenset({"li"}), frozenset("ul ol menu".split())),
    "dt": (frozenset("dt dd".split()), frozenset({"dl"})),
    "dd": (frozenset("dt dd".split()), frozenset({"dl"})),
    "tr": (frozenset({"tr"}), frozenset("table tbody thead tfoot".split())),
    "td": (frozenset("td th".split()), frozenset("tr table".split())),
    "th": (frozenset("td th".split()), frozenset("tr table".split())),
    "option": (frozenset({"option"}), frozenset({"select"})),
}
#: An end tag isn't carried past these.
_SCOPE = frozenset("table td th html body article section main".split())
#: Words of class, id and role that mark page furniture.
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertisements advertising banner sponsor sponsored promo promotion sidebar side menu menubar nav navbar navigation breadcrumb breadcrumbs "
    "footer comment comments commentlist respond reply replies disqus cookie cookies consent notice notices alert gdpr popup modal overlay newsletter subscribe subscription signup login share "
    "sharing social related recommended pagination pager toolbar widget widgets masthead topbar search complementary contentinfo dialog form skip hidden".split()
)
#: A class, id or role that begins with one of these names what the node is; a node that holds most
#: of the page's text stays furniture then, unless hardly any text is left elsewhere.
STRICT = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion comment comments commentlist respond reply replies disqus cookie cookies consent gdpr popup "
    "modal overlay newsletter subscribe subscription signup login dialog".split()
)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^'\">]|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>", re.DOTALL)
_MARK = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_HIDDEN = re.compile(r"""^(?:[^"']|"[^"]*"|'[^']*')*?(?<!\S)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.IGNORECASE)
_PART = re.compile(r"[A-Za-z]+")
_END_RAW = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.IGNORECASE) for t in RAW}


def _furniture(attrs: str) -> int:
    """2 where a mark begins with a STRICT word, 1 where it holds a word of furniture, else 0."""
    found = 0
    if attrs:
        for m in _MARK.finditer(attrs):
            for mark in (m[2] or m[3] or m[4] or "").split():
                words = [w.lower() for w in _PART.findall(mark)]
                if any(w in FURNITURE for w in words):
                    if words[0] in STRICT:
                        return 2
                    found = 1
    return found


class _Open:
    """The open elements, with the places of each tag, so that the innermost one of some tags is
    found without walking the stack; however deep a page nests, a tag costs no more."""

    def __init__(self) -> None:
        self.nodes, self.tags = [0], ["#page"]
        self.places: dict[str, list[int]] = {"#page": [0]}

    def push(self, node: int, tag: str) -> None:
        self.places.setdefault(tag, []).append(len(self.nodes))
        self.nodes.append(node)
        self.tags.append(tag)

    def innermost(self, tags: frozenset[str] | tuple[str, ...]) -> int:
        """The place of the innermost open element of these tags, or 0."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def close(self, place: int) -> None:
        for t in self.tags[place:]:
            self.places[t].pop()
        del self.nodes[place:], self.tags[place:]


class Page:
    """A page's DOM as parallel lists, parents before children.

    tag, parent, dropped (furniture, or inside it) and linked (a link, or inside one) of each node;
    runs: (node, text) in page order, and (node, None) where a line breaks.
    """

    def __init__(self, source: str):
        self.tag, self.parent, self.dropped, self.linked = ["#page"], [-1], [False], [False]
        self.runs: list[tuple[int, str | None]] = []
        self.mark = [0]
        open_, at, n = _Open(), 0, len(source)
        stack = open_.nodes
        last_end = source.rfind(">")
        tag, parent, dropped = self.tag, self.parent, self.dropped

        def text(s: str) -> None:
            if s and not dropped[stack[-1]]:
                self.runs.append((stack[-1], html.unescape(s) if "&" in s else s))

        while at < n:
            lt = source.find("<", at)
            if lt < 0 or (lt > last_end and not source.startswith("<!", lt)):
                text(source[at:])
                break
            m = _TOKEN.match(source, lt)
            if m is None:  # a plain sign
                after = source.find("<", lt + 1)
                after = n if after < 0 else after
                text(source[at:after])
                at = after
                continue
            text(source[at:lt])
            at = m.end()
            name = m[2] or m[5]
            if name is None:
                continue
            name, closing, attrs = name.lower(), m[1] or m[4], m[3] or m[6] or ""
            if closing:
                k = open_.innermost((name,))
                if k and (name in _SCOPE or k > open_.innermost(_SCOPE)):
                    open_.close(k)
                continue
            if name in _P_CLOSERS or name in _IMPLIED:
                closes, stops = _IMPLIED.get(name, (frozenset({"p"}), frozenset("article section div td th li body main".split())))
                if (k := open_.innermost(closes)) and k > open_.innermost(stops):
                    open_.close(k)
            here = stack[-1]
            if name in ("br", "hr") and not dropped[here]:
                self.runs.append((here, None))
            tag.append(name)
            parent.append(here)
            self.linked.append(name == "a" or self.linked[here])
            inside = name != "header" or open_.innermost(("article", "main")) > 0
            lasting = name in ("html", "body", "article", "main")
            gone = dropped[here] or name in DROPPED or not inside or (not lasting and bool(attrs) and _HIDDEN.search(attrs) is not None)
            dropped.append(gone)
            self.mark.append(0 if gone else _furniture(attrs) or int(name in WRAPPERS))
            node = len(tag) - 1
            if name in RAW:
                end = _END_RAW[name].search(source, at)
                if end is None:
                    break
                close = source.find(">", end.end())
                at = n if close < 0 else close + 1
            elif name not in VOID and not attrs.rstrip().endswith("/"):
                open_.push(node, name)
        if any(self.mark):
            self._drop_marked()

    def _drop_marked(self) -> None:
        """Drops marked nodes, but for those that hold the article or most of the page's text.

        Text of links doesn't count. Main and article elements without a mark of their own count as
        the article (all of them where each has a mark), articles if they have half of the text of
        the longest, and those inside a STRICT mark if they have more text than lies outside of marks.
        """
        tag, parent, mark, dropped = self.tag, self.parent, self.mark, self.dropped
        n = len(tag)
        chars = [0] * n
        for node, s in self.runs:
            if s and not self.linked[node]:
                chars[node] += len("".join(s.split()))
        left, clear, strict = 0, [True] * n, [False] * n
        for i in range(1, n):
            strict[i] = strict[parent[i]] or mark[i] == 2
            clear[i] = clear[parent[i]] and (not mark[i] or tag[i] in ("html", "body", "article", "main"))
            left += clear[i] * chars[i]
        left += chars[0]
        for i in range(n - 1, 0, -1):
            chars[parent[i]] += chars[i]
        content = [i for i in range(n) if tag[i] in ("article", "main") and chars[i] > (left if strict[i] else 0) and not dropped[i]]
        content = [i for i in content if not mark[i]] or content
        longest = max((chars[i] for i in content if tag[i] == "article"), default=0)
        holds = [False] * n
        for i in content:
            if tag[i] == "main" or 2 * chars[i] >= longest:
                while i and not holds[i]:
                    holds[i] = True
                    i = parent[i]
        for i in range(1, n):
            if dropped[parent[i]]:
                dropped[i] = True
            elif mark[i] and tag[i] not in ("html", "body", "article", "main") and not holds[i]:
                most = 2 * chars[i] > chars[0] and (mark[i] < 2 or 10 * left < chars[0])
                dropped[i] = not most
        self.runs = [r for r in self.runs if not dropped[r[0]]]


def _densities(page: Page) -> tuple[list[float], list[float], list[int], list[int], list[int]]:
    """Composite text density, density sum, characters, link characters and links of each node."""
    n = len(page.tag)
    chars, link, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    for node, s in page.runs:
        if s:
            k = len("".join(s.split()))
            chars[node] += k
            if page.linked[node]:
                link[node] += k
    for i in range(n - 1, 0, -1):
        if page.dropped[i]:
            continue
        p = page.parent[i]
        chars[p] += chars[i]
        link[p] += link[i]
        tags[p] += tags[i] + 1
        link_tags[p] += link_tags[i] + (page.tag[i] == "a")
    ratio = link[0] / chars[0] if chars[0] else 0.0
    density, total = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        if chars[i] and not page.dropped[i]:
            c, lc, t, lt = chars[i], max(1, link[i]), max(1, tags[i]), max(1, link_tags[i])
            base = math.log(c / max(1, c - link[i]) * link[i] + ratio * c + math.e)
            inner = c / lc * t / lt
            density[i] = c / t * (math.log(inner) / math.log(base) if base > 1 and inner > 0 else math.log(max(inner, 1.0)))
        if i:
            total[page.parent[i]] += density[i]
    return density, total, chars, link, link_tags


def main_text(source: str | None) -> str:
    """The article's text: blocks in page order joined by one space, white space made single."""
    if not source:
        return ""
    page = Page(source)
    n = len(page.tag)
    density, total, chars, link, links = _densities(page)
    if not chars[0]:
        return ""
    best = max(range(n), key=lambda i: (total[i], -i))
    path = [best]
    while path[-1]:
        path.append(page.parent[path[-1]])
    block, own = [0] * n, [0] * n
    for i in range(1, n):
        block[i] = i if page.tag[i] in BLOCKS else block[page.parent[i]]
    for node, s in page.runs:
        if s and not page.linked[node]:
            own[block[node]] += len("".join(s.split()))
    # The least density on the way from the best subtree up to the body is what other nodes must
    # reach; an article or main element on that way is content as a whole, else a node that holds
    # as much text between its blocks as the best subtree in all.
    limit = min(density[i] for i in path)
    top = next((i for i in reversed(path) if page.tag[i] in ("article", "main") and 2 * chars[i] >= chars[best]), None)
    loose = top is None
    if loose:
        top = next((i for i in reversed(path) if own[i] >= chars[best]), best)
    # Of an article nothing goes for its links but bars where no element says that it is one.
    bars = PAGE_BARS if page.tag[top] in LAYOUT else BARS
    on_path, near, keep, sure = set(path), set(path), [False] * n, [not loose] * n
    for i in range(n):
        if page.dropped[i]:
            continue
        p = page.parent[i]
        if i == top or (i and keep[p]):
            sure[i] = (i > 0 and sure[p]) or page.tag[i] in ("article", "main")
            keep[i] = i == top or sure[i] or page.tag[i] not in bars or links[i] < BAR_LINKS
            keep[i] = keep[i] or (10 * link[i] <= 9 * chars[i] if page.tag[i] in LISTS else 2 * link[i] <= chars[i])
        elif loose and i not in on_path and p in near:
            keep[i] = density[i] >= limit and 3 * link[i] <= chars[i]
            if not keep[i] and page.tag[i] not in BLOCKS:
                near.add(i)
    used = [keep[node] for node, _ in page.runs]
    if loose:
        _keep_between(page, block, on_path, used)
    out: list[str] = []
    last, buffer = -1, []
    for (node, s), u in zip(page.runs, used, strict=True):
        if not u:
            continue
        if block[node] != last:
            out.append("".join(buffer))
            buffer, last = [], block[node]
        buffer.append(" " if s is None else s)
    out.append("".join(buffer))
    return " ".join(w for part in out for w in part.split())


def _keep_between(page: Page, block: list[int], on_path: set[int], used: list[bool]) -> None:
    """Marks as used what the nodes on the way to the body hold between their blocks, but for stretches mostly of links."""
    runs, lo = page.runs, 0
    while lo < len(runs):
        hi, holder, chars, link = lo, block[runs[lo][0]], 0, 0
        while hi < len(runs) and block[runs[hi][0]] == holder:
            node, s = runs[hi]
            k = len("".join(s.split())) if s else 0
            chars += k
            link += k * page.linked[node]
            hi += 1
        if holder in on_path and 2 * link <= chars:
            used[lo:hi] = [True] * (hi - lo)
        lo = hi


def extract_main_text(df: DataFrame, html_col: str = "html", text_col: str = "text", keep_cols: list[str] | None = None) -> DataFrame:
    """Adds text_col: each page's main text, from its whole source.

    The page becomes a DOM (unclosed and misnested tags are allowed), furniture by element or by
    class, id and role goes (by these, and forms, only what doesn't hold the article or most of the
    text), and for every node the link-adjusted number of characters a tag is
    computed. The subtree whose children's densities sum highest is the article, with neighbours
    as dense as the least dense node between it and the body and the text that lies directly in
    the nodes up to the body. Where one of those holds as much text of its own, it is the article.
    Inside of it, links drop nothing but bars of three or more, and no part of an article or main
    element; lists and tables of nothing but links count as bars only where the article is the body
    or a table itself.

    Keeps keep_cols (default: all columns); a column called text_col is replaced. A null or
    empty page, or one without text, gives an empty string. Repeated rows are extracted each; an
    empty table gives an empty result.
    """
    keep = [c for c in (df.columns if keep_cols is None else keep_cols) if c != text_col]
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(text_col, T.StringType())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(it, 500):
            texts = pa.array([main_text(x) for x in b.column(len(keep)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(keep))] + [texts], schema.names)

    return map_arrow(df.select(*keep, F.col(html_col).alias("_page_source")), run, schema)
