"""Main text of HTML pages by composite text density.

A page is one row, so Spark spreads the pages and each is read by a small tree builder. For every node the density is its
characters per tag, scaled down by the share of link characters and link tags; a node's sum is that of its children's
densities. The node with the largest sum is the core of the article; nodes outside it that are at least as dense as the
least dense node on the core's path to <body> add their own densest subtrees. What is never article text (menus, forms,
adverts, comments ...) is cut out of the tree first. Forms, and elements that only a class, an id or a role marks as such,
are cut unless they wrap the article: then the density decides within them. Headings are never marked, and an element
that only its id marks, as ids are often made of headings, is no more marked if it is a section with a heading and
paragraphs of its own in which little is linked and nothing else is marked.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<(?P<start>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)(?:>|\Z)|<(?P<odd>[a-zA-Z][^\s/>]*)(?P<rest>[^>]*)(?:>|\Z)""",
    re.S,
)
_ATTR = re.compile(r"""([a-zA-Z][\w:-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
# HTML elements by what they are.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul caption".split())
_CLOSES_P = _BLOCK - frozenset("body html head td th tr tbody thead tfoot caption option optgroup legend title".split())
_SCOPE = frozenset("html body table td th caption article section div main aside nav header footer form ul ol blockquote details fieldset button".split())
_KIND = {"li": "li", "dt": "dd", "dd": "dd", "option": "option", "tr": "tr", "td": "td", "th": "td", "tbody": "tbody", "thead": "tbody", "tfoot": "tbody"}
_ENDS = {"li": ("li",), "dd": ("dd",), "option": ("option",), "td": ("td",), "tr": ("tr", "td"), "tbody": ("tbody", "tr", "td")}  # what a start tag of a kind ends
_LIST_SCOPE = frozenset("ul ol dl table select menu html body".split())
_NEVER = frozenset("head nav header footer aside script style noscript template iframe object canvas svg button select textarea dialog menu search".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SECTIONS = frozenset("article div section".split())
_MUTE = frozenset("script style noscript template iframe object canvas svg".split())
# Words in class, id or role that tell what a part of a page is for.
_SIGNS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist complementary contentinfo cookie cookies copyright disqus footer gdpr "
    "login masthead menu menubar modal nav navbar navigation newsletter pager pagination paywall popup promo promoted reply replies respond search share sharing sidebar signup skip "
    "social sponsor sponsored subscribe subscription taboola teaser toolbar tooltip".split()
)
# Such words that name sections of articles, or the blocks of page builders, as well: signs only before _PLURALS or _HOLDERS.
_TOPICS = frozenset("consent disclaimer discussion feedback legal notice notices promotion recommended related".split())
_PLURALS = frozenset("articles banner box items links news popup posts products stories topics videos".split())
_BUILT = frozenset("widget widgets".split())
# Words that may follow a sign, as in comment-list; words before it that make the name one of a layout, as in has-sidebar.
_HOLDERS = frozenset("area author bar block body bottom box button buttons column container content date form frame group header holder icon icons inner item items left link links list meta module outer panel post posts right row section slot text thread title top unit wrap wrapper zone".split())
_LAYOUT = frozenset("article content does has hide is layout main no non not show with without".split())


def _names(name: str) -> bool:
    """Whether one class, id or role, in lower case, names a part that is never article text."""
    words = [w for w in re.split(r"[^a-z]+", name) if len(w) > 1]
    tail = len(words)
    while tail and words[tail - 1] in _HOLDERS:
        tail -= 1
    if tail and words[tail - 1] in _SIGNS:
        return _LAYOUT.isdisjoint(words[: tail - 1])
    if words and words[0] in _BUILT:
        return tail == 1
    return len(words) > 1 and words[-1] in _PLURALS and words[-2] in _TOPICS and _LAYOUT.isdisjoint(words[:-2])


class _Open:
    """The open elements. Besides the stack, where each tag, each scope, and in each scope the paragraph and the list or
    table part stands is noted, so that no tag is answered by a walk up the stack."""

    def __init__(self, ended):
        self.stack: list[tuple[int, str]] = [(0, "#root")]
        self.of: dict[str, list[int]] = {}
        self.scopes, self.paragraphs, self.parts = [0], [0], [{}]
        self.ended = ended

    def push(self, node: int, tag: str) -> None:
        depth = len(self.stack)
        self.stack.append((node, tag))
        self.of.setdefault(tag, []).append(depth)
        if tag == "p":
            self.paragraphs[-1] = depth
        if tag in _KIND:
            self.parts[-1][_KIND[tag]] = depth
        if tag in _SCOPE:
            self.scopes.append(depth)
            self.paragraphs.append(0)
        if tag in _LIST_SCOPE:
            self.parts.append({})

    def pop(self, depth: int) -> None:
        """Ends all elements from this depth on."""
        while len(self.stack) > depth:
            node, tag = self.stack.pop()
            self.of[tag].pop()
            if tag in _LIST_SCOPE:
                self.parts.pop()
            if tag in _SCOPE:
                self.scopes.pop()
                self.paragraphs.pop()
            if tag in _KIND and self.parts[-1].get(_KIND[tag]) == len(self.stack):
                del self.parts[-1][_KIND[tag]]
            if tag == "p":
                self.paragraphs[-1] = 0
            self.ended(node, tag)

    def start(self, tag: str) -> None:
        """Ends what a start tag ends by itself."""
        if tag in _KIND:
            part = self.parts[-1]
            depth = min((part[k] for k in _ENDS[_KIND[tag]] if k in part), default=0)
            if depth:
                self.pop(depth)
        if tag in _CLOSES_P and self.paragraphs[-1]:
            self.pop(self.paragraphs[-1])

    def end(self, tag: str) -> None:
        """Ends the innermost element of the tag; an inline one only inside the innermost scope."""
        depths = self.of.get(tag)
        if depths and (tag in _BLOCK or depths[-1] >= self.scopes[-1]):
            self.pop(depths[-1])

    def within(self, *tags: str) -> bool:
        return any(self.of.get(t) for t in tags)


class _Page:
    """The tree: for each node its tag, parent and whether it is cut; pieces of text and block edges in page order. Marked
    are nodes whose cut is settled when the whole tree is known. The time is in proportion to the page's length."""

    def __init__(self, text: str):
        self.tag, self.parent, self.cut, self.marked, self.by_id = ["#root"], [-1], [False], [False], [False]
        self.pieces: list[tuple[int, str | None]] = []
        open_, at, length = _Open(self._ended), 0, len(text)
        while at < length:
            m = _TAG.search(text, at)
            if m is None or m.start() > at:
                self.pieces.append((open_.stack[-1][0], html.unescape(text[at : m.start() if m else length])))
            if m is None:
                break
            at = m.end()
            start = m["start"] or m["odd"]
            if start:
                start = start.lower()
                open_.start(start)
                parent = open_.stack[-1][0]
                node = self._add(start, parent, m["attrs"] or m["rest"] or "", open_)
                if start in _BLOCK:
                    self.pieces.append((parent, None))
                elif start == "br":
                    self.pieces.append((parent, " "))
                if start in _RAW:
                    end = re.compile(rf"</{re.escape(start)}(?=[\s/>])", re.I).search(text, at)
                    self.cut[node] = True
                    at = end.start() if end else length
                    open_.push(node, start)
                elif start not in _VOID and not (start in ("svg", "path") and m.group().endswith("/>")):
                    open_.push(node, start)
            elif m["end"]:
                open_.end(m["end"].lower())
        if True in self.marked:
            self._settle()

    def _ended(self, node: int, tag: str) -> None:
        if tag in _BLOCK:
            self.pieces.append((self.parent[node], None))

    def _add(self, tag: str, parent: int, attrs: str, open_: _Open) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        cut, marked = tag in _NEVER, tag == "form"
        if tag == "header" and open_.within("article", "main"):
            cut = False  # of the article, with its title
        by_id = True
        if attrs and not cut and tag not in ("html", "body", "main"):
            for name, *values in _ATTR.findall(attrs):
                name, value = name.lower(), "".join(values).lower()
                if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                    cut = True
                elif name in ("class", "id", "role") and tag not in _HEADINGS and any(map(_names, value.split())):
                    marked, by_id = True, by_id and name == "id"
        self.cut.append(cut or self.cut[parent])
        self.marked.append(marked and not self.cut[-1])
        self.by_id.append(by_id and tag in _SECTIONS)
        return len(self.tag) - 1

    def _settle(self) -> None:
        """Cuts the marked nodes, but not one that wraps the article: one that holds the page's <article> or <main>, or,
        where the page has none outside marked nodes, blocks (a form: text) with most of the characters that are not links."""
        n = len(self.tag)
        plain, blocks, holds = [0] * n, [False] * n, [False] * n
        in_link, under = [False] * n, list(self.marked)
        for i in range(1, n):
            p = self.parent[i]
            in_link[i], under[i] = self.tag[i] == "a" or in_link[p], under[i] or under[p]
        for node, text in self.pieces:
            if text is not None and not self.cut[node] and not in_link[node]:
                plain[node] += len("".join(text.split()))
        for i in range(n - 1, 0, -1):
            plain[self.parent[i]] += plain[i]
        self._spare_sections(plain, in_link)
        total = plain[next((i for i in range(n) if self.tag[i] == "body"), 0)]
        free = any(self.tag[i] in ("article", "main") and not under[i] and plain[i] for i in range(n))
        for i in range(n - 1, 0, -1):
            p, most = self.parent[i], 2 * plain[i] > total
            if self.marked[i] and (most or not free if holds[i] else most and (blocks[i] or self.tag[i] == "form") and not free):
                self.marked[i] = False
            if plain[i] and not self.marked[i]:
                blocks[p] = blocks[p] or blocks[i] or self.tag[i] in _BLOCK
                holds[p] = holds[p] or holds[i] or self.tag[i] in ("article", "main")
        for i in range(1, n):
            self.cut[i] = self.cut[i] or self.marked[i] or self.cut[self.parent[i]]

    def _spare_sections(self, plain: list[int], in_link: list[bool]) -> None:
        """No more marks sections that only an id marks, with a heading and paragraphs that are mostly no links, and without
        parts that are marked or cut themselves (as items of comments, forms or menus are)."""
        n = len(self.tag)
        headed, paragraphs, linked, odd = [False] * n, [0] * n, [0] * n, [False] * n
        for node, text in self.pieces:
            if text is not None and not self.cut[node] and in_link[node]:
                linked[node] += len("".join(text.split()))
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            if self.marked[i] and self.by_id[i] and headed[i] and not odd[i] and paragraphs[i] > 2 * linked[i]:
                self.marked[i] = False
            if self.tag[i] == "p" and not self.cut[i]:
                paragraphs[i] = plain[i]
            headed[p] = headed[p] or headed[i] or self.tag[i] in _HEADINGS and plain[i] + linked[i] > 0
            paragraphs[p], linked[p] = paragraphs[p] + paragraphs[i], linked[p] + linked[i]
            odd[p] = odd[p] or odd[i] or self.marked[i] or self.cut[i] and not self.cut[p] and self.tag[i] not in _MUTE

    def chosen(self) -> list[bool]:
        """Which nodes are of the article."""
        n = len(self.tag)
        chars, links, tags, link_tags, own = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
        in_link = [False] * n
        for i in range(1, n):
            in_link[i] = self.tag[i] == "a" or in_link[self.parent[i]]
        for node, text in self.pieces:
            if text is not None and not self.cut[node]:
                size = len("".join(text.split()))
                own[node] += size
        for i in range(n - 1, -1, -1):
            if self.cut[i]:
                continue
            chars[i] += own[i]
            links[i] += own[i] if in_link[i] else 0
            if i:
                p = self.parent[i]
                chars[p] += chars[i]
                links[p] += links[i]
                tags[p] += tags[i] + 1
                link_tags[p] += link_tags[i] + (self.tag[i] == "a")
        body = next((i for i in range(n) if self.tag[i] == "body"), 0)
        ratio = links[body] / max(1, chars[body])

        def density(c: int, lc: int, t: int, lt: int) -> float:
            if c == 0:
                return 0.0
            base = math.log(c / max(1, c - lc) * lc + ratio * c + math.e)
            return c / max(1, t) * math.log(max(math.e, c / max(1, lc) * max(1, t) / max(1, lt))) / math.log(base + 1)

        dense = [density(chars[i], links[i], tags[i], link_tags[i]) for i in range(n)]
        sums = [density(own[i], own[i] if in_link[i] else 0, 1, 0) for i in range(n)]
        for i in range(1, n):
            if not self.cut[i]:
                sums[self.parent[i]] += dense[i]
        inner = [i for i in range(n) if not self.cut[i] and chars[i]]
        take = [False] * n
        if not inner:
            return take
        core = max(inner, key=lambda i: (sums[i], -i))
        path, node = [], core
        while node > 0 and node != body:
            path.append(node)
            node = self.parent[node]
        threshold = min((dense[i] for i in [*path, body]), default=0.0)
        roots = [core] + [i for i in path if self.tag[i] in ("article", "main")][-1:]
        most = list(sums)  # the densest node of each subtree
        at = list(range(n))
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            if not self.cut[i] and most[i] > most[p]:
                most[p], at[p] = most[i], at[i]
        on_path = set(path) | {body, 0}
        for i in range(1, n):
            if self.cut[i] or self.parent[i] not in on_path or i in on_path:
                continue
            if dense[i] >= threshold and chars[i]:
                roots.append(i if self.tag[i] in _BLOCK and at[i] == i else at[i])
        for r in roots:
            take[r] = True
        for i in range(1, n):
            take[i] = (take[i] or take[self.parent[i]]) and not self.cut[i]
        return take

    def text(self) -> str:
        take, blocks, block = self.chosen(), [], []
        for node, text in [*self.pieces, (0, None)]:
            if text is None:
                line = " ".join("".join(block).split())
                if line:
                    blocks.append(line)
                block = []
            elif take[node]:
                block.append(text)
        return "\n".join(blocks)


def main_text(page: str | None) -> str:
    return _Page(page).text() if page else ""


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) for every row: the main text, one line a block, white space squeezed, references decoded.

    A null or empty page, or one without an article, has an empty text. A very long page takes time in proportion. Rows are taken one by one: repeated rows are
    repeated, null ids and URLs stay. Other columns are ignored.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(rows, "page_id long, url string, text string")
