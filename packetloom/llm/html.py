"""Main text of web pages by composite text density (operator 3).

A page becomes a tree of nodes. Each node's density is its characters per tag, lowered by the share of its characters
and tags that are links; marks of mere formatting inside a text count as text. A node's density sum adds up its
children's densities; the node with the largest sum is the article, and the least density on the path from body to it
is the threshold. Elsewhere, subtrees of at least that density add the node of their largest sum.

Menus, adverts and the like, told by element, role and being hidden, are cut out first and take no part in any count. So
are forms and what class and id names mark, unless they hold an article or main element, or most of the characters
outside links (of the page, or of its only article): there the density sums decide. A name that has a furniture word
among others, as share-price does, only cuts what is mostly links.
"""

from __future__ import annotations

import re
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import text as tx

# Names of the HTML vocabulary and words that mark page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
FURNITURE = frozenset("head nav footer aside script style noscript template iframe svg math button select textarea object canvas dialog menu title audio video datalist".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo promos promotion banner cookie cookies consent gdpr notice notices "
    "alert popup modal overlay newsletter subscribe subscription signup login nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager sidebar "
    "sidebars aside widget widgets footer masthead topbar toolbar comment comments commentlist disqus reply replies respond discussion related recommended "
    "recommendations trending share sharing social".split()
)
#: What may stand beside these words in a name of furniture.
BESIDE = frozenset(
    "a all area articles bar block bottom box btn button buttons center column container content count extra fixed form global google group header heading holder home horizontal icon icons inline "
    "inner item items layer left line link links list main more new news outer page panel post posts primary rail region right row secondary section site slot small span sticky stories story strip "
    "sub super tab text thread title toggle top unit vertical view wrap wrapper zone".split()
)
#: Elements that only format the text they stand in.
FORMATTING = frozenset("abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
KEPT = frozenset("html body main article".split())
#: An open element of the first kind ends where one of the second begins, unless one of the third stands between.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
_SCOPE = frozenset("html body table td th button object".split())

#: A quote means something only where it begins a value.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^=>]|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)>""")
#: A whole attribute, so that nothing inside a value or a longer name is taken for one.
_ATTRIBUTE = re.compile(r"""([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>][^\s>]*+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Page:
    """The nodes of a page in page order: element, parent, own pieces of text, and whether it is furniture."""

    def __init__(self, html: str):
        self.tags, self.parents, self.cut = ["#root"], [-1], [False]
        #: What marks a node as furniture, if density is not to overrule it: words of its names, or "<form>".
        self.marks: dict[int, set[str]] = {}
        #: Nodes that a name marks only if they are mostly links.
        self.hints: set[int] = set()
        #: (node, text) or (node, None) where a block begins or ends, in page order.
        self.pieces: list[tuple[int, str | None]] = []
        self._open = [0]
        self._places: dict[str, list[int]] = {}  # of open elements in _open, by name
        self._read(html)

    def _read(self, html: str) -> None:
        at, n = 0, len(html)
        while at < n:
            start = html.find("<", at)
            if start < 0:
                self._text(html[at:])
                return
            follows = html[start + 1 : start + 2]
            if not (follows.isascii() and (follows.isalpha() or follows in ("/", "!", "?")) and follows):
                self._text(html[at : start + 1])
                at = start + 1
                continue
            if start > at:
                self._text(html[at:start])
            if html.startswith("<!--", start):
                end = html.find("-->", start + 4)
                at = n if end < 0 else end + 3
                continue
            m = _TAG.match(html, start) if follows not in ("!", "?") else None
            if m is None:
                end = html.find(">", start)
                if end < 0:
                    return
                at = end + 1
                continue
            at = m.end()
            name = m[2].lower()
            if m[1]:
                self._end(name)
                continue
            self._start(name, m[3])
            if name in RAW:
                close = re.compile(rf"</{name}\b[^>]*+>?", re.IGNORECASE).search(html, at)
                self._end(name)
                at = close.end() if close else n

    def _text(self, text: str) -> None:
        self.pieces.append((self._open[-1], unescape(text) if "&" in text else text))

    def _start(self, name: str, attributes: str) -> None:
        if name in BLOCKS:
            self._imply(frozenset(["p"]), _SCOPE)
        if name in IMPLIED:
            self._imply(*IMPLIED[name])
        node = len(self.tags)
        self.tags.append(name)
        self.parents.append(self._open[-1])
        self.cut.append(self.cut[self._open[-1]] or self._furniture(name, attributes))
        if name in BLOCKS or name == "br":
            self.pieces.append((node, None))
        if name not in VOID and not attributes.endswith("/") or name in BLOCKS - VOID:
            self._places.setdefault(name, []).append(len(self._open))
            self._open.append(node)

    def _furniture(self, name: str, attributes: str) -> bool:
        """Whether the element is furniture whatever it holds; what else marks it is kept in marks."""
        if name in FURNITURE or (name == "header" and self.tags[self._open[-1]] not in ("article", "section", "main")):
            return True
        marks, seen = {"<form>"} if name == "form" else set(), set()
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in seen:  # the first of a name holds
                continue
            seen.add(key)
            if key in ("class", "id"):
                for whole in value.split():
                    words = {w.lower() for w in _WORD.findall(whole)}
                    if found := words & WORDS:
                        if words <= WORDS | BESIDE:
                            marks |= found
                        else:
                            self.hints.add(len(self.tags) - 1)
            elif name in KEPT:
                continue
            elif key == "role":
                if value.lower() == "form":
                    marks.add("<form>")
                elif value.lower() in ROLES:
                    return True
            elif key == "style":
                if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
                    return True
            elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
                return True
        if marks:
            self.marks[len(self.tags) - 1] = marks
        return False

    def _imply(self, ends: frozenset[str], stops: frozenset[str]) -> None:
        """Closes the open elements of `ends` that lie above the uppermost of `stops`: all of table rows' and lists' kinds, else one."""
        while (k := self._uppermost(ends)) and k >= self._uppermost(stops):
            self._close(k)
            if "tr" not in ends and "dd" not in ends:
                return

    def _uppermost(self, names: frozenset[str]) -> int:
        """The highest place of an open element of these names; 0 if there is none."""
        return max((self._places[name][-1] for name in names if self._places.get(name)), default=0)

    def _end(self, name: str) -> None:
        if places := self._places.get(name):
            self._close(places[-1])

    def _close(self, k: int) -> None:
        for node in self._open[k:]:
            self._places[self.tags[node]].pop()
            if self.tags[node] in BLOCKS:
                self.pieces.append((node, None))
        del self._open[k:]

    def _cut_marked(self, held: list[int]) -> None:
        """Cuts marked nodes out, given each node's own characters outside links.

        Not cut are nodes that hold a main or article element (one that is marked itself, as comments are, counts only
        where there is no other), nodes with most of the page's characters, and nodes by a mark whose nodes have most of
        them together; a run of text without blocks outvotes nothing. Where a page has one article, or else one main element, that is the page in this sense: what is
        marked apart from it is cut however long.
        """
        n = len(self.tags)
        articles, mains = ([i for i in range(n) if self.tags[i] == t and not self.cut[i]] for t in ("article", "main"))
        sound = [i for i in articles if i not in self.marks]
        holders = {*sound, *mains} or set(articles)
        holds = [i in holders for i in range(n)]
        for i in range(n - 1, 0, -1):
            if not self.cut[i]:
                held[self.parents[i]] += held[i]
                holds[self.parents[i]] |= holds[i]
        page = next((x[0] for x in (sound, mains) if len(x) == 1 and held[x[0]]), 0)
        blocks = [False] * n
        for i in range(n - 1, 0, -1):
            blocks[self.parents[i]] |= self.tags[i] in BLOCKS
            blocks[self.parents[i]] |= blocks[i]
        within = [i == page for i in range(n)]
        for i in range(1, n):
            within[i] |= within[self.parents[i]]
        found = {i: m for i, m in self.marks.items() if self.tags[i] not in KEPT and not holds[i] and not (within[i] and blocks[i] and 2 * held[i] > held[page])}
        while True:
            cut, sizes = self.cut[:], {}
            for i in range(1, n):
                cut[i] |= cut[self.parents[i]]
                if i in found and not cut[i]:
                    cut[i] = True
                    for mark in found[i] if within[i] and blocks[i] else ():
                        sizes[mark] = sizes.get(mark, 0) + held[i]
            largest = max(sizes, key=lambda mark: (sizes[mark], mark), default="")
            if 2 * sizes.get(largest, 0) <= held[page]:
                self.cut = cut
                return
            found = {i: m - {largest} if within[i] else m for i, m in found.items() if not within[i] or m - {largest}}

    def content(self) -> set[int]:
        """The nodes at the top of what is the article."""
        n = len(self.tags)
        chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        in_link = [False] * n
        for i in range(1, n):
            link = self.tags[i] == "a"
            in_link[i] = in_link[self.parents[i]] or link
            link_tags[i] = int(link)
        for node, text in self.pieces:
            if text and not self.cut[node]:
                size = len(text) - text.count(" ") - text.count("\n")
                chars[node] += size
                if in_link[node]:
                    link_chars[node] += size
        if self.marks:
            self._cut_marked([c - lc for c, lc in zip(chars, link_chars, strict=True)])
        self._cut_hinted(chars, link_chars)
        up = self.parents[:]  # the next node above that does more than format
        for i in range(n - 1, 0, -1):
            if not self.cut[i]:
                p = self.parents[i]
                chars[p] += chars[i]
                tags[p] += tags[i] + (self.tags[i] not in FORMATTING)
                link_chars[p] += link_chars[i]
                link_tags[p] += link_tags[i]
        for i in range(1, n):
            if self.tags[up[i]] in FORMATTING:
                up[i] = up[up[i]]
        share = link_chars[0] / max(chars[0], 1)
        density, sums = [0.0] * n, [0.0] * n
        for i in range(n):
            c = chars[i]
            if c and not self.cut[i]:
                lc = link_chars[i]
                base = log(c / max(c - lc, 1) * lc + share * c + e)
                density[i] = c / max(tags[i], 1) * max(log(c / max(lc, 1) * max(tags[i], 1) / max(link_tags[i], 1)), 0) / base
        for i in range(1, n):
            if self.tags[i] not in FORMATTING:
                sums[up[i]] += density[i]
        best, most = list(range(n)), sums[:]
        for i in range(n - 1, 0, -1):
            p = self.parents[i]
            if not self.cut[i] and most[i] > most[p]:
                most[p], best[p] = most[i], best[i]
        top = best[0]
        threshold, path, above = density[top], top, set()
        while path > 0:
            above.add(path)
            threshold = min(threshold, density[path]) if self.tags[path] not in ("#root", "html") else threshold
            path = self.parents[path]
        marked = {top}
        seen = [True] + [False] * (n - 1)
        for i in range(1, n):
            seen[i] = seen[self.parents[i]] and (density[i] >= threshold or self.tags[i] in ("html", "body")) and not self.cut[i]
            if self.tags[i] == "article" and i in self.marks and i not in above:  # a comment or the like beside the text
                seen[i] = False
            if seen[i] and self.tags[i] not in ("html", "body") and chars[i]:
                marked.add(best[i])
        return marked

    def _cut_hinted(self, chars: list[int], link_chars: list[int]) -> None:
        """Cuts hinted nodes whose characters are mostly in links."""
        if not self.hints:
            return
        n = len(self.tags)
        all_chars, all_links = chars[:], link_chars[:]
        for i in range(n - 1, 0, -1):
            if not self.cut[i]:
                all_chars[self.parents[i]] += all_chars[i]
                all_links[self.parents[i]] += all_links[i]
        for i in range(1, n):
            self.cut[i] |= self.cut[self.parents[i]] or (i in self.hints and self.tags[i] not in KEPT and 2 * all_links[i] > all_chars[i])
            if self.cut[i]:
                chars[i] = link_chars[i] = 0

    def text(self) -> str:
        """The article's blocks, one to a line."""
        marked, n = self.content(), len(self.tags)
        inside = [False] * n
        for i in range(n):
            inside[i] = not self.cut[i] and (i in marked or (i > 0 and inside[self.parents[i]]))
        blocks, now = [], []
        for node, text in self.pieces:
            if text is not None:
                if inside[node]:
                    now.append(text)
            elif self.tags[node] == "br":
                now.append(" ")
            elif now:
                blocks.append(now)
                now = []
        blocks.append(now)
        lines = (" ".join("".join(b).split()) for b in blocks)
        return "\n".join(x for x in lines if x)


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row (id_col, url_col, text) for each row of pages: the article of the whole html.

    Character references are decoded, white space inside a block becomes one space, blocks stand in page order on a line
    each; a line break element counts as white space. A null, empty or plain text html gives what text it has. Broken
    markup is read as browsers do it, roughly: open elements end with their parents, an unfinished tag ends the page.
    Rows may repeat and ids may be null or tied; no rows give no rows; other columns are ignored. Nothing is shuffled.
    """
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(batches):
        for batch in batches:
            _, offsets = tx.buffers(batch.column(2))
            for low, high in tx.chunks(offsets):
                part = batch.slice(low, high - low)
                texts = [Page(h).text() if h else "" for h in part.column(2).to_pylist()]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["id", "url", "text"])

    schema = f"id {source.schema[0].dataType.simpleString()}, url {source.schema[1].dataType.simpleString()}, text string"
    return source.mapInArrow(run, schema).withColumnsRenamed({"id": id_col, "url": url_col})
