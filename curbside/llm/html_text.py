"""Main text of web pages by a graphical model over the DOM tree.

Every element is a variable (main text, surroundings, or a container of both): all block elements, and inline ones whose
attributes name something. A heading such as "3 comments" begins an element of its own that lasts until the next heading
of its rank. Node potentials come from the tag, the words of class and id, the length, links and punctuation of the text;
edge potentials tie an element to its parent. The tree has no loops, so one pass of sum-product messages upwards and one
downwards give exact marginals. The potentials are counted in labelled pages (``labelled_pages``).

Reading takes time in proportion to the page, however broken its markup is.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbside.llm.common import with_long_id
from curbside.llm.labelled_pages import labelled_pages

# Element names of HTML.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var img br wbr".split())
_DROPPED = set("script style template noscript title textarea select button iframe object svg math canvas audio video head".split())
_IN_HEAD = set("base basefont bgsound link meta noframes noscript script style template title".split())
_RAW = set("script style template noscript title textarea iframe svg math".split())
_CLOSES_P = set("address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li".split())
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}, "p": {"td", "th", "table", "li", "div", "article", "section", "body"}}
_GROUPS = {"article": "main", "main": "main", "nav": "nav", "menu": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "label": "form", "fieldset": "form", "legend": "form", "input": "form", "body": "page", "html": "page", "section": "box", "div": "box"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# Words in class, id and role that name surroundings and main text.
_AROUND = set("ad ads adv advert advertisement adverts adsense aside banner breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright disqus dialog footer foot form gdpr header hidden legal login masthead menu menubar meta modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted recommend recommended related replies reply respond search share sharing side sidebar signup skip social sponsor sponsored subscribe tags toolbar toc top topbar widget widgets contentinfo complementary alert discussion feedback responses rail".split())
_INSIDE = set("article body content entry main post story text page paragraph prose".split())
# Words of headings above reader comments, adverts and the like, and words that may stand beside them.
_AROUND_TITLES = set("comment comments reply replies responses discussion related share newsletter subscribe advertisement sponsored recommended cookies".split())
_BESIDE_TITLES = set("a all and article articles add by for from in join latest leave more most on or our page popular post posts read reader readers recent show stories story the this to top topics us view write you your".split())
_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_QUOTE_OR_END = re.compile(r">|=\s*[\"']")
_NAME = re.compile(r"""(?:^|\s)(class|id|role|style|hidden|aria-hidden|y)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_KEYWORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HEADING_TAG = re.compile(r"</?h[1-6](?=[\s/>])", re.I)


class _TagEnds:
    """Where tags end: at the first ">" outside of quoted values or, if such a value is never closed, at the first one at all.

    What is found from an opening quote on is remembered, so all tags of a page take one reading of it.
    """

    def __init__(self, page: str):
        self._page, self._after_quote = page, {}
        self._from, self._next = -1, -1  # the next quoted value or ">" after a position
        self._bare_from, self._bare = -1, -1  # the next ">" after a position

    def find(self, at: int) -> int:
        """Position of the ">" that ends a tag whose name ends at ``at``; -1 if there is none."""
        page, trail, start = self._page, [], at
        while True:
            if not trail and self._from <= at <= self._next:
                stop = self._next
            else:
                found = _QUOTE_OR_END.search(page, at)
                stop = found.end() - 1 if found else len(page)
                if not trail:
                    self._from, self._next = at, stop
            if stop >= len(page):
                end = -1
                break
            if page[stop] == ">":
                end = stop
                break
            if stop in self._after_quote:
                end = self._after_quote[stop]
                break
            trail.append(stop)
            close = page.find(page[stop], stop + 1)
            if close < 0:
                end = -1
                break
            at = close + 1
        for quote in trail:
            self._after_quote[quote] = end
        if end >= 0:
            return end
        if not (self._bare_from <= start and (start <= self._bare or self._bare < 0 <= self._bare_from)):
            self._bare_from, self._bare = start, page.find(">", start)
        return self._bare


def _names_surroundings(title: str) -> bool:
    words = [w for w in re.findall(r"[a-z]+", html.unescape(re.sub(r"<[^>]*>", " ", title)).lower())]
    return bool(words) and any(w in _AROUND_TITLES for w in words) and all(w in _AROUND_TITLES or w in _BESIDE_TITLES for w in words)


class Tree:
    """Elements in page order; ``parent[k] < k``. ``blocks`` are lists of (element, raw text) in page order; ``gone`` are
    elements whose text is never shown."""

    def __init__(self, page: str | None):
        self.parent, self.tag, self.kind, self.mark, self.gone = [-1], ["html"], ["none"], [""], [False]
        self.chars, self.linked, self.stops = [0], [0], [0]
        self.blocks: list[list[tuple[int, str]]] = []
        self._stack: list[tuple[str, int]] = [("html", 0)]  # name, the element that its text belongs to
        self._depths: dict[str, list[int]] = defaultdict(list)  # where each name is on the stack
        self._block_depths, self._title_ranks = [0], []
        self._run: list[tuple[int, str]] = []
        self._links = 0
        self._build(page or "")

    def _build(self, page: str) -> None:
        at, size, ends, next_heading = 0, len(page), _TagEnds(page), -1
        while at < size:
            lt = page.find("<", at)
            if lt < 0:
                self._text(page[at:])
                break
            self._text(page[at:lt])
            if not (tag := _TAG.match(page, lt)):
                following = page[lt + 1 : lt + 2]
                if page.startswith("<!--", lt):
                    end = page.find("-->", lt + 2)
                    at = end + 3 if end >= 0 else size
                elif page.startswith("<![CDATA[", lt):
                    end = page.find("]]>", lt)
                    self._text(html.escape(page[lt + 9 : end if end >= 0 else size]))
                    at = end + 3 if end >= 0 else size
                elif following and following in "!?/":
                    end = page.find(">", lt)
                    at = end + 1 if end >= 0 else size
                else:
                    self._text("<")
                    at = lt + 1
                continue
            end = ends.find(tag.end())
            if end < 0:  # the page ends within a tag
                break
            name, rest, at = tag[1].lower(), page[tag.end() : end], end + 1
            if page[lt + 1] == "/":
                self._end(name)
            elif name in _RAW and not rest.rstrip().endswith("/"):
                if name not in _IN_HEAD:
                    self._leave_head()
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
                end = page.find(">", close.end()) if close else -1
                at = end + 1 if end >= 0 else size
                if name not in ("script", "style", "template"):
                    self._run.append((self._stack[-1][1], " "))
            else:
                if name in _HEADINGS:
                    if next_heading < at:  # a title reaches up to the next heading's tag, so that titles never overlap
                        found = _HEADING_TAG.search(page, at)
                        next_heading = found.start() if found else size + 1
                    self._start(name, rest, page[at:next_heading] if next_heading <= size else "")
                else:
                    self._start(name, rest, "")
        self._flush()
        for k in range(len(self.parent) - 1, 0, -1):  # sums over everything inside
            for sums in (self.chars, self.linked, self.stops):
                sums[self.parent[k]] += sums[k]

    def _push(self, name: str, element: int, block: bool) -> None:
        self._depths[name].append(len(self._stack))
        if block:
            self._block_depths.append(len(self._stack))
        self._stack.append((name, element))

    def _pop_to(self, depth: int) -> None:
        while len(self._stack) > depth:
            name, _ = self._stack.pop()
            self._depths[name].pop()
            if name == "#title":
                self._title_ranks.pop()
        while self._block_depths[-1] >= depth:
            self._block_depths.pop()

    def _flush(self) -> None:
        """The end of a block. Bare text of the page, an element of its own, ends with it."""
        if self._run:
            if not all(part.isspace() for _, part in self._run):
                self.blocks.append(self._run)
            self._run = []
        if bare := self._depths["#bare"]:
            self._pop_to(bare[-1])

    def _leave_head(self) -> None:
        """An open head ends where something comes that it may not hold, be </head> written or not."""
        if self._stack[-1][0] == "head":
            self._flush()
            self._pop_to(len(self._stack) - 1)

    def _bare(self) -> None:
        if self.tag[self._stack[-1][1]] in ("html", "body"):
            self._push("#bare", self._element("p", "none", "", False), True)

    def _text(self, part: str) -> None:
        if not part:
            return
        if part.isspace():
            self._run.append((self._stack[-1][1], part))
            return
        self._leave_head()
        self._bare()
        owner, n = self._stack[-1][1], len(part)
        self._run.append((owner, part))
        self.chars[owner] += n
        self.linked[owner] += n if self._links else 0
        self.stops[owner] += part.count(",") + part.count(". ") + part.rstrip().endswith((".", "!", "?"))

    def _close(self, names: set[str], fence: set[str]) -> None:
        """Ends the innermost of ``names``, unless one of ``fence`` lies within it."""
        at, most = (max((d[-1] for n in some if (d := self._depths.get(n))), default=0) for some in (names, fence))
        if at > most:
            self._flush()
            self._pop_to(at)

    def _end(self, name: str) -> None:
        if name == "a":
            self._links = max(0, self._links - 1)
        if name in _INLINE:
            depths = self._depths.get(name)
            if depths and depths[-1] > self._block_depths[-1]:
                self._pop_to(depths[-1])
        else:
            self._close({name}, {"td", "table"} - {name})

    def _start(self, name: str, rest: str, title: str) -> None:
        if name not in _IN_HEAD:
            self._leave_head()
        if name in _INLINE:
            if name == "br":
                self._run.append((self._stack[-1][1], "\n"))
            elif name not in _VOID and not rest.endswith("/"):
                self._links += name == "a"
                kind, mark, hidden = self._attributes(rest)
                if kind != "none" or mark or hidden:
                    self._bare()
                    self._push(name, self._element(name, kind, mark, hidden), False)
                else:
                    self._push(name, self._stack[-1][1], False)
            return
        if name in _CLOSES_P:
            self._close({"p"}, _SCOPE["p"])
        if name in _SIBLINGS:
            self._close(_SIBLINGS[name], _SCOPE[name])
        self._flush()
        if name in _VOID or self._stack[-1][0] == "head" and name != "noframes":  # the rest of a head holds nothing
            return
        self._links = 0
        if name in _HEADINGS:
            rank = int(name[1])
            if self._title_ranks and self._depths["#title"][-1] == self._block_depths[-1] and rank <= self._title_ranks[-1]:
                self._pop_to(self._depths["#title"][-1])
            if _names_surroundings(title):
                self._push("#title", self._element("section", "around", "", False), True)
                self._title_ranks.append(rank)
        self._push(name, self._element(name, *self._attributes(rest)), True)

    @staticmethod
    def _attributes(rest: str) -> tuple[str, str, bool]:
        """What the words of the attributes name, the mark of a labelled page, and whether the element is hidden."""
        words, mark, hidden = [], "", False
        for key, value in _NAME.findall(rest) if rest else []:
            key, value = key.lower(), value.strip("\"'")
            if key == "y":
                mark = value
            elif key == "hidden" or key == "style" and _HIDING.search(value):
                hidden = True
            elif key == "aria-hidden":
                words += ["hidden"] if value.lower() == "true" else []
            elif key != "style":
                words += [w.lower() for w in _KEYWORD.findall(value)]
        around, inside = any(w in _AROUND for w in words), any(w in _INSIDE for w in words)
        # "comment-body" and the like: a word for surroundings outweighs one for main text
        return "around" if around else "inside" if inside else "none", mark, hidden

    def _element(self, name: str, kind: str, mark: str, hidden: bool) -> int:
        above = self._stack[-1][1]
        self.parent.append(above)
        self.tag.append(name)
        self.kind.append(kind)
        self.mark.append(mark)
        self.gone.append(hidden or name in _DROPPED or self.gone[above])
        for sums in (self.chars, self.linked, self.stops):
            sums.append(0)
        return len(self.parent) - 1

    def features(self, k: int) -> tuple:
        n = self.chars[k]
        length = 0 if n == 0 else 1 if n < 30 else 2 if n < 120 else 3 if n < 400 else 4
        share = self.linked[k] / n if n else 0
        group = "inline" if self.tag[k] in _INLINE else _GROUPS.get(self.tag[k], "text")
        return ("tag", group), ("kind", self.kind[k]), ("links", 0 if share < 0.2 else 1 if share < 0.6 else 2), ("length", length, group), ("stops", min(self.stops[k], 3), group)


#: States of an element: surroundings, main text, or a container that holds both.
AROUND, MAIN, MIXED = STATES = (0, 1, 2)


#: Length and punctuation of a text say much the same and far less than a name does; chosen on the labelled pages.
WEIGHTS = {"length": 0.25, "stops": 0.25, "kind": 2.5, "tag": 2.0}


def page_labels(tree: Tree) -> list[int]:
    """States of a labelled page: marks are inherited, and what holds marked text without being so is mixed."""
    size = len(tree.parent)
    holds = [m == "1" for m in tree.mark]
    for k in range(size - 1, 0, -1):
        holds[tree.parent[k]] |= holds[k]
    labels = [MIXED] * size
    for k in range(1, size):
        above = labels[tree.parent[k]]
        labels[k] = int(tree.mark[k]) if tree.mark[k] else above if above != MIXED else MIXED if holds[k] else AROUND
    return labels


def log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


class Model:
    """Log-potentials of elements and of their ties to parents, counted in labelled pages."""

    def __init__(self, pages: list[str], smooth: float = 0.2, smooth_edge: float = 0.2):
        seen: dict[tuple, list[float]] = defaultdict(lambda: [smooth] * 3)
        ties: dict[str, list[list[float]]] = defaultdict(lambda: [[smooth_edge] * 3 for _ in STATES])
        for page in pages:
            tree = Tree(page)
            labels = page_labels(tree)
            for k in range(1, len(tree.parent)):
                ties[self.tie(tree, k)][labels[tree.parent[k]]][labels[k]] += 1
                for feature in tree.features(k):
                    seen[feature][labels[k]] += 1
        totals: dict[str, list[float]] = defaultdict(lambda: [0.0] * 3)
        for feature, counts in seen.items():
            for y in STATES:
                totals[feature[0]][y] += counts[y]
        self.node = {f: [math.log(c[y] / totals[f[0]][y]) for y in STATES] for f, c in seen.items()}
        self.edge = {t: [[math.log(row[b] / sum(row)) for b in STATES] for row in m] for t, m in ties.items()}

    @staticmethod
    def tie(tree: Tree, k: int) -> str:
        return "inline" if tree.tag[k] in _INLINE else "text" if tree.tag[k] not in _GROUPS else "box"

    def marginals(self, tree: Tree) -> list[float]:
        """Probability of each element to be main text, by messages up and down the tree."""
        size = len(tree.parent)
        up = [[0.0] * 3 for _ in range(size)]  # own potential and all messages from below
        up[0] = [-9.0, -9.0, 0.0]  # the root holds both
        edges = [self.edge[self.tie(tree, k)] for k in range(size)]
        for k in range(1, size):
            for feature in tree.features(k):
                if potential := self.node.get(feature):
                    weight = 0.5 if feature == ("tag", "text") else WEIGHTS.get(feature[0], 1.0)
                    for y in STATES:
                        up[k][y] += weight * potential[y]
        message = [[0.0] * 3 for _ in range(size)]
        for k in range(size - 1, 0, -1):
            message[k] = [log_sum([edges[k][a][b] + up[k][b] for b in STATES]) for a in STATES]
            above = up[tree.parent[k]]
            for a in STATES:
                above[a] += message[k][a]
        belief = [up[0]] + [[0.0] * 3] * (size - 1)
        for k in range(1, size):
            rest = [x - m for x, m in zip(belief[tree.parent[k]], message[k], strict=True)]
            found = [up[k][b] + log_sum([rest[a] + edges[k][a][b] for a in STATES]) for b in STATES]
            whole = log_sum(found)
            belief[k] = [x - whole for x in found]
        return [math.exp(b[MAIN] - log_sum(b)) for b in belief]


@lru_cache(maxsize=1)
def model() -> Model:
    """Trained once in each worker, from the same pages."""
    return Model(labelled_pages())


def main_text(page: str | None) -> str:
    """Blocks of main text, one to a line; white space within a block is one space."""
    tree = Tree(page)
    shown = [p >= 0.5 and not gone for p, gone in zip(model().marginals(tree), tree.gone, strict=True)]
    lines = []
    for k, tag in enumerate(tree.tag):
        if tag in _INLINE:  # part of a block that is left out
            shown[k] = shown[k] and shown[tree.parent[k]]
    for run in tree.blocks:
        whole = "".join(part for k, part in run if shown[k])
        if whole and (line := " ".join(html.unescape(whole).split())):
            lines.append(line)
    return "\n".join(lines)


def extracted(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html, ...): page_id, url, text, n_chars (code points).

    Null and empty pages have an empty text, as have pages without main text. Pages are read whole, broken markup
    included. Repeated rows appear again, an empty table gives no rows, other columns are ignored.
    """

    def extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [main_text(p) for p in frame["html"]]
            yield pd.DataFrame({"page_id": frame["page_id"], "url": frame["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    texts = pages.select(F.col("page_id").cast("string"), F.col("url").cast("string"), F.col("html").cast("string"))
    return with_long_id(texts.mapInPandas(extract, "page_id string, url string, text string, n_chars long"), "page_id")
