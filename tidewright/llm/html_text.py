"""Main text of web pages by tag-path ratios.

Every text node has a root-to-leaf path of tags; inline tags belong to their block's. Text length and punctuation are added
up per path and divided by its nodes; both ratios are smoothed over the page order, fused by product and held against a
threshold that follows their spread. Names that tell of boilerplate (class, id, role) are a prior: they are part of the path
and cut its score to a tenth, so text that outweighs the rest of its page stays whatever it is called.

Nodes of paths above the threshold are returned wherever they stand, and what stands with them: the element that holds
most of them, or the <article> elements (or else <main>) that hold half of them, and blocks beside it under their lowest
common ancestor. There, paths below the threshold lose their text if they are links alone or named as boilerplate;
headings, captions and short items stay. Elements that are menus, footers, forms or not shown by HTML's own rules have no
text here."""

from __future__ import annotations

import html
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_slices

#: Groups: an element of text that isn't shown, up to its end tag, and its start tag's rest if that ends in />; or a tag.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title|iframe)(?=[\s/>])(?=((?:[^<>\"']|\"[^\"]*\"|'[^']*')*/>)?)[^>]*>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][\w:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.S | re.I)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*([\w-]+)", re.I)
#: Fixed values of HTML: elements without end tag, and elements that begin a block.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Parts of a list or table, which stand beside other blocks as a whole.
PARTS = set("li dt dd caption tbody td tfoot th thead tr".split())
#: What an opening tag ends when it is still open, up to the element named.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Elements that aren't main text by HTML's own rules.
DROPPED = set("head nav footer aside form button select menu dialog search input fieldset svg".split())
#: Words of class, id or role that mark boilerplate where the others beside them are neutral.
MARKS = set("ad ads adsbygoogle adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promoted banner cookie cookies consent gdpr notice notices notification alert newsletter subscribe subscription signup login sidebar sidebars aside rail comment comments commentlist disqus reply replies respond discussion menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar toolbar related recommended recommendations share sharing social follow popup modal overlay widget widgets skip pagination pager tags tagcloud copyright complementary contentinfo disclaimer warning toast announcement paywall donate feedback reviews".split())
NEUTRAL = set("a all and area article articles author background bar bars bg block body bottom box button buttons card cards carousel center close col column container content count cover dark data desktop dfp div element entry extra facebook fb feed fields fixed flex float form full global google grid group head heading headline hero holder icon icons id image images img in info inline inner input item items js js2 label labels large layout left light line link links list lists main media medium message meta mini mobile module more msg network networks new news nofollow off on open outer page panel parent policy post posts primary print read reading region right root row secondary section site skin slider slot small sticky stories story style sub tab tablet tabs text this thread tile tiles title toggle top topics tracking twitter unit up us user users video videos view web wide wp wrap wrapper zone".split())
#: A mark after one of these says what an element has; an article's own head belongs to it.
NOT_IT, HEADS = {"with", "has", "no", "without", "hide"}, {"header", "masthead", "banner"}
ARTICLE = {"article", "main"}
PRIOR = 0.1
PUNCTUATION = re.compile(r"[.,;:!?…、。，！？]")


def attributes_of(attributes: str) -> dict[str, str]:
    """Attributes by name in lower case; of a name that repeats the first counts."""
    out: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(attributes):
        out.setdefault(name.lower(), next((v for v in values if v), ""))
    return out


def hidden(named: dict[str, str]) -> bool:
    """Whether an element isn't shown: any value of hidden hides, but for until-found, which search in the page opens."""
    if named.get("hidden", "until-found").strip().lower() != "until-found" or named.get("aria-hidden", "").strip().lower() == "true":
        return True
    return [x.lower() for x in DISPLAY.findall(named.get("style", ""))[-1:]] == ["none"]


def named_so(named: dict[str, str], in_article: bool) -> bool:
    """Whether class, id or role mark boilerplate: a name that is a mark and else neutral words or numbers."""
    for key in ("class", "id", "role"):
        for name in named.get(key, "").split():
            words = re.split(r"[_-]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower())
            marks = [w for before, w in zip(["", *words], words, strict=False) if w in MARKS and before not in NOT_IT and not (in_article and w in HEADS)]
            if marks and all(w in MARKS or w in NEUTRAL or not w or w.isdigit() for w in words):
                return True
    return False


#: What may be open in a scope, by the tags that end it when they open: index into an open element's places.
_ENDED_BY = {"li": 1, "dt": 2, "dd": 2, "tr": 3, "td": 4, "th": 4, "option": 5}
_BOUND = {"ul": (1,), "ol": (1,), "menu": (1,), "dl": (2,), "table": (0, 3, 4), "tr": (4,), "td": (0,), "th": (0,), "select": (5,), "button": (0,), "object": (0,), "foreignobject": (0, 1, 2, 3, 4, 5)}
#: Elements whose end tag ends whatever is open inside; the end tag of others stops at a block.
_WHOLE = BLOCK | DROPPED | {"object", "option", "foreignobject"}


class Page:
    """The text nodes of a page and its tree of elements, numbered in the order of their start tags (0: the page)."""

    def __init__(self, page: str):
        self.parent, self.tag, self.depth, self.last = [-1], [""], [0], [0]
        self.element: list[int] = []  # of each text node
        self.path: list[int] = []
        self.block: list[int] = []
        self.text: list[str] = []
        self.link: list[bool] = []
        self.marked: list[bool] = []  # of each path
        paths: dict[tuple[int, str, bool], int] = {}
        # tag, element, no text inside, in an article, in a drawing, path, in a link, open elements that start tags end
        stack: list[tuple] = [("", 0, False, False, False, self._path(paths, -1, "", False), False, (-1,) * 6)]
        open_tags: dict[str, int] = defaultdict(int)
        block = at = 0

        def close(k: int) -> None:
            for t, e, *_ in stack[k:]:
                open_tags[t] -= 1
                self.last[e] = len(self.tag) - 1
            del stack[k:]

        while True:
            m = TOKEN.search(page, at)
            end = m.start() if m else len(page)
            top = stack[-1]
            if end > at and not top[2]:
                text = page[at:end]
                if m is None:  # a page may be cut within a tag
                    text = re.sub(r"<[/!?a-zA-Z][^<>]*\Z", "", text)
                if text and (self.text or not text.isspace()):
                    self.element.append(top[1])
                    self.path.append(top[5])
                    self.block.append(block)
                    self.link.append(top[6])
                    self.text.append(html.unescape(text))
            if m is None:
                break
            drawn = top[4]
            at = m.end(2) if drawn and m[2] else m.end()  # only in a drawing does /> end such elements
            if not m[4]:
                continue
            tag, closing, attributes = m[4].lower(), bool(m[3]), m[5]
            if tag in BLOCK:
                block += 1
            if tag in VOID:
                continue
            if closing:
                if open_tags[tag]:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] == tag:
                            close(k)
                            break
                        if tag not in _WHOLE and stack[k][0] in BLOCK:
                            break
                continue
            if drawn and tag in BLOCK and not open_tags["foreignobject"]:  # a drawing left open ends here
                close(next(k for k in range(1, len(stack)) if stack[k][4]))
            place = _ENDED_BY.get(tag, 0 if tag in BLOCK else None)
            if place is not None and stack[-1][7][place] > 0:
                close(stack[-1][7][place])
            _, parent, hid, inside, drawn, path, link, places = stack[-1]
            number = len(self.tag)
            named = attributes_of(attributes) if attributes and not attributes.isspace() else {}
            if tag not in ("html", "body"):  # those are hidden until a script shows the page
                role = named.get("role", "").lower()
                hid = hid or (tag in DROPPED and role not in ARTICLE) or bool(named) and hidden(named) or (tag == "header" and not inside)
                mark = tag not in ARTICLE and role not in ARTICLE and named_so(named, inside)
                if tag in BLOCK or mark:
                    path = self._path(paths, path, tag, mark)
            self.parent.append(parent)
            self.tag.append(tag)
            self.depth.append(self.depth[parent] + 1)
            self.last.append(number)
            if attributes.rstrip().endswith("/") and tag not in BLOCK and (drawn or tag == "math" or tag in DROPPED or "-" in tag):
                continue
            here, own = list(places), len(stack)
            for k in _BOUND.get(tag, ()):
                here[k] = -1
            if tag == "p":
                here[0] = own
            elif tag in _ENDED_BY:
                here[_ENDED_BY[tag]] = own
            open_tags[tag] += 1
            stack.append((tag, number, hid, inside or tag in ARTICLE, (drawn or tag == "svg") and tag != "foreignobject", path, link or tag == "a", tuple(here)))
        close(1)
        self.last[0] = len(self.tag) - 1

    def _path(self, paths: dict, parent: int, tag: str, mark: bool) -> int:
        if (parent, tag, mark) not in paths:
            paths[parent, tag, mark] = len(paths)
            self.marked.append(mark or parent >= 0 and self.marked[parent])
        return paths[parent, tag, mark]

    def scores(self, radius: int = 2) -> np.ndarray:
        """The fused, smoothed ratio of each node's path, zero where it has no text: the mean of the path's nodes, so that a
        neighbour alone lifts no path; a tenth where it is named as boilerplate."""
        own = np.array([bool(t.strip()) for t in self.text])
        path, paths = np.array(self.path), len(self.marked)
        count = np.maximum(1, np.bincount(path, own, paths))
        length = np.bincount(path, [len(t.strip()) for t in self.text], paths) / count
        marks = np.bincount(path, [len(PUNCTUATION.findall(t)) for t in self.text], paths) / count
        kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / (radius / 2)) ** 2)
        smooth = [np.convolve(np.pad(r[path], radius, mode="edge"), kernel / kernel.sum(), "valid") for r in (length, marks)]
        fused = np.bincount(path, np.where(own, np.sqrt(smooth[0] * (1 + smooth[1])), 0), paths) / count
        return np.where(own, (fused * np.where(self.marked, PRIOR, 1))[path], 0)

    def selected(self, scores: np.ndarray) -> list[bool]:
        """Which text nodes are main text."""
        full = scores[scores > 0]
        chosen = scores >= max(full.max() * 0.3, full.mean() - full.std(), 1e-9)
        size = np.array([len(t.strip()) for t in self.text])
        weight = np.bincount(self.element, np.where(chosen, size, 0), len(self.tag)).astype(np.int64).tolist()
        for e in range(len(weight) - 1, 0, -1):  # children have larger numbers
            weight[self.parent[e]] += weight[e]
        total = weight[0]
        links = np.bincount(self.path, np.where(self.link, size, 0), len(self.marked)) >= 0.9 * np.maximum(1, np.bincount(self.path, size, len(self.marked)))
        lost = ~chosen & (np.array(self.marked) | links)[self.path]
        articles = [e for e, t in enumerate(self.tag) if t == "article" and weight[e]] or [e for e, t in enumerate(self.tag) if t == "main" and weight[e]]
        outer, end = [], -1
        for e in articles:
            if e > end:
                outer.append(e)
                end = self.last[e]
        if outer and 2 * sum(weight[e] for e in outer) >= total:
            inside = np.zeros(len(self.tag) + 1, np.int64)
            for e in outer:
                inside[e] += 1
                inside[self.last[e] + 1] -= 1
            inside = np.cumsum(inside) > 0
            return [bool(inside[e]) and not x for e, x in zip(self.element, lost.tolist(), strict=True)]
        holder = common = 0
        for e in range(1, len(self.tag)):
            if 10 * weight[e] >= 8 * total and self.depth[e] > self.depth[holder]:
                holder = e
            if weight[e] == total and self.depth[e] > self.depth[common]:
                common = e
        if self.tag[holder] in ("p", "h1", "span", "b", "i", "em", "strong", "a"):  # a lone paragraph: its parent
            holder = self.parent[holder]
        whole = [0] * len(self.tag)  # the block that an element stands in, lists and tables as one
        for e in range(1, len(self.tag)):
            whole[e] = e if self.tag[e] in BLOCK and self.tag[e] not in PARTS else whole[self.parent[e]]
        taken = []
        for ok, e, gone in zip(chosen.tolist(), self.element, lost.tolist(), strict=True):
            k = whole[e]
            beside = common <= e <= self.last[common] and (weight[k] > 0 or k > 0 and weight[self.parent[k]] > 0 and self.depth[k] > self.depth[common])
            taken.append((ok or holder <= e <= self.last[holder] or beside) and not gone)
        return taken


def main_text(page: str) -> str:
    """The content nodes of a page: blocks trimmed, their white space made one space, joined by one space in page order."""
    nodes = Page(page)
    if all(t.isspace() for t in nodes.text):
        return ""
    blocks: dict[int, list[str]] = {}
    for ok, block, text in zip(nodes.selected(nodes.scores()), nodes.block, nodes.text, strict=True):
        if ok:
            blocks.setdefault(block, []).append(text)
    return " ".join(x for x in (" ".join("".join(b).split()) for b in blocks.values()) if x)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    A null or empty page, and one without text outside boilerplate, gives the empty text and 0. Unclosed tags, stray end
    tags, cut pages and very long ones are read as they come. Rows that repeat are returned each; null ids and urls stay
    null; an empty table gives an empty result. Other columns are not read.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [main_text(x) for x in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html"))
    return rows.mapInArrow(by_slices(work, rows=128), "page_id long, url string, text string, n_chars long")
