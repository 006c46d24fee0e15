"""Main text of web pages by tag-path ratios.

A page is read once as a row of blocks: text between block-level tags, with the path of open block-level elements above it (tag
and class words) and the characters that lie in links. Character references are decoded, white space in a block is one
space. Scripts, styles, comments, form controls and hidden elements give no text; menus, side bars, page headers and footers, notices,
adverts and reader comments are known by their tags (``nav aside footer form``, a ``header`` outside the article) or by a word of
their class, id or role, and give none either. A form or an element known by a word only is no such thing if it holds the
main article, or on pages that mark none, a first heading and half of the text. Main articles are the elements ``article`` (or ``main``,
or these roles) with at least a quarter of the text of the largest one.

What remains is judged by path. All blocks of one path together give two ratios: characters a block and punctuation marks a block.
Both run over the page's blocks in order, are smoothed with a Gaussian window, and are fused as the root of their product, less the
share of link text. A path whose mean reaches ``level`` times the page's character-weighted mean is content, and its blocks are
content nodes. Where articles are marked, only their blocks are judged. The text is all blocks of these articles, or of the smallest element
that holds seven tenths of the content nodes' characters, headings and short lines too, without paths that are nothing but links.

Per row: null and empty pages, and pages without text, give an empty text. Pages are whole, however long or deep; unclosed and
misnested tags are repaired as browsers do it in the common cases. Repeated rows and null ids stay; columns other than ``page_id``,
``url`` and ``html`` are not read.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from thermalframe.llm import text as X

LEVEL = 0.5                     # share of the mean ratio that a content path reaches
SMOOTH = 2                      # blocks on either side of a smoothed one

#: Elements by what they do to a page's text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
                  "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section "
                  "summary table tbody td tfoot th thead title tr ul".split())
SILENT = frozenset("button canvas datalist head iframe label legend math noembed noframes noscript object optgroup option audio select svg "
                   "template video".split())
RAW = frozenset("script style textarea title xmp".split())
ENDS_PARAGRAPH = BLOCK - {"body", "html", "head", "title", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend"}
CLOSES = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"),
          "tbody": ("tbody", "thead"), "tfoot": ("tbody", "thead")}
HOLDS = {"li": ("ul", "ol", "menu", "dir"), "dd": ("dl",), "dt": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"),
         "tbody": ("table",), "tfoot": ("table",)}
BOILERPLATE_TAGS = frozenset("nav aside footer menu dialog search".split())
#: Class, id and role words of elements that are not main text: always, unless around it, unless around or in it.
COMMENT_WORDS = frozenset("comment comments commentlist commentform disqus respond replies reply".split())
ASIDE_WORDS = frozenset(
    "nav navbar navigation navigations menu menus submenu topnav breadcrumb breadcrumbs pagination pager toc sidebar sidebars aside "
    "complementary ad ads advert adverts advertisement advertisements advertising adsense adslot adbox sponsor sponsored sponsors promo promos "
    "promotion banner cookie cookies consent gdpr notice notices notification disclaimer newsletter subscribe subscription signup "
    "popup modal overlay share sharing social related recommended recommendations widget widgets footer foot colophon contentinfo "
    "copyright masthead login search skip".split())
HEADER_WORDS = frozenset("header topbar toolbar alert".split())
TEXT, NEVER, ASIDE, HEADER, SILENCE = range(5)         # kinds of elements

_tag = re.compile(r"""<(/?)([a-zA-Z][^\s/><]*+)((?:[^"'<>]++|"[^"<]*+"|'[^'<]*+')*+)>""")
_wide_tag = re.compile(r"""<(/?)([a-zA-Z][^\s/><]*+)((?:[^"'>]{1,4096}|"[^"]{0,4096}"|'[^']{0,4096}'){0,64}+)>""")
_attribute = re.compile(r"""([a-zA-Z-]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")
_word = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_punctuation = re.compile(r"""[.,;:!?。，、；：！？…]""")


@dataclass
class Element:
    tag: str
    path: int
    number: int
    parent: int
    kind: int


@dataclass
class Page:
    """Blocks of a page, and the elements above them."""
    texts: list[str] = field(default_factory=list)
    links: list[int] = field(default_factory=list)             # characters of link text
    paths: list[int] = field(default_factory=list)
    owners: list[int] = field(default_factory=list)
    elements: list[Element] = field(default_factory=list)
    articles: list[int] = field(default_factory=list)          # elements that are an article
    mains: list[int] = field(default_factory=list)
    headings: list[int] = field(default_factory=list)          # elements with a first heading


def _hints(attributes: str) -> tuple[set[str], bool]:
    """Words of class, id and role, and whether the element is hidden."""
    words: set[str] = set()
    hidden = False
    for m in _attribute.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name in ("class", "id", "role"):
            words.update(w.lower() for token in value.split() if not token.lower().startswith(("has-", "with-", "no-", "without-"))
                         for w in _word.findall(token))
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            hidden = True
        elif name == "style" and re.search(r"display\s*+:\s*+none|visibility\s*+:\s*+hidden", value.lower()):
            hidden = True
    return words, hidden


def read_page(text: str) -> Page:
    """Blocks and elements of a page, in one pass."""
    page = Page()
    known: dict[tuple, int] = {}
    root = Element("", 0, 0, 0, TEXT)
    page.elements.append(root)
    stack = [root]
    open_: dict[str, int] = {}
    pieces: list[str] = []
    linked: list[str] = []
    in_link = False

    def flush() -> None:
        if pieces:
            joined = " ".join("".join(pieces).split())
            if joined and stack[-1].kind != SILENCE:
                page.texts.append(joined)
                page.links.append(min(len(joined), len(" ".join("".join(linked).split()))))
                page.paths.append(stack[-1].path)
                page.owners.append(stack[-1].number)
            pieces.clear()
            linked.clear()

    def say(raw: str) -> None:
        if raw and stack[-1].kind != SILENCE:
            raw = references.unescape(raw) if "&" in raw else raw
            pieces.append(raw)
            if in_link:
                linked.append(raw)

    def push(tag: str, attributes: str) -> None:
        top = stack[-1]
        words, hidden = _hints(attributes) if attributes.strip() else (set(), False)
        if tag in ("html", "body"):
            words, hidden = set(), False
        if top.kind == SILENCE or hidden or tag in SILENT:
            kind = SILENCE
        elif tag in BOILERPLATE_TAGS or words & COMMENT_WORDS:
            kind = NEVER
        elif tag == "form" or words & ASIDE_WORDS:
            kind = NEVER if tag == "article" else ASIDE
        else:
            kind = HEADER if tag == "header" or words & HEADER_WORDS else TEXT
        key = (top.path, tag, " ".join(sorted(words)))
        own = Element(tag, known.setdefault(key, len(known) + 1), len(page.elements), top.number, kind)
        page.elements.append(own)
        stack.append(own)
        open_[tag] = open_.get(tag, 0) + 1
        if kind in (TEXT, HEADER):
            if tag == "article" or "role" in attributes and "article" in words:
                page.articles.append(own.number)
            elif tag == "main" or "role" in attributes and "main" in words:
                page.mains.append(own.number)
            elif tag == "h1":
                page.headings.append(own.number)

    def pop() -> None:
        gone = stack.pop()
        open_[gone.tag] -= 1

    at, n = 0, len(text)
    last_gt, last_comment = text.rfind(">"), text.rfind("-->")
    while at < n:
        lt = text.find("<", at)
        if lt < 0:
            say(text[at:])
            break
        say(text[at:lt])
        if text.startswith("<!--", lt):
            end = text.find("-->", lt + 4 if not text.startswith("<!-->", lt) else lt + 2) if lt < last_comment + 1 else -1
            at = n if end < 0 else end + 3
            continue
        if text.startswith(("<!", "<?"), lt):
            end = text.find(">", lt) if lt < last_gt else -1
            at = n if end < 0 else end + 1
            continue
        m = _tag.match(text, lt) or _wide_tag.match(text, lt)
        if m is None:
            if re.match(r"</?[a-zA-Z]", text[lt:lt + 3]) and lt < last_gt:
                at = text.find(">", lt) + 1                              # a tag with a broken quote
                m = re.match(r"<(/?)([a-zA-Z][^\s/><]*+)([^<>]*+)", text[lt:min(at, lt + 4096)])
            else:
                say("<")
                at = lt + 1
                continue
        else:
            at = m.end()
        closing, tag, attributes = m[1], m[2].lower(), m[3]
        if closing:
            if tag == "a":
                in_link = False
            if tag == "br" or tag == "p" and not open_.get("p"):
                flush() if tag == "p" else say(" ")
            elif (tag in BLOCK or tag in SILENT) and open_.get(tag):
                flush()
                in_link = False
                while stack[-1].tag != tag:
                    pop()
                pop()
            continue
        if tag in ("br", "wbr"):
            if tag == "br":
                say(" ")
            continue
        if tag == "hr":
            flush()
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(text, at)
            if tag == "title":
                flush()
            at = n if end is None else text.find(">", end.end()) + 1 or n
            continue
        if tag == "plaintext":
            say(text[at:])
            break
        if tag == "a":
            in_link = True
            continue
        if tag in VOID or tag not in BLOCK and tag not in SILENT:
            continue
        flush()
        if tag in ENDS_PARAGRAPH and stack[-1].tag == "p":
            pop()
        if tag in CLOSES and any(open_.get(t) for t in CLOSES[tag]):
            for back in range(1, min(len(stack), 64)):
                if stack[-back].tag in CLOSES[tag]:
                    for _ in range(back):
                        pop()
                    break
                if stack[-back].tag in HOLDS[tag]:
                    break
        if tag == "body" and stack[-1].tag == "head":
            pop()
        if tag[0] == "h" and tag[1:].isdigit() and stack[-1].tag[:1] == "h" and stack[-1].tag[1:].isdigit():
            pop()
        push(tag, attributes)
        if tag in SILENT and attributes.rstrip().endswith("/") and tag in ("svg", "math"):
            pop()
    flush()
    return page


def smooth(x: np.ndarray, radius: int = SMOOTH) -> np.ndarray:
    """Gaussian mean over the neighbours; weights outside the row do not count."""
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / max(radius / 2, 0.5)) ** 2)
    return np.convolve(x, kernel, "same")[:len(x)] / np.convolve(np.ones(len(x)), kernel, "same")[:len(x)] if len(x) > 2 * radius else \
        np.array([np.average(x, weights=np.exp(-0.5 * ((np.arange(len(x)) - i) / max(radius / 2, 0.5)) ** 2)) for i in range(len(x))])


def content_nodes(paths: np.ndarray, chars: np.ndarray, marks: np.ndarray, links: np.ndarray, level: float = LEVEL) -> np.ndarray:
    """Whether each block lies on a content path; see the module's text."""
    _, path = np.unique(paths, return_inverse=True)
    blocks = np.bincount(path)
    total = np.bincount(path, chars)
    ratio = total / blocks
    pointed = 1 + np.bincount(path, marks) / blocks
    free = 1 - np.bincount(path, links) / np.maximum(total, 1)
    fused = np.sqrt(smooth(ratio[path]) * smooth(pointed[path])) * free[path]
    score = np.bincount(path, fused) / blocks
    mean = float(np.average(fused, weights=chars))
    return (score >= level * mean - 1e-9)[path] & (free > 0)[path]


def _below(marked: list[bool], parent: list[int]) -> list[bool]:
    """Marks of the elements and of all those in them; parents come first."""
    out = list(marked)
    for i in range(1, len(out)):
        out[i] = out[i] or out[parent[i]]
    return out


def _sums(values: list[float], parent: list[int]) -> list[float]:
    """Each element's own value and those of all elements in it."""
    out = list(values)
    for i in range(len(out) - 1, 0, -1):
        out[parent[i]] += out[i]
    return out


def candidates(page: Page) -> tuple[list[int], list[bool] | None]:
    """Blocks that no menu, notice or the like holds, and which elements are in a main article (None: no article has text)."""
    elements = page.elements
    size = len(elements)
    parent = [e.parent for e in elements]
    never = _below([e.kind == NEVER for e in elements], parent)
    own = [0.0] * size
    for i, o in enumerate(page.owners):
        if not never[o]:
            own[o] += len(page.texts[i])
    held = _sums(own, parent)
    article = None
    for marked in (page.articles, page.mains):
        most = max((held[a] for a in marked if not never[a]), default=0)
        if most:
            mark = [False] * size
            for a in marked:
                mark[a] = not never[a] and 4 * held[a] >= most
            article = _below(mark, parent)
            break
    first = set(page.headings)
    about = [0.0] * size                               # what lies in an element: a main article, or the first headings
    for a in range(size):
        if (article[a] and not article[parent[a]]) if article else a in first:
            about[a] = 1
    about = _sums(about, parent)
    bad = [False] * size
    for e in elements[1:]:
        holds = about[e.number] > 0 and (article is not None or 2 * held[e.number] >= held[0])
        if article and article[e.number]:
            holds = e.kind == HEADER
        bad[e.number] = e.kind == NEVER or e.kind in (ASIDE, HEADER) and not holds
    bad = _below(bad, parent)
    rows = [i for i, o in enumerate(page.owners) if not bad[o]]
    inside = [i for i in rows if article[page.owners[i]]] if article else []
    return (inside, article) if inside else (rows, None)


def main_text(text: str) -> str:
    """The main text of one page."""
    page = read_page(text)
    rows, within = candidates(page)
    if not rows:
        return ""
    texts = [page.texts[i] for i in rows]
    owners = [page.owners[i] for i in rows]
    paths = np.array([page.paths[i] for i in rows])
    chars = np.array([len(t) for t in texts], float)
    links = np.array([page.links[i] for i in rows], float)
    marks = np.array([len(_punctuation.findall(t)) for t in texts], float)
    chosen = content_nodes(paths, chars, marks, links)
    if not chosen.any():
        chosen[:] = True
    if within is None:
        parent = [e.parent for e in page.elements]
        own = [0.0] * len(parent)
        for i in np.flatnonzero(chosen).tolist():
            own[owners[i]] += chars[i]
        held = _sums(own, parent)
        region = max(e for e, h in enumerate(held) if 10 * h >= 7 * held[0])
        if page.elements[region].tag in ("p", "li", "td", "dd", "blockquote", "pre"):
            region = parent[region]                    # one paragraph: its heading stands beside it
        mark = [False] * len(parent)
        mark[region] = True
        within = _below(mark, parent)
    _, path = np.unique(paths, return_inverse=True)
    only_links = (np.bincount(path, links) >= 0.9 * np.bincount(path, chars)) & (np.bincount(path) > 1) & (np.bincount(path, marks) == 0)
    return " ".join(t for i, t in enumerate(texts) if within[owners[i]] and (chosen[i] or not only_links[path[i]]))


EXTRACTED = "page_id long, url string, text string"


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every row; ``text`` is the main text of ``html``."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.slices(batches, "html"):
            texts = [main_text(h) if h else "" for h in batch.column("html").to_pylist()]
            yield pa.record_batch([batch.column("page_id").cast(pa.int64()), batch.column("url").cast(pa.string()),
                                   pa.array(texts, pa.string())], ["page_id", "url", "text"])
    return pages.select("page_id", "url", "html").mapInArrow(work, EXTRACTED)
