"""Main text of web pages: flat text blocks, judged by a decision tree on their and their neighbours' features."""

from __future__ import annotations

import html as _html
import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML.
#: What follows is no markup up to their end tag, or to the end of the page, and never text.
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
#: Their content is not text either, if they are closed. Where the next of the name begins first, or no end comes, the start tag alone is passed over.
SILENT = frozenset("noscript template svg object canvas select datalist button audio video map annotation annotation-xml".split())
#: These stand in one another; their ends are counted.
NESTED = frozenset("svg object template noscript".split())
#: They stand inside a line; all other elements end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img input label option math mi mo mn ms mtext mspace mrow mfrac msup msub msubsup msqrt mroot mover munder munderover mtable mtr mtd mstyle mfenced menclose mpadded mphantom semantics".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold what is not the article. A form is none: it may be wrapped around a whole page, so what counts is how many words it holds.
SIDE = frozenset("nav header footer aside menu dialog".split())
#: Elements that hold the article.
MAIN = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words of class names, ids and roles; a name is taken apart at marks, digits and capitals. They are features of a block; what they are worth, the tree learns.
#: They tell of something else than the article wherever a name begins or ends with them.
SIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored cookie cookies consent gdpr notice popup modal newsletter subscribe subscription sidebar menu navbar navigation nav "
    "breadcrumb breadcrumbs pagination pager header masthead footer copyright comment comments replies reply disqus respond responses discussion feedback contentinfo complementary".split()
)
#: These do so only alone or beside a word for a container.
WEAK_WORDS = frozenset("share sharing social tag tags search related recommended legal side widget promo promotion promotions login signup".split())
CONTAINERS = frozenset("list links bar box block buttons widget widgets section area container wrapper posts articles stories items nav menu form icons panel".split())
MAIN_WORDS = frozenset("article post entry story content main body".split())
_TAG = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|$)|<[!?/][^>]*(?:>|$)", re.S)
_HINT = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_LEGAL = re.compile(r"^(?:©|\(c\)\s*\d|copyright\b)|\ball rights reserved\b", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@lru_cache(maxsize=4096)
def marks(names: str) -> tuple[bool, bool]:
    """Whether class names, ids and roles tell of a side part, and of the article. A name that is one word counts before a longer one."""
    whole, side, main = set(), False, False
    for name in names.split():
        words = [w.lower() for w in _WORD.findall(name)]
        if not words:
            continue
        if len(words) == 1:
            whole.add(words[0])
            continue
        ends = {words[0], words[-1]}
        if ends & SIDE_WORDS or ends & WEAK_WORDS and ends & CONTAINERS:
            side = True
        elif ends & MAIN_WORDS:
            main = True
    if whole & (SIDE_WORDS | WEAK_WORDS):
        return True, False
    if whole & MAIN_WORDS:
        return False, True
    return side, main and not side


@dataclass
class Block:
    text: str
    links: int = 0  # words inside links
    side: bool = False
    main: bool = False
    heading: bool = False
    form: int = 0  # which form it stands in; 0 for none
    words: int = field(init=False)

    def __post_init__(self):
        self.words = len(self.text.split())
        if not self.main and self.words <= 25 and _LEGAL.search(self.text):  # an article may quote such a line
            self.side = True

    @property
    def density(self) -> float:
        return self.links / self.words if self.words else 0.0


def blocks(page: str | None) -> list[Block]:
    """Flat text blocks in page order. White space is one space; references are decoded. Unclosed elements are
    closed by the end of the element around them, and an end without a start is passed over. The end tags of head, body and p may be missing."""
    page = page or ""
    out: list[Block] = []
    parts: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, bool, bool, bool, int]] = []  # name, inside a side part, inside the article, inside a heading, inside which form
    in_link = forms = 0

    def close():
        text = " ".join("".join(parts).split()) if parts else ""
        if text:
            _, side, main, heading, form = stack[-1] if stack else ("", False, False, False, 0)
            out.append(Block(text, len("".join(linked).split()) if linked else 0, side, main, heading, form))
        parts.clear()
        linked.clear()

    def say(raw: str):
        text = _html.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if in_link:
            linked.append(text)

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if (name in RAW or name in SILENT) and not m[1]:
            if not m[3].rstrip().endswith("/"):
                at = _past(page, name, at)
            if name not in INLINE:
                close()
            continue
        if name in RAW or name in SILENT:
            continue
        if name == "a":
            in_link = 0 if m[1] else 1
            linked.append(" ")
        if name in INLINE:
            continue
        close()
        if name in VOID:
            continue
        if m[1]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if depth is not None:
                del stack[depth:]
            in_link = 0
            continue
        if name == "p" and stack and stack[-1][0] == "p":
            stack.pop()
        said = marks(" ".join(h.strip("\"'") for h in _HINT.findall(m[3]))) if m[3] and name not in ("html", "body") else (False, False)
        _, side, main, heading, form = stack[-1] if stack else ("", False, False, False, 0)
        here = name in SIDE or said[0]
        if name == "form":
            forms = form = forms + 1
        stack.append((name, side or here, (main or name in MAIN or said[1]) and not here, heading or name in HEADINGS, form))
    close()
    return out


@lru_cache(maxsize=64)
def _ends(name: str) -> re.Pattern:
    return re.compile(rf"<(/?){re.escape(name)}(?=[\s/>]|$)[^>]*>?", re.I)


def _past(page: str, name: str, at: int) -> int:
    """Where an element without text that began before `at` ends; `at` itself if it is not closed."""
    depth = 1
    for m in _ends(name).finditer(page, at):
        if m[1]:
            depth -= 1
            if not depth:
                return m.end()
        elif name in NESTED:
            depth += not m[0].rstrip(">").endswith("/")
        elif name not in RAW:
            return at  # the next one begins: this one has no end
    return len(page) if name in RAW else at


#: Features of a block, in this order.
FEATURES = ("words", "density", "prev_words", "prev_density", "next_words", "next_density", "side", "main", "heading", "any_main", "prev_side", "next_side", "longest_near", "longest", "page_links", "form")


def features(found: list[Block]) -> list[tuple]:
    """One tuple per block. Before the first and after the last block stands an empty one that belongs to no article.
    longest_near: words of the longest block within two places that is mostly no link and in no side part; longest: that of the whole page. page_links: the
    share of words in links outside side parts. form: words of the form around the block that are in no side part, 0 without a form."""
    in_form: dict[int, int] = {}
    for b in found:
        in_form[b.form] = in_form.get(b.form, 0) + (0 if b.side else b.words)
    in_form[0] = 0
    outside = sum(b.words for b in found if not b.side)
    page_links = sum(b.links for b in found if not b.side) / outside if outside else 0.0
    any_main = any(b.main and not b.side for b in found)
    own = [(0, 0.0, True), *((b.words, b.density, b.side) for b in found), (0, 0.0, True)]
    plain = [0, 0, *(0 if b.side or b.density > 0.5 else b.words for b in found), 0, 0]
    longest = max(plain)
    return [
        (b.words, here[1], p[0], p[1], q[0], q[1], b.side, b.main, b.heading, any_main, p[2], q[2], max(plain[i : i + 2] + plain[i + 3 : i + 5]), longest, page_links, in_form[b.form])
        for i, (b, p, here, q) in enumerate(zip(found, own, own[1:], own[2:], strict=False))
    ]


#: Labelled pages, written by hand after common forms of pages: g20 stands for 20 words of the article, b3 for 3 words of
#: something else. Each is taken at several lengths.
PAGES = (
    # marked articles
    "<nav><ul><li><a>b1</a><li><a>b2</a><li><a>b1</a></ul></nav><div class=ad>b8</div><article><h1>g9</h1><p>g40</p><p>g70<p>g12</article><footer>b7</footer>",
    "<header><p>b12</p></header><nav><a>b4</a></nav><main><h1>g7</h1><p>g4</p><p>g60 <a>g2</a> g8</p><ul><li>g6<li>g9<li>g4</ul><p>g33</p><h2>g3</h2><p>g50</p></main><aside><p>b25</p><p>b12</p></aside><footer><p>b5</p><a>b2</a></footer>",
    "<div class='site-header'>b6</div><div class='cookie-notice'><p>b35</p><a>b2</a></div><div class='post type-post tag-economy'><h1>g8</h1><p>g55</p><p>g18</p><div class=ad>b14</div><p>g75</p></div><div class='related-posts'><h3>b2</h3><a>b7</a><a>b9</a></div><section id=comments><p>b40</p><p>b15</p></section>",
    "<form id=f><div class=menu><a>b1</a><a>b2</a></div><article><h2>g6</h2><p>g30</p><p>g3</p><blockquote>g25</blockquote><p>g44</p></article><div class=footer>b9</div></form>",
    "<nav><a>b6</a></nav><aside>b30</aside><div class='entry-content'><p>g65</p><p>g2</p><p>g1</p><table><tr><td>g2<td>g1<tr><td>g3<td>g2</table><p>g48</p><ul><li><a>b3</a><li><a>b4</a><li><a>b2</a></ul></div><div class=newsletter><p>b18</p><form>b4</form></div>",
    "<div class=banner>b20</div><main><p>g22</p><p>g31 <a>g6</a></p><section class=discussion><p>b50</p><p>b22</p></section></main><footer>b30</footer>",
    "<p>b4</p><div>b12</div><main><h1>g5</h1><p>g80</p><p>g26</p></main><div>b10</div><p>b25</p><div><a>b3</a></div>",
    "<div>b45</div><article><p>g60</p><h3>g4</h3><p>g8</p><p>g7</p><p>g52</p></article><div>b60</div><p>b30</p>",
    "<article><header><a>b3</a></header><p>g45</p><figure><figcaption>g9</figcaption></figure><p>g38</p><p><a>g3</a></p><p>g64</p></article><aside><a>b5</a><p>b60</p></aside>",
    # pages without marks
    "<div><a>b1</a> <a>b1</a> <a>b2</a></div><h1>g8</h1><p>g60</p><p>g45</p><p>g6</p><p>g80</p><div><a>b3</a> <a>b2</a></div><div>b5</div>",
    "<ul><li><a>b2</a><li><a>b1</a><li><a>b3</a></ul><h2>g5</h2><div>g90</div><div>g24 <a>g2</a></div><div>g55</div><p>b4 <a>b3</a></p><p>b3</p>",
    "<table><tr><td><a>b2</a><br><a>b3</a><td><p>g35</p><p>g62</p><p>g20</p></table><p>b6 <a>b5</a></p>",
    "<p>g70</p><p>g40</p><p>g15</p><p>g35</p>",
    "<p>g45</p>",
    "<p>b2</p><p>b3</p><p><a>b4</a></p><p>b5</p>",
    "<div><a>b6</a></div><p>b2</p><h1>g7</h1><p>b3</p><p>g50</p><h3>g3</h3><p>g42</p><p>g11</p><p>g66</p><p>b2 <a>b2</a></p><div><a>b8</a></div><div><a>b9</a></div><div>b6</div>",
    # side parts before and after unmarked articles
    "<nav><a>b6</a></nav><p>g50</p><p>g30</p><footer>b14</footer>",
    "<div class=ad>b10</div><p>g40</p><div class=ad>b35</div><p>g60</p><aside>b90</aside><p>g28</p>",
    "<div class='cookie-notice'>b16</div><aside>b7</aside><form>b5</form><h1>g6</h1><p>g48</p><p>g33</p><div id=comments><p>b55</p><p>b9</p></div>",
    "<header>b5</header><aside><p>b3</p></aside><nav><a>b3</a></nav><p>g30</p><p>g90</p><footer><p>b40</p></footer>",
    "<nav><a>b2</a></nav><aside><p>b60</p></aside><footer>b8</footer>",
    "<div class=modal>b30</div><form><p>b3</p><p>b12</p></form><div class=sidebar><p>b22</p><a>b4</a></div>",
    # forms: around the whole page, and beside the article
    "<form><p>g60</p><p>g60</p></form>",
    "<form><div class=content><p>g60</p><p>g3</p><p>g90</p></div></form><footer>b9</footer>",
    "<form><nav><a>b2</a></nav><h1>g6</h1><p>g50</p><p>g12</p><p>g70</p></form>",
    "<p>g60</p><form><p>b9</p><p>b3</p></form><p>g40</p><form>b15</form>",
    "<main><p>g50</p><form><p>b6</p><p>b4</p></form><p>g60</p></main>",
    # pages of short texts
    "<p>g2</p><p>g3</p>",
    "<p>g4</p>",
    "<p>g1</p>",
    "<h1>g2</h1><p>g4</p><p>g3</p><p>g6</p>",
    "<div>g3</div><div>g5</div><div>g2</div><div>g4</div><div>g1</div>",
    "<nav><a>b2</a><a>b3</a></nav><p>g3</p><p>g4</p><footer>b4</footer>",
    "<article><p>g2</p><p>g3</p></article>",
    "<div><a>b2</a> <a>b3</a></div><p>b2</p><p><a>b3</a></p>",
)
LENGTHS = (0.4, 0.7, 1.0, 1.6, 3.0)


def labelled_blocks(pages=PAGES, lengths=LENGTHS) -> np.ndarray:
    """Features of the blocks of the labelled pages; last column: 1 for text of the article."""
    rows = []
    for page in pages:
        for k in lengths:
            text = re.sub(r"\b([gb])(\d+)\b", lambda m, k=k: " ".join([m[1]] * max(1, round(int(m[2]) * (k if int(m[2]) > 4 else 1)))), page)
            found = blocks(text)
            rows += [(*f, b.text[0] == "g") for b, f in zip(found, features(found), strict=True)]
    return np.array(rows, float)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8):
    """A decision tree by Gini impurity: (feature, cut, low, high) or the share of ones."""
    if depth == 0 or y.min() == y.max():
        return float(y.mean())
    best = None
    for f in range(x.shape[1]):
        order = x[:, f].argsort(kind="stable")
        v, t = x[order, f], y[order]
        left = np.cumsum(t)[:-1]
        k = np.arange(1, len(t))
        a, b = left / k, (t.sum() - left) / (len(t) - k)
        impurity = k * a * (1 - a) + (len(t) - k) * b * (1 - b)
        impurity[v[1:] == v[:-1]] = np.inf
        if len(impurity) and np.isfinite(impurity.min()) and (best is None or impurity.min() < best[0] - 1e-12):
            i = int(impurity.argmin())
            best = (impurity[i], f, float(v[i] + v[i + 1]) / 2)
    if best is None:
        return float(y.mean())
    _, f, cut = best
    low = x[:, f] <= cut
    return f, cut, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


@lru_cache(maxsize=1)
def tree():
    t = labelled_blocks()
    return grow(t[:, :-1], t[:, -1])


def keeps(node, row) -> bool:
    while isinstance(node, tuple):
        f, cut, low, high = node
        node = low if row[f] <= cut else high
    return node >= 0.5


def main_text(page: str | None, model=None) -> str:
    model = model or tree()
    found = blocks(page)
    return " ".join(b.text for b, row in zip(found, features(found), strict=True) if keeps(model, row))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: one row per row, no shuffle. Null, empty and textless pages have an empty text.
    Nothing but ids is judged by repeated or null ids and urls: they pass through."""

    model = tree()  # some dozens of nodes

    def run(batches):
        for b in batches:
            text = [main_text(h.as_py(), model) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long"
    )
