"""Main text of web pages: flat text blocks, classified by a small decision tree.

A page is cut into its text blocks in page order; block-level tags end a block,
inline tags don't.  Each block has its number of words and link density, those
of the blocks before and after it, whether it is a heading or list item, and
what it lies in: an article, a place outside the articles that hold most of
the page, or a part whose tag, role, class or id marks
menus, headers, footers, sidebars, notices, adverts, forms or comments.  A
decision tree over these features, grown on the labelled pages of
html_labels.py, tells main text from the rest.

A name says little about a wrapper: class and id of html, body, main and article
mark nothing, nor do names like has-sidebar, layout--sidebar or comments-open.
A form or a part marked by its name alone loses the mark where it, and nothing
outside such parts, holds the page's article (see ``_lifted``).

Scripts, styles, comments and other parts without readable text yield no
blocks.  Character references are decoded after the markup is cut, once.

Defined results: null or empty html, or a page without main text, gives an empty
string; unclosed and misplaced tags are tolerated: a closing tag ends the
innermost open part of its name, or nothing; repeated rows are all returned; a
null page_id or url stays null; other columns may have any name.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ddlscope.llm import tables
from ddlscope.llm.html_labels import LABELLED

#: Elements whose content is no readable text of the page.
SILENT = "script|style|noscript|template|textarea|title|svg|math|iframe|object|select|button|canvas|audio|video"
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<silent>{SILENT})(?=[\s/>])[^>]*+>.*?(?:</(?P=silent)\s*+>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-z][a-z0-9:-]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/?)(?P<tag2>[a-z][a-z0-9:-]*+)(?P<attrs2>[^>]*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)", re.I | re.S)
#: Parts that hold blocks and may be nested.
PARTS = set("html body head div section article main nav header footer aside form ul ol dl menu table tbody thead tr "
            "fieldset figure details dialog blockquote address hgroup center".split())
#: Other tags that start and end a block.
BLOCKS = PARTS | set("p h1 h2 h3 h4 h5 h6 li dt dd td th caption figcaption pre hr summary legend label option".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Tags and roles of parts beside the main text.
BESIDE_TAGS = {"head", "nav", "footer", "aside", "menu", "dialog"}
BESIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar"}
#: Words in a class or id that mark such parts, whole words and beginnings.
BESIDE_WORDS = set("ad ads adv menu nav navbar breadcrumb breadcrumbs toc pagination pager sidebar side aside widget widgets "
                   "related footer foot cookie cookies consent gdpr notice notices alert banner popup modal overlay login signin signup "
                   "search social share sharing tags masthead topbar toolbar print skip legal copyright".split())
BESIDE_STARTS = ("advert", "sponsor", "promo", "newsletter", "subscri", "recommend", "navig")
#: Words of parts with readers' comments, which stay beside the main text however long they are.
COMMENT_WORDS = set("comment comments commentlist disqus respond replies".split())
#: Words in a name after which it tells what a page or wrapper has, and words that end the name of a state.
MODIFIERS, STATES = {"has", "with", "no", "left", "right", "category", "tag"}, {"open", "closed"}
#: Words outside links from which a block is running text, where marked parts are weighed.
RUNNING = 8
#: Tags around the main text, whose class and id describe the page or its subject.
AROUND_TAGS = {"html", "body", "main", "article"}
_NAMES = re.compile(r"\b(class|id|role|style|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


#: Marks of a part: none, one that can be lifted (forms, names), one that can't (tags, roles, hidden parts, comments).
UNMARKED, SOFT, HARD = 0, 1, 2


@dataclass
class Block:
    text: str
    words: int
    link_words: int
    mark: int      # innermost marked part around it (a number, -1 for none)
    article: bool  # lies in an article or main part
    heading: int   # 1 to 6, 0 for none
    item: bool
    beside: bool = False  # lies in a part beside the main text
    apart: bool = False   # lies in no article, though articles hold most of the page's plain words


def _own_words(names: str) -> list[str]:
    """The words of a class or id that say what a part itself is."""
    found = []
    for name in names.split():
        words = [w.lower() for w in _WORDS.findall(name.split("--")[0])]
        if words and words[-1] not in STATES:
            found += words[:next((i for i, w in enumerate(words) if w in MODIFIERS), len(words))]
    return found


def _marks(tag: str, attrs: str, in_article: bool) -> tuple[int, bool]:
    """(mark, article) of an opening tag."""
    mark = HARD if tag in BESIDE_TAGS or tag == "header" and not in_article else SOFT if tag == "form" else UNMARKED
    article = tag in ("article", "main")
    if attrs:
        for m in _NAMES.finditer(attrs):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "role":
                mark = HARD if value.lower() in BESIDE_ROLES else mark
                article |= value.lower() in ("main", "article")
            elif name == "style":
                mark = HARD if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) else mark
            elif name == "hidden":
                mark = HARD
            elif tag not in AROUND_TAGS:
                words = _own_words(value)
                if "hidden" in value.lower().split() or not COMMENT_WORDS.isdisjoint(words):
                    mark = HARD
                elif any(w in BESIDE_WORDS or w.startswith(BESIDE_STARTS) for w in words) or "header" in words and not in_article:
                    mark = max(mark, SOFT)
    return mark, article


def text_blocks(page: str) -> list[Block]:
    """The non-empty text blocks of a page in page order."""
    found: list[Block] = []
    marked: list[tuple[int, int, bool]] = []      # mark, the marked part around it, whether it is a form
    open_parts: list[tuple[str, int, bool]] = []  # tag, innermost marked part, article (with those around it)
    pieces: list[tuple[str, bool]] = []           # text, in a link
    tag_now, own_mark, link = "", -1, False

    def marked_part(mark: int, around: int, tag: str) -> int:
        if mark == UNMARKED:
            return around
        marked.append((mark, around, tag == "form"))
        return len(marked) - 1

    def end_block() -> None:
        text = " ".join(html.unescape("".join(t for t, _ in pieces)).split()) if pieces else ""
        if text:
            _, mark, article = open_parts[-1] if open_parts else ("", -1, False)
            linked = sum(len(t.split()) for t, in_link in pieces if in_link)
            heading = int(tag_now[1]) if tag_now in HEADINGS else 0
            found.append(Block(text, len(text.split()), linked, max(mark, own_mark), article, heading, tag_now in ("li", "dt", "dd")))
        pieces.clear()

    at = 0
    for m in _MARKUP.finditer(page):
        if m.start() > at:
            pieces.append((page[at:m.start()], link))
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag, close = tag.lower(), bool(m["close"] or m["close2"])
        if tag == "a":
            link = not close
        elif tag == "br":
            pieces.append((" ", link))
        elif tag in BLOCKS:
            end_block()
            link = False
            _, around, article = open_parts[-1] if open_parts else ("", -1, False)
            attrs = m["attrs"] or m["attrs2"] or ""
            if tag in PARTS:
                if close:
                    for i in range(len(open_parts) - 1, -1, -1):
                        if open_parts[i][0] == tag:
                            del open_parts[i:]
                            break
                else:
                    mark, is_article = _marks(tag, attrs, article)
                    open_parts.append((tag, marked_part(mark, around, tag), article or is_article))
                tag_now, own_mark = "", -1
            elif close or not attrs.strip(" /"):
                tag_now, own_mark = "" if close else tag, -1
            else:
                tag_now, own_mark = tag, marked_part(_marks(tag, attrs, article)[0], around, tag)
    if at < len(page):
        pieces.append((page[at:], link))
    end_block()
    if marked:
        lifted, silent = _lifted(found, marked), []
        for i, (_, around, _) in enumerate(marked):
            silent.append(i not in lifted or around >= 0 and silent[around])
        for b in found:
            b.beside = b.mark >= 0 and silent[b.mark]
    plain = [0, 0]
    for b in found:
        if not b.beside:
            plain[b.article] += b.words - min(b.words, b.link_words)
    for b in found:
        b.apart = not b.article and plain[1] > plain[0]
    return found


def _lifted(blocks: list[Block], marked: list[tuple[int, int, bool]]) -> set[int]:
    """The marked parts that hold the page's article, from the outermost inwards.

    Of the soft parts at one depth it is the one with the most plain words, those in
    article or main parts first, if nothing outside has any such words and
    it has more of them than there are words of running text outside; or if it has the page's first
    heading and more running text than is outside; or if it is a form with most
    of the page's running text.  What lies in hard parts doesn't count.
    """
    # of a soft part with the soft parts in it, of the page (last) without them: words in articles, running text, best heading
    sums = [[0, 0, 7] for _ in range(len(marked) + 1)]

    def add(to: list[int], more: list[int]) -> None:
        to[0], to[1], to[2] = to[0] + more[0], to[1] + more[1], min(to[2], more[2])

    direct: list[list[int]] = [[0, 0, 7] for _ in range(len(marked) + 1)]  # without the soft parts in it
    for b in blocks:
        plain = max(0, b.words - b.link_words)
        running = plain if plain >= RUNNING and not b.heading else 0
        add(direct[b.mark], [plain if b.article else 0, running, b.heading or 7])
    inner: dict[int, list[int]] = {}
    for i in range(len(marked) - 1, -1, -1):
        mark, around, _ = marked[i]
        if mark == SOFT:
            add(sums[i], direct[i])
            if around < 0 or marked[around][0] == SOFT:
                inner.setdefault(around, []).append(i)
                if around >= 0:
                    add(sums[around], sums[i])
    lifted: set[int] = set()
    outside, at = direct[-1], -1
    whole = list(outside)
    for i in inner.get(-1, ()):
        add(whole, sums[i])
    while at in inner and not outside[0]:
        best = max(inner[at], key=lambda i: (sums[i][0], sums[i][1], -i))
        in_articles, running, heading = sums[best]
        if not (in_articles > outside[1] or heading <= 2 and heading == whole[2] < outside[2] and running > outside[1]
                or marked[best][2] and 2 * running > whole[1] and running > outside[1]):
            break
        lifted.add(best)
        add(outside, direct[best])
        at = best
    return lifted


#: words, link density of a block, the one before, the one after; then what it is and lies in.
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "beside", "article", "apart", "heading", "item")


def features(blocks: list[Block]) -> list[list[float]]:
    size = [(b.words, min(1.0, b.link_words / b.words)) for b in blocks]
    around = [(0, 0.0), *size, (0, 0.0)]
    return [[*around[i + 1], *around[i], *around[i + 2], b.beside, b.article, b.apart, b.heading > 0, b.item] for i, b in enumerate(blocks)]


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8) -> tuple:
    """A tree by least Gini impurity: (feature, cut, at most the cut, above) or a label; ties to the first feature and cut."""
    if depth == 0 or len(set(y.tolist())) < 2:
        return bool(y.mean() >= 0.5)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= cut
            impurity = sum(len(part) * part.mean() * (1 - part.mean()) for part in (y[low], y[~low]))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, float(cut), low)
    if best is None:
        return bool(y.mean() >= 0.5)
    _, f, cut, low = best
    return f, cut, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


def trained() -> tuple:
    """The tree of the labelled pages: a block's text starts with + (main text) or - there."""
    x, y = [], []
    for page in LABELLED:
        blocks = text_blocks(page)
        for b in blocks:
            y.append(b.text[0] == "+")
        x += features(blocks)
    return grow(np.array(x, np.float64), np.array(y, np.float64))


def classify(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, cut, low, high = tree
    left = x[:, f] <= cut
    out = np.empty(len(x), bool)
    out[left], out[~left] = classify(low, x[left]), classify(high, x[~left])
    return out


def main_text(page: str | None, tree) -> str:
    blocks = text_blocks(page or "")
    if not blocks:
        return ""
    keep = classify(tree, np.array(features(blocks), np.float64))
    return "\n\n".join(b.text for b, k in zip(blocks, keep) if k)


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of ``pages`` (page_id, url, html)."""
    tree = trained()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(batch.column(2)[i].as_py(), tree) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(
        rows, "page_id long, url string, text string, n_chars long")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(tables.table(spark, sf_dir, "pages"))
