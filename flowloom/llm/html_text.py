"""HTML extraction by line-block distribution.

The markup of a page is stripped to lines: one for each block element, with white space inside a line turned into one
space and character references decoded. Then the line-block distribution decides: weights of lines are summed over sliding
windows of lines; the main text starts where that sum surges (reaches `surge`) at a line with weight, ends where it dives
(to 0), and all lines between the two are kept, links among them too. That is done on every page.

Markup only shapes lines and weights. Lines of menus, headers, footers, sidebars, notices, adverts, forms and reader comments
(by element, by words of class, id and role, or as two or more short list items in a row that are nothing but links) are
blank: they weigh nothing and hold no text. Any other line weighs its text that is no link text. Where one article or main
element holds at least half of the weight (the innermost that does), its lines weigh twice that and 30 more, lines outside it an
eighth, and its edges are `window` blank lines, so that no window reaches over them; an article of little text, like a
teaser, has no say. A form, or an element set aside for a mere word of its class, id or role, that holds nine tenths of the
page's text in three lines or more is the page's wrapper and isn't set aside.

A quote in a tag opens a value only after an equals sign. What can't be a tag is text.

Cases: null or empty html, or a page without text, gives an empty text and 0 characters. A page whose sums never reach `surge`
starts at its largest sum. Very long pages are read whole. Every row is treated alone, so repeated rows and ties give repeated
results; an empty table gives an empty result; other columns are kept as they are, but columns named like the ones made here
are replaced.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from flowloom.llm.common import slices, table, text_column

WINDOW, SURGE = 3, 86
MENU_ITEM = 30

# Element names of HTML by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = ("script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "audio", "video", "textarea", "select", "title")
ASIDE = frozenset("nav header footer aside menu dialog button label fieldset figcaption head".split())
ARTICLE = frozenset(("article", "main"))
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
# Words in class, id and role that mark what is not main text.
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus "
    "footer form header login menu modal nav navbar navigation newsletter notice notices notification pagination popup promo promoted "
    "recommended related respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget contentinfo complementary search".split()
)
# Those of them that also hold for an article element and for articles below.
STRONG_WORDS = frozenset("comment comments commentlist respond disqus related recommended complementary advertisement sponsored promo".split())

_UNREAD = "|".join(UNREAD)
_ATTRS = r"(?:[^>=]+|=\s*(?:\"[^\"]*\"|'[^']*')|=)*+"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{_UNREAD})(?=[\s/>]){_ATTRS}>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*>"
    rf"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>{_ATTRS})>",
    re.S | re.I,
)
_MARKS = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_WORD = re.compile(r"[a-z]+")


@dataclass(slots=True)
class Line:
    text: str
    own: int  # code points that are no link text
    item: bool  # of a list
    hard: bool  # set aside, whatever the page looks like
    soft: int  # the innermost element around it that is set aside unless it holds the page, -1 without any
    article: int  # the innermost article element around it, -1 without any


def _set_aside(tag: str, attrs: str) -> int:
    """0: read it; 1: set aside, unless it holds the page or for an article below; 2: it and all below are set aside."""
    if tag in ASIDE:
        return 2
    soft = int(tag == "form")
    if not attrs or tag in ("html", "body"):
        return soft
    if _HIDDEN.search(attrs):
        return 2
    words = {w for m in _MARKS.finditer(attrs) for w in _WORD.findall((m[1] or m[2] or m[3] or "").lower())}
    if words & STRONG_WORDS:
        return 2
    return max(soft, int(tag not in ARTICLE and bool(words & ASIDE_WORDS)))


def lines_of(page: str) -> tuple[list[Line], list[int], list[int]]:
    """The page's lines; for each article element the one around it; for each element set aside softly the one around it."""
    lines: list[Line] = []
    articles: list[int] = []
    softs: list[int] = []
    outside = ("", False, -1, -1, False, False)
    stack: list[tuple[str, bool, int, int, bool, bool]] = []  # name, hard, soft, article, in a link, in a list item; all but the name hold for what lies below
    parts: list[str] = []
    links: list[str] = []

    def close() -> None:
        if parts:
            text = " ".join(_html.unescape("".join(parts)).split())
            if text:
                _, hard, soft, article, _, item = stack[-1] if stack else outside
                linked = len(" ".join(_html.unescape(" ".join(links)).split())) if links else 0
                lines.append(Line(text, max(0, len(text) - linked), item, hard, soft, article))
            parts.clear()
            links.clear()

    def text(piece: str) -> None:
        parts.append(piece)
        if stack and stack[-1][4]:
            links.append(piece)

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        if not (tag := (m["tag"] or "").lower()):
            if m["raw"]:
                parts.append(" ")
            continue
        aside = 0 if m["end"] else _set_aside(tag, m["attrs"])
        if tag not in INLINE or aside:
            close()
        if tag == "br":
            parts.append(" ")
        elif m["end"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    above = stack[k - 1] if k else outside
                    if stack[k][1:3] != above[1:3]:
                        close()
                    del stack[k:]
                    break
        elif tag not in VOID and not m["attrs"].endswith("/"):
            if tag not in INLINE:
                for k in range(len(stack) - 1, -1, -1):  # a block ends an open paragraph
                    if stack[k][0] == "p":
                        del stack[k:]
                        break
                    if stack[k][0] not in INLINE:
                        break
            _, hard, soft, article, link, item = stack[-1] if stack else outside
            if tag in ARTICLE:
                articles.append(article)
                article, soft = len(articles) - 1, -1
            if aside == 1:
                softs.append(soft)
                soft = len(softs) - 1
            stack.append((tag, hard or aside == 2, soft, article, link or tag == "a", item or tag == "li"))
    if at < len(page):
        text(page[at:])
    close()
    return lines, articles, softs


def _held(own: list[int], inner: list[int], above: list[int]) -> list[int]:
    """For each element what the lines in it hold, with those of the elements below it."""
    out = [0] * len(above)
    for k, n in zip(inner, own, strict=True):
        if k >= 0:
            out[k] += n
    for k in range(len(above) - 1, -1, -1):  # an element comes after the one around it
        if above[k] >= 0:
            out[above[k]] += out[k]
    return out


def _blank(lines: list[Line], softs: list[int]) -> list[bool]:
    """Which lines are set aside."""
    free = [line for line in lines if not line.hard]
    total = sum(line.own for line in free)
    held = _held([line.own for line in free], [line.soft for line in free], softs)
    many = _held([1] * len(free), [line.soft for line in free], softs)
    off = [held[k] * 10 < total * 9 or many[k] < 3 for k in range(len(softs))]
    for k, up in enumerate(softs):
        off[k] |= up >= 0 and off[up]
    blank = [line.hard or line.soft >= 0 and off[line.soft] for line in lines]
    k = 0
    while k < len(lines):
        end = k
        while end < len(lines) and not blank[end] and lines[end].item and not lines[end].own:
            end += 1
        if end - k > 1 and sum(len(line.text) for line in lines[k:end]) < MENU_ITEM * (end - k):  # a menu
            blank[k:end] = [True] * (end - k)
        k = max(end, k + 1)
    return blank


def shaped(lines: list[Line], articles: list[int], softs: list[int], window: int = WINDOW) -> tuple[list[int], list[str | None]]:
    """The weights of the page's lines and their texts, None for blank ones; with the blank lines at an article's edges."""
    blank = _blank(lines, softs)
    own = [0 if b else line.own for line, b in zip(lines, blank, strict=True)]
    held = _held(own, [line.article for line in lines], articles)
    chosen = max((k for k in range(len(articles)) if held[k] and 2 * held[k] >= sum(own)), default=-1)
    inside = [False] * len(articles)
    for k, up in enumerate(articles):
        inside[k] = k == chosen or up >= 0 and inside[up]
    weights: list[int] = []
    texts: list[str | None] = []
    before = False
    for line, n, b in zip(lines, own, blank, strict=True):
        here = line.article >= 0 and inside[line.article]
        if here != before:
            weights += [0] * window
            texts += [None] * window
        before = here
        weights.append(n if chosen < 0 else n // 8 if not here else 2 * n + 30 if n else 0)
        texts.append(None if b else line.text)
    return weights, texts


def between(weights: list[int], window: int = WINDOW, surge: int = SURGE) -> np.ndarray:
    """Whether each line lies between a surge and the next dive."""
    w = np.asarray(weights, dtype=np.int64)
    ends = np.concatenate([[0], np.cumsum(w)])
    at = np.arange(len(w))
    sums = ends[np.minimum(at + window, len(w))] - ends[at]  # of the window that starts here
    keep = np.zeros(len(w), dtype=bool)
    least = min(surge, int(sums.max(initial=0)))
    if least <= 0:
        return keep
    surges = np.flatnonzero((sums >= least) & (w > 0))
    dives = np.append(np.flatnonzero(sums == 0), len(w))
    end = 0
    for start in surges.tolist():
        if start >= end:
            end = int(dives[np.searchsorted(dives, start)])
            keep[start:end] = True
    return keep


def main_text(page: str, window: int = WINDOW, surge: int = SURGE) -> str:
    weights, texts = shaped(*lines_of(page), window)
    return "\n".join(t for t, kept in zip(texts, between(weights, window, surge), strict=True) if kept and t is not None)


def extract_main_text(pages: DataFrame, html: str = "html", into: str = "text", window: int = WINDOW, surge: int = SURGE) -> DataFrame:
    """`pages` without the html column, with the main text in column `into` (which replaces one of that name) and its code points in n_chars. Narrow: no shuffle."""
    kept = [c for c in pages.columns if c not in (html, into, "n_chars")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields if f.name in kept), f"`{into}` string", "n_chars bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, html):
            texts = [main_text(x, window, surge) for x in text_column(batch, html).to_pylist()]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=[*kept, into, "n_chars"])

    return pages.select(*kept, html).mapInArrow(run, schema)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
