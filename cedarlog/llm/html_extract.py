"""Main text of web pages by line-block distribution.

The markup is stripped into lines, one for each block-level element, of which each has a text length. Lines that are
mostly links have length 0, and so has, as one line, an element that never holds an article (navigation, headers,
footers, sidebars, notices, adverts, forms, reader comments; one inside an article's own element is no line at all). A
class word does not switch off an element that contains an article or most of the page's text. Lengths are summed over a
sliding window of lines. Where the sum leaves 0 text begins, and where it is 0 again the text dives; a run between is
kept, lines of links included, if its sums surge over a threshold or if it holds text of an article's own element.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_back

#: Quotes count after an equals sign only, and a tag that never closes takes the rest; possessive, so in linear time.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)", re.S)
RAW = frozenset("script style noscript template textarea title iframe object svg annotation select canvas audio video xmp noembed noframes".split())
ASIDE = frozenset("nav header footer aside form menu dialog datalist option button".split())
#: Elements that hold a line at most: a block that begins ends them, as their own end tags may be missing.
SHORT = frozenset("p option button".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter output q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr math semantics mrow mi mn mo ms mtext mspace mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mtable mtr mtd".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOT_ARTICLE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu menubar breadcrumb breadcrumbs"
    " sidebar side header masthead footer cookie cookies consent notice gdpr alert newsletter subscribe signup login popup modal overlay"
    " comment comments disqus replies respond share sharing social related recommended toolbar pagination pager widget skip copyright legal".split()
)
#: Words of notices, which are none of the article however much they say.
NOTICE = frozenset("cookie cookies consent gdpr".split())
#: Words that say where or how a part of a page is laid out. Inside an article, a compound of a boilerplate word and any other
#: word (share-price, side-note) is no boilerplate.
LAYOUT = frozenset(
    "site page main top bottom left right box bar wrap wrapper container section block inner outer list links link item items area panel content post article entry"
    " button buttons btn icon icons form text message policy info title heading row col column group module component slot unit banner label meta tags tag social media more".split()
)
#: Words of sections that follow an article and may hold further <article> elements (a comment or a teaser each).
AFTER_ARTICLE = frozenset("comment comments disqus replies respond related recommended".split())
#: Words of a header that is an article's.
OF_ARTICLE = frozenset("article entry post story".split())
#: Lines in a window, and the sum at which text surges; on a page that nowhere has twice that, half of its largest sum.
WINDOW, SURGE = 3, 86
#: Text on either side, in a window of lines, that is an article's, so that a list of links between is the article's too.
DENSE = 200
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
ATTRIBUTE = re.compile(r"([^\s=/>]++)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?+")
CLOSED_BY = {k: frozenset({k}) for k in ("p", "li", "option", "tr")} | {"dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"})}


def _boilerplate(tag: str, attributes: str, in_article: bool) -> str | None:
    """Why an element is boilerplate: hidden, its tag or role, or a word (notice: of a notice; after: of a section that follows an article)."""
    why = None
    if tag in ASIDE and not (tag == "header" and in_article):
        why = "word" if tag == "form" else "tag"
    if not attributes.strip():
        return why
    for name, *values in ATTRIBUTE.findall(attributes):
        value = "".join(values).lower()
        name = name.lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return "hidden"
        if name == "role" and value in ROLES:
            why = "tag"
        if name in ("class", "id") and tag not in ("html", "body", "article", "main"):
            words = set()
            for one in value.split():
                of = {w for w in re.split(r"[^a-z]+", one) if w}
                if not in_article or not of & NOT_ARTICLE or of <= NOT_ARTICLE | LAYOUT:
                    words |= of
            if tag == "header" and words & OF_ARTICLE:
                why = None
            elif words := words & NOT_ARTICLE:
                why = why if why == "tag" else "notice" if why == "notice" or words & NOTICE else "after" if why == "after" or words & AFTER_ARTICLE else "word"
    return why


def _switched_off(marked: list[tuple[str, int, int]], articles: list[tuple[str, int]], found: list[tuple[str, bool, int, int]]) -> list[int]:
    """For each marked element (why, the marked one around it or -1, how many articles are around it) the outermost element
    whose text is dropped that it is or lies in, or -1. Articles: name, the marked element around it or -1.

    An element that contains <main> is not dropped, unless it is hidden; one marked by a class word or a form is not if it
    contains an article (the page's first, if its word is that of a section after an article) or more than half of the
    page's text. On a page with articles an element with most of the text has to hold several blocks too, and one of a
    section after an article is not spared for its share if an article is elsewhere."""
    upwards = [(i, up) for i, (_, up, _) in reversed(list(enumerate(marked))) if up >= 0]
    inside, first, main = [0] * len(marked), [False] * len(marked), [False] * len(marked)
    for k, (name, mark) in enumerate(articles):
        if mark >= 0:
            inside[mark], first[mark], main[mark] = inside[mark] + 1, first[mark] or k == 0, main[mark] or name == "main"
    for i, up in upwards:
        inside[up], first[up], main[up] = inside[up] + inside[i], first[up] or first[i], main[up] or main[i]
    hard: list[bool] = []  # is or lies in an element that is dropped whatever the lengths are
    for i, (why, up, _) in enumerate(marked):
        hard.append((up >= 0 and hard[up]) or why == "hidden" or (why == "tag" and not main[i]))
    size, blocks, total = [0] * len(marked), [0] * len(marked), 0
    for text, linked, mark, _ in found:
        if not linked and not (mark >= 0 and hard[mark]):
            total += len(text)
            if mark >= 0:
                size[mark], blocks[mark] = size[mark] + len(text), blocks[mark] + 1
    for i, up in upwards:
        size[up], blocks[up] = size[up] + size[i], blocks[up] + blocks[i]
    off: list[int] = []
    for i, (why, up, around) in enumerate(marked):
        drop = why == "hidden" or (why == "tag" and not main[i])
        if why == "notice":
            drop = not (main[i] or first[i])
        elif why in ("word", "after"):
            article = main[i] or first[i] or (why == "word" and inside[i] > 0)
            elsewhere = inside[i] + around < len(articles)
            most = 2 * size[i] > total and (blocks[i] > 1 or not articles) and not (elsewhere and why == "after")
            drop = not (article or most)
        off.append(off[up] if up >= 0 and off[up] >= 0 else i if drop else -1)
    return off


def _decode(text: str) -> str:
    """Character references decoded; numbers too long to be a character's are none, as they are for any that is too large."""
    if "&#" in text:
        text = re.sub(r"&#0*+[0-9]{8,};?", "�", text)
    return html.unescape(text)


def lines_of(page: str) -> list[tuple[str, int, bool]]:
    """The page's lines in order: (text, length, whether it is in an article's own element). Boilerplate has no text, and
    length 0; blocks that are mostly links outside an article's own element have length 0."""
    found: list[tuple[str, bool, int, int]] = []  # text, whether it is mostly links, innermost marked element and article
    stack: list[tuple[str, bool, bool]] = []  # open elements that are not inline: name, whether it is marked, whether it is an article
    opened: Counter[str] = Counter()  # by name
    opened_marked: Counter[str] = Counter()
    marked: list[tuple[str, int, int]] = []
    articles: list[tuple[str, int]] = []
    marks: list[int] = [-1]  # open ones
    regions: list[int] = [-1]
    held: list[str] = []
    linked = [0]
    links = 0

    def end() -> None:
        text = " ".join(_decode("".join(held)).split())
        held.clear()
        if text:
            found.append((text, 2 * linked[0] > len(text), marks[-1], regions[-1]))
        linked[0] = 0

    def push(tag: str, why: str | None) -> None:
        if article := tag in ("article", "main"):
            regions.append(len(articles))
            articles.append((tag, marks[-1]))
        if why:
            marked.append((why, marks[-1], len(regions) - 1))
            marks.append(len(marked) - 1)
            opened_marked[tag] += 1
        opened[tag] += 1
        stack.append((tag, why is not None, article))

    def pop() -> str:
        name, mark, article = stack.pop()
        opened[name] -= 1
        if mark:
            marks.pop()
            opened_marked[name] -= 1
        if article:
            regions.pop()
        return name

    at, size = 0, len(page)
    for m in iter(lambda: TOKEN.search(page, at), None):
        if m.start() > at:
            held.append(page[at : m.start()])
            if links:
                linked[0] += len(" ".join(held[-1].split()))
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            elif opened[tag]:
                if tag not in INLINE or opened_marked[tag]:
                    end()
                while stack and pop() != tag:
                    pass
            elif tag == "p":
                end()
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
            if not m[0].endswith("/>"):
                at = close.end() if close else size
            if tag in ("title", "select"):
                end()
            continue
        if tag == "a":
            links += 1
        elif tag == "br":
            held.append(" ")
        elif tag not in INLINE:
            end()
            links = 0
            if tag in VOID:
                continue
            if stack and (stack[-1][0] in CLOSED_BY.get(tag, ()) or (stack[-1][0] in SHORT and not (tag == "button" and stack[-1][0] == "p"))):
                pop()
            push(tag, _boilerplate(tag, m[3], opened["article"] > 0))
        elif tag not in VOID and m[3].strip() and (why := _boilerplate(tag, m[3], False)):  # an inline element that is a notice or advert
            end()
            push(tag, why)
        elif tag not in VOID and opened[tag]:  # inside one, so that its end is not taken for the other's
            push(tag, None)
    if at < size:
        held.append(page[at:])
    end()
    off = _switched_off(marked, articles, found)
    off.append(-1)  # of no mark
    own = {region for _, links_only, mark, region in found if not links_only and off[mark] < 0}
    own -= {-1} | ({i for i, (x, _) in enumerate(articles) if x == "main"} if any(x == "article" for x, _ in articles) else set())
    lines: list[tuple[str, int, bool]] = []
    last = -1
    for text, links_only, mark, region in found:
        if off[mark] < 0:
            lines.append((text, 0 if links_only and region not in own else len(text), region in own))
        elif off[mark] != last and region not in own:
            lines.append(("", 0, False))
        last = off[mark]
    return lines


def text_runs(lengths: list[int], own: list[bool], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """The runs of lines (first, last) that are kept, by the sums of ``window`` successive lengths.

    A run begins where the sum leaves 0 and ends at its dive, where it is 0 again: at ``window`` lines of length 0. It is
    kept if one of its sums reaches ``surge`` (or half of the page's largest, if that is less) or one of its lines is in an
    article's ``own`` element. Runs whose sums next to the gap between them are ``DENSE`` both are one, gap included."""
    upto = [0, *accumulate(lengths)]

    def total(first: int) -> int:
        return upto[max(0, min(len(lengths), first + window))] - upto[max(0, first)]

    runs: list[list[int]] = []  # first, last, largest sum, whether it is an article's own
    for i, n in enumerate(lengths):
        if n:
            if not runs or i - runs[-1][1] > window:
                runs.append([i, i, 0, False])
            run = runs[-1]
            run[1:] = i, max(run[2], *(total(k) for k in range(i - window + 1, i + 1))), run[3] or own[i]
    least = min(surge, max((run[2] for run in runs), default=0) / 2)
    kept: list[tuple[int, int]] = []
    for first, last, most, owned in runs:
        if most >= least or owned:
            if kept and min(total(kept[-1][1] - window + 1), total(first)) >= DENSE:
                first = kept.pop()[0]
            kept.append((first, last))
    return kept


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The text of the runs of lines that ``text_runs`` keeps; boilerplate inside them is left out."""
    lines = lines_of(page or "")
    runs = text_runs([n for _, n, _ in lines], [own for _, _, own in lines], window, surge)
    return "\n\n".join(text for first, last in runs for text, _, _ in lines[first : last + 1] if text)


def _extract(batches):
    for batch in batches:
        yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": (texts := [main_text(h) for h in batch["html"]]), "n_chars": [len(t) for t in texts]})


def extract_main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages``; no shuffle, pages are independent.

    Null or empty html gives the empty text; null ids and urls are kept; repeated rows give repeated results; further
    columns are not read. A page is held whole in one task, as any row is; its time grows in proportion to its length,
    also for markup that is broken or deeply nested."""
    rows = pages.select(F.col("page_id").cast("long").cast("string").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return ids_back(rows.mapInPandas(_extract, "page_id string, url string, text string, n_chars long"), "page_id")
