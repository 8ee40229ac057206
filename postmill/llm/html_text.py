"""Main text of web pages: flat text blocks, judged by a small decision tree.

A page is cut into flat blocks at block-level tags. Elements and plain names for menus, headers, footers, sidebars,
notices, adverts, forms and reader comments are left out; of all other blocks a decision tree, trained on the small
labelled table below, judges the word count and link density of the block and of its neighbours, whether it is a heading,
and its place: on a page without a marked article, inside one, or beside one.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.scratch import small_batches

#: Elements whose content is never text, and elements that begin or end a block.
SILENT = frozenset("script style noscript template svg iframe canvas head select option datalist textarea button audio video map".split())
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul xmp".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Regions that hold no main text, by element, and of other blocks by a word of class, id or role; and regions that do.
OUTSIDE = frozenset("nav aside footer form menu dialog".split())
OUTSIDE_WORDS = frozenset("ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies consent disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices overlay pagination popup promo sidebar signup sponsored subscribe toast".split())
INSIDE = frozenset("article main".split())
INSIDE_WORDS = frozenset("article content entry main post story".split())
#: Elements that a word of INSIDE_WORDS makes a main region; a heading, figure or inline element is none.
CONTAINERS = frozenset("article center div main section table tbody td tr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Places of a block: on a page without an article, inside the article, beside it.
ALONE, WITHIN, BESIDE = 0, 1, 2
#: Labelled blocks: place, heading, words, link density, words and link density of the block before, of the block after,
#: the block's number of links; then 1 for main text. First the neighbours that stand for none, a link, a line and a paragraph.
_NEAR = [(0, 0.0), (1, 1.0), (9, 0.0), (70, 0.0)]
_PAIRS = [(before, after) for before in _NEAR for after in _NEAR]
_LINKS = [((1, 1.0), (1, 1.0))]
#: Where there is no article, short blocks among links are no text, others are.
_ALONE = [
    (0, 3, 0.0, 0, 0.0, 0, 0.0, 1), (0, 12, 0.0, 0, 0.0, 0, 0.0, 1), (0, 80, 0.0, 0, 0.0, 0, 0.0, 1), (0, 80, 0.1, 1, 1.0, 1, 1.0, 1),
    (0, 25, 0.0, 1, 1.0, 9, 0.0, 1), (0, 25, 0.0, 9, 0.0, 1, 1.0, 1), (0, 25, 0.2, 70, 0.0, 70, 0.0, 1), (0, 4, 0.0, 70, 0.0, 70, 0.0, 1),
    (0, 4, 0.0, 9, 0.0, 70, 0.0, 1), (0, 4, 0.0, 70, 0.0, 9, 0.0, 1), (1, 5, 0.0, 1, 1.0, 70, 0.0, 1), (1, 5, 0.0, 70, 0.0, 70, 0.0, 1),
    (0, 4, 0.0, 1, 1.0, 1, 1.0, 0), (0, 9, 0.0, 1, 1.0, 1, 1.0, 0), (0, 4, 0.0, 0, 0.0, 1, 1.0, 0), (0, 4, 0.0, 1, 1.0, 0, 0.0, 0),
    (0, 1, 1.0, 0, 0.0, 1, 1.0, 0), (0, 1, 1.0, 1, 1.0, 1, 1.0, 0), (0, 3, 1.0, 70, 0.0, 70, 0.0, 0), (0, 12, 0.7, 1, 1.0, 9, 0.0, 0),
    (0, 30, 0.6, 9, 0.0, 9, 0.0, 0), (1, 3, 1.0, 1, 1.0, 1, 1.0, 0), (0, 60, 0.8, 70, 0.0, 1, 1.0, 0), (0, 9, 0.5, 70, 0.0, 9, 0.0, 0),
]
_LINKED = [(heading, words, dense, *before, *after, 0) for heading, words, dense in ((0, 2, 1.0), (0, 6, 1.0), (0, 30, 0.6), (0, 60, 0.8), (1, 6, 1.0)) for before, after in _PAIRS]
#: Inside the article text is text, linked headings and longer linked lines too; runs of links are not.
_WITHIN = [
    *((heading, words, dense, *before, *after, 1) for heading in (0, 1) for words, dense in ((1, 0.0), (4, 0.0), (12, 0.3), (60, 0.0), (60, 0.5)) for before, after in _PAIRS),
    *((1, words, 1.0, *before, *after, 1) for words in (2, 8) for before, after in _PAIRS),
    *((0, words, 1.0, *before, *after, int((before, after) not in _LINKS)) for words in (8, 30) for before, after in _PAIRS),
]
#: A short line inside the article that is one link is text by itself, none beside another one; one of several links is none.
_SHORT = [(0, words, 1.0, *before, *after, links, int(links == 1 and (1, 1.0) not in (before, after))) for words in (1, 2, 4) for before, after in _PAIRS for links in (1, 2)]
#: Beside an article, long and link-free blocks are text, as are short ones between two long ones and headings before a
#: long one; other short ones and link-dense ones are not.
_BESIDE = [
    *((0, words, dense, *before, *after, 1) for words, dense in ((18, 0.0), (25, 0.1), (60, 0.0), (200, 0.2)) for before, after in zip(_NEAR, _NEAR[::-1])),
    *((0, words, 0.0, *near, *near, 1) for words in (18, 60) for near in _NEAR),
    *((0, words, 0.0, 70, 0.0, 70, 0.0, 1) for words in (2, 6, 12)), *((1, 6, 0.0, *near, 70, 0.0, 1) for near in _NEAR),
    *((0, words, 0.0, *before, *after, 0) for words in (2, 6, 12) for before, after in _PAIRS if before[0] < 70 or after[0] < 70),
    *((1, 6, 0.0, *before, *after, 0) for before in _NEAR for after in _NEAR[:3]),
    *_LINKED,
]
#: The number of links decides nothing but there.
LABELLED = [(place, *row[:-1], links, row[-1]) for place, rows in ((ALONE, _ALONE + _LINKED), (WITHIN, _WITHIN), (BESIDE, _BESIDE)) for row in rows for links in ((1, 2) if row[2] else (0,))]
LABELLED += [(WITHIN, *row) for row in _SHORT]


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = 6):
    """A decision tree by Gini impurity: (feature, cut, low side, high side), or at a leaf the share of label 1."""
    share = labels.mean()
    if depth == 0 or share in (0.0, 1.0):
        return float(share)
    best = (1e-12, 0, 0.0)
    gini = share * (1 - share)
    for j in range(rows.shape[1]):
        values = np.unique(rows[:, j])
        for cut in (values[1:] + values[:-1]) / 2:
            low = rows[:, j] <= cut
            a, b, w = labels[low].mean(), labels[~low].mean(), low.mean()
            gain = gini - w * a * (1 - a) - (1 - w) * b * (1 - b)
            if gain > best[0] + 1e-9:
                best = (gain, j, float(cut))
    if best[0] <= 1e-12:
        return float(share)
    low = rows[:, best[1]] <= best[2]
    return best[1], best[2], grow(rows[low], labels[low], depth - 1), grow(rows[~low], labels[~low], depth - 1)


def decide(tree, row) -> bool:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree >= 0.5


def train(table=LABELLED):
    table = np.array(table, float)
    return grow(table[:, :-1], table[:, -1], 12)


_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|[^>])*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*("[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^\s>]*))?""")
_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*([a-z-]+)\s*(!\s*important)?")
_FORM = re.compile(r"</?form\b", re.I)
_PAGE_PART = re.compile(r"<(?:article|main|nav|header|footer|h1)\b", re.I)
_RAW_END = {name: re.compile(rf"</{name}\b", re.I) for name in RAW}
_IMPLIED = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}


def _attributes(rest: str) -> dict[str, str]:
    """Attributes of a start tag by lower-case name; of a repeated one the first, as in browsers."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(rest):
        value = m[2] or ""
        out.setdefault(m[1].lower(), value.strip(value[0]) if value[:1] in ("'", '"') else value)
    return out


def _hidden(has: dict[str, str]) -> bool:
    if "hidden" in has or has.get("aria-hidden", "").strip().lower() == "true":
        return True
    shown = _DISPLAY.findall(has.get("style", "").lower())
    shown = [d for d in shown if d[1]] or shown
    return bool(shown) and shown[-1][0] == "none"


def _words(has: dict[str, str]) -> set[str]:
    """Words of class, id and role; those after has-, with-, no- or without- say nothing of the element."""
    out: set[str] = set()
    for name in " ".join(has.get(k, "") for k in ("class", "id", "role")).lower().split():
        for word in re.split(r"[^a-z0-9]+", name):
            if word in ("has", "with", "no", "without"):
                break
            out.add(word)
    return out


def _page_wide(page: str, at: int) -> bool:
    """Whether the form that begins before ``at`` wraps the page: it holds parts of a page, or half of what there is."""
    end = _FORM.search(page, at)
    stop = end.start() if end else len(page)
    return 2 * (stop - at) >= len(page) or bool(_PAGE_PART.search(page, at, stop))


def _region(name: str, has: dict[str, str], now: int) -> int:
    """The region of an element inside region ``now``: 2 outside the main text, 1 main, 0 unknown; 3 outside by a word of its names.

    Region 2 stays so; in region 3 an article or main region that has no such word itself is main again.
    """
    if now == 2 or name in OUTSIDE:
        return 2
    if name == "header" and now != 1:
        return 2
    words = _words(has) if has else set()
    closed = words & OUTSIDE_WORDS - ({"header"} if now == 1 else set())
    if name in INSIDE or has.get("role", "").strip().lower() in INSIDE:
        return 3 if now == 3 and closed else 1
    if now == 3 or name in ("html", "body"):
        return now
    if closed and name in BLOCKS and name not in HEADINGS:
        return 3
    return 1 if words & INSIDE_WORDS and name in CONTAINERS else now


def blocks_of(page: str) -> list[tuple[str, int, int, float, int]]:
    """The page's flat blocks: text (white space folded), region, heading or not, link density, number of links."""
    out: list[tuple[str, int, int, float, int]] = []
    text: list[str] = []
    linked = begun = 0
    stack: list[tuple[str, int, int]] = []  # element, region inside, silent
    opened: Counter[str] = Counter()  # how often each element is on the stack: what is not there is not looked for
    region = silent = links = heading = 0

    def flush():
        nonlocal linked, begun
        if text:
            words = " ".join(entities.unescape("".join(text)).split())
            if words:
                out.append((words, region, heading, min(1.0, linked / max(1, words.count(" ") + 1)), max(begun, int(linked > 0))))
            text.clear()
        linked = begun = 0

    def say(part: str):
        nonlocal linked
        if part and not silent:
            text.append(part)
            if links:
                linked += len(part.split())

    def close(k: int):
        opened.subtract(entry[0] for entry in stack[k:])
        del stack[k:]

    at, size = 0, len(page)
    while at < size:
        found = _TAG.search(page, at)
        if not found:
            say(page[at:])
            break
        say(page[at : found.start()])
        at = found.end()
        if found["cdata"]:
            say(entities.escape(found["cdata"], quote=False))
        name = found["name"]
        if not name:
            continue
        name, rest = name.lower(), found["rest"] or ""
        if name == "br":
            text.append(" ")
        if found["close"]:
            if name in BLOCKS:
                flush()
            if name == "a":
                links = max(0, links - 1)
            for k in range(len(stack) - 1, -1, -1) if opened[name] else ():
                if stack[k][0] == name:
                    close(k)
                    around, silent = (stack[-1][1], stack[-1][2]) if stack else (0, 0)
                    if around != region:
                        flush()
                    region = around
                    break
            if name in HEADINGS:
                heading = 0
            continue
        if name in RAW and not rest.rstrip().endswith("/"):
            end = _RAW_END[name].search(page, at)
            if name == "xmp":  # shown as it is written
                flush()
                say(entities.escape(page[at : end.start() if end else size], quote=False))
                flush()
            after = page.find(">", end.start()) if end else -1
            at = after + 1 if after >= 0 else size
            continue
        if name in EMPTY:
            if name == "hr":
                flush()
            continue
        if name in BLOCKS:
            flush()
            links = 0
            implied = [x for x in _IMPLIED.get(name, ()) if opened[x]]
            for k in range(len(stack) - 1, -1, -1) if implied else ():  # end tags that this start tag implies
                if stack[k][0] in implied:
                    close(k)
                    break
                if stack[k][0] in ("ul", "ol", "dl", "table", "div", "section", "article", "aside", "nav", "main", "body"):
                    break
            region, silent = (stack[-1][1], stack[-1][2]) if stack else (0, 0)
        if name == "a":
            links += 1
            begun += 1
        heading = int(name in HEADINGS) or (heading if name not in BLOCKS else 0)
        has = _attributes(rest) if rest else {}
        inside = region if name == "form" and region != 2 and _page_wide(page, at) else _region(name, has, region)
        hidden = bool(has) and _hidden(has)
        if name in BLOCKS or name in SILENT or inside != region or hidden:
            if inside != region:
                flush()
            silent = int(bool(silent) or name in SILENT or hidden)
            region = inside
            stack.append((name, region, silent))
            opened[name] += 1
    flush()
    return out


def _kept(blocks: list[tuple[str, int, int, float, int]], tree, named: bool) -> list[str]:
    """The blocks that the tree keeps, of those outside the regions left out; with ``named`` those left out by a name, too."""
    blocks = [b for b in blocks if b[1] < (3 if named else 4) and b[1] != 2]
    marked = any(b[1] == 1 for b in blocks)
    words = [0, *(b[0].count(" ") + 1 for b in blocks), 0]
    density = [0.0, *(b[3] for b in blocks), 0.0]
    kept = []
    for k, (text, region, heading, _, links) in enumerate(blocks, 1):
        place = WITHIN if region == 1 else BESIDE if marked else ALONE
        if decide(tree, (place, heading, words[k], density[k], words[k - 1], density[k - 1], words[k + 1], density[k + 1], links)):
            kept.append(text)
    return kept


def main_text(page: str, tree) -> str:
    """The kept blocks in page order, joined by one newline. Names of elements close nothing where no text were left."""
    blocks = blocks_of(page)
    return "\n".join(_kept(blocks, tree, True) or _kept(blocks, tree, False))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tree = train()
    for batch in batches:
        texts = [main_text(page or "", tree) for page in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_pages(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages``.

    A null or empty page has an empty text. Unclosed tags, comments, scripts and character references cut off at the end
    are read as browsers read them; very long pages are read whole. Repeated rows and null ids are extracted like others;
    other columns are not read. An empty table gives an empty table.
    """
    small_batches(spark)
    rows = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    return rows.mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
