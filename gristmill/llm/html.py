"""Main text of web pages by tag-path ratios.

A page is read as a sequence of blocks; each has the path of tags (and classes) from
the root.  For every path the length of its texts, their punctuation and the share of
linked text are added up over the page.  A path's ratio is its characters for each
block, times one more than its punctuation marks for each block, times its share of
text that is not linked.  Three steps turn ratios into a selection:

1. Fuse: the ratio is weighted by what the path's tags and names hint at (MAIN_GAIN
   inside a container that the page calls its main one; NOISE_TAG, NOISE_NAME inside
   elements that by tag or name rarely hold main text).  Hints are factors, so a ratio
   that is strong enough overrules them: an article in a box called "widget", a page
   that stands in one form, or text that is not in the page's ``<article>``.
2. Smooth: the page's content container is the deepest path that holds most of the
   fused score.  Inside it a path's score is averaged with the container's (so short
   headings and list items go with the paragraphs around them), outside with nothing.
3. Threshold: paths whose score reaches a share of the page's best are content.  Text
   from elements of the fixed noise lists is only taken if there are NOISE_CHARS of it.

Elements of one path share their fate, wherever on the page they stand.

Defined cases: null and empty html, and pages without content, give the empty text.
Unclosed and misplaced tags are read leniently; a cut-off page is read as far as it
goes.  Character references are decoded once; white space inside a block becomes one
space; ``<br>`` is white space.  Repeated rows are extracted each.  Empty table: no
rows.  Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg math object select".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
#: A start tag closes an open element of these, up to one of the bounds.
CLOSES = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table", "thead", "tbody", "tfoot")), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
# Tags, and words of classes, ids and roles, that rarely hold main text, or mostly do.
NOISE_TAGS = frozenset("nav header footer aside form button input dialog menu head".split())
NOISE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments comment-list commentlist cookie cookies consent disqus footer header login menu modal nav navbar navigation newsletter notice pagination popup promo promoted related replies respond share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget contentinfo complementary alert".split()
)
MAIN_TAGS = frozenset(("article", "main"))
MAIN_NAMES = frozenset(("main", "article", "article-body", "articlebody", "entry-content", "post-content"))

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*')*+[^>]*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)""", re.S)
NAMED = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。、，！？؟¿¡]")
#: Factors of the hints.
MAIN_GAIN, NOISE_TAG, NOISE_NAME = 2.0, 0.05, 0.15
#: Share of the fused score that the content container holds, share of the best score that a path needs.
HELD, THRESHOLD = 0.8, 0.25
#: Least characters of main text from noisy elements.
NOISE_CHARS = 200

Path = tuple[str, ...]


def blocks(html: str) -> Iterator[tuple[Path, float, list[str], int]]:
    """(path, factor of its hints, pieces of text, linked characters) of each block in order."""
    # Open elements: (tag, path, factor of the noise around, in main).
    stack: list[tuple[str, Path, float, bool]] = [("", (), 1.0, False)]
    text: list[str] = []
    links = linked = 0
    at = 0

    def block() -> tuple[Path, float, list[str], int]:
        depth = len(stack) - 1
        while depth and stack[depth][0] not in BLOCKS:
            depth -= 1
        _, path, noise, main = stack[depth]
        return path, noise * (MAIN_GAIN if main else 1.0), text, linked

    size = len(html)
    while at < size:
        found = TOKEN.search(html, at)
        if not found:
            text.append(html[at:])
            break
        if found.start() > at:
            piece = html[at : found.start()]
            text.append(piece)
            linked += len(piece) if links else 0
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:
            open_at = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
            if tag in BLOCKS and text:
                yield block()
                text, linked = [], 0
            if open_at:
                links -= sum(x[0] == "a" for x in stack[open_at:])
                del stack[open_at:]
            continue
        if tag == "br" or tag == "wbr":
            text.append(" " if tag == "br" else "")
            continue
        if tag in BLOCKS:
            if text:
                yield block()
                text, linked = [], 0
            shut = CLOSES.get(tag)
            close = None
            if shut:
                close = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] in shut[0] or stack[i][0] in shut[1]), None)
                close = close if close and stack[close][0] in shut[0] else None
            if close is None:
                # an open paragraph ends where a block starts
                close = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == "p" or stack[i][0] in BLOCKS), None)
                close = close if close and stack[close][0] == "p" else None
            if close:
                links -= sum(x[0] == "a" for x in stack[close:])
                del stack[close:]
        if tag in VOID or found[3].endswith("/") and tag not in BLOCKS:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)|\Z", re.I).search(html, at)
            at = end.end()
            continue
        names = [w for m in NAMED.finditer(found[3]) for w in (m[2] or m[3] or m[4] or "").lower().split()]
        _, path, noise, main = stack[-1]
        noise *= NOISE_TAG if tag in NOISE_TAGS else NOISE_NAME if NOISE_NAMES.intersection(names) else 1.0
        main = main or tag in MAIN_TAGS or not MAIN_NAMES.isdisjoint(names)
        stack.append((tag, (*path, ".".join([tag, *names])) if tag in BLOCKS else path, noise, main))
        links += tag == "a"
    if text:
        yield block()


@dataclass
class Sums:
    """What a path's blocks add up to."""

    hint: float
    chars: int = 0
    marks: int = 0
    linked: int = 0
    many: int = 0

    def ratio(self) -> float:
        return self.chars / self.many * (1 + self.marks / self.many) * (1 - self.linked / self.chars)


def extract(html: str | None) -> str:
    """The main text of one page."""
    rows: list[tuple[Path, str]] = []
    sums: dict[Path, Sums] = {}
    for path, hint, pieces, linked in blocks(html or ""):
        text = " ".join(unescape("".join(pieces)).split())
        if not text:
            continue
        rows.append((path, text))
        held = sums.setdefault(path, Sums(hint))
        held.hint = max(held.hint, hint)  # inline elements' hints may differ
        held.chars += len(text)
        held.marks += len(PUNCTUATION.findall(text))
        held.linked += min(linked, len(text))
        held.many += 1
    chosen = content_paths(sums)
    return "\n".join(text for path, text in rows if path in chosen)


def container(sums: dict[Path, Sums], fused: dict[Path, float]) -> Path:
    """The deepest path that holds HELD of the fused score of all blocks."""
    mass: dict[Path, float] = defaultdict(float)
    for path, score in fused.items():
        for depth in range(len(path)):  # proper prefixes: a container has blocks in it
            mass[path[:depth]] += score * sums[path].many
    whole = mass.get((), 0.0)
    return max((p for p, m in mass.items() if m >= HELD * whole), key=len, default=())


def content_paths(sums: dict[Path, Sums]) -> set[Path]:
    """The paths whose smoothed score reaches the threshold."""
    ratio = {path: held.ratio() for path, held in sums.items()}
    fused = {path: ratio[path] * held.hint for path, held in sums.items()}
    around = container(sums, fused)
    inside = {path for path in sums if path[: len(around)] == around and (len(path) > len(around) or not around)}
    chars = sum(sums[p].chars for p in inside)
    mean = sum(ratio[p] * sums[p].chars for p in inside) / chars if chars else 0.0
    score = {p: (fused[p] + (held.hint * mean * (1 - held.linked / held.chars) if p in inside else 0)) / 2 for p, held in sums.items()}
    best = max(score.values(), default=0.0)
    chosen = {p for p, x in score.items() if x > 0 and x >= THRESHOLD * best}
    noisy = {p for p in chosen if sums[p].hint < 1}
    return chosen - noisy if sum(sums[p].chars for p in noisy) < NOISE_CHARS else chosen


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string").select("page_id", "url", F.col("text"), F.length("text").cast("long").alias("n_chars"))
