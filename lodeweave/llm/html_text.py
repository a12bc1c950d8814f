"""Main text of web pages by tag-path ratios.

A page is a sequence of text blocks, each with the path of block-level elements from the root to it. For every path
the length of its text and its punctuation are added up over the page and divided by its number of blocks. The ratios
are fused (multiplied), smoothed along the page with a Gaussian window, and weighed down (``OTHER_WEIGHT``) for each element
around the block that the page itself names as something else (a menu, footer, form, advert, ...); blocks over the standard
deviation of these scores are content. The innermost element that holds nearly all of their text (an ``<article>`` or
``<main>`` before others that do) is the article, whose short paragraphs stay too, but not what is named as something
else inside it.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.llm.text import slices

#: Half-width of the smoothing window, in blocks.
RADIUS = 2
#: Weight of what is named as something else.
OTHER_WEIGHT = 0.05
#: An attribute's value is quoted or runs up to a blank; quotes elsewhere are characters like others.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*+(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*+)?+|[^>=]++)*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")

RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "html", "legend", "li",
    "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
PARAGRAPHS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li"}
#: What an opening tag ends implicitly.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Where an implicit end stops.
SCOPE = {"ul", "ol", "dl", "table", "article", "section", "div", "body"}
OTHER_TAGS = {"nav", "footer", "aside", "form", "head", "button", "select", "dialog", "menu", "svg", "object", "canvas", "header"}
OTHER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "form", "menu", "menubar"}
#: Names that mark any element, and further ones that mark only what holds others: a paragraph of that name may be about it.
_ADVERT_NAMES = r"ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo(?:tion)?s?|cookies?|consent|gdpr|popup|modal|overlay"
_HOLDER_NAMES = (
    r"banner|notices?|alert|nav|navbar|navigation|menu|breadcrumbs?|sidebar|widgets?|related(?=$|\s|[_-](?:posts?|articles?|links?|stories|news|content|items?|list|box|block|reading))|recommended|share|sharing|social|"
    r"subscribe|newsletter|signup|login|footer|foot|copyright|masthead|site-?header|page-?header|topbar|toolbar|pagination|pager|tags|comments?|respond|responses?|replies|disqus|reviews"
)
_OTHER_NAMES = {
    True: re.compile(rf"(?:^|[\s_-])(?:{_ADVERT_NAMES})(?:$|[\s_-])", re.I),
    False: re.compile(rf"(?:^|[\s_-])(?:{_ADVERT_NAMES}|{_HOLDER_NAMES})(?:$|[\s_-])", re.I),
}


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(text)}


def _is_other(tag: str, attributes: str) -> bool:
    """Whether an element is named as something else than content."""
    if tag in OTHER_TAGS:
        return True
    if not attributes or tag in ("html", "body", "main", "article"):
        return False
    found = _attributes(attributes)
    names = f"{found.get('class', '')} {found.get('id', '')}"
    return found.get("role", "").lower() in OTHER_ROLES or "hidden" in attributes.lower().split() or found.get("aria-hidden") == "true" or bool(_OTHER_NAMES[tag in PARAGRAPHS].search(names))


class Page:
    """The elements of a page by number (``parent`` of each, how many around it are ``other``, its ``path``) and its blocks of text."""

    def __init__(self, page: str) -> None:
        self.tag, self.parent, self.other, self.path = ["html"], [-1], [0], [0]
        self.texts: list[str] = []
        self.places: list[int] = []  # the element that each text stands in
        self._paths: dict[tuple[int, str], int] = {}
        self._parse(page)

    def _element(self, tag: str, parent: int, other: bool) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.other.append(self.other[parent] + other)
        self.path.append(self._paths.setdefault((self.path[parent], tag), len(self._paths) + 1))
        return len(self.tag) - 1

    def _parse(self, page: str) -> None:
        stack = [0]  # open block elements
        opened: defaultdict[str, list[int]] = defaultdict(list)  # their depths by tag
        inline: list[tuple[str, int]] = []  # open inline elements that are something else, with the depth of the stack
        within: Counter[str] = Counter()  # those by tag
        held: list[str] = []
        articles = 0  # open ones

        def flush() -> None:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                self.texts.append(text)
                self.places.append(stack[-1])

        def leave() -> None:
            within[inline.pop()[0]] -= 1

        def pop(depth: int) -> None:
            nonlocal articles
            for element in stack[depth:]:
                opened[self.tag[element]].pop()
                articles -= self.tag[element] == "article"
            del stack[depth:]
            while inline and inline[-1][1] > depth:
                leave()

        def end(tags: set[str], scope: set[str]) -> None:
            """Close the innermost open element of these tags, unless the scope ends before it."""
            depth = max((opened[t][-1] for t in tags if opened[t]), default=0)
            if depth and all(opened[t][-1] <= depth for t in scope if opened[t]):
                pop(depth)

        at, size, last, last_section = 0, len(page), page.rfind(">"), page.rfind("]]>")
        while at < size:
            m = _TOKEN.search(page, at) if at <= last or page.find("<!--", at) >= 0 else None
            if not m:
                if not inline:
                    held.append(page[at:])
                break
            if m.start() > at and not inline:
                held.append(page[at : m.start()])
            at = m.end()
            if m[2] is None:
                if m[0] == "<![CDATA[":  # a section, or if it has no end just a wrong comment
                    over = page.find("]]>", at) if at <= last_section else -1
                    at = over + 3 if over >= 0 else page.find(">", at) + 1 or size
                continue
            tag, closing, attributes = m[2].lower(), bool(m[1]), m[3] or ""
            if tag in RAW and not closing:
                over = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = over.end() if over else size
                continue
            if tag not in BLOCK:
                if tag == "br":
                    held.append(" ")
                elif closing:
                    while within[tag]:
                        over = inline[-1][0] == tag
                        leave()
                        if over:
                            break
                elif tag not in VOID and not attributes.rstrip().endswith("/") and _is_other(tag, attributes):
                    inline.append((tag, len(stack)))
                    within[tag] += 1
                continue
            flush()
            if closing:
                end({tag}, set())
                continue
            if self.tag[stack[-1]] == "p" and len(stack) > 1:  # any block ends a paragraph
                pop(len(stack) - 1)
            if tag in CLOSES:
                end(CLOSES[tag], SCOPE)
            own = _is_other(tag, attributes) and not (tag == "header" and articles)  # an article's own heading
            stack.append(self._element(tag, stack[-1], own))
            opened[tag].append(len(stack) - 1)
            articles += tag == "article"
        flush()


def _smooth(x: np.ndarray) -> np.ndarray:
    sigma = max(1.0, RADIUS / 2)
    kernel = np.exp(-(np.arange(-RADIUS, RADIUS + 1) ** 2) / (2 * sigma**2))
    return np.convolve(np.pad(x, RADIUS, mode="edge"), kernel / kernel.sum(), "valid")


def path_scores(page: Page) -> np.ndarray:
    """Each block's score: the fused ratios of its tag path, smoothed along the page, less for what is named as something else."""
    places = np.array(page.places)
    path, other = np.array(page.path)[places], np.array(page.other)[places]
    length, marks = np.array([len(t) for t in page.texts], float), np.array([len(_PUNCTUATION.findall(t)) for t in page.texts], float)
    count = np.maximum(np.bincount(path), 1)
    ratio = np.bincount(path, length) / count * (1 + np.bincount(path, marks) / count)
    return _smooth(ratio[path]) * OTHER_WEIGHT ** np.minimum(other, 2)


def main_text(text: str | None) -> str:
    """The article of a page, one line for each block; empty if there is none."""
    page = Page(text or "")
    if not page.texts:
        return ""
    score = path_scores(page)
    content = score >= min(float(score.std()), float(score.max()))
    held = [0] * len(page.tag)  # content text in each element, summed up from the leaves
    depth = [0] * len(page.tag)
    for place, block, yes in zip(page.places, page.texts, content.tolist(), strict=True):
        held[place] += len(block) * yes
    for e in range(len(page.tag) - 1, 0, -1):
        held[page.parent[e]] += held[e]
    for e in range(1, len(page.tag)):
        depth[e] = depth[page.parent[e]] + 1
    # of the elements with nearly all content text the innermost article or main, else the innermost; a paragraph counts as part of its parent
    rich = [e for e, n in enumerate(held) if n >= 0.8 * held[0] and page.tag[e] not in PARAGRAPHS]
    best = max(rich, key=lambda e: (page.tag[e] in ("article", "main"), depth[e]))
    inside = [e == best for e in range(len(page.tag))]
    for e in range(best + 1, len(page.tag)):
        inside[e] = inside[page.parent[e]]
    level = page.other[best]
    # beside the article only what stands in an element around it, or in one next to it, by no other name: a lead, a section; what is nested deeper may be comments or teasers
    around = {best}
    while page.parent[best] >= 0:
        best = page.parent[best]
        around.add(best)

    def beside(e: int) -> bool:
        named = page.other[e]
        while page.tag[e] in PARAGRAPHS and page.parent[e] >= 0:
            e = page.parent[e]
        e = e if e in around else page.parent[e]
        return e in around and page.other[e] == named

    kept = [inside[place] and (yes or page.other[place] == level) or yes and beside(place) for place, yes in zip(page.places, content.tolist(), strict=True)]
    return "\n".join(t for t, yes in zip(page.texts, kept, strict=True) if yes)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for each row of ``pages``; a null or empty page has an empty text, repeated rows are repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [main_text(page) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
