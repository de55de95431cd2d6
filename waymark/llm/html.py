"""Main-content extraction by tag-path ratios.

Text nodes are gathered by their root-to-leaf tag path; articles of a page are
told apart.  Each path gets two ratios: characters a node and punctuation marks
a node.  Their fusion, weighed by what the path's tags say (more inside an
article or main element, less inside a block named as an addition, nothing
inside boilerplate), is smoothed over the paths in page order.  Paths at or above a
share of the page's best score are the core.  The innermost element that holds
most of the core holds the content: the core in it, all else that a core article
or a core path's own container holds, and what lies between core paths in their
common container, headings before them included.  A class or id names boilerplate
only as a whole: every part of it is such a word or says what kind of block it is.
The text of content nodes, block by
block in page order, is the page's text.

Defined cases: null and empty html give the empty text; unclosed, crossed and
cut-off tags are taken as browsers do, as far as block structure goes; text
outside any element is of the root path; pages of any length and depth are read
whole; paths of equal score are content together; repeated rows and ids give
rows of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A path is of the core from this share of the page's best score on.
THRESHOLD = 0.25
#: Weights of a path and its neighbours in page order.
SMOOTH = (0.1, 0.8, 0.1)
#: What the tags say: weight inside an article or main element, and inside a block named as an addition.
INSIDE, ADDITION = 3.0, 0.3
#: Share of the core's characters that the common container of a page holds.
COMMON = 0.8
#: An element holds the content, whatever lies beside it, from this share of the core's characters on: all of them at a
#: threshold of 0, where all paths are core, and less the fewer paths a threshold makes core (0.6 at 0.25), never under half.
HOLDS = lambda threshold: max(0.5, 1 - 1.6 * threshold)

# Element names and words of class and id attributes.
RAW = frozenset("script style noscript template svg iframe object textarea title xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul li dd dt".split())
SELF_CLOSING = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "option": ("select",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
_PEERS = {tag: {tag} | ({"dd", "dt"} if tag in ("dd", "dt") else {"td", "th"} if tag in ("td", "th") else set()) for tag in SELF_CLOSING}
BOILERPLATE_TAGS = frozenset("head nav header footer aside form button select menu dialog search fieldset input".split())
BOILERPLATE_ROLES = frozenset("banner contentinfo complementary search form dialog alert".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements adsense banner breadcrumb breadcrumbs comment comments commentlist respond reply replies disqus cookie cookies consent gdpr footer footnav header masthead menu newsletter notice notices pagination pager popup modal promo promos promoted sidebar sidenav skip sponsor sponsored subscribe toolbar topbar login signup".split()
)
# names of blocks that add to a text: they are content only if their own ratios say so
ADDITION_WORDS = frozenset("related recommended share sharing social widget".split())
TEXT_TAGS = INLINE | frozenset("p blockquote pre ul ol li dl dd dt table tbody thead tr td th figure figcaption h1 h2 h3 h4 h5 h6".split())
HEADING_TAGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# a compound name says what an element is if all its parts are such words or say only where or what kind of block it is; headings of content are content
PLACES = frozenset("site page post entry article story blog news main global top bottom left right inner outer primary secondary area bar block body box col column content container group holder inner item items links list panel row section strip widget wrap wrapper zone form title text unit slot".split())
HEADINGS = frozenset("header masthead".split())
CONTENT_TAGS = frozenset("article main".split())

# quotes count only behind '='
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)(?:>|\Z)|([^<]+|<(?![a-zA-Z/!?]))|<", re.S)
_MARKS = re.compile(r"(?:^|\s)(?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_ROLE = re.compile(r"(?:^|\s)role\s*=\s*[\"']?([a-z]+)", re.I)
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?:[\s=]|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?、。，！？…]")


def _is_boilerplate(tag: str, attributes: str) -> bool:
    """Whether the element's name, role or style marks it and all it holds."""
    if tag in BOILERPLATE_TAGS:
        return True
    if not attributes:
        return False
    if (role := _ROLE.search(attributes)) and (role[1].lower() in BOILERPLATE_ROLES or role[1].lower().startswith("nav")):
        return True
    return bool(_HIDDEN.search(attributes))


def _says(word: str) -> bool:
    """Whether a word names boilerplate."""
    return word in BOILERPLATE_WORDS or word.startswith("nav")


def _named(tag: str, attributes: str, content: bool) -> tuple[bool, bool]:
    """Whether a class or id says that an element is boilerplate, and whether it says that it adds to a text."""
    if not attributes or tag in ("html", "body"):
        return False, False
    closes = adds = False
    for name in " ".join(a or b or c for a, b, c in _MARKS.findall(attributes)).lower().split():
        parts = [part for part in re.split("[_-]+", name) if part and not part.isdigit()]
        known = [part for part in parts if _says(part) or part in ADDITION_WORDS]
        if known and all(part in known or part in PLACES for part in parts) and not (content and HEADINGS.issuperset(known)):
            adds = adds or not ADDITION_WORDS.isdisjoint(known)
            closes = closes or any(map(_says, known))
    return closes, adds


@dataclass
class Page:
    """Paths by number: the one around each, its tag, its innermost article or main; and the text nodes in page order."""

    around: list[int]
    tags: list[str]
    homes: list[int]  # the innermost article or main that a path lies in or is, 0 for none
    nodes: list[tuple[int, int, str, bool, int]]  # path, block, text, inside an addition, number of the element that its block of text lies in
    within: list[int]  # of each such element the one around it


def parse(page: str) -> Page:
    """The text nodes of a page outside boilerplate."""
    around, tags, homes = [0], [""], [0]
    number: dict[tuple[int, str], int] = {}
    # an open element: (tag, path, is boilerplate, number of the innermost one around that a class or id closes, is an addition, box)
    stack: list[tuple[str, int, bool, int, bool, int]] = [("", 0, False, 0, False, 0)]
    boxes = [0]
    depth: dict[str, int] = {}  # how many elements of a name are open
    nodes: list[tuple[int, int, str, bool, bool, int, int]] = []
    outer = [0]  # of each closed element the one around it
    opened = [False]  # closed by its name but holds an article
    block = 0
    at, end = 0, len(page)

    def close(k: int) -> None:
        for element in stack[k:]:
            depth[element[0]] -= 1
        del stack[k:]

    while at < end:
        token = _TOKEN.match(page, at)
        at = token.end()
        closing, tag, attributes, text = token.groups()
        if text is not None:
            _, path, boilerplate, closed, added, box = stack[-1]
            nodes.append((path, block, text, boilerplate, added, closed, box))
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if tag not in INLINE:
            block += 1
        if tag == "br":
            _, path, boilerplate, closed, added, box = stack[-1]
            nodes.append((path, block, " ", boilerplate, added, closed, box))
        elif closing:
            if depth.get(tag):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        close(k)
                        break
                    if tag in INLINE and stack[k][0] not in INLINE:
                        break
        elif tag in RAW:
            closes = re.compile(rf"</{re.escape(tag)}\s*>?", re.I).search(page, at)
            at = closes.end() if closes else end
        elif tag not in VOID:
            if tag in CLOSES_P and depth.get("p"):
                k = len(stack) - 1
                while depth["p"]:
                    if stack[k][0] == "p":
                        close(k)
                    k -= 1
            if tag in SELF_CLOSING and any(depth.get(x) for x in _PEERS[tag]):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in SELF_CLOSING[tag]:
                        break
                    if stack[k][0] in _PEERS[tag]:
                        close(k)
                        break
            _, path, boilerplate, closed, added, box = stack[-1]
            content = bool(homes[path])
            boilerplate = boilerplate or (_is_boilerplate(tag, attributes) and not (tag == "header" and content))
            closes, adds = (False, False) if boilerplate else _named(tag, attributes, content)
            added = added or adds
            # an element that is an article has a path of its own
            key = (path, f"{tag} {len(tags)}" if tag == "article" else tag)
            if key not in number:
                number[key] = len(tags)
                around.append(path)
                tags.append(tag)
                homes.append(len(tags) - 1 if tag in CONTENT_TAGS else homes[path])
            if closes and tag not in CONTENT_TAGS:
                outer.append(closed)
                opened.append(False)
                closed = len(outer) - 1
            elif tag in CONTENT_TAGS and not boilerplate:
                wrapper = closed
                while wrapper and not opened[wrapper]:
                    opened[wrapper] = True
                    wrapper = outer[wrapper]
            if tag not in TEXT_TAGS:
                boxes.append(box)
                box = len(boxes) - 1
            stack.append((tag, number[key], boilerplate, closed, added, box))
            depth[tag] = depth.get(tag, 0) + 1
    shut = [False]
    for k in range(1, len(outer)):
        shut.append(shut[outer[k]] or not opened[k])
    return Page(around, tags, homes, [(path, n, entities.unescape(text), added, box) for path, n, text, boilerplate, added, closed, box in nodes if not (boilerplate or shut[closed])], boxes)


def scores(page: Page) -> dict[tuple[int, bool], float]:
    """The fused, weighed and smoothed ratio of each path with text, in page order."""
    sums: dict[tuple[int, bool], list[int]] = {}
    for path, _, text, added, _ in page.nodes:
        if stripped := text.strip():
            entry = sums.setdefault((path, added), [0, 0, 0])
            entry[0] += 1
            entry[1] += len(stripped)
            entry[2] += len(_PUNCTUATION.findall(stripped))
    if not sums:
        return {}
    table = np.array(list(sums.values()), float)
    fused = table[:, 1] / table[:, 0] * (1 + table[:, 2] / table[:, 0])
    says = [(INSIDE if page.homes[path] else 1.0) * (ADDITION if added else 1.0) for path, added in sums]
    wide = np.pad(fused * says, 1, mode="edge")
    smooth = sum(w * wide[k : k + len(fused)] for k, w in enumerate(SMOOTH))
    return dict(zip(sums, smooth.tolist(), strict=True))


def _common(page: Page, size: dict[int, int]) -> int:
    """The deepest path that holds most of the core's characters and is no block of text itself."""
    total = sum(size.values())
    held = dict(size)
    # a path's number is higher than that of the path around it
    for path in range(len(page.tags) - 1, 0, -1):
        if path in held:
            held[page.around[path]] = held.get(page.around[path], 0) + held[path]
    top = max(path for path, n in held.items() if n >= COMMON * total)
    while top and page.tags[top] in TEXT_TAGS:
        top = page.around[top]
    return top


def _holder(page: Page, size: dict[int, int], share: float) -> list[bool]:
    """Which elements lie in the innermost one that holds most of the core's characters."""
    total, held = sum(size.values()), [0] * len(page.within)
    for box in range(len(page.within) - 1, -1, -1):  # an element's number is higher than that of the one around it
        held[box] += size.get(box, 0)
        if box:
            held[page.within[box]] += held[box]
    top = max((box for box, n in enumerate(held) if n >= share * total), default=0)
    inside = [False] * len(page.within)
    for box in range(len(page.within)):
        inside[box] = box == top or (box > 0 and inside[page.within[box]])
    return inside


def content_nodes(page: Page, threshold: float = THRESHOLD) -> list[bool]:
    """Which text nodes are content."""
    score = scores(page)
    best = max(score.values(), default=0.0)
    core = {key for key, s in score.items() if s >= threshold * best}
    in_core = [(path, added) in core for path, _, _, added, _ in page.nodes]
    size: dict[int, int] = {}
    sizes: dict[int, int] = {}
    for (path, _, text, _, box), chosen in zip(page.nodes, in_core, strict=True):
        if chosen:
            size[path] = size.get(path, 0) + len(text.strip())
            sizes[box] = sizes.get(box, 0) + len(text.strip())
    if not core:
        return in_core
    homes = {page.homes[path] for path, _ in core} - {0}
    first = in_core.index(True)
    last = len(in_core) - 1 - in_core[::-1].index(True)
    top, holds = _common(page, size), _holder(page, sizes, HOLDS(threshold))
    under = [False] * len(page.tags)
    heading = [False] * len(page.tags)
    for path in range(len(page.tags)):
        under[path] = path == top or (path > 0 and under[page.around[path]])
        heading[path] = page.tags[path] in HEADING_TAGS or (path > 0 and heading[page.around[path]])
    boxes = {box for (_, _, text, _, box), chosen in zip(page.nodes, in_core, strict=True) if chosen and text.strip()}
    return [
        page.homes[path] in homes and not added or holds[box] and (chosen or (not added and (box in boxes or (under[path] and (first < k < last or (k < first and heading[path]))))))
        for k, ((path, _, _, added, box), chosen) in enumerate(zip(page.nodes, in_core, strict=True))
    ]


def main_text(html: str | None, threshold: float = THRESHOLD) -> str:
    page = parse(html or "")
    blocks: dict[int, list[str]] = {}
    for (_, block, text, _, _), chosen in zip(page.nodes, content_nodes(page, threshold), strict=True):
        if chosen:
            blocks.setdefault(block, []).append(text)
    lines = (" ".join("".join(parts).split()) for _, parts in sorted(blocks.items()))
    return "\n".join(line for line in lines if line)


def _extract(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py(), threshold) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return pages.mapInArrow(_extract(threshold), "page_id long, url string, text string, n_chars long")
