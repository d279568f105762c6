"""Main text of a web page by scoring the tree of its elements.

Every paragraph passes points for its length and its commas to the elements around it: in full to the nearest, half to
the next, less further out. The sum of an element is discounted by the share of its text that is link text. The article
or main part around the best element is kept, with those of its siblings that score well or read like text; on a page
without one, all but the lists of links around the best element. Elements that are never part of an article (navigation,
scripts, notices, adverts, comments ...) are cut from the tree first; those only their name or a form speaks against are
not cut if they hold the article, nor inside one if the name says something else as well. Reader comments, by name or by
heading, never count as the article, however long they are. All steps go over the tree a fixed number of times.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motorpool.llm.common import per_text

TAG = re.compile(
    r"<(?:!--(?:.*?-->|.*)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|(/?)([a-zA-Z][^\s/>]*)([^>]*+)>|[!?/][^>]*+>)",
    re.S,
)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Their content is no markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset(
    "script style noscript template iframe svg math canvas object embed button input select textarea nav footer aside menu"
    " dialog head title audio video map datalist fieldset noembed noframes".split()
)
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
# An opening tag of the key ends an open element of the values, unless one of the fences lies between.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
CLOSES |= {"option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
ENDS_PARAGRAPH = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
FENCES = frozenset("table ul ol dl div article section body html aside main nav form".split())
UNLIKELY = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus"
    " footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices outbrain overlay pager"
    " pagination paywall popup promo promotion related reply replies respond rss share sharing sidebar signup skip"
    " social sponsor sponsored sponsors subscribe subscription taboola toolbar widget widgets".split()
)
UNLIKELY_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split()
)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
# Points an element starts with.
START = {"article": 25.0, "main": 20.0, "section": 4.0, "div": 5.0, "pre": 3.0, "td": 3.0, "blockquote": 3.0}
START |= dict.fromkeys(("address", "ol", "ul", "dl", "dd", "dt", "li"), -3.0)
START |= dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6", "th"), -5.0)
ARTICLES = frozenset(("article", "main"))
# How much the name of an element speaks against it: a word among others, or nothing else; or it holds comments.
PARTLY, WHOLLY, COMMENTS = 1, 2, 3
# Words of a name that say nothing about what an element holds.
NEUTRAL = frozenset(
    "area bar block bottom box button buttons col column container group holder icon icons inner item items left link links"
    " list module outer panel region right row section slot top unit wrap wrapper zone".split()
)
REMARKS = frozenset("comment comments disqus replies respond".split())
# A name that ends so tells what may be done with comments, not that they are here.
SETTINGS = frozenset("open closed enabled disabled allowed on off count".split())
REMARKS_HEADING = re.compile(r"(?:\d[\d,. ]*)?(?:(?:reader|user|all|your) )?comments?(?: ?\(\d+\))?:?", re.I)
MAY_HEAD_REMARKS = re.compile(r"comment[^<]{0,20}</h[1-6]", re.I)
# How far a paragraph passes points.
LEVELS = 8
HEADINGS = frozenset(("h1", "h2", "h3"))
HEADS = HEADINGS | {"h4", "h5", "h6"}
# What a heading can mark as comments.
REMARK_PARTS = frozenset("div section aside ol ul".split())


class Element:
    __slots__ = ("tag", "parent", "parts", "dropped", "doubt", "score", "text", "links", "block")

    def __init__(self, tag: str, parent: Element | None, dropped: bool, doubt: int = 0) -> None:
        self.tag, self.parent, self.dropped, self.doubt = tag, parent, dropped, doubt
        self.parts: list[Element | str] = []
        self.score: float | None = None
        self.text = self.links = 0
        # The nearest block element, itself included.
        self.block: Element = self if tag in BLOCK or parent is None else parent.block


def elements(root: Element) -> list[Element]:
    """All elements, each after its parent, in page order."""
    found, stack = [], [root]
    while stack:
        node = stack.pop()
        found.append(node)
        stack += [part for part in reversed(node.parts) if not isinstance(part, str)]
    return found


def _unwanted(tag: str, attributes: str, inside: set[str]) -> bool:
    if tag in DROPPED:
        return True
    if tag == "header" and not inside & {"article", "main"}:
        return True
    if not attributes or tag in ("html", "body"):
        return False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "role" and value.lower() in UNLIKELY_ROLES and (tag, value.lower()) != ("form", "form"):
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def _remarks(tag: str, name: str) -> bool:
    """Whether a class or id says that reader comments are here; an article has to be called nothing else."""
    told = [[w.lower() for w in WORD.findall(token)] for token in name.split()]
    about = [bool(REMARKS.intersection(words)) and words[-1] not in SETTINGS for words in told]
    return any(about) and (all(about) or tag not in ARTICLES)


def _doubt(tag: str, attributes: str) -> int:
    doubt = PARTLY if tag == "form" else 0
    if not attributes or tag in ("html", "body"):
        return doubt
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id"):
            words = [w.lower() for w in WORD.findall(a or b or c)]
            if UNLIKELY.isdisjoint(words):
                continue
            wholly = all(w in UNLIKELY or w in NEUTRAL for w in words)
            doubt = max(doubt, COMMENTS if _remarks(tag, a or b or c) else WHOLLY if wholly else PARTLY)
    return doubt


def parse(page: str) -> Element:
    """The tree of a page; never fails, whatever the markup."""
    root = Element("html", None, False)
    at, here, length = 0, root, len(page)
    open_tags: dict[str, int] = {}
    doubtful = MAY_HEAD_REMARKS.search(page) is not None

    def close(until: Element) -> None:
        nonlocal here
        while True:
            open_tags[here.tag] -= 1
            done, here = here is until, here.parent
            if done:
                return

    def nearest(tags: frozenset[str] | set[str], fences: frozenset[str]) -> Element | None:
        if not any(open_tags.get(t) for t in tags):
            return None
        node = here
        while node is not root:
            if node.tag in tags:
                return node
            if node.tag in fences:
                return None
            node = node.parent
        return None

    while at < length:
        m = TAG.search(page, at)
        if m is None:
            here.parts.append(page[at:])
            break
        if m.start() > at:
            here.parts.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            found = nearest({tag}, frozenset(("td", "th")) if tag not in FENCES else frozenset())
            if found is not None:
                close(found)
            continue
        if tag in ("html", "body"):
            continue
        attributes = m[3] or m[6] or ""
        if tag in ENDS_PARAGRAPH and open_tags.get("p"):
            paragraph = nearest({"p"}, FENCES | {"td", "th", "button"})
            if paragraph is not None:
                close(paragraph)
        if tag in CLOSES:
            found = nearest(CLOSES[tag], FENCES)
            while found is not None:
                close(found)
                found = nearest(CLOSES[tag], FENCES)
        inside = {t for t in ("article", "main") if open_tags.get(t)}
        node = Element(tag, here, here.dropped or _unwanted(tag, attributes, inside), _doubt(tag, attributes))
        here.parts.append(node)
        doubtful = doubtful or bool(node.doubt) and not node.dropped
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            node.parts.append(page[at : end.start() if end else length])
            at = end.end() if end else length
            continue
        if attributes.rstrip().endswith("/") and tag not in BLOCK:
            continue
        here = node
        open_tags[tag] = open_tags.get(tag, 0) + 1
    if doubtful:
        _settle(root)
    return root


def _above(node: Element) -> Iterator[Element]:
    while node.parent is not None:
        node = node.parent
        yield node


def _settle(root: Element) -> None:
    """Cut the doubtful elements, but for those that hold the article.

    These are or contain an article or main part that nothing speaks against, or hold most of the points of a page that
    has no such part elsewhere. What has no other name than an unlikely one has to be the only one, or hold nearly all.
    Inside an article only such a name cuts. Comments stay only around the only article there is.
    """
    points: dict[Element, float] = {}
    begun = {root}
    for text, node, _ in blocks(root):
        points[node] = points.get(node, 0.0) + _points(text)
        outer = node.parent
        if node.tag in HEADS and outer not in begun and outer.tag in REMARK_PARTS and REMARKS_HEADING.fullmatch(text):
            outer.doubt = COMMENTS
        while node is not None and node not in begun:
            begun.add(node)
            node = node.parent
    every = elements(root)
    holder: set[Element] = set()
    for e in reversed(every):
        if e.parent is None:
            continue
        if e in points:
            points[e.parent] = points.get(e.parent, 0.0) + points[e]
        if _is_article(e, points) and not e.doubt or e in holder and e.doubt < WHOLLY:
            holder.add(e.parent)
    total = points.get(root, 0.0) or 1.0
    # For every element its nearest doubtful one above, and the articles (all, undoubted) with each as the nearest.
    nearest: dict[Element, Element | None] = {root: None}
    held: dict[Element | None, list[int]] = {None: [0, 0]}
    for e in every[1:]:
        nearest[e] = e.parent if e.parent.doubt else nearest[e.parent]
        if _is_article(e, points):
            counts = held.setdefault(nearest[e], [0, 0])
            counts[0] += 1
            counts[1] += not e.doubt
    # Seen from an element: the articles that no doubtful element hides but those around it, and those around it.
    seen: dict[Element, tuple[list[int], list[int]]] = {root: (held[None], [0, 0])}
    for e in every[1:]:
        shown, around = seen[e.parent]
        article = _is_article(e, points)
        own = [article, article and not e.doubt]
        if e.doubt and not e.dropped and not e.parent.dropped:
            kind = 0 if e.doubt >= WHOLLY else 1
            elsewhere = shown[kind] - around[kind] - own[kind] > 0
            holds = e.tag in ARTICLES or e in holder
            share = points.get(e, 0.0) / total
            if e.doubt == COMMENTS:
                kept = e in holder and not elsewhere
            elif e.doubt == WHOLLY:
                kept = not elsewhere and (holds or share > 0.9)
            elif around[0] and e.tag != "form":
                kept = True
            else:
                kept = holds or share > 0.5 and not elsewhere
            e.dropped = not kept
        e.dropped = e.dropped or e.parent.dropped
        below = held.get(e, (0, 0)) if e.doubt else (0, 0)
        seen[e] = ([x + y for x, y in zip(shown, below)], [x + y for x, y in zip(around, own)])


def _is_article(e: Element, points: dict[Element, float]) -> bool:
    return e.tag in ARTICLES and e.doubt < WHOLLY and points.get(e, 0.0) > 0


def blocks(root: Element) -> Iterator[tuple[str, Element, int]]:
    """Paragraphs in page order: (text, element that holds it, characters of it inside links)."""
    parts: list[str] = []
    linked = 0
    # (element, next part, inside a link); a block element ends the paragraph before and after itself.
    stack: list[list] = [[root, 0, False]]

    def flush() -> tuple[str, int] | None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        n, linked = linked, 0
        return (text, min(n, len(text))) if text else None

    while stack:
        node, i, link = frame = stack[-1]
        if i == len(node.parts):
            if node.tag in BLOCK and (got := flush()):
                yield got[0], node, got[1]
            stack.pop()
            continue
        frame[1] += 1
        part = node.parts[i]
        if isinstance(part, str):
            parts.append(part)
            if link:
                linked += len(part.strip())
        elif part.dropped:
            if part.tag in BLOCK and (got := flush()):
                yield got[0], node.block, got[1]
        elif part.tag == "br":
            parts.append("\n")
        elif part.tag in BLOCK:
            if got := flush():
                yield got[0], node.block, got[1]
            stack.append([part, 0, link])
        elif part.tag not in VOID:
            stack.append([part, 0, link or part.tag == "a"])


def _points(text: str) -> float:
    return min(1.0, len(text) / 25) + text.count(",") + min(len(text) / 100, 3.0)


def main_text(page: str) -> str:
    """The paragraphs of the article, joined by empty lines; an empty text if the page has none.

    Of containers that score alike the first in the page is best. A page that is plain text is its own article.
    """
    root = parse(page)
    paragraphs = list(blocks(root))
    candidates: dict[int, Element] = {}
    for text, node, linked in paragraphs:
        points = _points(text) * (0.25 if node.tag in ("li", "td", "th") else 1.0)
        up, level = node if node.tag in ("div", "article", "section", "main", "html", "td") else node.parent or node, 0
        while up is not None and level < LEVELS:
            if up.score is None:
                up.score = START.get(up.tag, 0.0)
                candidates[id(up)] = up
            up.score += points / (1, 2)[level] if level < 2 else points / (level * 3)
            up, level = up.parent, level + 1
        node.text += len(text)
        node.links += linked
    if not candidates:
        return ""
    every = elements(root)
    for e in reversed(every[1:]):
        e.parent.text += e.text
        e.parent.links += e.links

    def value(e: Element) -> float:
        return (e.score or 0.0) * (1 - e.links / max(e.text, 1))

    best = max(candidates.values(), key=value)
    path = [best, *_above(best)]
    whole = [e for e in path if e.tag == "article"] or [e for e in path if e.tag == "main"] or path
    scope = whole[-1]
    kept, linked_lists = {id(scope)}, set()
    if scope.parent is None:
        for node, outer in zip(path, path[1:]):
            for sibling in outer.parts:
                if not isinstance(sibling, str) and sibling is not node and sibling.links >= 0.5 * sibling.text > 0:
                    linked_lists.add(id(sibling))
    else:
        least = max(10.0, 0.2 * value(best))
        for sibling in scope.parent.parts:
            if isinstance(sibling, str) or sibling.dropped or not sibling.text:
                continue
            density = sibling.links / sibling.text
            reads = sibling.tag == "p" and density < 0.25 or sibling.tag in HEADINGS and density < 0.25
            if reads or sibling.score is not None and value(sibling) >= least:
                kept.add(id(sibling))

    inside: dict[Element, bool] = {}
    for e in every:
        within = e.parent is not None and inside[e.parent]
        inside[e] = id(e) not in linked_lists and (id(e) in kept or within)
    return "\n\n".join(text for text, node, _ in paragraphs if inside[node])


def extract(pages: DataFrame, *, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """``key``, ``url``, ``text`` and ``n_chars`` of every page.

    A null or empty page gives the empty text. Null urls and repeated rows are kept as they are; no rows give no rows.
    Each page is handled by itself, in memory in proportion to its length.
    """

    def build():
        def row(t: str) -> tuple:
            text = main_text(t)
            return text, len(text)

        return row

    named = pages.select(F.struct(F.col(key).alias("key"), F.col(url).alias("url")).alias("id"), F.col(page).alias("html"))
    found = per_text(named, "id", "html", "text string, n_chars long", build)
    return found.select(F.col("id.key").alias(key), F.col("id.url").alias(url), "text", "n_chars")
