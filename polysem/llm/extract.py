"""Main text of web pages by line-block distribution.

1. Markup is stripped: each block element begins a new line, and boundaries
   without text between them leave none; a line break is white space; scripts,
   styles and other invisible elements leave nothing. An element that is no part of
   an article (menu, header, footer, sidebar, form, advert, notice, comments)
   leaves blank lines, as many as a window and one more; only one where it stands
   between texts of one container (an advert within a story is no dive), or within
   an article. Whole names decide (`NOISE`). Outside an article no element that
   has one within is left out unless it is hidden, and a form with half of
   the page's text only loses its controls. Where `article` or `main` elements hold half of the
   text, lines outside them are blank; where they hold less (teasers), they are like others.
2. The lengths of the lines are summed over sliding windows of `WINDOW` lines.
   A stretch surges where a window passes the threshold and dives where a
   window is empty. The threshold is at most half of the largest window, so a
   page whose article is short has a surge too.
3. The lines of every stretch with a surge, from its first line with text to
   its dive point, are the text. In pages that mark their article, all lines
   there count as within one.

White space inside a line becomes one space, character references are decoded,
lines are joined by one newline. Null html is empty and has an empty text.
Repeated rows give repeated results. Work follows the length of the page.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from polysem.llm.chars import small

WINDOW = 3
THRESHOLD = 86

# Elements of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template iframe noframes textarea title".split())
INVISIBLE = frozenset("head script style noscript template iframe noframes object svg math canvas audio video map".split())
BOILERPLATE = frozenset("nav footer aside form button select option fieldset dialog menu label input textarea".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
ARTICLE = frozenset(("article", "main"))
CLOSED_BY_BLOCK = frozenset(("p", "li", "dt", "dd", "tr", "td", "th", "option"))

# Class names, ids, roles and labels of what is no part of an article. A name counts
# if it is one of these words or ends with one as a part (site-footer), or begins with
# one and ends with a usual part of such an element (cookie-box).
WORD = (
    r"(?:ads?|advert[a-z0-9]*|banner|breadcrumbs?|comments?|consent|contentinfo|cookies?|disqus|footer|gdpr|masthead"
    r"|menu|modal|nav|navbar|navigation|newsletter|notices?|overlay|pagination|popup|promo[a-z0-9]*|related|replies|respond"
    r"|search|share|sharing|sidebar|sidebars|signup|skip|social|sponsor[a-z0-9]*|subscribe|subscription|toolbar|widget)"
)
PART = (
    r"(?:area|bar|body|block|bottom|box|button|buttons|container|content|dialog|form|icons|inner|item|items|label|left|link|links|list"
    r"|message|panel|posts|right|section|slot|text|title|top|unit|\d+)"
)
NOISE = re.compile(rf"(?:[a-z0-9]+[_-]+)*{WORD}(?:[_-]+{PART})*", re.I)
# Names that tell of the layout around such elements.
LAYOUT = re.compile(r"(?:has|no|with|without|hide|show)[_-].*|.*[_-]wrap(?:per)?|(?:content|main)[_-]+sidebars?|sidebars?[_-]+content", re.I)
# Outside an article a heading block is part of the page's frame.
FRAME = re.compile(r"(?:[a-z0-9]+[_-]+)*(?:header|topbar)", re.I)
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*')*+)>""")
BROKEN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
NAMES = re.compile(r"""(?:^|[\s"'/])(class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
SPACE = re.compile(r"\s+")


def markup(page: str) -> Iterator[tuple[str, str, str]]:
    """The parts of a page: ("text", text, ""), ("open", name, attributes) and
    ("close", name, "")."""
    at, last, quoted = 0, page.rfind(">"), True
    while True:
        start = page.find("<", at)
        if start < 0 or start > last:
            yield "text", page[at:], ""
            return
        if start > at:
            yield "text", page[at:start], ""
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = len(page) if end < 0 else end + 3
            if end < 0:
                return
            continue
        after = page[start + 1 : start + 2]
        if after in ("!", "?"):
            at = page.find(">", start) + 1
            continue
        # A quote that is never closed ends with its tag; quotes are not looked
        # for again after that, so work follows the length of the page.
        is_tag = after == "/" or after.isalpha()
        found = TAG.match(page, start) if is_tag and quoted else None
        if is_tag and not found:
            found = BROKEN_TAG.match(page, start)
            quoted = quoted and not found
        if not found:
            yield "text", "<", ""
            at = start + 1
            continue
        name = found[2].lower()
        at = found.end()
        if found[1]:
            yield "close", name, ""
            continue
        yield "open", name, found[3]
        if name in RAW:
            end = re.compile(f"</{name}", re.I).search(page, at)
            if name in ("title", "textarea"):
                yield "text", page[at : end.start() if end else len(page)], ""
            at = end.start() if end else len(page)


def is_noise(name: str, attributes: str, in_article: bool, holds: bool = False) -> bool:
    """Whether an element is no part of an article. `holds`: it has one within."""
    if holds and (not in_article or name == "form"):
        return bool(attributes and HIDDEN.search(attributes) and name not in ("html", "body"))
    if name in BOILERPLATE or (name == "header" and not in_article):
        return True
    if not attributes or name in ("html", "body") or (name in ARTICLE and not in_article):
        return False
    return bool(HIDDEN.search(attributes)) or is_named_noise(attributes, in_article)


def is_named_noise(attributes: str, in_article: bool) -> bool:
    for kind, *values in NAMES.findall(attributes):
        value = "".join(values).strip()
        # A label is one name, however many words it has.
        for n in [SPACE.sub("-", value)] if kind.lower() == "aria-label" else value.split():
            if not LAYOUT.fullmatch(n) and (NOISE.fullmatch(n) or not in_article and FRAME.fullmatch(n)):
                return True
    return False


def holders(parts: list[tuple[str, str, str]]) -> set[int]:
    """Places of the opening tags within which an article is; one that is itself
    named as noise (a comment, say) does not count. Of forms, those with half of the text."""
    found: set[int] = set()
    stack: list[tuple[str, int]] = []
    forms: dict[int, int] = {}  # text before the form, then within it
    invisible = seen = 0

    def closed(name: str, at: int) -> None:
        if name == "form":
            forms[at] = seen - forms[at]

    for at, (kind, name, attributes) in enumerate(parts):
        if kind == "text":
            if not invisible:
                seen += len(name) - name.count(" ")
        elif kind == "open":
            if name in VOID or attributes.endswith("/") and name in INLINE:
                continue
            if name in CLOSED_BY_BLOCK and stack and stack[-1][0] == name:
                closed(*stack.pop())
            if name in ARTICLE and not invisible and not is_named_noise(attributes, True):
                # What is around a holder is one too.
                for _, above in reversed(stack):
                    if above in found:
                        break
                    found.add(above)
            stack.append((name, at))
            if name == "form":
                forms[at] = seen
            invisible += name in INVISIBLE
        elif kind == "close" and any(n == name for n, _ in stack):
            while stack:
                open_name, place = stack.pop()
                closed(open_name, place)
                invisible -= open_name in INVISIBLE
                if open_name == name:
                    break
    for name, place in stack:
        closed(name, place)
    return found | {place for place, size in forms.items() if seen and 2 * size >= seen}


def lines_of(page: str) -> tuple[list[str], bool]:
    """The lines of a stripped page, blank ones included, and whether the page
    marks its article, with half of the text at least."""
    lines: list[str] = []
    inside: list[bool] = []
    part: list[str] = []
    stack: list[tuple[str, str, int]] = []  # with the texts before it
    texts = 0  # lines with text so far
    between: dict[int, list[tuple[int, int]]] = {}  # blank lines within containers, by depth: texts before, place
    wide: set[int] = set()  # places of blank lines after which a container ended
    dropped = 0  # open elements that leave nothing
    depth = 0  # open article elements
    marked = False

    def end_line() -> None:
        nonlocal texts
        text = "".join(part)
        part.clear()
        if "&" in text:
            text = entities.unescape(text)
        text = SPACE.sub(" ", text).strip()
        if text:
            lines.append(text)
            inside.append(depth > 0)
            texts += 1

    def leave() -> tuple[str, str, int]:
        """The innermost element ends; a gap with no text after it in its container is a dive."""
        wide.update(place for before, place in between.pop(len(stack), []) if before == texts)
        return stack.pop()

    parts = list(markup(page))
    holding = holders(parts) if any(kind == "open" and (name in ARTICLE or name == "form") for kind, name, _ in parts) else set()
    for at, (kind, name, attributes) in enumerate(parts):
        if kind == "text":
            if not dropped:
                part.append(name)
            continue
        if kind == "open":
            if name == "br":
                part.append(" ")
                continue
            if not dropped and name not in INLINE:
                end_line()
            if name in VOID or attributes.endswith("/") and name in INLINE:
                continue
            if name in CLOSED_BY_BLOCK and stack and stack[-1][0] == name:
                dropped -= leave()[1] == "drop"
            role = ""
            if name in ARTICLE and not dropped:
                role, marked, depth = "article", True, depth + 1
            elif name in INVISIBLE or name == "title" or is_noise(name, attributes, depth > 0, at in holding):
                role, dropped = "drop", dropped + 1
                if dropped == 1 and name not in INVISIBLE:
                    # the innermost container with a text before it
                    around = bisect_left(stack, texts, key=lambda e: e[2])
                    contained = around > 0 and stack[around - 1][0] not in ("html", "body")
                    if contained and not depth:
                        between.setdefault(around, []).append((texts, len(lines)))
                    gap = 1 if depth or contained else WINDOW + 1
                    lines.extend([""] * gap)
                    inside.extend([depth > 0] * gap)
            stack.append((name, role, texts))
            continue
        if not any(n == name for n, _, _ in stack):
            continue
        if not dropped and name not in INLINE:
            end_line()
        while stack:
            open_name, role, _ = leave()
            dropped -= role == "drop"
            if role == "article":
                depth -= 1
            if open_name == name:
                break
    end_line()
    within = sum(len(x) for x, i in zip(lines, inside, strict=True) if i)
    if marked and 2 * within >= sum(map(len, lines)):
        return [x if i else "" for x, i in zip(lines, inside, strict=True)], True
    return [x for i, line in enumerate(lines) for x in ([""] * (WINDOW + 1) if i in wide else [line])], False


def main_lines(lines: list[str], one_stretch: bool = False, window: int = WINDOW, threshold: int = THRESHOLD) -> list[str]:
    """The lines between surge and dive points. With `one_stretch` empty windows
    do not end a stretch."""
    lengths = np.array([len(x) for x in lines])
    if not lengths.any():
        return []
    sums = np.convolve(lengths, np.ones(window, int))[window - 1 :]
    least = min(threshold, sums.max() / 2)
    filled = sums > 0
    if one_stretch:
        filled[:] = True
    edges = np.flatnonzero(np.diff(np.concatenate(([0], filled.astype(np.int8), [0]))))
    kept: list[str] = []
    for surge, dive in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if sums[surge:dive].max() >= least:
            kept += [x for x in lines[surge:dive] if x]
    return kept


def main_text(page: str | None) -> str:
    lines, marked = lines_of(page or "")
    return "\n".join(main_lines(lines, marked))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text (empty if none), n_chars."""
    rows = pages.select(pages[id_col].cast("bigint").alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = [main_text(p.as_py()) for p in batch.column(2)]
            sizes = [len(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(sizes, pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return rows.mapInArrow(work, "page_id bigint, url string, text string, n_chars bigint")
