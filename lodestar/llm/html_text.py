"""Main text of HTML pages by line-block distribution.

Markup is stripped and every block of the page becomes a line. A line weighs the length of its text;
markup only shifts weights: a line of a marked article weighs INSIDE times its length, one outside it
an OUTSIDE-th, with a gap where the article begins and ends, and a line of boilerplate (navigation, page header and footer, sidebars, forms, notices,
adverts, reader comments) or, where no article is marked, of links mostly, weighs nothing. Boilerplate
inside the article is stripped with the markup, so it opens no gap there. Sums over sliding windows of
WINDOW lines give the distribution: it surges where a sum reaches SURGE and dives where one falls to
nothing. The stretches between two dives that hold a surge are kept, or the heaviest one if none surges.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.arrow import arrow_map

WINDOW, SURGE, INSIDE, OUTSIDE = 3, 80, 4, 80
#: Elements by their part in a page.
BLOCKS = set("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
HOLDERS = set("article aside blockquote button details dialog div dl fieldset figure footer form header main menu nav ol section select span table ul".split())
BOILERPLATE = set("aside button dialog footer form menu nav select".split())
ARTICLES = {"article", "main"}
MARKS = set("ad ads adsense advert advertisement advertisements adverts alert banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer menu modal nav navbar navigation newsletter notice notification popup promo promotion related reply replies responses share sharing sidebar signup social sponsor sponsored subscribe teaser toolbar widget".split())
#: Words after a mark that make its name that of a part of a page, and not of a subject (related-posts, but not related-work).
PARTS = MARKS | set("area article articles aside bar block body bottom box btn button buttons card cards col column container content control controls count feed form group head header heading icon icons inner inside item items left link links list main meta module news outer overlay panel placeholder post posts primary right row section secondary slot stories story text thread title toggle top unit widgets wrap wrapper zone".split())
#: Every alternative can end at the end of the page, so no search starts twice over the same text.
_DROPPED = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|svg|textarea|object|title)\b[^>]*(?:>|\Z).*?(?:</\1[^>]*(?:>|\Z)|\Z)|<[!?][^>]*(?:>|\Z)", re.S | re.I)
_OPEN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)")
_REST = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_BARE = re.compile(r"([^>]*+)>")
_NUMBER = re.compile(r"&#([xX]?)0*+([0-9a-fA-F]{8})[0-9a-fA-F]*+")
_ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_UNSEEN = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
#: Words before a mark that only say whose it is.
WHOSE = {"site", "page", "main"}


def _own(attributes: str) -> dict[str, str]:
    """Attributes by lower-cased name; the first of a name counts."""
    out: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(attributes):
        out.setdefault(name.lower(), "".join(values))
    return out


def _is_boilerplate(name: str, own: dict[str, str], in_article: bool) -> bool:
    if name in BOILERPLATE or name == "header" and not in_article:
        return True
    if "hidden" in own and not own["hidden"].lower().startswith(("false", "until")):
        return True
    return own.get("aria-hidden", "").strip().lower() == "true" or bool(_UNSEEN.search(own.get("style", "")))


def _is_marked(name: str, own: dict[str, str], in_article: bool) -> bool:
    """A mark is a whole class, id or role, or its head where only words of PARTS or of one or two letters follow."""
    for word in " ".join(own.get(k, "") for k in ("class", "id", "role")).lower().split():
        parts = [p for p in re.split(r"[^a-z]+", word) if p]
        if len(parts) == 2 and parts[0] in WHOSE:
            parts = parts[1:]
        if parts and (parts[0] in MARKS or parts[0] == "header" and not in_article and name != "h1") and all(p in PARTS or len(p) <= 2 for p in parts[1:]):
            return True
    return False


def _tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, closing, name, attributes) of every tag, in one pass.

    A tag whose quotes never close ends at the next >, and from there on quotes count for nothing.
    """
    at, rest = 0, _REST
    while head := _OPEN.search(page, at):
        body = rest.match(page, head.end())
        if body is None and rest is _REST:
            rest = _BARE
            body = rest.match(page, head.end())
        if body is None:
            return
        at = body.end()
        yield head.start(), at, bool(head[1]), head[2].lower(), body[1]


def _plain(text: str) -> str:
    """text with character references decoded (of a number its first eight digits) and white space folded."""
    return " ".join(html.unescape(_NUMBER.sub(r"&#\1\2", text)).split())


class _Place(NamedTuple):
    """An open element: what holds for a line in it. Chains number the marked tags around it, 0: none."""

    name: str
    boilerplate: bool
    article: bool
    marks: int
    above: int
    below: bool


def lines(page: str) -> list[tuple[str, int, bool, bool]]:
    """(text, letters inside links, boilerplate, inside the article) of each block with text.

    A mark on an element that is or holds the article does not count. The time grows with the length
    of the page, however its tags are nested or broken.
    """
    page = _DROPPED.sub(" ", page)
    found: list[tuple[str, int, _Place]] = []
    stack, opened, chains = [_Place("", False, False, 0, 0, False)], Counter(), [0]
    parts: list[str] = []
    linked, in_link, at = 0, False, 0

    def close() -> None:
        nonlocal linked
        if text := _plain("".join(parts)):
            found.append((text, linked, stack[-1]))
        parts.clear()
        linked = 0

    for start, end, ends, name, attributes in _tags(page):
        if start > at:
            piece = page[at:start]
            parts.append(piece)
            linked += len(piece.strip()) if in_link else 0
        at = end
        if name == "a":
            in_link = not ends
        if name in BLOCKS:
            close()
        if name not in HOLDERS:
            continue
        if ends:
            while opened[name]:
                last = stack.pop().name
                opened[last] -= 1
                if last == name:
                    break
        elif not attributes.rstrip().endswith("/"):
            up, own = stack[-1], _own(attributes)
            marked, article = _is_marked(name, own, up.article), name in ARTICLES
            marks = up.marks
            if marked:
                chains.append(up.marks)
                marks = len(chains) - 1
            stack.append(_Place(name, up.boilerplate or _is_boilerplate(name, own, up.article), up.article or article, marks, marks if article else up.above, not article and (up.below or marked)))
            opened[name] += 1
    parts.append(page[at:])
    close()
    spared = _spared(found, chains)
    return [(text, linked, p.boilerplate or p.below or p.above not in spared, p.article) for text, linked, p in found]


def _spared(found: list[tuple[str, int, _Place]], chains: list[int]) -> set[int]:
    """Marked tags that are or hold the article: those around the article under the fewest marks that has text enough.

    chains: the next marked tag outside of each. Articles under marks stay dropped where the page says
    more without them (readers' comments).
    """
    sizes: dict[int, int] = {}
    other = 0
    for text, _, place in found:
        if not place.boilerplate and not place.below:
            if place.article:
                sizes[place.above] = sizes.get(place.above, 0) + len(text)
            other += 0 if place.above else len(text)
    depth = [0]
    for outer in chains[1:]:
        depth.append(depth[outer] + 1)
    best = min(sizes, key=lambda above: (sizes[above] < SURGE, depth[above], above), default=0)
    out = {0}
    if best and sizes[best] > other:
        while best:
            out.add(best)
            best = chains[best]
    return out


def stretches(weights: list[int]) -> list[tuple[int, int]]:
    """Stretches [start, end) of lines between dives of the window sums that surge; the heaviest one if none does."""
    out: list[tuple[int, int, int, int]] = []
    total, start, peak, mass = sum(weights[:WINDOW]), None, 0, 0
    for i in range(len(weights) + 1):
        if total and i < len(weights):
            if start is None:
                start, peak, mass = i, 0, 0
            peak, mass = max(peak, total), mass + weights[i]
        elif start is not None:
            out.append((start, i, peak, mass))
            start = None
        if i < len(weights):
            total += (weights[i + WINDOW] if i + WINDOW < len(weights) else 0) - weights[i]
    kept = [(a, b) for a, b, peak, _ in out if peak >= SURGE]
    return kept or [(a, b) for a, b, _, mass in sorted(out, key=lambda s: (-s[3], s[0]))[:1]]


def weighed(found: list[tuple[str, int, bool, bool]]) -> list[tuple[str, int]]:
    """(text, weight) of the lines of the distribution; where the article begins or ends, empty lines part it from what is outside."""
    marked = any(article and not boiler for _, _, boiler, article in found)
    out: list[tuple[str, int]] = []
    inside = None
    for text, linked, boiler, article in found:
        if marked and inside is not None and article != inside and not (boiler and article):
            out += [("", 0)] * WINDOW
        if not (boiler and article):
            inside = article
        if boiler:
            if not (marked and article):
                out.append((text, 0))
        elif marked:
            out.append((text, INSIDE * len(text) if article else len(text) // OUTSIDE))
        else:
            out.append((text, 0 if 2 * linked > len(text) else len(text)))
    return out


def main_text(page: str | None) -> str:
    """The main text: blocks in page order joined by line feeds; empty if there is none."""
    rows = weighed(lines(page or ""))
    return "\n".join(rows[i][0] for a, b in stretches([w for _, w in rows]) for i in range(a, b) if rows[i][1])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) for each row of pages.

    A null html is an empty page, and a page without main text gives an empty text. Repeated rows
    each keep their row, whole pages of any length are read, extra columns are ignored, and an empty
    table gives an empty result.
    """

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts, "n_chars": [len(t) for t in texts]}

        return step

    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return arrow_map(pages, make, "page_id bigint, url string, text string, n_chars bigint")
