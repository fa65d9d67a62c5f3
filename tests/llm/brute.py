"""Plain single-process versions that the operators are held against."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from html.parser import HTMLParser

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text):
    w = WORD.findall(ascii_lower(text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near(docs: dict, percent: int = 85) -> dict:
    """doc_id to (n_shingles, component_id)."""
    sets = {d: shingles(t) for d, t in docs.items()}
    by, parent = defaultdict(list), {d: d for d in docs}
    for d, s in sets.items():
        for x in s:
            by[x].append(d)

    def find(d):
        while parent[d] != d:
            parent[d] = parent[parent[d]]
            d = parent[d]
        return d

    for d, s in sets.items():
        common = Counter(o for x in s for o in by[x] if o > d)
        for o, c in common.items():
            if 100 * c >= percent * (len(s) + len(sets[o]) - c):
                a, b = sorted((find(d), find(o)))
                parent[b] = a
    return {d: (len(sets[d]), find(d)) for d in docs}


def substring(docs: dict, span: int = 20) -> dict:
    """doc_id to (n_words, n_removed, kept_sha256)."""
    seen, out = set(), {}
    for d in sorted(docs):
        w = WORD.findall(docs[d] or "")
        gone = [False] * len(w)
        for i in range(len(w) - span + 1):
            key = tuple(w[i : i + span])
            if key in seen:
                gone[i : i + span] = [True] * span
            else:
                seen.add(key)
        left = [x for x, g in zip(w, gone, strict=True) if not g]
        out[d] = (len(w), sum(gone), hashlib.sha256(" ".join(left).encode()).hexdigest())
    return out


def rules(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    counts, inside = Counter(grams), set()
    for i, g in enumerate(grams):
        if counts[g] > 1:
            inside |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def licenses(text):
    """n_words, n_base, first_word, last_word, base_labels."""
    w = LICENSE_WORD.findall(ascii_lower(text or ""))
    found = []
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        found += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    at = [i for i, _ in found]
    return len(w), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def edited(docs: dict) -> dict:
    """doc_id to (n_chars, edited_sha256)."""
    order = sorted(docs, reverse=True)
    out = {}
    for i, d in enumerate(order):
        own, following = docs[d] or "", docs[order[(i + 1) % len(order)]] or ""
        k = len(own) // 2
        out[d] = (len(own), hashlib.sha256((own[: len(own) - k] + following[:k]).encode()).hexdigest())
    return out


BLOCK_TAGS = set("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
NESTED_TAGS = set("article aside blockquote button details dialog div dl fieldset figure footer form header main menu nav ol section select span table ul".split())
PAGE_PARTS = re.compile(r"(?:(?:site|page|main)[-_ ])?(?:ad|ads|advert|banner|comments?|cookies?|footer|menu|nav|navbar|navigation|related|sidebar|social|share|promo|newsletter|header)(?:[-_](?:box|list|posts|links|area|wrap|wrapper|notice|[a-z]{1,2}))*")


class Page(HTMLParser):
    """(text, letters inside links, boilerplate, inside the article) of each block, by the library's parser.

    For pages without a mark around their article; what is boilerplate is told by rules of its own.
    """

    def __init__(self):
        super().__init__()
        self.found, self.open, self.text, self.linked, self.link, self.skipped = [], [], "", 0, False, None

    def close_block(self):
        if text := " ".join(self.text.split()):
            self.found.append((text, self.linked, any(e[1] for e in self.open), any(e[0] in ("article", "main") for e in self.open)))
        self.text, self.linked = "", 0

    def handle_starttag(self, tag, attrs):
        if self.skipped or tag in ("script", "style", "noscript", "template", "iframe", "svg", "textarea", "object", "title"):
            self.skipped = self.skipped or tag
            return
        self.link = True if tag == "a" else self.link
        if tag in BLOCK_TAGS:
            self.close_block()
        if tag in NESTED_TAGS:
            own, inside = {k: v or "" for k, v in attrs}, any(e[0] in ("article", "main") for e in self.open)
            element = tag in ("aside", "button", "dialog", "footer", "form", "menu", "nav", "select") or tag == "header" and not inside or "hidden" in own or "display:none" in own.get("style", "").replace(" ", "")
            named = any(PAGE_PARTS.fullmatch(re.sub(r"\d+x?\d*", "x", w)) for k in ("class", "id", "role") for w in own.get(k, "").lower().split())
            self.open.append((tag, element or named))

    def handle_endtag(self, tag):
        if self.skipped:
            self.skipped = None if tag == self.skipped else self.skipped
            return
        self.link = False if tag == "a" else self.link
        if tag in BLOCK_TAGS:
            self.close_block()
        if tag in [e[0] for e in self.open]:
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not self.skipped:
            self.text += data
            self.linked += len(data.strip()) if self.link else 0


def main_text(page) -> str:
    """Main text by sums over three lines taken one by one; 80 letters surge, an article counts four times, the rest an eightieth."""
    parser = Page()
    parser.feed(page or "")
    parser.close()
    parser.close_block()
    marked = any(article and not boiler for _, _, boiler, article in parser.found)
    seen = [r for r in parser.found if not (marked and r[2] and r[3])]
    rows = []
    for i, (text, linked, boiler, article) in enumerate(seen):
        if marked and i and article != seen[i - 1][3]:
            rows += [("", 0)] * 3
        plain = 0 if 2 * linked > len(text) else len(text)
        rows.append((text, 0 if boiler else plain if not marked else 4 * len(text) if article else len(text) // 80))
    sums = [sum(w for _, w in rows[i : i + 3]) for i in range(len(rows))]
    runs, now = [], []
    for i in [*range(len(rows)), None]:
        if i is not None and sums[i]:
            now.append(i)
        elif now:
            runs.append(now)
            now = []
    kept = [r for r in runs if max(sums[i] for i in r) >= 80] or sorted(runs, key=lambda r: -sum(rows[i][1] for i in r))[:1]
    return "\n".join(rows[i][0] for r in kept for i in r if rows[i][1])
