"""Quality rules: divergence of a document's histograms from language references.

References: over all documents of a language, the share of each character class and of each common
word are summed (a partial sum in every batch, then one small aggregate). Junk in the corpus shifts
these sums, so they are taken a second time over the documents that are near the first ones. A document's distance to a
language is the Jensen-Shannon distance (square root of the divergence in bits, 0 to 1) of its two
histograms; it is held against the nearest language, so a wrong lang value does no harm. A histogram
of too few characters or words says little and is left out of the verdict.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.arrow import arrow_map
from lodestar.llm.words import spans, window_hashes, word_hashes
from lodestar.session import cut

#: Common words of each language.
COMMON = {
    "en": "the of and to in a is that for it as was with be by on are this from at or an not",
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como o",
}
#: Language of the reference over all other documents.
OTHER = "*"
#: Least characters and words of a histogram that is held against its limit.
MIN_CHARACTERS, MIN_WORDS = 200, 60
MAX_CHARACTERS, MAX_COMMON = 0.14, 0.38
#: Limits for a document to count in the second references.
NEAR_CHARACTERS, NEAR_COMMON = 0.20, 0.36
CLASSES = 9
SYMBOLS = "#*$%&|<>"


def _class_table() -> np.ndarray:
    """Class of each code point below 256: 0 lower, 1 upper, 2 digit, 3 white space, 4 full stop or comma, 5 symbol, 6 other punctuation, 7 other letter, 8 the rest."""
    out = np.full(256, 8, dtype=np.int64)
    for i in range(256):
        c = chr(i)
        out[i] = 5 if c in SYMBOLS else 4 if c in ".," else 3 if c.isspace() else 2 if c.isdigit() else 1 if c.isupper() else 0 if c.islower() else 7 if c.isalpha() else 6 if i < 127 and i > 32 else 8
    return out


_CLASS = _class_table()
#: Ranges of code points above 255 that are no letters (first, last, class).
_RANGES = [
    (0x2000, 0x200B, 3), (0x2010, 0x2027, 6), (0x2028, 0x2029, 3), (0x202F, 0x202F, 3), (0x2030, 0x205E, 6), (0x205F, 0x205F, 3), (0x20A0, 0x20CF, 8),
    (0x2190, 0x2BFF, 8), (0x3000, 0x3000, 3), (0x3001, 0x3003, 6), (0x3008, 0x3011, 6), (0xE000, 0xF8FF, 8), (0xFE00, 0xFE0F, 8), (0xFF01, 0xFF0F, 6), (0xFFFD, 0xFFFD, 8), (0x1F000, 0x1FAFF, 8),
]
_FIRST, _LAST, _KIND = (np.array(x) for x in zip(*_RANGES, strict=True))
_VOCABULARY = sorted({w for words in COMMON.values() for w in words.split()})
_PLACE = {w.encode(): i for i, w in enumerate(_VOCABULARY)}


def histograms(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Counts of character classes and of common words (the last place has all other words).

    Digits are not counted: a number, key or date in a short text says nothing about its language.
    """
    points = np.frombuffer((text or "").encode("utf-32-le"), dtype=np.uint32)
    low = points[points < 256]
    classes = np.bincount(_CLASS[low], minlength=CLASSES)
    if len(low) < len(points):
        high = points[points >= 256]
        at = np.maximum(np.searchsorted(_FIRST, high, side="right") - 1, 0)
        inside = (high >= _FIRST[at]) & (high <= _LAST[at])
        classes += np.bincount(np.where(inside, _KIND[at], 7), minlength=CLASSES)
    classes[2] = 0
    counts, place, rest = np.zeros(len(_VOCABULARY) + 1, dtype=np.int64), _PLACE.get, len(_VOCABULARY)
    for word in (text or "").lower().encode().split():
        counts[place(word.strip(b".,;:!?\"'()"), rest)] += 1
    return classes, counts


def distances(p: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of a histogram of counts to each row of known; 1.0 where either is empty."""
    totals = known.sum(axis=1)
    if not p.sum():
        return np.ones(len(known))
    p, q = p / p.sum(), known / np.where(totals > 0, totals, 1)[:, None]
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        each = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    return np.where(totals > 0, np.sqrt(np.maximum(0.0, each.sum(axis=1) / 2)), 1.0)


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms of counts; 1.0 if either is empty."""
    return float(distances(np.asarray(p, dtype=float), np.asarray(q, dtype=float)[None, :])[0])


Reference = dict[str, tuple[np.ndarray, np.ndarray]]


class Languages:
    """References side by side, for many documents."""

    def __init__(self, known: Reference):
        self.classes = np.stack([x for x, _ in known.values()])
        self.words = np.stack([y for _, y in known.values()])

    def nearest(self, pair: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
        """Distances of both histograms to the language that is nearest by the limits."""
        x, y = distances(pair[0], self.classes), distances(pair[1], self.words)
        at = int(np.maximum(x / MAX_CHARACTERS, y / MAX_COMMON).argmin())
        return float(x[at]), float(y[at])


#: Columns of histograms that were taken before.
COUNTED = ("counted classes", "counted words")


def _pairs(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The histograms of each row: those taken before, or those of its text."""
    if COUNTED[0] not in batch.schema.names:
        return map(histograms, batch.column("text").to_pylist())
    return zip(*(batch.column(c).flatten().to_numpy().reshape(batch.num_rows, -1) for c in COUNTED), strict=True)


def _sums(docs: DataFrame, near: Reference | None) -> Reference:
    def make():
        languages = Languages(near) if near is not None else None

        def step(batch: pa.RecordBatch) -> dict:
            sums: dict[str, list] = {}
            for lang, (a, b) in zip(batch.column("lang").to_pylist(), _pairs(batch), strict=True):
                if languages is not None:
                    x, y = languages.nearest((a, b))
                    if x > NEAR_CHARACTERS or y > NEAR_COMMON:
                        continue
                held = sums.setdefault(lang if lang in COMMON else OTHER, [np.zeros(CLASSES), np.zeros(len(_VOCABULARY) + 1)])
                # Each document counts as one, so a few very long ones do not make the reference.
                held[0] += a / max(1, a.sum())
                held[1] += b / max(1, b.sum())
            return {"lang": list(sums), "classes": [x[0].tolist() for x in sums.values()], "words": [x[1].tolist() for x in sums.values()]}

        return step

    given = [c for c in COUNTED if c in docs.columns] or ["text"]
    parts = arrow_map(docs.select("lang", *given), make, "lang string, classes array<double>, words array<double>")
    rows = parts.select("lang", F.lit("c").alias("kind"), F.posexplode("classes").alias("i", "x")).union(parts.select("lang", F.lit("w"), F.posexplode("words")))
    out: Reference = {}
    for r in rows.groupBy("lang", "kind", "i").agg(F.sum("x").alias("x")).collect():
        pair = out.setdefault(r["lang"], (np.zeros(CLASSES), np.zeros(len(_VOCABULARY) + 1)))
        pair[r["kind"] == "w"][r["i"]] = round(r["x"], 6)  # whatever the order of the sum
    return {k: v for k, v in sorted(out.items()) if v[0].sum() and v[1].sum()}


def references(docs: DataFrame) -> Reference:
    """Language to summed histograms over all documents; bounded by the languages of COMMON and OTHER.

    docs: text (or the columns of COUNTED), lang. Languages that COMMON does not know, and null, are summed up as OTHER.
    """
    first = _sums(docs, None)
    return (_sums(docs, first) or first) if first else first


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    data = text.encode()
    starts, ends = spans(data)
    n = len(starts)
    blanks = len(data) - int((ends - starts).sum()) if n else len(data)
    seen: set[str] = set()
    repeated = 0
    for line in text.split("\n"):
        if line in seen:
            repeated += 1
        elif line.strip(" \t\n\r\x0b\x0c"):
            seen.add(line)
    grams = window_hashes(word_hashes(data), 3)
    inside = 0
    if len(grams):
        _, which, counts = np.unique(grams, return_inverse=True, return_counts=True)
        hit = counts[which] > 1
        covered = np.zeros(n, dtype=bool)
        for k in range(3):
            covered[k : k + len(grams)] |= hit
        inside = int(covered.sum())
    return n, len(text) - blanks, sum(map(text.count, SYMBOLS)), repeated, inside


def quality_rules(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """The columns of docs (text only if asked for), with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, character_distance, word_distance.

    docs: text, lang and any others; columns with the names of the results are replaced. base_failed:
    fewer than 50 words, or more than half of them in repeated 3-word windows. kept: not base_failed,
    and neither distance to the nearest language above its limit; the distance of characters counts
    from MIN_CHARACTERS counted characters on, that of words from MIN_WORDS words on, else it is null.
    A null text is an empty one (0 words, fails the base); very long texts are read whole. Repeated
    rows each keep their row. Without documents there is no reference and no row.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "character_distance", "word_distance"]
    docs = docs.drop(*added).withColumns({"text": F.col("text").cast("string"), "lang": F.col("lang").cast("string")})
    others = [c for c in docs.columns if keep_text or c != "text"]
    typed = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others)
    base = ", ".join(f"{c} bigint" for c in added[:5])
    if not keep_text:  # without the text a row is small: its histograms are taken once and written
        docs = cut(_counted(docs, others, f"{typed}, {base}, `{COUNTED[0]}` array<int>, `{COUNTED[1]}` array<int>", added[:5]))
    known = references(docs)

    def make():
        languages = Languages(known) if known else None

        def one(counts: tuple, pair: tuple[np.ndarray, np.ndarray]) -> tuple:
            n, repeated = counts[0], counts[4]
            failed = n < 50 or 100 * repeated > 50 * n
            if languages is None:
                return *counts, failed, not failed, None, None
            x, y = languages.nearest(pair)
            x, y = x if pair[0].sum() >= MIN_CHARACTERS else None, y if n >= MIN_WORDS else None
            return *counts, failed, not (failed or (x is not None and x > MAX_CHARACTERS) or (y is not None and y > MAX_COMMON)), x, y

        def step(batch: pa.RecordBatch) -> dict:
            own = map(base_counts, batch.column("text").to_pylist()) if keep_text else zip(*(batch.column(c).to_pylist() for c in added[:5]), strict=True)
            rows = [one(*r) for r in zip(own, _pairs(batch), strict=True)]
            return {c: batch.column(c) for c in others} | dict(zip(added, zip(*rows, strict=True) if rows else [()] * len(added), strict=True))

        return step

    return arrow_map(docs, make, f"{typed}, {base}, base_failed boolean, kept boolean, character_distance double, word_distance double")


def _counted(docs: DataFrame, others: list[str], schema: str, base: list[str]) -> DataFrame:
    """others, the base counts and the histograms of each text."""

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            texts = batch.column("text").to_pylist()
            counts, pairs = [base_counts(t) for t in texts], [histograms(t) for t in texts]
            out = {c: batch.column(c) for c in others} | dict(zip(base, zip(*counts, strict=True) if counts else [()] * len(base), strict=True))
            return out | dict(zip(COUNTED, zip(*pairs, strict=True) if pairs else ((), ()), strict=True))

        return step

    return arrow_map(docs, make, schema)
