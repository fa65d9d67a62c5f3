"""License scans: exact base phrases, and fuzzy search for short notices.

Fuzzy search: a notice that may hold k edits is split into k + 1 parts; by the pigeonhole principle
at least one part of any match is exact. One Aho-Corasick automaton over all parts finds these seeds
in the normalised text (words joined by one space), each seed gives a candidate stretch as wide as
the notice and its edits, and the regex library's bounded-error matching confirms it and gives the
span and the number of edits. Everything runs inside one pass over the rows, without a shuffle.

Defined results: a null text is an empty one (no words, no labels, score 0); whole texts of any
length are searched; repeated rows each keep their row; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.arrow import arrow_map

#: The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Short notices in normalised words, with the method's label for each.
NOTICES = {
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache-2.0",
    "released under the apache license": "apache-2.0",
    "redistribution and use in source and binary forms": "bsd",
    "this program is free software you can redistribute it": "gpl",
    "under the terms of the gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "mozilla public license version 2 0": "mpl-2.0",
    "this work is licensed under a creative commons attribution": "cc-by",
    "licensed under cc by": "cc-by",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "reserved",
}
#: One edit for every so many letters of a notice.
LETTERS_AN_EDIT = 10
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[str]:
    """Lower-cased (A-Z) words: runs of letters a-z, digits and what is outside ASCII."""
    return [w.decode() for w in _WORD.findall((text or "").encode().lower())]


@dataclass(frozen=True)
class Span:
    """A confirmed notice: place in the normalised text, edits, first word."""

    notice: str
    label: str
    start: int
    end: int
    edits: int
    word: int


def parts(notice: str, edits: int) -> list[tuple[int, str]]:
    """notice in edits + 1 parts of even length, each with its offset."""
    cut = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


class _Blanks:
    """Numbers of words by place in a text; the places of its blanks are taken once, when first asked for."""

    def __init__(self, text: str):
        self.text, self.places = text, None

    def before(self, end: int) -> int:
        """Blanks in text[:end]."""
        if self.places is None:
            self.places = [m.start() for m in re.finditer(" ", self.text)]
        return bisect_left(self.places, end)


class Scanner:
    """Finds notices with at most len // LETTERS_AN_EDIT edits."""

    def __init__(self, notices: dict[str, str] | None = None):
        notices = NOTICES if notices is None else notices
        self.seeds = ahocorasick.Automaton()
        self.known = []
        found: dict[str, list] = {}
        for n, (notice, label) in enumerate(notices.items()):
            edits = len(notice) // LETTERS_AN_EDIT
            self.known.append((notice, label, edits, regex.compile(rf"(?b)(?<!\w)(?:{regex.escape(notice)}){{e<={edits}}}(?!\w)")))
            for at, part in parts(notice, edits):
                found.setdefault(part, []).append((n, at))
        for part, uses in found.items():
            self.seeds.add_word(part, (len(part), uses))
        self.seeds.make_automaton()

    def find(self, text: str) -> list[Span]:
        """Spans in a normalised text, in order; of overlapping ones of a notice the best."""
        wide: dict[int, list[list[int]]] = {}
        for end, (size, uses) in self.seeds.iter(text):
            for n, at in uses:
                notice, _, edits, _ = self.known[n]
                low = max(0, end + 1 - size - at - edits)
                high = min(len(text), low + len(notice) + 2 * edits + 1)
                stretches = wide.setdefault(n, [])
                if stretches and low <= stretches[-1][1]:
                    stretches[-1][0] = min(low, stretches[-1][0])
                    stretches[-1][1] = max(high, stretches[-1][1])
                else:
                    stretches.append([low, high])
        out, blanks = [], _Blanks(text)
        for n, stretches in wide.items():
            notice, label, edits, pattern = self.known[n]
            for low, high in stretches:
                left = [(max(0, low - 1), min(len(text), high + 1))]
                while left:  # the best match of a stretch, then what stands before and after it
                    a, b = left.pop()
                    m = pattern.search(text, a, b) if b - a >= len(notice) - edits else None
                    if m:
                        out.append(Span(notice, label, m.start(), m.end(), sum(m.fuzzy_counts), blanks.before(m.start() + 1)))
                        left += [(a, m.start() - 1), (m.end(), b)]
        return sorted(out, key=lambda s: (s.start, s.end, s.notice))


_BASE = [(label, re.compile(rf"(?:^|(?<= ))(?={re.escape(phrase)}(?: |$))")) for phrase, label in BASE.items()]


def base_places(text: str) -> list[tuple[int, str]]:
    """(word number, label) of every base phrase in a normalised text."""
    blanks = _Blanks(text)
    return sorted((blanks.before(m.start()), label) for label, pattern in _BASE for m in pattern.finditer(text))


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    n_base counts the places of base phrases; first_word and last_word are their smallest and
    largest first word, null without any. labels has the base's and the method's. score is the best
    share of letters without an edit over all notices found: 1.0 for an exact phrase, 0.0 for none.
    spans: label, start, end (in the normalised text), edits.
    """

    def make():
        scanner = Scanner()

        def one(text: str | None) -> tuple:
            own = words(text)
            flat = " ".join(own)
            base, spans = base_places(flat), scanner.find(flat)
            base_labels = {label for _, label in base}
            score = 1.0 if base else max((1 - s.edits / len(s.notice) for s in spans), default=0.0)
            places = [at for at, _ in base]
            return (
                len(own), len(base), min(places, default=None), max(places, default=None), ",".join(sorted(base_labels)),
                ",".join(sorted(base_labels | {s.label for s in spans})), score, [{"label": s.label, "start": s.start, "end": s.end, "edits": s.edits} for s in spans],
            )

        def step(batch: pa.RecordBatch) -> dict:
            rows = [one(t) for t in batch.column("text").to_pylist()]
            names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
            return {"doc_id": batch.column("doc_id")} | dict(zip(names, zip(*rows, strict=True) if rows else [()] * 8, strict=True))

        return step

    schema = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<label:string,start:bigint,end:bigint,edits:int>>"
    return arrow_map(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), make, schema)
