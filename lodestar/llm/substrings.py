"""Substring deduplication by seed and extend over winnowed anchors.

Seeds: of the GRAM-word hashes inside every window of SPAN words, the leftmost smallest is an
anchor, so equal windows have the same anchor at the same place. Anchors that occur once in the
whole corpus are dropped by a distributed count; the rest are seeds.

Extension: each seed is extended both ways over all windows that it anchors (those alone can agree
with windows at other seeds of its hash); the words under them are its span. Seeds whose spans agree
form a class, joined by hash, and all windows of all but its first seed are repeats. The first seeds
of classes that share an anchor but not the span stand where a passage begins or ends; their windows
are matched one by one, by a 96-bit hash, with the earliest occurrence in order of (doc_id, start).
Repeated windows of neighbouring seeds run together into maximal repeats of SPAN words or more,
whose words are removed. So seeds are never paired with each other: a passage with a million copies
costs a million rows, not their square.

A word goes exactly if a window that covers it also starts earlier; windows are judged on the input.
Words are compared by hash: spans by 48 bits of their anchor and 64 of all their words, single windows
by 96 bits.

A document is a doc_id, or, where any doc_id stands in several rows, a doc_id with its text: rows of
one doc_id with other texts are documents of their own, in order of a hash of the text.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from itertools import compress
from operator import or_

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.arrow import arrow_map
from lodestar.llm.words import mix, stretch_hashes, stretch_pairs, window_hashes, word_hashes, word_pairs
from lodestar.session import cut, release

SPAN, GRAM = 20, 6


def anchors(words: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """Gram hashes, and for each window of span words the place of its anchor."""
    gram = min(GRAM, span)
    grams = window_hashes(words, gram)
    n = len(words) - span + 1
    if n <= 0:
        return grams, np.zeros(0, dtype=np.int64)
    at = np.arange(n, dtype=np.int64)
    least, where = grams[:n].copy(), at.copy()
    for k in range(1, span - gram + 1):
        lower = grams[k : k + n] < least
        np.copyto(least, grams[k : k + n], where=lower)
        np.copyto(where, at + k, where=lower)
    return grams, where


def _types(docs: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)


def _seed_rows(docs: DataFrame, span: int, who: list[str]) -> DataFrame:
    """(h, s, *who, pos): hash of an anchor, hash of its span, document, and place.

    48 bits of the anchor's hash are enough: where two anchors share them, their spans still differ.

    pos holds the anchor's word, then the words back to the first window that it anchors and the
    number of those windows less one, in 4 bits each.
    """

    def make():
        def step(batch: pa.RecordBatch) -> dict | None:
            out: list[list] = [[], [], []]
            counts = []
            for text in batch.column("text").to_pylist():
                words = word_hashes((text or "").encode())
                grams, where = anchors(words, span)
                counts.append(0)
                if len(where):
                    first = np.flatnonzero(np.diff(where, prepend=-1))  # windows of an anchor are neighbours
                    count = np.diff(first, append=len(where))
                    at = where[first]
                    shape = ((at - first) << 4) | (count - 1)
                    out[0].append((grams[at] >> np.uint64(16)).view(np.int64))
                    out[1].append(mix(stretch_hashes(words, first, first + count + span - 1) + shape.astype(np.uint64)).view(np.int64))
                    out[2].append((at << 8) | shape)
                    counts[-1] = len(at)
            return dict(zip(("h", "s", "pos"), map(np.concatenate, out), strict=True)) | _repeated(batch, who, counts) if out[0] else None

        return step

    return arrow_map(docs.select(*who, "text"), make, f"h bigint, s bigint, {_types(docs, who)}, pos bigint")


def _repeated(batch: pa.RecordBatch, names: list[str], counts: list[int]) -> dict:
    """Columns of batch with each row as often as counts says."""
    return {c: np.repeat(batch.column(c).to_numpy(), counts) for c in names}


def _window_rows(seeded: DataFrame, span: int, who: list[str]) -> DataFrame:
    """(w1, w2, *who, p) for each window that the documents' seeds (array of pos) anchor.

    w1 and the 32 bits of w2 come from a 128-bit hash of the words' 128-bit hashes.
    """

    def make():
        unpack = zstandard.ZstdDecompressor().decompress

        def step(batch: pa.RecordBatch) -> dict | None:
            out: list[list] = [[], [], []]
            counts = []
            for packed, seeds in zip(batch.column("packed").to_pylist(), batch.column("seeds"), strict=True):
                data = unpack(packed) if packed is not None else b""
                pairs = word_pairs(data)
                at = _starts(seeds.values.to_numpy())
                at = at[at + span <= len(pairs)]
                counts.append(len(at))
                if len(at):
                    found = stretch_pairs(pairs, at, at + span)
                    out[0].append(found[:, 0].view(np.int64))
                    out[1].append((found[:, 1] >> np.uint64(32)).astype(np.uint32).view(np.int32))
                    out[2].append(at.astype(np.int32))
            return dict(zip(("w1", "w2", "p"), map(np.concatenate, out), strict=True)) | _repeated(batch, who, counts) if out[0] else None

        return step

    return arrow_map(seeded.select(*who, "packed", "seeds"), make, f"w1 bigint, w2 int, {_types(seeded, who)}, p int")


def _packed(docs: DataFrame) -> DataFrame:
    """docs with the compressed bytes of its text as packed, for the shuffle."""
    others = [c for c in docs.columns if c != "text"]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others), "packed binary"])

    def make():
        pack = zstandard.ZstdCompressor(level=3).compress

        def step(batch: pa.RecordBatch) -> dict:
            return {c: batch.column(c) for c in others} | {"packed": [None if t is None else pack(t.encode()) for t in batch.column("text").to_pylist()]}

        return step

    return arrow_map(docs, make, schema)


def _starts(pos: np.ndarray) -> np.ndarray:
    """Starts of the windows that seeds anchor."""
    count = (pos & 15) + 1
    first = (pos >> 8) - ((pos >> 4) & 15)
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())


def _kept(n: int, marks: np.ndarray | None, span: int) -> np.ndarray:
    """Which of n words stay, given the seeds (pos) all of whose windows are repeats."""
    change = np.zeros(n + span + 17, dtype=np.int32)
    if marks is not None:
        first = (marks >> 8) - ((marks >> 4) & 15)
        stop = first + (marks & 15) + span
        fits = stop <= n
        np.add.at(change, first[fits], 1)
        np.add.at(change, stop[fits], -1)
    return np.cumsum(change[:n]) == 0


def repeats(docs: DataFrame, packed: DataFrame, who: list[str], span: int = SPAN) -> DataFrame:
    """(*who, marks): the windows of span words that also start earlier, as pos values.

    docs: who (not null, the key of a document in its order) and text; packed: the same rows by
    _packed. A document's marks are at most its own words.
    """
    rows = _seed_rows(docs, span, who)
    # Cut off, so that both sides of the join are plain shuffles: then a frequent anchor is split.
    shared = cut(rows.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("h"))
    seeds = cut(rows.join(shared, "h"))
    release(shared)
    own, firsts = [F.col(c) for c in who], [F.col(f"f.{c}").alias(f"{c}_0") for c in who]
    elsewhere = reduce(or_, (F.col(c) != F.col(f"{c}_0") for c in who))
    first = cut(seeds.groupBy("h", "s").agg(F.min(F.struct(*who, "pos")).alias("f")).select("h", "s", *firsts, F.col("f.pos").alias("p_0")))
    whole = seeds.join(first, ["h", "s"]).where(elsewhere | (F.col("pos") != F.col("p_0"))).select(*own, "pos")
    contested = first.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("h")
    edges = first.join(contested, "h").groupBy(*(F.col(f"{c}_0").alias(c) for c in who)).agg(F.collect_list("p_0").alias("seeds"))
    # The exchange of packed is also that of the caller's last join: texts move once.
    windows = _window_rows(packed.join(edges, who), span, who)
    earliest = windows.groupBy("w1", "w2").agg(F.min(F.struct(*who, "p")).alias("f"), F.count(F.lit(1)).alias("m")).where("m > 1").select("w1", "w2", *firsts, F.col("f.p").alias("p_0"))
    single = windows.join(earliest, ["w1", "w2"]).where(elsewhere | (F.col("p") != F.col("p_0"))).select(*own, F.shiftleft(F.col("p").cast("bigint"), 8).alias("pos"))
    return whole.unionByName(single).groupBy(*who).agg(F.collect_list("pos").alias("marks"))


ADDED = "n_words bigint, n_removed bigint, kept_sha256 string, kept_text string"


def _finished(df: DataFrame, others: list[str], span: int, keep_text: bool) -> DataFrame:
    """others, and the columns of ADDED, from packed and marks."""

    def make():
        unpack = zstandard.ZstdDecompressor().decompress

        def step(batch: pa.RecordBatch) -> dict:
            out = []
            for packed, marks in zip(batch.column("packed").to_pylist(), batch.column("marks"), strict=True):
                data = unpack(packed) if packed is not None else b""
                text = None if packed is None or not keep_text else data.decode()
                words = data.split()  # bytes.split() parts at the same six bytes
                stay = _kept(len(words), marks.values.to_numpy() if marks.is_valid else None, span)
                left, removed = b" ".join(compress(words, stay.tolist())), len(words) - int(stay.sum())
                out.append((len(words), removed, hashlib.sha256(left).hexdigest(), (left.decode() if removed else text) if keep_text else None))
            columns = zip(*out, strict=True) if out else ((), (), (), ())
            return {c: batch.column(c) for c in others} | dict(zip(("n_words", "n_removed", "kept_sha256", "kept_text"), columns, strict=True))

        return step

    out = arrow_map(df, make, ", ".join(filter(None, [_types(df, others), ADDED])))
    return out if keep_text else out.drop("kept_text")


def substring_dedup(docs: DataFrame, span: int = SPAN, keep_text: bool = False) -> DataFrame:
    """docs without its text, with n_words, n_removed, kept_sha256 and, if asked for, kept_text.

    docs: doc_id (integer), text, any other columns; columns with the names of the results are
    replaced. The digest is that of the words left, joined by one space. kept_text is that text where
    words went, else the text as it was (null stays null). A null or empty text has no words; one of
    fewer than span words is never touched, and one of any length is taken whole. A row with a null
    doc_id has no place in the order: it is kept whole and removes nothing elsewhere. Rows that
    repeat doc_id and text count as one document, so none of them is an earlier occurrence of
    another; rows of one doc_id with other texts are documents of their own, in order of a hash of
    the text. An empty table gives an empty result.
    """
    given = [c for c in docs.columns if c not in ("text", "n_words", "n_removed", "kept_sha256", "kept_text")]
    # Other columns travel under names of their own, so none can clash with those used here.
    named = {"doc_id": F.col("doc_id").cast("bigint"), "text": F.col("text").cast("string")}
    docs = docs.select(*(F.col(f"`{c}`").alias(f"given_{i}") for i, c in enumerate(given)), *(x.alias(c) for c, x in named.items()))
    known, who = docs.where("doc_id is not null"), ["doc_id"]
    if not known.groupBy("doc_id").count().where("count > 1").isEmpty():
        known, who = known.withColumn("part", F.coalesce(F.xxhash64("text"), F.lit(0))), ["doc_id", "part"]
    packed = _packed(known)
    found = repeats(known, packed, who, span)
    rest = _packed(docs.where("doc_id is null")).withColumn("marks", F.lit(None).cast("array<bigint>"))
    whole = packed.join(found, who, "left").select(*rest.columns).unionByName(rest)
    others = [f"given_{i}" for i in range(len(given))]
    out = _finished(whole.select(*others, "packed", "marks"), others, span, keep_text)
    return out.select(*(F.col(o).alias(c) for o, c in zip(others, given, strict=True)), *out.columns[len(others) :])
