"""Alignment of two tokenizers' tokens by packed bitsets over the bytes of a text.

A bitset marks the bytes where tokens of a tokenizer end. The AND of both has the shared cuts, its
set bits are selected in order, and the rank of a cut in either bitset, by popcounts of whole words
and of part of one, is the number of tokens up to it. So neighbouring cuts bound a group of tokens of
each side, and links expand within groups, vectorised over all texts of a block.

A block is a slice of rows of bounded size. Its distinct linked pairs, with the number of its documents
that hold each, are all that is counted over the corpus; a document keeps places into its block's
pairs. So a pair is shuffled once a block, not once a document, and texts are encoded once and never
shuffled.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.arrow import arrow_map, held
from lodestar.llm.encoding import _ODD, ByteEncoder, _bytes_of
from lodestar.session import cut

#: Links that are expanded at once.
LINKS = 1_000_000


class Groups(NamedTuple):
    """Tokens of all texts of a batch, one text after the other, and the groups they form."""

    a: np.ndarray  # token ids
    b: np.ndarray
    a_stops: np.ndarray  # of each group, the number of tokens up to its end
    b_stops: np.ndarray
    text: np.ndarray  # of each group, its text's number
    n_texts: int

    def starts(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each group, the number of tokens before it."""
        return np.append(0, self.a_stops[:-1])[: len(self.text)], np.append(0, self.b_stops[:-1])[: len(self.text)]


def bitset(places: np.ndarray, size: int) -> np.ndarray:
    """64-bit words whose bits at the places (below size) are set."""
    flags = np.zeros((size + 63) // 64 * 64, dtype=np.uint8)
    flags[places] = 1
    return np.packbits(flags, bitorder="little").view(np.uint64)


def select(bits: np.ndarray) -> np.ndarray:
    """Places of the set bits, in order."""
    return np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little"))


def rank(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Number of set bits up to and at each place."""
    before = np.append(0, np.cumsum(np.bitwise_count(bits), dtype=np.int64))
    word, bit = places >> 6, (places & 63).astype(np.uint64)
    mask = (np.uint64(2) << bit) - np.uint64(1)  # wraps to all ones at bit 63
    return before[word] + np.bitwise_count(bits[word] & mask)


def grouped(a: list[np.ndarray], b: list[np.ndarray], a_sizes: np.ndarray, b_sizes: np.ndarray) -> Groups:
    """Groups of the token ids a[i] and b[i] of each text; sizes are bytes by id, and both sides of a text have as many."""
    left, right = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (a, b))
    a_ends, b_ends = np.cumsum(a_sizes[left]), np.cumsum(b_sizes[right])
    size = int(a_ends[-1]) if len(a_ends) else 0
    one, other = bitset(a_ends - 1, size), bitset(b_ends - 1, size)  # a token ends at its last byte
    cuts = select(one & other)
    a_stops = rank(one, cuts)
    counts = np.cumsum([len(x) for x in a])
    return Groups(left, right, a_stops, rank(other, cuts), np.searchsorted(counts, a_stops), len(a))


def pair_counts(found: Groups, width: int, links: int = LINKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, code, times) of each text's distinct linked pairs, in order; a pair's code is a * width + b.

    At most about `links` links are expanded at once; a group with more is expanded by its distinct ids.
    """
    a0, b0 = found.starts()
    n_a, n_b = found.a_stops - a0, found.b_stops - b0
    upto = np.cumsum(n_a * n_b)
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def reduced(text: np.ndarray, code: np.ndarray, times: np.ndarray | None) -> None:
        codes, place = np.unique(code, return_inverse=True)
        keys, at, n = np.unique(text * len(codes) + place, return_inverse=True, return_counts=True)
        if times is not None:
            n = np.bincount(at, weights=times).astype(np.int64) if times.sum() < 2**52 else np.array([times[at == i].sum() for i in range(len(keys))])
        parts.append((keys // max(1, len(codes)), codes[keys % max(1, len(codes))], n))

    start = 0
    while start < len(upto):
        before = int(upto[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(upto, before + links, side="right")))
        if int(upto[start]) - before > links:  # one group
            (x, m), (y, n) = (np.unique(ids[low : low + k], return_counts=True) for ids, low, k in ((found.a, a0[start], n_a[start]), (found.b, b0[start], n_b[start])))
            rows = max(1, links // len(y))
            for i in range(0, len(x), rows):
                code = (x[i : i + rows, None] * width + y[None, :]).ravel()
                reduced(np.full(len(code), found.text[start]), code, (m[i : i + rows, None] * n[None, :]).ravel())
        else:
            sizes = (n_a * n_b)[start:stop]
            group = np.repeat(np.arange(start, stop), sizes)
            k = np.arange(len(group)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            code = found.a[a0[group] + k // n_b[group]] * width + found.b[b0[group] + k % n_b[group]]
            reduced(found.text[group], code, None)
        start = stop
    if not parts:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(3))
    if len(parts) == 1:
        return parts[0]
    text, code, times = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((code, text))
    text, code, times = text[order], code[order], times[order]
    first = np.flatnonzero(np.append(True, (np.diff(text) != 0) | (np.diff(code) != 0)))
    return text[first], code[first], np.add.reduceat(times, first)


class Aligner:
    """A byte-level vocabulary (A) and a piece vocabulary (B) with byte fallback."""

    def __init__(self, byte_path: str, piece_path: str):
        import sentencepiece

        self.bytes = ByteEncoder(byte_path)
        self.bytes.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        names = {i: t for t, i in self.bytes.tokenizer.get_vocab(with_added_tokens=True).items()}
        special = set(self.bytes.specials)
        self.a_bytes = [b"" if names.get(i) is None or names[i] in special else _bytes_of(names[i]) for i in range(max(names) + 1)]
        self.width = self.pieces.get_piece_size()
        piece = self.pieces.id_to_piece
        self.b_bytes = [bytes([int(piece(i)[3:5], 16)]) if self.pieces.is_byte(i) else b"" if self.pieces.is_control(i) or self.pieces.is_unknown(i) else piece(i).replace("▁", " ").encode() for i in range(self.width)]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.a_bytes, self.b_bytes))
        self.a_names, self.b_names = (np.array([[s + str(i).encode() for i in range(n)] for s in (b"", b",", b";", b"|")]) for n in (len(self.a_bytes), self.width))

    def tokens(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of each text on both sides; none on either where the text is null or empty or a side does not give it back."""
        none = np.zeros(0, dtype=np.int64)
        a = [self.bytes.tokenizer.encode(x, add_special_tokens=False).ids if _ODD(x) else self.bytes.fast(x) if x != " " else [] for x in (" " + (t or "") for t in texts)]
        b = self.pieces.encode([t or "" for t in texts], num_threads=1)
        out: tuple[list, list] = ([], [])
        for text, x, y in zip(texts, a, b, strict=True):
            data = (" " + (text or "")).encode()
            same = bool(text) and b"".join(map(self.a_bytes.__getitem__, x)) == data == b"".join(map(self.b_bytes.__getitem__, y))
            out[0].append(np.array(x, dtype=np.int64) if same else none)
            out[1].append(np.array(y, dtype=np.int64) if same else none)
        return out

    def align(self, texts: list[str | None]) -> Groups:
        return grouped(*self.tokens(texts), self.a_sizes, self.b_sizes)

    def written(self, found: Groups) -> list[str]:
        """The groups of each text as `a1,a2|b1;a3|b2,b3`; empty without tokens."""
        return [x.decode() for x in self._written(found)]

    def _written(self, found: Groups) -> list[bytes]:
        a0, b0 = found.starts()
        n_a, n_b = found.a_stops - a0, found.b_stops - b0
        flat = np.zeros(len(found.a) + len(found.b), dtype=max(self.a_names.dtype, self.b_names.dtype))
        mark = np.ones(len(found.a), dtype=np.int64)
        mark[a0] = np.where(np.diff(found.text, prepend=-1) > 0, 0, 2)  # a text's first group has no mark before it
        flat[np.arange(len(found.a)) + np.repeat(b0, n_a)] = self.a_names[mark, found.a]
        mark = np.ones(len(found.b), dtype=np.int64)
        mark[b0] = 3
        flat[np.arange(len(found.b)) + np.repeat(found.a_stops, n_b)] = self.b_names[mark, found.b]
        stops = np.cumsum(np.bincount(found.text, n_a + n_b, found.n_texts).astype(np.int64)) if len(found.text) else np.zeros(found.n_texts, dtype=np.int64)
        return [flat[i:j].tobytes().translate(None, b"\0") for i, j in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)]


def _sums(where: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Exact sums of values by place; where is ascending."""
    upto = np.append(0, np.cumsum(values, dtype=np.int64))
    bounds = np.searchsorted(where, np.arange(n + 1))
    return upto[bounds[1:]] - upto[bounds[:-1]]


def _aligner(byte_path: str, piece_path: str) -> tuple:
    key = f"{byte_path}\n{piece_path}"
    return key, lambda: held(key, lambda: Aligner(byte_path, piece_path))


def token_groups(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """(doc_id, groups) for each row of docs: groups array<struct<a array<int>, b array<int>>>, in order.

    docs: doc_id (integer) and text; other columns are ignored. Texts that are null or empty, or that
    either tokenizer does not give back byte for byte, have no groups; all others are taken whole.
    """
    key, aligner = _aligner(byte_path, piece_path)

    def make():
        own = aligner()

        def step(batch: pa.RecordBatch) -> dict:
            found = own.align(batch.column("text").to_pylist())
            a0, b0 = found.starts()
            out: list[list] = [[] for _ in range(found.n_texts)]
            for t, i, j, k, m in zip(found.text.tolist(), a0.tolist(), found.a_stops.tolist(), b0.tolist(), found.b_stops.tolist(), strict=True):
                out[t].append({"a": found.a[i:j].tolist(), "b": found.b[k:m].tolist()})
            return {"doc_id": batch.column("doc_id"), "groups": out}

        return step

    return arrow_map(_plain(docs), make, "doc_id bigint, groups array<struct<a:array<int>,b:array<int>>>", key)


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


_OWN = ["n_a", "n_b", "n_groups", "n_links"]


def aligned_blocks(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """One row a block: its number, arrays with a value for each document, the block's distinct pairs
    (codes) with the number of its documents that hold each (holders), and the documents' pairs (packed)."""
    key, aligner = _aligner(byte_path, piece_path)

    def make():
        own, pack = aligner(), zstandard.ZstdCompressor(level=1).compress

        def step(batch: pa.RecordBatch) -> dict | None:
            if not batch.num_rows:
                return None
            found = own.align(batch.column("text").to_pylist())
            a0, b0 = found.starts()
            n_a, n_b = found.a_stops - a0, found.b_stops - b0
            text, code, times = pair_counts(found, own.width)
            codes, place = np.unique(code, return_inverse=True)
            n = found.n_texts
            row = {
                "doc_id": batch.column("doc_id").to_pylist(), "n_a": _sums(found.text, n_a, n), "n_b": _sums(found.text, n_b, n), "n_groups": _sums(found.text, np.ones_like(n_a), n), "n_links": _sums(found.text, n_a * n_b, n),
                "groups_sha256": [hashlib.sha256(x).hexdigest() if x else "" for x in own._written(found)], "codes": codes, "holders": np.bincount(place, minlength=len(codes)),
                "packed": pack(np.concatenate([np.searchsorted(text, np.arange(n + 1)), place, times]).astype("<i8").tobytes()),
            }
            return {k: [v] for k, v in row.items()}

        return step

    arrays = ", ".join(f"{c} array<bigint>" for c in ("doc_id", *_OWN, "codes", "holders"))
    made = arrow_map(_plain(docs), make, f"{arrays}, groups_sha256 array<string>, packed binary", key)
    return cut(made).withColumn("block", F.monotonically_increasing_id())


def linked_pairs(blocks: DataFrame, width: int) -> DataFrame:
    """(code, n_docs, best): pairs of ids with the number of documents that hold them linked; best says
    that no pair of the same A id is held by more. An A id has at most width pairs."""
    pairs = blocks.select(F.explode(F.arrays_zip("codes", "holders")).alias("p")).groupBy(F.col("p.codes").alias("code")).agg(F.sum("p.holders").alias("n_docs"))
    pairs = cut(pairs)
    most = pairs.groupBy(F.floor(F.col("code") / width).alias("a")).agg(F.max("n_docs").alias("most"))
    return pairs.withColumn("a", F.floor(F.col("code") / width)).join(most, "a").select("code", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def piece_count(piece_path: str) -> int:
    """Number of ids of a piece vocabulary."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_path).get_piece_size()


def alignment_statistics(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """One row per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    docs: doc_id (integer) and text; other columns are ignored. n_best counts the links whose pair no
    other pair of its A id beats in documents that hold it, count_sum adds those documents up over
    all links. Texts without tokens (null, empty, or not given back byte for byte by a tokenizer)
    have zeros and an empty digest; very long ones are taken whole. Every row is a document, so
    repeated rows count as often; a null doc_id stays null. An empty table gives an empty one.
    """
    width = piece_count(piece_path)
    blocks = aligned_blocks(docs, byte_path, piece_path)
    pairs = cut(linked_pairs(blocks, width))
    asked = blocks.select("block", F.posexplode("codes").alias("at", "code"))
    looked = asked.join(pairs, "code").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("at", "n_docs", "best"))).alias("looked"))  # at most a block's own pairs
    whole = blocks.drop("codes", "holders").join(looked, "block", "left")

    def make():
        unpack = zstandard.ZstdDecompressor().decompress

        def one(packed: bytes, n: int, looked: pa.StructArray | None) -> tuple[np.ndarray, np.ndarray]:
            flat = np.frombuffer(unpack(packed), dtype="<i8")
            bounds, rest = flat[: n + 1], flat[n + 1 :]
            place, times = rest[: len(rest) // 2], rest[len(rest) // 2 :]
            if not len(place):
                return (np.zeros(n, dtype=np.int64),) * 2
            counts, best = looked.field("n_docs").to_numpy(), looked.field("best").to_numpy(zero_copy_only=False)
            sums = lambda x: np.diff(np.append(0, np.cumsum(x))[bounds])
            return sums(times * best[place]), sums(times * counts[place])

        def step(batch: pa.RecordBatch) -> dict:
            sizes = [len(x) for x in batch.column("doc_id")]
            found = [one(p.as_py(), n, x.values if x.is_valid else None) for p, n, x in zip(batch.column("packed"), sizes, batch.column("looked"), strict=True)]
            out = {c: pa.concat_arrays([batch.column(c).flatten()]) for c in ("doc_id", *_OWN, "groups_sha256")}
            return out | {"n_best": np.concatenate([x[0] for x in found] or [[]]), "count_sum": np.concatenate([x[1] for x in found] or [[]])}

        return step

    numbers = ", ".join(f"{c} bigint" for c in ("doc_id", *_OWN, "n_best", "count_sum"))
    return arrow_map(whole, make, f"{numbers}, groups_sha256 string")
