"""Exact BPE encoding with reuse: content-defined chunks, repaired joins and a memo of words.

A text is cut where a rolling hash of its code points meets a mask, so a passage that documents
share is cut alike in all of them. A chunk met before in the task is not encoded again. Tokens near
a cut can differ from those of the whole text, so each join is repaired: the end of the left chunk
and the start of the right one, back and forth to the nearest place where tokens surely break, are
encoded again with one unit of overlap on either side, and the window is widened until the overlaps
agree with what the chunks have. A unit is a stretch that starts at a space after a non-space.

Ids are those of the tokenizers library. What is plain (Latin letters and general punctuation) is
encoded by tiktoken over the same vocabulary, which is many times as fast; the rest, where character
tables could differ, and texts with a special token's string go to the library. Both merge alike:
tiktoken joins any two neighbours whose union is a token, the library only listed pairs, and inside
the span of a token every merge but those across its ends happens as it does in the token alone; so
they agree wherever each token, taken alone, is merged to itself. `unreachable` checks that.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from itertools import chain, compress, repeat
from operator import is_, not_

import numpy as np
import tiktoken

from lodestar.llm.arrow import held
from lodestar.llm.words import mix

#: White space, and the pieces of the byte-level and of the word vocabulary.
SPACES = "\t-\r \x85\xa0  -     　"
BYTE_PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACES}\p{{L}}\p{{N}}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
#: What is not plain has code points whose class may differ between libraries.
_ODD = re.compile("[^\\x00-\\x1b\\x20-ɏ‐-‧‰-⁞€™]").search
#: The word vocabulary's pieces of what is plain, for the re library; two letters are lower cases of Ⱥ and Ⱦ.
_PLAIN_PIECES = "'s|'t|'re|'ve|'m|'ll|'d|[a-zA-ZªµºÀ-ÖØ-öø-ɏⱥⱦ]+|[0-9²³¹¼-¾]|[^" + SPACES + "0-9²³¹¼-¾a-zA-ZªµºÀ-ÖØ-öø-ɏⱥⱦ]+"


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself, or one above 255."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()
_BYTES = {c: b for b, c in _LETTERS.items()}


def _bytes_of(letters: str) -> bytes:
    return bytes(_BYTES[c] for c in letters)


def _vocabulary(path: str) -> tuple[dict[str, int], list[tuple[str, str]], str]:
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return model["vocab"], merges, model.get("end_of_word_suffix") or ""


def unreachable(path: str) -> list[str]:
    """Tokens that the merges do not build from their own letters."""
    vocabulary, merges, suffix = _vocabulary(path)
    ranks = {pair: i for i, pair in reversed(list(enumerate(merges)))}
    out = []
    for left, right in merges:
        token = left + right
        ends = bool(suffix) and token.endswith(suffix)
        parts = list(token[: -len(suffix)]) if ends else list(token)
        if ends:
            parts[-1] += suffix
        while len(parts) > 1:
            rank, at = min((ranks.get(pair, len(ranks)), i) for i, pair in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == len(ranks):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) > 1 or token not in vocabulary:
            out.append(token)
    return out


def load_tokenizer(path: str):
    """A tokenizer of the library without truncation or padding."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _specials(tokenizer) -> list[str]:
    return [t.content for t in tokenizer.get_added_tokens_decoder().values()]


_SURE = re.compile(f"(?<=[^{SPACES}]) ")


def ends(text: str) -> tuple[str, str, str, str]:
    """First unit, the one after it, the one before the last, last unit; without a middle, (text, "", "", "").

    A unit starts at a space after a non-space. Tokens surely part there, whatever surrounds: only
    runs of white space hold a space that is not their first character, and no piece looks back.
    """
    starts, at = [], 0
    while len(starts) < 2 and (found := _SURE.search(text, at)):
        starts.append(found.start())
        at = found.start() + 1
    if len(starts) < 2:
        return text, "", "", ""
    low, last, found = starts[0], [], len(text)
    while len(last) < 2 and (found := text.rfind(" ", low + 1, found)) > 0:
        if not text[found - 1].isspace():
            last.append(found)
    if len(last) < 2:
        return text, "", "", ""
    return text[:low], text[low : starts[1]], text[last[1] : last[0]], text[last[0] :]


# ---- content-defined chunks -------------------------------------------------------------------
WINDOW, MEAN, LEAST, MOST = 32, 1024, 256, 8192


def cuts(text: str) -> list[int]:
    """Ends of the chunks of text: a chunk has LEAST to MOST code points, about MEAN, but the last."""
    n = len(text)
    if n <= LEAST:
        return [n] if n else []
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    rolled = mix(points.astype(np.uint64)).astype(np.uint32)
    width = 1
    while width < WINDOW:  # sums over twice the width, each step shifted by the width
        wider = rolled.copy()
        wider[width:] += rolled[:-width] << np.uint32(width)
        rolled, width = wider, 2 * width
    marks = np.flatnonzero(rolled >> np.uint32(32 - MEAN.bit_length() + 1) == 0) + 1
    out, start = [], 0
    for at in [*marks.tolist(), n]:
        while at - start > MOST:
            start += MOST
            out.append(start)
        if at - start >= LEAST and at < n:
            out.append(at)
            start = at
    if start < n:
        out.append(n)
    return out


class _Chunk:
    """A chunk's first and last unit, which its neighbours may change, and the ids of those between."""

    __slots__ = ("after", "before", "first", "ids", "last")


class ByteEncoder:
    """encode(text) gives the ids exactly as the library does for the whole text."""

    def __init__(self, path: str, held_chars: int = 24_000_000):
        self.tokenizer = load_tokenizer(path)
        self.specials = _specials(self.tokenizer)
        vocabulary, _, _ = _vocabulary(path)
        ranks = {_bytes_of(t): i for t, i in vocabulary.items() if t not in self.specials}
        self.fast = tiktoken.Encoding("byte", pat_str=BYTE_PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.chunks: dict[str, _Chunk] = {}
        self.held, self.limit = 0, held_chars
        self.reused = self.made = self.widened = 0

    def _ids(self, text: str) -> list[int]:
        """Ids of a stretch of units, without regard to chunks."""
        return self.tokenizer.encode(text, add_special_tokens=False).ids if _ODD(text) else self.fast(text)

    def _chunk(self, text: str) -> _Chunk:
        if (chunk := self.chunks.get(text)) is not None:
            self.reused += 1
            return chunk
        if self.held > self.limit:  # bounded: start anew
            self.chunks, self.held = {}, 0
        self.made += 1
        self.held += len(text)
        chunk = self.chunks[text] = _Chunk()
        chunk.first, chunk.after, chunk.before, chunk.last = ends(text)
        body = text[len(chunk.first) : len(text) - len(chunk.last)]
        chunk.ids = np.array(self._ids(body) if chunk.after else [], dtype=np.int32)
        return chunk

    def _joined(self, window: str, before: str, after: str) -> list[int] | None:
        """Ids of window, encoded again with the units around it; None if those come out otherwise."""
        ids, left, right = self._ids(before + window + after), self._ids(before), self._ids(after)
        low, high = len(left), len(ids) - len(right)
        if low > high or ids[:low] != left or ids[high:] != right:
            return None
        return ids[low:high]

    def encode(self, text: str) -> np.ndarray:
        """Ids of one text."""
        if any(s in text for s in self.specials):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.int32)
        out, window, before = [], "", ""
        stops = cuts(text)
        for a, b in zip([0, *stops], stops, strict=False):
            chunk = self._chunk(text[a:b])
            window += chunk.first
            if not chunk.after:  # nothing in it surely stands: the window grows over all of it
                self.widened += 1
                continue
            ids = self._joined(window, before, chunk.after)
            if ids is None:  # no agreement here either: the window grows over the chunk
                self.widened += 1
                window += text[a + len(chunk.first) : b]
                continue
            out += [np.array(ids, dtype=np.int32), chunk.ids]
            window, before = chunk.last, chunk.before
        if window:
            ids = self._joined(window, before, "")
            if ids is None:
                return np.array(self._ids(text), dtype=np.int32)
            out.append(np.array(ids, dtype=np.int32))
        return np.concatenate(out) if out else np.zeros(0, dtype=np.int32)


class WordEncoder:
    """Ids of whole texts under a lower-casing word vocabulary whose pieces hold no white space.

    Words between white space are looked up in a memo. Common words come early, so a memo of more
    than `limit` words takes no more of them; only when it lacks more than half of a batch's words
    does a new one begin, which takes over what it needs of the old one. New words of a batch are
    encoded together: their pieces, each with MARK for the end of a word, go to tiktoken as one
    string, and the ids are parted again at the tokens that end in MARK.
    """

    MARK = "\x01"

    def __init__(self, path: str, limit: int = 150_000):
        self.tokenizer = load_tokenizer(path)
        self.specials = _specials(self.tokenizer)
        vocabulary, merges, suffix = _vocabulary(path)
        mark = self.MARK.encode()
        named = {(_bytes_of(t.removesuffix(suffix)) + mark * t.endswith(suffix)): i for t, i in vocabulary.items() if t not in self.specials}
        order = [bytes([b]) for b in range(256)] + [bytes([b]) + mark for b in range(256)]
        order += [_bytes_of(left) + _bytes_of(right.removesuffix(suffix)) + mark * right.endswith(suffix) for left, right in merges]
        order = list(dict.fromkeys(order))  # ranks: the mark joins its letter before any other merge
        self.fast = tiktoken.Encoding("word", pat_str=f"[^{self.MARK}]+{self.MARK}", mergeable_ranks={t: i for i, t in enumerate(order)}, special_tokens={}).encode_ordinary
        self.named = np.array([named.get(t, -1) for t in order], dtype=np.int64)
        self.ends = np.array([t.endswith(mark) for t in order])
        self.line = order.index(b"\n" + mark)
        self.find = re.compile(_PLAIN_PIECES + "|\n").findall
        self.limit = limit
        self.now: dict[str, bytes] = {}  # ids as little-endian unsigned 32-bit numbers
        self.old: dict[str, bytes] = {}

    def forget(self) -> None:
        """Empties the memo; called between tasks."""
        self.now, self.old = {}, {}

    def _learn(self, words: set[str], memo: dict[str, bytes]) -> None:
        """Puts words into memo."""
        new = list(words)
        if self.old:
            new = []
            for word in words:
                if (ids := self.old.get(word)) is None:
                    new.append(word)
                else:
                    memo[word] = ids
        # A word of letters alone is one piece. The pieces of the others come from one pass over them
        # all, in which a line end, which no word holds, is a piece of its own after each word.
        alone = list(map(str.isalpha, new))
        whole, parted = list(compress(new, alone)), list(compress(new, map(not_, alone)))
        pieces = whole + self.find("\n".join([*parted, ""]))
        if not pieces:
            return
        ranks = np.array(self.fast(self.MARK.join([*pieces, ""])))
        ids = self.named[ranks].astype("<u4").tobytes()
        lines = np.flatnonzero(ranks == self.line)
        stops = np.concatenate((np.flatnonzero(self.ends[ranks])[: len(whole)] + 1, lines))
        starts = np.concatenate(([0], stops[:-1]))
        starts[len(whole) + 1 :] += 1  # behind the line end
        memo.update(zip(chain(whole, parted), [ids[a:b] for a, b in zip((4 * starts).tolist(), (4 * stops).tolist(), strict=True)], strict=True))

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        words: list[list[str] | None] = []
        for text in texts:
            if _ODD(text) or self.MARK in text or any(s in text for s in self.specials):
                words.append(None)
            else:
                words.append((text if text.isascii() else unicodedata.normalize("NFC", text)).lower().split())
        own = list(chain.from_iterable(filter(None, words)))
        ids = list(map(self.now.get, own))
        if lacking := list(compress(range(len(ids)), map(is_, ids, repeat(None)))):
            memo = self.now
            if len(memo) > self.limit:
                self.old, memo = {}, {}
                if 2 * len(lacking) > len(own):
                    self.now, self.old = memo, self.now
            asked = list(map(own.__getitem__, lacking))
            self._learn(set(asked), memo)
            for i, x in zip(lacking, map(memo.__getitem__, asked), strict=True):
                ids[i] = x
        out, at = [], 0
        for text, some in zip(texts, words, strict=True):
            if some is None:
                out.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4"))
            else:
                out.append(np.frombuffer(b"".join(ids[at : at + len(some)]), dtype="<u4"))
                at += len(some)
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of one text."""
        return self.encode_batch([text])[0].tolist()


def byte_encoder(path: str) -> ByteEncoder:
    """The process's encoder for a byte-level vocabulary; its key for arrow_map is the path."""
    return held(path, lambda: ByteEncoder(path))


def word_encoder(path: str) -> WordEncoder:
    """The process's encoder for a word vocabulary; its key for arrow_map is the path."""
    return held(path, lambda: WordEncoder(path))
