"""Cross-tokenizer alignment against a walk over byte offsets."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as T
import pytest

from lodestar.llm import alignment as A
from lodestar.llm import queries as Q

BYTE, PIECE = str(T.path("byte_bpe_50k.json")), str(T.path("piece_bpe_32k.model"))
ROWS = "doc_id bigint, text string"
NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(BYTE)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=PIECE)


def byte_letters():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


LETTERS = byte_letters()


def walk(libraries, text):
    """Groups [(a ids, b ids)] of a text by walking both lists of offsets."""
    a, b = libraries
    if not text:
        return []
    x = a.encode(" " + text, add_special_tokens=False).ids
    y = b.encode(text)
    x_bytes = [bytes(LETTERS[c] for c in a.id_to_token(i)) for i in x]
    y_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in y)]
    if not b"".join(x_bytes) == b"".join(y_bytes) == (" " + text).encode():
        return []
    out, i, j, at, to = [], 0, 0, 0, 0
    one, other = [], []
    while i < len(x) or j < len(y):
        if at <= to:
            one.append(x[i])
            at += len(x_bytes[i])
            i += 1
        else:
            other.append(y[j])
            to += len(y_bytes[j])
            j += 1
        if at == to and one and other:
            out.append((one, other))
            one, other = [], []
    return out


def brute(libraries, docs):
    found = [(d, walk(libraries, t)) for d, t in docs]
    links = [Counter((x, y) for one, other in g for x in one for y in other) for _, g in found]
    held = Counter(p for c in links for p in c)
    most = Counter()
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    out = []
    for (d, g), c in zip(found, links, strict=True):
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out.append((d, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), c.total(), sum(n for p, n in c.items() if held[p] == most[p[0]]), sum(n * held[p] for p, n in c.items()), hashlib.sha256(said.encode()).hexdigest() if g else ""))
    return sorted(out, key=repr)


def got(frame):
    return sorted((tuple(r[c] for c in NAMES) for r in frame.collect()), key=repr)


TEXTS = [
    None, "", " ", "a", "hello world", "hello  world", " lead", "trail ", "tabs\tand\nlines\r\n\n x", "<|endoftext|> and <s></s><unk> <0x41>", "日本語のテキスト、とても長い。", "\U0001f600\U0001f468‍\U0001f469", "▁▁ a", "naïve Ünïcödé", "=" * 500,
    "ー" * 300, "\x00\x1f", "a b　c", "ﬁ ligature ½", "é", "the the the the", "hello world", "0123456789" * 20, "\x1c\x1d odd \x85",
]


def test_odd_texts(spark, libraries):
    docs = list(enumerate(TEXTS)) + [(None, "hello world"), (4, "hello world"), (99, "lange Wörter " * 20_000)]
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], ROWS + ", block int, codes string").repartition(3)
    want = brute(libraries, docs)
    assert got(A.alignment_statistics(frame, BYTE, PIECE)) == want
    assert sum(r[3] > 0 for r in want) > 20 and sum(r[3] == 0 for r in want) >= 2


def test_query_of_the_given_table(spark, data, libraries):
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    assert got(Q.op13_token_alignment(spark, data)) == brute(libraries, docs)


def test_groups_themselves(spark, libraries):
    docs = list(enumerate(TEXTS))
    rows = A.token_groups(spark.createDataFrame(docs, ROWS), BYTE, PIECE).collect()
    assert {r["doc_id"]: [(g["a"], g["b"]) for g in r["groups"]] for r in rows} == {d: walk(libraries, t) for d, t in docs}


def test_bitsets():
    random.seed(3)
    for size in (1, 63, 64, 65, 1000):
        places = np.array(sorted({*random.sample(range(size), random.randint(1, size)), size - 1}))
        bits = A.bitset(places, size)
        assert A.select(bits).tolist() == places.tolist()
        assert A.rank(bits, np.arange(size)).tolist() == [int((places <= i).sum()) for i in range(size)]


@pytest.mark.parametrize("links", [1, 5, 50, 10**6])
def test_pairs_of_large_groups(links):
    random.seed(links)
    sizes = np.array([1, 2, 3, 1])
    a, b = [], []
    for _ in range(6):
        x = [random.randrange(4) for _ in range(random.randint(0, 40))]
        n = int(sizes[x].sum())
        y = []
        while (left := n - int(sizes[y].sum() if y else 0)) > 0:
            y.append(random.choice([i for i in range(4) if sizes[i] <= left]))
        a.append(np.array(x, dtype=np.int64))
        b.append(np.array(y, dtype=np.int64))
    found = A.grouped(a, b, sizes, sizes)
    a0, b0 = found.starts()
    want = Counter()
    for g, t in enumerate(found.text):
        for x in found.a[a0[g] : found.a_stops[g]]:
            for y in found.b[b0[g] : found.b_stops[g]]:
                want[int(t), int(x) * 4 + int(y)] += 1
    rows = list(zip(*(x.tolist() for x in A.pair_counts(found, 4, links)), strict=True))
    assert rows == sorted((t, c, n) for (t, c), n in want.items())


def test_empty_table(spark):
    assert A.alignment_statistics(spark.createDataFrame([], ROWS), BYTE, PIECE).collect() == []
