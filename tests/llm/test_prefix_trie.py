"""The prefix trie against a loop over all prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from lodestar.llm import prefix_trie as P
from lodestar.llm import queries as Q

ROWS = "conv_id bigint, turn bigint, role string, text string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def nodes(seqs):
    """Rows of NAMES for sequences {conv_id: [(role, text), ...]}."""
    members = defaultdict(list)
    for c in sorted(seqs):
        for d in range(len(seqs[c]) + 1):
            members[tuple(seqs[c][:d])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p in sorted(members, key=len, reverse=True):
        leaves[p] += not children[p]
        saved[p] += (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        if p:
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    return sorted((m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(",".join(str(c) for c in m if len(seqs[c]) == len(p)).encode()).hexdigest()) for p, m in members.items())


def sequences(rows):
    """Conversations of rows without ties."""
    out = defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        out[c].append((r or "", x or ""))
    return dict(out)


def borrowed(seqs):
    def one(c):
        h = zlib.crc32(str(c).encode()) % 9
        return seqs.get(c - c % 5, [])[:h] + seqs[c][h:]

    return {c: one(c) for c in seqs}


def got(frame):
    return sorted(tuple(r[c] for c in NAMES) for r in frame.collect())


@pytest.mark.parametrize("local", [1, 7, 100_000])
def test_trie_of_shared_starts(spark, monkeypatch, local):
    random.seed(local)
    monkeypatch.setattr(P, "BROADCAST_ROWS", 0 if local == 7 else 200_000)
    rows = []
    for c in range(90):
        kind = c % 3
        seq = ["hello"] * (12 if kind else random.randint(0, 3)) + ([random.choice("abcé") * random.randint(0, 2) for _ in range(random.randint(0, 4))] if kind < 2 else [])
        rows += [(c * 7, t, random.choice(["user", None]) if kind == 1 and t > 12 else "user", x) for t, x in enumerate(seq)]
    seqs = sequences(rows)
    lengths = spark.createDataFrame([(c * 7, len(seqs.get(c * 7, []))) for c in range(90)], "conv_id bigint, n bigint")
    turns, _ = P.coded_turns(spark.createDataFrame(rows, ROWS))
    want = nodes({c * 7: seqs.get(c * 7, []) for c in range(90)})
    assert got(P.node_table(P.prefix_trie(turns, lengths, local))) == want


def test_query_of_the_given_table(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = nodes(borrowed(sequences(rows)))
    assert got(Q.op11_prefix_trie(spark, data)) == want


def test_nulls_repeats_long_texts_and_extra_columns(spark, tmp_path):
    long_ = "wörd " * 50_000
    rows = [(1, None, None, None), (1, 2, "user", long_), (0, 1, "user", "a"), (0, 2, "user", long_), (None, 1, "user", "x"), (3, 5, "user", "b"), (3, 9, "", ""), (2, 5, "user", "b"), (2, 9, None, ""), (7, 1, "r", "t"), (7, 1, "r", "t")]
    frame = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], ROWS + ", pos int, item string, n string")
    frame.write.parquet(str(tmp_path / "conversations.parquet"))
    plain = {1: [("", ""), ("user", long_)], 0: [("user", "a"), ("user", long_)], 3: [("user", "b"), ("", "")], 2: [("user", "b"), ("", "")], 7: [("r", "t")] * 2}
    assert got(P.node_table(P.conversation_trie(frame))) == nodes(plain)
    assert got(Q.op11_prefix_trie(spark, str(tmp_path))) == nodes(borrowed(plain))
    # Tied turns: in order of their hash, whatever the order of rows.
    tied = [(1, 1, "u", x) for x in "abcd"]
    assert got(P.node_table(P.conversation_trie(spark.createDataFrame(tied, ROWS)))) == got(P.node_table(P.conversation_trie(spark.createDataFrame(tied[::-1], ROWS))))


def test_empty_table(spark):
    assert P.node_table(P.conversation_trie(spark.createDataFrame([], ROWS))).collect() == []


def test_digest_of_many_ends(spark):
    ids = [*range(-5_000, 5_000, 3), 10**12]
    ends = spark.createDataFrame([(-5_000, 4, i) for i in reversed(ids)] + [(1, 2, 1)], "conv_id bigint, depth bigint, member bigint")
    want = {(-5_000, 4): hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), (1, 2): hashlib.sha256(b"1").hexdigest()}
    assert {(r[0], r[1]): r[2] for r in P.end_digests(ends).collect()} == want
