"""The document operators on edge cases and against plain versions."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from public_tokenizers import path as tokenizer_path
from tokenizers import Tokenizer

from lodestar.llm import encoding, fingerprints, licenses, near_duplicates, packing, quality_model, quality_rules, queries, substrings
from tests.llm import brute

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, kept string, marks string, halves string"
WORDS = [f"w{i}" for i in range(400)]


def sentence(dice, n):
    return " ".join(dice.choice(WORDS) for _ in range(n))


def corpus():
    """Nulls, empties, copies, near copies, shared passages, long texts and odd characters."""
    dice = random.Random(5)
    base, shared, long_ = sentence(dice, 120), sentence(dice, 60), sentence(dice, 30_000)
    texts = [None, "", "   \n\t ", "one two", "One TWO", "a b c d", base, base, base.upper(), base.replace(" ", "\n"), long_, long_ + " end"]
    for k in range(12):  # near copies on either side of the threshold
        words = base.split()
        for _ in range(1 + k % 4):
            words[dice.randrange(len(words))] = f"x{k}"
        texts.append(" ".join(words))
    texts += [f"{sentence(dice, 25)} {shared} {sentence(dice, 25)}" for _ in range(8)]
    texts += [shared + " " + shared, "The The " * 300, sentence(dice, 20) + "\n" + sentence(dice, 20), "ﬁne  Straße\u00a0É E\u0301 日本語 <|endoftext|> 😀", "İstanbul ΣΑΣ x\x1cy\x85z", "!!! " * 80]
    texts += [sentence(dice, dice.randrange(1, 90)) for _ in range(30)]
    return dict(enumerate(texts, start=3))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, "en", "s", 0, "x", "y", "z", "h") for d, t in corpus().items()], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(frame):
    out = {r["doc_id"]: r for r in frame.collect()}
    assert len(out) == frame.count()
    return out


def test_fingerprints(spark, docs, none):
    texts = corpus()
    got = by_id(fingerprints.with_neighbours(docs))
    want = brute.edited(texts)
    assert {d: (r["n_chars"], r["edited_sha256"]) for d, r in got.items()} == want
    order = sorted(texts, reverse=True)
    for d, following in zip(order, order[1:] + order[:1], strict=True):
        same = fingerprints.canonical(texts[d]) == fingerprints.canonical(texts[following])
        assert got[d]["near_next"] == float(same)
        assert (got[d]["fingerprint"] == got[following]["fingerprint"]) is same
    assert fingerprints.with_neighbours(none).count() == 0
    alone = fingerprints.with_neighbours(spark.createDataFrame([(1, "ab")], "doc_id bigint, text string")).first()
    assert alone["near_next"] == 1.0 and alone["edited_sha256"] == hashlib.sha256(b"aa").hexdigest()
    ties = fingerprints.with_neighbours(spark.createDataFrame([(1, "ab"), (1, "cd"), (None, "zz"), (1, "ab")], "doc_id bigint, text string"))
    assert ties.count() == 4


def test_colliding_digests_are_told_apart(docs):
    """With eight bits most digests collide; the fingerprints still follow the bytes."""
    got = by_id(fingerprints.fingerprints(docs.select("doc_id", "text"), bits=8))
    texts = corpus()
    for a in texts:
        for b in texts:
            same = fingerprints.canonical(texts[a]) == fingerprints.canonical(texts[b])
            assert (got[a]["fingerprint"] == got[b]["fingerprint"]) is same


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_every_token_is_reachable(name):
    """The condition under which both libraries merge alike."""
    assert encoding.unreachable(str(tokenizer_path(name))) == []


def test_encoders_equal_the_library():
    own, word = encoding.ByteEncoder(str(tokenizer_path("byte_bpe_50k.json"))), encoding.WordEncoder(str(tokenizer_path("word_bpe_49k.json")), limit=50)
    dice = random.Random(3)
    bits = ["the ", "a", " ", "  ", "\n", "\t", "'s", "'ll", "12", "3", "é", "日本", "😀", " ", "\u00a0", "...", "!", "<|endoftext|>", "x", "Foo bar ", "ß", "Σ", "İ", "\x1c", "\x85", "ﬁ", "e\u0301", "\r\n", "_", "ſ", "’s", "ǅ", "²", "\x01", "\x00"]
    texts = [t or "" for t in corpus().values()] + ["".join(dice.choice(bits) for _ in range(dice.choice([1, 5, 50, 900]))) for _ in range(600)]
    texts += [t.replace("<|endoftext|>", "") for t in texts[-300:]] + ["x" * 20_000, " " * 9000, "ab " * 9000]
    for k, t in enumerate(texts):
        assert own.encode(t).tolist() == own.tokenizer.encode(t, add_special_tokens=False).ids, k
    for k, (t, ids) in enumerate(zip(texts, word.encode_batch(texts), strict=True)):
        assert ids.tolist() == word.tokenizer.encode(t, add_special_tokens=False).ids, k
    assert own.reused and own.widened


def test_cuts_cover_and_follow_content():
    dice = random.Random(9)
    text = sentence(dice, 20_000)
    ends = encoding.cuts(text)
    assert ends[-1] == len(text) and all(0 < b - a <= encoding.MOST for a, b in zip([0, *ends], ends, strict=False))
    moved = encoding.cuts("prefix words here " + text)
    parts = lambda t, e: {t[a:b] for a, b in zip([0, *e], e, strict=False)}
    assert len(parts(text, ends) & parts("prefix words here " + text, moved)) > 0.8 * len(ends)


def test_round_trip(spark, docs, none):
    library = Tokenizer.from_file(str(tokenizer_path("byte_bpe_50k.json")))
    got = by_id(queries.encode_decode(docs, str(tokenizer_path("byte_bpe_50k.json"))))
    for d, t in corpus().items():
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert tuple(got[d])[1:] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    assert queries.encode_decode(none, str(tokenizer_path("byte_bpe_50k.json"))).count() == 0


def test_near_duplicates(spark, docs, none):
    got = by_id(near_duplicates.near_duplicates(docs, 85))
    want = brute.near(corpus())
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == want
    assert all(r["kept"] is (r["component_id"] == d) for d, r in got.items())
    assert near_duplicates.near_duplicates(none).count() == 0
    odd = near_duplicates.near_duplicates(spark.createDataFrame([(None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (9, None)], "doc_id bigint, text string"))
    assert sorted(map(tuple, odd.collect()), key=str) == sorted([(None, 2, None, True), (2, 2, 2, True), (2, 2, 2, True), (9, 0, 9, True)], key=str)


def test_chains_of_near_copies(spark):
    """Every text is linked to its neighbours alone; one component spans the chain."""
    words = sentence(random.Random(1), 200).split()
    texts = {100 - k: " ".join(words[k * 3 : 150 + k * 3]) for k in range(16)}
    want = brute.near(texts)
    got = by_id(near_duplicates.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"), 85))
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == want
    assert len({c for _, c in want.values()}) < len(texts)


def test_substring_dedup(spark, docs, none):
    got = by_id(substrings.substring_dedup(docs, keep_text=True))
    want = brute.substring(corpus())
    assert {d: (r["n_words"], r["n_removed"], r["kept_sha256"]) for d, r in got.items()} == want
    assert sum(r["n_removed"] for r in got.values()) > 1000
    assert all(r["kept_text"] == corpus()[d] for d, r in got.items() if not r["n_removed"])
    assert substrings.substring_dedup(none).count() == 0
    text = " ".join(WORDS[:30])
    odd = substrings.substring_dedup(spark.createDataFrame([(1, text), (1, text), (None, text), (5, text)], "doc_id bigint, text string"))
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in odd.collect()) == [(0, 0), (1, 0), (1, 0), (5, 30)]


@pytest.mark.parametrize("seed", range(4))
def test_substring_dedup_of_few_words(spark, seed):
    """A small vocabulary: repeats overlap, nest and repeat inside a text."""
    dice = random.Random(seed)
    runs = [" ".join(dice.choice("ab") for _ in range(dice.randrange(5, 60))) for _ in range(6)]
    texts = {k: " ".join(dice.choice([*runs, "c", "d e"]) for _ in range(dice.randrange(1, 9))) for k in range(25)}
    got = by_id(substrings.substring_dedup(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")))
    assert {d: (r["n_words"], r["n_removed"], r["kept_sha256"]) for d, r in got.items()} == brute.substring(texts)


def test_licenses(spark, docs, none):
    texts = corpus() | {900: "All rights RESERVED. cc-by all rights reserved", 901: "generalpublic license general  public\nlicense!", 902: "Released under teh MIT Licence.", 903: "CC BYTE accBY cc by2 cc, by", 904: "nothing here", 905: "Licensed under the Apache Lcense, Version 2.0"}
    frame = spark.createDataFrame([(d, t, "q") for d, t in texts.items()], "doc_id bigint, text string, labels string")
    got = by_id(licenses.license_scan(frame))
    assert {d: tuple(r)[1:6] for d, r in got.items()} == {d: brute.licenses(t) for d, t in texts.items()}
    assert got[902]["labels"] == "mit" and 0 < got[902]["score"] < 1 and got[902]["spans"][0]["edits"] >= 2
    assert "apache-2.0" in got[905]["labels"] and got[904]["labels"] == "" and got[904]["score"] == 0.0
    assert licenses.license_scan(none).count() == 0


def test_notices_with_edits_are_found():
    """Any notice with no more edits than allowed is found: the seeds miss none."""
    scanner, dice = licenses.Scanner(), random.Random(8)
    for notice, label in licenses.NOTICES.items():
        for _ in range(6):
            letters = list(notice)
            for _ in range(len(notice) // licenses.LETTERS_AN_EDIT):
                letters[dice.randrange(1, len(letters) - 1)] = dice.choice("qxz")
            found = scanner.find("some words " + "".join(letters) + " and more")
            assert label in {s.label for s in found}


def test_rules(spark, docs, none):
    got = by_id(quality_rules.quality_rules(docs.select("doc_id", "text", "lang", "kept")))
    for d, t in corpus().items():
        n, chars, symbols, lines, repeated = brute.rules(t)
        failed = n < 50 or 100 * repeated > 50 * n
        r = got[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (n, chars, symbols, lines, repeated, failed)
        assert not (failed and r["kept"])
    assert quality_rules.quality_rules(none).count() == 0
    assert quality_rules.quality_rules(spark.createDataFrame([(1, None, None)], "doc_id bigint, text string, lang string")).first()["kept"] is False


def test_rules_follow_labels(spark, data):
    got = quality_rules.quality_rules(spark.read.parquet(data.replace("0.001", "0.01") + "/documents.parquet"))
    rows = got.join(spark.read.parquet(data.replace("0.001", "0.01") + "/labels.parquet"), "doc_id").where("not base_failed").collect()
    assert sum(r["kept"] == (r["quality"] == 1) for r in rows) >= 0.98 * len(rows)


def test_distance():
    p, q = np.array([1, 2, 3]), np.array([2, 4, 6])
    assert quality_rules.distance(p, q) == pytest.approx(0, abs=1e-7)
    assert quality_rules.distance(np.array([1, 0]), np.array([0, 1])) == pytest.approx(1)
    assert quality_rules.distance(np.zeros(2), q[:2]) == 1.0


def test_classifier(spark, data, docs, none):
    data = data.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    got = by_id(quality_model.quality_scores(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang"), labels))
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert all(r["held_out"] is (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in got.items())
    held = [d for d in known if got[d]["held_out"]]
    assert sum(got[d]["predicted"] == known[d] for d in held) >= 0.95 * len(held)
    assert all(r["predicted"] == int(r["score"] >= quality_model.THRESHOLD) and 0 <= r["score"] <= 1 for r in got.values())
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 then 1 - quality else quality end as quality")
    again = by_id(quality_model.quality_scores(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text"), flipped))
    assert {d: r["score"] for d, r in again.items()} == {d: r["score"] for d, r in got.items()}
    some = quality_model.quality_scores(docs, spark.createDataFrame([(3, 1), (4, None)], "doc_id bigint, quality int"))
    assert some.count() == len(corpus()) and some.where("score is null").count() == 0
    assert quality_model.quality_scores(none, labels).count() == 0


def check_packing(rows, texts, capacity):
    library = Tokenizer.from_file(str(tokenizer_path("word_bpe_49k.json")))
    held = {}
    for r in rows:
        held.setdefault(r["doc_id"], []).append(r)
    for d, t in texts.items():
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want = [(i, a, min(capacity, len(ids) - a), zlib.crc32(ids[a : a + capacity].tobytes())) for i, a in enumerate(range(0, len(ids), capacity))]
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in held[d]) == want
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return bins


def test_packing(spark, docs, none):
    path = str(tokenizer_path("word_bpe_49k.json"))
    rows = packing.packed_documents(docs, path, capacity=512).collect()
    bins = check_packing(rows, corpus(), 512)
    plain, loads = [], []
    sizes = [r["length"] for r in rows]
    packing.best_fit(plain, loads, sorted(range(len(sizes)), key=lambda i: -sizes[i]), sizes, 512)
    assert len(bins) <= len(loads)
    assert packing.packed_documents(none, path).count() == 0
    twice = packing.packed_documents(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id bigint, text string"), path)
    assert twice.count() == 3 and twice.select("sequence_id").distinct().count() == 1


def test_packing_over_levels(spark):
    dice = random.Random(2)
    sizes = [dice.choice([dice.randrange(1, 60), dice.randrange(1, 1001)]) for _ in range(900)] + [1000] * 5 + [501] * 11
    items = spark.createDataFrame(list(enumerate(sizes)), "item bigint, length bigint")
    got = packing.pack(items, 1000, shard_items=150).collect()
    assert sorted(r["item"] for r in got) == list(range(len(sizes)))
    loads = {}
    for r in got:
        loads[r["sequence_id"]] = loads.get(r["sequence_id"], 0) + sizes[r["item"]]
    assert max(loads.values()) <= 1000 and len(loads) <= 1.02 * sum(sizes) / 1000 + 2


def test_crossover_keeps_every_item():
    dice = random.Random(4)
    sizes = [dice.randrange(1, 400) for _ in range(300)]
    people = []
    for seed in range(2):
        bins, loads = [], []
        order = list(range(300))
        random.Random(seed).shuffle(order)
        packing.best_fit(bins, loads, order, sizes, 1000)
        people.append((bins, loads))
    bins, loads = packing.crossover(*people, sizes, 1000, dice)
    assert sorted(i for b in bins for i in b) == list(range(300))
    assert [sum(sizes[i] for i in b) for b in bins] == loads and max(loads) <= 1000
    assert len(packing.evolve(sizes, 1000, 1)[1]) <= len(people[0][1])
