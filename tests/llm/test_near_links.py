"""Buckets of many members below the threshold, and recall at the threshold, beside brute force."""

import random

import pytest

from lodestar import session
from lodestar.llm import graph, near_duplicates
from tests.llm import brute

BASE = [f"t{i}" for i in range(300)]


def template(n: int, differ: int, seed: int = 1) -> dict:
    """Texts of one template, each with a run of words of its own."""
    dice, out = random.Random(seed), {}
    for k in range(n):
        words, at = list(BASE), dice.randrange(300 - differ)
        words[at : at + differ] = [f"u{k}_{i}" for i in range(differ)]
        out[k] = " ".join(words)
    return out


def found(spark, texts: dict, percent: int) -> dict:
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(4)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates.near_duplicates(docs, percent).collect()}


@pytest.fixture
def pairs(monkeypatch):
    """(members, pairs) of every join by prefixes."""
    seen, whole = [], near_duplicates._prefix_pairs

    def spy(dense, facts, percent):
        out = whole(dense, facts, percent)
        seen.append((dense.count(), out.count()))
        return out

    monkeypatch.setattr(near_duplicates, "_prefix_pairs", spy)
    return seen


def test_a_template_below_the_threshold_makes_no_pairs(spark, pairs):
    texts = template(600, 40)
    assert found(spark, texts, 85) == {d: (296, d) for d in texts}
    assert pairs and pairs[0][0] > 500 and pairs[0][1] < 60


@pytest.mark.parametrize("percent", [80, 85])
def test_wide_buckets_equal_brute_force(spark, pairs, monkeypatch, percent):
    """Sizes, own runs, options that several texts share, and links across all of them."""
    monkeypatch.setattr(near_duplicates, "WIDE", 1)
    dice, texts = random.Random(percent), {}
    for k in range(240):
        words = list(BASE[: dice.randrange(240, 301)])
        for _ in range(dice.randrange(1, 5)):
            at, n, name = dice.randrange(len(words) - 12), dice.randrange(1, 12), dice.choice([f"u{k}", "v", f"o{k % 7}"])
            words[at : at + n] = [f"{name}_{i}" for i in range(dice.choice([n, 2]))]
        texts[k] = " ".join(words)
    assert found(spark, texts, percent) == brute.near(texts, percent)
    assert pairs and pairs[0][0] > 20


def test_prefixes_lose_no_link(spark):
    """All pairs of sets of any sizes, whatever the buckets say."""
    dice = random.Random(9)
    sets = {k: set(dice.sample(range(30), dice.randrange(1, 26))) for k in range(120)}
    sets |= {k: set(sets[k - 200]) ^ set(dice.sample(range(30), 2)) for k in range(200, 260)}
    facts = spark.createDataFrame([(k, len(s), list(s)) for k, s in sets.items() if s], "id bigint, n bigint, shingles array<bigint>")
    dense = facts.selectExpr("id", "id as c", "true as outside")
    for percent in (50, 80, 85, 100):
        got = {tuple(r) for r in near_duplicates._prefix_pairs(dense, facts, percent).collect()}
        for a, x in sets.items():
            for b, y in sets.items():
                if a < b and x and y and 100 * len(x & y) >= percent * len(x | y):
                    assert (a, b) in got


def test_recall_at_the_threshold(spark):
    """Pairs of 0.85 to 0.87, each of words of its own."""
    dice, texts = random.Random(3), {}
    while len(texts) < 1200:
        k = len(texts)
        one = [f"w{k}_{i}" for i in range(dice.randrange(120, 400))]
        other = one[: int(len(one) * dice.uniform(0.85, 0.88))]
        a, b = brute.shingles(" ".join(one)), brute.shingles(" ".join(other))
        if 85 * len(a | b) <= 100 * len(a & b) <= 87 * len(a | b):
            texts |= {k: " ".join(one), k + 1: " ".join(other)}
    got = found(spark, texts, 85)
    assert sum(got[k + 1][1] == k for k in range(0, 1200, 2)) >= 599


def test_sides_that_are_not_few(spark, monkeypatch):
    """The forms without broadcast hints give the same."""
    for module in (session, graph, near_duplicates):
        monkeypatch.setattr(module, "BROADCAST_ROWS", 0)
    texts = template(30, 14) | {100 + k: t for k, t in template(12, 40, seed=2).items()} | {200: BASE[0], 201: None}
    assert found(spark, texts, 85) == brute.near(texts)
