"""Line history, section splits, relevant ranks and the judge audit against loops."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from lodestar.operators import chunking, evaluation, history

ASKED = "ask_id bigint, path string, start bigint, end bigint"
HUNKS = "path string, seq bigint, old_start int, old_lines int, new_start int, new_lines int"


def edited(lines, random):
    """Another version of a file."""
    out = list(lines)
    for _ in range(random.randint(1, 4)):
        at = random.randint(0, len(out))
        out[at : at + random.choice([0, 0, 1, 3])] = [f"n{random.random()}" for _ in range(random.choice([0, 1, 2, 5]))]
    return out


def diff(old, new):
    """Hunks as a diff without context has them: no lines stand after the line before them."""
    out = []
    for tag, i, j, k, m in difflib.SequenceMatcher(None, old, new, autojunk=False).get_opcodes():
        if tag != "equal":
            out.append((i + 1 if j > i else i, j - i, k + 1 if m > k else k, m - k))
    return out


def followed(versions, start, end, limit):
    """Commits that changed lines start..end of the last version, newest first, by the lines themselves."""
    out = []
    for seq in range(len(versions) - 1, 0, -1):
        old, new = versions[seq - 1], versions[seq]
        matches = [(i + d, k + d) for i, k, n in difflib.SequenceMatcher(None, old, new, autojunk=False).get_matching_blocks() for d in range(n)]
        to_old = {b: a for a, b in matches}
        own = range(start - 1, end)
        kept = [to_old[x] for x in own if x in to_old]
        whole = len(kept) == len(own) and kept[-1] - kept[0] == len(own) - 1
        if not whole:
            out.append((seq, start, end))
            if len(out) == limit:
                break
        # The old range reaches from after the last line kept before it to before the first kept after it.
        if own[0] in to_old:
            first = to_old[own[0]]
        else:
            first = max((a for a, b in matches if b < own[0]), default=-1) + 1
        if own[-1] in to_old:
            last = to_old[own[-1]]
        else:
            last = min((a for a, b in matches if b > own[-1]), default=len(old)) - 1
        if first > last:
            break
        start, end = first + 1, last + 1
    return out


@pytest.mark.parametrize("together", [3, 1000])
def test_line_history_of_generated_edits(spark, together):
    random.seed(11)
    asked, hunks, want = [], [], set()
    for p in range(6):
        versions = [[f"p{p}l{i}" for i in range(30)]]
        for _ in range(25):
            versions.append(edited(versions[-1], random))
        for seq in range(1, len(versions)):
            hunks += [(f"f{p}", seq, *h) for h in diff(versions[seq - 1], versions[seq])]
        for a in range(8):
            start = random.randint(1, len(versions[-1]))
            end = min(len(versions[-1]), start + random.choice([0, 2, 12]))
            ask = p * 100 + a
            asked.append((ask, f"f{p}", start, end))
            want |= {(ask, n, *x) for n, x in enumerate(followed(versions, start, end, 4), 1)}
    asked.append((999, "unknown", 1, 5))
    found = history.line_history(spark.createDataFrame(asked, ASKED), spark.createDataFrame(hunks, HUNKS).repartition(5), 4, together)
    assert {tuple(r) for r in found.select("ask_id", "n", "seq", "start", "end").collect()} == want and len(want) > 60


def split(lines, start, end):
    out = []
    while end - start + 1 > 60:
        cut = next((c for c in range(start + 59, start + 30, -1) if not lines[c - 1].strip()), start + 59)
        out.append((start, cut))
        start = cut + 1
    return [*out, (start, end)]


@pytest.mark.parametrize("share", [0.0, 0.02, 0.1, 0.9])
def test_long_sections_are_cut_at_blank_lines(spark, share):
    random.seed(int(share * 100))
    rows, sections, want = [], [], set()
    for p in range(5):
        lines = [" " if random.random() < share else "x" for _ in range(random.choice([40, 300, 700]))]
        rows += [(f"f{p}", i, t) for i, t in enumerate(lines, 1)]
        bounds = [1, *sorted(random.sample(range(2, len(lines)), 3)), len(lines) + 1]
        for t, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
            sections.append((f"f{p}", f"t{t}", a, b - 1))
            want |= {(f"f{p}", f"t{t}", x, y) for x, y in split(lines, a, b - 1)}
    got = chunking.split_long(spark.createDataFrame(sections, "path string, title string, start int, end int"), spark.createDataFrame(rows, "path string, line int, text string"))
    assert {tuple(r) for r in got.select("path", "title", "start", "end").collect()} == want


def test_first_relevant_ranks(spark):
    hits = [(1, "bm25", 1, False, "a.py:1-9", "a.py", 1, 9), (1, "bm25", 2, False, "a.py:100-300", "a.py", 100, 300), (1, "bm25", 3, True, "PR#5", None, None, None), (1, "dense", 1, False, "b.py:1-2", "b.py", 1, 2), (2, "bm25", 4, False, "w.py:1-2", "w.py", 1, 2), (2, "dense", 2, True, "`pr#5`", None, None, None), (3, "bm25", 1, False, "a.py:1-9", "a.py", 1, 9)]
    gold = [(1, False, None, "a.py", 290, 400, False), (1, True, "pr#5", None, None, None, False), (2, False, None, "w.py", None, None, True), (2, True, "PR#5", None, None, None, False)]
    frame = spark.createDataFrame(hits, "query_id int, mode string, rank int, is_history boolean, ref string, path string, start int, end int")
    golds = spark.createDataFrame(gold, "query_id int, is_history boolean, ref string, path string, start int, end int, whole boolean")
    ranks = evaluation.first_relevant(frame, golds, ["mode"])
    assert {tuple(r) for r in ranks.collect()} == {(1, "bm25", 2), (1, "dense", None), (2, "bm25", 4), (2, "dense", 2)}
    assert {r["mode"]: (r["n"], r["recall_1"], r["recall_5"]) for r in evaluation.recall_mrr(ranks, ["mode"]).collect()} == {"bm25": (2, 0.0, 1.0), "dense": (2, 0.0, 0.5)}


def test_judge_audit(spark):
    fact = lambda *c: [(f"f{i}", x) for i, x in enumerate(c)]
    records = spark.createDataFrame(
        [("a", "s", fact(True, False), True, False, True, False), ("b", "s", fact(True), True, False, True, False), ("c", "s", [], True, True, False, False), ("d", "t", fact(True, True), True, False, True, False), ("e", "t", None, False, True, False, False)],
        "id string, system string, key_facts array<struct<fact:string,covered:boolean>>, answerable boolean, declined boolean, judged boolean, contradicts boolean",
    )
    replies = spark.createDataFrame([("a", "s", "yes\nYES"), ("b", "s", "maybe"), ("c", "s", ""), ("d", "t", "NO\nYES")], "id string, system string, reply string")
    decisions = evaluation.judge_decisions(records, replies)
    assert {tuple(r) for r in decisions.collect()} == {("a", "s", 0, "f0", True, True), ("a", "s", 1, "f1", False, True), ("d", "t", 0, "f0", True, False), ("d", "t", 1, "f1", True, True)}
    row = evaluation.judge_audit(records, decisions).first()
    assert (row["answers"], row["unparsed"], row["decisions"], row["disagreements"], row["judge_rate"], row["second_rate"]) == (2, 1, 4, 2, 0.75, 0.75)
    # b keeps the first judge's verdict; c declined a question that has an answer; e declined rightly.
    assert {r["system"]: (round(r["judge"], 6), round(r["second"], 6)) for r in evaluation.judged_correctness(records, decisions).collect()} == {"s": (0.5, 0.666667), "t": (1.0, 0.75)}
    none = evaluation.judge_audit(records, decisions.limit(0)).first()
    assert none["decisions"] == 0 and none["agreement"] is None


def test_mcnemar_of_many_pairs(spark):
    pairs = spark.range(20_000).select((F.col("id") < 9_900).alias("a"), (F.col("id") >= 9_900).alias("b"))
    from math import comb, isclose

    want = min(1.0, 2 * sum(comb(20_000, k) for k in range(9_901)) / 2**20_000)
    assert isclose(evaluation.mcnemar(pairs).first()["p_value"], want, rel_tol=1e-6)
