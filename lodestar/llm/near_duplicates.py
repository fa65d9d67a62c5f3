"""MinHash near-duplicate detection with tensored banding and exact verification.

Two small collections of half keys are taken from a document's shingle set: t half keys in each,
every half key made of ROWS minima. A table key pairs half key i of the first collection with half
key j of the second, so t**2 tables cost only 2 * t * ROWS minima. Two sets of similarity s share a
table with probability (1 - (1 - s**ROWS)**t)**2. t is the smallest number for which a collection
misses a pair at the threshold with probability MISS at most (13 at 0.80, 10 at 0.85); every larger
similarity does better.

Equal word sequences are one class before any key is made. A half key that only one class has is in
no bucket of two, so half keys are counted first and table keys are made of repeated ones alone.
Candidates are the classes that share a table key. First every bucket compares its members with one
leader; the links found give components. Then, in buckets of several components, the members outside
the largest one are compared with one member of it, and what is still outside after that, where it is
at most WIDE members, with all members of other components: at most WIDE pairs a member. Pairs of one
component cannot change the result and are never made.

Buckets that leave more outside (pages of one template just below the threshold) make no such pairs.
Their members are joined by prefixes of their sets, which loses nothing: shingles are ordered from
rare to frequent, and two sets that can be linked share one of the few that come first in both, so
that pages that differ in shingles of their own never meet. How many come first follows from both
sizes, so sets are dealt into bands of sizes STEP apart and joined band by band. A shingle that one
set alone has counts in a prefix and is not shuffled to the join.

A pair is made only if it can be linked: a class has a sketch, the parities of the numbers of its
shingles in each of some thousand classes of their hash (about 3 bits a shingle). Two sets differ in
at least as many shingles as their sketches differ in bits, so a pair whose sketches differ in more
bits than a link allows is no link for certain. The pairs left, nearly all of them links, are
confirmed on full shingle sets. No bucket is gathered in one task, and no link is dropped.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.arrow import arrow_map
from lodestar.llm.graph import connected_components
from lodestar.llm.words import mix, sequence_hash, window_hashes, word_pairs
from lodestar.session import BROADCAST_ROWS, cut, release

ROWS, SHINGLE, MISS = 3, 5, 1e-4
#: Least number of 64-bit words of a sketch, and its bits for each shingle.
SKETCH_WORDS, SKETCH_BITS = 8, 3
#: Links of the operator where nothing else is asked for: a similarity of 0.80 or more.
PERCENT = 80
#: Members that a bucket may leave to be compared with all others of it, and the width of a band of sizes.
WIDE, STEP = 50, 1.03


def tables(percent: int) -> int:
    """Half keys of each collection for a threshold."""
    return max(1, math.ceil(math.log(MISS) / math.log(1 - min(percent / 100, 0.99) ** ROWS)))


@lru_cache(maxsize=4)
def _factors(n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(85)).integers(0, 1 << 63, (n, 2), dtype=np.uint64) | np.uint64(1)


def shingle_set(text: str | None, size: int = SHINGLE) -> tuple[np.ndarray, int, int]:
    """Sorted distinct shingle hashes of a text, and two hashes of its word sequence.

    A-Z count as a-z. A text with fewer than size words has its whole sequence as one shingle; one
    without words has none.
    """
    data = (text or "").encode().lower()  # bytes.lower() changes A-Z alone
    pairs = word_pairs(data)
    if not len(pairs):
        return np.zeros(0, dtype=np.uint64), 0, 0
    high, low = divmod(sequence_hash(pairs), 1 << 64)
    return np.unique(window_hashes(np.ascontiguousarray(pairs[:, 0]), min(size, len(pairs)))), high, low - (1 << 63)


def half_keys(shingles: np.ndarray, n: int) -> np.ndarray:
    """The 2 * n half keys of a set, the first collection's first."""
    factors = _factors(2 * n * ROWS)
    least = np.full(len(factors), np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 4096):
        part = shingles[at : at + 4096]
        np.minimum(least, ((part[None, :] ^ factors[:, 1:]) * factors[:, :1]).min(axis=1), out=least)
    rows = least.reshape(2 * n, ROWS)
    key = rows[:, 0]
    for k in range(1, ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return key.view(np.int64)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Parities of the numbers of shingles in 64 * w classes of their hash; w is a power of two."""
    words = SKETCH_WORDS
    while 64 * words < SKETCH_BITS * len(shingles):
        words *= 2
    odd = np.bincount(((shingles >> np.uint64(20)) % np.uint64(64 * words)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, h1, h2, halves) for each row of docs; n half keys a collection."""

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            out = []
            for text in batch.column("text").to_pylist():
                shingles, h1, h2 = shingle_set(text)
                out.append((len(shingles), h1, h2, half_keys(shingles, n) if len(shingles) else None))
            sizes, h1, h2, halves = zip(*out, strict=True) if out else ((), (), (), ())
            return {"doc_id": batch.column("doc_id"), "n_shingles": sizes, "h1": h1, "h2": h2, "halves": halves}

        return step

    return arrow_map(docs.select("doc_id", "text"), make, "doc_id bigint, n_shingles bigint, h1 bigint, h2 bigint, halves array<bigint>")


def _few(rows: DataFrame) -> DataFrame:
    """rows, with a hint to broadcast them if a count shows that they are few."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def _facts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, n, sketch, shingles) of the wanted classes (id, low, h1, h2); low is a doc_id that has the text."""

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            found = [shingle_set(t) for t in batch.column("text").to_pylist()]
            return {
                "h1": [x[1] for x in found], "h2": [x[2] for x in found], "n": [len(x[0]) for x in found],
                "sketch": [sketch(x[0]) for x in found], "shingles": [x[0].view(np.int64) for x in found],
            }

        return step

    wanted = _few(cut(wanted))
    found = docs.select("doc_id", "text").join(wanted.select(F.col("low").alias("doc_id")), "doc_id", "left_semi")
    sets = arrow_map(found, make, "h1 bigint, h2 bigint, n bigint, sketch array<bigint>, shingles array<bigint>")
    # Rows of one doc_id can have several texts, and equal ones: the hashes tell which is meant.
    return sets.join(wanted.select("id", "h1", "h2"), ["h1", "h2"]).drop("h1", "h2").dropDuplicates(["id"])


def _can(percent: int) -> str:
    """SQL: whether sets of n and o shingles with sketches x and y can be linked."""
    differ = "aggregate(zip_with({x}, {y}, (u, v) -> bit_count(u ^ v)), 0, (s, u) -> s + u)"
    half = lambda x: f"zip_with(slice({x}, 1, shiftright(size({x}), 1)), slice({x}, shiftright(size({x}), 1) + 1, shiftright(size({x}), 1)), (u, v) -> u ^ v)"
    bits = f"""CASE WHEN size(x) = size(y) THEN {differ.format(x="x", y="y")}
        WHEN size(x) = 2 * size(y) THEN {differ.format(x=half("x"), y="y")}
        WHEN size(y) = 2 * size(x) THEN {differ.format(x="x", y=half("y"))} ELSE 0 END"""
    return f"100 * least(n, o) >= {percent} * greatest(n, o) AND {100 + percent} * ({bits}) <= {100 - percent} * (n + o)"


def _possible(pairs: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that can be linked, by their sketches."""
    left = facts.select(F.col("id").alias("a"), "n", F.col("sketch").alias("x"))
    right = facts.select(F.col("id").alias("b"), F.col("n").alias("o"), F.col("sketch").alias("y"))
    return pairs.join(left, "a").join(right, "b").where(_can(percent)).select("a", "b")


def _confirmed(pairs: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of which 100 * intersection >= percent * union, by their full sets."""
    left = facts.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    right = facts.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("x", "y")))
    return both.where(f"100 * common >= {percent} * (size(x) + size(y) - common)").select("a", "b")


def _members(classes: DataFrame, percent: int) -> DataFrame:
    """(key, id, l): classes that share a table key, with the key's leader."""
    t = tables(percent)
    slots = classes.select("id", F.posexplode("halves").alias("i", "h")).select("id", (F.col("i") < t).alias("one"), F.xxhash64("i", "h").alias("h"))
    repeated = cut(slots.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("h"))
    held = slots.join(repeated, "h").groupBy("id").agg(F.collect_list(F.expr("if(one, h, null)")).alias("p"), F.collect_list(F.expr("if(one, null, h)")).alias("q"))
    keys = cut(held.select("id", F.explode("p").alias("p"), "q").select("id", "p", F.explode("q").alias("q")).select(F.xxhash64("p", "q").alias("key"), "id"))
    # Cut off, so that both sides of the join are plain shuffles: then a frequent key is split.
    leader = cut(keys.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct(F.xxhash64("id").alias("r"), "id")).alias("s")).where("m > 1").select("key", F.col("s.id").alias("l")))
    members = cut(keys.join(leader, "key"))
    release(repeated, keys, leader)
    return members


def _held(members: DataFrame, parts: DataFrame) -> DataFrame:
    """(key, id, c, inside) of the keys with several components; inside: in the key's largest one."""
    now = members.select("key", "id").join(parts.toDF("id", "component"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    sizes = now.groupBy("key", "c").agg(F.count(F.lit(1)).alias("m")).groupBy("key").agg(F.max(F.struct("m", "c")).alias("s"), F.count(F.lit(1)).alias("k"))
    mixed = cut(sizes.where("k > 1").select("key", F.col("s.c").alias("most")))
    held = cut(now.join(mixed, "key").select("key", "id", "c", (F.col("c") == F.col("most")).alias("inside")))
    release(mixed)
    return held


def _prefix_pairs(dense: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """Every pair (a, b) of dense (id, c, outside) that can be linked, of two components and not both inside.

    Sets of n and m shingles are linked by ceil(percent * (n + m) / (100 + percent)) common ones at
    least, so they share one of the first n - that + 1 of the one and m - that + 1 of the other.
    """
    sets = dense.join(facts.select("id", "n", "shingles"), "id")
    tokens = sets.select("id", F.explode("shingles").alias("t"))
    repeated = cut(tokens.groupBy("t").agg(F.count(F.lit(1)).alias("m")).where("m > 1"))
    ranked = tokens.join(repeated, "t").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("m", "t"))).alias("ts"))
    ready = cut(sets.select("id", "c", "outside", "n").join(ranked, "id").withColumn("g", F.floor(F.log("n") / F.lit(math.log(STEP)))))

    apart = math.floor(math.log(100 / percent) / math.log(STEP)) + 1

    def role(partner: str, low: str) -> DataFrame:
        """The prefix of each set for partners of a band, whose smallest size is rounded down."""
        least = f"floor(pow({STEP}D, {partner}) * (1 - 1e-9D))"
        first = f"n - ceil({percent} * (n + {least}) / {100 + percent}.0D - 1e-6D) + 1 - (n - size(ts))"
        dealt = ready.select("*", F.explode(F.sequence(F.lit(0), F.lit(apart))).alias("d")).withColumn("first", F.expr(f"int({first})"))
        return dealt.where("first > 0").select(F.expr(low).alias("low"), "d", F.explode(F.expr("slice(ts, 1, first)")).alias("t"), "id", "c", "outside", "n").withColumn("t", F.col("t.t"))

    small, large = role("g + d", "g"), role("g - d", "g - d").toDF("low", "d", "t", "l", "k", "outside2", "o")
    met = small.join(large, ["low", "d", "t"]).where(f"c <> k AND (outside OR outside2) AND (d > 0 OR id < l) AND 100 * least(n, o) >= {percent} * greatest(n, o)")
    pairs = cut(met.select(F.least("id", "l").alias("a"), F.greatest("id", "l").alias("b")).distinct())
    release(repeated, ready)
    return pairs


def near_links(docs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between classes that give every component of the confirmed ones.

    docs: doc_id, text. classes: id, low, h1, h2, halves.
    """
    members = _members(classes, percent)
    facts = cut(_facts(docs, members.select("id").distinct().join(classes.select("id", "low", "h1", "h2"), "id")))
    pair = [F.least("id", "l").alias("a"), F.greatest("id", "l").alias("b")]

    # Every member of a bucket and its leader.
    tried = cut(_possible(members.where("id <> l").select(*pair).distinct(), facts, percent))
    parts = cut(connected_components(_confirmed(tried, facts, percent)))

    # Every member outside the bucket's largest component and one of that component, another in each bucket.
    held = _held(members, parts)
    leader = cut(held.where("inside").groupBy("key").agg(F.min(F.struct(F.xxhash64("key", "id").alias("r"), "id")).alias("s")).select("key", F.col("s.id").alias("l")))
    more = held.where("not inside").join(leader, "key").select(*pair).distinct().join(tried, ["a", "b"], "left_anti")
    more = cut(_possible(more, facts, percent))
    before, parts = parts, cut(connected_components(parts.union(_confirmed(more, facts, percent))))
    release(before, held, leader)

    # What is still outside: few members and all of other components, many by prefixes of their sets.
    held = _held(members, parts)
    wide = cut(held.groupBy("key").agg(F.count_if(~F.col("inside")).alias("out")).where(f"out > {WIDE}").select("key"))
    dense = cut(held.join(wide, "key", "left_semi").groupBy("id").agg(F.min("c").alias("c"), F.max(~F.col("inside")).alias("outside")))
    sketched = cut(held.join(wide, "key", "left_anti").join(facts.select("id", "n", "sketch"), "id").select("key", "id", "c", "inside", "n", F.col("sketch").alias("x")))
    other = sketched.toDF("key", "l", "d", "inside2", "o", "y")
    found = sketched.where("not inside").join(other, "key").where(f"c <> d AND (inside2 OR id < l) AND {_can(percent)}").select(*pair)
    shared = [] if dense.isEmpty() else [_prefix_pairs(dense, facts, percent)]
    for some in shared:
        found = found.union(_possible(some, facts, percent))
    rest = found.distinct().join(tried.union(more), ["a", "b"], "left_anti")
    links = cut(parts.toDF("a", "b").union(_confirmed(rest, facts, percent)))
    release(members, facts, tried, parts, held, more, wide, dense, sketched, *shared)
    return links


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    docs: doc_id (integer) and text; other columns are ignored, whatever their names. component_id is
    the smallest doc_id that links of 100 * intersection >= percent * union lead to, itself included;
    kept says that it is the row's own. Texts that are null, empty or without words have an empty set
    and no links; texts of any length are taken whole. A null doc_id takes no part in linking: its
    component is null and it is kept. Rows of one doc_id are one document as far as links go: each
    keeps its row, links of any of their texts count, and they share a component. An empty table
    gives none.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = cut(signatures(docs, tables(percent)))
    able = rows.where("n_shingles > 0 and doc_id is not null")
    grouped = able.groupBy("h1", "h2").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("m"), F.first("halves").alias("halves"))
    classes = cut(grouped.withColumn("id", F.monotonically_increasing_id()))
    low = classes.select("id", "low")
    links = near_links(docs, classes, percent)
    linked = links.join(low.toDF("a", "x"), "a").join(low.toDF("b", "y"), "b").select("x", "y")
    # Classes of one document: only where a doc_id has several texts.
    twins = cut(able.groupBy("doc_id").agg(F.min(F.struct("h1", "h2")).alias("one"), F.max(F.struct("h1", "h2")).alias("other")).where("one <> other").select("doc_id"))
    same = able.select("doc_id", "h1", "h2").join(twins, "doc_id").join(classes.select("h1", "h2", "low"), ["h1", "h2"]).select("doc_id", "low")
    parts = connected_components(linked.union(same))
    release(links)
    named = classes.join(parts.withColumnRenamed("node", "low"), "low", "left").where("m > 1 or component is not null")
    named = _few(cut(named.select("h1", "h2", F.coalesce("component", "low").alias("root"))))
    release(classes)
    found = able.select("doc_id", "n_shingles", "h1", "h2").join(named, ["h1", "h2"], "left").select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))
    alone = rows.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.union(alone).withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))
