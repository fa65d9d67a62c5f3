"""Best-fit packing of token pieces into sequences by a grouping genetic algorithm on islands.

Pieces are dealt to shards of at most SHARD_ITEMS by hash. In each shard several islands evolve
packings: crossover injects whole well-filled bins of one parent into the other, removes the bins
that would hold a piece twice, and best-fits the displaced pieces, largest first. Between the
rounds each island's elite migrates to the next island of its shard. What the best packing of a
shard leaves in bins that are not well filled goes on to the next level, over fewer shards, until
one is left; no piece is dropped, and no task holds more than a shard.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.arrow import arrow_map
from lodestar.llm.encoding import word_encoder
from lodestar.session import cut

CAPACITY, END, SHARD_ITEMS = 4096, 1, 6000
#: The search ends early where the number of bins is the least possible.
ISLANDS, ROUNDS, GENERATIONS, POPULATION = 3, 2, 20, 8
#: A bin with at most this share of free room is well filled and leaves the game.
WELL_FILLED = 1 / 256


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document: its ids, then END, cut at capacity."""
    names = ("doc_id", "piece", "start", "length", "ids_crc32")

    def make():
        encoder = word_encoder(tokenizer)
        end = np.array([END], dtype="<u4")

        def step(batch: pa.RecordBatch) -> dict | None:
            out = []
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc_id, own in zip(batch.column("doc_id").to_pylist(), encoder.encode_batch(texts), strict=True):
                ids = np.concatenate((own, end))
                out += [(doc_id, i, at, min(capacity, len(ids) - at), zlib.crc32(ids[at : at + capacity].tobytes())) for i, at in enumerate(range(0, len(ids), capacity))]
            return dict(zip(names, zip(*out, strict=True), strict=True)) if out else None

        return step

    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(docs, make, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint", tokenizer)


# ---- one island -------------------------------------------------------------------------------
def best_fit(bins: list[list[int]], loads: list[int], items, sizes: list[int], capacity: int) -> None:
    """Puts items, in their order, each into the bin with the least room that holds it."""
    many = len(loads) + len(items)  # room and bin in one number: room * many + bin
    rooms = sorted((capacity - load) * many + b for b, load in enumerate(loads) if load < capacity)
    for item in items:
        size = sizes[item]
        at = bisect_left(rooms, size * many)
        if at == len(rooms):
            room, b = capacity, len(bins)
            bins.append([])
            loads.append(0)
        else:
            room, b = divmod(rooms.pop(at), many)
        bins[b].append(item)
        loads[b] += size
        if room > size:
            insort(rooms, (room - size) * many + b)


def fitness(packing: tuple[list[list[int]], list[int]], capacity: int) -> tuple[int, float]:
    """Smaller is better: the number of bins, then how evenly they are filled."""
    return len(packing[1]), -sum((x / capacity) ** 2 for x in packing[1])


def exchanged(bins: list[list[int]], loads: list[int], loose: list[int], sizes: list[int], capacity: int) -> list[int]:
    """Fills bins by giving up a piece for a larger displaced one that still fits; returns what is displaced then."""
    many = len(sizes)  # size and piece in one number: size * many + piece
    order = sorted(sizes[i] * many + i for i in loose)
    for b, items in enumerate(bins):
        room = capacity - loads[b]
        for at, item in enumerate(items):
            if not room:
                break
            own = sizes[item]
            k = bisect_left(order, (own + room + 1) * many) - 1
            if k >= 0 and order[k] >= (own + 1) * many:
                size, other = divmod(order.pop(k), many)
                insort(order, own * many + item)
                room -= size - own
                items[at] = other
        loads[b] = capacity - room
    return [x % many for x in order]


def crossover(one, other, sizes: list[int], capacity: int, dice: random.Random):
    """A child of one with some of the well-filled bins of other."""
    order = sorted(range(len(other[1])), key=[(-load, dice.random()) for load in other[1]].__getitem__)
    pool = order[: max(1, len(order) // 2)]
    taken = dice.sample(pool, max(1, int(len(pool) * dice.uniform(0.1, 0.6))))
    inside = {item for b in taken for item in other[0][b]}
    bins, loads, loose = [], [], []
    for items, load in zip(*one, strict=True):
        if inside.isdisjoint(items):
            bins.append(list(items))
            loads.append(load)
        else:
            loose += [i for i in items if i not in inside]
    # Mutation: the emptiest bins, and some others, start anew.
    few = max(1, len(loads) // 20)
    anew = set(sorted(range(len(loads)), key=loads.__getitem__)[:few]) | set(dice.sample(range(len(loads)), min(len(loads), few)))
    for b in sorted(anew, reverse=True):
        loose += bins.pop(b)
        loads.pop(b)
    loose = exchanged(bins, loads, loose, sizes, capacity)
    for b in taken:
        bins.append(list(other[0][b]))
        loads.append(other[1][b])
    loose.sort()
    loose.sort(key=sizes.__getitem__, reverse=True)
    best_fit(bins, loads, loose, sizes, capacity)
    return bins, loads


def evolve(sizes: list[int], capacity: int, seed: int, elites=(), generations: int = GENERATIONS, population: int = POPULATION):
    """The best packing found: (bins, loads). elites: packings to start from."""
    dice, n = random.Random(seed), len(sizes)
    bound = -(-sum(sizes) // capacity)
    people = list(elites)
    while len(people) < population:
        spread = 0.0 if not people else 0.02 * 2 ** (len(people) % 5)
        bins: list[list[int]] = []
        loads: list[int] = []
        best_fit(bins, loads, sorted(range(n), key=[-size * (1 + dice.gauss(0, spread)) for size in sizes].__getitem__), sizes, capacity)
        people.append((bins, loads))
        if len(loads) == bound:
            break
    key = lambda p: fitness(p, capacity)
    people.sort(key=key)
    for _ in range(generations):
        if len(people[0][1]) <= bound:
            break
        for _ in range(population // 2):
            one, other = dice.sample(people, 2) if len(people) > 1 else (people[0], people[0])
            people.append(crossover(one, other, sizes, capacity, dice))
        alike = {key(p): p for p in reversed(people)}  # one of each fitness, so that parents differ
        people = [alike[k] for k in sorted(alike)][:population]
    return people[0]


# ---- the distributed game ---------------------------------------------------------------------
_STATE = "item bigint, length bigint, shard int, island int, migrant int, bin int"


def _island_round(capacity: int, turn: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        shard, island = int(rows["shard"].iloc[0]), int(rows["island"].iloc[0])
        own = rows[rows["migrant"] == 0].sort_values("item", kind="stable")
        items = own["item"].to_numpy()
        sizes = [int(x) for x in own["length"]]
        elites = []
        for migrant in (0, 1):
            part = rows[(rows["migrant"] == migrant) & (rows["bin"] >= 0)].sort_values("item", kind="stable")
            if len(part) == len(items):
                bins: list[list[int]] = [[] for _ in range(int(part["bin"].max()) + 1)]
                for i, b in enumerate(part["bin"]):
                    bins[b].append(i)
                elites.append((bins, [sum(sizes[i] for i in b) for b in bins]))
        best = evolve(sizes, capacity, seed=(turn * 1009 + island) * 100_003 + shard, elites=elites)
        where = np.zeros(len(items), dtype=np.int32)
        for b, members in enumerate(best[0]):
            where[members] = b
        return pd.DataFrame({"item": items, "length": own["length"].to_numpy(), "shard": shard, "island": island, "migrant": 0, "bin": where})

    return run


def _packed(items: DataFrame, shards: int, capacity: int, level: int) -> DataFrame:
    """(item, length, shard, bin, load) by the best island of each shard."""
    spread = items.select("item", "length", F.pmod(F.xxhash64("item", F.lit(level)), F.lit(shards)).cast("int").alias("shard"))
    state = spread.select("item", "length", "shard", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), F.lit(0).alias("migrant"), F.lit(-1).alias("bin"))
    for turn in range(ROUNDS):
        if turn:
            moved = state.withColumns({"island": F.pmod(F.col("island") + 1, F.lit(ISLANDS)), "migrant": F.lit(1)})
            state = state.unionByName(moved)
        state = cut(state.groupBy("shard", "island").applyInPandas(_island_round(capacity, turn), _STATE))
    loads = state.groupBy("shard", "island", "bin").agg(F.sum("length").alias("load"))
    rank = loads.groupBy("shard", "island").agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr("-pow(load, 2)")).alias("f"))
    best = rank.groupBy("shard").agg(F.min(F.struct("n", "f", "island")).alias("s")).select("shard", F.col("s.island").alias("island"))
    return state.join(best, ["shard", "island"], "left_semi").join(loads, ["shard", "island", "bin"]).select("item", "length", "shard", "bin", "load")


def pack(items: DataFrame, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(item, sequence_id) for items (item: unique bigint, length from 1 to capacity)."""
    left, level, done = items.select("item", "length"), 0, None
    n = left.count()
    while n:
        shards = max(1, -(-n // shard_items))
        rows = cut(_packed(left, shards, capacity, level))
        name = (F.lit(level).cast("bigint") * F.lit(1 << 54) + F.col("shard").cast("bigint") * F.lit(1 << 14) + F.col("bin")).alias("sequence_id")
        full = F.col("load") >= capacity * (1 - WELL_FILLED)
        if shards > 1 and rows.where(~full).count() > n // 2:
            # Such pieces cannot be filled up: what is in bins at least half full stays there. Of the
            # others best fit leaves one in a shard, and those of all shards meet on the next level.
            full = 2 * F.col("load") >= capacity
        full = F.lit(shards == 1) | full
        now = rows.where(full).select("item", name)
        done = now if done is None else done.unionByName(now)
        left, level = rows.where(~full).select("item", "length"), level + 1
        n = left.count()
    return done if done is not None else items.select("item", F.lit(0).cast("bigint").alias("sequence_id"))


def packed_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of each document.

    A null or empty text is END alone. Only documents longer than capacity are cut, into pieces of
    capacity and a last one that may be shorter; texts of any length are taken whole. Of pieces of
    one length the one with the smaller item number is placed first. Rows that repeat a doc_id are documents of their
    own; a null doc_id stays null. Offsets follow (doc_id, piece) inside a sequence. An empty table
    gives an empty result. Columns other than doc_id and text are ignored.
    """
    rows = cut(pieces(docs, tokenizer, capacity).withColumn("item", F.monotonically_increasing_id()))
    placed = rows.join(pack(rows, capacity), "item")

    order = Window.partitionBy("sequence_id").orderBy("doc_id", "piece", "item").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", F.coalesce(F.sum("length").over(order), F.lit(0)).cast("bigint").alias("offset"))
