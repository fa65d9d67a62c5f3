"""Prefix trie of conversations by distributed MSD radix partitioning and multikey quicksort.

Turns are dictionary-encoded: each distinct (role, text), told apart by SHA-256, gets a number. A
conversation is then its numbers in order and END. A bucket holds the conversations that share their
first turns, and a round partitions every bucket that is too large by the next turn at which its
members differ. The stretch before it, however long, is skipped in that round: counts by (bucket,
place), combined before the shuffle, show how far all members agree. So copies of a conversation, or
a first turn that a third of them share, take one round and are never gathered.

A bucket of one conversation is finished row by row. A bucket of at most LOCAL rows goes to one task,
where a multikey quicksort (three-way partitions by the turn at a depth) emits its nodes as it
recurses. What lies below a node of a large bucket is summed up along the path of large buckets above.

A node is (conv_id, depth): its smallest member and the number of turns. Nodes of one depth have no
member in common, so that is a key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.arrow import _release
from lodestar.session import BROADCAST_ROWS, cut, release

END, LOCAL = -1, 2_000
#: Conversation ids that one row of a digest's input holds at most.
CHUNK = 4_096

NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint"
_COLUMNS = [x.split()[0] for x in NODE.split(", ")]


class Trie(NamedTuple):
    """lower: nodes with the ends (sorted conv_ids that end there), at most LOCAL. upper: nodes of large
    buckets, any number of conversations end at each; upper_ends: (conv_id, depth, member) for those."""

    lower: DataFrame
    upper: DataFrame
    upper_ends: DataFrame


def _few(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def coded_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, lengths): turns (conv_id, pos, item, w) in order of turn, lengths (conv_id, n).

    conversations: conv_id, turn, role, text; other columns are ignored. item numbers the distinct
    (role, text), w is the text's UTF-8 length, pos counts from 0. A null turn comes first, a null
    role or text is empty, rows of one turn are in order of their hash, repeated rows stay. Rows
    without a conv_id belong to no conversation. Places come from a global sort and the counts of its
    partitions, so no conversation needs to fit in one task.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    thin = cut(conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), key.alias("key"), F.octet_length(text).cast("bigint").alias("w")))
    items = cut(thin.select("key").distinct().withColumn("item", F.monotonically_increasing_id()))
    order = ["conv_id", "turn", "key"]
    sorted_ = thin.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(sorted_.select("conv_id", "key", "w", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    runs = placed.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("m"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = cut(runs.withColumn("before", before))
    rows = placed.join(runs, ["conv_id", "part"]).select("conv_id", (F.col("at") - F.col("first") + F.col("before")).alias("pos"), "key", "w")
    turns = cut(rows.join(items, "key").select("conv_id", "pos", "item", "w"))
    lengths = cut(runs.groupBy("conv_id").agg(F.sum("m").alias("n")))
    release(thin, items, placed, runs)
    return turns, lengths


def quicksorted(convs: list[int], items: list[list[int]], weights: list[list[int]], top: int, up: int | None, gain: int) -> dict[str, list]:
    """The nodes of a bucket: conversations (ascending) that share their first top turns, and the turns after those.

    up is the conv_id of the node above, gain the weight of the last shared turn.
    """
    low, depth, parent, n, children, ends, saved = [], [], [], [], [], [], []
    work = [(True, list(range(len(convs))), 0, -1)]
    while work:
        is_node, members, d, above = work.pop()
        if is_node:  # all members agree on d turns
            first, here = members[0], len(low)
            low.append(convs[first])
            depth.append(top + d)
            parent.append(above)
            n.append(len(members))
            saved.append((len(members) - 1) * (weights[first][d - 1] if d else gain))
            ends.append([convs[m] for m in members if len(items[m]) == d])
            children.append(0)
            longer = members if not ends[-1] else [m for m in members if len(items[m]) > d]
            if longer:
                work.append((False, longer, d, here))
            continue
        pivot = items[members[len(members) // 2]][d]
        less = [m for m in members if items[m][d] < pivot]
        same = [m for m in members if items[m][d] == pivot]
        more = [m for m in members if items[m][d] > pivot]
        children[above] += 1
        work += [(False, part, d, above) for part in (more, less) if part]
        work.append((True, same, d + 1, above))
    leaves = [int(c == 0) for c in children]
    for i in range(len(low) - 1, 0, -1):  # a node comes after the one above it
        leaves[parent[i]] += leaves[i]
        saved[parent[i]] += saved[i]
    return {"conv_id": low, "depth": depth, "parent_conv_id": [up if p < 0 else low[p] for p in parent], "n_convs": n, "n_children": children, "n_leaves": leaves, "saved_tokens": saved, "ends": ends, "is_top": [p < 0 for p in parent]}


def _finished(rows: DataFrame) -> DataFrame:
    """Nodes of whole buckets, from rows (bucket, top, up, gain, conv_id, pos, item, w); a bucket's rows meet in one task."""
    schema = f"{NODE}, ends array<bigint>, is_top boolean"
    types = pa.schema([(c, pa.int64()) for c in _COLUMNS] + [("ends", pa.list_(pa.int64())), ("is_top", pa.bool_())])
    names = ["bucket", "top", "up", "gain", "conv_id", "pos", "item", "w"]

    def nodes(table: pa.Table) -> Iterator[pa.RecordBatch]:
        bucket, top, up, gain, conv, pos, item, w = (table.column(c).to_numpy() for c in names)
        bounds = np.flatnonzero(np.diff(bucket)) + 1
        out: dict[str, list] = {c: [] for c in types.names}
        for a, b in zip([0, *bounds.tolist()], [*bounds.tolist(), len(bucket)], strict=True):
            stops = np.flatnonzero(item[a:b] == END) + 1  # each conversation closes with END
            own_items, own_weights = item[a:b].tolist(), w[a:b].tolist()
            spans = list(zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True))
            made = quicksorted([int(conv[a + x]) for x, _ in spans], [own_items[x : y - 1] for x, y in spans], [own_weights[x : y - 1] for x, y in spans], int(top[a]), int(up[a]), int(gain[a]))
            for c, column in out.items():
                column += made[c]
            if len(out["depth"]) >= 10_000:
                yield pa.RecordBatch.from_pydict(out, schema=types)
                out = {c: [] for c in types.names}
        if out["depth"]:
            yield pa.RecordBatch.from_pydict(out, schema=types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _release(None)
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket = batch.column("bucket").to_numpy()
            last = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on in the next batch
            if last or (held and held[-1].column("bucket")[-1].as_py() != bucket[0]):
                whole = pa.Table.from_batches([*held, batch.slice(0, last)])
                yield from nodes(whole) if whole.num_rows else ()
                held = []
            held.append(batch.slice(last))
        if held:
            yield from nodes(pa.Table.from_batches(held))

    ordered = rows.select(*names).repartition("bucket").sortWithinPartitions("bucket", "conv_id", "pos")
    return ordered.mapInArrow(run, schema)


def _sum(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def prefix_trie(turns: DataFrame, lengths: DataFrame, local: int = LOCAL) -> Trie:
    """The nodes of the prefix trie of sequences.

    turns: conv_id, pos (from 0, without gaps), item (at least 0), w; lengths: conv_id and n, the
    number of its turns, which may be 0. Each distinct sequence of the first d items is a node of
    depth d: its smallest member, its parent's (null at the root), members, children, leaves below or
    at it, and saved_tokens, the sum over its subtree of (n_convs - 1) * w of a node's last item.
    Without conversations there are no nodes. local: the most rows that finish in one task.
    """
    spark = turns.sparkSession
    least = lengths.agg(F.min("conv_id")).first()[0]
    nothing = spark.createDataFrame([], f"{NODE}, ends array<bigint>")
    if least is None:
        return Trie(nothing, nothing.drop("ends"), spark.createDataFrame([], "conv_id bigint, depth bigint, member bigint"))
    rows = turns.join(lengths, "conv_id").select("conv_id", "pos", "item", "w", "n").unionByName(lengths.select("conv_id", F.col("n").alias("pos"), F.lit(END).cast("bigint").alias("item"), F.lit(0).cast("bigint").alias("w"), "n"))
    active = cut(rows.select("*", F.lit(least).cast("bigint").alias("bucket")))
    # Large buckets of a round: node above, last shared turn's weight, and the places of the buckets above.
    heads = spark.createDataFrame([(least, 0, None, 0)], "bucket bigint, top bigint, up bigint, gain bigint").withColumn("path", F.array().cast("array<struct<low:bigint,at:bigint>>"))
    larges, chains, ends, local_rows, alone, read = [], [], [], [], [], []
    while True:
        # How far all members agree: the first place where they differ or one ends.
        counts = cut(active.groupBy("bucket", "pos").agg(F.min("item").alias("lo"), F.max("item").alias("hi"), F.max("w").alias("w"), F.count(F.lit(1)).alias("m")))
        splits = counts.groupBy("bucket").agg(F.min(F.when((F.col("lo") != F.col("hi")) | (F.col("lo") == END), F.col("pos"))).alias("at"), F.max("m").alias("n_convs"))
        heads = cut(heads.join(splits, "bucket").withColumn("path", F.concat("path", F.array(F.struct(F.col("bucket").alias("low"), "at")))))
        at = _few(heads.select("bucket", "at"))
        chains.append(cut(counts.join(at, "bucket").where("pos < at").select("bucket", "at", (F.col("pos") + 1).alias("depth"), "w").unionByName(heads.select("bucket", "at", F.col("top").alias("depth"), F.col("gain").alias("w")))))
        branch = cut(active.join(at, "bucket").where("pos = at").select("bucket", "at", "item", "conv_id", "n", "w"))
        ends.append(branch.where(F.col("item") == END).select(F.col("bucket").alias("conv_id"), F.col("at").alias("depth"), F.col("conv_id").alias("member")))
        found = branch.where(F.col("item") != END).groupBy("bucket", "at", "item").agg(F.count(F.lit(1)).alias("m"), F.min("conv_id").alias("low"), F.sum(F.col("n") - F.col("at")).alias("size"), F.max("w").alias("gain"))
        children = cut(found.withColumn("kind", F.when(F.col("m") == 1, "alone").when(F.col("size") <= local, "local").otherwise("large")))
        larges.append(cut(heads.join(children.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_children"), F.count_if(F.col("kind") == "alone").alias("n_alone")), "bucket", "left")))
        named = children.select("bucket", "item", "low", "gain", "kind")
        members = cut(branch.where(F.col("item") != END).join(named, ["bucket", "item"]).select("conv_id", F.col("low"), (F.col("at") + 1).alias("top"), F.col("bucket").alias("up"), "gain", "kind"))
        rest = cut(active.drop("bucket").join(members, "conv_id").where("pos >= top").withColumnRenamed("low", "bucket"))
        below = children.where("kind = 'large'").select(F.col("low").alias("child"), (F.col("at") + 1).alias("top"), F.col("bucket").alias("up"), "gain")
        following = cut(below.join(heads.select(F.col("bucket").alias("up"), "path"), "up").select(F.col("child").alias("bucket"), "top", "up", "gain", "path"))
        local_rows.append(rest.where("kind = 'local'").drop("kind"))
        alone.append(rest.where("kind = 'alone'").drop("kind"))
        read.append(rest)
        release(counts, children, members)
        if len(read) == 1:
            release(active)
        active, heads = rest.where("kind = 'large'").select("conv_id", "pos", "item", "w", "n", "bucket"), following
        if heads.isEmpty():
            break
    single = _sum(alone).select("conv_id", F.col("pos").alias("depth"), F.when(F.col("pos") == F.col("top"), F.col("up")).otherwise(F.col("conv_id")).alias("parent_conv_id"), F.lit(1).cast("bigint").alias("n_convs"), (F.col("item") != END).cast("bigint").alias("n_children"), F.lit(1).cast("bigint").alias("n_leaves"), F.lit(0).cast("bigint").alias("saved_tokens"), F.when(F.col("item") == END, F.array("conv_id")).otherwise(F.array().cast("array<bigint>")).alias("ends"))
    local_nodes = cut(_finished(_sum(local_rows)))
    # What lies below each large bucket's last node: its own small children, and all of every large one beneath.
    tops = local_nodes.where("is_top").groupBy(F.col("parent_conv_id").alias("bucket"), (F.col("depth") - 1).alias("at")).agg(F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    large, chain = _sum(larges), _sum(chains)
    shared = chain.groupBy("bucket", "at").agg(F.sum("w").alias("along"))
    own = cut(large.join(tops, ["bucket", "at"], "left").join(shared, ["bucket", "at"]).select(
        "bucket", "at", "top", "up", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "path", ((F.col("n_convs") - 1) * F.col("along")).alias("along"), F.coalesce("saved", F.lit(0)).alias("saved"),
        (F.coalesce("leaves", F.lit(0)) + F.coalesce("n_alone", F.lit(0)) + F.col("n_children").isNull().cast("bigint")).alias("leaves"),
    ))
    upward = own.select(F.explode("path").alias("p"), "bucket", "at", "along", "saved", "leaves")
    itself = (F.col("p.low") == F.col("bucket")) & (F.col("p.at") == F.col("at"))
    totals = upward.groupBy(F.col("p.low").alias("bucket"), F.col("p.at").alias("at")).agg(F.sum("leaves").alias("n_leaves"), F.sum(F.col("saved") + F.when(itself, 0).otherwise(F.col("along"))).alias("below"))
    after = F.sum("w").over(Window.partitionBy("bucket", "at").orderBy(F.desc("depth")))
    upper = chain.withColumn("after", after).join(own.select("bucket", "at", "top", "up", "n_convs", "n_children"), ["bucket", "at"]).join(totals, ["bucket", "at"]).select(
        F.col("bucket").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("top"), F.col("up")).otherwise(F.col("bucket")).alias("parent_conv_id"), "n_convs",
        F.when(F.col("depth") < F.col("at"), F.lit(1).cast("bigint")).otherwise(F.col("n_children")).alias("n_children"), "n_leaves", (F.col("below") + (F.col("n_convs") - 1) * F.col("after")).alias("saved_tokens"),
    )
    return Trie(single.unionByName(local_nodes.drop("is_top")), upper, _sum(ends))


def conversation_trie(conversations: DataFrame) -> Trie:
    """The trie of conversations (conv_id, turn, role, text), taken as `coded_turns` says; w is a text's UTF-8 length."""
    return prefix_trie(*coded_turns(conversations))


def end_digests(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of ends (conv_id, depth, member): SHA-256 of the members, ascending, joined by commas.

    Members first meet in rows of at most CHUNK neighbouring ids; a node's rows are then hashed one
    after the other, so none is gathered.
    """
    chunked = ends.groupBy("conv_id", "depth", F.floor(F.col("member") / CHUNK).alias("chunk")).agg(F.array_join(F.array_sort(F.collect_list("member")), ",").alias("ids"))
    types = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done = []
            for conv_id, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "depth", "ids")), strict=True):
                if node == (conv_id, depth):
                    state.update(b"," + ids.encode())
                    continue
                if node:
                    done.append((*node, state.hexdigest()))
                node, state = (conv_id, depth), hashlib.sha256(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types.types, strict=True)], schema=types)
        if node:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*node, state.hexdigest()), types.types, strict=True)], schema=types)

    return chunked.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "chunk").mapInArrow(run, "conv_id bigint, depth bigint, ends_sha256 string")


def node_table(trie: Trie) -> DataFrame:
    """All nodes with ends_sha256: the digest of the conv_ids that end there (none: that of an empty text)."""
    lower = trie.lower.withColumn("ends_sha256", F.sha2(F.array_join("ends", ","), 256)).drop("ends")
    upper = trie.upper.join(_few(cut(end_digests(trie.upper_ends))), ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    return lower.unionByName(upper)
