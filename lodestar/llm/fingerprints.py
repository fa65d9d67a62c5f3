"""Document fingerprints: canonical exact digests with byte comparison inside equal buckets.

Canonical form: Unicode NFKC, case folding, NFKC again, and every run of white space as one space
with none at the ends. The digest is 128-bit XXH3 of the canonical UTF-8 bytes. Texts that share a
digest form a bucket; its smallest and largest canonical bytes are compared, and where they differ
(a hash collision) SHA-256 of the canonical bytes is appended, so texts have one fingerprint exactly
if their canonical bytes are equal.

Defined results: a null text is an empty one; repeated rows keep their own rows and share a
fingerprint; a null id is kept and sorts last; extra columns are ignored; an empty table gives an
empty result. Likeness of two digests is 1.0 if they are equal, else 0.0: an exact digest has
nothing between.
"""

from __future__ import annotations

import hashlib
import unicodedata
from bisect import bisect_left

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.arrow import arrow_map
from lodestar.session import BROADCAST_ROWS, cut


def canonical(text: str | None) -> bytes:
    """The canonical UTF-8 bytes of a text; null gives none."""
    if not text:
        return b""
    if text.isascii():
        return " ".join(text.lower().split()).encode()
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode()


def _digest(data: bytes, bits: int) -> str:
    return xxhash.xxh3_128_hexdigest(data)[: bits // 4]


def digests(docs: DataFrame, bits: int = 128, text: str = "text") -> DataFrame:
    """The columns of docs other than text, with digest and the compressed canonical bytes."""
    kept = [c for c in docs.columns if c not in (text, "digest", "packed")]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), "digest string", "packed binary"])

    def make():
        pack = zstandard.ZstdCompressor(level=1).compress

        def step(batch: pa.RecordBatch) -> dict:
            forms = [canonical(t) for t in batch.column(text).to_pylist()]
            return {c: batch.column(c) for c in kept} | {"digest": [_digest(x, bits) for x in forms], "packed": [pack(x) for x in forms]}

        return step

    return arrow_map(docs, make, schema)


def collided(docs: DataFrame, bits: int = 128, text: str = "text") -> DataFrame:
    """Digests of the canonical texts that stand for more than one byte string.

    Only texts of buckets with two rows or more are compared, by their smallest and largest bytes:
    an aggregate with map-side combining, so a bucket with a third of all rows is never gathered.
    """
    rows = digests(docs.select(text), bits, text)
    shared = cut(rows.groupBy("digest").count().where("count > 1").select("digest"))
    if shared.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        shared = F.broadcast(shared)
    return rows.join(shared, "digest", "left_semi").groupBy("digest").agg(F.min("packed").alias("a"), F.max("packed").alias("b")).where("a <> b").select("digest")


def resolved(rows: DataFrame, clashes: DataFrame, names: dict[str, str]) -> DataFrame:
    """Appends SHA-256 to digests that collided. names: digest column to SHA-256 column."""
    for digest, sha in names.items():
        rows = rows.join(clashes.select(F.col("digest").alias(digest), F.lit(True).alias("_clash")), digest, "left")
        rows = rows.withColumn(digest, F.when(F.col("_clash"), F.concat_ws("-", digest, F.lower(F.hex(sha)))).otherwise(F.col(digest))).drop("_clash")
    return rows


def fingerprints(docs: DataFrame, bits: int = 128, text: str = "text") -> DataFrame:
    """docs without its text, with fingerprint. bits: width of the digest (fewer only in tests).

    Null, empty and repeated texts, ties and empty tables as stated above; texts of any length are
    taken whole. Columns named fingerprint or sha are replaced; all others stay as they are.
    """
    kept = [c for c in docs.columns if c not in (text, "fingerprint", "sha", "_clash")]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), "fingerprint string", "sha binary"])

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            forms = [canonical(t) for t in batch.column(text).to_pylist()]
            return {c: batch.column(c) for c in kept} | {"fingerprint": [_digest(x, bits) for x in forms], "sha": [hashlib.sha256(x).digest() for x in forms]}

        return step

    clashes = cut(collided(docs, bits, text))
    return resolved(arrow_map(docs, make, schema), clashes, {"fingerprint": "sha"}).select(*kept, "fingerprint")


def _chunk_of(cuts: list[int]):
    """Chunks number the ids downwards: 0 has the largest ones, and the last one the nulls."""
    last = len(cuts)
    return lambda key: last + 1 if key is None else last - bisect_left(cuts, key)


def with_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has its last floor(n / 2) code points replaced by the first as many of the next
    document in descending doc_id (after the last comes the first; a lone one is its own next).
    Rows of one doc_id are ordered by text. One pass over the ids picks cut points and the first id
    of each chunk; then one shuffle deals whole texts to chunks of neighbouring ids, and the first
    row of a chunk also goes to the chunk before it, so no other task is needed for a neighbour.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = docs.select("doc_id")
    chunks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(ids.select(F.percentile_approx("doc_id", [i / chunks for i in range(1, chunks)], 10 * chunks)).first()[0] or []))
    chunk_of = _chunk_of(cuts)

    def heads_make():
        def step(batch: pa.RecordBatch) -> dict:
            keys = batch.column("doc_id").to_pylist()
            return {"chunk": [chunk_of(k) for k in keys], "doc_id": keys}

        return step

    # One row for each chunk: their number follows the partitions, not the rows.
    found = arrow_map(ids, heads_make, "chunk int, doc_id bigint").groupBy("chunk").agg(F.max("doc_id").alias("head")).collect()
    order = sorted((r["chunk"], r["head"]) for r in found)
    before = {head: order[i - 1][0] for i, (_, head) in enumerate(order)}

    def deal_make():
        def step(batch: pa.RecordBatch) -> dict:
            keys, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            out = [(chunk_of(k), 0, k, t) for k, t in zip(keys, texts, strict=True)]
            out += [(before[k], 1, k, t) for k, t in zip(keys, texts, strict=True) if k in before]
            return dict(zip(("chunk", "guest", "doc_id", "text"), zip(*out, strict=True), strict=True)) if out else None

        return step

    dealt = arrow_map(docs, deal_make, "chunk int, guest int, doc_id bigint, text string").repartition(max(1, chunks // 4), "chunk")
    dealt = dealt.sortWithinPartitions("chunk", "guest", F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first())
    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "sha", "edited_sha")

    def pairs_make():
        held: list = []

        def finished(now: tuple, text: str, form: bytes) -> tuple:
            doc_id, own, own_form = now
            half = len(own) // 2
            edited = own[: len(own) - half] + text[:half]
            edited_form = canonical(edited)
            return (
                doc_id, len(own), hashlib.sha256(edited.encode()).hexdigest(), _digest(own_form, 128), _digest(edited_form, 128),
                float(own_form == edited_form), float(own_form == form), hashlib.sha256(own_form).digest(), hashlib.sha256(edited_form).digest(),
            )

        def step(batch: pa.RecordBatch) -> dict | None:
            out = []
            for chunk, guest, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("chunk", "guest", "doc_id", "text")), strict=True):
                text = text or ""
                form = canonical(text)
                if held and held[0] == chunk:
                    out.append(finished(held[1], text, form))
                held[:] = [] if guest else [chunk, (doc_id, text, form)]
            return dict(zip(names, zip(*out, strict=True), strict=True)) if out else None

        return step

    rows = arrow_map(dealt, pairs_make, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, sha binary, edited_sha binary")
    clashes = cut(collided(docs))
    if not clashes.isEmpty():
        rows = resolved(rows, clashes, {"fingerprint": "sha", "edited_fingerprint": "edited_sha"})
    return rows.drop("sha", "edited_sha")
