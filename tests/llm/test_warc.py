"""WARC archives: written, read back, damaged, and held against the gzip library."""

import base64
import gzip
import hashlib
import io
import os

import pytest

from lodestar.llm import queries as Q
from lodestar.llm import warc as W

PAGES = "page_id bigint, url string, html string"


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def plain(pages, least=0):
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of pages with distinct page_ids."""
    first = {}
    for p, _, h in sorted(pages, key=lambda r: r[0]):
        first.setdefault(h or "", p)
    size = lambda h: len((h or "").encode())
    return sorted((p, size(h), sha(h), *(("revisit", first[h or ""]) if size(h) >= least and first[h or ""] != p else ("response", None))) for p, _, h in pages)


def found(frame):
    return sorted(tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in frame.collect())


CASES = [(i, f"http://x/{i}", html) for i, html in enumerate(["same", "é" * 70_000, "", None, "same", "a\r\n\r\nb", "WARC/1.1\r\n\r\n", "same", "\x00\x1f\x8b", "é" * 70_000])] + [(10, None, "x"), (-4, "http://a b/\r\nX-Page: 7", "same")]


@pytest.mark.parametrize(("least", "few"), [(0, True), (5, True), (0, False)])
def test_round_trip(spark, tmp_path, monkeypatch, least, few):
    monkeypatch.setattr(W, "BROADCAST_ROWS", 200_000 if few else 0)
    pages = spark.createDataFrame([(*c, 1, "z") for c in CASES], PAGES + ", first int, same string").repartition(3)
    W.write_archives(pages, f"file://{tmp_path}/a", least)
    got = W.read_archives(spark, f"file://{tmp_path}/a")
    assert found(got) == plain(CASES, least)
    rows = {r["page_id"]: r for r in got.collect()}
    for page, url, html in CASES:
        assert rows[page]["problem"] is None
        assert rows[page]["payload"] == ((html or "").encode() if rows[page]["record_type"] == "response" else None)
    assert rows[10]["target_uri"] is None and rows[-4]["target_uri"] == "http://a%20b/%0D%0AX-Page:%207"
    assert W.dangling(got).isEmpty()
    assert not W.dangling(got.where("record_type = 'revisit'")).isEmpty()


def test_members_are_what_gzip_reads(spark, tmp_path):
    W.write_archives(spark.createDataFrame(CASES, PAGES).coalesce(1), f"file://{tmp_path}/a")
    (name,) = [n for n in os.listdir(tmp_path / "a") if n.endswith(".warc.gz")]
    data = (tmp_path / "a" / name).read_bytes()
    rows = list(W.records(io.BytesIO(data), name))
    assert len(rows) == len(CASES)
    stops = [r["offset"] for r in rows[1:]] + [len(data)]
    for r, stop in zip(rows, stops, strict=True):
        whole = gzip.decompress(data[r["offset"] : stop])
        head, _, rest = whole.partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n") and f"\r\nContent-Length: {r['content_length']}".encode() in head
        assert rest[r["content_length"] :] == b"\r\n\r\n"
    assert len({r["record_id"] for r in rows}) == len(rows)


def damaged(change):
    def member(html):
        head = W.record(1, "http://x/", html, None, "2020-01-01T00:00:00Z")
        return gzip.compress(change(gzip.decompress(head)))

    good = W.record(2, "http://x/", "fine", None, "2020-01-01T00:00:00Z")
    return [(r["page_id"], r["problem"]) for r in W.records(io.BytesIO(member("some text") + good), "a")]


@pytest.mark.parametrize(
    ("change", "problem"),
    [
        (lambda x: x.replace(b"some text", b"some tent"), "block digest"),
        (lambda x: x.replace(b"sha1:", b"sha1:A", 1), "payload digest"),
        (lambda x: x[:-8], "content length"),
        (lambda x: x + b"more", "framing"),
        (lambda x: x.replace(b"WARC/1.1", b"WORC/1.1"), "version"),
        (lambda x: b"no header", "header"),
        (lambda x: x.replace(b"Content-Length: ", b"Content-Length: x"), "content length"),
    ],
)
def test_what_is_wrong_with_a_record_is_told_and_the_next_one_read(change, problem):
    rows = damaged(change)
    assert [p for _, p in rows] == [problem, None] and rows[1][0] == 2


def test_torn_archives():
    data = W.record(1, None, "a" * 1000, None, "d") + W.record(2, None, "b", None, "d")
    assert [r["problem"] for r in W.records(io.BytesIO(data[:-3]), "a")] == [None, "truncated"]
    assert [r["problem"] for r in W.records(io.BytesIO(data + b"junk"), "a")] == [None, None, "not gzip"]
    assert list(W.records(io.BytesIO(b""), "a")) == []


def test_only_what_the_manifest_names_is_read(spark, tmp_path):
    pages = spark.createDataFrame(CASES[:3], PAGES).coalesce(1)
    W.write_archives(pages, f"file://{tmp_path}/a")
    (tmp_path / "a" / "pages-lost.warc.gz").write_bytes(W.record(99, None, "left by a lost task", None, "d"))
    assert found(W.read_archives(spark, f"file://{tmp_path}/a", payload=False)) == plain(CASES[:3])
    with pytest.raises(Exception, match="not gzip"):
        (tmp_path / "b").mkdir()
        (tmp_path / "b" / "x.warc.gz").write_bytes(b"junk")
        W.read_archives(spark, f"file://{tmp_path}/b", mode="failfast").collect()


def test_query(spark, data, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url", "html").collect()]
    assert found(Q.op12_warc(spark, data)) == plain(rows)
    odd = [*CASES, (None, None, None), (0, "again", "same"), (None, "u", "alone")]
    spark.createDataFrame(odd, PAGES).write.parquet(str(tmp_path / "pages.parquet"))
    key = lambda rows: sorted(rows, key=repr)
    want = plain(CASES)
    want = [(p, n, d, *(("revisit", -4) if d == sha("same") and p != -4 else (k, t))) for p, n, d, k, t in want]
    want += [(None, 0, sha(""), "revisit", 2), (0, 4, sha("same"), "revisit", -4), (None, 5, sha("alone"), "response", None)]
    got = [tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in Q.op12_warc(spark, str(tmp_path)).collect()]
    assert key(got) == key(want)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], PAGES).write.parquet(str(tmp_path / "pages.parquet"))
    assert Q.op12_warc(spark, str(tmp_path)).collect() == []
