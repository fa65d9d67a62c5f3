"""The store's swaps, the embedding cache, the register and an index of several repositories."""

import json
import os
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar import agent
from lodestar.operators.embedding import EmbeddingCache, HashingEmbedder, ModelEmbedder
from lodestar.operators.store import Store
from lodestar.plans.ingest import Index
from lodestar.repositories import Register, StageListener
from lodestar.sources import files


def numbers(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "x int")


def values(snapshot, name, part=None):
    return sorted(r["x"] for r in snapshot.read(name, part).collect())


def test_all_tables_swap_at_once(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    first = store.publish({"a": store.write("a", numbers(spark, 1)), "b": store.write("b", numbers(spark, 1))})
    made = {}
    for name in ("a", "b"):  # a crash after either write leaves the first state
        made[name] = store.write(name, numbers(spark, 2))
        now = store.snapshot()
        assert values(now, "a") == values(now, "b") == [1]
    second = store.publish(made, base=first)
    assert values(second, "a") == values(second, "b") == [2]
    assert values(first, "a") == values(first, "b") == [1]  # a reader that began before
    with pytest.raises(RuntimeError, match="was published since"):
        store.publish(made, base=first)
    (tmp_path / "a" / "v-torn").mkdir()
    with pytest.raises(ValueError, match="not whole"):
        store.publish({"a": "a/v-torn"})
    assert store.snapshot().number == second.number == 2


def test_a_crash_while_a_manifest_is_written_changes_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.publish({"a": store.write("a", numbers(spark, 1))})
    version = store.write("a", numbers(spark, 2))
    for stop in ("_claim.", "_current."):
        broken = Store(spark, str(tmp_path))

        class Files:
            def __init__(self, inner, stop):
                self.inner, self.stop = inner, stop

            def __getattr__(self, name):
                return getattr(self.inner, name)

            def create(self, path, overwrite):
                if path.getName().startswith(self.stop):
                    raise OSError("lost")
                return self.inner.create(path, overwrite)

        broken._fs = Files(broken._fs, stop)
        with pytest.raises(OSError, match="lost"):
            broken.publish({"a": version})
        assert values(store.snapshot(), "a") == [1]
    (tmp_path / "_claim.000000000002.manifest-other.json").touch()  # a job that is about to publish, or was lost
    with pytest.raises(RuntimeError, match="another job"):
        store.publish({"a": version})
    os.utime(tmp_path / "_claim.000000000002.manifest-other.json", (1, 1))
    assert values(store.publish({"a": version}), "a") == [2]


def test_parts_keep_their_files_and_sweeps_spare_what_is_read(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    one = store.publish({"a": store.write("a", numbers(spark, 1))}, "one")
    store.publish({"a": store.write("a", numbers(spark, 5))}, "two")
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / one.tables["a"]["one"]).iterdir()}
    now = store.publish({"a": store.write("a", numbers(spark, 6))}, "two")
    assert values(now, "a") == [1, 6] and values(now, "a", "one") == [1]
    assert {p: p.stat().st_mtime_ns for p in before} == before
    prepared = store.write("a", numbers(spark, 9))
    assert store.sweep(3_600) == []
    gone = store.sweep(0)
    assert prepared in gone and one.tables["a"]["one"] not in gone and values(store.snapshot(), "a") == [1, 6]
    assert len(list(tmp_path.glob("_current.*"))) == len(list(tmp_path.glob("manifest-*"))) == 1
    dropped = store.publish({"a": None}, "two")
    assert values(dropped, "a") == [1] and not dropped.has("a", "two")


class Counting(HashingEmbedder):
    """Notes every text that it embeds in a folder, and fails at its n-th call while a mark is there."""

    def __init__(self, folder, fail=None):
        super().__init__()
        self.folder, self.fail = str(folder), fail

    def embed_documents(self, texts):
        if self.fail is not None and len(os.listdir(self.folder)) >= self.fail:
            raise RuntimeError("the model is gone")
        Path(self.folder, os.urandom(8).hex()).write_text(json.dumps(texts))
        return super().embed_documents(texts)

    def seen(self):
        return sorted(t for f in os.listdir(self.folder) for t in json.loads(Path(self.folder, f).read_text()))


def test_a_broken_run_goes_on_where_it_stopped(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    texts = [f"text {i}" for i in range(40)]
    frame = spark.createDataFrame([(t,) for t in [*texts, *texts, None]], "text string").repartition(3)
    broken = EmbeddingCache(spark, str(tmp_path / "cache"), Counting(tmp_path / "calls", 3), round_texts=7)
    with pytest.raises(Exception, match="the model is gone"):
        broken.ensure(frame.coalesce(1))
    kept = broken.read().count()
    assert 0 < kept < 40
    steps = []
    whole = EmbeddingCache(spark, str(tmp_path / "cache"), Counting(tmp_path / "calls"), round_texts=7)
    assert whole.ensure(frame, lambda done, total: steps.append((done, total))) == 40 - kept
    assert steps == [(i, len(steps)) for i in range(1, len(steps) + 1)] and len(steps) > 1
    lost = len(whole.embedder.seen()) - 40
    assert set(whole.embedder.seen()) == set(texts) and 0 <= lost <= 7 + 5  # the round that broke, at most
    assert whole.ensure(frame) == 0 and whole.read().count() == 40
    rows = whole.with_vectors(frame, "text")
    assert rows.count() == 81 and rows.where("vector is null").count() == 1
    other = EmbeddingCache(spark, str(tmp_path / "cache"), HashingEmbedder(8))
    assert other.ensure(frame) == 40  # another model's vectors are its own


def test_models_get_their_prefix_and_unit_length():
    seen = []

    def encode(texts):
        seen.extend(texts)
        return np.full((len(texts), 4), 3.0)

    model = ModelEmbedder("BAAI/bge-small-en-v1.5", encode)
    assert model.embed_query("why?").tolist() == [0.5] * 4 and model.embed_documents(["a"]).tolist() == [[0.5] * 4]
    assert seen[0].endswith(": why?") and seen[1] == "a"


def test_register(spark, tmp_path):
    register = Register(spark, str(tmp_path))
    assert register.get("client") is None and register.all().collect() == []
    assert register.register("https://github.com/ann/Client.git") == "client"
    assert register.register("ann/client") == "client" and register.register("bob/client") == "bob-client"
    with pytest.raises(ValueError, match="no repository address"):
        register.register("not a url")
    register.note("client", status="ready", stage="Ready", stats=json.dumps({"code": 3}), error="x")
    register.note("client", status="ingesting", stage="Reading", error="")
    got = register.get("client")
    assert (got["status"], got["stage"], got["error"], got["owner"], got["stats"]) == ("ingesting", "Reading", None, "ann", {"code": 3})
    assert register.ready("client") and not register.ready("bob-client") and not register.ready("nobody")
    assert sorted(register.recover()) == ["bob-client", "client"] and register.recover() == []
    assert [(r["repo"], r["status"]) for r in register.all().collect()] == [("bob-client", "failed"), ("client", "failed")]
    with pytest.raises(ValueError, match="no fields"):
        register.note("client", colour="red")


def test_stages_of_streams_are_noted(spark, tmp_path):
    register = Register(spark, str(tmp_path / "register"))
    listener = StageListener(register)
    spark.streams.addListener(listener)
    try:
        numbers(spark, 1, 2, 3).write.parquet(str(tmp_path / "in"))
        query = spark.readStream.schema("x int").parquet(str(tmp_path / "in")).writeStream.queryName("threads").format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert query.awaitTermination(60)
        import time

        for _ in range(50):  # listeners hear of it a little later
            stages = [r["stage"] for r in register.log().orderBy("at").collect()]
            if len(stages) >= 2:
                break
            time.sleep(0.2)
        assert stages[0] == "Started" and stages[1] == "Batch 0: 3 rows"
    finally:
        spark.streams.removeListener(listener)


CLIENT = "class Client:\n    def waitBeforeRetry(self):\n        return 1\n\n    def send(self):\n        return self.waitBeforeRetry()\n"
PATCH = "diff --git a/client.py b/client.py\n--- a/client.py\n+++ b/client.py\n@@ -3 +3 @@\n-        return 0\n+        return 1\n"
FIRST = "diff --git a/client.py b/client.py\nnew file mode 100644\n--- /dev/null\n+++ b/client.py\n@@ -0,0 +1,6 @@\n+all\n"


@pytest.fixture(scope="module")
def two(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("roots")
    for name, text in (("one", CLIENT), ("two", "def other():\n    return 'waits'\n")):
        (root / name).mkdir()
        (root / name / "client.py").write_text(text)
    (root / "one" / "untracked.py").write_text("def untracked():\n    pass\n")
    (root / "tracked").write_text("client.py\n\n")
    field = "\x1f".join
    (root / "log").write_text(field(["b" * 40, "ann", "2024-02-02T00:00:00Z", "Wait longer (#7)", "See #9.", PATCH]) + "\x1e" + field(["a" * 40, "ann", "2024-01-01T00:00:00Z", "Begin", "", FIRST]) + "\x1e")
    history = spark.createDataFrame([("pr", "PR#7", "Wait", "We wait, see #9 and #7.", "2024-02-01")], "kind string, ref string, title string, text string, created_at string")
    folder, stages = str(tmp_path_factory.mktemp("index")), []
    one = Index(spark, folder, repo="one", on_stage=stages.append)
    one.ingest(str(root / "one"), history, tracked=str(root / "tracked"), patches=str(root / "log"))
    other = Index(spark, folder, repo="two")
    other.ingest(str(root / "two"))
    return one, other, root, stages


def test_repositories_of_one_folder(two):
    one, other, root, stages = two
    assert stages[0] == "Reading files" and stages[-1] == "Writing index" and any(s.startswith("Embedding chunks (1/") for s in stages)
    noted = [r["stage"] for r in one.register.log().where("repo = 'one'").orderBy("at").collect()]
    assert noted == [*stages, "Ready"]
    assert {r["path"] for r in one.read("chunks").where("kind = 'code'").collect()} == {"client.py"}
    assert one.read("symbols").where("name = 'untracked'").count() == 0
    assert agent.search(one, "wait before retry", mode="bm25")[0]["symbol"] == "Client.waitBeforeRetry"  # found by its parts
    assert [r["symbol"] for r in agent.search(other, "other")] == ["other"]
    assert one.pinned().lexical().statistics()[0] == one.read("chunks").count() + other.read("chunks").count()
    files_of = lambda i: {p: p.stat().st_mtime_ns for parts in i.store.snapshot().tables.values() if i.repo in parts for p in Path(i.folder, parts[i.repo]).iterdir()}
    before, pinned = files_of(other), one.pinned()
    one.ingest(str(root / "one"), tracked=str(root / "tracked"))
    assert files_of(other) == before
    assert pinned.read("chunks").where("kind = 'pr'").count() == 1 and one.read("chunks").where("kind = 'pr'").count() == 0
    assert not one.pinned().has("hunks")  # the new state has none
    assert one.register.ready("one") and one.register.get("one")["stats"]["code"] == one.read("chunks").count()


def test_a_failed_ingest_leaves_the_old_state(two):
    _, other, root, _ = two
    number = other.store.snapshot().number

    class Broken(HashingEmbedder):
        def embed_documents(self, texts):
            raise RuntimeError("no model")

    with pytest.raises(Exception, match="no model"):
        Index(other.spark, other.folder, Broken(32), "two").ingest(str(root / "two"))
    assert other.store.snapshot().number == number
    held = other.register.get("two")
    assert held["status"] == "failed" and "no model" in held["error"] and other.register.ready("two")
    assert agent.search(other, "other")[0]["symbol"] == "other"


def test_history_tools_and_citations(spark, two, tmp_path):
    one, _, root, _ = two
    history = spark.createDataFrame([("pr", "PR#7", "Wait", "We wait, see #9 and #7.", "2024-02-01"), ("issue", "issue#9", "Slow", "It is slow.", "2024-01-30")], "kind string, ref string, title string, text string, created_at string")
    index = Index(spark, str(tmp_path / "index"))
    index.ingest(str(root / "one"), history, tracked=str(root / "tracked"), patches=str(root / "log"))
    s = agent.Session(index)
    told = agent.TOOLS["code_history"](s, "./client.py", 2, 3)
    assert re.sub(r"\s+", " ", told) == "[commit:bbbbbbbbbb] 2024-02-02 Wait longer (#7) (linked: PR#7, issue#9) See #9. [commit:aaaaaaaaaa] 2024-01-01 Begin"
    assert agent.TOOLS["code_history"](s, "client.py", 5, 6).startswith("[commit:aaaaaaaaaa]")
    assert agent.TOOLS["code_history"](s, "none.py", 1, 2) == "no such file"
    assert agent.TOOLS["read_thread"](s, "pr#7") == "[PR#7] 2024-02-01\nWe wait, see #9 and #7.\nlinked: issue#9"
    agent.TOOLS["read_file"](s, "client.py", 1, 6)
    got = agent.citations(s, ["client.py:2-3", "pr#7", "commit:bbbbbbbb", "nothing:1-2"], {"owner": "ann", "name": "client", "commit_sha": "f00"})
    base = "https://github.com/ann/client"
    assert [(c["ref"], c["url"], c["start_line"], c["end_line"]) for c in got] == [("client.py:2-3", f"{base}/blob/f00/client.py#L2-L3", 2, 3), ("PR#7", f"{base}/pull/7", None, None), ("commit:bbbbbbbbbb", f"{base}/commit/bbbbbbbbbb", None, None)]
    assert got[0]["snippet"] == "\n".join(CLIENT.splitlines()[1:3]) and got[1]["snippet"].startswith("We wait")
    assert agent.search_history(index, "slow", mode="bm25")[0]["thread"] == "issue#9"
    assert {h["thread"] for h in agent.search_history(index, "waiting is slow", mode="dense")} >= {"PR#7", "issue#9"}
    index.clear()
    with pytest.raises(FileNotFoundError):
        index.read("chunks")


def test_log_records_keep_their_order(spark, tmp_path):
    many = "\x1e".join("\x1f".join([f"{i:040d}", "a", "d", f"s{i}", "", "f.py"]) for i in range(3_000))
    (tmp_path / "log").write_text(many)
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = files.commit_log(spark, str(tmp_path / "log"), most=50)
        assert {r["title"] for r in rows.collect()} == {f"s{i}" for i in range(50)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    assert spark.range(1).select(F.lit(1)).count() == 1
