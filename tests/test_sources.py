"""Sources, parsers, ingest and the tool loop, without a network."""

import json
import tempfile
from pathlib import Path

import pytest

from lodestar import agent
from lodestar.plans.ingest import Index
from lodestar.sources import code, files, threads

NOTE = Path(tempfile.gettempdir(), "lodestar-tests-calls")
PYTHON = '''import os

LIMIT = 3
NAMES = ["a", "b"]
EXTRA = {"c": 1}


class Client:
    def get(self, url):
        return self.send(url)

    def send(self, url):
        return retry(url)


def retry(url):
    return os.path.join(url, "x")
'''


@pytest.mark.parametrize(("language", "text", "names", "callees"), [
    ("python", PYTHON, {("Client", "class"), ("Client.get", "method"), ("Client.send", "method"), ("retry", "function")}, {"send", "retry", "join"}),
    ("go", "package a\n\ntype Client struct {\n}\n\nfunc (c *Client) Get(u string) string {\n\treturn retry(u)\n}\n\nfunc retry(u string) string {\n\treturn u\n}\n", {("Client", "type"), ("Client.Get", "method"), ("retry", "function")}, {"retry"}),
    ("java", "class Client {\n  int get(String u) {\n    return retry(u);\n  }\n}\n", {("Client", "class"), ("Client.get", "method")}, {"retry"}),
    ("rust", "struct Client {\n}\n\nimpl Client {\n  pub fn get(&self) -> u8 {\n    retry(1)\n  }\n}\n", {("Client", "type"), ("Client", "impl"), ("Client.get", "method")}, {"retry"}),
    ("cpp", "class Client {\n public:\n  int get(int u) {\n    return retry(u);\n  }\n};\n", {("Client", "class"), ("Client.get", "method")}, {"retry"}),
    ("ruby", "class Client\n  def get(u)\n    retry_it(u)\n  end\nend\n", {("Client", "class"), ("Client.get", "method")}, {"retry_it"}),
    ("typescript", "interface A {\n  x: number\n}\nexport const run = (a: number) => {\n  return call(a)\n}\n", {("A", "interface"), ("run", "function")}, {"call"}),
])
def test_parsers(language, text, names, callees):
    found, calls = code.parse(text, language)
    assert {(d.qualified_name, d.kind) for d in found} == names
    assert callees <= {n for _, n in calls}


def node(n, at="2024-01-01T00:00:00Z"):
    return {"number": n, "title": f"t{n}", "body": "<!-- x -->text", "createdAt": at, "author": None, "comments": {"nodes": [{"body": "hi #3", "author": {"login": "ann"}}]}}


def test_pages_halve_and_late_nodes_drop():
    sizes = []

    def call(kind, cursor, size):
        sizes.append(size)
        if size > 6:
            raise threads.Heavy
        return {"nodes": [node(1), node(2, "2025-01-01T00:00:00Z")], "next": None}

    assert [n["number"] for n in threads.fetch(call, "issue", "2024-06-01T00:00:00Z")] == [1]
    assert sizes == [25, 12, 6]
    with pytest.raises(threads.Heavy):
        list(threads.fetch(lambda *a: (_ for _ in ()).throw(threads.Heavy()), "issue", None))


def transport(kind, cursor, size):
    at = cursor or 0
    return {"nodes": [node(10 * at + i) for i in range(3)] if kind in ("issue", "pr") else [], "next": at + 1 if at < 1 and kind in ("issue", "pr") else None}


def test_thread_source(spark):
    spark.dataSource.register(threads.ThreadSource)
    rows = spark.read.format("lodestar_threads").option("transport", "tests.test_sources:transport").load()
    assert rows.count() == 12
    kept = threads.within_budget(rows, 7)
    assert {(r["kind"], r["count"]) for r in kept.groupBy("kind").count().collect()} == {("issue", 6), ("pr", 1)}
    text = threads.thread_chunks(rows.where("kind = 'pr' and number = 0")).first()
    assert text["ref"] == "PR#0" and "by ghost" in text["text"] and "--- ann:\nhi #3" in text["text"] and "<!--" not in text["text"]


def shaky(kind, cursor, size):
    """The transport, whose calls are counted in a folder: the calls named there fail once, the third asks for a pause."""
    folder = Path(NOTE.read_text())
    n = len(list(folder.glob("call-*")))
    (folder / f"call-{n}").touch()
    if n == 2:
        raise threads.RateLimited
    if (folder / f"fail-{n}").exists():
        raise RuntimeError("the line is dead")
    if size > 12:
        raise threads.Heavy
    return transport(kind, cursor, size)


@pytest.mark.parametrize("fail", [3, 5, 7])
def test_a_stream_of_pages_goes_on_where_it_failed(spark, tmp_path, fail):
    calls = tmp_path / "calls"
    calls.mkdir()
    (calls / f"fail-{fail}").touch()
    NOTE.write_text(str(calls))  # workers do not see this process's environment
    spark.dataSource.register(threads.ThreadSource)

    def run():
        rows = spark.readStream.format("lodestar_threads").option("transport", "tests.test_sources:shaky").option("most", 8).option("waitSeconds", 0.01).load()
        query = rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    with pytest.raises(Exception, match="the line is dead"):
        run()
    run()
    got = spark.read.parquet(str(tmp_path / "out"))
    every = spark.read.format("lodestar_threads").option("transport", "tests.test_sources:transport").load()
    want = threads.within_budget(every, 8)
    key = lambda df: sorted((r["kind"], r["seq"], r["number"], r["title"]) for r in df.collect())
    assert key(got) == key(want) and len(key(got)) == 8


def test_commit_log(spark, tmp_path):
    many = "\n".join(f"f{i}.py" for i in range(30))
    (tmp_path / "log").write_text("\x1f".join(["0123456789abcdef", "ann", "2024-01-01", "Fix (#5)", "body", many]) + "\x1e" + "\x1f".join(["ff00", "bob", "2024-01-02", "S", "", "a.py"]) + "\x1e")
    rows = files.commit_log(spark, str(tmp_path / "log")).collect()
    assert [r["ref"] for r in rows] == ["commit:0123456789", "commit:ff00"]
    assert rows[0]["text"].endswith("f24.py\n... and 5 more")


def test_questions_and_answers(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps([{"id": "a", "split": "dev"}, {"id": "b", "split": "test"}]))
    assert [r["id"] for r in files.questions(spark, str(tmp_path / "q.json"), split="test").collect()] == ["b"]
    (tmp_path / "a.jsonl").write_text("".join(json.dumps({"id": "a", "system": "s", "answer": x}) + "\n" for x in ("old", "new")))
    assert [r["answer"] for r in files.answer_records(spark, str(tmp_path / "a.jsonl")).collect()] == ["new"]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    (root / "pkg").mkdir()
    (root / "tests").mkdir()
    (root / "pkg/client.py").write_text(PYTHON)
    (root / "tests/test_client.py").write_text("def test_x():\n    pass\n")
    (root / "guide.md").write_text("# Guide\nHow the client retries requests and why it waits between them, in enough words to stand alone as a section of the guide.\n## Timeouts\n" + "A timeout ends the wait for slow servers. " * 5)
    history = spark.createDataFrame([("pr", "PR#7", "Retry", "We retry because servers are slow and flaky. " + "\n\n--- ann: " + "retry details " * 100, "2024-01-01")], "kind string, ref string, title string, text string, created_at string")
    made = Index(spark, str(tmp_path_factory.mktemp("index")))
    assert set(made.ingest(str(root), history)) == {"code", "doc", "pr", "passage"}
    made.ingest(str(root), history)
    return made


def test_ingest(index):
    chunks = index.read("chunks")
    assert chunks.where("path like 'tests/%'").count() == 0
    assert chunks.count() == chunks.select("ref").distinct().count()
    assert {r["title"] for r in chunks.where("kind = 'doc'").collect()} == {"Guide", "Guide > Timeouts"}
    head = chunks.where("symbol = 'Client'").first()
    assert (head["start_line"], head["end_line"], head["extra"]) == (8, 8, ["get", "send"])
    assert {r["symbol"] for r in chunks.where("kind = 'code'").collect()} == {None, "Client", "Client.get", "Client.send", "retry"}
    assert {(r["callee"], r["caller"]) for r in index.read("calls").collect()} == {("send", "Client.get"), ("retry", "Client.send"), ("join", "retry")}
    assert chunks.where("symbol is null and kind = 'code'").first()["text"].startswith("import os")


@pytest.mark.parametrize("mode", ["hybrid", "bm25", "dense"])
def test_search(index, mode):
    assert agent.search(index, "timeout of slow servers", ("code", "doc"), mode=mode)[0]["title"] == "Guide > Timeouts"


def test_history_shows_passage(index):
    hit = agent.search_history(index, "retry details")[0]
    assert hit["thread"] == "PR#7" and hit["shown_ref"].startswith("PR#7@")


def scripted(*steps):
    left = list(steps)
    return lambda question, messages: left.pop(0) if len(left) > 1 else left[0]


def test_loop_retries_until_grounded(index):
    bad = {"answer": {"answer": "So [1].", "citations": ["PR#99"]}}
    good = {"answer": {"answer": "So [1].", "citations": ["PR#7"], "rationale_quotes": [{"ref": "PR#7", "quote": "because servers are slow and flaky"}]}}
    seen = []
    out = agent.answer(index, "Why retry?", scripted({"tool": "read_thread", "args": {"ref": "pr#7"}}, bad, good), seen.append)
    assert out["problems"] == [] and out["evidence"] == ["PR#7"]
    assert [e["type"] for e in seen] == ["tool_call", "tool_result", "answer", "done"]


def test_loop_ends_at_its_budget(index):
    calls = []

    def model(question, messages):
        if messages and messages[-1].get("final"):
            return {"answer": {"answer": "unknown", "abstained": True}}
        calls.append(1)
        return {"tool": "list_files", "args": {"path_glob": "*.py"}}

    out = agent.answer(index, "what?", model)
    assert out["answer"]["abstained"] and len(calls) == agent.MOST_REQUESTS


def test_tools(index):
    s = agent.Session(index)
    assert "Client.get" in agent.TOOLS["find_symbol"](s, "Client.get") or "pkg/client.py" in agent.TOOLS["find_symbol"](s, "Client.get")
    assert agent.TOOLS["read_file"](s, "pkg/client.py", 8, 9).splitlines()[:2] == ["pkg/client.py lines 8-9 of 17", "    8  class Client:"]
    assert agent.TOOLS["read_file"](s, "../secret", 1, 2) == "no such file"
    assert agent.TOOLS["read_file"](s, "./pkg/client.py", 99, 200) == "pkg/client.py has 17 lines"
    assert "1 matches" in agent.TOOLS["grep"](s, "LIMIT") and agent.TOOLS["grep"](s, "limit") == "no matches"
    assert "1 matches" in agent.TOOLS["grep"](s, "limit", ignore_case=True)
    assert agent.TOOLS["grep"](s, "(?<name>LIM)IT").endswith("1 matches")  # the syntax that runs
    assert agent.TOOLS["grep"](s, "(").startswith("invalid pattern")
    assert agent.TOOLS["list_files"](s, "*.md") == "guide.md"


def test_bytes_that_are_not_utf8(spark, tmp_path):
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "config.py").write_text("x = 1")
    (tmp_path / "a.py").write_bytes("x = 'é'".encode("latin-1"))
    found = files.repository_files(spark, str(tmp_path))
    assert [tuple(r) for r in files.source_files(found).select("path", "text").collect()] == [("a.py", "x = '�'")]
