"""The tool loop: a model calls retrieval tools over an index, and its answer must be grounded.

The model is a callable of (question, messages) that returns {"tool": name, "args": {...}} or
{"answer": {...}}; nothing here depends on which one it is.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators import grounding as G
from lodestar.operators import ivf
from lodestar.operators import retrieval as X
from lodestar.operators.history import line_history
from lodestar.plans.ingest import Index, Pinned

#: Limits of a run.
MOST_REQUESTS, MOST_CALLS, MOST_RETRIES, TOP, PREVIEW, MOST_READ = 12, 15, 3, 8, 700, 150
HISTORY = ("commit", "issue", "pr", "discussion", "release")
_EVIDENCE = "session string, seq bigint, ref string, path string, start_line int, end_line int, text string"


@dataclass
class Session:
    """One question's ledger and trace, over one state of the index."""

    index: Pinned
    ledger: dict[str, tuple] = field(default_factory=dict)
    trace: list[dict] = field(default_factory=list)

    def __post_init__(self):
        self.index = self.index.pinned()

    def add(self, ref, kind, text, path=None, start=None, end=None) -> None:
        """Adds evidence: code keeps its first text, history grows."""
        from lodestar.streaming.sessions import merge_text

        old = self.ledger.get(ref)
        text = merge_text(old[1] if old else None, text, kind in ("code", "doc"))
        self.ledger[ref] = (kind, text, path, start, end)

    def evidence(self) -> DataFrame:
        rows = [("s", i, ref, p, a, b, text) for i, (ref, (_, text, p, a, b)) in enumerate(self.ledger.items())]
        return self.index.spark.createDataFrame(rows, _EVIDENCE)


def _ranked_ids(at: Pinned, question: str, kinds: tuple[str, ...], mode: str) -> DataFrame:
    """(id, score) of the candidates of a question by BM25, vectors or both."""
    if mode not in ("hybrid", "bm25", "dense"):
        raise ValueError(f"no mode {mode!r}")
    lists, wanted = [], F.col("kind").isin(*kinds)
    if mode != "dense":
        asked = X.question_terms(at.spark.createDataFrame([(1, question)], "query_id bigint, text string"))
        lists.append(at.lexical().top(asked, X.CANDIDATES, wanted & (F.col("repo") == at.repo)).select("query_id", "id", "rank"))
    if mode != "bm25":
        ask = at.spark.createDataFrame([(1, [float(x) for x in at.embedder.embed_query(question)])], "query_id bigint, vector array<float>")
        lists.append(ivf.search(at.state, ask, X.CANDIDATES, at.repo, wanted).select("query_id", "id", "rank"))
    return X.fuse(lists[0] if len(lists) == 1 else lists[0].unionByName(lists[1])).select("id", "score")


def search(index: Index | Pinned, question: str, kinds: tuple[str, ...] = ("code", "doc"), k: int = TOP, mode: str = "hybrid") -> list:
    """The best k chunks of the kinds by BM25, vectors or both."""
    at = index.pinned()
    return _ranked_ids(at, question, kinds, mode).join(at.read("chunks"), "id").orderBy(F.desc("score"), "id").limit(k).collect()


def search_history(index: Index | Pinned, question: str, k: int = TOP, mode: str = "hybrid") -> list:
    """The best k threads among 4 * k hits by BM25, vectors or both; each shows its best passage, if one is among them."""
    at = index.pinned()
    chunks = at.read("chunks").where(F.col("kind").isin(*HISTORY, "passage"))
    hits = X.ranked(_ranked_ids(at, question, (*HISTORY, "passage"), mode).withColumn("query_id", F.lit(1)), 4 * k)
    grouped = X.regroup(hits.join(chunks.select("id", "kind", "ref", "parent"), "id").select("query_id", "id", F.coalesce("parent", "ref").alias("thread"), (F.col("kind") == "passage").alias("is_passage"), "score"), k)
    shown = chunks.select(F.col("id").alias("shown_id"), F.col("text").alias("shown"), F.col("ref").alias("shown_ref"))
    threads = chunks.where("kind <> 'passage'").select(F.col("ref").alias("thread"), "kind", "title", "created_at")
    return grouped.join(threads, "thread").join(shown, "shown_id").orderBy("rank").collect()


def _linked(at: Pinned, numbers: DataFrame) -> dict:
    """Id to the indexed threads that its numbers (id, number) link to."""
    known = at.read("chunks").where(F.col("kind").isin(*HISTORY)).select("ref")
    out: dict = {}
    for r in G.links_by_kind(numbers, known).orderBy("id", "number").collect():
        out.setdefault(r["id"], []).append(r["ref"])
    return out


def _search_code(s: Session, query: str) -> str:
    rows = search(s.index, query, ("code", "doc"))
    for r in rows:
        s.add(r["ref"], r["kind"], r["text"], r["path"], r["start_line"], r["end_line"])
    return "\n\n".join(f"[{r['ref']}]\n{r['text']}" for r in rows) or "nothing found"


def _search_history(s: Session, query: str) -> str:
    rows = search_history(s.index, query)
    for r in rows:
        s.add(r["thread"], r["kind"], r["shown"][:PREVIEW])
    return "\n\n".join(f"[{r['thread']}] {r['shown'][:PREVIEW]}" for r in rows) or "nothing found"


def _find_symbol(s: Session, name: str) -> str:
    found = X.find_definitions(s.index.read("symbols"), name).collect()
    used = X.find_callers(s.index.read("calls"), name).collect()
    out = []
    for r in found[:3]:
        text = "\n".join(x["text"] for x in X.read_lines(s.index.read("lines"), r["path"], r["start_line"], min(r["end_line"], r["start_line"] + 59)).collect())
        s.add(f"{r['path']}:{r['start_line']}-{r['end_line']}", "code", text, r["path"], r["start_line"], r["end_line"])
        out.append(f"[{r['path']}:{r['start_line']}-{r['end_line']}]\n{text}")
    return "\n".join(out + [f"{r['path']}:{r['start_line']} {r['qualified_name']}" for r in found[3:]] + [f"called in {r['path']}:{r['line']} {r['caller']}" for r in used]) or "no such symbol"


def _read_file(s: Session, path: str, start: int = 1, end: int = 120) -> str:
    path, start = path.strip().removeprefix("./"), max(1, start)
    own = s.index.read("lines").where(F.col("path") == path)
    total = own.agg(F.max("line")).first()[0]
    if total is None:
        return "no such file"
    end = min(end if end >= start else start + 119, start + MOST_READ - 1, total)
    rows = X.read_lines(own, path, start, end).collect() if start <= total else []
    if not rows:
        return f"{path} has {total} lines"
    low, high = rows[0]["line"], rows[-1]["line"]
    s.add(f"{path}:{low}-{high}", "code", "\n".join(r["text"] for r in rows), path, low, high)
    return f"{path} lines {low}-{high} of {total}\n" + "\n".join(f"{r['line']:5d}  {r['text']}" for r in rows)


def _grep(s: Session, pattern: str, path_glob: str = "*", ignore_case: bool = False) -> str:
    from lodestar.functions.text import glob_regex

    pattern = f"(?i){pattern}" if ignore_case else pattern
    try:  # by the syntax that will run
        s.index.spark._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception as e:  # whatever bridge the error comes over
        return f"invalid pattern: {str(e).splitlines()[-1][:200]}"
    rows = X.grep(s.index.read("searched").where(F.col("path").rlike(glob_regex(path_glob))), pattern).collect()
    return "\n".join([f"{r['path']}:{r['line']} {r['text']}" for r in rows] + [f"{rows[0]['total']} matches"]) if rows else "no matches"


def _list_files(s: Session, path_glob: str = "*") -> str:
    from lodestar.functions.text import glob_regex

    found = s.index.read("lines").select("path").distinct().where(F.col("path").rlike(glob_regex(path_glob)))
    rows, n = [r["path"] for r in found.orderBy("path").limit(200).collect()], found.count()
    return "\n".join(rows + ([f"and {n - len(rows)} more"] if n > len(rows) else []))


def _read_thread(s: Session, ref: str, offset: int = 0) -> str:
    from lodestar.functions.text import linked_numbers, number_of, release_candidates

    spark, offset = s.index.spark, max(0, offset)
    ask = spark.range(1).select(F.posexplode(release_candidates(F.lit(ref))).alias("pos", "want"))
    chunks = s.index.read("chunks").where(F.col("kind").isin(*HISTORY))
    hit = chunks.join(F.broadcast(ask), F.lower("ref") == F.lower("want")).orderBy("pos").first()
    if hit is None:
        return f"nothing indexed as {ref}"
    page = hit["text"][offset : offset + 6000]
    s.add(hit["ref"], hit["kind"], page)
    told = spark.createDataFrame([(hit["ref"], page)], "id string, page string")
    numbers = told.select("id", F.explode(linked_numbers(F.col("page"))).alias("number")).where(~F.col("number").eqNullSafe(number_of(F.col("id"))))
    links, end = _linked(s.index, numbers).get(hit["ref"], []), offset + len(page)
    more = f"\n[continue at offset={end}]" if end < len(hit["text"]) else ""
    return f"[{hit['ref']}] {(hit['created_at'] or '')[:10]}\n{page}{more}" + (f"\nlinked: {', '.join(links)}" if links else "")


def _code_history(s: Session, path: str, start_line: int, end_line: int) -> str:
    from lodestar.functions.text import linked_numbers

    path = path.strip().removeprefix("./")
    if not s.index.has("hunks"):
        return "no line history is indexed"
    if s.index.read("lines").where(F.col("path") == path).isEmpty():
        return "no such file"
    asked = s.index.spark.createDataFrame([(1, path, start_line, max(start_line, end_line))], "ask_id bigint, path string, start bigint, end bigint")
    rows = line_history(asked, s.index.read("hunks").where(F.col("path") == path)).join(s.index.read("commits"), "seq").orderBy("n").collect()
    told = s.index.spark.createDataFrame([(r["ref"], f"{r['title']}\n\n{r['body']}") for r in rows], "id string, message string")
    links = _linked(s.index, told.select("id", F.explode(linked_numbers(F.col("message"), threads=False)).alias("number")))
    out = []
    for r in rows:
        s.add(r["ref"], "commit", f"{r['title']}\n\n{r['body']}".strip())
        out.append(f"[{r['ref']}] {r['created_at'][:10]} {r['title']}" + (f" (linked: {', '.join(links[r['ref']])})" if r["ref"] in links else "") + (f"\n    {r['body'][:300]}" if r["body"] else ""))
    return "\n".join(out) or "no commit changed those lines"


def citations(s: Session, refs: list[str], repository: dict) -> list[dict]:
    """The references that the session's evidence backs, with their address, lines and text.

    repository: owner, name and commit_sha.
    """
    from lodestar.functions.text import ref_range, snippet, source_url

    spark = s.index.spark
    asked = spark.createDataFrame([("s", i, ref) for i, ref in enumerate(refs)], "session string, cite_id bigint, ref string")
    kinds = spark.createDataFrame([(i, kind) for i, (kind, *_) in enumerate(s.ledger.values())], "seq bigint, kind string")
    evidence = s.evidence().join(kinds, "seq")
    found = G.resolve(asked, evidence.drop("text", "kind")).where("resolved is not null").drop("ref", "session").join(evidence.drop("session", "ref"), "seq")
    lit = lambda name: F.lit(repository.get(name))
    _, start, end = ref_range(F.col("resolved"))
    rows = found.select("cite_id", F.col("resolved").alias("ref"), "kind", "path", F.when(F.col("path").isNotNull(), start).alias("start_line"), F.when(F.col("path").isNotNull(), end).alias("end_line"), source_url(lit("owner"), lit("name"), lit("commit_sha"), F.col("kind"), F.col("resolved")).alias("url"), snippet(F.col("text"), F.col("start_line"), F.col("resolved")).alias("snippet"))
    return [{k: v for k, v in r.asDict().items() if k != "cite_id"} for r in rows.orderBy("cite_id").collect()]


TOOLS: dict[str, Callable] = {"search_code": _search_code, "search_history": _search_history, "read_thread": _read_thread, "find_symbol": _find_symbol, "read_file": _read_file, "grep": _grep, "list_files": _list_files, "code_history": _code_history}


def problems(s: Session, question: str, answer: dict) -> list[str]:
    """What keeps an answer from being accepted."""
    spark, evidence = s.index.spark, s.evidence()
    cited, quotes = answer.get("citations", []), answer.get("rationale_quotes", [])
    asked = spark.createDataFrame([("s", i, ref) for i, ref in enumerate(cited)], "session string, cite_id bigint, ref string")
    lost = [r["ref"] for r in G.resolve(asked, evidence.drop("text")).where("resolved is null").orderBy("cite_id").collect()]
    told = spark.createDataFrame([("s", i, q["ref"], q["quote"]) for i, q in enumerate(quotes)], "session string, cite_id bigint, ref string, quote string")
    bad = [quotes[r["cite_id"]]["ref"] for r in G.quote_checks(told, evidence).where("not supported").orderBy("cite_id").collect()]
    row = spark.createDataFrame([(question, answer.get("answer", ""), cited, lost, bool(answer.get("abstained")), len(quotes), bad)], "question string, answer string, citations array<string>, unresolved array<string>, abstained boolean, n_quotes int, bad_quotes array<string>")
    return G.answer_problems(row).first()["problems"]


def answer(index: Index, question: str, model: Callable, on_event: Callable[[dict], None] | None = None) -> dict:
    """Runs the loop: tools until an answer passes, within the limits; else the model's last word without tools."""
    s, told, messages, calls, retries = Session(index), on_event or (lambda e: None), [], 0, 0
    seen: set[tuple] = set()
    for _ in range(MOST_REQUESTS):
        step = model(question, messages)
        if "answer" in step:
            found = problems(s, question, step["answer"])
            if not found or retries >= MOST_RETRIES:
                break
            retries += 1
            messages.append({"problems": found, "valid_refs": list(s.ledger)[:25]})
            continue
        if calls >= MOST_CALLS:
            step = None
            break
        calls += 1
        key = (step["tool"], tuple(sorted(step.get("args", {}).items())))
        told({"type": "tool_call", "tool": step["tool"], "args": step.get("args", {})})
        out = "already called with these arguments" if key in seen else TOOLS[step["tool"]](s, **step.get("args", {})) if step["tool"] in TOOLS else "no such tool"
        seen.add(key)
        s.trace.append({"tool": step["tool"], "args": step.get("args", {}), "refs": list(s.ledger)[-10:]})
        told({"type": "tool_result", "tool": step["tool"]})
        messages.append({"tool": step["tool"], "result": out})
    else:
        step = None
    if step is None or "answer" not in step:  # out of budget: newest evidence first, no tools
        kept, used = [], 0
        for ref, (_, text, *_rest) in reversed(s.ledger.items()):
            used += len(text)
            if used > G.BUDGET:
                break
            kept.append({"ref": ref, "text": text})
        step = model(question, [{"evidence": kept, "final": True}])
        found = problems(s, question, step["answer"])
    result = {"answer": step["answer"], "problems": found, "evidence": list(s.ledger), "trace": s.trace}
    told({"type": "answer", **result})
    told({"type": "done"})
    return result
