"""Chunking: threads, passages, pages, heading sections, line windows and code runs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.session import together

#: Sizes of passages, windows and sections.
PASSAGE, WINDOW_LINES, OVERLAP, LONGEST, SMALL_SECTION, SECTION_LINES = 1200, 60, 10, 80, 120, 60


def assemble_threads(turns: DataFrame) -> DataFrame:
    """(conv_id, body, n_comments) of turns (conv_id, turn, role, text), in order of turn."""
    comment = F.struct("turn", F.concat(F.lit("--- "), "role", F.lit(": "), "text").alias("s"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(comment)), lambda x: x["s"]), "\n\n")
    return turns.groupBy("conv_id").agg(F.concat(F.lit("Thread "), F.col("conv_id"), F.lit("\n\n"), joined).alias("body"), F.count(F.lit(1)).alias("n_comments"))


def pages(threads: DataFrame, size: int) -> DataFrame:
    """(conv_id, page, text, next_offset) of threads (conv_id, body), size characters a page."""
    n = F.ceil(F.length("body") / size).cast("bigint")
    rows = threads.where(F.length("body") > 0).select("conv_id", "body", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("page"))
    after = (F.col("page") + 1) * size
    return rows.select("conv_id", "page", F.substring("body", (F.col("page") * size + 1).cast("int"), F.lit(size)).alias("text"), F.when(after < F.length("body"), after).alias("next_offset"))


def _passages(body: str) -> Iterator[tuple[int, str]]:
    """(offset, text) of the passages of one thread."""
    parts = re.split(r"\n\n(?=--- )", body)
    at = 0
    for i, part in enumerate(parts):
        end = at + len(part) + (2 if i < len(parts) - 1 else 0)
        while at < end:
            feed = body.rfind("\n", at + PASSAGE // 2, at + PASSAGE) if end - at > PASSAGE else -1
            upto = min(end, feed if feed >= 0 else at + PASSAGE)
            if text := body[at:upto].strip(" \t\n\x0b\f\r"):
                yield at, text
            at = upto


def passages(threads: DataFrame) -> DataFrame:
    """(id, offset, text) of threads (id, body) longer than PASSAGE: a passage for each comment.

    Long comments are cut at their last line feed after half a passage, else hard. Positions count
    from 0 and point at the text before stripping; passages without text are left out. Where a cut
    falls depends on the one before it, so a thread is cut in one pass over its own text.
    """
    kind = threads.schema["id"].dataType

    def run(batches):
        for batch in batches:
            for i, body in zip(batch.column("id").to_pylist(), batch.column("body").to_pylist(), strict=True):
                found = list(_passages(body))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(found), batch.schema.field("id").type), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.string())], names=["id", "offset", "text"])

    return threads.where(F.length("body") > PASSAGE).select("id", "body").mapInArrow(run, f"id {kind.simpleString()}, offset bigint, text string")


def line_windows(start: Column, end: Column) -> Column:
    """Array of (start, end): windows of WINDOW_LINES overlapping by OVERLAP if a span is longer than LONGEST."""
    step = WINDOW_LINES - OVERLAP
    n = end - start + 1
    many = F.transform(F.sequence(F.lit(0).cast("bigint"), F.ceil((n - WINDOW_LINES) / step).cast("bigint")), lambda k: F.struct((start + k * step).alias("start"), F.least(start + k * step + WINDOW_LINES - 1, end).alias("end")))
    return F.when(n > LONGEST, many).otherwise(F.array(F.struct(start.alias("start"), end.alias("end"))))


def headings(lines: DataFrame) -> DataFrame:
    """lines (path, line, text) that are Markdown headings outside fences: level and heading.

    Adds nothing else; fences toggle by a running count.
    """
    order = Window.partitionBy("path").orderBy("line")
    # The patterns of fences and, below, of headings.
    fence = F.col("text").rlike(r"^\s*(```|~~~)")
    inside = F.sum(fence.cast("int")).over(order) % 2 == 1
    form = r"^(#{1,4})\s+(.+?)\s*#*\s*$"
    return lines.withColumns({"fence": fence, "inside": inside}).where(~F.col("fence") & ~F.col("inside") & F.col("text").rlike(form)).select("path", "line", F.length(F.regexp_extract("text", form, 1)).alias("level"), F.trim(F.regexp_extract("text", form, 2)).alias("heading"))


def breadcrumbs(found: DataFrame) -> DataFrame:
    """headings with their trail of parents: for each level the latest heading that is still open."""
    order = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    open_ = []
    for level in range(1, 5):
        last = F.max(F.when(F.col("level") <= level, F.struct("line", "level", "heading"))).over(order)
        open_.append(F.when((last["level"] == level) & (F.lit(level) <= F.col("level")), last["heading"]))
    return found.withColumn("trail", F.concat_ws(" > ", *open_))


def sections(lines: DataFrame) -> DataFrame:
    """(path, title, start, end): heading sections, and the lines before the first heading."""
    found = breadcrumbs(headings(lines)).select("path", F.col("line").alias("start"), F.col("trail").alias("title"))
    last = lines.groupBy("path").agg(F.max("line").alias("n"))
    first = last.join(found.where("start = 1").select("path"), "path", "left_anti").select("path", F.lit(1).alias("start"), F.lit(None).cast("string").alias("title"))
    order = Window.partitionBy("path").orderBy("start")
    return found.unionByName(first, allowMissingColumns=True).join(last, "path").select("path", "title", "start", F.coalesce(F.lead("start").over(order) - 1, "n").alias("end"))


def sized(sections: DataFrame, lines: DataFrame) -> DataFrame:
    """sections (path, start, end, ...) with size, the letters of their lines, from running sums over each path."""
    n = F.length("text").cast("bigint")
    upto = F.sum(n).over(Window.partitionBy("path").orderBy("line"))
    sums = lines.select("path", "line", upto.alias("upto"), (upto - n).alias("before"))
    first, last = sums.select("path", F.col("line").alias("start"), "before"), sums.select("path", F.col("line").alias("end"), "upto")
    return sections.join(first, ["path", "start"]).join(last, ["path", "end"]).withColumn("size", F.col("upto") - F.col("before")).drop("upto", "before")


def merge_small(rows: DataFrame) -> DataFrame:
    """Sections (path, title, start, end, size) with those below SMALL_SECTION carried into the next.

    A fold over a document's own sections: an array of structs in order, one document at a time.
    """
    item = F.struct("start", "end", "title", "size")
    ordered = rows.groupBy("path").agg(F.array_sort(F.collect_list(item)).alias("xs"), F.max("end").alias("n"))
    empty = "cast(array() as array<struct<title:string,start:int,end:int>>)"
    fold = f"""aggregate(xs, named_struct('out', {empty}, 'ps', cast(null as int), 'pt', cast(null as string)),
      (a, x) -> CASE WHEN x.size < {SMALL_SECTION} AND x.end < n
        THEN named_struct('out', a.out, 'ps', coalesce(a.ps, cast(x.start as int)), 'pt', coalesce(x.title, a.pt))
        ELSE named_struct('out', concat(a.out, array(named_struct('title', coalesce(x.title, a.pt), 'start', coalesce(a.ps, cast(x.start as int)), 'end', cast(x.end as int)))), 'ps', cast(null as int), 'pt', cast(null as string)) END,
      a -> CASE WHEN a.ps IS NULL THEN a.out ELSE concat(a.out, array(named_struct('title', a.pt, 'start', a.ps, 'end', cast(n as int)))) END)"""
    return ordered.select("path", F.explode(F.expr(fold)).alias("s")).select("path", "s.title", "s.start", "s.end")


def split_long(sections: DataFrame, lines: DataFrame) -> DataFrame:
    """sections (path, start, end, any others) with those of more than SECTION_LINES lines cut into several.

    A piece ends at the last blank line of its second half, else after SECTION_LINES lines; the next one
    begins after it, so a section is cut in one pass over its blank lines, in order. lines: path, line, text.
    """
    others = [c for c in sections.columns if c not in ("path", "start", "end")]
    long_ = F.col("end") - F.col("start") + 1 > SECTION_LINES
    own = sections.where(long_).select("path", F.struct("start", "end", *others).alias("section"), F.col("start").cast("bigint").alias("at"), F.lit(0).alias("kind"))
    blank = lines.where(~F.col("text").rlike(r"\S")).join(sections.where(long_).select("path").distinct(), "path", "left_semi").select("path", F.lit(None).cast(own.schema["section"].dataType).alias("section"), F.col("line").cast("bigint").alias("at"), F.lit(1).alias("kind"))
    ordered = together(own.unionByName(blank), "path").sortWithinPartitions("path", "at", "kind")
    kinds = ", ".join(f"`{c}` {sections.schema[c].dataType.simpleString()}" for c in sections.columns)
    names = sections.columns

    def pieces(first: int, last: int, blanks: list[int], done: bool) -> tuple[list[tuple[int, int]], int]:
        """Pieces that are settled by the blank lines so far, and where the next one begins."""
        out, seen = [], blanks[-1] if blanks else 0
        while last - first + 1 > SECTION_LINES and (done or seen >= first + SECTION_LINES - 1):
            stop = first + SECTION_LINES - 1
            stop = max((b for b in blanks if first + SECTION_LINES // 2 < b <= stop), default=stop)
            out.append((first, stop))
            first = stop + 1
        return out, first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, section, first, blanks = None, None, 0, []

        def told(found: list[tuple[int, int]], types: pa.Schema) -> Iterator[pa.RecordBatch]:
            rows = [{**section, "path": path, "start": a, "end": b} for a, b in found]
            if rows:
                yield pa.RecordBatch.from_pydict({c: [r[c] for r in rows] for c in names}, schema=types)

        def closed(types: pa.Schema) -> Iterator[pa.RecordBatch]:
            if section is not None:
                found, rest = pieces(first, section["end"], blanks, True)
                yield from told([*found, (rest, section["end"])], types)

        types = None
        for batch in batches:
            if types is None:
                inner = batch.schema.field("section").type
                types = pa.schema([("path", batch.schema.field("path").type) if c == "path" else (c, inner.field(c).type) for c in names])
            for p, s, at, kind in zip(*(batch.column(c).to_pylist() for c in ("path", "section", "at", "kind")), strict=True):
                if kind == 0 or p != path:
                    yield from closed(types)
                    path, section, first, blanks = p, s, at, []
                elif section is not None and at <= section["end"]:
                    blanks.append(at)
                    if len(blanks) > SECTION_LINES:
                        found, first = pieces(first, section["end"], blanks, False)
                        yield from told(found, types)
                        blanks = [b for b in blanks if b >= first]
        if types is not None:
            yield from closed(types)

    return sections.where(~long_).unionByName(ordered.mapInArrow(run, kinds))


def islands(lines: DataFrame) -> DataFrame:
    """(path, start, end, n_full) of runs of neighbouring lines (path, line, text) with at least 3 non-blank ones, trimmed to them."""
    full = F.when(F.col("text").rlike(r"\S"), F.col("line"))
    order = Window.partitionBy("path").orderBy("line")
    runs = lines.withColumn("run", F.col("line") - F.row_number().over(order)).groupBy("path", "run")
    return runs.agg(F.min(full).alias("start"), F.max(full).alias("end"), F.count(full).alias("n_full")).where("n_full >= 3").drop("run")
