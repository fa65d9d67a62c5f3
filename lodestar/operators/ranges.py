"""Line-range joins: an equality on path and block of lines, then the exact test.

Ranges are exploded over blocks of BLOCK lines, so a join compares only what shares a block; wide
ranges cost one row a block, and no path is joined with itself as a whole.

Where only one range of each point is asked for, or none, pairs are not made at all: a range is cut into
the few dyadic spans (2^level lines from a multiple of 2^level) that it consists of, spans keep their
best range, and a line looks at the spans that it lies in, one a level. So the cost follows the ranges and
the different lines, however many of them fall on each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.session import cut

BLOCK = 64


def _blocks(ranges: DataFrame) -> DataFrame:
    return ranges.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor(F.col("end") / BLOCK))))


def points_in(points: DataFrame, ranges: DataFrame, how: str = "inner") -> DataFrame:
    """points (path, line, ...) joined with the ranges (path, start, end, ...) that hold their line."""
    spread = _blocks(ranges.select(*[F.col(c).alias("r_path" if c == "path" else c) for c in ranges.columns]))
    on = (F.col("path") == F.col("r_path")) & (F.floor(F.col("line") / BLOCK) == F.col("block")) & F.col("line").between(F.col("start"), F.col("end"))
    out = points.join(spread, on, how)
    return out if how in ("left_anti", "left_semi") else out.drop("block", "r_path")


def _spans(start: Column, end: Column) -> Column:
    """Array of (level, span): the dyadic spans that make up the lines from start to end, two a level at most."""

    def of(level: Column) -> Column:
        first, after = -_halved(-start, level), _halved(end + 1, level)
        left = F.when((first < after) & (first % 2 != 0), F.struct(level.alias("level"), first.alias("span")))
        right = F.when((first < after) & (after % 2 != 0), F.struct(level.alias("level"), (after - 1).alias("span")))
        return F.array_compact(F.array(left, right))

    levels = F.sequence(F.lit(0), F.floor(F.log2(F.greatest(end - start + 1, F.lit(1)))).cast("int"))
    return F.when(start <= end, F.flatten(F.transform(levels, of)))


def _halved(line: Column, level: Column) -> Column:
    return F.call_function("shiftright", line, level)


def _held(points: DataFrame, ranges: DataFrame, best: Column) -> DataFrame:
    """(path, line, best) of the different lines of points that lie in a range; best: an aggregate that can be taken again of its own values."""
    whole = ranges.withColumns({c: F.col(c).cast("bigint") for c in ("start", "end")})
    spread = whole.select("*", F.explode(_spans(F.col("start"), F.col("end"))).alias("s")).select("*", "s.level", "s.span")
    spans = cut(spread.groupBy("path", "level", "span").agg(best.alias("best")))
    levels = [r["level"] for r in spans.select("level").distinct().collect()]  # 64 at most
    if not levels:
        return points.select("path", "line", F.lit(None).cast(spans.schema["best"].dataType).alias("best")).limit(0)
    lines = points.where("path is not null and line is not null").select("path", "line").distinct()
    asked = lines.withColumn("level", F.explode(F.array(*[F.lit(x) for x in sorted(levels)])))
    asked = asked.withColumn("span", _halved(F.col("line").cast("bigint"), F.col("level")))
    return asked.join(spans, ["path", "level", "span"]).groupBy("path", "line").agg(F.min("best").alias("best"))


def innermost(points: DataFrame, definitions: DataFrame, key: str) -> DataFrame:
    """Each point with the shortest definition around it (def_id; null at module level)."""
    others = [c for c in definitions.columns if c not in ("path", "start", "end", "def_id")]
    size = (F.col("end") - F.col("start")).alias("size")
    best = _held(points, definitions, F.min(F.struct(size, "def_id", *others)))
    on = (F.col("path") == F.col("h_path")) & (F.col("line") == F.col("h_line"))
    joined = points.join(best.withColumnsRenamed({"path": "h_path", "line": "h_line"}), on, "left")
    n = F.row_number().over(Window.partitionBy(key).orderBy("best.size", "best.def_id"))
    return joined.withColumn("n", n).where("n = 1").select(*points.columns, "best.def_id", *[f"best.{c}" for c in others])


def outside(points: DataFrame, definitions: DataFrame, key: str) -> DataFrame:
    """Points in no definition."""
    return points.join(_held(points, definitions, F.min(F.lit(True))), ["path", "line"], "left_anti").select(*points.columns)


def overlap_pairs(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Distinct (left_key, right_key) of ranges of one path that overlap.

    A pair that shares several blocks is kept in the first one only.
    """
    a = _blocks(left.select(left_key, "path", "start", "end"))
    b = _blocks(right.select(right_key, "path", F.col("start").alias("s"), F.col("end").alias("e"))) if "start" not in right.columns else _blocks(right.select(right_key, "path", "start", "end")).withColumnsRenamed({"start": "s", "end": "e"})
    first = F.col("block") == F.floor(F.greatest("start", "s") / BLOCK)
    return a.join(b, ["path", "block"]).where(first & (F.col("s") <= F.col("end")) & (F.col("start") <= F.col("e"))).select(left_key, right_key)


def overlapping(ranges: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """Ranges that overlap a gold range of their path, or lie in a path that is gold as a whole."""
    parts = overlap_pairs(ranges, gold.where("not whole"), key, "gold_id").select(key)
    files = ranges.join(gold.where("whole").select("path").distinct(), "path", "left_semi").select(key)
    return ranges.join(parts.unionByName(files).distinct(), key, "left_semi")
