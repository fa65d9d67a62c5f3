"""Line ranges against a loop, and how many rows they make."""

import json
import random

from pyspark.sql import functions as F

from lodestar.operators import ranges

DEFS, POINTS = "path string, start int, end int, def_id bigint, label string", "call_id bigint, path string, line int"


def test_innermost_and_outside_against_a_loop(spark):
    random.seed(5)
    defs = [(random.choice("abc"), s, s + random.choice([-1, 0, 1, 5, 64, 300, 5000]), i, f"l{i}") for i in range(300) for s in [random.randint(-3, 4000)]] + [(None, 1, 9, 900, "x"), ("a", None, 9, 901, "x"), ("a", 3, None, 902, "x")]
    points = [(i, random.choice(["a", "b", "c", "d"]), random.randint(-5, 12_000)) for i in range(800)] + [(900, None, 3), (901, "a", None)]

    def around(path, line):
        return [(e - s, i, label) for p, s, e, i, label in defs if None not in (p, path, s, e, line) and p == path and s <= line <= e]

    frame, dots = spark.createDataFrame(defs, DEFS), spark.createDataFrame(points, POINTS)
    want = {(i, p, line, *(min(around(p, line))[1:] if around(p, line) else (None, None))) for i, p, line in points}
    found = ranges.innermost(dots, frame, "call_id")
    assert {tuple(r) for r in found.select("call_id", "path", "line", "def_id", "label").collect()} == want and found.count() == len(points)
    assert {tuple(r) for r in ranges.outside(dots, frame, "call_id").collect()} == {x[:3] for x in want if x[3] is None}
    assert ranges.innermost(dots, frame.limit(0), "call_id").where("def_id is null").count() == len(points)
    assert ranges.outside(dots, frame.limit(0), "call_id").count() == len(points)


def test_rows_of_ranges_on_one_another(spark):
    """2,000 ranges around the lines of 2,000 points make no pairs."""
    n = F.col("id")
    defs = spark.range(2_000).select(F.lit("m").alias("path"), (n % 7 + 1).alias("start"), (n % 7 + 40).alias("end"), n.alias("def_id"))
    points = spark.range(2_000).select(n.alias("call_id"), F.lit("m").alias("path"), (n % 5 + 10).alias("line"))
    rows = []
    for found in (ranges.innermost(points, defs, "call_id"), ranges.outside(points, defs.where("start > 3"), "call_id")):
        found.collect()
        plan, nodes = found._jdf.queryExecution().executedPlan(), []
        todo = [plan]
        while todo:
            node = todo.pop()
            name = node.getClass().getSimpleName()
            todo += [node.executedPlan()] if name.startswith("AdaptiveSparkPlan") else [node.plan()] if name.endswith("QueryStageExec") else [node.children().apply(i) for i in range(node.children().size())]
            if "Join" in name:
                nodes.append(node.metrics().apply("numOutputRows").value())
        rows += nodes
    assert rows and max(rows) <= 2_000, json.dumps(rows)
