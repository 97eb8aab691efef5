"""Touched symbols against brute force, and with as many ranges as symbols in a file."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import graph

SYMBOL, HUNK = "name string, file_path string, line_start bigint, line_end bigint", "file_path string, start bigint, end bigint"


@pytest.mark.parametrize("reach", [3, 70, 700])
def test_overlapping_against_brute_force(spark, reach):
    r = random.Random(reach)
    place = lambda: (r.choice("ab"), a := r.randrange(-5, 2000), a + r.randrange(-1, reach))
    symbols = [(str(i), *place()) for i in range(400)] + [("null", "a", None, None)]
    hunks = [place() for _ in range(25)] + [("a", 63, 64), ("a", 255, 256), (None, 1, 2)]
    want = {n for n, f, a, b in symbols if a is not None and a <= b and any(f == g and lo <= hi and a <= hi and b >= lo for g, lo, hi in hunks)}
    got = [x.name for x in graph.overlapping(spark.createDataFrame(symbols, SYMBOL), spark.createDataFrame(hunks, HUNK)).collect()]
    assert sorted(got) == sorted(want) and 0 < len(want) < 400


def test_many_ranges_of_few_lines_are_not_all_pairs(spark):
    n = 300_000
    symbols = spark.range(n).select(F.col("id").cast("string").alias("name"), F.lit("f").alias("file_path"), (F.col("id") % 50).alias("line_start"), (F.col("id") % 50 + 2).alias("line_end"))
    hunks = spark.range(n).select(F.lit("f").alias("file_path"), (F.col("id") % 25).alias("start"), (F.col("id") % 25 + 3).alias("end"))
    assert graph.overlapping(symbols, hunks).count() == n // 50 * 28
