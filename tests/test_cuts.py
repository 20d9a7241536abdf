"""Searches for cuts on a grid of counts: the same as on the rows, which are read once."""

import random

import pytest
from pyspark.sql import functions as F

from blobloom.operators import similar


@pytest.fixture
def counted(spark):
    """Cells with keys, some outside of the area, and a counter of the rows that were read."""
    rng = random.Random(8)
    rows = [(rng.randrange(-3, 55), rng.randrange(-3, 110), rng.choice("aabbbcdefg"), "z") for _ in range(1500)]
    rows += [(None, 4, "a", "z"), (4, None, "a", "z")]
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame(rows, "x int, y int, k string, cells string").drop("cells")
    return rows, df.mapInArrow(count, df.schema), read


@pytest.mark.parametrize("measure", ["count", "entropy", "importance"])
def test_best_splits(counted, measure):
    rows, df, read = counted
    searches = [("v", "x", [10, 20, 30]), ("w", "x", [5, 12, 47]), ("h", "y", [3, 60, 61, 99])]
    got = {r["axis"]: (r["cut"], r["imbalance"]) for r in similar.best_splits(df, F.col("x"), F.col("y"), ["k"], searches, measure).collect()}
    assert read.value == len(rows)
    inside = df.where("x >= 0 and y >= 0")
    for name, which, cuts in searches:
        want = similar.best_split(inside, F.col(which), ["k"], cuts, measure).first()
        assert got[name] == (want["cut"], pytest.approx(want["imbalance"]))


@pytest.mark.parametrize("measure", ["count", "entropy"])
def test_three_way_layouts_read_the_rows_once(counted, measure):
    rows, df, read = counted
    x, y, width, height = F.col("x"), F.col("y"), 50, 100
    got = similar.three_way_layouts(df, x, y, ["k"], width, height, measure)
    assert read.value == len(rows)

    def cut(vertical, x0, y0, x1, y1):
        start, length = (x0, x1 - x0) if vertical else (y0, y1 - y0)
        part = df.where((x >= x0) & (x < x1) & (y >= y0) & (y < y1))
        return similar.best_split(part, x if vertical else y, ["k"], similar.split_points(length, start=start), measure).first()["cut"]

    h, v = cut(False, 0, 0, width, height), cut(True, 0, 0, width, height)
    assert got[0][0] == (0, 0, cut(True, 0, 0, width, h), h)
    assert got[1][1] == (0, h, cut(True, 0, h, width, height), height)
    assert got[2][0] == (0, 0, v, cut(False, 0, 0, v, height))
    assert got[3][1] == (v, 0, width, cut(False, v, 0, width, height))


def test_no_rows(spark):
    df = spark.createDataFrame([], "x int, y int, k string")
    assert similar.three_way_layouts(df, F.col("x"), F.col("y"), ["k"], 50, 100, "entropy")[0][2] == (0, 50, 50, 100)
