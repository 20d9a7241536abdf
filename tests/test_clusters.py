"""k-means with its own seeding against plain Python."""

import hashlib
import math
import random

import pytest

from blobloom.operators import clusters


def uniform(seed, turn, id_):
    return (int(hashlib.md5(f"{seed}:{turn}:{id_}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52


def plain_fit(points, k, seed, rounds, tolerance, farthest):
    """points: (id, vector, weight)."""
    centres = [min(points, key=lambda p: (-math.log(uniform(seed, 0, p[0])) / p[2], p[0]))[1]]
    for turn in range(1, k):
        gaps = [(min(math.dist(p[1], c) for c in centres), p) for p in points]
        gaps = [(d, p) for d, p in gaps if d > 0]
        if not gaps:
            break
        if farthest:
            centres.append(min(gaps, key=lambda g: (-(g[0] * g[1][2]), g[1][0]))[1][1])
        else:
            centres.append(min(gaps, key=lambda g: (-math.log(uniform(seed, turn, g[1][0])) / (g[0] ** 2 * g[1][2]), g[1][0]))[1][1])
    centres = [list(c) for c in centres]
    for _ in range(rounds):
        own = [[] for _ in centres]
        for p in points:
            own[min(range(len(centres)), key=lambda i: (math.dist(p[1], centres[i]), i))].append(p)
        moved = 0
        for i, members in enumerate(own):
            if members:
                total = sum(m[2] for m in members)
                new = [sum(m[1][j] * m[2] for m in members) / total for j in range(len(centres[i]))]
                moved = max(moved, math.dist(new, centres[i]))
                centres[i] = new
        if moved <= tolerance:
            break
    return centres


@pytest.fixture(scope="module")
def points():
    rng = random.Random(4)
    return [(i, [rng.gauss(10 * (i % 3), 1), rng.gauss(7 * (i % 5), 1)], float(rng.randrange(1, 40))) for i in range(300)]


@pytest.mark.parametrize("farthest", [False, True])
@pytest.mark.parametrize(("k", "seed"), [(1, 0), (4, 3), (12, 5)])
def test_fit(spark, points, farthest, k, seed):
    """12 seeds are more than are kept before the distances are written."""
    df = spark.createDataFrame(points, "id int, v array<double>, w double").repartition(5)
    found = clusters.fit(df, "id", "v", k, seed, 10, 0.01, weight="w", farthest=farthest)
    want = plain_fit(points, k, seed, 10, 0.01, farthest)
    assert len(found.centres) == len(want)
    for a, b in zip(found.centres, want, strict=True):
        assert a == pytest.approx(b)
    assert sum(found.weights) == pytest.approx(sum(p[2] for p in points))
    assert clusters.fit(df.repartition(2), "id", "v", k, seed, 10, 0.01, weight="w", farthest=farthest).centres[0] == pytest.approx(found.centres[0])


def test_clusters_of_points(spark, points):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v, _ in points], "id int, v array<double>, _w int, idx string")
    got = {r["id"]: r["cluster"] for r in clusters.spread_kmeans(df, "id", "v", 5, seed=2, tolerance=0.01).collect()}
    want = plain_fit([(i, v, 1.0) for i, v, _ in points], 5, 2, 10, 0.01, False)
    assert got == {i: min(range(5), key=lambda c: (math.dist(v, want[c]), c)) for i, v, _ in points}


def test_few_missing_and_no_points(spark):
    rows = [(1, [0.0], 5), (2, [0.0], 7), (3, [9.0], 1), (4, None, 3), (None, [50.0], 3), (6, [70.0], 0), (7, [80.0], None)]
    df = spark.createDataFrame(rows, "id int, v array<double>, cnt int")
    found = clusters.fit(df, "id", "v", 5, 0, 10, 1.0, weight="cnt", farthest=True)
    assert sorted(found.centres) == [[0.0], [9.0]] and sorted(found.weights) == [1.0, 12.0]
    got = clusters.weighted_kmeans(df, "id", "v", 5).collect()
    assert [r["cluster"] is None for r in got] == [False, False, False, True, False, False, False]
    none = df.where("id > 100")
    assert clusters.fit(none, "id", "v", 3, 0, 10, 1.0).centres == []
    assert clusters.spread_kmeans(none, "id", "v", 3).collect() == []
    assert clusters.centroids(found, spark).count() == 2


def test_an_empty_cluster_keeps_its_place(spark):
    """No point is nearest to the third centroid once both others have moved."""
    fit = clusters.Fit([[0.0], [10.0], [100.0]], [0.0] * 3, 0)
    df = spark.createDataFrame([(1, [1.0]), (2, [9.0])], "id int, v array<double>")
    assert [r["cluster"] for r in fit.assign(df, "v").orderBy("id").collect()] == [0, 1]
