"""k-means with seeding of its own, repeatable and in SQL's reach.

The driver holds the centroids, at most 256 of them, and nothing else: each seed and each round is one
aggregate over the points. Random choice is by keys -ln(u) / weight, with u from a hash of the point's id and
the least key taken, which draws a point with a probability in proportion to its weight in one pass.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binary import let
from ..shared import written
from .similar import PALETTE_SIZE, distance

# Seeds after which the distances so far are written, so that they are not computed again.
SEEDS_AT_ONCE = 8


def uniform(seed: int, turn: int, id_: str) -> Column:
    """A number between 0 and 1 from a hash of (seed, turn, id): the same on every run and engine."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(turn)), F.col(id_).cast("string")).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / 2.0**52


@dataclass
class Fit:
    """Centroids in the order of their seeds, the weight of their last members, and the rounds that it took."""

    centres: list[list[float]]
    weights: list[float]
    rounds: int

    def assign(self, points: DataFrame, vector: str, out: str = "cluster") -> DataFrame:
        """The points with the number of their nearest centroid, the smallest of equal ones; null without a vector."""
        return points.withColumn(out, _nearest(vector, self.centres))


def _nearest(vector: str, centres: list[list[float]]) -> Column:
    if not centres:
        return F.lit(None).cast("int")
    table = F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(c).alias("centre")) for i, c in enumerate(centres)])

    def best(point):
        return F.array_min(F.transform(table, lambda c: F.struct(distance(point, c["centre"]).alias("d"), c["idx"].alias("idx"))))["idx"]

    value = F.col(vector).cast("array<double>")
    return F.when(value.isNotNull(), let(value, best))


def _seeds(points: DataFrame, k: int, seed: int, farthest: bool) -> list[list[float]]:
    """The first centroid is drawn by weight; the next ones by squared distance to the nearest so far, or the farthest by distance x weight."""
    centres, pending = [], []
    for turn in range(k):
        if not turn:
            gap = weight = F.col("_w")
        else:
            near = F.least(F.col("_d"), *[distance(F.col("_v"), F.lit(c)) for c in pending])
            if len(pending) == SEEDS_AT_ONCE:
                points, pending = written(points.withColumn("_d", near), "distances"), []
                near = F.col("_d")
            gap = near
            weight = near * F.col("_w") if farthest else near * near * F.col("_w")
        key = -weight if farthest and turn else -F.log(uniform(seed, turn, "_id")) / weight
        found = points.where(gap > 0).agg(F.min_by("_v", F.struct(key.alias("key"), F.col("_id")))).first()[0]
        if found is None:
            break  # fewer different points than clusters
        centres.append(list(found))
        pending.append(list(found))
    return centres


def fit(points: DataFrame, id_: str, vector: str, k: int, seed: int, rounds: int, tolerance: float, weight: str | None = None, farthest: bool = False) -> Fit:
    """Centroids after seeding and at most `rounds` rounds; it stops when none moves farther than `tolerance`.

    An empty cluster keeps its centroid. Rows without an id, a vector or a positive weight take no part. Fewer
    different vectors than k give fewer clusters; no points give none.
    """
    if k > PALETTE_SIZE:
        raise ValueError(f"at most {PALETTE_SIZE} clusters")
    amount = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    used = points.select(F.col(id_).alias("_id"), F.col(vector).cast("array<double>").alias("_v"), amount.alias("_w"))
    used = used.where("_id is not null and _v is not null and _w > 0").withColumn("_d", F.lit(float("inf")))
    # Written once, as every seed and round reads it.
    used = written(used, "points")
    centres = _seeds(used, k, seed, farthest)
    weights, turn = [0.0] * len(centres), 0
    for turn in range(1, rounds + 1 if centres else 1):
        told = used.select(_nearest("_v", centres).alias("idx"), array_to_vector("_v").alias("_f"), "_w")
        means = told.groupBy("idx").agg(Summarizer.mean(F.col("_f"), F.col("_w")).alias("mean"), F.sum("_w").alias("weight")).collect()
        weights, moved = [0.0] * len(centres), 0.0
        for row in means:  # one row per cluster
            new = [float(x) for x in row["mean"].toArray()]
            moved = max(moved, sum((a - b) ** 2 for a, b in zip(new, centres[row["idx"]], strict=True)) ** 0.5)
            centres[row["idx"]], weights[row["idx"]] = new, row["weight"]
        if moved <= tolerance:
            break
    return Fit(centres, weights, turn)


def spread_kmeans(points: DataFrame, id_: str, vector: str, k: int, seed: int = 0, rounds: int = 10, tolerance: float = 0.5) -> DataFrame:
    """Points with their cluster: seeds spread by squared distance, at most ten rounds."""
    return fit(points, id_, vector, k, seed, rounds, tolerance).assign(points, vector)


def weighted_kmeans(hist: DataFrame, id_: str, vector: str, k: int, count: str = "cnt", seed: int = 0, rounds: int = 10, tolerance: float = 1.0) -> DataFrame:
    """Distinct values with their counts, and their cluster: the next seed is the farthest value by distance x count."""
    return fit(hist, id_, vector, k, seed, rounds, tolerance, weight=count, farthest=True).assign(hist, vector)


def centroids(found: Fit, spark) -> DataFrame:
    """(idx, centre, weight) of a fit."""
    rows = list(zip(range(len(found.centres)), found.centres, found.weights, strict=True))
    return spark.createDataFrame(rows, "idx int, centre array<double>, weight double")
