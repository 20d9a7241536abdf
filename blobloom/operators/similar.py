"""Split search, similarity of histograms, grouping, clustering and nearest match."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.binary import let
from ..shared import small_rows, written
from .lookups import assign_region
from .profile import SCORES, spread_of

# A palette index is one byte.
PALETTE_SIZE = 256
# Up to this many groups, a task holds all pair overlaps in one matrix (8 MB).
MATRIX_GROUPS = 1_000
# Beyond that: groups of a block, and pairs that a task adds up at once.
BLOCK_GROUPS, PAIRS_TOGETHER = 512, 4_000_000


# --- where to cut ---------------------------------------------------------------------------


def split_points(length: int, low: float = 0.3, high: float = 0.7, step: int | None = 8, start: int = 0) -> list[int]:
    """Candidate cuts of start..start+length between two shares of the length.

    With step None there are about 20 of them, and never one at the very ends.
    """
    first, last = math.floor(start + length * low), math.floor(start + length * high)
    if step is None:
        first, last = max(start + 1, first), min(start + length - 1, last)
        step = max(1, (last - first) // 20)
    return list(range(first, last + 1, step))


def _passed(position: Column, cuts: Sequence[int]) -> Column:
    """How many of the ascending cuts are at or below the position."""
    return sum((F.when(position >= c, 1).otherwise(0) for c in cuts), F.lit(0))


def _line_below(position: Column, lines: Sequence[int]) -> Column:
    """The last of the ascending lines that is at or below the position; NULL in front of the first."""
    return F.greatest(*[F.when(position >= line, F.lit(line)) for line in lines], F.lit(None).cast("int"))


def grid_counts(df: DataFrame, x: Column, y: Column, key: Sequence[str], x_lines: Sequence[int], y_lines: Sequence[int]) -> DataFrame:
    """(gx, gy, key, cells): rows per key and cell of a grid, which is named by its lower lines; written.

    Every search for a cut along one of the lines gives the same on this table (with x, y = gx, gy and the
    weight `cells`) as on the rows, which are read once. Rows in front of the first lines are left out.
    """
    gx, gy = _line_below(x, sorted(x_lines)).alias("gx"), _line_below(y, sorted(y_lines)).alias("gy")
    counts = df.groupBy(gx, gy, *key).agg(F.count("*").alias("cells"))
    return written(counts.where("gx is not null and gy is not null"), "grid")


def _rows(weight: str | None) -> Column:
    return F.count("*") if weight is None else F.sum(weight)


def split_scores(df: DataFrame, position: Column, key: Sequence[str], cuts: Sequence[int], measure: str, weight: str | None = None) -> DataFrame:
    """Imbalance of the two sides for every candidate cut: (cut, imbalance).

    The rows are counted once per (stretch between cuts, key). The left side of every cut is
    then a sum of stretches; nothing is counted again per candidate. With a weight a row
    stands for so many.
    """
    cuts = sorted(cuts)
    measure = "count" if measure == "area" else measure
    hist = df.groupBy(_passed(position, cuts).alias("_b"), *key).agg(_rows(weight).alias("cnt"))
    left = [F.sum(F.when(F.col("_b") <= i, F.col("cnt")).otherwise(0)).alias(f"_l{i}") for i in range(len(cuts))]
    per_key = hist.groupBy(*key).agg(F.sum("cnt").alias("_all"), *left)
    sides = [
        F.struct(F.lit(c).alias("cut"), F.lit(side).alias("side"), counted.alias("cnt"))
        for i, c in enumerate(cuts)
        for side, counted in ((0, F.col(f"_l{i}")), (1, F.col("_all") - F.col(f"_l{i}")))
    ]
    both = per_key.select(*key, F.inline(F.array(*sides))).where(F.col("cnt") > 0)
    scored = SCORES[measure](both, ["cut", "side"])
    return scored.groupBy("cut").agg(spread_of(measure, groups=2).alias("imbalance"))


def first_minimum(scores: DataFrame, order: Sequence[str]) -> DataFrame:
    """The candidate with the smallest imbalance, the first in order on a tie."""
    usable = scores.where(F.col("imbalance").isNotNull() & ~F.isnan("imbalance"))
    best = F.min(F.struct(F.col("imbalance"), *order))
    return usable.agg(best.alias("_best")).select(*[f"_best.{c}" for c in order], "_best.imbalance")


def best_split(df: DataFrame, position: Column, key: Sequence[str], cuts: Sequence[int], measure: str, weight: str | None = None) -> DataFrame:
    return first_minimum(split_scores(df, position, key, cuts, measure, weight), ["cut"])


def best_splits(df: DataFrame, x: Column, y: Column, key: Sequence[str], searches: Sequence[tuple[str, str, Sequence[int]]], measure: str) -> DataFrame:
    """(axis, cut, imbalance) of several searches (name, "x" or "y", cuts), after one pass over the rows.

    A search without a usable cut has no row. Rows without a position are left out, as are negative ones.
    """
    lines = {which: sorted({0, *(c for _, w, cuts in searches if w == which for c in cuts)}) for which in ("x", "y")}
    grid = grid_counts(df, x, y, key, lines["x"], lines["y"])
    out = None
    for name, which, cuts in searches:
        best = best_split(grid, F.col(f"g{which}"), key, cuts, measure, "cells").select(F.lit(name).alias("axis"), "cut", "imbalance")
        out = best if out is None else out.unionByName(best)
    return out


def quadrant_scores(
    df: DataFrame, x: Column, y: Column, key: Sequence[str], x_cuts: Sequence[int], y_cuts: Sequence[int], measure: str, width: int = 0, height: int = 0
) -> DataFrame:
    """Imbalance of the four parts for every pair of cuts: (h, v, imbalance)."""
    x_cuts, y_cuts = sorted(x_cuts), sorted(y_cuts)
    pairs = [(j, h, i, v) for j, h in enumerate(y_cuts) for i, v in enumerate(x_cuts)]
    if measure == "area":
        rows = []
        for _, h, _, v in pairs:
            areas = [w * t for w in (v, width - v) for t in (h, height - h)]
            rows.append((h, v, float(max(areas) - min(areas))))
        return df.sparkSession.createDataFrame(rows, "h int, v int, imbalance double")
    hist = df.groupBy(_passed(x, x_cuts).alias("_bx"), _passed(y, y_cuts).alias("_by"), *key).agg(
        F.count("*").alias("_n")
    )
    parts = [
        F.struct(
            F.lit(h).alias("h"),
            F.lit(v).alias("v"),
            ((F.col("_bx") > i).cast("int") + (F.col("_by") > j).cast("int") * 2).alias("part"),
        )
        for j, h, i, v in pairs
    ]
    placed = hist.select(*key, "_n", F.inline(F.array(*parts)))
    counted = placed.groupBy("h", "v", "part", *key).agg(F.sum("_n").alias("cnt"))
    scored = SCORES[measure](counted, ["h", "v", "part"])
    return scored.groupBy("h", "v").agg(spread_of(measure, groups=4).alias("imbalance"))


def best_quadrants(df: DataFrame, x: Column, y: Column, key: Sequence[str], x_cuts, y_cuts, measure: str, **size) -> DataFrame:
    return first_minimum(quadrant_scores(df, x, y, key, x_cuts, y_cuts, measure, **size), ["h", "v"])


def arrangement_scores(df: DataFrame, x: Column, y: Column, key: Sequence[str], layouts: Sequence[Sequence], measure: str) -> DataFrame:
    """Imbalance of each layout, a list of rectangles (x0, y0, x1, y1): (layout, imbalance).

    Rows are counted once by key and by their place in all layouts together.
    """
    measure = "count" if measure == "area" else measure
    places = [assign_region(x, y, rects, None).alias(f"_p{i}") for i, rects in enumerate(layouts)]
    hist = df.groupBy(*places, *key).agg(F.count("*").alias("_n"))
    options = [F.struct(F.lit(i).alias("layout"), F.col(f"_p{i}").alias("region")) for i in range(len(layouts))]
    placed = hist.select(*key, "_n", F.inline(F.array(*options))).where(F.col("region").isNotNull())
    counted = placed.groupBy("layout", "region", *key).agg(F.sum("_n").alias("cnt"))
    scored = SCORES[measure](counted, ["layout", "region"])
    sizes = {i: len(rects) for i, rects in enumerate(layouts)}
    parts = F.create_map(*[F.lit(v) for pair in sizes.items() for v in pair])[F.col("layout")]
    regions = scored.withColumn("_parts", parts)
    empty = F.count("*") < F.first("_parts")
    spread = spread_of(measure)
    if measure != "importance":
        spread = F.when(empty, F.max("score")).otherwise(spread)
    return regions.groupBy("layout").agg(spread.alias("imbalance"))


def choose_arrangement(df: DataFrame, x: Column, y: Column, key: Sequence[str], layouts, measure: str) -> DataFrame:
    """The layout with the smallest imbalance; the first one wins a tie."""
    return first_minimum(arrangement_scores(df, x, y, key, layouts, measure), ["layout"])


def two_way_layouts(width: int, height: int, h: int, v: int) -> list:
    """Top and bottom, then left and right."""
    return [[(0, 0, width, h), (0, h, width, height)], [(0, 0, v, height), (v, 0, width, height)]]


def three_way_layouts(df: DataFrame, x: Column, y: Column, key: Sequence[str], width: int, height: int, measure: str) -> list:
    """The four ways to cut an area in two and one half in two again.

    All six cuts lie on the same candidates (or in the middle, if there is no usable one), so the rows are
    counted once, on the grid of these, and each search is one over the counts; only the found numbers come back.
    """
    lines = [sorted({0, length, length // 2, *split_points(length)}) for length in (width, height)]
    grid = grid_counts(df, x, y, key, *lines)

    def cut(vertical: bool, x0: int, y0: int, x1: int, y1: int) -> int:
        inside = grid.where(F.col("gx").between(x0, x1 - 1) & F.col("gy").between(y0, y1 - 1))
        start, length = (x0, x1 - x0) if vertical else (y0, y1 - y0)
        points = split_points(length, start=start)
        found = best_split(inside, F.col("gx" if vertical else "gy"), key, points, measure, "cells").first()
        return found["cut"] if found["cut"] is not None else start + length // 2

    h, v = cut(False, 0, 0, width, height), cut(True, 0, 0, width, height)
    top, bottom = cut(True, 0, 0, width, h), cut(True, 0, h, width, height)
    left, right = cut(False, 0, 0, v, height), cut(False, v, 0, width, height)
    return [
        [(0, 0, top, h), (top, 0, width, h), (0, h, width, height)],
        [(0, 0, width, h), (0, h, bottom, height), (bottom, h, width, height)],
        [(0, 0, v, left), (0, left, v, height), (v, 0, width, height)],
        [(0, 0, v, height), (v, 0, width, right), (v, right, width, height)],
    ]


def nine_sections(width: int, height: int, v1: int, v2: int, h1: int, h2: int) -> list:
    """3 x 3 rectangles, row by row."""
    xs, ys = [0, v1, v2, width], [0, h1, h2, height]
    return [(xs[c], ys[r], xs[c + 1], ys[r + 1]) for r in range(3) for c in range(3)]


def checkerboard(section: Column, columns: int = 3) -> Column:
    """0 or 1, alternating over the cells of a grid that is numbered row by row."""
    row = F.floor(section / columns)
    return F.pmod(row + F.pmod(section, F.lit(columns)), F.lit(2)).cast("int")


# --- similarity of groups -------------------------------------------------------------------


def pair_overlaps(hist: DataFrame, group: str, key: Sequence[str], count: str = "cnt", salts: int = 16) -> DataFrame:
    """For each pair of groups a < b with a common key: shared (sum of the smaller counts),
    common keys, both totals.

    Up to MATRIX_GROUPS groups, every task adds its keys up in one square matrix, so that no
    row is ever made per key and pair. Of more groups, blocks meet in a join on the key, where the
    blocks of one key are spread over `salts` parts, and pairs are added up in the tasks too. Rows with a null group or key part count nowhere,
    and rows of one group and key are added up first, so both ways give the same rows.
    """
    whole = hist.dropna(subset=[group, *key]).groupBy(group, *key).agg(F.sum(count).alias(count))
    # Written once, as it is read for the groups, the overlaps and the totals.
    hist = written(whole, "histogram")
    rows = small_rows(hist.select(group).distinct(), MATRIX_GROUPS)
    if rows is None:
        shared = _shared_by_blocks(hist, group, key, count, salts)
    else:
        names = sorted(r[0] for r in rows if r[0] is not None)
        shared = _shared_by_matrix(hist, group, key, count, names)
    totals = hist.groupBy(group).agg(F.sum(count).alias("_t"))
    return (
        shared.join(totals.select(F.col(group).alias("a"), F.col("_t").alias("total_a")), "a")
        .join(totals.select(F.col(group).alias("b"), F.col("_t").alias("total_b")), "b")
        .select("a", "b", "shared", "common_keys", "total_a", "total_b")
    )


def _shared_by_matrix(hist: DataFrame, group: str, key: Sequence[str], count: str, names: list) -> DataFrame:
    kind = dict(hist.dtypes)[group]
    # A histogram has one row per key and group, so a key's list is as short as `names`.
    place = (F.array_position(F.lit(names).cast(f"array<{kind}>"), F.col(group)) - 1).cast("int")
    cell = F.struct(place.alias("g"), F.col(count).cast("bigint").alias("c"))
    per_key = hist.where(F.col(group).isNotNull()).groupBy(*key).agg(F.collect_list(cell).alias("cells"))
    width = len(names)

    def add_up(batches):
        shared = np.zeros((width, width), dtype=np.int64)
        common = np.zeros((width, width), dtype=np.int64)
        for batch in batches:
            lists = batch.column(0)
            flat = lists.flatten()
            starts = lists.offsets.to_numpy()
            rows = np.repeat(np.arange(len(lists)), np.diff(starts))
            dense = np.zeros((len(lists), width), dtype=np.int64)
            dense[rows, flat.field("g").to_numpy()] = flat.field("c").to_numpy()
            for g in range(width):
                mine = dense[dense[:, g] > 0]
                shared[g] += np.minimum(mine, mine[:, g : g + 1]).sum(axis=0)
                common[g] += (mine > 0).sum(axis=0)
        a, b = np.nonzero(np.triu(common, 1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(a), pa.array(b), pa.array(shared[a, b]), pa.array(common[a, b])], names=["i", "j", "s", "n"]
        )

    parts = per_key.where(F.size("cells") > 1).select("cells").mapInArrow(add_up, "i bigint, j bigint, s bigint, n bigint")
    sums = parts.groupBy("i", "j").agg(F.sum("s").alias("shared"), F.sum("n").alias("common_keys"))
    label = F.lit(names).cast(f"array<{kind}>")
    return sums.select(
        F.get(label, F.col("i").cast("int")).alias("a"), F.get(label, F.col("j").cast("int")).alias("b"), "shared", "common_keys"
    )


def _shared_by_blocks(hist: DataFrame, group: str, key: Sequence[str], count: str, salts: int) -> DataFrame:
    """Blocks of groups meet per key, as lists of counts; a task adds their pairs up before it hands any on."""
    names = hist.select(group).distinct()
    blocks = -(-names.count() // BLOCK_GROUPS)
    names = names.withColumn("_block", F.pmod(F.xxhash64(group), F.lit(blocks)))
    place = F.row_number().over(W.partitionBy("_block").orderBy(group))
    names = written(names.withColumn("_id", F.shiftleft(F.col("_block"), 32) + place), "groups")
    cells = F.collect_list(F.struct(F.col("_id").alias("g"), F.col(count).cast("bigint").alias("c")))
    # A list is as long as a block has groups, at most.
    lists = hist.join(names, group).groupBy(*key, "_block").agg(cells.alias("_cells"))
    part = F.pmod(F.xxhash64("_block"), F.lit(salts)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    one = lists.select(*key, F.col("_block").alias("_one"), F.col("_cells").alias("left"), every.alias("_salt"))
    two = lists.select(*key, F.col("_block").alias("_two"), F.col("_cells").alias("right"), part.alias("_salt"))
    met = one.join(two, [*key, "_salt"]).where(F.col("_one") <= F.col("_two")).select("left", "right")
    sums = met.mapInArrow(_add_pairs, "i bigint, j bigint, s bigint, n bigint").groupBy("i", "j").agg(F.sum("s").alias("shared"), F.sum("n").alias("common_keys"))
    first = names.select(F.col("_id").alias("i"), F.col(group).alias("_a"))
    second = names.select(F.col("_id").alias("j"), F.col(group).alias("_b"))
    both = sums.join(first, "i").join(second, "j")
    return both.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"), "shared", "common_keys")


def _add_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of two lists of (group, count): the sum of the smaller counts and the number of keys for each pair of
    groups, one row per pair and some PAIRS_TOGETHER of what is added up."""
    for batch in batches:
        sides = []
        for column in batch.columns:
            ends = column.offsets.to_numpy().astype(np.int64)
            flat = column.flatten()
            sides.append((ends[:-1] - ends[0], np.diff(ends), flat.field("g").to_numpy(), flat.field("c").to_numpy()))
        (left_at, left_n, left_g, left_c), (right_at, right_n, right_g, right_c) = sides
        pairs = left_n * right_n
        total = np.cumsum(pairs)
        start = 0
        while start < len(pairs):
            stop = max(start + 1, int(np.searchsorted(total, total[start] - pairs[start] + PAIRS_TOGETHER, "right")))
            n = pairs[start:stop]
            row = np.repeat(np.arange(start, stop), n)
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            i, j = left_at[row] + within // right_n[row], right_at[row] + within % right_n[row]
            start = stop
            once = left_g[i] < right_g[j]
            i, j = i[once], j[once]
            if not len(i):
                continue
            ones, a = np.unique(left_g[i], return_inverse=True)
            twos, b = np.unique(right_g[j], return_inverse=True)
            pair = a * len(twos) + b
            order = np.argsort(pair, kind="stable")
            found, first = np.unique(pair[order], return_index=True)
            smaller = np.minimum(left_c[i], right_c[j])[order]
            columns = [ones[found // len(twos)], twos[found % len(twos)], np.add.reduceat(smaller, first), np.diff(np.append(first, len(order)))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["i", "j", "s", "n"])


def weighted_jaccard(hist: DataFrame, group: str, key: Sequence[str], count: str = "cnt") -> DataFrame:
    """Similarity of each pair of groups with a common key (that of all others is 0)."""
    pairs = pair_overlaps(hist, group, key, count)
    union = F.col("total_a") + F.col("total_b") - F.col("shared")
    return pairs.select("a", "b", F.try_divide(F.col("shared"), union).alias("similarity"))


def cohesion(similarity: DataFrame, assignment: DataFrame, group: str, cluster: str) -> DataFrame:
    """Mean similarity of the pairs inside one cluster; 0 without such a pair.

    A pair that is not in the table has nothing in common and counts as 0.
    """
    a = assignment.select(F.col(group).alias("a"), F.col(cluster).alias("_ca"))
    b = assignment.select(F.col(group).alias("b"), F.col(cluster).alias("_cb"))
    inside = similarity.join(a, "a").join(b, "b").where(F.col("_ca") == F.col("_cb"))
    n = F.col("_n")
    sizes = assignment.groupBy(cluster).agg(F.count("*").alias("_n"))
    pairs = sizes.agg(F.sum(n * (n - 1) / 2)).scalar()
    return inside.agg(F.coalesce(F.try_divide(F.sum("similarity"), pairs), F.lit(0.0)).alias("cohesion"))


def _matrix(similarity: DataFrame, sections: int) -> list[list[float]]:
    """Similarity of numbered sections as a square table; the sections are few."""
    rows = small_rows(similarity, sections * (sections - 1) // 2)
    if rows is None:
        raise ValueError(f"more pairs than {sections} sections have")
    matrix = [[1.0 if i == j else 0.0 for j in range(sections)] for i in range(sections)]
    for r in rows:
        matrix[r["a"]][r["b"]] = matrix[r["b"]][r["a"]] = r["similarity"] or 0.0
    return matrix


def _join_best(matrix, groups: list[list[int]], section: int) -> None:
    """Put a section into the group whose members it resembles most on average."""
    means = [sum(matrix[section][m] for m in g) / len(g) for g in groups]
    groups[max(range(len(groups)), key=lambda g: (means[g], -g))].append(section)


def greedy_groups4(similarity: DataFrame, sections: int = 9, groups: int = 4) -> DataFrame:
    """Sections to groups: the best connected sections start a group each, every other one
    joins, in order, the group with the highest mean similarity so far."""
    matrix = _matrix(similarity, sections)
    seeds = sorted(range(sections), key=lambda i: (-sum(matrix[i]), i))[:groups]
    members = [[s] for s in seeds]
    for section in range(sections):
        if section not in seeds:
            _join_best(matrix, members, section)
    return _assignment(similarity, members)


def anchor_groups3(similarity: DataFrame) -> DataFrame:
    """3 x 3 sections to three groups: the centre starts group 0, the two corners least like
    it group 1, the other two group 2, and each edge joins the group it resembles most."""
    matrix = _matrix(similarity, 9)
    corners = sorted((0, 2, 6, 8), key=lambda i: (matrix[4][i], i))
    members = [[4], corners[:2], corners[2:]]
    for section in (1, 3, 5, 7):
        _join_best(matrix, members, section)
    return _assignment(similarity, members)


def _assignment(similarity: DataFrame, members: list[list[int]]) -> DataFrame:
    rows = [(section, g) for g, group in enumerate(members) for section in group]
    return similarity.sparkSession.createDataFrame(rows, "section int, palette int")


# --- vectors --------------------------------------------------------------------------------


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays of doubles."""
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v))


def class_centroids(points: DataFrame, label: str, vector: str, idx: str = "idx") -> DataFrame:
    """Mean vector of each label: (idx, centre)."""
    cells = points.select(label, F.posexplode(F.col(vector).cast("array<double>")).alias("_pos", "_v"))
    means = cells.groupBy(label, "_pos").agg(F.avg("_v").alias("_m"))
    ordered = F.array_sort(F.collect_list(F.struct("_pos", "_m")))
    return means.groupBy(F.col(label).cast("int").alias(idx)).agg(F.transform(ordered, lambda s: s["_m"]).alias("centre"))


def _palette(palette: DataFrame, idx: str, centre: str) -> Column:
    """The palette, at most 256 entries, as one array literal."""
    rows = small_rows(palette.select(idx, centre), PALETTE_SIZE)
    if rows is None:
        raise ValueError(f"a palette has at most {PALETTE_SIZE} entries")
    entries = [F.struct(F.lit(i).alias("idx"), F.lit(list(c)).alias("centre")) for i, c in sorted(rows)]
    return F.array(*entries)


def _distances(points: DataFrame, vector: str, palette: Column) -> DataFrame:
    def rank(point):
        return F.transform(palette, lambda p: F.struct(distance(point, p["centre"]).alias("d"), p["idx"].alias("idx")))

    return points.withColumn("_ranked", let(F.col(vector).cast("array<double>"), rank))


def nearest(points: DataFrame, vector: str, palette: DataFrame, idx: str = "idx", centre: str = "centre", skip_first: bool = False) -> DataFrame:
    """Closest palette entry and its distance, the smallest index on a tie.

    `skip_first` leaves out entry 0. A palette of fewer than three entries always gives 0.
    """
    ranked = _distances(points, vector, _palette(palette, idx, centre))
    usable = F.filter("_ranked", lambda p: p["idx"] > 0) if skip_first else F.col("_ranked")
    tiny = F.size("_ranked") < 3
    best = F.array_min(usable)
    return ranked.withColumns(
        {"nearest": F.when(tiny, F.lit(0)).otherwise(best["idx"]), "distance": F.when(~tiny, best["d"])}
    ).drop("_ranked")


def two_nearest(points: DataFrame, vector: str, palette: DataFrame, threshold: Column, idx: str = "idx", centre: str = "centre") -> DataFrame:
    """Best and second best entry; where they are close, the threshold decides.

    Close means d1 < d2 < 1.5 * d1; the second is chosen if d1 / (d1 + d2) > threshold.
    """
    ranked = _distances(points, vector, _palette(palette, idx, centre))
    two = F.slice(F.array_sort("_ranked"), 1, 2)
    first, second = F.get(two, F.lit(0)), F.get(two, F.lit(1))
    close = (first["d"] < second["d"]) & (second["d"] < first["d"] * 1.5)
    ratio = first["d"] / (first["d"] + second["d"])
    chosen = F.when(close & (ratio > threshold), second["idx"]).otherwise(first["idx"])
    return ranked.withColumns(
        {"best": first["idx"], "best_distance": first["d"], "second": second["idx"], "second_distance": second["d"], "chosen": chosen}
    ).drop("_ranked")


def usage_within(points: DataFrame, vector: str, palette: DataFrame, radius: float = 10, step: int = 1, x: str | None = None, y: str | None = None, idx: str = "idx", centre: str = "centre") -> DataFrame:
    """Points closer than `radius` to each palette entry, on every `step`-th row and column."""
    if step > 1:
        points = points.where((F.pmod(F.col(x), F.lit(step)) == 0) & (F.pmod(F.col(y), F.lit(step)) == 0))
    ranked = _distances(points, vector, _palette(palette, idx, centre))
    hits = ranked.select(F.explode("_ranked").alias("_p"))
    return hits.groupBy(F.col("_p.idx").alias(idx)).agg(F.count(F.when(F.col("_p.d") < radius, 1)).alias("usage"))


def kmeans(points: DataFrame, vector: str, k: int, seed: int, rounds: int = 10, tolerance: float = 0.5, weight: str | None = None) -> DataFrame:
    """Cluster of each point: spread seeding, at most ten rounds, stop below the tolerance."""
    data = points.withColumn("_features", array_to_vector(F.col(vector).cast("array<double>")))
    model = KMeans(featuresCol="_features", predictionCol="cluster", k=k, seed=seed, maxIter=rounds, tol=tolerance)
    if weight:
        model = model.setWeightCol(weight)
    return model.fit(data).transform(data).drop("_features")


def kmeans_weighted(hist: DataFrame, vector: str, k: int, seed: int, count: str = "cnt") -> DataFrame:
    """As `kmeans`, on distinct values with their counts."""
    return kmeans(hist, vector, k, seed, tolerance=1.0, weight=count)


def lloyd_step(points: DataFrame, vector: str, centroids: DataFrame) -> DataFrame:
    """Centroids (idx, centre, points) after one round; an empty cluster keeps its centroid."""
    assigned = _distances(points, vector, _palette(centroids, "idx", "centre"))
    assigned = assigned.select(F.array_min("_ranked")["idx"].alias("_c"), vector)
    sizes = assigned.groupBy("_c").agg(F.count("*").alias("points"))
    moved = class_centroids(assigned, "_c", vector).withColumnRenamed("centre", "_new")
    out = centroids.join(moved, "idx", "left").join(sizes.withColumnRenamed("_c", "idx"), "idx", "left")
    return out.select("idx", F.coalesce("_new", "centre").alias("centre"), F.coalesce("points", F.lit(0)).alias("points"))


def diverse_topk(hist: DataFrame, group: Sequence[str], key: str, value: str, min_distance: float = 15, keep: int = 10, n: int = 16, count: str = "cnt") -> DataFrame:
    """Per group: the `keep` most frequent entries, then the most frequent ones at least
    `min_distance` from all chosen, then the most frequent rest, up to n in all.

    Each round adds one entry per group by an aggregate; an entry that was too close once
    stays too close, so this is the greedy order without a loop over a group's rows.
    """
    group = list(group)
    rank = W.partitionBy(*group).orderBy("e")
    entry = F.struct((-F.col(count)).alias("order"), F.col(key).alias("key"), F.col(value).alias("value"))
    pool = written(hist.select(*group, entry.alias("e")), "pool")
    first = pool.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= keep)
    chosen = first.groupBy(*group).agg(F.array_sort(F.collect_list("e")).alias("chosen"))
    for _ in range(n - keep):
        far = F.forall("chosen", lambda c: F.abs(c["value"] - F.col("e.value")) >= min_distance)
        extra = pool.join(chosen, group).where(far).groupBy(*group).agg(F.min("e").alias("_e"))
        chosen = written(
            chosen.join(extra, group, "left").select(
                *group,
                F.when(F.col("_e").isNull(), F.col("chosen")).otherwise(F.array_append("chosen", F.col("_e"))).alias("chosen"),
            )
        )
    rest = pool.join(chosen, group).where(~F.array_contains("chosen", F.col("e")))
    fill = rest.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= n)
    picked = chosen.select(*group, F.posexplode("chosen").alias("place", "e"))
    spare = fill.where(F.col("_r") <= n - F.size("chosen")).select(
        *group, (F.size("chosen") + F.col("_r") - 1).alias("place"), "e"
    )
    return picked.unionByName(spare).select(
        *group, "place", F.col("e.key").alias(key), F.col("e.value").alias(value), (-F.col("e.order")).alias(count)
    )
