"""Split search, similarity, clustering and nearest match."""

from pyspark.sql import functions as F

from ..operators import clusters as cl
from ..operators import lookups as lk
from ..operators import profile as pr
from ..operators import similar as sm
from .aggregates import HIST, token_counts
from .registry import cents, days, query, rounded, sql_round

# Class centroids of the embeddings, and all distances to them, in SQL.
CENTRES = """cell AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, unnest(range(0, 64)) AS p FROM embeddings),
     centre AS (SELECT label AS idx, p, avg(v) AS m FROM cell GROUP BY 1, 2),
     dist AS (SELECT vec_id, idx, sqrt(sum((v - m) * (v - m))) AS d FROM cell JOIN centre USING (p) GROUP BY 1, 2),
     ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, idx) AS r FROM dist)"""


def centres(t):
    return sm.class_centroids(t.embeddings, "label", "embedding")


def kmeans_sql(points: str, k: int, rounds: int, tolerance: float, seed: int, farthest: bool) -> str:
    """Seeding and all rounds, one after the other, for points (id, v DOUBLE[], w); ends with fit (idx, c)."""

    def u(turn: int) -> str:
        return f"(('0x' || substr(md5('{seed}:{turn}:' || id::VARCHAR), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE"

    parts = [f"points AS MATERIALIZED ({points})"]
    parts.append(f"seed1 AS MATERIALIZED (SELECT 0 AS idx, v AS c FROM points ORDER BY -ln({u(0)}) / w, id LIMIT 1)")
    for turn in range(1, k):
        key = "-(d * w)" if farthest else f"-ln({u(turn)}) / (d * d * w)"
        parts.append(
            f"seed{turn + 1} AS MATERIALIZED (SELECT * FROM seed{turn} UNION ALL (SELECT {turn}, v FROM"
            f" (SELECT id, v, w, min(list_distance(v, c)) AS d FROM points, seed{turn} GROUP BY ALL) WHERE d > 0 ORDER BY {key}, id LIMIT 1))"
        )
    parts.append(f"round0 AS MATERIALIZED (SELECT idx, c, false AS done FROM seed{k})")
    for turn in range(1, rounds + 1):
        before = f"round{turn - 1}"
        parts += [
            f"own{turn} AS MATERIALIZED (SELECT id, v, w, arg_min(idx, (list_distance(v, c), idx)) AS idx FROM points, {before} GROUP BY ALL)",
            f"cell{turn} AS (SELECT idx, i, sum(x * w) / sum(w) AS m FROM (SELECT idx, w, unnest(v) AS x, unnest(range(0, len(v))) AS i FROM own{turn}) GROUP BY 1, 2)",
            f"mean{turn} AS MATERIALIZED (SELECT idx, list(m ORDER BY i) AS m FROM cell{turn} GROUP BY 1)",
            f"round{turn} AS MATERIALIZED (SELECT idx, CASE WHEN done OR m IS NULL THEN c ELSE m END AS c,"
            f" done OR max(coalesce(list_distance(c, m), 0)) OVER () <= {tolerance} AS done FROM {before} LEFT JOIN mean{turn} USING (idx))",
        ]
    parts.append(f"fit AS MATERIALIZED (SELECT idx, c FROM round{rounds})")
    return "WITH " + ", ".join(parts)


POINTS = "SELECT vec_id AS id, embedding::DOUBLE[] AS v, 1.0::DOUBLE AS w FROM embeddings"
LENGTHS = f"SELECT size::BIGINT AS id, [size::DOUBLE] AS v, sum(cnt)::DOUBLE AS w FROM (WITH {HIST} SELECT length(token) AS size, cnt FROM h) GROUP BY size"


@query(
    "ml01_kmeans",
    kmeans_sql(POINTS, 4, 10, 0.01, 7, False) + " SELECT id AS vec_id, arg_min(idx, (list_distance(v, c), idx))::BIGINT AS cluster FROM points, fit GROUP BY id, v",
)
def kmeans(t):
    return cl.spread_kmeans(t.embeddings, "vec_id", "embedding", 4, seed=7, tolerance=0.01).select("vec_id", "cluster")


@query("ml01_kmeans_centroids", kmeans_sql(POINTS, 9, 10, 0.001, 1, False) + f" SELECT idx::BIGINT AS idx, unnest(range(0, 64)) AS place, {sql_round('unnest(c)')} AS value FROM fit")
def kmeans_centroids(t):
    """More seeds than distances are kept for at once."""
    found = cl.fit(t.embeddings, "vec_id", "embedding", 9, seed=1, rounds=10, tolerance=0.001)
    return cl.centroids(found, t.spark).select("idx", F.posexplode("centre").alias("place", "value")).withColumn("value", rounded("value"))


@query(
    "ml01_lloyd_step",
    f"""WITH {CENTRES}, own AS (SELECT vec_id, idx FROM ranked WHERE r = 1), moved AS (SELECT idx, p, avg(v) AS m, count(*) AS points FROM own JOIN cell USING (vec_id) GROUP BY 1, 2)
        SELECT c.idx::BIGINT AS idx, c.p AS place, {sql_round('coalesce(moved.m, c.m)')} AS value, coalesce(points, 0) AS points
        FROM centre c LEFT JOIN moved ON moved.idx = c.idx AND moved.p = c.p""",
)
def lloyd_step(t):
    step = sm.lloyd_step(t.embeddings, "embedding", centres(t))
    return step.select("idx", "points", F.posexplode("centre").alias("place", "value")).withColumn("value", rounded("value"))


def length_counts(t):
    words = token_counts(t).withColumn("size", F.length("token").cast("bigint"))
    return words.groupBy("size").agg(F.sum("cnt").alias("cnt")).withColumn("v", F.array(F.col("size").cast("double")))


@query(
    "ml02_kmeans_weighted",
    kmeans_sql(LENGTHS, 4, 10, 1.0, 7, True) + " SELECT id AS size, w::BIGINT AS cnt, arg_min(idx, (list_distance(v, c), idx))::BIGINT AS cluster FROM points, fit GROUP BY id, v, w",
)
def kmeans_weighted(t):
    return cl.weighted_kmeans(length_counts(t), "size", "v", 4, seed=7).select("size", "cnt", "cluster")


@query("ml03_nearest", f"""WITH {CENTRES} SELECT vec_id, idx::BIGINT AS nearest, {sql_round('d')} AS distance FROM ranked WHERE r = 1""")
def nearest(t):
    return sm.nearest(t.embeddings, "embedding", centres(t)).select("vec_id", "nearest", rounded("distance").alias("distance"))


@query(
    "ml03_nearest_skip_first",
    f"""WITH {CENTRES} SELECT vec_id, arg_min(idx, (d, idx))::BIGINT AS nearest, {sql_round('min(d)')} AS distance FROM dist WHERE idx > 0 GROUP BY 1""",
)
def nearest_skip_first(t):
    found = sm.nearest(t.embeddings, "embedding", centres(t), skip_first=True)
    return found.select("vec_id", "nearest", rounded("distance").alias("distance"))


@query(
    "ml04_two_nearest",
    f"""WITH {CENTRES}, two AS (SELECT a.vec_id, a.idx AS best, b.idx AS second, a.d AS d1, b.d AS d2 FROM ranked a JOIN ranked b USING (vec_id) WHERE a.r = 1 AND b.r = 2)
        SELECT vec_id, best::BIGINT AS best, second::BIGINT AS second, {sql_round('d1')} AS best_distance, {sql_round('d2')} AS second_distance,
               CASE WHEN d1 < d2 AND d2 < d1 * 1.5 AND d1 / (d1 + d2) > (vec_id % 64) / 64.0::DOUBLE THEN second ELSE best END::BIGINT AS chosen FROM two""",
)
def two_nearest(t):
    found = sm.two_nearest(t.embeddings, "embedding", centres(t), (F.col("vec_id") % 64) / 64)
    return found.select(
        "vec_id", "best", "second", "chosen",
        rounded("best_distance").alias("best_distance"), rounded("second_distance").alias("second_distance"),
    )


JACCARD = f"""{HIST}, total AS (SELECT source, sum(cnt) AS n FROM h GROUP BY 1),
     common AS (SELECT x.source AS a, y.source AS b, sum(least(x.cnt, y.cnt)) AS m FROM h x JOIN h y ON x.token = y.token AND x.source < y.source GROUP BY 1, 2),
     jaccard AS (SELECT a, b, m / (p.n + q.n - m) AS similarity FROM common JOIN total p ON p.source = a JOIN total q ON q.source = b)"""


@query("ml05_weighted_jaccard", f"WITH {JACCARD} SELECT a, b, {sql_round('similarity')} AS similarity FROM jaccard")
def weighted_jaccard(t):
    pairs = sm.weighted_jaccard(token_counts(t), "source", ["token"])
    return pairs.withColumn("similarity", rounded("similarity"))


@query(
    "ml06_cohesion",
    f"WITH {JACCARD} SELECT {sql_round('coalesce(sum(similarity) / (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(DISTINCT source) AS n FROM documents GROUP BY length(source))), 0)')} AS cohesion FROM jaccard WHERE length(a) = length(b)",
)
def cohesion(t):
    pairs = sm.weighted_jaccard(token_counts(t), "source", ["token"])
    clusters = t.documents.select("source", F.length("source").alias("cluster")).distinct()
    return sm.cohesion(pairs, clusters, "source", "cluster").withColumn("cohesion", rounded("cohesion"))


# Split search over orders: days as the position, priority as the key.
SPLIT = """o AS (SELECT date_diff('day', DATE '1995-01-01', o_orderdate::DATE) AS day, o_custkey % 25 AS k FROM orders),
     side AS (SELECT cut, (day >= cut)::INT AS side, k, count(*) AS cnt FROM o, (SELECT unnest(range(700, 1701, 50)) AS cut) GROUP BY 1, 2, 3),
     sized AS (SELECT cut, side, sum(cnt) AS n FROM side GROUP BY 1, 2)"""
ENTROPY = "abs(-sum(cnt / n * log2(cnt / n)))"
CUTS = list(range(700, 1701, 50))


def ordered_days(t):
    return t.orders.select(days("o_orderdate").alias("day"), (F.col("o_custkey") % 25).alias("k"))


def _split_sql(score: str, spread: str = "max(score) - min(score)") -> str:
    return f"""WITH {SPLIT}, score AS (SELECT cut, side, {score} AS score FROM side JOIN sized USING (cut, side) GROUP BY 1, 2),
                    imb AS (SELECT cut, {spread} AS imbalance FROM score GROUP BY 1)"""


@query("ml07_split_scores", _split_sql(ENTROPY) + f" SELECT cut, {sql_round('imbalance')} AS imbalance FROM imb")
def split_scores(t):
    scores = sm.split_scores(ordered_days(t), F.col("day"), ["k"], CUTS, "entropy")
    return scores.withColumn("imbalance", rounded("imbalance"))


def _best_split(measure: str, sql: str) -> None:
    @query(f"ml07_best_split_{measure}", sql + f" SELECT cut, {sql_round('imbalance')} AS imbalance FROM imb ORDER BY imb.imbalance, cut LIMIT 1")
    def best_split(t):
        best = sm.best_split(ordered_days(t), F.col("day"), ["k"], CUTS, measure)
        return best.withColumn("imbalance", rounded("imbalance"))


_best_split("entropy", _split_sql(ENTROPY))
_best_split("count", _split_sql("count(*)::DOUBLE"))
_best_split(
    "importance",
    _split_sql(
        "CASE WHEN count(*) <= 3 THEN sqrt(sum(cnt)::DOUBLE) ELSE sum(sqrt(cnt::DOUBLE)) END", "ln(1 + max(score)) - ln(1 + min(score))"
    ),
)

# Quadrants over lines: quantity 0..51 and price in thousands 0..106 as the axes.
WIDTH, HEIGHT = 51, 106


def cells(t):
    return t.lineitem.select(
        F.col("l_quantity").cast("int").alias("x"),
        F.floor(F.col("l_extendedprice") / 1000).cast("int").alias("y"),
        (cents("l_discount") * 100 + cents("l_tax")).alias("k"),
        (F.col("l_partkey") % 97).alias("p"),
    )


CELLS = """cell AS (SELECT l_quantity::BIGINT AS x, floor(l_extendedprice / 1000)::BIGINT AS y,
                 round(l_discount * 100)::BIGINT * 100 + round(l_tax * 100)::BIGINT AS k, l_partkey % 97 AS p FROM lineitem)"""


@query(
    "ml08_best_quadrants",
    f"""WITH {CELLS}, c AS (SELECT h, v, (x >= v)::INT + 2 * (y >= h)::INT AS part, p, count(*) AS cnt
             FROM cell, (SELECT unnest(range(31, 75, 8)) AS h), (SELECT unnest(range(15, 36, 8)) AS v) GROUP BY ALL),
         s AS (SELECT h, v, part, sum(cnt) AS n FROM c GROUP BY ALL),
         e AS (SELECT h, v, part, {ENTROPY} AS score FROM c JOIN s USING (h, v, part) GROUP BY ALL),
         i AS (SELECT h, v, max(score) - CASE WHEN count(*) < 4 THEN 0 ELSE min(score) END AS imbalance FROM e GROUP BY ALL)
        SELECT h, v, {sql_round('imbalance')} AS imbalance FROM i ORDER BY i.imbalance, h, v LIMIT 1""",
)
def best_quadrants(t):
    x_cuts, y_cuts = sm.split_points(WIDTH), sm.split_points(HEIGHT)
    best = sm.best_quadrants(cells(t), F.col("x"), F.col("y"), ["p"], x_cuts, y_cuts, "entropy")
    return best.withColumn("imbalance", rounded("imbalance"))


LAYOUTS = [
    [(0, 0, 20, 40), (20, 0, 51, 40), (0, 40, 51, 106)],
    [(0, 0, 51, 40), (0, 40, 25, 106), (25, 40, 51, 106)],
    [(0, 0, 25, 50), (0, 50, 25, 106), (25, 0, 51, 106)],
    [(0, 0, 25, 106), (25, 0, 51, 45), (25, 45, 51, 106)],
]
LAYOUT_SQL = ", ".join(f"({i}, {r}, {a}, {b}, {c}, {d})" for i, rects in enumerate(LAYOUTS) for r, (a, b, c, d) in enumerate(rects))


@query(
    "ml09_choose_arrangement",
    f"""WITH {CELLS}, r(layout, region, x0, y0, x1, y1) AS (VALUES {LAYOUT_SQL}),
         c AS (SELECT layout, region, p, count(*) AS cnt FROM cell JOIN r ON x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY ALL),
         s AS (SELECT layout, region, sum(cnt) AS n FROM c GROUP BY ALL),
         e AS (SELECT layout, region, {ENTROPY} AS score FROM c JOIN s USING (layout, region) GROUP BY ALL),
         i AS (SELECT layout, max(score) - CASE WHEN count(*) < 3 THEN 0 ELSE min(score) END AS imbalance FROM e GROUP BY ALL)
        SELECT layout::BIGINT AS layout, {sql_round('imbalance')} AS imbalance FROM i ORDER BY i.imbalance, layout LIMIT 1""",
)
def choose_arrangement(t):
    best = sm.choose_arrangement(cells(t), F.col("x"), F.col("y"), ["p"], LAYOUTS, "entropy")
    return best.withColumn("imbalance", rounded("imbalance"))


def _cut_sql(name: str, position: str, start: str, stop: str, where: str) -> str:
    """CTE with the best cut of a part of the cells between start and stop of an axis."""
    return f"""{name} AS (
        SELECT coalesce((SELECT cut FROM (
          SELECT cut, max(score) - CASE WHEN count(*) < 2 THEN 0 ELSE min(score) END AS imbalance FROM (
            SELECT cut, side, abs(-sum(cnt / n * log2(cnt / n))) AS score FROM (
              SELECT *, sum(cnt) OVER (PARTITION BY cut, side) AS n FROM (
                SELECT cut, ({position} >= cut)::INT AS side, p, count(*) AS cnt
                FROM (SELECT * FROM cell WHERE {where}), (SELECT unnest(range(floor({start} + ({stop} - {start}) * 0.3)::BIGINT,
                     floor({start} + ({stop} - {start}) * 0.7)::BIGINT + 1, 8)) AS cut) GROUP BY ALL))
            GROUP BY ALL) GROUP BY ALL) ORDER BY imbalance, cut LIMIT 1), {start} + ({stop} - {start}) // 2) AS cut)"""


def _three_way_sql() -> str:
    h, v = "(SELECT cut FROM h)", "(SELECT cut FROM v)"
    top, bottom, left, right = (f"(SELECT cut FROM {n})" for n in ("top", "bottom", "lefty", "righty"))
    inside = f"x < {WIDTH} AND y < {HEIGHT}"
    cuts = [
        _cut_sql("h", "y", "0", str(HEIGHT), inside),
        _cut_sql("v", "x", "0", str(WIDTH), inside),
        _cut_sql("top", "x", "0", str(WIDTH), f"{inside} AND y < {h}"),
        _cut_sql("bottom", "x", "0", str(WIDTH), f"{inside} AND y >= {h}"),
        _cut_sql("lefty", "y", "0", str(HEIGHT), f"{inside} AND x < {v}"),
        _cut_sql("righty", "y", "0", str(HEIGHT), f"{inside} AND x >= {v}"),
    ]
    regions = [
        f"CASE WHEN y >= {h} THEN 2 WHEN x >= {top} THEN 1 ELSE 0 END",
        f"CASE WHEN y < {h} THEN 0 WHEN x >= {bottom} THEN 2 ELSE 1 END",
        f"CASE WHEN x >= {v} THEN 2 WHEN y >= {left} THEN 1 ELSE 0 END",
        f"CASE WHEN x < {v} THEN 0 WHEN y >= {right} THEN 2 ELSE 1 END",
    ]
    placed = " UNION ALL ".join(f"SELECT {i} AS layout, {r} AS region, p FROM cell WHERE {inside}" for i, r in enumerate(regions))
    return f"""WITH {CELLS}, {', '.join(cuts)}, c AS (SELECT layout, region, p, count(*) AS cnt FROM ({placed}) GROUP BY ALL),
        s AS (SELECT layout, region, sum(cnt) AS n FROM c GROUP BY ALL),
        e AS (SELECT layout, region, {ENTROPY} AS score FROM c JOIN s USING (layout, region) GROUP BY ALL)
        SELECT layout::BIGINT AS layout, {sql_round('max(score) - CASE WHEN count(*) < 3 THEN 0 ELSE min(score) END')} AS imbalance FROM e GROUP BY layout"""


@query("ml09_three_way", _three_way_sql())
def three_way(t):
    x, y = F.col("x"), F.col("y")
    layouts = sm.three_way_layouts(cells(t), x, y, ["p"], WIDTH, HEIGHT, "entropy")
    scores = sm.arrangement_scores(cells(t), x, y, ["p"], layouts, "entropy")
    return scores.withColumn("imbalance", rounded("imbalance"))


NINE = sm.nine_sections(WIDTH, HEIGHT, 15, 35, 30, 60)


def section_hist(t):
    section = lk.assign_region(F.col("x"), F.col("y"), NINE, None).alias("section")
    return pr.histogram(cells(t).select(section, "k").where(F.col("section").isNotNull()), ["section"], ["k"])


# Similarity of the nine sections as a full matrix, in SQL.
MATRIX = f"""{CELLS}, placed AS (SELECT CASE WHEN y < 30 THEN 0 WHEN y < 60 THEN 3 ELSE 6 END + CASE WHEN x < 15 THEN 0 WHEN x < 35 THEN 1 ELSE 2 END AS s, k
               FROM cell WHERE x < {WIDTH} AND y < {HEIGHT}),
     h AS (SELECT s, k, count(*) AS cnt FROM placed GROUP BY ALL), total AS (SELECT s, sum(cnt) AS n FROM h GROUP BY ALL),
     common AS (SELECT i.s AS a, j.s AS b, sum(least(i.cnt, j.cnt)) AS m FROM h i JOIN h j ON i.k = j.k GROUP BY ALL),
     sim AS MATERIALIZED (SELECT a, b, m / (p.n + q.n - m) AS v FROM common JOIN total p ON p.s = a JOIN total q ON q.s = b)"""


def _join_sql(step: int, section: str) -> str:
    """CTE with one more section, put into the group it resembles most on average."""
    return f"""g{step + 1} AS MATERIALIZED (SELECT * FROM g{step} UNION ALL SELECT * FROM (
        SELECT a AS section, palette FROM sim JOIN g{step} ON g{step}.section = b WHERE a = {section}
        GROUP BY ALL ORDER BY avg(v) DESC, palette LIMIT 1))"""


def _greedy_sql() -> str:
    seeds = """r AS (SELECT a AS section, row_number() OVER (ORDER BY sum(v) DESC, a) - 1 AS palette FROM sim GROUP BY a),
               g0 AS (SELECT section, palette FROM r WHERE palette < 4)"""
    steps = [_join_sql(i, f"(SELECT section FROM r WHERE palette >= 4 ORDER BY section LIMIT 1 OFFSET {i})") for i in range(5)]
    return f"WITH {MATRIX}, {seeds}, {', '.join(steps)} SELECT section::BIGINT AS section, palette::BIGINT AS palette FROM g5"


def _anchor_sql() -> str:
    seeds = """g0 AS (SELECT 4 AS section, 0::BIGINT AS palette UNION ALL
                      SELECT b, (row_number() OVER (ORDER BY v, b) + 1) // 2 FROM sim WHERE a = 4 AND b IN (0, 2, 6, 8))"""
    steps = [_join_sql(i, str(s)) for i, s in enumerate((1, 3, 5, 7))]
    return f"WITH {MATRIX}, {seeds}, {', '.join(steps)} SELECT section::BIGINT AS section, palette::BIGINT AS palette FROM g4"


@query("ml10_greedy_groups4", _greedy_sql())
def greedy_groups4(t):
    return sm.greedy_groups4(sm.weighted_jaccard(section_hist(t), "section", ["k"]))


@query("ml11_anchor_groups3", _anchor_sql())
def anchor_groups3(t):
    return sm.anchor_groups3(sm.weighted_jaccard(section_hist(t), "section", ["k"]))


@query(
    "ml12_checkerboard",
    f"""WITH {CELLS}, s AS (SELECT CASE WHEN y < 30 THEN 0 WHEN y < 60 THEN 1 ELSE 2 END AS r, CASE WHEN x < 15 THEN 0 WHEN x < 35 THEN 1 ELSE 2 END AS c FROM cell)
        SELECT (r * 3 + c)::BIGINT AS section, ((r + c) % 2)::BIGINT AS palette, count(*) AS cells FROM s GROUP BY 1, 2""",
)
def checkerboard(t):
    rows = section_hist(t).groupBy("section").agg(F.sum("cnt").alias("cells"))
    return rows.withColumn("palette", sm.checkerboard(F.col("section")))


def _nine_sql(axis: str, position: str, first: int, last: int) -> str:
    return f"""SELECT '{axis}' AS axis, cut FROM (
        SELECT cut, abs(max(score) - min(score)) AS imbalance FROM (
          SELECT cut, side, abs(-sum(cnt / n * log2(cnt / n))) AS score FROM (
            SELECT *, sum(cnt) OVER (PARTITION BY cut, side) AS n FROM (
              SELECT cut, ({position} >= cut)::INT AS side, p, count(*) AS cnt FROM cell, (SELECT unnest(range({first}, {last} + 1)) AS cut) GROUP BY ALL))
          GROUP BY ALL) GROUP BY ALL) ORDER BY imbalance, cut LIMIT 1"""


@query(
    "ml13_nine_sections",
    f"""WITH {CELLS} (""" + ") UNION ALL (".join(
        [_nine_sql("v1", "x", 10, 20), _nine_sql("v2", "x", 30, 40), _nine_sql("h1", "y", 21, 42), _nine_sql("h2", "y", 63, 84)]
    ) + ")",
)
def nine_sections(t):
    axes = (("v1", "x", WIDTH, 0.2, 0.4), ("v2", "x", WIDTH, 0.6, 0.8), ("h1", "y", HEIGHT, 0.2, 0.4), ("h2", "y", HEIGHT, 0.6, 0.8))
    searches = [(name, which, sm.split_points(length, low, high, step=None)) for name, which, length, low, high in axes]
    return sm.best_splits(cells(t), F.col("x"), F.col("y"), ["p"], searches, "entropy").select("axis", "cut")


def _diverse_sql() -> str:
    """Ten most frequent parts per brand, six rounds of the first far one, then the rest."""
    steps = [
        f"""c{i + 1} AS MATERIALIZED (SELECT * FROM c{i} UNION ALL SELECT p_brand, p_partkey, p_retailprice, cnt, o, {11 + i} AS place FROM (
             SELECT * FROM pool WHERE NOT EXISTS (SELECT 1 FROM c{i} x WHERE x.p_brand = pool.p_brand AND abs(x.p_retailprice - pool.p_retailprice) < 15)
             QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY o) = 1))"""
        for i in range(6)
    ]
    return f"""WITH pool AS MATERIALIZED (SELECT p_brand, p_partkey, p_retailprice, count(*) AS cnt, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_partkey) AS o
             FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3),
           c0 AS (SELECT *, o AS place FROM pool WHERE o <= 10), {', '.join(steps)},
           every AS (SELECT p_brand, p_partkey, p_retailprice, cnt, place, o FROM c6 UNION ALL SELECT p_brand, p_partkey, p_retailprice, cnt, 99, o FROM pool
                     WHERE NOT EXISTS (SELECT 1 FROM c6 x WHERE x.p_brand = pool.p_brand AND x.p_partkey = pool.p_partkey)),
           ranked AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY place, o) - 1 AS slot FROM every)
        SELECT p_brand, slot AS place, p_partkey, p_retailprice, cnt FROM ranked WHERE slot < 16"""


@query("ml14_diverse_topk", _diverse_sql())
def diverse_topk(t):
    lines = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    hist = lines.groupBy("p_brand", "p_partkey", "p_retailprice").agg(F.count("*").alias("cnt"))
    return sm.diverse_topk(hist, ["p_brand"], "p_partkey", "p_retailprice", min_distance=15)


@query(
    "ml15_usage_within",
    f"WITH {CENTRES} SELECT idx::BIGINT AS idx, count(*) FILTER (d < 0.9) AS usage FROM dist GROUP BY 1",
)
def usage_within(t):
    return sm.usage_within(t.embeddings, "embedding", centres(t), radius=0.9)
