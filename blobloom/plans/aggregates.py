"""Histograms, profiles, imbalance and top-k."""

from pyspark.sql import functions as F

from ..functions.colour import luminance
from ..functions.signal import compand
from ..operators import profile as pr
from .joins import TOKENS, tokens
from .registry import cents, query, rounded, sql_round
from .sources import document_blobs

HIST = f"""{TOKENS}, h AS (SELECT source, token, count(*) AS cnt FROM tokens WHERE token <> '' GROUP BY 1, 2)"""
BYTES = """x AS (SELECT doc_id, encode(text) AS b FROM documents),
           y AS (SELECT doc_id, b, unnest(range(1, octet_length(b) + 1)) AS i FROM x),
           z AS (SELECT doc_id, ('0x' || hex(b[i:i]))::INT AS byte, count(*) AS cnt FROM y GROUP BY 1, 2)"""


def token_counts(t, group: str = "source"):
    return pr.histogram(tokens(t), [group], ["token"])


@query("ag01_histogram", f"WITH {HIST} SELECT * FROM h")
def histogram(t):
    return token_counts(t)


@query(
    "ag02_byte_profile",
    f"""WITH {BYTES}, s AS (SELECT doc_id, sum(cnt)::BIGINT AS length, count(*) AS distinct_values, min(byte)::BIGINT AS min_value,
                 max(byte)::BIGINT AS max_value, sum(cnt * byte)::BIGINT AS s, sum(cnt * byte * byte)::BIGINT AS q FROM z GROUP BY 1)
        SELECT doc_id, length, distinct_values, min_value, max_value, {sql_round('s / length')} AS mean,
               {sql_round('sqrt((length::HUGEINT * q - s::HUGEINT * s)::DOUBLE) / length')} AS std_dev FROM s""",
)
def byte_profile(t):
    out = pr.byte_profile(document_blobs(t), ["doc_id"], "content")
    return out.withColumns({"mean": rounded("mean"), "std_dev": rounded("std_dev")})


@query(
    "ag02_top_bytes",
    f"""WITH {BYTES}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cnt DESC, byte) AS rank,
                               sum(cnt) OVER (PARTITION BY doc_id) AS total FROM z)
        SELECT doc_id, byte::BIGINT AS byte, cnt, round(cnt / total * 100, 1) AS percent, rank FROM r WHERE rank <= 10""",
)
def top_bytes(t):
    return pr.top_bytes(document_blobs(t), ["doc_id"], "content")


def _repeats_sql() -> str:
    parts = " UNION ALL ".join(
        f"SELECT hex(b[i + 1:i + {n}]) AS pattern FROM o WHERE i + {2 * n} <= octet_length(b)"
        f" AND b[i + 1:i + {n}] = b[i + {n + 1}:i + {2 * n}]"
        for n in range(2, 9)
    )
    return f"""WITH d AS (SELECT encode(text) AS b FROM documents),
                    o AS (SELECT b, unnest(range(0, octet_length(b) - 3)) AS i FROM d)
               SELECT pattern, count(*) AS repeats FROM ({parts}) GROUP BY pattern"""


@query("ag03_adjacent_repeats", _repeats_sql())
def adjacent_repeats(t):
    return pr.adjacent_repeats(document_blobs(t), "content")


BANDS = {"low": (0, 50), "middle": (50, 150), "high": (150, 1000)}


@query(
    "ag04_range_counts",
    f"""SELECT user_id, count(value) AS total, min(value) AS min_value, max(value) AS max_value, {sql_round('avg(value)')} AS mean,
           count(*) FILTER (value >= 0 AND value < 50) AS low_count, count(*) FILTER (value >= 50 AND value < 150) AS middle_count,
           count(*) FILTER (value >= 150 AND value < 1000) AS high_count,
           {sql_round('count(*) FILTER (value >= 0 AND value < 50) / count(value) * 100')} AS low_percent,
           {sql_round('count(*) FILTER (value >= 50 AND value < 150) / count(value) * 100')} AS middle_percent,
           {sql_round('count(*) FILTER (value >= 150 AND value < 1000) / count(value) * 100')} AS high_percent
        FROM events GROUP BY 1""",
)
def range_counts(t):
    out = pr.range_counts(t.events, ["user_id"], "value", BANDS)
    return out.withColumns({c: rounded(c) for c in ("mean", "low_percent", "middle_percent", "high_percent")})


@query(
    "ag05_primary_key_of",
    """WITH c AS (SELECT l_partkey, l_linenumber, count(*) AS uses FROM lineitem GROUP BY 1, 2)
       SELECT l_partkey, l_linenumber::BIGINT AS "primary", uses FROM c
       QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY uses DESC, l_linenumber) = 1""",
)
def primary_key_of(t):
    return pr.primary_key_of(t.lineitem, ["l_partkey"], "l_linenumber")


@query(
    "ag06_bounding_box",
    """WITH s AS (SELECT l_orderkey, l_quantity::BIGINT AS x, l_linenumber::BIGINT AS y, round(l_tax * 100)::BIGINT AS w,
                         round(l_discount * 100)::BIGINT AS h FROM lineitem),
            b AS (SELECT o_orderkey, coalesce(min(x), 0) AS min_x, coalesce(max(x + w * 8), 0) AS max_x,
                         coalesce(min(y), 0) AS min_y, coalesce(max(y + h * 8), 0) AS max_y
                  FROM orders LEFT JOIN s ON l_orderkey = o_orderkey GROUP BY 1)
       SELECT *, max_x - min_x AS width, max_y - min_y AS height FROM b""",
)
def bounding_box(t):
    lines = t.orders.select("o_orderkey").join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    width, height = (F.round(F.col(c) * 100).cast("bigint") for c in ("l_tax", "l_discount"))
    return pr.bounding_box(lines, ["o_orderkey"], F.col("l_quantity").cast("bigint"), F.col("l_linenumber"), width, height)


@query(
    "ag06_moved_to_origin",
    """WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity::BIGINT AS x, l_linenumber::BIGINT + l_suppkey % 50 AS y FROM lineitem)
       SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, x - min(x) OVER w AS x, y - min(y) OVER w AS y FROM s WINDOW w AS (PARTITION BY l_orderkey)""",
)
def moved_to_origin(t):
    x, y = F.col("l_quantity").cast("bigint").alias("x"), (F.col("l_linenumber") + F.col("l_suppkey") % 50).alias("y")
    lines = t.lineitem.select("l_orderkey", "l_linenumber", x, y)
    box = pr.bounding_box(lines, ["l_orderkey"], F.col("x"), F.col("y"), F.lit(1), F.lit(1))
    return pr.moved_to_origin(lines, ["l_orderkey"], "x", "y", box)


@query(
    "ag07_extents",
    """WITH e AS (SELECT 'o_orderkey' AS "column", min(o_orderkey) AS low, max(o_orderkey) AS high FROM orders
                  UNION ALL SELECT 'o_custkey', min(o_custkey), max(o_custkey) FROM orders
                  UNION ALL SELECT 'cents', min(round(o_totalprice * 100)::BIGINT), max(round(o_totalprice * 100)::BIGINT) FROM orders)
       SELECT *, high - low AS range, printf('%X', low) AS low_hex, printf('%X', high) AS high_hex FROM e""",
)
def extents(t):
    return pr.extents(t.orders.withColumn("cents", cents("o_totalprice")), ["o_orderkey", "o_custkey", "cents"])


@query(
    "ag08_usage_stats",
    """WITH l AS (SELECT p_type, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey),
            h AS (SELECT p_type, p_brand, count(*) AS cnt FROM l GROUP BY 1, 2),
            r AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY cnt DESC, p_brand) AS rank FROM h),
            g AS (SELECT p_type, floor(count(*) * 100 / (SELECT count(*) FROM l) + 0.5)::BIGINT AS percent FROM l GROUP BY 1)
       SELECT p_type, p_brand, cnt, rank, percent FROM r JOIN g USING (p_type) WHERE rank <= 5""",
)
def usage_stats(t):
    lines = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return pr.usage_stats(lines, ["p_type"], ["p_brand"])


@query(
    "ag09_merge_histograms",
    f"""WITH {HIST}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY cnt DESC, token) AS rank FROM h)
        SELECT token, sum(cnt)::BIGINT AS cnt FROM r WHERE rank <= 64 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 16""",
)
def merge_histograms(t):
    return pr.merge_histograms(token_counts(t), ["source"], ["token"])


@query(
    "ag10_shared_keys",
    f"""WITH {TOKENS} SELECT token, count(DISTINCT lang) AS groups, count(*) AS total FROM tokens WHERE token <> ''
        GROUP BY 1 HAVING count(DISTINCT lang) > 1""",
)
def shared_keys(t):
    return pr.shared_keys(token_counts(t, "lang"), "lang", ["token"])


@query(
    "ag11_imbalance_count",
    f"WITH {HIST}, s AS (SELECT source, count(*)::DOUBLE AS score FROM h GROUP BY 1) SELECT max(score) - min(score) AS imbalance FROM s",
)
def imbalance_count(t):
    return pr.imbalance(token_counts(t), ["source"], "count")


EVENT_HIST = """h AS (SELECT user_id, event_type, count(*) AS cnt FROM events GROUP BY 1, 2),
                n AS (SELECT user_id, sum(cnt) AS n FROM h GROUP BY 1),
                s AS (SELECT user_id, abs(-sum(cnt / n * log2(cnt / n))) AS score FROM h JOIN n USING (user_id) GROUP BY 1)"""


@query("ag12_entropy", f"WITH {EVENT_HIST} SELECT user_id, {sql_round('score')} AS score FROM s")
def entropy(t):
    hist = pr.histogram(t.events, ["user_id"], ["event_type"])
    return pr.entropy(hist, ["user_id"]).withColumn("score", rounded(F.abs("score")))


@query("ag12_imbalance_entropy", f"WITH {EVENT_HIST} SELECT {sql_round('max(score) - min(score)')} AS imbalance FROM s")
def imbalance_entropy(t):
    hist = pr.histogram(t.events, ["user_id"], ["event_type"])
    return pr.imbalance(hist, ["user_id"], "entropy").withColumn("imbalance", rounded("imbalance"))


@query(
    "ag13_imbalance_importance",
    f"""WITH {HIST}, s AS (SELECT source, CASE WHEN count(*) <= 3 THEN sqrt(sum(cnt)::DOUBLE) ELSE sum(sqrt(cnt::DOUBLE)) END AS score FROM h GROUP BY 1)
        SELECT {sql_round('ln(1 + max(score)) - ln(1 + min(score) FILTER (score > 0))')} AS imbalance FROM s""",
)
def imbalance_importance(t):
    return pr.imbalance(token_counts(t), ["source"], "importance").withColumn("imbalance", rounded("imbalance"))


@query(
    "ag14_imbalance_area",
    """WITH r AS (SELECT c_nationkey, min(c_custkey) AS x0, max(c_custkey) AS x1, min(floor(c_acctbal))::BIGINT AS y0,
                         max(floor(c_acctbal))::BIGINT AS y1 FROM customer GROUP BY 1),
            a AS (SELECT (x1 - x0) * (y1 - y0) AS area FROM r) SELECT max(area) - min(area) AS imbalance FROM a""",
)
def imbalance_area(t):
    balance = F.floor("c_acctbal").cast("bigint")
    boxes = t.customer.groupBy("c_nationkey").agg(
        F.min("c_custkey").alias("x0"), F.max("c_custkey").alias("x1"), F.min(balance).alias("y0"), F.max(balance).alias("y1")
    )
    return pr.imbalance_area(boxes)


@query(
    "ag15_invert_index",
    """SELECT l_partkey, array_to_string(list_sort(list(DISTINCT l_linenumber)), ' ') AS indices FROM lineitem
       WHERE l_linenumber BETWEEN 2 AND 6 GROUP BY 1""",
)
def invert_index(t):
    out = pr.invert_index(t.lineitem, ["l_partkey"], "l_linenumber", 2, 6, groups=None)
    return out.select("l_partkey", F.array_join("indices", " ").alias("indices"))


@query(
    "ag15_invert_index_first",
    """WITH g AS (SELECT l_partkey, list_sort(list(DISTINCT l_suppkey)) AS i FROM lineitem WHERE l_suppkey BETWEEN 0 AND 127 GROUP BY 1)
       SELECT l_partkey, array_to_string(i, ' ') AS indices FROM g ORDER BY i[1], l_partkey LIMIT 64""",
)
def invert_index_first(t):
    out = pr.invert_index(t.lineitem, ["l_partkey"], "l_suppkey", 0, 127)
    return out.select("l_partkey", F.array_join("indices", " ").alias("indices"))


@query(
    "ag16_density",
    f"""WITH {HIST}, k AS (SELECT source, count(*) AS keys FROM h GROUP BY 1),
             s AS (SELECT source, sum(n_chars)::BIGINT AS size FROM documents GROUP BY 1)
        SELECT source, keys, size, {sql_round('keys / size', 9)} AS density FROM k JOIN s USING (source)""",
)
def density(t):
    sizes = t.documents.groupBy("source").agg(F.sum("n_chars").alias("size"))
    out = pr.density(token_counts(t), ["source"], sizes, "size")
    return out.withColumn("density", rounded("density", 9))


@query("ag17_distinct_keys", "SELECT DISTINCT unnest(json_keys(props)) AS key FROM events")
def distinct_keys(t):
    maps = t.events.select(F.from_json("props", "map<string,string>").alias("m"))
    return pr.distinct_keys(maps, "m")


@query(
    "ag18_run_summary",
    f"""SELECT lang, count(*) AS items, count(DISTINCT source) AS folders, sum(octet_length(encode(text)))::BIGINT AS total,
               {sql_round('sum(octet_length(encode(text))) / count(*)')} AS per_item FROM documents GROUP BY 1""",
)
def run_summary(t):
    size = F.octet_length(F.encode("text", "UTF-8"))
    return pr.run_summary(t.documents, ["lang"], "source", size).withColumn("per_item", rounded("per_item"))


@query(
    "ag19_transform_extremes",
    f"""WITH {BYTES} SELECT doc_id, min((byte - 128) * abs(byte - 127))::BIGINT AS low,
               max((byte - 128) * abs(byte - 127))::BIGINT AS high FROM z GROUP BY 1""",
)
def transform_extremes(t):
    return pr.transform_extremes(pr.bytes_of(document_blobs(t), ["doc_id"], "content"), ["doc_id"], compand("byte"))


@query(
    "tk01_top_k",
    """WITH h AS (SELECT p_brand, p_partkey, count(*) AS cnt FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)
       SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY cnt DESC, p_partkey) AS rank FROM h QUALIFY rank <= 5""",
)
def top_k(t):
    lines = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return pr.top_k(pr.histogram(lines, ["p_brand"], ["p_partkey"]), ["p_brand"], ["p_partkey"], 5)


@query("tk02_cap_results", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def cap_results(t):
    return pr.first_rows(t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 50)


LUMINANCE = "0.299::DOUBLE * (p_partkey % 256) + 0.587::DOUBLE * p_size + 0.114::DOUBLE * floor(p_retailprice)"


@query(
    "tk03_sort_by_luminance",
    f"""SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_partkey = 0 THEN -1 ELSE {LUMINANCE} END, p_partkey) - 1 AS place
        FROM part""",
)
def sort_by_luminance(t):
    lum = luminance(F.col("p_partkey") % 256, "p_size", F.floor("p_retailprice"))
    return pr.sort_by_luminance(t.part, ["p_brand"], "p_partkey", lum).select("p_brand", "p_partkey", "place")


@query(
    "tk04_unique_sorted_limited",
    "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber::BIGINT AS l_linenumber FROM lineitem",
)
def unique_sorted_limited(t):
    return pr.unique_sorted_limited(t.lineitem, ["l_returnflag", "l_linestatus", "l_linenumber"])


@query("tk05_head_tail", 'SELECT page_id, left(html, 16) AS head, right(html, 16) AS tail FROM pages')
def head_tail(t):
    from ..operators.search import head_tail as ends

    head, tail = ends(F.col("html"), 16)
    return t.pages.select("page_id", head.alias("head"), tail.alias("tail"))
