"""Set operations and data quality."""

from pyspark.sql import functions as F

from ..functions import colour as co
from ..operators import quality as qu
from .registry import cents, days, micros, query
from .scalars import rgb, shade_sql


@query(
    "st01_fill_unmapped",
    """WITH d AS (SELECT date_diff('day', DATE '1995-01-01', o_orderdate::DATE) AS day, count(*) AS orders FROM orders GROUP BY 1),
            u AS (SELECT unnest(range(min(day), max(day) + 1)) AS day FROM d)
       SELECT u.day, coalesce(orders, -1) AS orders FROM u LEFT JOIN d USING (day)""",
)
def fill_unmapped(t):
    mapped = t.orders.groupBy(days("o_orderdate").cast("bigint").alias("day")).agg(F.count("*").alias("orders"))
    ends = t.orders.select(days("o_orderdate").cast("bigint").alias("d")).agg(F.sequence(F.min("d"), F.max("d")).alias("s"))
    universe = ends.select(F.explode("s").alias("day"))
    return qu.fill_unmapped(universe, mapped, "day", {"orders": F.lit(-1).cast("bigint")})


LEVEL_SQL = "(0, 36, 72, 108, 144, 180, 216, 252)"


@query(
    "st02_member_of",
    f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber * 36 IN {LEVEL_SQL} AND l_quantity::BIGINT * 9 IN {LEVEL_SQL}
               AND round(l_discount * 100)::BIGINT * 36 IN {LEVEL_SQL} AS valid FROM lineitem""",
)
def member_of(t):
    channels = [F.col("l_linenumber") * 36, F.col("l_quantity").cast("bigint") * 9, cents("l_discount") * 36]
    return t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", qu.member_of(channels, co.LEVELS).alias("valid"))


@query(
    "st03_concat_tracks",
    """SELECT epoch_us(o_orderdate) AS at, o_orderkey AS id, o_custkey AS who, 0::BIGINT AS track FROM orders
       UNION ALL SELECT epoch_us(ts), event_id, user_id, 1::BIGINT FROM events""",
)
def concat_tracks(t):
    orders = t.orders.select(micros("o_orderdate").alias("at"), F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("who"))
    events = t.events.select(micros("ts").alias("at"), F.col("event_id").alias("id"), F.col("user_id").alias("who"))
    return qu.concat_tracks(orders, events)


@query(
    "dq01_validate_domain",
    """SELECT l_orderkey, l_partkey, l_suppkey, d AS pct, CASE WHEN d <= 1 THEN 0 WHEN d <= 4 THEN 3 WHEN d <= 7 THEN 6 ELSE 9 END::BIGINT AS suggested
       FROM (SELECT *, round(l_discount * 100)::BIGINT AS d FROM lineitem) WHERE d NOT IN (0, 3, 6, 9)""",
)
def validate_domain(t):
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", cents("l_discount").alias("pct"))
    return qu.validate_domain(rows, "pct", [0, 3, 6, 9])


@query(
    "dq02_adjustment_report",
    f"""WITH {shade_sql(36)}, n AS (SELECT l_returnflag, unnest(notes) AS note FROM shaded)
        SELECT l_returnflag, note, count(*) AS rows FROM n GROUP BY 1, 2""",
)
def adjustment_report(t):
    rows = rgb(t, "l_returnflag").select("l_returnflag", co.shade("r", "g", "b", "light")["adjustments"].alias("notes"))
    return qu.adjustment_report(rows, ["l_returnflag"], "notes")


@query(
    "dq03_expect",
    """WITH s AS (SELECT o_orderkey, count(l_linenumber) AS lines, max(l_quantity) AS most FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
       SELECT o_orderkey, lines, CASE WHEN lines < 1 THEN 'no lines' WHEN lines > 7 THEN 'too many lines' WHEN most > 49 THEN 'too large' END AS broken FROM s""",
)
def expect(t):
    lines = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    sums = lines.groupBy("o_orderkey").agg(F.count("l_linenumber").alias("lines"), F.max("l_quantity").alias("most"))
    rules = {"no lines": F.col("lines") >= 1, "too many lines": F.col("lines") <= 7, "too large": F.col("most") <= 49}
    return qu.expect(sums, rules).select("o_orderkey", "lines", "broken")


@query(
    "dq04_layout_checks",
    """WITH e AS (SELECT user_id, epoch_us(ts) AS start, epoch_us(ts) + 1800000000 AS stop FROM events),
            l AS (SELECT *, lag(stop) OVER (PARTITION BY user_id ORDER BY start, stop) AS until FROM e)
       SELECT user_id, start, stop, until - start AS overlap FROM l WHERE start < until""",
)
def layout_checks(t):
    start = micros("ts")
    rows = t.events.select("user_id", start.alias("start"), (start + 1_800_000_000).alias("stop"))
    return qu.layout_checks(rows, ["user_id"], "start", "stop")


@query(
    "dq04_minimum_offset",
    """SELECT doc_id, n_chars, (octet_length(encode(text)) - n_chars) * 32 + 10 AS safe_offset FROM documents
       WHERE n_chars < (octet_length(encode(text)) - n_chars) * 32 + 10""",
)
def minimum_offset(t):
    extra = F.octet_length(F.encode("text", "UTF-8")) - F.col("n_chars")
    rows = t.documents.select("doc_id", "n_chars", extra.alias("records"))
    return qu.minimum_offset(rows, "n_chars", "records").drop("records")


@query(
    "dq05_size_contract",
    """SELECT doc_id, n_chars AS expected, octet_length(encode(text)) AS actual FROM documents WHERE n_chars <> octet_length(encode(text))""",
)
def size_contract(t):
    size = F.octet_length(F.encode("text", "UTF-8"))
    return qu.size_contract(t.documents.select("doc_id", "n_chars", "text"), F.col("n_chars"), size).select(
        "doc_id", "expected", "actual"
    )


@query(
    "dq06_expected_count",
    "SELECT doc_id FROM range(0, (SELECT count(*) FROM documents)) r(doc_id) WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def expected_count(t):
    return qu.expected_count(t.spark, t.documents.count(), t.labels, "doc_id")
