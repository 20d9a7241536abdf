"""Windows, sequences and streams."""

from pyspark.sql import functions as F

from ..operators import inplace
from ..operators import sequence as sq
from ..operators.ordered import Step, scan
from ..streaming import streams as st
from .registry import ORACLES, cents, micros, query
from .sources import document_blobs

USER = ["user_id"]
ORDER = ["event_id"]


@query(
    "wn01_record_spans",
    """SELECT user_id, event_id, lead(event_id) OVER w AS next, (lead(event_id) OVER w - event_id) // 8 AS count
       FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)
       QUALIFY lead(event_id) OVER w IS NOT NULL""",
)
def record_spans(t):
    return sq.record_spans(t.events.select("user_id", "event_id"), USER, "event_id", 8)


def timed(t):
    return t.events.select("user_id", "event_id", "event_type", micros("ts").alias("t"))


GROUPED = """e AS (SELECT user_id, event_id, epoch_us(ts) AS t FROM events),
     g AS (SELECT *, CASE WHEN lag(t) OVER w IS NULL OR t - lag(t) OVER w >= 14400000000 THEN 1 ELSE 0 END AS opens
           FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
     n AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY t, event_id)::BIGINT AS "group" FROM g)"""


@query(
    "wn02_gap_groups",
    f"""WITH {GROUPED} SELECT user_id, "group", min(t) AS start, max(t) + 60000000 AS "end", count(*) AS members,
          least(max(t) + 60000000, min(t) + 14400000000) AS preview_end FROM n GROUP BY 1, 2""",
)
def gap_groups(t):
    return sq.gap_groups(timed(t), USER, "t", 4 * 3600 * 1_000_000, 60_000_000, tie=["event_id"])


SEPARATED = """e AS (SELECT user_id, event_type = 'error' AS sep, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS p FROM events),
     i AS (SELECT *, p - row_number() OVER (PARTITION BY user_id, sep ORDER BY p) AS island FROM e),
     r AS (SELECT user_id, min(p) AS a, max(p) + 1 AS z FROM i WHERE sep GROUP BY user_id, island HAVING count(*) >= 2)"""


@query(
    "wn03_segment_by_separator",
    f"""WITH {SEPARATED} SELECT user_id, coalesce(lag(z) OVER (PARTITION BY user_id ORDER BY a), 0) AS first, a AS stop FROM r""",
)
def segment_by_separator(t):
    return sq.segment_by_separator(t.events, USER, ORDER, F.col("event_type") == "error", 2)


@query(
    "wn03_segment_keep_tail",
    f"""WITH {SEPARATED}, x AS (SELECT user_id, a, z, false AS tail FROM r UNION ALL SELECT user_id, max(p) + 1, max(p) + 1, true FROM e GROUP BY 1),
         y AS (SELECT user_id, coalesce(lag(z) OVER (PARTITION BY user_id ORDER BY a, z), 0) AS first, a AS stop, tail FROM x)
        SELECT user_id, first, stop FROM y WHERE NOT tail OR first < stop""",
)
def segment_keep_tail(t):
    return sq.segment_by_separator(t.events, USER, ORDER, F.col("event_type") == "error", 2, keep_tail=True)


@query(
    "wn04_take_until_sentinel",
    """WITH s AS (SELECT user_id, min(event_id) AS stop FROM events WHERE event_type = 'purchase' GROUP BY 1)
       SELECT user_id, event_id, event_type FROM events LEFT JOIN s USING (user_id) WHERE stop IS NULL OR event_id < stop""",
)
def take_until_sentinel(t):
    rows = t.events.select("user_id", "event_id", "event_type")
    return sq.take_until_sentinel(rows, USER, "event_id", F.col("event_type") == "purchase")


@query(
    "wn05_sticky_state",
    """SELECT user_id, event_id, coalesce(last_value(CASE WHEN event_type = 'purchase' THEN round(value * 100)::BIGINT END IGNORE NULLS)
         OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), -1) AS state FROM events""",
)
def sticky_state(t):
    setter = F.when(F.col("event_type") == "purchase", cents("value"))
    rows = t.events.select("user_id", "event_id", setter.alias("_set"))
    return sq.sticky_state(rows, USER, ORDER, F.col("_set"), -1).drop("_set")


@query(
    "wn06_bounded_accumulate",
    """WITH l AS (SELECT user_id, list(round(value * 100)::BIGINT % 2001 - 1000 ORDER BY event_id) AS d FROM events GROUP BY 1)
       SELECT user_id, list_reduce(d, lambda a, x: least(8191, greatest(-8192, a + x)), 8192::BIGINT)::BIGINT AS total FROM l""",
)
def bounded_accumulate(t):
    delta = cents("value") % 2001 - 1000
    return sq.bounded_accumulate(t.events, USER, ORDER, delta, -8192, 8191, 8192)


RUNNING = """WITH l AS (SELECT user_id, list(round(value * 100)::BIGINT % 2001 - 1000 ORDER BY event_id) AS d, list(event_id ORDER BY event_id) AS e,
                min(event_id) FILTER (event_id % 29 = 0) AS stop FROM events GROUP BY 1),
            i AS (SELECT *, unnest(range(1, len(d) + 1)) AS i FROM l)
       SELECT user_id, e[i] AS event_id, list_reduce(d[1:i], lambda a, x: least(8191, greatest(-8192, a + x)), 8192::BIGINT)::BIGINT AS total
       FROM i WHERE stop IS NULL OR e[i] < stop"""


def running(t, hot_rows=None):
    rows = t.events.select("user_id", "event_id", (cents("value") % 2001 - 1000).alias("d"))
    return sq.bounded_running(rows, USER, ORDER, F.col("d"), -8192, 8191, 8192, is_end=F.col("event_id") % 29 == 0, hot_rows=hot_rows).drop("d")


query("wn06_bounded_running", RUNNING)(running)
query("wn06_bounded_running_hot", RUNNING)(lambda t: running(t, hot_rows=40))


@query(
    "wn07_dictionary_encode",
    """WITH f AS (SELECT p_name, p_brand, min(p_partkey) AS first_at, count(*) AS uses FROM part GROUP BY 1, 2)
       SELECT *, row_number() OVER (ORDER BY first_at, p_name, p_brand) - 1 AS code FROM f""",
)
def dictionary_encode(t):
    return sq.dictionary_encode(t.part, ["p_name", "p_brand"], "p_partkey")


@query(
    "wn08_composite_layers",
    """SELECT l_partkey, l_linenumber::BIGINT AS l_linenumber,
              coalesce(arg_max(d + l * 16, (l_orderkey, d, l)) FILTER (d <> 0), 0)::BIGINT AS shown
       FROM (SELECT *, round(l_discount * 100)::BIGINT AS d, (l_suppkey % 4)::BIGINT AS l FROM lineitem) GROUP BY 1, 2""",
)
def composite_layers(t):
    rows = t.lineitem.withColumns({"d": cents("l_discount"), "l": F.col("l_suppkey") % 4})
    return sq.composite_layers(rows, ["l_partkey", "l_linenumber"], ["l_orderkey", "d", "l"], "d", F.col("l"))


@query(
    "wn10_run_expand",
    """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_suppkey, substr(repeat(l_linenumber::VARCHAR, l_quantity::INT)
         || CASE WHEN l_suppkey % 3 > 0 THEN repeat('8', (l_suppkey % 3)::INT) || '99' ELSE '' END, 1, 40) AS items FROM lineitem""",
)
def run_expand(t):
    def run(value, count):
        return F.struct(value.cast("int").alias("value"), count.cast("int").alias("count"))

    runs = F.array(
        run(F.col("l_linenumber"), F.col("l_quantity")),
        run(F.lit(8), F.col("l_suppkey") % 3),
        run(F.lit(9), F.lit(2)),
    )
    items = F.array_join(sq.run_expand(runs, F.lit(40)), "")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", items.alias("items"))


@query(
    "wn10_command_streams",
    """WITH RECURSIVE d AS (SELECT doc_id, encode(replace(text, '.', chr(0))) AS b FROM documents),
            r AS (SELECT doc_id, 0 AS step, 0::BIGINT AS pos, 0::BIGINT AS made, '' AS part, CASE WHEN octet_length(b) = 0 THEN 'end' END AS status FROM d
                  UNION ALL
                  SELECT doc_id, step + 1, CASE WHEN code = 0 THEN pos + 1 ELSE least(pos + size, n) END, made + length(h) // 2, h,
                         CASE WHEN made + length(h) // 2 >= 4096 THEN 'length' WHEN code = 0 THEN 'stop' WHEN pos + size > n THEN 'cut' WHEN pos + size = n THEN 'end' END
                  FROM (SELECT *, left(CASE WHEN code = 0 THEN '' WHEN code >= 128 THEN hex(b[pos + 2:least(pos + size, n)])
                                            ELSE repeat(hex(b[pos + 2:pos + 2]), code) END, 2 * (4096 - made)::INT) AS h
                        FROM (SELECT r.*, b, octet_length(b) AS n, code, CASE WHEN code >= 128 THEN 257 - code ELSE 2 END AS size
                              FROM (SELECT r.*, b, ('0x' || hex(b[pos + 1:pos + 1]))::INT AS code FROM r JOIN d USING (doc_id) WHERE status IS NULL) r)))
       SELECT doc_id, max(made)::BIGINT AS length, max(pos)::BIGINT AS used, max(status) AS status, md5(unhex(string_agg(part, '' ORDER BY step))) AS digest
       FROM r GROUP BY doc_id""",
)
def command_streams(t):
    """Texts read as commands: letters are runs, bytes beyond ASCII literals, full stops the stop code."""
    blobs = t.documents.select("doc_id", F.encode(F.replace(F.col("text"), F.lit("."), F.lit("\0")), "UTF-8").alias("b"))
    told = inplace.expand_commands(blobs, ["doc_id"], "b", 4096)
    return told.select("doc_id", F.octet_length("data").cast("bigint").alias("length"), "used", "status", F.md5("data").alias("digest"))


@query(
    "wn11_stride_records",
    """WITH d AS (SELECT doc_id, encode(text) AS b FROM documents),
            r AS (SELECT doc_id, b, unnest(range(0, (octet_length(b) - 4) // 8)) AS record FROM d WHERE octet_length(b) >= 12)
       SELECT doc_id, record, record * 8 + 4 AS at, hex(b[record * 8 + 5:record * 8 + 12]) AS bytes FROM r""",
)
def stride_records(t):
    return sq.stride_records(document_blobs(t), "content", 8, 4).withColumn("bytes", F.hex("bytes"))


@query(
    "wn12_scan_nonoverlapping",
    """WITH p AS (SELECT doc_id, string_split(text, 'haha') AS s FROM documents),
            q AS (SELECT doc_id, len(s) AS n, unnest(s) AS part, unnest(range(0, len(s))) AS match FROM p)
       SELECT doc_id, match, (sum(length(part)) OVER (PARTITION BY doc_id ORDER BY match) + 4 * match)::BIGINT AS position
       FROM q QUALIFY match < n - 1""",
)
def scan_nonoverlapping(t):
    return sq.scan_nonoverlapping(t.documents.select("doc_id", "text"), "text", "haha")


@query(
    "wn12_scan_bytes",
    """WITH RECURSIVE d AS (SELECT doc_id, hex(encode(text)) AS h FROM documents),
            s AS (SELECT doc_id, list_filter(range(0, length(h) // 2 - 3), lambda i: substr(h, 2 * i + 1, 8) = '68616861') AS hits FROM d WHERE contains(h, '68616861')),
            r AS (SELECT doc_id, hits, 0 AS match, hits[1] AS position FROM s WHERE len(hits) > 0
                  UNION ALL SELECT doc_id, hits, match + 1, list_filter(hits, lambda i: i >= position + 4)[1] FROM r
                  WHERE len(list_filter(hits, lambda i: i >= position + 4)) > 0)
       SELECT doc_id, match::BIGINT AS match, position FROM r""",
)
def scan_bytes(t):
    return inplace.scan_nonoverlapping(document_blobs(t), ["doc_id"], "content", b"haha")


@query(
    "wn00_row_numbers",
    """SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn,
              lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before,
              lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS after FROM events""",
)
def row_numbers(t):
    kind = F.col("event_type")
    count = F.lit(1).cast("bigint")
    rows = scan(t.events, USER, ORDER, Step(sums={"rn": count}, before={"before": kind}, after={"after": kind}))
    return rows.select("user_id", "event_id", "rn", "before", "after")


# --- the same with every user treated as a hot key ------------------------------------------


def _hot(name: str, sql_of: str, run) -> None:
    query(name, ORACLES[sql_of])(run)


_hot("wn02_gap_groups_hot", "wn02_gap_groups", lambda t: sq.gap_groups(
    timed(t), USER, "t", 4 * 3600 * 1_000_000, 60_000_000, tie=["event_id"], hot_rows=40
))
_hot("wn03_segment_keep_tail_hot", "wn03_segment_keep_tail", lambda t: sq.segment_by_separator(
    t.events, USER, ORDER, F.col("event_type") == "error", 2, keep_tail=True, hot_rows=40
))
_hot("wn05_sticky_state_hot", "wn05_sticky_state", lambda t: sq.sticky_state(
    t.events.select("user_id", "event_id", F.when(F.col("event_type") == "purchase", cents("value")).alias("_set")),
    USER, ORDER, F.col("_set"), -1, hot_rows=40,
).drop("_set"))
_hot("wn06_bounded_accumulate_hot", "wn06_bounded_accumulate", lambda t: sq.bounded_accumulate(
    t.events, USER, ORDER, cents("value") % 2001 - 1000, -8192, 8191, 8192, hot_rows=40
))


# --- streams --------------------------------------------------------------------------------


def arriving(t):
    return st.read_stream(t.spark, t.folder, "events.parquet", t.events.schema)


SESSIONS = """WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS t FROM events WHERE ts IS NOT NULL),
            g AS (SELECT *, CASE WHEN lag(t) OVER w IS NULL OR t - lag(t) OVER w >= 1800000000 THEN 1 ELSE 0 END AS opens
                  FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
            n AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY t, event_id) AS grp FROM g)
       SELECT user_id, min(t) AS start, max(t) AS "end", count(*) AS members FROM n GROUP BY user_id, grp"""


def session_rows(sessions, *more):
    return sessions.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "members", *more)


@query("ss01_gap_sessions", SESSIONS)
def gap_sessions(t):
    return session_rows(st.all_sessions(arriving(t), USER, "ts", "30 minutes", "1 day"))


@query(
    "ss01_open_sessions",
    """WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS t FROM events WHERE ts IS NOT NULL),
            g AS (SELECT *, CASE WHEN lag(t) OVER w IS NULL OR t - lag(t) OVER w >= 1800000000 THEN 1 ELSE 0 END AS opens
                  FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
            n AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY t, event_id) AS grp FROM g)
       SELECT user_id, min(t) AS start, max(t) AS "end", count(*) AS members,
              max(t) + 1799999999 > (SELECT max(t) FROM e) // 1000 * 1000 - 86400000000 AS open FROM n GROUP BY user_id, grp""",
)
def open_sessions(t):
    """All sessions, and whether the stream still holds them as open."""
    return session_rows(st.all_sessions(arriving(t), USER, "ts", "30 minutes", "1 day"), "open")


@query("ss01_gap_sessions_all", SESSIONS)
def gap_sessions_all(t):
    """The same, with open sessions from the events behind each key's last closed one."""
    closed = session_rows(st.run_to_end(st.gap_sessions(arriving(t), USER, "ts", "30 minutes", "1 day"), "sessions"))
    return st.with_open_sessions(closed, timed(t), USER, "t", 1_800_000_000, tie=["event_id"])


@query(
    "ss02_manifest_on_arrival",
    """WITH w AS (SELECT max(epoch_us(ts)) // 1000 - 3600000 AS mark FROM events),
            x AS (SELECT event_id, round(value * 100)::BIGINT + (event_type = 'error')::INT AS expected, NULL AS deadline FROM events
                  UNION ALL SELECT -1 - user_id, min(event_id), max(epoch_us(ts)) // 1000 + 1800000 FROM events GROUP BY user_id)
       SELECT x.event_id, expected, round(value * 100)::BIGINT AS actual,
              CASE WHEN e.event_id IS NULL THEN CASE WHEN deadline < mark THEN 'missing' ELSE 'pending' END
              WHEN expected = round(value * 100)::BIGINT THEN 'ok' ELSE 'mismatch' END AS status
       FROM x CROSS JOIN w LEFT JOIN events e ON e.event_id = x.event_id""",
)
def manifest_on_arrival(t):
    """Every event is awaited until a day after it; for each user one more that never comes, until half an hour after the last."""
    wrong = (F.col("event_type") == "error").cast("int")
    at = F.floor(micros("ts") / 1000)
    events = t.events.select("event_id", (cents("value") + wrong).alias("v"), (at + 86_400_000).alias("deadline"))
    never = t.events.groupBy("user_id").agg(F.min("event_id").alias("v"), (F.max(at) + 1_800_000).alias("deadline"))
    expected = events.unionByName(never.select((-1 - F.col("user_id")).alias("event_id"), "v", "deadline"))
    arrivals = arriving(t).select("event_id", cents("value").alias("v"), "ts")
    return st.check_arrivals(arrivals, expected, "event_id", "v", "ts", "deadline", "1 hour", "arrivals")


@query(
    "ss03_band_counts",
    """SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS window_start, user_id, count(*) AS total,
              count(*) FILTER (value >= 0 AND value < 50) AS low, count(*) FILTER (value >= 50 AND value < 1000) AS rest
       FROM events GROUP BY 1, 2""",
)
def band_counts(t):
    bands = {"low": (0, 50), "rest": (50, 1000)}
    counts = st.band_counts(arriving(t), USER, "ts", "value", "1 day", "1 day", bands)
    out = st.run_updates(counts, "bands", ["window_start", "user_id"])
    return out.withColumn("window_start", F.unix_micros("window_start"))
