"""Lookups and searches."""

from pyspark.sql import functions as F

from ..operators import lookups as lk
from ..operators import search as se
from ..operators.profile import histogram
from ..operators.sequence import context_window, offset_from_end
from ..operators.similar import pair_overlaps
from ..sources.blobs import asset_paths, spread, text_blobs
from .registry import cents, query
from .sources import document_blobs


@query(
    "jn01_verify_manifest",
    """WITH e AS (SELECT o_custkey, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS expected FROM orders GROUP BY 1),
            a AS (SELECT o_custkey, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS actual FROM orders
                  WHERE o_orderstatus <> 'P' GROUP BY 1)
       SELECT o_custkey, expected, actual, CASE WHEN actual IS NULL THEN 'missing'
              WHEN actual = expected THEN 'ok' ELSE 'mismatch' END AS status FROM e LEFT JOIN a USING (o_custkey)""",
)
def verify_manifest(t):
    def totals(orders):
        return orders.groupBy("o_custkey").agg(F.sum(cents("o_totalprice")).alias("total"))

    closed = t.orders.where(F.col("o_orderstatus") != "P")
    return lk.verify_manifest(totals(closed), totals(t.orders), "o_custkey", "total")


@query(
    "jn02_identify_signature",
    """WITH s AS (SELECT n_chars, md5(text) AS digest, min(doc_id) AS known FROM documents
                  JOIN labels USING (doc_id) GROUP BY 1, 2)
       SELECT d.doc_id, s.known FROM documents d LEFT JOIN s ON s.n_chars = d.n_chars AND s.digest = md5(d.text)""",
)
def identify_signature(t):
    docs = t.documents.select("doc_id", "n_chars", F.md5(F.encode("text", "UTF-8")).alias("digest"))
    signatures = docs.join(t.labels, "doc_id").select("n_chars", "digest", F.col("doc_id").alias("known"))
    return lk.identify_signature(docs, signatures, ["n_chars", "digest"], "known").select("doc_id", "known")


@query(
    "jn02_unidentified",
    """SELECT doc_id FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents JOIN labels USING (doc_id))""",
)
def unidentified(t):
    docs = t.documents.select("doc_id", "n_chars", F.md5(F.encode("text", "UTF-8")).alias("digest"))
    return lk.unidentified(docs, docs.join(t.labels, "doc_id"), ["n_chars", "digest"]).select("doc_id")


MATCHES = """d AS (SELECT doc_id, source, text, encode(text) AS b FROM documents),
     p AS (SELECT item_id, text AS passage, encode(text) AS p FROM benchmark WHERE octet_length(encode(text)) >= 16),
     c AS (SELECT doc_id, source, item_id, b, p, unnest(range(0, octet_length(b) - octet_length(p) + 1)) AS position
           FROM d JOIN p ON contains(text, passage)),
     m AS (SELECT doc_id, source, item_id, position::BIGINT AS position, b, p FROM c
           WHERE b[position + 1:position + octet_length(p)] = p)"""


def passages(t, around=None):
    patterns = text_blobs(t.benchmark, "text", "pattern").select("item_id", "pattern")
    return se.search_patterns(document_blobs(t), patterns, "doc_id", "content", "item_id", "pattern", around=around)


@query("jn03_search_patterns", f"WITH {MATCHES} SELECT doc_id, item_id, position FROM m")
def search_patterns(t):
    return passages(t)


@query("jn03_match_summary", f"WITH {MATCHES} SELECT item_id, count(*) AS matches FROM m GROUP BY item_id")
def match_summary(t):
    return se.match_summary(passages(t), "item_id")


@query(
    "src09_asset_sink",
    f"""WITH {MATCHES}, n AS (SELECT item_id, count(*) AS n FROM m GROUP BY item_id)
        SELECT doc_id, item_id, source || '/item' || item_id || CASE WHEN n > 1 THEN printf('_0x%08X', position) ELSE '' END
               || '.bin' AS asset_path FROM m JOIN n USING (item_id)""",
)
def asset_sink(t):
    hits = passages(t).join(t.documents.select("doc_id", "source"), "doc_id")
    stem = F.concat(F.lit("item"), F.col("item_id"))
    named = asset_paths(hits, F.col("source"), stem, F.lit(".bin"), ["item_id"], "position")
    return named.select("doc_id", "item_id", "asset_path")


@query(
    "wn09_context_window",
    f"""WITH {MATCHES} SELECT doc_id, item_id, position,
          hex(b[greatest(0, position - 8) + 1:least(octet_length(b), position + octet_length(p) + 8)]) AS context FROM m""",
)
def context(t):
    sizes = text_blobs(t.benchmark, "text", "pattern").select("item_id", F.octet_length("pattern").alias("size"))
    # A hit brings what lies around it, so no document is read again.
    hits = passages(t, around=8).join(sizes, "item_id").withColumn("from_one", F.col("near_at") + 1)
    out = context_window(hits, "near", "from_one", F.col("size"), 8)
    return out.select("doc_id", "item_id", "position", F.hex("context").alias("context"))


@query(
    "wn13_offset_from_end",
    f"WITH {MATCHES} SELECT doc_id, item_id, position, octet_length(b) - position AS from_end FROM m",
)
def from_end(t):
    hits = offset_from_end(passages(t, around=0), "position", F.col("blob_size"))
    return hits.select("doc_id", "item_id", "position", "from_end")


@query(
    "jn04_decode_by_dimension",
    """SELECT p_partkey, (p_size % 16)::BIGINT AS code, ((p_size % 16) // 4 + 1)::BIGINT AS width,
              (p_size % 4 + 1)::BIGINT AS height, (((p_size % 16) // 4 + 1) * (p_size % 4 + 1))::BIGINT AS tiles FROM part""",
)
def decode_by_dimension(t):
    codes = t.spark.createDataFrame(lk.SIZE_CODES, "code int, tiles int, width int, height int")
    records = t.part.select("p_partkey", (F.col("p_size") % 16).alias("code"))
    return lk.decode_by_dimension(records, codes, "code")


@query(
    "jn04_decode_size",
    """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_quantity::BIGINT AS code,
              CASE WHEN l_quantity < 16 THEN (l_quantity::BIGINT // 4 + 1) * (l_quantity::BIGINT % 4 + 1) END AS tiles
       FROM lineitem""",
)
def decode_size(t):
    code = F.col("l_quantity").cast("int")
    return t.lineitem.select("l_orderkey", "l_linenumber", code.alias("code"), lk.decode_size(code)["tiles"].alias("tiles"))


@query(
    "jn05_palette_lookup",
    """SELECT c_custkey, c_nationkey::BIGINT AS c_nationkey, coalesce(n_nationkey * 10, 0)::BIGINT AS r, coalesce(n_regionkey * 36, 0)::BIGINT AS g,
              coalesce(length(n_name), 0)::BIGINT AS b
       FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON n_nationkey = c_nationkey""",
)
def palette_lookup(t):
    palette = t.nation.where("n_regionkey <> 2").select(
        F.col("n_nationkey").alias("c_nationkey"),
        (F.col("n_nationkey") * 10).alias("r"),
        (F.col("n_regionkey") * 36).alias("g"),
        F.length("n_name").alias("b"),
    )
    return lk.palette_lookup(t.customer.select("c_custkey", "c_nationkey"), palette, "c_nationkey")


@query(
    "jn06_remap_two_hop",
    """WITH m AS (SELECT l_partkey AS p_partkey, min(l_suppkey) AS s_suppkey FROM lineitem WHERE l_partkey >= 128 GROUP BY 1)
       SELECT p.p_partkey, coalesce(s_nationkey, 0)::BIGINT AS s_nationkey FROM part p
       LEFT JOIN m USING (p_partkey) LEFT JOIN supplier USING (s_suppkey)""",
)
def remap_two_hop(t):
    remap = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min("l_suppkey").alias("s_suppkey"))
    palette = t.supplier.select("s_suppkey", "s_nationkey")
    return lk.remap_two_hop(t.part.select("p_partkey"), remap, palette, "p_partkey", "s_suppkey", low=128)


@query(
    "jn07_resolve_override",
    """SELECT o_orderkey, CASE
         WHEN c_mktsegment = 'BUILDING' AND o_orderpriority = '1-URGENT' THEN 'customer ' || o_custkey
         WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'general ' || o_orderpriority
         WHEN contains(o_orderpriority, ' ') THEN o_orderpriority END AS colour,
       CASE WHEN c_mktsegment = 'BUILDING' AND o_orderpriority = '1-URGENT' THEN 'specific'
         WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'general'
         WHEN contains(o_orderpriority, ' ') THEN 'literal' ELSE 'error' END AS source
       FROM orders LEFT JOIN customer ON c_custkey = o_custkey""",
)
def resolve_override(t):
    wanted = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority")
    specific = t.customer.where("c_mktsegment = 'BUILDING'").select(
        F.col("c_custkey").alias("o_custkey"),
        F.lit("1-URGENT").alias("o_orderpriority"),
        F.concat(F.lit("customer "), F.col("c_custkey")).alias("colour"),
    )
    general = (
        t.orders.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
        .select("o_orderpriority")
        .distinct()
        .withColumn("colour", F.concat(F.lit("general "), F.col("o_orderpriority")))
    )
    out = lk.resolve_override(wanted, specific, general, ["o_custkey", "o_orderpriority"], "o_orderpriority", "colour")
    return out.select("o_orderkey", "colour", "source")


@query(
    "jn08_tuned_default",
    """SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 0.0::DOUBLE WHEN s_acctbal > 5000 THEN 0.5::DOUBLE
                WHEN n_regionkey > 0 THEN n_regionkey * 0.5::DOUBLE ELSE 1.0::DOUBLE END AS factor
       FROM supplier JOIN nation ON n_nationkey = s_nationkey""",
)
def tuned_default(t):
    custom = F.when(F.col("s_acctbal") < 0, 0.0).when(F.col("s_acctbal") > 5000, 0.5)
    rows = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select("s_suppkey", lk.tuned_default(custom, F.col("n_regionkey") * 0.5).alias("factor"))


@query(
    "jn09_range_lookup",
    """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_quantity, CASE WHEN l_quantity BETWEEN 1 AND 10 THEN 1
         WHEN l_quantity BETWEEN 8 AND 20 THEN 2 WHEN l_quantity BETWEEN 15 AND 30 THEN 3
         WHEN l_quantity BETWEEN 35 AND 45 THEN 4 ELSE 0 END::BIGINT AS band FROM lineitem""",
)
def range_lookup(t):
    bands = t.spark.createDataFrame([(3, 15, 30), (1, 1, 10), (2, 8, 20), (4, 35, 45)], "band int, low int, high int")
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity")
    return lk.range_lookup(rows, "l_quantity", bands, "band", "low", "high")


@query(
    "jn09_range_lookup_large",
    """WITH r AS (SELECT s_suppkey AS band, s_suppkey * 7 AS low, s_suppkey * 7 + 9 AS high FROM supplier),
            v AS (SELECT DISTINCT l_partkey FROM lineitem),
            f AS (SELECT l_partkey, min(band) AS band FROM v JOIN r ON l_partkey BETWEEN low AND high GROUP BY 1)
       SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, coalesce(band, -1) AS band FROM lineitem LEFT JOIN f USING (l_partkey)""",
)
def range_lookup_large(t):
    low = F.col("s_suppkey") * 7
    ranges = t.supplier.select(F.col("s_suppkey").alias("band"), low.alias("low"), (low + 9).alias("high"))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    return lk.range_lookup(rows, "l_partkey", ranges, "band", "low", "high", default=-1, width=64)


FOUR = [(0, 0, 25, 40000), (25, 0, 51, 40000), (0, 40000, 25, 200000), (25, 40000, 51, 200000)]


@query(
    "jn10_assign_region",
    """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, ((l_quantity >= 25)::INT + 2 * (l_extendedprice >= 40000)::INT)::BIGINT AS region FROM lineitem""",
)
def assign_region(t):
    region = lk.assign_region(F.col("l_quantity"), F.col("l_extendedprice"), FOUR)
    return t.lineitem.select("l_orderkey", "l_linenumber", region.alias("region"))


@query(
    "jn10_assign_region_strict",
    """WITH r AS (SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE WHEN l_quantity < 10 THEN 0 WHEN l_quantity < 30 THEN 1 WHEN l_quantity < 45 THEN 2 END AS c,
                         CASE WHEN l_extendedprice < 20000 THEN 0 WHEN l_extendedprice < 50000 THEN 1 WHEN l_extendedprice < 90000 THEN 2 END AS r
                  FROM lineitem)
       SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, (r * 3 + c)::BIGINT AS region FROM r WHERE r IS NOT NULL AND c IS NOT NULL""",
)
def assign_region_strict(t):
    xs, ys = (0, 10, 30, 45), (0, 20000, 50000, 90000)
    nine = [(xs[c], ys[r], xs[c + 1], ys[r + 1]) for r in range(3) for c in range(3)]
    region = lk.assign_region(F.col("l_quantity"), F.col("l_extendedprice"), nine, None)
    rows = t.lineitem.select("l_orderkey", "l_linenumber", region.alias("region"))
    return rows.where(F.col("region").isNotNull())


@query(
    "jn11_interval_catalog",
    """WITH c AS (SELECT min(p_partkey) AS low, min(p_partkey) + 79 AS high, min(p_brand) AS category,
                         min(p_partkey) - 8 AS other_low FROM part GROUP BY p_partkey // 100)
       SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, category, l_partkey - low + other_low AS other
       FROM lineitem LEFT JOIN c ON l_partkey BETWEEN low AND high""",
)
def interval_catalog(t):
    catalog = t.part.groupBy(F.floor(F.col("p_partkey") / 100).alias("_g")).agg(
        F.min("p_partkey").alias("low"),
        (F.min("p_partkey") + 79).alias("high"),
        F.min("p_brand").alias("category"),
        (F.min("p_partkey") - 8).alias("other_low"),
    )
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    return lk.interval_catalog(rows, "l_partkey", catalog, "category", "low", "high", "other_low", width=100)


@query(
    "jn12_merge_by_index",
    """SELECT p_partkey, CASE WHEN p_partkey < 100 OR p_partkey >= 180 THEN p_retailprice ELSE p_retailprice * 2 END AS price FROM part""",
)
def merge_by_index(t):
    a = t.part.select("p_partkey", F.col("p_retailprice").alias("price"))
    b = t.part.select("p_partkey", (F.col("p_retailprice") * 2).alias("price"))
    return lk.merge_by_index(a, b, "p_partkey", "price", 100, 180)


@query(
    "jn13_catalog_fill",
    """SELECT code, coalesce(parts, 0) AS parts, coalesce(name, 'Unknown') AS name FROM range(1, 61) r(code)
       LEFT JOIN (SELECT p_size, count(*) AS parts, min(p_name) AS name FROM part GROUP BY 1) ON p_size = code""",
)
def catalog_fill(t):
    known = t.part.groupBy(F.col("p_size").cast("bigint").alias("code")).agg(
        F.count("*").alias("parts"), F.min("p_name").alias("name")
    )
    return lk.catalog_fill(t.spark, 1, 60, known, "code", {"parts": 0, "name": "Unknown"})


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query(
    "jn14_parameter_sweep",
    """WITH s AS (SELECT c_mktsegment AS seg, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cents
                  FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1),
            g AS (SELECT 'baseline' AS scenario, NULL AS item, 1.0::DOUBLE AS factor
                  UNION ALL SELECT 'item' || seg || '_factor' || replace(f, '.', '_'), seg, f::DOUBLE
                  FROM (SELECT DISTINCT c_mktsegment AS seg FROM customer), (VALUES ('0.25'), ('0.5'), ('0.75'), ('1'), ('1.5'), ('2')) v(f)
                  UNION ALL SELECT 'half_building', 'BUILDING', 0.5::DOUBLE)
       SELECT scenario, sum(cents * CASE WHEN item = seg THEN factor ELSE 1.0::DOUBLE END) AS total FROM g, s GROUP BY 1""",
)
def parameter_sweep(t):
    sales = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "c_mktsegment", cents("o_totalprice").alias("cents")
    )
    grid = lk.parameter_sweep(SEGMENTS, (0.25, 0.5, 0.75, 1.0, 1.5, 2.0), [("half_building", "BUILDING", 0.5)])
    return lk.apply_sweep(sales, "c_mktsegment", "cents", grid)


TOKENS = "tokens AS (SELECT doc_id, lang, source, unnest(string_split(text, ' ')) AS token FROM documents)"


def tokens(t):
    words = F.explode(F.split("text", " ")).alias("token")
    docs = spread(t.documents.select("doc_id", "lang", "source", "text"), "doc_id")
    return docs.select("doc_id", "lang", "source", words).where("token <> ''")


@query(
    "jn15_pairwise",
    f"""WITH {TOKENS}, h AS (SELECT DISTINCT source, token FROM tokens WHERE token <> '')
        SELECT x.source AS a, y.source AS b, count(*) AS common_keys FROM h x JOIN h y ON x.token = y.token AND x.source < y.source
        GROUP BY 1, 2""",
)
def pairwise(t):
    hist = histogram(tokens(t), ["source"], ["token"])
    return pair_overlaps(hist, "source", ["token"]).select("a", "b", "common_keys")


@query(
    "jn16_sequence_diff",
    """WITH h AS (SELECT page_id, encode(html) AS b FROM pages),
            j AS (SELECT x.page_id, x.b AS e, y.b AS a FROM h x JOIN h y ON y.page_id = x.page_id + 1),
            o AS (SELECT page_id, e, a, unnest(range(0, least(octet_length(e), octet_length(a)))) AS i FROM j),
            f AS (SELECT page_id, min(i) AS i FROM o WHERE e[i + 1:i + 1] <> a[i + 1:i + 1] GROUP BY 1)
       SELECT j.page_id, coalesce(i, least(octet_length(e), octet_length(a))) AS equal_leading, i AS position,
              hex(e[i + 1:i + 1]) AS expected_byte, hex(a[i + 1:i + 1]) AS actual_byte,
              hex(e[greatest(0, i - 8) + 1:i + 8]) AS expected_context, hex(a[greatest(0, i - 8) + 1:i + 8]) AS actual_context,
              octet_length(a) - octet_length(e) AS length_difference
       FROM j LEFT JOIN f USING (page_id)""",
)
def sequence_diff(t):
    pages = t.pages.select("page_id", F.encode("html", "UTF-8").alias("expected"))
    following = t.pages.select((F.col("page_id") - 1).alias("page_id"), F.encode("html", "UTF-8").alias("actual"))
    return se.sequence_diff(pages.join(following, "page_id"), "expected", "actual").drop("expected", "actual")


@query(
    "jn17_prefix_extra",
    """SELECT x.conv_id, x.turn, starts_with(y.text, x.role) AS is_prefix,
              CASE WHEN starts_with(y.text, x.role) THEN substr(y.text, length(x.role) + 1) END AS extra,
              left(y.text, 16) AS first, right(y.text, 16) AS last
       FROM conversations x JOIN (SELECT conv_id, turn, role || ': ' || text AS text FROM conversations) y
         ON y.conv_id = x.conv_id AND y.turn = x.turn + 2""",
)
def prefix_extra(t):
    later = t.conversations.select(
        "conv_id", (F.col("turn") - 2).alias("turn"), F.concat_ws(": ", "role", "text").alias("b")
    )
    pairs = t.conversations.select("conv_id", "turn", F.col("role").alias("a")).join(later, ["conv_id", "turn"])
    return pairs.select("conv_id", "turn", se.prefix_extra(F.col("a"), F.col("b")).alias("e")).select("conv_id", "turn", "e.*")


RECODING = [("AUTOMOBILE", 1), ("BUILDING", 2), ("MACHINERY", 5)]


def recoded(t):
    table = t.spark.createDataFrame(RECODING, "c_mktsegment string, segment int")
    return lk.recode(t.customer.select("c_custkey", "c_mktsegment"), "c_mktsegment", table, "segment")


@query(
    "jn18_recode",
    """SELECT c_custkey, c_mktsegment, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 ELSE 5 END::BIGINT AS segment
       FROM customer WHERE c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY')""",
)
def recode(t):
    return recoded(t)[0].select("c_custkey", "c_mktsegment", "segment")


@query(
    "jn18_recode_unmapped",
    """SELECT c_mktsegment, count(*) AS skipped FROM customer WHERE c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY') GROUP BY 1""",
)
def recode_unmapped(t):
    return recoded(t)[1]


@query(
    "jn19_enrich",
    """WITH s AS (SELECT o_custkey, count(*) AS orders, max(o_totalprice) AS balance FROM orders GROUP BY 1)
       SELECT c_custkey, CASE WHEN o_custkey IS NULL THEN c_acctbal ELSE s.balance END AS balance, n_name, orders
       FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN s ON o_custkey = c_custkey""",
)
def enrich(t):
    base = t.customer.select("c_custkey", "c_nationkey", F.col("c_acctbal").alias("balance"))
    places = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    people = base.select("c_custkey", "c_nationkey").join(places, "c_nationkey").select("c_custkey", "n_name")
    stats = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("orders"), F.max("o_totalprice").alias("balance")
    )
    return lk.enrich(base, "c_custkey", people, stats).select("c_custkey", "balance", "n_name", "orders")


@query("jn20_unnest", "SELECT vec_id, unnest(embedding)::DOUBLE AS item FROM embeddings")
def unnest(t):
    return lk.unnest(t.embeddings, "embedding").select("vec_id", "item")


@query(
    "jn21_keep_failed",
    """SELECT doc_id, quality::BIGINT AS quality, toxic::BIGINT AS toxic FROM documents LEFT JOIN labels USING (doc_id)""",
)
def keep_failed(t):
    return lk.keep_failed(t.documents, t.labels, "doc_id")
