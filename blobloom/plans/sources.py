"""Sources, sinks and probes."""

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import probes
from ..shared import new_folder
from ..sources import blobs as bl
from ..sources import tables as tb
from .registry import ORACLES, Tables, cents, query


def document_blobs(t: Tables, *more: str, min_length: int = 0):
    """Every document's text as a blob; a null text is an empty one."""
    docs = bl.text_blobs(bl.spread(t.documents.select("doc_id", *more, F.coalesce("text", F.lit("")).alias("text")), "doc_id"), "text", min_length=min_length)
    return docs.select("doc_id", *more, "content")


@query(
    "src01_read_blobs",
    """SELECT doc_id, octet_length(encode(text))::BIGINT AS length FROM documents
       WHERE octet_length(encode(text)) >= 6""",
)
def read_blobs(t):
    return document_blobs(t, min_length=6).select("doc_id", F.octet_length("content").alias("length"))


def nation_files(t) -> str:
    """Customers as real files: a directory per nation with one file of lines."""
    folder = new_folder(t.spark, "customers")
    line = F.format_string("%d\t%s\t%s", F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment"))
    bl.write_lines(t.customer, "c_nationkey", ["c_custkey"], line, folder)
    return folder


def nation_of(path: str):
    return F.regexp_extract(path, "c_nationkey=([0-9]+)/", 1).cast("bigint").alias("nation")


FILES = """f AS (SELECT c_nationkey::BIGINT AS nation, string_agg(c_custkey || chr(9) || c_name || chr(9) || c_mktsegment || chr(10), '' ORDER BY c_custkey) AS content
                 FROM customer GROUP BY 1)"""


@query("src01_read_files", f"WITH {FILES} SELECT nation, octet_length(encode(content))::BIGINT AS length, md5(content) AS digest FROM f WHERE octet_length(encode(content)) >= 200")
def read_files(t):
    """Files of at least 200 bytes, whole, by the binary source."""
    files = bl.read_blobs(t.spark, nation_files(t), "*.txt", min_length=200)
    return files.select(nation_of("path"), "length", F.md5("content").alias("digest"))


@query("src02_list_files", f"WITH {FILES} SELECT nation, octet_length(encode(content))::BIGINT AS length FROM f")
def list_files(t):
    """The files' own metadata, by the rule on their extension."""
    files = bl.filter_listing(bl.list_files(t.spark, nation_files(t)), "path", "extension", ".txt")
    return files.select(nation_of("path"), "length")


@query(
    "src02_filter_listing",
    """WITH n AS (SELECT page_id, list_last(string_split(url, '/')) AS name FROM pages)
       SELECT page_id, name, ends_with(name, '.html') AS by_extension,
              NOT contains(name, '.') AS bare,
              starts_with(name, '!') AND NOT contains(name, '.') AS bang,
              strpos(name, '.html') > 1 AS has_extension FROM n""",
)
def filter_listing(t):
    name = bl.file_name(F.col("url"))
    return t.pages.select(
        "page_id",
        name.alias("name"),
        bl.listing_rule(name, "extension", ".html").alias("by_extension"),
        bl.listing_rule(name, "bare").alias("bare"),
        bl.listing_rule(name, "bang").alias("bang"),
        bl.listing_rule(name, "contains", ".html").alias("has_extension"),
    )


MANIFEST = [("head", "a", 0, 64), ("middle", "a", 32, 160), ("none", "b", 10, 10), ("late", "b", 1000, 1256)]


@query(
    "src03_slice_by_manifest",
    """SELECT doc_id, name, folder, hex(encode(coalesce(text, ''))[a + 1:b]) AS bytes
       FROM documents, (VALUES ('head', 'a', 0, 64), ('middle', 'a', 32, 160),
                               ('none', 'b', 10, 10), ('late', 'b', 1000, 1256)) m(name, folder, a, b)""",
)
def slice_by_manifest(t):
    cut = bl.slice_by_manifest(document_blobs(t), "content", MANIFEST)
    return cut.select("doc_id", "name", "folder", F.hex("bytes").alias("bytes"))


@query(
    "src03_slice_by_table",
    """SELECT doc_id, toxic AS name, hex(encode(text)[quality * 20 + 1:quality * 20 + 40]) AS bytes
       FROM documents JOIN labels USING (doc_id)""".replace("toxic AS name", "toxic::BIGINT AS name"),
)
def slice_by_table(t):
    start = F.col("quality") * 20
    entries = t.labels.select("doc_id", F.col("toxic").alias("name"), start.alias("start"), (start + 40).alias("end"))
    cut = bl.slice_by_table(document_blobs(t), "doc_id", "content", entries)
    return cut.select("doc_id", "name", F.hex("bytes").alias("bytes"))


@query(
    "src04_read_csv_positional",
    """SELECT s_suppkey::VARCHAR AS number, s_name AS title, s_nationkey::VARCHAR AS place,
              s_acctbal::VARCHAR AS balance FROM supplier""",
)
def read_csv_positional(t):
    folder = new_folder(t.spark, "csv")
    t.supplier.write.option("header", False).csv(folder)
    return tb.read_csv_positional(t.spark, folder, ["number", "title", "place", "balance"])


@query(
    "src05_write_csv_titled",
    """SELECT s_suppkey AS "ID", s_name AS "Name", n_name AS "Nation", r_name AS "Region"
       FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey""",
)
def write_csv_titled(t):
    rows = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(
        t.region, F.col("n_regionkey") == F.col("r_regionkey")
    )
    titles = {"s_suppkey": "ID", "s_name": "Name", "n_name": "Nation", "r_name": "Region"}
    folder = new_folder(t.spark, "titled")
    tb.write_csv_titled(rows, titles, folder)
    schema = "`ID` bigint, `Name` string, `Nation` string, `Region` string"
    return t.spark.read.schema(schema).option("header", True).csv(folder)


TYPES = ("click", "error", "purchase", "signup", "view")


@query(
    "src06_write_wide",
    "SELECT user_id, "
    + ", ".join(f"coalesce(nullif(count(*) FILTER (event_type = '{k}'), 0)::VARCHAR, '') AS \"{k}\"" for k in TYPES)
    + " FROM events GROUP BY user_id",
)
def write_wide(t):
    return tb.wide(t.events, ["user_id"], "event_type", F.count(F.lit(1)))


@query(
    "src07_flatten_nested",
    """SELECT event_id, event_type, json_extract_string(props, '$.k')::BIGINT AS k FROM events""",
)
def flatten_nested(t):
    # The flat properties go one level down first, so that there is a path to follow.
    nested = F.concat(F.lit('{"event": {"props": '), F.col("props"), F.lit("}}"))
    rows = t.events.select("event_id", "event_type", nested.alias("json"))
    return tb.flatten_nested(rows, "json", "event struct<props: struct<k: int>>", {"event.props.k": "k"})


@query(
    "src08_json_sidecar",
    """SELECT l_orderkey, count(*) AS items, sum(l_quantity)::BIGINT AS quantity,
              sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS cents
       FROM lineitem GROUP BY l_orderkey""",
)
def json_sidecar(t):
    item = F.struct(F.col("l_quantity").cast("bigint").alias("quantity"), cents("l_extendedprice").alias("cents"))
    documents = tb.json_sidecar(t.lineitem, ["l_orderkey"], [F.col("l_linenumber").alias("line"), item.alias("item")])
    back = tb.flatten_nested(
        documents,
        "document",
        "line int, item struct<quantity: bigint, cents: bigint>",
        {"item.quantity": "quantity", "item.cents": "cents"},
    )
    return back.groupBy("l_orderkey").agg(
        F.count("*").alias("items"), F.sum("quantity").alias("quantity"), F.sum("cents").alias("cents")
    )


def _crc_sql() -> str:
    """CRC-32 byte by byte, with the table of the reflected polynomial EDB88320."""
    table = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    return f"""WITH k AS (SELECT {table}::BIGINT[] AS k), d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
            l AS (SELECT doc_id, list_transform(range(1, octet_length(b) + 1), lambda i: ('0x' || hex(b[i:i]))::BIGINT) AS bytes FROM d)
       SELECT doc_id, xor(list_reduce(bytes, lambda c, x: xor(k[(xor(c, x) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295::BIGINT) AS crc FROM l, k"""


@query("src10_snapshot_crc", _crc_sql())
def snapshot_crc(t):
    return bl.snapshot_manifest(document_blobs(t), "doc_id", "content")


@query("src10_snapshot_manifest", "SELECT doc_id, md5(coalesce(text, '')) AS md5 FROM documents")
def snapshot_manifest(t):
    return bl.snapshot_digests(document_blobs(t), "doc_id", "content")


@query(
    "src09_written_assets",
    """SELECT doc_id, name, folder, octet_length(encode(coalesce(text, ''))[a + 1:b])::BIGINT AS length, md5(encode(coalesce(text, ''))[a + 1:b]) AS digest
       FROM documents, (VALUES ('head', 'a', 0, 64), ('middle', 'a', 32, 160), ('late', 'c', 500, 900)) m(name, folder, a, b)""",
)
def written_assets(t):
    """Slices, written to a directory per folder and read back."""
    manifest = [("head", "a", 0, 64), ("middle", "a", 32, 160), ("late", "c", 500, 900)]
    assets = bl.slice_by_manifest(document_blobs(t), "content", manifest).select("doc_id", "name", "folder", "bytes")
    path = new_folder(t.spark, "assets")
    bl.write_assets(assets, "folder", path)
    back = bl.read_assets(t.spark, assets.schema, "folder", path)
    return back.select("doc_id", "name", "folder", F.octet_length("bytes").alias("length"), F.md5("bytes").alias("digest"))


@query(
    "src10_snapshot_once",
    """WITH a AS (SELECT doc_id, md5(coalesce(text, '')) AS md5 FROM documents),
            b AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN md5(md5) ELSE md5 END AS md5 FROM a WHERE doc_id % 7 > 0)
       SELECT 1::BIGINT AS run, doc_id, md5 AS expected, md5 AS actual, 'written' AS status FROM a
       UNION ALL SELECT 2, a.doc_id, a.md5, b.md5, CASE WHEN b.doc_id IS NULL THEN 'missing' WHEN a.md5 = b.md5 THEN 'ok' ELSE 'mismatch' END
       FROM a LEFT JOIN b ON a.doc_id = b.doc_id""",
)
def snapshot_once(t):
    """The first run writes the snapshot; in the second, files have gone and others have changed."""
    path = new_folder(t.spark, "snapshot")
    first = bl.snapshot_digests(document_blobs(t), "doc_id", "content")
    changed = F.when(F.col("doc_id") % 10 == 0, F.md5(F.col("md5").cast("binary"))).otherwise(F.col("md5"))
    second = first.where(F.col("doc_id") % 7 > 0).withColumn("md5", changed)
    told = [bl.snapshot_once(manifest, "doc_id", "md5", path).select(F.lit(run).alias("run"), "*") for run, manifest in enumerate((first, second), 1)]
    return told[0].unionByName(told[1])


@query(
    "src11_report_lines",
    """SELECT DISTINCT s_nationkey::BIGINT AS s_nationkey, 0::BIGINT AS line_no, '| Supplier | Name |' AS line FROM supplier
       UNION ALL
       SELECT s_nationkey::BIGINT, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey),
              printf('| %d | %s |', s_suppkey, s_name) FROM supplier""",
)
def report_lines(t):
    line = F.format_string("| %d | %s |", F.col("s_suppkey"), F.col("s_name"))
    return tb.report_lines(t.supplier, ["s_nationkey"], ["s_suppkey"], "| Supplier | Name |", line)


# --- probes ---------------------------------------------------------------------------------


@query(
    "flt01_checksum_gate",
    """SELECT doc_id FROM documents
       WHERE md5(coalesce(text, '')) = (SELECT md5(arg_min(coalesce(text, ''), doc_id)) FROM documents)""",
)
def checksum_gate(t):
    docs = document_blobs(t)
    expected = docs.agg(F.md5(F.min_by("content", "doc_id"))).scalar()
    return probes.digest_gate(docs, "content", expected).select("doc_id")


@query(
    "flt01_checksum_flag",
    """SELECT doc_id, coalesce(text, '') = (SELECT arg_min(coalesce(text, ''), doc_id) FROM documents) AS checksum_ok FROM documents""",
)
def checksum_flag(t):
    docs = document_blobs(t)
    expected = docs.agg(F.crc32(F.min_by("content", "doc_id"))).scalar()
    return probes.checksum_gate(docs, "content", expected, soft=True).select("doc_id", "checksum_ok")


# Offsets of every byte but the last eleven, in SQL.
OFFSETS = """d AS (SELECT doc_id, encode(text) AS b FROM documents),
             o AS (SELECT doc_id, b, unnest(range(0, octet_length(b) - 11)) AS i FROM d)"""


def byte_sql(offset: str) -> str:
    return f"('0x' || hex(b[{offset} + 1:{offset} + 1]))::INT"


@query(
    "flt02_probe_layout",
    f"""WITH {OFFSETS}
        SELECT doc_id, i AS at, {byte_sql('i')}::BIGINT AS tens, {byte_sql('i + 1')}::BIGINT AS ones,
               ('0x' || hex(b[i + 4:i + 7]))::BIGINT AS word
        FROM o WHERE b[i + 1:i + 1] BETWEEN '0'::BLOB AND '9'::BLOB
          AND {byte_sql('i + 1')} BETWEEN 48 AND 57 AND {byte_sql('i + 2')} = 32""",
)
def probe_layout(t):
    fields = {"tens": (0, "u8"), "ones": (1, "u8"), "blank": (2, "u8"), "word": (3, "u32be")}
    rules = [F.col("ones").between(48, 57), F.col("blank") == 32]
    digit = F.expr("substring(content, at + 1, 1) BETWEEN X'30' AND X'39'")
    found = probes.probe_layout(document_blobs(t), "content", fields, rules, first=digit)
    return found.drop("blank")


@query(
    "flt02_find_map_layouts",
    """SELECT doc_id, 17::BIGINT AS at, CASE WHEN doc_id % 2 = 1 THEN 'packed' ELSE 'plain' END AS kind,
              10 + 32 * tiles AS palette_at, 42 + 32 * tiles AS map_at, 2::BIGINT AS width, 3::BIGINT AS height,
              17 + 42 + 32 * tiles + 16 + CASE WHEN doc_id % 2 = 1 THEN 4 ELSE 0 END AS "end"
       FROM (SELECT doc_id, (1 + n_chars % 3)::BIGINT AS tiles FROM documents)""",
)
def find_map_layouts(t):
    # Each text, filled up to 200 bytes, lends its bytes to a map file behind 17 bytes of something else.
    docs = document_blobs(t, "n_chars").withColumn("tiles", 1 + F.col("n_chars") % 3)
    docs = docs.withColumn("content", F.concat("content", F.lit(b"." * 200)))

    def number(value, digits: int):
        return F.unhex(F.lpad(F.hex(value), digits, "0"))

    size = F.col("tiles").cast("int") * 32
    planted = F.concat(
        F.substring("content", 1, 17),
        number(size + 10, 8),
        number(size + 42, 8),
        number(F.col("tiles"), 4),
        F.substring(F.col("content"), F.lit(18), size + 32),
        F.unhex(F.lit("00020003")),
        F.substring("content", 100, 12),
        F.when(F.col("doc_id") % 2 == 1, F.unhex(F.lit("FFFFFFFF"))).otherwise(F.unhex(F.lit(""))),
    )
    return probes.find_map_layouts(docs.select("doc_id", planted.alias("content")), "content")


@query(
    "flt03_probe_with_reason",
    """SELECT CASE WHEN n_chars < 300 THEN 'too short' WHEN lang NOT IN ('en', 'de') THEN 'language'
                   WHEN octet_length(encode(text)) <> n_chars THEN 'not one byte each'
                   WHEN strpos(text, '.') = 0 THEN 'no sentence' ELSE 'ok' END AS reason, count(*) AS docs
       FROM documents GROUP BY 1""",
)
def probe_with_reason(t):
    rules = [
        ("too short", F.col("n_chars") >= 300),
        ("language", F.col("lang").isin("en", "de")),
        ("not one byte each", F.octet_length(F.encode("text", "UTF-8")) == F.col("n_chars")),
        ("no sentence", F.instr("text", ".") > 0),
    ]
    told = probes.probe_with_reason(t.documents, rules)
    return told.groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("docs"))


@query(
    "flt03_probe_map_header_all",
    """WITH h AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents), p AS (
         SELECT octet_length(b) AS size,
                CASE WHEN octet_length(b) >= 10 THEN ('0x' || hex(b[1:4]))::BIGINT END AS pal, CASE WHEN octet_length(b) >= 10 THEN ('0x' || hex(b[5:8]))::BIGINT END AS map,
                CASE WHEN octet_length(b) >= 10 THEN ('0x' || hex(b[9:9]))::BIGINT END AS psize, CASE WHEN octet_length(b) >= 10 THEN ('0x' || hex(b[10:10]))::BIGINT END AS tiles FROM h)
       SELECT CASE WHEN size < 10 THEN 'no header' WHEN map <= pal THEN 'map not behind palette'
                   WHEN psize NOT IN (32, 64, 96, 128) THEN 'invalid palette size'
                   WHEN pal - 10 < tiles * 32 * 0.1 OR pal - 10 > tiles * 32 THEN 'tile bytes do not fit' ELSE 'further' END AS reason,
              count(*) AS docs FROM p GROUP BY 1""",
)
def probe_map_header(t):
    """Every blob, those without a header too."""
    told = probes.probe_map_header(document_blobs(t), "content", F.lit(0))
    return told.groupBy("reason").agg(F.count("*").alias("docs"))


query("flt03_probe_map_header", ORACLES["flt03_probe_map_header_all"])(probe_map_header)


@query(
    "flt04_probe_content_valid_all",
    """WITH h AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents)
       SELECT doc_id FROM h WHERE coalesce(list_bool_and(list_transform(range(0, octet_length(b) // 2),
         lambda i: (('0x' || hex(b[2 * i + 1:2 * i + 2]))::INT & 2047) < 1910)), true)""",
)
def probe_content_valid(t):
    """Every blob; one of fewer than two bytes has no word that is wrong."""
    return probes.probe_content_valid(document_blobs(t), "doc_id", "content", 1910)


query("flt04_probe_content_valid", ORACLES["flt04_probe_content_valid_all"])(probe_content_valid)


@query(
    "flt05_probe_near",
    """WITH h AS (SELECT doc_id, encode(text) AS b FROM documents),
            m AS (SELECT doc_id, b, octet_length(b) AS n, octet_length(b) // 2 AS mid FROM h),
            o AS (SELECT doc_id, b, unnest(range(greatest(0, mid - 50), least(n - 1, mid + 50) + 1)) AS i FROM m)
       SELECT doc_id, i AS at FROM o WHERE b[i + 1:i + 1] = '.'::BLOB""",
)
def probe_near(t):
    middle = F.floor(F.octet_length("content") / 2).cast("int")
    dot = F.expr("substring(content, at + 1, 1) = X'2E'")
    return probes.probe_near(document_blobs(t), "content", middle, 50, dot)


def _encoding_sql() -> str:
    tests = [
        (at, f"hex(b[{at + 1}:{at + 1}]) BETWEEN '41' AND '5A' AND octet_length(b) > {at} AND regexp_matches(hex(b[{at + 2}:{at + 200}]), '^(..)*2E')")
        for at in (10, 12, 16, 20, 24, 32)
    ]
    chain = " ".join(f"WHEN {test} THEN {at}" for at, test in tests)
    return f"""WITH h AS (SELECT doc_id, encode(text) AS b FROM documents),
                    f AS (SELECT doc_id, CASE {chain} END AS hit FROM h)
               SELECT doc_id, hit IS NOT NULL AS found, coalesce(hit, 0)::BIGINT AS "offset" FROM f"""


@query("flt06_detect_encoding", _encoding_sql())
def detect_encoding(t):
    told = document_blobs(t).select("doc_id", probes.detect_encoding(F.col("content"), "[A-Z]", ".").alias("e"))
    return told.select("doc_id", "e.found", "e.offset")


@query(
    "flt07_first_offset_or_header",
    """SELECT doc_id, CASE WHEN regexp_matches(substr(text, 101), '[.!?]')
                THEN 100 + length(regexp_extract(substr(text, 101), '^[^.!?]*')) ELSE n_chars END::BIGINT AS stop
       FROM documents""",
)
def first_offset_or_header(t):
    stop = probes.first_offset_or_header(F.col("text"), "[.!?]", 100, F.col("n_chars"))
    return t.documents.select("doc_id", stop.cast("bigint").alias("stop"))


@query("flt08_filter_events", "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase' AND value > 0")
def filter_events(t):
    kept = probes.filter_events(t.events, "event_type", ["purchase"], F.col("value"))
    return kept.select("event_id", "user_id", "value")


@query("flt09_skip_short_patterns", "SELECT item_id FROM benchmark WHERE octet_length(encode(text)) >= 200")
def skip_short_patterns(t):
    patterns = bl.text_blobs(t.benchmark, "text", "pattern")
    return probes.skip_short_patterns(patterns, "pattern", 200).select("item_id")


@query(
    "flt10_slice_after_marker",
    """WITH r AS (SELECT page_id, CASE WHEN strpos(html, '<article>') > 0
                    THEN substr(html, strpos(html, '<article>') + 9) END AS rest FROM pages)
       SELECT page_id, length(rest)::BIGINT AS length, md5(rest) AS digest FROM r""",
)
def slice_after_marker(t):
    rest = t.pages.select("page_id", tx.slice_after("html", "<article>").alias("rest"))
    return rest.select("page_id", F.length("rest").alias("length"), F.md5(F.encode("rest", "UTF-8")).alias("digest"))


@query(
    "flt11_slice_between_markers",
    """WITH r AS (SELECT page_id, substr(html, strpos(html, '<h1>') + 4) AS rest FROM pages)
       SELECT page_id, substr(rest, 1, strpos(rest, '</h1>') - 1) AS title FROM r""",
)
def slice_between_markers(t):
    return t.pages.select("page_id", tx.slice_between("html", "<h1>", "</h1>").alias("title"))
