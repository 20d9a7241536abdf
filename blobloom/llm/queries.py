"""One query per operator over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, decontaminate, fingerprints, lm, media, packing, simhash, substrings, tokenfiles, toxicity, urls, variants

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_winnowing(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, folder, "documents"))


@query
def op2_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack_documents(table(spark, folder, "documents"), path, capacity=1024)


@query
def op3_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"), simhash.exact_plan(shingle=3, distance=3))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


@query
def op4_media_columns(spark: SparkSession, folder: str) -> DataFrame:
    return media.media_columns(table(spark, folder, "documents"))


# The rules that label URLs.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


@query
def op5_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(table(spark, folder, "pages"), RULES)


@query
def op6_bpe_encode_decode(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


# The same in SQL: a window is its 13 words in one string.
ORACLES["op7_substring_dedup"] = r"""
WITH split AS (
    SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents
), places AS (
    SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS place FROM split WHERE len(words) >= 13
), windows AS (
    SELECT doc_id, place, array_to_string(words[place : place + 12], ' ') AS w FROM places
), firsts AS (
    SELECT w, min(doc_id) AS least FROM windows GROUP BY w
), gone AS (
    SELECT doc_id, list(DISTINCT place + k) AS spots
    FROM windows JOIN firsts USING (w), range(0, 13) AS steps(k)
    WHERE least < doc_id GROUP BY doc_id
), kept AS (
    SELECT doc_id, len(words) AS n_words, coalesce(len(spots), 0) AS n_removed,
        CASE WHEN spots IS NULL THEN words ELSE list_select(words, list_filter(range(1, len(words) + 1), lambda i: NOT list_contains(spots, i))) END AS rest
    FROM split LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, n_words, n_removed, sha256(array_to_string(rest, ' ')) AS kept_sha256 FROM kept
"""


@query
def op7_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.without_repeats(table(spark, folder, "documents"), window=13, digests=True)


@query
def op8_separator_scan(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return tokenfiles.count_document_tokens(table(spark, folder, "documents"), path)


@query
def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op10_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    return lm.score_documents(table(spark, folder, "documents"))


LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format

# crc32 by its rule: 256 remainders of eight halving steps, then one look-up per byte of UTF-8.
ORACLES["op11_spelling_variants"] = f"""
WITH crc AS (
    SELECT list_transform(range(0, 256), lambda i: list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t
), runs AS (
    SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents
), told AS (
    SELECT doc_id, {LOWER("run")} AS run, count(*) AS n FROM runs GROUP BY ALL
), hashed AS (
    SELECT run, n, xor(list_reduce(
        flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
            lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + (unicode(c) >> 6)::BIGINT, 128 + (unicode(c) & 63)::BIGINT] END)),
        lambda h, b: xor(h >> 8, t[(xor(h, b) & 255) + 1]), 4294967295), 4294967295) AS h
    FROM told, crc WHERE length(run) >= 7
), counted AS (
    SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(n)::BIGINT AS n
    FROM hashed GROUP BY 1
), words AS (
    SELECT word, n FROM counted WHERE length(word) >= 7 AND n >= 2
), places AS (
    SELECT word, n, unnest(range(0, length(word))) AS i FROM words
), parts AS (
    SELECT word, n, substr(word, 1, i) AS a, substr(word, i + 2) AS b FROM places
), near AS (
    SELECT x.word, y.word AS other, y.n FROM parts x JOIN parts y ON x.a = y.a AND x.b = y.b WHERE x.word <> y.word
    UNION SELECT x.word, y.word, y.n FROM parts x JOIN words y ON y.word = x.a || x.b
    UNION SELECT y.word, x.word, x.n FROM parts x JOIN words y ON y.word = x.a || x.b
), best AS (
    SELECT word, count(*) AS n_near, max(n) AS m FROM near GROUP BY word
), formed AS (
    SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near,
        CASE WHEN b.m >= 10 * w.n THEN (SELECT min(other) FROM near x WHERE x.word = w.word AND x.n = b.m) END AS form,
        CASE WHEN b.m >= 10 * w.n THEN b.m END AS form_n
    FROM words w LEFT JOIN best b USING (word)
), walk AS (
    WITH RECURSIVE r AS (
        SELECT word, word AS here, 0 AS steps FROM formed
        UNION ALL SELECT r.word, f.form, r.steps + 1 FROM r JOIN formed f ON f.word = r.here WHERE f.form IS NOT NULL
    ) SELECT word, arg_max(here, steps) AS root FROM r GROUP BY word
)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN walk USING (word)
"""


@query
def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return variants.spelling_variants(table(spark, folder, "documents"))


# Phrases are words joined by one blank; every count is by language.
ORACLES["op12_phrase_collocations"] = rf"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWER("text")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), split AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces
), grams AS (
    SELECT lang, m, array_to_string(words[i : i + m - 1], ' ') AS p FROM (
        SELECT lang, words, m, unnest(range(1, len(words) - m + 2)) AS i FROM split, range(1, 5) AS sizes(m) WHERE len(words) >= m)
), counts AS MATERIALIZED (
    SELECT lang, m, p, count(*) AS f FROM grams GROUP BY ALL
), totals AS (
    SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE m = 1 GROUP BY lang
), candidates AS MATERIALIZED (
    SELECT lang, p, m, string_split(p, ' ') AS w, f AS a FROM counts WHERE m > 1 AND f >= 30
), parts AS MATERIALIZED (
    SELECT lang, p, a, k, array_to_string(w[1 : k], ' ') AS head, array_to_string(w[k + 1 :], ' ') AS tail
    FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates)
), cuts AS (
    SELECT c.lang, c.p, a, k, h.f AS l, t.f AS r, (2000000::HUGEINT * a // (h.f + t.f))::BIGINT AS score
    FROM parts c JOIN counts h ON h.lang = c.lang AND h.p = c.head JOIN counts t ON t.lang = c.lang AND t.p = c.tail
), lowest AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1
), inner_ AS (
    SELECT lang, array_to_string(w[i : i + size - 1], ' ') AS p, a FROM (
        SELECT lang, w, a, size, unnest(range(1, m - size + 2)) AS i FROM candidates, range(2, 4) AS sizes(size) WHERE size < m)
), around AS (
    SELECT lang, p, max(a) AS more FROM inner_ GROUP BY ALL
), ranked AS (
    SELECT lang, p AS phrase, a, l, r, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank
    FROM lowest LEFT JOIN around USING (lang, p) WHERE more IS NULL OR 100::HUGEINT * more < 80::HUGEINT * a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


@query
def op12_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


# The same in SQL: a window is its words in one string.
ORACLES["op13_fm_index_decontamination"] = rf"""
WITH d AS (
    SELECT doc_id, coalesce(regexp_extract_all({LOWER("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words FROM documents
), b AS (
    SELECT item_id, regexp_extract_all({LOWER("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), w AS (
    SELECT item_id, words, least(len(words), 10) AS size, unnest(range(1, greatest(len(words) - 8, 2))) AS place FROM b WHERE len(words) > 0
), windows AS (
    SELECT DISTINCT item_id, size, array_to_string(words[place : place + size - 1], ' ') AS w FROM w
), places AS (
    SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS place FROM d, (SELECT DISTINCT size FROM windows) WHERE len(words) >= size
), hits AS (
    SELECT doc_id, place, p.size, item_id FROM (SELECT doc_id, place, size, array_to_string(words[place : place + size - 1], ' ') AS w FROM places) p
    JOIN windows USING (w)
), marked AS (
    SELECT doc_id, count(DISTINCT place + k) AS n_hit FROM hits, range(0, 10) AS steps(k) WHERE k < size GROUP BY doc_id
), items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS listed FROM (SELECT DISTINCT doc_id, coalesce(item_id::VARCHAR, '') AS item_id FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marked USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query
def op13_fm_index_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.digests(decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"), window=10))
