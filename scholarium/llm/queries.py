"""The corpus operators as queries over the given tables, and what SQL can say about them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarium.llm.decontaminate import contamination
from scholarium.llm.frames import table
from scholarium.llm.html_text import extract
from scholarium.llm.jaccard import similar_documents
from scholarium.llm.licenses import TEMPLATES, scan, templates
from scholarium.llm.mixing import replicate
from scholarium.llm.neighbours import search
from scholarium.llm.pii import KINDS, as_text, find_spans
from scholarium.llm.quality import score_documents
from scholarium.llm.ranked import search as ranked_search
from scholarium.llm.revisits import crawl_records, resolve_revisits
from scholarium.llm.substrings import remove_repeats
from scholarium.llm.suffix_tree import score_texts
from scholarium.llm.trie import prefix_trie


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), templates(spark))


def op3_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources alike; the rows are the training copies themselves."""
    return replicate(table(spark, sf_dir, "documents")).select("doc_id", "copy", "source", "lang", "n_chars", "text", "shuffle_key")


def op6_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _of_kind(kind: int):
    return lambda span: span["kind"] == kind


def op10_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(as_text("base"), 256).alias("base_sha256"), as_text("spans").alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"), F.size("spans").cast("long").alias("n_spans"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"), k=4, part=85, whole=100)


def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve_revisits(crawl_records(table(spark, sf_dir, "pages")))
    lines = F.transform("headers", lambda e: F.concat(e["name"], F.lit(": "), e["value"]))
    return found.select("record_id", "url_key", F.unix_seconds("at").alias("at"), "outcome", "response_id", F.array_join(lines, "\n").alias("headers"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op12_nra_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_license_scan": op2_license_scan,
    "op3_poisson_mixing": op3_poisson_mixing,
    "op4_html_extraction": op4_html_extraction,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_learned_partitions": op6_learned_partitions,
    "op7_quality_rules": op7_quality_rules,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_warc_revisits": op9_warc_revisits,
    "op10_pii_boosting": op10_pii_boosting,
    "op11_suffix_tree": op11_suffix_tree,
    "op12_nra_search": op12_nra_search,
    "op13_prefix_trie": op13_prefix_trie,
}

_WORDS10 = r"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
items AS (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM (SELECT item_id, coalesce(text, '') AS text FROM benchmark)),
spans AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS span
    FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0)),
starts AS (
    SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS span
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, (SELECT DISTINCT n FROM spans))),
hits AS (SELECT doc_id, i, n, item_id FROM starts JOIN spans USING (n, span)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

_REPEATS = r"""
WITH bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
grams AS (SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS g FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 49)) AS i FROM bytes WHERE len(x) >= 100)),
hits AS (SELECT doc_id, i FROM grams JOIN (SELECT g, min(doc_id) AS lo FROM grams GROUP BY g HAVING count(*) > 1) USING (g) WHERE doc_id > lo),
edges AS (SELECT doc_id, i, max(i + 50) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM hits),
runs AS (SELECT doc_id, i, i + 50 AS e, sum(CASE WHEN before >= i THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM edges),
spans AS (SELECT doc_id, run, min(i) AS a, max(e) AS b FROM runs GROUP BY doc_id, run),
pieces AS (
    SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS from_, row_number() OVER (PARTITION BY doc_id ORDER BY a DESC) AS back FROM spans),
kept AS (
    SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed,
           string_agg(substr(x, 2 * from_ + 1, 2 * (a - from_)), '' ORDER BY a) || max(CASE WHEN back = 1 THEN substr(x, 2 * b + 1) END) AS k
    FROM pieces JOIN bytes USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(k, x))) AS kept_sha256
FROM bytes LEFT JOIN kept USING (doc_id)
"""

_LICENSES = r"""
WITH templates AS (SELECT * FROM (VALUES %s) AS t(license_id, text)),
grams AS (
    SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents) WHERE len(w) >= 5)),
wanted AS (
    SELECT DISTINCT license_id, array_to_string(w[i : i + 4], ' ') AS g
    FROM (SELECT license_id, w, unnest(range(1, len(w) - 3)) AS i FROM (SELECT license_id, regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM templates) WHERE len(w) >= 5)),
sizes AS (SELECT license_id, count(*) AS n_shingles FROM wanted GROUP BY license_id)
SELECT doc_id, license_id, n_shingles, count(*) AS n_found, count(*) / n_shingles AS containment
FROM grams JOIN wanted USING (g) JOIN sizes USING (license_id) GROUP BY doc_id, license_id, n_shingles HAVING count(*) / n_shingles >= 0.8
""" % ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in TEMPLATES)

_MIXING = r"""
WITH sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (SELECT source, (SELECT sum(n) FROM sizes) * 1.0::DOUBLE / (SELECT count(*)::DOUBLE FROM sizes) / n AS rate FROM sizes),
pieces AS (SELECT source, greatest(1, ceil(rate / 16.0))::INT AS pieces, rate / greatest(1, ceil(rate / 16.0)) AS mean FROM rates),
terms AS (SELECT k, sum(CASE WHEN k > 1 THEN ln(k::DOUBLE) ELSE 0 END) OVER (ORDER BY k) AS log_factorial FROM range(0, 101) AS t(k)),
tables AS (SELECT source, k, sum(exp(k * ln(mean) - mean - log_factorial)) OVER (PARTITION BY source ORDER BY k) AS below FROM pieces, terms),
pulls AS (
    SELECT doc_id, source, unnest(range(1, pieces + 1)) AS j FROM documents JOIN pieces USING (source)),
uniform AS (SELECT doc_id, source, j, ('0x' || substr(md5('17:' || doc_id || ':' || j), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM pulls),
drawn AS (SELECT doc_id, count(k) AS c FROM uniform LEFT JOIN tables ON uniform.source = tables.source AND below <= u GROUP BY doc_id)
SELECT doc_id, copy::INT AS copy, source, lang, n_chars, text, md5('17:order:' || doc_id || ':' || copy) AS shuffle_key
FROM (SELECT d.*, unnest(range(1, c + 1)) AS copy FROM documents d JOIN drawn USING (doc_id))
"""

_REVISITS = r"""
WITH pages_ AS (
    SELECT page_id, md5(coalesce(html, '')) AS digest, 1700000000 + page_id * 60 AS fetched,
           regexp_replace(lower(regexp_extract(url, '^(?i:https?)://([^/?]+)', 1)), '^([^@]*@)?(www\.)?|:(80|443)$', '', 'g') AS host,
           regexp_replace(regexp_extract(url, '^\w+://[^/?]+([^?]*)', 1), '/+$', '') AS path,
           list_sort(list_filter(string_split(regexp_extract(url, '\?(.*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))) AS query
    FROM (SELECT page_id, html, regexp_extract(url, '^\s*([^#\s]*)', 1) AS url FROM pages)),
keyed AS (SELECT *, CASE WHEN host <> '' THEN host || path || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END END AS url_key FROM pages_),
responses AS (SELECT page_id AS record_id, url_key, fetched AS seen, '"' || digest || '"' AS etag, strftime(make_timestamp((fetched - 3600) * 1000000), '%Y-%m-%d %H:%M:%S') AS modified FROM keyed),
checked AS (SELECT *, ('0x' || substr(md5(page_id::VARCHAR), 1, 5))::BIGINT AS h FROM keyed),
revisits AS (
    SELECT page_id + 1099511627776 AS record_id, url_key, CASE WHEN h % 13 = 0 THEN fetched - 1800 ELSE fetched + 60 * (1 + h % 5000) END AS seen,
           CASE WHEN h % 5 = 0 THEN NULL WHEN h % 11 = 0 THEN '"other"' WHEN h % 7 = 0 THEN 'W/"' || digest || '"' ELSE '"' || digest || '"' END AS etag,
           strftime(make_timestamp((fetched - 3600) * 1000000), '%Y-%m-%d %H:%M:%S') AS modified
    FROM checked),
found AS (SELECT r.*, f.record_id AS f_id, f.etag AS f_etag, f.modified AS f_modified FROM revisits r LEFT JOIN LATERAL (
    SELECT * FROM responses f WHERE f.url_key = r.url_key AND f.seen < r.seen ORDER BY f.seen DESC, f.record_id DESC LIMIT 1) f ON true),
judged AS (SELECT *, CASE WHEN f_id IS NULL THEN 'missing' WHEN etag IS NOT NULL THEN CASE WHEN replace(etag, 'W/', '') = f_etag THEN 'resolved' ELSE 'mismatch' END
           WHEN modified = f_modified THEN 'resolved' ELSE 'mismatch' END AS outcome FROM found)
SELECT record_id, url_key, seen AS at, outcome, CASE WHEN outcome = 'resolved' THEN f_id END AS response_id,
       CASE WHEN outcome = 'resolved' THEN 'content-type: text/html' || chr(10) || 'date: ' || strftime(make_timestamp(seen * 1000000), '%Y-%m-%d %H:%M:%S') || chr(10) || 'etag: ' || coalesce(etag, f_etag) || chr(10) || 'last-modified: ' || modified END AS headers
FROM judged
"""

_JACCARD = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
    SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 4) - 1], ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 4) + 2)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(node, other) AS (SELECT a, b FROM edges UNION SELECT reach.node, edges.b FROM reach JOIN edges ON edges.a = reach.other)
SELECT words.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(words.doc_id, coalesce(lo, words.doc_id)) AS component_id
FROM words LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT node AS doc_id, min(other) AS lo FROM reach GROUP BY node) USING (doc_id)
"""

_RANKED = r"""
WITH words AS (
    SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
    FROM documents WHERE text IS NOT NULL),
totals AS (SELECT count(*)::BIGINT AS docs, sum(len(w))::BIGINT AS terms FROM words WHERE len(w) > 0),
postings AS (SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM words) GROUP BY r, doc_id, n, term),
wanted AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark WHERE text IS NOT NULL),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*)::BIGINT AS df FROM postings GROUP BY term), totals),
scores AS (
    SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::BIGINT AS score
    FROM wanted JOIN postings USING (term) JOIN weights USING (term), totals GROUP BY item_id, r, doc_id)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r) AS rank FROM scores WHERE score > 0) WHERE rank <= 10
"""

_TRIE = r"""
WITH turns AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(r) || ':' || r || t)) AS i, {'role': r, 'text': t} AS said
    FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL)),
convs AS (
    SELECT c, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
           lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) % 4 AS h
    FROM (SELECT DISTINCT conv_id AS c FROM turns)),
parts AS (
    SELECT c, 0 AS part, i, said FROM convs JOIN turns ON conv_id = c - c % 20 AND i <= h
    UNION ALL SELECT c, 1, i, said FROM convs JOIN turns ON conv_id = c AND i > h),
seqs AS (SELECT c, coalesce(list(said ORDER BY part, i) FILTER (said IS NOT NULL), []) AS w FROM convs LEFT JOIN parts USING (c) GROUP BY c),
nodes AS (SELECT d, w[1:d] AS p, min(c) AS conv_id, count(*) AS n FROM (SELECT c, w, unnest(range(0, len(w) + 1)) AS d FROM seqs) GROUP BY d, w[1:d]),
counted AS (SELECT x.*, x.p[1:x.d - 1] AS up, (SELECT count(*) FROM nodes y WHERE y.d = x.d + 1 AND y.p[1:x.d] = x.p) AS n_children,
            CASE WHEN d = 0 THEN 0 ELSE (n - 1) * len(regexp_extract_all(p[d].text, '[^\x20\x09-\x0D]+')) END AS saved FROM nodes x),
under AS (SELECT k AS d, p[1:k] AS p, sum(saved) AS saved_tokens, sum((n_children = 0)::INT) AS n_leaves FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM counted) GROUP BY k, p[1:k]),
stops AS (SELECT w, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM seqs GROUP BY w)
SELECT x.conv_id, x.d::BIGINT AS depth, y.conv_id AS parent_conv_id, x.n AS n_convs, x.n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM counted x JOIN under USING (d, p) LEFT JOIN stops ON w = x.p LEFT JOIN nodes y ON y.d = x.d - 1 AND y.p = x.up
"""

ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": _WORDS10,
    "op2_license_scan": _LICENSES,
    "op3_poisson_mixing": _MIXING,
    "op5_suffix_dedup": _REPEATS,
    "op8_ngram_jaccard": _JACCARD,
    "op9_warc_revisits": _REVISITS,
    "op12_nra_search": _RANKED,
    "op13_prefix_trie": _TRIE,
}
