"""The registered queries of the training-data operators, each over its whole tables, and their SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtide.llm import (decontaminate, html_text, jaccard_join, license_scan, mixing, packing, pii, prefix_trie, quality,
                          token_links, topk, url_filter, warc)
from flowtide.llm.common import numbered, scratch_path, table

PII_KEY = "surrogate-key-1"
#: (verdict, host, path) of the URL rules.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def byte_vocabulary() -> tuple[str, str, dict[str, int]]:
    """Ranks, pattern and added tokens of the byte-level vocabulary."""
    import public_tokenizers
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as full:
        added = {t["content"]: t["id"] for t in json.load(full)["added_tokens"]}
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), *byte_vocabulary())


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.rules_frame(spark, URL_RULES))


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    described = quality.describe(table(spark, sf_dir, "documents"))
    return quality.scores(described, quality.fit(described, table(spark, sf_dir, "labels")))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    return decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).drop("rid")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = numbered(table(spark, sf_dir, "documents").select("doc_id", "text"), "join-documents")
    return jaccard_join.near_duplicates(rows.select("rid", "row.doc_id", "row.text")).select("doc_id", "class_id", "n_links")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder).drop("payload")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii.pseudonymized(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    return done.select("doc_id", "text", "n_entities")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.rebuilt(table(spark, sf_dir, "conversations")))


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs, carry=["doc_id"]).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocabularies
    return token_links.align(table(spark, sf_dir, "documents"), vocabularies.path("byte_bpe_50k.tiktoken"), vocabularies.PATTERN,
                             vocabularies.path("piece_bpe_32k.model"))


OP2_SQL = r"""
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END r FROM pages),
p AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
             regexp_extract(r, '^[^/?#]*([^?#]*)', 1) path FROM a),
m AS (SELECT *, CASE WHEN ('.' || host) LIKE '%.example.org' AND path LIKE '/en/1%' THEN 'example.org/en/1'
                     WHEN ('.' || host) LIKE '%.example.org' AND path LIKE '/es/%' THEN 'example.org/es/'
                     WHEN ('.' || host) LIKE '%.org' AND path LIKE '/%' THEN 'org/'
                     WHEN ('.' || host) LIKE '%.com' AND path LIKE '/fr/%' THEN 'com/fr/'
                     WHEN ('.' || host) LIKE '%.com' AND path LIKE '/de/%' THEN 'com/de/' END rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END verdict FROM m
"""

OP4_SQL = """
WITH e AS MATERIALIZED (SELECT row_number() OVER () n, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) v FROM embeddings
           WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.n, q.vec_id query_id, c.vec_id vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) score
      FROM e q JOIN e c ON q.n <> c.n WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS "rank", vec_id, score FROM s)
SELECT * FROM r WHERE "rank" <= 10
"""

OP8_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) b, sha256(coalesce(html, '')) d FROM pages),
f AS (SELECT *, octet_length(b) n, min(page_id) OVER (PARTITION BY d) m FROM p)
SELECT page_id, CAST(n AS BIGINT) payload_bytes, d payload_digest, CASE WHEN n >= 100 AND m <> page_id THEN 'revisit' ELSE 'response' END record_type,
       CASE WHEN n >= 100 AND m <> page_id THEN m END refers_to FROM f
"""

OP6_SQL = r"""
WITH d AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'),
               lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) w FROM documents),
b AS (SELECT item_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'),
               lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) n, array_to_string(w[s:s + 9], ' ') k
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') k
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) s FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, s, n FROM dw JOIN bw USING (n, k)),
words AS (SELECT doc_id, count(DISTINCT p) h FROM (SELECT doc_id, unnest(range(s, s + n)) p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) c, string_agg(i, ',' ORDER BY i) l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(h, 0) AS BIGINT) n_hit, CAST(coalesce(c, 0) AS BIGINT) n_items,
       sha256(coalesce(l, '')) items_sha256, coalesce(h, 0) > 0 contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP11_SQL = r"""
WITH t AS (SELECT conv_id, CAST(turn AS BIGINT) turn, CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '') x,
                  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) w FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT conv_id, list({'k': substr(sha256(x), 1, 32), 'w': w} ORDER BY turn NULLS FIRST, substr(sha256(x), 1, 32), w) own FROM t GROUP BY conv_id),
h AS (SELECT conv_id, conv_id - conv_id % 20 base, own, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
             lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda u, z: xor(u >> 1, 3988292384 * (u & 1)))), 4294967295) % 4 h FROM k),
r AS (SELECT h.conv_id, list_concat(coalesce(b.own, [])[1:h.h], h.own[h.h + 1:]) turns FROM h LEFT JOIN k b ON b.conv_id = h.base),
p AS (SELECT conv_id, unnest(range(0, len(turns) + 1)) depth, turns FROM r),
m AS (SELECT conv_id, depth, len(turns) = depth ending, array_to_string(list_transform(turns[1:depth], lambda q: q.k), '') path,
             array_to_string(list_transform(turns[1:depth - 1], lambda q: q.k), '') up, coalesce(turns[depth].w, 0) w FROM p),
n AS (SELECT path, depth, min(up) up, min(conv_id) conv_id, count(*) n_convs, min(w) * (count(*) - 1) saved,
             sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ending), '')) ends_sha256 FROM m GROUP BY path, depth),
c AS (SELECT up, depth - 1 depth, count(*) n_children FROM n WHERE depth > 0 GROUP BY ALL),
f AS (SELECT n.*, coalesce(n_children, 0) n_children FROM n LEFT JOIN c ON c.up = n.path AND c.depth = n.depth),
s AS (SELECT a.path, count(*) FILTER (d.n_children = 0) n_leaves, sum(d.saved) saved_tokens FROM f a JOIN f d ON d.depth >= a.depth AND starts_with(d.path, a.path) GROUP BY a.path)
SELECT f.conv_id, CAST(f.depth AS BIGINT) "depth", u.conv_id parent_conv_id, f.n_convs, CAST(f.n_children AS BIGINT) n_children, s.n_leaves,
       CAST(s.saved_tokens AS BIGINT) saved_tokens, f.ends_sha256
FROM f JOIN s ON s.path = f.path LEFT JOIN f u ON f.depth > 0 AND u.path = f.up AND u.depth = f.depth - 1
"""

#: Targets by sources in order of their cap; then the three fills, each as a running total in order of place.
OP12_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) size,
                  CAST('0x' || substr(sha256(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 15) AS BIGINT) place FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) source_size, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) weight FROM d GROUP BY source),
c AS (SELECT *, (SELECT sum(source_size) FROM s) whole, row_number() OVER (ORDER BY 3 * source_size / weight, weight) i,
             coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, weight ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) cut,
             sum(weight) OVER (ORDER BY 3 * source_size / weight DESC, weight DESC ROWS UNBOUNDED PRECEDING) free FROM s),
l AS (SELECT CAST(whole - cut AS DOUBLE) / free rate FROM c WHERE 3 * source_size > CAST(whole - cut AS DOUBLE) / free * weight ORDER BY i LIMIT 1),
t AS (SELECT source, source_size, coalesce(least(CAST(3 * source_size AS DOUBLE), (SELECT rate FROM l) * weight), CAST(3 * source_size AS DOUBLE)) target FROM s),
g AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END copies FROM t),
r0 AS (SELECT d.*, source_size, target, copies, target - copies * source_size gap0 FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
u0 AS (SELECT *, CASE WHEN size > 0 THEN CAST(sum(size) OVER (PARTITION BY source, size > 0 ORDER BY place) AS BIGINT) END upto0 FROM r0),
r1 AS (SELECT *, gap0 - coalesce(max(upto0) FILTER (upto0 <= gap0) OVER (PARTITION BY source), 0) gap1 FROM u0),
u1 AS (SELECT *, CASE WHEN size > 0 AND size <= gap1 AND upto0 > gap0 THEN CAST(sum(size) OVER (PARTITION BY source, size > 0 AND size <= gap1 AND upto0 > gap0 ORDER BY place) AS BIGINT) END upto1 FROM r1),
r2 AS (SELECT *, gap1 - coalesce(max(upto1) FILTER (upto1 <= gap1) OVER (PARTITION BY source), 0) gap2 FROM u1),
u2 AS (SELECT *, CASE WHEN size > 0 AND size <= gap2 AND upto0 > gap0 AND coalesce(upto1 > gap1, true) THEN CAST(sum(size) OVER (PARTITION BY source, size > 0 AND size <= gap2 AND upto0 > gap0 AND coalesce(upto1 > gap1, true) ORDER BY place) AS BIGINT) END upto2 FROM r2),
r3 AS (SELECT *, gap2 - coalesce(max(upto2) FILTER (upto2 <= gap2) OVER (PARTITION BY source), 0) gap3,
              CASE WHEN upto0 = min(upto0) FILTER (upto0 > gap0) OVER (PARTITION BY source) THEN 0
                   WHEN upto1 = min(upto1) FILTER (upto1 > gap1) OVER (PARTITION BY source) THEN 1
                   WHEN upto2 = min(upto2) FILTER (upto2 > gap2) OVER (PARTITION BY source) THEN 2 END edge FROM u2),
e AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN edge IS NULL THEN 1 ELSE 0 END, abs(gap3 - size), edge) closing FROM r3)
SELECT doc_id, size, source_size, target, CASE WHEN size = 0 THEN 0 ELSE size * (copies + CASE WHEN upto0 <= gap0 OR coalesce(upto1 <= gap1, false) OR coalesce(upto2 <= gap2, false)
       OR (edge IS NOT NULL AND closing = 1 AND abs(gap3 - size) < gap3) THEN 1 ELSE 0 END) END taken FROM e
"""

#: name -> (query, SQL or None)
ENTRIES = {
    "op1_packing": (op1_packing, None),
    "op2_url_filters": (op2_url_filters, OP2_SQL),
    "op3_license_scans": (op3_license_scans, None),
    "op4_topk_search": (op4_topk_search, OP4_SQL),
    "op5_quality_classifier": (op5_quality_classifier, None),
    "op6_decontamination": (op6_decontamination, OP6_SQL),
    "op7_jaccard_join": (op7_jaccard_join, None),
    "op8_warc": (op8_warc, OP8_SQL),
    "op9_pii": (op9_pii, None),
    "op10_html_extraction": (op10_html_extraction, None),
    "op11_prefix_trie": (op11_prefix_trie, OP11_SQL),
    "op12_source_mixing": (op12_source_mixing, OP12_SQL),
    "op13_token_alignment": (op13_token_alignment, None),
}
