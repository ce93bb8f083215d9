"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from ..session import ready
from . import bpe, decontaminate, neardup, periodic, prefix_trie, quality, secrets, set_join, shards, token_counts, topk, toxicity, warc
from .common import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: The unsigned checksum of a text ``s`` of digits.
CRC32 = """xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(range(1, length(s) + 1), lambda i: ascii(substr(s, i, 1))::UBIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, k: xor(v >> 1, 3988292384::UBIGINT * (v & 1)))), 4294967295::UBIGINT)"""


def register(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = lambda spark, sf_dir: build(ready(spark), sf_dir)
        if sql:
            ORACLE_SQL[name] = sql
        return build
    return add


@register("op1_exact_topk", """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT DISTINCT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integers(table(spark, sf_dir, "embeddings"))
    return topk.search(vectors, vectors.where(F.col("id") % 50 == 0), k=5)


@register("op2_extendible_shards", f"""
WITH h AS (SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) * {1 << 28}
    + CAST('0x' || substr(md5(coalesce(text, '')), 1, 7) AS BIGINT) AS bits FROM documents),
p AS (SELECT depth, bits >> ({shards.BITS} - depth) AS prefix, sum(n_bytes) AS bytes
      FROM h, (SELECT CAST(unnest(range(0, {shards.BITS} + 1)) AS BIGINT) AS depth) GROUP BY 1, 2),
leaf AS (SELECT h.doc_id, h.n_bytes, h.bits, min(p.depth) AS depth
         FROM h JOIN p ON p.prefix = h.bits >> ({shards.BITS} - p.depth) AND (p.bytes <= {shards.LIMIT} OR p.depth = {shards.BITS}) GROUP BY ALL)
SELECT leaf.doc_id, leaf.n_bytes, CASE WHEN leaf.depth = 0 THEN '' ELSE substr(lpad(bin(leaf.bits), {shards.BITS}, '0'), 1, CAST(leaf.depth AS INTEGER)) END AS shard,
    CAST(leaf.depth AS INTEGER) AS depth, CAST(p.bytes AS BIGINT) AS shard_bytes, p.bytes <= {shards.LIMIT} AS fits
FROM leaf JOIN p ON p.depth = leaf.depth AND p.prefix = leaf.bits >> ({shards.BITS} - leaf.depth)""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_bytes", "shard", "depth", "shard_bytes", "fits")


@register("op3_quality_discriminant")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op4_weighted_minhash")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "class_id")


@register("op5_benchmark_decontamination", r"""
WITH dw AS (SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), 'null') AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item, list_slice(w, i, i + 9) AS win FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(win) AS n FROM iw),
ow AS (SELECT rid, i, n, list_slice(w, i, i + n - 1) AS win FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
met AS (SELECT rid, i, n, item FROM ow JOIN iw USING (win)),
hit AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS pos FROM met) GROUP BY rid),
its AS (SELECT rid, list_sort(list(DISTINCT item)) AS items FROM met GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
    sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid)""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.scan(docs, table(spark, sf_dir, "benchmark")))


@register("op6_warc_normaliser", """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN f.first IS NULL OR f.first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN f.first IS DISTINCT FROM page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register("op7_token_counts")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count(docs, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


@register("op8_toxic_sentences")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), locate=toxicity.THRESHOLD)


@register("op9_bpe_round_trip")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@register("op10_secret_scan")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.digest(secrets.find(docs))


@register("op11_shingle_set_join", r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT rid, w[i:i + 3] AS x FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS (SELECT a.rid AS a, b.rid AS b, count(*) AS o FROM s a JOIN s b ON a.x = b.x AND a.rid <> b.rid GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
reach AS (SELECT rid AS a, rid AS b FROM d UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b),
c AS (SELECT a AS rid, min(doc_id) AS component_id FROM reach JOIN d ON d.rid = b GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM d LEFT JOIN n USING (rid) LEFT JOIN c USING (rid)""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.join(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@register("op12_prefix_trie", rf"""
WITH t AS (SELECT conv_id, turn, concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')) AS x,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, CAST(conv_id AS VARCHAR) AS s, list(md5(x) ORDER BY turn NULLS FIRST, md5(x)) AS x, list(words ORDER BY turn NULLS FIRST, md5(x)) AS w FROM t GROUP BY conv_id),
h AS (SELECT *, CAST({CRC32} % 4 AS BIGINT) AS h FROM l),
r AS (SELECT c.conv_id, list_concat(coalesce(b.x, [])[:c.h], c.x[c.h + 1:]) AS x, list_concat(coalesce(b.w, [])[:c.h], c.w[c.h + 1:]) AS w
      FROM h c LEFT JOIN h b ON b.conv_id = c.conv_id - c.conv_id % 20),
m AS (SELECT conv_id, x, d, CASE WHEN d = 0 THEN 0 ELSE w[d] END AS words, x[:d] AS prefix, len(x) = d AS ends FROM (SELECT *, unnest(range(0, len(x) + 1)) AS d FROM r)),
n AS (SELECT prefix, d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(words) AS saved,
      sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY prefix, d),
k AS (SELECT prefix[:d - 1] AS prefix, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
o AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (prefix)),
u AS (SELECT prefix[:a] AS prefix, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM o) GROUP BY 1)
SELECT o.conv_id, o.d AS depth, p.conv_id AS parent_conv_id, o.n_convs, o.n_children, u.n_leaves, CAST(u.saved_tokens AS BIGINT) AS saved_tokens, o.ends_sha256
FROM o JOIN u USING (prefix) LEFT JOIN n p ON o.d > 0 AND p.prefix = o.prefix[:o.d - 1]""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.nodes(prefix_trie.rebuilt(prefix_trie.turn_lists(table(spark, sf_dir, "conversations"))))


@register("op13_periodic_runs", rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS s, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w0 FROM documents),
h AS (SELECT *, CAST({CRC32} AS BIGINT) AS h, len(w0) AS n FROM d),
a AS (SELECT *, h // 10 AS g, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a FROM h),
w AS (SELECT rid, doc_id, n, CASE WHEN a IS NULL THEN w0 ELSE list_transform(range(0, n), lambda i: w0[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) END AS w FROM a),
word AS (SELECT rid, n, unnest(w) AS x, unnest(range(0, n)) AS i FROM w),
same AS (SELECT p.rid, q.i - p.i AS q, p.i FROM word p JOIN word q ON p.rid = q.rid AND p.x = q.x AND q.i > p.i AND q.i - p.i <= p.n // 4),
run AS (SELECT rid, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM same) GROUP BY rid, q, island
        HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT rid, start, length, min(q) AS period FROM run GROUP BY ALL),
best AS (SELECT rid, count(*) AS n_runs, arg_min(struct_pack(start, length, period), [-length, start, period]) AS b,
         string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines FROM runs GROUP BY rid),
gone AS (SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT rid, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(b.start AS BIGINT) AS start, CAST(b.length AS BIGINT) AS length, CAST(b.period AS BIGINT) AS period,
    CAST(1000 * b.length // b.period AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM w LEFT JOIN best USING (rid) LEFT JOIN kept USING (rid)""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return periodic.digest(periodic.runs(periodic.with_planted(docs)))


@register("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
