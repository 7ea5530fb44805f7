"""Named queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import read_table

RANKS = "byte_bpe_50k.tiktoken"


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import fingerprint_with_edits

    return fingerprint_with_edits(read_table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_rules

    return quality_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_documents

    return encode_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op6_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_pages

    return archive_pages(read_table(spark, sf_dir, "pages"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import secret_report

    return secret_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import substring_report

    return substring_report(read_table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic import run_report

    return run_report(read_table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import misspelt, spelling_variants

    return spelling_variants(read_table(spark, sf_dir, "documents"), misspelt)


def op13_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk_search import top_k

    rows = read_table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.where("vec_id % 50 = 0"), k=5)


QUERIES = {f.__name__: f for f in (
    op1_best_fit_packing, op2_fingerprints, op3_language_id, op4_quality_rules, op5_byte_bpe, op6_warc_normaliser,
    op7_secret_scan, op8_toxicity, op9_minhash_near_dup, op10_substring_dedup, op11_periodic_runs, op12_spelling_variants,
    op13_topk_search)}

_WORDS = r"list_filter(string_split_regex(coalesce({t}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

#: crc32 of a string in SQL, byte by byte; the table of 256 is made by its rule.
_CRC_TABLE = ("(SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: "
              "CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, i)) AS t)")
_CRC = ("xor(4294967295, list_reduce(list_transform(range(1, octet_length(encode({s})) + 1), lambda i: "
        "('0x' || substr(hex(encode({s})), 2 * i - 1, 2))::BIGINT), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295))")

ORACLE = {
    "op11_periodic_runs": f"""
WITH w0 AS (SELECT doc_id, {_WORDS.format(t="text")} AS w, {_CRC.format(s="doc_id::VARCHAR")} AS h FROM documents, {_CRC_TABLE}),
p0 AS (SELECT *, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS made, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM w0),
p1 AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM p0),
d AS MATERIALIZED (SELECT doc_id, n, CASE WHEN made THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM p1),
t AS MATERIALIZED (SELECT doc_id, n, unnest(w) AS x, unnest(range(n)) AS i FROM d),
m AS (SELECT l.doc_id, r.i - l.i AS q, l.i FROM t l JOIN t r ON l.doc_id = r.doc_id AND l.x = r.x AND r.i > l.i AND 4 * (r.i - l.i) <= l.n),
g AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM m),
s AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM g GROUP BY doc_id, q, g HAVING count(*) + q >= greatest(6, 4 * q)),
r AS MATERIALIZED (SELECT doc_id, start, length, min(q) AS period FROM s GROUP BY doc_id, start, length),
e AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
k AS (SELECT t.doc_id, string_agg(t.x, ' ' ORDER BY t.i) AS c FROM t ANTI JOIN e ON e.doc_id = t.doc_id AND e.i = t.i GROUP BY t.doc_id),
b AS (SELECT doc_id, count(*) AS n_runs, min(struct_pack(l := -length, s := start, p := period)) AS o,
  string_agg(start::VARCHAR || ',' || length::VARCHAR || ',' || period::VARCHAR || chr(10), '' ORDER BY start, period) AS x FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(b.n_runs, 0)::BIGINT AS n_runs, o.s::BIGINT AS start, -o.l::BIGINT AS length, o.p::BIGINT AS period,
  (1000 * -o.l // o.p)::BIGINT AS exponent_milli, sha256(coalesce(b.x, '')) AS runs_sha256, sha256(coalesce(k.c, '')) AS collapsed_sha256
FROM d LEFT JOIN b ON b.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id
""",
    "op12_spelling_variants": f"""
WITH RECURSIVE o AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[a-zÀ-ÿ]+')) AS w FROM documents),
u AS (SELECT doc_id, w, count(*) AS c FROM o GROUP BY doc_id, w),
h AS (SELECT w, c, {_CRC.format(s="coalesce(doc_id::VARCHAR, '') || ':' || w")} AS h FROM u, {_CRC_TABLE}),
v AS (SELECT CASE WHEN h % 97 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, c FROM h),
n AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n FROM v WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
x AS MATERIALIZED (SELECT word, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM n)),
p AS (SELECT a.word, b.word AS near FROM x a JOIN x b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT x.word, n.word FROM x JOIN n ON n.word = x.rest UNION SELECT n.word, x.word FROM x JOIN n ON n.word = x.rest),
f AS (SELECT p.word, count(*) AS n_near, min(struct_pack(m := -n.n, w := p.near)) AS best FROM p JOIN n ON n.word = p.near GROUP BY p.word),
j AS MATERIALIZED (SELECT n.word, n.n, coalesce(f.n_near, 0) AS n_near, CASE WHEN -f.best.m >= 2 * n.n THEN f.best.w END AS form,
  CASE WHEN -f.best.m >= 2 * n.n THEN -f.best.m END AS form_n FROM n LEFT JOIN f ON f.word = n.word),
r AS (SELECT word, word AS root FROM j UNION SELECT r.word, j.form FROM r JOIN j ON j.word = r.root WHERE j.form IS NOT NULL),
e AS (SELECT r.word, r.root FROM r JOIN j ON j.word = r.root WHERE j.form IS NULL)
SELECT j.word, j.n, j.n_near::BIGINT AS n_near, j.form, j.form_n::BIGINT AS form_n, e.root FROM j JOIN e ON e.word = j.word
""",
    "op13_topk_search": """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND list_count(embedding) = len(embedding)
  AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.r <> c.r),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, k::INTEGER AS rank, vec_id, score FROM k WHERE k <= 5
""",
    "op9_minhash_near_dup": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(t="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, unnest(s) AS h FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN s x ON x.doc_id = p.a JOIN s y ON y.doc_id = p.b
  WHERE 100 * p.c >= 75 * (len(x.s) + len(y.s) - p.c)),
r AS (SELECT doc_id AS n, doc_id AS c FROM s UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.n),
m AS (SELECT n, min(c) AS c FROM r GROUP BY n)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, m.c AS component_id, m.c = s.doc_id AS kept FROM s JOIN m ON m.n = s.doc_id
""",
    "op10_substring_dedup": f"""
WITH w AS (SELECT doc_id, {_WORDS.format(t="text")} AS w FROM documents),
x AS (SELECT doc_id, i, sha256(array_to_string(w[i:i+34], chr(31))) AS h FROM (
  SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM w WHERE len(w) >= 35)),
r AS (SELECT doc_id, i FROM x WHERE h IN (SELECT h FROM x GROUP BY h HAVING count(*) > 1)),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM r),
c AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
k AS (SELECT v.doc_id, string_agg(v.t, ' ' ORDER BY v.i) AS t FROM (
  SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS i FROM w) v
  ANTI JOIN g ON g.doc_id = v.doc_id AND g.i = v.i GROUP BY v.doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM w LEFT JOIN c ON c.doc_id = w.doc_id LEFT JOIN k ON k.doc_id = w.doc_id
""",
    "op6_warc_normaliser": """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, octet_length(encode(payload)) AS n, sha256(payload) AS digest FROM p),
f AS (SELECT digest, min(page_id) AS first_id, count(*) AS c FROM d WHERE n >= 100 GROUP BY digest)
SELECT d.page_id, d.n::BIGINT AS payload_bytes, d.digest AS payload_digest,
  CASE WHEN f.c > 1 AND d.page_id IS DISTINCT FROM f.first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.c > 1 AND d.page_id IS DISTINCT FROM f.first_id THEN f.first_id END AS refers_to
FROM d LEFT JOIN f USING (digest)
""",
}
