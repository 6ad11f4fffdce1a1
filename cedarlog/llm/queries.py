"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .clustering import cluster_vectors
from .common import table
from .decontaminate import contamination
from .embedding_dedup import near_vectors
from .html_extract import extract_main_text
from .lm_score import score_texts
from .minhash import near_duplicates
from .mixing import mix
from .packing import pack
from .secrets import scan_secrets
from .substring_dedup import remove_repeats
from .toxicity import fit_toxicity, score_toxicity
from .vector_codes import compress_vectors
from .warc import archive_pages


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans", "key")


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return score_toxicity(documents, fit_toxicity(documents, table(spark, sf_dir, "labels")))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op7_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=2)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", "byte_bpe_50k.tiktoken")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_vectors(table(spark, sf_dir, "embeddings"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("rate")


QUERIES = {f.__name__: f for f in (op1_html_extract, op2_decontaminate, op3_lm_score, op4_toxicity, op5_substring_dedup, op6_embedding_dedup, op7_minhash_forest, op8_warc, op9_packing, op10_secrets, op11_centroid_clusters, op12_vector_codes, op13_mixing)}

FINITE = "embedding IS NOT NULL AND len(embedding) = len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x)))"


def _clusters_sql(k: int = 8, rounds: int = 10) -> str:
    """Every round's assignment and centroids as a step of their own; floors of quotients in doubles are exact at these sizes."""
    steps = [f"""x AS MATERIALIZED (SELECT vec_id, unnest(range(1, 65)) AS d, unnest(list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(1024 * x) AS BIGINT))) AS v FROM embeddings WHERE len(embedding) = 64 AND {FINITE}),
s AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS k FROM (SELECT DISTINCT vec_id FROM x) QUALIFY k < {k}), c0 AS MATERIALIZED (SELECT k, d, v FROM x JOIN s USING (vec_id))"""]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT vec_id, min(m) % {k} AS k, min(m) // {k} AS distance FROM (SELECT vec_id, k, CAST(sum((x.v - c.v) * (x.v - c.v)) * {k} + k AS BIGINT) AS m FROM x JOIN c{i} c USING (d) GROUP BY vec_id, k) GROUP BY vec_id)")
        if i < rounds:
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c.k, c.d, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN (SELECT k, d, CAST(floor(CAST(sum(v) AS DOUBLE) / count(*)) AS BIGINT) AS v FROM x JOIN a{i} USING (vec_id) GROUP BY k, d) m USING (k, d))")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, CAST(k AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM a{rounds} JOIN (SELECT k, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY d)) AS h FROM c{rounds} GROUP BY k) USING (k)"""


def _codes_sql(entries: int = 64, rounds: int = 2) -> str:
    steps = [f"""v AS MATERIALIZED (SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(256 * x) AS BIGINT)) AS e FROM embeddings WHERE len(embedding) > 0 AND len(embedding) % 16 = 0 AND {FINITE}),
w AS (SELECT * FROM v WHERE len(e) = (SELECT arg_min(len(e), vec_id) FROM v)),
x AS MATERIALIZED (SELECT vec_id, (i - 1) // (n // 16) AS p, (i - 1) % (n // 16) AS j, x FROM (SELECT vec_id, len(e) AS n, unnest(range(1, len(e) + 1)) AS i, unnest(e) AS x FROM w)),
s AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM w QUALIFY k < {entries}), c0 AS MATERIALIZED (SELECT p, k, j, x FROM x JOIN s USING (vec_id))"""]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT vec_id, p, min(m) % {entries} AS k, min(m) // {entries} AS away FROM (SELECT vec_id, x.p, k, CAST(sum((x.x - c.x) * (x.x - c.x)) * {entries} + k AS BIGINT) AS m FROM x JOIN c{i} c USING (p, j) GROUP BY vec_id, x.p, k) GROUP BY vec_id, p)")
        if i < rounds:
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c.p, c.k, c.j, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN (SELECT p, k, j, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS x FROM x JOIN a{i} USING (vec_id, p) GROUP BY p, k, j) m USING (p, k, j))")
    return "WITH " + ",\n".join(steps) + f""",
o AS (SELECT vec_id, lower(string_agg(printf('%02x', k), '' ORDER BY p)) AS code, CAST(sum(away) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, k, j)) FROM c{rounds}) AS codebooks_sha256 FROM o JOIN w USING (vec_id)"""


ORACLES = {
    "op2_decontaminate": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM documents),
i AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM benchmark),
g AS (SELECT DISTINCT item_id, least(13, len(words)) AS n, array_to_string(words[p : p + least(13, len(words)) - 1], ' ') AS gram
      FROM i, LATERAL (SELECT unnest(range(1, greatest(1, len(words) - 12) + 1)) AS p) WHERE len(words) > 0),
w AS (SELECT doc_id, p, n, array_to_string(words[p : p + n - 1], ' ') AS gram
      FROM d, (SELECT DISTINCT n FROM g), LATERAL (SELECT unnest(range(1, len(words) - n + 2)) AS p)),
m AS (SELECT doc_id, p, n, item_id FROM w JOIN g USING (n, gram)),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM m) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)""",
    "op5_substring_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, unnest(range(0, greatest(0, length(x) // 2 - 399))) AS i, unnest(list_transform(range(0, greatest(0, length(x) // 2 - 399)), lambda i: hash(substr(x, 2 * i + 1, 800)))) AS h FROM d),
r AS (SELECT doc_id, i FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
o AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 400 THEN 0 ELSE 1 END AS new FROM r)),
s AS (SELECT doc_id, min(i) AS lo, max(i) + 400 AS hi FROM o GROUP BY doc_id, g),
k AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS was FROM s),
a AS (SELECT k.doc_id, CAST(sum(hi - lo) AS BIGINT) AS n_removed, count(*) AS n_spans, string_agg(substr(x, 2 * was + 1, 2 * (lo - was)), '' ORDER BY lo) || substr(any_value(x), 2 * max(hi) + 1) AS kept FROM k JOIN d USING (doc_id) GROUP BY k.doc_id)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256, TRY(decode(unhex(coalesce(kept, x)))) AS text FROM d LEFT JOIN a USING (doc_id)""",
    "op6_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
p AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS u, vec_id AS w FROM v UNION SELECT r.u, p.w FROM r JOIN p ON r.w = p.u),
c AS (SELECT u, min(w) AS component_id FROM r GROUP BY u), n AS (SELECT u, count(*) AS n FROM p GROUP BY u)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON v.vec_id = c.u LEFT JOIN n ON v.vec_id = n.u""",
    "op7_minhash_forest": r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
g AS (SELECT DISTINCT doc_id, words[i] || ' ' || coalesce(words[i + 1], '') AS s FROM d, LATERAL (SELECT unnest(range(1, greatest(2, len(words)))) AS i) WHERE len(words) > 0),
f AS (SELECT s, count(*) AS df FROM g GROUP BY s), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT doc_id, s, n, row_number() OVER (PARTITION BY doc_id ORDER BY df, s) AS k FROM g JOIN f USING (s) JOIN n USING (doc_id)),
x AS (SELECT doc_id, s FROM o WHERE k <= n - (4 * n + 4) // 5 + 1),
t AS (SELECT DISTINCT a.doc_id AS u, b.doc_id AS w FROM x a JOIN x b ON a.s = b.s AND a.doc_id < b.doc_id),
i AS (SELECT u, w, count(*) AS same FROM t JOIN g a ON a.doc_id = u JOIN g b ON b.doc_id = w AND a.s = b.s GROUP BY u, w),
l AS (SELECT u, w FROM i JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = w WHERE 100 * same >= 80 * (a.n + b.n - same)),
e AS (SELECT u, w FROM l UNION ALL SELECT w, u FROM l),
r AS (SELECT doc_id AS u, doc_id AS w FROM d UNION SELECT r.u, e.w FROM r JOIN e ON r.w = e.u),
c AS (SELECT u AS doc_id, min(w) AS component_id FROM r GROUP BY u)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op8_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY x) AS first FROM p)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(x, (k // 4) * 5 + 1, 5) AS INTEGER) >> CAST(15 - 5 * (k % 4) AS INTEGER)) & 31) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f""",
    "op11_centroid_clusters": _clusters_sql(),
    "op12_vector_codes": _codes_sql(),
    "op13_mixing": r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, sha256(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
c AS MATERIALIZED (SELECT source, size, count(*) AS n FROM d GROUP BY source, size),
s AS MATERIALIZED (SELECT source, CAST(sum(size * n) AS BIGINT) AS source_size, min(CASE WHEN size > 0 THEN size END) AS least, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM c GROUP BY source),
r AS (SELECT row_number() OVER w AS i, 3 * source_size / weight AS full_at, (sum(source_size) OVER () - coalesce(3 * sum(source_size) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
      FROM s WINDOW w AS (ORDER BY 3 * source_size / weight, source NULLS LAST), b AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS MATERIALIZED (SELECT source, source_size, least, least(CAST(3 * source_size AS DOUBLE), weight * (SELECT arg_min(level, i) FROM r WHERE level <= full_at)) AS target FROM s),
b AS (SELECT source, target, least(0, ln(target / source_size)) / least AS low, ln(3) / least AS high, 0 AS i FROM t WHERE target > 0
      UNION ALL SELECT source, target, CASE WHEN f < target THEN mid ELSE low END, CASE WHEN f < target THEN high ELSE mid END, i + 1
      FROM (SELECT b.source, target, low, high, i, (low + high) / 2 AS mid, sum(n * size * least(3, exp((low + high) / 2 * size))) AS f FROM b JOIN c ON b.source IS NOT DISTINCT FROM c.source WHERE i < 90 GROUP BY b.source, target, low, high, i)),
q AS MATERIALIZED (SELECT c.source, size, n, source_size, t.target, CASE WHEN t.target >= 3 * source_size THEN 3 ELSE least(3, exp(high * size)) END AS rate
      FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source LEFT JOIN b ON b.source IS NOT DISTINCT FROM t.source AND i = 90),
u AS (SELECT *, round(sum(n * rate) OVER (PARTITION BY source ORDER BY size DESC ROWS UNBOUNDED PRECEDING)) AS run FROM q WHERE size > 0),
m AS (SELECT source, size, n, source_size, target, greatest(0, least(3 * n, CAST(run - coalesce(lag(run) OVER (PARTITION BY source ORDER BY size DESC), 0) AS BIGINT))) AS copies, 0 AS i FROM u
      UNION ALL SELECT source, size, n, source_size, target, copies + CASE WHEN size = max(CASE WHEN change <> 0 THEN size END) OVER (PARTITION BY source) THEN change ELSE 0 END, i + 1
      FROM (SELECT *, CAST(sign(missing) * least(CASE WHEN missing > 0 THEN 3 * n - copies ELSE copies END, floor(abs(missing) / size)) AS BIGINT) AS change
            FROM (SELECT *, target - sum(size * copies) OVER (PARTITION BY source) AS missing FROM m WHERE i < 12))),
f AS (SELECT source, size, n, source_size, target, copies FROM m WHERE i = 12 UNION ALL SELECT source, size, n, source_size, target, n FROM q WHERE size = 0),
g AS (SELECT d.*, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (SELECT greatest(1, CAST(ceil(max(n) / 256) AS BIGINT)) FROM c) AS g FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY source, size, g ORDER BY h, doc_id) AS place, count(*) OVER (PARTITION BY source, size, g) AS own, count(*) OVER (PARTITION BY source, size ORDER BY g) AS upto FROM g),
x AS (SELECT doc_id, o.size, source_size, target, copies // n + CASE WHEN place <= (copies % n * upto) // n - (copies % n * (upto - own)) // n THEN 1 ELSE 0 END AS copies
      FROM o JOIN f ON o.source IS NOT DISTINCT FROM f.source AND o.size = f.size)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * copies AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies FROM x""",
}
