"""The operators applied to their whole tables, and the SQL that says the same where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licenses, minhash, mixing, piece_codec, quality, subspace_join, suffix_radix, token_counts, warc, word_graph


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(spark, _table(spark, sf_dir, "pages"), least=0)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = word_graph.remove_passages(_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=2)


def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_radix.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.col("_n_bytes").alias("n_bytes"), F.col("_n_removed").alias("n_removed"), F.col("_n_spans").alias("n_spans"), F.sha2("_kept", 256).alias("kept_sha256"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.code(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_blocks", "n_confirmed", F.array_join("licenses", ",").alias("licenses"), "bytes_saved")


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subspace_join.near_vectors(_table(spark, sf_dir, "embeddings"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.Mix(_table(spark, sf_dir, "documents"))
    return mix.report().select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {f.__name__: f for f in (op1_warc, op2_substring_dedup, op3_token_counts, op4_minhash, op5_suffix_array, op6_sentencepiece, op7_quality_rules, op8_license_scan, op9_embedding_dedup, op10_mixing)}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE_SQL = {
    "op1_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS h, min(page_id) OVER (PARTITION BY b) AS first FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(h, CAST(i // 8 * 10 + 1 AS BIGINT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d""",
    "op2_substring_dedup": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM d WHERE len(w) >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS m FROM s),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY m) AS f FROM h) WHERE f < doc_id),
x AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM r),
g AS (SELECT doc_id, list(j) AS js FROM x GROUP BY doc_id),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
k AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.j) AS kept FROM p ANTI JOIN x ON p.doc_id = x.doc_id AND p.j = x.j GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(js), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN k USING (doc_id)""",
    "op4_minhash": f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS x FROM d),
n AS (SELECT d.doc_id, count(x) AS n FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * shared >= 80 * (p.n + q.n - shared)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
c AS (SELECT doc_id AS node, doc_id AS least FROM documents UNION SELECT e.b, c.least FROM c JOIN e ON e.a = c.node WHERE c.least < e.b)
SELECT n.doc_id, n.n AS n_shingles, min(least) AS component_id, n.doc_id = min(least) AS kept FROM n JOIN c ON c.node = n.doc_id GROUP BY n.doc_id, n.n""",
    "op5_suffix_array": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, i, substr(x, 2 * i + 1, 200) AS s FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 99)) AS i FROM d WHERE len(x) >= 200)),
f AS (SELECT s, min((doc_id, i)) AS first FROM w GROUP BY s HAVING count(*) > 1),
r AS (SELECT doc_id, i FROM w JOIN f USING (s) WHERE (doc_id, i) <> first),
o AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM r),
g AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM o),
u AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY ALL),
k AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS next_ FROM u),
t AS (SELECT k.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(x, 2 * from_ + 1, 2 * (a - from_)) || CASE WHEN next_ IS NULL THEN substr(x, 2 * b + 1) ELSE '' END, '' ORDER BY a) AS kept FROM k JOIN d ON d.doc_id = k.doc_id GROUP BY k.doc_id)
SELECT d.doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)""",
    "op9_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
c AS (SELECT vec_id AS node, vec_id AS least FROM embeddings UNION SELECT l.b, c.least FROM c JOIN l ON l.a = c.node WHERE c.least < l.b),
m AS (SELECT node, min(least) AS least FROM c GROUP BY node),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT node AS vec_id, coalesce(n, 0) AS n_links, least AS component_id, node = least AS kept FROM m LEFT JOIN n ON n.a = node""",
}


def _quality_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)
    ratio = {
        "n_words": "n_words",
        "mean_word_chars": "CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END",
        "symbol_ratio": "CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END",
        "stop_word_ratio": "CASE WHEN n_words > 0 THEN n_stop / n_words ELSE 0 END",
        "dup_line_ratio": "CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END",
        "repeat_word_ratio": "CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END",
    }
    rules = " AND ".join(f"({ratio[m]}) {sign} {limit}" for m, low, high in quality.RULES for sign, limit in ((">=", low), ("<=", high)) if limit is not None)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
x AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
y AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM x) WHERE n > 1),
z AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM y) GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
  coalesce(z.n, 0) AS n_repeat_words, len(l) AS n_lines, len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS n_stop FROM d LEFT JOIN z ON z.doc_id = d.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {rules} AS kept FROM b"""


ORACLE_SQL["op7_quality_rules"] = _quality_sql()
