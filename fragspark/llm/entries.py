"""The queries of this subpackage for the driver: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fragspark import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fragspark.llm.op1_substring_dedup import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fragspark.llm.op2_suffix_dedup import suffix_dedup

    return suffix_dedup(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fragspark.llm.op3_mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op4_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fragspark.llm import op4_classifier as C

    docs = table(spark, sf_dir, "documents")
    return C.classify(docs, C.train(docs, table(spark, sf_dir, "labels")))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fragspark.llm.op5_rules import quality_rules

    found = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fragspark.llm.op6_jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fragspark.llm.op7_lm_scoring import score

    return score(table(spark, sf_dir, "documents"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fragspark.llm.op8_ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fragspark.llm.op9_token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), vocabulary_path())


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fragspark.llm.op10_packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary_path())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_suffix_dedup, op3_mixing, op4_classifier, op5_quality_rules, op6_jaccard_join, op7_lm_scoring, op8_ann, op9_token_counts, op10_packing)}


WORDS = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SUBSTRING_SQL = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS nth FROM win) WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM later)),
kept AS (SELECT doc_id, p, word FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w) ANTI JOIN gone USING (doc_id, p)),
texts AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM kept GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN texts USING (doc_id)"""

SUFFIX_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
parts AS (SELECT doc_id, c, substr(h, 1000 * c + 1, 1798) AS p FROM (SELECT doc_id, h, unnest(range(0, (length(h) // 2 - 400) // 500 + 1)) AS c FROM d WHERE length(h) >= 800)),
s AS (SELECT doc_id, 500 * c + j AS i, md5_number(substr(p, 2 * j + 1, 800)) AS k FROM (SELECT doc_id, c, p, unnest(range(0, length(p) // 2 - 399)) AS j FROM parts)),
again AS (SELECT k FROM s GROUP BY k HAVING count(*) > 1),
hit AS (SELECT doc_id, i FROM s SEMI JOIN again USING (k)),
runs AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 1 ELSE 0 END AS fresh FROM hit)),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS b FROM runs GROUP BY doc_id, g),
sums AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS n, max(b) AS last FROM spans GROUP BY doc_id),
kept AS (SELECT doc_id, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS lo, a AS hi FROM spans UNION ALL SELECT doc_id, coalesce(last, 0), length(h) // 2 FROM d LEFT JOIN sums USING (doc_id)),
texts AS (SELECT doc_id, string_agg(substr(h, 2 * lo + 1, 2 * (hi - lo)), '' ORDER BY lo) AS t FROM kept JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans, sha256(unhex(t)) AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id) JOIN texts USING (doc_id)"""

JACCARD_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORDS}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 2], ' ') END AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT u, v FROM shared JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 90 * (x.n + y.n - c)),
reach(u, v) AS (SELECT u, v FROM link UNION SELECT r.u, l.v FROM reach r JOIN link l ON l.u = r.v)
SELECT w.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, least(w.doc_id, min(reach.v)) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN reach ON reach.u = w.doc_id GROUP BY w.doc_id"""


def oracle_sql() -> dict[str, str]:
    """Learned models, library tokenizers, hash orders and approximate searches are beyond SQL: tests hold those against brute force."""
    return {"op1_substring_dedup": SUBSTRING_SQL, "op2_suffix_dedup": SUFFIX_SQL, "op6_jaccard_join": JACCARD_SQL}
