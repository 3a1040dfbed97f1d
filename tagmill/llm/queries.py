"""The queries of this folder, by name: each takes (spark, sf_dir) and covers its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, decontaminate, exact_topk, html_extract, line_dedup, mixing, order_minhash, quality_fm, secret_scan, substring_dedup, surrogates


#: For the invented people of test tables; real texts want a secret in spark.tagmill.surrogates.key.
DEMONSTRATION_KEY = "demonstration"


def op1_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_fm.quality(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.topk(common.table(spark, sf_dir, "embeddings"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(common.table(spark, sf_dir, "documents")).drop("kept_text")


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_classes(common.table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(common.table(spark, sf_dir, "pages"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.found_items(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_found", "n_windows", "share")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_scan(common.table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    narrow = docs.select("doc_id", "source", F.xxhash64("doc_id", "text").alias("by"))  # texts need not be shuffled
    return mixing.mix(narrow, mixing.tempered(docs), by=F.col("by")).select("doc_id", "source", "block", "slot", "place")


def op9_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get("spark.tagmill.surrogates.key", DEMONSTRATION_KEY)
    return surrogates.pseudonymise(common.table(spark, sf_dir, "documents"), key).select("doc_id", "text", "n_entities")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(common.table(spark, sf_dir, "documents"), short=True).select("doc_id", "text", "n_lines", "n_dropped")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # it imports this folder, so not at the top

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k == "pipeline" or k.startswith("op") and k[2].isdigit()}


_TOPK_SQL = """
WITH e AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda x: x[1] * x[2])) AS BIGINT) AS score
    FROM e AS q JOIN e AS c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

_PASSAGE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(0, len(w) - 34)) AS i FROM d WHERE len(w) >= 35),
g AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 35], ' ') AS k FROM p),
r AS (SELECT k FROM g GROUP BY k HAVING count(*) > 1),
h AS (SELECT DISTINCT doc_id, i + j AS pos FROM (SELECT g.doc_id, g.i, unnest(range(0, 35)) AS j FROM g JOIN r USING (k))),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS pos FROM d),
n AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.pos) AS kept, count(*) AS n_kept FROM x ANTI JOIN h ON x.doc_id = h.doc_id AND x.pos = h.pos GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN n ON d.doc_id = n.doc_id
"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can say what a query does; tests hold the others against brute force."""
    return {"op2_exact_topk": _TOPK_SQL, "op3_substring_dedup": _PASSAGE_SQL}
