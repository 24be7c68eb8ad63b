"""The registered queries opN_<name>: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, licenses, ngram_join, packing, pii, sharding, token_counts, topk, toxicity
from .runtime import table


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


OP6_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(pieces)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e) WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 10
"""


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_matches(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.spans_of(table(spark, sf_dir, "documents"))


#: The whole join in SQL: all pairs that share a shingle, and reachability. Fit for the test tables only.
OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS gs FROM w
), s AS (SELECT doc_id, len(gs) AS n, unnest(gs) AS g FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS o FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p WHERE 100 * o >= 80 * (na + nb - o)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT g.doc_id, len(any_value(g.gs))::BIGINT AS n_shingles, min(r.b) AS component_id FROM g JOIN r ON r.a = g.doc_id GROUP BY g.doc_id
"""


# ---- what SQL can say of the operators whose rows it can't give


def check_op3_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is whole, and every sequence gapless and within its capacity."""
    rows = op3_packing(spark, sf_dir)
    whole = rows.groupBy("doc_id").agg((F.count(F.lit(1)) == F.max("piece") + 1).alias("pieces"), (F.max(F.col("start") + F.col("length")) == F.sum("length")).alias("gapless"))
    full = rows.groupBy("sequence_id").agg(((F.max(F.col("offset") + F.col("length")) == F.sum("length")) & (F.sum("length") <= 4096)).alias("ok"))
    good = full.agg(F.bool_and("ok").alias("ok")).scalar()
    return whole.select("doc_id", (F.col("pieces") & F.col("gapless")).alias("whole"), good.alias("sequences"))


def check_op5_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_byte_bpe(spark, sf_dir).select("doc_id", "decoded_sha256")


def check_op7_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and checksums; slots without gaps; and the grown shard is the old one or the new one."""
    rows = op7_sharding(spark, sf_dir)
    dense = rows.groupBy("shard").agg(((F.max("slot") + 1 == F.count(F.lit(1))) & (F.countDistinct("slot") == F.count(F.lit(1)))).alias("ok")).agg(F.bool_and("ok").alias("ok")).scalar()
    return rows.select("doc_id", "size", (F.col("grown_shard").isin(16) | (F.col("grown_shard") == F.col("shard"))).alias("stays_or_new"), dense.alias("dense"))


def check_op8_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On the held-out labels at least 95 of 100 are right."""
    got = op8_toxicity(spark, sf_dir).join(table(spark, sf_dir, "labels").where("toxic is not null"), "doc_id")
    right = F.avg(F.when(F.col("held_out"), (F.col("predicted") == F.col("toxic")).cast("double"))) >= 0.95
    return got.agg(F.count(F.lit(1)).alias("n"), right.alias("good"), F.bool_and(F.col("score").between(0, 1)).alias("in_range"))


def check_op9_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_phone")


def check_op10_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_token_counts(spark, sf_dir).select("doc_id", "n_bytes", (F.col("over_limit") == (F.col("n_tokens") > 4096)).alias("limit_holds"))


CHECKS = {"check_op3_places": check_op3_places, "check_op5_round_trip": check_op5_round_trip, "check_op7_slots": check_op7_slots, "check_op8_held_out": check_op8_held_out, "check_op9_counts": check_op9_counts, "check_op10_bytes": check_op10_bytes}
CHECKS_SQL = {
    "check_op3_places": "SELECT doc_id, true AS whole, true AS sequences FROM documents",
    "check_op5_round_trip": "SELECT doc_id, sha256(coalesce(text, '')) AS decoded_sha256 FROM documents",
    "check_op7_slots": "SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, true AS stays_or_new, true AS dense FROM documents",
    "check_op8_held_out": "SELECT count(*) AS n, true AS good, true AS in_range FROM documents JOIN labels USING (doc_id) WHERE toxic IS NOT NULL",
    "check_op9_counts": r"""
SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS n_email,
  len(list_filter(regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda x: len(list_filter(string_split(x, '.'), lambda d: d::HUGEINT > 255)) = 0)) AS n_ip,
  len(list_filter(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 8 AND 15)) AS n_phone
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) d""",
    "check_op10_bytes": "SELECT doc_id, strlen(coalesce(text, '')) AS n_bytes, true AS limit_holds FROM documents",
}
QUERIES = {"op2_ngram_join": op2_ngram_join, "op9_pii": op9_pii, "op1_exact_topk": op1_exact_topk, "op4_license_scan": op4_license_scan, "op8_toxicity": op8_toxicity, "op3_packing": op3_packing, "op5_byte_bpe": op5_byte_bpe, "op10_token_counts": op10_token_counts, "op6_exact_dedup": op6_exact_dedup, "op7_sharding": op7_sharding, **CHECKS}
ORACLE_SQL = {"op1_exact_topk": OP1_SQL, "op2_ngram_join": OP2_SQL, "op6_exact_dedup": OP6_SQL, **CHECKS_SQL}
