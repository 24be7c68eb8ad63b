"""Prediction, preprocessing, metrics, vector search and quantisation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import numbers
from ..ml import predict as ml
from ..operators import relational
from ..sources import files
from .registry import load, query, sql

#: Query vectors of a broadcast block of ann_lsh, about.
ASKED = 4096
#: Centroids of a broadcast block of nearest_centroid, about.
CENTRES = 4096
FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


@query("predict_value")
def predict_value(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", *FEATURES)
    out = ml.predict(rows, "l_extendedprice", FEATURES, "value", files.version(spark, f"{sf_dir}/lineitem.parquet"), ml.Registry.of(spark), train_where="l_orderkey % 5 <> 0")
    return out.select("l_orderkey", "l_linenumber", "l_extendedprice", "result")


def _flagged(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", F.when(F.col("l_quantity") > 25, 1).otherwise(0).alias("big"), "l_extendedprice", "l_discount", "l_tax", "l_linenumber")


@query("predict_class")
def predict_class(spark, sf_dir):
    out = ml.predict(_flagged(spark, sf_dir), "big", ["l_extendedprice", "l_discount", "l_returnflag"], "class", files.version(spark, f"{sf_dir}/lineitem.parquet"), ml.Registry.of(spark), train_where="l_orderkey % 5 <> 0")
    return out.select("l_orderkey", "l_linenumber", "big", "result", "debug_value")


@query("fm_interaction")
def fm_interaction(spark, sf_dir):
    out = ml.predict(_flagged(spark, sf_dir), "big", ["l_extendedprice", "l_discount"], "fm", files.version(spark, f"{sf_dir}/lineitem.parquet"), ml.Registry.of(spark))
    return out.select("l_orderkey", "l_linenumber", "big", "result", "debug_value")


@query("model_lookup", "SELECT false AS before, true AS after, false AS other")
def model_lookup(spark, sf_dir):
    rows = load(spark, sf_dir, "part").select("p_size", "p_retailprice")
    registry = ml.Registry.new(spark)
    before = registry.lookup("part", ["p_size"], "p_retailprice", "value") is not None
    registry.save(ml.train(rows, "p_retailprice", ["p_size"], "value"), "part", ["p_size"], "p_retailprice", "value")
    after, other = (registry.lookup("part", f, "p_retailprice", "value") is not None for f in (["p_size"], ["p_partkey"]))
    return spark.createDataFrame([(before, after, other)], "before boolean, after boolean, other boolean")


# ---- preprocessing: statistics are one aggregation, applied as a broadcast row (a scalar), never a global window

@query("label_encode", "SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment)::INT AS code FROM customer")
def label_encode(spark, sf_dir):
    return ml.encode_labels(load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "code").select("c_custkey", "code")


sql("impute_mean", "SELECT c_custkey, round(coalesce(nullif(greatest(c_acctbal, 0), 0), (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0)), 4) AS x FROM customer")
@query("impute_median", "SELECT c_custkey, round(coalesce(nullif(greatest(c_acctbal, 0), 0), (SELECT median(c_acctbal) FROM customer WHERE c_acctbal > 0)), 4) AS x FROM customer")
def impute_median(spark, sf_dir):
    rows = load(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("x"))
    middle = relational.exact_quantiles(rows, "x", [0.5]).scalar()
    return rows.select("c_custkey", F.round(F.coalesce("x", middle), 4).alias("x"))



sql(
    "impute_mode",
    "SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), (SELECT v FROM (SELECT c_mktsegment AS v, count(*) AS n FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY c_mktsegment) t ORDER BY n DESC, v LIMIT 1)) AS x FROM customer",
)
sql("one_hot", "SELECT c_custkey, CAST(c_mktsegment = 'BUILDING' AS INT) AS building, CAST(c_mktsegment = 'MACHINERY' AS INT) AS machinery, CAST(c_mktsegment NOT IN ('BUILDING', 'MACHINERY') AS INT) AS other FROM customer")
sql("scale_minmax", "SELECT c_custkey, round((c_acctbal - lo) / (hi - lo), 6) AS x FROM customer CROSS JOIN (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer) s")
sql("scale_standard", "SELECT c_custkey, round((c_acctbal - m) / sd, 5) AS x FROM customer CROSS JOIN (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS sd FROM customer) s")

@query("scale_robust", "SELECT c_custkey, round((c_acctbal - q2) / (q3 - q1), 5) AS x FROM customer CROSS JOIN (SELECT percentile_cont(0.25) WITHIN GROUP (ORDER BY c_acctbal) AS q1, percentile_cont(0.5) WITHIN GROUP (ORDER BY c_acctbal) AS q2, percentile_cont(0.75) WITHIN GROUP (ORDER BY c_acctbal) AS q3 FROM customer) s")
def scale_robust(spark, sf_dir):
    rows = load(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    q = relational.exact_quantiles(rows, "c_acctbal", [0.25, 0.5, 0.75]).select(F.struct("q0", "q1", "q2").alias("q")).scalar()
    return rows.select("c_custkey", F.round((F.col("c_acctbal") - q["q1"]) / (q["q2"] - q["q0"]), 5).alias("x"))


sql("scale_maxabs", "SELECT c_custkey, round(c_acctbal / m, 6) AS x FROM customer CROSS JOIN (SELECT max(abs(c_acctbal)) AS m FROM customer) s")
sql("scale_normalizer", "SELECT l_orderkey, l_linenumber, round(l_quantity / sqrt(l_quantity * l_quantity + l_extendedprice * l_extendedprice), 8) AS x FROM lineitem")
sql("kbins", "SELECT c_custkey, CAST(least(floor((c_acctbal - lo) / ((hi - lo) / 5)), 4) AS INT) AS bin FROM customer CROSS JOIN (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer) s")
sql("poly_features", "SELECT l_orderkey, l_linenumber, l_quantity AS a, l_linenumber AS b, l_quantity * l_quantity AS aa, l_quantity * l_linenumber AS ab, l_linenumber * l_linenumber AS bb FROM lineitem")
sql("variance_threshold", "SELECT var_pop(l_quantity) > 0.01 AS quantity, var_pop(l_tax) > 0.01 AS tax, var_pop(l_discount) > 0.01 AS discount FROM lineitem")
sql("power_transform", "SELECT c_custkey, round(CASE WHEN c_acctbal >= 0 THEN ln(c_acctbal + 1) ELSE -ln(1 - c_acctbal) END, 6) AS x FROM customer")
sql("train_eval_test_split", "SELECT CASE WHEN o_orderkey % 10 < 7 THEN 'train' WHEN o_orderkey % 10 < 9 THEN 'evaluate' ELSE 'test' END AS part, count(*) AS n FROM orders GROUP BY 1")

# ---- metrics


@query(
    "metric_auc",
    """WITH r AS (SELECT (l_quantity > 25)::INT AS y, l_extendedprice AS s FROM lineitem), k AS (SELECT y, (rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2) AS rk FROM r)
       SELECT round((sum(rk) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2) / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)), 8) AS auc FROM k""",
)
def metric_auc(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("s"), F.when(F.col("l_quantity") > 25, 1).otherwise(0).alias("y"))
    return ml.auc(rows, "s", "y").select(F.round("auc", 8).alias("auc"))


sql(
    "metric_f1",
    """SELECT round(2.0 * tp / (2 * tp + fp + fn), 8) AS f1, round(1.0 * (tp + tn) / (tp + tn + fp + fn), 8) AS accuracy FROM (
       SELECT sum(CASE WHEN y = 1 AND p = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN y = 0 AND p = 1 THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN y = 1 AND p = 0 THEN 1 ELSE 0 END) AS fn, sum(CASE WHEN y = 0 AND p = 0 THEN 1 ELSE 0 END) AS tn
       FROM (SELECT CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS y, CASE WHEN l_extendedprice > 30000 THEN 1 ELSE 0 END AS p FROM lineitem) a) b""",
)
sql("metric_mse", "SELECT round(avg((l_extendedprice - 1500 * l_quantity) * (l_extendedprice - 1500 * l_quantity)), 2) AS mse FROM lineitem", "SELECT round(avg((l_extendedprice - 1500 * l_quantity) * (l_extendedprice - 1500 * l_quantity)), 2) AS mse FROM lineitem")

# ---- vectors: a stated query set (vec_id % 100 = 0, in blocks) against all rows; the top k is kept per query before the shuffle


def asked_blocks(vectors: DataFrame, block: int = ASKED) -> list[DataFrame]:
    """The query vectors (q, v) in parts of about `block` rows, so that each may be broadcast."""
    asked = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("v"))
    blocks = -(-asked.count() // block) or 1
    return [asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i) for i in range(blocks)]


def _nearest(spark, sf_dir, distance, k=10):
    """Each block of queries is broadcast and meets all rows; a task keeps k rows a query before the shuffle."""
    e = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    rounded = F.round(distance(F.col("embedding"), F.col("v")), 6).alias("d")
    found = [e.join(F.broadcast(part), F.col("vec_id") != F.col("q")).select("q", "vec_id", rounded) for part in asked_blocks(e)]
    ranked = [d.withColumn("rk", F.row_number().over(W.partitionBy("q").orderBy("d", "vec_id"))).where(F.col("rk") <= k) for d in found]
    return reduce(DataFrame.unionByName, ranked).select("q", "vec_id", "rk", "d")


KNN = """SELECT q, vec_id, rk::INT AS rk, d FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, vec_id) AS rk FROM (
  SELECT x.vec_id AS q, e.vec_id, round({}, 6) AS d FROM embeddings e JOIN embeddings x ON x.vec_id % 100 = 0 AND e.vec_id <> x.vec_id) a) b WHERE rk <= 10"""


@query("knn_l2", KNN.format("list_distance(e.embedding::DOUBLE[], x.embedding::DOUBLE[])"))
def knn_l2(spark, sf_dir):
    return _nearest(spark, sf_dir, numbers.l2)


@query("knn_cosine", KNN.format("1 - list_cosine_similarity(e.embedding::DOUBLE[], x.embedding::DOUBLE[])"))
def knn_cosine(spark, sf_dir):
    return _nearest(spark, sf_dir, lambda a, b: 1 - numbers.cosine(a, b))


@query("ann_lsh")
def ann_lsh(spark, sf_dir):
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = F.col("embedding").cast("array<double>")
    e = load(spark, sf_dir, "embeddings").select("vec_id", v.alias("v"), array_to_vector(v).alias("x"))
    lsh = BucketedRandomProjectionLSH(inputCol="x", outputCol="h", bucketLength=2.0, numHashTables=4, seed=7).fit(e)
    hashed = lsh.transform(e).select("vec_id", "v", F.transform("h", lambda b: vector_to_array(b)[0]).alias("h"))
    asked = hashed.where("vec_id % 100 = 0").selectExpr("vec_id AS q", "v AS w", "h AS g")
    blocks = -(-asked.count() // ASKED) or 1
    alike = F.exists(F.arrays_zip("g", "h"), lambda b: b["g"] == b["h"])  # in one table's bucket
    near = (F.col("q") != F.col("vec_id")) & alike & (numbers.l2(F.col("w"), F.col("v")) < 1.3)
    found = [hashed.join(F.broadcast(asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i)), near) for i in range(blocks)]
    return reduce(DataFrame.unionByName, found).select("q", "vec_id", F.round(numbers.l2(F.col("w"), F.col("v")), 6).alias("d"))


@query(
    "nearest_centroid",
    """WITH c AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) r(i) GROUP BY label, i),
       d AS (SELECT e.vec_id, c.label, sum((e.embedding[c.i]::DOUBLE - c.m) ** 2) AS d FROM embeddings e, c GROUP BY e.vec_id, c.label)
       SELECT vec_id, arg_min(label, d) AS label FROM d GROUP BY vec_id""",
)
def nearest_centroid(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings")
    each = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centres = each.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    centres = files.stored(centres)
    blocks = -(-centres.count() // CENTRES) or 1  # labels may grow with the data: blocks of them are broadcast one after another
    nearest = lambda cs: F.array_min(F.transform(cs, lambda c: F.struct(numbers.l2(F.col("embedding"), c["c"]).alias("d"), c["label"].alias("label"))))
    out = e.select("vec_id", "embedding", F.lit(None).cast("struct<d:double,label:int>").alias("best"))
    for i in range(blocks):
        some = centres.where(F.pmod(F.xxhash64("label"), F.lit(blocks)) == i).agg(F.collect_list(F.struct("label", "c")).alias("cs"))
        found = out.crossJoin(F.broadcast(some)).withColumn("own", nearest("cs"))  # one row
        out = found.select("vec_id", "embedding", F.when(F.col("best").isNull() | (F.col("own") < F.col("best")), F.col("own")).otherwise(F.col("best")).alias("best"))
    return out.select("vec_id", F.col("best.label").alias("label"))


@query(
    "vector_quantize",
    """SELECT vec_id, round((hi - lo) / 255.0, 8) AS scale, list_sum(list_transform(embedding, lambda x: floor(x::DOUBLE / ((hi - lo) / 255.0) - lo / ((hi - lo) / 255.0) + 0.5)))::BIGINT AS total
       FROM (SELECT *, list_min(embedding)::DOUBLE AS lo, list_max(embedding)::DOUBLE AS hi FROM embeddings) t""",
)
def vector_quantize(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings").select("vec_id", numbers.quantize(F.col("embedding")).alias("z"))
    return e.select("vec_id", F.round("z.scale", 8).alias("scale"), F.aggregate("z.q", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query("libsvm_encode", "SELECT p_partkey, p_size AS label, concat_ws(' ', '1:' || p_size, '2:' || p_partkey) AS line FROM part")
def libsvm_encode(spark, sf_dir):
    p = load(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("label"), F.concat_ws(" ", F.concat(F.lit("1:"), "p_size"), F.concat(F.lit("2:"), "p_partkey")).alias("line"))
    return p


@query("libsvm_decode", "SELECT p_size::DOUBLE AS label, '1,2,0' AS ids, p_size + p_partkey::DOUBLE AS total FROM part")
def libsvm_decode(spark, sf_dir):
    p = load(spark, sf_dir, "part").select(F.concat_ws(" ", "p_size", F.concat(F.lit("1:"), "p_size"), F.concat(F.lit("2:"), "p_partkey")).alias("line"))
    d = files.parse_libsvm(p, "line", 3)
    return d.select("label", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"), F.aggregate("values", F.lit(0.0), lambda s, x: s + x).alias("total"))
