"""PREDICT statements, learners, preparation by learned steps, and checks of what has no exact oracle.

Results that no SQL can give are compared with what must hold of them: each check is a row of booleans.
"""

from __future__ import annotations

from pyspark.ml.feature import PCA, QuantileDiscretizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..functions import text
from ..ml import statement as st
from ..session import register_tables
from .registry import QUERIES, load, query

CHARGE = "l_quantity * 10 + l_tax * 100 - l_discount * 100 AS charge"
FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


def _versioned(spark, sf_dir, table: str, columns: str) -> str:
    """A view of a data folder's table whose name tells the folder, so that each folder has its models."""
    name = f"{table}_{abs(hash(sf_dir)) % 10**8}"
    register_tables(spark, sf_dir, (table,))
    spark.sql(f"SELECT {columns} FROM {table}").createOrReplaceTempView(name)
    return name


@query("predict_statement", "SELECT count(*) AS n, true AS close, true AS again FROM lineitem")
def predict_statement(spark, sf_dir):
    """A charge made of other columns: the mean error must stay below a tenth of the deviation. A second statement finds the model."""
    t = _versioned(spark, sf_dir, "lineitem", f"l_quantity, l_discount, l_tax, {CHARGE}")
    said = f"PREDICT VALUE OF charge FROM {t} TRAIN ON l_quantity, l_discount, l_tax"
    first = st.predict_sql(spark, said)
    second = st.predict_sql(spark, said).agg(F.sum("result").alias("s")).scalar()
    got = first.agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg((F.col("result") - F.col("charge")) ** 2)).alias("e"), F.stddev_pop("charge").alias("sd"), F.sum("result").alias("s"))
    return got.select("n", (F.col("e") < F.col("sd") / 10).alias("close"), (F.abs(F.col("s") - second) <= F.abs(F.col("s")) * 1e-9).alias("again"))


@query("predict_all_columns", "SELECT count(*) AS n, true AS mostly FROM lineitem WHERE l_quantity > 10")
def predict_all_columns(spark, sf_dir):
    """TRAIN ON *, with a text column, a model by name and WHERE."""
    t = _versioned(spark, sf_dir, "lineitem", "l_quantity, l_extendedprice, l_returnflag, CAST(l_quantity > 25 AS INT) AS big")
    got = st.predict_sql(spark, f"PREDICT CLASS OF big FROM {t} WHERE l_quantity > 10 TRAIN ON * WITH tree")
    return got.agg(F.count(F.lit(1)).alias("n"), (F.avg((F.col("result") == F.col("big")).cast("double")) > 0.99).alias("mostly"))


def _learner(name: str, task: str):
    def run(spark, sf_dir):
        columns = "l_quantity, l_discount, l_tax, l_linenumber, CAST(l_quantity > 25 AS INT) AS big, " + CHARGE
        rows = spark.table(_versioned(spark, sf_dir, "lineitem", columns))
        target = "big" if task == "class" else "charge"
        made = st.fitted(rows.where("l_linenumber <> 2"), target, FEATURES, task, name)
        held = st._shown(made, rows.where("l_linenumber = 2"), FEATURES, task)
        if task == "class":
            good = F.avg((F.col("result") == F.col("big")).cast("double")) > 0.85
        else:
            good = F.sqrt(F.avg((F.col("result") - F.col("charge")) ** 2)) < F.stddev_pop("charge") * 0.3
        return held.agg(F.count(F.lit(1)).alias("n"), good.alias("good"))

    return run


for _task, _names in (("class", ("forest", "gbt", "svc", "bayes", "mlp")), ("value", ("forest", "gbt"))):
    for _name in _names:
        query(f"learn_{_task}_{_name}", "SELECT count(*) AS n, true AS good FROM lineitem WHERE l_linenumber = 2")(_learner(_name, _task))


@query("pipeline_choice", "SELECT 12 AS tried, true AS better_than_half, true AS ordered")
def pipeline_choice(spark, sf_dir):
    register_tables(spark, sf_dir, ("lineitem",))
    rows = spark.sql("SELECT l_quantity, l_discount, l_tax, CAST(l_linenumber AS DOUBLE) AS l_linenumber, CAST(l_quantity > 25 AS INT) AS big FROM lineitem")
    got = st.best_pipeline(rows, "big", FEATURES)
    return got.agg(F.count(F.lit(1)).cast("int").alias("tried"), (F.max("score") > 0.5).alias("better_than_half"), (F.max("score") >= F.min("score")).alias("ordered"))


@query("pca_features", "SELECT count(*) AS n, true AS uncorrelated, true AS ordered FROM lineitem")
def pca_features(spark, sf_dir):
    """Principal components: uncorrelated, of falling variance."""
    rows = load(spark, sf_dir, "lineitem").select(*[F.col(c).cast("double").alias(c) for c in FEATURES])
    v = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(rows)
    p = PCA(inputCol="x", outputCol="p", k=3).fit(v).transform(v).select(vector_to_array("p").alias("p"))
    a, b = F.col("p")[0], F.col("p")[1]
    return p.agg(F.count(F.lit(1)).alias("n"), (F.abs(F.corr(a, b)) < 1e-6).alias("uncorrelated"), (F.var_pop(a) >= F.var_pop(b)).alias("ordered"))


@query("scale_quantile", "SELECT count(*) AS n, true AS even FROM customer")
def scale_quantile(spark, sf_dir):
    """Ten quantile bins, whose limits are estimated with a bounded error: each holds 10 per cent, give or take 3."""
    rows = load(spark, sf_dir, "customer").select("c_acctbal")
    bins = QuantileDiscretizer(numBuckets=10, inputCol="c_acctbal", outputCol="b", relativeError=0.005).fit(rows).transform(rows)
    each = bins.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    return each.agg(F.sum("n").alias("n"), F.bool_and(F.abs(F.col("n") / total - 0.1) < 0.03).alias("even"))


# ---- checks of queries whose rows no SQL can give


@query("check_approx_distinct", "SELECT l_returnflag, true AS close FROM lineitem GROUP BY l_returnflag")
def check_approx_distinct(spark, sf_dir):
    exact = load(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("m"))
    got = QUERIES["approx_distinct"](spark, sf_dir)
    return got.join(exact, "l_returnflag").select("l_returnflag", (F.abs(F.col("n") / F.col("m") - 1) < 0.15).alias("close"))


@query("check_approx_percentile", "SELECT l_returnflag, true AS close FROM lineitem GROUP BY l_returnflag")
def check_approx_percentile(spark, sf_dir):
    """The share of rows up to the estimate must be 0.9 within the documented error."""
    got = QUERIES["approx_percentile"](spark, sf_dir)
    rows = load(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice").join(F.broadcast(got), "l_returnflag")  # a row a flag
    below = rows.groupBy("l_returnflag").agg(F.avg((F.col("l_extendedprice") <= F.col("p")).cast("double")).alias("s"))
    return below.select("l_returnflag", (F.abs(F.col("s") - 0.9) < 0.01).alias("close"))


@query("check_random_normal", "SELECT 1000 AS n, true AS mean_near, true AS sd_near")
def check_random_normal(spark, sf_dir):
    got = QUERIES["random_normal"](spark, sf_dir).agg(F.count("x").cast("int").alias("n"), F.avg("x").alias("m"), F.stddev("x").alias("s"))
    return got.select("n", (F.abs(F.col("m") - 10) < 0.32).alias("mean_near"), (F.abs(F.col("s") - 2) < 0.25).alias("sd_near"))


@query("check_hash_bucket", "SELECT count(*) AS n, 16 AS buckets, true AS even FROM orders")
def check_hash_bucket(spark, sf_dir):
    got = QUERIES["hash_bucket"](spark, sf_dir)
    mean = F.sum("n") / 16
    return got.agg(F.sum("n").alias("n"), F.count(F.lit(1)).cast("int").alias("buckets"), (F.max(F.abs(F.col("n"))) < mean * 1.5).alias("even"))


@query("check_tablesample", "SELECT true AS of_table, true AS about_a_tenth")
def check_tablesample(spark, sf_dir):
    whole, got = load(spark, sf_dir, "lineitem"), QUERIES["tablesample"](spark, sf_dir)
    strange = got.exceptAll(whole).limit(1).agg(F.count(F.lit(1)).alias("n")).scalar()
    total = whole.agg(F.count(F.lit(1)).alias("n")).scalar()
    return got.agg(F.count(F.lit(1)).alias("n")).select((F.lit(0) == strange).alias("of_table"), (F.abs(F.col("n") / total - 0.1) < 0.03).alias("about_a_tenth"))


@query("check_stream_train", "SELECT count(*) AS n, round(regr_slope(value, k), 6) AS slope, round(regr_intercept(value, k), 4) AS intercept FROM (SELECT value, json_extract_string(props, '$.k')::DOUBLE AS k FROM events) t WHERE k IS NOT NULL")
def check_stream_train(spark, sf_dir):
    return QUERIES["stream_batch_train"](spark, sf_dir).select("n", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"))


@query("check_soundex", "SELECT DISTINCT c_mktsegment AS w, CASE c_mktsegment WHEN 'BUILDING' THEN 'B435' WHEN 'AUTOMOBILE' THEN 'A351' WHEN 'MACHINERY' THEN 'M256' WHEN 'HOUSEHOLD' THEN 'H243' WHEN 'FURNITURE' THEN 'F653' END AS s FROM customer")
def check_soundex(spark, sf_dir):
    return load(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("w"), F.soundex("c_mktsegment").alias("s")).distinct()


@query("check_ann_recall", "SELECT true AS all_true, true AS recall")
def check_ann_recall(spark, sf_dir):
    """Pairs within 1.3 of the asked vectors by brute force, against those of the hashed buckets."""
    from ..functions import numbers
    from .learning import asked_blocks

    e = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    near = numbers.l2(F.col("embedding"), F.col("v")) < 1.3
    exact = [e.join(F.broadcast(part), (F.col("vec_id") != F.col("q")) & near).select("q", "vec_id") for part in asked_blocks(e)]
    every = exact[0]
    for x in exact[1:]:
        every = every.unionByName(x)
    got = QUERIES["ann_lsh"](spark, sf_dir).select("q", "vec_id")
    wrong = got.join(every, ["q", "vec_id"], "left_anti").agg(F.count(F.lit(1)).alias("n")).scalar()
    found = got.agg(F.count(F.lit(1)).alias("n")).scalar()
    return every.agg(F.count(F.lit(1)).alias("n")).select((F.lit(0) == wrong).alias("all_true"), (found >= F.col("n") * 0.9).alias("recall"))


@query("check_levenshtein_weights", "SELECT n_nationkey, 2 * (length(n_name) - 6) - 2 * (length(n_name) - 6) + levenshtein(n_name, 'NATION')::INT AS d FROM nation")
def check_levenshtein_weights(spark, sf_dir):
    """With unit costs the weighted distance is the plain one."""
    one = F.lit(1)
    return load(spark, sf_dir, "nation").select("n_nationkey", text.weighted_levenshtein(F.col("n_name"), F.lit("NATION"), one, one, one).cast("long").alias("d"))


@query("check_predictions", "SELECT count(*) AS n, true AS values_balanced, true AS classes_balanced, true AS fm_agrees FROM lineitem")
def check_predictions(spark, sf_dir):
    """What training itself implies: on its rows, least squares with an intercept leaves no mean error, and logistic regression

    gives a mean probability that is the share of the class; a class is 1 just where the raw score is above 0.
    """
    value, kind, fm = (QUERIES[q](spark, sf_dir) for q in ("predict_value", "predict_class", "fm_interaction"))
    v = value.where("l_orderkey % 5 <> 0").agg((F.abs(F.avg("result") / F.avg("l_extendedprice") - 1) < 1e-6).alias("ok")).scalar()
    k = kind.where("l_orderkey IS NOT NULL").select("big", (1 / (1 + F.exp(-F.col("debug_value")))).alias("p"), (F.col("result") == (F.col("debug_value") > 0).cast("double")).alias("same"))
    k = k.agg((F.bool_and("same") & (F.abs(F.avg("p") - F.avg("big")) < 0.02)).alias("ok")).scalar()
    f = fm.agg(F.bool_and(F.col("result") == (F.col("debug_value") > 0).cast("double")).alias("ok")).scalar()
    return value.agg(F.count(F.lit(1)).alias("n")).select("n", v.alias("values_balanced"), k.alias("classes_balanced"), f.alias("fm_agrees"))


# ---- stored vectors


@query(
    "vector_delta",
    """SELECT vec_id, greatest(ceil(log2((hi - lo) / 0.001 + 1)), 1)::INT AS bits, true AS within FROM (SELECT vec_id, list_max(d) AS hi, list_min(d) AS lo FROM (
       SELECT vec_id, list_transform(embedding, lambda x, i: x::DOUBLE - ((i % 7) / 10.0)) AS d FROM embeddings) a) b""",
)
def vector_delta(spark, sf_dir):
    """Differences from a base vector, in the bits that a tolerance of 0.001 asks for; decoded within half a step of it."""
    from ..ml import store

    e = load(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    base = F.transform(F.sequence(F.lit(1), F.size("v")), lambda i: (i % 7) / F.lit(10.0))
    z = e.withColumn("base", base).withColumn("z", store.delta(F.col("v"), F.col("base"), 0.001))
    error = F.array_max(F.zip_with("v", store.undelta(F.col("z"), F.col("base")), lambda a, b: F.abs(a - b)))
    return z.select("vec_id", F.col("z.bits").alias("bits"), (error <= 0.0005 + 1e-9).alias("within"))


@query("vector_store", "SELECT vec_id AS id, true AS half_near, true AS uint8_near, true AS float_same FROM embeddings")
def vector_store(spark, sf_dir):
    """Saved in three forms and loaded again: half precision within 2^-11 of each number, eight bits within half a step."""
    from ..ml import store

    e = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    s = store.VectorStore(spark)
    for form in ("half", "uint8", "float"):
        s.save(form, e, form)
    gap = lambda a, b: F.zip_with(a, b, lambda x, y: F.abs(x - y))
    rows = e.join(s.load("half").withColumnRenamed("v", "h"), "id").join(s.load("uint8").withColumnRenamed("v", "u"), "id").join(s.load("float").withColumnRenamed("v", "f"), "id")
    near = F.forall(F.zip_with(gap(F.col("v"), F.col("h")), "v", lambda g, x: g <= F.greatest(F.abs(x) / 2048, F.lit(2.0**-25)) + 1e-12), lambda t: t)
    step = (F.array_max("v") - F.array_min("v")) / 255
    return rows.select("id", near.alias("half_near"), (F.array_max(gap(F.col("v"), F.col("u"))) <= step / 2 + 1e-9).alias("uint8_near"), (F.col("v") == F.col("f")).alias("float_same"))


@query("infer_by_name", "SELECT count(*) AS n, true AS right FROM lineitem")
def infer_by_name(spark, sf_dir):
    """Trained and asked by table and model name; then fine-tuned, which keeps the preparation."""
    from ..ml.predict import Registry

    t = _versioned(spark, sf_dir, "lineitem", f"l_quantity, l_discount, l_tax, {CHARGE}")
    registry, names = Registry.new(spark), ["l_quantity", "l_discount", "l_tax"]
    st.train_model(spark, registry, "linear", t, names, "charge")
    st.finetune(spark, registry, "linear", t, spark.table(t).where("l_quantity > 10"), names, "charge")
    got = st.infer(spark, registry, "linear", t, names, "charge")
    return got.agg(F.count(F.lit(1)).alias("n"), (F.max(F.abs(F.col("result") - F.col("charge"))) < F.stddev_pop("charge") / 5).alias("right"))
