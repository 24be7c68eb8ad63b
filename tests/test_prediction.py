"""PREDICT statements, training by table name, fine-tuning and candidate pipelines."""

import pytest
from pyspark.sql import functions as F

from sparkloom.ml import predict as ml
from sparkloom.ml import statement as st


def test_statements_are_parsed():
    p = st.parse("predict value of click_rate\nfrom t where a > 1 and b = 'on x' TRAIN ON a, b ,c;")
    assert p == st.Predict("value", "click_rate", "t", ("a", "b", "c"), "a > 1 and b = 'on x'", None)
    assert st.parse("PREDICT CLASS OF y FROM t TRAIN ON * WITH forest") == st.Predict("class", "y", "t", (), None, "forest")
    assert st.parse("PREDICT CLASS OF y FROM t TRAIN ON").features == ()
    for bad in ("PREDICT y FROM t TRAIN ON a", "PREDICT VALUE OF a, b FROM t TRAIN ON c", "SELECT 1", "PREDICT VALUE OF a FROM t TRAIN ON b,,c"):
        with pytest.raises(ValueError):
            st.parse(bad)


@pytest.fixture(scope="module")
def table(spark):
    rows = spark.range(400).select("id", (F.col("id") % 20).cast("double").alias("a"), F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("kind"))
    rows = rows.withColumn("y", F.when(F.col("id") % 50 != 7, F.col("a") * 3 + F.when(F.col("kind") == "even", 10).otherwise(0))).withColumn("big", (F.col("a") > 9).cast("int"))
    rows.createOrReplaceTempView("prediction_table")
    return "prediction_table"


def test_a_statement_trains_once_and_predicts_rows_without_a_target(spark, table):
    registry = ml.Registry.new(spark)
    got = st.predict_sql(spark, f"PREDICT VALUE OF y FROM {table} WHERE id < 60 TRAIN ON a, kind", registry)
    assert got.count() == 60 and got.where("result is null").isEmpty()
    assert got.where("y is not null and abs(result - y) > 1").isEmpty()
    st.predict_sql(spark, f"PREDICT VALUE OF y FROM {table} TRAIN ON a, kind", registry)
    assert registry.all().count() == 1
    st.predict_sql(spark, f"PREDICT VALUE OF y FROM {table} TRAIN ON a, kind WITH tree", registry)
    assert registry.all().count() == 2


def test_the_setting_names_the_model_and_unknown_ones_are_errors(spark, table):
    registry = ml.Registry.new(spark)
    spark.conf.set(st.SETTING, "forest")
    try:
        st.predict_sql(spark, f"PREDICT CLASS OF big FROM {table} TRAIN ON a", registry)
    finally:
        spark.conf.unset(st.SETTING)
    assert [r["task"] for r in registry.all().collect()] == ["class:forest"]
    with pytest.raises(ValueError, match="no learner"):
        st.predict_sql(spark, f"PREDICT CLASS OF big FROM {table} TRAIN ON a WITH oracle", registry)
    with pytest.raises(ValueError, match="no column"):
        st.predict_sql(spark, f"PREDICT CLASS OF big FROM {table} TRAIN ON zz", registry)


def test_train_infer_and_finetune_by_name(spark, table):
    registry = ml.Registry.new(spark)
    with pytest.raises(LookupError):
        st.infer(spark, registry, "linear", table, ["a"], "y")
    assert st.train_model(spark, registry, "linear", table, ["a"], "y")
    before = st.infer(spark, registry, "linear", table, ["a"], "y").agg(F.avg("result")).first()[0]
    new = spark.range(200).select((F.col("id") % 20).cast("double").alias("a"), (F.col("id") % 20 * 3 + 1000).cast("double").alias("y"))
    assert st.finetune(spark, registry, "linear", table, new, ["a"], "y")
    after = st.infer(spark, registry, "linear", table, ["a"], "y").agg(F.avg("result")).first()[0]
    assert after > before + 900 and registry.all().count() == 2


def test_candidate_pipelines_are_scored_on_unseen_rows(spark, table):
    got = st.best_pipeline(spark.table(table).select("a", "big"), "big", ["a"], pipelines=[("standard",), ("minmax", "polynomial")], models=["logistic"]).collect()
    assert len(got) == 2 and got[0]["score"] >= got[1]["score"] and got[0]["score"] > 0.9


def test_linear_models_as_columns_equal_their_pipelines(spark):
    rows = spark.range(300).select((F.col("id") % 17).cast("double").alias("a"), F.when(F.col("id") % 11 != 0, F.col("id") % 5).cast("int").alias("b"), F.lit(2.0).alias("c"))
    rows = rows.withColumns({"y": F.col("a") * 2 - F.coalesce("b", F.lit(1)) + F.rand(3), "k": (F.col("a") > 8).cast("int")})
    names = ["a", "b", "c"]
    for task, target in (("value", "y"), ("class", "k")):
        model = ml.train(rows, target, names, task)
        got, raw = ml.as_columns(model, names)
        out = model.transform(ml.typed(rows, names).withColumnsRenamed({}))
        both = out.select(got.alias("g"), F.col("result").alias("w")).collect()
        assert all(r["g"] == pytest.approx(r["w"], rel=1e-9, abs=1e-9) for r in both)
    assert ml.as_columns(st.fitted(rows, "k", names, "class", "tree"), names) is None
