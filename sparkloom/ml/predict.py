"""PREDICT VALUE and PREDICT CLASS: train if the registry has no model, then infer over the table.

The registry is a Parquet table in the shared folder; a model's key is the digest of its table, features, target and task.
WHERE is honoured, exactly one target is taken, and imputers are fitted on training rows only.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import FMClassifier, LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import Imputer, ImputerModel, StandardScaler, StandardScalerModel, StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.files import folder

#: The most features of a model; more are an error.
MOST_FEATURES = 100
_REGISTRIES: dict[str, "Registry"] = {}
_LOADED: dict[str, PipelineModel] = {}


@dataclass
class Registry:
    spark: SparkSession
    path: str

    @staticmethod
    def new(spark: SparkSession) -> "Registry":
        return Registry(spark, folder(spark, "models"))

    @staticmethod
    def of(spark: SparkSession) -> "Registry":
        """The registry of a session: models are trained once in it."""
        key = spark.sparkContext.applicationId
        if key not in _REGISTRIES:
            _REGISTRIES[key] = Registry.new(spark)
        return _REGISTRIES[key]

    def load_or(self, table: str, features: Sequence[str], target: str, task: str, make: Callable[[], PipelineModel]) -> PipelineModel:
        """The newest model of a key, or a new one that is saved. A model is read once a session."""
        path = self.lookup(table, features, target, task)
        if path is None:
            model = make()
            _LOADED[self.save(model, table, features, target, task)] = model
            return model
        if path not in _LOADED:
            _LOADED[path] = PipelineModel.load(path)
        return _LOADED[path]

    SCHEMA = "model string, table string, features string, target string, task string, at double, path string"

    def all(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/router")
        except Exception as e:  # no model yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], self.SCHEMA)

    @staticmethod
    def key(table: str, features: Sequence[str], target: str, task: str) -> str:
        return hashlib.md5("\x1f".join([table, *features, target, task]).encode()).hexdigest()

    def lookup(self, table: str, features: Sequence[str], target: str, task: str) -> str | None:
        rows = self.all().where(F.col("model") == self.key(table, features, target, task)).orderBy(F.desc("at")).limit(1).collect()
        return rows[0]["path"] if rows else None

    def save(self, model: PipelineModel, table: str, features: Sequence[str], target: str, task: str) -> str:
        key = self.key(table, features, target, task)
        at = time.time()
        path = f"{self.path}/{key}-{at:.6f}"
        model.write().save(path)
        row = [(key, table, ",".join(features), target, task, at, path)]
        self.spark.createDataFrame(row, self.SCHEMA).write.mode("append").parquet(f"{self.path}/router")
        return path


def feature_columns(df: DataFrame, target: str, features: Sequence[str] | None) -> list[str]:
    """The listed features, or every column but the target that is a number or a text."""
    if features:
        return list(features)
    usable = [f.name for f in df.schema.fields if f.name != target and isinstance(f.dataType, (T.NumericType, T.StringType, T.BooleanType))]
    if len(usable) > MOST_FEATURES:
        raise ValueError(f"{len(usable)} columns to train on; list up to {MOST_FEATURES} of them")
    return usable


def pipeline(df: DataFrame, target: str, features: Sequence[str], task: str) -> Pipeline:
    texts = [c for c in features if isinstance(df.schema[c].dataType, T.StringType)]
    numbers = [c for c in features if c not in texts]
    steps: list = [StringIndexer(inputCols=texts, outputCols=[f"{c}__i" for c in texts], handleInvalid="keep")] if texts else []
    if numbers:
        steps.append(Imputer(inputCols=numbers, outputCols=[f"{c}__n" for c in numbers], strategy="mean"))
    steps += [
        VectorAssembler(inputCols=[f"{c}__i" for c in texts] + [f"{c}__n" for c in numbers], outputCol="__raw", handleInvalid="keep"),
        StandardScaler(inputCol="__raw", outputCol="__x", withMean=True),
    ]
    learner = {
        "value": lambda: LinearRegression(featuresCol="__x", labelCol="__y", predictionCol="result", regParam=0.01),
        "class": lambda: LogisticRegression(featuresCol="__x", labelCol="__y", predictionCol="result", rawPredictionCol="__raw_score", maxIter=50),
        "fm": lambda: FMClassifier(featuresCol="__x", labelCol="__y", predictionCol="result", rawPredictionCol="__raw_score", factorSize=4, maxIter=50, seed=7),
    }[task]
    return Pipeline(stages=[*steps, learner()])


def typed(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in features if not isinstance(df.schema[c].dataType, T.StringType)})


def train(df: DataFrame, target: str, features: Sequence[str], task: str) -> PipelineModel:
    rows = typed(df, features).withColumn("__y", F.col(target).cast("double")).where("__y is not null")
    return pipeline(df, target, features, task).fit(rows)


def as_columns(model: PipelineModel, features: Sequence[str]) -> tuple[Column, Column | None] | None:
    """A linear model of numbers as an expression (result, raw score of classes), which stays in generated code; None for others."""
    stages = list(model.stages)
    learner = stages.pop()
    if not isinstance(learner, (LinearRegressionModel, LogisticRegressionModel)) or any(not isinstance(s, (ImputerModel, VectorAssembler, StandardScalerModel)) for s in stages):
        return None
    classes = isinstance(learner, LogisticRegressionModel)
    if [type(s) for s in stages] != [ImputerModel, VectorAssembler, StandardScalerModel] or classes and learner.numClasses != 2:
        return None
    imputer, _, scaler = stages
    fill, names = imputer.surrogateDF.first(), imputer.getInputCols()
    if list(names) != list(features) or not (scaler.getWithMean() and scaler.getWithStd()):
        return None
    total, terms = float(learner.intercept), []
    for c, w, m, s in zip(names, learner.coefficients.toArray().tolist(), scaler.mean.toArray().tolist(), scaler.std.toArray().tolist(), strict=True):
        if s:
            total -= w * m / s
            x = F.col(c).cast("double")
            terms.append(F.when(x.isNull() | F.isnan(x), F.lit(float(fill[c]))).otherwise(x) * F.lit(w / s))
    score = sum(terms, F.lit(total))
    return (F.when(score > 0, 1.0).otherwise(0.0), score) if classes else (score, None)


def predict(df: DataFrame, target: str, features: Sequence[str] | None = None, task: str = "value", table: str = "", registry: Registry | None = None, where: str | None = None, train_where: str | None = None) -> DataFrame:
    """df's rows with `result`, and for classes the raw score as `debug_value` (above 0: class 1)."""
    names = feature_columns(df, target, features)
    registry = registry or Registry.new(df.sparkSession)
    model = registry.load_or(table, names, target, task, lambda: train(df.where(train_where) if train_where else df, target, names, task))
    rows = df.where(where) if where else df
    linear = as_columns(model, names)
    if linear is not None:
        return rows.select(*df.columns, linear[0].alias("result"), *([linear[1].alias("debug_value")] if linear[1] is not None else []))
    out = model.transform(typed(rows, names))
    extra = []
    if task != "value":
        from pyspark.ml.functions import vector_to_array

        extra = [vector_to_array("__raw_score")[1].alias("debug_value")]
    return out.select(*df.columns, F.col("result").cast("double").alias("result"), *extra)


def finetune(registry: Registry, df: DataFrame, target: str, features: Sequence[str], task: str, table: str) -> str:
    """A newer model under the same key; lookups take the latest."""
    return registry.save(train(df, target, features, task), table, features, target, task)


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """ROC AUC from ranks: one aggregation by score, then running sums over ranges of scores; a single class gives 0."""
    from ..operators.relational import running_total

    by = df.groupBy(score).agg(F.sum(label).alias("p"), F.count(F.lit(1)).alias("n"))
    rows = running_total(by, score, F.col("n") - F.col("p"), "low")
    out = rows.agg(F.sum(F.col("p") * (F.col("low") + (F.col("n") - F.col("p")) / 2)).alias("u"), F.sum("p").alias("p"), F.sum(F.col("n") - F.col("p")).alias("q"))
    return out.select(F.when((F.col("p") > 0) & (F.col("q") > 0), F.col("u") / (F.col("p") * F.col("q"))).otherwise(F.lit(0.0)).alias("auc"))


def encode_labels(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with numbers from 1 for the values of a text column in their order: distinct values by partial aggregation, then running counts."""
    from ..operators.relational import running_total

    values = df.where(F.col(column).isNotNull()).select(column).distinct()
    codes = running_total(values, column, F.lit(1), "__before").select(F.col(column).alias("__value"), (F.col("__before") + 1).cast("int").alias(name))
    return df.join(codes, F.col(column) == F.col("__value"), "left").drop("__value")
