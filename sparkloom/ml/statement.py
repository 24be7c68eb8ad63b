"""PREDICT as a statement, train / infer / fine-tune calls by table name, and candidate pipelines.

    PREDICT VALUE | CLASS OF target FROM table [WHERE condition] TRAIN ON column, … | * [WITH model]

A model's name comes from WITH, else from the setting `sparkloom.predict.model`, else by task. Tables are those that the
session knows by name. WHERE limits the rows that are predicted; training takes the rows with a target.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, FMClassifier, GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import PCA, Imputer, Interaction, MaxAbsScaler, MinMaxScaler, Normalizer, OneHotEncoder, PolynomialExpansion, QuantileDiscretizer, RobustScaler, StandardScaler, StringIndexer, VarianceThresholdSelector, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, FMRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .predict import Registry, as_columns, feature_columns, typed

_FORM = re.compile(r"^\s*predict\s+(value|class)\s+of\s+([\w.]+)\s+from\s+([\w.]+)(?:\s+where\s+(.+?))?\s+train\s+on\s*(\*|[\w.,\s]*?)(?:\s+with\s+(\w+))?\s*;?\s*$", re.I | re.S)
SETTING = "sparkloom.predict.model"

_IO = {"featuresCol": "__x", "labelCol": "__y", "predictionCol": "result"}
_RAW = {**_IO, "rawPredictionCol": "__raw_score"}
#: Learners by name: of classes, and of values.
CLASSIFIERS = {
    "logistic": lambda n, k: LogisticRegression(**_RAW, maxIter=50), "fm": lambda n, k: FMClassifier(**_RAW, factorSize=4, maxIter=50, seed=7), "svc": lambda n, k: LinearSVC(**_RAW, maxIter=30),
    "tree": lambda n, k: DecisionTreeClassifier(**_RAW, maxDepth=8, seed=7), "forest": lambda n, k: RandomForestClassifier(**_RAW, numTrees=20, maxDepth=8, seed=7), "gbt": lambda n, k: GBTClassifier(**_IO, maxIter=10, seed=7),
    "bayes": lambda n, k: NaiveBayes(**_RAW, modelType="gaussian"), "mlp": lambda n, k: MultilayerPerceptronClassifier(**_RAW, layers=[n, 8, k], maxIter=60, seed=7),
}
REGRESSORS = {
    "linear": lambda n, k: LinearRegression(**_IO, regParam=0.01), "fm": lambda n, k: FMRegressor(**_IO, factorSize=4, maxIter=50, seed=7), "tree": lambda n, k: DecisionTreeRegressor(**_IO, maxDepth=8, seed=7),
    "forest": lambda n, k: RandomForestRegressor(**_IO, numTrees=20, maxDepth=8, seed=7), "gbt": lambda n, k: GBTRegressor(**_IO, maxIter=10, seed=7),
}
#: Steps of numbers, by name; each goes from one vector column to another.
STEPS = {
    "standard": lambda i, o: StandardScaler(inputCol=i, outputCol=o, withMean=True), "minmax": lambda i, o: MinMaxScaler(inputCol=i, outputCol=o), "maxabs": lambda i, o: MaxAbsScaler(inputCol=i, outputCol=o),
    "robust": lambda i, o: RobustScaler(inputCol=i, outputCol=o), "normalizer": lambda i, o: Normalizer(inputCol=i, outputCol=o), "polynomial": lambda i, o: PolynomialExpansion(inputCol=i, outputCol=o, degree=2),
    "pca": lambda i, o: PCA(inputCol=i, outputCol=o, k=2), "variance": lambda i, o: VarianceThresholdSelector(featuresCol=i, outputCol=o, varianceThreshold=1e-9),
}


@dataclass(frozen=True)
class Predict:
    task: str
    target: str
    table: str
    features: tuple[str, ...]
    where: str | None = None
    model: str | None = None


def parse(statement: str) -> Predict:
    m = _FORM.match(statement)
    if not m:
        raise ValueError(f"not a PREDICT statement: {statement.strip()[:80]}")
    names = [] if m[5].strip() in ("*", "") else [c.strip() for c in m[5].split(",")]
    if any(not c for c in names):
        raise ValueError("PREDICT: a column is missing after TRAIN ON")
    return Predict(m[1].lower(), m[2], m[3], tuple(names), m[4], m[6])


def steps_of(df: DataFrame, features: Sequence[str], steps: Sequence[str] = ("standard",), one_hot: bool = False) -> list[Estimator]:
    """From columns to `__x`: texts indexed (unknown ones apart) or one-hot, numbers imputed by their mean, then the named steps."""
    texts = [c for c in features if isinstance(df.schema[c].dataType, T.StringType)]
    numbers = [c for c in features if c not in texts]
    out: list = []
    if texts:
        out.append(StringIndexer(inputCols=texts, outputCols=[f"{c}__i" for c in texts], handleInvalid="keep"))
        if one_hot:
            out.append(OneHotEncoder(inputCols=[f"{c}__i" for c in texts], outputCols=[f"{c}__h" for c in texts], handleInvalid="keep"))
    if numbers:
        out.append(Imputer(inputCols=numbers, outputCols=[f"{c}__n" for c in numbers], strategy="mean"))
    out.append(VectorAssembler(inputCols=[f"{c}__{'h' if one_hot else 'i'}" for c in texts] + [f"{c}__n" for c in numbers], outputCol="__v0", handleInvalid="keep"))
    for k, name in enumerate(steps):
        out.append(STEPS[name](f"__v{k}", "__x" if k == len(steps) - 1 else f"__v{k + 1}"))
    if not steps:
        out[-1].setOutputCol("__x")
    return out


def fitted(df: DataFrame, target: str, features: Sequence[str], task: str, model: str, steps: Sequence[str] = ("standard",), one_hot: bool = False) -> PipelineModel:
    """A pipeline trained on the rows that have a target. Preparation and learner are fitted on those rows only."""
    learners = CLASSIFIERS if task == "class" else REGRESSORS
    if model not in learners:
        raise ValueError(f"PREDICT {task.upper()}: no learner is called {model}; there are {', '.join(sorted(learners))}")
    rows = typed(df, features).withColumn("__y", F.col(target).cast("double")).where("__y is not null")
    prepared = Pipeline(stages=steps_of(df, features, steps, one_hot)).fit(rows)
    wide, kinds = 0, 2
    if model == "mlp":  # it must know its layers
        ready = prepared.transform(rows).select("__x", "__y")
        wide = ready.first()["__x"].size
        kinds = int(ready.agg(F.max("__y")).first()[0]) + 1
    learner = learners[model](wide, kinds)
    return PipelineModel(stages=[*prepared.stages, learner.fit(prepared.transform(rows))])


def _shown(model: PipelineModel, df: DataFrame, features: Sequence[str], task: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    linear = as_columns(model, features)
    if linear is not None:
        return df.select(*df.columns, linear[0].alias("result"), *([linear[1].alias("debug_value")] if linear[1] is not None else []))
    out = model.transform(typed(df, features))
    scored = next((c for c in ("__raw_score", "rawPrediction") if c in out.columns and c not in df.columns), None)
    raw = [vector_to_array(scored)[1].alias("debug_value")] if task == "class" and scored else []
    # the target and the other columns come back as they were
    return out.select(*df.columns, F.col("result").cast("double").alias("result"), *raw)


def predict_sql(spark: SparkSession, statement: str, registry: Registry | None = None) -> DataFrame:
    """The rows of a PREDICT statement's table with `result`; a model is trained if the registry has none for it."""
    p = parse(statement)
    df = spark.table(p.table)
    missing = [c for c in (p.target, *p.features) if c not in df.columns]
    if missing:
        raise ValueError(f"PREDICT: {p.table} has no column {', '.join(missing)}")
    name = p.model or spark.conf.get(SETTING, None) or ("logistic" if p.task == "class" else "linear")
    registry = registry or Registry.of(spark)
    features = feature_columns(df, p.target, p.features or None)
    model = registry.load_or(p.table, features, p.target, f"{p.task}:{name}", lambda: fitted(df, p.target, features, p.task, name))
    return _shown(model, df.where(p.where) if p.where else df, features, p.task)


def train_model(spark: SparkSession, registry: Registry, model: str, table: str, features: Sequence[str], target: str, task: str = "value", **options) -> bool:
    """Trains a model and registers it; the newest of its key is the one that is found."""
    df = spark.table(table)
    registry.save(fitted(df, target, list(features), task, model, **options), table, list(features), target, f"{task}:{model}")
    return True


def infer(spark: SparkSession, registry: Registry, model: str, table: str, features: Sequence[str], target: str, task: str = "value") -> DataFrame:
    """The table's rows by a registered model; it is an error if there is none."""
    path = registry.lookup(table, list(features), target, f"{task}:{model}")
    if path is None:
        raise LookupError(f"no model {model} of {target} in {table}")
    return _shown(PipelineModel.load(path), spark.table(table), list(features), task)


def finetune(spark: SparkSession, registry: Registry, model: str, table: str, new_rows: DataFrame, features: Sequence[str], target: str, task: str = "value") -> bool:
    """A newer model that keeps the preparation of the last one and trains only the learner, on new rows."""
    path = registry.lookup(table, list(features), target, f"{task}:{model}")
    if path is None:
        raise LookupError(f"no model {model} of {target} in {table}")
    old = PipelineModel.load(path)
    frozen = PipelineModel(stages=old.stages[:-1])
    rows = typed(new_rows, features).withColumn("__y", F.col(target).cast("double")).where("__y is not null")
    learner = (CLASSIFIERS if task == "class" else REGRESSORS)[model](0, 2)
    registry.save(PipelineModel(stages=[*old.stages[:-1], learner.fit(frozen.transform(rows))]), table, list(features), target, f"{task}:{model}")
    return True


#: The orders of preparation that are tried.
PIPELINES = (("standard",), ("minmax",), ("robust",), ("standard", "polynomial"), ("variance", "standard"), ("maxabs", "pca"))


def best_pipeline(df: DataFrame, target: str, features: Sequence[str], task: str = "class", models: Sequence[str] = ("logistic", "tree"), pipelines: Sequence[Sequence[str]] = PIPELINES, held: float = 0.25, seed: int = 7) -> DataFrame:
    """steps, model, score of each combination, the best first: accuracy (classes) or -MSE (values) on rows that training doesn't see."""
    fit_rows, test_rows = df.randomSplit([1 - held, held], seed=seed)
    out = []
    for steps in pipelines:
        for name in models:
            made = fitted(fit_rows, target, features, task, name, steps)
            shown = _shown(made, test_rows.where(F.col(target).isNotNull()), features, task)
            error = F.col("result") - F.col(target).cast("double")
            score = shown.agg((F.avg((error == 0).cast("double")) if task == "class" else -F.avg(error * error)).alias("s")).first()["s"]
            out.append(("+".join(steps), name, float(score or 0.0)))
    return df.sparkSession.createDataFrame(sorted(out, key=lambda r: -r[2]), "steps string, model string, score double")


__all__ = ["Interaction", "QuantileDiscretizer", "best_pipeline", "finetune", "infer", "parse", "predict_sql", "train_model"]
