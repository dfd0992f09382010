"""Classifiers over the session table and over sequences."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.operators import boosting, recurrent
from sessionloom.operators import forest as deep
from sessionloom.operators.clean import string_columns
from sessionloom.operators.sampling import class_sizes
from sessionloom.operators.sequences import fit_step_scaler, standardise_steps
from sessionloom.operators.structure import numeric_columns
from sessionloom.plans.cuts import quantiles
from sessionloom.schema import MODEL_ID_COLUMNS
from sessionloom.session import materialise

SEED = 42


def model_input(df: DataFrame, drop: list[str] = MODEL_ID_COLUMNS) -> tuple[DataFrame, list[str], list[str]]:
    """(frame without ids and metadata, numeric features, categorical features)."""
    kept = df.drop(*drop)
    return kept, numeric_columns(kept, ("label", "weight")), string_columns(kept)


def class_weights(df: DataFrame, name: str = "weight") -> DataFrame:
    """Balanced weight n / (k * n_c) on every row; the k weights become one CASE."""
    sizes = class_sizes(df)
    n, k = sum(sizes.values()), len(sizes)
    out = None
    for c, size in sizes.items():
        w = n / (k * size)
        out = F.when(F.col("label") == c, w) if out is None else out.when(F.col("label") == c, w)
    return df.withColumn(name, out)


def most_frequent(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """Most frequent text per column, the smallest on ties; 'unknown' where there is none."""
    fills = {}
    for c in columns:
        top = df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n")).orderBy(F.desc("n"), c).limit(1).collect()
        fills[c] = top[0][0] if top else "unknown"
    return fills


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def fill_stage(df: DataFrame, numeric: list[str], texts: dict[str, str], scale: bool = False) -> SQLTransformer:
    """Stage of a saved pipeline: exact medians for missing numbers, given texts for missing categories.

    ``scale`` also subtracts the median and divides by the interquartile range, a range of zero by 1.
    """
    cuts = quantiles(df, numeric, [0.25, 0.5, 0.75]) if numeric else {}
    parts = []
    for c in numeric:
        low, middle, high = (q if q is not None else 0.0 for q in cuts[c])
        number = f"coalesce(nanvl(CAST(`{c}` AS DOUBLE), NULL), CAST('{middle!r}' AS DOUBLE))"
        if scale:
            number = f"({number} - CAST('{middle!r}' AS DOUBLE)) / CAST('{(high - low) or 1.0!r}' AS DOUBLE)"
        parts.append(f"{number} AS `{c}__filled`")
    parts += [f"coalesce(CAST(`{c}` AS STRING), {_text(fill)}) AS `{c}__text`" for c, fill in texts.items()]
    return SQLTransformer(statement=f"SELECT {', '.join(['*', *parts])} FROM __THIS__")


def encoder_stages(df: DataFrame, numeric: list[str], texts: dict[str, str], scale: bool = False) -> list:
    """Filling, one-hot codes of the known values (an unknown value has none), one feature vector."""
    stages: list = [fill_stage(df, numeric, texts, scale)]
    inputs = []
    if numeric:
        stages.append(VectorAssembler(inputCols=[f"{c}__filled" for c in numeric], outputCol="numeric", handleInvalid="keep"))
        inputs.append("numeric")
    if texts:
        index, hot = [f"{c}__index" for c in texts], [f"{c}__hot" for c in texts]
        # the slot for unknown values is the last one, which the encoder drops
        stages.append(StringIndexer(inputCols=[f"{c}__text" for c in texts], outputCols=index, handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=index, outputCols=hot, handleInvalid="error", dropLast=True))
        inputs += hot
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep"))
    return stages


def preprocessing_model(df: DataFrame, scale: bool = True, exclude: tuple[str, ...] = ("bot_likelihood_score", "anomaly_score")) -> PipelineModel:
    """Numeric: impute and robust-scale; categorical: 'unknown' and one-hot; the rest dropped."""
    kept, numeric, categorical = model_input(df)
    numeric = [c for c in numeric if c not in exclude]
    return Pipeline(stages=encoder_stages(kept, numeric, dict.fromkeys(categorical, "unknown"), scale)).fit(kept)


def fit_classifier(train: DataFrame, classifier, weight: bool = True) -> PipelineModel:
    """Encoders and classifier fitted on training rows only; the fills are part of the model."""
    kept, numeric, categorical = model_input(train)
    kept = kept.withColumn("label", F.col("label").cast("double"))
    if weight:
        kept = class_weights(kept)
        classifier = classifier.copy().setWeightCol("weight")
    return Pipeline(stages=[*encoder_stages(kept, numeric, most_frequent(kept, categorical)), classifier]).fit(kept)


def apply_classifier(model: PipelineModel, df: DataFrame) -> DataFrame:
    kinds = [c for c in numeric_columns(df) if c != "label"]
    ready = df.withColumns({c: F.col(c).cast("double") for c in [*kinds, "label"]})
    return with_probabilities(model.transform(ready))


def random_forest(trees: int = 300, depth: int = 15) -> RandomForestClassifier:
    """Spark's forest; its node statistics may take a gigabyte at once, so deep levels need fewer passes."""
    return RandomForestClassifier(
        labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, seed=SEED, maxMemoryInMB=1024, cacheNodeIds=True, checkpointInterval=10
    )


@dataclass
class EncodedModel:
    """Encoders fitted on training rows and a model over the encoded features."""

    encoders: PipelineModel
    names: list[str]
    trees: boosting.BoostedTrees

    def apply(self, df: DataFrame) -> DataFrame:
        kinds = [c for c in numeric_columns(df) if c != "label"]
        ready = df.withColumns({c: F.col(c).cast("double") for c in [*kinds, "label"]})
        return self.trees.transform(_arrays(self.encoders.transform(ready)).select(*df.columns, "feature_array"))


def _arrays(df: DataFrame) -> DataFrame:
    return df.withColumn("feature_array", vector_to_array("features"))


def fit_boosted(train: DataFrame, settings: boosting.Boosting, weight: bool = True, task_rows: int = boosting.TASK_ROWS) -> EncodedModel:
    """Encoders and softmax boosting fitted on training rows only, classes weighted alike unless told otherwise."""
    kept, numeric, categorical = model_input(train)
    kept = class_weights(kept) if weight else kept.withColumn("weight", F.lit(1.0))
    encoders = Pipeline(stages=encoder_stages(kept, numeric, most_frequent(kept, categorical))).fit(kept)
    ready = encoders.transform(kept)
    trees = boosting.fit(_arrays(ready).select("feature_array", "label", "weight"), settings, task_rows)
    return EncodedModel(encoders, slot_names(ready), trees)


@dataclass
class EncodedForest:
    encoders: PipelineModel
    forest: deep.Forest

    def apply(self, df: DataFrame) -> DataFrame:
        kinds = [c for c in numeric_columns(df) if c != "label"]
        ready = df.withColumns({c: F.col(c).cast("double") for c in [*kinds, "label"]})
        return self.forest.transform(_arrays(self.encoders.transform(ready)).select(*df.columns, "feature_array"))


def fit_forest(train: DataFrame, trees: int = 300, weight: bool = True, task_rows: int = deep.TASK_ROWS) -> EncodedForest:
    """Encoders and a forest without a depth limit fitted on training rows only."""
    kept, numeric, categorical = model_input(train)
    kept = class_weights(kept) if weight else kept.withColumn("weight", F.lit(1.0))
    encoders = Pipeline(stages=encoder_stages(kept, numeric, most_frequent(kept, categorical))).fit(kept)
    return EncodedForest(encoders, deep.fit(_arrays(encoders.transform(kept)).select("feature_array", "label", "weight"), trees, SEED, task_rows))


def save_boosted(model: EncodedModel, spark, path: str) -> None:
    model.encoders.write().overwrite().save(f"{path}/encoders")
    boosting.save(model.trees, spark, f"{path}/model")
    spark.createDataFrame(list(enumerate(model.names)), "slot int, name string").coalesce(1).write.mode("overwrite").parquet(f"{path}/names")


def load_boosted(spark, path: str) -> EncodedModel:
    names = [r["name"] for r in spark.read.parquet(f"{path}/names").orderBy("slot").collect()]
    return EncodedModel(PipelineModel.load(f"{path}/encoders"), names, boosting.load(spark, f"{path}/model"))


def fit_sequences(train: DataFrame, width: int, column: str = "steps", **settings) -> tuple[recurrent.RecurrentModel, DataFrame]:
    """The recurrent classifier on standardised sequences of equal length with class weights, and the scaler of its training rows."""
    scaler = materialise(fit_step_scaler(train, width, column), "step-scaler")
    ready = standardise_steps(class_weights(train), scaler, column)
    return recurrent.fit(ready.select(F.col(column).alias("steps"), "label", "weight"), **settings), scaler


def with_probabilities(scored: DataFrame) -> DataFrame:
    """``probability_array``: the model's probabilities as an array."""
    return scored.withColumn("probability_array", vector_to_array("probability"))


def soft_vote(first: DataFrame, second: DataFrame, key: str, weights: tuple[float, float] = (0.7, 0.3)) -> DataFrame:
    """Weighted mean of two probability arrays and the first class of the largest value."""
    a = first.select(key, F.col("probability_array").alias("pa"))
    b = second.select(key, F.col("probability_array").alias("pb"))
    mixed = F.zip_with("pa", "pb", lambda x, y: weights[0] * x + weights[1] * y)
    out = a.join(b, key).select(key, mixed.alias("probability_array"))
    return out.withColumn("prediction", predicted_class(F.col("probability_array")))


def predicted_class(probabilities):
    return (F.array_position(probabilities, F.array_max(probabilities)) - 1).cast("int")


def slot_names(transformed: DataFrame) -> list[str]:
    """Names of the feature vector's slots from the assembler's metadata."""
    attrs = transformed.schema["features"].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a["name"] for kind in attrs.values() for a in kind}
    return [names.get(i, str(i)) for i in range(max(names, default=-1) + 1)]


def _top(spark, names: list[str], values, k: int) -> DataFrame:
    rows = sorted(zip(names, map(float, values)), key=lambda r: (-r[1], r[0]))[:k]
    return spark.createDataFrame(rows, "feature string, importance double")


def feature_importance(model: PipelineModel, transformed: DataFrame, k: int = 20) -> DataFrame:
    """Top-k importances of a forest with slot names."""
    return _top(transformed.sparkSession, slot_names(transformed), model.stages[-1].featureImportances.toArray(), k)


def boosted_importance(model: EncodedModel, spark, k: int = 20) -> DataFrame:
    """Top-k shares of the gain of boosted trees with slot names."""
    return _top(spark, model.names, model.trees.importance(), k)


def best_model(metrics: DataFrame) -> DataFrame:
    """Largest f1, first position on ties (columns model, position, f1)."""
    return metrics.orderBy(F.desc("f1"), "position").limit(1)


def compare_models(frames: dict[str, DataFrame]) -> DataFrame:
    """Stack per-model metric rows in the given order."""
    parts = [m.select(F.lit(name).alias("model"), F.lit(i).alias("position"), "*") for i, (name, m) in enumerate(frames.items())]
    return reduce(DataFrame.unionByName, parts)
