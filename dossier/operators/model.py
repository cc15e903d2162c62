"""Importance model: forest training, scoring, attribution."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import fixed, rules
from .forest import Forest, grow
from .keyed import rank_by_digest
from .shapley import attribution_shapley

# fixed values: forest settings
TREES, DEPTH, LEAF, SEED = 300, 15, 2, 42


def features(rows: DataFrame) -> DataFrame:
    filled = rows.fillna(0.0, list(fixed.SIGNALS))
    return VectorAssembler(inputCols=list(fixed.SIGNALS), outputCol="features").transform(filled)


def class_weights(rows: DataFrame, label_col: str = "label") -> DataFrame:
    """Balanced weight n / (classes * n_class) per label (at most four rows)."""
    counts = rows.groupBy(label_col).agg(F.count("*").alias("n"))
    everything = W.partitionBy()  # over the per-class rows only
    return counts.withColumn(
        "weight", F.sum("n").over(everything) / (F.count("*").over(everything) * F.col("n"))
    )


def train_importance_model(
    rows: DataFrame, label_col: str = "boot_label", trees: int = TREES, depth: int = DEPTH,
    seed: int = SEED,
) -> Forest:
    """Random forest on the nine signals with balanced class weights."""
    weights = class_weights(rows.select(F.col(label_col).alias("label")))
    train = features(rows).withColumn("_class", rules.label_index(F.col(label_col)).cast("double"))
    # One weight per label, four at most: the rows are never dealt out by label.
    train = train.join(
        F.broadcast(weights.select(F.col("label").alias(label_col), F.col("weight").alias("_weight"))), label_col
    )
    return grow(train, trees, depth, LEAF, seed)


def train_candidate(
    rows: DataFrame, label_col: str = "human_label", trees: int = TREES, depth: int = DEPTH,
) -> Forest:
    """The forest of a retraining round: the same settings on human labels."""
    return train_importance_model(rows, label_col, trees, depth)


def cross_validate(
    rows: DataFrame, label_col: str = "boot_label", trees: int = TREES, depth: int = DEPTH,
) -> DataFrame:
    """Accuracy per fold, min(5, n/2) folds with equal shares of each label; no rows under ten examples.

    Rows of a label are dealt to the folds in the order of a digest of the file id.
    """
    spark = rows.sparkSession
    n = rows.count()
    schema = "fold int, accuracy double"
    if n < 10:
        return spark.createDataFrame([], schema)
    folds = min(5, n // 2)
    folded = rank_by_digest(rows, label_col, "file_id").withColumn("_fold", F.pmod("_rank", F.lit(folds)).cast("int"))
    results = []
    for fold in range(folds):
        model = train_importance_model(folded.filter(F.col("_fold") != fold), label_col, trees, depth)
        held = probabilities(folded.filter(F.col("_fold") == fold), model)
        right = held.select(F.avg((_arg_max_label(F.col("probability")) == F.col(label_col)).cast("double"))).first()[0]
        results.append((fold, float(right)))
    return spark.createDataFrame(results, schema)


def probabilities(rows: DataFrame, model: Forest) -> DataFrame:
    """Add ``probability`` as four values by class id; classes never seen get 0.  Missing signals become 0."""
    return rows.fillna(0.0, list(fixed.SIGNALS)).withColumn("probability", model.column(rows.sparkSession))


def _importance(probability: Column) -> Column:
    total = F.lit(0.0)
    for i, midpoint in enumerate(fixed.CLASS_MIDPOINTS):
        total = total + F.get(probability, F.lit(i)) * F.lit(midpoint)
    return F.round(F.least(F.greatest(total, F.lit(0.0)), F.lit(100.0)), 2)


def _arg_max_label(probability: Column) -> Column:
    best = F.array_position(probability, F.array_max(probability)).cast("int")
    return F.element_at(F.array(*[F.lit(name) for name in fixed.LABELS]), best)


def score_from_probabilities(rows: DataFrame) -> DataFrame:
    """importance_score, label and confidence from a ``probability`` array."""
    p = F.col("probability")
    return rows.withColumns({
        "importance_score": _importance(p), "label": _arg_max_label(p), "confidence": F.array_max(p),
    })


def score_with_model(rows: DataFrame, model: Forest) -> DataFrame:
    return score_from_probabilities(probabilities(rows, model))


def decision_confidence(rows: DataFrame, model: Forest | None) -> DataFrame:
    """Add ``confidence``: largest class probability, 0.5 without a model."""
    if model is None:
        return rows.withColumn("confidence", F.lit(0.5))
    return probabilities(rows, model).withColumn("confidence", F.array_max("probability"))


def feature_importance(model: Forest, rows: DataFrame) -> DataFrame:
    """Importance per signal, 4 decimals (nine rows)."""
    values = [(name, round(float(v), 4)) for name, v in zip(fixed.SIGNALS, model.featureImportances.toArray())]
    return rows.sparkSession.createDataFrame(values, "signal string, importance double")


def attribution_proxy(rows: DataFrame) -> DataFrame:
    """Add ``attribution``: the nine signals min-max scaled over the corpus."""
    bounds = rows.agg(F.struct(*[
        F.struct(F.min(F.coalesce(s, F.lit(0.0))).alias("low"), F.max(F.coalesce(s, F.lit(0.0))).alias("high")).alias(s)
        for s in fixed.SIGNALS
    ])).scalar()
    scaled = rows.withColumn("_bounds", bounds)

    def share(name: str) -> Column:
        low, width = F.col(f"_bounds.{name}.low"), F.col(f"_bounds.{name}.high") - F.col(f"_bounds.{name}.low")
        value = F.coalesce(F.col(name), F.lit(0.0)) - low
        return F.when(width > 0, value / F.nullif(width, F.lit(0.0))).otherwise(value)

    return scaled.withColumn("attribution", F.array(*[share(s) for s in fixed.SIGNALS])).drop("_bounds")


def attributions(rows: DataFrame, model: Forest | None) -> DataFrame:
    """Shapley values of the model for every file; without a model every file gets the proxy."""
    return attribution_proxy(rows) if model is None else attribution_shapley(rows, model)
