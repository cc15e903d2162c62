"""A random forest grown in parts of trees and held as arrays.

Up to ``DEAL`` rows Spark grows ``PART`` trees at a time and saves them to the
shared folder; the driver then keeps their nodes as arrays, about fifty bytes a
node, and lets the part go.  What it holds while a part grows does not depend on
the number of trees.  More rows are dealt out by node (``deal``).  A file's
probabilities are the mean over all trees of those of its leaf.
"""

from __future__ import annotations

import gc
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions import fixed
from ..functions.storage import shared_folder, written
from ..functions.vector import as_list_column, as_matrix
from .deal import Tree, grow_dealt

#: Trees that grow at once.
PART = 60
#: Rows up to which Spark's own forest is grown.
DEAL = 20_000


@dataclass
class Forest:
    trees: list[Tree]
    importances: np.ndarray

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(row, class): summed over the trees and divided by their number."""
        total = np.zeros((len(x), len(fixed.LABELS)))
        for tree in self.trees:
            total += tree.probability[tree.leaves(x)]
        return total / len(self.trees)

    def predictProbability(self, x: DenseVector) -> DenseVector:  # noqa: N802  as of Spark's models
        return Vectors.dense(self.probabilities(np.asarray(x.toArray())[None, :])[0])

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802
        return Vectors.dense(self.importances)

    def column(self, spark: SparkSession) -> Column:
        """Class probabilities of a row from its signals; missing ones count as 0."""
        shared = spark.sparkContext.broadcast(self)

        @F.arrow_udf(ArrayType(DoubleType()))
        def score(signals: pa.Array) -> pa.Array:
            return as_list_column(shared.value.probabilities(as_matrix(signals))) if len(signals) else pa.array([], pa.list_(pa.float64()))

        return score(F.array(*[F.coalesce(F.col(s).cast("double"), F.lit(0.0)) for s in fixed.SIGNALS]))

    def save(self, spark: SparkSession, path: str) -> None:
        """Nodes and importances as tables below ``path``, replacing what is there."""
        nodes = pa.Table.from_batches([pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(t.left), i)), pa.array(np.arange(len(t.left))), pa.array(t.feature.astype(np.int64)), pa.array(t.threshold),
             pa.array(t.left.astype(np.int64)), pa.array(t.right.astype(np.int64)), as_list_column(t.probability)],
            names=["tree", "node", "feature", "threshold", "left", "right", "probability"]) for i, t in enumerate(self.trees)])
        spark.createDataFrame(nodes).write.mode("overwrite").parquet(f"{path}/nodes")
        spark.createDataFrame([(self.importances.tolist(),)], "importances array<double>").write.mode("overwrite").parquet(
            f"{path}/importances")


def load(spark: SparkSession, path: str) -> Forest:
    """A forest as ``Forest.save`` has written it."""
    table = spark.read.parquet(f"{path}/nodes").orderBy("tree", "node").toArrow()
    which = table["tree"].to_numpy()
    columns = [table[c].to_numpy() for c in ("feature", "threshold", "left", "right")] + [as_matrix(table["probability"])]
    edges = [0, *(np.flatnonzero(np.diff(which)) + 1).tolist(), len(which)]
    trees = [Tree(*(c[a:b] for c in columns)) for a, b in zip(edges, edges[1:])]
    return Forest(trees, np.array(spark.read.parquet(f"{path}/importances").first()["importances"]))


def _saved_trees(spark: SparkSession, folder: str) -> list[Tree]:
    """The trees of a model that Spark has saved."""
    table = spark.read.parquet(f"{folder}/data").select("treeID", "nodeData.*").orderBy("treeID", "id").select(
        "treeID", F.col("split.featureIndex").alias("feature"),
        F.coalesce(F.get("split.leftCategoriesOrThreshold", F.lit(0)), F.lit(0.0)).alias("threshold"),
        "leftChild", "rightChild", "impurityStats").toArrow()
    stats = as_matrix(table["impurityStats"])
    stats = np.pad(stats, ((0, 0), (0, max(0, len(fixed.LABELS) - stats.shape[1]))))[:, :len(fixed.LABELS)]
    columns = [table[c].to_numpy() for c in ("feature", "threshold", "leftChild", "rightChild")]
    columns.append(stats / np.maximum(stats.sum(1, keepdims=True), 1e-300))
    which = table["treeID"].to_numpy()
    edges = [0, *(np.flatnonzero(np.diff(which)) + 1).tolist(), len(which)]
    return [Tree(*(np.ascontiguousarray(c[a:b]) for c in columns)) for a, b in zip(edges, edges[1:])]


def grow(train: DataFrame, trees: int, depth: int, leaf: int, seed: int, part: int | None = None) -> Forest:
    """A forest on (features, _class, _weight), ``part`` trees at a time; part i has the seed ``seed`` + i.

    More than ``DEAL`` rows are dealt out by node: the same rules, other draws.
    """
    spark, part = train.sparkSession, part or PART
    rows = written(train.select("features", "_class", "_weight"), "forest-rows")  # read by every part
    if rows.count() > DEAL:
        grown, importances = grow_dealt(rows, trees, depth, leaf, seed)
        return Forest(grown, importances / max(importances.sum(), 1e-300))
    folder = f"{shared_folder(spark).rstrip('/')}/forest-{uuid.uuid4().hex}"
    grown: list[Tree] = []
    importances = np.zeros(len(fixed.SIGNALS))
    for i, begin in enumerate(range(0, trees, part)):
        n = min(part, trees - begin)
        model = RandomForestClassifier(
            featuresCol="features", labelCol="_class", weightCol="_weight", numTrees=n, maxDepth=depth,
            minInstancesPerNode=leaf, seed=seed + i, maxMemoryInMB=256,
        ).fit(rows)
        importances += n * model.featureImportances.toArray()
        model.write().save(f"{folder}/part-{i}")
        del model
        gc.collect()  # lets the JVM's copy go too
        grown += _saved_trees(spark, f"{folder}/part-{i}")
    return Forest(grown, importances / max(importances.sum(), 1e-300))
