"""Exact Shapley values of a forest against one background row, in closed form.

A leaf counts for a coalition if the signals on which the file goes to the leaf
and the background does not (set A) are all present, and those on which only the
background goes there (set B) are all absent.  The Shapley values of that game
depend on |A| and |B| alone, so one walk through each tree gives all values; the
walk splits only where file and background part.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import fixed
from .forest import Forest, Tree

#: Rows of one walk.
STEP = 2000


def _weights(signals: int) -> tuple[np.ndarray, np.ndarray]:
    """Value of a member of A and of B by (|A|, |B|)."""
    inside, outside = np.zeros((signals + 1,) * 2), np.zeros((signals + 1,) * 2)
    for a in range(signals + 1):
        for b in range(signals + 1 - a):
            if a:
                inside[a, b] = factorial(a - 1) * factorial(b) / factorial(a + b)
            if b:
                outside[a, b] = -factorial(a) * factorial(b - 1) / factorial(a + b)
    return inside, outside


def _add(total: np.ndarray, tree: Tree, row: np.ndarray, node: np.ndarray, present: np.ndarray, absent: np.ndarray,
         worth: np.ndarray, ones: np.ndarray) -> None:
    """Add what the leaves give to the signals in A or B; the others get nothing from them."""
    worth = worth[:, ones[present], ones[absent]]
    for signal in range(total.shape[1]):
        own = np.flatnonzero((present | absent) >> signal & 1)
        if not len(own):
            continue
        rows, at = row[own], node[own]
        value = worth[absent[own] >> signal & 1, own]
        for c in range(total.shape[2]):
            total[:, signal, c] += np.bincount(rows, value * tree.probability[at, c], len(total))


def shapley_values(x: np.ndarray, background: np.ndarray, trees: list[Tree]) -> np.ndarray:
    """(row, signal, class) values of the forest's mean probabilities."""
    signals = x.shape[1]
    worth = np.stack(_weights(signals))
    ones = np.array([m.bit_count() for m in range(1 << signals)])
    bits = 1 << np.arange(signals)
    total = np.zeros((len(x), signals, trees[0].probability.shape[1]))
    for tree in trees:
        ends = []
        row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        present = absent = np.zeros(len(x), np.int64)
        while len(row):
            leaf = tree.left[node] < 0
            if leaf.any():
                ends.append((row[leaf], node[leaf], present[leaf], absent[leaf]))
                row, node, present, absent = row[~leaf], node[~leaf], present[~leaf], absent[~leaf]
            feature = tree.feature[node]
            own = x[row, feature] <= tree.threshold[node]
            other = background[feature] <= tree.threshold[node]
            bit = bits[feature]
            held, dropped = (present & bit) > 0, (absent & bit) > 0
            parts = (own != other) & ~held & ~dropped
            goes_left = np.where(dropped, other, own)
            ahead = np.where(goes_left, tree.left[node], tree.right[node])
            aside = np.where(other, tree.left[node], tree.right[node])[parts]
            row, node = np.concatenate([row, row[parts]]), np.concatenate([ahead, aside])
            absent = np.concatenate([absent, absent[parts] | bit[parts]])
            present = np.concatenate([np.where(parts, present | bit, present), present[parts]])
        if ends:
            _add(total, tree, *map(np.concatenate, zip(*ends)), worth, ones)
    return total / len(trees)


def attribution_shapley(rows: DataFrame, model: Forest) -> DataFrame:
    """Add ``attribution``: mean absolute Shapley value of each signal over the classes.

    Absent signals stand at their corpus mean.  Every file is judged the same
    way; narrow but for the means.
    """
    spark = rows.sparkSession
    filled = rows.fillna(0.0, list(fixed.SIGNALS)).drop("attribution")
    means = filled.agg(*[F.avg(s) for s in fixed.SIGNALS]).first()
    background = np.array([m or 0.0 for m in means])
    trees = spark.sparkContext.broadcast(model.trees)
    names = filled.columns

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, STEP):
                part = batch.slice(begin, STEP)
                x = np.stack([part.column(s).to_numpy(zero_copy_only=False) for s in fixed.SIGNALS], 1)
                values = np.abs(shapley_values(x, background, trees.value)).mean(2)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(list(values), pa.list_(pa.float64()))], names=[*part.schema.names, "attribution"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in filled.schema.fields)
    return filled.mapInArrow(walk, f"{kinds}, attribution array<double>").select(*names, "attribution")
