"""A forest on rows dealt out by node follows the rules of Spark's forest."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.functions import fixed
from dossier.operators import deal, forest, model


@pytest.fixture
def rows(spark):
    rng = np.random.default_rng(5)
    x = rng.random((1500, 9)).round(3)
    x[:, 0] = rng.choice([0.1, 0.4, 0.7], 1500)
    x[:, 1] = 0.5  # one value: never cut
    noisy = x[:, 2] + x[:, 5] + rng.normal(0, 0.1, 1500)
    labels = [fixed.LABELS[i] for i in np.digitize(noisy, [0.5, 0.9, 1.3])]
    schema = "file_id long, boot_label string, " + ", ".join(f"{s} double" for s in fixed.SIGNALS)
    rows = [(i, label, *own) for i, (label, own) in enumerate(zip(labels, x.tolist()))]
    return spark.createDataFrame(rows + rows[:100], schema).repartition(3)  # some rows come twice


@pytest.mark.parametrize("small", [150, 10_000])
def test_many_rows_are_dealt_out_and_not_sent_as_tables(rows, monkeypatch, small):
    class Never:
        def __init__(self, **_):
            raise AssertionError("Spark's forest sends a table per node and partition")

    want = model.train_importance_model(rows.filter("file_id % 4 > 0"), trees=20, depth=8)
    monkeypatch.setattr(forest, "RandomForestClassifier", Never)
    monkeypatch.setattr(forest, "DEAL", 1000)
    monkeypatch.setattr(deal, "SMALL", small)
    monkeypatch.setattr(deal, "AT_ONCE", 7)
    got = model.train_importance_model(rows.filter("file_id % 4 > 0"), trees=20, depth=8)
    assert len(got.trees) == 20 and len({t.threshold.tobytes() for t in got.trees}) == 20
    held = rows.filter("file_id % 4 = 0")

    def quality(m):
        right = (model._arg_max_label(F.col("probability")) == F.col("boot_label")).cast("double")
        return model.probabilities(held, m).agg(F.avg(right), F.avg(F.array_max("probability"))).first()

    assert quality(got)[0] > quality(want)[0] - 0.04 and abs(quality(got)[1] - quality(want)[1]) < 0.04
    assert np.abs(got.importances - want.importances).max() < 0.06 and got.importances.sum() == pytest.approx(1)
    assert got.importances[1] == 0


@pytest.mark.parametrize("small", [100, 10_000])
def test_leaves_hold_the_shares_of_the_rows_drawn(spark, rows, monkeypatch, small):
    monkeypatch.setattr(deal, "SMALL", small)
    seen = {}
    keep = deal.cuts

    def cuts(written):
        seen["rows"] = written.toPandas()
        return keep(written)

    monkeypatch.setattr(deal, "cuts", cuts)
    train = model.features(rows).withColumns({
        "_class": F.when(F.col("boot_label") == "KEEP", 3.0).when(F.col("boot_label") == "REVIEW", 1.0).otherwise(0.0),
        "_weight": F.when(F.col("boot_label") == "KEEP", 2.5).otherwise(0.75)})
    trees, importances = deal.grow_dealt(train, 3, 6, 4, 42)
    assert importances.sum() == pytest.approx(3)
    x, own = np.stack(seen["rows"]["x"]), seen["rows"]
    for t, tree in enumerate(trees):
        drawn = deal.draws(own["id"].to_numpy(), t, 42)
        assert 0.9 < drawn.mean() < 1.1 and (drawn == 0).mean() == pytest.approx(0.37, abs=0.05)
        leaf = tree.leaves(x)
        sums = np.zeros((len(tree.left), 4))
        np.add.at(sums, (leaf, own["class"]), drawn * own["weight"])
        at = np.unique(leaf[drawn > 0])
        assert np.allclose(tree.probability[at], sums[at] / sums[at].sum(1, keepdims=True))
        assert set(at) == set(np.flatnonzero(tree.left < 0))
        assert np.bincount(leaf, drawn)[at].min() >= 4
        inner = np.flatnonzero(tree.left >= 0)
        best = tree.probability.argmax(1)
        a, b = tree.left[inner], tree.right[inner]
        assert not ((tree.left[a] < 0) & (tree.left[b] < 0) & (best[a] == best[b])).any()
        level = np.zeros(len(tree.left), int)
        todo = [(0, 0)]
        while todo:
            node, level[node] = todo.pop()
            if tree.left[node] >= 0:
                todo += [(tree.left[node], level[node] + 1), (tree.right[node], level[node] + 1)]
        assert level.max() <= 6


def test_a_row_of_unknown_label_is_an_error(rows, monkeypatch):
    monkeypatch.setattr(forest, "DEAL", 0)
    with pytest.raises(Exception, match="known label"):
        model.train_importance_model(rows.withColumn("boot_label", F.lit("OTHER")), trees=1, depth=2)
