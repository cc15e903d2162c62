"""The Shapley walk adds up its leaves without a row of (signal, class) for each of them."""

import tracemalloc

import numpy as np

from dossier.operators import deal, shapley


def test_leaves_are_added_by_signal_and_class():
    rng = np.random.default_rng(2)
    rows = np.zeros(20_000, deal.ROW)
    rows["bins"], rows["class"], rows["drawn"], rows["weight"] = rng.integers(0, 32, (20_000, 9)), rng.integers(0, 4, 20_000), 1, 1.0
    nodes, _ = deal.subtree(rows, 12, 2, (1, 2))
    tree = deal._tree(nodes)
    tree.probability = nodes["sums"] / nodes["sums"].sum(1, keepdims=True)
    x, background = rng.integers(0, 32, (2000, 9)).astype(float), np.full(9, 15.0)
    tracemalloc.start()
    got = shapley.shapley_values(x, background, [tree, tree])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # what all signals get together is the file's probability less that of the background
    want = tree.probability[tree.leaves(x)] - tree.probability[tree.leaves(background[None])]
    assert np.allclose(got.sum(1), want) and not shapley.shapley_values(x[:0], background, [tree]).size
    assert peak < 4e6
