"""Trees of a forest grown on rows dealt out by node.

A table of sums per node and partition is what Spark's own forest sends, and it
has more nodes the more rows there are.  Here only nodes of more than ``SMALL``
drawn rows are cut by such tables, added up over the partitions; the rows of a
smaller node are sent once, packed, to the task that grows all below it.  What is
sent follows rows x trees, and a task holds one node of at most ``SMALL`` rows.

The rules are those of Spark's forest: rows drawn with replacement (Poisson(1)),
three of nine signals per node, up to 31 cuts per signal, Gini gain on the
weights, ``leaf`` drawn rows at least on each side, and two leaves of one class
under one node become one.  Draws and signals depend on the seed, the tree and
the row or node, so every job sees the same ones.  Cuts come from all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import fixed
from ..functions.storage import written
from ..functions.vector import as_matrix

#: Drawn rows up to which a node is grown as a whole by one task.
SMALL = 50_000
#: Rows of a partition that are looked at together.
TOGETHER = 1 << 20
#: Nodes whose tables are held together; trees whose nodes go to the driver together.
NODES, AT_ONCE = 256, 60

SIGNALS, CLASSES, BINS = len(fixed.SIGNALS), len(fixed.LABELS), 32
TRIED = int(np.ceil(np.sqrt(SIGNALS)))
ROW = np.dtype([("bins", "u1", SIGNALS), ("class", "u1"), ("drawn", "u1"), ("weight", "<f8")])
NODE = np.dtype([("feature", "<i4"), ("cut", "<i4"), ("left", "<i4"), ("right", "<i4"), ("sums", "<f8", CLASSES)])
#: Chance of at most 0, 1, 2, ... draws.
_DRAWS = np.cumsum(np.exp(-1) / np.cumprod([1, *range(1, 16)]))


@dataclass
class Tree:
    """Nodes in arrays; a leaf has no child (-1)."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    probability: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row."""
        node = np.zeros(len(x), np.int64)
        inner = np.flatnonzero(self.left[node] >= 0)
        while len(inner):
            at = node[inner]
            goes_left = x[inner, self.feature[at]] <= self.threshold[at]
            node[inner] = np.where(goes_left, self.left[at], self.right[at])
            inner = inner[self.left[node[inner]] >= 0]
        return node


def draws(ids: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is drawn for a tree."""
    with np.errstate(over="ignore"):
        h = ids.astype(np.uint64)
        for salt in (seed, tree):  # splitmix64
            h = h + np.uint64(salt + 1) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(31))
    return np.searchsorted(_DRAWS, (h >> np.uint64(11)) * 2.0 ** -53, side="right").astype(np.uint8)


def _tried(nodes: int, *seed: int) -> np.ndarray:
    """The signals tried at each node."""
    return np.argpartition(np.random.default_rng(seed).random((nodes, SIGNALS)), TRIED - 1, axis=1)[:, :TRIED]


def _tables(rows: np.ndarray, node: np.ndarray, nodes: int, tried: np.ndarray) -> np.ndarray:
    """(class sums of weights and drawn rows, node, signal tried, bin)."""
    weight, cells = rows["weight"] * rows["drawn"], nodes * BINS
    bins, places, begin = rows["bins"], np.arange(len(rows)), rows["class"].astype(np.int64) * cells + node * BINS
    table = np.empty((CLASSES + 1, nodes, TRIED, BINS))
    for j in range(TRIED):
        own = bins[places, tried[node, j]]
        table[:CLASSES, :, j] = np.bincount(begin + own, weight, CLASSES * cells).reshape(CLASSES, nodes, BINS)
        table[CLASSES, :, j] = np.bincount(node * BINS + own, rows["drawn"], cells).reshape(nodes, BINS)
    return table


def _best(table: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each node the signal tried, the bin after which it is cut, and the gain; 0 where no cut is allowed."""
    left = table.cumsum(3)
    total, left = left[..., -1:], left[..., :-1]
    right = total - left

    def spread(sums: np.ndarray) -> np.ndarray:
        weight, squares = sums[0].copy(), sums[0] ** 2
        for one in sums[1:CLASSES]:
            weight += one
            squares += one * one
        return squares / np.maximum(weight, 1e-300)

    gain = (spread(left) + spread(right) - spread(total)) / np.maximum(total[:CLASSES].sum(0), 1e-300)
    gain[(left[CLASSES] < leaf) | (right[CLASSES] < leaf)] = 0
    flat = gain.reshape(table.shape[1], -1)
    at = flat.argmax(1)
    won = flat[np.arange(len(at)), at]
    return at // (BINS - 1), at % (BINS - 1), np.where(won > 1e-12, won, 0)


def _mixed(sums: np.ndarray) -> np.ndarray:
    """Whether nodes have more than one class."""
    return (sums > 0).sum(1) > 1


def _merged(nodes: np.ndarray) -> None:
    """Two leaves of one class under one node become one leaf; children come after their parents."""
    best = nodes["sums"].argmax(1)
    for i in np.flatnonzero(nodes["left"] >= 0)[::-1]:
        a, b = nodes["left"][i], nodes["right"][i]
        if nodes["left"][a] < 0 and nodes["left"][b] < 0 and best[a] == best[b]:
            nodes["left"][i] = nodes["right"][i] = -1


def _kept(nodes: np.ndarray) -> np.ndarray:
    """Which nodes can be reached from the first."""
    kept = np.zeros(len(nodes), bool)
    level = np.zeros(1, np.int64)
    while len(level):
        kept[level] = True
        inner = level[nodes["left"][level] >= 0]
        level = np.concatenate([nodes["left"][inner], nodes["right"][inner]])
    return kept


def subtree(rows: np.ndarray, depth: int, leaf: int, seed: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The nodes below one node, itself first, and the gain of each signal times the weight."""
    grown: list[np.ndarray] = []
    gains: list[np.ndarray] = []
    node, n, begun = np.zeros(len(rows), np.int64), 1, 0
    for level in range(depth + 1):
        sums = np.bincount(node * CLASSES + rows["class"], rows["weight"] * rows["drawn"], n * CLASSES).reshape(n, CLASSES)
        here = np.zeros(n, NODE)
        here["left"] = here["right"] = -1
        here["sums"] = sums
        won = np.zeros(n)
        drawn = np.bincount(node, rows["drawn"], n)
        asked = np.flatnonzero((drawn >= 2 * leaf) & _mixed(sums)) if level < depth else np.zeros(0, np.int64)
        tried = _tried(n, *seed, level)
        edges = np.searchsorted(node, np.arange(n + 1))  # rows are in the order of their nodes
        for begin in range(0, len(asked), NODES):
            some = asked[begin:begin + NODES]
            place = np.full(some[-1] - some[0] + 1, -1)
            place[some - some[0]] = np.arange(len(some))
            own = slice(edges[some[0]], edges[some[-1] + 1])
            at = place[node[own] - some[0]]
            signal, cut, gain = _best(_tables(rows[own][at >= 0], at[at >= 0], len(some), tried[some]), leaf)
            here["feature"][some], here["cut"][some], won[some] = tried[some, signal], cut, gain
        split = np.flatnonzero(won > 0)
        rank = np.full(n, -1)
        rank[split] = np.arange(len(split))
        here["left"][split] = begun + n + 2 * rank[split]
        here["right"][split] = here["left"][split] + 1
        grown.append(here)
        gains.append(won * sums.sum(1))
        going = rank[node] >= 0
        rows, node = rows[going], node[going]
        goes_right = rows["bins"][np.arange(len(rows)), here["feature"][node]] > here["cut"][node]
        node = 2 * rank[node] + goes_right
        order = np.argsort(node, kind="stable")
        rows, node = rows[order], node[order]
        begun, n = begun + n, 2 * len(split)
        if not n:
            break
    nodes, gain = np.concatenate(grown), np.concatenate(gains)
    _merged(nodes)
    kept = _kept(nodes)
    place = np.cumsum(kept) - 1
    nodes, gain = nodes[kept], gain[kept]
    inner = nodes["left"] >= 0
    for side in ("left", "right"):
        nodes[side][inner] = place[nodes[side][inner]]
    return nodes, np.bincount(nodes["feature"][inner], gain[inner], SIGNALS)


def cuts(rows: DataFrame) -> list[np.ndarray]:
    """Up to 31 cuts per signal: between all its values if there are few, else at 1/32, 2/32, ... of the rows."""
    values = rows.select(F.posexplode("x").alias("signal", "value")).filter("value IS NOT NULL")
    some = values.distinct().withColumn("_n", F.row_number().over(W.partitionBy("signal").orderBy("value"))).filter(
        F.col("_n") <= BINS + 1).collect()
    shares = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    parts = {r["signal"]: r["parts"] for r in values.groupBy("signal").agg(
        F.percentile_approx("value", shares, 100_000).alias("parts")).collect()}
    found = []
    for signal in range(SIGNALS):
        few = np.array(sorted(r["value"] for r in some if r["signal"] == signal))
        found.append((few[1:] + few[:-1]) / 2 if len(few) <= BINS else np.unique(parts[signal]))
    return found


def _in_bins(batches: Iterator[pa.RecordBatch], edges: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and packed rows of a partition, ``TOGETHER`` at most at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        x = as_matrix(batch.column("x"))
        if batch.column("class").null_count or np.isnan(x).any():
            raise ValueError("a forest needs a known label and numbers in every row")
        rows = np.zeros(batch.num_rows, ROW)
        for signal, edge in enumerate(edges):
            rows["bins"][:, signal] = np.searchsorted(edge, x[:, signal], side="left")
        rows["class"], rows["weight"] = batch.column("class").to_numpy(), batch.column("weight").to_numpy()
        held.append((batch.column("id").to_numpy(), rows))
        if sum(len(r) for _, r in held) >= TOGETHER:
            yield tuple(map(np.concatenate, zip(*held)))
            held = []
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def _by_node(batches: Iterator[pa.RecordBatch], edges: list[np.ndarray], trees: list[Tree], waiting: list[np.ndarray],
             seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(tree, rows drawn, place of each row's node in ``waiting``), rows in the order of their nodes."""
    for ids, rows in _in_bins(batches, edges):
        for t, (tree, nodes) in enumerate(zip(trees, waiting)):
            if not len(nodes):
                continue
            drawn = draws(ids, t, seed)
            some = np.flatnonzero(drawn)
            place = np.full(len(tree.left), -1)
            place[nodes] = np.arange(len(nodes))
            at = place[tree.leaves(rows["bins"][some])]
            some, at = some[at >= 0], at[at >= 0]
            order = np.argsort(at, kind="stable")
            own = rows[some[order]]
            own["drawn"] = drawn[some[order]]
            if len(own):
                yield t, own, at[order]


def _tree(nodes: np.ndarray) -> Tree:
    """Nodes with cuts in bins."""
    return Tree(nodes["feature"], nodes["cut"], nodes["left"], nodes["right"], nodes["sums"])


PACKED = "tree int, node int, packed binary"


def _packed(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    tree, node, packed = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(tree, pa.int32()), pa.array(node, pa.int32()), pa.array(packed, pa.binary())], names=["tree", "node", "packed"])


def _cut_large(rows: DataFrame, edges: list, tops: list[np.ndarray], large: list[np.ndarray], leaf: int, seed: int) -> list:
    """Best cut of every node in ``large``: tree, node, signal, bin, gain, and the sums of both sides."""
    shared = rows.sparkSession.sparkContext.broadcast((edges, [_tree(t) for t in tops], large))

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, trees, large = shared.value
        for t, own, at in _by_node(batches, edges, trees, large, seed):
            for begin in range(0, len(large[t]), NODES):
                a, b = np.searchsorted(at, [begin, begin + NODES])
                some = large[t][begin:begin + NODES]
                tried = np.concatenate([_tried(1, seed, t, int(node)) for node in some])
                table = _tables(own[a:b], at[a:b] - begin, len(some), tried)
                yield _packed([(t, int(node), table[:, i].tobytes()) for i, node in enumerate(some)])

    def best(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, node = (k.as_py() for k in key)
        table = np.zeros((CLASSES + 1, TRIED, BINS))
        for part in parts:
            for packed in part.column("packed"):
                table += np.frombuffer(packed.as_buffer()).reshape(table.shape)
        signal, cut, gain = (v[0] for v in _best(table[:, None], leaf))
        sides = [table[:, signal, :cut + 1].sum(1).tolist(), table[:, signal, cut + 1:].sum(1).tolist()]
        yield pa.RecordBatch.from_pylist([{
            "tree": t, "node": node, "signal": int(_tried(1, seed, t, node)[0, signal]), "cut": int(cut), "gain": float(gain),
            "left": sides[0], "right": sides[1]}], schema=found)

    sums = pa.list_(pa.float64())
    found = pa.schema([("tree", pa.int32()), ("node", pa.int32()), ("signal", pa.int32()), ("cut", pa.int32()),
                       ("gain", pa.float64()), ("left", sums), ("right", sums)])
    won = rows.mapInArrow(tables, PACKED).groupBy("tree", "node").applyInArrow(
        best, "tree int, node int, signal int, cut int, gain double, left array<double>, right array<double>").collect()
    shared.unpersist()
    return won


def _grow_small(rows: DataFrame, edges: list, tops: list[np.ndarray], small: list[np.ndarray], levels: list[np.ndarray],
                depth: int, leaf: int, seed: int) -> DataFrame:
    """All below every node in ``small``: tree, node, packed nodes, gains."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((edges, [_tree(t) for t in tops], small, levels))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, trees, small, _ = shared.value
        for t, own, at in _by_node(batches, edges, trees, small, seed):
            places, begins = np.unique(at, return_index=True)
            ends = [*begins[1:], len(at)]
            yield _packed([(t, int(small[t][p]), own[a:b].tobytes()) for p, a, b in zip(places, begins, ends)])

    def grown(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, node = (k.as_py() for k in key)
        own = np.concatenate([np.frombuffer(packed.as_buffer(), ROW) for part in parts for packed in part.column("packed")])
        nodes, gains = subtree(own, depth - int(shared.value[3][t][node]), leaf, (seed, t, node))
        yield pa.RecordBatch.from_arrays(
            [pa.array([t], pa.int32()), pa.array([node], pa.int32()), pa.array([nodes.tobytes()], pa.binary()),
             pa.array([gains.tolist()], pa.list_(pa.float64()))], names=["tree", "node", "packed", "gains"])

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return written(rows.mapInArrow(dealt, PACKED).repartition(parts, "tree", "node").groupBy("tree", "node").applyInArrow(
        grown, PACKED + ", gains array<double>"), "forest-nodes")


def _joined(top: np.ndarray, below: list, edges: list[np.ndarray]) -> tuple[Tree, np.ndarray]:
    """One tree out of its top and what was grown below, and which nodes of the top still have children."""
    parts, begun = [top], len(top)
    for row in below:
        part = np.frombuffer(row["packed"], NODE).copy()
        inner = part["left"] >= 0
        part["left"][inner] += begun - 1
        part["right"][inner] += begun - 1
        top[row["node"]] = part[0]  # the first takes the place that was left for it
        parts.append(part[1:])
        begun += len(part) - 1
    nodes = np.concatenate(parts)
    for i in range(len(top) - 1, -1, -1):  # as ``_merged``: children of the top come from below
        a, b = nodes["left"][i], nodes["right"][i]
        if a >= 0 and nodes["left"][a] < 0 and nodes["left"][b] < 0 and nodes["sums"][a].argmax() == nodes["sums"][b].argmax():
            nodes["left"][i] = nodes["right"][i] = -1
    still = nodes["left"][:len(top)] >= 0
    kept = _kept(nodes)
    place = np.cumsum(kept) - 1
    nodes = nodes[kept]
    inner = nodes["left"] >= 0
    threshold = np.zeros(len(nodes))
    for signal, edge in enumerate(edges):
        own = inner & (nodes["feature"] == signal)
        threshold[own] = edge[nodes["cut"][own]]
    left, right = (np.where(inner, place[nodes[side]], -1).astype(np.int64) for side in ("left", "right"))
    return Tree(nodes["feature"].astype(np.int64), threshold, left, right,
                nodes["sums"] / np.maximum(nodes["sums"].sum(1, keepdims=True), 1e-300)), still


def grow_dealt(train: DataFrame, trees: int, depth: int, leaf: int, seed: int) -> tuple[list[Tree], np.ndarray]:
    """Trees on (features, _class, _weight) and the sum of their importances, each tree's adding up to one."""
    rows = written(train.select(
        vector_to_array("features").alias("x"), F.col("_class").cast("int").alias("class"),
        F.col("_weight").cast("double").alias("weight"), F.monotonically_increasing_id().alias("id")), "forest-dealt")
    edges = cuts(rows)
    tops = [np.zeros(1, NODE) for _ in range(trees)]
    for top in tops:
        top["left"] = top["right"] = -1
    levels = [np.zeros(1, np.int64) for _ in range(trees)]
    gains = np.zeros((trees, SIGNALS))
    top_gains: list[dict[int, float]] = [{} for _ in range(trees)]
    large = [np.zeros(1, np.int64) if depth else np.zeros(0, np.int64) for _ in range(trees)]
    small: list[list[int]] = [[] for _ in range(trees)]
    while any(map(len, large)):
        coming: list[list[int]] = [[] for _ in range(trees)]
        for cut in _cut_large(rows, edges, tops, large, leaf, seed):
            t, node, top = cut["tree"], cut["node"], tops[cut["tree"]]
            sides = np.array([cut["left"], cut["right"]])
            top["sums"][node] = sides[:, :CLASSES].sum(0)
            if cut["gain"] <= 0:
                continue
            top["feature"][node], top["cut"][node] = cut["signal"], cut["cut"]
            top["left"][node], top["right"][node] = len(top), len(top) + 1
            top_gains[t][node] = cut["gain"] * top["sums"][node].sum()
            new = np.zeros(2, NODE)
            new["left"] = new["right"] = -1
            new["sums"] = sides[:, :CLASSES]
            tops[t] = np.concatenate([top, new])
            levels[t] = np.concatenate([levels[t], np.full(2, levels[t][node] + 1)])
            for child, drawn, mixed in zip((len(top), len(top) + 1), sides[:, CLASSES], _mixed(new["sums"])):
                if levels[t][child] < depth and drawn >= 2 * leaf and mixed:
                    (coming[t] if drawn > SMALL else small[t]).append(child)
        large = [np.array(c, np.int64) for c in coming]
    below = _grow_small(rows, edges, tops, [np.array(s, np.int64) for s in small], levels, depth, leaf, seed)
    grown: list[Tree] = []
    for begin in range(0, trees, AT_ONCE):
        of: dict[int, list] = {}
        for row in below.filter(F.col("tree").between(begin, begin + AT_ONCE - 1)).collect():
            of.setdefault(row["tree"], []).append(row)
        for t in range(begin, min(begin + AT_ONCE, trees)):
            parts = sorted(of.get(t, ()), key=lambda r: r["node"])
            tree, still = _joined(tops[t], parts, edges)
            grown.append(tree)
            gains[t] = np.sum([r["gains"] for r in parts], 0) if parts else 0
            for node, gain in top_gains[t].items():
                gains[t, tops[t]["feature"][node]] += gain * still[node]
    return grown, (gains / np.maximum(gains.sum(1, keepdims=True), 1e-300)).sum(0)
