"""Similarity search and clustering against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.operators import cluster, neighbours, vectors
from dossier.plans import registry


def clustered(seed, groups, each, dims=24, noise=0.25):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, dims))
    points = np.repeat(centres, each, axis=0) + noise * rng.standard_normal((groups * each, dims))
    return points / np.linalg.norm(points, axis=1, keepdims=True)


def frame(spark, matrix, name="chunk_id"):
    rows = [(f"v{i:05d}", [float(x) for x in row]) for i, row in enumerate(matrix)]
    return spark.createDataFrame(rows, f"{name} string, vector array<double>")


def brute(matrix, threshold):
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    unit = matrix / np.where(norms > 0, norms, 1)
    sims = unit @ unit.T
    i, j = np.nonzero(np.triu(sims >= threshold, 1))
    return {(f"v{a:05d}", f"v{b:05d}") for a, b in zip(i, j)}


def found(pairs):
    rows = [(r[0], r[1]) for r in pairs.collect()]
    assert len(rows) == len(set(rows)), "a pair came twice"
    assert all(a < b for a, b in rows)
    return set(rows)


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.95])
@pytest.mark.parametrize("block", [16, 64, 4096])
def test_exact_pairs_equal_brute_force(spark, threshold, block):
    matrix = clustered(1, 20, 15)
    got = found(neighbours.exact_pairs(frame(spark, matrix, "id"), threshold, block))
    assert got == brute(matrix, threshold)


def test_exact_pairs_with_a_hot_cell(spark):
    rng = np.random.default_rng(2)
    matrix = np.vstack([clustered(3, 1, 200, noise=0.05), rng.standard_normal((300, 24))])
    got = found(neighbours.exact_pairs(frame(spark, matrix, "id"), 0.9, 32))
    assert got == brute(matrix, 0.9)


def test_hot_cell_is_cut_into_bounded_tiles(spark):
    matrix = clustered(3, 1, 300, noise=0.05)
    cells = frame(spark, matrix, "id").select(
        F.lit(0).cast("long").alias("cell"), F.lit(False).alias("visitor"), "id", "vector")
    placed = neighbours.tiles(cells, 50).groupBy("cell", "kind", "a", "b").count()
    assert placed.agg(F.max("count")).first()[0] <= 50 * 2 * 2  # two blocks, hash placement may be uneven
    assert placed.count() == 6 * 7 // 2


def test_an_ordinary_cell_is_sent_once(spark):
    matrix = clustered(3, 1, 60, noise=0.05)
    cells = frame(spark, matrix, "id").select(
        F.lit(0).cast("long").alias("cell"), (F.col("id") < "v00020").alias("visitor"), "id", "vector")
    assert neighbours.tiles(cells, 50).count() == 60


def test_banding_meets_its_recall():
    for threshold in (0.8, 0.9, 0.95, 0.99):
        for count in (10 ** 3, 10 ** 6, 10 ** 9):
            bands, bits = neighbours.banding(clustered(1, 20, 10), count, threshold, 0.99)
            assert 1 - (1 - (1 - np.arccos(threshold) / np.pi) ** bits) ** bands >= 0.99 - 1e-9


def test_exact_pairs_prune_visits_between_far_clusters(spark):
    matrix = clustered(5, 40, 10, dims=64, noise=0.05)
    table = frame(spark, matrix, "id")
    pivots, radii, _ = neighbours._measured(table, neighbours._pivots(table, 40))
    cells = neighbours._assign_cells(table, pivots, radii, 0.95)
    visits = cells.filter("visitor").count()
    assert visits < len(matrix) * len(pivots) / 2 / 10  # far below visiting every later cell


def deep(monkeypatch, first=3, blocks=2):
    monkeypatch.setattr(neighbours, "FIRST_PIVOTS", first)
    monkeypatch.setattr(neighbours, "DEEP_BLOCKS", blocks)


@pytest.mark.parametrize("threshold", [0.5, 0.9])
def test_pairs_of_two_levels_equal_brute_force(spark, monkeypatch, threshold):
    deep(monkeypatch)
    rng = np.random.default_rng(8)
    matrix = np.vstack([clustered(1, 20, 15), clustered(3, 1, 150, noise=0.05), rng.standard_normal((100, 24))])
    cells = neighbours.Cells(frame(spark, matrix, "id"), threshold, 16)
    assert cells.deep is not None
    assert found(cells.compare(frame(spark, matrix, "id"), neighbours._emit_pairs, neighbours.PAIR_SCHEMA)) == brute(matrix, threshold)


def test_a_cell_without_a_drawn_pivot_stays_whole(spark, monkeypatch):
    deep(monkeypatch)
    matrix = clustered(1, 20, 15)
    table = frame(spark, matrix, "id")
    cells = neighbours.Cells(table, 0.8, 16)
    cells.deep.pivots = cells.deep.pivots.filter("cell > 0")
    assert found(cells.compare(table, neighbours._emit_pairs, neighbours.PAIR_SCHEMA)) == brute(matrix, 0.8)


def test_cells_grow_in_number_and_not_in_rows(spark, monkeypatch):
    """400, 4000 and 40000 rows in blocks of 25: a cell stays near a block, and no vector meets all pivots."""
    deep(monkeypatch, first=4, blocks=4)
    most = []
    for times in (1, 10, 100):
        table = frame(spark, clustered(4, 400, times, dims=8, noise=0.05), "id").cache()
        cells = neighbours.Cells(table, 0.999, 25)
        homes = cells.placed(table).filter("NOT visitor").groupBy("cell").count()
        found_ = homes.agg(F.max("count").alias("most"), F.avg("count").alias("mean"), F.sum("count").alias("rows")).first()
        assert found_["rows"] == 400 * times and found_["mean"] <= 2 * 25
        most.append(found_["most"])
        assert len(cells.pivots) <= max(4, np.ceil(np.sqrt(400 * times / 25)))
    assert max(most) <= 12 * 25
    assert neighbours.first_pivots(10 ** 4) == 100 and neighbours.first_pivots(10 ** 9) == neighbours.PIVOTS


def test_copies_are_linked_as_a_star(spark):
    base = clustered(7, 5, 4)
    matrix = np.vstack([base, np.repeat(base[:1], 100, axis=0)])
    pairs = vectors.near_duplicate_pairs(frame(spark, matrix), 0.99)
    star = [r for r in pairs.collect() if r[0] == "v00000" and r[2] == 1.0]
    assert len(star) == 100
    assert found(pairs) - {(a, b) for a, b, _ in star} == brute(base, 0.99)


@pytest.mark.parametrize("method", ["exact", "lsh"])
def test_every_copy_is_in_every_pair(spark, monkeypatch, method):
    monkeypatch.setattr(vectors, "COPIES_BLOCK", 4)
    base = clustered(7, 4, 3, noise=0.02)
    matrix = np.vstack([base, np.repeat(base[:1], 11, axis=0), np.repeat(base[1:2], 6, axis=0), base[5:6], np.zeros((2, 24))])
    want = brute(matrix, 0.97)
    got = found(vectors.near_duplicate_pairs(frame(spark, matrix), 0.97, method=method, copies="all"))
    star = found(vectors.near_duplicate_pairs(frame(spark, matrix), 0.97, method=method))
    assert len(star) < len(got)
    assert got == want if method == "exact" else got <= want and len(got) > 0.9 * len(want)


def test_every_copy_of_ids_that_repeat_or_are_null(spark):
    """As a join of all rows with all rows of a larger id."""
    rows = [("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("b", [1.0, 0.0]), ("b", [1.0, 0.0]), (None, [1.0, 0.0]), (None, [0.6, 0.8]),
            ("c", [0.1, 1.0]), ("c", None), ("d", [0.0, 1.0]), ("d", [0.0, 0.0])]
    table = spark.createDataFrame(rows, "chunk_id string, vector array<double>")
    got = sorted((r[0], r[1], round(r[2], 6)) for r in vectors.near_duplicate_pairs(table, 0.9, copies="all").collect())
    near = round(1 / np.sqrt(1.01), 6)
    assert got == [("a", "b", 1.0), ("a", "b", 1.0), ("a", "c", near), ("a", "d", 1.0), ("c", "d", near)]


def test_text_queries_give_every_pair_of_copies():
    """The queries on texts ask for all copies."""
    for name in ("near_duplicate_text_pairs", "near_duplicate_lsh"):
        asked = {}

        class Stages:
            text_vectors = "texts"

        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(registry.vectors, "near_duplicate_pairs", lambda *a, **k: asked.update(k))
            getattr(registry, name)(Stages)
        assert asked["copies"] == "all"


def test_zero_vectors_pair_with_nothing(spark):
    matrix = np.vstack([np.zeros((3, 24)), clustered(1, 2, 3)])
    assert found(vectors.near_duplicate_pairs(frame(spark, matrix), 0.5)) == brute(matrix, 0.5)


def test_no_vectors_give_no_pairs(spark):
    empty = frame(spark, np.zeros((1, 4))).limit(0)
    assert vectors.near_duplicate_pairs(empty, 0.9).count() == 0
    assert vectors.near_duplicate_pairs(empty, 0.9, method="lsh").count() == 0


def test_threshold_ties_are_kept(spark):
    matrix = np.array([[1.0, 0.0], [0.6, 0.8], [0.0, 1.0]])
    assert ("v00000", "v00001") in found(neighbours.exact_pairs(frame(spark, matrix, "id"), 0.6))


def sparse_texts(seed, rows, dims=256, words=40, topics=30):
    """Hashed word counts of texts that share most words with their topic."""
    rng, common = np.random.default_rng(seed), np.random.default_rng(0).integers(0, dims, (topics, 12))
    out = np.zeros((rows, dims))
    for i, topic in enumerate(rng.integers(0, topics, rows)):
        np.add.at(out[i], np.concatenate([rng.choice(common[topic], words * 3 // 4), rng.integers(0, dims, words // 4)]), 1.0)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def test_runs_that_cannot_hold_a_better_one_are_left():
    known, asked, k = sparse_texts(1, 4096), sparse_texts(2, 200), 5
    ids = [f"v{i:05d}" for i in range(len(known))]
    index = neighbours.MaxWeightIndex(ids, known)
    bound = np.sort(np.round(asked @ known[:200].T, 12), axis=1)[:, -k]
    q, row, score = index.search(asked, bound, k)
    scores = np.round(asked @ known.T, 12)
    for i in range(len(asked)):
        want = sorted(range(len(ids)), key=lambda j: (-scores[i, j], ids[j]))[:k]
        assert [index.ids[r] for r in row[q == i]] == [ids[j] for j in want]
    assert index.visited < 0.5 * index.offered
    assert sum(len(dims) for _, dims, _ in index.runs) < 0.9 * known.shape[1] * len(index.runs)


def test_search_in_a_block_below_the_bound_finds_nothing():
    index = neighbours.MaxWeightIndex(["a", "b"], np.array([[1.0, 0.0], [0.0, 0.0]]))
    q, row, score = index.search(np.array([[0.0, 1.0], [1.0, 0.0], [-1.0, 0.0]]), np.array([0.5, 0.5, -1.0]), 2)
    assert list(zip(q, index.ids[row], score)) == [(1, "a", 1.0), (2, "b", 0.0), (2, "a", -1.0)]


@pytest.mark.parametrize("sample", [3, 50, 4096])
def test_top_k_of_sparse_queries_with_ties_and_zeros(spark, monkeypatch, sample):
    monkeypatch.setattr(neighbours, "BOUND_SAMPLE", sample)
    known = np.vstack([sparse_texts(3, 300, 32, 6, 5), np.zeros((3, 32)), sparse_texts(3, 40, 32, 6, 5)])  # the last repeat the first
    asked = np.vstack([sparse_texts(4, 40, 32, 3, 5), np.zeros((1, 32)), -sparse_texts(5, 5, 32, 3, 5)])
    got = neighbours.top_k_pairs(frame(spark, asked, "id"), frame(spark, known, "id"), 7, 32).collect()
    scores = np.round(asked @ known.T, 12)
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["similarity"]))
    for i in range(len(asked)):
        want = sorted(range(len(known)), key=lambda j: (-scores[i, j], j))[:7]
        assert [(n, x) for n, x, _ in sorted(by[f"v{i:05d}"])] == [(n + 1, f"v{j:05d}") for n, j in enumerate(want)]


@pytest.mark.parametrize("block", [16, 4096])
def test_lsh_pairs_are_exact_and_nearly_complete(spark, block):
    matrix = clustered(11, 20, 15, noise=0.08)
    want = brute(matrix, 0.97)
    got = found(vectors.near_duplicate_pairs(frame(spark, matrix), 0.97, method="lsh", block_rows=block))
    assert got <= want
    assert len(got) >= 0.9 * len(want)


@pytest.mark.parametrize("block", [4096, 30, 7])
def test_top_k_equals_brute_force(spark, block):
    matrix = clustered(13, 10, 10)
    table = frame(spark, matrix, "id")
    got = neighbours.top_k_pairs(table.limit(20), table, 4, block).collect()
    sims = np.round(matrix[:20] @ matrix.T, 12)
    for q in range(20):
        order = sorted(range(len(matrix)), key=lambda i: (-sims[q, i], i))[:4]
        mine = sorted((r for r in got if r["query_id"] == f"v{q:05d}"), key=lambda r: r["rank"])
        assert [r["id"] for r in mine] == [f"v{i:05d}" for i in order]


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 50)]
    edges = spark.createDataFrame(chain + star, "a long, b long")
    labels = {r["node"]: r["component"] for r in cluster.connected_components(edges).collect()}
    assert all(labels[i] == 0 for i in range(201))
    assert all(labels[1000 + i] == 1000 for i in range(50))


def python_dbscan(matrix, eps, min_points):
    sims = matrix @ matrix.T
    near = [set(np.flatnonzero(row >= 1 - eps)) for row in sims]
    core = [len(n | {i}) >= min_points for i, n in enumerate(near)]
    label = [None] * len(matrix)
    for i in range(len(matrix)):
        if not core[i] or label[i] is not None:
            continue
        stack = [i]
        while stack:
            p = stack.pop()
            if label[p] is not None:
                continue
            label[p] = i
            if core[p]:
                stack.extend(near[p])
    return label, core


@pytest.mark.parametrize("noise", [0.12, 0.25])
def test_dbscan_equals_a_sequential_run(spark, noise):
    matrix = clustered(17, 12, 8, noise=noise)
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(matrix)]
    table = spark.createDataFrame(rows, "file_id long, vector array<double>")
    want, core = python_dbscan(matrix, 0.2, 4)
    got = {r["file_id"]: r for r in cluster.dbscan_cluster(table, 0.2, 4, block_rows=20).collect()}
    assert len(got) == len(matrix)
    assert [got[i]["cluster"] for i in range(len(matrix))] == want
    assert [got[i]["is_core"] for i in range(len(matrix))] == core


def test_a_dense_cluster_sends_links_not_pairs(spark):
    matrix = clustered(3, 1, 400, noise=0.02)
    points = frame(spark, matrix, "id").withColumn("mark", F.lit(1).cast("long"))
    cells = neighbours.Cells(points, 0.5, 100)
    links = neighbours.core_links(cells, points)
    tiles_of_a_point = 4
    assert 399 <= links.count() <= 400 * tiles_of_a_point * 2  # of 79 800 pairs
    near = neighbours.neighbour_weights(cells, points).collect()
    assert {r["near"] for r in near} == {399}


def test_merge_joins_sets():
    parent = np.arange(8)
    neighbours._merge(parent, np.array([5, 3]), np.array([3, 1]))
    neighbours._merge(parent, np.array([7, 7]), np.array([5, 2]))
    assert parent.tolist() == [0, 1, 1, 1, 4, 1, 6, 1]


def test_dbscan_counts_copies_as_points(spark):
    rows = [(i, [1.0, 0.0]) for i in range(3)] + [(9, [0.0, 1.0])]
    table = spark.createDataFrame(rows, "file_id long, vector array<double>")
    got = {r["file_id"]: (r["cluster"], r["is_core"]) for r in cluster.dbscan_cluster(table).collect()}
    assert got == {0: (0, True), 1: (0, True), 2: (0, True), 9: (None, False)}


def test_similar_chunks_of_an_unknown_id(spark):
    assert vectors.similar_chunks(frame(spark, clustered(1, 2, 3)), "nobody").count() == 0


def test_every_vector_goes_to_few_tasks():
    """What was sent to each of many cells: a row goes out once per block of the other side, and blocks are bounded."""
    for rows, asking in ((10 ** 4, 10 ** 4), (300_000, 70_000), (3_300_000, 780_000), (10 ** 9, 50), (3, 2)):
        across, down = neighbours._grid(rows, asking, 65_536, 12)
        assert -(-rows // across) <= 65_536 and 1 <= down <= asking
        assert rows * asking / (across * down) <= neighbours.PRODUCTS or down == asking
    assert neighbours._grid(3_300_000, 780_000, 65_536, 12)[1] <= 8  # before: every cell it could not rule out, most of 806


@pytest.mark.parametrize("columns", [64, 8192])
def test_held_vectors_give_the_best_of_many_copies(monkeypatch, columns):
    """Copies and near copies beyond k: the products alone cannot order them."""
    monkeypatch.setattr(neighbours, "MET_COLUMNS", columns)
    rng = np.random.default_rng(6)
    one = sparse_texts(7, 1)
    known = np.vstack([np.repeat(one, 150, axis=0), one + 1e-7 * rng.standard_normal((150, 256)), sparse_texts(8, 200), np.zeros((9, 256))])
    known = known[rng.permutation(len(known))].astype(np.float32)
    ids = [f"v{i:04d}" for i in rng.permutation(len(known))]
    asked = neighbours.unit_rows(np.vstack([one, sparse_texts(9, 20), np.zeros((1, 256)), -one]))
    scores, k = np.round(asked @ neighbours.unit_rows(known).T, 12), 5
    held = neighbours.HeldVectors(ids, [known[:77], known[77:]], k)
    assert len(held.ids) < len(ids) - 140
    for bound in (np.full(len(asked), -1.0), np.sort(scores[:, :40], axis=1)[:, -k]):
        q, row, score = held.search(asked, bound)
        for i in range(len(asked)):
            want = sorted(range(len(ids)), key=lambda j: (-scores[i, j], ids[j]))[:k]
            assert [(held.ids[r], s) for r, s in zip(row[q == i], score[q == i])] == [(ids[j], scores[i, j]) for j in want]


def test_pairs_of_vectors_without_structure_meet_in_large_blocks(spark, monkeypatch):
    """Cells rule nothing out there, and a row was sent to nearly all of them."""
    rng = np.random.default_rng(12)
    matrix = np.vstack([rng.standard_normal((500, 24)), clustered(3, 1, 100, noise=0.05)])
    table = frame(spark, matrix, "id")
    monkeypatch.setattr(neighbours, "LARGE_FROM", 400)
    monkeypatch.setattr(neighbours, "MET_COLUMNS", 50)
    cells = neighbours.Cells(table, 0.6, 8)
    assert cells.large and cells.deep is None
    sent = neighbours.tiles(cells.placed(table), cells.block_rows, cells.rows).count()
    assert sent <= 10 * len(matrix)  # 75 cells before
    assert found(cells.compare(table, neighbours._emit_pairs, neighbours.PAIR_SCHEMA)) == brute(matrix, 0.6)
    apart = frame(spark, clustered(5, 40, 15, dims=64, noise=0.02), "id")
    assert not neighbours.Cells(apart, 0.95, 8).large  # clusters stay in their cells
