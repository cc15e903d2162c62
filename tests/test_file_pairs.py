"""File pairs met block by block, against the table of all pairs."""

import numpy as np
import pytest

from dossier.functions.storage import written
from dossier.operators import dedup, neighbours, vectors
from dossier.plans import corpus


def _rows(seed=3):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((420, 12)).astype(np.float32)
    x[50:60] = x[40]  # copies in several files
    x[300:306] = x[301]  # and in files of many chunks
    x[100] = 0
    for i, v in enumerate(x):
        # no path: 33 chunks of an unknown file; /g*: files of many chunks
        yield f"c{i:03d}", None if i % 13 == 0 else f"/f{i // 3:03d}" if i < 300 else f"/g{i % 4}", v.tolist()


def _found(frame):
    rows = [(r.path_1, r.path_2, r.shared_chunks, round(r.avg_similarity, 9), round(r.redundancy_ratio, 9), r.action) for r in frame.collect()]
    assert len({r[:2] for r in rows}) == len(rows), "a pair of files came twice"
    return sorted(rows)


def _both(spark, rows, pair, average, **kinds):
    table = spark.createDataFrame(rows, "chunk_id string, path string, vector array<float>").cache()
    chunks, paths = table.select("chunk_id", "vector"), table.filter("path IS NOT NULL").select("chunk_id", "path")
    members = vectors.class_members(chunks)
    old = dedup.class_redundancy(vectors.near_duplicate_pairs(chunks, pair), members, paths, average)
    files = written(dedup.class_files(members, paths))
    new = dedup.vector_redundancy(files, written(vectors.distinct_vectors(chunks)), paths, pair, average, **kinds)
    return _found(old), new


@pytest.mark.parametrize("large,numbers,pair,average", [(512, 1 << 22, 0.5, 0.62), (512, 600, 0.9, 0.95), (5, 600, 0.5, 0.62)])
def test_blocks_give_the_rows_of_the_pair_table(spark, monkeypatch, large, numbers, pair, average):
    monkeypatch.setattr(dedup, "LARGE_FILE", large)
    monkeypatch.setattr(dedup, "STRIP", 16)
    monkeypatch.setattr(dedup, "MET", 32)
    monkeypatch.setattr(dedup, "SENT_PAIRS", 50)
    old, new = _both(spark, list(_rows()), pair, average, numbers=numbers)
    assert len(old) > 10 and _found(new) == old


def test_an_id_with_two_vectors_and_no_rows(spark):
    rows = [("a", "/a", [1.0, 0.0, 0.1]), ("a", "/a", [0.9, 0.3, 0.0]), ("b", "/b", [0.8, 0.6, 0.0]), ("c", "/c", [0.0, 0.0, 1.0])]
    old, new = _both(spark, rows, 0.5, 0.8)
    assert old and _found(new) == old
    assert _both(spark, [("z", "/z", [0.0, 0.0])], 0.5, 0.8)[1].count() == 0
    old, new = _both(spark, rows[3:], 0.5, 0.8)
    assert old == _found(new) == []


def test_pairs_of_small_files_are_not_shuffled(spark):
    """The only exchange of pairs would be an aggregate over the two paths."""
    new = _both(spark, [r for r in _rows() if r[1] and r[1].startswith("/f")], 0.5, 0.62)[1]
    assert "path_1" not in "".join(line for line in new._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line)


def test_cells_are_used_where_they_spare_products(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LARGE_FROM", 100)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 32)
    monkeypatch.setattr(dedup, "_file_pairs", None)
    monkeypatch.setattr(neighbours, "LARGE_SHARE", 2.0)
    old, new = _both(spark, list(_rows()), 0.9, 0.95)
    assert old and _found(new) == old


def test_sections_carry_their_paths(spark):
    rows = list(_rows())
    table = spark.createDataFrame(rows, "chunk_id string, path string, vector array<float>")
    chunks, paths = table.select("chunk_id", "vector"), table.filter("path IS NOT NULL").select("chunk_id", "path")
    want = dedup.chunk_to_path_map(vectors.near_duplicate_pairs(chunks, 0.6), paths)
    got = dedup.chunk_to_path_map(vectors.near_duplicate_pairs(dedup.with_path(chunks, paths), 0.6))
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


@pytest.mark.parametrize("twice", [False, True])
def test_corpus_sections_with_repeated_files(spark, tmp_path, twice):
    class Stages(corpus.Corpus):
        def __init__(self, spark):
            self.spark = spark

        vectors = property(lambda self: self.spark.createDataFrame(
            [(c, 1, v) for c, _, v in _rows()], "chunk_id string, file_id long, vector array<float>"))

        @property
        def vector_paths(self):
            rows = [(c, p) for c, p, _ in _rows() if p]
            return self.spark.createDataFrame(rows * (2 if twice else 1), "chunk_id string, path string")

    c = Stages(spark)
    want = dedup.chunk_to_path_map(c.pairs, c.vector_paths)
    assert sorted(map(tuple, c.sections.collect())) == sorted(map(tuple, want.collect()))
    members = vectors.class_members(c.vectors)
    assert _found(c.redundancy) == _found(dedup.class_redundancy(c.pairs, members, c.vector_paths, 0.40))
