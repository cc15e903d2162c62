"""Paths of marked file pairs, found without the table of pairs."""

import numpy as np

from dossier.functions.storage import written
from dossier.operators import dedup, vectors
from dossier.plans.corpus import Corpus


def _table(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, path string, vector array<float>")


def _both(spark, rows, pair, average, block_rows=64):
    table = _table(spark, rows).cache()
    chunks = table.select("chunk_id", "vector")
    paths = table.filter("path IS NOT NULL").select("chunk_id", "path")
    none = spark.createDataFrame([], "hash string, path_1 string, path_2 string")
    members = vectors.class_members(chunks)
    old = dedup.duplicate_paths(none, dedup.class_redundancy(
        vectors.near_duplicate_pairs(chunks, pair, block_rows=block_rows), members, paths, average))
    files = written(dedup.class_files(members, paths))
    new = dedup.averaged_duplicate_paths(
        none, files, written(vectors.distinct_vectors(chunks)), pair, average, block_rows)
    return {r.path for r in old.collect()}, sorted(r.path for r in new.collect())


def test_marked_paths_equal_those_of_all_pairs(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((420, 12)).astype(np.float32)
    x[50:60] = x[40]  # copies in several files
    x[100] = 0
    rows = []
    for i, v in enumerate(x):
        path = None if i % 13 == 0 else f"/f{i // 3:03d}" if i < 300 else f"/g{i % 4}"  # /g*: files of many chunks
        rows.append((f"c{i:03d}", path, v.tolist()))
    for pair, average in ((0.5, 0.62), (0.6, 0.8)):
        old, new = _both(spark, rows, pair, average)
        assert len(old) > 10, old
        assert sorted(old) == new, (pair, average, old ^ set(new))


def test_an_average_drawn_down_by_a_second_chunk(spark):
    """/a and /b have one pair of 0.9 and one of 0.5: an average of 0.7."""
    def at(axis, cosine):
        v = [0.0] * 6
        v[axis], v[axis + 1] = cosine, (1 - cosine ** 2) ** 0.5
        return v

    rows = [("a0", "/a", at(0, 1.0)), ("a1", "/a", at(3, 1.0)), ("b0", "/b", at(0, 0.9)), ("b1", "/b", at(3, 0.5))]
    assert _both(spark, rows, 0.4, 0.75)[1] == []
    assert _both(spark, rows, 0.4, 0.69)[1] == ["/a", "/b"]
    assert _both(spark, rows, 0.6, 0.75)[1] == ["/a", "/b"]


def test_an_id_with_two_vectors(spark):
    rows = [("a", "/a", [1.0, 0.0, 0.1]), ("a", "/a", [0.9, 0.3, 0.0]), ("b", "/b", [0.8, 0.6, 0.0]), ("c", "/c", [0.0, 0.0, 1.0])]
    for pair, average in ((0.5, 0.86), (0.05, 0.1)):
        old, new = _both(spark, rows, pair, average)
        assert new == sorted(old)


def test_signals_make_no_pair_table(spark, tmp_path, monkeypatch):
    """What grew with the square of the files: the pairs of a corpus are not made for its duplicate paths."""
    def refuse(*_, **__):
        raise AssertionError("the table of file pairs was made")

    monkeypatch.setattr(dedup, "expanded_redundancy", refuse)
    monkeypatch.setattr(vectors, "near_duplicate_pairs", refuse)
    rng = np.random.default_rng(5)
    docs = [(i, f"Words of document number {i}, enough to be kept. " * 3, "en", "web", 10) for i in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    base = rng.standard_normal((20, 8))
    vecs = [(i, (base[i % 20] + 0.2 * rng.standard_normal(8)).astype(np.float32).tolist(), 0) for i in range(80)]
    spark.createDataFrame(vecs, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert Corpus(spark, str(tmp_path)).dup_paths.count() > 10
