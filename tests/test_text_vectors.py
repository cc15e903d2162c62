"""Stored texts go when only their vectors are asked for."""

import pyarrow as pa
import pyarrow.parquet as pq

from dossier.functions import storage
from dossier.plans import corpus


def test_texts_are_deleted_once_the_vectors_are_written(spark, tmp_path, monkeypatch):
    words = [" ".join(f"word{(i * j) % 97}" for j in range(1, 60)) for i in range(1, 40)]
    pq.write_table(pa.table({"doc_id": range(39), "text": words, "lang": ["en"] * 39, "source": ["web"] * 39}), tmp_path / "documents.parquet")
    (tmp_path / "kept").mkdir()
    monkeypatch.setattr(storage, "shared_folder", lambda spark: str(tmp_path / "kept"))
    left = lambda: sorted(p.name.rsplit("-", 1)[0] for p in (tmp_path / "kept").iterdir())
    alone = corpus.Corpus(spark, str(tmp_path))
    got = sorted(map(tuple, alone.text_vectors.collect()))
    assert left() == ["text-vectors"]
    after = corpus.Corpus(spark, str(tmp_path))
    assert after.chunks.count() >= len(got) > 20
    assert sorted(map(tuple, after.text_vectors.collect())) == got
    assert left() == ["chunks", "content", "text-vectors", "text-vectors"]
