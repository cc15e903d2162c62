"""What a task holds does not follow the rows of an Arrow batch."""

import io
import zipfile

import numpy as np
import pyarrow as pa

from dossier.operators import neighbours
from dossier.plans import registry
from dossier.sources import files


def test_archives_are_packed_a_few_hundred_at_a_time():
    names = [f"d{i}" for i in range(1000)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(names), pa.array(["a text"] * 1001)], names=["name", "text"])
    out = list(registry._zipped(iter([batch])))
    assert max(b.num_rows for b in out) <= 256 and sum(b.num_rows for b in out) == 1001
    assert out[-1].column("path").to_pylist()[-2:] == ["/root/d999.zip", None]
    with zipfile.ZipFile(io.BytesIO(out[0].column("content")[3].as_py())) as archive:
        assert archive.read("inner/deep/d3.json") == b"txet a"


def test_members_of_many_archives_in_small_batches(spark):
    def packed(i):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as archive:
            archive.writestr("a.txt", f"{i}" * 10)
            archive.writestr("b.txt", "")
        return buffer.getvalue()

    rows = [(f"/z{i}", packed(i)) for i in range(20)] + [("/broken", b"no zip")]
    archives = spark.createDataFrame(rows, "path string, content binary")
    found = {(r.source_archive, r.member): r for r in files.zip_members(archives, batch_bytes=600).collect()}
    assert len(found) == 41
    assert bytes(found["/z7", "a.txt"].content) == b"7" * 10 and found["/z7", "b.txt"].position == 1
    assert found["/broken", None].hash == "error_unreadable" and found["/broken", None].position is None


def test_candidates_are_scored_a_bounded_number_at_a_time(monkeypatch):
    x = neighbours.unit_rows(np.ones((50, 8)) + 0.01 * np.random.default_rng(1).standard_normal((50, 8)))
    whole = neighbours._passing(x, x, 0.99)
    gathered = []
    einsum = np.einsum
    monkeypatch.setattr(neighbours, "SCORED", 80)
    monkeypatch.setattr(np, "einsum", lambda how, a, b: gathered.append(len(a)) or einsum(how, a, b))
    parts = neighbours._passing(x, x, 0.99)
    assert len(whole[0]) == 2500 and max(gathered) == 10
    assert all(np.array_equal(a, b) for a, b in zip(whole[:2], parts[:2])) and np.allclose(whole[2], parts[2])


def test_queries_meet_a_block_in_strips():
    def rows(n, asks):
        return pa.RecordBatch.from_arrays(
            [pa.array([3] * n), pa.array([0] * n, pa.int32()), pa.array([asks] * n), pa.array([0.0] * n),
             pa.array([f"{i}" for i in range(n)]), pa.array([[1.0, 0.0]] * n)], names=["cell", "block", "is_query", "bound", "id", "vector"])

    parts = [part.num_rows for ids, held, part in neighbours._asked_blocks(iter([rows(5, False), rows(1300, True)]))]
    assert parts == [512, 512, 276]


def test_vectors_of_bands_are_packed_without_loss():
    rng = np.random.default_rng(2)
    for kind in (np.float32, np.float64):
        counts = rng.poisson(0.5, (30, 256)).astype(kind)
        matrix = counts / np.linalg.norm(counts, axis=1, keepdims=True).astype(kind)
        packed = neighbours._packed(matrix)
        assert np.array_equal(neighbours._unpacked(pa.chunked_array([packed])), matrix)
        assert max(map(len, packed.to_pylist())) < matrix[0].nbytes / 2


def test_rows_that_visit_every_cell_are_sent_a_bounded_number_at_a_time(spark, monkeypatch):
    rng = np.random.default_rng(3)
    pivots = neighbours.unit_rows(1.0 + 0.01 * rng.standard_normal((40, 8)))
    x = 1.0 + 0.01 * rng.standard_normal((6000, 8))
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(len(x))]), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "vector"])
    frame = spark.createDataFrame([("0", [1.0])], "id string, vector array<double>")
    monkeypatch.setattr(type(frame), "mapInArrow", lambda self, function, schema: function)
    run = neighbours._assign_cells(frame, pivots, np.full(len(pivots), 1.0), 0.5)
    sent = list(run(iter([batch])))
    home = (neighbours.unit_rows(x) @ pivots.T).argmax(axis=1)
    places = sorted((r["id"], r["cell"], r["visitor"]) for b in sent for r in b.select(["id", "cell", "visitor"]).to_pylist())
    want = [(str(i), int(c), c != h) for i, h in enumerate(home) for c in range(h, len(pivots))]
    assert places == sorted(want)
    assert max(b.num_rows for b in sent) <= 4096
