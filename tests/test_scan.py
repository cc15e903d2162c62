"""Hashes of long files, read in pieces."""

import gzip
import hashlib

import numpy as np

from dossier.sources import files


def test_long_files_are_hashed_in_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "WHOLE", 2000)
    monkeypatch.setattr(files, "MAX_LINE", 20_000)
    rng = np.random.default_rng(5)
    noise = rng.integers(0, 256, 400_000, np.uint8).tobytes()
    bom = b"\xef\xbb\xbf"
    given = {
        "noise.bin": noise, "ends.txt": b"line\n" * 3000, "open.txt": b"line\r\n" * 3000 + b"last", "two.txt": b"x" * 3000 + b"\n\n",
        "begins.txt": b"\n\n" + b"a" * 3000, "mark.txt": bom + b"line\n" * 3000, "marks.txt": bom * 2 + b"line\n" * 900 + bom,
        "mark_open.txt": bom + b"l" * 3000, "only.bin": b"\n" * 5000, "bare.bin": b"\0" * 50_000, "bare_line.bin": b"\0" * 50_000 + b"\nend" + noise,
        "packed.gz": gzip.compress(noise), "not.gz": noise[:5000], "small.txt": b"small\n", "edge.txt": b"e" * 2000,
        "sub/a b%20+ü.txt": b"\xff\xfe\n" * 2000, "sub/deep/noise.parquet": noise[::-1],
    }
    for name, content in given.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    rows = files.scan_inventory(spark, str(tmp_path)).collect()
    got = {r["path"][len(str(tmp_path)) + 1:]: (r["hash"], r["size_bytes"]) for r in rows}
    assert len(rows) == len(given)
    assert got == {name: (hashlib.sha256(content).hexdigest(), len(content)) for name, content in given.items()}


def test_a_long_file_is_read_by_one_task_and_never_as_one_value(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "WHOLE", 2000)
    monkeypatch.setattr(files, "MAX_CONTENT", 10_000)  # longer files fit no value
    content = b"some line\n" * 100_000
    (tmp_path / "long.txt").write_bytes(content)
    (tmp_path / "long.gz").write_bytes(content)
    rows = {r["name"]: r["hash"] for r in files.scan_inventory(spark, str(tmp_path)).collect()}
    assert rows == {"long.txt": hashlib.sha256(content).hexdigest(), "long.gz": "error_too_large"}
