"""Distributed walk of a folder tree that every executor can see (a shared mount).

File-system tables of Spark leave out empty files and carry one time only; the
walk keeps both.  Folders are listed level by level in tasks, so neither the
tree nor a file's bytes pass through the driver.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.storage import written
from ..operators import inventory

ENTRY = ("path string, is_folder boolean, size_bytes long, created_time timestamp_ntz, "
         "modified_time timestamp_ntz, access_time timestamp_ntz, error string")
COLUMNS = [part.split()[0] for part in ENTRY.split(", ")]


def _code(error: OSError) -> str:
    """Error codes stand in for the hash."""
    known = {PermissionError: "error_permission", FileNotFoundError: "error_not_found"}
    return known.get(type(error), "error_locked")


def _utc(seconds: float) -> datetime:
    return datetime.fromtimestamp(seconds, timezone.utc).replace(tzinfo=None)


def _entries(folder: str) -> Iterator[tuple]:
    try:
        listing = os.scandir(folder)
    except OSError as error:  # the folder itself, without size
        yield folder, False, None, None, None, None, _code(error)
        return
    with listing:
        for entry in listing:
            try:
                if entry.is_dir(follow_symlinks=False):
                    yield entry.path, True, 0, None, None, None, None
                elif entry.is_file():
                    info = entry.stat()
                    created = getattr(info, "st_birthtime", info.st_ctime)
                    yield (entry.path, False, info.st_size, _utc(created), _utc(info.st_mtime), _utc(info.st_atime), None)
            except OSError as error:
                yield entry.path, False, None, None, None, None, _code(error)


def _list(batches: Iterator[pd.DataFrame], rows_per_batch: int = 10_000) -> Iterator[pd.DataFrame]:
    rows = []
    for batch in batches:
        for folder in batch["path"]:
            for entry in _entries(folder):
                rows.append(entry)
                if len(rows) >= rows_per_batch:
                    yield _frame(rows)
                    rows = []
    if rows:
        yield _frame(rows)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=COLUMNS).astype({"size_bytes": "Int64"})


def walk_files(spark: SparkSession, root: str) -> DataFrame:
    """Every file below ``root`` with size and its three times.

    A folder or entry that cannot be read is a row without size and times and
    with an ``error`` code.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    frontier = spark.createDataFrame([(os.path.abspath(root),)], "path string")
    levels = []
    while True:
        level = written(frontier.repartition(parts, "path").mapInPandas(_list, ENTRY), "walk")
        levels.append(level.filter("NOT is_folder").drop("is_folder"))
        frontier = level.filter("is_folder").select("path")
        if frontier.isEmpty():
            break
    files = levels[0]
    for level in levels[1:]:
        files = files.unionByName(level)
    return files


def _digest(path: str, error: str | None) -> str:
    if error:
        return error
    try:
        with open(path, "rb") as stream:
            return hashlib.file_digest(stream, "sha256").hexdigest()
    except OSError as failed:
        return _code(failed)


def hash_files(files: DataFrame) -> DataFrame:
    """Add ``hash``: SHA-256 of each file, read in pieces, of any length, or the error code."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(hash=[_digest(p, e) for p, e in zip(batch["path"], batch["error"])])

    files = files if "error" in files.columns else files.withColumn("error", F.lit(None).cast("string"))
    schema = files.schema.add("hash", "string")
    # spread by path, so one full folder does not become one task
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(parts, "path").mapInPandas(run, schema)


def walk_inventory(spark: SparkSession, root: str, with_hash: bool = True) -> DataFrame:
    """Inventory of a folder tree, empty files included."""
    files = walk_files(spark, root)
    files = hash_files(files) if with_hash else files.withColumn("hash", F.col("error"))
    files = files.drop("error")
    return inventory.inventory_row(files.withColumn("source_archive", F.lit("")), root=os.path.abspath(root))
