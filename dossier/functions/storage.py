"""Where intermediate tables are written."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession


_LOCAL: dict[str, str] = {}
_OPEN: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only where all runs in one JVM."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith(("local[", "local,")) and spark.sparkContext.master != "local":
        raise PySparkException("set spark.checkpoint.dir to a folder shared by all executors")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL:
        _LOCAL[application] = tempfile.mkdtemp(prefix="dossier-")
    return _LOCAL[application]


def written(frame: DataFrame, name: str = "stage") -> DataFrame:
    """Write a stage to the shared folder and read it back.

    Cuts the lineage with files that survive the loss of any executor.
    """
    spark = frame.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for paths in _OPEN:
        paths.append(path)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[list[str]]:
    """Delete at the end what ``written`` has written inside.

    For a run whose results are saved elsewhere by then, or taken off the list
    of paths, which is in the order they were written.
    """
    paths: list[str] = []
    _OPEN.append(paths)
    try:
        yield paths
    finally:
        _OPEN[:] = [held for held in _OPEN if held is not paths]
        hadoop = spark._jvm.org.apache.hadoop.fs.Path
        for path in paths:
            place = hadoop(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
