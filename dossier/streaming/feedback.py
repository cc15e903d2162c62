"""Newest decision per file from a stream of actions or feedback."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.keyed import latest_per_key

#: Batches between two snapshots.
SNAPSHOT_EVERY = 20


class ChangeLog:
    """Changed rows by batch below ``target``, folded into a snapshot now and then.

    ``batch=N`` holds the keys that batch N changed.  Every ``every`` batches the
    last snapshot and the batches after it become ``_snapshots/upto=N``; then
    ``_manifests/N`` names it, and what it replaces is deleted but for one
    snapshot, which readers may still have open.  A snapshot counts once its
    manifest is there, so a run that dies before that leaves the batches to be
    read, and a batch that is repeated replaces itself.
    """

    def __init__(self, spark: SparkSession, target: str, key: str, every: int = SNAPSHOT_EVERY):
        self.spark, self.target, self.key, self.every = spark, target.rstrip("/"), key, every
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.target).getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self, folder: str, prefix: str) -> list[int]:
        place = self._path(f"{self.target}/{folder}" if folder else self.target)
        if not self._files.exists(place):
            return []
        names = [status.getPath().getName() for status in self._files.listStatus(place)]
        return sorted(int(n[len(prefix):]) for n in names if n.startswith(prefix) and n[len(prefix):].lstrip("-").isdigit())

    def snapshot(self) -> int | None:
        """The batch up to which the valid snapshot goes."""
        for number in reversed(self._numbers("_manifests", "")):
            stream = self._files.open(self._path(f"{self.target}/_manifests/{number}"))
            text = bytes(stream.readAllBytes()).decode()
            stream.close()
            if text.endswith("}") and json.loads(text)["upto"] == number:  # whole
                return number
        return None

    def _parts(self) -> list[str]:
        upto = self.snapshot()
        later = [f"{self.target}/batch={n}" for n in self._numbers("", "batch=") if upto is None or n > upto]
        return ([] if upto is None else [f"{self.target}/_snapshots/upto={upto}"]) + later

    def save(self, changed: DataFrame, batch: int) -> None:
        """Write the rows that a batch changed; at every ``every``-th batch a snapshot too."""
        changed.write.mode("overwrite").parquet(f"{self.target}/batch={batch}")
        if (batch + 1) % self.every == 0 and self.snapshot() != batch:
            self.state().write.mode("overwrite").parquet(f"{self.target}/_snapshots/upto={batch}")
            self._name(batch)
            self._clear()

    def _name(self, batch: int) -> None:
        stream = self._files.create(self._path(f"{self.target}/_manifests/{batch}"), True)
        stream.write(json.dumps({"upto": batch}).encode())
        stream.close()

    def _clear(self) -> None:
        named = self._numbers("_manifests", "")
        for number in named[:-2]:
            self._files.delete(self._path(f"{self.target}/_manifests/{number}"), True)
        for number in self._numbers("_snapshots", "upto="):
            if number not in named[-2:]:
                self._files.delete(self._path(f"{self.target}/_snapshots/upto={number}"), True)
        for number in self._numbers("", "batch="):
            if len(named) > 1 and number <= named[-2]:
                self._files.delete(self._path(f"{self.target}/batch={number}"), True)

    def state(self) -> DataFrame:
        """The newest row of every key: the snapshot and the batches after it."""
        numbered = [
            self.spark.read.parquet(part).selectExpr("*", f"{int(part.rsplit('=', 1)[1])} AS batch") for part in self._parts()
        ]
        if not numbered:
            raise FileNotFoundError(f"no batch below {self.target}")
        rows = numbered[0]
        for more in numbered[1:]:
            rows = rows.unionByName(more)
        return latest_per_key(rows, self.key, "batch").drop("batch")


def stream_latest(
    spark: SparkSession, source: str, schema: StructType, key: str, order: tuple[str, ...],
    target: str, checkpoint: str, files_per_batch: int | None = None, snapshot_every: int = SNAPSHOT_EVERY,
) -> StreamingQuery:
    """Keep the newest row per key in streaming state and log its changes.

    The state holds one row per key.  Every batch writes the keys it changed
    to a ``ChangeLog``, which folds batches into snapshots as it goes.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    latest = latest_per_key(reader.parquet(source), key, *order)
    log = ChangeLog(spark, target, key, snapshot_every)
    return (
        latest.writeStream.outputMode("update").foreachBatch(log.save)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def current_state(spark: SparkSession, target: str, key: str) -> DataFrame:
    """Newest row per key: one snapshot and fewer than ``SNAPSHOT_EVERY`` batches are read."""
    return ChangeLog(spark, target, key).state()


def compact(spark: SparkSession, target: str, key: str, compacted: str) -> None:
    """Write the current state as the first batch of a log in a new folder."""
    current_state(spark, target, key).write.mode("errorifexists").parquet(f"{compacted}/batch=-1")


def stream_feedback_latest(
    spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Newest action per file (file_id, ts, event_id, ...)."""
    return stream_latest(
        spark, source, schema, "file_id", ("ts", "event_id"), target, checkpoint, files_per_batch)
