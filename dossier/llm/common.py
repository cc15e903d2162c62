"""Helpers shared by the operators: byte views of text columns, word hashes, ranks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Bytes of text that one numpy step works on; a longer text is a step of its own.
STEP_BYTES = 512 << 10

#: Bytes that separate words: space and the five ASCII line and tab characters.
WHITE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])

#: Upper-case ASCII letters as lower case, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

_RNG = np.random.default_rng(20240229)
BYTE_VALUE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
ODD = np.uint64(0xD6E8FEB86659FD93)
_POWERS: dict[str, np.ndarray] = {}


def powers(kind: str, base: np.uint64, size: int) -> np.ndarray:
    """base ** 0, 1, 2 … modulo 2 ** 64, kept and grown as needed."""
    known = _POWERS.get(kind)
    if known is None or len(known) < size:
        known = np.full(max(size, STEP_BYTES + 64), base, np.uint64)
        known[0] = 1
        np.multiply.accumulate(known, out=known)
        if size <= 2 * STEP_BYTES:
            _POWERS[kind] = known
    return known[:size]


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit values."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def steps(batch: pa.RecordBatch, column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of less than twice ``limit`` bytes of text; a longer text is a part alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    step = np.cumsum(sizes, dtype=np.int64) // limit
    large = np.flatnonzero(sizes > limit)
    edges = np.unique(np.concatenate([[0], np.flatnonzero(np.diff(step)) + 1, large, large + 1, [batch.num_rows]])).tolist()
    for begin, end in zip(edges, edges[1:]):
        if end > begin:
            yield batch.slice(begin, end - begin)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and the bounds of its rows; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[bounds[0]:bounds[-1]], bounds - bounds[0]


def spans_of(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the maximal runs of true bytes; no run crosses a row."""
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    if len(inside):
        edges = bounds[:-1][bounds[:-1] < len(inside)]
        before[edges] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[:-1] = inside[1:]
        edges = bounds[1:][bounds[1:] > 0] - 1
        after[edges] = False
        ends = np.flatnonzero(inside & ~after) + 1
    else:
        starts = ends = np.zeros(0, np.int64)
    return starts, ends, np.searchsorted(bounds, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each span of bytes; ``fold`` maps bytes to bytes first."""
    value = BYTE_VALUE if fold is None else BYTE_VALUE[fold]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(value[data] * powers("up", BASE, len(data)), out=sums[1:])
    size = (ends - starts).astype(np.uint64)
    return mixed((sums[ends] - sums[starts]) * powers("down", INVERSE, len(data) + 1)[starts] + size * ODD)


def window_hashes(hashes: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first position, hash) of every run of ``size`` hashes inside one row."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total = total * ODD + hashes[k:k + n]
    at = np.flatnonzero(rows[:n] == rows[size - 1:])
    return at, mixed(total[at])


def digest(column: str | Column) -> Column:
    """A 128-bit key of a text: null and the empty text are the same."""
    return F.md5(F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("binary"))


def ranked(table: DataFrame, key: str, order: list[str], buckets: int, name: str = "rank") -> DataFrame:
    """Add a rank, gapless from 0, among the rows of equal ``key``.

    A hot key is dealt over ``buckets``: rows are numbered inside a bucket and
    the counts of the buckets before are added.  ``table`` is read twice and has
    to give the same rows both times (a written table).
    """
    table = table.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = table.groupBy(key, "bucket").count()
    counts = counts.select(key, "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy(key, "bucket").orderBy(*order)
    return (
        table.withColumn("inside", F.row_number().over(inside) - 1).join(counts.hint("merge"), [key, "bucket"])
        .withColumn(name, F.col("before") + F.col("inside")).drop("bucket", "inside", "before")
    )


def bit_of(values: np.ndarray, bits: int) -> np.ndarray:
    """The place of each 64-bit value in a bitmap of 2 ** bits."""
    return (mixed(values.view(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.int64)


def holds(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each value may be in the set that a ``bitmap`` was made of; never false for one that is."""
    at = bit_of(values, len(bitmap).bit_length() + 2)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def bitmap(table: DataFrame, column: str, bits: int, slices: int = 32) -> np.ndarray:
    """A bitmap of 2 ** bits over the values of a long column, as bytes.

    Its size does not depend on the table: every task gives its own bitmap in
    slices, slices are united by Spark, and the driver gets the united ones.
    """
    size = (1 << bits) // 8

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked, seen = np.zeros(size, np.uint8), False
        for batch in batches:
            at = bit_of(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), bits)
            np.bitwise_or.at(marked, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
            seen = seen or len(at) > 0
        if seen:
            for i, part in enumerate(np.split(marked, slices)):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["slice", "marks"])

    def united(key, rows):
        total = np.zeros(size // slices, np.uint8)
        for part in rows.column("marks"):
            total |= np.frombuffer(part.as_buffer(), np.uint8)
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "marks": pa.array([total.tobytes()], pa.binary())})

    parts = table.select(column).mapInArrow(mark, "slice int, marks binary").groupBy("slice").applyInArrow(united, "slice int, marks binary")
    whole = np.zeros((slices, size // slices), np.uint8)
    for part in parts.collect():
        whole[part["slice"]] = np.frombuffer(part["marks"], np.uint8)
    return whole.reshape(-1)
