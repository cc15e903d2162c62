"""Operator 5: substring dedup by hashing lines, paragraphs or the sentences of lines.

Short units repeat in clean texts by chance, long passages do not, whatever the
length of their units.  What is hashed are therefore runs: from every unit the
fewest units onward, and up to every unit the fewest before it, that have
``min_words`` words together; a unit with enough words is a run by itself.  A
repeated passage of whole units with that many words is covered by such runs to
its last unit.  A text with fewer words is one run.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.storage import written
from .common import LOWER

#: Words of a run, at least.
MIN_WORDS = 16

#: What a unit is.  A sentence ends with marks before white space, or with its line, and has the white space behind it.
UNITS = {
    "sentence": re.compile(r"(?m)[^\n]*?[.!?]+(?:[ \t\r]+|$)|[^\n]+"),
    "line": re.compile(r"[^\n]+"),
    "paragraph": re.compile(r"(?:[^\n]|\n(?!\n))+"),
}

_FOLD = bytes(LOWER)
_BATCH = 20_000


def split(text: str, unit: re.Pattern) -> list[tuple[int, int, bytes, int]]:
    """(start, end, words, count) of the units that have a word; offsets count characters.

    Words are in lower case (A to Z) with one space between.
    """
    found = []
    for one in unit.finditer(text):
        words = one[0].encode("utf-8", "replace").translate(_FOLD).split()
        if words:
            found.append((one.start(), one.end(), b" ".join(words), len(words)))
    return found


def runs_of(units: list[tuple[int, int, bytes, int]], min_words: int) -> list[tuple[int, int]]:
    """(first, last) of the units of every run."""
    before = [0]
    for one in units:
        before.append(before[-1] + one[3])
    n, runs, j = len(units), [], 0
    if n and before[n] < min_words:
        return [(0, n - 1)]
    onward = [-1] * n
    for i in range(n):
        j = max(i, j)
        while j < n and before[j + 1] - before[i] < min_words:
            j += 1
        if j == n:
            break
        onward[i] = j
        runs.append((i, j))
    i = 0
    for j in range(n):
        while before[j + 1] - before[i + 1] >= min_words:
            i += 1
        if before[j + 1] - before[i] >= min_words and onward[i] != j:
            runs.append((i, j))
    return runs


def units_of(text: str, unit: re.Pattern, min_words: int) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, 128-bit digest) of the runs of a text."""
    units = split(text, unit)
    for i, j in runs_of(units, min_words):
        digest = hashlib.blake2b(b" ".join(u[2] for u in units[i:j + 1]), digest_size=16).digest()
        yield units[i][0], units[j][1], digest


def covered(text: str, unit: re.Pattern, runs: list[dict]) -> list[dict]:
    """The units that lie in any of ``runs`` (start, end, first_id), each with the smallest first_id of those."""
    units = split(text, unit)
    place = {one[0]: i for i, one in enumerate(units)}
    gone: dict[int, object] = {}
    for run in runs:
        i = place.get(run["start"], len(units))
        while i < len(units) and units[i][1] <= run["end"]:
            first = run["first_id"]
            gone[i] = first if i not in gone else min(gone[i], first, key=lambda x: (x is not None, x))
            i += 1
    return [{"start": units[i][0], "end": units[i][1], "first_id": gone[i]} for i in sorted(gone)]


def text_units(documents: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "line",
               min_words: int = MIN_WORDS) -> DataFrame:
    """(id, start, end, digest) of every run of at least ``min_words`` words.  Narrow."""
    pattern = UNITS[unit]
    rows = documents.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    fields = [("start", pa.int64()), ("end", pa.int64()), ("digest", pa.binary())]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, found = [], []

            def made() -> pa.RecordBatch:
                columns = list(zip(*found)) or [()] * 3
                return pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(row, pa.int64())), *(pa.array(c, t) for c, (_, t) in zip(columns, fields))],
                    names=["id", *(n for n, _ in fields)])

            for i, value in enumerate(batch.column("text")):
                if value.is_valid:
                    for one in units_of(value.as_py(), pattern, min_words):
                        row.append(i)
                        found.append(one)
                if len(found) >= _BATCH:
                    yield made()
                    row, found = [], []
            yield made()

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(find, f"id {kind}, start long, end long, digest binary")


def later_units(units: DataFrame) -> DataFrame:
    """Runs that equal an earlier one, with ``first_id`` and ``first_start``, its place.

    Earlier is a smaller id, or the same id and a smaller start; a run that
    overlaps the first one in its own document is no copy of it.  First places
    are an aggregate with partial minima, kept for repeated digests only and
    written, so the join back has two plain shuffles and a hot digest is split.
    """
    firsts = written(
        units.groupBy("digest").agg(F.min(F.struct("id", "start", "end")).alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1").select("digest", F.col("first.id").alias("first_id"), F.col("first.start").alias("first_start"),
                                F.col("first.end").alias("first_end")),
        "unit-firsts")
    return units.join(firsts.hint("merge"), "digest").filter(
        ~F.col("id").eqNullSafe(F.col("first_id")) | (F.col("start") >= F.col("first_end"))).drop("digest", "first_end")


def dedup_units(documents: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "line",
                min_words: int = MIN_WORDS) -> DataFrame:
    """Documents without the units of runs that stand in an earlier document or earlier in the same.

    Adds ``removed``, an array of (start, end, first_id) of the units that go,
    with character offsets in the original text, sorted, and the smallest id of
    the first places of their runs; ``n_chars_before``; and replaces the text by
    what is left; line ends stay.  Runs are judged on the input.  Lines are the
    plain choice; sentences also find a passage that is pasted into a line.

    A null text stays null and an empty one empty, with nothing removed; of
    equal texts the one with the smallest key stays whole.  Rows that repeat a
    key count as one document: a unit that goes in one goes in all.  A null key
    sorts before all others.  Of a very long text a task holds the words once more.  Other columns stay, but for those that have an
    added name; an empty table stays empty.  Texts are shuffled once, to their
    ranges, and the joins are sort-merge joins at every size.
    """
    later = later_units(text_units(documents, key, text, unit, min_words))
    gone = written(
        later.groupBy(F.col("id").alias("__id")).agg(
            F.array_sort(F.collect_set(F.struct("start", "end", "first_id"))).alias("removed")), "unit-removed")
    own = [f for f in documents.schema.fields if f.name not in ("removed", "n_chars_before")]
    joined = documents.select(*[F.col(f"`{f.name}`") for f in own]).join(
        gone.hint("merge"), F.col(f"`{key}`").eqNullSafe(F.col("__id")), "left")
    joined = joined.withColumn("n_chars_before", F.coalesce(F.length(F.col(f"`{text}`")), F.lit(0)).cast("long")).withColumn(
        "removed", F.coalesce("removed", F.array().cast(gone.schema["removed"].dataType))).drop("__id")
    names, pattern = joined.columns, UNITS[unit]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index(text)
            left, gone = [], []
            for value, runs in zip(batch.column(place), batch.column("removed")):
                body, kept, at = value.as_py(), [], 0
                gone.append(covered(body, pattern, runs.as_py()) if len(runs) and body is not None else [])
                for one in gone[-1]:
                    kept.append(body[at:max(at, one["start"])])
                    at = max(at, one["end"])
                left.append(body if body is None else "".join(kept) + body[at:])
            columns = list(batch.columns)
            columns[place] = pa.array(left, pa.string())
            columns[names.index("removed")] = pa.array(gone, batch.column("removed").type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    ddl = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in joined.schema.fields)
    return joined.mapInArrow(cut, ddl)
