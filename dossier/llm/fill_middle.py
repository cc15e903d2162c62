"""Operator 11: fill-in-middle, assembled by secondary sort.

Every text is cut into prefix, middle and suffix, and these into pieces of a few
thousand code points, keyed by document and position in the output.  Pieces are
dealt by document and sorted inside their partition by position
(``repartition(...).sortWithinPartitions(...)``, the DataFrame form of
``repartitionAndSortWithinPartitions``), so a task reads every output from its
first piece to its last and feeds a running digest.  Restoring reads the marks
off that stream, numbers the pieces by their place in the source and sorts them
inside the partition once more: texts are shuffled once.  No task holds a whole
text after the cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import steps

#: Marks of prefix, suffix and middle, and the order of the parts in each form.
PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
FORMS = {"plain": ("",), "psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
#: Place of each part in the source.
_PLACE = {"": 0, PREFIX: 0, MIDDLE: 1, SUFFIX: 2}

#: Code points in a piece.
CHUNK = 1 << 13
_FLUSH_BYTES, _FLUSH_ROWS = 1 << 20, 4096


def cut(key: object, text: str, seed: int = 1, rate: int = 90, spm: int = 20) -> tuple[str, int, int]:
    """(form, end of prefix, end of middle) of one text, from a hash of its key alone."""
    name = "" if key is None else key
    h = hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    if not text or h3 % 100 >= rate or any(mark in text for mark in MARKS):
        return "plain", 0, 0
    a, b = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    return ("spm" if h4 % 100 < spm else "psm"), a, b


class _Rows:
    """Rows gathered into batches of bounded size."""

    def __init__(self, schema: pa.Schema) -> None:
        self.schema, self.rows, self.bytes = schema, [], 0

    def add(self, row: tuple, size: int = 0) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.bytes += size
        if self.bytes >= _FLUSH_BYTES or len(self.rows) >= _FLUSH_ROWS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = zip(*self.rows)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, self.schema)], schema=self.schema)
            self.rows, self.bytes = [], 0


def _schemas(documents: DataFrame, key: str) -> tuple[str, str]:
    kind = documents.schema[key].dataType.simpleString()
    first = f"id {kind}, n long, form string, prefix_chars long, middle_chars long"
    return f"row binary, pos long, body binary, {first}", f"row binary, pos long, body binary, {first}, output_sha256 string, copies long"


def _arrow(ddl: str, id_type: pa.DataType) -> pa.Schema:
    kinds = {"binary": pa.binary(), "long": pa.int64(), "string": pa.string()}
    names = [part.strip().split(" ", 1) for part in ddl.split(", ")]
    return pa.schema([(name, id_type if name == "id" else kinds[kind]) for name, kind in names])


def pieces(documents: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1, rate: int = 90, spm: int = 20,
           chunk: int = CHUNK) -> DataFrame:
    """(row, pos, body, id, n, form, prefix_chars, middle_chars): the pieces of every output; narrow.

    ``row`` names the document by its key, its text and the partition it was
    read from, not by a running number, so a task that runs again after a lost
    executor gives the same names in whatever order it reads its rows.  Rows that
    agree in key and text within a partition share a name; their pieces are
    counted, not mixed.  ``id`` and what follows stand on the first piece only.
    """
    rows = documents.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    ddl, _ = _schemas(documents, key)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for batch in batches:
            out = _Rows(_arrow(ddl, batch.column("id").type))
            for step in steps(batch, "text"):
                for name, value in zip(step.column("id").to_pylist(), step.column("text")):
                    body = value.as_py() or ""
                    form, a, b = cut(name, body, seed, rate, spm)
                    row = hashlib.blake2b(f"{part}:{name!r}:{form}:".encode() + body.encode(), digest_size=16).digest()
                    bounds = {"": (0, len(body)), PREFIX: (0, a), MIDDLE: (a, b), SUFFIX: (b, len(body))}
                    pos, plain = 0, form == "plain"
                    first = (name, len(body), form, None if plain else a, None if plain else b - a)
                    for mark in FORMS[form]:
                        begin, end = bounds[mark]
                        for at in range(begin, max(end, begin + 1), chunk):
                            piece = ((mark if at == begin else "") + body[at:min(at + chunk, end)]).encode()
                            yield from out.add((row, pos, piece, *(first if pos == 0 else (None,) * 5)), len(piece))
                            pos += 1
            yield from out.flush()

    return rows.mapInArrow(emit, ddl)


def assembled(parts: DataFrame) -> DataFrame:
    """The pieces of every output together and in order: one shuffle, sorted inside the partitions."""
    return parts.repartition("row").sortWithinPartitions("row", "pos")


class Splitter:
    """Reads the parts of one output off its pieces; a mark may lie across pieces."""

    def __init__(self, form: str) -> None:
        self.marks = [mark.encode() for mark in FORMS[form] if mark]
        self.places = [_PLACE[mark] for mark in FORMS[form]]
        self.place = None if self.marks else 0
        self.done, self.rest = 0, b""

    def feed(self, piece: bytes) -> Iterator[tuple[int, bytes]]:
        """(place in the source, bytes) of what is known to belong to a part."""
        data = self.rest + piece
        while self.done < len(self.marks):
            at = data.find(self.marks[self.done])
            if at < 0:
                keep = min(len(data), len(self.marks[self.done]) - 1)
                data, self.rest = data[:len(data) - keep], data[len(data) - keep:]
                if data and self.place is not None:
                    yield self.place, data
                return
            if at and self.place is not None:
                yield self.place, data[:at]
            self.place, data = self.places[self.done], data[at + len(self.marks[self.done]):]
            self.done += 1
        self.rest = b""
        if data and self.place is not None:
            yield self.place, data


def _outputs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, int, bytes, tuple]]:
    """(row, pos, body, first) of sorted pieces, equal pieces of equal rows counted: ``first`` ends with the copies so far."""
    for batch in batches:
        columns = [batch.column(name).to_pylist() for name in ("row", "pos", "id", "n", "form", "prefix_chars", "middle_chars")]
        for row, pos, *first, body in zip(*columns, batch.column("body")):
            yield row, pos, body.as_py(), tuple(first)


def restored(ordered: DataFrame) -> DataFrame:
    """From assembled outputs and their forms, the pieces of the source in its order.

    Before them stands a row (pos -1) with what is known of the output: its
    digest and how many equal rows it stands for.  Sorted inside the
    partitions; nothing is shuffled.
    """
    kind = ordered.schema["id"].dataType.simpleString()
    ddl = (f"row binary, pos long, body binary, id {kind}, n long, form string, prefix_chars long, middle_chars long, "
           "output_sha256 string, copies long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = last = first = digest = splitter = out = None
        copies = count = 0

        def known() -> tuple:
            return (now, -1, None, *first, digest.hexdigest(), copies)

        def typed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal out
            for batch in batches:
                out = out or _Rows(_arrow(ddl, batch.column("id").type))
                yield batch

        for row, pos, body, head in _outputs(typed(batches)):
            if row != now:
                if now is not None:
                    yield from out.add(known())
                now, first, digest, splitter, copies, count, last = row, head, hashlib.sha256(), Splitter(head[2]), 0, 0, None
            copies += pos == 0
            if pos == last:  # the same piece of an equal row
                continue
            last = pos
            digest.update(body)
            for place, data in splitter.feed(body):
                yield from out.add((row, (place << 40) + count, data, *(None,) * 7), len(data))
                count += 1
        if now is not None:
            yield from out.add(known())
            yield from out.flush()

    return ordered.mapInArrow(read, ddl).sortWithinPartitions("row", "pos")


def digests(sources: DataFrame) -> DataFrame:
    """One row per document: what is known of its output, and the digest of the text restored from it."""
    kind = sources.schema["id"].dataType.simpleString()
    ddl = (f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = digest = out = None
        for batch in batches:
            out = out or _Rows(_arrow(ddl, batch.column("id").type))
            columns = [batch.column(name).to_pylist() for name in (
                "pos", "id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "copies")]
            for pos, *head, body in zip(*columns, batch.column("body")):
                if pos >= 0:
                    digest.update(body.as_py())
                    continue
                if known:
                    for _ in range(known[-1]):
                        yield from out.add((*known[:-1], digest.hexdigest()))
                known, digest = head, hashlib.sha256()
        if known:
            for _ in range(known[-1]):
                yield from out.add((*known[:-1], digest.hexdigest()))
            yield from out.flush()

    return sources.mapInArrow(read, ddl)


def output_texts(documents: DataFrame, key: str = "doc_id", text: str = "text", **options: int) -> DataFrame:
    """(id, form, output): the whole output of every document, a row for each row.

    Joins the pieces as they come, so a task holds one text.  For outputs too
    long for a row, write ``assembled(pieces(documents))`` instead.
    """
    kind = documents.schema[key].dataType.simpleString()
    ddl = f"id {kind}, form string, output string"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = last = None
        parts, head, copies, schema = [], None, 0, None

        def whole() -> pa.RecordBatch:
            text = b"".join(parts).decode()
            return pa.RecordBatch.from_arrays(
                [pa.array(x, f.type) for x, f in zip(([head[0]] * copies, [head[2]] * copies, [text] * copies), schema)], schema=schema)

        def typed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal schema
            for batch in batches:
                schema = schema or _arrow(ddl, batch.column("id").type)
                yield batch

        for row, pos, body, first in _outputs(typed(batches)):
            if row != now:
                if now is not None:
                    yield whole()
                now, last, parts, head, copies = row, None, [], first, 0
            copies += pos == 0
            if pos != last:
                parts.append(body)
                last = pos
        if now is not None:
            yield whole()

    return assembled(pieces(documents, key, text, **options)).mapInArrow(read, ddl)


def round_trip(documents: DataFrame, key: str = "doc_id", text: str = "text", **options: int) -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of every row.

    A null or empty text is plain and empty; so is any text that contains a
    mark.  A null key hashes as the empty name.  Rows that repeat a key, with
    the same or another text, are rows of their own.  An empty table gives no
    row, other columns are not read, and a text of any length goes through in
    pieces; the digests need all of a document in one task, one piece at a time.
    """
    done = digests(restored(assembled(pieces(documents, key, text, **options))))
    return done.withColumnRenamed("id", key)
