"""Operator 1: removal of repeated byte strings with run-length indexes.

A window is a string of ``length`` bytes.  Its anchor is the leftmost smallest
hash of the short strings in it, so equal windows have equal anchors at equal
places, and a text falls into stretches of windows with one anchor each (a
context: all bytes of these windows).  Contexts are dealt out by their anchor:
equal windows meet wherever they stand, and unique text stays where it is.

Contexts equal as a whole enter once, as their earliest place, which is what
the run compression would make of them; their later places are repeats from end
to end.  Where an anchor has several contexts, a run-length index over them
streams their matching statistics and marks the windows that start earlier.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from ..functions.storage import written
from .common import BASE, BYTE_VALUE, INVERSE, ODD, bitmap, bytes_of, holds, mixed, powers, steps
from .run_index import RunIndex

#: Bytes of a repeated string, and of the short strings that choose anchors.
LENGTH, GRAM = 100, 32

#: Bytes of contexts in one index.
INDEX_BYTES = 1 << 20

#: An anchor with more contexts is judged window by window, by partial minima over window hashes.
CONTEXTS = 20_000

#: Bitmaps of what is worth sending on.
ANCHOR_BITS, PLACE_BITS = 26, 26

#: A longer text is cut into parts of this many windows.
PART = 4 << 20


class Stretches:
    """Windows of texts by anchor: arrays over stretches of consecutive windows with one anchor."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> None:
        self.data = data
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_VALUE[data] * powers("up", BASE, n), out=self.sums[1:])
        self.down = powers("down", INVERSE, n + 1)
        windows = max(0, n - length + 1)
        if not windows:
            self.row = self.start = self.count = self.base = np.zeros(0, np.int64)
            self.anchor = self.context = np.zeros(0, np.int64)
            return
        grams = mixed((self.sums[gram:] - self.sums[:-gram]) * self.down[:n - gram + 1])
        low = np.uint64((1 << 24) - 1)
        least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        width, reach = length - gram + 1, 1
        while reach * 2 <= width:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if reach < width:
            least = np.minimum(least[:len(least) - (width - reach)], least[width - reach:])
        at = (least & low).astype(np.int64)
        # A window counts if it ends inside the text in which it begins.
        valid = np.zeros(windows, bool)
        for begin, end in zip(bounds[:-1], bounds[1:]):
            if end - begin >= length:
                valid[begin:end - length + 1] = True
        first = valid.copy()
        first[1:] &= (at[1:] != at[:-1]) | ~valid[:-1]
        edge = bounds[:-1][bounds[:-1] < windows]
        first[edge] = valid[edge]
        starts = np.flatnonzero(first)
        stop = np.zeros(windows, bool)
        stop[:-1] = valid[:-1] & (first[1:] | ~valid[1:])
        stop[-1] = valid[-1]
        ends = np.flatnonzero(stop)
        self.row = np.searchsorted(bounds, starts, "right") - 1
        self.start, self.count = starts - bounds[self.row], ends - starts + 1
        self.anchor = grams[at[starts]].view(np.int64)
        self.base = starts
        self.context = self.hash(starts, ends + length, at[starts] - starts)

    def hash(self, starts: np.ndarray, ends: np.ndarray, more: np.ndarray | int = 0) -> np.ndarray:
        """64-bit hash of the bytes of each range."""
        size = (ends - starts + np.asarray(more) * 65536).astype(np.uint64)
        return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts] + size * ODD).view(np.int64)


def _parts(rows: DataFrame, length: int, gram: int, columns: list[tuple[str, pa.DataType]], choose) -> DataFrame:
    """Rows that ``choose(stretches)`` makes of each part of the texts: (stretch index, arrays)."""
    kind = rows.schema["id"].dataType.simpleString()
    names = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch, "text"):
                ids = step.column("id")
                data, bounds = bytes_of(step.column("text"))
                for at in range(0, max(1, len(data)), PART):
                    if len(data) <= PART + length:
                        part, edges, skip = data, bounds, 0
                    elif step.num_rows == 1:
                        part = data[at:at + PART + length - 1]
                        edges, skip = np.array([0, len(part)]), at
                    else:  # a step of several rows is never longer than two steps
                        part, edges, skip = data, bounds, 0
                    found = Stretches(part, edges, length, gram)
                    index, *arrays = choose(found, skip)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(found.row[index])), *(pa.array(a, t) for a, (_, t) in zip(arrays, columns))],
                        names=["id", *(n for n, _ in columns)])
                    if part is data:
                        break

    return rows.mapInArrow(emit, f"id {kind}, " + ", ".join(f"{n} {names[t]}" for n, t in columns))


def _spans_by_index(rows: DataFrame, length: int) -> DataFrame:
    """(id, start, end) of bytes covered by windows that start earlier among the contexts of one anchor."""
    kind = rows.schema["id"].dataType.simpleString()
    dealt = rows.repartition("anchor").sortWithinPartitions("anchor", "id", "start")

    def indexed(ids: list, starts: list, texts: list, id_type: pa.DataType) -> pa.RecordBatch:
        bounds = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=bounds[1:])
        flags = RunIndex(np.frombuffer(b"".join(texts), np.uint8), bounds, length).repeated()
        edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
        first, last = edges[::2], edges[1::2]  # a context's last windows are no windows, so runs never meet
        of = np.searchsorted(bounds, first, "right") - 1
        begin = np.array(starts, np.int64)[of] - bounds[of]
        return pa.RecordBatch.from_arrays(
            [pa.array([ids[i] for i in of], id_type), pa.array(begin + first), pa.array(begin + last + length - 1)],
            names=["id", "start", "end"])

    def overlaid(ids: list, starts: list, texts: list, id_type: pa.DataType) -> pa.RecordBatch:
        """Contexts of rows that repeat an id and lie over each other: each window by its first place."""
        windows, first, rank = [], {}, 0
        for i, (begin, text) in enumerate(zip(starts, texts)):
            rank += i > 0 and ids[i] != ids[i - 1]
            for at in range(len(text) - length + 1):
                window, place = hash(text[at:at + length]), (rank, begin + at)
                windows.append((window, place, i))
                first[window] = min(first.get(window, place), place)
        later = [(ids[i], place[1]) for window, place, i in windows if first[window] < place]
        begin = np.array([b for _, b in later], np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array([i for i, _ in later], id_type), pa.array(begin), pa.array(begin + length)], names=["id", "start", "end"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, starts, texts, held, now, id_type = [], [], [], 0, None, pa.int64()
        since, reach, over, seen = 0, 0, False, set()  # of this anchor: first entry, end of the id's windows, whether they meet, texts at this place
        for batch in batches:
            id_type = batch.column("id").type
            for anchor, id_, start, text in zip(*(batch.column(c).to_pylist() for c in ("anchor", "id", "start", "bytes"))):
                if anchor != now:
                    if over:
                        yield overlaid(ids[since:], starts[since:], texts[since:], id_type)
                        del ids[since:], starts[since:], texts[since:]
                        held = sum(map(len, texts))
                    if held >= INDEX_BYTES:
                        yield indexed(ids, starts, texts, id_type)
                        ids, starts, texts, held = [], [], [], 0
                    since, over = len(ids), False
                again = anchor == now and id_ == ids[-1]
                if again and start == starts[-1]:
                    if text in seen:  # rows that repeat an id: one place enters once
                        continue
                else:
                    seen = set()
                seen.add(text)
                over = over or again and start < reach
                end = start + len(text) - length + 1
                reach = max(reach, end) if again else end
                now = anchor
                ids.append(id_)
                starts.append(start)
                texts.append(text)
                held += len(text)
        if over:
            yield overlaid(ids[since:], starts[since:], texts[since:], id_type)
            del ids[since:], starts[since:], texts[since:]
        if texts:
            yield indexed(ids, starts, texts, id_type)

    return dealt.mapInArrow(emit, f"id {kind}, start long, end long")


def repeated_spans(documents: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM,
                   contexts: int = CONTEXTS) -> DataFrame:
    """(id, start, end): byte ranges covered by a string of ``length`` bytes that also starts earlier.

    Earlier is a smaller id, or the same id and an earlier start.  Ranges of an
    id may overlap; together they are all such bytes.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    long_ = pa.int64()

    def share(table: DataFrame, column: str, bits: int) -> Broadcast:
        return spark.sparkContext.broadcast(bitmap(table, column, bits))

    # Anchors that occur once are no repeats: they end here, after partial counts.
    anchors = _parts(rows, length, gram, [("anchor", long_)], lambda s, skip: (np.arange(len(s.anchor)), s.anchor)).groupBy("anchor").agg(
        F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor")
    anchors = written(anchors, "suffix-anchors")
    marked = share(anchors, "anchor", ANCHOR_BITS)

    def places(s: Stretches, skip: int) -> tuple:
        i = np.flatnonzero(holds(marked.value, s.anchor))
        return i, s.anchor[i], s.context[i], s.start[i] + skip, s.count[i]

    found = written(_parts(rows, length, gram, [("anchor", long_), ("context", long_), ("start", long_), ("count", long_)], places),
                    "suffix-places")
    by_context = found.groupBy("anchor", "context").agg(
        F.min(F.struct("id", "start")).alias("first"), F.count(F.lit(1)).alias("n"))
    by_context = written(by_context.select("anchor", "context", "first.id", "first.start", "n"), "suffix-contexts")

    # Later places of a context are repeats from end to end.
    firsts = by_context.filter("n > 1").select("anchor", "context", F.col("id").alias("f_id"), F.col("start").alias("f_start"))
    whole = found.join(firsts.hint("merge"), ["anchor", "context"]).filter(
        ~F.col("id").eqNullSafe(F.col("f_id")) | (F.col("start") != F.col("f_start"))
    ).select("id", "start", (F.col("start") + F.col("count") + length - 1).alias("end"))

    # Anchors with several contexts: the bytes of each context's first place.
    several = written(by_context.groupBy("anchor").agg(F.count(F.lit(1)).alias("contexts")).filter("contexts > 1"), "suffix-several")
    firsts = by_context.join(several.hint("merge"), "anchor").filter(F.col("contexts") <= contexts)
    wanted = written(firsts.select("anchor", "context", F.col("id").alias("w_id"), "start"), "suffix-wanted")
    place = F.col("context").bitwiseXOR(F.col("start")).alias("place")
    chosen_marks = share(wanted.select(place), "place", PLACE_BITS)

    def bodies(s: Stretches, skip: int) -> tuple:
        i = np.flatnonzero(holds(chosen_marks.value, s.context ^ (s.start + skip)))
        raw = s.data.tobytes()
        return i, s.context[i], s.start[i] + skip, [raw[b:b + c + length - 1] for b, c in zip(s.base[i], s.count[i])]

    bodies_ = _parts(rows, length, gram, [("context", long_), ("start", long_), ("bytes", pa.binary())], bodies)
    chosen = bodies_.join(wanted.hint("merge"), ["context", "start"]).filter(
        F.col("id").eqNullSafe(F.col("w_id"))).select("anchor", "id", "start", "bytes")
    spans = whole.unionByName(_spans_by_index(chosen, length))

    crowded = several.filter(F.col("contexts") > contexts).select("anchor")
    if crowded.limit(1).count():
        spans = spans.unionByName(_spans_by_window(rows, share(crowded, "anchor", ANCHOR_BITS), length, gram))
    return spans


def _spans_by_window(rows: DataFrame, crowded: Broadcast, length: int, gram: int) -> DataFrame:
    """Repeats of anchors with very many contexts: each window by its hash, first places as partial minima."""
    def windows(s: Stretches, skip: int) -> tuple:
        i = np.flatnonzero(holds(crowded.value, s.anchor))
        of = np.repeat(i, s.count[i])
        inside = np.arange(len(of)) - np.repeat(np.cumsum(s.count[i]) - s.count[i], s.count[i])
        begin = s.base[of] + inside if len(of) else np.zeros(0, np.int64)
        return of, s.hash(begin, begin + length), s.start[of] + inside + skip

    found = written(_parts(rows, length, gram, [("window", pa.int64()), ("start", pa.int64())], windows), "suffix-windows")
    firsts = found.groupBy("window").agg(F.min(F.struct("id", "start")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    firsts = written(firsts.select("window", "first"), "suffix-window-firsts")
    return found.join(firsts.hint("merge"), "window").filter(
        ~F.col("id").eqNullSafe(F.col("first.id")) | (F.col("start") != F.col("first.start"))
    ).select("id", "start", (F.col("start") + length).alias("end"))


CUT = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())]


def remove_repeats(documents: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, with_text: bool = True,
                   contexts: int = CONTEXTS) -> DataFrame:
    """Per row: key, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and, if wanted, the bytes kept.

    Every byte under a string of ``length`` bytes that also starts earlier goes;
    strings are judged on the input and overlaps count.  Matches end at the
    bounds of a document.  A null text is empty; a text shorter than ``length``
    stays whole; of equal texts the one with the smallest key stays.  Rows that
    repeat a key count as one document whose texts lie over each other: what
    goes in one goes in all.  A null key sorts before all others.  Other columns
    are not read; an empty table gives no row.

    The kept bytes need not be UTF-8, so they are binary.  A text is shuffled
    once, to its spans; the answer is exact but for equal 64-bit hashes.
    """
    spans = repeated_spans(documents, key, text, length, contexts=contexts)
    cuts = written(spans.groupBy(F.col("id").alias("s_id")).agg(
        F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends")), "suffix-cuts")
    rows = documents.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("binary").alias("text"))
    joined = rows.join(cuts.hint("merge"), F.col("id").eqNullSafe(F.col("s_id")), "left").select("id", "text", "starts", "ends")
    fields = CUT if with_text else CUT[:-1]
    kind = rows.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text_, starts, ends in zip(batch.column("text"), batch.column("starts"), batch.column("ends")):
                body = memoryview(text_.as_buffer()) if text_.is_valid else memoryview(b"")
                out.append(_cut(body, starts, ends)[:len(fields)])
            columns = list(zip(*out)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *(pa.array(c, t) for c, (_, t) in zip(columns, fields))], names=["id", *(n for n, _ in fields)])

    names = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    done = joined.mapInArrow(cut, f"id {kind}, " + ", ".join(f"{n} {names[t]}" for n, t in fields))
    return done.withColumnRenamed("id", key)


def _cut(body: memoryview, starts: pa.Scalar, ends: pa.Scalar) -> tuple:
    """Counts, digest and bytes of what is left of a text."""
    if not starts.is_valid:
        return len(body), 0, 0, hashlib.sha256(body).hexdigest(), bytes(body)
    begin, end = (x.values.to_numpy(zero_copy_only=False) for x in (starts, ends))
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.minimum(np.maximum.accumulate(end[order]), len(body))
    first = np.ones(len(begin), bool)
    first[1:] = begin[1:] > end[:-1]
    begin, end = begin[first], np.append(end[:-1][first[1:]], end[-1])
    inside = begin < end
    begin, end = begin[inside], end[inside]
    left = b"".join(body[a:b] for a, b in zip(np.append(0, end), np.append(begin, len(body))))
    return len(body), len(body) - len(left), len(begin), hashlib.sha256(left).hexdigest(), left
