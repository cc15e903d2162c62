"""Operator 10: benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised to their words in lower case with one space before and
after each; the automaton holds every window of ``size`` words of the test
items in the same form, so one scan of a text finds all windows at word bounds.
Byte places in the normalised text lead back to words, and words to the offsets
of the original text.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

#: Words of a window; a test item of fewer words is one window.
WINDOW = 10

#: Bytes of test text in one automaton; a larger benchmark is scanned in blocks of this size.
BLOCK_BYTES = 512 << 10

#: Bytes that are no part of a word: all ASCII but digits and letters.
_WORD_BYTE = [b >= 0x80 or chr(b).isalnum() for b in range(256)]
_FOLD = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if _WORD_BYTE[b] else 0x20 for b in range(256))
#: A word of the original text, which still has capitals.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def normal_words(text: str | bytes | None) -> list[bytes]:
    """The words of a text in lower case (A to Z only), as UTF-8 bytes."""
    data = text.encode() if isinstance(text, str) else text or b""
    return data.translate(_FOLD).split()


def windows_of(words: list[bytes], size: int) -> set[str]:
    """Windows as the automaton holds them: one Latin-1 character per byte, a space around each word."""
    if not words:
        return set()
    return {f" {b' '.join(words[i:i + size]).decode('latin-1')} " for i in range(max(1, len(words) - size + 1))}


def blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text", size: int = WINDOW,
           block_bytes: int = BLOCK_BYTES) -> list[tuple[str, Broadcast]]:
    """The test items as named broadcast blocks of at most ``block_bytes`` of text (or one item)."""
    spark, done, block, held = benchmark.sparkSession, [], [], 0

    def close() -> None:
        done.append((uuid.uuid4().hex, spark.sparkContext.broadcast((size, block))))

    for name, body in benchmark.select(F.coalesce(F.col(f"`{item}`").cast("string"), F.lit("null")), F.col(f"`{text}`")).toLocalIterator():
        if held and held + len(body or "") > block_bytes:
            close()
            block, held = [], 0
        block.append((name, body))
        held += len(body or "")
    close()
    return done


_AUTOMATA: dict[str, ahocorasick.Automaton] = {}


def _automaton(name: str, shared: Broadcast) -> ahocorasick.Automaton:
    """The automaton of a block, built once in each Python worker; only the last one is kept."""
    if name not in _AUTOMATA:
        size, items = shared.value
        windows: dict[str, list[str]] = {}
        for item, body in items:
            for window in windows_of(normal_words(body), size):
                windows.setdefault(window, []).append(item)
        automaton = ahocorasick.Automaton()
        for window, found in windows.items():
            automaton.add_word(window, (len(window), *found))
        automaton.make_automaton()
        _AUTOMATA.clear()
        _AUTOMATA[name] = automaton
    return _AUTOMATA[name]


_RUN = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def scan(text: bytes | None, automaton: ahocorasick.Automaton) -> tuple[int, list[tuple[int, int]], list[str]]:
    """(words, merged runs of hit words [first, end), items with a window here)."""
    words = normal_words(text)
    if not words or not len(automaton):
        return len(words), [], []
    plain = f" {b' '.join(words).decode('latin-1')} "
    hits = list(automaton.iter(plain))
    if not hits:
        return len(words), [], []
    # The place of a space is the number of words before it.
    starts = np.cumsum([0, *(len(w) + 1 for w in words)])
    runs, items = [], set()
    spans = sorted((end + 1 - value[0], end) for end, value in hits)
    for first, end in zip(np.searchsorted(starts, [a for a, _ in spans]), np.searchsorted(starts, [b for _, b in spans])):
        if runs and first <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(runs[-1][1], int(end)))
        else:
            runs.append((int(first), int(end)))
    for _, value in hits:
        items.update(value[1:])
    return len(words), runs, sorted(items)


def original_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets [start, end) in the original text of runs of words."""
    if not runs:
        return []
    at = [m.span() for m in _WORD.finditer(text)]
    return [(at[first][0], at[end - 1][1]) for first, end in runs]


def find_contamination(documents: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
                       item_text: str = "text", size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All columns of the documents, and what of the benchmark stands in them.

    Adds ``n_words``, ``runs`` (word ranges [first, end) under any window,
    merged), ``n_hit``, ``items`` (item ids as strings, sorted), ``spans`` (the
    runs as character offsets of the original text) and ``contaminated``.

    A row's words are counted on the whole text; a null or empty text has none
    and is clean.  Items without a word have no window; a null item id is named
    ``null``; an empty benchmark finds
    nothing.  Rows that repeat or tie are judged each for itself.  A column of
    the documents that has one of the added names is replaced.  Narrow: the
    benchmark is broadcast in blocks of bounded size, texts are not shuffled.
    A benchmark of more than one block scans the texts once for each block.
    """
    added = ["n_words", "runs", "n_hit", "items", "spans", "contaminated"]
    result = documents.drop(*added)
    for number, (name, shared) in enumerate(blocks(benchmark, item, item_text, size, block_bytes)):
        result = _with_block(result, name, shared, text, first=number == 0)
    return result.withColumn("contaminated", F.col("n_hit") > 0)


def _with_block(documents: DataFrame, name: str, shared: Broadcast, text: str, first: bool) -> DataFrame:
    """Scan with one block; what an earlier block has found is kept and merged."""
    schema = documents.schema
    extra = [("n_words", "long"), ("runs", "array<struct<first:bigint,end:bigint>>"), ("n_hit", "long"), ("items", "array<string>"),
             ("spans", "array<struct<start:bigint,end:bigint>>")]
    kept = [f for f in schema.fields if f.name not in dict(extra)]
    ddl = ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept] + [f"{n} {t}" for n, t in extra])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(name, shared)
        for batch in batches:
            texts = batch.column(text)
            before = batch.column("runs").to_pylist() if not first else [[]] * batch.num_rows
            named = batch.column("items").to_pylist() if not first else [[]] * batch.num_rows
            counts, runs, items, spans = [], [], [], []
            for value, earlier, names in zip(texts, before, named):
                body = value.as_buffer().to_pybytes() if value.is_valid else None
                n, new, ids = scan(body, automaton)
                if earlier:
                    new = merged([*((r["first"], r["end"]) for r in earlier), *new])
                counts.append(n)
                runs.append([{"first": a, "end": b} for a, b in new])
                items.append(sorted({*names, *ids}))
                spans.append([{"start": a, "end": b} for a, b in original_spans(body.decode("utf-8", "replace") if new else "", new)])
            hit = [sum(r["end"] - r["first"] for r in x) for x in runs]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in kept), pa.array(counts, pa.int64()), pa.array(runs, _RUN),
                 pa.array(hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, _SPAN)],
                names=[*(f.name for f in kept), *(n for n, _ in extra)])

    return documents.mapInArrow(found, ddl)


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges that touch or overlap as one."""
    done: list[tuple[int, int]] = []
    for first, end in sorted(runs):
        if done and first <= done[-1][1]:
            done[-1] = (done[-1][0], max(done[-1][1], end))
        else:
            done.append((first, end))
    return done
