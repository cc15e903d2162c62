"""Operator 2: token packing by shortest-pack-first over the length histogram."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
import tokenizers
from pyspark.sql import DataFrame, functions as F

from ..functions.storage import written
from .common import ranked

#: Tokens of a sequence, and the id that ends a document.
CAPACITY, END_ID = 1024, 0

#: Sub-buckets over which the pieces of one length are numbered.
RANK_BUCKETS = 256

_JSON, _RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
_SPECIAL = {"<|endoftext|>": 50256}


class Encoder:
    """Ids of the vocabulary ``byte_bpe_50k``.

    The rank file of the same vocabulary gives the same ids as the JSON file
    (checked by the tests) four times as fast; texts on which its pattern
    matcher gives up go to the JSON file's tokenizer.
    """

    _known: Encoder | None = None

    def __init__(self) -> None:
        with open(public_tokenizers.path(_RANKS), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding(
            "byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=_SPECIAL)
        self.exact: tokenizers.Tokenizer | None = None

    @classmethod
    def here(cls) -> Encoder:
        """One per Python worker."""
        cls._known = cls._known or cls()
        return cls._known

    def slow(self, text: str) -> np.ndarray:
        self.exact = self.exact or tokenizers.Tokenizer.from_file(public_tokenizers.path(_JSON))
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)

    def ids(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all")
        except ValueError as error:
            if "backtracking" not in str(error):  # the pattern matcher's limit on long white space
                raise
            return self.slow(text)


PIECES = "doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long"


def token_pieces(documents: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Documents as pieces of at most ``capacity`` ids: whole runs from the start, then the rest.  Narrow.

    A document is its ids and END_ID.  ``ids_crc32`` is of the piece's ids as
    little-endian unsigned 32-bit numbers.
    """
    rows = documents.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.here()
        for batch in batches:
            row, out = [], []
            for i, value in enumerate(batch.column("text")):
                ids = encoder.ids(value.as_py()) if value.is_valid else np.zeros(0, np.uint32)
                ids = np.append(ids, np.uint32(END_ID)).astype("<u4", copy=False)
                for start in range(0, len(ids), capacity):
                    piece = ids[start:start + capacity]
                    row.append(i)
                    out.append((start, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row, pa.int64())), *(pa.array(c, pa.int64()) for c in columns)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return rows.mapInArrow(cut, PIECES.format(kind=kind))


@dataclass
class Pattern:
    """``count`` sequences of the same composition: (length, how many), longest first."""

    count: int
    lengths: list[tuple[int, int]] = field(default_factory=list)

    def used(self) -> int:
        return sum(length * n for length, n in self.lengths)


def pack_histogram(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Shortest pack first: each length, longest first, goes to the pack with the most room.

    All packs of equal room and composition are one pattern with a count, so a
    step takes as many pieces as a pattern has packs; the last pattern of a
    length is split in two.  A length adds three patterns at most: there are no
    more than 3 x capacity, whatever the number of documents.
    """
    by_room: list[list[Pattern]] = [[] for _ in range(capacity + 1)]
    shortest = 0  # no pack has more room than this
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while shortest >= length and not by_room[shortest]:
                shortest -= 1
            if shortest < length:
                # A new pack is the shortest, so it takes this length again as long as it fits.
                copies = capacity // length
                for count, n in ((left // copies, copies), (1, left % copies)):
                    if count and n:
                        by_room[capacity - n * length].append(Pattern(count, [(length, n)]))
                        shortest = max(shortest, capacity - n * length)
                break
            pattern = by_room[shortest].pop()
            taken = min(left, pattern.count)
            if pattern.count > taken:
                by_room[shortest].append(Pattern(pattern.count - taken, list(pattern.lengths)))
            lengths = list(pattern.lengths)
            if lengths and lengths[-1][0] == length:
                lengths[-1] = (length, lengths[-1][1] + 1)
            else:
                lengths.append((length, 1))
            by_room[shortest - length].append(Pattern(taken, lengths))
            left -= taken
    return [p for room in by_room for p in room]


def intervals(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, copies in a sequence, offset) of every pattern's lengths."""
    rows, used, sequence = [], {}, 0
    for pattern in patterns:
        offset = 0
        for length, copies in pattern.lengths:
            begin = used.get(length, 0)
            used[length] = begin + pattern.count * copies
            rows.append((length, begin, used[length], sequence, copies, offset))
            offset += length * copies
        sequence += pattern.count
    return rows


def pack(documents: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """All documents as pieces placed in sequences of at most ``capacity`` tokens.

    Returns per piece (key, start, length, ids_crc32, doc_tokens, sequence_id,
    offset).  A null or empty text is one piece with the end id; longer
    documents than a sequence are cut after every ``capacity`` ids.  Rows that
    tie or repeat are packed each for itself; a null key is ordered first; an
    empty table gives no piece; other columns are not read.

    Only the histogram of lengths, ``capacity`` rows, reaches the driver.  The
    patterns go back as at most 3 x capacity x sqrt(2 x capacity) intervals of
    ranks, whatever the number of documents; pieces of one length are numbered
    over sub-buckets, so a length that most pieces have is no hot key.
    """
    pieces = written(token_pieces(documents, key, text, capacity), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    spark = documents.sparkSession
    places = spark.createDataFrame(
        intervals(pack_histogram(histogram, capacity)),
        "p_length long, begin long, end long, first_sequence long, copies long, first_offset long")
    numbered = ranked(pieces, "length", ["doc_id", "start", "ids_crc32"], RANK_BUCKETS)
    inside = F.col("rank") - F.col("begin")
    return numbered.join(
        F.broadcast(places), (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("begin")) & (F.col("rank") < F.col("end"))
    ).select(
        F.col("doc_id").alias(key), "start", "length", "ids_crc32", "doc_tokens",
        (F.col("first_sequence") + F.floor(inside / F.col("copies"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + F.pmod(inside, F.col("copies")) * F.col("length")).cast("long").alias("offset"))
