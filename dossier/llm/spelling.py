"""Operator 13: spelling variants by a bit-sliced position index.

The vocabulary is laid out as bits: for every position and letter one bitset of
the words that have this letter there.  A query walks its letters once and keeps
two sets, the words that agree so far and those that differ by one edit so far;
each step is a handful of ``&`` and ``|`` over whole bitsets.  An inserted or
deleted letter shifts the position that is read by one.

Words of one length that share their first letters, or their last ones, are one
index.  One edit leaves the first or the last half of a word as it is, so two
near words meet in one of the two.  Bits are numbered from the most frequent
word down, so the near word of largest count is the lowest bit of the answer: a
query gives one row, never its pairs.  An index of more than BLOCK words is
dealt out in blocks, each asked by all queries of its group.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, functions as F

from ..functions.storage import written
from .common import steps

LEAST_LENGTH, LEAST_COUNT, EVERY = 5, 3, 97

#: Words of one index.
BLOCK = 1 << 14

#: Letters of a word that place it in a group, at most; half of a shorter word.
SHARED = 4

#: Maximal runs of LEAST_LENGTH letters or more, capitals of ASCII already lower: shorter ones give no word.
_RUN = re.compile(f"[a-zÀ-ÿ]{{{LEAST_LENGTH},}}")
_FLUSH = 200_000


def words_of(key: object, text: str) -> Counter:
    """Words of one text with their counts; some have lost a letter, as a hash of key and run says."""
    lowered = text.encode().lower().decode()  # bytes.lower() changes A to Z alone
    counts: Counter = Counter()
    start = zlib.crc32(f"{'' if key is None else key}:".encode())
    for run, n in Counter(_RUN.findall(lowered)).items():
        h = zlib.crc32(run.encode(), start)
        if h % EVERY == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
            if len(run) < LEAST_LENGTH:
                continue
        counts[run] += n
    return counts


def vocabulary(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): words of LEAST_LENGTH code points or more that occur LEAST_COUNT times or more in all texts."""
    rows = documents.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for step in steps(batch, "text"):
                for name, value in zip(step.column("id").to_pylist(), step.column("text")):
                    if value.is_valid:
                        for word, n in words_of(name, value.as_py()).items():
                            counts[word] += n
                        if len(counts) >= _FLUSH:
                            yield flushed()
        if counts:
            yield flushed()

    return rows.mapInArrow(scan, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


class PositionIndex:
    """Bitsets by position and letter over words of one length; bits count down from the largest n, then up in word order."""

    def __init__(self, words: list[tuple[str, int]]) -> None:
        self.words = sorted(words, key=lambda w: (-w[1], w[0]))
        self.length = len(self.words[0][0])
        self.all = (1 << len(self.words)) - 1
        members: list[dict[str, list[int]]] = [{} for _ in range(self.length)]
        for bit, (word, _) in enumerate(self.words):
            for letters, letter in zip(members, word):
                letters.setdefault(letter, []).append(bit)
        size = len(self.words) // 8 + 1
        self.at = [{letter: _bits(bits, size) for letter, bits in letters.items()} for letters in members]
        self._states: dict[int, list] = {}

    def near(self, query: str) -> int:
        """The bits of the words one edit from ``query``; queries that share first letters share those steps."""
        extra = self.length - len(query)
        if abs(extra) > 1:
            return 0
        # The query asked last, then (exact, one) after each of its letters.
        states = self._states.setdefault(extra, ["", (self.all, 0)])
        last, shared = states[0], 0
        while shared < min(len(last), len(query)) and last[shared] == query[shared]:
            shared += 1
        del states[shared + 2:]
        states[0] = query
        at, n = self.at, self.length
        exact, one = states[-1]
        for i in range(len(states) - 2, len(query)):
            letter = query[i]
            here = at[i].get(letter, 0) if i < n else 0
            if extra == 0:  # another letter: both sides move on
                one = one & here | exact & ~here
            elif extra > 0:  # the word has a letter more: it reads one position ahead afterwards
                one = (one | exact) & (at[i + 1].get(letter, 0) if i + 1 < n else 0)
            else:  # the word has a letter less: it reads one position behind afterwards
                one = (one & at[i - 1].get(letter, 0) if i else 0) | exact
            exact &= here
            states.append((exact, one))
        return one | exact if extra > 0 else one  # the letter more may be the last

    def sharing_first(self, letters: str) -> int:
        """The bits of the words that begin with ``letters``."""
        found = self.all
        for place, letter in zip(self.at, letters):
            found &= place.get(letter, 0)
        return found


def _bits(places: list[int], size: int) -> int:
    raw = bytearray(size)
    for p in places:
        raw[p >> 3] |= 1 << (p & 7)
    return int.from_bytes(raw, "little")


def shared_letters(length: int) -> int:
    """First or last letters that a near word of a word of this length keeps."""
    return min(length // 2, SHARED)


def _groups(words: DataFrame) -> DataFrame:
    """(place, own, word, n): every word in the indexes it belongs to and in those it asks.

    An index holds the words of one length with the same first (or last)
    letters; words a letter shorter or longer ask it as well.
    """
    size = F.length("word")
    each = words.select("word", "n", size.alias("size"), F.explode(F.array(
        *[F.struct((size + d).alias("length"), F.lit(side).alias("side")) for d in (-1, 0, 1) for side in "<>"])).alias("to"))
    length = F.col("to.length")
    shared = F.least(F.floor(length / 2).cast("int"), F.lit(SHARED))
    letters = F.when(F.col("to.side") == "<", F.substring("word", F.lit(1), shared)).otherwise(F.right("word", shared))
    return each.filter(length >= LEAST_LENGTH).select(
        F.concat_ws("", "to.side", length.cast("string"), letters).alias("place"), (length == F.col("size")).alias("own"), "word", "n")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, form, form_n) of the words (word, n) that have near words: how many, and the one of largest n.

    Ties go to the smallest word.  ``words`` has each word once.
    """
    grouped = written(_groups(words), "spelling-groups")
    sizes = written(grouped.filter("own").groupBy("place").agg(F.count(F.lit(1)).alias("rows")), "spelling-sizes")
    dealt = grouped.join(sizes.hint("merge"), "place").withColumn("blocks", F.ceil(F.col("rows") / BLOCK).cast("int"))
    dealt = dealt.withColumn("home", F.when(F.col("own"), F.pmod(F.xxhash64("word"), "blocks")).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "place", "block", F.coalesce(F.col("home") == F.col("block"), F.lit(False)).alias("member"), "word", "n")
    dealt = dealt.repartition("place", "block").sortWithinPartitions("place", "block", F.desc("member"), "word")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members, index, found = None, [], None, []

        def answer(word: str) -> None:
            bits = index.near(word)
            if bits and now[0][0] == ">":  # those that share the first letters too are found there
                bits &= ~index.sharing_first(word[:shared_letters(index.length)])
            if bits:
                form, n = index.words[(bits & -bits).bit_length() - 1]
                found.append((word, bits.bit_count(), form, n))

        def built() -> PositionIndex | None:
            nonlocal index
            index = PositionIndex(members) if members else None
            if index and (len(members) > 1):
                for word, _ in members:
                    answer(word)
            return index

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*found), (pa.string(), pa.int64(), pa.string(), pa.int64()))],
                names=["word", "n_near", "form", "form_n"])
            found.clear()
            return out

        for batch in batches:
            for place, block, member, word, n in zip(*(batch.column(c).to_pylist() for c in ("place", "block", "member", "word", "n"))):
                if (place, block) != now:
                    if members and index is None:
                        built()
                    now, members, index = (place, block), [], None
                if member:
                    members.append((word, n))
                else:
                    if index is None and members:
                        built()
                    if index:
                        answer(word)
            if len(found) >= 4096:
                yield flushed()
        if members and index is None:
            built()
        if found:
            yield flushed()

    answers = dealt.mapInArrow(ask, "word string, n_near long, form string, form_n long")
    return answers.groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("n"), "form")).alias("best")).select(
        "word", "n_near", F.col("best.form").alias("form"), (-F.col("best.n")).alias("form_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: the last word when forms are followed.

    Every form has at least twice the count of its word, so there are no rings;
    pointers double, which takes as many rounds as the logarithm of the longest chain.
    """
    now = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        seen = Observation()
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = now.join(onward.hint("merge"), "root", "left").observe(
            seen, F.count("further").alias("moved")).select("word", F.coalesce("further", "root").alias("root"))
        now = written(moved, "spelling-roots")
        if not seen.get["moved"]:
            return now


def variants(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary.

    A word's form is its near word of largest n (ties: the smallest in code-point
    order) if that n is twice its own or more; its root is the last form of
    forms, itself if it has none.  A null or empty text has no words; a null key
    counts as the empty one in the hash; a row that repeats another counts again,
    as its words occur again.  Other columns are not read and an empty table
    gives no row.  A very long text is split into words at once, in its own step.
    """
    words = written(vocabulary(documents, key, text), "spelling-words")
    near = written(near_words(words), "spelling-near")
    known = written(words.join(near.hint("merge"), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(F.col("form_n") >= 2 * F.col("n"), F.col("form")).alias("form"),
        F.when(F.col("form_n") >= 2 * F.col("n"), F.col("form_n")).alias("form_n")), "spelling-forms")
    roots = _roots(known.filter("form IS NOT NULL"))
    return known.join(roots.hint("merge"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
