"""Operator 4: quality by weak supervision.

Rules look at counts of a text and vote good, bad or abstain.  Expectation
maximisation over the table of vote patterns estimates how each rule votes on
good and on bad texts (its accuracy), and every text gets the posterior
probability of being good.  No rule alone rejects a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import WHITE, bytes_of, span_hashes, spans_of, steps, window_hashes

#: Words of the windows that count as repeated.
REPEAT_WINDOW = 8

_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_UPPER = (np.arange(256) >= ord("A")) & (np.arange(256) <= ord("Z"))
_STOP = np.isin(np.arange(256), list(b".!?"))
#: Second bytes of the capitals in U+00C0 to U+00DE, behind 0xC3.
_CAPITAL = (np.arange(256) >= 0x80) & (np.arange(256) <= 0x9E) & (np.arange(256) != 0x97)
_FIRST = (np.arange(256) & 0xC0) != 0x80

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_symbol_words",
          "n_ends", "n_shouts")


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _doubles(rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks of entries that repeat an earlier (row, key), and of all that occur twice or more."""
    order = np.lexsort((keys, rows))
    same = np.zeros(len(keys), bool)
    same[1:] = (rows[order][1:] == rows[order][:-1]) & (keys[order][1:] == keys[order][:-1])
    any_ = same.copy()
    any_[:-1] |= same[1:]
    later, twice = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order], twice[order] = same, any_
    return later, twice


def counts(column: pa.Array) -> list[np.ndarray]:
    """COUNTS of each text of a column."""
    data, bounds = bytes_of(column)
    n = len(bounds) - 1
    inside = ~WHITE[data]
    starts, ends, rows = spans_of(inside, bounds)
    n_words = np.bincount(rows, minlength=n)
    at, windows = window_hashes(span_hashes(data, starts, ends), rows, REPEAT_WINDOW)
    _, twice = _doubles(rows[at], windows)
    cover = np.zeros(len(rows) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + REPEAT_WINDOW, -1)
    n_repeat = np.bincount(rows[np.cumsum(cover[:-1]) > 0], minlength=n)
    first, last, of = spans_of(data != 10, bounds)
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside, out=total[1:])
    worded = total[last] > total[first]
    first, last, of = first[worded], last[worded], of[worded]
    later, _ = _doubles(of, span_hashes(data, first, last))
    symbols, upper = _SYMBOL[data], _UPPER[data]
    upper[:-1] |= (data[:-1] == 0xC3) & _CAPITAL[data[1:]]
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum(symbols, out=total[1:])
    with_symbol = total[ends] > total[starts]
    final = data[ends - 1]
    shout = (final == ord("!")) & (ends - starts > 1) & (data[np.maximum(ends - 2, 0)] == ord("!"))
    return [n_words, _sums(inside & _FIRST[data], bounds), _sums(symbols, bounds), np.bincount(of[later], minlength=n),
            n_repeat, np.bincount(of, minlength=n), _sums(upper, bounds), *(np.bincount(rows[x], minlength=n)
            for x in (with_symbol, _STOP[final], shout))]


def with_counts(documents: DataFrame, text: str = "text") -> DataFrame:
    """The documents with COUNTS of their whole texts; a null text has none.  Narrow.

    Words are runs of bytes other than space and ASCII line or tab characters.
    ``n_lines`` counts lines with a word, ``n_dup_lines`` those equal to an
    earlier one, ``n_repeat_words`` the words in windows of eight words that
    occur twice or more in the text.  Columns with these names are replaced.
    """
    kept = [f for f in documents.schema.fields if f.name not in COUNTS]
    ddl = ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept] + [f"{c} long" for c in COUNTS])
    names = [f.name for f in kept]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch, text):
                yield pa.RecordBatch.from_arrays(
                    [*(step.column(c) for c in names), *(pa.array(x, pa.int64()) for x in counts(step.column(text)))],
                    names=[*names, *COUNTS])

    return documents.mapInArrow(count, ddl)


def base_failed() -> Column:
    """Too short, or more than 30 % of the words in repeated windows."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def rules() -> dict[str, Column]:
    """A vote per rule: -1 bad, 1 good, 0 abstains.  All compare whole numbers.

    A rule that looks for one fault abstains where it does not find it; only the
    rules on sentences and on plain words vote good.
    """
    c, words, chars = F.col, F.col("n_words"), F.col("word_chars")

    def vote(bad: Column, good: Column | None = None) -> Column:
        votes = F.when(bad, F.lit(-1))
        return (votes if good is None else votes.when(good, F.lit(1))).otherwise(F.lit(0))

    return {
        "symbols": vote(c("n_symbols") * 10 > words),
        "symbol_words": vote(c("n_symbol_words") * 10 > words),
        "capitals": vote(c("n_upper") * 2 > chars),
        "shouting": vote(c("n_shouts") * 10 > words),
        "repeated_lines": vote(c("n_dup_lines") * 10 > c("n_lines") * 3),
        "repeated_words": vote(c("n_repeat_words") * 10 > words * 2),
        "word_length": vote((chars < words * 2) | (chars > words * 15)),
        "short": vote(words < 20),
        "sentences": vote(c("n_ends") * 100 < words, (c("n_ends") * 40 >= words) & (c("n_ends") * 2 <= words)),
        "plain": vote(c("n_symbol_words") * 3 > words, (c("n_symbol_words") * 50 <= words) & (c("n_upper") * 4 <= chars)
                      & (c("n_repeat_words") * 20 <= words)),
    }


#: A rule is taken to be right in 8 of 10 votes before any is seen; no rule is surer than the bounds.
BELIEF, BOUNDS = (8.0, 2.0), (0.55, 0.99)


@dataclass(frozen=True)
class Votes:
    """What expectation maximisation has found."""

    prior: float
    #: Rule -> share of right votes among those that it gives.
    accuracy: dict[str, float]
    #: Vote pattern as text -> probability of a good text.
    posterior: dict[str, float]


def pattern() -> Column:
    """The votes of all rules as a text, one character per rule: 0 bad, 1 abstains, 2 good."""
    return F.concat(*[(vote + 1).cast("string") for vote in rules().values()])


def expectation_maximisation(patterns: list[tuple[str, int]], names: list[str], rounds: int = 500) -> Votes:
    """Estimate the rules' accuracies; ``patterns`` holds (votes, number of texts).

    A rule that votes is right with its accuracy, independently of the others
    given the class; an abstention says nothing.  The belief that rules are
    better than chance names the classes and keeps a rule that never votes.
    """
    votes = np.array([[int(v) - 1 for v in p] for p, _ in patterns], float).reshape(len(patterns), len(names))
    weight = np.array([n for _, n in patterns], float)
    accuracy, prior = np.full(len(names), BELIEF[0] / sum(BELIEF)), BELIEF[0] / sum(BELIEF)
    chance = np.zeros(0)
    for _ in range(rounds if patterns else 0):
        odds = np.log(prior / (1 - prior)) + votes @ np.log(accuracy / (1 - accuracy))
        new = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        settled, chance = len(chance) > 0 and np.abs(new - chance).max() < 1e-9, new
        if settled:
            break
        right = (votes > 0) * chance[:, None] + (votes < 0) * (1 - chance)[:, None]
        accuracy = np.clip((weight @ right + BELIEF[0]) / (weight @ (votes != 0) + sum(BELIEF)), *BOUNDS)
        prior = float(np.clip((weight @ chance + BELIEF[0]) / (weight.sum() + sum(BELIEF)), 0.5, 0.95))
    return Votes(prior, {n: float(a) for n, a in zip(names, accuracy)}, {p: float(c) for (p, _), c in zip(patterns, chance)})


def fit(counted: DataFrame) -> Votes:
    """Fit on all texts with a word.  Only the table of patterns, at most 3 ** rules rows, reaches the driver."""
    table = counted.filter("n_words > 0").select(pattern().alias("votes")).groupBy("votes").count()
    return expectation_maximisation(sorted((r["votes"], r["count"]) for r in table.collect()), list(rules()))


def judge(counted: DataFrame, votes: Votes, threshold: float = 0.5) -> DataFrame:
    """Add ``votes``, ``quality`` (posterior), ``base_failed`` and ``kept``.

    Texts without a word have quality 0.  A pattern that the fit has not seen
    gets 0.5.  A kept text passes the base rules and reaches the threshold.
    """
    spark = counted.sparkSession
    table = spark.createDataFrame(list(votes.posterior.items()) or [("", 0.5)], "votes string, posterior double")
    return (
        counted.withColumn("votes", pattern()).join(F.broadcast(table), "votes", "left")
        .withColumn("quality", F.when(F.col("n_words") > 0, F.coalesce("posterior", F.lit(0.5))).otherwise(0.0)).drop("posterior")
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
    )


def filter_quality(documents: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents judged good, with their own columns.

    Two narrow passes over the texts: one for the vote table, one to filter.
    Null, empty and blank texts go; rows that tie or repeat are judged alike; an
    empty table stays empty; a document column named like an added one is kept
    as it came.
    """
    own = documents.columns
    # Under names that cannot clash, and with the text once.
    body = documents.toDF(*[f"__{i}" for i in range(len(own))])
    counted = with_counts(body, f"__{own.index(text)}")
    kept = judge(counted, fit(counted), threshold).filter("kept")
    return kept.select(*[F.col(f"__{i}").alias(name) for i, name in enumerate(own)])
