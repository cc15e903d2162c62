"""Language detection by a character n-gram model fitted on labelled texts.

The model is a table of log probabilities of three-letter runs, fitted by one
aggregate over all labelled rows and bounded by ``grams`` runs per fit.  A
detector made of it is a column function that reads a text once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType

from ..functions import fixed

#: Runs in a model; with eight bytes each and as many a language, a few megabytes.
GRAMS = 20_000


@dataclass
class LanguageModel:
    """``logp[i, j]``: log probability of run ``grams[i]`` in ``languages[j]``."""

    grams: list[str]
    languages: list[str]
    logp: np.ndarray

    def table(self, spark: SparkSession) -> DataFrame:
        """(gram, lang, logp), to be stored or looked at."""
        rows = [(g, lang, float(self.logp[i, j])) for i, g in enumerate(self.grams) for j, lang in enumerate(self.languages)]
        return spark.createDataFrame(rows, "gram string, lang string, logp double")


def gram_counts(rows: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, gram, n) over all rows with a language: three code points of words in lower case with a space at both ends.

    Words are counted before they are cut, so what is shuffled are distinct words.
    """
    words = (
        rows.filter(F.col(lang).isNotNull() & (F.col(lang) != ""))
        .select(F.col(lang).alias("lang"), F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1))).alias("word"))
        .groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    )
    padded = F.concat(F.lit(" "), "word", F.lit(" "))
    runs = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.substring(F.col("padded"), i, F.lit(3)))
    return words.withColumn("padded", padded).select("lang", "n", F.explode(runs).alias("gram")).groupBy("lang", "gram").agg(
        F.sum("n").alias("n"))


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", grams: int = GRAMS) -> LanguageModel:
    """A model of the languages in ``lang``, from the ``grams`` most frequent runs (ties: the smaller first).

    Rows without text or language are left out; without any the model knows no
    language.  Counts are smoothed by one.  The driver gets a row for each kept
    run and language.
    """
    counts = gram_counts(rows, text, lang)
    kept = counts.groupBy("gram").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "gram").limit(grams)
    found = counts.join(F.broadcast(kept), "gram").select("gram", "lang", "n").collect()
    names, languages = sorted({r["gram"] for r in found}), sorted({r["lang"] for r in found})
    place, column = {g: i for i, g in enumerate(names)}, {lang: j for j, lang in enumerate(languages)}
    n = np.ones((len(names), len(languages)))
    for r in found:
        n[place[r["gram"]], column[r["lang"]]] += r["n"]
    return LanguageModel(names, languages, np.log(n / n.sum(axis=0)))


@lru_cache(1)
def _letters() -> np.ndarray:
    """Of every code point, whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _packed(points: np.ndarray) -> np.ndarray:
    """One number for each three code points in a row."""
    p = points.astype(np.int64)
    return p[:-2] << 42 | p[1:-1] << 21 | p[2:]


def runs_of(text: str) -> np.ndarray:
    """The packed runs of a text, in order; none has a space in the middle."""
    points = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le"), "<u4")
    points = np.where(_letters()[points], points, 32)
    return _packed(points)[points[1:-1] != 32]


def detector(model: LanguageModel, spark: SparkSession) -> Callable[[Column], Column]:
    """A column function like ``text.detect_language``: the most likely language of a text.

    '' under 50 characters, and where no run of the text is known; ties go to
    the first language in order.  Whole texts are read.
    """
    points = [np.array([ord(c) for c in g]) for g in model.grams]
    packed = np.array([_packed(p)[0] for p in points], np.int64)
    order = np.argsort(packed)
    shared = spark.sparkContext.broadcast((packed[order], model.logp[order], model.languages))

    def best(text: str) -> str:
        known, logp, languages = shared.value
        if len(text) < fixed.MIN_LANG_CHARS or not len(known):
            return ""
        runs = runs_of(text)
        at = np.minimum(np.searchsorted(known, runs), len(known) - 1)
        at = at[known[at] == runs]
        return languages[int(logp[at].sum(axis=0).argmax())] if len(at) else ""

    @F.pandas_udf(StringType())
    def detect(text: pd.Series) -> pd.Series:
        return text.map(best, na_action="ignore")

    return lambda text: F.coalesce(detect(F.coalesce(text, F.lit(""))), F.lit(""))
