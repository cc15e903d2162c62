"""Operator 8: line dedup by overlapping windows of three lines, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.storage import written

#: Lines of a window.
WINDOW = 3


def _line_hashes(text: Column) -> Column:
    """(number, two 64-bit hashes) of every line that is not blank, numbered from 0 over all lines."""
    lines = F.transform(F.split(text, "\n"), lambda line, i: F.struct(i.alias("number"), F.regexp_replace(
        F.btrim(line, F.lit(" \t\r\x0b\x0c")), r"[ \t\r\x0b\x0c]+", " ").alias("line")))
    return F.transform(
        F.filter(lines, lambda x: x["line"] != ""),
        lambda x: F.struct(x["number"].alias("number"), F.xxhash64(x["line"]).alias("a"), F.xxhash64(F.lit(1), x["line"]).alias("b")))


def line_windows(documents: DataFrame, key: str = "doc_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """(key, first, last, a, b): every run of ``size`` consecutive lines that are not blank.

    ``first`` and ``last`` number lines from 0; (a, b) is the window's 128-bit key.
    """
    hashed = documents.select(F.col(f"`{key}`").alias("id"), _line_hashes(F.col(f"`{text}`")).alias("lines"))

    def window(i: Column) -> Column:
        of = [F.get("lines", i + k) for k in range(size)]
        return F.struct(of[0]["number"].alias("first"), of[-1]["number"].alias("last"),
                        F.xxhash64(*[x["a"] for x in of]).alias("a"), F.xxhash64(*[x["b"] for x in of]).alias("b"))

    at = F.when(F.size("lines") >= size, F.transform(F.sequence(F.lit(0), F.size("lines") - size), window))
    # The outer form: else a filter on the array is pushed down and all the text work is done twice.
    rows = hashed.select("id", F.explode_outer(at).alias("w")).select("id", "w.first", "w.last", "w.a", "w.b")
    return rows.filter("first IS NOT NULL")


def later_windows(windows: DataFrame) -> DataFrame:
    """Windows of which an equal one stands earlier: smaller id, or same id and earlier line.

    Each key's first place is an aggregate with partial minima, kept only for
    keys that repeat and written; the join back to the windows then has two
    plain shuffles, so a window that a third of the rows share is split.
    """
    firsts = (
        windows.groupBy("a", "b").agg(F.min(F.struct("id", "first")).alias("origin"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1").select("a", "b", "origin")
    )
    firsts = written(firsts, "line-firsts")
    return windows.join(firsts.hint("merge"), ["a", "b"]).filter(
        ~F.col("origin.id").eqNullSafe(F.col("id")) | (F.col("origin.first") != F.col("first")))


def covered_lines(later: DataFrame) -> DataFrame:
    """(id, lines): the line numbers that repeated windows cover, merged; blank lines in a window count."""
    runs = later.groupBy("id").agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    numbers = F.flatten(F.transform("runs", lambda r: F.sequence(r["first"], r["last"])))
    return runs.select("id", F.array_sort(F.array_distinct(numbers)).alias("lines"))


def dedup_lines(documents: DataFrame, key: str = "doc_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """Documents without the later copies of runs of ``size`` or more lines.

    Lines are compared with outer white space taken off and inner white space as
    one space; blank lines are skipped when windows are formed.  Every line that
    a later window covers goes, with the blank lines inside it; windows are
    judged on the input.  Adds ``n_lines``, ``n_removed_lines`` and ``removed``
    (line numbers from 0), replaces the text by what is left.

    A null text stays null with 0 lines, an empty one has one line; texts with
    fewer than ``size`` lines stay as they are; equal texts under two keys lose
    all windows in the later.  Rows that repeat a key count as one document: a
    line number that goes in one goes in all.  A null key sorts before all
    others.  Other columns are kept; an empty table stays empty.

    The joins are sort-merge joins at every size, so the plan, and with it the
    one shuffle of the texts, grows in proportion to the input.
    """
    found = written(covered_lines(later_windows(line_windows(documents, key, text, size))), "line-covered")
    found = found.withColumnsRenamed({"id": "__id", "lines": "__lines"})
    body = F.col(f"`{text}`")
    lines, gone = F.split(body, "\n"), F.coalesce("__lines", F.array().cast("array<int>"))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    kept = F.array_join(F.transform(left, lambda i: F.get(F.col("__all"), i)), "\n")
    joined = documents.join(found.hint("merge"), documents[f"`{key}`"].eqNullSafe(F.col("__id")), "left")
    return joined.withColumn("__all", lines).select(
        *[F.col(f"`{c}`") for c in documents.columns if c not in (text, "n_lines", "n_removed_lines", "removed")],
        F.when(F.col("__lines").isNull(), body).otherwise(kept).alias(text),
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.size(gone).cast("long").alias("n_removed_lines"), gone.alias("removed"))
