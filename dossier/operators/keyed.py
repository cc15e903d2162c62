"""Latest, first and top rows per key, without gathering a key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def latest_per_key(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The row of each key with the greatest ``order``; partial maxima before the shuffle."""
    whole = F.struct(*[F.col(c) for c in rows.columns])
    picked = rows.groupBy(F.col(key).alias("_key")).agg(
        F.max_by(whole, F.struct(*[F.col(c) for c in order])).alias("_row")
    )
    return picked.select("_row.*")


def first_per_key(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The row of each key with the smallest ``order``."""
    whole = F.struct(*[F.col(c) for c in rows.columns])
    picked = rows.groupBy(F.col(key).alias("_key")).agg(
        F.min_by(whole, F.struct(*[F.col(c) for c in order])).alias("_row")
    )
    return picked.select("_row.*")


def top_per_key(rows: DataFrame, key: str, n: int, *order: Column) -> DataFrame:
    """First n rows of each key, numbered by ``rank``.

    Spark limits each key before the shuffle, so a hot key sends n rows per task.
    """
    window = W.partitionBy(key).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= n)


def rank_by_digest(rows: DataFrame, label_col: str, id_col: str) -> DataFrame:
    """Add ``_rank`` (from 1, by MD5 of the id) and ``_size`` among the rows of each label.

    Ranks are counted by the first three hex digits: bucket totals (4096 per
    label at most) give a row's offset, so no label is sorted in one task.
    """
    digest = F.md5(F.col(id_col).cast("string"))
    rows = rows.withColumns({"_digest": digest, "_bucket": F.substring(digest, 1, 3)})
    buckets = rows.groupBy(label_col, "_bucket").agg(F.count("*").alias("_n"))
    by_label = W.partitionBy(label_col)
    offsets = buckets.select(
        label_col, "_bucket", (F.sum("_n").over(by_label.orderBy("_bucket")) - F.col("_n")).alias("_before"),
        F.sum("_n").over(by_label).alias("_size"))
    inside = W.partitionBy(label_col, "_bucket").orderBy("_digest", id_col)
    return (
        rows.withColumn("_row", F.row_number().over(inside))
        # at most labels x 4096 rows
        .join(F.broadcast(offsets), [label_col, "_bucket"])
        .withColumn("_rank", F.col("_before") + F.col("_row")).drop("_digest", "_bucket", "_before", "_row")
    )
