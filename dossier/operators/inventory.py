"""Inventory: names, categories, status, quarantine, summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed, rules


def categorize_extension(files: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """Add ``category``.

    ``mapping`` (extension, category) extends or overrides the built-in core
    list; Spark chooses its join by its size.
    """
    builtin = rules.category(F.col("extension"))
    if mapping is None:
        return files.withColumn("category", builtin)
    extra = (
        mapping.groupBy(F.lower("extension").alias("extension"))
        .agg(F.max("category").alias("_mapped"))
    )
    return (
        files.join(extra, "extension", "left")
        .withColumn("category", F.coalesce("_mapped", builtin))
        .drop("_mapped")
    )


def content_hash(raw: DataFrame, content_col: str = "content") -> DataFrame:
    """Add ``hash``: SHA-256 hex of the bytes; unreadable content gives an error code."""
    return raw.withColumn(
        "hash", F.coalesce(F.sha2(F.col(content_col), 256), F.lit("error_unreadable"))
    )


def inventory_row(files: DataFrame, root: str = "", mapping: DataFrame | None = None) -> DataFrame:
    """Derive every inventory column from path, size, times and hash.

    ``depth`` counts folders below ``root``.
    """
    name = rules.file_name(F.col("path"))
    below = F.expr(f"substring(path, {len(root.rstrip('/')) + 2})") if root else F.ltrim(F.col("path"), F.lit("/"))
    rows = files.withColumns({
        "name": name,
        "stem": rules.stem(name),
        "extension": rules.extension(name),
        "folder": F.regexp_replace("path", r"/[^/]+$", ""),
        "depth": (F.size(F.split(below, "/")) - 1).cast("long"),
        "size_mb": F.round(F.col("size_bytes") / F.lit(1048576.0), 2),
        "is_empty": F.col("size_bytes") == 0,
    })
    return categorize_extension(rows, mapping).withColumn(
        "status", rules.inventory_status(F.col("extension"), F.col("size_bytes"))
    )


def inventory_status(files: DataFrame) -> DataFrame:
    return files.withColumn(
        "status", rules.inventory_status(F.col("extension"), F.col("size_bytes"))
    )


def _in_review() -> Column:
    return F.col("category").isin(*fixed.REVIEW_CATEGORIES)


def quarantine_split(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, quarantined): files of a review category leave with a reason."""
    held = files.filter(_in_review()).withColumn("reason", F.concat(F.lit("category:"), "category"))
    return files.filter(~_in_review()), held


def inventory_summary(files: DataFrame) -> DataFrame:
    """One row over all scanned files, archive members included."""
    member = F.coalesce(F.col("source_archive"), F.lit("")) != ""
    kept = ~_in_review()
    return files.agg(
        F.count_if(kept & ~member).alias("real_files"),
        F.count_if(kept & member).alias("archive_members"),
        F.count_if(F.col("status") == "DELETE_CANDIDATE").alias("delete_candidates"),
        F.count_if(~kept).alias("quarantined"),
        F.round(F.coalesce(F.sum(F.when(kept & ~member, F.col("size_mb"))), F.lit(0.0)), 2).alias("total_mb"),
    )


def folder_tree_counts(files: DataFrame, prefix: str = "/root/") -> DataFrame:
    """Every folder prefix with the number of files at or below it.

    Files are first counted per folder, so the prefixes of a hot folder are
    built once instead of once per file.
    """
    per_folder = files.groupBy("folder").agg(F.count("*").alias("n"))
    parts = F.split(F.regexp_replace("folder", f"^{prefix}", ""), "/")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")
    )
    return (
        per_folder.select(F.explode(prefixes).alias("folder"), "n")
        .groupBy("folder").agg(F.sum("n").alias("file_count"))
    )
