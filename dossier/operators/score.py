"""The nine signals, bootstrap score and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed, text as tx, rules
from ..functions.storage import written
from . import cluster, vectors as vec


def score_input_join(files: DataFrame, content: DataFrame, chunks: DataFrame) -> DataFrame:
    """files, their content and their chunk totals; chunks are aggregated before the join."""
    totals = (
        chunks.filter("clean_status = 'SUCCESS'").groupBy("file_id")
        .agg(F.max("chunk_total").alias("chunk_total"), F.sum("clean_word_count").alias("clean_word_count"))
    )
    extracted = content.select(
        "file_id", "extraction_status", "ocr_applied", F.col("word_count").alias("extracted_words"),
        "language_hint",
    )
    return (
        files.select("file_id", "path", "name", "extension", "category", "folder", "size_bytes",
                     "modified_time", "access_time", "hash")
        .join(extracted, "file_id", "left").join(totals, "file_id", "left")
    )


def _log_share(count: Column, full: int) -> Column:
    value = F.greatest(F.coalesce(count, F.lit(0)), F.lit(0)).cast("double")
    return F.least(F.log1p(value) / F.log1p(F.lit(float(full))), F.lit(1.0))


def s_content_richness(rows: DataFrame) -> DataFrame:
    count = F.coalesce("clean_word_count", "extracted_words", F.lit(0))
    return rows.withColumn("s_content_richness", _log_share(count, fixed.RICHNESS_WORDS))


def s_recency(rows: DataFrame, as_of: str) -> DataFrame:
    """1 - age in whole days / 1825; future dates go above 1, no date gives 0."""
    newest = F.greatest("modified_time", "access_time")
    seconds = F.timestamp_diff("SECOND", newest, F.lit(as_of).cast("timestamp_ntz"))
    days = F.floor(seconds / F.lit(86400.0))
    score = F.lit(1.0) - F.least(days / F.lit(float(fixed.STALENESS_DAYS)), F.lit(1.0))
    return rows.withColumn("s_recency", F.coalesce(score, F.lit(0.0)))


def s_type_importance(rows: DataFrame) -> DataFrame:
    return rows.withColumn("s_type_importance", rules.type_importance(F.col("extension")))


def s_uniqueness(rows: DataFrame, dup_paths: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """0 for a path among the duplicates, else 1.

    Only (file_id, path) of ``files`` is shuffled by path; the wide rows stay
    placed by file id for the joins around this one.
    """
    paths = (rows if files is None else files).select("file_id", "path")
    marked = paths.join(dup_paths.select("path"), "path", "left_semi").select(
        "file_id", F.lit(True).alias("_dup"))
    return (
        rows.join(marked, "file_id", "left")
        .withColumn("s_uniqueness", F.when(F.col("_dup"), 0.0).otherwise(1.0)).drop("_dup")
    )


def s_extraction_quality(rows: DataFrame) -> DataFrame:
    status = F.upper(F.coalesce("extraction_status", F.lit("")))
    ocr = F.coalesce("ocr_applied", F.lit(False))
    return rows.withColumn(
        "s_extraction_quality",
        F.when((status == "SUCCESS") & ocr, 0.6).when(status == "SUCCESS", 1.0)
        .when(status == "PARTIAL", 0.3).otherwise(0.0),
    )


def s_content_depth(rows: DataFrame) -> DataFrame:
    return rows.withColumn("s_content_depth", _log_share(F.col("chunk_total"), fixed.DEPTH_CHUNKS))


def s_llm_quality(rows: DataFrame) -> DataFrame:
    """Heuristic used when no ratings are supplied."""
    mix = (F.lit(0.3) * F.col("s_content_richness") + F.lit(0.4) * F.col("s_content_depth")
           + F.lit(0.3) * F.col("s_extraction_quality"))
    clipped = F.least(F.greatest(mix, F.lit(0.0)), F.lit(1.0))
    # greatest/least skip nulls, so a missing part must be tested first
    return rows.withColumn("s_llm_quality", F.coalesce(F.when(mix.isNotNull(), clipped), F.lit(0.2)))


def _weighted(names: tuple[str, ...]) -> Column:
    weights = dict(zip(fixed.SIGNALS, fixed.SIGNAL_WEIGHTS))
    total = None
    for name in names:
        term = F.lit(weights[name]) * F.col(name)
        total = term if total is None else total + term
    return total


def boot8(rows: DataFrame) -> DataFrame:
    """Add ``boot8``: the weighted sum of the first eight signals."""
    return rows.withColumn("boot8", _weighted(fixed.SIGNALS[:-1]))


def signals(
    files: DataFrame, content: DataFrame, chunks: DataFrame, dup_paths: DataFrame,
    file_vectors: DataFrame, clusters: DataFrame, as_of: str, ratings: DataFrame | None = None,
) -> DataFrame:
    """All nine signal columns for every file.

    ``ratings`` (file_id, rating 1..5) replaces the quality heuristic when given.
    """
    rows = s_recency(s_content_richness(score_input_join(files, content, chunks)), as_of)
    rows = s_uniqueness(s_type_importance(rows), dup_paths, files)
    rows = cluster.cluster_density(s_content_depth(s_extraction_quality(rows)), clusters)
    rows = s_llm_quality(rows) if ratings is None else apply_ratings(rows, ratings)
    rows = written(rows, "eight-signals")  # read for the centroid and again for the result
    centroid = vec.keep_centroid(boot8(rows), file_vectors)
    return vec.semantic_proximity(rows, file_vectors, centroid)


def rating_keys(rows: DataFrame, dup_paths: DataFrame, excerpts: DataFrame, max_words: int = 200) -> DataFrame:
    """(file_id, cache_key, snippet) of every file to be rated from outside.

    Files that are no duplicates and have over 20 words; excerpt of 200 words,
    key = MD5 of the first 800 characters of the excerpt text.
    """
    chosen = (
        rows.filter(F.coalesce("extracted_words", F.lit(0)) > 20)
        .join(dup_paths.select("path").distinct(), "path", "left_anti").select("file_id")
    )
    text = F.coalesce("excerpt", F.lit(""))
    return chosen.join(excerpts, "file_id", "left").select(
        "file_id", F.md5(F.substring(text, 1, 800)).alias("cache_key"),
        F.array_join(F.slice(tx.words(text), 1, max_words), " ").alias("snippet"),
    )


def llm_rating_batch(keys: DataFrame) -> DataFrame:
    """The requests: one row per distinct cache key, with the snippet of its smallest file."""
    return keys.groupBy("cache_key").agg(
        F.min("file_id").alias("file_id"), F.min_by("snippet", "file_id").alias("snippet"))


def apply_ratings(rows: DataFrame, ratings: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Map ratings 1..5 to 0..1; unrated files get 0.2.

    ``ratings`` holds (file_id, rating), or (cache_key, rating) with the
    ``keys`` (file_id, cache_key): every file of a key gets its rating.
    """
    value = F.least(F.greatest(F.col("rating").cast("double"), F.lit(1.0)), F.lit(5.0))
    by = "file_id" if keys is None else "cache_key"
    mapped = ratings.filter("rating IS NOT NULL").groupBy(by).agg(F.max((value - 1) / 4).alias("s_llm_quality"))
    if keys is not None:
        mapped = keys.select("file_id", "cache_key").join(mapped, "cache_key").select("file_id", "s_llm_quality")
    return rows.join(mapped, "file_id", "left").fillna({"s_llm_quality": 0.2})


def boot_score(rows: DataFrame) -> DataFrame:
    """Add ``boot_score``: weighted sum x 100, min-max rescaled over the corpus."""
    raw = rows.withColumn("_raw", _weighted(fixed.SIGNALS) * 100)
    low, high = raw.agg(F.min("_raw")).scalar(), raw.agg(F.max("_raw")).scalar()
    bounded = raw.withColumns({"_low": low, "_high": high})
    width = F.col("_high") - F.col("_low")
    return bounded.withColumn(
        "boot_score",
        F.when(width > 0, (F.col("_raw") - F.col("_low")) / width * 100).otherwise(F.col("_raw")),
    ).drop("_raw", "_low", "_high")


def boot_label(scored: DataFrame) -> DataFrame:
    return scored.withColumn("boot_label", rules.score_label(F.col("boot_score")))


def file_scores(signal_rows: DataFrame) -> DataFrame:
    """The score table: identity, nine signals, importance score and label."""
    scored = boot_label(boot_score(signal_rows))
    return scored.select(
        "file_id", "path", "name", F.col("extension").alias("ext"), "category", *fixed.SIGNALS,
        F.round("boot_score", 2).alias("importance_score"), F.col("boot_label").alias("label"),
    )


def score_distribution(scores: DataFrame) -> DataFrame:
    """Mean, interpolated median, sample deviation, min, max, to 2 decimals.

    The exact median aggregates distinct values with counts, bounded here by
    the 10 001 possible scores of two decimals.
    """
    score = F.col("importance_score")
    return scores.agg(
        F.round(F.avg(score), 2).alias("mean"), F.round(F.percentile(score, 0.5), 2).alias("median"),
        F.round(F.stddev_samp(score), 2).alias("std"), F.round(F.min(score), 2).alias("min"),
        F.round(F.max(score), 2).alias("max"),
    )


def label_counts(scores: DataFrame) -> DataFrame:
    """Files per label, and the total under the label 'TOTAL'."""
    return (
        scores.rollup("label").agg(F.grouping("label").alias("_all"), F.count("*").alias("n"))
        .select(F.when(F.col("_all") == 1, "TOTAL").otherwise(F.col("label")).alias("label"), "n")
    )


TOP_COLUMNS = ("name", "ext", "importance_score", "label", "s_llm_quality", "s_cluster_density",
               "s_semantic_proximity")


def top_bottom_files(scores: DataFrame, n: int = 10) -> DataFrame:
    shown = scores.select("file_id", *TOP_COLUMNS)
    top = shown.orderBy(F.desc("importance_score"), "file_id").limit(n)
    bottom = shown.orderBy("importance_score", "file_id").limit(n)
    return top.withColumn("side", F.lit("top")).unionByName(bottom.withColumn("side", F.lit("bottom")))
