"""Extraction: routing, status, language filter, counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed, rules, text as tx


def extraction_route(files: DataFrame) -> DataFrame:
    return files.withColumn("route", rules.extraction_route(F.col("extension"), F.col("category")))


def truncate_text(content: DataFrame, max_chars: int = fixed.MAX_TEXT_CHARS) -> DataFrame:
    """Cut long text and mark the method."""
    long = F.char_length("extracted_text") > max_chars
    return content.withColumns({
        "extraction_method": F.when(long, F.concat("extraction_method", F.lit("_truncated")))
        .otherwise(F.col("extraction_method")),
        "extracted_text": F.when(long, F.substring("extracted_text", 1, max_chars))
        .otherwise(F.col("extracted_text")),
    })


def ocr_flag(content: DataFrame) -> DataFrame:
    return content.withColumn("ocr_applied", F.lower("extraction_method").contains("ocr"))


def text_counts(content: DataFrame) -> DataFrame:
    text = F.coalesce("extracted_text", F.lit(""))
    return content.withColumns({
        "char_count": F.char_length(text).cast("long"),
        "word_count": tx.word_count(text),
    })


def db_text_sanitize(content: DataFrame, text_col: str = "extracted_text") -> DataFrame:
    return content.withColumn(text_col, tx.sanitize_for_storage(F.col(text_col)))


def extraction_status(content: DataFrame) -> DataFrame:
    return content.withColumn(
        "extraction_status",
        rules.extraction_status(F.col("extracted_text"), F.col("extraction_method"), F.col("extension")),
    )


def _refusal() -> Column:
    """Reason a row is not stored, null when it is."""
    real = F.coalesce(F.col("source_archive"), F.lit("")) == ""
    language = F.coalesce(F.col("language_hint"), F.lit(""))
    return (
        F.when(F.col("is_empty") & real, "empty_file")
        .when(F.col("extraction_status").isin("FAILED", "SKIPPED"),
              F.concat(F.lit("status:"), "extraction_status"))
        .when((language != "") & ~language.isin(*fixed.ALLOWED_LANGUAGES),
              F.concat(F.lit("language:"), language))
    )


def extraction_filter(content: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stored, quarantined with ``reason``).

    Both outputs test the status; write the classified rows first, or Spark
    repeats the text work behind it in each of the two filters.
    """
    marked = content.withColumn("reason", _refusal())
    return marked.filter("reason IS NULL").drop("reason"), marked.filter("reason IS NOT NULL")


def extract_content(
    raw: DataFrame, max_chars: int | None = None, detect: Callable[[Column], Column] = tx.detect_language,
) -> DataFrame:
    """Sanitise, flag, count and classify raw text in one narrow pass.

    Texts are kept whole unless the caller sets ``max_chars``.  Without a
    ``language_hint`` column the language is detected by ``detect``.
    """
    clean = db_text_sanitize(raw)
    clean = clean if max_chars is None else truncate_text(clean, max_chars)
    content = extraction_status(text_counts(ocr_flag(clean)))
    if "language_hint" in raw.columns:
        return content
    return content.withColumn(
        "language_hint", detect(F.coalesce("extracted_text", F.lit(""))))


def extraction_summary(content: DataFrame) -> DataFrame:
    """Count and percentage per status over stored rows, and the quarantined number."""
    marked = content.withColumn("_held", _refusal().isNotNull())
    counts = marked.filter("NOT _held").groupBy(F.col("extraction_status").alias("status")).agg(
        F.count("*").alias("n")
    )
    statuses = content.sparkSession.createDataFrame(
        [("SUCCESS",), ("PARTIAL",), ("FAILED",), ("SKIPPED",)], "status string"
    )
    total = marked.agg(F.count_if(~F.col("_held"))).scalar()
    share = F.try_divide(F.col("n") * 100.0, total)
    return statuses.join(counts, "status", "left").select(
        "status",
        F.coalesce("n", F.lit(0)).alias("files"),
        F.round(F.coalesce(share, F.lit(0.0)), 1).alias("percent"),
        marked.agg(F.count_if("_held")).scalar().alias("quarantined"),
    )
