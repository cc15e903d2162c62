"""Classification rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def extension(name: Column) -> Column:
    """Last suffix in lower case; '' for dot files and names without one."""
    return F.lower(F.regexp_extract(name, r"^.+([.][^./]+)$", 1))


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"^(.+)[.][^./]+$", "$1")


def category(ext: Column) -> Column:
    """Category of an extension, or the default."""
    ext = F.lower(F.coalesce(ext, F.lit("")))
    result = F.lit(fixed.DEFAULT_CATEGORY)
    for name, extensions in fixed.EXTENSIONS_OF_CATEGORY.items():
        result = F.when(ext.isin(extensions.split()), name).otherwise(result)
    return result


def inventory_status(ext: Column, size_bytes: Column) -> Column:
    return (
        F.when(size_bytes == 0, "DELETE_CANDIDATE")
        .when(ext.isin(fixed.TEMP_EXTENSIONS), "DELETE_CANDIDATE")
        .when(ext.isin(fixed.CRITICAL_EXTENSIONS), "KEEP")
        .when(ext.isin(fixed.ARCHIVE_EXTENSIONS), "ARCHIVE")
        .otherwise("REVIEW")
    )


def extraction_route(ext: Column, category: Column) -> Column:
    """Extractor family; the first matching rule wins."""
    ext = F.lower(ext)
    return (
        F.when(category.isin(*fixed.SKIP_CATEGORIES), "skip")
        .when(ext.isin(fixed.ROUTE_TEXT), "text")
        .when(ext.isin(fixed.ROUTE_CSV), "csv")
        .when(ext.isin(fixed.ROUTE_PDF), "pdf")
        .when(ext.isin(fixed.ROUTE_DOC), "doc")
        .when(ext.isin(fixed.ROUTE_SHEET), "sheet")
        .when(ext.isin(fixed.ROUTE_SLIDES), "slides")
        .when(ext.isin(fixed.ROUTE_IMAGE), "image")
        .when(ext.isin(fixed.ROUTE_JAR), "jar")
        .when(ext.isin(fixed.ROUTE_ARCHIVE), "archive")
        .when(ext.isin(fixed.ROUTE_BINARY), "binary_strings")
        .when(ext.isin(fixed.ROUTE_SKIP), "skip")
        .when(category.isin(*fixed.TEXT_LIKE_CATEGORIES), "text")
        .otherwise("generic")
    )


def extraction_status(text: Column, method: Column, ext: Column) -> Column:
    chars = F.char_length(F.coalesce(text, F.lit("")))
    office = fixed.ROUTE_DOC + fixed.ROUTE_PDF + fixed.ROUTE_SHEET + fixed.ROUTE_SLIDES
    return (
        F.when(method.isin(*fixed.SKIP_METHODS), "SKIPPED")
        .when(chars == 0, "FAILED")
        .when(ext.isin(fixed.ROUTE_IMAGE) & (chars < 20), "PARTIAL")
        .when(ext.isin(office) & (chars < 10), "PARTIAL")
        .otherwise("SUCCESS")
    )


def type_importance(ext: Column) -> Column:
    bare = F.regexp_replace(F.lower(F.coalesce(ext, F.lit(""))), r"^\.+", "")
    result = F.lit(fixed.TYPE_WEIGHT_DEFAULT)
    for weight, members in reversed(fixed.TYPE_WEIGHTS):
        result = F.when(bare.isin(members.split()), F.lit(weight)).otherwise(result)
    return result


def score_label(score: Column) -> Column:
    return (
        F.when(score >= fixed.KEEP_FROM, "KEEP")
        .when(score >= fixed.ARCHIVE_FROM, "ARCHIVE")
        .when(score >= fixed.REVIEW_FROM, "REVIEW")
        .otherwise("DELETE_CANDIDATE")
    )


def label_index(label: Column) -> Column:
    result = F.lit(None).cast("int")
    for i, name in enumerate(fixed.LABELS):
        result = F.when(label == name, F.lit(i)).otherwise(result)
    return result
