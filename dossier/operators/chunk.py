"""Cleaning and chunking of extracted text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed, text as tx
from ..functions.storage import written


def clean_text(
    content: DataFrame, text_col: str = "extracted_text", method_col: str = "extraction_method"
) -> DataFrame:
    """Add ``clean_text``: encoding, HTML, OCR noise, NFC, boilerplate, whitespace.

    HTML is parsed only for direct and generic reads that contain a tag, OCR
    noise is removed only from recognised text.  '' for null or empty input.
    Each step is a column of its own, so none is evaluated twice.
    """
    method = F.lower(F.coalesce(method_col, F.lit("")))
    text = F.col("_text")
    is_html = method.rlike("unstructured|plain_text_read") & text.rlike(fixed.HTML_TAG_PATTERN)
    return (
        content.withColumn("_text", tx.fix_encoding(F.col(text_col)))
        .withColumn("_text", F.coalesce(tx.strip_html(F.when(is_html, text)), text))
        .withColumn("_text", F.when(method.contains("ocr"), tx.remove_ocr_noise(text)).otherwise(text))
        .withColumn("_text", tx.normalize_unicode(text))
        .withColumn("clean_text", F.coalesce(tx.normalize_whitespace(tx.remove_boilerplate(text)), F.lit("")))
        .drop("_text")
    )


def reuse_clean_by_hash(content: DataFrame) -> DataFrame:
    """Clean each content hash once and give the result to every copy.

    The first row of a hash is taken, KEEP files before others and then by id.
    Rows whose hash is missing or an error code are cleaned on their own.
    The first rows are found on hashes and ids; only then texts are shuffled.
    The cleaned texts are written once, so that Spark can split a hot hash in
    the join back.  An id is one row's.
    """
    usable = F.col("hash").isNotNull() & ~F.coalesce(F.col("hash"), F.lit("")).startswith("error")
    order = F.struct((F.col("phase1_status") != "KEEP").alias("later"), F.col("id"))
    first = content.filter(usable).groupBy("hash").agg(F.min(order).alias("_first")).select(F.col("_first.id").alias("id"))
    once = content.join(written(first, "first-of-hash"), "id", "left_semi").select("hash", "extracted_text", "extraction_method")
    cleaned = written(clean_text(once).select("hash", "clean_text"), "clean-by-hash")
    shared = content.filter(usable).join(cleaned, "hash")
    return shared.unionByName(clean_text(content.filter(~usable)))


def _spans(length: Column, last: Column, step: int, size: int, min_words: int, base: Column) -> Column:
    """(first, length) of windows that start at every step up to ``last`` and cover ``length`` words.

    A window of fewer than ``min_words`` is no chunk of its own: its words go to
    the window before, which then reaches the end.
    """
    starts = F.filter(F.sequence(F.lit(0), last, F.lit(step)), lambda at: (at == 0) | (length - at >= min_words))

    def span(at: Column) -> Column:
        absorbs = (at + step <= last) & (length - at - step < min_words)
        words = F.when(absorbs, length - at).otherwise(F.least(length - at, F.lit(size)))
        return F.struct((base + at).cast("int").alias("first"), words.cast("int").alias("length"))

    return F.transform(starts, span)


def sliding_windows(
    words: Column, size: int = fixed.CHUNK_WORDS, overlap: int = fixed.CHUNK_OVERLAP,
    min_words: int = fixed.CHUNK_MIN_WORDS, early_stop: bool = True,
) -> Column:
    """Overlapping word windows joined by spaces; every word is in one.

    With ``early_stop`` the last window is the first one reaching the end;
    otherwise windows start at every step below the word count.
    """
    step = size - min(overlap, size - 1)
    n = F.size(words)
    if early_stop:
        last = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(float(step))).cast("int")) * step
    else:
        last = F.greatest(F.lit(0), n - 1)
    windows = _spans(n, last, step, size, min_words, F.lit(0))
    return F.transform(windows, lambda w: F.array_join(F.slice(words, w["first"] + 1, w["length"]), " "))


def _paragraphs(text: Column) -> Column:
    parts = F.transform(F.split(text, r"\n\s*\n"), tx.strip)
    return F.filter(parts, lambda p: p != "")


def packed_paragraphs(
    words: Column, paragraphs: Column, size: int = fixed.CHUNK_WORDS, overlap: int = fixed.CHUNK_OVERLAP,
    min_words: int = fixed.CHUNK_MIN_WORDS,
) -> Column:
    """Greedy packing of paragraphs, folded in order inside the row.

    A paragraph that would overflow closes the chunk; the next one starts with
    the last ``overlap`` words.  A paragraph longer than ``size`` is windowed.
    What is held before it and has fewer than ``min_words`` words, a heading
    say, goes with it, and a short rest goes to the chunk before.  Every chunk is
    a run of consecutive words, so the fold carries only word positions and the
    texts are cut at the end.
    """
    overlap = min(overlap, size - 1)
    span = "array<struct<first:int,length:int>>"
    none = F.array().cast(span)

    def run(first: Column, length: Column) -> Column:
        one = F.array(F.struct(first.cast("int").alias("first"), length.cast("int").alias("length")))
        return F.when(length > 0, one).otherwise(none)

    def windows(first: Column, length: Column) -> Column:
        return _spans(length, length - 1, size - overlap, size, min_words, first)

    def add(acc: Column, count: Column) -> Column:
        first, end = acc["first"], acc["end"]
        held = end - first
        oversize, overflow = count > size, held + count > size
        joined = (oversize | overflow) & (held > 0) & (held < min_words)
        closed = F.when(joined, windows(first, held + count)).when(
            oversize, F.concat(run(first, held), windows(end, count))).when(
            overflow, run(first, held)).otherwise(none)
        start = F.when(joined | oversize, end + count - overlap).when(
            overflow, F.greatest(first, end - overlap)).otherwise(first)
        return F.struct(
            F.concat(acc["runs"], closed).alias("runs"), start.alias("first"), (end + count).alias("end"))

    def finished(acc: Column) -> Column:
        rest, runs = acc["end"] - acc["first"], acc["runs"]
        last = F.element_at(runs, -1)
        short = (rest < min_words) & (F.size(runs) > 0)
        longer = run(last["first"], F.greatest(acc["end"] - last["first"], last["length"]))
        return F.when(short, F.concat(F.slice(runs, 1, F.greatest(F.size(runs) - 1, F.lit(0))), longer)).otherwise(
            F.concat(runs, run(acc["first"], rest)))

    start = F.struct(none.alias("runs"), F.lit(0).alias("first"), F.lit(0).alias("end"))
    runs = F.aggregate(F.transform(paragraphs, lambda p: F.size(tx.words(p))), start, add, finished)
    return F.transform(runs, lambda r: F.array_join(F.slice(words, r["first"] + 1, r["length"]), " "))


def _with_chunks(
    cleaned: DataFrame, size: int, overlap: int, min_words: int, paragraphs: bool = True
) -> DataFrame:
    """Add ``_chunks``: the chunks of ``clean_text`` as an array.

    Words and paragraphs are columns of their own and only evaluated once.
    """
    text, words = F.col("clean_text"), F.col("_words")
    none = F.array().cast("array<string>")
    long = F.size(words) > size
    rows = cleaned.withColumn("_words", tx.words(text))
    packed = none
    if paragraphs:
        rows = rows.withColumn("_paragraphs", F.when(long & text.rlike(r"\n\s*\n"), _paragraphs(text)))
        rows = rows.withColumn("_packed", F.when(
            F.size("_paragraphs") > 1, packed_paragraphs(words, F.col("_paragraphs"), size, overlap, min_words)))
        packed = F.coalesce("_packed", none)
    short = F.when(F.size(words) > 0, F.array(text)).otherwise(none)
    sliding = sliding_windows(words, size, overlap, min_words)
    return rows.withColumn(
        "_chunks", F.when(~long, short).when(F.size(packed) > 0, packed).otherwise(sliding)
    ).drop("_words", "_paragraphs", "_packed")


def _exploded(rows: DataFrame) -> DataFrame:
    """(file_id, chunk_index, chunk_text).

    The outer form keeps Spark from testing the array in a filter that it would
    push down, evaluating all the cleaning and chunking a second time.
    """
    return rows.select("file_id", F.posexplode_outer("_chunks").alias("chunk_index", "chunk_text")).filter(
        "chunk_index IS NOT NULL")


def chunk_sliding(
    cleaned: DataFrame, size: int = fixed.CHUNK_WORDS, overlap: int = fixed.CHUNK_OVERLAP,
    min_words: int = fixed.CHUNK_MIN_WORDS,
) -> DataFrame:
    """One row per window of every text, without regard to paragraphs."""
    rows = _with_chunks(cleaned, size, overlap, min_words, paragraphs=False)
    return _exploded(rows.select("file_id", "_chunks"))


def chunk_paragraphs(
    cleaned: DataFrame, size: int = fixed.CHUNK_WORDS, overlap: int = fixed.CHUNK_OVERLAP,
    min_words: int = fixed.CHUNK_MIN_WORDS,
) -> DataFrame:
    """One row per packed chunk of every text of more than ``size`` words and one paragraph."""
    text, words = F.col("clean_text"), F.col("_words")
    rows = cleaned.withColumn("_words", tx.words(text))
    rows = rows.withColumn("_paragraphs", F.when(F.size(words) > size, _paragraphs(text)))
    packed = packed_paragraphs(words, F.col("_paragraphs"), size, overlap, min_words)
    return _exploded(rows.select("file_id", F.when(F.size("_paragraphs") > 1, packed).alias("_chunks")))


CHUNK_COLUMNS = (
    "chunk_id", "extracted_content_id", "file_id", "chunk_index", "chunk_total", "clean_text",
    "clean_char_count", "clean_word_count", "language", "phase1_status", "clean_status",
)


def chunk_documents(
    content: DataFrame, chunk_size: int = fixed.CHUNK_WORDS, overlap: int = fixed.CHUNK_OVERLAP,
    min_words: int = fixed.CHUNK_MIN_WORDS, detect: Callable[[Column], Column] = tx.detect_language,
) -> DataFrame:
    """Clean and chunk stored content into narrow chunk rows.

    ``detect`` names the language of a chunk without a hint; a fitted
    ``language.detector`` is better than the word lists, on short chunks above all.

    Needs id, file_id, extracted_text, extraction_method, extraction_status,
    language_hint, phase1_status; a ``clean_text`` that is there already, as from
    ``reuse_clean_by_hash``, is taken.  Skipped, blank and emptied texts keep one
    placeholder row.  No shuffle: every step is inside the row.
    """
    skipped = F.col("extraction_status").isin("FAILED", "SKIPPED") | (
        tx.is_blank(F.coalesce("extracted_text", F.lit("")))
    )
    cleaned = content if "clean_text" in content.columns else clean_text(content)
    cleaned = cleaned.withColumn(
        "clean_status",
        F.when(skipped, "SKIPPED").when(F.col("clean_text") == "", "FAILED").otherwise("SUCCESS"),
    )
    good, chunks = F.col("clean_status") == "SUCCESS", F.col("_chunks")
    chunked = _with_chunks(cleaned, chunk_size, overlap, min_words).withColumn(
        "_chunks",
        F.when(~good, F.array(F.lit(""))).when(F.size(chunks) > 0, chunks).otherwise(F.array("clean_text")),
    )
    exploded = chunked.select(
        F.col("id").alias("extracted_content_id"), "file_id", "language_hint", "phase1_status",
        "clean_status", F.when(good, F.size("_chunks")).otherwise(0).cast("long").alias("chunk_total"),
        # outer: an inferred filter on the array would repeat all work above it
        F.posexplode_outer("_chunks").alias("chunk_index", "clean_text"),
    )
    hint = tx.strip(F.coalesce("language_hint", F.lit("")))
    text = F.col("clean_text")
    return exploded.withColumns({
        "chunk_id": F.concat_ws("_", "extracted_content_id", "chunk_index"),
        "chunk_index": F.col("chunk_index").cast("long"),
        "clean_char_count": F.char_length(text).cast("long"),
        "clean_word_count": tx.word_count(text),
        "language": F.when(F.col("clean_status") != "SUCCESS", "")
        .when(hint != "", hint).otherwise(detect(F.when(hint == "", text))),
    }).select(*CHUNK_COLUMNS)


def clean_summary(content: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: files per outcome with percentages, copies that reuse a cleaned text, chunks, words."""
    reused = (
        content.filter(F.col("hash").isNotNull() & ~F.col("hash").startswith("error"))
        .groupBy("hash").agg(F.count("*").alias("n"))
        .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)))
    )
    first, status = F.col("chunk_index") == 0, F.col("clean_status")
    totals = chunks.agg(
        F.count_if(first).alias("source_files"),
        F.count_if(first & (status == "SUCCESS")).alias("cleaned"),
        F.count_if(first & (status == "FAILED")).alias("failed"),
        F.count_if(first & (status == "SKIPPED")).alias("skipped"),
        F.count_if(status == "SUCCESS").alias("total_chunks"),
        F.coalesce(F.sum(F.when(status == "SUCCESS", F.col("clean_word_count"))), F.lit(0)).alias("total_words"),
    )

    def percent(name: str) -> Column:
        share = F.try_divide(F.col(name) * 100.0, F.col("source_files"))
        return F.round(F.coalesce(share, F.lit(0.0)), 1).alias(f"{name}_percent")

    return totals.select(
        "*", percent("cleaned"), percent("failed"), percent("skipped"), reused.scalar().alias("reused")
    )


def chunk_languages(chunks: DataFrame) -> DataFrame:
    """Chunks per language, the largest first."""
    return (
        chunks.filter("clean_status = 'SUCCESS' AND language <> ''")
        .groupBy("language").agg(F.count("*").alias("chunks"))
        .orderBy(F.desc("chunks"), "language")
    )
