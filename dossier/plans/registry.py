"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, FloatType

from ..functions import fixed, text as tx, vector as vx
from ..functions.storage import shared_folder
from ..operators import (
    chunk, cluster, dedup, explain, extract, feedback, inventory, language, model, report, score, serve, vectors,
)
from ..sources import files as raw, tables, walk
from ..streaming import feedback as feedback_stream, ingest
from .corpus import AS_OF, PAIR_THRESHOLD, Corpus, corpus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _rounded(frame: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of digits, so results compare across engines."""
    return frame.select(*[
        F.round(F.col(f"`{f.name}`").cast("double"), digits).alias(f.name)
        if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f"`{f.name}`")
        for f in frame.schema.fields
    ])


def query(build: Callable[[Corpus], DataFrame]) -> Callable[[Corpus], DataFrame]:
    """Register a corpus query under its function name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rounded(build(corpus(spark, sf_dir)))

    QUERIES[build.__name__] = run
    return build


def _long(frame: DataFrame, key: str, array: str) -> DataFrame:
    """An array column as rows (key, position, value)."""
    return frame.select(key, F.posexplode_outer(array).alias("position", "value"))


def _scratch(c: Corpus, name: str) -> str:
    return f"{shared_folder(c.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# --- sources, sinks, upserts -------------------------------------------------
@query
def scan_inventory(c):
    return raw.scan_inventory(c.spark, c.sf_dir).drop("modified_time")


@query
def walk_inventory(c):
    return walk.walk_inventory(c.spark, c.sf_dir).drop("created_time", "modified_time", "access_time")


@query
def inventory_row(c):
    return inventory.inventory_row(c.raw_files)


@query
def content_hash(c):
    text = c.table("documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    return inventory.content_hash(text).select("doc_id", "hash")


def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, content): a zip of every (name, text), a few hundred at a time."""
    def pack(text: str, name: str) -> bytes:
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr(f"inner/{name}.txt", text)
            archive.writestr(f"{name}.tmp", text)
            archive.writestr(f"{name}.csv", "")
            archive.writestr(f"inner/deep/{name}.json", text[::-1])
        return buffer.getvalue()

    for batch in batches:
        for begin in range(0, batch.num_rows, 256):
            part = batch.slice(begin, 256)
            names, texts = part.column("name").to_pylist(), part.column("text").to_pylist()
            packed = [pack(t, n) for t, n in zip(texts, names)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([None if n is None else f"/root/{n}.zip" for n in names], pa.string()), pa.array(packed, pa.binary())], names=["path", "content"])


def _archives(c: Corpus) -> DataFrame:
    """Every document packed into a small zip of its own."""
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    return c.texts("documents").select(name.alias("name"), "text").mapInArrow(_zipped, "path string, content binary")


@query
def archive_members(c):
    return raw.archive_members(_archives(c)).drop("modified_time")


@query
def archive_text_rollup(c):
    members = raw.text_source(raw.zip_members(_archives(c)))
    rolled = raw.archive_text_rollup(members)
    return rolled.select("source_archive", "extraction_method", F.sha2("text", 256).alias("text_hash"))


@query
def upsert_by_key(c):
    """Score rows updated by the actions, the last action of a file winning."""
    old = c.files.select("file_id", "status", F.lit(-1).cast("long").alias("batch"))
    new = c.actions.select("file_id", F.col("action").alias("status"), F.col("event_id").alias("batch"))
    return tables.upsert_by_key(old, new, "file_id", "batch")


@query
def upsert_by_key_columns(c):
    """Partial update: an existing row changes only its status."""
    old = c.files.select("file_id", "status", F.lit(-1).cast("long").alias("batch"))
    new = c.actions.select("file_id", F.col("action").alias("status"), F.col("event_id").alias("batch"))
    return tables.upsert_by_key(old, new, "file_id", "batch", update=("status",))


@query
def upsert_buckets(c):
    """The same merge into a table of 32 hash buckets, in place."""
    path = _scratch(c, "bucketed")
    old = c.files.select("file_id", "status", F.lit(-1).cast("long").alias("batch"))
    new = c.actions.select("file_id", F.col("action").alias("status"), F.col("event_id").alias("batch"))
    tables.write_bucketed(old, path, "file_id", 32)
    tables.upsert_buckets(c.spark, path, new, "file_id", "batch", 32)
    return c.spark.read.parquet(path).select("file_id", "status", "batch")


@query
def insert_ignore(c):
    old = c.files.select("file_id", "status", F.lit(-1).cast("long").alias("batch"))
    new = c.actions.select("file_id", F.col("action").alias("status"), F.col("event_id").alias("batch"))
    return tables.insert_ignore(old, new, ["file_id"], "batch")


@query
def append_event(c):
    path = _scratch(c, "events")
    tables.append_event(c.actions, path)
    tables.append_event(c.actions, path)
    return (
        c.spark.read.parquet(path).groupBy("event_id", "file_id", "action", "actor")
        .agg(F.count("*").alias("copies"), F.count("created_at").alias("stamped"))
    )


@query
def export_csv(c):
    path = _scratch(c, "csv")
    rows = c.files.join(c.scores.select("file_id", "label", "importance_score"), "file_id")
    columns = {**tables.FILES_REPORT, "Size (MB)": tables.size_in_mb()}
    tables.export_csv(rows, columns, path)
    back = c.spark.read.csv(path, header=True, quote='"', escape='"', emptyValue="", nullValue="\u0000")
    return back.toDF(*[n.lower().replace(" ", "_").replace("(", "").replace(")", "") for n in back.columns])


@query
def write_report_json(c):
    path = _scratch(c, "report")
    tables.write_report_json(score.label_counts(c.scores), path)
    return c.spark.read.schema("label string, n long").json(path)


@query
def text_source(c):
    text = c.texts("documents").select("doc_id", F.concat(F.lit(" \n"), "text", F.lit("\t ")).cast("binary").alias("content"))
    return raw.text_source(text).select("doc_id", F.sha2("text", 256).alias("text_hash"),
                                        F.char_length("text").alias("chars"))


@query
def binary_guard(c):
    content = c.texts("documents").join(c.all_files.select(F.col("file_id").alias("doc_id"), "extension"), "doc_id")
    return raw.binary_guard(content.withColumn("content", F.col("text").cast("binary"))).select("doc_id", "is_binary")


@query
def printable_strings(c):
    text = c.texts("documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    return raw.printable_strings(text).select("doc_id", F.sha2("text", 256).alias("text_hash"))


# --- projections, predicates, classification ---------------------------------
@query
def categorize_extension(c):
    return inventory.categorize_extension(c.all_files.select("file_id", "extension"))


@query
def inventory_status(c):
    return inventory.inventory_status(c.all_files.select("file_id", "extension", "size_bytes"))


@query
def quarantine_split(c):
    kept, held = inventory.quarantine_split(c.all_files)
    return kept.select("file_id", F.lit("").alias("reason")).unionByName(held.select("file_id", "reason"))


@query
def extraction_route(c):
    return extract.extraction_route(c.all_files).select("file_id", "extension", "category", "route")


@query
def truncate_text(c):
    cut = extract.truncate_text(c.raw_content, max_chars=1000)
    return cut.select("file_id", "extraction_method", F.md5("extracted_text").alias("text_hash"))


@query
def extraction_status(c):
    return extract.extract_content(c.raw_content).select("file_id", "extraction_status")


@query
def extraction_filter(c):
    stored, held = extract.extraction_filter(c.all_content)
    return stored.select("file_id", F.lit("").alias("reason")).unionByName(held.select("file_id", "reason"))


@query
def ocr_flag(c):
    return extract.ocr_flag(c.raw_content).select("file_id", "ocr_applied")


@query
def text_counts(c):
    return extract.text_counts(c.raw_content).select("file_id", "char_count", "word_count")


@query
def db_text_sanitize(c):
    return extract.db_text_sanitize(c.raw_content).select("file_id", F.md5("extracted_text").alias("text_hash"))


@query
def metadata_filter(c):
    found = vectors.metadata_filter(
        c.search_meta, {"language": "en", "category": "Document"},
        modified_after="2021-01-01", modified_before="2024-12-31 23:59:59")
    return found.select("chunk_id", "file_id", "language", "category", "modified_time")


@query
def snippet_240(c):
    return c.texts("documents").select("doc_id", tx.snippet(F.col("text")).alias("snippet"))


@query
def action_to_label(c):
    return feedback.action_to_label(c.actions, c.scores).select(
        "event_id", "file_id", "action", "new_label", "predicted_label", "predicted_score", "decision")


def _raw_feedback(c: Corpus) -> DataFrame:
    """Events as raw feedback with untidy and invalid entries."""
    return c.actions.select(
        "event_id", "file_id", F.concat(F.lit(" "), F.lower("action"), F.lit(" ")).alias("human_label"),
        F.when(F.col("event_id") % 3 == 0, "approve").when(F.col("event_id") % 3 == 1, " Reject")
        .otherwise("maybe").alias("decision"))


@query
def validate_feedback(c):
    valid, rejected = feedback.validate_feedback(_raw_feedback(c))
    return valid.withColumn("accepted", F.lit(True)).unionByName(rejected.withColumn("accepted", F.lit(False)))


# --- joins -------------------------------------------------------------------
@query
def pending_antijoin(c):
    """Files without stored content, KEEP first."""
    pending = serve.pending_antijoin(c.files, c.content, "file_id", "status")
    return pending.select("file_id", "status")


@query
def score_input_join(c):
    return score.score_input_join(c.files, c.content, c.chunks).drop("category", "hash")


@query
def chunk_to_path_map(c):
    return c.sections


@query
def files_listing(c):
    rows = serve.files_listing(c.files, c.scores, c.explanations, c.content, c.redundancy, 100)
    return rows.select("file_id", "path", "importance_score", "label", "confidence", "top_signal_1",
                       "extraction_status", "is_duplicate", "duplicate_similarity")


@query
def file_detail(c):
    rows = serve.file_detail(c.files, c.scores, c.explanations, c.content, c.chunks, 2)
    return rows.select("file_id", "path", "importance_score", "label", "top_signal_1", "extraction_status", "preview")


@query
def text_preview(c):
    return serve.text_preview(c.content, c.chunks)


@query
def review_queue(c):
    rows = serve.review_queue(c.files, c.scores, c.explanations, c.content, 200)
    return rows.select("file_id", "path", "importance_score", "label", "top_signal_1", "explanation_text",
                       "counterfactual_tip", "extraction_status")


@query
def feedback_training_join(c):
    return feedback.feedback_training_join(c.feedback, c.scores, c.files).select(
        "feedback_id", "file_id", "human_label", "folder", "path", "s_content_richness", "s_recency",
        "s_semantic_proximity")


@query
def semi_join_ids(c):
    ids = c.actions.filter("action = 'DELETE'").select("file_id")
    return serve.semi_join_ids(c.scores, ids).select("file_id", "importance_score", "label")


@query
def explanations_lookup(c):
    ids = c.actions.filter("action = 'DELETE'").select("file_id")
    return explain.explanations_lookup(c.explanations, ids).select("file_id", "importance_score", "top_signal_1")


# --- aggregations ------------------------------------------------------------
@query
def exact_duplicate_groups(c):
    return dedup.exact_duplicate_groups(c.chunked_files)


@query
def exact_duplicate_pairs(c):
    return c.duplicate_files


@query
def file_redundancy(c):
    return c.redundancy


@query
def chunk_counts_per_path(c):
    return dedup.chunk_counts_per_path(c.chunk_paths)


@query
def file_embedding_mean(c):
    return _long(c.file_vectors, "file_id", "vector")


@query
def label_counts(c):
    return score.label_counts(c.scores)


@query
def score_distribution(c):
    return score.score_distribution(c.scores)


@query
def kpis(c):
    return report.kpis(c.files, c.scores, c.redundancy)


@query
def status_breakdown(c):
    return report.status_breakdown(c.scores)


@query
def score_histogram_equal(c):
    return report.score_histogram_equal(c.scores)


@query
def score_histogram_tiers(c):
    return report.score_histogram_tiers(c.scores)


@query
def folder_tree_counts(c):
    return inventory.folder_tree_counts(c.files)


@query
def explanation_report(c):
    return explain.explanation_report(c.explanations)


@query
def inventory_summary(c):
    return inventory.inventory_summary(c.all_files)


@query
def extraction_summary(c):
    return extract.extraction_summary(c.all_content)


@query
def clean_summary(c):
    return chunk.clean_summary(c.content, c.chunks)


@query
def chunk_languages(c):
    return chunk.chunk_languages(c.chunks)


@query
def duplicates_summary(c):
    return dedup.duplicates_summary(c.duplicate_files, c.sections, c.redundancy)


@query
def disagreement_rate(c):
    return feedback.disagreement_rate(feedback.usable_feedback(c.feedback))


@query
def class_balance_check(c):
    return feedback.class_balance_check(feedback.usable_feedback(c.feedback), minimum=40)


@query
def retrain_status(c):
    return feedback.retrain_status(c.feedback, feedback.usable_feedback(c.feedback))


# --- window, dedup, sort, limit, top-k ---------------------------------------
@query
def top_chunk_excerpt(c):
    return serve.top_chunk_excerpt(c.chunks).select("file_id", F.md5("excerpt").alias("excerpt_hash"))


@query
def first_chunk_per_file(c):
    return serve.first_chunk_per_file(c.chunks).select("file_id", F.md5("preview").alias("preview_hash"))


@query
def latest_feedback_per_file(c):
    return feedback.latest_feedback_per_file(c.feedback).select(
        "file_id", "feedback_id", "human_label", "reviewer_confidence", "created_at")


@query
def best_hit_per_file(c):
    """Every chunk scored against the sample vector, best chunk per file."""
    hits = c.vectors.select("chunk_id", "file_id", vx.cosine_to(F.col("vector"), c.query_vector).alias("score"))
    return serve.best_hit_per_file(hits.join(c.chunks.select("chunk_id", "clean_text"), "chunk_id", "left"))


@query
def top_bottom_files(c):
    return score.top_bottom_files(c.scores)


@query
def explorer_page(c):
    rows = c.files.join(c.scores.select("file_id", "importance_score", "label"), "file_id")
    page = report.explorer_page(rows, "/en", "Document", "size_bytes", True, 60)
    return page.select("file_id", "name", "folder", "category", "size_bytes", "label")


@query
def biggest_files(c):
    return report.biggest_files(c.files)


@query
def duplicates_listing(c):
    return dedup.duplicates_listing(c.redundancy, 10, 2)


@query
def session_history(c):
    return serve.session_history(c.messages, 3).select("session_id", "message_id", "role", "position")


@query
def latest_promoted_model(c):
    return feedback.latest_promoted_model(c.versions)


# --- set operations ----------------------------------------------------------
@query
def duplicate_paths(c):
    return c.dup_paths


@query
def duplicate_paths_default(c):
    """At the default thresholds: from files per class and links of classes, without a pair of files."""
    return c.strict_dup_paths


@query
def redundancy_of_paths(c):
    """Pairs of every file whose id is divisible by 50 with any other, at the default thresholds."""
    asked = c.files.filter("file_id % 50 = 0").select("path")
    return dedup.redundancy_of_paths(asked, c.strict_class_files, c.strict_class_links, c.vector_paths).withColumns(
        {x: F.round(x, 6) for x in ("avg_similarity", "redundancy_ratio")})


@query
def recommendations(c):
    return dedup.recommendations(c.duplicate_files, c.redundancy, 0.40)


# --- text cleaning, chunking, language ---------------------------------------
def _digest(frame: DataFrame, key: str, value: Column) -> DataFrame:
    return frame.select(key, F.md5(value).alias("text_hash"))


def _dirty(c: Corpus) -> Column:
    """Document text with every artefact planted between its words."""
    junk = "".join(bad for bad, _ in fixed.ENCODING_FIXES if bad != "\x00")
    return F.replace(F.col("text"), F.lit(" the "), F.lit(f" the{junk}||||____ ..... "))


@query
def fix_encoding(c):
    return _digest(c.texts("documents"), "doc_id", tx.fix_encoding(_dirty(c)))


@query
def strip_html(c):
    """Text nodes of every page; scripts and styles stay in."""
    pages = c.texts("pages")
    return pages.select("page_id", tx.strip_html(F.col("html")).alias("text")).select(
        "page_id", F.char_length("text").alias("chars"), F.md5("text").alias("text_hash"))


@query
def clean_html_pages(c):
    """Whole pages through the cleaning steps, as generic reads."""
    pages = c.texts("pages").select(
        "page_id", F.col("html").alias("extracted_text"), F.lit("plain_text_read").alias("extraction_method"))
    return _digest(chunk.clean_text(pages), "page_id", F.col("clean_text"))


@query
def strip_html_tags(c):
    return _digest(c.texts("pages"), "page_id", tx.strip_tags(F.col("html")))


@query
def remove_ocr_noise(c):
    return _digest(c.texts("documents"), "doc_id", tx.remove_ocr_noise(_dirty(c)))


@query
def normalize_unicode(c):
    decomposed = F.replace(F.col("text"), F.lit("é"), F.lit("é"))
    return _digest(c.texts("documents"), "doc_id", tx.normalize_unicode(decomposed))


@query
def remove_boilerplate(c):
    noisy = F.replace(F.col("text"), F.lit("\n"), F.lit("\n Page 3 of 9\n12\nCONFIDENTIAL\nwww.x.org\nWWW.x\n"))
    return _digest(c.texts("documents"), "doc_id", tx.remove_boilerplate(noisy))


@query
def normalize_whitespace(c):
    loose = F.replace(F.col("text"), F.lit("\n"), F.lit(" \t\r\n\r\n\n\n  "))
    return _digest(c.texts("documents"), "doc_id", tx.normalize_whitespace(loose))


@query
def clean_text(c):
    return _digest(chunk.clean_text(c.raw_content), "file_id", F.col("clean_text"))


@query
def reuse_clean_by_hash(c):
    return _digest(chunk.reuse_clean_by_hash(c.all_content), "file_id", F.col("clean_text"))


def _cleaned(c: Corpus) -> DataFrame:
    return chunk.clean_text(c.raw_content).select("file_id", "clean_text")


@query
def chunk_sliding(c):
    return chunk.chunk_sliding(_cleaned(c)).select(
        "file_id", "chunk_index", F.md5("chunk_text").alias("text_hash"))


@query
def chunk_paragraphs(c):
    """Every line of a document as a paragraph of its own."""
    spaced = _cleaned(c).withColumn("clean_text", F.replace("clean_text", F.lit("\n"), F.lit("\n\n")))
    return chunk.chunk_paragraphs(spaced)


@query
def chunk_documents(c):
    return chunk.chunk_documents(c.content).select(
        "chunk_id", "file_id", "chunk_index", "chunk_total", "clean_char_count", "clean_word_count", "language",
        "clean_status", F.md5("clean_text").alias("text_hash"))


@query
def detect_language(c):
    """By the character n-gram model of all labelled documents."""
    detect = language.detector(c.languages, c.spark)
    return c.texts("documents").select("doc_id", detect(F.col("text")).alias("language"))


@query
def detect_language_words(c):
    """By function words, where no model is fitted."""
    return c.texts("documents").select("doc_id", tx.detect_language(F.col("text")).alias("language"))


@query
def language_model(c):
    """Log probabilities of letter runs by language."""
    return c.languages.table(c.spark).withColumn("logp", F.round("logp", 6))


@query
def embed_truncate(c):
    """Chunk vectors of whole texts, without an input limit."""
    good = c.chunks.filter("clean_status = 'SUCCESS'").select("chunk_id", "clean_text")
    embedded = vectors.embed_text(good)
    norm = F.round(F.sqrt(vx.dot(F.col("vector"), F.col("vector"))), 4)
    return embedded.select("chunk_id", F.size("vector").alias("dims"), norm.alias("norm"))


# --- vectors -----------------------------------------------------------------
@query
def vector_normalize(c):
    return _long(vectors.vector_normalize(c.vectors), "chunk_id", "vector")


@query
def semantic_search(c):
    found = vectors.semantic_search(
        c.vectors.select("chunk_id", "vector"), c.search_meta, c.query_vector, 20, {"language": "en"})
    return found.select("chunk_id", "file_id", "score", "name", "language")


@query
def search_files(c):
    found = serve.search_files(
        c.vectors.select("chunk_id", "vector"), c.search_meta, c.files, c.scores, c.explanations, c.query_vector, 30)
    return found.select("file_id", "path", "relevance", "importance_score", "label", "snippet", "explanation_text")


@query
def knn_batch_join(c):
    asked = c.vectors.select(F.col("chunk_id").alias("query_id"), "vector")
    return vectors.knn_batch_join(asked, c.vectors.select("chunk_id", "vector"), 5)


@query
def similar_chunks(c):
    return vectors.similar_chunks(c.vectors, "0_0", 0.15, 20)


@query
def near_duplicate_pairs(c):
    return vectors.near_duplicate_pairs(c.vectors, PAIR_THRESHOLD)


@query
def near_duplicate_text_pairs(c):
    """Near-duplicate chunks of the cleaned texts, every copy in every pair."""
    return vectors.near_duplicate_pairs(c.text_vectors, 0.95, copies="all")


@query
def near_duplicate_lsh(c):
    return vectors.near_duplicate_pairs(c.text_vectors, 0.95, method="lsh", copies="all")


@query
def dbscan_cluster(c):
    return c.clusters.select("file_id", F.coalesce("cluster", F.lit(-1)).alias("cluster"), "is_core")


@query
def cluster_density(c):
    return cluster.cluster_density(c.files.select("file_id"), c.clusters)


def _boot8(c: Corpus) -> DataFrame:
    return score.boot8(c.signals).select("file_id", "boot8")


@query
def keep_centroid(c):
    centroid = vectors.keep_centroid(_boot8(c), c.file_vectors)
    return centroid.select(F.posexplode("vector").alias("position", "value"))


@query
def semantic_proximity(c):
    centroid = vectors.keep_centroid(_boot8(c), c.file_vectors)
    return vectors.semantic_proximity(c.files.select("file_id"), c.file_vectors, centroid)


# --- scoring, model, explanation, feedback -----------------------------------
@query
def s_content_richness(c):
    return score.s_content_richness(c.score_input).select("file_id", "s_content_richness")


@query
def s_recency(c):
    return score.s_recency(c.score_input, AS_OF).select("file_id", "s_recency")


@query
def s_type_importance(c):
    return score.s_type_importance(c.score_input).select("file_id", "s_type_importance")


@query
def s_uniqueness(c):
    return score.s_uniqueness(c.score_input, c.dup_paths).select("file_id", "s_uniqueness")


@query
def s_uniqueness_default(c):
    """With the duplicate paths of the default thresholds."""
    return score.s_uniqueness(c.score_input, c.strict_dup_paths).select("file_id", "s_uniqueness")


@query
def s_extraction_quality(c):
    return score.s_extraction_quality(c.score_input).select("file_id", "s_extraction_quality")


@query
def s_content_depth(c):
    return score.s_content_depth(c.score_input).select("file_id", "s_content_depth")


@query
def s_llm_quality(c):
    rows = score.s_content_depth(score.s_extraction_quality(score.s_content_richness(c.score_input)))
    return score.s_llm_quality(rows).select("file_id", "s_llm_quality")


@query
def llm_rating_batch(c):
    return score.llm_rating_batch(_rating_keys(c)).select("file_id", "cache_key", F.md5("snippet").alias("snippet_hash"))


def _rating_keys(c: Corpus) -> DataFrame:
    return score.rating_keys(c.score_input, c.dup_paths, serve.top_chunk_excerpt(c.chunks))


@query
def llm_rating_applied(c):
    """Quality labels taken as answers to the rating requests, given to all files of a key."""
    keys = _rating_keys(c)
    answers = c.table("labels").select(
        F.col("doc_id").alias("file_id"), (F.col("quality") * 3 + F.col("toxic") * 7).alias("rating"))
    ratings = score.llm_rating_batch(keys).join(answers, "file_id").select("cache_key", "rating")
    return score.apply_ratings(c.files.select("file_id"), ratings, keys)


@query
def signals(c):
    rows = score.signals(
        c.files, c.content, c.chunks, c.dup_paths, c.file_vectors, c.clusters, AS_OF)
    return rows.select("file_id", *fixed.SIGNALS)


@query
def boot_score(c):
    return score.boot_score(c.signals).select("file_id", "boot_score")


@query
def boot_label(c):
    return score.boot_label(score.boot_score(c.signals)).select("file_id", "boot_label")


@query
def train_importance_model(c):
    return model.score_with_model(c.signals, c.forest()).select("file_id", "importance_score", "label", "confidence")


@query
def cross_validate(c):
    rows = score.boot_label(score.boot_score(c.signals))
    return model.cross_validate(rows)


@query
def score_with_model(c):
    """Scores from a probability table built out of the signals."""
    raw_p = [F.col("s_content_richness"), F.col("s_type_importance"), F.col("s_uniqueness"), F.col("s_semantic_proximity")]
    total = raw_p[0] + raw_p[1] + raw_p[2] + raw_p[3]
    table = c.signals.select("file_id", F.array(*[p / total for p in raw_p]).alias("probability"))
    return model.score_from_probabilities(table).select("file_id", "importance_score", "label", "confidence")


@query
def feature_importance(c):
    return model.feature_importance(c.forest(), c.signals)


@query
def attribution_proxy(c):
    return _long(model.attribution_proxy(c.scores), "file_id", "attribution")


@query
def attribution_shapley(c):
    return _long(model.attributions(c.scores, c.forest()), "file_id", "attribution")


def _entry_text(entries: Column) -> Column:
    return F.array_join(F.transform(entries, lambda s: s["signal"]), ",")


@query
def top_signals(c):
    return explain.top_signals(c.attributed).select("file_id", _entry_text(F.col("top_signals")).alias("signals"))


@query
def weak_signals(c):
    return explain.weak_signals(c.attributed).select("file_id", _entry_text(F.col("weak_signals")).alias("signals"))


@query
def explanation_prompt(c):
    rows = explain.weak_signals(explain.top_signals(c.attributed))
    return explain.explanation_prompt(rows).select("file_id", "prompt")


@query
def decision_confidence(c):
    return model.decision_confidence(c.scores, c.forest()).select("file_id", "confidence")


@query
def llm_sampling_gate(c):
    return explain.llm_sampling_gate(c.attributed, keep_percent=40).select("file_id", "label", "use_llm")


@query
def template_explanation(c):
    return c.explanations.select("file_id", "explanation_text", "counterfactual_tip")


@query
def build_explanations(c):
    rows = explain.build_explanations(c.attributed)
    shares = [F.element_at("shap_json", F.lit(s)).alias(f"shap_{s}") for s in fixed.SIGNALS]
    return rows.select("*", *shares).drop("shap_json", "explanation_text", "counterfactual_tip")


@query
def explanation_fallback_view(c):
    """Half of the files shown as if not yet explained."""
    bare = F.col("file_id") % 2 == 0
    hidden = ("explanation_text", "counterfactual_tip", "confidence", "top_signal_1", "top_signal_2", "top_signal_3")
    rows = c.explanations.withColumns({n: F.when(~bare, F.col(n)) for n in hidden})
    shown = explain.explanation_fallback_view(rows)
    return shown.withColumn("top3", F.array_join(F.transform("top3", lambda s: s["label"]), ","))


@query
def usable_feedback(c):
    return feedback.usable_feedback(c.feedback).select("file_id", "feedback_id", "human_label", "predicted_label")


@query
def stratified_split(c):
    usable = feedback.usable_feedback(c.feedback)
    return feedback.stratified_split(usable).select("file_id", "human_label", "is_holdout")


@query
def class_weights(c):
    return model.class_weights(feedback.usable_feedback(c.feedback), "human_label")


def _training_rows(c: Corpus) -> DataFrame:
    rows = feedback.feedback_training_join(feedback.usable_feedback(c.feedback), c.scores, c.files)
    return feedback.stratified_split(rows)


@query
def train_candidate(c):
    """Candidate trained on the training part, applied to the holdout."""
    rows = _training_rows(c)
    forest = model.train_candidate(rows.filter("NOT is_holdout"), "human_label")
    held = model.score_with_model(rows.filter("is_holdout"), forest)
    return held.select("file_id", "human_label", F.col("label").alias("predicted"), "confidence")


@query
def gate_score(c):
    return feedback.gate_score(feedback.usable_feedback(c.feedback).filter("predicted_label IS NOT NULL"),
                               "human_label", "predicted_label")


@query
def classification_report(c):
    return feedback.classification_report(
        feedback.usable_feedback(c.feedback).filter("predicted_label IS NOT NULL"), "human_label", "predicted_label")


@query
def promotion_decision(c):
    usable = feedback.usable_feedback(c.feedback).filter("predicted_label IS NOT NULL")
    candidate = feedback.gate_score(usable, "human_label", "predicted_label")
    return feedback.promotion_decision(candidate, feedback.latest_promoted_model(c.versions))


@query
def model_version_log(c):
    usable = feedback.usable_feedback(c.feedback).filter("predicted_label IS NOT NULL")
    candidate = feedback.gate_score(usable, "human_label", "predicted_label")
    decision = feedback.promotion_decision(candidate, feedback.latest_promoted_model(c.versions))
    quality = feedback.classification_report(usable, "human_label", "predicted_label")
    row = feedback.model_version_row(c.versions, decision, "models/candidate", quality, usable)
    return c.versions.select("version", "promoted", "gate_score").unionByName(
        row.select("version", "promoted", "gate_score"))


@query
def rollback_to_version(c):
    return feedback.rollback_to_version(c.versions, 4)


@query
def mark_feedback_used(c):
    return feedback.mark_feedback_used(c.feedback, feedback.usable_feedback(c.feedback), 9, False).select(
        "feedback_id", "used_in_train", "training_attempts", "promoted_in_version")


@query
def mark_feedback_promoted(c):
    return feedback.mark_feedback_used(c.feedback, feedback.usable_feedback(c.feedback), 9, True).select(
        "feedback_id", "used_in_train", "training_attempts", "promoted_in_version")


@query
def apply_actions(c):
    return feedback.apply_actions(c.scores, c.actions).select("file_id", "label")


@query
def retrieval_context(c):
    """Context lines for every supplied vector taken as a question."""
    asked = c.vectors.select(F.col("chunk_id").alias("query_id"), "vector")
    near = vectors.knn_batch_join(asked, c.vectors.select("chunk_id", "vector"), 5)
    hits = near.join(c.vectors.select("chunk_id", "file_id"), "chunk_id").join(
        c.chunks.select("chunk_id", "clean_text"), "chunk_id", "left").select(
        "query_id", "file_id", "chunk_id", F.col("similarity").alias("score"), "clean_text")
    best = serve.best_hit_per_file(hits, ("query_id",))
    return serve.retrieval_context(best, c.files, c.scores, c.chunks, asked)


@query
def retrieval_context_text(c):
    """Context lines for every user turn of the conversations."""
    c.chunks  # stored once for the vectors and the hits
    near = vectors.knn_batch_join(c.questions, c.text_vectors.select("chunk_id", "vector"), 5)
    hits = near.join(c.chunks.select("chunk_id", "file_id", "clean_text"), "chunk_id")
    best = serve.best_hit_per_file(hits.withColumnRenamed("similarity", "score"), ("query_id",))
    return serve.retrieval_context(best, c.files, c.scores, c.chunks, c.questions)


# --- streaming ---------------------------------------------------------------
@query
def stream_ingest(c):
    """All content streamed in as files, chunked, and read back."""
    source, target, checkpoint = (_scratch(c, f"stream-{part}") for part in ("in", "out", "state"))
    c.content.write.parquet(source)
    schema = c.spark.read.parquet(source).schema
    ingest.stream_ingest(c.spark, source, schema, target, checkpoint, files_per_batch=4).awaitTermination()
    return ingest.ingested(c.spark, target).select(
        "chunk_id", "file_id", "chunk_index", "chunk_total", "clean_char_count", "clean_word_count", "language",
        "clean_status", F.md5("clean_text").alias("text_hash"))


@query
def stream_feedback_latest(c):
    source, target, checkpoint = (_scratch(c, f"actions-{part}") for part in ("in", "out", "state"))
    c.actions.repartition(4).write.parquet(source)
    schema = c.spark.read.parquet(source).schema
    feedback_stream.stream_feedback_latest(
        c.spark, source, schema, target, checkpoint, files_per_batch=2).awaitTermination()
    return feedback_stream.current_state(c.spark, target, "file_id").select(
        "file_id", "event_id", "action", "actor", "ts")
