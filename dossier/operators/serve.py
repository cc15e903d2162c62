"""Queries behind the file lists, search results and chat context."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import text as tx
from ..functions.storage import written
from . import vectors as vec
from .keyed import top_per_key

EXPLANATION_PART = (
    "confidence", "shap_json", "explanation_text", "counterfactual_tip",
    *[f"top_signal_{i}{p}" for i in (1, 2, 3) for p in ("", "_value", "_shap")],
)


def semi_join_ids(rows: DataFrame, ids: DataFrame, key: str = "file_id") -> DataFrame:
    """Rows whose key is among the ids; Spark broadcasts the ids when they are small."""
    return rows.join(ids.select(key), key, "left_semi")


def pending_antijoin(rows: DataFrame, done: DataFrame, key: str, status_col: str | None = None) -> DataFrame:
    """Rows not yet processed; with ``status_col`` KEEP rows come first, then by key."""
    pending = rows.join(done.select(key), key, "left_anti")
    if status_col is None:
        return pending
    return pending.orderBy(F.when(F.col(status_col) == "KEEP", 0).otherwise(1), key)


def _of(frame: DataFrame, ids: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Columns of the few rows named by ``ids``, a frame bounded by a limit."""
    return frame.join(F.broadcast(ids.select("file_id")), "file_id", "left_semi").select("file_id", *columns)


def path_similarity(redundancy: DataFrame) -> DataFrame:
    """Highest pair similarity of every path on either side."""
    return (
        redundancy.select(F.explode(F.array("path_1", "path_2")).alias("path"), "avg_similarity")
        .groupBy("path").agg(F.max("avg_similarity").alias("similarity"))
    )


def files_listing(
    files: DataFrame, scores: DataFrame, explanations: DataFrame, content: DataFrame,
    redundancy: DataFrame, limit: int = 100,
) -> DataFrame:
    """Best files first with explanation, extraction status and duplicate flag.

    All joins are left joins on unique keys, so the limit is taken first and
    the wide joins see only the listed rows.
    """
    order = [F.coalesce("importance_score", F.lit(0.0)).desc(), F.col("file_id")]
    top = (
        files.join(scores.select("file_id", "importance_score", "label"), "file_id", "left")
        .orderBy(*order).limit(limit)
    )
    listed = redundancy.select(F.explode(F.array("path_1", "path_2")).alias("path"), "avg_similarity")
    listed = (
        listed.join(F.broadcast(top.select("path")), "path", "left_semi")
        .groupBy("path").agg(F.max("avg_similarity").alias("_sim"))
    )
    return (
        top.join(_of(explanations, top, EXPLANATION_PART), "file_id", "left")
        .join(_of(content, top, ("extraction_status",)), "file_id", "left")
        .join(listed, "path", "left")
        .withColumns({
            "is_duplicate": F.col("_sim").isNotNull(),
            "duplicate_similarity": F.round(F.coalesce("_sim", F.lit(0.0)) * 100, 0),
        })
        .drop("_sim").orderBy(*order)
    )


def text_preview(content: DataFrame, chunks: DataFrame, chars: int = 320) -> DataFrame:
    """(file_id, preview): extracted text if successful, else the first good chunk."""
    head = tx.strip(F.substring(tx.strip(F.col("extracted_text")), 1, chars))
    extracted = content.select(
        "file_id", F.when((F.col("extraction_status") == "SUCCESS") & (head != ""), head).alias("_text"))
    good = chunks.filter("clean_status = 'SUCCESS' AND clean_text IS NOT NULL")
    # only the head of each chunk enters the aggregate
    first = good.groupBy("file_id").agg(
        F.min_by(F.substring(tx.strip(F.col("clean_text")), 1, chars), F.col("chunk_index")).alias("_chunk"))
    return extracted.join(first, "file_id", "full").select(
        "file_id", F.coalesce("_text", "_chunk", F.lit("")).alias("preview"))


def file_detail(
    files: DataFrame, scores: DataFrame, explanations: DataFrame, content: DataFrame,
    chunks: DataFrame, file_id: int,
) -> DataFrame:
    """One file with everything known about it; the id filter reaches every scan."""
    one = F.col("file_id") == file_id
    return (
        files.filter(one)
        .join(scores.filter(one).select("file_id", "importance_score", "label"), "file_id", "left")
        .join(explanations.filter(one).select("file_id", *EXPLANATION_PART), "file_id", "left")
        .join(content.filter(one).select("file_id", "extraction_status"), "file_id", "left")
        .join(text_preview(content.filter(one), chunks.filter(one)), "file_id", "left")
        .fillna({"preview": ""})
    )


def review_queue(
    files: DataFrame, scores: DataFrame, explanations: DataFrame, content: DataFrame, limit: int = 200
) -> DataFrame:
    """Files to review, lowest score first."""
    waiting = scores.filter(F.col("label").isin("REVIEW", "DELETE_CANDIDATE"))
    order = [F.col("importance_score"), F.col("file_id")]
    top = (
        files.join(waiting.select("file_id", "importance_score", "label"), "file_id")
        .orderBy(*order).limit(limit)
    )
    return (
        top.join(_of(explanations, top, EXPLANATION_PART), "file_id", "left")
        .join(_of(content, top, ("extraction_status",)), "file_id", "left")
        .orderBy(*order)
    )


def top_chunk_excerpt(chunks: DataFrame, n: int = 3) -> DataFrame:
    """(file_id, excerpt): the first n good chunks joined by a space."""
    good = chunks.filter("clean_status = 'SUCCESS' AND clean_text IS NOT NULL AND clean_text <> ''")
    first = top_per_key(good.select("file_id", "chunk_index", "clean_text"), "file_id", n, F.col("chunk_index"))
    ordered = F.array_sort(F.collect_list(F.struct("chunk_index", "clean_text")))  # at most n entries
    return first.groupBy("file_id").agg(
        F.array_join(F.transform(ordered, lambda c: c["clean_text"]), " ").alias("excerpt"))


def first_chunk_per_file(chunks: DataFrame, chars: int = 1000) -> DataFrame:
    """(file_id, preview): head of the first good chunk."""
    return (
        chunks.filter("clean_status = 'SUCCESS'").groupBy("file_id")
        .agg(F.min_by(F.substring("clean_text", 1, chars), F.col("chunk_index")).alias("preview"))
    )


def best_hit_per_file(hits: DataFrame, per: tuple[str, ...] = ()) -> DataFrame:
    """One row per file out of chunk hits: the best chunk, relevance to 3 decimals.

    Hits need file_id, chunk_id, score, clean_text; ``per`` adds grouping
    columns such as a query id.
    """
    picked = hits.groupBy(*per, "file_id").agg(
        F.max("score").alias("score"),
        F.min_by(F.struct("chunk_id", "clean_text"), F.struct(-F.col("score"), F.col("chunk_id"))).alias("_hit"),
    )
    return picked.select(
        *per, "file_id", F.col("_hit.chunk_id").alias("chunk_id"),
        F.round("score", 3).alias("relevance"), tx.snippet(F.col("_hit.clean_text")).alias("snippet"))


def search_files(
    vectors: DataFrame, meta: DataFrame, files: DataFrame, scores: DataFrame, explanations: DataFrame,
    query_vec: list[float], limit: int = 30, filters: dict | None = None,
) -> DataFrame:
    """Files of the best chunks with scores and explanations, most relevant first.

    The limit counts chunks, so fewer files may come back.
    """
    hits = vec.semantic_search(vectors, meta, query_vec, limit, filters)
    found = best_hit_per_file(hits)
    return (
        found.join(files, "file_id")
        .join(scores.select("file_id", "importance_score", "label"), "file_id", "left")
        .join(explanations.select("file_id", "explanation_text", "counterfactual_tip", "confidence"),
              "file_id", "left")
        .orderBy(F.desc("relevance"), "file_id")
    )


def session_history(messages: DataFrame, n: int = 20) -> DataFrame:
    """The last n messages of every session, oldest first within the session."""
    last = top_per_key(messages, "session_id", n, F.desc("message_id"))
    return last.select(
        "session_id", "message_id", "role", "content",
        (F.count("*").over(W.partitionBy("session_id")) - F.col("rank") + 1).alias("position"))


def retrieval_context(hits: DataFrame, files: DataFrame, scores: DataFrame, chunks: DataFrame,
                      questions: DataFrame) -> DataFrame:
    """(query_id, context): one line per retrieved file, with a short preview.

    Hits carry query_id, file_id, relevance; a question has at most its top-k
    files, so the ordered list per question is bounded.  Lines are made per file
    and joined once, so a file found by very many questions can be split.
    """
    preview = F.substring(F.coalesce("preview", F.lit("")), 1, 200)
    line = F.concat(
        F.lit("- "), F.col("name"), F.lit(" | label="), F.coalesce("label", F.lit("None")),
        F.lit(" | score="), F.coalesce(F.col("importance_score").cast("string"), F.lit("None")),
        F.when(preview != "", F.concat(F.lit("\n  Preview: "), preview)).otherwise(""),
    )
    facts = (
        files.select("file_id", "name")
        .join(scores.select("file_id", "importance_score", "label"), "file_id", "left")
        .join(first_chunk_per_file(chunks), "file_id", "left")
    )
    lines = hits.join(written(facts.select("file_id", line.alias("line")), "file-lines"), "file_id").select(
        "query_id", F.struct((-F.col("relevance")).alias("r"), "file_id", "line").alias("e"))
    texts = lines.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["line"]), "\n").alias("context"))
    return questions.select("query_id").join(texts, "query_id", "left").fillna(
        {"context": "No matching files were found."})
