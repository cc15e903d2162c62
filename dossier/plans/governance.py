"""A whole governance run, and a retraining round, over a user's own tables.

Every stage is written below ``out`` and read back by the next, so a later
stage never repeats an earlier one and a run can be inspected table by table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import fixed, text
from ..functions.storage import temporary
from ..operators import chunk, cluster, dedup, explain, extract, feedback, inventory, language, model, report, score, vectors
from ..operators.forest import Forest
from ..sources import tables


class Stages:
    """Named tables below one folder."""

    def __init__(self, spark: SparkSession, out: str):
        self.spark, self.out = spark, out.rstrip("/")

    def save(self, name: str, frame: DataFrame) -> DataFrame:
        frame.write.mode("overwrite").parquet(f"{self.out}/{name}")
        return self.load(name, frame.schema)

    def load(self, name: str, schema=None) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(f"{self.out}/{name}")

    def report(self, name: str, frame: DataFrame) -> None:
        tables.write_report_json(frame, f"{self.out}/reports/{name}")


def prepare(
    stages: Stages, files: DataFrame, texts: DataFrame, root: str = "", mapping: DataFrame | None = None,
    languages: language.LanguageModel | None = None,
) -> dict[str, DataFrame]:
    """Inventory, extraction outcome and chunks.

    ``files``: file_id, path, size_bytes, hash, created/modified/access_time,
    source_archive.  ``texts``: file_id, extracted_text, extraction_method and,
    if known, language_hint.
    """
    detect = text.detect_language if languages is None else language.detector(languages, stages.spark)
    listed = stages.save("files_all", inventory.inventory_row(files, root, mapping))
    kept, held = inventory.quarantine_split(listed)
    facts = kept.select("file_id", "extension", "category", "is_empty", "source_archive", "hash",
                        F.col("status").alias("phase1_status"))
    raw = texts.join(facts, "file_id").withColumn("id", F.col("file_id"))
    classified = stages.save("content_all", extract.extract_content(raw, detect=detect))
    content, refused = extract.extraction_filter(classified)
    cleaned = stages.save("content_clean", chunk.reuse_clean_by_hash(content))
    chunks = stages.save("chunks", chunk.chunk_documents(cleaned, detect=detect))
    stages.report("inventory", inventory.inventory_summary(listed))
    stages.report("extraction", extract.extraction_summary(classified))
    stages.report("cleaning", chunk.clean_summary(content, chunks))
    return {"files": kept, "files_quarantined": held, "content": content, "content_quarantined": refused,
            "chunks": chunks}


def find_duplicates(
    stages: Stages, files: DataFrame, chunks: DataFrame, chunk_vectors: DataFrame,
    pair_threshold: float = dedup.PAIR_THRESHOLD, file_threshold: float = dedup.FILE_DUP_THRESHOLD,
    method: str = "exact", all_pairs: bool = False,
) -> dict[str, DataFrame]:
    """Exact and near duplicates of the chunked files.

    Stored are files per class of equal vectors and links between classes, which
    grow with the chunks; ``dedup.redundancy_of_paths`` lists the pairs of given
    files from them.  ``all_pairs`` writes the whole pair table and the
    recommendations as well, which grow with the square of the files that
    share a chunk.
    """
    paths = chunks.select("chunk_id", "file_id").join(files.select("file_id", "path", "hash"), "file_id")
    exact = stages.save("duplicate_files", dedup.exact_duplicate_pairs(paths))
    pairs = stages.save("duplicate_chunks", vectors.near_duplicate_pairs(chunk_vectors, pair_threshold, method))
    held = stages.save("duplicate_class_files", dedup.class_files(vectors.class_members(chunk_vectors), paths))
    links = stages.save("duplicate_class_links", dedup.class_links(pairs, held))
    marked = stages.save("duplicate_paths", dedup.class_duplicate_paths(
        exact, held, links, paths, pair_threshold, file_threshold))
    found = {"duplicate_files": exact, "duplicate_chunks": pairs, "duplicate_class_files": held, "duplicate_class_links": links,
             "duplicate_paths": marked}
    if all_pairs:
        sections = stages.save("redundant_sections", dedup.chunk_to_path_map(pairs, paths))
        redundancy = stages.save("file_redundancy", dedup.expanded_redundancy(held, links, paths, file_threshold))
        advice = stages.save("merge_recommendations", dedup.recommendations(exact, redundancy, file_threshold))
        stages.report("duplicates", dedup.duplicates_summary(exact, sections, redundancy))
        found |= {"redundant_sections": sections, "file_redundancy": redundancy, "merge_recommendations": advice}
    return found


def score_files(
    stages: Stages, files: DataFrame, content: DataFrame, chunks: DataFrame, chunk_vectors: DataFrame,
    duplicates: dict[str, DataFrame], as_of: str, eps: float = 0.3,
    deployed: Forest | None = None, ratings: DataFrame | None = None,
    trees: int = model.TREES, depth: int = model.DEPTH,
) -> tuple[DataFrame, Forest]:
    """Signals, model scores and labels; a forest is trained when none is deployed."""
    file_vectors = stages.save("file_vectors", vectors.file_embedding_mean(chunk_vectors))
    clusters = stages.save("clusters", cluster.dbscan_cluster(file_vectors, eps))
    signals = stages.save("signals", score.signals(
        files, content, chunks, duplicates["duplicate_paths"], file_vectors, clusters, as_of, ratings))
    if deployed is None:
        deployed = model.train_importance_model(
            score.boot_label(score.boot_score(signals)), "boot_label", trees, depth)
        deployed.save(stages.spark, f"{stages.out}/models/initial")
    rated = model.score_with_model(signals, deployed).select(
        "file_id", "path", "name", F.col("extension").alias("ext"), "category", *fixed.SIGNALS,
        "importance_score", "label", "confidence")
    scores = stages.save("file_scores", rated)
    stages.report("scores", score.score_distribution(scores))
    stages.report("labels", score.label_counts(scores))
    stages.report("top_bottom", score.top_bottom_files(scores))
    stages.report("feature_importance", model.feature_importance(deployed, scores))
    return scores, deployed


def explain_files(
    stages: Stages, scores: DataFrame, deployed: Forest | None,
) -> DataFrame:
    """Explanation records of scored files (with ``confidence``)."""
    attributed = model.attributions(scores, deployed)
    explanations = stages.save("file_explanations", explain.build_explanations(attributed))
    stages.report("explanations", explain.explanation_report(explanations))
    return explanations


def run(
    spark: SparkSession, files: DataFrame, texts: DataFrame, out: str, as_of: str, root: str = "",
    embed: Callable[[DataFrame], DataFrame] = vectors.embed_text, trees: int = model.TREES,
    depth: int = model.DEPTH, pair_threshold: float = dedup.PAIR_THRESHOLD, eps: float = 0.3,
    pair_method: str = "exact", mapping: DataFrame | None = None, all_pairs: bool = False,
    languages: language.LanguageModel | None = None,
) -> dict[str, DataFrame]:
    """Files and texts in, every result table out.

    ``mapping`` (extension, category) adds to the built-in extension list;
    ``pair_method`` chooses the near-duplicate search; ``all_pairs`` writes all
    pairs of files, see ``find_duplicates``.  Without it ``duplicates_found``
    counts the files that have a duplicate instead of the pairs.  ``languages`` is a
    fitted ``language.LanguageModel``; without one, function words decide.
    """
    stages = Stages(spark, out)
    with temporary(spark):
        base = prepare(stages, files, texts, root, mapping, languages)
        good = base["chunks"].filter("clean_status = 'SUCCESS'").select("chunk_id", "file_id", "clean_text")
        chunk_vectors = stages.save("chunk_vectors", embed(good).select("chunk_id", "file_id", "vector"))
        duplicates = find_duplicates(
            stages, base["files"], base["chunks"], chunk_vectors, pair_threshold, method=pair_method,
            all_pairs=all_pairs)
        scores, deployed = score_files(
            stages, base["files"], base["content"], base["chunks"], chunk_vectors, duplicates, as_of, eps,
            trees=trees, depth=depth)
        explanations = explain_files(stages, scores, deployed)
        stages.report("kpis", report.kpis(
            base["files"], scores, duplicates["file_redundancy" if all_pairs else "duplicate_paths"]))
        return {**base, **duplicates, "chunk_vectors": chunk_vectors, "file_scores": scores,
                "file_explanations": explanations}


def retrain(
    spark: SparkSession, out: str, feedback_rows: DataFrame, scores: DataFrame, files: DataFrame,
    versions: DataFrame, deployed: Forest | None = None,
    threshold: int = feedback.RETRAIN_AT, force: bool = False, trees: int = model.TREES, depth: int = model.DEPTH,
) -> dict:
    """One retraining round: gates, training, comparison on the holdout, version log.

    Returns ``promoted``, ``reason``, the model when one was trained, and the
    new ``versions`` and ``feedback`` tables.  The deployed model is rescored on
    the same holdout rather than trusting its logged score.
    """
    stages = Stages(spark, out)
    usable = stages.save("usable_feedback", feedback.feedback_training_join(
        feedback.usable_feedback(feedback_rows), scores, files))
    n = usable.count()
    unchanged = {"promoted": False, "model": None, "versions": versions, "feedback": feedback_rows}
    if n < threshold:
        return {**unchanged, "reason": f"Need >= {threshold} usable feedback rows, have {n}."}
    short = feedback.class_balance_check(usable).collect()  # at most one row per label
    if short:
        named = {r["human_label"]: r["examples"] for r in short}
        return {**unchanged, "reason": f"Too few examples per class (need >= {feedback.MIN_CLASS} each): {named}."}
    split = stages.save("training_split", feedback.stratified_split(usable))
    held = split.filter("is_holdout")
    candidate = model.train_candidate(split.filter("NOT is_holdout"), "human_label", trees, depth)

    def judged(forest) -> DataFrame:
        return model.score_with_model(held.drop("label"), forest).select("human_label", F.col("label").alias("predicted"))

    candidate_rows = judged(candidate)
    new = feedback.gate_score(candidate_rows, "human_label", "predicted")
    old = None if deployed is None else feedback.gate_score(judged(deployed), "human_label", "predicted")
    decision = stages.save("promotion", feedback.promotion_decision(new, old, force=force))
    quality = feedback.classification_report(candidate_rows, "human_label", "predicted")
    folder = F.concat(F.lit(f"{stages.out}/models/v"), F.col("version").cast("string"))
    row = feedback.model_version_row(versions, decision, "", quality, usable).withColumn("model_path", folder)
    row = stages.save("new_version", row.withColumn("trained_at", F.current_timestamp().cast("timestamp_ntz")))
    made = row.first()
    candidate.save(spark, f"{stages.out}/models/v{made['version']}")
    stages.report("classification", quality)
    stages.report("disagreement", feedback.disagreement_rate(usable))
    return {
        "promoted": made["promoted"], "reason": made["notes"], "model": candidate,
        "versions": versions.unionByName(row, allowMissingColumns=True),
        "feedback": feedback.mark_feedback_used(feedback_rows, usable, made["version"], made["promoted"]),
    }
