"""Human feedback: validation, selection, split, gate, promotion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import fixed
from .keyed import latest_per_key, rank_by_digest

# fixed values
MIN_CONFIDENCE, MAX_ATTEMPTS, MIN_CLASS, RETRAIN_AT = 3, 3, 5, 30
HOLDOUT, MIN_IMPROVEMENT = 0.2, 0.01
ACTION_LABELS = {"KEEP": "KEEP", "ARCHIVE": "ARCHIVE", "DELETE": "DELETE_CANDIDATE"}


def _tidy(name: str) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(name, F.lit("")), r"^\s+|\s+$", ""))


def validate_feedback(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected). Confidence defaults to 3 only when the column is absent."""
    if "reviewer_confidence" not in raw.columns:
        raw = raw.withColumn("reviewer_confidence", F.lit(3))
    rows = raw.withColumns({"human_label": _tidy("human_label"), "decision": _tidy("decision")})
    valid = F.col("human_label").isin(*fixed.LABELS) & F.col("decision").isin(*fixed.DECISIONS)
    return rows.filter(valid), rows.filter(~valid)


def action_label(action: Column) -> Column:
    result = F.lit(None).cast("string")
    for name, label in ACTION_LABELS.items():
        result = F.when(action == name, label).otherwise(result)
    return result


def action_to_label(actions: DataFrame, scores: DataFrame) -> DataFrame:
    """Label chosen by each action and whether it agrees with the stored prediction.

    REVIEWED carries no label and no decision; it stays for the audit trail.
    """
    predicted = scores.select("file_id", F.col("label").alias("predicted_label"),
                              F.col("importance_score").alias("predicted_score"))
    new_label = action_label(F.col("action"))
    agrees = F.coalesce(F.col("predicted_label") == F.col("new_label"), F.lit(False))
    return (
        actions.filter(F.col("action").isin("KEEP", "ARCHIVE", "DELETE", "REVIEWED"))
        .withColumn("new_label", new_label).join(predicted, "file_id", "left")
        .withColumn("decision", F.when(F.col("new_label").isNotNull(),
                                       F.when(agrees, "APPROVE").otherwise("REJECT")))
    )


def apply_actions(scores: DataFrame, actions: DataFrame) -> DataFrame:
    """Scores with the label of the latest deciding action of each file."""
    decided = actions.withColumn("_new", action_label(F.col("action"))).filter("_new IS NOT NULL")
    latest = latest_per_key(decided, "file_id", "ts", "event_id").select("file_id", "_new")
    return (
        scores.join(latest, "file_id", "left")
        .withColumn("label", F.coalesce("_new", "label")).drop("_new")
    )


def feedback_training_join(feedback: DataFrame, scores: DataFrame, files: DataFrame) -> DataFrame:
    """Feedback with signals, folder and path; rows without either are dropped."""
    return (
        feedback.join(scores.select("file_id", *fixed.SIGNALS), "file_id")
        .join(files.select("file_id", "folder", "path"), "file_id")
    )


def latest_feedback_per_file(feedback: DataFrame) -> DataFrame:
    return latest_per_key(feedback, "file_id", "created_at", "feedback_id")


def usable_feedback(feedback: DataFrame) -> DataFrame:
    """Newest row per file, then confident enough, then not tried too often."""
    latest = latest_feedback_per_file(feedback)
    return latest.filter(
        (F.coalesce("reviewer_confidence", F.lit(MIN_CONFIDENCE)) >= MIN_CONFIDENCE)
        & (F.coalesce("training_attempts", F.lit(0)) < MAX_ATTEMPTS)
    )


def class_balance_check(usable: DataFrame, minimum: int = MIN_CLASS) -> DataFrame:
    """Labels with too few examples; empty means training may go on."""
    return (
        usable.groupBy("human_label").agg(F.count("*").alias("examples"))
        .filter(F.col("examples") < minimum)
    )


def retrain_status(feedback: DataFrame, usable: DataFrame, threshold: int = RETRAIN_AT) -> DataFrame:
    new = F.count_if(~F.coalesce("used_in_train", F.lit(False)))
    return feedback.agg(new.alias("new_feedback_rows")).select(
        (F.col("new_feedback_rows") >= threshold).alias("should_retrain"), "new_feedback_rows",
        F.lit(threshold).cast("long").alias("threshold"),
        usable.agg(F.count("*")).scalar().alias("usable_labeled"),
    )


def disagreement_rate(usable: DataFrame) -> DataFrame:
    wrong = F.when(F.col("predicted_label").isNotNull(),
                   (F.col("predicted_label") != F.col("human_label")).cast("double"))
    return usable.agg(F.round(F.avg(wrong), 4).alias("disagreement_rate"))


def stratified_split(
    usable: DataFrame, label_col: str = "human_label", id_col: str = "file_id", share: float = HOLDOUT
) -> DataFrame:
    """Add ``is_holdout``: the first round(share * n) rows of each label by MD5 of the id."""
    ranked = rank_by_digest(usable, label_col, id_col)
    take = F.round(F.lit(share) * F.col("_size")).cast("long")
    return ranked.withColumn("is_holdout", F.col("_rank") <= take).drop("_rank", "_size")


def _class_stats(pred: DataFrame, truth_col: str, pred_col: str) -> DataFrame:
    """tp, fp, fn per class present in truth or prediction (at most four rows)."""
    cells = pred.groupBy(F.col(truth_col).alias("t"), F.col(pred_col).alias("p")).agg(F.count("*").alias("n"))
    sides = cells.select("t", "p", "n", F.explode(F.array_distinct(F.array("t", "p"))).alias("label"))
    hit = (F.col("t") == F.col("label")) & (F.col("p") == F.col("label"))
    stats = sides.groupBy("label").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(~hit & (F.col("p") == F.col("label")), F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when(~hit & (F.col("t") == F.col("label")), F.col("n")).otherwise(0)).alias("fn"),
    )

    def ratio(top: Column, bottom: Column) -> Column:
        return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))

    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return stats.select(
        "label", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), (tp + fn).alias("support"), "tp",
    )


def gate_score(pred: DataFrame, truth_col: str, pred_col: str) -> DataFrame:
    """One row: F1 per class weighted by the class's mean misclassification cost."""
    cost = F.lit(None).cast("double")
    for label, costs in fixed.CLASS_COSTS.items():
        cost = F.when(F.col("label") == label, F.lit(sum(costs.values()) / len(costs))).otherwise(cost)
    stats = _class_stats(pred, truth_col, pred_col).withColumn("cost", cost)
    return stats.agg((F.sum(F.col("f1") * F.col("cost")) / F.sum("cost")).alias("gate_score"))


def classification_report(pred: DataFrame, truth_col: str, pred_col: str) -> DataFrame:
    """Precision, recall, F1 and support per class, and the overall accuracy."""
    stats = _class_stats(pred, truth_col, pred_col)
    accuracy = stats.agg(F.sum("tp") / F.sum("support")).scalar()
    return stats.select("label", "precision", "recall", "f1", "support", accuracy.alias("accuracy"))


def promotion_decision(
    candidate: DataFrame, baseline: DataFrame | None, min_improvement: float = MIN_IMPROVEMENT,
    force: bool = False,
) -> DataFrame:
    """One row: scores and whether the candidate replaces the deployed model."""
    old = F.lit(0.0) if baseline is None else F.coalesce(baseline.select("gate_score").scalar(), F.lit(0.0))
    rows = candidate.select(F.col("gate_score").alias("candidate_gate_score"), old.alias("baseline_gate_score"))
    new, old = F.col("candidate_gate_score"), F.col("baseline_gate_score")
    promoted = F.lit(force) | (new >= old + min_improvement) | (old == 0.0)
    gain = f" by >= {min_improvement}."
    return rows.select(
        "*", promoted.alias("promoted"),
        F.when(promoted, F.concat(F.format_string("Candidate gate_score %.4f beat baseline %.4f", new, old), F.lit(gain)))
        .otherwise(F.concat(F.format_string("Rejected: candidate %.4f did not beat baseline %.4f", new, old),
                            F.lit(f" by {min_improvement}."))).alias("reason"),
    )


def model_version_row(
    versions: DataFrame, decision: DataFrame, model_path: str, accuracy: DataFrame, usable: DataFrame,
) -> DataFrame:
    """Next row of the version log, to be appended with ``insert_ignore``."""
    return decision.select(
        F.coalesce(versions.agg(F.max("version")).scalar() + 1, F.lit(1)).cast("long").alias("version"),
        F.lit(model_path).alias("model_path"), "promoted",
        F.col("candidate_gate_score").alias("gate_score"), "baseline_gate_score",
        accuracy.agg(F.max("accuracy")).scalar().alias("accuracy"),
        usable.agg(F.count("*")).scalar().alias("feedback_count"),
        F.col("reason").alias("notes"),
    )


def latest_promoted_model(versions: DataFrame) -> DataFrame:
    """One row: newest promoted version, its gate score, and the next version number."""
    promoted = F.when(F.col("promoted"), F.struct("trained_at", "version"))
    return versions.agg(
        F.max_by("version", promoted).alias("version"),
        F.max_by("gate_score", promoted).alias("gate_score"),
        (F.coalesce(F.max("version"), F.lit(0)) + 1).alias("next_version"),
    )


def rollback_to_version(versions: DataFrame, version: int) -> DataFrame:
    """The promoted row of that version; empty when it was never promoted."""
    return versions.filter((F.col("version") == version) & F.col("promoted"))


def mark_feedback_used(feedback: DataFrame, used: DataFrame, version: int, promoted: bool) -> DataFrame:
    """Flag the used rows; promoted ones get the version, rejected ones one more attempt."""
    marks = used.select("feedback_id").distinct().withColumn("_used", F.lit(True))
    hit = F.coalesce("_used", F.lit(False))
    rows = feedback.join(marks, "feedback_id", "left").withColumn(
        "used_in_train", F.coalesce("used_in_train", F.lit(False)) | hit
    )
    if promoted:
        rows = rows.withColumn(
            "promoted_in_version", F.when(hit, F.lit(version)).otherwise(F.col("promoted_in_version")))
    else:
        rows = rows.withColumn(
            "training_attempts",
            F.when(hit, F.coalesce("training_attempts", F.lit(0)) + 1).otherwise(F.col("training_attempts")))
    return rows.drop("_used")
