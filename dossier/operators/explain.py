"""Explanations of a decision from signal attributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed


def _ranked(strongest: bool, n: int) -> Column:
    """First n signals by attribution as structs (signal, label, value, shap).

    Strongest first breaks ties by the later signal, weakest first by the earlier.
    """
    entries = [
        F.struct(
            F.get("attribution", F.lit(i)).alias("shap"), F.lit(i).alias("position"),
            F.lit(name).alias("signal"), F.lit(fixed.SIGNAL_NAMES[i]).alias("label"),
            F.coalesce(F.col(name), F.lit(0.0)).alias("value"),
        )
        for i, name in enumerate(fixed.SIGNALS)
    ]
    return F.slice(F.sort_array(F.array(*entries), asc=not strongest), 1, n)


def top_signals(rows: DataFrame, n: int = 3) -> DataFrame:
    return rows.withColumn("top_signals", _ranked(True, n))


def weak_signals(rows: DataFrame, n: int = 4) -> DataFrame:
    return rows.withColumn("weak_signals", _ranked(False, n))


def one_decimal(x: Column) -> Column:
    """x to one decimal as printed numbers are rounded: by exact value, ties to even.

    10x is taken as 8x + 2x with the rounding error of that sum, so a score
    such as 42.45 goes the way its stored value lies.
    """
    a, b = x * 8, x * 2
    tenfold = a + b
    rest = tenfold - a
    error = (a - (tenfold - rest)) + (b - rest)
    base = F.floor(tenfold)
    part = tenfold - base
    up = (part > 0.5) | ((part == 0.5) & ((error > 0) | ((error == 0) & (base % 2 == 1))))
    return (base + F.when(up, 1).otherwise(0)) / F.lit(10.0)


def _lines(entries: Column, word: str) -> Column:
    return F.array_join(F.transform(entries, lambda s: F.concat(
        F.lit("  - "), s["label"],
        F.format_string(f": %.2f ({word}: %.3f)", F.bround(s["value"], 2), F.bround(s["shap"], 3))
    )), "\n")


# --- fixed values: the wording of the prompt and of the fallback texts ---------
def explanation_prompt(rows: DataFrame) -> DataFrame:
    """Add ``prompt`` from top_signals and weak_signals."""
    return rows.withColumn("prompt", F.concat(
        F.lit("File: "), F.coalesce("name", F.lit("unknown")),
        F.lit("\nType: "), F.coalesce("ext", F.lit("unknown")),
        F.format_string("\nScore: %.1f/100", one_decimal(F.coalesce("importance_score", F.lit(0.0)))),
        F.lit("\nDecision: "), F.coalesce("label", F.lit("REVIEW")),
        F.lit("\nTop contributing signals:\n"), _lines(F.col("top_signals"), "impact"),
        F.lit("\nWeakest signals:\n"), _lines(F.col("weak_signals"), "low impact"),
    ))


def llm_sampling_gate(rows: DataFrame, keep_percent: int = 100, delete_confidence: float = 0.55) -> DataFrame:
    """Add ``use_llm``: a repeatable share of KEEP, uncertain DELETE_CANDIDATE, no others."""
    draw = F.pmod(F.conv(F.substring(F.md5(F.col("file_id").cast("string")), 1, 8), 16, 10).cast("long"), F.lit(100))
    return rows.withColumn(
        "use_llm",
        F.when(F.col("label") == "KEEP", draw < keep_percent)
        .when(F.col("label") == "DELETE_CANDIDATE", F.col("confidence") <= delete_confidence)
        .otherwise(False),
    )


def _hint(label: Column) -> Column:
    result = F.lit("strengthen this signal")
    for name, hint in reversed(list(zip(fixed.SIGNAL_NAMES, fixed.SIGNAL_HINTS))):
        result = F.when(label == name, hint).otherwise(result)
    return result


def template_explanation(rows: DataFrame) -> DataFrame:
    """Add ``explanation_text`` and ``counterfactual_tip`` from fixed wording."""
    label, score = F.col("label"), F.coalesce("importance_score", F.lit(0.0))
    shown = F.format_string("%d", F.bround(score).cast("long"))
    kind = F.upper(F.regexp_replace(F.coalesce("ext", F.lit("")), r"^\.+", ""))
    subject = F.concat(
        F.coalesce("name", F.lit("This file")),
        F.when(kind != "", F.concat(F.lit(" ("), kind, F.lit(")"))).otherwise(""),
    )
    tier = (F.when(score >= 80, "very high").when(score >= 50, "moderate to high")
            .when(score >= 20, "low to moderate").otherwise("very low"))
    top = F.get("top_signals", F.lit(0))
    top_name = F.lower(top["label"])
    weakest = F.array_join(F.transform("weak_signals", lambda s: s["label"]), ", ")
    hints = F.array_join(F.transform(F.slice("weak_signals", 1, 3), lambda s: _hint(s["label"])), ", ")

    # --- fixed values: message texts -----------------------------------------
    delete_text = F.concat(
        subject, F.lit(" scored "), shown, F.lit("/100, indicating "), tier,
        F.lit(" value with no strong retention signals. The weakest signals were "), weakest,
        F.lit(", which held this file back. This decision is grounded in SHAP-based attribution "
              "over the nine explainability signals."),
    )
    archive_text = F.concat(
        subject, F.lit(" scored "), shown,
        F.lit("/100, suggesting it has some value but lower priority for active use. "
              "The highest contributing signals were "), top_name,
        F.lit(" and related importance factors. Review whether updating the content or recency "
              "could raise its value."),
    )
    review_text = F.concat(
        subject, F.lit(" scored "), shown,
        F.lit("/100, which places it in the uncertain range requiring human judgment. "
              "It has some useful content but also weaker signals such as "), weakest,
        F.lit(". Human review is recommended to confirm whether it should be kept or archived."),
    )
    keep_text = F.concat(
        subject, F.lit(" scored "), shown, F.lit("/100 indicating "), tier,
        F.lit(" importance to the organization. The most influential factor was "), top_name,
        F.format_string(" (value: %.2f).", F.bround(top["value"], 2)),
    )
    delete_tip = F.concat(
        F.lit("To move out of DELETE_CANDIDATE, focus on the weakest signals: "), weakest,
        F.lit(". Specifically, "), hints, F.lit("."),
    )
    archive_tip = F.lit("Accessing or updating this file would increase its recency score and may elevate it to KEEP.")
    review_tip = F.lit("To move this file to KEEP, ensure it has rich content, is recently modified, "
                       "and is not a duplicate of another file.")
    keep_tip = F.lit("Continue keeping this file accessible and up to date to maintain its high score.")

    def by_label(delete: Column, archive: Column, review: Column, keep: Column) -> Column:
        return (F.when(label == "DELETE_CANDIDATE", delete).when(label == "ARCHIVE", archive)
                .when(label == "REVIEW", review).otherwise(keep))

    return rows.withColumns({
        "explanation_text": by_label(delete_text, archive_text, review_text, keep_text),
        "counterfactual_tip": by_label(delete_tip, archive_tip, review_tip, keep_tip),
    })


EXPLANATION_COLUMNS = (
    "file_id", "path", "name", "label", "importance_score",
    *[f"top_signal_{i}{part}" for i in (1, 2, 3) for part in ("", "_value", "_shap")],
    "shap_json", "explanation_text", "counterfactual_tip", "confidence", "explanation_method",
)


def build_explanations(rows: DataFrame) -> DataFrame:
    """One record per scored file; needs ``attribution`` and ``confidence``. Narrow."""
    rows = template_explanation(weak_signals(top_signals(rows)))
    flat = {}
    for i in (1, 2, 3):
        entry = F.get("top_signals", F.lit(i - 1))
        flat[f"top_signal_{i}"] = entry["signal"]
        flat[f"top_signal_{i}_value"] = entry["value"]
        flat[f"top_signal_{i}_shap"] = entry["shap"]
    names = F.array(*[F.lit(s) for s in fixed.SIGNALS])
    return rows.withColumns({
        **flat,
        "shap_json": F.map_from_arrays(names, "attribution"),
        "explanation_method": F.lit("template"),
    }).select(*EXPLANATION_COLUMNS)


def explanations_lookup(explanations: DataFrame, ids: DataFrame) -> DataFrame:
    """Stored explanations of the given ids, best score first."""
    return (
        explanations.join(ids.select("file_id"), "file_id", "left_semi")
        .orderBy(F.desc("importance_score"), "file_id")
    )


def _title(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def explanation_fallback_view(rows: DataFrame) -> DataFrame:
    """What to show per file: stored explanation, else one built from its signals.

    Needs importance_score, label, explanation_text, counterfactual_tip,
    confidence, shap_json and top_signal_1..3 with values.
    """
    score = F.coalesce("importance_score", F.lit(0.0))
    stored = F.filter(
        F.array(*[F.struct(F.col(f"top_signal_{i}").alias("label"), F.col(f"top_signal_{i}_value").alias("value"))
                  for i in (1, 2, 3)]),
        lambda s: s["label"].isNotNull() & s["value"].isNotNull(),
    )
    # equal values: shorter names first, as stored objects order their keys
    by_value = F.transform(
        F.slice(F.array_sort(
            F.transform(F.map_entries("shap_json"), lambda e: F.struct(
                (-e["value"]).alias("v"), F.char_length(e["key"]).alias("n"), e["key"].alias("k")))
        ), 1, 3),
        lambda s: F.struct(_title(s["k"]).alias("label"), F.least(F.lit(1.0), -s["v"]).alias("value")),
    )
    empty = F.array().cast("array<struct<label:string,value:double>>")
    entries = F.when(F.size(stored) > 0, stored).otherwise(F.coalesce(by_value, empty))
    rows = rows.withColumn("_entries", entries)
    names = F.array_join(F.transform("_entries", lambda s: s["label"]), ", ")
    number = F.regexp_replace(score.cast("string"), r"\.0$", "")
    made = F.concat(
        F.lit("This file is labeled "), F.coalesce("label", F.lit("REVIEW")),
        F.lit(" with an importance score of "), number, F.lit(". The strongest signals are "), names, F.lit("."),
    )
    return rows.select(
        "file_id",
        F.when(F.coalesce("explanation_text", F.lit("")) != "", F.col("explanation_text")).otherwise(made).alias("text"),
        F.when(F.coalesce("counterfactual_tip", F.lit("")) != "", F.col("counterfactual_tip"))
        .otherwise("Use this explanation to decide whether the file should be kept, archived, or reviewed.").alias("tip"),
        F.col("_entries").alias("top3"),
        F.coalesce("confidence", F.least(F.greatest(score / 100, F.lit(0.05)), F.lit(1.0))).alias("confidence"),
        F.col("confidence").isNotNull().alias("has_real_confidence"),
    )


def explanation_report(records: DataFrame) -> DataFrame:
    """Report in long form: section, key, n, value, text.

    Sections: method, label, top_signal (five most frequent), overall, sample
    (the best-scored file of each label).
    """
    null_text = F.lit(None).cast("string").alias("text")
    null_value = F.lit(None).cast("double").alias("value")

    def section(frame: DataFrame, name: str) -> DataFrame:
        return frame.select(F.lit(name).alias("section"), "key", "n", "value", "text")

    methods = records.groupBy(F.col("explanation_method").alias("key")).agg(F.count("*").alias("n"))
    labels = records.groupBy(F.col("label").alias("key")).agg(
        F.count("*").alias("n"), F.avg("confidence").alias("value"))
    leading = (
        records.groupBy(F.col("top_signal_1").alias("key")).agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "key").limit(5)
    )
    overall = records.agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 3).alias("value"))
    first = F.struct((-F.col("importance_score")).alias("s"), F.col("file_id"))
    samples = records.groupBy(F.col("label").alias("key")).agg(
        F.min_by(F.struct("name", "importance_score", "explanation_text"), first).alias("pick"))
    return (
        section(methods.select("*", null_value, null_text), "method")
        .unionByName(section(labels.select("*", null_text), "label"))
        .unionByName(section(leading.select("*", null_value, null_text), "top_signal"))
        .unionByName(section(overall.select(F.lit("all").alias("key"), "*", null_text), "overall"))
        .unionByName(section(samples.select(
            "key", F.lit(1).cast("long").alias("n"), F.col("pick.importance_score").alias("value"),
            F.concat_ws(": ", "pick.name", "pick.explanation_text").alias("text")), "sample"))
    )
