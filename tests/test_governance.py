"""A whole run and a retraining round on the smallest tables."""

import pytest
from pyspark.sql import functions as F

from dossier.operators import dedup
from dossier.plans import governance
from dossier.plans.corpus import AS_OF, corpus

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def result(spark, tmp_path_factory):
    data = corpus(spark, SF)
    texts = data.raw_content.select("file_id", "extracted_text", "extraction_method", "language_hint")
    out = str(tmp_path_factory.mktemp("run"))
    return out, governance.run(spark, data.raw_files, texts, out, AS_OF, root="/root", trees=5, depth=5)


def test_every_kept_file_is_scored_and_explained(result):
    _, tables = result
    files = tables["files"].count()
    assert tables["file_scores"].count() == tables["file_explanations"].count() == files
    assert tables["file_scores"].filter("importance_score < 0 OR importance_score > 100").count() == 0


def test_the_run_agrees_with_the_single_steps(spark, result):
    _, tables = result
    data = corpus(spark, SF)
    for name, want in (("duplicate_files", data.duplicate_files), ("chunks", data.chunks)):
        assert sorted(map(str, tables[name].collect())) == sorted(map(str, want.select(*tables[name].columns).collect()))


def test_reports_are_written(spark, result):
    out, _ = result
    assert spark.read.json(f"{out}/reports/kpis").first()["total_files"] > 0
    assert {r["label"] for r in spark.read.json(f"{out}/reports/labels").collect()} >= {"TOTAL"}


def test_duplicates_are_stored_without_pairs(spark, result):
    """The pairs of given files come from the stored form, equal to the whole pair table."""
    _, tables = result
    assert "file_redundancy" not in tables
    paths = tables["chunks"].join(tables["files"].select("file_id", "path"), "file_id").select("chunk_id", "path")
    whole = dedup.expanded_redundancy(tables["duplicate_class_files"], tables["duplicate_class_links"], paths).cache()
    some = whole.select(F.col("path_1").alias("path")).distinct().orderBy("path").limit(3).cache()
    got = dedup.redundancy_of_paths(some, tables["duplicate_class_files"], tables["duplicate_class_links"], paths)
    names = [r[0] for r in some.collect()]
    want = whole.filter(F.col("path_1").isin(names) | F.col("path_2").isin(names))
    key = lambda r: (r["path_1"], r["path_2"], r["shared_chunks"], round(r["avg_similarity"], 9), r["action"])
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect())) != []
    marked = {r[0] for r in dedup.duplicate_paths(tables["duplicate_files"], whole).collect()}
    assert {r[0] for r in tables["duplicate_paths"].collect()} == marked


def retrained(spark, tmp_path, **options):
    data = corpus(spark, "/root/testdata/sf0.01")
    scores = data.scores
    versions = spark.createDataFrame([], "version long, promoted boolean, gate_score double, notes string")
    return governance.retrain(spark, str(tmp_path), data.feedback, scores, data.files, versions, trees=5, depth=5, **options)


def test_first_model_is_promoted_and_feedback_marked(spark, tmp_path):
    done = retrained(spark, tmp_path)
    assert done["promoted"], done["reason"]
    assert done["versions"].first()["version"] == 1
    marked = done["feedback"].filter("promoted_in_version = 1").count()
    assert marked == spark.read.parquet(f"{tmp_path}/usable_feedback").count() > 30


def test_too_little_feedback_changes_nothing(spark, tmp_path):
    done = retrained(spark, tmp_path, threshold=10 ** 6)
    assert not done["promoted"] and done["model"] is None and done["reason"].startswith("Need >=")


def test_a_class_with_too_few_rows_stops_training(spark, tmp_path):
    data = corpus(spark, SF)
    versions = spark.createDataFrame([], "version long, promoted boolean")
    done = governance.retrain(spark, str(tmp_path), data.feedback, data.scores, data.files, versions, threshold=1)
    assert done["reason"].startswith("Too few examples")
