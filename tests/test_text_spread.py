"""Text work is spread over the tasks whatever the row groups of a table."""

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from dossier.plans import corpus


def spread(frame):
    return sorted(r["count"] for r in frame.groupBy(F.spark_partition_id()).count().collect())


def test_a_file_of_one_row_group_is_spread(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus, "TEXTS", 100)
    texts = pa.table({"doc_id": range(4000), "text": [f"{i} " * 20 for i in range(4000)]})
    pq.write_table(texts, tmp_path / "documents.parquet", row_group_size=4000, compression="none")
    size = (tmp_path / "documents.parquet").stat().st_size
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size // 12))
    try:
        c = corpus.Corpus(spark, str(tmp_path))
        assert c.table("documents").rdd.getNumPartitions() >= 8 and spread(c.table("documents")) == [4000]
        got = c.texts("documents")
        assert max(spread(got)) <= 200 and got.count() == 4000
        assert sorted(got.collect()) == sorted(c.table("documents").collect())
        pq.write_table(texts, tmp_path / "even.parquet", row_group_size=100, compression="none")
        assert "Exchange" not in c.texts("even")._jdf.queryExecution().executedPlan().toString()
        pq.write_table(texts.slice(0, 0), tmp_path / "none.parquet")
        assert c.texts("none").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_small_file_fills_the_cores(spark, tmp_path):
    pq.write_table(pa.table({"doc_id": range(400)}), tmp_path / "documents.parquet")
    assert len(spread(corpus.Corpus(spark, str(tmp_path)).texts("documents"))) == spark.sparkContext.defaultParallelism
