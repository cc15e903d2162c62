"""Corpus stages derived from the supplied tables.

Each property is one stage of the governance run; costly stages are written to
the shared folder once per session and read back, as a scheduled run would.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.storage import temporary, written
from ..operators import chunk, cluster, dedup, explain, extract, inventory, language, model, score, vectors

AS_OF = "2026-01-01 00:00:00"
PAIR_THRESHOLD = 0.35  # the supplied vectors are near random; none reach 0.7
CLUSTER_EPS = 0.65

# extension given to document number i: element i mod 16
EXTENSIONS = (".pdf .docx .txt .xlsx .csv .md .py .json .pptx .png .zip .pem .html .tmp .log .xyz").split()

#: Rows of a text task where a table has to be spread.
TEXTS = 8192

_OPEN: dict[tuple[str, str], "Corpus"] = {}


def corpus(spark: SparkSession, sf_dir: str) -> "Corpus":
    """The corpus of a table folder, shared by all queries of one application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _OPEN:
        _OPEN[key] = Corpus(spark, sf_dir)
    return _OPEN[key]


def _days(base: str, days: Column) -> Column:
    return F.lit(base).cast("timestamp_ntz") + F.make_dt_interval(days.cast("int"))


class Corpus:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._forests = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def texts(self, name: str) -> DataFrame:
        """A text table; one that does not fill the cores by itself is spread over tasks of ``TEXTS`` rows.

        Text work is CPU-bound.  Spark cuts files by bytes but reads a row group
        as a whole, so a large file of one row group has many partitions and all
        rows in one.  A table that is even already is left as it is.
        """
        rows = self.table(name)
        cores = self.spark.sparkContext.defaultParallelism
        if rows.rdd.getNumPartitions() < cores:
            return rows.repartition(max(cores, -(-rows.count() // TEXTS)))
        # the partitions follow the files, so those of the bare scan are those of the text
        held = rows.groupBy(F.spark_partition_id()).count().agg(F.max("count").alias("most"), F.sum("count").alias("all")).first()
        uneven = held["most"] is not None and held["most"] > max(TEXTS, 2 * -(-held["all"] // cores))
        return rows.repartition(max(cores, -(-held["all"] // TEXTS))) if uneven else rows

    # --- inventory -----------------------------------------------------------
    def _listed(self, documents: DataFrame) -> DataFrame:
        """Documents as scanned files; the text stays alongside until pruned."""
        d = F.col("doc_id")
        ext = F.element_at(F.array(*[F.lit(e) for e in EXTENSIONS]), (d % len(EXTENSIONS) + 1).cast("int"))
        modified = _days("2020-01-01 00:00:00", (d * 37) % 2190)
        return documents.select(
            d.alias("file_id"),
            F.concat(F.lit("/root/"), "source", F.lit("/"), "lang", F.lit("/doc_"), d.cast("string"), ext).alias("path"),
            F.when(d % 97 == 0, F.lit(0)).otherwise(F.octet_length("text")).cast("long").alias("size_bytes"),
            F.when(d % 89 == 0, "error_locked").otherwise(F.sha2(F.col("text").cast("binary"), 256)).alias("hash"),
            modified.alias("created_time"), modified.alias("modified_time"),
            F.when(d % 11 != 0, modified + F.make_dt_interval((d % 50).cast("int"))).alias("access_time"),
            F.lit("").alias("source_archive"), "text", "lang",
        )

    @property
    def raw_files(self) -> DataFrame:
        return self._listed(self.table("documents")).drop("text", "lang")

    @cached_property
    def all_files(self) -> DataFrame:
        return written(inventory.inventory_row(self.raw_files), "files")

    @property
    def files(self) -> DataFrame:
        return inventory.quarantine_split(self.all_files)[0]

    # --- extraction ----------------------------------------------------------
    @property
    def raw_content(self) -> DataFrame:
        """What the extractors would have read: text, method and language per file."""
        listed = inventory.inventory_row(self._listed(self.texts("documents")))
        d = F.col("file_id")
        return extract.extraction_route(listed).select(
            d.alias("id"), d, "path", "extension", "category", "is_empty", "source_archive", "hash",
            F.col("text").alias("extracted_text"),
            F.when(F.col("route") == "skip", "SKIPPED").when(F.col("extension") == ".png", "tesseract_ocr")
            .otherwise("plain_text_read").alias("extraction_method"),
            F.when(d % 5 == 0, "").otherwise(F.col("lang")).alias("language_hint"),
            F.col("status").alias("phase1_status"),
        )

    @cached_property
    def all_content(self) -> DataFrame:
        return written(extract.extract_content(self.raw_content), "content")

    @property
    def content(self) -> DataFrame:
        return self._kept(self.all_content)

    @staticmethod
    def _kept(all_content: DataFrame) -> DataFrame:
        return extract.extraction_filter(inventory.quarantine_split(all_content)[0])[0]

    @cached_property
    def languages(self) -> language.LanguageModel:
        return language.fit(self.texts("documents"))

    @cached_property
    def chunks(self) -> DataFrame:
        return written(chunk.chunk_documents(self.content), "chunks")

    @property
    def chunk_paths(self) -> DataFrame:
        return self.chunks.join(self.files.select("file_id", "path"), "file_id").select(
            "chunk_id", "file_id", "path", "clean_status")

    # --- vectors -------------------------------------------------------------
    @property
    def vectors(self) -> DataFrame:
        """The supplied vectors as two chunk vectors per file."""
        v = F.col("vec_id")
        file_id = F.floor(v / 2).cast("long")
        return self.table("embeddings").select(
            F.concat_ws("_", file_id, v % 2).alias("chunk_id"), file_id.alias("file_id"),
            F.col("embedding").alias("vector"),
        )

    @property
    def vector_paths(self) -> DataFrame:
        return self.vectors.join(self.files.select("file_id", "path"), "file_id").select("chunk_id", "path")

    @property
    def search_meta(self) -> DataFrame:
        texts = self.chunks.select("chunk_id", "clean_text")
        languages = self.content.select("file_id", F.col("language_hint").alias("language"))
        return (
            self.vectors.select("chunk_id", "file_id").join(self.files, "file_id")
            .join(languages, "file_id", "left").join(texts, "chunk_id", "left")
            .select("chunk_id", "file_id", "language", "extension", "category", "name", "folder", "path",
                    "source_archive", "created_time", "modified_time", "clean_text")
        )

    @property
    def query_vector(self) -> list[float]:
        """A sample search vector: the supplied vector with the smallest id."""
        return self.table("embeddings").orderBy("vec_id").first()["embedding"]

    @cached_property
    def text_vectors(self) -> DataFrame:
        """Vectors of all chunks; texts and chunks that no query has asked for by now are deleted when these are written."""
        def embedded(chunks: DataFrame) -> DataFrame:
            good = chunks.filter("clean_status = 'SUCCESS'").select("chunk_id", "file_id", "clean_text")
            return written(vectors.embed_text(good, max_chars=None).select("chunk_id", "file_id", "vector"), "text-vectors")

        if "chunks" in self.__dict__:
            return embedded(self.chunks)
        with temporary(self.spark) as paths:
            texts = self.__dict__.get("all_content")
            texts = written(extract.extract_content(self.raw_content), "content") if texts is None else texts
            found = embedded(written(chunk.chunk_documents(self._kept(texts)), "chunks"))
            paths.pop()  # the vectors stay
        return found

    @property
    def file_vectors(self) -> DataFrame:
        return vectors.file_embedding_mean(self.vectors)

    # --- duplicates ----------------------------------------------------------
    @cached_property
    def pairs(self) -> DataFrame:
        return written(vectors.near_duplicate_pairs(self.vectors, PAIR_THRESHOLD), "duplicate-chunks")

    @property
    def sections(self) -> DataFrame:
        repeated = self.vector_paths.groupBy("chunk_id").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count()
        if repeated:  # every row of a chunk's path gives one of the pair
            return dedup.chunk_to_path_map(self.pairs, self.vector_paths)
        named = dedup.with_path(self.vectors.select("chunk_id", "vector"), self.vector_paths)
        return dedup.chunk_to_path_map(vectors.near_duplicate_pairs(named, PAIR_THRESHOLD))

    @cached_property
    def distinct_vectors(self) -> DataFrame:
        return written(vectors.distinct_vectors(self.vectors), "distinct-vectors")

    @cached_property
    def redundancy(self) -> DataFrame:
        return written(dedup.vector_redundancy(
            self.strict_class_files, self.distinct_vectors, self.vector_paths, PAIR_THRESHOLD, 0.40), "file-redundancy")

    @cached_property
    def strict_class_files(self) -> DataFrame:
        """The stored form of file pairs at the default thresholds."""
        return written(dedup.class_files(vectors.class_members(self.vectors), self.vector_paths), "class-files")

    @cached_property
    def strict_class_links(self) -> DataFrame:
        pairs = vectors.near_duplicate_pairs(self.vectors, dedup.PAIR_THRESHOLD)
        return written(dedup.class_links(pairs, self.strict_class_files), "class-links")

    @property
    def strict_dup_paths(self) -> DataFrame:
        return dedup.class_duplicate_paths(
            self.duplicate_files, self.strict_class_files, self.strict_class_links, self.vector_paths)

    @property
    def chunked_files(self) -> DataFrame:
        """Files that reached chunking; duplicates are looked for among these."""
        return self.files.join(self.chunks.select("file_id"), "file_id", "left_semi")

    @property
    def duplicate_files(self) -> DataFrame:
        return dedup.exact_duplicate_pairs(self.chunked_files)

    @cached_property
    def dup_paths(self) -> DataFrame:
        """Paths of the file pairs of ``redundancy`` that are marked, and of exact duplicates."""
        return written(dedup.averaged_duplicate_paths(
            self.duplicate_files, self.strict_class_files, self.distinct_vectors, PAIR_THRESHOLD, 0.40), "duplicate-paths")

    @cached_property
    def clusters(self) -> DataFrame:
        return written(cluster.dbscan_cluster(self.file_vectors, CLUSTER_EPS), "clusters")

    # --- scores --------------------------------------------------------------
    @cached_property
    def score_input(self) -> DataFrame:
        return written(score.score_input_join(self.files, self.content, self.chunks), "score-input")

    @cached_property
    def signals(self) -> DataFrame:
        rows = score.signals(
            self.files, self.content, self.chunks, self.dup_paths, self.file_vectors, self.clusters, AS_OF)
        return written(rows, "signals")

    @cached_property
    def scores(self) -> DataFrame:
        return written(score.file_scores(self.signals), "file-scores")

    @property
    def attributed(self) -> DataFrame:
        return model.decision_confidence(model.attribution_proxy(self.scores), None)

    @cached_property
    def explanations(self) -> DataFrame:
        return written(explain.build_explanations(self.attributed), "file-explanations")

    def forest(self, trees: int = model.TREES, depth: int = model.DEPTH):
        key = (trees, depth)
        if key not in self._forests:
            rows = score.boot_label(score.boot_score(self.signals))
            self._forests[key] = model.train_importance_model(rows, "boot_label", trees, depth)
        return self._forests[key]

    # --- people --------------------------------------------------------------
    @property
    def feedback(self) -> DataFrame:
        """Labels as human decisions; every sixth file got a second, later one."""
        d = F.col("doc_id")
        label = (
            F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "KEEP")
            .when((F.col("quality") == 1) & (F.col("toxic") == 1), "REVIEW")
            .when((F.col("quality") == 0) & (F.col("toxic") == 0), "ARCHIVE")
            .otherwise("DELETE_CANDIDATE")
        )
        base = self.table("labels").join(
            self.scores.select(F.col("file_id").alias("doc_id"), F.col("label").alias("predicted_label")), "doc_id"
        ).select(
            (d * 2).alias("feedback_id"), d.alias("file_id"), "predicted_label", label.alias("human_label"),
            F.when(d % 10 == 0, F.lit(2)).when(d % 10 != 1, F.lit(4)).alias("reviewer_confidence"),
            F.when(d % 23 == 0, F.lit(3)).when(d % 7 != 0, F.lit(0)).alias("training_attempts"),
            (d % 3 == 0).alias("used_in_train"), F.lit(None).cast("int").alias("promoted_in_version"),
            (F.lit("2025-01-01 00:00:00").cast("timestamp_ntz")
             + F.make_dt_interval(F.lit(0), d.cast("int"))).alias("created_at"),
        )
        second = base.filter("file_id % 6 = 0").withColumns({
            "feedback_id": F.col("feedback_id") + 1,
            "human_label": F.when(F.col("human_label") == "KEEP", "ARCHIVE").otherwise(F.col("human_label")),
            "reviewer_confidence": F.lit(5),
            "created_at": F.col("created_at") + F.make_dt_interval(F.lit(400)),
        })
        return base.unionByName(second)

    @property
    def actions(self) -> DataFrame:
        e = F.col("event_id")
        documents = self.table("documents").agg(F.count("*")).scalar()
        verb = F.element_at(F.array(*[F.lit(a) for a in ("KEEP", "ARCHIVE", "DELETE", "REVIEWED")]),
                            (e % 4 + 1).cast("int"))
        return self.table("events").select(
            "event_id", (e % documents).alias("file_id"), verb.alias("action"),
            F.col("user_id").cast("string").alias("actor"), "ts")

    @property
    def messages(self) -> DataFrame:
        return self.table("conversations").select(
            F.col("conv_id").alias("session_id"), F.col("turn").alias("message_id"), "role",
            F.col("text").alias("content"))

    @property
    def questions(self) -> DataFrame:
        asked = self.texts("conversations").filter("role = 'user'").select(
            F.concat_ws("_", "conv_id", "turn").alias("query_id"), "text")
        return vectors.embed_text(asked, "text", max_chars=None).select("query_id", "vector")

    @property
    def versions(self) -> DataFrame:
        i = F.col("item_id")
        return self.table("benchmark").select(
            (i + 1).alias("version"), (i % 3 == 0).alias("promoted"),
            F.round(F.lit(0.4) + ((i * 37) % 50) / F.lit(100.0), 2).alias("gate_score"),
            _days("2025-01-01 00:00:00", i).alias("trained_at"))
