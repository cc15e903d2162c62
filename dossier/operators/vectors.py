"""Vector operators: embedding, search, near duplicates, centroids."""

from __future__ import annotations

from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed, vector as vx
from ..functions.storage import written
from . import neighbours


def embed_text(
    chunks: DataFrame, text_col: str = "clean_text", dims: int = 256,
    max_chars: int | None = None,
) -> DataFrame:
    """Default embedder: hashed term counts, unit length.

    Adds ``vector`` of the whole text; ``max_chars`` stands for the input limit
    of a model, where a caller's model has one.  Any DataFrame -> DataFrame callable adding a unit vector
    can take its place.
    """
    text = F.coalesce(text_col, F.lit(""))
    if max_chars is not None:
        text = F.substring(text, 1, max_chars)
    tokens = RegexTokenizer(inputCol="_text", outputCol="_tokens", pattern=r"[^\p{L}\p{N}]+")
    counts = HashingTF(inputCol="_tokens", outputCol="_counts", numFeatures=dims)
    scaled = Normalizer(inputCol="_counts", outputCol="_unit")
    frame = scaled.transform(counts.transform(tokens.transform(chunks.withColumn("_text", text))))
    return frame.withColumn("vector", vector_to_array("_unit", "float32")).drop(
        "_text", "_tokens", "_counts", "_unit"
    )


def vector_normalize(vectors: DataFrame) -> DataFrame:
    return vectors.filter("vector IS NOT NULL").withColumn("vector", vx.unit(F.col("vector")))


METADATA_EQUAL = ("language", "extension", "category", "name", "folder", "path", "source_archive")


def metadata_predicate(
    filters: dict | None = None, created_after=None, created_before=None,
    modified_after=None, modified_before=None,
) -> Column:
    """AND of the given equality filters and inclusive time bounds."""
    filters = filters or {}
    unknown = set(filters) - set(METADATA_EQUAL)
    if unknown:
        raise ValueError(f"unknown filters: {sorted(unknown)}")
    terms = [F.col(name) == value for name, value in filters.items() if value]
    for column, low, high in (
        ("created_time", created_after, created_before),
        ("modified_time", modified_after, modified_before),
    ):
        if low:
            terms.append(F.col(column) >= F.lit(low).cast("timestamp_ntz"))
        if high:
            terms.append(F.col(column) <= F.lit(high).cast("timestamp_ntz"))
    result = F.lit(True)
    for term in terms:
        result = result & term
    return result


def metadata_filter(meta: DataFrame, filters: dict | None = None, **bounds) -> DataFrame:
    return meta.filter(metadata_predicate(filters, **bounds))


def semantic_search(
    vectors: DataFrame, meta: DataFrame, query_vec: list[float], top_k: int = 10,
    filters: dict | None = None, **bounds,
) -> DataFrame:
    """Top-k chunks by cosine among those that pass the filters, joined to their metadata."""
    scored = vectors.filter("vector IS NOT NULL").select(
        "chunk_id", vx.cosine_to(F.col("vector"), query_vec).alias("score")
    )
    best = [F.desc("score"), F.col("chunk_id")]
    filtered = bool(filters) or any(bounds.values())
    allowed = metadata_filter(meta, filters, **bounds)
    if filtered:
        scored = scored.join(allowed.select("chunk_id"), "chunk_id", "left_semi")
    hits = scored.orderBy(*best).limit(top_k)
    return hits.join(meta, "chunk_id").orderBy(*best)


def similar_chunks(
    vectors: DataFrame, chunk_id: str, threshold: float = 0.90, top_k: int = 20, meta: DataFrame | None = None
) -> DataFrame:
    """Neighbours of one chunk at or above the threshold; empty for an unknown id.

    With ``meta`` the columns of the chunks found are joined on.
    """
    anchor = vectors.filter(F.col("chunk_id") == chunk_id).select("vector").first()
    best = [F.desc("similarity_score"), F.col("chunk_id")]
    if anchor is None:
        hits = vectors.limit(0).select("chunk_id", F.lit(0.0).alias("similarity_score"))
        return hits if meta is None else hits.join(meta, "chunk_id")
    hits = (
        vectors.filter((F.col("chunk_id") != chunk_id) & F.col("vector").isNotNull())
        .select("chunk_id", vx.cosine_to(F.col("vector"), anchor["vector"]).alias("similarity_score"))
        .filter(F.col("similarity_score") >= threshold)
        .orderBy(*best).limit(top_k)
    )
    return hits if meta is None else hits.join(meta, "chunk_id").orderBy(*best)


def knn_batch_join(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """k nearest chunks for every query (query_id, vector)."""
    found = neighbours.top_k_pairs(
        queries.filter("vector IS NOT NULL").withColumnRenamed("query_id", "id"),
        vectors.filter("vector IS NOT NULL").withColumnRenamed("chunk_id", "id"), k,
    )
    return found.select("query_id", F.col("id").alias("chunk_id"), "similarity", "rank")


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """One row per distinct non-zero vector: digests, smallest id, vector, copies.

    Copies collapse in the partial aggregate, so a vector held by a third of
    all rows reaches the shuffle once per task.  Keys are two digests (128
    bits), which sort and join far more cheaply than the vectors.
    """
    usable = vectors.filter(F.exists("vector", lambda x: x != 0))
    return vx.with_digest(usable).groupBy(*vx.DIGEST).agg(
        F.min("chunk_id").alias("id"), F.count("*").alias("copies"), F.any_value("vector").alias("vector"))


def _copy_links(vectors: DataFrame, distinct: DataFrame) -> DataFrame:
    """(first id, copy) for every further copy of a vector: n-1 links, not n^2.

    Only ids and digests are shuffled.
    """
    first = distinct.filter("copies > 1").select(*vx.DIGEST, F.col("id").alias("chunk_id_1"))
    return (
        vx.with_digest(vectors).select("chunk_id", *vx.DIGEST).join(first, vx.DIGEST)
        .filter("chunk_id <> chunk_id_1")
        .select("chunk_id_1", F.col("chunk_id").alias("chunk_id_2"), F.lit(1.0).alias("similarity_score"))
    )


def class_members(vectors: DataFrame) -> DataFrame:
    """(chunk_id, class_id): the smallest id with an equal vector, for every non-zero vector.

    That id stands for its copies in ``near_duplicate_pairs``.  Ids and digests
    are written, so both sides of the join are plain shuffles.
    """
    usable = vectors.filter(F.exists("vector", lambda x: x != 0))
    ids = written(vx.with_digest(usable).select("chunk_id", *vx.DIGEST), "vector-digests")
    first = written(ids.groupBy(*vx.DIGEST).agg(F.min("chunk_id").alias("class_id")), "vector-classes")
    return ids.join(first.hint("merge"), vx.DIGEST).select("chunk_id", "class_id")


def near_duplicate_pairs(
    vectors: DataFrame, threshold: float = 0.95, method: str = "exact",
    block_rows: int = neighbours.BLOCK_ROWS, copies: str = "linked", **lsh,
) -> DataFrame:
    """Near-duplicate chunks as (chunk_id_1, chunk_id_2, similarity_score).

    Distinct vectors are compared in full, every pair at or above the threshold
    once.  ``copies`` says what is given of identical vectors: ``linked`` to
    their smallest id, which stands for all of them in the other pairs, or
    ``all``, where every copy is in every pair.  ``method`` is the caller's
    choice at every size: ``exact``, or ``lsh``, which is approximate.
    """
    if method not in ("exact", "lsh"):
        raise ValueError("method must be 'exact' or 'lsh'")
    if copies not in ("linked", "all"):
        raise ValueError("copies must be 'linked' or 'all'")
    distinct = written(distinct_vectors(vectors), "distinct-vectors")  # read several times below
    if copies == "all":
        distinct = _named_classes(distinct)
    compare = neighbours.exact_pairs if method == "exact" else neighbours.lsh_pairs
    pairs = compare(distinct.select("id", "vector"), threshold, block_rows=block_rows, **lsh).toDF(
        "chunk_id_1", "chunk_id_2", "similarity_score")
    if copies == "linked":
        return pairs.unionByName(_copy_links(vectors, distinct))
    return _with_copies(vectors, distinct, pairs)


#: Between the parts of the name of a class.
SEPARATOR = "\u0000"
#: Copies of a vector that meet as many others in a tile.
COPIES_BLOCK = 1000


def _named_classes(distinct: DataFrame) -> DataFrame:
    """Distinct vectors whose id is the name of a class of copies: smallest chunk id, digests where an id has several vectors, copies.

    The number of copies travels in the name, so pairs of vectors without
    copies need no join.
    """
    distinct = distinct.filter("id IS NOT NULL")  # no chunk of the others has an id to be named by
    repeated = distinct.groupBy("id").agg(F.count("*").alias("_n")).filter("_n > 1").limit(1).count()
    keys = [F.lpad(F.hex(d), 16, "0") for d in vx.DIGEST] if repeated else []
    return distinct.withColumn("id", F.concat_ws(SEPARATOR, "id", *keys, F.col("copies").cast("string")))


def _with_copies(vectors: DataFrame, distinct: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs of chunks from ``pairs`` of named classes: each of one class with each of the other, and all of a class.

    What leaves is as the product of the copies on both sides; a class of many
    falls into blocks, and tiles of two blocks are joined.
    """
    usable = vectors.filter(F.exists("vector", lambda x: x != 0))
    named = written(distinct.select(*vx.DIGEST, F.col("id").alias("class"), "copies"), "class-names")
    blocks = F.ceil(F.col("copies") / COPIES_BLOCK)
    members = written(
        written(vx.with_digest(usable).select("chunk_id", *vx.DIGEST).filter("chunk_id IS NOT NULL"), "vector-digests")
        .join(named.hint("merge"), vx.DIGEST)
        .select("class", F.pmod(F.xxhash64("chunk_id"), blocks).alias("block"), "chunk_id"), "class-copies")

    def held(i: int) -> Column:
        return F.substring_index(f"class_{i}", SEPARATOR, -1).cast("long")

    def blocks_of(i: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(held(i) / COPIES_BLOCK) - 1))

    links = written(pairs.toDF("class_1", "class_2", "similarity_score"), "class-pairs")
    single = (held(1) == 1) & (held(2) == 1)
    alone = links.filter(single).select(
        *[F.substring_index(f"class_{i}", SEPARATOR, 1).alias(f"chunk_id_{i}") for i in (1, 2)], "similarity_score")
    near = links.filter(~single).withColumn("block_1", blocks_of(1)).withColumn("block_2", blocks_of(2))
    own = named.filter("copies > 1").select(F.col("class").alias("class_1"), F.col("class").alias("class_2"), F.lit(1.0).alias("similarity_score"))
    own = own.withColumn("block_1", blocks_of(1)).withColumn("block_2", blocks_of(2)).filter("block_1 <= block_2")
    first, second = (members.toDF(f"class_{i}", f"block_{i}", f"_c{i}").hint("merge") for i in (1, 2))
    met = (
        written(near.unionByName(own), "class-tiles").join(first, ["class_1", "block_1"]).join(second, ["class_2", "block_2"])
        # inside a block of one class every pair is met from both sides
        .filter("class_1 <> class_2 OR block_1 < block_2 OR _c1 < _c2")
    )
    both = met.select(F.least("_c1", "_c2").alias("chunk_id_1"), F.greatest("_c1", "_c2").alias("chunk_id_2"), "similarity_score")
    return both.unionByName(alone).filter("chunk_id_1 < chunk_id_2")


def file_embedding_mean(vectors: DataFrame) -> DataFrame:
    """Element-wise mean of the chunk vectors of each file (file_id, vector).

    The mean is an aggregate with partial sums; no file's vectors are gathered.
    """
    return (
        vectors.filter("vector IS NOT NULL").groupBy("file_id")
        .agg(Summarizer.mean(array_to_vector("vector")).alias("_mean"))
        .select("file_id", vector_to_array("_mean").alias("vector"))
    )


def keep_centroid(boot: DataFrame, file_vectors: DataFrame, n: int = fixed.KEEP_CENTROID_FILES) -> DataFrame:
    """One row: normalised mean vector of the n best files by ``boot8``."""
    top = (
        boot.select("file_id", "boot8").join(file_vectors, "file_id")
        .orderBy(F.desc("boot8"), "file_id").limit(n)
    )
    mean = top.agg(Summarizer.mean(array_to_vector("vector")).alias("_mean"))
    return mean.filter("_mean IS NOT NULL").select(vx.unit(vector_to_array("_mean")).alias("vector"))


def semantic_proximity(files: DataFrame, file_vectors: DataFrame, centroid: DataFrame) -> DataFrame:
    """Add ``s_semantic_proximity``: cosine to the centroid on a 0..1 scale.

    A file without vector gets 0.5; with no vectors at all everything is 0.
    """
    target = centroid.select("vector").scalar()
    similarity = vx.cosine(F.col("vector"), F.col("_centroid"))
    clipped = F.least(F.greatest(F.coalesce(similarity, F.lit(0.0)), F.lit(-1.0)), F.lit(1.0))
    return (
        files.join(file_vectors, "file_id", "left").withColumn("_centroid", target)
        .withColumn("s_semantic_proximity",
                    F.when(F.col("_centroid").isNull(), 0.0).otherwise((clipped + 1) / 2))
        .drop("vector", "_centroid")
    )
