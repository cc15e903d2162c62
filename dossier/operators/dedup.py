"""Exact and near duplicates at file level."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import vector as vx
from ..functions.storage import written
from ..functions.vector import as_matrix, unit_rows
from . import neighbours
from .keyed import top_per_key

FILE_DUP_THRESHOLD = 0.85  # fixed value
PAIR_THRESHOLD = 0.90  # fixed value
BLOCK_FILES = 1000  # files of a class in one tile


def _hashed_paths(files: DataFrame) -> DataFrame:
    usable = F.col("hash").isNotNull() & ~F.col("hash").startswith("error") & F.col("path").isNotNull()
    return files.filter(usable).select("hash", "path").distinct()


def exact_duplicate_groups(files: DataFrame) -> DataFrame:
    """Members of every hash held by more than one path: hash, copies, primary, path.

    Long form: a group of any size stays a set of rows and is never gathered.
    The groups are written before the join back; Spark splits a hot key only
    when both sides of a join come straight from a shuffle.
    """
    paths = _hashed_paths(files)
    groups = written(
        paths.groupBy("hash").agg(F.count("*").alias("copies"), F.min("path").alias("primary_path"))
        .filter("copies > 1"), "hash-groups"
    )
    return paths.join(groups, "hash").select("hash", "copies", "primary_path", "path")


def exact_duplicate_pairs(files: DataFrame) -> DataFrame:
    """Smallest path of a group paired with every other one: n-1 pairs."""
    return (
        exact_duplicate_groups(files).filter("path <> primary_path")
        .select("hash", F.col("primary_path").alias("path_1"), F.col("path").alias("path_2"))
    )


SEPARATOR = "\u0000"  # between a chunk id and its path


def with_path(vectors: DataFrame, chunk_paths: DataFrame) -> DataFrame:
    """Vectors whose ``chunk_id`` also holds the path of the chunk ('' when unknown), for ``chunk_to_path_map``.

    ``chunk_paths`` has one row per chunk.  The order of ids stays the same.
    """
    path = F.coalesce("_path", F.lit(""))
    paths = chunk_paths.select("chunk_id", F.col("path").alias("_path"))
    return vectors.join(paths, "chunk_id", "left").withColumn("chunk_id", F.concat("chunk_id", F.lit(SEPARATOR), path)).drop("_path")


def chunk_to_path_map(pairs: DataFrame, chunk_paths: DataFrame | None = None) -> DataFrame:
    """Attach paths to both ends ('' when unknown) and keep pairs across files.

    ``chunk_paths`` has one row per chunk.  Without it the ids of ``pairs`` hold
    the paths (``with_path``): then no pair is shuffled.
    """
    if chunk_paths is None:
        return pairs.select(
            *[F.substring_index(f"chunk_id_{i}", SEPARATOR, 1).alias(f"chunk_id_{i}") for i in (1, 2)],
            *[F.substring_index(f"chunk_id_{i}", SEPARATOR, -1).alias(f"path_{i}") for i in (1, 2)],
            F.col("similarity_score").alias("similarity"),
        ).filter("path_1 <> path_2")
    paths = chunk_paths.select("chunk_id", "path")
    first = paths.toDF("chunk_id_1", "_p1")
    second = paths.toDF("chunk_id_2", "_p2")
    return (
        pairs.join(first, "chunk_id_1", "left").join(second, "chunk_id_2", "left")
        .select(
            "chunk_id_1", "chunk_id_2",
            F.coalesce("_p1", F.lit("")).alias("path_1"), F.coalesce("_p2", F.lit("")).alias("path_2"),
            F.col("similarity_score").alias("similarity"),
        )
        .filter("path_1 <> path_2")
    )


def chunk_counts_per_path(chunk_paths: DataFrame) -> DataFrame:
    return chunk_paths.filter("path IS NOT NULL").groupBy("path").agg(F.count("*").alias("chunk_count"))


def file_redundancy(
    sections: DataFrame, chunk_paths: DataFrame, file_threshold: float = FILE_DUP_THRESHOLD
) -> DataFrame:
    """File pairs with their shared chunks, mean similarity, ratio and action."""
    pairs = (
        sections.select(F.least("path_1", "path_2").alias("path_1"),
                        F.greatest("path_1", "path_2").alias("path_2"), "similarity")
        .filter("path_1 <> path_2").groupBy("path_1", "path_2")
        .agg(F.count("similarity").alias("shared_chunks"), F.avg("similarity").alias("avg_similarity"))
    )
    return _rated(pairs, chunk_paths, file_threshold)


def class_files(members: DataFrame, chunk_paths: DataFrame) -> DataFrame:
    """(class_id, path, n): how many chunks of a file are in a class of equal vectors.

    With ``class_links`` this is the stored form of all chunk pairs: its rows
    follow the chunks, however many files share a class.  The path of a chunk
    without one is ''.
    """
    paths = chunk_paths.select("chunk_id", "path")
    return (
        members.join(paths, "chunk_id", "left").groupBy("class_id", F.coalesce("path", F.lit("")).alias("path"))
        .agg(F.count("*").alias("n"))
    )


def class_links(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """(class_1, class_2, similarity) between the classes of ``files``.

    ``pairs`` links the smallest ids of classes; a link of a copy to its class
    has no class as its second end and is left out.
    """
    classes = written(files.select("class_id").distinct(), "class-ids")
    first, second = (classes.select(F.col("class_id").alias(f"class_{i}")) for i in (1, 2))
    links = pairs.select(F.col("chunk_id_1").alias("class_1"), F.col("chunk_id_2").alias("class_2"),
                         F.col("similarity_score").alias("similarity"))
    return links.join(first.hint("merge"), "class_1", "left_semi").join(second.hint("merge"), "class_2", "left_semi").select(
        "class_1", "class_2", "similarity")


def _both_ways(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("class_2").alias("class_1"), F.col("class_1").alias("class_2"), "similarity"))


def linked_paths(files: DataFrame, links: DataFrame) -> DataFrame:
    """(path) of the files that share a class with another file, or have a link to one.

    These are the files of ``class_redundancy`` without its pairs.  A class
    needs only the smallest and the largest path it reaches: a file has another
    one there unless it is both.  Rows follow the chunks and links.
    """
    spans = written(files.groupBy("class_id").agg(F.min("path").alias("least"), F.max("path").alias("most")), "class-spans")
    reached = (
        _both_ways(links).join(spans.withColumnRenamed("class_id", "class_2").hint("merge"), "class_2")
        .select(F.col("class_1").alias("class_id"), "least", "most")
    )
    reach = written(spans.unionByName(reached).groupBy("class_id").agg(
        F.min("least").alias("least"), F.max("most").alias("most")), "class-reach")
    return files.join(reach.hint("merge"), "class_id").filter("least < path OR path < most").select("path").distinct()


def _shared_of(asked: DataFrame, files: DataFrame, to: DataFrame) -> DataFrame:
    """(_p1, _p2, shared_chunks, _similarity summed) of the files in ``asked`` with any other, by the steps ``to`` from class to class."""
    near = written(
        asked.select(F.col("class_id").alias("class_1"), F.col("path").alias("_p1"), F.col("n").alias("_n1"))
        .join(written(to, "class-steps").hint("merge"), "class_1").select("class_2", "_p1", "_n1", "similarity"), "asked-classes")
    met = near.join(files.select(F.col("class_id").alias("class_2"), F.col("path").alias("_p2"), F.col("n").alias("_n2")).hint("merge"),
                    "class_2").filter("_p1 <> _p2")
    chunks = F.col("_n1") * F.col("_n2")
    return met.groupBy("_p1", "_p2").agg(F.sum(chunks).alias("shared_chunks"), F.sum(chunks * F.col("similarity")).alias("_similarity"))


def redundancy_of_paths(
    paths: DataFrame, files: DataFrame, links: DataFrame, chunk_paths: DataFrame, file_threshold: float = FILE_DUP_THRESHOLD
) -> DataFrame:
    """The rows of ``class_redundancy`` that name one of ``paths`` (path).

    Only the classes of those files are expanded, so the work follows the pairs
    that are asked for.
    """
    asked = written(files.join(paths.select("path").distinct().hint("merge"), "path", "left_semi"), "asked-files")
    to = _both_ways(links).unionByName(
        asked.select(F.col("class_id").alias("class_1"), F.col("class_id").alias("class_2"), F.lit(1.0).alias("similarity")).distinct())
    shared = _shared_of(asked, files, to)
    # A pair of two files asked for is found from either.
    pairs = shared.groupBy(F.least("_p1", "_p2").alias("path_1"), F.greatest("_p1", "_p2").alias("path_2")).agg(
        F.min("shared_chunks").alias("shared_chunks"), F.min("_similarity").alias("_similarity"))
    return _rated(pairs.select("path_1", "path_2", "shared_chunks", (F.col("_similarity") / F.col("shared_chunks")).alias(
        "avg_similarity")), chunk_paths, file_threshold)


def class_redundancy(
    pairs: DataFrame, members: DataFrame, chunk_paths: DataFrame, file_threshold: float = FILE_DUP_THRESHOLD
) -> DataFrame:
    """``file_redundancy`` over all chunk pairs that ``pairs`` and the copies in ``members`` stand for.

    ``pairs`` links the smallest ids of classes of equal vectors, ``members`` has
    (chunk_id, class_id).  Two files share the product of their chunks in both
    classes of a link, so what is joined are rows per file and class, never
    pairs of copies.  A class of many files falls into blocks, and a task joins
    tiles of two blocks.  The result has a row for every pair of files that
    share a class: as the square of a class's files.
    """
    files = written(class_files(members, chunk_paths), "class-files")
    return expanded_redundancy(files, written(class_links(pairs, files), "class-links"), chunk_paths, file_threshold)


def expanded_redundancy(
    held: DataFrame, links: DataFrame, chunk_paths: DataFrame, file_threshold: float = FILE_DUP_THRESHOLD
) -> DataFrame:
    """All file pairs of the stored form (``class_files`` and ``class_links``, both written)."""
    classes = written(
        held.groupBy("class_id").agg(F.count("*").alias("files"))
        .withColumn("blocks", F.ceil(F.col("files") / BLOCK_FILES).cast("long")), "class-blocks")
    blocked = written(
        held.join(classes.hint("merge"), "class_id")
        .select("class_id", F.pmod(F.xxhash64("path"), F.col("blocks")).alias("block"), "path", "n"), "class-file-blocks")
    first, second = (classes.select(F.col("class_id").alias(f"class_{i}"), F.col("blocks").alias(f"_b{i}")) for i in (1, 2))
    near = links.join(first, "class_1").join(second, "class_2")
    copies = classes.filter("files > 1").select(
        F.col("class_id").alias("class_1"), F.col("class_id").alias("class_2"), F.lit(1.0).alias("similarity"),
        F.col("blocks").alias("_b1"), F.col("blocks").alias("_b2"))

    def tiled(links: DataFrame) -> DataFrame:
        return links.withColumn("block_1", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_b1") - 1))).withColumn(
            "block_2", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_b2") - 1))).drop("_b1", "_b2")

    tiles = written(tiled(near.select(*copies.columns)).unionByName(tiled(copies)), "class-tiles")
    left = tiles.join(blocked.toDF("class_1", "block_1", "_p1", "_n1").hint("merge"), ["class_1", "block_1"])
    both = left.join(blocked.toDF("class_2", "block_2", "_p2", "_n2").hint("merge"), ["class_2", "block_2"]).filter(
        "CASE WHEN class_1 = class_2 THEN _p1 < _p2 ELSE _p1 <> _p2 END")
    chunks = F.col("_n1") * F.col("_n2")
    shared = (
        both.groupBy(F.least("_p1", "_p2").alias("path_1"), F.greatest("_p1", "_p2").alias("path_2"))
        .agg(F.sum(chunks).alias("shared_chunks"), F.sum(chunks * F.col("similarity")).alias("_similarity"))
        .select("path_1", "path_2", "shared_chunks", (F.col("_similarity") / F.col("shared_chunks")).alias("avg_similarity"))
    )
    return _rated(shared, chunk_paths, file_threshold)


def _rated(pairs: DataFrame, chunk_paths: DataFrame, file_threshold: float) -> DataFrame:
    counts = written(chunk_counts_per_path(chunk_paths), "path-counts")  # see exact_duplicate_groups
    size = F.greatest(F.coalesce("_n1", F.lit(1)), F.coalesce("_n2", F.lit(1)))
    return (
        pairs.join(counts.toDF("path_1", "_n1"), "path_1", "left")
        .join(counts.toDF("path_2", "_n2"), "path_2", "left")
        .select(
            "path_1", "path_2", "shared_chunks", "avg_similarity",
            (F.col("shared_chunks") / size).alias("redundancy_ratio"),
            F.when(F.col("avg_similarity") >= file_threshold, "DELETE duplicate")
            .otherwise("REVIEW").alias("action"),
        )
    )


#: Classes of a file from which on its rows are dealt over several blocks, at most what meets at once.
LARGE_FILE = 512
#: Rows of whole files that meet at once.
STRIP, MET = 1024, 2048
#: Rows of file pairs in a batch that goes out.
SENT_PAIRS = 65536


def vector_redundancy(
    files: DataFrame, distinct: DataFrame, chunk_paths: DataFrame, pair_threshold: float = PAIR_THRESHOLD,
    file_threshold: float = FILE_DUP_THRESHOLD, numbers: int = neighbours.LARGE,
) -> DataFrame:
    """``class_redundancy`` of all pairs at or above ``pair_threshold``, without a table of pairs.

    ``files`` is ``class_files`` (written), ``distinct`` has a row per distinct
    vector (written).  A file lies in one block of at most ``numbers`` numbers,
    and a task meets two blocks: all pairs of two files are met there, so their
    row is complete and neither pairs of chunks nor of files are shuffled; a
    vector is sent once per block.  Files of more than LARGE_FILE classes are
    dealt over blocks of their own, and their rows are added up.  Where cells
    would spare most products the pairs are found by cells.
    """
    spread = neighbours.Cells(distinct.select("id", "vector"), pair_threshold)
    several = distinct.groupBy("id").agg(F.count("*").alias("_n")).filter("_n > 1").limit(1).count()
    if several or (spread.rows >= neighbours.LARGE_FROM and not spread.large):
        pairs = spread.compare(distinct.select("id", "vector"), neighbours._emit_pairs, neighbours.PAIR_SCHEMA)
        links = class_links(pairs.toDF("chunk_id_1", "chunk_id_2", "similarity_score"), files)
        return expanded_redundancy(files, written(links, "class-links"), chunk_paths, file_threshold)
    counts = written(chunk_counts_per_path(chunk_paths), "path-counts")
    sizes = written(
        files.groupBy("path").agg(F.count("*").alias("classes")).join(counts.hint("merge"), "path", "left")
        .select("path", "classes", F.coalesce("chunk_count", F.lit(1)).alias("size")), "file-sizes")
    held = files.join(sizes.hint("merge"), "path").join(
        distinct.select(F.col("id").alias("class_id"), "vector").hint("merge"), "class_id")
    held = written(held.select((F.col("classes") > min(LARGE_FILE, STRIP, MET)).alias("large"), "path", "size", "class_id", "n", "vector"), "file-vectors")
    rows = {r["large"]: r["rows"] for r in held.groupBy("large").agg(F.count("*").alias("rows")).collect()}
    cores = held.sparkSession.sparkContext.defaultParallelism
    width = held.select(F.size("vector")).first()
    most = max(1, numbers // max(1, width[0] if width else 1))
    small = max(1, -(-rows.get(False, 0) // most), min(int(np.sqrt(6 * cores)), -(-rows.get(False, 0) // STRIP)))
    large = -(-rows.get(True, 0) // most)

    def every(low: int, high: int) -> Column:
        return F.sequence(F.lit(low), F.lit(high - 1)) if high > low else F.array().cast("array<int>")

    def tiled(rows: DataFrame, mine: Column, others: Column) -> DataFrame:
        placed = rows.withColumn("mine", mine.cast("int")).withColumn("_other", F.explode(others))
        return placed.select(F.least("mine", "_other").alias("a"), F.greatest("mine", "_other").alias("b"),
                             "mine", "path", "size", "class_id", "n", "vector")

    block = F.pmod(F.xxhash64("path"), F.lit(small))
    schema = "path_1 string, path_2 string, shared_chunks long, _similarity double, _size long"
    keys = ["a", "b"]

    def met(rows: DataFrame, tiles: int) -> DataFrame:
        parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(tiles, neighbours.MAX_PARTS))
        dealt = rows.repartition(parts, *keys).sortWithinPartitions(*keys, "mine", "path", "class_id")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for group in neighbours._groups(batches, keys):
                yield from _file_pairs(group, pair_threshold)

        return dealt.mapInArrow(run, schema)

    pairs = met(tiled(held.filter("NOT large"), block, every(0, small)), 2 * small * (small + 1))
    if large:
        # blocks of large files follow those of the others; a tile has at least one of them
        own = F.lit(small) + F.pmod(F.xxhash64("path", "class_id"), F.lit(large))
        rest = tiled(held.filter("large"), own, every(0, small + large)).unionByName(
            tiled(held.filter("NOT large"), block, every(small, small + large)))
        parts = met(rest, 2 * large * (small + large))
        pairs = pairs.unionByName(parts.groupBy("path_1", "path_2").agg(
            F.sum("shared_chunks").alias("shared_chunks"), F.sum("_similarity").alias("_similarity"), F.max("_size").alias("_size")))
    mean = F.col("_similarity") / F.col("shared_chunks")
    return pairs.select(
        "path_1", "path_2", "shared_chunks", mean.alias("avg_similarity"),
        (F.col("shared_chunks") / F.col("_size")).alias("redundancy_ratio"),
        F.when(mean >= file_threshold, "DELETE duplicate").otherwise("REVIEW").alias("action"))


def _whole_files(begins: np.ndarray, end: int, most: int) -> list[tuple[int, int]]:
    """Runs of rows of at most ``most`` that begin and end with a file; ``begins`` are the first rows of files. A longer file is cut."""
    runs, begin = [], int(begins[0]) if len(begins) else end
    while begin < end:
        if begin + most >= end:
            stop = end
        else:
            stop = int(begins[np.searchsorted(begins, begin + most, side="right") - 1])
            stop = stop if stop > begin else begin + most
        runs.append((begin, stop))
        begin = stop
    return runs


def _file_pairs(group: pa.Table, threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows of file pairs of one tile, sorted by block, path and class."""
    unit = unit_rows(as_matrix(group["vector"]))
    rough = unit.astype(np.float32)
    mine, n, size = group["mine"].to_numpy(), group["n"].to_numpy(), group["size"].to_numpy()
    path = group["path"].combine_chunks().dictionary_encode()
    file, names = path.indices.to_numpy(), path.dictionary
    cls = group["class_id"].combine_chunks().dictionary_encode().indices.to_numpy()
    place = np.empty(len(names), np.int64)
    place[pc.sort_indices(names).to_numpy()] = np.arange(len(names))  # of a path among all
    size_of = np.empty(len(names), np.int64)
    size_of[file] = size
    begins = np.flatnonzero(np.concatenate([[True], (file[1:] != file[:-1]) | (mine[1:] != mine[:-1])]))
    one = mine[0] == mine[-1]  # a single block meets itself
    if one and group["a"][0].as_py() != group["b"][0].as_py():
        return  # the other block is empty
    edge = len(mine) if one else int(np.flatnonzero(mine != mine[0])[0])
    right = begins if one else begins[begins >= edge]
    found, held = [], 0

    def sent() -> pa.RecordBatch:
        p, q, shared, similarity = (np.concatenate(x) for x in zip(*found))
        low, high = np.where(place[p] < place[q], p, q), np.where(place[p] < place[q], q, p)
        return pa.RecordBatch.from_arrays(
            [names.take(pa.array(low)), names.take(pa.array(high)), pa.array(shared), pa.array(similarity),
             pa.array(np.maximum(size_of[p], size_of[q]))], names=["path_1", "path_2", "shared_chunks", "_similarity", "_size"])

    parts = _whole_files(right, len(mine), MET)
    for begin, end in _whole_files(begins[begins < edge], edge, STRIP):
        for at, stop in parts:
            if stop <= begin:
                continue
            hit = np.flatnonzero(rough[begin:end] @ rough[at:stop].T >= threshold - vx.CANDIDATE_MARGIN)
            i, j = np.divmod(hit, stop - at)
            i, j = i + begin, j + at
            other = file[i] != file[j]
            if one:
                other &= i < j
            i, j = i[other], j[other]
            score, step = np.empty(len(i)), max(1, neighbours.SCORED // max(1, unit.shape[1]))
            for k in range(0, len(i), step):
                score[k:k + step] = np.einsum("nd,nd->n", unit[i[k:k + step]], unit[j[k:k + step]])
            score[cls[i] == cls[j]] = 1.0
            keep = score >= threshold
            i, j, score = i[keep], j[keep], score[keep]
            if not len(i):
                continue
            p, q = file[i].astype(np.int64), file[j].astype(np.int64)
            key = np.minimum(p, q) * len(names) + np.maximum(p, q)
            order = np.argsort(key, kind="stable")
            key, chunks = key[order], (n[i] * n[j])[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            found.append((*np.divmod(key[first], len(names)), np.add.reduceat(chunks, first), np.add.reduceat(chunks * score[order], first)))
            held += len(first)
            if held >= SENT_PAIRS:
                yield sent()
                found, held = [], 0
    if found:
        yield sent()


def duplicate_paths(duplicate_files: DataFrame, redundancy: DataFrame) -> DataFrame:
    """Every path on either side of an exact pair or of a pair marked for deletion."""
    marked = redundancy.filter("action = 'DELETE duplicate'")
    return _either_side(duplicate_files, marked.select(F.explode(F.array("path_1", "path_2")).alias("path")))


def _either_side(duplicate_files: DataFrame, marked: DataFrame) -> DataFrame:
    exact = duplicate_files.select(F.explode(F.array("path_1", "path_2")).alias("path"))
    return exact.unionByName(marked).filter("path <> ''").distinct()


def class_duplicate_paths(
    duplicate_files: DataFrame, files: DataFrame, links: DataFrame, chunk_paths: DataFrame,
    pair_threshold: float = PAIR_THRESHOLD, file_threshold: float = FILE_DUP_THRESHOLD,
) -> DataFrame:
    """``duplicate_paths`` from the stored form (``class_files`` and ``class_links``).

    No chunk pair is below ``pair_threshold``, so with a file threshold of at
    most that every pair of files is marked, whatever its average, and a file is
    marked if it has any pair: no pair is made.  Above it averages decide, and
    pairs are made.
    """
    if file_threshold <= pair_threshold:
        return _either_side(duplicate_files, linked_paths(files, links))
    return duplicate_paths(duplicate_files, expanded_redundancy(files, links, chunk_paths, file_threshold))


def averaged_duplicate_paths(
    duplicate_files: DataFrame, files: DataFrame, distinct: DataFrame,
    pair_threshold: float = PAIR_THRESHOLD, file_threshold: float = FILE_DUP_THRESHOLD,
    block_rows: int = neighbours.BLOCK_ROWS,
) -> DataFrame:
    """``duplicate_paths`` of the pairs of files whose average reaches ``file_threshold``, without the pair table.

    ``files`` is ``class_files`` (written), ``distinct`` has a row per distinct
    vector.  A file is marked by a single pair, so its likeliest partners are
    tried first, exactly: a file of the same class and the best partner nearby;
    for the files this leaves open, the best partner anywhere.  An average can
    only reach the threshold if a chunk pair does, so a file without such a
    partner is settled too.  Only what is open after that has its pairs made.
    """
    return _either_side(duplicate_files, _marked_paths(files, distinct, pair_threshold, file_threshold, block_rows))


TRIED = 2  # partners of a file that are tried in a round
TRIED_CLASSES = 1024  # classes of two files compared in a task; larger pairs are left to the last step


def _marked_paths(
    files: DataFrame, distinct: DataFrame, pair_threshold: float, file_threshold: float, block_rows: int
) -> DataFrame:
    spans = written(files.groupBy("class_id").agg(F.min("path").alias("least"), F.max("path").alias("most")), "class-spans")
    # An id: the owner (the path of a class of one file), the digests of the vector, the class.
    digests = [F.lpad(F.hex(d), 16, "0") for d in vx.DIGEST]
    keyed = distinct.withColumnRenamed("id", "class_id").join(spans.hint("merge"), "class_id")
    one = F.col("least") == F.col("most")
    owner = F.lpad(F.hex(F.when(one, F.xxhash64("least")).otherwise(F.xxhash64("class_id", *vx.DIGEST))), 16, "0")
    vectors = written(keyed.select(F.concat(owner, *digests, "class_id").alias("id"), "class_id", "vector"), "class-vectors")
    named = vectors.select("id", "vector")
    lowest = max(pair_threshold, file_threshold)
    partners = neighbours.Partners(named, lowest, 16, block_rows)
    own = spans.filter("least < most").select("class_id", F.col("class_id").alias("near"), F.lit(1.0).alias("similarity"))

    def tried(found: DataFrame, asked: DataFrame) -> DataFrame:
        """(path, other, similarity): the likeliest partners of every asked file (class_id, path)."""
        near = own.unionByName(found.select(
            F.substring("query_id", 49, 1 << 30).alias("class_id"), F.substring("id", 49, 1 << 30).alias("near"), "similarity"))
        met = (
            asked.join(written(near, "near-classes").hint("merge"), "class_id")
            .join(spans.withColumnRenamed("class_id", "near").hint("merge"), "near")
        )
        # '' holds all chunks without a file: it is left to the last step
        other = F.when((F.col("least") != F.col("path")) & (F.col("least") != ""), F.col("least")).when(
            F.col("most") != F.col("path"), F.col("most")).otherwise("")
        best = met.groupBy("path", other.alias("other")).agg(F.max("similarity").alias("similarity"))
        return written(top_per_key(best, "path", TRIED, F.desc("similarity"), F.col("other")), "tried-pairs")

    asked = written(files.filter("path <> ''").select("class_id", "path"), "asked-classes")
    first = _averaged(tried(partners.nearby(), asked), files, vectors, pair_threshold, file_threshold)
    left = written(asked.join(first.hint("merge"), "path", "left_anti"), "open-classes")
    queries = vectors.join(left.select("class_id").distinct().hint("merge"), "class_id", "left_semi").select("id", "vector")
    again = tried(partners.best(written(queries, "open-vectors")), left)
    second = _averaged(again, files, vectors, pair_threshold, file_threshold)
    rest = written(again.select("path").distinct().join(second.hint("merge"), "path", "left_anti"), "open-files")
    last = _averaged_fully(rest, files, vectors, partners, pair_threshold, file_threshold)
    return first.unionByName(second).unionByName(last)


def _averaged(
    tried: DataFrame, files: DataFrame, vectors: DataFrame, pair_threshold: float, file_threshold: float
) -> DataFrame:
    """(path) of both files of every tried pair whose average reaches the threshold; all their classes meet in a task."""
    pairs = tried.filter("other <> ''").select(F.least("path", "other").alias("path_1"), F.greatest("path", "other").alias("path_2")).distinct()
    sizes = written(files.groupBy("path").agg(F.count("*").alias("classes")), "file-classes")
    small = (
        pairs.join(sizes.toDF("path_1", "_c1").hint("merge"), "path_1").join(sizes.toDF("path_2", "_c2").hint("merge"), "path_2")
        .filter(F.col("_c1") + F.col("_c2") <= TRIED_CLASSES).select("path_1", "path_2")
    )
    small = written(small, "small-pairs")
    sides = small.select("path_1", "path_2", F.lit(1).alias("side"), F.col("path_1").alias("path")).unionByName(
        small.select("path_1", "path_2", F.lit(2).alias("side"), F.col("path_2").alias("path")))
    held = sides.join(files.hint("merge"), "path").select("path_1", "path_2", "side", "class_id", "n")
    rows = held.join(vectors.hint("merge"), "class_id").select("path_1", "path_2", "side", "class_id", "n", "vector")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in neighbours._groups(batches, ["path_1", "path_2"]):
            side, n = group["side"].to_numpy(), group["n"].to_numpy().astype(np.float64)
            classes = np.asarray(group["class_id"].to_pylist(), dtype=object)
            left, right = np.flatnonzero(side == 1), np.flatnonzero(side == 2)
            if any(len(set(classes[s])) < len(s) for s in (left, right)):
                continue  # an id of several vectors: left to the last step
            unit = unit_rows(as_matrix(group["vector"]))
            similarity = unit[left] @ unit[right].T
            same = classes[left][:, None] == classes[right][None, :]
            similarity[same] = 1.0
            weight = np.where(same | (similarity >= pair_threshold), n[left][:, None] * n[right][None, :], 0.0)
            if weight.sum() and (weight * similarity).sum() / weight.sum() >= file_threshold:
                yield pa.RecordBatch.from_arrays([pa.array([group["path_1"][0].as_py(), group["path_2"][0].as_py()])], names=["path"])

    dealt = rows.repartition("path_1", "path_2").sortWithinPartitions("path_1", "path_2", "side", "class_id")
    return written(dealt.mapInArrow(compare, "path string").distinct(), "marked-files")


def _averaged_fully(
    rest: DataFrame, files: DataFrame, vectors: DataFrame, partners: neighbours.Partners, pair_threshold: float, file_threshold: float
) -> DataFrame:
    """(path) of both files of every pair that names one of ``rest`` (path) and reaches the threshold, from all its links."""
    asked = written(files.join(rest.hint("merge"), "path", "left_semi"), "asked-files")
    classes = written(asked.select("class_id").distinct(), "asked-ids")
    queries = written(vectors.join(classes.hint("merge"), "class_id", "left_semi").select("id", "vector"), "asked-vectors")
    found = partners.all(queries, pair_threshold).select(
        F.substring("query_id", 49, 1 << 30).alias("class_1"), F.substring("id", 49, 1 << 30).alias("class_2"), "similarity", "query_id", "id")
    # A link inside one id of several vectors is found from both and counts once.
    to = found.filter("class_1 <> class_2 OR query_id < id").drop("query_id", "id").unionByName(
        classes.select(F.col("class_id").alias("class_1"), F.col("class_id").alias("class_2"), F.lit(1.0).alias("similarity")))
    shared = _shared_of(asked, files, to)
    return shared.filter(F.col("_similarity") / F.col("shared_chunks") >= file_threshold).select(
        F.explode(F.array("_p1", "_p2")).alias("path"))


def recommendations(
    exact: DataFrame, redundancy: DataFrame, file_threshold: float = FILE_DUP_THRESHOLD
) -> DataFrame:
    def column(value: str, name: str) -> Column:
        return F.lit(value).alias(name)

    same = exact.select(
        column("exact_duplicate", "rec_type"), column("HIGH", "severity"),
        F.col("path_1").alias("primary_id"), F.col("path_2").alias("duplicate_id"),
        column("Delete one copy", "action"),
        F.format_string("Identical files (hash=%s…)", F.substring("hash", 1, 12)).alias("details"),
    )
    near = redundancy.select(
        column("near_duplicate_file", "rec_type"),
        F.when(F.col("avg_similarity") >= file_threshold, "HIGH").otherwise("MEDIUM").alias("severity"),
        F.col("path_1").alias("primary_id"), F.col("path_2").alias("duplicate_id"), "action",
        F.format_string(
            "Shared chunks: %d, avg sim: %.2f, overlap: %d%%", "shared_chunks", "avg_similarity",
            F.bround(F.col("redundancy_ratio") * 100).cast("long"),
        ).alias("details"),
    )
    return same.unionByName(near)


def duplicates_summary(exact: DataFrame, sections: DataFrame, redundancy: DataFrame) -> DataFrame:
    """Row counts of the four duplicate outputs."""

    def counted(frame: DataFrame, name: str) -> DataFrame:
        return frame.agg(F.count("*").alias("rows")).select(F.lit(name).alias("output"), "rows")

    return (
        counted(exact, "exact_duplicate_pairs")
        .unionByName(counted(sections, "near_duplicate_chunk_pairs"))
        .unionByName(counted(redundancy, "redundant_file_pairs"))
        .unionByName(counted(recommendations(exact, redundancy), "recommendations"))
    )


def duplicates_listing(redundancy: DataFrame, limit: int = 100, digits: int | None = None) -> DataFrame:
    """Most similar file pairs first."""
    shown = F.col("avg_similarity") if digits is None else F.round("avg_similarity", digits)
    return (
        redundancy.orderBy(F.desc("avg_similarity"), "path_1", "path_2").limit(limit)
        .select("path_1", "path_2", shown.alias("avg_similarity"), "action")
    )
