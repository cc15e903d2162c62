"""Density clustering over the similarity graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from ..functions.storage import written
from ..functions.vector import DIGEST, with_digest
from . import neighbours


def _round(edges: DataFrame) -> tuple[DataFrame, dict]:
    """Write one round's edges; its row count and digest are observed on the way."""
    seen = Observation()
    digest = F.sum(F.xxhash64("a", "b") % 1_000_003)
    table = written(edges.observe(seen, F.count(F.lit(1)).alias("rows"), digest.alias("digest")), "components")
    return table, seen.get


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, component) for every node of the edges (a, b); smallest node names it.

    Alternates large-star and small-star steps, which need O(log n) rounds.
    A node's neighbours are never gathered: minima are aggregates joined back.
    Each round is written to the shared folder, which cuts the lineage.
    """
    current, before = _round(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(max_rounds):
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Written, so that both sides of the join come straight from a shuffle and a hub is split.
        lowest = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "component-lowest")
        large = both.filter("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.filter("a <> b").distinct(), "component-large")
        lowest = written(large.groupBy("a").agg(F.min("b").alias("m")), "component-lowest")
        small = (
            large.join(lowest, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(lowest.withColumnRenamed("m", "b"))
        )
        current, after = _round(
            small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def dbscan_cluster(
    vectors: DataFrame, eps: float = 0.3, min_points: int = 3, id_col: str = "file_id",
    block_rows: int = neighbours.BLOCK_ROWS,
) -> DataFrame:
    """DBSCAN with cosine distance: (id, cluster, is_core), cluster null for noise.

    A cluster is named by its smallest core id; a border point joins the
    smallest adjacent cluster.  Equal vectors are collapsed to one weighted
    point first.  The first pass counts neighbours, the second links cores;
    both send rows in proportion to the points, however dense a cluster is.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    usable = vectors.filter("vector IS NOT NULL")
    points = written(
        with_digest(usable).groupBy(*DIGEST).agg(
            F.min(id_col).alias("id"), F.count("*").alias("weight"), F.any_value("vector").alias("vector")), "points"
    )
    named = points.select(F.col("id").cast("string").alias("id"), "vector", "weight")
    cells = neighbours.Cells(named, 1.0 - eps, block_rows)
    near = neighbours.neighbour_weights(cells, named.withColumnRenamed("weight", "mark"))
    marked = written(
        named.join(near, "id", "left")
        .withColumn("mark", (F.col("weight") + F.coalesce("near", F.lit(0)) >= min_points).cast("long"))
        .select("id", "vector", "mark"), "marked-points"
    )
    links = written(neighbours.core_links(cells, marked).select(
        F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"), "among_cores"), "links")
    cores = marked.filter("mark = 1").select(F.col("id").cast(kind).alias("id"))
    joined = connected_components(links.filter("among_cores").select("a", "b")).withColumnRenamed("node", "id")
    core_labels = written(cores.join(joined, "id", "left").select(
        "id", F.coalesce("component", "id").alias("cluster"), F.lit(True).alias("is_core")
    ), "core-labels")
    border_labels = (
        links.filter("NOT among_cores").withColumnRenamed("b", "id")
        .join(core_labels.select("id", "cluster"), "id")
        .groupBy(F.col("a").alias("id")).agg(F.min("cluster").alias("cluster"))
        .withColumn("is_core", F.lit(False))
    )
    labels = points.select("id", *DIGEST).join(
        core_labels.unionByName(border_labels), "id", "left"
    ).select(*DIGEST, "cluster", F.coalesce("is_core", F.lit(False)).alias("is_core"))
    return (
        with_digest(usable).select(id_col, *DIGEST).join(labels, DIGEST)
        .select(id_col, "cluster", "is_core")
    )


def cluster_density(files: DataFrame, clusters: DataFrame) -> DataFrame:
    """Add ``s_cluster_density``: cluster size over the largest cluster's size."""
    sizes = written(
        clusters.filter("cluster IS NOT NULL").groupBy("cluster").agg(F.count("*").alias("size")), "cluster-sizes")
    largest = sizes.agg(F.max("size")).scalar()
    share = (
        clusters.join(sizes, "cluster")
        .select("file_id", (F.col("size") / largest).alias("s_cluster_density"))
    )
    return files.join(share, "file_id", "left").fillna({"s_cluster_density": 0.0})
