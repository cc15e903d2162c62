"""Operator 12: near duplicates by a multi-index Hamming join of MinHash signatures.

A signature has SYMBOLS MinHash values of BITS bits each; the distance of two is
the number of values that differ.  Signatures are split into CHUNKS chunks.  Two
signatures at a distance of at most DISTANCE = 2 * CHUNKS - 1 cannot differ
twice in every chunk, so some chunk differs in one value at most (pigeonhole).
Every chunk therefore gives a key for each value left out: all pairs within the
distance meet under a key, none is left to chance.  What is left to chance is
the signature: two sets at similarity 0.8 lie further apart than 19 of 40 with
probability 2e-5, which no cap or bucket size changes.

What meets is compared by signature and then confirmed on full sets, and no pair
leaves its task.  Every key has a leader, the set whose keys most others have.
Sets first go to the nearest leader of their keys and are joined with its group
inside a task, which puts most copies into one component.  Keys with several
components after that send all their sets to their leader: any two sets that
share a key meet there.  Signatures alone tell which sets have a near one of
another component, and only those come with their full sets.  Large groups are
dealt out in tiles of two blocks; a task returns the links that join components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.storage import written
from ..operators.cluster import connected_components
from . import ngram_join
from .common import BASE, bitmap, holds, mixed, steps
from .ngram_join import SKETCH_BITS, _by_group, _labelled, _rows_by_query, _set_keys, full_paths, pair_overlap, shingle_sets

BITS, CHUNKS, CHUNK = 16, 10, 4
SYMBOLS, DISTANCE = CHUNKS * CHUNK, 2 * CHUNKS - 1

#: Bits of the bitmap of keys that several sets have; a fuller one in a larger corpus lets more rows through to the exact join.
KEY_BITS = 26

#: Sets that meet under one key are compared in tiles of two blocks of so many.
BLOCK = 2048

_SALT = mixed(np.arange(1, SYMBOLS + 1, dtype=np.uint64) * BASE)
_MULTIPLIER = mixed(_SALT) | np.uint64(1)


def signatures(grams: np.ndarray, size: np.ndarray) -> np.ndarray:
    """SYMBOLS values for each set; sets are runs of ``grams`` of the given sizes, those of empty sets are 0."""
    out = np.zeros((len(size), SYMBOLS), "<u2")
    filled = np.flatnonzero(size)
    if len(filled):
        first = (np.cumsum(size) - size)[filled]
        for k in range(SYMBOLS):
            least = np.minimum.reduceat((grams ^ _SALT[k]) * _MULTIPLIER[k], first)
            out[filled, k] = (mixed(least) & np.uint64((1 << BITS) - 1)).astype(np.uint16)
    return out


def chunk_keys(values: np.ndarray) -> np.ndarray:
    """One row per set: CHUNKS * CHUNK keys, each a chunk without one of its values.

    A key holds the chunk, the place left out and the values left, so two keys
    are equal if and only if the values are.
    """
    out = np.empty((len(values), SYMBOLS), np.int64)
    values = values.astype(np.int64)
    for c in range(CHUNKS):
        for j in range(CHUNK):
            left = [c * CHUNK + i for i in range(CHUNK) if i != j]
            out[:, c * CHUNK + j] = (c * CHUNK + j) << 48 | values[:, left[0]] << 32 | values[:, left[1]] << 16 | values[:, left[2]]
    return out


def signature_table(documents: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(id, n, set_key, signature) of every row; narrow."""
    rows = documents.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch, "text"):
                of, grams = shingle_sets(step.column("text"), words)
                size, keys = _set_keys(of, grams, step.num_rows)
                raw = signatures(grams, size)
                yield pa.RecordBatch.from_arrays(
                    [step.column("id"), pa.array(size, pa.int64()), pa.array(keys, pa.int64()),
                     pa.array([x.tobytes() for x in raw], pa.binary())], names=["id", "n", "set_key", "signature"])

    return rows.mapInArrow(scan, f"id {kind}, n long, set_key long, signature binary")


def _values(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(len(column), SYMBOLS)


def _keys_of(sets: DataFrame, only=None) -> DataFrame:
    """(token, set_key, n): the keys of every set, with ``only`` none but those in the bitmap.  Narrow."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 4096):
                part = batch.slice(begin, 4096)
                tokens = chunk_keys(_values(part.column("signature")))
                row, at = np.nonzero(holds(only.value, tokens.reshape(-1)).reshape(tokens.shape)) if only is not None else np.divmod(
                    np.arange(tokens.size), SYMBOLS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tokens[row, at]), part.column("set_key").take(pa.array(row)), part.column("n").take(pa.array(row))],
                    names=["token", "set_key", "n"])

    return sets.select("signature", "set_key", "n").mapInArrow(emit, "token long, set_key long, n long")


def _near(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, distance) of the pairs within DISTANCE."""
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = (_values(batch.column("x")) != _values(batch.column("y"))).sum(1)
            near = pa.array(np.flatnonzero(apart <= DISTANCE))
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").take(near), batch.column("b").take(near), pa.array(apart, pa.int64()).take(near)],
                names=["a", "b", "distance"])

    x = sets.select(F.col("set_key").alias("a"), F.col("signature").alias("x"))
    y = sets.select(F.col("set_key").alias("b"), F.col("signature").alias("y"))
    return pairs.select("a", "b").join(x.hint("merge"), "a").join(y.hint("merge"), "b").select("a", "b", "x", "y").mapInArrow(
        measure, "a long, b long, distance long")


def _linked(one: np.ndarray, others: list[np.ndarray], over: int, under: int) -> np.ndarray:
    """Which of the sorted sets ``others`` link with the sorted set ``one``."""
    size = np.array([len(x) for x in others], np.int64)
    all_ = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, all_), len(one) - 1)
    common = np.add.reduceat((one[at] == all_).astype(np.int64), np.cumsum(size) - size)
    return common >= pair_overlap(len(one), size, over, under)


def _settled(stars: DataFrame, paths: DataFrame, over: int, under: int) -> DataFrame:
    """(a, b, settled, root): links that join every group (leader a, sets b) as the similarities of its sets do.

    The leader is compared with all, then every set not joined to it with those
    of other components within the distance.  Links returned join two components
    each; rows (b, null, group, root) say in which group a set was and which of
    it names its part.
    """
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, salt, keys, sets in _by_group(batches):
            root, made = np.arange(len(keys)), []

            def unite(u: int, v: int) -> None:
                x, y = sorted((root[u], root[v]))
                root[root == y] = x
                made.append((keys[u], keys[v], None))

            if len(keys) > 1:
                for v in np.flatnonzero(_linked(sets[0], sets[1:], over, under)) + 1:
                    if root[v] != root[0]:
                        unite(0, int(v))
                if (root != root[0]).any():
                    values = signatures(np.concatenate(sets), np.array([len(x) for x in sets]))
                    for u in np.flatnonzero(root != root[0]):
                        near = np.flatnonzero(((values != values[u]).sum(1) <= DISTANCE) & (root != root[u]))
                        hit = near[_linked(sets[u], [sets[v] for v in near], over, under)] if len(near) else []
                        for v in hit:
                            if root[u] != root[v]:
                                unite(int(u), int(v))
            group = int(mixed(np.array([a], np.int64).view(np.uint64) + np.uint64(salt)).view(np.int64)[0])
            made = [(*x, None) for x in made] + [(b, None, group, keys[r]) for b, r in zip(keys[1:], root[1:])]
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*made)], names=["a", "b", "settled", "root"])

    return _rows_by_query(stars, paths).mapInArrow(join, "a long, b long, settled long, root long")


def _tiled(members: DataFrame, weight: str, limit: int) -> DataFrame:
    """Rows (a, …) with tile (i, j) and their ``block``: the blocks of a group hold ``limit`` of ``weight`` or so.

    Any two rows of a group share a tile.  Rows are dealt by tile and come sorted by it.
    """
    counts = written(members.groupBy("a").agg(F.ceil(F.sum(weight) / limit).cast("int").alias("blocks")), "hamming-counts")
    blocked = members.join(counts.hint("merge"), "a").withColumn("block", F.pmod(F.xxhash64("set_key"), "blocks").cast("int"))
    tiled = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn(
        "i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other", "blocks")
    return tiled.repartition("a", "i", "j").sortWithinPartitions("a", "i", "j")


class _Tile:
    """The rows of one tile and which of them are to be compared."""

    def __init__(self, tile: tuple, rows: list[dict], over: int, under: int) -> None:
        self.leader, self.diagonal, self.over, self.under = tile[0], tile[1] == tile[2], over, under
        self.keys, self.n, self.component, self.settled, self.block = (
            np.array([r[name] for r in rows], np.int64) for name in ("set_key", "n", "component", "settled", "block"))
        self.values = np.frombuffer(b"".join(r["signature"] for r in rows), "<u2").reshape(len(rows), SYMBOLS)

    def near(self, u: int) -> np.ndarray:
        """Later rows within DISTANCE of row ``u`` that are in another component, not compared before and of a size that can link."""
        n = self.n[u:] if self.diagonal else self.n
        rows = slice(u, None) if self.diagonal else slice(None)
        may = (self.component[rows] != self.component[u]) & (self.settled[rows] != self.settled[u])
        may &= (n * self.under >= n[0 if self.diagonal else u] * self.over) & (n[0 if self.diagonal else u] * self.under >= n * self.over)
        if not self.diagonal:
            may &= self.block > self.block[u]
        other = np.flatnonzero(may) + (u if self.diagonal else 0)
        return other[(self.values[other] != self.values[u]).sum(1) <= DISTANCE] if len(other) else other


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict]]]:
    """((a, i, j), rows) of rows sorted by tile."""
    now, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            tile = row["a"], row["i"], row["j"]
            if tile != now:
                if len(rows) > 1:
                    yield now, rows
                now, rows = tile, []
            rows.append(row)
    if len(rows) > 1:
        yield now, rows


def _with_partners(members: DataFrame, over: int, under: int) -> DataFrame:
    """(a, set_key) of the members that have a near set of another component in their group."""
    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile, rows in _tiles(batches):
            t = _Tile(tile, rows, over, under)
            found = np.zeros(len(rows), bool)
            for u in range(len(rows)):
                near = t.near(u)
                found[near] = True
                found[u] |= len(near) > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(found.sum(), t.leader, np.int64)), pa.array(t.keys[found])], names=["a", "set_key"])

    return _tiled(members.withColumn("one", F.lit(1)), "one", BLOCK).mapInArrow(flag, "a long, set_key long").distinct()


def _joining(members: DataFrame, over: int, under: int) -> DataFrame:
    """(a, b): links between near members, confirmed on their full sets, that join the components of a tile."""
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile, rows in _tiles(batches):
            t = _Tile(tile, rows, over, under)
            sets = [np.frombuffer(r["path"], ">u8").astype(np.uint64) for r in rows]
            made = []
            for u in range(len(rows)):
                near = t.near(u)
                if not len(near):
                    continue
                for v in near[_linked(sets[u], [sets[v] for v in near], over, under)]:
                    if t.component[u] != t.component[v]:
                        t.component[t.component == t.component[v]] = t.component[u]
                        made.append((t.keys[u], t.keys[v]))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*made)], names=["a", "b"])

    sized = members.withColumn("grams", F.length("path") / 8)
    return _tiled(sized, "grams", ngram_join.GROUP).drop("grams").mapInArrow(join, "a long, b long")


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, over: int = 4,
                    under: int = 5) -> DataFrame:
    """(key, n_shingles, component_id): groups of texts whose sets of word n-grams link, directly or through others.

    Two texts link when intersection / union of their sets of distinct word
    n-grams is at least over / under (0.8 or more is what the signature is made
    for) and their signatures lie within DISTANCE.  Words are compared in lower
    case (A to Z).  A text of fewer words is one n-gram; a null, empty or blank
    text has an empty set, is linked with nothing and has component itself.  The
    component is the smallest key in it.  Equal sets are one node.  Rows that
    repeat a key are rows of their own with the component of their own set; a
    row with a null key has the component of an equal text with a key, else
    null.  Other columns are not read; an empty table gives no row.  A very long
    text is one numpy step of about ten times its bytes.
    """
    spark = documents.sparkSession
    rows = written(signature_table(documents, key, text, words), "hamming-rows")
    sets = written(rows.filter("n > 0").groupBy("set_key").agg(
        F.min("id").alias("first"), F.min("n").alias("n"), F.any_value("signature").alias("signature")), "hamming-sets")

    several = written(_keys_of(sets).groupBy("token").agg(
        F.min("set_key").alias("least"), F.max("set_key").alias("most"), F.count(F.lit(1)).alias("rows"))
        .filter("least <> most").select("token", "rows"), "hamming-tokens")
    shared = spark.sparkContext.broadcast(bitmap(several, "token", KEY_BITS))
    heads = written(_keys_of(sets, shared).join(several.hint("merge"), "token"), "hamming-keys")

    # The leader of a key is the set whose keys most others have; each set goes to the nearest leader of its keys.
    scored = heads.withColumn("score", F.sum("rows").over(Window.partitionBy("set_key")))
    leaders = written(scored.groupBy("token").agg(F.max_by(F.struct("set_key", "n"), F.struct("score", "set_key")).alias("l")).select(
        "token", F.col("l.set_key").alias("a"), F.col("l.n").alias("m")), "hamming-leaders")
    groups = written(heads.join(leaders.hint("merge"), "token").select("a", "m", "set_key", "n").distinct(), "hamming-groups")
    may = groups.filter(
        (F.col("set_key") != F.col("a")) & (F.col("n") * under >= F.col("m") * over) & (F.col("m") * under >= F.col("n") * over))
    stars = written(_near(may.select("a", F.col("set_key").alias("b")), sets).groupBy("b").agg(
        F.min(F.struct("distance", "a")).alias("best")).select(F.col("best.a").alias("a"), "b"), "hamming-stars")

    # Sets in order of hash; with no counts to sort by, that is the order paths come in.
    unsorted = spark.sparkContext.broadcast(np.zeros(1 << SKETCH_BITS, np.int8))

    def full_sets(wanted: DataFrame) -> DataFrame:
        asked = wanted.join(sets.select("set_key", F.col("first").alias("id")).hint("merge"), "set_key")
        return written(full_paths(documents, written(asked, "hamming-asked"), key, text, words, unsorted), "hamming-full")

    paths = full_sets(stars.select(F.explode(F.array("a", "b")).alias("set_key")).distinct())
    made = written(_settled(stars, paths, over, under), "hamming-links")
    links = made.filter("b IS NOT NULL").select("a", "b")
    # What is joined so far, by names that follow each other a few steps: equal names are one component, if not the other way round.
    names = written(made.filter("b IS NULL").select(F.col("a").alias("set_key"), "settled", "root"), "hamming-names")
    for _ in range(2):
        onward = names.select(F.col("set_key").alias("root"), F.col("root").alias("further"))
        names = written(names.join(onward.hint("merge"), "root", "left").select(
            "set_key", "settled", F.coalesce("further", "root").alias("root")), "hamming-names")
    labels = written(sets.select("set_key", "n", "signature").join(names.hint("merge"), "set_key", "left").select(
        "set_key", "n", "signature", F.coalesce("root", "set_key").alias("component"), F.coalesce("settled", "set_key").alias("settled")),
        "hamming-labels")

    members = written(groups.select("a", "set_key").join(labels.hint("merge"), "set_key"), "hamming-members")
    several = written(members.groupBy("a").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select(
        "a"), "hamming-open")
    asked = written(_with_partners(members.join(several.hint("merge"), "a"), over, under), "hamming-partners")
    if asked.limit(1).count():
        more_sets = full_sets(asked.select("set_key").distinct())
        facing = written(members.join(asked.hint("merge"), ["a", "set_key"]).join(more_sets.hint("merge"), "set_key"), "hamming-facing")
        links = links.unionByName(written(_joining(facing, over, under), "hamming-more"))
    # Components of names, then of sets.
    named = labels.select("set_key", "component")
    edges = links.join(named.toDF("a", "x").hint("merge"), "a").join(named.toDF("b", "y").hint("merge"), "b").filter("x <> y")
    edges = written(edges.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "hamming-edges")
    joined = written(connected_components(edges), "hamming-components").withColumnRenamed("node", "root").withColumnRenamed("component", "whole")
    joined = named.join(joined.hint("merge"), named["component"] == joined["root"], "left").select(
        F.col("set_key").alias("node"), F.coalesce("whole", "component").alias("component"))
    return _labelled(rows.select("id", "n", "set_key"), sets.select("set_key", "first"), joined).select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id")


def one_per_component(documents: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, over: int = 4,
                      under: int = 5) -> DataFrame:
    """The documents whose key names their component; all columns as they were.  Null keys stay."""
    named = near_duplicates(documents, key, text, words, over, under)
    later = written(named.filter(F.col(key) != F.col("component_id")).select(F.col(key).alias("__later")).distinct(), "hamming-later")
    return documents.join(later.hint("merge"), F.col(f"`{key}`") == F.col("__later"), "left_anti")
