"""Operator 6: n-gram Jaccard join over a prefix tree.

Every text is its set of word n-grams, and every set is a path: its n-grams in
one global order, rarest first by a counting sketch of fixed size.  Sets that
can reach the threshold share n-grams near the root of their paths, so only the
first part of each path is dealt out to find candidates.  Candidates are
compared in the depth-first order of the tree: a path's overlap with the query
is counted once for all sets that share it, and a subtree is left as soon as
what remains of its paths cannot reach the overlap needed.

Sets are first compared in groups around one leader each, inside a task, and
what this joins is not compared again: a group of thousands of near copies sends
rows in proportion to it.  Only pairs of different groups that stand in
different components afterwards are compared as pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.storage import written
from ..operators.cluster import connected_components
from .common import LOWER, WHITE, bitmap, bytes_of, holds, mixed, span_hashes, spans_of, steps, window_hashes

#: The counting sketch has 2 ** SKETCH_BITS counts, whatever the corpus; more bits tell frequent n-grams apart in a larger one.
SKETCH_BITS = 19
_SLICES = 32

#: Bitmaps of n-grams and of sets that are worth sending on; fuller ones in a larger corpus only send more.
TOKEN_BITS, SET_BITS = 26, 23

#: A path shows 1 / EXTRA of its length more than the least, and two sets must share as many n-grams there.
#: Half of that is given up again: the n-grams there that most sets have.
EXTRA = 16

#: N-grams of the sets that meet in one tree, about; larger groups are dealt to several.
GROUP = 1 << 20


def shingle_sets(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct n-grams of each text, sorted; a text of fewer words is one n-gram."""
    data, bounds = bytes_of(column)
    starts, ends, rows = spans_of(~WHITE[data], bounds)
    hashes = span_hashes(data, starts, ends, LOWER)
    count = np.bincount(rows, minlength=len(bounds) - 1)
    at, grams = window_hashes(hashes, rows, words)
    of = rows[at]
    for few in range(1, words):
        at, short = window_hashes(hashes, rows, few)
        at_short = count[rows[at]] == few
        of = np.concatenate([of, rows[at][at_short]])
        grams = np.concatenate([grams, mixed(short[at_short] + np.uint64(few))])
    if words > 1:  # short texts were added at the end
        order = np.argsort(of, kind="stable")
        of, grams = of[order], grams[order]
    edges = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
    for begin, end in zip(edges, edges[1:]):
        grams[begin:end].sort()
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (grams[1:] != grams[:-1])
    return of[new], grams[new]


def _set_keys(of: np.ndarray, grams: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(size, 64-bit key) of each row's set; the key does not depend on order."""
    size = np.bincount(of, minlength=n)
    total = np.zeros(len(grams) + 1, np.uint64)
    np.cumsum(mixed(grams ^ np.uint64(0xA5A5A5A5A5A5A5A5)), out=total[1:])
    end = np.cumsum(size)
    return size, mixed(total[end] - total[end - size] + size.astype(np.uint64)).view(np.int64)


def _bucket(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def set_table(documents: DataFrame, key: str, text: str, words: int) -> tuple[DataFrame, np.ndarray]:
    """(id, n, set_key) of every row, written, and the sketch of n-gram counts over all of them."""
    rows = documents.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, id_type = np.zeros(1 << SKETCH_BITS, np.int64), None
        for batch in batches:
            id_type = batch.column("id").type
            for step in steps(batch, "text"):
                of, grams = shingle_sets(step.column("text"), words)
                sketch += np.bincount(_bucket(grams), minlength=len(sketch))
                size, keys = _set_keys(of, grams, step.num_rows)
                n = step.num_rows
                yield pa.RecordBatch.from_arrays(
                    [step.column("id"), pa.array(size, pa.int64()), pa.array(keys, pa.int64()),
                     pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
                    names=["id", "n", "set_key", "slice", "counts"])
        if id_type is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(_SLICES, id_type), pa.nulls(_SLICES, pa.int64()), pa.nulls(_SLICES, pa.int64()),
                 pa.array(range(_SLICES), pa.int32()),
                 pa.array([x.astype("<u4").tobytes() for x in np.split(np.minimum(sketch, 0xFFFFFFFF), _SLICES)], pa.binary())],
                names=["id", "n", "set_key", "slice", "counts"])

    scanned = written(rows.mapInArrow(scan, f"id {kind}, n long, set_key long, slice int, counts binary"), "ngram-sets")

    def added(key, batch):
        total = sum((np.frombuffer(x.as_buffer(), "<u4").astype(np.int64) for x in batch.column("counts")),
                    np.zeros((1 << SKETCH_BITS) // _SLICES, np.int64))
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    # A task gives one slice of fixed size, and so does the sum: the sketch has 2 ** SKETCH_BITS counts at any input.
    parts = scanned.filter("slice IS NOT NULL").select("slice", "counts").groupBy("slice").applyInArrow(
        added, "slice int, counts binary").collect()
    sketch = np.zeros(1 << SKETCH_BITS, np.int64)
    for part in parts:
        size = len(sketch) // _SLICES
        sketch[part["slice"] * size:(part["slice"] + 1) * size] = np.frombuffer(part["counts"], np.int64)
    return scanned.filter("slice IS NULL").select("id", "n", "set_key"), sketch


def least_overlap(n: np.ndarray | int, over: int, under: int):
    """Common elements that a set of n needs with any partner: ceil(n * over / under)."""
    return -(-n * over // under)


def pair_overlap(n, m, over: int, under: int):
    """Common elements with which sets of n and m link."""
    return -(-over * (n + m) // (over + under))


def _ordered(of: np.ndarray, grams: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's n-grams, which come sorted, by their count and then by hash."""
    counts, grams = sketch[_bucket(grams)], grams.copy()
    edges = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
    for begin, end in zip(edges, edges[1:]):
        grams[begin:end] = grams[begin:end][np.argsort(counts[begin:end], kind="stable")]
    return of, grams


def path_heads(documents: DataFrame, text: str, words: int, shared: Broadcast, over: int, under: int,
               only: Broadcast | None = None) -> DataFrame:
    """(token, set_key, n): the first n-grams of every path, as many as two similar sets must share some of.

    With ``only``, a bitmap, no others than those n-grams.  Narrow.
    """
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch, "text"):
                of, grams = shingle_sets(step.column("text"), words)
                size, keys = _set_keys(of, grams, step.num_rows)
                of, grams = _ordered(of, grams, shared.value)
                head = size - least_overlap(size, over, under) + 1 + size // EXTRA
                place = np.arange(len(of)) - (np.cumsum(size) - size)[of]
                # A set that no other set can match has no candidates.
                able = np.zeros(len(size), bool)
                for other in (size - 1, size, size + 1):
                    able |= pair_overlap(size, other, over, under) <= np.minimum(size, other) - (other == size)
                shown = np.flatnonzero((place < head[of]) & able[of])
                if only is not None:
                    shown = shown[holds(only.value, grams[shown])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams[shown].view(np.int64)), pa.array(keys[of[shown]]), pa.array(size[of[shown]], pa.int64())],
                    names=["token", "set_key", "n"])

    return documents.select(F.col(f"`{text}`").alias("text")).mapInArrow(emit, "token long, set_key long, n long")


def full_paths(documents: DataFrame, wanted: DataFrame, key: str, text: str, words: int, shared: Broadcast) -> DataFrame:
    """(set_key, path) of the wanted (id, set_key): all n-grams in global order, 8 bytes each.

    Texts are not shuffled: a bitmap of the wanted sets lets their paths
    through, and the exact join follows on those.
    """
    rows = documents.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    marked = documents.sparkSession.sparkContext.broadcast(bitmap(wanted, "set_key", SET_BITS))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch, "text"):
                of, grams = shingle_sets(step.column("text"), words)
                size, keys = _set_keys(of, grams, step.num_rows)
                chosen = np.flatnonzero(holds(marked.value, keys) & (size > 0))
                of, grams = _ordered(of, grams, shared.value)
                raw, end = grams.astype(">u8"), np.cumsum(size)
                yield pa.RecordBatch.from_arrays(
                    [step.column("id").take(pa.array(chosen)), pa.array(keys[chosen]),
                     pa.array([raw[end[i] - size[i]:end[i]].tobytes() for i in chosen], pa.binary())],
                    names=["id", "p_key", "path"])

    found = rows.mapInArrow(emit, f"id {kind}, p_key long, path binary")
    return found.join(wanted.hint("merge"), "id").filter("p_key = set_key").select("set_key", "path")


class Tree:
    """The prefix tree of some paths, ``step`` elements to a node, level by level.

    Sorted paths that agree up to a level share its node, so a node is a run of
    rows; its elements are counted against a query once for all of them.
    """

    def __init__(self, paths: list[np.ndarray], over: int, under: int, step: int = 16) -> None:
        self.over, self.under = over, under
        sizes = np.array([len(p) for p in paths], np.int64)
        width = max(step, -(-int(sizes.max(initial=1)) // step) * step)
        table = np.zeros((len(paths), width), np.uint64)
        table[np.arange(width) < sizes[:, None]] = np.concatenate(paths) if len(paths) else []
        order = np.lexsort(table[:, ::-1].T) if len(paths) < 3 else np.argsort(
            np.ascontiguousarray(table.astype(">u8")).view(f"S{width * 8}")[:, 0], kind="stable")
        table, self.sizes, self.order = table[order], sizes[order], order
        differs = np.full(len(paths), -1)
        if len(paths) > 1:
            unequal = table[1:] != table[:-1]
            differs[1:] = np.where(unequal.any(1), unequal.argmax(1), width)
        #: Per level: elements of the nodes, node above, smallest and largest set below, node of each row.
        self.levels = []
        above = np.zeros(len(paths), np.int64)
        for begin in range(0, width, step):
            first = np.flatnonzero(differs < begin + step)
            row_node = np.zeros(len(paths), np.int64)
            row_node[first] = 1
            row_node = np.cumsum(row_node) - 1
            self.levels.append((
                table[first, begin:begin + step], above[first], np.minimum.reduceat(self.sizes, first),
                np.maximum.reduceat(self.sizes, first), begin + step))
            above = row_node
        self.leaf = above

    def links(self, query: np.ndarray) -> np.ndarray:
        """Positions, in the list given, of the paths that reach the threshold with the query."""
        query = np.sort(query)
        overlap, alive = np.zeros(1, np.int64), np.ones(1, bool)
        for elements, above, least, most, depth in self.levels:
            seen = np.flatnonzero(alive[above])
            count = np.zeros(len(above), np.int64)
            part = elements[seen]
            at = np.minimum(np.searchsorted(query, part), len(query) - 1)
            count[seen] = overlap[above[seen]] + ((query[at] == part) & (part != 0)).sum(1)
            # A subtree is left if not even all that remains of its longest path is enough for its smallest set.
            need = pair_overlap(len(query), least, self.over, self.under)
            alive = alive[above] & (count + np.maximum(most - depth, 0) >= need)
            overlap = count
        reached = alive[self.leaf] & (overlap[self.leaf] >= pair_overlap(len(query), self.sizes, self.over, self.under))
        return self.order[reached]


def _rows_by_query(pairs: DataFrame, paths: DataFrame) -> DataFrame:
    """(a, salt, b, path) dealt by a and salt and sorted: the path of ``a`` first (b null), then those of its b.

    Salts keep what meets at GROUP n-grams or so, whatever the number of pairs.
    """
    sized = pairs.join(paths.select(F.col("set_key").alias("b"), (F.length("path") / 8).alias("size")).hint("merge"), "b")
    counts = sized.groupBy("a").agg(F.sum("size").alias("n"))
    salted = pairs.join(counts.hint("merge"), "a").select(
        "a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / GROUP)).cast("int").alias("salt"))
    salted = written(salted, "ngram-pairs")
    asked = salted.select("a", "salt").distinct().join(paths.hint("merge"), F.col("a") == F.col("set_key")).select(
        "a", "salt", F.lit(None).cast("long").alias("b"), "path")
    found = salted.join(paths.hint("merge"), F.col("b") == F.col("set_key")).select("a", "salt", "b", "path")
    return asked.unionByName(found).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").isNotNull(), "b")


def _by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[int], list[np.ndarray]]]:
    """(a, salt, set keys, paths) of each group of rows; the query is the first."""
    now, keys, paths = None, [], []
    for batch in batches:
        for a, salt, b, path in zip(batch.column("a").to_pylist(), batch.column("salt").to_pylist(),
                                    batch.column("b").to_pylist(), batch.column("path")):
            if (a, salt) != now:
                if now:
                    yield *now, keys, paths
                now, keys, paths = (a, salt), [], []
            if not keys or b is not None:  # a set under two equal rows is one query
                keys.append(a if b is None else b)
                paths.append(np.frombuffer(path.as_buffer(), ">u8").astype(np.uint64))
    if now:
        yield *now, keys, paths


def verified(pairs: DataFrame, paths: DataFrame, over: int, under: int) -> DataFrame:
    """The pairs (a, b) whose sets link: a walks through the tree of its candidates."""
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, _, keys, paths_ in _by_group(batches):
            hit = Tree(paths_[1:], over, under).links(paths_[0]) if len(keys) > 1 else []
            if len(hit):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a] * len(hit), pa.int64()), pa.array([keys[1 + i] for i in hit], pa.int64())], names=["a", "b"])

    return _rows_by_query(pairs, paths).mapInArrow(walk, "a long, b long")


def star_links(stars: DataFrame, paths: DataFrame, over: int, under: int) -> DataFrame:
    """(a, b, settled): links that join each group (leader a, sets b) as its sets' similarities do.

    The leader walks through the tree of the group, then every set that is not
    joined to it yet.  What is joined is not compared again and only links that
    join are returned, so neither the links nor the rows sent are pairs.  All
    pairs of a group and salt are settled afterwards; rows (b, null, group) tell
    in which group a set was.
    """
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, salt, keys, paths_ in _by_group(batches):
            root = list(range(len(keys)))

            def find(x: int) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            tree, made = Tree(paths_, over, under), []
            for u in range(len(keys)):
                if u and find(u) == find(0):
                    continue
                for v in tree.links(paths_[u]).tolist():
                    x, y = find(u), find(v)
                    if x != y:
                        root[max(x, y)] = min(x, y)
                        made.append((keys[u], keys[v], None))
            group = int(mixed(np.array([a], np.int64).view(np.uint64) + np.uint64(salt)).view(np.int64)[0])
            made += [(b, None, group) for b in keys[1:]]
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*made)], names=["a", "b", "settled"])

    return _rows_by_query(stars, paths).mapInArrow(join, "a long, b long, settled long")


def _needed(n: Column, m: Column, over: int, under: int) -> Column:
    """Shared n-grams, among those left, of two sets of n and m that link; at least one."""
    given_up = F.greatest(_given_up(n, over, under), _given_up(m, over, under))
    return F.greatest(F.lit(1) + F.floor(F.least(n, m) / EXTRA) - given_up, F.lit(1))


def _given_up(n: Column, over: int, under: int) -> Column:
    return F.floor(F.floor(n * over / under) / (2 * EXTRA))


def jaccard_components(documents: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, over: int = 4,
                       under: int = 5) -> DataFrame:
    """(key, n_shingles, component_id): groups of texts whose n-gram sets link, directly or through others.

    Two texts link when intersection / union of their sets of distinct word
    n-grams is at least over / under.  Words are compared in lower case (A to
    Z).  A text of fewer words is one n-gram; a null, empty or blank text has an
    empty set, is linked with nothing and has component itself.  The component
    is the smallest key in it.  Equal sets are one node.  Rows that repeat a key
    are rows of their own with the component of their own set; a row with a null
    key has the component of an equal text with a key, else null.  Other columns
    are not read; an empty table gives no row.  The answer is exact but for equal 64-bit hashes.
    """
    spark = documents.sparkSession
    sets, sketch = set_table(documents, key, text, words)
    shared = spark.sparkContext.broadcast(sketch)
    filled = sets.filter("n > 0")
    firsts = written(filled.groupBy("set_key").agg(F.min("id").alias("first"), F.min("n").alias("n")), "ngram-firsts")

    tokens = written(
        path_heads(documents, text, words, shared, over, under).groupBy("token")
        .agg(F.min("set_key").alias("least"), F.max("set_key").alias("most"), F.count(F.lit(1)).alias("rows"))
        .filter("least <> most").select("token", "rows"), "ngram-tokens")
    several = spark.sparkContext.broadcast(bitmap(tokens, "token", TOKEN_BITS))
    heads = path_heads(documents, text, words, shared, over, under, several).groupBy("token", "set_key").agg(F.min("n").alias("n"))
    heads = written(heads, "ngram-heads").join(tokens.hint("merge"), "token")
    heads = written(_left(heads, over, under), "ngram-left")

    # The set whose n-grams most others have: the original of copies that differ more from each other than from it.
    leaders = heads.groupBy("token").agg(
        F.min("set_key").alias("least"), F.max("set_key").alias("most"), F.max_by("set_key", "score").alias("leader"))
    leaders = written(leaders.filter("least <> most").select("token", "leader"), "ngram-leaders")
    heads = written(heads.join(leaders.hint("merge"), "token"), "ngram-shared")
    able = written(heads.select("set_key").distinct(), "ngram-able")
    paths = written(full_paths(
        documents, able.join(firsts.hint("merge"), "set_key").select(F.col("first").alias("id"), "set_key"), key, text, words, shared),
        "ngram-paths")

    # First every set with the leader of its that it shares most with, then what is still apart.
    stars = heads.filter("set_key <> leader").groupBy("set_key", "leader").agg(F.count(F.lit(1)).alias("c"))
    stars = stars.groupBy("set_key").agg(F.max(F.struct("c", "leader")).alias("best"))
    stars = written(stars.select(F.col("best.leader").alias("a"), F.col("set_key").alias("b")), "ngram-stars")
    made = written(star_links(stars, paths, over, under), "ngram-links")
    links = made.filter("b IS NOT NULL").select("a", "b")
    joined = written(connected_components(links), "ngram-joined")
    settled = made.filter("b IS NULL").select(F.col("a").alias("set_key"), "settled")
    apart = _apart(heads, joined, settled, over, under)
    more = written(verified(apart, paths, over, under), "ngram-more")
    if more.limit(1).count():
        joined = written(connected_components(links.unionByName(more)), "ngram-components")
    return _labelled(sets, firsts, joined).select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id")


def _left(heads: DataFrame, over: int, under: int) -> DataFrame:
    """(token, set_key, n, score) without the n-grams of each path that most sets have.

    Two sets that link share one n-gram more than 1 / EXTRA of the smaller near
    the root.  Each gives up fewer than half as many, always those with most
    rows, so they still share what is counted in ``_needed``: a passage that
    thousands of texts quote does not make pairs of them.  Sets with too few
    left to link with any partner go.
    """
    of_set = Window.partitionBy("set_key")
    ranked = heads.withColumn("rank", F.row_number().over(of_set.orderBy(F.desc("rows"), "token")))
    left = ranked.filter(F.col("rank") > _given_up(F.col("n"), over, under))
    left = left.withColumn("left", F.count(F.lit(1)).over(of_set)).withColumn("score", F.sum("rows").over(of_set))
    least, most = F.floor(F.col("n") * over / under), F.floor(F.col("n") * under / over)
    return left.filter(F.col("left") >= F.greatest(
        F.lit(1) + F.floor(least / EXTRA) - _given_up(most, over, under), F.lit(1))).select("token", "set_key", "n", "score")


def _apart(heads: DataFrame, joined: DataFrame, settled: DataFrame, over: int, under: int) -> DataFrame:
    """Pairs (a, b) of different components, not settled in a group, that share enough n-grams near the root to link."""
    named = heads.select("token", "set_key", "n").join(joined.withColumnRenamed("node", "set_key").hint("merge"), "set_key", "left")
    named = written(named.join(settled.hint("merge"), "set_key", "left").select(
        "token", "set_key", "n", F.coalesce("component", "set_key").alias("component"),
        F.coalesce("settled", "set_key").alias("settled")), "ngram-named")
    groups = written(named.groupBy("token", "settled").agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.min("component").alias("x"), F.max("component").alias("y")), "ngram-groups")
    # Only n-grams of several groups and several components are left.
    several = groups.groupBy("token").agg(
        F.min("settled").alias("f"), F.max("settled").alias("g"), F.min("x").alias("x"), F.max("y").alias("y")).filter(
        "f <> g AND x <> y").select("token")
    several = written(several, "ngram-several")
    groups = written(groups.join(several.hint("merge"), "token"), "ngram-several-groups")
    named = written(named.join(several.hint("merge"), "token"), "ngram-several-rows")
    # Rows meet the other groups of their n-gram, then only those groups' rows.
    other = groups.select("token", F.col("settled").alias("other"), "least", "most", "x", "y")
    facing = named.join(other.hint("merge"), "token").filter(
        (F.col("settled") < F.col("other")) & ((F.col("component") != F.col("x")) | (F.col("component") != F.col("y")))
        & (F.col("n") * under >= F.col("least") * over) & (F.col("most") * under >= F.col("n") * over))
    partner = named.select("token", F.col("settled").alias("other"), F.col("component").alias("its"), F.col("set_key").alias("partner"),
                           F.col("n").alias("m"))
    met = facing.join(partner.hint("merge"), ["token", "other"]).filter(
        (F.col("component") != F.col("its")) & (F.col("n") * under >= F.col("m") * over) & (F.col("m") * under >= F.col("n") * over))
    pairs = met.groupBy("set_key", "partner").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("n"), F.min("m").alias("m"))
    return written(pairs.filter(F.col("c") >= _needed(F.col("n"), F.col("m"), over, under)).select(
        F.col("set_key").alias("a"), F.col("partner").alias("b")), "ngram-apart")


def _labelled(sets: DataFrame, firsts: DataFrame, joined: DataFrame) -> DataFrame:
    """Component of every row: the smallest id over all sets of its component."""
    named = written(firsts.join(joined.withColumnRenamed("node", "set_key").hint("merge"), "set_key", "left").select(
        "set_key", "first", F.coalesce("component", "set_key").alias("component")), "ngram-labels")
    smallest = written(named.groupBy("component").agg(F.min("first").alias("component_id")), "ngram-smallest")
    of = written(named.join(smallest.hint("merge"), "component").select("set_key", "component_id"), "ngram-of-set")
    rows = sets.withColumn("set_key", F.when(F.col("n") > 0, F.col("set_key")))
    return rows.join(of.hint("merge"), "set_key", "left").select("id", "n", F.coalesce("component_id", "id").alias("component_id"))


def one_per_component(documents: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, over: int = 4,
                      under: int = 5) -> DataFrame:
    """The documents whose key names their component; all columns as they were.  Null keys stay."""
    named = jaccard_components(documents, key, text, words, over, under)
    later = written(named.filter(F.col(key) != F.col("component_id")).select(F.col(key).alias("__later")).distinct(), "ngram-later")
    return documents.join(later.hint("merge"), F.col(f"`{key}`") == F.col("__later"), "left_anti")
