"""Distributed similarity search over vectors.

Work is cut into *tiles*: a bounded block of rows against another bounded
block.  One task multiplies two blocks and emits only the pairs that pass, so
neither a hot group nor the full pair set is ever held or emitted.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.storage import written
from ..functions.vector import CANDIDATE_MARGIN, as_list_column, as_matrix, unit_rows

PAIR_SCHEMA = "id_1 string, id_2 string, similarity double"
BLOCK_ROWS = 4096
MAX_PARTS = 50_000
PIVOTS = 8192  # of one level: rows on the driver or in a task
FIRST_PIVOTS = 1024  # of the first level, while their square covers the cells needed
DEEP_BLOCKS = 4  # a cell of more blocks than this gets pivots of its own


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows of one key out of batches sorted by key.

    Only the open group is buffered; tiles bound its size.
    """
    held: list[pa.Table] = []
    held_key = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows - 1, dtype=bool)
        for column in columns:
            change |= column[1:] != column[:-1]
        starts = np.concatenate([[0], np.flatnonzero(change) + 1, [batch.num_rows]])
        table = pa.Table.from_batches([batch])
        for begin, end in zip(starts[:-1], starts[1:]):
            key = tuple(column[begin] for column in columns)
            if held and key != held_key:
                yield pa.concat_tables(held).combine_chunks()
                held = []
            held_key = key
            held.append(table.slice(begin, end - begin))
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _by_tile(rows: DataFrame, keys: list[str], compare: Callable, schema: str, blocks: int = 1) -> DataFrame:
    """Run ``compare`` once per tile of rows carrying ``keys``.

    ``blocks`` is the number of blocks of rows at hand; with more of them than
    shuffle partitions the number of parts follows the data.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, keys):
            if group.num_rows > 1:
                yield from compare(group)

    # a stated number keeps small but compute-heavy tiles on separate tasks
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(blocks, MAX_PARTS))
    return rows.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _bucket(key: Column, buckets: Column) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("tile")), buckets).cast("int")


HOT_CELLS = 1_000_000  # rows of 24 bytes; more of them are joined by a shuffle


def tiles(cells: DataFrame, block_rows: int, rows: int | None = None) -> DataFrame:
    """Place every row in the tiles it takes part in.

    ``cells``: cell long, visitor boolean, id, vector and any other columns.
    Residents of a cell meet each other, visitors meet residents.  An ordinary
    cell is one tile and its rows are sent once.  A cell with more than
    ``block_rows`` residents or visitors is split by hash into sub-blocks that
    meet pairwise, so a hot cell becomes many bounded tiles.  ``rows`` is the
    number of rows if known: up to one block of them, no cell can be hot.
    """
    if rows is not None and rows <= block_rows:
        return cells.select("*", F.lit(0).alias("_mine"), F.lit("whole").alias("kind"),
                            F.lit(0).alias("a"), F.lit(0).alias("b"))
    hot = written(
        cells.groupBy("cell")
        .agg(F.count_if(~F.col("visitor")).alias("_r"), F.count_if("visitor").alias("_v"))
        .filter((F.col("_r") > block_rows) | (F.col("_v") > block_rows))
        .select(
            "cell", F.ceil(F.col("_r") / block_rows).cast("int").alias("_rs"),
            F.ceil(F.col("_v") / block_rows).cast("int").alias("_vs"),
        ),
        "hot-cells",
    )
    if hot.count() <= HOT_CELLS:
        hot = F.broadcast(hot)
    none = F.array().cast("array<int>")

    def blocks(name: str) -> Column:
        return F.when(F.col(name) > 0, F.sequence(F.lit(0), F.greatest(F.lit(0), F.col(name) - 1))).otherwise(none)

    def tile(kind: str, a: Column, b: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), a.cast("int").alias("a"), b.cast("int").alias("b"))

    own = F.when(F.col("visitor"), F.col("_vs")).otherwise(F.col("_rs"))
    mine = F.coalesce(_bucket(F.col("id"), F.nullif(own, F.lit(0))), F.lit(0))
    as_visitor = F.transform(blocks("_rs"), lambda r: tile("visit", F.col("_mine"), r))
    among = F.transform(
        blocks("_rs"), lambda r: tile("home", F.least(F.col("_mine"), r), F.greatest(F.col("_mine"), r)))
    met = F.transform(blocks("_vs"), lambda v: tile("visit", v, F.col("_mine")))
    whole = F.array(tile("whole", F.lit(0), F.lit(0)))
    places = (
        F.when(F.col("_rs").isNull(), whole).when(F.col("visitor"), as_visitor).otherwise(F.concat(among, met))
    )
    return (
        cells.join(hot, "cell", "left").withColumn("_mine", mine)
        # outer: an inferred filter would build every list twice
        .withColumn("_tile", F.explode_outer(places)).filter("_tile IS NOT NULL")
        .select("*", F.col("_tile.kind").alias("kind"), F.col("_tile.a").alias("a"), F.col("_tile.b").alias("b"))
        .drop("_tile", "_rs", "_vs")
    )


TILE_KEYS = ["cell", "kind", "a", "b"]


#: Numbers of either side that are gathered at once for exact scores (16 MB).
SCORED = 1 << 21
#: Rows of a block that a strip of the other meets at once (8 MB of products).
MET_COLUMNS = 2048


def _passing(left: np.ndarray, right: np.ndarray, threshold: float):
    """Index pairs with cosine >= threshold and their float64 scores.

    A block of near copies has as many candidates as products; their vectors are
    gathered a bounded number at a time.
    """
    rough = left.astype(np.float32) @ right.astype(np.float32).T
    i, j = np.divmod(np.flatnonzero(rough >= threshold - CANDIDATE_MARGIN), max(1, len(right)))
    exact, step = np.empty(len(i)), max(1, SCORED // max(1, left.shape[1]))
    for k in range(0, len(i), step):
        exact[k:k + step] = np.einsum("nd,nd->n", left[i[k:k + step]], right[j[k:k + step]])
    keep = exact >= threshold
    return i[keep], j[keep], exact[keep]


def _pair_batches(ids_1, ids_2, scores, step: int = 65536) -> Iterator[pa.RecordBatch]:
    swap = ids_1 > ids_2
    low, high = np.where(swap, ids_2, ids_1), np.where(swap, ids_1, ids_2)
    for k in range(0, len(scores), step):
        part = slice(k, k + step)
        yield pa.RecordBatch.from_arrays(
            [pa.array(low[part], pa.string()), pa.array(high[part], pa.string()), pa.array(scores[part])],
            names=["id_1", "id_2", "similarity"],
        )


def _packed(matrix: np.ndarray) -> pa.Array:
    """Rows as compressed bytes behind a letter for their kind, without loss: a row of term counts has few different values."""
    kind = matrix.dtype.char if matrix.dtype.char in "fd" else "d"
    return pa.array([kind.encode() + zlib.compress(row.tobytes()) for row in np.ascontiguousarray(matrix, kind)], pa.binary())


def _unpacked(column: pa.ChunkedArray) -> np.ndarray:
    """The matrix of a list column or of packed vectors."""
    if not pa.types.is_binary(column.type):
        return as_matrix(column)
    return np.stack([np.frombuffer(zlib.decompress(row[1:]), chr(row[0])) for row in column.to_pylist()])


def _tile_pairs(group: pa.Table, threshold: float, accept: Callable | None = None, strip: int = 1024):
    """Passing pairs of one tile as index arrays (p, q, similarity), strip by strip."""
    vectors = unit_rows(_unpacked(group["vector"]))
    visitor = group["visitor"].to_numpy().astype(bool)
    mine = group["_mine"].to_numpy()
    kind, a, b = group["kind"][0].as_py(), group["a"][0].as_py(), group["b"][0].as_py()
    extra = np.stack([np.frombuffer(row, np.int32) for row in group["bands"].to_pylist()]) if "bands" in group.column_names else None
    residents, visitors = np.flatnonzero(~visitor), np.flatnonzero(visitor)
    if kind == "whole":
        jobs = [(residents, residents), (visitors, residents)]
    elif kind == "visit":
        jobs = [(visitors, residents)]
    elif a == b:
        jobs = [(residents, residents)]
    else:
        jobs = [(np.flatnonzero(mine == a), np.flatnonzero(mine == b))]
    for left, right in jobs:
        for start in range(0, len(left), strip):
            rows = left[start:start + strip]
            # within one block only later rows are partners
            for begin in range(start if left is right else 0, len(right), MET_COLUMNS):
                partners = right[begin:begin + MET_COLUMNS]
                i, j, scores = _passing(vectors[rows], vectors[partners], threshold)
                p, q = rows[i], partners[j]
                if left is right:
                    once = p < q
                    p, q, scores = p[once], q[once], scores[once]
                if accept is not None and len(p):
                    ok = accept(extra[p], extra[q], group["cell"][0].as_py())
                    p, q, scores = p[ok], q[ok], scores[ok]
                if len(p):
                    yield p, q, scores


def _ids(group: pa.Table) -> np.ndarray:
    return np.asarray(group["id"].to_pylist(), dtype=object)


def _emit_pairs(threshold: float, accept: Callable | None = None) -> Callable:
    def compare(group: pa.Table) -> Iterator[pa.RecordBatch]:
        ids = _ids(group)
        for p, q, scores in _tile_pairs(group, threshold, accept):
            yield from _pair_batches(ids[p], ids[q], scores)

    return compare


def _emit_weights(threshold: float) -> Callable:
    """Per tile and point, the summed ``mark`` of its neighbours in the tile."""

    def compare(group: pa.Table) -> Iterator[pa.RecordBatch]:
        mark = group["mark"].to_numpy().astype(np.float64)
        near = np.zeros(group.num_rows)
        for p, q, _ in _tile_pairs(group, threshold):
            near += np.bincount(p, mark[q], len(near)) + np.bincount(q, mark[p], len(near))
        seen = np.flatnonzero(near)
        yield pa.RecordBatch.from_arrays(
            [group["id"].combine_chunks().take(pa.array(seen)), pa.array(near[seen].astype(np.int64))],
            names=["id", "near"])

    return compare


def _merge(parent: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
    """Join the sets of every pair (p, q) in place; the smaller index leads a set."""
    while True:
        a, b = parent[p], parent[q]
        apart = a != b
        if not apart.any():
            return
        p, q, a, b = p[apart], q[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:  # point every member at its leader
            jumped = parent[parent]
            if np.array_equal(jumped, parent):
                break
            parent[:] = jumped


def _emit_links(threshold: float) -> Callable:
    """Per tile, links that keep its connections: core to core, border to core.

    ``mark`` is 1 for core points.  Cores joined inside the tile are linked to
    one of them, and a border point is linked once to each such set, so a dense
    tile emits about one row per point instead of one per pair.
    """

    def compare(group: pa.Table) -> Iterator[pa.RecordBatch]:
        core = group["mark"].to_numpy().astype(bool)
        parent = np.arange(group.num_rows)
        touches = [np.zeros((0, 2), dtype=np.int64)]
        for p, q, _ in _tile_pairs(group, threshold):
            both = core[p] & core[q]
            _merge(parent, p[both], q[both])
            for border, centre in ((p, q), (q, p)):
                mixed = ~core[border] & core[centre]
                pair = np.stack([border[mixed], parent[centre[mixed]]], axis=1)
                touches.append(np.unique(pair, axis=0))
        touch = np.concatenate(touches)
        touch = np.unique(np.stack([touch[:, 0], parent[touch[:, 1]]], axis=1), axis=0)
        joined = np.flatnonzero(parent != np.arange(len(parent)))
        a, b = np.concatenate([joined, touch[:, 0]]), np.concatenate([parent[joined], touch[:, 1]])
        ids = group["id"].combine_chunks()
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(a)), ids.take(pa.array(b)), pa.array(np.arange(len(a)) < len(joined))],
            names=["a", "b", "among_cores"])

    return compare


def _pivots(vectors: DataFrame, count: int) -> np.ndarray:
    """A bounded, repeatable sample of vectors (at most ``count`` rows)."""
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(count).select("vector").collect()
    return unit_rows(np.asarray([r["vector"] for r in rows], dtype=np.float64)) if rows else np.zeros((0, 1))


#: Rows that meet the pivots at once, and rows of a batch that goes out: a row may go to every cell.
MET_ROWS = 1024
SENT_ROWS = 4096


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches, a bounded number at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, MET_ROWS):
            yield batch.slice(at, MET_ROWS)


def _sent(part: pa.RecordBatch, who: np.ndarray, place: dict[str, np.ndarray], carried: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows ``who`` of ``part`` with their ``place``, a bounded number at a time."""
    for at in range(0, len(who), SENT_ROWS):
        some = slice(at, at + SENT_ROWS)
        take = pa.array(who[some])
        yield pa.RecordBatch.from_arrays(
            [*[pa.array(v[some]) for v in place.values()], *[part.column(c).take(take) for c in carried]], names=[*place, *carried])


def _nearest(batch: pa.RecordBatch, pivots: np.ndarray):
    """Cosine to every pivot and the index of the nearest one, per row."""
    cosine = unit_rows(as_matrix(batch.column("vector"))) @ pivots.T
    return cosine, cosine.argmax(axis=1)


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def _measured(vectors: DataFrame, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pivots that have residents, widest cell first, and each cell's angular radius and rows.

    One row per pivot comes back to the driver; pivots are bounded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        widest, rows = np.full(len(pivots), -1.0), np.zeros(len(pivots), np.int64)
        for part in _parts(batches):
            cosine, home = _nearest(part, pivots)
            np.maximum.at(widest, home, _angle(cosine[np.arange(len(home)), home]))
            rows += np.bincount(home, minlength=len(rows))
        used = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(widest[used]), pa.array(rows[used])], names=["cell", "radius", "rows"])

    found = (
        vectors.select("vector").mapInArrow(run, "cell long, radius double, rows long")
        .groupBy("cell").agg(F.max("radius").alias("radius"), F.sum("rows").alias("rows")).orderBy(F.desc("radius"), "cell").collect()
    )
    return pivots[[r["cell"] for r in found]], np.asarray([r["radius"] for r in found]), np.asarray([r["rows"] for r in found], np.int64)


def _assign_cells(
    vectors: DataFrame, pivots: np.ndarray, radii: np.ndarray, threshold: float, visits: bool = True
) -> DataFrame:
    """Give every vector its home cell and the later cells it must visit.

    A visit is left out only when no partner can be there, by either bound:
    - if x is nearest to pivot i and y to pivot j, their distance is at least
      that of x to the plane between i and j, (cos(x,i) - cos(x,j)) / |i - j|;
    - all residents of j lie within the cell's radius, so x must lie within
      that radius plus the angle of the threshold.
    Cells are ordered widest first: vectors visit the tighter of two cells.
    Without ``visits`` only home cells are given.
    """
    reach = np.sqrt(max(0.0, 2.0 - 2.0 * threshold)) + 1e-6
    limits = np.cos(np.minimum(np.pi, radii + np.arccos(threshold) + 1e-6))
    spread = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * pivots @ pivots.T))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            cosine, home = _nearest(part, pivots)
            rows = np.arange(len(home))
            who = where = np.zeros(0, np.int64)
            if visits:
                gap = cosine[rows, home][:, None] - cosine
                goes = (gap <= reach * spread[home] + 1e-6) & (cosine >= limits[None, :] - 1e-9)
                goes &= np.arange(len(pivots))[None, :] > home[:, None]
                who, where = np.nonzero(goes)
            place = {
                "cell": np.concatenate([home, where]).astype(np.int64),
                "visitor": np.concatenate([np.zeros(len(rows), bool), np.ones(len(who), bool)]),
            }
            yield from _sent(part, np.concatenate([rows, who]), place, carried)

    carried = [name for name in ("id", "vector", "mark") if name in vectors.columns]
    kinds = [f"{name} {vectors.schema[name].dataType.simpleString()}" for name in carried]
    return vectors.select(*carried).mapInArrow(run, ", ".join(["cell long, visitor boolean", *kinds]))


class _DeepCells:
    """The second level: cells of many blocks get pivots of their own.

    Pivots are rows like others, drawn by a hash of the id at one per block, and
    stay in a table: what a task holds are the pivots of one cell, at most
    PIVOTS of them.  A cell's rows are dealt over several tasks by salt, and its
    pivots go to each of them.
    """

    SUB_BITS = 20

    def __init__(self, vectors: DataFrame, pivots: np.ndarray, radii: np.ndarray, sizes: np.ndarray, block_rows: int):
        # Per deep cell: the share of its rows to draw as pivots, and over how many tasks its rows go.  At most PIVOTS rows.
        deep = [
            (int(c), float(min(PIVOTS, -(-sizes[c] // block_rows)) / sizes[c]), int(-(-sizes[c] // (64 * block_rows))))
            for c in np.flatnonzero(sizes > DEEP_BLOCKS * block_rows)
        ]
        self.deep = F.broadcast(vectors.sparkSession.createDataFrame(deep, "cell long, share double, salts int"))
        homes = _assign_cells(vectors.select("id", "vector"), pivots, radii, 1.0, visits=False).join(self.deep.drop("salts"), "cell")
        drawn = F.pmod(F.xxhash64("id", F.lit("pivot")), F.lit(1 << 40)) < F.col("share") * float(1 << 40)
        self.pivots = written(homes.filter(drawn).select("cell", F.xxhash64("id").alias("sub"), "vector"), "deep-pivots")
        measured = self._met(homes.select("cell", "visitor", "id", "vector"), None)
        self.radii = written(measured.groupBy("cell", "sub").agg(F.max("radius").alias("radius")), "deep-radii")

    def placed(self, rows: DataFrame, threshold: float) -> DataFrame:
        """Rows (cell, visitor, …) of deep cells in sub-cells, and those of other cells as they are."""
        whole = rows.join(self.deep, "cell", "left_anti").withColumn("cell", F.shiftleft("cell", self.SUB_BITS))
        return whole.unionByName(self._met(rows.join(self.deep.select("cell"), "cell", "left_semi"), threshold))

    def _met(self, rows: DataFrame, threshold: float | None) -> DataFrame:
        """Rows meet the pivots of their cell: for the sub-cells to be in, or, without a threshold, for the radii of these."""
        carried = [c for c in rows.columns if c not in ("cell", "visitor")]
        pivots = self.pivots.withColumn("radius", F.lit(0.0)) if threshold is None else self.pivots.join(
            self.radii.hint("merge"), ["cell", "sub"])
        pivots = pivots.join(self.deep.drop("share"), "cell").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        empty = {c: F.lit(None).cast(rows.schema[c].dataType) for c in ("visitor", *carried) if c != "vector"}
        rows = rows.join(self.deep.drop("share"), "cell").withColumn("salt", F.pmod(F.xxhash64("id"), "salts").cast("int"))
        both = pivots.select("cell", "salt", F.lit(False).alias("is_row"), "sub", "radius", "vector", *[v.alias(c) for c, v in empty.items()])
        both = both.unionByName(rows.select(
            "cell", "salt", F.lit(True).alias("is_row"), F.lit(None).cast("long").alias("sub"), F.lit(None).cast("double").alias("radius"),
            "vector", *empty))
        dealt = both.repartition("cell", "salt").sortWithinPartitions("cell", "salt", "is_row", "sub")
        if threshold is None:
            return dealt.mapInArrow(_measure_deep, "cell long, sub long, radius double")
        kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in carried]
        return dealt.mapInArrow(_place_deep(threshold, carried, self.SUB_BITS), ", ".join(["cell long, visitor boolean", *kinds]))


def _cell_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table | None, pa.RecordBatch]]:
    """(cell, pivots, rows): the rows of a cell and salt, batch by batch, with the pivots that came before them."""
    now, pivots = None, []
    for batch in batches:
        keys = list(zip(batch.column("cell").to_pylist(), batch.column("salt").to_pylist(), batch.column("is_row").to_pylist()))
        edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        for begin, end in zip(edges, edges[1:]):
            if begin == end:
                continue
            part, (cell, salt, is_row) = batch.slice(begin, end - begin), keys[begin]
            if (cell, salt) != now:
                now, pivots = (cell, salt), []
            if is_row:
                if len(pivots) > 1:
                    pivots = [pa.concat_tables(pivots).combine_chunks()]
                yield cell, pivots[0] if pivots else None, part
            else:
                pivots.append(pa.Table.from_batches([part]))


def _measure_deep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for cell, pivots, rows in _cell_runs(batches):
        if pivots is not None:
            unit, widest = unit_rows(as_matrix(pivots["vector"])), np.full(pivots.num_rows, -1.0)
            for part in _parts([rows]):
                cosine, home = _nearest(part, unit)
                np.maximum.at(widest, home, _angle(cosine[np.arange(len(home)), home]))
            used = np.flatnonzero(widest >= 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used), cell)), pivots["sub"].combine_chunks().take(pa.array(used)), pa.array(widest[used])],
                names=["cell", "sub", "radius"])


def _place_deep(threshold: float, carried: list[str], bits: int) -> Callable:
    """Residents go to the sub-cell of their nearest pivot and to the tighter ones that may hold a partner, visitors to all of those.

    The bounds are those of ``_assign_cells``; both hold for a visitor too.
    """
    reach = np.sqrt(max(0.0, 2.0 - 2.0 * threshold)) + 1e-6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for cell, table, rows in _cell_runs(batches):
            if table is None:  # no pivot drawn: the cell stays whole
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(rows.num_rows, cell << bits)), rows.column("visitor"), *[rows.column(c) for c in carried]],
                    names=["cell", "visitor", *carried])
                continue
            if held is not table:
                held = table
                pivots, radii = unit_rows(as_matrix(table["vector"])), table["radius"].to_numpy()
                limits = np.cos(np.minimum(np.pi, radii + np.arccos(threshold) + 1e-6))
                rank = np.lexsort((np.arange(len(radii)), -radii)).argsort()  # widest first
            for part in _parts([rows]):
                cosine, home = _nearest(part, pivots)
                row = np.arange(len(home))
                apart = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * pivots[home] @ pivots.T))
                goes = (cosine[row, home][:, None] - cosine <= reach * apart + 1e-6) & (cosine >= limits[None, :] - 1e-9)
                visitor = part.column("visitor").to_numpy(zero_copy_only=False).astype(bool)
                goes &= visitor[:, None] | (rank[None, :] > rank[home][:, None])
                goes[row[~visitor], home[~visitor]] = True
                who, where = np.nonzero(goes)
                place = {"cell": (cell << bits) + 1 + where, "visitor": visitor[who] | (where != home[who])}
                yield from _sent(part, who, place, carried)

    return run


#: Rows from which cells may give way to large blocks, the share of visits at which they do, and numbers of such a block.
LARGE_FROM, LARGE_SHARE, LARGE = 4 * BLOCK_ROWS, 0.25, 1 << 22


def _visit_share(sample: np.ndarray, pivots: np.ndarray, radii: np.ndarray, sizes: np.ndarray, threshold: float) -> float:
    """Share of all other rows that the sampled vectors would meet in the cells they visit, by the bounds of ``_assign_cells``."""
    cosine = sample @ pivots.T
    home = cosine.argmax(axis=1)
    apart = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * pivots[home] @ pivots.T))
    gap = cosine[np.arange(len(home)), home][:, None] - cosine
    goes = gap <= np.sqrt(max(0.0, 2.0 - 2.0 * threshold)) * apart + 1e-6
    goes &= cosine >= np.cos(np.minimum(np.pi, radii + np.arccos(threshold) + 1e-6))[None, :] - 1e-9
    return float((goes @ sizes).mean() / sizes.sum())


class Cells:
    """Where vectors fall: pivots, cell radii and block count, found once for several passes.

    Where a vector would visit many of the cells they save no product, but each
    visit sends the vector again: then all rows are one cell of a few large
    blocks that meet pairwise, and a vector is sent once per block.

    The number of cells follows the rows, so that a cell is about one block: up
    to FIRST_PIVOTS cells or the square root of those needed at the first level,
    and pivots of its own for a cell that is still many blocks.  A vector is
    compared with the pivots of the first level and those of the deep cells it
    is in, never with all.
    """

    def __init__(self, vectors: DataFrame, threshold: float, block_rows: int = BLOCK_ROWS):
        if not 0.0 < threshold <= 1.0:
            raise ValueError("threshold must lie in (0, 1]")
        self.threshold, self.block_rows, self.deep, self.large = threshold, block_rows, None, False
        self.rows = vectors.count()
        self.blocks = max(1, -(-self.rows // block_rows))
        if self.blocks > 1:
            sample = _pivots(vectors, first_pivots(self.blocks))
            self.pivots, self.radii, sizes = _measured(vectors, sample)
            self.large = self.rows >= LARGE_FROM and _visit_share(sample[:1024], self.pivots, self.radii, sizes, threshold) > LARGE_SHARE
            if self.large:
                # as many blocks as give every core a few pairs of them, more if they would not be bounded
                least = int(np.sqrt(6 * vectors.sparkSession.sparkContext.defaultParallelism))
                held = max(1, LARGE // self.pivots.shape[1])
                across = max(least, -(-self.rows // held))
                self.block_rows, self.blocks = max(1, -(-self.rows // across)), min(MAX_PARTS, 2 * across * (across + 1))
            elif (sizes > DEEP_BLOCKS * block_rows).any():
                self.deep = _DeepCells(vectors, self.pivots, self.radii, sizes, block_rows)

    def placed(self, vectors: DataFrame) -> DataFrame:
        """(cell, visitor, id, vector, …): every vector in its home cell and in those it must visit."""
        if self.blocks == 1 or self.large:  # a single cell without visitors
            return vectors.select(F.lit(0).cast("long").alias("cell"), F.lit(False).alias("visitor"), "*")
        rows = _assign_cells(vectors, self.pivots, self.radii, self.threshold)
        return rows if self.deep is None else self.deep.placed(rows, self.threshold)

    def compare(self, vectors: DataFrame, emit: Callable, schema: str) -> DataFrame:
        """Meet all near vectors tile by tile; ``emit`` turns a tile into rows."""
        spread = tiles(self.placed(vectors), self.block_rows, self.rows)
        return _by_tile(spread, TILE_KEYS, emit(self.threshold), schema, self.blocks)


def first_pivots(blocks: int) -> int:
    """Cells of the first level."""
    return min(blocks, PIVOTS, max(FIRST_PIVOTS, int(np.ceil(np.sqrt(blocks)))))


def exact_pairs(vectors: DataFrame, threshold: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All unordered pairs of (id, vector) rows with cosine >= threshold, each once.

    Rows fall to the cell of their nearest pivot; a pair is compared in the
    tighter of its two cells only.  Pruning depends on how clustered the vectors
    are; without any structure the work is that of a block-by-block product.
    """
    return Cells(vectors, threshold, block_rows).compare(vectors, _emit_pairs, PAIR_SCHEMA)


def neighbour_weights(cells: Cells, points: DataFrame) -> DataFrame:
    """(id, near): summed ``mark`` of all other points within the threshold.

    Tiles send one partial sum per point; no pair leaves a task.
    """
    partial = cells.compare(points, _emit_weights, "id string, near long")
    return partial.groupBy("id").agg(F.sum("near").alias("near"))


def core_links(cells: Cells, points: DataFrame) -> DataFrame:
    """(a, b, among_cores): links that connect what is within the threshold; ``mark`` is 1 for cores."""
    return cells.compare(points, _emit_links, "a string, b string, among_cores boolean")


def banding(sample: np.ndarray, count: int, threshold: float, recall: float) -> tuple[int, int]:
    """(bands, bits per band) that find a pair at the threshold with the given chance.

    More bits make buckets smaller but need more bands.  The cheapest setting is
    taken: copies sent (one per band) plus expected comparisons, a thousand of
    which cost about as much as sending one vector.
    """
    same_bit = 1.0 - np.arccos(threshold) / np.pi
    angles = np.arccos(np.clip(sample @ sample.T, -1.0, 1.0))[np.triu_indices(len(sample), 1)]
    best = None
    for bits in range(4, 31):
        bands = max(1, int(np.ceil(np.log1p(-recall) / np.log1p(-min(same_bit ** bits, 1 - 1e-9)))))
        chance = np.mean((1.0 - angles / np.pi) ** bits) if len(angles) else 0.0
        cost = bands * (1.0 + count * chance / 1000.0)
        if best is None or cost < best[0]:
            best = (cost, bands, bits)
    return best[1], best[2]


def lsh_pairs(
    vectors: DataFrame, threshold: float, recall: float = 0.99, seed: int = 42, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Approximate pairs: candidates share a random-hyperplane band, scores are exact.

    ``recall`` is the chance of finding a pair that lies right at the threshold;
    closer pairs are found more surely.  A pair is emitted in the first band its
    two signatures share, so results need no distinct.  Hot buckets are tiled
    like any other cell.
    """
    if not 0.0 < recall < 1.0:
        raise ValueError("recall must lie in (0, 1)")
    sample = _pivots(vectors, 256)
    if len(sample) == 0:
        return vectors.sparkSession.createDataFrame([], PAIR_SCHEMA)
    count = vectors.count()
    bands, rows = banding(sample, count, threshold, recall)
    planes = np.random.default_rng(seed).standard_normal((sample.shape[1], bands * rows))
    weights = 1 << np.arange(rows, dtype=np.int64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            bits = (as_matrix(batch.column("vector")) @ planes > 0).reshape(batch.num_rows, bands, rows)
            signatures = (bits * weights).sum(axis=2)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), _packed(as_matrix(batch.column("vector"))),
                 pa.array([row.tobytes() for row in signatures.astype(np.int32)], pa.binary()),
                 as_list_column(signatures * bands + np.arange(bands))],
                names=["id", "vector", "bands", "cells"],
            )

    # Every band sends the vector again: it is packed once, and signatures have 32 bits.
    signed = vectors.select("id", "vector").mapInArrow(sign, "id string, vector binary, bands binary, cells array<long>")
    cells = signed.withColumn("cell", F.explode("cells")).drop("cells").withColumn("visitor", F.lit(False))

    def first_shared(left: np.ndarray, right: np.ndarray, cell: int) -> np.ndarray:
        same = left == right
        return same.argmax(axis=1) == cell % bands

    return _by_tile(
        tiles(cells, block_rows, count), TILE_KEYS, _emit_pairs(threshold, first_shared), PAIR_SCHEMA,
        blocks=bands * count // block_rows,
    )


class _Places:
    """Cells of the vectors to be searched: pivots, radii, and blocks of bounded rows in each cell."""

    def __init__(self, vectors: DataFrame, block_rows: int):
        rows = vectors.count()
        # One row per pivot comes back to the driver.
        self.pivots, self.radii, sizes = _measured(vectors, _pivots(vectors, min(PIVOTS, max(1, -(-rows // block_rows)))))
        self.blocks = np.maximum(1, -(-sizes // block_rows))

    def residents(self, vectors: DataFrame) -> DataFrame:
        """Every vector in its cell, once; a hot cell has several blocks."""
        pivots, blocks = self.pivots, self.blocks

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in _parts(batches):
                home = _nearest(part, pivots)[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(home.astype(np.int64)), pa.array(blocks[home]), *part.columns], names=["cell", "_blocks", "id", "vector"])

        kind = vectors.schema["vector"].dataType.simpleString()
        placed = vectors.select(F.col("id").cast("string").alias("id"), "vector").mapInArrow(
            place, f"cell long, _blocks long, id string, vector {kind}")
        return placed.select("cell", _bucket(F.col("id"), F.col("_blocks")).alias("block"), F.lit(False).alias("is_query"),
                             F.lit(None).cast("double").alias("bound"), "id", F.col("vector").cast("array<double>").alias("vector"))

    def visits(self, queries: DataFrame) -> DataFrame:
        """Queries (id, vector, bound) in the blocks of every cell that may hold something as near as ``bound``.

        A cell's vectors lie within its radius of the pivot, so none is nearer
        to the query than their angle less that radius.
        """
        pivots, radii, blocks = self.pivots, self.radii, self.blocks

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in _parts(batches):
                cosine, _ = _nearest(part, pivots)
                possible = np.cos(np.maximum(0.0, _angle(cosine) - radii[None, :]))
                who, where = np.nonzero(possible >= part.column("bound").to_numpy()[:, None] - 1e-9)
                many = blocks[where]
                who, cell = np.repeat(who, many), np.repeat(where, many)
                block = np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many)
                place = {"cell": cell.astype(np.int64), "block": block.astype(np.int32)}
                yield from _sent(part, who, place, ["bound", "id", "vector"])

        kind = queries.schema["vector"].dataType.simpleString()
        return queries.select("id", "vector", "bound").mapInArrow(visit, f"cell long, block int, bound double, id string, vector {kind}").select(
            "cell", "block", F.lit(True).alias("is_query"), "bound", "id", F.col("vector").cast("array<double>").alias("vector"))


#: Queries of a batch that are compared at once.
STRIP = 512


def _bounded(queries: DataFrame, sample: np.ndarray, k: int) -> DataFrame:
    """Queries with ``bound``: their k-th similarity in a sample of the vectors, which the whole cannot fall below."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bound = np.full(batch.num_rows, -1.0)
            for begin in range(0, batch.num_rows if len(sample) >= k else 0, STRIP):
                scores = unit_rows(as_matrix(batch.column("vector").slice(begin, STRIP))) @ sample.T
                scores.partition(len(sample) - k, axis=1)
                bound[begin:begin + STRIP] = np.round(scores[:, len(sample) - k], 12)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vector"), pa.array(bound)], names=["id", "vector", "bound"])

    return queries.mapInArrow(run, f"id string, vector {queries.schema['vector'].dataType.simpleString()}, bound double")


class MaxWeightIndex:
    """The vectors of one block in short runs, with the largest and smallest weight of a run in every dimension.

    Vectors nearest to the same one of the block stand together, so a run has few
    dimensions that are not zero, and only those are multiplied.  A query's
    score in a run is at most the sum of its weights times those extremes; runs
    are taken best bound first, and those that cannot reach the k-th score known
    by then are left.
    """

    RUN = 64

    def __init__(self, ids: list[str], vectors: np.ndarray):
        self.ids = np.asarray(ids, dtype=object)
        near = (vectors @ vectors[::self.RUN].T).argmax(axis=1)
        order = np.lexsort((self.ids, near))
        self.ids, vectors, near = self.ids[order], vectors[order], near[order]
        self.rank = np.argsort(np.argsort(self.ids, kind="stable"), kind="stable")
        place = np.arange(len(near)) - np.searchsorted(near, near)
        starts = np.flatnonzero(place % self.RUN == 0)
        ends = np.append(starts[1:], len(near))
        self.tops, self.lows = np.maximum.reduceat(vectors, starts), np.minimum.reduceat(vectors, starts)
        self.runs = []
        for i, (begin, end) in enumerate(zip(starts, ends)):
            dims = np.flatnonzero((self.tops[i] != 0) | (self.lows[i] != 0))
            self.runs.append((begin, dims, np.ascontiguousarray(vectors[begin:end, dims])))
        self.visited = self.offered = 0

    def search(self, queries: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) of the k best rows of every query that are not below its ``bound``; ties to the smaller id."""
        most = np.maximum(queries, 0) @ self.tops.T + np.minimum(queries, 0) @ self.lows.T
        known = bound.copy()
        first = most.argmax(axis=1)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def visit(i: int, asking: np.ndarray, lift: bool) -> None:
            begin, dims, held = self.runs[i]
            scores = np.round(queries[np.ix_(asking, dims)] @ held.T, 12)
            if lift and scores.shape[1] >= k:
                kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
                known[asking] = np.maximum(known[asking], kth)
            q, row = np.nonzero(scores >= known[asking][:, None] - 1e-11)
            found.append((asking[q], begin + row, scores[q, row]))
            self.visited += len(asking)

        self.offered += most.size
        for i in np.unique(first):
            visit(i, np.flatnonzero((first == i) & (most[:, i] >= known - 1e-9)), lift=True)
        order = np.argsort(-most.max(axis=0), kind="stable")
        for i in order:
            asking = np.flatnonzero((first != i) & (most[:, i] >= known - 1e-9))
            if len(asking):
                visit(i, asking, lift=True)
        none = np.zeros(0, np.int64)
        q, row, score = (np.concatenate(x) for x in zip((none, none, none.astype(float)), *found))
        order = np.lexsort((self.rank[row], -score, q))
        q, row, score = q[order], row[order], score[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        return q[place < k], row[place < k], score[place < k]


def _asked_blocks(batches: Iterator[pa.RecordBatch], unit: bool = True) -> Iterator[tuple[list[str], list[np.ndarray], pa.RecordBatch]]:
    """(ids, vectors in parts, queries): the queries of a cell and block, batch by batch, with the vectors that came before them.

    The same lists come back while the block is the same; with ``unit`` the vectors are scaled to length one.
    """
    now, ids, held = None, [], []
    for batch in batches:
        keys = list(zip(batch.column("cell").to_pylist(), batch.column("block").to_pylist(), batch.column("is_query").to_pylist()))
        edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        for begin, end in zip(edges, edges[1:]):
            if begin == end:
                continue
            part, (cell, block, is_query) = batch.slice(begin, end - begin), keys[begin]
            if (cell, block) != now:
                now, ids, held = (cell, block), [], []
            if not is_query:
                ids += part.column("id").to_pylist()
                vectors = as_matrix(part.column("vector"))
                held.append(unit_rows(vectors) if unit else vectors)
            elif ids:
                for at in range(0, part.num_rows, STRIP):
                    yield ids, held, part.slice(at, STRIP)


class Partners:
    """Partners of some vectors among all (id, vector), at a similarity of at least ``threshold``.

    The first ``owner`` characters of an id name an owner; vectors of one owner
    are no partners in ``nearby`` and ``best``.  Every vector is sent to its
    cell once; only those asked for go to other cells.
    """

    SCHEMA = "query_id string, id string, similarity double"

    def __init__(self, vectors: DataFrame, threshold: float, owner: int, block_rows: int = BLOCK_ROWS):
        self.vectors, self.threshold, self.owner = vectors, threshold, owner
        self.places = _Places(vectors, block_rows)
        blocks = int(self.places.blocks.sum()) if len(self.places.pivots) else 0
        self.parts = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(blocks, MAX_PARTS))

    def nearby(self) -> DataFrame:
        """The best partner of every vector inside its own block; one barely below the threshold may be among them."""
        return self._met(None, self.threshold, best=True)

    def best(self, queries: DataFrame) -> DataFrame:
        """The best partner of every query in each block that may hold one, as in ``nearby``."""
        return self._met(queries, self.threshold - CANDIDATE_MARGIN, best=True)

    def all(self, queries: DataFrame, threshold: float) -> DataFrame:
        """Every other vector at or above ``threshold`` of every query, of its own owner too."""
        return self._met(queries, threshold, best=False)

    def _met(self, queries: DataFrame | None, threshold: float, best: bool) -> DataFrame:
        if not len(self.places.pivots):
            return self.vectors.sparkSession.createDataFrame([], self.SCHEMA)
        owner = self.owner
        rows = self.places.residents(self.vectors)
        if queries is not None:
            asked = queries.select(F.col("id").cast("string").alias("id"), "vector", F.lit(float(threshold)).alias("bound"))
            rows = rows.unionByName(self.places.visits(asked))

        def scored(asks: np.ndarray, ids: np.ndarray, names: np.ndarray, x: np.ndarray, y: np.ndarray):
            if best:
                rough = x.astype(np.float32) @ y.astype(np.float32).T
                rough[np.array([a[:owner] for a in asks], dtype=object)[:, None] == names[None, :]] = -2.0
                j = rough.argmax(axis=1)
                i = np.flatnonzero(rough[np.arange(len(j)), j] >= threshold - CANDIDATE_MARGIN)
                j = j[i]
                score = np.einsum("nd,nd->n", x[i], y[j])
            else:
                i, j, score = _passing(x, y, threshold)
                other = asks[i] != ids[j]
                i, j, score = i[other], j[other], score[other]
            for at in range(0, len(i), 65536):
                part = slice(at, at + 65536)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(asks[i[part]], pa.string()), pa.array(ids[j[part]], pa.string()), pa.array(score[part])],
                    names=["query_id", "id", "similarity"])

        def visited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of = None
            for held_ids, held, part in _asked_blocks(batches):
                if of is not held_ids:
                    of, ids, y = held_ids, np.asarray(held_ids, dtype=object), np.concatenate(held)
                    names = np.array([a[:owner] for a in held_ids], dtype=object)
                asks = np.asarray(part.column("id").to_pylist(), dtype=object)
                yield from scored(asks, ids, names, unit_rows(as_matrix(part.column("vector"))), y)

        def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for group in _groups(batches, ["cell", "block"]):
                ids, y = _ids(group), unit_rows(as_matrix(group["vector"]))
                names = np.array([a[:owner] for a in ids], dtype=object)
                for at in range(0, len(ids), STRIP):
                    yield from scored(ids[at:at + STRIP], ids, names, y[at:at + STRIP], y)

        dealt = rows.repartition(self.parts, "cell", "block").sortWithinPartitions("cell", "block", "is_query")
        return dealt.mapInArrow(at_home if queries is None else visited, self.SCHEMA)


#: Vectors that give every query its first bound: rows on the driver and in every task.
BOUND_SAMPLE = 4096


#: Numbers of the vectors that a task holds (two copies in single precision), and products it makes in about a minute.
HELD, PRODUCTS = 1 << 24, 1 << 33


def _grid(rows: int, queries: int, held_rows: int, cores: int) -> tuple[int, int]:
    """Blocks of vectors and of queries that meet pairwise, a task each.

    A block of vectors has at most ``held_rows``.  Within that the blocks are
    such that few rows are sent again: a query's best of a block are sent too,
    so it counts twice.
    """
    work = rows * queries
    tasks = max(-(-work // PRODUCTS), min(4 * cores, -(-work // (1 << 24))), 1)
    across = max(1, -(-rows // held_rows), int(np.sqrt(tasks * rows / (2 * max(1, queries)))))
    return across, max(1, min(-(-tasks // across), queries))


class HeldVectors:
    """Vectors held in a task, searched by products in single precision; what may be among the best is scored in double.

    Of equal vectors the k smallest ids are held, as no other can be among the best.
    """

    def __init__(self, ids: list[str], parts: list[np.ndarray], k: int):
        vectors = np.concatenate(parts)
        order = np.argsort(np.asarray(ids, dtype=object), kind="stable")
        copies: dict[bytes, int] = {}
        kept = []
        for i in order:
            key = hashlib.blake2b(vectors[i], digest_size=16).digest()
            copies[key] = seen = copies.get(key, 0) + 1
            if seen <= k:
                kept.append(i)
        # in the order of their ids, so a smaller row is a smaller id
        self.ids = np.asarray(ids, dtype=object)[kept]
        self.vectors = vectors[kept]
        self.k, self.rough = k, np.empty(self.vectors.shape, np.float32)
        for at in range(0, len(kept), MET_COLUMNS):
            self.rough[at:at + MET_COLUMNS] = unit_rows(self.vectors[at:at + MET_COLUMNS])

    def _best(self, q: np.ndarray, row: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((row, -score, q))
        q, row, score = q[order], row[order], score[order]
        first = np.arange(len(q)) - np.searchsorted(q, q) < self.k
        return q[first], row[first], score[first]

    def _scored(self, queries: np.ndarray, q: np.ndarray, row: np.ndarray) -> np.ndarray:
        exact, step = np.empty(len(q)), max(1, SCORED // max(1, queries.shape[1]))
        for at in range(0, len(q), step):
            some = slice(at, at + step)
            exact[some] = np.einsum("nd,nd->n", queries[q[some]], unit_rows(self.vectors[row[some]]))
        return np.round(exact, 12)

    def search(self, queries: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) of the k best rows of every unit query that are not below its ``bound``; ties to the smaller id."""
        known, rough = bound.copy(), queries.astype(np.float32)  # no k-th best is below what is known
        found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for at in range(0, len(self.ids), MET_COLUMNS):
            block = self.rough[at:at + MET_COLUMNS]
            product = rough @ block.T
            hit = np.flatnonzero(product >= (known - CANDIDATE_MARGIN).astype(np.float32)[:, None])
            if len(hit) > 64 * self.k * len(queries):  # the k-th best of this block alone
                kth = np.partition(product, -self.k, axis=1)[:, -self.k]
                known = np.maximum(known, kth.astype(np.float64) - CANDIDATE_MARGIN)
                hit = np.flatnonzero(product >= (known - CANDIDATE_MARGIN).astype(np.float32)[:, None])
            if not len(hit):
                continue
            q, row = np.divmod(hit, len(block))
            score = self._scored(queries, q, at + row)
            able = score >= known[q] - 1e-11
            found = self._best(*(np.concatenate(x) for x in zip(found, (q[able], at + row[able], score[able]))))
            last = np.flatnonzero(np.arange(len(found[0])) - np.searchsorted(found[0], found[0]) == self.k - 1)
            known[found[0][last]] = np.maximum(known[found[0][last]], found[2][last])
        return found


def top_k_pairs(queries: DataFrame, vectors: DataFrame, k: int, block_rows: int | None = None) -> DataFrame:
    """The k vectors nearest to each query (query_id, id, similarity, rank).  Exact; ties: smaller id.

    Every query meets every vector: vectors and queries fall into blocks by
    their ids, and a task holds a block of vectors (of ``block_rows``, or HELD
    numbers) while a block of queries streams past.  A sample of fixed size
    gives every query a similarity that its k-th nearest cannot fall below, so
    few products are looked at again, and k rows per query leave a task.  The
    products are as many as queries times vectors.
    """
    spark = vectors.sparkSession
    schema = "query_id string, id string, similarity double"
    sample = _pivots(vectors, BOUND_SAMPLE)
    rows, asking = vectors.count(), queries.count()
    if not rows or not asking:
        return spark.createDataFrame([], f"{schema}, rank int")
    across, down = _grid(rows, asking, block_rows or max(1, HELD // sample.shape[1]), spark.sparkContext.defaultParallelism)
    single = all(f.schema["vector"].dataType.elementType.simpleString() == "float" for f in (queries, vectors))
    vector = F.col("vector").cast(f"array<{'float' if single else 'double'}>").alias("vector")
    name = F.col("id").cast("string").alias("id")

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    held = vectors.select(_bucket(name, F.lit(across)).alias("cell"), every(down).alias("block"), F.lit(False).alias("is_query"),
                          F.lit(None).cast("double").alias("bound"), name, vector)
    asked = _bounded(queries.select(name, "vector"), sample, k).select(
        every(across).alias("cell"), _bucket(F.col("id"), F.lit(down)).alias("block"), F.lit(True).alias("is_query"),
        "bound", "id", vector)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, index = None, None
        for ids, parts, part in _asked_blocks(batches, unit=False):
            if of is not ids:
                of, index = ids, None  # the block before is let go first
                index = HeldVectors(ids, parts, k)
                parts.clear()
            q, row, score = index.search(unit_rows(as_matrix(part.column("vector"))), part.column("bound").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [part.column("id").take(pa.array(q)), pa.array(index.ids[row], pa.string()), pa.array(score)],
                names=["query_id", "id", "similarity"])

    met = held.unionByName(asked).repartitionById(across * down, F.col("cell") * F.lit(down) + F.col("block"))
    found = met.sortWithinPartitions("cell", "block", "is_query").mapInArrow(search, schema)
    order = W.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
