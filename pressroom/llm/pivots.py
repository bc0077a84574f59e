"""Near-duplicate vectors through a pivot-permutation index.

Pivots are taken from a sample of at most ``MOST_PIVOTS`` vectors, four times the root of the number of
different vectors, those of least digest; near copies among them count as one. A vector is described by its ``nearest`` pivots in the order of their cosines, and put on the inverted
list of each of them. Lists are opened in square tiles of ``BLOCK`` by ``BLOCK`` vectors; in a tile every pair
gets the number of pivots it shares, from the short lists within the tile; pairs that share ``least_shared`` or
more are verified by their cosine, in the list of their least shared pivot alone. A tile gives each vector its
number of links and one edge to the least vector it hangs together with, so neither pairs nor links are ever
rows; a list of any length is spread over its tiles.

Equal vectors are found by a digest of 128 bits, go through the index once and count by their number. The result
is exact on what the index retrieves: no link is false; one is missing only where two different vectors
share less than ``least_shared`` of their ``nearest`` pivots (``tests/llm`` measure the recall).

Vectors that are null, zero, hold null or non-finite entries, or have another length than most (of equal
counts, the greater) link with nothing. Rows of one id are vectors of their own. A null id is no candidate for
the least id of a component; a component without any has null. An empty table has no rows; a table of fewer
vectors than pivots uses each as one; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected
from .files import stage
from .whitening import finite_vectors

BLOCK = 1024
MOST_PIVOTS = 16384  # 8 MB of pivots at 64 dimensions
SLICE = 1024


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # entries may be so great that their squares are not finite
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), d)


def _classes(rows: DataFrame) -> DataFrame:
    """Different vectors (node, key, vector, copies, least), staged."""
    found = rows.where("key is not null").groupBy("key").agg(
        F.any_value("vector").alias("vector"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
    return stage(found.withColumn("node", F.monotonically_increasing_id()))


def _rows(vectors: DataFrame, vec_col: str, id_col: str) -> DataFrame:
    """(vec_id, key, vector), staged; the key is null where a vector links with nothing."""
    usable = finite_vectors(vectors, vec_col) & F.exists(vec_col, lambda c: c != 0)
    v = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(usable, v).alias("vector"))
    sizes = rows.where("vector is not null").groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("many"))
    usual = sizes.orderBy(F.desc("many"), F.desc("d")).first()
    d = usual.d if usual else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            sizes = np.where(np.asarray(column.is_valid()), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), -1)
            keys, at = [None] * len(sizes), np.flatnonzero(sizes == d)
            m = _matrix(column.take(pa.array(at)), d) + 0.0 if len(at) else np.zeros((0, d))  # -0.0 becomes 0.0
            for i, row in zip(at.tolist(), m, strict=True):
                keys[i] = hashlib.blake2b(row.tobytes(), digest_size=16).digest()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), column], names=["vec_id", "key", "vector"])

    return stage(rows.mapInArrow(run, "vec_id long, key binary, vector array<double>"))


def choose_pivots(classes: DataFrame, n: int, least: float) -> np.ndarray:
    """A bounded sample of the different vectors, the same in every run, without those near one before.

    A group of near copies so gets one pivot, not a share of all: which of many pivots amid the group are
    nearest to a member would be chance, and members would share few.
    """
    count = min(n, MOST_PIVOTS, max(64, int(4 * n ** 0.5)))
    got = classes.orderBy("key").limit(count).select("vector").collect()
    sample = _unit(np.array([r.vector for r in got]))
    kept: list[int] = []
    free = np.ones(len(sample), bool)
    for i in range(len(sample)):
        if free[i]:
            kept.append(i)
            free &= sample @ sample[i] < least
    return sample[kept]


def describe(classes: DataFrame, pivots: np.ndarray, nearest: int) -> DataFrame:
    """Vectors (node, copies, vector) with ``order``: the nearest pivots, nearest first; of equal ones the lower number first."""
    d, k = pivots.shape[1], min(nearest, len(pivots))
    turned = np.ascontiguousarray(pivots.T)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                near = _unit(_matrix(part.column(part.schema.get_field_index("vector")), d)) @ turned
                best = np.sort(np.argpartition(-near, k - 1, axis=1)[:, :k], axis=1)
                best = np.take_along_axis(best, np.argsort(-np.take_along_axis(near, best, 1), axis=1, kind="stable"), 1)
                order = pa.ListArray.from_arrays(pa.array(np.arange(len(best) + 1) * k, pa.int32()), pa.array(best.ravel(), pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, order], names=[*part.schema.names, "order"])

    return classes.mapInArrow(run, "node long, copies long, vector array<double>, order array<int>")


def _shared(own: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of pivots every pair shares, and whether ``own`` is the least of them."""
    count, first = np.ones((len(left), len(right)), np.uint16), np.ones((len(left), len(right)), bool)

    def lists(order):
        by = np.argsort(order.ravel(), kind="stable")
        pivots, start = np.unique(order.ravel()[by], return_index=True)
        return dict(zip(pivots.tolist(), np.split(by // order.shape[1], start[1:]), strict=True))

    there = lists(right)
    for pivot, rows in lists(left).items():
        if pivot != own and (columns := there.get(pivot)) is not None:
            cells = np.ix_(rows, columns)
            count[cells] += 1
            if pivot < own:
                first[cells] = False
    return count, first


def _least_linked(linked: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the rows and columns of a tile, the least node each hangs together with."""
    none = np.iinfo(np.int64).max
    a, b = a.copy(), b.copy()
    while True:
        new_a = np.minimum(a, np.where(linked, b[None, :], none).min(axis=1))
        new_b = np.minimum(b, np.where(linked, new_a[:, None], none).min(axis=0))
        if (new_a == a).all() and (new_b == b).all():
            return a, b
        a, b = new_a, new_b


def open_tile(own: int, same: bool, left: tuple, right: tuple, least: float, least_shared: int) -> list[np.ndarray]:
    """(node, links, peer) of a tile. ``left`` and ``right``: nodes, copies, orders and unit vectors."""
    a, copies_a, order_a, va = left
    b, copies_b, order_b, vb = right
    count, first = _shared(own, order_a, order_b)
    linked = first & (count >= least_shared)
    linked &= va @ vb.T >= least
    if same:
        np.fill_diagonal(linked, False)
    ra, rb = linked.any(axis=1), linked.any(axis=0)
    linked = linked[np.ix_(ra, rb)]
    if not linked.size:
        return [np.zeros(0, np.int64)] * 3
    a, b, copies_a, copies_b = a[ra], b[rb], copies_a[ra], copies_b[rb]
    links_a, links_b = linked.astype(float) @ copies_b, copies_a @ linked.astype(float)
    peer_a, peer_b = _least_linked(linked, a, b)
    if same:  # both sides are the same vectors, a pair stands there twice
        return [a, links_a.astype(np.int64), np.minimum(peer_a, peer_b)]
    return [np.concatenate([a, b]), np.concatenate([links_a, links_b]).astype(np.int64), np.concatenate([peer_a, peer_b])]


def _tiles(described: DataFrame) -> DataFrame:
    """Every vector in every tile of its pivots' lists: its block against each block of the list."""
    posted = described.withColumn("pivot", F.explode("order"))
    sizes = posted.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("node", "pivot"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    placed = posted.join(F.broadcast(sizes), "pivot").withColumn("block", block).select("*", other)  # one row per pivot
    return placed.select("pivot", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block",
                         "node", "copies", "order", "vector")


def link(classes: DataFrame, least: float, nearest: int, least_shared: int) -> DataFrame:
    """(node, links, peer) from all tiles; a node may have many rows, links add up."""
    n = classes.count()
    if not n:
        return classes.select("node", F.lit(0).cast("long").alias("links"), F.col("node").alias("peer"))
    pivots = choose_pivots(classes, n, least)
    d, shared = pivots.shape[1], min(least_shared, len(pivots))
    tiles = _tiles(stage(describe(classes.select("node", "copies", "vector"), pivots, nearest)))

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        low, high, block = (table.column(c).to_numpy() for c in ("low", "high", "block"))
        own, same = table.column("pivot")[0].as_py(), bool(low[0] == high[0])
        node, copies = table.column("node").to_numpy(), table.column("copies").to_numpy().astype(float)
        order, vector = (table.column(c).combine_chunks() for c in ("order", "vector"))
        order = order.flatten().to_numpy().reshape(len(node), -1)
        vector = _unit(_matrix(vector, d))
        by = np.argsort(node, kind="stable")  # the same sums whatever order the rows come in

        def side(which):
            at = by[block[by] == which]
            return node[at], copies[at], order[at], vector[at]

        left = side(low[0])
        columns = open_tile(own, same, left, left if same else side(high[0]), least, shared)
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["node", "links", "peer"])

    return tiles.groupBy("pivot", "low", "high").applyInArrow(run, "node long, links long, peer long")


def near_vectors(vectors: DataFrame, least: float = 0.9, nearest: int = 12, least_shared: int = 2,
                 vec_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id (least id reachable), kept (is it that one)."""
    rows = _rows(vectors, vec_col, id_col)
    classes = _classes(rows)
    found = stage(link(classes.select("node", "key", "copies", "vector"), least, nearest, least_shared))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    edges = found.where("peer <> node").select(F.col("node").alias("a"), F.col("peer").alias("b"))
    labels = connected(edges)
    nodes = classes.select("node", "key", "copies", "least").join(links, "node", "left").join(labels, "node", "left") \
        .withColumn("label", F.coalesce("label", "node"))
    ids = nodes.groupBy("label").agg(F.min("least").alias("component_id"))
    known = nodes.join(ids, "label").select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    joined = rows.select("vec_id", "key").join(known, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id")) \
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
