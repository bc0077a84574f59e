"""Exact Jaccard similarity components of word shingle sets, by a token-group matrix.

Documents of equal sets are one node. Nodes are put into groups, the matrix says which tokens the union of
a group holds, and a node can only link into a group whose union holds ``threshold`` of its tokens.

1. One node against the union of all others: tokens are dealt out by hash range, as packed arrays of 32-bit
   fingerprints (an accidental match only opens too much), and each range counts for its nodes the tokens that
   another node has too. Nodes below the bound have no partner. This is all the work on the whole corpus.
2. Groups: nodes that are left meet under a few min-hashes, in chunks of about ``CHUNK``; from the
   most central on, each node of a chunk that no leader has reached becomes a leader, and is linked to all nodes of the
   chunk that reach the threshold with it. Linked nodes are a group. This may miss links, never adds one.
3. The matrix between groups: the bound of step 1 again, now against the union of other groups. For the nodes left, the
   rarest ``1 - threshold`` of their tokens name the cells of similar nodes that can hold a partner; only these
   are opened, at most about ``CHUNK`` members each, and checked exactly. A node needs one link into a group, since the
   group's members are connected.

So every link between different components is found, and none is listed inside one. A group of any size is
spread over chunks, and its tokens are one entry in the matrix.

Null texts and texts without words have an empty set and are alone; a text of fewer words than a shingle is one
shingle of all its words; repeated rows share a component; a component's id is its smallest document id,
null if it has none; an empty table gives no row; other columns are not read. Sets are identified by 64-bit
fingerprints, shingles by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import PLAIN, Rolling, mix, word_slices
from .components import connected
from .files import stage, tidy

CHUNK = 1000
RANGE_CHARS = 10_000_000  # characters of text whose tokens make one hash range
LEAST_RANGES = 128
FLUSH = 1_000_000  # tokens a task packs at a time
BROADCAST = 100_000  # rows of a narrow table that may be broadcast; larger ones are joined by shuffling
PERMUTATIONS = 3
_U = np.uint64


def shingles(texts: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, last + 1, sorted distinct shingles of the texts in a row, offsets)."""
    for lo, hi, w in word_slices(texts, PLAIN, lower=True):
        n, count = w.n, w.counts()
        roll = Rolling(w.hashes(), 1)
        grams = mix(roll.windows(size) + _U(size)) if n >= size else np.zeros(0, _U)
        whole = np.arange(len(grams)) + size <= w.last()[:len(grams)]
        text, value = w.text_of()[:len(grams)][whole], grams[whole]
        short = np.flatnonzero((count > 0) & (count < size))
        if len(short):
            text = np.concatenate([text, short])
            value = np.concatenate([value, mix(roll.span(w.first[short], count[short]) + count[short].astype(_U))])
        order = np.lexsort((value, text))
        text, value = text[order], value[order]
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
        text, value = text[new], value[new]
        yield lo, hi, value, np.searchsorted(text, np.arange(hi - lo + 1))


def signatures(tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each set."""
    sums = np.zeros(len(tokens) + 1, _U)
    np.cumsum(mix(tokens ^ _U(0xA5A5A5A5DEADBEEF)), out=sums[1:])
    n = np.diff(offsets)
    return mix(sums[offsets[1:]] - sums[offsets[:-1]] + n.astype(_U)).view(np.int64)


def _pack(tokens: list[np.ndarray], counts: list[np.ndarray], names: list[np.ndarray], owners: list[np.ndarray],
          ranges: int) -> pa.RecordBatch:
    """The tokens of some nodes by hash range: fingerprints, and which node each belongs to.

    A token that two owners here have is known to be shared: it is counted for its nodes at once and sent on as
    one entry without a node, so the entries of a token are at most one per batch or per node.
    """
    value, count = np.concatenate(tokens), np.concatenate(counts)
    names, owners = np.concatenate(names), np.concatenate(owners)
    n = len(names)
    owner = np.unique(owners, return_inverse=True)[1]
    order = np.argsort(value)
    who = np.repeat(np.arange(n, dtype=np.int32), count)[order]
    value = value[order]
    first = np.ones(len(value), bool)
    first[1:] = value[1:] != value[:-1]
    head = np.maximum.accumulate(np.where(first, np.arange(len(value), dtype=np.int32), 0))
    other = np.zeros(len(value), bool)
    other[head[owner[who] != owner[who[head]]]] = True
    known = other[head]
    part = (((value >> _U(32)) * _U(ranges)) >> _U(32)).astype(np.int32)
    kept = ~known | first
    mine = np.where(known, n, who)[kept]
    low, edge = value[kept].astype(np.uint32), np.searchsorted(part[kept], np.arange(ranges + 1))
    at, whole = who[known], np.searchsorted(part[known], np.arange(ranges + 1))
    full = np.flatnonzero(np.diff(edge))
    own = names is owners or bool((names == owners).all())
    columns: list[list[bytes]] = [[], [], [], [], []]
    for i in full:  # a range names the nodes that have tokens in it, no others
        entries, counted = mine[edge[i]:edge[i + 1]], at[whole[i]:whole[i + 1]]
        here = np.unique(np.concatenate([entries[entries < n], counted]))
        k = len(here)
        index = np.where(entries < n, np.searchsorted(here, entries), k).astype("<u2" if k < 1 << 16 else "<u4")
        local = np.bincount(np.searchsorted(here, counted), minlength=k).astype("<u4") if len(counted) else np.zeros(0, "<u4")
        for column, value_here in zip(columns, (names[here].astype("<i8"), np.zeros(0) if own else owners[here].astype("<i8"),
                                                low[edge[i]:edge[i + 1]], index, local), strict=True):
            column.append(value_here.tobytes())
    return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), *(pa.array(c, pa.binary()) for c in columns)],
                                      names=["part", "names", "owners", "prints", "who", "local"])


_PACKED = "part int, names binary, owners binary, prints binary, who binary, local binary"


def _count_shared(table: pa.Table) -> pa.Table:
    """Of one hash range: per node, its tokens that nodes of another owner have too."""
    names, owners, prints, who, local, at = [], [], [], [], [], 0
    for row in zip(*(table.column(c) for c in ("names", "owners", "prints", "who", "local")), strict=True):
        name, owner, low, index, known = (np.frombuffer(x.as_buffer(), np.uint8) for x in row)
        names.append(name.view("<i8"))
        owners.append(owner.view("<i8") if len(owner) else names[-1])
        prints.append(low.view(np.uint32))
        index = index.view("<u2" if 2 * len(index) == len(low) else "<u4")
        n = len(names[-1])
        who.append(np.where(index == n, -1, index.astype(np.int32) + at).astype(np.int32))
        local.append(known.view("<u4").astype(np.int64) if len(known) else np.zeros(n, np.int64))
        at += n
    node, code = np.unique(np.concatenate(names), return_inverse=True)
    owner = np.unique(np.concatenate(owners), return_inverse=True)[1]
    prints, who, counts = np.concatenate(prints), np.concatenate(who), np.concatenate(local)
    pair = np.unique((prints[who >= 0].astype(_U) << _U(32)) | owner[who[who >= 0]].astype(_U))
    pair = (pair >> _U(32)).astype(np.uint32)
    many = np.unique(np.concatenate([pair[1:][pair[1:] == pair[:-1]], prints[who < 0]]))
    if len(many):
        prints, who = prints[who >= 0], who[who >= 0]
        place = np.minimum(np.searchsorted(many, prints), len(many) - 1)
        counts += np.bincount(who[many[place] == prints], minlength=len(counts))
    shared = np.zeros(len(node), np.int64)
    np.maximum.at(shared, code, counts)  # copies of a node have the same count
    some = np.flatnonzero(shared)
    del names, owners, prints, who, local, pair, counts
    tidy()
    return pa.table({"node": node[some], "shared": shared[some]})


def _shared(packed: DataFrame) -> DataFrame:
    return (packed.groupBy("part").applyInArrow(_count_shared, "node long, shared long")
            .groupBy("node").agg(F.sum("shared").alias("shared")))


def _pack_texts(rows: DataFrame, size: int, ranges: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for batch in batches:
            for _, _, tokens, offsets in shingles(batch.column(0), size):
                name = signatures(tokens, offsets)
                held.append((tokens, np.diff(offsets), name))
                many += len(tokens)
                if many >= FLUSH:
                    t, c, n = zip(*held, strict=True)
                    yield _pack(t, c, n, n, ranges)
                    held, many = [], 0
        if many:
            t, c, n = zip(*held, strict=True)
            yield _pack(t, c, n, n, ranges)
        tidy()

    return rows.select("text").mapInArrow(run, _PACKED)


def _pack_sets(sets: DataFrame, ranges: int) -> DataFrame:
    """Sets (node, label, tokens), packed under their labels."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for batch in batches:
            for node, label, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tokens = np.frombuffer(raw, "<u8")
                held.append((tokens, np.array([len(tokens)]), np.array([node]), np.array([label])))
                many += len(tokens)
                if many >= FLUSH:
                    yield _pack(*zip(*held, strict=True), ranges)
                    held, many = [], 0
        if many:
            yield _pack(*zip(*held, strict=True), ranges)

    return sets.select("node", "label", "tokens").mapInArrow(run, _PACKED)


class Sets:
    """An inverted index of some sets, for exact overlaps of one set with all of them."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        value = np.concatenate([*sets, np.zeros(0, _U)])
        order = np.argsort(value)
        self.value, self.who = value[order], np.repeat(np.arange(len(sets)), self.sizes)[order]

    def overlaps(self, tokens: np.ndarray) -> np.ndarray:
        lo = np.searchsorted(self.value, tokens)
        many = np.searchsorted(self.value, tokens, "right") - lo
        at = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())
        return np.bincount(self.who[at], minlength=len(self.sizes))

    def similar(self, tokens: np.ndarray, percent: int) -> np.ndarray:
        both = self.overlaps(tokens)
        return np.flatnonzero(100 * both >= percent * (self.sizes + len(tokens) - both))


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of sorted batches by their first ``keys`` columns."""
    last, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != last:
                if held:
                    yield last, held
                last, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield last, held


def _link_to_leaders(rows: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) from nodes to leaders of their chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for _, held in _runs(batches, 3):
            if len(held) < 2:
                continue
            nodes, sets = [n for n, _ in held], [np.frombuffer(t, "<u8") for _, t in held]
            index = Sets(sets)
            spread = np.bincount(np.cumsum(np.diff(index.value, prepend=index.value[:1]) != 0)) if len(index.value) else np.zeros(0)
            group = np.cumsum(np.diff(index.value, prepend=index.value[:1]) != 0)
            central = np.bincount(index.who, spread[group], len(sets)) / np.maximum(index.sizes, 1)
            order, free = np.argsort(-central, kind="stable"), np.ones(len(sets), bool)
            for i in order:
                if not free[i]:
                    continue
                linked = index.similar(sets[i], percent)
                free[i] = False
                free[linked] = False
                a += [nodes[j] for j in linked if j != i]
                b += [nodes[i]] * (len(linked) - 1)
            if len(a) > 10_000:
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
                a, b = [], []
        yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.mapInArrow(run, "a long, b long")


def _open_cells(rows: DataFrame, percent: int) -> DataFrame:
    """Edges from asking nodes to one similar member of each other group in a cell.

    Rows: crowd, chunk, asks, node, label, tokens; the members of a cell come before the nodes that ask.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, members, index, labels = None, [], None, None
        for batch in batches:
            a, b = [], []
            for crowd, chunk, asks, node, label, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (crowd, chunk) != last:
                    last, members, index = (crowd, chunk), [], None
                if not asks:
                    members.append((node, label, np.frombuffer(raw, "<u8")))
                    continue
                if index is None:
                    index, labels = Sets([t for *_, t in members]), np.array([x for _, x, _ in members], np.int64)
                hit = index.similar(np.frombuffer(raw, "<u8"), percent)
                hit = hit[labels[hit] != label]
                for i in hit[np.unique(labels[hit], return_index=True)[1]].tolist():
                    a.append(node)
                    b.append(members[i][0])
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
        tidy()

    return rows.mapInArrow(run, "a long, b long")


def _small(df: DataFrame) -> DataFrame:
    """Broadcast a written table of few rows; leave a larger one to a shuffled join."""
    return F.broadcast(df) if df.limit(BROADCAST + 1).count() <= BROADCAST else df


def _components(docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, twin (a hash of the text), n_shingles, label of the component (null without words), component_id."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("twin"), text.alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    ranges = max(LEAST_RANGES, 1 + chars // RANGE_CHARS)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, tokens, offsets in shingles(batch.column(2), size):
                n = np.diff(offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(n),
                     pa.array(signatures(tokens, offsets), mask=n == 0)],
                    names=["doc_id", "twin", "n_shingles", "node"])

    sets = stage(rows.mapInArrow(describe, "doc_id long, twin long, n_shingles long, node long"))
    nodes = stage(sets.where("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first(F.struct("doc_id", "twin")).alias("one")))
    edges = stage(_edges(rows, nodes, size, percent, ranges))
    labels = connected(edges)
    members = nodes.join(labels, "node", "left").select("node", "doc_id", F.coalesce("label", "node").alias("label"))
    named = members.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = members.join(named, "label").select("node", "label", "component_id")
    return sets.join(named, "node", "left").select(
        "doc_id", "twin", "n_shingles", "label",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def join_similar(docs: DataFrame, size: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    return _components(docs, size, percent, id_col, text_col).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, size: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, the one of smallest id, with all its columns.

    Repeated rows of that id and text are one document; rows of that id but another text of the component are
    told apart by their text. Documents without words all stay.
    """
    text = F.col(text_col).cast("string")
    twin = F.xxhash64(text)
    joined = stage(_components(docs, size, percent, id_col, text_col).where("label is not null").select("doc_id", "twin", "label"))
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "twin")  # null ids last
    best = joined.groupBy("label").agg(F.min(rank).alias("m")).select(
        "label", F.col("m.doc_id").alias("best_id"), F.col("m.twin").alias("best_twin"))
    told = stage(joined.join(best, "label").select(
        "doc_id", "twin", (F.col("doc_id").eqNullSafe(F.col("best_id")) & (F.col("twin") == F.col("best_twin"))).alias("best")))
    left = _small(stage(told.where("not best").select(F.col("doc_id").alias("gone_id"), F.col("twin").alias("gone_twin")).distinct()))
    kept = docs.join(left, docs[id_col].cast("long").eqNullSafe(left["gone_id"]) & (twin == left["gone_twin"]), "left_anti")
    if told.where("best").groupBy("doc_id", "twin").count().where("count > 1").head(1):  # repeated rows
        blank = text.isNull() | ~text.rlike(r"[^\x20\x09-\x0D]")
        kept = kept.where(~blank).dropDuplicates([id_col, text_col]).unionAll(kept.where(blank))
    return kept


def _edges(rows: DataFrame, nodes: DataFrame, size: int, percent: int, ranges: int) -> DataFrame:
    bound = F.expr(f"100 * shared >= {percent} * n")
    # 1: what could link to anything at all
    left = stage(_shared(_pack_texts(rows, size, ranges)).join(nodes, "node").where(bound).select("node", "one", "n"))
    wanted = _small(left.select(F.col("one.doc_id").alias("wanted_doc"), F.col("one.twin").alias("wanted_twin"), F.col("node").alias("wanted")))
    same = rows["doc_id"].eqNullSafe(wanted["wanted_doc"]) & (rows["twin"] == wanted["wanted_twin"])
    texts = rows.join(wanted, same).select("text", "wanted")

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(1).to_numpy()
            for lo, hi, tokens, offsets in shingles(batch.column(0), size):
                some = np.flatnonzero(signatures(tokens, offsets) == wanted[lo:hi])  # not another row of that id
                parts = [tokens[offsets[i]:offsets[i + 1]] for i in some]
                keys = [[int(mix(p ^ _U(0x1234567 * (r + 1))).min().view(np.int64)) for r in range(PERMUTATIONS)] for p in parts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(wanted[lo:hi][some]), pa.array([len(p) for p in parts], pa.int64()),
                     pa.array([p.astype("<u8").tobytes() for p in parts], pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    names=["node", "n", "tokens", "keys"])

    sets = stage(texts.mapInArrow(to_sets, "node long, n long, tokens binary, keys array<long>").dropDuplicates(["node"]))
    # 2: groups around leaders
    keyed = sets.select("node", "tokens", F.posexplode("keys").alias("turn", "key"))
    crowds = stage(sets.select(F.posexplode("keys").alias("turn", "key")).groupBy("turn", "key").count().where("count > 1"))
    chunked = keyed.join(_small(crowds), ["turn", "key"]).select(
        "turn", "key", F.pmod(F.xxhash64("node", "turn"), F.ceil(F.col("count") / CHUNK)).alias("chunk"), "node", "tokens")
    links = stage(_link_to_leaders(
        chunked.repartition("turn", "key", "chunk").sortWithinPartitions("turn", "key", "chunk", "node"), percent))
    groups = connected(links)
    # 3: between groups
    grouped = sets.join(_small(groups), "node", "left").select("node", "n", "tokens", F.coalesce("label", "node").alias("label"))
    open_to = stage(_shared(_pack_sets(grouped, ranges)).join(sets.select("node", "n"), "node").where(bound).select("node"))
    asking = stage(grouped.join(_small(open_to), "node", "left_semi"))

    def to_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, label, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                token = np.frombuffer(raw, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(np.full(len(token), node)), pa.array(np.full(len(token), label))],
                                                 names=["token", "node", "label"])

    tokens = asking.select("node", "label", "tokens").mapInArrow(to_tokens, "token long, node long, label long")
    matrix = stage(tokens.select("token", "label").distinct())
    common = stage(matrix.groupBy("token").agg(F.count("*").alias("groups")))
    ranked = tokens.join(common, "token").join(asking.select("node", "n"), "node").selectExpr(
        "node", "label", "token", "n", "groups", "row_number() over (partition by node order by groups, token) as rank")
    rare = stage(ranked.where(f"rank <= n - ceil({percent} * n / 100) + 1 and groups > 1").select("node", "label", "token"))
    # nodes that share rare tokens are a crowd, a part of a crowd is a cell: the matrix tells which cells hold a token
    hubs = rare.groupBy("token").agg(F.min("node").alias("hub"))
    crowds = connected(rare.join(hubs, "token").where("node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b")))
    cells = asking.select("node").join(crowds, "node", "left").select("node", F.coalesce("label", "node").alias("crowd"))
    sizes = cells.groupBy("crowd").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    cells = stage(cells.join(sizes, "crowd").select("node", "crowd", F.pmod(F.xxhash64("node"), F.col("chunks")).alias("chunk")))
    held = tokens.select("token", "node").join(cells, "node").select("token", "crowd", "chunk").distinct()
    ask = stage(rare.select("node", "token").join(held, "token").select("node", "crowd", "chunk").distinct())
    order = ["crowd", "chunk", "asks", "node"]
    members = asking.join(cells, "node").select("crowd", "chunk", F.lit(0).alias("asks"), "node", "label", "tokens")
    asks = asking.join(ask, "node").select("crowd", "chunk", F.lit(1).alias("asks"), "node", "label", "tokens")
    opened = members.unionAll(asks).repartition("crowd", "chunk").sortWithinPartitions(*order)
    return links.unionAll(_open_cells(opened, percent)).select("a", "b")
