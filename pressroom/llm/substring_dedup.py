"""Repeated passages across a corpus, by relative Lempel-Ziv parsing against hashed reference blocks.

Every text is cut into reference blocks around anchors: of the ``gram``-word sequences in each window of
``window`` words, the one of least hash. Two equal windows have the same anchor at the same place, so all
repeats of a window meet under its anchor; a block is the words of all windows that hold the anchor. The
index maps anchor and block to the number of places that have it.

A text is then parsed greedily. Where its block has been seen at two places, every window in it is a
repeat and the factor goes on. Where the anchor is known with other blocks, the factor ends somewhere in the
block: there, at the factor boundary, its windows are looked up one by one against the windows of all other
blocks of the anchor, a block seen many times standing for all its places. Runs of repeated windows are the
factors; each is at least ``window`` words long, and their union is removed.

Anchors and blocks are counted before they are shuffled, and no list holds more than one text's anchors, so
a passage in a third of all texts is no single task's load.

Null texts and texts of fewer than ``window`` words lose nothing; repeated rows are repeats of each other;
rows of the same id but other text are kept apart; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import PLAIN, Rolling, Words, cover, mix, word_slices
from .files import stage

KIND = "doc_id long, n_words long, n_removed long, kept_sha256 string, factors array<struct<start: int, length: int>>"
_U = np.uint64


def _sliding(values: np.ndarray, length: int, pick: np.ufunc) -> np.ndarray:
    """pick over values[i:i + length] for every whole window."""
    out, have = values, 1
    while 2 * have <= length:
        out, have = pick(out[:-have], out[have:]) if len(out) > have else out[:0], 2 * have
    rest = length - have
    return pick(out[:len(out) - rest], out[rest:]) if len(out) > rest else out[:0]


def anchors(w: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of anchors (word numbers of the slice), their hashes, the hashes of their blocks, and the
    places of the anchor in the first and the last window of its block (in one number, by 64)."""
    n, reach = w.n, window - gram + 1
    none = np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, _U), np.zeros(0, np.int32)
    if n < window:
        return none
    roll = Rolling(w.hashes(), 1)
    grams = np.maximum(mix(roll.windows(gram)), _U(1))
    least = _sliding(grams, reach, np.minimum)
    whole = np.arange(len(least)) + window <= w.last()[:len(least)]
    least[~whole] = 0
    padded = np.zeros(len(least) + 2 * (reach - 1), _U)
    padded[reach - 1:reach - 1 + len(least)] = least
    chosen = np.flatnonzero(_sliding(padded, reach, np.maximum)[:len(grams)] == grams)
    if not len(chosen):
        return none
    # windows that have this anchor begin at a run of places; padded[i + reach - 1] belongs to the window at i
    mine = padded[chosen[:, None] + (reach - 1 - np.arange(reach))] == grams[chosen][:, None]
    near = np.argmax(mine, axis=1)
    far = reach - 1 - np.argmax(mine[:, ::-1], axis=1)
    size = far - near + window
    block = mix(roll.span(chosen - far, size) + far.astype(_U) * _U(1 << 32) + size.astype(_U))
    return chosen, grams[chosen], block, (near + 64 * far).astype(np.int32)


def _anchor_rows(docs: DataFrame, window: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, twins = batch.column(0), batch.column(1)
            for lo, hi, w in word_slices(batch.column(2), PLAIN):
                at, anchor, block, places = anchors(w, window, gram)
                text = np.searchsorted(w.first, at, "right") - 1
                rows = pa.array(lo + text)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(block.view(np.int64)), names.take(rows),
                     twins.take(rows), pa.array((at - w.first[text]).astype(np.int32)), pa.array(places)],
                    names=["anchor", "block", "doc_id", "twin", "pos", "places"])

    return docs.mapInArrow(run, "anchor long, block long, doc_id long, twin int, pos int, places int")


def _boundary_windows(rows: DataFrame, window: int) -> DataFrame:
    """The single windows of the listed blocks: a hash of all words and the anchor's place, under the anchor.

    Anchor and hash are made from different functions of the words, so together they have 128 bits."""
    kind = "anchor long, block long, n long, place int, hash long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            for lo, hi, w in word_slices(batch.column(0), PLAIN):
                part = lists.slice(lo, hi - lo)
                flat = part.flatten()
                text = np.repeat(np.arange(hi - lo), np.diff(part.offsets.to_numpy()))
                anchor, block, pos, n, places = (
                    flat.field(k).to_numpy(zero_copy_only=False) for k in ("anchor", "block", "pos", "n", "places"))
                near, far = places % 64, places // 64
                many = far - near + 1
                who = np.repeat(np.arange(len(pos)), many)
                place = near[who] + np.arange(len(who)) - (np.cumsum(many) - many)[who]
                begin = (w.first[text] + pos)[who] - place
                key = mix(Rolling(mix(w.hashes()), 2).span(begin, window) + place.astype(_U)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[who]), pa.array(block[who]), pa.array(n[who]),
                     pa.array(place.astype(np.int32)), pa.array(key)],
                    names=["anchor", "block", "n", "place", "hash"])

    return rows.mapInArrow(run, kind)


def _cut(rows: DataFrame, window: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = window - gram + 1
        for batch in batches:
            out = {"doc_id": batch.column(0), "n_words": [], "n_removed": [], "kept_sha256": [], "factors": []}
            for text, hits in zip(batch.column(1), batch.column(2), strict=True):
                words = (text.as_py() or "").encode().split()  # bytes: exactly the six ASCII separators
                factors = []
                if hits.is_valid and len(hits):
                    flat = hits.values
                    pos, mask = flat.field("pos").to_numpy(), flat.field("mask").to_numpy()
                    start = (pos[:, None] - np.arange(reach))[(mask[:, None] >> np.arange(reach)) & 1 == 1]
                    start = start[(start >= 0) & (start + window <= len(words))]
                    start = np.unique(start)
                    gone = cover(start, window, len(words))
                    edge = np.flatnonzero(np.diff(gone, prepend=False, append=False))
                    factors = list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
                kept, at = [], 0
                for a, b in factors:
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                out["n_words"].append(len(words))
                out["n_removed"].append(len(words) - len(kept))
                out["kept_sha256"].append(hashlib.sha256(b" ".join(kept)).hexdigest())
                out["factors"].append([{"start": a, "length": b - a} for a, b in factors])
            yield pa.RecordBatch.from_arrays(
                [out["doc_id"], pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()),
                 pa.array(out["kept_sha256"], pa.string()),
                 pa.array(out["factors"], pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())])))],
                names=list(out))

    return rows.mapInArrow(run, KIND)


def remove_repeats(docs: DataFrame, window: int = 35, gram: int = 12, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """One row per document (``KIND``): words, removed words, hash of the kept ones, factors removed."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.hash(text_col).alias("twin"), F.col(text_col).cast("string").alias("text"))
    found = _anchor_rows(rows, window, gram)
    # written, so that both sides of the joins are plain shuffles, which the skew join can split
    shared = stage(found.groupBy("anchor").count().where("count > 1").select("anchor"))
    found = stage(found.join(shared, "anchor", "left_semi"))
    blocks = stage(found.groupBy("anchor", "block").agg(
        F.count("*").alias("n"), F.min(F.struct("doc_id", "twin", "pos", "places")).alias("at")))
    several = stage(blocks.groupBy("anchor").count().where("count > 1").select("anchor"))
    asked = (blocks.join(several, "anchor", "left_semi")
             .groupBy(F.col("at.doc_id").alias("doc_id"), F.col("at.twin").alias("twin"))
             .agg(F.collect_list(F.struct("anchor", "block", F.col("at.pos").alias("pos"), "n",
                                          F.col("at.places").alias("places"))).alias("asked")))
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & a["twin"].eqNullSafe(b["twin"])
    # repeated rows all answer: their blocks count two places or more already, so no total passes one by that
    some = rows.join(asked, same(rows, asked)).select(rows["text"], asked["asked"])
    windows = stage(_boundary_windows(some, window))
    twice = stage(windows.groupBy("anchor", "hash").agg(F.sum("n").alias("total")).where("total > 1").select("anchor", "hash"))
    partial = (windows.where("n = 1").join(twice, ["anchor", "hash"], "left_semi").groupBy("anchor", "block")
               .agg(F.expr("bit_or(shiftleft(1L, place))").alias("mask")))
    whole = F.expr("shiftleft(1L, int(at.places div 64 + 1)) - shiftleft(1L, int(at.places % 64))")
    masks = stage(blocks.where("n > 1").select("anchor", "block", whole.alias("mask")).unionAll(partial))
    hits = (found.join(masks, ["anchor", "block"]).groupBy("doc_id", "twin")
            .agg(F.collect_list(F.struct("pos", "mask")).alias("hits")))
    return _cut(rows.join(hits, same(rows, hits), "left").select(rows["doc_id"], rows["text"], hits["hits"]), window, gram)
