"""Benchmark phrases in training texts, found by an FM-index per shard.

A shard is a run of documents of ``SLICE`` bytes of text together, or one longer document. Its text is all words of its
documents, numbered within the shard, with a separator after each document. The suffix array gives the Burrows-Wheeler
transform, kept as a wavelet matrix with ranks; all phrases are searched backwards at once, one rank for each bit of a word;
occurrences are located by walking to the next sampled suffix; their spans are merged.

``index_texts`` builds the index of every shard once and writes it to the shared folder, a file a task, without looking at any
benchmark; ``search_index`` searches the files for the phrases of any benchmark, any number of times. A pipeline that needs the
documents themselves (``drop_contaminated``) builds and searches a shard in one pass and writes no files.

Phrases are windows of ``window`` consecutive words of an item; an item of fewer words, but not none, is
one phrase. Words are runs of ASCII letters (lower-cased), digits and all characters beyond ASCII.
The benchmark is written to the shared folder in pieces of at most ``PIECE`` characters (or one longer
item), and every shard is searched for each piece in turn, so a large benchmark costs time, not memory.

Null texts have no words and no hits; repeated documents and items count each (an item's id once per
document); without benchmark items nothing is hit; other columns are not read. Words count as equal by 64 bits of
their hash, phrases by 64 bits over those.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files
from .arrays import ALNUM, Rolling, buffers, cover, mix, slices, word_slices

PIECE = 32 << 20
SAMPLE = 8
HITS = ("doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
        "spans array<struct<start: int, end: int>>")


class Phrases:
    """Distinct windows of some items, over the sorted hashes of their words."""

    def __init__(self, items: list[str], texts: pa.Array, window: int):
        parts = [(lo, w, w.hashes()) for lo, _, w in word_slices(texts, ALNUM, lower=True)]
        hashes = np.concatenate([h for _, _, h in parts] or [np.zeros(0, np.uint64)])
        self.vocabulary = np.unique(hashes)
        codes = np.searchsorted(self.vocabulary, hashes)
        first, item, done = [], [], 0
        for lo, w, _ in parts:
            first.append(w.first[:-1] + done)
            item.append(w.counts())
            done += w.n
        first = np.concatenate(first or [np.zeros(0, np.int64)])
        count = np.concatenate(item or [np.zeros(0, np.int64)])
        many = np.where(count >= window, count - window + 1, np.minimum(count, 1))
        owner = np.repeat(np.arange(len(count)), many)
        start = first[owner] + np.arange(len(owner)) - (np.cumsum(many) - many)[owner]
        length = np.minimum(count, window)[owner]
        key = mix(Rolling(mix(codes.astype(np.uint64) + np.uint64(1)), 1).span(start, length) + length.astype(np.uint64))
        _, one, phrase = np.unique(key, return_index=True, return_inverse=True)
        self.start, self.length, self.codes = start[one], length[one], codes
        self.n = len(one)
        order = np.argsort(phrase, kind="stable")
        self.owners = owner[order]
        self.owner_first = np.searchsorted(phrase[order], np.arange(self.n + 1))
        self.items = items


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes; only ties are sorted again, each time by twice the length."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank = np.zeros(n, np.int64)
    new = np.concatenate([[True], text[order[1:]] != text[order[:-1]]])
    at = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = at
    single = new & np.append(new[1:], True)
    slots, k = np.flatnonzero(~single), 1
    while len(slots):
        who = order[slots]
        after = np.where(who + k < n, rank[np.minimum(who + k, n - 1)] + 1, 0)
        mine = rank[who]
        by = np.argsort(mine * (n + 1) + after)
        who, after, mine = who[by], after[by], mine[by]
        order[slots] = who
        new = np.concatenate([[True], (mine[1:] != mine[:-1]) | (after[1:] != after[:-1])])
        rank[who] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        slots = slots[~(new & np.append(new[1:], True))]
        k *= 2
    return order


class FMIndex:
    """Counts and places of phrases in a text of small numbers; the text ends with its only 0."""

    def __init__(self, levels: np.ndarray, counts: np.ndarray, sampled: np.ndarray, samples: np.ndarray):
        """From the bits of the wavelet matrix, one row a level, the number of each symbol, the sampled rows and their places."""
        self.levels, self.counts, self.marks, self.samples = levels, counts, sampled, samples
        self.bits, self.n = levels.shape
        self.before = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        self.ones = np.zeros((self.bits, self.n + 1), np.int32)
        np.cumsum(levels, axis=1, out=self.ones[:, 1:])
        self.zeros = self.n - self.ones[:, -1].astype(np.int64)
        self.sampled = np.concatenate([[0], np.cumsum(sampled)]).astype(np.int32)

    @classmethod
    def build(cls, text: np.ndarray) -> FMIndex:
        suffixes = suffix_array(text.astype(np.uint16) if text.max() < 1 << 16 else text)  # 16 bits: a radix sort
        row = text[suffixes - 1]  # of position 0 the terminal, which is last in the text
        bits = max(1, int(text.max()).bit_length())
        levels = np.zeros((bits, len(text)), bool)
        for level in range(bits):
            levels[level] = bit = row >> (bits - 1 - level) & 1 == 1
            row = np.concatenate([row[~bit], row[bit]])
        sampled = suffixes % SAMPLE == 0
        return cls(levels, np.bincount(text).astype(np.int32), sampled, suffixes[sampled])

    def arrays(self) -> dict[str, np.ndarray]:
        return {"size": np.array([self.bits, self.n]), "levels": np.packbits(self.levels), "symbols": self.counts,
                "sampled": np.packbits(self.marks), "samples": self.samples.astype(np.int32 if self.n < 1 << 31 else np.int64)}

    @classmethod
    def load(cls, arrays) -> FMIndex:
        bits, n = arrays["size"].tolist()
        return cls(np.unpackbits(arrays["levels"], count=bits * n).reshape(bits, n), arrays["symbols"],
                   np.unpackbits(arrays["sampled"], count=n), arrays["samples"].astype(np.int64))

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol stands among the first ``upto`` of the transform."""
        lo, hi = np.zeros_like(upto), upto
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = (symbol >> (self.bits - 1 - level)) & 1 == 1
            lo = np.where(bit, zeros + ones[lo], lo - ones[lo])
            hi = np.where(bit, zeros + ones[hi], hi - ones[hi])
        return hi - lo

    def symbol(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            bit = ones[at + 1] - ones[at]
            at = np.where(bit == 1, zeros + ones[at], at - ones[at])
            out = out * 2 + bit
        return out

    def search(self, codes: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of suffixes that begin with each phrase ``codes[start:start + length]``."""
        lo, hi, step = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64), 2
        unknown = np.concatenate([[0], np.cumsum((codes < 0) | (codes >= len(self.counts)))])
        live = np.flatnonzero(unknown[start + length] == unknown[start])
        last = codes[start[live] + length[live] - 1]
        lo[live], hi[live] = self.before[last], self.before[last + 1]
        live = live[(hi[live] > lo[live]) & (length[live] > 1)]
        while len(live):
            symbol = codes[start[live] + length[live] - step]
            base = self.before[symbol]
            lo[live], hi[live] = base + self.rank(symbol, lo[live]), base + self.rank(symbol, hi[live])
            live = live[(hi[live] > lo[live]) & (length[live] > step)]
            step += 1
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, steps, live = np.zeros(len(rows), np.int64), 0, np.arange(len(rows))
        while len(live):
            hit = self.sampled[rows + 1] > self.sampled[rows]
            out[live[hit]] = self.samples[self.sampled[rows[hit]]] + steps
            live, rows = live[~hit], rows[~hit]
            symbol = self.symbol(rows)
            rows = self.before[symbol] + self.rank(symbol, rows)
            steps += 1
        return out


class Shard:
    """The index over the whole texts of some documents."""

    def __init__(self, counts: np.ndarray, vocabulary: np.ndarray, index: FMIndex):
        self.counts, self.vocabulary, self.index = counts, vocabulary, index
        self.filled = np.flatnonzero(counts)  # texts with words; each begins where those before end, separators included
        self.begin = np.cumsum(counts[self.filled] + 1) - counts[self.filled] - 1

    @classmethod
    def build(cls, texts: pa.Array) -> Shard:
        counts, hashes = np.zeros(len(texts), np.int64), [np.zeros(0, np.uint64)]
        for lo, hi, w in word_slices(texts, ALNUM, lower=True):
            counts[lo:hi] = w.counts()
            hashes.append(w.hashes())
        vocabulary, codes = np.unique(np.concatenate(hashes), return_inverse=True)
        many = counts[counts > 0]
        text = np.ones(len(codes) + len(many) + 1, np.int32)
        text[np.arange(len(codes)) + np.repeat(np.arange(len(many)), many)] = codes + 2
        text[-1] = 0
        return cls(counts, vocabulary, FMIndex.build(text))

    def dump(self, ids: pa.Array) -> bytes:
        out = io.BytesIO()
        np.savez(out, ids=ids.fill_null(0).to_numpy(), named=ids.is_valid().to_numpy(zero_copy_only=False), counts=self.counts.astype(np.int32),
                 vocabulary=self.vocabulary, **self.index.arrays())
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> tuple[pa.Array, Shard]:
        with np.load(io.BytesIO(raw)) as arrays:
            ids = pa.array(arrays["ids"], pa.int64(), mask=~arrays["named"])
            return ids, cls(arrays["counts"].astype(np.int64), arrays["vocabulary"], FMIndex.load(arrays))

    def find(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences: (start, length) in words of the shard, and distinct (text, item) pairs."""
        none = np.zeros(0, np.int64)
        if not phrases.n or not len(self.vocabulary):
            return none, none, none, none
        at = np.minimum(np.searchsorted(self.vocabulary, phrases.vocabulary), len(self.vocabulary) - 1)
        codes = np.where(self.vocabulary[at] == phrases.vocabulary, at + 2, -1)[phrases.codes]
        lo, hi = self.index.search(codes, phrases.start, phrases.length)
        count = hi - lo
        phrase = np.repeat(np.arange(phrases.n), count)
        rows = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())
        place = self.index.locate(rows)
        text = np.searchsorted(self.begin, place, "right") - 1
        pair = np.unique(self.filled[text] * phrases.n + phrase)
        doc, one = pair // phrases.n, pair % phrases.n
        many = phrases.owner_first[one + 1] - phrases.owner_first[one]
        owner = phrases.owners[np.repeat(phrases.owner_first[one] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        return place - text, phrases.length[phrase], np.repeat(doc, many), owner


def _write_pieces(benchmark: DataFrame, item_col: str, text_col: str) -> str:
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    folder = files.new_folder(benchmark.sparkSession, "benchmark")
    items.repartition(1 + chars // PIECE, "item_id").write.parquet(folder)
    return folder


_PIECES: dict[tuple[str, int], list[Phrases]] = {}


def _pieces(folder: str, window: int) -> Iterator[Phrases]:
    """The phrases of each piece; a single piece is kept for later shards."""
    if (folder, window) in _PIECES:
        yield from _PIECES[folder, window]
        return
    system, path = files.split_uri(folder)
    found = [f.path for f in system.get_file_info(fs.FileSelector(path)) if f.path.endswith(".parquet")]
    for file in sorted(found):
        table = pq.read_table(file, filesystem=system)
        phrases = Phrases(table.column("item_id").to_pylist(), table.column("text"), window)
        if len(found) == 1:
            _PIECES.clear()
            _PIECES[folder, window] = [phrases]
        yield phrases
    if not found:
        _PIECES[folder, window] = []


def judge(shard: Shard, folder: str, window: int, share: float) -> dict[str, pa.Array]:
    """All columns of ``HITS`` but the id, for a shard."""
    counts, n, per_hit = shard.counts, len(shard.counts), round(1 / share)
    text_of = np.repeat(np.arange(n), counts)
    starts, lengths, found = [], [], [set() for _ in range(n)]
    for phrases in _pieces(folder, window):
        start, length, doc, owner = shard.find(phrases)
        starts.append(start)
        lengths.append(length)
        for d, o in zip(doc.tolist(), owner.tolist(), strict=True):
            found[d].add(str(phrases.items[o]))
    hit = np.zeros(len(text_of), bool)
    if starts:
        hit = cover(np.concatenate(starts), np.concatenate(lengths), len(text_of))
    first = np.cumsum(counts) - counts
    at = np.flatnonzero(hit)
    n_hit = np.bincount(text_of[at], minlength=n)
    head = np.ones(len(at), bool)
    head[1:] = (at[1:] != at[:-1] + 1) | (text_of[at[1:]] != text_of[at[:-1]])
    begin, end = at[head], at[np.append(head[1:], True)[:len(at)]] + 1
    owner = text_of[begin]
    spans: list[list] = [[] for _ in range(n)]
    for d, b, e in zip(owner.tolist(), (begin - first[owner]).tolist(), (end - first[owner]).tolist(), strict=True):
        spans[d].append({"start": b, "end": e})
    return {"n_words": pa.array(counts, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()),
            "n_items": pa.array([len(f) for f in found], pa.int64()),
            "items_sha256": pa.array([hashlib.sha256(",".join(sorted(f)).encode()).hexdigest() for f in found], pa.string()),
            "contaminated": pa.array((n_hit > 0) & (per_hit * n_hit >= counts), pa.bool_()),
            "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))}


def shards(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of documents; memory follows their bytes, not their number."""
    return slices(buffers(texts)[1])


def index_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Index every shard once; (file, offset, length, docs) of each, read back from the shared folder. No row is shuffled."""
    folder = files.new_folder(docs.sparkSession, "fm-index")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, stream, at = "", None, 0
        for batch in batches:
            out = []
            for lo, hi in shards(batch.column(1)):
                if stream is None:
                    uri, stream = files.create(folder, ".fm")
                raw = Shard.build(batch.column(1).slice(lo, hi - lo)).dump(batch.column(0).slice(lo, hi - lo))
                stream.write(raw)
                out.append({"file": uri, "offset": at, "length": len(raw), "docs": hi - lo})
                at += len(raw)
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([
                ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("docs", pa.int64())]))
        if stream is not None:
            stream.close()
        files.tidy()

    return files.stage(rows.mapInArrow(run, "file string, offset long, length long, docs long"))


def search_index(index: DataFrame, benchmark: DataFrame, window: int = 13, share: float = 0.05, item_col: str = "item_id",
                 text_col: str = "text") -> DataFrame:
    """``HITS`` of all documents of an index; a task reads about as much as one that wrote a file."""
    folder = _write_pieces(benchmark, item_col, text_col)
    tasks = index.select("file").distinct().count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, at, length in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                with files.read_at(uri) as f:
                    f.seek(at)
                    ids, shard = Shard.load(f.read(length))
                got = judge(shard, folder, window, share)
                yield pa.RecordBatch.from_arrays([ids, *got.values()], names=["doc_id", *got])
        files.tidy()

    return index.repartition(max(1, tasks), "file", "offset").mapInArrow(run, HITS)


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: float = 0.05,
                       id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """One row per document (``HITS``): words, hit words, items found, and the word spans to remove.

    ``contaminated``: at least one word is hit, and at least ``share`` of all.
    """
    return search_index(index_texts(docs, id_col, text_col), benchmark, window, share, item_col, text_col)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: float = 0.05,
                      text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    folder, at = _write_pieces(benchmark, item_col, "text"), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in shards(batch.column(at)):
                part = batch.slice(lo, hi - lo)
                yield part.filter(pc.invert(judge(Shard.build(part.column(at)), folder, window, share)["contaminated"]))
        files.tidy()

    return docs.mapInArrow(run, docs.schema)
