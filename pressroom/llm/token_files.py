"""Token ids as Simple-8b words in files, and back.

Every 64-bit word holds a selector in its top four bits and 60, 30, 20 ... 1 ids of equal width in the
others; a value of more than 60 bits takes an escape word and a word of its own. Ids are cut into blocks
of ``BLOCK``; a block starts at a word of its own, and the file keeps the place of every block, so blocks
decode independently and all words of many blocks in one array operation per selector.

File: words; places of blocks; doc ids, whether they are null, ids per document; then the three counts
(words, blocks, documents) and ``MAGIC``. All numbers are little-endian.

Null texts are empty and take the end id alone; repeated rows are documents of their own, in the order
of their texts; an empty table gives no file and no row; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files
from .unitcodes import encoder

BLOCK = 1024
MAGIC = b"S8BIDS01"
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)  # of selectors 1 to 14; 0 is the escape
_POWERS = np.array([1 << i for i in range(64)], np.uint64)
_COUNT = np.array([0, *COUNTS, 0], np.int64)
_ESCAPED = np.uint64(1 << 63)
_READ = 4096  # blocks at a time


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of the ids, and the first word of each block; the top bit of a place tells of escapes."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    values = np.zeros(blocks * BLOCK, np.uint64)
    values[:n] = ids
    left = np.full(blocks, BLOCK)
    left[-1] = n - (blocks - 1) * BLOCK
    bits = np.searchsorted(_POWERS, values, "right").astype(np.uint8).reshape(blocks, BLOCK)
    best, escape = np.ones((blocks, BLOCK), np.int16), bits > 60
    place = np.arange(BLOCK, dtype=np.int16)
    for count in COUNTS[-2::-1]:
        fits = bits <= 60 // count
        if not fits.any():
            break
        bad = np.where(fits, np.int16(BLOCK + 64), place)  # past the end anything fits
        bad = np.minimum.accumulate(bad[:, ::-1], axis=1)[:, ::-1]
        best[(bad - place) >= count] = count
    at, rows, taken = np.zeros(blocks, np.int64), np.arange(blocks), []
    while len(rows):  # one word of every block that is not yet at its end
        count = best[rows, at[rows]]
        taken.append((rows, at[rows], count))
        at[rows] += count
        rows = rows[at[rows] < left[rows]]
    row, start, count = (np.concatenate([t[i] for t in taken]) for i in range(3))
    order = np.argsort(row, kind="stable")
    row, start, count = row[order], start[order], count[order].astype(np.int64)
    first = row * BLOCK + start
    wide = escape.reshape(-1)[first]
    place = np.cumsum(1 + wide) - (1 + wide)
    words = np.zeros(int(place[-1] + 1 + wide[-1]), np.uint64)
    padded = np.concatenate([values, np.zeros(64, np.uint64)])
    inside = np.minimum(count, left[row] - start)
    for selector, many in enumerate(COUNTS, 1):
        if len(mine := np.flatnonzero((count == many) & ~wide)):
            held = padded[first[mine][:, None] + np.arange(many)]
            held[np.arange(many) >= inside[mine][:, None]] = 0
            shift = (np.arange(many) * (60 // many)).astype(np.uint64)
            words[place[mine]] = np.bitwise_or.reduce(held << shift, axis=1) | np.uint64(selector << 60)
    words[place[wide] + 1] = values[first[wide]]
    places = np.zeros(blocks, np.uint64)
    head = np.flatnonzero(np.diff(row, prepend=-1))
    places[row[head]] = place[head]
    places[np.unique(row[wide])] |= _ESCAPED
    return words, places


def unpack(words: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """The n ids of whole blocks; ``places`` count from the first of the given words."""
    blocks = len(places)
    if not n:
        return np.zeros(0, np.uint64)
    escaped = np.flatnonzero(places & _ESCAPED)
    begin = (places & ~_ESCAPED).astype(np.int64)
    size = np.diff(np.append(begin, len(words)))
    out = np.zeros((blocks, BLOCK + 64), np.uint64)
    block = np.repeat(np.arange(blocks), size)
    selector = (words >> np.uint64(60)).astype(np.int64)
    count = _COUNT[selector]
    before = np.cumsum(count) - count
    start = before - before[begin][block]
    flat = out.reshape(-1)
    plain = np.ones(blocks, bool)
    plain[escaped] = False
    plain = plain[block]
    for code, many in enumerate(COUNTS, 1):
        if len(mine := np.flatnonzero((selector == code) & plain)):
            shift = (np.arange(many) * (60 // many)).astype(np.uint64)
            held = (words[mine][:, None] >> shift) & np.uint64((1 << 60 // many) - 1)
            flat[(block[mine] * (BLOCK + 64) + start[mine])[:, None] + np.arange(many)] = held
    for b in escaped:
        at, i = 0, begin[b]
        while i < begin[b] + size[b]:
            code = int(words[i] >> np.uint64(60))
            if not code:
                out[b, at], at, i = words[i + 1], at + 1, i + 2
                continue
            many = COUNTS[code - 1]
            shift = (np.arange(many) * (60 // many)).astype(np.uint64)
            out[b, at:at + many] = (words[i] >> shift) & np.uint64((1 << 60 // many) - 1)
            at, i = at + many, i + 1
    return out[:, :BLOCK].reshape(-1)[:n]


class Writer:
    """One file: documents in the order they come, whole blocks as soon as they are full."""

    def __init__(self, folder: str):
        self.uri, self.stream = files.create(folder, ".s8b")
        self.rest, self.places, self.words = [], [], 0
        self.held, self.docs, self.lengths = 0, [], []

    def add(self, doc_ids: list, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.docs += doc_ids
        self.lengths.append(lengths)
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= 256 * BLOCK:
            self._flush(self.held // BLOCK * BLOCK)

    def _flush(self, n: int) -> None:
        ids = np.concatenate([*self.rest, np.zeros(0, np.uint32)])
        self.rest, self.held = [ids[n:]], len(ids) - n
        words, places = pack(ids[:n])
        self.places.append(places + np.uint64(self.words))
        self.words += len(words)
        self.stream.write(words.astype("<u8").tobytes())

    def close(self) -> tuple[str, int, int]:
        self._flush(self.held)
        lengths = np.concatenate([*self.lengths, np.zeros(0, np.int64)])
        places = np.concatenate(self.places)
        null = np.array([d is None for d in self.docs], np.uint8)
        docs = np.array([0 if d is None else d for d in self.docs], "<i8")
        for part in (places.astype("<u8"), docs, null, lengths.astype("<u8"),
                     np.array([self.words, len(places), len(docs)], "<u8")):
            self.stream.write(part.tobytes())
        self.stream.write(MAGIC)
        self.stream.close()
        return self.uri, len(docs), int(lengths.sum())


def read_file(uri: str) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(doc ids, ids, ids per document) for runs of documents, block ranges read as they are needed."""
    with files.read_at(uri) as f:
        size = f.size()
        f.seek(size - 32)
        tail = f.read(32)
        if tail[24:] != MAGIC:
            raise ValueError(f"{uri} is not a file of packed token ids")
        n_words, n_blocks, n_docs = (int(x) for x in np.frombuffer(tail[:24], "<u8"))
        f.seek(8 * n_words)
        foot = f.read(8 * n_blocks + 17 * n_docs)
        places = np.frombuffer(foot, "<u8", n_blocks)
        docs = np.frombuffer(foot, "<i8", n_docs, 8 * n_blocks)
        null = np.frombuffer(foot, np.uint8, n_docs, 8 * n_blocks + 8 * n_docs)
        lengths = np.frombuffer(foot, "<u8", n_docs, 8 * n_blocks + 9 * n_docs).astype(np.int64)
        names = [None if z else int(d) for d, z in zip(docs, null, strict=True)]
        total, done, rest, got = int(lengths.sum()), 0, np.zeros(0, np.uint32), 0
        ends = np.cumsum(lengths)
        for lo in range(0, n_blocks, _READ):
            hi = min(lo + _READ, n_blocks)
            begin = int(places[lo] & ~_ESCAPED)
            end = int(places[hi] & ~_ESCAPED) if hi < n_blocks else n_words
            f.seek(8 * begin)
            words = np.frombuffer(f.read(8 * (end - begin)), "<u8")
            n = min(total - lo * BLOCK, (hi - lo) * BLOCK)
            rest = np.concatenate([rest, unpack(words, places[lo:hi] - np.uint64(begin), n).astype(np.uint32)])
            got += n
            upto = int(np.searchsorted(ends, got, "right"))
            if upto > done:
                take = int(lengths[done:upto].sum())
                yield names[done:upto], rest[:take], lengths[done:upto]
                rest, done = rest[take:], upto
        if done < n_docs:
            yield names[done:], rest, lengths[done:]


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with an end id after each document, and the new lengths."""
    lengths = np.diff(offsets) + 1
    out = np.full(int(lengths.sum()), end_id, np.uint32)
    keep = np.ones(len(out), bool)
    keep[np.cumsum(lengths) - 1] = False
    out[keep] = ids
    return out, lengths


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of all texts in ascending order of ids; returns (file, first_id, n_docs, n_ids) per file.

    Each file is a range of ids, so no order over all rows meets in one task. The manifest has one row per
    partition and is the only thing that reaches the driver.
    """
    spark = docs.sparkSession
    folder = files.new_folder(spark, "tokens")
    rows = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
            .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, first = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(0).to_pylist()
            if out is None:
                out, first = Writer(folder), names[0]
            ids, lengths = with_end(*encoder(tokenizer).encode(batch.column(1)), end_id)
            out.add(names, ids, lengths)
        if out is not None:
            uri, n_docs, n_ids = out.close()
            yield pa.RecordBatch.from_pydict({"file": [uri], "first_id": pa.array([first], pa.int64()),
                                              "n_docs": pa.array([n_docs], pa.int64()), "n_ids": pa.array([n_ids], pa.int64())})

    kind = "file string, first_id long, n_docs long, n_ids long"
    return spark.createDataFrame(rows.mapInArrow(write, kind).collect(), kind)


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32."""
    spark = manifest.sparkSession
    rows, start = [], 0
    for r in sorted(manifest.collect(), key=lambda r: (r.first_id is not None, r.first_id or 0)):
        rows.append((r.file, start))
        start += r.n_ids
    kind = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not rows:
        return spark.createDataFrame([], kind)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for names, ids, lengths in read_file(uri):
                    ends = np.cumsum(lengths)
                    raw = memoryview(ids.astype("<u4").tobytes())
                    crc = [zlib.crc32(raw[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(names, pa.int64()), "start": pa.array(at + ends - lengths, pa.int64()),
                        "n_tokens": pa.array(lengths, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})
                    at += int(lengths.sum())

    return spark.createDataFrame(rows, "file string, start long").repartition(len(rows)).mapInArrow(read, kind)
