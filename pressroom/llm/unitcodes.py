"""Token ids of many texts: each distinct piece of text goes through the tokenizer once per worker.

A text is cut where the tokenizer's own splitting always cuts: before a run of white space, between
a letter (ASCII, or À to ÿ) and an ASCII sign other than the apostrophe, and after a single line feed before a
letter. The ids of a text are the ids of its pieces, one after the other. Texts holding characters for
which this does not hold (special tokens, white space beyond ASCII) are encoded whole.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .arrays import buffers, byte_set, slices

SPACE = byte_set((0x20, 0x20), (0x09, 0x0D))
LETTER = byte_set((0x41, 0x5A), (0x61, 0x7A))
SIGN = byte_set((0x21, 0x26), (0x28, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
_ODD = byte_set((0x1C, 0x1F), (0xC2, 0xC2), (0xE1, 0xE3))
_LATIN = "^[ \n]?[A-Za-zÀ-ÖØ-öø-ÿ]+$"
_LED = "^ [^ \t\n\r\x0b\x0c]"
_WHOLE = re.compile(rb"<\||[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
#: Distinct pieces a worker remembers, and their characters; beyond that it forgets those met once, or all if
#: that leaves more than half (results are the same).
REMEMBERED, REMEMBERED_CHARS = 400_000, 32 << 20
SLICE = 8 << 20  # bytes of text handled at once, or one longer text


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer file of the given name."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """``encode``: ids and offsets of a string array. ``path`` is a file of the tokenizers library."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        size = max(vocab.values()) + 1
        self.first_of_unit, self.last_of_unit = np.zeros(size, bool), np.zeros(size, bool)
        for token, i in vocab.items():
            self.first_of_unit[i] = token.startswith("Ġ")
            self.last_of_unit[i] = token.endswith("</w>")
        self.word_ends = bool(self.last_of_unit.any())
        self._forget()

    def _forget(self) -> None:
        self.entry: dict[str, int] = {}
        self.chars = 0
        self.at, self.length, self.again = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, bool)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def _forget_rare(self) -> None:
        """Keep the pieces that were met again since the last time."""
        kept = np.flatnonzero(self.again[:len(self.entry)])
        units = list(itertools.compress(self.entry, self.again.tolist()))
        at, length = self.at[kept], self.length[kept]
        ids = self.pool[np.repeat(at - (np.cumsum(length) - length), length) + np.arange(length.sum())]
        self._forget()
        if len(units) <= REMEMBERED // 2 and sum(map(len, units)) <= REMEMBERED_CHARS // 2:
            self._learn(units, ids, length)

    def _learn(self, units: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        k = len(self.entry)
        while k + len(units) > len(self.at):
            self.at, self.length, self.again = (np.resize(x, 2 * len(x)) for x in (self.at, self.length, self.again))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.pool[self.used:self.used + len(ids)] = ids
        self.at[k:k + len(units)] = self.used + np.cumsum(lengths) - lengths
        self.length[k:k + len(units)] = lengths
        self.again[k:k + len(units)] = False
        self.used += len(ids)
        self.chars += sum(map(len, units))
        self.entry.update(zip(units, range(k, k + len(units)), strict=True))

    def _plain(self, units: list[str]) -> None:
        for i in range(0, len(units), 1000):
            some = [e.ids for e in self.tokenizer.encode_batch_fast(units[i:i + 1000], add_special_tokens=False)]
            lengths = np.array([len(x) for x in some], np.int64)
            self._learn(units[i:i + 1000], np.fromiter((t for x in some for t in x), np.uint32, int(lengths.sum())), lengths)

    def _joined(self, units: list[str]) -> None:
        """Many one-word units in one call; where a unit begins or ends shows in its tokens."""
        for i in range(0, len(units), 1000):
            some = units[i:i + 1000]
            text = " ".join(some) if self.word_ends else "".join(some)
            found, = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)  # without offsets, which nobody reads
            ids = np.array(found.ids, np.uint32)
            if self.word_ends:
                ends = np.flatnonzero(self.last_of_unit[ids]) + 1
                starts = np.concatenate([[0], ends[:-1]])
            else:
                starts = np.flatnonzero(self.first_of_unit[ids])
                ends = np.append(starts[1:], len(ids))
            if len(starts) == len(some):
                self._learn(some, ids, ends - starts)
            else:
                self._plain(some)

    def _entries(self, pieces: pa.Array) -> np.ndarray:
        units = pieces.to_pylist()
        if len(self.entry) + len(units) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self._forget_rare()
        out = np.array(list(map(self.entry.get, units, itertools.repeat(-1))), np.int64)
        self.again[out[out >= 0]] = True
        if len(new := np.flatnonzero(out < 0)):
            fast = pc.match_substring_regex(pieces.take(pa.array(new)), _LATIN if self.word_ends else _LED).to_numpy(zero_copy_only=False)
            for some, learn in ((new[fast], self._joined), (new[~fast], self._plain)):
                out[some] = len(self.entry) + np.arange(len(some))  # entries are numbered as they are learned
                learn([units[i] for i in some.tolist()])
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text begins (n + 1 offsets); null texts have none."""
        data, offsets = buffers(texts)
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for lo, hi in slices(offsets, SLICE):
            i, c = self._slice(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
            ids.append(i)
            counts.append(c)
        count = np.concatenate(counts)
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(count)])

    def _slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        space, letter, sign = SPACE[data], LETTER[data], SIGN[data]
        cut = np.zeros(n, bool)
        starts, ends = letter.copy(), letter.copy()  # of letters, those of two bytes from À to ÿ among them
        pair = np.flatnonzero(data[:-1] == 0xC3)
        pair = pair[(data[pair + 1] != 0x97) & (data[pair + 1] != 0xB7)]
        starts[pair] = ends[pair + 1] = True
        cut[1:] = space[1:] & ~space[:-1] | ends[:-1] & sign[1:] | sign[:-1] & starts[1:]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        feed = data == 0x0A
        cut[2:] |= letter[2:] & feed[1:-1] & ~space[:-2] & ~edge[1:n - 1]
        cut |= edge[:n]
        start = np.flatnonzero(cut)
        at = np.append(start, n).astype(np.int32)
        units = pa.StringArray.from_buffers(len(start), pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data)))
        coded = units.dictionary_encode()
        entry = self._entries(coded.dictionary)[coded.indices.to_numpy()]
        length, at = self.length[entry], self.at[entry]
        ends = np.cumsum(length)
        place = np.repeat(at - (ends - length), length)
        place += np.arange(ends[-1])
        ids = self.pool.take(place)
        first = np.searchsorted(start, offsets)
        ends = np.concatenate([[0], ends])
        counts = ends[first[1:]] - ends[first[:-1]]
        if len(whole := self._whole(data, offsets)):
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for i in whole:
                text = data[offsets[i]:offsets[i + 1]].tobytes().decode()
                parts[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
                counts[i] = len(parts[i])
            ids = np.concatenate(parts)
        return ids, counts

    @staticmethod
    def _whole(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Texts that must not be cut."""
        near = np.flatnonzero(_ODD[data])
        bar = np.flatnonzero(data[1:] == 0x7C)
        near = np.concatenate([near, bar[data[bar] == 0x3C]])
        if not len(near):
            return near
        which = np.unique(np.searchsorted(offsets, near, "right") - 1)
        return np.array([i for i in which if _WHOLE.search(data[offsets[i]:offsets[i + 1]].tobytes())], np.int64)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file; it stays for later tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
