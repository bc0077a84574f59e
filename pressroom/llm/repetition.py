"""Quality rules on whole texts: simple counts, and repeated substrings from a suffix array.

The words of many texts are sorted as suffixes at once (the same word in two texts is two symbols, so
suffixes of different texts never meet). Neighbours in that order give longest common prefixes; the
larger of a place's two is the length of the longest repeat that begins there, and places whose left
neighbour has a longer one are not left-maximal. The spans of all maximal repeats of at least
``min_repeat`` words are united; a text fails if they cover more than ``max_covered`` of its words, or
if one repeat is longer than ``max_repeat`` words and than ``max_repeat_share`` of the text.

Null and empty texts have no words and fail the length rule; repeated rows are judged each and alike; an
empty table gives no row; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import _BYTES, PLAIN, Rolling, Words, byte_set, cover, mix, per_text, word_slices
from .files import tidy
from .fm_index import suffix_array

SYMBOL = byte_set(*((ord(c), ord(c)) for c in "#*$%&|<>"))
KIND = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, longest_repeat long, n_covered long")


def longest_repeats(words: Words) -> np.ndarray:
    """For each word, the length of the longest run of words from there that its text has once more."""
    n = words.n
    if n < 2:
        return np.zeros(n, np.int64)
    _, code = np.unique(words.hashes(), return_inverse=True)
    _, code = np.unique(words.text_of() * n + code, return_inverse=True)
    order = suffix_array(code)
    one, two = order[:-1], order[1:]
    roll = Rolling(mix(code.astype(np.uint64) + np.uint64(1)), 1)
    common = (code[one] == code[two]).astype(np.int64)
    live = np.flatnonzero(common)
    low, high = common[live], n - np.maximum(one[live], two[live])  # equal to low words, at most high
    while len(live):
        middle = (low + high + 1) // 2
        # lengths grow by doubling first, so that the many short repeats take few steps
        middle = np.minimum(middle, 2 * low)
        middle = np.where(middle <= low, low + 1, middle)
        over = low >= high
        same = np.zeros(len(live), bool)
        ok = ~over
        same[ok] = roll.span(one[live[ok]], middle[ok]) == roll.span(two[live[ok]], middle[ok])
        low = np.where(same, middle, low)
        high = np.where(same | over, high, middle - 1)
        done = low >= high
        common[live[done]] = low[done]
        live, low, high = live[~done], low[~done], high[~done]
    longest = np.zeros(n, np.int64)
    longest[order[1:]] = common
    longest[order[:-1]] = np.maximum(longest[order[:-1]], common)
    return longest


def _duplicate_lines(w: Words) -> np.ndarray:
    """Per text, the lines with a word that equal an earlier line of the text."""
    n = len(w.data)
    feed = w.data == 0x0A
    edge = np.zeros(n + 1, bool)
    edge[w.offsets[:-1]] = True
    edge[1:n + 1] |= feed
    edge = edge[:n]
    begin = np.flatnonzero(edge)
    end = np.append(begin[1:], n)
    if not len(begin):
        return np.zeros(len(w.offsets) - 1, np.int64)
    end = end - (feed[end - 1])
    filled = np.searchsorted(w.start, end) > np.searchsorted(w.start, begin)
    begin, end = begin[filled], end[filled]
    text = np.searchsorted(w.offsets, begin, "right") - 1
    line = mix(Rolling(_BYTES[w.data], 0).span(begin, end - begin) + (end - begin).astype(np.uint64))
    line = mix(line + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(line, return_index=True)
    many = len(w.offsets) - 1
    return np.bincount(text, minlength=many) - np.bincount(text[first], minlength=many)


def judge(texts: pa.Array, min_words: int, max_repeat_words: float, min_repeat: int, max_covered: float,
          max_repeat: int, max_repeat_share: float) -> dict[str, np.ndarray]:
    """All counts and verdicts of some texts."""
    parts = []
    for _, _, w in word_slices(texts, PLAIN):
        count = w.counts()
        inside = PLAIN[w.data] & ((w.data & 0xC0) != 0x80)
        chars = per_text(inside, w.offsets)
        symbols = per_text(SYMBOL[w.data], w.offsets)
        longest = longest_repeats(w)
        repeated = per_text(cover(np.flatnonzero(longest >= 3), 3, w.n), w.first)
        left = np.concatenate([[0], longest[:-1]]) if w.n else longest
        maximal = np.flatnonzero((longest >= min_repeat) & ~((left > longest) & (left > 0)))
        covered = per_text(cover(maximal, longest[maximal], w.n), w.first)
        most = np.zeros(len(count), np.int64)
        np.maximum.at(most, w.text_of(), longest)
        failed = (count < min_words) | (100 * repeated > round(100 * max_repeat_words) * count)
        bad = (covered > max_covered * count) | ((most > max_repeat) & (most > max_repeat_share * count))
        parts.append((count, chars, symbols, _duplicate_lines(w), repeated, failed, ~failed & ~bad, most, covered))
    names = [c.split()[0] for c in KIND.split(", ")][1:]
    if not parts:
        return {k: np.zeros(0, bool if k in ("base_failed", "kept") else np.int64) for k in names}
    return {k: np.concatenate(v) for k, v in zip(names, zip(*parts, strict=True), strict=True)}


def quality(docs: DataFrame, min_words: int = 50, max_repeat_words: float = 0.5, min_repeat: int = 10,
            max_covered: float = 0.3, max_repeat: int = 100, max_repeat_share: float = 0.2,
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document (``KIND``), without a shuffle."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = judge(batch.column(1), min_words, max_repeat_words, min_repeat, max_covered, max_repeat, max_repeat_share)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v) for v in got.values())],
                                             names=["doc_id", *got])
        tidy()

    return rows.mapInArrow(run, KIND)


def keep_good(docs: DataFrame, **rules) -> DataFrame:
    """The documents that pass, with all their columns.

    Judged where they are: the verdict is a column of the same row, so copies and null ids are no matter.
    """
    text = rules.pop("text_col", "text")
    kind, names = docs.schema, docs.columns
    at = names.index(text)
    limits = {"min_words": 50, "max_repeat_words": 0.5, "min_repeat": 10, "max_covered": 0.3, "max_repeat": 100,
              "max_repeat_share": 0.2, **rules}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(judge(batch.column(at), **limits)["kept"]))
        tidy()

    return docs.mapInArrow(run, kind)
