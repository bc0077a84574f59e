"""Personal data in texts: four patterns, and a skip-chain conditional random field that makes labels agree.

The variables of a text are its tokens with a digit or an at sign. Neighbours in the text share a chain potential;
tokens that repeat or are alike (the same letters and digits) share a skip potential, each with the next one
like it, so a token of a thousand occurrences has a thousand edges. Tokens inside a pattern's match are
observed. Loopy sum-product messages give the marginals of the others; those that are sure of a kind become
further spans. Matches of the patterns are never changed.

The weights are fitted by pseudo-likelihood to the patterns' own labels on at most ``sample_docs`` documents
(those of smallest id hash): one number per feature and label, small whatever the corpus.

Null and empty texts have no spans; repeated rows are handled each; an empty table gives no row; other columns
are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import buffers, slices
from .files import tidy

KINDS = ("email", "ip", "card", "phone")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+){3,}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_TOKEN = re.compile(r"[^\s]*[0-9@][^\s]*")
_CUES = (re.compile("phone|tel|call|mobile|fax", re.I), re.compile("mail|contact|write", re.I),
         re.compile("card|visa|credit|pay", re.I), re.compile("ip|host|server|addr", re.I))
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
#: Sweeps of messages, their damping, and the marginal from which a token becomes a span.
SWEEPS, DAMPING, SURE = 12, 0.5, 0.9
NEAR = 40  # characters between neighbours of the chain
N_FEATURES = 32
FAILED = {12, 19}  # features of tokens that a pattern's check has turned down


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def patterns(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the patterns' matches, by kind and start."""
    out = []
    if "@" in text:
        done, at, before = 0, text.find("@"), 0
        while at >= 0:
            low = max(done, before)
            m = _LOCAL.match(text[low:at][::-1])
            if m and (d := _DOMAIN.match(text, at)):
                out.append((0, at - m.end(), d.end()))
                done = d.end()
            before = at + 1
            at = text.find("@", at + 1)
    if not _DIGIT.search(text):
        return out
    if "." in text:
        for m in _DOTTED.finditer(text):
            parts, at = m.group().split("."), m.start()
            for i in range(0, len(parts) - 3, 4):
                end = at + sum(map(len, parts[i:i + 4])) + 3
                values = [p.lstrip("0") for p in parts[i:i + 4]]  # a part may have thousands of zeros
                if all(len(v) <= 3 and int(v or 0) <= 255 for v in values):
                    out.append((1, at, end))
                at = end + 1
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((3, *m.span()))
    return out


class Tokens:
    """The variables of a text: places, labels of the patterns (-1 where none), features, edges."""

    def __init__(self, text: str, found: list[tuple[int, int, int]]):
        spans = sorted((s, e, k) for k, s, e in found)
        self.start, self.end, self.label, self.features = [], [], [], []
        last: dict[str, int] = {}
        chain, skip, at = [], [], 0
        for m in _TOKEN.finditer(text):
            start, end = m.span()
            while start < end and not text[start].isalnum() and text[start] != "+":
                start += 1
            while end > start and not text[end - 1].isalnum():
                end -= 1
            if start == end:
                continue
            while at < len(spans) and spans[at][1] <= start:
                at += 1
            inside = at < len(spans) and spans[at][0] < end
            i = len(self.start)
            if i and start - self.end[-1] <= NEAR:
                chain.append((i - 1, i))
            token = text[start:end]
            form = "".join(c for c in token.lower() if c.isalnum())
            if len(form) >= 4:
                if form in last:
                    skip.append((last[form], i))
                last[form] = i
            self.start.append(start)
            self.end.append(end)
            self.label.append(1 + spans[at][2] if inside else 0)
            self.features.append(_features(token, text[max(0, start - 24):start]))
        self.chain, self.skip = chain, skip


def _features(token: str, before: str) -> list[int]:
    digits = [c for c in token if "0" <= c <= "9"]
    n, letters = len(digits), sum(c.isalpha() for c in token)
    out = [0, 1 + sum(n >= x for x in (1, 4, 7, 9, 12, 13, 20))]  # 1 to 8
    local, _, domain = token.partition("@")
    if domain:
        out.append(9 if local and "." in domain else 10)
    dots = token.count(".")
    if dots == 3 and not letters:
        parts = token.split(".")
        out.append(11 if all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts) else 12)
    out.append(13 if not letters else 14 if n else 15)
    if token[0] == "+":
        out.append(16)
    if "-" in token and not letters:
        out.append(17)
    if 13 <= n <= 19 and not letters:
        out.append(18 if luhn("".join(digits)) else 19)
    if letters and n and all(c in "0123456789abcdefABCDEF" for c in token):
        out.append(20)
    if before.rstrip(" ").endswith("("):
        out.append(21)
    out += [22 + i for i, cue in enumerate(_CUES) if cue.search(before)]
    return out


def fit(rows: list[tuple[int, list[int], list[int], list[int], list[int]]], steps: int = 300) -> dict[str, np.ndarray]:
    """Weights from (label, features, labels before, labels after, labels of tokens alike), by pseudo-likelihood."""
    k = len(KINDS) + 1
    w = {"node": np.zeros((N_FEATURES, k)), "chain": np.zeros((k, k)), "skip": np.zeros((k, k))}
    if not rows:
        return w
    y = np.array([r[0] for r in rows])
    x = np.zeros((len(rows), N_FEATURES))
    seen = {c: np.zeros((len(rows), k)) for c in ("before", "after", "alike")}
    for i, (_, features, *labels) in enumerate(rows):
        x[i, features] = 1
        for c, some in zip(seen, labels, strict=True):
            for label in some:
                seen[c][i, label] += 1
    want = np.eye(k)[y]
    for step in range(steps):
        logit = x @ w["node"] + seen["before"] @ w["chain"] + seen["after"] @ w["chain"].T + seen["alike"] @ w["skip"]
        p = np.exp(logit - logit.max(axis=1, keepdims=True))
        error = want - p / p.sum(axis=1, keepdims=True)
        rate = 4.0 / (1 + step / 100) / len(rows)
        w["node"] += rate * (x.T @ error - 0.1 * w["node"])
        w["chain"] += rate * (seen["before"].T @ error + (seen["after"].T @ error).T - 0.1 * w["chain"])
        both = seen["alike"].T @ error
        w["skip"] += rate * (both + both.T - 0.1 * w["skip"])
    return w


def marginals(t: Tokens, w: dict[str, np.ndarray]) -> np.ndarray:
    """Label probabilities of the tokens, by damped loopy sum-product messages in the log domain."""
    n, k = len(t.start), len(KINDS) + 1
    unary = np.zeros((n, k))
    for i, features in enumerate(t.features):
        unary[i] = w["node"][features].sum(axis=0)
    known = np.array(t.label) > 0
    unary[known] = -30.0
    unary[known, np.array(t.label)[known]] = 0.0
    for i, features in enumerate(t.features):  # a failed check digit or a part over 255 is evidence of none
        if not known[i] and FAILED & set(features):
            unary[i], unary[i, 0] = -30.0, 0.0
    edges = np.array(t.chain + t.skip, np.int64).reshape(-1, 2)
    potential = np.concatenate([np.broadcast_to(w["chain"], (len(t.chain), k, k)), np.broadcast_to(w["skip"], (len(t.skip), k, k))])
    source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    potential = np.concatenate([potential, potential.transpose(0, 2, 1)])
    message, m = np.zeros((len(source), k)), len(edges)
    back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
    for _ in range(SWEEPS if m else 0):
        belief = unary.copy()
        np.add.at(belief, target, message)
        out = (belief[source] - message[back])[:, :, None] + potential
        top = out.max(axis=1, keepdims=True)
        new = np.log(np.exp(out - top).sum(axis=1)) + top[:, 0]
        new -= new.max(axis=1, keepdims=True)
        message = DAMPING * message + (1 - DAMPING) * new
    np.add.at(unary, target, message)
    p = np.exp(unary - unary.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def further(text: str, found: list[tuple[int, int, int]], w: dict[str, np.ndarray]) -> list[tuple[int, int, int]]:
    """Spans the field adds to the patterns' matches; neighbours of one kind are one span."""
    t = Tokens(text, found)
    if 0 not in t.label:
        return []
    p = marginals(t, w)
    out: list[tuple[int, int, int]] = []
    last = -2
    for i in np.flatnonzero((np.array(t.label) == 0) & (p[:, 1:].max(axis=1) >= SURE)).tolist():
        kind = int(p[i, 1:].argmax())
        if last == i - 1 and out[-1][0] == kind and t.start[i] - out[-1][2] <= 2:
            out[-1] = (kind, out[-1][1], t.end[i])
        else:
            out.append((kind, t.start[i], t.end[i]))
        last = i
    return out


def train(docs: DataFrame, sample_docs: int = 2000, id_col: str = "doc_id", text_col: str = "text",
          sample_tokens: int = 200) -> dict[str, np.ndarray]:
    """Fit the weights on the first ``sample_tokens`` tokens of at most ``sample_docs`` rows, those of smallest id
    hash; a row counts once however often it is repeated. So the driver gets at most their product of tokens."""
    keyed = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("text")).where("i is not null") \
        .withColumn("h", F.xxhash64("text"))
    picked = keyed.select("i", "h").distinct().orderBy(F.xxhash64("i"), "i", "h").limit(sample_docs).collect()
    wanted = docs.sparkSession.createDataFrame(picked, "i long, h long")
    some = keyed.join(F.broadcast(wanted), ["i", "h"], "left_semi").dropDuplicates(["i", "h"]).select("text")
    kind = "label int, features array<int>, before array<int>, after array<int>, alike array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = pa.list_(pa.int32())
        schema = pa.schema([("label", pa.int32()), ("features", lists), ("before", lists), ("after", lists), ("alike", lists)])
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                t = Tokens(text or "", patterns(text or ""))
                mine = [{"label": y, "features": f, "before": [], "after": [], "alike": []} for y, f in zip(t.label, t.features, strict=True)]
                for i, j in t.chain:
                    mine[i]["after"].append(t.label[j])
                    mine[j]["before"].append(t.label[i])
                for i, j in t.skip:
                    mine[i]["alike"].append(t.label[j])
                    mine[j]["alike"].append(t.label[i])
                rows += mine[:sample_tokens]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    rows = some.mapInArrow(run, kind).collect()
    return fit(sorted((r.label, list(r.features), list(r.before), list(r.after), list(r.alike)) for r in rows))


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def _parts(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """The batches cut to texts of ``SLICE`` bytes together, or one longer text."""
    for batch in batches:
        for lo, hi in slices(buffers(batch.column(at))[1]):
            yield batch.slice(lo, hi - lo)


def find_personal(docs: DataFrame, sample_docs: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: counts and hash of the patterns' matches, all spans as text and as an array."""
    weights = train(docs, sample_docs, id_col, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
            "found array<struct<kind: string, start: int, end: int>>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, 1):
            counts: list[list[int]] = [[], [], [], []]
            base, spans, found = [], [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                mine = patterns(text)
                every = mine + further(text, mine, weights) if "@" in text or _DIGIT.search(text) else mine
                for k in range(4):
                    counts[k].append(sum(m[0] == k for m in mine))
                base.append(hashlib.sha256(_joined(mine).encode()).hexdigest())
                spans.append(_joined(every))
                found.append([{"kind": KINDS[k], "start": s, "end": e} for k, s, e in sorted(every)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.string()),
                 pa.array(spans, pa.string()), pa.array(found, pa.list_(_SPAN))],
                names=[c.split()[0] for c in kind.split(", ")[:7]] + ["found"])
        tidy()

    return rows.mapInArrow(run, kind)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span, overlapping ones together, replaced by the name of its first kind."""
    out, at = [], 0
    merged: list[list[int]] = []
    for s, e, k in sorted((s, e, k) for k, s, e in spans):
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e, k])
    for s, e, k in merged:
        out += [text[at:s], f"<{KINDS[k].upper()}>"]
        at = e
    return "".join(out) + text[at:]


def redact_personal(docs: DataFrame, sample_docs: int = 2000, id_col: str = "doc_id", text_col: str = "text",
                    chars_col: str = "n_chars") -> DataFrame:
    """All rows and columns of ``docs``, personal data in the text replaced and its length set anew."""
    weights = train(docs, sample_docs, id_col, text_col)
    at, chars = docs.columns.index(text_col), docs.columns.index(chars_col) if chars_col in docs.columns else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, at):
            texts = []
            for value in batch.column(at):
                text = value.as_py()
                if text and ("@" in text or _DIGIT.search(text)):
                    mine = patterns(text)
                    if every := mine + further(text, mine, weights):
                        text = redact(text, every)
                texts.append(text)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if chars >= 0:
                columns[chars] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(batch.schema.field(chars).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)
        tidy()

    return docs.mapInArrow(run, docs.schema)
