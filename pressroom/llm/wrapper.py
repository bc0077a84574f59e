"""Main text of web pages by wrapper induction over the pages of a host.

Every page is parsed into a tree of elements. The pages of a host are aligned with one of them, the seed, by
simple tree matching: equal labels in order, the largest number of matched nodes, and among such alignments one
with the most equal texts. Over all distinct pages of the host, a seed block whose text stays the same, with all below it, is
template, inside the slot too (but not inside an article element, which says itself what the article is); where text varies, it counts for its node. The content slot is found from the top: as long as one
child container holds most of the varying text, it is the slot. From each page the node aligned with the slot gives the
text, without template nodes and without the elements HTML has for other things (menus, footers, forms ...).

Names of classes only settle what alignment leaves open. A container all of whose name speaks of boilerplate
("ad", "share-buttons", not "search-history") is left out, unless ``MOST`` of the varying text of its host
lies in it; names of text blocks (paragraphs, headings, quotes) count for nothing; reader comments, which vary as the article
does, are known by name alone.

A page most of whose text is the seed's is a near copy and has no say in what is template. A host of fewer than
``least_pages`` other pages has no template, and pages of such hosts, or without the slot, are read by the same descent over
their own text, by the same names.

Only skeletons (labels, text hashes and lengths) are shuffled to find the seed and the wrapper; a task adds up
its pages before anything is sent on, and the joins on the host are plain skew joins, so a host with a third
of all pages is split. Lists of children are matched in memory of their length times its square root.

Null and empty html give empty text; a null url is a host of its own; repeated pages give a row each but
count once for the wrapper; pages may be nested thousands deep; an empty table gives no row; other columns are not read.
Texts count as equal by 64 bits of their digest.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style textarea title noscript iframe xmp noembed noframes".split()
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter output q ruby rb rt rp s samp "
    "small span strike strong sub sup time tt u var wbr img".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre search section table ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"},
         "option": {"select"}, "tbody": {"table"}}
# names of boilerplate
DROPPED = frozenset(
    "head script style noscript template nav aside footer form select button input textarea iframe svg canvas object embed "
    "audio video map dialog menu title xmp noembed noframes".split())
COMMENTS = frozenset("comment comments commentlist reply replies respond disqus".split())
WORDS = COMMENTS | frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion sidebar side-bar menu nav navbar "
    "navigation breadcrumb breadcrumbs footer masthead topbar toolbar cookie cookies consent gdpr notice notices banner popup modal "
    "overlay newsletter subscribe subscription signup login share sharing social related recommended search widget pagination "
    "pager alert outbrain taboola".split())
BESIDE = frozenset(  # may stand beside one of them in a name
    "area articles bar block body bottom box buttons container content count form group header inner item items left links list "
    "main outer panel posts right row section site slot thread top unit wrap wrapper zone".split())
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
CONTAINERS = frozenset("html body div section article main td table tbody tr center span".split())
_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>?", re.S)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW}
MOST = 0.5
COPY = 0.8  # share of equal text from which a page is a near copy of the seed
WIDE = 2_000  # pairs of children from which rows are filled as arrays, to the same result


class Tree:
    """Elements in page order; node 0 is the page."""

    def __init__(self) -> None:
        self.label, self.tag, self.parent, self.children = ["#"], ["#"], [-1], [[]]
        self.drop = [0]  # 1 by its name, 2 by its element or as comments
        self.pieces: list[tuple[int, str]] = []  # text, or a break where it is empty

    def add(self, tag: str, names: str, parent: int) -> int:
        node = len(self.tag)
        self.tag.append(tag)
        self.label.append(f"{tag}.{names}" if names else tag)
        self.parent.append(parent)
        self.children[parent].append(node)
        self.children.append([])
        self.drop.append(_drop(self.label[node]))
        return node

    def own_text(self) -> list[list[str]]:
        out: list[list[str]] = [[] for _ in self.tag]
        for node, text in self.pieces:
            if text:
                out[node].append(text)
        return out


@lru_cache(1 << 14)
def _drop(label: str) -> int:
    tag, _, names = label.partition(".")
    found = 2 if tag in DROPPED else 0
    if tag in TEXTUAL:
        return found
    for name in names.lower().split():
        parts = [name] if name in WORDS else [p for p in re.split("[-_:0-9]+", name) if p]
        if any(p in WORDS for p in parts) and all(p in WORDS or p in BESIDE for p in parts):
            found = max(found, 2 if any(p in COMMENTS for p in parts) else 1)
    return found


def parse(page: str) -> Tree:
    tree, stack, at, n = Tree(), [0], 0, len(page)
    lower_ends = _ENDS
    pieces = tree.pieces
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            pieces.append((stack[-1], entities.unescape(page[at:])))
            break
        if m.start() > at:
            text = page[at:m.start()]
            pieces.append((stack[-1], entities.unescape(text) if "&" in text else text))
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if tag not in INLINE:
            pieces.append((stack[-1], ""))
        if m.group(1):
            for i in range(len(stack) - 1, 0, -1):
                if tree.tag[stack[i]] == tag:
                    del stack[i:]
                    break
            continue
        if tag in CLOSES_P:
            _close(tree, stack, {"p"}, CONTAINERS)
        if tag in CLOSES:
            _close(tree, stack, CLOSES[tag], HOLDS[tag])
        names = " ".join(a or b or c for k, a, b, c in _NAMES.findall(m.group(3))) if "=" in m.group(3) else ""
        node = tree.add(tag, names, stack[-1])
        if tag in VOID:
            continue
        if tag in lower_ends:
            end = lower_ends[tag].search(page, at)
            at = end.end() if end else n
            continue
        stack.append(node)
    return tree


def _close(tree: Tree, stack: list[int], tags: set[str], holders: set[str] | frozenset[str]) -> None:
    for i in range(len(stack) - 1, 0, -1):
        tag = tree.tag[stack[i]]
        if tag in tags:
            if i == 1 or tree.tag[stack[i - 1]] not in tags:
                del stack[i:]
                return
        elif tag in holders:
            break
    for i in range(len(stack) - 1, 0, -1):  # the outermost of several
        if tree.tag[stack[i]] in tags:
            del stack[i:]
            return
        if tree.tag[stack[i]] in holders:
            return


def skeleton(tree: Tree) -> bytes:
    """Labels, depths, and per node the length of its own text and, of those with text, its digest."""
    texts, depth = [" ".join("".join(t).split()) for t in tree.own_text()], [0] * len(tree.tag)
    for i in range(1, len(depth)):
        depth[i] = depth[tree.parent[i]] + 1
    digests = np.array([_digest(t) for t in texts if t], "<i8").tobytes()
    return len(digests).to_bytes(4, "little") + digests + zlib.compress(json.dumps([tree.label, depth, [len(t) for t in texts]]).encode("utf-8"), 6)


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") >> 1 | 1


class Skeleton:
    def __init__(self, raw: bytes):
        split = 4 + int.from_bytes(raw[:4], "little")
        self.label, depth, self.chars = json.loads(zlib.decompress(raw[split:]))
        digests = iter(np.frombuffer(raw[4:split], "<i8").tolist())
        self.hash = [next(digests) if c else 0 for c in self.chars]
        self.drop = [_drop(label) for label in self.label]
        n, at = len(self.label), []
        self.parent, self.size = [-1] * n, [1] * n
        self.children: list[list[int]] = [[] for _ in range(n)]
        for i, d in enumerate(depth):
            del at[d:]
            if d:
                self.parent[i] = at[-1]
                self.children[at[-1]].append(i)
            at.append(i)
        self.shape = [0] * n
        for i in range(n - 1, -1, -1):
            self.shape[i] = hash((self.label[i], tuple(self.shape[c] for c in self.children[i])))
            self.size[i] += sum(self.size[c] for c in self.children[i])


NODE = 1 << 24  # of a score: matched nodes first, equal texts second


def align(a: Skeleton, b: Skeleton) -> list[int]:
    """For each node of a, the node of b that simple tree matching gives it, or -1."""
    scores: dict[tuple[int, int], int] = {}
    found = [-1] * len(a.label)

    def pair(i: int, j: int) -> int:
        """Score of two nodes of one label whose children are settled."""
        if not a.children[i] or not b.children[j]:
            return NODE + (a.hash[i] == b.hash[j] != 0)
        if (i, j) not in scores:  # of one shape: node by node
            scores[i, j] = a.size[i] * NODE + sum(map(_equal, a.hash[i:i + a.size[i]], b.hash[j:j + a.size[i]]))
        return scores[i, j]

    def rows(x: list[int], y: list[int]) -> list[list[int]]:
        table = [[0] * (len(y) + 1)]
        for i in x:
            above, row, best, label = table[-1], [0], 0, a.label[i]
            for k, j in enumerate(y):
                v = above[k + 1] if above[k + 1] > best else best
                if label == b.label[j] and (w := above[k] + pair(i, j)) > v:
                    v = w
                row.append(v)
                best = v
            table.append(row)
        return table

    def row_by_row(x: list[int], y: list[int], above: np.ndarray):
        """The same rows, each as an array after ``above``."""
        numbers = {label: n for n, label in enumerate({b.label[j] for j in y})}
        labels, texts = np.array([numbers[b.label[j]] for j in y]), np.array([b.hash[j] for j in y])
        parents = [k for k, j in enumerate(y) if b.children[j]]
        for i in x:
            same = labels == numbers.get(a.label[i], -1)
            gain = np.where(same, NODE + ((texts == a.hash[i]) & (texts != 0)), 0)
            if a.children[i]:
                for k in parents:
                    if same[k]:
                        gain[k] = pair(i, y[k])
            row = np.concatenate([[0], np.maximum(above[1:], above[:-1] + gain)])
            above = np.maximum.accumulate(row)
            yield above

    def best(x: list[int], y: list[int]) -> int:
        if len(x) * len(y) < WIDE:
            return rows(x, y)[-1][-1]
        last = np.zeros(len(y) + 1, np.int64)
        for last in row_by_row(x, y, last):
            pass
        return int(last[-1])

    def matched(x: list[int], y: list[int]) -> list[tuple[int, int]]:
        """Pairs of a best alignment of two lists of children."""
        if len(x) * len(y) < WIDE:
            return _trace(x, y, rows(x, y), len(y))[0]
        step, out, q = math.isqrt(len(x)) + 1, [], len(y)
        kept = [np.zeros(len(y) + 1, np.int64)]  # every step-th row; the rows between are filled again
        for n, row in enumerate(row_by_row(x, y, kept[0]), 1):
            if n % step == 0:
                kept.append(row)
        for n in range(len(kept) - 1, -1, -1):
            part = x[n * step:(n + 1) * step]
            more, q = _trace(part, y, [kept[n], *row_by_row(part, y, kept[n])], q)
            out += more
        return out

    def open_pair(i: int, j: int) -> bool:
        return bool(a.children[i]) and bool(b.children[j]) and a.shape[i] != b.shape[j] and (i, j) not in scores

    def settle(i: int, j: int) -> None:
        """Scores of a pair and of all pairs below it, children first; a page may be nested thousands deep."""
        stack = [(i, j)]
        while stack:
            i, j = stack[-1]
            if not open_pair(i, j):
                stack.pop()
                continue
            x, y = a.children[i], b.children[j]
            inner = [q for q in y if b.children[q]]
            if below := [(p, q) for p in x if a.children[p] for q in inner if a.label[p] == b.label[q] and open_pair(p, q)]:
                stack += below
            else:
                scores[i, j] = NODE + (a.hash[i] == b.hash[j] != 0) + best(x, y)

    todo = [(0, 0)]
    while todo:
        i, j = todo.pop()
        found[i] = j
        x, y = a.children[i], b.children[j]
        if not x or not y:
            continue
        if a.shape[i] == b.shape[j]:
            todo += zip(x, y, strict=True)
        else:
            settle(i, j)
            todo += matched(x, y)
    return found


def _equal(x: int, y: int) -> bool:
    return x == y != 0


def _trace(x: list[int], y: list[int], table: list, q: int) -> tuple[list[tuple[int, int]], int]:
    """Pairs on the way back from the last row and column q, and the column where it reaches the first row."""
    p, out = len(x), []
    while p and q:
        v = table[p][q]
        if v == table[p - 1][q]:
            p -= 1
        elif v == table[p][q - 1]:
            q -= 1
        else:
            p, q = p - 1, q - 1
            out.append((x[p], y[q]))
    return out, q


def sums_below(s: Skeleton, mass: list[float], out: list[bool]) -> list[float]:
    total = [0.0 if o else float(m) for m, o in zip(mass, out, strict=True)]
    for i in range(len(total) - 1, 0, -1):
        if not out[i] and not out[s.parent[i]]:
            total[s.parent[i]] += total[i]
    return total


def descend(s: Skeleton, mass: list[float], out: list[bool], share: float = 0.6) -> int:
    """The content slot: from the top, the child container with most of the mass outside boilerplate."""
    total, node = sums_below(s, mass, out), 0
    while total[node] > 0:
        inside = [c for c in s.children[node] if not out[c] and s.label[c].split(".")[0] in CONTAINERS]
        best = max(inside, key=lambda c: total[c], default=None)
        if best is None or total[best] < share * total[node] or s.label[node].split(".")[0] == "article":
            break
        node = best
    return node


def own_slot(s: Skeleton) -> int:
    """Of a single page: its only article or main element, else the descent over its own text."""
    for tag in ("article", "main"):
        named = [i for i, x in enumerate(s.label) if x.split(".")[0] == tag and not s.drop[i]]
        if len(named) == 1:
            return named[0]
    return descend(s, s.chars, [d > 0 for d in s.drop])


def extract(tree: Tree, slot: int, template: set[int], content: set[int]) -> str:
    """Text below the slot, blocks joined by one space; ``content`` is what alignment keeps in spite of its name."""
    n = len(tree.tag)
    out = [d == 2 or d == 1 and i not in content for i, d in enumerate(tree.drop)]
    state = [0] * n  # 1 inside, 2 inside and dropped
    articles = [False] * n
    for i in range(1, n):
        p = tree.parent[i]
        articles[i] = articles[p] or tree.tag[i] == "article"
        out[i] |= not articles[i] and (i in template or tree.tag[i] == "header")
        if state[p] == 2 or (i == slot or state[p] == 1) and i != slot and out[i]:
            state[i] = 2
        elif i == slot or state[p]:
            state[i] = 1
    if slot == 0:
        state[0] = 1
        for i in range(1, n):
            p = tree.parent[i]
            state[i] = 2 if state[p] == 2 or out[i] else 1
    return " ".join("".join(t or " " for i, t in tree.pieces if state[i] == 1 or not t).split())


class Wrapper:
    """Sums over the pages of a host: per seed node, pages matched, pages with the same text, varying characters.
    Node -1 counts the pages, and those that are no near copies of the seed."""

    def __init__(self, seed: Skeleton):
        self.seed, self.sums = seed, {-1: [0, 0, 0]}

    def add(self, page: Skeleton) -> None:
        pairs = align(page, self.seed)
        same = [j >= 0 and page.hash[i] == self.seed.hash[j] for i, j in enumerate(pairs)]
        votes = int(sum(c for c, e in zip(page.chars, same, strict=True) if e) < COPY * sum(page.chars))
        self.sums[-1][0] += 1
        self.sums[-1][1] += votes
        for i, j in enumerate(pairs):
            k = i
            while j < 0:  # text without a counterpart counts for the nearest ancestor that has one
                k = page.parent[k]
                j = pairs[k]
            one = self.sums.setdefault(j, [0, 0, 0])
            if k == i:
                one[0] += votes
                one[1] += votes * same[i]
            if not same[i]:
                one[2] += page.chars[i]


def choose(seed: Skeleton, sums: dict[int, list[int]], least_pages: int, constant: float) -> tuple[int, list[int], list[int]]:
    """(slot, template nodes, nodes kept in spite of their names); slot -1 where nothing varies."""
    pages, votes, _ = sums.pop(-1)
    mass = [sums.get(i, (0, 0, 0))[2] for i in range(len(seed.label))]
    varying = sums_below(seed, mass, [d == 2 for d in seed.drop])
    content = [i for i, d in enumerate(seed.drop) if d == 1 and varying[i] > 0 and varying[i] >= MOST * varying[0]]
    kept = set(content)
    slot = descend(seed, mass, [d == 2 or d == 1 and i not in kept for i, d in enumerate(seed.drop)]) if pages > 1 else 0
    # a node is template with all below it, or not at all; without text it is as its children are
    fixed = [votes >= least_pages] * len(seed.label)
    for i in range(len(fixed) - 1, 0, -1):
        if seed.hash[i] and fixed[i]:
            m, e, _ = sums.get(i, (0, 0, 0))
            fixed[i] = 2 * m >= votes and e >= constant * m
        if not fixed[i] and i:
            fixed[seed.parent[i]] = False
    return slot or -1, [i for i, f in enumerate(fixed) if f and seed.hash[i]], content


def extract_text(pages: DataFrame, least_pages: int = 5, constant: float = 0.9, id_col: str = "page_id",
                 url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page. A node is template where its text is the same in ``constant`` of the
    pages it is matched in, those are half or more of its host's pages, and the host has ``least_pages`` besides near copies of the seed."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)", 1))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html"), host.alias("host"))

    def to_skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [skeleton(parse(x or "")) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["host", "page"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, seed, wrapper = None, None, None
        schema = pa.schema([("host", pa.string()), ("node", pa.int64()), ("matched", pa.int64()),
                            ("equal", pa.int64()), ("chars", pa.int64())])

        def sums() -> pa.RecordBatch:
            out = [{"host": name, "node": j, "matched": m, "equal": e, "chars": c}
                   for j, (m, e, c) in wrapper.sums.items()] if wrapper else []
            return pa.RecordBatch.from_pylist(out, schema=schema)

        for batch in batches:
            for host, page, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if wrapper is None or host != name or raw != seed:
                    yield sums()
                    name, seed = host, raw
                    wrapper = Wrapper(Skeleton(raw))
                wrapper.add(Skeleton(page))
        yield sums()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for host, raw, nodes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seed = Skeleton(raw)
                slot, fixed, content = choose(seed, {x["node"]: [x["matched"], x["equal"], x["chars"]] for x in nodes}, least_pages, constant)
                out.append({"host": host, "seed": raw, "slot": slot, "fixed": fixed, "content": content})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([
                ("host", pa.string()), ("seed", pa.binary()), ("slot", pa.int64()), ("fixed", pa.list_(pa.int64())), ("content", pa.list_(pa.int64()))]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seed = None, None
        for batch in batches:
            texts = []
            for page, raw, slot, fixed, content in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
                tree = parse(page or "")
                mine, node, template, kept = Skeleton(skeleton(tree)), -1, set(), set()
                if raw is not None and slot >= 0:
                    if raw != last:
                        last, seed = raw, Skeleton(raw)
                    pairs, fixed, content = align(mine, seed), set(fixed), set(content)
                    same = [h == 0 or j in fixed and h == seed.hash[j] for h, j in zip(mine.hash, pairs, strict=True)]
                    for i in range(len(pairs) - 1, 0, -1):  # all below must be template on this page too
                        same[mine.parent[i]] &= same[i]
                    for i, j in enumerate(pairs):
                        if j == slot:
                            node = i
                        if same[i] and tree.tag[i] not in INLINE:
                            template.add(i)
                        if j in content:
                            kept.add(i)
                texts.append(extract(tree, node if node >= 0 else own_slot(mine), template, kept))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    # copies of a page count once; the seed is the page of least hash, of which each task sends one a host
    bones = rows.select("host", "html").mapInArrow(to_skeletons, "host string, page binary").distinct()
    seeds = (rows.groupBy("host").agg(F.min(F.struct(F.xxhash64("html").alias("h"), "html")).alias("m"))
             .select("host", "m.html").mapInArrow(to_skeletons, "host string, page binary").withColumnRenamed("page", "seed"))
    sums = (bones.join(seeds, "host").sortWithinPartitions("host").select("host", "page", "seed")
            .mapInArrow(add_up, "host string, node long, matched long, equal long, chars long")
            .groupBy("host", "node").agg(*(F.sum(c).alias(c) for c in ("matched", "equal", "chars")))
            .groupBy("host").agg(F.collect_list(F.struct("node", "matched", "equal", "chars")).alias("nodes")))
    wrappers = seeds.join(sums, "host").select("host", "seed", "nodes").mapInArrow(
        settle, "host string, seed binary, slot long, fixed array<long>, content array<long>")
    return rows.join(wrappers, "host", "left").select("page_id", "url", "html", "seed", "slot", "fixed", "content").mapInArrow(
        read, "page_id long, url string, text string, n_chars long")
