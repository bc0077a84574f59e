"""Plain versions of the contracts of the ten queries, for small tables."""

from __future__ import annotations

import collections
import hashlib
import html
import re
import zlib

import numpy as np

WORD = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def repeats(docs, window=35):
    words = [WORD.findall(t or "") for _, t in docs]
    seen = collections.Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(docs, words, strict=True):
        gone = {i + k for i in range(len(w) - window + 1) if seen[tuple(w[i:i + window])] > 1 for k in range(window)}
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def secrets(docs):
    out = []
    for d, t in docs:
        t, found = t or "", []
        for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A):
            if len(m.group(2)) >= 12:
                found.append((m.start(), 0, m.end(), "assign"))
        found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 18]
        found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 16]
        n = collections.Counter(f[3] for f in found)
        spans = [f"{k}:{a}:{e}" for a, _, e, k in sorted(found)]
        out.append((d, n["assign"], n["access"], n["hex"], sha(",".join(spans)), spans))
    return out


def _luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def personal(docs):
    out = []
    for d, t in docs:
        t, found = t or "", []
        found += [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        found += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            digits = re.sub("[ -]", "", m.group())
            if 13 <= len(digits) <= 19 and _luhn(digits):
                found.append(("card", m))
        found += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
        n = collections.Counter(k for k, _ in found)
        spans = [f"{k}:{m.start()}:{m.end()}" for k, m in found]
        out.append((d, n["email"], n["ip"], n["card"], n["phone"], sha(",".join(spans)), spans))
    return out


def article(page: str) -> str:
    """For pages of the given tables: all of the article element."""
    inner = re.search("<article>(.*?)</article>", page, re.S).group(1)
    inner = re.sub(r"</?(?:p|h1|br|div|li|ul)\b[^>]*>", " ", inner)
    return " ".join(html.unescape(re.sub("<[^>]*>", "", inner)).split())


def contamination(docs, items, window=13):
    windows = collections.defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(lower(t))
        n = min(window, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[a:a + n])].add(str(i))
    sizes, out = {len(k) for k in windows}, []
    for d, t in docs:
        w, hit, found = ALNUM.findall(lower(t)), set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if (k := tuple(w[a:a + n])) in windows:
                    hit.update(range(a, a + n))
                    found |= windows[k]
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def quality(docs, min_repeat=10, max_covered=0.3, max_repeat=100, max_share=0.2):
    out = []
    for d, t in docs:
        t = t or ""
        w = WORD.findall(t)
        at = collections.defaultdict(list)
        for i, x in enumerate(w):
            at[x].append(i)
        longest = []
        for i in range(len(w)):
            best = 0
            for j in at[w[i]]:
                n = 0
                while i != j and max(i, j) + n < len(w) and w[i + n] == w[j + n]:
                    n += 1
                best = max(best, n)
            longest.append(best)
        three = {p + k for p, n in enumerate(longest) if n >= 3 for k in range(3)}
        covered = {q for p, n in enumerate(longest) if n >= min_repeat for q in range(p, p + n)}
        lines, again = set(), 0
        for x in t.split("\n"):
            again += x in lines and bool(WORD.search(x))
            lines.add(x)
        failed = len(w) < 50 or 100 * len(three) > 50 * len(w)
        top = max(longest, default=0)
        bad = len(covered) > max_covered * len(w) or top > max_repeat and top > max_share * len(w)
        out.append((d, len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), again, len(three), failed, not failed and not bad))
    return out


def tokens(docs, tokenizer, end):
    encoded = tokenizer.encode_batch([t or "" for _, t in docs], add_special_tokens=False)
    return [(d, np.array([*e.ids, end], "<u4")) for (d, _), e in zip(docs, encoded, strict=True)]


def token_rows(docs, tokenizer, end):
    out, start = [], 0
    ordered = sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    for d, ids in tokens(ordered, tokenizer, end):
        out.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def shingle_sets(docs, size=5):
    out = []
    for _, t in docs:
        w = WORD.findall(lower(t))
        out.append({tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()})
    return out


def components(docs, percent=75):
    sets, root = shingle_sets(docs), list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders, pairs = collections.defaultdict(list), collections.Counter()
    for i, s in enumerate(sets):
        for x in s:
            pairs.update((j, i) for j in holders[x])
            holders[x].append(i)
    for (i, j), n in pairs.items():
        if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
            root[find(j)] = find(i)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(s), least.get(find(i)) if s else d, find(i)) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))]


def near_vectors(rows, least=0.9):
    """(vec_id, n_links, component_id, kept) of (vec_id, vector) rows."""
    usable = [v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    sizes = collections.Counter(len(v) for (_, v), u in zip(rows, usable, strict=True) if u)
    usual = max(sizes, key=lambda s: (sizes[s], s), default=0)
    usable = [u and len(v) == usual for (_, v), u in zip(rows, usable, strict=True)]
    links = [[] for _ in rows]
    at = [i for i, u in enumerate(usable) if u]
    if at:
        m = np.array([rows[i][1] for i in at], dtype=float)
        m /= np.abs(m).max(axis=1, keepdims=True)
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        for a, row in zip(at, m @ m.T >= least, strict=True):
            links[a] = [at[b] for b in np.flatnonzero(row) if at[b] != a]
    label, out = [None] * len(rows), []
    for i in range(len(rows)):
        if label[i] is None:
            group, todo = {i}, [i]
            while todo:
                new = set(links[todo.pop()]) - group
                group |= new
                todo += new
            name = (min((rows[g][0] for g in group if rows[g][0] is not None), default=None),)
            for g in group:
                label[g] = name
        out.append((rows[i][0], len(links[i]), label[i][0], rows[i][0] == label[i][0]))
    return out


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i:i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) of (doc_id, source, lang, n_chars, text) rows."""
    def leaf(r, text):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*r[:4], text)))

    langs = collections.defaultdict(list)
    for r in rows:
        langs[r[2]].append(r)
    names = sorted(langs, key=lambda n: (n is not None, (n or "").encode()))
    for n in names:
        langs[n].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
    trees = {n: tree([leaf(r, r[4]) for r in langs[n]]) for n in names}
    top, out = tree([trees[n][-1][0] for n in names]), []
    for k, n in enumerate(names):
        for i, r in enumerate(langs[n]):
            path = []
            for levels, at in ((trees[n], i), (top, k)):
                for level in levels[:-1]:
                    first = at - at % 8
                    path.append(("".join(level[first:at]), "".join(level[at + 1:first + 8])))
                    at //= 8
            node = leaf(r, lower(r[4]) if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else r[4])
            for left, right in path:
                node = sha(left + node + right)
            out.append((r[0], trees[n][0][i], trees[n][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), node, node == top[-1][0]))
    return out
