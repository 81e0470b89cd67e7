"""Plain-Python statements of the contracts."""

import hashlib
import math
import re
import zlib
from collections import Counter

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words(text):
    return (text or "").encode().split()


def low_words(text):
    return (text or "").encode().translate(LOWER).split()


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def contaminated(docs, items, k=10):
    """doc rows (id, text) -> {id: (n_words, n_hit, n_items, sha)}"""
    windows = {}
    for item, text in items:
        w = alnum_words(text)
        for s in range(max(1, len(w) - k + 1)):
            if w:
                windows.setdefault(tuple(w[s : s + k]), set()).add(item)
    sizes = sorted({len(w) for w in windows})
    out = {}
    for i, text in docs:
        w, found = alnum_words(text), set()
        hit = [False] * len(w)
        for n in sizes:
            for s in range(len(w) - n + 1):
                if (got := windows.get(tuple(w[s : s + n]))) is not None:
                    found |= got
                    hit[s : s + n] = [True] * n
        out[i] = (len(w), sum(hit), len(found), sha(",".join(sorted(map(str, found)))))
    return out


def near_groups(docs, k, percent):
    """{id: (set size, least id reachable)}"""
    sets = {}
    for i, t in docs:
        w = low_words(t)
        sets[i] = {tuple(w[s : s + k]) for s in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def substring(docs, k):
    """{id: (n_words, n_removed, kept sha)}"""
    seen, out = set(), {}
    for i, t in sorted(docs, key=lambda r: r[0]):
        w = words(t)
        gone = [False] * len(w)
        for s in range(len(w) - k + 1):
            key = tuple(w[s : s + k])
            if key in seen:
                gone[s : s + k] = [True] * k
            seen.add(key)
        out[i] = (len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone) if not g)))
    return out


def statistics(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words"""
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines, seen, dup = t.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(w[s : s + 3]) for s in range(len(w) - 2))
    cover = {s + k for s in range(len(w) - 2) if c[tuple(w[s : s + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover)


def base_scores(docs):
    """{id: (held_out, n_tokens, n_known, N, base)}"""
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}
    tok = {i: [*low_words(t), b"\n"] for i, t in docs}
    c = Counter(x for i, w in tok.items() if not held[i] for x in w)
    n, v = sum(c.values()), len(c)
    return {i: (held[i], len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) for i, w in tok.items()}


def level_targets(sizes, weights=(5, 2, 1), most=3):
    """Targets by handing the excess on, round after round; sizes: {source: words}."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, open_, target = float(sum(sizes.values())), set(names), {}
    while True:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total > most * sizes[s] + 1e-9]
        if not over:
            return target | {s: left * w[s] / total for s in open_}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
            open_.discard(s)
        if not open_:
            return target


WHITE = " \t\n\x0b\x0c\r"


def line_dedup(docs, length=40, least=5):
    """doc rows (id, text) -> rows (id, lines, dropped, kept text); rows without id are documents of their own by text, before all ids"""
    name = lambda i, t: (1, i) if i is not None else (0, t or "")
    key = lambda line: line.strip(WHITE).translate({c: c + 32 for c in range(65, 91)})
    holders = {}
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= length:
                holders.setdefault(key(line), set()).add(name(i, t))
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        # which of several rows without id is the last is not stated; such cases are left to the caller
        stay = [len(h := holders.get(key(x), ())) < least or name(i, t) == max(h) for x in lines]
        out.append((i, len(lines), len(lines) - sum(stay), "\n".join(x for x, s in zip(lines, stay) if s)))
    return out


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def manifest(rows):
    """rows (doc_id, source, lang, n_chars, text) -> rows (doc_id, leaf, subroot, root, proof, folded, verified), in any order"""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    low = lambda t: None if t is None else t.translate({c: c + 32 for c in range(65, 91)})
    leaf = lambda r, t: h(*map(field, (r[0], r[1], r[2], r[3], t)))
    touched = lambda r: r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([h(*levels[-1][k : k + 8]) for k in range(0, len(levels[-1]), 8)])
        return levels

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    ordered = {g: sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4]))) for g in langs}
    trees = {g: tree([leaf(r, r[4]) for r in ordered[g]]) for g in langs}
    top = tree([trees[g][-1][0] for g in langs])
    out = []
    for g in langs:
        for p, r in enumerate(ordered[g]):
            proof, now = "", leaf(r, low(r[4]) if touched(r) else r[4])
            for levels, at in ((trees[g], p), (top, langs.index(g))):
                for nodes in levels[:-1]:
                    run, o = nodes[at // 8 * 8 : at // 8 * 8 + 8], at % 8
                    proof += "".join(run[:o] + run[o + 1 :])
                    now = h(*run[:o], now, *run[o + 1 :])
                    at //= 8
            out.append((r[0], trees[g][0][p], trees[g][-1][0], top[-1][0], h(proof), now, now == top[-1][0]))
    return out
