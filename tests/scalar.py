"""Slow plain-Python statements of what the operators compute, to hold them against."""

import heapq
from collections import defaultdict

STEPS = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if dr or dc]


def nbrs(i, rows, cols):
    r, c = divmod(i, cols)
    return [(r + dr) * cols + c + dc for dr, dc in STEPS if 0 <= r + dr < rows and 0 <= c + dc < cols]


def flood(z, rows, cols):
    """z: {cell: elevation}. Gives down, filled and the pop order."""
    seeds = [i for i in sorted(z) if sum(n in z for n in nbrs(i, rows, cols)) < 8]
    down, filled, order = {i: -1 for i in seeds}, {i: z[i] for i in seeds}, []
    heap = [(z[i], k, i) for k, i in enumerate(seeds)]
    heapq.heapify(heap)
    k = len(heap)
    while heap:
        e, _, i = heapq.heappop(heap)
        order.append(i)
        for n in nbrs(i, rows, cols):
            if n in z and n not in down:
                down[n], filled[n] = i, max(z[n], e)
                heapq.heappush(heap, (filled[n], k, n))
                k += 1
    return down, filled, order


def children(down):
    up = defaultdict(list)
    for i, d in down.items():
        if d >= 0:
            up[d].append(i)
    return up


def accumulate(down, order):
    acc = {i: 1 for i in down}
    for i in reversed(order):
        if down[i] >= 0:
            acc[down[i]] += acc[i]
    return acc


def strahler(cells, down, acc):
    out, up = {}, children({i: down[i] for i in cells})
    for i in sorted(cells, key=lambda i: (acc[i], i)):
        o = [out[u] for u in up[i] if u in out]
        out[i] = max(o) + (o.count(max(o)) > 1) if o else 1
    return out


def upstream(down, outlet):
    up, got, todo = children(down), set(), [outlet]
    while todo:
        i = todo.pop()
        got.add(i)
        todo += up[i]
    return got


def greedy(domain, down, acc, m):
    """Selected outlets and the outlet of each cell."""
    pending, chosen = defaultdict(int), set()
    for i in sorted(domain, key=lambda i: (acc[i], i)):
        n, d = pending.pop(i, 0) + 1, down[i]
        if n >= m or d < 0 or d not in domain:
            chosen.add(i)
        else:
            pending[d] += n
    owner = {}
    for i in domain:
        j = i
        while j not in chosen:
            j = down[j]
        owner[i] = j
    return chosen, owner


def reaches(cells, down, acc, order, length):
    """(start, end, cells, from, to, order, length) of each reach, in layer order."""
    same = defaultdict(list)
    for i in cells:
        if down[i] in cells and order[down[i]] == order[i]:
            same[down[i]].append(i)
    merges = {i: d for d, k in same.items() if len(k) == 1 for i in k}
    starts = sorted((i for i in cells if i not in merges.values()), key=lambda i: (order[i], acc[i], i))
    out = []
    for s in starts:
        way = [s]
        while way[-1] in merges:
            way.append(merges[way[-1]])
        out.append((s, way[-1], len(way), acc[s], acc[way[-1]], order[s], round(sum(length(i, down[i]) for i in way), 2)))
    return out
