"""Plain Python statements of the results, for small inputs."""

import itertools
import math


def ward(n, d0, d1, alpha, mix):
    """Sequential Lance-Williams merges: (left, right, height), clusters named by smallest unit."""
    size = {i: 1.0 for i in range(n)}
    d = {}
    for i, j in itertools.combinations(range(n), 2):
        if mix == "squared":
            d[i, j] = ((1 - alpha) * d0[i, j] ** 2 + alpha * d1[i, j] ** 2) / (2 * n)
        else:
            d[i, j] = (1 - alpha) * d0[i, j] + alpha * d1[i, j]
    out = []
    while len(size) > 1:
        (a, b), h = min(d.items(), key=lambda kv: (kv[1], kv[0]))
        out.append((a, b, h))
        for c in size:
            if c in (a, b):
                continue
            ac, bc = tuple(sorted((a, c))), tuple(sorted((b, c)))
            d[ac] = ((size[a] + size[c]) * d[ac] + (size[b] + size[c]) * d[bc] - size[c] * h) / (
                size[a] + size[b] + size[c])
            del d[bc]
        del d[a, b]
        size[a] += size.pop(b)
    return out


def cut(n, merges, k):
    label = list(range(n))
    for a, b, _ in merges[:n - k]:
        label = [a if x == b else x for x in label]
    order = {c: i + 1 for i, c in enumerate(sorted(set(label)))}
    return [order[x] for x in label]


def explained(n, d, label):
    total = sum(v * v for v in d.values()) / n ** 2
    within = 0.0
    for c in set(label):
        members = [i for i in range(n) if label[i] == c]
        within += sum(d[i, j] ** 2 for i, j in itertools.combinations(members, 2)) / (n * len(members))
    return 1 - within / total


def silhouette(n, d, label):
    def dist(i, j):
        return d[min(i, j), max(i, j)]
    total = 0.0
    for i in range(n):
        by = {}
        for j in range(n):
            if j != i:
                by.setdefault(label[j], []).append(dist(i, j))
        if label[i] not in by:
            continue
        a = sum(by[label[i]]) / len(by[label[i]])
        b = min(sum(v) / len(v) for c, v in by.items() if c != label[i])
        total += (b - a) / max(a, b) if max(a, b) > 0 else 0.0
    return total / n


def pair_indices(d, label):
    inside = [v for (i, j), v in d.items() if label[i] == label[j]]
    across = [v for (i, j), v in d.items() if label[i] != label[j]]
    every = sorted(d.values())
    k = len(inside)
    small, large = sum(every[:k]), sum(every[-k:])
    return {"Dunn": min(across) / max(inside),
            "McClain": (sum(inside) / k) / (sum(across) / len(across)),
            "Cindex": (sum(inside) - small) / (large - small)}


def calinski_harabasz(x, label):
    n, p = len(x), len(x[0])
    grand = [sum(r[c] for r in x) / n for c in range(p)]
    b = w = 0.0
    for g in set(label):
        rows = [x[i] for i in range(n) if label[i] == g]
        mean = [sum(r[c] for r in rows) / len(rows) for c in range(p)]
        b += len(rows) * sum((mean[c] - grand[c]) ** 2 for c in range(p))
        w += sum((r[c] - mean[c]) ** 2 for r in rows for c in range(p))
    k = len(set(label))
    return (b / (k - 1)) / (w / (n - k))


def adjusted_rand(a, b):
    def c2(v):
        return v * (v - 1) / 2
    n = len(a)
    cells, rows, cols = {}, {}, {}
    for x, y in zip(a, b):
        cells[x, y] = cells.get((x, y), 0) + 1
        rows[x] = rows.get(x, 0) + 1
        cols[y] = cols.get(y, 0) + 1
    s, r, c = (sum(map(c2, t.values())) for t in (cells, rows, cols))
    e = r * c / c2(n)
    return (s - e) / ((r + c) / 2 - e)


def close(a, b, tol=1e-9):
    return math.isclose(a, b, rel_tol=tol, abs_tol=tol)
