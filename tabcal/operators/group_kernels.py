"""Numpy kernels of the leave-one-group-out trees: bounded histograms and bin-pair counts."""

import numpy as np


def cell_sums(cells, n, s, size):
    """Counts and target sums per cell of several nodes: nodes x size each, from per node lists of cells, counts and sums (or None)."""
    lists = [c if c is not None else () for c in cells]
    node = np.repeat(np.arange(len(lists)), [len(c) for c in lists])
    flat = lambda parts, kind: np.concatenate([np.asarray(p, dtype=kind) for p in parts if p is not None] or [np.zeros(0, dtype=kind)])
    place = node * size + flat(cells, np.int64)
    return [np.bincount(place, flat(parts, float), len(lists) * size).reshape(-1, size) for parts in (n, s)]


def first_best(n, s, width, least):
    """(gain, feature, bin) of the split that lowers the squared error most; gain 0 if none does.

    ``n`` and ``s`` are features x bins; gains are compared to nine digits of the largest possible one.
    """
    left_n, left_s = np.cumsum(n, axis=1), np.cumsum(s, axis=1)
    all_n, all_s = left_n[:, -1:], left_s[:, -1:]
    right_n, right_s = all_n - left_n, all_s - left_s
    fits = (left_n >= least) & (right_n >= least) & (left_n > 0) & (right_n > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(fits, left_s ** 2 / left_n + right_s ** 2 / right_n - all_s ** 2 / all_n, 0.0)
    top = gain.max(initial=0.0)
    if not top > 0:
        return 0.0, 0, 0
    at = int(np.argmax(gain >= top * (1 - 1e-9)))
    return float(gain.flat[at]), at // width, at % width


def best_splits(n, s, width, least, last):
    """(value, feature, bin, whether there is a split) per node, each as an array; ``n`` and ``s`` are nodes x features x bins.  Rules and
    ties as in ``first_best``."""
    nodes = len(n)
    rows = n[:, 0].sum(axis=1) if n.shape[1] else np.zeros(nodes)
    with np.errstate(divide="ignore", invalid="ignore"):
        value = np.where(rows > 0, s[:, 0].sum(axis=1) / rows, np.nan) if n.shape[1] else np.full(nodes, np.nan)
    at, gains = np.zeros(nodes, dtype=np.int64), np.zeros(nodes, dtype=bool)
    if not last and n.shape[1]:
        left_n, left_s = np.cumsum(n, axis=2), np.cumsum(s, axis=2)
        all_n, all_s = left_n[:, :, -1:], left_s[:, :, -1:]
        right_n, right_s = all_n - left_n, all_s - left_s
        fits = (left_n >= least) & (right_n >= least) & (left_n > 0) & (right_n > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(fits, left_s ** 2 / left_n + right_s ** 2 / right_n - all_s ** 2 / all_n, 0.0).reshape(nodes, -1)
        top = gain.max(axis=1, initial=0.0)
        at = np.where((top > 0) & (rows > 0), np.argmax(gain >= (top * (1 - 1e-9))[:, None], axis=1), 0)
        gains = (top > 0) & (rows > 0) & (gain[np.arange(nodes), at] > 1e-12 * np.maximum(1.0, rows))
    return value, at // width, at % width, gains


def pair_counts(cells, y, size):
    """(a, b, n, s): rows per pair of cells a <= b, and the target's sum where a is b, of rows x features cell numbers; pairs that occur."""
    counts = np.zeros(size * size)
    features = cells.shape[1]
    for i in range(features):
        for j in range(i, features):
            counts += np.bincount(cells[:, i] * size + cells[:, j], minlength=size * size)
    sums = np.bincount(cells.ravel(), np.repeat(y, features), size)
    held = np.flatnonzero(counts)
    a, b = held // size, held % size
    return a, b, counts[held], np.where(a == b, sums[a], 0.0)


def matrices(pairs, size):
    """Counts of cell pairs as a symmetric matrix, and the target sums of the cells."""
    counts, sums = np.zeros((size, size)), np.zeros(size)
    a, b, n = (np.asarray(pairs[c], dtype=kind) for c, kind in (("a", int), ("b", int), ("n", float)))
    counts[a, b] = n
    counts[b, a] = n
    same = a == b
    sums[a[same]] = np.asarray(pairs["s"], dtype=float)[same]
    return counts, sums


def boost_stumps(counts, sums, features, width, rounds, rate):
    """One number per cell: the target's mean (shared out over the features) plus the stumps' steps."""
    table = np.zeros(features * width)
    n = np.diag(counts)
    rows = n[:width].sum()
    if rows <= 0:
        return np.full(features * width, np.nan)
    mean = sums[:width].sum() / rows
    table += mean / features
    left = sums - n * mean  # residual sums per cell
    grid = n.reshape(features, width)
    for _ in range(rounds):
        gain, feature, place = first_best(grid, left.reshape(features, width), width, 1)
        if not gain > 1e-12 * max(1.0, rows):
            break
        at = slice(feature * width, (feature + 1) * width)
        low = np.arange(width) <= place
        own_n, own_s = n[at], left[at]
        step = np.where(low, own_s[low].sum() / own_n[low].sum(), own_s[~low].sum() / own_n[~low].sum()) * rate
        table[at] += step
        left = left - counts[:, at] @ step
    return table
