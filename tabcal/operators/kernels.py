"""Small numpy helpers that run inside tasks on d x d matrices or on bounded blocks of rows."""

from __future__ import annotations

import numpy as np


def unpack(n, s, q):
    """Centred cross-product matrix and mean shift from packed sums."""
    d = len(s)
    s = np.asarray(s, dtype=float)
    full = np.zeros((d, d))
    full[np.triu_indices(d)] = q
    full = full + np.triu(full, 1).T
    return full - np.outer(s, s) / n, s / n


def stack(column):
    """Matrix from a column of arrays; missing cells become NaN."""
    return np.stack([np.asarray(v) for v in column]).astype(float)


def soft(value, by):
    return np.sign(value) * max(abs(value) - by, 0.0)


def solve(kind, n, cross, params):
    """Coefficients of a linear model from the centred cross products of (features, target).

    Returns (coef, extra); extra holds noise precision and coefficient covariance for bayesian_ridge.
    """
    p = len(cross) - 1
    xx, xy, yy = cross[:p, :p], cross[:p, p], cross[p, p]
    if kind == "ols":
        return np.linalg.pinv(xx, hermitian=True) @ xy, None
    if kind == "ridge":
        return np.linalg.solve(xx + params["alpha"] * np.eye(p), xy), None
    if kind == "elastic_net":
        a, l1 = params["alpha"], params["l1_ratio"]
        gram, corr, w = xx / n, xy / n, np.zeros(p)
        for _ in range(int(params.get("max_iter", 50000))):
            biggest = change = 0.0
            for j in range(p):
                if gram[j, j] == 0:
                    continue
                old = w[j]
                w[j] = soft(corr[j] - gram[j] @ w + gram[j, j] * old, a * l1) / (gram[j, j] + a * (1 - l1))
                change, biggest = max(change, abs(w[j] - old)), max(biggest, abs(w[j]))
            if change <= 1e-10 * max(biggest, 1e-30):
                return w, None
        raise RuntimeError("elastic net did not converge; raise max_iter")
    if kind == "bayesian_ridge":
        # evidence maximisation on the eigenvalues of X'X; fixed values: hyper-priors 1e-6, tolerance 1e-3
        prior, tol = params.get("prior", 1e-6), params.get("tol", 1e-3)
        values, vectors = np.linalg.eigh(xx)
        values = np.clip(values, 0.0, None)
        rotated = vectors.T @ xy
        alpha, lam, old = 1.0 / (yy / n + np.finfo(float).eps), 1.0, None
        weights = lambda: vectors @ (rotated / (values + lam / alpha))
        for _ in range(int(params.get("max_iter", 300))):
            w = weights()
            sse = max(yy - 2 * w @ xy + w @ xx @ w, 0.0)
            gamma = np.sum(alpha * values / (lam + alpha * values))
            lam = (gamma + 2 * prior) / (w @ w + 2 * prior)
            alpha = (n - gamma + 2 * prior) / (sse + 2 * prior)
            if old is not None and np.sum(np.abs(old - w)) < tol:
                break
            old = w
        else:
            raise RuntimeError("the evidence of the Bayesian ridge did not converge; raise max_iter")
        covariance = (vectors / (values + lam / alpha)) @ vectors.T / alpha
        return weights(), (alpha, covariance)
    raise ValueError(f"unknown model: {kind}")


def fit_scaled(kind, n, cross, params):
    """Fit on standardised features (population sd, constant column left alone); raw-scale coefficients."""
    p = len(cross) - 1
    sd = np.sqrt(np.clip(np.diag(cross)[:p], 0, None) / n)
    sd = np.where(sd == 0, 1.0, sd)
    unit = np.append(1.0 / sd, 1.0)
    coef, extra = solve(kind, n, cross * np.outer(unit, unit), params)
    return coef / sd, sd, extra


def fit_row(kind, row, scaled, params):
    """One model from one row of cross products, as the values of a coefficient row."""
    cross, shift = unpack(row["n"], row["s"], row["q"])
    mean = np.asarray(row["mu"], dtype=float) + shift
    p = len(mean) - 1
    if scaled:
        coef, sd, extra = fit_scaled(kind, row["n"], cross, params)
    else:
        (coef, extra), sd = solve(kind, row["n"], cross, params), np.ones(p)
    precision, covariance = (float(extra[0]), extra[1].ravel().tolist()) if extra else (None, None)
    intercept = float(mean[p] - coef @ mean[:p])
    return [float(row["n"]), coef.tolist(), intercept, mean[:p].tolist(), sd.tolist(), precision, covariance]


def sum_squared_error(coef, intercept_gap, n, cross, mean):
    """SSE of a linear model on rows known only by their cross products.

    ``intercept_gap`` is the difference between the rows' mean residual and zero.
    """
    p = len(coef)
    centred = cross[p, p] - 2 * coef @ cross[:p, p] + coef @ cross[:p, :p] @ coef
    return max(centred, 0.0) + n * intercept_gap**2


def vif_from_correlation(r):
    """Variance inflation = diagonal of the inverse correlation matrix; infinite for columns that take part in an exact dependence."""
    values, vectors = np.linalg.eigh((r + r.T) / 2)
    share = vectors ** 2
    none = values <= 1e-12 * values.max()
    vif = (share[:, ~none] / values[~none]).sum(axis=1)
    vif[share[:, none].sum(axis=1) > 1e-9] = np.inf
    vif[1 - 1 / vif >= 1 - 1e-12] = np.inf
    return vif


PAIRS = 1 << 18  # distances worked out at once, so that they stay in a core's cache
SCREENED_PAIRS = 1 << 20  # the same where a matrix product goes first
KEPT_ROWS = 1_000_000  # candidates of a block before they are cut to k per query
SCREEN_WIDTH = 8  # coordinates from which a matrix product is worth it


def distances(query, train, metric, order=2.0):
    """Distance matrix between two bounded blocks."""
    gaps, gap = np.zeros((len(query), len(train))), np.empty((len(query), len(train)))
    if metric == "nan_euclidean":
        d = query.shape[1]
        seen, both = np.zeros(gaps.shape), np.empty(gaps.shape, dtype=bool)
        for j in range(d):
            np.subtract(query[:, j : j + 1], train[:, j], out=gap)
            np.logical_not(np.isnan(gap, out=both), out=both)
            seen += both
            gap[~both] = 0.0
            gaps += np.square(gap, out=gap)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(seen > 0, np.sqrt(gaps * d / seen), np.inf)
    power = {"euclidean": 2.0, "manhattan": 1.0}.get(metric, order)
    for j in range(query.shape[1]):
        np.subtract(query[:, j : j + 1], train[:, j], out=gap)
        if metric == "euclidean":
            gaps += np.square(gap, out=gap)
        elif metric == "chebyshev":
            np.maximum(gaps, np.abs(gap, out=gap), out=gaps)
        elif power == 1.0:
            gaps += np.abs(gap, out=gap)
        else:
            gaps += np.abs(gap, out=gap) ** power
    if metric == "euclidean":
        return np.sqrt(gaps, out=gaps)
    return gaps if metric == "chebyshev" or power == 1.0 else gaps ** (1.0 / power)


def _best(row, col, d, take):
    """Of the pairs (row, col, d) the ``take`` nearest per row, ties to the smaller col."""
    best = np.lexsort((col, d, row))
    row, col, d = row[best], col[best], d[best]
    starts = np.searchsorted(row, row)
    keep = np.arange(len(row)) - starts < take
    return row[keep], col[keep], d[keep]


def first_k(parts, k):
    """One (query id, distance, train id, value) of several, cut to the k nearest per query id, ties by train id."""
    if not parts:
        return tuple(np.array([]) for _ in range(4))
    ids, d, near, values = (np.concatenate(part) for part in zip(*parts))
    code = {x: i for i, x in enumerate(dict.fromkeys(ids.tolist()))} if ids.dtype == object else None
    row = np.unique(ids, return_inverse=True)[1] if code is None else np.array([code[x] for x in ids.tolist()], dtype=np.int64)
    best = np.lexsort((near, d, row))
    row = row[best]
    best = best[np.arange(len(row)) - np.searchsorted(row, row) < k]
    return ids[best], d[best], near[best], values[best]


def block_top_k(query_ids, query, train_ids, train, values, k, metric, order, exclude_self, chunk=None, groups=None):
    """(query id, distance, train id, value) of the k nearest in this block, per query; with ``groups`` (of the queries, of the
    training rows) a query's own group is left out.

    Euclidean distances of wide vectors are first bounded by one matrix product; only pairs that can be among the k nearest by that bound
    get their distance, worked out as elsewhere, so the screen never decides a result.
    """
    out_q, out_d, out_t, out_v = [], [], [], []
    rank = np.lexsort((train_ids,))
    train_ids, train, values = train_ids[rank], train[rank], values[rank]
    apart = None if groups is None else (groups[0], groups[1][rank])
    screened = metric == "euclidean" and train.shape[1] >= SCREEN_WIDTH
    chunk = chunk or max(1, (SCREENED_PAIRS if screened else PAIRS) // max(1, len(train)))
    take = min(k, len(train))
    if screened:
        whole = np.isfinite(train).all(axis=1)
        centre = train[whole].mean(axis=0) if whole.any() else np.zeros(train.shape[1])
        b = train - centre
        own = np.square(b).sum(axis=1)
        widest = np.sqrt(own[whole].max()) if whole.any() else 0.0
        margin = (4 * train.shape[1] + 64) * np.finfo(float).eps  # rounding of the product and of the distances, on both sides
    for at in range(0, len(query), chunk):
        ids, some = query_ids[at : at + chunk], query[at : at + chunk]
        if screened:
            with np.errstate(invalid="ignore", over="ignore"):
                a = some - centre
                norm = np.square(a).sum(axis=1)
                d = a @ b.T
                d *= -2.0
                d += own
                d += norm[:, None]
            d[np.isnan(d)] = np.inf
            slack = margin * (np.sqrt(norm) + widest) ** 2
        else:
            d, slack = distances(some, train, metric, order), np.zeros(len(some))
        if exclude_self:
            d[ids[:, None] == train_ids[None, :]] = np.inf
        if apart is not None:
            d[apart[0][at : at + chunk, None] == apart[1][None, :]] = np.inf
        edge = np.partition(d, take - 1, axis=1)[:, take - 1]
        row, col = np.nonzero((d <= (edge + slack)[:, None]) & np.isfinite(d))
        if screened:
            gaps = np.zeros(len(row))
            for j in range(train.shape[1]):
                gaps += np.square(some[row, j] - train[col, j])
            near = np.sqrt(gaps)
        else:
            near = d[row, col]
        row, col, near = _best(row, col, near, take)
        out_q.append(ids[row]); out_d.append(near); out_t.append(train_ids[col]); out_v.append(values[col])
    join = lambda parts: np.concatenate(parts) if parts else np.array([])
    return join(out_q), join(out_d), join(out_t), join(out_v)


def top_k_by_cell(a, b, k, metric, order, exclude_self, grouped):
    """The k nearest of a block's training rows ``b`` per query of ``a``; a query meets the cells it named, or all if these hold most rows."""
    a_ids, b_ids = a["id"].to_numpy(), b["id"].to_numpy()
    query, train, y, cell = stack(a["v"]), stack(b["v"]), b["y"].to_numpy(float), b["cell"].to_numpy()
    ga, gb = a["g"].to_numpy(), b["g"].to_numpy()

    def found(rows, members):
        return block_top_k(
            a_ids[rows], query[rows], b_ids[members], train[members], y[members], k, metric, order, exclude_self,
            groups=(ga[rows], gb[members]) if grouped else None)

    by_cell = np.argsort(cell, kind="stable")
    names, first = np.unique(cell[by_cell], return_index=True)
    last = np.r_[first[1:], len(cell)]
    named = np.concatenate(a["cells"].to_list())
    owner = np.repeat(np.arange(len(a)), [len(c) for c in a["cells"]])
    at = np.minimum(np.searchsorted(names, named), len(names) - 1)
    held = names[at] == named
    owner, at = owner[held], at[held]
    if 2 * (last - first)[at].sum() >= len(a) * len(b):
        return found(slice(None), slice(None))
    order_ = np.argsort(at, kind="stable")
    owner, at = owner[order_], at[order_]
    parts, kept = [], 0
    for i in np.unique(at):
        rows = owner[np.searchsorted(at, i) : np.searchsorted(at, i, "right")]
        parts.append(found(rows, by_cell[first[i] : last[i]]))
        kept += len(parts[-1][0])
        if kept > KEPT_ROWS:
            parts, kept = [first_k(parts, k)], 0
    return first_k(parts, k)


PLANE_LEAF = 48  # points in a leaf of a task's tree
ASKED_AT_ONCE = 256  # points of a leaf asked together


def plane_tree(points, depth):
    """(axis, cut) per inner node of a complete tree over points of the plane, halved across the wider side; node i leads to 2i+1 and 2i+2."""
    inner = 2**depth - 1
    axis, cut, parts = np.zeros(inner, dtype=np.int64), np.zeros(inner), [points]
    for node in range(inner):
        part, parts[node] = parts[node], None
        if len(part):
            axis[node] = np.ptp(part, axis=0).argmax()
            middle = (len(part) - 1) // 2
            cut[node] = np.partition(part[:, axis[node]], middle)[middle]
        low = part[:, axis[node]] <= cut[node]
        parts += [part[low], part[~low]]
    return axis, cut


def plane_leaf(points, axis, cut):
    """The leaf of every point."""
    node = np.zeros(len(points), dtype=np.int64)
    for _ in range(len(axis).bit_length()):
        node = 2 * node + 1 + (points[np.arange(len(points)), axis[node]] > cut[node])
    return node - len(axis)


def plane_regions(axis, cut):
    """Lower and upper ends of every leaf's region, for whole coordinates."""
    low, high = [np.full(2, -np.inf)], [np.full(2, np.inf)]
    for node in range(len(axis)):
        left, right = high[node].copy(), low[node].copy()
        left[axis[node]], right[axis[node]] = cut[node], cut[node] + 1
        low += [low[node], right]
        high += [left, high[node]]
    return np.array(low[len(axis) :]), np.array(high[len(axis) :])


def plane_meeting(low, high, axis, cut):
    """(row, leaf) of all leaves whose region meets the rectangle of a row."""
    row, node = np.arange(len(low)), np.zeros(len(low), dtype=np.int64)
    for _ in range(len(axis).bit_length()):
        left, right = low[row, axis[node]] <= cut[node], high[row, axis[node]] > cut[node]
        row, node = np.r_[row[left], row[right]], np.r_[2 * node[left] + 1, 2 * node[right] + 2]
    return row, node - len(axis)


def plane_nearest(train, query, k):
    """The k smallest largest-coordinate distances of every query point to the training points, ascending, infinite where there are fewer."""
    out = np.full((len(query), k), np.inf)
    if not len(train):
        return out
    depth = max(0, int(np.ceil(np.log2(len(train) / PLANE_LEAF))))
    axis, cut = plane_tree(train, depth)
    home, asked = plane_leaf(train, axis, cut), plane_leaf(query, axis, cut)
    low, high = np.full((2**depth, 2), np.inf), np.full((2**depth, 2), -np.inf)
    np.minimum.at(low, home, train)
    np.maximum.at(high, home, train)
    by_leaf = np.argsort(home, kind="stable")
    train, starts = train[by_leaf], np.searchsorted(home[by_leaf], np.arange(2**depth + 1))
    gaps = lambda q, t: np.maximum(np.abs(q[:, :1] - t[:, 0]), np.abs(q[:, 1:] - t[:, 1]))
    order = np.argsort(asked, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(asked[order])) + 1):
        leaf = asked[rows[0]] if len(rows) else 0
        own = train[starts[leaf] : starts[leaf + 1]]
        for at in range(0, len(rows), ASKED_AT_ONCE):
            some = rows[at : at + ASKED_AT_ONCE]
            q = query[some]
            bound = np.partition(gaps(q, own), k - 1, axis=1)[:, k - 1][:, None] if len(own) >= k else np.inf
            least, most = (q - bound).min(axis=0), (q + bound).max(axis=0)
            near = np.flatnonzero(((low <= most) & (high >= least)).all(axis=1))
            d = gaps(q, np.concatenate([train[starts[i] : starts[i + 1]] for i in near]))
            take = min(k, d.shape[1])
            out[some, :take] = np.sort(np.partition(d, take - 1, axis=1)[:, :take], axis=1)
    return out


PRIME = 2**31 - 1
DRAWN_AT_ONCE = 1 << 16  # draws worked out at once


def _folded(x, spare, times=2):
    """A number of the same residue modulo PRIME in place of x, at most PRIME if x < 2^62 and it is folded twice."""
    for _ in range(times):
        np.right_shift(x, np.uint64(31), out=spare)
        x &= np.uint64(PRIME)
        x += spare
    return x


def _mixed(x, out, spare):
    """Fifth power modulo the prime, of numbers up to PRIME: 5 does not divide PRIME - 1, so every value comes from exactly one."""
    np.multiply(x, x, out=out)
    _folded(out, spare, 1)  # below 2^32, so its square fits
    out *= out
    _folded(out, spare)  # at most PRIME + 8
    out *= x
    return _folded(out, spare)


def drawn_positions(keys, repetitions: int, n: int, stream: int):
    """Position in 0..n-1 of every (row, repetition), for n below 2^32: a fixed rule on the row's 52-bit key.

    Two values below the prime are made by steps that are one-to-one in the key's low part, and read as one number below its
    square (62 bits), so all positions have the same chance up to one part in 2^62 / n; plain integer arithmetic, which SQL
    can repeat.
    """
    k, r = np.asarray(keys, dtype=np.int64)[:, None], np.arange(repetitions, dtype=np.int64)[None, :]
    whole = lambda x: x.astype(np.uint64)
    high = whole(k % PRIME) + whole(r * 40503 + stream * 7919)
    spare, x, low = np.empty_like(high), np.empty_like(high), np.empty_like(high)
    _mixed(_folded(high, spare), x, spare)
    np.multiply(x, np.uint64(48271), out=low)
    low += whole(k // PRIME * 16807) + whole(r * 69621 + stream)
    _mixed(_folded(low, spare), high, spare)
    high[high == PRIME] = 0
    x += high * np.uint64(69621)
    _mixed(_folded(x, spare), low, spare)
    low[low == PRIME] = 0
    low *= np.uint64(n)
    low //= np.uint64(PRIME)
    high *= np.uint64(n)
    high += low
    high //= np.uint64(PRIME)
    return high.view(np.int64)


def row_slices(rows, repetitions):
    step = max(1, DRAWN_AT_ONCE // repetitions)
    return [slice(at, at + step) for at in range(0, rows, step)]


def block_values(pieces):
    """One array of a block's values from its pieces."""
    return np.concatenate([np.asarray(v) for v in pieces.sort_values("piece")["e"]])


def drawn_sums(keys, x, e, n, repetitions):
    """Per repetition the sum of the values drawn from ``e`` and of their products with each column of x."""
    total, moved = np.zeros(repetitions), np.zeros((x.shape[1], repetitions))
    for part in row_slices(len(keys), repetitions):
        made = e[drawn_positions(keys[part], repetitions, n, 0)]
        total += made.sum(axis=0)
        moved += x[part].T @ made
    return total, moved


def fold_errors(models, inputs, y, linear):
    """Absolute errors (folds x rows). A linear model is its intercept and coefficients; else a table whose entries named by ``inputs`` are added."""
    out = np.repeat(models[:, :1], len(y), axis=1) if linear else np.zeros((len(models), len(y)))
    for i in range(inputs.shape[1]):
        out += models[:, i + 1 : i + 2] * inputs[:, i] if linear else models[:, inputs[:, i].astype(np.int64)]
    return np.abs(np.subtract(y, out, out=out), out=out)


def _magnitude(models, low, high, linear):
    """Bound on the size of all terms of a prediction, for inputs between low and high."""
    if linear:
        return np.abs(models[:, 0]) + np.abs(models[:, 1:]) @ np.maximum(np.abs(low), np.abs(high))
    return sum(np.abs(models[:, int(a) : int(b) + 1]).max(axis=1) for a, b in zip(low, high))


def prediction_gaps(models, centre, low, high, linear):
    """Bound on how far the predictions of each model and of ``centre`` lie apart on rows whose inputs lie between low and high."""
    d = models - centre
    if linear:
        return np.abs(d[:, 0] + d[:, 1:] @ (low / 2 + high / 2)) + np.abs(d[:, 1:]) @ (high / 2 - low / 2)
    ends = [(d[:, int(a) : int(b) + 1].min(axis=1), d[:, int(a) : int(b) + 1].max(axis=1)) for a, b in zip(low, high)]
    return np.maximum(np.abs(sum(e[0] for e in ends)), np.abs(sum(e[1] for e in ends)))


def centres(models, low, high, linear, most, close):
    """Models, at most ``most``, of which one is within ``close`` of every model if so few suffice: always the farthest is added."""
    chosen, far = [np.median(models, axis=0)], np.full(len(models), np.inf)
    while True:
        far = np.minimum(far, prediction_gaps(models, chosen[-1], low, high, linear))
        if len(chosen) == most or not far.max() > close:
            return np.array(chosen)
        chosen.append(models[far.argmax()])


def nearest_centre(models, centres, low, high, largest, linear):
    """(centre, gap) of every model: the gap bounds the difference of errors on every row, rounding of predictions and of targets up to
    ``largest`` included."""
    gaps = np.stack([prediction_gaps(models, c, low, high, linear) for c in centres], axis=1)
    nearest = np.where(np.isnan(gaps), np.inf, gaps).argmin(axis=1)
    own, size = _magnitude(models, low, high, linear), _magnitude(centres, low, high, linear)
    gap = gaps[np.arange(len(models)), nearest] * (1 + 1e-9) + 1e-12 * (largest + own + size[nearest])
    return nearest, np.where(np.isnan(gap), np.inf, gap)


def error_bracket(errors, share):
    """Per fold (least, most) between which these rows' part of every order statistic at ``share`` of all rows lies; NaN without finite errors.

    The k-th smallest of all, k from share * n to share * (n + 1) + 1, is at least the smallest part's lower end and at most the largest
    part's upper end.
    """
    out = np.full((len(errors), 2), np.nan)
    for i, row in enumerate(errors):
        row = row[np.isfinite(row)]
        n = len(row)
        if n:
            ranks = (max(1, int(np.floor(share * n))), min(n, int(np.ceil(share * n)) + 3))
            out[i] = np.partition(row, [r - 1 for r in ranks])[[r - 1 for r in ranks]]
    return out


def errors_inside(errors, low, high):
    """Per fold (finite errors, errors below ``low``, distinct errors from low to high, their counts)."""
    for row, least, most in zip(errors, low, high):
        row = row[np.isfinite(row)]
        values, counts = np.unique(row[(row >= least) & (row <= most)], return_counts=True)
        yield len(row), int((row < least).sum()), values, counts
