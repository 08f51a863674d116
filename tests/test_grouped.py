"""Leave-one-group-out against a fit per fold on the same bins."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabcal.operators import group_kernels as GK, grouped as G, neighbors as N


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(5)
    n = 700
    pdf = pd.DataFrame({
        "i": np.arange(n), "g": np.where(rng.random(n) < 0.4, "hot", rng.choice(["a", "b", "c", "d", "e"], n)),
        "x1": np.round(rng.normal(0, 2, n), 1), "x2": rng.integers(0, 6, n).astype(float), "x3": rng.random(n)})
    pdf["y"] = 3 * pdf.x1 + np.where(pdf.x2 > 2, 5, 0) * np.where(pdf.g == "hot", -1, 1) + rng.normal(0, 1, n)
    pdf.loc[pdf.index % 50 == 0, "x1"] = np.nan
    pdf.loc[pdf.g == "e", "g"] = None
    pdf.loc[3, "y"] = np.nan
    df = spark.createDataFrame(pdf).withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("x1", "y")}).repartition(5)
    return df, pdf


FEATURES = ["x1", "x2", "x3"]


def numbers(pdf, edges):
    out = np.column_stack([np.searchsorted(e, pdf[c].to_numpy(), "left") for c, e in zip(FEATURES, edges)])
    out[np.isnan(pdf[FEATURES].to_numpy())] = 0
    return out


def grow(b, y, width, depth, least):
    """A plain regression tree on bin numbers, as a function of bin numbers."""
    value = y.mean() if len(y) else np.nan
    best = None
    if depth and len(y):
        options = []
        for f in range(b.shape[1]):
            for j in range(width):
                left = b[:, f] <= j
                if least <= left.sum() <= len(y) - least and 0 < left.sum() < len(y):
                    options.append((y[left].sum() ** 2 / left.sum() + y[~left].sum() ** 2 / (~left).sum() - y.sum() ** 2 / len(y), f, j))
        if options:
            top = max(o[0] for o in options)
            best = next(o for o in options if o[0] >= top * (1 - 1e-9)) if top > 1e-9 else None
    if best is None:
        return lambda rows: np.full(len(rows), value)
    _, f, j = best
    left = b[:, f] <= j
    low, high = grow(b[left], y[left], width, depth - 1, least), grow(b[~left], y[~left], width, depth - 1, least)
    return lambda rows: np.where(rows[:, f] <= j, low(rows), high(rows))


@pytest.mark.parametrize("depth,least", [(0, 1), (1, 1), (3, 5)])
def test_trees_equal_a_fit_per_fold(frame, depth, least):
    df, pdf = frame
    got = G.leave_group_out_tree(df, "g", FEATURES, "y", depth=depth, minimum_leaf=least, minimum_rows=20, bins=8).toPandas().set_index("i")
    edges = G.bin_edges(df, FEATURES, 8)
    b, known, group = numbers(pdf, edges), ~pdf.y.isna().to_numpy(), pdf.g.fillna("none").to_numpy()
    assert len(got) == len(pdf)
    for g in set(group):
        fit = known & (group != g)
        want = grow(b[fit], pdf.y.to_numpy()[fit], 8, depth, least)(b[group == g])
        assert np.allclose(got.loc[pdf.i[group == g], "prediction"], want)


def test_boosting_equals_stumps_fitted_to_residuals(frame):
    df, pdf = frame
    got = G.leave_group_out_boosting(df, "g", FEATURES, "y", rounds=25, rate=0.3, bins=8).toPandas().set_index("i")
    edges = G.bin_edges(df, FEATURES, 8)
    b, known, group = numbers(pdf, edges), ~pdf.y.isna().to_numpy(), pdf.g.fillna("none").to_numpy()
    for g in set(group):
        fit, y = known & (group != g), pdf.y.to_numpy()
        now = np.full(len(pdf), y[fit].mean())
        for _ in range(25):
            now = now + 0.3 * grow(b[fit], (y - now)[fit], 8, 1, 1)(b)
        assert np.allclose(got.loc[pdf.i[group == g], "prediction"], now[group == g])


def test_one_round_at_full_rate_is_the_depth_one_tree(frame):
    df, _ = frame
    a = G.leave_group_out_boosting(df, "g", FEATURES, "y", rounds=1, rate=1.0, bins=8).toPandas().set_index("i").prediction
    b = G.leave_group_out_tree(df, "g", FEATURES, "y", depth=1, bins=8).toPandas().set_index("i").prediction
    assert np.allclose(a.sort_index(), b.sort_index())


def test_small_groups_are_not_scored_and_no_rows_give_none(frame):
    df, pdf = frame
    kept = pdf.g.fillna("none").value_counts()
    least = int(kept.median()) + 1
    for fit in (G.leave_group_out_tree, G.leave_group_out_boosting):
        got = fit(df, "g", FEATURES, "y", minimum_rows=least, bins=4).toPandas()
        assert set(got.g.fillna("none")) == set(kept[kept >= least].index)
        assert fit(df.limit(0), "g", FEATURES, "y").count() == 0


@pytest.mark.parametrize("block_rows", [20_000, 60])
def test_knn_leaves_the_own_group_out(spark, block_rows, monkeypatch):
    rng = np.random.default_rng(8)
    n = 400
    v = np.round(rng.normal(size=(n, 3)), 1)
    v[:80] = v[0]  # copies of one point in all groups
    g = np.where(rng.random(n) < 0.5, "hot", rng.choice(["a", "b", "c"], n))
    y = rng.normal(size=n)
    rows = [(i, None if g[i] == "c" else str(g[i]), [float(x) for x in v[i]], float(y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "i long, g string, v array<double>, y double")
    found = N.nearest(df, df, query_id="i", train_id="i", vector="v", value="y", k=5, group="g", pivots=9, block_rows=block_rows).toPandas()
    for i in range(n):
        others = [j for j in range(n) if g[j] != g[i]]
        want = sorted(others, key=lambda j: (float(np.sqrt(((v[i] - v[j]) ** 2).sum())), j))[:5]
        assert found[found.i == i].sort_values("rank").neighbor_id.tolist() == want
    out = G.leave_group_out_knn(df, "g", "i", "v", "y", k=5, minimum_rows=30).toPandas().set_index("i")
    assert len(out) == n
    first = found[found.i == 7].neighbor_value.mean()
    assert abs(out.loc[7, "prediction"] - first) < 1e-12


def test_rows_are_read_a_fixed_number_of_times(spark, tmp_path):
    """The plan of the boosted folds holds the input as often with 3 as with 300 groups."""
    counts = []
    for groups in (3, 300):
        path = f"{tmp_path}/{groups}"
        spark.range(3000).select((F.col("id") % groups).alias("g"), (F.col("id") % 17).cast("double").alias("x"), F.sin("id").alias("y")).write.parquet(path)
        out = G.leave_group_out_boosting(spark.read.parquet(path), "g", ["x"], "y", rounds=3)
        counts.append(out._jdf.queryExecution().optimizedPlan().collectLeaves().size())
    assert counts[0] == counts[1] <= 4


def test_ties_go_to_the_first_feature_and_the_smallest_edge():
    n, s = np.ones((2, 4)), np.array([[-1.0, -1.0, 1.0, 1.0]] * 2)
    assert GK.first_best(n, s, 4, 1)[1:] == (0, 1)
    assert GK.first_best(n, np.zeros((2, 4)), 4, 1)[0] == 0.0


def test_splits_of_many_nodes_equal_those_of_each():
    rng = np.random.default_rng(4)
    n = rng.integers(0, 4, (60, 3, 5)).astype(float)
    s = rng.normal(size=n.shape) * (n > 0)
    n[:, 1:], s[0] = 0, 0.0
    n[3] = 0
    value, feature, place, gains = GK.best_splits(n, s, 5, 1, False)
    for i in range(60):
        gain, f, b = GK.first_best(n[i], s[i], 5, 1)
        rows = n[i, 0].sum()
        assert gains[i] == bool(rows > 0 and gain > 1e-12 * max(1.0, rows))
        assert not gains[i] or (feature[i], place[i]) == (f, b)
        assert np.isnan(value[i]) if rows == 0 else value[i] == s[i, 0].sum() / rows


def test_a_large_groups_pairs_give_the_same_table_as_its_rows(spark, monkeypatch):
    rng = np.random.default_rng(6)
    frame = pd.DataFrame({"g": np.where(np.arange(300) < 200, 0, rng.integers(1, 6, 300)), "a": rng.normal(size=300), "b": rng.integers(0, 4, 300) * 1.0})
    frame["y"] = frame["a"] + frame["b"]
    df = spark.createDataFrame(frame)
    edges = G.bin_edges(df, ["a", "b"], 6)
    want = [sorted(set(np.quantile(frame[c], np.arange(1, 6) / 6))) for c in ("a", "b")]
    assert all(np.allclose(e, w) for e, w in zip(edges, want))
    tables = lambda: {r.g: r["_table"] for r in G.fold_tables(
        df, "g", ["a", "b"], "y", rounds=5, rate=0.3, minimum_rows=3, bins=6, edges=edges).collect()}
    whole = tables()
    monkeypatch.setattr(G, "GROUP_ROWS", 50)
    cut = tables()
    assert set(whole) == set(cut) and all(np.allclose(whole[g], cut[g], atol=1e-9) for g in whole)
