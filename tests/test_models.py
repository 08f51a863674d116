import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tabcal.operators import encode as E, linear as L, models as M, neighbors as N


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    n = 600
    x = rng.normal(size=(n, 3)) * [1, 5, 0.2] + [10, -3, 100]
    pdf = pd.DataFrame(x, columns=["a", "b", "c"])
    pdf["y"] = 2 * pdf.a - pdf.b + 4 * pdf.c + rng.normal(size=n)
    pdf["g"], pdf["fold"], pdf["id"] = rng.choice(list("pqrs"), n), rng.integers(0, 3, n), np.arange(n)
    return spark.createDataFrame(pdf), pdf


F3 = ["a", "b", "c"]


def scaled(pdf):
    x = pdf[F3].to_numpy()
    return (x - x.mean(0)) / x.std(0), pdf.y.to_numpy() - pdf.y.mean(), x.std(0)


def test_ols_and_ridge_match_closed_form(data):
    df, pdf = data
    z, y, sd = scaled(pdf)
    for kind, params, penalty in (("ols", {}, 0.0), ("ridge", {"alpha": 50.0}, 50.0)):
        want = np.linalg.solve(z.T @ z + penalty * np.eye(3), z.T @ y) / sd
        one = L.fit_linear(df, F3, "y", kind, **params).first()
        assert np.allclose(one.coef, want)
        assert one.intercept == pytest.approx(pdf.y.mean() - want @ pdf[F3].mean().to_numpy())


def test_elastic_net_kernel_and_mllib_agree(data):
    df, _ = data
    std = E.standardize(df, df, F3)
    vec = VectorAssembler(inputCols=F3, outputCol="features").transform(std)
    mllib = M.elastic_net("features", "y", vec, 0.5, 0.6).fit(vec).coefficients.toArray()
    ours = np.array(L.fit_linear(std, F3, "y", "elastic_net", alpha=0.5, l1_ratio=0.6).first().coef)
    assert np.allclose(mllib, ours, atol=1e-4)
    ridge = M.ridge("features", "y", vec, 30.0).fit(vec).coefficients.toArray()
    assert np.allclose(ridge, L.fit_linear(std, F3, "y", "ridge", alpha=30.0).first().coef, atol=1e-6)


def test_bayesian_ridge_sd(data):
    df, pdf = data
    fitted = L.fit_linear(df, F3, "y", "bayesian_ridge")
    one = fitted.first()
    z, y, sd = scaled(pdf)
    w = np.array(one.coef) * sd
    noise = np.sqrt(1 / one.noise_precision)
    assert abs(noise - np.std(y - z @ w)) < 0.02
    cov = np.array(one.covariance).reshape(3, 3)
    lam = 3 / (w @ w)  # close to the evidence solution for a strong signal
    assert np.allclose(cov, np.linalg.inv(one.noise_precision * z.T @ z + lam * np.eye(3)), rtol=0.05, atol=1e-6)
    got = L.score(df, fitted, [], F3).orderBy("id").toPandas()
    want = np.sqrt(np.einsum("ij,jk,ik->i", z, cov, z) + 1 / one.noise_precision)
    assert np.allclose(got.prediction_sd, want)


def test_grid_search_equals_refitting_every_fold(data):
    df, pdf = data
    got = L.grid_search(df, "fold", F3, "y", [("ridge", {"alpha": 20.0})]).toPandas()
    for _, row in got.iterrows():
        train, held = pdf[pdf.fold != row.fold], pdf[pdf.fold == row.fold]
        z, y, sd = scaled(train)
        w = np.linalg.solve(z.T @ z + 20 * np.eye(3), z.T @ y) / sd
        guess = train.y.mean() + (held[F3].to_numpy() - train[F3].mean().to_numpy()) @ w
        assert row.cv_RMSE == pytest.approx(np.sqrt(((held.y - guess) ** 2).mean()))


def test_leave_group_out_equals_refitting(data):
    df, pdf = data
    got = L.leave_group_out(df, "g", F3, "y", "ols").orderBy("id").toPandas()
    for g in "pqrs":
        train, held = pdf[pdf.g != g], pdf[pdf.g == g]
        w, *_ = np.linalg.lstsq(np.c_[np.ones(len(train)), train[F3]], train.y, rcond=None)
        assert np.allclose(got[got.g == g].prediction, np.c_[np.ones(len(held)), held[F3]] @ w)


def test_vif_matches_regressions(data):
    df, pdf = data
    got = {r.feature: r.VIF for r in L.vif_table(df.withColumn("d", F.col("a") + F.col("b") / 7), [*F3, "d", "gone"]).collect()}
    assert got["gone"] is None and got["a"] == float("inf") and got["c"] < 1.1


def test_freeze():
    frozen = M.freeze({"ridge": {"alpha": 1.0}, "hyperparameter_tuning": {"enabled": True}}, {"ridge": {"model__alpha": 100.0, "poly__degree": 2}})
    assert frozen["ridge"] == {"alpha": 100.0, "degree": 2}
    assert frozen["hyperparameter_tuning"] == {"enabled": False, "frozen_from_training_cv": True}


def brute(points, values, ids, k, power=2.0):
    d = (np.abs(points[:, None, :] - points[None, :, :]) ** power).sum(-1) ** (1 / power)
    np.fill_diagonal(d, np.inf)
    order = np.lexsort((np.broadcast_to(ids, d.shape), d))[:, :k]
    return ids[order], np.take_along_axis(d, order, 1)


@pytest.mark.parametrize("metric,power", [("euclidean", 2.0), ("manhattan", 1.0), ("minkowski", 3.0)])
def test_neighbours_match_brute_force(spark, metric, power):
    rng = np.random.default_rng(4)
    points = rng.normal(size=(300, 3)).round(1)
    points[100:200] = points[100]  # a third of the rows are one point
    ids, values = np.arange(300), rng.normal(size=300)
    cells = [(int(i), [float(c) for c in v], float(y)) for i, v, y in zip(ids, points, values)]
    df = spark.createDataFrame(cells, "id long, v array<double>, y double").repartition(5)
    got = N.nearest(df, df, query_id="id", train_id="id", vector="v", value="y", k=4, metric=metric, order=power,
                    exclude_self=True, pivots=9, block_rows=40).orderBy("id", "rank").toPandas()
    want_ids, want_d = brute(points, values, ids, 4, power)
    assert np.allclose(got.distance.to_numpy().reshape(300, 4), want_d)
    strict = np.diff(np.c_[want_d, np.full(300, np.inf)], axis=1) > 1e-9
    assert (got.neighbor_id.to_numpy().reshape(300, 4) == want_ids)[strict & np.r_["1", np.ones((300, 1), bool), strict[:, :-1]]].all()


def test_knn_impute_matches_brute_force(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(80, 3))
    holes = x.copy()
    holes[::4, 0] = np.nan
    holes[1::9, 2] = np.nan
    pdf = pd.DataFrame(holes, columns=["p", "q", "r"]).assign(id=np.arange(80))
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "p double, q double, r double, id long")
    got = N.knn_impute(df, df, ["p", "q", "r"], "id", k=3, block_rows=30).orderBy("id").toPandas()
    for i in np.where(np.isnan(holes[:, 0]))[0]:
        both = ~np.isnan(holes) & ~np.isnan(holes[i])
        gap = np.where(both, holes - holes[i], 0) ** 2
        with np.errstate(divide="ignore", invalid="ignore"):
            d = np.where(both.sum(1) > 0, np.sqrt(gap.sum(1) * 3 / both.sum(1)), np.inf)
        d[np.isnan(holes[:, 0])] = np.inf
        assert got.p[i] == pytest.approx(holes[np.argsort(d, kind="stable")[:3], 0].mean())


def test_adaboost_and_quantile_forest_run_and_order(spark, data):
    df, _ = data
    vec = VectorAssembler(inputCols=F3, outputCol="features").transform(df)
    boosted = M.adaboost_r2(vec, row_id="id", features="features", label="y", rounds=3, maxDepth=3)(vec)
    spread = vec.agg(F.stddev("y")).first()[0]
    assert boosted.agg(F.sqrt(F.avg(F.pow(F.col("y") - F.col("prediction"), 2)))).first()[0] < spread
    q = M.quantile_forest(vec, vec, row_id="id", features="features", label="y", quantiles={"lo": 0.1, "hi": 0.9}, grid=20, numTrees=5, maxDepth=3, seed=1)
    assert q.where("lo > hi").count() == 0 and q.count() == 600


def test_polynomial_powers_match_mllib(spark):
    df = spark.createDataFrame([(2.0, 3.0, 5.0)], "a double, b double, c double")
    for degree in (2, 3):
        terms = E.expand_polynomial(df, ["a", "b", "c"], degree).first().poly.toArray()
        powers = E.polynomial_powers(3, degree)
        assert np.allclose(terms, [2.0**p * 3.0**q * 5.0**r for p, q, r in powers])


def test_searches_compare_clearly_fewer_than_all_pairs(spark, monkeypatch):
    """On clustered rows the pairs compared inside cells grow well below rows x rows, and the search stays exact."""
    from tabcal.operators import kernels, neighbors as N

    rng = np.random.default_rng(9)
    shares = []
    for n in (1_000, 8_000):
        centres = rng.normal(0, 40, (60, 4))
        v = centres[rng.integers(0, 60, n)] + rng.normal(size=(n, 4))
        df = spark.createDataFrame([(i, [float(x) for x in row], float(i)) for i, row in enumerate(v)], "i long, v array<double>, y double")
        met = spark.sparkContext.accumulator(0)
        plain = kernels.block_top_k

        def counted(query_ids, query, train_ids, *rest, **more):
            met.add(len(query_ids) * len(train_ids))
            return plain(query_ids, query, train_ids, *rest, **more)

        monkeypatch.setattr(N.kernels, "block_top_k", counted)
        found = N.nearest(df, df, query_id="i", train_id="i", vector="v", value="y", k=3, exclude_self=True).toPandas()
        monkeypatch.setattr(N.kernels, "block_top_k", plain)
        shares.append(met.value / n ** 2)
        for i in (0, 17, n - 1):
            d = np.sqrt(((v - v[i]) ** 2).sum(axis=1))
            d[i] = np.inf
            assert set(found[found.i == i].neighbor_id) == set(np.argsort(d)[:3])
    assert 0 < shares[1] < 0.1 and shares[1] < shares[0]


def test_a_query_goes_once_to_a_tile_and_wide_vectors_stay_exact(spark, monkeypatch):
    """In wide space no cell can be left out; a query's vector is sent once per tile of cells, not once per cell."""
    from tabcal.operators import neighbors as N

    rng = np.random.default_rng(21)
    n = 600
    v = rng.normal(size=(n, 24)) + 1e4  # far from the origin, so a careless product would lose digits
    v[5] = v[400]
    df = spark.createDataFrame([(i, [float(x) for x in row], float(i)) for i, row in enumerate(v)], "i long, v array<double>, y double")
    sent, plain = [], N.written

    def counted(table):
        out = plain(table)
        if "cells" in out.columns:
            sent.append(out.count())
        return out

    monkeypatch.setattr(N, "written", counted)
    got = N.nearest(df, df, query_id="i", train_id="i", vector="v", value="y", k=5, exclude_self=True, block_rows=200).orderBy("i", "rank").toPandas()
    assert n <= sent[0] <= 6 * n  # 64 pivots, at most 6 tiles
    want_ids, want_d = brute(v, np.arange(n), np.arange(n), 5)
    assert (got.neighbor_id.to_numpy().reshape(n, 5) == want_ids).all() and np.allclose(got.distance.to_numpy().reshape(n, 5), want_d)


def test_quantile_forest_reads_a_row_once(spark, data):
    """No shuffle holds a row per leaf or bin of a test row, and the quantiles are the weighted ones of the leaves' members."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import RandomForestRegressor

    vec = VectorAssembler(inputCols=F3, outputCol="features").transform(data[0])
    params = dict(numTrees=4, maxDepth=3, seed=2)
    found = M.quantile_forest(vec, vec, row_id="id", features="features", label="y", quantiles={"lo": 0.2, "hi": 0.7}, grid=10, **params)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange hashpartitioning") == 1
    got = found.toPandas().set_index("id")
    model = RandomForestRegressor(featuresCol="features", labelCol="y", **params).setLeafCol("leaf").fit(vec)
    pdf = model.transform(vec).select("id", "y", vector_to_array("leaf").alias("leaf")).toPandas()
    leaf, edges = np.stack(pdf.leaf), np.quantile(pdf.y, np.arange(1, 11) / 10)
    bins = (edges[None, :] < pdf.y.to_numpy()[:, None]).sum(axis=1)
    for i in range(0, len(pdf), 37):
        mass = sum(np.bincount(bins[leaf[:, t] == leaf[i, t]], minlength=11) / (leaf[:, t] == leaf[i, t]).sum() for t in range(4)).cumsum()
        for name, p in (("lo", 0.2), ("hi", 0.7)):
            assert got.loc[pdf.id[i], name] == pytest.approx(edges[min(int((mass >= p * mass[-1] - 1e-12).argmax()), 9)])


def test_metrics_read_written_predictions_and_weights(spark, monkeypatch):
    """No pass of the metrics runs a model again, and no AdaBoost round the trees before it."""
    from tabcal.catalog import modelling

    rows = spark.range(200).selectExpr("id AS row_id", "CASE WHEN id % 3 = 0 THEN 'test' ELSE 'train' END AS split", "id * 1.5D AS y", "id * 1D AS x", "id % 7 * 1D AS z")
    d = modelling.assembled(rows, ["x", "z"])
    tables = []
    monkeypatch.setattr(M, "written", lambda df, keep=M.written: tables.append(df) or keep(df))
    score = M.adaboost_r2(d.where("split = 'train'"), row_id="row_id", features="features", label="y", rounds=2, maxDepth=2)
    assert len(tables) == 2
    tree = M.decision_tree("features", "y", maxDepth=2, seed=1).fit(d)
    out = modelling.metrics_by_split({"ada": score, "tree": tree}, d)
    assert "UDF(" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.model, r.split, r.n_rows) for r in out.collect()} == {(m, s, n) for m in ("ada", "tree") for s, n in (("test", 67), ("train", 133))}
