"""Models, tuning, neighbours, bootstrap, composed jobs, sources and sinks."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import functions as F

from tabcal.catalog.base import FRACTIONS, LINES, METRIC_ROUND, METRIC_SQL, SEED, SPLIT_LINES, lines, predictions, query, r, rounded, table
from tabcal.catalog.base import round_sql
from tabcal.catalog.columns import split_lines
from tabcal.catalog.evaluation import INTERVAL_COLUMNS, INTERVAL_SQL, KEYS
from tabcal.catalog.profiles import group_split_sql
from tabcal.functions.features import safe_ratio
from tabcal.operators.columns import repair_types
from tabcal.operators import bootstrap as B, encode as E, evaluate as V, grouped as G, linear as L, models as M, neighbors as N, preprocess as PP, splits as S
from tabcal.plans import calibration as CP, clean_split as CS, compare as TC
from tabcal.session import durable, written
from tabcal.sources import readers as RD, writers as WR

FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


def table_of_models(spark, sf):
    """Split lines with the target (price in thousands plus a quantity effect) and a group-fold column."""
    d = split_lines(spark, sf)
    return d.withColumn("y", F.col("l_extendedprice") / 1000 + 2 * F.col("l_quantity") - 3 * F.col("l_linenumber") * F.col("l_tax"))


Y_SQL = SPLIT_LINES + ", ty AS (SELECT *, l_extendedprice / 1000 + 2 * l_quantity - 3 * l_linenumber * l_tax AS y FROM sl)\n"


def assembled(d, features=FEATURES):
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(d)


def stored(d, *columns):
    """The modelling table as a job keeps it: needed columns written once, then read by every fit."""
    return durable(d.select(*columns))


def metrics_by_split(models, d):
    """All models score a row in one pass; the predictions are written once and read by every pass of the metrics."""
    scored = d
    for i, model in enumerate(models.values()):
        out = model.transform(scored) if hasattr(model, "transform") else model(scored)
        scored = out.withColumnRenamed("prediction", f"_prediction_{i}")
    said = [f"_prediction_{i}" for i in range(len(models))]
    kept = written(scored.select("row_id", "split", "y", *said))
    told = {name: lambda rows, c=c: rows.withColumn("prediction", F.col(c)) for name, c in zip(models, said)}
    table_ = M.score_table(told, kept, row_id="row_id", label="y", split="split", policy="all", experiment="baseline")
    return V.regression_metrics(table_, ["model", "split"], bounded=True)


@query("ols_m1", Y_SQL + """, m AS (SELECT covar_pop(l_quantity, y) a, covar_pop(l_linenumber, y) b, var_pop(l_quantity) p, var_pop(l_linenumber) q, covar_pop(l_quantity, l_linenumber) c FROM ty WHERE split = 'train')
 SELECT 'l_quantity' AS feature, round((a * q - b * c) / (p * q - c * c), 6) + 0.0 AS coefficient FROM m UNION ALL SELECT 'l_linenumber', round((b * p - a * c) / (p * q - c * c), 6) + 0.0 FROM m""")
def _(spark, sf):
    d = assembled(table_of_models(spark, sf).where("split = 'train'"), ["l_quantity", "l_linenumber"])
    return rounded(M.coefficients(M.ols("features", "y").fit(d), ["l_quantity", "l_linenumber"], spark).select("feature", "coefficient"))


Z_SQL = Y_SQL + """, z AS (SELECT (l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER () AS x, y FROM ty WHERE split = 'train'),
 m AS (SELECT count(*) AS n, covar_pop(x, y) AS c, var_pop(x) AS v FROM z) """


def one_feature(spark, sf):
    d = table_of_models(spark, sf).where("split = 'train'")
    return assembled(E.standardize(d, d, ["l_quantity"]), ["l_quantity"])


@query("elastic_net_m2", Z_SQL + "SELECT 'l_quantity' AS feature, round(sign(c) * greatest(abs(c) - 2.0 * 0.7, 0) / (v + 2.0 * 0.3), 5) AS coefficient FROM m")
def _(spark, sf):
    d = one_feature(spark, sf)
    return rounded(M.coefficients(M.elastic_net("features", "y", d, 2.0, 0.7).fit(d), ["l_quantity"], spark).select("feature", "coefficient"), 5)


@query("ridge_m3", Z_SQL + "SELECT 'l_quantity' AS feature, round(c * n / (v * n + 500), 6) AS coefficient FROM m")
def _(spark, sf):
    d = one_feature(spark, sf)
    return rounded(M.coefficients(M.ridge("features", "y", d, 500.0).fit(d), ["l_quantity"], spark).select("feature", "coefficient"))


@query("coefficient_table_m13", Z_SQL + "SELECT 'l_quantity' AS feature, round(c * n / (v * n + 500), 6) AS coefficient, round(abs(c * n / (v * n + 500)), 6) AS absolute FROM m")
def _(spark, sf):
    d = table_of_models(spark, sf).where("split = 'train'")
    return rounded(L.coefficient_table(L.fit_linear(d, ["l_quantity"], "y", "ridge", alpha=500.0), ["l_quantity"]))


@query("bayesian_ridge_m4")
def _(spark, sf):
    d = table_of_models(spark, sf)
    scored = L.score(d, L.fit_linear(d.where("split = 'train'"), FEATURES, "y", "bayesian_ridge"), [], FEATURES)
    return scored.groupBy("split").agg(F.count("prediction").alias("n_rows"), r(F.avg("prediction"), 4).alias("mean_prediction"),
                                       r(F.avg("prediction_sd"), 4).alias("mean_sd"), r(F.sqrt(F.avg(F.pow(F.col("y") - F.col("prediction"), 2))), 4).alias("RMSE"))


@query("polynomial_ridge_e12")
def _(spark, sf):
    terms = ["l_quantity", "l_discount", "l_tax"]
    d = E.expand_polynomial(written(table_of_models(spark, sf).select("row_id", "split", "y", *terms)), terms, 2)
    d = written(E.scale_vector(d, "split = 'train'", "poly", "features").select("row_id", "split", "y", "features"))
    model = M.ridge("features", "y", d.where("split = 'train'"), 10.0).fit(d.where("split = 'train'"))
    return rounded(metrics_by_split({"Polynomial Ridge": model}, d), 4)


@query("interaction_terms_e12", SPLIT_LINES + "SELECT row_id, l_quantity AS t0, l_discount AS t1, l_quantity * l_discount AS t2 FROM sl")
def _(spark, sf):
    from pyspark.ml.functions import vector_to_array

    d = E.expand_polynomial(lines(spark, sf), ["l_quantity", "l_discount"], 2, interaction_only=True)
    v = vector_to_array("poly")
    return d.select("row_id", *[v[i].alias(f"t{i}") for i in range(3)])


@query("tree_models_m5")
def _(spark, sf):
    d = written(assembled(table_of_models(spark, sf)).select("row_id", "split", "y", "features"))
    train = d.where("split = 'train'")
    return rounded(metrics_by_split({
        "decision_tree": M.decision_tree("features", "y", maxDepth=5, seed=1).fit(train),
        "random_forest": M.random_forest("features", "y", numTrees=10, maxDepth=5, seed=1).fit(train),
        "bagged_trees": M.bagged_trees("features", "y", numTrees=10, maxDepth=5, seed=1).fit(train)}, d), 4)


@query("quantile_forest_m6")
def _(spark, sf):
    d = assembled(table_of_models(spark, sf))
    return rounded(M.quantile_forest(d.where("split = 'train'"), d.where("split = 'test'"), row_id="row_id", features="features", label="y",
                                     quantiles={"q05": 0.05, "q50": 0.5, "q95": 0.95}, numTrees=10, maxDepth=5, seed=1), 4)


@query("gradient_boosting_m7")
def _(spark, sf):
    d = written(assembled(table_of_models(spark, sf)))
    return rounded(metrics_by_split({"gbt": M.gradient_boosting("features", "y", maxIter=10, maxDepth=3, seed=1).fit(d.where("split = 'train'"))}, d), 4)


@query("adaboost_r2_m8")
def _(spark, sf):
    d = written(assembled(table_of_models(spark, sf)).select("row_id", "split", "y", "features"))
    score = M.adaboost_r2(d.where("split = 'train'"), row_id="row_id", features="features", label="y", rounds=5, maxDepth=3)
    return rounded(metrics_by_split({"adaboost_r2": score}, d), 4)


@query("log_target_s29", Y_SQL + f""", m AS (SELECT regr_slope(ln(1 + y), l_quantity) AS b, regr_intercept(ln(1 + y), l_quantity) AS a FROM ty WHERE split = 'train'),
 p AS (SELECT 'log_ols' AS model, split, y AS Actual, exp(a + b * l_quantity) - 1 AS Predicted FROM ty, m),
 e AS (SELECT *, Actual - Predicted AS Residual, abs(Actual - Predicted) AS AbsoluteError, pow(Actual - Predicted, 2) AS SquaredError FROM p)
 SELECT model, split, {METRIC_ROUND} FROM (SELECT model, split, {METRIC_SQL} FROM e GROUP BY 1, 2)""")
def _(spark, sf):
    d = assembled(table_of_models(spark, sf), ["l_quantity"])
    score = M.fit_log_target(lambda label: M.ols("features", label), d.where("split = 'train'"), "y")
    return rounded(metrics_by_split({"log_ols": score}, d))


GRIDS = {"ridge": [{"alpha": a} for a in (1.0, 100.0, 10000.0)], "elastic_net": [{"alpha": a, "l1_ratio": l} for a in (0.01, 1.0) for l in (0.2, 0.9)], "ols": [{}]}


def folded(spark, sf):
    d = table_of_models(spark, sf)
    return d.withColumn("fold", F.pmod(S.hash_number(F.col("l_suppkey"), SEED), F.lit(3)))


FOLDED_SQL = Y_SQL + f", fo AS (SELECT *, ('0x' || substr(md5(l_suppkey || '|{SEED}'), 1, 8))::BIGINT % 3 AS fold FROM ty WHERE split = 'train')\n"


@query("grid_search_m9", FOLDED_SQL + """, cd AS (SELECT unnest([1.0, 100.0, 10000.0])::DOUBLE AS alpha, unnest(['{"alpha": 1.0}', '{"alpha": 100.0}', '{"alpha": 10000.0}']) AS candidate_parameters),
 st AS (SELECT k AS fold, count(*)::DOUBLE AS n, avg(l_quantity) AS mx, avg(y) AS my, covar_pop(l_quantity, y) AS cxy, var_pop(l_quantity) AS v FROM fo, (SELECT unnest(range(3)) AS k) WHERE fold <> k GROUP BY 1),
 w AS (SELECT st.*, candidate_parameters, n * cxy / v / (n + alpha) AS w FROM st, cd),
 sc AS (SELECT candidate_parameters, k AS fold, sqrt(avg(pow(y - my - w * (l_quantity - mx), 2)) FILTER (fo.fold = k)) AS cv, sqrt(avg(pow(y - my - w * (l_quantity - mx), 2)) FILTER (fo.fold <> k)) AS tr
   FROM fo, (SELECT fold AS k, * EXCLUDE (fold) FROM w) GROUP BY 1, 2)
 SELECT 'ridge' AS model, candidate_parameters, rank() OVER (ORDER BY avg(cv)) AS rank_cv_RMSE, round(avg(cv), 6) AS mean_cv_RMSE, round(stddev_pop(cv), 6) AS std_cv_RMSE, round(avg(tr), 6) AS mean_train_cv_RMSE FROM sc GROUP BY 2""")
def _(spark, sf):
    candidates = [("ridge", p) for p in GRIDS["ridge"]]
    out = L.cv_table(L.grid_search(folded(spark, sf).where("split = 'train'"), "fold", ["l_quantity"], "y", candidates))
    return rounded(out.drop("mean_fit_time_seconds", "std_fit_time_seconds"))


@query("grid_search_linear_family_m9")
def _(spark, sf):
    candidates = [(kind, p) for kind, options in GRIDS.items() for p in options]
    out = L.cv_table(L.grid_search(folded(spark, sf).where("split = 'train'"), "fold", FEATURES, "y", candidates))
    return rounded(out.drop("mean_fit_time_seconds", "std_fit_time_seconds"), 5)


@query("grid_search_trees_m9")
def _(spark, sf):
    d = written(assembled(folded(spark, sf)).where("split = 'train'").select("features", "y", "fold"))
    tree = M.decision_tree("features", "y", seed=1)
    grid = ParamGridBuilder().addGrid(tree.maxDepth, [2, 4]).build()
    return rounded(M.tune(tree, grid, d, "y", "fold", 3)[1], 4)


@query("best_parameters_io11")
def _(spark, sf):
    return rounded(TC.tune_linear(folded(spark, sf).where("split = 'train'"), fold="fold", features=FEATURES, target="y", grids=GRIDS), 5)


@query("params_json_io11", """SELECT o_orderpriority, '{"custkey":' || o_custkey || ',"status":"' || o_orderstatus || '"}' AS parameters FROM orders""")
def _(spark, sf):
    d = table(spark, sf, "orders").select("o_orderpriority", F.col("o_custkey").alias("custkey"), F.col("o_orderstatus").alias("status"))
    return WR.params_json(d, ["status", "custkey"])


@query("frozen_refit_m10", Y_SQL + f""", m AS (SELECT count(*)::DOUBLE AS n, avg(l_quantity) AS mx, avg(y) AS my, covar_pop(l_quantity, y) AS c, var_pop(l_quantity) AS v FROM ty WHERE split = 'train'),
 e AS (SELECT split, y AS Actual, my + n * c / v / (n + 100) * (l_quantity - mx) AS Predicted FROM ty, m),
 f AS (SELECT *, Actual - Predicted AS Residual, abs(Actual - Predicted) AS AbsoluteError, pow(Actual - Predicted, 2) AS SquaredError FROM e)
 SELECT 'ridge' AS model, split, {METRIC_ROUND} FROM (SELECT split, {METRIC_SQL} FROM f GROUP BY 1)""")
def _(spark, sf):
    frozen = M.freeze({"ridge": {"alpha": 1.0}, "hyperparameter_tuning": {"enabled": True}}, {"ridge": {"model__alpha": 100.0}})
    p = TC.linear_predictions(table_of_models(spark, sf), row_id="row_id", features=["l_quantity"], target="y", models={"ridge": ("ridge", frozen["ridge"])})
    return rounded(V.regression_metrics(p, ["model", "split"], bounded=True))


@query("held_out_selection_m14")
def _(spark, sf):
    chosen, final = TC.select_and_test(stored(folded(spark, sf), "row_id", "split", "fold", "y", *FEATURES), row_id="row_id", features=FEATURES, target="y", fold="fold", grids=GRIDS)
    return rounded(V.regression_metrics(final.where("split = 'test'"), ["model", "split"], bounded=True), 5)


VARIANTS_SQL = Y_SQL + f""", bd AS (SELECT quantile_cont(y, 0.025) AS lo, quantile_cont(y, 0.975) AS hi FROM ty WHERE split = 'train'),
 va AS (SELECT 'original' AS experiment, split, l_quantity AS x, y FROM ty UNION ALL SELECT 'without_quantity', split, l_linenumber, y FROM ty
   UNION ALL SELECT 'trimmed_target', split, l_quantity, y FROM ty, bd WHERE split <> 'train' OR y BETWEEN lo AND hi
   UNION ALL SELECT 'engineered_ratio', split, l_quantity / (l_linenumber + 1), y FROM ty),
 m AS (SELECT experiment, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM va WHERE split = 'train' GROUP BY 1),
 e AS (SELECT experiment, split, y AS Actual, a + b * x AS Predicted, y - (a + b * x) AS Residual, abs(y - (a + b * x)) AS AbsoluteError, pow(y - (a + b * x), 2) AS SquaredError FROM va JOIN m USING (experiment))
 SELECT 'all' AS policy, experiment, false AS exploratory, 'ols' AS model, split, {METRIC_ROUND} FROM (SELECT experiment, split, {METRIC_SQL} FROM e GROUP BY 1, 2)"""


@query("variant_experiments_m17", VARIANTS_SQL)
def _(spark, sf):
    ratio = lambda x: x.withColumn("ratio", safe_ratio(F.col("l_quantity"), F.col("l_linenumber") + 1))
    return rounded(TC.run_variants(stored(table_of_models(spark, sf), "row_id", "split", "y", "l_quantity", "l_linenumber"), {
        "original": (lambda x: x, ["l_quantity"]), "without_quantity": (lambda x: x, ["l_linenumber"]),
        "trimmed_target": (TC.trimmed("y"), ["l_quantity"]), "engineered_ratio": (ratio, ["ratio"]),
    }, row_id="row_id", target="y", models={"ols": ("ols", {})}))


@query("experiment_scope_a30", LINES + """SELECT 'without_' || l_returnflag AS experiment, count(*) >= 50 AS enabled, avg((amount IS NULL)::INT) > 0.14 AS targeted, avg((amount IS NULL)::INT) <= 0.14 AS exploratory,
 CASE WHEN avg((amount IS NULL)::INT) > 0.14 THEN 'gaps' ELSE 'few_gaps' END AS reason FROM lines GROUP BY l_returnflag""")
def _(spark, sf):
    """One ablation per return flag, in scope if it has rows, targeted if amounts are missing there (one row per flag reaches the driver)."""
    flags = lines(spark, sf).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("amount").isNull().cast("int")).alias("gap")).collect()
    return TC.experiment_scope(spark, {
        f"without_{x.l_returnflag}": {"enabled": x.n >= 50, "targeted": x.gap > 0.14, "exploratory": x.gap <= 0.14, "reason": "gaps" if x.gap > 0.14 else "few_gaps"} for x in flags})


VIF_SQL = Y_SQL + """, f AS (SELECT l_quantity AS a, y AS b, coalesce(amount, (SELECT median(amount) FROM ty)) AS c FROM ty),
 m AS (SELECT corr(a, b) ab, corr(a, c) ac, corr(b, c) bc FROM f), d AS (SELECT *, 1 + 2 * ab * ac * bc - ab * ab - ac * ac - bc * bc AS det FROM m),
 v AS (SELECT 'l_quantity' AS feature, (1 - bc * bc) / det AS VIF FROM d UNION ALL SELECT 'y', (1 - ac * ac) / det FROM d UNION ALL SELECT 'amount', (1 - ab * ab) / det FROM d)
"""
VIF_LABEL = "CASE WHEN VIF < 5 THEN 'acceptable' WHEN VIF < 10 THEN 'high' ELSE 'severe' END"


@query("vif_m12", VIF_SQL + f"""SELECT feature, 'kept' AS status, '' AS reason, round(VIF, 6) AS VIF, round(1 - 1 / VIF, 6) AS R2_against_other_features, {VIF_LABEL} AS interpretation FROM v
 UNION ALL VALUES ('empty', 'dropped', 'fully_missing', NULL, NULL, NULL), ('gone', 'dropped', 'not_present_in_X_train', NULL, NULL, NULL)""")
def _(spark, sf):
    return rounded(L.vif_table(table_of_models(spark, sf), ["l_quantity", "y", "amount", "empty", "gone"]))


@query("vif_summary_m12", VIF_SQL + """SELECT 'all' AS policy, round(max(VIF), 6) AS max_vif, round(median(VIF), 6) AS median_vif, count(*) FILTER (VIF >= 5) AS number_features_vif_above_5,
 count(*) FILTER (VIF >= 10) AS number_features_vif_above_10, 0::BIGINT AS number_inf_vif FROM v""")
def _(spark, sf):
    return rounded(L.vif_summary(L.vif_table(table_of_models(spark, sf), ["l_quantity", "y", "amount", "empty", "gone"]), "all"))


@query("leave_group_out_m16", Y_SQL + """, g AS (SELECT l_suppkey, count(*)::DOUBLE n, sum(l_quantity) sx, sum(y) sy, sum(l_quantity * l_quantity) sxx, sum(l_quantity * y) sxy FROM ty GROUP BY 1),
 t AS (SELECT l_suppkey, sum(n) OVER () - n AS n, sum(sx) OVER () - sx AS sx, sum(sy) OVER () - sy AS sy, sum(sxx) OVER () - sxx AS sxx, sum(sxy) OVER () - sxy AS sxy, n AS own FROM g),
 w AS (SELECT l_suppkey, (sxy - sx * sy / n) / (sxx - sx * sx / n) AS b, sy / n - (sxy - sx * sy / n) / (sxx - sx * sx / n) * sx / n AS a FROM t WHERE own >= 50)
 SELECT l_suppkey, row_id, round(a + b * l_quantity, 5) AS prediction FROM ty JOIN w USING (l_suppkey)""")
def _(spark, sf):
    out = L.leave_group_out(table_of_models(spark, sf), "l_suppkey", ["l_quantity"], "y", "ols", 50)
    return rounded(out.select("l_suppkey", "row_id", "prediction"), 5)


@query("leave_group_out_metrics_m16", Y_SQL + f""", g AS (SELECT l_suppkey, count(*)::DOUBLE n, sum(l_quantity) sx, sum(y) sy, sum(l_quantity * l_quantity) sxx, sum(l_quantity * y) sxy FROM ty GROUP BY 1),
 t AS (SELECT l_suppkey, sum(n) OVER () - n AS n, sum(sx) OVER () - sx AS sx, sum(sy) OVER () - sy AS sy, sum(sxx) OVER () - sxx AS sxx, sum(sxy) OVER () - sxy AS sxy, n AS own FROM g),
 w AS (SELECT l_suppkey, (sxy - sx * sy / n) / (sxx - sx * sx / n) AS b, sy / n - (sxy - sx * sy / n) / (sxx - sx * sx / n) * sx / n AS a FROM t WHERE own >= 50),
 e AS (SELECT l_suppkey, y AS Actual, a + b * l_quantity AS Predicted, y - (a + b * l_quantity) AS Residual, abs(y - (a + b * l_quantity)) AS AbsoluteError, pow(y - (a + b * l_quantity), 2) AS SquaredError FROM ty JOIN w USING (l_suppkey))
 SELECT 'ols' AS model, l_suppkey, {METRIC_ROUND}, round(MaximumAE, 6) AS MaximumAE, round(worst, 6) AS worst_row_squared_error_share, dominant_residual_direction FROM (
 SELECT l_suppkey, {METRIC_SQL}, max(AbsoluteError) AS MaximumAE, max(SquaredError) / sum(SquaredError) AS worst, CASE WHEN avg(Residual) > 0 THEN 'underprediction' ELSE 'overprediction' END AS dominant_residual_direction FROM e GROUP BY 1)""")
def _(spark, sf):
    out = L.leave_group_out(table_of_models(spark, sf), "l_suppkey", ["l_quantity"], "y", "ols", 50)
    p = V.prediction_table(out, row_id="row_id", actual="y", predicted="prediction", labels={"model": F.lit("ols")}, carry=["l_suppkey"])
    return rounded(V.regression_metrics(p, ["model", "l_suppkey"], extra=V.fold_extras()).drop("target_mean", "target_min", "target_max"))


STUMP_FEATURES, STUMP_BINS = ["l_quantity", "l_extendedprice"], 16


def stump_sql(source, least):
    """st: per held-out supplier the depth-1 tree on all other suppliers' rows of ``source``: feature f, edge e, the means lo and hi."""
    probs = "[" + ", ".join(f"{i / STUMP_BINS}::DOUBLE" for i in range(1, STUMP_BINS)) + "]"
    edges = " UNION ALL ".join(f"SELECT {i} AS f, unnest(list_distinct(quantile_cont({c}, {probs}))) AS e FROM {source}" for i, c in enumerate(STUMP_FEATURES))
    feature = "CASE f " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(STUMP_FEATURES)) + " END"
    return f""", ce AS (SELECT l_suppkey, l_quantity, l_extendedprice, y - (SELECT avg(y) FROM {source}) AS c FROM {source}), ed AS MATERIALIZED ({edges}),
 gl AS MATERIALIZED (SELECT l_suppkey, f, e, count(*) FILTER ({feature} <= e)::DOUBLE AS n, coalesce(sum(c) FILTER ({feature} <= e), 0) AS s FROM ce, ed GROUP BY ALL),
 ga AS (SELECT l_suppkey, count(*)::DOUBLE AS n, sum(c) AS s FROM ce GROUP BY 1),
 tl AS (SELECT f, e, sum(n) AS n, sum(s) AS s FROM gl GROUP BY ALL), tt AS (SELECT sum(n) AS n, sum(s) AS s FROM ga),
 op AS (SELECT ga.l_suppkey, gl.f, gl.e, tl.n - gl.n AS nl, tl.s - gl.s AS sl, tt.n - ga.n AS n, tt.s - ga.s AS s FROM ga JOIN gl USING (l_suppkey) JOIN tl ON tl.f = gl.f AND tl.e = gl.e, tt WHERE ga.n >= {least}),
 gn AS (SELECT *, sl * sl / nl + (s - sl) * (s - sl) / (n - nl) - s * s / n AS gain FROM op WHERE nl > 0 AND nl < n),
 st AS MATERIALIZED (SELECT l_suppkey, f, e, sl / nl + (SELECT avg(y) FROM {source}) AS lo, (s - sl) / (n - nl) + (SELECT avg(y) FROM {source}) AS hi
  FROM (SELECT *, max(gain) OVER (PARTITION BY l_suppkey) AS top FROM gn) WHERE gain >= top * (1 - 1e-9::DOUBLE)
  QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY f, e) = 1)
"""


STUMP = "CASE WHEN (CASE f " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(STUMP_FEATURES)) + " END) <= e THEN lo ELSE hi END"


@query("leave_group_out_tree_m16", Y_SQL + stump_sql("ty", 50) + f" SELECT l_suppkey, row_id, round({STUMP}, 5) AS prediction FROM ty JOIN st USING (l_suppkey)")
def _(spark, sf):
    out = G.leave_group_out_tree(table_of_models(spark, sf), "l_suppkey", STUMP_FEATURES, "y", minimum_rows=50, bins=STUMP_BINS)
    return rounded(out.select("l_suppkey", "row_id", "prediction"), 5)


@query("leave_group_out_deep_tree_m16")
def _(spark, sf):
    d = table_of_models(spark, sf).select("row_id", "l_suppkey", "y", *FEATURES)
    out = G.leave_group_out_tree(d, "l_suppkey", FEATURES, "y", depth=4, minimum_leaf=5, minimum_rows=50)
    return rounded(out.select("l_suppkey", "row_id", "prediction"), 5)


@query("leave_group_out_boosting_m16")
def _(spark, sf):
    """100 boosted stumps per held-out supplier over all features; pooled scores as in the reports of whole folds."""
    features = [*FEATURES, "l_extendedprice"]
    d = table_of_models(spark, sf).select("row_id", "l_suppkey", "y", *features)
    out = written(G.leave_group_out_boosting(d, "l_suppkey", features, "y", rounds=100, minimum_rows=50).select("row_id", "l_suppkey", "y", "prediction"))
    p = V.prediction_table(out, row_id="row_id", actual="y", predicted="prediction", labels={"model": F.lit("boosted_stumps")}, carry=["l_suppkey"])
    return rounded(V.regression_metrics(p, ["model", "l_suppkey"], extra=V.fold_extras()).drop("target_mean", "target_min", "target_max"))


@query("leave_group_out_boosted_step_m16", Y_SQL + stump_sql("ty", 50) + f""" SELECT l_suppkey, round(sqrt(avg(pow(y - ({STUMP}), 2))), 6) AS RMSE, round(avg(abs(y - ({STUMP}))), 6) AS MAE, count(*) AS n_rows
 FROM ty JOIN st USING (l_suppkey) GROUP BY 1""")
def _(spark, sf):
    """The first stump at full rate, from the counts of bin pairs: the depth-1 tree, by the other route."""
    d = table_of_models(spark, sf).select("l_suppkey", "y", *STUMP_FEATURES)
    out = G.leave_group_out_boosting(d, "l_suppkey", STUMP_FEATURES, "y", rounds=1, rate=1.0, minimum_rows=50, bins=STUMP_BINS)
    gap = F.col("y") - F.col("prediction")
    return rounded(out.groupBy("l_suppkey").agg(F.sqrt(F.avg(gap * gap)).alias("RMSE"), F.avg(F.abs(gap)).alias("MAE"), F.count(F.lit(1)).alias("n_rows")))


# ---- neighbours ----------------------------------------------------------------------------
def vectors(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("double").alias("label"))


PAIRS_SQL = """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label::DOUBLE AS label FROM embeddings),
 p AS (SELECT a.vec_id, b.vec_id AS neighbor_id, b.label AS neighbor_value, $d AS distance FROM e a JOIN e b ON a.vec_id <> b.vec_id),
 nn AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbor_id) AS rank FROM p QUALIFY rank <= 5)
"""
EUCLID, MANHATTAN = "list_distance(a.v, b.v)", "list_sum(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2])))"


def near(spark, sf, metric="euclidean", order=2.0, k=5):
    v = vectors(spark, sf)
    return N.nearest(v, v, query_id="vec_id", train_id="vec_id", vector="embedding", value="label", k=k, metric=metric, order=order, exclude_self=True)


@query("leave_group_out_knn_m16", """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label::DOUBLE AS label, vec_id % 7 AS g FROM embeddings),
 p AS (SELECT a.vec_id, a.g, b.label AS neighbor_value, b.vec_id AS neighbor_id, list_distance(a.v, b.v) AS distance FROM e a JOIN e b ON a.g <> b.g),
 nn AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbor_id) <= 5)
SELECT vec_id, g, round(avg(neighbor_value), 8) AS prediction FROM nn GROUP BY ALL""")
def _(spark, sf):
    v = vectors(spark, sf).withColumn("g", F.col("vec_id") % 7)
    return rounded(G.leave_group_out_knn(v, "g", "vec_id", "embedding", "label", k=5).select("vec_id", "g", "prediction"), 8)


@query("nearest_neighbours_knn1", PAIRS_SQL.replace("$d", EUCLID) + "SELECT vec_id, rank::INTEGER AS rank, neighbor_id, neighbor_value, round(distance, 8) AS distance FROM nn")
def _(spark, sf):
    return rounded(near(spark, sf), 8)


@query("knn_manhattan_knn1", PAIRS_SQL.replace("$d", MANHATTAN) + "SELECT vec_id, round(avg(neighbor_value), 8) AS prediction, round(avg(distance), 8) AS mean_distance FROM nn GROUP BY 1")
def _(spark, sf):
    return rounded(N.knn_regression(near(spark, sf, "manhattan"), "vec_id"), 8)


@query("knn_inverse_distance_j10", PAIRS_SQL.replace("$d", EUCLID) + "SELECT vec_id, round(CASE WHEN min(distance) = 0 THEN avg(neighbor_value) FILTER (distance = 0) ELSE sum(neighbor_value / distance) / sum(1 / distance) END, 8) AS prediction, round(avg(distance), 8) AS mean_distance FROM nn GROUP BY 1")
def _(spark, sf):
    return rounded(N.knn_regression(near(spark, sf), "vec_id", "distance"), 8)


@query("k_sweep_m11", PAIRS_SQL.replace("$d", EUCLID) + ", ks AS (SELECT unnest([1, 3, 5]) AS k) SELECT vec_id, k, round(avg(neighbor_value) FILTER (rank <= k), 8) AS prediction FROM nn, ks GROUP BY 1, 2")
def _(spark, sf):
    return rounded(N.k_sweep(near(spark, sf), "vec_id", [1, 3, 5]), 8)


def fill_sql(c):
    gap = lambda x: f"coalesce(pow(a.{x} - b.{x}, 2), 0)"
    seen = lambda x: f"(a.{x} IS NOT NULL AND b.{x} IS NOT NULL)::INT"
    xs = ["x0", "x1", "x2", "x3"]
    return f"""(SELECT vec_id, avg(v) AS {c}f FROM (SELECT a.vec_id, b.{c} AS v, row_number() OVER (PARTITION BY a.vec_id ORDER BY sqrt(({" + ".join(map(gap, xs))}) * 4 / ({" + ".join(map(seen, xs))})), b.vec_id) AS k
 FROM h a JOIN h b ON a.{c} IS NULL AND b.{c} IS NOT NULL WHERE {" + ".join(map(seen, xs))} > 0) WHERE k <= 5 GROUP BY 1)"""


@query("knn_impute_e4", """WITH h AS (SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN NULL ELSE embedding[1]::DOUBLE END AS x0, CASE WHEN vec_id % 7 = 0 THEN NULL ELSE embedding[2]::DOUBLE END AS x1,
 embedding[3]::DOUBLE AS x2, embedding[4]::DOUBLE AS x3 FROM embeddings) SELECT vec_id, round(coalesce(x0, x0f), 8) AS x0, round(coalesce(x1, x1f), 8) AS x1, round(x2, 8) AS x2, round(x3, 8) AS x3
 FROM h LEFT JOIN """ + fill_sql("x0") + " USING (vec_id) LEFT JOIN " + fill_sql("x1") + " USING (vec_id)")
def _(spark, sf):
    d = vectors(spark, sf).select("vec_id", *[F.col("embedding")[i].alias(f"x{i}") for i in range(4)])
    holed = d.withColumns({"x0": F.expr("CASE WHEN vec_id % 5 = 0 THEN NULL ELSE x0 END"), "x1": F.expr("CASE WHEN vec_id % 7 = 0 THEN NULL ELSE x1 END")})
    return rounded(N.knn_impute(holed, holed, ["x0", "x1", "x2", "x3"], "vec_id"), 8)


# ---- bootstrap and composed calibration ----------------------------------------------------
NET = {"alpha": 0.1, "l1_ratio": 0.5}


def draws_sql(stream):
    """Position drawn by each row key k and repetition rep out of n residuals: the rule of bootstrap.drawn_positions."""
    p = "2147483647"
    mixed = lambda x: f"({x} * {x} % {p} * ({x} * {x} % {p}) % {p} * {x} % {p})"
    return f"""((hi * n + lo * n // {p}) // {p}) AS pos FROM (SELECT *, {mixed('z3')} AS lo FROM (SELECT *, (hi * 69621 + x2) % {p} AS z3 FROM (SELECT *, {mixed('x3')} AS hi
 FROM (SELECT *, (x2 * 48271 + k // {p} * 16807 + rep * 69621 + {stream}) % {p} AS x3 FROM (SELECT *, {mixed('x1')} AS x2 FROM (SELECT *, (k % {p} + rep * 40503 + {stream * 7919}) % {p} AS x1"""


def bootstrap_sql(train, scored, repetitions=300, alpha=0.1, l1=0.5):
    """One-feature elastic net on the rows of ``train``, refitted per repetition; pr holds all predictions of the rows of ``scored``."""
    key = f"('0x' || substr(md5(row_id || '|{SEED}'), 1, 13))::BIGINT"
    soft = lambda c: f"sign({c}) * greatest(abs({c}) - {alpha * l1}::DOUBLE, 0) / {1 + alpha * (1 - l1)}::DOUBLE"
    return f""", bt AS (SELECT row_id, l_quantity AS q, y, {key} AS k, md5(row_id || '|{SEED}') AS h FROM {train}),
 bs AS (SELECT count(*)::BIGINT AS n, avg(q) AS mx, stddev_pop(q) AS sx, avg(y) AS my, covar_pop(q, y) / stddev_pop(q) AS c, var_pop(y) AS vy FROM bt),
 bf AS (SELECT *, {soft('c')} AS w FROM bs),
 br AS MATERIALIZED (SELECT k, n, (q - mx) / sx AS z, y - my - w * (q - mx) / sx AS e, row_number() OVER (ORDER BY h, row_id) - 1 AS pos FROM bt, bf),
 rp AS (SELECT unnest(range({repetitions}))::BIGINT AS rep),
 d0 AS (SELECT rep, z, {draws_sql(0)} FROM br, rp))))))),
 rs AS (SELECT rep, sum(br.e) AS se, sum(d0.z * br.e) AS sx FROM d0 JOIN br ON br.pos = d0.pos GROUP BY rep),
 bm AS MATERIALIZED (SELECT rep, {soft('c')} AS w, b FROM (SELECT rep, bf.w + rs.sx / n AS c, my + se / n AS b FROM rs, bf)),
 so AS (SELECT row_id, {key} AS k, n, (l_quantity - mx) / sx AS z FROM {scored}, bf),
 d1 AS (SELECT row_id, rep, z, {draws_sql(1)} FROM so, rp))))))),
 pr AS (SELECT d1.row_id, b + w * d1.z + e AS p FROM d1 JOIN br ON br.pos = d1.pos JOIN bm USING (rep))
"""


@query("residual_bootstrap_c13", Y_SQL + bootstrap_sql("(SELECT * FROM ty WHERE split = 'train')", "(SELECT * FROM ty WHERE split = 'test')") + """
 SELECT row_id, round(avg(p), 4) AS "Predicted", round(quantile_cont(p, 0.05::DOUBLE), 4) AS "Lower", round(quantile_cont(p, 0.95::DOUBLE), 4) AS "Upper" FROM pr GROUP BY 1""")
def _(spark, sf):
    d = table_of_models(spark, sf)
    boot = B.ResidualBootstrap(d.where("split = 'train'"), row_id="row_id", features=["l_quantity"], target="y", repetitions=300, **NET)
    found = boot.bounds(d.where("split = 'test'"), [0.9])
    return rounded(found.select("row_id", F.col("mean").alias("Predicted"), F.col("lower_0").alias("Lower"), F.col("upper_0").alias("Upper")), 4)


@query("residual_bootstrap_features_c13")
def _(spark, sf):
    """The same with all features; compared with numpy in the tests."""
    d = table_of_models(spark, sf)
    boot = B.ResidualBootstrap(d.where("split = 'train'"), row_id="row_id", features=FEATURES, target="y", repetitions=300, **NET)
    found = boot.bounds(d.where("split = 'test'"), [0.9])
    return rounded(found.select("row_id", F.col("mean").alias("Predicted"), F.col("lower_0").alias("Lower"), F.col("upper_0").alias("Upper")), 4)


def role_lines(spark, sf):
    d = table_of_models(spark, sf).drop("split")
    manifest = S.shared_roles(S.group_split(d, "l_suppkey", FRACTIONS, SEED))
    return S.apply_manifest(d, manifest, "l_suppkey", "role")


LEVELS = (0.5, 0.8, 0.9, 0.95)
ROLE_SQL = (Y_SQL + f""", rl AS MATERIALIZED (SELECT ty.* EXCLUDE (split), CASE g.split WHEN 'train' THEN 'train' WHEN 'validation' THEN 'calibration' ELSE 'heldout' END AS role
 FROM ty JOIN {group_split_sql('l_suppkey', 'ty')} g USING (l_suppkey))
""").replace("WITH lines", "WITH RECURSIVE lines", 1)

# The evidence loop of the Bayesian ridge for one standardised feature (its sum of squares is n), from the sums in bf.
EVIDENCE_SQL = """, ev AS (SELECT 1 AS i, n::DOUBLE AS n, n * c AS xy, n * vy AS yy, 1 / (vy + 2.220446049250313e-16::DOUBLE) AS alpha, 1.0::DOUBLE AS lam, NULL::DOUBLE AS old, false AS done FROM bf
 UNION ALL SELECT i + 1, n, xy, yy, (n - gamma + 2e-6::DOUBLE) / (sse + 2e-6::DOUBLE), lam2, w, coalesce(abs(old - w) < 1e-3::DOUBLE, false) FROM (
  SELECT *, (gamma + 2e-6::DOUBLE) / (w * w + 2e-6::DOUBLE) AS lam2, greatest(yy - 2 * w * xy + w * n * w, 0) AS sse FROM (
   SELECT *, xy / (n + lam / alpha) AS w, alpha * n / (lam + alpha * n) AS gamma FROM ev WHERE NOT done))),
 by_ AS (SELECT xy / (n + lam / alpha) AS wb, alpha AS noise, 1 / (n + lam / alpha) / alpha AS cov FROM ev WHERE done)
"""


@query("bayesian_ridge_one_feature_m4", Y_SQL.replace("WITH lines", "WITH RECURSIVE lines", 1) + """, bf AS (SELECT count(*) AS n, avg(l_quantity) AS mx, stddev_pop(l_quantity) AS sx, avg(y) AS my, covar_pop(l_quantity, y) / stddev_pop(l_quantity) AS c, var_pop(y) AS vy FROM ty WHERE split = 'train')
""" + EVIDENCE_SQL + """ SELECT row_id, round(my + wb * (l_quantity - mx) / sx, 5) AS prediction, round(sqrt(pow((l_quantity - mx) / sx, 2) * cov + 1 / noise), 6) AS prediction_sd FROM ty, bf, by_""")
def _(spark, sf):
    d = table_of_models(spark, sf)
    scored = L.score(d, L.fit_linear(d.where("split = 'train'"), ["l_quantity"], "y", "bayesian_ridge"), [], ["l_quantity"])
    return rounded(scored.select("row_id", "prediction", "prediction_sd"), 5, prediction_sd=6)


def methods_sql():
    shares = ", ".join(f"{x!r}::DOUBLE" for c in LEVELS for x in ((1 - c) / 2, 1 - (1 - c) / 2))
    rank = "least(len(s), ceil((len(s) + 1)::DOUBLE * (1 - (1 - c))))::BIGINT"
    levels = ", ".join(f"({i}, {c!r}::DOUBLE, {NormalDist().inv_cdf((1 + c) / 2)!r}::DOUBLE)" for i, c in enumerate(LEVELS))
    return ROLE_SQL + bootstrap_sql("(SELECT * FROM rl WHERE role = 'train')", "(SELECT * FROM rl WHERE role <> 'train')") + EVIDENCE_SQL + f""",
 sp AS (SELECT row_id, quantile_cont(p, [{shares}]) AS bd FROM pr GROUP BY 1),
 sc AS MATERIALIZED (SELECT row_id, role, y AS a, l_suppkey, my + w * (l_quantity - mx) / sx AS net, my + wb * (l_quantity - mx) / sx AS bay,
   greatest(sqrt(pow((l_quantity - mx) / sx, 2) * cov + 1 / noise), 1e-8::DOUBLE) AS sd, bd FROM rl JOIN sp USING (row_id), bf, by_),
 lv(i, c, nz) AS (VALUES {levels}),
 qs AS (SELECT list(abs(a - net) ORDER BY abs(a - net)) AS s, list(abs(a - bay) / sd ORDER BY abs(a - bay) / sd) AS t FROM sc WHERE role = 'calibration'),
 qb AS (SELECT i, list(u ORDER BY u) AS s FROM (SELECT i, greatest(bd[2 * i + 1] - a, a - bd[2 * i + 2], 0) AS u FROM sc, lv WHERE role = 'calibration') GROUP BY 1),
 qq AS (SELECT lv.i, c, nz, qs.s[{rank.replace('(s)', '(qs.s)')}] AS q1, qs.t[{rank.replace('(s)', '(qs.t)')}] AS q2, qb.s[{rank.replace('(s)', '(qb.s)')}] AS q3 FROM lv JOIN qb USING (i), qs),
 tb AS (SELECT 'split_conformal' AS method, 'elastic_net' AS model, c, row_id, l_suppkey, a, net AS p, net - q1 AS lo, net + q1 AS hi FROM sc, qq WHERE role = 'heldout'
   UNION ALL SELECT 'bayesian_native', 'bayesian_ridge', c, row_id, l_suppkey, a, bay, bay - nz * sd, bay + nz * sd FROM sc, qq WHERE role = 'heldout'
   UNION ALL SELECT 'bayesian_conformalized', 'bayesian_ridge', c, row_id, l_suppkey, a, bay, bay - q2 * sd, bay + q2 * sd FROM sc, qq WHERE role = 'heldout'
   UNION ALL SELECT 'bootstrap_percentile', 'elastic_net', c, row_id, l_suppkey, a, net, bd[2 * i + 1], bd[2 * i + 2] FROM sc, qq WHERE role = 'heldout'
   UNION ALL SELECT 'bootstrap_conformalized', 'elastic_net', c, row_id, l_suppkey, a, net, bd[2 * i + 1] - q3, bd[2 * i + 2] + q3 FROM sc, qq WHERE role = 'heldout'),
 iv AS (SELECT method, model, 'shared' AS evaluation_scheme, 'heldout' AS split, c AS nominal_coverage, row_id, l_suppkey, a AS Actual, p AS Predicted, a - p AS Residual, abs(a - p) AS AbsoluteError, pow(a - p, 2) AS SquaredError,
   hi - lo AS IntervalWidth, a >= lo AND a <= hi AS Covered, CASE WHEN a < lo THEN 'below_interval_overprediction' WHEN a > hi THEN 'above_interval_underprediction' ELSE 'covered' END AS MissDirection,
   hi - lo + CASE WHEN a < lo THEN (2 / (1 - c)) * (lo - a) WHEN a > hi THEN (2 / (1 - c)) * (a - hi) ELSE 0 END AS WinklerScore FROM tb)
"""


def five_methods(spark, sf):
    return CP.interval_methods(role_lines(spark, sf), row_id="row_id", features=["l_quantity"], target="y", elastic_net=NET, coverages=LEVELS, repetitions=300, carry=["l_suppkey"])


# Widths and errors are compared to six digits before they are ranked, as equal ones may differ in the last bit between engines.
@query("interval_methods_c15", methods_sql() + f""", rk AS (SELECT *, rank() OVER (PARTITION BY method, nominal_coverage ORDER BY round(IntervalWidth, 6)) + (count(*) OVER (PARTITION BY method, nominal_coverage, round(IntervalWidth, 6)) - 1) / 2.0::DOUBLE AS rw,
   rank() OVER (PARTITION BY method, nominal_coverage ORDER BY round(AbsoluteError, 6)) + (count(*) OVER (PARTITION BY method, nominal_coverage, round(AbsoluteError, 6)) - 1) / 2.0::DOUBLE AS re FROM iv)
 SELECT {KEYS}, n_rows, {round_sql(INTERVAL_COLUMNS, 4)}, round(rho, 4) + 0.0 AS UncertaintyErrorSpearman FROM (SELECT {KEYS}, {INTERVAL_SQL.replace('0.9::DOUBLE', 'nominal_coverage')},
  CASE WHEN method <> 'split_conformal' THEN corr(rw, re) END AS rho FROM rk GROUP BY {KEYS})""")
def _(spark, sf):
    from tabcal.operators.calibrate import METRIC_KEYS, interval_metrics

    out = five_methods(spark, sf).withColumns({c: F.round(c, 6) for c in ("IntervalWidth", "AbsoluteError")})
    needed = ["Actual", "Predicted", "Residual", "AbsoluteError", "SquaredError", "IntervalWidth", "Covered", "MissDirection", "WinklerScore"]
    return rounded(interval_metrics(written(out.select(*METRIC_KEYS, *needed))), 4)


@query("coverage_curve_c15", methods_sql() + """ SELECT method, nominal_coverage, count(*) AS n_rows, round(avg(Covered::INT), 4) AS "EmpiricalCoverage", round(avg(IntervalWidth), 4) AS "MeanIntervalWidth" FROM iv GROUP BY 1, 2""")
def _(spark, sf):
    return rounded(CP.coverage_curve(five_methods(spark, sf)), 4)


@query("held_out_calibration_c16", Y_SQL + """, mk AS (SELECT *, l_suppkey % 7 = 0 AS cal FROM ty),
 g AS (SELECT l_suppkey, count(*)::DOUBLE n, sum(l_quantity) sx, sum(y) sy, sum(l_quantity * l_quantity) sxx, sum(l_quantity * y) sxy FROM mk WHERE NOT cal GROUP BY 1),
 t AS (SELECT l_suppkey, sum(n) OVER () - n AS n, sum(sx) OVER () - sx AS sx, sum(sy) OVER () - sy AS sy, sum(sxx) OVER () - sxx AS sxx, sum(sxy) OVER () - sxy AS sxy, n AS own FROM g),
 w AS (SELECT l_suppkey, (sxy - sx * sy / n) / (sxx - sx * sx / n) AS b, sy / n - (sxy - sx * sy / n) / (sxx - sx * sx / n) * sx / n AS a FROM t WHERE own >= 5),
 sc AS (SELECT w.l_suppkey, abs(y - a - b * l_quantity) AS s FROM mk, w WHERE cal),
 q AS (SELECT l_suppkey, s AS q_hat FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY s) k, count(*) OVER (PARTITION BY l_suppkey) n FROM sc) WHERE k = least(n, ceil((n + 1)::DOUBLE * (1 - (1 - 0.9::DOUBLE))))::BIGINT)
 SELECT l_suppkey, count(*) AS n_rows, round(avg((abs(y - a - b * l_quantity) <= q_hat)::INT), 6) AS coverage, round(avg(2 * q_hat), 5) AS width FROM mk JOIN w USING (l_suppkey) JOIN q USING (l_suppkey) GROUP BY 1""")
def _(spark, sf):
    d = table_of_models(spark, sf)
    out = CP.held_out_conformal(d, row_id="row_id", group="l_suppkey", features=["l_quantity"], target="y", kind="ols", coverage=0.9, minimum_rows=5, calibration="l_suppkey % 7 = 0")
    return rounded(out.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n_rows"), F.avg(F.col("Covered").cast("double")).alias("coverage"), F.avg("IntervalWidth").alias("width")), 6, width=5)


@query("held_out_tree_calibration_c16", Y_SQL.replace("ty AS (", "ta AS (", 1) + """, mk AS (SELECT *, l_suppkey % 7 = 0 AS cal FROM ta), ty AS (SELECT * FROM mk WHERE NOT cal)""" + stump_sql("ty", 5) + f""",
 sc AS (SELECT st.l_suppkey, abs(y - ({STUMP})) AS s FROM mk, st WHERE cal),
 q AS (SELECT l_suppkey, s AS q_hat FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY s) k, count(*) OVER (PARTITION BY l_suppkey) n FROM sc) WHERE k = least(n, ceil((n + 1)::DOUBLE * (1 - (1 - 0.9::DOUBLE))))::BIGINT)
 SELECT l_suppkey, count(*) AS n_rows, round(avg((abs(y - ({STUMP})) <= q_hat)::INT), 6) AS coverage, round(avg(2 * q_hat), 5) AS width FROM ty JOIN st USING (l_suppkey) JOIN q USING (l_suppkey) GROUP BY 1""")
def _(spark, sf):
    d = table_of_models(spark, sf)
    out = CP.held_out_conformal(d, row_id="row_id", group="l_suppkey", features=STUMP_FEATURES, target="y", kind="stumps", coverage=0.9, minimum_rows=5,
                                calibration="l_suppkey % 7 = 0", rounds=1, rate=1.0, bins=STUMP_BINS)
    return rounded(out.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n_rows"), F.avg(F.col("Covered").cast("double")).alias("coverage"), F.avg("IntervalWidth").alias("width")), 6, width=5)


# ---- composed preprocessing ----------------------------------------------------------------
PREPARED = ["row_id", "split", "fold", "y", "amount", "discount", "l_tax", "kind", "l_suppkey", "l_linenumber"]


def preprocessor():
    return E.TablePreprocessor(numeric=["amount", "discount", "l_tax"], one_hot_columns=["kind"], encoded=["l_suppkey"], grouped=["l_linenumber"], indicators=True, target="y", folds=3)


NUMBERS = ("amount", "discount", "l_tax")
COMPOSED_SQL = Y_SQL + f""", fo AS MATERIALIZED (SELECT *, ('0x' || substr(md5(l_suppkey || '|{SEED}'), 1, 8))::BIGINT % 3 AS fold FROM ty),
 slots AS (SELECT unnest(range(4)) AS slot), ov AS MATERIALIZED (SELECT slot, avg(y) m, var_pop(y) v FROM fo, slots WHERE split = 'train' AND fold <> slot GROUP BY 1),
 ct AS MATERIALIZED (SELECT slot, l_suppkey, count(*) n, avg(y) m, var_pop(y) v FROM fo, slots WHERE split = 'train' AND fold <> slot GROUP BY 1, 2),
 md AS MATERIALIZED (SELECT {", ".join(f"median({c}) AS m_{c}" for c in NUMBERS)} FROM fo WHERE split = 'train'),
 te AS MATERIALIZED (SELECT r.*, CASE WHEN ct.n IS NULL THEN ov.m ELSE ct.n / (ct.n + ct.v / ov.v) * ct.m + (1 - ct.n / (ct.n + ct.v / ov.v)) * ov.m END AS x, {", ".join(f"coalesce({c}, m_{c}) AS f_{c}" for c in NUMBERS)}
   FROM (SELECT *, CASE WHEN split = 'train' THEN fold ELSE 3 END AS slot FROM fo) r JOIN ov ON ov.slot = r.slot LEFT JOIN ct ON ct.slot = r.slot AND ct.l_suppkey = r.l_suppkey, md),
 un AS MATERIALIZED (SELECT avg(x) AS cx, stddev_pop(x) AS ux, {", ".join(f"avg(f_{c}) AS c_{c}, stddev_pop(f_{c}) AS u_{c}" for c in NUMBERS)} FROM te WHERE split = 'train')
 SELECT row_id, round((x - cx) / ux, 5) + 0.0 AS l_suppkey_encoded,
 {", ".join(f"round((f_{c} - c_{c}) / u_{c}, 5) + 0.0 AS {c}" for c in NUMBERS)}, (amount IS NULL)::DOUBLE AS amount_missing, (discount IS NULL)::DOUBLE AS discount_missing,
 {", ".join(f"(coalesce(kind, 'missing_reported_gap') = '{v}')::DOUBLE AS " + '"kind=' + v + '"' for v in ("A", "N", "R", "missing_reported_gap"))},
 {", ".join(f"(l_linenumber = {i})::DOUBLE AS " + '"l_linenumber=' + str(i) + '"' for i in range(1, 8))} FROM te, un"""


def recipe():
    return PP.Recipe(numeric=NUMBERS, one_hot=("kind",), grouped=("l_linenumber",), encoded=("l_suppkey",), indicators=True, target="y", folds=3)


@query("fitted_preprocessor_e11", COMPOSED_SQL + " WHERE split <> 'train'")
def _(spark, sf):
    """Fitted on training rows, saved, loaded again and applied to rows it never saw."""
    d = stored(folded(spark, sf), *PREPARED)
    path = WR.scratch_path(spark, "preprocessor")
    PP.Preprocessor(recipe()).fit(d).save(path)
    model = PP.PreprocessorModel.load(spark, path)
    out = model.transform(d.where("split <> 'train'"))
    return rounded(out.select("row_id", *[F.col(f"`{c}`") for c in model.output_columns]), 5)


@query("fitted_preprocessor_training_e11", COMPOSED_SQL + " WHERE split = 'train'")
def _(spark, sf):
    d = stored(folded(spark, sf), *PREPARED)
    model = PP.Preprocessor(recipe()).fit(d)
    out = model.transform_training(d.where("split = 'train'"))
    return rounded(out.select("row_id", *[F.col(f"`{c}`") for c in model.output_columns]), 5)


@query("composed_preprocessor_e11", COMPOSED_SQL)
def _(spark, sf):
    p = preprocessor()
    out = p.fit_transform(stored(folded(spark, sf), *PREPARED))
    return rounded(out.select("row_id", *[F.col(f"`{c}`") for c in p.output_columns]), 5)


@query("expansion_audit_a28", """SELECT 6::BIGINT AS input_columns, 3::BIGINT AS numeric_columns, 2::BIGINT AS one_hot_inputs, 1::BIGINT AS encoded_columns,
 4 + (SELECT count(DISTINCT l_linenumber) FROM lineitem) AS one_hot_outputs, 4 + (SELECT count(DISTINCT l_linenumber) FROM lineitem) + 6 AS output_columns""")
def _(spark, sf):
    p = preprocessor()
    return p.expansion_audit(p.fit_transform(stored(folded(spark, sf), *PREPARED)))


@query("preprocessing_summary_a31", SPLIT_LINES + "SELECT 'full' AS policy, split, count(*) AS n_rows, 0::BIGINT AS nulls_remaining, 17::BIGINT AS output_columns FROM sl GROUP BY split")
def _(spark, sf):
    p = preprocessor()
    out = p.fit_transform(stored(folded(spark, sf), *PREPARED))
    return CS.preprocessing_summary({"full": out}, p.output_columns)


@query("policy_runner_e13", SPLIT_LINES + """, v AS (SELECT * FROM sl WHERE amount IS NOT NULL) SELECT policy, split, count(*) AS n_rows FROM v, (SELECT unnest(['full_raw', 'policy_50', 'policy_20']) AS policy) GROUP BY 1, 2""")
def _(spark, sf):
    d = CS.prepare(lines(spark, sf), target="amount", numeric=["discount", "sparse"])
    _, reports = CS.run_policies(d, {"full_raw": None, "policy_50": 0.5, "policy_20": 0.2}, row_id="row_id", group="l_suppkey", target="amount",
                                 features=["kind", "discount", "status", "sparse", "empty"], pairs=[("discount", "discount", "status")], fractions=FRACTIONS, seed=SEED)
    return reports["split_summary"].select("policy", "split", "n_rows")


# ---- sources and sinks ---------------------------------------------------------------------
@query("split_sink_io6", SPLIT_LINES + "SELECT row_id, l_suppkey, amount, split FROM sl")
def _(spark, sf):
    path = WR.scratch_path(spark, "splits")
    WR.save_splits(split_lines(spark, sf).select("row_id", "l_suppkey", "amount", "split"), path, "split")
    return spark.read.parquet(path)


@query("split_source_io7", SPLIT_LINES + "SELECT row_id, amount, split FROM sl WHERE split = 'validation'")
def _(spark, sf):
    path = WR.scratch_path(spark, "splits")
    WR.save_splits(split_lines(spark, sf).select("row_id", "amount", "split"), path, "split")
    return RD.load_split(spark, path, "validation")


@query("csv_source_io1", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def _(spark, sf):
    path = WR.scratch_path(spark, "report")
    d = table(spark, sf, "supplier")
    WR.save_report(d, [path])
    return RD.load_table(spark, path, fmt="csv", schema=d.schema)


@query("multi_header_source_io2", "SELECT o_orderkey::DOUBLE AS order_id, o_totalprice AS price, o_orderpriority AS priority FROM orders")
def _(spark, sf):
    path = WR.scratch_path(spark, "raw")
    WR.save_report(table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus"), [path])
    raw = RD.read_multi_header(spark, path, header_rows=1, names=["order_id", "price", "priority", "status"], drop=["status"])
    return repair_types(raw, ["order_id", "price", "priority"])


@query("flattened_header_io3", "SELECT s_suppkey::VARCHAR AS \"s suppkey\", s_name AS \"s name\", s_acctbal AS \"s acctbal\" FROM supplier")
def _(spark, sf):
    path = WR.scratch_path(spark, "raw")
    named = table(spark, sf, "supplier").select(F.col("s_suppkey").alias(" s  suppkey"), F.col("s_name").alias("s name "), F.col("s_acctbal").alias("s\tacctbal"))
    WR.save_report(named, [path])
    return repair_types(RD.read_multi_header(spark, path, header_rows=1), ["s acctbal"])


@query("report_append_io8", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def _(spark, sf):
    counts = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    first, both = WR.scratch_path(spark, "results"), WR.scratch_path(spark, "results")
    counts.where("o_orderpriority < '3'").write.parquet(first)
    return WR.append_report(counts, first, both, ["o_orderpriority", "n"])


@query("file_fingerprints_io9")
def _(spark, sf):
    return RD.file_fingerprints(spark, sf)


@query("model_round_trip_io10", Y_SQL + """, m AS (SELECT regr_slope(y, l_quantity) AS b, regr_intercept(y, l_quantity) AS a FROM ty WHERE split = 'train')
 SELECT row_id, round(a + b * l_quantity, 5) AS prediction FROM ty, m""")
def _(spark, sf):
    from pyspark.ml.regression import LinearRegressionModel

    d = assembled(table_of_models(spark, sf), ["l_quantity"])
    path = WR.scratch_path(spark, "model")
    WR.save_model(M.ols("features", "y").fit(d.where("split = 'train'")), path)
    return rounded(LinearRegressionModel.load(path).transform(d).select("row_id", "prediction"), 5)
