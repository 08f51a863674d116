"""Metrics, sub-group errors, encoders, conformal intervals and coverage tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabcal.catalog.base import LINES, METRIC_ROUND, METRIC_SQL, PRED, SPLIT_LINES, lines, predictions, query, r, round_sql, rounded, table
from tabcal.catalog.columns import split_lines
from tabcal.functions.features import right_closed_bin
from tabcal.functions.rules import usage_group
from tabcal.operators import calibrate as K, encode as E, evaluate as V
from tabcal.operators.scale import attach
from tabcal.session import written

TRAIN = "split = 'train'"


# ---- metrics -------------------------------------------------------------------------------
@query("prediction_table_a0", PRED + "SELECT policy, experiment, exploratory, model, split, row_id, Actual, Predicted, Residual, AbsoluteError, SquaredError FROM pr")
def _(spark, sf):
    return predictions(spark, sf).select("policy", "experiment", "exploratory", "model", "split", "row_id", "Actual", "Predicted", "Residual", "AbsoluteError", "SquaredError")


@query("regression_metrics_a1", PRED + f"SELECT model, l_suppkey, {METRIC_ROUND} FROM (SELECT model, l_suppkey, {METRIC_SQL} FROM pr GROUP BY 1, 2)")
def _(spark, sf):
    return rounded(V.regression_metrics(predictions(spark, sf), ["model", "l_suppkey"]))


@query("metrics_row_a2", PRED + f"SELECT policy, experiment, exploratory, model, split, {METRIC_ROUND} FROM (SELECT policy, experiment, exploratory, model, split, {METRIC_SQL} FROM pr GROUP BY ALL)")
def _(spark, sf):
    return rounded(V.regression_metrics(predictions(spark, sf), ["policy", "experiment", "exploratory", "model", "split"], bounded=True))


GROUP_METRICS = """count(*) AS n_rows, round(avg(AbsoluteError), 5) AS MAE, round(sqrt(avg(SquaredError)), 5) AS RMSE, round(avg(Residual), 5) + 0.0 AS Bias, round(median(AbsoluteError), 5) AS MedianAE,
 round(avg(Actual), 5) AS ActualMean, round(avg(Predicted), 5) AS PredictedMean FROM pr GROUP BY 1"""


@query("errors_by_usage_a3", PRED + "SELECT model || '/' || CASE WHEN amount IS NOT NULL AND discount IS NOT NULL AND amount + discount = 0 THEN 'no_fiber_reported' WHEN amount > 0 OR discount > 0 THEN 'fiber_used' ELSE 'fiber_amount_unknown' END AS usage_group, " + GROUP_METRICS)
def _(spark, sf):
    used = usage_group([F.col("amount"), F.col("discount")])
    return rounded(V.errors_by_group(predictions(spark, sf), F.concat_ws("/", "model", used), "usage_group"), 5)


@query("errors_by_bin_a3", PRED + "SELECT model || '/' || CASE WHEN Actual / 43 <= 120 THEN '<=120' WHEN Actual / 43 <= 150 THEN '120-150' WHEN Actual / 43 <= 180 THEN '150-180' WHEN Actual / 43 > 180 THEN '>180' ELSE 'nan' END AS strength_bin, " + GROUP_METRICS)
def _(spark, sf):
    return rounded(V.errors_by_group(predictions(spark, sf), F.concat_ws("/", "model", right_closed_bin(F.col("Actual") / 43)), "strength_bin"), 5)


@query("errors_by_supplier_a3", PRED + "SELECT model || '/' || l_suppkey::VARCHAR AS publication, " + GROUP_METRICS)
def _(spark, sf):
    return rounded(V.errors_by_group(predictions(spark, sf), F.concat_ws("/", "model", F.col("l_suppkey").cast("string")), "publication"), 5)


SEEDS = PRED + ", sd AS (SELECT model, l_returnflag AS seed, avg(AbsoluteError) AS MAE, sqrt(avg(SquaredError)) AS RMSE FROM pr GROUP BY 1, 2) "


@query("over_seeds_a21", SEEDS + "SELECT model, count(*) AS runs, round(avg(MAE), 5) AS MAE_mean, round(stddev_samp(MAE), 5) AS MAE_std, round(avg(RMSE), 5) AS RMSE_mean, round(stddev_samp(RMSE), 5) AS RMSE_std FROM sd GROUP BY 1")
def _(spark, sf):
    m = predictions(spark, sf).groupBy("model", F.col("l_returnflag").alias("seed")).agg(F.avg("AbsoluteError").alias("MAE"), F.sqrt(F.avg("SquaredError")).alias("RMSE"))
    return rounded(V.over_seeds(m, ["model"], ["MAE", "RMSE"]), 5)


FOLD_SQL = PRED + f""", fm AS (SELECT model, l_suppkey, {METRIC_SQL}, max(AbsoluteError) AS MaximumAE,
 CASE WHEN avg(Residual) > 0 THEN 'underprediction' ELSE 'overprediction' END AS direction FROM pr GROUP BY 1, 2)
"""


def fold_metrics(spark, sf):
    return V.regression_metrics(predictions(spark, sf), ["model", "l_suppkey"], extra=V.fold_extras())


@query("fold_metrics_m16", PRED + f"""SELECT model, l_suppkey, {METRIC_ROUND}, {round_sql(['MaximumAE', 'target_mean', 'target_min', 'target_max', 'worst_row_squared_error_share'])}, dominant_residual_direction FROM (
 SELECT model, l_suppkey, {METRIC_SQL}, max(AbsoluteError) AS MaximumAE, avg(Actual) AS target_mean, min(Actual) AS target_min, max(Actual) AS target_max,
 max(SquaredError) / sum(SquaredError) AS worst_row_squared_error_share, CASE WHEN avg(Residual) > 0 THEN 'underprediction' ELSE 'overprediction' END AS dominant_residual_direction FROM pr GROUP BY 1, 2)""")
def _(spark, sf):
    return rounded(fold_metrics(spark, sf))


@query("fold_summary_a22", FOLD_SQL + "SELECT model, count(*) AS folds, " + ", ".join(
    f"round(avg({c}), 5) + 0.0 AS {c}_mean, round(stddev_samp({c}), 5) AS {c}_std, round(median({c}), 5) + 0.0 AS {c}_median" for c in ("MAE", "RMSE", "R2")) + " FROM fm GROUP BY 1")
def _(spark, sf):
    return rounded(V.fold_summary(fold_metrics(spark, sf), ["model"]), 5)


@query("direction_counts_a22", FOLD_SQL + "SELECT model, count(*) FILTER (direction = 'overprediction') AS overprediction, count(*) FILTER (direction = 'underprediction') AS underprediction FROM fm GROUP BY 1")
def _(spark, sf):
    p = predictions(spark, sf).groupBy("model", "l_suppkey").agg(*V.fold_extras())
    return V.direction_counts(p, ["model"])


MM = ["MAE", "RMSE", "R2", "Bias", "MedianAE", "MaximumAE"]


@query("micro_macro_a23", FOLD_SQL + f"""SELECT 'micro_all_rows' AS aggregation, model, n_groups, n_rows, {round_sql(MM, 5)} FROM (SELECT model, count(DISTINCT l_suppkey) AS n_groups, {METRIC_SQL}, max(AbsoluteError) AS MaximumAE FROM pr GROUP BY 1)
 UNION ALL SELECT 'macro_equal_group_weight', model, count(*), sum(n_rows)::BIGINT, {", ".join(f"round(avg({c}), 5) + 0.0" for c in MM)} FROM fm GROUP BY model""")
def _(spark, sf):
    return rounded(V.micro_macro(predictions(spark, sf), ["model"], "l_suppkey"), 5)


@query("held_out_shift_a24", LINES + """, n AS (SELECT l_suppkey, 'l_extendedprice' AS c, l_extendedprice AS v FROM lines UNION ALL SELECT l_suppkey, 'ratio', CASE WHEN l_orderkey % 2 = 0 THEN l_quantity * l_suppkey END FROM lines),
 g AS (SELECT l_suppkey, c, min(v) mn, max(v) mx FROM n WHERE v IS NOT NULL GROUP BY 1, 2),
 b AS (SELECT a.l_suppkey, a.c, min(o.mn) mn, max(o.mx) mx FROM g a JOIN g o ON o.c = a.c AND o.l_suppkey <> a.l_suppkey GROUP BY 1, 2),
 nr AS (SELECT l_suppkey, avg((v < mn OR v > mx)::INT) AS nrate FROM n JOIN b USING (l_suppkey, c) WHERE v IS NOT NULL GROUP BY 1),
 t AS (SELECT l_suppkey, 'l_orderkey' AS c, l_orderkey::VARCHAR AS v FROM lines UNION ALL SELECT l_suppkey, 'kind', kind FROM lines WHERE kind IS NOT NULL),
 u AS (SELECT c, v, count(DISTINCT l_suppkey) AS s FROM t GROUP BY 1, 2),
 cr AS (SELECT l_suppkey, avg((s = 1)::INT) AS crate FROM t JOIN u USING (c, v) GROUP BY 1)
 SELECT l_suppkey, round(nrate, 9) AS numeric_out_of_training_range_rate, round(crate, 9) AS unseen_category_rate FROM nr JOIN cr USING (l_suppkey)""")
def _(spark, sf):
    d = lines(spark, sf).withColumn("ratio", F.expr("CASE WHEN l_orderkey % 2 = 0 THEN l_quantity * l_suppkey END"))
    return rounded(V.held_out_shift(d, "l_suppkey", ["l_extendedprice", "ratio"], ["l_orderkey", "kind"]), 9)


@query("experiment_delta_a26", PRED + f""", m AS (SELECT CASE WHEN l_tax > 0.04 THEN 'high' ELSE 'low' END AS experiment, model, split, avg(AbsoluteError) AS MAE, sqrt(avg(SquaredError)) AS RMSE FROM pr GROUP BY 1, 2, 3)
 SELECT model, split, {", ".join(f"round(max({c}) FILTER (experiment = 'low'), 5) AS {c}_reference, round(max({c}) FILTER (experiment = 'high'), 5) AS {c}_challenger, round(max({c}) FILTER (experiment = 'high') - max({c}) FILTER (experiment = 'low'), 5) + 0.0 AS {c}_delta" for c in ("MAE", "RMSE"))} FROM m GROUP BY 1, 2""")
def _(spark, sf):
    m = predictions(spark, sf).groupBy(F.when(F.col("l_tax") > 0.04, "high").otherwise("low").alias("experiment"), "model", "split").agg(
        F.avg("AbsoluteError").alias("MAE"), F.sqrt(F.avg("SquaredError")).alias("RMSE"))
    return rounded(V.experiment_delta(m, "low", "high", ["MAE", "RMSE"]), 5)


POLICY = PRED + """, m AS (SELECT model, split, l_returnflag AS policy, sqrt(avg(SquaredError)) AS RMSE FROM pr GROUP BY 1, 2, 3) """


def policy_metrics(spark, sf):
    return predictions(spark, sf).drop("policy").groupBy("model", "split", F.col("l_returnflag").alias("policy")).agg(F.sqrt(F.avg("SquaredError")).alias("RMSE"))


@query("policy_sensitivity_a27", POLICY + """, v AS (SELECT model, arg_min(policy, RMSE) AS bp, min(RMSE) AS br, count(DISTINCT policy) > 1 AS comparison_available FROM m WHERE split = 'validation' GROUP BY 1),
 t AS (SELECT model, arg_min(policy, RMSE) AS tp, min(RMSE) AS tr FROM m WHERE split = 'test' GROUP BY 1)
 SELECT v.model, comparison_available, bp AS best_validation_policy, round(br, 5) AS best_validation_RMSE, round(m.RMSE, 5) AS test_RMSE_for_best_validation_policy, tp AS best_test_policy, round(tr, 5) AS best_test_RMSE
 FROM v JOIN t USING (model) JOIN m ON m.model = v.model AND m.policy = v.bp AND m.split = 'test'""")
def _(spark, sf):
    return rounded(V.policy_sensitivity(policy_metrics(spark, sf)), 5)


@query("bucket_pivot_a29", PRED + "SELECT model, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'validation') AS validation, count(*) FILTER (split = 'test') AS test FROM pr GROUP BY 1")
def _(spark, sf):
    return V.pivot_counts(predictions(spark, sf), "model", "split", ["train", "validation", "test"])


@query("metric_pivot_a29", POLICY + "SELECT policy, round(avg(RMSE) FILTER (model = 'flat'), 5) AS flat, round(avg(RMSE) FILTER (model = 'taxed'), 5) AS taxed FROM m GROUP BY 1")
def _(spark, sf):
    return rounded(V.pivot_means(policy_metrics(spark, sf), "policy", "model", ["flat", "taxed"], "RMSE"), 5)


@query("best_model_o3", POLICY + "SELECT split, model, policy, round(RMSE, 5) AS RMSE FROM m QUALIFY row_number() OVER (PARTITION BY split ORDER BY RMSE, model) = 1")
def _(spark, sf):
    return rounded(V.best_row(policy_metrics(spark, sf), "RMSE", "model", keys=["split"]), 5)


@query("worst_across_models_o4", PRED + """SELECT row_id, round(residual_flat, 6) AS residual_flat, round(residual_taxed, 6) AS residual_taxed, round((abs(residual_flat) + abs(residual_taxed)) / 2, 6) AS mean_absolute_residual,
 sign(residual_flat) = sign(residual_taxed) AS same_direction FROM (SELECT row_id, max(Residual) FILTER (model = 'flat') AS residual_flat, max(Residual) FILTER (model = 'taxed') AS residual_taxed FROM pr GROUP BY 1)
 ORDER BY (abs(residual_flat) + abs(residual_taxed)) / 2 DESC, row_id LIMIT 10""")
def _(spark, sf):
    return rounded(V.worst_across_models(predictions(spark, sf), ["flat", "taxed"]))


@query("strategy_gaps_m15", PRED + """, m AS (SELECT model, split AS strategy, sqrt(avg(SquaredError)) AS RMSE, avg(AbsoluteError) AS MAE, 1 - sum(SquaredError) / (var_pop(Actual) * count(*)) AS R2 FROM pr GROUP BY 1, 2)
 SELECT model, strategy, round(m.RMSE, 5) AS RMSE, round(m.MAE, 5) AS MAE, round(m.R2, 7) AS R2, round(m.RMSE - b.RMSE, 5) + 0.0 AS RMSE_gap, round(m.MAE - b.MAE, 5) + 0.0 AS MAE_gap, round(m.R2 - b.R2, 7) + 0.0 AS R2_gap
 FROM m JOIN (SELECT * FROM m WHERE strategy = 'train') b USING (model)""".replace("model, strategy, round", "model, m.strategy, round"))
def _(spark, sf):
    m = V.regression_metrics(predictions(spark, sf), ["model", "split"], bounded=True).select("model", F.col("split").alias("strategy"), "RMSE", "MAE", "R2")
    return rounded(V.strategy_gaps(m, ["model"], "strategy", "train"), 5, R2=7, R2_gap=7)


# ---- encoders ------------------------------------------------------------------------------
@query("median_impute_e1", SPLIT_LINES + """, s AS (SELECT median(amount) a, median(discount) d FROM sl WHERE split = 'train')
 SELECT row_id, coalesce(amount, a) AS amount, round(coalesce(discount, d), 6) AS discount FROM sl, s""")
def _(spark, sf):
    d = split_lines(spark, sf).select("row_id", "split", "amount", "discount")
    return rounded(E.impute(d, d.where(TRAIN), ["amount", "discount"], "median").drop("split"))


@query("mean_impute_e2", SPLIT_LINES + """, s AS (SELECT avg(amount) a, avg(discount) d FROM sl WHERE split = 'train')
 SELECT row_id, round(coalesce(amount, a), 6) AS amount, round(coalesce(discount, d), 8) AS discount FROM sl, s""")
def _(spark, sf):
    d = split_lines(spark, sf).select("row_id", "split", "amount", "discount")
    return rounded(E.impute(d, d.where(TRAIN), ["amount", "discount"], "mean").drop("split"), 6, discount=8)


@query("missing_indicators_e3", SPLIT_LINES + "SELECT row_id, amount, l_tax, (amount IS NULL)::DOUBLE AS amount_missing FROM sl")
def _(spark, sf):
    d = split_lines(spark, sf).select("row_id", "split", "amount", "l_tax")
    return E.missing_indicators(d, d.where(TRAIN), ["amount", "l_tax"]).drop("split")


@query("standardise_e5", SPLIT_LINES + """, s AS (SELECT avg(amount) a, stddev_pop(amount) b, avg(l_extendedprice) c, stddev_pop(l_extendedprice) d FROM sl WHERE split = 'train')
 SELECT row_id, round((amount - a) / b, 7) + 0.0 AS amount, round((l_extendedprice - c) / d, 7) + 0.0 AS l_extendedprice, 0.0::DOUBLE AS one FROM sl, s""")
def _(spark, sf):
    d = split_lines(spark, sf).select("row_id", "split", "amount", "l_extendedprice", F.lit(1.0).alias("one"))
    return rounded(E.standardize(d, d.where(TRAIN), ["amount", "l_extendedprice", "one"]).drop("split"), 7)


@query("robust_scale_e6", SPLIT_LINES + """, s AS (SELECT median(amount) a, quantile_cont(amount, 0.75) - quantile_cont(amount, 0.25) b, median(l_extendedprice) c, quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25) d FROM sl WHERE split = 'train')
 SELECT row_id, round((amount - a) / b, 7) + 0.0 AS amount, round((l_extendedprice - c) / d, 7) + 0.0 AS l_extendedprice FROM sl, s""")
def _(spark, sf):
    d = split_lines(spark, sf).select("row_id", "split", "amount", "l_extendedprice")
    return rounded(E.robust_scale(d, d.where(TRAIN), ["amount", "l_extendedprice"]).drop("split"), 7)


@query("min_max_scale_e6", SPLIT_LINES + """, s AS (SELECT min(amount) a, max(amount) b, min(l_extendedprice) c, max(l_extendedprice) d FROM sl WHERE split = 'train')
 SELECT row_id, round((amount - a) / (b - a), 7) AS amount, round((l_extendedprice - c) / (d - c), 7) + 0.0 AS l_extendedprice FROM sl, s""")
def _(spark, sf):
    d = split_lines(spark, sf).select("row_id", "split", "amount", "l_extendedprice")
    return rounded(E.min_max_scale(d, d.where(TRAIN), ["amount", "l_extendedprice"]).drop("split"), 7)


HOT = """SELECT row_id, (coalesce(kind, 'missing_reported_gap') = 'A')::DOUBLE AS "kind=A", (coalesce(kind, 'missing_reported_gap') = 'N')::DOUBLE AS "kind=N",
 (coalesce(kind, 'missing_reported_gap') = 'R')::DOUBLE AS "kind=R", (coalesce(kind, 'missing_reported_gap') = 'missing_reported_gap')::DOUBLE AS "kind=missing_reported_gap" FROM sl"""


@query("one_hot_e7", SPLIT_LINES + HOT)
def _(spark, sf):
    d = split_lines(spark, sf).select("row_id", "split", "kind")
    return E.one_hot(d, E.train_categories(d.where(TRAIN), ["kind"])).drop("split")


@query("dummies_e7", SPLIT_LINES + HOT.replace("""(coalesce(kind, 'missing_reported_gap') = 'A')::DOUBLE AS "kind=A", """, ""))
def _(spark, sf):
    d = split_lines(spark, sf).select("row_id", "split", "kind")
    return E.one_hot(d, E.train_categories(d.where(TRAIN), ["kind"], drop_first=True)).drop("split")


@query("rare_categories_e8", SPLIT_LINES + """, c AS (SELECT l_partkey::VARCHAR AS v, count(*) n FROM sl WHERE split = 'train' GROUP BY 1),
 k AS (SELECT v FROM (SELECT v, n, row_number() OVER (ORDER BY n DESC, v DESC) rk, count(*) OVER () f FROM c WHERE n >= 10)
   WHERE rk <= CASE WHEN f + CASE WHEN (SELECT count(*) FROM c) > f THEN 1 ELSE 0 END > 20 THEN 19 ELSE f END)
 SELECT row_id, CASE WHEN l_partkey::VARCHAR IN (SELECT v FROM k) THEN l_partkey::VARCHAR WHEN (SELECT count(*) FROM c) > (SELECT count(*) FROM k) THEN '__infrequent__' END AS label FROM sl""")
def _(spark, sf):
    d = split_lines(spark, sf).select("row_id", "split", F.col("l_partkey").cast("string").alias("label"))
    return E.group_rare(d, E.rare_category_map(d.where(TRAIN), ["label"]), ["label"]).drop("split")


ENCODE = SPLIT_LINES + """, f AS (SELECT *, ('0x' || substr(md5(row_id || '|42'), 1, 8))::BIGINT % 5 AS fold, l_suppkey::VARCHAR AS cat FROM sl),
 slots AS (SELECT unnest(range(6)) AS slot),
 ov AS (SELECT slot, avg(l_extendedprice) m, var_pop(l_extendedprice) v FROM f, slots WHERE split = 'train' AND fold <> slot GROUP BY 1),
 ct AS (SELECT slot, cat, count(*) n, avg(l_extendedprice) m, var_pop(l_extendedprice) v FROM f, slots WHERE split = 'train' AND fold <> slot GROUP BY 1, 2)
 SELECT row_id, split, round(CASE WHEN ct.n IS NULL THEN ov.m ELSE ct.n / (ct.n + ct.v / ov.v) * ct.m + (1 - ct.n / (ct.n + ct.v / ov.v)) * ov.m END, 4) AS encoded
 FROM (SELECT *, CASE WHEN split = 'train' THEN fold ELSE 5 END AS slot FROM f) r JOIN ov ON ov.slot = r.slot LEFT JOIN ct ON ct.slot = r.slot AND ct.cat = r.cat"""


@query("target_encoding_e9", ENCODE)
def _(spark, sf):
    from tabcal.operators.splits import row_folds

    d = row_folds(split_lines(spark, sf), "row_id", 5, 42).select("row_id", "split", "fold", "l_suppkey", "l_extendedprice")
    out = E.target_encode(d, column="l_suppkey", target="l_extendedprice", train=TRAIN, fold="fold", folds=5, out="encoded")
    return rounded(out.select("row_id", "split", "encoded"), 4)


@query("scaled_encoding_e10", SPLIT_LINES + """, ov AS (SELECT avg(l_extendedprice) m, var_pop(l_extendedprice) v FROM sl WHERE split = 'train'),
 ct AS (SELECT l_suppkey, count(*) n, avg(l_extendedprice) m, var_pop(l_extendedprice) v FROM sl WHERE split = 'train' GROUP BY 1),
 e AS (SELECT row_id, split, (l_returnflag = 'A')::DOUBLE AS hot, CASE WHEN ct.n IS NULL THEN ov.m ELSE ct.n / (ct.n + ct.v / ov.v) * ct.m + (1 - ct.n / (ct.n + ct.v / ov.v)) * ov.m END AS x FROM sl LEFT JOIN ct USING (l_suppkey), ov)
 SELECT row_id, hot, round((x - (SELECT avg(x) FROM e WHERE split = 'train')) / (SELECT stddev_pop(x) FROM e WHERE split = 'train'), 5) + 0.0 AS encoded FROM e""")
def _(spark, sf):
    d = split_lines(spark, sf).select("row_id", "split", "l_suppkey", "l_extendedprice", (F.col("l_returnflag") == "A").cast("double").alias("hot"), F.lit(0).alias("fold"))
    out = E.target_encode(d, column="l_suppkey", target="l_extendedprice", train=TRAIN, fold="fold", folds=1, out="encoded", cross_fit=False)
    return rounded(E.standardize(out, out.where(TRAIN), ["encoded"]).select("row_id", "hot", "encoded"), 5)


# ---- intervals -----------------------------------------------------------------------------
ALPHAS = (0.05, 0.1, 0.2)
Q_SQL = PRED + """, cal AS (SELECT model, l_returnflag, AbsoluteError AS s, AbsoluteError / greatest(100 * (1 + l_quantity), 1e-8) AS ns FROM pr WHERE split = 'validation'),
 al AS (SELECT unnest([0.05, 0.1, 0.2])::DOUBLE AS alpha),
 rk AS (SELECT model, s, row_number() OVER (PARTITION BY model ORDER BY s) AS k, count(*) OVER (PARTITION BY model) AS n FROM cal),
 qa AS (SELECT model, alpha, 1 - alpha AS nominal_coverage, n AS n_calibration_rows, least(n, ceil((n + 1)::DOUBLE * (1 - alpha)))::BIGINT AS finite_sample_rank, s AS q_hat
   FROM rk, al WHERE k = least(n, ceil((n + 1)::DOUBLE * (1 - alpha)))::BIGINT),
 rn AS (SELECT model, ns, row_number() OVER (PARTITION BY model ORDER BY ns) AS k, count(*) OVER (PARTITION BY model) AS n FROM cal),
 qn AS (SELECT model, ns AS q_norm FROM rn WHERE k = least(n, ceil((n + 1)::DOUBLE * (1 - 0.1::DOUBLE)))::BIGINT)
"""


def calibration_scores(spark, sf):
    p = predictions(spark, sf).where("split = 'validation'")
    return p.withColumn("ns", F.col("AbsoluteError") / F.greatest(100 * (1 + F.col("l_quantity")), F.lit(1e-8)))


@query("conformal_quantile_c1", Q_SQL + "SELECT model, alpha, round(q_hat, 6) AS q_hat FROM qa")
def _(spark, sf):
    return rounded(K.conformal_quantiles(calibration_scores(spark, sf), ["model"], "AbsoluteError", ALPHAS, bounded=True).select("model", "alpha", "q_hat"))


@query("quantile_audit_c2", Q_SQL + "SELECT model, alpha, round(nominal_coverage, 9) AS nominal_coverage, n_calibration_rows, finite_sample_rank, round(finite_sample_rank / n_calibration_rows::DOUBLE, 9) AS quantile_level, round(q_hat, 6) AS q_hat FROM qa")
def _(spark, sf):
    return rounded(K.conformal_quantiles(calibration_scores(spark, sf), ["model"], "AbsoluteError", ALPHAS, bounded=True), 9, q_hat=6)


@query("group_quantile_c1", PRED + """, rk AS (SELECT model, l_suppkey, AbsoluteError AS s, row_number() OVER (PARTITION BY model, l_suppkey ORDER BY AbsoluteError) AS k, count(*) OVER (PARTITION BY model, l_suppkey) AS n FROM pr)
 SELECT model, l_suppkey, n AS n_calibration_rows, round(s, 6) AS q_hat FROM rk WHERE k = least(n, ceil((n + 1)::DOUBLE * (1 - 0.1::DOUBLE)))::BIGINT""")
def _(spark, sf):
    out = K.conformal_quantiles(predictions(spark, sf), ["model", "l_suppkey"], "AbsoluteError", [0.1])
    return rounded(out.select("model", "l_suppkey", "n_calibration_rows", "q_hat"))


@query("interpolated_quantile_c3", PRED + "SELECT model, count(*) AS n_calibration_rows, round(quantile_cont(AbsoluteError, 0.9), 6) AS q_hat FROM pr WHERE split = 'validation' GROUP BY 1")
def _(spark, sf):
    return rounded(K.interpolated_quantile(calibration_scores(spark, sf), ["model"], "AbsoluteError", 0.9))


@query("symmetric_interval_c4", PRED + "SELECT model, row_id, Predicted - 5000 AS \"Lower\", Predicted + 5000 AS \"Upper\" FROM pr")
def _(spark, sf):
    lo, hi = K.symmetric_bounds(F.col("Predicted"), F.lit(5000.0))
    return predictions(spark, sf).select("model", "row_id", lo.alias("Lower"), hi.alias("Upper"))


BASE_SQL = ", bi AS MATERIALIZED (SELECT *, Predicted - 30 * (1 + l_quantity) AS lo, Predicted + 45 * (1 + l_quantity) AS hi FROM pr)"


def base_intervals(spark, sf):
    return predictions(spark, sf).withColumn("Lower", F.col("Predicted") - 30 * (1 + F.col("l_quantity"))).withColumn("Upper", F.col("Predicted") + 45 * (1 + F.col("l_quantity")))


@query("conformalised_interval_c5", PRED + BASE_SQL + """, sc AS (SELECT model, greatest(lo - Actual, Actual - hi, 0) AS s FROM bi WHERE split = 'validation'),
 q AS (SELECT model, s AS q_hat FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY s) k, count(*) OVER (PARTITION BY model) n FROM sc) WHERE k = least(n, ceil((n + 1)::DOUBLE * (1 - 0.1::DOUBLE)))::BIGINT)
 SELECT model, row_id, round(lo - q_hat, 6) + 0.0 AS "Lower", round(hi + q_hat, 6) AS "Upper", round(q_hat, 6) AS q_hat FROM bi JOIN q USING (model) WHERE split = 'test'""")
def _(spark, sf):
    b = base_intervals(spark, sf)
    out = K.conformalize(b.where("split = 'validation'"), b.where("split = 'test'"), ["model"], 0.1)
    return rounded(out.select("model", "row_id", "Lower", "Upper", "q_hat"))


WINKLER = """hi - lo + CASE WHEN Actual < lo THEN (2 / (1 - nominal_coverage)) * (lo - Actual) WHEN Actual > hi THEN (2 / (1 - nominal_coverage)) * (Actual - hi) ELSE 0 END"""


@query("winkler_c6", PRED + BASE_SQL + f" SELECT model, row_id, round({WINKLER}, 5) AS winkler FROM (SELECT *, 0.9::DOUBLE AS nominal_coverage FROM bi)")
def _(spark, sf):
    b = base_intervals(spark, sf)
    return b.select("model", "row_id", r(K.winkler(F.col("Actual"), F.col("Lower"), F.col("Upper"), F.lit(1.0) - F.lit(0.9)), 5).alias("winkler"))


IV = Q_SQL + """, mi AS (SELECT 'split_conformal' AS method, pr.*, Predicted - q_hat AS lo, Predicted + q_hat AS hi FROM pr JOIN qa ON qa.model = pr.model AND alpha = 0.1 WHERE split = 'test'
   UNION ALL SELECT 'normalised_conformal', pr.*, Predicted - q_norm * greatest(100 * (1 + l_quantity), 1e-8), Predicted + q_norm * greatest(100 * (1 + l_quantity), 1e-8) FROM pr JOIN qn USING (model) WHERE split = 'test'),
 iv AS (SELECT method, model, 'shared' AS evaluation_scheme, split, nominal_coverage, row_id, Actual, Predicted, lo AS "Lower", hi AS "Upper", Residual, AbsoluteError, SquaredError, hi - lo AS IntervalWidth, (hi - lo) / 2 AS HalfWidth,
   (hi - lo) / 2 AS UncertaintyScore, Actual >= lo AND Actual <= hi AS Covered, CASE WHEN Actual < lo THEN 'below_interval_overprediction' WHEN Actual > hi THEN 'above_interval_underprediction' ELSE 'covered' END AS MissDirection,
   AbsoluteError / greatest((hi - lo) / 2, 1e-8) AS StandardizedError, """ + WINKLER + """ AS WinklerScore, l_suppkey FROM (SELECT *, 0.9::DOUBLE AS nominal_coverage FROM mi))
"""


def intervals(spark, sf):
    """Two conformal methods on the test rows; their quantiles come from one job over the validation rows.  Both splits are written once."""
    p = written(predictions(spark, sf).where("split IN ('validation', 'test')").select(
        "model", "split", "row_id", "Actual", "Predicted", "AbsoluteError", "l_suppkey", "l_quantity"))
    spread = F.greatest(100 * (1 + F.col("l_quantity")), F.lit(1e-8))
    widths = {"split_conformal": F.lit(1.0), "normalised_conformal": spread}
    option = lambda m, w: F.struct(F.lit(m).alias("method"), w.alias("unit"))
    both = p.select("*", F.explode(F.array(*[option(m, w) for m, w in widths.items()])).alias("_o")).select(*p.columns, "_o.method", "_o.unit")
    scores = both.where("split = 'validation'").select("method", "model", (F.col("AbsoluteError") / F.col("unit")).alias("s"))
    q = K.conformal_quantiles(scores, ["method", "model"], "s", [0.1], bounded=True).select("method", "model", "q_hat")
    lo, hi = K.symmetric_bounds(F.col("Predicted"), F.col("q_hat") * F.col("unit"))
    rows = attach(both.where("split = 'test'"), q, ["method", "model"], bounded=True).withColumn("Lower", lo).withColumn("Upper", hi)
    return K.interval_table(rows, labels={
        "method": F.col("method"), "model": F.col("model"), "evaluation_scheme": F.lit("shared"), "split": F.col("split"), "nominal_coverage": F.lit(0.9)}, carry=["l_suppkey"])


def stored_intervals(spark, sf):
    """The interval table as a job would keep it: written once, then summarised several times."""
    return written(intervals(spark, sf))


@query("normalised_conformal_c12", Q_SQL + "SELECT model, round(q_norm, 9) AS q_hat FROM qn")
def _(spark, sf):
    return rounded(K.conformal_quantiles(calibration_scores(spark, sf), ["model"], "ns", [0.1], bounded=True).select("model", "q_hat"), 9)


IV_DOUBLES = ["Lower", "Upper", "Residual", "AbsoluteError", "SquaredError", "IntervalWidth", "HalfWidth", "UncertaintyScore", "StandardizedError", "WinklerScore"]


@query("interval_table_c7", IV + 'SELECT method, model, evaluation_scheme, split, nominal_coverage, row_id, Actual, Predicted, Covered, MissDirection, ' + ", ".join(f'round("{c}", 4) + 0.0 AS "{c}"' for c in IV_DOUBLES) + " FROM iv")
def _(spark, sf):
    d = intervals(spark, sf).drop("l_suppkey")
    return d.select(*[r(c, 4).alias(c) if c in IV_DOUBLES else F.col(c) for c in d.columns])


SPEAR = """ivr AS (SELECT *, rank() OVER (PARTITION BY method, model ORDER BY IntervalWidth) + (count(*) OVER (PARTITION BY method, model, IntervalWidth) - 1) / 2.0::DOUBLE AS rw,
 rank() OVER (PARTITION BY method, model ORDER BY AbsoluteError) + (count(*) OVER (PARTITION BY method, model, AbsoluteError) - 1) / 2.0::DOUBLE AS re FROM iv)
"""
INTERVAL_SQL = METRIC_SQL + """, avg(Covered::INT) AS EmpiricalCoverage, avg(Covered::INT) - 0.9::DOUBLE AS CoverageGap, avg(IntervalWidth) AS MeanIntervalWidth, median(IntervalWidth) AS MedianIntervalWidth, stddev_pop(IntervalWidth) AS StdIntervalWidth,
 avg((MissDirection = 'below_interval_overprediction')::INT) AS BelowIntervalRate, avg((MissDirection = 'above_interval_underprediction')::INT) AS AboveIntervalRate, avg(WinklerScore) AS MeanWinklerScore, median(WinklerScore) AS MedianWinklerScore"""
INTERVAL_COLUMNS = ["EmpiricalCoverage", "CoverageGap", "MeanIntervalWidth", "MedianIntervalWidth", "StdIntervalWidth", "BelowIntervalRate", "AboveIntervalRate",
                    "MeanWinklerScore", "MedianWinklerScore", "MAE", "RMSE", "R2", "R", "Bias", "MedianAE"]
KEYS = "method, model, evaluation_scheme, split, nominal_coverage"


@query("spearman_w7", IV + ", " + SPEAR + "SELECT method, model, round(corr(rw, re), 7) AS rho FROM ivr WHERE method = 'normalised_conformal' GROUP BY 1, 2")
def _(spark, sf):
    return rounded(K.spearman(stored_intervals(spark, sf).where("method = 'normalised_conformal'"), ["method", "model"], "IntervalWidth", "AbsoluteError", "rho", bounded=True), 7)


@query("interval_metrics_c8", IV + ", " + SPEAR + f"SELECT {KEYS}, n_rows, {round_sql(INTERVAL_COLUMNS, 5)}, round(UncertaintyErrorSpearman, 6) AS UncertaintyErrorSpearman FROM (SELECT {KEYS}, {INTERVAL_SQL}, CASE WHEN method = 'normalised_conformal' THEN corr(rw, re) END AS UncertaintyErrorSpearman FROM ivr GROUP BY {KEYS})")
def _(spark, sf):
    return rounded(K.interval_metrics(stored_intervals(spark, sf)), 5, UncertaintyErrorSpearman=6)


GROUP_RANKS = SPEAR.replace("ivr AS", "gvr AS").replace("PARTITION BY method, model", "PARTITION BY method, model, l_suppkey")
GROUP_RHO = "CASE WHEN max(IntervalWidth) - min(IntervalWidth) > greatest(1e-8, abs(median(IntervalWidth)) * 1e-8) THEN corr(rw, re) END AS UncertaintyErrorSpearman"


@query("group_interval_metrics_c9", IV + ", " + GROUP_RANKS + f"SELECT l_suppkey, {KEYS}, n_rows, {round_sql(INTERVAL_COLUMNS, 7)}, CASE WHEN NOT isnan(UncertaintyErrorSpearman) THEN round(UncertaintyErrorSpearman, 7) + 0.0 END AS UncertaintyErrorSpearman FROM (SELECT l_suppkey, {KEYS}, {INTERVAL_SQL}, {GROUP_RHO} FROM gvr GROUP BY l_suppkey, {KEYS})")
def _(spark, sf):
    return rounded(K.interval_metrics(stored_intervals(spark, sf), [*K.METRIC_KEYS, "l_suppkey"], bounded=False), 7)


@query("micro_macro_intervals_a23", IV + ", " + SPEAR + f""", gm AS (SELECT l_suppkey, {KEYS}, {INTERVAL_SQL} FROM iv GROUP BY l_suppkey, {KEYS})
 SELECT 'micro_all_rows' AS aggregation, {KEYS}, n_rows, n_groups, {round_sql(INTERVAL_COLUMNS, 5)}, round(rho, 6) AS UncertaintyErrorSpearman
 FROM (SELECT {KEYS}, count(DISTINCT l_suppkey) AS n_groups, {INTERVAL_SQL}, CASE WHEN method = 'normalised_conformal' THEN corr(rw, re) END AS rho FROM ivr GROUP BY {KEYS})
 UNION ALL SELECT 'macro_equal_group_weight', {KEYS}, sum(n_rows)::BIGINT, count(*), {", ".join(f"round(avg({c}), 5) + 0.0" for c in INTERVAL_COLUMNS)}, NULL FROM gm GROUP BY {KEYS}""".replace("\n, gm", ", gm", 1))
def _(spark, sf):
    return rounded(K.micro_macro_intervals(stored_intervals(spark, sf), "l_suppkey"), 5, UncertaintyErrorSpearman=6)


LABEL_COLUMNS = "method, model, l_suppkey, n_rows, ConfidenceDiagnostic, CoverageEvidence"


@query("confidence_labels_c10", IV + f""", gm AS (SELECT l_suppkey, {KEYS}, count(*) AS n_rows, avg(Covered::INT) AS c, avg(IntervalWidth) AS w FROM iv GROUP BY l_suppkey, {KEYS}),
 md AS (SELECT *, median(w) OVER (PARTITION BY method) AS mw FROM gm), lb AS (SELECT *, c < nominal_coverage AS below, w - mw > greatest(1e-8, abs(mw) * 1e-8) AS wide FROM md)
 SELECT method, model, l_suppkey, n_rows, CASE WHEN below AND NOT wide THEN 'narrow_but_wrong' WHEN below THEN 'wide_and_wrong' WHEN wide THEN 'wide_but_safe' ELSE 'well_calibrated_or_sharp' END AS ConfidenceDiagnostic,
 CASE WHEN n_rows >= 10 THEN 'more_stable_n_ge_10' ELSE 'limited_n_lt_10' END AS CoverageEvidence, round(greatest(0, nominal_coverage - c), 8) AS MiscoverageShortfall, round(greatest(0, nominal_coverage - c) / greatest(w, 1e-8), 12) AS NarrowWrongScore FROM lb""")
def _(spark, sf):
    g = K.interval_metrics(stored_intervals(spark, sf), [*K.METRIC_KEYS, "l_suppkey"], bounded=False, with_spearman=False)
    out = K.confidence_labels(g)
    return out.select(*LABEL_COLUMNS.split(", "), r("MiscoverageShortfall", 8).alias("MiscoverageShortfall"), r("NarrowWrongScore", 12).alias("NarrowWrongScore"))


@query("normal_interval_c11", PRED + "SELECT model, row_id, round(Predicted - 1.2815515655446004::DOUBLE * (100 + l_quantity), 6) + 0.0 AS \"Lower\", round(Predicted + 1.2815515655446004::DOUBLE * (100 + l_quantity), 6) AS \"Upper\" FROM pr")
def _(spark, sf):
    lo, hi = K.symmetric_bounds(F.col("Predicted"), K.normal_half_width(100 + F.col("l_quantity"), 0.8))
    return rounded(predictions(spark, sf).select("model", "row_id", lo.alias("Lower"), hi.alias("Upper")))


@query("percentile_interval_c14", """SELECT l_orderkey, count(*) AS repetitions, round(quantile_cont(l_extendedprice, 0.1), 6) AS "Lower", round(quantile_cont(l_extendedprice, 0.9), 6) AS "Upper" FROM lineitem GROUP BY 1""")
def _(spark, sf):
    return rounded(K.percentile_bounds(table(spark, sf, "lineitem"), "l_orderkey", "l_extendedprice", 0.8))


@query("miscovered_rows_c17", IV + "SELECT method, model, row_id, round(StandardizedError, 6) AS StandardizedError, MissDirection FROM iv WHERE NOT Covered")
def _(spark, sf):
    return rounded(K.miscovered_rows(intervals(spark, sf)).select("method", "model", "row_id", "StandardizedError", "MissDirection"))


@query("calibration_by_group_a25", IV + """SELECT method || '/' || model || '/' || l_suppkey AS fold, count(*) AS n_rows, round(avg(Actual), 5) AS mean_true, round(avg(Predicted), 5) AS mean_prediction, round(avg((Actual BETWEEN "Lower" AND "Upper")::INT), 8) AS coverage,
 round(avg("Upper" - "Lower"), 5) AS interval_width, round(avg(abs(Residual)), 5) AS mean_residual, round(avg(HalfWidth / 100), 7) AS mean_distance FROM iv GROUP BY 1""")
def _(spark, sf):
    d = intervals(spark, sf).withColumn("mean_distance", F.col("HalfWidth") / 100).withColumn("fold", F.concat_ws("/", "method", "model", F.col("l_suppkey").cast("string")))
    return rounded(V.calibration_by_group(d, "fold"), 5, coverage=8, mean_distance=7)
