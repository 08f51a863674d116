"""Prediction tables and regression metrics: per model, per split, per sub-group, per fold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tabcal.operators.scale import attach, exact_quantiles, safe_corr, unpivot_numeric

METRICS = ("n_rows", "MAE", "RMSE", "R2", "R", "Bias", "MedianAE")


def prediction_table(
    df: DataFrame, *, row_id: str, actual: str, predicted: str, labels: dict[str, Column], carry: Sequence[str] = ()
) -> DataFrame:
    """Labels, row id, actual, predicted and the three error columns (residual = actual - predicted)."""
    a, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    return df.select(
        *[value.alias(name) for name, value in labels.items()],
        F.col(row_id).alias("row_id"), a.alias("Actual"), p.alias("Predicted"), (a - p).alias("Residual"),
        F.abs(a - p).alias("AbsoluteError"), ((a - p) * (a - p)).alias("SquaredError"), *carry,
    )


def medians(df: DataFrame, keys: Sequence[str], columns: dict[str, str], *, bounded: bool) -> DataFrame:
    """One exact median per (keys, column); ``columns`` maps source column to output column."""
    long = unpivot_numeric(df, keys, list(columns))
    per_column = exact_quantiles(long, [*keys, "column"], "value", {"_m": 0.5}, bounded=bounded)
    return per_column.groupBy(*keys).agg(*[
        F.max(F.when(F.col("column") == c, F.col("_m"))).alias(out) for c, out in columns.items()
    ])


def point_aggregates() -> list[Column]:
    """Every metric but the median, as one set of aggregates over a prediction table."""
    n = F.count(F.lit(1))
    sse, spread = F.sum("SquaredError"), F.var_pop("Actual") * n
    r2 = (
        F.when(n < 2, F.lit(None).cast("double"))
        .when(spread > 0, 1 - F.try_divide(sse, spread))
        .otherwise(F.when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    )
    return [
        n.alias("n_rows"), F.avg("AbsoluteError").alias("MAE"), F.sqrt(F.avg("SquaredError")).alias("RMSE"),
        r2.alias("R2"), safe_corr("Actual", "Predicted").alias("R"), F.avg("Residual").alias("Bias"),
    ]


def regression_metrics(
    predictions: DataFrame, keys: Sequence[str], *, bounded: bool = False, extra: Sequence[Column] = ()
) -> DataFrame:
    """n, MAE, RMSE, R2, R, Bias, MedianAE per key; one pass for all models and splits."""
    points = predictions.groupBy(*keys).agg(*point_aggregates(), *extra)
    middle = medians(predictions, keys, {"AbsoluteError": "MedianAE"}, bounded=bounded)
    return attach(points, middle, keys, bounded=bounded)


def errors_by_group(predictions: DataFrame, group: Column, name: str) -> DataFrame:
    """Error summary per sub-group; NULL is reported as its own text key."""
    rows = predictions.withColumn(name, F.coalesce(group.cast("string"), F.lit("nan")))
    points = rows.groupBy(name).agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg("AbsoluteError").alias("MAE"),
        F.sqrt(F.avg("SquaredError")).alias("RMSE"), F.avg("Residual").alias("Bias"),
        F.avg("Actual").alias("ActualMean"), F.avg("Predicted").alias("PredictedMean"),
    )
    middle = medians(rows, [name], {"AbsoluteError": "MedianAE"}, bounded=False)
    return attach(points, middle, [name]).select(
        name, "n_rows", "MAE", "RMSE", "Bias", "MedianAE", "ActualMean", "PredictedMean"
    ).orderBy(F.desc("RMSE"), name)


def over_seeds(metrics: DataFrame, keys: Sequence[str], columns: Sequence[str], *, sample: bool = True) -> DataFrame:
    """Mean and sd of metric columns over repeated runs (sample sd, or population sd)."""
    sd = F.stddev_samp if sample else F.stddev_pop
    return metrics.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"),
        *[f for c in columns for f in (F.avg(c).alias(f"{c}_mean"), sd(c).alias(f"{c}_std"))],
    )


def fold_extras() -> list[Column]:
    """Per-fold extras: largest error, target range, share of the worst row, direction."""
    sse = F.sum("SquaredError")
    return [
        F.max("AbsoluteError").alias("MaximumAE"), F.avg("Actual").alias("target_mean"),
        F.min("Actual").alias("target_min"), F.max("Actual").alias("target_max"),
        F.when(sse > 0, F.try_divide(F.max("SquaredError"), sse)).otherwise(F.lit(0.0)).alias("worst_row_squared_error_share"),
        F.when(F.avg("Residual") > 0, F.lit("underprediction")).otherwise(F.lit("overprediction")).alias(
            "dominant_residual_direction"
        ),
    ]


def fold_summary(fold_metrics: DataFrame, keys: Sequence[str], columns: Sequence[str] = ("MAE", "RMSE", "R2")) -> DataFrame:
    """Mean, median and sd of the per-fold metrics per model."""
    middle = medians(fold_metrics, keys, {c: f"{c}_median" for c in columns}, bounded=True)
    spread = fold_metrics.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("folds"),
        *[f for c in columns for f in (F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"))],
    )
    return attach(spread, middle, keys, bounded=True)


def direction_counts(fold_metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    return (
        fold_metrics.groupBy(*keys).pivot("dominant_residual_direction", ["overprediction", "underprediction"])
        .agg(F.count(F.lit(1))).na.fill(0)
    )


def micro_macro(
    predictions: DataFrame, keys: Sequence[str], group: str,
    columns: Sequence[str] = ("MAE", "RMSE", "R2", "Bias", "MedianAE", "MaximumAE"),
) -> DataFrame:
    """Row-weighted metrics and the unweighted mean of the per-group metrics."""
    largest = F.max("AbsoluteError").alias("MaximumAE")
    groups = F.count_distinct(group).alias("n_groups")
    micro = regression_metrics(predictions, keys, bounded=True, extra=[largest, groups])
    per_group = regression_metrics(predictions, [*keys, group], extra=[largest])
    macro = per_group.groupBy(*keys).agg(
        F.sum("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_groups"), *[F.avg(c).alias(c) for c in columns]
    )
    shown = [*keys, "n_groups", "n_rows", *columns]
    return micro.select(F.lit("micro_all_rows").alias("aggregation"), *shown).unionByName(
        macro.select(F.lit("macro_equal_group_weight").alias("aggregation"), *shown)
    )


def held_out_shift(df: DataFrame, group: str, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Leave-one-group-out shift of every group in one pass.

    The training range without group g comes from the two extreme groups per column, and a
    category is unseen in training when it occurs in one group only, so no fold is expanded.
    """
    cells = unpivot_numeric(df, [group], numeric).where("value IS NOT NULL")
    ranges = cells.groupBy("column", group).agg(F.min("value").alias("_mn"), F.max("value").alias("_mx"))
    outer = None
    for end, order in (("_mn", F.col("_mn").asc()), ("_mx", F.col("_mx").desc())):
        two = ranges.withColumn("_r", F.row_number().over(W.partitionBy("column").orderBy(order, group))).where("_r <= 2")
        pick = two.groupBy("column").agg(
            F.max(F.when(F.col("_r") == 1, F.struct(F.col(group).alias("g")))).alias(f"{end}_g"),
            F.max(F.when(F.col("_r") == 1, F.col(end))).alias(f"{end}_1"),
            F.max(F.when(F.col("_r") == 2, F.col(end))).alias(f"{end}_2"),
        )
        outer = pick if outer is None else attach(outer, pick, ["column"], bounded=True)
    bounded = attach(cells, outer, ["column"], bounded=True)
    without = lambda end: F.when(F.col(f"{end}_g.g").eqNullSafe(F.col(group)), F.col(f"{end}_2")).otherwise(F.col(f"{end}_1"))
    low, high = without("_mn"), without("_mx")
    out_of_range = (F.col("value") < low) | (F.col("value") > high)
    numeric_rate = bounded.groupBy(group).agg(
        F.avg(F.when(low.isNotNull(), out_of_range.cast("double"))).alias("numeric_out_of_training_range_rate")
    )
    labels = (
        df.select(group, *[F.col(c).cast("string").alias(c) for c in categorical])
        .unpivot([group], list(categorical), "column", "value").where("value IS NOT NULL")
        .groupBy("column", "value", group).agg(F.count(F.lit(1)).alias("_c"))
    )
    spread = labels.groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("_groups"), F.min(group).alias("_only")
    ).where("_groups = 1").select("column", "value", F.col("_only").alias(group), F.lit(1.0).alias("_new"))
    flagged = attach(labels, spread, ["column", "value", group])
    unseen_rate = flagged.groupBy(group).agg(
        (F.sum(F.col("_c") * F.coalesce(F.col("_new"), F.lit(0.0))) / F.sum("_c")).alias("unseen_category_rate")
    )
    groups = df.select(group).distinct()
    return attach(attach(groups, numeric_rate, [group]), unseen_rate, [group])


def calibration_by_group(intervals: DataFrame, group: str) -> DataFrame:
    """Rows, means, coverage, width, residual and neighbour distance per group."""
    covered = (F.col("Actual") >= F.col("Lower")) & (F.col("Actual") <= F.col("Upper"))
    return intervals.groupBy(group).agg(
        F.count("Actual").alias("n_rows"), F.avg("Actual").alias("mean_true"),
        F.avg("Predicted").alias("mean_prediction"), F.avg(covered.cast("double")).alias("coverage"),
        F.avg(F.col("Upper") - F.col("Lower")).alias("interval_width"),
        F.avg(F.abs(F.col("Actual") - F.col("Predicted"))).alias("mean_residual"),
        F.avg("mean_distance").alias("mean_distance"),
    )


def experiment_delta(metrics: DataFrame, reference: str, challenger: str, columns: Sequence[str]) -> DataFrame:
    """Challenger minus reference, per (model, split) and metric column."""
    of = lambda name, c: F.max(F.when(F.col("experiment") == name, F.col(c)))
    return metrics.groupBy("model", "split").agg(*[
        x for c in columns for x in (
            of(reference, c).alias(f"{c}_reference"), of(challenger, c).alias(f"{c}_challenger"),
            (of(challenger, c) - of(reference, c)).alias(f"{c}_delta"),
        )
    ])


def strategy_gaps(metrics: DataFrame, keys: Sequence[str], strategy: str, base: str, columns=("RMSE", "MAE", "R2")) -> DataFrame:
    """Metric gap of every split strategy against the base strategy."""
    baseline = metrics.where(F.col(strategy) == base).select(*keys, *[F.col(c).alias(f"_b_{c}") for c in columns])
    joined = attach(metrics, baseline, keys, bounded=True)
    return joined.select(*metrics.columns, *[(F.col(c) - F.col(f"_b_{c}")).alias(f"{c}_gap") for c in columns])


def policy_sensitivity(metrics: DataFrame) -> DataFrame:
    """Best policy per model on validation, its test RMSE, and the best test policy."""
    on = lambda split: F.when(F.col("split") == split, F.struct("RMSE", "policy"))
    best = metrics.groupBy("model").agg(
        (F.count_distinct(F.when(F.col("split") == "validation", F.col("policy"))) > 1).alias("comparison_available"),
        F.min(on("validation")).alias("_v"), F.min(on("test")).alias("_t"),
    )
    tests = metrics.where("split = 'test'").select("model", F.col("policy").alias("_p"), F.col("RMSE").alias("_r"))
    matched = best.select("*", F.col("_v.policy").alias("_p"))
    return attach(matched, tests, ["model", "_p"], bounded=True).select(
        "model", "comparison_available",
        F.col("_v.policy").alias("best_validation_policy"), F.col("_v.RMSE").alias("best_validation_RMSE"),
        F.col("_r").alias("test_RMSE_for_best_validation_policy"),
        F.col("_t.policy").alias("best_test_policy"), F.col("_t.RMSE").alias("best_test_RMSE"),
    )


def best_row(metrics: DataFrame, metric: str, name: str, *, keys: Sequence[str] = ()) -> DataFrame:
    """The row with the smallest metric (ties by name), per key."""
    others = [c for c in metrics.columns if c not in keys]
    best = metrics.where(F.col(metric).isNotNull()).groupBy(*keys).agg(
        F.min_by(F.struct(*others), F.struct(metric, name)).alias("_best")
    )
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in others])


def worst_across_models(predictions: DataFrame, models: Sequence[str], k: int = 10) -> DataFrame:
    """Rows with the largest mean absolute residual over the models, and whether all models agree in sign."""
    residual = lambda m: F.max(F.when(F.col("model") == m, F.col("Residual")))
    wide = predictions.groupBy("row_id").agg(*[residual(m).alias(f"residual_{m}") for m in models])
    parts = [F.col(f"residual_{m}") for m in models]
    mean_abs = sum((F.abs(p) for p in parts), F.lit(0.0)) / len(parts)
    signs = F.array_distinct(F.array(*[F.signum(p) for p in parts]))
    return wide.select(
        "*", mean_abs.alias("mean_absolute_residual"), (F.size(signs) == 1).alias("same_direction")
    ).orderBy(F.desc("mean_absolute_residual"), "row_id").limit(k)


def pivot_counts(df: DataFrame, key: str, column: str, values: Sequence[str]) -> DataFrame:
    return df.groupBy(key).pivot(column, list(values)).agg(F.count(F.lit(1))).na.fill(0)


def pivot_means(df: DataFrame, key: str, column: str, values: Sequence[str], metric: str) -> DataFrame:
    return df.groupBy(key).pivot(column, list(values)).agg(F.avg(metric))
