"""Prediction intervals: conformal, Gaussian and percentile rules, and their coverage tables."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tabcal.operators.evaluate import medians, point_aggregates
from tabcal.operators.scale import (
    LARGE_GROUP_ROWS, attach, by_size, exact_quantiles, null_safe, order_statistics, running_weights, safe_corr, usable,
)
from tabcal.session import written

WIDTH_TOLERANCE = 1e-8  # fixed value: relative width spread that still counts as constant
ERROR_FLOOR = 1e-8  # fixed value: smallest half-width when standardising an error
STABLE_ROWS = 10  # fixed value: rows from which per-group coverage counts as stable

# Labels of the calibration of a group (coverage below or not, width above the median or not) and of its evidence.
NARROW_WRONG, WIDE_WRONG, WIDE_SAFE, GOOD = "narrow_but_wrong", "wide_and_wrong", "wide_but_safe", "well_calibrated_or_sharp"
STABLE, LIMITED = "more_stable_n_ge_10", "limited_n_lt_10"

METRIC_KEYS = ("method", "model", "evaluation_scheme", "split", "nominal_coverage")


def _finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def conformal_rank(n: Column, alpha: float) -> Column:
    """The finite-sample rank min(n, ceil((n + 1)(1 - alpha)))."""
    return F.least(n, F.ceil((n + 1).cast("double") * F.lit(1 - alpha)))


def conformal_quantiles(
    scores: DataFrame, keys: Sequence[str], score: str, alphas: Sequence[float], *, bounded: bool = False
) -> DataFrame:
    """Finite-sample split-conformal quantile per (keys, alpha).

    The rank is min(n, ceil((n + 1)(1 - alpha))); q_hat is the score at that rank.
    """
    for alpha in alphas:
        if not 0 < alpha < 1:
            raise ValueError("alpha must be strictly between 0 and 1")
    rank = conformal_rank
    wanted = {f"_q{i}": (1 - a, rank(F.col("_n"), a)) for i, a in enumerate(alphas)}
    wide = order_statistics(scores.where(_finite(score)), keys, score, wanted, bounded=bounded, count_as="_rows")
    levels = F.inline(F.array(*[
        F.struct(
            F.lit(float(a)).alias("alpha"), F.lit(1 - a).alias("nominal_coverage"),
            F.col("_rows").alias("n_calibration_rows"), rank(F.col("_rows"), a).alias("finite_sample_rank"),
            (rank(F.col("_rows"), a) / F.col("_rows")).alias("quantile_level"), F.col(f"_q{i}").alias("q_hat"),
        ) for i, a in enumerate(alphas)
    ]))
    return wide.select(*keys, levels)


def interpolated_quantile(scores: DataFrame, keys: Sequence[str], score: str, coverage: float) -> DataFrame:
    """The other rule: interpolated quantile of the scores at the wanted coverage."""
    return exact_quantiles(scores, keys, score, {"q_hat": coverage}, count_as="n_calibration_rows")


def checked_half_width(width: Column) -> Column:
    return F.when(width < 0, F.raise_error(F.lit("interval half-width cannot be negative")).cast("double")).otherwise(width)


def symmetric_bounds(prediction: Column, half_width: Column) -> tuple[Column, Column]:
    width = checked_half_width(half_width)
    return prediction - width, prediction + width


def nonconformity(actual: Column, lower: Column, upper: Column) -> Column:
    """How far the target lies outside a base interval; a crossed interval is an error."""
    outside = F.greatest(lower - actual, actual - upper, F.lit(0.0))
    crossed = F.raise_error(F.lit("lower bound above upper bound")).cast("double")
    return F.when(lower > upper, crossed).otherwise(outside)


def winkler(actual: Column, lower: Column, upper: Column, alpha: Column) -> Column:
    width = upper - lower
    return (
        F.when(actual < lower, width + (F.lit(2.0) / alpha) * (lower - actual))
        .when(actual > upper, width + (F.lit(2.0) / alpha) * (actual - upper))
        .otherwise(width)
    )


def normal_half_width(sd: Column, coverage: float) -> Column:
    if not 0 < coverage < 1:
        raise ValueError("coverage must be strictly between 0 and 1")
    return F.lit(NormalDist().inv_cdf((1 + coverage) / 2)) * sd


def conformalize(
    calibration: DataFrame, evaluation: DataFrame, keys: Sequence[str], alpha: float, *, bounded: bool = True
) -> DataFrame:
    """Expand base intervals (Lower, Upper) of ``evaluation`` by the calibration quantile of the
    nonconformity scores, per key."""
    scored = calibration.withColumn("_score", nonconformity(F.col("Actual"), F.col("Lower"), F.col("Upper")))
    q = conformal_quantiles(scored, keys, "_score", [alpha], bounded=bounded).select(*keys, "q_hat")
    joined = attach(evaluation, q, keys, bounded=bounded)
    new = {"Lower": F.col("Lower") - F.col("q_hat"), "Upper": F.col("Upper") + F.col("q_hat")}
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in evaluation.columns], "q_hat")


def interval_table(df: DataFrame, *, labels: dict[str, Column], carry: Sequence[str] = (), uncertainty: str | None = None) -> DataFrame:
    """The full interval table from (row_id, Actual, Predicted, Lower, Upper) and a nominal coverage label."""
    base = df.select(
        *[value.alias(name) for name, value in labels.items()],
        "row_id", "Actual", "Predicted", "Lower", "Upper", *carry,
        *([F.col(uncertainty).alias("_u")] if uncertainty else []),
    )
    a, p, lo, hi = (F.col(c) for c in ("Actual", "Predicted", "Lower", "Upper"))
    crossed = F.raise_error(F.lit("lower bound above upper bound")).cast("double")
    width = F.when(lo > hi, crossed).otherwise(hi - lo)
    half = width / 2
    names = [n for n in labels]
    return base.select(
        *names, "row_id", "Actual", "Predicted", "Lower", "Upper",
        (a - p).alias("Residual"), F.abs(a - p).alias("AbsoluteError"), ((a - p) * (a - p)).alias("SquaredError"),
        width.alias("IntervalWidth"), half.alias("HalfWidth"),
        (F.col("_u") if uncertainty else half).alias("UncertaintyScore"),
        ((a >= lo) & (a <= hi)).alias("Covered"),
        F.when(a < lo, F.lit("below_interval_overprediction"))
        .when(a > hi, F.lit("above_interval_underprediction")).otherwise(F.lit("covered")).alias("MissDirection"),
        (F.abs(a - p) / F.greatest(half, F.lit(ERROR_FLOOR))).alias("StandardizedError"),
        winkler(a, lo, hi, F.lit(1.0) - F.col("nominal_coverage")).alias("WinklerScore"),
        *carry,
    )


def spearman(df: DataFrame, keys: Sequence[str], left: str, right: str, out: str, *, bounded: bool = False) -> DataFrame:
    """Average-rank correlation per group, on rows where both are known (NaN is not).

    Groups of at most ``LARGE_GROUP_ROWS`` rows are ranked in the task that holds them.  Both columns of larger groups, and of all where the
    keys are ``bounded`` or none, are ranked in one range-partitioned pass; ranks return to rows by value, those of frequent values by broadcast.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(left).cast("double").alias(left), F.col(right).cast("double").alias(right)).where(usable(left) & usable(right))
    if keys and not bounded:
        rows = written(rows)
        small, rows = by_size(rows, keys, LARGE_GROUP_ROWS)
        group = W.partitionBy(*keys)
        mean_rank = lambda c: F.rank().over(group.orderBy(c)) + (F.count(F.lit(1)).over(W.partitionBy(*keys, c)) - 1) / F.lit(2.0)
        ranked = small.select(*keys, right, mean_rank(left).alias("_rl")).select(*keys, "_rl", mean_rank(right).alias("_rr"))
        direct = ranked.groupBy(*keys).agg(safe_corr("_rl", "_rr").alias(out))
        return direct.unionByName(_spread_spearman(rows, keys, left, right, out))
    return _spread_spearman(rows, keys, left, right, out)


def _spread_spearman(rows, keys, left, right, out):
    sides = F.inline(F.array(*[
        F.struct(F.lit(side).alias("_side"), F.col(c).cast("double").alias("_v"), F.lit(1).alias("_w")) for side, c in enumerate((left, right))
    ]))
    ranks = written(running_weights(rows.select(*keys, sides), [*keys, "_side"], "_v", "_w"))
    for side, (column, rank) in enumerate(((left, "_rl"), (right, "_rr"))):
        mean_rank = (F.col("before") + (F.col("own") + 1) / F.lit(2.0)).alias(rank)
        one = ranks.where(F.col("_side") == side).select(*keys, F.col("_v").alias(f"_v{side}"), mean_rank, F.col("own").alias(f"_own{side}"))
        rows = attach(
            rows.withColumn(f"_v{side}", F.col(column).cast("double")), one, [*keys, f"_v{side}"], size_col=f"_own{side}")
    return rows.groupBy(*keys).agg(safe_corr("_rl", "_rr").alias(out))


def interval_metrics(
    intervals: DataFrame, keys: Sequence[str] = METRIC_KEYS, *, bounded: bool = True, with_spearman: bool = True
) -> DataFrame:
    """Coverage, widths, tail rates, Winkler scores, width/error rank correlation and point metrics.

    ``keys`` must include nominal_coverage.  The rank correlation is NULL where the width is
    constant within tolerance.
    """
    keys = list(keys)
    covered = F.avg(F.col("Covered").cast("double"))
    missed = lambda side: F.avg((F.col("MissDirection") == side).cast("double"))
    base = intervals.groupBy(*keys).agg(
        *point_aggregates(),
        covered.alias("EmpiricalCoverage"), (covered - F.col("nominal_coverage")).alias("CoverageGap"),
        F.avg("IntervalWidth").alias("MeanIntervalWidth"), F.stddev_pop("IntervalWidth").alias("StdIntervalWidth"),
        missed("below_interval_overprediction").alias("BelowIntervalRate"),
        missed("above_interval_underprediction").alias("AboveIntervalRate"),
        F.avg("WinklerScore").alias("MeanWinklerScore"),
        (F.max("IntervalWidth") - F.min("IntervalWidth")).alias("_range"),
    )
    middle = medians(intervals, keys, {
        "AbsoluteError": "MedianAE", "IntervalWidth": "MedianIntervalWidth", "WinklerScore": "MedianWinklerScore",
    }, bounded=bounded)
    out = attach(base, middle, keys, bounded=bounded)
    varying = F.col("_range") > F.greatest(F.lit(WIDTH_TOLERANCE), F.abs("MedianIntervalWidth") * WIDTH_TOLERANCE)
    if with_spearman:
        rows = intervals
        if bounded:  # widths that do not vary have no rank correlation, so their rows need no ranks
            out = written(out)
            asked = out.where(varying).select(*[F.col(k).alias(f"_vk{i}") for i, k in enumerate(keys)])
            rows = intervals.join(F.broadcast(asked), null_safe(keys, "_vk"), "left_semi")
        ranked = spearman(rows, keys, "IntervalWidth", "AbsoluteError", "_rho", bounded=bounded)
        out = attach(out, ranked, keys, bounded=bounded)
        rho = F.when(varying, F.col("_rho"))
    else:
        rho = F.lit(None).cast("double")
    return out.select(
        *keys, "EmpiricalCoverage", "CoverageGap", "MeanIntervalWidth", "MedianIntervalWidth", "StdIntervalWidth",
        "BelowIntervalRate", "AboveIntervalRate", "MeanWinklerScore", "MedianWinklerScore",
        rho.alias("UncertaintyErrorSpearman"), "n_rows", "MAE", "RMSE", "R2", "R", "Bias", "MedianAE",
    )


MACRO_COLUMNS = (
    "EmpiricalCoverage", "CoverageGap", "MeanIntervalWidth", "MedianIntervalWidth", "StdIntervalWidth",
    "BelowIntervalRate", "AboveIntervalRate", "MeanWinklerScore", "MedianWinklerScore",
    "MAE", "RMSE", "R2", "R", "Bias", "MedianAE",
)


def micro_macro_intervals(intervals: DataFrame, group: str, *, with_spearman: bool = True) -> DataFrame:
    """Interval metrics over all rows, and their unweighted mean over groups."""
    keys = list(METRIC_KEYS)
    sizes = intervals.groupBy(*keys).agg(F.count_distinct(group).alias("n_groups"))
    micro = attach(interval_metrics(intervals, keys, with_spearman=with_spearman), sizes, keys, bounded=True)
    per_group = interval_metrics(intervals, [*keys, group], bounded=False, with_spearman=False)
    macro = per_group.groupBy(*keys).agg(
        F.sum("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_groups"),
        *[F.avg(c).alias(c) for c in MACRO_COLUMNS], F.lit(None).cast("double").alias("UncertaintyErrorSpearman"),
    )
    label = lambda df, text: df.select(F.lit(text).alias("aggregation"), *macro.columns)
    return label(micro, "micro_all_rows").unionByName(label(macro, "macro_equal_group_weight"))


def confidence_labels(group_metrics: DataFrame) -> DataFrame:
    """Label each group's calibration from its coverage and its width against the method's median width."""
    typical = medians(group_metrics, ["method"], {"MeanIntervalWidth": "MethodMedianGroupWidth"}, bounded=True)
    rows = attach(group_metrics, typical, ["method"], bounded=True)
    below = F.col("EmpiricalCoverage") < F.col("nominal_coverage")
    tolerance = F.greatest(F.lit(WIDTH_TOLERANCE), F.abs("MethodMedianGroupWidth") * WIDTH_TOLERANCE)
    wide = (F.col("MeanIntervalWidth") - F.col("MethodMedianGroupWidth")) > tolerance
    shortfall = F.greatest(F.lit(0.0), F.col("nominal_coverage") - F.col("EmpiricalCoverage"))
    return rows.select(
        "*",
        F.when(below & ~wide, F.lit(NARROW_WRONG)).when(below & wide, F.lit(WIDE_WRONG))
        .when(wide, F.lit(WIDE_SAFE)).otherwise(F.lit(GOOD)).alias("ConfidenceDiagnostic"),
        shortfall.alias("MiscoverageShortfall"),
        (shortfall / F.greatest(F.col("MeanIntervalWidth"), F.lit(1e-8))).alias("NarrowWrongScore"),
        F.when(F.col("n_rows") >= STABLE_ROWS, F.lit(STABLE)).otherwise(F.lit(LIMITED)).alias(
            "CoverageEvidence"
        ),
    ).orderBy(F.desc("MiscoverageShortfall"), "MeanIntervalWidth")


def percentile_bounds(distribution: DataFrame, row_id: str, prediction: str, coverage: float) -> DataFrame:
    """Central percentile bounds per row over its repetitions (a fixed number per row)."""
    tail = (1 - coverage) / 2
    both = F.percentile(prediction, [tail, 1 - tail])
    return distribution.groupBy(row_id).agg(
        F.count(F.lit(1)).alias("repetitions"), both[0].alias("Lower"), both[1].alias("Upper")
    )


def miscovered_rows(intervals: DataFrame) -> DataFrame:
    return intervals.where(~F.col("Covered")).orderBy(F.desc("StandardizedError"), "row_id")
