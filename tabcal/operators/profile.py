"""Column and group profiles: missingness, cardinality, moments, correlation, histograms."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from tabcal.operators.columns import null_shares
from tabcal.operators.gram import correlations, pair_moments
from tabcal.operators.scale import attach, exact_quantiles, safe_corr, unpivot_numeric, unpivot_text, with_scalars

LOW_CARDINALITY_MAX = 10  # fixed value
MEDIUM_CARDINALITY_MAX = 20  # fixed value


def missing_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return null_shares(df, columns).select(
        "column", F.col("missing").alias("missing_count"),
        F.try_divide(F.col("missing") * F.lit(100.0), F.col("rows")).alias("missing_percent"),
    )


def missing_before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    shared = [c for c in before.columns if c in after.columns]
    left = null_shares(before, shared).select("column", F.col("missing").alias("_b"), F.col("rows").alias("_rb"))
    right = null_shares(after, shared).select("column", F.col("missing").alias("_a"), F.col("rows").alias("_ra"))
    return attach(left, right, ["column"], bounded=True).select(
        "column", F.col("_b").alias("missing_before"), F.col("_a").alias("missing_after"),
        (F.col("_b") - F.col("_a")).alias("missing_reduced_by"),
        (F.col("_b") * 100.0 / F.col("_rb")).alias("missing_percentage_before"),
        (F.col("_a") * 100.0 / F.col("_ra")).alias("missing_percentage_after"),
    )


def fully_missing_audit(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    gone = F.col("missing") == F.col("rows")
    return null_shares(train, columns).select(
        "column", F.col("rows").alias("train_rows"), F.col("missing").alias("missing_count_train"),
        F.try_divide(F.col("missing").cast("double"), F.col("rows")).alias("missing_fraction_train"),
        gone.alias("fully_missing_in_train"), gone.alias("dropped_from_modeling"),
        F.when(gone, F.lit("numeric_fully_missing_in_X_train")).otherwise(F.lit("")).alias("drop_reason"),
    )


def distinct_counts(df: DataFrame, columns: Sequence[str], *, null_counts: bool) -> DataFrame:
    """(column, rows, missing, categories).  Values are counted per (column, value) first, so a
    frequent value collapses before the shuffle."""
    cells = unpivot_text(df, [], columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("_c"))
    categories = F.count(F.lit(1)) if null_counts else F.count("value")
    return cells.groupBy("column").agg(
        F.sum("_c").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("_c"))), F.lit(0)).alias("missing"),
        categories.alias("categories"),
    )


def cardinality_report(
    train: DataFrame, columns: Sequence[str],
    low: int = LOW_CARDINALITY_MAX, medium: int = MEDIUM_CARDINALITY_MAX,
) -> DataFrame:
    """Train categories (NULL is one) and the encoder bucket they imply."""
    by_size = lambda a, b, c: F.when(F.col("categories") <= low, a).when(F.col("categories") <= medium, b).otherwise(c)
    return distinct_counts(train, columns, null_counts=True).select(
        "column", F.col("missing").alias("missing_count_train"),
        F.try_divide(F.col("missing").cast("double"), F.col("rows")).alias("missing_fraction_train"),
        F.col("categories").alias("unique_categories_train"),
        by_size(F.lit("low"), F.lit("medium"), F.lit("high")).alias("cardinality_bucket"),
        by_size(
            F.lit("onehot_ignore_unknown"), F.lit("rare_category_onehot"),
            F.lit("domain_grouping_then_rare_category_onehot"),
        ).alias("encoder_policy"),
        F.lit(low).cast("long").alias("low_cardinality_max"),
        F.lit(medium).cast("long").alias("medium_cardinality_max"),
    )


def encoding_advice(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Recommended encoding per column: 2 values binary, up to 10 one-hot, else target; numbers none."""
    kinds = dict(df.dtypes)
    text = [c for c in columns if kinds[c] == "string"]
    is_text = F.col("column").isin(*text) if text else F.lit(False)
    n = F.col("categories")
    return distinct_counts(df, columns, null_counts=False).select(
        "column", F.when(is_text, F.lit("text")).otherwise(F.lit("number")).alias("kind"),
        n.alias("unique_values"),
        F.when(~is_text, F.lit("No Encoding")).when(n == 2, F.lit("Binary Encoding"))
        .when(n <= 10, F.lit("One-Hot Encoding")).otherwise(F.lit("Ordinal/Target Encoding")).alias("encoding"),
    )


def column_contract(
    train: DataFrame, numeric: Sequence[str], one_hot: Sequence[str], encoded: Sequence[str]
) -> DataFrame:
    """Role, presence, missing count, category count and output width of every contracted column."""
    roles = [(c, "numeric") for c in numeric] + [(c, "one_hot") for c in one_hot] + [(c, "target_encoded") for c in encoded]
    contract = train.sparkSession.createDataFrame(
        [(i, c, r, c in train.columns) for i, (c, r) in enumerate(roles)],
        "position long, column string, role string, present boolean",
    )
    present = [c for c, _ in roles if c in train.columns]
    counts = distinct_counts(train, present, null_counts=False).select("column", "missing", "categories")
    width = F.when(F.col("role") == "one_hot", F.col("categories") + (F.col("missing") > 0).cast("long"))
    return attach(contract, counts, ["column"], bounded=True).select(
        "position", "column", "role", "present", F.col("missing").alias("missing_count"),
        F.col("categories").alias("unique_values"),
        F.when(F.col("present"), width.otherwise(F.lit(1).cast("long"))).alias("output_columns"),
    )


def _corrected_skew(n, g1):
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def _corrected_kurtosis(n, g2):
    return F.when(n > 3, ((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3)))


def numeric_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean, median, sd, min, max, CV%, skewness and high-side outliers (> q75 + 1.5 sd)."""
    long = unpivot_numeric(df, [], columns)
    quant = exact_quantiles(long, ["column"], "value", {"median": 0.5, "q75": 0.75}, bounded=True)
    n = F.count("value").cast("double")
    moments = long.groupBy("column").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
        _corrected_skew(n, F.skewness("value")).alias("skewness"),
    )
    stats = attach(moments, quant, ["column"], bounded=True)
    limits = stats.select("column", (F.col("q75") + 1.5 * F.col("std")).alias("_limit"))
    outliers = attach(long, limits, ["column"], bounded=True).groupBy("column").agg(
        F.count_if(F.coalesce(F.col("value") > F.col("_limit"), F.lit(False))).alias("outliers")
    )
    return attach(stats, outliers, ["column"], bounded=True).select(
        "column", "mean", "median", "std", "min", "max",
        F.try_divide(F.col("std") * 100, F.col("mean")).alias("cv_percent"), "skewness", "outliers",
    )


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sd, min, quartiles, max and bias-corrected kurtosis."""
    long = unpivot_numeric(df, [], columns)
    quant = exact_quantiles(long, ["column"], "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, bounded=True)
    n = F.count("value").cast("double")
    moments = long.groupBy("column").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
        _corrected_kurtosis(n, F.kurtosis("value")).alias("kurtosis"),
    )
    return attach(moments, quant, ["column"], bounded=True)


def group_size_describe(df: DataFrame, group: str) -> DataFrame:
    """Distribution of the rows per group."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).cast("double").alias("rows_per_group"))
    return describe(sizes, ["rows_per_group"])


def value_counts(df: DataFrame, column: str, *, with_null: bool = True) -> DataFrame:
    """(column value, n, share of the counted rows)."""
    rows = df if with_null else df.where(F.col(column).isNotNull())
    counted = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.count(F.lit(1)).alias("_total"))
    return with_scalars(counted, total).select(column, "n", (F.col("n") * 100.0 / F.col("_total")).alias("percent"))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every ordered pair, each pair on the rows where both are known."""
    r = correlations(pair_moments(df, columns))
    cells = [(a, b, None if np.isnan(r[i, j]) else float(r[i, j])) for i, a in enumerate(columns) for j, b in enumerate(columns)]
    return df.sparkSession.createDataFrame(cells, "left_column string, right_column string, r double")


def target_correlations(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    numbers = df.select(target, *[F.col(c).cast("double").alias(c) for c in features])
    wide = numbers.agg(*[safe_corr(c, target).alias(f"_c{i}") for i, c in enumerate(features)])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"_c{i}").alias("r")) for i, c in enumerate(features)
    ])))


def trend_lines(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Least-squares line of the target on each feature."""
    names = ("slope", "intercept", "r2")
    fits = (F.regr_slope, F.regr_intercept, F.regr_r2)
    wide = df.agg(*[
        fit(F.col(target), F.col(c).cast("double")).alias(f"_{name}{i}")
        for i, c in enumerate(features) for name, fit in zip(names, fits)
    ])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), *[F.col(f"_{name}{i}").alias(name) for name in names])
        for i, c in enumerate(features)
    ])))


def _bin_edges(df, keys, value, bins, bounded):
    probs = {f"e{i}": i / bins for i in range(1, bins)}
    return exact_quantiles(df, keys, value, probs, bounded=bounded)


def mutual_information(df: DataFrame, features: Sequence[str], target: str, bins: int = 8) -> DataFrame:
    """Plug-in mutual information (nats) of equal-frequency bins of each feature and the target."""
    rows = unpivot_numeric(df.where(F.col(target).isNotNull()), [target], features).where("value IS NOT NULL")
    edges = F.array(*[F.col(f"e{i}") for i in range(1, bins)])
    feature_edges = _bin_edges(rows, ["column"], "value", bins, True).select("column", edges.alias("_fe"))
    target_edges = _bin_edges(df, [], target, bins, True).select(edges.alias("_te"))
    placed = with_scalars(attach(rows, feature_edges, ["column"], bounded=True), target_edges)
    above = lambda array, c: F.size(F.filter(array, lambda e: e < F.col(c)))
    cells = placed.groupBy("column", above("_fe", "value").alias("x"), above("_te", target).alias("y")).agg(
        F.count(F.lit(1)).cast("double").alias("c")
    )
    per_column = W.partitionBy("column")
    n = F.sum("c").over(per_column)
    share = F.col("c") / n
    ratio = F.col("c") * n / (F.sum("c").over(W.partitionBy("column", "x")) * F.sum("c").over(W.partitionBy("column", "y")))
    return cells.select("column", (share * F.log(ratio)).alias("_t")).groupBy("column").agg(
        F.sum("_t").alias("mutual_information")
    )


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Equal-width bin counts between min and max; the last bin is closed on both sides."""
    ends = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    rows = with_scalars(df.select(column).where(F.col(column).isNotNull()), ends)
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col(column) - F.col("_lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    return rows.groupBy(at.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def dominant_category(df: DataFrame, group: str, category: str, out: str) -> DataFrame:
    """Most frequent category per group, smallest on ties; counted per (group, category) first."""
    counted = df.where(F.col(category).isNotNull()).groupBy(group, category).agg(F.count(F.lit(1)).alias("_c"))
    return counted.groupBy(group).agg(F.min_by(category, F.struct(-F.col("_c"), F.col(category))).alias(out))


def group_composition(
    df: DataFrame, *, group: str, target: str, features: Sequence[str], used, category: str,
    numeric: Sequence[str], minimum_rows: int,
) -> DataFrame:
    """Per-group audit: size, target statistics, missing cells, flag share, dominant category, ranges."""
    missing = sum((F.col(c).isNull().cast("long") for c in features), F.lit(0).cast("long"))
    rows = df.select(group, target, category, *[c for c in numeric], missing.alias("_mc"), used.alias("_used"))
    audit = rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(target).alias("target_mean"), F.stddev_samp(target).alias("target_std"),
        F.min(target).alias("target_min"), F.max(target).alias("target_max"),
        F.sum("_mc").alias("missing_cells_total"), F.avg("_mc").alias("missing_cells_per_row_mean"),
        (F.avg(F.col("_used").cast("double")) * 100).alias("flag_percentage"),
        (F.count(F.lit(1)) >= minimum_rows).alias("eligible"),
        *[f(c).alias(f"{c}_{n}") for c in numeric for n, f in (("min", F.min), ("max", F.max))],
    )
    return attach(audit, dominant_category(rows, group, category, "dominant_category"), [group])


def composition_summary(audit: DataFrame) -> DataFrame:
    """One row over the group audit."""
    sizes = audit.select(F.col("n_rows").cast("double").alias("n"), "eligible")
    median = exact_quantiles(sizes, [], "n", {"median_group_rows": 0.5})
    one = sizes.agg(
        F.sum("n").cast("long").alias("modeling_rows"), F.count(F.lit(1)).alias("groups"),
        F.min("n").cast("long").alias("minimum_group_rows"), F.max("n").cast("long").alias("maximum_group_rows"),
        F.count_if("eligible").alias("groups_with_minimum_rows"),
        F.coalesce(F.sum(F.when(F.col("eligible"), F.col("n"))), F.lit(0)).cast("long").alias("rows_in_groups_with_minimum_rows"),
        (F.max("n") * 100 / F.sum("n")).alias("largest_group_row_percentage"),
    )
    return with_scalars(one, median)
