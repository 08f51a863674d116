"""Projection, filters and column selection, with the audits that go with them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType

from tabcal.functions.text import number_column, to_number
from tabcal.operators.scale import attach, condition, exact_quantiles, unpivot_numeric, with_scalars

CHUNK = 100  # columns per aggregate, to stay inside code generation limits


def matching_columns(columns: Sequence[str], candidates: Sequence[str]) -> list[str]:
    """Exact name, then case-insensitive name, then case-insensitive substring."""
    folded = {c.casefold(): c for c in columns}
    found: list[str] = []
    for candidate in candidates:
        low = candidate.casefold()
        if candidate in columns:
            hits = [candidate]
        elif folded.get(low, None) is not None:
            hits = [folded[low]]
        else:
            hits = [c for c in columns if low in c.casefold()]
        found += [h for h in hits if h not in found]
    return found


def first_matching_column(columns: Sequence[str], candidates: Sequence[str]) -> str | None:
    hits = matching_columns(columns, candidates)
    return hits[0] if hits else None


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    absent = [c for c in required if c not in df.columns]
    if absent:
        raise ValueError(f"missing required columns: {absent}")
    return df


def features_and_target(df: DataFrame, features: Sequence[str], target: str, row_id: str) -> DataFrame:
    return require_columns(df, [*features, target, row_id]).select(row_id, *features, target)


def valid_target_rows(df: DataFrame, target: str) -> DataFrame:
    """Rows whose target is a number, with the target as a double."""
    number = number_column(df, target)
    return df.withColumn(target, number).where(F.col(target).isNotNull())


def target_summary(df: DataFrame, target: str) -> DataFrame:
    """Four rows: total, valid, missing, percent valid."""
    number = number_column(df, target)
    counted = df.agg(F.count(F.lit(1)).alias("n"), F.count(number).alias("ok"))
    metric = lambda name, value: F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value"))
    return counted.select(F.inline(F.array(
        metric("total_rows", F.col("n")),
        metric("valid_target_rows", F.col("ok")),
        metric("missing_target_rows", F.col("n") - F.col("ok")),
        metric("valid_target_percent", F.try_divide(F.col("ok") * F.lit(100.0), F.col("n"))),
    )))


def drop_unused(df: DataFrame, target: str, unused: Sequence[str]) -> DataFrame:
    return df.where(F.col(target).isNotNull()).drop(*unused)


def candidates_by_prefix(columns: Sequence[str], prefixes: Sequence[str], target: str) -> list[str]:
    return [c for c in columns if c != target and c.startswith(tuple(prefixes))]


def excluded_columns_audit(
    df: DataFrame, selected: Sequence[str], target: str, reasons: Sequence[tuple[str, str]], otherwise: str
) -> DataFrame:
    """One row per column that is neither selected nor the target, with the reason of its prefix and its missing share."""
    names = [c for c in df.columns if c not in selected and c != target]
    of = {c: next((text for prefix, text in reasons if c.startswith(prefix)), otherwise) for c in names}
    reason = F.element_at(F.create_map(*[F.lit(x) for pair in of.items() for x in pair]), F.col("column"))
    return null_shares(df, names).select(
        "column", reason.alias("reason"), F.coalesce(F.try_divide(F.col("missing"), F.col("rows")), F.lit(0.0)).alias("missing_fraction"))


def type_partition(df: DataFrame, columns: Sequence[str], known_numeric: Sequence[str] = ()) -> tuple[list, list]:
    """(numeric, categorical) by a known list, else by column type."""
    numeric = [
        c for c in columns if c in known_numeric or isinstance(df.schema[c].dataType, NumericType)
    ]
    return numeric, [c for c in columns if c not in numeric]


def null_shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, rows, missing) in one aggregate pass per chunk of columns."""
    out = None
    for at in range(0, len(columns), CHUNK):
        part = columns[at : at + CHUNK]
        counted = df.agg(F.count(F.lit(1)).alias("_rows"), *[
            F.count_if(F.col(c).isNull()).alias(f"_n{i}") for i, c in enumerate(part)
        ])
        rows = counted.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col("_rows").alias("rows"), F.col(f"_n{i}").alias("missing"))
            for i, c in enumerate(part)
        ])))
        out = rows if out is None else out.unionByName(rows)
    return out


def missingness_policy(df: DataFrame, features: Sequence[str], threshold: float | None) -> DataFrame:
    """Keep a feature when its missing fraction is at most the threshold."""
    fraction = F.try_divide(F.col("missing"), F.col("rows"))
    kept = F.lit(True) if threshold is None else fraction <= F.lit(float(threshold))
    return null_shares(df, features).select(
        F.col("column").alias("feature"),
        fraction.alias("missing_fraction_before_semantic_recode"),
        (fraction * 100).alias("missing_percentage_before_semantic_recode"),
        F.lit(threshold).cast("double").alias("missing_threshold"),
        kept.alias("kept"),
        F.when(kept, F.lit("")).otherwise(F.lit(f"missing_fraction_above_{threshold}")).alias("drop_reason"),
    )


def drop_sparse_columns(df: DataFrame, features: Sequence[str], threshold: float | None) -> DataFrame:
    """Project away features over the threshold; the schema depends on data, so this runs one aggregate."""
    policy = missingness_policy(df, features, threshold).where(~F.col("kept")).select("feature").collect()
    return df.drop(*[r.feature for r in policy])


def normalize_shared_table(
    df: DataFrame, *, artefacts: Sequence[str], zero_fill: Sequence[str], target: str, key: str | None = None
) -> DataFrame:
    """Drop artefacts (and the key, when given), NULL -> 0 on listed columns, numeric target."""
    kept = df.drop(*artefacts, *([key] if key else []))
    new = {c: F.coalesce(number_column(kept, c), F.lit(0.0)) for c in zero_fill if c in kept.columns}
    bad = F.raise_error(F.lit(f"non-numeric target in {target}")).cast("double")
    value = number_column(kept, target)
    new[target] = F.when(F.col(target).isNotNull() & value.isNull(), bad).otherwise(value)
    return kept.select(*[new[c].alias(c) if c in new else F.col(c) for c in kept.columns])


def ablate(df: DataFrame, *, prefixes: Sequence[str] = (), substrings: Sequence[str] = ()) -> DataFrame:
    """Remove columns by case-insensitive prefix or substring."""
    return df.drop(*[
        c for c in df.columns
        if c.casefold().startswith(tuple(p.casefold() for p in prefixes)) or any(s in c for s in substrings)
    ])


def trim_bounds(df: DataFrame, target: str, train: Column | str, lower: float, upper: float) -> DataFrame:
    """Target quantiles of the training rows."""
    return exact_quantiles(df.where(train), [], target, {"lower_threshold": lower, "upper_threshold": upper})


def trim_train_target(df: DataFrame, target: str, train: Column | str, lower: float, upper: float) -> DataFrame:
    """Drop training rows outside the train quantiles (ends included); other rows stay."""
    bounded = with_scalars(df, trim_bounds(df, target, train, lower, upper))
    inside = F.col(target).between(F.col("lower_threshold"), F.col("upper_threshold"))
    return bounded.where(~condition(train) | inside).drop("lower_threshold", "upper_threshold")


def trim_audit(df: DataFrame, target: str, train: Column | str, lower: float, upper: float) -> DataFrame:
    rows = with_scalars(df.where(train), trim_bounds(df, target, train, lower, upper))
    inside = F.coalesce(F.col(target).between(F.col("lower_threshold"), F.col("upper_threshold")), F.lit(False))
    return rows.agg(
        F.lit(float(lower)).alias("lower_quantile"), F.lit(float(upper)).alias("upper_quantile"),
        F.max("lower_threshold").alias("lower_threshold"), F.max("upper_threshold").alias("upper_threshold"),
        F.count(F.lit(1)).alias("training_rows_before"), F.count_if(inside).alias("training_rows_after"),
        F.count_if(~inside).alias("training_rows_removed"),
    )


def within_sd(df: DataFrame, columns: Sequence[str], train: Column | str, width: float = 5.0) -> DataFrame:
    """Keep rows inside mean +/- width sd (train bounds) in every column; NULL fails, as NaN does."""
    bounds = df.where(train).agg(
        *[F.avg(c).alias(f"_a_{c}") for c in columns], *[F.stddev_samp(c).alias(f"_s_{c}") for c in columns]
    )
    keep = F.lit(True)
    for c in columns:
        reach = F.lit(width) * F.col(f"_s_{c}")
        keep = keep & F.col(c).between(F.col(f"_a_{c}") - reach, F.col(f"_a_{c}") + reach)
    return with_scalars(df, bounds).where(keep).select(*df.columns)


def iqr_bounds(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, lower, upper): quartiles widened by 1.5 IQR."""
    quartiles = exact_quantiles(
        unpivot_numeric(df, [], columns), ["column"], "value", {"q1": 0.25, "q3": 0.75}, bounded=True
    )
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    return quartiles.select("column", (F.col("q1") - reach).alias("lower"), (F.col("q3") + reach).alias("upper"))


def iqr_outlier_rows(df: DataFrame, row_id: str, columns: Sequence[str]) -> DataFrame:
    """(row_id, column, value) of every cell outside its column's bounds."""
    cells = attach(unpivot_numeric(df, [row_id], columns), iqr_bounds(df, columns), ["column"], bounded=True)
    return cells.where((F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))).select(
        row_id, "column", "value"
    )


def iqr_outlier_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Outlier count and percent of rows per column; columns without outliers are left out."""
    cells = attach(unpivot_numeric(df, [], columns), iqr_bounds(df, columns), ["column"], bounded=True)
    outside = F.coalesce((F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper")), F.lit(False))
    return (
        cells.groupBy("column")
        .agg(F.count_if(outside).alias("outlier_count"), F.count(F.lit(1)).alias("_n"))
        .where("outlier_count > 0")
        .select("column", "outlier_count", (F.col("outlier_count") * 100.0 / F.col("_n")).alias("outlier_percent"))
    )


def stable_results(metrics: DataFrame, max_mae: float = 20.0, max_rows: int = 5) -> DataFrame:
    """Remove result rows that are both bad (MAE) and small."""
    return metrics.where(~F.coalesce((F.col("MAE") >= max_mae) & (F.col("n_rows") <= max_rows), F.lit(False)))


def poor_coverage(table: DataFrame, nominal: float, column: str = "coverage") -> DataFrame:
    return table.where(F.col(column) < F.lit(float(nominal)))


def distinct_complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop rows with any NULL, then exact duplicates (pre-aggregated, so copies collapse map-side)."""
    return df.select(*columns).dropna().dropDuplicates()


def add_labels(df: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Constant label columns in front of a report."""
    return df.select(*[F.lit(v).alias(k) for k, v in labels.items()], "*")


def coercion_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULL counts before and after numeric coercion, per column."""
    counted = df.agg(*[
        c for i, name in enumerate(columns) for c in (
            F.count_if(F.col(name).isNull()).alias(f"_b{i}"),
            F.count_if(number_column(df, name).isNull()).alias(f"_a{i}"),
        )
    ])
    return counted.select(F.inline(F.array(*[
        F.struct(
            F.lit(name).alias("column"),
            F.col(f"_b{i}").alias("missing_before_numeric_coercion"),
            F.col(f"_a{i}").alias("missing_after_numeric_coercion"),
            (F.col(f"_a{i}") - F.col(f"_b{i}")).alias("new_missing_from_numeric_coercion"),
        ) for i, name in enumerate(columns)
    ])))


def coerce_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[number_column(df, c).alias(c) if c in columns else F.col(c) for c in df.columns])


def repair_types(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Cast a text column to double only when that creates no new NULL (one aggregate decides all)."""
    report = coercion_report(df, columns).where("new_missing_from_numeric_coercion = 0").select("column").collect()
    return coerce_columns(df, [r["column"] for r in report])


def align_columns(df: DataFrame, reference: Sequence[str]) -> DataFrame:
    """Exactly the reference columns: absent ones become 0, extra ones are dropped."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(0.0).alias(c) for c in reference])
