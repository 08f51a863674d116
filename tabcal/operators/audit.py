"""Split summaries, leakage audits, crossing groups and readiness checks."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from tabcal.operators.scale import with_scalars


def split_summary(df: DataFrame, *, split: str, group: str, target: str, features: Sequence[str]) -> DataFrame:
    """Rows, share, groups, target statistics and missing predictor cells per split."""
    missing = sum((F.col(c).isNull().cast("long") for c in features), F.lit(0).cast("long"))
    rows = df.select(split, group, target, missing.alias("_mc"))
    per = rows.groupBy(split).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(group).alias("n_groups"),
        F.avg(target).alias("target_mean"), F.stddev_samp(target).alias("target_std"),
        F.min(target).alias("target_min"), F.max(target).alias("target_max"),
        F.sum("_mc").alias("missing_predictor_cells"), F.avg("_mc").alias("missing_predictor_cells_per_row"),
    )
    total = rows.agg(F.count(F.lit(1)).alias("_total"))
    return with_scalars(per, total).select(
        *per.columns, (F.col("n_rows") * 100.0 / F.col("_total")).alias("row_percentage")
    )


def check(name: str, value: Column, passed: Column) -> Column:
    return F.struct(
        F.lit(name).alias("check"), value.cast("string").alias("value"),
        F.when(passed, F.lit("pass")).otherwise(F.lit("fail")).alias("status"),
    )


def leakage_audit(df: DataFrame, *, split: str, group: str, names: Sequence[str], uses_target: bool = False) -> DataFrame:
    """Groups shared by each pair of splits, rows without a split, and the target-use flag."""
    has = lambda s: F.max((F.col(split) == s).cast("int"))
    per_group = df.groupBy(group).agg(
        *[F.coalesce(has(s), F.lit(0)).alias(f"_in_{i}") for i, s in enumerate(names)],
        F.count(F.lit(1)).alias("_n"), F.count(split).alias("_assigned"),
    )
    pairs = list(combinations(range(len(names)), 2))
    one = per_group.agg(
        *[F.count_if((F.col(f"_in_{i}") == 1) & (F.col(f"_in_{j}") == 1)).alias(f"_p{i}_{j}") for i, j in pairs],
        F.sum("_n").alias("_rows"), F.sum("_assigned").alias("_assigned"),
    )
    checks = [check(f"{names[i]}_{names[j]}_group_overlap", F.col(f"_p{i}_{j}"), F.col(f"_p{i}_{j}") == 0) for i, j in pairs]
    checks.append(check("assignment_uses_target_values", F.lit(uses_target), F.lit(not uses_target)))
    checks.append(check("all_rows_assigned", F.col("_assigned"), F.col("_assigned") == F.col("_rows")))
    return one.select(F.inline(F.array(*checks)))


def role_summary(df: DataFrame, *, role: str, group: str, fold: str) -> DataFrame:
    return df.groupBy(role).agg(
        F.lit(fold).alias("evaluation_fold"), F.count(F.lit(1)).alias("n_rows"), F.count_distinct(group).alias("n_groups")
    )


def fail_on_failed_checks(audit: DataFrame) -> DataFrame:
    """Pass the audit through, failing the job at the first failed check."""
    message = F.concat(F.lit("audit failed: "), F.col("check"), F.lit(" = "), F.col("value"))
    return audit.withColumn(
        "status", F.when(F.col("status") == "pass", F.col("status")).otherwise(F.raise_error(message).cast("string"))
    )


def crossing_groups(df: DataFrame, *, key: str, split: str) -> DataFrame:
    """How many groups (and rows) occur in more than one split."""
    per = df.groupBy(key).agg(F.count_distinct(split).alias("_s"), F.count(F.lit(1)).alias("_n"))
    crossing = F.col("_s") > 1
    return per.agg(
        F.count(F.lit(1)).alias("groups"), F.count_if(crossing).alias("crossing_groups"),
        F.count_if(F.col("_n") > 1).alias("repeated_groups"),
        F.coalesce(F.sum(F.when(crossing, F.col("_n"))), F.lit(0)).alias("rows_in_crossing_groups"),
    )


def readiness_audit(
    df: DataFrame, *, split: str, group: str, target: str, row_id: str, features: Sequence[str],
    lineage: Sequence[str], names: Sequence[str], expected_rows: DataFrame,
) -> DataFrame:
    """Prerequisite checks before calibration: alignment, separation, completeness, overlap.

    ``expected_rows`` is a one-row table whose only column is the row count of the source.
    """
    leaked = sorted(set(features) & set(lineage))
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"), F.count(target).alias("_targets"), F.count(group).alias("_groups"),
        F.count_distinct(row_id).alias("_ids"),
        *[F.count_if(F.col(split) == s).alias(f"_n_{i}") for i, s in enumerate(names)],
    )
    one = with_scalars(counts, expected_rows.toDF("_expected"))
    checks = [check(f"{s}_has_rows", F.col(f"_n_{i}"), F.col(f"_n_{i}") > 0) for i, s in enumerate(names)]
    checks += [
        check("target_complete", F.col("_targets"), F.col("_targets") == F.col("_rows")),
        check("group_complete", F.col("_groups"), F.col("_groups") == F.col("_rows")),
        check("row_ids_unique", F.col("_ids"), F.col("_ids") == F.col("_rows")),
        check("all_source_rows_represented", F.col("_rows"), F.col("_rows") == F.col("_expected")),
        check("target_not_a_predictor", F.lit(target), F.lit(target not in features)),
        check("lineage_columns_excluded_from_predictors", F.lit(len(leaked)), F.lit(not leaked)),
    ]
    return one.select(F.inline(F.array(*checks))).unionByName(
        leakage_audit(df, split=split, group=group, names=names)
    )


def alignment_audit(
    df: DataFrame, *, row_id: str, target: str, group: str, predictors: Sequence[str], lineage: Sequence[str]
) -> DataFrame:
    """Counters of the align-and-dedupe step: targets removed, copies removed, groups, leaks."""
    kept = df.where(F.col(target).isNotNull())
    content = kept.groupBy(*predictors, target).agg(F.count(F.lit(1)).alias("_c"), F.min(row_id).alias("_id"))
    source = df.agg(
        F.count(F.lit(1)).alias("source_rows"), F.count_if(F.col(target).isNull()).alias("missing_target_rows_removed"),
        F.count_if(F.col(group).isNull()).alias("missing_groups"),
    )
    deduped = content.agg(
        F.count(F.lit(1)).alias("modeling_rows"), F.sum(F.col("_c") - 1).alias("exact_duplicate_rows_removed"),
        F.lit(len(list(predictors)) + 1).cast("long").alias("modeling_columns"),
        F.lit(len(set(predictors) & set(lineage))).cast("long").alias("metadata_columns_in_predictors"),
        (F.count_distinct("_id") == F.count(F.lit(1))).alias("row_ids_unique"),
    )
    return with_scalars(source, deduped)
