"""Checked joins: many-to-one lookups that must be complete, lineage, semi and anti joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tabcal.operators.scale import attach, null_safe


def unique_key_or_fail(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key; a repeated key fails the job (checked inside the plan, no extra action)."""
    values = [c for c in df.columns if c not in keys]
    once = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"), F.min_by(F.struct(*values), F.struct(*values)).alias("_v")
    )
    message = F.concat(F.lit("join key is not unique: "), F.to_json(F.struct(*keys)))
    guarded = once.where(F.when(F.col("_rows") > 1, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))
    return guarded.select(*keys, *[F.col(f"_v.{v}").alias(v) for v in values])


def many_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], rename: dict[str, str] | None = None) -> DataFrame:
    """Left join onto a right side whose key must be unique; right columns may be renamed."""
    rename = rename or {}
    checked = unique_key_or_fail(right, keys)
    for old, new in rename.items():
        checked = checked.withColumnRenamed(old, new)
    return attach(left, checked, keys, count_rows=True)


def complete_lookup(df: DataFrame, manifest: DataFrame, key: str, value: str) -> DataFrame:
    """Look up a role for every row; a row without one fails the job."""
    joined = attach(df, manifest.select(key, value), [key], count_rows=True)
    message = F.concat(F.lit(f"no {value} for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("NULL")))
    return joined.withColumn(
        value, F.when(F.col(value).isNull(), F.raise_error(message).cast("string")).otherwise(F.col(value))
    )


def unassigned_groups(df: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Groups present in the data but absent from the manifest."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")).join(manifest.select(key), key, "left_anti")


def append_lineage(predictions: DataFrame, lineage: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Lineage columns by row id; clashing names are dropped from the right."""
    clash = [c for c in lineage.columns if c in predictions.columns and c != row_id]
    return predictions.join(lineage.drop(*clash), row_id, "left")


def rows_with_keys(df: DataFrame, keys_df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Semi join on null-safe keys."""
    right = keys_df.select(*[F.col(k).alias(f"_sk{i}") for i, k in enumerate(keys)]).distinct()
    return df.join(right, null_safe(keys, "_sk"), "left_semi")


def unseen_values(train: DataFrame, other: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n_rows) of values in ``other`` that training never had."""
    cells = lambda df: df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        [], list(columns), "column", "value"
    ).where("value IS NOT NULL")
    seen = cells(train).distinct()
    counted = cells(other).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.join(seen, ["column", "value"], "left_anti")
