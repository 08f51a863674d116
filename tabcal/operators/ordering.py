"""Windows, ranks, top-k, duplicate flags and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tabcal.operators.scale import attach, exact_quantiles, with_scalars

BLOCK_ROWS = 1_000_000


def content_key(columns: Sequence[str], null_text: str = "__MISSING__") -> Column:
    """md5 of the separator-joined columns with NULL spelled out, so ('a', NULL) and (NULL, 'a') differ."""
    return F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit(null_text)) for c in columns]))


def forward_fill(
    df: DataFrame, position: str, columns: Sequence[str], *, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Carry the last non-NULL value down in source order.

    Rows are cut into blocks of consecutive positions; each block fills itself, and one row per
    block carries the value in from the blocks before it.
    """
    blocked = df.withColumn("_block", F.floor(F.col(position) / block_rows))
    last = blocked.groupBy("_block").agg(*[
        F.max_by(c, F.when(F.col(c).isNotNull(), F.col(position))).alias(f"_l_{c}") for c in columns
    ])
    earlier = W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)  # one row per block
    carried = last.select("_block", *[F.last(f"_l_{c}", ignorenulls=True).over(earlier).alias(f"_c_{c}") for c in columns])
    inside = W.partitionBy("_block").orderBy(position).rowsBetween(W.unboundedPreceding, W.currentRow)
    joined = attach(blocked, carried, ["_block"])
    return joined.select(*[
        F.coalesce(F.last(c, ignorenulls=True).over(inside), F.col(f"_c_{c}")).alias(c) if c in columns else F.col(c)
        for c in df.columns
    ])


def rank_by(metrics: DataFrame, keys: Sequence[str], metric: str, out: str = "rank") -> DataFrame:
    """Minimum rank of a metric within each report section (one row per model)."""
    return metrics.withColumn(out, F.rank().over(W.partitionBy(*keys).orderBy(F.col(metric).asc_nulls_last())).cast("long"))


def group_median_to_rows(df: DataFrame, group: str, value: str, out: str) -> DataFrame:
    """Each row beside its group's exact median."""
    stats = exact_quantiles(df, [group], value, {out: 0.5}, count_as="_n_rows")
    return attach(df, stats, [group], size_col="_n_rows").drop("_n_rows")


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First n rows per group; the rank limit is applied before and after the shuffle."""
    ranked = df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_rank") <= n).drop("_rank")


def duplicate_flags(df: DataFrame, columns: Sequence[str], row_id: str) -> DataFrame:
    """Copies per content and whether the row is a later copy (the smallest row id is kept)."""
    keyed = df.withColumn("_content", content_key(columns))
    first = keyed.groupBy("_content").agg(F.min(row_id).alias("_first"), F.count(F.lit(1)).alias("copies"))
    return attach(keyed, first, ["_content"], size_col="copies").select(
        *df.columns, "copies", (F.col(row_id) != F.col("_first")).alias("is_later_copy")
    )


def keep_first(df: DataFrame, columns: Sequence[str], row_id: str) -> DataFrame:
    """Smallest row id per distinct content; copies collapse before the shuffle."""
    return df.groupBy(*columns).agg(F.min(row_id).alias(row_id), F.count(F.lit(1)).alias("copies"))


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """A top-k report: order with a tie-breaking key and keep k rows."""
    return df.orderBy(*order).limit(k)


def union_ragged(frames: Sequence[DataFrame]) -> DataFrame:
    """Union of report tables; absent columns become NULL."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def key_set_comparison(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Sizes of both key sets, their intersection, and whether they are equal."""
    sides = left.select(key, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(key, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    )
    per_key = sides.groupBy(key).agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    both = F.count_if((F.col("_l") == 1) & (F.col("_r") == 1))
    return per_key.agg(
        F.count_if(F.col("_l") == 1).alias("left_keys"), F.count_if(F.col("_r") == 1).alias("right_keys"),
        both.alias("shared_keys"), (both == F.count(F.lit(1))).alias("equal_sets"),
    )


def with_total(df: DataFrame, value: str, out: str) -> DataFrame:
    return with_scalars(df, df.agg(F.sum(value).alias(out)))
