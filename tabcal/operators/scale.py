"""Building blocks that stay exact when one group holds a large share of all rows.

* ``attach``           group statistics back onto rows, hot groups split off by broadcast
* ``exact_quantiles``  exact interpolated quantiles without buffering a group anywhere
* ``order_statistics`` exact k-th smallest value per group
* ``value_ranks``      exact ranks per group without putting a group into one task
* ``running_weights``  exact running sums per group along a value, by range partitions
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from tabcal.session import durable, written

HOT_GROUPS = 256  # rows of the broadcast side; no other group can exceed 1/257 of the rows
BROADCAST_ROWS = 100_000  # a table with one row per key is broadcast whole if it was counted and has at most this many
SKETCH_ACCURACY = 10_000  # percentile_approx rank error is at most n / accuracy
BRACKET = 4.0 / SKETCH_ACCURACY  # bracket half-width in rank share: sketch error with margin
WHOLE_GROUP_ROWS = 20_000  # below this the bracket is the whole group
LARGE_GROUP_ROWS = 1_000_000  # a smaller group may be sorted in one task; at most rows / this many are larger


def null_safe(keys: Sequence[str], prefix: str) -> Column:
    condition = F.lit(True)
    for i, key in enumerate(keys):
        condition = condition & F.col(key).eqNullSafe(F.col(f"{prefix}{i}"))
    return condition


def condition(c: Column | str) -> Column:
    """A condition given as a Column or as SQL text."""
    return F.expr(c) if isinstance(c, str) else c


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Append the columns of a one-row table (a global aggregate) to every row."""
    return df.crossJoin(F.broadcast(one_row))


def pin(one_row: DataFrame) -> DataFrame:
    """A fitted one-row table (statistics, a d x d matrix) computed now and kept as literals.

    Fitting is an action in any case; pinning stops later steps from recomputing the fit.
    """
    return one_row.sparkSession.createDataFrame(one_row.collect(), one_row.schema)


def attach(
    df: DataFrame,
    stats: DataFrame,
    keys: Sequence[str],
    *,
    size_col: str | None = None,
    bounded: bool = False,
    count_rows: bool = False,
    hot_groups: int = HOT_GROUPS,
    broadcast_rows: int | None = None,
) -> DataFrame:
    """Left-join one row per key onto ``df``; NULL is a key of its own.

    ``bounded=True`` states that the number of keys is fixed by the schema (columns, splits, methods), so the statistics are broadcast.
    With ``size_col`` (a column of group sizes) or ``count_rows=True`` (sizes are counted over ``df``) the statistics are written once
    and counted.  Up to ``broadcast_rows`` of them are broadcast.  Otherwise the ``hot_groups`` largest groups are broadcast, and one
    shuffle join serves the others, on the keys and a route: the hash of the keys, or of the whole row in a hot group, so that such rows go
    along without a partner and are dealt over all partitions; no other key has more than 1/(hot_groups+1) of the rows.  The result's plan holds ``df`` once, so calls can be
    chained.  With neither, no key may repeat much in ``df``.
    """
    keys = list(keys)
    if not keys:
        return with_scalars(df, stats)
    values = [c for c in stats.columns if c not in keys]
    renamed = lambda p: [F.col(k).alias(f"{p}{i}") for i, k in enumerate(keys)]
    drop = lambda p: [f"{p}{i}" for i in range(len(keys))]
    if not bounded and (size_col is not None or count_rows):
        stats = written(stats)
        bounded = stats.count() <= (BROADCAST_ROWS if broadcast_rows is None else broadcast_rows)
    if bounded:
        right = stats.select(*renamed("_bk"), *values)
        return df.join(F.broadcast(right), null_safe(keys, "_bk"), "left").drop(*drop("_bk"))
    if count_rows:
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
        right = sizes.select(*renamed("_sk"), "_size")
        stats, size_col = written(stats.join(right, null_safe(keys, "_sk"), "left").drop(*drop("_sk"))), "_size"
    if size_col is None:
        right = stats.select(*renamed("_jk"), *values)
        return df.join(right, null_safe(keys, "_jk"), "left").drop(*drop("_jk"))
    hot = stats.orderBy(F.desc_nulls_last(size_col), *keys).limit(hot_groups)
    hot = hot.select(*renamed("_hk"), F.struct(*values).alias("_hot"))
    cold = stats.select(*renamed("_ck"), F.xxhash64(*keys).alias("_cold_route"), F.struct(*values).alias("_cold"))
    # A partition's rows have the same salts when a lost task runs again; equal rows of different partitions have different ones.
    salted = F.xxhash64(F.spark_partition_id(), *[F.col(f"`{c}`") for c in _hashable(df)])
    marked = df.join(F.broadcast(hot), null_safe(keys, "_hk"), "left").withColumn(
        "_route", F.when(F.col("_hot").isNull(), F.xxhash64(*keys)).otherwise(salted))
    joined = marked.join(cold, null_safe(keys, "_ck") & (F.col("_route") == F.col("_cold_route")), "left")
    picked = [F.coalesce(F.col("_hot").getField(v), F.col("_cold").getField(v)).alias(v) for v in values]
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], *picked)


def _hashable(df: DataFrame) -> list[str]:
    """Columns of plain types, whose hashes tell rows apart."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.NumericType, T.StringType, T.DateType, T.TimestampType, T.BooleanType, T.BinaryType))]


def usable(value: str) -> Column:
    """Neither NULL nor NaN; NaN is treated as NULL everywhere."""
    return F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))


def _bracketed_counts(df, keys, value, ranks, size_stats, bounded):
    """Cumulative counts of the few values that can hold the wanted ranks.

    ``ranks`` maps an output name to (share, function of n giving the 1-based rank).
    Per wanted rank, rows under the bracket collapse to one NULL-valued counter and rows
    above it are dropped, both during map-side aggregation.  The true order statistic is
    inside every valid bracket, so recomputed sketches cannot change the answer.
    """
    names = list(ranks)
    shares = [ranks[n][0] for n in names]
    rows = attach(df, size_stats, keys, size_col="_n", bounded=bounded)
    large, v = F.col("_n") > WHOLE_GROUP_ROWS, F.col(value)
    position = lambda w, low, high: F.struct(
        w.alias("w"), (large & (v < low)).alias("below"), (large & (v > high)).alias("above")
    )
    if len(names) <= 8:
        wanted = F.array(*[position(F.lit(i), F.col("_sk")[2 * i], F.col("_sk")[2 * i + 1]) for i in range(len(names))])
    else:  # one lambda instead of one expression per rank keeps the generated code small
        numbers = F.sequence(F.lit(0), F.lit(len(names) - 1))
        wanted = F.transform(numbers, lambda i: position(i, F.get("_sk", 2 * i), F.get("_sk", 2 * i + 1)))
    spread = rows.select(*keys, value, "_n", F.explode(wanted).alias("_w")).where(~F.col("_w.above"))
    counted = spread.groupBy(
        *keys,
        F.col("_w.w").alias("_w"),
        F.when(~F.col("_w.below"), F.col(value)).alias("_v"),
    ).agg(F.count(F.lit(1)).alias("_c"), F.max("_n").alias("_n"))
    running = W.partitionBy(*keys, "_w").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(
        W.unboundedPreceding, W.currentRow
    )
    return counted.withColumn("_cum", F.sum("_c").over(running)), names


def large_groups(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """Keys with more than ``rows`` rows: at most total/rows of them, so the table may be broadcast."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > rows).drop("_rows")


def by_size(df, keys, rows):
    """(rows of small groups, rows of large groups); with no large group AQE drops the second branch."""
    big = F.broadcast(large_groups(df, keys, rows).select(*[F.col(k).alias(f"_lk{i}") for i, k in enumerate(keys)]))
    return df.join(big, null_safe(keys, "_lk"), "left_anti"), df.join(big, null_safe(keys, "_lk"), "left_semi")


def _sketch(df, keys, value, shares):
    points = []
    for share in shares:
        points += [max(0.0, share - BRACKET), min(1.0, share + BRACKET)]
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.percentile_approx(value, points, SKETCH_ACCURACY).alias("_sk"),
    )


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    *,
    bounded: bool = False,
    count_as: str | None = None,
    large_rows: int = LARGE_GROUP_ROWS,
) -> DataFrame:
    """Exact linear-interpolated quantiles (numpy's default rule) per group, NULLs ignored.

    ``probs`` maps output column to probability.  Groups of moderate size use the built-in
    exact percentile.  For larger ones (and always for global or ``bounded`` keys) one sketch
    pass brackets each quantile and one counting pass keeps only the bracket (about 0.1% of
    the group), so no task and no buffer ever holds a whole large group.
    """
    keys = list(keys)
    clean = df.select(*keys, value).where(usable(value))
    if keys and not bounded:
        small, large = by_size(clean, keys, large_rows)
        all_probs = F.percentile(value, [float(p) for p in probs.values()])
        direct = small.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), all_probs.alias("_p")).select(
            *keys, *([F.col("_n").alias(count_as)] if count_as else []),
            *[F.col("_p")[i].alias(n) for i, n in enumerate(probs)],
        )
        return direct.unionByName(_bracketed_quantiles(large, keys, value, probs, False, count_as))
    return _bracketed_quantiles(clean, keys, value, probs, bounded, count_as)


def _bracketed_quantiles(clean, keys, value, probs, bounded, count_as):
    sketch = _sketch(clean, keys, value, list(probs.values()))
    ranks = {name: (p, None) for name, p in probs.items()}
    counts, names = _bracketed_counts(clean, keys, value, ranks, sketch, bounded)
    p_of = F.element_at(F.array(*[F.lit(float(probs[n])) for n in names]), F.col("_w") + 1)
    position = (F.col("_n") - 1) * p_of
    lower_rank = F.floor(position) + 1
    upper_rank = F.least(lower_rank + 1, F.col("_n"))
    picked = counts.groupBy(*keys, "_w").agg(
        F.max("_n").alias("_n"),
        F.min(F.when(F.col("_cum") >= lower_rank, F.col("_v"))).alias("_lo"),
        F.min(F.when(F.col("_cum") >= upper_rank, F.col("_v"))).alias("_hi"),
    )
    fraction = position - F.floor(position)
    value_at = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * fraction
    out = picked.withColumn("_q", F.when(fraction > 0, value_at).otherwise(F.col("_lo")))
    extra = [F.max("_n").alias(count_as)] if count_as else []
    return out.groupBy(*keys).agg(
        *extra, *[F.max(F.when(F.col("_w") == i, F.col("_q"))).alias(n) for i, n in enumerate(names)]
    )


def order_statistics(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    ranks: dict[str, tuple[float, Column]],
    *,
    bounded: bool = False,
    count_as: str = "n",
    large_rows: int = LARGE_GROUP_ROWS,
) -> DataFrame:
    """Exact k-th smallest finite value per group.

    ``ranks`` maps output column to (approximate share k/n, k as a Column over ``_n``).
    """
    keys = list(keys)
    clean = df.select(*keys, value).where(usable(value))
    if keys and not bounded:
        small, large = by_size(clean, keys, large_rows)
        group = W.partitionBy(*keys)
        numbered = small.select(
            *keys, F.col(value).alias("_v"), F.row_number().over(group.orderBy(value)).alias("_k"),
            F.count(F.lit(1)).over(group).alias("_n"),
        )
        direct = numbered.groupBy(*keys).agg(
            F.max("_n").alias(count_as),
            *[F.max(F.when(F.col("_k") == k.cast("long"), F.col("_v"))).alias(name) for name, (_, k) in ranks.items()],
        )
        return direct.unionByName(_bracketed_statistics(large, keys, value, ranks, False, count_as))
    return _bracketed_statistics(clean, keys, value, ranks, bounded, count_as)


def _bracketed_statistics(clean, keys, value, ranks, bounded, count_as):
    sketch = _sketch(clean, keys, value, [r[0] for r in ranks.values()])
    counts, names = _bracketed_counts(clean, keys, value, ranks, sketch, bounded)
    rank_of = F.element_at(F.array(*[ranks[n][1].cast("long") for n in names]), F.col("_w") + 1)
    picked = counts.groupBy(*keys, "_w").agg(
        F.max("_n").alias("_n"), F.min(F.when(F.col("_cum") >= rank_of, F.col("_v"))).alias("_v")
    )
    return picked.groupBy(*keys).agg(
        F.max("_n").alias(count_as),
        *[F.max(F.when(F.col("_w") == i, F.col("_v"))).alias(n) for i, n in enumerate(names)],
    )


def value_ranks(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, value, ties, before): copies of each value and rows strictly below it in its group."""
    counted = df.select(*keys, value, F.lit(1).alias("_one"))
    return running_weights(counted, keys, value, "_one").withColumnRenamed("own", "ties")


def running_weights(df: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    """(keys, value, own, before): the weight on each value and the weight strictly below it in its group, one path for every group size.

    Weights of equal values are added first.  The distinct values are range-partitioned by (keys, value) and written once, so a large
    group spans several partitions and small ones share one; only totals per (keys, partition) cross between partitions.
    """
    keys = list(keys)
    distinct = df.select(*keys, value, weight).where(usable(value)).groupBy(*keys, value).agg(F.sum(weight).alias("own"))
    placed = written(distinct.repartitionByRange(*keys, value).withColumn("_b", F.spark_partition_id()))
    totals = placed.groupBy(*keys, "_b").agg(F.sum("own").alias("_bw"))
    earlier = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_b", F.coalesce(F.sum("_bw").over(earlier), F.lit(0)).alias("_off"))
    inside = W.partitionBy(*keys, "_b").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    return attach(placed, offsets, [*keys, "_b"]).select(
        *keys, value, "own", (F.col("_off") + F.coalesce(F.sum("own").over(inside), F.lit(0))).alias("before")
    )


def average_rank() -> Column:
    """Average rank of tied values, from the columns of ``value_ranks``."""
    return F.col("before") + (F.col("ties") + 1) / F.lit(2.0)


def safe_corr(a: str, b: str) -> Column:
    """Pearson correlation on rows where both are known; NULL (not an error) without spread."""
    left, right = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(left) * F.stddev_pop(right))


def unpivot_numeric(df: DataFrame, ids: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(ids, column, value) with every value as a double."""
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        list(ids), list(columns), "column", "value"
    )


def unpivot_text(df: DataFrame, ids: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(ids, column, value) with every value as text."""
    return df.select(*ids, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        list(ids), list(columns), "column", "value"
    )
