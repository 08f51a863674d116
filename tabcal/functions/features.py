"""Numeric feature expressions: ratios, logs, interactions, row sums, bins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

RATIO_EPSILON = 1e-9  # fixed value: smallest usable denominator of a safe ratio
SHIFT_EPSILON = 1e-8  # fixed value: added to the denominator of an epsilon ratio
STRENGTH_EDGES = (120.0, 150.0, 180.0)  # fixed values: right-closed bin edges


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """NULL where the denominator is (nearly) zero."""
    return F.when(F.abs(denominator) > RATIO_EPSILON, F.try_divide(numerator, denominator))


def epsilon_ratio(numerator: Column, denominator: Column) -> Column:
    return numerator / (denominator + F.lit(SHIFT_EPSILON))


def strict_sum(columns: list[Column]) -> Column:
    """NULL if any part is NULL."""
    return reduce(lambda a, b: a + b, columns)


def lenient_sum(columns: list[Column]) -> Column:
    """Sum of the known parts; NULL only if every part is NULL."""
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in columns])
    return F.when(F.coalesce(*columns).isNotNull(), total)


def right_closed_bin(c: Column, edges=STRENGTH_EDGES) -> Column:
    """Labels ``<=a``, ``a-b``, ..., ``>z``; an edge value belongs to the lower bin."""
    text = [f"{e:g}" for e in edges]
    chain = F.when(c <= edges[0], F.lit(f"<={text[0]}"))
    for i in range(1, len(edges)):
        chain = chain.when(c <= edges[i], F.lit(f"{text[i - 1]}-{text[i]}"))
    return chain.when(c > edges[-1], F.lit(f">{text[-1]}"))


def add_binder_ratios(df: DataFrame, parts: list[str], water: str, admixture: str) -> DataFrame:
    """Total of the binder parts (first part is the main one) and the ratios built on it."""
    main, *extras = parts
    total = strict_sum([F.col(p) for p in parts])
    return df.select(
        "*",
        total.alias("total_binder"),
        epsilon_ratio(F.col(water), F.col(main)).alias("water_to_main"),
        epsilon_ratio(F.col(water), total).alias("water_to_binder"),
        epsilon_ratio(F.col(admixture), total).alias("admixture_to_binder"),
        *[epsilon_ratio(F.col(p), total).alias(f"{p}_to_binder") for p in extras],
    )


def add_logs(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select("*", *[F.log1p(c).alias(f"log_{c}") for c in columns])


def add_interactions(df: DataFrame, main: str, water: str, admixture: str, age: str) -> DataFrame:
    """Products with the log age and with water; needs the ratio and log columns."""
    log_age = F.col(f"log_{age}")
    return df.select(
        "*",
        (F.col("total_binder") * log_age).alias("binder_age"),
        (F.col("water_to_binder") * log_age).alias("water_binder_age"),
        (F.col(main) * log_age).alias("main_age"),
        (F.col(admixture) * log_age).alias("admixture_age"),
        (F.col(main) * F.col(water)).alias("main_water"),
        (F.col("total_binder") * F.col(water)).alias("binder_water"),
    )


REPRESENTATIONS = ("original", "ratios", "logs", "interactions")


def represent(df: DataFrame, level: str, *, parts: list[str], water: str, admixture: str, age: str) -> DataFrame:
    """Cumulative feature representations; each level adds columns to the one before."""
    if level not in REPRESENTATIONS:
        raise ValueError(f"unknown representation: {level}")
    depth = REPRESENTATIONS.index(level)
    if depth >= 1:
        df = df.transform(add_binder_ratios, parts, water, admixture)
    if depth >= 2:
        df = df.transform(add_logs, [age, admixture, *parts[1:]])
    if depth >= 3:
        df = df.transform(add_interactions, parts[0], water, admixture, age)
    return df


def composite_ratios(
    df: DataFrame, *, binder: list[str], fibers: list[str], water: str, sand: str, admixture: str
) -> DataFrame:
    """Totals (strict), ratios to total binder (safe), then the summed components are dropped."""
    total_binder = strict_sum([F.col(c) for c in binder])
    total_scm = strict_sum([F.col(c) for c in binder[1:]])
    total_fiber = strict_sum([F.col(c) for c in fibers])
    return df.select(
        "*",
        total_binder.alias("total_binder"),
        total_scm.alias("total_scm"),
        total_fiber.alias("total_fiber_amount"),
        safe_ratio(F.col(water), total_binder).alias("water_binder_ratio"),
        safe_ratio(total_scm, total_binder).alias("scm_binder_ratio"),
        safe_ratio(F.col(sand), total_binder).alias("sand_binder_ratio"),
        safe_ratio(F.col(admixture), total_binder).alias("superplasticizer_binder_ratio"),
        safe_ratio(total_fiber, total_binder).alias("fiber_binder_ratio"),
    ).drop(*binder, *fibers)
