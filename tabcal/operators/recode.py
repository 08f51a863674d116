"""Semantic recoding of missing amount/type pairs and conditional group imputation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tabcal.functions.rules import NOT_APPLICABLE, UNKNOWN_TYPE
from tabcal.functions.text import first_number, number_column
from tabcal.operators.scale import attach

Pair = tuple[str, str, str]  # label, amount column, type column


def _pair_conditions(df: DataFrame, amount: str, kind: str):
    value, label = number_column(df, amount), F.col(kind)
    positive = F.coalesce(value > 0, F.lit(False)) & label.isNull()
    unused = (value.isNull() | F.coalesce(value == 0, F.lit(False))) & label.isNull()
    return value, label, positive, unused


def recode_pairs(df: DataFrame, pairs: Sequence[Pair]) -> DataFrame:
    """amount>0 & no type -> unknown_type; no/zero amount & no type -> 0 and not_applicable.

    An absent amount next to a given type is left alone.  Every expression reads the
    original columns, so all pairs are one projection.
    """
    new = {}
    for _, amount, kind in pairs:
        if amount not in df.columns or kind not in df.columns:
            continue
        value, label, positive, unused = _pair_conditions(df, amount, kind)
        new[amount] = F.when(unused, F.lit(0.0)).otherwise(value)
        new[kind] = F.when(positive, F.lit(UNKNOWN_TYPE)).when(unused, F.lit(NOT_APPLICABLE)).otherwise(label)
    return df.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])


# Names of the summary's counters.
SUMMARY_COUNTERS = [
    "amount_missing_before", "type_missing_before", "both_missing_before",
    "amount_positive_type_missing_to_unknown_type",
    "amount_zero_or_missing_type_missing_to_not_applicable",
    "type_present_amount_missing_left_missing",
    "amount_missing_after", "type_missing_after", "amount_zero_after",
    "unknown_type_after", "not_applicable_after",
]


def recode_summary(df: DataFrame, pairs: Sequence[Pair]) -> DataFrame:
    """One row per pair with before/after counters; one aggregate pass for all pairs."""
    rows = []
    for label_text, amount, kind in pairs:
        head = [F.lit(label_text).alias("pair"), F.lit(amount).alias("amount_col"), F.lit(kind).alias("type_col")]
        if amount not in df.columns or kind not in df.columns:
            rows.append(F.struct(
                *head, F.lit(False).alias("applied"),
                F.lit("amount_or_type_column_not_in_policy").alias("reason"),
                *[F.lit(None).cast("long").alias(c) for c in SUMMARY_COUNTERS],
            ))
            continue
        value, label, positive, unused = _pair_conditions(df, amount, kind)
        zero = F.coalesce(value == 0, F.lit(False))
        tests = [
            value.isNull(), label.isNull(), value.isNull() & label.isNull(), positive, unused,
            value.isNull() & label.isNotNull(), value.isNull() & ~unused, label.isNull() & ~positive & ~unused,
            zero | unused, positive | F.coalesce(label == UNKNOWN_TYPE, F.lit(False)),
            unused | F.coalesce(label == NOT_APPLICABLE, F.lit(False)),
        ]
        rows.append(F.struct(
            *head, F.lit(True).alias("applied"), F.lit("semantic_rules_applied").alias("reason"),
            *[F.count_if(t).alias(c) for t, c in zip(tests, SUMMARY_COUNTERS)],
        ))
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def recode_with_dependents(
    df: DataFrame, name: str, amount: str, kind: str | None, extras: Sequence[str] = (), *, flag: bool = True
) -> DataFrame:
    """Stronger recode: no/zero amount forces not_applicable even over a given type.

    Dependent columns of an unused ingredient become 0; the flag marks rows whose type
    column is filled (so always, when there is one) while the amount is blank.
    """
    value = first_number(F.col(amount).cast("string"))
    unused = value.isNull() | F.coalesce(value == 0, F.lit(False))
    new = {amount: F.coalesce(value, F.lit(0.0))}
    if kind is not None:
        new[kind] = (
            F.when(unused, F.lit(NOT_APPLICABLE))
            .when(F.col(kind).isNull(), F.lit(UNKNOWN_TYPE))
            .otherwise(F.col(kind))
        )
    for extra in extras:
        new[extra] = F.when(unused, F.lit(0.0)).otherwise(first_number(F.col(extra).cast("string")))
    out = [new[c].alias(c) if c in new else F.col(c) for c in df.columns]
    if flag:
        out.append(value.isNull().cast("double").alias(f"{name}_amount_is_missing"))
    return df.select(*out)


def conditional_group_impute(
    df: DataFrame, train: DataFrame, method: str, numerics: Sequence[str]
) -> DataFrame:
    """Label a blank method from its numeric siblings, then fill numerics by method mean.

    Means are learned from ``train`` before relabelling, so relabelled rows use the
    train-wide mean unless that label already occurred.
    """
    numerics = list(numerics)
    reported = F.lit(False)
    for c in numerics:
        reported = reported | F.coalesce(F.col(c) >= 0, F.lit(False))
    label = F.coalesce(F.col(method), F.when(reported, F.lit(UNKNOWN_TYPE)).otherwise(F.lit(NOT_APPLICABLE)))
    per_method = train.where(F.col(method).isNotNull()).groupBy(method).agg(
        F.count(F.lit(1)).alias("_rows"), *[F.avg(c).alias(f"_m_{c}") for c in numerics]
    )
    overall = train.agg(*[F.avg(c).alias(f"_g_{c}") for c in numerics])
    relabelled = df.withColumn(method, label)
    joined = attach(relabelled, per_method, [method], size_col="_rows")
    joined = attach(joined, overall, [])
    return joined.select(*[
        F.coalesce(F.col(c), F.col(f"_m_{c}"), F.col(f"_g_{c}")).alias(c) if c in numerics else F.col(c)
        for c in df.columns
    ])
