"""Clean, recode, split and audit one raw table under several missingness policies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tabcal.functions.text import normalize_blanks
from tabcal.operators import audit as A, columns as C, profile as P, recode as K
from tabcal.operators.ordering import union_ragged
from tabcal.operators.splits import random_split


def prepare(raw: DataFrame, *, target: str, numeric: Sequence[str]) -> DataFrame:
    """Blank markers to NULL, rows with a target, numeric columns coerced."""
    return C.coerce_columns(C.valid_target_rows(normalize_blanks(raw), target), numeric)


def run_policy(
    df: DataFrame, *, policy: str, threshold: float | None, row_id: str, group: str, target: str, features: Sequence[str],
    pairs: Sequence[K.Pair], fractions: dict[str, float], seed: int,
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The modelling table of one policy (with a split column) and its audit tables."""
    kept_report = C.missingness_policy(df, features, threshold)
    kept = [r.feature for r in kept_report.where("kept").select("feature").collect()]
    base = df.select(row_id, group, target, *kept)
    recoded = K.recode_pairs(base, pairs)
    split = random_split(recoded, row_id, fractions, seed)
    train = split.where("split = 'train'")
    numeric, labels = C.type_partition(split, kept)
    empty_report = P.fully_missing_audit(train, numeric) if numeric else None
    reports = {
        "feature_missingness_policy": kept_report,
        "recode_summary": K.recode_summary(base, pairs),
        "missing_before_after": P.missing_before_after(base.select(*kept), recoded.select(*kept)),
        "split_summary": A.split_summary(split, split="split", group=group, target=target, features=kept),
    }
    if empty_report is not None:
        gone = [r["column"] for r in empty_report.where("fully_missing_in_train").select("column").collect()]
        split = split.drop(*gone)
        reports["fully_missing_audit"] = empty_report
    if labels:
        reports["cardinality_report"] = P.cardinality_report(train, labels)
    return split, {k: C.add_labels(v, {"policy": policy}) for k, v in reports.items()}


def run_policies(df: DataFrame, policies: dict[str, float | None], **arguments) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Every policy's table, and each kind of audit as one union over the policies."""
    tables, reports = {}, {}
    for policy, threshold in policies.items():
        tables[policy], found = run_policy(df, policy=policy, threshold=threshold, **arguments)
        for name, report in found.items():
            reports.setdefault(name, []).append(report)
    return tables, {name: union_ragged(parts) for name, parts in reports.items()}


def preprocessing_summary(tables: dict[str, DataFrame], outputs: Sequence[str]) -> DataFrame:
    """Widths and NULLs left per split after the transform, per policy."""
    out = []
    for policy, df in tables.items():
        nulls = sum((F.col(f"`{c}`").isNull().cast("long") for c in outputs), F.lit(0).cast("long"))
        per = df.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(nulls).alias("nulls_remaining"))
        out.append(per.select(F.lit(policy).alias("policy"), "*", F.lit(len(outputs)).cast("long").alias("output_columns")))
    return union_ragged(out)
