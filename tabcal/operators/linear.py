"""Linear models from distributed cross products: one pass serves every fold and every candidate.

MLlib estimators with penalties mapped to the (alpha, l1_ratio) convention are in
``tabcal.operators.models``; here the data is reduced to one d x d matrix per fold.
"""

from __future__ import annotations

import json
import time
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from tabcal.operators import kernels
from tabcal.operators.gram import correlations, pair_moments
from tabcal.operators.scale import attach, with_scalars

cloudpickle.register_pickle_by_value(kernels)


COEFFICIENTS = ["n", "coef", "intercept", "feature_mean", "feature_sd", "noise_precision", "covariance"]
COEFFICIENT_SCHEMA = (
    "n double, coef array<double>, intercept double, feature_mean array<double>, feature_sd array<double>, "
    "noise_precision double, covariance array<double>"
)


def cross_products(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, n, s, q, mu): count, sums and packed products of the columns around their overall means.

    All sums are ordinary partial aggregates, so a hot key is combined on the map side.
    """
    columns = list(columns)
    means = df.agg(F.array(*[F.avg(F.col(c).cast("double")) for c in columns]).alias("mu"))
    rows = with_scalars(df.select(*keys, *columns), means).select(
        *keys, *[(F.col(c).cast("double") - F.col("mu")[i]).alias(f"_z{i}") for i, c in enumerate(columns)]
    ).dropna(subset=[f"_z{i}" for i in range(len(columns))])
    z = [F.col(f"_z{i}") for i in range(len(columns))]
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.array(*[F.sum(c) for c in z]).alias("s"),
        F.array(*[F.sum(z[i] * z[j]) for i in range(len(z)) for j in range(i, len(z))]).alias("q"),
    )
    return with_scalars(sums, means)


def total(sums: DataFrame, width: int) -> DataFrame:
    """Sum of all keys' cross products, as one row."""
    packed = width * (width + 1) // 2
    add = lambda c, k: F.array(*[F.sum(F.col(c)[i]) for i in range(k)])
    return sums.agg(F.sum("n").alias("n"), add("s", width).alias("s"), add("q", packed).alias("q"), F.max("mu").alias("mu"))


def without_each(sums: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Per key, the cross products of all OTHER keys: total minus own, no fold is expanded."""
    all_rows = total(sums, width).select(F.col("n").alias("_tn"), F.col("s").alias("_ts"), F.col("q").alias("_tq"))
    joined = with_scalars(sums, all_rows)
    minus = lambda a, b: F.zip_with(F.col(a), F.col(b), lambda x, y: x - y)
    return joined.select(*keys, (F.col("_tn") - F.col("n")).alias("n"), minus("_ts", "s").alias("s"), minus("_tq", "q").alias("q"), "mu")


def fit(sums: DataFrame, keys: Sequence[str], features: Sequence[str], kind: str, *, scaled: bool = True, **params) -> DataFrame:
    """(keys, n, coef, intercept, noise_precision, covariance) for each row of cross products."""
    key_schema = "".join(f"`{k}` {t}, " for k, t in sums.select(*keys).dtypes) if keys else ""
    names = list(keys)

    def run(batches):
        for pdf in batches:
            out = [[row[k] for k in names] + kernels.fit_row(kind, row, scaled, params) for row in pdf.to_dict("records")]
            yield pd.DataFrame(out, columns=names + COEFFICIENTS)

    return sums.select(*names, "n", "s", "q", "mu").mapInPandas(run, key_schema + COEFFICIENT_SCHEMA)


def fit_all(sums: DataFrame, kind: str, *, scaled: bool = True, **params) -> DataFrame:
    """The model of the one row of ``sums``, solved on the driver (d x d) and pinned."""
    return sums.sparkSession.createDataFrame([kernels.fit_row(kind, sums.first(), scaled, params)], COEFFICIENT_SCHEMA)


def dot(features: Sequence[str], coef: str = "coef", intercept: str = "intercept") -> Column:
    return sum((F.col(c).cast("double") * F.col(coef)[i] for i, c in enumerate(features)), F.col(intercept))


def score(df: DataFrame, fitted: DataFrame, keys: Sequence[str], features: Sequence[str], *, bounded: bool = False) -> DataFrame:
    """Add ``prediction`` (and ``prediction_sd`` where the model has a covariance)."""
    stats = fitted.select(*keys, "coef", "intercept", "feature_mean", "feature_sd", "noise_precision", "covariance")
    rows = attach(df, stats, keys, bounded=bounded, count_rows=bool(keys) and not bounded)
    p = len(features)
    unit = [
        (F.col(c).cast("double") - F.col("feature_mean")[i]) / F.col("feature_sd")[i] for i, c in enumerate(features)
    ]
    spread = sum((unit[i] * unit[j] * F.col("covariance")[i * p + j] for i in range(p) for j in range(p)), F.lit(0.0))
    return rows.select(
        *df.columns, dot(features).alias("prediction"),
        F.when(F.col("noise_precision").isNotNull(), F.sqrt(spread + 1 / F.col("noise_precision"))).alias("prediction_sd"),
    )


def fit_linear(df: DataFrame, features: Sequence[str], target: str, kind: str, **params) -> DataFrame:
    """Fit on all given rows; the result is one pinned row of coefficients."""
    return fit_all(cross_products(df, [], [*features, target]), kind, **params)


def coefficient_table(fitted: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, coefficient, absolute value) of the standardised features, largest first."""
    cells = F.array(*[
        F.struct(F.lit(c).alias("feature"), (F.col("coef")[i] * F.col("feature_sd")[i]).alias("coefficient"))
        for i, c in enumerate(features)
    ])
    return fitted.select(F.inline(cells)).select("*", F.abs("coefficient").alias("absolute")).orderBy(F.desc("absolute"), "feature")


def leave_group_out(df: DataFrame, group: str, features: Sequence[str], target: str, kind: str, minimum_rows: int = 1, **params) -> DataFrame:
    """Rows of every eligible group scored by the model fitted on all other groups.

    One aggregation pass gives each group's cross products; each fold's training matrix is the
    total minus the group's own.
    """
    sums = cross_products(df, [group], [*features, target])
    folds = without_each(sums, [group], len(features) + 1)
    eligible = sums.where(F.col("n") >= minimum_rows).select(group, F.col("n").alias("_own"))
    folds = attach(folds, eligible, [group]).where("_own IS NOT NULL").drop("_own")  # before any model is solved
    fitted = fit(folds, [group], features, kind, **params)
    return score(df, fitted, [group], features).where("prediction IS NOT NULL")


def grid_search(df: DataFrame, fold: str, features: Sequence[str], target: str, candidates: Sequence[tuple[str, dict]]) -> DataFrame:
    """(model, candidate_parameters, fold, cv and train RMSE, fit seconds), from per-fold cross products.

    Both errors of every candidate come from the matrices, so the rows are read once however
    many candidates there are.  Scaling is refitted inside each fold.
    """
    width = len(features) + 1
    held = cross_products(df, [fold], [*features, target])
    held = held.select(fold, *[F.col(c).alias(f"h_{c}") for c in ("n", "s", "q")], "mu")
    train = without_each(held.select(fold, *[F.col(f"h_{c}").alias(c) for c in ("n", "s", "q")], "mu"), [fold], width)
    rows = attach(train, held.drop("mu"), [fold], bounded=True)
    options = F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.lit(json.dumps(params, sort_keys=True)).alias("params")) for kind, params in candidates
    ])
    spread = rows.select("*", F.explode(options).alias("o")).select(
        F.col(fold).cast("long").alias("fold"), F.col("o.kind").alias("kind"), F.col("o.params").alias("params"),
        "n", "s", "q", "mu", "h_n", "h_s", "h_q",
    )

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                cross, shift = kernels.unpack(row["n"], row["s"], row["q"])
                held_cross, held_shift = kernels.unpack(row["h_n"], row["h_s"], row["h_q"])
                started = time.perf_counter()
                coef, _, _ = kernels.fit_scaled(row["kind"], row["n"], cross, json.loads(row["params"]))
                took = time.perf_counter() - started
                p = len(coef)
                move = held_shift - shift
                gap = move[p] - coef @ move[:p]
                cv = kernels.sum_squared_error(coef, gap, row["h_n"], held_cross, held_shift)
                own = kernels.sum_squared_error(coef, 0.0, row["n"], cross, shift)
                out.append((row["kind"], row["params"], row["fold"], (cv / row["h_n"]) ** 0.5, (own / row["n"]) ** 0.5, took))
            yield pd.DataFrame(out, columns=["model", "candidate_parameters", "fold", "cv_RMSE", "train_RMSE", "fit_seconds"])

    return spread.mapInPandas(run, "model string, candidate_parameters string, fold long, cv_RMSE double, train_RMSE double, fit_seconds double")


def cv_table(fold_scores: DataFrame) -> DataFrame:
    """Candidate table: rank, mean and sd of the CV error, train error, fit time."""
    from pyspark.sql import Window as W

    per = fold_scores.groupBy("model", "candidate_parameters").agg(
        F.avg("cv_RMSE").alias("mean_cv_RMSE"), F.stddev_pop("cv_RMSE").alias("std_cv_RMSE"),
        F.avg("train_RMSE").alias("mean_train_cv_RMSE"),
        F.avg("fit_seconds").alias("mean_fit_time_seconds"), F.stddev_pop("fit_seconds").alias("std_fit_time_seconds"),
    )
    rank = F.rank().over(W.partitionBy("model").orderBy("mean_cv_RMSE")).cast("long")  # one row per candidate
    return per.select("model", "candidate_parameters", rank.alias("rank_cv_RMSE"), *per.columns[2:])


def best_candidates(table: DataFrame) -> DataFrame:
    return table.groupBy("model").agg(
        F.count(F.lit(1)).alias("candidate_count"), F.min("mean_cv_RMSE").alias("best_cv_RMSE"),
        F.min_by("candidate_parameters", F.struct("mean_cv_RMSE", "candidate_parameters")).alias("best_parameters"),
    )


def vif_table(train: DataFrame, features: Sequence[str]) -> DataFrame:
    """VIF per kept feature; absent, fully missing and constant columns are reported as dropped."""
    from tabcal.operators.encode import impute

    spark = train.sparkSession
    present = [c for c in features if c in train.columns]
    facts = train.agg(*[f for i, c in enumerate(present) for f in (
        F.count(c).alias(f"_n{i}"), (F.min(c) == F.max(c)).alias(f"_c{i}"))]).first()
    status = {c: "not_present_in_X_train" for c in features if c not in present}
    for i, c in enumerate(present):
        status[c] = "fully_missing" if facts[f"_n{i}"] == 0 else "constant_or_single_unique_value" if facts[f"_c{i}"] else ""
    kept = [c for c in features if status[c] == ""]
    rows = [(c, "dropped", status[c], None, None, None) for c in features if status[c]]
    if len(kept) == 1:
        rows.append((kept[0], "kept", "", None, None, "not_enough_features"))
    elif kept:
        filled = impute(train.select(*[F.col(c).cast("double").alias(c) for c in kept]), train, kept, "median")
        for c, v in zip(kept, kernels.vif_from_correlation(correlations(pair_moments(filled, kept)))):  # one d x d matrix
            label = (
                "near-perfect multicollinearity" if np.isinf(v) else "acceptable" if v < 5 else "high" if v < 10 else "severe"
            )
            rows.append((c, "kept", "", float(v), float(1 - 1 / v), label))
    return spark.createDataFrame(
        rows, "feature string, status string, reason string, VIF double, R2_against_other_features double, interpretation string"
    )


def vif_summary(table: DataFrame, policy: str) -> DataFrame:
    kept = table.where("VIF IS NOT NULL")
    finite = F.when(F.abs("VIF") != float("inf"), F.col("VIF"))
    return kept.agg(
        F.lit(policy).alias("policy"), F.max("VIF").alias("max_vif"), F.percentile(finite, 0.5).alias("median_vif"),
        F.count_if(F.col("VIF") >= 5).alias("number_features_vif_above_5"),
        F.count_if(F.col("VIF") >= 10).alias("number_features_vif_above_10"),
        F.count_if(F.col("VIF") == float("inf")).alias("number_inf_vif"),
    )
